"""Main text of HTML pages from parser events, text-to-tag ratios and threshold clustering.

The standard library's streaming parser turns a page into lines, one per block. Each line has a
text-to-tag ratio; the ratios, in page order, are smoothed with a Gaussian kernel and clustered in one
dimension into content and the rest. Regions of content lines are the article: every `article` that holds
one, whole; beside it in `main`, the content lines themselves; without either, all from the first content
line to the last within the smallest element that holds them all, the headings just before, and in a bare
body the paragraphs without links just before and after. What tags, roles, classes and ids say only takes
out menus, headers, footers, sidebars, notices, adverts, forms and comments first; a class never takes out
an `article` or `main`, and within one only names that stand for such a block (`set_apart`).

Null or empty html gives an empty text. Each row stands alone: repeated rows and extra columns change
nothing, and nothing is shuffled. Pages are taken whole, however long. Ratios that are all alike make one
cluster: all lines are content. Nothing in the article is dropped or cut.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy.llm.common import table

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rt s samp small span strike strong sub sup time tt u var wbr img".split())
#: Left out with all they hold; a header only where no article holds it, as it may hold the title.
SKIP = frozenset("script style noscript template head title nav aside form button select option textarea iframe object svg canvas audio video map dialog menu footer".split())
#: What a head may hold; anything else ends it.
HEAD = frozenset("head title style script meta link base noscript template".split())
#: Elements that close themselves when the next one opens, so they aren't kept on the stack.
LOOSE = frozenset("p li dt dd tr td th thead tbody tfoot colgroup optgroup h1 h2 h3 h4 h5 h6".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
CUE = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|advertising|sponsor(?:ed|s)?|promo(?:tion)?s?|banner|cookies?|consent|gdpr|notice|notices|alert|popup|modal|overlay|newsletter|subscribe|signup|paywall|sidebar|side-?bar|aside|widget|menu|nav|navbar|navigation|breadcrumbs?|footer|header|masthead|topbar|share|sharing|social|related|recommended|recommendations|comments?|comment-list|replies|reply|disqus|login|search|pagination|pager|toolbar|copyright|disclaimer|form)(?:$|[\s_-])",
    re.IGNORECASE,
)
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
#: Classes of adverts and the like within an article, as whole names or before a hyphen.
INNER = re.compile(r"(?:^|\s)(?:ads?|adverts?|advertisement|sponsored|promo|newsletter|subscribe|share|sharing|social|related|recommended|comments?|sidebar|breadcrumbs?|popup|modal)(?:$|\s)|(?:^|\s)(?:ads?|adverts?|advertisement|sponsored|cookie)-", re.IGNORECASE)
#: Names of blocks within an article that aren't its text: readers' remarks by any part of a name, others by its first, links to other pages only by names made of these words alone.
REMARKS = frozenset("comment comments commentlist commentarea disqus replies".split())
NOT_TEXT = frozenset("ad ads advert adverts advertisement sponsored cookie cookies newsletter subscribe subscription signup promo sidebar popup modal breadcrumb breadcrumbs".split())
LINKS = frozenset("share sharing social related recommended recommendations".split())
OF_LINKS = LINKS | frozenset("buttons button bar links link tools box icons this widget posts post articles article stories story content news items reading topics list media block section area container wrapper panel".split())
PREFIXES = frozenset("article post entry story page site content block section widget js".split())
#: Elements that such a name takes out by id, too; a paragraph or heading may bear one as the target of a link.
CONTAINERS = frozenset("div section ul ol dl figure details fieldset table center".split())
OTHER = re.compile(r"comment|repl(?:y|ies)|promo|related|teaser", re.IGNORECASE)
WIDTH = 1.5
#: Tags of a paragraph at the ends of a bare body that is taken for text, its own among them; lists of links have more.
PLAIN = 2
#: Why an element is left out: by its class, by its kind.
BY_CLASS, BY_KIND = 1, 2


def set_apart(names: str) -> bool:
    """Whether classes or ids, like `article-comments`, `shareButtons` or `related_posts`, name a block that is no text of an article."""
    for name in names.split():
        parts = [p for p in re.split(r"[-_]+|(?<=[a-z])(?=[A-Z])", name) if p]
        parts = [p.lower() for p in parts]
        if REMARKS.intersection(parts):
            return True
        while len(parts) > 1 and parts[0] in PREFIXES:
            parts = parts[1:]
        if parts and (parts[0] in NOT_TEXT or parts[0] in LINKS and OF_LINKS.issuperset(parts)):
            return True
    return False


class Lines(HTMLParser):
    """Collects (text, tags, element, heading, paragraph) for each block that isn't left out, and each element's parent and kind."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, int, int]] = [("", 0, 0)]  # tag, element, why it is left out
        self.parents, self.kinds = [-1], [""]
        self.lines: list[tuple[str, int, int, bool, bool]] = []
        self.text: list[str] = []
        self.tags, self.articles, self.heading, self.paragraph = 0, 0, False, False
        self.open: Counter = Counter()  # tags on the stack

    def parse_marked_section(self, i, report=1):
        return self.parse_bogus_comment(i)

    def flush(self) -> None:
        if self.text:
            text = " ".join("".join(self.text).split())
            if text:
                self.lines.append((text, self.tags, self.stack[-1][1], self.heading, self.paragraph))
            self.text = []
        self.tags, self.heading, self.paragraph = 0, False, False

    def handle_starttag(self, tag, attrs):
        named = dict(attrs)
        hidden = "hidden" in named or bool(HIDDEN.search(named.get("style") or ""))
        if tag in INLINE and tag != "img":
            self.tags += 1
            if hidden or INNER.search(named.get("class") or ""):
                self._push(tag, self.stack[-1][1], BY_CLASS)
            return
        if tag in VOID:
            self.tags += 1
            self.text.append(" ")
            return
        self.flush()
        self.tags += 1
        if tag not in HEAD and self.open["head"]:
            for k, (t, _, _) in enumerate(self.stack):
                if t == "head":
                    self._pop(k)
                    break
        if self.stack[-1][0] in LOOSE and (self.stack[-1][0] in ("p", tag)):  # an open one ends where a block, or its like, begins
            self._pop(len(self.stack) - 1)
        role, classes = (named.get("role") or "").lower(), named.get("class") or ""
        article = tag in ("article", "main") or role in ("main", "article") or named.get("itemprop") == "articleBody"
        out = self.stack[-1][2]
        if article and out == BY_CLASS:
            out = 0
        if not out and (tag in SKIP or tag == "header" and not self.articles or role in ROLES or hidden):
            out = BY_KIND
        if not out and tag == "article" and OTHER.search(f"{classes} {named.get('id') or ''}"):
            out = BY_KIND
        elif not out and not article and tag not in ("body", "html"):
            inside = self.articles or tag in LOOSE
            apart = inside and tag in CONTAINERS and (set_apart(f"{classes} {named.get('id') or ''}") or named.get("itemprop") == "comment")
            if apart or INNER.search(classes) or not inside and any(CUE.search(named.get(k) or "") for k in ("class", "id")):
                out = BY_CLASS
        self.heading, self.paragraph = tag in ("h1", "h2", "h3"), tag == "p"
        if tag in LOOSE and not out:
            return
        self._push(tag, len(self.parents), out)
        self.parents.append(self.stack[-2][1])
        kind = ("main" if tag == "main" or role == "main" else "article") if article else tag
        self.kinds.append(kind)
        self.articles += kind in ("article", "main")

    def handle_startendtag(self, tag, attrs):
        if tag in VOID or tag in INLINE:
            self.handle_starttag(tag, attrs)
        else:
            self.handle_starttag(tag, attrs)
            self.handle_endtag(tag)

    def _push(self, tag: str, element: int, out: int) -> None:
        self.stack.append((tag, element, out))
        self.open[tag] += 1

    def _pop(self, k: int) -> None:
        for tag, i, _ in self.stack[k:]:
            self.open[tag] -= 1
            self.articles -= tag not in INLINE and self.kinds[i] in ("article", "main")
        del self.stack[k:]

    def handle_endtag(self, tag):
        if tag in INLINE:
            self.tags += 1
            if self.stack[-1][0] == tag:
                self._pop(len(self.stack) - 1)
            return
        if tag in VOID:
            return
        self.flush()
        if not self.open[tag]:
            return
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k][0] == tag:
                self._pop(k)
                break
            if tag in LOOSE and self.stack[k][0] not in LOOSE:
                break

    def handle_data(self, data):
        if not self.stack[-1][2]:
            self.text.append(data)


def content_lines(lengths: np.ndarray, tags: np.ndarray) -> np.ndarray:
    """Which lines are content: two-means clusters of the smoothed text-to-tag ratios."""
    ratio = np.log1p(lengths / np.maximum(tags, 1))
    r = int(3 * WIDTH)
    kernel = np.exp(-0.5 * (np.arange(-r, r + 1) / WIDTH) ** 2)
    smooth = np.convolve(ratio, kernel, "full")[r : r + ratio.size] / np.convolve(np.ones_like(ratio), kernel, "full")[r : r + ratio.size]
    low, high = smooth.min(), smooth.max()
    for _ in range(20):
        near = smooth - low > high - smooth
        if not near.any() or near.all():
            return np.ones(ratio.size, bool)
        a, b = smooth[~near].mean(), smooth[near].mean()
        if (a, b) == (low, high):
            break
        low, high = a, b
    return near


def main_blocks(html: str | None) -> list[str]:
    """The article's blocks in page order; [] for null, empty or textless html."""
    p = Lines()
    p.feed(html or "")
    p.close()
    p.flush()
    if not p.lines:
        return []
    lengths, tags = (np.array([f(x) for x in p.lines], float) for f in (lambda x: len(x[0]), lambda x: x[1]))
    content = content_lines(lengths, tags)
    at = np.array([x[2] for x in p.lines])
    n = len(p.parents)
    article, main = np.zeros(n, int), np.zeros(n, int)  # the outermost article that holds an element, and main, or 0
    for i in range(1, n):  # children come after their parents
        article[i] = article[p.parents[i]] or (i if p.kinds[i] == "article" else 0)
        main[i] = main[p.parents[i]] or (i if p.kinds[i] == "main" else 0)
    told = article[at]
    if content[told > 0].any():
        kept = np.isin(told, np.unique(told[content & (told > 0)])) & (told > 0) | content & (told == 0) & (main[at] > 0)
    elif content[main[at] > 0].any():
        kept = main[at] > 0
    else:
        last = np.arange(n)  # an element's descendants are the elements up to its last: all are numbered in page order
        for i in range(n - 1, 0, -1):
            last[p.parents[i]] = max(last[p.parents[i]], last[i])
        common, end = int(at[content].min()), int(at[content].max())
        while last[common] < end:
            common = p.parents[common]
        kept = (at >= common) & (at <= last[common])
        if p.kinds[common] in ("", "html", "body"):
            a, b = np.flatnonzero(content)[[0, -1]]
            plain = np.array([x[3] or x[4] and x[1] <= PLAIN for x in p.lines]) & (at == common)
            while a and plain[a - 1]:
                a -= 1
            while b + 1 < len(at) and plain[b + 1]:
                b += 1
            kept &= (np.arange(len(at)) >= a) & (np.arange(len(at)) <= b)
        first = int(kept.argmax())
        while first and p.lines[first - 1][3]:
            first -= 1
            kept[first] = True
    return [x[0] for x, k in zip(p.lines, kept, strict=True) if k]


def main_text(html: str | None) -> str:
    return "\n".join(main_blocks(html))


def extract(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url"), html: str = "html") -> DataFrame:
    """The columns of `keep` and `text`, the main text of `html`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h) for h in batch.column(len(keep)).to_pylist()]
            yield pa.record_batch([*batch.columns[:-1], pa.array(texts, pa.string())], [*keep, "text"])

    return pages.select(*keep, F.col(html).alias("__html")).mapInArrow(run, T.StructType([*(pages.schema[c] for c in keep), T.StructField("text", T.StringType())]))


def op5_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
