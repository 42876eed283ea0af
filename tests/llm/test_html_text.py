import html
import os
import random
import re
import time

import numpy as np
import pytest

from colloquy.llm import html_text as H

ARTICLE = """<!doctype html><html><head><title>Site</title><style>p{x:1}</style><script>var a = "<p>no</p>";</script></head><body>
<header><a href=/>Home</a></header><nav><ul><li>One</li><li>Two</li></ul></nav>
<div class="cookie-notice">We use cookies.</div>
<article><h1>A  title &amp; more</h1><p>First <b>para</b>graph
with&nbsp;white   space, long enough to be the text of an article.</p><ul><li>short</li></ul>
<div class="ad">Buy now</div><p>Second paragraph, caf&eacute; &#x2014; also long enough to count.</p></article>
<section class="comments"><p>First comment by a reader, which is long too.</p></section>
<form><input value=x><button>Send</button></form><aside>Related</aside><footer>Imprint</footer></body></html>"""
TEXT = "A title & more\nFirst paragraph with white space, long enough to be the text of an article.\nshort\nSecond paragraph, café — also long enough to count."


def test_main_text():
    assert H.main_text(ARTICLE) == TEXT
    assert H.main_text(ARTICLE.replace("article>", "div>")) == TEXT


def test_null_empty_broken_and_long():
    assert H.main_text(None) == H.main_text("") == H.main_text("<div><p></p>") == ""
    assert H.main_text("plain text only") == "plain text only"
    assert H.main_text("<p>an <i>unclosed element &lt; here") == "an unclosed element < here"
    assert H.main_text("<main>" + "<p>word word word word</p>" * 20_000 + "</main>") == "\n".join(["word word word word"] * 20_000)


def test_rows(spark):
    df = spark.createDataFrame([(1, "u", ARTICLE, "x"), (1, "u", ARTICLE, "x"), (None, None, None, None)], "page_id long, url string, html string, text string")
    got = sorted(((r.page_id, r.url, r.text) for r in H.extract(df).collect()), key=str)
    assert got == sorted([(1, "u", TEXT), (1, "u", TEXT), (None, None, "")], key=str) and H.extract(df.limit(0)).collect() == []


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<html><head><title>x</title><body><article><p>A text without the head's end</p></article></body></html>", "A text without the head's end"),
        ('<article><p>First<p class="ad">Buy<p>Second<p>Third</article>', "First\nSecond\nThird"),
        ('<article><h2 id="share-prices">Prices</h2><p id="related-work">Rise</p><div class="form">of things</div></article>', "Prices\nRise\nof things"),
        ("<article><header><h1>Title</h1></header><p>Text of it</p><footer>Copyright foot</footer></article>", "Title\nText of it"),
        ("<main><p>A lede of its own, as long as what follows it.</p><article><p>The article, as long as what it follows here.</p></article></main>", "A lede of its own, as long as what follows it.\nThe article, as long as what it follows here."),
        ('<article><p>Some <span class="ad">Buy <b>now</b></span>words</p></article>', "Some words"),
        ('<div class="sidebar-layout"><div class="menu">One</div><article><p>Held by a cue.</p></article></div>', "Held by a cue."),
        ("<body><div>Top | New</div><h1>A title</h1><div><p>" + "long words of a text " * 9 + "</p><p>short</p><p>" + "long words of a text " * 9 + "</p></div></body>", "A title\n" + ("long words of a text " * 9).strip() + "\nshort\n" + ("long words of a text " * 9).strip()),
    ],
)
def test_regions(page, text):
    assert H.main_text(page) == text


LONG = ("long words of a text " * 9).strip()
BLOCKS = [
    '<section id="comments"><p>{}</p></section>', '<div class="article-comments"><p>{}</p></div>', '<ol class="comment-list"><li>{}</li></ol>', '<ul class="commentlist"><li>{}</li></ul>', '<div class="share-buttons">{}</div>', '<div id="shareBar">{}</div>',
    '<div class="related-posts"><ul><li>{}</li></ul></div>', '<section class="post-related_articles">{}</section>', '<div class="newsletter-signup"><p>{}</p></div>', '<div id="newsletter">{}</div>', '<div itemprop="comment">{}</div>', '<div class="social-links">{}</div>',
]


@pytest.mark.parametrize("block", BLOCKS)
def test_blocks_within_an_article_that_are_no_text(block):
    other = block.format("A remark by someone who has read all of it, and at length.")
    assert H.main_text(f"<article><p>{LONG}</p>{other}<p>{LONG} end</p></article>") == f"{LONG}\n{LONG} end"
    assert H.main_text(f"<main><p>{LONG}</p>{other}<p>{LONG} end</p></main>") == f"{LONG}\n{LONG} end"


@pytest.mark.parametrize("name", ["related-work", "share-prices", "commentary", "social-history", "recommended-dose", "adaptive", "socialism", "signed-up", "cookiesheet"])
def test_names_that_only_look_like_them_stay(name):
    page = f'<article><p>{LONG}</p><section id="{name}"><p>Part of it</p></section><div class="{name}">and this</div><p>{LONG}</p></article>'
    assert H.main_text(page) == f"{LONG}\nPart of it\nand this\n{LONG}"


def test_ends_of_a_bare_body():
    assert H.main_text(f"<body><p>Hi.</p><p>{LONG}</p><p>{LONG}</p></body>") == f"Hi.\n{LONG}\n{LONG}"
    assert H.main_text(f"<body><p>{LONG}</p><p>{LONG}</p><p>End.</p></body>") == f"{LONG}\n{LONG}\nEnd."
    links = "<p><a href=x>Home</a> <a href=y>News</a></p>"
    assert H.main_text(f"<body>{links}<h1>T</h1><p>Hi.</p><p>{LONG}</p><p>{LONG}</p><p>End.</p>{links}</body>") == f"T\nHi.\n{LONG}\n{LONG}\nEnd."


def test_time_is_linear_in_nesting_and_stray_ends():
    n = 40_000
    for page in ("<div>x" * n, "<div>" * n + "</section>" * n, "<ul><li>" * n + "x", "<div><p>" * n + "y" * 200):
        start = time.process_time()
        H.main_text(page)
        assert time.process_time() - start < 6, page[:20]


def test_pages_without_an_article_against_what_they_were_made_of():
    """Pages made of a text and of what surrounds it, cut apart by the parts they were made of."""
    rng, words = random.Random(5), "one of these words makes a sentence with some others".split()
    for _ in range(200):
        text = [" ".join(rng.choice(words) for _ in range(rng.randrange(25, 60))) for _ in range(rng.randrange(3, 9))]
        title, chrome = "A title of it", ['<div class="menu"><a href=x>Home</a></div>', "<nav><ul><li>One</li></ul></nav>", '<div id="sidebar"><p>Elsewhere</p></div>', "<aside>Note</aside>", '<div class="comments"><p>Well said</p></div>', "<form><button>Go</button></form>"]
        around = [rng.choice(chrome) for _ in range(6)]
        holder = rng.choice(["div", "section"])
        body = f"<{holder}><h1>{title}</h1>" + "".join(f"<p>{t}</p>" + rng.choice(["", "<script>x</script>", '<div class="ad">Buy</div>']) for t in text) + f"</{holder}>"
        page = f"<html><head><title>t</title></head><body><header>Site</header>{''.join(around[:3])}{body}{''.join(around[3:])}<footer>Imprint</footer></body></html>"
        assert H.main_text(page) == "\n".join([title, *text])


def test_clusters_split_where_squares_are_least():
    rng = np.random.default_rng(2)
    for _ in range(50):
        n = int(rng.integers(12, 40))
        long = np.zeros(n, bool)
        long[n // 3 : 2 * n // 3] = True
        lengths = np.where(long, rng.integers(200, 400, n), rng.integers(3, 12, n)).astype(float)
        assert H.content_lines(lengths, np.ones(n))[long].all() and not H.content_lines(lengths, np.ones(n))[[0, -1]].any()
    assert H.content_lines(np.full(5, 7.0), np.ones(5)).all()


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="the driver's tables are not here")
def test_pages_match_a_plain_cut(spark):
    """The driver's pages, whose article is marked, against cutting them with regular expressions."""

    def plain(page):
        body = re.search(r"<article>(.*)</article>", re.sub(r"(?s)<!--.*?-->", "", page or ""), re.DOTALL)
        blocks = re.split(r"</?(?:p|h[1-6]|ul|ol|li|div|table|tr|td|blockquote|pre)\b[^>]*>", body[1] if body else "")
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"<br\s*/?>", " ", b))).split()) for b in blocks]
        return "\n".join(b for b in blocks if b)

    rows = H.extract(spark.read.parquet("/root/testdata/sf0.001/pages.parquet"), ("page_id", "url", "html")).collect()
    assert len(rows) > 20 and [r.text for r in rows] == [plain(r.html) for r in rows]
