"""Main text of pages: furniture goes, the article stays, whatever the markup."""

import os
import random
import re
import time

import pytest

from lacuna.llm.html_text import main_text, op1

LONG = "A sentence of the article that goes on for a while, with words enough to be text. " * 3


def page(body):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t='</p>';</script></head><body>{body}</body></html>"


FURNITURE = {
    "menu": "<nav><ul><li><a href=/>Home</a></li><li><a href=/a>About</a></li></ul></nav>",
    "header": "<header><h1>Site name</h1></header>",
    "footer": "<footer>&copy; somebody</footer>",
    "sidebar": "<aside><p>Other things to read here.</p></aside>",
    "advert": '<div class="ad-box"><p>Buy this thing now.</p></div>',
    "notice": '<div id="cookieNotice">We use cookies.</div>',
    "form": "<form><label>Name</label><input name=n><button>Send</button></form>",
    "comments": '<section class="comments"><p>First!</p><p>I disagree.</p></section>',
    "script": "<script>if (a < b) document.write('<p>x</p>')</script>",
    "comment": "<!-- <p>not shown</p> -->",
    "hidden": "<div hidden>secret</div>",
    "links": "<ul><li><a href=1>One more story</a></li><li><a href=2>Another story</a></li></ul>",
}


@pytest.mark.parametrize("kind", FURNITURE)
def test_furniture(kind):
    part = FURNITURE[kind]
    article = f"<article><h1>Title</h1><p>{LONG}</p><p>Short end.</p></article>"
    want = "\n".join(["Title", " ".join(LONG.split()), "Short end."])
    assert main_text(page(part + article)) == want
    assert main_text(page(article + part)) == want


@pytest.mark.parametrize(
    "html",
    [
        '<div class="page with-sidebar"><article>{}</article></div>',
        '<div class="nav-layout"><div><h1>Title</h1>{}</div><div class="sidebar">more to read</div></div>',
        '<article>{}<section class="comments"><article class="comment"><p>' + LONG * 4 + "</p></article></section></article>",
        '<main>{}<ol class="commentlist"><li>' + LONG * 5 + '</li></ol></main><div class="related"><h3>Related</h3><p>' + LONG + "</p></div>",
    ],
)
def test_wrappers_and_comments(html):
    text = " ".join(LONG.split())
    assert main_text(page(html.format(f"<p>{LONG}</p><p>{LONG}</p>"))).removeprefix("Title\n") == f"{text}\n{text}"


@pytest.mark.parametrize(
    "part, text",
    [
        ("<ul><li><a href=/1>The first source</a></li><li><a href=/2>The second source</a></li></ul>", "The first source\nThe second source"),
        ('<section class="related-work"><h2>Related work</h2><p>Others did this before us, at some length.</p></section>', "Related work\nOthers did this before us, at some length."),
        ('<h2 id="social">Social history</h2>', "Social history"),
        ('<section id="social-history"><p>Short.</p></section>', "Short."),
        ('<p class="ad-hoc">An ad hoc remark.</p>', "An ad hoc remark."),
        (f'<div class="notice"><p>{LONG}</p></div>', " ".join(LONG.split())),
        ('<div class="ad">Buy it.</div>', None),
        ('<div class="google-ads"><p>Buy it.</p></div>', None),
        ('<div class="notice">Please log in.</div>', None),
        ('<div class="reader-comments"><p>Well said!</p></div>', None),
        ('<div class="share-buttons"><a href=/f>Share</a></div>', None),
        ("<form><p>Your name</p></form>", None),
    ],
)
@pytest.mark.parametrize("tag", ["article", "div", None])
def test_inside_the_article(part, text, tag):
    """Names and links alone drop nothing from the article; adverts, comments and light furniture go."""
    inner = f"<h1>Title</h1><p>{LONG}</p><p>{LONG}</p><h2>Sources</h2>{part}<p>{LONG}</p>"
    html = page(f"{FURNITURE['menu']}{f'<{tag}>{inner}</{tag}>' if tag else inner}{FURNITURE['footer']}")
    long = " ".join(LONG.split())
    assert main_text(html) == "\n".join(["Title", long, long, "Sources", *([text] if text else []), long])


def test_tags_only_break_ties():
    """Densities choose between articles; a light rest joins the core only within its own article."""
    long = " ".join(LONG.split())
    teasers = "".join(f"<article><h2>Teaser {k}</h2><p>Read on.</p></article>" for k in range(6))
    assert main_text(page(f"{teasers}<div><p>{LONG}</p><p>{LONG}</p></div>")) == f"{long}\n{long}"
    inner = f"<div><p>{LONG}</p><p>{LONG}</p></div><p>By A.</p>"
    assert main_text(page(f"<article>{inner}</article><p>Thin.</p>")) == f"{long}\n{long}\nBy A."
    assert main_text(page(f"<div>{inner}</div><p>Thin.</p>")) == f"{long}\n{long}"


@pytest.mark.parametrize("seed", range(30))
def test_random_pages(seed):
    """Pages built from known articles and furniture, with and without the article's own element."""
    r = random.Random(seed)
    say = lambda n: " ".join("".join(r.choice("aeioulmnrst") for _ in range(r.randint(2, 9))) for _ in range(n))
    blocks = [say(6)] + [say(r.randint(25, 80)) for _ in range(r.randint(2, 9))]
    inner = f"<h1>{blocks[0]}</h1>" + "".join(f"<p>{b}</p>" if r.random() < 0.7 else f"<div><p>{b}</div>" for b in blocks[1:])
    tag = r.choice(["article", "main", "div", "section"])
    parts = [f"<{tag}>{inner}</{tag}>"] + r.sample([v for k, v in FURNITURE.items() if k != "header"], 5)
    r.shuffle(parts)
    assert main_text(page("".join(parts))) == "\n".join(blocks)


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.1/pages.parquet"), reason="no tables here")
def test_pages_without_their_article_tags():
    """The densities find the same text on every page when article and main say nothing."""
    import pyarrow.parquet as pq

    pages = [h for h in pq.read_table("/root/testdata/sf0.1/pages.parquet")["html"].to_pylist() if h]
    for html in pages:
        text = main_text(html)
        assert text == main_text(re.sub(r"<(/?)(article|main)\b", r"<\1div", html)) == main_text(re.sub(r"</?(article|main)\b[^>]*>", "", html))


def test_blocks_and_references():
    html = page("<article><p>a&nbsp;&amp; b<br>c <b>d\n e</b><p>f &#x41;&lt;g&gt;<div>h<p>i</div></article>")
    assert main_text(html) == "a & b c d e\nf A<g>\nh\ni"


def test_without_article():
    html = page(f"<div class=top><a href=/>x</a> <a href=/b>y</a></div><div><div><p>{LONG}</p><p>{LONG}</p></div><div><p>{LONG}</p></div></div>")
    assert main_text(html) == "\n".join([" ".join(LONG.split())] * 3)


def test_growth_stops_at_thin_text():
    text = " ".join(LONG.split())
    left = "<div><div>Shop</div><div>News now</div><div>Call us</div><div>Map</div></div>"
    two = f"<div><p>{LONG}</p><p>{LONG}</p></div>"
    assert main_text(page(f"<div>{left}{two}</div>")) == f"{text}\n{text}"
    assert main_text(page(f"<div><h1>Title</h1>{two}{two}</div>")) == "\n".join(["Title"] + [text] * 4)
    assert main_text(page(f"{two}{two}")) == "\n".join([text] * 4)


@pytest.mark.parametrize("html", [None, "", "<", "<>", "<p", "</p></div>", "<!--", "<script>", '<a href="', "<![CDATA[", "&#xffffffff;", "<p class='x", "<" * 2000])
def test_broken(html):
    assert isinstance(main_text(html), str)


def test_unclosed_and_text_only():
    assert main_text("just text &amp; more") == "just text & more"
    assert main_text(f"<body><article><p><b>{LONG}<p>end") == " ".join(LONG.split()) + "\nend"


def test_long_page_is_linear():
    html = page("<article>" + "<p>word</p>" * 60_000 + "</article>")
    assert main_text(html).count("\n") == 59_999
    assert len(main_text("<div>" * 30_000 + "x")) == 1


@pytest.mark.parametrize(
    "html",
    ["<a " * 350_000, '<a "> <b "x ' * 80_000, "<p a='" * 200_000, "<div>" * 60_000 + "</section>" * 60_000, "<div>" * 40_000 + "<li></li>" * 40_000]
    + ["<div>" + "<b>" * 40_000 + "<p>x</p>" * 40_000, "<b><div>" + "<i>" * 40_000 + "</b>" * 40_000, '<div class="ad">' * 40_000 + "<h1>x</h1>" * 5000]
    + ["<article>" * 40_000 + "x", "<script>" * 100_000, "&" * 500_000, "<p " + 'a="' * 200_001 + ">x", "<div>" * 3000 + "<h1>a</h1>" * 30_000],
)
def test_broken_markup_is_linear(html):
    began = time.process_time()
    main_text(html)
    assert time.process_time() - began < 8


def test_query(spark):
    rows = [(1, "u", page(f"<p>{LONG}</p><p>é</p>")), (1, "u", None), (None, None, "")]
    got = op1(spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS text")).collect()
    assert sorted((r.text, r.n_chars) for r in got) == [("", 0), ("", 0), (t := " ".join(LONG.split()) + "\né", len(t))]
    assert op1(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
