import re

import pytest

from samplemill.llm import html_text as h

ARTICLE = "<h1>A title</h1><p>First &amp; second,<br>on two\n\t lines.</p><p>Short</p><ul><li>One point.</li><li>Another&nbsp;one</li></ul>"
WANTED = "A title\nFirst & second, on two lines.\nShort\nOne point.\nAnother one"
AROUND = {
    "menu": "<nav><ul><li><a href='/a'>Home</a></li><li>Products, services.</li></ul></nav>",
    "unclosed menu": "<nav><ul><li><a href='/a'>Home</a>",
    "header": "<header><h1>The site, with a long claim about itself.</h1></header>",
    "footer": "<footer>&copy; someone, somewhere. All of the rights, in all of the world.</footer>",
    "sidebar": "<div class='right-sidebar'><p>Popular: this, that, and the other thing that many read today.</p></div>",
    "aside": "<aside><p>Beside the point, but long enough to look like text, with commas.</p></aside>",
    "notice": "<div id='cookieNotice'><p>We use cookies, as all do. Click here, there, or anywhere to go on.</p></div>",
    "advert": "<div class='ad'>Buy now, pay later. The best of all offers, only today, only here.</div>",
    "form": "<form><label>Your name, please.</label><textarea>Type here, in full sentences.</textarea></form>",
    "script": "<script>var t = '</p><p>Not text, never. Not at all.';</script><style>p { margin: 0 }</style>",
    "comments": "<section class='comments'><p>I read this, all of it, and I disagree. Strongly, in fact.</p></section>",
    "comment article": "<article class='comment'><p>Well said, all in all. I agree, with no doubt.</p></article>",
    "markup": "<!-- a comment, with text. --><?php echo 1; ?><noscript>Switch it on, please.</noscript>",
    "hidden": "<div style='display: none'><p>Hidden words, for machines only. Many of them.</p></div>",
    "roles": "<div role='navigation'>Go here, go there.</div><div role='complementary'>More, and more. Still more.</div>",
}


@pytest.mark.parametrize("where", ["article", "main", "div class='entry-content'", "div itemprop=articleBody"])
@pytest.mark.parametrize("name", AROUND)
def test_what_is_beside_a_marked_article_is_left_out(name, where):
    inner = "" if name == "unclosed menu" else AROUND[name]
    page = f"<!DOCTYPE html><html><head><title>T</title></head><body>{AROUND[name]}<{where}>{ARTICLE}</{where.split()[0]}>{inner}</body></html>"
    if name == "unclosed menu" and "div" in where:
        return
    assert h.main_text(page) == WANTED


@pytest.mark.parametrize("name", sorted(set(AROUND) - {"unclosed menu", "comment article"}))
def test_paths_choose_where_nothing_is_marked(name):
    text = "<h2>A heading</h2>" + "".join(f"<p>Paragraph {i}, which goes on for a while, as paragraphs do. It ends here.</p>" for i in range(6)) + "<p>Short.</p>"
    page = f"<body>{AROUND[name]}<div><a href=1>Home</a> <a href=2>News</a></div><div class=x1>{text}</div><div>Imprint <a href=3>Contact</a></div>{AROUND[name]}</body>"
    got = h.main_text(page).split("\n")
    assert got[0] == "A heading" and got[-1] == "Short." and len(got) == 8


def test_names_of_frames():
    text = "".join(f"<p>Paragraph {i}, which goes on for a while, as paragraphs do. It ends here.</p>" for i in range(3))
    for frame in ("<div class='page has-sidebar no-comments'>", "<div id='sidebar-left-layout'>", "<body class='search-page'><div>"):
        assert len(h.main_text(f"{frame}<nav>Menu, and more.</nav><div>{text}</div></div>").split("\n")) == 3


def test_defects():
    assert h.main_text("<article><p>One<p>Two<b>bold</b> &am") == "One\nTwobold &am"
    assert h.main_text("<body><article><h1>T</h1><p><b>Never closed.<br><p>Next &lt;tag&gt; &#233;&#x20AC;.</article><footer>F, g. H") == "T\nNever closed.\nNext <tag> é€."
    assert h.main_text("<table><tr><td>a, b.<td>c<tr><td>d</table>") == "a, b.\nc\nd"
    assert h.main_text("<article><p>a < b, and so on.</p><p cla") == "a < b, and so on."
    assert h.main_text("<article><p>One, two.</p><!-- never closed <p>x") == "One, two."
    assert h.main_text("plain words, no tags. At all") == "plain words, no tags. At all"
    assert h.main_text("<form id=page><div class=content-wrap><main><p>Wrapped, whole.</p></main></div></form>") == "Wrapped, whole."
    for empty in (None, "", "<!--", "</p>", "<script>x", "<nav>only a menu</nav>", "<article></article>"):
        assert h.main_text(empty) == ""


def plain(html):
    """The article of a page of the test tables, by patterns alone."""
    from html import unescape

    body = re.search("<article>(.*?)(</article>|$)", html, re.DOTALL)[1]
    blocks = re.split("</?(?:p|h1)>", body)
    return "\n".join(filter(None, (" ".join(unescape(re.sub("<[^<>]*>", " ", b)).split()) for b in blocks)))


def test_all_pages_against_patterns(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r for r in h.extract(pages).collect()}
    rows = pages.collect()
    assert len(got) == len(rows)
    for r in rows:
        assert got[r.page_id].text == plain(r.html) and got[r.page_id].url == r.url
        assert got[r.page_id].n_chars == len(got[r.page_id].text)


def test_rows(spark):
    long_page = "<article>" + "<p>Some words, again.</p>" * 60_000 + "</article>"
    deep = "<div>" * 5000 + "<p>Deep, down.</p>"
    rows = [(1, "u", long_page, "x"), (None, None, None, "x"), (2, "u", "", "x"), (3, None, deep, "x"), (3, None, deep, "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = h.extract(pages)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted((r.page_id or 0, r.url or "", r.n_chars) for r in got.collect()) == [(0, "", 0), (1, "u", 60_000 * 19 - 1), (2, "u", 0), (3, "", 11), (3, "", 11)]
    assert h.extract(pages.limit(0)).collect() == []
