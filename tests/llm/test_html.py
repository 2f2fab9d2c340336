import re
from html import unescape

import pytest
from watchlake.llm.html import Page, extract, main_text

LONG = "This paragraph has quite a few words, so that it looks like what people write."


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (None, ""), ("", ""), ("just words", "just words"), ("<p>a<p>b", "a\nb"), ("<!-- <p>no</p>", ""),
        ("<article><p>x &amp; y&nbsp;&eacute; &#65;&#x42;<br>\n  z</p></article>", "x & y é AB z"),
        ("<nav><a href=x>Menu</a></nav><main><h1>T</h1><p>Body</p></main><footer>F</footer>", "T\nBody"),
        (f"<div class='sidebar'>{LONG}</div><div id=post><p>{LONG}</p><p>{LONG}</p></div><div class=comments><p>{LONG * 9}</p></div>", f"{LONG}\n{LONG}"),
        ("<article><p>a</p><aside>b</aside><form>c</form><script>d<p></script><p>e</p><div class='share'>f</div></article>", "a\ne"),
        ("<article><h1>t</h1><section><p>one</p></section><section><p>two</p><p>three</p></section></article>", "t\none\ntwo\nthree"),
        ("<article><ul><li>a<li>b</ul><table><tr><td>c<td>d<tr><td>e</table></article>", "a\nb\nc d\ne"),
        ("<article><p title='a>b'>c</p></article><div class='cookie-notice'>d</div>", "c"),
        ("<article><p>a <b>b<p>c</article>", "a b\nc"), ("<p>a &lt;script&gt; b</p>", "a <script> b"),
    ],
)
def test_pages(html, text):
    assert main_text(html) == text


@pytest.mark.parametrize(
    "attributes",
    ["class='content has-sidebar'", "class='overflow-hidden prose'", "class='post no-comments'", "class='page-with-sidebar'", "class='entry-social-wrap'",
     "title='a hidden gem'", "data-hidden=false", "data-id='nav'", "data-x=' class=ad '", "lang=en data-role=menu"],
)
def test_marks_of_other_things_cut_nothing(attributes):
    assert main_text(f"<div {attributes}><p>{LONG}</p><p>{LONG}</p></div>") == f"{LONG}\n{LONG}"


@pytest.mark.parametrize("attributes", ["class='x ad'", "id=nav", "hidden", "class=y hidden=''", "HIDDEN", "class='site-footer'", "class='relatedPosts'", "style='display: none'"])
def test_marks_cut(attributes):
    assert main_text(f"<article><p>{LONG}</p><p>{LONG}</p><div {attributes}><p>{LONG}</p></div></article>") == f"{LONG}\n{LONG}"


def test_addresses_are_no_marks():
    page = "<article><p>see <a href='/the-hidden-lake'>the lake</a> and <a href='/x?id=comments&class=ad'>x</a> <a href=/role=nav>y</a></p></article>"
    assert main_text(page) == "see the lake and x y"


def test_densities_follow_their_definition():
    page = Page(f"<body><div id=x><p>{LONG}</p><p>{LONG}</p></div><div><a href=1>link</a><a href=2>other</a></div></body>")
    dense, sums, body = page.densities()
    at = {t: [i for i, x in enumerate(page.tag) if x == t] for t in ("p", "div")}
    assert min(dense[at["p"][0]], dense[at["div"][0]]) > 5 * dense[at["div"][1]]
    assert sums[at["div"][0]] == pytest.approx(sum(dense[i] for i in at["p"]))
    nodes, dropped = page.content()
    assert page.text() == f"{LONG}\n{LONG}" and at["div"][1] not in nodes and (nodes == [at["div"][0]] or dropped == {at["div"][1]})


LINKS = "<div class='x7'>" + "".join(f"<a href='/{k}'>one link</a> " for k in range(12)) + "</div>"
PARAGRAPHS = "".join(f"<p>{k} {LONG}</p>" for k in range(6))
WANT = "\n".join(f"{k} {LONG}" for k in range(6))


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<body>{LINKS}<div class='q3'><h1>Title</h1>{PARAGRAPHS}</div>{LINKS}</body>", f"Title\n{WANT}"),  # no article, names that say nothing
        (f"<body><div><div>{LINKS}</div><div><h2>Title</h2><div>{PARAGRAPHS}</div><p>End.</p></div></div></body>", f"Title\n{WANT}\nEnd."),
        (f"<body><article><p>Teaser.</p></article><div id=z>{PARAGRAPHS}</div></body>", f"Teaser.\n{WANT}"),  # an article that holds less than the content
        (f"<body><article><h3><a href=1>other page</a></h3></article><div id=z>{PARAGRAPHS}</div>{LINKS}</body>", WANT),  # a teaser that is a link
        (f"<body><h1>Title</h1><section>{PARAGRAPHS}</section><section><p>short</p><p>{LONG}</p></section>{LINKS}</body>", f"Title\n{WANT}\nshort\n{LONG}"),
        (f"<body><article><section>{PARAGRAPHS}</section><section><h2>More</h2><p>Last words.</p></section></article></body>", f"{WANT}\nMore\nLast words."),
        (f"<body><span><b>{PARAGRAPHS}</b></span></body>", WANT),
        (f"<body>{LONG}<br><br>{LONG}<p>short</p>{LINKS}</body>", f"{LONG} {LONG}\nshort"),
        (f"<body><p><b>{LONG}<br><p>{LONG}</p></body>", f"{LONG}\n{LONG}"),
        (f"<table><tr><td>{LINKS}<td>{PARAGRAPHS}</table>", WANT),
    ],
)
def test_density_decides_where_names_say_nothing(page, text):
    assert main_text(page) == text


@pytest.mark.parametrize(
    "piece",
    ["<a ", "<p a='", "<p a='>", "<p a=\"'>", "<b>", "</i>", "<div>", "<!--", "<!", "<?", "&", "<li>", "<p><a href='x'>", "<", "</script ", "<script>", "<table><tr><td>", "<b><div><i></b>", "a='b\" "],
)
def test_time_grows_with_the_page(piece):
    """Hostile pages: eight times the page takes no more than a few times eight times as long."""
    import time

    took = []
    for n in (20_000, 160_000):
        body, began = piece * (n // len(piece)), time.process_time()
        for page in (body, "<p a='" + body, body + "</i>" * (n // 8), "<b>" * (n // 8) + body + "</u>" * (n // 8)):
            main_text(page)
        took.append(max(time.process_time() - began, 0.02))
    assert took[1] < 24 * took[0]


def test_deep_and_broken_pages_end():
    assert main_text("<div>" * 5000 + "x").strip() == "x"
    assert main_text("<p " + "a='b" * 5000 + "<p>x") is not None
    assert main_text("<" * 10000) == "<" * 10000


def test_columns(spark):
    df = spark.createDataFrame([(1, None, "u"), (1, None, "u"), (2, "<p>a</p>", None)], "page_id long, html string, text string")
    assert sorted((r["page_id"], r["text"]) for r in extract(df, ["page_id"]).collect()) == [(1, ""), (1, ""), (2, "a")]
    assert extract(df.limit(0), ["page_id"]).count() == 0


def test_query_finds_the_articles(spark, sf_dir):
    from watchlake.llm import entry

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    for r in entry.QUERIES["op2_html"](spark, sf_dir).collect():
        article = re.search(r"<article>(.*?)</article>", pages[r["page_id"]], re.S)[1]
        blocks = [re.sub(r"\s+", " ", unescape(re.sub(r"<[^>]*>", "", x))).strip() for x in re.split(r"</?(?:p|h1)>", article.replace("<br>", " "))]
        assert r["text"] == "\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])
