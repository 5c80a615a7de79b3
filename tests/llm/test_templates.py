"""Main text of pages: site templates, markup, broken tags."""

import html
import random
import re

import pytest

import __spark_entry__ as entry_points
from brightshelf.llm import templates
from brightshelf.llm.templates import main_text

SF = "/root/testdata/sf0.001"


def plain(page):
    return main_text(page, frozenset(), frozenset())[0]


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("", ""),
        ("no tags &amp; all", "no tags & all"),
        ("<p>a<p>b<b>c</b>d<br>e", "a bcd e"),
        ("<article><p><b>one<br><p>two</p></article><footer>f", "one two"),
        ("<article><h1> T\n\t&nbsp;x </h1><p>a&lt;b &eacute; &#8364;</p></article>", "T x a<b é €"),
        ("<nav>menu</nav><main><p>x</p><aside>side</aside><form>mail <input></form></main>", "x"),
        ("<div class='cookie-notice'>we use</div><p>text</p><div id=comments><article>me too</article></div>", "text"),
        ("<header><h1>Site</h1></header><article><header><h1>Title</h1></header><p>body</p></article>", "Title body"),
        ("<form action=x><article><p>whole page in a form</p></article></form>", "whole page in a form"),
        ("<script>var t='</p>';</script><style>p{}</style><p>x<!-- <p>gone</p> -->y</p>", "xy"),
        ("<p>x</p><script>never closed <p>z", "x"),
        ("<p>x</p><a href='/un", "x"),
        ("<p title='a > b'>x</p><p title=\"odd>y</p>", "x y"),
        ("1 < 2 <p>3 <4</p>", "1 < 2 3 <4"),
        ("<ul><li><a>a</a><li><a>b</a><li><a>c</a></ul><p>text here</p>", "text here"),
        ("<article><ul><li>a<li>b</ul></article>", "a b"),
        ("<table><tr><td>a<td>b<tr><td>c</table>", "a b c"),
        ("<div hidden>h</div><div role=banner>b</div><div class=adBox>ad</div><div class=shadow>kept</div>", "kept"),
        ("<title>t</title><body class='has-sidebar'><p>x", "x"),
        ("<p>a</b></i></div>b</p>", "ab"),
    ],
)
def test_markup(page, text):
    assert plain(page) == text


def page(k, body, notice="Our shop closes at noon on holidays", tag="div"):
    return f"<html><body><{tag} class='x7'>{notice}</{tag}><div class='k2'>{body}</div><div class='z9'><span>All about us {k % 2}</span></div></body></html>"


def sites():
    rng = random.Random(4)
    body = lambda: "".join(f"<p>{' '.join(str(rng.randrange(10**6)) for _ in range(9))}</p>" for _ in range(3))
    rows = []
    for k in range(60):
        rows.append((k, f"http://a.example/{k}", page(k, body() + "<p>Be.</p>" * (k < 8))))
    # Copies of one article on many addresses of the same host.
    copy = body()
    rows += [(100 + k, f"https://user@A.example:81/{k}", page(k, copy)) for k in range(30)]
    # Too few pages of this host, a page without a host, and empty pages.
    rows += [(200 + k, f"http://b.example/{k}", page(k, body())) for k in range(3)]
    rows += [(300, None, page(0, body())), (301, "nothing", page(0, body())), (302, "http://a.example/n", None), (303, "http://a.example/e", ""), (None, "http://a.example/1", page(1, copy))]
    return rows


def inner(text):
    return " ".join(html.unescape(re.sub("<[^>]*>", " ", text)).split())


@pytest.mark.parametrize("broadcast_rows", [None, 0])
def test_repeated_subtrees_go_and_copies_stay(spark, broadcast_rows):
    rows = sites()
    df = spark.createDataFrame([(*r, "t", 5) for r in rows], "page_id long, url string, html string, text string, host int")
    got = templates.extract_text(df, ["page_id", "url"], broadcast_rows=broadcast_rows).collect()
    assert len(got) == len(rows)
    by_key = {(r.page_id, r.url): r for r in got}
    for page_id, url, text in rows:
        r = by_key[page_id, url]
        want = inner(text or "")
        if url and "a.example" in url.lower() and text:
            want = want.removeprefix("Our shop closes at noon on holidays ").rsplit(" All about us", 1)[0]
            assert r.n_template == 2
        else:
            assert r.n_template == 0
        assert (r.text, r.n_chars) == (want, len(want)), page_id
    assert templates.extract_text(df.limit(0), ["page_id"]).count() == 0
    with pytest.raises(ValueError):
        templates.extract_text(df, ["text"])


def test_paragraphs_inside_articles_are_no_template(spark):
    rows = [(k, "http://c.example/", f"<nav>n</nav><article><p>Said in every article.</p><p>{k} {'w' * (30 + k)}</p><div>Read also our other pages</div></article>") for k in range(20)]
    got = templates.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string"), ["page_id"]).collect()
    assert {r.text for r in got} == {f"Said in every article. {k} {'w' * (30 + k)}".strip() for k in range(20)}


def test_deep_and_long_pages():
    deep = "<div>" * 50_000 + "x" + "</div>" * 50_000
    assert plain(deep) == "x"
    long = "<article>" + "<p>word &amp; word</p>" * 200_000
    assert plain(long) == "word & word " * 199_999 + "word & word"
    assert plain("<a '" * 20_000 + ">x") == "x"


def test_query_against_the_articles(spark):
    got = {r.page_id: r for r in entry_points.queries()["op11_html_extraction"](spark, SF).collect()}
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    assert len(got) == len(pages)
    for p in pages:
        article = re.search("<article>(.*?)</article>", p.html, re.S)[1]
        blocks = [html.unescape(b) for b in re.split("<[^>]*>", re.sub("</?b>", "", article))]
        want = " ".join(w for b in blocks for w in b.split())
        assert (got[p.page_id].text, got[p.page_id].n_chars, got[p.page_id].url) == (want, len(want), p.url)
