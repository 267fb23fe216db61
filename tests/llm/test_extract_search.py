import math

import numpy as np
import pytest
from .conftest import SF

from panelcast.llm import ann, html_text, url_filter

LONG = "The keeper of the house said that the boats and the men were in the bay, and it was not for him to say who had the rope."
PAGE = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a="</p><p>{LONG}</p>";</script></head>
<body class="with-sidebar"><header><div>{LONG}</div></header><nav><ul><li><a href="/a">Home</a><li><a href="/b">News</a></ul></nav>
<div class="cookie-notice"><p>{LONG}</p></div><div class="ad">{LONG}</div><!-- <p>{LONG}</p> -->
<article><header><h1>A title &amp; more</h1></header><p><b>{LONG}<br>Short  line.
<p>{LONG} &eacute;&#233;&nbsp;x <img alt="a > b" src=x><a href="/c">link</a> end</p><form><p>{LONG}</p></form>
<blockquote>Quoted.</blockquote><aside><p>{LONG}</p></aside><section class="comments"><p>{LONG}</p></section></article>
<div id="sidebar"><p>{LONG}</p></div><footer>&copy; {LONG}</footer></body></html>"""


def test_page_parts():
    assert html_text.main_text(PAGE) == "\n".join(
        ["A title & more", LONG, "Short line.", f"{LONG} éé x link end", "Quoted."])


def test_plain_pages_by_block_statistics():
    page = (f"<div><a href=x>one</a> <a href=y>two</a> <a href=z>three</a></div><h2>Head</h2><p>{LONG}</p><p>Yes.</p><p>{LONG}</p>"
            f"<div>{'lorem ipsum dolor sit amet consectetur ' * 8}</div>")
    got = html_text.main_text(page).split("\n")
    assert "one two three" not in got and "Yes." in got and got.count(LONG) == 2 and "Head" in got
    assert not any("lorem" in x for x in got)


@pytest.mark.parametrize("page,text", [
    (None, ""), ("", ""), ("<p></p>", ""), (LONG, LONG), (f"<p>{LONG}", LONG), (f"<article>{LONG}<script>x", LONG),
    (f"</div></p><p>{LONG}<!-- open", LONG), ("<nav>only a menu</nav>", ""), (f"<article><p>{LONG} <b", LONG),
])
def test_broken_pages(page, text):
    assert html_text.main_text(page) == text


def test_extract_frame(spark):
    rows = [(1, "u", PAGE, 1, "x"), (2, None, None, 1, "x"), (1, "u", PAGE, 1, "x"), (None, "v", f"<p>{LONG * 3000}</p>", 2, "y")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, _id int, text string")
    got = html_text.extract(pages).collect()
    assert len(got) == 4 and [c for c in got[0].asDict()] == ["page_id", "url", "text", "n_chars"]
    assert all(r.n_chars == len(r.text) for r in got)
    assert {r.page_id: r.n_chars for r in got}[None] == len(LONG) * 3000
    assert html_text.extract(pages.limit(0)).collect() == []


def test_given_pages_give_their_articles(con):
    import html
    import re
    for (page,) in con.execute("SELECT html FROM pages").fetchall():
        article = re.search(r"<article>(.*?)(</article>|\Z)", page, re.S)[1]
        parts = re.split(r"</?(?:p|h1|br)[^>]*>", article)
        want = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in parts]
        assert html_text.main_text(page) == "\n".join(x for x in want if x)


def brute(vectors, every, k):
    out = {}
    for q, x in vectors.items():
        if q % every == 0:
            near = sorted((math.sqrt(sum((a - b) ** 2 for a, b in zip(x, y, strict=True))), i) for i, y in vectors.items() if i != q)
            out[q] = near[:k]
    return out


def test_recall_and_scores_on_given_vectors(spark, con):
    vectors = {i: [float(x) for x in v] for i, v in con.execute("SELECT vec_id, embedding FROM embeddings").fetchall()}
    got = {}
    for r in ann.nearest(spark.read.parquet(f"{SF}/embeddings.parquet"), every=10).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    want = brute(vectors, 10, 10)
    assert got.keys() == want.keys()
    hits = 0
    for q, found in got.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, 11))
        assert [f[2] for f in found] == sorted(f[2] for f in found)
        for _, i, s in found:
            assert s == pytest.approx(math.dist(vectors[q], vectors[i]), abs=1e-12)
        hits += len({f[1] for f in found} & {i for _, i in want[q]})
    assert hits / (10 * len(want)) >= 0.9


def test_vectors_that_take_no_part_and_hot_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 7), (100, [0.0, 1.0], 7), (1, [1.0, 1.0], 7), (2, None, 7), (3, [0.0, 0.0], 7), (4, [nan, 1.0], 7),
            (5, [inf, 1.0], 7), (6, [None, 1.0], 7), (None, [1.0, 0.5], 7), (7, [1.0, 2.0, 3.0], 7), (200, [0.0, 0.0], 7), (1, [1.0, 1.0], 7)]
    rows += [(1000 + k, [2.0, 2.0], 7) for k in range(60)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, _id int")
    got = {}
    for r in ann.nearest(frame).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    vectors = {0: [1.0, 0.0], 100: [0.0, 1.0], 1: [1.0, 1.0]} | {1000 + k: [2.0, 2.0] for k in range(60)}
    want = brute(vectors, 100, 10)
    assert got.keys() == want.keys() == {0, 100, 1000}
    for q, found in got.items():
        assert [(i, s) for _, i, s in sorted(found)] == [(i, s) for s, i in want[q]]
    assert ann.nearest(frame.limit(0)).collect() == []
    assert ann.nearest(frame.filter("vec_id = 3")).collect() == []
    assert ann.nearest(frame.filter("vec_id = 0")).collect() == []


def test_chi_square_quantiles():
    rng = np.random.default_rng(0)
    x = (rng.standard_normal((200_000, 8)) ** 2).sum(1)
    assert np.mean(x <= ann.chi_square_quantile(0.9, 8)) == pytest.approx(0.9, abs=0.005)


URLS = [(1, "https://WWW.Site.ORG/x"), (2, "http://example.org/es/1"), (3, "http://a.example.org/en/12?x#y"), (4, "http://example.org/en/2"),
        (5, "http://com/fr/"), (6, "http://x.com/de/9"), (7, "http://notexample.org"), (8, None), (9, "no scheme"), (10, "a://b?c/://d"),
        (11, "http://net.com/en/1"), (12, "http://É.COM/fr/a"), (13, ""), (14, "x://"), (14, "x://")]


def test_hosts_paths_and_rules(spark):
    frame = spark.createDataFrame([(i, u, "h", "p", "r") for i, u in URLS], "page_id long, url string, _host string, path string, rule string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(frame).collect()}
    assert got[1] == ("www.site.org", "/x", "org/", "allow")
    assert got[2] == ("example.org", "/es/1", "example.org/es/", "block")
    assert got[3] == ("a.example.org", "/en/12", "example.org/en/1", "block")
    assert got[4] == ("example.org", "/en/2", "org/", "allow")
    assert got[5] == ("com", "/fr/", "com/fr/", "allow")
    assert got[6] == ("x.com", "/de/9", "com/de/", "block")
    assert got[7][:3] == ("notexample.org", "", None)
    assert got[8][:3] == got[9][:3] == got[13][:3] == got[14][:3] == ("", "", None)
    assert got[10][:3] == ("b", "", None)
    assert got[12][0] == "É.com" and got[12][2] == "com/fr/"
    assert len(url_filter.judge_urls(frame).collect()) == len(URLS)
    assert url_filter.judge_urls(frame.limit(0)).collect() == []


def test_pure_branches_are_kept_apart_and_rejected(spark):
    rules = (("block", "h.com", "/bad/"), ("allow", "h.com", "/good/"))
    urls = [f"http://h.com/bad/{k}" for k in range(40)] + [f"http://h.com/good/{k}" for k in range(40)]
    urls += [f"http://all.h.com/bad/x{k}" for k in range(40)] + ["http://all.h.com/other/1"]
    frame = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: r for r in url_filter.judge_urls(frame, rules=rules).collect()}
    assert got[0].template == "/bad/*" and got[50].template == "/good/*"
    # every labelled page of this host is blocked: its unlabelled branch follows
    assert got[len(urls) - 1].rule is None and got[len(urls) - 1].verdict == "block"


def test_url_plan_has_no_python(spark):
    frame = spark.createDataFrame(URLS, "page_id long, url string")
    plan = url_filter.judge_urls(frame)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("page", [
    f"<html><head><title>x</title><body><article><p>{LONG}</article>",
    f"<html><head><title>x</title><article><p>{LONG}</article>",
    f"<article><svg class=i /><p>{LONG}</p></article>",
    f"<article><iframe src='x'/><p>{LONG}</p></article>",
    f"<div><button>Go</div><article><p>{LONG}</p></article><button>x</button>",
    f"<article><object data=x><p>{LONG}</p></article>",
])
def test_silent_elements_without_an_end_tag(page):
    assert html_text.main_text(page) == LONG


def test_bare_less_than_and_linked_paragraphs():
    plain = f"{LONG} x < 5 and so on"
    assert html_text.main_text(plain) == plain
    linked = f"<article><p>{LONG}</p><p>See <a href=x>the report of the keeper</a> too.</p><p>{LONG}</p></article>"
    assert html_text.main_text(linked) == f"{LONG}\nSee the report of the keeper too.\n{LONG}"


@pytest.mark.parametrize("page", [
    f"<div class='content sidebar-right'><article><p>{LONG}</p></article></div>",
    f"<div class='content sidebar-right'><p>{LONG}</p></div>",
    f"<div class='side-by-side'><p>{LONG}</p></div>",
    f"<div id=share-container><p>{LONG}</p></div>",
    f"<div class=social><main><p>{LONG}</p></main></div>",
    f"<article><header class='entry-header'>{LONG}</header></article>",
])
def test_marked_wrappers_around_the_article(page):
    assert html_text.main_text(page) == LONG


@pytest.mark.parametrize("page", [
    f"<div id=comments><article class='comment-body'><p>{LONG}</p></article></div>",
    f"<article><section class=comments><article><p>{LONG}</p></article></section></article>",
    f"<aside><article><p>{LONG}</p></article></aside>", f"<div hidden><article><p>{LONG}</p></article></div>",
])
def test_marks_that_hold(page):
    assert html_text.main_text(page) == ""


RUSSIAN = "Смотритель дома сказал, что лодки и люди остались в заливе и что не ему решать, у кого теперь верёвка от старого причала."
CHINESE = "屋子的看守人说船和人都还在海湾里，绳子在谁手上不是他能决定的事情，他只知道昨天夜里风很大。" * 2


@pytest.mark.parametrize("page,text", [
    (f"<nav><a href=/>Дом</a></nav><h1>Заголовок</h1><p>{RUSSIAN}</p><p>Да.</p><p>{RUSSIAN}</p>", f"Заголовок\n{RUSSIAN}\nДа.\n{RUSSIAN}"),
    (f"<div class=menu>首页</div><div><p>{CHINESE}</p><p>{CHINESE}</p></div><footer>版权</footer>", f"{CHINESE}\n{CHINESE}"),
    (f"<form action=/p><div><article><p>{LONG}</p></article></div><input type=hidden></form>", LONG),
    (f"<body><form id=f><p>{LONG} {LONG}</p><h2>More</h2><p>{LONG}</p><label>Mail</label><button>Send</button></form></body>",
     f"{LONG} {LONG}\nMore\n{LONG}"),
    (f"<article><p>{LONG}</p></article><form><p>Write to us, we shall answer.</p><label>Name <input></label></form>", LONG),
    (f"<article><p data-x=it's>{LONG}</p><p>{LONG}</p><p id='z'>{LONG}</p></article>", f"{LONG}\n{LONG}\n{LONG}"),
    (f"<article><p title=\"open>{LONG}</p><p class=\"b\">{LONG}</p></article>", f"{LONG}\n{LONG}"),
    (f"<article><p title=\"open>{LONG}</p></article>", LONG),
    (f"<article><p>{LONG} a<b and c>d</p></article>", f"{LONG} a<b and c>d"),
    (f"<article><!--><p>{LONG}</p><!-- x --!><p>{LONG}</p><!-- y --></article>", f"{LONG}\n{LONG}"),
    (f"<div class='related-work'><p>{LONG}</p></div>", LONG),
    (f"<article><section id='share-prices'><p>{LONG}</p></section><p class='side'>{LONG}</p></article>", f"{LONG}\n{LONG}"),
    (f"<article><p>{LONG}</p><div class='related-posts'><p>{LONG}</p></div><div class='share'>Share it</div></article>", LONG),
    (f"<nav><a href=x>Home</a><article><p>{LONG}</p></article>", LONG),
    (f"<aside><p>Beside</p><article><p>{LONG}</p></article>", LONG),
    (f"<main><p>{LONG}</p><p <b>{LONG}</b></p></main>", f"{LONG}\n{LONG}"),
])
def test_faults_of_markup_and_other_languages(page, text):
    assert html_text.main_text(page) == text


@pytest.mark.parametrize("unit", ["<div>", "<p title=\"a' ", "<svg>", "<b ", "<!--", "<a href='", "<nav>", "<form>", "<article>", "</p>",
                                  "<title>", "<p class=\"x>", "< ", "<p x=\"a>b=\""])
def test_repeated_tags_take_linear_time(unit):
    import time
    t0 = time.process_time()
    html_text.main_text(unit * 8000)
    html_text.main_text(f"<article><p>{LONG}</p></article>" + unit * 8000 + "</svg></title>")
    assert time.process_time() - t0 < 2
