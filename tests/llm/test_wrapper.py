import random
import re
import time
from collections import Counter
from html import unescape

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from stratafold.llm import wrapper

SF = "/root/testdata/sf0.001"


def test_tree_matching_is_the_textbook_one():
    """Against the plain recursion without shortcuts."""

    def plain(a, b):
        if isinstance(a, str) or isinstance(b, str):
            return int(isinstance(a, str) and isinstance(b, str))
        if a.tag != b.tag:
            return 0
        x, y = ([c for c in n.children if (c.strip() if isinstance(c, str) else c.tag not in wrapper._RAW)] for n in (a, b))
        m = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i, p in enumerate(x):
            for j, q in enumerate(y):
                m[i + 1][j + 1] = max(m[i][j + 1], m[i + 1][j], m[i][j] + plain(p, q))
        return 1 + m[-1][-1]

    pages = ["<div><p>a<p>b<ul><li>x</ul></div>", "<div><p>a</p><ul><li>x<li>y</ul><p>c</p></div>", "<div><h1>t</h1><p><b>q</b>r</div>", "<p>z", "<div><ul><li>1<ul><li>2</ul></ul><p>k</div>"]
    r = random.Random(4)

    def made(depth):
        tags = r.choices(["div", "b", "section", "i"], k=r.randrange(4)) if depth else []
        return "".join(f"<{t}>{made(depth - 1)}{r.choice(['', 'x'])}</{t}>" for t in tags)

    pages += [made(4) for _ in range(30)]
    trees = [wrapper.parse(p) for p in pages]
    for a in trees:
        for b in trees:
            got = wrapper.match(a, b)
            nodes, texts = wrapper.align(a, b, {})
            assert got == plain(a, b) == len(nodes) + len(texts)
            assert all(p.tag == q.tag for p, q in nodes)


def test_made_up_pages():
    page = (
        "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a='</p>';</script></head><body><header><h1>Site</h1></header>"
        "<nav><ul><li><a href=/x>Home</a></ul></nav><div class='cookie-notice'>We use</div><div id=sidebar>Side</div>"
        "<article><h1>Head &amp; line</h1><p>One\n  two<br>three <b>bold</b>.<div class=\"ad\">Buy</div><p>Fo&#117;r &lt;tag&gt; &euro;<ul><li>a<li>b</ul>"
        "<form><input value=q>Mail</form><aside>More</aside><section class=comments><p>Reader</section></article><footer>Foot</footer><!-- c --></body></html>"
    )
    got = "\n\n".join(wrapper.extract_blocks(wrapper.parse(page)))
    assert got == "Head & line\n\nOne two three bold.\n\nFour <tag> €\n\na\n\nb"
    # the same without a marked article
    plain = page.replace("article", "div")
    assert "\n\n".join(wrapper.extract_blocks(wrapper.parse(plain))) == got


def test_constants_need_support_and_copies_vote_once():
    page = lambda i: f"<div><p>Powered by X</p><p>Story {i} goes on</p></div>"
    texts, n = wrapper.extract_group([page(i) for i in range(20)])
    assert n == 1 and texts[3] == "Story 3 goes on"
    texts, n = wrapper.extract_group([page(1)] * 20)
    assert n == 0 and texts[0] == "Powered by X\n\nStory 1 goes on"
    texts, n = wrapper.extract_group([page(i) for i in range(3)])
    assert n == 0 and texts[0].startswith("Powered")


def test_deep_and_long_pages_among_others():
    pages = [f"<div>{'<p>x<ul><li>y</ul>' * 700}<p>s{i}</div>" + "<b>z</b>" * (i * 300) for i in range(9)] + ["<div>" * 5000 + "deep"]
    texts, _ = wrapper.extract_group(pages)
    assert texts[-1] == "deep"


ODD = [None, "", "<", "a < b > c", "<p", "<!-- open", "<script>x", "plain &nbsp; text &amp;amp;", "<b><i></b></i>x", "</p></div>y", "<article>" * 2000 + "deep", "<p>" * 20_000 + "z", "<td>1<td>2", "x" * 2_000_000]


def test_whole_table(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    odd = spark.createDataFrame([(10_000 + i, None if i % 2 else f"http://h{i % 3}/", t) for i, t in enumerate(ODD)] * 2, "page_id long, url string, html string")
    rows = pages.unionByName(odd)
    got = wrapper.main_text(rows.withColumn("text", rows.url)).collect()
    assert len(got) == rows.count()
    by = {r.page_id: r for r in got}
    for r in pages.collect():
        article = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        parts = [" ".join(unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", article.replace("<br>", " "))]
        assert by[r.page_id].text == "\n\n".join(x for x in parts if x)
        assert by[r.page_id].n_chars == len(by[r.page_id].text)
    want = ["", "", "<", "a < b > c", "<p", "", "", "plain text &amp;", "x", "y", "deep", "z"]
    assert [by[10_000 + i].text for i in range(len(want))] == want
    assert by[10_013].n_chars == 2_000_000


def test_large_host_is_split(spark):
    rows = [(i, "https://User@Big.example/x", f"<article><p>Common line</p><p>page {i}</p></article>") for i in range(300)]
    got = wrapper.main_text(spark.createDataFrame(rows, "page_id long, url string, html string"), group=40).collect()
    assert {r.text for r in got} == {f"page {i}" for i in range(300)}


def test_empty(spark):
    assert wrapper.main_text(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_articles_win_over_class_words():
    text = lambda page: "\n\n".join(wrapper.extract_blocks(wrapper.parse(page)))
    article = "<article><div class='entry-header'><h1>Title</h1></div><p class='search-results'>Found</p><div class='notice'>Note</div><div class='ad'>Buy</div></article>"
    want = "Title\n\nFound\n\nNote"
    assert text(f"<div class='layout has-sidebar'>{article}<div class=sidebar>Side</div></div>") == want
    assert text(f"<div class='page-widget'>{article}</div>") == want
    assert text(f"<div id=header><main>{article}</main></div><p>Else") == want
    assert text(f"<p>Before</p><div class=widget>{article}</div><p>After") == f"Before\n\n{want}\n\nAfter"
    assert text(f"{article}<div class=comments><article>Reader</article></div>") == want
    assert text(f"<aside>{article}</aside><p>Rest") == "Rest"


def test_long_lists_are_traced_back_by_halves(monkeypatch):
    r = np.random.default_rng(1)
    w = r.integers(0, 4, (5, 6))
    cx, cy = r.integers(0, 5, 60), r.integers(0, 6, 75)
    whole = wrapper._largest(cx, cy, w)
    monkeypatch.setattr(wrapper, "TABLE_CELLS", 20)
    halves = wrapper._largest(cx, cy, w)
    weight = lambda pairs: sum(w[cx[i], cy[j]] for i, j in pairs)
    assert weight(whole) == weight(halves) == wrapper._last_row(cx, cy, w)[-1]
    for pairs in (whole, halves):
        ordered = sorted(pairs)
        assert all(a[0] < b[0] and a[1] < b[1] for a, b in zip(ordered, ordered[1:], strict=False))


@pytest.mark.parametrize("unit", ["<a ", "<div>", "<b></i>", "<b>", "<a \"", "<a '\">", "<i><div><b></i>", "<b><tr>", "<td><li>", "<!--", "<![CDATA[", "<x y='", "</p>"])
def test_broken_markup_is_parsed_in_linear_time(unit):
    page = unit * (1_000_000 // len(unit))
    began = time.process_time()
    tree = wrapper.parse(page)
    assert time.process_time() - began < 8  # a second or two on an idle machine; quadratic time is minutes
    wrapper.extract_blocks(tree)


def test_deep_and_long_pages_are_aligned():
    deep = lambda i: "<div>" * 3000 + f"<p>Powered by us</p><p>Story {i} goes on</p>"
    texts, n = wrapper.extract_group([deep(i) for i in range(12)])
    assert n == 1 and texts == [f"Story {i} goes on" for i in range(12)]
    r = random.Random(2)
    row = lambda: "".join(r.choice(["<p>x y</p>", "<h3>k</h3>", "<p>a<b>c</b></p>", "<h2>q<i>z</i></h2>"]) for _ in range(700))
    texts, n = wrapper.extract_group([f"<div>{row()}<section>{'<h5>Same line</h5>' * 30}</section>{row()}</div>" for i in range(9)])
    assert not any("Same line" in t for t in texts)


def _plain_pages(n):
    """Pages whose parts no tag, role or class tells from each other, and their main texts."""
    r = random.Random(7)
    words = lambda k: " ".join(r.choice(["lorem", "ipsum", "dolor", "sit", "amet", "elit", "sed", "magna"]) + str(r.randrange(99)) for _ in range(k))
    pages, want = [], []
    for _ in range(n):
        title, paras = words(5), [words(r.randrange(20, 60)) for _ in range(r.randrange(2, 7))]
        links = "".join(f"<li><a href=/{words(1)}>{words(2)}</a></li>" for _ in range(r.randrange(4, 8)))
        pages.append(
            f"<html><body><div><ul>{links}</ul></div><div>{words(6)}</div><div><h1>{title}</h1>" + "".join(f"<p>{p}</p>" for p in paras)
            + f"<p><a href=/x>{paras[0]}</a></p></div><div>&copy; example {words(4)}</div></body></html>"
        )
        want.append("\n\n".join([title, *paras, paras[0]]))
    return pages, want


def test_induction_finds_the_content_without_marks():
    pages, want = _plain_pages(20)
    on, parts = wrapper.extract_group(pages)
    off, none = wrapper.extract_group(pages, induction=False)
    assert on == want and parts == 3
    assert none == 0 and all(a != b for a, b in zip(on, off, strict=True))
    assert all(w in o for w, o in zip(want, off, strict=True))


def test_induction_equals_the_marks_on_the_table():
    """With the marks of article, menu, advert and footer taken away the alignment tells the same."""
    pages = [r for r in pq.read_table("/root/testdata/sf0.01/pages.parquet").to_pylist()]
    hosts = Counter(r["url"].split("/")[2] for r in pages)
    checked = 0
    for host in (h for h, n in hosts.items() if n >= 8):
        own = [r["html"] for r in pages if r["url"].split("/")[2] == host]
        marked, parts = wrapper.extract_group(own)
        assert parts == 3  # menu, advert and footer, whatever their marks
        bare = [re.sub(r"<(/?)(?:nav|article|footer)>", r"<\1div>", h).replace("<div class=\"ad\">", "<div>") for h in own]
        got = wrapper.extract_group(bare)[0]
        assert got == marked
        assert wrapper.extract_group(bare, induction=False)[0] != marked
        checked += len(own)
    assert checked >= 50


def test_inside_an_article_and_paragraphs_of_links():
    text = lambda page: "\n\n".join(wrapper.extract_blocks(wrapper.parse(page)))
    page = "<article><div class='article-header'><h1>Title</h1></div><section class='related-work'><p>Work</p></section><p>Body</p></article>"
    assert text(page) == "Title\n\nWork\n\nBody"
    assert text("<div><p><a href=x>A paragraph that is a link</a></p><p>Rest</p></div>") == "A paragraph that is a link\n\nRest"
    assert text("<p>Text of some length here</p><ul><li><a>a</a><li><a>b</a><li><a>c</a></ul>") == "Text of some length here"


def test_rows_of_one_id_and_url_are_spread(spark):
    same = [(1, "http://h/x", f"<p>Copy</p><p>{i % 3}</p>") for i in range(500)]
    others = [(i, "http://h/x", f"<article><p>page {i}</p></article>") for i in range(2, 30)]
    rows = spark.createDataFrame(same + others, "page_id long, url string, html string").withColumn("host", F.lit("x"))
    got = Counter((r.page_id, r.text) for r in wrapper.main_text(rows).collect())
    assert got == Counter([(1, f"Copy\n\n{i % 3}") for i in range(500)] + [(i, f"page {i}") for i in range(2, 30)])


def test_the_query(spark):
    got = {r.page_id: (r.url, r.text, r.n_chars) for r in wrapper.op1_wrapper_extract(spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        article = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        parts = [" ".join(unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", article.replace("<br>", " "))]
        text = "\n\n".join(x for x in parts if x)
        assert got[r.page_id] == (r.url, text, len(text))
