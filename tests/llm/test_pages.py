import re

import pytest

from strokewise.llm import pages


@pytest.fixture(scope="module")
def tree(spark):
    return pages.trained(spark)


def test_labelled_pages(tree):
    rows = pages.labelled_rows()
    right = sum(pages.kept(tree, r[:-1]) == bool(r[-1]) for r in rows)
    assert len(rows) > 5_000 and right > 0.995 * len(rows)  # some blocks without any frame look alike


def test_held_out_page(tree):
    page = """<!DOCTYPE html><html><head><title>no</title><script>var a = "</p><p>no";</script><style>p{}</style></head>
    <body class="page"><div class="top-bar"><span>no</span></div><nav>no <a href=x>no</a></nav><!-- <p>no</p> -->
    <div class="post"><h1>Yes &amp; title</h1><p>One<br>two &eacute;&#x21; <b>three</b>
    four<p>Five <a href="y">six</a><textarea>no</textarea></div><div id="comments"><p>no no no</p></div>
    <aside>no</aside><form><label>no</label><input value="no"></form><footer>&copy; no</footer></body></html>"""
    assert pages.main_text(tree, page) == "Yes & title\n\nOne two é! three four\n\nFive six"


@pytest.mark.parametrize("page", [None, "", "<", "<p", "<!--", "<p>&amp", "</p></div>" * 500, "<a " * 3_000, "<div>" * 3_000, "<script>", "<p title='x>y", "plain"])
def test_odd_pages(tree, page):
    assert isinstance(pages.main_text(tree, page), str)


KEPT = {
    "ends with the article": ("<body><article><h1>T</h1><p>First paragraph of it here.</p><p>Last paragraph of it here.</p></article></body>", "T\n\nFirst paragraph of it here.\n\nLast paragraph of it here."),
    "plain text": ("only some text\nin two lines", "only some text in two lines"),
    "no body tag": ("<html><head><title>t</title><meta charset=x><p>One block of text.</p><p>Another block of text.</p>", "One block of text.\n\nAnother block of text."),
    "unclosed button": ("<article><p>One block of text.</p><button>Press<p>Another block of text.</p></article>", None),
    "closed button": ("<article><p>One block of text.</p><button>Press</button><select><option>a<option>b</select><p>Another block of text.</p></article>", "One block of text.\n\nAnother block of text."),
    "math": ("<article><p>So <math><mi>x</mi><mo>=</mo><mn>1</mn></math> it is.</p></article>", "So x=1 it is."),
    "linked block": ("<article><p>One block of text.</p><a href=x><p>A linked block of text.</p></a><p>Another block of text.</p></article>", "One block of text.\n\nA linked block of text.\n\nAnother block of text."),
    "unclosed paragraphs and items": ("<main><p class=comment>no<p>One block of text.<ul><li class=ad>no<li>two words</ul></main>", "One block of text.\n\ntwo words"),
    "form around the page": ("<form><nav>no</nav><article><p>One block of text.</p></article><p>Your name, please</p></form>", "One block of text."),
    "layout names": ("<div class='page has-sidebar'><article><p>One block of text.</p></article><div class=sidebar><p>no no no</p></div></div>", "One block of text."),
    "quotes that never end": ("<article><p title=\"x>One block of text.</p><p>Another block's text.</p></article>", None),
    "nested comments of readers": ("<article><p>One block of text.</p><section class=comments><article class=comment><p>I think that it is so, too.</p></article></section></article>", "One block of text."),
}


@pytest.mark.parametrize("case", list(KEPT))
def test_layouts(tree, case):
    page, want = KEPT[case]
    got = pages.main_text(tree, page)
    if want is None:
        assert "One block of text." in got and "Another block" in got
    else:
        assert got == want


@pytest.mark.parametrize("page", ["<script " * 130_000, "<a '>" * 200_000, "<a \"'>" * 150_000, "<div>" * 100_000 + "</p>" * 100_000, "<" * 1_000_000, "<!--" * 250_000, "<ul><li>" * 100_000, "<button>x" * 100_000, "word " * 400_000])
def test_long_pages_in_little_time(tree, page):
    import time

    began = time.perf_counter()
    pages.main_text(tree, page)
    assert time.perf_counter() - began < 10


def test_repeated_rows_agree(spark):
    d = spark.createDataFrame([(1, "u", "<article><p>some words here</p></article>")] * 3 + [(2, None, None)], "page_id long, url string, html string")
    assert [tuple(r) for r in pages.digest(d).orderBy("page_id").collect()] == [(1, "u", "some words here", 15)] * 3 + [(2, None, "", 0)]


def test_test_pages(spark, sf_dir):
    """Exactly the blocks within the article element."""
    rows = pages.digest(spark.read.parquet(f"{sf_dir}/pages.parquet")).collect()
    sources = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    assert rows
    import html

    for r in rows:
        inner = re.search(r"<article>(.*)</article>", sources[r.page_id] or "", re.S)
        cut = re.split(r"</?(?:p|h1)>", inner[1]) if inner else []
        want = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", x)))).strip() for x in cut]
        assert r.text == "\n\n".join(x for x in want if x)
        assert r.n_chars == len(r.text)


def test_columns_and_empty(spark):
    d = spark.createDataFrame([(1, "u", "<article><p>hello</p></article>", "t")], "page_id long, url string, html string, text string")
    out, name = pages.extract(d)
    assert name == "text_" and out.columns == [*d.columns, name] and out.first()[name] == "hello"
    assert pages.digest(d.limit(0)).count() == 0
