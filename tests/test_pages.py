"""HTML units as an expression against the standard library's parser, page by page."""

import random

import pytest
from pyspark.sql import functions as F

from provena.sources.pages import heading_units, visible
from provena.sources.records import html_units

PAGES = [
    "", "plain", "<h1>A</h1><p>x <b>y</b></p><script>no()</script><h2>B</h2>z<h2>B</h2>w", "before<h3>C</h3>c<h1>A</h1>a<h2 class='x>y'>B</h2>b<h4>D</h4>d",
    "<style>p{}</style ><!-- <h1>no</h1> --><H1 id=1>Up <i>per</i></H1 >t<SCRIPT>'</h1>'</SCRIPT>u", "<h1>open<h2>B</h2>t", "<h2>a</h1>b</h2>c", "<h1></h1>t<h2> </h2>u",
    "a&nbsp;b &copy; &middot; &amp;copy; &#65;&#x42; &eacute;&Eacute &bogus; &amp;lt;i&amp;gt; R&D &", "1 < 2 and 3 > 2 <b>x</b>", '<a href="x>y" title=\'<h1>\'>link</a>t<br/>u', "<a title=it's>x</a>y",
    "<header>h</header><hr>r<h10>n</h10>", "<!DOCTYPE html><?php x ?>t", "<h1>\n  A B　C </h1>\n d\n e", "<h1>가 나</h1>다<h6>라</h6>마",
]


def units(spark, pages):
    df = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "i int, h string").select("i", visible(F.col("h")).alias("h"))
    got = {r.i: [(u.path, u.text) for u in r.u] for r in df.select("i", heading_units(F.col("h")).alias("u")).collect()}
    return [got[i] for i in range(len(pages))]


def test_units_by_parser(spark):
    got = units(spark, PAGES)
    for page, u in zip(PAGES, got):
        assert u == [(x["path"], x["text"]) for x in html_units(page)], page


def test_a_sign_that_opens_no_tag_stays_in_its_word(spark):
    assert units(spark, ["a <3 b"]) == [[("", "a <3 b")]]  # the parser hands it over in two pieces


def test_units_of_drawn_pages(spark):
    r = random.Random(7)
    parts = ["<h1>", "</h1>", "<h2 a='b'>", "</h2>", "<h3>", "</h3>", "<p>", "</p>", "<br>", "word", " ", "&amp;", "&copy;", "&#8212;", "<!-- c -->", "<script>x<y</script>", "<style>h1{}</style>", "\n", "<b>bold</b>", "텍스트"]
    pages = ["".join(r.choice(parts) for _ in range(r.randint(1, 25))) for _ in range(400)]
    assert units(spark, pages) == [[(x["path"], x["text"]) for x in html_units(p)] for p in pages]


def test_long_pages(spark):
    many = "".join(f"<h2>t{i}</h2><p a='{i}'>text {i}" for i in range(3000))
    wide = "<p " + " ".join(f"a{i}='{i}'" for i in range(500)) + ">" + "x " * 1_000_000 + "<!--" + "c" * 1_000_000 + "--><h1>" + "y " * 200_000 + "</h1>z"
    a, b = units(spark, [many, wide])
    assert len(a) == 3000 and a[-1] == ("t0 > t2999", "text 2999")
    assert [len(t) for _, t in b] == [1_999_999, 1]


@pytest.mark.parametrize("page", [None])
def test_null_page(spark, page):
    df = spark.createDataFrame([(page,)], "h string").select(visible(F.col("h")).alias("h"))
    assert df.select(heading_units(F.col("h")).alias("u")).first().u in (None, [])
