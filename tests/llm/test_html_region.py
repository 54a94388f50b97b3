"""Main text: learned weights and the scan decide; names are no veto; odd tables."""

import random

import pytest

from millrace.llm import html_region

ARTICLE = "<h1>Head</h1><p>one two three four five six seven</p><ul><li>eight nine</li></ul><p>ten eleven twelve</p>"
TEXT = "Head one two three four five six seven eight nine ten eleven twelve"


def page(before, after, article=ARTICLE):
    return f"<html><body>{before}{article}{after}</body></html>"


@pytest.mark.parametrize(
    ("before", "after"),
    [
        ('<nav><a href="/">home</a></nav><article>', "</article><footer>us</footer>"),
        ('<nav><a href="/">home</a></nav><div class="zone">', "</div><footer>us</footer>"),
        ('<div class="product-comments-enabled post">', "</div><div class='comments'>nice page</div>"),
        ('<div class="menu">a b c</div><article class="tags-politics main">', "</article>"),
        ('<body class="single has-sidebar"><header>top</header><article>', "</article><aside>more</aside>"),
        ('<p title="5" tall"></p><article>', "</article>"),
    ],
)
def test_the_article_of_any_name(before, after):
    assert html_region.extract(page(before, after), {}) == TEXT


def pages(spark, rng, n=60):
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    text = lambda k: " ".join(word() for _ in range(k))
    rows, want = [], {}
    for i in range(n):
        marked = i % 3 > 0
        body, promo = [text(rng.randrange(10, 30)) for _ in range(3)], text(40)
        inner = "".join(f"<p>{x}</p>" for x in body)
        held = f"<article>{inner}</article>" if marked else f"<div>{inner}</div>"
        rows.append((i, f"https://e.org/{i}", f"<body><div class='xq9'>{promo}</div>{held}<div class='zz7'><p>{text(30)}</p></div></body>"))
        want[i] = " ".join(body)
    return spark.createDataFrame(rows, "page_id long, url string, html string"), want


def test_learned_names_decide_on_pages_without_marks(spark):
    frame, want = pages(spark, random.Random(8))
    got = {r.page_id: r.text for r in html_region.main_text(frame).collect()}
    assert got == want
    plain = {r.page_id: r.text for r in html_region.main_text(frame, weights={}).collect()}
    assert all(plain[i] == want[i] for i in want if i % 3) and all(plain[i] != want[i] for i in want if not i % 3)


def test_the_scan_finds_the_largest_sum():
    rng = random.Random(1)
    for _ in range(200):
        x = [rng.randrange(-5, 6) for _ in range(rng.randrange(9))]
        a, b = html_region.best_region(x)
        assert sum(x[a:b]) == max([0, *(sum(x[i:j]) for i in range(len(x)) for j in range(i + 1, len(x) + 1))])


def test_odd_rows(spark):
    long = "<article>" + "<p>word &amp; more</p>" * 50_000 + "</article>"
    rows = [(1, None, None, "x"), (None, "u", "", "y"), (2, "u", "<article>a</article>", None), (2, "u", "<article>a</article>", None), (3, "u", long, "z"), (4, "u", "no tags", "t"), (5, "u", "<p", "t"), (6, "u", "&bogus; &eacute;&#x41;", "t")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = [(r.page_id, r.text, r.n_chars) for r in html_region.main_text(frame).collect()]
    assert len(got) == len(rows) and got[0] == (1, "", 0) and got[1] == (None, "", 0) and got[2] == got[3] == (2, "a", 1)
    assert got[4][2] == len("word & more ") * 50_000 - 1 and got[5][1] == "no tags" and got[7][1] == "&bogus; éA"
    assert html_region.main_text(frame.limit(0)).collect() == []


@pytest.mark.parametrize("links", [3, 39, 60, 500])
def test_a_menu_between_paragraphs_is_left_out_whatever_its_length(links):
    paragraph = "<p>" + "Words of the story that is told here, at some length, without any link. " * 6 + "</p>"
    menu = "<div class='zone'>" + " ".join(f"<a href='/{i}'>topic {i}</a>" for i in range(links)) + "</div>"
    for marked, (before, after) in ((False, ("<div>", "</div>")), (True, ("", ""))):
        page = f"<html><body>{before}{paragraph}{menu}{paragraph}{after}</body></html>"
        for weights in ({}, {"linked": -3.0}):
            text = html_region.extract(page, weights)
            assert text.count("story") == 12 and "topic" not in text, (marked, weights)


def test_blocks_of_links_count_as_labelled_pages_say(spark):
    """Where marked content holds blocks of links, such blocks are content elsewhere too."""
    linked = "<p>" + " ".join(f"<a href='/{i}'>word{i} more{i}</a>" for i in range(30)) + "</p>"
    plain = "<p>" + "some plain words of the text " * 10 + "</p>"
    pages = spark.createDataFrame([(f"<article>{linked}{plain}</article><footer>{'all rights are kept ' * 8}</footer>",)] * 3, "html string")
    weights = html_region.learn(pages)
    assert weights["linked"] > 0 and "word3" in html_region.extract(f"<div>{plain}{linked}{plain}</div>", weights)
    assert "word3" not in html_region.extract(f"<div>{plain}{linked}{plain}</div>", {})
