"""Minimum cuts against all labellings, and pages of several layouts."""

import itertools
import random

import pytest

from strandmill.llm import page_text as pt


def cost(weights, ties, labels):
    return sum(max(w, 0) if not x else max(-w, 0) for w, x in zip(weights, labels, strict=True)) + sum(w for a, b, w in ties if labels[a] != labels[b])


def test_cut_is_minimal():
    rng = random.Random(3)
    for _ in range(300):
        n = rng.randrange(1, 9)
        weights = [rng.choice([-1, 1]) * rng.randrange(0, 5) for _ in range(n)]
        ties = [(i - 1, i, rng.randrange(0, 5)) for i in range(1, n)] + [
            (a, b, rng.randrange(0, 4)) for a, b in (sorted(rng.sample(range(n), 2)) for _ in range(n if n > 1 else 0))]
        best = min(cost(weights, ties, x) for x in itertools.product([False, True], repeat=n))
        assert cost(weights, ties, pt.cut(weights, ties)) == pytest.approx(best)


LONG = "This is a long sentence of the article, with enough words to be read. And here is another one of them."
PAGES = {
    "": "",
    "plain text only, without any markup. It has two sentences.": "plain text only, without any markup. It has two sentences.",
    f"<p>{LONG}</p><script>var x = '<p>no</p>';</script><p>{LONG}": f"{LONG} {LONG}",
    f"<body><div id=nav><a href=x>Home</a> <a href=y>News</a></div><div class='content'><h1>Head</h1><p>{LONG}<p>Short one.</div>"
    f"<div class='sidebar'><p>{LONG}</p></div><div id='comments'><p>{LONG}</p></div><footer>&copy; 2020</footer>": f"Head {LONG} Short one.",
    f"<header><p>{LONG}</p></header><main><article><p>A &amp; B &lt;c&gt; caf&eacute;&nbsp;x <b>bo</b>ld<br>new {LONG}</p>"
    f"<section class=comments><p>{LONG}</p></section><form><p>{LONG}</p><input></form></article><aside>{LONG}</aside></main>": f"A & B <c> café x bold new {LONG}",
    f"<!-- <p>{LONG}</p> --><div class='cookie-notice'>{LONG}</div><article><p>{LONG}</p><div class=ad>{LONG}</div><p>End.</p></article>": f"{LONG} End.",
    f"<article><ul><li>one<li>two</ul><table><tr><td>{LONG}<td>cell</table></article>": f"one two {LONG} cell",
    f"<div style='display: none'>{LONG}</div><div role=banner>{LONG}</div><p>5 < 6 and {LONG}</p>": f"5 < 6 and {LONG}",
    "<nav><ul><li><a>a</a><li><a>b</a></ul></nav>": "",
    f"<article><p title=\"a > b\">{LONG}</p><p title='open>{LONG}</article>": None,
    "<" * 500 + ">": None,
}


@pytest.mark.parametrize("page", PAGES)
def test_layouts(page):
    text = pt.main_text(page)
    assert PAGES[page] is None or text == PAGES[page]
    assert text == " ".join(text.split())


def test_pages_table(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "u", f"<article>{LONG}</article>"), (3, "u", f"<article>{LONG}</article>"),
            (None, "v", "<article>" + "<p>word and more. </p>" * 20000 + "</article>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as text")
    out = pt.extract(df)
    assert out.columns == [*df.columns, "main_text"]
    got = {r.page_id: r.main_text for r in out.collect()}
    assert got[1] == got[2] == "" and got[3] == LONG and got[None] == " ".join(["word and more."] * 20000)
    assert pt.extract(df.limit(0)).collect() == []
