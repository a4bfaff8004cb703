"""Main text of pages: shapes of layout, broken markup, odd values."""

import pytest

from trackloom.llm.htmltext import extract, main_text

LONG = "Words of the article that run on for a while, with commas, and end at last."


@pytest.mark.parametrize("page,want", [
    (None, ""), ("", ""), ("<html></html>", ""), ("plain words", "plain words"),
    ("<body><nav><ul><li><a href=x>Menu</a></li></ul></nav><div class=\"ad\">Buy now.</div><article><h1>Head &amp; more</h1>"
     f"<p><b>Bold start.<br><p>{LONG}</p><p>Short.</p></article><footer>&copy; us</footer></body>", f"Head & more\n\nBold start.\n\n{LONG}\n\nShort."),
    (f"<body><header><h1>Site</h1></header><div id=content><h1>Title</h1><p>{LONG}</p><p>{LONG}</p></div><div class='sidebar'><p>Side {LONG}</p></div>"
     f"<div id=comments><p>First! {LONG}</p></div></body>", f"Title\n\n{LONG}\n\n{LONG}"),
    (f"<body><form><p>{LONG}</p></form><main><p>{LONG}</p><script>var x='<p>no</p>'</script><style>p{{}}</style></main></body>", LONG),
    (f"<article><p>a\n\t b&nbsp;c&#33;</p><ul><li>one<li>two</ul>{LONG}", f"a b c!\n\none\n\ntwo\n\n{LONG}"),
    ("<article><header><h1>T</h1><p>By me</p></header><p>Body text here.</p></article>", "T\n\nBody text here."),
    (f"<body><!-- no <p>x</p> --><div><p>{LONG}</p></div><!-- open <p>never</p>", LONG),
    (f"<div><ul>{''.join(f'<li><a href=/{i}>link number {i}</a></li>' for i in range(30))}</ul></div><div><p>{LONG}</p><p>{LONG}</p></div>", f"{LONG}\n\n{LONG}"),
])
def test_extract(page, want):
    assert extract(page) == want


def test_deep_and_long_pages_end():
    assert extract("<div>" * 20_000 + "deep") == "deep"
    assert extract("<p>" + "word " * 200_000).count("word") == 200_000
    assert extract("<a href='" + "x" * 100_000) in ("", "<a href='" + "x" * 100_000)


def test_operator_keeps_every_row(spark):
    df = spark.createDataFrame([(1, "u", "<p>x</p>", "y"), (1, "u", "<p>x</p>", "y"), (None, None, None, None)], "page_id long, url string, html string, text string")
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in main_text(df).collect()) == [(0, "", 0), (1, "x", 1), (1, "x", 1)]
    assert main_text(df.limit(0)).count() == 0
