import random

import pytest

from turnwise.llm import render

CASES = {
    "": "",
    "plain  text\n here": "plain text here",
    "<p>one<p>two": "one\n\ntwo",
    "<ul><li>a<li>b<ul><li>c</ul></ul>": "- a\n- b\n  - c",
    "<ol start=3><li>x</li><li value=7>y<li>z</ol>": "3. x\n7. y\n8. z",
    "<table><tr><th>name<th>n<tr><td>ann<td>1<tr><td>b<td>20</table>": "name | n\nann  | 1\nb    | 20",
    "<table><tr><td rowspan=2>a<td>b<tr><td>c</table>": "a | b\n  | c",
    "<div hidden>no</div><p style='display:none'>no</p><script>no</script><style>no</style><b style='visibility: hidden'>no</b>yes": "yes",
    "a<br>b<hr>c": "a\nb\n\n---\n\nc",
    "<pre>x  y\n  z</pre>": "x  y\n  z",
    "<blockquote>q<p>r</blockquote>": "> q\n>\n> r",
    "&lt;b&gt; &amp; &eacute;&nbsp;x": "<b> & é x",
    "<!-- gone --><p>kept<!-- open": "kept",
    "<b>bold</b><i>next</i> <a href='x'>link</a>": "boldnext link",
    "<title>t</title><body>b</body>": "b",
    "text <a href='unclosed": "text",
    "<dl><dt>t<dd>d</dl>": "t\n  d",
    "<details><summary>s</summary>hidden</details>": "s",
    "<table><tr><td>a</table>after": "a\n\nafter",
    "<textarea><b>x</b></textarea>": "<b>x</b>",
    "</p>x</div></table>": "x",
}


LONG = "a" * 41
CASES |= {
    f"<table><tr><td>{LONG}<td>1<tr><td>b<td>2</table>": f"{LONG} | 1\nb{' ' * 40} | 2",
    "<table><tr><td rowspan=0>a<td>b<tr><td>c<tr><td>d</table>": "a | b\n  | c\n  | d",
    "<body hidden>no": "",
    "<html style='display:none'>no": "",
    "<dialog>no</dialog><dialog open>yes</dialog>": "yes",
    "<div style='visibility:hidden'>no <b style='visibility:visible'>yes</b></div>": "yes",
    "<ul><li style='visibility:hidden'>no<li>yes</ul>": "- yes",
    "<ruby>k<rp>(</rp><rt>r</rt><rp>)</rp></ruby>": "kr",
    "<style>.x, #y {display: none} p.z{visibility:hidden} @media print {b {display:none}} a:hover{display:none}</style><i class='w x'>no</i><i id=y>no</i><p class=z>no</p><b>yes</b> <a>too</a>": "yes too",
    "<style>/* .q{display:none} */.x{display:none}</style><i class=x style='display:inline'>yes</i><i class=q>too</i>": "yestoo",
}


@pytest.mark.parametrize("page", CASES)
def test_layout(page):
    assert render.render(page)[1] == CASES[page]


DEEP = "<div>" * 200
SHOWN = {
    "a <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>no</annotation></math> b": "a x=1 b",
    "<svg><title>no</title><defs><text>no</text></defs><path d='m'/><text>one</text><text>two</text></svg>": "one two",
    "<object data='x'>instead</object>": "instead",
    "<table><tr><li>x</li></tr></table>": "- x",
    "<table><tr><li>x<td>y</table>": "- x\n\ny",
    "<table><dt>t<dd>d<tr><td>y</table>": "t\n  d\n\ny",
    "<table><tr><option>o</option><td>y</table>": "o\n\ny",
    "<table><tr><caption>c</caption><tr><td>y</table>": "c\ny",
    DEEP + "<p hidden>no</p><template><b>no</b></template><noscript>no</noscript>yes": "yes",
    "<section hidden>" + DEEP + "<section>x</section>no</section>": "",
    DEEP + "<table><tr><td>cell</table>": "cell",
    DEEP + "<ul><li>a<li>b<ul><li>c</ul></ul>": "- a\n- b\n  - c",
    "<blockquote>" * 70 + "q": "> " * 64 + "q",
}


@pytest.mark.parametrize("page", SHOWN)
def test_all_visible_text_and_no_other(page):
    assert render.render(page)[1] == SHOWN[page]


def test_long_cells_are_wrapped_within_their_column():
    """No word is lost, columns stay aligned, and a word longer than the column widens it."""
    words = " ".join(f"word{i}" for i in range(40))
    out = render.render(f"<table><tr><td>{words}<td>1<tr><td>b<td>2<tr><td>{'u' * 100}<td>3</table>")[1].split("\n")
    marks = {x.index(" | ") for x in out if " | " in x}
    assert marks == {100} and " ".join(x[:100].strip() for x in out[:-2]) == words
    assert [x[103:] for x in out if " | " in x] == ["1", "2", "3"]
    assert render.wrapped("x" * 25, 10) == ["x" * 10, "x" * 10, "x" * 5] and render.wrapped("ab cd", 4) == ["ab", "cd"]


def words_of(e):
    """Every text of a tree in order, by plain recursion."""
    return [w for c in e.children for w in (c.split() if isinstance(c, str) else words_of(c))]


def test_no_visible_word_is_lost_or_moved():
    """Random trees of blocks, lists, quotes and tables: the words come out as they stand, marks aside."""
    rng = random.Random(2)
    wrap = ["<div>{}</div>", "<p>{}</p>", "<b>{}</b>", "<ul><li>{}</li></ul>", "<blockquote>{}</blockquote>", "<ol><li>{}</li><li>{}</li></ol>", "<table><tr><td>{}</td></tr></table>", "<dl><dt>{}</dt><dd>{}</dd></dl>", "<section>{} {}</section>"]

    def tree(depth):
        if not depth or rng.random() < 0.2:
            return " ".join(f"w{rng.randint(0, 999)}" for _ in range(rng.randint(1, 4)))
        form = rng.choice(wrap)
        return form.format(*(tree(depth - 1) for _ in range(form.count("{}"))))

    for _ in range(200):
        page = tree(6)
        got = [w for w in render.render(page)[1].split() if w.startswith("w")]
        assert got == words_of(render.parse(page)[0]), page


def test_titles():
    assert render.render("<head><title> A &amp;\n b </title></head>x") == ("A & b", "x")
    assert render.render("<svg><title>no</title></svg><p>x")[0] == ""


def test_deep_and_long_pages_end():
    assert render.render("<div>" * 50000 + "deep")[1] == "deep"
    assert render.render("<ul><li>" * 3000 + "deep")[1].endswith("deep")
    assert render.render("<table><tr><td>" * 2000 + "deep")[1] == "deep"
    assert render.render("<" * 20000)[1]
    assert len(render.render("<p>word " * 20000)[1].split()) == 20000
    assert render.render("<table><tr><td colspan=99999>a<td rowspan=99999>b</table>")[1].startswith("a")
    assert render.render("<a " + "x='" * 5000)[1] == ""


def test_rows(spark):
    pages = spark.createDataFrame([(1, "<p>x", "u"), (1, "<p>x", "u"), (2, None, "u"), (None, "", "u")], "page_id long, html string, text string")
    rows = sorted((str(r.page_id), r.title, r.text) for r in render.extract(pages).collect())
    assert rows == [("1", "", "x"), ("1", "", "x"), ("2", "", ""), ("None", "", "")]
    assert render.extract(pages.limit(0)).count() == 0
