import pytest

from folioflow.llm import markup as M

MARKED = [
    "<p>One</p>", "a &amp; b", "&lt;p&gt;x&lt;/p&gt;", "# Head\n\ntext", "Head\n====", "**bold** text", "see [x](http://a.example/1)", "![alt](img/p.png){.plate}", "`code`[^1]\n\n[^1]: note",
    "```py\nx = 1\n```", "> quoted", "* a\n* b", "1. a\n1. b", "| a | b |\n|---|:--:|\n| 1 | 2 |", "[[Target|word]]", "'''bold''' x", "== Head ==\ntext", "{{stub}}", "{|\n! a\n|-\n| b\n|}",
    "[http://a.example word]", "__NOTOC__\ntext", "\\section{Head}", "\\emph{x}", "$x^2 + y$ holds", "\\[ x = 1 \\]", "\\begin{itemize}\n\\item a\n\\end{itemize}", "``x'' y", "caf\\'{e}", "a<br/>b", "x<!-- c -->",
]
PRINTED = [
    "* * *", "***", "If a < b and b > c, then", "3 * 4 * 5 shillings", "cost $5 in 1939 and $9 a year later", "C:\\books\\old_jar_9 here", "Write to <ort@vale.example> now", "was careful [75].",
    "x_1 + x_2 = 55, and ~ 6 kg", "i == j held", "The set {2, 4} and (a|b)", "“if (x > 0) return x;” was all", "7/10 *, with a star", "The #1 title", "wrote [sic],", "A & B", "- dash", "2019. It was", "it's '90s", "", "—Não", "§\n40. Nobody could read",
]


@pytest.mark.parametrize("text", MARKED)
def test_control_signs_are_found(text):
    assert M.signs(text)


@pytest.mark.parametrize("text", PRINTED)
def test_signs_of_the_line_are_not(text):
    assert not M.signs(text)


@pytest.mark.parametrize(
    "text, want",
    [
        ("<h2>Head</h2><p>One &amp; two</p><ul><li>a</li><li>b</li></ul>", [("heading", "Head"), ("body", "One & two"), ("list", "a"), ("list", "b")]),
        ("# Head #\n\nSome *words* and [a link](http://x.example).", [("heading", "Head"), ("body", "Some words and a link.")]),
        ("== Head ==\n'''bold''' [[T|word]] {{stub}}", [("heading", "Head"), ("body", "bold word")]),
        ("\\section{Head}\ncaf\\'{e} \\emph{now}\\footnote{n}", [("heading", "Head"), ("body", "café nown")]),
        ("text\n```\na < b\n```", [("body", "text"), ("code", "a < b")]),
        ("\\[ x^2 \\]\nwords", [("formula", "x^2"), ("body", "words")]),
        ("| a | b |\n|---|---|\n| 1 | 2 |", [("row", "a, b"), ("row", "1, 2")]),
        ("plain text", [("body", "plain text")]),
        ("", []),
    ],
)
def test_blocks(text, want):
    assert M.blocks(text) == want


def test_alignment_makes_optional_and_repeated_groups():
    a = M.folded(M.stream("<ul><li>a</li><li>b</li></ul>"))
    assert a == ("<ul>", ("+", ("<li>", "#text", "</li>")), "</ul>")
    one = M.align(M.folded(M.stream("<p>x</p>")), M.folded(M.stream("<p>x<br></p>")))
    assert ("?", ("<br>",)) in one
    assert M._read(M._write(a)) == a


@pytest.mark.parametrize(
    "wrapper, stream, made",
    [
        ("#text <a> #text", "#text <a> #text", True),
        ("#text <a> #text", "<a> #text #text", False),
        ("<ul> ( <li> #text )+ </ul>", "<ul> <li> #text <li> #text <li> #text </ul>", True),
        ("<ul> ( <li> #text )+ </ul>", "<ul> <li> #text </ul> <li>", False),
        ("( ( a )? ( b )? )+ c", "a b a a b " * 40 + "c", True),
        ("( ( a )? ( b )? )+ c", "a b a a b " * 40 + "d", False),
        ("<p> ( #text <br> )? #text </p>", "<p> #text </p>", True),
    ],
)
def test_a_wrapper_makes_streams_in_order(wrapper, stream, made):
    assert M.accepts(M._read(wrapper), M._read(stream.strip())) is made


def test_inferred_wrappers_make_all_they_were_inferred_from():
    streams = [M.folded(M.stream(t)) for t in MARKED]
    made = M.inferred([(x, 1) for x in streams])
    assert len(made) < len(streams) and sum(n for _, n in made) == len(streams)
    assert all(any(M.accepts(w, x) for w, _ in made) for x in streams)


def test_only_signs_that_other_texts_of_the_host_support_are_markup(spark):
    rows = [(k, "a", f"text {k} <b>bold</b> more", "x") for k in range(3)] + [(10, "b", "text <b>bold</b> more", "x"), (11, "a", "text <b>bold</b> and <b>more</b> here", "x"), (12, "a", "see `n` here", "x")]
    df = spark.createDataFrame(rows, "id long, host string, text string, kind string")
    held = M.marked(M.streams(df.drop("kind")))
    assert sorted(r.id for r in held.collect()) == [0, 1, 2, 11]  # 10 stands alone in its host, 12 has a stream of its own
    clean = {r.id: r.text for r in M.cleaned(df, held).collect()}
    assert clean[0] == "text 0 bold more" and clean[10] == "text <b>bold</b> more" and clean[12] == "see `n` here"


def test_wrappers_over_tables(spark):
    rows = [(1, "h", "<p>x</p>", "k"), (2, "h", "<p>x<br>y</p>", "k"), (3, "h", "plain", "k"), (4, None, "**b** x", "k"), (5, "h", None, "k"), (6, "h", "", "k"), (1, "h", "<p>x</p>", "k"), (7, "h", "<p>z</p>", "k")]
    df = spark.createDataFrame(rows, "id long, host string, text string, kind string")
    found = M.streams(df)
    assert sorted({r.id for r in M.marked(found).collect()}) == [1, 2, 7]
    made = M.wrappers(M.distinct_streams(found)).collect()
    assert {(r.host, r.texts) for r in made} == {("h", 3), ("", 1)}
    assert all(M.accepts(M._read(r.wrapper), M.folded(M.stream(t))) for r in made if r.host for t in ("<p>x</p>", "<p>x<br>y</p>"))
    clean = M.cleaned(df, M.marked(found)).collect()
    assert {(r.id, r.text) for r in clean} == {(1, "x"), (2, "x\ny"), (3, "plain"), (4, "**b** x"), (7, "z")}
    empty = spark.createDataFrame([], "id long, host string, text string, kind string")
    assert M.marked(M.streams(empty)).count() == 0 and M.cleaned(empty, M.marked(M.streams(empty))).count() == 0


def test_long_text(spark):
    rows = [(k, "h", "<p>" + f"word {k} & more < less " * 20000 + "</p>") for k in range(3)]
    assert M.marked(M.streams(spark.createDataFrame(rows, "id long, host string, text string"))).count() == 3
