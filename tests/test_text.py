import re
from itertools import pairwise

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioflow.functions import text as T

END = re.compile(r"""(?:[!?;:]|(?<!\b[A-Z])\.)["')\]”’]*(?=\s|$)""")


def plain_sentences(text):
    text = text.strip()
    ends = [0, *(m.end() for m in END.finditer(text)), len(text)]
    return [s for a, b in pairwise(ends) if (s := text[a:b].strip())]


def plain_cut(piece, most):
    out = []
    while len(piece) > most:
        at = max(piece.rfind(",", 0, most), piece.rfind(";", 0, most)) + 1 or piece.rfind(" ", 0, most + 1)
        at = at if at > 0 else most
        out.append(piece[:at].strip())
        piece = piece[at:].strip()
    return out + [piece] if piece else out


def plain_clips(text, most=125):
    clips = []
    for p in (c for s in plain_sentences(text) for c in plain_cut(s, most)):
        if not any(c.isalnum() for c in p):
            continue
        if clips and len(clips[-1]) + 1 + len(p) <= most:
            clips[-1] += " " + p
        else:
            clips.append(p)
    return clips


TEXTS = ["He left. She stayed! Why? No; never: so.", "J. K. Vale met Ort. Plan B. Then.", "word " * 80, "x" * 400, "a, " * 100 + "end", "“Stop.” he said. (Go.) Now", "* * *", "", "  ", "one two. three", "long; " + "y" * 200 + " z. " + "w" * 130]


def test_split_cut_and_fill(spark):
    df = spark.createDataFrame([(t,) for t in [*TEXTS, None]], "t string")
    rows = df.select("t", T.sentences(F.col("t")).alias("s"), T.clips(F.col("t")).alias("c"), T.clips(F.col("t"), 30, 60).alias("d")).collect()
    for r in rows:
        if r.t is None:
            assert r.s is None
            continue
        assert r.s == plain_sentences(r.t) and r.c == plain_clips(r.t) and r.d == plain_clips(r.t, 30)
        assert all(len(c) <= 125 for c in r.c)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="ab ,;.!?A\"’)x", max_size=90), min_size=1, max_size=12))
def test_clips_as_the_plain_rules(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", T.clips(F.col("t"), 20, 20).alias("c")).collect():
        assert r.c == plain_clips(r.t, 20)


@pytest.mark.parametrize(
    "build, given, want",
    [
        (T.collapse, "a  b [12]\n c [1234]", "a b c [1234]"), (T.slug, "Hello, World!", "hello-world"), (T.slug, "¡¿", "book"), (T.meta_escape, "a=b;c#d\\e\nf", "a\\=b\\;c\\#d\\\\e\\\nf"),
        (T.heading_key, "The Straße — No. 1!", "the strasse no 1"), (T.is_label, "Chapter IV: x", True), (T.is_label, "Chapter ivory", False), (T.is_label, "part twenty-one", True), (T.is_label, "book " + "x" * 90, False),
        (T.is_section_label, "IV.", True), (T.is_section_label, "12", True), (T.is_section_label, "It was a...", True), (T.is_section_label, "Notes and Sources", False),
        (T.truncated, "é" * 60, "é" * 60), (T.truncated, "word " * 40, "word " * 26 + "word…"), (T.speakable, "* * *", False), (T.clip_key, "abc", "ba7816bf8f01cfea414140de5dae2223"),
    ],
)
def test_expressions(spark, build, given, want):
    assert spark.range(1).select(build(F.lit(given)).alias("x")).first().x == want


def test_fingerprint(spark):
    import hashlib

    got = spark.range(1).select(T.fingerprint(F.lit("a"), F.lit("b")).alias("x")).first().x
    assert got == hashlib.sha256(b"a\0b\0").hexdigest()
