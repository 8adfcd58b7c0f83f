import hashlib
import itertools
import unicodedata as ud

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from folioflow.llm import lookalikes as L

BASE = "Тhe café at Ångström’s field — naïve ﬁre, 10 kg, “ok” in 1984. Ｆｕｌｌ width and cо"


@pytest.mark.parametrize(
    "a, b",
    [("ｗｏｒｄ", "word"), ("cafe\u0301", "café"), ("ﬁre", "fire"), ("a\u200bb\u00adc\ufeff", "abc"), ("a\u00a0b\u2009c", "a b c"), ("раrсеl", "parcel"), ("Αrk", "Ark"), ("ё", "ë"), ("e\u034f\u0301", "é"), ("⽯", "石"), ("ｶﾞ", "ガ"), ("K", "K"), ("µ", "μ"), ("，", ","), ("یالک", "يالك"), ("a\r\nb", "a\nb")],
)
def test_same_print(a, b):
    assert L.one_form(a) == L.one_form(b)


@pytest.mark.parametrize("a, b", [("A", "a"), ("é", "e"), ("1", "2"), ("m²", "m2"), ("“x”", '"x"'), ("a–b", "a—b"), ("a\nb", "a b"), ("½", "1/2"), ("й", "и"), ("👩\u200d🚀", "👩🚀")])
def test_shows_in_print(a, b):
    assert L.one_form(a) != L.one_form(b)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=40))
def test_one_pass_is_enough(text):
    once = L.one_form(text)
    assert L.one_form(once) == once and ud.is_normalized("NFC", once)


def test_table_is_checked():
    assert len(L.table()) > 1000
    with pytest.raises(ValueError):
        L.check({"²": "2"})
    with pytest.raises(ValueError):
        L.check({"x": "y", "y": "z"})
    assert L.one_form(None) is None and L.one_form("") == ""


def test_pairs_equal_brute_force(spark):
    texts = [BASE, BASE.replace("о", "o"), BASE.replace(" ", "\u00a0"), BASE + "!", BASE.replace("é", "e\u0301"), BASE, "short", None, ""]
    rows = [(i, t, "b") for i, t in enumerate(texts)] + [(0, BASE, "b")]
    got = {(r.a, r.b) for r in L.equal_print_pairs(spark.createDataFrame(rows, "id long, text string, a string"), 60).collect()}
    known = {i: t for i, t in enumerate(texts) if t and len(t) >= 60}
    want = {(i, j) for i, j in itertools.combinations(sorted(known), 2) if known[i] != known[j] and L.one_form(known[i]) == L.one_form(known[j])}
    assert got == want and want
    assert L.equal_print_pairs(spark.createDataFrame([], "id long, text string"), 60).count() == 0


def test_longest_sequence_wins():
    assert L.transduced("\r\n") == "\n" and L.transduced("\ra") == "\na" and L.transduced("ﬃ") == "ffi"
    assert L.one_form("\u0435\u0301") == "é" and L.one_form("ё") == L.one_form("e\u0308")  # look-alikes under accents, however composed
    for c, to in list(L.table().items())[:3000]:
        assert ud.normalize("NFC", L.transduced(c)) == ud.normalize("NFC", to)
        assert L.one_form(c + "\u0301" * 40) == L.one_form(ud.normalize("NFC", c) + "\u0301" * 40)


def test_classes_hold_the_same_links_as_the_pairs(spark):
    texts = [BASE, BASE.replace("о", "o"), BASE.replace(" ", "\u00a0"), BASE + "!", BASE, BASE.replace("é", "e\u0301") + "!", BASE + "?", None, "short"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] * 2, "id long, text string")
    links = {}
    for r in L.equal_print_pairs(df, 60).collect():
        for x in (r.a, r.b):
            links[x] = links.get(x, 0) + 1
    got = {r.id: r for r in L.print_classes(df, 60).collect()}
    assert {k: r.links for k, r in got.items()} == links and got[2].class_id == 0 and got[0].wordings == len({texts[i] for i in (0, 1, 2, 4)})


def test_many_copies_of_one_wording(spark):
    rows = [(i, BASE) for i in range(300)] + [(1000 + i, BASE.replace("о", "o")) for i in range(3)]
    assert L.equal_print_pairs(spark.createDataFrame(rows, "id long, text string"), 60).count() == 900


def test_clip_key(spark):
    df = L.unified(spark.createDataFrame([("ｗord", "x"), (None, "x")], "text string, one string"))
    rows = df.select("one_form", L.clip_key(df["one_form"]).alias("k")).collect()
    assert rows[0].k == hashlib.sha256(b"word").hexdigest()[:32] and rows[1].one_form is None
