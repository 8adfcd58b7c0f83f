import pytest
import regex as re

from folioflow.llm import pieces as P


def size(text, unit):
    return {"chars": len(text), "bytes": len(text.encode()), "utf16": len(text.encode("utf-16-le")) // 2}[unit]


TEXTS = {
    "prose": "The cook sold the rope. The clerk kept the lamp, as ever; the night was cold. " * 30,
    "run": "x" * 900,
    "pictures": "👩‍🚀é̂" * 200,
    "han": "林安云打量着马车。周石秋称赞了井台，又买下了木桶；" * 40,
    "thai": "ธนกรซื้อสมุด 24 ใบ " * 60,
}


@pytest.mark.parametrize("unit, limit, overlap", [("chars", 120, 20), ("bytes", 200, 40), ("utf16", 150, 30), ("chars", 7, 90), ("bytes", 61, 0)])
@pytest.mark.parametrize("name", TEXTS)
def test_pieces_cover_the_text_within_the_limit(name, unit, limit, overlap):
    text = TEXTS[name]
    got = P.cut(text, unit, limit, overlap)
    assert got[0][0] == 0 and got[-1][1] == len(text)
    for a, b, _ in got:
        assert a < b and size(text[a:b], unit) <= limit
    for (a0, b0, _), (a1, b1, _) in zip(got, got[1:]):
        assert a0 < a1 <= b0 < b1  # no gap, and forward
        assert size(text[a1:b0], unit) <= overlap
        if name == "run" and overlap <= limit // 2:
            assert b0 - a1 == overlap
    whole, at = "", 0
    for a, b, _ in got:
        whole += text[at:b]
        at = b
    assert whole == text


def test_graphemes_stay_whole():
    text = TEXTS["pictures"]
    ends = {m.end() for m in re.finditer(r"\X", text)}
    assert all(b in ends for _, b, _ in P.cut(text, "chars", 40, 0))


def test_the_topic_decides():
    text = "The rope held the boat and the rope held. The boat and the rope held the boat. " * 2 + "Stars shine above cold stars tonight. Cold stars shine above all stars. " * 2
    first = P.cut(text, "chars", len(text) - 20, 0)[0]
    assert text[first[1] :].startswith("Stars") and first[2] == "sentence"


def test_over_tables(spark):
    rows = [
        ("s", 1, "a" * 11, "chars", 10, 2, 0), ("s", 2, "a" * 10, "chars", 10, 2, 0), ("s", 3, "é" * 6, "bytes", 10, 0, 0), ("s", 4, "😀" * 6, "utf16", 10, None, 0), ("s", 5, None, "chars", 10, 2, 0),
        ("s", 6, "", "chars", 0, 2, 0), ("s", 7, "a" * 20, "acres", 10, 2, 0), ("s", 8, "a" * 20, "chars", None, 2, 0), ("s", 1, "a" * 11, "chars", 10, 2, 0),
    ]
    df = spark.createDataFrame(rows, "item_kind string, item_id long, text string, size_unit string, max_size int, overlap_size int, piece_idx int")
    got = P.oversized_pieces(df).collect()
    assert {r.item_id for r in got} == {1, 3, 4}
    assert sum(r.item_id == 1 for r in got) == 2
    assert P.oversized_pieces(df.limit(0)).count() == 0
