import pytest

from folioflow.llm import encoding as E

CLEAN = [
    "Das Mädchen aus Halane ging über die Brücke zur Mühle", "La montaña está lejos y el niño pidió café", "À l’été, la forêt était déjà près du marché",
    "Никто не видел мост на краю деревни после ужина", "Как странно выглядел дом, где он починил ключ", "为什么周云澄忘记了渡船和铜镜", "Γιατί ο γέρος έχασε το κερί και τον χάρτη",
]

HAN = ["林安云打量着马车", "谁也没有看见渡船", "他在村口画下木桶", "收割时称赞了石桥", "整整一夜擦亮书架", "听说井台多么旧啊"]


def garble(text, writer, reader):
    raw = text.encode(writer)
    return "".join(bytes([b]).decode(reader, "ignore") or chr(b) for b in raw) if reader not in E.WIDE else raw.decode(reader)


def corpus(extra):
    rows = [("paragraph", f"c{i}-{k}", t) for i, t in enumerate(CLEAN) for k in range(60)]
    return rows + [("paragraph", f"g{i}", t) for i, t in enumerate(extra)]


def find(spark, rows):
    df = spark.createDataFrame([(*r, "x") for r in rows], "kind string, key string, text string, restored string")
    return {r.key: r for r in E.restored(df).collect()}


@pytest.mark.parametrize(
    "text, writer, reader",
    [(CLEAN[0], "utf-8", "cp1252"), (CLEAN[2], "utf-8", "latin-1"), (CLEAN[1], "utf-8", "cp850"), (CLEAN[3], "utf-8", "cp1251"), (CLEAN[3], "cp1251", "latin-1"), (CLEAN[4], "koi8-r", "cp1251"), (CLEAN[5], "gbk", "latin-1"), (CLEAN[0], "cp1252", "cp850"), (CLEAN[6], "cp1253", "latin-1")],
)
def test_round_trip(spark, text, writer, reader):
    # a text without ASCII can't meet a twin: its code is learned from several odd words
    texts = [text] if " " in text else HAN
    rows = corpus([garble(t, writer, reader) for t in texts]) + [("paragraph", f"h{i}-{k}", f"{t}{k}") for i, t in enumerate(HAN) for k in range(800) if len(texts) > 1]
    got = find(spark, rows)
    assert {k: r.restored for k, r in got.items()} == {f"g{k}": t for k, t in enumerate(texts)}


def test_only_what_is_learned_is_undone(spark):
    alone = "Łódź łąka pięć"  # no twin shows this code, so it stays
    assert not find(spark, corpus([garble(alone, "cp1250", "cp437")]))


def test_transformations_are_worked_out_from_pairs_not_taken_from_a_list():
    assert "cp855>cp1257" in E.explain("что", "что".encode("cp855").decode("cp1257"))
    pairs = [(E.explain(w, garble(w, "koi8-r", "cp1251")), 1) for w in CLEAN[3].split()]
    assert E.cover(pairs, 2) == {"koi8-r>cp1251": len(pairs)}
    assert E.cover([(["cp855>cp1257"], 1)], 2) == {} and E.cover([(["utf-8>cp1252"], 1)], 2) == {"utf-8>cp1252": 1}


def test_twice_in_part_and_lost(spark):
    twice = garble(garble(CLEAN[0], "utf-8", "cp1252"), "utf-8", "cp1252")
    part = CLEAN[4] + " " + garble("Никто не видел", "utf-8", "cp1252")
    lost = "Das M\ufffddchen ging"
    got = find(spark, corpus([twice, part, lost]))
    assert set(got) == {"g0", "g1", "g2"}
    assert got["g0"].restored == CLEAN[0] and got["g1"].restored == CLEAN[4] + " Никто не видел"
    assert got["g2"].transformation is None


def test_rare_but_right(spark):
    fine = ["The letter Ã follows Â in the table", "SÃO TOMÉ NÃO TEM FIM", "The frame ╔══╗ around it", "plain ascii", "“quoted”—and…", "о\ufeffkno with ZWNBSP"]
    assert not find(spark, corpus([t for t in fine for _ in range(3)]))


def test_learned_from_twins(spark):
    rows = [(t,) for t in ["Das Mädchen aus Halane", "Das MÃ¤dchen aus Halane", "Das Mädchen aus Halane"]]
    got = {r.transformation for r in E.learned(spark.createDataFrame(rows, "text string")).collect()}
    assert "utf-8>cp1252" in got


def test_edges(spark):
    assert not find(spark, [("t", "1", None), ("t", "2", ""), ("t", None, "plain")])
    assert E.restored(spark.createDataFrame([], "kind string, key string, text string")).count() == 0
    assert E.undo("Ã©", "cp1252", "utf-8") == "é" and E.undo("é", "cp1252", "utf-8") is None


def test_a_garbled_copy_group_does_not_become_usual(spark):
    boiler = "Alle Rechte vorbehalten; kein Blatt darf ohne Erlaubnis vervielfältigt werden, auch nicht für Bücher"
    bad = garble(boiler, "cp1252", "cp850")
    many = [f"Die Bücher {i} sind für das Mädchen, der Bär schläft" for i in range(1050)] + [boiler]
    rows = [("paragraph", f"c{i}", t) for i, t in enumerate(many)] + [("paragraph", f"g{i}", bad) for i in range(530)]
    got = find(spark, rows)
    assert set(got) == {f"g{i}" for i in range(530)} and {r.restored for r in got.values()} == {boiler}


def test_garbled_sides_of_twins_do_not_vote(spark):
    clean = [f"Der Zeuge {i}x ging heim, Süß" for i in range(40)]
    rows = [("paragraph", f"c{i}", t) for i, t in enumerate(clean)] + [("paragraph", f"g{i}", garble(t, "utf-8", "cp1252")) for i, t in enumerate(clean)]
    assert set(find(spark, rows)) == {f"g{i}" for i in range(40)}


def test_a_record_is_restored_from_its_twin_where_pairs_say_nothing(spark):
    clean = "Der Wärter fuhr einmal nach Łódź"
    got = find(spark, [("paragraph", "c", clean), ("paragraph", "g", garble(clean, "utf-8", "cp1252"))])
    assert set(got) == {"g"} and got["g"].restored == clean and got["g"].transformation == "utf-8>cp1252"
