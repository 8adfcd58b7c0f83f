import random

import numpy as np

from folioflow.llm import leakage as K

WORDS = [f"w{i}" for i in range(400)]


def passage(rng, n):
    return [rng.choice(WORDS) for _ in range(n)]


def found(spark, docs, items):
    d = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, share int")
    e = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    return {(r.doc_id, r.item_id) for r in K.leaks(d, e).collect()}


def brute(docs, items):
    """Longest common subsequence in runs of at least three words, over the whole document."""
    out = set()
    for i, t in docs:
        for j, q in items:
            if t and q and K.in_order(K.words(q), K.words(t)) >= 0.55 * len(K.words(q)):
                out.add((i, j))
    return out


def test_against_brute_force(spark):
    rng = random.Random(5)
    items = [(j, " ".join(passage(rng, 60))) for j in range(12)]
    docs = []
    for i in range(60):
        body = passage(rng, 80)
        own = items[i % 12][1].split()
        share = [0.0, 0.3, 0.7, 1.0][i % 4]
        own = own[: int(len(own) * share)]
        for k in range(0, len(own), 15):
            own[k] = "lost"
        docs.append((i, " ".join(body[:40] + own + body[40:])))
    got = found(spark, docs, items)
    assert got == brute(docs, items) and got == {(i, i % 12) for i in range(60) if i % 4 >= 2}


def test_layout_and_notes_don_t_hide(spark):
    item = "The old clerk sold a silent rope to the miller, who kept it under the stairs for nine long years before noon."
    doc = "x y z " + item.upper().replace(",", " [7],").replace(" TO ", "\n  to\u00a0") + " and so on"
    other = "The old clerk sold a silent rope. " + "Other words entirely different stand here now instead of it all."
    shuffled = " ".join(reversed(item.split()))
    assert found(spark, [(1, doc), (2, other), (3, shuffled)], [(9, item)]) == {(1, 9)}


def test_chinese_by_character(spark):
    item = "1909年，白松秋的座钟比房子还贵。谁也没有看见温晴远在村口画下了木桶。沈石石半夜里量过了斗篷。"
    assert found(spark, [(1, "开头" + item[:40] + "结尾"), (2, item[:12])], [(1, item)]) == {(1, 1)}


def test_edges(spark):
    assert found(spark, [(1, None), (2, ""), (None, "a b c d e f")], [(1, None), (2, ""), (3, "a b c"), (None, "a b c d e f")]) == set()
    long = " ".join(WORDS)
    assert found(spark, [(1, long), (1, long), (2, "a " * 200_000 + long)], [(1, long), (2, long)]) == {(1, 1), (1, 2), (2, 1), (2, 2)}
    assert found(spark, [], [(1, long)]) == set() and found(spark, [(1, long)], []) == set()


def test_matches_are_the_longest(spark):
    items = K.Items([(1, "a b c d e f g"), (2, "c d e f g h")])
    stream = np.array([items.vocabulary.get(w, -1) for w in "x a b c d e f g h y".split()] + [-1])
    s, t, n = items.matches(stream)
    assert sorted(zip(s.tolist(), n.tolist())) == [(1, 7), (3, 6)]
    kept = K.without_leaks(spark.createDataFrame([(1, "x"), (2, "y")], "doc_id long, text string"), spark.createDataFrame([(1, 5)], "doc_id long, item_id long"))
    assert [r.doc_id for r in kept.collect()] == [2]


def test_suffix_array_against_plain_search():
    rng = random.Random(9)
    words = list("abcde")
    items = K.Items([(j, " ".join(rng.choice(words) for _ in range(rng.randint(4, 20)))) for j in range(9)])
    for _ in range(30):
        stream = np.array([items.vocabulary.get(rng.choice([*words, "x"]), -1) for _ in range(80)] + [-1])
        places, ranks, keys, shared = items.suffix_array(stream)
        assert keys == sorted(keys) and (np.diff(ranks) >= 0).all()
        want = set()
        for s in range(len(stream)):
            for t in range(len(items.stream)):
                n = 0
                while s + n < len(stream) and t + n < len(items.stream) and stream[s + n] == items.stream[t + n] >= 0:
                    n += 1
                if n >= K.SEED and not (s and t and stream[s - 1] == items.stream[t - 1] >= 0):
                    want.add((s, t, n))
        got = list(zip(*(x.tolist() for x in items.matches(stream)), strict=True))
        assert set(got) == want and len(got) == len(want)


def test_marks_taken_away(spark):
    item = "C’était le registre que Mme Ort a caché. Elle paya 7.29 francs pour Vale’s café, ce matin-là, près du marché."
    doc = "avant " + item.replace("’", "").replace("-", "").replace(".", "").replace(",", "") + " après"
    noted = item.replace("que", "que [22]").replace("francs", "<b>francs</b>")
    assert found(spark, [(1, doc), (2, noted)], [(3, item)]) == {(1, 3), (2, 3)}
    assert K.words("1909年，白松") == ["1909", "年", "白", "松"]
