import random

from folioflow.llm import stuffing as S

NOUNS = "rope lamp boat clerk miller stair garden window letter brook pump hedge candle kettle market".split()
VERBS = "sold kept lost found drew mended painted carried".split()


def prose(rng, n):
    return " ".join(f"The {rng.choice(NOUNS)} of the {rng.choice(NOUNS)} was {rng.choice(VERBS)} by a {rng.choice(NOUNS)} in the {rng.choice(NOUNS)}." for _ in range(n))


def pages():
    rng = random.Random(3)
    kw = ["ebook", "torrent", "mp3", "coupon"]
    plain = [prose(rng, rng.randint(3, 12)) for _ in range(80)]
    spam = [
        "\n".join(f"{rng.choice(kw)} Vale" for _ in range(30)), " ".join(rng.choice(kw) for _ in range(120)), "\n".join(f"http://a{i}.example/x-{i}" for i in range(20)),
        "\n".join(f'<a href="https://b{i}.test">rope {i}</a>' for i in range(20)), " ".join(f"#{rng.choice(kw)}Vale" for _ in range(40)), ", ".join(f"{rng.choice(kw)} Ort" for _ in range(60)),
        prose(rng, 1) + "\n" + " ".join(rng.choice(kw) for _ in range(120)), " ".join(" ".join(rng.choice(kw)) for _ in range(50)),
    ]
    fine = [
        "Index\n" + "\n".join(f"{w}, {i}, {200 + i}–{300 + i}" for i, w in enumerate(NOUNS)), prose(rng, 10) + "\n" + " ".join(rng.choice(kw) for _ in range(20)),
        "\n\n".join("The clerk sold the rope,\nand the miller lost the lamp.\nO carry the boat, carry it home." for _ in range(8)), "Cast\n" + "\n".join(f"N{i}x — the {w}" for i, w in enumerate(NOUNS)),
        "WEBVTT\n\n" + "\n\n".join(f"00:0{i}:01.000 --> 00:0{i}:02.000\n{prose(rng, 1)}" for i in range(6)),
    ]
    return plain, spam, fine


def test_spam_is_told_from_a_books_own_matter(spark):
    plain, spam, fine = pages()
    texts = plain + spam + fine
    rows = [(i, "en" if i % 7 else None, t, 0.0) for i, t in enumerate(texts)]
    got = {r.doc_id for r in S.stuffed(spark.createDataFrame(rows, "doc_id long, lang string, text string, apart double")).collect()}
    assert got == {len(plain) + k for k in range(len(spam))}


def test_curve_is_the_least_squares_line(spark):
    import numpy as np

    plain, _, _ = pages()
    words = ["zip"] * 40 + ["zap"] * 20 + ["zop"] * 10 + ["zup"] * 5 + ["zep"] * 5
    rows = [(i, "en", t) for i, t in enumerate(plain)] + [(999, "en", " ".join(words)), (999, "en", " ".join(words))]
    r = next(x for x in S.curves(spark.createDataFrame(rows, "doc_id long, lang string, text string")).collect() if x.doc_id == 999)
    x, y = np.log([1, 2, 3, 4.5, 4.5]), np.log([40, 20, 10, 5, 5])  # equal uses share their mean rank
    slope, base = np.polyfit(x, y, 1)
    assert abs(r.slope - slope) < 1e-9 and abs(r.residual - np.sqrt(((y - base - slope * x) ** 2).mean())) < 1e-6
    assert (r.words, r.band) == (80, 6) and abs(r.height - np.log(80 / 5)) < 1e-9


def test_a_page_is_compared_with_its_like(spark):
    schema = "doc_id long, lang string, band int, words long, apart double, linked double, slope double, residual double, height double"
    like = [(i, "aa", 6, 80, 0.0, 0.0, -0.2 - 0.001 * (i % 5), 0.1, 0.1) for i in range(25)]
    other = [(100 + i, "bb", 6, 80, 0.0, 0.0, -0.8 - 0.001 * (i % 5), 0.1, 0.1) for i in range(25)]
    asked = [(900, "aa", 6, 80, 1.0, 0.0, -0.8, 0.1, 0.1), (901, "bb", 6, 80, 1.0, 0.0, -0.8, 0.1, 0.1), (902, "cc", 6, 80, 1.0, 0.0, -0.8, 0.1, 0.1)]
    got = {r.doc_id: r.steeper for r in S.compared(spark.createDataFrame(like + other + asked, schema)).collect()}
    assert len(got) == 53 and got[900] > 10 and abs(got[901]) < 1 and 0 <= got[902] < 10  # an unknown language is compared with all


def test_edges(spark):
    schema = "doc_id long, lang string, text string"
    assert S.stuffed(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, "en", None), (2, None, ""), (3, "en", "\n \n"), (None, "en", "x y z"), (4, "en", "12 13\n14"), (5, "en", "One short line.")]
    assert S.stuffed(spark.createDataFrame(rows, schema)).count() == 0


def test_a_source_of_stuffed_pages_does_not_make_its_keywords_prose(spark):
    rng = random.Random(5)
    good = [(i, "en", f"s{i % 5}", prose(rng, rng.randint(4, 12))) for i in range(100)]
    kw = ["ebook", "torrent", "mp3", "coupon", "casino", "poker", "loan", "pills"]
    bad = [(1000 + i, "en", "spam", " ".join(rng.choice(kw) for _ in range(rng.randint(60, 90)))) for i in range(50)]
    many = [f"{c}{v}{d}" for c in "bdfgk" for v in "aeiou" for d in "lmnrt"]
    wide = [(2000 + i, "en", "more", " ".join(w for w in rng.sample(many, 40) for _ in range(2))) for i in range(20)]
    text = " ".join(rng.choice(["tram", "visa", "quiz"]) for _ in range(80))
    copies = [(3000 + i, "en", "more", text) for i in range(30)]
    wrong = [(4000, "xx", "s1", " ".join(rng.choice(kw) for _ in range(80))), (4001, "xx", "s2", good[0][3])]
    rows = good + bad + wide + copies + wrong
    got = {r.doc_id for r in S.stuffed(spark.createDataFrame(rows, "doc_id long, lang string, source string, text string")).collect()}
    assert got == {r[0] for r in bad + wide + copies + wrong[:1]}
