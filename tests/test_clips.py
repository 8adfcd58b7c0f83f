import pytest
from pyspark.sql import functions as F

from folioflow.operators import clips as K
from folioflow.operators import retries, timeline

S = "sent_id long, book_id string, chapter_idx int, sent_idx int, para_id long, kind string, text string, key string"


def sentences(spark):
    rows = [(1, "b", 1, 0, 1, "heading", "Head", "x"), (2, "b", 1, 1, 2, "body", "One.", "x"), (3, "b", 1, 2, 2, None, "Two,", "x"), (4, "b", 1, 3, 3, "body", "One.", "x"), (5, "b", 2, 0, 4, "body", "One.", "x"), (6, "b", 2, 1, 4, "body", None, "x")]
    return spark.createDataFrame(rows, S)


def test_gaps_and_uses(spark):
    s = sentences(spark)
    gaps = {r.sent_id: r.gap for r in K.with_gaps(s.where("text is not null")).collect()}
    assert gaps == {1: 0.8, 2: 0.25, 3: 0.4, 4: 0.8, 5: 0.8}
    uses = {r.text: (r.uses, r.first_use) for r in K.first_uses(s.drop("key")).collect()}
    assert uses == {"Head": (1, 1), "One.": (3, 2), "Two,": (1, 3)}


def test_pending_and_counts(spark):
    s = sentences(spark).drop("key")
    uses = K.first_uses(s)
    cached = uses.where("text = 'One.'").select("key", F.lit(10).alias("n_samples")).unionByName(uses.where("text = 'Head'").select("key", F.lit(0).alias("n_samples")))
    assert {r.text for r in K.pending(uses, cached).collect()} == {"Head", "Two,"}  # a clip without samples is a miss
    assert {(r.chapter_idx, r.cached, r.missing) for r in K.chapter_counts(s, cached).collect()} == {(1, 1, 2), (2, 1, 0)}


def test_batches_are_one_global_order(spark):
    rows = [(f"{i * 7919 % 100:02d}{i:03d}", "x" * (i % 13)) for i in range(300)]
    df = spark.createDataFrame(rows, "key string, text string")
    got = {r.key: r.batch for r in K.batches(df, 7).collect()}
    want = {k: i // 7 for i, (k, _) in enumerate(sorted(rows, key=lambda r: (-len(r[1]), r[0])))}
    assert got == want
    with pytest.raises(ValueError):
        K.batches(df, 0)
    assert K.batches(df.limit(0), 7).count() == 0


def test_plans_and_manifests(spark):
    plans = K.chapter_plans(sentences(spark).drop("key"), "fp")
    assert {(r.chapter_idx, len(r.clip_keys)) for r in plans.collect()} == {(1, 4), (2, 1)}
    assert K.stale(plans, plans).count() == 0
    assert K.stale(plans, plans.where("chapter_idx = 1").withColumn("gap_after", F.transform("gap_after", lambda x: x + 1))).count() == 2


def test_progress():
    told = []
    step = K.Progress(200, told.append)
    for done in (0, 5, 19, 20, 21, 90, 199, 200, 200):
        step(done)
    assert told == [10, 40, 90, 100]
    empty = []
    K.Progress(0, empty.append)(0)
    assert empty == [100]


def test_timeline(spark):
    rows = [(1, "b", 1, 0, 24000, 0.25, "One"), (2, "b", 1, 1, 12000, 0.80001, "Two"), (3, "b", 2, 0, 2400, 0.1, "Three")]
    df = spark.createDataFrame(rows, "sent_id long, book_id string, chapter_idx int, sent_idx int, n_samples long, gap double, text string")
    placed = timeline.offsets(df)
    assert [(r.start, r.end, r.start_sample) for r in placed.orderBy("sent_id").collect()] == [(0.0, 1.0, 0), (1.25, 1.75, 30000), (0.0, 0.1, 0)]
    chapters = spark.createDataFrame([("b", 1), ("b", 2), ("b", 3)], "book_id string, chapter_idx int")
    on_book = timeline.book_timeline(timeline.chapter_lengths(placed, chapters))
    got = [(r.samples, r.book_start, r.mark_start, r.mark_end) for r in on_book.orderBy("chapter_idx").collect()]
    assert got == [(61200, 0, 0, 2550), (4800, 61200, 2550, 2750), (2400, 66000, 2750, 2850)]
    text = timeline.vtt(timeline.cues(placed, on_book)).first().vtt
    assert text == "WEBVTT\n\n00:00:00.000 --> 00:00:01.000\nOne\n\n00:00:01.250 --> 00:00:01.750\nTwo\n\n00:00:02.550 --> 00:00:02.650\nThree\n"
    books = spark.createDataFrame([("b", "T=1", None), ("c", "Empty", "A")], "book_id string, title string, author string")
    marks = on_book.withColumn("title", F.concat(F.lit("#"), "chapter_idx"))
    made = {r.book_id: r.metadata for r in timeline.metadata(marks, books).collect()}
    assert made["c"] == ";FFMETADATA1\ntitle=Empty\nartist=A\nalbum=Empty\n"
    assert made["b"].startswith(";FFMETADATA1\ntitle=T\\=1\nalbum=T\\=1\n[CHAPTER]\nTIMEBASE=1/1000\nSTART=0\nEND=2550\ntitle=\\#1\n[CHAPTER]")
    listing = timeline.concat_list(spark.createDataFrame([("b", 2, "/x/it's"), ("b", 1, "/a")], "book_id string, chapter_idx int, path string")).first().listing
    assert listing == "ffconcat version 1.0\nfile '/a'\nfile '/x/it'\\''s'\n"


def test_retries_keep_the_best_take(spark):
    first = spark.createDataFrame([("a", "x" * 100, 0, True, 8.0), ("b", "x" * 100, 0, True, 15.0), ("c", "x" * 100, 0, True, 99.0)], retries.TAKES)
    rounds = []

    def speak(df):
        rounds.append({(r.key, r.attempt, r.capped) for r in df.collect()})
        seconds = F.when(F.col("key") == "b", 20.0 - 5 * F.col("attempt")).when(F.col("capped"), 99.0).otherwise(30.0)
        return df.withColumn("seconds", seconds.cast("double"))

    got = {r.key: (r.attempt, r.capped, r.note) for r in retries.settled(first, speak).collect()}
    assert got["a"] == (0, True, None)
    assert got["b"][0] == 2 and "recovered" in got["b"][2]
    assert got["c"] == (3, False, "kept attempt 3 of 3")
    assert rounds[0] == {("b", 1, True), ("c", 1, True)} and rounds[2] == {("c", 3, False)}


def test_equal_takes_keep_the_earliest(spark):
    t = spark.createDataFrame([("a", "x" * 100, i, False, 13.0) for i in (2, 1, 0)], retries.TAKES)
    assert retries.best_takes(t).first().attempt == 0
