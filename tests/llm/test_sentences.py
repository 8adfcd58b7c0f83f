import pytest

from folioflow.llm import sentences as S


def cut(spark, rows):
    df = spark.createDataFrame(rows, "para_id long, book_id string, text string, end_char int")  # a clashing extra column
    ends = {}
    for r in S.sentence_ends(df).collect():
        ends.setdefault(r.para_id, []).append(r.end_char)
    texts = {r[0]: r[2] for r in rows}
    out = {}
    for pid, es in ends.items():
        start, out[pid] = 0, []
        for e in sorted(es):
            out[pid].append(texts[pid][start:e].strip())
            start = e
    return out


CASES = [
    ["Dr. Vale met Mrs. Ort at 3.30 p.m. in the yard.", "She left."],
    ["She had lived for years in the U.S.", "The cook slept."],
    ["“Is it cold?” asked Vale, “or do you mean the pier?”", "The rope lay still."],
    ["He counted: one … two … three, and slept.", "It was late."],
    ["“Nobody came…” Ortane began, but the clerk listened.", "Rain fell."],
    ["The play Who Sold the Map? made Ort famous.", "The end came in 1984.", "57 others left."],
    ["(The lamp was cold, as Ort said.)", "The café — “all was well” — closed."],
    ["See Fig. 7.2 and pp. 25–70 of Vol. 9 for the hut of Ort.", "The file ch2.xhtml at www.ort.example/v3.5/ named it."],
    ["Am 7. Mai 1822 prüfte er das Boot.", "„Halt!“, rief Ort am Kanal.", "Man nahm z. B. das Rad, d. h. fast alles."],
    ["«Где фонарь?» — спросил Ладов.", "Взяли хлеб и т. д., т. е. почти всё.", "— Стойте! — крикнул он."],
    ["“快走！”周石秋说。", "见第2.5节，他称之为《渡船？》的那一篇。", "井台多么旧啊！"],
    ["「待って！」と西井は言った。", "沢田は……外套を売った。", "「鍵はどこ？」小山が聞いた。"],
    ["“기다려!” 장서윤 씨가 말했다.", "왜 그는 열쇠를 버렸을까?"],
    ["«توقف!» صاح هالك.", "لماذا رسم هالك المرآة؟", "قال د. لالك إن راوود راقب الحبل."],
    ["“रुको!” विनील ने कहा।", "पं. नीजीत ने देखा।"],
    ["Γιατί έχασε το κερί;", "Ο κ. Περάτος πλήρωσε."],
    ["ธนกรซื้อสมุด 24 ใบ", "วิภาเดินช้า ๆ ในครัว", "นาย Wilarnet เฝ้าหอคอย"],
    ["eReaders were rare then.", "Version 3.3.22 opens .epub files."],
]


@pytest.mark.parametrize("want", CASES, ids=range(len(CASES)))
def test_sentences_of_one_text(spark, want):
    glue = "" if any(c > "\u3000" and c < "\ua000" for c in want[0]) else " "
    assert cut(spark, [(1, "b", glue.join(want), 0)])[1] == want


def test_a_document_tells_its_own_abbreviations(spark):
    rows = [(1, "a", "He owns the qrt. on the hill.", 0), (2, "a", "We saw the qrt. Vale today.", 0), (3, "b", "The word qrt is short.", 0), (4, "b", "He said qrt. Vale left.", 0)]
    got = cut(spark, rows)
    assert got[2] == ["We saw the qrt. Vale today."]
    assert got[4] == ["He said qrt.", "Vale left."]


def test_edges(spark):
    rows = [(1, None, "One. Two", 0), (1, None, "One. Two", 0), (2, "b", None, 0), (3, "b", "", 0), (4, "b", "* * *", 0), (5, "b", "Über al\u00adles. Jа wohl. ", 0), (6, "b", "x. " * 4000 + "End", 0)]
    got = cut(spark, rows)
    assert set(got) == {1, 5, 6}
    assert got[1] == ["One.", "Two"]
    assert got[5][-1] == "Jа wohl." and len(got[5]) == 2
    assert cut(spark, [(7, "b", "notaire.Personne vint. ", 0)])[7] == ["notaire.", "Personne vint."]
    assert S.sentence_ends(spark.createDataFrame([], "para_id long, book_id string, text string")).count() == 0


def test_paragraphs_that_give_no_ends_are_evidence(spark, tmp_path):
    from folioflow.llm.queries import p1_found

    spark.createDataFrame([("a", 1, "publisher"), ("a", 2, "scan")], "book_id string, doc_pos int, origin string").write.parquet(str(tmp_path / "spine_docs.parquet"))
    rows = [(1, "a", 1, "body", "We saw the qrt. Vale today."), (2, "a", 2, "body", "He owns the qrt. on the hill."), (3, "a", 1, "heading", "Of the qrt. and its yard")]
    spark.createDataFrame(rows, "para_id long, book_id string, doc_pos int, kind string, text string").write.parquet(str(tmp_path / "paragraphs.parquet"))
    assert [(r.para_id, r.end_char) for r in p1_found(spark, str(tmp_path)).collect()] == [(1, 27)]
