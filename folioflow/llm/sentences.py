"""Problem 1: sentence boundaries across languages and scripts.

Method: document-centred disambiguation. One pass over every text splits what is certain by script, leaves full stops after
words open, and counts how each document uses its words where there is no doubt: with a stop before a small letter or comma
(an abbreviation), without a stop (a word), with a capital within a sentence (a proper name), in small letters (a common
word). An open stop is then decided by what its own document says of the word before it and, after an abbreviation, of the
capitalised word behind it. Where the document is silent or says both, the counts of the whole corpus decide.

Nulls and texts without a letter or digit give no row; repeated rows give one; other columns are ignored."""

from __future__ import annotations

import re as stdlib_re
import unicodedata as ud
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex as re
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.session import cut, known_rows, spread

# Marks and words of the written languages.
STOPS = ".!?…。！？؟۔।॥։።｡"
CJK_STOPS = "。！？｡"
CLOSERS = "\"'”’»›“)]}」』）】〕"
INVISIBLE = "­͏​‌‍‎‏⁠﻿"
BLANKS = "              　"
TITLES = frozenset("Mr Mrs Ms Dr Prof Rev Hon Gen Col Capt Lt Sgt St Mt Ft Sr Sra Srta Dra Dña Mme Mlle M MM Fr Hr Frl Hl Abb проф акад гр ул им стр κ κα Δρ".split())
ORDINAL_LEADS = frozenset("am im vom zum beim bis ab seit der die das den dem des jeden diesem".split())
REPORTING = re.compile(
    r"\b(?:said|says|asked|asks|cried|began|whispered|replied|answered|shouted|called|added|told|wrote|murmured|remarked|went on|continued"
    r"|sagte|fragte|rief|antwortete|flüsterte|schrie|begann|dit|demanda|cria|répondit|murmura|dijo|preguntó|gritó|respondió|disse|perguntou|gritou|respondeu"
    r"|сказал\w*|спросил\w*|крикнул\w*|ответил\w*|прошептал\w*|είπε|ρώτησε|φώναξε|απάντησε)\b"
    r"|말했다|물었다|외쳤다|대답했다|소리쳤다|कहा|पूछा|चिल्लाया|बोला|बोली|قال|قالت|سأل|صاح|صاحت|أجاب"
)
REPORTING_CJK = re.compile(r"[说問问道喊叫答嚷]|言った|言う|聞いた|叫んだ|答えた|尋ねた|つぶやいた")

LOOKALIKE = str.maketrans("авекмнорстхуіјѕАВЕКМНОРСТХУІЈЅοαρνΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "abekmhopctxyijsABEKMHOPCTXYIJSoapvABEZHIKMNOPTYX")
LATIN_AS_CYRILLIC = str.maketrans("aekmhopctxyijsABEKMHOPCTXYIJS", "аекмнорстхуіјѕАВЕКМНОРСТХУІЈЅ")
WIDE = {c: c - 0xFEE0 for c in range(0xFF01, 0xFF5F) if chr(c).upper() != chr(c) or chr(c).lower() != chr(c) or chr(c).isdigit() or chr(c) == "．"} | {ord(c): " " for c in BLANKS}
_INVISIBLE = re.compile(f"[{INVISIBLE}]")
_MIXED = re.compile(r"[\p{Latin}\p{Cyrillic}\p{Greek}][\p{L}\p{M}]*")
_LATIN = re.compile(r"\p{Latin}")
_OTHER = re.compile(r"[\p{Cyrillic}\p{Greek}]")
_MARK = re.compile(rf"([{re.escape(STOPS)};;]+(?:\s?[{re.escape(STOPS)}]+)*)((?:\s?[»]|[{re.escape(CLOSERS)}])*)")
_BEFORE = re.compile(r"[\p{L}\p{M}.\-]+\Z")
_URL = re.compile(r"(?:(?<!\w)\w++://|www\.|(?<![\w.-])[\w.-]++@)\S+|(?<![\w.-])[\w-]++(?:\.[\w-]++)++/\S*|(?<![\w-])[\w-]{2,}+\.(?:xhtml|html|epub|m4b|com|org|net|test|example|invalid)\b[^\s,;]*|[A-Za-z]:\\\S+")
_WORD = re.compile(r"(?<![\p{L}\p{M}.])\p{L}[\p{L}\p{M}]*+(?![.'’])")
_ASCII_WORD = stdlib_re.compile(r"(?<![A-Za-z.])[A-Za-z]++(?![.'])")
_INNER = re.compile(r"(?<=[\p{Ll},;] )\p{Lu}[\p{L}\p{M}]++")
_ASCII_INNER = stdlib_re.compile(r"(?<=[a-z,;] )[A-Z][A-Za-z]++")
_THAI_BLANK = re.compile(r"(?<=[ก-ๅ็-๎])[ \n]+")
_GLUED = re.compile(r".*\p{Ll}{3}\.(?=\p{Lu})(.+)")
_DENSE = re.compile(r"\A.*[\p{Han}\p{Hiragana}\p{Katakana}](?=\p{Latin})")
_LOUD = re.compile(r"\p{Lu}{2}[’' \p{Lu}]*\Z")
_ALNUM = re.compile(r"[\p{L}\p{N}]")
_CAMEL = re.compile(r"\p{Ll}{1,2}\p{Lu}\p{L}")

_CASED = re.compile(r"\p{Lu}")
_re = lru_cache(maxsize=None)(re.compile)  # looks up a pattern faster than the module does
Uses = dict[str, Counter]
SURE, OPEN_UPPER, OPEN_LOWER = 0, 1, 2


def folded(text: str) -> tuple[str, list[int] | None]:
    """``text`` with wide letters, blanks and look-alikes made plain and invisible characters left out, and where each character stood."""
    at = None
    if _INVISIBLE.search(text):
        at = [i for i, c in enumerate(text) if c not in INVISIBLE]
        text = "".join(text[i] for i in at)
    if text.isascii():
        return text, at
    text = text.translate(WIDE)
    if _LATIN.search(text) and _OTHER.search(text):
        text = _MIXED.sub(_one_script, text)
    return text, at


def _one_script(m: re.Match) -> str:
    """A word of mixed letters in the script most of them have."""
    latin, other = len(_LATIN.findall(m[0])), len(_OTHER.findall(m[0]))
    if not latin or not other:
        return m[0]
    plain = m[0].translate(LOOKALIKE)
    return plain if not _OTHER.search(plain) else m[0].translate(LATIN_AS_CYRILLIC) if latin < other else plain


def _plain(word: str) -> str:
    """The form under which a word is counted."""
    return word if word.isascii() else ud.normalize("NFKC", word)


def _loud(f: str, i: int) -> bool:
    """Whether what stands before ``i`` is written in capitals."""
    return _LOUD.search(f, max(0, i - 10), i) is not None


def _next_word(f: str, i: int) -> tuple[str, str]:
    """What stands at ``i``: U a capital, L a small letter, N a figure, O a letter without case, D a dash, Q an opening mark, P other, '' the end; and the word."""
    if i >= len(f):
        return "", ""
    c = f[i]
    if c.isalpha():
        m = _re(r"[\p{L}\p{M}]+").match(f, i)
        word = m[0] if m else c
        return ("L" if c.islower() else "U" if c.isupper() else "O"), word
    if c.isdigit():
        return "N", ""
    if c in "—–-―":
        return "D", ""
    if c in "“„«‘‹「『（(\"'¿¡[《":
        return "Q", ""
    return "P", ""


def _reported(f: str, i: int) -> bool:
    """Whether a clause that reports the speech before ``i`` follows: its verb stands before the next stop, within a few words."""
    tail = ud.normalize("NFC", _re(r"[—–―-]?[^.!?。！？؟।;；:，,「“«\n]{0,60}").match(f, i)[0]).lower()
    if _re(r"[぀-ヿ一-鿿]").search(tail[:4]):
        return bool(REPORTING_CJK.search(tail[:24]))
    return bool(REPORTING.search(" ".join(tail.split()[:6])))


def scan(text: str, uses: Uses | None = None) -> list[tuple[int, int, str, str]]:
    """Boundaries of one text as (end, state, word, next); the uses of its words are added to ``uses``, by use.

    ``end`` counts code points of the text as it stands. State SURE needs no decision; OPEN_UPPER and OPEN_LOWER wait for
    the uses of ``word``, before the stop, and ``next``, the capitalised word after it. Uses: a with a stop that goes on, n the
    same before a figure, b without a stop, e with a stop at the end of the text, u with a stop before a capital, m with a
    capital within a sentence."""
    counted, uses = uses is not None, defaultdict(Counter) if uses is None else uses
    if not text or not _ALNUM.search(text):
        return []
    f, at = folded(text)
    size = len(f.rstrip())
    urls = [m.span() for m in _URL.finditer(f)] if "/" in f or "@" in f or "www" in f or "\\" in f or _re(r"\w\.\p{Ll}\p{Ll}").search(f) else []
    found: list[tuple[int, int, str]] = []
    follows: dict[int, str] = {}
    greek_text = _re(r"\p{Greek}{3}").search(f) is not None
    for m in _MARK.finditer(f):
        stop, closing, end = m[1], m[2], m.end()
        if any(a <= m.start() < b - 1 for a, b in urls):
            continue
        if stop[0] in ";;":
            if not greek_text or not _re(r"\p{Greek}[\p{L}\p{M}]*[»”]?\s?\Z").search(f[max(0, m.start() - 20) : m.start()]):
                continue
        if end >= size:
            if stop == ".":
                word = _BEFORE.search(f, max(0, m.start() - 24), m.start())
                if word:
                    key = _plain(word[0].strip("-’'"))
                    uses["e"][key.lower() if len(key) > 1 and key.isupper() and _loud(f, word.start()) else key] += 1
            continue
        if "《" in f and f.rfind("《", 0, m.start()) > f.rfind("》", 0, m.start()):
            continue
        gap = _re(r"\s*").match(f, end).end()
        blank = gap > end
        kind, word_after = _next_word(f, gap)
        if closing and closing[-1] in "“\"'’" and not blank and kind in ("U", "L", "O", "N") and stop[0] not in CJK_STOPS and closing[-1] in "“":
            closing, end, gap, blank = closing[:-1], end - 1, end - 1, False  # an opening mark after a stop without a blank
            kind = "Q"
        if f[end : end + 1] in (",", "，", "、", ";", ":") or (kind == "P" and f[gap] in ",;:)]，"):
            if stop == "." and not closing:
                _use(uses, f, m.start(), "a")
            continue
        if stop[0] in CJK_STOPS:
            if closing:
                if f.startswith(("と", "って"), end):
                    continue
                if stop[-1] in "！？" and _reported(f, gap):
                    continue
                if stop[-1] == "。" and _re(r"[^。！？「“，]{1,12}(?:说|道|言った|聞いた)[。，]").match(f, end) and kind != "Q":
                    continue
            found.append((end, SURE, ""))
            continue
        if stop[0] in "؟۔।॥։።" or stop[0] in "!?;;" or any(c in "!?" for c in stop):
            if kind == "L" and not _CAMEL.match(f, pos=gap):
                continue
            if kind == "D" and (_re(r"[—–―-]\s?\p{Ll}").match(f, gap) or f[gap + 1 : gap + 9].isupper() and _reported(f, gap + 1)):
                continue
            if not blank and kind not in ("U", "Q") and stop[0] not in "؟۔।॥":
                continue
            if closing and kind in ("U", "O", "D") and _reported(f, gap):
                continue
            found.append((end, SURE, ""))
            continue
        if stop.startswith("…") or stop.startswith("..") or len(stop.replace(" ", "")) > 1:
            loud = f[max(0, m.start() - 12) : m.start()].strip()
            if kind in ("U", "Q") and not (closing and _reported(f, gap)) and (blank or closing) and (closing or not m.start() or f[m.start() - 1] != " ") and _re(r"[\p{L}\p{N}]\Z").search(loud):
                found.append((end, SURE, ""))
            continue
        # one full stop
        before = _BEFORE.search(f, max(0, m.start() - 24), m.start())
        word = _plain(_DENSE.sub("", before[0]).strip("-’'")) if before else ""
        if glued := _GLUED.match(word):
            word = glued[1]
        letters = len(_re(r"[^\p{L}]").sub("", word))
        if letters > 1 and word.isupper() and (len(word_after) > 1 and word_after.isupper() or _loud(f, m.start() - len(word))):
            word = word.lower()  # a line in capitals
        if not blank:
            if kind == "U" and not closing and letters >= 3 and "." not in word and _re(r"\p{Lu}(?:\p{Ll}|[’' ]|\.-?\p{Lu}\.)").match(f, end) and _re(r"\p{Ll}\Z").search(word):
                found.append((end, SURE, ""))
            elif closing and kind in ("U", "Q", "O"):
                found.append((end, SURE, ""))
            elif kind == "Q" and letters >= 3:
                found.append((end, SURE, ""))
            elif kind in ("U", "O") and not word and m.start() and f[m.start() - 1] in ")]}”’»²³¹":
                found.append((end, SURE, ""))
            continue
        if closing and "." not in word and letters > 3:
            if kind == "L" and not _CAMEL.match(f, pos=gap) or kind == "D" and _re(r"[—–―-]\s?\p{Ll}").match(f, gap):
                continue
            found.append((end, SURE, ""))
            continue
        if not word:
            number = _re(r"(?:(\p{L}+)\s)?(?<![\p{L}\p{N}.,/])(\d{1,2})\Z").search(f[max(0, m.start() - 16) : m.start()])
            if number and number[1] and number[1].lower() in ORDINAL_LEADS and kind in ("U", "L"):
                continue
            if kind in ("U", "Q", "O", "N", "D") or kind == "L" and _CAMEL.match(f, pos=gap):
                found.append((end, SURE, ""))
            elif kind == "P" and f[gap] not in ",;:)]":
                found.append((end, SURE, ""))
            continue
        if kind == "D" and _re(r"[—–―-]\s?\p{Ll}").match(f, gap):
            continue
        if letters == 1 and "." not in word and word.isupper() and not closing:
            if kind == "U" and not (f[max(0, m.start() - 3) : m.start() - 1].strip() in ("°", "º")):
                if f[m.start() - 2 : m.start() - 1] in ("°", "º"):
                    found.append((end, SURE, ""))
                continue  # an initial
            if f[m.start() - 2 : m.start() - 1] in ("°", "º") and kind in ("U", "Q", "O", "N"):
                found.append((end, SURE, ""))
                continue
        if f[m.start() - len(word) - 1 : m.start() - len(word)] in ("°", "º") and kind in ("U", "Q"):
            found.append((end, SURE, ""))
            continue
        small = kind == "L" and not _CAMEL.match(f, pos=gap)
        uses["a" if small or kind == "P" and f[gap] in ",;:)]" else "n" if kind == "N" else "u"][word] += 1
        if small:
            continue
        found.append((end, OPEN_LOWER if kind == "N" else OPEN_UPPER, word))
        if kind == "U" and not (f.startswith(".", gap + 1) if len(word_after) == 1 else word_after.isupper()):  # initials and lines in capitals say nothing
            follows[end] = _plain(word_after)
    if counted:
        _evidence(f, uses)
    if _re(r"[฀-๿]{4}").search(f):
        found += _thai(f)
    if _re(r"\n[ \t]*\n").search(f):
        found += [(len(f[: m.start()].rstrip()), SURE, "") for m in _re(r"\n[ \t]*\n\s*").finditer(f)]
    spans = {end: (state, word) for end, state, word in sorted(found, key=lambda x: -x[1]) if 0 < end < size}
    ends = [(e, *spans[e]) for e in sorted(spans)] + [(size, SURE, "")]
    kept, start = [], 0
    for end, state, word in ends:
        if not _ALNUM.search(f[start:end]):
            if kept and end == size:  # a tail of marks belongs to the last sentence
                kept[-1] = (end, SURE, "")
            continue
        kept.append((end, state, word))
        start = end
    out = [(e, s, w, follows.get(e, "")) for e, s, w in kept]
    if at is not None:
        at.append(len(text))
        last = len(text.rstrip(INVISIBLE + " \t\n\r" + BLANKS))
        out = [((at[e - 1] + 1) if e < size else last, s, w, n) for e, s, w, n in out]
    elif out:
        out[-1] = (len(text.rstrip()), SURE, "", "")
    return out


def _use(uses: Uses, f: str, i: int, use: str) -> None:
    before = _BEFORE.search(f, max(0, i - 24), i)
    if before:
        uses[use][_plain(before[0].strip("-’'"))] += 1


def _thai(f: str) -> list[tuple[int, int, str]]:
    """A blank ends a Thai sentence unless a figure, a repeat mark or a foreign name stands on either side."""
    found = []
    for m in _THAI_BLANK.finditer(f):
        rest = f[m.end() : m.end() + 60]
        if _re(r"[ก-ๅ]").match(rest) or _re(r"[“\"«‘(]").match(rest) or _re(r"\p{Latin}[\p{L}’'-]*(?:[ ,]+[\p{Latin}\d’'-]+){3}").match(rest):
            found.append((m.start(), SURE, ""))
    return found


def _evidence(f: str, uses: Uses) -> None:
    """Adds to ``uses`` the words of ``f`` that stand without a stop (b), and those with a capital in the midst of a sentence (m)."""
    if f.isascii():
        uses["b"].update(_ASCII_WORD.findall(f))
        uses["m"].update(_ASCII_INNER.findall(f))
    else:
        f = f if ud.is_normalized("NFKC", f) else ud.normalize("NFKC", f)
        uses["b"].update(_WORD.findall(f))
        if _CASED.search(f):
            uses["m"].update(_INNER.findall(f))


_OPEN = pa.list_(pa.struct([("end", pa.int32()), ("state", pa.int32()), ("word", pa.string()), ("next", pa.string())]))
_USES = "abenum"
_ROWS = (
    "para_id long, book_id string, doc_pos int, sure array<int>, open array<struct<end:int,state:int,word:string,next:string>>, "
    "doc long, word string, a int, b int, e int, n int, u int, m int"
)


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (para_id, book_id, doc_pos, asked, doc, text) rows: the ends of each text that is asked for, as one row, and the uses of
    the words of all texts, summed per batch and document, each (doc, word) one row."""
    for batch in batches:
        ids, books, places, asked, docs, texts = (batch.column(i).to_pylist() for i in range(6))
        kept: tuple[list, ...] = ([], [], [], [], [])
        counts: dict[int, Uses] = {}
        for pid, book, place, want, doc, text in zip(ids, books, places, asked, docs, texts, strict=True):
            uses = counts.get(doc) or counts.setdefault(doc, defaultdict(Counter))
            ends = scan(text or "", uses)
            if want and ends:
                sure = [e for e, state, _, _ in ends if state == SURE]
                still = [{"end": e, "state": state, "word": w, "next": n} for e, state, w, n in ends if state != SURE]
                for column, value in zip(kept, (pid, book, place, sure, still), strict=True):
                    column.append(value)
        told: dict[tuple[int, str], list[int]] = {}
        for doc, uses in counts.items():
            for place, use in enumerate(_USES):
                for word, n in uses[use].items():
                    row = told.get((doc, word))
                    if row is None:
                        row = told[doc, word] = [0] * 6
                    row[place] = n
            told.pop((doc, ""), None)
        k, n = len(kept[0]), len(told)
        none = lambda size, kind: pa.nulls(size, kind)
        join = lambda x, y: pa.chunked_array([x, y]).combine_chunks()
        kinds = (pa.int64(), pa.string(), pa.int32(), pa.list_(pa.int32()), _OPEN)
        own = [join(pa.array(c, t), none(n, t)) for c, t in zip(kept, kinds, strict=True)]
        evidence = [join(none(k, pa.int64()), pa.array([d for d, _ in told], pa.int64())), join(none(k, pa.string()), pa.array([w for _, w in told], pa.string()))]
        sums = list(zip(*told.values())) or [()] * 6
        evidence += [join(none(k, pa.int32()), pa.array(c, pa.int32())) for c in sums]
        yield pa.RecordBatch.from_arrays(own + evidence, names=[c.split()[0] for c in ("para_id", "book_id", "doc_pos", "sure", "open", "doc", "word", *_USES)])


def _by_document(a: Column, b: Column, n: Column) -> Column:
    """What a document's own unambiguous uses of a word say: 1 an abbreviation, 0 a word; null where it has none or both.
    A stop before a figure proves nothing, but leaves doubt."""
    return F.when((a > 0) & (b == 0), 1).when((a + n == 0) & (b > 0), 0)


def _by_corpus(word: Column, a: Column, b: Column, e: Column, u: Column) -> Column:
    """The same from the uses of all documents together, where either use may prevail and a figure goes on; 2 an abbreviation that may end a sentence."""
    stops = a + e + u
    return (
        F.when((a > 0) & (stops * 2 >= b) & (e == 0), 1)
        .when((a >= 3) & (e == 0) & (a >= 8 * u), 1)
        .when((a > 0) & (e > 0) & (a * 8 >= e) & (stops >= 2 * b), 2)
        .when((a == 0) & (e == 0) & (u >= 3) & (b == 0) & ((F.length(word) <= 4) | word.contains(".")), 1)
        .when((b > 0) | (e > 0), 0)
    )


def _name(lower: Column, inner: Column) -> Column:
    """True where a capitalised word is a proper name by its uses within sentences, false where it is a common word, null where there are none."""
    return F.when(inner > lower, True).when(lower > 0, False)


def verdicts(evidence: DataFrame) -> DataFrame:
    """(doc, word, says, ends) of every word a document writes before a stop, unless it is a plain word: ``says`` as in
    ``_by_corpus``, taken from the document, then from the corpus, then from the word's length. Whether an abbreviation may end
    a sentence only the corpus knows; ``ends`` tells whether the word is seen at the end of a text anywhere.

    ``evidence`` (doc, word, a, b, e, n, u) must be hashed by ``word``: its sums per word and per document then need no shuffle."""
    uses = ("a", "b", "e", "n", "u")
    corpus = evidence.groupBy("word").agg(*[F.sum(c).alias(f"all_{c}") for c in uses]).where("all_a + all_e + all_n + all_u > 0")
    by_corpus = _by_corpus(F.col("word"), F.col("all_a") + F.col("all_n"), *[F.col(f"all_{c}") for c in ("b", "e", "u")])
    corpus = corpus.select("word", by_corpus.alias("by_corpus"), (F.col("all_e") > 0).alias("ends"))
    own = evidence.where("a + e + n + u > 0").join(corpus, "word")
    by_doc = _by_document(F.col("a"), F.col("b"), F.col("n"))
    by_doc = F.when((by_doc == 1) & F.col("ends"), 2).otherwise(by_doc)
    says = F.coalesce(by_doc, "by_corpus", F.when(F.length("word") <= 2, 1).otherwise(0))
    return own.select("doc", "word", says.alias("says"), "ends").where((F.col("says") != 0) | F.col("word").contains("."))


def names(evidence: DataFrame, asked: DataFrame) -> DataFrame:
    """(doc, next, name) of the capitalised words ``asked`` (doc, next): whether the document, then the corpus, uses them as proper names."""
    both = asked.select(F.explode(F.array("next", F.lower("next"))).alias("word")).distinct()
    used = known_rows(evidence, both, "word", how="left_semi")
    is_lower = F.lower("word") == F.col("word")
    sums = (F.sum(F.when(is_lower, F.col("b")).otherwise(0)).alias("lower"), F.sum("m").alias("inner"))
    own = used.groupBy("doc", F.lower("word").alias("folded")).agg(*sums)
    whole = own.groupBy("folded").agg(_name(F.sum("lower"), F.sum("inner")).alias("by_corpus"))
    wanted = asked.withColumn("folded", F.lower("next"))
    found = wanted.join(own, ["doc", "folded"], "left").join(whole, "folded", "left")
    return found.select("doc", "next", F.coalesce(_name(F.col("lower"), F.col("inner")), "by_corpus").alias("name"))


def sentence_ends(paragraphs: DataFrame, published: DataFrame | None = None) -> DataFrame:
    """(para_id, end_char) of every sentence of ``paragraphs`` (para_id, book_id, text).

    Words are counted over all given paragraphs. Only rows with ``asked`` (a column of the paragraphs; all rows where it is
    missing), and of documents (book_id, doc_pos) that are in ``published`` where that is given, give ends. Null or wordless
    texts give none; repeated paragraphs give theirs once; of several texts under one id the one whose ends come last counts.
    Texts are read in place and never shuffled: counts and ends are."""
    has = lambda c, other: F.col(c) if c in paragraphs.columns else F.lit(other)
    own = paragraphs.where(F.col("text").isNotNull())
    own = own.select("para_id", "book_id", has("doc_pos", 0).cast("int").alias("doc_pos"), F.coalesce(has("asked", True), F.lit(False)).alias("asked"), F.xxhash64("book_id").alias("doc"), "text")
    rows = cut(own.mapInArrow(_scanned, _ROWS))
    evidence = rows.where("doc is not null").select("doc", "word", *_USES)
    evidence = spread(evidence, "word").groupBy("word", "doc").agg(*[F.sum(c).alias(c) for c in _USES])
    ends = rows.where("sure is not null").select("para_id", "book_id", "doc_pos", "sure", "open")
    if published is not None:
        ends = known_rows(ends, published.select("book_id", "doc_pos").distinct(), "book_id", "doc_pos", how="left_semi")
    ends = ends.groupBy("para_id").agg(F.max(F.struct("sure", "open", F.xxhash64("book_id").alias("doc"))).alias("x")).select("para_id", "x.*")
    sure = ends.select("para_id", F.explode("sure").alias("end_char"))
    still_open = ends.select("para_id", "doc", F.explode("open").alias("x")).select("para_id", "doc", F.col("x.end").alias("end_char"), "x.state", "x.word", "x.next")
    said = known_rows(still_open, cut(verdicts(evidence)), "doc", "word", how="left")
    title = F.lower("word").isin(*sorted({x.lower() for x in TITLES})) & (F.col("state") == OPEN_UPPER)
    plain = said.where(F.col("says").isNull() & ~title).select("para_id", "end_char")  # a word that is no abbreviation ends its sentence
    doubtful = cut(said.where(F.col("says").isNotNull() & ~title))
    asked = doubtful.where((F.col("state") == OPEN_UPPER) & (F.col("next") != "")).select("doc", "next").distinct()
    told = known_rows(doubtful, names(evidence, asked), "doc", "next", how="left")
    common = ~F.coalesce("name", F.lit(True))  # a common word with a capital starts a sentence
    ended = F.when(F.col("says") == 1, common).when(F.col("says") == 2, True).otherwise(F.col("ends") | common)
    decided = told.where(F.when(F.col("state") == OPEN_LOWER, F.col("says") != 1).otherwise(ended))
    return sure.unionByName(plain).unionByName(decided.select("para_id", "end_char"))


__all__ = ["folded", "names", "scan", "sentence_ends", "verdicts"]
