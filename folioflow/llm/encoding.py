"""Problem 2: text that was decoded with the wrong character encoding.

Method: garbled records and clean near-twins meet on their text stripped of non-ASCII characters; their words are aligned
one by one. Of every aligned pair it is worked out which code it was written in and which it was read in; the fewest such
transformations that explain the pairs, each with ``LEAST_SUPPORT`` different ones, are learned. Only learned
transformations are undone on the remaining records, wherever that turns letters that hardly ever stand side by side in the
whole corpus into letters that often do. Scripts without ASCII between their letters leave nothing to meet on: for what is
still odd then, transformations are learned from the words that they make usual. Records with replacement characters or
stray control characters are found even where nothing can be restored.

Null and plain ASCII texts are no case; repeated rows count once; texts are read whole."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import cache, lru_cache

import pyarrow as pa
import regex as re
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.lookalikes import one_form
from folioflow.session import cut, known_rows

# Codes that extend ASCII, those of the web's encoding standard and of DOS, the more usual first.
CODES = (
    "utf-8 cp1252 latin-1 cp437 cp850 mac-roman cp1251 cp1250 cp1253 cp1254 cp1255 cp1256 cp1257 cp1258 koi8-r koi8-u cp866 mac-cyrillic iso8859-2 iso8859-3 iso8859-4 iso8859-5 iso8859-6"
    " iso8859-7 iso8859-8 iso8859-10 iso8859-13 iso8859-14 iso8859-15 iso8859-16 cp874 gbk big5 cp932 euc-jp cp949 cp852 cp855 cp857 cp858 cp860 cp861 cp862 cp863 cp865 cp775 cp737 cp869"
).split()
WIDE = frozenset(("gbk", "big5", "cp932", "euc-jp", "cp949"))
WESTERN = ("cp1252", "latin-1", "cp850", "cp437", "mac-roman")
READERS = tuple(c for c in CODES if c != "utf-8")

TOKEN = re.compile(r"[^\x00-\x20]*[^\x00-\x7f][^\x00-\x20]*")
RUN = r"[^\x00-\x7f]+"
BLANKS = r"[\x00-\x20]+"
TYPOGRAPHIC = frozenset("“”‘’«»„…—–‚\u00a0")
#: In text without blanks a garbled stretch stands right beside clean ideographs.
_BETWEEN = re.compile(r"[\x21-\u2e7f]*[\x80-\u2e7f][\x21-\u2e7f]*")
_PART = re.compile(r"[^\x00-\x20“”‘’«»„…—–]*[^\x00-\x7f“”‘’«»„…—–][^\x00-\x20“”‘’«»„…—–]*")
_LATIN = re.compile(r"\p{Latin}")
_FOREIGN = re.compile(r"[\p{Cyrillic}\p{Greek}\p{Arabic}\p{Hebrew}\p{Thai}\p{Hangul}\p{Han}]")
_NUMERAL = re.compile(r"\p{Han}[IVXLC]+\p{Han}")
_CASE_BREAK = re.compile(r"\p{Ll}\p{Lu}|\p{Lu}\p{Lu}\p{Ll}")
_CONTROL = re.compile(r"[\x80-\x84\x86-\x9f]")
STRIP = "\"'()[]{}.,;:!?*_/<>#=|&"

ODD = -4.2  # mean log10 share of a token's letter pairs in the corpus below which it is looked into
GAIN = 0.8  # by how much undoing a transformation must raise it
GAIN_WEST = 1.2  # the same where one western letter becomes another
GAIN_UTF8 = 0.15  # the same where strict UTF-8 comes out, which chance hardly makes
LEAST_SKELETON = 4  # characters that twins must share; with fewer, texts meet that have nothing to do with one another
LEAST_SUPPORT = 2  # different aligned words that must show a transformation; strict UTF-8 proves itself with one
LEAST_ODD = 5  # different odd words that a transformation must make usual to be learned without twins
ODD_LETTERS = 6  # characters above ASCII such a word must have
LEAST_SHARE = 2e-7  # letter pairs with a lower share count as unseen, so that at most 1 / LEAST_SHARE are kept, whatever the corpus
FEW_TEXTS = 1000  # with fewer different texts pairs are too few to tell, and copies count up to this number over that of the texts


@cache
def _bytes_of(reader: str) -> dict[str, int]:
    """Byte of each character above ASCII; bytes the code leaves open stand as control characters."""
    made = {}
    for b in range(0x80, 0x100):
        try:
            c = bytes([b]).decode(reader)
        except UnicodeDecodeError:
            c = chr(b)
        made.setdefault(c, b)
    return made


def undo(text: str, reader: str, writer: str, controls: bool = False) -> str | None:
    """What ``text`` was before bytes written in ``writer`` were read as ``reader``; None where that can't be.

    Stray control characters are let through only as a step of several (``controls``)."""
    if reader in WIDE:
        try:
            raw = text.encode(reader)
        except UnicodeEncodeError:
            return None
    else:
        of, raw = _bytes_of(reader), bytearray()
        for c in text:
            b = ord(c) if c < "\x80" else of.get(c)
            if b is None:
                return None
            raw.append(b)
    try:
        out = bytes(raw).decode(writer)
    except UnicodeDecodeError:
        return None
    if out == text:
        return None
    return None if not controls and any("\x80" <= c < "\xa0" and c != "\x85" or c < " " and c not in "\t\n\r" for c in out) else out


@lru_cache(maxsize=50_000)
def _written(c: str) -> dict[str, bytes]:
    """Bytes of one character in every code that has it."""
    out = {}
    for w in CODES:
        try:
            out[w] = c.encode(w)
        except UnicodeEncodeError:
            continue
    return out


@lru_cache(maxsize=50_000)
def _read(c: str) -> dict[int, list[str]]:
    """Codes in which ``c`` may have been read, by its first byte."""
    out: dict[int, list[str]] = {}
    for r in READERS:
        if r in WIDE:
            first = _written(c).get(r, b"")[:1]
        else:
            first = bytes([_bytes_of(r)[c]]) if c in _bytes_of(r) else b""
        if first and first[0] >= 0x80:
            out.setdefault(first[0], []).append(r)
    return out


def explain(clean: str, garbled: str) -> list[str]:
    """Names (written in > read in) of the transformations that turn ``clean`` into ``garbled``: all pairs of codes are considered."""
    a, b = re.search(RUN, clean), re.search(RUN, garbled)
    if not a or not b or a.start() != b.start() or not len(clean) / 3 <= len(garbled) <= 3 * len(clean):
        return []
    readers = _read(b[0][0])
    found = []
    for w, raw in _written(a[0][0]).items():
        found += [f"{w}>{r}" for r in readers.get(raw[0], ()) if r != w and undo(garbled, r, w) == clean]
    return found


def cover(signatures: list[tuple[list[str], int]], least: int, least_utf8: int = 1) -> dict[str, int]:
    """The fewest transformations that explain the most: again and again the one with most unexplained pairs, as long as it has
    ``least``. ``signatures``: the transformations that explain a pair alike, and of how many pairs they do."""
    order = {c: i for i, c in enumerate(CODES)}
    left, learned = list(signatures), {}
    while left:
        support: Counter = Counter()
        for names, n in left:
            for x in names:
                support[x] += n
        enough = [x for x, n in support.items() if n >= (least_utf8 if x.startswith("utf-8>") else least)]
        if not enough:
            return learned
        best = min(enough, key=lambda x: (-support[x], sum(order[c] for c in x.split(">")), x))
        learned[best] = support[best]
        left = [(names, n) for names, n in left if best not in names]
    return learned


def pairs_of(token: str) -> list[str]:
    """Letter pairs of ``token`` that touch a character above ASCII, and single ideographs and syllables."""
    s = "^" + "".join(c.lower() if len(c.lower()) == 1 else c for c in token.strip(STRIP)) + "$"
    out = []
    for a, b in zip(s, s[1:]):
        if a < "\x80" and b < "\x80" or a >= "⺀" and b < "⺀":
            continue
        out.append(b if b >= "⺀" else a + b)
    return out


def _mixed(token: str) -> bool:
    """Whether ideographs and other characters above ASCII stand side by side."""
    return any("\u2e80" <= c < "\ufb00" for c in token) and any("\x80" <= c < "\u2e80" and c not in TYPOGRAPHIC for c in token)


class Model:
    """How usual a token's letter pairs are in the whole corpus."""

    def __init__(self, counts: dict[str, int], total: int, learned: dict[str, int]):
        self.total = max(total, 1)
        self.shares = {p: math.log10(n / self.total) for p, n in counts.items()}
        self.floor = math.log10(0.3 / self.total)
        self.ranked = [tuple(x.split(">"))[::-1] for x in sorted(learned, key=lambda x: (-learned[x], x))]
        self.usual = lru_cache(maxsize=200_000)(self._usual)
        self.repaired = lru_cache(maxsize=200_000)(self._repaired)

    def _usual(self, token: str) -> float:
        pairs = pairs_of(token)
        if not pairs:
            return -2.5
        of, floor = self.shares.get, self.floor
        return sum(of(p, floor) for p in pairs) / len(pairs)

    def odd(self, token: str) -> bool:
        if self.usual(token) > ODD:
            return False
        plain = one_form(token)
        return plain == token or self.usual(plain) <= ODD

    def _once(self, token: str, odd: bool = True) -> tuple[float, str, str] | None:
        """The best single step back. UTF-8 read as something else is told by its own form; a code of pairs of bytes needs
        several characters; a code of single bytes needs an odd token, and more than one letter if it is of another script."""
        before, best = self.usual(token), None
        high = sum(c > "\x7f" for c in token)
        for r, w in self.ranked:
            if w != "utf-8" and (w in WIDE and high < 4 or w not in WIDE and not odd or w not in WESTERN and high < 2):
                continue
            out = undo(token, r, w)
            if out is None:
                continue
            if w in WESTERN and _CASE_BREAK.search(out) or w != "utf-8" and w not in WESTERN and _LATIN.search(out) and _FOREIGN.search(out) and not _NUMERAL.search(out):
                continue
            after = self.usual(out)
            least = GAIN_UTF8 if w == "utf-8" else (GAIN_WEST if w in WESTERN or not odd else GAIN)
            if after - before >= least and (best is None or after > best[0] + 0.05):
                best = (after, out, f"{w}>{r}")
        return best

    def _repaired(self, token: str) -> tuple[str, str] | None:
        """The token as it was and the transformations undone, or None."""
        if all(c <= "\x7f" or c in TYPOGRAPHIC for c in token):
            return None
        if _mixed(token):
            whole = self._once(token, odd=False)  # ideographs themselves may be what wrong reading made
            return (whole[1], whole[2]) if whole else self._in_parts(token, _BETWEEN)
        odd = self.odd(token)
        names, now = [], token
        for _ in range(3):  # text may have been garbled again and again
            best = self._once(now, odd and not names)
            if best is None or names and not best[2].startswith("utf-8"):
                break
            now = best[1]
            names.append(best[2])
        if names:
            return now, "+".join(names)
        # twice garbled text may be no more usual after one step
        for r, w in self.ranked:
            step = undo(token, r, w, controls=True) if w == "utf-8" else None
            best = step and self._once(step, odd=False)
            if best and best[2].startswith("utf-8") and best[0] - self.usual(token) >= GAIN_UTF8:
                return best[1], f"{w}>{r}+{best[2]}"
        if not odd:
            return None
        return self._in_parts(token, _PART) if any(c in TYPOGRAPHIC for c in token) else None

    def _in_parts(self, token: str, pattern: re.Pattern) -> tuple[str, str] | None:
        """The token with its garbled stretches repaired, where at least one is."""
        done: list[str] = []

        def part(m: re.Match) -> str:
            got = self.repaired(m[0]) if m[0] != token else None
            if got:
                done.append(got[1])
            return got[0] if got else m[0]

        out = pattern.sub(part, token)
        return (out, done[0]) if done else None

    def restore(self, text: str) -> tuple[str, Counter]:
        """The text with its garbled tokens repaired, and what was undone how often. A stretch is mostly garbled in one way:
        where a single-byte code prevails, tokens between repaired ones are undone by it, also those too short to tell."""
        names: Counter = Counter()
        if not any(map(self.repaired, set(TOKEN.findall(text)))):
            return text, names
        tokens = [(m.start(), m[0], self.repaired(m[0])) for m in TOKEN.finditer(text)]
        for _, token, got in tokens:
            if got:
                names[got[1]] += len(token)
        if not names:
            return text, names
        prevailing = names.most_common(1)[0][0]
        writer, _, reader = prevailing.partition(">")
        alone = "+" not in prevailing and writer != "utf-8"
        same = [bool(got) and got[1] == prevailing for _, _, got in tokens]
        parts, at = [], 0
        for k, (start, token, got) in enumerate(tokens):
            now = got[0] if got else token
            if alone and not same[k] and (out := undo(token, reader, writer)):
                between = any(same[max(0, k - 3) : k]) and any(same[k + 1 : k + 4])
                if self.usual(out) >= self.usual(token) - (1.5 if between else 0.2):
                    now, same[k] = out, True
            parts += [text[at:start], now]
            at = start + len(token)
        return "".join(parts) + text[at:], names


    def unexplained(self, text: str) -> list[str]:
        """Odd words of ``text`` that nothing learned so far repairs, long enough to tell."""
        words = set(TOKEN.findall(text))
        words = {p for t in words for p in (_BETWEEN.findall(t) if _mixed(t) else [t])}
        return [t for t in sorted(words) if sum(c > "\x7f" for c in t) >= ODD_LETTERS and not self.repaired(t) and self.odd(t)]

    def invented(self, token: str) -> str | None:
        """The transformation, of all pairs of codes whose reader is known to misread, that makes an odd word most usual."""
        readers = sorted({r for r, _ in self.ranked} | {"cp1252", "latin-1"})
        before, best = self.usual(token), None
        for r in readers:
            for w in CODES:
                out = undo(token, r, w) if (r, w) not in self.ranked and r != w else None
                if out and (gain := self.usual(out) - before) >= GAIN_WEST and (best is None or gain > best[0]):
                    best = (gain, f"{w}>{r}")
        return best and best[1]


_MODELS: dict[int, Model] = {}


def _model(shared) -> Model:
    """The model of a broadcast, made once a worker."""
    if shared.id not in _MODELS:
        _MODELS.clear()
        _MODELS[shared.id] = Model(*shared.value)
    return _MODELS[shared.id]


class _Shared:
    """What a model is made of, on all executors."""

    def __init__(self, spark, counts: dict[str, int], total: int, learned: dict[str, int]):
        self.cast = spark.sparkContext.broadcast((counts, total, learned))
        self.id = self.cast._jbroadcast.id()  # no other broadcast of the session has it

    @property
    def value(self):
        return self.cast.value


def aligned(text: str, fixes: list[dict]) -> tuple[str, Counter]:
    """The text with the words its twin proves to be garbled as the twin has them, and what was undone how often."""
    names: Counter = Counter()
    by_slot = {x["slot"]: x for x in sorted(fixes, key=lambda x: (x["slot"], x["name"], x["clean"]), reverse=True)}
    if not by_slot:
        return text, names
    parts = re.split(f"({BLANKS})", text)
    for slot, fix in by_slot.items():
        names[fix["name"]] += len(parts[2 * slot])
        parts[2 * slot] = fix["clean"]
    return "".join(parts), names


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        tokens: Counter = Counter()
        for text, weight in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if weight == 1:
                tokens.update(TOKEN.findall(text))
            else:
                for token in TOKEN.findall(text):
                    tokens[token] += weight
        counts: Counter = Counter()
        for token, n in tokens.items():
            plain = one_form(token)
            # a look-alike spelling is known by its plain form
            for pair in pairs_of(token) + (pairs_of(plain) if plain != token else []):
                counts[pair] += n
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["pair", "n"])


def _undone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (k, slot, token): what every token that strict UTF-8 takes was, with the readers that show so."""
    for batch in batches:
        out: tuple[list, ...] = ([], [], [], [], [])
        for k, slot, token in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            by: dict[str, list[str]] = {}
            for r in READERS:
                once = undo(token, r, "utf-8", controls=True)
                for clean in (once, once and undo(once, r, "utf-8")):  # text may have been garbled twice
                    if clean and not _CONTROL.search(clean):
                        by.setdefault(clean, []).append(f"utf-8>{r}")
            for clean, names in by.items():
                for column, value in zip(out, (k, slot, token, clean, names), strict=True):
                    column.append(value)
        kinds = (pa.int64(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.string()))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=["k", "slot", "token", "clean", "names"])


def distinct_texts(records: DataFrame) -> DataFrame:
    """(text, copies, th) of every different text with a character above ASCII, and its hash. Copies meet before the shuffle,
    so a text that a third of all rows share is no hot key."""
    own = records.select("text").where(F.col("text").rlike(r"[^\x00-\x7f]"))
    return own.groupBy("text").agg(F.count("*").alias("copies")).withColumn("th", F.md5("text"))


def slots_of(texts: DataFrame) -> DataFrame:
    """(k, th, slot, token): the words with a character above ASCII of the texts (text, th) that share what is left without
    such characters with another text; ``slot`` numbers the words between blanks."""
    keyed = texts.select("th", "text", F.regexp_replace("text", RUN, "").alias("skeleton")).where(F.length("skeleton") >= LEAST_SKELETON)
    keyed = keyed.select(F.xxhash64("skeleton").alias("k"), "th", "text")
    twins = keyed.groupBy("k").agg(F.min("th").alias("a"), F.max("th").alias("b")).where("a <> b").select("k")
    each = keyed.join(twins, "k", "left_semi").select("k", "th", F.posexplode(F.split("text", BLANKS)).alias("slot", "token"))
    return each.where(F.col("token").rlike(r"[^\x00-\x7f]"))


def proven(words: DataFrame) -> DataFrame:
    """(k, slot, token, clean, names): words that strict UTF-8 shows to be another word of the same slot, read wrongly.
    ``words`` (k, slot, token) are joined with what they may have been, so a slot with any number of wordings is no pair of all."""
    undone = words.mapInArrow(_undone, "k long, slot int, token string, clean string, names array<string>")
    return undone.join(words.withColumnRenamed("token", "clean"), ["k", "slot", "clean"]).select("k", "slot", "token", "clean", "names")


def _signatures(rows: DataFrame) -> list[tuple[list[str], int]]:
    """(names, number of different pairs) of explained pairs (clean, token, names). Codes agree on few sets of characters, so the
    sets of names are some hundreds, whatever the number of pairs."""
    return [(r[0], r[1]) for r in rows.select("clean", "token", "names").distinct().groupBy("names").count().collect()]


def _aligned_pairs(words: DataFrame, shared: _Shared) -> DataFrame:
    """(clean, token, names): each word of a slot beside the slot's most usual one of each script, where a change of codes explains the pair."""

    def rated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        usual = _model(shared).usual
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([usual(t) for t in batch.column(2).to_pylist()], pa.float64())], names=["k", "slot", "token", "usual"])

    def explained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, ...] = ([], [], [])
            for clean, token in zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True):
                if names := explain(clean, token):
                    for column, value in zip(out, (clean, token, names), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.string(), pa.string(), pa.list_(pa.string())), strict=True)], names=["clean", "token", "names"])

    each = words.mapInArrow(rated, "k long, slot int, token string, usual double")
    first = F.ascii(F.regexp_extract("token", r"[^\x00-\x7f]", 0))
    script = F.when(first < 0x2E80, F.shiftright(first, 7)).otherwise(-1)  # texts of several scripts may meet by their blanks alone
    top = each.groupBy("k", "slot", script.alias("script")).agg(F.max(F.struct("usual", "token")).alias("top"))
    pairs = each.join(top.select("k", "slot", F.col("top.usual").alias("best"), F.col("top.token").alias("clean")), ["k", "slot"]).where((F.col("token") != F.col("clean")) & (F.col("best") - F.col("usual") >= GAIN))
    return pairs.select("clean", "token").distinct().mapInArrow(explained, "clean string, token string, names array<string>")


class Learned:
    """What the distinct texts (text, copies, th) teach: transformations with their support, the model, and the twins' proofs."""

    def __init__(self, texts: DataFrame):
        spark = texts.sparkSession
        slots = cut(slots_of(texts))
        words = cut(slots.select("k", "slot", "token").distinct())
        sure = cut(proven(words))
        utf8 = _signatures(sure)
        named = F.element_at("names", 1)
        fixes = slots.join(sure, ["k", "slot", "token"]).groupBy("th").agg(F.collect_set(F.struct("slot", "clean", named.alias("name"))).alias("fixes"))
        self.fixes = cut(fixes)
        # copies under other ids say nothing more, and a garbled text doesn't say what is usual
        weight = F.least("copies", F.lit(max(1, FEW_TEXTS // max(1, texts.count()))))
        taught = texts.join(self.fixes, "th", "left_anti") if utf8 else texts
        counts = cut(taught.select("text", weight).mapInArrow(_counted, "pair string, n long").groupBy("pair").agg(F.sum("n").alias("n")))
        total = counts.agg(F.sum("n")).first()[0] or 0
        rows = counts.where(F.col("n") > max(1, int(LEAST_SHARE * total))).toArrow().to_pydict()
        self.counts, self.total = dict(zip(rows["pair"], rows["n"])), total
        bare = _Shared(spark, self.counts, self.total, {})
        unproven = words.join(sure, ["k", "slot", "token"], "left_anti")
        self.support = cover(utf8 + _signatures(_aligned_pairs(unproven, bare)), LEAST_SUPPORT)
        self.shared = _Shared(spark, self.counts, self.total, self.support)

    def more(self, odd: DataFrame) -> dict[str, int]:
        """Transformations that ``odd`` words (token) teach where twins can't meet."""
        shared = self.shared

        def tried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            invented = _model(shared).invented
            for batch in batches:
                counts = Counter(filter(None, map(invented, batch.column(0).to_pylist())))
                yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["name", "n"])

        found = odd.select("token").distinct().mapInArrow(tried, "name string, n long").groupBy("name").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_ODD)
        return {r[0]: r[1] for r in found.collect()}


def learned(records: DataFrame) -> DataFrame:
    """(transformation, support) inferred from near-twins among the distinct texts of ``records`` (text)."""
    support = Learned(cut(distinct_texts(records))).support
    return records.sparkSession.createDataFrame(sorted(support.items()), "transformation string, support long")


_FOUND = "th string, transformation string, restored string, odd array<string>"


def _repair(texts: DataFrame, shared: _Shared) -> DataFrame:
    """(th, transformation, restored, odd) of the texts (th, text, fixes) that are garbled or hold odd words nothing explains."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(shared)
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [])
            for th, text, fixes in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                now, proved = aligned(text, fixes or [])
                now, names = model.restore(now)
                names += proved
                odd = [] if names else model.unexplained(text)
                if names or odd or "\ufffd" in text or _CONTROL.search(text):
                    for column, value in zip(out, (th, names.most_common(1)[0][0] if names else None, now, odd), strict=True):
                        column.append(value)
            kinds = (pa.string(), pa.string(), pa.string(), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=["th", "transformation", "restored", "odd"])

    return texts.mapInArrow(find, _FOUND)


def garbled_texts(texts: DataFrame) -> DataFrame:
    """(th, transformation, restored) of the distinct texts (text, copies, th) that hold wrongly decoded text."""
    known = Learned(texts)
    asked = texts.select("th", "text").join(known.fixes, "th", "left")
    found = cut(_repair(asked, known.shared))
    more = known.more(found.select(F.explode("odd").alias("token")))
    if more:
        again = found.where(F.size("odd") > 0).select("th", F.col("restored").alias("text"), F.lit(None).cast("array<struct<slot:int,clean:string,name:string>>").alias("fixes"))
        found = found.where(F.size("odd") == 0).unionByName(_repair(again, _Shared(texts.sparkSession, known.counts, known.total, known.support | more)))
    lost = F.col("restored").contains("\ufffd") | F.col("restored").rlike(r"[\x80-\x84\x86-\x9f]")
    return found.where(F.col("transformation").isNotNull() | lost).select("th", "transformation", "restored")


def restored(records: DataFrame) -> DataFrame:
    """(kind, key, transformation, restored) of every record (kind, key, text) that holds wrongly decoded text.

    ``transformation`` is null where nothing could be restored. A key with several texts gives a row for each garbled one.
    Only distinct texts are shuffled and looked into; what is found goes back to the records by hash. Letter pairs go to all
    executors: at most 1 / ``LEAST_SHARE`` of them, as shares add up to one; so do the learned transformations, of which there
    are no more than pairs of codes. Neither grows with the documents."""
    found = garbled_texts(cut(distinct_texts(records)))
    own = records.where(F.col("text").rlike(r"[^\x00-\x7f]")).select("kind", "key", F.md5("text").alias("th"))
    return known_rows(own, found, "th").select("kind", "key", "transformation", "restored").distinct()
