"""Problem 4: one form for texts that print the same.

Method: a longest-match transducer over grapheme clusters. Its table is compiled once from rules (Unicode decompositions,
width, blanks, invisible characters, look-alike letters) and checked for conflicts: applying it twice changes nothing, and
no two characters that show in print (case, digits, raised digits, quotes, dashes) fall together. It then rewrites a text
in one pass over its clusters.

Null stays null, the empty text stays empty; texts of any length are rewritten whole."""

from __future__ import annotations

import unicodedata as ud
from functools import cache, lru_cache

import pandas as pd
import regex as re
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflow.session import SALTS, cut, known_rows

# Letters that print alike, each with the letter it comes out as.
LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "ԛ": "q", "ԝ": "w", "ѵ": "v", "ӏ": "l",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "І": "I", "Ј": "J", "Ѕ": "S", "Ԛ": "Q", "Ԝ": "W", "Ѵ": "V", "Ӏ": "I",
    "ο": "o", "ν": "v", "ϲ": "c", "ϳ": "j", "ι": "i", "ı": "i", "ɡ": "g", "ɑ": "a", "α": "a", "ρ": "p", "υ": "u", "κ": "k", "к": "k", "ɩ": "i",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J",
    "ک": "ك", "ی": "ي", "ہ": "ه",
    "օ": "o", "ս": "u", "հ": "h", "ց": "g", "Օ": "O", "Ս": "U", "Լ": "L",
}
BLANK = "               　\t"
#: Compatibility forms that print as their plain letters; all other compatibility forms (raised digits, fractions, signs) show in print.
PLAIN_FORMS = frozenset({"<wide>", "<narrow>", "<small>", "<isolated>", "<initial>", "<medial>", "<final>"})
LIGATURES = frozenset(range(0xFB00, 0xFB07)) | frozenset(range(0xFB13, 0xFB18)) | {0x132, 0x133, 0x13F, 0x140, 0x149, 0x1C4, 0x1C5, 0x1C6, 0x1C7, 0x1C8, 0x1C9, 0x1CA, 0x1CB, 0x1CC, 0x1F1, 0x1F2, 0x1F3}
SAME_SIGN = {0xB5: "μ", 0x2D0: "ː", 0x2010: "-", 0x2011: "-", 0x2024: ".", 0x2236: ":", 0x2215: "/", 0x2044: "/", 0x2212: "−", 0x2028: "\n", 0x2029: "\n", 0x85: "\n"}
JOINERS = "‌‍"

_PICTURE = re.compile(r"\p{Extended_Pictographic}|[\U0001F3FB-\U0001F3FF\U0001F1E6-\U0001F1FF]")
#: Virama signs: a joiner after one of them changes the printed form.
_VIRAMA = re.compile(r"[्্੍્୍்్್്්]")
# a cluster is worth a look when it holds a character outside plain ASCII; runs of plain text are passed over
_CLUSTER = re.compile(r"[^\x00-\x08\x0b-\x7f][\p{M}\p{Cf}︀-️]*|[\x20-\x7e][\p{M}\p{Cf}︀-️]+|\t|\r\n?")


def _invisible(c: str) -> bool:
    o = ord(c)
    return (ud.category(c) == "Cf" and not 0x600 <= o <= 0x605 and o not in (0x6DD, 0x70F, 0x8E2)) or o in (0x34F, 0x115F, 0x1160, 0x3164, 0xFFA0, 0x17B4, 0x17B5) or 0xFE00 <= o <= 0xFE0F or 0xE0100 <= o <= 0xE01EF or 0x180B <= o <= 0x180F


def _single(c: str) -> str:
    """What one character comes out as, before composition."""
    o = ord(c)
    if c in BLANK:
        return " "
    if o in SAME_SIGN:
        return SAME_SIGN[o]
    if _invisible(c):
        return ""
    kind = ud.decomposition(c).partition(" ")[0]
    if kind.startswith("<"):
        if kind in PLAIN_FORMS or o in LIGATURES or 0x2E80 <= o <= 0x2FDF or 0x3131 <= o <= 0x318E:
            c = ud.normalize("NFKC", c)
        else:
            return c
    return "".join(LOOKALIKES.get(x, x) for x in ud.normalize("NFD", c))


@cache
def table() -> dict[str, str]:
    """The compiled table of single characters; raises where two rules disagree."""
    made = {}
    for o in range(0x80, 0x30000):
        c = chr(o)
        if ud.category(c) in ("Cn", "Cs", "Co") or 0xAC00 <= o < 0xD7A4 or 0x4E00 <= o < 0xA000:
            continue
        to = ud.normalize("NFC", _single(c))
        if to != c:
            made[c] = to
    made["\t"], made["\r"], made["\r\n"] = " ", "\n", "\n"
    check(made)
    return made


def check(made: dict[str, str]) -> None:
    """Raises ValueError if the table isn't at rest after one pass, or joins characters that show a difference in print."""
    for c, to in made.items():
        again = ud.normalize("NFC", "".join(made.get(x, x) for x in to))
        if again != to:
            raise ValueError(f"{c!r} becomes {to!r}, then {again!r}")
        if len(to) == 1 and len(c) == 1 and (c.isupper() and to.islower() or c.islower() and to.isupper()):
            raise ValueError(f"{c!r} and {to!r} differ in case")
        if c in "²³¹⁰⁴⁵⁶⁷⁸⁹“”‘’«»„–—":
            raise ValueError(f"{c!r} shows in print")


@cache
def transducer() -> tuple[dict, int]:
    """The table compiled into a trie of single steps, each node (next nodes, output or None), over decomposed clusters: every
    precomposed letter stands in it decomposed as well, so that one walk takes the longest sequence the table knows."""
    root: dict = {}
    most = 1
    for c, to in table().items():
        for spelling in {c, ud.normalize("NFD", c)}:
            node = root
            for x in spelling:
                node = node.setdefault(x, {})
            node[""] = to
            most = max(most, len(spelling))
    return root, most


def transduced(cluster: str) -> str:
    """One cluster rewritten in one pass: at each place the longest sequence that the table knows, else the character itself."""
    root, _ = transducer()
    out, at = [], 0
    while at < len(cluster):
        node, end, made = root, at + 1, cluster[at]
        for k in range(at, len(cluster)):
            node = node.get(cluster[k])
            if node is None:
                break
            if "" in node:
                end, made = k + 1, node[""]
        out.append(made)
        at = end
    return "".join(out)


@lru_cache(maxsize=100_000)
def _cluster(s: str) -> str:
    out = transduced("".join(c for c in ud.normalize("NFD", s) if not _invisible(c)) if len(s) > 1 else s)
    # look-alikes under accents are found on the decomposed form
    return ud.normalize("NFC", "".join(LOOKALIKES.get(c, c) for c in ud.normalize("NFD", out)))


def one_form(text: str | None) -> str | None:
    """``text`` in the one form; equal results mean equal print."""
    if text is None or text.isascii() and "\t" not in text and "\r" not in text:
        return text
    made = table()

    def step(m: re.Match) -> str:
        s = m[0]
        if s[0] == "\r" or len(s) == 1:
            return made.get(s, s)
        if any(j in s for j in JOINERS):
            # between pictures, and after a virama, a joiner shows
            if "‍" in s and _PICTURE.match(s) and _PICTURE.match(text, pos=m.end()):
                return _PICTURE.match(s)[0] + "".join(c for c in s[1:] if not _invisible(c) or c == "‍")
            if _VIRAMA.search(s) and re.search(r"[्্੍્୍்్್്්][‌‍]\Z", s):
                return _cluster(s) + s[-1]
        return _cluster(s)

    out = _CLUSTER.sub(step, text)
    return out if ud.is_normalized("NFC", out) else _settled(out)


def _settled(s: str) -> str:
    return ud.normalize("NFC", "".join(LOOKALIKES.get(c, c) for c in ud.normalize("NFD", s)))


@F.pandas_udf(T.StringType())
def one_form_udf(texts: pd.Series) -> pd.Series:
    return texts.map(one_form, na_action="ignore")


def unified(df: DataFrame, column: str = "text", into: str = "one_form") -> DataFrame:
    """``df`` with ``column`` in the one form as ``into``; every row is kept, null stays null."""
    return df.withColumn(into, one_form_udf(F.col(column)))


def clip_key(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 32)


def equal_print_pairs(items: DataFrame, least: int) -> DataFrame:
    """(a, b), a < b, of all items (id, text) of at least ``least`` code points whose texts differ but print the same.

    Repeated ids count once. Pairs are made between different wordings only: wordings are paired first, one row each, then
    carry their ids, spread by salt so that a wording that a third of all rows share isn't one task. The number of result
    rows is the number of such pairs; none is capped."""
    long = items.where(F.length("text") >= least).select("id", "text")
    form = unified(long).select("id", F.xxhash64("one_form").alias("k1"), F.md5("one_form").alias("k2"), F.md5("text").alias("v"))
    kept = cut(form.distinct())
    wordings = kept.select("k1", "k2", "v").distinct()
    mixed = wordings.groupBy("k1", "k2").agg(F.count("*").alias("n")).where("n > 1").select("k1", "k2")
    wordings = cut(wordings.join(mixed, ["k1", "k2"]))
    # a form with many wordings is spread as well: each wording meets the others in SALTS parts
    part = F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")
    a = wordings.select("k1", "k2", F.col("v").alias("va"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("part"))
    b = wordings.select("k1", "k2", F.col("v").alias("vb"), part.alias("part"))
    pairs = a.join(b, ["k1", "k2", "part"]).where("va < vb").select("va", "vb")
    members = kept.join(mixed, ["k1", "k2"], "left_semi").select("id", "v")
    salts = 8
    left = members.select(F.col("v").alias("va"), F.col("id").alias("ia"), F.pmod(F.xxhash64("id"), F.lit(salts)).alias("sa"))
    right = members.select(F.col("v").alias("vb"), F.col("id").alias("ib"), F.pmod(F.xxhash64("id"), F.lit(salts)).alias("sb"))
    spread = pairs.withColumn("sa", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long")))).join(left, ["va", "sa"])
    spread = spread.select("vb", "ia", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("sb")).join(right, ["vb", "sb"])
    return spread.select(F.least("ia", "ib").alias("a"), F.greatest("ia", "ib").alias("b")).where("a < b").distinct()


def print_classes(items: DataFrame, least: int) -> DataFrame:
    """(id, class_id, wordings, links) of all items (id, text) of at least ``least`` code points that print the same as one with
    another text: one row an item instead of all pairs. ``class_id`` is the least id of those that print so, ``wordings`` how many
    texts they have, ``links`` how many items with another text the item is equal to. An id with several texts counts for the
    least of them."""
    long = items.where(F.length("text") >= least).groupBy("id").agg(F.min("text").alias("text"))
    form = cut(unified(long).select("id", F.xxhash64("one_form").alias("k1"), F.md5("one_form").alias("k2"), F.md5("text").alias("v")))
    # sums per wording come first, so a form that a third of all items share is a few rows
    wordings = form.groupBy("k1", "k2", "v").agg(F.count("*").alias("n"), F.min("id").alias("least_id"))
    classes = wordings.groupBy("k1", "k2").agg(F.min("least_id").alias("class_id"), F.count("*").alias("wordings"), F.sum("n").alias("all")).where("wordings > 1")
    told = wordings.join(classes, ["k1", "k2"]).select("v", "k1", "k2", "class_id", "wordings", (F.col("all") - F.col("n")).alias("links"))
    return known_rows(form, told, "k1", "k2", "v").select("id", "class_id", "wordings", "links")
