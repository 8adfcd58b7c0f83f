"""Column expressions on text: sentence pieces, clips, heading keys, labels, slugs, escapes. All run inside the JVM.

Null in, null out; the empty text gives an empty array or the empty string, as stated for each."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_CHARS = 125
MAX_TITLE_BYTES = 140
LABEL_MAX_CHARS = 80
MARK = "\u0001"

# Sentence ends, closing marks, number words and labels.
CLOSERS = "\"')\\]”’"
SENTENCE_END = rf"(?U)(?:[!?;:]|(?<!\b[A-Z])\.)[{CLOSERS}]*(?=\s|\z)"
NUMBER_WORDS = "one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|thirteen|fourteen|fifteen|sixteen|seventeen|eighteen|nineteen|twenty|thirty|forty|fifty"
LABEL = rf"(?i)^(?:chapter|part|book)[\s ]+(?:\d{{1,3}}|[ivxlcdm]{{1,7}}|(?:{NUMBER_WORDS})(?:[- ](?:{NUMBER_WORDS}))?)(?:[^a-z0-9]|$)"
BARE_NUMBER = r"(?i)^(?:\d{1,3}|[ivxlcdm]{1,7})\s*[.:)]?$"
NOTE_MARKER = r"(?U)(?<!\s)\s*\[\d{1,3}\]"


def strip(text: Column) -> Column:
    """``text`` without white space at its ends, in the Unicode sense."""
    return F.regexp_replace(text, r"(?U)^\s+|(?<!\s)\s+\z", "")


def collapse(text: Column) -> Column:
    """Bare note markers out, every stretch of white space one blank, none at the ends."""
    unmarked = F.regexp_replace(F.regexp_replace(text, " ", " "), NOTE_MARKER, "")
    return strip(F.regexp_replace(unmarked, r"(?U)\s+", " "))


def speakable(text: Column) -> Column:
    return text.rlike(r"[\p{L}\p{N}]")


def sentences(text: Column) -> Column:
    """Array of the sentences of ``text``: cut after each end mark with its closers, stripped, none empty."""
    parts = F.split(F.regexp_replace(strip(text), SENTENCE_END, f"$0{MARK}"), MARK)
    return F.filter(F.transform(parts, strip), lambda s: s != "")


def cut_long(piece: Column, most: int = MAX_CHARS) -> Column:
    """Array of parts of ``piece``, each of at most ``most`` characters: after the last comma or semicolon, else at the last
    blank, else mid-word. A short piece is one part; only long ones enter the fold."""

    def after(acc: Column, _: Column) -> Column:
        rest = acc["rest"]
        head = F.substring(rest, 1, most)
        comma = F.length(F.regexp_extract(head, r"(?s)^(.*[,;])", 1))
        blank = F.length(F.regexp_extract(F.substring(rest, 1, most + 1), r"(?s)^(.*) ", 1))
        at = F.when(comma > 0, comma).when(blank > 0, blank).otherwise(F.lit(most))
        done = F.length(rest) <= most
        part = F.when(rest == "", F.array().cast("array<string>")).when(done, F.array(rest)).otherwise(F.array(strip(F.substring(rest, F.lit(1), at))))
        left = F.when(done, F.lit("")).otherwise(strip(F.substring(rest, at + 1, F.length(rest))))
        return F.struct(F.concat(acc["out"], part).alias("out"), left.alias("rest"))

    start = F.struct(F.array().cast("array<string>").alias("out"), piece.alias("rest"))
    folded = F.aggregate(F.sequence(F.lit(0), F.length(piece)), start, lambda acc, i: F.when(acc["rest"] == "", acc).otherwise(after(acc, i)))
    return F.when(F.length(piece) <= most, F.array(piece)).otherwise(folded["out"])


def fill(pieces: Column, most: int = MAX_CHARS) -> Column:
    """Array of clips: a piece joins the clip before it while both fit into ``most`` characters."""

    def step(acc: Column, piece: Column) -> Column:
        fits = (F.length(acc["last"]) + 1 + F.length(piece) <= most) & (acc["last"] != "")
        closed = F.when(fits | (acc["last"] == ""), acc["closed"]).otherwise(F.concat(acc["closed"], F.array(acc["last"])))
        return F.struct(closed.alias("closed"), F.when(fits, F.concat(acc["last"], F.lit(" "), piece)).otherwise(piece).alias("last"))

    start = F.struct(F.array().cast("array<string>").alias("closed"), F.lit("").alias("last"))
    return F.aggregate(pieces, start, step, lambda acc: F.when(acc["last"] == "", acc["closed"]).otherwise(F.concat(acc["closed"], F.array(acc["last"]))))


def clips(text: Column, max_chars: int = MAX_CHARS, fill_chars: int = MAX_CHARS) -> Column:
    """Array of the utterances of a paragraph: sentences, long ones cut, those without letter or digit dropped, short ones joined."""
    parts = F.flatten(F.transform(sentences(text), lambda s: cut_long(s, max_chars)))
    return fill(F.filter(parts, speakable), min(max_chars, fill_chars))


def heading_key(text: Column) -> Column:
    """Key under which headings are compared: lower case, no punctuation, single blanks. ß counts as ss."""
    low = F.regexp_replace(F.lower(text), "ß", "ss")
    return strip(F.regexp_replace(F.regexp_replace(low, r"(?U)[^\w\s]", ""), r"(?U)\s+", " "))


def is_section_label(title: Column) -> Column:
    return title.rlike(BARE_NUMBER) | title.rlike(r"\.\.\.$")


def is_label(text: Column) -> Column:
    """Whether a short body paragraph reads as a chapter label."""
    return (F.length(text) <= LABEL_MAX_CHARS) & text.rlike(LABEL)


def slug(text: Column, empty: str = "book") -> Column:
    made = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(made, F.lit("")), F.lit(empty))


def meta_escape(text: Column) -> Column:
    """A backslash before each sign with a meaning in the chapter metadata file."""
    return F.regexp_replace(text, r"([=;#\\\n])", r"\\$1")


def shortened(text: Column, width: int) -> Column:
    return F.when(F.length(text) > width, F.concat(F.substring(text, 1, width - 1), F.lit("…"))).otherwise(text)


def truncated(text: Column, most: int = MAX_TITLE_BYTES) -> Column:
    """``text`` within ``most`` bytes of UTF-8, cut at a word, with an ellipsis where it was cut."""
    # code points whose end lies within the room, found on the running byte size
    room = most - 3
    points = F.split(text, "")
    sizes = F.aggregate(
        points,
        F.struct(F.lit(0).alias("bytes"), F.lit(0).alias("n")),
        lambda acc, c: F.struct((acc["bytes"] + F.octet_length(c)).alias("bytes"), F.when(acc["bytes"] + F.octet_length(c) <= room, acc["n"] + 1).otherwise(acc["n"]).alias("n")),
        lambda acc: acc["n"],
    )
    cut = F.substring(text, F.lit(1), sizes)
    head = F.regexp_replace(F.when(F.instr(cut, " ") > 0, F.regexp_extract(cut, r"(?s)^(.*) ", 1)).otherwise(cut), r"[ ,;:]+$", "")
    return F.when(F.octet_length(text) <= most, text).otherwise(F.concat(head, F.lit("…")))


def clip_key(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 32)


def fingerprint(*parts: Column) -> Column:
    """Digest over the parts, each ended by NUL."""
    return F.sha2(F.concat(*[F.concat(p, F.lit("\0")) for p in parts]), 256)
