"""Problem 5: oversized texts cut at natural boundaries.

Method: lexical-cohesion segmentation. Blocks of words slide over the text; where the words before and after a gap differ
most, the topic turns. Within each window of allowed sizes the gap with the deepest valley is cut; a window without a
sentence end falls back to clause marks, then blanks, then grapheme boundaries. Each next piece begins early enough to
share the asked overlap. Sizes are in code points, UTF-8 bytes or UTF-16 units.

Null text, limit or unit gives no row; a text within its limit gives none; a limit below one character cuts by code point.
The overlap is lowered to half the limit where it is larger."""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex as re
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.llm.sentences import OPEN_LOWER, TITLES, scan

BLOCK_WORDS = 20
LEAST_FILL = 0.5
WORD = re.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}]|[\p{L}\p{M}\p{N}]+")
CLAUSE = re.compile(r"[,;:，、；：،؛·](?=\s|[^\x00-\x7f])[”»’」』)]*\s*|\s[—–]\s|[—–](?=\s)\s*")
BLANK = re.compile(r"\s+")
GRAPHEME = re.compile(r"\X")
LOWER_TITLES = frozenset(t.lower() for t in TITLES)


def size_of(text: Column, unit: Column) -> Column:
    """Size of ``text`` in ``unit``; null for an unknown unit."""
    return F.when(unit == "chars", F.length(text)).when(unit == "bytes", F.octet_length(text)).when(unit == "utf16", (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int"))


def _widths(text: str, unit: str) -> np.ndarray:
    """Size of the text before each code point, and of the whole."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    if unit == "bytes":
        each = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
    elif unit == "utf16":
        each = 1 + (points >= 0x10000)
    else:
        each = np.ones(len(points), dtype=np.int64)
    return np.concatenate([[0], np.cumsum(each)])


def valleys(text: str, gaps: list[int]) -> dict[int, float]:
    """Depth of the cohesion valley at each gap: how far the similarity of the blocks around it lies below the peaks on both sides."""
    words = [(m.start(), m[0].casefold()) for m in WORD.finditer(text)]
    starts = [s for s, _ in words]
    scores = []
    for g in gaps:
        i = bisect_left(starts, g)
        a, b = Counter(w for _, w in words[max(0, i - BLOCK_WORDS) : i]), Counter(w for _, w in words[i : i + BLOCK_WORDS])
        norm = math.sqrt(sum(n * n for n in a.values()) * sum(n * n for n in b.values()))
        scores.append(sum(n * b[w] for w, n in a.items()) / norm if norm else 0.0)
    depth = {}
    for k, s in enumerate(scores):
        left, right = s, s
        for j in range(k - 1, -1, -1):
            if scores[j] < left:
                break
            left = scores[j]
        for j in range(k + 1, len(scores)):
            if scores[j] < right:
                break
            right = scores[j]
        depth[gaps[k]] = left + right - 2 * s
    return depth


def cut(text: str, unit: str, limit: int, overlap: int) -> list[tuple[int, int, str]]:
    """Pieces as (start, end, kind of the cut at the end), in code points; each within ``limit`` and sharing ``overlap`` with the next."""
    at = _widths(text, unit)
    size = len(text)
    if at[-1] <= limit:
        return [(0, size, "end")]
    overlap = min(overlap, limit // 2)
    ends = []
    for end, state, word, _ in scan(text):
        if state == OPEN_LOWER or state and (word.lower() in LOWER_TITLES or len(word) < 3):
            continue
        m = BLANK.match(text, end)
        ends.append(m.end() if m else end)
    ends = [e for e in ends if 0 < e < size]
    depth = valleys(text, ends)
    clauses = [m.end() for m in CLAUSE.finditer(text)]
    blanks = [m.end() for m in BLANK.finditer(text)]
    graphemes: list[int] | None = None
    pieces, start = [], 0
    while at[-1] - at[start] > limit:
        most = int(np.searchsorted(at, at[start] + limit, side="right")) - 1
        shared = overlap if pieces else 0
        least = int(np.searchsorted(at, at[start] + max(limit * LEAST_FILL, shared + 1), side="left"))
        choice, kind = None, ""
        for kind, stops in (("sentence", ends), ("clause", clauses), ("blank", blanks)):
            inside = stops[bisect_left(stops, least) : bisect_right(stops, most)]
            if inside:
                choice = max(inside, key=lambda e: (depth[e], e)) if kind == "sentence" else inside[-1]
                break
        if choice is None:
            kind = "grapheme"
            graphemes = graphemes or [m.end() for m in GRAPHEME.finditer(text)]
            k = bisect_right(graphemes, most) - 1
            choice = graphemes[k] if k >= 0 and at[graphemes[k]] - at[start] > shared else most
            if choice <= start:
                choice = start + 1
        pieces.append((start, choice, kind))
        back = int(np.searchsorted(at, at[choice] - overlap, side="left"))
        if overlap and back > start:
            if not text[back : back + 1].isascii() or not text[back - 1 : back].isascii():
                graphemes = graphemes or [m.end() for m in GRAPHEME.finditer(text)]
                k = bisect_left(graphemes, back)
                back = min(graphemes[k], choice) if k < len(graphemes) else choice
            start = back
        else:
            start = choice
    pieces.append((start, size, "end"))
    return pieces


SCHEMA = "item_kind string, item_id long, piece_idx int, start_char int, end_char int, cut_kind string, piece string"


def _cut_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for kind, item, text, unit, limit, overlap in pdf.itertuples(index=False):
            rows += [(kind, item, i, a, b, how, text[a:b]) for i, (a, b, how) in enumerate(cut(text, unit, int(limit), int(overlap)))]
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])


def oversized_pieces(items: DataFrame) -> DataFrame:
    """The ordered pieces of every item whose text exceeds its limit.

    ``items``: item_kind, item_id, text, size_unit, max_size, overlap_size; further columns are ignored. Repeated rows give
    their pieces once. Rows within the limit never reach Python."""
    own = items.select("item_kind", "item_id", "text", "size_unit", "max_size", F.coalesce("overlap_size", F.lit(0)).alias("overlap_size"))
    large = own.where((size_of(F.col("text"), F.col("size_unit")) > F.col("max_size")) & (F.col("max_size") > 0)).dropDuplicates(["item_kind", "item_id"])
    return large.mapInPandas(_cut_rows, SCHEMA)
