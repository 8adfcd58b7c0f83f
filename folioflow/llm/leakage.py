"""Problem 7: evaluation passages inside training texts.

Method: training suffix arrays. The corpus is cut into shards; in each, the suffixes of the word stream are sorted, and
every suffix of every test item is looked up by binary search, which gives its longest verbatim match and, from what
neighbours in the array share, all others with their places. The matches of one document and item are then put in order within one place of the document; a document that holds
at least half of an item's words so is affected and can be removed.

Words are compared without case, punctuation, blanks and look-alike spellings; Chinese and Japanese by character. Null and
empty texts hold nothing; empty items leak nowhere; repeated rows count once; texts are read whole."""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import regex as re
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.lookalikes import one_form

SHARE = 0.5
SEED = 5  # words a verbatim match must have to be looked up
SURE_SHARE = 0.55  # a share between the two needs one long verbatim match as well: stock phrases alone may add up to a half
LONG = 0.3
RUN = 3  # words a verbatim match must have to count
SHARD_WORDS = 400_000
BLOCK_ITEMS = 20_000  # items looked up in one pass; more are taken in further passes
WORD = re.compile(r"(?V1)[\p{Han}\p{Hiragana}\p{Katakana}]|[[\p{L}\p{M}\p{N}]--[\p{Han}\p{Hiragana}\p{Katakana}]]+")
_MARK = re.compile(r"[^\p{L}\p{M}\p{N}\s]+")
_NOTE = re.compile(r"\[\d{1,3}\]")
_TAG = re.compile(r"<[/a-zA-Z][^<>]{0,200}>")
_HYPHEN = re.compile(r"(?<=\p{Ll})[-‐]\n(?=\p{Ll})")


def words(text: str) -> list[str]:
    """Words in small letters. Notes and tags go; marks go without a blank, so that a text whose marks were taken away
    (``cétait``, ``729``) has the same words as the text that has them."""
    plain = _TAG.sub(" ", _NOTE.sub(" ", _HYPHEN.sub("", text)))
    return WORD.findall(_MARK.sub("", one_form(plain).casefold()))


class Items:
    """The test items as one stream of words, and its suffixes."""

    def __init__(self, items: list[tuple[int, str]]):
        self.ids, self.words = [], []
        self.vocabulary: dict[str, int] = {}
        stream, owner, place = [], [], []
        for item, text in items:
            own = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words(text)]
            if not own:
                continue
            k = len(self.ids)
            self.ids.append(item)
            self.words.append(own)
            stream += [*own, -1]
            owner += [k] * (len(own) + 1)
            place += range(len(own) + 1)
        self.stream, self.owner, self.place = (np.array(x, dtype=np.int64) for x in (stream, owner, place))
        self.sizes = np.array([len(w) for w in self.words], dtype=np.int64)
        self.levels: list[np.ndarray] = []
        ranks = self._ranked(self.stream, learn=True)
        # every different test suffix of at least SEED words: its words, the first place that has it, its rank, and all places
        raw, ends = self.stream.astype(">u4").tobytes(), np.nonzero(self.stream < 0)[0]
        tests: dict[bytes, list[int]] = {}
        for i in np.nonzero(ranks >= 0)[0].tolist():
            tests.setdefault(raw[4 * i : 4 * int(ends[np.searchsorted(ends, i)])], []).append(i)
        self.test_keys = list(tests)
        self.test_places = np.array([own[0] for own in tests.values()], dtype=np.int64)
        self.test_ranks = ranks[self.test_places]
        self.test_owners = np.array([i for own in tests.values() for i in own], dtype=np.int64)
        self.test_ends = np.cumsum([0, *map(len, tests.values())])

    def _ranked(self, stream: np.ndarray, learn: bool = False) -> np.ndarray:
        """Rank of each position's first ``SEED`` words among those of the items, in word order; -1 where the items don't have them."""
        size = len(self.vocabulary) + 1
        now = stream.copy()
        for d in range(1, SEED):
            then = np.full(len(stream), -1, dtype=np.int64)
            then[: len(stream) - d] = stream[d:]
            good = (now >= 0) & (then >= 0)
            key = now * size + then
            if learn:
                self.levels.append(np.unique(key[good]))
            level = self.levels[d - 1]
            if not len(level):
                return np.full(len(stream), -1, dtype=np.int64)
            at = np.minimum(np.searchsorted(level, key), len(level) - 1)
            now = np.where(good & (level[at] == key), at, -1)
        return now

    def _common(self, a: np.ndarray, x: np.ndarray, b: np.ndarray, y: np.ndarray, known: int) -> np.ndarray:
        """How many words the suffixes of ``a`` at places ``x`` share with those of ``b`` at ``y``, of which ``known`` are the same."""
        size, live = np.full(len(x), known, dtype=np.int64), np.arange(len(x))
        while len(live):
            i, j = x[live] + size[live], y[live] + size[live]
            inside = (i < len(a)) & (j < len(b))
            live, i, j = live[inside], i[inside], j[inside]
            live = live[(a[i] == b[j]) & (a[i] >= 0)]
            size[live] += 1
        return size

    def suffix_array(self, stream: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[bytes], np.ndarray]:
        """Places of the shard's suffixes in the order of their words, to their end or the longest item's length; the rank of
        their first words; the suffixes themselves; and how many words each shares with the one before it. A suffix whose first
        ``SEED`` words stand in no item can't match any and is left out."""
        ranks = self._ranked(stream)
        starts = np.nonzero(ranks >= 0)[0]
        stops = np.append(np.nonzero(stream < 0)[0], len(stream))
        ends = np.minimum(stops[np.searchsorted(stops, starts)], starts + int(self.sizes.max(initial=0)))
        raw = stream.astype(">u4").tobytes()
        keys = [raw[4 * a : 4 * b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        order = sorted(range(len(keys)), key=keys.__getitem__)
        places = starts[order]
        shared = np.zeros(len(places), dtype=np.int64)
        if len(places) > 1:
            shared[1:] = self._common(stream, places[:-1], stream, places[1:], 0)
        return places, ranks[places], [keys[k] for k in order], shared

    def matches(self, stream: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Longest verbatim matches of all test suffixes in one shard: (place in the shard, place in the items, words).

        Every different test suffix is looked up once by binary search, whichever items share it. Its longest match stands beside
        the place found; what the suffixes further off share with it is the least they share with one another on the way."""
        places, ranks, keys, shared = self.suffix_array(stream)
        none = np.zeros(0, dtype=np.int64)
        lo, hi = (np.searchsorted(ranks, self.test_ranks, side) for side in ("left", "right"))
        known = np.nonzero(hi > lo)[0]
        if not len(known):
            return none, none, none
        lo, hi, first = lo[known], hi[known], self.test_places[known]
        at = np.array([bisect_left(keys, self.test_keys[k], a, b) for k, a, b in zip(known.tolist(), lo.tolist(), hi.tolist(), strict=True)])
        beside = [self._common(stream, places[np.clip(x, lo, hi - 1)], self.stream, first, SEED) for x in (at - 1, at)]
        # each test suffix with all suffixes of the shard that begin with its first words
        count = hi - lo
        q = np.repeat(np.arange(len(known)), count)
        j = np.arange(len(q)) - np.repeat(np.cumsum(count) - count, count) + lo[q]
        below = j < at[q]
        size = np.where(below, beside[0][q], beside[1][q])
        start, end = np.where(below, j + 1, at[q] + 1), np.where(below, at[q] - 1, j)  # what lies between them in the array
        far = np.nonzero(start <= end)[0]
        size[far] = np.minimum(size[far], _least(shared, start[far], end[far]))
        # and with every item that has it
        owners = self.test_ends[known + 1] - self.test_ends[known]
        n = owners[q]
        s, size = np.repeat(places[j], n), np.repeat(size, n)
        t = self.test_owners[np.arange(len(s)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.test_ends[known][q], n)]
        # matches that go on to the left are part of a longer one
        left = (s > 0) & (t > 0)
        left[left] = (stream[s[left] - 1] == self.stream[t[left] - 1]) & (stream[s[left] - 1] >= 0)
        return s[~left], t[~left], size[~left]


def _least(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The least of ``values`` from each ``start`` to ``end``, both counted, by minima over runs of powers of two."""
    if not len(start):
        return start
    level = np.log2(end - start + 1).astype(np.int64)
    out, table = np.empty(len(start), dtype=np.int64), values
    for k in range(int(level.max()) + 1):
        own = np.nonzero(level == k)[0]
        out[own] = np.minimum(table[start[own]], table[end[own] - (1 << k) + 1])
        table = np.minimum(table[: -(1 << k)], table[1 << k :]) if len(table) > 1 << k else table
    return out


def in_order(item: list[int], doc: list[int]) -> int:
    """Most words of ``item`` that stand in ``doc`` in order, within one place, in verbatim runs of at least ``RUN`` words."""
    starts = defaultdict(list)
    for p in range(len(item) - RUN + 1):
        starts[tuple(item[p : p + RUN])].append(p)
    runs = []
    for q in range(len(doc) - RUN + 1):
        for p in starts.get(tuple(doc[q : q + RUN]), ()):
            if p and q and item[p - 1] == doc[q - 1]:
                continue
            k = RUN
            while p + k < len(item) and q + k < len(doc) and item[p + k] == doc[q + k]:
                k += 1
            runs.append((p, q, k))
    runs.sort()
    reach = int(1.4 * len(item)) + 12
    best: list[tuple[int, int]] = []  # words and first place of the best chain that ends with each run
    top = 0
    for i, (p, q, k) in enumerate(runs):
        score, first = k, q
        for j in range(i):
            pj, qj, kj = runs[j]
            cut = max(pj + kj - p, qj + kj - q, 0)  # what overlaps counts once
            if qj < q and pj < p and k - cut >= RUN and q + k - best[j][1] <= reach and best[j][0] + k - cut > score:
                score, first = best[j][0] + k - cut, best[j][1]
        best.append((score, first))
        top = max(top, score)
    return top


def _leaks(shard: list[tuple[int, list[int]]], items: Items) -> list[tuple[int, int, int, float]]:
    """(doc, item, longest match, share) of one shard."""
    offsets, stream = [], []
    for _, own in shard:
        offsets.append(len(stream))
        stream += own
        stream.append(-1)
    s, t, size = items.matches(np.array(stream, dtype=np.int64))
    if not len(s):
        return []
    doc = np.searchsorted(np.array(offsets), s, side="right") - 1
    item = items.owner[t]
    order = np.lexsort((s, item, doc))
    s, size, doc, item = s[order], size[order], doc[order], item[order]
    pair = doc * len(items.ids) + item
    need = items.sizes[item]
    total = np.concatenate([[0], np.cumsum(size)])
    # words matched from each match on within one place; pairs that can't reach the share are left out
    span = np.int64(len(stream)) + 1
    key = pair * span + s
    upto = np.searchsorted(key, np.minimum(key + (1.4 * need + 12).astype(np.int64), pair * span + span - 1), side="right")
    near = total[upto] - total[:-1]
    hit = near >= 0.6 * SHARE * need
    out = []
    for pr in np.unique(pair[hit]):
        a, b = np.searchsorted(pair, pr), np.searchsorted(pair, pr, side="right")
        d, k = int(pr // len(items.ids)), int(pr % len(items.ids))
        wanted = hit[a:b]
        reach = int(1.4 * items.sizes[k]) + 12
        base, own = offsets[d], shard[d][1]
        best, seen = 0, -1
        for at in s[a:b][wanted]:
            lo = int(at) - base
            if lo <= seen:
                continue
            window = own[max(0, lo - reach // 2) : lo + reach + reach // 2]
            seen = lo + reach // 2
            best = max(best, in_order(items.words[k], window))
        longest = int(size[a:b].max())
        if best >= SURE_SHARE * items.sizes[k] or best >= SHARE * items.sizes[k] and longest >= LONG * items.sizes[k]:
            out.append((shard[d][0], items.ids[k], longest, best / float(items.sizes[k])))
    return out


_ITEMS: dict[object, Items] = {}


def _items(shared) -> Items:
    """The items of a broadcast, made ready once a worker."""
    if shared not in _ITEMS:
        _ITEMS.clear()
        _ITEMS[shared] = Items(shared.value)
    return _ITEMS[shared]


SCHEMA = "doc_id long, item_id long, longest_match int, share double"


def leaks(documents: DataFrame, eval_items: DataFrame) -> DataFrame:
    """(doc_id, item_id, longest_match, share) of every document (doc_id, text) that holds at least half of an item (item_id, text).

    Documents are never shuffled: each task shards what it reads. Items travel to the tasks in blocks of ``BLOCK_ITEMS``,
    one pass each, so their size is bounded whatever the table holds."""
    spark = documents.sparkSession
    known = eval_items.select("item_id", "text").where(F.col("text").isNotNull() & F.col("item_id").isNotNull()).dropDuplicates(["item_id"])
    blocks = -(-known.count() // BLOCK_ITEMS) or 1
    texts = documents.select("doc_id", "text").where(F.col("text").isNotNull() & F.col("doc_id").isNotNull())

    def one(block: int) -> DataFrame:
        rows = known.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).collect()
        shared = spark.sparkContext.broadcast([(r[0], r[1]) for r in sorted(rows)])

        def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items = _items(shared)
            of = items.vocabulary.get

            def found(shard: list[tuple[int, list[int]]]) -> pa.RecordBatch:
                columns = list(zip(*_leaks(shard, items))) or [()] * 4
                return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.float64()))], names=["doc_id", "item_id", "longest_match", "share"])

            shard, held = [], 0
            for batch in batches:
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    own = [of(w, -1) for w in words(text)]
                    if not items.ids:
                        continue
                    shard.append((doc, own))
                    held += len(own)
                    if held >= SHARD_WORDS:
                        yield found(shard)
                        shard, held = [], 0
            if shard:
                yield found(shard)

        return texts.mapInArrow(look, SCHEMA)

    every = reduce(DataFrame.unionByName, map(one, range(blocks)))
    return every.groupBy("doc_id", "item_id").agg(F.max("longest_match").alias("longest_match"), F.max("share").alias("share"))


def without_leaks(documents: DataFrame, found: DataFrame) -> DataFrame:
    """``documents`` without the affected ones."""
    return documents.join(found.select("doc_id").distinct(), "doc_id", "left_anti")
