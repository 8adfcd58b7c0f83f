"""Problem 6: texts packed into containers of fixed capacity.

Method: vector bin packing by the dot-product heuristic. Every text has three demands: tokens, one segment, and tokens that
bear loss. A container is filled with the item whose demands, weighted by how scarce each is over all items, point most in
the direction of what the container has left. Texts are spread over groups of about ``GROUP`` by a hash of their id, each
packed on its own, so that no task grows with the corpus.

Null text gives no row; an empty text is an item of no tokens; repeated ids count once; a text above the capacity is cut
into whole containers and one rest, which is packed like any other; a kind without a positive capacity gets nothing."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex as re
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.session import cut

TOKENIZER = os.environ.get("FOLIOFLOW_TOKENIZER", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")  # a path all executors have
GROUP = 4096
TOKENS_A_SEGMENT = 16  # a container takes one segment for so many tokens of its capacity, at least MIN_SEGMENTS
MIN_SEGMENTS = 4
LOSS_SHARE = 1.0  # share of the capacity that loss-bearing tokens may fill; below 1 it binds, and space is left for prompts
#: Fixed value: the public pattern the vocabulary was made with.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_ANSWER = re.compile(r"\A\s*Q:.*?\n(?=A:|->)", re.DOTALL)


@cache
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def sized(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, tokens, loss_tokens) of every document (doc_id, text). In a question with its answer only the answer bears loss."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(tokenizer).encode_ordinary
        for batch in batches:
            tokens, loss = [], []
            for text in batch.column(1).to_pylist():
                n = len(encode(text))
                prompt = _ANSWER.match(text)
                tokens.append(n)
                loss.append(max(0, n - len(encode(prompt[0]))) if prompt else n)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tokens, pa.int32()), pa.array(loss, pa.int32())], names=["doc_id", "tokens", "loss_tokens"])

    own = documents.select("doc_id", "text").where(F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    return own.mapInArrow(count, "doc_id long, tokens int, loss_tokens int").dropDuplicates(["doc_id"])


def packed(demands: np.ndarray, limits: np.ndarray) -> list[list[int]]:
    """Containers as lists of item rows. ``demands`` has a row per item, none of which exceeds ``limits``.

    Items with the same demands are alike to the heuristic, so it looks at each such class once, however many items it has."""
    if not len(demands):
        return []
    kinds, of, counts = np.unique(demands, axis=0, return_inverse=True, return_counts=True)
    members = [list(x) for x in np.split(np.argsort(of.ravel(), kind="stable")[::-1], np.cumsum(counts[::-1])[:-1])][::-1]
    size = kinds / limits
    scarce = (size * counts[:, None]).sum(axis=0) / counts.sum()
    containers = []
    while len(size):
        left, own = np.ones(len(limits)), []
        alive = np.arange(len(size))
        while len(alive):
            alive = alive[(size[alive] <= left + 1e-12).all(axis=1)]
            if not len(alive):
                break
            k = int(alive[(size[alive] @ (scarce * left)).argmax()])
            own.append(int(members[k].pop()))
            left = left - size[k]
            if not members[k]:
                alive = alive[alive != k]
        containers.append(own)
        there = np.array([bool(m) for m in members])
        if not there.all():
            size, members = size[there], [m for m in members if m]
    return containers


SCHEMA = "container_kind string, container_id long, position int, doc_id long, start_token int, end_token int, loss_tokens int"


def _pack(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["doc_id", "start_token"], kind="stable", ignore_index=True)
    first = pdf.iloc[0]
    capacity, separator = int(first["capacity_tokens"]), int(first["separator_tokens"])
    tokens = pdf["end_token"].to_numpy() - pdf["start_token"].to_numpy()
    # the first item needs no separator: with one more of them in the capacity, every item brings its own
    demands = np.column_stack([tokens + separator, np.ones(len(pdf)), pdf["loss_tokens"].to_numpy()]).astype(float)
    limits = np.array([capacity + separator, first["segments"], first["loss_most"]], dtype=float)
    made = packed(demands, limits)
    order = [i for own in made for i in own]
    out = pdf.loc[order, ["container_kind", "doc_id", "start_token", "end_token", "loss_tokens"]].reset_index(drop=True)
    out["container_id"] = np.repeat(np.arange(len(made)), [len(x) for x in made]) + int(first["part"]) * (1 << 20)
    out["position"] = [k for own in made for k in range(len(own))]
    return out[[c.split()[0] for c in SCHEMA.split(", ")]]


def limited(containers: DataFrame, tokens_a_segment: int, loss_share: float) -> DataFrame:
    """(container_kind, capacity_tokens, separator_tokens, segments, loss_most): the simultaneous limits of each usable kind."""
    kinds = containers.where("capacity_tokens > 0 and container_kind is not null").dropDuplicates(["container_kind"])
    segments = F.greatest(F.lit(MIN_SEGMENTS), F.floor(F.col("capacity_tokens") / tokens_a_segment)).cast("int")
    return kinds.select("container_kind", "capacity_tokens", F.coalesce("separator_tokens", F.lit(0)).alias("separator_tokens"), segments.alias("segments"), F.greatest(F.lit(1), F.floor(F.col("capacity_tokens") * loss_share)).cast("int").alias("loss_most"))


def assigned(documents: DataFrame, containers: DataFrame, tokenizer: str = TOKENIZER, tokens_a_segment: int = TOKENS_A_SEGMENT, loss_share: float = LOSS_SHARE) -> DataFrame:
    """Every document assigned to containers of every kind: (container_kind, container_id, position, doc_id, start_token, end_token, loss_tokens).

    ``containers`` is the small table of kinds (container_kind, capacity_tokens, separator_tokens). A container takes one segment
    for every ``tokens_a_segment`` tokens of its capacity, and ``loss_share`` of its capacity in loss-bearing tokens; a text
    that bears more is cut by that limit. Texts are counted once; only ids and sizes are shuffled."""
    sizes = cut(sized(documents, tokenizer))
    parts = max(1, -(-sizes.count() // GROUP))
    fixed = limited(containers, tokens_a_segment, loss_share).collect()  # a fixed table of three rows
    if not fixed:
        return documents.sparkSession.createDataFrame([], SCHEMA)
    names = ("container_kind", "capacity_tokens", "separator_tokens", "segments", "loss_most")
    of_kind: Column = F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in zip(names, r, strict=True)]) for r in fixed])
    each = sizes.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(parts))).select("*", F.explode(of_kind).alias("k")).select("doc_id", "tokens", "loss_tokens", "part", "k.*")
    # a text within both limits is whole; one beyond either is cut at the smaller, so that no piece exceeds any
    whole = (F.col("tokens") <= F.col("capacity_tokens")) & (F.col("loss_tokens") <= F.col("loss_most"))
    each = each.withColumn("step", F.when(whole, F.col("capacity_tokens")).otherwise(F.least("capacity_tokens", "loss_most")))
    pieces = F.sequence(F.lit(0), F.greatest(F.ceil(F.col("tokens") / F.col("step")) - 1, F.lit(0)).cast("int"))
    cut_up = each.withColumn("i", F.explode(pieces)).withColumn("start_token", F.col("i") * F.col("step"))
    cut_up = cut_up.withColumn("end_token", F.least("tokens", F.col("start_token") + F.col("step")))
    share = F.col("loss_tokens") - (F.col("tokens") - F.col("end_token"))  # loss-bearing tokens stand at the end
    cut_up = cut_up.withColumn("loss_tokens", F.greatest(F.lit(0), F.least(share, F.col("end_token") - F.col("start_token"))))
    return cut_up.groupBy("container_kind", "part").applyInPandas(_pack, SCHEMA)


def fill(packs: DataFrame, containers: DataFrame, tokens_a_segment: int = TOKENS_A_SEGMENT, loss_share: float = LOSS_SHARE) -> DataFrame:
    """(container_kind, containers, items, tokens, filled, least_containers): how well each kind is filled, separators counted.
    No packing can do with fewer than ``least_containers``, which is what the scarcest of the three limits asks for."""
    each = packs.groupBy("container_kind", "container_id").agg(F.count("*").alias("items"), F.sum(F.col("end_token") - F.col("start_token")).alias("tokens"), F.sum("loss_tokens").alias("loss"))
    of = each.join(F.broadcast(limited(containers, tokens_a_segment, loss_share)), "container_kind")
    used = F.col("tokens") + (F.col("items") - 1) * F.col("separator_tokens")
    taken = F.sum(F.col("tokens") + F.col("items") * F.col("separator_tokens"))
    most = lambda c: F.max(c)
    least = F.greatest(F.ceil(taken / (most("capacity_tokens") + most("separator_tokens"))), F.ceil(F.sum("items") / most("segments")), F.ceil(F.sum("loss") / most("loss_most")))
    return of.groupBy("container_kind").agg(
        F.count("*").alias("containers"),
        F.sum("items").alias("items"),
        F.sum("tokens").alias("tokens"),
        F.round(F.sum(used) / F.sum("capacity_tokens"), 6).alias("filled"),
        least.alias("least_containers"),
    )
