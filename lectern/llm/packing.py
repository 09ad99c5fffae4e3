"""Documents of varying length into containers of fixed capacity, by large-item matching (8).

Documents larger than a container are cut into full containers and a rest; nothing else is split. Items above a third of
the capacity go at most two to a container, matched greedily: each, from the largest on, takes the largest partner that
still fits. Smaller items then go, from the largest on, where they leave the least space.

Items are spread by hash over shards of a bounded number of items, each packed by itself; a shard leaves at most a few
containers half empty, so what is lost against packing all at once shrinks with the size of a shard, not with the data.
"""

from __future__ import annotations

import base64
from bisect import bisect_right
from collections.abc import Iterator
from functools import cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.arrow_groups import column, starts_of, whole_groups
from lectern.session import materialise

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: How the tokenizers' texts are parted before merging: a fixed value that belongs to the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
ITEMS_PER_SHARD = 20_000
#: Targets in one pass over the documents' token counts; more are taken in further passes.
TARGETS_AT_ONCE = 100
ASSIGNED = "target_id bigint, container_id string, doc_id bigint, piece bigint, n_tokens bigint"


@cache
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """``doc_id, n_tokens`` of each document with at least one token, by the public tokenizer at ``tokenizer``."""

    @F.arrow_udf("bigint")
    def tokens(a: pa.Array) -> pa.Array:
        encode = _encoding(tokenizer).encode_ordinary
        return pa.array([0 if not t else len(encode(t)) for t in a.to_pylist()], pa.int64())

    x = documents.where("doc_id is not null and text is not null").select("doc_id", tokens("text").alias("n_tokens"))
    return x.groupBy("doc_id").agg(F.max("n_tokens").alias("n_tokens")).where("n_tokens > 0")


def pack(sizes: list[int], capacity: int) -> tuple[list[int], int]:
    """The bin of each item and the number of bins. Sizes are from 1 to ``capacity``; ties go by position."""
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    bins = [-1] * len(sizes)
    gaps: list[int] = []
    large = [i for i in order if 3 * sizes[i] > capacity]
    # ascending, so that the largest partner that fits is found by bisection; taken ones are skipped by linked positions
    rising = large[::-1]
    keys = [sizes[i] for i in rising]
    before = list(range(len(rising) + 1))  # before[k]: the last free position below k, as a position + 1

    def free(k: int) -> int:
        while before[k] != k:
            before[k] = before[before[k]]
            k = before[k]
        return k

    for p in range(len(rising), 0, -1):
        i = rising[p - 1]
        if bins[i] >= 0:
            continue
        before[p] = p - 1
        bins[i] = len(gaps)
        gap = capacity - sizes[i]
        q = free(min(bisect_right(keys, gap), p - 1))
        if q:
            j = rising[q - 1]
            before[q] = q - 1
            bins[j] = len(gaps)
            gap -= sizes[j]
        gaps.append(gap)
    # bins by the space left; a bit for each space that some bin has
    by: dict[int, list[int]] = {}
    bits = 0
    for b in range(len(gaps) - 1, -1, -1):
        by.setdefault(gaps[b], []).append(b)
        bits |= 1 << gaps[b]
    for i in order[len(large) :]:
        size = sizes[i]
        fits = bits >> size
        if fits:
            gap = size + (fits & -fits).bit_length() - 1
            b = by[gap].pop()
            if not by[gap]:
                bits &= ~(1 << gap)
        else:
            gap, b = capacity, len(gaps)
            gaps.append(capacity)
        bins[i] = b
        left = gap - size
        if left:
            by.setdefault(left, []).append(b)
            bits |= 1 << left
    return bins, len(gaps)


def _pack_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in whole_groups(batches, ["target_id", "shard"], 1):
        target, shard, size, capacity = (column(t, c) for c in ("target_id", "shard", "n_tokens", "capacity_tokens"))
        at = [*np.flatnonzero(starts_of(target, shard)), len(size)]
        for lo, hi in zip(at, at[1:]):
            bins, _ = pack(size[lo:hi].tolist(), int(capacity[lo]))
            names = pa.array([f"{target[lo]}-{shard[lo]}-{b}" for b in bins])
            rows = t.slice(lo, hi - lo).select(["target_id", "doc_id", "piece", "n_tokens"]).combine_chunks()
            yield pa.RecordBatch.from_arrays([rows.column("target_id").combine_chunks(), names, *(rows.column(c).combine_chunks() for c in ("doc_id", "piece", "n_tokens"))], names=["target_id", "container_id", "doc_id", "piece", "n_tokens"])


def assign(documents: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER, items_per_shard: int = ITEMS_PER_SHARD) -> DataFrame:
    """``target_id, container_id, doc_id, piece, n_tokens``: the container of each document, or of each piece of one that
    is larger than a container, for each target. Piece k of a document begins at its token k * capacity.

    Documents without tokens (null, empty) need no container. Repeated documents are packed once, ties go by doc_id.
    Targets with null or less than one token of capacity have no containers, repeated targets count once.
    """
    counts = materialise(token_counts(documents, tokenizer), "tokens")
    shards = max(1, -(-counts.count() // items_per_shard))
    targets = targets.where("target_id is not null and capacity_tokens >= 1").groupBy("target_id").agg(F.max("capacity_tokens").alias("capacity_tokens"))
    out, block = [], []
    for r in targets.orderBy("target_id").toLocalIterator():
        block.append(r)
        if len(block) == TARGETS_AT_ONCE:
            out.append(_assigned(counts, block, shards))
            block = []
    if block:
        out.append(_assigned(counts, block, shards))
    return reduce(DataFrame.unionByName, out) if out else counts.sparkSession.createDataFrame([], ASSIGNED)


def _assigned(counts: DataFrame, few: list, shards: int) -> DataFrame:
    """The documents in containers of a block of targets."""
    each = F.array(*[F.struct(F.lit(r.target_id).cast("bigint").alias("target_id"), F.lit(r.capacity_tokens).cast("bigint").alias("capacity_tokens")) for r in few])
    x = counts.select("*", F.inline(each)).withColumn("full", F.floor(F.col("n_tokens") / F.col("capacity_tokens")))
    whole = x.where("full > 0").select("target_id", "capacity_tokens", "doc_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("full") - 1)).alias("piece"))
    whole = whole.select("target_id", F.concat_ws("-", "target_id", F.lit("full"), "doc_id", "piece").alias("container_id"), "doc_id", "piece", F.col("capacity_tokens").alias("n_tokens"))
    rest = x.select("target_id", "capacity_tokens", "doc_id", F.col("full").alias("piece"), F.pmod("n_tokens", "capacity_tokens").alias("n_tokens")).where("n_tokens > 0")
    rest = rest.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)))
    rest = rest.repartition("target_id", "shard").sortWithinPartitions("target_id", "shard", "doc_id")
    packed = rest.mapInArrow(_pack_shards, ASSIGNED)
    return packed.unionByName(whole)


def fill(assigned: DataFrame, targets: DataFrame) -> DataFrame:
    """For each target the containers used, the tokens in them and the share of space that is filled."""
    x = assigned.groupBy("target_id", "container_id").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("items"))
    x = x.groupBy("target_id").agg(F.count("*").alias("n_containers"), F.sum("items").alias("n_items"), F.sum("n").alias("n_tokens"), F.max("n").alias("fullest"))
    return x.join(targets.select("target_id", "capacity_tokens").distinct(), "target_id").withColumn("filled", F.round(F.col("n_tokens") / (F.col("n_containers") * F.col("capacity_tokens")), 6))
