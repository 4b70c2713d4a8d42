"""Texts into containers of fixed capacity, by shortest-pack-first over the histogram of their lengths."""

from __future__ import annotations

import bisect
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from panelwright.session import Scratch

#: Vocabulary of a public tokenizer (byte-level BPE), as ranks.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pattern that splits text before byte-level BPE (a fixed value of that tokenizer).
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Ranks of one length are numbered in shards of about so many pieces, so that no length is numbered in one task.
SHARD = 1 << 18

_ENCODERS: dict = {}


def _encoder(vocabulary: str):
    if vocabulary not in _ENCODERS:
        import base64

        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
        _ENCODERS[vocabulary] = tiktoken.Encoding("packing", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[vocabulary]


def token_counts(docs: DataFrame, doc: Column, text: Column, *, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc and n_tokens; a null text has 0 tokens. Every text is encoded whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabulary)
        for b in batches:
            n = [len(encoder.encode_ordinary(t.encode("utf-8", "replace").decode())) if t else 0 for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], names=["doc", "n_tokens"])

    base = docs.select(doc.alias("doc"), text.alias("text"))
    return base.mapInArrow(run, f"doc {base.schema['doc'].dataType.simpleString()}, n_tokens long")


def pack_histogram(counts: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """Patterns (copies, {length: how many}) that hold all lengths of a histogram.

    Lengths come longest first; each goes to the shortest pack, the one with the most room, if it fits
    there, else opens a new one. Packs of one pattern are handled together, so the work depends on the
    number of lengths and patterns, not on how many texts there are.
    """
    room: list[int] = []  # rooms with open patterns, ascending
    held: dict[int, list[list]] = defaultdict(list)

    def put(left: int, copies: int, pattern: dict[int, int]) -> None:
        if not held[left]:
            bisect.insort(room, left)
        held[left].append([copies, pattern])

    for length in sorted(counts, reverse=True):
        n = counts[length]
        while n:
            if room and room[-1] >= length:
                left = room[-1]
                copies, pattern = held[left][-1]
                take = min(copies, n)
                more = pattern | {length: pattern.get(length, 0) + 1}
                if take == copies:
                    held[left].pop()
                    if not held[left]:
                        room.pop()
                else:
                    held[left][-1][0] -= take
                put(left - length, take, more)
                n -= take
            else:
                # as many whole packs of this length as can be filled, and one for the rest
                each = capacity // length
                if n >= each:
                    put(capacity - each * length, n // each, {length: each})
                    n %= each
                if n:
                    put(capacity - n * length, 1, {length: n})
                    n = 0
    return [(copies, pattern) for packs in held.values() for copies, pattern in packs]


def _slots(patterns: list[tuple[int, dict[int, int]]]) -> np.ndarray:
    """Rows (length, first rank, pattern's first container, texts per container, first slot), by length and rank."""
    out, used, container = [], defaultdict(int), 0
    for copies, pattern in patterns:
        slot = 0
        for length in sorted(pattern, reverse=True):
            out.append((length, used[length], container, pattern[length], slot))
            used[length] += copies * pattern[length]
            slot += pattern[length]
        container += copies
    return np.array(sorted(out), np.int64).reshape(-1, 5)


def _place(slots: np.ndarray):
    key = slots[:, 0] * (1 << 48) + slots[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = (b.column(c).to_numpy() for c in ("n_tokens", "rank"))
            _, first, container, each, slot = slots[np.searchsorted(key, length * (1 << 48) + rank, side="right") - 1].T
            at = rank - first
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc", "piece", "first_token", "n_tokens")), pa.array(container + at // each), pa.array(slot + at % each)], names=["doc", "piece", "first_token", "n_tokens", "container", "slot"])

    return run


def pack(sizes: DataFrame, capacity: int, scratch: Scratch) -> DataFrame:
    """doc, piece, first_token, n_tokens, container and slot of each text of `sizes` (doc, n_tokens).

    A text longer than the capacity is cut into full pieces and a rest; all others stay whole. Texts
    without tokens need no room and are left out. The histogram has at most `capacity` entries, which are all
    that reaches the driver; ranks are numbered in shards whose number follows the corpus; each piece's rank among those of its length then says which pattern it goes to.
    """
    pieces = F.transform(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_tokens") - 1) / capacity).cast("long")), lambda i: F.struct(i.alias("piece"), (i * capacity).alias("first_token"), F.least(F.lit(capacity).cast("long"), F.col("n_tokens") - i * capacity).alias("n_tokens")))
    cut = sizes.where("n_tokens > 0").select("doc", F.explode(pieces).alias("p")).select("doc", "p.*")
    # even a length that all pieces have is numbered in several tasks, however many there are
    shards = max(8, -(-cut.count() // SHARD))
    cut = cut.withColumn("shard", F.pmod(F.xxhash64("doc", "piece"), F.lit(shards)))
    per = cut.groupBy("n_tokens", "shard").agg(F.count(F.lit(1)).alias("n"))
    per, _ = scratch.write(per.withColumn("before", F.coalesce(F.sum("n").over(W.partitionBy("n_tokens").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))))
    got = per.groupBy("n_tokens").agg(F.sum("n").alias("n")).toArrow()  # at most `capacity` rows
    counts = dict(zip(got.column("n_tokens").to_pylist(), got.column("n").to_pylist()))
    ranked = cut.withColumn("within", F.row_number().over(W.partitionBy("n_tokens", "shard").orderBy("doc", "piece")) - 1)
    # offsets: a row per length and shard, written, so that the planner knows whether to broadcast it
    ranked = ranked.join(per.select("n_tokens", "shard", "before"), ["n_tokens", "shard"]).withColumn("rank", F.col("within") + F.col("before"))
    kind = cut.schema["doc"].dataType.simpleString()
    patterns = pack_histogram(counts, capacity)
    return ranked.select("doc", "piece", "first_token", "n_tokens", "rank").mapInArrow(_place(_slots(patterns)), f"doc {kind}, piece long, first_token long, n_tokens long, container long, slot long")


def fill_containers(docs: DataFrame, doc: Column, text: Column, capacities: DataFrame, *, vocabulary: str = VOCABULARY) -> DataFrame:
    """Every text in containers of each capacity: kind, container, slot, doc, piece, first_token, n_tokens.

    capacities: kind and capacity, a handful of rows. Texts are sized once in tokens of the tokenizer whose
    ranks are in `vocabulary`, then packed for each capacity (see pack). Within a kind, a container's pieces
    add up to no more than its capacity. Rows with a null doc are texts like any other; repeated rows are
    packed each; a null or non-positive capacity gives no containers.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    sizes, _ = scratch.write(token_counts(docs, doc, text, vocabulary=vocabulary))
    kinds = capacities.select("kind", F.col("capacity").cast("long").alias("capacity")).where("capacity > 0").distinct().orderBy("kind", "capacity").collect()
    out = None
    for kind, capacity in kinds:
        packed = pack(sizes, capacity, scratch).select(F.lit(kind).alias("kind"), "container", "slot", "doc", "piece", "first_token", "n_tokens")
        out = packed if out is None else out.unionByName(packed)
    if out is None:
        key = docs.select(doc.alias("doc")).schema["doc"].dataType.simpleString()
        return docs.sparkSession.createDataFrame([], f"kind string, container long, slot long, doc {key}, piece long, first_token long, n_tokens long")
    return out
