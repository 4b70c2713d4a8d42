"""Subject areas of texts: seeded non-negative factorisation of the document-term matrix, read off per sentence."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.session import Scratch

#: Words that show a sentence's language (fixed values); a text in none of them counts as the first.
LANGUAGES = {
    "en": {"the", "of", "and", "to", "was", "is", "in", "for", "we", "on", "with", "this", "that", "by", "at", "as", "it", "you", "are", "not", "from", "out"},
    "es": {"el", "la", "los", "las", "de", "del", "y", "con", "por", "según", "esta", "se", "un", "una", "que", "lo", "al", "es", "para", "hay", "no"},
    "de": {"der", "die", "das", "und", "den", "dem", "um", "durch", "mit", "wie", "uns", "ist", "ein", "eine", "war", "auf", "laut", "für", "zu", "im", "von"},
}
#: Terms are hashed to so many columns in each language (this bounds all that is broadcast or collected).
BLOCK = 1 << 16
TERMS = BLOCK * len(LANGUAGES)
#: Components without an area, for words of all areas.
GROUND = 2
#: Rounds of alternating updates; updates of a document's mixture in each.
ROUNDS, INNER = 4, 6
#: Sentences folded in at once.
FOLD = 4096
#: How much of its seed a component keeps; how much a labelled document may be about other areas than those it is labelled with.
ANCHOR, LEAK = 0.3, 0.02
#: Words of a sentence that its leading area must explain, and its part of all words that areas explain there.
LEAST, LEADS = 2.0, 0.5
#: Share of a document's sentences with an area from which on the area is one of the document's.
SHARE = 0.25

_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|</?[a-zA-Z][^<>]*>|&#?\w{1,10};", re.S)
_BREAK = re.compile(r"[.!?…]\s|\n|\s[|•*-]\s")
_TERM = re.compile(r"[^\W\d_]{2,}")


class _Codes(dict):
    """Of each word: its column within a language's block, and above it a bit for each language that it shows."""

    def __missing__(self, word: str) -> int:
        shows = sum(1 << k for k, known in enumerate(LANGUAGES.values()) if word in known)
        code = self[word] = zlib.crc32(word.encode("utf-8", "replace")) % BLOCK + BLOCK * shows
        return code


def terms_of(texts: list[str], codes: _Codes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(columns of the words of all sentences, words in each sentence, sentences in each text).

    A sentence is in the language that most of its words show, else in the one that most of its text shows.
    """
    words: list[int] = []
    sizes, per = [], []
    for text in texts:
        n = 0
        for part in _BREAK.split(_MARKUP.sub(" \n ", text) if "<" in text or "&" in text else text):
            found = _TERM.findall(part.lower())
            if found:
                words.extend(map(codes.__getitem__, found))
                sizes.append(len(found))
                n += 1
        per.append(n)
    code, size, n = np.array(words, np.int64), np.array(sizes, np.int64), np.array(per, np.int64)
    if not len(code):
        return code.astype(np.int32), size.astype(np.int32), n.astype(np.int32)
    start = np.r_[0, np.cumsum(size)[:-1]]
    text = np.repeat(np.arange(len(texts)), n)
    rank = np.zeros((len(LANGUAGES), len(size)), np.int64)
    for k in range(len(LANGUAGES)):
        votes = np.add.reduceat((code >> (16 + k)) & 1, start)
        rank[k] = (votes << 32) + np.bincount(text, weights=votes, minlength=len(texts)).astype(np.int64)[text]
    spoken = rank.argmax(0)
    return (np.repeat(spoken, size) * BLOCK + code % BLOCK).astype(np.int32), size.astype(np.int32), n.astype(np.int32)


def _mixtures(index: np.ndarray, value: np.ndarray, start: np.ndarray, h: np.ndarray, mask: np.ndarray, inner: int) -> tuple[np.ndarray, np.ndarray]:
    """Mixtures w of documents (rows of a sparse matrix) over the components, and the part of each entry that each component has.

    h: (terms, components). Both come from the multiplicative updates of the Kullback-Leibler divergence.
    """
    at, value, mask = h[index], value.astype(np.float32)[:, None], mask.astype(np.float32)
    row = np.repeat(np.arange(len(start) - 1), np.diff(start))
    w = mask / mask.sum(1, keepdims=True)
    for k in range(inner + 1):
        part = at * w[row]
        part *= value / np.maximum(part.sum(1, keepdims=True), 1e-12)
        if k < inner:
            w = np.add.reduceat(part, start[:-1], axis=0) * mask
            w /= np.maximum(w.sum(1, keepdims=True), 1e-12)
    return w, part


def _even(h: np.ndarray) -> np.ndarray:
    """Components whose terms add up to one in each language."""
    blocks = h.reshape(len(h), len(LANGUAGES), BLOCK)
    return (blocks / np.maximum(blocks.sum(2, keepdims=True), 1e-12)).reshape(h.shape)


def _seeds(sums: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Components from the terms of the labelled documents of each area (rows of sums) and of all documents.

    An area's seed is what is more usual in it than on the average of all areas; the ground's is what no area has for itself.
    """
    p, every = _even(sums), _even(total[None, :])[0]
    mean = p.mean(0)
    own = _even(np.maximum(p - 1.5 * mean, 0))
    shared = np.sort(p, axis=0)[: max(1, len(p) // 2 + 1)].mean(0)  # in half of the areas or more
    ground = np.stack([np.minimum(shared, every) + 0.05 * every if g == 0 else every for g in range(GROUND)])
    h = np.concatenate([0.9 * own + 0.1 * p, _even(ground)])
    return _even(h + 1e-3 * every + 1e-9)


def areas_of(terms: np.ndarray, sizes: np.ndarray, per: np.ndarray, h: np.ndarray, areas: int) -> np.ndarray:
    """(texts, areas): how many sentences of each text are about each area.

    A sentence is folded in at fixed components: its mixture says how many of its words each area explains.
    """
    counts = np.zeros((len(per), areas), np.int64)
    if not len(sizes):
        return counts
    text = np.repeat(np.arange(len(per)), per)
    ends = np.cumsum(sizes)
    for at in range(0, len(sizes), FOLD):
        size = sizes[at : at + FOLD]
        some = terms[ends[at] - sizes[at] : ends[at + len(size) - 1]]
        w = _mixtures(some, np.ones(len(some), np.float32), np.r_[0, np.cumsum(size)], h, np.ones((len(size), h.shape[1])), INNER)[0]
        explained = w[:, :areas] * size[:, None]
        best = explained.argmax(1)
        most = explained[np.arange(len(size)), best]
        clear = (most >= LEAST) & (most > LEADS * explained.sum(1))
        np.add.at(counts, (text[at : at + FOLD][clear], best[clear]), 1)
    return counts


_MATRIX = pa.schema([("index", pa.list_(pa.int32())), ("value", pa.list_(pa.float32())), ("terms", pa.list_(pa.int32())), ("sizes", pa.list_(pa.int32()))])
_LISTS = "index array<int>, value array<float>, terms array<int>, sizes array<int>"


def _lists(flat: np.ndarray, lengths: np.ndarray, kind) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(lengths)], pa.int32()), pa.array(flat, kind))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of the document-term matrix, square roots of counts, and the terms of each sentence."""
    codes = _Codes()
    for b in batches:
        terms, sizes, per = terms_of([t or "" for t in b.column(1).to_pylist()], codes)
        row = np.repeat(np.repeat(np.arange(len(per)), per), sizes)
        cell, n = np.unique(row * TERMS + terms, return_counts=True)
        words = np.bincount(row, minlength=len(per))
        distinct = np.bincount(cell // TERMS, minlength=len(per))
        yield pa.RecordBatch.from_arrays([b.column(0), _lists(cell % TERMS, distinct, pa.int32()), _lists(np.sqrt(n), distinct, pa.float32()), _lists(terms, words, pa.int32()), _lists(sizes, per, pa.int32())], names=["doc", *_MATRIX.names])
        if len(codes) > 1_000_000:
            codes.clear()


def _entries(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """index, value, row starts and labels of the documents of a batch that have any term."""
    lists, n = b.column("index"), b.column("index").value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    start = np.r_[0, np.cumsum(n[n > 0])]
    return lists.flatten().to_numpy(), b.column("value").flatten().to_numpy(), start, b.column("labels").to_numpy(zero_copy_only=False)[n > 0]


def _cells(sums: np.ndarray) -> pa.RecordBatch:
    """The entries of (terms, components) sums that are not zero."""
    cell = np.flatnonzero(sums.reshape(-1) > 1e-7)
    return pa.RecordBatch.from_arrays([pa.array(cell), pa.array(sums.reshape(-1)[cell].astype(float))], names=["cell", "x"])


def _gather(df: DataFrame, components: int) -> np.ndarray:
    """(components, TERMS) of summed cells; at most components * TERMS rows of two numbers."""
    got = df.groupBy("cell").agg(F.sum("x").alias("x")).toArrow()
    out = np.zeros(TERMS * components)
    out[got.column("cell").to_numpy()] = got.column("x").to_numpy()
    return out.reshape(TERMS, components).T


def subject_areas(docs: DataFrame, doc: Column, text: Column, labels: DataFrame, areas: list[str]) -> DataFrame:
    """doc, area, share: the areas that at least a quarter of a text's sentences with an area are about.

    labels: doc, area; of several rows for a document all areas count, in any case and with blanks around
    them; areas that are not in `areas` are left out. The labelled documents' words seed one component per
    area, and hold their own mixtures to their labels (not quite: labels may be wrong or incomplete); ground
    components take the words of all areas. Alternating multiplicative updates (Kullback-Leibler) factor the
    matrix of all documents, each round one pass over it with sums per term; terms are hashed per language,
    so components, sums and what is broadcast have a fixed size. Passes run in as many tasks as the cluster
    has cores, so what they send does not grow with the corpus. Each sentence is then folded in at the
    components found: its area is the leading one of its mixture, if that explains two words or more, and more
    than all others together. Texts are read once; null and empty texts have no areas; repeated rows have
    rows each; without labels there are no areas.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "subjects")
    n, k = len(areas), len(areas) + GROUND
    base = docs.select(doc.alias("doc"), text.alias("text"))
    kind = base.schema["doc"].dataType.simpleString()
    bit = F.lit(None).cast("long")
    for i, a in enumerate(areas):
        bit = F.when(F.lower(F.trim("area")) == a.strip().lower(), F.lit(1 << i).cast("long")).otherwise(bit)
    marks = labels.withColumn("bit", bit).where("bit is not null and doc is not null").groupBy(F.col("doc").alias("ldoc")).agg(F.bit_or("bit").alias("labels"))
    matrix = base.mapInArrow(_counted, f"doc {kind}, {_LISTS}")
    matrix, _ = scratch.write(matrix.join(marks, F.col("doc") == F.col("ldoc"), "left").select("doc", F.coalesce("labels", F.lit(0).cast("long")).alias("labels"), "index", "value", "terms", "sizes"))
    has = lambda labels: (labels[:, None] >> np.arange(n)) & 1
    rows = matrix.select("index", "value", "labels").coalesce(spark.sparkContext.defaultParallelism)

    def seeding(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((TERMS, n + 1), np.float64)
        for b in batches:
            index, value, start, labels = _entries(b)
            if not len(labels):
                continue
            row = np.repeat(np.arange(len(labels)), np.diff(start))
            mine = has(labels)
            share = np.concatenate([mine / np.maximum(mine.sum(1, keepdims=True), 1), np.ones((len(labels), 1))], 1)
            np.add.at(sums, index, value[:, None] * share[row])
        yield _cells(sums)

    sums = _gather(rows.mapInArrow(seeding, "cell long, x double"), n + 1)
    seed = _seeds(sums[:n], sums[n])
    h = seed
    for _ in range(ROUNDS):
        shared = spark.sparkContext.broadcast(np.ascontiguousarray(h.T, np.float32))  # TERMS * k floats

        def update(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            total = np.zeros((TERMS, k), np.float32)
            for whole in batches:
                for at in range(0, whole.num_rows, 200):
                    index, value, start, labels = _entries(whole.slice(at, 200))
                    if not len(labels):
                        continue
                    mask = np.ones((len(labels), k))
                    mask[:, :n] = np.where(labels[:, None] > 0, np.where(has(labels) > 0, 1.0, LEAK), 1.0)
                    np.add.at(total, index, _mixtures(index, value, start, shared.value, mask, INNER)[1])
            yield _cells(total)

        part = _gather(rows.mapInArrow(update, "cell long, x double"), k)
        shared.unpersist()
        h = _even((1 - ANCHOR) * _even(part) + ANCHOR * seed)
    last = spark.sparkContext.broadcast(np.ascontiguousarray(h.T, np.float32))  # TERMS * k floats

    def reading(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("sizes")
            counts = areas_of(b.column("terms").flatten().to_numpy(), lists.flatten().to_numpy(), lists.value_lengths().to_numpy(zero_copy_only=False), last.value, n)
            share = counts / np.maximum(counts.sum(1, keepdims=True), 1)
            at, area = np.nonzero(share >= SHARE)
            yield pa.RecordBatch.from_arrays([b.column("doc").take(pa.array(at)), pa.array([areas[a] for a in area], pa.string()), pa.array(share[at, area])], names=["doc", "area", "share"])

    return matrix.select("doc", "terms", "sizes").mapInArrow(reading, f"doc {kind}, area string, share double")
