"""Evaluation texts inside corpus texts: one Aho-Corasick automaton over the items, then an exact word alignment."""

from __future__ import annotations

import bisect
import difflib
import html
import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of a passage or question, in their order, that count as a leak.
LEAST = 15
#: Words of an anchor; each holds a name or figure of its item.
ANCHOR = 3
#: Share of an item's names and figures, within the part that a text has of it, that must be its own.
OWN = 0.6
#: Words between two parts of an item (other sentences may stand there), and around an anchor.
REACH = 120
#: A part without a name or figure counts if it is this close to one that counts, or this long.
BESIDE, LONG = 2, 8
#: Items of one automaton, which every worker holds; a larger collection is cut into parts, and texts are scanned once for each.
PART = 50_000

_ZERO = "\u00ad\u200b\u200c\u200d\u2060\ufeff"
_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|</?[a-zA-Z][^<>]*>", re.S)
_ENTITY = re.compile(r"&#?\w{1,10};")
_TOKEN = re.compile(rf"{_ENTITY.pattern}|[^\W_](?:[{_ZERO}]*[^\W_])*")
_GAP = re.compile(r"[\W_]+")
_UNSEEN = re.compile(f"[{_ZERO}]")
#: Stands between the words outside of markup and those inside; no item has it.
_EDGE = "\n"
_DROP = dict.fromkeys(map(ord, _ZERO))
#: Words that are capitalised but are no names of their own (fixed values).
MONTHS = {"january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"}


def words(text: str) -> tuple[list[str], list[int]]:
    """The words of a text without case, punctuation, spacing and markup, and where each begins in it.

    What stands inside markup (comments and attributes, however long) comes after them, behind an edge.
    """
    out, at, inside = [], [], []

    def add(start: int, end: int) -> None:
        for m in _TOKEN.finditer(text, start, end):
            w = m.group()
            if w[0] == "&":
                w = html.unescape(w)
                if not w.isalnum():
                    continue
            out.append(w.translate(_DROP).lower())
            at.append(m.start())

    last = 0
    for m in _MARKUP.finditer(text):
        add(last, m.start())
        inside.append(m.span())
        last = m.end()
    add(last, len(text))
    if inside:
        out.append(_EDGE)
        at.append(inside[0][0])
        for span in inside:
            add(*span)
    return out, at


def _plain(text: str) -> str:
    """The words of a text, or of a piece of markup, as one string with single blanks: as words() has them, but without their places."""
    if "&" in text:
        text = _ENTITY.sub(lambda m: f" {u} " if (u := html.unescape(m.group())).isalnum() else " ", text)
    return f" {_GAP.sub(' ', text).lower().strip()} "


def may_hold(a, text: str) -> bool:
    """Whether any anchor stands in a text; most texts are done with this."""
    if _UNSEEN.search(text):
        text = text.translate(_DROP)
    parts = [_MARKUP.sub(" ", text), " \n ".join(_MARKUP.findall(text))] if "<" in text else [text]
    return any(next(a.iter(_plain(part)), None) for part in parts)


def _is_figure(w: str) -> bool:
    return any(c.isdigit() for c in w)


def _lower(text: str) -> set[str]:
    return {w for w in re.findall(r"\b[^\W\d_]+\b", text) if w == w.lower()}


def _capitals(text: str) -> set[str]:
    return {w.lower() for w in re.findall(r"\b[^\W\d_]{3,}\b", text) if w != w.lower()}


def item_parts(items: list[tuple], common: set[str] | None = None) -> list[tuple]:
    """(item, words, names and figures) of each passage and question.

    A name is a capitalised word that no item has in lower case (common: those that one has), and no month.
    """
    if common is None:
        common = set().union(*(_lower(t) for _, *texts in items for t in texts if t))
    parts = []
    for item, *texts in items:
        for t in texts:
            ws = words(t)[0] if t else None
            if ws:
                parts.append((item, ws, _capitals(t) - common - MONTHS, {w for w in ws if _is_figure(w)}))
    return parts


class Items:
    """Parts of items and, made when it is first asked for, their automaton: a worker makes it once for all its tasks."""

    def __init__(self, parts: list[tuple]):
        self.parts, self._made = parts, None

    @property
    def automaton(self):
        if self._made is None:
            self._made = (automaton(self.parts),)
        return self._made[0]

    def __getstate__(self):
        return self.parts

    def __setstate__(self, parts):
        self.parts, self._made = parts, None


def automaton(parts: list[tuple]):
    """Anchors: all runs of ANCHOR words with a name or figure; a part without either has all its runs; short parts are one anchor."""
    import ahocorasick

    a = ahocorasick.Automaton()
    anchors: dict[str, set[int]] = {}
    for k, (_, ws, names, figures) in enumerate(parts):
        own = names | figures
        n = min(ANCHOR, len(ws))
        for i in range(len(ws) - n + 1):
            run = ws[i : i + n]
            if not own or own.intersection(run):
                anchors.setdefault(f" {' '.join(run)} ", set()).add(k)
    for text, ks in anchors.items():
        a.add_word(text, (len(text), tuple(sorted(ks))))
    if anchors:
        a.make_automaton()
    return a if anchors else None


def aligned(part: list[str], own: set[str], names: set[str], there: list[str]) -> tuple[int, int, int, int, int]:
    """(words in order, own names and figures among them, names among them, first and last word of `there`) that a text has of a part."""
    blocks = [(b.a, b.b, b.size) for b in difflib.SequenceMatcher(None, part, there, autojunk=False).get_matching_blocks() if b.size]
    counts = [s >= LONG or any(w in own for w in part[i : i + s]) and s >= 2 for i, _, s in blocks]
    grew = True
    while grew:
        grew = False
        for k in range(len(blocks)):
            if counts[k]:
                continue
            for j in (k - 1, k + 1):
                if 0 <= j < len(blocks) and counts[j]:
                    (i0, j0, s0), (i1, j1, s1) = sorted((blocks[k], blocks[j]))
                    if i1 - i0 - s0 <= BESIDE and j1 - j0 - s0 <= BESIDE:
                        counts[k] = grew = True
    kept = [b for b, c in zip(blocks, counts) if c]
    if not kept:
        return 0, 0, 0, 0, 0
    total = sum(s for *_, s in kept)
    mine = sum(w in own for i, _, s in kept for w in part[i : i + s])
    named = sum(w in names for i, _, s in kept for w in part[i : i + s])
    # names and figures that the text has changed: in gaps of a few words on both sides
    changed = 0
    for (i0, j0, s0), (i1, j1, s1) in zip(kept, kept[1:]):
        gap = i1 - i0 - s0
        if 0 < gap <= 4 * BESIDE:
            changed += sum(w in own for w in part[i0 + s0 : i1])
    return total, mine, named, changed, kept[0][1]


def leaks_of(parts: list[tuple], a, text: str) -> list[tuple]:
    """(item, words, first offset) of each item that a text carries."""
    if a is None or not text or not may_hold(a, text):
        return []
    ws, at = words(text)
    joined = f" {' '.join(ws)} "
    begins = list(itertools.accumulate((len(w) + 1 for w in ws), initial=1))
    hits: dict[int, list[int]] = {}
    for end, (size, ks) in a.iter(joined):
        place = bisect.bisect_left(begins, end - size + 2)
        for k in ks:
            hits.setdefault(k, []).append(place)
    found: dict = {}
    for k, places in hits.items():
        item, part, names, figures = parts[k]
        places.sort()
        least = min(LEAST, len(part))
        # stretches of the text around anchors that stand within reach of each other
        start = 0
        for i in range(1, len(places) + 1):
            if i < len(places) and places[i] - places[i - 1] <= REACH:
                continue
            low, high = max(0, places[start] - len(part) - BESIDE), places[i - 1] + len(part) + BESIDE
            anchors = i - start
            start = i
            if anchors < 2 and least > 2 * ANCHOR:
                continue
            stretch = ws[low:high]
            total, mine, named, changed, first = aligned(part, names | figures, names, stretch)
            if total < least or names and not named or mine < OWN * (mine + changed):
                continue
            if item not in found or found[item][0] < total:
                found[item] = (total, at[min(low + first, len(at) - 1)])
    return [(item, total, offset) for item, (total, offset) in found.items()]


def _known(items: DataFrame, part: int, parts: int) -> list[tuple]:
    """The item_parts of one of several parts of the items; a name is one in all of them."""
    mine = items.where(F.pmod(F.xxhash64(items.columns[0]), F.lit(parts)) == part)
    rows = [tuple(r) for r in mine.collect()]  # about PART rows

    def lower(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(sorted(set().union(*(_lower(t) for c in b.columns for t in c.to_pylist() if t))), pa.string())], names=["w"])

    capitals = set().union(*(_capitals(t) for _, *texts in rows for t in texts if t))
    mentioned = items.sparkSession.createDataFrame([(w,) for w in sorted(capitals)], "w string")
    common = items.select(*items.columns[1:]).mapInArrow(lower, "w string").distinct().join(mentioned, "w", "left_semi")
    return item_parts(rows, {r["w"] for r in common.collect()})  # no more than the part's capitalised words


def leaked_items(docs: DataFrame, doc: Column, text: Column, items: DataFrame) -> DataFrame:
    """doc, item, words, offset: each item of which a text holds the passage or question, or fifteen words of it.

    items: item, and any number of text columns after it (passages, questions). Normalised words of all of
    them make one automaton, which every worker builds once; each text is scanned once, whole, outside of
    markup and inside of it. Where anchors of an item meet, its words are aligned with the text: runs of words
    that hold its names or figures count, with those close beside them; `words` is how many there are,
    `offset` where the first one begins in the original text. Case, punctuation, spacing, markup of any
    length, changed single words and sentences in between don't matter; names and figures that were exchanged
    for others do. A passage of fewer than fifteen words must be there in full. Collections of more than PART
    items are cut into parts with an automaton each. Null texts have no rows, null passages no effect;
    repeated rows of docs have rows each.
    """
    spark = docs.sparkSession
    base = docs.select(doc.alias("doc"), text.alias("text")).where("text is not null")
    parts = max(1, -(-items.count() // PART))
    if parts == 1:
        known = [item_parts([tuple(r) for r in items.collect()])]  # at most PART rows
    else:
        known = [_known(items, i, parts) for i in range(parts)]
    kinds = [base.schema["doc"].dataType.simpleString(), items.schema[0].dataType.simpleString()]
    item_type = pa.int64() if kinds[1] in ("bigint", "int") else pa.string()
    out = None
    for some in known:
        shared = spark.sparkContext.broadcast(Items(some))  # bounded by PART

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            held = shared.value
            for b in batches:
                at, found = [], []
                for i, t in enumerate(b.column(1).to_pylist()):
                    for f in leaks_of(held.parts, held.automaton, t):
                        at.append(i)
                        found.append(f)
                if at:
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array([f[0] for f in found], item_type), pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.int64())], names=["doc", "item", "words", "offset"])

        mine = base.mapInArrow(run, f"doc {kinds[0]}, item {kinds[1]}, words long, offset long")
        out = mine if out is None else out.unionByName(mine)
    return out
