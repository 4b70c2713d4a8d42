"""Deeply nested records into flat tables, with one stored copy per distinct object (Merkle identities)."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from json.decoder import scanstring

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.session import Scratch

#: A JSON value begins at the start of the text, or after an assignment in script text.
_BARE = re.compile(r"\s*(?=[\[{])")
_ASSIGNED = re.compile(r"=\s*(?=[\[{])")
_SPACE = re.compile(r"[ \t\n\r]*")
_ATOM = re.compile(r"(-?(?:0|[1-9]\d*))(\.\d+)?([eE][-+]?\d+)?|true|false|null")
_NAMED = {"true": True, "false": False, "null": None}
_BATCH = 20_000


def _no_constant(name: str):
    raise ValueError(name)


def _deep(text: str, at: int) -> tuple[object, int]:
    """One JSON value and where it ends, however deep: open lists and objects are on a list, not on the call stack."""
    blank = lambda i: _SPACE.match(text, i).end()
    root: list = []
    open_: list = [(root, None)]
    while True:
        at = blank(at)
        sign, (holder, key) = text[at : at + 1], open_[-1]
        if sign == "{" or sign == "[":
            value, at = ({} if sign == "{" else []), blank(at + 1)
            closes = text[at : at + 1] == ("}" if sign == "{" else "]")
        elif sign == '"':
            value, at = scanstring(text, at + 1)
            closes = True
        else:
            m = _ATOM.match(text, at)
            if not m:
                raise ValueError("no value")
            whole, part, power = m.groups()
            value = _NAMED[m.group()] if whole is None else float(m.group()) if part or power else int(whole)
            at, closes = m.end(), True
        if key is None:
            holder.append(value)
        else:
            holder[key] = value
        if sign in ("{", "[") and not closes:
            open_.append((value, None))
        else:
            at += sign in ("{", "[")
            # after a whole value: close what ends here, go on with what does not
            while True:
                holder = open_[-1][0]
                if holder is root:
                    return root[0], at
                at = blank(at)
                sign = text[at : at + 1]
                if sign == ",":
                    at += 1
                    break
                if sign != ("}" if isinstance(holder, dict) else "]"):
                    raise ValueError("no end")
                open_.pop()
                at += 1
        if isinstance(open_[-1][0], dict):
            at = blank(at)
            if text[at : at + 1] != '"':
                raise ValueError("no name")
            name, at = scanstring(text, at + 1)
            at = blank(at)
            if text[at : at + 1] != ":":
                raise ValueError("no colon")
            at, open_[-1] = at + 1, (open_[-1][0], name)


def _value(text: str, at: int) -> tuple[object, int]:
    try:
        return json.JSONDecoder(parse_constant=_no_constant).raw_decode(text, at)
    except RecursionError:
        return _deep(text, at)


def decode_all(text: str | None) -> list:
    """The complete JSON objects and lists in a text, in their order: one that is the text itself, or all that script text assigns.

    Text around them doesn't matter; cut-off JSON is none.
    """
    text, out = text or "", []
    m = _BARE.match(text)
    if m:
        try:
            return [_value(text, m.end())[0]]
        except ValueError:
            return []
    at = 0
    while m := _ASSIGNED.search(text, at):
        try:
            value, at = _value(text, m.end())
            out.append(value)
        except ValueError:
            at = m.end()
    return out


def decode_after(text: str | None, marker: str):
    """The JSON value right after the first `marker` in a text; None without one, or if it is cut off."""
    at = (text or "").find(marker)
    if at < 0:
        return None
    try:
        return _value(text, at + len(marker))[0]
    except ValueError:
        return None


def _walk(roots: list, rows_field: str):
    """(occ, parent, field, ordinal, hash, body, role, holder) of every object, bottom-up.

    occ numbers the objects in document order; field is the nearest field above an object, ordinal
    its place in a list; holder is the occ of the nearest object above that has rows_field. role is `holder` for
    an object with rows_field, `row` for the records it holds there (wrappers such as edges and node are
    passed through), else `other`. Open objects are on a list, so depth does not matter.
    """
    out: list = []
    count = 0

    # an open list or object: kind, items left, canonical texts of those done (with their names in an object), what is known of it, name of the item at work
    def frame(value, parent: int, field: str, ordinal: int, holder: int, inside: bool):
        nonlocal count
        if isinstance(value, list):
            return ["[", iter(enumerate(value)), [], (parent, field, holder, inside), None]
        occ, count = count, count + 1
        holds = rows_field in value
        wrapper = inside and not holds and ("edges" in value or "nodes" in value or "node" in value) and "id" not in value
        return ["{", iter(value.items()), [], (occ, parent, field, ordinal, holder, inside, holds, wrapper), None]

    for i, root in enumerate(roots):
        stack = [frame(root, -1, "", i, -1, False)]
        while stack:
            kind, items, parts, own, _ = stack[-1]
            nxt = next(items, None)
            if nxt is None:
                stack.pop()
                if kind == "[":
                    text = "[" + ",".join(parts) + "]"
                else:
                    occ, parent, field, ordinal, holder, inside, holds, wrapper = own
                    body = "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{v}" for k, v in sorted(parts)) + "}"
                    digest = hashlib.sha256(body.encode("utf-8", "surrogatepass")).digest()[:16]
                    role = "holder" if holds and not inside else "row" if inside and not wrapper else "holder" if holds else "other"
                    out.append((occ, parent, field, ordinal, digest, body, role, holder))
                    text = f'{{"$":"{digest.hex()}"}}'
                if stack:
                    above = stack[-1]
                    above[2].append(text if above[0] == "[" else (above[4], text))
                continue
            name, value = nxt
            if kind == "[":
                parent, field, holder, inside = own
                if isinstance(value, (dict, list)):
                    stack.append(frame(value, parent, field, name, holder, inside))
                else:
                    parts.append(json.dumps(value, ensure_ascii=False))
                continue
            occ, _, _, _, holder, inside, holds, wrapper = own
            if isinstance(value, (dict, list)):
                stack[-1][4] = name
                stack.append(frame(value, occ, name, 0, occ if holds else holder, name == rows_field or (wrapper and name in ("edges", "nodes", "node"))))
            else:
                parts.append((name, json.dumps(value, ensure_ascii=False)))
    return out


_SCHEMA = pa.schema([("occ", pa.int32()), ("parent", pa.int32()), ("field", pa.string()), ("ordinal", pa.int32()), ("hash", pa.binary()), ("body", pa.string()), ("role", pa.string()), ("holder", pa.int32()), ("holder_hash", pa.binary())])
_COLUMNS = "occ int, parent int, field string, ordinal int, hash binary, body string, role string, holder int, holder_hash binary"


def _objects(rows_field: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            # a body that this batch has already given is not given again
            ids, kept, columns, given = b.column(0), [], [[] for _ in _SCHEMA], set()
            for i, text in enumerate(b.column(1).to_pylist()):
                found = _walk(decode_all(text), rows_field)
                hashes = {r[0]: r[4] for r in found}
                for occ, parent, field, ordinal, digest, body, role, holder in found:
                    kept.append(i)
                    new = (digest, role == "other") not in given
                    if new:
                        given.add((digest, role == "other"))
                    for c, x in zip(columns, (occ, parent, field, ordinal, digest, body if new else None, role, holder, hashes.get(holder))):
                        c.append(x)
                if len(kept) >= _BATCH:
                    yield _batch(ids, kept, columns)
                    kept, columns = [], [[] for _ in _SCHEMA]
            if kept:
                yield _batch(ids, kept, columns)

    def _batch(ids, kept, columns):
        def array(c, kind):
            try:
                return pa.array(c, kind)
            except UnicodeEncodeError:  # lone surrogates
                return pa.array([x.encode("utf-8", "replace").decode() if isinstance(x, str) else x for x in c], kind)

        return pa.RecordBatch.from_arrays([ids.take(pa.array(kept)), *(array(c, f.type) for c, f in zip(columns, _SCHEMA))], names=["doc", *_SCHEMA.names])

    return run


def _parsed(docs: DataFrame, doc: Column, text: Column, rows_field: str) -> DataFrame:
    """Every object of every text, written once: whole rows that repeat are parsed once."""
    base = docs.select(doc.alias("doc"), text.alias("text")).where("text is not null").distinct()
    every = base.mapInArrow(_objects(rows_field), f"doc {base.schema['doc'].dataType.simpleString()}, {_COLUMNS}")
    return Scratch(docs.sparkSession, "nested").write(every)[0]


def flatten(docs: DataFrame, doc: Column, text: Column, *, rows_field: str) -> tuple[DataFrame, DataFrame]:
    """(bridge, objects) of the JSON in `text`.

    objects: hash, body; one row per distinct object of all texts. body is its canonical JSON (sorted keys)
    with the objects inside it replaced by `{"$": hash}`, so that equal subtrees have equal hashes.
    bridge: doc, occ, parent, field, ordinal, hash, role, holder, holder_hash; one row per occurrence.
    Repeated rows of `docs` count once. Of a text, all complete JSON values count, in their order. Null texts,
    texts without JSON and JSON that is cut off give no rows; depth does not matter; of a key that occurs
    twice in an object the last counts.
    """
    every = _parsed(docs, doc, text, rows_field)
    return every.drop("body"), _stored(every)


def _stored(every: DataFrame) -> DataFrame:
    return every.where("body is not null").groupBy("hash").agg(F.min("body").alias("body"))


def _scalar(body: Column, field: str) -> Column:
    x = F.get_json_object(body, f"$.{field}")
    return F.when(F.trim(x) != "", x)


def holder_rows(docs: DataFrame, doc: Column, text: Column, *, rows_field: str = "variants") -> tuple[DataFrame, DataFrame]:
    """(holders, rows): two flat tables of the records that hold `rows_field`, and of the records held there.

    holders: doc, occ, holder_hash, holder_id, holder_title. rows: doc, occ, holder (the occ of its holder),
    ordinal, holder_id, row_id, title; ids are their digits; title is public_title, else title, else the
    values of options joined by ` / `, else ''. A holder or row whose id has no digits has a null id.
    """
    every = _parsed(docs, doc, text, rows_field)
    bridge, objects = every.drop("body"), _stored(every.where("role <> 'other'"))
    digits = lambda c: F.nullif(F.regexp_extract(F.regexp_replace(c, r"\.0*$", ""), r"([0-9]+)[^0-9]*$", 1), F.lit(""))
    options = F.get_json_object("body", "$.options")
    values = F.when(options.startswith("["), F.array_join(F.from_json(options, "array<string>"), " / ")).otherwise(options)
    fields = objects.select("hash", digits(F.get_json_object("body", "$.id")).alias("id"), _scalar(F.col("body"), "title").alias("own"), F.coalesce(_scalar(F.col("body"), "public_title"), _scalar(F.col("body"), "title"), values, F.lit("")).alias("title"))
    holders = bridge.where("role = 'holder'").join(fields, "hash").select("doc", "occ", F.col("hash").alias("holder_hash"), F.col("id").alias("holder_id"), F.col("own").alias("holder_title"))
    rows = bridge.where("role = 'row' and holder_hash is not null").join(fields.select("hash", F.col("id").alias("row_id"), "title"), "hash")
    rows = rows.join(fields.select(F.col("hash").alias("holder_hash"), F.col("id").alias("holder_id")), "holder_hash")
    return holders, rows.select("doc", "occ", "holder", "ordinal", "holder_id", "row_id", "title")
