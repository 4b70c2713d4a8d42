"""Calling an outside provider for rows in batches: cached answers, one retry per item, statuses. The provider is given; nothing here goes out by itself."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.session import Scratch


class Provider(Protocol):
    """Answers a batch of (ref, prompt) with {ref: answer}; refs without an answer may be missing."""

    def __call__(self, batch: list[tuple[str, str]]) -> dict[str, str]: ...


class Failed(Exception):
    """The provider can't be used: no key, no quota, no network."""


class Retryable(Failed):
    """A failure that is worth another try."""


def with_backoff(call: Callable, waits: tuple[float, ...] = (2, 4, 8, 16, 32), most: float = 60, sleep: Callable[[float], None] = time.sleep):
    """call(), tried again after each of the waits while it raises Retryable."""
    for wait in waits:
        try:
            return call()
        except Retryable:
            sleep(min(wait, most) + random.random())
    return call()


def cache_key(provider: str, model: str, prompt: Column) -> Column:
    return F.sha2(F.concat_ws("\0", F.lit(provider), F.lit(model), prompt), 256)


def answers(rows: DataFrame, ref: str, prompt: str, provider: Provider, *, valid: Callable[[str], bool] = bool, batch: int = 5, calls: int | None = None, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """ref, answer, status (`ok`, `ok_after_retry`, `invalid_or_missing`, `pending`) for each row.

    Rows go out in batches; items without a valid answer go out once more, alone. `calls` is the number of calls
    of all tasks together: the rows that they can reach, in order of ref, are asked for in one task, and what
    is left is `pending`. A call that fails for good (Failed, OSError or RuntimeError, after the waits of with_backoff) leaves
    its items and those after it in its task pending; errors of the program itself are raised.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, broken = calls, False

        def ask(items: list[tuple[str, str]]) -> dict[str, str] | None:
            nonlocal left, broken
            if broken or left is not None and left <= 0:
                return None
            left = left if left is None else left - 1
            try:
                return {k: v for k, v in (with_backoff(lambda: provider(items), sleep=sleep) or {}).items() if valid(v)}
            except (Failed, OSError, RuntimeError):
                broken = True
                return None

        for b in batches:
            todo = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
            out: list[tuple] = []
            for at in range(0, len(todo), batch):
                part = todo[at : at + batch]
                first = ask(part)
                for item in part:
                    if first is not None and item[0] in first:
                        out.append((item[0], first[item[0]], "ok"))
                        continue
                    again = ask([item]) if first is not None else None
                    if again is None:
                        out.append((item[0], None, "pending"))
                    else:
                        out.append((item[0], again.get(item[0]), "ok_after_retry" if item[0] in again else "invalid_or_missing"))
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.string()) for i in range(3)], names=["ref", "answer", "status"])

    asked = rows.select(F.col(ref).cast("string").alias("ref"), F.col(prompt).alias("prompt"))
    kind = "ref string, answer string, status string"
    if calls is None:
        return asked.mapInArrow(run, kind)
    first = asked.orderBy("ref", "prompt").limit(calls * batch)  # all that the calls can reach
    seen = first.select("ref").distinct()
    rest = asked.join(seen, "ref", "left_anti").select("ref", F.lit(None).cast("string").alias("answer"), F.lit("pending").alias("status"))
    return first.coalesce(1).mapInArrow(run, kind).unionByName(rest)


def cached_answers(rows: DataFrame, cache: DataFrame, ref: str, prompt: str, provider: Provider, *, name: str, model: str, **kw) -> tuple[DataFrame, DataFrame]:
    """(answers of all rows, new cache entries): prompts that the cache (key, answer) has are not asked again; equal prompts are asked once."""
    keyed = rows.select(F.col(ref).cast("string").alias("ref"), F.col(prompt).alias("__p"), cache_key(name, model, F.col(prompt)).alias("key"))
    known = keyed.join(cache.select("key", "answer"), "key").select("ref", "answer", F.lit("ok").alias("status"))
    fresh = keyed.join(cache.select("key"), "key", "left_anti")
    # written once: a lost executor must not send the questions again
    asked, _ = Scratch(rows.sparkSession, "answers").write(answers(fresh.groupBy("key").agg(F.min("__p").alias("__p")), "key", "__p", provider, **kw).withColumnRenamed("ref", "key"))
    new = fresh.select("ref", "key").join(asked, "key").select("ref", "answer", "status")
    return known.unionByName(new), asked.where("status like 'ok%'").select("key", "answer")
