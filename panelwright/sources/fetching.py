"""Polite fetching into a cache of landed bytes. It runs on the driver, outside of plans; what it lands is read as a source. The getter is given; nothing here goes out by itself."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable
from datetime import UTC, datetime
from pathlib import Path
from typing import NamedTuple
from urllib.parse import urlsplit
from urllib.robotparser import RobotFileParser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.functions.text import strip_tags


class Response(NamedTuple):
    status: int
    body: bytes
    final_url: str = ""


class Disallowed(Exception):
    """The site's robots.txt forbids the address, or can't be read."""


class Limiter:
    """Waits so that calls for one key are at least `gap` seconds apart."""

    def __init__(self, gap: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.gap, self.clock, self.sleep = gap, clock, sleep
        self._last: dict[str, float] = {}

    def wait(self, key: str) -> None:
        if key in self._last and (left := self._last[key] + self.gap - self.clock()) > 0:
            self.sleep(left)
        self._last[key] = self.clock()


def cache_path(root: str | Path, url: str, snapshot: str | None = None) -> tuple[Path, Path]:
    """(body, meta) of a URL below root: by host, for pages kept as a dated series also by snapshot; named by the URL's hash."""
    folder = Path(root) / urlsplit(url).netloc.replace(":", "_")
    if snapshot:
        folder = folder / "snapshots" / snapshot
    key = hashlib.sha256(url.encode()).hexdigest()[:24]
    return folder / f"{key}.body", folder / f"{key}.meta.json"


def cache_key(url: Column) -> Column:
    """The name of a URL in the cache, as a column."""
    return F.substring(F.sha2(url, 256), 1, 24)


class Fetcher:
    """fetch() returns a landed body, or gets, lands and returns it: only if robots.txt allows it, spaced out per host, and only when it was answered with 200."""

    def __init__(self, root: str | Path, get: Callable[[str, float], Response], agent: str, gap: float = 5.0, limiter: Limiter | None = None):
        self.root, self.get, self.agent = Path(root), get, agent
        self.limiter = limiter or Limiter(gap)
        self._robots: dict[str, tuple[RobotFileParser, str]] = {}

    def cached(self, url: str, snapshot: str | None = None) -> bytes | None:
        body, meta = cache_path(self.root, url, snapshot)
        return body.read_bytes() if body.exists() and meta.exists() else None  # a body without its meta was cut off

    def meta(self, url: str, snapshot: str | None = None) -> dict | None:
        _, meta = cache_path(self.root, url, snapshot)
        return json.loads(meta.read_text()) if meta.exists() else None

    def robots(self, url: str) -> tuple[bool, str]:
        """(allowed, status): found (its rules hold), missing (all is allowed), blocked or error (nothing is)."""
        parts = urlsplit(url)
        if parts.netloc not in self._robots:
            parser = RobotFileParser()
            self.limiter.wait(parts.netloc)
            try:
                r = self.get(f"{parts.scheme}://{parts.netloc}/robots.txt", 20)
                status = "found" if r.status == 200 else "blocked" if r.status in (401, 403) else "error" if r.status >= 500 else "missing"
            except OSError:
                r, status = None, "error"
            if status == "found":
                parser.parse(r.body.decode("utf-8", "replace").splitlines())
            else:
                parser.allow_all, parser.disallow_all = status == "missing", status != "missing"
            self._robots[parts.netloc] = parser, status
        parser, status = self._robots[parts.netloc]
        return parser.can_fetch(self.agent, url), status

    def fetch(self, url: str, refresh: bool = False, timeout: float = 30, snapshot: str | None = None) -> bytes:
        if not refresh and (held := self.cached(url, snapshot)) is not None:
            return held
        if not self.robots(url)[0]:
            raise Disallowed(url)
        self.limiter.wait(urlsplit(url).netloc)
        r = self.get(url, timeout)
        if r.status != 200:
            raise OSError(f"{r.status} for {url}")
        body, meta = cache_path(self.root, url, snapshot)
        body.parent.mkdir(parents=True, exist_ok=True)
        body.write_bytes(r.body)
        meta.write_text(json.dumps({"url": url, "final_url": r.final_url or url, "status": r.status, "fetched_at": datetime.now(UTC).isoformat()}))
        return r.body


def twice(call: Callable, *args):
    """call(*args), tried once more if it fails."""
    try:
        return call(*args)
    except Exception:
        return call(*args)


def catalogue_pages(fetch: Callable[[str], bytes], url: Callable[[int], str], most: int = 5) -> list[tuple[int, str, str]]:
    """(page, url, body) of a live catalogue, page by page up to the first without products."""
    out = []
    for page in range(1, most + 1):
        body = fetch(url(page)).decode("utf-8", "replace")
        if not json.loads(body).get("products"):
            break
        out.append((page, url(page), body))
    return out


def listing_pages(first: set[int], fetch: Callable[[int], str | None], linked: Callable[[str], set[int]]) -> tuple[dict[int, str], set[int]]:
    """(pages found, pages expected): later pages may link to pages that the first did not; each is tried once, the least number first."""
    expected, tried, found = set(first), set(), {}
    while left := expected - tried:
        n = min(left)
        tried.add(n)
        if (html := fetch(n)) is not None:
            found[n] = html
            expected |= linked(html)
    return found, expected


def cached_pages(rows: DataFrame, cache: DataFrame) -> DataFrame:
    """rows (served_ts, requested_ts, source_url) with html: the landed page (ts, url, body) of the time served, else of the time asked for, else null."""
    c = cache.groupBy("ts", "url").agg(F.min("body").alias("body"))
    side = lambda ts, name: c.select(F.col("ts").alias(ts), F.col("url").alias("source_url"), F.col("body").alias(name))
    j = rows.join(side("served_ts", "__s"), ["served_ts", "source_url"], "left").join(side("requested_ts", "__r"), ["requested_ts", "source_url"], "left")
    return j.withColumn("html", F.coalesce("__s", "__r")).drop("__s", "__r")


def descriptions(pages: DataFrame, roaster: str, body: str) -> DataFrame:
    """roaster, product_id, description: the text of each product of a live catalogue's pages; the last page counts."""
    kind = "struct<products:array<struct<id:string,body_html:string>>>"
    p = pages.select(roaster, "page", F.explode(F.from_json(body, kind)["products"]).alias("p"))
    return p.groupBy(F.col(roaster).alias("roaster"), F.col("p.id").alias("product_id")).agg(strip_tags(F.max_by("p.body_html", "page")).alias("description"))
