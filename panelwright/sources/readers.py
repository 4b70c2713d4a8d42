"""Sources: all-text CSV with notes, latest file, capture indexes, and JSON inside pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from panelwright.operators.nested import _walk, decode_after, decode_all


def read_text_csv(spark: SparkSession, path: str, notes: str | None = None) -> DataFrame:
    """A CSV with a header as text columns; blanks are null. Lines that begin with `notes` (say, #) and a byte order mark are skipped."""
    reader = spark.read.option("header", True).option("nullValue", "").option("quote", '"').option("escape", '"').option("multiLine", notes is None)
    if notes:
        reader = reader.option("comment", notes)
    return reader.csv(path)


def latest_file(spark: SparkSession, pattern: str) -> str:
    """The last by name of the files that match a pattern; FileNotFoundError for none."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    names = sorted(str(f.getPath()) for f in found or [])
    if not names:
        raise FileNotFoundError(pattern)
    return names[-1]


def capture_index(lines: DataFrame, body: str, keys: list[str]) -> DataFrame:
    """keys, ts, url, first_position from JSON lists of [timestamp, url] rows with a header row: of equal timestamps the last URL at the first place."""
    rows = F.from_json(F.coalesce(body, F.lit("[]")), "array<array<string>>")
    at = lines.select(*keys, F.posexplode(rows).alias("pos", "r")).where("pos > 0").select(*keys, "pos", F.col("r").getItem(0).alias("ts"), F.col("r").getItem(1).alias("url"))
    return at.groupBy(*keys, "ts").agg(F.max_by("url", "pos").alias("url"), F.min("pos").alias("first_position"))


def snapshot_url(ts: Column, url: Column) -> Column:
    return F.concat(F.lit("https://web.archive.org/web/"), ts, F.lit("/"), url)


def served_stamp(final_url: Column, requested: Column) -> Column:
    """The timestamp of the capture that was really served, from the final URL; else the one asked for."""
    found = F.regexp_extract(final_url, r"/web/(\d{14})", 1)
    return F.when(found != "", found).otherwise(requested)


def embedded_json(pages: DataFrame, key: str, html: str, marker: str | None = None) -> DataFrame:
    """key, n, json: the complete JSON values that a page is or that its script text assigns, in their order (n), as canonical JSON.

    With a marker only the value right after its first place counts. Pages without one are left out.
    """
    import json

    import pyarrow as pa

    def canonical(value) -> str:
        try:
            return json.dumps(value, ensure_ascii=True, sort_keys=True)
        except RecursionError:
            return _walk([value], "")[-1][5]  # deeper than the encoder goes: its own fields, objects inside by their hash

    def run(batches):
        for b in batches:
            at, n, values = [], [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                found = decode_all(t) if marker is None else [decode_after(t, marker)]
                for k, v in enumerate(found):
                    if v is not None:
                        at.append(i)
                        n.append(k)
                        values.append(canonical(v))
            if at:
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array(n, pa.int32()), pa.array(values)], names=[key, "n", "json"])

    return pages.select(key, html).mapInArrow(run, f"{key} {pages.schema[key].dataType.simpleString()}, n int, json string")


def first_rows(rows: DataFrame, by: list[str], *order: str | Column) -> DataFrame:
    """The first row of each group in the given order."""
    return rows.withColumn("__r", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where("__r = 1").drop("__r")
