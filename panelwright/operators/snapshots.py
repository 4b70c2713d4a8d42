"""What changed between consecutive full snapshots: persistent ordinals, bitmaps and aligned value vectors."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from panelwright.session import Scratch

#: Rows per ordinal space; a source with more rows gets several spaces, so that none is numbered in one task.
SPACE = 1 << 16
#: Keys per bitmap word.
BITS = 64


class Ordinals:
    """A stored dictionary: the ordinal of each key in its source's space. What is in it never changes; runs add to it.

    A run's additions are a folder of their own, `keys` (s, sp, k, o) and `spaces` (s, spaces: the sources that have
    several), renamed into place when it is whole. A source keeps the number of spaces it was first seen with.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(self.root))

    def _runs(self) -> list[str]:
        return sorted(n for n in (f.getPath().getName() for f in self._fs.listStatus(self._path(self.root))) if n.isdigit())

    def read(self, table: str, schema: T.StructType) -> DataFrame:
        at = [f"{self.root}/{n}/{table}" for n in self._runs()]
        return self.spark.read.schema(schema).parquet(*at) if at else self.spark.createDataFrame([], schema)

    def add(self, **tables: DataFrame) -> None:
        new = f"{self.root}/.{uuid.uuid4().hex}"
        for name, df in tables.items():
            df.write.parquet(f"{new}/{name}")
        runs = self._runs()
        if not self._fs.rename(self._path(new), self._path(f"{self.root}/{int(runs[-1]) + 1 if runs else 0:06d}")):
            raise OSError("the ordinals could not be stored")


def key_ordinals(rows: DataFrame, source: Column, key: Column, store: str, *, space: int = SPACE) -> tuple[DataFrame, DataFrame]:
    """(keys, spaces) of the dictionary stored at `store`, after the keys of `rows` that it lacks have been added.

    keys: s, sp, k, o; a new key gets the next free ordinal of its space, in order of the keys. spaces: s, spaces.
    Keys are shuffled by source and space once; rows with a null key are left out; a null source is a source.
    """
    spark = rows.sparkSession
    base = rows.select(source.alias("s"), key.alias("k")).where("k is not null")
    kinds = {f.name: f.dataType for f in base.schema.fields}
    schemas = {"keys": T.StructType([T.StructField("s", kinds["s"]), T.StructField("sp", T.LongType()), T.StructField("k", kinds["k"]), T.StructField("o", T.LongType())]), "spaces": T.StructType([T.StructField("s", kinds["s"]), T.StructField("spaces", T.LongType())])}
    held = Ordinals(spark, store)
    known, spaces = held.read("keys", schemas["keys"]), held.read("spaces", schemas["spaces"])
    scratch = Scratch(spark, "ordinals")
    big = base.groupBy("s").agg(F.ceil(F.count(F.lit(1)) / space).alias("spaces")).where("spaces > 1")
    if held._runs():
        seen = known.select(F.col("s").alias("ks")).distinct()
        big = big.join(seen, F.col("s").eqNullSafe(F.col("ks")), "left_anti")
    big, _ = scratch.write(big)
    every = spaces.unionByName(big)
    at = _spaced(base, every).select("s", "sp", "k", F.lit(None).cast("long").alias("o")).unionByName(known)
    per = at.repartition("s", "sp").groupBy("s", "sp", "k").agg(F.max("o").alias("o"))
    w = W.partitionBy("s", "sp")
    free = F.coalesce(F.max("o").over(w) + 1, F.lit(0))
    number = F.row_number().over(W.partitionBy("s", "sp", F.col("o").isNull()).orderBy("k")) - 1
    new = per.withColumns({"free": free, "number": number}).where("o is null").select("s", "sp", "k", (F.col("free") + F.col("number")).alias("o"))
    new, added = scratch.write(new)
    if added["rows"]:
        held.add(keys=new, spaces=big)
    return held.read("keys", schemas["keys"]), held.read("spaces", schemas["spaces"])


def _spaced(rows: DataFrame, spaces: DataFrame) -> DataFrame:
    """rows (s, k, ..) with sp, the space of the key; spaces holds the sources that have more than one."""
    # a written table of the largest sources: the planner knows its size, and broadcasts it where it is small
    at = spaces.select(F.col("s").alias("ls"), "spaces")
    return rows.join(at, F.col("s").eqNullSafe(F.col("ls")), "left").withColumn("sp", F.pmod(F.xxhash64("k"), F.coalesce("spaces", F.lit(1)))).drop("ls", "spaces")


def snapshot_changes(rows: DataFrame, source: Column, key: Column, period: Column, version: Column, value: Column, *, tolerance: float = 0.005, space: int = SPACE, store: str | None = None) -> DataFrame:
    """Records added, removed or changed between each snapshot of a source and its next.

    rows: all snapshots; a source's snapshots are the periods in which it has rows, in order. Of the rows
    of a key in a snapshot, the one with the greatest version counts; of copies, the least value that is
    not null. Returns source, key, period (of the later snapshot) and change_kind: `added`, `removed`, or
    `changed` where the value differs by `tolerance` or more, or is null on one side only.

    The keys of a source have dense ordinals within spaces, from the dictionary stored at `store` (see
    key_ordinals), which persist from run to run; without one they are made for this run. A snapshot is, per
    space, a sparse bitmap of 64-bit words with a vector of values per word, aligned by ordinal. Additions
    are `cur AND NOT prev`, removals `prev AND NOT cur`, changes come from the vectors where both bits are
    set. Vectors hold ordinals and values only; ordinals become keys again at the end. Rows are shuffled once,
    with their dictionary entries, by source and space, so that a source with most of the rows is spread;
    all else happens where they are. Rows without a period are left out; rows without a key only show that
    the snapshot exists; rows without a source are one source; null versions are least; NaN counts as null.
    """
    x = F.nanvl(value.cast("double"), F.lit(None).cast("double"))
    scratch = Scratch(rows.sparkSession, "snapshots")
    dictionary, spaces = key_ordinals(rows.where(period.isNotNull()), source, key, store or f"{scratch.root}/store", space=space)
    base = rows.select(source.alias("s"), key.alias("k"), period.alias("q"), F.coalesce(version.cast("string"), F.lit("")).alias("ver"), x.alias("x")).where("q is not null")
    # a source that has several spaces does not see all its snapshots in each of them
    snaps = base.join(spaces.select(F.col("s").alias("ls")), F.col("s").eqNullSafe(F.col("ls")), "left_semi").groupBy(F.col("s").alias("as_")).agg(F.array_sort(F.collect_set("q")).alias("all"))
    snaps, _ = scratch.write(snaps)

    entries = dictionary.select("s", "sp", "k", "o", *[F.lit(None).cast(dict(base.dtypes)[c]).alias(c) for c in ("q", "ver", "x")])
    spread = _spaced(base, spaces).withColumn("o", F.lit(None).cast("long")).unionByName(entries).repartition("s", "sp")
    counting = spread.groupBy("s", "sp", "k", "q").agg(F.max_by("x", F.struct("ver", F.col("x").isNotNull(), -F.col("x"))).alias("x"), F.max("o").alias("o"))
    keys = counting.groupBy("s", "sp", "k").agg(F.max("o").alias("o"), F.collect_list(F.when(F.col("q").isNotNull(), F.struct("q", "x"))).alias("at")).where("size(at) > 0")

    # one row per word and snapshot, and one per word (without a snapshot) that has its keys
    word, bit = F.coalesce(F.floor(F.col("o") / BITS), F.lit(-1)), (F.col("o") % BITS).cast("int")
    null = lambda c: F.lit(None).cast(dict(keys.select("k", "at.q", "at.x").dtypes)[c].removeprefix("array<").removesuffix(">"))
    cell = lambda q, v, k: F.struct(q.alias("q"), v.alias("x"), k.alias("k"))
    own = F.when(F.col("k").isNotNull(), F.array(cell(null("q"), null("x"), F.col("k")))).otherwise(F.array().cast(f"array<struct<q:{dict(base.dtypes)['q']},x:double,k:{dict(base.dtypes)['k']}>>"))
    cells = keys.select("s", "sp", word.alias("w"), bit.alias("b"), F.explode(F.concat(own, F.transform("at", lambda a: cell(a["q"], a["x"], null("k"))))).alias("c"))
    here = F.col("c.q").isNotNull() & F.col("b").isNotNull()
    words = cells.groupBy("s", "sp", "w", F.col("c.q").alias("q")).agg(
        F.coalesce(F.bit_or(F.when(here, F.call_function("shiftleft", F.lit(1).cast("long"), F.col("b")))), F.lit(0).cast("long")).alias("bits"),
        F.array_sort(F.collect_list(F.when(here, F.struct("b", F.col("c.x").alias("x"))))).alias("vec"),
        F.map_from_entries(F.collect_list(F.when(F.col("c.k").isNotNull(), F.struct("b", F.col("c.k").alias("k"))))).alias("ks"),
    )
    words = words.join(snaps, F.col("s").eqNullSafe(F.col("as_")), "left")
    words = words.withColumn("snaps", F.coalesce("all", F.array_sort(F.collect_set("q").over(W.partitionBy("s", "sp")))))
    words = words.withColumn("i", F.array_position("snaps", F.col("q")))
    by = W.partitionBy("s", "sp", "w").orderBy("q")
    whole = by.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    words = words.withColumns({"pi": F.lag("i").over(by), "pbits": F.lag("bits").over(by), "pvec": F.lag("vec").over(by), "ni": F.lead("i").over(by), "ks": F.first(F.when(F.col("q").isNull(), F.col("ks")), True).over(whole)})
    words = words.where("q is not null and w >= 0")

    follows = F.coalesce(F.col("pi") == F.col("i") - 1, F.lit(False))
    none = F.lit(0).cast("long")
    prev = F.when(follows, F.col("pbits")).otherwise(none)
    added, gone = F.col("bits").bitwiseAND(F.bitwise_not(prev)), prev.bitwiseAND(F.bitwise_not(F.col("bits")))
    both = F.col("bits").bitwiseAND(prev)
    has = lambda m, e: F.call_function("shiftrightunsigned", m, e["b"]).bitwiseAND(F.lit(1).cast("long")) == 1
    kind = words.schema["vec"].dataType

    def pick(vec: Column, bits: Column) -> Column:
        return F.when(bits != 0, F.filter(vec, lambda e: has(bits, e))).otherwise(F.array().cast(kind))

    empty = F.array().cast("array<int>")
    bits_of = lambda vec: F.transform(vec, lambda e: e["b"])
    moved = F.zip_with(pick(F.col("vec"), both), pick(F.col("pvec"), both), lambda c, p: F.when(F.coalesce(F.abs(c["x"] - p["x"]) >= tolerance, c["x"].isNull() != p["x"].isNull()), c["b"]))
    last = F.col("i") == F.size("snaps")
    # a word that is absent from the next snapshot has lost all its keys there
    lost = F.when(~last & ~F.coalesce(F.col("ni") == F.col("i") + 1, F.lit(False)), bits_of(F.col("vec"))).otherwise(empty)
    named = lambda bs, q, name: F.transform(bs, lambda b: F.struct(b.alias("b"), q.alias("q"), F.lit(name).alias("kind")))
    found = F.concat(
        named(F.when(F.col("i") > 1, bits_of(pick(F.col("vec"), added))).otherwise(empty), F.col("q"), "added"),
        named(bits_of(pick(F.coalesce("pvec", F.array().cast(kind)), gone)), F.col("q"), "removed"),
        named(F.filter(moved, lambda b: b.isNotNull()), F.col("q"), "changed"),
        named(lost, F.try_element_at("snaps", F.col("i").cast("int") + 1), "removed"),
    )
    return words.select("s", "ks", F.explode(found).alias("c")).select(F.col("s").alias("source"), F.element_at("ks", F.col("c.b")).alias("key"), F.col("c.q").alias("period"), F.col("c.kind").alias("change_kind"))
