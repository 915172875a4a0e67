"""Small helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts' word patterns.
BLANKS = "\t\n\x0b\f\r "
BLANK_RUN = "[\\x20\\x09-\\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def aside(docs: DataFrame, own: tuple[str, ...]) -> tuple[DataFrame, dict[str, str]]:
    """`docs` with those of its columns that an operator uses a name of (`own`, in any case) under names it lacks, and
    the way back for withColumnsRenamed: so a table's own columns come out as they went in."""
    taken, back = {c.lower() for c in (*docs.columns, *own)}, {}
    for c in docs.columns:
        if c.lower() in {o.lower() for o in own}:
            name = f"{c}_"
            while name.lower() in taken:
                name += "_"
            taken.add(name.lower())
            back[name] = c
    return docs.withColumnsRenamed({c: n for n, c in back.items()}), back


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z alone; a null text is empty."""
    return F.translate(F.coalesce(c, F.lit("")), UPPER, LOWER)


def split_words(c: Column, separators: str, trimmed: str | None = None) -> Column:
    """The words of `c`: what stands between runs of the separator class (a regex class body)."""
    inner = (
        F.btrim(c, F.lit(trimmed)) if trimmed is not None else F.regexp_replace(c, f"^[{separators}]+|[{separators}]+$", "")
    )
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, f"[{separators}]+"))


def word_count(c: Column) -> Column:
    """Number of runs of characters other than white space; null counts as empty."""
    inner = F.btrim(F.coalesce(c, F.lit("")), F.lit(BLANKS))
    return F.when(inner == "", F.lit(0)).otherwise(F.size(F.split(inner, BLANK_RUN))).cast("long")


def finite_vectors(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(rows, start, end, x): the rows of a batch whose list is not null and holds neither nulls nor non-finite
    numbers, and their bounds in x, the batch's numbers as doubles."""
    offsets = column.offsets.to_numpy()
    x = column.values.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
    bad = np.concatenate(([0], np.cumsum(~np.isfinite(x))))
    rows = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False) & (bad[offsets[1:]] == bad[offsets[:-1]]))
    return rows, offsets[rows], offsets[rows + 1], x


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, or below the checkpoint folder that the context was given.

    Without either it is an error, but in local mode: a folder of each machine's own would lose rows on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not found.isDefined() and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        base = found.get() if found.isDefined() else tempfile.mkdtemp(prefix="cashtide-")
    return f"{base.rstrip('/')}/cashtide-{uuid.uuid4().hex}"


def saved(df: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes `df` to a folder of shared_dir, the given one or a new one, and reads it again: cuts the lineage, survives
    lost executors."""
    spark = df.sparkSession
    path = folder or shared_dir(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, folder: str) -> None:
    """Deletes a folder that saved() wrote, once nothing will read it any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Size of the set of `likely`: 4 MB.
BITS = 1 << 25


def bit_rows(keys: DataFrame, place: Column) -> DataFrame:
    """(k, bits): the bits at `place` (from 0) of all rows, in rows of 32768 bits, set on the executors."""
    return (
        keys.select((place + 1).alias("p"))
        .groupBy(F.bitmap_bucket_number("p").alias("k"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits"))
    )


def bit_set(keys: DataFrame, place: Column, bits: int) -> np.ndarray:
    """The rows of bit_rows as one array of bits / 8 bytes, however many keys there are."""
    found = np.zeros(bits // 8, np.uint8)
    for r in bit_rows(keys, place).toLocalIterator():
        b = np.frombuffer(bytes(r["bits"]), np.uint8)
        found[(r["k"] - 1) * 4096 :][: len(b)] = b
    return found


def likely(rows: DataFrame, key: str, keys: DataFrame, bits: int = BITS, without: bool = False) -> DataFrame:
    """The rows whose `key` may be in `keys`, or (without) those whose key certainly is not, by a bit set of fixed
    size: bits / 8 bytes are broadcast, however many keys there are. Null keys are certainly not in it.

    An exact join of the first part has to follow; with very many keys the set rules out less, which costs shuffle
    but no result."""
    place = F.pmod(F.xxhash64(key), F.lit(bits))
    held = saved(bit_rows(keys.where(F.col(key).isNotNull()), place).select(F.col("k").alias("_k"), F.col("bits").alias("_bits")))
    at = F.bitmap_bit_position(place + 1).cast("int")
    byte = F.conv(F.hex(F.substring(F.col("_bits"), F.shiftright(at, 3) + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(byte.bitwiseAND(F.pow(F.lit(2), at % 8).cast("int")) != 0, F.lit(False))
    met = rows.join(F.broadcast(held), F.col(key).isNotNull() & (F.bitmap_bucket_number(place + 1) == F.col("_k")), "left")
    return met.where(~hit if without else hit).select(*rows.columns)


def thinned(edges: DataFrame) -> DataFrame:
    """Links (a, b), a < b, that connect what the links of `edges` connect: of the smaller neighbours of each node only the
    smallest one stays linked with it, and the others are linked with that one instead. Nodes that hang together by
    the same few hubs keep about one link each, however many of the hubs each is linked with."""
    e = edges.where("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    e = saved(e.distinct())
    low = e.groupBy(F.col("b").alias("_b")).agg(F.min("a").alias("low"))
    others = e.join(low, F.col("b") == F.col("_b")).where("a <> low").select(F.col("low").alias("a"), F.col("a").alias("b"))
    return low.select(F.col("low").alias("a"), F.col("_b").alias("b")).unionAll(others).distinct()


def components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """Connected components of a table of links: (node, component), component being the smallest node reachable.

    First the links are thinned (see thinned). Every round replaces each node's label by the smallest label among its
    neighbours and then follows the label's own label (pointer jumping), so long chains shorten by doubling. One joined,
    aggregated and saved table a round; nothing but a count of changes reaches the driver. Nodes that have no link
    are not returned. Null ends are ignored, repeated links and loops do no harm.
    """
    e = saved(thinned(edges.select(F.col(left).alias("a"), F.col(right).alias("b"))))
    both = saved(e.unionAll(e.select(F.col("b"), F.col("a"))))
    labels = saved(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")))
    while True:
        near = (
            both.join(labels.select(F.col("node").alias("b"), "component"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("component").alias("low"))
        )
        step = labels.join(near, "node", "left").select(
            "node", F.col("component").alias("was"), F.least("component", F.coalesce("low", "component")).alias("low")
        )
        own = labels.select(F.col("node").alias("low"), F.col("component").alias("far"))
        step = saved(
            step.join(own, "low", "left").select("node", "was", F.least("low", F.coalesce("far", "low")).alias("component"))
        )
        labels = step.select("node", "component")
        if step.where("component < was").limit(1).count() == 0:
            return labels
