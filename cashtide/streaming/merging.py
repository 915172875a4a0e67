"""Tables that a stream keeps merged: small folders of changes beside a base, compacted now and then.

Layout below a path: `base/gen=N` is the merged table of generation N, `delta/gen=N/...` what came while N was the newest.
The merge has to ignore order and repetition (see operators/feed.merged), so a batch that is run again, or whose changes are
already in a base, does no harm: every row counts exactly once whatever fails and restarts."""

from __future__ import annotations

import functools
import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..operators import balances, feed

Merge = Callable[[DataFrame], DataFrame]


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, at = _fs(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []


def _whole(spark: SparkSession, path: str) -> bool:
    fs, at = _fs(spark, f"{path}/_SUCCESS")
    return fs.exists(at)


def generation(spark: SparkSession, path: str) -> int:
    """The newest generation whose base is written whole; 0 before the first compaction."""
    found = [int(n.removeprefix("gen=")) for n in _names(spark, f"{path}/base") if n.startswith("gen=")]
    return max((n for n in found if _whole(spark, f"{path}/base/gen={n}")), default=0)


def _parts(spark: SparkSession, path: str, gen: int) -> list[str]:
    """Folders that make up the table at a generation: its base and the whole changes since."""
    base = [f"{path}/base/gen={gen}"] if gen else []
    deltas = [f"{path}/delta/gen={gen}/{n}" for n in sorted(_names(spark, f"{path}/delta/gen={gen}"))]
    return base + [d for d in deltas if _whole(spark, d)]


def current(spark: SparkSession, path: str, schema: StructType | str, merge: Merge = feed.merged) -> DataFrame:
    """The table now."""
    parts = _parts(spark, path, generation(spark, path))
    rows = spark.read.schema(schema).parquet(*parts) if parts else spark.createDataFrame([], schema)
    return merge(rows)


def compact(spark: SparkSession, path: str, schema: StructType | str, merge: Merge = feed.merged) -> int:
    """Writes the next generation's base and drops what is two generations old; readers of the last one go on undisturbed."""
    gen = generation(spark, path)
    current(spark, path, schema, merge).write.mode("overwrite").parquet(f"{path}/base/gen={gen + 1}")
    for kind in ("base", "delta"):
        for name in _names(spark, f"{path}/{kind}"):
            if name.startswith("gen=") and int(name.removeprefix("gen=")) < gen:
                fs, at = _fs(spark, f"{path}/{kind}/{name}")
                fs.delete(at, True)
    return gen + 1


def _token(spark: SparkSession, checkpoint: str) -> str:
    """Names a checkpoint's batches apart from those of another one, a lost and newly made one included."""
    fs, folder = _fs(spark, f"{checkpoint}/token")
    if not fs.exists(folder):
        fs.mkdirs(folder)
        fs.mkdirs(_fs(spark, f"{checkpoint}/token/{uuid.uuid4().hex}")[1])
    return hashlib.sha256("".join(sorted(_names(spark, f"{checkpoint}/token"))).encode()).hexdigest()[:16]


def keep(stream: DataFrame, path: str, checkpoint: str, merge: Merge = feed.merged, every: int = 16, **trigger):
    """Starts a query that keeps `stream` merged below `path`, read by current(); every so many batches it compacts.

    A batch writes its own merged rows only, so it costs what it holds; the table as a whole is rewritten once in
    `every` batches. `trigger` is that of the writer, all that is there if none is given."""
    spark, schema = stream.sparkSession, stream.schema
    token = _token(spark, checkpoint)

    def write(batch: DataFrame, number: int) -> None:
        own = batch.sparkSession
        gen = generation(own, path)
        merge(batch).write.mode("overwrite").parquet(f"{path}/delta/gen={gen}/{token}-{number}")
        if len(_names(own, f"{path}/delta/gen={gen}")) >= every:
            compact(own, path, schema, merge)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def keep_transactions(stream: DataFrame, path: str, checkpoint: str, every: int = 16, **trigger):
    """Keeps pulled transactions (id, fetched_at, seq and content) merged by id; read with current() and table_schema()."""
    return keep(feed.pulled(stream), path, checkpoint, feed.merged, every, **trigger)


def table_schema(pulled: StructType) -> StructType:
    """Schema of the kept table for pulled rows of this schema."""
    at = pulled["fetched_at"].dataType
    return functools.reduce(lambda s, c: s.add(c, at), (feed.FIRST, feed.LAST), StructType(list(pulled.fields)))


def latest(rows: DataFrame) -> DataFrame:
    """Merge of balance observations: the latest per account, by hand first."""
    return balances.latest(rows).select(*rows.columns)
