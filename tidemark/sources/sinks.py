"""Sinks whose effects happen once: idempotent upserts, per-batch files, and a ledger of batches."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _exists(df: DataFrame, path: str) -> bool:
    jvm = df.sparkSession._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).exists(at)


def per_batch_files(path: str, fmt: str = "parquet") -> Callable[[DataFrame, int], None]:
    """foreachBatch: batch n replaces folder batch=n, so a replay writes the same rows again, once."""

    def write(df: DataFrame, batch: int) -> None:
        df.write.format(fmt).mode("overwrite").save(f"{path}/batch={batch}")

    return write


def upsert_files(path: str, keys: Sequence[str], seq: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch: the latest row of each key by ``seq``, as a new version of the table for every batch.

    Replaying a batch gives the same version.  ``current(spark, path)`` reads the newest.
    """

    def write(df: DataFrame, batch: int) -> None:
        rows = df
        earlier = [v for v in _versions(df, path) if v < batch]
        if earlier:
            rows = rows.unionByName(df.sparkSession.read.parquet(f"{path}/v={max(earlier)}"))
        rest = [c for c in df.columns if c not in keys]
        latest = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), seq).alias("_row")).select(*keys, "_row.*")
        latest.write.mode("overwrite").parquet(f"{path}/v={batch}")

    return write


def _versions(df: DataFrame, path: str) -> list[int]:
    if not _exists(df, path):
        return []
    jvm = df.sparkSession._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).listStatus(at)
    names = [s.getPath().getName() for s in found]
    return sorted(int(n[2:]) for n in names if n.startswith("v="))


def current(spark, path: str) -> DataFrame:
    versions = _versions(spark.range(0), path)
    if not versions:
        raise ValueError(f"{path} has no version yet")
    return spark.read.parquet(f"{path}/v={versions[-1]}")


def transactional(begin: Callable[[int], bool], write: Callable[[DataFrame, int], None], commit: Callable[[int], None], abort: Callable[[int], None]) -> Callable[[DataFrame, int], None]:
    """foreachBatch over a two-phase target: ``begin`` is false for a batch that was committed before."""

    def run(df: DataFrame, batch: int) -> None:
        if not begin(batch):
            return
        try:
            write(df, batch)
        except BaseException:
            abort(batch)
            raise
        commit(batch)

    return run


def kafka_sink(df: DataFrame, servers: str, topic: str, key: str, value: str, checkpoint: str):
    """At least once: consumers drop repeats by (batch, key).  Needs Spark's Kafka connector."""
    out = df.select(F.col(key).cast("string").alias("key"), F.col(value).cast("binary").alias("value"))
    return out.writeStream.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).option("checkpointLocation", checkpoint)
