"""Sources: lists, replayable logs, decoding with a dead-letter table, versioned payloads, Kafka."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def of_list(spark: SparkSession, rows: Sequence, schema: T.StructType | str) -> DataFrame:
    """Rows in arrival order, numbered in ``seq``."""
    kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    numbered = T.StructType([*kind.fields, T.StructField("seq", T.LongType())])
    return spark.createDataFrame([(*tuple(r), i) for i, r in enumerate(rows)], numbered)


def empty(spark: SparkSession, schema: T.StructType | str) -> DataFrame:
    return spark.createDataFrame([], schema)


def read_from(log: DataFrame, offset: int = 0, seq: str = "seq") -> DataFrame:
    """A replay of ``log`` from an offset; offsets past the end or below 0 are errors."""
    if offset < 0 or offset > log.agg(F.coalesce(F.max(seq) + 1, F.lit(0))).first()[0]:
        raise ValueError(f"offset {offset} is out of range")
    return log.where(F.col(seq) >= offset)


def log_length(log: DataFrame) -> int:
    return log.count()


def file_stream(spark: SparkSession, path: str, schema: T.StructType | str, fmt: str = "parquet", files_per_batch: int | None = None) -> DataFrame:
    """A directory as a seekable stream: offsets are kept in the query's checkpoint."""
    reader = spark.readStream.format(fmt).schema(schema)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def decode_json(raw: DataFrame, payload: str, schema: T.StructType | str, topic: str = "topic") -> tuple[DataFrame, DataFrame]:
    """(rows, dead letters): payloads that do not parse go to the second and stop nothing."""
    kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    strict = T.StructType([*kind.fields, T.StructField("_corrupt_record", T.StringType())])
    text = F.col(payload).cast("string")
    parsed = raw.withColumn("_row", F.from_json(text, strict, {"mode": "PERMISSIVE"}))
    bad = F.col("_row").isNull() | F.col("_row._corrupt_record").isNotNull() | text.isNull()
    keep = [c for c in raw.columns if c != payload]
    good = parsed.where(~bad).select(*keep, *[F.col("_row")[f.name].alias(f.name) for f in kind.fields])
    name = F.col(topic) if topic in raw.columns else F.lit(topic)
    dead = parsed.where(bad).select(name.alias("topic"), text.alias("payload"), F.lit("malformed JSON").alias("error"), F.current_timestamp().alias("ts"), F.lit(1).alias("attempt"))
    return good, dead


def decode_protobuf(raw: DataFrame, payload: str, message: str, descriptor: str) -> DataFrame:
    from pyspark.sql.protobuf.functions import from_protobuf

    return raw.withColumn("_row", from_protobuf(F.col(payload), message, descFilePath=descriptor, options={"mode": "PERMISSIVE"}))


def encode_versioned(payload: Column, version: int) -> Column:
    """A payload behind a two-byte big-endian version."""
    if not 0 <= version <= 65_535:
        raise ValueError("version is 0..65535")
    return F.concat(F.unhex(F.lit(f"{version:04X}")), payload.cast("binary"))


def decode_versioned(df: DataFrame, column: str, version: int, migrations: dict[int, Callable[[Column], Column]] | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows with ``payload`` and ``version``, failures with ``error``); other versions need a migration."""
    head = F.when(F.octet_length(column) >= 2, F.conv(F.hex(F.substring(column, 1, 2)), 16, 10).cast("int"))
    body = F.expr(f"substring(`{column}`, 3)")
    rows = df.withColumn("version", head)
    payload = F.when(F.col("version") == version, body)
    for v, f in (migrations or {}).items():
        payload = payload.when(F.col("version") == v, f(body))
    rows = rows.withColumn("payload", payload)
    error = F.when(F.col("version").isNull(), "payload too short").when(F.col("payload").isNull(), F.concat(F.lit("unknown version "), F.col("version")))
    return rows.where(error.isNull()).drop(column), rows.where(error.isNotNull()).withColumn("error", error).drop("payload")


def kafka_stream(spark: SparkSession, servers: str, topic: str, starting: str = "earliest", per_batch: int | None = None, **options: str) -> DataFrame:
    """Needs Spark's Kafka connector on the class path."""
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", starting).options(**options)
    if per_batch is not None:
        reader = reader.option("maxOffsetsPerTrigger", per_batch)
    return reader.load()
