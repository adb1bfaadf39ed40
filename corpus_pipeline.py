"""The corpus pipeline: language ID, near-duplicate removal, secret masking, mixing, BPE encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``documents``.  A stage sees only what its predecessor kept.

1. language_id      documents without a letter (predicted ``und``) go; nothing else does, also when no row is labelled.
                    A missing ``lang`` becomes the predicted one.
2. near_duplicates  of each group of linked documents the one with the smallest doc_id stays; documents
                    without words link with nothing and stay.
3. secrets          secrets are masked in the text, and n_chars follows the new text.
4. mixing           each document comes out as often as the mix takes it (0, 1 or 2 times).
5. bpe              ids of each document that is left, with counts and digests (one row per copy).

Null texts have no letter and go in stage 1.  Null ids, repeated rows and extra columns are carried along;
repeated rows of one id count as one document in stage 2 and all stay or go together.  Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, jaccard, language, mixing, secrets
from tidemark.llm.common import named, table, written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps rows with a predicted language and fills in missing labels.  The prediction follows the text alone."""
    model = language.fit(docs)
    return language.keep_known(docs, model, lang="lang")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    gone = jaccard.join(docs).where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*map(named, docs.columns))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = secrets.redact(docs)
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return clean.select(*map(named, docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    copies = mixing.mix(docs).select(F.col("doc_id").alias("id"), "copies").groupBy("id").agg(F.max("copies").alias("copies"))
    rows = docs.select(F.col("doc_id").alias("id"), F.struct(*map(named, docs.columns)).alias("row"))  # so that no name clashes
    taken = rows.join(copies, rows["id"].eqNullSafe(copies["id"])).where("copies > 0")
    return taken.select(F.explode(F.array_repeat("row", F.col("copies").cast("int"))).alias("row")).select("row.*")


def encode_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    path = P.path("byte_bpe_multi_50k.tiktoken")
    return bpe.digests(docs, path, P.PATTERN, keep_ids=True).withColumnRenamed("key", "doc_id")


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("secrets", mask_secrets),
    ("mixing", mix_sources),
    ("bpe", encode_bpe),
]

#: Language models, taggers, subset sums and BPE merges are not expressible in SQL; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
