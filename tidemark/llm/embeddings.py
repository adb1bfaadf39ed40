"""Embedding near-duplicates: random-hyperplane sign hashing, exact verification, components.

Equal vectors form one class, represented by its smallest id; classes are never expanded into pairs.
Each class is hashed into several tables by the signs of its products with seeded random hyperplanes.
Bits per table grow with the logarithm of the number of classes, and tables are as many as keep the chance
of missing a pair at the threshold below ``MISS``.  In a bucket all pairs are verified by cosine in double
precision as block products; buckets of more than ``BLOCK`` classes are cut into blocks and all pairs of
blocks are verified, each as its own group, so no bucket is capped and none meets in one task.  Buckets are dealt by
ids alone; vectors join only the blocks that have anything to compare.  A pair counts
in the first table in which it meets.  A group of pairs gives each class's number of linked vectors and a
spanning forest of its links, so results grow with vectors and not with the square of a group.

Null vectors, vectors with null or non-finite components and zero vectors link with nothing.  Vectors of
different lengths never link.  Repeated rows (equal id and vector) count as vectors.  Empty tables give no
rows.  Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch_of, table, written
from .graph import connected_components

THRESHOLD, MISS, BLOCK, SEED = 0.95, 0.005, 1024, 11


def tables_for(n: int, threshold: float = THRESHOLD) -> tuple[int, int]:
    """(bits, tables) for n classes: about 32 classes a bucket if they were spread evenly."""
    bits = min(30, max(6, math.ceil(math.log2(max(n, 2) / 32))))
    meet = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(MISS) / math.log(1 - meet))


def signatures(vectors: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """One integer of ``bits`` signs per vector and table."""
    planes = np.random.default_rng([SEED, vectors.shape[1]]).standard_normal((vectors.shape[1], bits * tables))
    signs = (vectors @ planes >= 0).reshape(len(vectors), tables, bits)
    return signs @ (1 << np.arange(bits, dtype=np.int32)).astype(np.int32)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    v = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


HASHED = pa.schema([("width", pa.int32()), ("rep", pa.int64()), ("sigs", pa.list_(pa.int32()))])
FOUND = pa.schema([("rep", pa.int64()), ("peer", pa.int64()), ("n_linked", pa.int64())])


def _forest(x: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """The smallest index reachable from each of n by the links (x, y)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def near_links(classes: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """rep, peer, n_linked of the pairs of ``classes`` (rep, v: valid, distinct; n: vectors) that meet and reach the
    threshold: rows of a rep add up to the vectors linked with it; peers join the components together."""
    bits, tables = tables_for(classes.count(), threshold)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            width = pa.compute.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False)
            for w in np.unique(width):
                part = batch.filter(pa.array(width == w))
                for at in range(0, part.num_rows, 2048):
                    cut = part.slice(at, 2048)
                    sigs = signatures(_matrix(cut.column(1), int(w)), bits, tables).astype(np.int32)
                    yield batch_of(HASHED, width=[int(w)] * cut.num_rows, rep=cut.column(0), sigs=list(sigs))

    hashes = written(classes.select("rep", "v").mapInArrow(hashed, "width int, rep long, sigs array<int>"))
    rows = hashes.select("width", "rep", F.posexplode("sigs").alias("t", "bucket"))
    bucket = ["width", "t", "bucket"]
    blocks = written(rows.groupBy(*bucket).count().where("count > 1").withColumn("blocks", F.ceil(F.col("count") / BLOCK).cast("int")).drop("count"))
    own = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    dealt = rows.join(blocks, bucket).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select(*bucket, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "rep")
    dealt = dealt.join(classes.select("rep", "v", "n"), "rep").join(hashes.select("rep", "sigs"), "rep")

    def verified(group: pa.Table) -> pa.Table:
        i, j, t, w = (group.column(c)[0].as_py() for c in ("i", "j", "t", "width"))
        own, rep, n = (group.column(c).to_numpy() for c in ("own", "rep", "n"))
        v = _matrix(group.column("v").combine_chunks(), w)
        sigs = group.column("sigs").combine_chunks().flatten().to_numpy().reshape(len(rep), -1)
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        xs, ys = [], []
        for at in range(0, len(left), 512):
            x, y = np.nonzero(v[left[at : at + 512]] @ v[right].T >= threshold)
            x, y = left[at + x], right[y]
            if i == j:
                x, y = x[x < y], y[x < y]
            first = np.ones(len(x), bool)
            for k in range(t):
                first &= sigs[x, k] != sigs[y, k]
            xs.append(x[first])
            ys.append(y[first])
        x, y = np.concatenate(xs or [own[:0]]), np.concatenate(ys or [own[:0]])
        linked = np.bincount(x, weights=n[y], minlength=len(rep)) + np.bincount(y, weights=n[x], minlength=len(rep))
        peer = rep[_forest(x, y, len(rep))]
        keep = linked > 0
        return pa.table([pa.array(rep[keep]), pa.array(peer[keep]), pa.array(linked[keep].astype(np.int64))], schema=FOUND)

    pairs_of_blocks = [*bucket, "i", "j"]
    return dealt.repartition(*pairs_of_blocks).groupBy(*pairs_of_blocks).applyInArrow(verified, "rep long, peer long, n_linked long")


def near_duplicates(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """key, n_links, component_id, kept for every row of ``vectors``."""
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(column).alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    if dict(rows.dtypes)["v"] not in ("array<float>", "array<double>"):
        rows = rows.withColumn("v", F.col("v").cast("array<double>"))
    valid = F.coalesce(~bad & F.exists("v", lambda x: x != 0), F.lit(False))
    good = rows.where(valid & F.col("id").isNotNull())
    classes = written(good.groupBy("v").agg(F.min("id").alias("rep"), F.count("*").alias("n")))
    found = written(near_links(classes, threshold))
    component = connected_components(found.select(F.col("rep").alias("a"), F.col("peer").alias("b")))
    linked = found.groupBy("rep").agg(F.sum("n_linked").alias("n_linked"))
    known = classes.join(linked, "rep", "left").join(component.withColumnRenamed("id", "rep"), "rep", "left").select(
        "v", (F.col("n") - 1 + F.coalesce("n_linked", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id")
    )
    out = rows.withColumn("v", F.when(valid, F.col("v"))).join(known, "v", "left")
    component_id = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component_id.alias("component_id"), (F.col("id") == component_id).alias("kept"))


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))



SQL = """
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
d AS (SELECT x, count(*) AS n FROM l GROUP BY x),
r AS (SELECT x AS id, x AS z FROM d UNION SELECT r.id, l.y FROM r JOIN l ON l.x = r.z),
c AS (SELECT id, min(z) AS component_id FROM r GROUP BY id)
SELECT vec_id, coalesce(d.n, 0)::BIGINT AS n_links, coalesce(component_id, vec_id)::BIGINT AS component_id, vec_id = coalesce(component_id, vec_id) AS kept
FROM embeddings LEFT JOIN d ON d.x = vec_id LEFT JOIN c ON c.id = vec_id
"""
