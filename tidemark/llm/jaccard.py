"""N-gram Jaccard join with adaptive multi-match prefixes.

A document's set is its distinct 5-word shingles (64-bit hashes) of ASCII-lower-cased words.  Documents with
equal sets form one class, represented by its smallest id; classes are never expanded into pairs.

Order: shingles are ordered rarest first by estimated frequency, then by hash.  Frequencies come from all
documents: each slice of rows counts its shingles and reports those in ``LOCAL_MIN`` of its documents or more;
the ``COMMON`` most frequent overall are kept (a bounded table), all others count as rare.  Any order gives
the same result; a good one keeps common passages out of prefixes.

Prefixes: if overlap at the threshold needs o of a set's n shingles, two linked sets share l of their first
n - o + l.  For each set the l of 1..``LONGEST`` with the least estimated cost is chosen: postings written plus
candidates expected, which are the prefix's frequencies over l.  Sets chosen l and m must share min(l, m)
prefix shingles before they are verified.

Search, in two rounds, so that a group of near copies is not multiplied out:
1. Stars.  In the posting list of each prefix shingle all sets of fitting size meet only the first, the hub.  Verified links
   give stars: each set joins its smallest linked hub, with the distance (1 - Jaccard) as its radius.
2. Between stars.  Posting lists are reduced to stars; stars that share a list are candidates, lone sets only
   with min(l, m) shared shingles.  What the prefixes share and what lies beyond them must be able to reach
   the threshold.  Hubs are verified.  Distance is a metric, so two
   stars further apart than both radii plus 0.2 hold no link; members of the others are compared pair by pair
   as far as the triangle inequality leaves a link possible.
Links go to connected components; no link between different components of the graph is lost.

Verification compares whole sets, built again from the texts of the candidates.  Shingles are equal if their
64-bit hashes are: within a pair of sets of 10,000 shingles two differ and collide with a chance of 10**-11, and
a link hangs on that only at the threshold itself.  Sets of one class have equal sizes and 128 bits in common.

Null text or text without words: empty set, size 0, linked with nothing.  Fewer than five words: the whole
sequence is one shingle.  Sets of fewer than four shingles link with equal sets only.  Very long texts count whole.  Repeated rows and equal texts share a class; rows
with a null id are given back unlinked.  Empty tables give no rows.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch_of, discard, gram_hashes, mix, slices, table, word_hashes, written
from .graph import connected_components

SHINGLE, PERCENT = 5, 80
LOCAL_MIN, COMMON, LONGEST = 4, 1 << 17, 4
#: Cost of verifying a candidate in postings written.
VERIFY_COST = 8.0


def shingle_sets(texts: list[bytes], k: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words, offsets = word_hashes([t.lower() for t in texts])
    grams = gram_hashes(words, k)
    out = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(grams[a : b - k + 1]))
        elif b > a:
            out.append(gram_hashes(words[a:b], b - a) ^ np.uint64(b - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def prefix(shingles: np.ndarray, common: np.ndarray, df: np.ndarray) -> tuple[int, np.ndarray]:
    """(l, prefix shingles rarest first) of least estimated cost; common is sorted, df its frequencies."""
    n = len(shingles)
    need = -(-PERCENT * n // 100)
    if not n:
        return 1, shingles
    if len(common):
        at = np.minimum(np.searchsorted(common, shingles), len(common) - 1)
        freq = np.where(common[at] == shingles, df[at], 1)
    else:
        freq = np.ones(n, np.int64)
    order = np.lexsort((shingles, freq))
    run = np.cumsum(freq[order] - 1.0)
    choices = range(1, min(LONGEST, need) + 1)
    best = min(choices, key=lambda m: (n - need + m + VERIFY_COST * run[n - need + m - 1] / m, m))
    return best, shingles[order[: n - need + best]]


SETS = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("count", pa.int64())])
PREFIXES = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("l", pa.int32()), ("tokens", pa.list_(pa.int64()))])


def _signature(s: np.ndarray) -> tuple[int, int]:
    """Two 64-bit sums that tell sets apart."""
    return int(np.add.reduce(mix(s + np.uint64(1))).view(np.int64)), int(np.add.reduce(mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5))).view(np.int64))


def _sets(rows: DataFrame) -> DataFrame:
    """A row per document (id, n, s1, s2), and per frequent shingle of a slice of rows (s1, count)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=16 << 20):
            sets = []
            for part in slices([batch], limit=2 << 20):
                sets += shingle_sets([(t or "").encode() for t in part.column(1).to_pylist()])
            signed = [_signature(s) if len(s) else (0, 0) for s in sets]
            n = len(sets)
            yield batch_of(SETS, id=batch.column(0), n=[len(s) for s in sets], s1=[a for a, _ in signed], s2=[b for _, b in signed], count=[None] * n)
            found, count = np.unique(np.concatenate(sets), return_counts=True)
            found, count = found[count >= LOCAL_MIN].view(np.int64), count[count >= LOCAL_MIN]
            for at in range(0, len(found), 10_000):
                f = found[at : at + 10_000]
                none = [None] * len(f)
                yield batch_of(SETS, id=none, n=none, s1=f, s2=none, count=count[at : at + 10_000])

    return rows.mapInArrow(run, "id long, n long, s1 long, s2 long, count long")


def _prefixes(rows: DataFrame, common: np.ndarray, df: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=2 << 20):
            sets = shingle_sets([(t or "").encode() for t in batch.column(1).to_pylist()])
            found = [prefix(s, common, df) for s in sets]
            yield batch_of(PREFIXES, id=batch.column(0), n=[len(s) for s in sets], l=[m for m, _ in found], tokens=[p.view(np.int64) for _, p in found])

    return rows.mapInArrow(run, "id long, n long, l int, tokens array<long>")


OVERLAPS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("shared", pa.int64()), ("total", pa.int64())])
#: Shingles of texts that a worker keeps between the pairs of a partition.
KEPT = 2_000_000


def overlaps(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """``pairs`` (a, b) with shared and total: the sizes of their sets' intersection and union."""
    first, second = texts.select(F.col("id").alias("a"), F.col("text").alias("x")), texts.select(F.col("id").alias("b"), F.col("text").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, np.ndarray] = {}
        size = 0
        for batch in slices(batches, "y", 1 << 20):
            x, y = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            if size > KEPT:
                known, size = {}, 0
            new = [t for t in {*x, *y} if t not in known]
            for at in range(0, len(new), 256):
                part = new[at : at + 256]
                for t, s in zip(part, shingle_sets([(t or "").encode() for t in part]), strict=True):
                    known[t] = s
                    size += len(s)
            shared = [len(np.intersect1d(known[t], known[u], assume_unique=True)) for t, u in zip(x, y, strict=True)]
            total = [len(known[t]) + len(known[u]) - n for t, u, n in zip(x, y, shared, strict=True)]
            yield batch_of(OVERLAPS, a=batch.column(0), b=batch.column(1), shared=shared, total=total)

    # a hub's pairs are many: its text joins last, where adaptive execution may split it
    both = pairs.join(second, "b").join(first, "a").select("a", "b", "x", "y")
    return both.mapInArrow(run, "a long, b long, shared long, total long")


def join(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_shingles, component_id of every row of ``documents``."""
    rows = documents.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    seen = written(_sets(rows))
    sets = seen.where("count IS NULL").drop("count")
    top = seen.where("count IS NOT NULL").groupBy("s1").agg(F.sum("count").alias("f")).orderBy(F.desc("f"), "s1").limit(COMMON).toPandas().sort_values("s1", key=lambda c: c.to_numpy().astype(np.int64).view(np.uint64))
    common, df = top["s1"].to_numpy().astype(np.int64).view(np.uint64), top["f"].to_numpy().astype(np.int64)
    classes = written(sets.where("id IS NOT NULL AND n > 0").groupBy("n", "s1", "s2").agg(F.min("id").alias("rep")))
    reps = classes.select(F.col("rep").alias("id"))

    # postings of the prefixes' shingles that several sets share
    # a set that one more shingle takes below the threshold links with equal sets only, which its class holds
    found = written(_prefixes(rows.where("id IS NOT NULL"), common, df).where(_fits("n", "(n + 1)")).join(reps, "id", "left_semi"))
    lists = found.select("id", "n", "l", F.explode("tokens").alias("token"))
    hubs = lists.groupBy("token").agg(F.min(F.struct("id", "n", "l")).alias("hub"), F.max("id").alias("last")).where("hub.id < last")
    hubs = written(hubs.select("token", F.col("hub.id").alias("hub"), F.col("hub.n").alias("hub_n"), F.col("hub.l").alias("hub_l")))
    shared = written(lists.join(hubs, "token"))
    discard(found)
    discard(hubs)
    texts = written(rows.join(shared.select("id").distinct(), "id", "left_semi"))
    component = connected_components(_links(shared, texts)).withColumnRenamed("id", "rep")
    placed = classes.join(component, "rep", "left").select("n", "s1", "s2", F.coalesce("component", "rep").alias("component"))
    out = sets.join(placed, ["n", "s1", "s2"], "left")
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id"))


LINKED = f"100 * shared >= {PERCENT} * total"


def _fits(x: str, y: str) -> str:
    return f"100 * {x} >= {PERCENT} * {y}"


def _needed(n: str) -> str:
    return f"cast(ceil({PERCENT} * {n} / 100) AS long)"


def _enough(k: str, x: tuple[str, str, str], y: tuple[str, str, str]) -> str:
    """SQL: k shared prefix shingles can reach the threshold; x and y are (least size, most size, l).

    Prefixes are cut in one order, so what the set with the lower cut shares beyond k lies in its
    rest, o - l shingles; overlap must come to PERCENT / (100 + PERCENT) of both sizes.
    """
    rest = f"greatest({_needed(x[1])} - {x[2]}, {_needed(y[1])} - {y[2]})"
    return f"{100 + PERCENT} * ({k} + {rest}) >= {PERCENT} * ({x[0]} + {y[0]})"


def _links(shared: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) whose components are those of all links; shared: postings (token, id, n, l, and the hub's)."""
    distance = 1 - F.col("shared") / F.col("total")
    # round 1: every set against the hubs of its lists
    near = shared.where(f"id <> hub AND {_fits('n', 'hub_n')} AND {_fits('hub_n', 'n')}").groupBy(F.col("hub").alias("a"), F.col("id").alias("b"))
    near = near.agg(F.count("*").alias("k"), *[F.max(c).alias(c) for c in ("n", "l", "hub_n", "hub_l")])
    # a list's hub may hide some shared shingles from this count, so half is asked for; round 2 takes the rest
    near = near.where(_enough("2 * k", ("n", "n", "l"), ("hub_n", "hub_n", "hub_l")))
    with_hub = written(overlaps(near.select("a", "b"), texts))
    linked = with_hub.where(LINKED)
    nearest = F.min(F.struct("a", distance.alias("r"))).alias("x")
    star = written(linked.groupBy(F.col("b").alias("id")).agg(nearest).select("id", F.col("x.a").alias("hub"), F.col("x.r").alias("r")))
    radius = star.groupBy("hub").agg(F.max("r").alias("radius"))

    # round 2: stars that share a list
    own = shared.select("token", "id", "n", "l").join(star.select("id", "hub"), "id", "left").select("token", F.coalesce("hub", "id").alias("star"), "n", "l")
    lists = own.groupBy("token", "star").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.min("l").alias("l"))
    lists = written(lists.join(radius.withColumnRenamed("hub", "star"), "star", "left").na.fill(0.0, ["radius"]))
    x, y = (lists.select("token", *[F.col(c).alias(f"{c}_{s}") for c in ("star", "least", "most", "l", "radius")]) for s in "xy")
    met = x.join(y, "token").where(f"star_x < star_y AND {_fits('most_x', 'least_y')} AND {_fits('most_y', 'least_x')}")
    ends = [F.min(c).alias(c) for c in ("least_x", "least_y", "l_x", "l_y")] + [F.max(c).alias(c) for c in ("most_x", "most_y")]
    pairs = met.groupBy(F.col("star_x").alias("a"), F.col("star_y").alias("b")).agg(F.count("*").alias("k"), *ends, F.max("radius_x").alias("ra"), F.max("radius_y").alias("rb"))
    pairs = pairs.where("ra > 0 OR rb > 0 OR k >= least(l_x, l_y)").where(_enough("k", ("least_x", "most_x", "l_x"), ("least_y", "most_y", "l_y")))
    pairs = written(pairs.select("a", "b", "ra", "rb").join(with_hub, ["a", "b"], "left"))
    new = written(overlaps(pairs.where("total IS NULL").select("a", "b"), texts))
    links = written(linked.select("a", "b").union(new.where(LINKED).select("a", "b")))

    # members of stars whose hubs do not link, as far as the triangle inequality allows
    seen = pairs.where("total IS NOT NULL").union(pairs.drop("shared", "total").join(new, ["a", "b"]))
    slack = f"{1 - PERCENT / 100} + 1e-9"
    wide = seen.where(f"NOT ({LINKED}) AND (ra > 0 OR rb > 0)").withColumn("d", distance).where(f"d <= ra + rb + {slack}").select("a", "b", "d")
    named = connected_components(links)
    ends = wide.join(named.toDF("a", "ca"), "a", "left").join(named.toDF("b", "cb"), "b", "left")
    ends = written(ends.where("coalesce(ca, a) <> coalesce(cb, b)").select("a", "b", "d"))
    hubs = ends.select("a").union(ends.select("b")).distinct().select(F.col("a").alias("hub"), F.col("a").alias("id"), F.lit(0.0).alias("r"))
    sizes = shared.groupBy("id").agg(F.max("n").alias("n"))
    members = written(star.select("hub", "id", "r").union(hubs).join(sizes, "id").select("hub", "id", "r", "n"))
    rest = ends.join(members.toDF("a", "ia", "ra", "na"), "a").join(members.toDF("b", "ib", "rb", "nb"), "b")
    rest = rest.where(f"ia <> ib AND NOT (ia = a AND ib = b) AND ra + rb + {slack} >= d AND {_fits('na', 'nb')} AND {_fits('nb', 'na')}")
    rest = rest.select(F.least("ia", "ib").alias("a"), F.greatest("ia", "ib").alias("b")).distinct()
    return links.union(overlaps(rest, texts).where(LINKED).select("a", "b"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 80 * (a.n + b.n - k)),
r AS (SELECT x AS id, x AS z FROM l UNION SELECT r.id, l.y FROM r JOIN l ON l.x = r.z),
c AS (SELECT id, min(z) AS component_id FROM r GROUP BY id)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(component_id, doc_id)::BIGINT AS component_id FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.id = doc_id
"""
