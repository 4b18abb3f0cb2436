"""Exact top-k by inner product with a pivot-distance index.

Inner products become Euclidean distances by one more component,
``sqrt(M - |x|^2)`` with M the largest squared norm; queries have 0 there.
Each entry is keyed by its nearest pivot and its distance to it, and a
pivot's entries lie in annuli of growing distance. A query first searches one
annulus around its own distance, which bounds its k-th best score; by the
triangle inequality an annulus at distance r from a pivot holds nothing
nearer than ``|r - d(query, pivot)|``, so annuli and entries beyond the bound
are skipped and all others are compared.

Components are whole numbers, so scores are exact while they are below 2^53.
Inputs: null ids, null or empty vectors and vectors with null or non-finite
components take no part, nor do vectors of another length than the commonest,
whose product with others isn't defined; of several rows of one id the least
vector counts; equal vectors are searched once, and each of their ids is
found; ties go to the smaller id; an empty table gives an empty result.
Further columns, whatever their names, are not read.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import stored
from ._vectors import SAMPLE_ROWS, Segments, class_id, classes, matrix, ranked, sample, search, top, usable

PIVOTS, ANNULI = 16, 32

_RESULT = "query_id long, rank int, vec_id long, score long"
_KEYED = "cid string, vec array<double>, ids array<long>, p int, r double"


def pivots(points: np.ndarray, n: int) -> np.ndarray:
    """Points far from each other, by farthest-first traversal."""
    chosen = [int(((points - points.mean(0)) ** 2).sum(1).argmax())]
    far = ((points - points[chosen[0]]) ** 2).sum(1)
    while len(chosen) < min(n, len(points)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((points - points[chosen[-1]]) ** 2).sum(1))
    return points[chosen]


def lifted(x: np.ndarray, most: float) -> np.ndarray:
    return np.hstack([x, np.sqrt(np.maximum(0.0, most - (x**2).sum(1)))[:, None]])


def distances(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, (x**2).sum(1)[:, None] + (at**2).sum(1) - 2 * x @ at.T))


def topk(df: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", n_pivots: int = PIVOTS, annuli: int = ANNULI) -> DataFrame:
    """k best rows by inner product of the integer vectors in ``vec_col``, exactly.

    Returns (query_id, rank, vec_id, score). Pivots come from the SAMPLE_ROWS
    vectors of least hash; they only affect speed.
    """
    spark = df.sparkSession
    rows, _ = stored(usable(df, id_col, vec_col, drop_zero=False), "vectors")
    cls, _ = stored(classes(rows, k), "vector-classes")
    norm = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)
    most = cls.agg(F.max(norm)).first()[0]
    if most is None:
        return spark.createDataFrame([], _RESULT)
    at = pivots(lifted(sample(cls, SAMPLE_ROWS), most), n_pivots)

    def keyed(batches):
        for b in batches:
            d = distances(lifted(matrix(b.column("vec"), b.num_rows), most), at)
            p = d.argmin(1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p.astype(np.int32)), pa.array(d[np.arange(len(d)), p])], names=["cid", "vec", "ids", "p", "r"])

    index, _ = stored(cls.select("cid", "vec", "ids").mapInArrow(keyed, _KEYED), "pivot-index")
    lo, hi = np.zeros(len(at)), np.zeros(len(at))
    for x in index.groupBy("p").agg(F.min("r").alias("lo"), F.max("r").alias("hi")).collect():  # a row for each pivot
        lo[x["p"]], hi[x["p"]] = x["lo"], x["hi"]
    width = np.maximum((hi - lo) / annuli, 1e-9)

    def cell(p: np.ndarray, r: np.ndarray) -> np.ndarray:
        return p * annuli + np.clip((r - lo[p]) / width[p], 0, annuli - 1).astype(np.int64)

    def celled(batches):
        for b in batches:
            c = cell(np.asarray(b.column("p")), np.asarray(b.column("r")))
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32)), b.column("r")], names=["cell", "r"])

    counts, first, last = np.zeros(len(at) * annuli, dtype=np.int64), np.full(len(at) * annuli, np.inf), np.full(len(at) * annuli, -np.inf)
    for x in index.select("p", "r").mapInArrow(celled, "cell int, r double").groupBy("cell").agg(F.count("*").alias("n"), F.min("r").alias("lo"), F.max("r").alias("hi")).collect():
        counts[x["cell"]], first[x["cell"]], last[x["cell"]] = x["n"], x["lo"], x["hi"]
    seg = Segments.pack(counts, cuts=np.arange(len(counts)) % annuli == 0)
    n_groups = len(seg.salts)
    held, g_lo, g_hi, g_pivot = np.zeros(n_groups, dtype=np.int64), np.full(n_groups, np.inf), np.full(n_groups, -np.inf), np.zeros(n_groups, dtype=np.int64)
    np.add.at(held, seg.group, counts)
    np.minimum.at(g_lo, seg.group, first)
    np.maximum.at(g_hi, seg.group, last)
    g_pivot[seg.group] = np.arange(len(counts)) // annuli
    live = np.flatnonzero(held)

    def dealt(batches):
        for b in batches:
            g = seg.group[cell(np.asarray(b.column("p")), np.asarray(b.column("r")))]
            s = np.array([int(x[:8], 16) for x in b.column("cid").to_pylist()], dtype=np.int64) % seg.salts[g]
            yield pa.RecordBatch.from_arrays([pa.array(g.astype(np.int32)), pa.array(s.astype(np.int32)), *(b.column(c) for c in ("cid", "vec", "ids", "r"))], names=["g", "s", "cid", "vec", "ids", "r"])

    def probes(choose):
        def run(batches):
            for b in batches:
                x = matrix(b.column("vec"), b.num_rows)
                d = distances(np.hstack([x, np.zeros((len(x), 1))]), at)
                bound = np.asarray(b.column("bound")) if "bound" in b.schema.names else np.full(len(x), -np.inf)
                who, g, s = [], [], []
                for i in range(len(x)):
                    gap = np.maximum(0.0, np.maximum(g_lo[live] - d[i, g_pivot[live]], d[i, g_pivot[live]] - g_hi[live]))
                    for group in live[choose(gap, d[i, g_pivot[live]], (x[i] ** 2).sum(), bound[i])].tolist():
                        for salt in range(seg.salts[group]):
                            who.append(i), g.append(group), s.append(salt)
                far = b.take(pa.array(who, pa.int32()))
                kept = np.asarray(who, dtype=np.int64)
                own = d[kept, g_pivot[np.asarray(g, dtype=np.int64)]]
                yield pa.RecordBatch.from_arrays([pa.array(g, pa.int32()), pa.array(s, pa.int32()), far.column("cid"), far.column("vec"), pa.array(bound[kept], pa.float64()), pa.array(own, pa.float64())], names=["g", "s", "cid", "vec", "bound", "own"])
        return run

    slack = 1e-6 * (1 + most)

    def home(gap, d, norm2, bound):
        return np.lexsort((d, gap))[:1]  # the annulus around the query's own distance to the nearest pivot

    def open_(gap, d, norm2, bound):
        return np.flatnonzero((norm2 + most - gap**2) / 2 + slack >= bound)

    def meet(e, q):
        order = np.argsort(e["r"], kind="stable")
        r, vec = e["r"][order], e["vec"][order]
        by = np.argsort(q["own"], kind="stable")
        for lo_q in range(0, len(by), 128):
            some = by[lo_q : lo_q + 128]
            x, own, bound = q["vec"][some], q["own"][some], q["bound"][some]
            reach = np.sqrt(np.maximum(0.0, (x**2).sum(1) + most - 2 * (bound - slack)))
            a, z = np.searchsorted(r, own - reach, "left"), np.searchsorted(r, own + reach, "right")
            if a.min() >= z.max():
                continue
            scores = x @ vec[a.min() : z.max()].T
            first = e["first"][order][a.min() : z.max()]
            for i, row in enumerate(scores):
                from_, to = a[i] - a.min(), z[i] - a.min()
                hit = top(row[from_:to], first[from_:to], k + 1) + from_
                hit = hit[row[hit] >= bound[i]]
                yield int(some[i]), order[hit + a.min()], row[hit]

    own = rows.where(is_query(F.col("vec_id"))).select(F.col("vec_id").alias("query_id"), "vec", class_id())
    asked, _ = stored(own.groupBy("cid").agg(F.min("vec").alias("vec")), "queries")
    n_asked = asked.count()
    entries = index.mapInArrow(dealt, "g int, s int, cid string, vec array<double>, ids array<long>, r double")
    probe_schema = "g int, s int, cid string, vec array<double>, bound double, own double"
    near = search(entries, asked.mapInArrow(probes(home), probe_schema), n_asked, meet, ["r", "bound", "own"])
    worst = near.groupBy("qcid").agg(F.sort_array(F.collect_list("score"), asc=False).alias("s")).select(F.col("qcid").alias("cid"), F.get("s", F.lit(k)).alias("bound"))
    bounded, _ = stored(asked.join(worst, "cid", "left").select("cid", "vec", F.coalesce("bound", F.lit(float("-inf"))).alias("bound")), "bounds")
    hits = search(entries, bounded.mapInArrow(probes(open_), probe_schema), n_asked, meet, ["r", "bound", "own"])
    return ranked(hits, own.select("query_id", F.col("cid").alias("qcid")), k).withColumn("score", F.col("score").cast("long"))


def exact_rows(spark, sf_dir: str) -> DataFrame:
    """Query op8: 5 best of every 50th row of ``embeddings``, by whole 256ths."""
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    whole = F.transform("embedding", lambda x: F.floor(F.lit(256.0) * x.cast("double")).cast("double"))
    finite = ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return topk(df.where(finite).select("vec_id", whole.alias("embedding")), lambda i: i % 50 == 0, k=5)


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT q.vec_id AS query_id, e.vec_id, list_dot_product(q.x, e.x)::BIGINT AS score
  FROM v q JOIN v e ON q.vec_id % 50 = 0 AND q.vec_id <> e.vec_id
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs
) WHERE rank <= 5
"""
