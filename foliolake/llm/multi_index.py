"""Approximate nearest neighbours with an inverted multi-index.

Vectors are cut in two halves, each quantised by its own codebook; an entry
lies in the cell of its pair of centroids. A query walks the pairs in order
of summed distance, with a heap over the two sorted lists of centroids, until
its cells hold enough candidates, which are then reranked by the exact inner
product of the original vectors. The distance of a half is the negative inner
product with its centroid, so that sums of halves order pairs as the measure
orders vectors.

Inputs: null ids, null, empty, zero or non-finite vectors take no part, nor
do vectors of another length than the commonest, whose product with others
isn't defined; of several rows of one id the least vector counts; equal
vectors are searched once, and each of their ids is found; ties go to the
smaller id; fewer candidates than k are all returned; an empty table gives an
empty result. Further columns, whatever their names, are not read.
"""

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import stored
from ._vectors import SAMPLE_ROWS, Segments, class_id, classes, matrix, ranked, sample, search, top, usable

#: Codebook of a half (all vectors learnt from, if fewer).
CENTROIDS = 128
#: A query's candidates: this share of the index, and so many at least.
#: Recall rises with the share and the codebook: on vectors without clusters, the hardest, 0.4 finds over 0.9 of the true neighbours.
SHARE, LEAST = 0.4, 64
#: Queries that walk the cells in one task.
WALKS = 256

_RESULT = "query_id long, rank int, vec_id long, score double"


def codebook(points: np.ndarray, k: int, rounds: int = 15, seed: int = 7) -> np.ndarray:
    """k-means centroids."""
    rng = np.random.default_rng(seed)
    at = points[rng.choice(len(points), k, replace=False)].copy()
    for _ in range(rounds):
        own = nearest(points, at)
        n = np.bincount(own, minlength=k)
        total = np.zeros_like(at)
        np.add.at(total, own, points)
        at[n > 0] = total[n > 0] / n[n > 0, None]
    return at


def nearest(points: np.ndarray, at: np.ndarray) -> np.ndarray:
    return ((at**2).sum(1) / 2 - points @ at.T).argmin(1)


def walk(d1: np.ndarray, d2: np.ndarray, counts: np.ndarray, enough: int) -> tuple[float, list[int]]:
    """Cells by summed distance until they hold ``enough`` entries.

    counts: entries by cell, as a matrix. Returns the last sum and the cells
    with entries. Cells that tie with the last are included.
    """
    o1, o2 = np.argsort(d1, kind="stable"), np.argsort(d2, kind="stable")
    s1, s2, p1, p2 = d1[o1].tolist(), d2[o2].tolist(), o1.tolist(), o2.tolist()
    by = counts[np.ix_(o1, o2)].tolist()
    n1, n2, k2 = len(s1), len(s2), counts.shape[1]
    heap, found, held, last = [(s1[0] + s2[0], 0, 0)], [], 0, -np.inf
    while heap:
        d, i, j = heapq.heappop(heap)
        if held >= enough and d > last:
            break
        last = d
        if by[i][j]:
            held += by[i][j]
            found.append(p1[i] * k2 + p2[j])
        # each pair is pushed once: along a row from its left, down the first column from above
        if j + 1 < n2:
            heapq.heappush(heap, (s1[i] + s2[j + 1], i, j + 1))
        if j == 0 and i + 1 < n1:
            heapq.heappush(heap, (s1[i + 1] + s2[0], i + 1, 0))
    return last, found


def knn(
    df: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", centroids: int = CENTROIDS, share: float = SHARE, least: int = LEAST,
) -> DataFrame:
    """k nearest rows by inner product of each row that ``is_query`` (a condition on vec_id) holds for.

    Returns (query_id, rank, vec_id, score). Codebooks come from the
    SAMPLE_ROWS vectors of least hash; every row is indexed.
    """
    spark = df.sparkSession
    rows, _ = stored(usable(df, id_col, vec_col, drop_zero=True), "vectors")
    cls, _ = stored(classes(rows, k), "vector-classes")
    n = cls.count()
    learnt = sample(cls, SAMPLE_ROWS)
    if not len(learnt):
        return spark.createDataFrame([], _RESULT)
    half = max(1, learnt.shape[1] // 2)
    c1 = codebook(learnt[:, :half], min(centroids, len(learnt)))
    c2 = codebook(learnt[:, half:], min(centroids, len(learnt))) if learnt.shape[1] > half else np.zeros((1, 0))
    k2 = len(c2)

    def celled(batches):
        for b in batches:
            x = matrix(b.column("vec"), b.num_rows)
            cell = nearest(x[:, :half], c1) * k2 + (nearest(x[:, half:], c2) if k2 > 1 else 0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32))], names=["cid", "vec", "ids", "cell"])

    index = cls.select("cid", "vec", "ids").mapInArrow(celled, "cid string, vec array<double>, ids array<long>, cell int")
    index, _ = stored(index, "multi-index")
    counts = np.zeros(len(c1) * k2, dtype=np.int64)
    for r in index.groupBy("cell").count().collect():  # a row for each cell at most
        counts[r["cell"]] = r["count"]
    seg = Segments.pack(counts)
    grid, enough = counts.reshape(len(c1), k2), max(least, int(np.ceil(share * n)))

    def dealt(batches):
        for b in batches:
            g = seg.group[np.asarray(b.column("cell"))]
            s = np.array([int(x[:8], 16) for x in b.column("cid").to_pylist()], dtype=np.int64) % seg.salts[g]
            yield pa.RecordBatch.from_arrays([pa.array(g.astype(np.int32)), pa.array(s.astype(np.int32)), *b.columns], names=["g", "s", "cid", "vec", "ids", "cell"])

    def walked(batches):
        for b in batches:
            x = matrix(b.column("vec"), b.num_rows)
            d1, d2 = -(x[:, :half] @ c1.T), -(x[:, half:] @ c2.T)
            at, g, s, until = [], [], [], []
            for i in range(len(x)):
                last, cells = walk(d1[i], d2[i], grid, enough)
                for group in np.unique(seg.group[cells]).tolist():
                    for salt in range(seg.salts[group]):
                        at.append(i), g.append(group), s.append(salt), until.append(last)
            far = b.take(pa.array(at, pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(g, pa.int32()), pa.array(s, pa.int32()), far.column("cid"), far.column("vec"), pa.array(until, pa.float64())], names=["g", "s", "cid", "vec", "until"])

    def meet(e, q):
        i1, i2 = e["cell"] // k2, e["cell"] % k2
        for lo in range(0, len(q["vec"]), 128):
            x, until = q["vec"][lo : lo + 128], q["until"][lo : lo + 128]
            d = -(x[:, :half] @ c1.T)[:, i1] - (x[:, half:] @ c2.T)[:, i2]
            scores = np.where(d <= until[:, None] + 1e-9, x @ e["vec"].T, -np.inf)
            for i, row in enumerate(scores):
                at = top(row, e["first"], k + 1)
                at = at[row[at] > -np.inf]
                yield lo + i, at, row[at]

    own = rows.where(is_query(F.col("vec_id"))).select(F.col("vec_id").alias("query_id"), "vec", class_id())
    asked, _ = stored(own.groupBy("cid").agg(F.min("vec").alias("vec")), "queries")
    dealt_schema = "g int, s int, cid string, vec array<double>, ids array<long>, cell int"
    probe_schema = "g int, s int, cid string, vec array<double>, until double"
    n_asked = asked.count()
    walks = asked.repartition(max(1, -(-n_asked // WALKS)), "cid").mapInArrow(walked, probe_schema)
    hits = search(index.mapInArrow(dealt, dealt_schema), walks, n_asked, meet, ["cell", "until"])
    return ranked(hits, own.select("query_id", F.col("cid").alias("qcid")), k)


def nearest_rows(spark, sf_dir: str) -> DataFrame:
    """Query op1: 20 nearest of every 20th row of ``embeddings``."""
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return knn(df, lambda i: i % 20 == 0, k=20)
