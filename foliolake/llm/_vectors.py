"""Distinct vectors, and blocks of queries against blocks of entries.

Equal vectors are one class, which keeps the few smallest ids that any
top-k can need, so copies cost no more than one vector. Both sides are dealt
in blocks of bounded size: a segment of entries meets a chunk of queries in
one task, and only each query's best classes leave it.
"""

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Entries of a segment and queries of a chunk, so the memory of a task.
SEGMENT_ROWS = 16_384
CHUNK_ROWS = 8_192
#: Vectors from which codebooks and pivots are learnt, whatever the table's size.
SAMPLE_ROWS = 8_192

_HITS = "qcid string, score double, ids array<long>"


def usable(df: DataFrame, id_col: str, vec_col: str, drop_zero: bool) -> DataFrame:
    """(vec_id, vec) of the rows that take part.

    Null ids, null or empty vectors and vectors with null or non-finite
    components don't; nor do zero vectors if ``drop_zero``, nor vectors of
    another length than the commonest. Of several rows of one id the least
    vector counts.
    """
    v = F.col(vec_col)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    ok = F.col(id_col).isNotNull() & v.isNotNull() & (F.size(v) > 0) & ~bad
    if drop_zero:
        ok &= F.exists(v, lambda x: x != 0)
    rows = df.where(ok).select(F.col(id_col).cast("long").alias("vec_id"), v.cast("array<double>").alias("vec"))
    dims = rows.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    if dims:
        rows = rows.where(F.size("vec") == dims[0]["d"])
    return rows.groupBy("vec_id").agg(F.min("vec").alias("vec"))


def class_id() -> Column:
    return F.md5(F.array_join(F.transform("vec", lambda x: x.cast("string")), ",")).alias("cid")


def classes(rows: DataFrame, k: int) -> DataFrame:
    """(cid, vec, ids): each distinct vector with its k + 1 smallest ids.

    The rank is limited before the shuffle too, so a vector that a third of
    all rows share sends a few rows from each task.
    """
    keyed = rows.select("vec_id", "vec", class_id())
    first = keyed.withColumn("nth", F.row_number().over(W.partitionBy("cid").orderBy("vec_id"))).where(F.col("nth") <= k + 1)
    return first.groupBy("cid").agg(F.min("vec").alias("vec"), F.array_sort(F.collect_list("vec_id")).alias("ids"))


def matrix(col: pa.Array | pa.ChunkedArray, rows: int) -> np.ndarray:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return np.asarray(col.flatten(), dtype=np.float64).reshape(rows, -1)


def sample(cls: DataFrame, rows: int = SAMPLE_ROWS) -> np.ndarray:
    """``rows`` vectors or so, whatever the table's size: those whose class id, a hash, lies below a bound."""
    n = cls.count()
    some = cls.select("cid", "vec")
    if n > rows:
        # the first eight hexadecimal digits of the hash; a tenth more, so that hardly ever fewer than ``rows`` come
        some = some.where(F.conv(F.substring("cid", 1, 8), 16, 10).cast("long") < int(2**32 * min(1.0, 1.1 * rows / n)))
    got = sorted(some.collect())[:rows]
    return np.array([r["vec"] for r in got], dtype=np.float64)


@dataclass
class Segments:
    """Cells packed in groups of about SEGMENT_ROWS; a larger cell is a group of its own, split by salts."""

    group: np.ndarray
    salts: np.ndarray

    @classmethod
    def pack(cls, counts: np.ndarray, cuts: np.ndarray | None = None, rows: int = SEGMENT_ROWS) -> "Segments":
        """counts: entries by cell. cuts: cells at which a group must begin."""
        group, salts, held = np.zeros(len(counts), dtype=np.int64), [0], 0
        for c, n in enumerate(counts.tolist()):
            if c and (held + n > rows and held or cuts is not None and cuts[c]):
                salts.append(0)
                held = 0
            held += n
            group[c], salts[-1] = len(salts) - 1, max(1, -(-held // rows))
        return cls(group, np.array(salts, dtype=np.int64))


def top(scores: np.ndarray, first: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k largest of a row; of ties, those whose first id is least."""
    if len(scores) <= k:
        return np.arange(len(scores))
    last = np.partition(scores, len(scores) - k)[len(scores) - k]
    more, same = np.flatnonzero(scores > last), np.flatnonzero(scores == last)
    left = k - len(more)
    if len(same) > left:
        same = same[np.argpartition(first[same], left - 1)[:left]]
    return np.concatenate([more, same])


def search(
    entries: DataFrame, probes: DataFrame, n_queries: int, meet: Callable[[dict, dict], list[tuple[int, np.ndarray, np.ndarray]]], extra: list[str],
) -> DataFrame:
    """Best classes of each query, (qcid, score, ids), one row for each hit in a segment.

    entries: (g, s, cid, vec, ids, *extra of entries). probes: (g, s, cid,
    vec, ...). ``meet`` gets both sides of one segment and chunk as dicts of
    arrays, and returns (query's position, entries' positions, scores).
    """
    n_chunks = max(1, -(-n_queries // CHUNK_ROWS))
    left = entries.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(n_chunks - 1))) if n_chunks > 1 else F.lit(0))
    right = probes.withColumn("c", F.pmod(F.xxhash64("cid"), F.lit(n_chunks)).cast("int"))

    def arrays(t: pa.Table) -> dict:
        out = {"vec": matrix(t.column("vec"), t.num_rows), "cid": t.column("cid").to_pylist()}
        for name in t.column_names:
            if name in extra:
                out[name] = np.asarray(t.column(name).combine_chunks())
        if "ids" in t.column_names:
            out["ids"] = t.column("ids").combine_chunks()
            out["first"] = np.array([x[0] for x in out["ids"].to_pylist()], dtype=np.int64)
        return out

    def tile(e: pa.Table, q: pa.Table) -> pa.Table:
        who, score, ids = [], [], []
        if e.num_rows and q.num_rows:
            entry, query = arrays(e), arrays(q)
            for i, at, s in meet(entry, query):
                who += [query["cid"][i]] * len(at)
                score.append(s)
                ids.append(at)
            ids = [entry["ids"].take(pa.array(np.concatenate(ids)))] if ids else []
        return pa.table(
            [pa.array(who, pa.string()), pa.array(np.concatenate(score) if score else [], pa.float64()), ids[0].cast(pa.list_(pa.int64())) if ids else pa.array([], pa.list_(pa.int64()))],
            names=["qcid", "score", "ids"],
        )

    return left.groupBy("g", "s", "c").cogroup(right.groupBy("g", "s", "c")).applyInArrow(tile, _HITS)


def ranked(hits: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): k best rows but the query's own, ties to smaller ids.

    queries: (query_id, qcid). A class holds k + 1 ids at least, or all.
    """
    each = hits.select("qcid", "score", F.explode("ids").alias("vec_id"))
    order = (F.desc("score"), F.col("vec_id"))
    best = each.withColumn("nth", F.row_number().over(W.partitionBy("qcid").orderBy(*order))).where(F.col("nth") <= k + 1).drop("nth")
    mine = queries.join(best, "qcid").where(F.col("vec_id") != F.col("query_id"))
    return (
        mine.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
