"""The vector searches on tables of more than one segment, against all rows."""

import numpy as np
import pytest

from foliolake.llm import _vectors, multi_index, pivot_index


@pytest.fixture(scope="module")
def many(spark):
    """20,000 vectors without clusters, the hardest case, a tenth of them copies of one."""
    x = np.random.default_rng(5).normal(size=(20_000, 16))
    x[::10] = x[7]
    x = np.round(x, 3)
    rows = [(i, v, "c") for i, v in enumerate(x.tolist())]
    return x, spark.createDataFrame(rows, "vec_id long, embedding array<double>, cid string")


def best(x, q, k):
    s = x @ x[q]
    return s, [i for i in np.lexsort((np.arange(len(x)), -s)) if i != q][:k]


def test_multi_index_finds_nine_of_ten(spark, many):
    """Every row is indexed, only a share of them is compared, and the recall holds."""
    x, df = many
    got = multi_index.knn(df, lambda i: i % 400 == 3, k=20).collect()
    found, want = {}, 0
    for r in got:
        found.setdefault(r["query_id"], {})[r["vec_id"]] = r["score"]
    hits = 0
    for q in range(3, len(x), 400):
        s, near = best(x, q, 20)
        assert len(found[q]) == 20 and all(v == pytest.approx(s[i], abs=1e-12) for i, v in found[q].items())
        hits, want = hits + len(set(near) & set(found[q])), want + 20
    assert hits / want >= 0.9


def test_multi_index_compares_a_share_only(many):
    x, _ = many
    grid = np.full((128, 128), 2)
    d = np.random.default_rng(6).normal(size=(2, 128))
    _, cells = multi_index.walk(d[0], d[1], grid, int(multi_index.SHARE * grid.sum()))
    assert 0.4 <= len(cells) / grid.size <= 0.41


def test_pivot_index_is_exact_over_segments_and_chunks(spark, many, monkeypatch):
    """Small segments and chunks, so that annuli are split, salted and pruned."""
    monkeypatch.setattr(_vectors, "CHUNK_ROWS", 16)
    monkeypatch.setattr(_vectors.Segments.pack.__func__, "__defaults__", (None, 300))
    x, df = many
    whole = np.floor(256 * x[:4000])
    rows = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(whole)], "vec_id long, embedding array<double>")
    got = {}
    for r in pivot_index.topk(rows, lambda i: i % 100 == 7, k=5).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert len(got) == 40
    for q, mine in got.items():
        s, near = best(whole, q, 5)
        assert sorted(mine) == [(k + 1, i, int(s[i])) for k, i in enumerate(near)]


def test_vectors_of_another_length_take_no_part(spark):
    rows = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [2.0, 0.0, 1.0]), (3, [0.5, 0.0]), (3, [0.1, 0.0]), (None, [1.0, 1.0])], "vec_id long, embedding array<double>")
    for search in (multi_index.knn, pivot_index.topk):
        got = {(r["query_id"], r["vec_id"]) for r in search(rows, lambda i: i == 0, k=5).collect()}
        assert got == {(0, 1), (0, 3)}
        assert search(rows.limit(0), lambda i: i == 0, k=5).count() == 0
