"""Groups of near copies around the threshold, against all pairs."""

import random

import pytest

from foliolake.llm import near_dup

from test_operators import ODD, brute_groups, docs


def dense(seed, copies, words, edits):
    """Copies of one text, each with some words changed, so that pairs lie on both sides of 0.8."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(500)}" for _ in range(words)]
    out = []
    for k in range(copies):
        w = list(base)
        for _ in range(rng.randrange(edits + 1)):
            w[rng.randrange(words)] = rng.choice(["zz", "yy", f"x{k}", f"x{k}{rng.randrange(9)}"])
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("words", [2, 5])
def test_dense_groups_lose_no_link(spark, words):
    """Many nodes of one bucket stay apart, and some are linked only through others."""
    texts = [*dense(1, 90, 80, 12), *dense(2, 40, 25, 4), *ODD]
    random.Random(3).shuffle(texts)
    n, root = brute_groups(texts, words, 80)
    assert len(set(root)) > 15
    got = {r["doc_id"]: r for r in near_dup.duplicates(docs(spark, texts), words=words).collect()}
    assert [got[i]["n_shingles"] for i in range(len(texts))] == n
    assert [got[i]["component_id"] for i in range(len(texts))] == root


def test_meetings_keep_every_link(spark, tmp_path):
    """Without any hub: all nodes apart, each link must come through leading shingles."""
    from foliolake.llm._common import Scratch

    memory = near_dup._Words()
    sets = {i: near_dup.shingles(t, 2, memory) for i, t in enumerate(dense(4, 60, 60, 9))}
    links = {(i, j) for i in sets for j in sets if i < j and 100 * len(set(sets[i]) & set(sets[j])) >= 80 * len(set(sets[i]) | set(sets[j]))}
    rows = spark.createDataFrame([(bytes([i]), len(s), s.tobytes()) for i, s in sets.items()], "node binary, n long, s binary")
    # three roots, as if hubs had joined some
    for roots in (lambda i: i, lambda i: i % 3):
        apart = spark.createDataFrame([(bytes([i]), bytes([roots(i)])) for i in sets], "node binary, root binary")
        with Scratch() as keep:
            got = {tuple(sorted((r["u"][0], r["v"][0]))) for r in near_dup.meetings(apart, rows, 80, keep).collect()}
        want = {(i, j) for i, j in links if roots(i) != roots(j)}
        assert want and want <= got
        assert all(roots(i) != roots(j) for i, j in got)


def test_no_documents(spark):
    assert near_dup.duplicates(docs(spark, [])).count() == 0
    assert near_dup.deduplicated(docs(spark, [])).count() == 0
    assert [r["kept"] for r in near_dup.duplicates(docs(spark, [None, "", " "])).collect()] == [True] * 3
