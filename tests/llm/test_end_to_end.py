"""Each query on folders of tables: planted cases, odd rows, empty tables; and the pipeline stage by stage."""

import random
import zlib

import pytest
from pyspark.sql import functions as F
from test_operators import brute_groups

import corpus_pipeline
from foliolake.llm import queries, sentence_pieces

DOCS = "doc_id long, text string, lang string, source string, n_chars long, node string, score double"
LABELS = "doc_id long, quality int, toxic int, text string"
VECTORS = "vec_id long, embedding array<double>, cid string, rank int"
TALKS = "conv_id long, turn int, role string, text string, part int"


def folder(spark, path, docs=(), labels=(), vectors=(), talks=()):
    """Tables with columns whose names the operators use too."""
    rows = [(*d, len(d[1] or ""), "x", 0.5) for d in docs]
    for name, data, schema in (("documents", rows, DOCS), ("labels", [(*x, "t") for x in labels], LABELS), ("embeddings", [(*v, "c", 1) for v in vectors], VECTORS), ("conversations", [(*t, 1) for t in talks], TALKS)):
        spark.createDataFrame(list(data), schema).write.parquet(f"{path}/{name}.parquet")
    return str(path)


def fold(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


SYLLABLES = {"en": "the ing and ould ight ack ness ough", "de": "sch ein ung ich keit ver auf zen", "es": "cion ando mente los por aje illo ar"}


def prose(rng, lang, n):
    s = SYLLABLES[lang].split()
    return " ".join("".join(rng.choice(s) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def test_languages_are_told_on_the_held_out_fold(spark, tmp_path):
    rng, docs = random.Random(1), []
    for i in range(240):
        lang = ("en", "de", "es")[i % 3]
        docs.append((i, prose(rng, lang, 60), lang if i % 7 else None, "s"))
    odd = [(900, None, "en", "s"), (901, "", None, None), (902, "12 34 !?", "de", "s"), (0, docs[0][1], "en", "s")]
    got = queries.QUERIES["op2_language_id"](spark, folder(spark, tmp_path, docs + odd)).collect()
    assert len(got) == 244
    right = [r["lang_pred"] == ("en", "de", "es")[r["doc_id"] % 3] for r in got if r["doc_id"] < 240 and r["held_out"]]
    assert len(right) > 30 and sum(right) >= 0.95 * len(right)
    assert all(r["held_out"] == (fold(r["doc_id"], 4) == 2) and 0 <= r["score"] <= 1 for r in got)
    assert {r["lang_pred"] for r in got if r["doc_id"] >= 900} == {"und"}


def test_quality_is_told_on_the_held_out_fold(spark, tmp_path):
    rng, docs, labels = random.Random(2), [], []
    for i in range(240):
        good = i % 2
        text = ". ".join(prose(rng, "en", 9).capitalize() for _ in range(6)) + "." if good else " ".join(rng.choice(["BUY!!", "$$$", "click", "###", "|"]) for _ in range(60))
        docs.append((i, text, "en", "s")), labels.append((i, good, 0))
    docs += [(900, None, None, None), (901, "", None, "s"), (0, docs[0][1], "en", "s")]
    labels += [(0, None, 0), (None, 1, 0), (5, 7, 0), (1, 1, None)]
    got = queries.QUERIES["op6_quality"](spark, folder(spark, tmp_path, docs, labels)).collect()
    assert len(got) == 243 and all(r["held_out"] == (fold(r["doc_id"], 3) == 1) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    held = [r["predicted"] == r["doc_id"] % 2 for r in got if r["doc_id"] < 240 and r["held_out"]]
    assert len(held) > 40 and sum(held) >= 0.95 * len(held)


BAD = ["idiot", "stupid", "moron", "loser"]


def noisy(rng, word):
    return rng.choice([word, word.upper(), word.replace("i", "1").replace("o", "0"), ".".join(word), word.replace("o", "ooo").replace("u", "uuu"), word.replace("s", "$")])


def planted(rng, n):
    docs, labels = [], []
    for i in range(n):
        words = prose(rng, "en", 50).split()
        if i % 4 == 0:
            for _ in range(4):
                words.insert(rng.randrange(50), noisy(rng, rng.choice(BAD)))
        docs.append((i, " ".join(words), "en", f"s{i % 3}")), labels.append((i, 1, int(i % 4 == 0)))
    return docs, labels


def test_toxic_documents_are_told_on_the_held_out_fold(spark, tmp_path):
    docs, labels = planted(random.Random(3), 400)
    docs += [(900, None, None, None), (901, "", None, "s"), (0, docs[0][1], "en", "s")]
    got = queries.QUERIES["op3_toxicity"](spark, folder(spark, tmp_path, docs, labels)).collect()
    assert len(got) == 403 and all(r["held_out"] == (fold(r["doc_id"], 5) == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    held = [(r["predicted"], int(r["doc_id"] % 4 == 0)) for r in got if r["doc_id"] < 400 and r["held_out"]]
    assert sum(p == 1 for p, y in held if y) >= 0.9 * sum(y for _, y in held) and not any(p for p, y in held if not y)


ODD_DOCS = [(None, None, None, None), (None, "a b c", "en", "s"), (1, "", "en", None), (1, "", "en", None), (2, "word " * 4000, "en", "s"), (3, "x", None, "s"), (3, "y", "en", "t"), (4, "x" * 60_000, "en", "s"), (5, " \n\t", "de", "s")]
ODD_LABELS = [(None, None, None), (1, 1, 1), (1, 0, 0), (2, 1, 0), (99, 5, 5)]
ODD_VECTORS = [(None, [1.0]), (0, None), (0, [1.0, 2.0]), (20, [1.0, 2.0]), (20, [1.0, 2.0]), (50, [float("nan"), 1.0]), (100, [0.0, 0.0]), (3, [2.0, None]), (4, [])]
ODD_TALKS = [(None, None, None, None), (1, 1, "ann", "hi"), (1, 1, "ann", "hi"), (1, 2, "bob", None), (2, 1, "", "x" * 60_000)]


@pytest.mark.parametrize("name", queries.QUERIES)
def test_odd_rows_and_empty_tables(spark, tmp_path, name):
    odd = folder(spark, tmp_path / "odd", ODD_DOCS, ODD_LABELS, ODD_VECTORS, ODD_TALKS)
    got = queries.QUERIES[name](spark, odd)
    rows = got.collect()
    if "doc_id" in got.columns:
        assert len(rows) == len(ODD_DOCS)
    none = queries.QUERIES[name](spark, folder(spark, tmp_path / "none"))
    assert none.dtypes == got.dtypes and none.count() == 0


def test_pipeline_stage_by_stage(spark, tmp_path):
    rng = random.Random(4)
    docs, labels = planted(rng, 240)
    near = [(500 + k, " ".join([*docs[1][1].split()[:-1], f"end{k}"]), "en", "s1") for k in range(3)]
    private = [(600, prose(rng, "en", 30) + " mail ann@example.com now", "en", "s0"), (601, prose(rng, "en", 30) + " call +1 (978) 555-2485", "en", None)]
    sf = folder(spark, tmp_path, docs + near + private + [(700, None, None, None), (701, "", "en", "s2")], labels)
    kept = spark.read.parquet(f"{sf}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    out = {}
    for n, stage in corpus_pipeline.STAGES:
        before = kept
        kept = stage(spark, kept, sf)
        kept.write.parquet(f"{tmp_path}/out/{n}")
        kept = spark.read.parquet(f"{tmp_path}/out/{n}")
        out[n] = (before, kept)
        assert n == names[-1] or kept.columns == before.columns

    def ids(df):
        return {r["doc_id"] for r in df.select("doc_id").collect()}

    was, now = out["toxicity"]
    assert ids(was) - ids(now) <= {i for i, *_ in docs if i % 4 == 0} and len(ids(was) - ids(now)) >= 50
    was, now = out["near_dedup"]
    rows = sorted((r["doc_id"], r["text"]) for r in was.select("doc_id", "text").collect())
    _, root = brute_groups([t for _, t in rows], 5, 80)
    assert ids(now) == {rows[i][0] for i, r in enumerate(root) if i == r} and not ids(now) & {500, 501, 502}
    was, now = out["pii"]
    new, old = ({r["doc_id"]: r["text"] for r in df.collect()} for df in (now, was))
    assert new[600] == old[600].replace("ann@example.com", "[EMAIL]") and new[601] == old[601].replace("+1 (978) 555-2485", "[PHONE]")
    assert all(new[i] == old[i] for i in old if i < 500)
    was, now = out["mixing"]
    words = {r["doc_id"]: len((r["text"] or "").split()) for r in was.collect()}
    taken = now.select(F.sum(F.size(F.split(F.trim("text"), r"\s+")))).first()[0]
    assert abs(taken - 1.5 * sum(words.values())) <= 400 and ids(now) <= {i for i, n in words.items() if n}
    was, now = out["sentence_pieces"]
    back = sorted(r["text"] for r in sentence_pieces.decode(now).collect())
    assert back == sorted(r["text"] for r in was.collect())
    again = corpus_pipeline.run(spark, sf)
    assert sorted(map(str, again.collect())) == sorted(map(str, now.collect()))
