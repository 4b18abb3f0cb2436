"""Near-duplicate detection with MinHash.

Each document is the set of its distinct word shingles. Documents with equal
sets are one node. Minima of many universal hash functions form a signature,
cut in bands; nodes that share a band are candidates. They aren't compared
all with all:

1. Within a band bucket each node meets one hub. Pairs whose signatures agree
   enough and that full sets confirm are links; their components are classes.
2. Buckets that still hold several classes get another hub, which meets the
   nodes of other classes, for as long as that joins a tenth of the classes.
   A bucket of n copies so costs some n pairs and not n^2.
3. The nodes of buckets that are still apart meet through shingles: in an
   order by rarity, sets of similarity t share one of their first
   n - ceil(t n) + 1 shingles. Shingles that one class has to itself come
   first and lead nowhere, so a text that is near to many but like none costs
   nothing, and only pairs of different classes that share one of the other
   leading shingles, and whose sizes and places there allow a link, are
   compared. This step is exact: no link between classes is lost in it.

Alternating large-star and small-star gives the components.

Inputs: null, empty and wordless texts have no shingles and are linked with
nothing; a text with fewer words than a shingle is one shingle; very long
texts are read whole, their minima in blocks; repeated rows and texts are one
node; ties of hubs and keys go to the least; an empty table gives an empty
result; a null doc_id counts as greater than any other and is only its
component's id where there is no other (the document is then kept). Further
columns, whatever their names, are not read.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ._common import Scratch, small_batches, stored, table
from .components import components

#: Hash functions: BANDS * ROWS. At similarity 0.8 a pair shares no band with a probability of 5e-6; at 0.1 it shares one with 4e-5.
BANDS, ROWS = 40, 6
#: Signatures (a byte of each minimum) whose estimate is lower than the threshold by this much, over four deviations, fail.
SLACK = 0.11
#: A further round of hubs follows while the last one left this share of the classes apart at most.
LEFT = 0.9
REMEMBERED = 300_000

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_ODD1, _ODD2, _ODD3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * _ODD2
    x = (x ^ (x >> np.uint64(27))) * _ODD3
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    """64-bit hash by word; forgets all when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = h = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return h


def shingles(text: str | None, words: int, memory: _Words) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes of a whole text."""
    tokens = (text or "").encode("utf-8", "replace").translate(_LOWER).split()
    if not tokens:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(memory.__getitem__, tokens), dtype=np.uint64, count=len(tokens))
    n = min(words, len(h))
    made = np.full(len(h) - n + 1, n, dtype=np.uint64)
    for j in range(n):
        made = _mix(made * _ODD1 + h[j : len(h) - n + 1 + j])
    return np.unique(made)


def hash_family(n: int, seed: int = 20_11) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers (odd) and addends of n universal hash functions x -> a x + b mod 2^64, compared by their high bits."""
    rng = np.random.default_rng(seed)
    return rng.integers(0, 2**64, n, dtype=np.uint64) | np.uint64(1), rng.integers(0, 2**64, n, dtype=np.uint64)


def minima(s: np.ndarray, a: np.ndarray, b: np.ndarray, block: int = 256) -> np.ndarray:
    low = np.full(len(a), np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(s), block):
        h = np.multiply.outer(s[i : i + block], a)
        h += b
        np.minimum(low, h.min(axis=0), out=low)
    return low


_SIGNED = "{key}th long, n_shingles long, node binary, sig binary, bands array<long>"


def signed(df: DataFrame, words: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, th, n_shingles, node, sig, bands) of each row of (doc_id, text).

    th is a hash of the text, node a 128-bit key of the set (null if empty).
    """
    small_batches(df.sparkSession)
    kind = df.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "th", "n_shingles", "node", "sig", "bands"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = hash_family(bands * rows)
        salt, memory = _mix(np.arange(1, bands + 1, dtype=np.uint64) * _ODD1), _Words()
        for batch in batches:
            n, node, sig, keys = [], [], [], []
            for text in batch.column("text").to_pylist():
                s = shingles(text, words, memory)
                n.append(len(s))
                if not len(s):
                    node.append(None), sig.append(None), keys.append(None)
                    continue
                low = minima(s, a, b) >> np.uint64(32)
                node.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                sig.append((low & np.uint64(255)).astype(np.uint8).tobytes())
                band = salt.copy()
                for j in range(rows):
                    band = _mix(band * _ODD1 + low.reshape(bands, rows)[:, j])
                keys.append(band.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("th"), pa.array(n, pa.int64()), pa.array(node, pa.binary()), pa.array(sig, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=names,
            )

    return df.select("doc_id", F.xxhash64("text").alias("th"), "text").mapInArrow(run, _SIGNED.format(key=f"doc_id {kind}, "))


def _sets(wanted: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """(node, sig, n, s) of each row of ``wanted`` (node, k, th, sig): the whole set, sorted, from the text with that key.

    Texts are dealt by key and hash of the text; the few that are wanted stay.
    """
    texts = docs.select(_key().alias("k"), F.xxhash64("text").alias("th"), "text")
    found = texts.join(wanted.hint("shuffle_hash"), ["k", "th"]).dropDuplicates(["k", "th"]).select("node", "sig", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = _Words()
        for b in batches:
            made = [shingles(t, words, memory) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("node"), b.column("sig"), pa.array([len(s) for s in made], pa.int64()), pa.array([s.tobytes() for s in made], pa.binary())], names=["node", "sig", "n", "s"])

    return found.mapInArrow(run, "node binary, sig binary, n long, s binary")


def _key() -> Column:
    """doc_id as text that is never null."""
    return F.coalesce(F.concat(F.lit("i"), F.col("doc_id").cast("string")), F.lit("n"))


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) whose signatures agree enough and that have 100 * intersection >= percent * union on full sets."""
    least = percent / 100 - SLACK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(b.column(c).field("sig").to_pylist()), dtype=np.uint8).reshape(b.num_rows, -1) for c in ("su", "sv"))
            ok = ((x == y).mean(axis=1) - 1 / 256) / (1 - 1 / 256) >= least
            left, right = b.column("su").field("s"), b.column("sv").field("s")
            for i in np.flatnonzero(ok).tolist():
                s, t = np.frombuffer(left[i].as_py(), dtype=np.uint64), np.frombuffer(right[i].as_py(), dtype=np.uint64)
                both = len(np.intersect1d(s, t, assume_unique=True))
                ok[i] = 100 * both >= percent * (len(s) + len(t) - both)
            yield b.select(["u", "v"]).filter(pa.array(ok))

    side = F.struct("sig", "s")
    left, right = sets.select(F.col("node").alias("u"), side.alias("su")), sets.select(F.col("node").alias("v"), side.alias("sv"))
    return pairs.join(left, "u").join(right, "v").select("u", "v", "su", "sv").mapInArrow(run, "u binary, v binary")


def meetings(apart: DataFrame, sets: DataFrame, percent: int, keep: Scratch) -> DataFrame:
    """Pairs (u, v) of rows of ``apart`` (node, root) with different roots that may reach the similarity.

    None that reaches it is left out. Of all shingles only those that nodes
    of several roots share can bring a pair together.
    """
    def exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                n = np.asarray(part.column("n"))
                far = part.select(["node", "r", "n"]).take(pa.array(np.repeat(np.arange(len(n)), n)))
                yield pa.RecordBatch.from_arrays([*far.columns, pa.array(np.frombuffer(b"".join(part.column("s").to_pylist()), dtype=np.int64))], names=["node", "r", "n", "g"])

    rooted = apart.select("node", F.xxhash64("root").alias("r")).join(sets, "node").select("node", "r", "n", "s")
    grams = keep(rooted.mapInArrow(exploded, "node binary, r long, n long, g long"), "grams")
    shared = keep(grams.groupBy("g").agg(F.count("*").alias("df"), F.min("r").alias("a"), F.max("r").alias("z")).where("a != z").select("g", "df"), "shared")
    own = W.partitionBy("node")
    seen = grams.join(shared, "g").withColumn("m", F.count("*").over(own)).withColumn("nth", F.row_number().over(own.orderBy("df", "g")))
    at = F.col("n") - F.col("m") + F.col("nth")
    first = F.col("n") - F.ceil(percent * F.col("n") / 100) + 1
    leading = keep(seen.withColumn("at", at).where(F.col("at") <= first).select("g", "node", "r", "n", "at"), "leading")
    # the root that most nodes with a shingle have: its nodes don't meet each other there, and need not be paired off
    most = keep(leading.groupBy("g", "r").count().groupBy("g").agg(F.max_by("r", F.struct("count", "r")).alias("main"), F.count("*").alias("roots")).where("roots > 1").select("g", "main"), "main")
    here = keep(leading.join(most, "g"), "here")
    # of a pair the smaller set x comes in the class of its size, the larger one y in all classes that its size and its place let it meet
    n, at, main = F.col("n"), F.col("at"), F.col("r") == F.col("main")
    short = here.where((100 + percent) * (1 + n - at) >= 2 * percent * n)
    x = short.select("g", _size_class(n).alias("c"), F.col("node").alias("u"), F.col("r").alias("ru"), n.alias("nu"), at.alias("pu"), main.alias("mu"))
    most_x = F.least(n, F.floor((100 + percent) * (1 + n - at) / percent) - n)
    classes_ = F.when(100 * most_x >= percent * n, F.sequence(_size_class(F.ceil(percent * n / 100)), _size_class(most_x)))
    y = here.select(F.explode(classes_).alias("c"), "g", F.col("node").alias("v"), F.col("r").alias("rv"), n.alias("nv"), at.alias("pv"), main.alias("mv"))
    sizes = (100 * F.col("nu") >= percent * F.col("nv")) & ((F.col("nu") < F.col("nv")) | (F.col("nu") == F.col("nv")) & (F.col("u") < F.col("v")))
    # what sets can have in common if this is the first shingle that they share
    rest = 1 + F.least(F.col("nu") - F.col("pu"), F.col("nv") - F.col("pv"))
    reach = (100 + percent) * rest >= percent * (F.col("nu") + F.col("nv"))
    apart_ = (F.col("ru") != F.col("rv")) & sizes & reach

    def met(left: DataFrame, right: DataFrame) -> DataFrame:
        return left.join(right, ["g", "c"]).where(apart_).select("u", "v")

    return met(x.where("not mu"), y).union(met(x.where("mu"), y.where("not mv"))).distinct()


def _size_class(n: Column) -> Column:
    """Sizes within a twentieth or so of one another share a class."""
    return F.floor(F.log(n.cast("double")) / np.log(1.05)).cast("int")


def _joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """(node, root) after more links (u, v): components of the roots that these link."""
    by = [roots.select(F.col("node").alias(end), F.col("root").alias(f"r{end}")) for end in "uv"]
    ends = links.join(by[0], "u", "left").join(by[1], "v", "left").select(F.coalesce("ru", "u").alias("u"), F.coalesce("rv", "v").alias("v"))
    moved = components(ends).select(F.col("node").alias("was"), F.col("root").alias("now"))
    alone = moved.join(roots, F.col("was") == F.col("node"), "left_anti").select(F.col("was").alias("node"), F.col("now").alias("root"))
    return stored(roots.join(moved, F.col("root") == F.col("was"), "left").select("node", F.coalesce("now", "root").alias("root")).union(alone), "roots")[0]


def classes(df: DataFrame, words: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, th, n_shingles, node, root) of each row of (doc_id, text).

    node is the key of the set, root that of its component; both are null
    for documents without shingles.
    """
    spark = df.sparkSession
    small_batches(spark)
    docs = df.select("doc_id", "text")
    all_, _ = stored(signed(docs, words, bands, rows), "signed")
    with Scratch() as keep:
        # of the rows with one set any stands for it
        one = keep(all_.where(F.col("node").isNotNull()).select("node", _key().alias("k"), "th", "sig", "bands").dropDuplicates(["node"]), "nodes")
        in_band = one.select("node", F.explode("bands").alias("band"))
        shared = keep(in_band.groupBy("band").agg(F.min("node").alias("hub"), F.max("node").alias("last")).where("hub != last").select("band", "hub"), "hubs")
        members = keep(in_band.join(shared, "band").select("band", "hub", "node"), "members")
        wanted = keep(one.join(members.select("node").distinct(), "node").select("node", "k", "th", "sig"), "wanted")
        sets = keep(_sets(wanted, docs, words), "sets")

        def linked(pairs: DataFrame, tag: str) -> DataFrame:
            return keep(_linked(pairs, sets, percent), tag)

        roots = components(linked(members.where("hub != node").select(F.col("hub").alias("u"), F.col("node").alias("v")).distinct(), "star"))
        before = None
        while True:
            rooted = members.join(roots, "node", "left").select("band", "node", F.coalesce("root", "node").alias("root"))
            open_ = keep(rooted.groupBy("band").agg(F.min("root").alias("a"), F.max("root").alias("z"), F.max_by(F.struct("node", "root"), F.xxhash64("node", F.lit(before or 0))).alias("hub")).where("a != z").select("band", "hub"), "open")
            left = keep(rooted.join(open_, "band").select("band", "node", "root", "hub"), "apart")
            apart = left.agg(F.count_distinct("root")).first()[0]
            if not apart or before is not None and apart > LEFT * before:
                break
            more = linked(left.where("hub.root != root").select(F.col("hub.node").alias("u"), F.col("node").alias("v")).distinct(), "round")
            roots, before = _joined(roots, more), apart
        if apart:
            late = linked(meetings(left.select("node", "root").distinct(), sets, percent, keep), "late")
            if not late.isEmpty():
                roots = _joined(roots, late)
    return all_.select("doc_id", "th", "n_shingles", "node").join(roots, "node", "left").select("doc_id", "th", "n_shingles", "node", F.coalesce("root", "node").alias("root"))


def duplicates(df: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row of (doc_id, text)."""
    rows = classes(df, words, percent)
    # written, so that the join has a plain shuffle on both sides and one root with very many rows can be split
    ids, _ = stored(rows.where(F.col("root").isNotNull()).groupBy(F.col("root").alias("r")).agg(F.min("doc_id").alias("least")), "least-ids")
    found = rows.join(ids, F.col("root") == F.col("r"), "left")
    return found.select(
        "doc_id", "n_shingles", F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"),
    ).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def deduplicated(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, all columns, without all but one document of each group.

    The document of least doc_id stays, of several rows of it the one whose
    text's hash is least. Documents without shingles all stay.
    """
    rows = classes(docs, words, percent)
    best = rows.where(F.col("root").isNotNull()).groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("k"))
    stay = best.select(F.col("k.doc_id").alias("__fl_id"), F.col("k.th").alias("__fl_th"), F.lit(True).alias("__fl_whole"))
    empty = rows.where(F.col("root").isNull()).select(F.col("doc_id").alias("__fl_id"), F.col("th").alias("__fl_th"), F.lit(False).alias("__fl_whole")).distinct()
    on = F.col("doc_id").eqNullSafe(F.col("__fl_id")) & (F.col("__fl_h") == F.col("__fl_th"))
    kept = docs.withColumn("__fl_h", F.xxhash64("text")).join(stay.union(empty), on)
    nth = F.row_number().over(W.partitionBy("__fl_id", "__fl_th").orderBy(F.lit(1)))
    return kept.withColumn("__fl_n", nth).where(~F.col("__fl_whole") | (F.col("__fl_n") == 1)).select(*docs.columns)


def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query op5: groups of documents by two-word shingles at 0.8."""
    return duplicates(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text"), words=2, percent=80)


SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w] ELSE list_transform(range(1, len(w)), lambda i: [w[i], w[i + 1]]) END) AS g FROM d
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
links AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id
  JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
  GROUP BY 1, 2, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))
), reach AS (
  SELECT doc_id AS node, doc_id AS to_ FROM documents UNION SELECT r.node, l.v FROM reach r JOIN links l ON r.to_ = l.u
), c AS (SELECT node, min(to_) AS component_id FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN c ON c.node = d.doc_id
"""
