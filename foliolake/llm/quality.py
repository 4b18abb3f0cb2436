"""Quality classifier: histogram gradient-boosted trees over text statistics.

Trees grow on binned features, and the finished forest lies in flat arrays
(feature, threshold, leaf values, in heap order), which numpy walks for a
whole batch of documents at once, one step for each level.

Inputs: null and empty texts have all statistics 0 and are scored like any
other; labels other than 0 and 1, and null ones, are left out; of several
labels of a document the largest counts; without both labels the score is
the constant share of label 1 (0.5 if there are none); very long texts are
read whole; cuts that gain the same go to the first feature, then the lowest
edge; repeated rows each have a score; an empty table gives an empty result.
Further columns, whatever their names, are not read.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import fold, id_text, map_texts, small_batches, table

#: Labelled documents to learn from at most: those of least hash.
SAMPLE_ROWS = 20_000
TREES, DEPTH, RATE, BINS, LEAST_LEAF, L2 = 80, 4, 0.15, 64, 8, 1.0

FEATURES = (
    "log_bytes", "log_words", "mean_word", "long_words", "short_words", "upper", "digit", "punctuation", "symbol", "pipe", "bang", "non_ascii", "space", "newline",
    "distinct_words", "distinct_lines", "lines", "mean_line", "distinct_pairs", "commonest_word", "entropy", "end_marks", "upper_words", "distinct_ends",
)

_KIND = np.zeros(256, dtype=np.int64)  # 0 other, 1 lower, 2 upper, 3 digit, 4 white space, 5 punctuation, 6 symbol, 7 beyond ASCII
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[128:] = 1, 2, 3, 7
_KIND[[9, 10, 11, 12, 13, 32]] = 4
_KIND[[ord(c) for c in ".,;:!?'\"()-"]] = 5
_KIND[[ord(c) for c in "#$%&*+/<=>@[\\]^_`{|}~"]] = 6


def statistics(text: str | None) -> list[float]:
    data = (text or "").encode("utf-8", "replace")
    if not data.strip():
        return [0.0] * len(FEATURES)
    n = len(data)
    by = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256)
    kinds = np.bincount(_KIND, weights=by, minlength=8) / n
    words, lines = data.split(), [x for x in data.split(b"\n") if x.strip()]
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    count: dict[bytes, int] = {}
    for w in words:
        count[w] = count.get(w, 0) + 1
    pairs = len(set(zip(words, words[1:], strict=False)))
    p = by[by > 0] / n
    m = len(words)
    return [
        float(np.log1p(n)), float(np.log1p(m)), float(lengths.mean()), float((lengths > 15).mean()), float((lengths <= 2).mean()), kinds[2], kinds[3], kinds[5], kinds[6], by[124] / n, by[33] / n, kinds[7], kinds[4], by[10] / n,
        len(count) / m, len(set(lines)) / len(lines), float(np.log1p(len(lines))), float(np.log1p(n / len(lines))), pairs / max(1, m - 1), max(count.values()) / m, float(-(p * np.log2(p)).sum()),
        sum(x.rstrip().endswith((b".", b"!", b"?")) for x in lines) / len(lines), sum(1 for w in count if w.isupper()) / len(count), len({w[-3:] for w in count}) / len(count),
    ]


@dataclass
class Forest:
    """Perfect trees of one depth, as arrays of (tree, node) in heap order."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        rows, out = np.arange(len(x))[:, None], np.full(len(x), self.base)
        if not len(self.leaf):
            return out
        trees, depth = np.arange(len(self.leaf))[None, :], int(np.log2(self.leaf.shape[1]))
        node = np.zeros((len(x), len(self.leaf)), dtype=np.int64)
        for _ in range(depth):
            node = 2 * node + 1 + (x[rows, self.feature[trees, node]] > self.threshold[trees, node])
        return out + self.leaf[trees, node - (self.leaf.shape[1] - 1)].sum(1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def grow(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE, bins: int = BINS, least: int = LEAST_LEAF, l2: float = L2) -> Forest:
    """Boosted trees for the logistic loss; split candidates are quantile bins."""
    none = Forest(np.zeros((0, 0), int), np.zeros((0, 0)), np.zeros((0, 0)), 0.0)
    if not len(y):
        return none
    p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    none.base = float(np.log(p / (1 - p)))
    if y.min() == y.max():
        return none
    n, f = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(f)]
    binned = np.stack([np.searchsorted(edges[j], x[:, j], "left") for j in range(f)], axis=1)
    width = bins + 1
    flat = binned + np.arange(f) * width
    margin, made = np.full(n, none.base), []
    for _ in range(trees):
        q = 1 / (1 + np.exp(-margin))
        g, h = y - q, np.maximum(q * (1 - q), 1e-6)
        node, feat, cut = np.zeros(n, dtype=np.int64), np.zeros(2**depth - 1, dtype=np.int64), np.full(2**depth - 1, np.inf)
        for level in range(depth):
            first, many = 2**level - 1, 2**level
            at = ((node - first) * (f * width))[:, None] + flat
            hist = [np.bincount(at.ravel(), weights=np.repeat(v, f), minlength=many * f * width).reshape(many, f, width) for v in (g, h, np.ones(n))]
            gl, hl, nl = (np.cumsum(v, axis=2) for v in hist)
            gt, ht, nt = gl[:, :, -1:], hl[:, :, -1:], nl[:, :, -1:]
            gain = gl**2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt**2 / (ht + l2)
            gain[(nl < least) | (nt - nl < least)] = -np.inf
            best = gain.reshape(many, -1).argmax(1)
            for k in range(many):
                j, b = divmod(int(best[k]), width)
                if gain[k, j, b] > 1e-9 and b < len(edges[j]):
                    feat[first + k], cut[first + k] = j, edges[j][b]
            node = 2 * node + 1 + (x[np.arange(n), feat[node]] > cut[node])
        own = node - (2**depth - 1)
        leaf = rate * np.bincount(own, weights=g, minlength=2**depth) / (np.bincount(own, weights=h, minlength=2**depth) + l2)
        margin += leaf[own]
        made.append((feat, cut, leaf))
    return Forest(*(np.stack(v) for v in zip(*made, strict=True)), none.base)


def labelled(docs: DataFrame, labels: DataFrame, col: str, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, text, y) of at most ``rows`` labelled documents, those of least hash."""
    known = labels.where(F.col(col).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(col).cast("int").alias("y"))
    chosen = known.withColumn("h", F.xxhash64(id_text(), F.lit(17))).orderBy("h", "doc_id").limit(rows).drop("h")
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # of ``rows`` rows at most


def features(df: DataFrame, keys: list[str]) -> DataFrame:
    """The keys and x, the statistics of ``text``."""
    small_batches(df.sparkSession)
    schema = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys) + ", x array<double>"
    return map_texts(df, lambda _, texts: [list(map(statistics, texts))], schema, [pa.list_(pa.float64())], keys)


def fit(docs: DataFrame, labels: DataFrame, col: str = "quality") -> Forest:
    got = features(labelled(docs, labels, col), ["doc_id", "y"]).orderBy("doc_id").collect()
    return grow(np.array([r["x"] for r in got]).reshape(len(got), len(FEATURES)), np.array([r["y"] for r in got], dtype=float))


def classify(df: DataFrame, forest: Forest) -> DataFrame:
    """(doc_id, score) of each row of (doc_id, text)."""
    small_batches(df.sparkSession)

    def run(_, texts):
        return [forest.score(np.array([statistics(t) for t in texts]))]

    return map_texts(df, run, "doc_id long, score double", [pa.float64()])


def qualities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query op6: quality of every document, learnt from two folds of three."""
    docs = table(spark, sf_dir, "documents").withColumn("doc_id", F.col("doc_id").cast("long"))
    forest = fit(docs.where(fold(3) != 1), table(spark, sf_dir, "labels").where(fold(3) != 1))
    scored = classify(docs, forest)
    return scored.select("doc_id", (fold(3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
