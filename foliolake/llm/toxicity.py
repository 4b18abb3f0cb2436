"""Toxicity of noisy text: decode it first, then score what was meant.

A token with look-alike digits and signs, doubled or stretched letters, or
letters set apart is a lattice of the characters it may stand for. Viterbi decoding under
a character trigram model of the whole corpus, plus the cost of each
substitution, gives the restored words. Weights of restored words and of
their beginnings come from labelled documents; the evidence of a document's
distinct words is added up and calibrated to a probability.

Inputs: null and empty texts have no evidence and get the calibrated score
of none; very long texts and tokens are read whole, in time that grows with
their length; labels other than 0 and 1, and null ones, are left out; of
several labels of a document the largest counts; readings that cost the same
go to the one found first; repeated rows each have a score; an empty table
gives an empty result; without labels every document has the same low score.
Further columns, whatever their names, are not read.
"""

import os.path
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache, reduce
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import fold, map_texts, small_batches, table
from .quality import labelled

#: Labelled documents to learn from, and words that carry weight, at most.
SAMPLE_ROWS, LEXICON = 20_000, 20_000
#: A word weighs if the lower bound of its share of toxic documents (at Z deviations) reaches LEAST_SHARE.
Z, LEAST_SHARE, STEMS = 3.0, 0.4, (4, 5, 6)
#: Tokens whose restored form a task remembers.
REMEMBERED = 300_000

# fixed values: what a look-alike may stand for
LOOKS = {
    "0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "¡": "i",
}
#: Costs in nats: a look-alike read as a letter, or as no letter; letters set apart that are joined, for each; a stretched letter read as two; two equal letters read as one.
READ, NOT_READ, JOIN, TWICE, ONCE = 1.0, 7.0, 1.0, 0.5, 4.5

_EDGE = ".,;:?\"'`*&%#~()[]{}<>/\\=^…«»“”„‘’-–—_"
_MARKS = "!$@|+"
_DOUBLED = re.compile(r"(.)\1")
_ODD = re.compile("[" + re.escape("".join(LOOKS)) + r"]|(.)\1")
_SIGN = r"(?:[^\W_]|[" + re.escape("".join(c for c in LOOKS if not c.isalnum())) + "])"
_APART = re.compile(rf"{_SIGN}(?:[.,/\-_*·]+{_SIGN}){{2,}}")
_SPACED = re.compile(rf"(?<!\S){_SIGN}(?:\s++{_SIGN}){{2,}}(?!\S)")
_GAPS = re.compile(r"\s+")
_WORDS = re.compile(r"[^\W\d_]+")

#: Alphabet of the character model: 0 is no letter, then a to z, lower-case Latin-1, and one for all other letters.
SYMBOLS = 1 + 26 + 32 + 1


def _symbol(c: str) -> int:
    if "a" <= c <= "z":
        return ord(c) - 96
    if 0xDF <= ord(c) <= 0xFE and c.isalpha():
        return 27 + ord(c) - 0xDF
    return SYMBOLS - 1 if c.isalpha() else 0


#: The step after a token.
_END = [[(" ", 0.0, (0,))]]


def _code_table() -> np.ndarray:
    """Symbol of each code point below 0x250, upper-case like lower-case; the last is for all beyond."""
    return np.array([_symbol(chr(i).lower()[:1]) for i in range(0x250)] + [SYMBOLS - 1], dtype=np.int64)


def trigrams(df: DataFrame) -> DataFrame:
    """(gram, n): counts of all symbol trigrams of ``text``; SYMBOLS ** 3 rows at most."""
    small_batches(df.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, total = _code_table(), np.zeros(SYMBOLS**3, dtype=np.int64)

        def add(text: str) -> None:
            at = np.frombuffer(f"  {text}  ".encode("utf-32-le", "replace"), dtype="<u4")
            s = codes[np.minimum(at, 0x250)]
            total[:] += np.bincount((s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:], minlength=SYMBOLS**3)

        for b in batches:
            some, held = [], 0
            for text in b.column("text").to_pylist():
                if text:
                    some.append(text)
                    held += len(text)
                    if held > 500_000:
                        add("  ".join(some))
                        some, held = [], 0
            if some:
                add("  ".join(some))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["gram", "n"])

    return df.select("text").mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def character_model(df: DataFrame) -> np.ndarray:
    """Costs in nats of each symbol after two others, from all texts of ``df``; backs off to shorter contexts."""
    n = np.zeros(SYMBOLS**3)
    for r in trigrams(df).collect():  # SYMBOLS ** 3 rows at most
        n[r["gram"]] = r["n"]
    n = n.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    one = (n.sum((0, 1)) + 1) / (n.sum() + SYMBOLS)
    two = (n.sum(0) + 10 * one) / (n.sum((0, 2))[:, None] + 10)
    three = (n + 10 * two[None]) / (n.sum(2)[:, :, None] + 10)
    return -np.log(three).astype(np.float32).ravel()


class Decoder:
    def __init__(self, costs: np.ndarray, remembered: int = REMEMBERED):
        self.costs, self.memory, self.remembered = costs.tolist(), {}, remembered

    def viterbi(self, lattice: Iterable[list[tuple]], before: int = 0) -> tuple[str, float]:
        """The cheapest reading; of equal ones the first found.

        A state is the last two symbols as one number, ``before`` the first.
        It points back to the one before it; what all states share is written
        out on the way, so a long token takes time and memory in proportion
        to its length.
        """
        costs, n, square, done = self.costs, SYMBOLS, SYMBOLS * SYMBOLS, []
        states: dict[int, tuple[float, tuple | None]] = {before: (0.0, None)}
        for k, options in enumerate(chain(lattice, _END)):
            then: dict[int, tuple[float, tuple | None]] = {}
            for s, (cost, path) in states.items():
                for out, extra, codes in options:
                    x, c = s, cost + extra
                    for z in codes:
                        x = x * n + z
                        c += costs[x]
                        x %= square
                    had = then.get(x)
                    if had is None or c < had[0]:
                        then[x] = (c, (path, out))
            states = then
            if k % 256 == 255:
                states = self._settled(states, done)
        cost, path = min(states.values(), key=lambda s: s[0])
        return "".join(done + self._back(path))[:-1], cost  # without the sign of the end

    @staticmethod
    def _back(path: tuple | None) -> list[str]:
        out = []
        while path is not None:
            path, piece = path
            out.append(piece)
        return out[::-1]

    @classmethod
    def _settled(cls, states: dict, done: list[str]) -> dict:
        """The states without the beginning that all their readings share, which goes to ``done``."""
        read = {key: cls._back(path) for key, (_, path) in states.items()}
        same = len(os.path.commonprefix(list(read.values())))
        done += next(iter(read.values()))[:same]
        return {key: (cost, reduce(lambda p, x: (p, x), read[key][same:], None)) for key, (cost, _) in states.items()}

    @staticmethod
    @lru_cache(4096)
    def run(c: str, n: int) -> list[list[tuple[str, float, tuple[int, ...]]]]:
        """Readings, with costs and symbols, of a character that stands ``n`` times (3 for more) in a row: one letter, or two."""
        if c in LOOKS:
            reads = [(r, READ) for r in LOOKS[c]] + [(" ", NOT_READ)]
        elif c.isalpha():
            reads = [(c, 0.0)]
        else:
            reads, n = [(" ", 0.0)], 1
        again = [] if n == 1 else [*reads, ("", ONCE)] if n == 2 else [*((r, cost + TWICE) for r, cost in reads), ("", 0.0)]
        return [[(out, cost, tuple(map(_symbol, out))) for out, cost in options] for options in (reads, again) if options]

    @classmethod
    def lattice(cls, token: str) -> list[list[tuple]]:
        return list(cls.steps(token))

    @classmethod
    def steps(cls, token: str) -> Iterator[list[tuple]]:
        for c, same in groupby(token):
            yield from cls.run(c, min(3, sum(1 for _ in same)))

    def restore(self, token: str) -> str:
        """The words that a token stands for, in lower case, with single spaces between."""
        return self._known(token.lower())

    def _known(self, token: str) -> str:
        """``restore`` of a token in lower case; what takes more than a look is remembered."""
        core = token if token.isalpha() else token.strip(_EDGE)
        if core.isalpha() and not _DOUBLED.search(core):
            return core
        got = self.memory.get(token)
        if got is None:
            got = self._restore(token)
            if len(token) <= 64:
                if len(self.memory) >= self.remembered:
                    self.memory.clear()
                self.memory[token] = got
        return got

    def _restore(self, token: str) -> str:
        whole = token.strip(_EDGE)
        core = self._bare(whole).strip(_EDGE)
        if core.isalpha() and not _DOUBLED.search(core):
            return core
        for t in (whole, core):
            if _APART.fullmatch(t):
                return self._joined([c for c in t if c.isalnum() or c in LOOKS])[0]
        odd = [m.span() for m in _ODD.finditer(core)]
        if odd:
            # what stands before is certain, and after two certain signs nothing that follows can matter
            first, last = odd[0][0], odd[-1][1]
            while last < len(core) and core[last] == core[last - 1]:
                last += 1
            before = [_symbol(c) for c in core[max(0, first - 2) : first]]
            got = self.viterbi(self.steps(core[first : last + 2]), (before[-2] if len(before) > 1 else 0) * SYMBOLS + (before[-1] if before else 0))[0]
            core = core[:first] + got + core[last + 2 :]
        return " ".join(_WORDS.findall(core))

    @staticmethod
    def _bare(token: str) -> str:
        """Without a run of one mark at either end, and without a single exclamation mark at the end."""
        if token and token[0] in _MARKS and token[:1] == token[1:2]:
            token = token.lstrip(token[0])
        if token and token[-1] in _MARKS and (token[-1:] == token[-2:-1] or token[-1] == "!"):
            token = token.rstrip(token[-1])
        return token

    def _joined(self, letters: list[str]) -> tuple[str, float]:
        """Letters set apart as one word, unless they are likelier as they stand; and the cost."""
        lattice = self.lattice("".join(letters))
        if letters[-1] == "!":
            lattice[-1] = [*lattice[-1], ("", 0.0, ())]  # a mark at the end
        joined, cost = self.viterbi(lattice)
        cost += JOIN * (len(letters) - 1)
        apart = [(w.strip(), c) for w, c in (self.viterbi(self.lattice(c)) for c in letters)]
        if cost >= sum(c for _, c in apart):
            joined, cost = " ".join(w for w, _ in apart if w), sum(c for _, c in apart)
        return " ".join(joined.split()), cost

    def _spaced(self, found: str) -> list[tuple[str, float]]:
        """Readings of letters set apart by white space: all as one word, and, where gaps differ, one word from each wider gap to the next."""
        letters, gaps = found.lower().split(), [len(g) for g in _GAPS.findall(found)]
        out, least, group = [self._joined(letters)], min(gaps), [[letters[0]]]
        for c, gap in zip(letters[1:], gaps, strict=True):
            if gap > least:
                group.append([])
            group[-1].append(c)
        if len(group) > 1:
            parts = [self._joined(g) for g in group]
            out.append((" ".join(w for w, _ in parts if w), sum(c for _, c in parts)))
        return out

    def words(self, text: str | None) -> set[str]:
        """Distinct restored words of a whole text."""
        if not text:
            return set()
        found = set()
        for got in map(self._known, set(text.lower().split())):
            if " " in got:
                found.update(got.split(" "))
            else:
                found.add(got)
        for m in _SPACED.finditer(text):
            for got, _ in self._spaced(m[0]):
                found.update(got.split(" "))
        found.discard("")
        return found

    def restored(self, text: str | None) -> str:
        """The restored text as a whole, words in order."""
        if not text:
            return ""
        spaced = _SPACED.sub(lambda m: min(self._spaced(m[0]), key=lambda r: r[1])[0], text)
        return " ".join(w for w in map(self.restore, spaced.split()) if w)


def units(word: str) -> Iterable[str]:
    """A word, and its beginnings, marked by a final dash."""
    yield word
    for n in STEMS:
        if len(word) > n:
            yield word[:n] + "-"


def unit_counts(df: DataFrame, costs: np.ndarray) -> DataFrame:
    """(unit, pos, neg): documents of (text, y) that hold each unit."""
    small_batches(df.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(costs)
        for b in batches:
            by = (Counter(), Counter())
            for text, y in zip(b.column("text").to_pylist(), b.column("y").to_pylist(), strict=True):
                by[y].update({u for w in decoder.words(text) for u in units(w)})
            names = sorted(by[0].keys() | by[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([by[1][u] for u in names], pa.int64()), pa.array([by[0][u] for u in names], pa.int64())], names=["unit", "pos", "neg"])

    return df.select("text", "y").mapInArrow(count, "unit string, pos long, neg long").groupBy("unit").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def lexicon(counts: DataFrame, most: int = LEXICON, z: float = Z, least: float = LEAST_SHARE) -> dict[str, float]:
    """Weight by unit, the evidence in nats of one that is toxic as often as its lower bound says."""
    n, p = F.col("pos") + F.col("neg"), F.col("pos") / (F.col("pos") + F.col("neg"))
    low = (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)
    got = counts.where("pos >= 3").select("unit", low.alias("low")).where(F.col("low") >= least).orderBy(F.desc("low"), "unit").limit(most).collect()
    return {r["unit"]: float(-np.log(max(1e-4, 1 - r["low"]))) for r in got}


def evidence(decoder: Decoder, weights: dict[str, float], text: str | None) -> float:
    """Of each distinct restored word the heaviest unit, added up."""
    total = 0.0
    for w in decoder.words(text):
        total += max(weights.get(w, 0.0), weights.get(w[:4] + "-", 0.0), weights.get(w[:5] + "-", 0.0), weights.get(w[:6] + "-", 0.0))
    return min(total, 12.0)


def calibrate(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Intercept and slope of a logistic regression on log(1 + evidence); the slope can't be negative."""
    if not len(y) or y.min() == y.max():
        return -2.0, 4.0
    f, w = np.stack([np.ones(len(x)), np.log1p(x)], axis=1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(f @ w, -30, 30)))
        g = f.T @ (y - p) - np.array([0.0, 0.05]) * w
        h = (f * (p * (1 - p))[:, None]).T @ f + np.diag([1e-6, 0.05])
        step = np.linalg.solve(h, g)
        w += np.clip(step, -4, 4)
        if abs(step).max() < 1e-8:
            break
    return (float(w[0]), float(w[1])) if w[1] > 0 else (-2.0, 4.0)


class Scorer:
    """All that is learnt; plain values, so that it travels to executors."""

    def __init__(self, costs: np.ndarray, weights: dict[str, float], line: tuple[float, float]):
        self.costs, self.weights, self.line = costs, weights, line

    def scores(self, decoder: Decoder, texts: Iterable[str | None]) -> np.ndarray:
        x = np.log1p([evidence(decoder, self.weights, t) for t in texts])
        return 1 / (1 + np.exp(-np.clip(self.line[0] + self.line[1] * x, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame) -> Scorer:
    """The character model from all ``docs``; weights and calibration from labels outside held-out fold 0.

    Fold 1 of five calibrates what folds 2 to 4 have taught.
    """
    costs = character_model(docs)
    sample = labelled(docs, labels.where(fold(5) != 0), "toxic", SAMPLE_ROWS)
    weights = lexicon(unit_counts(sample.where(fold(5) != 1), costs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(costs)
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([evidence(decoder, weights, t) for t in b.column("text").to_pylist()], pa.float64()), b.column("y")], names=["x", "y"])

    got = sample.where(fold(5) == 1).select("text", "y").mapInArrow(run, "x double, y int").collect()  # SAMPLE_ROWS at most
    return Scorer(costs, weights, calibrate(np.array([r["x"] for r in got]), np.array([r["y"] for r in got], dtype=float)))


def score(df: DataFrame, scorer: Scorer, keys: list[str] | None = None) -> DataFrame:
    """The keys and score of each text."""
    small_batches(df.sparkSession)
    keys = keys or ["doc_id"]
    schema = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys) + ", score double"
    return map_texts(df, lambda decoder, texts: [scorer.scores(decoder, texts)], schema, [pa.float64()], keys, start=lambda: Decoder(scorer.costs))


def scored_rows(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """``docs``, all columns, with __fl_score."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(scorer.costs)
        for b in batches:
            made = pa.array(scorer.scores(decoder, b.column("text").to_pylist()), pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns, made], names=[*b.schema.names, "__fl_score"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("__fl_score", T.DoubleType())]))


def toxicities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query op3: toxicity of every document, learnt from four folds of five."""
    docs = table(spark, sf_dir, "documents").withColumn("doc_id", F.col("doc_id").cast("long"))
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (fold(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
