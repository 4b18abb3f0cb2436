"""SentencePiece encoding and decoding.

An Aho-Corasick automaton over the pieces reads a text once; at each
position it follows its output links, from the longest piece that ends there
to shorter ones, and relaxes the best score of a segmentation up to that
position. Characters that no piece covers become byte pieces.

As in the model's own normaliser, a space is written U+2581 and one is put in
front. A literal U+2581 goes to byte pieces, by way of a character that
neither the text nor a piece holds, so decoding restores every text. Unpaired
surrogates can't occur in Spark strings.

Inputs: a null text has null ids, an empty text none; very long texts are
encoded whole; repeated rows each have their ids; of segmentations with equal
scores the one whose last piece is longest, and so on back, is taken; an
empty table gives an empty result. Columns but the keys, whatever their
names, are not read.
"""

import gc
import hashlib
import re
from collections import deque
from collections.abc import Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import map_texts, process_cache, small_batches, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Stretches of text whose ids a task remembers.
REMEMBERED = 200_000
#: Score of a byte piece, below any sum of real pieces for one character.
_BYTE = -1e6


def load(path: str = MODEL) -> tuple[list[str | None], list[float], list[int]]:
    """Pieces by id (None if text can't match it), their scores, and the ids of the 256 bytes."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces, scores, of_byte = [], [], [-1] * 256
    for i in range(sp.get_piece_size()):
        piece = sp.id_to_piece(i)
        if sp.is_byte(i):
            of_byte[int(piece[1:-1], 16)] = i
        plain = not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))
        pieces.append(piece if plain else None)
        scores.append(sp.get_score(i))
    return pieces, scores, of_byte


class Codec:
    """pieces: by id, None for those that text can't match. of_byte: ids of byte pieces."""

    def __init__(self, pieces: Sequence[str | None], scores: Sequence[float], of_byte: Sequence[int], remembered: int = REMEMBERED):
        self.scores, self.of_byte = list(scores), list(of_byte)
        self.bytes_of = [b"" if p is None else p.replace(SPACE, " ").encode() for p in pieces]
        for b, i in enumerate(of_byte):
            if i >= 0:
                self.bytes_of[i] = bytes([b])
        self.letters = frozenset(c for p in pieces if p for c in p)
        self._build({p: i for i, p in enumerate(pieces) if p})
        self.remembered, self.memory = remembered, {}
        # no piece goes on past a character before U+2581, so a text falls apart there
        self.apart = not any(p and re.search(f"[^{SPACE}]{SPACE}", p) for p in pieces)
        self.cut = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n" if not any(p and "\n" in p for p in pieces) else f"{SPACE}*[^{SPACE}]+|{SPACE}+")

    def _build(self, pieces: dict[str, int]) -> None:
        """Transitions, the piece that ends in each state, and output links."""
        go, ends, depth = [{}], [-1], [0]
        for piece, i in pieces.items():
            s = 0
            for c in piece:
                if c not in go[s]:
                    go[s][c] = len(go)
                    go.append({}), ends.append(-1), depth.append(depth[s] + 1)
                s = go[s][c]
            ends[s] = i
        fail, link = [0] * len(go), [0] * len(go)
        queue = deque(go[0].values())
        while queue:
            s = queue.popleft()
            link[s] = fail[s] if ends[fail[s]] >= 0 else link[fail[s]]
            for c, t in go[s].items():
                queue.append(t)
                f = fail[s]
                while f and c not in go[f]:
                    f = fail[f]
                fail[t] = go[f].get(c, 0) if go[f].get(c, 0) != t else 0
        self.go, self.ends, self.fail, self.link, self.depth = go, ends, fail, link, depth

    def _free(self, text: str) -> str:
        """A character that neither the text nor any piece holds."""
        held = self.letters.union(text)
        return next(c for c in map(chr, chain(range(0xE000, 0x110000), range(0xD800))) if c not in held and not c.isspace())

    def viterbi(self, s: str, literal: str | None = None) -> list[int]:
        """Ids of the best segmentation; of equal ones, the one whose last piece is longest, and so on back.

        literal: the character that stands for a U+2581 of the text itself.
        """
        go, ends, fail, link, depth, scores = self.go, self.ends, self.fail, self.link, self.depth, self.scores
        best, from_, piece, state = [0.0], [0], [-1], 0
        for pos, c in enumerate(s, 1):
            while state and c not in go[state]:
                state = fail[state]
            state = go[state].get(c, 0)
            top, at, which = best[pos - 1] + _BYTE, pos - 1, -1
            out = state if ends[state] >= 0 else link[state]
            while out:
                start = pos - depth[out]
                score = best[start] + scores[ends[out]]
                if score > top:
                    top, at, which = score, start, ends[out]
                out = link[out]
            best.append(top), from_.append(at), piece.append(which)
        ids, pos = [], len(s)
        while pos:
            if piece[pos] >= 0:
                ids.append(piece[pos])
            else:
                c = SPACE if s[pos - 1] == literal else s[pos - 1]
                ids += [self.of_byte[b] for b in reversed((" " if s[pos - 1] == SPACE else c).encode("utf-8", "replace"))]
            pos = from_[pos]
        return ids[::-1]

    def _stretch(self, s: str) -> bytes:
        made = np.array(self.viterbi(s), dtype="<i4").tobytes()
        if len(s) <= 64:
            if len(self.memory) >= self.remembered:
                self.memory.clear()
            self.memory[s] = made
        return made

    def packed(self, text: str) -> bytes:
        """Ids as little-endian 32-bit numbers."""
        if not text:
            return b""
        literal = self._free(text) if SPACE in text else None
        s = SPACE + (text.replace(SPACE, literal) if literal else text).replace(" ", SPACE)
        if not self.apart:
            return np.array(self.viterbi(s, literal), dtype="<i4").tobytes()
        memory = self.memory
        if literal:
            return b"".join([np.array(self.viterbi(x, literal), dtype="<i4").tobytes() if literal in x else memory.get(x) or self._stretch(x) for x in self.cut.findall(s)])
        return b"".join([memory.get(x) or self._stretch(x) for x in self.cut.findall(s)])

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.packed(text), dtype="<i4").tolist()

    def decode(self, ids: Sequence[int]) -> str:
        by = self.bytes_of
        return b"".join([by[i] for i in ids]).decode("utf-8", "replace")[1:]


def _codec(path: str):
    def start() -> Codec:
        cache = process_cache()
        if ("codec", path) not in cache:
            cache["codec", path] = Codec(*load(path))
            gc.freeze()  # hundreds of thousands of dicts that stay
        return cache["codec", path]
    return start


def encode(df: DataFrame, model: str = MODEL, keys: list[str] | None = None) -> DataFrame:
    """The keys and ids, array<int>, of ``text``."""
    small_batches(df.sparkSession)
    keys = keys or ["doc_id"]
    schema = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys) + ", ids array<int>"

    def run(codec: Codec, texts):
        packed = [None if t is None else codec.packed(t) for t in texts]
        ends = np.cumsum([0, *(len(p or b"") // 4 for p in packed)]).astype(np.int32)
        values = pa.array(np.frombuffer(b"".join(p or b"" for p in packed), dtype="<i4"))
        return [pa.ListArray.from_arrays(pa.array(ends), values, mask=pa.array([p is None for p in packed]))]

    return map_texts(df, run, schema, [pa.list_(pa.int32())], keys, start=_codec(model))


def decode(df: DataFrame, model: str = MODEL, keys: list[str] | None = None) -> DataFrame:
    """The keys and text of ``ids``."""
    keys = keys or ["doc_id"]
    schema = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys) + ", text string"
    names = [*keys, "text"]

    def each(batches):
        codec = _codec(model)()
        for b in batches:
            texts = [None if x is None else codec.decode(x) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keys), pa.array(texts, pa.string())], names=names)

    return df.select(*keys, "ids").mapInArrow(each, schema)


def tokens(spark: SparkSession, sf_dir: str, model: str = MODEL) -> DataFrame:
    """Query op10: every document encoded and decoded again.

    (doc_id, n_tokens, ids_sha256 of the little-endian 32-bit ids, lossless:
    whether decoding gives the text back). Null texts have null figures.
    """
    docs = table(spark, sf_dir, "documents").withColumn("doc_id", F.col("doc_id").cast("long"))
    small_batches(spark)

    def run(codec: Codec, texts):
        n, sha, same = [], [], []
        for t in texts:
            packed = None if t is None else codec.packed(t)
            n.append(None if t is None else len(packed) // 4)
            sha.append(None if t is None else hashlib.sha256(packed).hexdigest())
            same.append(None if t is None else codec.decode(np.frombuffer(packed, dtype="<i4").tolist()) == t)
        return [n, sha, same]

    return map_texts(docs, run, "doc_id long, n_tokens long, ids_sha256 string, lossless boolean", [pa.int64(), pa.string(), pa.bool_()], start=_codec(model))
