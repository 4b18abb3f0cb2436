"""Language identification by compression.

Each language has a raw-content zstandard dictionary of its own labelled
text: of each sampled document its whole text, or words from blocks all over
it up to a share of the dictionary. A text is encoded with every dictionary,
and the language whose code is smallest is chosen. ``accepted`` is false where the runner-up is almost as
small.

Inputs: a null text, or one without any letter, is ``und`` with score 0; ties
go to the language that sorts first; without labelled rows every text is
``und``. Texts are encoded whole, in blocks, so that long texts lean on the
dictionary as short ones do; repeated rows each have a result; an empty table
gives an empty one. Further columns, whatever their names, are not read.
"""

import re
from collections.abc import Iterable

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ._common import fold, id_text, map_texts, small_batches, table

#: Bounds of what is learnt: documents of each language (those of least hash), and bytes of its dictionary.
SAMPLE_DOCS, DICT_BYTES = 96, 256 * 1024
#: Blocks, spread over a sampled document, that its share is made of.
SPREAD = 16
#: Bytes of a block, and level of compression.
BLOCK, LEVEL = 4096, 3
#: Margins, as shares of the runner-up's size: accepted from here on, and certain.
ACCEPT, CERTAIN = 0.02, 0.25

LETTER = re.compile(r"[^\W\d_]")

_SCHEMA = "doc_id long, lang_pred string, score double, accepted boolean"


def spread(text: str, share: int, seed: Column) -> Column:
    """Texts of up to ``share`` characters whole; of longer ones the words of a block from each SPREAD-th, placed by ``seed``."""
    n, blocks = F.length(text), min(SPREAD, share)
    width, out = share // blocks, []
    for j in range(blocks):
        start = F.floor(n * j / blocks)
        room = F.greatest(F.floor(n * (j + 1) / blocks) - start - width, F.lit(0))
        at = start + F.pmod(F.xxhash64(seed, F.lit(j)), room + 1) + 1
        out.append(F.regexp_replace(F.substring(text, at.cast("int"), F.lit(width)), r"^\S*\s|\s\S*$", ""))
    return F.when(n <= share, F.col(text)).otherwise(F.concat_ws(" ", *out))


def dictionaries(docs: DataFrame, per_lang: int = SAMPLE_DOCS, size: int = DICT_BYTES) -> dict[str, bytes]:
    """Text by language, from the ``per_lang`` documents of least hash of each."""
    h = F.xxhash64(id_text(), F.length("text"))
    keyed = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "doc_id", h.alias("h"))
    nth = F.row_number().over(W.partitionBy("lang").orderBy("h", "doc_id"))
    chosen = keyed.withColumn("nth", nth).where(F.col("nth") <= per_lang).select("lang", "h").collect()
    if not chosen:
        return {}
    hashes = sorted({r["h"] for r in chosen})
    share = max(1, size // max(1, min(per_lang, 64)))
    part = spread("text", share, h)
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", h.alias("h"), part.alias("text"))
    # a row for each chosen hash of a language, so per_lang of a language at most, each cut to its share of the dictionary
    got = known.where(F.col("h").isin(hashes)).groupBy("lang", "h").agg(F.min("text").alias("text")).collect()
    out: dict[str, bytes] = {}
    for r in sorted(got, key=lambda r: (r["lang"], r["h"], r["text"])):
        have = out.get(r["lang"], b"")
        if len(have) < size:
            out[r["lang"]] = have + b" " + plain(r["text"])
    # the encoder reaches the end of a dictionary most cheaply, so what is kept is the end
    return {k: v[-size:] for k, v in out.items()}


#: Bytes beyond ASCII belong to letters; all other non-letters are spaces.
_LETTERS = bytes(c if 65 <= c <= 90 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def plain(text: str) -> bytes:
    """Lower-case words, without what says nothing about a language."""
    return b" ".join(text.lower().encode("utf-8", "replace").translate(_LETTERS).split())


class Encoder:
    def __init__(self, dicts: dict[str, bytes], level: int = LEVEL):
        self.langs = sorted(dicts)
        self.by = []
        for lang in self.langs:
            d = zstandard.ZstdCompressionDict(dicts[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            self.by.append(zstandard.ZstdCompressor(level=level, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False))

    def sizes(self, text: str, block: int = BLOCK) -> list[int]:
        data = plain(text)
        parts = [data[i : i + block] for i in range(0, len(data), block)]
        return [sum(len(c.compress(p)) for p in parts) for c in self.by]

    def classify(self, text: str | None) -> tuple[str, float, bool]:
        if not self.langs or text is None or not LETTER.search(text):
            return "und", 0.0, False
        by = sorted(zip(self.sizes(text), self.langs, strict=True))
        if len(by) == 1:
            return by[0][1], 1.0, True
        margin = (by[1][0] - by[0][0]) / by[1][0]
        return by[0][1], min(1.0, margin / CERTAIN), margin >= ACCEPT


def identify(df: DataFrame, dicts: dict[str, bytes]) -> DataFrame:
    """(doc_id, lang_pred, score, accepted) of each row of (doc_id, text)."""
    small_batches(df.sparkSession)

    def run(enc: Encoder, texts: Iterable[str | None]) -> list[list]:
        return [list(x) for x in zip(*map(enc.classify, texts), strict=True)]

    return map_texts(df, run, _SCHEMA, [pa.string(), pa.float64(), pa.bool_()], start=lambda: Encoder(dicts))


def languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query op2: the language of every document, learnt from three folds of four."""
    docs = table(spark, sf_dir, "documents").withColumn("doc_id", F.col("doc_id").cast("long"))
    found = identify(docs.select("doc_id", "text"), dictionaries(docs.where(fold(4) != 2).select("doc_id", "text", "lang")))
    return found.select("doc_id", (fold(4) == 2).alias("held_out"), "lang_pred", "score", "accepted")
