"""Measures of what came back, and reports against a baseline."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def measures(chunks: DataFrame, *keys: str) -> DataFrame:
    """(keys, chunks, untranslated, lost, guard_hits) of chunks (keys, source, out, raw).

    raw is what the model gave before the guard. Only chunks with words count.
    """
    words = F.size(F.filter(F.split(T.strip("source"), T.WS + "+"), lambda w: w != ""))
    same = T.strip("source") == T.strip("out")
    lost = ~same & (F.length("source") >= 30) & (F.length("out") < 0.55 * F.length("source"))
    return chunks.where(T.translatable("source")).groupBy(*keys).agg(
        F.count("*").alias("chunks"), F.count_if(same & (words >= 4)).alias("untranslated"), F.count_if(lost).alias("lost"), F.count_if(F.col("raw") != F.col("out")).alias("guard_hits"),
    )


def result_hash(text):
    return F.substring(F.sha2(text, 256), 1, 16)


def compared(now: DataFrame, baseline: DataFrame, key: str, metrics: list[str]) -> DataFrame:
    """A row for each key and one, with a null key, of all: metrics and their change since the baseline."""
    old = baseline.select(F.col(key), *(F.col(m).alias(f"old_{m}") for m in metrics))
    both = now.select(key, *metrics).join(old, key, "left")
    sums = [F.sum(m).alias(m) for m in metrics] + [(F.sum(m) - F.sum(F.coalesce(f"old_{m}", m))).alias(f"{m}_delta") for m in metrics]
    return both.rollup(key).agg(*sums)


def box_overlaps(boxes: DataFrame, *page: str, share: float = 0.25) -> DataFrame:
    """(page, pairs): pairs of boxes (page, n, x0, y0, x1, y1) that share so much of the smaller one."""
    from ..functions.lists import overlap_share

    box = F.struct("x0", "y0", "x1", "y1")
    a, b = boxes.select(*page, F.col("n").alias("i"), box.alias("a")), boxes.select(*page, F.col("n").alias("j"), box.alias("b"))
    pairs = a.join(b, list(page)).where((F.col("i") < F.col("j")) & (overlap_share(F.col("a"), F.col("b")) >= share))
    return pairs.groupBy(*page).agg(F.count("*").alias("pairs"))
