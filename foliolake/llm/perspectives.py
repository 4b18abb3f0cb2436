"""Perspective rotation: each dialogue as every participant would have led it.

For each participant the dialogue is rendered with that speaker as
``assistant`` and all others as named users; instructions stay with
``system``, who is no participant. The mask holds what the assistant says,
with its end mark, which is what a model would be trained on.

A rendering comes in parts of PART messages, so that no row or group grows
with a dialogue; parts in order make up the whole. Messages are numbered
through a range-partitioned table: numbers within its pieces plus the pieces
before, so that one endless dialogue is spread over many tasks.

Inputs: a null or blank role is the speaker ``unknown``; a null text is
empty; null turns come last; equal turns are ordered by role, then text;
repeated rows count each; a null conv_id is a dialogue of its own; dialogues
without participants have no rows, nor has an empty table; very long texts
are rendered whole. Control marks within a text or a speaker's name are broken
up, and line feeds in a name become spaces, so neither can begin a turn.
Further columns, whatever their names, are not read.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ._common import stored, table

PART = 256
OPEN, CLOSE, SYSTEM = "<|im_start|>", "<|im_end|>", "system"


def _harmless(x: Column) -> Column:
    return F.replace(x, F.lit("<|im_"), F.lit("<| im_"))


def _speaker() -> Column:
    name = F.trim(F.replace("role", F.lit("\n"), F.lit(" ")))
    return F.coalesce(F.when(name != "", _harmless(name)), F.lit("unknown"))


def numbered(df: DataFrame) -> DataFrame:
    """(conv_id, nth, speaker, text): messages numbered from 1 in each dialogue."""
    text = _harmless(F.coalesce("text", F.lit("")))
    rows = df.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), _speaker().alias("speaker"), text.alias("text"))
    order = [F.col("conv_id").asc(), F.col("turn").asc_nulls_last(), F.col("speaker"), F.col("text")]
    # a random last key parts even rows that are alike; the table is written, so a task that runs again changes nothing
    spread, _ = stored(rows.withColumn("salt", F.rand(5)).repartitionByRange(*order[:3], F.col("salt")).withColumn("piece", F.spark_partition_id()).drop("salt"), "messages")
    inner = spread.withColumn("at", F.row_number().over(W.partitionBy("conv_id", "piece").orderBy(*order[1:])))
    sizes = spread.groupBy("conv_id", "piece").count()
    before = F.sum("count").over(W.partitionBy("conv_id").orderBy("piece").rowsBetween(W.unboundedPreceding, -1))
    offsets = sizes.select(F.col("conv_id").alias("c"), F.col("piece").alias("p"), F.coalesce(before, F.lit(0)).alias("before"))
    return inner.join(offsets, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("piece") == F.col("p"))).select("conv_id", (F.col("at") + F.col("before")).alias("nth"), "speaker", "text")


def rotations(df: DataFrame, part: int = PART) -> DataFrame:
    """(conv_id, perspective, part, n_messages, text, mask) of (conv_id, turn, role, text).

    mask is an array of (start, end) in characters of ``text``, end exclusive.
    """
    messages = numbered(df)
    who = df.select(F.col("conv_id").cast("long").alias("c"), _speaker().alias("perspective"))
    who = who.where(F.col("perspective") != SYSTEM).distinct()
    seen = messages.join(who, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")
    own = F.col("speaker") == F.col("perspective")
    head = F.when(F.col("speaker") == SYSTEM, F.lit(SYSTEM)).when(own, F.lit("assistant")).otherwise(F.concat(F.lit("user name="), "speaker"))
    piece = F.concat(F.lit(OPEN), head, F.lit("\n"), "text", F.lit(CLOSE + "\n"))
    keyed = seen.select("conv_id", "perspective", ((F.col("nth") - 1) / part).cast("long").alias("part"), "nth", own.alias("own"), piece.alias("piece"))
    end = F.sum(F.length("piece")).over(W.partitionBy("conv_id", "perspective", "part").orderBy("nth"))
    placed = keyed.withColumn("end", end)
    start = F.col("end") - F.length("piece") + len(OPEN + "assistant\n")
    message = F.struct("nth", "piece", F.when(F.col("own"), F.struct(start.alias("start"), (F.col("end") - 1).alias("end"))).alias("span"))
    parts = placed.groupBy("conv_id", "perspective", "part").agg(F.count("*").alias("n_messages"), F.array_sort(F.collect_list(message)).alias("m"))  # PART messages at most
    return parts.select(
        "conv_id", "perspective", "part", "n_messages", F.array_join(F.transform("m", lambda x: x["piece"]), "").alias("text"),
        F.filter(F.transform("m", lambda x: x["span"]), lambda x: x.isNotNull()).alias("mask"),
    )


def spans(mask: Column) -> Column:
    """A mask as text, start-end joined by commas."""
    return F.array_join(F.transform(mask, lambda x: F.concat_ws("-", x["start"].cast("string"), x["end"].cast("string"))), ",")


def rotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query op4: every dialogue of ``conversations`` from each side."""
    made = rotations(table(spark, sf_dir, "conversations"))
    return made.select("conv_id", "perspective", "part", "n_messages", "text", spans(F.col("mask")).alias("mask"))


SQL = """
WITH m AS (
  SELECT conv_id, coalesce(replace(nullif(trim(replace(role, chr(10), ' ')), ''), '<|im_', '<| im_'), 'unknown') AS speaker, replace(coalesce(text, ''), '<|im_', '<| im_') AS text, turn FROM conversations
), n AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, speaker, text) AS nth FROM m
), w AS (SELECT DISTINCT conv_id, speaker AS perspective FROM m WHERE speaker <> 'system'),
p AS (
  SELECT n.conv_id, perspective, (nth - 1) // 256 AS part, nth, speaker = perspective AS own,
    '<|im_start|>' || CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = perspective THEN 'assistant' ELSE 'user name=' || speaker END || chr(10) || text || '<|im_end|>' || chr(10) AS piece
  FROM n JOIN w ON n.conv_id IS NOT DISTINCT FROM w.conv_id
), e AS (
  SELECT *, sum(length(piece)) OVER (PARTITION BY conv_id, perspective, part ORDER BY nth) AS stop FROM p
)
SELECT conv_id, perspective, part, count(*) AS n_messages, string_agg(piece, '' ORDER BY nth) AS text,
  coalesce(string_agg((stop - length(piece) + 22)::BIGINT || '-' || (stop - 1)::BIGINT, ',' ORDER BY nth) FILTER (WHERE own), '') AS mask
FROM e GROUP BY conv_id, perspective, part
"""
