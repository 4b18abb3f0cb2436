"""Words that a reader found on a page image, as lines and pieces of lines."""

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import direction, dot_leader, score_junk

LINE = ("doc_id", "page_no", "block", "par", "line")
#: Mean confidence below which a line is notation, and the share of such lines that makes a page of it.
LEAST_CONFIDENCE, NOISE_SHARE = 62, 0.4
COLUMN_GAP = 2.0


def lines(words: DataFrame) -> DataFrame:
    """(…, text, x0, y0, x1, y1, conf, n_words, noise) of words (…, word, x, y, w, h, conf, text).

    noise: the page has 0.4 of its lines under the least confidence.
    """
    ordered = F.array_sort(F.collect_list(F.struct("word", "text")))  # the words of one line
    made = words.where(F.trim("text") != "").groupBy(*LINE).agg(
        F.array_join(F.transform(ordered, lambda w: w["text"]), " ").alias("text"), F.min("x").alias("x0"), F.min("y").alias("y0"), F.max(F.col("x") + F.col("w")).alias("x1"), F.max(F.col("y") + F.col("h")).alias("y1"),
        F.avg("conf").alias("conf"), F.count("*").alias("n_words"),
    )
    page = W.partitionBy("doc_id", "page_no")
    low = F.count_if(F.col("conf") < LEAST_CONFIDENCE).over(page)
    return made.withColumn("noise", low >= NOISE_SHARE * F.count("*").over(page))


def spans(words: DataFrame, leaders: bool = False) -> DataFrame:
    """Words with span, the piece of their line, cut at gaps over two median word heights, and at dotted leaders if asked."""
    along = W.partitionBy(*LINE).orderBy("word")
    heights = F.array_sort(F.collect_list("h").over(W.partitionBy(*LINE)))
    middle = F.get(heights, (F.size(heights) / 2).cast("int"))
    gap = F.col("x") - F.lag(F.col("x") + F.col("w")).over(along)
    wide = F.coalesce(gap > COLUMN_GAP * middle, F.lit(False))
    if leaders:
        lead = dot_leader("text")
        wide = wide | (lead & (F.row_number().over(along) > 1)) | F.coalesce(F.lag(lead).over(along), F.lit(False))
    return words.withColumn("__cut", wide.cast("int")).withColumn("span", F.sum("__cut").over(along)).drop("__cut")


def split_lines(words: DataFrame, leaders: bool = False) -> DataFrame:
    """The pieces of lines, each a line of its own with its span."""
    cut = spans(words, leaders)
    ordered = F.array_sort(F.collect_list(F.struct("word", "text")))
    return cut.groupBy(*LINE, "span").agg(
        F.array_join(F.transform(ordered, lambda w: w["text"]), " ").alias("text"), F.min("x").alias("x0"), F.max(F.col("x") + F.col("w")).alias("x1"), F.avg("conf").alias("conf"), F.count("*").alias("n_words"),
    )


def rows_of_cells(lines_: DataFrame) -> DataFrame:
    """Lines (page, n, text, x0, y0, x1, y1, noise) with a cell beside them: three words at most, beyond a column gap, half as high."""
    other = lines_.where("not noise").select("doc_id", "page_no", F.col("n").alias("m"), F.size(F.split(F.trim("text"), r"\s+")).alias("words"), F.col("x0").alias("ox"), F.col("y0").alias("oy0"), F.col("y1").alias("oy1"))
    height = F.col("y1") - F.col("y0")
    on = (F.col("n") != F.col("m")) & (F.col("ox") - F.col("x1") > COLUMN_GAP * height) & (F.col("words") <= 3) & (F.least("y1", "oy1") - F.greatest("y0", "oy0") >= height / 2)
    hit = lines_.join(other, ["doc_id", "page_no"]).where(on).select("doc_id", "page_no", "n").distinct()
    return hit


def block_of(points: DataFrame, blocks: DataFrame) -> DataFrame:
    """(page, n, held): the sorted numbers of the blocks (page, b, x0, y0, x1, y1) that hold each point (page, n, x, y)."""
    on = F.col("x").between(F.col("x0"), F.col("x1")) & F.col("y").between(F.col("y0"), F.col("y1"))
    hit = points.join(blocks, ["doc_id", "page_no"]).where(on).groupBy("doc_id", "page_no", "n").agg(F.array_sort(F.collect_set("b")).alias("held"))
    return points.select("doc_id", "page_no", "n").join(hit, ["doc_id", "page_no", "n"], "left").withColumn("held", F.coalesce("held", F.array().cast("array<long>")))


def mean_confidence(words: DataFrame, *keys: str) -> DataFrame:
    """(keys, conf): mean of words that are no leaders, 0 without any."""
    return words.groupBy(*keys).agg(F.coalesce(F.avg(F.when(~dot_leader("text"), F.col("conf"))), F.lit(0.0)).alias("conf"))


def line_votes(lines_: DataFrame, key: str, source: str, share: float = 0.2) -> DataFrame:
    """(key, lang): languages that a fifth of a page's lines, two at least, name; the source always."""
    n = lines_.groupBy(key).agg(F.count("*").alias("all"))
    votes = lines_.where("lang is not null").groupBy(key, "lang").agg(F.count("*").alias("n")).join(n, key).where(F.col("n") >= F.greatest(F.lit(2.0), share * F.col("all")))
    return votes.select(key, "lang").union(n.select(key, F.lit(source))).distinct()


def staffs(rows: DataFrame, key: str) -> DataFrame:
    """(key, first, last, n): staffs in a page's ink by row (key, y, ink).

    The ink of three rows around each, the page's edges joined, is compared
    with 0.45 of its 99.5th percentile; rows over it that are at most two
    apart are one line, lines within one and a half times the lower quartile
    of their distances one staff, and four lines make one.
    """
    by = W.partitionBy(key).orderBy("y")
    whole = W.partitionBy(key)
    before = F.coalesce(F.lag("ink").over(by), F.last("ink").over(by.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    after = F.coalesce(F.lead("ink").over(by), F.first("ink").over(by.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    moving = rows.withColumn("m", F.col("ink") + before + after)
    at = moving.withColumn("r", F.row_number().over(W.partitionBy(key).orderBy("m"))).withColumn("c", F.count("*").over(whole))
    level = at.groupBy(key).agg(F.max(F.when(F.col("r") == F.floor(0.995 * (F.col("c") - 1)) + 1, F.col("m"))).alias("top"))
    dark = moving.join(level, key).where("m >= 0.45 * top and m > 0")
    jump = F.coalesce((F.col("y") - F.lag("y").over(by) > 2).cast("int"), F.lit(0))
    marks = dark.withColumn("j", jump).withColumn("mark", F.sum("j").over(by)).groupBy(key, "mark").agg(F.avg("y").alias("y"))
    gaps = marks.withColumn("gap", F.col("y") - F.lag("y").over(by))
    near = gaps.where("gap is not null").withColumn("r", F.row_number().over(W.partitionBy(key).orderBy("gap"))).withColumn("c", F.count("*").over(whole))
    usual = near.groupBy(key).agg(F.max(F.when(F.col("r") == F.floor(0.25 * (F.col("c") - 1)) + 1, F.col("gap"))).alias("usual"))
    cut = F.coalesce((F.col("gap") > 1.5 * F.col("usual")).cast("int"), F.lit(0))
    staff = gaps.join(usual, key, "left").withColumn("k", cut).withColumn("staff", F.sum("k").over(by))
    return staff.groupBy(key, "staff").agg(F.min("y").alias("first"), F.max("y").alias("last"), F.count("*").alias("n")).where("n >= 4").select(key, "first", "last", "n")


def trimmed(words: DataFrame) -> DataFrame:
    """Words of score lines without the notation read at either end; lines of nothing else go."""
    line = W.partitionBy(*LINE)
    sung = F.when(~score_junk("text", "conf"), F.col("word"))
    return words.withColumns({"__a": F.min(sung).over(line), "__z": F.max(sung).over(line)}).where("word between __a and __z").drop("__a", "__z")


def directions(words: DataFrame) -> DataFrame:
    """Words of score lines with piece: "sung", "number" or "direction"; and span.

    From the first span that reads as a direction on all spans are; bar
    numbers that lead the first one are a piece of their own, and notation
    read into the end of a span goes.
    """
    cut = spans(words)
    ordered = F.array_sort(F.collect_list(F.struct("word", "text")))
    said = cut.groupBy(*LINE, "span").agg(F.array_join(F.transform(ordered, lambda w: w["text"]), " ").alias("__said")).where(direction("__said"))
    rows = cut.join(said.groupBy(*LINE).agg(F.min("span").alias("__first")), list(LINE), "left")
    span = W.partitionBy(*LINE, "span")
    on, back = span.orderBy("word").rowsBetween(W.unboundedPreceding, 0), span.orderBy(F.desc("word")).rowsBetween(W.unboundedPreceding, 0)
    digits, mark = F.col("text").rlike(r"^\p{Nd}+$").cast("int"), (score_junk("text", "conf") & F.col("text").rlike(r"\p{L}")).cast("int")
    leads = (F.col("span") == F.col("__first")) & (F.min(digits).over(on) == 1) & (F.col("word") < F.max("word").over(span))
    rows = rows.withColumns({"__lead": F.coalesce(leads, F.lit(False)), "__mark": F.min(mark).over(back) == 1})
    start = F.min(F.when(~F.col("__lead"), F.col("word"))).over(span)
    sung = F.col("__first").isNull() | (F.col("span") < F.col("__first"))
    piece = F.when(sung, "sung").when(F.col("__lead"), "number").when(F.col("__mark") & (F.col("word") > start), None).otherwise("direction")
    return rows.withColumn("piece", piece).where("piece is not null").drop("__first", "__lead", "__mark")


def direction_groups(lines_: DataFrame) -> DataFrame:
    """(page, n, first): direction lines (page, n, block, par, x0, y0, x1, y1) with the first line of the direction that they carry on.

    A line carries on the oldest open direction of its band whose last line
    is just above and overlaps it side to side; the lines of a page are
    walked in order.
    """
    kinds = {f.name: f.dataType.simpleString() for f in lines_.schema.fields}

    def walk(page: pd.DataFrame) -> pd.DataFrame:
        open_, firsts = {}, []
        for r in page.sort_values("n").itertuples():
            height = r.y1 - r.y0
            on = (k for k, last in open_.items() if (last.block, last.par) == (r.block, r.par) and last.x0 < r.x1 and r.x0 < last.x1 and -0.5 * height <= r.y0 - last.y1 <= 1.5 * height)
            first = next(on, r.n)
            open_[first] = r
            firsts.append((r.doc_id, r.page_no, r.n, first))
        return pd.DataFrame(firsts, columns=["doc_id", "page_no", "n", "first"])

    return lines_.groupBy("doc_id", "page_no").applyInPandas(walk, f"doc_id {kinds['doc_id']}, page_no {kinds['page_no']}, n {kinds['n']}, first {kinds['n']}")
