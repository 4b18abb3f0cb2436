"""Lines of text on pages of a document that is written anew."""

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Width, in points, that a line of text beside an image needs.
LEAST_BAND = 80.0


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _page_numbers(heights: pd.Series, room: pd.Series) -> pd.Series:
    def one(line_heights, most: float) -> list[int]:
        page, used, out = 0, 0.0, []
        for k, h in enumerate(line_heights):
            if k and used + h > most:
                page, used = page + 1, 0.0
            used += h
            out.append(page)
        return out

    return pd.Series([one(h, r) for h, r in zip(heights, room, strict=True)])


def paginated(lines: DataFrame, room: float, *keys: str, order: str = "n", height: str = "height") -> DataFrame:
    """``lines`` with page, from 0: each page takes lines in order while they fit in ``room``, one at least.

    A page begins where the last one ended, so its sums start anew: a walk
    over the heights of one document, of which only numbers are gathered.
    """
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order).alias("n"), F.col(height).cast("double").alias("h"))))
    numbers = lines.groupBy(*keys).agg(ordered.alias("__lines"))
    placed = numbers.withColumn("__pages", _page_numbers(F.transform("__lines", lambda x: x["h"]), F.lit(float(room))))
    each = placed.select(*keys, F.explode(F.arrays_zip("__lines", "__pages")).alias("__x")).select(*keys, F.col("__x.__lines.n").alias(order), F.col("__x.__pages").alias("page"))
    return lines.join(each, [*keys, order])


def image_fills(x: Column, right: Column, width: Column, margin: Column) -> Column:
    """Whether an image leaves no band beside it that is wide enough for text."""
    held = F.least(right, margin + width) - F.greatest(x, margin)
    return width - held < LEAST_BAND


def width_limits(limits: DataFrame, *keys: str, limit: str = "limit") -> DataFrame:
    """(keys, width): the widest limit of a paragraph's lines."""
    return limits.groupBy(*keys).agg(F.max(limit).alias("width"))
