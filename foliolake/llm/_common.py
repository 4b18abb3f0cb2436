"""What the operators of this subpackage share."""

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import remove, shared_dir, stored  # noqa: F401  for the operators

#: Words of the contracts: runs of anything but ASCII white space.
WORD = "[^\\x20\\x09-\\x0D]+"
#: Rows of one Arrow batch; long texts make batches of many rows heavy.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


class Scratch:
    """Tables written on the way to a result, which go when nothing reads them any more.

    Tables that the result itself reads are made with ``stored`` and stay as
    long as the application's folder does.
    """

    def __init__(self):
        self.paths: list[tuple[SparkSession, str]] = []

    def __call__(self, df: DataFrame, tag: str) -> DataFrame:
        out, path = stored(df, tag)
        self.paths.append((df.sparkSession, path))
        return out

    def __enter__(self) -> "Scratch":
        return self

    def __exit__(self, *_) -> None:
        for spark, path in self.paths:
            remove(spark, path)


def id_text(col: str | Column = "doc_id") -> Column:
    """doc_id as text; null as the empty text."""
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(c.cast("string"), F.lit(""))


def fold(n: int, col: str = "doc_id") -> Column:
    return F.pmod(F.crc32(id_text(col).cast("binary")), F.lit(n))


def process_cache() -> dict:
    """A dict that lives as long as this Python worker, for what is dear to build."""
    import sys
    import types

    return sys.modules.setdefault("_foliolake_cache", types.ModuleType("_foliolake_cache")).__dict__


def map_texts(
    df: DataFrame, run: Callable[[list, list], list], schema: str, kinds: list[pa.DataType], keys: list[str] | None = None,
    start: Callable[[], object] | None = None,
) -> DataFrame:
    """``run(state, texts, keys)`` for each Arrow batch of ``text``.

    Returns the key columns followed by the columns that ``run`` makes, in
    the order of ``schema``. ``start`` makes the state of one task.
    """
    keys = keys or ["doc_id"]
    names = [x.split()[0] for x in schema.split(",")]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = start() if start else None
        for b in batches:
            if not b.num_rows:
                continue
            made = run(state, b.column("text").to_pylist())
            cols = [b.column(k) for k in keys] + [x if isinstance(x, pa.Array) else pa.array(x, kind) for x, kind in zip(made, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return df.select(*keys, "text").mapInArrow(each, schema)
