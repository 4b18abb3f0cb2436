"""Blocks of text formats as column expressions: nothing leaves the JVM."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import WS, col, strip

YAML = rf"^({WS}*[-\p{{L}}\p{{N}}_\"'][^\n]*?:{WS}*)(['\"]?)([^#\n]*?[^\s])(['\"]?)({WS}*(?:#.*)?)$"


def html_nodes(df: DataFrame, key: str, html: str = "html") -> DataFrame:
    """(key, n, text): stripped text nodes outside script and style, in order; entities part nodes."""
    bare = F.regexp_replace(col(html), r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>", "<>")
    bare = F.regexp_replace(F.regexp_replace(bare, r"(?s)<!--.*?-->", "<>"), r"(?s)<[^>]*>", "\u0001")
    bare = F.regexp_replace(bare, r"&(?:[A-Za-z][A-Za-z0-9]*|#[0-9]+|#[xX][0-9A-Fa-f]+);?", "\u0001")
    nodes = F.filter(F.transform(F.split(bare, "\u0001"), strip), lambda t: t != "")
    return df.select(key, F.posexplode(nodes).alias("n", "text"))


def yaml_scalars(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, line_no, text) of "key: value" lines whose value is no number, boolean or null."""
    rows = df.select(key, F.posexplode(F.split(col(text), "\n")).alias("line_no", "line"))
    value = strip(F.regexp_extract("line", YAML, 3))
    even = F.regexp_extract("line", YAML, 2) == F.regexp_extract("line", YAML, 4)
    return rows.where(F.col("line").rlike(YAML) & even).select(key, "line_no", value.alias("text")).where(~F.col("text").rlike(r"^(true|false|null|~|[-+]?[0-9]+(\.[0-9]+)?)$"))


def gettext_entries(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, n, msgid, msgstr): each msgstr line with the msgid line before it; the header, of empty id, is left out."""
    lines = F.filter(F.split(col(text), "\n"), lambda x: x.startswith("msgid ") | x.startswith("msgstr "))
    rows = df.select(key, F.posexplode(F.arrays_zip(lines.alias("line"), F.concat(F.array(F.lit("")), lines).alias("prev"))).alias("at", "z")).select(key, "at", "z.line", "z.prev")
    pairs = rows.where(F.col("line").startswith("msgstr ") & F.col("prev").startswith("msgid "))

    def value(line: str, skip: int) -> Column:
        return F.regexp_replace(F.regexp_replace(strip(F.substring(F.col(line), skip, 1_000_000)), '^"|"$', ""), r'\\(["\\])', "$1")

    made = pairs.select(key, "at", value("prev", 7).alias("msgid"), value("line", 8).alias("msgstr")).where("msgid != ''")
    return made.select(key, F.col("at").alias("n"), "msgid", F.when(F.col("msgstr") == "", F.col("msgid")).otherwise(F.col("msgstr")).alias("text"))


def subtitle_cues(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, n, start, end, text): cues in order with their times; note, style and region lines and empty cues are left out."""
    parts = F.filter(F.split(F.regexp_replace(col(text), "\r\n", "\n"), r"\n[ \t]*\n"), lambda p: p.rlike("-->[^\n]+"))
    rows = df.select(key, F.posexplode(parts).alias("n", "part"))
    body = F.split(F.regexp_extract("part", r"(?s)-->[^\n]*\n(.*)$", 1), "\n")
    kept = F.filter(body, lambda x: (strip(x) != "") & ~F.ltrim(x).rlike("^(NOTE|STYLE|REGION)"))
    time = r"([0-9:.,]+)"
    return rows.select(
        key, "n", F.regexp_extract("part", rf"{time}\s*-->", 1).alias("start"), F.regexp_extract("part", rf"-->\s*{time}", 1).alias("end"), strip(F.array_join(kept, "\n")).alias("text"),
    ).where("text != ''")


def xliff_units(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, n, text): the target of each unit, else its source; units without text are left out."""
    units = F.regexp_extract_all(col(text), F.lit(r"(?s)(<(?:\w+:)?trans-unit\b.*?</(?:\w+:)?trans-unit\s*>)"), F.lit(1))
    rows = df.select(key, F.posexplode(units).alias("n", "unit"))

    def inner(tag: str) -> Column:
        got = F.regexp_replace(F.regexp_extract("unit", rf"(?s)<(?:\w+:)?{tag}\b[^>]*?>(.*?)</(?:\w+:)?{tag}\s*>", 1), r"(?s)<[^>]*>", "")
        for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
            got = F.replace(got, F.lit(entity), F.lit(sign))
        return strip(got)

    target = inner("target")
    return rows.select(key, "n", F.when(target == "", inner("source")).otherwise(target).alias("text")).where("text != ''")


def cells(df: DataFrame, row: str, columns: list[str]) -> DataFrame:
    """(row, c, column, text): cells that aren't empty, in the order of ``columns``; a missing column is an error."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"400: no such column: {', '.join(missing)}")
    each = F.array(*(F.struct(F.lit(c).alias("column"), col(c).cast("string").alias("text")) for c in columns))
    return df.select(row, F.posexplode(each).alias("c", "x")).select(row, "c", "x.column", strip("x.text").alias("text")).where("text != ''")
