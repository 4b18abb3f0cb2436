"""Queries of positioned text; positions are made from the numbers of line items and the words of documents."""

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators import layout, ocr, quality
from ._tables import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f
    return add


def _items(spark, sf):
    """One line item for each order, supplier and line number, that of the least part."""
    i = table(spark, sf, "lineitem")
    best = F.row_number().over(W.partitionBy("l_orderkey", "l_suppkey", "l_linenumber").orderBy("l_partkey", "l_quantity", "l_extendedprice"))
    return i.withColumn("k", best).where("k = 1").drop("k")


def _lines(spark, sf):
    return _placed(_items(spark, sf).withColumn("line_no", F.col("l_orderkey")))


def _all_lines(spark, sf):
    """Every line item, numbered within its page by order, then part."""
    nth = F.row_number().over(W.partitionBy("l_suppkey", "l_linenumber").orderBy("l_orderkey", "l_partkey", "l_quantity", "l_extendedprice"))
    return _placed(table(spark, sf, "lineitem").withColumn("line_no", nth))


def _placed(i):
    return i.select(
        F.col("l_suppkey").alias("doc_id"), F.col("l_linenumber").alias("page_no"), F.col("l_orderkey").alias("n"), "line_no", ((F.col("l_partkey") % 4) * 130.0).alias("x"),
        ((F.col("l_partkey") % 4) * 130.0 + 100 + F.col("l_quantity") % 3).alias("right"), (800.0 - (F.col("l_orderkey") % 50) * 14).alias("y"), (10.0 + F.col("l_orderkey") % 2).alias("size"),
        (F.col("l_returnflag") == "R").alias("bold"), F.concat(F.col("l_returnflag"), F.lit(" "), F.col("l_linestatus")).alias("text"),
    )


_ITEMS = "(SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_suppkey, l_linenumber ORDER BY l_partkey, l_quantity, l_extendedprice) = 1)"
_LINES = f"""l AS (SELECT l_suppkey AS doc_id, l_linenumber AS page_no, l_orderkey AS n, l_orderkey AS line_no, (l_partkey % 4) * 130.0::DOUBLE AS x, (l_partkey % 4) * 130.0::DOUBLE + 100 + l_quantity % 3 AS "right",
  800.0::DOUBLE - (l_orderkey % 50) * 14 AS y, 10.0::DOUBLE + l_orderkey % 2 AS size, l_returnflag = 'R' AS bold, l_returnflag || ' ' || l_linestatus AS text FROM {_ITEMS})"""
_ONCE = "(doc_id, page_no, y, x)"
_D = "d AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY doc_id, page_no, y, x ORDER BY n) = 1)"
_SPACING = "sp AS (SELECT doc_id, page_no, min(g) AS g FROM (SELECT doc_id, page_no, round_even(gap * 2, 0) / 2 AS g FROM (SELECT *, lag(y) OVER (PARTITION BY doc_id, page_no ORDER BY y DESC, x) - y AS gap FROM d) WHERE gap > 0 GROUP BY ALL HAVING count(*) > 1) GROUP BY ALL)"


@query(f"WITH {_LINES}, {_D}, {_SPACING} SELECT DISTINCT d.doc_id, d.page_no, coalesce(g, 0)::DOUBLE AS spacing FROM d LEFT JOIN sp USING (doc_id, page_no)")
def line_spacing(spark, sf):
    return layout.line_spacing(_all_lines(spark, sf))


@query(f"""WITH {_LINES}, e AS (SELECT doc_id, page_no, round_even(x, 0) AS x, round_even("right", 0) AS r, count(*) AS n FROM l GROUP BY ALL)
SELECT doc_id, page_no, x, arg_max(r, n * 100000 - r) AS "right" FROM e GROUP BY doc_id, page_no, x HAVING sum(n) >= 3 AND 2 * max(n) >= sum(n) AND arg_max(r, n * 100000 - r) - x >= 100""")
def justified_columns(spark, sf):
    return layout.justified_columns(_lines(spark, sf))


@query(f"""WITH {_LINES} SELECT doc_id, list_sort(list(x))[floor(0.05 * (count(*) - 1))::INT + 1] AS "left", list_sort(list("right"))[floor(0.95 * (count(*) - 1))::INT + 1] AS "right" FROM l GROUP BY 1""")
def page_margins(spark, sf):
    return layout.margins(_lines(spark, sf))


_PARAS = f"""{_LINES}, {_D}, {_SPACING}, b AS (
  SELECT d.*, coalesce(g, 0) AS spacing, lag(x) OVER w AS px, lag("right") OVER w AS pr, lag(y) OVER w AS py, lag(size) OVER w AS ps, lag(bold) OVER w AS pb FROM d LEFT JOIN sp USING (doc_id, page_no) WINDOW w AS (PARTITION BY doc_id, page_no ORDER BY y DESC, x)
), o AS (
  SELECT *, CASE WHEN px IS NULL THEN 1 WHEN py - y > 0 AND py - y <= greatest(1.8 * greatest(size, ps), 1.25 * spacing) AND (abs(x - px) <= 3 OR abs((x + "right") / 2 - (px + pr) / 2) <= 3 OR px - x BETWEEN 0 AND 40) AND abs(size - ps) <= 0.2 * greatest(size, ps) AND bold = pb THEN 0 ELSE 1 END AS opens FROM b
), q AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id, page_no ORDER BY y DESC, x)::BIGINT - 1 AS para_no FROM o)"""


@query(f"WITH {_PARAS} SELECT doc_id, page_no, n, para_no FROM q")
def paragraph_grouping(spark, sf):
    return layout.paragraphs(_all_lines(spark, sf)).select("doc_id", "page_no", "n", "para_no")


@query(f"""WITH {_PARAS}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_no, para_no ORDER BY y DESC, x) AS nth, count(*) OVER (PARTITION BY doc_id, page_no, para_no) AS c FROM q),
s AS (SELECT doc_id, page_no, para_no, size, count(*) AS c, min(nth) AS f FROM r GROUP BY ALL), bs AS (SELECT doc_id, page_no, para_no, arg_max(size, c * 1000000 - f) AS base_size FROM s GROUP BY ALL)
SELECT doc_id, page_no, para_no, max(c) AS n, coalesce(max(c) >= 3 AND max("right") FILTER (nth < c) - min("right") FILTER (nth < c) <= 4, false) AS justified, string_agg(text, ' ' ORDER BY nth) AS text, any_value(base_size) AS base_size FROM r JOIN bs USING (doc_id, page_no, para_no) GROUP BY doc_id, page_no, para_no""")
def paragraph_figures(spark, sf):
    got = layout.paragraph_figures(layout.paragraphs(_all_lines(spark, sf)))
    return got.select("doc_id", "page_no", "para_no", "n", F.coalesce("justified", F.lit(False)).alias("justified"), "text", "base_size")


@query(f"""WITH {_LINES}, a AS (SELECT doc_id, page_no, round_even(x, 0) AS wx, count(*) AS s, min(y) AS bottom, max(y) AS top FROM l GROUP BY ALL HAVING count(*) >= 3),
c AS (SELECT a.doc_id, a.page_no, wx, count(*) AS c FROM a JOIN l ON a.doc_id = l.doc_id AND a.page_no = l.page_no AND l.x < wx - 1 AND l."right" > wx + 1 AND l.y BETWEEN bottom AND top GROUP BY ALL)
SELECT doc_id, page_no, wx AS x, bottom, top FROM a LEFT JOIN c USING (doc_id, page_no, wx) WHERE coalesce(c, 0) < s""")
def column_walls(spark, sf):
    return layout.column_walls(_lines(spark, sf))


def _boxes(spark, sf):
    return _lines(spark, sf).select("doc_id", "page_no", "n", F.col("x").alias("x0"), (F.col("x") + 90 + F.col("n") % 80).alias("x1"), (F.col("y") - F.col("n") % 30).alias("y0"), F.col("y").alias("y1"))


_BOXES = f"{_LINES}, x AS (SELECT doc_id, page_no, n, x AS x0, x + 90 + n % 80 AS x1, y - n % 30 AS y0, y AS y1 FROM l)"


@query(f"""WITH {_BOXES} SELECT a.doc_id, a.page_no, count(*) AS pairs FROM x a JOIN x b ON a.doc_id = b.doc_id AND a.page_no = b.page_no AND a.n < b.n
WHERE least((a.x1 - a.x0) * (a.y1 - a.y0), (b.x1 - b.x0) * (b.y1 - b.y0)) > 0 AND greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) / least((a.x1 - a.x0) * (a.y1 - a.y0), (b.x1 - b.x0) * (b.y1 - b.y0)) >= 0.25 GROUP BY 1, 2""")
def box_overlaps(spark, sf):
    return quality.box_overlaps(_boxes(spark, sf), "doc_id", "page_no")


_POINTS = 'p AS (SELECT doc_id, page_no, n, x + 50 AS x, y - 5 AS y FROM l)'


def _points(spark, sf):
    return _lines(spark, sf).select("doc_id", "page_no", "n", (F.col("x") + 50).alias("x"), (F.col("y") - 5).alias("y"))


@query(f"""WITH {_BOXES}, {_POINTS}, h AS (SELECT p.doc_id, p.page_no, p.n, x0, x1, y0 FROM p JOIN x ON p.doc_id = x.doc_id AND p.page_no = x.page_no AND p.x BETWEEN x0 AND x1 AND p.y BETWEEN y0 AND y1 QUALIFY row_number() OVER (PARTITION BY p.doc_id, p.page_no, p.n ORDER BY x1 - x0, y0, x0, x1) = 1)
SELECT doc_id, page_no, n, x0, x1, y0 FROM p LEFT JOIN h USING (doc_id, page_no, n)""")
def enclosing_boxes(spark, sf):
    return layout.enclosing(_points(spark, sf), _boxes(spark, sf))


@query(f"""WITH {_BOXES}, h AS (SELECT a.doc_id, a.page_no, a.n, max(b.y1) AS floor FROM x a JOIN x b ON a.doc_id = b.doc_id AND a.page_no = b.page_no WHERE a.n <> b.n AND b.x0 < a.x1 AND a.x0 < b.x1 AND b.y1 <= a.y0 GROUP BY 1, 2, 3)
SELECT doc_id, page_no, n, floor FROM x LEFT JOIN h USING (doc_id, page_no, n)""")
def box_floors(spark, sf):
    return layout.floors(_boxes(spark, sf))


@query(f"""WITH {_LINES}, h AS (SELECT a.doc_id, a.page_no, a.line_no, min(b.x) AS x FROM l a JOIN l b ON a.doc_id = b.doc_id AND a.page_no = b.page_no WHERE b.x > a."right" AND abs(b.y - a.y) <= 0.6 * a.size GROUP BY 1, 2, 3)
SELECT doc_id, page_no, line_no, least(coalesce(h.x, 560), 560)::DOUBLE AS "limit" FROM l LEFT JOIN h USING (doc_id, page_no, line_no)""")
def line_limits(spark, sf):
    return layout.right_limits(_lines(spark, sf), 560.0)


@query(f"""WITH {_BOXES}, g AS (SELECT doc_id, page_no, n, "right" AS a, "right" + 20 AS b, y FROM l) SELECT DISTINCT g.doc_id, g.page_no, g.n FROM g JOIN x ON x.doc_id = g.doc_id AND x.page_no = g.page_no WHERE (x0 BETWEEN a AND b OR x1 BETWEEN a AND b) AND y BETWEEN y0 AND y1""")
def shapes_in_gaps(spark, sf):
    gaps = _lines(spark, sf).select("doc_id", "page_no", "n", F.col("right").alias("left"), (F.col("right") + 20).alias("__r"), "y").withColumnRenamed("__r", "right")
    return layout.between(gaps, _boxes(spark, sf)).select("doc_id", "page_no", "n")


@query(f"""WITH {_BOXES}, {_POINTS}, h AS (SELECT p.doc_id, p.page_no, p.n, string_agg(x.n::VARCHAR, ',' ORDER BY x.n) AS held FROM p JOIN x ON p.doc_id = x.doc_id AND p.page_no = x.page_no WHERE p.x BETWEEN x0 AND x1 AND p.y BETWEEN y0 AND y1 AND x.n % 3 = 0 GROUP BY 1, 2, 3)
SELECT doc_id, page_no, n, coalesce(held, '') AS held FROM p LEFT JOIN h USING (doc_id, page_no, n)""")
def point_in_block(spark, sf):
    blocks = _boxes(spark, sf).withColumnRenamed("n", "b")
    return ocr.block_of(_points(spark, sf), blocks).select("doc_id", "page_no", "n", F.array_join(F.transform("held", lambda b: b.cast("string")), ",").alias("held"))


@query(f"""WITH c AS (SELECT l_suppkey AS doc_id, l_linenumber AS page_no, l_orderkey AS n, (5 + l_quantity % 7)::DOUBLE AS target FROM {_ITEMS}),
g AS (SELECT *, sum(CASE WHEN n - p > 32 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page_no ORDER BY n) AS k FROM (SELECT *, lag(n) OVER (PARTITION BY doc_id, page_no ORDER BY n) AS p FROM c))
SELECT doc_id, page_no, n, CASE WHEN count(*) OVER w > 1 THEN greatest(min(target) OVER w, 6) ELSE target END AS size FROM g WINDOW w AS (PARTITION BY doc_id, page_no, k)""")
def table_components(spark, sf):
    i = _items(spark, sf)
    cells = i.select(F.col("l_suppkey").alias("doc_id"), F.col("l_linenumber").alias("page_no"), F.col("l_orderkey").alias("n"), F.lit(10.0).alias("base"), (5 + F.col("l_quantity") % 7).alias("target"))
    a, b = cells.select("doc_id", "page_no", F.col("n").alias("a")), cells.select("doc_id", "page_no", F.col("n").alias("b"))
    edges = a.join(b, ["doc_id", "page_no"]).where((F.col("a") < F.col("b")) & (F.col("b") - F.col("a") <= 32))
    return layout.levelled(cells, edges)


def _words(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", " ")).alias("i", "text"))
    line = (F.col("i") / 8).cast("int")
    return d.select(
        "doc_id", (line / 40).cast("int").alias("page_no"), F.lit(0).alias("block"), F.lit(0).alias("par"), line.alias("line"), (F.col("i") % 8).alias("word"),
        (F.col("i") % 8 * 60 + F.when(F.col("i") % 8 >= 5, F.col("i") % 3 * 40).otherwise(0)).alias("x"), (line % 40 * 20).alias("y"), F.lit(50).alias("w"), F.lit(12).alias("h"), ((F.col("doc_id") * 31 + F.col("i") * 17) % 100).cast("double").alias("conf"), "text",
    )


_WORDS = "w0 AS (SELECT doc_id, unnest(string_split(text, ' ')) AS text, generate_subscripts(string_split(text, ' '), 1) - 1 AS i FROM documents), w AS (SELECT doc_id, i // 320 AS page_no, i // 8 AS line, i % 8 AS word, i % 8 * 60 + CASE WHEN i % 8 >= 5 THEN i % 3 * 40 ELSE 0 END AS x, i // 8 % 40 * 20 AS y, ((doc_id * 31 + i * 17) % 100)::DOUBLE AS conf, text FROM w0)"


@query(f"""WITH {_WORDS}, l AS (SELECT doc_id, page_no, line, md5(string_agg(text, ' ' ORDER BY word)) AS digest, min(x) AS x0, max(x) + 50 AS x1, avg(conf) AS conf, count(*) AS n FROM w WHERE trim(text) <> '' GROUP BY 1, 2, 3)
SELECT doc_id, page_no::INT AS page_no, line::INT AS line, digest, x0::INT AS x0, x1::INT AS x1, round(conf, 6) AS conf, n, count(*) FILTER (conf < 62) OVER p >= 0.4 * count(*) OVER p AS noise FROM l WINDOW p AS (PARTITION BY doc_id, page_no)""")
def ocr_lines(spark, sf):
    got = ocr.lines(_words(spark, sf))
    return got.select("doc_id", "page_no", "line", F.md5("text").alias("digest"), F.col("x0").cast("int").alias("x0"), F.col("x1").cast("int").alias("x1"), F.round("conf", 6).alias("conf"), F.col("n_words").alias("n"), "noise")


@query(f"""WITH {_WORDS}, g AS (SELECT *, sum(CASE WHEN x - px > 24 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, line ORDER BY word) AS span FROM (SELECT *, lag(x + 50) OVER (PARTITION BY doc_id, line ORDER BY word) AS px FROM w))
SELECT doc_id, line::INT AS line, span::BIGINT AS span, md5(string_agg(text, ' ' ORDER BY word)) AS digest, count(*) AS n FROM g GROUP BY 1, 2, 3""")
def column_spans(spark, sf):
    return ocr.split_lines(_words(spark, sf)).select("doc_id", "line", "span", F.md5("text").alias("digest"), F.col("n_words").alias("n"))


@query(f"""WITH l AS (SELECT l_suppkey AS doc_id, l_linenumber AS page_no, l_orderkey AS n, (l_partkey % 4) * 130.0::DOUBLE AS x0, (l_partkey % 4) * 130.0::DOUBLE + 60 AS x1, (l_orderkey % 50) * 14.0::DOUBLE AS y0, (l_orderkey % 50) * 14.0::DOUBLE + 12 AS y1 FROM lineitem)
SELECT DISTINCT a.doc_id, a.page_no, a.n FROM l a JOIN l b ON a.doc_id = b.doc_id AND a.page_no = b.page_no WHERE a.n <> b.n AND b.n % 5 <> 0 AND b.x0 - a.x1 > 24 AND least(a.y1, b.y1) - greatest(a.y0, b.y0) >= 6""")
def cell_rows(spark, sf):
    i = table(spark, sf, "lineitem")
    x, y = (F.col("l_partkey") % 4) * 130.0, (F.col("l_orderkey") % 50) * 14.0
    rows = i.select(F.col("l_suppkey").alias("doc_id"), F.col("l_linenumber").alias("page_no"), F.col("l_orderkey").alias("n"), F.lit("a cell").alias("text"), x.alias("x0"), (x + 60).alias("x1"), y.alias("y0"), (y + 12).alias("y1"), (F.col("l_orderkey") % 5 == 0).alias("noise"))
    return ocr.rows_of_cells(rows)


@query("""WITH r AS (SELECT n_nationkey, y, CASE WHEN y % 60 IN (10, 18, 26, 34, 42) THEN 100 ELSE (y * 7 + n_nationkey) % 5 END AS ink FROM nation, range(300) t(y)),
m AS (SELECT *, ink + coalesce(lag(ink) OVER w, last_value(ink) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) + coalesce(lead(ink) OVER w, first_value(ink) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS m FROM r WINDOW w AS (PARTITION BY n_nationkey ORDER BY y)),
t AS (SELECT n_nationkey, list_sort(list(m))[floor(0.995 * 299)::INT + 1] AS top FROM m GROUP BY 1),
k AS (SELECT *, sum(CASE WHEN y - p > 2 THEN 1 ELSE 0 END) OVER (PARTITION BY n_nationkey ORDER BY y) AS mark FROM (SELECT m.*, lag(y) OVER (PARTITION BY n_nationkey ORDER BY y) AS p FROM m JOIN t USING (n_nationkey) WHERE m.m >= 0.45 * top AND m.m > 0)),
a AS (SELECT n_nationkey, mark, avg(y) AS y FROM k GROUP BY 1, 2), g AS (SELECT *, y - lag(y) OVER (PARTITION BY n_nationkey ORDER BY y) AS gap FROM a),
u AS (SELECT n_nationkey, list_sort(list(gap))[floor(0.25 * (count(*) - 1))::INT + 1] AS usual FROM g WHERE gap IS NOT NULL GROUP BY 1),
s AS (SELECT g.*, sum(CASE WHEN gap > 1.5 * usual THEN 1 ELSE 0 END) OVER (PARTITION BY n_nationkey ORDER BY y) AS staff FROM g LEFT JOIN u USING (n_nationkey))
SELECT n_nationkey, min(y) AS "first", max(y) AS "last", count(*) AS n FROM s GROUP BY n_nationkey, staff HAVING count(*) >= 4""")
def staff_spans(spark, sf):
    rows = table(spark, sf, "nation").select("n_nationkey", F.explode(F.sequence(F.lit(0), F.lit(299))).alias("y"))
    ink = F.when((F.col("y") % 60).isin(10, 18, 26, 34, 42), 100).otherwise((F.col("y") * 7 + F.col("n_nationkey")) % 5)
    return ocr.staffs(rows.withColumn("ink", ink), "n_nationkey")


@query(f"""WITH {_WORDS}, t AS (SELECT *, lower(text) AS lw FROM w) SELECT doc_id, round(avg(conf), 6) AS conf FROM t GROUP BY 1""")
def page_confidence(spark, sf):
    return ocr.mean_confidence(_words(spark, sf), "doc_id").select("doc_id", F.round("conf", 6).alias("conf"))


@query()
def line_grouping(spark, sf):
    i = table(spark, sf, "lineitem")
    runs = i.select(
        F.col("l_suppkey").alias("doc_id"), F.col("l_linenumber").alias("page_no"), F.row_number().over(W.partitionBy("l_suppkey", "l_linenumber").orderBy("l_orderkey")).alias("run_no"), F.col("l_returnflag").alias("text"),
        ((F.col("l_partkey") % 5) * 40.0).alias("x"), (800.0 - (F.col("l_orderkey") % 50) * 14 + (F.col("l_partkey") % 3) * 0.5).alias("y"), F.lit(36.0).alias("width"), F.lit(10.0).alias("size"),
        (F.col("l_returnflag") == "R").alias("bold"), F.lit(False).alias("italic"), F.lit(True).alias("serif"), (F.col("l_orderkey") % 2).cast("int").alias("color"),
    )
    return layout.lines(runs).select("doc_id", "page_no", "line_no", "text", "x", "right", "y", "bold", "color")
