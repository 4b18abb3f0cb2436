"""Queries of settings, model files, exports, history, scripts and pages."""

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import ocr, pages, scripts, upkeep
from ._tables import table
from .layout_queries import _WORDS, _words

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f
    return add


_NAMES = ["Latin", "Cyrillic", "Arabic", "Greek", "Hebrew", "Devanagari", "Han", "HanS", "HanT", "Japanese", "Katakana", "Runic", ""]
_CODES = ["eng_Latn", "deu_Latn", "zho_Hans", "jpn_Jpan", "rus_Cyrl", "xxx_Latn", "auto"]
_INSTALLED = [[], ["eng", "deu", "fra", "ita", "nld"], ["eng", "rus", "jpn", "chi_tra", "ell"], ["chi_sim", "bul", "lat"]]


def _strings(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _at(values, index):
    return F.get(F.array(*(F.lit(v) for v in values)), index.cast("int"))


def _readers(spark, sf):
    lists = F.array(*(F.array(*map(F.lit, v)).cast("array<string>") for v in _INSTALLED))
    return table(spark, sf, "customer").select("c_custkey", _at(_NAMES, F.col("c_custkey") % 13).alias("script"), _at(_CODES, F.col("c_custkey") % 7).alias("code"), F.get(lists, (F.col("c_custkey") % 4).cast("int")).alias("installed"))


_READERS = f"""r AS (SELECT c_custkey, {_strings(_NAMES)}[c_custkey % 13 + 1] AS script, {_strings(_CODES)}[c_custkey % 7 + 1] AS code,
  [{", ".join(f"{_strings(v)}::VARCHAR[]" for v in _INSTALLED)}][c_custkey % 4 + 1] AS installed FROM customer)"""


@query(f"""WITH {_READERS}, k AS (SELECT *, CASE
  WHEN script = 'Latin' THEN ['eng', 'deu', 'fra', 'spa', 'ita', 'nld', 'por', 'pol', 'swe', 'dan', 'fin', 'hun', 'tur', 'lat'] WHEN script = 'Cyrillic' THEN ['rus', 'ukr', 'bul'] WHEN script = 'Greek' THEN ['ell']
  WHEN script IN ('Han', 'HanS') THEN ['chi_sim'] WHEN script = 'HanT' THEN ['chi_tra', 'chi_sim'] WHEN script IN ('Japanese', 'Katakana') THEN ['jpn'] ELSE [] END AS codes FROM r),
f AS (SELECT c_custkey, list_filter(codes, lambda c: len(installed) = 0 OR list_contains(installed, c))[1:3] AS found FROM k)
SELECT c_custkey, CASE WHEN len(found) > 0 THEN array_to_string(found, '+') ELSE 'eng' END AS languages FROM f""")
def probe_languages(spark, sf):
    return _readers(spark, sf).select("c_custkey", scripts.probe_languages("script", F.col("installed")).alias("languages"))


@query(f"""WITH {_READERS}, b AS (SELECT *, CASE WHEN code = 'zho_Hans' THEN 'chi_sim' ELSE split_part(code, '_', 1) END AS name FROM r)
SELECT c_custkey, name, CASE WHEN code = 'auto' OR (len(installed) > 0 AND NOT list_contains(installed, name)) THEN 'eng' ELSE name END AS language FROM b""")
def reading_languages(spark, sf):
    return _readers(spark, sf).select("c_custkey", scripts.reader_code("code").alias("name"), scripts.reading_language("code", F.col("installed")).alias("language"))


@query(f"""WITH p AS (SELECT c_custkey, {_strings(_NAMES)}[c_custkey % 13 + 1] AS claimed, {_strings(_NAMES)}[c_custkey // 13 % 13 + 1] AS printed, c_custkey % 50 / 10.0::DOUBLE AS conf FROM customer),
n AS (SELECT *, CASE WHEN claimed IN ('HanS', 'HanT') THEN 'Han' ELSE claimed END AS a, CASE WHEN printed IN ('HanS', 'HanT') THEN 'Han' ELSE printed END AS b FROM p)
SELECT c_custkey, claimed NOT IN ('Runic', '') AS usable, claimed = '' OR printed = '' OR conf < 2 OR a = b OR (a IN ('Han', 'Japanese') AND b IN ('Han', 'Japanese')) AS trusted FROM n""")
def page_trust(spark, sf):
    c = table(spark, sf, "customer")
    p = c.select("c_custkey", _at(_NAMES, F.col("c_custkey") % 13).alias("claimed"), _at(_NAMES, F.floor(F.col("c_custkey") / 13) % 13).alias("printed"), (F.col("c_custkey") % 50 / 10.0).alias("conf"))
    return p.select("c_custkey", scripts.usable("claimed").alias("usable"), scripts.trustworthy("claimed", "printed", "conf").alias("trusted"))


@query("""WITH RECURSIVE l AS (SELECT l_suppkey AS doc_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity) AS n, 8 + l_quantity % 20 AS height FROM lineitem),
w AS (SELECT doc_id, n, 0 AS page, height::DOUBLE AS used FROM l WHERE n = 1 UNION ALL
  SELECT l.doc_id, l.n, CASE WHEN used + height > 300 THEN page + 1 ELSE page END, CASE WHEN used + height > 300 THEN height ELSE used + height END::DOUBLE FROM w JOIN l ON l.doc_id = w.doc_id AND l.n = w.n + 1)
SELECT doc_id, n::INT AS n, page::INT AS page FROM w""")
def pagination(spark, sf):
    from pyspark.sql import Window as W

    i = table(spark, sf, "lineitem")
    lines = i.select(F.col("l_suppkey").alias("doc_id"), F.row_number().over(W.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")).alias("n"), (8 + F.col("l_quantity") % 20).alias("height"))
    return pages.paginated(lines, 300, "doc_id").select("doc_id", "n", "page")


@query("SELECT l_orderkey, l_linenumber, 450.0 - (least(l_partkey % 300 + 10.0 * l_quantity, 500) - greatest(l_partkey % 300, 50)) < 80 AS fills FROM lineitem")
def image_bands(spark, sf):
    i, x = table(spark, sf, "lineitem"), F.col("l_partkey") % 300
    return i.select("l_orderkey", "l_linenumber", pages.image_fills(x, x + 10 * F.col("l_quantity"), F.lit(450.0), F.lit(50.0)).alias("fills"))


@query("SELECT l_suppkey, l_linenumber AS para, max(300 + l_partkey % 200 + l_quantity)::DOUBLE AS width FROM lineitem GROUP BY 1, 2")
def paragraph_widths(spark, sf):
    limits = table(spark, sf, "lineitem").select("l_suppkey", F.col("l_linenumber").alias("para"), (300 + F.col("l_partkey") % 200 + F.col("l_quantity")).cast("double").alias("limit"))
    return pages.width_limits(limits, "l_suppkey", "para")


_QUOTAS = ["max 100000", "400000 100000", "50000 100000", "", "x y", "250000 100000", "1600000 100000", "100000"]


@query(f"""WITH s AS (SELECT c_custkey, ['/', '', ' /a/b/ ', 'x'][c_custkey % 4 + 1] || CASE WHEN c_custkey % 3 = 0 THEN c_name || '//' ELSE '' END AS p, CASE WHEN c_custkey % 5 > 0 THEN c_name END AS v, {_strings(_QUOTAS)}[c_custkey % 8 + 1] AS q FROM customer),
t AS (SELECT *, trim(trim(p), '/') AS bare, try_cast(split_part(q, ' ', 1) AS BIGINT) AS quota, try_cast(split_part(q, ' ', 2) AS BIGINT) AS period FROM s)
SELECT c_custkey, CASE WHEN bare = '' THEN '' ELSE '/' || bare END AS root, coalesce(v, 'none') AS value, CASE WHEN quota IS NULL OR period IS NULL THEN 0 ELSE greatest(1, least(8, ceil(quota::DOUBLE / period))) END::BIGINT AS cpus FROM t""")
def settings(spark, sf):
    c = table(spark, sf, "customer")
    path = F.concat(_at(["/", "", " /a/b/ ", "x"], F.col("c_custkey") % 4), F.when(F.col("c_custkey") % 3 == 0, F.concat("c_name", F.lit("//"))).otherwise(F.lit("")))
    s = c.select("c_custkey", path.alias("p"), F.when(F.col("c_custkey") % 5 > 0, F.col("c_name")).alias("v"), _at(_QUOTAS, F.col("c_custkey") % 8).alias("q"))
    return s.select("c_custkey", upkeep.root_path("p").alias("root"), upkeep.setting("v", "none").alias("value"), upkeep.cpu_limit("q", F.lit(8)).alias("cpus"))


_FILES = ["config.json", "model.safetensors", "pytorch_model.bin", "vocab.json"]


def _files(spark, sf):
    i = table(spark, sf, "lineitem")
    return i.select(F.col("l_orderkey").alias("model_id"), _at(_FILES, F.col("l_linenumber") % 4).alias("name"), F.when(F.col("l_quantity") > 5, (F.col("l_quantity") * (F.col("l_partkey") % 3)).cast("long")).alias("size"))


_FILES_SQL = f"f AS (SELECT l_orderkey AS model_id, {_strings(_FILES)}[l_linenumber % 4 + 1] AS name, CASE WHEN l_quantity > 5 THEN (l_quantity * (l_partkey % 3))::BIGINT END AS size FROM lineitem)"


@query(f"""WITH {_FILES_SQL} SELECT model_id, coalesce(sum(size), 0)::BIGINT AS total, coalesce(nullif(max(coalesce(size, 0)) FILTER (name = 'model.safetensors'), 0), nullif(max(coalesce(size, 0)) FILTER (name = 'pytorch_model.bin'), 0), 0)::BIGINT AS download FROM f GROUP BY 1""")
def model_sizes(spark, sf):
    return upkeep.sizes(_files(spark, sf))


@query(f"WITH {_FILES_SQL} SELECT o_orderkey AS model_id FROM orders WHERE o_orderkey IN (SELECT model_id FROM f WHERE name IN ('model.safetensors', 'pytorch_model.bin'))")
def models_present(spark, sf):
    return upkeep.present(table(spark, sf, "orders").select(F.col("o_orderkey").alias("model_id")), _files(spark, sf))


_EXTENSIONS = ["PDF", "docx", ".Md", "tar.gz", "xlsx"]


@query(f"""WITH w AS (SELECT CASE WHEN o_orderkey % 9 = 0 THEN '../' ELSE '' END || o_orderkey AS id, {_strings(_EXTENSIONS)}[o_orderkey % 5 + 1] AS extension, o_orderkey FROM orders),
p AS (SELECT *, id || '.export.' || regexp_replace(lower(extension), '[^a-z0-9]+', '', 'g') AS path FROM w WHERE o_orderkey % 9 <> 0)
SELECT id, extension, path, CASE extension WHEN 'docx' THEN 'application/vnd.openxmlformats-officedocument.wordprocessingml.document' WHEN 'xlsx' THEN 'application/vnd.openxmlformats-officedocument.spreadsheetml.sheet' ELSE 'application/octet-stream' END AS media,
CASE WHEN o_orderkey % 2 = 0 THEN 'kept ' ELSE 'made ' END || id AS content, o_orderkey % 2 <> 0 AS built FROM p""")
def original_exports(spark, sf):
    o = table(spark, sf, "orders")
    wanted = o.select(F.concat(F.when(F.col("o_orderkey") % 9 == 0, "../").otherwise(""), F.col("o_orderkey").cast("string")).alias("id"), _at(_EXTENSIONS, F.col("o_orderkey") % 5).alias("extension"), "o_orderkey")
    kept = wanted.where("o_orderkey % 2 = 0").select(upkeep.export_path("id", "extension").alias("path"), F.concat(F.lit("kept "), "id").alias("content"))
    return upkeep.exports(wanted, kept, F.concat(F.lit("made "), "id"))


@query("SELECT o_orderkey AS job_id, 'complete' AS status FROM orders")
def job_snapshots(spark, sf):
    return upkeep.snapshots(table(spark, sf, "orders").select(F.col("o_orderkey").alias("job_id"), F.lit("complete").alias("status"), F.repeat(F.lit("x"), F.lit(100)).alias("result")))


@query("""WITH e AS (SELECT o_orderkey, 'e' || o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%d') AS created_at, ['docx', '', 'PDF'][o_orderkey % 3 + 1] AS ext FROM orders WHERE o_orderkey % 7 > 1)
SELECT id, created_at, 'n' || o_orderkey AS original_name, CASE WHEN o_orderkey % 4 > 0 THEN o_custkey_ ELSE 0 END::BIGINT AS size_bytes, ext <> '' AND o_orderkey % 5 = 0 AS has_source FROM (SELECT e.*, o.o_custkey AS o_custkey_ FROM e JOIN orders o USING (o_orderkey))""")
def history_entries(spark, sf):
    o, k = table(spark, sf, "orders"), F.col("o_orderkey")
    id_, ext = F.concat(F.lit("e"), k.cast("string")), _at(["docx", "", "PDF"], k % 3)
    fields = F.to_json(F.struct(id_.alias("id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("created_at"), ext.alias("source_extension"), F.concat(F.lit("n"), k.cast("string")).alias("original_name")))
    entries = o.select(F.when(k % 7 == 0, F.lit("{broken")).when(k % 7 == 1, F.lit('{"created_at": "2020-01-01"}')).otherwise(fields).alias("meta"))
    files = o.where("o_orderkey % 4 > 0").select(F.concat(id_, F.lit(".md")).alias("name"), F.col("o_custkey").cast("long").alias("size")).union(
        o.where("o_orderkey % 5 = 0").select(F.concat(id_, F.lit(".source."), F.lower(ext)).alias("name"), F.lit(1).cast("long").alias("size")))
    return upkeep.history(entries, files)


_LETTERS = r"\p{L}"
_JUNK = rf"(CASE WHEN len(regexp_extract_all(text, '{_LETTERS}')) = 0 THEN NOT regexp_matches(text, '^[-_—–]+$') ELSE len(regexp_extract_all(text, '{_LETTERS}')) <= 2 AND conf < 50 END)"
_LINE = "doc_id, page_no, line"


@query(f"""WITH {_WORDS}, j AS (SELECT *, {_JUNK} AS junk FROM w), k AS (SELECT *, min(word) FILTER (NOT junk) OVER p AS a, max(word) FILTER (NOT junk) OVER p AS z FROM j WINDOW p AS (PARTITION BY {_LINE}))
SELECT doc_id, line::INT AS line, md5(string_agg(text, ' ' ORDER BY word)) AS digest, count(*) AS n FROM k WHERE word BETWEEN a AND z GROUP BY 1, 2""")
def score_lines(spark, sf):
    ordered = F.array_sort(F.collect_list(F.struct("word", "text")))
    return ocr.trimmed(_words(spark, sf)).groupBy("doc_id", "line").agg(F.md5(F.array_join(F.transform(ordered, lambda w: w["text"]), " ")).alias("digest"), F.count("*").alias("n"))


_MARKS = rf"{T.LETTER}{T.WS}*-{T.WS}*{T.LETTER}|_"


@query(f"""WITH {_WORDS}, g AS (SELECT *, {_JUNK} AS junk, sum(CASE WHEN x - px > 24 THEN 1 ELSE 0 END) OVER (PARTITION BY {_LINE} ORDER BY word) AS span FROM (SELECT *, lag(x + 50) OVER (PARTITION BY {_LINE} ORDER BY word) AS px FROM w)),
s AS (SELECT {_LINE}, span, string_agg(text, ' ' ORDER BY word) AS said FROM g GROUP BY ALL),
f AS (SELECT {_LINE}, min(span) AS first FROM s WHERE len(regexp_extract_all(said, '{T.LETTER}{{2,}}')) >= 5 AND NOT regexp_matches(said, '{_MARKS}') GROUP BY ALL),
m AS (SELECT g.*, first, span = first AND bool_and(regexp_matches(text, '^\\p{{Nd}}+$')) OVER (PARTITION BY {_LINE}, span ORDER BY word) AND word < max(word) OVER (PARTITION BY {_LINE}, span) AS lead,
  bool_and(junk AND regexp_matches(text, '{_LETTERS}')) OVER (PARTITION BY {_LINE}, span ORDER BY word DESC) AS mark FROM g LEFT JOIN f USING (doc_id, page_no, line)),
o AS (SELECT *, min(word) FILTER (NOT coalesce(lead, false)) OVER (PARTITION BY {_LINE}, span) AS start FROM m),
c AS (SELECT *, CASE WHEN first IS NULL OR span < first THEN 'sung' WHEN lead THEN 'number' WHEN mark AND word > start THEN NULL ELSE 'direction' END AS piece FROM o)
SELECT doc_id, piece, count(*) AS n, md5(string_agg(text, ' ' ORDER BY line, word)) AS digest FROM c WHERE piece IS NOT NULL GROUP BY 1, 2""".replace("\\\\p", "\\p"))
def score_directions(spark, sf):
    ordered = F.array_sort(F.collect_list(F.struct("line", "word", "text")))
    return ocr.directions(_words(spark, sf)).groupBy("doc_id", "piece").agg(F.count("*").alias("n"), F.md5(F.array_join(F.transform(ordered, lambda w: w["text"]), " ")).alias("digest"))


@query()
def direction_groups(spark, sf):
    i = table(spark, sf, "lineitem")
    x, y = (F.col("l_partkey") % 4) * 130.0, (F.col("l_orderkey") % 50) * 14.0
    lines = i.groupBy(F.col("l_suppkey").alias("doc_id"), F.col("l_linenumber").alias("page_no"), F.col("l_orderkey").alias("n")).agg(F.min(x).alias("x0"), F.min(y).alias("y0"))
    return ocr.direction_groups(lines.select("doc_id", "page_no", "n", F.lit(0).alias("block"), F.lit(0).alias("par"), "x0", "y0", (F.col("x0") + 100).alias("x1"), (F.col("y0") + 12).alias("y1")))
