"""Queries of text rules over documents, conversations and pages."""

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import lists as L
from ..functions import longtext as LT
from ..functions import text as T
from ..operators import language, lookups, translate
from ..sources import markup
from ._tables import table

WS, LETTER = T.WS, T.LETTER
QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f
    return add


_TERM = T.TERMINATOR.replace("'", "''")
_SENT = T.SENTENCE.replace("'", "''")
_ABBR = ", ".join(f"'{a}'" for a in T.ABBREVIATIONS)
_EDGE = r"""[.,;:!?\"''()\[\]“”„»«]"""


def strip_sql(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{WS}+', ''), '{WS}+$', '')"


def _sentences_cte(rows: str = "documents", key: str = "doc_id") -> str:
    """p, f, g and s (key, k, s): the sentences of ``text`` of each of the rows."""
    return rf"""
  p AS (SELECT {key}, unnest(regexp_extract_all(text, '{_SENT}', 1)) AS s, generate_subscripts(regexp_extract_all(text, '{_SENT}', 1), 1) AS i FROM {rows}),
  f AS (SELECT *, NOT (coalesce(regexp_matches(lag(s) OVER (PARTITION BY {key} ORDER BY i), '[^{WS[1:]}\z'), false) AND NOT regexp_matches(regexp_replace(s, '{_TERM}$', ''), '{WS}')) AND lower(regexp_replace(regexp_replace(regexp_extract(regexp_replace(s, '{_TERM}$', ''), '(\S+)$', 1), '^{_EDGE}+', ''), '{_EDGE}+$', '')) IN ({_ABBR}) AS ab FROM p),
  g AS (SELECT *, sum(CASE WHEN coalesce(prev, false) THEN 0 ELSE 1 END) OVER (PARTITION BY {key} ORDER BY i) AS k FROM (SELECT *, lag(ab) OVER (PARTITION BY {key} ORDER BY i) AS prev FROM f)),
  s AS (SELECT {key}, k, string_agg(s, '' ORDER BY i) AS s FROM g GROUP BY 1, 2)
"""


_SENTENCES_CTE = _sentences_cte()


@query(f"WITH {_SENTENCES_CTE} SELECT doc_id, count(*) AS n_sentences, max(length(s)) AS longest, md5(string_agg(s, '|' ORDER BY k)) AS digest FROM s WHERE {strip_sql('s')} <> '' GROUP BY 1")
def sentence_split(spark, sf):
    # a filter on the pieces would be pushed down and cut the text once more
    d = table(spark, sf, "documents").where(~T.blank("text")).select("doc_id", T.sentences("text").alias("s"))
    return d.select("doc_id", F.size("s").cast("long").alias("n_sentences"), F.array_max(F.transform("s", F.length)).cast("long").alias("longest"), F.md5(F.array_join("s", "|")).alias("digest"))


def _translatable_sql(x: str) -> str:
    t = strip_sql(f"regexp_replace({x}, '{T.LEADERS}', ' ', 'g')")
    return f"CASE WHEN regexp_matches({t}, '{T.ADDRESS}') OR (regexp_matches({t}, '{T.ROMAN}') AND {t} <> '') THEN false ELSE len(regexp_extract_all({t}, '{T.CJK}')) >= 2 OR regexp_matches({t}, '{LETTER}{{2}}') END"


_CASES = ["", "  ", "...", "a b c", "12.04.2021 10:30", "https://example.org/a", "www.example.org", "xiv", "XIV.", "Kapitel . . . . . 12", ". . . . . .", "語", "日本", "ab", "3 kg", "see http://x.org now", "iv iv"]


@query(f"WITH c AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) SELECT doc_id, count(*) AS n_lines, count(*) FILTER ({_translatable_sql('line')}) AS n_translatable FROM c GROUP BY 1")
def translatable_lines(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return d.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.count_if(T.translatable("line")).alias("n_translatable"))


@query("SELECT t AS text, " + _translatable_sql("t") + " AS translatable FROM (VALUES " + ", ".join(f"('{c}')" for c in _CASES) + ") v(t)")
def translatable_cases(spark, sf):
    return spark.createDataFrame([(c,) for c in _CASES], "text string").select("text", T.translatable("text").alias("translatable"))


@query("SELECT doc_id, md5(regexp_replace(replace(text, '. ', '.'), '([.!?])([A-ZÄÖÜ])', '\\1 \\2', 'g')) AS digest FROM documents")
def normalized_spaces(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(T.space_after_stops(F.replace("text", F.lit(". "), F.lit(".")))).alias("digest"))


_DIRTY = "'“' || replace(replace(text, ' of ', ' — '), ' in ', ' . . . . ') || '” ' || chr(57345)"


def _clean_sql(x: str) -> str:
    # neighbouring dashes share their white space, which a second pass finds
    bare = f"regexp_replace(regexp_replace({x}, '{T.LEADERS}', ' ', 'g'), '[\\x{{E000}}-\\x{{F8FF}}]', '•', 'g')"
    return strip_sql(f"regexp_replace(regexp_replace(translate({bare}, '“”', '\"\"'), '({WS})[—–]({WS})', '\\1-\\2', 'g'), '({WS})[—–]({WS})', '\\1-\\2', 'g')")


_CLEAN = f"regexp_replace(regexp_replace({_DIRTY}, '{T.LEADERS}', ' ', 'g'), '[\\x{{E000}}-\\x{{F8FF}}]', '•', 'g')"


@query("SELECT doc_id, md5(" + strip_sql(f"regexp_replace(regexp_replace(translate({_CLEAN}, '“”', '\"\"'), '({WS})[—–]({WS})', '\\1-\\2', 'g'), '({WS})[—–]({WS})', '\\1-\\2', 'g')") + ") AS digest FROM documents")
def cleaned_source(spark, sf):
    dirty = F.concat(F.lit("“"), F.replace(F.replace("text", F.lit(" of "), F.lit(" — ")), F.lit(" in "), F.lit(" . . . . ")), F.lit("” "))
    return table(spark, sf, "documents").select("doc_id", F.md5(T.clean(dirty)).alias("digest"))


@query("SELECT doc_id, md5(CASE WHEN contains(text, ' of ') THEN replace(replace(text, ' of ', ' - '), ' - ', ' — ') ELSE replace(text, ' of ', ' - ') END) AS digest FROM documents WHERE NOT contains(text, ' - ') AND NOT contains(text, ' — ') AND NOT contains(text, ' – ')")
def restored_dashes(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.md5(T.restore_dashes(F.replace("text", F.lit(" of "), F.lit(" — ")), F.replace("text", F.lit(" of "), F.lit(" - ")))).alias("digest"))


_CJKN = f"len(regexp_extract_all(text, '{T.CJK}'))"


@query(f"""WITH o AS (SELECT doc_id, lang, text, CASE doc_id % 4 WHEN 0 THEN text || text || text || repeat('x', 20) WHEN 1 THEN text || ' [[x]]' WHEN 2 THEN text || '的' ELSE text || '!' END AS out FROM documents)
SELECT doc_id, (length(text) + 1.5 * {_CJKN})::DOUBLE AS weighted, NOT (length(out) > 2.0 * (length(text) + 1.5 * {_CJKN}) + 15 OR (regexp_matches(out, '{T.WIKI}') AND NOT regexp_matches(text, '{T.WIKI}')) OR (regexp_matches(out, '{T.CJK}') AND NOT regexp_matches(text, '{T.CJK}') AND lang <> 'fr')) AS kept FROM o""")
def guarded_output(spark, sf):
    m = F.col("doc_id") % 4
    out = F.when(m == 0, F.concat("text", "text", "text", F.lit("x" * 20))).when(m == 1, F.concat("text", F.lit(" [[x]]"))).when(m == 2, F.concat("text", F.lit("的"))).otherwise(F.concat("text", F.lit("!")))
    d = table(spark, sf, "documents").withColumn("out", out).withColumn("target", F.when(F.col("lang") == "fr", F.lit("jpn_Jpan")).otherwise(F.lit("deu_Latn")))
    return d.select("doc_id", T.weighted_length("text").alias("weighted"), (T.guard("text", "out", "target") == F.col("out")).alias("kept"))


@query(f"SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(replace(replace(replace(text, 'ff', 'ﬀ'), 'fi', 'ﬁ'), 'ti', 'Ɵ'), 'ﬀ', 'ff', 'g'), 'ﬁ', 'fi', 'g'), '({T.SMALL})Ɵ', '\\1ti', 'g')) AS digest FROM documents")
def expanded_ligatures(spark, sf):
    broken = F.replace(F.replace(F.replace("text", F.lit("ff"), F.lit("ﬀ")), F.lit("fi"), F.lit("ﬁ")), F.lit("ti"), F.lit("Ɵ"))
    return table(spark, sf, "documents").select("doc_id", F.md5(T.ligatures(broken)).alias("digest"))


_MD = "CASE doc_id % 4 WHEN 0 THEN '# ' || text WHEN 1 THEN replace(text, chr(10), chr(10) || '- ') WHEN 2 THEN replace(text, chr(10), chr(10) || '```' || chr(10)) ELSE replace(text, chr(10), chr(10) || '  2. ') END"
_FENCE = f"regexp_matches({strip_sql('line')}, '^(```|~~~)')"


@query(f"""WITH l AS (SELECT doc_id, unnest(string_split({_MD}, chr(10))) AS line, generate_subscripts(string_split({_MD}, chr(10)), 1) - 1 AS line_no FROM documents),
f AS (SELECT *, {_FENCE} AS fence, sum({_FENCE}::INT) OVER (PARTITION BY doc_id ORDER BY line_no) AS seen FROM l)
SELECT doc_id, line_no::INT AS line_no, CASE WHEN fence OR seen % 2 = 1 THEN line ELSE regexp_extract(line, '{T.MARKER}', 1) END AS prefix, md5(CASE WHEN fence OR seen % 2 = 1 THEN '' ELSE regexp_extract(line, '{T.MARKER}', 2) END) AS digest, fence OR seen % 2 = 1 AS in_fence FROM f""")
def markdown_blocks(spark, sf):
    m = F.col("doc_id") % 4
    md = F.when(m == 0, F.concat(F.lit("# "), "text")).when(m == 1, F.replace("text", F.lit("\n"), F.lit("\n- "))).when(m == 2, F.replace("text", F.lit("\n"), F.lit("\n```\n"))).otherwise(F.replace("text", F.lit("\n"), F.lit("\n  2. ")))
    got = translate.markdown_lines(table(spark, sf, "documents").select("doc_id", md.alias("text")), "doc_id")
    return got.select("doc_id", "line_no", "prefix", F.md5("line").alias("digest"), "in_fence")


def _dialogues(spark, sf):
    c = table(spark, sf, "conversations")
    part = F.concat(F.lit("# Page "), F.col("turn").cast("string"), F.lit("\n"), "text")
    return c.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", part.alias("p")))), lambda x: x["p"]), "\n").alias("text"))


@query(f"SELECT conv_id, turn::INT AS page_no, md5({strip_sql('text')}) AS digest FROM conversations")
def page_sections(spark, sf):
    return translate.page_sections(_dialogues(spark, sf), "conv_id").select("conv_id", "page_no", F.md5("text").alias("digest"))


@query(f"""WITH RECURSIVE p AS (SELECT conv_id, turn, coalesce(text, '') AS text, role = 'system' AS noise, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n, coalesce(lead(role = 'system') OVER w, false) AS nx FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
r AS (
  SELECT conv_id, 0::BIGINT AS i, NULL::BIGINT AS turn, '' AS page, '' AS carry FROM p WHERE i = 1
  UNION ALL
  SELECT q.conv_id, q.i, q.turn, CASE WHEN cut THEN {strip_sql('head')} ELSE now END, CASE WHEN cut THEN rest ELSE '' END FROM (
    SELECT *, i < n AND NOT noise AND NOT nx AND now <> '' AND head <> '' AND rest <> '' AS cut FROM (
      SELECT *, {strip_sql('substr(now, length(head) + 1)')} AS rest FROM (
        SELECT *, regexp_extract(now, '(?s)^(.*{_TERM})', 1) AS head FROM (
          SELECT p.*, {strip_sql("r.carry || CASE WHEN r.carry <> '' THEN ' ' ELSE '' END || p.text")} AS now FROM p JOIN r ON p.conv_id = r.conv_id AND p.i = r.i + 1)))) q
)
SELECT conv_id, turn::INT AS page_no, md5(page) AS digest FROM r WHERE i > 0""")
def cross_page_merge(spark, sf):
    pages = table(spark, sf, "conversations").select("conv_id", F.col("turn").cast("int").alias("page_no"), "text", (F.col("role") == "system").alias("noise"))
    return translate.merged_pages(pages, "conv_id").select("conv_id", "page_no", F.md5("text").alias("digest"))


@query(f"""WITH b AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\\b[^>]*>.*?</script\\s*>|<style\\b[^>]*>.*?</style\\s*>', '<>', 'g'), '(?s)<!--.*?-->', '<>', 'g'), '(?s)<[^>]*>', chr(1), 'g'), '&(?:[A-Za-z][A-Za-z0-9]*|#[0-9]+|#[xX][0-9A-Fa-f]+);?', chr(1), 'g') AS t FROM pages),
n AS (SELECT page_id, list_filter(list_transform(string_split(t, chr(1)), lambda x: {strip_sql('x')}), lambda x: x <> '') AS l FROM b)
SELECT page_id, (generate_subscripts(l, 1) - 1)::INT AS n, unnest(l) AS text FROM n""")
def html_text_nodes(spark, sf):
    return markup.html_nodes(table(spark, sf, "pages"), "page_id")


_YAML_SQL = "'name: \"' || p_name || '\"' || chr(10) || 'size: ' || p_size || chr(10) || '  brand: ' || p_brand || ' # mark' || chr(10) || 'ready: true' || chr(10) || 'type: ' || p_type"


@query("""SELECT p_partkey, 0 AS line_no, p_name AS text FROM part UNION ALL SELECT p_partkey, 2, string_split(p_brand, '#')[1] FROM part UNION ALL SELECT p_partkey, 4, p_type FROM part""")
def yaml_scalars(spark, sf):
    p = table(spark, sf, "part")
    text = F.concat(F.lit('name: "'), "p_name", F.lit('"\nsize: '), F.col("p_size").cast("string"), F.lit("\n  brand: "), "p_brand", F.lit(" # mark\nready: true\ntype: "), "p_type")
    return markup.yaml_scalars(p.select("p_partkey", text.alias("text")), "p_partkey")


@query("""SELECT p_partkey, 3 AS n, p_name AS msgid, p_name AS text FROM part UNION ALL SELECT p_partkey, 5, p_brand, p_type FROM part""")
def gettext_entries(spark, sf):
    p = table(spark, sf, "part")
    text = F.concat(F.lit('msgid ""\nmsgstr ""\n"Language: de"\n\nmsgid "'), "p_name", F.lit('"\nmsgstr ""\n\nmsgid "'), "p_brand", F.lit('"\nmsgstr "'), "p_type", F.lit('"\n'))
    return markup.gettext_entries(p.select("p_partkey", text.alias("text")), "p_partkey")


@query("""SELECT n_nationkey, 0 AS n, '00:00:01,000' AS "start", '00:00:02,000' AS "end", n_name AS text FROM nation UNION ALL SELECT n_nationkey, 2, '00:00:05,000', '00:00:06,000', n_name || chr(10) || 'again' FROM nation""")
def subtitle_cues(spark, sf):
    n = table(spark, sf, "nation")
    text = F.concat(F.lit("1\n00:00:01,000 --> 00:00:02,000\n"), "n_name", F.lit("\n\n2\n00:00:03,000 --> 00:00:04,000\n \n\n3\n00:00:05,000 --> 00:00:06,000\n"), "n_name", F.lit("\nagain\nNOTE x\n"))
    return markup.subtitle_cues(n.select("n_nationkey", text.alias("text")), "n_nationkey")


@query("""SELECT n_nationkey, 0 AS n, n_name AS text FROM nation UNION ALL SELECT n_nationkey, 1, 'b & c' FROM nation""")
def xliff_units(spark, sf):
    n = table(spark, sf, "nation")
    text = F.concat(F.lit('<xliff><trans-unit id="1"><source>'), "n_name", F.lit('</source></trans-unit><trans-unit id="2"><source>a</source><target>b <g>&amp;</g> c</target></trans-unit><trans-unit id="3"><source></source></trans-unit></xliff>'))
    return markup.xliff_units(n.select("n_nationkey", text.alias("text")), "n_nationkey")


@query("""SELECT c_custkey, 0 AS c, 'c_mktsegment' AS "column", c_mktsegment AS text FROM customer UNION ALL SELECT c_custkey, 1, 'c_name', c_name FROM customer""")
def delimited_cells(spark, sf):
    return markup.cells(table(spark, sf, "customer"), "c_custkey", ["c_mktsegment", "c_name"])


_IP = r"([0-9]{1,3}\.){3}[0-9]{1,3}"


@query(f"""WITH v AS (SELECT c_custkey, unnest([c_name, c_acctbal::VARCHAR, (c_custkey % 250) || '.1.2.3', (c_custkey % 250) || '.1.2.0/24', '10.0.0.1 - 10.0.0.9', 'AA:BB:CC:00:11:22', '  ', c_mktsegment, '-12,5', '3 kg']) AS t, generate_subscripts([1,2,3,4,5,6,7,8,9,10], 1) AS i FROM customer)
SELECT c_custkey, sum(CASE WHEN trim(t) <> '' AND NOT (regexp_matches(trim(t), '^-?[0-9]+([.,][0-9]+)?$') OR regexp_matches(trim(t), '^{_IP}(/[0-9]{{1,2}})?$') OR regexp_matches(trim(t), '^{_IP}\\s*-\\s*{_IP}$') OR regexp_matches(trim(t), '^([0-9A-Fa-f]{{2}}[:-]){{5}}[0-9A-Fa-f]{{2}}$')) THEN i ELSE 0 END)::BIGINT AS kept FROM v GROUP BY 1""")
def spreadsheet_cells(spark, sf):
    c, k = table(spark, sf, "customer"), (F.col("c_custkey") % 250).cast("string")
    values = F.array("c_name", F.col("c_acctbal").cast("string"), F.concat(k, F.lit(".1.2.3")), F.concat(k, F.lit(".1.2.0/24")), F.lit("10.0.0.1 - 10.0.0.9"), F.lit("AA:BB:CC:00:11:22"), F.lit("  "), "c_mktsegment", F.lit("-12,5"), F.lit("3 kg"))
    rows = c.select("c_custkey", F.posexplode(values).alias("i", "t"))
    return rows.groupBy("c_custkey").agg(F.sum(F.when(T.plain_cell("t"), F.col("i") + 1).otherwise(0)).cast("long").alias("kept"))


_SCRIPT_SQL = ", ".join(f"{{'n': len(regexp_extract_all(text, '{p.replace('Is', '')}')), 'i': {-i}, 's': '{n}'}}" for i, (n, p) in enumerate(T.SCRIPTS.items()))


@query(f"""SELECT doc_id, (list_sort([{_SCRIPT_SQL}], 'DESC')[1]).s AS script, round(len(regexp_extract_all(text, '\\p{{L}}')) / (length(text) - len(regexp_extract_all(text, '{WS}')))::DOUBLE, 9) AS letters, false AS rtl, '' AS other FROM documents""")
def script_figures(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.script("text").alias("script"), F.round(T.letter_share("text"), 9).alias("letters"), T.right_to_left("text").alias("rtl"), T.first_script("text").alias("other"))


@query("WITH b AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i, unnest(string_split(text, chr(10))) AS t FROM documents), k AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS n, trim(t, ' ' || chr(9)) AS t FROM b WHERE trim(t, ' ' || chr(9)) <> '') SELECT doc_id, md5(string_agg(CASE WHEN n % 3 = 0 THEN '+' || t ELSE t END, '|' ORDER BY n)) AS digest, count(*) AS n FROM k GROUP BY 1")
def ordinal_reinjection(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    parts = lookups.numbered_blocks(d, "text", "doc_id").withColumnRenamed("block", "text").withColumn("text", F.regexp_replace("text", r"^[ \t]+|[ \t]+$", ""))
    new = parts.where("n % 3 = 0").select("doc_id", "n", F.concat(F.lit("+"), "text").alias("block"))
    done = lookups.reinjected(parts, new, "doc_id")
    return done.groupBy("doc_id").agg(F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda x: x["text"]), "|")).alias("digest"), F.count("*").alias("n"))


_PAIRS = [("en", "de", "opus-mt-en-de"), ("fr", "de", "opus-mt-tc-big-fr-de"), ("xx", "de", "opus-mt-xx-de")]


@query(f"""SELECT doc_id, CASE lang WHEN 'en' THEN 'opus-mt-en-de' WHEN 'fr' THEN 'opus-mt-tc-big-fr-de' ELSE '{L.FALLBACK_MODEL}' END AS model_id, coalesce(lang IN ('en', 'fr'), false) AS dedicated FROM documents""")
def pair_lookup(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", language.internal("lang", "und").alias("source"), F.lit("deu_Latn").alias("target"))
    return lookups.resolved_models(d, spark.createDataFrame(_PAIRS, "src string, tgt string, model_id string")).select("doc_id", "model_id", "dedicated")


@query("SELECT src, tgt, model_id FROM (VALUES ('en', 'de', 'opus-mt-en-de'), ('fr', 'de', 'opus-mt-tc-big-fr-de')) v(src, tgt, model_id)")
def offered_pairs(spark, sf):
    return lookups.offered_pairs(spark.createDataFrame(_PAIRS, "src string, tgt string, model_id string"), lookups.catalogue(spark))


@query("""WITH l(c) AS (VALUES ('en'), ('de'), ('fr'), ('es')), m AS (
  SELECT p_partkey AS pos, 'opus-mt-' || CASE WHEN p_size % 3 = 0 THEN 'tc-big-' ELSE '' END || ['en','de','fr','es','qq'][(p_partkey % 5) + 1] || '-' || ['de','en','es','fr'][(p_size % 4) + 1] AS name, p_partkey % 5 AS a, p_size % 4 AS b, p_size % 3 = 0 AS big, ['en','de','fr','es','qq'][(p_partkey % 5) + 1] AS src, ['de','en','es','fr'][(p_size % 4) + 1] AS tgt, p_partkey % 2 = 0 AS lic FROM part)
SELECT src, tgt, name AS model_id, CASE WHEN lic THEN 'apache-2.0' ELSE 'unknown' END AS license FROM m WHERE src <> tgt AND src IN (SELECT c FROM l) QUALIFY row_number() OVER (PARTITION BY src, tgt ORDER BY big DESC, pos) = 1""")
def best_models(spark, sf):
    p = table(spark, sf, "part")
    src, tgt = F.get(F.array(*map(F.lit, ("en", "de", "fr", "es", "qq"))), (F.col("p_partkey") % 5).cast("int")), F.get(F.array(*map(F.lit, ("de", "en", "es", "fr"))), F.col("p_size") % 4)
    name = F.concat(F.lit("opus-mt-"), F.when(F.col("p_size") % 3 == 0, F.lit("tc-big-")).otherwise(F.lit("")), src, F.lit("-"), tgt)
    tags = F.when(F.col("p_partkey") % 2 == 0, F.array(F.lit("translation"), F.lit("license:apache-2.0"), F.lit("license:mit"))).otherwise(F.array(F.lit("translation")))
    return lookups.best_models(p.select(F.col("p_partkey").alias("pos"), name.alias("name"), tags.alias("tags")), lookups.catalogue(spark))


_GRAMS = f"' ' || lower(regexp_replace({strip_sql('text')}, '\\s+', ' ', 'g')) || ' '"


@query(f"""WITH t0 AS MATERIALIZED (SELECT doc_id, lang, string_split({_GRAMS}, '') AS ch FROM documents), g AS (SELECT doc_id, lang, unnest(list_transform(range(1, len(ch) - 1), lambda i: ch[i] || ch[i + 1] || ch[i + 2])) AS gram FROM t0),
c AS (SELECT lang AS l, gram, count(*) AS n FROM g WHERE doc_id % 2 = 0 GROUP BY 1, 2), t AS (SELECT l, sum(n) AS a FROM c GROUP BY 1),
p AS (SELECT l, gram, n * 1000000 // a AS w FROM (SELECT *, row_number() OVER (PARTITION BY l ORDER BY n DESC, gram) AS r FROM c) JOIN t USING (l) WHERE r <= {language.PROFILE}),
s AS (SELECT doc_id, l, sum(n * w) AS w FROM (SELECT doc_id, gram, count(*) AS n FROM g GROUP BY 1, 2) JOIN p USING (gram) GROUP BY 1, 2)
SELECT doc_id, l AS lang, round((w / sum(w) OVER (PARTITION BY doc_id))::DOUBLE, 6) AS share FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY w DESC, l) = 1""")
def language_profiles(spark, sf):
    d = table(spark, sf, "documents")
    got = language.detected(d, language.profiles(d), "doc_id")
    return got.select("doc_id", "lang", F.round("share", 6).alias("share"))


@query(f"""WITH c AS (SELECT source AS doc_id, doc_id AS n, text, CASE WHEN length({strip_sql('text')}) >= 200 AND lang <> 'es' THEN lang END AS sure, lang AS guess, CASE WHEN source IN ('src1', 'src2') THEN 'de' ELSE 'en' END AS source, 'de' AS target, source <> 'src3' AS mixed FROM documents),
p AS (SELECT doc_id, list_distinct(list(sure) FILTER (sure IS NOT NULL AND mixed)) AS proven FROM c GROUP BY 1),
x AS (SELECT c.*, proven, CASE WHEN mixed THEN coalesce(sure, CASE WHEN len(list_distinct(list_append(coalesce(proven, []), source))) > 1 AND len(regexp_extract_all(text, '{LETTER}{{2,}}')) >= 3 THEN guess END) END AS l FROM c JOIN p USING (doc_id)),
k AS (SELECT doc_id, n, coalesce(l, source) AS lang FROM x WHERE NOT (mixed AND (coalesce(l = target, false) OR (l IS NULL AND source = target AND coalesce(list_contains(proven, target), false)))))
SELECT doc_id, lang, min(n) AS "first", count(*) AS members FROM k GROUP BY 1, 2""")
def language_groups(spark, sf):
    d = table(spark, sf, "documents")
    sure = F.when((F.length(T.strip("text")) >= 200) & (F.col("lang") != "es"), F.col("lang"))
    chunks = d.select(F.col("source").alias("doc_id"), F.col("doc_id").alias("n"), "text", sure.alias("sure"), F.col("lang").alias("among"), F.when(F.col("source").isin("src1", "src2"), F.lit("de")).otherwise(F.lit("en")).alias("source"), F.lit("de").alias("target"), (F.col("source") != "src3").alias("mixed"))
    return language.language_groups(chunks).select("doc_id", "lang", "first", F.size("members").cast("long").alias("members"))


@query("""WITH v AS (SELECT doc_id, string_split(regexp_replace(text, '-', ' ', 'g'), ' ') AS w FROM documents) SELECT doc_id, md5(regexp_replace(replace(text, ' to ', '_'), '_+', ' ', 'g')) AS digest FROM documents WHERE NOT contains(text, '-')""")
def sung_syllables(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.md5(T.join_syllables(F.replace(F.replace("text", F.lit(" to "), F.lit("_")), F.lit("ti"), F.lit("t - i")))).alias("digest"))


@query("SELECT p_partkey, upper(chr((97 + p_partkey % 26)::INT) || chr((97 + p_size % 26)::INT)) AS name, ((p_partkey % 26) + 1) * 26 + (p_size % 26) + 1 AS idx FROM part")
def spreadsheet_columns(spark, sf):
    ref = F.concat(F.chr((F.col("p_partkey") % 26 + 97).cast("int")), F.chr(F.col("p_size") % 26 + 97), F.col("p_size").cast("string"))
    name = T.column_name(ref)
    return table(spark, sf, "part").select("p_partkey", name.alias("name"), T.column_index(name).alias("idx"))


@query("""SELECT * FROM (VALUES (1, 'deu_Latn,spa_Latn,fra_Latn,eng_Latn'), (2, 'eng_Latn,deu_Latn'), (3, 'eng_Latn'), (4, 'fra_Latn,eng_Latn')) v(id, codes)""")
def favourite_languages(spark, sf):
    rows = [(1, " deu_Latn,spa_Latn, deu_Latn,xx,fra_Latn,ita_Latn"), (2, "eng_Latn,deu_Latn"), (3, ""), (4, "fra_Latn,,eng_Latn")]
    return spark.createDataFrame(rows, "id int, spec string").select("id", F.array_join(L.favourites("spec"), ",").alias("codes"))


@query("""SELECT * FROM (VALUES (1, '1,2,3,4,5'), (2, '1,2,3,5'), (3, '4,5'), (4, NULL), (5, NULL), (6, NULL), (7, NULL), (8, '2')) v(id, pages)""")
def page_ranges(spark, sf):
    rows = [(1, " "), (2, "1-3, 5"), (3, "4-9"), (4, "6"), (5, "3-2"), (6, "0"), (7, "a"), (8, "2,2")]
    return spark.createDataFrame(rows, "id int, spec string").select("id", F.array_join(F.transform(L.pages("spec", F.lit(5)), lambda p: p.cast("string")), ",").alias("pages"))


@query("""WITH w AS (SELECT doc_id, list_filter(string_split_regex(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' '), lambda x: x <> '') AS w FROM documents)
SELECT doc_id, len(w)::INT AS n, CASE WHEN len(w) >= 3 THEN least(greatest(round_even(len(w) / 6.0, 0)::INT, 1), len(w)::INT - 2) END AS "first", CASE WHEN len(w) >= 3 THEN len(w)::INT - greatest(least(greatest(round_even(len(w) * 3 / 6.0, 0)::INT, least(greatest(round_even(len(w) / 6.0, 0)::INT, 1), len(w)::INT - 2) + 1), len(w)::INT - 1), least(greatest(round_even(len(w) / 6.0, 0)::INT, 1), len(w)::INT - 2)) END AS "last" FROM w""")
def spread_words(spark, sf):
    words = F.filter(F.split(T.squeeze("text"), " "), lambda x: x != "")
    d = table(spark, sf, "documents").select("doc_id", words.alias("w"))
    parts = L.spread("w", F.array(F.lit("a"), F.lit("b c"), F.lit("d e f")))
    enough = F.size("w") >= 3
    return d.select("doc_id", F.size("w").alias("n"), F.when(enough, F.size(F.get(parts, F.lit(0)))).alias("first"), F.when(enough, F.size(F.get(parts, F.lit(2)))).alias("last"))


@query(f"SELECT doc_id, CASE lang WHEN 'fr' THEN '>>deu<< ' || text ELSE text END = CASE lang WHEN 'fr' THEN '>>deu<< ' || text ELSE text END AS same, md5(CASE lang WHEN 'fr' THEN '>>deu<< ' ELSE '' END || text) AS digest FROM documents")
def model_inputs(spark, sf):
    model = F.when(F.col("lang") == "fr", F.lit(L.FALLBACK_MODEL)).otherwise(F.lit("opus-mt-en-de"))
    return table(spark, sf, "documents").select("doc_id", F.lit(True).alias("same"), F.md5(T.model_input(model, "text", F.lit("deu_Latn"))).alias("digest"))


@query()
def long_text_chunks(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", LT.split_long(F.col("text")).alias("c"))
    return d.select("doc_id", F.size("c").alias("n"), F.array_max(F.transform("c", F.length)).alias("longest"), F.md5(F.array_join("c", "|")).alias("digest"))


@query()
def token_limited(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text", LT.split_to_tokens(F.col("text")).alias("c"))
    return d.select("doc_id", F.size("c").alias("n"), (F.array_join("c", "") == F.col("text")).alias("lossless"))


@query()
def wrapped_lines(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", LT.wrap(F.col("text"), 72).alias("c"))
    return d.select("doc_id", F.size("c").alias("n"), F.md5(F.array_join("c", "\n")).alias("digest"))


@query()
def logical_order(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(LT.to_logical(F.concat(F.lit("שלום "), "text"))).alias("digest"))


def flagship(spark, sf):
    """Documents as sentences, cleaned, enriched by the identity backend, guarded, rejoined and counted by language and model."""
    d = table(spark, sf, "documents")
    blocks = d.select("doc_id", "lang", F.posexplode(F.split("text", "\n")).alias("n", "text")).where(T.translatable("text"))
    sourced = blocks.withColumn("source", language.internal("lang", "und")).withColumn("target", F.lit("deu_Latn"))
    routed = lookups.resolved_models(sourced, spark.createDataFrame(_PAIRS, "src string, tgt string, model_id string"))
    done = translate.translated(routed, "doc_id", "lang", "model_id", "n")
    return done.groupBy("lang", "model_id").agg(
        F.count("*").alias("chunks"), F.sum(F.size(T.sentences(T.clean("text")))).alias("n_sentences"), F.sum(F.length("text")).alias("n_chars"), F.count_if(T.strip("out") == T.strip(T.clean("text"))).alias("unchanged"),
    )


QUERIES["translated_documents"] = flagship
SQL["translated_documents"] = f"""WITH l AS (SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents),
  c AS (SELECT row_number() OVER () AS id, lang, line, {_clean_sql('line')} AS text FROM l WHERE {_translatable_sql('line')}),
  {_sentences_cte('c', 'id')},
  j AS (SELECT id, count(*) FILTER ({strip_sql('s')} <> '') AS n, string_agg({strip_sql('s')}, ' ' ORDER BY k) FILTER ({strip_sql('s')} <> '') AS joined FROM s GROUP BY 1),
  o AS (SELECT c.*, j.n, joined, regexp_extract(line, '{WS}([—–]){WS}', 1) AS dash FROM c JOIN j USING (id)),
  r AS (SELECT *, CASE WHEN dash = '' OR contains(line, ' - ') THEN joined ELSE replace(joined, ' - ', ' ' || dash || ' ') END AS out FROM o)
SELECT lang, CASE split_part(lang, '-', 1) WHEN 'en' THEN 'opus-mt-en-de' WHEN 'fr' THEN 'opus-mt-tc-big-fr-de' ELSE 'Helsinki-NLP/opus-mt-tc-bible-big-mul-mul' END AS model_id,
  count(*) AS chunks, sum(n)::BIGINT AS n_sentences, sum(length(line))::BIGINT AS n_chars, count(*) FILTER ({strip_sql('out')} = text) AS unchanged FROM r GROUP BY 1, 2"""
