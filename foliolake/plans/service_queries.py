"""Queries of jobs, history, formats and quality."""

import json
import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as TY

from ..functions import text as T
from ..operators import jobs, quality
from ..sources import files
from ..storage import shared_dir
from ..streaming import jobs as streams
from ._tables import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f
    return add


def _jobs(spark, sf):
    o, day = table(spark, sf, "orders"), F.unix_timestamp(F.col("o_orderdate").cast("timestamp"))
    status = F.get(F.array(*map(F.lit, ("queued", "running", "complete", "failed", "paused"))), (F.col("o_orderkey") % 5).cast("int"))
    return o.select(
        F.col("o_orderkey").alias("job_id"), status.alias("status"), F.when(F.col("o_custkey") % 7 == 0, F.lit(0)).otherwise(day).alias("queued_at"), (day + 60).alias("started_at"), (day + 3600).alias("finished_at"), (F.col("o_custkey") % 11).alias("current"),
        (F.col("o_custkey") % 9).alias("total"), (day + F.col("o_orderkey") % 500 + 60).alias("now"), (F.col("o_custkey") % 13 == 0).alias("cancel_requested"), F.concat(F.lit("kind"), (F.col("o_custkey") % 3).cast("string")).alias("kind"),
    )


_JOBS = """j AS (SELECT o_orderkey AS job_id, ['queued','running','complete','failed','paused'][(o_orderkey % 5) + 1] AS status, CASE WHEN o_custkey % 7 = 0 THEN 0 ELSE epoch(o_orderdate)::BIGINT END AS queued_at, epoch(o_orderdate)::BIGINT + 60 AS started_at, epoch(o_orderdate)::BIGINT + 3600 AS finished_at,
  o_custkey % 11 AS current, o_custkey % 9 AS total, epoch(o_orderdate)::BIGINT + o_orderkey % 500 + 60 AS now, o_custkey % 13 = 0 AS cancel_requested, 'kind' || (o_custkey % 3) AS kind FROM orders)"""
_AT = "coalesce(nullif(queued_at, 0), nullif(started_at, 0), nullif(finished_at, 0), 0)"


@query(f"WITH {_JOBS} SELECT job_id, row_number() OVER (ORDER BY {_AT}, job_id)::INT AS position FROM j WHERE status = 'queued'")
def queue_positions(spark, sf):
    return jobs.queue_positions(_jobs(spark, sf))


@query(f"""WITH {_JOBS} SELECT job_id, CASE WHEN total <= 0 THEN 0 WHEN status = 'running' AND current >= total THEN least(round_even(100.0::DOUBLE * current / total, 1), 99) ELSE least(round_even(100.0::DOUBLE * current / total, 1), 100) END::DOUBLE AS percent,
CASE WHEN current >= total AND total > 0 THEN 0 WHEN current > 0 AND current < total THEN round_even((now - started_at)::DOUBLE / current * (total - current), 0)::BIGINT END AS eta FROM j""")
def job_progress(spark, sf):
    return jobs.progress(_jobs(spark, sf))


@query(f"WITH {_JOBS} SELECT job_id, status FROM j WHERE status = 'queued' AND NOT cancel_requested AND job_id % 10 <> 0 ORDER BY {_AT}, job_id LIMIT 1")
def next_job(spark, sf):
    j = _jobs(spark, sf)
    return jobs.next_job(j, j.where("job_id % 10 = 0")).select("job_id", "status")


@query(f"""WITH {_JOBS} SELECT job_id, CASE WHEN cancel_requested AND status IN ('running', 'queued') THEN 'cancelled' WHEN status IN ('running', 'queued') AND kind = 'kind2' THEN 'failed' WHEN status = 'running' THEN 'queued' ELSE status END AS status, status <> 'running' AS started FROM j""")
def job_recovery(spark, sf):
    j = _jobs(spark, sf)
    snaps = j.withColumn("ts", F.lit(2)).unionByName(j.withColumn("ts", F.lit(1)).withColumn("status", F.lit("queued")))
    return jobs.recovered(snaps, ("kind0", "kind1")).select("job_id", "status", F.col("started_at").isNotNull().alias("started"))


@query(f"WITH {_JOBS} SELECT job_id FROM j WHERE NOT (status IN ('complete', 'failed', 'cancelled') AND coalesce(finished_at, queued_at, 0) < 1000000000 - 3600)")
def job_retention(spark, sf):
    return jobs.unexpired_jobs(_jobs(spark, sf), 1_000_000_000.0).select("job_id")


@query(f"WITH {_JOBS} SELECT j.job_id, CASE WHEN status = 'complete' THEN 'done ' || j.job_id END AS result, p.position FROM j LEFT JOIN (SELECT job_id, row_number() OVER (ORDER BY {_AT}, job_id)::INT AS position FROM j WHERE status = 'queued') p USING (job_id)")
def job_results(spark, sf):
    j = _jobs(spark, sf).withColumn("history_id", F.col("job_id").cast("string")).withColumn("result", F.lit(None).cast("string"))
    return jobs.with_results(j, j.select(F.col("history_id").alias("id"), F.concat(F.lit("done "), "history_id").alias("result"))).select("job_id", "result", "position")


def _history(spark, sf):
    o = table(spark, sf, "orders")
    return o.select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderdate").cast("timestamp").alias("created_at"), F.concat(F.lit("Datei "), F.col("o_orderkey").cast("string"), F.lit(".docx")).alias("original_name"), F.col("o_orderstatus").alias("source"), F.lit("deu_Latn").alias("target"))


@query("SELECT o_orderkey::VARCHAR AS id FROM orders ORDER BY o_orderdate DESC, o_orderkey::VARCHAR DESC LIMIT 10")
def newest_entries(spark, sf):
    return jobs.newest(_history(spark, sf), 10).select("id")


@query("SELECT o_orderkey::VARCHAR AS id FROM orders WHERE contains(lower('Datei ' || o_orderkey || '.docx ' || o_orderstatus || ' deu_Latn'), '7.docx f') ORDER BY o_orderdate DESC, o_orderkey::VARCHAR DESC LIMIT 5 OFFSET 5")
def history_page(spark, sf):
    return jobs.filtered(_history(spark, sf), "7.docx F", page=1).select("id")


@query("SELECT o_orderkey::VARCHAR AS id, strftime(o_orderdate, '%Y%m%d') || '-Datei-' || o_orderkey || '.docx-' || substr(md5(o_orderkey::VARCHAR), 1, 8) AS entry, 'Datei_' || o_orderkey || '_' || strftime(o_orderdate, '%Y-%m-%d_%H%M') || '_deu.pdf' AS file FROM orders")
def history_names(spark, sf):
    h = _history(spark, sf)
    return h.select("id", jobs.entry_id(F.col("created_at"), F.col("original_name"), F.md5("id")).alias("entry"), jobs.download_name(F.col("original_name"), F.col("created_at"), F.col("target"), "pdf").alias("file"))


@query("SELECT count(*) AS n FROM (SELECT o_custkey, max(o_orderdate < TIMESTAMP '1996-01-01' - INTERVAL 48 HOUR) AS gone FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1) e RIGHT JOIN orders o ON e.o_custkey = o.o_custkey WHERE NOT coalesce(gone, o.o_orderdate < TIMESTAMP '1996-01-01' - INTERVAL 48 HOUR)")
def file_retention(spark, sf):
    import datetime

    o = table(spark, sf, "orders")
    rows = o.select(F.concat(F.lit("e"), F.col("o_custkey").cast("string"), F.lit(".x"), F.col("o_orderkey").cast("string")).alias("name"), F.col("o_orderdate").alias("modified"), (F.col("o_orderkey") % 2 == 0).alias("is_entry"))
    return jobs.unexpired_files(rows, datetime.datetime(1996, 1, 1), 48).agg(F.count("*").alias("n"))


_CHUNKS = "c AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS src, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents), o AS (SELECT doc_id, trim(src) AS src, CASE (i + doc_id) % 3 WHEN 0 THEN trim(src) WHEN 1 THEN substr(trim(src), 1, (length(trim(src)) / 2)::INT) ELSE upper(trim(src)) END AS out, i FROM c)"


def _chunks(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "src"))
    s, m = F.trim("src"), (F.col("i") + 1 + F.col("doc_id")) % 3
    out = F.when(m == 0, s).when(m == 1, F.substring(s, F.lit(1), F.bround(F.length(s) / 2).cast("int"))).otherwise(F.upper(s))
    return d.select("doc_id", s.alias("source"), out.alias("out"), F.when(m == 2, s).otherwise(out).alias("raw"))


@query(f"""WITH {_CHUNKS} SELECT doc_id, count(*) AS chunks, count(*) FILTER (src = trim(out) AND len(list_filter(string_split(src, ' '), lambda x: x <> '')) >= 4) AS untranslated,
count(*) FILTER (src <> trim(out) AND length(src) >= 30 AND length(out) < 0.55 * length(src)) AS lost, count(*) FILTER ((i + doc_id) % 3 = 2 AND src <> out) AS guard_hits FROM o WHERE regexp_matches(src, '{T.LETTER}{{2}}') AND NOT regexp_matches(src, '{T.ROMAN}') GROUP BY 1""")
def quality_measures(spark, sf):
    return quality.measures(_chunks(spark, sf), "doc_id")


@query("""WITH n AS (SELECT o_orderstatus AS k, count(*) AS chunks, sum(o_custkey % 5)::BIGINT AS lost FROM orders GROUP BY 1) SELECT k, sum(chunks)::BIGINT AS chunks, sum(lost)::BIGINT AS lost, (sum(chunks) - sum(CASE WHEN k <> 'F' THEN chunks - 7 ELSE chunks END))::BIGINT AS chunks_delta, (sum(lost) - sum(CASE WHEN k <> 'F' THEN lost * 2 ELSE lost END))::BIGINT AS lost_delta FROM n GROUP BY ROLLUP (k)""")
def baseline_delta(spark, sf):
    now = table(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("k")).agg(F.count("*").alias("chunks"), F.sum(F.col("o_custkey") % 5).alias("lost"))
    old = now.where("k <> 'F'").select("k", (F.col("chunks") - 7).alias("chunks"), (F.col("lost") * 2).alias("lost"))
    return quality.compared(now, old, "k", ["chunks", "lost"])


@query("SELECT doc_id, substr(sha256(text), 1, 16) AS result_sha FROM documents")
def result_hashes(spark, sf):
    return table(spark, sf, "documents").select("doc_id", quality.result_hash(F.col("text")).alias("result_sha"))


def _as_json(spark, sf):
    o = table(spark, sf, "orders")
    value = F.struct(F.col("o_orderpriority").alias("title"), F.col("o_orderkey").alias("n"), F.array(F.struct(F.col("o_orderstatus").alias("b"), F.lit(" ").alias("a"))).alias("items"))
    return o.select(F.col("o_orderkey").alias("doc_id"), F.lit("json").alias("ext"), F.to_json(value).cast("binary").alias("content"), F.create_map().cast("map<string,string>").alias("opts"))


@query("""SELECT o_orderkey AS doc_id, 0 AS block_no, '["title"]' AS path, o_orderpriority AS text FROM orders UNION ALL SELECT o_orderkey, 1, '["items", 0, "b"]', o_orderstatus FROM orders""")
def json_string_paths(spark, sf):
    return files.blocks(_as_json(spark, sf)).select("doc_id", "block_no", "path", "text")


@query("""SELECT o_orderkey AS doc_id, CASE k WHEN 0 THEN lower(o_orderpriority) ELSE o_orderstatus END AS text, k AS block_no FROM orders, range(2) t(k)""")
def json_rewritten(spark, sf):
    d = _as_json(spark, sf)
    new = files.blocks(d).where("block_no = 0").withColumn("text", F.lower("text"))
    again = d.drop("content").join(files.rewritten(d, new).select("doc_id", "content"), "doc_id").select("doc_id", "ext", "content", "opts")
    return files.blocks(again).select("doc_id", F.col("block_no").cast("long").alias("block_no"), "text")


@query("""SELECT * FROM (VALUES ('csv', 3, 3), ('docx', 3, 3), ('html', 2, 2), ('json', 2, 2), ('po', 2, 2), ('srt', 1, 1), ('xliff', 2, 2), ('yaml', 2, 2)) v(ext, n, same)""")
def format_round_trips(spark, sf):
    """One document of each format, its blocks in capitals and back."""
    made = {
        "csv": b"a,b\nx y,1\nz w,q q\n", "docx": files.write_docx("# One\ntwo words\nthree"), "html": b"<h1>One</h1><script>no</script><p>two</p>", "json": json.dumps({"a": "x", "b": ["y", 1]}).encode(),
        "po": b'msgid ""\nmsgstr ""\n\nmsgid "a b"\nmsgstr ""\n\nmsgid "c"\nmsgstr "d"\n', "srt": b"1\n00:00:01,000 --> 00:00:02,000\nhi there\n\n2\n00:00:03,000 --> 00:00:04,000\n \n",
        "xliff": b'<xliff><file><trans-unit id="1"><source>a</source></trans-unit><trans-unit id="2"><source>b</source><target>c</target></trans-unit></file></xliff>', "yaml": b"a: one two\nb: 3\nc: 'four'\n",
    }
    rows = [(i, ext, bytearray(c), {}) for i, (ext, c) in enumerate(sorted(made.items()))]
    docs = spark.createDataFrame(rows, "doc_id long, ext string, content binary, opts map<string,string>")
    first = files.blocks(docs)
    done = files.rewritten(docs, first.withColumn("text", F.upper("text")))
    again = files.blocks(docs.drop("content").join(done.select("doc_id", "content"), "doc_id").select("doc_id", "ext", "content", "opts")).select("doc_id", "block_no", F.col("text").alias("after"))
    both = first.join(again, ["doc_id", "block_no"], "left").join(docs.select("doc_id", "ext"), "doc_id")
    return both.groupBy("ext").agg(F.count("*").cast("int").alias("n"), F.count_if(F.upper("text") == F.col("after")).cast("int").alias("same"))


def _run(stream, mode: str):
    """All that is there now, through a stream into files; each batch has a folder of its own, so one that runs again replaces itself."""
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/foliolake/{spark.sparkContext.applicationId}/stream-{uuid.uuid4().hex}"
    put = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True)
    put.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{base}/out/batch={n}")).start().awaitTermination()
    spark.createDataFrame([], stream.schema).write.parquet(f"{base}/out/batch=-1")
    return spark.read.schema(stream.schema).parquet(f"{base}/out").select(*stream.columns)


def _events(spark, sf):
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    e = spark.readStream.schema(TY.StructType([f for f in schema])).option("pathGlobFilter", "events.parquet").parquet(sf)
    return e.withColumn("ts", F.col("ts").cast("timestamp"))


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS value FROM events WHERE time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events) GROUP BY 1, 2")
def event_windows(spark, sf):
    got = _run(streams.activity(_events(spark, sf)), "append")
    return got.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("value", 6).alias("value"))


@query()
def job_states(spark, sf):
    kinds = F.array(*map(F.lit, ("enqueue", "start", "pause", "resume", "cancel", "finish", "fail")))
    e = _events(spark, sf).select(F.col("user_id").alias("job_id"), "ts", F.col("event_id").alias("seq"), F.get(kinds, (F.col("event_id") % 7).cast("int")).alias("event"))
    return _run(streams.job_states(e), "update")
