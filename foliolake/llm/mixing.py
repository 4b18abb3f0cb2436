"""Mixing sources to target weights by Sainte-Lague apportionment.

Sources share a budget of words by weight, none above a multiple of its own
size. The documents of a source are dealt by a seeded hash to shards of
bounded size; a shard, its documents in order of the hash, is a stream cut in
blocks of equal size. Blocks go first to sources and then, within a source,
to shards by highest quotients, so that each shard has a whole number of
blocks to give; evenly spaced blocks from a seeded start are taken, whole
passes first.

Highest quotients are found without listing all seats: a divisor that
certainly gives too few seats settles most of them, and only the next seats
of each party, as many as its quotients can win, are ranked.

Inputs: null and empty texts have size 0 and are never taken; very long texts
reach over as many blocks as they fill; a null source is a source; a null
doc_id counts as the empty id; repeated rows count each, and those that tie
in hash and size are alike; quotients that tie go to the source or shard that
comes first; an empty table gives an empty result. Columns named ``__fl_...``
are the operator's; others, whatever their names, pass through.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ._common import WORD, id_text, stored, table

SEED = "foliolake"
WEIGHTS, BUDGET, LIMIT = (3, 1, 2), 1.5, 2
#: Words of a block, and of a shard about.
BLOCK_WORDS, SHARD_WORDS = 32, 1 << 20
#: Tasks over which the documents of one source are dealt.
SALTS = 64


def _key() -> Column:
    return F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, limit: int = LIMIT) -> DataFrame:
    """(source, source_size, target): shares by weight, those above their limit cut and the excess shared again.

    In order of limit over weight the sources that are cut come first, so the
    common level is that of the first source which isn't. A row for each
    source; windows without partitions run over those alone.
    """
    one = W.partitionBy(F.lit(0))
    by_name = one.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    ratio = F.col("cap") / F.col("w")
    before = one.orderBy("ratio", F.col("source").isNull(), "source").rowsBetween(W.unboundedPreceding, -1)
    level = (F.lit(budget) * F.sum("source_size").over(one) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / (F.sum("w").over(one) - F.coalesce(F.sum("w").over(before), F.lit(0)))
    levels = sizes.withColumn("w", weight).withColumn("cap", F.col("source_size") * limit).withColumn("ratio", ratio).withColumn("level", level)
    shared = F.min_by(F.when(F.col("level") < F.col("ratio"), F.col("level")), F.when(F.col("level") < F.col("ratio"), F.struct("ratio", F.col("source").isNull(), "source"))).over(one)
    least = F.least(F.col("cap").cast("double"), F.col("w") * F.col("shared"))
    return levels.withColumn("shared", shared).select("source", "source_size", F.coalesce(least, F.col("cap").cast("double")).alias("target"))


def apportioned(parties: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    """Adds ``won`` to rows with votes (double), cap and seats (the same throughout a group).

    Sainte-Lague: seat s + 1 of a party has the quotient votes / (2 s + 1),
    and the ``seats`` largest quotients win, ties by ``order``; no party wins
    more than ``cap``.
    """
    all_ = W.partitionBy(*group)
    n, v = F.count("*").over(all_), F.sum("votes").over(all_)
    few = F.greatest(F.col("seats") - n / 2, F.lit(0.0))
    sure = F.least(F.col("cap"), F.floor(F.when(v > 0, F.col("votes") * few / v).otherwise(0.0) + 0.5))
    begun = parties.withColumn("sure", sure).withColumn("left", F.col("seats") - F.sum("sure").over(all_))
    quotient = F.when(F.col("sure") < F.col("cap"), F.col("votes") / (2 * F.col("sure") + 1))
    ranked = begun.withColumn("q", quotient).withColumn("nth", F.row_number().over(all_.orderBy(F.desc_nulls_last("q"), *order)))
    # the quotient that the last seat needs at least: there are that many first quotients as large
    need = F.max(F.when(F.col("nth") == F.col("left"), F.col("q"))).over(all_)
    may = F.when(need > 0, F.floor((F.col("votes") / need + 1) / 2) - F.col("sure") + 1).otherwise(F.col("left"))
    most = F.least(F.col("cap") - F.col("sure"), F.greatest(may, F.lit(0)), F.col("left"))
    bids = ranked.withColumn("need", need).withColumn("most", F.greatest(most, F.lit(0)).cast("long"))
    bids = bids.withColumn("extra", F.explode(F.sequence(F.lit(0).cast("long"), "most")))
    # bid 0 keeps a party without further seats in the table, and wins nothing
    q = F.when(F.col("extra") > 0, F.col("votes") / (2 * (F.col("sure") + F.col("extra")) - 1))
    place = F.row_number().over(all_.orderBy(F.desc_nulls_last("q"), *order))
    wins = bids.withColumn("q", q).withColumn("place", place).withColumn("win", ((F.col("extra") > 0) & (F.col("place") <= F.col("left"))).cast("long"))
    keep = [F.col(c) for c in parties.columns]
    return wins.withColumn("won", F.col("sure") + F.sum("win").over(W.partitionBy(*group, *[c for c in ("src", "shard") if c in parties.columns]))).where("extra = 0").select(*keep, F.col("won").cast("long").alias("won"))


def sized(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """``docs`` with __fl_size in words, __fl_src, a key of the source, and __fl_h, the seeded hash."""
    return docs.withColumns({
        "__fl_size": F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long"), "__fl_src": _key(), "__fl_h": F.md5(F.concat(F.lit(seed + "/"), id_text())),
    })


def figures(marks: DataFrame, shard: int = SHARD_WORDS) -> DataFrame:
    """(source, src, source_size, target, n_shards) of each source of (source, __fl_src, __fl_size)."""
    by = marks.groupBy("source", F.col("__fl_src").alias("src")).agg(F.sum("__fl_size").alias("source_size"))
    return targets(by.select("source", "source_size")).withColumn("src", _key()).withColumn("n_shards", F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard)).cast("long"))


def dealt(rows: DataFrame, goal: DataFrame) -> DataFrame:
    """``rows`` of ``sized`` with __fl_shard and the source_size and target of their source.

    A source is dealt over SALTS tasks by the hash of its documents, so that
    one that holds a third of all rows isn't one task's.
    """
    salted = goal.select(F.col("src").alias("__fl_s1"), F.col("n_shards").alias("__fl_n"), F.col("source_size").alias("__fl_source_size"), F.col("target").alias("__fl_target"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("__fl_s0"))
    found = rows.withColumn("__fl_salt", F.pmod(F.xxhash64("__fl_h"), F.lit(SALTS)).cast("int")).join(salted, (F.col("__fl_src") == F.col("__fl_s1")) & (F.col("__fl_salt") == F.col("__fl_s0")))
    return found.withColumn("__fl_shard", _shard(F.col("__fl_h"), F.col("__fl_n"))).drop("__fl_s0", "__fl_s1", "__fl_salt", "__fl_n")


def quotas(rows: DataFrame, goal: DataFrame, block: int = BLOCK_WORDS) -> DataFrame:
    """(src, shard, words, blocks, quota) of each shard of each source; rows: of ``dealt``."""
    shards = rows.groupBy(F.col("__fl_src").alias("src"), F.col("__fl_shard").alias("shard")).agg(F.sum("__fl_size").alias("words")).where("words > 0").withColumn("blocks", F.greatest(F.lit(1), F.round(F.col("words") / block)).cast("long"))
    whole = shards.groupBy("src").agg(F.sum("blocks").alias("source_blocks")).join(goal, "src").where("source_size > 0")
    ideal = F.col("target") * F.col("source_blocks") / F.col("source_size")
    first = whole.withColumn("votes", ideal).withColumn("cap", F.col("source_blocks") * LIMIT).withColumn("all", F.lit(0))
    first = first.withColumn("seats", F.round(F.sum("votes").over(W.partitionBy("all"))).cast("long"))
    won = apportioned(first, ["all"], [F.col("source").isNull(), F.col("source")]).select("src", F.col("won").alias("seats"))
    second = shards.join(won, "src").withColumn("votes", F.col("words").cast("double")).withColumn("cap", F.col("blocks") * LIMIT)
    return apportioned(second, ["src"], [F.col("shard")]).select("src", "shard", "words", "blocks", F.col("won").alias("quota"))


def _shard(h: Column, n: Column) -> Column:
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("long") % n


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def planned(rows: DataFrame, shards: DataFrame, seed: str = SEED) -> DataFrame:
    """Rows of ``dealt`` that have words, with __fl_plan; shards: of ``quotas``.

    __fl_plan: array of (from, n, times): words from a position (from 0),
    how many, and how often they are taken, one for each block that the
    document reaches into.
    """
    given = shards.select(F.col("src").alias("__fl_s2"), F.col("shard").alias("__fl_s3"), F.col("words").alias("__fl_w"), F.col("blocks").alias("__fl_p"), F.col("quota").alias("__fl_q"))
    rows = rows.where("__fl_size > 0").join(given, (F.col("__fl_src") == F.col("__fl_s2")) & (F.col("__fl_shard") == F.col("__fl_s3")))
    stream = W.partitionBy("__fl_src", "__fl_shard").orderBy("__fl_h", "__fl_size").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("__fl_a", F.sum("__fl_size").over(stream) - F.col("__fl_size"))
    a, w, p, q, size = (F.col(f"__fl_{x}") for x in ("a", "w", "p", "q", "size"))
    at = F.conv(F.substring(F.md5(F.concat(F.lit(seed + "/start/"), "__fl_src", F.lit("/"), F.col("__fl_shard").cast("string"))), 1, 8), 16, 10).cast("long") % p
    passes, rest = _div(q, p), q % p

    def block_of(x: Column) -> Column:
        return _div((x + 1) * p - 1, w)

    def one(k: Column) -> Column:
        lo, hi = F.greatest(_div(k * w, p), a), F.least(_div((k + 1) * w, p), a + size)
        times = passes + _div((k + at + 1) * rest, p) - _div((k + at) * rest, p)
        return F.struct((lo - a).alias("from"), (hi - lo).alias("n"), times.alias("times"))

    return rows.withColumn("__fl_plan", F.transform(F.sequence(block_of(a), block_of(a + size - 1)), one))


def _taken() -> Column:
    return F.coalesce(F.aggregate("__fl_plan", F.lit(0).cast("long"), lambda s, x: s + x["n"] * x["times"]), F.lit(0).cast("long"))


def mixture(docs: DataFrame, seed: str = SEED, block: int = BLOCK_WORDS, shard: int = SHARD_WORDS) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of each row of ``docs``.

    Sizes are counted once and written; all else works on narrow rows.
    """
    marks, _ = stored(sized(docs.select("doc_id", "source", "text"), seed).drop("text"), "sizes")
    goal, _ = stored(figures(marks, shard), "figures")
    rows = dealt(marks, goal)
    plan = planned(rows, quotas(rows, goal, block), seed)
    out = ["doc_id", F.col("__fl_size").alias("size"), F.col("__fl_source_size").alias("source_size"), F.col("__fl_target").alias("target")]
    return plan.select(*out, _taken().alias("taken")).union(rows.where("__fl_size = 0").select(*out, F.lit(0).cast("long").alias("taken")))


def mixed(docs: DataFrame, seed: str = SEED, block: int = BLOCK_WORDS, shard: int = SHARD_WORDS) -> DataFrame:
    """The rows that the mix takes, with the columns of ``docs``.

    A document's first row has the words taken once at least, a second row
    those taken twice; white space after a word stays with it. Text is the
    original where all words are taken. n_chars follows the text.
    """
    marks, _ = stored(sized(docs.select("doc_id", "source", "text"), seed).drop("doc_id", "text"), "sizes")
    goal, _ = stored(figures(marks, shard), "figures")
    shards, _ = stored(quotas(dealt(marks, goal), goal, block), "quotas")
    rows = planned(dealt(sized(docs, seed), goal), shards, seed)
    most = F.array_max(F.transform("__fl_plan", lambda x: x["times"]))
    rows = rows.where(most > 0).withColumn("__fl_pass", F.explode(F.sequence(F.lit(1).cast("long"), most)))
    whole = F.forall("__fl_plan", lambda x: x["times"] >= F.col("__fl_pass"))
    words = F.regexp_extract_all("text", F.lit(f"({WORD}[\\x20\\x09-\\x0D]*)"), F.lit(1))

    def cut(w: Column) -> Column:
        blocks = F.filter("__fl_plan", lambda x: x["times"] >= F.col("__fl_pass"))
        return F.array_join(F.flatten(F.transform(blocks, lambda x: F.slice(w, (x["from"] + 1).cast("int"), x["n"].cast("int")))), "")

    text = F.when(whole, F.col("text")).otherwise(F.get(F.transform(F.array(words), cut), F.lit(0)))
    out = rows.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query op7: the mix of all documents."""
    return mixture(table(spark, sf_dir, "documents").withColumn("doc_id", F.col("doc_id").cast("long")))


SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce('s' || source, 'n') AS src, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size, md5('{SEED}/' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), s AS (SELECT src, source, sum(size)::BIGINT AS source_size FROM d GROUP BY ALL),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w, 2 * source_size AS cap FROM s),
l AS (
  SELECT *, cap / w AS ratio,
    (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
    / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS level
  FROM w
), lev AS (SELECT level FROM l WHERE level < ratio ORDER BY ratio, source NULLS LAST LIMIT 1),
t AS (
  SELECT src, source, source_size, greatest(1, ceil(source_size / {SHARD_WORDS}))::BIGINT AS n_shards,
    coalesce(least(cap::DOUBLE, w * (SELECT level FROM lev)), cap::DOUBLE) AS target FROM l
), dd AS (SELECT d.*, ('0x' || substr(h, 1, 8))::UBIGINT::BIGINT % n_shards AS shard FROM d JOIN t USING (src)),
sh AS (SELECT src, shard, sum(size)::BIGINT AS words, greatest(1, round(sum(size) / {BLOCK_WORDS}))::BIGINT AS blocks FROM dd GROUP BY ALL HAVING sum(size) > 0),
f AS (SELECT t.*, sb, target * sb / source_size AS votes FROM t JOIN (SELECT src, sum(blocks)::BIGINT AS sb FROM sh GROUP BY 1) USING (src)),
m1 AS (SELECT round(sum(votes))::BIGINT AS seats FROM f),
c1 AS (SELECT src, row_number() OVER (ORDER BY votes / (2 * k + 1) DESC, source NULLS LAST) AS rank FROM f, unnest(range(0, 2 * sb)) AS u(k)),
won1 AS (SELECT src, count(*) AS seats FROM c1, m1 WHERE rank <= m1.seats GROUP BY 1),
c2 AS (SELECT src, shard, row_number() OVER (PARTITION BY src ORDER BY words::DOUBLE / (2 * k + 1) DESC, shard) AS rank FROM sh, unnest(range(0, 2 * blocks)) AS u(k)),
won2 AS (SELECT src, shard, count(*) AS quota FROM c2 JOIN won1 USING (src) WHERE rank <= seats GROUP BY ALL),
p AS (
  SELECT src, shard, words, blocks, coalesce(quota, 0)::BIGINT AS quota,
    ('0x' || substr(md5('{SEED}/start/' || src || '/' || shard), 1, 8))::UBIGINT::BIGINT % blocks AS start
  FROM sh LEFT JOIN won2 USING (src, shard)
), b AS (
  SELECT src, shard, k * words // blocks AS lo, (k + 1) * words // blocks AS hi,
    quota // blocks + ((k + start + 1) * (quota % blocks)) // blocks - ((k + start) * (quota % blocks)) // blocks AS times
  FROM p, unnest(range(0, blocks)) AS u(k)
), o AS (
  SELECT *, (sum(size) OVER (PARTITION BY src, shard ORDER BY h, size ROWS UNBOUNDED PRECEDING))::BIGINT - size AS a, row_number() OVER () AS rid FROM dd WHERE size > 0
), g AS (
  SELECT rid, sum((least(hi, a + size) - greatest(lo, a)) * times)::BIGINT AS taken FROM o JOIN b ON o.src = b.src AND o.shard = b.shard AND lo < a + size AND hi > a GROUP BY rid
)
SELECT doc_id, size, source_size, target, taken FROM (
  SELECT o.doc_id, o.src, o.size, g.taken FROM o JOIN g USING (rid) UNION ALL SELECT doc_id, src, size, 0 FROM dd WHERE size = 0
) JOIN t USING (src)
"""
