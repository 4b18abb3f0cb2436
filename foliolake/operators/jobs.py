"""Job queue and history as tables."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.lists import percent_done, seconds_left

TERMINAL = ("complete", "failed", "cancelled")


def _when(*cols: str):
    """The first time that is set; zero counts as unset."""
    return F.coalesce(*(F.nullif(F.col(c), F.lit(0)) for c in cols), F.lit(0))


def queue_positions(jobs: DataFrame) -> DataFrame:
    """(job_id, position) of queued jobs, from 1, by the first of their times, then id.

    One queue is one order, so its numbers come from one window over the
    queued rows alone, which a service bounds.
    """
    queued = jobs.where("status = 'queued'").withColumn("at", _when("queued_at", "started_at", "finished_at"))
    return queued.select("job_id", F.row_number().over(W.partitionBy(F.lit(0)).orderBy("at", "job_id")).alias("position"))


def progress(jobs: DataFrame) -> DataFrame:
    """(job_id, percent, eta) from current, total, status, started_at and now."""
    return jobs.select("job_id", percent_done("current", "total", "status").alias("percent"), seconds_left("current", "total", "started_at", "now").alias("eta"))


def listing(jobs: DataFrame, *hidden: str) -> DataFrame:
    """Jobs in order of their times, without payload columns, with queue positions."""
    return jobs.drop("result", "payload", *hidden).join(queue_positions(jobs), "job_id", "left").withColumn("at", _when("queued_at", "started_at", "finished_at")).orderBy("at", "job_id").drop("at")


def next_job(jobs: DataFrame, active: DataFrame) -> DataFrame:
    """The earliest queued job that isn't cancelled or active; no row or one."""
    ready = jobs.where("status = 'queued' and not cancel_requested").join(active.select("job_id"), "job_id", "left_anti")
    return ready.orderBy(_when("queued_at", "started_at", "finished_at"), "job_id").limit(1)


def recovered(snapshots: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """The last snapshot of each job after a restart: running jobs queue again, those of unknown kind or asked to stop end."""
    nth = F.row_number().over(W.partitionBy("job_id").orderBy(F.desc("ts"), F.desc("status")))
    last = snapshots.withColumn("nth", nth).where("nth = 1").drop("nth")
    stopped = F.col("cancel_requested") & F.col("status").isin("running", "queued")
    status = F.when(stopped, F.lit("cancelled")).when(F.col("status").isin("running", "queued") & ~F.col("kind").isin(*kinds), F.lit("failed")).when(F.col("status") == "running", F.lit("queued")).otherwise(F.col("status"))
    return last.withColumn("started_at", F.when(F.col("status") == "running", F.lit(None)).otherwise(F.col("started_at"))).withColumn("status", status)


def with_results(jobs: DataFrame, history: DataFrame) -> DataFrame:
    """Complete jobs without a result get that of their history entry; positions are added."""
    found = history.select(F.col("id").alias("history_id"), F.col("result").alias("__r"))
    got = jobs.join(found, "history_id", "left").withColumn("result", F.when((F.col("status") == "complete") & F.col("result").isNull(), F.col("__r")).otherwise(F.col("result"))).drop("__r")
    return got.join(queue_positions(jobs), "job_id", "left")


def unexpired_jobs(jobs: DataFrame, now: float, keep: float = 3600.0) -> DataFrame:
    """Without jobs that ended more than ``keep`` seconds ago."""
    ended = F.coalesce("finished_at", "queued_at", F.lit(0))
    return jobs.where(~(F.col("status").isin(*TERMINAL) & (ended < now - keep)))


def unexpired_files(files: DataFrame, now, hours: float | None) -> DataFrame:
    """Without the files of entries older than the window; files are matched by their name up to the first dot.

    files: (name, modified, is_entry). A file without an entry goes by its
    own age. No window keeps all.
    """
    if hours is None:
        return files
    base = F.substring_index("name", ".", 1)
    old = F.col("modified") < F.lit(now) - F.expr(f"make_dt_interval(0, {int(hours)}, 0, 0)")
    keyed = files.withColumns({"__base": base, "__old": old})
    entries = keyed.where("is_entry").groupBy("__base").agg(F.max("__old").alias("__gone"))
    got = keyed.join(entries, "__base", "left")
    return got.where(~F.coalesce("__gone", "__old")).select(*files.columns)


def newest(history: DataFrame, keep: int) -> DataFrame:
    """The ``keep`` newest entries."""
    return history.orderBy(F.desc("created_at"), F.desc("id")).limit(keep)


def filtered(history: DataFrame, needle: str, page: int = 0, size: int = 5) -> DataFrame:
    """A page of the entries whose name or languages hold ``needle``."""
    hit = F.contains(F.lower(F.concat_ws(" ", "original_name", "source", "target")), F.lit(needle.lower()))
    return history.where(hit).orderBy(F.desc("created_at"), F.desc("id")).offset(page * size).limit(size)


def entry_id(created, name, token):
    """date-name-token, the name reduced to safe characters."""
    safe = F.substring(F.trim(F.regexp_replace(name, r"[^A-Za-z0-9._-]+", "-")), 1, 80)
    return F.concat_ws("-", F.date_format(created, "yyyyMMdd"), safe, F.substring(token, 1, 8))


def download_name(name, created, target, extension: str):
    """stem_date_time_lang.ext in ASCII."""
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    ascii_ = F.regexp_replace(F.translate(stem, "äöüÄÖÜéèêàçñáíóú", "aouAOUeeeacnaiou"), r"[^A-Za-z0-9_-]+", "_")
    return F.concat(F.concat_ws("_", ascii_, F.date_format(created, "yyyy-MM-dd_HHmm"), F.substring(target, 1, 3)), F.lit("." + extension))
