"""Settings, model files, exports and snapshots as tables."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import col, strip

# fixed values: the files that hold a model's weights, the first one wanted first, and the media types of exports
WEIGHTS = ("model.safetensors", "pytorch_model.bin")
MEDIA = {
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "odt": "application/vnd.oasis.opendocument.text",
    "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation", "csv": "text/csv", "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "html": "text/html", "htm": "text/html", "srt": "text/plain", "vtt": "text/plain", "json": "application/json", "yaml": "text/yaml", "yml": "text/yaml", "po": "text/plain",
    "xlf": "application/xml", "xliff": "application/xml", "pdf": "application/pdf", "md": "text/markdown", "txt": "text/plain",
}


def root_path(value) -> Column:
    """A path prefix with one slash in front and none behind; empty for none."""
    bare = F.btrim(strip(value), F.lit("/"))
    return F.when(bare != "", F.concat(F.lit("/"), bare)).otherwise(F.lit(""))


def setting(value, default) -> Column:
    """A setting, or its default where it isn't set; an empty one is set."""
    return F.coalesce(col(value), F.lit(default))


def cpu_limit(quota_line, cores) -> Column:
    """CPUs that a "quota period" line allows, between 1 and those there are; 0 for no line, no quota or a malformed one."""
    parts = F.split(strip(quota_line), r"\s+")
    quota, period = F.get(parts, F.lit(0)).try_cast("long"), F.get(parts, F.lit(1)).try_cast("long")
    n = F.ceil(quota / F.nullif(period, F.lit(0)))
    return F.coalesce(F.greatest(F.lit(1), F.least(col(cores).cast("long"), n)).cast("long") * F.when(quota.isNull() | period.isNull() | (period == 0), None).otherwise(1), F.lit(0)).cast("long")


def present(models: DataFrame, files: DataFrame) -> DataFrame:
    """The models (model_id, …) of which a file (model_id, name, size) of weights is there."""
    return models.join(files.where(F.col("name").isin(*WEIGHTS)).select("model_id"), "model_id", "left_semi")


def sizes(files: DataFrame) -> DataFrame:
    """(model_id, total, download): bytes of all files, and of the first kind of weights that has any."""
    first = [F.nullif(F.max(F.when(F.col("name") == w, F.coalesce("size", F.lit(0)))), F.lit(0)) for w in WEIGHTS]
    return files.groupBy("model_id").agg(F.coalesce(F.sum("size"), F.lit(0)).alias("total"), F.coalesce(*first, F.lit(0)).alias("download"))


def extension(x) -> Column:
    """An extension in small letters and digits, twelve at most."""
    return F.substring(F.regexp_replace(F.lower(col(x)), "[^a-z0-9]+", ""), 1, 12)


def valid_id(x) -> Column:
    """Whether an entry's id stays within its folder."""
    return ~(F.contains(col(x), F.lit("..")) | F.contains(col(x), F.lit("/")) | F.contains(col(x), F.lit("\\")))


def media_type(x) -> Column:
    table = F.create_map(*(F.lit(v) for kv in MEDIA.items() for v in kv))
    return F.coalesce(F.try_element_at(table, col(x)), F.lit("application/octet-stream"))


def export_path(item, ext) -> Column:
    return F.concat(col(item), F.lit(".export."), extension(ext))


def exports(wanted: DataFrame, kept: DataFrame, build) -> DataFrame:
    """(id, extension, path, media, content, built) of wanted (id, extension, …): those kept as they are, the others from ``build``.

    build: a column of ``wanted``. An export is made once: what is kept
    (path, content) is not made again. Ids that leave the folder are left out.
    """
    asked = wanted.where(valid_id("id")).withColumn("path", export_path("id", "extension"))
    there = kept.select("path", F.col("content").alias("__kept"), F.lit(True).alias("__there"))
    both = asked.join(there, "path", "left")
    made = F.when(F.col("__there"), F.col("__kept")).otherwise(build)
    return both.select("id", "extension", "path", media_type("extension").alias("media"), made.alias("content"), F.col("__there").isNull().alias("built"))


def snapshots(jobs: DataFrame) -> DataFrame:
    """Jobs as they are kept over a restart: without their results."""
    return jobs.drop("result")


def keep_snapshots(jobs: DataFrame, path: str) -> None:
    """Adds the jobs' snapshots to the folder; its writer shows them all at once or not at all."""
    snapshots(jobs).write.mode("append").json(path)


_ENTRY = "struct<id:string,created_at:string,source_extension:string,original_name:string>"


def history(entries: DataFrame, files: DataFrame) -> DataFrame:
    """Entries of a history folder, newest first.

    entries: (meta), a metadata file's JSON; files: (name, size) of the
    folder. Unreadable metadata, and such without an id, are left out. Each
    entry gets size_bytes, of its result, and has_source, whether its source
    is there.
    """
    read = entries.select(F.from_json("meta", _ENTRY, {"mode": "PERMISSIVE"}).alias("m")).where("m.id is not null").select("m.*")
    named = read.withColumn("result_name", F.concat("id", F.lit(".md"))).withColumn(
        "source_name", F.when(F.coalesce("source_extension", F.lit("")) != "", F.concat("id", F.lit(".source."), extension("source_extension"))),
    )
    result, source = files.select(F.col("name").alias("result_name"), F.col("size").alias("__size")), files.select(F.col("name").alias("source_name"), F.lit(True).alias("__source"))
    found = named.join(result, "result_name", "left").join(source, "source_name", "left")
    return found.select(
        "id", "created_at", "original_name", F.coalesce("__size", F.lit(0)).cast("long").alias("size_bytes"), F.coalesce("__source", F.lit(False)).alias("has_source"),
    ).orderBy(F.desc(F.coalesce("created_at", F.lit(""))), "id")


def history_folder(spark: SparkSession, path: str) -> DataFrame:
    """``history`` of a folder; files are listed with their sizes and only metadata is read."""
    listed = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"), F.col("length").alias("size"))
    meta = spark.read.text(f"{path}/*.json", wholetext=True).select(F.col("value").alias("meta"))
    return history(meta, listed)
