"""Reading and writing the library's tables and files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaiq.functions import calendar
from mosaiq.operators.history import latest_per

#: The wire form of an asset; readers take it as it is and never infer.
ASSET_SCHEMA = """
    id string, type string, original_file_name string, file_created_at timestamp, file_modified_at timestamp, updated_at timestamp,
    local_date_time timestamp, is_favorite boolean, is_archived boolean, is_trashed boolean, duration string, width int, height int,
    exif struct<make:string,model:string,latitude:double,longitude:double,city:string,state:string,country:string,file_size_in_byte:bigint>,
    people array<struct<id:string,name:string>>, checksum string, live_photo_video_id string"""


def read_assets(spark: SparkSession, path: str, form: str = "json") -> DataFrame:
    """Assets with unknown types as OTHER and unknown sizes as 0."""
    raw = spark.read.schema(ASSET_SCHEMA).format(form).load(path)
    kind = F.when(F.col("type").isin("IMAGE", "VIDEO", "AUDIO", "OTHER"), F.col("type")).otherwise("OTHER")
    return raw.withColumns({"type": kind, "width": F.coalesce("width", F.lit(0)), "height": F.coalesce("height", F.lit(0))})


def search(
    assets: DataFrame, kind: str | None = None, person: str | None = None, persons: list[str] | None = None, every: bool = False, taken_from: Column | None = None, taken_to: Column | None = None, updated_after: Column | None = None
) -> DataFrame:
    """Rows by type, one person, any or every one of several, days of capture (both whole) and last change, in order of capture."""
    found = assets
    ids = F.transform("people", lambda p: p["id"])
    if kind:
        found = found.where(F.col("type") == kind)
    if person:
        found = found.where(F.array_contains(ids, person))
    if persons:
        wanted = F.array(*[F.lit(p) for p in persons])
        found = found.where(F.size(F.array_except(wanted, ids)) == 0 if every else F.arrays_overlap(ids, wanted))
    if taken_from is not None:
        found = found.where(F.col("file_created_at") >= calendar.day_start(taken_from))
    if taken_to is not None:
        found = found.where(F.col("file_created_at") <= calendar.day_end(taken_to))
    if updated_after is not None:
        found = found.where(F.col("updated_at") > updated_after)
    return found.orderBy("file_created_at", "id")


def stills(assets: DataFrame) -> DataFrame:
    return assets.where("type = 'IMAGE' and live_photo_video_id is null")


def live_photos(assets: DataFrame) -> DataFrame:
    return assets.where("type = 'IMAGE' and live_photo_video_id is not null")


def without_live_components(assets: DataFrame) -> DataFrame:
    """Without the videos that belong to live photos."""
    parts = live_photos(assets).select(F.col("live_photo_video_id").alias("id"))
    return assets.join(parts, "id", "left_anti")


def newest(assets: DataFrame, most: int) -> DataFrame:
    return assets.orderBy(F.desc("file_created_at"), "id").limit(most)


def changed_since(assets: DataFrame, snapshot_time: Column) -> bool:
    """Whether a row is newer than a snapshot."""
    return bool(assets.where(F.col("updated_at") > snapshot_time).limit(1).count())


def write_snapshot(df: DataFrame, path: str, fingerprint: str) -> None:
    """A version of a table under its content's fingerprint."""
    df.write.mode("overwrite").parquet(f"{path}/{fingerprint}")


def read_snapshot(spark: SparkSession, path: str, fingerprint: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{path}/{fingerprint}")


def export_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def import_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def inventory(spark: SparkSession, path: str, by_depth: int = 1) -> DataFrame:
    """Files and bytes per folder below path; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    base = path.rstrip("/").split(":")[-1]
    below = F.split(F.regexp_replace(F.substring_index("path", base, -1), "^/", ""), "/")
    folder = F.array_join(F.slice(below, 1, by_depth), "/")
    return files.groupBy(folder.alias("folder")).agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"))


def sidecar(df: DataFrame) -> DataFrame:
    """One JSON object a row, nulls left out."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))


def bucket(assets: DataFrame, key: str, size: str = "month") -> DataFrame:
    """The rows of one bucket of a timeline: a month (yyyy-MM) or a day (yyyy-MM-dd)."""
    form = {"month": "yyyy-MM", "day": "yyyy-MM-dd"}[size]
    return assets.where(F.date_format("file_created_at", form) == key)


def people(assets: DataFrame) -> DataFrame:
    """person, name and n: how many rows each person is on."""
    return assets.select(F.explode("people").alias("p")).groupBy(F.col("p.id").alias("person"), F.col("p.name").alias("name")).agg(F.count(F.lit(1)).alias("n"))


def usable_snapshots(manifest: DataFrame, fingerprint: str, now: Column, first: Column, last: Column, tie: str, days: int = 7) -> DataFrame:
    """Of each fingerprint the newest of the snapshots (stored, lo, hi) that aren't too old and hold the whole range."""
    fresh = manifest.where(F.datediff(now, "stored").between(0, days) & (F.col("lo") <= first) & (F.col("hi") >= last))
    return latest_per(fresh, [fingerprint], [F.desc("stored"), F.col(tie)])


def rows_in_turn(df: DataFrame):
    """Rows one by one, a partition at a time, for callers that stop early."""
    return df.toLocalIterator(prefetchPartitions=True)
