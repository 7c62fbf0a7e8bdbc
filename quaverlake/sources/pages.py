"""Raw catalogue pages: JSON files {"id": .., "result": {"count": N, "<name>_loop": [..]}}, one page each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOOPS = {"artists": "artists_loop", "albums": "albums_loop", "genres": "genres_loop", "tracks": "titles_loop", "libraries": "folder_loop", "members": "titles_loop"}
FIELDS = {
    "artists": ["id", "artist", "extid"], "albums": ["id", "title", "album", "artist_id", "year", "disccount", "compilation", "release_type", "artwork_track_id", "extid"], "genres": ["id", "genre"],
    "tracks": ["id", "title", "url", "remote", "subtitle", "type", "extid", "album_id", "year", "disc", "disccount", "tracknum", "duration", "filesize", "samplerate", "addedTime", "modificationTime", "lastUpdated", "release_type", "compilation", "artwork_track_id", "work_id", "work", "performance", "grouping", "artist_ids", "genre_ids", "rating", "playcount"],
    "libraries": ["id", "name"], "members": ["id"],
}


def read_pages(spark: SparkSession, path: str, entity: str) -> DataFrame:
    """One row per entry: page (file), count that the page reports, pos and the entity's fields as text, whether they came as numbers or strings."""
    loop = LOOPS[entity]
    row = ", ".join(f"{f}: string" for f in FIELDS[entity])
    schema = f"result struct<count: string, {loop}: array<struct<{row}>>>"
    pages = spark.read.schema(schema).option("multiLine", True).json(path).select(F.input_file_name().alias("page"), F.col("result.count").try_cast("long").alias("count"), F.col(f"result.{loop}").alias("entries"))
    return pages.select("page", "count", F.posexplode_outer("entries").alias("pos", "e")).select("page", "count", "pos", "e.*")


def audit_pages(rows: DataFrame) -> DataFrame:
    """One row: pages, reported, found and status (ok, count changed, rows missing, too many rows or no pages) of what read_pages gives."""
    each = rows.groupBy("page").agg(F.min("count").alias("count"), F.count("pos").alias("n"))
    total = each.agg(F.count("*").alias("pages"), F.min("count").alias("reported"), F.max("count").alias("most"), F.coalesce(F.sum("n"), F.lit(0)).alias("found"))
    status = F.when(F.col("pages") == 0, "no pages").when(F.col("reported").isNull() | (F.col("reported") != F.col("most")), "count changed").when(F.col("found") < F.col("reported"), "rows missing").when(F.col("found") > F.col("reported"), "too many rows").otherwise("ok")
    return total.select("pages", "reported", "found", status.alias("status"))


def write_tables(tables: dict[str, DataFrame], path: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def read_tables(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}") for name in names}
