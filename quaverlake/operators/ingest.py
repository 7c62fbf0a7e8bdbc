"""Typing and validating raw rows, change tokens and drift of a source's status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S

LAST_SECOND = 253_402_300_799


def _text(name: str) -> Column:
    return S.blank_to_null(F.col(name))


def type_rows(raw: DataFrame, entity: str) -> DataFrame:
    """Typed rows of an entity, with the raw row kept as `raw` for validation. Missing columns count as null."""
    wanted = {
        "artists": {"source_id": _text("id"), "name": _text("artist"), "external_id": _text("extid")},
        "albums": {"source_id": _text("id"), "title": F.coalesce(_text("title"), _text("album")), "artist_id": _text("artist_id"), "year": S.to_positive_int(F.col("year")), "disc_count": S.to_positive_int(F.col("disccount")), "compilation": S.to_bool01(F.col("compilation")), "release_type": _text("release_type"), "artwork_track_id": _text("artwork_track_id"), "external_id": _text("extid")},
        "genres": {"source_id": _text("id"), "name": _text("genre")},
        "libraries": {"source_id": _text("id"), "name": _text("name")},
        "members": {"source_id": _text("id")},
        "tracks": {
            "source_id": _text("id"), "title": _text("title"), "url": _text("url"), "remote": S.to_bool01(F.col("remote")), "album_id": _text("album_id"), "year": S.to_positive_int(F.col("year")), "disc": S.to_positive_int(F.col("disc")), "track_number": S.to_positive_int(F.col("tracknum")),
            "duration": S.to_double(F.col("duration")), "file_size": S.to_long(F.col("filesize")), "added_at": S.to_unix_ts(F.col("addedTime")), "modified_at": S.to_unix_ts(F.col("modificationTime")), "compilation": S.to_bool01(F.col("compilation")), "artist_ids": S.split_ids(F.col("artist_ids")), "genre_ids": S.split_ids(F.col("genre_ids")), "rating": S.to_long(F.col("rating")).cast("int"), "play_count": S.to_long(F.col("playcount")),
        },
    }[entity]
    from ..sources.pages import FIELDS

    for name in FIELDS[entity]:
        if name not in raw.columns:
            raw = raw.withColumn(name, F.lit(None).cast("string"))
    return raw.select(*[c.alias(k) for k, c in wanted.items()], F.struct(*FIELDS[entity]).alias("raw"))


def validate_rows(typed: DataFrame, entity: str, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(good rows, rejects with their reasons). strict raises if there is a reject."""
    missing = lambda c: F.when(F.col(c).isNull(), f"{c} is missing")
    raw = lambda c: F.trim(F.col(f"raw.{c}"))
    negative = lambda c: F.when(raw(c).try_cast("double") < 0, f"{c} is negative")
    broken = lambda c: F.when((raw(c) != "") & ~F.lower(raw(c)).isin("0", "1", "true", "false"), f"{c} is no boolean")
    reasons = [missing("source_id")]
    if entity in ("artists", "genres", "libraries"):
        reasons.append(missing("name"))
    if entity in ("albums", "tracks"):
        reasons += [missing("title"), broken("compilation")]
    if entity == "tracks":
        reasons += [missing("url"), missing("remote"), F.when(F.col("rating") > 100, "rating is above 100"), *map(negative, ("rating", "playcount", "duration", "filesize"))]
    marked = typed.withColumn("reasons", F.array_compact(F.array(*reasons)))
    bad = marked.where(F.size("reasons") > 0)
    if strict and not bad.isEmpty():
        raise ValueError(f"{entity}: rows were rejected, the first for {bad.first()['reasons']}")
    return marked.where(F.size("reasons") == 0).drop("raw", "reasons"), bad


def change_token(uuid: Column, last_scan: Column, rescan: Column, failed: Column) -> Column:
    """["scan", uuid, time] as JSON; null while scanning, after a failed scan, without a uuid or a usable time."""
    time = S.to_long(last_scan)
    usable = S.blank_to_null(uuid).isNotNull() & time.between(1, LAST_SECOND) & (F.coalesce(F.trim(rescan.cast("string")), F.lit("")).isin("", "0")) & S.blank_to_null(failed).isNull()
    return F.when(usable, F.to_json(F.array(F.lit("scan"), F.trim(uuid), time.cast("string"))))


def needs_refresh(tokens: DataFrame, baseline: DataFrame) -> DataFrame:
    """(source, token, changed): without a token there is nothing to compare; without a baseline there is something to fetch."""
    return tokens.join(baseline.withColumnRenamed("token", "known"), "source", "left").select("source", "token", (F.col("token").isNotNull() & ~F.col("token").eqNullSafe(F.col("known"))).alias("changed"))


def status_drift(first: DataFrame, last: DataFrame, fields: list[str]) -> DataFrame:
    """(source, drifted fields) between two reads of a status."""
    both = first.alias("a").join(last.alias("b"), "source", "full_outer")
    changed = [F.when(~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}")), F.lit(f)) for f in fields]
    return both.select("source", F.array_compact(F.array(*changed)).alias("drifted"))


def total_mismatches(status: DataFrame, counts: DataFrame, names: list[str]) -> DataFrame:
    """(source, mismatches): how many totals of the status differ from what was read."""
    both = status.alias("a").join(counts.alias("b"), "source")
    return both.select("source", sum((F.when(~F.col(f"a.{n}").eqNullSafe(F.col(f"b.{n}")), 1).otherwise(0) for n in names), F.lit(0)).alias("mismatches"))
