"""Reconciling an import with the stored tables: last row wins, upsert, deletion of the unseen, counts and references."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dedupe_last(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key; rows of equal order are decided by all their columns. A partial maximum precedes the shuffle."""
    rest = [c for c in df.columns if c != key]
    last = df.groupBy(key).agg(F.max(F.struct(order, *[c for c in rest if c != order])).alias("r"))
    return last.select(key, *[F.col(f"r.{c}").alias(c) for c in rest]).select(*df.columns)


def upsert(target: DataFrame, batch: DataFrame, key: str, refresh_id: str) -> DataFrame:
    """Batch rows replace those of their key and get the refresh id; all others stay. Batch keys are unique."""
    kept = target.join(batch.select(key), key, "left_anti")
    return kept.unionByName(batch.withColumn("seen_refresh_id", F.lit(refresh_id)))


def relation_rows(batch: DataFrame, owner: str, ids: str, target: str) -> DataFrame:
    """(owner, target, pos) of the array column `ids` of a batch, each id once in order."""
    return batch.select(F.col("source_id").alias(owner), F.posexplode(F.array_distinct(ids)).alias("pos", target))


def statistic_rows(batch: DataFrame, owner: str, statistics: str) -> DataFrame:
    """One row for each owner and source of the array column of structs `statistics` (source, ...), the last of a source counting."""
    each = batch.select(F.col("source_id").alias(owner), F.posexplode(statistics).alias("_pos", "_s")).groupBy(owner, F.col("_s.source").alias("_source")).agg(F.max_by("_s", "_pos").alias("_s"))
    return each.select(owner, "_s.*")


def replace_relations(links: DataFrame, batch: DataFrame, owner: str, ids: str, target: str) -> DataFrame:
    """Links (owner, target, pos) where those of the batch's owners are replaced by its array column `ids`, each id once in order."""
    fresh = relation_rows(batch, owner, ids, target)
    kept = links.join(batch.select(F.col("source_id").alias(owner)).distinct(), owner, "left_anti")
    return kept.select(owner, target, "pos").unionByName(fresh.select(owner, target, "pos"))


def referenced_artists(lookups: DataFrame, albums: DataFrame, track_artists: DataFrame, refresh_id: str) -> DataFrame:
    """Artist lookups that an album or a track of this refresh names."""
    named = albums.where(F.col("seen_refresh_id") == refresh_id).select(F.col("artist_id").alias("source_id"))
    named = named.union(track_artists.where(F.col("seen_refresh_id") == refresh_id).select("artist_id")).where("source_id is not null").distinct()
    return lookups.join(named, "source_id", "left_semi")


def upsert_memberships(members: DataFrame, batch: DataFrame, refresh_id: str) -> DataFrame:
    fresh = batch.select("library_id", "track_id").dropDuplicates().withColumn("seen_refresh_id", F.lit(refresh_id))
    return members.join(fresh, ["library_id", "track_id"], "left_anti").unionByName(fresh)


def delete_unseen(tables: dict[str, DataFrame], links: dict[str, DataFrame], refresh_id: str) -> dict[str, DataFrame]:
    """Tables without the rows that this refresh did not see, and links without those of deleted tracks."""
    kept = {name: df.where(F.col("seen_refresh_id") == refresh_id) for name, df in tables.items()}
    tracks = kept["tracks"].select(F.col("source_id").alias("track_id"))
    return kept | {name: df.join(tracks, "track_id", "left_semi") for name, df in links.items()}


def check_counts(tables: dict[str, DataFrame], members: DataFrame, reported: DataFrame, refresh_id: str) -> DataFrame:
    """(name, actual, expected, ok) of each table and each library's members, against reported (name, expected)."""
    rows = None
    for name, df in tables.items():
        one = df.where(F.col("seen_refresh_id") == refresh_id).agg(F.countDistinct("source_id").alias("actual")).select(F.lit(name).alias("name"), "actual")
        rows = one if rows is None else rows.unionByName(one)
    each = members.where(F.col("seen_refresh_id") == refresh_id).groupBy("library_id").agg(F.countDistinct("track_id").alias("actual"))
    rows = rows.unionByName(each.select(F.concat(F.lit("library:"), "library_id").alias("name"), "actual"))
    both = rows.join(reported, "name", "full_outer").select("name", F.coalesce("actual", F.lit(0)).alias("actual"), "expected")
    return both.withColumn("ok", F.col("actual").eqNullSafe(F.col("expected")))


def referential_counts(albums: DataFrame, tracks: DataFrame, artists: DataFrame, genres: DataFrame, track_artists: DataFrame, track_genres: DataFrame, members: DataFrame) -> DataFrame:
    """(warning, n): links whose target does not exist. A null link has no target to miss."""

    def missing(links: DataFrame, column: str, targets: DataFrame) -> DataFrame:
        return links.where(F.col(column).isNotNull()).join(targets.select(F.col("source_id").alias(column)), column, "left_anti").agg(F.count("*").alias("n"))

    to_artist = missing(albums, "artist_id", artists).union(missing(track_artists, "artist_id", artists)).agg(F.sum("n").alias("n"))
    named = {"track_album": missing(tracks, "album_id", albums), "artist": to_artist, "track_genre": missing(track_genres, "genre_id", genres), "member_track": missing(members, "track_id", tracks)}
    out = None
    for name, one in named.items():
        one = one.select(F.lit(name).alias("warning"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def catalogue_summary(tables: dict[str, DataFrame], warnings: DataFrame) -> DataFrame:
    """One row: the rows of each table and how many warnings count something."""
    out = warnings.agg(F.sum((F.col("n") > 0).cast("long")).alias("warnings"))
    for name, df in tables.items():
        out = out.crossJoin(df.agg(F.count("*").alias(name)))
    return out


def replace_snapshot(current: DataFrame | None, new: DataFrame, snapshot_id: str, limit: int = 10_000, available: bool = True) -> DataFrame:
    """current (id, title, snapshot_id, all snapshots that are stored) with the rows (id, title) of a new snapshot staged beside them, after checks; a failed check raises and the
    current rows stay. The new rows count once the state names their snapshot (activate_snapshot)."""
    checks = new.agg(
        F.count("*").alias("n"), F.countDistinct("id").alias("ids"), F.count_if(F.coalesce(F.trim("id"), F.lit("")) == "").alias("blank"),
        F.count_if((F.length("id") > 256) | F.col("title").isNull() | (F.length("title") > 1024)).alias("long"),
    ).first()
    wrong = "unavailable but not empty" if not available and checks.n else "too many rows" if checks.n > limit else "blank ids" if checks.blank else "repeated ids" if checks.ids < checks.n else "too long" if checks.long else ""
    if not wrong and current is not None and not current.where(F.col("snapshot_id") == snapshot_id).isEmpty():
        wrong = "the snapshot is there already"
    if wrong:
        raise ValueError(wrong)
    staged = new.select("id", "title", F.lit(snapshot_id).alias("snapshot_id"))
    return staged if current is None else current.select("id", "title", "snapshot_id").unionByName(staged)


def activate_snapshot(rows: DataFrame, snapshot_id: str) -> tuple[DataFrame, DataFrame]:
    """(rows, state): the one-row state that names the snapshot, and the rows without those of inactive snapshots."""
    state = rows.sparkSession.createDataFrame([(snapshot_id,)], "active_snapshot_id string")
    return rows.where(F.col("snapshot_id") == snapshot_id), state


def active_rows(rows: DataFrame, state: DataFrame) -> DataFrame:
    """Rows of the snapshot that the one-row state names."""
    return rows.join(F.broadcast(state.select(F.col("active_snapshot_id").alias("snapshot_id")).limit(1)), "snapshot_id", "left_semi")
