"""The observation log: recording, selections, browsing, summaries, reviews and the export of evaluation cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .paging import page_after


def _observed(meta: DataFrame) -> DataFrame:
    return meta.withColumn("observation_id", F.sha2(F.concat_ws("|", "query_id", F.col("created_at").cast("string")), 256))


def record_observations(results: DataFrame, meta: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(observations, candidates) of search results (query_id, key, kind, title, place, native_rating) and meta (query_id, created_at, query, status).

    Ids are hashes, so a repeated run gives the same. Only tracks have a public rating, native / 20."""
    ids = _observed(meta)
    observations = ids.select("observation_id", "created_at", "query", "status")
    rows = results.join(ids.select("query_id", "observation_id"), "query_id")
    candidates = rows.select("observation_id", F.sha2(F.concat_ws("|", "observation_id", "key"), 256).alias("correlation_id"), F.col("place").alias("position"), "kind", "title", F.when(F.col("kind") == "track", (F.col("native_rating") / 20).cast("decimal(5,2)")).alias("rating"), F.lit(None).cast("timestamp").alias("selected_at"))
    return observations, candidates


def record_requests(requests: DataFrame, meta: DataFrame) -> DataFrame:
    """(observation_id, sequence, kind, status, duration_ms) of the requests (query_id, started_at, kind, status, duration_ms) that searches made; the sequence counts from 1 in the order of
    their starts. Durations below 0 and null ones are 0."""
    rows = requests.join(_observed(meta).select("query_id", "observation_id"), "query_id")
    order = Window.partitionBy("observation_id").orderBy("started_at", "kind", "status", "duration_ms")
    return rows.select("observation_id", F.row_number().over(order).alias("sequence"), "kind", "status", F.greatest(F.coalesce(F.col("duration_ms").cast("double"), F.lit(0.0)), F.lit(0.0)).alias("duration_ms"))


def record(results: DataFrame, requests: DataFrame, meta: DataFrame) -> dict[str, DataFrame]:
    """The three linked tables of a log of searches: observations, candidates and requests. Rows of queries that meta does not name are left out."""
    observations, candidates = record_observations(results, meta)
    return {"observations": observations, "candidates": candidates, "requests": record_requests(requests, meta)}


def recording_faults(tables: dict[str, DataFrame]) -> DataFrame:
    """(fault, n) of recorded tables, all 0 in a sound log: repeated ids, links to no observation, and gaps in the sequences of requests."""
    repeated = lambda name, key: tables[name].groupBy(key).count().where("count > 1").agg(F.count("*").alias("n"))
    orphans = lambda name: tables[name].join(tables["observations"], "observation_id", "left_anti").agg(F.count("*").alias("n"))
    gaps = tables["requests"].groupBy("observation_id").agg(F.max("sequence").alias("last"), F.count("*").alias("all"), F.countDistinct("sequence").alias("several"))
    faults = {
        "repeated observations": repeated("observations", "observation_id"), "repeated candidates": repeated("candidates", "correlation_id"),
        "candidates without an observation": orphans("candidates"), "requests without an observation": orphans("requests"),
        "sequences with gaps": gaps.where("last <> all or several <> all").agg(F.count("*").alias("n")),
    }
    out = None
    for name, rows in faults.items():
        one = rows.select(F.lit(name).alias("fault"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def retrieval_durations(requests: DataFrame, observations: DataFrame) -> DataFrame:
    """(observation_id, retrieval_ms, processing_ms). Index and provider requests run side by side with the playlist search, expansions one after
    another, name-free requests side by side. requests: observation_id, kind (index, provider, expansion, name_free), duration_ms; observations: playlist_ms, total_ms."""
    of = lambda *kinds: F.when(F.col("kind").isin(*kinds), F.col("duration_ms"))
    each = requests.groupBy("observation_id").agg(F.max(of("index", "provider")).alias("a"), F.sum(of("expansion")).alias("b"), F.max(of("name_free")).alias("c"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    out = observations.join(each, "observation_id", "left").withColumn("retrieval_ms", F.greatest(zero("a"), zero("playlist_ms")) + zero("b") + zero("c"))
    return out.select("observation_id", "retrieval_ms", F.greatest(F.lit(0), F.col("total_ms") - F.col("retrieval_ms")).alias("processing_ms"))


def mark_selected(candidates: DataFrame, selections: DataFrame) -> DataFrame:
    """Sets selected_at of candidates that a selection names and that have none; the earliest selection counts."""
    first = selections.groupBy("correlation_id").agg(F.min("selected_at").alias("_at"))
    return candidates.join(first, "correlation_id", "left").withColumn("selected_at", F.coalesce("selected_at", "_at")).drop("_at").select(*candidates.columns)


def summarise_observations(observations: DataFrame, candidates: DataFrame, reviews: DataFrame) -> DataFrame:
    each = candidates.groupBy("observation_id").agg(F.count("*").alias("candidates"), F.min(F.when(F.col("selected_at").isNotNull(), F.col("position"))).alias("selected_position"))
    review = reviews.select("observation_id", "review_class", "included")
    out = observations.join(each, "observation_id", "left").join(review, "observation_id", "left")
    return out.withColumns({"candidates": F.coalesce("candidates", F.lit(0)), "included": F.coalesce("included", F.lit(False))})


def observation_filter(text: str | None = None, reviewed: bool | None = None, result: str | None = None) -> Column:
    """A condition on summaries. The text is literal, upper and lower case A-Z being alike; result is no_results, selected or failed."""
    fold = lambda c: F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    keep = F.lit(True)
    if text is not None:
        keep = keep & F.contains(fold(F.col("query")), fold(F.lit(text)))
    if reviewed is not None:
        keep = keep & (F.col("review_class").isNotNull() == F.lit(reviewed))
    if result is not None:
        keep = keep & {"no_results": (F.col("status") == "completed") & (F.col("candidates") == 0), "selected": F.col("selected_position").isNotNull(), "failed": F.col("status") == "failed"}[result]
    return keep


def browse_observations(summaries: DataFrame, condition: Column, offset: int = 0, limit: int = 100, after: tuple | None = None) -> tuple[int, DataFrame]:
    """(total, page), the newest first; `after` is (created_at, observation_id) of the last row of the page before."""
    rows = summaries.where(condition)
    if after is not None:
        return rows.count(), page_after(rows, [(F.col("created_at"), True), (F.col("observation_id"), True)], after, min(limit, 100))
    return rows.count(), rows.orderBy(F.desc("created_at"), F.desc("observation_id")).offset(offset).limit(min(limit, 100))


def apply_reviews(observations: DataFrame, candidates: DataFrame, stored: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(stored reviews with the good ones of new, rejects with a reason). new: observation_id, review_class, included, expected_correlation_id, one per observation."""
    own = candidates.select(F.col("observation_id").alias("_o"), F.col("correlation_id").alias("expected_correlation_id"))
    checked = new.join(observations.select("observation_id", "status"), "observation_id", "left").join(own, "expected_correlation_id", "left")
    reason = F.when(F.col("status").isNull(), "no such observation").when(F.col("expected_correlation_id").isNotNull() & ~F.col("_o").eqNullSafe(F.col("observation_id")), "expected is not a candidate").when((F.col("status") == "failed") & F.col("included"), "failed searches can't be included")
    checked = checked.withColumn("reason", reason).select(*new.columns, "reason")
    good = checked.where("reason is null").drop("reason")
    return stored.join(good.select("observation_id"), "observation_id", "left_anti").unionByName(good), checked.where("reason is not null")


def export_cases(observations: DataFrame, candidates: DataFrame, reviews: DataFrame) -> DataFrame:
    """Reviewed and included cases of completed searches: query, class and candidates in order, without ids, times or notes."""
    chosen = reviews.where("included").join(observations.where("status = 'completed'").select("observation_id", "query"), "observation_id")
    rows = chosen.join(candidates, "observation_id", "left")
    entry = F.when(F.col("correlation_id").isNotNull(), F.struct("position", "title", F.col("selected_at").isNotNull().alias("selected"), (F.col("correlation_id").eqNullSafe(F.col("expected_correlation_id"))).alias("expected")))
    return rows.groupBy("observation_id", "query", "review_class").agg(F.array_sort(F.collect_list(entry)).alias("candidates")).drop("observation_id")
