"""Job, error and tool-call logs: filters and pages, latest jobs, retention, interruption, references and summaries of requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .paging import page_after

#: Days that rows are kept by default.
RETENTION = {"observations": 90, "errors": 90, "tool_calls": 30, "jobs": 90}
TERMINAL = ["Completed", "Failed", "Cancelled", "Interrupted"]
SUMMARY = 240


def browse_log(df: DataFrame, filters: dict[str, str | None], order: list[str], offset: int = 0, limit: int = 100, after: tuple | None = None) -> tuple[int, DataFrame]:
    """(total, page): equality filters by trimmed values, blank ones ignored; the newest first. `after`, the last row's values of the columns of `order`, gives the page behind it without
    sorting those before, as an offset does."""
    for column, value in filters.items():
        if value and value.strip():
            df = df.where(F.col(column) == value.strip())
    if after is not None:
        return df.count(), page_after(df, [(F.col(c), True) for c in order], after, min(limit, 100))
    return df.count(), df.orderBy(*[F.desc(c) for c in order]).offset(offset).limit(min(limit, 100))


def latest_job(jobs: DataFrame, by: Column, order: list[str], only_active: bool = False) -> DataFrame:
    """The newest job of each value of `by`; active are those in no terminal status."""
    rows = jobs.where(~F.col("status").isin(TERMINAL)) if only_active else jobs
    n = F.row_number().over(Window.partitionBy(by).orderBy(*[F.desc(c) for c in order]))
    return rows.withColumn("_n", n).where("_n = 1").drop("_n")


def purge(df: DataFrame, timestamp: str, cutoff: Column, terminal_only: bool = False, except_id: str | None = None, id_col: str = "id", children: dict[str, DataFrame] | None = None) -> tuple[DataFrame, int, dict[str, DataFrame]]:
    """(kept rows, number deleted, kept children). Deleted are rows strictly older than the cutoff; with terminal_only those in a terminal status; never except_id."""
    old = F.coalesce(F.col(timestamp) < cutoff, F.lit(False))
    if terminal_only:
        old = old & F.col("status").isin(TERMINAL)
    if except_id is not None:
        old = old & (F.col(id_col) != except_id)
    kept = df.where(~old)
    own = {name: c.join(kept.select(id_col), id_col, "left_semi") for name, c in (children or {}).items()}
    return kept, df.where(old).count(), own


def interrupt_running(calls: DataFrame, now: Column, message: str = "The process ended before the call did.") -> DataFrame:
    running = F.col("status") == "Running"
    spent = F.greatest(F.lit(0.0), (F.unix_micros(now) - F.unix_micros(F.col("started_at"))) / 1000.0)
    return calls.withColumns({"completed_at": F.when(running, now).otherwise(F.col("completed_at")), "duration_ms": F.when(running, spent).otherwise(F.col("duration_ms")), "error_message": F.when(running, message).otherwise(F.col("error_message")), "status": F.when(running, "Interrupted").otherwise(F.col("status"))})


def reference_snapshots(calls: DataFrame, metadata: DataFrame) -> DataFrame:
    """(call_id, path, pos, reference, title): the references that calls of browse, play and manage_queue name, with what is known of them."""
    one = calls.where("tool = 'browse'").select("call_id", F.lit("browseRef").alias("path"), F.lit(0).alias("pos"), F.get_json_object("arguments", "$.browseRef").alias("reference"))
    lists = F.try_parse_json(F.get_json_object("arguments", "$.items")).try_cast("array<variant>")
    items = calls.where("tool in ('play', 'manage_queue')").select("call_id", F.posexplode(lists).alias("pos", "item"))
    # Only strings count; numbers and objects of the list keep their places.
    many = items.where(F.schema_of_variant("item") == "STRING").select("call_id", F.concat(F.lit("items["), F.col("pos").cast("string"), F.lit("]")).alias("path"), "pos", F.col("item").cast("string").alias("reference"))
    rows = one.where("reference is not null").unionByName(many)
    return rows.join(metadata.select("reference", "title"), "reference", "left").select("call_id", "path", "pos", "reference", "title")


#: What stands before the values of a search, by argument and whether it is a number, and before its rating by the kind of match.
SEARCH_PARTS = [("name", False, ""), ("provider", False, "Provider: "), ("genre", False, "Genre: ")]
RATINGS = {"at_least": "Rating: ≥ ", "exact": "Rating: = "}
#: What a request without arguments asks for, by tool.
WITHOUT_ARGUMENTS = {"search": "Broad search", "browse": "Library roots", "get_player_status": "All players"}


def request_summary(calls: DataFrame, snapshots: DataFrame | None = None) -> DataFrame:
    """(call_id, summary): one line of what a call asks for, by its tool, at most 240 characters; null where the arguments are truncated or neither an object nor null, and for unknown tools.

    snapshots (call_id, path, pos, reference, title, perhaps artist and album) name what references stand for."""
    said = F.try_parse_json("arguments")
    value = lambda name: F.try_variant_get(said, f"$.{name}", "variant")
    one_line = lambda c: F.nullif(F.trim(F.regexp_replace(c, r"[\s\p{Cc}]+", " ")), F.lit(""))
    text = lambda name: F.when(F.schema_of_variant(value(name)) == "STRING", one_line(value(name).cast("string")))
    number = lambda name: F.when(F.schema_of_variant(value(name)).rlike("^(BIGINT|DECIMAL|DOUBLE)"), F.get_json_object("arguments", f"$.{name}"))
    line = lambda *parts: F.nullif(F.array_join(F.array_compact(F.array(*parts)), " · "), F.lit(""))
    after = lambda label, c: F.concat(F.lit(label), c)

    first, last, rating, match = number("fromYear"), number("toYear"), number("rating"), text("ratingMatch")
    both = first.isNotNull() & last.isNotNull()
    rated = F.coalesce(*[F.when(match == kind, after(label, rating)) for kind, label in RATINGS.items()], after("Rating: ", rating))
    odd_match = F.when(rating.isNull() | ~match.isin(*RATINGS), after("Rating match: ", match))
    search = line(*[after(label, text(name)) for name, _, label in SEARCH_PARTS], F.when(both, F.concat(F.lit("Years: "), first, F.lit("–"), last)), F.when(~both, after("From year: ", first)), F.when(~both, after("To year: ", last)), rated, odd_match)

    known = [F.lit(None).cast("string")] * 3
    if snapshots is not None:
        more = [F.when((F.coalesce(one_line(F.col(c)), F.lit("")) != "") & (F.lower(c) != F.lower("title")), one_line(F.col(c))) for c in ("artist", "album") if c in snapshots.columns]
        label = F.coalesce(F.when(F.col("title").isNotNull(), line(one_line(F.col("title")), *more)), one_line(F.col("reference")))
        own = snapshots.withColumn("item", F.struct("pos", label.alias("label"))).groupBy("call_id").agg(
            F.min(F.when(F.col("path") == "browseRef", F.col("item")))["label"].alias("_root"), F.min(F.when(F.col("path").startswith("items["), F.col("item")))["label"].alias("_first"), F.count_if(F.col("path").startswith("items[")).alias("_items"),
        )
        calls = calls.join(own, "call_id", "left")
        known = [F.col("_root"), F.col("_first"), F.col("_items")]
    root, item, items = known
    count = F.size(value("items").try_cast("array<variant>"))
    asked = F.when(count >= 0, F.concat(count.cast("string"), F.when(count == 1, " requested item").otherwise(" requested items")))
    shown = F.coalesce(F.when(items > 1, F.concat(item, F.lit(" + "), (items - 1).cast("string"), F.lit(" more"))), item, asked)
    action = text("action")
    act = F.concat(F.upper(F.substring(action, 1, 1)), F.replace(F.substring(action, F.lit(2), F.length(action)), F.lit("_"), F.lit(" ")))

    empty = F.is_variant_null(said) | F.forall(F.map_values(said.try_cast("map<string,variant>")), F.is_variant_null)
    nothing = F.lit(None).cast("string")
    for tool, what in WITHOUT_ARGUMENTS.items():
        nothing = F.when((F.col("tool") == tool) & F.coalesce(empty, F.lit(False)), what).otherwise(nothing)
    by_tool = (
        F.when(F.col("tool") == "search", search).when(F.col("tool") == "browse", F.coalesce(root, text("browseRef"))).when(F.col("tool") == "get_queue", text("player"))
        .when(F.col("tool") == "control_player", line(text("player"), act)).when(F.col("tool").isin("manage_queue", "play"), line(text("player"), act, shown))
    )
    fine = (F.is_variant_null(said) | F.schema_of_variant(said).startswith("OBJECT")) & ~F.coalesce("arguments_truncated", F.lit(False))
    full = F.coalesce(by_tool, nothing)
    return calls.select("call_id", F.when(fine, F.when(F.length(full) > SUMMARY, F.concat(F.substring(full, 1, SUMMARY - 1), F.lit("…"))).otherwise(full)).alias("summary"))


def ingest_errors(existing: DataFrame, new: DataFrame, limits: dict[str, int]) -> DataFrame:
    """New errors with trimmed and cut fields, without reports that are stored or come twice; errors without a report id are all kept."""
    for column, n in limits.items():
        new = new.withColumn(column, F.substring(F.trim(column), 1, n))
    named = new.where("report_id is not null").dropDuplicates(["report_id"]).join(existing.select("report_id"), "report_id", "left_anti")
    return new.where("report_id is null").unionByName(named.select(*new.columns))
