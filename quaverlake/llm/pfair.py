"""Mixing sources to target weights by Pfair scheduling.

Each source's rows, in the order of a keyed hash, form blocks of `block_rows` rows. Weights are whole numbers, the quotas, of a
`period` of slots that they fill. The j-th block (from 0) of a source of weight w = quota / period is released at slot
floor(j / w) and due by slot ceil((j + 1) / w); each slot goes to the released block with the earliest deadline, ties to the source that
comes first. On one line of slots with weights that add up to 1 every block meets its deadline, so
up to each slot a source has had less than one block more or less than its weight times the slots (Baruah et al., 1996).

Release times and deadlines repeat every `period` slots, so the schedule of one period, a table of `period` entries whatever the
data, gives every block's slot by arithmetic. A source that runs out leaves its later slots empty; no row is dropped or repeated.

Ranks inside a source take two steps: counts of small hash ranges and their running sums, then row numbers inside a range; a source that
holds a third of all rows is thereby split into as many groups as there are ranges.

Weights default to the square root of the sources' row counts; `weights` gives some sources their own instead. Every source gets at least
one slot of a period; with more than a quarter as many sources as slots the period grows to four slots a source.

Defined results: a null source is a source of its own and comes first. Rows with a null id stand where their text puts them; rows of equal id (or equal text) are ordered by
the hash of the whole row, equal rows in either order. Empty tables give empty results. Extra columns are kept; those named like an added column are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import cut, table

BLOCK_ROWS = 32
PERIOD = 1000
KEY = "mix-1"
#: Hex digits of the hash that name a range: 4096 ranges a source.
RANGE_DIGITS = 3
LATE = 1 << 62
#: Slots of a period, about 8 bytes each, up to which the schedule is broadcast; a longer one is joined by a shuffle.
MOST_BROADCAST = 1_000_000


def quotas(counts: DataFrame, period: int, weights: dict[str, float] | None = None) -> DataFrame:
    """(source, quota) of (source, total): shares of the period by largest remainders, at least 1 each. Sources are named as `_named` does."""
    weight = F.sqrt("total")
    for source, own in (weights or {}).items():
        weight = F.when(F.col("source") == "s" + source, float(own)).otherwise(weight)
    one = Window.partitionBy(F.lit(0))  # a row per source
    shares = counts.withColumn("w", weight).withColumn("exact", F.col("w") / F.sum("w").over(one) * (F.lit(period) - F.count("*").over(one)))
    shares = shares.withColumn("part", F.col("exact") - F.floor("exact")).withColumn("left", F.lit(period) - F.sum(F.floor("exact") + 1).over(one))
    ranked = shares.withColumn("n", F.row_number().over(one.orderBy(F.desc("part"), "source")))
    return ranked.select("source", (F.floor("exact") + 1 + (F.col("n") <= F.col("left")).cast("int")).alias("quota"))


def schedule(shares: DataFrame, period: int) -> DataFrame:
    """(source, quota, slots): the slots of each source in one period, from 0 and in order. A fold over the slots keeps how many blocks each source has had."""
    one = shares.agg(F.array_sort(F.collect_list(F.struct("source", "quota"))).alias("sources"))
    p = F.lit(period).cast("long")

    def step(state: Column, t: Column) -> Column:
        def due(s: Column, i: Column) -> Column:
            had = F.get(state["had"], i)
            released = had * p < (t + 1) * s["quota"]  # floor(had / weight) <= t
            return F.struct(F.when(released, F.ceil((had + 1) * p / s["quota"])).otherwise(F.lit(LATE)).alias("due"), i.alias("i"))

        next_one = F.array_min(F.transform("sources", due))["i"]
        return F.struct(F.transform(state["had"], lambda n, i: n + (i == next_one).cast("long")).alias("had"), F.concat(state["line"], F.array(next_one)).alias("line"))

    start = F.struct(F.transform("sources", lambda s: F.lit(0).cast("long")).alias("had"), F.array().cast("array<int>").alias("line"))
    line = one.select("sources", F.aggregate(F.sequence(F.lit(0).cast("long"), p - 1), start, step, lambda s: s["line"]).alias("line"))
    slots = line.select("sources", F.posexplode("line").alias("slot", "i")).select(F.get("sources", F.col("i")).alias("s"), "slot")
    return slots.groupBy("s").agg(F.array_sort(F.collect_list("slot")).alias("slots")).select("s.source", "s.quota", "slots")


def _named(source: str) -> Column:
    return F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit("n"))


def interleave(docs: DataFrame, source_col: str = "source", id_col: str = "doc_id", block_rows: int = BLOCK_ROWS, period: int = PERIOD, weights: dict[str, float] | None = None, key: str = KEY) -> DataFrame:
    """The rows of docs with block (of its source, from 0), slot and place (in the block, from 0). The mixture is the order of (slot, place)."""
    docs = docs.drop("block", "slot", "place")
    same = F.coalesce(F.col(id_col).cast("string"), *([F.col("text").cast("string")] if "text" in docs.columns else []), F.lit(""))
    # The row is one column, so that no column of the input clashes with those made here.
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(row.alias("row"), _named(source_col).alias("source"), F.md5(F.concat(F.lit(key + "|"), same)).alias("hash")).withColumn("range", F.substring("hash", 1, RANGE_DIGITS))
    ranges = cut(rows.groupBy("source", "range").agg(F.count("*").alias("rows")))
    counts = ranges.groupBy("source").agg(F.sum("rows").alias("total"))
    sources = counts.count()
    period = max(period, 4 * sources)
    # One row a source, with `period` numbers in all, as every source has at least one slot.
    plan = cut(schedule(quotas(counts, period, weights), period))
    if period <= MOST_BROADCAST:
        plan = F.broadcast(plan)
    earlier = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranges.select("source", "range", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("before"))
    within = Window.partitionBy("source", "range").orderBy("hash", F.xxhash64("row"))
    ranked = rows.withColumn("number", F.row_number().over(within)).join(offsets, ["source", "range"]).join(plan, "source")
    rank = F.col("before") + F.col("number") - 1
    block = F.floor(rank / block_rows)
    slot = F.floor(block / F.col("quota")) * period + F.get("slots", (block % F.col("quota")).cast("int"))
    return ranked.select("row.*", block.alias("block"), slot.alias("slot"), (rank % block_rows).alias("place"))


def op9_pfair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interleave(table(spark, sf_dir, "documents").select("doc_id", "source"))


OP9_SQL = f"""
WITH RECURSIVE named AS (
  SELECT doc_id, source, coalesce('s' || source, 'n') AS name, md5('{KEY}|' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), counts AS (
  SELECT name, sqrt(CAST(count(*) AS DOUBLE)) AS w FROM named GROUP BY name
), size AS (
  SELECT greatest({PERIOD}, 4 * count(*)) AS p, count(*) AS k, sum(w) AS total FROM counts
), exact AS (
  SELECT name, w / total * (p - k) AS x, p FROM counts, size
), ranked AS (
  SELECT name, CAST(floor(x) AS BIGINT) + 1 AS low, row_number() OVER (ORDER BY x - floor(x) DESC, name) AS n,
    p - sum(CAST(floor(x) AS BIGINT) + 1) OVER () AS spare FROM exact
), shares AS (
  SELECT name, CAST(low + CASE WHEN n <= spare THEN 1 ELSE 0 END AS BIGINT) AS quota, row_number() OVER (ORDER BY name) AS i FROM ranked
), one AS (
  SELECT list(quota ORDER BY i) AS q FROM shares
), line AS (
  SELECT CAST(0 AS BIGINT) AS t, list_transform(q, lambda x: CAST(0 AS BIGINT)) AS had, CAST(0 AS BIGINT) AS pick FROM one
  UNION ALL
  SELECT t + 1, list_transform(had, lambda x, i: x + CASE WHEN i = best THEN 1 ELSE 0 END), best FROM (
    SELECT t, had, CAST(list_position(due, list_min(due)) AS BIGINT) AS best FROM (
      SELECT t, had, list_transform(had, lambda x, i: CASE WHEN x * p < (t + 1) * q[i] THEN ((x + 1) * p + q[i] - 1) // q[i] ELSE {LATE} END) AS due
      FROM line, one, size WHERE t < p))
), slots AS (
  SELECT pick AS i, t - 1 AS slot, row_number() OVER (PARTITION BY pick ORDER BY t) - 1 AS j FROM line WHERE pick > 0
), numbered AS (
  SELECT doc_id, source, name, row_number() OVER (PARTITION BY name ORDER BY h) - 1 AS r FROM named
)
SELECT doc_id, source, r // {BLOCK_ROWS} AS block, CAST((r // {BLOCK_ROWS}) // quota * p + slot AS BIGINT) AS slot, CAST(r % {BLOCK_ROWS} AS BIGINT) AS place
FROM numbered JOIN shares USING (name) JOIN slots ON slots.i = shares.i AND slots.j = (r // {BLOCK_ROWS}) % quota, size
"""
