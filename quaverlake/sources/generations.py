"""The search index as immutable generations in Spark tables: each table has two slots as partitions, and one row of state names the slot that counts."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NAMES = ["documents", "lookup_terms", "token_postings", "trigram_postings"]
STATE = "generation long, slot int, version string, documents long"


def _state(spark: SparkSession, root: str):
    """The row of state, or nothing where no index is published."""
    try:
        return spark.read.schema(STATE).parquet(f"{root}/state").orderBy(F.desc("generation")).first()
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def publish_index(spark: SparkSession, index: dict[str, DataFrame], root: str, version: str) -> int:
    """Writes a generation into the slot that does not count, checks that each of its tables has rows to read, and then makes it the current one. The one before stays in its
    slot; the one before that is what the new one replaced. A failure leaves the current one."""
    now = _state(spark, root)
    number = now.generation + 1 if now else 1
    slot = number % 2
    for table in NAMES:
        rows = index[table].withColumn("slot", F.lit(slot))
        lanes = ["slot", "lane"] if table == "lookup_terms" else ["slot"]
        if table == "documents" and rows.isEmpty():
            raise ValueError("an index without documents is not published")
        # Lanes of an older generation in this slot must not stay, so the slot is written as a table of its own.
        rows.drop("slot").write.mode("overwrite").partitionBy(*lanes[1:]).parquet(f"{root}/{table}/slot={slot}")
    counts = {table: spark.read.schema(index[table].schema).parquet(f"{root}/{table}/slot={slot}").count() for table in NAMES}
    spark.createDataFrame([(number, slot, version, counts["documents"])], STATE).coalesce(1).write.mode("append").parquet(f"{root}/state")
    return number


def open_index(spark: SparkSession, root: str, version: str) -> dict[str, DataFrame]:
    """The tables of the current generation; one of another version is refused."""
    now = _state(spark, root)
    if now is None:
        raise ValueError("no index is published")
    if now.version != version:
        raise ValueError(f"the index has version {now.version}, not {version}")
    return {table: spark.read.parquet(f"{root}/{table}/slot={now.slot}") for table in NAMES}
