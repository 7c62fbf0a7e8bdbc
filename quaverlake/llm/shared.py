"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an edge list that stand in one file, if there are fewer than fill all partitions.
FILE_ROWS = 250_000


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, the one that driver and executors share.

    The setting is read from the session; only where it is unset (local tests) a
    temporary folder of this machine takes its place.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write `df` to the shared folder and read it back: the lineage ends here.

    A lost executor costs no recomputation of what stands before the cut.
    """
    path = shared_dir(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._cut_at = path
    return out


def uncut(*tables: DataFrame) -> None:
    """Deletes tables that `cut` wrote and that nothing reads any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._cut_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an undirected edge list: rows (node, component), the component
    being the smallest node reachable. Nulls and self-loops are ignored; no edges give no rows.

    Alternates the large-star and small-star steps (Kiveris et al., 2014) until no edge changes. Every
    step groups by node; a hub of many edges is reduced by a partial minimum before the shuffle,
    and its neighbours are joined to that minimum, a join that adaptive execution can split.

    A step's edges are written to as many files as the edges before it fill: small lists are not spread over all
    shuffle partitions, each with a file of its own.
    """
    measured = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    e = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    e = cut(e)
    state = measured(e)
    while True:
        # Large star: link every larger neighbour of a node to the smallest node it sees.
        both = e.union(e.select(F.col("v"), F.col("u")).toDF("u", "v"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        # Small star: link every smaller neighbour, and the node, to the smallest of them.
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low2, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low2.select("u", F.col("m").alias("v")))
        before, e = e, cut(small.where("u <> v").distinct().coalesce(max(1, math.ceil(state[0] / FILE_ROWS))))
        uncut(before)
        now = measured(e)
        if now == state:
            out = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
            out._cut_at = e._cut_at
            return out
        state = now
