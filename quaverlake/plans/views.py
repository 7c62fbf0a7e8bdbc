"""Catalogue tables and queries as views over the driver's tables, in SQL that Spark and DuckDB both read."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: Dangling and missing values are made by key, so that checks have something to find.
VIEWS = {
    "v_artists": "SELECT concat('s', CAST(s_suppkey AS VARCHAR(20))) AS source_id, s_name AS name FROM supplier WHERE s_suppkey % 17 <> 0",
    "v_albums": "SELECT p_brand AS source_id, p_brand AS title, concat('s', CAST(min(p_partkey) AS VARCHAR(20))) AS artist_id, CAST(1980 + min(p_partkey) % 40 AS INT) AS year FROM part GROUP BY p_brand",
    "v_genres": "SELECT DISTINCT p_type AS source_id, p_type AS name FROM part WHERE p_type <> 'SMALL'",
    "v_tracks": "SELECT concat('t', CAST(p_partkey AS VARCHAR(20))) AS source_id, p_name AS title, CASE WHEN p_partkey % 11 = 0 THEN 'none' ELSE p_brand END AS album_id, CASE WHEN p_partkey % 5 > 0 THEN CAST(1970 + p_partkey % 50 AS INT) END AS year FROM part",
    "v_track_artists": "SELECT DISTINCT concat('t', CAST(l_partkey AS VARCHAR(20))) AS track_id, concat('s', CAST(l_suppkey AS VARCHAR(20))) AS artist_id, CAST(l_suppkey AS BIGINT) AS pos FROM lineitem WHERE l_partkey % 7 <> 0",
    "v_track_genres": "SELECT concat('t', CAST(p_partkey AS VARCHAR(20))) AS track_id, p_type AS genre_id, CAST(0 AS BIGINT) AS pos FROM part",
    "v_statistics": "SELECT concat('t', CAST(p_partkey AS VARCHAR(20))) AS track_id, CASE WHEN p_partkey % 3 = 0 THEN 'other' ELSE 'core' END AS source, CAST(p_size * 2 AS INT) AS native_rating FROM part",
    "v_members": "SELECT concat('n', CAST(c_nationkey AS VARCHAR(20))) AS library_id, concat('t', CAST(c_custkey AS VARCHAR(20))) AS track_id FROM customer",
    # Titles are the whole title elements of all pages, artists all names of parts; each of both is asked for, page titles two times in three with an alteration.
    "v_titles": "SELECT CAST(page_id AS VARCHAR(20)) AS id, title, album, CASE WHEN lang = '' THEN 'NONE' ELSE upper(lang) END AS genre, native_rating, year FROM (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(url, '://([^/]+)', 1) AS album, regexp_extract(url, '://[^/]+/([a-z]+)/', 1) AS lang, CAST(length(html) % 101 AS INT) AS native_rating, CAST(1960 + page_id % 64 AS INT) AS year FROM pages) x",
    "v_singers": "SELECT concat('b', CAST(min(p_partkey) AS VARCHAR(20))) AS id, p_name AS title FROM part GROUP BY p_name",
    "v_queries": "SELECT concat('q', CAST(number AS VARCHAR(20))) AS query_id, CASE WHEN number % 3 = 0 THEN concat(substring(t, 1, 4), substring(t, 6)) WHEN number % 3 = 1 THEN concat(t, ' zz') ELSE t END AS text FROM (SELECT min(p_partkey) AS number, p_name AS t FROM part GROUP BY p_name UNION ALL SELECT 100000 + page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) FROM pages) x",
    "v_calls": "SELECT event_id AS call_id, event_type AS tool, ts AS started_at, CAST(value AS DOUBLE) AS duration_ms, props AS arguments, CASE WHEN event_id % 9 = 0 THEN 'Running' WHEN event_type = 'error' THEN 'Failed' ELSE 'Completed' END AS status, user_id FROM events",
    "v_observations": "SELECT concat('o', CAST(user_id AS VARCHAR(20)), '-', CAST(CAST(ts AS DATE) AS VARCHAR(20))) AS observation_id, min(ts) AS created_at, max(event_type) AS query, CASE WHEN max(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) = 1 AND user_id % 4 = 0 THEN 'failed' ELSE 'completed' END AS status FROM events GROUP BY user_id, CAST(ts AS DATE)",
    "v_candidates": "SELECT concat('o', CAST(user_id AS VARCHAR(20)), '-', CAST(CAST(ts AS DATE) AS VARCHAR(20))) AS observation_id, concat('k', CAST(event_id AS VARCHAR(20))) AS correlation_id, CAST(row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS INT) AS position, CAST(NULL AS TIMESTAMP) AS selected_at, event_type AS title FROM events WHERE user_id % 5 <> 0",
    "v_selections": "SELECT concat('k', CAST(event_id AS VARCHAR(20))) AS correlation_id, ts AS selected_at FROM events WHERE event_type = 'purchase'",
    "v_reviews": "SELECT concat('o', CAST(user_id AS VARCHAR(20)), '-', CAST(CAST(ts AS DATE) AS VARCHAR(20))) AS observation_id, CASE WHEN user_id % 2 = 0 THEN 'good' ELSE 'bad' END AS review_class, user_id % 6 = 0 AS included, min(concat('k', CAST(event_id AS VARCHAR(20)))) AS expected_correlation_id FROM events WHERE user_id % 3 = 0 GROUP BY user_id, CAST(ts AS DATE)",
}
TABLES = ["supplier", "part", "lineitem", "customer", "pages", "events", "orders"]


def with_views(sql: str) -> str:
    """DuckDB SQL with the views that it names, and those that these name, in front."""
    need: list[str] = []

    def visit(text: str) -> None:
        for name, body in VIEWS.items():
            if name in text and name not in need:
                visit(body)
                need.append(name)

    visit(sql)
    if not need:
        return sql
    return "WITH " + ", ".join(f"{n} AS ({VIEWS[n]})" for n in need) + ("," if sql.lstrip().upper().startswith("WITH ") else "") + " " + (sql.lstrip()[5:] if sql.lstrip().upper().startswith("WITH ") else sql)


class Views:
    """The views of one folder of tables: views.tracks is v_tracks."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        body = VIEWS[f"v_{name}"]
        used = [t for t in TABLES if re.search(rf"\bFROM {t}\b", body)]
        return self.spark.sql(re.sub(r"\bFROM (\w+)\b", lambda m: f"FROM {{{m[1]}}}" if m[1] in used else m[0], body), **{t: self.spark.read.parquet(f"{self.dir}/{t}.parquet") for t in used})
