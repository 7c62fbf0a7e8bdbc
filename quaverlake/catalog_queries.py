"""The registered queries of the catalogue operators, each with its SQL for DuckDB where SQL can express it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import scalars as S
from .functions import text as T
from .operators import documents as D
from .operators import evaluate as E
from .operators import index as I
from .operators import ingest as N
from .operators import observe as O
from .operators import oplog as L
from .operators import reconcile as C
from .operators import retrieve as R
from .operators import score as Sc
from .operators import select as A
from .operators import stored as St
from .operators import titles as Ti
from .plans import search as P
from .plans.stage import shared_root, staged
from .plans.views import Views, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of the views, under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        if sql:
            SQL[f.__name__] = with_views(sql)
        return f

    return add


# Reconciling.


@query("""SELECT source_id, title, n FROM (SELECT concat('c', CAST(o_custkey AS VARCHAR)) AS source_id, o_orderstatus AS title, o_orderkey AS n,
  row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS r FROM orders) WHERE r = 1""")
def dedupe_last(v):
    rows = v.spark.read.parquet(f"{v.dir}/orders.parquet").select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("source_id"), F.col("o_orderstatus").alias("title"), F.col("o_orderkey").alias("n"))
    return C.dedupe_last(rows, "source_id", "n")


def _seen(v):
    """Stored tracks of an older refresh, and a batch of a new one that holds two thirds of them."""
    stored = v.tracks.withColumn("seen_refresh_id", F.lit("r1"))
    number = F.substring("source_id", 2, 20).cast("long")
    return stored, v.tracks.where(number % 3 != 0).withColumn("title", F.upper("title"))


_UPSERTED = "(SELECT source_id, CASE WHEN CAST(substring(source_id, 2) AS BIGINT) % 3 <> 0 THEN upper(title) ELSE title END AS title, album_id, year, CASE WHEN CAST(substring(source_id, 2) AS BIGINT) % 3 <> 0 THEN 'r2' ELSE 'r1' END AS seen_refresh_id FROM v_tracks)"


@query(f"SELECT * FROM {_UPSERTED}")
def upsert(v):
    return C.upsert(*_seen(v), "source_id", "r2")


@query(f"SELECT track_id, artist_id FROM v_track_artists JOIN {_UPSERTED} u ON track_id = source_id WHERE seen_refresh_id = 'r2'")
def delete_unseen(v):
    tracks = C.upsert(*_seen(v), "source_id", "r2")
    return C.delete_unseen({"tracks": tracks}, {"links": v.track_artists}, "r2")["links"].select("track_id", "artist_id")


def _stored(v, df, key):
    """A stored table of a folder of its own."""
    name = f"stored_{uuid.uuid4().hex}"
    St.create_table(df, name, key, f"{shared_root(v.spark)}/{name}", bands=4, buckets=8)
    return name


@query(f"SELECT * FROM {_UPSERTED}")
def stored_upsert(v):
    """The same refresh on a stored table, in place."""
    stored, batch = _seen(v)
    name = _stored(v, stored, "source_id")
    St.upsert_table(v.spark, name, batch, "source_id", "r2")
    return St.read_table(v.spark, name).drop("band")


@query(f"SELECT track_id, artist_id FROM v_track_artists JOIN {_UPSERTED} u ON track_id = source_id WHERE seen_refresh_id = 'r2'")
def stored_delete_unseen(v):
    stored, batch = _seen(v)
    tracks, links = _stored(v, stored, "source_id"), _stored(v, v.track_artists, "track_id")
    St.upsert_table(v.spark, tracks, batch, "source_id", "r2")
    St.delete_unseen_tables(v.spark, [tracks], {links: "track_id"}, tracks, "r2")
    return St.read_table(v.spark, links).select("track_id", "artist_id")


@query("""SELECT track_id, artist_id, pos FROM v_track_artists WHERE CAST(substring(track_id, 2) AS BIGINT) % 3 = 0
  UNION ALL SELECT source_id, title, CAST(0 AS BIGINT) FROM v_tracks WHERE CAST(substring(source_id, 2) AS BIGINT) % 3 <> 0
  UNION ALL SELECT source_id, album_id, CAST(1 AS BIGINT) FROM v_tracks WHERE CAST(substring(source_id, 2) AS BIGINT) % 3 <> 0 AND album_id <> title""")
def replace_relations(v):
    batch = v.tracks.where(F.substring("source_id", 2, 20).cast("long") % 3 != 0).withColumn("ids", F.array("title", "album_id", "title"))
    return C.replace_relations(v.track_artists, batch, "track_id", "ids", "artist_id").withColumn("pos", F.col("pos").cast("long"))


@query("SELECT source_id, name FROM v_artists WHERE source_id IN (SELECT artist_id FROM v_albums UNION SELECT artist_id FROM v_track_artists)")
def referenced_artists(v):
    seen = lambda df: df.withColumn("seen_refresh_id", F.lit("r"))
    return C.referenced_artists(v.artists, seen(v.albums), seen(v.track_artists), "r")


@query("SELECT library_id, track_id, CASE WHEN track_id LIKE '%7' THEN 'r2' ELSE 'r1' END AS seen_refresh_id FROM (SELECT DISTINCT library_id, track_id FROM v_members)")
def upsert_memberships(v):
    stored = v.members.distinct().withColumn("seen_refresh_id", F.lit("r1"))
    return C.upsert_memberships(stored, v.members.where("track_id like '%7'"), "r2")


@query("""SELECT 'tracks' AS name, count(*) AS actual, count(*) + 1 AS expected, false AS ok FROM v_tracks
  UNION ALL SELECT 'library:' || library_id, count(DISTINCT track_id), count(DISTINCT track_id), true FROM v_members GROUP BY library_id""")
def check_counts(v):
    seen = lambda df: df.withColumn("seen_refresh_id", F.lit("r"))
    reported = v.members.groupBy(F.concat(F.lit("library:"), "library_id").alias("name")).agg(F.countDistinct("track_id").alias("expected"))
    reported = reported.unionByName(v.tracks.agg((F.count("*") + 1).alias("expected")).select(F.lit("tracks").alias("name"), "expected"))
    return C.check_counts({"tracks": seen(v.tracks)}, seen(v.members), reported, "r")


_WARNINGS = """(SELECT 'track_album' AS warning, count(*) AS n FROM v_tracks WHERE album_id NOT IN (SELECT source_id FROM v_albums)
  UNION ALL SELECT 'artist', (SELECT count(*) FROM v_albums WHERE artist_id NOT IN (SELECT source_id FROM v_artists)) + (SELECT count(*) FROM v_track_artists WHERE artist_id NOT IN (SELECT source_id FROM v_artists))
  UNION ALL SELECT 'track_genre', count(*) FROM v_track_genres WHERE genre_id NOT IN (SELECT source_id FROM v_genres)
  UNION ALL SELECT 'member_track', count(*) FROM v_members WHERE track_id NOT IN (SELECT source_id FROM v_tracks))"""


@query(f"SELECT * FROM {_WARNINGS} w")
def referential_counts(v):
    return C.referential_counts(v.albums, v.tracks, v.artists, v.genres, v.track_artists, v.track_genres, v.members)


@query(f"""SELECT CAST(sum(CASE WHEN n > 0 THEN 1 ELSE 0 END) AS BIGINT) AS warnings, (SELECT count(*) FROM v_tracks) AS tracks, (SELECT count(*) FROM v_albums) AS albums,
  (SELECT count(*) FROM v_artists) AS artists, (SELECT count(*) FROM v_genres) AS genres FROM {_WARNINGS} w""")
def catalogue_summary(v):
    return C.catalogue_summary({"tracks": v.tracks, "albums": v.albums, "artists": v.artists, "genres": v.genres}, referential_counts(v))


# Documents. Lists are joined to text, so that results compare by value.


def _flat(df):
    return df.select("kind", "id", "title", "artist", "album", "native_rating", F.array_join("artist_ids", ",").alias("artist_ids"), "year", F.array_join("genre_keys", ",").alias("genre_keys"))


_ARTIST_DOCS = "SELECT 'artist' AS kind, source_id AS id, name AS title, CAST(NULL AS VARCHAR) AS artist, CAST(NULL AS VARCHAR) AS album, CAST(0 AS INT) AS native_rating, source_id AS artist_ids, CAST(NULL AS INT) AS year, '' AS genre_keys FROM v_artists"
_ALBUM_DOCS = "SELECT 'album' AS kind, b.source_id AS id, title, a.name AS artist, CAST(NULL AS VARCHAR) AS album, CAST(0 AS INT) AS native_rating, coalesce(artist_id, '') AS artist_ids, year, '' AS genre_keys FROM v_albums b LEFT JOIN v_artists a ON a.source_id = b.artist_id"
_TRACK_DOCS = """SELECT 'track' AS kind, t.source_id AS id, t.title, coalesce(l.names, aa.name) AS artist, b.title AS album, coalesce(s.native_rating, 0) AS native_rating,
  coalesce(l.ids, b.artist_id, '') AS artist_ids, coalesce(t.year, b.year) AS year, coalesce(g.genre_keys, '') AS genre_keys
  FROM v_tracks t LEFT JOIN v_albums b ON b.source_id = t.album_id LEFT JOIN v_artists aa ON aa.source_id = b.artist_id
  LEFT JOIN (SELECT track_id, string_agg(name, ', ' ORDER BY pos) AS names, string_agg(artist_id, ',' ORDER BY pos) AS ids FROM v_track_artists JOIN v_artists ON source_id = artist_id GROUP BY track_id) l ON l.track_id = t.source_id
  LEFT JOIN (SELECT track_id, native_rating FROM v_statistics WHERE source = 'core') s ON s.track_id = t.source_id
  LEFT JOIN (SELECT track_id, string_agg(DISTINCT upper(trim(name)), ',') AS genre_keys FROM v_track_genres JOIN v_genres ON source_id = genre_id GROUP BY track_id) g ON g.track_id = t.source_id"""


def _track_documents(v):
    return D.track_documents(v.tracks, v.albums, v.artists, v.genres, v.track_artists, v.track_genres, v.statistics)


@query(_ARTIST_DOCS)
def artist_documents(v):
    return _flat(D.artist_documents(v.artists))


@query(_ALBUM_DOCS)
def album_documents(v):
    return _flat(D.album_documents(v.albums, v.artists))


@query(_TRACK_DOCS)
def track_documents(v):
    return _flat(_track_documents(v))


def _all_documents(v):
    return D.search_documents(D.artist_documents(v.artists), D.album_documents(v.albums, v.artists), _track_documents(v))


@query(f"SELECT kind, count(*) AS n, count(artist) AS artists, CAST(sum(native_rating) AS BIGINT) AS ratings, count(DISTINCT kind || ':' || id) AS keys FROM ({_ARTIST_DOCS} UNION ALL {_ALBUM_DOCS} UNION ALL {_TRACK_DOCS}) d GROUP BY kind")
def search_documents(v):
    return _all_documents(v).groupBy("kind").agg(F.count("*").alias("n"), F.count("artist").alias("artists"), F.sum("native_rating").alias("ratings"), F.countDistinct("key").alias("keys"))


@query("SELECT 'album:' || source_id AS key, artist_id FROM v_albums")
def canonical_album_artist(v):
    return D.canonical_album_artist(I.document_artists(_all_documents(v)))


@query(f"SELECT u.artist_id, d.id, d.native_rating FROM ({_TRACK_DOCS}) d, (SELECT unnest(string_split(artist_ids, ',')) AS artist_id, id FROM ({_TRACK_DOCS}) x) u WHERE u.id = d.id AND u.artist_id IN (SELECT source_id FROM v_artists)")
def artist_media(v):
    docs = _all_documents(v)
    return D.artist_media(v.artists.select(F.col("source_id").alias("artist_id")), I.document_artists(docs), docs, "track").select("artist_id", "id", "native_rating")


# Text.

_PLAIN = "trim(lower(regexp_replace({}, '[^\\p{{L}}\\p{{Nd}}]+', ' ', 'g')))"
_NORMAL = _PLAIN.format("strip_accents(replace(replace(replace(replace({}, 'ß', 'ss'), 'œ', 'oe'), 'Œ', 'oe'), 'æ', 'ae'))")


def _n(column):
    return _NORMAL.replace("{}", column)


def _c(normal):
    return f"replace({normal}, ' ', '')"


def _skeleton(compacted):
    replaced = compacted
    for a, b in T.SOUNDS:
        replaced = f"replace({replaced}, '{a}', '{b}')"
    mapped = f"regexp_replace(translate({replaced}, 'cqvz', 'kkfs'), '[aeiouy]', '', 'g')"
    letters = f"string_split({mapped}, '')"
    return f"array_to_string(list_filter({letters}, lambda x, i: i = 1 OR x <> {letters}[i - 1]), '')"


@query(f"""SELECT doc_id, md5(n) AS normalised, md5(c) AS compacted, md5(array_to_string(list_filter(m, lambda x, i: i = 1 OR x <> m[i - 1]), '')) AS skeleton,
  CAST(CASE WHEN n = '' THEN 0 ELSE length(n) - length(c) + 1 END AS INT) AS words FROM (SELECT *, string_split(regexp_replace(translate(s, 'cqvz', 'kkfs'), '[aeiouy]', '', 'g'), '') AS m FROM
  (SELECT doc_id, n, c, replace(replace(replace(replace(replace(replace(replace(c, 'ph', 'f'), 'ght', 't'), 'ck', 'k'), 'qu', 'k'), 'sh', 's'), 'ch', 'c'), 'th', 't') AS s FROM
  (SELECT doc_id, n, replace(n, ' ', '') AS c FROM (SELECT doc_id, {_n('text')} AS n FROM documents) a) b) d) e""")
def text_forms(v):
    docs = v.spark.read.parquet(f"{v.dir}/documents.parquet").select("doc_id", T.normalise(F.col("text")).alias("n")).withColumn("c", T.compact(F.col("n")))
    return docs.select("doc_id", F.md5("n").alias("normalised"), F.md5("c").alias("compacted"), F.md5(T.skeleton(F.col("c"))).alias("skeleton"), F.size(T.tokens(F.col("n"))).alias("words"))


_BACKWARDS = I.EquivalenceProvider("backwards", "backwards", 1210, lambda c: F.array(F.reverse(T.compact(T.normalise(c)))), lambda span, number, whole: F.array(F.reverse(T.compact(span))))


@query(f"""SELECT id, n AS normalised, c AS compact, list_filter(string_split(n, ' '), lambda x: x <> '') AS tokens, array_to_string(list_filter(m, lambda x, i: i = 1 OR x <> m[i - 1]), '') AS skeleton, CASE WHEN length(c) >= 3 THEN list_sort(list_distinct(list_transform(range(1, length(c) - 1), lambda i: substring(c, i, 3)))) ELSE [] END AS trigrams, [reverse(c)] AS backwards
  FROM (SELECT *, string_split(regexp_replace(translate(s, 'cqvz', 'kkfs'), '[aeiouy]', '', 'g'), '') AS m FROM (SELECT id, n, c, replace(replace(replace(replace(replace(replace(replace(c, 'ph', 'f'), 'ght', 't'), 'ck', 'k'), 'qu', 'k'), 'sh', 's'), 'ch', 'c'), 'th', 't') AS s FROM (SELECT id, n, replace(n, ' ', '') AS c FROM (SELECT id, {_n('title')} AS n FROM v_titles) a) b) d) e""")
def forms_of_titles(v):
    """The struct of forms with a lane that was added; phonetic codes and spoken forms have golden values in the tests."""
    forms = v.titles.select("id", I.text_forms(F.col("title"), phonetic=False, providers=I.register_equivalence([], _BACKWARDS)).alias("f")).select("id", "f.*").drop("spoken")
    return forms.withColumn("trigrams", F.array_sort("trigrams"))


@query(f"""SELECT a.query_id, CAST(d AS INT) AS distance, round(CASE WHEN len(ga) > 0 AND len(gb) > 0 THEN 2.0 * len(list_intersect(ga, gb)) / (len(ga) + len(gb)) ELSE 0 END, 9) AS dice FROM
  (SELECT query_id, CASE WHEN levenshtein(x, y) <= 3 THEN levenshtein(x, y) ELSE 4 END AS d, list_distinct(list_transform(range(1, length(x) - 1), lambda i: substring(x, i, 3))) AS ga, list_distinct(list_transform(range(1, length(y) - 1), lambda i: substring(y, i, 3))) AS gb FROM
  (SELECT query_id, {_c(_n('q.text'))} AS x, {_c(_n('t.title'))} AS y FROM v_queries q JOIN v_titles t ON q.query_id = 'q' || CAST(100000 + CAST(t.id AS BIGINT) AS VARCHAR))) a""")
def similarity(v):
    pairs = v.queries.join(v.titles.withColumn("query_id", F.concat(F.lit("q"), (100_000 + F.col("id").cast("long")).cast("string"))), "query_id")
    x, y = T.compact(T.normalise(F.col("text"))), T.compact(T.normalise(F.col("title")))
    return pairs.select("query_id", T.bounded_edit(x, y, 3).alias("distance"), F.round(T.trigram_dice(T.trigrams(x), T.trigrams(y)), 9).alias("dice"))


@query("""SELECT p_partkey, CASE WHEN match = 'exact' THEN r * 20 = floor(r * 20) AND native = r * 20 ELSE native >= ceil(r * 20) END AS fits, CASE WHEN year IS NULL THEN false ELSE year BETWEEN 1980 AND 1999 END AS in_years FROM
  (SELECT p_partkey, p_size * 2 AS native, CAST(p_partkey % 21 AS DECIMAL(7,2)) / 4 AS r, CASE WHEN p_partkey % 2 = 0 THEN 'exact' ELSE 'at_least' END AS match, CASE WHEN p_partkey % 5 > 0 THEN 1970 + p_partkey % 50 END AS year FROM part)""")
def predicates(v):
    part = v.spark.read.parquet(f"{v.dir}/part.parquet")
    rating, match = (F.col("p_partkey") % 21).cast("decimal(7,2)") / 4, F.when(F.col("p_partkey") % 2 == 0, "exact").otherwise("at_least")
    year = F.when(F.col("p_partkey") % 5 > 0, 1970 + F.col("p_partkey") % 50)
    return part.select("p_partkey", S.rating_predicate(F.col("p_size") * 2, rating, match).alias("fits"), S.year_predicate(year, F.lit(1980), F.lit(1999)).alias("in_years"))


@query("""SELECT p_partkey, CASE WHEN ok THEN least(a, b) END AS first_year, CASE WHEN ok THEN greatest(a, b) END AS last_year FROM (SELECT p_partkey, a, b, a BETWEEN 1000 AND 2027 AND b BETWEEN 1000 AND 2027 AS ok FROM
  (SELECT p_partkey, CASE WHEN x BETWEEN 0 AND 26 THEN x + 2000 WHEN x BETWEEN 0 AND 99 THEN x + 1900 ELSE x END AS a, CASE WHEN y BETWEEN 0 AND 26 THEN y + 2000 WHEN y BETWEEN 0 AND 99 THEN y + 1900 ELSE y END AS b FROM
  (SELECT p_partkey, CAST(p_partkey % 130 AS INT) AS x, CAST(1900 + p_partkey % 140 AS INT) AS y FROM part)))""")
def normalise_years(v):
    part = v.spark.read.parquet(f"{v.dir}/part.parquet")
    years = S.normalise_years((F.col("p_partkey") % 130).cast("int"), (1900 + F.col("p_partkey") % 140).cast("int"), 2026)
    return part.select("p_partkey", years.alias("y")).select("p_partkey", F.col("y.first").alias("first_year"), F.col("y.last").alias("last_year"))


# Index and retrieval over the text catalogue: tracks are titles of pages, artists names of parts.


def _docs(v):
    tracks = v.titles.select(F.lit("track").alias("kind"), "id", "title", F.lit(None).cast("string").alias("artist"), "album", "native_rating", F.array().cast("array<string>").alias("artist_ids"), "year", F.array("genre").alias("genre_keys"))
    artists = v.singers.select(F.lit("artist").alias("kind"), "id", "title", F.lit(None).cast("string").alias("artist"), F.lit(None).cast("string").alias("album"), F.lit(0).alias("native_rating"), F.array("id").alias("artist_ids"), F.lit(None).cast("int").alias("year"), F.array().cast("array<string>").alias("genre_keys"))
    return tracks.unionByName(artists)


_DOCS = "docs AS (SELECT 'track' AS kind, id, title, album, native_rating, year, genre FROM v_titles UNION ALL SELECT 'artist', id, title, NULL, 0, NULL, NULL FROM v_singers)"
_TEXTS = f"""{_DOCS}, texts AS (SELECT kind || ':' || id AS key, 'title' AS field, 1 AS f, title AS text FROM docs WHERE title IS NOT NULL
  UNION ALL SELECT kind || ':' || id, 'album', 3, album FROM docs WHERE album IS NOT NULL UNION ALL SELECT kind || ':' || id, 'combined', 4, concat_ws(' ', title, album) FROM docs),
 forms AS (SELECT key, field, f, text, n, replace(n, ' ', '') AS c FROM (SELECT key, field, f, text, {_n('text')} AS n FROM texts)),
 field_forms AS (SELECT *, {_skeleton('c')} AS s FROM forms)"""
_LOOKUP = f"""{_TEXTS}, terms AS (SELECT DISTINCT lane, term, key FROM (SELECT 'normalised' AS lane, n AS term, key FROM field_forms UNION ALL SELECT 'compact', c, key FROM field_forms UNION ALL SELECT 'skeleton', s, key FROM field_forms) WHERE term <> '')"""
_SPANS = f"""asked AS (SELECT query_id, list_filter(string_split({_n('text')}, ' '), lambda x: x <> '') AS w FROM v_queries),
 spans AS (SELECT query_id, len(w) AS tokens, k AS size, array_to_string(w[i:i + k - 1], ' ') AS span, row_number() OVER (PARTITION BY query_id ORDER BY i, k) - 1 AS span_no FROM
  (SELECT query_id, w, i, unnest(range(1, len(w) - i + 2)) AS k FROM (SELECT query_id, w, unnest(range(1, len(w) + 1)) AS i FROM asked))),
 span_forms AS (SELECT *, {_skeleton('c')} AS s FROM (SELECT *, replace(span, ' ', '') AS c FROM spans)),
 span_terms AS (SELECT DISTINCT query_id, lane, term FROM (SELECT query_id, 'normalised' AS lane, span AS term FROM span_forms UNION ALL SELECT query_id, 'compact', c FROM span_forms UNION ALL SELECT query_id, 'skeleton', s FROM span_forms) WHERE term <> '')"""
_TIE = "CASE WHEN key LIKE 'artist:%' THEN 0 ELSE 2 END, key"
_CANDIDATES = f"""{_LOOKUP}, {_SPANS}, matches AS (SELECT query_id, lane, key, CAST(count(*) AS DOUBLE) AS score FROM span_terms JOIN terms USING (lane, term) GROUP BY ALL),
 candidates AS (SELECT query_id, lane, key, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id, lane ORDER BY score DESC, {_TIE}) AS r FROM matches) WHERE r <= 80)"""


@query(f"WITH {_LOOKUP} SELECT lane, term, key FROM terms")
def lookup_terms(v):
    return I.lookup_terms(_docs(v), phonetic=False, providers=[])


@query(f"WITH {_CANDIDATES} SELECT * FROM candidates")
def lookup_candidates(v):
    return R.lookup_candidates(v.queries, I.lookup_terms(_docs(v), phonetic=False, providers=[]), phonetic=False, providers=[])


_ALLOWED = "(SELECT 'track:' || id AS key FROM v_titles WHERE native_rating >= 60 AND genre = 'EN')"


@query(f"WITH {_CANDIDATES} SELECT query_id, lane, key, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id, lane ORDER BY score DESC, {_TIE}) AS r FROM matches WHERE key IN {_ALLOWED}) WHERE r <= 80")
def constrained_candidates(v):
    docs = _docs(v)
    allowed = docs.where("kind = 'track' and native_rating >= 60 and array_contains(genre_keys, 'EN')").select(I.stable_key().alias("key"))
    return R.lookup_candidates(v.queries, I.lookup_terms(docs, phonetic=False, providers=[]), allowed, phonetic=False, providers=[])


_WORDS = f"{_DOCS}, bags AS (SELECT kind || ':' || id AS key, list_filter(string_split({_n('concat_ws($$ $$, title, album)')}, ' '), lambda x: x <> '') AS w FROM docs), posts AS (SELECT key, term, CAST(count(*) AS BIGINT) AS tf, len(any_value(w)) AS length FROM (SELECT key, w, unnest(w) AS term FROM bags) GROUP BY key, term)"
_GRAMS = f"{_DOCS}, bags AS (SELECT key, CASE WHEN length(c) >= 3 THEN list_transform(range(1, length(c) - 1), lambda i: substring(c, i, 3)) ELSE [] END AS w FROM (SELECT kind || ':' || id AS key, {_c(_n('concat_ws($$ $$, title, album)'))} AS c FROM docs)), posts AS (SELECT key, term, CAST(count(*) AS BIGINT) AS tf, len(any_value(w)) AS length FROM (SELECT key, w, unnest(w) AS term FROM bags) GROUP BY key, term)"


def _bm25(hits):
    return f"""size AS (SELECT count(*) AS n, avg(length) AS mean FROM (SELECT DISTINCT key, length FROM posts)), hits AS ({hits}), tfs AS (SELECT query_id, term, key, length, sum(tf) AS tf FROM hits GROUP BY ALL),
 dfs AS (SELECT query_id, term, count(*) AS df FROM tfs GROUP BY ALL),
 scored AS (SELECT query_id, key, CAST(sum(CAST(round(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean)) * 1e9) AS BIGINT)) AS DOUBLE) / 1e9 AS score FROM tfs JOIN dfs USING (query_id, term), size GROUP BY ALL)"""


def _top80(lane):
    return f"SELECT query_id, lane, key, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, {_TIE}) AS r FROM (SELECT *, '{lane}' AS lane FROM scored)) WHERE r <= 80"


@query(f"WITH {_WORDS} SELECT key, term, tf, CAST(length AS BIGINT) AS length FROM posts")
def token_postings(v):
    return I.token_postings(_docs(v))


@query(f"WITH {_GRAMS} SELECT key, term, tf, CAST(length AS BIGINT) AS length FROM posts")
def trigram_postings(v):
    return I.trigram_postings(_docs(v))


@query(f"""WITH {_WORDS}, {_bm25(f"SELECT query_id, word AS term, key, tf, length FROM (SELECT DISTINCT query_id, unnest(list_filter(string_split({_n('text')}, ' '), lambda x: x <> '')) AS word FROM v_queries) q JOIN posts ON starts_with(posts.term, word)")} {_top80('token_prefix')}""")
def prefix_candidates(v):
    return R.prefix_candidates(v.queries, I.token_postings(_docs(v))).withColumn("score", F.round("score", 6))


@query(f"""WITH {_GRAMS}, {_bm25(f"SELECT query_id, term, key, tf, length FROM (SELECT DISTINCT query_id, unnest(CASE WHEN length(c) >= 3 THEN list_transform(range(1, length(c) - 1), lambda i: substring(c, i, 3)) ELSE [] END) AS term FROM (SELECT query_id, {_c(_n('text'))} AS c FROM v_queries)) q JOIN posts USING (term)")} {_top80('trigram')}""")
def trigram_candidates(v):
    return R.trigram_candidates(v.queries, staged(I.trigram_postings(_docs(v)))).withColumn("score", F.round("score", 6))


_SCORED = f"""{_CANDIDATES}, pairs AS (SELECT c.query_id, c.key, field, ff.f, span_no, tokens - size AS ignored, ff.n AS fn, ff.c AS fc, ff.s AS fs, span AS qn, sf.c AS qc, sf.s AS qs, greatest(length(ff.c), length(sf.c)) AS longest
  FROM (SELECT DISTINCT query_id, key FROM candidates) c JOIN field_forms ff USING (key) JOIN span_forms sf USING (query_id) WHERE ff.n <> ''),
 metrics AS (SELECT *, levenshtein(fc, qc) AS d, CASE WHEN longest <= 4 THEN 1 WHEN longest <= 8 THEN 2 WHEN longest <= 16 THEN 3 ELSE 4 END AS t,
  list_distinct(list_transform(range(1, length(fc) - 1), lambda i: substring(fc, i, 3))) AS ga, list_distinct(list_transform(range(1, length(qc) - 1), lambda i: substring(qc, i, 3))) AS gb FROM pairs),
 diced AS (SELECT *, CASE WHEN len(ga) > 0 AND len(gb) > 0 THEN CAST(2 AS DOUBLE) * len(list_intersect(ga, gb)) / (len(ga) + len(gb)) ELSE 0 END AS dice FROM metrics),
 signals AS (SELECT *, CASE WHEN fn = qn THEN 1300 WHEN list_sort(string_split(fn, ' ')) = list_sort(string_split(qn, ' ')) THEN 1260 WHEN fc = qc THEN 1230 WHEN starts_with(fn, qn) THEN 1140
  WHEN length(fs) >= 3 AND fs = qs THEN 1080 WHEN abs(length(fc) - length(qc)) <= t AND substring(fc, 1, 1) = substring(qc, 1, 1) AND d <= t THEN 1000 - 40 * d WHEN dice >= 0.45 THEN 700 + CAST(round(200 * dice) AS INT) END AS signal FROM diced),
 finals AS (SELECT *, signal - 320 * ignored - CASE field WHEN 'title' THEN 0 WHEN 'album' THEN 240 ELSE 100 END AS final FROM signals WHERE signal IS NOT NULL),
 scored AS (SELECT query_id, key, CAST(final AS INT) AS score, field FROM (SELECT *, row_number() OVER (PARTITION BY query_id, key ORDER BY final DESC, f, span_no) AS r FROM finals WHERE final > 0) WHERE r = 1),
 ranked AS (SELECT query_id, key, score, field, kind, title, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, CASE kind WHEN 'artist' THEN 0 ELSE 2 END, upper(title), key) AS rank FROM scored JOIN docs ON key = kind || ':' || id)"""


def _ranked(v, keep):
    """What `keep` leaves of the ranked rows of each text, for all queries."""
    docs = _docs(v)
    classes = R.lookup_classes(I.lookup_terms(docs, phonetic=False, providers=[]))

    def search(asked):
        lanes = staged(R.collect_candidates(R.lookups(asked, classes, phonetic=False, providers=[])))
        return keep(Sc.rank(Sc.score_candidates(lanes, docs, asked, phonetic=False, providers=[]), docs))

    return R.once_a_text(v.queries, search)


@query(f"WITH {_SCORED} SELECT query_id, key, score, field FROM scored")
def score_candidates(v):
    return _ranked(v, lambda ranked: ranked.select("query_id", "key", "score", "field"))


@query(f"WITH {_SCORED} SELECT query_id, key, score, field, CAST(rank AS INT) AS rank FROM ranked WHERE rank <= 5")
def search_top5(v):
    return _ranked(v, lambda ranked: Sc.top_n(ranked, 5).select("query_id", "key", "score", "field", "rank"))


@query(f"WITH {_SCORED} SELECT query_id, key, CAST(place AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY query_id, kind ORDER BY rank) AS place FROM ranked) WHERE place <= CASE kind WHEN 'artist' THEN 5 ELSE 80 END")
def cap_by_kind(v):
    return _ranked(v, lambda ranked: Sc.cap_by_kind(ranked).select("query_id", "key", "place"))


@query()
def search_all_lanes(v):
    """All lanes and signals, phonetic and cardinal ones included."""
    docs = _docs(v)
    classes = R.lookup_classes(I.lookup_terms(docs))

    def search(asked):
        asked = staged(asked)
        lanes = staged(R.collect_candidates(R.lookups(asked, classes), R.prefix_candidates(asked, I.token_postings(docs)), R.trigram_candidates(asked, I.trigram_postings(docs))))
        return Sc.top_n(Sc.rank(Sc.score_candidates(lanes, docs, asked), docs)).select("query_id", "key", "score", "field", "signal", "rank")

    return R.once_a_text(v.queries, search)


@query(f"WITH {_CANDIDATES}, firsts AS (SELECT query_id, key, min(CASE lane WHEN 'normalised' THEN 1 WHEN 'compact' THEN 2 ELSE 3 END) AS p FROM candidates GROUP BY ALL) SELECT m.query_id, m.lane, m.matched, coalesce(r.retrieved, 0) AS retrieved, coalesce(n.fresh, 0) AS fresh FROM (SELECT query_id, lane, count(*) AS matched FROM matches GROUP BY ALL) m LEFT JOIN (SELECT query_id, lane, count(*) AS retrieved FROM candidates GROUP BY ALL) r USING (query_id, lane) LEFT JOIN (SELECT query_id, CASE p WHEN 1 THEN 'normalised' WHEN 2 THEN 'compact' ELSE 'skeleton' END AS lane, count(*) AS fresh FROM firsts GROUP BY ALL) n USING (query_id, lane)")
def lane_report(v):
    return R.lookup_report(v.queries, I.lookup_terms(_docs(v), phonetic=False, providers=[]), phonetic=False, providers=[])


_MORE_LANES = _CANDIDATES.replace("key FROM field_forms) WHERE", "key FROM field_forms UNION ALL SELECT 'backwards', reverse(c), key FROM field_forms) WHERE").replace("s FROM span_forms) WHERE", "s FROM span_forms UNION ALL SELECT query_id, 'backwards', reverse(c) FROM span_forms) WHERE")


@query(f"""WITH {_MORE_LANES}, firsts AS (SELECT query_id, key, min(CASE lane WHEN 'normalised' THEN 1 WHEN 'compact' THEN 2 WHEN 'skeleton' THEN 3 ELSE 4 END) AS p FROM candidates GROUP BY ALL)
  SELECT m.query_id, m.lane, m.matched, coalesce(r.retrieved, 0) AS retrieved, coalesce(n.fresh, 0) AS fresh FROM (SELECT query_id, lane, count(*) AS matched FROM matches GROUP BY ALL) m LEFT JOIN (SELECT query_id, lane, count(*) AS retrieved FROM candidates GROUP BY ALL) r USING (query_id, lane)
  LEFT JOIN (SELECT query_id, CASE p WHEN 1 THEN 'normalised' WHEN 2 THEN 'compact' WHEN 3 THEN 'skeleton' ELSE 'backwards' END AS lane, count(*) AS fresh FROM firsts GROUP BY ALL) n USING (query_id, lane)""")
def register_equivalence(v):
    """The report of lanes with one that was added."""
    providers = I.register_equivalence([], _BACKWARDS)
    return R.lookup_report(v.queries, I.lookup_terms(_docs(v), phonetic=False, providers=providers), phonetic=False, providers=providers)


@query("SELECT 'track:' || id AS key, CAST((SELECT count(*) FROM v_titles WHERE native_rating >= 60) AS BIGINT) AS matched FROM v_titles WHERE native_rating >= 60 ORDER BY id LIMIT 80")
def constraint_scan(v):
    return R.constraint_scan(_docs(v), F.col("native_rating") >= 60).select("key", "matched")


# Whole texts: documents as titles and benchmark items as queries, every word of both.


def _whole(v):
    docs = v.spark.read.parquet(f"{v.dir}/documents.parquet")
    nothing = lambda kind: F.lit(None).cast(kind)
    return docs.select(F.lit("track").alias("kind"), F.col("doc_id").cast("string").alias("id"), F.col("text").alias("title"), nothing("string").alias("artist"), nothing("string").alias("album"), F.lit(0).alias("native_rating"), nothing("array<string>").alias("artist_ids"), nothing("int").alias("year"), nothing("array<string>").alias("genre_keys"))


def _items(v):
    return v.spark.read.parquet(f"{v.dir}/benchmark.parquet").select(F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("query_id"), "text")


_WHOLE = "docs AS (SELECT 'track' AS kind, CAST(doc_id AS VARCHAR) AS id, text AS title, CAST(NULL AS VARCHAR) AS album FROM documents)"
_WHOLE_WORDS = _WORDS.replace(_DOCS, _WHOLE)


@query(f"WITH {_WHOLE_WORDS} SELECT key, term, tf, CAST(length AS BIGINT) AS length FROM posts")
def text_token_postings(v):
    return I.token_postings(_whole(v))


@query(f"""WITH {_WHOLE_WORDS}, {_bm25(f"SELECT query_id, word AS term, key, tf, length FROM (SELECT DISTINCT 'b' || item_id AS query_id, unnest(list_filter(string_split({_n('text')}, ' '), lambda x: x <> '')) AS word FROM benchmark) q JOIN posts ON starts_with(posts.term, word)")} {_top80('token_prefix')}""")
def text_prefix_candidates(v):
    return R.prefix_candidates(_items(v), I.token_postings(_whole(v))).withColumn("score", F.round("score", 6))


# Selection. The draw is the first 13 hex digits of an MD5, which DuckDB can make too.


def _draw(*parts):
    return "(CAST('0x' || substring(md5(concat_ws('|', " + ", ".join(parts) + ")), 1, 13) AS BIGINT) / 4503599627370496.0)"


@query("""SELECT bucket, CAST(n AS INT) AS n, key, native_rating, has_more FROM (SELECT *, max(n) OVER (PARTITION BY bucket) > 50 AS has_more FROM (SELECT CAST(native_rating // 20 AS INT) AS bucket, 'track:' || id AS key, native_rating,
  row_number() OVER (PARTITION BY native_rating // 20 ORDER BY native_rating DESC, translate(title, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), translate(album, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'track:' || id) AS n FROM v_titles)) WHERE n <= 50""")
def rating_browse(v):
    return A.rating_browse(_docs(v)).select("bucket", "n", "key", "native_rating", "has_more")


@query(f"""SELECT album, key FROM (SELECT album, 'track:' || id AS key, row_number() OVER (PARTITION BY album ORDER BY {_draw("'s/all'", "album", "'track:' || id")}, 'track:' || id) AS r FROM v_titles) WHERE r <= 20""")
def reservoir(v):
    return A.reservoir(_docs(v).where("kind = 'track'").withColumn("key", I.stable_key()), ["album"], 20, "s").select("album", "key")


@query(f"""SELECT genre, key, CAST(place AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY genre ORDER BY score DESC, turn, bucket, album) AS place FROM (SELECT *, -ln(1 - {_draw("'r/album'", "genre", "album")}) AS bucket FROM
  (SELECT genre, key, score, album, row_number() OVER (PARTITION BY genre, score, album ORDER BY -ln(1 - {_draw("'r'", "genre", "key")}), key) AS turn FROM (SELECT genre, 'track:' || id AS key, native_rating // 20 AS score, lower(album) AS album FROM v_titles)))) WHERE place <= 35""")
def rotate(v):
    rows = v.titles.withColumns({"key": F.concat(F.lit("track:"), "id"), "score": F.floor(F.col("native_rating") / 20)})
    return A.rotate(rows, ["genre"], 35, "r").select("genre", "key", "place")


@query(f"""SELECT genre, key, CAST(place AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY genre ORDER BY score DESC, turn, -ln(1 - {_draw("'w/album'", "genre", "album")}) / first_weight, album) AS place FROM
  (SELECT *, row_number() OVER t AS turn, first_value(weight) OVER t AS first_weight FROM (SELECT genre, 'track:' || id AS key, native_rating // 50 AS score, lower(album) AS album, 1 + greatest(0, native_rating - 80) / 10 AS weight FROM v_titles)
   WINDOW t AS (PARTITION BY genre, score, album ORDER BY -ln(1 - {_draw("'w'", "genre", "key")}) / weight, key))) WHERE place <= 35""")
def weighted_rotate(v):
    rows = v.titles.withColumns({"key": F.concat(F.lit("track:"), "id"), "score": F.floor(F.col("native_rating") / 50)})
    return A.rotate(rows, ["genre"], 35, "w", weight=A.rating_weight(F.col("native_rating"))).select("genre", "key", "place")


@query("""SELECT id, CAST(coalesce(CASE WHEN rating IS NULL THEN 4 WHEN match = 'exact' AND rating < 4 THEN NULL WHEN match = 'exact' THEN rating ELSE greatest(rating, 4) END, -1) AS DOUBLE) AS rating FROM
  (SELECT doc_id AS id, CASE WHEN doc_id % 7 > 0 THEN CAST(doc_id % 6 AS DOUBLE) END AS rating, CASE WHEN doc_id % 2 = 0 THEN 'exact' ELSE 'at_least' END AS match FROM documents)""")
def top_track_constraint(v):
    docs = v.spark.read.parquet(f"{v.dir}/documents.parquet")
    out = S.top_track_constraint(F.when(F.col("doc_id") % 7 > 0, (F.col("doc_id") % 6).cast("double")), F.when(F.col("doc_id") % 2 == 0, "exact").otherwise("at_least"))
    return docs.select(F.col("doc_id").alias("id"), F.coalesce(out["rating"], F.lit(-1.0)).alias("rating"))


def _tables(v):
    return {"artists": v.artists, "albums": v.albums, "tracks": v.tracks, "genres": v.genres, "track_artists": v.track_artists, "track_genres": v.track_genres}


@query("SELECT source_id AS id, name AS title FROM v_artists WHERE source_id IN (SELECT artist_id FROM v_albums) ORDER BY upper(name), source_id LIMIT 50")
def browse_album_artists(v):
    return A.browse(_tables(v), "album_artists")


@query("SELECT source_id AS id, title FROM v_albums WHERE source_id IN (SELECT album_id FROM v_tracks JOIN v_track_genres g ON g.track_id = source_id WHERE genre_id = 'ECONOMY') ORDER BY upper(title), source_id LIMIT 10 OFFSET 5")
def browse_albums_of_genre(v):
    return A.browse(_tables(v), "albums_of_genre", "ECONOMY", 5, 10)


@query("SELECT source_id AS id, title FROM v_albums WHERE artist_id = 's5' OR source_id IN (SELECT album_id FROM v_tracks JOIN v_track_artists a ON a.track_id = source_id WHERE a.artist_id = 's5') ORDER BY upper(title), source_id LIMIT 50")
def browse_albums_of_artist(v):
    return A.browse(_tables(v), "albums_of_artist", "s5")


@query("SELECT DISTINCT CAST(year AS VARCHAR) AS id, CAST(year AS VARCHAR) AS title FROM v_albums WHERE year IS NOT NULL ORDER BY 1 DESC LIMIT 50")
def browse_years(v):
    return A.browse(_tables(v), "years")


@query("SELECT source_id AS id, name AS title FROM v_artists ORDER BY upper(name), source_id LIMIT 50")
def browse_artists(v):
    return A.browse(_tables(v), "artists")


@query("SELECT source_id AS id, title FROM v_albums ORDER BY upper(title), source_id LIMIT 50")
def browse_albums(v):
    return A.browse(_tables(v), "albums")


@query("SELECT source_id AS id, name AS title FROM v_genres ORDER BY upper(name), source_id LIMIT 50")
def browse_genres(v):
    return A.browse(_tables(v), "genres")


@query("SELECT source_id AS id, title FROM v_albums WHERE year = (SELECT min(year) FROM v_albums) ORDER BY upper(title), source_id LIMIT 50")
def browse_albums_of_year(v):
    year = v.albums.agg(F.min("year")).first()[0]
    return A.browse(_tables(v), "albums_of_year", str(year))


def _dated(v):
    number = F.substring("source_id", 2, 20).cast("long")
    return _tables(v) | {"tracks": v.tracks.withColumns({"added_at": F.timestamp_seconds(number % 700 * 86_400), "track_number": F.when(number % 4 > 0, number % 13)})}


@query("SELECT b.source_id AS id, b.title FROM v_albums b JOIN (SELECT album_id, max(CAST(substring(source_id, 2) AS BIGINT) % 700) AS added FROM v_tracks GROUP BY album_id) t ON t.album_id = b.source_id ORDER BY added DESC, upper(b.title), b.source_id LIMIT 10 OFFSET 3")
def browse_recent_albums(v):
    return A.browse(_dated(v), "recent_albums", None, 3, 10)


@query("SELECT id, title FROM (SELECT source_id AS id, title, CAST(substring(source_id, 2) AS BIGINT) AS n FROM v_tracks WHERE album_id = 'Brand#3') ORDER BY CASE WHEN n % 4 > 0 THEN n % 13 END NULLS LAST, upper(title), id LIMIT 50")
def browse_tracks_of_album(v):
    return A.browse(_dated(v), "tracks_of_album", "Brand#3")


# Observations.

_MARKED = "(SELECT c.observation_id, c.correlation_id, c.position, c.title, s.at AS selected_at FROM v_candidates c LEFT JOIN (SELECT correlation_id, min(selected_at) AS at FROM v_selections GROUP BY correlation_id) s USING (correlation_id))"
_SUMMARY = f"(SELECT o.observation_id, o.status, o.query, o.created_at, coalesce(c.n, 0) AS candidates, c.p AS selected_position, r.review_class, coalesce(r.included, false) AS included FROM v_observations o LEFT JOIN (SELECT observation_id, count(*) AS n, min(CASE WHEN selected_at IS NOT NULL THEN position END) AS p FROM {_MARKED} m GROUP BY observation_id) c USING (observation_id) LEFT JOIN v_reviews r USING (observation_id))"


def _marked(v):
    return O.mark_selected(v.candidates, v.selections)


def _summaries(v):
    return O.summarise_observations(v.observations, _marked(v), v.reviews)


_META = "meta AS (SELECT 'u' || user_id || '-' || CAST(ts AS DATE) AS query_id, CAST(CAST(ts AS DATE) AS VARCHAR) || ' 00:00:00' AS made, max(event_type) AS query, CASE WHEN max(value) > 190 THEN 'failed' ELSE 'completed' END AS status FROM events GROUP BY 1, 2), named AS (SELECT *, sha256(query_id || '|' || made) AS observation_id FROM meta)"
_EVENT_ID = "'u' || user_id || '-' || CAST(ts AS DATE)"


def _recorded(v):
    """Users' days as searches: their views and clicks are results, all their events requests."""
    events = v.spark.read.parquet(f"{v.dir}/events.parquet").withColumn("query_id", F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("-"), F.to_date("ts").cast("string")))
    meta = events.groupBy("query_id", F.to_date("ts").cast("timestamp").alias("created_at")).agg(F.max("event_type").alias("query"), F.when(F.max("value") > 190, "failed").otherwise("completed").alias("status"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("ts", "event_id"))
    results = events.where("event_type in ('view', 'click')").select("query_id", F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("key"), F.when(F.col("event_type") == "view", "track").otherwise("album").alias("kind"), F.col("event_type").alias("title"), place.alias("place"), F.least(F.lit(100), F.floor("value")).cast("int").alias("native_rating"))
    requests = events.select("query_id", F.col("ts").alias("started_at"), F.col("event_type").alias("kind"), F.lit("ok").alias("status"), F.col("value").alias("duration_ms"))
    return O.record(results, requests, meta)


@query(f"WITH {_META} SELECT observation_id, made AS created, query, status FROM named")
def record_observations(v):
    return _recorded(v)["observations"].select("observation_id", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created"), "query", "status")


@query(f"""WITH {_META} SELECT observation_id, sha256(observation_id || '|' || key) AS correlation_id, CAST(position AS INT) AS position, kind, CASE WHEN kind = 'track' THEN round(rating / 20, 2) END AS rating FROM (SELECT {_EVENT_ID} AS query_id, 'e' || event_id AS key,
  row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS position, CASE event_type WHEN 'view' THEN 'track' ELSE 'album' END AS kind, least(100, floor(value)) AS rating FROM events WHERE event_type IN ('view', 'click')) r JOIN named USING (query_id)""")
def record_candidates(v):
    return _recorded(v)["candidates"].select("observation_id", "correlation_id", "position", "kind", F.col("rating").cast("double").alias("rating"))


@query(f"""WITH {_META} SELECT observation_id, CAST(row_number() OVER (PARTITION BY observation_id ORDER BY ts, event_type, value) AS INT) AS sequence, event_type AS kind, 'ok' AS status, greatest(coalesce(value, 0), 0) AS duration_ms FROM (SELECT *, {_EVENT_ID} AS query_id FROM events) e JOIN named USING (query_id)""")
def record_requests(v):
    return _recorded(v)["requests"].select("observation_id", "sequence", "kind", F.col("status"), "duration_ms")


@query("SELECT * FROM (VALUES ('repeated observations', CAST(0 AS BIGINT)), ('repeated candidates', 0), ('candidates without an observation', 0), ('requests without an observation', 0), ('sequences with gaps', 0)) t(fault, n)")
def recording_faults(v):
    """What the three tables of the log say about each other."""
    return O.recording_faults(_recorded(v))


@query(f"SELECT correlation_id, position, epoch_us(selected_at) AS selected_us FROM {_MARKED} m")
def mark_selected(v):
    return _marked(v).select("correlation_id", "position", F.unix_micros(F.col("selected_at").cast("timestamp")).alias("selected_us"))


@query(f"SELECT observation_id, status, candidates, selected_position, review_class, included FROM {_SUMMARY} s")
def summarise_observations(v):
    return _summaries(v).select("observation_id", "status", "candidates", "selected_position", "review_class", "included")


@query(f"SELECT observation_id FROM {_SUMMARY} s WHERE contains(lower(query), 'view') AND review_class IS NULL AND selected_position IS NOT NULL ORDER BY created_at DESC, observation_id DESC LIMIT 100")
def browse_observations(v):
    return O.browse_observations(_summaries(v), O.observation_filter("VIEW", False, "selected"))[1].select("observation_id")


@query(f"SELECT observation_id FROM {_SUMMARY} s WHERE status = 'completed' AND candidates = 0")
def no_results(v):
    return _summaries(v).where(O.observation_filter(result="no_results")).select("observation_id")


@query("SELECT observation_id, CASE WHEN status = 'failed' AND included THEN 'failed searches can''t be included' END AS reason FROM v_reviews JOIN v_observations USING (observation_id) WHERE expected_correlation_id IN (SELECT correlation_id FROM v_candidates) UNION ALL SELECT observation_id, 'expected is not a candidate' FROM v_reviews WHERE expected_correlation_id NOT IN (SELECT correlation_id FROM v_candidates)")
def apply_reviews(v):
    good, bad = O.apply_reviews(v.observations, v.candidates, v.reviews.limit(0), v.reviews)
    return bad.select("observation_id", "reason").unionByName(good.select("observation_id", F.lit(None).cast("string").alias("reason")))


@query(f"""SELECT query, review_class, count(*) AS cases, CAST(sum(n) AS BIGINT) AS candidates, CAST(sum(picked) AS BIGINT) AS selected, CAST(sum(hit) AS BIGINT) AS expected FROM (SELECT r.observation_id, any_value(o.query) AS query, any_value(review_class) AS review_class, count(m.correlation_id) AS n, count(m.selected_at) AS picked, count_if(m.correlation_id = r.expected_correlation_id) AS hit
  FROM v_reviews r JOIN v_observations o ON o.observation_id = r.observation_id AND o.status = 'completed' LEFT JOIN {_MARKED} m ON m.observation_id = r.observation_id WHERE included GROUP BY r.observation_id) GROUP BY query, review_class""")
def export_cases(v):
    cases = O.export_cases(v.observations, _marked(v), v.reviews)
    number = lambda what: F.sum(F.size(F.filter("candidates", what))).alias
    return cases.groupBy("query", "review_class").agg(F.count("*").alias("cases"), F.sum(F.size("candidates")).alias("candidates"), number(lambda c: c["selected"])("selected"), number(lambda c: c["expected"])("expected"))


@query("""SELECT user_id, greatest(coalesce(max(CASE WHEN event_type IN ('click', 'view') THEN value END), 0), user_id % 5) + coalesce(sum(CASE WHEN event_type = 'purchase' THEN CAST(round(value) AS BIGINT) END), 0) + coalesce(max(CASE WHEN event_type = 'error' THEN round(value) END), 0) AS retrieval_ms FROM (SELECT user_id, event_type, CASE WHEN event_type IN ('click', 'view') THEN round(value) ELSE value END AS value FROM events) GROUP BY user_id""")
def retrieval_durations(v):
    events = v.spark.read.parquet(f"{v.dir}/events.parquet")
    kind = F.when(F.col("event_type") == "click", "index").when(F.col("event_type") == "view", "provider").when(F.col("event_type") == "purchase", "expansion").when(F.col("event_type") == "error", "name_free")
    requests = events.select(F.col("user_id").alias("observation_id"), kind.alias("kind"), F.round("value").alias("duration_ms"))
    observations = events.select(F.col("user_id").alias("observation_id")).distinct().withColumns({"playlist_ms": F.col("observation_id") % 5, "total_ms": F.lit(10_000)})
    return O.retrieval_durations(requests, observations).select(F.col("observation_id").alias("user_id"), "retrieval_ms")


# Evaluation: each query expects the title that its words were taken from; what is found are the five best.

_CASES = "cases AS (SELECT q.query_id AS id, CASE WHEN t.id IS NULL THEN NULL ELSE t.title END AS want, CAST(substring(q.query_id, 2) AS BIGINT) % 97 AS ms FROM v_queries q LEFT JOIN v_titles t ON q.query_id = 'q' || CAST(100000 + CAST(t.id AS BIGINT) AS VARCHAR))"
_RESULTS = f"{_SCORED}, {_CASES}, results AS (SELECT c.id, ms, want IS NOT NULL AS positive, count(r.key) AS found, min(CASE WHEN upper(trim(r.title)) = upper(trim(want)) AND r.kind = 'track' THEN r.rank END) AS pos FROM cases c LEFT JOIN (SELECT * FROM ranked WHERE rank <= 5) r ON r.query_id = c.id GROUP BY c.id, ms, want)"


def _case_results(v):
    found = _ranked(v, lambda ranked: Sc.top_n(ranked, 5).select("query_id", F.col("rank").alias("position"), "kind", "title", "artist", "album")).withColumnRenamed("query_id", "id")
    wanted = v.titles.select(F.concat(F.lit("q"), (100_000 + F.col("id").cast("long")).cast("string")).alias("id"), F.array(F.struct(F.lit("track").alias("kind"), "title", F.lit(None).cast("string").alias("artist"), F.lit(None).cast("string").alias("album"))).alias("expected"))
    cases = v.queries.select(F.col("query_id").alias("id"), F.col("text").alias("query")).join(wanted, "id", "left")
    none = F.array().cast("array<struct<kind:string,title:string,artist:string,album:string>>")
    cases = cases.withColumns({"expected": F.coalesce("expected", none), "duration_ms": F.substring("id", 2, 20).cast("long") % 97, "error": F.lit(None).cast("string")})
    return E.case_results(E.match_expected(found, cases), cases)


@query(f"WITH {_RESULTS} SELECT id, positive, found, CAST(pos AS INT) AS position, coalesce(1.0 / pos, 0) AS reciprocal_rank, CASE WHEN positive THEN pos IS NOT NULL ELSE found = 0 END AS passed FROM results")
def case_results(v):
    return _case_results(v).select("id", "positive", "found", "position", "reciprocal_rank", "passed")


@query(f"""WITH {_RESULTS} SELECT count(*) AS total, count_if(positive) AS positive, count_if(NOT positive) AS no_match, count_if(CASE WHEN positive THEN pos IS NOT NULL ELSE found = 0 END) AS passed, count_if(positive AND pos = 1) AS top1, count_if(positive AND pos <= 5) AS top5,
  count_if(NOT positive AND found = 0) AS correct_no_match, round(coalesce(avg(CASE WHEN positive THEN coalesce(1.0 / pos, 0) END), 0), 9) AS mrr, round(avg(ms), 9) AS mean_ms, CAST(quantile_disc(ms, 0.95) AS DOUBLE) AS p95_ms FROM results""")
def evaluation_summary(v):
    return E.evaluation_summary(_case_results(v)).drop("errors").withColumns({"mrr": F.round("mrr", 9), "mean_ms": F.round("mean_ms", 9)})


# Logs.


@query("SELECT tool, call_id FROM (SELECT tool, call_id, row_number() OVER (PARTITION BY tool ORDER BY started_at DESC, call_id DESC) AS r FROM v_calls WHERE status NOT IN ('Completed', 'Failed')) WHERE r = 1")
def latest_job(v):
    return L.latest_job(v.calls, F.col("tool"), ["started_at", "call_id"], only_active=True).select("tool", "call_id")


@query("SELECT call_id FROM v_calls WHERE tool = 'click' AND status = 'Completed' ORDER BY started_at DESC, call_id DESC LIMIT 20 OFFSET 10")
def browse_log(v):
    return L.browse_log(v.calls, {"tool": " click ", "status": "Completed", "user_id": " "}, ["started_at", "call_id"], 10, 20)[1].select("call_id")


@query("SELECT call_id FROM v_calls WHERE status = 'Completed' ORDER BY started_at DESC, call_id DESC LIMIT 20 OFFSET 40")
def log_page_by_key(v):
    """The third page, each found behind the last row of the one before."""
    after = None
    for n in range(3):
        page = L.browse_log(v.calls, {"status": "Completed"}, ["started_at", "call_id"], 0, 20, after)[1].select("started_at", "call_id")
        if n < 2:
            last = page.orderBy("started_at", "call_id").first()
            after = tuple(last) if last else None
    return page.select("call_id")


@query("SELECT status, count(*) AS kept FROM v_calls WHERE NOT (started_at < TIMESTAMP '2024-01-15 00:00:00' AND status IN ('Completed', 'Failed') AND call_id <> 1) GROUP BY status")
def purge(v):
    calls = v.calls.withColumn("id", F.col("call_id").cast("string"))
    kept, _, _ = L.purge(calls, "started_at", F.lit("2024-01-15 00:00:00").cast("timestamp"), terminal_only=True, except_id="1")
    return kept.groupBy("status").agg(F.count("*").alias("kept"))


@query("SELECT call_id, CASE WHEN status = 'Running' THEN 'Interrupted' ELSE status END AS status, CASE WHEN status = 'Running' THEN greatest(0, (epoch_us(TIMESTAMP '2024-01-20 00:00:00') - epoch_us(started_at)) / 1000.0) ELSE duration_ms END AS duration_ms FROM v_calls")
def interrupt_running(v):
    calls = v.calls.withColumns({"completed_at": F.lit(None).cast("timestamp"), "error_message": F.lit(None).cast("string"), "started_at": F.col("started_at").cast("timestamp")})
    return L.interrupt_running(calls, F.lit("2024-01-20 00:00:00").cast("timestamp")).select("call_id", "status", "duration_ms")


@query("SELECT doc_id, md5(CASE WHEN length(text) > 2000 THEN '{\"truncated\":true,\"originalCharacterCount\":' || length(text) || ',\"prefix\":' || CAST(to_json(substring(text, 1, 1744)) AS VARCHAR) || '}' ELSE text END) AS bounded FROM documents")
def bound_json(v):
    docs = v.spark.read.parquet(f"{v.dir}/documents.parquet")
    return docs.select("doc_id", F.md5(S.bound_json(F.col("text"), 2000)).alias("bounded"))


@query("SELECT event_id AS call_id, CASE event_type WHEN 'error' THEN NULL WHEN 'view' THEN 'Rating: ≥ ' || json_extract_string(props, '$.k') ELSE 'Rating: ' || json_extract_string(props, '$.k') END AS summary FROM events")
def request_summary(v):
    arguments = F.replace("arguments", F.lit('"k"'), F.when(F.col("tool") == "view", '"ratingMatch":"at_least","rating"').otherwise('"rating"'))
    calls = v.calls.withColumns({"arguments": arguments, "arguments_truncated": F.lit(False)})
    return L.request_summary(calls.withColumn("tool", F.when(F.col("tool") == "error", "get_queue").otherwise("search")))


@query("SELECT event_id, 'browseRef' AS path, 'r' || event_id % 50 AS reference, CASE WHEN event_id % 50 < 20 THEN 'title ' || event_id % 50 END AS title FROM events WHERE event_type = 'view' UNION ALL SELECT event_id, 'items[1]', CASE event_id % 4 WHEN 0 THEN '0f' || event_id % 50 WHEN 1 THEN '-' || event_id % 50 WHEN 2 THEN '[' || event_id % 50 ELSE 'null' END, NULL FROM events WHERE event_type = 'click'")
def reference_snapshots(v):
    number = (F.col("call_id") % 50).cast("string")
    arguments = F.when(F.col("tool") == "view", F.concat(F.lit('{"browseRef":"r'), number, F.lit('"}'))).otherwise(F.concat(F.lit('{"items":[5,"'), F.element_at(F.array(F.concat(F.lit("0f"), number), F.concat(F.lit("-"), number), F.concat(F.lit("["), number), F.lit("null")), (F.col("call_id") % 4 + 1).cast("int")), F.lit('",{"a":1},null,true,["x"]]}')))
    calls = v.calls.where("tool in ('view', 'click')").withColumns({"arguments": arguments, "tool": F.when(F.col("tool") == "view", "browse").otherwise("play")})
    known = v.spark.range(20).select(F.concat(F.lit("r"), F.col("id").cast("string")).alias("reference"), F.concat(F.lit("title "), F.col("id").cast("string")).alias("title"))
    return L.reference_snapshots(calls, known).select(F.col("call_id").alias("event_id"), "path", "reference", "title")


@query("SELECT report_id, message FROM (SELECT DISTINCT 'u' || user_id AS report_id, substring(event_type, 1, 4) AS message FROM events WHERE user_id % 3 > 0 AND event_type = 'error' AND user_id >= 20) UNION ALL SELECT NULL, substring(event_type, 1, 4) FROM events WHERE user_id % 3 = 0 AND event_type = 'error'")
def ingest_errors(v):
    errors = v.calls.where("tool = 'error'").select(F.when(F.col("user_id") % 3 > 0, F.concat(F.lit("u"), F.col("user_id").cast("string"))).alias("report_id"), F.concat(F.lit("  "), F.col("tool")).alias("message"))
    stored = v.spark.range(20).select(F.concat(F.lit("u"), F.col("id").cast("string")).alias("report_id"))
    return L.ingest_errors(stored, errors, {"message": 4})


@query("""SELECT event_id, CASE WHEN event_id % 5 > 0 AND user_id % 7 > 0 AND event_type <> 'error' THEN '["scan","u' || user_id || '","' || event_id || '"]' END AS token FROM events""")
def change_token(v):
    rows = v.spark.read.parquet(f"{v.dir}/events.parquet")
    token = N.change_token(F.when(F.col("user_id") % 7 > 0, F.concat(F.lit(" u"), F.col("user_id").cast("string"))), F.col("event_id").cast("string"), F.when(F.col("event_id") % 5 == 0, "1").otherwise("0"), F.when(F.col("event_type") == "error", "yes"))
    return rows.select("event_id", token.alias("token"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_name END AS title, CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_size END AS disc, CASE WHEN p_partkey % 4 = 0 THEN 'title is missing' WHEN p_size * 3 > 100 THEN 'rating is above 100' END AS reason FROM part""")
def validate_rows(v):
    part = v.spark.read.parquet(f"{v.dir}/part.parquet")
    number = F.col("p_partkey").cast("string")
    raw = part.select(number.alias("id"), F.when(F.col("p_partkey") % 4 == 0, "  ").otherwise(F.concat(F.lit(" "), "p_name")).alias("title"), F.lit("file://x").alias("url"), F.lit("0").alias("remote"), F.when(F.col("p_size") % 3 == 0, "0").otherwise(F.col("p_size").cast("string")).alias("disc"), (F.col("p_size") * 3).cast("string").alias("rating"))
    good, bad = N.validate_rows(N.type_rows(raw, "tracks"), "tracks")
    out = good.select("source_id", "title", "disc", F.lit(None).cast("string").alias("reason")).unionByName(bad.select("source_id", "title", "disc", F.col("reasons")[0].alias("reason")))
    return out.select(F.col("source_id").cast("long").alias("p_partkey"), "title", "disc", "reason")


@query("SELECT s_suppkey AS supplier, len(list_distinct(list_filter(list_transform(string_split(parts, ','), lambda x: trim(x)), lambda x: x <> ''))) AS ids FROM (SELECT l_suppkey AS s_suppkey, string_agg(CASE WHEN l_partkey % 9 = 0 THEN '' ELSE ' ' || l_partkey END, ',') AS parts FROM lineitem GROUP BY l_suppkey)")
def split_ids(v):
    """The lists of suppliers with an even key are JSON arrays, of strings and numbers."""
    rows = v.spark.read.parquet(f"{v.dir}/lineitem.parquet").groupBy(F.col("l_suppkey").alias("supplier")).agg(F.array_join(F.collect_list(F.when(F.col("l_partkey") % 9 == 0, "").otherwise(F.concat(F.lit(" "), F.col("l_partkey").cast("string")))), ",").alias("parts"))
    array = F.concat(F.lit(" ["), F.array_join(F.transform(F.split("parts", ","), lambda x: F.when(F.length(x) % 2 == 0, F.concat(F.lit('"'), x, F.lit('"'))).otherwise(F.coalesce(F.nullif(F.trim(x), F.lit("")), F.lit("null")))), ","), F.lit("]"))
    rows = rows.withColumn("parts", F.when(F.col("supplier") % 2 == 0, array).otherwise(F.col("parts")))
    return rows.select("supplier", F.size(S.split_ids(F.col("parts"))).cast("long").alias("ids"))


# Without SQL: phonetic and cardinal signals, and the whole search.


@query()
def title_search(v):
    shows = v.singers.select("id", "title")
    return Ti.title_search(v.queries, shows, ["zz"]).select("query_id", "id", "score", "signal", "place")


@query()
def full_search(v):
    number = F.substring("query_id", 2, 20).cast("long")
    asked = v.queries.withColumns({"rating": F.when(number % 7 == 0, 3.0), "match": F.when(number % 7 == 0, "at_least"), "genre": F.when(number % 11 == 0, "en"), "from_year": F.when(number % 13 == 0, 80), "to_year": F.when(number % 13 == 0, 99)})
    asked = asked.withColumn("text", F.when(number % 17 == 0, "").otherwise(F.col("text")))
    return P.search(asked, _docs(v), "seed", 2026, titles=v.singers.select("id", "title"), phrases=["zz"])
