"""Rules that no query of the tables exercises alone."""

import pytest
from pyspark.sql import functions as F

from quaverlake.functions import text as T
from quaverlake.operators import evaluate as E
from quaverlake.operators import index as I
from quaverlake.operators import ingest as N
from quaverlake.operators import observe as O
from quaverlake.operators import oplog as L
from quaverlake.operators import paging as Pg
from quaverlake.operators import retrieve as R
from quaverlake.operators import score as Sc
from quaverlake.operators import select as A
from quaverlake.plans import search as P
from quaverlake.sources.pages import read_tables, write_tables

QUERY = "query_id string, text string, rating double, match string, genre string, from_year int, to_year int"


def test_each_rule_of_a_query(spark):
    rows = {
        "long": ("x" * 501, None, None, None, None, None), "genre": ("a", None, None, "g" * 501, None, None), "words": ("a " * 21, None, None, None, None, None), "marks": ("?!", None, None, None, None, None),
        "rating": ("a", 5.5, "exact", None, None, None), "match": ("a", 4.0, "about", None, None, None), "none": ("a", 4.0, None, None, None, None), "stars": ("songs with 4+ stars", None, None, None, None, None), "rated": ("rated 5 songs", None, None, None, None, None),
        "years": ("a", None, None, None, 1990, None), "fine": ("a" * 500, 0.0, "at_least", "g" * 500, 1990, 1999), "blank": ("  ", None, None, None, None, None), "twenty": ("a " * 20, None, None, None, None, None), "null": (None, None, None, None, None, None),
    }
    got = {r.query_id: r.error for r in P.validate_queries(spark.createDataFrame([(k, *v) for k, v in rows.items()], QUERY)).collect()}
    assert got == {
        "long": "text is too long", "genre": "genre is too long", "words": "too many words", "marks": "no words", "rating": "rating is not from 0 to 5", "match": "unknown match", "none": "unknown match",
        "stars": "rating in the name", "rated": "rating in the name", "years": "one end of the years is missing", "fine": None, "blank": None, "twenty": None, "null": None,
    }


def test_interpretation(spark):
    rows = [("a", "x", 4.0, "exact", None, None, None), ("b", " ", None, None, "g", None, None), ("c", None, None, None, None, 1990, 1991), ("d", "", None, None, None, None, None)]
    assert {r.query_id: r.interpretation for r in P.interpret(spark.createDataFrame(rows, QUERY)).collect()} == {"a": "named", "b": "filtered", "c": "filtered", "d": "discovery"}


def test_drift_totals_and_refreshes(spark):
    schema = "source string, uuid string, version string, albums long, tracks long"
    first = spark.createDataFrame([("s", "u", "8", 5, None), ("t", "u", "8", 5, 9)], schema)
    last = spark.createDataFrame([("s", "u", "9", None, None), ("t", "u", "8", 5, 9), ("new", "v", None, 1, 1)], schema)
    assert {r.source: r.drifted for r in N.status_drift(first, last, ["uuid", "version", "albums", "tracks"]).collect()} == {"s": ["version", "albums"], "t": [], "new": ["uuid", "albums", "tracks"]}
    assert {r.source: r.mismatches for r in N.total_mismatches(first, last, ["albums", "tracks"]).collect()} == {"s": 1, "t": 0}
    tokens = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", None), ("d", "4")], "source string, token string")
    known = spark.createDataFrame([("a", "1"), ("b", "0"), ("c", "3")], "source string, token string")
    assert {r.source: r.changed for r in N.needs_refresh(tokens, known).collect()} == {"a": False, "b": True, "c": False, "d": True}


def test_spoken_digits_and_forms(spark):
    words = ["route 66b", "7", "", "MTV", "Part IV", "no digits"]
    backwards = I.EquivalenceProvider("backwards", "backwards", 1210, lambda c: F.array(F.reverse(T.compact(T.normalise(c)))), lambda span, number, whole: F.array(F.reverse(T.compact(span))))
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", T.expand_digits(T.normalise(F.col("w"))).alias("d"), I.text_forms(F.col("w"), providers=[I.ACRONYM, I.CARDINAL, backwards]).alias("f")).collect()
    assert [r.d for r in rows] == ["route six six b", "seven", "", "mtv", "part iv", "no digits"]
    f = {r.w: r.f for r in rows}
    assert f["route 66b"].spoken == "route six six b" and f["MTV"].acronym and not f["Part IV"].acronym and f["Part IV"].roman_cardinal == ["cardinal:4 part"]
    assert f["no digits"].backwards == ["stigidon"] and f["7"].double_metaphone == ["SFN"] and f[""].tokens == []
    # What an added provider knows is in the index, in the lanes and in the scores.
    docs = spark.createDataFrame([("track", "1", "abc", None, None, 0, [], None, [])], I.DOCUMENT)
    asked = spark.createDataFrame([("q", "cba")], "query_id string, text string")
    reverse = I.EquivalenceProvider("backwards", "backwards", 1210, backwards.indexed, lambda span, number, whole: F.array(T.compact(span)))
    found = R.lookup_candidates(asked, I.lookup_terms(docs, providers=[reverse]), providers=[reverse])
    assert [(r.lane, r.key) for r in found.collect()] == [("backwards", "track:1")]
    assert [(r.signal, r.score) for r in Sc.score_candidates(found, docs, asked, providers=[reverse]).where("field = 'title'").collect()] == [("backwards", 1210)]


def test_genres_exact_titles_and_tables(spark, tmp_path):
    docs = spark.createDataFrame([("track", "1", "The Show", "x", None, 0, ["a", " "], None, ["POP", "", "POP"]), ("album", "2", "the show!", None, None, 0, [], None, [])], I.DOCUMENT)
    assert [tuple(r) for r in I.document_genres(docs).collect()] == [("track:1", "POP")] and [tuple(r) for r in I.document_artists(docs).collect()] == [("track:1", "a")]
    asked = spark.createDataFrame([("q", "THE show"), ("r", "show")], "query_id string, text string")
    every = asked.select("query_id").crossJoin(docs.select(I.stable_key().alias("key")))
    ranked = Sc.rank(Sc.score_candidates(every, docs, asked, phonetic=False), docs, asked)
    assert {(r.query_id, r.key): r.exact_title for r in ranked.collect()} == {("q", "track:1"): True, ("q", "album:2"): True, ("r", "track:1"): False, ("r", "album:2"): False}
    write_tables({"docs": docs, "asked": asked}, f"file://{tmp_path}/t")
    back = read_tables(spark, f"file://{tmp_path}/t", ["docs", "asked"])
    assert sorted(back["docs"].collect()) == sorted(docs.collect()) and back["asked"].count() == 2


def test_report_is_written_with_its_cases(spark, tmp_path):
    results = spark.createDataFrame([("a", True, 1, 1, 1.0, True, False, 10.0)], "id string, positive boolean, found long, position int, reciprocal_rank double, passed boolean, failed boolean, duration_ms double")
    E.write_report(E.evaluation_summary(results), results, f"file://{tmp_path}/r")
    assert spark.read.json(f"file://{tmp_path}/r/summary").first().mrr == 1.0 and spark.read.json(f"file://{tmp_path}/r/cases").first().id == "a"


def test_exact_artist(spark):
    schema = "query_id string, key string, kind string, id string, exact_title boolean"
    rows = [("one", "artist:a", "artist", "a", True), ("one", "track:t", "track", "t", False), ("two", "artist:a", "artist", "a", True), ("two", "artist:b", "artist", "b", True), ("song", "artist:a", "artist", "a", True), ("song", "track:t", "track", "t", True)]
    rows += [("own", "artist:a", "artist", "a", True), ("own", "album:1", "album", "1", True), ("other", "artist:a", "artist", "a", True), ("other", "album:2", "album", "2", True), ("unknown", "artist:a", "artist", "a", True), ("unknown", "album:3", "album", "3", True), ("none", "artist:a", "artist", "a", False)]
    canonical = spark.createDataFrame([("album:1", "a"), ("album:2", "b")], "key string, artist_id string")
    got = A.exact_artist(spark.createDataFrame(rows, schema), canonical).collect()
    assert sorted((r.query_id, r.key, r.id) for r in got) == [("one", "artist:a", "a"), ("own", "artist:a", "a")]


def test_regular_tracks_leave_out_top_tracks(spark):
    rows = spark.range(60).selectExpr("'q' query_id", "concat('k', id) key", "concat('al', id % 7) album", "cast(90 as int) native_rating", "1120 score")
    top = A.top_tracks(rows, "s")
    rest = A.regular_tracks(rows, top, "s")
    assert top.count() == 5 and rest.count() == 30 and sorted(r.place for r in rest.collect()) == list(range(1, 31))
    assert not {r.key for r in top.collect()} & {r.key for r in rest.collect()}
    few = rows.limit(8)
    assert A.regular_tracks(few, A.top_tracks(few, "s"), "s").count() == 3


def test_preview_pins_the_own_title(spark):
    albums = spark.createDataFrame([("q", f"album:{k}", "Name" if k == 6 else f"t{k}", "x") for k in range(9)], "query_id string, key string, title string, album string")
    asked = spark.createDataFrame([("q", "name")], "query_id string, title string")
    got = A.artist_preview(albums, asked, "s").orderBy("place").collect()
    assert [r.place for r in got] == [1, 2, 3, 4, 5] and got[0].key == "album:6" and got[0].pinned and not got[1].pinned and {r.discography_count for r in got} == {9}
    assert A.artist_preview(albums, asked, "s", tracks_only=F.lit(True)).collect() == []


def test_weights_show_in_first_places(spark):
    """Chi-square over 3,000 seeds: of albums of one track each, one stands first as often as its weight says; equal weights are drawn alike."""
    tracks = spark.createDataFrame([("a", 80), ("b", 90), ("c", 100)], "key string, native_rating int")
    rows = spark.range(3000).selectExpr("cast(id as string) query_id").crossJoin(tracks).selectExpr("query_id", "key", "key album", "native_rating", "1 score")
    for weight, odds in ((A.rating_weight(F.col("native_rating")), {"a": 1 / 6, "b": 2 / 6, "c": 3 / 6}), (None, {"a": 1 / 3, "b": 1 / 3, "c": 1 / 3})):
        first = {r.key: r["count"] for r in A.rotate(rows, ["query_id"], 1, "seed", weight=weight).groupBy("key").count().collect()}
        assert sum((first[k] - 3000 * p) ** 2 / (3000 * p) for k, p in odds.items()) < 13.8  # the 0.1 % point of two degrees of freedom


def test_pages_by_key_are_pages_by_offset(spark):
    schema = "id int, a int, b string"
    rows = spark.createDataFrame([(k, [None, 1, 2, 2, 3][k % 5], [None, "x", "y"][k % 3]) for k in range(47)], schema)
    for order in ([("a", True), ("b", False), ("id", False)], [("a", False), ("b", True), ("id", True)]):
        columns = [(F.col(c), falls) for c, falls in order]
        want = [r.id for r in rows.orderBy(*[c.desc() if falls else c.asc() for c, falls in columns]).collect()]
        got, after = [], None
        while page := Pg.page_after(rows, columns, after, 10).collect():
            got += [r.id for r in page]
            after = tuple(page[-1][c] for c, _ in order)
        assert got == want
    plan = Pg.page_after(rows, [(F.col("id"), False)], (20,), 10)._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in plan and "Offset" not in plan
    log = rows.select(F.col("id"), F.col("id").alias("at"), F.lit("t").alias("tool"))
    page = lambda **more: [r.id for r in L.browse_log(log, {"tool": "t"}, ["at", "id"], limit=10, **more)[1].collect()]
    assert page(after=(37, 37)) == page(offset=10) == list(range(36, 26, -1))
    seen = rows.select(F.col("id").alias("observation_id"), F.col("id").alias("created_at"))
    assert [r.observation_id for r in O.browse_observations(seen, F.lit(True), limit=5, after=(10, 10))[1].collect()] == [9, 8, 7, 6, 5]


def test_rating_pages_by_key(spark):
    docs = spark.createDataFrame([("track", str(k), ["B", "a", "b", None][k % 4], None, ["X", "x"][k % 2], [85, 90, 99, 100][k % 4 if k % 5 else 0], [], None, []) for k in range(70)], I.DOCUMENT)
    want = [r.key for r in A.rating_browse(docs, 100).where("bucket = 4").orderBy("n").collect()]
    got, after, more = [], None, True
    while more:
        page = A.rating_page(docs, 4, after, 9).collect()
        got, more = got + [r.key for r in page], page[-1].has_more
        after = (page[-1].native_rating, page[-1].title, page[-1].artist, page[-1].album, page[-1].key)
    assert got == want and len(want) > 40
