import json
import uuid

import pytest
from pyspark.sql import functions as F

from quaverlake.operators import evaluate as E
from quaverlake.operators import index as I
from quaverlake.operators import ingest as N
from quaverlake.operators import reconcile as C
from quaverlake.operators import stored as St
from quaverlake.sources.generations import open_index, publish_index
from quaverlake.sources.pages import audit_pages, read_pages
from quaverlake.streaming import streams as W


def page(path, count, rows):
    path.write_text(json.dumps({"id": 1, "result": {"count": count, "artists_loop": rows}}))


def test_pages(spark, tmp_path):
    page(tmp_path / "1.json", 3, [{"id": 1, "artist": " A "}, {"id": "2", "artist": "B"}])
    page(tmp_path / "2.json", "3", [{"id": 3, "artist": ""}])
    rows = read_pages(spark, str(tmp_path), "artists")
    assert audit_pages(rows).first().status == "ok"
    good, bad = N.validate_rows(N.type_rows(rows, "artists"), "artists")
    assert sorted((r.source_id, r.name) for r in good.collect()) == [("1", "A"), ("2", "B")]
    assert [r.reasons for r in bad.collect()] == [["name is missing"]]
    with pytest.raises(ValueError):
        N.validate_rows(N.type_rows(rows, "artists"), "artists", strict=True)
    page(tmp_path / "3.json", 3, [{"id": 4}])
    assert audit_pages(read_pages(spark, str(tmp_path), "artists")).first().status == "too many rows"
    page(tmp_path / "3.json", 4, [])
    assert audit_pages(read_pages(spark, str(tmp_path), "artists")).first().status == "count changed"


def test_snapshot_checks(spark):
    rows = lambda *x: spark.createDataFrame(x, "id string, title string")
    assert C.replace_snapshot(None, rows(("a", "t")), "s").first().snapshot_id == "s"
    two = C.replace_snapshot(C.replace_snapshot(None, rows(("a", "t")), "s"), rows(("a", "u"), ("b", "v")), "s2")
    assert sorted((r.id, r.snapshot_id) for r in two.collect()) == [("a", "s"), ("a", "s2"), ("b", "s2")]
    kept, state = C.activate_snapshot(two, "s2")
    assert sorted(r.title for r in C.active_rows(two, state).collect()) == sorted(r.title for r in kept.collect()) == ["u", "v"]
    with pytest.raises(ValueError):
        C.replace_snapshot(two, rows(("c", "t")), "s2")
    for bad, more in ((rows(("a", "t"), ("a", "u")), {}), (rows((" ", "t")), {}), (rows(("a", None)), {}), (rows(("a", "t")), {"available": False}), (rows(("a", "t"), ("b", "u")), {"limit": 1})):
        with pytest.raises(ValueError):
            C.replace_snapshot(None, bad, "s", **more)


def test_generations(spark, tmp_path):
    docs = spark.createDataFrame([("track", "1", "MTV Night", None, None, 0, [], None, [])], I.DOCUMENT)
    build = lambda docs: {"documents": docs, "lookup_terms": I.lookup_terms(docs), "token_postings": I.token_postings(docs), "trigram_postings": I.trigram_postings(docs)}
    index, root = build(docs), f"file://{tmp_path}/index"
    with pytest.raises(ValueError, match="no index"):
        open_index(spark, root, "v1")
    assert [publish_index(spark, index, root, "v1") for _ in range(3)] == [1, 2, 3]
    assert sorted(p.name for p in (tmp_path / "index" / "documents").iterdir()) == ["slot=0", "slot=1"]
    assert open_index(spark, root, "v1")["lookup_terms"].where("lane = 'normalised'").count() == index["lookup_terms"].where("lane = 'normalised'").count()
    with pytest.raises(ValueError, match="version v1"):
        open_index(spark, root, "v2")
    with pytest.raises(ValueError, match="without documents"):
        publish_index(spark, index | {"documents": docs.limit(0)}, root, "v1")
    assert open_index(spark, root, "v1")["documents"].count() == 1
    # The new generation is complete before it counts, and the slot that it replaced holds nothing else.
    old = open_index(spark, root, "v1")["documents"]
    publish_index(spark, build(docs.unionByName(docs.withColumn("id", F.lit("2")))), root, "v2")
    assert old.count() == 1 and open_index(spark, root, "v2")["documents"].count() == 2


def test_corpus(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"schemaVersion": 1, "extra": 0, "cases": [{"id": "a-b", "query": "x", "category": "c", "expected": [{"kind": "track", "title": " "}]}, {"id": "A", "query": " y", "category": "", "more": 1, "expected": None}]}))
    cases = E.read_corpus(spark, f"file://{tmp_path}/c.json")
    assert sorted(cases.first().unknown) == ["extra", "more"]
    got = {(r.location, r.error) for r in E.validate_corpus(cases).collect()}
    assert got == {("members", "unknown member extra"), ("members", "unknown member more"), ("cases[0].expected[0]", "title is blank"), ("cases[1]", "id is not kebab case"), ("cases[1]", "query is blank or not trimmed"), ("cases[1]", "category is blank or not trimmed"), ("cases[1]", "expected is missing")}


def test_corpus_without_cases_or_version(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"schemaVersion": 2, "cases": []}))
    got = {(r.location, r.error) for r in E.validate_corpus(E.read_corpus(spark, f"file://{tmp_path}/c.json")).collect()}
    assert got == {("schemaVersion", "version is not 1"), ("cases", "no cases")}


def test_metrics_of_two_cases(spark):
    results = spark.createDataFrame([("a", True, 2, 2, 0.5, True, False, 10.0), ("b", False, 0, None, 0.0, True, False, 30.0)], "id string, positive boolean, found long, position int, reciprocal_rank double, passed boolean, failed boolean, duration_ms double")
    r = E.evaluation_summary(results).first()
    assert (r.total, r.passed, r.top1, r.top5, r.mrr, r.correct_no_match, r.p95_ms) == (2, 2, 0, 1, 0.5, 1, 30.0)
    assert E.evaluation_summary(results.limit(0)).first().mrr == 0


def drain(query):
    query.awaitTermination(120)


PAGE = "source_id string, title string, artists array<string>, genres array<string>, statistics array<struct<source: string, native_rating: int>>, pos long"


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set(name, before)
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_pages_as_a_stream_converge(spark, tmp_path, rocks):
    """Pages with artists, genres and statistics; replays, older rows, and a restart with and without the old checkpoint."""
    tables = {k: f"s_{uuid.uuid4().hex}" for k in ("tracks", "artists", "genres", "statistics")}
    none = lambda schema: spark.createDataFrame([], schema)
    St.create_table(none("source_id string, title string, seen_refresh_id string"), tables["tracks"], "source_id", f"file://{tmp_path}/tracks", bands=2, buckets=2)
    St.create_table(none("track_id string, artist_id string, pos int"), tables["artists"], "track_id", f"file://{tmp_path}/artists", bands=2, buckets=2)
    St.create_table(none("track_id string, genre_id string, pos int"), tables["genres"], "track_id", f"file://{tmp_path}/genres", bands=2, buckets=2)
    St.create_table(none("track_id string, source string, native_rating int"), tables["statistics"], "track_id", f"file://{tmp_path}/statistics", bands=2, buckets=2)
    pages = 0

    def arrive(*rows):
        nonlocal pages
        pages += 1
        spark.createDataFrame(rows, PAGE).coalesce(1).write.parquet(f"{tmp_path}/in/{pages}")

    def run(checkpoint, at_once=1):
        stream = spark.readStream.schema(PAGE).option("maxFilesPerTrigger", at_once).parquet(f"{tmp_path}/in/*")
        changes = W.stream_pages(stream, "source_id", "pos")
        writer = W.write_pages(changes, tables, "r", {"artists": ("track_id", "artist_id"), "genres": ("track_id", "genre_id")}, "statistics")
        query = writer.option("checkpointLocation", f"{tmp_path}/{checkpoint}").trigger(availableNow=True).start()
        drain(query)
        read = lambda t, *c: sorted(tuple(r) for r in St.read_table(spark, tables[t]).select(*c).collect())
        return read("tracks", "source_id", "title"), read("artists", "track_id", "artist_id", "pos"), read("genres", "track_id", "genre_id"), read("statistics", "track_id", "source", "native_rating")

    arrive(("a", "one", ["x", "y", "x"], ["g"], [("core", 20), ("other", 5), ("core", 40)], 1), ("a", "two", ["y"], None, [("core", 60)], 2), ("b", "x", None, ["g", "h"], None, 1), (None, "lost", None, None, None, 1))
    want = ([("a", "two"), ("b", "x")], [("a", "y", 0)], [("b", "g"), ("b", "h")], [("a", "core", 60)])
    assert run("cp") == want
    arrive(("a", "one", ["x"], ["g"], None, 1), ("b", "x", None, ["g", "h"], None, 1))  # a replay, and a row that is older than what is known
    assert run("cp") == want
    arrive(("b", "y", ["z", "x"], [], [("core", 1), ("core", 2)], 5), ("c", "new", [], [], [], 1))
    want = ([("a", "two"), ("b", "y"), ("c", "new")], [("a", "y", 0), ("b", "x", 1), ("b", "z", 0)], [], [("a", "core", 60), ("b", "core", 2)])
    assert run("cp") == want
    assert run("another", 9) == want  # all pages again, without what was known
    for name in tables.values():
        spark.sql(f"DROP TABLE {name}")


def test_tool_calls_as_a_stream(spark, tmp_path):
    events = [("c1", "play", "started", "2024-01-01 00:00:00"), ("c1", "play", "completed", "2024-01-01 00:00:02"), ("c1", "play", "failed", "2024-01-01 00:00:03"), ("c2", "play", "started", "2024-01-01 00:00:00"), ("c3", "play", "completed", "2024-01-01 00:00:00")]
    late = [("c9", "play", "started", "2024-01-02 00:00:00")]
    schema = "call_id string, tool string, event string, at string"
    for name, part in (("1", events), ("2", late), ("3", [("c8", "play", "started", "2024-01-03 00:00:00")])):
        spark.createDataFrame(part, schema).withColumn("at", F.col("at").cast("timestamp")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{name}")
    stream = spark.readStream.schema("call_id string, tool string, event string, at timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    out = W.stream_tool_calls(stream)
    drain(out.writeStream.format("memory").queryName("calls").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start())
    got = {(r.call_id, r.status, r.duration_ms) for r in spark.table("calls").collect() if r.status != "Interrupted"}
    assert got == {("c1", "Completed", 2000.0)}
    assert "c2" in {r.call_id for r in spark.table("calls").where("status = 'Interrupted'").collect()}


def test_timeout_reaches_the_workers(spark, tmp_path):
    """A call that is open longer than a short timeout is interrupted, and one within a long one is not."""
    rows = [("c1", "play", "started", "2024-01-01 00:00:00"), ("c9", "play", "started", "2024-01-01 00:20:00"), ("c8", "play", "started", "2024-01-01 00:40:00")]
    schema = "call_id string, tool string, event string, at string"
    for i, row in enumerate(rows):
        spark.createDataFrame([row], schema).withColumn("at", F.col("at").cast("timestamp")).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    for name, timeout, want in (("short", "1 minute", {"c1", "c9"}), ("long", "3 hours", set())):
        stream = spark.readStream.schema("call_id string, tool string, event string, at timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
        drain(W.stream_tool_calls(stream, timeout).writeStream.format("memory").queryName(f"calls_{name}").option("checkpointLocation", f"{tmp_path}/cp_{name}").trigger(availableNow=True).start())
        got = {r.call_id for r in spark.table(f"calls_{name}").where("status = 'Interrupted'").collect()}
        assert got >= {"c1"} & want and got <= want


def test_errors_and_selections_as_streams(spark, tmp_path):
    spark.createDataFrame([("r1", "2024-01-01"), ("r1", "2024-01-02"), (None, "2024-01-01"), ("r2", "2024-01-01")], "report_id string, at string").withColumn("at", F.col("at").cast("timestamp")).coalesce(1).write.parquet(f"{tmp_path}/e")
    errors = W.stream_errors(spark.readStream.schema("report_id string, at timestamp").parquet(f"{tmp_path}/e"))
    drain(errors.writeStream.format("memory").queryName("errors").option("checkpointLocation", f"{tmp_path}/c1").trigger(availableNow=True).start())
    assert sorted(str(r.report_id) for r in spark.table("errors").collect()) == ["None", "r1", "r2"]
    stamp = lambda rows, schema, at: spark.createDataFrame(rows, schema).withColumn(at, F.col(at).cast("timestamp")).coalesce(1)
    stamp([("k1", "o", 2, "2024-01-01 10:00:00")], "correlation_id string, observation_id string, position int, shown_at string", "shown_at").write.parquet(f"{tmp_path}/k")
    stamp([("k1", "2024-01-01 11:00:00"), ("k1", "2024-01-01 12:00:00"), ("k9", "2024-01-01 12:00:00")], "correlation_id string, selected_at string", "selected_at").write.parquet(f"{tmp_path}/s")
    shown = spark.readStream.schema("correlation_id string, observation_id string, position int, shown_at timestamp").parquet(f"{tmp_path}/k")
    chosen = spark.readStream.schema("correlation_id string, selected_at timestamp").parquet(f"{tmp_path}/s")
    drain(W.stream_selections(shown, chosen).writeStream.format("memory").queryName("picked").option("checkpointLocation", f"{tmp_path}/c2").trigger(availableNow=True).start())
    assert [(r.correlation_id, r.position) for r in spark.table("picked").collect()] == [("k1", 2)]
