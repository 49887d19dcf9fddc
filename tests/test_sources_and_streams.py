"""Scans, sinks, the query log and the streams."""

import itertools
import json
import re

import pytest
from pyspark.sql import functions as F

from evidra.functions.table_functions import register
from evidra.functions.text import STRATEGIES, chunks
from evidra.operators.graph import decompose
from evidra.operators.merge import append_merge, upsert_graph
from evidra.sources.listing import Listing, read_listing, write_listing
from evidra.sources.records import keyed, list_packages, parse_xml, read_corpus, read_golden, write_corpus
from evidra.sources.seed import golden, seed_bills
from evidra.sources.snapshots import Store
from evidra.streaming import trace as T
from evidra.sources.xml_files import broken_xml, documents, scan_xml
from evidra.streaming.state import PROVIDER, steps_of


def test_corpus_round_trip_and_fallback(spark, tmp_path):
    b = seed_bills(spark)
    assert b.count() == 16 and b.where("bill_id = '118-HR-22'").first()["ordinal"] == 4
    assert read_corpus(spark, f"{tmp_path}/none").count() == 0
    rows = [json.loads(r) for r in b.drop("bill_id", "ordinal").toJSON().collect()]
    (tmp_path / "seed.json").write_text(json.dumps(rows))
    got = read_corpus(spark, f"{tmp_path}/ingested.json", f"{tmp_path}/seed.json")
    assert got.count() == 16 and {r[0] for r in got.select("corpus_source").distinct().collect()} == {"seed"}
    (tmp_path / "ingested.json").write_text(json.dumps(rows[:2]))
    got = read_corpus(spark, f"{tmp_path}/ingested.json", f"{tmp_path}/seed.json")
    assert got.count() == 2 and got.first()["corpus_source"] == "ingested"
    write_corpus(got.drop("bill_id"), f"{tmp_path}/out")
    assert read_corpus(spark, f"{tmp_path}/out").count() == 2
    broken = spark.createDataFrame([("118", "hr", None), (None, "hr", "1"), ("118", "hr", "2")], "congress string, bill_type string, bill_number string")
    assert [r["bill_id"] for r in keyed(broken).collect()] == ["118-HR-2"]


def test_golden_set(spark, tmp_path):
    rows = [{"query": r["query"], "relevant": r["relevant"], "note": "n"} for r in golden(spark).collect()]
    (tmp_path / "g.json").write_text(json.dumps(rows))
    assert read_golden(spark, f"{tmp_path}/g.json").count() == 6


def test_xml_that_is_no_bill(spark):
    rows = [("a", "<billStatus><bill><congress>118</congress><type>HR</type><number>1</number><title> T </title></bill></billStatus>"), ("b", "<other/>"), ("c", "<billStatus><bill>"), ("d", None), ("e", "")]
    df = spark.createDataFrame(rows, "source string, xml string")
    got = parse_xml(df, "xml", "2025-06-30").collect()
    assert [r["source"] for r in got] == ["a"] and got[0]["title"] == "T" and got[0]["sponsor"] is None and got[0]["committees"] == [] and got[0]["outcome"] == "died_in_committee"
    long = df.where("source = 'a'").withColumn("xml", F.replace("xml", F.lit("</bill>"), F.lit("<summaries><summary><text>one two three</text></summary></summaries></bill>")))
    assert parse_xml(long, "xml", "2025-06-30", max_summary=7).first()["summary"] == "one two"


def test_listing(spark):
    df = spark.createDataFrame([(f"BILLSTATUS-118hr{i}", f"2024-01-{i:02d}") for i in range(1, 20)] + [("BILLSTATUS-117s1", "2024-01-05")], "package_id string, last_modified string")
    assert list_packages(df, "BILLSTATUS-118", "2024-01-10").count() == 10 and list_packages(df, "BILLSTATUS-118", "2024-01-10", 3).count() == 3


def test_upserts(spark):
    b = seed_bills(spark)
    nodes, edges = decompose(b.limit(10))
    again = b.where("ordinal < 3").withColumn("title", F.lit("another"))
    n, e = upsert_graph(nodes, edges, *decompose(again))
    assert e.count() == edges.count() and n.where("name = 'another'").count() == 3 and n.count() == nodes.count()
    chunks = spark.createDataFrame([("a#0", "x"), ("a#1", "y")], "chunk_id string, text string")
    assert sorted(map(tuple, append_merge(chunks, chunks.where("chunk_id = 'a#1'").withColumn("text", F.lit("z")), ["chunk_id"]).collect())) == [("a#0", "x"), ("a#1", "z")]


def test_query_log_as_it_grows(spark, tmp_path):
    log = f"{tmp_path}/log"
    one = spark.createDataFrame([("q1", "a"), ("q2", None)], "query string, graph_answer string")
    assert T.append_log(one, log)
    stream = T.log_stream(spark, log)
    assert stream.isStreaming
    run = lambda: stream.writeStream.format("parquet").option("path", f"{tmp_path}/seen").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination(120)
    run()
    assert T.append_log(one.limit(1), log)
    run()
    rows = spark.read.parquet(f"{tmp_path}/seen").collect()
    assert len(rows) == 3 and all(re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\.\d{6}\+00:00", r["ts"]) for r in rows)
    (tmp_path / "file").write_text("x")
    assert T.append_log(one, f"{tmp_path}/file/log") is False


def test_merge_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    source = spark.readStream.schema("id int, v string, at int").json(f"{tmp_path}/in")
    for k, rows in enumerate(([(1, "a", 1), (2, "b", 1), (1, "c", 2), (1, "b", 0)], [(2, "d", 3), (3, "e", 1)], [(3, "f", 2)])):
        (tmp_path / "in" / f"{k}.json").write_text("\n".join(json.dumps(dict(zip(("id", "v", "at"), r))) for r in rows))
        T.merge_stream(source, f"{tmp_path}/t", ["id"], "at", f"{tmp_path}/c").awaitTermination(120)
    store = Store(spark, f"{tmp_path}/t", {})
    assert sorted((r["id"], r["v"]) for r in store.table("rows").collect()) == [(1, "c"), (2, "d"), (3, "f")] and store.versions() == [1, 2]


def test_merge_stream_of_a_batch_that_runs_again(spark, tmp_path):
    """A batch that was merged, but whose end the stream has not noted, runs again and changes nothing; what is written follows the batch."""
    (tmp_path / "in").mkdir()
    source = spark.readStream.schema("id int, v string, at int").json(f"{tmp_path}/in")
    rows = [(i, "a" * 50, 0) for i in range(20_000)]
    for k, batch in enumerate((rows, [(3, "b", 1), (20_001, "c", 1)])):
        (tmp_path / "in" / f"{k}.json").write_text("\n".join(json.dumps(dict(zip(("id", "v", "at"), r))) for r in batch))
        T.merge_stream(source, f"{tmp_path}/t", ["id"], "at", f"{tmp_path}/c").awaitTermination(120)
    store = Store(spark, f"{tmp_path}/t", {})
    files = {p: p.stat().st_size for p in (tmp_path / "t" / "data").rglob("*.parquet")}
    size = lambda version: sum(n for p, n in files.items() if f"/{version}-" in str(p))
    assert 0 < size(1) < size(0) / 8
    was, seen = store.manifest(), rows_of(store.table("rows"))
    last = max((tmp_path / "c" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    for p in (last, last.with_name(f".{last.name}.crc")):  # as if the driver had died before it noted the batch
        p.unlink(missing_ok=True)
    T.merge_stream(source, f"{tmp_path}/t", ["id"], "at", f"{tmp_path}/c").awaitTermination(120)
    assert store.manifest() == was and rows_of(store.table("rows")) == seen and len(seen) == 20_001


def rows_of(df):
    return sorted(map(tuple, df.select("id", "v", "at").collect()))


def test_state_that_ends(spark, tmp_path):
    """Late events, a restart and the end of idle keys; until then the state is the one of a table."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    try:
        (tmp_path / "in").mkdir()
        schema = "engine string, step string, n int, phase string, rows string, at timestamp"
        batches = [
            [("g", "a", 2, "done", None, "10:00"), ("g", "b", 3, "start", "1", "10:01")],
            [("g", "a", 1, "start", "5", "09:58"), ("g", "b", 4, "done", None, "10:02")],  # the first of them is late
            [("h", "a", 9, "start", None, "12:30")],
            [("g", "a", 0, "gone", "7", "09:00"), ("h", "a", 10, "done", "2", "12:31")],  # too late
            [("h", "b", 1, "start", None, "12:32")],
        ]
        got = []
        for k, rows in enumerate(batches):
            lines = [json.dumps(dict(zip(("engine", "step", "n", "phase", "rows"), r)) | {"at": f"2025-01-01T{r[5]}:00Z"}) for r in rows]
            (tmp_path / "in" / f"{k}.json").write_text("\n".join(lines))
            stream = steps_of(spark.readStream.schema(schema).json(f"{tmp_path}/in"), ["engine", "step"], "n", ["phase", "rows"], "at")
            out = stream.writeStream.outputMode("update").foreachBatch(lambda df, _: got.append([tuple(r) for r in df.collect()]))
            out.option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination(180)  # a restart each time
        sent = [r for b in got for r in b]
        states = {r[:2]: r[2:4] for r in sent}
        before = spark.read.schema(schema).json([f"{tmp_path}/in/{k}.json" for k in (0, 1)])
        table = T.merge_state(before, ["engine", "step"], "n", ["phase", "rows"]).collect()
        first_two = {r[:2]: r[2:4] for r in sent if r[0] == "g" and not r[4]}
        assert first_two == {(r["engine"], r["step"]): (r["phase"], r["rows"]) for r in table} == {("g", "a"): ("done", "5"), ("g", "b"): ("done", "1")}
        assert sorted(r[:4] for r in sent if r[4]) == [("g", "a", "done", "5"), ("g", "b", "done", "1")]
        assert states["h", "a"] == ("done", "2") and not any("gone" in r for r in sent)
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_state_of_a_stream(spark, tmp_path):
    """The same grouped state on a stream as on a table."""
    (tmp_path / "in").mkdir()
    events = [("g", "a", 1, "start", None), ("g", "a", 2, "done", "5"), ("g", "b", 3, "start", "1"), ("g", "b", 4, "done", None)]
    (tmp_path / "in" / "0.json").write_text("\n".join(json.dumps(dict(zip(("engine", "step", "n", "phase", "rows"), e))) for e in events))
    schema = "engine string, step string, n int, phase string, rows string"
    stream = T.merge_state(spark.readStream.schema(schema).json(f"{tmp_path}/in"), ["engine", "step"], "n", ["phase", "rows"])
    query = stream.writeStream.outputMode("complete").format("memory").queryName("state").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    query.awaitTermination(120)
    table = T.merge_state(spark.read.schema(schema).json(f"{tmp_path}/in"), ["engine", "step"], "n", ["phase", "rows"])
    assert sorted(map(tuple, spark.table("state").collect())) == sorted(map(tuple, table.collect())) == [("g", "a", "done", "5"), ("g", "b", "done", "1")]


def test_interleaved_lanes_and_the_end(spark):
    steps = spark.createDataFrame([(1, "graph", 0), (1, "graph", 1), (1, "vector", 0)], "run int, lane string, k int")
    got = [(r["at"], r["lane"]) for r in T.interleave(steps, "run", "lane", "k", closing="end").orderBy("at").collect()]
    assert got == [(1, "graph"), (2, "vector"), (3, "graph"), (4, "end")]


def bill_xml(n, more=""):
    return f"<billStatus>\n<bill><congress>118</congress>\n<type>HR</type><number>{n}</number><title>T{n}{more}</title>\n</bill></billStatus>"


def test_xml_files(spark, tmp_path):
    """Many documents in a file and a file for one, on one line or many; broken ones are told with their file, and lose no others."""
    (tmp_path / "many.xml").write_text("<?xml version='1.0'?>\n<bills>\n" + "\n".join(bill_xml(i) for i in range(300)) + "\n</bills>\n")
    (tmp_path / "one.xml").write_text(bill_xml(1000).replace("\n", ""))
    cut_off, malformed, other = "<billStatus><bill><number>7</number><", "<billStatus><bill><number>8</bill></billStatus>", "<billStatus><law/></billStatus>"
    (tmp_path / "broken.xml").write_text("\n".join([bill_xml(2000), cut_off, bill_xml(2001), malformed, bill_xml(2002), other, bill_xml(2003), cut_off]))
    (tmp_path / "empty.xml").write_text("")
    (tmp_path / "none.xml").write_text("<bills/>")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        assert documents(spark, str(tmp_path)).rdd.getNumPartitions() > 5  # the large file is split
        got = scan_xml(spark, str(tmp_path), "2025-06-30").collect()
        assert sorted(int(r["bill_number"]) for r in got) == [*range(300), 1000, 2000, 2001, 2002, 2003]
        assert {r["file"].rsplit("/", 1)[1] for r in got} == {"many.xml", "one.xml", "broken.xml"}
        bad = broken_xml(spark, str(tmp_path)).collect()
        assert {r["file"].rsplit("/", 1)[1] for r in bad} == {"broken.xml"}
        assert sorted(r["sample"].split("\n")[0][:36] for r in bad) == sorted(x[:36] for x in (cut_off, cut_off, malformed, other))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_pages_that_can_hold_nothing_are_not_read(spark, tmp_path):
    at = f"{tmp_path}/l"
    rows = [(f"BILLSTATUS-{117 + i % 2}hr{i:05d}", f"2024-{1 + i // 400:02d}-15") for i in range(4000)] + [(None, None)]
    df = spark.createDataFrame(rows, "package_id string, last_modified string")
    n = write_listing(df.where("package_id is not null"), at, 100)
    assert n >= 40 and len(list((tmp_path / "l").glob("page-*.json"))) == n
    assert read_listing(spark, at).count() == 4000
    index = [json.loads(x) for x in (tmp_path / "l" / "pages.json").read_text().splitlines()]
    # pages that another prefix, or an older date, rules out are broken: reading one would fail
    for p in index:
        if p["last_id"] < "BILLSTATUS-118" or p["last_date"] < "2024-06":
            (tmp_path / "l" / f"page-{p['page']}.json").write_text("{")
    want = [r for r in rows if r[0] and r[0].startswith("BILLSTATUS-118") and r[1] >= "2024-06"]
    got = read_listing(spark, at, "BILLSTATUS-118", "2024-06")
    assert sorted((r["package_id"], r["last_modified"]) for r in got.collect()) == sorted(want) and len({r["page"] for r in got.collect()}) < n / 2
    # a task stops at the limit: no later page of its range is opened
    first = min(r["page"] for r in got.collect())
    for p in index:
        if p["page"] > first:
            (tmp_path / "l" / f"page-{p['page']}.json").write_text("{")
    assert read_listing(spark, at, "BILLSTATUS-118", "2024-06", limit=5, pages=1000).count() == 5


def test_filters_of_a_query_reach_the_reader(spark, tmp_path):
    at = f"{tmp_path}/l"
    write_listing(spark.createDataFrame([(f"P{i:03d}", f"2024-01-{1 + i % 28:02d}") for i in range(100)], "package_id string, last_modified string"), at, 10)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        spark.dataSource.register(Listing)
        df = spark.read.format("package_pages").option("path", at).option("filters", "true").load()
        some = df.where("package_id like 'P01%' and last_modified >= '2024-01-05' and page >= 0")
        assert "StartsWith" not in some._jdf.queryExecution().executedPlan().toString() and some.count() == len([i for i in range(10, 20) if 1 + i % 28 >= 5])
        assert df.where("package_id = 'P042'").count() == 1 and df.where("last_modified > '2024-01-27'").count() == 3
        for p in (tmp_path / "l").glob("page-*.json"):
            if "P04" not in p.read_text():
                p.write_text("{")
        assert df.where("package_id = 'P042'").count() == 1
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_chunks_as_a_table_function(spark):
    register(spark)
    rows = [(1, "One two. Three four! Five?"), (2, None), (3, "  \n"), (4, "x" * 500), (5, " lead. And tail. ")]
    spark.createDataFrame(rows, "k int, t string").createOrReplaceTempView("chunk_rows")
    for s, size, overlap in itertools.product((*STRATEGIES, "unknown"), (7, 220), (0, 3)):
        got = spark.sql(f"SELECT k, c.chunk_index AS i, c.chunk AS c FROM chunk_rows, LATERAL chunks(t, '{s}', {size}, {overlap}) c").collect()
        want = spark.table("chunk_rows").select("k", F.posexplode(chunks(F.col("t"), s, size, overlap)).alias("i", "c")).collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, want)), (s, size, overlap)
    with pytest.raises(Exception, match="size must be at least 1"):
        spark.sql("SELECT * FROM chunk_rows, LATERAL chunks(t, 'fixed', 0) c").collect()
    with pytest.raises(Exception, match="must be a text"):
        spark.sql("SELECT * FROM chunk_rows, LATERAL chunks(k) c").collect()
