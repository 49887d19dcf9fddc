import pytest
from oracle import database, differences
from pyspark.sql import functions as F

import corpus_pipeline
from evidra.llm.op7_chat import escape, events_of, fold_events, read_back, render, unescape
from evidra.llm.registry import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows_as_sql(spark, name):
    d = "/root/testdata/sf0.001"
    assert differences(spark, database(d), name, QUERIES[name], ORACLE_SQL[name], d) == ([], [])


def test_fold(spark):
    e = [
        (1, 0, 0, "message", "user", "hi"),
        (1, 1, 1, "message", "assistant", ""), (1, 1, 2, "delta", None, "He"), (1, 1, 3, "delta", None, "llo"),
        (1, 1, 4, "edit", None, "Bye"), (1, 1, 5, "delta", None, "!"),
        (1, 2, 1, "message", "user", "again"), (1, 2, 2, "delete", None, None),
        (2, 0, 1, "delta", "assistant", "old"), (2, 0, 2, "regenerate", None, "new"), (2, 0, 3, None, None, None), (2, 0, 4, "delta", None, "est"),
        (None, None, None, "message", None, None),
    ]
    log = spark.createDataFrame(e, "conv_id bigint, turn int, seq int, kind string, role string, text string").withColumns({c: F.lit(1) for c in ("above", "parts", "n", "at")})
    got = {(r["conv_id"], r["turn"]): (r["role"], r["text"]) for r in fold_events(log).collect()}
    assert got == {(1, 0): ("user", "hi"), (1, 1): ("assistant", "Bye!"), (2, 0): ("assistant", "est"), (None, None): ("", "")}
    assert read_back(render(fold_events(log.where("false")))).count() == 0


def test_escape_round_trip(spark):
    texts = ["", "\\", "\\0\\1", "### user: </turn>\n", "#<:\\#", "é😀 </turn>", "\\### Assistant: </turn> ok"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select("t", escape(F.col("t"), True).alias("e"), unescape(escape(F.col("t"), True)).alias("u"), unescape(escape(F.col("t"))).alias("v")).collect()
    assert all(r["t"] == r["u"] == r["v"] and not set("#<:") & set(r["e"]) for r in rows)


def test_awkward_conversations(spark):
    rows = [(1, 0, None, None), (1, 0, None, None), (None, 1, "a: b</turn>", "x"), (2, None, "assistant", "long " * 50_000), (2, None, "assistant", "t")]
    c = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("seq", F.lit("x")).withColumn("kind", F.lit("delete"))
    got = {r["conv_id"]: r for r in read_back(render(fold_events(events_of(c)))).collect()}
    assert got[1]["n_turns"] == 2 and got[None]["n_turns"] == 1 and got[2]["loss_chars"] == 250_001


def test_pipeline(spark):
    d = "/root/testdata/sf0.001"
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    docs = spark.read.parquet(f"{d}/documents.parquet")
    before, kept = docs, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, d)
        assert after.columns == docs.columns
        kept.append(after.count())
        before = after
    assert docs.count() > kept[0] > kept[1] > kept[2] == kept[3] > 0
    got = corpus_pipeline.run(spark, d)
    assert got.where("lossless").count() == got.count() == kept[3]


def test_pipeline_awkward(spark):
    from cases import documents, none

    d, (docs, n) = "/root/testdata/sf0.001", documents(spark)
    for make in (docs, none(spark)):
        now = make
        for name, stage in corpus_pipeline.STAGES:
            now = stage(spark, now, d)
            assert now.count() <= n


def test_pipeline_on_awkward_rows(spark):
    """What each stage keeps and changes of nulls, empty and very long texts, repeated rows and clashing names."""
    from cases import TEXTS, documents

    d, (docs, n) = "/root/testdata/sf0.001", documents(spark)
    run = dict(corpus_pipeline.STAGES)
    rows = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=repr)
    kept = run["quality classifier"](spark, docs, d)
    assert kept.columns == docs.columns and set(rows(kept)) <= set(rows(docs))
    near = run["simhash near-dedup"](spark, docs, d)
    # null, empty and blank texts are one group; equal texts are, and the row without an id belongs to none
    want = [(0, None), *((i, t) for i, t in enumerate(TEXTS) if i in (3, 4, 5, 6, 7, 8)), (None, "no id")]
    assert near.columns == docs.columns and rows(near) == sorted(want, key=repr)
    assert rows(run["benchmark decontamination"](spark, docs, d)) == rows(docs)
    clean = run["personal data"](spark, docs, d)
    changed = [(a, b) for a, b in zip(rows(docs), rows(clean)) if a != b]
    assert clean.columns == docs.columns and [b for _, b in changed] == [(6, "[EMAIL] call [PHONE] now [IP]")]
    assert clean.where("doc_id = 6").first()["n_chars"] == len("[EMAIL] call [PHONE] now [IP]")
    ids = run["sentencepiece encoding"](spark, docs, d)
    assert ids.count() == ids.where("lossless").count() == n


def test_pipeline_stages_decide_row_by_row(spark):
    """Null and repeated ids: each row goes or stays by its own text."""
    leak, clean = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").first()["text"], "a plain sentence about nothing that anyone would want to drop"
    near = " ".join(f"word{i}" for i in range(60))
    rows = [(None, leak), (1, leak), (2, clean), (2, leak), (None, clean), (3, near), (3, near), (4, near + " end"), (5, None), (3, "something else entirely, of its own")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text").cast("bigint"), "k1": F.lit("x"), "component_id": F.lit(0)})
    run = dict(corpus_pipeline.STAGES)
    clear = lambda df: sorted((r["doc_id"] or 0, r["text"] or "") for r in df.collect())
    left = run["benchmark decontamination"](spark, docs, "/root/testdata/sf0.001")
    assert left.columns == docs.columns and clear(left) == clear(docs.where(F.coalesce(F.col("text"), F.lit("")) != leak))
    left = run["simhash near-dedup"](spark, docs, "/root/testdata/sf0.001")
    assert left.columns == docs.columns and clear(left) == sorted([(0, leak), (0, clean), (1, leak), (2, clean), (3, near), (3, "something else entirely, of its own"), (5, "")])
    left = run["personal data"](spark, docs, "/root/testdata/sf0.001")
    assert left.columns == docs.columns and clear(left) == clear(docs)


def plain_fold(events):
    """The final turns of a log, one event after the other."""
    order = lambda e: tuple((x is not None, x if x is not None else 0) for x in (e[2],)) + tuple((x is not None, (x or "").encode()) for x in (e[3] or "message", e[4], e[5] or ""))
    turns = {}
    for e in sorted({(c, t, s, k or "message", r, x or "") for c, t, s, k, r, x in events}, key=order):
        conv, turn, _, kind, role, text = e
        there, named, said = turns.get((conv, turn), (None, None, ""))
        if kind == "delta":
            there, said = there if there is not None else True, said + text
        else:
            there, said = kind != "delete", text
        turns[conv, turn] = (there, role if role is not None else named, said)
    return {k: (role or "", said) for k, (there, role, said) in turns.items() if there}


def test_fold_of_random_logs(spark):
    """Shuffled order, repeated events, deletions followed by deltas."""
    import random

    rng = random.Random(11)
    kinds = ["message", "delta", "delta", "delta", "edit", "regenerate", "delete", None]
    e = [(rng.randrange(40), rng.randrange(3), rng.choice([None, *range(6)]), rng.choice(kinds), rng.choice([None, "user", "assistant"]), rng.choice([None, "a", "b", " late"])) for _ in range(900)]
    e += rng.sample(e, 300)
    rng.shuffle(e)
    log = spark.createDataFrame(e, "conv_id bigint, turn int, seq int, kind string, role string, text string").repartition(5)
    got = {(r["conv_id"], r["turn"]): (r["role"], r["text"]) for r in fold_events(log).collect()}
    assert got == plain_fold(e) and any(k not in got for k in {(x[0], x[1]) for x in e})
