import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from cases import documents, none
from pyspark.sql import functions as F

from evidra.llm import op12_repair
from evidra.llm.op11_toxicity import TOXIC, marginals, op11_toxicity as op11, toxicity
from evidra.llm.op12_repair import damaged, op12_repair as op12, repair
from evidra.llm.op13_divergence import SQL as DIVERGENCE_SQL
from evidra.llm.op13_divergence import divergence

SF = "/root/testdata/sf0.1"


# --- 11


def test_marginals_equal_all_labellings():
    rng = np.random.default_rng(5)
    for sizes in ([1], [5], [3, 1, 7], [9, 2, 2]):
        n = sum(sizes)
        u, start, trans = rng.normal(0, 2, n), rng.normal(0, 1, 2), rng.normal(0, 1, (2, 2))
        first = np.zeros(n, bool)
        first[np.cumsum([0, *sizes[:-1]])] = True
        got, xi, total = marginals(u, first, start, trans, pairs=True)
        at, want, pairs, logs = 0, [], [], 0.0
        for size in sizes:
            each, both = Counter(), Counter()
            for y in itertools.product((0, 1), repeat=size):
                w = np.exp(start[y[0]] + sum(u[at + k] for k in range(size) if y[k]) + sum(trans[a, b] for a, b in zip(y, y[1:])))
                each.update({"z": w, **{k: w for k in range(size) if y[k]}})
                both.update({(k, y[k - 1], y[k]): w for k in range(1, size)})
            want += [each[k] / each["z"] for k in range(size)]
            pairs += [[[both[k, i, j] / each["z"] for j in (0, 1)] for i in (0, 1)] for k in range(1, size)]
            logs, at = logs + np.log(each["z"]), at + size
        assert np.allclose(got, want) and np.isclose(total, logs)
        assert np.allclose(xi.transpose(2, 0, 1), np.array(pairs).reshape(-1, 2, 2))


def test_long_texts_keep_their_marginals():
    """One text, and the same one with others around it."""
    rng = np.random.default_rng(7)
    u, start, trans = rng.normal(0, 6, 40_000), np.array([1.0, -1.0]), np.array([[2.0, -1.0], [-1.0, 1.0]])
    first = np.zeros(len(u), bool)
    first[0] = True
    alone = marginals(u, first, start, trans)
    first2 = np.concatenate([[True] * 123, first, [True] * 777])
    assert np.allclose(alone, marginals(np.concatenate([np.ones(123), u, np.ones(777)]), first2, start, trans)[123:-777])


@pytest.fixture(scope="module")
def scored(spark):
    return op11(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic"), "doc_id").join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang"), "doc_id").cache()


def test_held_out_toxicity(spark, scored):
    """Recall and precision on labels that were not learned from. Some labelled documents have lost their toxic words to junk."""
    r = scored.where("held_out").groupBy("toxic", "predicted").count().collect()
    n = {(x["toxic"], x["predicted"]): x["count"] for x in r}
    recall, precision = n[1, 1] / (n[1, 1] + n.get((1, 0), 0)), n[1, 1] / (n[1, 1] + n.get((0, 1), 0))
    print("recall", recall, "precision", precision)
    assert recall >= 0.9 and precision >= 0.97
    for lang in ("de", "fr", "es"):  # words that are told by their beginnings
        x = scored.where("held_out and toxic = 1").where(F.col("lang") == lang).agg(F.avg("predicted")).first()[0]
        assert x >= 0.9, lang


def test_spans_are_where_the_words_are(scored):
    rows = scored.where("spans <> '' and lang = 'en' and toxic = 1").select("text", "spans").collect()
    found = Counter(r["text"][int(a) : int(b)].lower() for r in rows for s in r["spans"].split(",") for a, b in [s.split(":")])
    assert found and sum(n for w, n in found.items() if w in ("idiot", "trash", "scum", "moron", "clown", "loser", "stupid", "pathetic", "worthless", "disgusting")) > 0.8 * sum(found.values())
    assert all(re.fullmatch(r"[^\W\d_].*[^\W\d_]|[^\W\d_]", w, re.S) for w in found)


def test_toxicity_awkward(spark):
    docs, n = documents(spark)
    labels = spark.createDataFrame([(1, 0, "a"), (2, 1, "b"), (2, 0, "b"), (None, 1, "c"), (5, None, "d"), (9, 0, "e")], "doc_id bigint, toxic int, text string")
    for lab in (labels, labels.where("false"), labels.where("toxic = 1"), labels.where("toxic = 0")):
        got = toxicity(docs, lab).collect()
        assert len(got) == n and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["score"] < 0.01 for r in toxicity(docs, labels.where("false")).collect())
    assert all(r["score"] > 0.99 for r in toxicity(docs, labels.where("toxic = 1 and doc_id = 2")).collect())
    assert toxicity(none(spark), labels).count() == 0


def test_only_training_labels_and_text_count(spark):
    """Other labels, languages and sources change no score."""
    d = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    train = F.crc32(F.col("doc_id").cast("string")) % 3 != 1
    a = toxicity(docs, labels, train=train).select("doc_id", "score")
    turned = labels.withColumn("toxic", F.when(train, F.col("toxic")).otherwise(1 - F.col("toxic")))
    b = toxicity(docs.withColumns({"lang": F.lit("x"), "source": F.lit("y")}), turned, train=train).select("doc_id", "score")
    assert sorted(a.collect()) == sorted(b.collect()) and a.where(F.col("score") >= TOXIC).count()


# --- 12


def plain_repair(rows):
    """Rows in order; all edit sequences layer by layer, the least (cost, audit, lines) of each state."""
    seen, judged = set(), []
    for turn, role, text in rows:
        body = text.rstrip(" \t\n\v\f\r")
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
        seen.add((role, text))
        judged.append((role, text, fault))
    step = {"": "su", "s": "u", "u": "a", "a": "u"}
    put = lambda best, state, x: best.__setitem__(state, min(best.get(state, x), x))

    def inserts(best):
        for _ in range(2):
            for state, (c, a, lines) in list(best.items()):
                put(best, made := "a" if state == "u" else "u", (c + 2, a + "I", (*lines, {"u": "user:", "a": "assistant:"}[made])))
        return best

    best = {"": (0, "", ())}
    for role, text, fault in judged:
        after = {}
        for state, (c, a, lines) in inserts(best).items():
            put(after, state, (c + 3, a + "D", lines))
            if fault in ("blank", "duplicate"):
                continue
            extra = fault == "truncated"
            if role[:1] and role[0] in step[state]:
                put(after, role[0], (c + extra, a + "K", (*lines, f"{role}:{text}")))
            new = "a" if state == "u" else "u"
            put(after, new, (c + 2 + extra, a + "R", (*lines, {"u": "user:", "a": "assistant:"}[new] + text)))
        best = after
    best = inserts(best)
    cost, audit, lines = min(x for s, x in best.items() if s in ("", "a"))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    of = Counter(f for _, _, f in judged)
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(judged, judged[1:]))
    return gaps, of["blank"], of["duplicate"], of["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def compared(spark, rows, parts=8):
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(parts)
    df = df.withColumns({c: F.lit("x") for c in ("k1", "copies", "first", "at", "k", "cost", "rows", "s1", "place")})
    want = defaultdict(list)
    for c, t, r, x in rows:
        want[c].append((t, " " if r is None else r, " " if x is None else x))
    for rs in want.values():
        rs.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    got = {r["conv_id"]: tuple(r)[1:] for r in repair(df).collect()}
    assert got == {c: plain_repair(rs) for c, rs in want.items()}
    return got


def random_rows(rng, n, convs, turns):
    texts = ["", " \t", "Hello.", "What?", "cut off", "ends! ", "Ü 😀.", None, "again."]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "s", "u"]
    return [(rng.choice(convs), rng.choice(turns), rng.choice(roles), rng.choice(texts) if rng.random() < 0.5 else f"Text {rng.randrange(40)}" + rng.choice([".", ""])) for _ in range(n)]


def test_repair_brute_force(spark):
    rng = random.Random(3)
    compared(spark, random_rows(rng, 400, [None, *range(60)], [None, *range(9)]))


def test_repair_in_small_segments(spark, monkeypatch):
    """Conversations over many segments and tasks."""
    monkeypatch.setattr(op12_repair, "SEGMENT", 3)
    monkeypatch.setattr(op12_repair, "HELD", 2)
    rng = random.Random(4)
    compared(spark, random_rows(rng, 700, [None, 1, 2, 2, 2, 3], [None, *range(300)]))


def test_repair_hot_conversation(spark):
    """Most rows are one conversation's, and most of these are equal."""
    rng = random.Random(5)
    rows = [(7, t, ("user", "assistant")[t % 2] if rng.random() < 0.8 else "system", f"Text {t}.") for t in range(2500)]
    rows += [(7, 40, "user", "The same.")] * 1500 + [(7, t, "user", "The same.") for t in range(50, 900)] + [(8, 1, "user", "Hi.")]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert len(compared(spark, rows)[7][6]) >= 4850
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_repair_of_nothing(spark):
    c = spark.createDataFrame([(1, 1, "user", "x")], "conv_id bigint, turn bigint, role string, text string")
    [r] = repair(c, F.lit(0)).collect()
    assert tuple(r) == (1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert repair(c.where("false")).count() == 0


def test_damage_drops_some_conversations_but_names_them(spark):
    c = spark.createDataFrame([(i, 0, "user", "One. Two.") for i in range(200)], "conv_id bigint, turn bigint, role string, text string")
    assert damaged(c).where("copies = 0").count() and repair(damaged(c), F.col("copies")).count() == 200
    assert op12(spark, "/root/testdata/sf0.001").count()


# --- 13


def test_divergence_awkward(spark):
    """Against the SQL, on rows with nulls, groups without terms and languages without kept terms."""
    rng = random.Random(6)
    vocabulary = ["the", "The", "of", "Ünï", "ünï", "北京", "rare", "a1b", "x"]
    rows = [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(30))), rng.choice(["en", "de", None, ""]), rng.choice(["a", "b", None, "ü", "c"])) for i in range(300)]
    rows += [(None, None, "en", "empty"), (None, "1 2 3", "en", "empty"), (1, "lonely words", "xx", "a"), (1, "lonely words", "xx", "b"), (5, "only", "yy", "a"), rows[0], rows[0], (9, "the " * 200_000, "en", "long"), (10, "the\x00of@The[of`x{", "en", "long")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    extra = df.withColumns({c: F.lit("x") for c in ("term", "n", "docs", "part", "item", "value", "rank", "v", "p", "q", "x", "y", "total")})
    con = duckdb.connect()
    con.register("documents", df.toArrow())
    want = Counter(con.sql(DIVERGENCE_SQL).fetchall())
    assert want and Counter(tuple(r) for r in divergence(extra).select("lang", "source", "part", "item", "value", "rank").collect()) == want
    assert divergence(none(spark)).count() == 0


