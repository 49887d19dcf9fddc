import random

import numpy as np
import pytest
from cases import documents, none
from pyspark.sql import functions as F

from corpus_pipeline import simhash_near_dedup
from evidra.llm import near_sets
from evidra.llm.components import connected_components, merged
from evidra.llm.op1_embedding import bits_for, embedding_neardup, op1_embedding_neardup, signatures, tables_for
from evidra.llm.op6_simhash import fingerprint, near_edges, op6_simhash_neardup, simhash_neardup

DATA = "/root/testdata/sf0.001"


def components(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components_of_random_graphs(spark):
    r = random.Random(1)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(70)]
    got = {x["node"]: x["component"] for x in connected_components(spark.createDataFrame([*links, (None, 3), (5, 5)], "a bigint, b bigint")).collect()}
    real = [p for p in links if p[0] != p[1]]
    assert got == components({x for p in real for x in p}, real)
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_merged_labels_are_connected(spark):
    r = random.Random(2)
    old, new = ([(r.randrange(200), r.randrange(200)) for _ in range(90)] for _ in range(2))
    new += [(300, 301), (5, 302)]  # nodes without a label are their own
    frame = lambda links, names: spark.createDataFrame(links, names)
    label = merged(connected_components(frame(old, "a bigint, b bigint")), frame(new, "x bigint, y bigint"))
    got = {x["node"]: x["component"] for x in label.collect()}
    assert len(got) == label.count()
    exact = components(range(400), old + new)
    assert all(exact[n] == exact[c] and c <= n for n, c in got.items())
    before = components(range(400), old)
    assert sum(got.get(n, n) == exact[n] for n in range(400)) > sum(before[n] == exact[n] for n in range(400))


def test_components_are_not_worked_out_each_turn(spark, monkeypatch):
    # texts that share a passage, and few of which are alike: each turn asks about pairs
    r, calls = random.Random(3), []
    shared = " ".join(f"s{i}" for i in range(30))
    line = lambda: " ".join(f"w{r.randrange(10**6)}" for _ in range(30))
    texts = [f"{shared} {line()}" for _ in range(60)]
    texts += [f"{t} {line()[:8]}" for t in texts[:6]]
    monkeypatch.setattr(near_sets, "connected_components", lambda *a: calls.append(a) or connected_components(*a))
    monkeypatch.setattr(near_sets, "ALL_PAIRS", 8)
    monkeypatch.setattr(near_sets, "_heavier", lambda known, classes: known)
    monkeypatch.setattr(near_sets, "_common", lambda *a: (np.zeros(0, np.uint64), np.zeros(0, np.int64)))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {x["doc_id"]: x["component_id"] for x in near_sets.set_neardup(df).collect()}
    sets = [near_sets.shingles(t) for t in texts]
    links = [(a, b) for a in range(len(texts)) for b in range(a) if near_sets.similar(sets[a], sets[b])]
    assert got == components(range(len(texts)), links) and len(links) >= 6
    assert len(calls) <= 2


def test_a_large_group_of_near_copies_is_not_squared(spark, monkeypatch):
    # copies that are alike only if they have few edits between them: all are like the base, or like nothing
    r, asked = random.Random(4), []
    base, texts = [f"b{i}" for i in range(150)], []
    for i in range(500):
        w = list(base)
        for j in range(r.randrange(7)):
            w[r.randrange(150)] = f"x{i}-{j}"
        texts.append(" ".join(w))
    verified = near_sets._verified
    monkeypatch.setattr(near_sets, "_verified", lambda pairs, *a: asked.append(pairs.distinct().count()) or verified(pairs, *a))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {x["doc_id"]: x["component_id"] for x in near_sets.set_neardup(df).collect()}
    sets = [near_sets.shingles(t) for t in texts]
    links = [(a, b) for a in range(len(texts)) for b in range(a) if near_sets.similar(sets[a], sets[b])]
    assert got == components(range(len(texts)), links) and len(set(got.values())) > 50
    assert sum(asked) < 10 * len(texts)


def brute_vectors(rows, least=0.95):
    good = {i: np.array(v, float) for i, v in rows if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    ids = list(good)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if len(good[a]) == len(good[b]) and good[a] @ good[b] / np.sqrt((good[a] @ good[a]) * (good[b] @ good[b])) >= least]
    n = dict.fromkeys((i for i, _ in rows), 0)
    for p in links:
        for x in p:
            n[x] += 1
    comp = components(n, links)
    return {i: (n[i], comp[i], comp[i] == i) for i in n}


def test_embedding_neardup_is_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").select("vec_id", "embedding").collect()]
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in op1_embedding_neardup(spark, DATA).collect()}
    assert got == brute_vectors(rows)


def test_embedding_neardup_awkward(spark):
    r = np.random.default_rng(3)
    base = r.standard_normal((6, 16))
    rows = [(k, (base[k % 6] + 0.05 * r.standard_normal(16)).tolist()) for k in range(60)] + [(100 + k, base[0].tolist()) for k in range(9)]
    rows += [(200, None), (201, []), (202, [0.0] * 16), (203, [float("nan")] * 16), (204, [None, *[1.0] * 15]), (205, [float("inf")] * 16), (206, [1.0, 2.0]), (207, [2.0, 4.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumns({c: F.lit(1) for c in ("id", "v", "rep", "label", "sigs")})
    got = {x["vec_id"]: (x["n_links"], x["component_id"], x["kept"]) for x in embedding_neardup(df, block=16).collect()}
    assert got == brute_vectors(rows)
    assert embedding_neardup(df.where("false")).count() == 0


def brute_fingerprints(fps):
    ids = list(fps)
    return components(ids, [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if (fps[a] ^ fps[b]).bit_count() <= 3])


def plain_fingerprint(text):
    import xxhash

    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate({c: " " for c in (9, 10, 11, 12, 13)}).split(" ")
    w = [x for x in w if x]
    h = [xxhash.xxh64(" ".join(s), seed=42).intdigest() for s in (zip(*(w[i:] for i in range(3))) if len(w) >= 3 else [w])] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_is_brute_force(spark):
    texts = {r[0]: r[1] for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()}
    fps = {i: plain_fingerprint(t) for i, t in texts.items()}
    comp = brute_fingerprints(fps)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"], r["kept"]) for r in op6_simhash_neardup(spark, DATA).collect()}
    assert got == {i: (f"{fps[i]:016x}", comp[i], comp[i] == i) for i in fps}


@pytest.mark.parametrize("leaf", [8, 64])
def test_trees_miss_no_link(spark, leaf):
    r = random.Random(leaf)
    fps = [r.getrandbits(64) for _ in range(150)]
    for _ in range(500):
        f = r.choice(fps)
        for b in r.sample(range(64), r.choice((0, 1, 2, 3, 4))):
            f ^= 1 << b
        fps.append(f)
    fps = {k: f for k, f in enumerate(dict.fromkeys(fps))}
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f, k) for k, f in fps.items()], "fp bigint, rep bigint")
    edges = [tuple(e) for e in near_edges(df, leaf=leaf).collect()]
    assert components(fps, edges) == brute_fingerprints(fps)


def test_simhash_awkward(spark):
    docs, n = documents(spark)
    got = simhash_neardup(docs).collect()
    assert len(got) == n
    by = {r["doc_id"]: r for r in got}
    assert {by[i]["component_id"] for i in (0, 1, 2)} == {0} and by[9]["component_id"] == 8 and by[None]["component_id"] is None
    assert by[0]["fingerprint"] == "0" * 16 and int(by[5]["fingerprint"], 16) == fingerprint(plain := "Ünïcode straße 北京 😀 text") == plain_fingerprint(plain)
    assert simhash_neardup(none(spark)).count() == 0


# --- the pipeline's near-duplicates: all pairs of five-word shingle sets of similarity 0.8 ---


def five_words(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_pipeline_neardup_is_brute_force(spark):
    r = random.Random(11)
    line = lambda n: " ".join(f"w{r.randrange(4000)}" for _ in range(n))
    texts, common = [None, "", "one two", "One  two", "one three"], line(40)
    for n in [6, 12, 30, 60, 120, 300] * 6:
        base = line(n).split()
        texts.append(" ".join(base))
        for edits in (0, 1, 1, 2, 3, 5):  # similarities on both sides of 0.8
            w = list(base)
            for _ in range(edits):
                w[r.randrange(n)] = "new" + str(r.randrange(9))
            texts.append(" ".join(w))
    texts += [f"{common} {line(r.choice((2, 5, 10, 40)))}" for _ in range(80)]  # a common passage
    chain = line(100).split()
    for i in range(30):  # only neighbours are alike
        chain = chain[4:] + line(4).split()
        texts.append(" ".join(chain))
    base = line(80).split()
    for i in range(70):  # a large group of near copies
        w = list(base)
        w[r.randrange(80)] = f"x{i}"
        texts.append(" ".join(w))
    r.shuffle(texts)
    sets = [five_words(t) for t in texts]
    links = [(a, b) for a in range(len(sets)) for b in range(a) if sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    want = components(range(len(sets)), links)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {x["doc_id"] for x in simhash_near_dedup(spark, docs, "").collect()}
    assert got == {i for i in want if want[i] == i}
    assert len({want[i] for i in want}) < len({frozenset(s) for s in sets})  # near copies, not only equal ones


def test_dense_ball_is_dealt_into_blocks(spark):
    """Fingerprints within a few bits of one another, which no vantage point divides: same components, many groups."""
    r = random.Random(8)
    center = r.getrandbits(64)
    ball = sorted({center ^ sum(1 << b for b in r.sample(range(64), r.choice((2, 3, 4)))) for _ in range(1500)})
    far = sorted({r.getrandbits(64) for _ in range(200)})
    fps = ball + far
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f, i) for i, f in enumerate(fps)], "fp bigint, rep bigint")
    x = np.array(fps, np.uint64)
    near = np.bitwise_count(x[:, None] ^ x[None, :]) <= 3
    want = components(range(len(fps)), [(i, j) for i, j in zip(*map(list, np.nonzero(near))) if i < j])
    for block in (100, 1 << 30):
        edges = near_edges(df, leaf=50, block=block)
        got = {i: i for i in range(len(fps))} | {n: c for n, c in connected_components(edges).collect()}
        assert got == want


def compared(x, bits):
    """Pairs that the tables compare, of all ordered pairs."""
    sigs = signatures(x, bits, tables_for(bits))
    return sum(float((np.unique(sigs[:, t], return_counts=True)[1] ** 2).sum()) for t in range(sigs.shape[1])) / len(x) ** 2


def test_bits_follow_the_vectors():
    """Vectors around a common mean share buckets more often, and get more bits."""
    r = np.random.default_rng(5)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    even, mean = unit(r.standard_normal((20_000, 64))), unit(r.standard_normal((20_000, 64)) + 1.0)
    b1, b2 = bits_for(even[:4000], len(even)), bits_for(mean[:4000], len(mean))
    assert b2 > b1 and compared(even, b1) < 0.03 and compared(mean, b2) < 0.1


def test_embedding_recall_of_every_twentieth(spark):
    """Links of the rows whose id is divisible by 20, against all rows of sf0.1."""
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").toPandas().sort_values("vec_id")
    x = np.stack(e["embedding"]).astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    got = {r["vec_id"]: r["n_links"] for r in op1_embedding_neardup(spark, "/root/testdata/sf0.1").collect()}
    rows = np.flatnonzero(e["vec_id"].to_numpy() % 20 == 0)
    want = ((x[rows] @ x.T) >= 0.95).sum(axis=1) - 1
    found = np.array([got[i] for i in e["vec_id"].to_numpy()[rows]])
    assert (found <= want).all() and found.sum() >= 0.99 * want.sum()
    print("links", want.sum(), "found", found.sum())


@pytest.mark.parametrize("sample", [300, 2000])
def test_trees_inside_large_leaves(spark, sample, monkeypatch):
    """With a small sample the first leaves are large: trees inside them leave none above the block but for a planted ball, and miss no pair."""
    from evidra.llm import op6_simhash as S

    rng = np.random.default_rng(sample)
    far = rng.integers(0, 1 << 63, 12_000, np.uint64) * np.uint64(2) + rng.integers(0, 2, 12_000, np.uint64)
    near = far[:1500] ^ (np.uint64(1) << rng.integers(0, 64, 1500).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 1500).astype(np.uint64))
    centre = far[0]
    ball = np.array([centre ^ np.uint64((1 << int(a)) | (1 << int(b)) | (1 << int(c))) for a, b, c in rng.integers(0, 20, (900, 3))], np.uint64)
    fps = np.unique(np.concatenate([far, near, ball])).view(np.int64)
    df = spark.createDataFrame([(int(x), i) for i, x in enumerate(fps)], "fp bigint, rep bigint")
    seen = []
    real = S._refined
    monkeypatch.setattr(S, "_refined", lambda rows, *a: seen.append(real(rows, *a)) or seen[-1])
    got = S.connected_components(S.near_edges(df, leaf=64, sample=sample, block=128))
    label = {r["node"]: r["component"] for r in got.collect()}
    u = fps.view(np.uint64)
    labels = S.Labels(len(u))
    for i in range(len(u)):
        labels.join(np.append(np.flatnonzero(np.bitwise_count(u ^ u[i]) <= 3), i))
    labels.of = labels.roots(np.arange(len(u)))
    want = {i: int(labels.of[i]) for i in range(len(u)) if (labels.of == labels.of[i]).sum() > 1}
    assert label == want
    owned = seen[0].where("own").groupBy("tree", "leaf").count().where("count > 128").collect()
    assert seen[0].where("own").count() > (5000 if sample == 300 else 500) and sum(r["count"] for r in owned) <= 2 * (len(ball) + 200)
