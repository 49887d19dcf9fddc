"""Near-duplicates by SimHash fingerprints and word-shingle sets: all pairs of texts whose sets have a Jaccard
similarity of ``SIMILARITY`` or more, and their components.

The vantage-point trees of the SimHash operator propose pairs of five-word fingerprints, and the sets decide. No
radius of 64-bit fingerprints is both wide enough for a similarity of 0.8 (about 10 bits on average, often
more) and narrow enough for a search by trees. So the pairs beyond the radius are found on the sets themselves. Shingles have one
order in the whole corpus, common ones last: those that are common in a sample, and then those that turn out to be among the
first of many sets. Two sets of that similarity share one of their first n - ceil(0.8 n) + 1 shingles in any such order,
and behind the first one that they share there is enough left of both, so no pair is missed; the order bears on the cost only.

Only components matter. First the sets of each group that shares a shingle are compared, in a large group each with
its hubs (``_hubs``: sets with the least before the shingle, which can be similar to the most others); then, in turns, with hubs of
other components; then those pairs of a large group that are not yet in one component and have enough left behind the shingle. So a large group
of near copies is not squared: what its hubs have not reached has too much of its own before the shingle. Turns end when hardly
any pair of one is similar. Between them components are only joined by what is new (``merged``); they are worked out before and after.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidra.llm.common import BROADCAST_KEYS, cut, drop, lean, mix, partitions, row_key, small_batches, without
from evidra.llm.components import connected_components, merged
from evidra.llm.op6_simhash import near_edges, vote

SHINGLE_WORDS = 5
#: As a fraction, so that bounds are exact.
SIMILARITY = (4, 5)
#: Texts that common shingles are taken from, and how many are kept; they bear on the cost only.
SAMPLE = 10_000
COMMON = 400_000
#: Of larger groups only pairs between components are compared.
ALL_PAIRS = 32
#: Shingles of large groups that are moved to the end of the order; they bear on the cost only.
HEAVY = 1_000_000
#: Rounds, at most, in which other hubs of a large group are compared first; they bear on the cost only.
TURNS = 6
#: The last such round is one in which less than one pair in so many is similar, and less than one class in so many is joined.
FRUITFUL = (10, 1_000)


def shingles(text: str | None, k: int = SHINGLE_WORDS) -> np.ndarray:
    """The distinct 64-bit hashes of a text's runs of k words, sorted; a shorter text is one run."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = max(1, len(w) - k + 1)
    h = np.full(n, min(k, len(w)), np.uint64)
    for i in range(min(k, len(w))):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + w[i : i + n])
    h.sort()
    return h[np.append(True, h[1:] != h[:-1])]


def class_of(s: np.ndarray) -> tuple[int, int]:
    """Two numbers for equal sets: the class, and what tells sets apart that share it."""
    one = xxhash.xxh3_128_intdigest(s.tobytes())
    return tuple(np.array([one & ((1 << 64) - 1), one >> 64], np.uint64).view(np.int64).tolist())


def first_shingles(s: np.ndarray, common: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Those of a set that any set of the similarity shares one of."""
    n = len(s)
    rank = np.zeros(n, np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, s), len(common) - 1)
        rank = np.where(common[at] == s, count[at], 0)
    return s[np.lexsort((s, rank))[: n + 1 - -(-SIMILARITY[0] * n // SIMILARITY[1])]] if n else s


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * SIMILARITY[1] >= SIMILARITY[0] * (len(a) + len(b) - both)


def _common(texts: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    of = max(1, -(-texts.count() // SAMPLE))

    def run(batches):
        for b in batches:
            h = [shingles(t, k) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(h).view(np.int64))], names=["h"])

    some = texts.where(F.pmod(F.xxhash64("text"), F.lit(of)) == 0).distinct().mapInArrow(lean(run), "h bigint")
    rows = some.groupBy("h").count().where("count > 2").orderBy(F.desc("count"), "h").limit(COMMON).toPandas()
    return _ordered(rows)


def _ordered(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    h, n = rows["h"].to_numpy(np.int64).view(np.uint64), rows["count"].to_numpy(np.int64)
    order = np.argsort(h)
    return h[order], n[order]


def _heavier(known: tuple[np.ndarray, np.ndarray], classes: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The order with what is among the first shingles of many classes behind all that was known to be common."""
    rows = classes.select(F.explode("first").alias("h")).groupBy("h").count().where(F.col("count") > ALL_PAIRS).orderBy(F.desc("count"), "h").limit(HEAVY).toPandas()
    h, n = _ordered(rows)
    n = n + (known[1].max() if len(known[1]) else 0)
    old = ~np.isin(known[0], h)
    h, n = np.concatenate([known[0][old], h]), np.concatenate([known[1][old], n])
    order = np.argsort(h)
    return h[order], n[order]


def _runs(batches, names: list[str]):
    """Arrays of the rows of each ``h`` that has two rows or more, of a partition sorted by ``h``, by the second column."""
    held = None
    for b in chain(batches, [None]):
        if b is not None:
            now = np.stack([b[x].to_numpy(np.int64) for x in names])
            held = now if held is None else np.concatenate([held, now], axis=1)
        if held is None or not held.shape[1]:
            continue
        edges = np.flatnonzero(np.append(True, held[0, 1:] != held[0, :-1]))
        ends = np.append(edges[1:], held.shape[1])
        if b is not None:  # the last one may go on
            edges, ends = edges[:-1], ends[:-1]
        for i in np.flatnonzero(ends - edges > 1):
            run = held[:, edges[i] : ends[i]]
            yield run[:, np.argsort(run[1], kind="stable")]
        held = held[:, ends[-1] if len(ends) else 0 :]


def _fit(n: np.ndarray, p: np.ndarray, m: int, q: int) -> np.ndarray:
    """Whether sets of n and m shingles, of which p and q stand before the first one that they share, can be similar."""
    return np.minimum(n - p, m - q) * (SIMILARITY[0] + SIMILARITY[1]) >= SIMILARITY[0] * (n + m)


def _hubs(c: np.ndarray, n: np.ndarray, p: np.ndarray, label: np.ndarray, turn: int) -> np.ndarray:
    """Places of the classes of a group that its others are compared with in a turn: of those of about one size, which can be similar, the
    hubs of one label after the other and those of the largest label. A label's hub has the smallest part before the shingle."""
    order = np.lexsort((mix(c.view(np.uint64)), p / n))
    band = np.floor(np.log(n) / np.log(SIMILARITY[1] / SIMILARITY[0]))[order]
    out = []
    for v in np.unique(band):
        rows = order[band == v]
        names, first, size = np.unique(label[rows], return_index=True, return_counts=True)
        hubs, most = rows[np.sort(first)], rows[label[rows] == names[size.argmax()]]
        out += [hubs[turn % len(hubs)], most[turn % len(most)]]
    return np.unique(out)


def _pairs(members: DataFrame) -> DataFrame:
    """From ``(h, cls, n, p)``: pairs ``(x, y)`` of classes of a group ``h`` that can be similar, and the rows
    ``(h, x, n, p)`` of groups of more than ``ALL_PAIRS``, which are only compared with their hubs."""

    def run(batches):
        out, size = [], 0
        for h, c, n, p in _runs(batches, ["h", "cls", "n", "p"]):
            large = len(c) > ALL_PAIRS
            if large:
                yield pd.DataFrame({"x": c, "y": None, "h": h, "n": n, "p": p})
            got = []
            for i in _hubs(c, n, p, c, 0) if large else range(len(c) - 1):
                ok = np.flatnonzero(_fit(n, p, n[i], p[i]) & (c != c[i])) if large else i + 1 + np.flatnonzero(_fit(n[i + 1 :], p[i + 1 :], n[i], p[i]))
                got.append((np.minimum(c[ok], c[i]), np.maximum(c[ok], c[i])))
            out += got
            size += sum(len(x) for x, _ in got)
            if size > 50_000:
                x, y = (np.concatenate(v) for v in zip(*out))
                yield pd.DataFrame({"x": x, "y": y, "h": None, "n": None, "p": None})
                out, size = [], 0
        if size:
            x, y = (np.concatenate(v) for v in zip(*out))
            yield pd.DataFrame({"x": x, "y": y, "h": None, "n": None, "p": None})

    n = max(partitions(members.sparkSession), 2)
    return members.repartition(n, "h").sortWithinPartitions("h").mapInPandas(lean(run), "x bigint, y bigint, h bigint, n bigint, p bigint")


def _apart(members: DataFrame, turn: int | None = None) -> DataFrame:
    """All pairs of a group whose ``label`` differs and that can be similar; in a ``turn`` only those of its hubs."""

    def run(batches):
        for _, c, n, p, label in _runs(batches, ["h", "cls", "n", "p", "label"]):
            if (label != label[0]).any() and turn is not None:
                for one in _hubs(c, n, p, label, turn):
                    ok = np.flatnonzero(_fit(n, p, n[one], p[one]) & (label != label[one]))
                    if len(ok):
                        yield pd.DataFrame({"x": np.minimum(c[ok], c[one]), "y": np.maximum(c[ok], c[one])})
            elif (label != label[0]).any():
                for i in range(len(c) - 1):
                    ok = i + 1 + np.flatnonzero(_fit(n[i + 1 :], p[i + 1 :], n[i], p[i]) & (label[i + 1 :] != label[i]))
                    if len(ok):
                        yield pd.DataFrame({"x": np.full(len(ok), c[i]), "y": c[ok]})

    n = max(partitions(members.sparkSession), 2)
    return members.repartition(n, "h").sortWithinPartitions("h").mapInPandas(lean(run), "x bigint, y bigint")


def may_be_similar(m: int, a: np.ndarray, n: int, b: np.ndarray) -> bool:
    """Whether sets of m and n shingles with these first ones can be similar: what they share is among the first ones of
    both, or behind the first ones of one of them."""
    most = len(np.intersect1d(a, b, assume_unique=True)) + max(m - len(a), n - len(b))
    return most * (SIMILARITY[0] + SIMILARITY[1]) >= SIMILARITY[0] * (m + n)


def _verified(pairs: DataFrame, classes: DataFrame, signs: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """Those pairs whose sets are similar. Sets are made anew, for one row of each class that the first shingles leave: ``signs`` has the
    classes of rows, ``rows`` (``id, k1, k2, text``) their texts."""

    def hopeful(batches):
        for b in batches:
            ok = [may_be_similar(*r) for r in zip(b["m"], b["s"], b["n"], b["t"])]
            yield b.loc[ok, ["x", "y"]]

    def similar_ones(batches):
        for b in batches:
            ok = [similar(np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)) for p, q in zip(b["s"], b["t"])]
            yield b.loc[ok, ["x", "y"]]

    def whole(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingles(t, k).tobytes() for t in b.column(1).to_pylist()], pa.binary())], names=["cls", "set"])

    left = pairs.distinct().join(classes.select(F.col("cls").alias("x"), F.col("n").alias("m"), F.col("first").alias("s")), "x")
    both = left.join(classes.select(F.col("cls").alias("y"), "n", F.col("first").alias("t")), "y")
    some = cut(both.select("x", "y", "m", "s", "n", "t").mapInPandas(lean(hopeful), "x bigint, y bigint"))
    ends = some.select(F.col("x").alias("cls")).union(some.select("y")).distinct()
    wanted = cut(signs.join(ends, "cls").groupBy("cls").agg(F.min(F.struct("k1", "k2")).alias("at")).select("at.k1", "at.k2", "cls"))
    sets = rows.select("k1", "k2", "text").join(F.broadcast(wanted) if wanted.count() <= BROADCAST_KEYS else wanted, ["k1", "k2"]).select("cls", "text").mapInArrow(lean(whole), "cls bigint, set binary")
    sets = cut(sets.dropDuplicates(["cls"]))  # rows may repeat an id and a text
    left = some.join(sets.select(F.col("cls").alias("x"), F.col("set").alias("s")), "x")
    found = cut(left.join(sets.select(F.col("cls").alias("y"), F.col("set").alias("t")), "y").select("x", "y", "s", "t").mapInPandas(lean(similar_ones), "x bigint, y bigint"))
    for x in (some, wanted, sets):
        drop(x)
    return found


def _told_apart(signs: DataFrame) -> DataFrame:
    """Signs whose classes hold equal sets only: where sets share the class, but not ``other``, each gets a class of its own."""
    clash = signs.select("cls", "other").distinct().groupBy("cls").agg(F.count("*").alias("n")).where("n > 1").select("cls", F.lit(True).alias("clash"))
    clash = cut(clash)
    if clash.isEmpty():
        return signs.drop("other")
    cls = F.when(F.col("clash"), F.xxhash64("cls", "other")).otherwise(F.col("cls"))
    return cut(signs.join(F.broadcast(clash) if clash.count() <= BROADCAST_KEYS else clash, "cls", "left").withColumn("cls", cls).drop("other", "clash"))


def _proposed(classes: DataFrame) -> DataFrame:
    """Pairs ``(x, y)`` of classes with equal fingerprints, or such within the radius of the trees."""
    prints = cut(classes.groupBy("fp").agg(F.min("cls").alias("rep")))
    same = classes.join(prints, "fp").where("cls <> rep").select(F.col("rep").alias("a"), F.col("cls").alias("b"))
    both = same.union(near_edges(prints))
    return both.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"))


def set_neardup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE_WORDS) -> DataFrame:
    """``doc_id, k1, k2, component_id`` (the smallest id reachable by pairs of the similarity) and ``kept``, a row per document;
    ``k1, k2`` is the row's key by id and text.

    Of each component the row with the smallest id is kept, and of those with that id the one with the smallest
    key. Null and empty texts have the empty set and are alike; very long ones are compared by all their shingles. A row with a null id is returned with a null component,
    and kept. Rows that repeat an id are returned each. Other columns are ignored. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(text_col).alias("text"))
    small_batches(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["id", "k1", "k2", "cls", "other", "n", "first", "fp"]
    rows = docs.select(F.col(id_col).alias("id"), *row_key(F.col(id_col), F.col(text_col)), F.col(text_col).alias("text"))

    def signs_of(order) -> DataFrame:
        known = spark.sparkContext.broadcast(order)

        def signed(batches):
            for b in (whole.slice(a, 1000) for whole in batches for a in range(0, whole.num_rows, 1000)):
                sets = [shingles(t, k) for t in b.column(3).to_pylist()]
                first = [first_shingles(s, *known.value).view(np.int64) for s in sets]
                prints = np.array([vote(s) for s in sets], np.uint64).view(np.int64)
                own = np.array([class_of(s) for s in sets], np.int64).reshape(-1, 2)
                columns = (pa.array(own[:, 0]), pa.array(own[:, 1]), pa.array([len(s) for s in sets], pa.int32()), pa.array(first, pa.list_(pa.int64())), pa.array(prints))
                yield pa.RecordBatch.from_arrays([*b.columns[:3], *columns], names=names)

        return rows.mapInArrow(lean(signed), f"id {kind}, k1 bigint, k2 bigint, cls bigint, other bigint, n int, first array<bigint>, fp bigint")

    order = _common(texts, k)
    order = _heavier(order, signs_of(order).where("id is not null").select("cls", "first").dropDuplicates(["cls"]))
    signs = _told_apart(cut(signs_of(order)))
    best = F.min(F.struct("id", "k1", "k2")).alias("best")
    classes = cut(signs.where("id is not null").groupBy("cls").agg(best, F.first("n").alias("n"), F.first("first").alias("first"), F.first("fp").alias("fp")))
    met = cut(_pairs(classes.select(F.posexplode("first").alias("p", "h"), "cls", "n").select("h", "cls", "n", "p")))
    near = _verified(met.where("h is null").select("x", "y").union(_proposed(classes.select("fp", "cls"))), classes, signs, rows, k)
    label, exact = connected_components(near, "x", "y"), True
    large = met.where("h is not null").select("h", F.col("x").alias("cls"), "n", "p")
    turns, few = [None, *reversed(range(TURNS))], classes.count() // FRUITFUL[1]
    while turns:
        turn = turns.pop()
        now = large.join(label, F.col("cls") == F.col("node"), "left").select("h", "cls", "n", "p", F.coalesce("component", "cls").alias("label"))
        pairs = cut(_apart(now, turn).distinct())
        asked = pairs.count()
        found = _verified(pairs, classes, signs, rows, k) if asked else pairs
        alike = found.count() if asked else 0
        if alike:
            near, exact = near.union(found), False
        if not asked or alike * FRUITFUL[0] < asked and alike <= few:
            turns = turns[:1]  # further turns would hardly lessen what is left for the end
        if alike and turns:  # labels that may be too many bear on the cost only
            label = merged(label, found)
        drop(pairs)
    if not exact:
        label = connected_components(near, "x", "y")
    least = classes.join(label, F.col("cls") == F.col("node"), "left").select("cls", "best", F.coalesce("component", "cls").alias("label"))
    found = least.join(least.groupBy("label").agg(F.min("best").alias("chosen")), "label").select("cls", "chosen")
    out = signs.select("id", "k1", "k2", "cls").join(found, "cls", "left")
    none = F.col("id").isNull()
    kept = none | ((F.col("id") == F.col("chosen.id")) & (F.col("k1") == F.col("chosen.k1")) & (F.col("k2") == F.col("chosen.k2")))
    return out.select(F.col("id").alias(id_col), "k1", "k2", F.when(~none, F.col("chosen.id")).alias("component_id"), kept.alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE_WORDS) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one of each component, and those without an id; of rows
    that repeat an id and a text one stays. Cases as in ``set_neardup``."""
    found = cut(set_neardup(docs, id_col, text_col, k).select("k1", "k2", "kept"))
    left = without(docs, found.where("not kept").select("k1", "k2").distinct(), id_col, text_col)
    again = cut(found.where("kept").groupBy("k1", "k2").count().where("count > 1"))
    if again.isEmpty():
        return left
    k1, k2 = row_key(F.col(id_col), F.col(text_col))
    twice = without(left, again, id_col, text_col, "left_semi").withColumns({"_key1": k1, "_key2": k2}).dropDuplicates(["_key1", "_key2"]).drop("_key1", "_key2")
    return without(left, again, id_col, text_col).union(twice)
