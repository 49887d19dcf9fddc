"""Quality by hierarchical empirical Bayes: evidence of a document classifier, combined with the posteriors of its
host and of its path on that host.

Two linear classifiers (quality, toxic) over distinct words, their beginnings, and a few shape features are fitted on a bounded
sample of labelled rows and give each document's log odds. For each host the expected share of good
documents is a beta posterior, (sum of p + s m) / (n + s), around the global share m; for each path it is one
around its host's share. A document's own p is left out of its sums, as its evidence counts already. The strengths
s follow from the spread of the groups (moments), within ``STRENGTH``, so sparse sites shrink to their prior. A
document's odds are its evidence times the ratio of its path's odds to the global ones.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidra.llm.common import cut, lean, small_batches

#: Labelled rows that the classifier is fitted on, about; chosen by a hash of the id.
SAMPLE = 12_000
#: A word has a weight if it is in this many documents of the sample and its share of a label's documents is so
#: many standard errors off the label's own share: words that occur by chance are many and hide the few that tell.
LEAST_DOCS = 4
LEAST_Z = 4.0
L2 = 0.3
#: Lengths of beginnings of words, in bytes, and features that may have a weight.
BEGINNINGS = (6,)
FEATURES = 50_000
#: Log odds where a label has one class, or none: quality is then good, toxicity absent.
SURE = 30.0
STEPS = 150
HEADS = ("quality", "toxic")
#: Least and greatest strength of a prior, in documents.
STRENGTH = (10.0, 1e4)
#: Sites (a host's path each) up to this number are broadcast.
BROADCAST_SITES = 500_000
#: Entries of a task's table of words, after which it is emptied, and rows that a task reads at once.
WORDS = 200_000
ROWS = 500
_PUNCT = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
_ALL = (1 << 64) - 1
_MARKS = (b"!!", b"***", b"$$$", b"%%%", b"&&&", b"###", b" | ", b"http", b"{", b"<", b"=", b"_")


def shape(raw: bytes, tokens: int, distinct: int) -> list[float]:
    """A few numbers about a text, each 0 to about 1."""
    n = max(len(raw), 1)
    upper = n - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    letters = n - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"))
    digits = n - len(raw.translate(None, b"0123456789"))
    t = max(tokens, 1)
    return [
        1.0,
        upper / max(letters, 1),
        digits / n,
        min(1.0, math.log1p(tokens) / 8),
        float(tokens < 5),
        distinct / t,
        min(1.0, t / max(distinct, 1) / 20),
        min(1.0, raw.count(b"\n") / t * 5),
        *(min(1.0, raw.count(m) / t * 3) for m in _MARKS),
    ]


SHAPES = 8 + len(_MARKS)


def read(text: str | None) -> tuple[set[bytes], list[float]]:
    """Distinct words and the shape of a text; a null text is empty."""
    raw = (text or "").encode("utf-8", "replace")
    words = raw.translate(_PUNCT).lower().split()
    distinct = set(words)
    return distinct, shape(raw, len(words), len(distinct))


def fit(rows: list[tuple[np.ndarray, list[float], dict[str, float]]], heads: tuple[str, ...] = HEADS) -> dict:
    """Weights from (feature hashes, shape, labels) rows: logistic regression with an L2 term. A beginning counts for each word that has it.

    A head with one class always says that class; one without labels says that a document is good. Rows with
    a null label of a head don't train it.
    """
    ids = np.concatenate([r[0] for r in rows]) if rows else np.zeros(0, np.int64)
    u, at, n = np.unique(ids, return_inverse=True, return_counts=True)
    doc = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    keep = np.zeros(len(u), bool)
    for head in heads:
        y = np.array([np.nan if r[2].get(head) is None else float(r[2][head]) for r in rows])
        use = ~np.isnan(y)
        if use.any() and 0 < y[use].mean() < 1:
            m, labelled = y[use].mean(), np.bincount(at, weights=use[doc], minlength=len(u))
            z = (np.bincount(at, weights=np.where(use, y, 0)[doc], minlength=len(u)) - labelled * m) / np.sqrt(np.maximum(labelled, 1) * m * (1 - m))
            keep |= np.abs(z) >= LEAST_Z
    u = u[keep & (n >= LEAST_DOCS)]
    at = np.minimum(np.searchsorted(u, ids), max(len(u) - 1, 0))
    ok = u[at] == ids if len(u) else np.zeros(len(ids), bool)
    doc, at = doc[ok], at[ok]
    dense = np.array([r[1] for r in rows]).reshape(len(rows), SHAPES)
    model = {"words": u, "heads": {}}
    for head in heads:
        y = np.array([np.nan if r[2].get(head) is None else float(r[2][head]) for r in rows])
        use = ~np.isnan(y)
        w, v = np.zeros(len(u)), np.zeros(SHAPES)
        v[0] = SURE if (y[use].mean() if use.any() else float(head != "toxic")) > 0.5 else -SURE
        if use.any() and 0 < y[use].mean() < 1:
            v[0] = 0.0
            yy, m = np.where(use, y, 0), use.sum()
            mw, mv, sw, sv = np.zeros_like(w), np.zeros_like(v), np.zeros_like(w), np.zeros_like(v)
            for t in range(1, STEPS + 1):
                z = np.bincount(doc, weights=w[at], minlength=len(rows)) + dense @ v
                r = np.where(use, 1 / (1 + np.exp(-np.clip(z, -30, 30))) - yy, 0)
                gw = (np.bincount(at, weights=r[doc], minlength=len(u)) + L2 * w) / m
                gv = (dense.T @ r + 0.01 * L2 * v) / m
                for x, g, m1, m2 in ((w, gw, mw, sw), (v, gv, mv, sv)):
                    m1 *= 0.9
                    m1 += 0.1 * g
                    m2 *= 0.99
                    m2 += 0.01 * g * g
                    x -= 0.1 * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.99**t)) + 1e-8)
        model["heads"][head] = (w, v)
    return model


def hashes(words: set[bytes]) -> np.ndarray:
    """Numbers of the features of distinct words: of each word itself, and of its beginnings that are shorter than it."""
    digest = xxhash.xxh64_intdigest
    return np.array([digest(f) for w in words for f in (w, *(b"^" + w[:k] for k in BEGINNINGS if len(w) > k))], np.uint64).view(np.int64)


def _chosen(some: DataFrame, heads: tuple[str, ...], most: int = FEATURES) -> np.ndarray:
    """The features that tell a label apart, by the same test as in ``fit``, counted on the executors; the ``most`` strongest."""
    sums = [f"{k}_{h}" for h in heads for k in ("n", "y")]

    def counted(batches):
        for b in (x.iloc[a : a + ROWS] for x in batches for a in range(0, len(x), ROWS)):
            got = [hashes(read(t)[0]) for t in b["text"]]
            ids = np.concatenate(got) if got else np.zeros(0, np.int64)
            u, at, n = np.unique(ids, return_inverse=True, return_counts=True)
            out = {"hash": u, "n": n}
            for h in heads:
                y = np.repeat(b[h].to_numpy(float), [len(g) for g in got])
                out |= {f"n_{h}": np.bincount(at, weights=~np.isnan(y), minlength=len(u)), f"y_{h}": np.bincount(at, weights=np.nan_to_num(y), minlength=len(u))}
            yield pd.DataFrame(out)

    counts = some.mapInPandas(lean(counted), "hash bigint, n bigint, " + ", ".join(f"{c} double" for c in sums)).groupBy("hash").agg(*(F.sum(c).alias(c) for c in ("n", *sums)))
    means = some.agg(*(F.avg(h).alias(h) for h in heads)).first()
    z = [
        F.abs((F.col(f"y_{h}") - F.col(f"n_{h}") * m) / F.sqrt(F.greatest(F.col(f"n_{h}"), F.lit(1.0)) * m * (1 - m)))
        for h in heads
        for m in [means[h]]
        if m is not None and 0 < m < 1
    ]
    if not z:
        return np.zeros(0, np.int64)
    rows = counts.where(F.col("n") >= LEAST_DOCS).select("hash", F.greatest(*z, F.lit(0.0)).alias("z")).where(F.col("z") >= LEAST_Z)
    return np.sort(np.array([r["hash"] for r in rows.orderBy(F.desc("z"), "hash").limit(most).collect()], np.int64))


def _sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_id: str, heads: tuple[str, ...], sample: int) -> list:
    """Features of about ``sample`` labelled documents, computed on the executors: those that tell a label apart. Of rows that share an id
    the least text counts."""
    rows = labels.where(F.col(label_id).isNotNull())
    of = max(1, -(-rows.count() // sample))
    rows = rows.where(F.pmod(F.xxhash64(label_id), F.lit(of)) == 0).groupBy(F.col(label_id).alias("id")).agg(*(F.max(F.col(h).cast("double")).alias(h) for h in heads))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.pmod(F.xxhash64("id"), F.lit(of)) == 0)
    some = texts.join(F.broadcast(rows), "id")  # about ``sample`` rows of labels
    some = cut(some.groupBy("id").agg(F.min("text").alias("text"), *(F.max(h).alias(h) for h in heads)).select("text", *heads))  # so an id of very many rows is one
    chosen = docs.sparkSession.sparkContext.broadcast(_chosen(some, heads))

    def features(batches):
        known = chosen.value
        for b in (x.iloc[a : a + ROWS] for x in batches for a in range(0, len(x), ROWS)):
            got = [read(t) for t in b["text"]]
            told = [h[np.isin(h, known)] for h in (hashes(g[0]) for g in got)]
            yield pd.DataFrame({"hashes": [h.tobytes() for h in told], "shape": [np.array(g[1]).tobytes() for g in got], **{h: b[h].to_numpy() for h in heads}})

    out = some.mapInPandas(lean(features), "hashes binary, shape binary, " + ", ".join(f"{h} double" for h in heads))
    found = [(np.frombuffer(r["hashes"], np.int64), np.frombuffer(r["shape"]), {h: None if r[h] is None or math.isnan(r[h]) else r[h] for h in heads}) for r in out.collect()]
    return sorted(found, key=lambda r: (r[0].tobytes(), r[1].tobytes(), str(r[2])))  # in one order, whatever tasks end first


def evidence(docs: DataFrame, model: dict, id_col: str, text_col: str, host: Column, path: Column, keep: tuple[str, ...] = ()) -> DataFrame:
    """``id, host, path, z_<head>``: log odds of each document by its text alone; columns ``keep`` as ``keep0`` and so on."""
    heads = tuple(model["heads"])
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((model["words"], np.stack([model["heads"][h][0] for h in heads], 1), np.stack([model["heads"][h][1] for h in heads], 1)))
    kept = [(f"keep{i}", c) for i, c in enumerate(keep)]
    names = ["id", "host", "path", *(k for k, _ in kept), *(f"z_{h}" for h in heads)]

    def run(batches):
        u, w, v = shared.value
        weights = {k & _ALL: np.array(x) for k, x in zip(u.tolist(), w.tolist())}
        digest = xxhash.xxh64_intdigest
        known = {}
        for b in (whole.slice(a, ROWS) for whole in batches for a in range(0, whole.num_rows, ROWS)):
            z = np.zeros((b.num_rows, len(heads)))
            for i, t in enumerate(b.column(b.num_columns - 1).to_pylist()):
                words, s = read(t)
                if len(known) > WORDS:
                    known.clear()
                for x in words.difference(known):
                    total = weights.get(digest(x))
                    for k in BEGINNINGS:
                        if len(x) > k and (more := weights.get(digest(b"^" + x[:k]))) is not None:
                            total = more if total is None else total + more
                    known[x] = total
                hit = [k for k in map(known.__getitem__, words) if k is not None]
                z[i] = np.array(s) @ v
                if hit:
                    z[i] += np.sum(hit, axis=0)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *(pa.array(z[:, k]) for k in range(len(heads)))], names=names)

    site = [host.cast("string").alias("host"), path.cast("string").alias("path")]
    rows = docs.select(F.col(id_col).alias("id"), *site, *(F.col(c).alias(k) for k, c in kept), F.col(text_col).alias("text"))
    schema = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]] + [f"z_{h} double" for h in heads]
    return rows.mapInArrow(lean(run), ", ".join(schema))


def _strength(groups: DataFrame, head: str, mean: float) -> float:
    """Beta strength from the spread of group means: m (1 - m) / between - 1, within bounds."""
    n, p, pp = F.col("n"), F.col(f"p_{head}"), F.col(f"pp_{head}")
    r = groups.where("n > 1").select(F.count("*"), F.avg(F.pow(p / n - mean, 2)), F.avg((pp / n - F.pow(p / n, 2)) / n)).first()
    if not r[0]:
        return 100.0
    between = max(r[1] - max(r[2], 0.0), 1e-9)
    return float(min(STRENGTH[1], max(STRENGTH[0], mean * (1 - mean) / between - 1)))


def _logit(c: Column) -> Column:
    return F.log(c) - F.log(1 - c)


def posterior(z: DataFrame, heads: tuple[str, ...] = HEADS) -> DataFrame:
    """Adds ``p_<head>`` to rows with ``host, path, z_<head>``: the evidence and the posteriors of the row's site, which
    the row itself is left out of. A null host or path is a group of its own."""
    p = {h: 1 / (1 + F.exp(-F.col(f"z_{h}"))) for h in heads}
    sums = [F.sum(x).alias(f"{k}_{h}") for h in heads for k, x in (("p", p[h]), ("pp", p[h] * p[h]))]
    paths = cut(z.groupBy("host", "path").agg(F.count("*").alias("n"), *sums))
    both = lambda g: g.agg(F.sum("n").alias("n"), *(F.sum(f"{k}_{h}").alias(f"{k}_{h}") for h in heads for k in ("p", "pp")))
    hosts = both(paths.groupBy("host"))
    total = both(hosts).first()
    named = hosts.select(F.col("host").alias("of_host"), F.col("n").alias("n_host"), *(F.col(f"p_{h}").alias(f"host_{h}") for h in heads))
    sites = paths.join(named, F.col("host").eqNullSafe(F.col("of_host"))).select(
        F.col("host").alias("site_host"), F.col("path").alias("site_path"), F.col("n").alias("n_path"), "n_host", *(F.col(f"p_{h}").alias(f"path_{h}") for h in heads), *(f"host_{h}" for h in heads)
    )
    sites = cut(sites)
    sites = F.broadcast(sites) if sites.count() <= BROADCAST_SITES else sites
    out = z.join(sites, F.col("host").eqNullSafe(F.col("site_host")) & F.col("path").eqNullSafe(F.col("site_path")))
    for h in heads:
        mean = min(1 - 1e-6, max(1e-6, total[f"p_{h}"] / total["n"])) if total["n"] else 0.5
        sh, sp = _strength(hosts, h, mean), _strength(paths, h, mean)
        share = (F.col(f"host_{h}") - p[h] + sh * mean) / (F.col("n_host") - 1 + sh)
        share = (F.col(f"path_{h}") - p[h] + sp * share) / (F.col("n_path") - 1 + sp)
        shift = _logit(F.least(F.greatest(share, F.lit(1e-9)), F.lit(1 - 1e-9))) - math.log(mean / (1 - mean))
        out = out.withColumn(f"p_{h}", 1 / (1 + F.exp(-(F.col(f"z_{h}") + shift))))
    return out.drop("site_host", "site_path", "n_path", "n_host", *(f"{k}_{h}" for h in heads for k in ("path", "host")))


_KEPT = "p_quality >= 0.5 and p_toxic < 0.5"


def quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host: str | Column = "source", path: str | Column = "lang", label_id: str = "doc_id", sample: int = SAMPLE
) -> DataFrame:
    """One row per document: id, host, path, ``p_quality``, ``p_toxic``, ``kept``.

    A document is kept if p_quality >= 0.5 and p_toxic < 0.5. Null and empty texts have only their shape as
    evidence; very long ones are read whole; a null host or path is a group of its own. Rows that repeat an id, or have
    none, are scored each; a document labelled twice counts as of good quality, or toxic, if one label says so; labels
    with a null id are left out. Without labelled rows every document is kept. The classifier is fitted on about ``sample``
    labelled rows; strengths of priors stay within ``STRENGTH``. Other columns, of both tables, are ignored; an empty table gives none.
    """
    host, path = (F.col(x) if isinstance(x, str) else x for x in (host, path))
    model = fit(_sample(docs, labels, id_col, text_col, label_id, HEADS, sample))
    out = posterior(cut(evidence(docs, model, id_col, text_col, host, path)))
    return out.select(F.col("id").alias(id_col), "host", "path", "p_quality", "p_toxic", F.expr(_KEPT).alias("kept"))


def drop_rejected(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host: str | Column = "source", path: str | Column = "lang", label_id: str = "doc_id", sample: int = SAMPLE
) -> DataFrame:
    """The rows of ``docs`` that ``quality`` keeps, with all their columns; cases as there.

    The decision is on the row: texts are read twice, once for the sums of their sites and once for the row, and never
    shuffled, unless there are more than ``BROADCAST_SITES`` sites.
    """
    host, path = (F.col(x) if isinstance(x, str) else x for x in (host, path))
    model = fit(_sample(docs, labels, id_col, text_col, label_id, HEADS, sample))
    columns = docs.columns
    out = posterior(evidence(docs, model, id_col, text_col, host, path, tuple(columns))).where(_KEPT)
    return out.select(*(F.col(f"keep{i}").alias(c) for i, c in enumerate(columns)))


def op10_quality(spark, sf_dir: str) -> DataFrame:
    """``quality`` over all documents, fitted on ``labels``; the host is the source. The table has no path: the language
    stands in for it."""
    return quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
