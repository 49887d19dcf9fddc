"""Toxic spans by a linear-chain conditional random field over words; documents are scored by what its marginals add up to.

The field has two states, plain and toxic. A word speaks for the toxic state by weights of the word, its beginnings and its endings,
and of its neighbours; two weights for each pair of states and for the start tie neighbours together. Forward and backward sums
give each word's marginal, over texts of any length; runs of words of 0.5 or more are the offending spans.

Labels mark documents, not words, so words are labelled first: a feature tells if its share of the different words of toxic
documents is so many standard errors above its share in others, and a word of a toxic document is toxic if at least
``SURPLUS`` of the occurrences of one of its telling features are beyond what plain documents have. Features are counted by Spark; the
field is fitted on segments of the sample's texts, and a logistic function of the marginals on its documents.
"""

from __future__ import annotations

import re
from collections import Counter
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidra.llm.common import cut

#: Labelled rows that the model is fitted on, about; chosen by a hash of the id. Equal texts count once.
SAMPLE = 12_000
#: Features that the field may weigh, those with the strongest signs; a feature is in so many documents of the sample.
FEATURES = 30_000
LEAST_DOCS = 5
LEAST_Z = 3.0
#: When a feature marks words: standard errors, and the share of its occurrences that only toxic documents explain.
TELLING_Z = 5.0
SURPLUS = 0.75
#: Words of a segment; segments of a document that train the field, with a toxic word and without.
SEGMENT = 32
WITH_TOXIC, WITHOUT = 4, 2
STEPS = 100
L2 = 1.0
#: Marginal of a word in a span, and score of a document that is called toxic.
SPAN = 0.5
TOXIC = 0.7
#: Entries of a task's table of words, after which it is emptied, and rows that a task reads at once.
WORDS = 200_000
ROWS = 200
_WORD = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> list[str]:
    return list(map(str.lower, _WORD.findall(text or "")))


def features(word: str) -> list[str]:
    """The word itself, its beginnings of 3 to 8 characters and its endings of 2 to 4."""
    n = len(word)
    return ["=" + word, *("^" + word[:k] for k in range(3, min(n, 9))), *("$" + word[-k:] for k in range(2, min(n, 5)))]


def marginals(u: np.ndarray, first: np.ndarray, start: np.ndarray, trans: np.ndarray, pairs: bool = False):
    """Marginal of the toxic state of each word, and with ``pairs`` those of (state before, state) and the log of the total.

    ``u``: what speaks for the toxic state; ``first``: where a sequence begins; ``start``, ``trans``: logs. All sequences are one
    chain that forgets at each beginning; it is cut in equal lanes, whose products of matrices give each lane its ends.
    """
    n = len(u)
    lanes = max(1, int(n**0.5))
    steps = -(-n // lanes)
    fill = lanes * steps - n
    e = np.exp(np.clip(np.concatenate([u, np.zeros(fill)]), -30, 30))
    f = np.concatenate([first, np.ones(fill, bool)])
    s, t = np.exp(start), np.exp(trans)
    lay = lambda x: np.ascontiguousarray(x.reshape(lanes, steps).T)
    m = [[lay(np.where(f, s[j], t[i, j]) * (e if j else 1.0)) for j in (0, 1)] for i in (0, 1)]
    p = [[np.ones(lanes), np.zeros(lanes)], [np.zeros(lanes), np.ones(lanes)]]
    for k in range(steps):
        p = [[p[i][0] * m[0][j][k] + p[i][1] * m[1][j][k] for j in (0, 1)] for i in (0, 1)]
        total = p[0][0] + p[0][1] + p[1][0] + p[1][1]
        p = [[x / total for x in row] for row in p]
    enter, leave = np.empty((2, lanes)), np.empty((2, lanes))
    a0 = a1 = b0 = b1 = 0.5
    whole = np.array(p).reshape(4, lanes).T.tolist()
    for k, (p00, p01, p10, p11) in enumerate(whole):
        enter[:, k] = a0, a1
        a0, a1 = a0 * p00 + a1 * p10, a0 * p01 + a1 * p11
        a0, a1 = a0 / (a0 + a1), a1 / (a0 + a1)
    for k in range(lanes - 1, -1, -1):
        p00, p01, p10, p11 = whole[k]
        leave[:, k] = b0, b1
        b0, b1 = p00 * b0 + p01 * b1, p10 * b0 + p11 * b1
        b0, b1 = b0 / (b0 + b1), b1 / (b0 + b1)
    ahead, behind, sums = np.empty((2, steps, lanes)), np.empty((2, steps, lanes)), np.empty((steps, lanes))
    x0, x1 = enter
    for k in range(steps):
        x0, x1 = x0 * m[0][0][k] + x1 * m[1][0][k], x0 * m[0][1][k] + x1 * m[1][1][k]
        sums[k] = x0 + x1
        x0, x1 = x0 / sums[k], x1 / sums[k]
        ahead[0, k], ahead[1, k] = x0, x1
    y0, y1 = leave
    for k in range(steps - 1, -1, -1):
        behind[0, k], behind[1, k] = y0, y1
        y0, y1 = m[0][0][k] * y0 + m[0][1][k] * y1, m[1][0][k] * y0 + m[1][1][k] * y1
        total = y0 + y1
        y0, y1 = y0 / total, y1 / total
    flat = lambda x: x.T.reshape(-1)[:n]
    a, b = np.stack([flat(ahead[0]), flat(ahead[1])]), np.stack([flat(behind[0]), flat(behind[1])])
    z = (a * b).sum(0)
    out = a[1] * b[1] / z
    if not pairs:
        return out
    inner = np.flatnonzero(~first)
    xi = np.stack([np.stack([a[i, inner - 1] * t[i, j] * (e[inner] if j else 1.0) * b[j, inner] for j in (0, 1)]) for i in (0, 1)])
    return out, xi / xi.sum((0, 1)), float(np.log(flat(sums)).sum())


class Field:
    """Weights by feature; of the words that are features, what they say about their neighbours."""

    def __init__(self, own: dict[str, float], before: dict[str, float], after: dict[str, float], start: np.ndarray, trans: np.ndarray, scorer: np.ndarray | None = None):
        self.own, self.before, self.after, self.start, self.trans, self.scorer = own, before, after, start, trans, scorer
        self.known: dict[str, int] = {}
        self.table = np.zeros((1024, 3))

    def ids(self, tokens: list[str]) -> list[int]:
        known = self.known
        for w in set(tokens).difference(known):
            k = len(known)
            if k == len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            own = self.own
            self.table[k] = sum(own[f] for f in features(w) if f in own), self.before.get(w, 0.0), self.after.get(w, 0.0)
            known[w] = k
        return list(map(known.__getitem__, tokens))

    def marginals(self, texts: list[list[str]]) -> list[np.ndarray]:
        """Of each text's words."""
        if len(self.known) > WORDS:
            self.known.clear()
        sizes = [len(t) for t in texts]
        ids = np.array([i for t in texts for i in self.ids(t)], np.int64)
        if not len(ids):
            return [np.zeros(0) for _ in texts]
        first = np.zeros(len(ids), bool)
        first[[a for a, n in zip(np.cumsum([0, *sizes[:-1]]), sizes) if n]] = True
        return np.split(marginals(speaks(self.table[ids], first), first, self.start, self.trans), np.cumsum(sizes)[:-1])

    def score(self, rows: np.ndarray) -> np.ndarray:
        """0 to 1, of rows of ``signs``."""
        return 1 / (1 + np.exp(-np.clip(rows @ self.scorer, -30, 30)))


def speaks(table: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Own weights and those of the neighbours within the sequence."""
    u = table[:, 0].copy()
    inner = np.flatnonzero(~first)
    u[inner] += table[inner - 1, 1]
    u[inner - 1] += table[inner, 2]
    return u


SIGNS = 7


def signs(p: np.ndarray, ids: list[str]) -> list[float]:
    """What a document's marginals add up to: toxic words and all words (whose weighted difference is the evidence for one rate
    against another), at least one toxic word, the surest one, different ones."""
    if not len(p):
        return [1.0] + [0.0] * (SIGNS - 1)
    e, hit = float(p.sum()), np.flatnonzero(p >= SPAN)
    different = len({ids[i] for i in hit})
    return [1.0, min(e, 100.0) / 5, min(len(p), 5000) / 250, float(np.log1p(e)), min(10.0, -float(np.log1p(-np.minimum(p, 1 - 1e-6)).sum())), float(p.max()), min(different, 5.0)]


def spans(text: str, p: np.ndarray) -> str:
    """Offsets, in code points, of runs of toxic words: ``start:end`` (end exclusive), comma-joined."""
    if not (p >= SPAN).any():
        return ""
    runs = ([m for _, m in g] for toxic, g in groupby(zip(p >= SPAN, _WORD.finditer(text)), key=lambda x: bool(x[0])) if toxic)
    return ",".join(f"{ms[0].start()}:{ms[-1].end()}" for ms in runs)


def _adam(x: dict[str, np.ndarray], gradient, steps: int, rate: float) -> None:
    m1, m2 = ({k: np.zeros_like(v) for k, v in x.items()} for _ in range(2))
    for t in range(1, steps + 1):
        for k, g in gradient().items():
            m1[k] += 0.1 * (g - m1[k])
            m2[k] += 0.01 * (g * g - m2[k])
            x[k] -= rate * (m1[k] / (1 - 0.9**t)) / (np.sqrt(m2[k] / (1 - 0.99**t)) + 1e-8)


def fit_field(segments: list[tuple[list[str], list[bool]]], chosen: list[str], steps: int = STEPS) -> Field:
    """Weights of the ``chosen`` features by likelihood of the labelled segments, with an L2 term."""
    at = {f: i for i, f in enumerate(chosen)}
    types: dict[str, int] = {}
    ids = np.array([types.setdefault(w, len(types)) for ws, _ in segments for w in ws], np.int64)
    y = np.array([x for _, ys in segments for x in ys], float)
    first = np.zeros(len(ids), bool)
    first[np.cumsum([0, *(len(ws) for ws, _ in segments)])[:-1]] = True
    found = [[at[f] for f in features(w) if f in at] for w in types]
    owner, feature = np.repeat(np.arange(len(types)), [len(f) for f in found]), np.array([i for f in found for i in f], np.int64)
    context = np.array([at.get("=" + w, len(at)) for w in types], np.int64)
    x = {"own": np.zeros(len(at)), "before": np.zeros(len(at) + 1), "after": np.zeros(len(at) + 1), "start": np.zeros(2), "trans": np.zeros((2, 2))}
    inner, n = np.flatnonzero(~first), max(1, int(first.sum()))
    yi = y.astype(int)
    seen = np.array([[((yi[inner - 1] == i) & (yi[inner] == j)).sum() for j in (0, 1)] for i in (0, 1)], float)
    begun = np.array([(yi[first] == j).sum() for j in (0, 1)], float)

    def gradient():
        table = np.stack([np.bincount(owner, x["own"][feature], len(types)), x["before"][context], x["after"][context]], 1)
        p, xi, _ = marginals(speaks(table[ids], first), first, x["start"], x["trans"], pairs=True)
        r = p - y
        by = lambda t, k: np.bincount(context[t], k, len(at) + 1)
        g = {
            "own": np.bincount(feature, np.bincount(ids, r, len(types))[owner], len(at)),
            "before": by(ids[inner - 1], r[inner]),
            "after": by(ids[inner], r[inner - 1]),
            "start": np.array([(1 - p[first]).sum(), p[first].sum()]) - begun,
            "trans": xi.sum(2) - seen,
        }
        g["before"][-1] = g["after"][-1] = 0.0  # words without weights of their own
        return {k: (v + L2 * x[k]) / n for k, v in g.items()}

    if len(ids):
        _adam(x, gradient, steps, 0.1)
    heads = {k: {f[1:]: float(x[k][i]) for f, i in at.items() if f[0] == "="} for k in ("before", "after")}
    return Field({f: float(x["own"][i]) for f, i in at.items()}, heads["before"], heads["after"], x["start"], x["trans"])


def fit_scorer(rows: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression on the signs of documents; one class, or none, gives a sure answer."""
    if not len(y) or y.min() == y.max():
        return np.array([30.0 if len(y) and y[0] else -30.0] + [0.0] * (SIGNS - 1))
    scale = np.maximum(rows.std(0), 1e-3)
    scale[0] = 1.0
    x = {"w": np.zeros(SIGNS)}
    _adam(x, lambda: {"w": ((rows / scale).T @ (1 / (1 + np.exp(-np.clip(rows / scale @ x["w"], -30, 30))) - y) + 0.1 * x["w"] * (np.arange(SIGNS) > 0)) / len(y)}, 1500, 0.05)
    return x["w"] / scale


def sample_of(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_id: str, label: str, train: Column | None, sample: int) -> DataFrame:
    """``text, y`` of about ``sample`` labelled documents, each text once; of rows that share an id the least text counts."""
    rows = labels.select(F.col(label_id).alias("i"), F.col(label).cast("double").alias("l")).where("i is not null and l is not null")
    if train is not None:
        rows = rows.withColumnRenamed("i", id_col).where(train).withColumnRenamed(id_col, "i")
    of = max(1, -(-rows.count() // sample))
    rows = rows.where(F.pmod(F.xxhash64("i", F.lit(11)), F.lit(of)) == 0).groupBy("i").agg(F.max("l").alias("y"))
    texts = docs.select(F.col(id_col).alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).where(F.pmod(F.xxhash64("i", F.lit(11)), F.lit(of)) == 0)
    texts = texts.join(F.broadcast(rows) if of > 1 or sample <= 1_000_000 else rows, "i")  # about ``sample`` rows of two numbers
    texts = texts.groupBy("i").agg(F.min("text").alias("text"), F.max("y").alias("y"))  # so an id of very many rows is one
    return cut(texts.groupBy("text").agg(F.max("y").alias("y")))


def _counted(batches):
    """Different words of toxic and of plain documents by feature, and the documents that have it."""
    toxic, plain, docs = Counter(), Counter(), Counter()

    def send():
        names = list(docs)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([c[f] for f in names], pa.int64()) for c in (toxic, plain, docs))], names=["feature", "toxic", "plain", "docs"])
        for c in (toxic, plain, docs):
            c.clear()

    for b in batches:
        for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            found = [f for w in set(words(text)) for f in ("", *features(w))]
            (toxic if y else plain).update(found)
            docs.update(set(found))
            if len(docs) > 500_000:
                yield from send()
    yield from send()


def choose(sample: DataFrame, most: int = FEATURES) -> tuple[list[str], set[str]]:
    """Features to weigh, and those that tell, by their shares of the different words of toxic and of plain documents."""
    counts = cut(sample.mapInArrow(_counted, "feature string, toxic bigint, plain bigint, docs bigint").groupBy("feature").agg(*(F.sum(c).alias(c) for c in ("toxic", "plain", "docs"))))
    total = counts.where("feature = ''").first()
    if not total or not total["toxic"] or not total["plain"]:
        return [], set()
    a, b = float(total["toxic"]), float(total["plain"])
    m = (F.col("toxic") + F.col("plain")) / (a + b)
    z = (F.col("toxic") - m * a) / F.sqrt(m * a * (b / (a + b)))
    rows = counts.where((F.col("feature") != "") & (F.col("docs") >= LEAST_DOCS)).select("feature", "docs", z.alias("z"), (1 - F.col("plain") / b / F.nullif(F.col("toxic") / a, F.lit(0.0))).alias("surplus"))
    rows = rows.where(F.abs("z") >= LEAST_Z).orderBy(F.abs("z").desc(), "feature").limit(most).collect()
    return [r["feature"] for r in rows], {r["feature"] for r in rows if r["z"] >= TELLING_Z and (r["surplus"] or 0) >= SURPLUS}


def segments(tokens: list[str], toxic: bool, telling: set[str], known: dict[str, bool]) -> list[tuple[list[str], list[bool]]]:
    """Labelled segments of a document, chosen by a hash."""
    for w in set(tokens).difference(known):
        known[w] = not telling.isdisjoint(features(w))
    marks = [toxic and known[w] for w in tokens]
    all_of = [(tokens[k : k + SEGMENT], marks[k : k + SEGMENT]) for k in range(0, len(tokens), SEGMENT)]
    all_of.sort(key=lambda s: xxhash.xxh64_intdigest(" ".join(s[0]).encode("utf-8", "replace")))
    return [s for s in all_of if any(s[1])][:WITH_TOXIC] + [s for s in all_of if not any(s[1])][:WITHOUT]


def fit(sample: DataFrame) -> Field:
    """The field and its scorer."""
    spark = sample.sparkSession
    chosen, telling = choose(sample)
    marked = spark.sparkContext.broadcast(telling)

    def cuts(batches):
        known: dict[str, bool] = {}
        for b in batches:
            got = [s for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for s in segments(words(text), bool(y), marked.value, known)]
            yield pa.RecordBatch.from_arrays([pa.array([s[0] for s in got], pa.list_(pa.string())), pa.array([s[1] for s in got], pa.list_(pa.bool_()))], names=["words", "marks"])

    rows = sample.mapInArrow(cuts, "words array<string>, marks array<boolean>").toArrow() if telling else None
    field = fit_field(list(zip(rows.column(0).to_pylist(), rows.column(1).to_pylist())) if rows else [], chosen)
    shared = spark.sparkContext.broadcast(field)

    def seen(batches):
        for part in _parts(batches):
            texts = [words(t) for t in part.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([signs(p, t) for p, t in zip(shared.value.marginals(texts), texts)], pa.list_(pa.float64())), part.column(1)], names=["signs", "y"])

    rows = sample.mapInArrow(seen, "signs array<double>, y double").toArrow()
    # in one order, whatever tasks end first
    pairs = sorted(zip(map(tuple, rows.column(0).to_pylist()), rows.column(1).to_pylist()))
    field.scorer = fit_scorer(np.array([p[0] for p in pairs]).reshape(-1, SIGNS), np.array([p[1] for p in pairs]))
    field.known, field.table = {}, np.zeros((1024, 3))
    return field


def _parts(batches):
    return (b.slice(a, ROWS) for b in batches for a in range(0, b.num_rows, ROWS))


def toxicity(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label: str = "toxic", train: Column | None = None, sample: int = SAMPLE
) -> DataFrame:
    """One row per document: id, ``score`` (0 to 1), ``n_words``, ``n_toxic`` (sum of marginals), ``spans``.

    The score goes by the text alone. A null or empty text, or one without a word, has no toxic word and the score of that; very long ones are
    read whole. Rows that repeat an id, or have none, are scored each. ``train``: which ids of labels may be learned from
    (a condition on the column ``id_col``); a document labelled twice is toxic if one label says so; labels that are null, or whose id is,
    are left out. Without labels, or with one class, the answer is that class, toxic only if all say so. The model is fitted on
    about ``sample`` labelled rows. Other columns, of both tables, are ignored; an empty table gives none.
    """
    field = fit(sample_of(docs, labels, id_col, text_col, label_id, label, train, sample))
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches):
        field = shared.value
        for part in _parts(batches):
            raw = [t or "" for t in part.column(1).to_pylist()]
            texts = [words(t) for t in raw]
            found = field.marginals(texts)
            score = field.score(np.array([signs(p, t) for p, t in zip(found, texts)]).reshape(-1, SIGNS))
            columns = [pa.array(score), pa.array([len(t) for t in texts], pa.int64()), pa.array([float(p.sum()) for p in found], pa.float64()), pa.array([spans(t, p) for t, p in zip(raw, found)], pa.string())]
            yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=["i", "score", "n_words", "n_toxic", "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"i {kind}, score double, n_words bigint, n_toxic double, spans string").withColumnRenamed("i", id_col)


def op11_toxicity(spark, sf_dir: str) -> DataFrame:
    """``toxicity`` of all documents, learned from the labels whose id has another remainder than 1; no SQL: the field is fitted."""
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    out = toxicity(docs, labels, train=~held_out)
    return out.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"), "n_words", "n_toxic", "spans")
