"""Divergence of sources: how far the terms of each source of a language lie from those of its other sources, and which
terms set it apart from the language.

A group is a (language, source). Its share of a kept term is p = 1 + floor(10^9 (count + 2) / (N + 2 V)); the divergence of two
groups is the sum over the V kept terms of f(p, q) = floor((p - q)^2 / (p + q)). Most counts are zero, so nothing is summed term by
term: each pair starts at the baseline V f(p0, q0) of zero counts, and an inverted index of the counts that aren't zero emits
corrections:

* a term of one group, against the other's zero count: f(p, q0) - f(p0, q0). It depends on the count alone, so a group emits one for
  each different count it has, times the terms that have it;
* a term that both have: f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0), from the postings of that term, where it isn't zero.

All sums are of whole numbers, so the result is exact whatever the order. Texts are counted within their task first, in a bounded
table; a very common term or a very large source costs each task one row.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidra.llm.common import cut

#: A language keeps the terms that are in at least so many of its documents.
LEAST_DOCS = 10
#: Terms that are reported for each group.
TOP = 10
#: Entries of a task's table of counts, after which it is sent on and emptied; texts that a task reads at once.
ENTRIES = 400_000
ROWS = 200
#: Groups up to this number are broadcast.
BROADCAST_GROUPS = 200_000
#: Bytes of a text that belong to terms, A-Z lower-cased; others part them.
_TERM = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))


def terms(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(_TERM).split()


def _counted(batches):
    """Occurrences, and documents, of each (lang, source, term) that this task has seen since it last sent them."""
    seen: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    names = ["lang", "source", "term", "n", "docs"]

    def send():
        for (lang, source), (n, docs) in seen.items():
            found = list(n)
            for a in range(0, len(found), 50_000):
                t = found[a : a + 50_000]
                k = len(t)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * k), pa.array([source] * k), pa.array(t, pa.binary()).cast(pa.string()), pa.array([n[x] for x in t], pa.int64()), pa.array([docs[x] for x in t], pa.int64())], names=names)
        seen.clear()

    for b in (whole.slice(a, ROWS) for whole in batches for a in range(0, whole.num_rows, ROWS)):
        for lang, source, text in zip(*(c.to_pylist() for c in b.columns)):
            words = terms(text)
            n, docs = seen.get((lang, source)) or seen.setdefault((lang, source), (Counter(), Counter()))
            n.update(words)
            docs.update(set(words))
        if sum(len(n) for n, _ in seen.values()) > ENTRIES:
            yield from send()
    yield from send()


def _share(count: str, total: str) -> Column:
    """1 + floor(10^9 (count + 2) / (total + 2 v)), exact for counts of any size."""
    return F.expr(f"1 + (cast({count} + 2 as decimal(20, 0)) * cast(1000000000 as decimal(10, 0))) div cast({total} + 2 * v as decimal(20, 0))")


def _far(p: str, q: str) -> str:
    return f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})"


def divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``lang, source, part, item, value, rank``: for each group its divergence from each other source of its language (part
    ``pair``, all ranks) and its ``top`` terms above the language's share (part ``term``).

    A null text, language or source is ''. Terms are runs of letters and of characters beyond ASCII; only A-Z are lower-cased. A
    group whose texts have no term counts with zeros; a language with no kept term has the value 0 for each pair and no terms; a
    language of one source has no pairs. Ranks follow the value, ties the item's bytes. Very long texts are counted whole, repeated
    rows count each, ids play no part. Other columns are ignored; an empty table gives none.
    """
    d = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))))
    counts = d.mapInArrow(_counted, "lang string, source string, term string, n bigint, docs bigint").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of_term = Window.partitionBy("lang", "term")  # a row for each source
    counts = counts.withColumns({"in_docs": F.sum("docs").over(of_term), "n_lang": F.sum("n").over(of_term), "first": F.row_number().over(of_term.orderBy("source")) == 1})
    kept = cut(counts.where(F.col("in_docs") >= least_docs).select("lang", "source", "term", "n", "n_lang", "first"))

    langs = kept.groupBy("lang").agg(F.sum("n").alias("total_lang"), F.count_if("first").alias("v"))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    groups = d.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.select("lang", "source", zero("total"), zero("total_lang"), zero("v"))
    groups = cut(groups.withColumn("p0", F.when(F.col("v") > 0, _share("0", "total")).otherwise(1)))
    small = groups.count() <= BROADCAST_GROUPS
    sites = F.broadcast(groups) if small else groups
    index = kept.join(sites, ["lang", "source"]).withColumn("p", _share("n", "total"))

    # pairs, each once: x stands before y
    x, y = (groups.select("lang", F.col("source").alias(k), F.col("p0").alias(f"{k}0"), *(["v"] if k == "x" else [])) for k in "xy")
    pairs = x.join(y, "lang").where("x < y").select("lang", "x", "y", F.expr(f"v * ({_far('x0', 'y0')})").alias("value"))
    same = index.groupBy("lang", "source", "p", "p0").agg(F.count("*").alias("k"))
    other = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    alone = same.join(F.broadcast(other) if small else other, "lang").where("source <> item")
    alone = alone.select("lang", F.least("source", "item").alias("x"), F.greatest("source", "item").alias("y"), F.expr(f"k * ({_far('p', 'q0')} - {_far('p0', 'q0')})").alias("value"))
    a = index.select("lang", "term", F.col("source").alias("x"), "p", "p0")
    b = index.select("lang", "term", F.col("source").alias("y"), F.col("p").alias("q"), F.col("p0").alias("q0"))
    both = a.join(b.hint("merge"), ["lang", "term"]).where("x < y")
    both = both.select("lang", "x", "y", F.expr(f"{_far('p', 'q')} - {_far('p', 'q0')} - {_far('p0', 'q')} + {_far('p0', 'q0')}").alias("value")).where("value <> 0")
    sums = pairs.unionByName(alone.where("value <> 0")).unionByName(both).groupBy("lang", "x", "y").agg(F.sum("value").alias("value"))
    turned = F.explode(F.array(F.struct(F.col("x").alias("source"), F.col("y").alias("item")), F.struct(F.col("y").alias("source"), F.col("x").alias("item"))))
    pair = sums.select("lang", turned.alias("t"), "value").select("lang", "t.source", F.lit("pair").alias("part"), "t.item", "value")

    term = index.withColumn("q", _share("n_lang", "total_lang")).where("p > q")
    term = term.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr(_far("p", "q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    rank = F.row_number().over(order)
    ranked = pair.withColumn("rank", rank).unionByName(term.withColumn("rank", rank).where(F.col("rank") <= top))
    return ranked.select("lang", "source", "part", "item", F.col("value").cast("bigint").alias("value"), F.col("rank").cast("int").alias("rank"))


def op13_divergence(spark, sf_dir: str) -> DataFrame:
    """``divergence`` over all documents."""
    return divergence(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
t AS (SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
vocabulary AS (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT id) >= 10),
langs AS (SELECT lang, count(*) AS v, sum(n) AS total FROM vocabulary GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
counts AS (SELECT lang, source, term, count(*) AS n FROM t GROUP BY ALL),
full_counts AS (
  SELECT g.lang, g.source, w.term, coalesce(c.n, 0) AS n
  FROM g JOIN vocabulary w ON w.lang = g.lang LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = w.term),
totals AS (SELECT lang, source, sum(n) AS total FROM full_counts GROUP BY lang, source),
shares AS (
  SELECT f.lang, f.source, f.term, f.n, (1 + (1000000000::HUGEINT * (f.n + 2)) // (s.total + 2 * l.v))::HUGEINT AS p
  FROM full_counts f JOIN totals s ON s.lang = f.lang AND s.source = f.source JOIN langs l ON l.lang = f.lang),
lang_shares AS (
  SELECT w.lang, w.term, (1 + (1000000000::HUGEINT * (w.n + 2)) // (l.total + 2 * l.v))::HUGEINT AS q
  FROM vocabulary w JOIN langs l ON l.lang = w.lang),
summed AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM shares a JOIN shares b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source GROUP BY ALL),
parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON b.lang = a.lang AND b.source <> a.source
  LEFT JOIN summed s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL
  SELECT s.lang, s.source, 'term', s.term, (((s.p - q.q) * (s.p - q.q)) // (s.p + q.q))::BIGINT
  FROM shares s JOIN lang_shares q ON q.lang = s.lang AND q.term = s.term WHERE s.n > 0 AND s.p > q.q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM parts)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""
