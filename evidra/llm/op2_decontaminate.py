"""Benchmark decontamination by winnowing. DataFrame functions only.

A word k-gram is hashed; in each run of ``window - k + 1`` hashes the least is a fingerprint (of equal ones
the last). Two texts that share ``window`` words share the fingerprints of that run, so a join of the fingerprints of
items and documents finds every shared span of that length. A hit is extended word by word to both sides,
as far as a window can reach, and counts if it grows to a whole window; hash collisions die there.
Items shorter than a window are compared as wholes: an item of n words with every run of n words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidra.llm.common import cut, row_key, without

WINDOW = 10
K = 6
#: Benchmark fingerprints up to this number are broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 500_000
#: What separates words, after lower-casing A-Z: every ASCII character but 0-9, a-z (and DEL is one).
BREAK = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """The words of a text; none for null."""
    parts = F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BREAK)
    return F.filter(parts, lambda w: w != "")


def _grams(w: str, n: int) -> Column:
    """The hash of each run of n words of the array column ``w`` of word hashes."""
    last = F.size(w) - n
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*(F.get(F.col(w), i + j) for j in range(n))))).otherwise(F.array().cast("array<bigint>"))


def _winnow(g: str, run: int) -> Column:
    """Positions of the fingerprints among the hashes ``g``: those that are the least of some run."""
    last = F.size(g) - run
    lowest = F.transform(F.sequence(F.lit(0), last), lambda i: F.least(*(F.get(F.col(g), i + j) for j in range(run))) if run > 1 else F.get(F.col(g), i))
    picked = F.transform(lowest, lambda m, i: i + run - F.array_position(F.reverse(F.slice(F.col(g), i + 1, run)), m).cast("int"))
    return F.when(last >= 0, F.array_distinct(picked)).otherwise(F.array().cast("array<int>"))


def _equal_run(a: Column, b: Column) -> Column:
    """How many words two arrays have in common from the start."""
    n = F.least(F.size(a), F.size(b))
    same = F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x == y)
    first = F.array_position(same, False)
    return F.when(n == 0, 0).when(first == 0, n).otherwise(first - 1).cast("int")


def _marks(texts: DataFrame, window: int, k: int, short: list[int]) -> DataFrame:
    """``texts``: key, w. Adds ``marks``: (n, position, hash) of fingerprints (n = 0) and, for each length in
    ``short``, of all runs of that many words."""
    t = texts.withColumn("h", F.transform("w", lambda x: F.xxhash64(x))).withColumn("g", _grams("h", k)).withColumn("p", _winnow("g", window - k + 1))
    marks = [F.transform("p", lambda i: F.struct(F.lit(0).alias("n"), i.alias("at"), F.get(F.col("g"), i).alias("hash")))]

    def runs(n: int) -> Column:
        return F.transform(_grams("h", n), lambda x, i: F.struct(F.lit(n).alias("n"), i.alias("at"), x.alias("hash")))

    marks += map(runs, short)
    # the condition always holds; as it isn't deterministic, it keeps the optimizer from pushing explode's own size(marks) > 0 below the
    # projections above, which would write their expressions out anew for each use
    return t.select(*texts.columns, F.when(F.spark_partition_id() >= 0, F.concat(*marks) if len(marks) > 1 else marks[0]).alias("marks"))


def _found(docs: DataFrame, items: DataFrame, id_col: str, text_col: str, item_col: str, item_text_col: str, window: int, k: int) -> tuple[DataFrame, DataFrame]:
    """Whole windows that documents hold, ``(k1, k2, from, to, ctx)``, and the items of each place in an item, ``(ctx, item)``."""
    it = items.select(F.col(item_col).alias("item"), words(F.col(item_text_col)).alias("w")).where("item is not null and size(w) > 0")
    # equal items are one class, so a passage that many items repeat is sought once
    classes = cut(it.groupBy("w").agg(F.min("item").alias("cls")))
    member = it.join(classes, "w").select("cls", "item")
    short = sorted(r[0] for r in classes.where(F.size("w") < window).select(F.size("w")).distinct().collect())  # window - 1 lengths at most
    # around a hit: the words that a window can reach; the positions count within them from here on
    reach = window - k
    size = F.when(F.col("n") == 0, k).otherwise(F.col("n"))
    near = lambda w, at: F.slice(w, F.greatest(F.lit(1), F.col(at) + 1 - reach), size + reach + F.least(F.col(at), F.lit(reach)))
    marked = _marks(classes, window, k, short).select("cls", F.col("w").alias("iw"), F.explode("marks").alias("m"))
    own = F.when(F.size("iw") < window, F.size("iw")).otherwise(0)
    marked = marked.select("cls", "iw", F.col("m.n").alias("n"), F.col("m.at").alias("iat"), F.col("m.hash").alias("hash")).where(F.col("n") == own)
    marked = marked.select("cls", "n", "hash", near("iw", "iat").alias("iw"), F.least("iat", F.lit(reach)).alias("i")).withColumn("ctx", F.xxhash64("n", "hash", "i", "iw"))
    # places of items with equal surroundings are one context: a document is compared with it once
    contexts = cut(marked.select("n", "hash", "iw", "i", "ctx").distinct())
    named = cut(marked.select("ctx", "cls").distinct().join(member, "cls").select("ctx", F.col("item").cast("string").alias("item")).distinct())
    contexts = F.broadcast(contexts) if contexts.count() <= BROADCAST_ROWS else contexts

    base = docs.select(*row_key(F.col(id_col), F.col(text_col)), words(F.col(text_col)).alias("w"))
    found = _marks(base, window, k, short).select("k1", "k2", "w", F.explode("marks").alias("m"))
    found = found.select("k1", "k2", "w", F.col("m.n").alias("n"), F.col("m.at").alias("at"), F.col("m.hash").alias("hash"))
    hits = found.join(contexts, ["n", "hash"]).select("k1", "k2", "ctx", "n", "at", near("w", "at").alias("dw"), F.least("at", F.lit(reach)).alias("d"), "iw", "i")
    hits = cut(hits)
    whole = F.slice("dw", F.col("d") + 1, size) == F.slice("iw", F.col("i") + 1, size)
    left = _equal_run(F.reverse(F.slice("dw", 1, F.col("d"))), F.reverse(F.slice("iw", 1, F.col("i"))))
    right = _equal_run(F.slice("dw", F.col("d") + size + 1, reach), F.slice("iw", F.col("i") + size + 1, reach))
    hits = hits.where(whole).select("k1", "k2", "ctx", "n", "at", size.alias("size"), F.when(F.col("n") > 0, 0).otherwise(left).alias("left"), F.when(F.col("n") > 0, 0).otherwise(right).alias("right"))
    spans = hits.select("k1", "k2", "ctx", "n", (F.col("at") - F.col("left")).alias("from"), (F.col("at") + F.col("size") + F.col("right")).alias("to"))
    return spans.where((F.col("n") > 0) | (F.col("to") - F.col("from") >= window)).drop("n").distinct(), named


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, k: int = K) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated``.

    ``n_hit`` counts the words inside any occurrence of a window of an item, ``n_items`` the items with
    occurring windows; the digest is that of their ids, sorted as strings and joined by commas. Null and
    empty texts have no words and no hits; an item without words has no windows; items that repeat a text
    are found each; rows with a null item id are left out. Each document row decides for itself: rows
    without an id, and rows that repeat an id with another text, have the hits of their own text (rows are told apart
    by a 128-bit hash of id and text). Very long texts are taken whole. Empty tables give no rows or no hits. Other
    columns are ignored.
    """
    spans, names = _found(docs, items, id_col, text_col, item_col, item_text_col, window, k)
    spans = cut(spans)
    names = F.broadcast(names) if names.count() <= BROADCAST_ROWS else names
    hit = spans.select("k1", "k2", "from", "to").distinct().select("k1", "k2", F.explode(F.sequence("from", F.col("to") - 1)).alias("at")).distinct()
    hit = hit.groupBy("k1", "k2").agg(F.count("*").alias("n_hit"))
    named = spans.select("k1", "k2", "ctx").distinct().join(names, "ctx").select("k1", "k2", "item").distinct()
    named = named.groupBy("k1", "k2").agg(F.count("*").alias("n_items"), F.sha2(F.array_join(F.array_sort(F.collect_list("item")), ","), 256).alias("items_sha256"))
    counted = docs.select(F.col(id_col).alias("doc"), *row_key(F.col(id_col), F.col(text_col)), F.size(words(F.col(text_col))).cast("bigint").alias("n_words"))
    out = counted.join(hit.join(named, ["k1", "k2"]), ["k1", "k2"], "left")
    return out.select(
        F.col("doc").alias(id_col),
        "n_words",
        F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, k: int = K) -> DataFrame:
    """The rows of ``docs`` without a hit, with all their columns; cases as in ``decontaminate``."""
    spans, _ = _found(docs, items, id_col, text_col, item_col, item_text_col, window, k)
    return without(docs, cut(spans.select("k1", "k2").distinct()), id_col, text_col)


def op2_decontaminate(spark, sf_dir: str) -> DataFrame:
    """``decontaminate`` over all documents and benchmark items; rows as its docstring says."""
    return decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
i AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark WHERE item_id IS NOT NULL),
iw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(list_slice(w, p, p + least(len(w), 10) - 1), ' ') AS gram
  FROM i, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(p) WHERE len(w) > 0),
lens AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT doc_id, n, p, array_to_string(list_slice(w, p, p + n - 1), ' ') AS gram
  FROM d, lens, unnest(range(1, len(w) - n + 2)) AS t(p)),
h AS (SELECT doc_id, p, dw.n, item_id FROM dw JOIN iw ON dw.n = iw.n AND dw.gram = iw.gram),
c AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT DISTINCT doc_id, p, n FROM h), unnest(range(p, p + n)) AS t(q) GROUP BY doc_id),
s AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN s USING (doc_id)
"""
