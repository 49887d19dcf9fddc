"""Sharding by a k-d tree: nodes are split at weighted medians along their widest metadata dimension until
they hold one shard each. DataFrame functions only.

Each dimension is a 63-bit coordinate in a total order: the value in 20 bits, 24 bits of the text's CRC
and 19 of a hash of the id. So equal texts stay together until a cut falls inside their group. Rows whose coordinates are equal
(repeated rows, say) are told apart by 32 bits more, a hash of their place in the checkpointed table, so a group of any size can
still be cut. The weighted median of all nodes of a level is found exactly by
radix descent: sums of bytes over 16 bits of the coordinate, four times, and twice more over the places where a cut falls
on equal rows; each pass is one grouped aggregation with partial sums, over the metadata columns only, and sends back one row for each node.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidra.llm.common import cut

SHARDS = 16
VALUE_BITS, TEXT_BITS, ID_BITS = 20, 24, 19
DIGIT = 16
#: Rows of a window that numbers slots, about.
BUCKET_ROWS = 20_000


def _at(values: list, kind: str) -> Column:
    """The value for the row's node, from a literal array indexed by node."""
    return F.get(F.lit(values).cast(f"array<{kind}>"), F.col("node"))


def _coordinate(names: list[str], dim: list[int], low: list[float], high: list[float]) -> Column:
    """0 to 2^63 - 1, in order of the value of the node's dimension, then the text's CRC, then a hash of the id."""
    top = (1 << VALUE_BITS) - 1
    value = F.get(F.array(*names), _at(dim, "int"))
    scaled = F.floor((value - _at(low, "double")) / _at([h - l or 1.0 for l, h in zip(low, high)], "double") * top)
    scaled = F.coalesce(scaled, F.lit(0)).cast("bigint")
    text = F.shiftright("crc", 32 - TEXT_BITS)
    ident = F.shiftrightunsigned(F.xxhash64("id"), 64 - ID_BITS)
    return F.shiftleft(scaled, TEXT_BITS + ID_BITS) + F.shiftleft(text, ID_BITS) + ident


def _descend(rows: DataFrame, column: str, bits: int, left: list[float], last: bool) -> tuple[list[int], list[int]]:
    """For each node the value of ``column`` up to which the bytes of its rows reach what is left, and how many rows have that value;
    ``left`` becomes what is left of it for these. In the ``last`` column the value before it is taken if that is nearer."""
    prefix, many = [0] * len(left), [0] * len(left)
    rows = rows.where(_at(left, "double") >= 0)
    passes = bits // DIGIT
    for depth in range(passes):
        shift = bits - DIGIT * (depth + 1)
        here = rows.where(F.shiftrightunsigned(column, shift + DIGIT) == _at(prefix, "bigint")) if depth else rows
        bins = here.groupBy("node", F.shiftrightunsigned(column, shift).alias("digit")).agg(F.sum("size").alias("size"), F.count("*").alias("n"))
        bins = bins.withColumn("upto", F.sum("size").over(Window.partitionBy("node").orderBy("digit")))
        hit = bins.where(F.col("upto") >= _at(left, "double")).groupBy("node").agg(F.min_by(F.struct("digit", "upto", "size", "n"), "digit").alias("x"))
        for node, x in hit.collect():  # one row for each node
            before = x["upto"] - x["size"]
            prefix[node], many[node] = x["digit"], x["n"]
            if depth == passes - 1 and (last or x["n"] == 1) and left[node] - before < x["upto"] - left[node]:
                prefix[node] -= 1
            left[node] -= before
    return prefix, many


def _cut_points(rows: DataFrame, wanted: list[float]) -> tuple[list[int], list[int]]:
    """For each node the coordinate c, and the place among rows of that coordinate, for which the bytes of rows up to them are nearest to
    those wanted.

    ``rows``: node, c, place, size; nodes not to be cut want nothing (-1).
    """
    left = list(wanted)
    cuts, many = _descend(rows, "c", 64, left, False)
    left = [x if n > 1 else -1.0 for x, n in zip(left, many)]
    if max(many, default=0) < 2:
        return cuts, [(1 << 32) - 1] * len(cuts)
    places, _ = _descend(rows.where(F.col("c") == _at(cuts, "bigint")), "place", 32, left, True)
    return cuts, [p if n > 1 else (1 << 32) - 1 for p, n in zip(places, many)]


def kd_shards(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", dims: tuple[str, ...] = ("lang", "n_chars"), target_bytes: int | None = None) -> DataFrame:
    """Every row with its shard: ``doc_id, size, text_crc32, law, shard, slot, grown_shard``.

    The number of shards is given, or follows from ``target_bytes``. The law is ``bytes``: shards hold
    nearly equal sums of size (UTF-8 bytes of the text plus 1). A node of m shards is cut at the weighted
    quantile floor(m / 2) / m of its widest dimension. ``dims`` may be numbers or strings (by hash);
    columns that are missing are left out. Dimensions that follow from the text keep equal texts in one shard,
    but for a group that a cut falls into. A null text has size 1 and
    CRC 0, a very long one its whole size; null metadata counts as the lowest value, null ids are like any other value. Repeated rows are
    kept each and can be cut apart. Slots follow (id, CRC) within a hashed bucket and are gapless from 0 in each shard; a bucket
    that holds very many rows (of one id and text) is dealt out by their places. Columns other than those named are ignored. An empty table
    gives an empty result.
    """
    text = F.col(text_col)
    meta = {"d0": F.coalesce(F.octet_length(text), F.lit(0)).cast("double")}
    for name in dims:
        if name in docs.columns:
            c = F.col(name)
            meta[f"d{len(meta)}"] = (F.pmod(F.xxhash64(c), F.lit(1 << VALUE_BITS)) if docs.schema[name].dataType.simpleString() == "string" else c).cast("double")
    rows = docs.select(
        F.col(id_col).cast("bigint").alias("id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("bigint").alias("size"),
        F.crc32(F.coalesce(text, F.lit(""))).alias("crc"),
        *(F.when(F.isnan(c), None).otherwise(c).alias(k) for k, c in meta.items()),
    )
    # places are drawn once: they are kept by the checkpoint
    rows = rows.withColumns({"node": F.lit(0), "place": F.shiftrightunsigned(F.xxhash64(F.monotonically_increasing_id()), 32)})
    rows, names = cut(rows), list(meta)
    spans = [f(k).alias(f"{n}_{k}") for k in names for n, f in (("lo", F.min), ("hi", F.max))]
    whole = rows.agg(F.sum("size").alias("size"), F.count("*").alias("n"), *spans).first()
    if target_bytes:
        shards = max(1, -(-(whole["size"] or 0) // target_bytes))
    nodes = [(0, shards)]  # (first shard, shards); the children of a level stand behind it
    level = range(1)
    while whole["n"] and any(nodes[k][1] > 1 for k in level):
        n = len(nodes)
        dim, low, high, wanted = [0] * n, [0.0] * n, [0.0] * n, [-1.0] * n
        left, right = list(range(n)), list(range(n))
        ends = {r["node"]: r for r in rows.groupBy("node").agg(F.sum("size").alias("size"), *spans).collect()}  # a row for each node
        for k in level:
            first, m = nodes[k]
            if m < 2:
                continue
            left[k], right[k] = len(nodes), len(nodes) + 1
            nodes += [(first, m // 2), (first + m // 2, m - m // 2)]
            if r := ends.get(k):
                lo, hi = ([r[f"{x}_{d}"] or 0.0 for d in names] for x in ("lo", "hi"))
                dim[k] = max(range(len(names)), key=lambda i: (hi[i] - lo[i]) / ((whole[f"hi_{names[i]}"] or 0.0) - (whole[f"lo_{names[i]}"] or 0.0) or 1.0))
                low[k], high[k], wanted[k] = lo[dim[k]], hi[dim[k]], r["size"] * (m // 2) / m
        level = range(n, len(nodes))
        placed = rows.withColumn("c", _coordinate(names, dim, low, high))
        cuts, places = _cut_points(placed.select("node", "c", "place", "size"), wanted)
        low_side = (F.col("c") < _at(cuts, "bigint")) | ((F.col("c") == _at(cuts, "bigint")) & (F.col("place") <= _at(places, "bigint")))
        step = F.when(low_side, _at(left, "int")).otherwise(_at(right, "int"))
        rows = cut(placed.withColumn("node", step).drop("c"))
    rows = rows.select("id", "size", "crc", "place", _at([first for first, _ in nodes], "int").alias("shard"))
    # slots: a count for each (shard, bucket), running starts, then the order within the bucket
    buckets = max(1, -(-whole["n"] // (shards * BUCKET_ROWS))) * 4
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("id", "crc"), F.lit(buckets)).cast("int"))
    # of large buckets there are few: each holds this many rows
    large = rows.groupBy("shard", "bucket").agg((F.count("*") / BUCKET_ROWS).cast("int").alias("parts")).where("parts > 1")
    rows = rows.join(F.broadcast(cut(large)), ["shard", "bucket"], "left").withColumn("part", F.pmod(F.col("place"), F.coalesce("parts", F.lit(1))).cast("int"))
    sizes = rows.groupBy("shard", "bucket", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket", "part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("shard", "bucket", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    order = Window.partitionBy("shard", "bucket", "part").orderBy("id", "crc")
    rows = rows.withColumn("k", F.row_number().over(order)).join(starts, ["shard", "bucket", "part"])
    return rows.select(
        F.col("id").alias(id_col),
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("start") + F.col("k") - 1).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op3_kd_shards(spark, sf_dir: str) -> DataFrame:
    """``kd_shards`` over all documents, into 16 shards; rows as its docstring says."""
    return kd_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"))
