import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidra.functions.text import chunks, group_semantic

TEXTS = [None, "", "  \n ", "One.", "Short one. Two! Three?  Four.", "x" * 95 + ". " + "y" * 41 + " tail. End.", "A b c. " * 30, "No stop here " * 20]


def plain_recursive(text, size, overlap):
    out, held = [], ""
    for s in (s for s in re.split(r"(?<=[.!?])\s+", (text or "").strip()) if s.strip()):
        if len(s) > size:
            out += [held.strip()] if held.strip() else []
            cut = [s[i : i + size] for i in range(0, len(s), size)]
            out += [c.strip() for c in cut[:-1] if c.strip()]
            held = cut[-1].strip()
        elif held and len(held) + 1 + len(s) > size:
            out.append(held.strip())
            held = s
        else:
            held = f"{held} {s}".strip()
    out += [held.strip()] if held.strip() else []
    return [c if i == 0 or overlap <= 0 else f"{out[i - 1][-overlap:]} {c}".strip() for i, c in enumerate(out)]


@pytest.mark.parametrize("size,overlap", [(40, 0), (40, 10), (220, 40), (7, 3)])
def test_recursive(spark, size, overlap):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "i int, t string")
    got = {r["i"]: r["c"] for r in df.select("i", chunks(F.col("t"), "recursive", size, overlap).alias("c")).collect()}
    assert got == {i: plain_recursive(t, size, overlap) for i, t in enumerate(TEXTS)}


def plain_semantic(text, size, dim=256, least=0.12):
    """By dense vectors, sentence after sentence."""

    def vector(s):
        v = np.zeros(dim)
        for t in re.findall("[a-z0-9]+", s.lower()):
            v[int(hashlib.md5(t.encode()).hexdigest(), 16) % dim] += 1
        v = np.where(v > 0, 1 + np.log(np.maximum(v, 1)), 0)
        return v / np.linalg.norm(v) if v.any() else v

    text = (text or "").strip()
    parts = [s for s in re.split(r"(?<=[.!?])\s+", text) if s.strip()]
    if len(parts) < 2:
        return [text] if text else []
    out, group, centre = [], [parts[0]], vector(parts[0])
    for s in parts[1:]:
        v = vector(s)
        size_both = np.linalg.norm(centre) * np.linalg.norm(v)
        if size_both > 0 and centre @ v / size_both >= least and len(" ".join([*group, s])) <= size:
            group.append(s)
            centre = (centre + v) / 2
        else:
            out.append(" ".join(group))
            group, centre = [s], v
    return [*out, " ".join(group)]


def test_semantic_is_the_plain_fold(spark):
    texts = [*TEXTS, "The tax bill passed. The tax bill failed! A dog barks. The dog barks again. 1 2 3? ... !!! Tax and dog. " * 3, "One tax. Two tax. Red fish. Blue fish."]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for size in (30, 60, 220):
        got = {r["i"]: r["c"] for r in df.select("i", chunks(F.col("t"), "semantic", size).alias("c")).collect()}
        assert got == {i: plain_semantic(t, size) for i, t in enumerate(texts)}


def test_semantic_and_unknown(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "i int, t string")
    rows = df.select("i", "t", chunks(F.col("t"), "semantic", 40).alias("s"), chunks(F.col("t"), "other").alias("u"), chunks(F.col("t")).alias("r")).collect()
    assert all(r["u"] == r["r"] and r["s"] == group_semantic(r["t"], 40) for r in rows)
    with pytest.raises(ValueError):
        chunks(F.col("t"), size=0)
