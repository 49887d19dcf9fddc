"""Text functions as column expressions; the two chunkers that carry state from sentence to sentence run over Arrow batches."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from evidra.functions.vocabulary import HTML_ENTITIES, STOP_WORDS

SIZE, OVERLAP = 220, 40
#: Texts that a task cuts at once.
STEP = 200
_SENTENCE_END = re.compile(r"(?<=[.!?])\s+")
STRATEGIES = ("recursive", "fixed", "sentence", "sliding", "semantic", "whole")


#: The characters of Unicode's white space.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """Without white space at both ends (trim alone takes blanks only)."""
    return F.btrim(c, F.lit(WHITE))


def matches(c: Column, pattern: str) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(pattern), F.lit(0))


def keywords(c: Column) -> Column:
    """Distinct words of three letters or more that aren't stop words, in order of appearance."""
    return F.array_except(matches(c, "[a-z]{3,}"), F.lit(STOP_WORDS))


def tokens(c: Column) -> Column:
    return matches(c, "[a-z0-9]+")


def sentences(c: Column) -> Column:
    parts = F.split(F.coalesce(c, F.lit("")), r"(?U)(?<=[.!?])\s+")
    return F.filter(parts, lambda x: strip(x) != "")


def strip_html(c: Column) -> Column:
    """Plain prose of an HTML text: tags become blanks, then entities in their fixed order, then white space."""
    out = F.regexp_replace(F.coalesce(c, F.lit("")), "<[^>]+>", " ")
    for entity, plain in HTML_ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(plain))
    return strip(F.regexp_replace(out, r"(?U)\s+", " "))


# --- chunkers: text -> array of text ---------------------------------------------------------------


def _windows(c: Column, size: int, step: int) -> Column:
    cut = F.transform(F.sequence(F.lit(0), F.length(c) - 1, F.lit(step)), lambda i: strip(c.substr(i + 1, F.lit(size))))
    return F.when(F.length(c) > 0, F.filter(cut, lambda x: x != "")).otherwise(F.array().cast("array<string>"))


def pack_sentences(text: str | None, size: int, overlap: int) -> list[str]:
    """Sentences packed into pieces of at most ``size`` characters, too long ones cut; each piece but the first is led
    by the last ``overlap`` characters of the one before. One pass over the text."""
    out: list[str] = []
    held: list[str] = []
    length = 0

    def close() -> None:
        nonlocal length
        if piece := " ".join(held).strip():
            out.append(piece)
        held.clear()
        length = 0

    for s in _SENTENCE_END.split((text or "").strip()):
        if not s.strip():
            continue
        if len(s) > size:
            close()
            last = (len(s) - 1) // size * size
            out += filter(None, (s[i : i + size].strip() for i in range(0, last, size)))
            s = s[last:].strip()
        elif held and length + 1 + len(s) > size:
            close()
        if s:
            length += len(s) + bool(held)
            held.append(s)
    close()
    return [f"{before[-overlap:]} {piece}".strip() if k and overlap > 0 else piece for k, (before, piece) in enumerate(zip(["", *out], out))]


def by_steps(batches: Iterator[pd.Series], pieces: Callable[[str | None], list[str]]) -> Iterator[pd.Series]:
    """The pieces of each text; those of ``STEP`` texts are held at once, however many a batch has."""
    for texts in batches:
        for a in range(0, len(texts), STEP):
            yield texts.iloc[a : a + STEP].map(pieces)


def _recursive(c: Column, size: int, overlap: int) -> Column:
    @F.pandas_udf("array<string>")
    def packed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        return by_steps(batches, lambda t: pack_sentences(t, size, overlap))

    return packed(c)


def hash_vector(text: str, dim: int) -> dict[int, float]:
    """Damped counts by md5 bucket, of unit length; the driver's and the semantic chunker's form."""
    n: dict[int, int] = {}
    for t in re.findall("[a-z0-9]+", text.lower()):
        b = int(hashlib.md5(t.encode()).hexdigest(), 16) % dim
        n[b] = n.get(b, 0) + 1
    w = {b: 1 + math.log(c) for b, c in n.items()}
    norm = math.sqrt(sum(x * x for x in w.values()))
    return {b: x / norm for b, x in w.items()} if norm else w


def group_semantic(text: str | None, size: int, dim: int = 256, least: float = 0.12) -> list[str]:
    """Sentences grouped while the next one is close to a running centroid and still fits."""
    text = (text or "").strip()
    parts = [s for s in _SENTENCE_END.split(text) if s.strip()]
    if len(parts) <= 1:
        return [text] if text else []
    out, held, centre = [], "", {}
    for k, s in enumerate(parts):
        v = hash_vector(s, dim)
        norms = math.sqrt(sum(x * x for x in centre.values()) * sum(x * x for x in v.values()))
        close = norms > 0 and sum(x * centre.get(b, 0.0) for b, x in v.items()) / norms >= least
        if k and close and len(held) + len(s) + 1 <= size:
            held = f"{held} {s}"
            centre = {b: (centre.get(b, 0.0) + v.get(b, 0.0)) / 2 for b in centre.keys() | v.keys()}
        else:
            out += [held] if k else []
            held, centre = s, v
    return [*out, held]


def _semantic(c: Column, size: int) -> Column:
    @F.pandas_udf("array<string>")
    def grouped(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        return by_steps(batches, lambda t: group_semantic(t, size))

    return grouped(c)


def chunks(c: Column, strategy: str = "recursive", size: int = SIZE, overlap: int = OVERLAP) -> Column:
    """The chunks of a text; none if it is null or blank. An unknown strategy is the recursive one."""
    if size < 1:
        raise ValueError("size must be at least 1")
    c = strip(F.coalesce(c, F.lit("")))
    made = {
        "whole": lambda t: F.array(t),
        "fixed": lambda t: _windows(t, size, max(1, size - overlap)),
        "sliding": lambda t: _windows(t, size, max(1, size // 2)),
        "sentence": lambda t: sentences(t),
    }.get(strategy)
    # the text is bound to a lambda's variable: written out in the windows' own lambda it would be stripped anew for each window
    out = _semantic(c, size) if strategy == "semantic" else _recursive(c, size, overlap) if made is None else F.get(F.transform(F.array(c), made), F.lit(0))
    return F.when(c == "", F.array().cast("array<string>")).otherwise(out)
