"""Chunkers as a table function, for SQL: ``chunks(text, strategy, size, overlap)`` gives ``chunk_index, chunk``."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from evidra.functions.text import OVERLAP, SIZE, STRATEGIES, WHITE, group_semantic, pack_sentences


def _windows(text: str, size: int, step: int) -> list[str]:
    return [text[a : a + size] for a in range(0, len(text), step)]


class Chunks:
    """Pieces of a text by strategy, blank ones left out; a null or blank text has none, an unknown strategy is the recursive one."""

    @staticmethod
    def analyze(text: AnalyzeArgument, strategy: AnalyzeArgument = None, size: AnalyzeArgument = None, overlap: AnalyzeArgument = None) -> AnalyzeResult:
        if not isinstance(text.dataType, StringType):
            raise ValueError("the first argument must be a text")
        for name, a, least in (("size", size, 1), ("overlap", overlap, 0)):
            if a is not None and a.isConstantExpression and a.value is not None and a.value < least:
                raise ValueError(f"{name} must be at least {least}")
        if strategy is not None and not strategy.isConstantExpression:
            raise ValueError("the strategy must be a constant")
        return AnalyzeResult(StructType().add("chunk_index", IntegerType(), False).add("chunk", StringType(), False))

    def eval(self, text: str | None, strategy: str = "recursive", size: int | None = SIZE, overlap: int | None = OVERLAP) -> Iterator[tuple[int, str]]:
        size, overlap = SIZE if size is None else size, OVERLAP if overlap is None else overlap
        body = (text or "").strip(WHITE)
        made = {
            "whole": lambda: [body],
            "fixed": lambda: _windows(body, size, max(1, size - overlap)),
            "sliding": lambda: _windows(body, size, max(1, size // 2)),
            "sentence": lambda: re.split(f"(?<=[.!?])[{WHITE}]+", body),
            "semantic": lambda: group_semantic(body, size),
        }.get(strategy if strategy in STRATEGIES else "recursive", lambda: pack_sentences(body, size, overlap))
        pieces = made() if body else []
        pieces = [p if strategy == "sentence" else p.strip(WHITE) for p in pieces] if strategy in ("sentence", "fixed", "sliding") else pieces
        for k, p in enumerate(p for p in pieces if p.strip(WHITE)):
            yield k, p


def register(spark: SparkSession) -> None:
    """Make ``chunks`` known to the session's SQL."""
    spark.udtf.register("chunks", udtf(Chunks))
