"""Extension points: models plug in as pandas UDFs or columns; defaults need no model."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .text import WORD


def embed(texts: DataFrame, column: str, model: Callable[[list[str]], list[list[float]]], prefix: str = "", batch: int = 32) -> DataFrame:
    """Adds ``embedding`` by a model that maps a list of texts to vectors."""

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            out: list = []
            for i in range(0, len(s), batch):
                out += model([prefix + (t or "") for t in s.iloc[i : i + batch]])
            yield pd.Series(out, index=s.index)

    return texts.withColumn("embedding", run(column))


def hashed_embedding(text: Column, size: int = 64) -> Column:
    """Default embedding: counts of hashed words, normalised to length 1. Built-in functions only."""
    slots = F.transform(F.regexp_extract_all(F.lower(text), F.lit(f"({WORD})"), 1), lambda w: F.pmod(F.xxhash64(w), F.lit(size)))
    counts = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.size(F.filter(slots, lambda s: s == i)).cast("double"))
    norm = F.sqrt(F.aggregate(counts, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(counts, lambda x: F.when(norm > 0, x / norm).otherwise(0.0))


def rerank(pairs: DataFrame, model: Callable[[list[str], list[str]], list[float]]) -> DataFrame:
    """Adds ``score`` to (query, doc) by a model; ``ranking.overlap_score`` is the default without one."""

    @F.pandas_udf("double")
    def run(q: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series(model(q.tolist(), d.tolist()))

    return pairs.withColumn("score", run("query", "doc"))


class ListedSource(DataSource):
    """A data source of resources from any object with ``list()`` and ``read(uri)``, one partition a slice.

    Register a subclass that sets ``connector``; each task reads its own slice.
    """

    connector: type | None = None

    @classmethod
    def name(cls) -> str:
        return "listed"

    def schema(self) -> str:
        return "uri string, content string"

    def reader(self, schema) -> DataSourceReader:
        return _ListedReader(self.connector(), int(self.options.get("slices", "8")))


class _ListedReader(DataSourceReader):
    def __init__(self, source, slices: int):
        self.source, self.slices = source, slices

    def partitions(self):
        return [InputPartition(i) for i in range(self.slices)]

    def read(self, partition):
        for i, uri in enumerate(self.source.list()):
            if i % self.slices == partition.value:
                text = self.source.read(uri)
                if text is not None:
                    yield uri, text
