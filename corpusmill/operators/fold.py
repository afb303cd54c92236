"""Ordered folds: rows of a group pass in order through a state, one at a time, without gathering the group."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string


def ordered_fold(
    rows: DataFrame, by: list[str], order: list[str | Column], start: Callable[[], Any], step: Callable[[Any, tuple], list[tuple]], schema: str,
    columns: list[str] | None = None, finish: Callable[[Any, tuple], list[tuple]] | None = None, apart: list[str] | None = None,
) -> DataFrame:
    """Rows of ``schema`` that ``step`` (state, row) and, at a group's end, ``finish`` (state, key) give.

    Rows are dealt by ``by`` and sorted within partitions by ``by`` and ``order``; a state from ``start`` goes with each group, and
    nothing else is held. ``columns``: what a row has, ``by`` first; all by default. ``apart``: columns that also deal rows: where a state is known to be
    as new, so that a large group lies in several tasks.
    """
    own = list(dict.fromkeys([*by, *(apart or []), *(columns or rows.columns)]))
    kinds, n = to_arrow_schema(_parse_datatype_string(schema)), len(by) + len(apart or [])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, out = None, None, []

        def made() -> pa.RecordBatch:
            nonlocal out
            got = list(zip(*out)) or [()] * len(kinds)
            out = []
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(got, kinds)], kinds.names)

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if key is None or row[:n] != key:
                    if key is not None and finish:
                        out += finish(state, key)
                    key, state = row[:n], start()
                out += step(state, row)
                if len(out) >= 10_000:
                    yield made()
        if key is not None and finish:
            out += finish(state, key)
        if out:
            yield made()

    dealt = rows.repartition(*by, *(apart or [])).sortWithinPartitions(*by, *(apart or []), *order)
    return dealt.select(*own).mapInArrow(work, schema)
