"""Python functions of whole texts over small pieces of Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

# Rows that are Python objects at a time; a batch of Spark's may hold many megabytes of texts.
PIECE_ROWS = 128


def by_pieces(function: Callable, returns: str | T.DataType):
    """Column function that maps ``function`` over rows; only ``PIECE_ROWS`` of a batch are Python objects at once, and each piece leaves before the next."""
    arrow = to_arrow_type(returns if isinstance(returns, T.DataType) else T.DataType.fromDDL(returns))

    def pieces(columns: tuple[pa.Array, ...]) -> Iterator[pa.Array]:
        for first in range(0, len(columns[0]), PIECE_ROWS):
            rows = [c.slice(first, PIECE_ROWS).to_pylist() for c in columns]
            yield pa.array([function(*row) for row in zip(*rows, strict=True)], arrow)

    def one(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield from pieces((batch,))

    def many(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for batch in batches:
            yield from pieces(batch)

    single = function.__code__.co_argcount == 1
    return F.arrow_udf(one if single else many, returns, F.ArrowUDFType.SCALAR_ITER)
