"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from drawlake.operators.graph import checkpointed, components, shared_dir, stored

__all__ = ["CRC32_SQL", "checkpointed", "components", "crc32_sql", "fold_of", "free_name", "giving_back", "shared_dir", "stored"]


def fold_of(key: Column, n: int) -> Column:
    """crc32 of the key's text modulo n, as the contracts fix folds."""
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(n))


def free_name(taken: list[str], wanted: str) -> str:
    """``wanted``, with underscores after it until no name of ``taken`` is the same (names differ by more than case)."""
    low = {t.lower() for t in taken}
    while wanted.lower() in low:
        wanted += "_"
    return wanted


#: SQL, after WITH RECURSIVE: crc_tab(tab), the 256 steps of CRC-32 as one list, made from its polynomial.
CRC32_SQL = """crc_steps(i, v, k) AS (SELECT i, i, 0 FROM range(256) r(i) UNION ALL SELECT i, xor(v >> 1, 3988292384 * (v & 1)), k + 1 FROM crc_steps WHERE k < 8),
crc_tab AS MATERIALIZED (SELECT list(v ORDER BY i) AS tab FROM crc_steps WHERE k = 8)"""


def crc32_sql(text: str) -> str:
    """SQL of the unsigned crc32 of a text's UTF-8 bytes, beside crc_tab."""
    code = f"hex(encode({text}))"
    bytes_ = f"list_transform(range(1, length({code}), 2), lambda p: ('0x' || substr({code}, p, 2))::BIGINT)"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, {bytes_}), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])))"


def giving_back(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow; at its end the worker, which Spark keeps for later tasks, hands free memory back to the system."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # another C library has none
                pass

    return wrapped
