"""Variable-byte numbers: seven bits a byte, lowest first.

Two conventions for the high bit: ``continue`` marks all bytes but the last, ``stop`` marks the last byte alone. Numbers are unsigned, up to
32 bits in the files that use them, up to 63 here.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

CONVENTIONS = ("continue", "stop")
FILE_BYTES = 5  #: of the longest number in the files, which have 32 bits for one


def varbyte_length(n: Column, most: int = 9) -> Column:
    """Bytes of a number, the same in both conventions.

    ``most`` is what the longest number of a format has, 5 for numbers of 32 bits; a larger number, which that format can't hold, counts as one.
    """
    out = F.lit(most)
    for size in range(most - 1, 0, -1):
        out = F.when(n < F.lit(1 << 7 * size), F.lit(size)).otherwise(out)
    return out.cast("long")


def encode_number(n: int, convention: str = "continue") -> bytes:
    """One number's bytes."""
    if n < 0 or convention not in CONVENTIONS:
        raise ValueError(f"{n} in {convention}")
    groups = [n >> s & 127 for s in range(0, max(1, n.bit_length()), 7)]
    high = 128 if convention == "continue" else 0
    return bytes([*(g | high for g in groups[:-1]), groups[-1] | (128 - high)])


def encode_numbers(numbers: Iterable[int], convention: str = "continue") -> bytes:
    """The bytes of all numbers, a place of all numbers at a time. Raises ValueError for what is below 0 or beyond 63 bits."""
    n = np.array(numbers if isinstance(numbers, np.ndarray) else list(numbers), dtype=object if not isinstance(numbers, np.ndarray) else None)
    if convention not in CONVENTIONS or (len(n) and (n.min() < 0 or n.max() >= 1 << 63)):
        raise ValueError(f"numbers below 0 or beyond 63 bits, or no convention {convention!r}")
    n = n.astype(np.int64)
    size = np.ones(len(n), np.int64)
    for place in range(1, 9):
        size += n >= 1 << 7 * place
    start = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    for place in range(9):
        own = size > place
        last = size[own] == place + 1
        high = ~last if convention == "continue" else last
        out[start[own] + place] = (n[own] >> 7 * place & 127) | (high.astype(np.int64) << 7)
    return out.tobytes()


def decode_numbers(data: bytes, convention: str = "continue") -> list[int]:
    """All numbers of ``data``, by sums over the bytes between last bytes. Raises ValueError if the last number is cut short."""
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return []
    last = (raw < 128) if convention == "continue" else (raw >= 128)
    if not last[-1]:
        raise ValueError("the last number is cut short")
    ends = np.flatnonzero(last)
    starts = np.concatenate([[0], ends[:-1] + 1])
    place = np.arange(len(raw)) - np.repeat(starts, ends - starts + 1)
    return np.add.reduceat((raw & 127).astype(np.int64) << 7 * place, starts).tolist()


def read_numbers(stream: Iterator[bytes]) -> list[int]:
    return decode_numbers(b"".join(stream))


def varbyte_encode(numbers: Column, convention: str = "continue") -> Column:
    """``binary`` of an array of numbers; null for null."""

    @F.pandas_udf("binary")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else encode_numbers(v, convention))

    return run(numbers)


def varbyte_decode(data: Column, convention: str = "continue") -> Column:
    """The numbers of a ``binary``; null for null."""

    @F.pandas_udf("array<long>")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else decode_numbers(v, convention))

    return run(data)


def varbyte_sums(data: Column, convention: str = "continue") -> Column:
    """The running sums of a ``binary``'s numbers: ids of gaps. Null for null."""

    @F.pandas_udf("array<long>")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else np.cumsum(np.array(decode_numbers(v, convention), np.int64)))

    return run(data)
