"""Hashes of words and of word windows, and what is built on them."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words whose hashes a task remembers; forgotten all together when full.
REMEMBERED = 100_000
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """64-bit hashes of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = found = xxhash.xxh3_64_intdigest(word)
        return found

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(hashes: np.ndarray) -> np.ndarray:
    """The same hashes with every bit depending on every other."""
    hashes = (hashes ^ (hashes >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    hashes = (hashes ^ (hashes >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return hashes ^ (hashes >> np.uint64(31))


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash for each window of size words; none if there are fewer words."""
    count = len(hashes) - size + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(count, np.uint64)
    for n in range(size):
        total = total * _MULTIPLIER + hashes[n : n + count]
    return mixed(total)


def digest(words: list[bytes]) -> bytes:
    """16 bytes that tell word sequences apart."""
    return hashlib.md5(b" ".join(words), usedforsecurity=False).digest()


def bitmap_of(keys: DataFrame, column: str, bits: int = 1 << 24) -> np.ndarray:
    """A bitmap of fixed size (a power of two of bits) of a long column's values, by their low bits.

    Values not in the column may be found in it, never the reverse. Its size (2 MB) doesn't depend
    on the number of values, so it may be collected and broadcast.
    """
    block_bits = 1 << 15
    place = F.pmod(F.col(column), F.lit(bits))
    rows = (
        keys.select((place / block_bits).cast("int").alias("block"), (place % block_bits).alias("bit"))
        .groupBy("block")
        .agg(F.bitmap_construct_agg("bit").alias("bits"))
        .collect()
    )
    bitmap = np.zeros(bits // 8, np.uint8)
    for block, found in rows:
        bitmap[block * 4096 : (block + 1) * 4096] = np.frombuffer(bytes(found), np.uint8)
    return bitmap


def in_bitmap(bitmap: np.ndarray, values: np.ndarray) -> np.ndarray:
    place = values.astype(np.int64) & (8 * len(bitmap) - 1)
    return (bitmap[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1


def long_rows(names: list[str], columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Record batches of bounded size of long columns."""
    size = 1 << 17
    for start in range(0, len(columns[0]) if columns else 0, size):
        yield pa.RecordBatch.from_arrays(
            [pa.array(c[start : start + size].astype(np.int64, copy=False)) for c in columns], names=names
        )
