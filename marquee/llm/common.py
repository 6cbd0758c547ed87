"""What the operators share: scratch tables, Arrow text buffers and vectorised word hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from marquee.session import fresh_path

#: Text bytes handled at once by the vectorised functions; one longer text makes a piece of its own.
PIECE_BYTES = 1 << 21
BATCH_BYTES = str(4 << 20)

BLANKS = bytes([0x20, *range(0x09, 0x0E)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20

_P = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def bounded_batches(spark: SparkSession) -> None:
    """Let Arrow batches end at a number of bytes, so that long texts do not add up in a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts the lineage, is computed once and survives lost executors."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def word_table(blanks: bytes) -> np.ndarray:
    """For each byte, whether it belongs to a word."""
    table = np.ones(256, dtype=bool)
    table[list(blanks)] = False
    return table


WORD_BYTES = word_table(BLANKS)


def pieces(batch: pa.RecordBatch, column: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch that hold at most ``limit`` bytes of text, or one row."""
    sizes = np.asarray(pa.compute.binary_length(batch.column(column)).fill_null(0))
    start = total = 0
    for row, size in enumerate(sizes.tolist()):
        if row > start and total + size > limit:
            yield batch.slice(start, row - start)
            start, total = row, 0
        total += size
    if len(sizes) > start:
        yield batch.slice(start)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column and the offset of each row (null: empty)."""
    column = column.fill_null("").cast(pa.large_binary())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case; other bytes stay."""
    return _LOWER[data]


def word_spans(data: np.ndarray, offsets: np.ndarray, table: np.ndarray = WORD_BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and for each row the index of its first word (one more entry than rows)."""
    inside = np.zeros(len(data) + 2, dtype=bool)
    inside[1:-1] = table[data]
    starts, ends = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    starts[edges] |= inside[1:-1][edges]
    ends[edges - 1] |= inside[1:-1][edges - 1]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _power_tables(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        made = []
        for factor in (base, pow(base, -1, 1 << 64)):
            table = np.ones(size, np.uint64)
            done, step = 1, factor
            while done < size:  # doubling: table[done:2*done] = table[:done] * factor**done
                take = min(done, size - done)
                table[done : done + take] = table[:take] * np.uint64(step)
                done, step = done + take, step * step & _MASK
            made.append(table)
        have = _powers[base] = (made[0], made[1])
    return have


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of every word, from prefix sums of a polynomial; works through the bytes in pieces."""
    base = (_P + 2 * seed * 0xD6E8FEB86659FD93) & _MASK | 1
    out = np.empty(len(starts), np.uint64)
    first = 0
    while first < len(starts):
        last = max(first + 1, int(np.searchsorted(ends, starts[first] + PIECE_BYTES, "right")))
        low, high = int(starts[first]), int(ends[last - 1])
        powers, inverse = _power_tables(high - low + 1, base)
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum((data[low:high].astype(np.uint64) + np.uint64(1)) * powers[: high - low], out=sums[1:])
        s, e = starts[first:last] - low, ends[first:last] - low
        out[first:last] = (sums[e] - sums[s]) * inverse[s] + (e - s).astype(np.uint64) * np.uint64(_P)
        first = last
    return mixed(out)


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of every run of n words (of the whole array: mask runs that cross rows)."""
    count = len(words) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    total, factor = np.zeros(count, np.uint64), 1
    for j in range(n):
        factor = factor * 0xA0761D6478BD642F + 0x1D8E4E27C47D124F & _MASK | 1
        total += words[j : j + count] * np.uint64(factor)
    return mixed(total)


def rows_of_words(firsts: np.ndarray) -> np.ndarray:
    """The row of every word, from each row's first word."""
    return np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))


def crc32_sql(number: str) -> str:
    """DuckDB SQL for the unsigned CRC-32 of an integer's decimal form."""
    return f"""xor(4294967295, list_reduce([4294967295] || list_transform(string_split(cast({number} as varchar), ''), lambda c: ascii(c)::bigint),
    lambda crc, byte: list_reduce([xor(crc, byte), 1, 2, 3, 4, 5, 6, 7, 8], lambda k, nth: case when k % 2 = 1 then xor(k // 2, 3988292384) else k // 2 end)))"""
