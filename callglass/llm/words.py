"""Words of whole texts as numbers, in Arrow batches inside tasks.

A word is a run of bytes other than 0x20 and 0x09 to 0x0D. Words stay places in the buffer
of a batch; what is compared are 64-bit hashes, computed for all words of a chunk at once.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: Rows and bytes of one Arrow batch, and bytes of text handled at once.
BATCH, BATCH_BYTES, CHUNK = 1_000, 4_000_000, 2_000_000
#: Bytes hashed in one step.
STEP = 1 << 20
MASK = (1 << 64) - 1
#: Two odd multipliers, for words and for windows of words.
BYTE_BASE, WORD_BASE = 0xD6E8FEB86659FD93, 0x9E3779B97F4A7C15
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes outside ASCII letters, ASCII digits and other characters' bytes.
NO_LETTER = np.ones(256, bool)
NO_LETTER[[*range(ord("0"), ord("9") + 1), *range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base^0 to base^(n-1) modulo 2^64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.ones(max(n, STEP + 1), np.uint64)
        have[1:] = base
        with np.errstate(over="ignore"):
            have = _powers[base] = np.cumprod(have, dtype=np.uint64)
    return have


def hashes_of(values: np.ndarray, first: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """Hash of each run values[first:end], independent of where it lies."""
    with np.errstate(over="ignore"):
        sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum((values.astype(np.uint64) + np.uint64(1)) * powers(base, len(values))[: len(values)], out=sums[1:])
        return (sums[end] - sums[first]) * powers(pow(base, -1, 1 << 64), len(values) + 1)[first]


def words_in(data: np.ndarray, bounds: np.ndarray, space: np.ndarray = SPACE, cuts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, byte after the last, and hash of each word; no word crosses one of ``bounds`` or ``cuts``."""
    inside = ~space[data]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    edges = bounds if cuts is None else np.concatenate([bounds, cuts])
    edges = edges[(edges > 0) & (edges < len(data))]
    starts[edges] = inside[edges]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    ends[edges - 1] = inside[edges - 1]
    first, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    out = np.empty(len(first), np.uint64)
    low = 0
    while low < len(first):  # steps of whole words
        zero = first[low]
        high = max(low + 1, int(np.searchsorted(end, zero + STEP, "right")))
        out[low:high] = hashes_of(data[zero : end[high - 1]], first[low:high] - zero, end[low:high] - zero, BYTE_BASE)
        low = high
    return first, end, scrambled(out)


def windows(values: np.ndarray, size: int) -> np.ndarray:
    """64-bit hash of each run of ``size`` values; empty if there are fewer."""
    if len(values) < size:
        return np.zeros(0, np.uint64)
    factor, power, span, out, done, rest = WORD_BASE, values.astype(np.uint64), 1, None, 0, size
    with np.errstate(over="ignore"):
        while rest:
            if rest & 1:
                if out is None:
                    out, done = power, span
                else:
                    n = len(values) - done - span + 1
                    out = out[:n] * np.uint64(factor) + power[done : done + n]
                    done += span
            rest >>= 1
            if rest:
                n = len(power) - span
                power = power[:n] * np.uint64(factor) + power[span : span + n]
                factor = factor * factor & MASK
                span *= 2
    return out[: len(values) - size + 1]


def scrambled(values: np.ndarray, seed: int = 0) -> np.ndarray:
    """A well-mixed hash of each 64-bit value."""
    with np.errstate(over="ignore"):
        x = values.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & MASK)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def characters_of(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 with blanks for wide punctuation, and the edges of each character of a script without blanks.

    These are Thai, Lao, Myanmar, Khmer, kana and Han characters.
    """
    leads = np.flatnonzero(data >= 0xE0)
    leads = leads[leads + 2 < len(data)]
    a, b, c = data[leads], data[leads + 1], data[leads + 2]
    wide = (a == 0xE3) & (b == 0x80) & ((c <= 0x83) | (c >= 0x88) & (c <= 0x9F))  # U+3000 to U+3003, U+3008 to U+301F
    wide |= (a == 0xEF) & (b == 0xBC) & ((c >= 0x81) & (c <= 0x8F) | (c >= 0x9A) & (c <= 0x9F))  # U+FF01 to U+FF0F, U+FF1A to U+FF1F
    if wide.any():
        data = data.copy()
        data[(leads[wide][:, None] + np.arange(3)).ravel()] = 0x20
    three = (a >= 0xE3) & (a <= 0xE9) & ~wide
    three |= (a == 0xE0) & (b >= 0xB8) & (b <= 0xBB) | (a == 0xE1) & ((b >= 0x80) & (b <= 0x82) | (b == 0x9E) | (b == 0x9F))
    four = (a == 0xF0) & (b >= 0xA0) & (b <= 0xB3)
    return data, np.concatenate([leads[three], leads[three] + 3, leads[four], leads[four] + 4])


class Words:
    """Words of consecutive texts: text k has the words ``first[k]`` to ``first[k + 1]``."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, space: np.ndarray = SPACE, cuts: np.ndarray | None = None) -> None:
        self.data = data
        self.starts, self.ends, self.hashes = words_in(data, bounds, space, cuts)
        self.first = np.searchsorted(self.starts, bounds)
        self.counts = np.diff(self.first)

    def runs(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Text and first word of each run of ``size`` words of one text."""
        room = np.maximum(self.counts - size + 1, 0)
        owner = np.repeat(np.arange(len(room)), room)
        before = np.concatenate([[0], np.cumsum(room)])[:-1]
        return owner, np.arange(len(owner)) - np.repeat(before, room) + self.first[:-1][owner]


def chunks(
    batches: Iterator[pa.RecordBatch], lower: bool = False, most: int = CHUNK, space: np.ndarray = SPACE, characters: bool = False
) -> Iterator[tuple[pa.RecordBatch, Words]]:
    """Rows of a batch that hold about ``most`` bytes of ``text``, and their words; a null text counts as empty.

    With ``characters`` each character of a script without blanks is a word.
    """
    for batch in batches:
        column = batch.column("text").cast(pa.large_binary()).fill_null(b"")
        if not len(column):
            continue
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
        low = 0
        while low < len(column):
            high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + most, "right")) - 1)
            part = data[offsets[low] : offsets[high]]
            part = LOWER[part] if lower else part
            part, cuts = characters_of(part) if characters else (part, None)
            yield batch.slice(low, high - low), Words(part, offsets[low : high + 1] - offsets[low], space, cuts)
            low = high


def small_batches(spark: SparkSession, rows: int = BATCH) -> None:
    """Texts can be long, so few rows go into one Arrow batch. Python workers get this package's folder in their path."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    home, known = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment.get("PYTHONPATH", "")
    if home not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [home, known]))


def mapped(df: DataFrame, function, schema: str | StructType) -> DataFrame:
    """``function`` turns the Arrow batches of a partition into others, one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from function(batches)

    return df.mapInArrow(run, schema)


def whole_groups(batches: Iterator[pa.RecordBatch], key: str, held_bytes: int) -> Iterator[pa.Table]:
    """Blocks of rows that come sorted by ``key``, cut between keys."""
    held, weight = [], 0
    for batch in batches:
        held.append(batch)
        weight += batch.nbytes
        if weight >= held_bytes:
            block = pa.Table.from_batches(held)
            keys = block.column(key).to_numpy()
            cut = int(np.searchsorted(keys, keys[-1]))
            if cut:
                yield block.slice(0, cut)
                held = block.slice(cut).combine_chunks().to_batches()
                weight = sum(b.nbytes for b in held)
    if held:
        yield pa.Table.from_batches(held)


def each_group(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The rows of one key after the other; they come sorted by ``key``."""
    for block in whole_groups(batches, key, 1):
        keys = block.column(key).to_numpy()
        heads = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])).tolist()
        for low, high in zip(heads, [*heads[1:], len(keys)]):
            yield block.slice(low, high - low)
