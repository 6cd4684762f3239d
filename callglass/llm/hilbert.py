"""Sharding along a Hilbert curve over quantised metadata.

Every row gets a cell of a grid whose axes are metadata columns cut at their quantiles.
Rows are put in the order of the cells along a Hilbert curve and cut into runs whose
counts differ by one at most. Neighbours on the curve are neighbours in every axis, so a
shard covers a small box of the grid and min/max statistics prune on all axes at once.

Everything is made of built-in column functions. The driver sees one row per axis: the
least and greatest value and the cut points.

Defined results: a null in an axis has the code 0, before all values. Rows that are equal
in all ordering columns take neighbouring slots in any order. An empty table gives an
empty table. Input columns that have a name of an output column are replaced; other
extra columns stay.
"""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of a text value that are compared, after what all values have in common.
PREFIX = 7
#: Rows that one sort inside a cell should have to take, and the most parts of a cell.
ROWS_PER_PART, MOST_PARTS = 500_000, 65_536


def curve_tables(axes: int) -> tuple[list[int], list[int]]:
    """For state * 2^axes + corner: the digit along the curve, and the next state.

    A state is (entry corner, direction). The rule is the usual one: turn the corner into
    the frame of the state, undo the Gray code, and move to the frame of the child.
    """
    size, mask = 1 << axes, (1 << axes) - 1

    def right(x: int, k: int) -> int:
        k %= axes
        return ((x >> k) | (x << (axes - k))) & mask

    def left(x: int, k: int) -> int:
        return right(x, axes - k % axes)

    def gray(i: int) -> int:
        return i ^ (i >> 1)

    plain = {gray(i): i for i in range(size)}

    def entry(i: int) -> int:
        return 0 if i == 0 else gray(2 * ((i - 1) // 2))

    def turn(i: int) -> int:
        j = 0 if i == 0 else i if i % 2 else i - 1
        return ((j & ~(j + 1) & mask) .bit_length() if j & 1 else 0) % axes

    digits, states = [], []
    for state in range(size * axes):
        at, direction = divmod(state, axes)
        for corner in range(size):
            digit = plain[right(corner ^ at, direction + 1)]
            digits.append(digit)
            states.append((at ^ left(entry(digit), direction + 1)) * axes + (direction + turn(digit) + 1) % axes)
    return digits, states


def curve_index(codes: Sequence[Column], bits: int) -> Column:
    """The position along the curve of the cell with these codes, each of ``bits`` bits."""
    axes = len(codes)
    digits, states = curve_tables(axes)
    next_digit, next_state = F.array(*map(F.lit, digits)), F.array(*map(F.lit, states))
    corners = F.array(*(
        sum((F.shiftright(c, b).bitwiseAND(1) * (1 << (axes - 1 - a)) for a, c in enumerate(codes)), F.lit(0)) for b in range(bits - 1, -1, -1)
    ))
    start = F.struct(F.lit(0).alias("state"), F.lit(0).cast("long").alias("index"))

    def step(at: Column, corner: Column) -> Column:
        row = at["state"] * (1 << axes) + corner
        return F.struct(
            F.element_at(next_state, row + 1).alias("state"), (at["index"] * (1 << axes) + F.element_at(next_digit, row + 1)).alias("index")
        )

    return F.aggregate(corners, start, step, lambda at: at["index"])


def measures(df: DataFrame, axes: Sequence[str]) -> tuple[list[Column], int]:
    """One ordered number per axis, and the count of rows. Texts count by the bytes that follow their common start."""
    kinds = dict(df.dtypes)
    texts = [a for a in axes if kinds[a] == "string"]
    found = df.agg(F.count(F.lit(1)).alias("n"), *(f(F.col(a).cast("binary")).alias(f"{k}_{i}") for i, a in enumerate(texts) for k, f in (("min", F.min), ("max", F.max)))).first()
    out = []
    for a in axes:
        if a in texts:
            i = texts.index(a)
            common = os.path.commonprefix([bytes(found[f"min_{i}"] or b""), bytes(found[f"max_{i}"] or b"")])
            piece = F.substring(F.col(a).cast("binary"), len(common) + 1, PREFIX)
            out.append(F.conv(F.rpad(F.hex(piece), 2 * PREFIX, "0"), 16, 10).cast("double"))
        else:
            out.append(F.col(a).cast("double"))
    return out, found["n"]


def codes(df: DataFrame, numbers: Sequence[Column], bits: int) -> list[Column]:
    """0 for null, then 1 to 2^bits - 1 by the quantiles of each number."""
    cuts = (1 << bits) - 1
    shares = [k / cuts for k in range(1, cuts)]
    found = df.agg(*(F.percentile_approx(m, shares, 10_000).alias(f"q{i}") for i, m in enumerate(numbers))).first()
    out = []
    for i, m in enumerate(numbers):
        bounds = sorted(set(found[f"q{i}"] or []))
        above = sum(((m > F.lit(b)).cast("int") for b in bounds), F.lit(1))
        out.append(F.when(m.isNull(), 0).otherwise(above))
    return out


def assign(df: DataFrame, axes: Sequence[str], shards: int, ties: Sequence[str], bits: int = 4) -> DataFrame:
    """``df`` with ``cell`` (place on the curve), ``shard`` and ``slot`` (gapless from 0 in each shard).

    ``ties`` order the rows of a cell's part. A cell is cut into parts by a hash of
    ``ties``, as many as the row count asks for, so that a cell with most rows is still
    sorted by many tasks; offsets of cells and of parts come from counts.
    """
    numbers, total = measures(df, axes)
    parts = 64
    while parts < min(MOST_PARTS, total / ROWS_PER_PART):
        parts *= 2
    kept = [c for c in df.columns if c not in ("cell", "shard", "slot")]
    placed = [curve_index(codes(df, numbers, bits), bits).alias("cell"), F.pmod(F.xxhash64(*ties), F.lit(parts)).alias("__part")]
    counts = df.select(*placed).groupBy("cell", "__part").agg(F.count(F.lit(1)).alias("__n"))
    cells = counts.groupBy("cell").agg(F.sum("__n").alias("__n"))
    # At most 2^(axes * bits) rows, whatever the input.
    before_cell = cells.select("cell", (F.sum("__n").over(Window.orderBy("cell")) - F.col("__n")).alias("__cells"))
    in_cell = Window.partitionBy("cell").orderBy("__part")
    before = counts.withColumn("__parts", F.sum("__n").over(in_cell) - F.col("__n")).join(before_cell, "cell")
    before = before.select("cell", "__part", (F.col("__cells") + F.col("__parts")).alias("__before"))
    own = Window.partitionBy("cell", "__part").orderBy(*ties)
    rows = df.select(*kept, *placed).withColumn("__row", F.row_number().over(own) - 1).join(before, ["cell", "__part"])
    place, (low, more) = F.col("__before") + F.col("__row"), divmod(total, shards)
    cut = (low + 1) * more
    shard = F.when(place < cut, F.floor(place / (low + 1))).otherwise(more + F.floor((place - cut) / max(low, 1)))
    first = F.when(F.col("shard") <= more, F.col("shard") * (low + 1)).otherwise(cut + (F.col("shard") - more) * low)
    rows = rows.withColumn("__place", place).withColumn("shard", shard.cast("int"))
    return rows.select(*kept, "cell", "shard", (F.col("__place") - first).cast("long").alias("slot"))


def write(sharded: DataFrame, path: str) -> None:
    """One folder per shard, rows in the order of the curve."""
    sharded.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").mode("overwrite").parquet(path)


def documents_in_shards(documents: DataFrame, shards: int = 40) -> DataFrame:
    """All documents in ``shards`` runs along the curve over language, source and length."""
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = documents.select(
        "doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), "lang", "source", "n_chars"
    )
    done = assign(narrow, ["lang", "source", "n_chars"], shards, ["text_crc32", "doc_id"])
    return done.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "cell")
