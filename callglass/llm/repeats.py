"""Removal of repeated passages, by super-k-mers.

A window is a run of ``size`` words of one text. Consecutive windows whose least m-word
hash (their minimiser) is the same travel as one packed string to the bucket of that
minimiser; a window and all its equals have the same minimiser and meet there. In the
bucket the windows are unpacked, sorted and counted. Words under a window that occurs
twice or more go.

Packed strings travel in compressed frames, one for each range of minimisers and flush of
a task. Copies are combined before they travel: a string that a flush holds several times
is sent once, without a place and with a weight, and its places are reported by the task
itself. The windows of minimisers with very many super-k-mers would fill one bucket. They
travel one by one as 128-bit fingerprints, combined in the task, and are dealt by
fingerprint.

Defined results: a null text has no words and stays null as text. A text shorter than a
window, or empty, stays as it is. Repeated rows are copies of each other, so their windows
count as repeated; they may share a ``doc_id``. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callglass.llm.words import WORD_BASE, Words, chunks, each_group, hashes_of, mapped, scrambled, small_batches, windows

#: Words of a minimiser.
SEED = 5
#: A minimiser with more super-k-mers is split; of these at most so many are named to the tasks, the largest first.
SPLIT_ABOVE, MOST_SPLIT = 5_000, 1 << 20
#: Bytes of packed strings that a task gathers before it sends them, and that are counted at once.
FLUSH, BLOCK = 32_000_000, 2_000_000
#: A frame of packed strings, of fingerprints, or of spans known to repeat.
PACKED, PRINTS, SPANS = range(3)
FRAMES = "part int, kind byte, n int, frame binary"
ARROW = pa.schema([("part", pa.int32()), ("kind", pa.int8()), ("n", pa.int32()), ("frame", pa.binary())])
SPAN_ROWS = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("start", pa.int32()), ("stop", pa.int32())])
#: Columns of a frame before its strings: place (without one: weight 2), size and key.
LAYOUT = [("doc_id", np.int64), ("text_key", np.int64), ("named", np.uint8), ("start", np.int32), ("length", np.int32), ("weight", np.uint8), ("key", np.uint64), ("second", np.uint64)]
WORDS = {PACKED: ("doc_id", "text_key", "named", "start", "length", "weight", "key"), PRINTS: ("doc_id", "text_key", "named", "start", "weight", "key", "second"), SPANS: ("doc_id", "text_key", "named", "start", "length")}
TYPES = dict(LAYOUT)


def runs_by_minimiser(c: Words, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each run of windows with one minimiser: text, first word, word after the last, minimiser. Also all windows' first words."""
    owner, at = c.runs(size)
    if not len(at):
        return owner, at, at, np.zeros(0, np.uint64), at
    least = scrambled(windows(c.hashes, SEED))
    span, done = size - SEED + 1, 1
    while done < span:  # least of ever longer runs
        step = min(done, span - done)
        least = np.minimum(least[: len(least) - step], least[step:])
        done += step
    key = least[at]
    new = np.append(True, (key[1:] != key[:-1]) | (owner[1:] != owner[:-1]))
    head = np.flatnonzero(new)
    last = np.append(head[1:], len(at)) - 1
    return owner[head], at[head], at[last] + size, key[head], at


def minimisers(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for _, c in chunks(batches):
        keys, n = np.unique(runs_by_minimiser(c, size)[3], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], ["key", "n"])


def several(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row: whether an equal row stands elsewhere, and whether it is the first of its equals."""
    order = np.lexsort(columns)
    new = np.zeros(len(order), bool)
    new[:1] = True
    for x in columns:
        new[1:] |= x[order][1:] != x[order][:-1]
    group = np.cumsum(new) - 1
    many, first = np.zeros(len(order), bool), np.zeros(len(order), bool)
    many[order] = np.bincount(group)[group] > 1 if len(order) else False
    first[order] = new
    return many, first


class Outbox:
    """Frames of a task, by part."""

    def __init__(self, parts: int, size: int) -> None:
        self.parts, self.size, self.press = parts, size, zstandard.ZstdCompressor(level=6)
        self.width = np.uint64((1 << 64) // parts + 1)
        self.held: list[dict[str, np.ndarray]] = []
        self.strings: list[bytes] = []
        self.bytes = 0

    def frames(self, kind: int, columns: dict[str, np.ndarray], part: np.ndarray, strings: list[bytes] | None = None) -> Iterator[tuple]:
        order = np.argsort(part, kind="stable")
        cuts = np.flatnonzero(np.append(True, part[order][1:] != part[order][:-1])) if len(order) else []
        for low, high in zip(cuts, [*cuts[1:], len(order)]):
            pick = order[low:high]
            parts = [columns[c][pick].astype(TYPES[c]).tobytes() for c in WORDS[kind]]
            if strings is not None:
                parts += [strings[i] for i in pick.tolist()]
            yield int(part[pick[0]]), kind, len(pick), self.press.compress(b"".join(parts))

    def spread(self, values: np.ndarray) -> np.ndarray:
        """The part of each value; minimisers are small hashes, so they are mixed once more."""
        return (scrambled(values.view(np.uint64), 9) // self.width).astype(np.int64)

    def add(self, columns: dict[str, np.ndarray], strings: list[bytes]) -> None:
        self.held.append(columns)
        self.strings += strings
        self.bytes += int(columns["length"].sum()) + 40 * len(strings)

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.held:
            return
        c = {k: np.concatenate([h[k] for h in self.held]) for k in self.held[0]}
        many, first = several(c["one"], c["two"])
        c["weight"] = np.where(many, 2, 1)
        c["named"] = np.where(many, 2, c["named"])
        rows = []
        sent = np.flatnonzero(~many | first)
        own = {k: v[sent] for k, v in c.items()}
        rows += self.frames(PACKED, own, self.spread(own["key"]), [self.strings[i] for i in sent.tolist()])
        known = {k: v[many] for k, v in c.items()} | {"length": c["words"][many], "named": c["was"][many]}
        rows += self.frames(SPANS, known, self.spread(known["text_key"]))
        self.held, self.strings, self.bytes = [], [], 0
        yield batch_of(rows)

    def prints(self, c: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        many, first = several(c["key"], c["second"])
        c["weight"], was = np.where(many, 2, 1), c["named"]
        c["named"] = np.where(many, 2, was)
        own = {k: v[~many | first] for k, v in c.items()}
        known = {k: v[many] for k, v in c.items()} | {"named": was[many], "length": np.full(int(many.sum()), self.size)}
        rows = [*self.frames(PRINTS, own, self.spread(own["key"])), *self.frames(SPANS, known, self.spread(known["text_key"]))]
        yield batch_of(rows)


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(columns, ARROW)], schema=ARROW)


def places(batches: Iterator[pa.RecordBatch], size: int, parts: int, split: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Frames of packed strings and fingerprints with their places, and of spans that are known to repeat."""
    box = Outbox(parts, size)
    for batch, c in chunks(batches):
        ids = batch.column("doc_id").fill_null(0).to_numpy()
        named = batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False).astype(np.uint8)
        text_keys = batch.column("text_key").to_numpy()
        owner, start, stop, key, at = runs_by_minimiser(c, size)
        if not len(owner):
            continue
        hot = np.isin(key, split)
        if hot.any():
            all_owner = c.runs(size)[0]
            inside = np.repeat(hot, stop - start - size + 1)
            who, where = all_owner[inside], at[inside]
            yield from box.prints({
                "doc_id": ids[who], "text_key": text_keys[who], "named": named[who], "start": where - c.first[who],
                "key": windows(c.hashes, size)[where], "second": windows(scrambled(c.hashes, 1), size)[where],
            })
            owner, start, stop, key = (x[~hot] for x in (owner, start, stop, key))
        low, high = c.starts[start], c.ends[stop - 1]
        raw = c.data.tobytes()
        box.add({
            "doc_id": ids[owner], "text_key": text_keys[owner], "named": named[owner], "was": named[owner], "start": start - c.first[owner],
            "length": high - low, "words": stop - start, "key": key, "one": hashes_of(c.hashes, start, stop, WORD_BASE), "two": hashes_of(scrambled(c.hashes, 1), start, stop, WORD_BASE),
        }, [raw[x:y] for x, y in zip(low.tolist(), high.tolist())])
        if box.bytes >= FLUSH:
            yield from box.flush()
    yield from box.flush()


def opened(frames: list[tuple[int, bytes]], kind: int) -> tuple[dict[str, np.ndarray], list[bytes]]:
    """Columns of all frames together, and their strings one after the other."""
    unpress = zstandard.ZstdDecompressor()
    columns, strings = {c: [np.zeros(0, TYPES[c])] for c in WORDS[kind]}, []
    for n, frame in frames:
        raw, at = unpress.decompress(frame), 0
        for c in WORDS[kind]:
            columns[c].append(np.frombuffer(raw, TYPES[c], n, at))
            at += n * np.dtype(TYPES[c]).itemsize
        strings.append(raw[at:])
    return {c: np.concatenate(v) for c, v in columns.items()}, strings


def runs_of(rows: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Joins consecutive windows of a row: row, first word, word after the last."""
    if not len(rows):
        return rows, at, at
    new = np.append(True, (rows[1:] != rows[:-1]) | (at[1:] != at[:-1] + 1))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(rows)) - 1
    return rows[first], at[first], at[last] + size


def repeated_in_packs(packs: list[bytes], weights: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and offset of each window whose words occur twice or more in the block."""
    bounds = np.concatenate([[0], np.cumsum(np.fromiter(map(len, packs), np.int64, len(packs)))])
    c = Words(np.frombuffer(b"".join(packs), np.uint8), bounds)
    words = c.hashes
    row, at = c.runs(size)
    prints = windows(words, size)[at]
    order = np.argsort(prints, kind="stable")
    ordered = prints[order]
    new = np.append(True, ordered[1:] != ordered[:-1])
    heads = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    total = np.add.reduceat(weights[row[order]], heads)
    twice = total[group] > 1
    members, lead = order[twice], order[heads[group[twice]]]
    apart = members != lead
    same = np.ones(len(members), bool)
    for k in range(size):
        same[apart] &= words[at[members[apart]] + k] == words[at[lead[apart]] + k]
    repeated = np.zeros(len(row), bool)
    repeated[members] = True
    if not same.all():  # two different windows with one fingerprint: count these by their words
        for p in np.unique(prints[members[~same]]):
            kept: dict[bytes, list[int]] = {}
            for i in np.flatnonzero(prints == p):
                kept.setdefault(words[at[i] : at[i] + size].tobytes(), []).append(i)
            for those in kept.values():
                repeated[those] = weights[row[those]].sum() > 1
    hits = np.flatnonzero(repeated)
    return row[hits], at[hits] - c.first[row[hits]]


def span_rows(c: dict[str, np.ndarray], rows: np.ndarray, start: np.ndarray, stop: np.ndarray) -> pa.RecordBatch:
    begin = c["start"][rows]
    return pa.RecordBatch.from_arrays([
        pa.array(c["doc_id"][rows], mask=c["named"][rows] == 0), pa.array(c["text_key"][rows]),
        pa.array((begin + start).astype(np.int32)), pa.array((begin + stop).astype(np.int32)),
    ], schema=SPAN_ROWS)


def count_buckets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Spans of the repeated windows. Frames come sorted by part, and a part holds whole buckets."""
    for block in each_group(batches, "part"):
        frames: dict[int, list[tuple[int, bytes]]] = {PACKED: [], PRINTS: [], SPANS: []}
        for kind, n, frame in zip(*(block.column(x).to_pylist() for x in ("kind", "n", "frame"))):
            frames[kind].append((n, frame))
        c, _ = opened(frames.pop(SPANS), SPANS)
        if len(c["start"]):
            yield span_rows(c, np.arange(len(c["start"])), np.zeros(len(c["start"]), np.int64), c["length"])
        c, _ = opened(frames.pop(PRINTS), PRINTS)
        if len(c["key"]):
            order = np.lexsort((c["second"], c["key"]))
            one, two = c["key"][order], c["second"][order]
            group = np.cumsum(np.append(True, (one[1:] != one[:-1]) | (two[1:] != two[:-1]))) - 1
            hit = order[np.bincount(group, c["weight"][order])[group] > 1]
            hit = hit[c["named"][hit] < 2]
            yield span_rows(c, hit, np.zeros(len(hit), np.int64), np.full(len(hit), size))
        c, strings = opened(frames.pop(PACKED), PACKED)
        raw, end = b"".join(strings), np.cumsum(c["length"], dtype=np.int64)
        order = np.argsort(c["key"], kind="stable")
        key, done = c["key"][order], np.cumsum(c["length"][order], dtype=np.int64)
        low = 0
        while low < len(order):
            high = int(np.searchsorted(done, done[low] - c["length"][order[low]] + BLOCK))
            high = int(np.searchsorted(key, key[min(high, len(key) - 1)], "right"))
            pick = order[low:high]
            packs = [raw[y - n : y] for y, n in zip(end[pick].tolist(), c["length"][pick].tolist())]
            row, at = repeated_in_packs(packs, c["weight"][pick].astype(np.int64), size)
            placed = c["named"][pick[row]] < 2
            row, start, stop = runs_of(row[placed], at[placed], size)
            yield span_rows(c, pick[row], start, stop)
            low = high


def repeated_spans(documents: DataFrame, size: int) -> DataFrame:
    """``doc_id``, ``text_key``, ``start``, ``stop``: words under windows that occur twice or more; spans may overlap."""
    spark = documents.sparkSession
    small_batches(spark)
    parts = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = documents.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    counts = mapped(documents.select("text"), lambda b: minimisers(b, size), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    top = counts.where(F.col("n") > SPLIT_ABOVE).orderBy(F.desc("n"), "key").limit(MOST_SPLIT).collect()
    split = spark.sparkContext.broadcast(np.array([r["key"] for r in top], np.int64).view(np.uint64))
    sent = mapped(keyed, lambda b: places(b, size, parts, split.value), FRAMES)
    buckets = sent.repartition("part").sortWithinPartitions("part")
    return mapped(buckets, lambda b: count_buckets(b, size), "doc_id long, text_key long, start int, stop int")


def spans_of_texts(documents: DataFrame, size: int) -> DataFrame:
    """The different spans of each ``__id`` and ``__key`` (of its text): equal rows name the same ones, which are kept once."""
    spans = repeated_spans(documents, size).groupBy(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"))
    return spans.agg(F.collect_set(F.struct("start", "stop")).alias("__spans"))


def kept_words(words: list[bytes], spans: list[dict]) -> list[bytes]:
    edge = np.zeros(len(words) + 1, np.int32)
    np.add.at(edge, [s["start"] for s in spans], 1)
    np.add.at(edge, [s["stop"] for s in spans], -1)
    stay = np.cumsum(edge[:-1]) == 0
    return [w for w, s in zip(words, stay.tolist()) if s]


def cut_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, removed, digest, kept = [], [], [], []
        for whole, spans in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("spans").to_pylist()):
            words = (whole or b"").split()
            n.append(len(words))
            if spans:
                words = kept_words(words, spans)
            removed.append(n[-1] - len(words))
            joined = b" ".join(words)
            digest.append(hashlib.sha256(joined).hexdigest())
            kept.append(whole if not removed[-1] else joined)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("text_key"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest), pa.array(kept, pa.binary()).cast(pa.string())],
            ["doc_id", "text_key", "n_words", "n_removed", "kept_sha256", "kept_text"],
        )


def without_repeats(documents: DataFrame, size: int = 35) -> DataFrame:
    """One row per document: ``n_words``, ``n_removed``, ``kept_sha256`` and ``kept_text``.

    ``kept_text`` is the text itself if nothing goes, else the kept words joined by a space.
    """
    right = spans_of_texts(documents, size).withColumnRenamed("__spans", "spans").hint("shuffle_hash")
    keyed = documents.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    both = keyed.join(right, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_key") == F.col("__key")), "left")
    return mapped(
        both.select("doc_id", "text_key", "text", "spans"), cut_words,
        "doc_id long, text_key long, n_words long, n_removed long, kept_sha256 string, kept_text string",
    )


def cut(documents: DataFrame, size: int = 35) -> DataFrame:
    """``documents`` with repeated passages removed from ``text``, and ``n_chars`` of the texts that change; all columns stay."""
    right = spans_of_texts(documents, size).hint("shuffle_hash")
    both = documents.join(right, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__key")), "left")
    names, schema = documents.columns, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.schema)
    return mapped(both.select(*names, "__spans"), lambda b: cut_rows(b, names), schema)


def cut_rows(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").to_pylist()
        changed = {}
        for k, spans in enumerate(batch.column("__spans").to_pylist()):
            if spans:
                changed[k] = b" ".join(kept_words(texts[k].encode().split(), spans)).decode()
        columns = {n: batch.column(n) for n in names}
        if changed:
            columns["text"] = pa.array([changed.get(k, t) for k, t in enumerate(texts)], pa.string())
            if "n_chars" in columns:
                old = columns["n_chars"]
                columns["n_chars"] = pa.array([len(changed[k]) if k in changed else n for k, n in enumerate(old.to_pylist())], old.type)
        yield pa.RecordBatch.from_arrays(list(columns.values()), names)
