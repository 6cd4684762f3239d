"""Benchmark decontamination by greedy string tiling.

Runs of ``SEED`` words that a document shares with a benchmark item are seeds. For each
pair with seeds, tiles are marked greedily: the longest match of words that are free on
both sides is marked first, then the next longest, down to ``SEED`` words. Tiles may lie
in any order, so a passage whose parts were moved is caught. A pair is reported if tiles
cover at least ``coverage`` of the item's words. A shorter item is one seed as it stands,
down to ``LEAST_ITEM`` words; one or two words say nothing about where a text comes from.

Seeds come from running (Karp-Rabin) hashes of the words; words are compared by 64-bit
hashes of their lower-cased letters, digits and non-ASCII characters. In scripts without
blanks each character is a word.

The items go to all tasks only while their seeds and bytes are below a checked size;
beyond it seeds are joined by a shuffle. Both ways give the same rows.

Defined results: null and empty texts and items of fewer than ``LEAST_ITEM`` words match
nothing. Repeated rows of either table give repeated pairs. A null id stays null. Only
``doc_id``, ``text`` and ``item_id``, ``text`` are read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callglass.llm.words import NO_LETTER, Words, chunks, mapped, small_batches, windows

#: Words of a seed, which is also the shortest tile, and of the shortest item.
SEED, LEAST_ITEM = 5, 3
#: Largest benchmark, in items and bytes, that is sent to all tasks.
SENT_ITEMS, SENT_BYTES = 200_000, 16_000_000
PAIRS = "doc_id long, item_id long, item_words int, tiles int, covered int, coverage double"
ARROW = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("item_words", pa.int32()), ("tiles", pa.int32()), ("covered", pa.int32()), ("coverage", pa.float64())])


def tiles(item: np.ndarray, doc: np.ndarray, at_item: np.ndarray, at_doc: np.ndarray, seed: int = SEED) -> list[tuple[int, int, int]]:
    """Greedy tiles (item place, document place, words) from all pairs of equal seeds."""
    order = np.lexsort((at_item, at_doc - at_item))
    i, d = at_item[order], at_doc[order]
    new = np.append(True, (i[1:] != i[:-1] + 1) | (d[1:] != d[:-1] + 1))
    head = np.flatnonzero(new)
    size = np.diff(np.append(head, len(i))) + seed - 1
    found = [(-n, a, b) for n, a, b in zip(size.tolist(), i[head].tolist(), d[head].tolist())]
    heapq.heapify(found)
    used_item, used_doc, out = np.zeros(len(item), bool), set(), []
    while found:
        n, a, b = heapq.heappop(found)
        n = -n
        free = [not used_item[a + k] and b + k not in used_doc for k in range(n)]
        if all(free):
            out.append((a, b, n))
            used_item[a : a + n] = True
            used_doc.update(range(b, b + n))
            continue
        k = 0
        while k < n:  # what is left of the match competes anew
            start = k
            while k < n and free[k]:
                k += 1
            if k - start >= seed:
                heapq.heappush(found, (start - k, a + start, b + start))
            k += 1
    return out


class Benchmark:
    """Words and seeds of some items, all with seeds of ``size`` words."""

    def __init__(self, ids: list, words: list[np.ndarray], size: int) -> None:
        self.ids, self.words, self.size = ids, words, size
        seeds = [windows(w, size) for w in words]
        seed = np.concatenate([np.zeros(0, np.uint64), *seeds])
        item = np.repeat(np.arange(len(words)), [len(s) for s in seeds])
        place = np.concatenate([np.zeros(0, np.int64), *(np.arange(len(s)) for s in seeds)])
        order = np.argsort(seed, kind="stable")
        self.seed, self.item, self.place = seed[order], item[order], place[order]
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.seed >> np.uint64(44)).astype(np.int64)] = True

    def pairs(self, owner: np.ndarray, at: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Document, item, place in the document and in the item of each shared seed."""
        hit = np.flatnonzero(self.maybe[(seeds >> np.uint64(44)).astype(np.int64)])
        low, high = np.searchsorted(self.seed, seeds[hit]), np.searchsorted(self.seed, seeds[hit], "right")
        times = high - low
        row = np.repeat(np.arange(len(hit)), times)
        which = low[row] + np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
        hit = hit[row]
        return owner[hit], self.item[which], at[hit], self.place[which]

    def tile(self, item: int, hashes: np.ndarray, at: np.ndarray, place: np.ndarray, coverage: float) -> tuple | None:
        words = self.words[item]
        edge = np.zeros(len(words) + 1, np.int64)
        np.add.at(edge, place, 1)
        np.add.at(edge, place + self.size, -1)
        if np.count_nonzero(np.cumsum(edge)[:-1]) < coverage * len(words):  # tiles cover no more than all seeds
            return None
        found = tiles(words, hashes, place, at, self.size)
        covered = sum(n for _, _, n in found)
        return (self.ids[item], len(words), len(found), covered, covered / len(words)) if covered >= coverage * len(words) else None


def benchmarks(ids: list, words: list[np.ndarray]) -> list[Benchmark]:
    """The items by their seeds' words."""
    size = [min(SEED, len(w)) for w in words]
    own = {s: [k for k, x in enumerate(size) if x == s] for s in range(LEAST_ITEM, SEED + 1)}
    return [Benchmark([ids[k] for k in ks], [words[k] for k in ks], s) for s, ks in own.items() if ks]


def worded(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Words]]:
    return chunks(batches, lower=True, space=NO_LETTER, characters=True)


def item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[np.ndarray]]]:
    for batch, c in worded(batches):
        yield batch.column("item_id").to_pylist(), [c.hashes[a:b] for a, b in zip(c.first[:-1], c.first[1:])]


def hits(c: Words, sized: list[Benchmark], coverage: float) -> Iterator[tuple[int, tuple]]:
    """Text and pair of each text and item that tiles cover."""
    for items in sized:
        owner, at = c.runs(items.size)
        if not len(at):
            continue
        doc, item, where, place = items.pairs(owner, at, windows(c.hashes, items.size)[at])
        order = np.lexsort((place, where, item, doc))
        doc, item, where, place = (x[order] for x in (doc, item, where, place))
        head = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]))) if len(doc) else []
        for low, high in zip(head, [*head[1:], len(doc)]):
            found = items.tile(int(item[low]), c.hashes, where[low:high], place[low:high], coverage)
            if found:
                yield int(doc[low]), found


def search(batches: Iterator[pa.RecordBatch], items: list[Benchmark], coverage: float) -> Iterator[pa.RecordBatch]:
    for batch, c in worded(batches):
        ids = batch.column("doc_id")
        rows = [(ids[doc].as_py(), *found) for doc, found in hits(c, items, coverage)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows), ARROW)], schema=ARROW)


def free(batches: Iterator[pa.RecordBatch], items: list[Benchmark], coverage: float) -> Iterator[pa.RecordBatch]:
    """The rows whose own text covers no item."""
    for batch, c in worded(batches):
        keep = np.ones(batch.num_rows, bool)
        keep[[doc for doc, _ in hits(c, items, coverage)]] = False
        yield batch.filter(pa.array(keep))


def seeds_of(batches: Iterator[pa.RecordBatch], name: str, sizes: list[int], own: bool = False) -> Iterator[pa.RecordBatch]:
    """Distinct seeds of each text with its id and a key of its text; with ``own`` a text of few words is one seed."""
    for batch, c in worded(batches):
        for size in sizes:
            owner, at = c.runs(size)
            if own and size < SEED:
                owner, at = (x[c.counts[owner] == size] for x in (owner, at))
            if len(at):
                both = np.unique(np.stack([windows(c.hashes, size)[at].view(np.int64), owner], 1), axis=0)
                row = pa.array(both[:, 1])
                columns = [pa.array(both[:, 0]), batch.column(name).take(row), batch.column("text_key").take(row), pa.array(np.full(len(both), size, np.int32))]
                yield pa.RecordBatch.from_arrays(columns, ["seed", name, "text_key", "words"])


def search_pairs(batches: Iterator[pa.RecordBatch], coverage: float, keys: bool = False) -> Iterator[pa.RecordBatch]:
    """The same for rows of a document and an item; with ``keys`` only the document's id and key of its text."""
    for batch in batches:
        items = pa.RecordBatch.from_arrays([batch.column("item_id"), batch.column("item_text")], ["item_id", "text"])
        words = [w for _, ws in item_words(iter([items])) for w in ws]
        for k in range(batch.num_rows):
            own, row = benchmarks([batch.column("item_id")[k].as_py()], [words[k]]), batch.slice(k, 1)
            for found in search(iter([row.select(["doc_id", "text"])]), own, coverage):
                yield row.select(["doc_id", "text_key"]) if keys else found


def sent(benchmark: DataFrame) -> tuple[DataFrame, Broadcast | None]:
    """The items with a text, and their ids and words for all tasks if they are few."""
    spark = benchmark.sparkSession
    small_batches(spark)
    items = benchmark.select("item_id", "text").where("text is not null")
    size = items.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    if size["n"] > SENT_ITEMS or size["bytes"] > SENT_BYTES:
        return items, None
    rows = items.collect()
    batch = pa.RecordBatch.from_arrays([pa.array([r["item_id"] for r in rows], pa.int64()), pa.array([r["text"] for r in rows], pa.string())], ["item_id", "text"])
    found = list(item_words(iter([batch])))
    return items, spark.sparkContext.broadcast(([i for ids, _ in found for i in ids], [w for _, ws in found for w in ws]))


def seeded(documents: DataFrame, items: DataFrame) -> DataFrame:
    """Documents beside the items with which they share a seed."""
    keyed = documents.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    tests = items.select("item_id", F.xxhash64("text").alias("text_key"), "text")
    every = list(range(LEAST_ITEM, SEED + 1))
    theirs = mapped(tests, lambda b: seeds_of(b, "item_id", every, own=True), "seed long, item_id long, text_key long, words int").withColumnRenamed("text_key", "item_key")
    sizes = sorted(r["words"] for r in theirs.select("words").distinct().collect())  # at most three numbers
    own = mapped(keyed, lambda b: seeds_of(b, "doc_id", sizes), "seed long, doc_id long, text_key long, words int")
    pairs = own.join(theirs, ["seed", "words"]).select("doc_id", "text_key", "item_id", "item_key").distinct()
    pairs = pairs.withColumnsRenamed({"doc_id": "d", "text_key": "dk", "item_id": "i", "item_key": "ik"})
    both = keyed.join(pairs, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("dk"))).drop("d", "dk")
    tests = tests.withColumnsRenamed({"text": "item_text", "text_key": "item_key"})
    return both.join(tests, tests["item_id"].eqNullSafe(both["i"]) & (tests["item_key"] == both["ik"])).select("doc_id", "text_key", "text", "item_id", "item_text")


def contaminated(documents: DataFrame, benchmark: DataFrame, coverage: float = 0.5) -> DataFrame:
    """Pairs of a document and an item whose words tiles cover: ``doc_id``, ``item_id``, ``item_words``, ``tiles``, ``covered``, ``coverage``."""
    items, few = sent(benchmark)
    if few is not None:
        return mapped(documents.select("doc_id", "text"), lambda b: search(b, benchmarks(*few.value), coverage), PAIRS)
    return mapped(seeded(documents, items), lambda b: search_pairs(b, coverage), PAIRS)


def clean(documents: DataFrame, benchmark: DataFrame, coverage: float = 0.5) -> DataFrame:
    """The documents of which no benchmark item is covered. Each row is judged by its own text, whatever its ``doc_id``."""
    items, few = sent(benchmark)
    if few is not None:
        return mapped(documents, lambda b: free(b, benchmarks(*few.value), coverage), documents.schema)
    found = mapped(seeded(documents, items), lambda b: search_pairs(b, coverage, keys=True), "doc_id long, text_key long").distinct()
    found = found.withColumnsRenamed({"doc_id": "__id", "text_key": "__key"})
    return documents.join(found, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__key")), "left_anti")
