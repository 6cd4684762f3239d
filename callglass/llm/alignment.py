"""Alignment of two tokenizers over the bytes of each text.

Both encode a text, tokens become ranges of bytes. For the documents of a batch, ``merge_asof``
by document finds for each token's start the other side's token that covers it; the pairs of
both directions are all overlaps. Overlaps that end at the same byte close a group. Tokens of
the two sides in one group are linked.

An id pair's count is the number of documents that hold it linked. Documents keep their
distinct pairs in a stored table, so texts are encoded once. Counts are added up in tasks first
and then by pair. They go to all tasks where a count of pairs shows that they fit there;
beyond it pairs are joined by a shuffle.

Defined results: a null or empty text has no tokens, nor has one whose tokens' bytes are not
the space and the text (a text that holds the second tokenizer's own sign for a space, for
one); its counts are 0 and its digest is empty. Repeated rows are documents of their own and
may share a ``doc_id``, which may be null. Only ``doc_id`` and ``text`` are read. A document is
encoded in one piece: its tokens must fit a task. The digest is over the groups' ids as text;
``signs`` are the one between a group's two sides and the one between groups.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callglass.llm.components import stored
from callglass.llm.words import mapped, small_batches

#: Bytes of text aligned at once, linked pairs of one group written out one by one, pairs a task counts at once.
CHUNK, PLAIN_GROUP, COUNTED = 1_000_000, 4_096, 2_000_000
#: Pairs whose counts go to all tasks, 16 bytes each.
HELD = 6_000_000
#: Between the sides of a group and between groups, if a caller names none.
SIGNS = ";|"
# The printable characters that stand for themselves in byte-level vocabularies.
PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]


def byte_letters() -> dict[str, int]:
    """The character of each byte in a byte-level vocabulary: itself if printable, else the next from U+0100."""
    rest = iter(range(0x100, 0x200))
    return {chr(b if b in PRINTABLE else next(rest)): b for b in range(0x100)}


class Table:
    """Bytes of every id, end to end, so that many tokens are spelt out at once."""

    def __init__(self, tokens: list[bytes]) -> None:
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.data = np.frombuffer(b"".join(tokens), np.uint8)

    def spelt(self, ids: np.ndarray) -> np.ndarray:
        lengths = self.lengths[ids]
        shift = self.starts[ids] - (np.cumsum(lengths) - lengths)
        return self.data[np.repeat(shift, lengths) + np.arange(lengths.sum())]


class Sides:
    """The two tokenizers, their bytes, and their ids as text with each sign that can follow."""

    def __init__(self, first: str, second: str, signs: str = SIGNS) -> None:
        import public_tokenizers
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        path = public_tokenizers.path(first)
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        with open(path, encoding="utf-8") as lines:
            spec = json.load(lines)
        letters, vocabulary = byte_letters(), spec["model"]["vocab"]
        tokens = [b""] * (max(self.library.get_vocab(with_added_tokens=True).values()) + 1)
        for t, i in vocabulary.items():
            tokens[i] = bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode()
        self.a = Table(tokens)
        # If merges come in order of ids, the ids of bytes are ranks and a faster library gives the same ids.
        ids = [vocabulary["".join(m.split(" ") if isinstance(m, str) else m)] for m in spec["model"]["merges"]]
        self.ranked = None
        if ids == sorted(ids) and spec["normalizer"] is None:
            special = {t["content"] for t in spec.get("added_tokens", ())}
            ranks = {tokens[i]: i for t, i in vocabulary.items() if t not in special}
            self.ranked = tiktoken.Encoding("first", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(second))
        self.b = Table([
            bytes([int(p[3:5], 16)]) if self.pieces.is_byte(i) else p.replace("▁", " ").encode()
            for i, p in enumerate(self.pieces.id_to_piece(k) for k in range(self.pieces.get_piece_size()))
        ])
        na, nb = len(self.a.lengths), len(self.b.lengths)
        #: Text of A's id with "," or the sign between sides after it, then of B's with "," or the sign between groups.
        self.told = [f"{i}{s}" for i in range(na) for s in "," + signs[0]] + [f"{i}{s}" for i in range(nb) for s in "," + signs[1]]
        self.base = 2 * na
        self.nb = nb

    def encoded(self, texts: list[str]) -> list[list[int]]:
        """A's ids. Characters of newer alphabets, in which letters may differ between versions, go to the file's own library."""
        if self.ranked is None:
            return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        return [
            self.ranked.encode_ordinary(t) if t.isascii() or settled(t) else self.library.encode(t, add_special_tokens=False).ids
            for t in texts
        ]


def settled(text: str) -> bool:
    """Only characters below U+0590 and general punctuation to U+206F."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return bool(((points < 0x590) | ((points >= 0x2000) & (points < 0x2070))).all())


_sides: dict[tuple[str, ...], Sides] = {}


def sides(names: tuple[str, ...]) -> Sides:
    """For two file names and, if given, the digest's signs."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if names not in _sides:
        _sides[names] = Sides(*names)
    return _sides[names]


def flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """All ids, and where each list starts."""
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
    return np.fromiter(chain.from_iterable(lists), np.int64, int(bounds[-1])), bounds


def equal_bytes(table: Table, ids: np.ndarray, bounds: np.ndarray, data: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Which texts (``data`` from edge to edge) their tokens spell exactly."""
    ends = np.concatenate([[0], np.cumsum(table.lengths[ids])])[bounds]
    same = np.diff(ends) == np.diff(edges)
    if same.all():
        wrong = np.flatnonzero(table.spelt(ids) != data)
        same[np.searchsorted(edges, wrong, "right") - 1] = False
        return same
    spelt = table.spelt(ids)
    for k in np.flatnonzero(same).tolist():
        same[k] = np.array_equal(spelt[ends[k] : ends[k + 1]], data[edges[k] : edges[k + 1]])
    return same


class Aligned:
    """Tokens of several texts, dealt into groups."""

    def __init__(self, a: np.ndarray, b: np.ndarray, doc_a: np.ndarray, doc_b: np.ndarray, len_a: np.ndarray, len_b: np.ndarray) -> None:
        self.a, self.b, self.doc_a, self.doc_b = a, b, doc_a, doc_b
        end_a, end_b = np.cumsum(len_a), np.cumsum(len_b)
        left = pd.DataFrame({"doc": doc_a, "at": end_a - len_a, "a": np.arange(len(a))})
        right = pd.DataFrame({"doc": doc_b, "at": end_b - len_b, "b": np.arange(len(b))})
        covered = pd.merge_asof(left, right, on="at", by="doc")
        covering = pd.merge_asof(right, left, on="at", by="doc")
        pa_, pb = covered["a"].to_numpy(), covered["b"].to_numpy()
        qa, qb = covering["a"].to_numpy(), covering["b"].to_numpy()
        new = left["at"].to_numpy()[qa] != right["at"].to_numpy()[qb]  # equal starts are in both directions
        self.over_a, self.over_b = np.concatenate([pa_, qa[new]]), np.concatenate([pb, qb[new]])
        closing = end_a[self.over_a] == end_b[self.over_b]
        self.last_a, self.last_b = np.sort(self.over_a[closing]), np.sort(self.over_b[closing])
        self.group_a = np.searchsorted(self.last_a, np.arange(len(a)))
        self.group_b = np.searchsorted(self.last_b, np.arange(len(b)))
        self.doc = doc_a[self.last_a]  # of each group
        self.count_a = np.diff(self.last_a, prepend=-1)
        self.count_b = np.diff(self.last_b, prepend=-1)
        self.first_a, self.first_b = self.last_a + 1 - self.count_a, self.last_b + 1 - self.count_b

    def pairs(self, nb: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document, id pair (A's id times ``nb`` and B's) and number of its links; sorted, each pair once a document."""
        product = self.count_a * self.count_b
        small = product <= PLAIN_GROUP
        own = np.flatnonzero(small[self.group_a])
        g = self.group_a[own]
        each = self.count_b[g]
        at = np.repeat(np.arange(len(own)), each)
        b = self.first_b[g][at] + np.arange(len(at)) - np.repeat(np.cumsum(each) - each, each)
        doc, pair, times = [self.doc_a[own][at]], [self.a[own][at] * nb + self.b[b]], [np.ones(len(at), np.int64)]
        for k in np.flatnonzero(~small).tolist():  # repeated ids of a large group count once, with their product
            x, n = np.unique(self.a[self.first_a[k] : self.last_a[k] + 1], return_counts=True)
            y, m = np.unique(self.b[self.first_b[k] : self.last_b[k] + 1], return_counts=True)
            doc.append(np.full(len(x) * len(y), self.doc[k]))
            pair.append((x[:, None] * nb + y).ravel())
            times.append(np.outer(n, m).ravel())
        doc, pair, times = map(np.concatenate, (doc, pair, times))
        if not len(pair):
            return doc, pair, times
        most = int(pair.max()) + 1
        if (int(doc.max()) + 1) * most < 1 << 62:
            key = doc * most + pair
            if len(key) == int(product[small].sum()) == int(product.sum()):
                key.sort()
                heads = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
                return key[heads] // most, key[heads] % most, np.diff(np.append(heads, len(key)))
            order = np.argsort(key, kind="stable")
        else:
            order = np.lexsort((pair, doc))
        doc, pair, times = doc[order], pair[order], times[order]
        heads = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (pair[1:] != pair[:-1])))
        return doc[heads], pair[heads], np.add.reduceat(times, heads)

    def told(self, s: Sides) -> tuple[np.ndarray, np.ndarray]:
        """Groups as places in ``Sides.told``: A's ids of a group, then B's; and the document of each place."""
        out, doc = np.empty(len(self.a) + len(self.b), np.int64), np.empty(len(self.a) + len(self.b), np.int64)
        last_a, last_b = np.zeros(len(self.a), np.int64), np.zeros(len(self.b), np.int64)
        last_a[self.last_a] = last_b[self.last_b] = 1
        place_a = np.arange(len(self.a)) + self.first_b[self.group_a]
        place_b = np.arange(len(self.b)) + self.last_a[self.group_b] + 1
        out[place_a], out[place_b] = 2 * self.a + last_a, s.base + 2 * self.b + last_b
        doc[place_a], doc[place_b] = self.doc_a, self.doc_b
        return out, doc


COLUMNS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>"
NAMES = [c.split()[0] for c in COLUMNS.split(", ")]


def aligned_chunk(doc_ids: pa.Array, texts: list[str | None], s: Sides) -> pa.RecordBatch:
    """One row per text, in order."""
    full = [k for k, t in enumerate(texts) if t]
    n = len(texts)
    counts = {c: np.zeros(n, np.int64) for c in ("n_a", "n_b", "n_groups", "n_links")}
    digest, pairs, times, bounds = [""] * n, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(n + 1, np.int64)
    if full:
        spaced = [" " + texts[k] for k in full]
        raw = [t.encode() for t in spaced]
        data, edges = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])])
        a, bound_a = flat(s.encoded(spaced))
        b, bound_b = flat(s.pieces.encode([texts[k] for k in full], num_threads=1))
        sound = equal_bytes(s.a, a, bound_a, data, edges) & equal_bytes(s.b, b, bound_b, data, edges)
        rows = np.array(full)
        doc_a, doc_b = np.repeat(rows, np.diff(bound_a)), np.repeat(rows, np.diff(bound_b))
        if not sound.all():
            keep_a, keep_b = np.repeat(sound, np.diff(bound_a)), np.repeat(sound, np.diff(bound_b))
            a, doc_a, b, doc_b = a[keep_a], doc_a[keep_a], b[keep_b], doc_b[keep_b]
        if len(a):
            both = Aligned(a, b, doc_a, doc_b, s.a.lengths[a], s.b.lengths[b])
            counts["n_a"], counts["n_b"] = np.bincount(doc_a, minlength=n), np.bincount(doc_b, minlength=n)
            counts["n_groups"] = np.bincount(both.doc, minlength=n)
            np.add.at(counts["n_links"], both.doc, both.count_a * both.count_b)
            owner, pairs, times = both.pairs(s.nb)
            bounds = np.searchsorted(owner, np.arange(n + 1))
            places, at = both.told(s)
            cuts = np.searchsorted(at, np.arange(n + 1)).tolist()
            for k in rows[sound].tolist():
                line = "".join(map(s.told.__getitem__, places[cuts[k] : cuts[k + 1]].tolist()))
                digest[k] = hashlib.sha256(line[:-1].encode()).hexdigest()
    lists = [pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(v, pa.int64())) for v in (pairs, times)]
    return pa.RecordBatch.from_arrays([doc_ids.cast(pa.int64()), *(pa.array(counts[c], pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")), pa.array(digest), *lists], NAMES)


def aligned_batches(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    s = sides(names)
    for batch in batches:
        texts, low = batch.column("text").to_pylist(), 0
        while low < len(texts):
            high, weight = low, 0
            while high < len(texts) and (high == low or weight + len(texts[high] or "") <= CHUNK):
                weight += len(texts[high] or "")
                high += 1
            yield aligned_chunk(batch.column("doc_id").slice(low, high - low), texts[low:high], s)
            low = high


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many of the task's documents hold each pair, a bounded number of pairs at a time."""
    held, weight = [], 0

    def told() -> pa.RecordBatch:
        pair, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(pair), pa.array(n.astype(np.int64))], ["pair", "n"])

    for batch in batches:
        held.append(batch.column("pairs").flatten().to_numpy())
        weight += len(held[-1])
        if weight >= COUNTED:
            yield told()
            held, weight = [], 0
    if weight:
        yield told()


def pair_counts(documents: DataFrame, nb: int) -> DataFrame:
    """``pair``, ``n`` (documents that hold it) and ``best``: the highest of its first id, ties included.

    The highest counts are one row per id of the first vocabulary, so they are broadcast.
    """
    parts = mapped(documents.select("pairs"), counted, "pair long, n long")
    counts = stored(parts.groupBy("pair").agg(F.sum("n").alias("n")), "pairs")
    a = F.floor(F.col("pair") / F.lit(nb))
    top = counts.groupBy(a.alias("a")).agg(F.max("n").alias("most"))
    return counts.withColumn("a", a).join(F.broadcast(top), "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def summed(batches: Iterator[pa.RecordBatch], known: tuple[np.ndarray, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Adds ``n_best`` and ``count_sum``; ``known`` are pairs in order, and twice their counts, plus one if best."""
    pair, value = known
    for batch in batches:
        lists = batch.column("pairs")
        edges = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
        found = value[np.searchsorted(pair, lists.flatten().to_numpy())]
        times = batch.column("times").flatten().to_numpy()
        total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[edges])
        own = [batch.column(c) for c in SHOWN]
        yield pa.RecordBatch.from_arrays([*own, pa.array(total(times * (found & 1))), pa.array(total(times * (found >> 1)))], [*SHOWN, "n_best", "count_sum"])


SHOWN = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
SCORED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"


def scored(documents: DataFrame, counts: DataFrame, held: int) -> DataFrame:
    """Documents with the sums over their links: by a look-up in every task, or by a join where counts are too many."""
    n = counts.count()
    if n <= held:
        table = counts.select("pair", (F.col("n") * 2 + F.col("best").cast("int")).alias("v")).toArrow()
        pair, value = table.column("pair").to_numpy(), table.column("v").to_numpy()
        order = np.argsort(pair)
        known = documents.sparkSession.sparkContext.broadcast((pair[order], value[order]))
        return mapped(documents.drop("row"), lambda b: summed(b, known.value), SCORED)
    links = documents.select("row", F.inline(F.arrays_zip("pairs", "times"))).withColumnRenamed("pairs", "pair")
    sums = links.join(counts, "pair").groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    return documents.join(sums, "row", "left").select(*SHOWN, *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_best", "count_sum")])


def aligned(documents: DataFrame, first: str = "byte_bpe_50k.json", second: str = "piece_bpe_32k.model", held: int | None = None, signs: str = SIGNS) -> DataFrame:
    """Numbers of tokens, groups and links of every document, and how common its linked id pairs are."""
    small_batches(documents.sparkSession)
    rows = mapped(documents.select("doc_id", "text"), lambda b: aligned_batches(b, (first, second, signs)), COLUMNS)
    kept = stored(rows.withColumn("row", F.monotonically_increasing_id()), "aligned")
    return scored(kept, pair_counts(kept, sides((first, second, signs)).nb), HELD if held is None else held)
