"""Similarity join of word-n-gram sets by prefix trees.

1. Each task makes the n-gram sets of its texts and sends the n-grams of a block of texts,
   sorted, in slices to the owners of ranges of n-gram hashes. Owners count and answer only
   for n-grams that occur twice or more. An n-gram of one text alone can be in no
   intersection, so what comes back is enough to compute every intersection exactly.
2. N-grams are ordered by (count, hash), rare ones first. Two sets that link share one of
   the first ``n - ceil(t n) + 1`` of each. A text whose unshared n-grams fill that prefix
   links with nothing and is done; all others are sets of shared n-grams, one per class of
   equal sets.
3. Sets meet in buckets of prefix n-grams. A bucket puts them into a trie and lets each
   set walk it: overlaps of a common path are counted once, and a subtree is left when the
   overlap so far and what remains cannot reach the need, or when all of it is already
   connected with the set. A bucket reports links that connect, not all pairs.
4. Sets that share buckets, directly or through others, form a group. A group of bounded
   size is one trie, so that each set travels once. In a larger group every set visits two
   buckets first. What this connects needs no more comparing: later only buckets that still
   hold several components are opened.

A bucket with very many sets is split. In the first visit some of its sets are placed
into all of its parts; in the second, its largest component is cut into parts and the
other sets visit each, or all parts meet in pairs. So no task holds a whole hot bucket,
and each pair of sets that might link has been connected or compared.

Defined results: null and empty texts have an empty set and link with nothing. Equal sets
are one class. Rows that share a ``doc_id`` count as linked; a null ``doc_id`` links with
nothing. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callglass.llm.components import connected, stored
from callglass.llm.words import MASK, Words, chunks, mapped, scrambled, small_batches, whole_groups, windows

#: Bytes of text in a block, texts of a task whose copies are known, places of an n-gram in a block that travel with it.
CHUNK, REMEMBERED, FEW = 2_000_000, 200_000, 32
#: Sets in a bucket before it is split, and about how many of them go into all parts. A set of many n-grams counts as one for each ``USUAL``.
BUCKET, SHARED, USUAL = 2_048, 64, 1_000
#: Bytes of an n-gram's hash, of its place in a block, and of its count, as they travel.
GRAM, PLACE, COUNT = 6, 3, 4
#: Bytes of slices that an owner takes at once.
HELD = 4_000_000
MEMBER, META, SLICE, HOT_COUNT, HOT_PLACES, SHARED_GRAMS, HOT_SHARED, SET = range(8)
FIELDS = [("kind", pa.int8()), ("part", pa.int32()), ("block", pa.int64()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary()), ("doc_id", pa.int64()), ("n", pa.int32()), ("d1", pa.int64()), ("d2", pa.int64())]
ARROW = pa.schema(FIELDS)
ROWS = "kind byte, part int, block long, a binary, b binary, c binary, doc_id long, n int, d1 long, d2 long"


def rows_of(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[]] * len(FIELDS)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, FIELDS)], schema=ARROW)


def packed(values: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of each value, byte by byte of all values, which compresses well when they are sorted."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def unpacked(data: bytes, width: int) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.reshape(-1).view("<u8")


def needed(total: int, t: tuple[int, int]) -> int:
    """Least intersection of two sets with ``total`` n-grams together."""
    return -(-t[0] * total // (t[0] + t[1]))


def prefix(n: int, t: tuple[int, int]) -> int:
    return n - -(-t[0] * n // t[1]) + 1


def gram_sets(c: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams, sorted by hash, and the text of each."""
    owner, at = c.runs(size)
    grams, owners = [scrambled(windows(c.hashes, size)[at]) if len(at) else np.zeros(0, np.uint64)], [owner]
    for k in range(1, size):  # shorter texts are one sequence
        short = np.flatnonzero(c.counts == k)
        if len(short):
            grams.append(scrambled(windows(c.hashes, k)[c.first[short]], k))
            owners.append(short)
    h, o = np.concatenate(grams), np.concatenate(owners)
    order = np.argsort(h, kind="stable") if len(owners) == 1 else np.lexsort((o, h))
    h, o = h[order], o[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    return h[keep], o[keep]


def slices(batches: Iterator[pa.RecordBatch], size: int, parts: int) -> Iterator[pa.RecordBatch]:
    """Step 1 in the task that has the texts."""
    seen, serial = set(), TaskContext.get().partitionId() << 32
    width = (1 << 8 * GRAM) // parts + 1
    edges = np.array([k * width for k in range(1, parts)], np.uint64)
    for batch, c in chunks(batches, lower=True, most=CHUNK):
        own = batch.column("doc_id").to_pylist()
        h, o = gram_sets(c, size)
        serial += 1
        n = np.bincount(o, minlength=len(own))
        d1, d2 = np.zeros(len(own), np.uint64), np.zeros(len(own), np.uint64)
        np.add.at(d1, o, scrambled(h, 2))
        np.add.at(d2, o, scrambled(h, 3))
        d1, d2 = d1.view(np.int64), d2.view(np.int64)
        rows, sent = [], np.zeros(len(own), bool)
        for k, (doc, count, x, y) in enumerate(zip(own, n.tolist(), d1.tolist(), d2.tolist())):
            rows.append((MEMBER, hash((serial, k)) % parts, serial + k, None, None, None, doc, count, x, y))
            both = (x & MASK) << 64 | y & MASK
            if doc is not None and count and both not in seen:
                if len(seen) >= REMEMBERED:
                    seen.clear()
                seen.add(both)
                sent[k] = True
        rows.append((META, serial % parts, serial, np.stack([d1, d2], 1).tobytes(), n.astype(np.uint32).tobytes(), None, None, None, None, None))
        keep = sent[o]
        h, o = h[keep] >> np.uint64(64 - 8 * GRAM), o[keep]
        if len(h):
            heads = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
            times = np.diff(np.append(heads, len(h)))
            often = np.repeat(times > FEW, times)
            cuts = [0, *np.searchsorted(h, edges).tolist(), len(h)]
            for part in range(parts):
                x, y = cuts[part], cuts[part + 1]
                if x < y:
                    few = ~often[x:y]
                    if few.any():
                        rows.append((SLICE, part, serial, packed(h[x:y][few], GRAM), None, packed(o[x:y][few], PLACE), None, None, None, None))
                    hot = heads[(heads >= x) & (heads < y)]
                    hot = hot[often[hot]]
                    if len(hot):
                        count = packed(times[np.searchsorted(heads, hot)], COUNT)
                        rows.append((HOT_COUNT, part, serial, packed(h[hot], GRAM), count, None, None, None, None, None))
            if often.any():
                rows.append((HOT_PLACES, serial % parts, serial, packed(h[often], GRAM), None, packed(o[often], PLACE), None, None, None, None))
        yield rows_of(rows)


def owners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 1 at the owner of a range: answers for n-grams that occur twice or more; other rows pass."""
    for block in whole_groups(batches, "part", HELD):
        kind = block.column("kind").to_numpy()
        passing = np.isin(kind, (MEMBER, META, HOT_PLACES))
        yield from block.filter(pa.array(passing)).to_batches()
        grams, weights, places, serials = [], [], [], []
        rest = block.filter(pa.array(~passing)).select(["kind", "block", "a", "b", "c"])
        for k, serial, a, b, c in zip(*(rest.column(x).to_pylist() for x in rest.column_names)):
            h = unpacked(a, GRAM)
            grams.append(h)
            serials.append(np.full(len(h), serial))
            weights.append(unpacked(b, COUNT) if k == HOT_COUNT else np.ones(len(h), np.uint64))
            places.append(unpacked(c, PLACE).astype(np.int64) if k == SLICE else np.full(len(h), -1))
        if not grams:
            continue
        h, w, p, s = map(np.concatenate, (grams, weights, places, serials))
        order = np.argsort(h, kind="stable")
        heads = np.flatnonzero(np.append(True, h[order][1:] != h[order][:-1]))
        total = np.add.reduceat(w[order].astype(np.int64), heads)
        count = np.empty(len(h), np.int64)
        count[order] = np.repeat(total, np.diff(np.append(heads, len(h))))
        keep = np.flatnonzero(count > 1)
        keep = keep[np.lexsort((h[keep], s[keep]))]
        rows = []
        ends = np.flatnonzero(np.append(s[keep][1:] != s[keep][:-1], True)) + 1 if len(keep) else []
        low = 0
        for high in ends:
            pick = keep[low:high]
            serial, low = int(s[pick[0]]), high
            for hot in (False, True):
                q = pick[(p[pick] < 0) == hot]
                if len(q):
                    some = packed(np.minimum(count[q], (1 << 8 * COUNT) - 1), COUNT)
                    rows.append((HOT_SHARED if hot else SHARED_GRAMS, 0, serial, packed(h[q], GRAM), some, None if hot else packed(p[q], PLACE), None, None, None, None))
        if rows:
            yield rows_of(rows)


def shared_sets(batches: Iterator[pa.RecordBatch], t: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    """Step 2: for each text that may link, its shared n-grams in order. Membership passes."""
    for block in whole_groups(batches, "block", HELD):
        kind = block.column("kind").to_numpy()
        yield from block.filter(pa.array(kind == MEMBER)).to_batches()
        rest = block.filter(pa.array(kind != MEMBER)).select(["kind", "block", "a", "b", "c"])
        by: dict[int, list[tuple]] = {}
        for row in zip(*(rest.column(x).to_pylist() for x in rest.column_names)):
            by.setdefault(row[1], []).append(row)
        for rows in by.values():
            yield from block_sets(rows, t)


def block_sets(rows: list[tuple], t: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    grams, counts, owner = ([np.zeros(0, np.uint64)] for _ in range(3))
    meta, hot, hot_counts, hot_places = None, [], [], None
    for kind, _, a, b, c in rows:
        if kind == META:
            meta = (np.frombuffer(a, np.int64).reshape(-1, 2), np.frombuffer(b, np.uint32).astype(np.int64))
        elif kind == SHARED_GRAMS:
            grams.append(unpacked(a, GRAM))
            counts.append(unpacked(b, COUNT))
            owner.append(unpacked(c, PLACE))
        elif kind == HOT_SHARED:
            hot.append(unpacked(a, GRAM))
            hot_counts.append(unpacked(b, COUNT))
        else:
            hot_places = (unpacked(a, GRAM), unpacked(c, PLACE))
    if hot_places is not None:
        h, k = np.concatenate(hot), np.concatenate(hot_counts)
        order = np.argsort(h)
        grams.append(hot_places[0])
        counts.append(k[order][np.searchsorted(h[order], hot_places[0])])
        owner.append(hot_places[1])
    h, k, o = map(np.concatenate, (grams, counts, owner))
    order = np.lexsort((h, k, o))
    h, k, o = h[order], k[order], o[order]
    digest, n = meta
    first = np.searchsorted(o, np.arange(len(n) + 1))
    out = []
    for doc in np.unique(o).tolist():
        x, y, size = first[doc], first[doc + 1], int(n[doc])
        if size - (y - x) < prefix(size, t):
            out.append((SET, 0, 0, packed(h[x:y], GRAM), None, None, None, size, int(digest[doc, 0]), int(digest[doc, 1])))
    if out:
        yield rows_of(out)


def prefixes(batches: Iterator[pa.RecordBatch], t: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    """A row for each shared n-gram in the prefix of a set.

    If it is the first n-gram that two sets share, all before it in either are missing in
    the other. The sets can link only if what they can spare adds up to 0 or more:
    ``spare`` is n (1 - t) - place (1 + t), in whole numbers.
    """
    for batch in batches:
        grams, rows, places, spare = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for k, (n, a) in enumerate(zip(batch.column("n").to_pylist(), batch.column("a").to_pylist())):
            h = unpacked(a, GRAM).view(np.int64)
            use = h[: prefix(n, t) - (n - len(h))]
            grams.append(use)
            rows.append(np.full(len(use), k))
            places.append(np.arange(n - len(h), n - len(h) + len(use), dtype=np.int32))
            spare.append(n * (t[1] - t[0]) - places[-1].astype(np.int64) * (t[1] + t[0]))
        row = pa.array(np.concatenate(rows))
        yield pa.RecordBatch.from_arrays([
            pa.array(np.concatenate(grams)), pa.array(np.concatenate(places)), pa.array(np.concatenate(spare)), batch.column("n").take(row), batch.column("d1").take(row), batch.column("d2").take(row),
        ], ["gram", "place", "spare", "n", "d1", "d2"])


class Node:
    __slots__ = ("edge", "children", "low", "high", "rest", "members", "same")

    def __init__(self, edge: list[int], n: int) -> None:
        self.edge, self.children, self.low, self.high, self.rest, self.members, self.same = edge, {}, n, n, 0, [], None


class Trie:
    """Sets in global order; ``join`` walks it with a set and yields the sets that this newly connects with it."""

    def __init__(self, t: tuple[int, int]) -> None:
        self.t, self.root, self.up = t, Node([], 0), {}

    def top(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def add(self, key: int, n: int, grams: list[int]) -> None:
        node, at = self.root, 0
        node.low, node.high = min(node.low or n, n), max(node.high, n)
        while at < len(grams):
            child = node.children.get(grams[at])
            if child is None:
                child = node.children[grams[at]] = Node(grams[at:], n)
                child.same = key
                node, at = child, len(grams)
                break
            edge, k = child.edge, 1
            while k < len(edge) and at + k < len(grams) and edge[k] == grams[at + k]:
                k += 1
            if k < len(edge):  # split the edge
                mid = Node(edge[:k], child.low)
                mid.high, mid.rest, mid.same = child.high, child.rest + len(edge) - k, child.same
                child.edge = edge[k:]
                mid.children[edge[k]] = child
                node.children[grams[at]] = child = mid
            at += k
            child.low, child.high, child.rest = min(child.low, n), max(child.high, n), max(child.rest, len(grams) - at)
            if child.same is not None and self.top(child.same) != self.top(key):
                child.same = None
            node = child
        node.members.append((key, n))

    def join(self, key: int, n: int, grams: list[int]) -> Iterator[int]:
        own, (num, den) = {g: i for i, g in enumerate(grams, 1)}, self.t
        stack = [(c, 0, 0) for c in self.root.children.values()]
        while stack:
            node, overlap, last = stack.pop()
            if node is None:  # all below has been seen: it may be one component by now
                node = overlap
                tops = {None if c.same is None else self.top(c.same) for c in node.children.values()} | {self.top(m) for m, _ in node.members}
                if len(tops) == 1:
                    node.same = tops.pop()
                continue
            if node.same is not None and self.top(node.same) == self.top(key):
                continue
            if node.high * den < num * n or n * den < num * node.low:
                continue
            need, edge, rest = needed(n + max(node.low, -(-num * n // den)), self.t), node.edge, node.rest
            for k in range(0, len(edge), 32):
                piece = edge[k : k + 32]
                met = [own[g] for g in piece if g in own]
                if met:  # both are in one order: what follows in the tree matches only what follows here
                    overlap, last = overlap + len(met), met[-1]
                if overlap + min(len(edge) - k - len(piece) + rest, len(grams) - last) < need:
                    break
            else:
                for other, m in node.members:
                    if overlap >= needed(n + m, self.t) and self.top(other) != self.top(key):
                        self.up[self.top(other)] = self.top(key)
                        yield other
                if node.children:
                    if node.same is None:
                        stack.append((None, node, 0))
                    stack += [(c, overlap, last) for c in node.children.values()]


def bucket_links(rows: list[tuple], t: tuple[int, int]) -> Iterator[tuple[int, int]]:
    """Links that connect the sets (rep, n, component, n-grams) of one bucket."""
    if len({r[2] for r in rows}) < 2:
        return
    trie, first = Trie(t), {}
    for rep, _, component, _ in rows:
        trie.up[rep] = first.setdefault(component, rep)
    for rep, n, _, a in sorted(rows, key=lambda r: (r[1], r[0])):
        grams = unpacked(a, GRAM).tolist()
        for other in trie.join(rep, n, grams):
            yield rep, other
        trie.add(rep, n, grams)


def bucket_joins(batches: Iterator[pa.RecordBatch], t: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    """Step 3 over rows sorted by (gram, piece)."""
    held, key, out = {}, None, []

    def links() -> None:
        out.extend(bucket_links(list(held.values()), t))
        held.clear()

    for batch in batches:
        for gram, piece, *row in zip(*(batch.column(x).to_pylist() for x in ("gram", "piece", "rep", "n", "component", "a"))):
            if key != (gram, piece):
                links()
                key = (gram, piece)
            held[row[0]] = tuple(row)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], ["a", "b"])
            out.clear()
    links()
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], ["a", "b"])


def met(visits: DataFrame, sets: DataFrame, t: tuple[int, int]) -> DataFrame:
    """Links found in the buckets (gram, piece) that sets visit; ``component`` tells what is connected already."""
    rows = visits.join(sets, ["d1", "d2"]).select("gram", "piece", "rep", "n", "component", "a").repartition("gram", "piece").sortWithinPartitions("gram", "piece")
    return mapped(rows, lambda b: bucket_joins(b, t), "a long, b long")


def spread(column: str = "rep") -> Column:
    return F.xxhash64(column)


def weight() -> Column:
    """How many sets a group of rows counts as."""
    return F.sum(F.greatest(F.lit(1), F.ceil(F.col("n") / USUAL)))


def signed(visitors: DataFrame) -> DataFrame:
    """For each bucket of (``gram``, ``rep``): how many sets visit it, and a fingerprint of which."""
    mark = F.xxhash64("rep")
    return visitors.groupBy("gram").agg(weight().alias("m"), F.struct(F.count(F.lit(1)), F.bit_xor(mark), F.sum(F.shiftright(mark, 16))).alias("who"))


def first_visits(shared: DataFrame) -> DataFrame:
    """The two shared n-grams of each set that most sets share."""
    sized = shared.join(shared.groupBy("gram").agg((-F.count(F.lit(1))).alias("less")), "gram")
    two = sized.groupBy("rep", "d1", "d2", "n").agg(F.slice(F.sort_array(F.collect_list(F.struct("less", "place", "gram"))), 1, 2).alias("two"))
    visits = two.select("rep", "d1", "d2", "n", F.explode("two").alias("v")).select("rep", "d1", "d2", "n", F.col("v.gram").alias("gram"))
    return visits.join(signed(visits), "gram")


def placed(visits: DataFrame) -> DataFrame:
    """A large bucket in parts, with some of its sets in all of them."""
    pieces = F.ceil(F.col("m") / BUCKET)
    everywhere = F.pmod(F.xxhash64("rep", F.lit(1)), F.ceil(F.col("m") / SHARED)) == 0
    to = F.when((pieces > 1) & everywhere, F.sequence(F.lit(0).cast("long"), pieces - 1)).otherwise(F.array(F.pmod(spread(), pieces)))
    return visits.select("rep", "d1", "d2", "gram", F.explode(to).alias("piece"), F.col("rep").alias("component"))


def open_visits(shared: DataFrame, components: DataFrame, done: DataFrame) -> DataFrame:
    """Visits to buckets that still hold several components.

    Buckets with the same visitors need one visit, and none if such a one was compared
    whole before (``done``: who, m).
    """
    at = shared.join(components.withColumnsRenamed({"node": "rep"}), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    by = at.groupBy("gram", "component").agg(weight().alias("k"))
    sizes = by.groupBy("gram").agg(F.max("k").alias("most"), F.max_by("component", F.struct("k", "component")).alias("largest"), F.count(F.lit(1)).alias("components"))
    once = sizes.where("components > 1").join(signed(shared), "gram").groupBy("who").agg(F.min("gram").alias("gram"), *(F.first(c).alias(c) for c in ("m", "most", "largest")))
    still = once.join(done.where(F.col("m") <= BUCKET).select("who").distinct(), "who", "left_anti").drop("who")
    rows = at.join(still, "gram")
    pieces, own = F.ceil(F.col("m") / BUCKET), F.pmod(spread(), F.ceil(F.col("m") / BUCKET))
    every = F.sequence(F.lit(0).cast("long"), pieces - 1)
    pairs = F.transform(every, lambda j: F.least(own, j) * pieces + F.greatest(own, j))
    to = F.when(pieces <= 1, F.array(F.lit(0).cast("long"))).when(
        F.col("m") - F.col("most") <= BUCKET, F.when(F.col("component") == F.col("largest"), F.array(own)).otherwise(every)
    ).otherwise(pairs)
    return rows.select("rep", "d1", "d2", "gram", F.explode(to).alias("piece"), "component")


def joined(documents: DataFrame, size: int = 5, similarity: tuple[int, int] = (4, 5)) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` of each document: word ``size``-grams, Jaccard at least ``similarity``."""
    spark, t = documents.sparkSession, similarity
    small_batches(spark)
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    sent = mapped(documents.select("doc_id", "text"), lambda b: slices(b, size, parts), ROWS)
    counted = mapped(sent.repartition("part").sortWithinPartitions("part"), owners, ROWS)
    found = mapped(counted.repartition("block").sortWithinPartitions("block"), lambda b: shared_sets(b, t), ROWS)
    found = stored(found.select("kind", "doc_id", "n", "d1", "d2", "a"), "gram-sets")
    members = found.where(F.col("kind") == MEMBER).select("doc_id", "n", "d1", "d2")
    classes = members.where("doc_id is not null and n > 0").groupBy("d1", "d2").agg(F.min("doc_id").alias("least_id"))
    classes = stored(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")  # ids may be shared, numbers are not
    sets = found.where(F.col("kind") == SET).select("d1", "d2", "n", "a")
    grams = mapped(sets, lambda b: prefixes(b, t), "gram long, place int, spare long, n int, d1 long, d2 long").distinct()
    several = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("m"), F.max("spare").alias("most")).where("m > 1").select("gram", "most")
    able = stored(grams.join(several, "gram").where("spare + most >= 0").select("gram", "place", "n", "d1", "d2").join(classes.drop("least_id"), ["d1", "d2"]), "prefixes")
    shared = stored(able.join(able.groupBy("gram").agg(F.count(F.lit(1)).alias("m"), F.min("rep").alias("least")).where("m > 1").drop("m"), "gram"), "shared")
    groups = connected(shared.select(F.col("rep").alias("a"), F.col("least").alias("b"))).withColumnsRenamed({"node": "rep", "component": "group"})
    members_of = shared.select("rep", "n", "d1", "d2").distinct().join(groups, "rep")
    grouped = stored(members_of.join(members_of.groupBy("group").agg(weight().alias("m")), "group"), "groups")
    once = grouped.where(F.col("m") <= BUCKET).select("rep", "d1", "d2", F.col("group").alias("gram"), F.lit(0).cast("long").alias("piece"), F.col("rep").alias("component"))
    links = stored(met(once, sets, t), "near").union(ids_in_several_classes(members, classes))
    large = grouped.where(F.col("m") > BUCKET).select("rep")
    if large.limit(1).count():
        shared = stored(shared.drop("least").join(large, "rep"), "shared")
        visits = stored(first_visits(shared), "visits")
        near = stored(met(placed(visits), sets, t), "near")
        more = stored(met(open_visits(shared, connected(near), visits.select("who", "m").distinct()), sets, t), "near")
        links = links.union(near).union(more)
    whole = stored(connected(links).select(F.col("node").alias("rep"), "component").join(classes.select("rep", "least_id"), "rep"), "components")
    least = whole.groupBy("component").agg(F.min("least_id").alias("first_id"))
    whole = whole.join(least, "component").select("rep", "first_id")
    labels = classes.join(whole, "rep", "left").select("d1", "d2", F.coalesce("first_id", "least_id").alias("component"))
    out = members.join(labels, ["d1", "d2"], "left")
    alone = F.col("doc_id").isNull() | (F.col("n") == 0)
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(alone, F.col("doc_id")).otherwise(F.col("component")).alias("component_id"))


def ids_in_several_classes(members: DataFrame, classes: DataFrame) -> DataFrame:
    """Rows of one ``doc_id`` with different sets link their classes, each with the id's least."""
    own = members.where("doc_id is not null and n > 0").join(classes.drop("least_id"), ["d1", "d2"]).select("doc_id", "rep").distinct()
    least = own.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("most")).where("a <> most").drop("most")
    return own.join(least, "doc_id").where("a <> rep").select("a", F.col("rep").alias("b"))


def first_of_each(documents: DataFrame, size: int = 5, similarity: tuple[int, int] = (4, 5)) -> DataFrame:
    """The documents without those that link, directly or not, with one of smaller ``doc_id``."""
    found = joined(documents, size, similarity)
    leaders = found.where(F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id"))).select(F.col("doc_id").alias("__leader")).distinct()
    kept = documents.join(leaders, F.col("doc_id").eqNullSafe(F.col("__leader")), "left_semi")
    first = Window.partitionBy("doc_id").orderBy(F.xxhash64(*[c for c in kept.columns if c != "doc_id"]))
    once = kept.where("doc_id is not null").withColumn("__copy", F.row_number().over(first)).where("__copy = 1").drop("__copy")
    return once.unionByName(kept.where("doc_id is null"))
