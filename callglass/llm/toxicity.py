"""Toxicity scores by a factorization machine over hashed terms.

Terms are a text's lower-cased words and their first four bytes, hashed. How often each term
stands in texts of either label is counted over all labelled texts of the learning part, and
the ``TERMS`` terms that tell the labels apart best (chi-squared) make up the model. A
factorization machine, with a weight per term and an interaction of each pair of terms
through short factor vectors, is fitted to at most ``SAMPLE`` texts of each label, the ones
with the least hash of ``doc_id``; their weights restore the true share of the labels.
Every text is scored whole, in one pass.

Defined results: null and empty texts get the score of a text without terms. A null
``doc_id`` is not learnt from and counts as held out. Labels that are null are not used; a
repeated label counts again. Without labels of both kinds every score is the share of label
1 (0 without any). Only ``doc_id``, ``text`` and ``toxic`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callglass.llm.words import BYTE_BASE, NO_LETTER, STEP, Words, chunks, hashes_of, mapped, scrambled, small_batches
from callglass.session import broadcast_if_small

#: Bits of a term's hash, terms in the model, least texts with a term, least chi-squared, texts of each label that are fitted.
BITS, TERMS, LEAST, APART, SAMPLE = 28, 4_096, 4, 20.0, 20_000
#: Bytes of the second kind of term.
HEAD = 4
#: Factors per term, rounds over the sample, rows in a step, step size, weight of the penalty.
FACTORS, ROUNDS, STEP_ROWS, RATE, PENALTY = 4, 12, 256, 0.05, 1e-4


def held_out() -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, F.lit(True))


def terms(c: Words) -> tuple[np.ndarray, np.ndarray]:
    """Text and term, distinct and sorted."""
    owner = np.repeat(np.arange(len(c.counts)), c.counts)
    long = np.flatnonzero(c.ends - c.starts > HEAD)
    heads, low = np.zeros(len(long), np.uint64), 0
    while low < len(long):
        zero = c.starts[long[low]]
        high = max(low + 1, int(np.searchsorted(c.starts[long], zero + STEP)))
        own = c.starts[long[low:high]] - zero
        heads[low:high] = hashes_of(c.data[zero : zero + own[-1] + HEAD], own, own + HEAD, BYTE_BASE)
        low = high
    hashed = np.concatenate([c.hashes, scrambled(heads, 5)]) >> np.uint64(64 - BITS)
    keys = np.unique(np.concatenate([owner, owner[long]]).astype(np.uint64) << np.uint64(BITS) | hashed)
    return (keys >> np.uint64(BITS)).astype(np.int64), (keys & np.uint64((1 << BITS) - 1)).astype(np.int64)


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, c in chunks(batches, space=NO_LETTER):
        owner, term = terms(c)
        toxic = batch.column("toxic").to_numpy()[owner] == 1
        kinds, place = np.unique(term, return_inverse=True)
        one = np.bincount(place, toxic, minlength=len(kinds)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(one), pa.array(np.bincount(place, minlength=len(kinds)) - one)], ["term", "ones", "zeros"])


def chosen(batches: Iterator[pa.RecordBatch], vocabulary: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Numbers of the model's terms in each text."""
    for batch, c in chunks(batches, space=NO_LETTER):
        owner, term = terms(c)
        at = np.minimum(np.searchsorted(vocabulary, term), len(vocabulary) - 1)
        keep = vocabulary[at] == term
        ends = np.cumsum(np.bincount(owner[keep], minlength=batch.num_rows))
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(at[keep].astype(np.int32)))
        yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in batch.schema.names if x != "text"), lists], [*(x for x in batch.schema.names if x != "text"), "terms"])


class Machine:
    """Logistic factorization machine over sets of term numbers."""

    def __init__(self, terms: int, bias: float = 0.0) -> None:
        rng = np.random.default_rng(7)
        self.bias, self.weight, self.factor = bias, np.zeros(terms), rng.normal(0, 0.01, (terms, FACTORS))

    def raw(self, flat: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Score before the logistic function, and sums of factors, for each of ``n`` texts."""
        v = self.factor[flat]
        sums, squares = np.zeros((n, FACTORS)), np.zeros((n, FACTORS))
        np.add.at(sums, owner, v)
        np.add.at(squares, owner, v * v)
        return self.bias + np.bincount(owner, self.weight[flat], minlength=n) + 0.5 * (sums * sums - squares).sum(1), sums

    def score(self, flat: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(flat, owner, n)[0], -30, 30)))

    def fit(self, rows: list[list[int]], label: np.ndarray, importance: np.ndarray) -> None:
        """Adaptive gradient steps; the order of rows is fixed."""
        rng = np.random.default_rng(11)
        seen_w, seen_v, seen_b = np.full(len(self.weight), 1e-6), np.full(self.factor.shape, 1e-6), 1e-6
        for _ in range(ROUNDS):
            order = rng.permutation(len(rows))
            for low in range(0, len(order), STEP_ROWS):
                pick = order[low : low + STEP_ROWS]
                own = [rows[i] for i in pick.tolist()]
                flat = np.fromiter((t for r in own for t in r), np.int64)
                owner = np.repeat(np.arange(len(own)), [len(r) for r in own])
                z, sums = self.raw(flat, owner, len(own))
                slope = importance[pick] * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - label[pick])
                of = slope[owner]
                dw, dv = np.bincount(flat, of, minlength=len(self.weight)).astype(float), np.zeros_like(self.factor)
                np.add.at(dv, flat, of[:, None] * (sums[owner] - self.factor[flat]))
                used = np.unique(flat)
                dw[used] += PENALTY * len(own) * self.weight[used]
                dv[used] += PENALTY * len(own) * self.factor[used]
                seen_w[used] += dw[used] ** 2
                seen_v[used] += dv[used] ** 2
                seen_b += slope.sum() ** 2
                self.weight[used] -= RATE * dw[used] / np.sqrt(seen_w[used])
                self.factor[used] -= RATE * dv[used] / np.sqrt(seen_v[used])
                self.bias -= RATE * slope.sum() / np.sqrt(seen_b)


def learned(documents: DataFrame, labels: DataFrame) -> tuple[np.ndarray, Machine]:
    """The model's terms, sorted, and the fitted machine."""
    known = labels.where("doc_id is not null and toxic in (0, 1)").select(F.col("doc_id").alias("__id"), "toxic").where(~held_out_of("__id"))
    rows = documents.select("doc_id", F.lower("text").alias("text")).join(broadcast_if_small(known), F.col("doc_id") == F.col("__id")).select("doc_id", "toxic", "text")
    share = known.agg(F.coalesce(F.sum("toxic"), F.lit(0)).alias("ones"), F.count(F.lit(1)).alias("n")).first()
    ones, zeros = share["ones"], share["n"] - share["ones"]
    if not ones or not zeros:
        return np.zeros(1, np.int64), Machine(1, -30.0 if not ones else 30.0)
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    counts = mapped(rows.select("toxic", "text"), counted, "term long, ones long, zeros long").groupBy("term").agg(F.sum("ones").alias("a"), F.sum("zeros").alias("b"))
    n = float(ones + zeros)
    apart = F.pow(a * (zeros - b) - b * (ones - a), 2) / ((a + b) * (n - a - b) + 1) * (n / ones / zeros)
    found = counts.where((F.col("a") + F.col("b") >= LEAST) & (apart >= APART)).orderBy(apart.desc(), "term").limit(TERMS).collect()
    vocabulary = np.array(sorted(r["term"] for r in found) or [-1], np.int64)
    sent = documents.sparkSession.sparkContext.broadcast(vocabulary)
    own = mapped(rows, lambda x: chosen(x, sent.value), "doc_id long, toxic int, terms array<int>")
    parts = [own.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("terms")).limit(SAMPLE).collect() for k in (0, 1)]
    sample = [r for p in parts for r in p]
    machine = Machine(len(vocabulary), float(np.log(ones / zeros)))
    if not parts[0] or not parts[1]:  # labels of one kind have no texts
        return vocabulary, machine
    label = np.array([r["toxic"] for r in sample], float)
    importance = np.where(label == 1, ones / max(1, len(parts[1])), zeros / max(1, len(parts[0])))
    machine.fit([list(r["terms"]) for r in sample], label, importance / importance.min())
    return vocabulary, machine


def held_out_of(column: str) -> Column:
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(5)) == 0


def scores(batches: Iterator[pa.RecordBatch], vocabulary: np.ndarray, machine: Machine) -> Iterator[pa.RecordBatch]:
    for batch in chosen(batches, vocabulary):
        lists = batch.column("terms")
        owner = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
        score = machine.score(lists.values.to_numpy(), owner, batch.num_rows)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"]
        )


def scored(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` of every document."""
    small_batches(documents.sparkSession)
    model = documents.sparkSession.sparkContext.broadcast(learned(documents, labels))
    rows = documents.select("doc_id", held_out().alias("held_out"), F.lower("text").alias("text"))
    return mapped(rows, lambda b: scores(b, *model.value), "doc_id long, held_out boolean, score double, predicted int")
