"""Language identification by mixtures.

Learning counts hashed letter trigrams per language over all texts of the learning part.
For a text, expectation-maximisation estimates the share of each language from the
likelihoods of its trigrams. Sets of the largest one, two, ... languages are fitted, and a
set grows as long as the likelihood less a penalty for each language does. The answer is the
language with the largest share in that set, and the share is the score.

Defined results: a null text and a text without a letter are ``und`` with score 0. If
nothing can be learned, all are ``und``. Between equal shares the first name wins. A null
``doc_id`` is not in the learning part and counts as held out. Repeated rows count as often
as they stand. Only ``doc_id``, ``text`` and, for learning, ``lang`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callglass.llm.words import NO_LETTER, mapped, small_batches

#: Bits of a trigram's hash, added counts per trigram, rounds of estimation.
BITS, ADDED, ROUNDS = 16, 0.5, 12
#: Trigrams of a text overlap, so its likelihood counts this part; each further language costs half the logarithm of the count.
WEIGHT = 1 / 3
#: Bytes of text handled at once.
CHUNK = 1_000_000
FOLD = np.arange(256, dtype=np.uint32)
FOLD[NO_LETTER] = 0x20
FOLD[ord("0") : ord("9") + 1] = 0x20


def held_out() -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(True))


def trigrams(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First and last row, text and hash of each trigram. Words have one blank on either side."""
    data = column.cast(pa.large_binary()).fill_null(b"")
    if not len(data):
        return
    offsets = np.frombuffer(data.buffers()[1], np.int64)[data.offset : data.offset + len(data) + 1]
    raw = np.frombuffer(data.buffers()[2] or b"", np.uint8)
    low = 0
    while low < len(data):
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + CHUNK, "right")) - 1)
        letters = FOLD[raw[offsets[low] : offsets[high]]]
        padded = np.full(len(letters) + 2 * (high - low) + 2, 0x20, np.uint32)
        owner = np.repeat(np.arange(high - low), np.diff(offsets[low : high + 1]))
        at = np.arange(len(letters)) + 2 * owner + 1
        padded[at] = letters
        gram = padded[:-2] << 16 | padded[1:-1] << 8 | padded[2:]
        own = np.repeat(np.arange(high - low), np.diff(offsets[low : high + 1]) + 2)[: len(gram)]
        blank = padded == 0x20
        use = (blank[:-2].astype(np.int8) + blank[1:-1] + blank[2:]) < 2
        use &= ~blank[1:-1]
        gram, own = gram[use], own[use]
        yield low, high, own, (gram * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
        low = high


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trigram counts per language of a task's texts."""
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = batch.column("lang").to_pylist()
        for low, high, own, gram in trigrams(batch.column("text")):
            names = sorted(set(langs[low:high]))
            number = np.array([names.index(x) for x in langs[low:high]])
            counts = np.bincount(number[own] * (1 << BITS) + gram, minlength=len(names) << BITS).reshape(len(names), -1)
            for name, c in zip(names, counts):
                total[name] = total.get(name, 0) + c
    for name, c in total.items():
        have = np.flatnonzero(c)
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(have), pa.string()), pa.array(have), pa.array(c[have])], ["lang", "gram", "n"])


def learned(documents: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and, per trigram, the logarithm of its probability in each."""
    rows = documents.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.lower("text").alias("text"), "lang")
    found = mapped(rows, counted, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).collect()
    names = sorted({r["lang"] for r in found})
    table = np.full((1 << BITS, len(names)), ADDED)
    place = {n: i for i, n in enumerate(names)}
    for r in found:
        table[r["gram"], place[r["lang"]]] += r["n"]
    return names, np.log(table / table.sum(0)) if names else table


def fitted(likely: np.ndarray, count: np.ndarray, first: np.ndarray, doc: np.ndarray, share: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Shares and log-likelihood per text after some rounds; languages with share 0 stay out."""
    total = np.add.reduceat(count, first)[:, None]
    for _ in range(rounds):
        part = likely * share[doc]
        part *= (count / part.sum(1))[:, None]
        share = np.add.reduceat(part, first, axis=0) / total
    return share, np.add.reduceat(count * np.log((likely * share[doc]).sum(1)), first)


def mixtures(own: np.ndarray, gram: np.ndarray, logs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts that have trigrams, and the shares of languages in the chosen set."""
    keys, count = np.unique(own * (1 << BITS) + gram, return_counts=True)
    doc, gram = keys >> BITS, keys & ((1 << BITS) - 1)
    first = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
    texts, doc, count = doc[first], np.cumsum(np.append(0, doc[1:] != doc[:-1])), count.astype(float)
    rows = logs[gram]
    top = rows.max(1, keepdims=True)
    likely = np.exp(rows - top)  # the same factor for all languages of a trigram changes no comparison
    likely += 1e-12
    total = np.add.reduceat(count, first)
    everything, _ = fitted(likely, count, first, doc, np.full((len(texts), logs.shape[1]), 1 / logs.shape[1]), ROUNDS)
    order = np.argsort(-everything, axis=1, kind="stable")
    best, score, growing = np.zeros_like(everything), np.full(len(texts), -np.inf), np.ones(len(texts), bool)
    for k in range(1, logs.shape[1] + 1):
        start = np.zeros_like(everything)
        np.put_along_axis(start, order[:, :k], np.maximum(np.take_along_axis(everything, order[:, :k], 1), 1e-6), 1)
        start /= start.sum(1, keepdims=True)
        share, fit = fitted(likely, count, first, doc, start, 1 if k == 1 else ROUNDS // 2)
        value = WEIGHT * fit - (k - 1) * 0.5 * np.log(np.maximum(total, 2))
        growing &= value > score + 1e-9
        if not growing.any():
            break
        best[growing], score[growing] = share[growing], value[growing]
    return texts, best


def answers(text: pa.Array, lettered: np.ndarray, names: list[str], logs: np.ndarray) -> tuple[list[str], np.ndarray, list[list[str]]]:
    """Language, score and chosen set of each text."""
    langs, scores, sets = ["und"] * len(text), np.zeros(len(text)), [[] for _ in range(len(text))]
    for low, _, own, gram in trigrams(text) if names else ():
        if not len(own):
            continue
        texts, shares = mixtures(own, gram.astype(np.int64), logs)
        for t, s in zip((texts + low).tolist(), shares):
            if lettered[t]:
                k = int(s.argmax())
                langs[t], scores[t] = names[k], min(1.0, float(s[k]))
                sets[t] = [names[i] for i in np.argsort(-s, kind="stable") if s[i] > 0]
    for t in np.flatnonzero(lettered & (scores == 0)) if names else ():  # letters of no known trigram: nothing speaks for any language
        langs[t], scores[t], sets[t] = names[0], 1 / len(names), names
    return langs, scores, sets


def predicted(batches: Iterator[pa.RecordBatch], names: list[str], logs: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs, scores, sets = answers(batch.column("text"), batch.column("lettered").to_numpy(zero_copy_only=False), names, logs)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("held_out"), pa.array(langs, pa.string()), pa.array(scores), pa.array(sets, pa.list_(pa.string()))],
            ["doc_id", "held_out", "lang_pred", "score", "languages"],
        )


def led(batches: Iterator[pa.RecordBatch], names: list[str], logs: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The rows whose own text is in some language; if no language is known, those with a letter."""
    for batch in batches:
        lettered = batch.column("__lettered").to_numpy(zero_copy_only=False)
        langs, _, _ = answers(batch.column("__lower"), lettered, names, logs)
        keep = np.array(langs, object) != "und" if names else lettered
        yield batch.drop_columns(["__lower", "__lettered"]).filter(pa.array(keep, pa.bool_()))


def lettered() -> Column:
    return F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))


def model(documents: DataFrame) -> Broadcast:
    small_batches(documents.sparkSession)
    return documents.sparkSession.sparkContext.broadcast(learned(documents))


def identified(documents: DataFrame) -> DataFrame:
    """``doc_id``, ``held_out``, ``lang_pred``, ``score`` and ``languages`` (the chosen set) of every document."""
    sent = model(documents)
    rows = documents.select("doc_id", held_out().alias("held_out"), F.lower("text").alias("text"), lettered().alias("lettered"))
    return mapped(rows, lambda b: predicted(b, *sent.value), "doc_id long, held_out boolean, lang_pred string, score double, languages array<string>")


def recognised(documents: DataFrame) -> DataFrame:
    """The documents without those in no language (``und``). Each row is judged by its own text, whatever its ``doc_id``."""
    sent = model(documents)
    return mapped(documents.select("*", F.lower("text").alias("__lower"), lettered().alias("__lettered")), lambda b: led(b, *sent.value), documents.schema)
