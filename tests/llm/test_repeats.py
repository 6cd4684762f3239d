import hashlib
import random
from collections import Counter

import pytest
from tables import documents

from callglass.llm import repeats


def plain(texts, size):
    found = [(t or "").encode().split() for t in texts]
    starts = Counter(tuple(w[i : i + size]) for w in found for i in range(len(w) - size + 1))
    out = []
    for w in found:
        stay = [True] * len(w)
        for i in range(len(w) - size + 1):
            if starts[tuple(w[i : i + size])] > 1:
                stay[i : i + size] = [False] * size
        kept = b" ".join(x for x, s in zip(w, stay) if s)
        out.append((len(w), stay.count(False), hashlib.sha256(kept).hexdigest()))
    return out


def check(spark, texts, size=35):
    got = repeats.without_repeats(documents(spark, texts), size).collect()
    assert len(got) == len(texts)
    want = plain(texts, size)
    for r in got:
        assert (r["n_words"], r["n_removed"], r["kept_sha256"]) == want[r["doc_id"]], r["doc_id"]
        if not r["n_removed"]:
            assert r["kept_text"] == texts[r["doc_id"]]
    return got


def made(seed, n=60, vocabulary=40):
    rng = random.Random(seed)
    words = [f"w{i}é" for i in range(vocabulary)]
    passages = [[rng.choice(words) for _ in range(rng.randint(30, 70))] for _ in range(6)]
    texts = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randint(0, 4)):
            parts += rng.choice(passages) if rng.random() < 0.4 else [rng.choice(words) for _ in range(rng.randint(0, 90))]
        texts.append("\n\t ".join(parts))
    return texts + texts[:10]


@pytest.mark.parametrize("split", [5_000, 3])
def test_against_counting_all_windows(spark, monkeypatch, split):
    monkeypatch.setattr(repeats, "SPLIT_ABOVE", split)
    got = check(spark, made(split))
    assert any(r["n_removed"] for r in got) and any(not r["n_removed"] for r in got)


def test_edges(spark):
    run = " ".join(map(str, range(35)))
    check(spark, [None, "", " \n", "a", run, run, " ".join(["a"] * 35), " ".join(["a"] * 36), "b " * 5_000, " ".join(map(str, range(34))), run.replace(" ", " ")])
    check(spark, [])


def test_rows_with_the_same_id(spark):
    run = " ".join(map(str, range(40)))
    rows = [(7, run, 1), (7, run, 1), (7, "other", 2), (None, run + " z", 3)]
    got = repeats.without_repeats(spark.createDataFrame(rows, "doc_id long, text string, start int"), 35).collect()
    assert sorted((r["n_words"], r["n_removed"]) for r in got) == [(1, 0), (40, 40), (40, 40), (41, 40)]


def test_whole_given_table(spark):
    given = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()
    check(spark, [r["text"] for r in given])


def test_two_windows_with_one_fingerprint_are_told_apart(monkeypatch):
    import numpy as np

    monkeypatch.setattr(repeats, "windows", lambda values, size: np.zeros(max(0, len(values) - size + 1), np.uint64))
    row, at = repeats.repeated_in_packs([b"a b c", b"a b d", b"a b c"], np.ones(3, np.int64), 3)
    assert row.tolist() == [0, 2] and at.tolist() == [0, 0]


def test_equal_rows_keep_their_spans_once(spark):
    run = " ".join(map(str, range(60)))
    sizes = []
    for copies in (50, 400):
        df = spark.createDataFrame([(None, run)] * copies + [(1, run + " end")], "doc_id long, text string")
        sizes.append({r["__id"]: r["n"] for r in repeats.spans_of_texts(df, 35).selectExpr("__id", "size(__spans) n").collect()})
        got = repeats.without_repeats(df, 35)
        assert got.count() == copies + 1 and {r["n_removed"] for r in got.select("n_removed").distinct().collect()} == {60}
    assert sizes[0] == sizes[1] and sizes[0].keys() == {None, 1}
