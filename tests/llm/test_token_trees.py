import random

import numpy as np
import pytest
from tables import documents

from callglass.llm import token_trees

NAME = "byte_bpe_50k.tiktoken"


@pytest.fixture(scope="module")
def count():
    return token_trees.counter(NAME)


def test_counts_equal_the_library(count):
    for t in ["", "it's  a test \n\n x", "déjà vu 漢字 12345 'll", " " * 30, "<|endoftext|>"]:
        assert int(count.cut(t)[1].sum()) == len(count.encoding.encode_ordinary(t))


def test_random_edits_equal_counting_anew(count):
    rng = random.Random(5)
    bits = ["the ", " a", "'s", "\n", "  ", "x", "12", "!", "é", "tion", "   \t", "漢"]
    for _ in range(150):
        text = "".join(rng.choice(bits) for _ in range(rng.choice([0, 3, 40, 600])))
        tree = token_trees.Tree.of(*count.cut(text))
        for _ in range(12):
            a = rng.randint(0, len(text))
            b = min(len(text), a + rng.choice([0, 1, 3, 90]))
            text, tree, _ = token_trees.edit(tree, text, a, b, "".join(rng.choice(bits) for _ in range(rng.choice([0, 1, 4]))), count)
            lengths, counts = count.cut(text)
            own = [np.concatenate([np.zeros(0, np.uint32), *(x[i] for x in tree.blocks)]) for i in (0, 1)]
            assert own[0].tolist() == lengths.tolist() and own[1].tolist() == counts.tolist()
            assert tree.tokens == counts.sum() and tree.characters == len(text)


def test_only_the_neighbourhood_is_counted_anew(count):
    text = "some plain words in a row " * 2_000
    tree = token_trees.Tree.of(*count.cut(text))
    assert token_trees.edit(tree, text, 20_000, 20_004, "other", count)[2] < 8


def test_given_documents(spark, count):
    given = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in given.collect()}
    rows = token_trees.scrubbed_counts(given).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts) and any(r["n_edits"] for r in rows)
    put = lambda m: "<address>" if m["address"] else "<number>" if m["number"] else m.group()[0]
    for r in rows:
        t = texts[r["doc_id"]]
        assert r["n_tokens_before"] == len(count.encoding.encode_ordinary(t))
        assert r["n_tokens_after"] == len(count.encoding.encode_ordinary(token_trees.SCRUBBED.sub(put, t)))


def test_stored_trees_and_edits(spark, count, tmp_path):
    df = documents(spark, ["one two three", None, "", "four", "x" * 100_000 + " end"])
    token_trees.trees(df).write.parquet(str(tmp_path / "trees"))
    stored = spark.read.parquet(str(tmp_path / "trees"))
    edits = spark.createDataFrame([(0, 4, 7, "2"), (0, 0, 3, None), (0, 5, 6, "overlaps"), (1, 0, 0, "new"), (3, 90, 95, " more"), (4, 5, 100_000, "")], "doc_id long, start int, stop int, put string")
    got = {r["doc_id"]: r for r in token_trees.apply_edits(stored, edits).collect()}
    assert {i: got[i]["text"] for i in range(5)} == {0: " toverlapso three", 1: "new", 2: "", 3: "four more", 4: "xxxxx end"}
    assert all(r["n_tokens"] == len(count.encoding.encode_ordinary(r["text"] or "")) for r in got.values())
    assert token_trees.scrubbed_counts(df.limit(0)).count() == 0
    twice = spark.createDataFrame([(1, "a 12345", 3), (1, "a 12345", 3), (None, "b", 3)], "doc_id long, text string, n_tokens int")
    assert sorted((r["n_edits"]) for r in token_trees.scrubbed_counts(twice).collect()) == [0, 1, 1]


def test_segments_add_up_and_are_cut_once(monkeypatch):
    count = token_trees.Counter("byte_bpe_50k.tiktoken")
    rng = random.Random(4)
    bits = ["the", "word", " ", "  ", "\n", "\t", "\r\n", "don't", "'s", "é", "漢", "12", "12345", "a@b.co", "!!", "!!!", "\xa0", "\x0b", "\x1c", "\u2028", "\u200b", "\u3000", "-"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.choice([0, 1, 3, 40]))) for _ in range(3000)]
    for limit in (600_000, 5):
        monkeypatch.setattr(token_trees, "SEGMENTS", limit)
        for t in texts:
            want = len(count.pattern.findall(t)), len(count.encoding.encode_ordinary(t)), bool(token_trees.places_to_scrub(t))
            assert count.totals(t) == want, repr(t)
    calls, plain = [], count.pattern
    monkeypatch.setattr(token_trees, "SEGMENTS", 600_000)
    count.segments.clear()
    count.totals("some words of a text")
    count.pattern = type("Watched", (), {"findall": lambda self, s: calls.append(s) or plain.findall(s)})()
    assert count.totals("some words of a text of words")[:2] == (7, len(count.encoding.encode_ordinary("some words of a text of words")))
    assert calls == []
