import random
import re

import pytest
from tables import documents

from callglass.llm import components, jaccard_trie


def sets(texts, size):
    out = []
    for t in texts:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        out.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set()))
    return out


def plain(texts, size, t):
    found = sets(texts, size)
    top = list(range(len(texts)))

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for i, a in enumerate(found):
        for j, b in enumerate(found[:i]):
            if a and b and t[1] * len(a & b) >= t[0] * len(a | b):
                x, y = sorted((root(i), root(j)))
                top[y] = x
    return [(i, len(a), root(i)) for i, a in enumerate(found)]


def check(spark, texts, size=3, t=(9, 10)):
    got = jaccard_trie.joined(documents(spark, texts), size, t).collect()
    want = plain(texts, size, t)
    assert sorted(tuple(r) for r in got) == want
    return want


def made(seed, n=120):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    passage = [rng.choice(words) for _ in range(30)]
    bases = [[rng.choice(words) for _ in range(rng.randint(1, 120))] for _ in range(8)]
    texts = []
    for _ in range(n):
        text = list(rng.choice(bases)) if rng.random() < 0.8 else [rng.choice(words) for _ in range(rng.randint(1, 60))] + passage
        for _ in range(rng.choice([0, 0, 1, 2, 4, 8])):
            k = rng.randrange(len(text))
            text[k : k + rng.choice([0, 1])] = [rng.choice(words)]
        texts.append(" ".join(text).replace("w1", "W1"))
    return texts


@pytest.mark.parametrize(("size", "t", "bucket"), [(3, (9, 10), 2_048), (5, (4, 5), 2_048), (3, (9, 10), 4), (2, (1, 2), 3)])
def test_against_all_pairs(spark, monkeypatch, size, t, bucket):
    monkeypatch.setattr(jaccard_trie, "BUCKET", bucket)
    monkeypatch.setattr(jaccard_trie, "SHARED", 2)
    want = check(spark, made(bucket + size), size, t)
    assert len({c for _, _, c in want}) < len(want)


def test_edges(spark):
    check(spark, [None, "", " ", "a", "A", "a b", "a  b", "b a", "a b c", "a b c d", "x " * 3_000, "é ü", "É ü", "a b c"])
    check(spark, [])


def test_null_and_repeated_ids(spark):
    rows = [(None, "a b c d", 1), (3, "a b c d", 1), (3, "p q r s", 2), (9, "p q r s", 3), (9, "p q r s", 3)]
    got = jaccard_trie.joined(spark.createDataFrame(rows, "doc_id long, text string, n int"), 3, (9, 10)).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"] or -1) for r in got) == [(-1, -1), (3, 3), (3, 3), (9, 3), (9, 3)]


def test_whole_given_table(spark):
    given = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()
    check(spark, [r["text"] for r in given])


def test_one_document_of_each_group_stays(spark):
    df = documents(spark, ["a b c d e f", "a b c d e f", "A b c d e f", "z", None, None])
    assert sorted(r["doc_id"] for r in jaccard_trie.first_of_each(df).collect()) == [0, 3, 4, 5]


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 200)], "a long, b long")
    got = {r["node"]: r["component"] for r in components.connected(links).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 200: 100}


def test_rows_that_share_an_id_keep_their_links(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    rows = [(1, a), (1, b), (2, a + " more"), (3, b + " more")]
    for given in (rows, rows[::-1], [rows[1], rows[0], *rows[2:]]):
        df = documents(spark, []).unionByName(spark.createDataFrame(given, "doc_id long, text string"), allowMissingColumns=True)
        got = {(r["doc_id"], r["component_id"]) for r in jaccard_trie.joined(df, size=3, similarity=(9, 10)).collect()}
        assert got == {(1, 1), (2, 1), (3, 1)}
