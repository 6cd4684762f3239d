import random
import re

import pytest
from tables import documents

from callglass.llm import tiling


def words(text):
    return re.findall("[\u0e00-\u0e7f\u3005-\u3007\u3020-\u9fff\U00020000-\U0003ffff]|(?:[0-9a-z]|[^\\x00-\x7f\u0e00-\u0e7f\u3000-\u9fff\uff01-\uff0f\uff1a-\uff1f\U00020000-\U0003ffff])+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(doc, item):
    """Words covered by greedy string tiling, by trying all places."""
    a, b = words(item), words(doc)
    used_a, used_b, covered, n = set(), set(), 0, 0
    while True:
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                k = 0
                while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k] and i + k not in used_a and j + k not in used_b:
                    k += 1
                if k > best[0]:
                    best = (k, i, j)
        k, i, j = best
        if k < min(tiling.SEED, max(tiling.LEAST_ITEM, len(a))):
            return (len(a), n, covered) if a else (0, 0, 0)
        used_a |= set(range(i, i + k))
        used_b |= set(range(j, j + k))
        covered, n = covered + k, n + 1


def made(seed):
    rng = random.Random(seed)
    word = [f"w{i}é" for i in range(60)]
    items = [" ".join(rng.choice(word) for _ in range(rng.randint(3, 30))) for _ in range(8)]
    texts = []
    for _ in range(40):
        parts = [" ".join(rng.choice(word) for _ in range(rng.randint(0, 30)))]
        if rng.random() < 0.7:
            w = rng.choice(items).split()
            k = rng.randrange(len(w))
            parts += rng.choice([[" ".join(w)], [" ".join(w[k:]), "--", " ".join(w[:k])], [" ".join(w[:k])]])
        parts.append(" ".join(rng.choice(word) for _ in range(rng.randint(0, 30))))
        texts.append(", ".join(parts).replace("w1", "W1"))
    return texts, items


@pytest.mark.parametrize("sent", [200_000, 0])
def test_against_trying_all_places(spark, monkeypatch, sent):
    monkeypatch.setattr(tiling, "SENT_ITEMS", sent)
    texts, items = made(3)
    texts += [None, "", "a b"]
    items += [None, "", "one two", "a b", "w3é w4é", "three Short words", "exactly four short words", "我们今天一起去北京大学。", "สวัสดี"]
    texts += ["and three, short words.", "exactly four short", "Exactly: four SHORT words", "昨天他说，我们今天一起去北京大学看书", "我们昨天", "abc我们今天一起去、北京大学def", "สวัสดีครับ"]
    tests = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["item_words"], r["tiles"], r["covered"]) for r in tiling.contaminated(documents(spark, texts), tests, 0.5).collect()}
    want = {}
    for d, t in enumerate(texts):
        for i, x in enumerate(items):
            n, k, covered = plain(t, x)
            if n and covered and covered >= 0.5 * n:
                want[d, i] = (n, k, covered)
    assert got.keys() == want.keys() and len({i for _, i in want if i >= 8}) == 4 and len(want) > 10
    # Between matches of one length any may be marked first.
    assert sum(got[k] == want[k] for k in want) >= 0.9 * len(want)


def test_moved_parts_case_and_punctuation_are_caught(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    moved = "Theta, iota! kappa LAMBDA mu... zeta eta -- xx alpha beta gamma delta epsilon"
    tests = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = tiling.contaminated(documents(spark, [moved, item.replace("delta", "x").replace("kappa", "y"), "alpha beta gamma delta"]), tests, 0.5).collect()
    assert [(r["doc_id"], r["tiles"], r["covered"]) for r in got] == [(0, 2, 10)]


def test_clean_keeps_the_rest_with_all_columns(spark):
    item = "alpha beta gamma delta epsilon zeta"
    tests = spark.createDataFrame([(1, item, 5)], "item_id long, text string, doc_id int")
    df = documents(spark, ["x " + item, "other", None])
    kept = tiling.clean(df, tests)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 2]
    assert tiling.clean(df.limit(0), tests).count() == 0 and tiling.clean(df, tests.limit(0)).count() == 3


def test_null_and_repeated_ids(spark):
    item = "alpha beta gamma delta epsilon zeta"
    tests = spark.createDataFrame([(None, item)], "item_id long, text string")
    rows = spark.createDataFrame([(None, item), (1, item), (1, item), (1, "z")], "doc_id long, text string")
    got = tiling.contaminated(rows, tests).collect()
    assert sorted(r["doc_id"] or -1 for r in got) == [-1, 1, 1] and {r["item_id"] for r in got} == {None}


@pytest.mark.parametrize("sent", [200_000, 0])
def test_clean_judges_each_row_by_its_text(spark, monkeypatch, sent):
    monkeypatch.setattr(tiling, "SENT_ITEMS", sent)
    item = "alpha beta gamma delta epsilon zeta"
    tests = spark.createDataFrame([(1, item)], "item_id long, text string")
    rows = spark.createDataFrame([(None, "x " + item), (None, "clean"), (None, None), (1, item), (1, "clean"), (1, "clean")], "doc_id long, text string")
    assert sorted(map(str, tiling.clean(rows, tests).collect())) == sorted(map(str, rows.collect()[1:3] + rows.collect()[4:]))
