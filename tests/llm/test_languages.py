import zlib

import numpy as np
from tables import DOCUMENTS, documents

from callglass.llm import languages


def test_held_out_accuracy_and_columns(spark):
    given = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lang = {r["doc_id"]: r["lang"] for r in given.collect()}
    rows = languages.identified(given).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(lang)
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["lang_pred"] == r["languages"][0] for r in rows if r["languages"])
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in held]) > 0.95


ENGLISH, GERMAN = "the quick brown fox jumps over the lazy dog and the cat ", "der schnelle braune fuchs springt über den faulen hund und die katze "


def learning(spark, extra):
    rows = [(i, (ENGLISH, GERMAN)[i % 2] * 3, ("en", "de")[i % 2], "s", 0) for i in range(40)]
    return spark.createDataFrame(rows + [(1000 + i, t, None, "s", 0) for i, t in enumerate(extra)], DOCUMENTS)


def test_mixtures_and_edges(spark):
    texts = [None, "", "123 !?", ENGLISH, GERMAN * 2_000, ENGLISH * 20 + GERMAN * 20, ENGLISH * 30 + GERMAN * 5, "x", "中文字"]
    got = {r["doc_id"] - 1000: r for r in languages.identified(learning(spark, texts)).collect() if r["doc_id"] >= 1000}
    assert [got[i]["lang_pred"] for i in range(3)] == ["und"] * 3 and got[0]["score"] == 0
    assert got[3]["lang_pred"] == "en" and got[3]["languages"] == ["en"] and got[3]["score"] == 1
    assert got[4]["lang_pred"] == "de"
    assert set(got[5]["languages"]) == {"en", "de"} and 0.3 < got[5]["score"] < 0.75
    assert got[6]["languages"] == ["en", "de"] and got[6]["score"] > 0.7
    assert got[8]["lang_pred"] in ("en", "de")


LANGUAGES = {
    "en": ENGLISH, "de": GERMAN, "fr": "le vif renard brun saute par dessus le chien paresseux et la souris dort ", "es": "el veloz zorro marrón salta sobre el perro perezoso y los gatos duermen ",
    "fi": "nopea ruskea kettu hyppää laiskan koiran yli ja kissa nukkuu ", "pl": "szybki brązowy lis przeskakuje nad leniwym psem i śpiącym kotem ",
}


def test_a_text_in_six_languages_names_all_and_stays(spark):
    rows = [(i * 6 + k, t * 3, l, "s", 0) for i in range(20) for k, (l, t) in enumerate(LANGUAGES.items())]
    df = spark.createDataFrame([*rows, (1000, "".join(t * 10 for t in LANGUAGES.values()), None, "s", 0), (1001, LANGUAGES["pl"] * 5, None, "s", 0)], DOCUMENTS)
    got = {r["doc_id"]: r for r in languages.identified(df).where("doc_id >= 1000").collect()}
    assert set(got[1000]["languages"]) == set(LANGUAGES) and got[1000]["score"] < 0.34
    assert got[1001]["languages"] == ["pl"]
    assert languages.recognised(df).count() == df.count()


def test_chosen_sets_equal_trying_each_size():
    """The chosen set against fitting one text at a time, in plain loops."""
    rng = np.random.default_rng(5)
    logs = np.log(rng.dirichlet(np.full(1 << languages.BITS, 0.02), 5).T + 1e-9)
    for used in (1, 2, 3, 5):
        own = [int(rng.choice(1 << languages.BITS, p=np.exp(logs[:, k]) / np.exp(logs[:, k]).sum())) for k in range(used) for _ in range(60)]
        _, shares = languages.mixtures(np.zeros(len(own), np.int64), np.array(own), logs)
        likely = np.exp(logs[own] - logs[own].max(1, keepdims=True)) + 1e-12

        def fit(start, rounds, likely=likely):
            for _ in range(rounds):
                part = likely * start
                start = (part / part.sum(1, keepdims=True)).mean(0)
            return start, np.log((likely * start).sum(1)).sum()

        whole, _ = fit(np.full(5, 0.2), languages.ROUNDS)
        order, best, score = np.argsort(-whole, kind="stable"), None, -np.inf
        for k in range(1, 6):
            start = np.where(np.isin(np.arange(5), order[:k]), np.maximum(whole, 1e-6), 0)
            share, value = fit(start / start.sum(), 1 if k == 1 else languages.ROUNDS // 2)
            value = languages.WEIGHT * value - (k - 1) * 0.5 * np.log(len(own))
            if value <= score + 1e-9:
                break
            best, score = share, value
        assert np.allclose(shares[0], best, atol=1e-9) and (shares[0] > 0).sum() == used


def test_nothing_to_learn_and_empty(spark):
    df = spark.createDataFrame([(1, "word", None, "s", 1)], DOCUMENTS)
    assert [r["lang_pred"] for r in languages.identified(df).collect()] == ["und"]
    assert languages.identified(df.limit(0)).count() == 0
    more = df.union(spark.createDataFrame([(2, "12", None, "s", 1), (3, None, None, "s", 1)], DOCUMENTS))
    assert [r["doc_id"] for r in languages.recognised(more).collect()] == [1]


def test_labels_of_the_held_out_part_are_not_used(spark):
    rows = [(i, ENGLISH if i % 2 else GERMAN, "en" if i % 2 else "de", "s", 0) for i in range(60)]
    wrong = [(i, t, "xx" if zlib.crc32(str(i).encode()) % 4 == 2 else l, s, n) for i, t, l, s, n in rows]
    a, b = (sorted(map(str, languages.identified(spark.createDataFrame(r, DOCUMENTS)).collect())) for r in (rows, wrong))
    assert a == b


def test_rejection_keeps_columns_and_clean_rows(spark):
    df = learning(spark, [None, "12", ENGLISH]).withColumn("languages", languages.F.lit(1))
    kept = languages.recognised(df)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == [*range(40), 1002]


def test_shares_maximise_the_likelihood():
    rng = np.random.default_rng(0)
    likely, count = rng.random((50, 2)) + 0.01, rng.integers(1, 9, 50).astype(float)
    share, fit = languages.fitted(likely, count, np.array([0]), np.zeros(50, int), np.array([[0.5, 0.5]]), 400)
    grid = [(np.log(likely @ [p, 1 - p]) * count).sum() for p in np.linspace(0.001, 0.999, 999)]
    assert fit[0] >= max(grid) - 1e-3


def test_rejection_judges_each_row_by_its_text(spark):
    extra = spark.createDataFrame([(i, t, None, "s", 0) for i in (None, 2000) for t in (None, "12", ENGLISH, ENGLISH)], DOCUMENTS)
    kept = languages.recognised(learning(spark, []).union(extra)).where("lang is null").collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept) == [(0, ENGLISH)] * 2 + [(2000, ENGLISH)] * 2
