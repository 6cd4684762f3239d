import re

import pytest
import sentencepiece
import test_jaccard
import test_repeats
import test_tiling

import corpus_pipeline
from callglass.llm import languages, pieces, tiling

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    return tuple(spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "benchmark"))


def kept_text(texts):
    """Each text without the words under windows of 35 words that occur twice."""
    from collections import Counter

    found = [t.encode().split() for t in texts]
    starts = Counter(tuple(w[i : i + 35]) for w in found for i in range(len(w) - 34))
    out = []
    for t, w in zip(texts, found):
        stay = [True] * len(w)
        for i in range(len(w) - 34):
            if starts[tuple(w[i : i + 35])] > 1:
                stay[i : i + 35] = [False] * 35
        out.append(t if all(stay) else b" ".join(x for x, s in zip(w, stay) if s).decode())
    return out


def test_stages_equal_a_plain_version(spark, tables):
    docs, items = tables
    languages_of = {r["doc_id"]: r for r in languages.identified(docs).collect()}
    rows = [r for r in docs.orderBy("doc_id").collect() if languages_of[r["doc_id"]]["lang_pred"] != "und"]
    ids, texts = [r["doc_id"] for r in rows], [r["text"] for r in rows]
    keep = [i for i, _, root in test_jaccard.plain(texts, 5, (4, 5)) if i == root]
    ids, texts = [ids[i] for i in keep], [texts[i] for i in keep]
    texts = kept_text(texts)
    tests = [r["text"] for r in items.collect()]
    grams = lambda w: {tuple(w[i : i + tiling.SEED]) for i in range(len(w) - tiling.SEED + 1)}
    item_grams = [grams(test_tiling.words(t)) for t in tests]
    clean = []
    for i, t in zip(ids, texts):
        own = grams(test_tiling.words(t))
        covered = [test_tiling.plain(t, x) for x, g in zip(tests, item_grams) if own & g]
        if not any(c and c >= 0.5 * n for n, _, c in covered):
            clean.append((i, t))
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.vocabulary_file())
    want = sorted((i, library.encode(t)) for i, t in clean)
    got = sorted((r["doc_id"], r["ids"]) for r in corpus_pipeline.run(spark, FOLDER).collect())
    assert got == want and 0 < len(want) < docs.count()


def test_stages_keep_the_columns(spark, tables):
    docs = tables[0].limit(30).withColumn("note", languages.F.lit("x"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, FOLDER).columns == docs.columns
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), FOLDER).count() == 0


def test_cut_changes_only_texts_with_repeats(spark):
    run = " ".join(map(str, range(35)))
    df = spark.createDataFrame([(1, run + " end", 9), (2, run, 9), (3, "a  b", 4), (4, None, None)], "doc_id long, text string, n_chars long")
    got = {r["doc_id"]: tuple(r) for r in corpus_pipeline.repeated_passages(spark, df, FOLDER).collect()}
    assert got == {1: (1, "end", 3), 2: (2, "", 0), 3: (3, "a  b", 4), 4: (4, None, None)}


def test_names():
    assert [len(s) for s in corpus_pipeline.STAGES] == [2] * 5 and all(re.match(r"\w", n) for n, _ in corpus_pipeline.STAGES)
    assert test_repeats.plain(["a"], 35)[0][:2] == (1, 0)
