import functools
import random

import pytest
import sentencepiece
from tables import documents

from callglass.llm import pieces


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=pieces.vocabulary_file())


def odd_texts(seed=1):
    rng = random.Random(seed)
    letters = "abcdethenorition .,\n\té漢字Ⅷ▁"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 300))) for _ in range(40)]
    texts += [" " * n + "word" for n in (1, 2, 5, 40)] + ["a" * 500, "the" * 200, " " * 100, "=" * 77, "thetionationing" * 30, "▁▁x", "é", "x\x00y"]
    return texts


def test_short_texts_equal_the_library(library):
    own = pieces.model(pieces.vocabulary_file())
    for t in odd_texts():
        assert own.encode(t) == library.encode(t), t
        assert own.decode(library.encode(t)) == t.replace("▁", " ")


def in_chunks(own, text, size, margin=16):
    import pyarrow as pa

    rows = list(pieces.split(iter([pa.RecordBatch.from_pylist([{"doc_id": 1, "text_key": 1, "text": text}])]), margin, size))
    made = [b.to_pylist()[0] for b in rows]
    import numpy as np

    table = pa.table({"doc_id": [1] * len(made), "text_key": [1] * len(made), "no": [m["no"] for m in made], "matrix": [np.array(own.transfer(m["body"], m["low"], m["high"], m["no"] == 0), float).tobytes() for m in made]})
    out = []
    for m, s in zip(made, pieces.scanned(table).to_pylist()):
        out += own.trace(m["body"], m["low"], m["high"], (s["back"], s["over"]), (s["back2"], s["over2"]))
    return out


@pytest.mark.parametrize("size", [1, 3, 7, 20, 64])
def test_chunks_equal_the_library(library, size):
    own = pieces.model(pieces.vocabulary_file())
    for t in odd_texts(size):
        assert in_chunks(own, t, size) == library.encode(t), (size, t)


def test_scores_give_the_best_path():
    own = pieces.Pieces.__new__(pieces.Pieces)
    rng = random.Random(3)
    plain = {p: (i, -rng.random() * 5) for i, p in enumerate(["▁", "a", "b", "c", "ab", "bc", "abc", "ca", "▁a", "▁ab", "bca", "cab"])}
    own.setup(plain, {b: 100 + b for b in range(256)}, merging=False)

    def best(text):
        @functools.lru_cache(None)
        def go(at):
            if at == len(text):
                return 0.0
            return max(own.weight(None, text[at:k]) + go(k) for k in range(at + 1, len(text) + 1) if text[at:k] in plain or k == at + 1)

        return go(0)

    for _ in range(60):
        t = "".join(rng.choice("abcx ") for _ in range(rng.randint(1, 30)))
        want = best("▁" + t.replace(" ", "▁"))
        ids = {i: p for p, (i, _) in plain.items()}
        for got in (own.encode(t), *(in_chunks(own, t, s) for s in (1, 4, 9))):
            assert abs(sum(plain[ids[i]][1] if i in ids else own.least for i in got) - want) < 1e-9 or "x" in t


def test_documents(spark, library, monkeypatch):
    monkeypatch.setattr(pieces, "CHUNK", 400)
    given = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    texts = given + odd_texts() + [None, "", "no blank" * 2_000]
    got = {r["doc_id"]: r for r in pieces.encoded_documents(documents(spark, texts)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert got[i]["ids"] == (None if t is None else library.encode(t)), i
        assert got[i]["round_trip"]
    back = pieces.decode(pieces.encode(documents(spark, texts)))
    assert {r["doc_id"]: r["decoded"] for r in back.collect()} == {i: t if t is None else t.replace("▁", " ") for i, t in enumerate(texts)}


def test_edges(spark, monkeypatch):
    monkeypatch.setattr(pieces, "CHUNK", 5)
    rows = [(1, "same text here", 1), (1, "same text here", 1), (1, "other text here", 2), (None, "long enough", 3), (None, None, 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = pieces.encoded_documents(df).collect()
    assert len(got) == 5 and all(r["round_trip"] for r in got)
    assert pieces.encoded_documents(df.limit(0)).count() == 0


def test_models_with_longer_pieces(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(pieces, "CHUNK", 50)
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(36)) for _ in range(6)]
    lines = [" ".join(rng.choice(words) for _ in range(5)) for _ in range(200)]
    sentencepiece.SentencePieceTrainer.train(
        sentence_iterator=iter(lines), model_prefix=str(tmp_path / "long"), model_type="bpe", vocab_size=490, max_sentencepiece_length=40, byte_fallback=True,
        hard_vocab_limit=False, normalization_rule_name="identity", remove_extra_whitespaces=False, minloglevel=2,
    )
    file = str(tmp_path / "long.model")
    library, own = sentencepiece.SentencePieceProcessor(model_file=file), pieces.model(file)
    assert own.longest > 16
    texts = [" ".join(rng.choice(words)[rng.randint(0, 9) :] for _ in range(12)) for _ in range(30)] + lines[:20]
    got = {r["doc_id"]: r["ids"] for r in pieces.encode(documents(spark, texts), file).collect()}
    assert got == {i: library.encode(t) for i, t in enumerate(texts)}


def test_stretches_are_whole_and_remembered(library, monkeypatch):
    own = pieces.Pieces(pieces.vocabulary_file())
    texts = odd_texts(5) + ["co.\nCiónes, andenorer", "", "andenorer,", "co.\nCiónes", "w" * 70]
    spaced = [pieces.BLANK + t.replace(" ", pieces.BLANK) if t else "" for t in texts]
    found, first = own.stretches(spaced)
    for k, t in enumerate(spaced):
        mine = found[first[k] : first[k + 1]]
        assert "".join(mine) == t
        assert [i for s in mine for i in own.numbers(own.only_path(s))] == library.encode(texts[k])
    assert own.stretches(["▁co.\nCi"])[0] == ["▁co.", "\n", "Ci"]
    want = [i for t in texts for i in library.encode(t)]
    assert own.ids_of_texts(texts)[0].tolist() == want
    solve, calls = own.solve, []
    monkeypatch.setattr(own, "solve", lambda units: calls.extend(units) or solve(units))
    assert own.ids_of_texts(texts)[0].tolist() == want
    assert all(len(u) > pieces.WIDEST for u in calls) and len(own.solved) == len(own.at) == len(own.sizes)
    monkeypatch.setattr(pieces, "REMEMBERED", 3)
    for _ in range(2):
        assert own.ids_of_texts(texts + [None])[0].tolist() == want


def test_a_short_text_needs_one_worker(spark):
    """Encoding and checking in two Python steps of a stage would hold the model in two workers of a task."""
    df = pieces.encoded_documents(documents(spark, ["a b"]))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan.split("Union", 1)
    assert "MapInArrow" not in above
    assert "LogicalRDD" in below.split("MapInArrow")[1]
