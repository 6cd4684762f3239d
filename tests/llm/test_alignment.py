import hashlib
import random
from collections import Counter

import pytest
from tables import DOCUMENTS, documents

from callglass.llm import alignment, catalogue

NAMES = ("byte_bpe_50k.json", "piece_bpe_32k.model")


@pytest.fixture(scope="module")
def s():
    return alignment.sides(NAMES)


def tokens(text, s):
    """Ids and bytes of both sides by the libraries alone."""
    if not text:
        return None
    letters = alignment.byte_letters()
    a = s.library.encode(" " + text, add_special_tokens=False).ids
    b = s.pieces.encode(text)
    spelt_a = [bytes(letters[c] for c in s.library.id_to_token(i)) for i in a]
    spelt_b = [bytes([int(p[3:5], 16)]) if s.pieces.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, s.pieces.id_to_piece(i)) for i in b)]
    if not b"".join(spelt_a) == b"".join(spelt_b) == (" " + text).encode():
        return None
    return a, spelt_a, b, spelt_b


def groups(text, s):
    found = tokens(text, s)
    if found is None:
        return []
    a, spelt_a, b, spelt_b = found

    def ends(spelt):
        at, out = 0, []
        for x in spelt:
            at += len(x)
            out.append(at)
        return out

    end_a, end_b = ends(spelt_a), ends(spelt_b)
    common = set(end_a) & set(end_b)
    sides = []
    for ids, at in ((a, end_a), (b, end_b)):
        own = [[]]
        for i, e in zip(ids, at):
            own[-1].append(i)
            if e in common:
                own.append([])
        sides.append(own[:-1])
    return list(zip(*sides))


def plain(texts, s):
    linked = []
    for t in texts:
        c = Counter()
        for a, b in groups(t, s):
            c.update((x, y) for x in a for y in b)
        linked.append(c)
    count = Counter(p for c in linked for p in c)
    best = {}
    for (a, _), n in count.items():
        best[a] = max(n, best.get(a, 0))
    out = []
    for t, c in zip(texts, linked):
        g = groups(t, s)
        line = "|".join(",".join(map(str, a)) + ";" + ",".join(map(str, b)) for a, b in g)
        out.append((sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(c.values()),
                    sum(n for p, n in c.items() if count[p] == best[p[0]]), sum(n * count[p] for p, n in c.items()),
                    hashlib.sha256(line.encode()).hexdigest() if g else ""))
    return out


SHOWN = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
TEXTS = [
    "The quick brown fox", "the quick  brown\n\nfox", "", None, "a▁b", "<|endoftext|> and <s> </s>", "déjà vu, naïve", "漢字かな交じり", "🙂🙂 ok 👩‍👩‍👧",
    " ", "  two", "x" * 300, "ab" * 200, "tab\tand\r\nline", "12345 67890", "الكتاب", "\u0000nul", "The quick brown fox", "﻿mark", "ﬁ ligature ½", "é", "日" * 100,
]


def rows_of(df, held):
    return [tuple(r[c] for c in SHOWN) for r in sorted(alignment.aligned(df, held=held).collect(), key=lambda r: r["doc_id"])]


@pytest.mark.parametrize("held", [10**6, 0])
def test_odd_texts(spark, s, held):
    assert rows_of(documents(spark, TEXTS), held) == plain(TEXTS, s)


@pytest.mark.parametrize(("chunk", "group"), [(1_000_000, 4_096), (50, 0), (200, 2)])
def test_random_texts(spark, s, monkeypatch, chunk, group):
    rng = random.Random(chunk)
    bits = ["the ", "word", " ", "é", "漢", "🙂", "\n", "12", "-", "aaaa", "’s", "Ünï", "▁", "ß", "==", "　"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.choice([0, 1, 5, 60]))) for _ in range(120)]
    want = plain(texts, s)
    monkeypatch.setattr(alignment, "CHUNK", chunk)
    monkeypatch.setattr(alignment, "PLAIN_GROUP", group)
    monkeypatch.setattr(alignment, "COUNTED", 20)
    out = []
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    parts = list(alignment.aligned_batches(iter([batch]), NAMES))
    counts, best = Counter(), {}
    for part in alignment.counted(iter(parts)):
        counts.update(dict(zip(part.column("pair").to_pylist(), part.column("n").to_pylist())))
    for p, n in counts.items():
        best[p // s.nb] = max(n, best.get(p // s.nb, 0))
    for part in parts:
        for r in part.to_pylist():
            links = list(zip(r["pairs"], r["times"]))
            out.append((r["n_a"], r["n_b"], r["n_groups"], r["n_links"], sum(t for p, t in links if counts[p] == best[p // s.nb]), sum(t * counts[p] for p, t in links), r["groups_sha256"]))
    assert out == want


def test_ids_equal_the_files_library(s):
    texts = [t for t in TEXTS if t]
    assert s.ranked is not None
    assert s.encoded(texts) == [e.ids for e in s.library.encode_batch(texts, add_special_tokens=False)]
    assert s.ranked.encode_ordinary("’tis “so” — don’t…") == s.library.encode("’tis “so” — don’t…", add_special_tokens=False).ids


def test_given_documents(spark, s):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = [r["text"] for r in df.orderBy("doc_id").collect()]
    assert rows_of(df, None) == plain(texts, s)


def test_empty_tables_and_repeated_rows(spark, s):
    df = documents(spark, ["a b"])
    assert alignment.aligned(df.limit(0)).collect() == [] and alignment.aligned(df.limit(0), held=-1).collect() == []
    again = spark.createDataFrame([(1, "the end", None, "s", 1), (1, "the end", None, "s", 1), (None, "the end", None, "s", 1), (2, "other", None, "s", 1)], DOCUMENTS)
    for held in (100, 0):
        got = sorted((r["doc_id"] or 0, r["n_links"], r["count_sum"]) for r in alignment.aligned(again, held=held).collect())
        links = got[0][1]
        assert got == [(0, links, 3 * links), (1, links, 3 * links), (1, links, 3 * links), (2, got[3][1], got[3][1])]
    clash = documents(spark, ["a b"]).withColumnsRenamed({"lang": "pairs", "source": "row"})
    assert len(alignment.aligned(clash).collect()) == 1


def test_query_writes_groups_as_its_contract_says(spark, s):
    """`a1,a2|b1;a3|b2,b3`: a bar between the sides of a group, a semicolon between groups."""
    path = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{path}/documents.parquet").collect()}
    digests = {r["doc_id"]: r["groups_sha256"] for r in catalogue.op12_aligned_tokens(spark, path).collect()}
    want = {}
    for k, t in texts.items():
        line = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups(t, s))
        want[k] = hashlib.sha256(line.encode()).hexdigest() if line else ""
    assert digests == want
