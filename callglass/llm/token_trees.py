"""Token counts that follow edits.

A document's text is cut into pre-tokens, as a byte-pair tokenizer does before it merges.
Pre-tokens are the leaves of a segment tree; its nodes hold sums of characters and tokens.
An edit finds its place by descending the tree. Only the pre-tokens it touches and the few
before it that look ahead into it are cut and counted anew, until a cut of the new text
falls on a cut of the old one behind the edit; from there on both go on alike. The changed
leaves are spliced in and the sums on their way to the root are brought up to date.

Trees are binary columns beside the text, so they can be stored with the documents and
edited later. The tokenizer is one of the public byte-pair vocabularies.

Defined results: a null or empty text has no tokens; edits beyond the end of a text are cut
off there. Edits of one text count from the text as it was, are applied from the last to the
first, and must not overlap; an overlapping edit is left out. Repeated rows give repeated
results; they may share a ``doc_id``. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callglass.llm.words import mapped, small_batches

#: Leaves in a block (the tree stands on blocks), and pre-tokens whose token count a task remembers.
BLOCK, REMEMBERED = 64, 200_000
#: Segments a task remembers.
SEGMENTS = 600_000
#: Characters after a pre-token that can change where it ends.
AHEAD = 2
TREE = "blocks binary, lengths binary, counts binary"
#: What the query's edits replace: addresses, long numbers, runs of one mark.
SCRUBBED = re.compile(r"(?P<address>[\w.+-]+@[\w-]+(?:\.[\w-]+)+)|(?P<number>\d{5,})|(?P<run>([^\w\s])\4{2,})")
#: The same for texts without "@", in which no address can be; it does not try one at every letter.
NO_ADDRESS = re.compile(r"(?P<number>\d{5,})|(?P<run>([^\w\s])\3{2,})")


#: Some blanks and what stands up to the next; no pre-token has a blank behind another character.
SEGMENT = re.compile(r"[ \t\r\n]*[^ \t\r\n]+|[ \t\r\n]+")
#: White space besides these, with which a run of blanks can go on.
OTHER_BLANK = re.compile(r"[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


class Counter:
    """Pre-tokens and their token counts."""

    def __init__(self, name: str) -> None:
        import base64

        import public_tokenizers
        import regex
        import tiktoken

        with open(public_tokenizers.path(name), "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=self.ranks, special_tokens={})
        self.known: dict[str, int] = {}
        #: Of a segment the pre-tokens, the tokens as a multiple of 2^32, and 2^64 if an edit lies in it; no edit holds a blank.
        self.segments: dict[str, int] = {}

    def totals(self, text: str) -> tuple[int, int, bool]:
        """Pre-tokens and tokens of a text, and whether it has edits; each segment of it is cut once and remembered for a while."""
        if OTHER_BLANK.search(text):
            return len(self.pattern.findall(text)), len(self.encoding.encode_ordinary(text)), SCRUBBED.search(text) is not None
        own, known = SEGMENT.findall(text), self.segments
        try:
            both = sum(map(known.__getitem__, own))
        except KeyError:
            new = [s for s in dict.fromkeys(own) if s not in known]
            if len(known) + len(new) > SEGMENTS:
                known.clear()
                new = list(dict.fromkeys(own))
            for s in new:
                pieces = self.pattern.findall(s)
                known[s] = (sum(map(self, pieces)) << 32) + len(pieces) + ((SCRUBBED.search(s) is not None) << 64)
            both = sum(map(known.__getitem__, own))
        return both & 0xFFFFFFFF, both >> 32 & 0xFFFFFFFF, both >> 64 > 0

    def __call__(self, piece: str) -> int:
        n = self.known.get(piece)
        if n is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            n = self.known[piece] = 1 if piece.encode() in self.ranks else len(self.encoding.encode_ordinary(piece))
        return n

    def cut(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Length and tokens of each pre-token."""
        pieces = self.pattern.findall(text)
        n = len(pieces)
        return np.fromiter(map(len, pieces), np.uint32, n), np.fromiter(map(self, pieces), np.uint32, n)


_counters: dict[str, Counter] = {}


def counter(name: str) -> Counter:
    if name not in _counters:
        _counters[name] = Counter(name)
    return _counters[name]


class Tree:
    """Blocks of leaves under a binary tree of sums, of characters and of tokens; node 1 is the root."""

    def __init__(self, blocks: list[tuple[np.ndarray, np.ndarray]]) -> None:
        self.blocks = blocks
        self.width = 1
        while self.width < len(blocks):
            self.width *= 2
        self.sums = [0] * (2 * self.width), [0] * (2 * self.width)
        for k, block in enumerate(blocks):
            for own, leaves in zip(self.sums, block):
                own[self.width + k] = int(leaves.sum())
        for own in self.sums:
            for node in range(self.width - 1, 0, -1):
                own[node] = own[2 * node] + own[2 * node + 1]

    @classmethod
    def of(cls, lengths: np.ndarray, counts: np.ndarray) -> Tree:
        return cls([(lengths[k : k + BLOCK], counts[k : k + BLOCK]) for k in range(0, len(lengths), BLOCK)])

    @classmethod
    def load(cls, blocks: bytes, lengths: bytes, counts: bytes) -> Tree:
        ends = np.cumsum(np.frombuffer(blocks, np.uint32)).astype(np.int64)[:-1]
        a, b = np.frombuffer(lengths, np.uint32), np.frombuffer(counts, np.uint32)
        return cls(list(zip(np.split(a, ends), np.split(b, ends))) if len(a) or len(ends) else [])

    def dump(self) -> tuple[bytes, bytes, bytes]:
        sizes = np.array([len(a) for a, _ in self.blocks], np.uint32)
        a, b = (np.concatenate([np.zeros(0, np.uint32), *(x[i] for x in self.blocks)]).astype(np.uint32) for i in (0, 1))
        return sizes.tobytes(), a.tobytes(), b.tobytes()

    @property
    def characters(self) -> int:
        return self.sums[0][1]

    @property
    def tokens(self) -> int:
        return self.sums[1][1]

    def find(self, place: int) -> tuple[int, int]:
        """Block that holds the character at ``place``, and the place of the block's first."""
        node, start, characters = 1, 0, self.sums[0]
        while node < self.width:
            node *= 2
            if place >= start + characters[node] and characters[node + 1]:
                start += characters[node]
                node += 1
        return node - self.width, start

    def replace(self, low: int, high: int, lengths: np.ndarray, counts: np.ndarray) -> None:
        """Puts new leaves in place of the characters from ``low`` to ``high``, both borders of leaves."""
        first, start = self.find(low)
        last, begin = self.find(max(low, high - 1))
        a, b = self.blocks[first]
        head = int(a.cumsum().searchsorted(low - start, "right")) if low > start else 0
        c, d = self.blocks[last]
        tail = int(c.cumsum().searchsorted(high - begin, "right")) if high > begin else 0
        self.blocks[first] = (np.concatenate([a[:head], lengths, c[tail:]]), np.concatenate([b[:head], counts, d[tail:]]))
        empty = np.zeros(0, np.uint32)
        for k in range(first + 1, last + 1):
            self.blocks[k] = (empty, empty)
        if len(self.blocks[first][0]) > 8 * BLOCK:  # many new leaves: build the tree anew from its leaves
            self.__init__(Tree.of(*(np.concatenate([x[i] for x in self.blocks]) for i in (0, 1))).blocks)
            return
        for k in range(first, last + 1):
            for own, leaves in zip(self.sums, self.blocks[k]):
                node = self.width + k
                change = int(leaves.sum()) - own[node]
                while node:
                    own[node] += change
                    node //= 2

    def border(self, place: int) -> int:
        """Start of the first leaf that ends after ``place``."""
        block, start = self.find(place)
        ends = self.blocks[block][0].cumsum()
        k = int(ends.searchsorted(place - start, "right"))
        return start + int(ends[k - 1]) if k else start

    def is_border(self, place: int) -> bool:
        if place in (0, self.characters):
            return True
        block, start = self.find(place)
        if place == start:
            return True
        ends = self.blocks[block][0].cumsum()
        k = int(ends.searchsorted(place - start))
        return k < len(ends) and int(ends[k]) == place - start


def edit(tree: Tree, text: str, start: int, stop: int, put: str, count: Counter) -> tuple[str, Tree, int]:
    """The text and tree after one edit, and how many pre-tokens were counted anew."""
    start, stop = min(start, len(text)), min(stop, len(text))
    new, shift = text[:start] + put + text[stop:], len(put) - (stop - start)
    if not tree.blocks:
        lengths, counts = count.cut(new)
        return new, Tree.of(lengths, counts), len(lengths)
    low = tree.border(max(0, start - AHEAD)) if start else 0
    at, lengths, counts = low, [], []
    for piece in count.pattern.finditer(new, low):
        at = piece.end()
        lengths.append(piece.end() - piece.start())
        counts.append(count(piece.group()))
        if at - shift >= stop and at >= start + len(put) and tree.is_border(at - shift):
            break
    high = at - shift if lengths else tree.characters
    tree.replace(low, high, np.array(lengths, np.uint32), np.array(counts, np.uint32))
    return new, tree, len(lengths)


def built(batches: Iterator[pa.RecordBatch], name: str) -> Iterator[pa.RecordBatch]:
    count = counter(name)
    for batch in batches:
        trees = [Tree.of(*count.cut(t or "")) for t in batch.column("text").to_pylist()]
        parts = list(zip(*(t.dump() for t in trees))) or [[], [], []]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("text"), *(pa.array(p, pa.binary()) for p in parts), pa.array([t.tokens for t in trees], pa.int64())],
            ["doc_id", "text", "blocks", "lengths", "counts", "n_tokens"],
        )


def trees(documents: DataFrame, name: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """``doc_id``, ``text``, the tree's columns and ``n_tokens`` of every document."""
    small_batches(documents.sparkSession, 250)
    return mapped(documents.select("doc_id", "text"), lambda b: built(b, name), f"doc_id long, text string, {TREE}, n_tokens long")


def applied(batches: Iterator[pa.RecordBatch], name: str) -> Iterator[pa.RecordBatch]:
    count = counter(name)
    for batch in batches:
        out = []
        for text, blocks, lengths, counts, edits in zip(*(batch.column(c).to_pylist() for c in ("text", "blocks", "lengths", "counts", "edits"))):
            tree, anew, done, before = Tree.load(blocks, lengths, counts), 0, 0, len(text or "") + 1
            for e in sorted(edits or (), key=lambda e: (-e["start"], -e["stop"])):
                if e["stop"] <= before and e["start"] <= e["stop"] or e["start"] >= len(text or "") and not done:
                    text, tree, n = edit(tree, text or "", e["start"], e["stop"], e["put"] or "", count)
                    anew, done, before = anew + n, done + 1, e["start"]
            out.append((text, *tree.dump(), tree.tokens, done, anew, sum(len(a) for a, _ in tree.blocks)))
        columns = list(zip(*out)) or [[]] * 8
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("n_tokens"), *(pa.array(c, t) for c, t in zip(columns, (pa.string(), *[pa.binary()] * 3, *[pa.int64()] * 4)))],
            ["doc_id", "n_tokens_before", "text", "blocks", "lengths", "counts", "n_tokens", "n_edits", "n_counted_anew", "n_pretokens"],
        )


EDITED = f"doc_id long, n_tokens_before long, text string, {TREE}, n_tokens long, n_edits long, n_counted_anew long, n_pretokens long"


def with_edits(rows: DataFrame, name: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """Rows of ``trees`` with a column ``edits`` (array of start, stop, put) after these edits."""
    small_batches(rows.sparkSession, 250)
    return mapped(rows.select("doc_id", "text", "blocks", "lengths", "counts", "n_tokens", "edits"), lambda b: applied(b, name), EDITED)


def apply_edits(stored: DataFrame, edits: DataFrame, name: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """``stored`` trees after ``edits`` (doc_id, start, stop, put); trees without edits stay as they are."""
    by = edits.groupBy("doc_id").agg(F.collect_list(F.struct("start", "stop", "put")).alias("edits"))
    return with_edits(stored.join(by, "doc_id", "left"), name)


def places_to_scrub(text: str) -> list[tuple[int, int, str]]:
    """Edits (start, stop, put) of one text, in order."""
    pattern = SCRUBBED if "@" in text else NO_ADDRESS
    put = lambda m, kinds: "<address>" if kinds.get("address") else "<number>" if kinds["number"] else m.group()[0]
    return [(m.start(), m.end(), put(m, m.groupdict())) for m in pattern.finditer(text)]


def scrubbed(batches: Iterator[pa.RecordBatch], name: str) -> Iterator[pa.RecordBatch]:
    """One pass: a text's edits, and its tree if it has any; the tree then follows the edits."""
    count = counter(name)
    for batch in batches:
        out = []
        for text in batch.column("text").to_pylist():
            text = text or ""
            pieces, n, touched = count.totals(text)
            if not touched:
                out.append((n, 0, n, pieces, 0))
                continue
            edits = places_to_scrub(text)
            tree, anew = Tree.of(*count.cut(text)), 0
            before = tree.tokens
            for start, stop, put in reversed(edits):
                text, tree, n = edit(tree, text, start, stop, put, count)
                anew += n
            out.append((before, len(edits), tree.tokens, sum(len(a) for a, _ in tree.blocks), anew))
        columns = list(zip(*out)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *(pa.array(c, pa.int64()) for c in columns)], SCRUBBED_NAMES)


SCRUBBED_NAMES = ["doc_id", "n_tokens_before", "n_edits", "n_tokens_after", "n_pretokens", "n_counted_anew"]


def scrubbed_counts(documents: DataFrame, name: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """Token counts of every document before and after its addresses, long numbers and runs of marks are replaced.

    Texts without edits need no tree here; ``trees`` builds and stores one for every document.
    """
    small_batches(documents.sparkSession, 250)
    return mapped(documents.select("doc_id", "text"), lambda b: scrubbed(b, name), ", ".join(f"{c} long" for c in SCRUBBED_NAMES))
