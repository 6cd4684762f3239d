"""SentencePiece encoding and decoding as a max-plus scan.

A segmentation of a text is a path through places; an edge is a piece of the vocabulary, or
a single character. Its weight is the piece's score (unigram models), or 0 if the piece may
follow the one before and minus infinity if not (BPE models). Whether two pieces of a BPE
model may stand side by side is local: their own merging, done on the two alone, must not
join them. A segmentation is the one that merging makes if and only if that holds for all
neighbours, so exactly one path has a finite weight and the best path is the model's own
result.

A text of more than ``CHUNK`` characters is split. A chunk yields a transfer matrix: for
each state at its left border (which piece lies across or ends there) and each state at its
right border the weight of the best path between. Matrices combine associatively; the
vector of the first chunk is carried through them, the best states are traced back, and
then each chunk traces its own part with its two states alone. Places between two
characters that no piece holds side by side are common to all paths, so what lies between
them is solved once and remembered for a while.

Characters that are no piece become their UTF-8 byte pieces. A blank is put before the text,
as the model's normaliser does.

Defined results: a null text has null ids and decodes to null; an empty text has none. The
mark for a blank (U+2581) decodes to a blank. Repeated rows give repeated results; they may
share a ``doc_id``. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callglass.llm.words import mapped, small_batches, windows

BLANK = "▁"
#: Characters of a chunk, stretches a task remembers, longest stretch that is remembered.
CHUNK, REMEMBERED, LONGEST = 32_768, 400_000, 48
#: Neighbours of pieces a task remembers, and texts that are cut into stretches at once.
PAIRS, CUT = 600_000, 50
#: Longest stretch that is solved beside others, and how many at once.
WIDEST, BATCH = 64, 20_000
UNITS = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+")
NEVER = float("-inf")


def vocabulary_file(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def places(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)


def few_bits(hashes: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((hashes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)


def neighbours(points: np.ndarray) -> np.ndarray:
    """A small hash of each character and the one after it."""
    return few_bits(points[:-1] << np.uint64(21) | points[1:])


class Pieces:
    """A model's pieces and the weights of paths."""

    def __init__(self, file: str, merging: bool = True) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=file)
        n = model.get_piece_size()
        plain = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.setup({model.id_to_piece(i): (i, model.get_score(i)) for i in plain}, {int(model.id_to_piece(i)[3:5], 16): i for i in range(n) if model.is_byte(i)}, merging)

    def setup(self, plain: dict[str, tuple[int, float]], of_byte: dict[int, int], merging: bool) -> None:
        self.merging = merging
        self.ids = {p: i for p, (i, _) in plain.items()}
        self.scores = {p: s for p, (_, s) in plain.items()}
        self.least = min(self.scores.values()) - 10
        self.longest = max(map(len, plain))
        self.of_byte = of_byte
        self.words = {i: p.encode() for p, (i, _) in plain.items()} | {i: bytes([b]) for b, i in of_byte.items()}
        self.starts: dict = {}  # a tree of pieces by character
        for p in plain:
            node = self.starts
            for ch in p:
                node = node.setdefault(ch, {})
            node[""] = True
        #: No piece has a blank after another character, so all paths meet before such a blank.
        self.meets = not any(re.search(f"[^{BLANK}]{BLANK}", p) for p in plain)
        #: By hash, the neighbours that some piece holds; others no piece and no merge can span, so all paths meet between them.
        self.joined = np.zeros(1 << 20, bool)
        twos = "".join(sorted({p[k : k + 2] for p in plain for k in range(len(p) - 1)}))
        self.joined[neighbours(places(twos))[::2]] = True
        #: Whether right may follow left, by number of left * count + number of right.
        self.beside: dict[int, bool] = {}
        self.number = {p: k for k, p in enumerate(plain)}
        self.count = len(plain)
        self.whole = {p for p in plain if len(p) == 1 or self.merged(p) == [p]} if merging else set(plain)
        self.text_of = list(plain)
        self.id_of = np.array([plain[p][0] for p in plain], np.int32)
        self.by_length = []
        for n in range(1, self.longest + 1):
            own = [p for p in self.whole if len(p) == n]
            hashes = windows(places("".join(own)), n)[::n]
            order = np.argsort(hashes)
            maybe = np.zeros(1 << 20, bool)
            maybe[few_bits(hashes)] = True
            self.by_length.append((hashes[order], np.array([self.number[p] for p in own], np.int64)[order], maybe))
        self.pairs, self.fit = np.array([-1], np.int64), np.array([False])
        self.known: dict[str, list[str]] = {}
        self.forget()

    def forget(self) -> None:
        """No solved stretches: their numbers, and of each where its ids begin and how many they are."""
        self.solved: dict[str, int] = {}
        self.at, self.sizes, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def merged(self, text: str) -> list[str]:
        """Merges the neighbours of best score, the leftmost first, as long as there are any."""
        parts = list(text)
        while True:
            best, at = NEVER, -1
            for k in range(len(parts) - 1):
                score = self.scores.get(parts[k] + parts[k + 1], NEVER)
                if score > best:
                    best, at = score, k
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def fits(self, left: str, right: str) -> bool:
        """Whether merging keeps the two pieces apart."""
        a, b = self.number.get(left), self.number.get(right)
        if a is None or b is None:  # a character that is no piece joins nothing
            return True
        key = a * self.count + b
        have = self.beside.get(key)
        if have is None:
            if len(self.beside) >= PAIRS:
                self.beside.clear()
            have = self.beside[key] = self.merged(left + right) == [left, right]
        return have

    def weight(self, before: str | None, piece: str) -> float:
        if not self.merging:
            return self.scores.get(piece, self.least)
        if before is None:
            return 0.0 if len(piece) == 1 or piece in self.whole else NEVER
        return 0.0 if self.fits(before, piece) else NEVER

    def reach(self, text: str, start: int, before: str | None, limit: int) -> dict[int, tuple[float, int]]:
        """Best weight and start of the last piece for each place up to ``limit``."""
        best: dict[int, tuple[float, int]] = {start: (0.0, -1)}
        for at in range(start, limit):
            here = best.get(at)
            if here is None:
                continue
            last = before if at == start else text[here[1] : at]
            node = self.starts
            for end in range(at + 1, limit + 1):
                node = node.get(text[end - 1])
                if node is None and end > at + 1:
                    break
                if end == at + 1 or "" in node:
                    weight = here[0] + self.weight(last, text[at:end])
                    if weight > best.get(end, (NEVER, 0))[0]:
                        best[end] = (weight, at)
                if node is None:
                    break
        return best

    def path(self, text: str, start: int, end: int, before: str | None) -> tuple[float, list[str]]:
        """Best weight and pieces from one place to another."""
        if start == end:
            return 0.0, []
        best, out, at = self.reach(text, start, before, end), [], end
        if end not in best:
            return NEVER, []
        while at > start:
            out.append(text[best[at][1] : at])
            at = best[at][1]
        return best[end][0], out[::-1]

    def fit_all(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """``fits`` for arrays of piece numbers; -1 is a character that is no piece."""
        keys = left * self.count + right
        at = np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)
        out = self.fit[at]
        new = np.flatnonzero((self.pairs[at] != keys) & (left >= 0) & (right >= 0))
        for k in new.tolist():
            out[k] = self.fits(self.text_of[left[k]], self.text_of[right[k]])
        return out | (left < 0) | (right < 0)

    def solve(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many stretches at once, one after the other, and where each begins and the last ends.

        The scan of ``only_path``, carried out for all stretches side by side, place by place.
        """
        if not self.merging or max(map(len, units), default=0) > WIDEST:
            rows = [self.numbers(self.unit(u)) for u in units]
            return np.fromiter((i for r in rows for i in r), np.int32), np.cumsum([0, *map(len, rows)])
        text = "".join(units)
        cp = places(text)
        size = np.fromiter(map(len, units), np.int64, len(units))
        first = np.concatenate([[0], np.cumsum(size)])[:-1]
        ahead = np.repeat(first + size, size) - np.arange(len(cp))
        found = np.full((self.longest + 1, len(cp)), -1, np.int64)
        for n, (hashes, numbers, maybe) in enumerate(self.by_length, 1):
            own = windows(cp, n)
            hit = np.flatnonzero(maybe[few_bits(own)] & (ahead[: len(own)] >= n))
            at = np.minimum(np.searchsorted(hashes, own[hit]), max(0, len(hashes) - 1))
            if len(hashes):
                good = hashes[at] == own[hit]
                found[n, hit[good]] = numbers[at[good]]
        last, length = np.full(len(cp), -1, np.int64), np.ones(len(cp), np.int64)
        for end in range(1, int(size.max(initial=0)) + 1):
            open_ = first[size >= end]
            for n in range(min(end, self.longest), 0, -1):
                start = open_ + end - n
                piece = found[n, start]
                able = np.flatnonzero(piece >= 0) if n > 1 else np.arange(len(start))
                if not len(able):
                    continue
                if n < end:
                    able = able[self.fit_all(last[start[able] - 1], piece[able])]
                ends = open_[able] + end - 1
                last[ends], length[ends] = piece[able], n
                keep = np.ones(len(open_), bool)
                keep[able] = False
                open_ = open_[keep]
                if not len(open_):
                    break
        begins = np.zeros(len(cp), bool)
        of = np.full(len(cp), -1, np.int64)
        low, at = first[size > 0], (first + size - 1)[size > 0]
        while len(at):
            start = at - length[at] + 1
            begins[start], of[start] = True, last[at]
            more = start > low
            low, at = low[more], start[more] - 1
        starts = np.flatnonzero(begins)
        piece = of[starts]
        width = np.ones(len(starts), np.int64)
        odd = np.flatnonzero(piece < 0)
        spelled = [[self.of_byte[b] for b in text[k].encode()] for k in starts[odd].tolist()]
        width[odd] = [len(x) for x in spelled]
        place = np.concatenate([[0], np.cumsum(width)])
        ids = np.zeros(int(place[-1]), np.int32)
        ids[place[:-1][piece >= 0]] = self.id_of[piece[piece >= 0]]
        for k, x in zip(odd.tolist(), spelled):
            ids[place[k] : place[k + 1]] = x
        if len(self.beside) > 1.1 * len(self.pairs):
            keys = np.fromiter(self.beside, np.int64, len(self.beside))
            order = np.argsort(keys)
            self.pairs, self.fit = keys[order], np.fromiter(self.beside.values(), bool, len(keys))[order]
        return ids, np.append(place[np.searchsorted(starts, first)], place[-1])

    def ids_of_texts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and where each begins and the last ends.

        A stretch is solved once and remembered for the texts that follow; a wide one only for these texts.
        """
        every, rows = [], np.zeros(len(texts) + 1, np.int64)
        for low in range(0, len(texts), CUT):
            some = [BLANK + t.replace(" ", BLANK) if t else "" for t in texts[low : low + CUT]]
            own, starts = self.stretches(some)
            rows[low + 1 : low + 1 + len(some)] = starts[1:] + len(every)
            every += own
        different = dict.fromkeys(every)
        short = [u for u in different if len(u) <= WIDEST and u not in self.solved]
        if len(self.solved) + len(short) > REMEMBERED:
            self.forget()
            short = [u for u in different if len(u) <= WIDEST]
        wide = [u for u in different if len(u) > WIDEST]
        del different
        at, sizes, flat, shift = [self.at], [self.sizes], [self.flat], len(self.flat)
        for some in (*(short[k : k + BATCH] for k in range(0, len(short), BATCH)), *([u] for u in wide)):
            ids, ends = self.solve(some)
            at.append(ends[:-1] + shift)
            sizes.append(np.diff(ends))
            flat.append(ids)
            shift += len(ids)
        index = {u: k for k, u in enumerate((*short, *wide), len(self.solved))}
        at, sizes, flat = map(np.concatenate, (at, sizes, flat))
        self.solved |= index
        order = np.fromiter(map(self.solved.__getitem__, every), np.int64, len(every))
        count = sizes[order]
        ends = np.concatenate([[0], np.cumsum(count)])
        ids = flat[np.repeat(at[order] - ends[:-1], count) + np.arange(int(ends[-1]))]
        for u in wide:
            del self.solved[u]
        kept = len(self.solved)
        self.at, self.sizes = at[:kept], sizes[:kept]
        self.flat = flat[: int(self.at[-1] + self.sizes[-1]) if kept else 0].copy()
        return ids, ends[rows]

    def stretches(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """What lies between the neighbours that no piece holds, text after text, and where each text begins and the last ends."""
        text = "".join(texts)
        bounds = np.cumsum([0, *map(len, texts)])
        if not text:
            return [], np.zeros(len(bounds), np.int64)
        new = np.ones(len(text), bool)
        new[1:] = ~self.joined[neighbours(places(text))]
        new[bounds[bounds < len(text)]] = True
        starts = np.flatnonzero(new)
        at = starts.tolist()
        return [text[a:b] for a, b in zip(at, [*at[1:], len(text)])], np.searchsorted(starts, bounds)

    def only_path(self, text: str) -> list[str]:
        """The best path from the start of a text to its end in a merging model.

        Up to each place one path alone has a finite weight, so the scan keeps its last
        piece and looks no further than the first that fits, the longest being tried first.
        """
        last: list[str] = [""]
        whole, beside, number, count, longest = self.whole, self.beside, self.number, self.count, self.longest
        for end in range(1, len(text) + 1):
            for start in range(max(0, end - longest), end):
                piece = text[start:end]
                if piece in whole or start + 1 == end:
                    if start == 0:
                        break
                    left = last[start]
                    have = beside.get(number[left] * count + number[piece]) if left in number and piece in number else True
                    if have is None:
                        have = self.fits(left, piece)
                    if have:
                        break
            last.append(piece)
        out, at = [], len(text)
        while at:
            out.append(last[at])
            at -= len(last[at])
        return out[::-1]

    def units(self, text: str) -> list[str]:
        return UNITS.findall(text) if self.meets else [text] if text else []

    def unit(self, text: str) -> list[str]:
        have = self.known.get(text)
        if have is None:
            have = self.only_path(text) if self.merging else self.path(text, 0, len(text), None)[1]
            if len(text) <= LONGEST:
                if len(self.known) >= REMEMBERED:
                    self.known.clear()
                self.known[text] = have
        return have

    def meeting(self, text: str, low: int, high: int) -> list[int]:
        """Places from ``low`` to ``high`` that all paths pass; only the first and the last."""
        if not self.meets:
            return []
        find = re.compile(f"(?<=[^{BLANK}]){BLANK}")
        first = find.search(text, max(low, 1), high + 1)
        if first is None:
            return []
        at = high
        while at > first.start():
            if text[at : at + 1] == BLANK and text[at - 1] != BLANK:
                break
            at -= 1
        return [first.start(), at]

    def left_states(self, text: str, border: int) -> list[tuple[int, int]]:
        """Pieces (characters before the border, characters after it) that may lie across it or end there."""
        out = []
        for back in range(1, min(self.longest, border) + 1):
            for over in range(min(self.longest - back, len(text) - border) + 1):
                piece = text[border - back : border + over]
                if piece in self.ids or len(piece) == 1:
                    out.append((back, over))
        return out

    def transfer(self, text: str, low: int, high: int, first: bool) -> list[tuple[int, int, int, int, float]]:
        """The finite entries of a chunk's matrix: left state, right state, weight."""
        limit = min(len(text), high + self.longest - 1)
        passed = [p for p in self.meeting(text, low, high - 1) if p > low or first]
        entries, tail = [], None
        for back, over in [(0, 0)] if first else self.left_states(text, low):
            start, before = low + over, text[low - back : low + over] if back else None
            if passed and start <= passed[0]:
                weight = self.path(text, start, passed[0], before)[0]
                if weight == NEVER:
                    continue
                if tail is None:
                    middle = 0.0 if self.merging else sum(self.scores.get(p, self.least) for u in self.units(text[passed[0] : passed[-1]]) for p in self.unit(u))
                    tail = {end: (w + middle, at) for end, (w, at) in self.reach(text, passed[-1], None, limit).items()}
                found = {end: (w + weight, at) for end, (w, at) in tail.items()}
            elif start >= high:
                if start - low + back <= self.longest and back + over:  # the piece covers the whole chunk
                    entries.append((back, over, back + high - low, start - high, 0.0))
                continue
            else:
                found = self.reach(text, start, before, limit)
            entries += [(back, over, high - at, end - high, w) for end, (w, at) in found.items() if end >= high > at >= 0]
        return entries

    def trace(self, text: str, low: int, high: int, left: tuple[int, int], right: tuple[int, int]) -> list[int]:
        """Ids of the chunk's pieces between its two states; the piece of the right state is its last."""
        start, at = low + left[1], high - right[0]
        if start > at:  # one piece covers the whole chunk and belongs to an earlier one
            return []
        before = text[low - left[0] : start] if left[0] else None
        passed = [p for p in self.meeting(text, low, at) if p >= start and (p > low or not left[0])]
        if not passed:
            out = self.numbers(self.path(text, start, at, before)[1])
        else:
            out = self.numbers(self.path(text, start, passed[0], before)[1])
            out += self.ids_between(text[passed[0] : passed[-1]])
            out += self.numbers(self.path(text, passed[-1], at, None)[1])
        return out + self.numbers([text[at : high + right[1]]])

    def ids_between(self, text: str) -> list[int]:
        """Ids of a stretch between two places that all paths pass."""
        units = self.units(text)
        index = {u: k for k, u in enumerate(dict.fromkeys(units))}
        narrow = [u for u in index if len(u) <= WIDEST]
        solved: dict[str, list[int]] = {u: self.numbers(self.unit(u)) for u in index if len(u) > WIDEST}
        ids, ends = self.solve(narrow)
        flat = ids.tolist()
        solved |= {u: flat[a:b] for u, a, b in zip(narrow, ends[:-1].tolist(), ends[1:].tolist())}
        return [i for u in units for i in solved[u]]

    def numbers(self, pieces: list[str]) -> list[int]:
        out = []
        for p in pieces:
            i = self.ids.get(p)
            if i is None:
                out += [self.of_byte[b] for b in p.encode()]
            else:
                out.append(i)
        return out

    def encode(self, text: str) -> list[int]:
        """A text of one chunk."""
        return self.ids_of_texts([text])[0].tolist()

    def decode(self, ids: list[int]) -> str:
        words = self.words
        return b"".join([words[i] for i in ids]).decode("utf-8", "replace").replace(BLANK, " ")[1:]


_models: dict[str, Pieces] = {}


def model(file: str) -> Pieces:
    if file not in _models:
        _models[file] = Pieces(file)
    return _models[file]


def ids_of(rows: list[list[int] | None]) -> pa.Array:
    ends = np.cumsum([0, *(len(r or ()) for r in rows)]).astype(np.int32)
    flat = np.fromiter((i for r in rows for i in r or ()), np.int32, int(ends[-1]))
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat), mask=pa.array([r is None for r in rows]))


def encoded(batches: Iterator[pa.RecordBatch], file: str) -> Iterator[pa.RecordBatch]:
    own = model(file)
    for batch in batches:
        ids, ends = own.ids_of_texts(batch.column("text").to_pylist())
        lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids), mask=batch.column("text").is_null())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), lists], ["doc_id", "text", "ids"])


def split(batches: Iterator[pa.RecordBatch], margin: int, size: int) -> Iterator[pa.RecordBatch]:
    """Chunks of normalised text with margins: place of the chunk in its string, length, number, whether it is the last."""
    for batch in batches:
        for k, t in enumerate(batch.column("text").to_pylist()):
            text = BLANK + t.replace(" ", BLANK)
            for no, low in enumerate(range(0, len(text), size)):
                begin, high = max(0, low - margin), min(len(text), low + size)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c).slice(k, 1) for c in ("doc_id", "text_key")] + [pa.array([v], p) for v, p in ((no, pa.int32()), (text[begin : high + margin], pa.string()), (low - begin, pa.int32()), (high - begin, pa.int32()))],
                    ["doc_id", "text_key", "no", "body", "low", "high"],
                )


def matrices(batches: Iterator[pa.RecordBatch], file: str) -> Iterator[pa.RecordBatch]:
    own = model(file)
    for batch in batches:
        found = [own.transfer(t, a, b, n == 0) for t, a, b, n in zip(*(batch.column(c).to_pylist() for c in ("body", "low", "high", "no")))]
        packed = [np.array(f, np.float64).tobytes() for f in found]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "text_key", "no")), pa.array(packed, pa.binary())], ["doc_id", "text_key", "no", "matrix"])


def scanned(table: pa.Table) -> pa.Table:
    """The states between the chunks of one text: the best path through all matrices."""
    table = table.sort_by("no")
    vector: dict[tuple[int, int], float] = {(0, 0): 0.0}
    origins = []
    for data in table.column("matrix").to_pylist():
        after: dict[tuple[int, int], float] = {}
        origin = {}
        for a, b, c, d, w in np.frombuffer(data, np.float64).reshape(-1, 5).tolist():
            left, right = (int(a), int(b)), (int(c), int(d))
            total = vector.get(left, NEVER) + w
            if total > after.get(right, NEVER):
                after[right], origin[right] = total, left
        origins.append(origin)
        vector = after
    state = max((s for s in vector if s[1] == 0), key=lambda s: (vector[s], -s[0]))
    lefts, rights = [], []
    for origin in reversed(origins):
        rights.append(state)
        state = origin[state]
        lefts.append(state)
    columns = [pa.array(x, pa.int32()) for x in (*zip(*lefts[::-1]), *zip(*rights[::-1]))]
    return pa.table([table.column("doc_id"), table.column("text_key"), table.column("no"), *columns], ["doc_id", "text_key", "no", "back", "over", "back2", "over2"])


def traced(batches: Iterator[pa.RecordBatch], file: str) -> Iterator[pa.RecordBatch]:
    own = model(file)
    for batch in batches:
        rows = [
            own.trace(t, a, b, (p, q), (r, s))
            for t, a, b, p, q, r, s in zip(*(batch.column(c).to_pylist() for c in ("body", "low", "high", "back", "over", "back2", "over2")))
        ]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "text_key", "no")), ids_of(rows)], ["doc_id", "text_key", "no", "ids"])


def short_texts(documents: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` of the texts of one chunk, nulls among them."""
    small_batches(documents.sparkSession)
    return documents.select("doc_id", "text").where(F.coalesce(F.length("text"), F.lit(0)) < CHUNK)


def encode(documents: DataFrame, file: str | None = None) -> DataFrame:
    """``doc_id``, ``text`` and ``ids`` of every document."""
    file = file or vocabulary_file()
    short = mapped(short_texts(documents), lambda b: encoded(b, file), "doc_id long, text string, ids array<int>")
    return short.union(encoded_long(documents, file))


def encoded_long(documents: DataFrame, file: str) -> DataFrame:
    """``doc_id``, ``text`` and ``ids`` of the texts of more chunks."""
    small_batches(documents.sparkSession)
    rows = documents.select("doc_id", "text")
    size, margin = CHUNK, model(file).longest
    key = F.xxhash64("text").alias("text_key")
    long = rows.where(F.length("text") >= size).select("doc_id", key, "text")
    once = long.dropDuplicates(["doc_id", "text_key"])
    chunks = mapped(once, lambda b: split(b, margin, size), "doc_id long, text_key long, no int, body string, low int, high int").repartition("doc_id", "text_key", "no")
    parts = mapped(chunks, lambda b: matrices(b, file), "doc_id long, text_key long, no int, matrix binary")
    states = parts.groupBy("doc_id", "text_key").applyInArrow(scanned, "doc_id long, text_key long, no int, back int, over int, back2 int, over2 int")
    same = [F.col("doc_id").eqNullSafe(F.col("d")), F.col("text_key") == F.col("k")]
    right = states.withColumnsRenamed({"doc_id": "d", "text_key": "k", "no": "m"})
    both = chunks.join(right, [*same, F.col("no") == F.col("m")]).drop("d", "k", "m")
    own = mapped(both, lambda b: traced(b, file), "doc_id long, text_key long, no int, ids array<int>")
    whole = own.groupBy("doc_id", "text_key").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("no", "ids"))), lambda x: x["ids"])).alias("ids"))
    return long.join(whole.withColumnsRenamed({"doc_id": "d", "text_key": "k"}), same).select("doc_id", "text", "ids")


def decoded(batches: Iterator[pa.RecordBatch], file: str) -> Iterator[pa.RecordBatch]:
    own = model(file)
    for batch in batches:
        texts = [None if i is None else own.decode(i) for i in batch.column("ids").to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "decoded"])


def decode(rows: DataFrame, file: str | None = None) -> DataFrame:
    """``rows`` (doc_id, ids) with ``decoded``."""
    small_batches(rows.sparkSession, 250)
    file = file or vocabulary_file()
    return mapped(rows.select("doc_id", "ids"), lambda b: decoded(b, file), "doc_id long, ids array<int>, decoded string")


def checked(batches: Iterator[pa.RecordBatch], file: str) -> Iterator[pa.RecordBatch]:
    own = model(file)
    for batch in batches:
        ids, n, digest, same = batch.column("ids"), [], [], []
        for row, text in zip(ids, batch.column("text").to_pylist()):
            values = row.values.to_numpy() if row.is_valid else None
            n.append(0 if values is None else len(values))
            digest.append(None if values is None else hashlib.sha256(values.astype("<i4").tobytes()).hexdigest())
            same.append(text is None if values is None else own.decode(values.tolist()) == text.replace(BLANK, " "))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(digest, pa.string()), pa.array(same), ids], ["doc_id", "n_pieces", "ids_sha256", "round_trip", "ids"])


CHECKED = "doc_id long, n_pieces long, ids_sha256 string, round_trip boolean, ids array<int>"


def encoded_documents(documents: DataFrame, file: str | None = None) -> DataFrame:
    """``doc_id``, ``n_pieces``, ``ids_sha256`` (little-endian 32-bit ids), ``round_trip`` (whether decoding gives the text) and ``ids``.

    A text of one chunk is encoded and checked by one worker: each of two steps would hold the model in a worker of its own.
    """
    file = file or vocabulary_file()
    short = mapped(short_texts(documents), lambda b: checked(encoded(b, file), file), CHECKED)
    return short.union(mapped(encoded_long(documents, file), lambda b: checked(b, file), CHECKED))
