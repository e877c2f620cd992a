"""SentencePiece encoding and decoding as a max-plus parallel scan.

An encoding is the cut of a text into vocabulary pieces with the greatest sum of scores (characters that no piece covers
fall back to byte pieces). A giant document is split into chunks. Between chunks the state is how far back the piece
across the boundary began; a chunk, knowing the few characters before it, gives the matrix of best scores from
each state on its left to each on its right. These matrices combine associatively (maximum of sums); a scan of them gives
the best scores at every chunk's left boundary, and with these each chunk finds its pieces and the state they come
from on its own, for every state on its right that can be.

No piece holds a blank's mark after another character, so every encoding cuts before the first of a run of blanks:
between such cuts a chunk's matrix is a sum of one score per word. A batch's new words are cut all at once, as arrays,
and kept in a bounded memo.

Scores are integers here, which makes the scan exact and associative. Of equal sums the one whose later pieces are
longer is taken. Given the scores before a chunk, its own pass makes the choices that one pass over the whole text
would make, so the ids don't depend on where a text is cut into chunks, nor on whether it is.

The file's scores are read as a unigram model's. For files of another kind (merge ranks) the result is the best cut
under those scores, which is not the merge order's result.

Null and empty texts have no pieces. Repeated rows are encoded each, an empty table gives no row, and other columns, of
whatever name, are not read. A text that holds the blank's mark itself is decoded with a blank in its place.
"""

from __future__ import annotations

import bisect
import collections
import functools
import math
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, stored, texts, tokenizer_path

MARK = "▁"
CHUNK_CHARS = 16_384
NEVER = -(1 << 60)
MEMO_WORDS, LONG = 180_000, 200
SCAN_BLOCK = 64
WIDTH = 4  # bytes per id
#: Words up to these lengths are cut together as one array.
LENGTHS, ARRAY_WORDS, GROUP_CHARS = (4, 6, 8, 10, 12, 16, 24, 40), 6000, 1_500_000
_BASE, _SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


class Pieces:
    """The vocabulary: pieces' ids and integer scores, prefixes, byte pieces."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.strings, self.byte_of, found = [sp.id_to_piece(i) for i in range(n)], {}, []
        for i, piece in enumerate(self.strings):
            if sp.is_byte(i):
                self.byte_of[i] = int(piece[3:5], 16)
            elif not (sp.is_unknown(i) or sp.is_control(i) or sp.is_unused(i)):
                found.append((piece, i, sp.get_score(i)))
        self._build(found)
        self.silent = {i for i in range(n) if sp.is_control(i) or sp.is_unknown(i)}

    def _build(self, found: list[tuple[str, int, float]]) -> None:
        usual = [-s for _, _, s in found if s > -1e8] or [1.0]
        top = max(1.0, max(usual))
        scale = 1 << max(0, 35 - math.ceil(math.log2(top)))
        self.of, self.prefixes = {}, set()
        for piece, i, s in found:
            self.of[piece] = (round(max(s, -32 * top) * scale), i)
            self.prefixes.update(piece[:k] for k in range(1, len(piece) + 1))
        self.unknown = round(-(32 * top + 10) * scale)
        self.longest = max(map(len, self.of), default=1)
        self.cuts = not any(MARK in p.lstrip(MARK) for p in self.of)
        byte_ids = {b: i for i, b in self.byte_of.items()}
        self.fallback = lambda char: [byte_ids[b] for b in char.encode("utf-8", "surrogatepass")] if len(byte_ids) == 256 else [0]

    def from_here(self, text: str, at: int):
        """(end, score, id) of the pieces that start at `at`; an unknown character is one with id -1."""
        prefixes, of, single = self.prefixes, self.of, False
        for end in range(at + 1, min(len(text), at + self.longest) + 1):
            part = text[at:end]
            if part not in prefixes:
                break
            if part in of:
                score, i = of[part]
                single |= end == at + 1
                yield end, score, i
        if not single:
            yield at + 1, self.unknown, -1

    def best(self, text: str, lead: int = 0, stop: int | None = None, cross: bool = False) -> tuple[int, list[int]]:
        """(score, ids) of the best cut of text[lead:stop]; with `cross`, the first piece starts at 0, before `lead`,
        and must end beyond it."""
        stop = len(text) if stop is None else stop
        score, back = [NEVER] * (stop + 1), [None] * (stop + 1)
        score[0 if cross else lead] = 0
        for at in [0, *range(lead, stop)] if cross else range(lead, stop):
            base = score[at]
            if base == NEVER:
                continue
            for end, s, i in self.from_here(text, at):
                if end <= stop and (end > lead or not cross) and base + s > score[end]:
                    score[end], back[end] = base + s, (at, i)
        ids, at = [], stop
        while back[at] is not None:
            start, i = back[at]
            ids.append(self.fallback(text[start:at])[::-1] if i < 0 else [i])
            at = start
        return score[stop], [i for group in ids for i in group][::-1]

    def ends(self, text: str, start: int) -> np.ndarray:
        """Scores of the best cuts from `start` to each of the last positions: the end, one before it, and so on."""
        score = [NEVER] * (len(text) + 1)
        score[start] = 0
        for at in range(start, len(text)):
            if score[at] > NEVER:
                for end, s, _ in self.from_here(text, at):
                    score[end] = max(score[end], score[at] + s)
        out = [score[len(text) - e] if len(text) - e >= start else NEVER for e in range(self.longest)]
        return np.array(out, np.int64)


def _hash_step(h, chars):
    """Rolling hashes with one more character each."""
    h = (h + chars + np.uint64(1)) * _BASE
    return h ^ (h >> np.uint64(29))


class PieceTable:
    """Finds pieces by the hash of their characters, many at once. Hashes that share a slot go to a further, smaller level."""

    def __init__(self, pieces: Pieces):
        found = list(pieces.of.items())
        keys, length = np.zeros(len(found), np.uint64), np.array([len(piece) for piece, _ in found])
        for n in np.unique(length):
            at = np.flatnonzero(length == n)
            chars = np.frombuffer("".join(found[k][0] for k in at.tolist()).encode("utf-32-le", "surrogatepass"), "<u4").reshape(-1, n)
            for c in chars.T.astype(np.uint64):
                keys[at] = _hash_step(keys[at], c)
        # two places more: no piece, and an unknown character
        self.none, self.unknown = len(found), len(found) + 1
        self.scores = np.array([s for _, (s, _) in found] + [NEVER, pieces.unknown], np.int64)
        self.ids = np.array([i for _, (_, i) in found] + [-1, -1], np.int64)
        if len(np.unique(keys)) < len(keys):
            raise ValueError("two pieces have one hash")
        self.levels, left, bits = [], np.arange(len(keys)), max(10, (8 * len(keys)).bit_length())
        while len(left):
            slot = self._slot(keys[left], bits, len(self.levels))
            first = np.unique(slot, return_index=True)[1]
            table, at = np.zeros(1 << bits, np.uint64), np.full(1 << bits, len(keys), np.int32)
            table[slot[first]], at[slot[first]] = keys[left[first]], left[first]
            left = np.delete(left, first)
            more = np.zeros(1 << bits, bool)
            more[self._slot(keys[left], bits, len(self.levels))] = True
            self.levels.append((bits, table, at, more))
            bits = max(10, bits - 3)

    @staticmethod
    def _slot(keys, bits: int, level: int):
        return ((keys ^ np.uint64(level)) * _SPREAD >> np.uint64(64 - bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Each key's place in `scores` and `ids`."""
        none = self.none
        out, look = np.full(len(keys), none, np.int32), None
        for level, (bits, table, at, more) in enumerate(self.levels):
            k = keys if look is None else keys[look]
            slot = self._slot(k, bits, level)
            hit = table[slot] == k
            got = np.where(hit, at[slot], none)
            if look is None:
                out, look = got, np.flatnonzero(more[slot] & ~hit)
            else:
                out[look] = got
                look = look[more[slot] & ~hit]
            if not len(look):
                break
        return out


def cut_words(pieces: Pieces, table: PieceTable, words: list[str], width: int) -> list[tuple[int, bytes]]:
    """(score, ids) of words of at most `width` characters."""
    n, length = len(words), np.array([len(w) for w in words])
    flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")
    place = np.arange(len(flat)) - np.repeat(np.cumsum(length) - length, length)
    chars = np.zeros((width, n), np.uint64)  # a row per place, so that steps go along memory
    chars[place, np.repeat(np.arange(n), length)] = flat
    inside = np.arange(width)[:, None] < length
    size = min(pieces.longest, width)
    piece = np.full((size + 1, width, n), table.none, np.int32)
    h = np.zeros((width, n), np.uint64)
    for k in range(1, size + 1):  # pieces of k characters, by the place where they start
        h = _hash_step(h[: width - k + 1], chars[k - 1 :])
        valid = inside[k - 1 :]
        piece[k, : width - k + 1][valid] = table.find(h[valid])
    missing = (piece[1] == table.none) & inside
    piece[1][missing] = table.unknown
    score, back = np.full((width + 1, n), NEVER, np.int64), np.zeros((width + 1, n), np.int8)
    score[0] = 0
    for end in range(1, width + 1):
        for k in range(min(size, end), 0, -1):  # the longest first, which equal sums keep
            s = score[end - k] + table.scores[piece[k, end - k]]
            better = s > score[end]
            score[end][better], back[end][better] = s[better], k
    starts = np.full((width, n), -1, np.int64)
    at, column = length.copy(), np.arange(n)
    while len(column := column[at[column] > 0]):
        k = back[at[column], column].astype(np.int64)
        at[column] -= k
        found = piece[k, at[column], column]
        starts[at[column], column] = np.where(found == table.unknown, -2, table.ids[found])
    ids = starts.T
    taken = ids != -1
    blob, ends = ids[taken].astype("<i4").tobytes(), np.cumsum(taken.sum(1)) * WIDTH
    total = score[length, np.arange(n)]
    cuts = [0, *ends.tolist()]
    out = [(t, blob[a:b]) for t, a, b in zip(total.tolist(), cuts, cuts[1:])]
    for k in np.flatnonzero(missing.any(0)).tolist():
        w = words[k]
        spelt = [pieces.fallback(w[p]) if i == -2 else [i] for p, i in enumerate(ids[k].tolist()) if i != -1]
        out[k] = out[k][0], array("I", [i for group in spelt for i in group]).tobytes()
    return out


class Encoder:
    def __init__(self, path: str):
        self.pieces = Pieces(path)
        self.table = PieceTable(self.pieces)
        self.words: dict[str, tuple[int, bytes]] = {}
        self.old: dict[str, tuple[int, bytes]] = {}

    def word(self, word: str) -> tuple[int, bytes]:
        """(score, ids) of a stretch between cuts."""
        score, ids = self.pieces.best(word)
        return score, array("I", ids).tobytes()

    def learn(self, words: set[str]) -> dict[str, tuple[int, bytes]]:
        """(score, ids) of all `words`: those not remembered are cut as arrays, by length. What is long isn't kept."""
        if len(self.words) >= MEMO_WORDS:
            self.old, self.words = self.words, {}
        known, old = self.words, self.old
        by_length: dict[int, list[str]] = {}
        longs: dict[str, tuple[int, bytes]] = {}
        for w in words.difference(known):
            if w in old:
                known[w] = old[w]
            elif len(w) > LENGTHS[-1]:
                (longs if len(w) > LONG else known)[w] = self.word(w)
            else:
                by_length.setdefault(bisect.bisect_left(LENGTHS, len(w)), []).append(w)
        for k, group in by_length.items():
            for a in range(0, len(group), ARRAY_WORDS):
                part = group[a : a + ARRAY_WORDS]
                known.update(zip(part, cut_words(self.pieces, self.table, part, LENGTHS[k])))
        return known if not longs else collections.ChainMap(longs, known)

    def cut_places(self, text: str, before: str) -> list[int]:
        """Places where every encoding cuts: a mark after something else."""
        if not self.pieces.cuts:
            return []
        out, at = [], text.find(MARK)
        while at >= 0:
            if (text[at - 1] if at else before) != MARK:
                out.append(at)
            at = text.find(MARK, at + 1)
        return out

    def stretches(self, text: str) -> list[str]:
        """A marked text between its cuts."""
        if not self.pieces.cuts:
            return [text]
        if MARK + MARK not in text:
            first, *rest = text.split(MARK)
            return ([first] if first else []) + [MARK + w for w in rest]
        places = self.cut_places(text, "")
        places = places if places and places[0] == 0 else [0, *places]
        return [text[a:b] for a, b in zip(places, [*places[1:], len(text)])]

    def encode(self, batch: list[str]) -> list[bytes]:
        """Ids of texts, each in one pass; in groups of bounded size, so that few distinct words are held at once."""
        out, group, size = [], [], 0
        for t in batch:
            group.append(self.stretches(MARK + t.replace(" ", MARK)) if t else [])
            size += len(t)
            if size > GROUP_CHARS:
                out += self._joined(group)
                group, size = [], 0
        return out + self._joined(group)

    def _joined(self, group: list[list[str]]) -> list[bytes]:
        known = self.learn(set().union(*group))
        return [b"".join([known[w][1] for w in words]) for words in group]

    def scored(self, text: str) -> tuple[int, bytes]:
        """(score, ids) of a text that begins and ends at cuts."""
        words = self.stretches(text)
        known = self.learn(set(words))
        return sum(known[w][0] for w in words), b"".join([known[w][1] for w in words])

    def parts(self, before: str, chunk: str) -> tuple[str, str, str] | None:
        """A chunk before its first cut, between its cuts, and from its last cut on; None without cuts."""
        places = self.cut_places(chunk, before[-1:])
        return (chunk[: places[0]], chunk[places[0] : places[-1]], chunk[places[-1] :]) if places else None

    def transfer(self, before: str, chunk: str) -> tuple[np.ndarray, bytes]:
        """([state on the left, state on the right] -> best score, ids between the cuts). A state is how many characters before
        the boundary the piece across it starts; such a piece is scored in the chunk where it ends."""
        p, n = self.pieces, len(chunk)
        size = p.longest
        out = np.full((size, size), NEVER, np.int64)
        parts = self.parts(before, chunk)
        if parts:
            head, middle, tail = parts
            score, ids = self.scored(middle) if middle else (0, b"")
            ends = p.ends(tail, 0)
            for d in range(min(size, len(before) + 1)):
                to_cut = self._to(before, head, d)
                if to_cut > NEVER:
                    out[d] = np.where(ends > NEVER, to_cut + score + ends, NEVER)
            return out, ids
        for d in range(min(size, len(before) + 1)):
            if d == 0:
                out[0] = p.ends(chunk, 0)
                continue
            text = before[len(before) - d :] + chunk
            score = [NEVER] * (len(text) + 1)
            for end, s, i in p.from_here(text, 0):
                if end > d:
                    score[end] = s
            for at in range(d + 1, len(text)):
                if score[at] > NEVER:
                    for end, s, i in p.from_here(text, at):
                        score[end] = max(score[end], score[at] + s)
            for e in range(size):
                if n - e > 0:
                    out[d, e] = score[len(text) - e]
        return out, b""

    def _to(self, before: str, head: str, d: int) -> int:
        """Best score from state d to the end of `head`, a cut."""
        if not head:
            return 0 if d == 0 else NEVER
        return self.pieces.best(before[len(before) - d :] + head if d else head, d, None, d > 0)[0]

    def trace(self, before: str, head: str, tail: str | None, middle: bytes, reach: np.ndarray, rights: int) -> list[tuple[int, bytes]]:
        """For each of the first `rights` states on the right: the state on the left that it comes from, -1 if there is none,
        and the ids of the pieces that end in the chunk. `reach`: the best scores of the text before, by state on the left; `middle`:
        the ids between the cuts; a chunk without cuts is all head, its tail None."""
        if tail is None:
            return self._traced(before, head, reach, range(rights))
        left, first = self._traced(before, head, reach, [0])[0]
        tails = self._traced("", tail, np.zeros(1, np.int64), range(rights))
        return [(left if d >= 0 else -1, first + middle + ids) for d, ids in tails]

    def _traced(self, before: str, part: str, reach: np.ndarray, rights) -> list[tuple[int, bytes]]:
        """The pass over a part without cuts, from all states on its left at once."""
        lead = min(len(reach) - 1, len(before))
        text, p = before[len(before) - lead :] + part, self.pieces
        score, back = [NEVER] * (len(text) + 1), [None] * (len(text) + 1)
        for d in range(lead + 1):
            score[lead - d] = int(reach[d])
        for at in range(len(text)):
            if score[at] > NEVER:
                for end, s, i in p.from_here(text, at):
                    if end > lead and score[at] + s > score[end]:
                        score[end], back[end] = score[at] + s, (at, i)
        out = []
        for r in rights:
            at, ids = len(text) - r, []
            if at < 0 or score[at] == NEVER:
                out.append((-1, b""))
                continue
            while at > lead:
                start, i = back[at]
                ids.append(p.fallback(text[start:at]) if i < 0 else [i])
                at = start
            out.append((lead - at, array("I", [i for group in reversed(ids) for i in group]).tobytes()))
        return out


def chunk_starts(marked: str, size: int, longest: int) -> list[int]:
    """Where chunks of about `size` characters start: at a cut in the second half of each if there is one. None is
    shorter than the longest piece, but for a text that is."""
    starts = [0]
    while len(marked) - starts[-1] > size + longest:
        low, high = starts[-1] + max(size // 2, longest), starts[-1] + max(size, longest)
        at = marked.rfind(MARK, low, high + 1)
        while at > low and marked[at - 1] == MARK:
            at -= 1
        starts.append(at if at > low else high)
    return starts


def combined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product of stacks of matrices."""
    s = a[..., :, :, None] + b[..., None, :, :]
    return np.maximum(np.where((a[..., :, :, None] > NEVER) & (b[..., None, :, :] > NEVER), s, NEVER).max(-2), NEVER)


def prefixes(m: np.ndarray) -> np.ndarray:
    """Products of the first 1, 2, ... matrices of a stack, by a scan of logarithmic depth."""
    out, step = m.copy(), 1
    while step < len(out):
        out[step:] = combined(out[:-step], out[step:].copy())
        step *= 2
    return out


def reaches(m: np.ndarray) -> np.ndarray:
    """The best scores before each chunk of a stack of transfer matrices, from state 0: a scan within blocks, each of which
    goes on from the row that the block before it reached."""
    size = m.shape[1]
    row = np.full(size, NEVER, np.int64)
    row[0] = 0
    out = [row]
    for at in range(0, len(m), SCAN_BLOCK):
        for product in prefixes(m[at : at + SCAN_BLOCK]):
            out.append(combined(row[None, :], product)[0])
        row = out[-1]
    return np.stack(out[:-1])


@functools.lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    return Encoder(path)


class Decoder:
    """Texts of ids: bytes are put together, marks become blanks, the one put first goes."""

    def __init__(self, pieces: Pieces):
        self.byte_of, n = pieces.byte_of, len(pieces.strings)
        shown = ["" if i in pieces.silent else s.replace(MARK, " ") for i, s in enumerate(pieces.strings)]
        self.strings = np.array(shown, object)
        self.is_byte = np.zeros(n, bool)
        self.is_byte[list(self.byte_of)] = True

    def text(self, ids: bytes) -> str:
        found = np.frombuffer(ids, "<u4")
        strings, single = self.strings[found], self.is_byte[found]
        if single.any():  # each run of byte pieces is decoded where it starts
            at = np.flatnonzero(single)
            strings[at] = ""
            for run in np.split(at, np.flatnonzero(np.diff(at) > 1) + 1):
                strings[run[0]] = bytes(self.byte_of[i] for i in found[run].tolist()).decode("utf-8", "replace").replace(MARK, " ")
        text = "".join(strings.tolist())
        return text[1:] if text.startswith(" ") else text


@functools.lru_cache(maxsize=1)
def decoder(path: str) -> Decoder:
    return Decoder(Pieces(path))


RESULT = "doc_id long, text string, ids binary"


def _encode_giants(docs: DataFrame, path: str, chunk_chars: int) -> DataFrame:
    """Documents of several chunks: chunks dealt over all tasks, matrices scanned per document, chunks traced back. `inside`:
    the chunk ends where no cut is certain, so that several states on its right can be."""
    pieces = Pieces(path)
    longest, always = pieces.longest, pieces.cuts

    def cut(batches):
        for batch in slices(batches):
            for key, doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                marked = MARK + text.replace(" ", MARK)
                starts = chunk_starts(marked, chunk_chars, longest)
                ends = [*starts[1:], len(marked)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key] * len(starts)), pa.array([doc_id] * len(starts), pa.int64()), pa.array(range(len(starts)), pa.int32()),
                     pa.array([marked[max(0, a - longest + 1) : a] for a in starts]), pa.array([marked[a:b] for a, b in zip(starts, ends)]),
                     pa.array([not (e == len(marked) or always and marked[e] == MARK and marked[e - 1] != MARK) for e in ends]),
                     pa.array([text] + [None] * (len(starts) - 1), pa.string())],
                    names=["key", "doc_id", "chunk", "before", "part", "inside", "text"],
                )

    keyed = docs.select(F.monotonically_increasing_id().alias("key"), "doc_id", "text")
    schema = "key long, doc_id long, chunk int, before string, part string, inside boolean, text string"
    chunks = stored(keyed.mapInArrow(cut, schema), "sp-chunks", "zstd")
    dealt = chunks.select("key", "chunk", "before", "part", "inside").repartition("key", "chunk")

    def matrices(batches):
        """Each chunk's words are cut here, once; what is left to trace is before its first cut and after its last."""
        for batch in batches:
            out = [[], [], [], []]
            for b, c in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                m, middle = encoder(path).transfer(b, c)
                parts = encoder(path).parts(b, c)
                for column, value in zip(out, (m.tobytes(), parts[0] if parts else c, parts[2] if parts else None, middle)):
                    column.append(value)
            kinds = (pa.binary(), pa.string(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *(pa.array(x, k) for x, k in zip(out, kinds)), batch.column(2), batch.column(4)],
                                             names=["key", "chunk", "m", "head", "tail", "middle", "before", "inside"])

    schema = "key long, chunk int, m binary, head string, tail string, middle binary, before string, inside boolean"
    cut_chunks = stored(dealt.mapInArrow(matrices, schema), "sp-matrices", "zstd")

    def scan(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("chunk")
        m = np.frombuffer(b"".join(rows["m"].to_pylist()), np.int64).reshape(len(rows), longest, longest)
        return pa.table([rows["key"], rows["chunk"], pa.array([r.tobytes() for r in reaches(m)], pa.binary())], names=["key", "chunk", "reach"])

    before = cut_chunks.select("key", "chunk", "m").groupBy("key").applyInArrow(scan, "key long, chunk int, reach binary")

    def trace(batches):
        for batch in batches:
            key, chunk, right, left, ids = [], [], [], [], []
            for k, c, b, head, tail, middle, inside, reach in zip(*(x.to_pylist() for x in batch.columns)):
                for r, (d, got) in enumerate(encoder(path).trace(b, head, tail, middle, np.frombuffer(reach, np.int64), longest if inside else 1)):
                    if d >= 0:
                        for column, value in zip((key, chunk, right, left, ids), (k, c, r, d, got)):
                            column.append(value)
            columns = [pa.array(key, pa.int64()), *(pa.array(x, pa.int32()) for x in (chunk, right, left)), pa.array(ids, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "chunk", "right", "left", "ids"])

    joined = cut_chunks.join(before, ["key", "chunk"]).select("key", "chunk", "before", "head", "tail", "middle", "inside", "reach")
    traced = joined.mapInArrow(trace, "key long, chunk int, right int, left int, ids binary")

    def together(rows: pa.Table) -> pa.Table:
        """From the end: the pieces of each chunk for the state on its right."""
        of = {(c, r): (d, k) for k, (c, r, d) in enumerate(zip(*(rows[n].to_pylist() for n in ("chunk", "right", "left"))))}
        state, picked = 0, []
        for c in range(max(c for c, _ in of), -1, -1):
            state, k = of[c, state]
            picked.append(k)
        return pa.table([rows["key"][:1], pa.array([b"".join(rows["ids"][k].as_py() for k in reversed(picked))])], names=["key", "ids"])

    ids = traced.groupBy("key").applyInArrow(together, "key long, ids binary")
    return chunks.where("chunk = 0").select("key", "doc_id", "text").join(ids, "key").select("doc_id", "text", "ids")


def encode(docs: DataFrame, model_path: str | None = None, chunk_chars: int = CHUNK_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, ids) with ids as little-endian unsigned 32-bit. Only documents of several chunks are shuffled."""
    path, docs = model_path or tokenizer_path("piece_bpe_32k.model"), texts(docs, id_col, text_col)

    def scan(batches):
        for batch in slices(batches):
            ids = encoder(path).encode(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.binary())], names=["doc_id", "text", "ids"])

    giant = F.length("text") > 2 * chunk_chars
    return docs.where(~giant).mapInArrow(scan, RESULT).unionByName(_encode_giants(docs.where(giant), path, chunk_chars))


def decode(encoded: DataFrame, model_path: str | None = None) -> DataFrame:
    """All columns, and `decoded`, the text of `ids`."""
    path, names = model_path or tokenizer_path("piece_bpe_32k.model"), encoded.columns

    def scan(batches):
        for batch in slices(batches):
            out = [decoder(path).text(b) for b in batch.column(names.index("ids")).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=[*names, "decoded"])

    return encoded.mapInArrow(scan, encoded.selectExpr("*", "cast(null as string) as decoded").schema)


__all__ = ["Encoder", "Pieces", "combined", "decode", "encode", "prefixes", "reaches"]
