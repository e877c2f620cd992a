"""Logistic context mixing over the bits of spelt words.

A word, closed by a blank, is a sequence of bytes, and each byte a path of bits in a prefix code. For each bit,
predictors look up counts under hashed contexts (the last 1, 2, 3, 4, 6 and 8 bytes of the word, with the place in
the code). Their stretched probabilities are summed under weights that a gate chooses (how many contexts have been
seen), and squashed. Counts are those of all training words, each once, and a training word is spelt from counts without
itself; the weights are the same for every corpus. Nothing depends on the order or division of the words. The tables' size
follows from the number of words, up to `MOST_BITS`.
"""

from __future__ import annotations

import heapq

import numpy as np

ORDERS = (1, 2, 3, 4, 6, 8)
#: Slots of a context's table, as a power of two: four for each word, between these bounds (2^21 slots of 6 contexts are 50 MB).
LEAST_BITS, MOST_BITS = 16, 21
GATES = len(ORDERS) + 1
#: Weights by gate, of the orders above.
WEIGHTS = np.array(
    [[0.3, 0.3, 0.3, 0.3, 0.3, 0.3], [0.6, 0.3, 0.3, 0.3, 0.3, 0.0], [0.55, 0.55, 0.15, 0.0, 0.0, 0.0], [0.4, 0.55, 0.2, 0.0, 0.0, 0.0],
     [0.3, 0.5, 0.3, 0.25, 0.0, 0.0], [0.2, 0.25, 0.4, 0.4, 0.2, 0.0], [0.0, 0.1, 0.25, 0.4, 0.3, 0.1]], np.float32
)
CLOSE, END = 0x20, 0xFF  # neither byte occurs in a word of valid UTF-8
BATCH_BYTES = 60_000
DELTA = 0.15


def slot_bits(n_words: int) -> int:
    return min(MOST_BITS, max(LEAST_BITS, (4 * n_words).bit_length()))


class Code:
    """A prefix code of bytes: for each byte its length, the nodes on its path and the bits taken there."""

    def __init__(self, weights: np.ndarray):
        heap = [(float(w) + 1e-3, b, b) for b, w in enumerate(weights)]
        heapq.heapify(heap)
        children, node = {}, 256
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            children[node] = (a[2], b[2])
            heapq.heappush(heap, (a[0] + b[0], node, node))
            node += 1
        paths, stack = {}, [(node - 1, ())]
        while stack:
            at, path = stack.pop()
            if at < 256:
                paths[at] = path
            else:
                stack += [(c, (*path, (at - 256, bit))) for bit, c in enumerate(children[at])]
        self.length = np.array([len(paths[b]) for b in range(256)])
        self.first = np.concatenate([[0], np.cumsum(self.length)[:-1]])
        flat = np.array([step for b in range(256) for step in paths[b]])
        self.nodes, self.bits = flat[:, 0].astype(np.uint32), flat[:, 1].astype(np.int8)


def batches(words: list[bytes]):
    """Lists of words of bounded total length."""
    group, size = [], 0
    for w in words:
        group.append(w)
        size += len(w) + 1
        if size >= BATCH_BYTES:
            yield group
            group, size = [], 0
    if group:
        yield group


class Events:
    """The bits of a batch of words: their owner, node, value and, for each order, the slot of their context."""

    def __init__(self, words: list[bytes], code: Code, slot_bits: int):
        flat = np.frombuffer(bytes([CLOSE]).join(words) + bytes([CLOSE]), np.uint8)
        length = np.array([len(w) + 1 for w in words])
        start = np.repeat(np.cumsum(length) - length, length)
        place = np.arange(len(flat)) - start
        owner = np.repeat(np.arange(len(words)), length)
        per = code.length[flat]
        rep = np.repeat(np.arange(len(flat)), per)
        step = np.arange(len(rep)) - np.repeat(np.cumsum(per) - per, per) + code.first[flat][rep]
        self.node, self.bit, self.owner, self.n = code.nodes[step], code.bits[step], owner[rep], len(words)
        salt = (self.node + np.uint32(1)) * np.uint32(0x9E3779B1)
        h = np.full(len(flat), 0x811C9DC5, np.uint32)
        self.slots = []
        for k in range(1, max(ORDERS) + 1):
            before = np.where(place >= k, np.roll(flat, k), np.uint8(CLOSE)).astype(np.uint32)
            h = (h ^ before) * np.uint32(0x01000193)
            h ^= h >> np.uint32(15)
            if k in ORDERS:
                mixed = h.take(rep)
                mixed += salt
                mixed *= np.uint32(0x85EBCA6B)
                mixed ^= mixed >> np.uint32(13)
                mixed *= np.uint32(0xC2B2AE35)
                mixed >>= np.uint32(32 - slot_bits)
                self.slots.append(mixed.astype(np.int64))


_LOG = np.log(np.arange(256) + DELTA).astype(np.float32)
_SURE = (np.arange(512) / (np.arange(512) + 0.6)).astype(np.float32)


def _evidence() -> tuple[np.ndarray, np.ndarray]:
    """What a slot's two counts, as one number, say of a bit, and whether it was seen: for the bit 0 and 1, and then for these where
    a word's own are left out. Of scaled counts they are no measurable part."""
    pair = np.arange(1 << 16, dtype=np.uint16).view(np.uint8).reshape(-1, 2).astype(np.int64)
    x, seen = [], []
    for own in (0, 1):
        for bit in (0, 1):
            same, other = pair[:, bit], pair[:, 1 - bit]
            same = np.maximum(same - (own & (np.maximum(same, other) < 255)), 0)
            x.append((_LOG[same] - _LOG[other]) * _SURE[same + other])
            seen.append(same + other > 0)
    return np.concatenate(x), np.concatenate(seen).astype(np.int8)


_EVIDENCE, _SEEN = _evidence()


def squash(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -16, 16)))


def count(words: list[bytes], code: Code, counts: np.ndarray) -> None:
    """Add the bits of distinct words to `counts` (orders, two for each slot)."""
    slots_bits = counts.shape[1].bit_length() - 2
    for group in batches(words):
        e = Events(group, code, slots_bits)
        for k, slots in enumerate(e.slots):
            np.add.at(counts[k], slots * 2 + e.bit, counts.dtype.type(1))


def scaled(counts: np.ndarray) -> np.ndarray:
    """Counts in bytes. Where one of a context's two is above 255, both are scaled down together, rounded up, so that their odds
    stay and none that was seen vanishes."""
    pairs = counts.reshape(-1, 2)
    most = np.maximum(pairs.max(1, keepdims=True), 255)
    return (-(-pairs * 255 // most)).astype(np.uint8).reshape(counts.shape)


class Model:
    """Everything that spelling needs. `counts`: (orders, two for each slot), as `scaled` gives them."""

    def __init__(self, code: Code, counts: np.ndarray):
        self.code, self.counts, self.slot_bits = code, counts, counts.shape[1].bit_length() - 2

    def event_bits(self, group: list[bytes], counted: np.ndarray):
        """(events, bits that each costs): a predictor's evidence is its log odds of the bit that comes, less of them where
        little was seen, without the word's own bits where it is counted; the gate is how many contexts have been seen."""
        e = Events(group, self.code, self.slot_bits)
        of = (counted[e.owner].astype(np.int64) << 1 | e.bit) << 16
        x, gate = np.empty((len(ORDERS), len(of)), np.float32), np.zeros(len(of), np.int8)
        for k, slots in enumerate(e.slots):
            at = self.counts[k].view(np.uint16).take(slots) | of
            _EVIDENCE.take(at, out=x[k], mode="clip")
            gate += _SEEN.take(at)
        gate = gate.astype(np.int64)
        z = np.zeros(len(of), np.float32)
        for k in range(len(ORDERS)):
            z += WEIGHTS[:, k].take(gate) * x[k]
        return e, -np.log2(np.clip(squash(z), 1e-6, 1 - 1e-6))

    def bits(self, words: list[bytes], counted: np.ndarray) -> np.ndarray:
        """Bits that spell each word; `counted` says which of them are in the counts."""
        out, first = [], 0
        for group in batches(words):
            e, cost = self.event_bits(group, counted[first : first + len(group)])
            first += len(group)
            out.append(np.bincount(e.owner, weights=cost, minlength=e.n))
        return np.concatenate(out) if out else np.zeros(0)
