"""Logistic mixing of bit predictors over a text's words.

A token (a word, an escape for a rare word, or the text's end) is a path of bits in a prefix code. For each bit, predictors
look up counts of the place in the code under contexts: the commonest of the last words, which tells languages and
subjects apart; the word before; and the two words before. Their stretched probabilities are summed under weights
that a gate chooses (how well the two-word context is known), squashed, and refined by an adaptive probability map. Weights
and map are learned online along each text, in blocks that begin small: a text starts from the same state wherever it lies.
"""

from __future__ import annotations

from functools import cached_property

import numpy as np

#: Levels of the code that tables hold; deeper bits, of rare words, are known from two-word contexts only.
DEPTH, PREVIOUS_DEPTH = 16, 10
#: Commonest words that are contexts of their own, as topic and as word before.
TOPICS, PREVIOUS = 32, 512
WINDOW = 16
MAX_LENGTH = 48
#: Whole numbers up to this one are exact in single precision.
SINGLE = 1 << 24
#: Added to counts, and what makes few of them unsure: of single contexts, and of two words, where one sight tells much.
DELTA, UNSURE, PAIR_DELTA, PAIR_UNSURE = 0.4, 0.8, 0.05, 0.4
BUCKETS, MAP_WEIGHT = 25, 20.0  # an odd number: no evidence is a bucket of its own, and costs a bit
FIRST_BLOCK, RATE = 16, 3.0
#: Initial weights by gate, of the three predictors in the order above.
WEIGHTS = np.array([[0.8, 0.35, 0.0], [0.7, 0.3, 0.6], [0.5, 0.2, 0.7], [0.4, 0.15, 0.8]], np.float32)
GATES, PREDICTORS = WEIGHTS.shape


def code_length(weight: np.ndarray, total: float) -> np.ndarray:
    """Bits of a symbol's code by its weight, so that the codes of all weights fit."""
    return np.clip(np.ceil(np.log2(total / np.maximum(weight, 1)) - 1e-9), 1, MAX_LENGTH).astype(np.int64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(32))


def pair_contexts(code: np.ndarray, place: np.ndarray) -> np.ndarray:
    """A hash of the two tokens before each; `place`: a token's place in its text."""
    one, two = np.zeros(len(code), np.uint64), np.zeros(len(code), np.uint64)
    one[1:] = np.where(place[1:] >= 1, code[:-1] + np.uint64(1), np.uint64(0))
    two[2:] = np.where(place[2:] >= 2, code[:-2] + np.uint64(1), np.uint64(0))
    return mixed(mixed(two + np.uint64(0x9E3779B97F4A7C15)) + one) >> np.uint64(16) << np.uint64(16)  # 48 bits are told apart


def topics(rank: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The smallest rank (of common words, from 1) among the words of a window before each token, TOPICS if none is below."""
    best = np.full(len(rank), TOPICS, np.int32)
    for k in range(1, WINDOW + 1):
        best[k:] = np.where(place[k:] >= k, np.minimum(best[k:], rank[:-k]), best[k:])
    return best


def previous(rank: np.ndarray, place: np.ndarray) -> np.ndarray:
    out = np.full(len(rank), PREVIOUS, np.int32)
    out[1:] = np.where(place[1:] >= 1, np.minimum(rank[:-1], PREVIOUS), PREVIOUS)
    return out


def table(context: np.ndarray, code: np.ndarray, contexts: int, depth: int) -> np.ndarray:
    """Counts of the code's prefixes of `depth` bits under each context."""
    prefix = (code >> np.uint64(64 - depth)).astype(np.int64)
    return np.bincount(context.astype(np.int64) << depth | prefix, minlength=contexts << depth).reshape(contexts, 1 << depth)


def with_inner_nodes(leaves: np.ndarray) -> np.ndarray:
    """(contexts, 2 << depth): counts of all nodes, of which node i has the children 2 i and 2 i + 1."""
    levels = [leaves]
    while levels[-1].shape[1] > 1:
        levels.append(levels[-1].reshape(len(leaves), -1, 2).sum(2))
    return np.concatenate([np.zeros((len(leaves), 1), leaves.dtype), *reversed(levels)], 1)


def narrowed(counts: np.ndarray) -> np.ndarray:
    """The same numbers in the narrowest unsigned type that holds them all."""
    most = int(counts.max(initial=0))
    return counts.astype(next(t for t in (np.uint16, np.uint32, np.uint64) if most <= np.iinfo(t).max), copy=False)


def node_counts(context: np.ndarray, code: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(levels, counts) for entries sorted by context and code: how many levels of each are listed, and one after another
    the counts in its context of its code's prefixes of 0, 1, ... bits, ending with the first that the entry alone makes up."""
    size = len(code)
    at, level, kind = np.arange(size), 0, None
    listed, place, value = np.zeros(size, np.int64), [], []
    same = np.concatenate([[False], context[1:] == context[:-1]])
    while len(at) and level <= MAX_LENGTH:
        if level:
            prefix = code[at] >> np.uint64(64 - level)
            same = np.concatenate([[False], same[1:] & (prefix[1:] == prefix[:-1])])
        start = np.flatnonzero(~same)
        total = np.add.reduceat(n[at], start)
        count = np.repeat(total, np.diff(np.append(start, len(at))))
        kind = kind or narrowed(total).dtype  # a context's total is its largest count
        listed[at] = level + 1
        place.append(at)
        value.append(count.astype(kind))
        # an entry goes on while others are with it; groups go on as a whole
        width = np.repeat(np.diff(np.append(start, len(at))), np.diff(np.append(start, len(at))))
        keep = width > 1
        at, same = at[keep], same[keep]
        level += 1
    place, value = np.concatenate([np.zeros(0, np.int64), *place]), np.concatenate([np.zeros(0, kind or np.uint16), *value])
    return listed, value[np.argsort(place, kind="stable")]


def ordered(context: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Places by context (of 48 bits, above 16 that are free), then code; those with both alike in any order. One sort by the context and the
    code's first bits does for nearly all; the few codes that differ behind these are put right."""
    key = context | code >> np.uint64(48)
    order = np.argsort(key)
    key, value = key[order], code[order]
    alike = key[1:] == key[:-1]
    wrong = np.flatnonzero(alike & (value[1:] < value[:-1]))
    if len(wrong):
        run = np.cumsum(np.concatenate([[False], ~alike]))
        some = np.zeros(run[-1] + 1, bool)
        some[run[wrong]] = True
        at = np.flatnonzero(some[run])
        order[at] = order[at][np.lexsort((value[at], run[at]))]
    return order


def own_counts(doc: np.ndarray, pair: np.ndarray, context: np.ndarray, code: np.ndarray):
    """The same for a text's own tokens, texts lying one after another: counts in their own text, in the tokens' order. `pair`: numbers of
    the pairs of context and code, in that order."""
    if not len(doc):
        return *node_counts(context, code, np.zeros(0, np.int64)), np.zeros(0, np.int64)
    text, low, middle = (doc - doc[0]).astype(np.uint64), len(doc).bit_length(), int(pair.max()).bit_length()
    if int(text[-1]).bit_length() + middle + low <= 64:
        key = np.sort((text << np.uint64(middle) | pair.astype(np.uint64)) << np.uint64(low) | np.arange(len(doc), dtype=np.uint64))
        order = (key & np.uint64((1 << low) - 1)).astype(np.int64)
    else:
        order = np.lexsort((pair, doc))
    doc, pair, context = doc[order], pair[order], context[order]
    # equal codes are one entry
    other = doc[1:] != doc[:-1]
    first = np.concatenate([[True], other | (pair[1:] != pair[:-1])])
    start = np.flatnonzero(first)
    n = np.diff(np.append(start, len(order)))
    own = np.cumsum(np.concatenate([[False], other | (context[1:] != context[:-1])]))
    listed, value = node_counts(own[start], code[order][start], n)
    entry = np.empty(len(order), np.int64)
    entry[order] = np.repeat(np.arange(len(start)), n)
    return listed, value, entry


def evidence(same: np.ndarray, other: np.ndarray, delta: float = DELTA, unsure: float = UNSURE) -> np.ndarray:
    """A predictor's log odds of the bit that comes, from counts of it and of the other; less of them where little was seen."""
    n = same + other
    return np.log((same + np.float32(delta)) / (other + np.float32(delta))) * (n / (n + np.float32(unsure)))


def node_evidence(counts: np.ndarray) -> np.ndarray:
    """For each context and node the evidence of coming from its parent to it: first for other texts' tokens, then for tokens
    that are counted themselves."""
    same = counts.astype(np.float32)
    other = same.reshape(-1, 2)[:, ::-1].reshape(same.shape)
    return np.stack([evidence(same, other), evidence(np.maximum(same - 1, 0), other)]).reshape(-1)


class Tables:
    """What topics and words before say of every node."""

    def __init__(self, topic_leaves: np.ndarray, previous_leaves: np.ndarray):
        self.topic, self.before = node_evidence(with_inner_nodes(topic_leaves)), node_evidence(with_inner_nodes(previous_leaves))
        self.contexts = len(topic_leaves), len(previous_leaves)


class Paths:
    """What is known of each token of some texts: its code, contexts, and counts in its two-word context without its own text."""

    def __init__(self, code, length, topic, before, train, levels, first, counts, own_levels, own_first, own):
        self.code, self.length, self.topic, self.before, self.train = code, length, topic, before, train
        self.levels, self.first, self.counts = levels, first, counts
        self.own_levels, self.own_first, self.own = own_levels, own_first, own

    @cached_property
    def kind(self):
        """The type that holds all counts exactly."""
        return np.float32 if self.counts.itemsize == 2 or self.counts.max(initial=0) <= SINGLE else np.float64

    def pair_counts(self, t: np.ndarray):
        """Counts along the paths of the tokens `t`, which have listed levels."""
        return Counted(self, t)


class Counted:
    """Counts of the prefixes of some tokens' codes: beyond the listed levels the last one stands. Where single precision doesn't hold
    them all they are in double precision, so that a bit's two counts add up."""

    def __init__(self, paths: Paths, t: np.ndarray):
        self.kind, self.counts, self.own, mine = paths.kind, paths.counts, paths.own, paths.own_levels[t]
        # a token without own counts looks at the zero that ends them
        self.first, self.top = paths.first[t], paths.levels[t] - 1
        self.own_first, self.own_top = np.where(mine > 0, paths.own_first[t], len(self.own) - 1), np.maximum(mine, 1) - 1

    def keep(self, at: np.ndarray) -> None:
        """Only these tokens from now on."""
        self.first, self.top, self.own_first, self.own_top = self.first[at], self.top[at], self.own_first[at], self.own_top[at]

    def __call__(self, k: int, level: int) -> np.ndarray:
        """Of prefixes of `level` bits, for the first k tokens."""
        at = np.minimum(self.top[:k], level)
        at += self.first[:k]
        n = self.counts.take(at).astype(self.kind)
        np.minimum(self.own_top[:k], level, out=at)
        at += self.own_first[:k]
        n -= self.own.take(at)
        return np.maximum(n, 0, out=n)


def squash(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-z))


def blocks(sizes: np.ndarray):
    """For each step (texts that have it, its first place, its end): blocks of a text double in length."""
    at, width = 0, FIRST_BLOCK
    while (going := np.flatnonzero(sizes > at)).size:
        yield going, at, np.minimum(sizes[going], at + width)
        at, width = at + width, width * 2 if at else width


_GATE = np.minimum(np.ceil(np.log2(np.arange(6) + 1)), GATES - 1).astype(np.intp)


def bits(paths: Paths, tables: Tables, sizes: np.ndarray, weights: np.ndarray = WEIGHTS) -> np.ndarray:
    """Bits of each token of texts of these sizes, which lie one after another. Each text learns weights of its own on the
    way, and a map from the mixed to a refined probability; what a block teaches is used from the next block on.

    Everything is told from the bit that comes: evidence for it has a positive sign, and the map, in which a bucket of evidence
    and its mirror image make one, counts what came."""
    out, n = np.zeros(len(paths.code), np.float64), len(sizes)
    starts = np.cumsum(sizes) - sizes
    change = np.zeros((PREDICTORS, n), np.float32)
    centre = squash((np.arange(BUCKETS, dtype=np.float32) + 0.5) * (24 / BUCKETS) - 12)
    came = np.tile(MAP_WEIGHT * centre, n).astype(np.float32)
    flat = [(tables.topic, paths.topic, tables.contexts[0], 2 << DEPTH, DEPTH), (tables.before, paths.before, tables.contexts[1], 2 << PREVIOUS_DEPTH, PREVIOUS_DEPTH)]
    last = PREDICTORS - 1
    of_gate = [np.ascontiguousarray(weights[:, k] - (weights[0, k] if k < last else 0)) for k in range(PREDICTORS)]
    for going, first, end in blocks(sizes):
        count = end - first
        t = np.repeat(starts[going] + first, count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        order = np.argsort((MAX_LENGTH - paths.length[t]).astype(np.uint8), kind="stable")  # those that go on stand in front
        t, who = t[order], np.repeat(going, count)[order]
        length, own = paths.length[t], paths.train[t].astype(np.int64)
        longer = len(t) - np.cumsum(np.bincount(length, minlength=MAX_LENGTH + 1))  # tokens with more bits than each level
        prefix = (paths.code[t] >> np.uint64(64 - DEPTH)).astype(np.int64)
        rows = [(own * contexts + context[t]) * width for _, context, contexts, width, _ in flat]
        # chances are multiplied along a token's bits, each at least 1e-6, and their logarithm is taken once; gradients are added up
        # by token and then by text
        block, chance, slope = np.zeros(len(t), np.float32), np.ones(len(t)), np.zeros((PREDICTORS, len(t)), np.float32)
        # below the tables nothing is known without a two-word context, and a bit costs a bit
        lone = paths.levels[t] == 0
        block[lone] = np.maximum(length[lone] - DEPTH, 0)
        pair = np.flatnonzero(~lone)
        learned = np.zeros(len(came))
        seen = np.bincount(who, weights=np.minimum(length, DEPTH), minlength=n)
        counted = paths.pair_counts(t[pair])
        parent = counted(len(pair), 0)
        paired, who_pair, slope_pair = pair, who[pair], np.zeros(len(pair))
        each, base_of = weights[0][:, None] + change, who * BUCKETS
        mapped = came.reshape(n, BUCKETS)
        mapped = (np.float32(0.5) * (mapped / (mapped + mapped[:, ::-1]))).reshape(-1)
        for level in range(int(length[0])):
            m = int(longer[level])
            keep = int(np.searchsorted(pair, m))
            pair, parent = pair[:keep], parent[:keep]
            known = parent > 0
            if 4 * (alive := np.count_nonzero(known)) < 3 * keep:
                # what has a count of nothing has no evidence on any further bit
                slope[last, paired], on = slope_pair, np.flatnonzero(known)
                counted.keep(on)
                block[pair[~known]] += np.maximum(length[pair[~known]] - max(level, DEPTH), 0)
                paired = pair = pair[on]
                parent, who_pair, slope_pair, keep, known = parent[on], who_pair[on], slope_pair[on], alive, np.ones(alive, bool)
            child = np.minimum(counted(keep, level + 1), parent)
            if level < DEPTH:
                some, base, spot, up, down, here = who[:m], base_of[:m], pair, parent, child, slice(0, m)
                some_pair, in_pair = who_pair[:keep], slice(0, keep)
                node = prefix[:m] >> (DEPTH - 1 - level)
                node |= 2 << level
                x = [counts.take(row[:m] + node) for (counts, *_, depth), row in zip(flat, rows) if level < depth]
                z = each[0].take(some)
                z *= x[0]
                for k in range(1, len(x)):
                    z += each[k].take(some) * x[k]
            else:
                block[pair[~known]] += 1
                at_pair, up, down = pair[known], parent[known], child[known]
                some, base, spot, x, here = who[at_pair], base_of[at_pair], slice(None), [], at_pair
                some_pair, in_pair = some, np.flatnonzero(known)
                z = np.zeros(len(some), np.float32)
            if not len(some):
                parent = child
                continue
            if len(up):
                of_pair = evidence(down, up - down, PAIR_DELTA, PAIR_UNSURE)
                gate = _GATE.take(np.minimum(up, 5).astype(np.int64))
                more = of_gate[last].take(gate)
                more += change[last].take(some_pair)
                more = more * of_pair
                for k in range(len(x)):
                    more += of_gate[k].take(gate) * x[k][spot]
                z[spot] += more
            p = squash(z)
            at = np.clip(z, np.float32(-11.99), np.float32(11.99))
            at += np.float32(12)
            at *= np.float32(BUCKETS / 24)
            at = at.astype(np.int64)
            at += base
            chance[here] *= np.maximum(np.float32(0.5) * p + mapped.take(at), np.float32(1e-6))
            if level >= DEPTH:
                seen += np.bincount(some, minlength=n)
            error = np.subtract(1, p, out=p)
            for k in range(len(x)):
                slope[k, here] += np.multiply(error, x[k], out=x[k])
            if len(up):
                slope_pair[in_pair] += error[spot] * of_pair
            learned += np.bincount(at, minlength=len(came))
            parent = child
        out[t] = block - np.log2(chance)
        slope[last, paired] = slope_pair
        gradient = np.stack([np.bincount(who, weights=s, minlength=n) for s in slope])
        change += (RATE * gradient / (seen + 200.0)).astype(np.float32)
        came += learned.astype(np.float32)
    return out
