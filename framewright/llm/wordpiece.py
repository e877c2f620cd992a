"""Token counts by a linear longest-match automaton.

Greedy word-piece splitting of a word in time linear in its length: a trie of the vocabulary whose nodes
carry failure links and the number of pieces that following such a link pops, so that a word's piece count
comes out of one pass over its bytes and no piece is ever built.

A word that no longer initial piece fits starts with the bare blank's piece, if the vocabulary has it. A word that the
vocabulary cannot spell counts as one unknown token. Null and empty texts count 0 words; a very long text or word takes one
pass like any other; repeated rows are counted each, an empty table gives no row, other columns are not read.
"""

from __future__ import annotations

import functools
import json

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import Memo, slices, texts, tokenizer_path

MEMO_WORDS = 300_000


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: character -> byte, by their public rule."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class LongestMatch:
    """The automaton. `initial`: pieces that may start a word (an empty one is the mark of a start alone, a piece that
    holds none of the word's bytes); `inner`: pieces that may follow."""

    def __init__(self, initial, inner):
        self.child: list[dict[int, int]] = [{}, {}]  # node 0: start of a word, node 1: after a piece
        self.bare, final = b"" in initial, set()
        for root, pieces in ((0, initial), (1, inner)):
            for piece in pieces:
                if piece:
                    node = root
                    for b in piece:
                        node = self.child[node][b] if b in self.child[node] else self._grow(node, b)
                    final.add(node)
        self._link(final)

    def _grow(self, node: int, b: int) -> int:
        self.child[node][b] = new = len(self.child)
        self.child.append({})
        return new

    def _link(self, final: set[int]) -> None:
        """Failure links, breadth first, and for each the count of pieces popped on the way."""
        n = len(self.child)
        self.fail, self.popped = [-1] * n, [0] * n
        if self.bare:
            self.fail[0], self.popped[0] = 1, 1
        queue = [(0, b, v) for b, v in self.child[0].items()] + [(1, b, v) for b, v in self.child[1].items()]
        for u, b, v in queue:
            if v in final:
                self.fail[v], self.popped[v] = 1, 1
            else:
                z, count = self.fail[u], self.popped[u]
                while z >= 0 and b not in self.child[z]:
                    count += self.popped[z]
                    z = self.fail[z]
                if z >= 0:
                    self.fail[v], self.popped[v] = self.child[z][b], count
            queue += [(v, c, w) for c, w in self.child[v].items()]

    def count(self, word: bytes) -> int:
        """Pieces of the greedy longest-match split; 0 if the word cannot be spelt."""
        node, pieces, child, fail, popped = 0, 0, self.child, self.fail, self.popped
        for b in word:
            while b not in child[node]:
                pieces += popped[node]
                node = fail[node]
                if node < 0:
                    return 0
            node = child[node][b]
        while node > 1:
            pieces += popped[node]
            node = fail[node]
        return pieces if node == 1 else 0


def split_vocabulary(path: str) -> tuple[list[bytes], list[bytes]]:
    """Word-initial pieces (those written with the space's stand-in, without it) and inner ones of a byte-level vocabulary."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    to_byte = byte_alphabet()
    initial, inner = [], []
    for piece in model["vocab"]:
        if all(c in to_byte for c in piece):
            raw = bytes(to_byte[c] for c in piece)
            if raw.startswith(b" "):
                initial.append(raw[1:])
            else:
                inner.append(raw)
    return initial, inner


@functools.lru_cache(maxsize=2)
def automaton(path: str) -> LongestMatch:
    return LongestMatch(*split_vocabulary(path))


SCHEMA = "doc_id long, n_words long, n_tokens long, n_unknown long"


def count_tokens(docs: DataFrame, vocab_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Words, word-piece tokens and unknown words of every text. One pass, no shuffle; the memo of words
    seen is bounded and only saves time."""
    path = vocab_path or tokenizer_path("byte_bpe_50k.json")

    def scan(batches):
        memo = Memo(automaton(path).count, MEMO_WORDS)
        for batch in slices(batches):
            words, tokens, unknown = [], [], []
            for text in batch.column(1).to_pylist():
                counts = list(map(memo.__getitem__, text.encode("utf-8", "surrogatepass").split()))
                zero = counts.count(0)
                words.append(len(counts))
                tokens.append(sum(counts) + zero)
                unknown.append(zero)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(x, pa.int64()) for x in (words, tokens, unknown))],
                names=["doc_id", "n_words", "n_tokens", "n_unknown"],
            )

    return texts(docs, id_col, text_col).mapInArrow(scan, SCHEMA)
