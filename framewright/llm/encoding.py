"""Exact token ids of whole texts, with the work on repeated words done once.

The tokenizers library encodes; a text is first cut where its tokenizer always starts a new piece, and the
ids of a cut-out chunk are remembered in a bounded memo. The joined ids equal those of the whole text.
"""

from __future__ import annotations

import functools
import json
import os
import re
import sys
from array import array

import numpy as np

MEMO_CHUNKS, MEMO_PARTS, LONG, ROW_WORDS = 500_000, 100_000, 200, 200

_L = "A-Za-zÀ-ÖØ-öø-ÿ"
_P = ".,;:!?"
_ENDS = frozenset(_P)
#: A word and what follows it up to the next space: between letters, punctuation and line ends every supported
#: pre-tokenizer starts a new piece (two line ends in a row may be one piece).
_WORD_AND_TAIL = re.compile(rf"([{_L}]+)([{_P}\n][{_L}{_P}\n]*)")
_PART = re.compile(rf"[{_L}]+|[{_P}]+|\n")
_SPACE_INSIDE_SPACE = re.compile(r"[^\S ] (?=[^\S ])")
_LONE_SPACE = re.compile(r"(?<=\S) (?=\S)")


def cut_style(config: dict) -> str:
    """"space": a piece never crosses the start of a lone space (byte-level pre-tokenizer, no normalizer);
    "drop": white space is dropped; "whole": nothing is known, texts are encoded whole."""
    pre = config.get("pre_tokenizer") or {}
    if config.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space"):
        return "space"
    first = (pre.get("pretokenizers") or [{}])[0]
    if first.get("type") == "Split" and first.get("invert") and first.get("behavior") == "Removed" and r"[^\s\p{L}\p{N}]+" in first.get("pattern", {}).get("Regex", ""):
        return "drop"
    return "whole"


def _is_latin(text: str) -> bool:
    """Only Latin-1: composed already, and lowered alike by character or as a whole."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class Encoder:
    """Little-endian unsigned 32-bit ids, as bytes, of texts."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            self.style = cut_style(json.load(f))
        self.at_end, self.marks = self._word_marks()
        self.chunks: dict = {}
        self.old_chunks: dict = {}
        self.parts: dict[str, bytes] = {}

    def _ids(self, pieces: list[str]) -> list[bytes]:
        out = []
        for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False):
            ids = array("I", e.ids)
            if sys.byteorder == "big":
                ids.byteswap()
            out.append(ids.tobytes())
        return out

    def _word_marks(self) -> tuple[bool, np.ndarray]:
        """Which ids begin a word that stands after a space, or (True, ...) which end one."""
        at_end = self.style == "drop"
        vocab = self.tokenizer.get_vocab()
        marks = np.zeros(max(vocab.values(), default=0) + 1, bool)
        for piece, i in vocab.items():
            marks[i] = piece.endswith("</w>") if at_end else piece.startswith("\u0120")
        return at_end, marks

    def _word_ids(self, words: list[str]) -> list[bytes]:
        """Ids of words of letters, each after a space: many are encoded as one row, whose ids show where a word begins or
        ends. A row in which these places don't come to its number of words is encoded word by word."""
        out = []
        rows = [words[k : k + ROW_WORDS] for k in range(0, len(words), ROW_WORDS)]
        for row, ids in zip(rows, self._ids([" " + " ".join(row) for row in rows])):
            at = np.flatnonzero(self.marks[np.frombuffer(ids, "<u4")]) * 4
            if len(at) != len(row):
                out += self._ids([" " + w for w in row])
                continue
            cuts = [0, *(at + 4).tolist()] if self.at_end else [*at.tolist(), len(ids)]
            out += [ids[a:b] for a, b in zip(cuts, cuts[1:])]
        return out

    def _split(self, text: str) -> list:
        """Chunks at spaces. The first is a 1-tuple, as it has no space before it; the others stand for " " + chunk."""
        if self.style == "space" and ("  " in text or _SPACE_INSIDE_SPACE.search(text)):
            parts: list = _LONE_SPACE.split(text)
        else:
            if self.style == "drop" and _is_latin(text):
                text = text.lower()  # as the normalizer would; equal words then meet in the memo
            parts = text.split(" ")
        parts[0] = (parts[0],)
        return parts

    def _learn(self, keys: set) -> list:
        """Put the ids of all `keys` into the current memo; returns new keys that are too long to be kept."""
        chunks, old = self.chunks, self.old_chunks
        if len(self.parts) > MEMO_PARTS:
            self.parts.clear()
        new = keys.difference(chunks)
        if old:
            again = old.keys() & new
            chunks.update(zip(again, map(old.__getitem__, again)))
            new -= again
        whole = [k for k in new if type(k) is tuple]
        new.difference_update(whole)
        words = list(filter(str.isalpha, new))
        new.difference_update(words)
        tailed, heads, parts = [], set(), set()
        for k in new:
            if k[-1:] in _ENDS and (head := k[:-1]).isascii() and head.isalpha():  # the usual case of the next one
                tailed.append((k, head, k[-1]))
                heads.add(head)
                parts.add(k[-1])
            elif (m := _WORD_AND_TAIL.fullmatch(k)) and "\n\n" not in k:
                head, tail = m.groups()
                tail = [tail] if len(tail) == 1 else _PART.findall(tail)
                tailed.append((k, head, tail))
                heads.add(head)
                parts.update(tail)
            else:
                whole.append(k)
        heads.difference_update(words)
        for h in heads:
            if h not in chunks:
                if h in old:
                    chunks[h] = old[h]
                else:
                    words.append(h)
        chunks.update(zip(words, self._word_ids(words)))
        chunks.update(zip(whole, self._ids([k[0] if type(k) is tuple else " " + k for k in whole])))
        need = list(parts.difference(self.parts))
        self.parts.update(zip(need, self._ids(need)))
        get = self.parts.__getitem__
        for k, head, tail in tailed:
            chunks[k] = chunks[head] + b"".join(map(get, tail))
        long = [k for k in whole if len(k if type(k) is str else k[0]) > LONG]
        return long + [k for k in words if len(k) > LONG] + [k for k, _, _ in tailed if len(k) > LONG]

    def encode(self, texts: list[str]) -> list[bytes]:
        if self.style == "whole":
            return self._ids(texts)
        out, group, size = [], [], 0
        for t in texts:  # in groups of bounded size, so that a batch of long texts holds few chunks at once
            group.append(self._split(t))
            size += len(t)
            if size > 4_000_000:
                out += self._encode(group)
                group, size = [], 0
        return out + self._encode(group)

    def _encode(self, split: list[list]) -> list[bytes]:
        keys = set().union(*split)
        long = self._learn(keys)
        get = self.chunks.__getitem__
        out = [b"".join(map(get, parts)) for parts in split]
        for k in long:
            del self.chunks[k]
        if len(self.chunks) > MEMO_CHUNKS:
            self.old_chunks, self.chunks = self.chunks, {}
        return out


@functools.lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """One per Python worker, kept from task to task."""
    return Encoder(path)
