"""Scoring of whole texts by a language model learnt from the corpus: logistic context mixing of bits.

A text is a sequence of lower-cased words and one end. Every word that two training texts or more have is a path of bits in a
prefix code of all such words, of the end and of an escape; `word_mixing` predicts each bit under contexts that reach over words
(topic, word before, two words before), mixes the predictions by gated weights that are learned online along the text, and
refines them. After an escape a word is spelt bit by bit the same way, from contexts of its bytes (`context_mixing`). The sum
of all bits is the text's score; nothing else goes into it.

A training text is scored from the rest of the corpus: words that only it has are spelt, spelling leaves out the word itself,
two-word contexts leave out the whole text, and tables of single contexts leave out the token.

How it runs: each task turns its documents into chunks (distinct words, and documents as indices into them); words with
their counts and places are brought together by word, once, which gives counts, codes and spellings, and these go back to the
chunks that hold them. Chunks then send their distinct pairs of a two-word context and a word, once each however often they occur,
to the context's owner, and get back the counts along each word's path. Pairs, words and their counts grow with the corpus; the tables
of topics and words before, and of spelling contexts, are of a bounded size. Nothing depends on how documents are dealt to tasks.

Null and empty texts are just an end. Rows that repeat an id are scored each, and are texts of their own: a repeated row is known from the
other. Rows without an id learn. A very long text is one chunk; its distinct words and pairs stay below its length. Ties among
words (of one code length) are ordered by a hash of the word. An empty table gives no row; columns other than id and text, of
whatever name, are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import context_mixing as cm
from . import word_mixing as wm
from .common import distinct, drop_shared, id_remainder, slices, stored, texts

CHUNK_WORDS, CHUNK_TOKENS, PIECE_BYTES = 300_000, 1_500_000, 2 << 20
BLOCK_WORDS, BLOCK_ROWS = 50_000, 20_000
WORD_BUCKETS, PAIR_TOKENS, MAX_PAIR_PARTS = 1024, 1_500_000, 1 << 16
SCORE_TOKENS = 200_000
END = bytes([cm.END])  # no UTF-8 text holds this byte
#: Symbols without a word, as numbers of coded words.
NO_ID = -(1 << 63)


def squeezed(values: np.ndarray) -> bytes:
    """Compressed by byte planes: small integers take little."""
    values = np.ascontiguousarray(values)
    return zstandard.compress(values.view(np.uint8).reshape(-1, values.itemsize).T.tobytes(), 1)


def opened(blob: bytes, dtype) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(blob), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(dtype).itemsize, -1).T).reshape(-1).view(dtype)


def squeezed_counts(values: np.ndarray) -> bytes:
    """Compressed in the narrowest type, of which the first byte tells the width."""
    values = wm.narrowed(values)
    return bytes([values.itemsize]) + squeezed(values)


def opened_counts(blob: bytes) -> np.ndarray:
    return opened(blob[1:], f"<u{blob[0]}")


def words_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(tokens of each text, words one after another): A-Z lowered, cut at ASCII white space, each text closed by an end."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    words, sizes = lists.flatten().cast(pa.binary()), np.diff(lists.offsets.to_numpy())
    some = pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)  # white space at a text's ends leaves empty words
    sizes = sizes - np.bincount(np.repeat(np.arange(len(sizes)), sizes)[~some], minlength=len(sizes))
    # ends are taken from behind the words
    kept, ends = np.flatnonzero(some), np.cumsum(sizes + 1) - 1
    at = np.full(len(kept) + len(sizes), len(words))
    inner = np.ones(len(at), bool)
    inner[ends] = False
    at[inner] = kept
    return sizes + 1, pa.concat_arrays([words, pa.array([END], pa.binary())]).take(pa.array(at))


class Numbering:
    """Distinct words in the order in which they came."""

    def __init__(self):
        self.words = pa.array([], pa.binary())

    def of(self, words: pa.Array) -> np.ndarray:
        """Words' numbers, new words getting the next."""
        found = words.dictionary_encode()
        both, n = pa.concat_arrays([self.words, found.dictionary]).dictionary_encode(), len(self.words)
        self.words = both.dictionary
        return both.indices.to_numpy()[n:][found.indices.to_numpy()]


def joined(words: pa.Array) -> bytes:
    return pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), b" ")[0].as_py()


def pieces(sizes: np.ndarray):
    """Slices of texts of at most `PIECE_BYTES` bytes, or of one text."""
    ends, first = np.cumsum(sizes), 0
    while first < len(sizes):
        last = max(first + 1, int(np.searchsorted(ends, (ends[first] - sizes[first]) + PIECE_BYTES, "right")))
        yield slice(first, last)
        first = last


CHUNK_SCHEMA = "part long, chunk long, words binary, counts binary, texts binary, tokens binary, ids binary, held binary, sizes binary, bytes binary"


def names_of(schema: str) -> list[str]:
    return [f.split()[0] for f in schema.split(", ")]


def rows_as(schema: str, rows: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=names_of(schema))


def row_of(schema: str, values) -> pa.RecordBatch:
    return rows_as(schema, [values])


def chunked(docs: DataFrame) -> DataFrame:
    """A row per chunk of a task's documents: distinct words, how often and in how many texts training has them, and the
    documents as word numbers, the commonest words having the smallest."""

    def row(part, chunk, numbers, documents):
        tokens = np.concatenate([d[0] for d in documents])
        sizes = np.array([len(d[0]) for d in documents], np.int64)
        held = np.array([d[2] for d in documents], bool)
        rank = np.argsort(-np.bincount(tokens, minlength=len(numbers.words)), kind="stable")
        words, new = numbers.words.take(pa.array(rank)), np.empty(len(rank), np.uint32)
        new[rank] = np.arange(len(rank), dtype=np.uint32)
        tokens = new[tokens]
        learned = np.repeat(~held, sizes)
        text = np.repeat(np.arange(len(documents)), sizes)
        once = distinct(text[learned].astype(np.int64) << 32 | tokens[learned]) & 0xFFFFFFFF
        counts, in_texts = (np.bincount(t, minlength=len(words)) for t in (tokens[learned], once))
        ids = np.array([NO_ID if d[1] is None else d[1] for d in documents], np.int64)
        values = [part, chunk, zstandard.compress(joined(words), 1), squeezed(counts), squeezed(in_texts), squeezed(tokens),
                  ids.tobytes(), held.astype(np.uint8).tobytes(), sizes.tobytes(), np.array([d[3] for d in documents], np.int64).tobytes()]
        return row_of(CHUNK_SCHEMA, values)

    def scan(batches):
        part, chunk, numbers, documents, size = TaskContext.get().partitionId(), 0, Numbering(), [], 0
        for batch in slices(batches):
            doc_ids, texts, held = batch.columns
            bytes_of = pc.binary_length(texts).to_numpy()
            for some in pieces(bytes_of):
                sizes, words = words_of(texts[some])
                known = list(zip(doc_ids[some].to_pylist(), held[some].to_pylist(), bytes_of[some].tolist()))
                ends, first = np.cumsum(sizes), 0
                while first < len(sizes):
                    # up to the text that fills the chunk
                    low = int(ends[first] - sizes[first])
                    last = min(len(sizes), int(np.searchsorted(ends, low + CHUNK_TOKENS - size)) + 1)
                    tokens = numbers.of(words[low : int(ends[last - 1])])
                    documents += [(t, *k) for t, k in zip(np.split(tokens, ends[first : last - 1] - low), known[first:last])]
                    size, first = size + len(tokens), last
                    if len(numbers.words) >= CHUNK_WORDS or size >= CHUNK_TOKENS:
                        yield row(part, chunk, numbers, documents)
                        chunk, numbers, documents, size = chunk + 1, Numbering(), [], 0
        if documents:
            yield row(part, chunk, numbers, documents)

    return stored(docs.select("doc_id", "text", "held_out").mapInArrow(scan, CHUNK_SCHEMA), "chunks")


LEXICON_SCHEMA = (
    "bucket long, block long, words binary, counts binary, texts binary, first binary, parts binary, chunks binary, numbers binary, "
    "known long, tokens long, escapes long, ends long"
)


def lexicon_of(chunks: DataFrame) -> DataFrame:
    """Blocks of distinct words in the order of a hash, with their counts and the places (part, chunk, number) that hold them. A
    word's bucket, the hash's first bits, and the order in it don't depend on the number of tasks."""

    def postings(batches):
        for batch in batches:
            for part, chunk, blob, counts, in_texts in zip(*(batch.column(i).to_pylist() for i in range(5))):
                words = pa.array(zstandard.decompress(blob).split(b" "), pa.binary())
                n, texts, number = opened(counts, np.int64), opened(in_texts, np.int64), np.arange(len(words))
                for a in range(0, len(words), BLOCK_ROWS):
                    s = slice(a, a + BLOCK_ROWS)
                    size = len(number[s])
                    yield pa.RecordBatch.from_arrays(
                        [words[s], *(pa.array(x) for x in (n[s], texts[s], np.full(size, part), np.full(size, chunk), number[s]))],
                        names=["word", "n", "texts", "part", "chunk", "number"],
                    )

    def block(bucket, at, words, n, texts, first, part, chunk, number):
        is_end = np.array([w == END for w in words])
        rare = (texts < 2) & ~is_end
        values = [bucket, at, zstandard.compress(b" ".join(words), 1), *(squeezed(x) for x in (n, texts, first, part, chunk, number)),
                  int((n > 0).sum()), int(n.sum()), int(n[rare].sum()), int(n[is_end].sum())]
        return row_of(LEXICON_SCHEMA, values)

    def gather(batches):
        parts, rows, enough, of_bucket, at = [], 0, BLOCK_WORDS, -1, 0
        for batch, last in _last_marked(batches):
            parts.append(batch)
            rows += batch.num_rows
            if rows < enough and not last:
                continue
            held = pa.Table.from_batches(parts).combine_chunks()
            word, bucket = held["word"].combine_chunks(), held["bucket"].to_numpy()
            change = pc.not_equal(word[1:], word[:-1]).to_numpy(zero_copy_only=False) if len(word) > 1 else np.zeros(0, bool)
            starts = np.concatenate([[0], np.flatnonzero(change) + 1]) if len(word) else np.zeros(0, np.int64)
            cut = len(word) if last else int(starts[-1])  # the last word's rows may go on
            starts = starts[starts < cut]
            if not len(starts):  # one word's rows alone: they are put together again when they are twice as many
                parts, enough = held.to_batches(), 2 * rows
                continue
            edges = np.concatenate([[0], np.flatnonzero(np.diff(bucket[starts])) + 1, [len(starts)]])
            n, texts, part, chunk, number = (held[c].to_numpy() for c in ("n", "texts", "part", "chunk", "number"))
            ends = np.append(starts[1:], cut)
            for a, b in zip(edges, edges[1:]):
                low, high, own = int(starts[a]), int(ends[b - 1]), starts[a:b] - starts[a]
                if bucket[low] != of_bucket:
                    of_bucket, at = bucket[low], 0
                sums = [np.add.reduceat(x[low:high], own) for x in (n, texts)]
                yield block(int(of_bucket), at, word.take(pa.array(starts[a:b])).to_pylist(), *sums, np.append(own, high - low), part[low:high], chunk[low:high], number[low:high])
                at += 1
            parts, rows, enough = held.slice(cut).to_batches(), len(held) - cut, BLOCK_WORDS

    rows = chunks.select("part", "chunk", "words", "counts", "texts").mapInArrow(postings, "word binary, n long, texts long, part long, chunk long, number long")
    h = F.xxhash64("word")  # its order is the buckets', and tells nearly all rows apart
    rows = rows.withColumn("h", h).withColumn("bucket", F.shiftrightunsigned("h", 64 - WORD_BUCKETS.bit_length() + 1))
    dealt = rows.repartition("bucket").sortWithinPartitions("h", "word").select("bucket", "word", "n", "texts", "part", "chunk", "number")
    return stored(dealt.mapInArrow(gather, LEXICON_SCHEMA), "lexicon")


def _last_marked(batches):
    """(batch, whether it is the last)."""
    before = None
    for batch in batches:
        if batch.num_rows:
            if before is not None:
                yield before, False
            before = batch
    if before is not None:
        yield before, True


class Facts:
    """Totals of the training corpus, the codes of the symbols without a word, and the commonest words."""

    def __init__(self, seen):
        self.n, self.distinct, self.single = (int(seen[k] or 0) for k in ("tokens", "known", "escapes"))
        self.ends = int(seen["ends"] or 0)
        common = self.n - self.single - self.ends
        self.total = float(common + max(1, self.single) + max(1, self.ends))
        self.end_length, self.escape_length = (int(wm.code_length(np.array([w]), self.total)[0]) for w in (self.ends, self.single))
        self.end_code = self.escape_code = np.uint64(0)
        self.base: dict[tuple[int, int], np.ndarray] = {}
        self.rank: dict[bytes, int] = {}

    def place_codes(self, histograms) -> None:
        """Canonical codes: shorter ones first; of one length the end, the escape, then words by bucket, block and place.
        `histograms`: (bucket, block, words of each length)."""
        at, by_length = 0, {}
        blocks = sorted(histograms, key=lambda r: r[:2])
        counts = np.array([r[2] for r in blocks], np.int64).reshape(len(blocks), wm.MAX_LENGTH + 1)
        own = {length: [name for name in ("end", "escape") if getattr(self, f"{name}_length") == length] for length in range(wm.MAX_LENGTH + 1)}
        firsts = np.zeros((len(blocks), wm.MAX_LENGTH + 1), np.uint64)
        for length in range(1, wm.MAX_LENGTH + 1):
            step = 1 << (64 - length)
            for name in own[length]:
                setattr(self, f"{name}_code", np.uint64(at))
                at += step
            before = np.cumsum(counts[:, length]) - counts[:, length]
            firsts[:, length] = np.array([at + int(b) * step for b in before.tolist()], np.uint64) if len(blocks) else 0
            at += int(counts[:, length].sum()) * step
        self.base = {r[:2]: f for r, f in zip(blocks, firsts)}


def lengths_of(texts: np.ndarray, n: np.ndarray, is_end: np.ndarray, total: float) -> np.ndarray:
    """Code lengths of words, 0 for those that are escaped and for the end."""
    return np.where((texts >= 2) & ~is_end, wm.code_length(n, total), 0)


def facts_of(lexicon: DataFrame) -> Facts:
    seen = lexicon.agg(*(F.sum(c).alias(c) for c in ("known", "tokens", "escapes", "ends"))).first()
    facts = Facts(seen)
    total, least = facts.total, facts.n / 50_000
    schema = "bucket long, block long, lengths binary, common binary, counts binary"

    def scan(batches):
        for batch in batches:
            for bucket, block, blob, n, texts in zip(*(batch.column(i).to_pylist() for i in range(5))):
                words, n, texts = zstandard.decompress(blob).split(b" "), opened(n, np.int64), opened(texts, np.int64)
                is_end = np.array([w == END for w in words])
                length = lengths_of(texts, n, is_end, total)
                # fewer than 50,000 words in all have so large a share
                top = np.flatnonzero((n >= max(1, least)) & (length > 0))
                top = top[np.argsort(-n[top], kind="stable")][: wm.PREVIOUS]
                yield row_of(schema, [bucket, block, np.bincount(length, minlength=wm.MAX_LENGTH + 1).tobytes(), b" ".join(words[i] for i in top.tolist()), n[top].tobytes()])

    # a row of fixed size for each block of words
    got = lexicon.select("bucket", "block", "words", "counts", "texts").mapInArrow(scan, schema).collect()
    facts.place_codes([(r["bucket"], r["block"], np.frombuffer(r["lengths"], np.int64)) for r in got])
    common = [(-n, w) for r in got if len(r["counts"]) for n, w in zip(np.frombuffer(r["counts"], np.int64).tolist(), bytes(r["common"]).split(b" "))]
    facts.rank = {w: k for k, (_, w) in enumerate(sorted(common)[: wm.PREVIOUS])}
    return facts


def known_words(batch) -> list[bytes]:
    """Training words of (words, counts) rows."""
    out = []
    for blob, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
        words = zstandard.decompress(blob).split(b" ")
        out += [words[i] for i in np.flatnonzero(opened(counts, np.int64) > 0).tolist() if words[i] != END]
    return out


def fit_bits(lexicon: DataFrame, n_known: int) -> cm.Model:
    """Counts over all training words. Tables are summed on the executors by part, and the driver gets one table."""
    spark = lexicon.sparkSession
    blocks = lexicon.select("words", "counts").coalesce(max(2, -(-n_known // 500_000)))
    slots = cm.slot_bits(n_known)

    def many(batches):
        """Words of many rows at once."""
        words = []
        for batch in batches:
            words += known_words(batch)
            if len(words) >= BLOCK_WORDS:
                yield words
                words = []
        if words:
            yield words

    def histogram(batches):
        n = np.zeros(256, np.int64)
        for words in many(batches):
            n += np.bincount(np.frombuffer(b" ".join(words) + b" ", np.uint8), minlength=256)
        yield pa.RecordBatch.from_arrays([pa.array([n.tobytes()])], names=["n"])

    weights = (np.arange(256) == cm.CLOSE).astype(np.int64)
    for r in blocks.mapInArrow(histogram, "n binary").collect():  # a row of 2 KB from each task
        weights += np.frombuffer(r["n"], np.int64)
    code, parts, schema = cm.Code(weights), 4, "part long, counts binary"

    def count(batches):
        counts = np.zeros((len(cm.ORDERS), 2 << slots), np.int32)
        for words in many(batches):
            cm.count(words, code, counts)
        for k in range(len(cm.ORDERS)):
            for p, piece in enumerate(np.split(counts[k], parts)):
                yield pa.RecordBatch.from_arrays([pa.array([k * parts + p]), pa.array([squeezed(piece)])], names=["part", "counts"])

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, blob in zip(*(c.to_pylist() for c in batch.columns)):
                piece = opened(blob, np.int32).astype(np.int64)
                total[part] = piece + total[part] if part in total else piece
        for part, piece in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([squeezed(cm.scaled(piece))])], names=["part", "counts"])

    counts = np.zeros((len(cm.ORDERS), parts, (2 << slots) // parts), np.uint8)
    for r in blocks.mapInArrow(count, schema).repartition(len(cm.ORDERS) * parts, "part").mapInArrow(add, schema).collect():
        counts[r["part"] // parts, r["part"] % parts] = opened(r["counts"], np.uint8)
    return cm.Model(code, counts.reshape(len(cm.ORDERS), -1))


PIECE_SCHEMA = "part long, chunk long, number binary, counts binary, code binary, length binary, spelling binary, rank binary"


def coded(lexicon: DataFrame, facts: Facts, bits: cm.Model) -> DataFrame:
    """For each chunk, pieces of its words' numbers, counts, codes, bits of spelling (of escaped words) and ranks."""
    shared = lexicon.sparkSession.sparkContext.broadcast((facts, bits))

    def scan(batches):
        for batch in batches:
            facts, bits = shared.value
            for bucket, block, blob, n, texts, first, parts, chunks, numbers in zip(*(c.to_pylist() for c in batch.columns)):
                words, n, texts = zstandard.decompress(blob).split(b" "), opened(n, np.int64), opened(texts, np.int64)
                is_end = np.array([w == END for w in words])
                length = lengths_of(texts, n, is_end, facts.total)
                code, base = np.zeros(len(words), np.uint64), facts.base[bucket, block]
                for k in np.unique(length[length > 0]).tolist():
                    at = np.flatnonzero(length == k)
                    code[at] = base[k] + np.arange(len(at), dtype=np.uint64) * np.uint64(1 << (64 - k))
                rare = np.flatnonzero((length == 0) & ~is_end)
                spelling = np.zeros(len(words), np.float32)
                if len(rare):
                    spelling[rare] = bits.bits([words[i] for i in rare.tolist()], n[rare] > 0)
                code[rare], length[rare] = facts.escape_code, facts.escape_length
                code[is_end], length[is_end] = facts.end_code, facts.end_length
                rank = np.array([facts.rank.get(w, wm.PREVIOUS) for w in words], np.int32)
                word = np.repeat(np.arange(len(words)), np.diff(opened(first, np.int64)))
                part, chunk, number = (opened(x, np.int64) for x in (parts, chunks, numbers))
                order = np.argsort(part << 32 | chunk, kind="stable")
                part, chunk, word, number = part[order], chunk[order], word[order], number[order].astype(np.int32)
                cuts = (np.flatnonzero((np.diff(part) != 0) | (np.diff(chunk) != 0)) + 1).tolist()
                length, rank, rows = length.astype(np.uint8), rank.astype(np.uint16), []
                for a, b in zip([0, *cuts], [*cuts, len(part)]):
                    if b > a:
                        w = word[a:b]
                        columns = (number[a:b], n[w], code[w], length[w], spelling[w], rank[w])
                        rows.append([int(part[a]), int(chunk[a]), *map(squeezed, columns)])
                if rows:
                    yield rows_as(PIECE_SCHEMA, rows)

    return lexicon.select("bucket", "block", "words", "counts", "texts", "first", "parts", "chunks", "numbers").mapInArrow(scan, PIECE_SCHEMA)


WORDS_SCHEMA = "part long, chunk long, tokens binary, ids binary, held binary, sizes binary, bytes binary, counts binary, code binary, length binary, spelling binary, rank binary"
KINDS = {"counts": np.int64, "code": np.uint64, "length": np.uint8, "spelling": np.float32, "rank": np.uint16}


def with_codes(chunks: DataFrame, pieces: DataFrame) -> DataFrame:
    """Chunks with what `coded` says of their words, by number."""

    def meet(chunk: pa.Table, words: pa.Table) -> pa.Table:
        number = np.concatenate([opened(b.as_py(), np.int32) for b in words["number"]])
        columns = []
        for name, kind in KINDS.items():
            values = np.empty(len(number), kind)
            values[number] = np.concatenate([opened(b.as_py(), kind) for b in words[name]])
            columns.append(pa.array([squeezed(values)]))
        return pa.table([*(chunk[c] for c in names_of(WORDS_SCHEMA)[:7]), *columns], names=names_of(WORDS_SCHEMA))

    left = chunks.select(*names_of(WORDS_SCHEMA)[:7]).groupBy("part", "chunk")
    return stored(left.cogroup(pieces.groupBy("part", "chunk")).applyInArrow(meet, WORDS_SCHEMA), "coded-chunks")


class Chunk:
    """A coded chunk's tokens."""

    def __init__(self, row: dict):
        self.tokens = opened(row["tokens"], np.uint32).astype(np.int32)
        self.ids, self.sizes, self.bytes = (np.frombuffer(row[c], np.int64) for c in ("ids", "sizes", "bytes"))
        self.held = np.frombuffer(row["held"], np.uint8) > 0
        self.of_word = {name: opened(row[name], kind) for name, kind in KINDS.items()}
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.text = np.repeat(np.arange(len(self.sizes), dtype=np.int32), self.sizes)
        self.place = np.arange(len(self.tokens), dtype=np.int32) - self.starts.astype(np.int32)[self.text]
        self.code = self.of_word["code"][self.tokens]
        self.rank = self.of_word["rank"][self.tokens].astype(np.int32)
        self.train = ~self.held[self.text]

    def pairs(self):
        """(context, code, training count, whether a held-out text has it) of the distinct pairs, by context and code, and
        each token's pair and context."""
        context = wm.pair_contexts(self.code, self.place)
        order = wm.ordered(context, self.code)
        at, code = context[order], self.code[order]
        first = np.flatnonzero(np.concatenate([np.ones(min(1, len(at)), bool), (at[1:] != at[:-1]) | (code[1:] != code[:-1])]))
        size = np.diff(np.append(first, len(order)))
        pair = np.empty(len(order), np.int32)
        pair[order] = np.repeat(np.arange(len(first), dtype=np.int32), size)
        n = np.add.reduceat(self.train[order].astype(np.int32), first)
        return at[first], code[first], n, n < size, pair, context


def rows_of(batches):
    """Rows one by one: each is a chunk of several megabytes."""
    for one in slices(batches, 1):
        yield one.to_pylist()[0]


def tables_of(words: DataFrame) -> wm.Tables:
    """Counts of code prefixes under topics and words before, summed over all training tokens. Their size is fixed."""
    shapes = {0: (wm.TOPICS + 1, wm.DEPTH), 1: (wm.PREVIOUS + 1, wm.PREVIOUS_DEPTH)}
    parts, schema = 4, "part long, counts binary"

    def count(batches):
        sums = {k: np.zeros((c, 1 << d), np.int64) for k, (c, d) in shapes.items()}
        for row in rows_of(batches):
            c = Chunk(row)
            t = c.train
            sums[0] += wm.table(wm.topics(c.rank, c.place)[t], c.code[t], *shapes[0])
            sums[1] += wm.table(wm.previous(c.rank, c.place)[t], c.code[t], *shapes[1])
        for k, total in sums.items():
            for p, piece in enumerate(np.array_split(total.reshape(-1), parts)):
                yield pa.RecordBatch.from_arrays([pa.array([k * parts + p]), pa.array([squeezed(piece)])], names=["part", "counts"])

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, blob in zip(*(c.to_pylist() for c in batch.columns)):
                piece = opened(blob, np.int64)
                total[part] = piece + total[part] if part in total else piece
        for part, piece in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([squeezed(piece)])], names=["part", "counts"])

    got = {r["part"]: opened(r["counts"], np.int64) for r in words.mapInArrow(count, schema).repartition(2 * parts, "part").mapInArrow(add, schema).collect()}
    flat = [np.concatenate([got[k * parts + p] for p in range(parts)]) if got else np.zeros(c << d, np.int64) for k, (c, d) in shapes.items()]
    return wm.Tables(*(f.reshape(c, 1 << d) for f, (c, d) in zip(flat, shapes.values())))


def pair_counts(words: DataFrame, n_tokens: int) -> DataFrame:
    """(part, chunk, owner, levels, counts): for a chunk's pairs of one owner, in their order, the counts along their paths over
    the whole corpus. A chunk sends a pair once, so that a context of very many tokens is no more rows than chunks."""
    bits = min(MAX_PAIR_PARTS, max(16, -(-n_tokens // PAIR_TOKENS))).bit_length()
    schema = "part long, chunk long, owner long, context binary, code binary, n binary"

    def send(batches):
        for row in rows_of(batches):
            context, code, n, asked, _, _ = Chunk(row).pairs()
            owner = (context >> np.uint64(64 - bits)).astype(np.int64)
            cuts = (np.flatnonzero(np.diff(owner)) + 1).tolist()
            for a, b in zip([0, *cuts], [*cuts, len(owner)]):
                steps = np.diff(context[a:b] >> np.uint64(16), prepend=np.uint64(0))
                yield row_of(schema, [row["part"], row["chunk"], int(owner[a]), squeezed(steps), squeezed(code[a:b]), squeezed_counts(n[a:b].astype(np.uint64) << np.uint64(1) | asked[a:b])])

    def own(rows: pa.Table) -> pa.Table:
        context = [np.cumsum(opened(b.as_py(), np.uint64), dtype=np.uint64) << np.uint64(16) for b in rows["context"]]
        sizes = [len(c) for c in context]
        context, code, n = np.concatenate(context), np.concatenate([opened(b.as_py(), np.uint64) for b in rows["code"]]), np.concatenate([opened_counts(b.as_py()) for b in rows["n"]])
        order = wm.ordered(context, code)
        context, code = context[order], code[order]
        asked, n = n & n.dtype.type(1), (n >> n.dtype.type(1)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], (context[1:] != context[:-1]) | (code[1:] != code[:-1])]))
        levels, counts = wm.node_counts(context[first], code[first], np.add.reduceat(n[order], first))
        starts = np.cumsum(levels) - levels
        # a context that training has never tells nothing, and one that it has once nothing of the text that has it
        entry = np.empty(len(order), np.int64)
        entry[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(order))))
        useful = counts[starts][entry] > (asked == 0)
        out, at = [], 0
        for size in sizes:
            mine = np.where(useful[at : at + size], entry[at : at + size], -1)
            have = mine[mine >= 0]
            length = levels[have]
            places = np.repeat(starts[have] - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))
            out.append((squeezed(np.where(mine >= 0, levels[mine], 0).astype(np.uint8)), squeezed_counts(counts[places])))
            at += size
        return pa.table([rows["part"], rows["chunk"], rows["owner"], pa.array([o[0] for o in out]), pa.array([o[1] for o in out])], names=["part", "chunk", "owner", "levels", "counts"])

    sent = words.select(*names_of(WORDS_SCHEMA)).mapInArrow(send, schema)
    counts = sent.groupBy("owner").applyInArrow(own, "part long, chunk long, owner long, levels binary, counts binary")
    return stored(counts, "pair-counts", "none")  # what was sent goes from the disks before scoring


RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"


def chunk_bits(c: Chunk, pair_levels: np.ndarray, pair_counts: np.ndarray, pair: np.ndarray, context: np.ndarray, tables: wm.Tables) -> np.ndarray:
    """Bits of every token, some texts at a time. Long texts are a group by themselves."""
    first_of_pair = np.cumsum(pair_levels) - pair_levels
    out, ends, a = np.empty(len(c.tokens)), np.cumsum(c.sizes), 0
    topic, before = wm.topics(c.rank, c.place), wm.previous(c.rank, c.place)
    length = c.of_word["length"][c.tokens].astype(np.int64)
    padded = np.append(pair_counts, pair_counts.dtype.type(0))
    while a < len(c.sizes):
        low = int(c.starts[a])
        b = max(a + 1, int(np.searchsorted(ends, low + SCORE_TOKENS, "right")))
        s = slice(low, int(ends[b - 1]))
        levels = pair_levels[pair[s]]
        mine = np.flatnonzero((levels > 0) & c.train[s])
        listed, own, entry = wm.own_counts(c.text[s][mine], pair[s][mine], context[s][mine], c.code[s][mine])
        own_levels, own_first = np.zeros(len(levels), np.int64), np.zeros(len(levels), np.int64)
        own_levels[mine], own_first[mine] = listed[entry], (np.cumsum(listed) - listed)[entry]
        paths = wm.Paths(c.code[s], length[s], topic[s], before[s], c.train[s].astype(np.float32), levels, np.minimum(first_of_pair[pair[s]], len(pair_counts)), padded,
                         own_levels, own_first, np.append(own, own.dtype.type(0)))
        out[s] = wm.bits(paths, tables, c.sizes[a:b])
        a = b
    return out + c.of_word["spelling"][c.tokens]


def summed(words: DataFrame, counts: DataFrame, facts: Facts, tables: wm.Tables) -> DataFrame:
    """Scores of all documents of all chunks."""
    shared = words.sparkSession.sparkContext.broadcast(tables)
    n, distinct = facts.n, facts.distinct

    def meet(chunk: pa.Table, counts: pa.Table) -> pa.Table:
        c = Chunk(chunk.to_pylist()[0])
        *_, pair, context = c.pairs()
        counts = counts.sort_by("owner")
        levels = np.concatenate([opened(b.as_py(), np.uint8) for b in counts["levels"]]).astype(np.int64)
        values = np.concatenate([opened_counts(b.as_py()) for b in counts["counts"]])
        bits = chunk_bits(c, levels, values, pair, context, shared.value)
        of_word = c.of_word["counts"]
        base = np.log10((of_word + 1) / (n + distinct + 1))[c.tokens]
        total, base, known = (np.add.reduceat(x, c.starts) for x in (bits, base, (of_word > 0).astype(np.int64)[c.tokens]))
        columns = [
            pa.array(c.ids, mask=c.ids == NO_ID), pa.array(c.held), pa.array(c.sizes), pa.array(known), pa.array(np.full(len(c.ids), n)), pa.array(base),
            pa.array(-total * np.log10(2)), pa.array(np.where(c.bytes > 0, total / np.maximum(c.bytes, 1), np.nan), mask=c.bytes == 0),
        ]
        return pa.table(columns, names=names_of(RESULT))

    return words.groupBy("part", "chunk").cogroup(counts.groupBy("part", "chunk")).applyInArrow(meet, RESULT)


def score(docs: DataFrame, modulus: int = 7, held_out: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scores of all texts, learnt from those whose id doesn't fall in the held-out remainder."""
    spark = docs.sparkSession
    chunks = chunked(texts(docs, id_col, text_col).withColumn("held_out", id_remainder(modulus) == held_out))
    lexicon = lexicon_of(chunks)
    facts = facts_of(lexicon)
    words = with_codes(chunks, coded(lexicon, facts, fit_bits(lexicon, facts.distinct)))
    drop_shared(spark, chunks._stored_at)
    drop_shared(spark, lexicon._stored_at)
    return summed(words, pair_counts(words, facts.n), facts, tables_of(words))
