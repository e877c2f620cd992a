"""Secret scans with structural confirmation.

Pattern matches of three base kinds are always reported. Beyond them, candidates that look like encoded
key material are decoded and parsed: a candidate counts only if its bytes have the structure of a private key to the
end (a grammar of nested DER elements, the OpenSSH private format's fields) or of a signed token (a JSON header that names
an algorithm). Public keys and certificates are no secrets and aren't reported. Base64 of either alphabet may be wrapped over
lines, whose ends may be escaped (a backslash and n, r or t, as in JSON). An armoured key that is encrypted has no structure
of its own; it is confirmed by its headers, and by whole blocks of the cipher that they name.

Null and empty texts have no spans; very long texts are scanned whole, in time linear in their length; repeated rows give repeated
results; spans that start alike are listed in the order of `KINDS`. An empty table gives no row; other columns, of whatever name, are
not read.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from bisect import bisect_left, bisect_right
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import prepare, slices, texts

#: The base kinds in the order in which equal starts are listed, then the confirmed kinds.
KINDS = ("assign", "access", "hex", "jwt", "pem", "der", "derhex", "ssh")
BASE_KINDS = KINDS[:3]

_ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_JWT = re.compile(
    r"(?:(?<![A-Za-z0-9_-])|(?<=\\[nrt]))(eyJ[A-Za-z0-9_-]+)\.[A-Za-z0-9_-]*\.[A-Za-z0-9_-]*((?:\.[A-Za-z0-9_-]+){2})?"
)
_PEM = re.compile(
    r"-----BEGIN ((?:[A-Z0-9]+ )*PRIVATE KEY)-----(?:(?:\s|\\+[nrt])*Proc-Type:[ ]?4,ENCRYPTED(?:\s|\\+[nrt])+DEK-Info:[ ]?([A-Z0-9-]+),([0-9A-Fa-f]+)(?=\s|\\))?"
    r"((?:[A-Za-z0-9+/=_\s]|-(?!----)|\\+[nrt])*)-----END \1-----"
)
# Base64 of a DER sequence (0x30 and a length) or of the OpenSSH magic: where it may start, and all lines that may belong to it.
_BASE64 = re.compile(r"(?:(?<![A-Za-z0-9+/])|(?<=\\[nrt]))(?:M[A-P]|b3BlbnNzaC1r)(?=[A-Za-z0-9+/_-]{12})")
_LINE = re.compile(r"[A-Za-z0-9+/_-]+")
_LINES = re.compile(r"[A-Za-z0-9+/_-]+(?:[ \t]*(?:\\+[nrt]|[\r\n][ \t]*)+[A-Za-z0-9+/_-]+)*")
_SSH_MAGIC = b"openssh-key-v1\x00"
_PADDING = re.compile(r"={0,2}")
_OTHER = re.compile(r"[-_]")
_DER_HEX = re.compile(r"(?<![0-9A-Fa-f])30(?:8[1-4]|[0-7][0-9A-Fa-f])[0-9A-Fa-f]{28,}")


class Plain:
    """Bytes that are there, read piece by piece."""

    def __init__(self, data: bytes):
        self.data, self.n = data, len(data)

    def read(self, a: int, b: int) -> bytes:
        return self.data[a:b]


class Coded:
    """The bytes that base64 characters of a text stand for. Only those that are read are decoded, so that a candidate costs as much as
    its headers, however long it says it is."""

    def __init__(self, text: str, start: int, chars: int):
        self.text, self.start, self.end, self.n = text, start, start + chars, chars * 3 // 4

    def read(self, a: int, b: int) -> bytes:
        group, b = a // 3, min(b, self.n)
        if a >= b:
            return b""
        chars = self.text[self.start + 4 * group : min(self.start + 4 * -(-b // 3), self.end)]
        return unbase64(chars)[a - 3 * group : b - 3 * group]


#: More elements than any key has side by side.
MOST_ITEMS = 9


def der_items(source, a: int, b: int, most: int = MOST_ITEMS) -> list[tuple[int, int, int]] | None:
    """(tag, start, end) of the DER elements that fill the bytes from a to b exactly; None if they don't, or are more than `most`."""
    out: list = []
    while a < b:
        head = source.read(a, min(a + 6, b))
        if len(head) < 2 or len(out) == most:
            return None
        tag, length, k = head[0], head[1], 0
        if length & 0x80:
            k = length & 0x7F
            if not 1 <= k <= 4 or 2 + k > len(head):
                return None
            length = int.from_bytes(head[2 : 2 + k], "big")
            if length < 0x80:
                return None  # DER wants the shortest form
        start = a + 2 + k
        if start + length > b or tag in (0x00, 0xFF):
            return None
        out.append((tag, start, start + length))
        a = start + length
    return out


def _is_algorithm(source, a: int, b: int, items: int | None = None) -> bool:
    """An AlgorithmIdentifier: an object id, then at most one element of parameters."""
    found = der_items(source, a, b, 2)
    return bool(found) and found[0][0] == 0x06 and found[0][2] - found[0][1] > 1 and items in (None, len(found))


def is_der_key(source) -> bool:
    """One SEQUENCE that is a private key: of RSA or DSA (a version and just the integers of such a key), of an elliptic curve
    (version 1, octets, tagged parameters), PKCS #8 (a version, an algorithm, octets that hold a key's element, tagged attributes) or
    encrypted PKCS #8 (an algorithm, octets in whole). Only headers and the version are read."""
    source = Plain(source) if isinstance(source, bytes) else source
    outer = der_items(source, 0, source.n, 1) if source.n >= 16 else None
    if not outer or outer[0][0] != 0x30 or not (items := der_items(source, *outer[0][1:])):
        return False
    tags, sizes = [t for t, _, _ in items], [b - a for _, a, b in items]
    if tags == [0x30, 0x04]:
        return _is_algorithm(source, *items[0][1:], items=2) and sizes[1] >= 16 and sizes[1] % 8 == 0
    if tags[0] != 0x02 or sizes[0] != 1 or (version := source.read(items[0][1], items[0][2])) not in (b"\x00", b"\x01"):
        return False
    if all(t == 0x02 for t in tags):
        return len(tags) in (6, 9) and all(sizes) and max(sizes) >= 16
    if tags[1] == 0x04:
        tagged = items[2:]
        return version == b"\x01" and sizes[1] >= 16 and 1 <= len(tagged) <= 2 and all(t in (0xA0, 0xA1) and der_items(source, a, b, 1) for t, a, b in tagged)
    if tags[1:3] == [0x30, 0x04]:
        return _is_algorithm(source, *items[1][1:]) and bool(der_items(source, *items[2][1:], 1)) and len(tags) <= 5 and all(t in (0xA0, 0xA1, 0x81) for t in tags[3:])
    return False


#: Fields of a public key, and of a private one with its comment: no key type has more.
MOST_FIELDS = 16


def _fields(source, at: int, end: int, n: int | None, most: int = MOST_FIELDS):
    """((start, end) of the next n length-prefixed fields, all that fit up to `end` if n is None, where they end); None if n don't fit or
    there are more than `most`."""
    out: list = []
    while len(out) != n:
        size = source.read(at, min(at + 4, end))
        stop = at + 4 + int.from_bytes(size, "big")
        if len(size) < 4 or stop > end:
            return (out, at) if n is None else None
        if len(out) == most:
            return None
        out.append((at + 4, stop))
        at = stop
    return out, at


def ssh_size(source) -> int:
    """Bytes of the OpenSSH private key that `source` begins with; 0 if there is none. All fields are parsed to the end: cipher,
    derivation, public keys, and the private part, which starts with two equal numbers and ends with counted padding
    if it isn't encrypted, and else fills the cipher's blocks."""
    source = Plain(source) if isinstance(source, bytes) else source
    magic = len(_SSH_MAGIC)
    if source.read(0, magic) != _SSH_MAGIC or not (head := _fields(source, magic, source.n, 3)):
        return 0
    names, at = head
    if any(b - a > 64 for a, b in names[:2]):
        return 0
    cipher, derivation = (source.read(a, b) for a, b in names[:2])
    keys = int.from_bytes(source.read(at, at + 4), "big")
    if not re.fullmatch(rb"[a-z0-9@.-]+", cipher) or not re.fullmatch(rb"[a-z0-9]+", derivation) or not 1 <= keys <= 64:
        return 0
    if not (rest := _fields(source, at + 4, source.n, keys + 1, keys + 1)):
        return 0
    *public, (a, b) = rest[0]
    if not all(_is_public_key(source, *p) for p in public):
        return 0
    if cipher == b"none":
        if b - a < 16 or source.read(a, a + 4) != source.read(a + 4, a + 8) or not (body := _fields(source, a + 8, b, None, MOST_FIELDS * keys)):
            return 0
        fields, end = body
        if not fields or not _is_type(source, *fields[0]) or b - end > 255 or source.read(end, b) != bytes(range(1, b - end + 1)):
            return 0
    elif b - a < 16 or (b - a) % 8:
        return 0
    return rest[1]


_SSH_TYPE = re.compile(rb"(ssh|ecdsa|sk)-[a-z0-9@.-]+")


def _is_type(source, a: int, b: int) -> bool:
    return b - a <= 128 and bool(_SSH_TYPE.fullmatch(source.read(a, b)))


def _is_public_key(source, a: int, b: int) -> bool:
    found = _fields(source, a, b, None)
    return bool(found) and len(found[0]) >= 2 and found[1] == b and _is_type(source, *found[0][0])


def is_encrypted_body(cipher: str, body: bytes) -> bool:
    """Whole blocks of the cipher that an armour's header names."""
    block = 16 if cipher.startswith(("AES", "CAMELLIA", "SEED")) else 8
    return len(body) >= 2 * block and len(body) % block == 0


def der_size(head: bytes) -> int:
    """Bytes of the DER element that starts so; 0 if there is none."""
    if len(head) < 6 or head[0] != 0x30:
        return 0
    k = head[1] & 0x7F
    if not head[1] & 0x80:
        return 2 + k
    return 2 + k + int.from_bytes(head[2 : 2 + k], "big") if 1 <= k <= 4 else 0


def unbase64(text: str) -> bytes:
    """Bytes of standard or URL-safe base64, padded or not; empty if it isn't that."""
    text = re.sub(r"\\+[nrt]|\s", "", text).rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except (binascii.Error, ValueError):
        return b""


def is_json_object(part: str, *keys: str) -> bool:
    try:
        value = json.loads(unbase64(part))
    except (ValueError, RecursionError):
        return False
    return isinstance(value, dict) and all(isinstance(value.get(k), str) for k in keys)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base kinds: leftmost and non-overlapping in each kind, short matches dropped."""
    found = []
    low = text.lower()
    if any(w in low for w in _ASSIGN_WORDS):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    # a run is maximal and a shorter run fails as a whole, so the bound can stand in the pattern
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


def base64_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of DER and SSH keys in base64, on one line or over several. Each candidate is measured by its headers, and only
    one that is a key covers more than its first line's beginning, so that the time is linear in the text's length."""
    found, at = [], 0
    while first := _BASE64.search(text, at):
        at = _LINES.match(text, first.start()).end()
        lines = [m.span() for m in _LINE.finditer(re.sub(r"\\+[nrt]", lambda m: " " * len(m[0]), text[first.start() : at]))]
        joined = "".join(text[first.start() + a : first.start() + b] for a, b in lines)
        before = list(accumulate((b - a for a, b in lines), initial=0))
        ends, other, covered = set(before[1:]), [m.start() for m in _OTHER.finditer(joined)], first.start()
        for m in _BASE64.finditer(text, first.start(), at):
            line = bisect_right(lines, (m.start() - first.start(), at)) - 1
            start = before[line] + m.start() - first.start() - lines[line][0]
            if m.start() < covered:
                continue
            kind, size = None, der_size(unbase64(joined[start : start + 12]))
            if m[0][0] == "M":
                n = -(-size * 4 // 3)
                if size and start + n <= len(joined) and is_der_key(Coded(joined, start, n)):
                    kind = 5
            elif unbase64(joined[start : start + 20]) == _SSH_MAGIC:
                chars = len(joined) - start
                size = ssh_size(Coded(joined, start, chars - (chars % 4 == 1)))
                n = -(-size * 4 // 3)
                kind = 7 if size else None
            # the text's base64 has to stop there; '-' and '_' end the other alphabet's
            stop = start + n if kind else 0
            if kind and (stop in ends or (stop < len(joined) and joined[stop] in "-_" and bisect_left(other, start) == bisect_left(other, stop))):
                last = bisect_left(before, stop) - 1
                covered = _PADDING.match(text, first.start() + lines[last][0] + stop - before[last]).end()
                found.append((m.start(), kind, covered))
        at = max(at, covered)
    return found


def confirmed_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the candidates whose decoded bytes have a key's structure."""
    found = []
    if "eyJ" in text:
        for m in _JWT.finditer(text):
            if is_json_object(m[1], "alg"):
                # an encrypted token has five parts
                found.append((m.start(), 3, m.end() if is_json_object(m[1], "alg", "enc") or not m[2] else m.start(2)))
    if "-----BEGIN" in text:
        for m in _PEM.finditer(text):
            blob = unbase64(m[4])
            if is_encrypted_body(m[2], blob) if m[2] else is_der_key(blob) or ssh_size(blob) == len(blob) > 0:
                found.append((m.start(), 4, m.end()))
    armoured = [(a, b) for a, k, b in found if k == 4]
    for a, kind, b in base64_spans(text):
        if not any(x < a and b < y for x, y in armoured):  # what stands in armour is the armour's key
            found.append((a, kind, b))
    if "30" in text:
        for m in _DER_HEX.finditer(text):
            if len(m[0]) % 2 == 0 and is_der_key(bytes.fromhex(m[0])):
                found.append((m.start(), 6, m.end()))
    return sorted(found)


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, n_confirmed long, base_sha256 string, spans string"


def _scan(batches):
    for batch in slices(batches):
        out = {name: [] for name in ("n_assign", "n_access", "n_hex", "n_confirmed", "base_sha256", "spans")}
        for text in batch.column(1).to_pylist():
            base = base_spans(text)
            more = confirmed_spans(text)
            for k in range(3):
                out[f"n_{KINDS[k]}"].append(sum(s[1] == k for s in base))
            out["n_confirmed"].append(len(more))
            out["base_sha256"].append(hashlib.sha256(written(base).encode()).hexdigest())
            out["spans"].append(written(sorted(base + more)))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(out[f"n_{k}"], pa.int64()) for k in ("assign", "access", "hex", "confirmed")),
             pa.array(out["base_sha256"], pa.string()), pa.array(out["spans"], pa.string())],
            names=["doc_id", "n_assign", "n_access", "n_hex", "n_confirmed", "base_sha256", "spans"],
        )


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document with its spans (code points, end exclusive). A single pass without a shuffle."""
    return texts(docs, id_col, text_col).mapInArrow(_scan, SCHEMA)


def redacted(text: str, mark: str = "[secret]") -> str:
    """The text with every span replaced; overlapping spans are replaced as one."""
    parts, at = [], 0
    for a, _, b in sorted(base_spans(text) + confirmed_spans(text)):
        if a >= at:
            parts += [text[at:a], mark]
        at = max(at, b)
    return "".join(parts) + text[at:]


def redact_secrets(docs: DataFrame, text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """All rows and columns of `docs`, secrets in `text_col` replaced by `mark`; null texts stay null."""
    prepare(docs.sparkSession)
    where, schema = docs.columns.index(text_col), docs.schema

    def change(batches):
        for batch in slices(batches):
            columns = list(batch.columns)
            old = batch.column(where)
            columns[where] = pa.array([None if t is None else redacted(t, mark) for t in old.to_pylist()], old.type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(change, schema)
