"""Secrets with structural confirmation.

Base patterns are reported as they match. Beyond them, long base64 and hex runs (wrapped over lines
or not, from every place where a key may begin) and PEM bodies are decoded and parsed, and so is what
a run decodes to, one level deep. A key is reported only if its inner structure says what it is:

* ``der_key``: a DER sequence whose nested lengths all fit and whose fields are those of a private
  key (PKCS#1, DSA, PKCS#8, encrypted PKCS#8, SEC 1), or a PEM body that its header declares encrypted,
  with a start vector of the cipher's block size and whole blocks of data,
* ``ssh_key``: the OpenSSH container, its length-prefixed fields filling it as they should,
* ``signed_token``: header and claims are JSON objects, the header names an algorithm and the
  signature has that algorithm's length.

Random strings, hashes and encoded pictures do not parse and are left alone. Public keys and
certificates are not secrets.

Spans are [start, end) in code points of the whole text. Cases: null text is empty; overlapping
spans of different kinds are all reported; repeated rows are searched one by one; ids are carried as
they are, null too; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from motionmatch.llm.texts import column, map_batches, texts_of

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "der_key", "ssh_key", "signed_token")
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
# Candidates: three dotted runs; a PEM body; a run of base64 or hex, perhaps over
# several lines, that could hold a small key.
TOKEN = re.compile(r"(?<![A-Za-z0-9_.-])(eyJ[A-Za-z0-9_-]*)\.(eyJ[A-Za-z0-9_-]*)\.([A-Za-z0-9_-]+)")
LINE_END = r"(?:\r?\n|\\r|\\n)"
PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]*)PRIVATE KEY-----"
                 rf"((?:\s*{LINE_END}+[A-Za-z-]+:[^\n\\]*)*)([A-Za-z0-9+/=\s\\]*)-----END \1PRIVATE KEY-----")
CIPHER = re.compile(r"Proc-Type:[ \t]*4,[ \t]*ENCRYPTED[\s\\rn]+DEK-Info:[ \t]*(AES|DES|CAMELLIA|SEED|IDEA|RC2|BF)[A-Z0-9-]*,[ \t]*([0-9A-Fa-f]+)")
RUN = re.compile(r"[A-Za-z0-9+/_-]{24,}(?:[ \t]*(?:\r?\n|\\r|\\n)+[ \t]*[A-Za-z0-9+/_-]+)*={0,2}")
LINE = re.compile(r"\\[rn]|([A-Za-z0-9+/_-]+)")
RUN_CHARS = 48
# Where a key may begin in a run: a DER sequence or the OpenSSH mark, in base64 and in hex.
BASE64_START = re.compile(r"(?=M[A-P]|b3BlbnNzaC1rZXktdjEA)")
HEX_RUN = re.compile(r"[0-9A-Fa-f]{64,}")
HEX_START = re.compile(r"(?=30|6[Ff]70656[Ee]7373682[Dd]6[Bb])")
OPENSSH = b"openssh-key-v1\0"
# Bytes of a signature by algorithm name (fixed values of the public registry); RSA's is its modulus.
SIGNATURES = {"HS256": (32,), "HS384": (48,), "HS512": (64,), "ES256": (64,), "ES384": (96,), "ES512": (132,),
              "EdDSA": (64, 114), **{f"{k}{n}": (128, 256, 384, 512, 1024) for k in ("RS", "PS")
                                     for n in (256, 384, 512)}}
INTEGER, OCTETS, OID, SEQUENCE, CONTEXT_0 = 0x02, 0x04, 0x06, 0x30, 0xA0
MAX_DEPTH = 16


def decoded(run: str) -> bytes | None:
    """Bytes of a base64 run (either alphabet, padding optional); None if it is none."""
    body = run.rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def elements(data: bytes) -> list[tuple[int, bytes]] | None:
    """(tag, content) of DER elements that fill ``data`` exactly, with minimal lengths."""
    out, at = [], 0
    while at < len(data):
        if at + 2 > len(data) or data[at] & 0x1F == 0x1F:
            return None
        tag, length = data[at], data[at + 1]
        at += 2
        if length & 0x80:
            size = length & 0x7F
            if not 1 <= size <= 4 or at + size > len(data) or data[at] == 0:
                return None
            length = int.from_bytes(data[at:at + size], "big")
            at += size
            if length < 128:
                return None
        if at + length > len(data):
            return None
        out.append((tag, data[at:at + length]))
        at += length
    return out


def nested(data: bytes, depth: int = 0) -> bool:
    """All constructed elements below parse to their ends."""
    found = elements(data)
    return found is not None and depth < MAX_DEPTH and all(
        nested(content, depth + 1) for tag, content in found if tag & 0x20)


def is_der_key(data: bytes) -> bool:
    if len(data) < 32 or data[0] != SEQUENCE or not nested(data):
        return False
    outer = elements(data)
    if len(outer) != 1:
        return False
    fields = elements(outer[0][1])
    tags = [t for t, _ in fields]
    first = fields[0][1] if fields else b""
    if tags == [INTEGER] * 6 and first == b"\0":                  # DSA: version, p, q, g and both keys
        return len(fields[1][1]) >= 64 and 20 <= len(fields[2][1]) <= 33
    if len(tags) >= 9 and tags[:9] == [INTEGER] * 9 and first in (b"\0", b"\1"):
        return len(fields[1][1]) >= 32                            # PKCS#1: version, modulus, exponents, ...
    if tags[:3] == [INTEGER, SEQUENCE, OCTETS] and first in (b"\0", b"\1"):
        return names_algorithm(fields[1][1]) and len(fields[2][1]) >= 16              # PKCS#8
    if tags[:2] == [INTEGER, OCTETS] and first == b"\1":
        return len(fields[1][1]) in (24, 28, 32, 48, 66) and set(tags[2:]) <= {CONTEXT_0, CONTEXT_0 + 1}  # SEC 1
    if tags == [SEQUENCE, OCTETS]:
        return names_algorithm(fields[0][1]) and len(fields[1][1]) >= 32 and len(fields[1][1]) % 8 == 0  # encrypted
    return False


def names_algorithm(content: bytes) -> bool:
    fields = elements(content)
    return bool(fields) and fields[0][0] == OID and len(fields[0][1]) >= 3


def strings(data: bytes, n: int) -> tuple[list[bytes], bytes] | None:
    """``n`` strings with 32-bit lengths, and what follows."""
    out = []
    for _ in range(n):
        size = int.from_bytes(data[:4], "big")
        if len(data) < 4 + size:
            return None
        out.append(data[4:4 + size])
        data = data[4 + size:]
    return out, data


def ssh_size(data: bytes) -> int | None:
    """Bytes of the OpenSSH container that ``data`` begins with; None if it begins with none."""
    if not data.startswith(OPENSSH):
        return None
    head = strings(data[len(OPENSSH):], 3)                        # cipher, derivation, its options
    if head is None or len(head[1]) < 4:
        return None
    keys = int.from_bytes(head[1][:4], "big")
    if not 1 <= keys <= 64:
        return None
    body = strings(head[1][4:], keys + 1)                         # public keys, then the private part
    if body is None or not body[0][-1]:
        return None
    private = body[0][-1]
    if head[0][0] == b"none":                                     # readable: both check numbers agree
        fits = len(private) >= 8 and private[:4] == private[4:8] and strings(private[8:], 2) is not None
    else:
        fits = len(private) % 8 == 0
    return len(data) - len(body[1]) if fits else None


def der_size(head: bytes) -> int | None:
    """Bytes of the DER sequence whose first (at most six) bytes are given, as its length says."""
    if len(head) < 2 or head[0] != SEQUENCE:
        return None
    if head[1] < 128:
        return 2 + head[1]
    size = head[1] & 0x7F
    return 2 + size + int.from_bytes(head[2:2 + size], "big") if 1 <= size <= 4 and len(head) >= 2 + size else None


def may_be_key(first: bytes, size: int) -> bool:
    """Whether the first field of a sequence of ``size`` bytes is a version, or a sequence that fits."""
    at = 2 + (first[1] & 0x7F if first[1] & 0x80 else 0)
    if first[at:at + 1] == bytes([INTEGER]):
        return first[at + 1:at + 3] in (b"\1\0", b"\1\1")
    inner = der_size(first[at:])
    return inner is not None and at + inner <= size


def is_signed_token(header: str, claims: str, signature: str) -> bool:
    parts = []
    for part in (header, claims):
        data = decoded(part)
        try:
            parts.append(json.loads(data) if data is not None else None)
        except (ValueError, RecursionError):
            return False
    data = decoded(signature)
    if data is None or not all(isinstance(p, dict) for p in parts):
        return False
    return isinstance(name := parts[0].get("alg"), str) and len(data) in SIGNATURES.get(name, ())


def key_at(first: bytes, rest: Callable[[int | None], bytes | None]) -> tuple[int, str] | None:
    """(bytes, kind) of the key that begins with ``first``; ``rest(n)`` gives n bytes from there, or all."""
    if (size := der_size(first)) is not None:
        data = rest(size) if size >= 32 and may_be_key(first, size) else None
        return (size, "der_key") if data is not None and is_der_key(data) else None
    if first.startswith(OPENSSH[:len(first)]) and (data := rest(None)) is not None and (size := ssh_size(data)):
        return size, "ssh_key"
    return None


def key_kind(data: bytes | None) -> str | None:
    if not data:
        return None
    return "der_key" if is_der_key(data) else "ssh_key" if ssh_size(data) else None


def whole(body: str) -> bytes | None:
    """Bytes of a base64 run without what follows its last full byte."""
    return decoded(body[:-1] if len(body) % 4 == 1 else body)


def keys_in(body: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of keys in a run, wherever in it they begin and end."""
    out, at = [], 0
    for m in BASE64_START.finditer(body):
        a = m.start()

        def rest(n):
            chars = len(body) - a if n is None else -(-4 * n // 3)
            data = whole(body[a:a + chars]) if a + chars <= len(body) else None
            return data if data is None or n is None else data[:n]

        if a >= at and (key := key_at(whole(body[a:a + 16]) or b"", rest)):
            at = a - (-4 * key[0] // 3)
            out.append((a, at, key[1]))
    for run in HEX_RUN.finditer(body):
        for m in HEX_START.finditer(run[0]):
            a = run.start() + m.start()

            def rest(n):
                end = run.end() - (run.end() - a) % 2 if n is None else a + 2 * n
                return bytes.fromhex(body[a:end]) if end <= run.end() else None

            if a >= at and run.end() - a >= 24 and (key := key_at(bytes.fromhex(body[a:a + 24]), rest)):
                at = a + 2 * key[0]
                out.append((a, at, key[1]))
    return out


def wrapped_keys(body: str) -> list[tuple[int, int, str]]:
    """The same for keys encoded once more: PEM or a run in what the run decodes to, at any of four offsets."""
    out = []
    for k in range(4):
        data = whole(body[k:])
        inner = data.decode("latin-1") if data else ""
        found = pem_keys(inner)
        found += [s for s in run_keys(inner, keys_in) if not any(s[0] < b and a < s[1] for a, b, _ in found)]
        for a, b, kind in found:
            b += len(inner[b:]) - len(inner[b:].lstrip())         # a line end after the armour
            out.append((k + 4 * a // 3, min(len(body), k - (-4 * b // 3)), kind))
    return out


def pem_keys(text: str) -> list[tuple[int, int, str]]:
    if "PRIVATE KEY-----" not in text:
        return []
    found = ((m, pem_kind(m[2], decoded(re.sub(r"\\n|\\r|\s", "", m[3])))) for m in PEM.finditer(text))
    return [(*m.span(), kind) for m, kind in found if kind]


def pem_kind(header: str, data: bytes | None) -> str | None:
    """Of a body with the header of the old encryption: whole blocks and a start vector of that size."""
    if cipher := CIPHER.search(header):
        block = 8 if cipher[1] in ("DES", "IDEA", "RC2", "BF") else 16
        return "der_key" if data and len(data) >= 32 and len(data) % block == 0 and len(cipher[2]) == 2 * block else None
    return key_kind(data)


def run_keys(text: str, search: Callable[[str], list[tuple[int, int, str]]]) -> list[tuple[int, int, str]]:
    """What ``search`` finds in the runs of a text, lines of a wrapped run joined; with the padding."""
    out = []
    for m in RUN.finditer(text):
        lines = [(x.start(1), x[1]) for x in LINE.finditer(text, m.start(), m.end()) if x[1]]
        body = "".join(x for _, x in lines)
        if len(body) < RUN_CHARS:
            continue
        for a, b, kind in search(body):
            start, end = place(lines, a), place(lines, b - 1) + 1
            out.append((start, m.end() if text[end:m.end()].strip("=") == "" else end, kind))
    return out


def place(lines: list[tuple[int, str]], at: int) -> int:
    """Where in the text the character ``at`` of the joined lines stands."""
    for start, line in lines:
        if at < len(line):
            return start + at
        at -= len(line)
    raise IndexError(at)


def keys_and_wrapped(body: str) -> list[tuple[int, int, str]]:
    """Keys of the run as it stands, and those it holds encoded once more beside them."""
    direct = keys_in(body)
    return direct + [s for s in wrapped_keys(body) if not any(s[0] < b and a < s[1] for a, b, _ in direct)]


def confirmed(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, kind) of what its structure confirms."""
    if ".eyJ" in text:
        for m in TOKEN.finditer(text):
            if is_signed_token(*m.groups()):
                yield m.start(), m.end(), "signed_token"
    armoured = pem_keys(text)
    yield from armoured
    for start, end, kind in run_keys(text, keys_and_wrapped):
        if not any(start < b and a < end for a, b, _ in armoured):
            yield start, end, kind


def base_spans(text: str) -> Iterator[tuple[int, int, str]]:
    for m in ASSIGN.finditer(text):
        if len(m[2]) >= 12:
            yield m.start(), m.end(), "assign"
    if "AKIA" in text:
        for m in ACCESS.finditer(text):
            if m.end() - m.start() >= 18:
                yield m.start(), m.end(), "access"
    for m in HEX.finditer(text):
        yield m.start(), m.end(), "hex"


def secrets_in(text: str) -> list[tuple[int, int, str]]:
    """All spans by start, then kind as listed."""
    return sorted([*base_spans(text), *confirmed(text)], key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def masked(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each stretch of overlapping spans replaced by its first kind."""
    out, at = [], 0
    for start, end, kind in spans:
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join(out) + text[at:]


SCHEMA = "doc_id bigint, spans array<struct<start:bigint,end:bigint,kind:string>>, clean_text string"
SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))


def secret_spans(docs: DataFrame, *, with_text: bool = True) -> DataFrame:
    """Spans of every text and, if asked for, the text without them (null text stays null)."""
    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [(t, secrets_in(t)) for t in texts_of(batch)]
            spans = [[{"start": a, "end": b, "kind": k} for a, b, k in s] for _, s in found]
            clean = [None if not given else masked(t, s) if s else t
                     for given, (t, s) in zip(column(batch, "text").is_valid().to_pylist(), found)] \
                if with_text else [None] * len(found)
            return pa.RecordBatch.from_arrays(
                [column(batch, "doc_id"), pa.array(spans, SPAN), pa.array(clean, pa.string())],
                ["doc_id", "spans", "clean_text"])

        return step

    return map_batches(docs.select("doc_id", "text"), SCHEMA, make)


def without_secrets(docs: DataFrame) -> DataFrame:
    """All rows and columns; secrets in the text are masked, and ``n_chars`` is that of the new text."""
    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            at, length = (batch.schema.get_field_index(c) for c in ("text", "n_chars"))
            texts, lengths = batch.column(at).to_pylist(), batch.column(length).to_pylist()
            for k, text in enumerate(texts):
                if text and (spans := secrets_in(text)):
                    texts[k] = masked(text, spans)
                    lengths[k] = len(texts[k])
            batch = batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.column(at).type))
            return batch.set_column(length, batch.schema.field(length), pa.array(lengths, batch.column(length).type))

        return step

    return map_batches(docs, docs.schema, make)


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def digest(spans: list[tuple[int, int, str]]) -> str:
    return hashlib.sha256(joined([s for s in spans if s[2] in BASE_KINDS]).encode()).hexdigest()
