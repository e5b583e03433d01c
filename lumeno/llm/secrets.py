"""Secret scans by token efficiency.

Fixed patterns give the base spans. Beyond them, a random string needs many tokens of a common vocabulary: few characters
to a token. Strings that do so are reported as `token` spans, unless they are known digests (plain hex of a digest's
length), UUIDs, or identifiers (parts of letters or of digits alone, joined by separators).

Defined results: null text is the empty text (no spans); equal rows give equal results; an empty table gives an empty
result; other columns are ignored. Whole texts are scanned; only those with a chance of a match see the patterns, which
the byte tests below decide exactly: a hex run of 32 bytes, `AKIA`, one of the assignment's key words, or a long word with
letters and digits.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumeno.llm.wordhash import Words, blocks

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LONG_HEX = re.compile(rb"[0-9a-f]{32}")
KEYS = (b"passw", b"secret", b"token", b"api")
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}(?![A-Za-z0-9+/_=-])")
UUID = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
DIGEST = re.compile(r"[0-9a-f]+|[0-9A-F]+")
PART = re.compile(r"[a-z]+|[A-Z]+[a-z]*|[0-9]+")
#: Hex digits of MD5, SHA-1, SHA-224, SHA-256, SHA-384 and SHA-512 (fixed values).
DIGEST_LENGTHS = frozenset((32, 40, 56, 64, 96, 128))
KINDS = ("assign", "access", "hex", "token")
#: A string of `CANDIDATE` with fewer characters to a token than this is taken for random.
MAX_CHARS_PER_TOKEN = 2.2

_encodings: dict[str, object] = {}
_CLASS = np.zeros((2, 256), bool)
_CLASS[0, 48:58] = True
_CLASS[1, 65:91] = _CLASS[1, 97:123] = True
_HEX = np.zeros(256, bool)
_HEX[48:58] = _HEX[97:103] = True


def encoding(path: str):
    """The tiktoken encoding of a rank file, once in each worker."""
    if path not in _encodings:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encodings[path] = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    return sorted(found + [(m.start(), 2, m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= 32])


def identifier(s: str) -> bool:
    """Parts between separators that each are words or one number, as in camelCase, snake_case and paths."""
    parts = [p for p in re.split(r"[+/_=-]+", s) if p]
    return all(p.isdigit() or len(PART.findall(p)) <= 1 + len(p) // 6 for p in parts)


def random_spans(text: str, base: list[tuple[int, int, int]], enc, most: float = MAX_CHARS_PER_TOKEN) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the strings that the vocabulary encodes badly and no base span touches."""
    found = []
    for m in CANDIDATE.finditer(text):
        s, (a, b) = m[0], m.span()
        if s.isalpha() or s.isdigit() or any(x < b and a < y for x, _, y in base):
            continue
        if UUID.fullmatch(s) or len(s) in DIGEST_LENGTHS and DIGEST.fullmatch(s) or identifier(s):
            continue
        if len(s) < most * len(enc.encode_ordinary(s)):
            found.append((a, 3, b))
    return found


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def suspects(texts: list[bytes]) -> np.ndarray:
    """Positions of the texts that any pattern can match."""
    words = Words(texts)
    low, hits = words.raw.lower(), []
    for key, raw in (*((k, low) for k in KEYS), (b"AKIA", words.raw)):
        at = raw.find(key)
        while at >= 0:
            hits.append(at)
            at = raw.find(key, at + 1)
    long = np.flatnonzero(words.end - words.start >= 20)
    a, b = words.start[long], words.end[long]
    sums = [np.concatenate([[0], np.cumsum(c[words.bytes], dtype=np.int64)]) for c in (*_CLASS, _HEX)]
    digits, letters, hexes = (s[b] - s[a] for s in sums)
    keep = (digits > 0) & (letters > 0) | (hexes >= 32)
    return np.unique(np.searchsorted(words.text_start, np.concatenate([np.array(hits, np.int64), a[keep]]), "right") - 1)


def redact(text: str, spans: list[tuple[int, int, int]], by: str = "<secret>") -> str:
    """The text with every span, or run of overlapping spans, replaced."""
    out, at = [], 0
    for a, _, b in sorted(spans):
        if a >= at:
            out += [text[at:a], by]
        at = max(at, b)
    return "".join(out) + text[at:]


def scan(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", most: float = MAX_CHARS_PER_TOKEN) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_token, redacted (null where nothing was found)."""

    names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_token", "redacted"]
    types = [pa.int64()] * 3 + [pa.string(), pa.string(), pa.int64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = (0, 0, 0, hashlib.sha256(b"").hexdigest(), "", 0, None)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            rows = [nothing] * len(texts)
            for first, some in blocks(texts):
                for k in suspects(some).tolist():
                    text = texts[first + k]
                    base = base_spans(text)
                    spans = sorted(base + random_spans(text, base, encoding(vocabulary), most))
                    if spans:
                        n = [sum(x[1] == kind for x in spans) for kind in range(4)]
                        rows[first + k] = (*n[:3], hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), n[3], redact(text, spans))
            cols = list(zip(*rows)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, types))], names=names)

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_token long, redacted string")


def clean(docs: DataFrame, vocabulary: str, text_col: str = "text", chars_col: str = "n_chars", most: float = MAX_CHARS_PER_TOKEN) -> DataFrame:
    """docs with all columns, every span in a text replaced by <secret>; chars_col, if there is one, follows the text where it changed."""
    at, n_at = docs.columns.index(text_col), docs.columns.index(chars_col) if chars_col in docs.columns else -1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, new = batch.column(at).to_pylist(), {}
            for first, some in blocks(texts):
                for k in suspects(some).tolist():
                    text = texts[first + k]
                    base = base_spans(text)
                    spans = base + random_spans(text, base, encoding(vocabulary), most)
                    if spans:
                        new[first + k] = redact(text, spans)
            cols = list(batch.columns)
            if new:
                cols[at] = pa.array([new.get(k, t) for k, t in enumerate(texts)], batch.schema.types[at])
                if n_at >= 0:
                    cols[n_at] = pa.array([len(new[k]) if k in new else n for k, n in enumerate(cols[n_at].to_pylist())], batch.schema.types[n_at])
            yield pa.RecordBatch.from_arrays(cols, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)
