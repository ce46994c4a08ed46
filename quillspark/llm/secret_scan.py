"""Secret scan: patterns of known secrets, and stretches of high entropy.

Beside three patterns, every candidate string (a long run of token characters) is read with a sliding
window for each character class; the window's Shannon entropy comes from counts that change by two
characters a step. Windows above the class's limit join to spans, unless an allow-list clears them.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "entropy")

# Fixed values of the query's contract.
_KEYS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ASSIGN = re.compile(
    r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")

_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")


@dataclass(frozen=True)
class CharClass:
    """Runs of ``pattern`` with ``window`` characters of at least ``bits`` entropy each are secrets."""

    name: str
    pattern: str
    window: int
    bits: float


CLASSES = (
    CharClass("hex", r"[0-9a-fA-F]{20,}", 20, 3.0),
    CharClass("alnum", r"[A-Za-z0-9]{20,}", 20, 3.6),
    CharClass("base64", r"[A-Za-z0-9+/_=-]{24,}", 24, 3.9),
)
#: What clears a candidate: words (a single case and no digit, however long), paths, rulers, known examples.
#: No pattern can match a string in two ways, so that a near miss costs one pass.
ALLOW = (
    r"[A-Z]?[a-z]+(?:[-_/][A-Z]?[a-z]+)*",
    r"[A-Z]+(?:[-_/][A-Z]+)*",
    r"[0-9]+(?:[-_/][0-9]+)*",
    r"(.)\1*",
    r"(?i).*(?:example|placeholder|changeme|xxxx).*",
)


def high_entropy(text: str, window: int, bits: float) -> list[tuple[int, int]]:
    """Spans of ``text`` that consist of windows whose entropy is at least ``bits``."""
    n = len(text)
    if n < window:
        return []
    term = [0.0] + [c * math.log2(c) for c in range(1, window + 1)]  # H = log2(w) - sum(c log2 c) / w
    limit = (math.log2(window) - bits) * window + 1e-9
    counts: dict[str, int] = {}
    total = 0.0
    for c in text[:window]:
        k = counts.get(c, 0)
        counts[c] = k + 1
        total += term[k + 1] - term[k]
    spans: list[tuple[int, int]] = []
    for end in range(window, n + 1):
        if total <= limit:
            start = end - window
            if spans and start <= spans[-1][1]:
                spans[-1] = (spans[-1][0], end)
            else:
                spans.append((start, end))
        if end < n:
            for c, d in ((text[end - window], -1), (text[end], 1)):
                k = counts.get(c, 0)
                counts[c] = k + d
                total += term[k + d] - term[k]
    return spans


class Scanner:
    def __init__(self, classes: tuple[CharClass, ...] = CLASSES, allow: tuple[str, ...] = ALLOW):
        self.classes = [(c, re.compile(c.pattern)) for c in classes]
        self.allow = [re.compile(p, re.DOTALL) for p in allow]

    def base(self, text: str) -> list[tuple[str, int, int]]:
        found = []
        low = text.lower()
        if any(k in low for k in _KEYS):
            found += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
        if "AKIA" in text:
            found += [("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
        found += [("hex", *m.span()) for m in _HEX.finditer(text)]
        return found

    def added(self, text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
        """Spans of high entropy, whole, that reach beyond the characters which ``base`` covers."""
        found: set[tuple[int, int]] = set()
        for m in _CANDIDATE.finditer(text):
            if any(p.fullmatch(m[0]) for p in self.allow):
                continue
            for c, pattern in self.classes:
                for run in pattern.finditer(m[0]):
                    if not any(p.fullmatch(run[0]) for p in self.allow):
                        at = m.start() + run.start()
                        found |= {(at + a, at + b) for a, b in high_entropy(run[0], c.window, c.bits)}
        spans: list[tuple[str, int, int]] = []
        for a, b in sorted(found):
            if spans and a < spans[-1][2]:
                spans[-1] = ("entropy", spans[-1][1], max(b, spans[-1][2]))
            else:
                spans.append(("entropy", a, b))
        covers: list[tuple[int, int]] = []
        for a, b in sorted((a, b) for _, a, b in base):
            if covers and a <= covers[-1][1]:
                covers[-1] = (covers[-1][0], max(b, covers[-1][1]))
            else:
                covers.append((a, b))
        out, k = [], 0
        for kind, a, b in spans:
            while k < len(covers) and covers[k][1] <= a:
                k += 1
            if k == len(covers) or not (covers[k][0] <= a and b <= covers[k][1]):
                out.append((kind, a, b))
        return out

    def scan(self, text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
        """(base spans, all spans), each by start, then kind."""
        order = lambda s: (s[1], KINDS.index(s[0]), s[2])
        base = self.base(text)
        return sorted(base, key=order), sorted(base + self.added(text, base), key=order)


def mask(text: str, spans: list[tuple[str, int, int]], mark: str = "[secret]") -> str:
    out, last = [], 0
    for _, a, b in spans:
        if a >= last:
            out += [text[last:a], mark]
        last = max(last, b)
    return "".join([*out, text[last:]])


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, masked string"


def scan_documents(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """A row per document: counts of base spans, their digest, all spans, and (``keep_text``) the text
    with each span masked.

    A null or empty text has no spans (``masked`` stays null for null); the work for a text is linear in
    its length, very long strings without white space included. Spans that begin together stand in the order
    of ``KINDS``, then by their end; entropy spans that overlap are one. Only doc_id and text are read; rows
    that repeat give repeated rows, a null doc_id stays null, an empty table gives no row.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        write = lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        for batch in batches:
            counts: dict[str, list[int]] = {k: [] for k in KINDS[:3]}
            digests, every, masked = [], [], []
            for text in batch.column("text").to_pylist():
                base, spans = scanner.scan(text or "")
                kinds = [s[0] for s in base]
                for k in counts:
                    counts[k].append(kinds.count(k))
                digests.append(hashlib.sha256(write(base).encode()).hexdigest())
                every.append(write(spans))
                masked.append(mask(text, spans) if keep_text and text is not None else None)
            columns = [batch.column("doc_id"), *map(pa.array, counts.values()), pa.array(digests, pa.string())]
            columns += [pa.array(every, pa.string()), pa.array(masked, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "masked"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def mask_documents(docs: DataFrame) -> DataFrame:
    """``docs`` with the secrets of ``text`` masked and ``n_chars``, where there is one, counted anew.

    All rows and columns stay, repeated ones too; a null text stays null and keeps its ``n_chars``."""
    columns = [f for f in docs.schema.fields if f.name != "text"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for batch in batches:
            texts = batch.column("text").to_pylist()
            masked = [t and mask(t, scanner.scan(t)[1]) for t in texts]
            at = batch.schema.get_field_index("text")
            yield batch.set_column(at, batch.schema.field(at).with_type(pa.string()), pa.array(masked, pa.string()))

    out = docs.mapInArrow(run, docs.schema)
    if any(f.name == "n_chars" for f in columns):
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return out
