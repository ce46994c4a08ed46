"""BPE as a streaming transducer with bounded lookahead, and a decoder that streams bytes to text.

Merges run from the best rank to the worst. Text that is still to come can change what stands to the left
of it only through a chain of merges of rising rank, each of which takes in one symbol more on its left;
the longest such chain that the merge list allows is its sufficient lookahead. Tokens that end so many
characters before the last one read are stable. The transducer therefore holds only the lookahead and one
block of a pre-token, however long this is. A text is composed (NFC) in parts, cut where no character joins
to the one before; only a run of characters that do, such as accents upon accents, is held until it ends.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterable, Iterator
from functools import cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices


@cache
def joining() -> frozenset[str]:
    """Characters that may join to what stands before them, or change places with it, when a text is composed
    (NFC): marks, second parts of compositions (Hangul vowels and finals too), and what decomposes into either."""
    every = map(chr, range(0x110000))
    parts = {c: unicodedata.normalize("NFD", c) for c in every if unicodedata.decomposition(c) and unicodedata.decomposition(c)[0] != "<"}
    seconds = {p[-1] for p in parts.values() if len(p) > 1} | set(map(chr, [*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)]))
    seconds |= {unicodedata.normalize("NFC", p[1:])[0] for p in parts.values() if len(p) > 1}
    first = lambda c: parts.get(c, c)[0]
    return frozenset(c for c in map(chr, range(0x110000)) if unicodedata.combining(first(c)) or first(c) in seconds)


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself where it prints, else from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


def lookahead(merges: Iterable[tuple[str, str]], suffix: str) -> int:
    """Characters after which what stands before can no longer change.

    A chain moves left by the left part of a merge, and goes on with a merge of a worse rank whose right
    part begins with this left part; ``begins``: tokens that a token's leftmost merges pass through.
    """
    lefts: dict[str, set[str]] = {}
    reach: dict[str, int] = {}
    longest = 0
    for a, b in merges:
        begins, todo = {b}, [b]
        while todo:
            for x in lefts.get(todo.pop(), ()):
                if x not in begins:
                    begins.add(x)
                    todo.append(x)
        length = len(a.removesuffix(suffix) if suffix else a) + max((reach.get(x, 0) for x in begins), default=0)
        reach[a] = max(reach.get(a, 0), length)
        longest = max(longest, length)
        lefts.setdefault(a + b, set()).add(a)
    return longest


class Model:
    """A vocabulary file of the tokenizers library with a BPE model, byte-level alphabet and split pattern."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("dropout") or model.get("continuing_subword_prefix"):
            raise ValueError("only plain BPE models are read")
        self.suffix = model.get("end_of_word_suffix") or ""
        self.vocab: dict[str, int] = model["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.ranks = {m: i for i, m in enumerate(merges)}
        self.lookahead = lookahead(merges, self.suffix)
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        self.names = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.specials = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.special_length = max(map(len, self.special), default=0)
        steps = self._steps(spec.get("normalizer"), "normalizers")
        self.nfc = any(s["type"] == "NFC" for s in steps)
        self.lower = any(s["type"] == "Lowercase" for s in steps)
        split = next(s for s in self._steps(spec["pre_tokenizer"], "pretokenizers") if s["type"] == "Split")
        if split["behavior"] != "Removed" or not split["invert"]:
            raise ValueError("the split pattern has to name the pieces to keep")
        self.pattern = regex.compile(split["pattern"]["Regex"])
        self.joins = spec.get("decoder") is None  # then tokens are joined by spaces, and bytes stay in their alphabet

    @staticmethod
    def _steps(spec: dict | None, key: str) -> list[dict]:
        return [] if spec is None else spec.get(key, [spec])


@cache
def load(path: str) -> Model:
    return Model(path)


class Piece:
    """Transducer for one pre-token, fed in parts."""

    def __init__(self, model: Model, block: int = 1024):
        self.model, self.block = model, block
        self.symbols: list[str] = []

    def merge(self, symbols: list[str]) -> list[str]:
        """All merges by rank, then from the left; neighbours are linked, candidates wait in a heap."""
        n, ranks = len(symbols), self.model.ranks
        if n < 2:
            return symbols
        symbols = symbols[:]
        if n <= 64:
            none, get = 1 << 60, ranks.get
            open_ranks = [get(p, none) for p in zip(symbols, symbols[1:])]
            while open_ranks and (best := min(open_ranks)) < none:
                k = open_ranks.index(best)
                symbols[k : k + 2] = [symbols[k] + symbols[k + 1]]
                del open_ranks[k]
                if k:
                    open_ranks[k - 1] = get((symbols[k - 1], symbols[k]), none)
                if k < len(open_ranks):
                    open_ranks[k] = get((symbols[k], symbols[k + 1]), none)
            return symbols
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(r, i, symbols[i], symbols[i + 1]) for i in range(n - 1) if (r := ranks.get((symbols[i], symbols[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if symbols[i] != a or j < 0 or symbols[j] != b or not a:
                continue
            symbols[i], symbols[j] = a + b, ""
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
            for x, y in ((before[i], i), (i, k)):
                if x >= 0 and y >= 0 and (r := ranks.get((symbols[x], symbols[y]))) is not None:
                    heapq.heappush(heap, (r, x, symbols[x], symbols[y]))
        return [s for s in symbols if s]

    def feed(self, letters: str) -> Iterator[int]:
        """``letters``: more of the piece, in the byte alphabet; gives the tokens that are now stable."""
        self.symbols += letters
        hold = self.model.lookahead + 1
        while len(self.symbols) > hold + 2 * self.block:
            part = self.symbols[: hold + 2 * self.block]
            ids, done = [], 0
            for token in self.merge(part):
                if done + len(token) > len(part) - hold:
                    break
                done += len(token)
                ids.append(self.model.vocab[token])
            del self.symbols[:done]
            yield from ids

    def end(self) -> Iterator[int]:
        if self.symbols:
            self.symbols[-1] += self.model.suffix
            for token in self.merge(self.symbols):
                yield self.model.vocab[token]
            self.symbols = []


class Encoder:
    """Text in, token ids out as soon as they are stable. ``feed`` takes parts of any size."""

    def __init__(self, model: Model, most_known: int = 200_000, long: int = 512):
        self.model, self.long = model, long
        self.alphabet = byte_alphabet()
        self.known: dict[str, tuple[int, ...]] = {}
        self.most_known = most_known
        self.raw = ""  # text not yet normalised: it might still change
        self.text = ""  # normalised text not yet cut
        self.open: Piece | None = None  # a long piece that may go on
        self.kind: regex.Pattern | None = None
        self._letters, self._rest = regex.compile(r"\p{L}*"), regex.compile(r"[^\s\p{L}\p{N}]*")
        self._joining = joining() if model.nfc else frozenset()

    def _mapped(self, piece: str) -> str:
        alphabet = self.alphabet
        return piece if piece.isascii() and piece.isprintable() and " " not in piece else "".join([alphabet[b] for b in piece.encode()])

    def word(self, piece: str) -> tuple[int, ...]:
        found = self.known.get(piece)
        if found is None:
            one = Piece(self.model)
            found = (*one.feed(self._mapped(piece)), *one.end())
            if len(piece) <= 64:
                if len(self.known) >= self.most_known:
                    self.known.clear()
                self.known[piece] = found
        return found

    def feed(self, part: str) -> Iterator[int]:
        raw = self.raw + part
        at = self._safe(raw)
        self.raw = raw[at:]
        yield from self._segments(raw[:at], False)

    def end(self) -> Iterator[int]:
        raw, self.raw = self.raw, ""
        yield from self._segments(raw, True)

    def _safe(self, raw: str) -> int:
        """Where ``raw`` may be cut: before white space if there is some, else before a character that joins
        to nothing before it and can't lie in a special token. So little more than a run of joining
        characters is held."""
        for k in range(len(raw) - 1, max(-1, len(raw) - 4096), -1):
            if raw[k].isspace():
                return k
        tail = len(raw) - 2 * self.model.special_length
        heads = [raw.find(t[0], max(tail, 0)) for t in self.model.special]
        return self._start(raw, min([k for k in heads if k >= 0], default=len(raw) - 1))

    def _start(self, raw: str, k: int) -> int:
        while k > 0 and raw[k] in self._joining:
            k -= 1
        return k

    def _segments(self, raw: str, last: bool) -> Iterator[int]:
        at = 0
        if self.model.specials is not None:
            for m in self.model.specials.finditer(raw):
                yield from self._pieces(self._normal(raw[at : m.start()]), True)
                yield self.model.special[m[0]]
                at = m.end()
        yield from self._pieces(self._normal(raw[at:]), last)

    def _normal(self, text: str) -> str:
        if self.model.nfc and not text.isascii():
            text = unicodedata.normalize("NFC", text)
        if self.model.lower:
            # one character at a time, as the library does: no final sigma
            text = text.lower() if "Σ" not in text else text.replace("Σ", "σ").lower()
        return text

    def _pieces(self, text: str, last: bool) -> Iterator[int]:
        if self.open is not None:
            more = self.kind.match(text)
            yield from self.open.feed(self._mapped(more[0]))
            text = text[more.end() :]
            if not text and not last:
                return
            yield from self.open.end()
            self.open = None
        text, self.text = self.text + text, ""
        found = self.model.pattern.findall(text)
        held = None
        if not last and found and text.endswith(found[-1]):
            held = found.pop()  # may go on with the next part
            if len(held) == 1 and found and found[-1] == "'" and text.endswith("'" + held):
                held = found.pop() + held  # perhaps a contraction
        known, word = self.known, self.word
        for piece in found:
            ids = known.get(piece)
            yield from ids if ids is not None else word(piece)
        if held is None:
            return
        if len(held) < self.long:
            self.text = held
            return
        self.kind = self._letters if held[0].isalpha() and self._letters.fullmatch(held) else self._rest
        self.open = Piece(self.model)
        yield from self.open.feed(self._mapped(held))


class Decoder:
    """Token ids in, text out: bytes of tokens pass through a UTF-8 state machine, which keeps the bytes of
    an unfinished character until the rest comes."""

    def __init__(self, model: Model):
        self.utf8 = codecs.getincrementaldecoder("utf-8")("replace")
        back = {c: bytes([b]) for b, c in enumerate(byte_alphabet())}
        plain = lambda t: t.encode() if model.joins else b"".join(back.get(c, c.encode()) for c in t)
        self.bytes = [plain(model.names[i]) if i in model.names else b"" for i in range(max(model.names) + 1)]
        self.between, self.first = b" " if model.joins else b"", True

    def feed(self, ids: list[int]) -> str:
        if not ids:
            return ""
        raw = self.between.join(map(self.bytes.__getitem__, ids))
        raw, self.first = raw if self.first else self.between + raw, False
        return self.utf8.decode(raw)

    def end(self) -> str:
        return self.utf8.decode(b"", True)


SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, ids array<int>"


def encode_documents(docs: DataFrame, path: str, keep_ids: bool = False, part: int = 1 << 16) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, ids (null unless ``keep_ids``) for every row.

    ``path``: the vocabulary file, at the same place on all executors. Texts go through encoder and decoder
    in parts of ``part`` characters, however long they are. A null or empty text has no tokens. Only doc_id
    and text are read; repeated rows give repeated rows, a null doc_id stays null, an empty table gives no row.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        encoder, decoder = Encoder(model), Decoder(model)
        names = [str(i) for i in range(max(model.names) + 1)]
        for b in slices(batches):
            n, ids_hash, text_hash, kept = [], [], [], []
            for text in b.column("text").to_pylist():
                text = text or ""
                a, t, count, every = hashlib.sha256(), hashlib.sha256(), 0, []
                decoder.first = True
                for at in range(0, len(text) + part, part):
                    ids = list(encoder.feed(text[at : at + part]) if at < len(text) else encoder.end())
                    if ids:
                        a.update(((" " if count else "") + " ".join(map(names.__getitem__, ids))).encode())
                        t.update(decoder.feed(ids).encode())
                        count += len(ids)
                        if keep_ids:
                            every += ids
                t.update(decoder.end().encode())
                n.append(count)
                ids_hash.append(a.hexdigest())
                text_hash.append(t.hexdigest())
                kept.append(every if keep_ids else None)
            columns = [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())]
            columns.append(pa.array(kept, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)
