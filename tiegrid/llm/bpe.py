"""BPE encoding by a dynamic programme over prefixes, and decoding.

For every prefix of a word there is exactly one token with which its encoding
can end. A suffix automaton of the vocabulary, run over the word, lists the
tokens that end at each position; the one that is compatible with the last
token of the prefix before it is stored, and following the stored tokens back
from the end of the word gives the exact ids, with no merge loop.

Two tokens are compatible if encoding their joined text gives just these two.
A merge across their border joins a node of the left token's right spine to a
node of the right token's left spine. It happens if that pair has a merge whose
rank comes before the merge that takes the left node away and not after the one
that takes the right node away (of two equal merges the left one is done first).
"""

from __future__ import annotations

import json
import unicodedata
from hashlib import sha256

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tiegrid.llm.common import map_texts, string_sha256, worker_object

#: White space as the tokenizer's pattern library has it.
SPACES = regex.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+")
#: The pieces of a lower-cased text; fixed by the tokenizer file.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^ \p{L}\p{N}]+")
WORD_END = "</w>"
#: Chunks of text, and pieces, whose encodings a worker keeps at least, and pairs of tokens that it has tried.
CACHE, PAIRS = 350_000, 400_000
NEVER = 1 << 60


def tokenizer_tables(path: str) -> dict:
    """The vocabulary, merges and special tokens of a tokenizer file, to send to executors; its size is fixed by the file."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model = spec["model"]
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    return {"vocab": model["vocab"], "merges": merges, "special": {x["content"]: x["id"] for x in spec["added_tokens"]}}


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class Automaton:
    """A suffix automaton of many symbol sequences, with the sequences that end at each state."""

    def __init__(self) -> None:
        self.next: dict[int, int] = {}
        self.link, self.length = [-1], [0]
        self.ends: dict[int, int] = {}
        self.arcs: list[list[int]] = [[]]

    def _state(self, length: int, link: int, arcs: list[int], like: int | None = None) -> int:
        made = len(self.link)
        self.length.append(length)
        self.link.append(link)
        self.arcs.append(list(arcs))
        for symbol in arcs:
            self.next[made << 10 | symbol] = self.next[like << 10 | symbol]
        return made

    def _split(self, parent: int, child: int, symbol: int) -> int:
        """The state for the parent's longest string and the symbol, cut off from ``child``."""
        made = self._state(self.length[parent] + 1, self.link[child], self.arcs[child], child)
        self.link[child] = made
        while parent >= 0 and self.next.get(parent << 10 | symbol) == child:
            self.next[parent << 10 | symbol] = made
            parent = self.link[parent]
        return made

    def add(self, symbols: list[int], token: int) -> None:
        last = 0
        for symbol in symbols:
            found = self.next.get(last << 10 | symbol)
            if found is not None:
                last = found if self.length[found] == self.length[last] + 1 else self._split(last, found, symbol)
                continue
            made, at = self._state(self.length[last] + 1, 0, []), last
            while at >= 0 and (found := self.next.get(at << 10 | symbol)) is None:
                self.next[at << 10 | symbol] = made
                self.arcs[at].append(symbol)
                at = self.link[at]
            if at >= 0:
                self.link[made] = found if self.length[found] == self.length[at] + 1 else self._split(at, found, symbol)
            last = made
        self.ends[last] = token

    def finish(self) -> None:
        """Give each state the nearest state on its suffix path at which a whole sequence ends."""
        order = sorted(range(1, len(self.link)), key=self.length.__getitem__)
        self.nearest = [-1] * len(self.link)
        for state in order:
            up = self.link[state]
            self.nearest[state] = up if up in self.ends else self.nearest[up]
        del self.arcs


class Encoder:
    """Encodes and decodes as the tokenizers library does with the same file."""

    def __init__(self, tables: dict) -> None:
        self.vocab: dict[str, int] = tables["vocab"]
        self.strings = {i: s for s, i in self.vocab.items()} | {i: s for s, i in tables["special"].items()}
        self.special = tables["special"]
        self.special_at = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.bytes = byte_symbols()
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for rank, (a, b) in enumerate(tables["merges"]):
            pair, whole = (self.vocab[a], self.vocab[b]), self.vocab[a + b]
            self.rank.setdefault(pair, rank)
            self.parts.setdefault(whole, (*pair, rank))
        self.right: dict[int, tuple] = {}
        self.left: dict[int, tuple] = {}
        self.fits: dict[int, bool] = {}
        self.symbols = {c: k for k, c in enumerate(self.bytes)}
        self.length = {}
        self.automaton = Automaton()
        for string, token in self.vocab.items():
            symbols = self._symbols(string)
            if symbols is not None and self._reachable(token):
                self.length[token] = len(symbols)
                self.automaton.add(symbols, token)
        self.automaton.finish()
        self.inner = [self.symbols[c] for c in self.bytes]
        self.shown = {str(i): s for i, s in self.strings.items()}
        self.cache: dict[str, str] = {}
        self.older: dict[str, str] = {}
        self.pieces: dict[str, str] = {}

    def _symbols(self, string: str) -> list[int] | None:
        """The symbols of a token; the last one of a word is another symbol than inside."""
        ends = string.endswith(WORD_END) and len(string) > len(WORD_END)
        core = string[: -len(WORD_END)] if ends else string
        if not all(c in self.symbols for c in core):
            return None
        found = [self.symbols[c] for c in core]
        if ends:
            found[-1] += 256
        return found

    def _right_spine(self, token: int) -> tuple:
        """(node, rank of the merge that takes it away) from the token down its right side."""
        if token not in self.right:
            out, node, taken = [], token, NEVER
            while True:
                out.append((node, taken))
                if node not in self.parts:
                    break
                _, node, taken = self.parts[node]
            self.right[token] = tuple(out)
        return self.right[token]

    def _left_spine(self, token: int) -> tuple:
        if token not in self.left:
            out, node, taken = [], token, NEVER
            while True:
                out.append((node, taken))
                if node not in self.parts:
                    break
                node, _, taken = self.parts[node]
            self.left[token] = tuple(out)
        return self.left[token]

    def _crosses(self, a: int, b: int, before: int = NEVER) -> bool:
        """Whether a merge across the border of tokens a and b comes before rank ``before``."""
        rank = self.rank
        for x, x_taken in self._right_spine(a):
            for y, y_taken in self._left_spine(b):
                found = rank.get((x, y))
                if found is not None and found < before and found < x_taken and found <= y_taken:
                    return True
        return False

    def _reachable(self, token: int) -> bool:
        """Whether encoding the token's own text gives the token."""
        stack = [token]
        while stack:
            node = stack.pop()
            if node in self.parts:
                a, b, rank = self.parts[node]
                if self._crosses(a, b, rank):
                    return False
                stack += [a, b]
        return True

    def compatible(self, a: int, b: int) -> bool:
        key = a << 32 | b
        found = self.fits.get(key)
        if found is None:
            if len(self.fits) > PAIRS:
                self.fits.clear()
            found = self.fits[key] = not self._crosses(a, b)
        return found

    def encode_piece(self, piece: str) -> list[int]:
        """The ids of one piece of text, which ends a word."""
        symbols = list(map(self.inner.__getitem__, piece.encode()))
        symbols[-1] |= 256
        automaton, lengths, known = self.automaton, self.length, self.fits.get
        step, link, ends, nearest, longest = automaton.next.get, automaton.link, automaton.ends, automaton.nearest, automaton.length
        last = [-1]
        state = matched = at = 0
        for symbol in symbols:
            at += 1
            while (found := step(state << 10 | symbol)) is None and state:
                state = link[state]
                matched = longest[state]
            state, matched = (found, matched + 1) if found is not None else (0, 0)
            # What ends at a state is its longest string; if less is matched, look on higher up.
            node = state if longest[state] == matched and state in ends else nearest[state]
            token = -1
            while node >= 0:
                token = ends[node]
                start = at - longest[node]
                if not start:
                    break
                before = last[start]
                if before >= 0:
                    fit = known(before << 32 | token)
                    if fit or fit is None and self.compatible(before, token):
                        break
                token = -1
                node = nearest[node]
            last.append(token)
        out = []
        while at > 0:
            token = last[at]
            if token < 0:
                raise ValueError(f"the vocabulary can't encode {piece!r}")
            out.append(token)
            at -= lengths[token]
        return out[::-1]

    def _chunk(self, chunk: str) -> str:
        """The ids of a stretch without white space, joined by spaces. What was in use lately is kept."""
        made = self.older.get(chunk)
        if made is None:
            made = " ".join([self.pieces.get(p) or self._piece(p) for p in PIECES.findall(chunk)])
        if len(self.cache) >= CACHE:
            self.older, self.cache = self.cache, {}
        if len(chunk) < 100:
            self.cache[chunk] = made
        return made

    def _piece(self, piece: str) -> str:
        made = " ".join(map(str, self.encode_piece(piece)))
        if len(self.pieces) >= CACHE:
            self.pieces.clear()
        if len(piece) < 100:
            self.pieces[piece] = made
        return made

    def _segments(self, text: str):
        """(special id or None, text) from left to right; special tokens are found before any other step."""
        at = 0
        if self.special_at:
            for m in self.special_at.finditer(text):
                if m.start() > at:
                    yield None, text[at : m.start()]
                yield self.special[m.group()], m.group()
                at = m.end()
        if at < len(text):
            yield None, text[at:]

    def _chunks(self, text: str) -> list[str]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            # Lower case is taken character by character, without the rule for a final sigma.
            text = text.replace("Σ", "σ")
        return SPACES.sub(" ", text).lower().split(" ")

    def encode_text(self, text: str) -> str:
        """The ids of a text, joined by spaces."""
        ids: list[str] = []
        get, make = self.cache.get, self._chunk
        for special, part in self._segments(text):
            if special is not None:
                ids.append(str(special))
                continue
            for c in self._chunks(part):
                made = get(c)
                if made is None:
                    made = make(c)
                    get = self.cache.get
                if made:
                    ids.append(made)
        return " ".join(ids)

    def encode(self, text: str) -> list[int]:
        return [int(i) for i in self.encode_text(text).split()]

    def decode_shown(self, ids: list[str]) -> str:
        """The tokens of decimal ids joined by spaces, as the file names no decoder; unknown ids give nothing."""
        try:
            return " ".join(map(self.shown.__getitem__, ids))
        except KeyError:
            return " ".join([self.shown[i] for i in ids if i in self.shown])

    def decode(self, ids: list[int]) -> str:
        return self.decode_shown(list(map(str, ids)))


def worker_encoder(shared) -> Encoder:
    """The encoder of a broadcast tokenizer, built once in each Python worker."""
    return worker_object("bpe", shared.value["key"], lambda: Encoder(shared.value["tables"]))


def _broadcast(docs: DataFrame, path: str):
    with open(path, "rb") as f:
        key = sha256(f.read()).hexdigest()
    return docs.sparkSession.sparkContext.broadcast({"key": key, "tables": tokenizer_tables(path)})


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", slim: bool = False) -> DataFrame:
    """(id, n_tokens, ids, decoded): every whole text encoded with a tokenizer file, then decoded.

    With ``slim``, ids_sha256 and decoded_sha256 (of the decimal ids joined by
    one space, and of the decoded text in UTF-8) stand in place of the last
    two. A null text counts as empty and gives no ids. Repeated rows and rows
    with a null id each give their row; an empty table gives an empty result.
    """
    shared = _broadcast(docs, path)

    def rows(texts: list[bytes]) -> list[pa.Array]:
        encoder = worker_encoder(shared)
        counts, first, second = [], [], []
        for raw in texts:
            shown = encoder.encode_text(raw.decode())
            ids = shown.split()
            decoded = encoder.decode_shown(ids)
            counts.append(len(ids))
            first.append(string_sha256(shown) if slim else np.array(ids, np.int32))
            second.append(string_sha256(decoded) if slim else decoded)
        if slim:
            made = pa.array(first, pa.string())
        else:
            made = pa.ListArray.from_arrays(np.cumsum([0, *counts]).astype(np.int32), pa.array(np.concatenate([np.zeros(0, np.int32), *first])))
        return [pa.array(counts, pa.int64()), made, pa.array(second, pa.string())]

    second = "ids_sha256 string, decoded_sha256 string" if slim else "ids array<int>, decoded string"
    fields = f"n_tokens bigint, {second}"
    return map_texts(docs, rows, fields, id_col, text_col, "bpe")


def decode_documents(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, decoded): the text of every list of ids; null lists count as empty."""
    shared = _broadcast(encoded, path)
    kind = encoded.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            encoder = worker_encoder(shared)
            texts = [encoder.decode(ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_col, "decoded"])

    return encoded.select(id_col, ids_col).mapInArrow(run, f"{id_col} {kind}, decoded string")
