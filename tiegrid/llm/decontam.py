"""Benchmark decontamination with a suffix automaton of the normalised test items.

The automaton accepts every run of consecutive words of every item. A document
streams through it; at each word the automaton gives the longest run that ends
there and occurs in some item. A run of WINDOW words or more, or a whole item
that is shorter, makes its words hits. The items with such a run follow from the
state that stands for the last WINDOW words.

Items go to the executors in blocks of BLOCK_WORDS words, so what is broadcast
is bounded however many items there are. With several blocks the documents are
numbered and written first; they are read once for each block, whose part is
written before the next block is read, and the parts are merged by row.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiegrid.llm.common import id_type, materialize, text_bytes, worker_object

WINDOW = 10
#: Words of benchmark items that one automaton holds.
BLOCK_WORDS = 1_000_000
#: Every separator byte becomes a space and A-Z become a-z; other bytes stay.
NORMAL = bytes(
    c + 32 if 0x41 <= c <= 0x5A else 0x20 if c <= 0x2F or 0x3A <= c <= 0x60 or 0x7B <= c <= 0x7F else c for c in range(256)
)
WORD = re.compile(rb"[^\x20]+")


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased words: runs of digits, letters a-z and all characters beyond ASCII."""
    return text.translate(NORMAL).split()


@dataclass
class Automaton:
    """A generalised suffix automaton over word numbers."""

    next: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])

    def _copy(self, parent: int, child: int, word: int) -> int:
        made = len(self.next)
        self.next.append(dict(self.next[child]))
        self.length.append(self.length[parent] + 1)
        self.link.append(self.link[child])
        self.link[child] = made
        while parent >= 0 and self.next[parent].get(word) == child:
            self.next[parent][word] = made
            parent = self.link[parent]
        return made

    def add(self, words: list[int]) -> None:
        last = 0
        for word in words:
            child = self.next[last].get(word)
            if child is not None:
                last = child if self.length[child] == self.length[last] + 1 else self._copy(last, child, word)
                continue
            made, at = len(self.next), last
            self.next.append({})
            self.length.append(self.length[last] + 1)
            self.link.append(0)
            while at >= 0 and word not in self.next[at]:
                self.next[at][word] = made
                at = self.link[at]
            if at >= 0:
                child = self.next[at][word]
                self.link[made] = child if self.length[child] == self.length[at] + 1 else self._copy(at, child, word)
            last = made

    def steps(self, words: list[int]) -> Iterator[tuple[int, int]]:
        """(state, length of the longest match that ends here) after each word."""
        state = matched = 0
        for word in words:
            while (found := self.next[state].get(word)) is None and state:
                state = self.link[state]
                matched = self.length[state]
            state, matched = (found, matched + 1) if found is not None else (0, 0)
            yield state, matched

    def up_to(self, state: int, size: int) -> int:
        """The state for the last ``size`` words of a match of that length or more."""
        while self.length[self.link[state]] >= size:
            state = self.link[state]
        return state


class Items:
    """The test items of one block, ready to be searched for."""

    def __init__(self, items: list[tuple[object, list[bytes]]], window: int) -> None:
        self.window = window
        self.numbers: dict[bytes, int] = {}
        listed = []
        for item, words in items:
            if words:
                listed.append((item, [self.numbers.setdefault(w, len(self.numbers) + 1) for w in words]))
        self.automaton = Automaton()
        for _, numbers in listed:
            self.automaton.add(numbers)
        self.by_window: dict[int, set] = {}
        whole: dict[int, list] = {}
        for item, numbers in listed:
            for state, matched in self.automaton.steps(numbers):
                if matched >= window:
                    self.by_window.setdefault(self.automaton.up_to(state, window), set()).add(item)
            if len(numbers) < window:
                whole.setdefault(self.automaton.up_to(state, len(numbers)), []).append((len(numbers), item))
        # Each state also ends with the short items that end at the states above it.
        self.whole: list[list] = [[] for _ in self.automaton.link]
        for state in sorted(range(1, len(self.whole)), key=self.automaton.length.__getitem__):
            self.whole[state] = self.whole[self.automaton.link[state]] + whole.get(state, [])
        self.shortest = min((min(len(n), window) for _, n in listed), default=window)
        # Pairs of words that follow each other in an item, as a bit set of hashes with no missing ones.
        self.pairs = np.zeros(1 << 22, bool)
        for _, numbers in listed:
            n = np.array(numbers)
            self.pairs[self._pair(n[:-1], n[1:])] = True

    @staticmethod
    def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a * 1_000_003 + b) & (1 << 22) - 1

    def runs(self, numbers: np.ndarray) -> list[tuple[int, int]]:
        """Stretches outside which no item of at least ``shortest`` words can occur."""
        known = numbers > 0
        if self.shortest < 2:
            linked = known[1:] & known[:-1]
        else:
            linked = known[1:] & known[:-1] & self.pairs[self._pair(numbers[:-1], numbers[1:])]
        edge = np.diff(np.concatenate(([0], linked.view(np.int8), [0])))
        starts, ends = np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0] + 1
        if self.shortest < 2:
            alone = known.copy()
            for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
                alone[a:b] = False
            single = np.nonzero(alone)[0]
            starts, ends = np.concatenate((starts, single)), np.concatenate((ends, single + 1))
        long = ends - starts >= self.shortest
        return list(zip(starts[long].tolist(), ends[long].tolist(), strict=True))

    def search(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Merged (start, end) stretches of hit words, and the items that occur."""
        get = self.numbers.get
        numbers = np.fromiter([get(w, 0) for w in words], np.int64, len(words))
        spans: list[tuple[int, int]] = []
        items: set = set()
        for first, last in self.runs(numbers):
            for at, (state, matched) in enumerate(self.automaton.steps(numbers[first:last].tolist()), first + 1):
                if matched >= self.window:
                    items |= self.by_window[self.automaton.up_to(state, self.window)]
                    spans.append((at - self.window, at))
                for size, item in self.whole[state]:
                    if size <= matched:
                        items.add(item)
                        spans.append((at - size, at))
        return merge(spans), items


def merge(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def blocks_of(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[object, list[bytes]]]]:
    """The items in blocks of bounded size, read from one partition after another."""
    block, size = [], 0
    rows = benchmark.filter(F.col(text_col).isNotNull()).select(F.col(id_col), F.col(text_col).cast("binary"))
    for item, text in rows.toLocalIterator():
        words = words_of(bytes(text))
        if block and size + len(words) > BLOCK_WORDS:
            yield block
            block, size = [], 0
        block.append((item, words))
        size += len(words)
    yield block


SPANS = "array<struct<start:int,end:int>>"
SPAN_TYPE = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def span_array(found: list[list[tuple[int, int]]]) -> pa.Array:
    return pa.array([[{"start": a, "end": b} for a, b in x] for x in found], SPAN_TYPE)


def by_block(texts: DataFrame, blocks: Iterable[list], window: int) -> DataFrame:
    """(row, n_words, spans, items) of rows (row, text) for every block of items, one row for each text and block with hits.

    Rows without hits in a block are left out, but for the first block. The
    parts are written one after another, so the driver and each task hold one block.
    """

    def part(shared, all_rows: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = None
            for batch in batches:
                held = held or prepared(shared)
                words = [words_of(text) for text in text_bytes(batch.column(1))]
                found = [held.search(w) for w in words]
                items = [sorted(str(i) for i in which if i is not None) for _, which in found]
                columns = [batch.column(0), pa.array([len(w) for w in words], pa.int64()), span_array([x for x, _ in found]), pa.array(items, pa.list_(pa.string()))]
                made = pa.RecordBatch.from_arrays(columns, names=["row", "n_words", "spans", "items"])
                yield made if all_rows else made.filter(pa.array([bool(x) for x, _ in found], pa.bool_()))

        return texts.mapInArrow(run, f"row bigint, n_words bigint, spans {SPANS}, items array<string>")

    merged = None
    for block in blocks:
        shared = texts.sparkSession.sparkContext.broadcast((block, window))
        one = materialize(part(shared, merged is None), "decontam")
        shared.destroy()
        merged = one if merged is None else merged.union(one)
    return merged


def find_hits(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """(id, n_words, n_hit, spans, items): the words of each text that occur in a test item.

    spans are merged (start, end) word offsets, the end exclusive; items the
    sorted ids, as text, of items that occur. An item of fewer than ``window``
    words counts as one window; one without words, or null, is left out, and so
    is an item with a null id from ``items`` (its words are hits). A null text
    has no words. Repeated rows each give their row; an empty table of
    documents gives an empty result, an empty benchmark no hits.
    """
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"]).alias("n_hit")
    first, rest = leading(blocks_of(benchmark, item_col, item_text_col))
    if rest is None:
        shared = docs.sparkSession.sparkContext.broadcast((first, window))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = None
            for batch in batches:
                held = held or prepared(shared)
                words = [words_of(text) for text in text_bytes(batch.column(1))]
                found = [held.search(w) for w in words]
                items = [sorted(str(i) for i in which if i is not None) for _, which in found]
                columns = [batch.column(0), pa.array([len(w) for w in words], pa.int64()), span_array([x for x, _ in found]), pa.array(items, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(columns, names=[id_col, "n_words", "spans", "items"])

        schema = f"{id_col} {id_type(docs, id_col)}, n_words bigint, spans {SPANS}, items array<string>"
        return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema).select(id_col, "n_words", n_hit, "spans", "items")

    base = materialize(docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col), F.col(text_col)), "decontam-rows")
    parts = by_block(base.select("row", F.col(text_col)), rest, window)
    by_row = parts.groupBy("row").agg(
        F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("s"), F.flatten(F.collect_list("items")).alias("i")
    )
    union = F.aggregate(
        F.array_sort("s"),
        F.array().cast(SPANS),
        lambda done, x: F.when(
            (F.size(done) > 0) & (x["start"] <= F.element_at(done, -1)["end"]),
            F.concat(
                F.slice(done, 1, F.size(done) - 1),
                F.array(F.struct(F.element_at(done, -1)["start"].alias("start"), F.greatest(F.element_at(done, -1)["end"], x["end"]).alias("end"))),
            ),
        ).otherwise(F.concat(done, F.array(x))),
    )
    merged = base.select("row", id_col).join(by_row, "row").select(id_col, "n_words", union.alias("spans"), F.array_sort(F.array_distinct("i")).alias("items"))
    return merged.select(id_col, "n_words", n_hit, "spans", "items")


def leading(blocks: Iterator[list]) -> tuple[list, Iterator[list] | None]:
    """The only block and None, or the first one and an iterator over all."""
    first = next(blocks)
    second = next(blocks, None)
    return first, None if second is None else chain([first, second], blocks)


def prepared(shared) -> Items:
    """The automaton of a broadcast block of items, built once in each Python worker."""
    return worker_object("decontam", shared.value, lambda: Items(*shared.value))


def cut_words(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the given stretches of words and what stands between their words."""
    places = [m.span() for m in WORD.finditer(text.translate(NORMAL))]
    out, at = [], 0
    for a, b in spans:
        out.append(text[at : places[a][0]])
        at = places[b - 1][1]
    return b"".join([*out, text[at:]])


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    max_coverage: float = 0.5,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """``docs`` without test items: hit spans are cut from the texts; a text of which more than ``max_coverage`` is hit goes.

    All other columns stay as they are. Clean texts, null ones included, pass
    unchanged. With several blocks of items, the spans of all are found in the
    original text and merged, so the number of blocks changes nothing.
    """
    spark = docs.sparkSession
    at = docs.columns.index(text_col)

    def applied(batch: pa.RecordBatch, found: Iterable[list[tuple[int, int]]]) -> pa.RecordBatch:
        texts, keep = batch.column(at).to_pylist(), []
        changed = False
        for k, (raw, spans) in enumerate(zip(text_bytes(batch.column(at)), found, strict=True)):
            keep.append(not spans or sum(b - a for a, b in spans) <= max_coverage * len(words_of(raw)))
            if spans and keep[-1]:
                texts[k] = cut_words(raw, spans).decode()
                changed = True
        if changed:
            batch = batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))
        return batch.filter(pa.array(keep, pa.bool_()))

    first, rest = leading(blocks_of(benchmark, item_col, item_text_col))
    if rest is None:
        shared = spark.sparkContext.broadcast((first, window))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = None
            for batch in batches:
                held = held or prepared(shared)
                yield applied(batch, (held.search(words_of(raw))[0] for raw in text_bytes(batch.column(at))))

        return docs.mapInArrow(run, docs.schema)

    # Row numbers of a written table, one struct to each row, so that columns can have any names.
    base = docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"))
    base = materialize(base, "decontam-rows")
    hits = by_block(base.select("row", F.col("doc")[text_col].alias("text")), rest, window).filter(F.size("spans") > 0)
    by_row = hits.groupBy("row").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    joined = base.join(by_row, "row", "left").select("doc.*", F.col("spans"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = (merge((s["start"], s["end"]) for s in x or ()) for x in batch.column(batch.num_columns - 1).to_pylist())
            yield applied(batch.select(list(range(batch.num_columns - 1))), found)

    return joined.mapInArrow(cut, docs.schema)
