"""SimHash near-duplicates: fingerprints, links by pigeonring chains, components.

Two fingerprints link if they differ in ``max_bits`` bits or fewer. Cut the 64
bits into ``SEGMENTS`` segments on a ring. If the differences over all segments
sum to at most ``max_bits``, then some segment starts a chain whose first l
segments differ in at most l * max_bits / SEGMENTS bits, for every l up to
SEGMENTS (the pigeonring principle, Qin and Xiao 2018). Two facts follow:

* the first segments, while that budget is below one, are equal, and over the
  stretch where it is below two at most one bit differs, so one half of that
  stretch is equal too. Both make one equi-join key for each start and half;
* a candidate pair is dropped as soon as a prefix of its chain is over budget,
  before the Hamming distance of all 64 bits is taken.

Identical texts collapse to one fingerprint first. A key that many fingerprints
share is dealt out in blocks, and a block pair yields a spanning forest of its
links, so no group's pairs are written out, while no link is lost.

``deduplicate`` looks for candidates under several fingerprints of a text's word
set, as a few changed words can move more than ``max_bits`` bits of one of them,
and judges each by SimHashes of the set of its shingles: links that these show to
be clearly similar stand, clearly unlike ones go, and those between are decided
by the sets themselves. Only fingerprints that have a candidate at all meet
again with the confirming bits. Of the links left open a task first hands on the
closest ones that would join its groups; where the sets reject some of these, all
links still open are judged where they meet, block by block, and only a forest of
those that hold is written.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from tiegrid.llm.common import arrow_rows, id_type, map_texts, materialize, worker_object
from tiegrid.plans.graph import connected_components
from tiegrid.plans.work import join_on_hot_keys

SEGMENTS = 8
WIDTH = 64 // SEGMENTS
#: Fingerprints of one key that are compared in one block; two blocks meet in a task.
BLOCK = 512
#: Block pairs that a Python task gets at a time.
AT_ONCE = 128
#: SimHashes of 64 bits each that confirm a link, and under which ``deduplicate`` looks for candidates.
CONFIRM, CANDIDATES = 6, 5
#: How many links of a node a block pair judges after the first round: all of two blocks. Empty: the first round alone, to tell what it does by itself.
NEAREST = (2 * BLOCK,)
#: Shingles that are counted at once when the sets of a block pair are compared.
GRAMS_AT_ONCE = 4096


#: Of each byte its eight bits, one to a byte of a long.
BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def majority(hashes: np.ndarray) -> np.ndarray:
    """The 64 bits that are set in over half the hashes of each row, as a signed long for each."""
    rows, n = hashes.shape
    votes = np.zeros((rows, 64), np.int64)
    # A byte counts up to 255.
    for at in range(0, n, 255):
        some = np.ascontiguousarray(hashes[:, at : at + 255]).view(np.uint8).reshape(rows, -1, 8)
        votes += np.ascontiguousarray(BITS[some].sum(1, dtype=np.uint64)).view(np.uint8)
    return np.packbits(2 * votes > n, axis=1, bitorder="little").view("<i8")[:, 0]


def simhash(texts: list[bytes], shingle: int, seed: int = 42) -> np.ndarray:
    """The signed 64-bit SimHash of each text over its word shingles, repeats included; 0 if a text has no words."""
    digest = xxhash.xxh64_intdigest
    out = np.zeros(len(texts), np.int64)
    for row, text in enumerate(texts):
        words = text.lower().split()
        if not words:
            continue
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        if len(words) > shingle:
            starts, ends = starts[: len(words) - shingle + 1], ends[shingle - 1 :]
        else:
            starts, ends = starts[:1], ends[-1:]
        spans = zip(starts.tolist(), ends.tolist(), strict=True)
        out[row] = majority(np.array([[digest(joined[a:b], seed) for a, b in spans]], "<u8"))[0]
    return out


class WordHashes(dict):
    """64-bit hashes of words, kept for the words in use."""

    def __missing__(self, word: bytes) -> int:
        made = xxhash.xxh64_intdigest(word)
        if len(self) > 100_000:
            self.clear()
        self[word] = made
        return made


#: Increments that set the members of a family of hashes apart.
FAMILY = (np.arange(1, CANDIDATES + CONFIRM + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[:, None]


def remixed(hashes: np.ndarray, family: np.ndarray) -> np.ndarray:
    """A row of other hashes of the same things for each increment of ``family``."""
    h = hashes + family
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def gram_hashes(words: list[bytes], shingle: int, known: WordHashes) -> np.ndarray:
    """Hashes of the shingles of a text, or of the whole text if it has fewer words; one for a text without any."""
    each = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    n = max(1, len(words) - shingle + 1)
    grams = np.zeros(n, np.uint64)
    for k in range(min(shingle, len(words))):
        grams = grams * np.uint64(0xD6E8FEB86659FD93) + each[k : k + n]
    return grams


def set_simhashes(texts: list[bytes], shingle: int, known: WordHashes) -> np.ndarray:
    """CANDIDATES SimHashes of each text's set of words, then CONFIRM ones of its set of word shingles; 0 without words.

    Words are hashed once; the hashes of shingles and the members of each family are mixed from these.
    """
    out = np.zeros((len(texts), CANDIDATES + CONFIRM), np.int64)
    for row, text in enumerate(texts):
        words = text.lower().split()
        if not words:
            continue
        each = np.fromiter(map(known.__getitem__, set(words)), np.uint64)
        out[row, :CANDIDATES] = majority(remixed(each, FAMILY[:CANDIDATES]))
        out[row, CANDIDATES:] = majority(remixed(np.unique(gram_hashes(words, shingle, known)), FAMILY[CANDIDATES:]))
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp): the SimHash of every whole text as a signed long.

    A-Z count as a-z; words are runs of characters other than ASCII white
    space; each word shingle counts as often as it occurs; fewer words make one
    shingle. A null or empty text, or one without words, has fingerprint 0.
    """
    return map_texts(docs, lambda texts: [pa.array(simhash(texts, shingle))], "fp bigint", id_col, text_col)


def set_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5) -> DataFrame:
    """(id, fp0, ..., c0, ...): SimHashes of the words and, to confirm, of the shingles of every whole text, each counted once."""

    def rows(texts: list[bytes]) -> list[pa.Array]:
        known = worker_object("simhash", shingle, WordHashes)
        return [pa.array(column) for column in set_simhashes(texts, shingle, known).T.copy()]

    return map_texts(docs, rows, ", ".join(f"{n} bigint" for n in (*FPS, *CS)), id_col, text_col, "simhash")


FPS, CS = [f"fp{k}" for k in range(CANDIDATES)], [f"c{k}" for k in range(CONFIRM)]


def budgets(max_bits: int) -> list[int]:
    """The most differing bits in the first 1, 2, ... segments of a chain."""
    return [length * max_bits // SEGMENTS for length in range(1, SEGMENTS + 1)]


def chain_keys(fp, max_bits: int) -> list:
    """The equi-join keys of a fingerprint column; linked fingerprints share one at least."""
    allowed = budgets(max_bits)
    equal, near = WIDTH * allowed.count(0), WIDTH * allowed.count(1)
    if not 0 < max_bits < SEGMENTS:
        raise ValueError(f"max_bits is 1 to {SEGMENTS - 1}")
    if near % 2:
        near -= 1
    keys = []
    for start in range(SEGMENTS):
        turned = fp
        if start:
            turned = F.shiftleft(fp, WIDTH * start).bitwiseOR(F.shiftrightunsigned(fp, 64 - WIDTH * start))
        head = F.shiftrightunsigned(turned, 64 - equal)
        for half in (0, 1) if near else (0,):
            rest = F.shiftrightunsigned(turned, 64 - equal - near // 2 * (half + 1)).bitwiseAND(F.lit((1 << near // 2) - 1))
            tag = F.lit((start * 2 + half) << (equal + near // 2)).cast("bigint")
            keys.append(F.shiftleft(head, near // 2).bitwiseOR(rest).bitwiseOR(tag))
    return keys


def key_start(key: int, max_bits: int) -> int:
    """The segment at which a key's chain starts."""
    allowed = budgets(max_bits)
    return (key >> (WIDTH * allowed.count(0) + WIDTH * allowed.count(1) // 2) >> 1) % SEGMENTS


def candidates(values: np.ndarray, start: int, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i < j) of unsigned fingerprints whose chain from segment ``start`` keeps its budgets and that link."""
    n = len(values)
    shift = np.uint64(WIDTH * start)
    turned = values if start == 0 else (values << shift) | (values >> np.uint64(64 - WIDTH * start))
    masks = [(np.uint64((1 << WIDTH * (k + 1)) - 1) << np.uint64(64 - WIDTH * (k + 1)), most) for k, most in enumerate(budgets(max_bits))]
    left, right = [], []
    for at in range(0, n, 512):
        differ = turned[at : at + 512, None] ^ turned[None, :]
        chain = np.ones(differ.shape, bool)
        for mask, most in masks[:-1]:
            chain &= np.bitwise_count(differ & mask) <= most
        i, j = np.nonzero(chain)
        i, j = i[i + at < j], j[i + at < j]
        close = np.bitwise_count(differ[i, j]) <= max_bits
        left.append(i[close] + at)
        right.append(j[close])
    return np.concatenate(left), np.concatenate(right)


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of ``n`` places the smallest place that it reaches over the pairs."""
    label = np.arange(n)
    while len(i):
        before = label.copy()
        least = np.minimum(label[i], label[j])
        np.minimum.at(label, i, least)
        np.minimum.at(label, j, least)
        label = label[label]
        if (before == label).all():
            break
    return label


def bridges(label: np.ndarray, i: np.ndarray, j: np.ndarray, away: np.ndarray) -> list[tuple[int, int]]:
    """The closest pairs that connect the classes of ``label``, as many as a spanning forest of them needs."""
    root = {k: k for k in np.unique(label[np.concatenate((i, j))]).tolist()}

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    taken = []
    for k in np.argsort(away, kind="stable").tolist():
        p, q = find(int(label[i[k]])), find(int(label[j[k]]))
        if p != q:
            root[max(p, q)] = min(p, q)
            taken.append((int(i[k]), int(j[k])))
    return taken


def in_blocks(prints: DataFrame, fps: list[str], extra: list[str], max_bits: int) -> DataFrame:
    """(key, items): the (fp, node, *extra) that share a chain key under one of ``fps``, dealt out in pairs of blocks."""
    by_fp = prints.select("node", *extra, F.explode(F.array(*(F.struct(F.lit(k).cast("bigint").alias("k"), F.col(c).alias("fp")) for k, c in enumerate(fps)))).alias("p"))
    flat = by_fp.select("node", *extra, F.col("p.fp").alias("fp"), F.shiftleft(F.col("p.k"), 40).alias("family"))
    keyed = flat.select("fp", "node", *extra, "family", F.explode(F.array(*chain_keys(F.col("fp"), max_bits))).alias("key"))
    keyed = keyed.select("fp", "node", *extra, F.col("key").bitwiseOR(F.col("family")).alias("key"))
    shared = materialize(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "simhash-keys")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    return (
        join_on_hot_keys(keyed, shared, "key", "n")  # a key of very many is dealt out in blocks from where its rows are
        .withColumn("blocks", blocks)
        .select("key", F.struct("fp", "node", *extra).alias("item"), own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        .groupBy("key", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"))
        .agg(F.collect_list("item").alias("items"))
        .filter(F.size("items") > 1)
        .select("key", "items")
    )


def _groups(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, list[np.ndarray]]]:
    """(key, fingerprints, nodes, further columns) of each row of ``in_blocks``, nodes distinct."""
    lists = batch.column(1)
    columns = [x.to_numpy(zero_copy_only=False) for x in lists.values.flatten()]
    ends = lists.offsets.to_pylist()
    for key, a, b in zip(batch.column(0).to_pylist(), ends, ends[1:], strict=False):
        nodes, first = np.unique(columns[1][a:b], return_index=True)
        if len(nodes) > 1:
            yield key, columns[0][a:b][first].astype(np.int64).view(np.uint64), nodes, [c[a:b][first] for c in columns[2:]]


def links(prints: DataFrame, max_bits: int = 3, fps: list[str] | None = None, confirm: tuple[int, int] | None = None) -> DataFrame:
    """(u, v, kind): links between the values of ``prints.node`` that connect all that is linked.

    Fingerprints are the columns ``fps`` ("fp" alone by default); a link under
    any of them counts. With ``confirm``, a link is "sure" if the confirming
    SimHashes of both differ in the first number of bits at most, and "open"
    up to the second; only nodes with some candidate are looked at for this.
    Of the open links those come that join the groups of sure ones; u = v is a
    node with further ones ("left").
    """
    fps = fps or ["fp"]

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: set = set()
            for key, values, nodes, _ in _groups(batch):
                i, j = candidates(values, key_start(key, max_bits), max_bits)
                found.update(nodes[np.union1d(i, j)].tolist())
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64())], names=["node"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            edges: set = set()
            for key, values, nodes, more in _groups(batch):
                i, j = candidates(values, key_start(key, max_bits), max_bits)
                open_ = None
                if more:
                    # As unsigned numbers: of a negative one, bits of its absolute value would be counted.
                    c = np.stack(more[:CONFIRM], 1).astype(np.int64).view(np.uint64)
                    away = np.bitwise_count(c[i] ^ c[j]).sum(1)
                    between = (away > confirm[0]) & (away <= confirm[1])
                    open_ = i[between], j[between], away[between]
                    i, j = i[away <= confirm[0]], j[away <= confirm[0]]
                label = forest(len(nodes), i, j)
                edges |= {(int(nodes[k]), int(nodes[label[k]]), "sure") for k in np.nonzero(label != np.arange(len(nodes)))[0]}
                if open_ is not None:
                    apart = label[open_[0]] != label[open_[1]]
                    i, j, away = (x[apart] for x in open_)
                    if len(i):
                        joins = bridges(label, i, j, away)
                        edges |= {(int(nodes[b]), int(nodes[a]), "open") for a, b in joins}
                        if len(joins) < len(i):
                            edges |= {(k, k, "left") for k in nodes[np.union1d(i, j)].tolist()}
            u, v, kind = zip(*edges, strict=True) if edges else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(kind, pa.string())], names=["u", "v", "kind"])

    extra = CS if confirm is not None else []
    if confirm is not None:
        with arrow_rows(prints.sparkSession, AT_ONCE):
            with_some = materialize(in_blocks(prints, fps, [], max_bits).mapInArrow(near, "node bigint").distinct(), "simhash-candidates")
        prints = prints.join(with_some, "node", "left_semi")
    with arrow_rows(prints.sparkSession, AT_ONCE):
        return materialize(in_blocks(prints, fps, extra, max_bits).mapInArrow(joined, "u bigint, v bigint, kind string").distinct(), "simhash-links")


def confirm_budget(similarity: float) -> tuple[int, int]:
    """Confirming bits in which shingle sets of this Jaccard similarity differ, two standard deviations less and more."""
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    bits = 64 * CONFIRM
    spread = 2 * math.sqrt(bits * share * (1 - share))
    return math.floor(bits * share - spread), math.ceil(bits * share + spread)


def shingle_sets(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(id, grams): the distinct hashes of the shingles of the texts of ``ids``."""

    def rows(texts: list[bytes]) -> list[pa.Array]:
        known = worker_object("simhash", shingle, WordHashes)
        return [pa.array([np.unique(gram_hashes(t.lower().split(), shingle, known)).view(np.int64) for t in texts], pa.list_(pa.int64()))]

    sets = map_texts(docs.join(ids, id_col, "left_semi"), rows, "grams array<bigint>", id_col, text_col, "simhash").distinct()
    return materialize(sets, "simhash-sets")


def alike(docs: DataFrame, open_: DataFrame, id_col: str, text_col: str, shingle: int, similarity: float) -> DataFrame:
    """The rows of ``open_`` (u, v, a, b) whose texts, those of ids a and b, have shingle sets of at least the Jaccard similarity."""

    ids = open_.select(F.col("a").alias(id_col)).union(open_.select("b")).distinct()
    sets = shingle_sets(docs, ids, id_col, text_col, shingle)
    both = open_.join(sets.toDF("a", "ga"), "a").join(sets.toDF("b", "gb"), "b")
    shared = F.size(F.array_intersect("ga", "gb"))
    return both.filter(shared >= similarity * (F.size("ga") + F.size("gb") - shared)).select("u", "v").distinct()


def overlaps(sizes: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """How many values each two of the sets share that lie one after the other in ``grams``."""
    n = len(sizes)
    row = np.repeat(np.arange(n), sizes)
    _, column, times = np.unique(grams, return_inverse=True, return_counts=True)
    shared = times[column] > 1
    row, column = row[shared], np.unique(column[shared], return_inverse=True)[1]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((n, n), np.float32)  # exact below 2^24
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, GRAMS_AT_ONCE):
        a, b = np.searchsorted(column, (first, first + GRAMS_AT_ONCE))
        has = np.zeros((n, GRAMS_AT_ONCE), np.float32)
        has[row[a:b], column[a:b] - first] = 1
        out += has @ has.T
    return out


def judged_in_place(apart: DataFrame, max_bits: int, confirm: tuple[int, int], similarity: float) -> DataFrame:
    """(u, v): links that connect all that open links with alike sets connect, among the nodes of each ``clump``.

    ``apart`` has node, clump, group, FPS, CS and grams. A clump's nodes are
    dealt out in blocks, and each block pair judges all its open links between
    groups where it is and yields a forest of those that hold, so a clump's
    pairs are neither written out nor cut off.
    """

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u: list[int] = []
            v: list[int] = []
            lists = batch.column(0)
            fields = {f.name: lists.values.field(k) for k, f in enumerate(lists.type.value_type)}
            ends = lists.offsets.to_pylist()
            for a, b in zip(ends, ends[1:], strict=False):
                part = {c: x.slice(a, b - a) for c, x in fields.items()}
                numbers = lambda c: part[c].to_numpy(zero_copy_only=False).astype(np.int64)  # noqa: B023, E731
                nodes, group = numbers("node"), numbers("group")
                bits = {c: numbers(c).view(np.uint64) for c in (*FPS, *CS)}
                differ = lambda c: np.bitwise_count(bits[c][:, None] ^ bits[c][None, :])  # noqa: B023, E731
                near = np.logical_or.reduce([differ(c) <= max_bits for c in FPS])
                away = sum(differ(c).astype(np.int64) for c in CS)
                i, j = np.nonzero(near & (away > confirm[0]) & (away <= confirm[1]) & (group[:, None] != group[None, :]))
                i, j = i[i < j], j[i < j]
                if not len(i):
                    continue
                some = np.union1d(i, j)
                chosen = part["grams"].take(pa.array(some))
                sizes = np.diff(chosen.offsets.to_numpy())
                i, j = np.searchsorted(some, i), np.searchsorted(some, j)
                both = overlaps(sizes, chosen.flatten().to_numpy())[i, j].astype(np.int64)
                hold = both >= similarity * (sizes[i] + sizes[j] - both)
                label = forest(len(some), i[hold], j[hold])
                moved = np.nonzero(label != np.arange(len(some)))[0]
                u += nodes[some[moved]].tolist()
                v += nodes[some[label[moved]]].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    sizes = materialize(apart.groupBy("clump").agg(F.count(F.lit(1)).alias("n"), F.min("group").alias("least"), F.max("group").alias("most")).filter("least <> most").select("clump", "n"), "simhash-clumps")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    item = F.struct("node", "group", *FPS, *CS, "grams")
    dealt = join_on_hot_keys(apart, sizes, "clump", "n").withColumn("blocks", blocks)
    dealt = dealt.select("clump", item.alias("item"), own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    pairs = dealt.groupBy("clump", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q")).agg(F.collect_list("item").alias("items"))
    with arrow_rows(apart.sparkSession, 4):
        return materialize(pairs.filter(F.size("items") > 1).select("items").mapInArrow(judge, "u bigint, v bigint").distinct(), "simhash-links")


def classes(base: DataFrame, prints: DataFrame, found: DataFrame, id_col: str) -> DataFrame:
    """``base`` with component_id, of its distinct ``prints`` (node, rep, copies) and the links between their nodes."""
    joined = connected_components(found)
    members = joined.join(prints.select("node", "rep"), "node")
    least = members.groupBy("component").agg(F.min("rep").alias("least"))
    moved = members.join(least, "component").select("node", "least")
    labelled = prints.join(moved, "node", "left").select("node", "copies", F.coalesce("least", "rep").cast(id_type(base, id_col)).alias("component_id"))
    return join_on_hot_keys(base, materialize(labelled, "simhash-classes"), "node", "copies")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_bits: int = 3) -> DataFrame:
    """(id, fp, component_id) for every row of ``docs``.

    component_id is the smallest id that is reachable over links, its own
    included. Rows with a null id stay; they take the component of their
    fingerprint, null if no row of it has an id. Repeated rows stay repeated.
    An empty table gives an empty result.
    """
    base = materialize(fingerprints(docs, id_col, text_col, shingle).withColumn("node", F.col("fp")), "simhash")
    prints = base.groupBy("node", "fp").agg(F.min(id_col).alias("rep"), F.count(F.lit(1)).alias("copies"))
    found = links(prints, max_bits).select("u", "v")
    return classes(base, prints, found, id_col).select(id_col, "fp", "component_id")


def hex_digits(fp) -> F.Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def judged_links(docs: DataFrame, prints: DataFrame, max_bits: int, id_col: str, text_col: str, shingle: int, similarity: float) -> DataFrame:
    """(u, v): links between nodes of ``prints`` that their confirming bits or, where these leave it open, their shingle sets bear out.

    They connect all that such links connect. First, open links that would join
    the groups of sure ones are judged; if the sets bear all of them out, nothing
    is apart that could be joined. Otherwise all open links of the nodes with
    further ones are judged where they meet (``judged_in_place``): a clump holds
    all that any links connect, so both ends of each lie in one.
    """
    confirm = confirm_budget(similarity)
    rep = prints.select("node", "rep")
    found = links(prints, max_bits, FPS, confirm)
    open_ = found.filter("kind = 'open'").select("u", "v")
    fresh = materialize(open_.join(rep.toDF("u", "a"), "u").join(rep.toDF("v", "b"), "v").select("u", "v", "a", "b"), "simhash-open")
    known = materialize(found.filter("kind = 'sure'").select("u", "v").union(alike(docs, fresh, id_col, text_col, shingle, similarity)), "simhash-links")
    left = found.filter("kind = 'left'").select(F.col("u").alias("node"))
    if not NEAREST or left.isEmpty() or open_.join(known, ["u", "v"], "left_anti").isEmpty():
        return known
    clumps = connected_components(found.select("u", "v")).toDF("node", "clump")
    groups = connected_components(known).toDF("node", "group")
    apart = prints.join(left, "node", "left_semi").join(clumps, "node").join(groups, "node", "left").withColumn("group", F.coalesce("group", "node"))
    apart = materialize(apart.select("node", "clump", "group", *FPS, *CS, F.col("rep").alias(id_col)), "simhash-apart")
    sets = shingle_sets(docs, apart.select(id_col).distinct(), id_col, text_col, shingle)
    one = sets.groupBy(id_col).agg(F.min("grams").alias("grams"))
    return known.union(judged_in_place(apart.join(one, id_col), max_bits, confirm, similarity))


def deduplicate(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = 3, shingle: int = 5, similarity: float = 0.8
) -> DataFrame:
    """``docs`` with one row of each near-duplicate group, the one with the smallest id.

    Candidates are SimHashes over the set of words of a text, of which a few
    changed words move few bits, CANDIDATES of them; links are judged by the
    SimHashes of the sets of ``shingle`` consecutive words, and by the sets
    themselves where these leave it open. All columns stay. Of rows that
    repeat a kept id one stays, always the same: the one with the smallest hash
    of its columns. Rows with a null id can't be told apart from others and stay.
    """
    with_id = docs.filter(F.col(id_col).isNotNull())
    base = set_fingerprints(with_id, id_col, text_col, shingle).withColumn("node", F.xxhash64(*FPS, *CS))
    base = materialize(base, "simhash")
    prints = base.groupBy("node", *FPS, *CS).agg(F.min(id_col).alias("rep"), F.count(F.lit(1)).alias("copies"))
    found = judged_links(with_id, prints, max_bits, id_col, text_col, shingle, similarity)
    each = classes(base.select(id_col, "node"), prints.select("node", "rep", "copies"), found, id_col)
    keep = each.filter(F.col(id_col) == F.col("component_id")).groupBy(F.col(id_col).alias("id")).agg(F.count(F.lit(1)).alias("n"))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    hashed = F.xxhash64(*(F.col(f"`{f.name}`") for f in docs.schema if not isinstance(f.dataType, MapType)))
    # A row travels as one column, so its columns can have any names.
    kept = with_id.select(F.col(f"`{id_col}`").alias("id"), F.struct(*columns).alias("row"), hashed.alias("hash")).join(keep, "id")
    once = kept.filter("n = 1").select("row.*")
    repeated = kept.filter("n > 1").groupBy("id").agg(F.min_by("row", "hash").alias("row")).select("row.*")
    return once.union(repeated).union(docs.filter(F.col(id_col).isNull()))
