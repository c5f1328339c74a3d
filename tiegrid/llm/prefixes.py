"""Prefix trie of conversations: equal sequences are collapsed first, then weighted prefixes are added up.

A turn's identity is the MD5 of its role and text. A sequence of turns is named
by its length and the sums of 128 hash bits over its turns, each hashed with its
place, so running sums over places name every prefix, and no sequence is ever
gathered in one row.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tiegrid.llm.common import materialize
from tiegrid.plans.work import join_on_hot_keys

#: Characters of role and text by which tied turns are dealt to tasks; within a task they are ordered in full.
DEALT_BY = 64
#: Turns of one sequence whose running sums are taken in one go.
PIECE = 4096
#: Conversation ids in one packed row of an end list.
PACKED = 20_000
SUMS = ["s0", "s1", "s2", "s3"]


class Trie(NamedTuple):
    """``nodes``: one row per distinct prefix. ``ends``: (key, conv_id), the node at which each conversation ends."""

    nodes: DataFrame
    ends: DataFrame


def number_turns(conversations: DataFrame, texts: bool = False) -> DataFrame:
    """(conv_id, place, turn, n_bytes) of every turn, with role and text if ``texts``; place counts from 0.

    Turns are ordered by turn number, null first; equal numbers by role, then
    text, as UTF-8; repeated rows are turns of their own. A null role or text is
    empty, rows without a conversation id are left out, further columns are not
    read. The rows are dealt in order, so a conversation of any length is shared
    by many tasks, which number their parts; a part's start is added afterwards.
    """
    kept = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.col("turn").alias("number"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    dealt = kept.repartitionByRange("conv_id", F.asc_nulls_first("number"), F.substring("role", 1, DEALT_BY), F.substring("text", 1, DEALT_BY))
    ordered = dealt.sortWithinPartitions("conv_id", F.asc_nulls_first("number"), "role", "text").select(
        "conv_id",
        F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))).alias("turn"),
        F.octet_length("text").cast("bigint").alias("n_bytes"),
        *(["role", "text"] if texts else []),
    )

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, seen = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            if not len(ids):
                continue
            fresh = np.r_[True, ids[1:] != ids[:-1]]
            starts = np.flatnonzero(fresh)
            place = np.arange(len(ids)) - starts[np.cumsum(fresh) - 1]
            if ids[0] == last:
                place[: starts[1] if len(starts) > 1 else len(ids)] += seen
            last, seen = ids[-1], int(place[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(ids), part)), pa.array(place)], names=names)

    fields = "conv_id bigint, turn string, n_bytes bigint" + ", role string, text string" * texts
    names = [f.split(" ")[0] for f in fields.split(", ")] + ["part", "place"]
    numbered = materialize(ordered.mapInArrow(number, fields + ", part bigint, place bigint"), "turns")
    # Only a conversation that goes on in a further part has a start there: one at most for each part.
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = numbered.groupBy("conv_id", "part").count().withColumn("start", F.sum("count").over(before)).filter("start > 0").drop("count")
    placed = numbered.join(F.broadcast(starts), ["conv_id", "part"], "left")
    return placed.withColumn("place", F.col("place") + F.coalesce("start", F.lit(0))).select("conv_id", "place", "turn", "n_bytes", *(["role", "text"] if texts else []))


def crc32_of_id(column: str) -> Column:
    return F.crc32(F.col(column).cast("string").cast("binary"))


def rebuild(numbered: DataFrame, group: int = 5, modulus: int = 9) -> tuple[DataFrame, DataFrame]:
    """Conversations whose first turns are those of another: (turns, conversations).

    The first h turns of conversation c are those of c - c % ``group`` (all it
    has if fewer, none if there is no such conversation); c's own turns from its
    h-th on follow. h is the CRC-32 of c's decimal id modulo ``modulus``. The
    second table has every conv_id, those that are left without a turn included.
    """
    h = (crc32_of_id("conv_id") % modulus).cast("int")
    heads = numbered.filter(F.col("place") < modulus - 1).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("place", "turn", "n_bytes"))).alias("head"))
    sizes = numbered.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    based = sizes.withColumn("h", h).withColumn("base", F.col("conv_id") - F.col("conv_id") % group)
    joined = based.join(heads.withColumnRenamed("conv_id", "base"), "base", "left")
    facts = materialize(joined.select("conv_id", "n", "h", F.slice(F.coalesce("head", F.array().cast(heads.schema["head"].dataType)), 1, F.col("h")).alias("head")), "heads")
    front = facts.select("conv_id", F.posexplode("head").alias("at", "x")).select("conv_id", (F.col("at") + 1).cast("bigint").alias("depth"), "x.turn", "x.n_bytes")
    own = join_on_hot_keys(numbered.filter(F.col("place") >= h), facts.select("conv_id", "n", "h", F.size("head").alias("taken")), "conv_id", "n")
    own = own.select("conv_id", (F.col("taken") + F.col("place") - F.col("h") + 1).cast("bigint").alias("depth"), "turn", "n_bytes")
    return front.unionByName(own), facts.select("conv_id")


def as_sequences(numbered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations as they are: (turns, conversations) for ``prefix_trie``."""
    turns = numbered.select("conv_id", (F.col("place") + 1).alias("depth"), "turn", "n_bytes")
    return turns, numbered.select("conv_id").distinct()


def _key(depth: Column, sums: list[Column]) -> Column:
    return F.md5(F.concat_ws(":", depth.cast("string"), *(s.cast("string") for s in sums)))


def prefix_trie(turns: DataFrame, conversations: DataFrame) -> Trie:
    """The trie of sequences of turns (conv_id, depth from 1, turn, n_bytes) of ``conversations`` (conv_id).

    A node is a distinct sequence of first turns; the root, of depth 0, has
    every conversation, those without turns included. Per node: key, depth,
    conv_id (its smallest member), parent (the parent's key) and parent_conv_id
    (null for the root), n_convs, n_children, n_leaves, saved_tokens (over its
    subtree, each node's members but one times the bytes of its last text) and
    n_bytes of its last turn. No conversation: no node.

    Equal sequences become one with a weight; those that are proper prefixes go
    by an anti-join, which leaves the leaves; every prefix of a weighted sequence
    is one row, and rows of a node are added up where they are before they meet.
    Sums over a subtree need no step per level: with the bytes from a prefix's
    last turn to its sequence's end, they are weighted sums over sequences, less
    the bytes of the distinct nodes, each counted on the sequence of its smallest
    member only.
    """
    bits = [F.xxhash64("depth", "turn"), F.xxhash64(F.lit(1), "depth", "turn")]
    low = F.lit(0xFFFFFFFF).cast("bigint")
    parts = [piece for x in bits for piece in (x.bitwiseAND(low), F.shiftrightunsigned(x, 32))]
    rebuilt = materialize(turns.select("conv_id", "depth", "n_bytes", *(p.alias(s) for p, s in zip(parts, SUMS, strict=True))), "pieces")
    sums = [*SUMS, "n_bytes"]
    totals = rebuilt.groupBy("conv_id").agg(F.count(F.lit(1)).alias("len"), *(F.sum(c).alias(c) for c in sums))
    whole = conversations.join(totals, "conv_id", "left").fillna(0, ["len", *sums])
    whole = materialize(whole.select("conv_id", "len", F.col("n_bytes").alias("total"), _key(F.col("len"), [F.col(s) for s in SUMS]).alias("key")), "wholes")
    sequences = materialize(whole.groupBy("key").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("weight"), F.min("len").alias("len"), F.min("total").alias("total")), "sequences")

    # Running sums over the places of one conversation of each sequence, piece by piece.
    own = join_on_hot_keys(rebuilt, sequences.drop("key"), "conv_id", "len").withColumn("piece", F.floor((F.col("depth") - 1) / PIECE))
    inside = Window.partitionBy("conv_id", "piece").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("conv_id").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = own.filter(F.col("len") > PIECE).groupBy("conv_id", "piece").agg(*(F.sum(c).alias("b_" + c) for c in sums))
    starts = pieces.select("conv_id", "piece", *(F.sum("b_" + c).over(before).alias("b_" + c) for c in sums))
    summed = own.select("*", *(F.sum(c).over(inside).alias("u_" + c) for c in sums)).join(starts, ["conv_id", "piece"], "left")
    upto = {c: F.col("u_" + c) + F.coalesce("b_" + c, F.lit(0)) for c in sums}
    below = summed.select(
        F.col("conv_id").alias("sequence"),
        "depth",
        _key(F.col("depth"), [upto[s] for s in SUMS]).alias("key"),
        _key(F.col("depth") - 1, [upto[s] - F.col(s) for s in SUMS]).alias("parent"),
        "n_bytes",
        (F.col("total") - upto["n_bytes"] + F.col("n_bytes")).alias("tail"),
        "weight",
        "len",
    )
    zero = F.lit(0).cast("bigint")
    roots = sequences.select(F.col("conv_id").alias("sequence"), zero.alias("depth"), _key(zero, [zero] * 4).alias("key"), F.lit(None).cast("string").alias("parent"), zero.alias("n_bytes"), F.col("total").alias("tail"), "weight", "len")
    prefixes = materialize(below.unionByName(roots), "prefixes")

    proper = prefixes.filter("depth < len").select("key").distinct()
    leaves = sequences.join(proper, "key", "left_anti").select(F.col("conv_id").alias("sequence"), F.lit(1).alias("leaf"))
    least = prefixes.groupBy("key").agg(
        F.min("depth").alias("depth"),
        F.min("parent").alias("parent"),
        F.min("n_bytes").alias("n_bytes"),
        F.sum("weight").alias("n_convs"),
        F.min(F.struct("sequence", "tail")).alias("first"),
        F.sum(F.col("weight") * F.col("tail")).alias("weighted"),
    )
    nodes = materialize(least.select("*", F.col("first.sequence").alias("conv_id"), F.col("first.tail").alias("tail")).drop("first"), "nodes")
    # From some depth on the nodes of a sequence have its conversation as smallest member, or none of them has.
    owned = nodes.groupBy(F.col("conv_id").alias("sequence")).agg(F.min(F.struct("depth", "tail")).alias("from"))
    facts = sequences.select(F.col("conv_id").alias("sequence"), "len").join(leaves, "sequence", "left").join(owned, "sequence", "left")
    facts = materialize(facts.select("sequence", "len", F.coalesce("leaf", F.lit(0)).alias("leaf"), F.col("from.depth").alias("own_depth"), F.col("from.tail").alias("own_tail")), "facts")
    counted = F.when(F.col("own_depth").isNull(), 0).when(F.col("depth") >= F.col("own_depth"), F.col("tail")).otherwise(F.col("own_tail"))
    sides = join_on_hot_keys(prefixes.select("key", "sequence", "depth", "tail"), facts, "sequence", "len")
    added = sides.groupBy("key").agg(F.sum("leaf").alias("n_leaves"), F.sum(counted).alias("once"))

    children = nodes.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("key")).agg(F.count(F.lit(1)).alias("n_children"))
    full = nodes.join(added, "key").join(children, "key", "left").select(
        "key", "depth", "conv_id", "parent", "n_convs", F.coalesce("n_children", zero).alias("n_children"), F.col("n_leaves").cast("bigint").alias("n_leaves"), (F.col("weighted") - F.col("once")).alias("saved_tokens"), "n_bytes"
    )
    full = materialize(full, "trie")
    parents = full.filter("n_children > 0").select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("siblings"))
    inner = join_on_hot_keys(full.filter("parent IS NOT NULL"), parents, "parent", "siblings").drop("siblings")
    top = full.filter("parent IS NULL").withColumn("parent_conv_id", F.lit(None).cast("bigint"))
    return Trie(inner.unionByName(top), whole.select("key", "conv_id"))


def last_turns(nodes: DataFrame, numbered: DataFrame) -> DataFrame:
    """``nodes`` of conversations that were taken as they are, with role and text of each node's last turn (null at the root)."""
    turns = numbered.select("conv_id", (F.col("place") + 1).alias("depth"), "role", "text")
    return nodes.join(turns, ["conv_id", "depth"], "left")


def end_digests(ends: DataFrame) -> DataFrame:
    """(key, ends_sha256, n_ends): SHA-256 of the decimal ids of the conversations that end at a node, ascending and joined by commas.

    The ids are dealt in order, so the list of one node is packed by many tasks;
    one task then hashes a node's packed rows as they pass, as SHA-256 can't be
    taken in parts.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids = None, []

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([key]), pa.array([ids[0]]), pa.array([len(ids)]), pa.array([",".join(map(str, ids))])], names=["key", "first", "n", "text"])

        for batch in batches:
            keys, values = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)] if len(keys) else [0]
            done: dict[str, list] = {"key": [], "first": [], "n": [], "text": []}
            for a, b in zip(cuts, cuts[1:], strict=False):
                if ids and keys[a] != key:
                    yield row()
                    ids = []
                key = keys[a]
                ids += values[a:b].tolist()
                last = b == len(keys)
                while len(ids) >= PACKED or ids and not last:
                    now, ids = ids[:PACKED], ids[PACKED:]
                    for name, x in zip(done, (key, now[0], len(now), ",".join(map(str, now))), strict=True):
                        done[name].append(x)
            if done["key"]:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in done.values()], names=list(done))
        if ids:
            yield row()

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, made, n = None, None, 0
        for batch in batches:
            done: list[tuple] = []
            for k, size, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if k != key:
                    if key is not None:
                        done.append((key, made.hexdigest(), n))
                    key, made, n = k, sha256(), 0
                made.update((("," if n else "") + text).encode())
                n += size
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], names=["key", "ends_sha256", "n_ends"])
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([made.hexdigest()]), pa.array([n])], names=["key", "ends_sha256", "n_ends"])

    dealt = ends.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id").select("key", "conv_id")
    packed = dealt.mapInArrow(pack, "key string, first bigint, n bigint, text string")
    return packed.repartition("key").sortWithinPartitions("key", "first").mapInArrow(fold, "key string, ends_sha256 string, n_ends bigint")
