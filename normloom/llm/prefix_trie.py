"""Conversation prefix trie in succinct level order: LOUDS bit vectors and label arrays by prefix shard.

Every turn's prefix gets a chained 128-bit digest, streamed in order of turns, so that equal prefixes are
one node, and grouping by digest counts the members of each. Nodes of many members (``HEAVY``), which
always hang together below the root, form the upper trie; what hangs below them falls into light subtrees, dealt to shards of about
``SHARD_NODES`` nodes. A shard lays its nodes out level by level as a LOUDS bit vector, whose
rank gives each node's parent, and adds numbers up the tree in reverse breadth-first order. The upper trie, at most
one node for ``HEAVY`` turns, takes the sums of the subtrees below it and is rolled up by itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from normloom.llm.shared import column, reliable

#: Members beyond which a node belongs to the upper trie, and nodes of a shard below it, about.
HEAVY, SHARD_NODES = 4096, 2048
#: Ids that one block of a node's sorted members holds at most.
BLOCK = 1 << 16


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))


def ordered(turns: DataFrame) -> DataFrame:
    """``conv_id, place, digest, words`` of ``turns(conv_id, turn, role, text)``: places from 0 in order of turn, null first,
    ties by role and text. A null role or text counts as empty; turns without a conversation are left out."""
    said = [F.coalesce(column(c), F.lit("")).alias(c) for c in ("role", "text")]
    rows = turns.where(column("conv_id").isNotNull()).select(column("conv_id").alias("conv_id"), column("turn").alias("turn"), *said)
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")) - 1
    whole = F.unhex(F.sha2(F.concat(F.sha2(F.col("role").cast("binary"), 256), F.col("text")).cast("binary"), 256))
    return rows.select("conv_id", place.alias("place"), whole.alias("digest"), word_count(F.col("text")).alias("words"))


def shared_heads(turns: DataFrame, block: int = 20, most: int = 4) -> DataFrame:
    """``ordered`` rows in which the first h turns of each conversation c are those of conversation c - c % ``block``,
    h = crc32 of c in decimal, modulo ``most``: fewer if that has fewer, none if it is absent."""
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    own = turns.where(F.col("place") >= head)
    ids = turns.select("conv_id").distinct().select("conv_id", head.alias("head"), (F.col("conv_id") - F.col("conv_id") % block).alias("base"))
    given = turns.where(F.col("place") < most - 1).withColumnRenamed("conv_id", "base")
    return own.unionByName(ids.join(given, "base").where(F.col("place") < F.col("head")).select(*own.columns))


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each turn in order: its depth, its prefix's digest and its parent's; the last one of a conversation is marked."""
    names, kinds = ["conv_id", "depth", "hi", "lo", "p_hi", "p_lo", "words", "last"], [pa.int64()] * 7 + [pa.bool_()]
    held, at, prefix, out = None, None, b"", []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    for rows in batches:
        for conv, digest, words in zip(*[rows.column(c).to_pylist() for c in ("conv_id", "digest", "words")], strict=True):
            if conv != at:
                if held:
                    out.append((*held, True))
                at, prefix, depth, parent = conv, bytes(16), 0, (0, 0)
            elif held:
                out.append((*held, False))
            prefix, depth = hashlib.blake2b(prefix + digest, digest_size=16).digest(), depth + 1
            own = int.from_bytes(prefix[:8], "big", signed=True), int.from_bytes(prefix[8:], "big", signed=True)
            held, parent = (conv, depth, *own, *parent, words), own
        if out:
            yield batch()
            out = []
    if held:
        out.append((*held, True))
        yield batch()


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted ``hi, lo, conv_id`` rows to blocks of ids of one node."""
    for rows in batches:
        hi, lo, conv = (rows.column(c).to_numpy() for c in ("hi", "lo", "conv_id"))
        cuts = np.flatnonzero((hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])) + 1
        starts = [s for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(hi)], strict=True) for s in range(a, b, BLOCK)]
        ends = [*starts[1:], len(hi)] if starts else []
        if starts:
            yield pa.RecordBatch.from_arrays([pa.array(hi[starts]), pa.array(lo[starts]), pa.array(conv[starts]), pa.array([conv[a:b].tobytes() for a, b in zip(starts, ends, strict=True)], pa.binary())], ["hi", "lo", "first", "ids"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks in order of node and first id to one digest of the comma-joined decimal ids a node."""
    at, state = None, None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([at[0]], pa.int64()), pa.array([at[1]], pa.int64()), pa.array([state.hexdigest()])], ["hi", "lo", "ends_sha256"])

    for rows in batches:
        for hi, lo, ids in zip(*[rows.column(c).to_pylist() for c in ("hi", "lo", "ids")], strict=True):
            text = ",".join(map(str, np.frombuffer(ids, np.int64).tolist())).encode()
            if (hi, lo) == at:
                state.update(b"," + text)
            else:
                if at:
                    yield row()
                at, state = (hi, lo), hashlib.sha256(text)
    if at:
        yield row()


def end_digests(ends: DataFrame) -> DataFrame:
    """``hi, lo, ends_sha256`` of the conversations ``ends(hi, lo, conv_id)`` that end at each node, in order of their ids.

    A node's members are sorted by ranges over all tasks and packed into blocks, so that the one task which must digest
    them in order reads blocks, one at a time, however many there are.
    """
    blocks = ends.repartitionByRange("hi", "lo", "conv_id").sortWithinPartitions("hi", "lo", "conv_id").mapInArrow(_packed, "hi long, lo long, first long, ids binary")
    return blocks.repartition("hi", "lo").sortWithinPartitions("hi", "lo", "first").mapInArrow(_digests, "hi long, lo long, ends_sha256 string")


class Louds:
    """A forest in level order below a node 0 that stands for what is above it.

    ``bits`` has, for each node in breadth-first order, a one for each child and a zero; ``labels`` has
    the node's number in the given arrays. Siblings are ordered by smallest member.
    """

    def __init__(self, above: np.ndarray, depth: np.ndarray, conv: np.ndarray):
        n = len(above)
        level = np.zeros(n, np.int64)
        by_depth = np.argsort(depth, kind="stable")
        for some in np.split(by_depth, np.flatnonzero(np.diff(depth[by_depth])) + 1):
            level[some] = np.where(above[some] >= 0, level[above[some]] + 1, 0)
        rank, done, self.levels, labels = np.zeros(n + 1, np.int64), 1, [1], []
        by_level = np.argsort(level, kind="stable")
        for some in np.split(by_level, np.flatnonzero(np.diff(level[by_level])) + 1):
            parent = np.where(above[some] >= 0, rank[above[some]], 0)
            some = some[np.lexsort((conv[some], parent))]
            rank[some] = np.arange(done, done + len(some))
            labels.append(some)
            done += len(some)
            self.levels.append(done)
        self.labels = np.concatenate(labels)
        up = np.r_[0, np.where(above >= 0, rank[above], 0)[self.labels]]
        degree = np.bincount(up[1:], minlength=n + 1)
        self.bits = np.ones(2 * n + 1, bool)
        self.bits[np.cumsum(degree + 1) - 1] = False
        # The i-th one is node i; the zeros before it are its parent's rank.
        self.parents = np.r_[-1, np.cumsum(~self.bits)[self.bits]]

    def children(self) -> np.ndarray:
        return np.diff(np.r_[-1, np.flatnonzero(~self.bits)]) - 1

    def summed(self, values: np.ndarray) -> np.ndarray:
        """Sums over subtrees of ``values``, one for each node in breadth-first order, node 0 included."""
        out = values.copy()
        for a, b in zip(self.levels[-2::-1], self.levels[:0:-1], strict=True):
            np.add.at(out, self.parents[a:b], out[a:b])
        return out


#: Columns of a node as a shard takes it; the last three are sums from subtrees that are not in the shard.
NODE = ["hi", "lo", "p_hi", "p_lo", "depth", "words", "conv_id", "n_convs", "children", "leaves", "saved"]
ROLLED = "hi long, lo long, p_hi long, p_lo long, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, top boolean"


def _forest(batches: Iterator[pa.RecordBatch]) -> tuple[dict[str, np.ndarray], Louds]:
    rows = pa.Table.from_batches(batches).select(NODE)
    of = {c: rows.column(c).to_numpy().astype(np.int64) for c in NODE}
    place = dict(zip(zip(of["hi"].tolist(), of["lo"].tolist(), strict=True), range(rows.num_rows), strict=True))
    # A root stands above itself in its columns; it has no parent.
    above = np.array([place.get(p, -1) if d else -1 for p, d in zip(zip(of["p_hi"].tolist(), of["p_lo"].tolist(), strict=True), of["depth"].tolist(), strict=True)], np.int64)
    return of, Louds(above, of["depth"], of["conv_id"])


def _rolled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    of, trie = _forest(batches)
    at, up = trie.labels, trie.parents[1:]
    children = trie.children()[1:] + of["children"][at]
    leaves = trie.summed(np.r_[0, of["leaves"][at] + (children == 0)])[1:]
    saved = trie.summed(np.r_[0, of["saved"][at] + (of["n_convs"][at] - 1) * of["words"][at]])[1:]
    parent = pa.array(np.r_[0, of["conv_id"][at]][up], mask=up == 0)
    columns = [of[c][at] for c in ("hi", "lo", "p_hi", "p_lo", "depth", "conv_id")]
    yield pa.RecordBatch.from_arrays([*map(pa.array, columns), parent, *map(pa.array, (of["n_convs"][at], children, leaves, saved, up == 0))], [c.split()[0] for c in ROLLED.split(", ")])


def _succinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = list(batches)
    of, trie = _forest(rows)
    labels = np.stack([of["hi"][trie.labels], of["lo"][trie.labels]], 1).tobytes()
    shard, n = rows[0].column("shard")[0].as_py(), len(trie.labels)
    yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([n], pa.int64()), pa.array([np.packbits(trie.bits, bitorder="little").tobytes()], pa.binary()), pa.array([labels], pa.binary())], ["shard", "n_nodes", "louds", "labels"])


for _f in (_rolled, _succinct):
    _f.__annotations__ = {"batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}


class PrefixTrie:
    """The trie of ``turns(conv_id, place, digest, words)``, rows of ``ordered`` or the like: places need an order only, not every number.

    ``members(conv_id)`` names all conversations, turnless ones too; without it those of ``turns`` are meant. Conversations of equal
    turns share all of their nodes. An empty table has no node, not even a root.
    """

    def __init__(self, turns: DataFrame, members: DataFrame | None = None, heavy: int = HEAVY, shard_nodes: int = SHARD_NODES):
        streamed = turns.select("conv_id", "place", "digest", "words").repartition("conv_id").sortWithinPartitions("conv_id", "place").drop("place")
        self.path = reliable(streamed.mapInArrow(_chained, "conv_id long, depth long, hi long, lo long, p_hi long, p_lo long, words long, last boolean"))
        self.members = (turns if members is None else members).select(F.col("conv_id").cast("long").alias("conv_id")).where("conv_id is not null").distinct()
        same = ["hi", "lo", "p_hi", "p_lo", "depth", "words"]
        nodes = self.path.groupBy(*same).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"))
        root = self.members.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0").select(*[F.lit(0).cast("long").alias(c) for c in same], "conv_id", "n_convs")
        zeros = {c: F.lit(0).cast("long") for c in ("children", "leaves", "saved")}
        every = reliable(nodes.withColumns(zeros))
        self.upper = reliable(every.where(F.col("n_convs") > heavy).unionByName(root.withColumns(zeros)))
        # Each light node lies on the path of its smallest member, whose first light node is the top of its subtree.
        heads = self.upper.select("hi", "lo")
        light = self.path.join(heads, ["hi", "lo"], "left_anti")
        tops = light.groupBy("conv_id").agg(F.min_by(F.struct("hi", "lo"), "depth").alias("top"))
        shards = max(1, -(-every.count() // shard_nodes))
        shard = F.pmod(F.xxhash64("top.hi", "top.lo"), F.lit(shards)).alias("shard")
        self.light = every.where(F.col("n_convs") <= heavy).join(tops, "conv_id").select(*NODE, shard)

    def shards(self) -> DataFrame:
        """``shard, n_nodes, louds, labels``: the stored form, bits packed from the lowest on, labels two numbers of the prefix's
        digest each; the upper trie is shard -1."""
        upper = self.upper.select(*NODE, F.lit(-1).cast("long").alias("shard"))
        return self.light.unionByName(upper).groupBy("shard").applyInArrow(_succinct, "shard long, n_nodes long, louds binary, labels binary")

    def nodes(self) -> DataFrame:
        """One row a node: ``conv_id`` (smallest member), ``depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``."""
        light = reliable(self.light.groupBy("shard").applyInArrow(_rolled, ROLLED))
        tops = light.where("top").groupBy("p_hi", "p_lo").agg(F.count("*").alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
        sums = {c: F.coalesce(F.col(f"t.{c}"), F.lit(0)) for c in ("children", "leaves", "saved")}
        joined = self.upper.drop(*sums).alias("u").join(tops.alias("t"), (F.col("u.hi") == F.col("t.p_hi")) & (F.col("u.lo") == F.col("t.p_lo")), "left")
        upper = joined.select(*[F.col(f"u.{c}") for c in NODE if c not in sums], *[s.alias(c) for c, s in sums.items()])
        upper = upper.groupBy(F.lit(0).alias("one")).applyInArrow(_rolled, ROLLED)
        above = self.upper.select(F.col("hi").alias("p_hi"), F.col("lo").alias("p_lo"), F.col("conv_id").alias("above"))
        hung = light.where("top").join(above, ["p_hi", "p_lo"]).withColumn("parent_conv_id", F.col("above")).select(*light.columns)
        every = light.where("not top").unionByName(hung).unionByName(upper)
        turnless = self.members.join(self.path.select("conv_id").distinct(), "conv_id", "left_anti")
        ends = reliable(self.path.where("last").select("hi", "lo", "conv_id").unionByName(turnless.select(*[F.lit(0).cast("long").alias(c) for c in ("hi", "lo")], "conv_id")))
        none = F.lit(hashlib.sha256(b"").hexdigest())
        said = every.join(end_digests(ends), ["hi", "lo"], "left")
        return said.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256"))
