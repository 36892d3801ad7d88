"""Incremental, reversible line dedup: sharded cuckoo filters backed by exact reference counts.

An index holds one reference for each document and line key, as append-only rows with a change of
+1 or -1. A key whose reference count reaches ``least_docs`` enters the cuckoo filter of its shard, and its
fingerprint is deleted again when documents go and the count falls below. Reading tests every
reference by the filters; only those that pass are shuffled and counted exactly, so false positives
cost a shuffled row and never a line. Of a key held by at least ``least_docs`` documents all lines
go but those of the largest document id; deleting documents gives the lines back.

Keys are known by two 64-bit hashes, 128 bits together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from normloom.llm.shared import ascii_lower, bounded_batches, column, packed, reliable, unpacked

#: Stripped at both ends of a line: space, tab, line feed, vertical tab, form feed, carriage return.
STRIPPED = " \t\n\x0b\x0c\r"
#: Slots of a bucket, the share of slots filled at most, and rounds of moving fingerprints before a filter counts as full.
SLOTS, FULLEST, ROUNDS = 4, 0.8, 500
#: Filters of this size together are sent to every executor; larger ones are joined by shard, whose references are dealt to ``SALTS`` parts.
BROADCAST_BYTES, SALTS = 32 << 20, 32
#: Shards of a new index.
SHARDS = 64


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(STRIPPED)))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _hashes(key: Column) -> Column:
    return F.struct(F.xxhash64(key).alias("hi"), F.xxhash64(F.lit(1), key).alias("lo"))


class Cuckoo:
    """A cuckoo filter over pairs of hashes: ``slots`` has a row of fingerprints for each bucket, 0 where free.

    A fingerprint's other bucket depends on it and its bucket alone, so that two keys of one
    fingerprint which share a bucket share both, and deleting either leaves the other found.
    """

    def __init__(self, slots: np.ndarray):
        self.slots, self.mask = slots, len(slots) - 1

    @classmethod
    def sized(cls, keys: int) -> Cuckoo:
        return cls(np.zeros((1 << max(2, int(np.ceil(np.log2(max(keys, 1) / (SLOTS * FULLEST))))), SLOTS), np.uint16))

    @classmethod
    def built(cls, lo: np.ndarray) -> Cuckoo:
        made, room = cls.sized(len(lo)), len(lo)
        while not made.insert(lo):
            room = max(2 * room, 1)
            made = cls.sized(room)
        return made

    def _other(self, bucket: np.ndarray, mark: np.ndarray) -> np.ndarray:
        return bucket ^ (((mark.astype(np.int64) * 0x5BD1E995) >> 7) & self.mask)

    def _marks(self, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = lo.astype(np.int64).view(np.uint64)
        return np.maximum(h & np.uint64(0xFFFF), 1).astype(np.uint16), ((h >> np.uint64(16)).astype(np.int64)) & self.mask

    def contains(self, lo: np.ndarray) -> np.ndarray:
        mark, bucket = self._marks(lo)
        return (self.slots[bucket] == mark[:, None]).any(1) | (self.slots[self._other(bucket, mark)] == mark[:, None]).any(1)

    def insert(self, lo: np.ndarray) -> bool:
        """Add keys; false if they find no room, after which the filter must be built anew."""
        if np.count_nonzero(self.slots) + len(lo) > FULLEST * self.slots.size:
            return False
        mark, bucket = self._marks(lo)
        turned, draw, moves = np.zeros(len(mark), bool), np.random.default_rng(len(lo)), 0
        while len(mark):
            lead = np.unique(bucket, return_index=True)[1]  # one key a bucket and round
            free = self.slots[bucket[lead]] == 0
            fits = free.any(1)
            at = lead[fits]
            self.slots[bucket[at], free[fits].argmax(1)] = mark[at]
            stuck = lead[~fits]
            kick = stuck[turned[stuck]]
            turn = stuck[~turned[stuck]]
            bucket[turn], turned[turn] = self._other(bucket[turn], mark[turn]), True
            if len(kick):
                moves += 1
                place = draw.integers(0, SLOTS, len(kick))
                out = self.slots[bucket[kick], place].copy()
                self.slots[bucket[kick], place] = mark[kick]
                mark[kick], bucket[kick] = out, self._other(bucket[kick], out)
                if moves > ROUNDS:
                    return False
            left = np.ones(len(mark), bool)
            left[at] = False
            mark, bucket, turned = mark[left], bucket[left], turned[left]
        return True

    def delete(self, lo: np.ndarray) -> None:
        """Take away one fingerprint for each key, all of which must have been inserted."""
        mark, bucket = self._marks(lo)
        pair = np.minimum(bucket, self._other(bucket, mark))
        while len(mark):
            lead = np.unique(pair, return_index=True)[1]
            left = np.ones(len(mark), bool)
            left[lead] = False
            for other in (False, True):
                b = self._other(pair[lead], mark[lead]) if other else pair[lead]
                hit = self.slots[b] == mark[lead][:, None]
                found = hit.any(1)
                self.slots[b[found], hit[found].argmax(1)] = 0
                lead = lead[~found]
            mark, pair = mark[left], pair[left]

    @classmethod
    def read(cls, slots: bytes) -> Cuckoo:
        return cls(np.frombuffer(slots, np.uint16).reshape(-1, SLOTS).copy())

    def row(self) -> bytes:
        return self.slots.tobytes()


def _updated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One shard's filter after deletions and insertions; null slots if they do not fit."""
    held, added, gone, shard = None, [], [], 0
    for batch in batches:
        shard = batch.column("shard")[0].as_py()
        step, lo = batch.column("step").to_numpy(), batch.column("lo").to_numpy(zero_copy_only=False)
        for slots in batch.column("slots").drop_null().to_pylist():
            held = Cuckoo.read(slots)
        added.append(lo[step > 0])
        gone.append(lo[step < 0])
    new, old = np.concatenate(added), np.concatenate(gone)
    if held is None:
        held, fits = Cuckoo.built(new), True
    else:
        held.delete(old)
        fits = held.insert(new)
    yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([held.row() if fits else None], pa.binary())], ["shard", "slots"])


_updated.__annotations__ = {"batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}


class LineIndex:
    """References and filters below ``folder``, which all executors share.

    Each change writes one version: references first, then one filter for each shard. A version counts once all of its
    filters are there, so a change that broke off leaves nothing and may be repeated. The id column must keep its type.
    """

    def __init__(self, spark: SparkSession, folder: str, least_docs: int = 3, least_chars: int = 20, shards: int = SHARDS):
        self.spark, self.folder, self.least_docs, self.least_chars, self.shards = spark, folder.rstrip("/"), least_docs, least_chars, shards

    def _read(self, name: str) -> DataFrame | None:
        try:
            return self.spark.read.parquet(f"{self.folder}/{name}")
        except AnalysisException as error:
            if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                return None
            raise

    def version(self) -> int:
        found = self._read("filters")
        whole = found.groupBy("version").agg(F.count("*").alias("n")).where(F.col("n") == self.shards).agg(F.max("version")).first()[0] if found is not None else None
        return whole or 0

    def _filters(self, version: int) -> DataFrame:
        return self._read("filters").where(F.col("version") == version).select("shard", "slots")

    def references(self) -> DataFrame:
        """``hi, lo, doc_id, change, version`` of all whole versions."""
        return self._read("references").where(F.col("version") <= self.version())

    def insert(self, docs: DataFrame, text: str = "text", key: str = "doc_id") -> None:
        """Add the lines of documents. A null or empty text is one empty line; rows that repeat an id are one document,
        whether they come together or later; a null id is one document, smaller than all others."""
        keys = F.filter(F.transform(_lines(column(text)), line_key), lambda k: F.length(k) >= self.least_chars)
        found = docs.select(column(key).alias("doc_id"), F.explode(F.transform(F.array_distinct(keys), _hashes)).alias("h"))
        self._advance(found.select("h.hi", "h.lo", "doc_id", F.lit(1).alias("change")))

    def delete(self, ids: DataFrame, key: str = "doc_id") -> None:
        """Take documents away; ids that the index does not hold change nothing."""
        if not self.version():
            return
        gone = ids.select(column(key).alias("gone")).distinct()
        held = self.references().join(F.broadcast(gone) if gone.count() <= 100_000 else gone, F.col("doc_id").eqNullSafe(F.col("gone")), "left_semi")
        self._advance(held.groupBy("hi", "lo", "doc_id").agg((-F.sum("change")).cast("int").alias("change")).where("change < 0"))

    def _advance(self, references: DataFrame) -> None:
        old = self.version()
        now = old + 1
        references.write.mode("overwrite").parquet(f"{self.folder}/references/version={now}")
        every = self._read("references").where(F.col("version") <= now)
        counts = every.groupBy("hi", "lo").agg(F.sum(F.when(F.col("version") <= old, F.col("change")).otherwise(0)).alias("before"), F.sum("change").alias("after"))
        shard = F.pmod("hi", F.lit(self.shards)).cast("int").alias("shard")
        enters, was = F.col("after") >= self.least_docs, F.col("before") >= self.least_docs
        crossed = counts.where(enters != was).select(shard, F.when(enters, 1).otherwise(-1).alias("step"), "lo", F.lit(None).cast("binary").alias("slots"))
        filters = self._filters(old).select("shard", F.lit(0).alias("step"), F.lit(0).cast("long").alias("lo"), "slots") if old else None
        given = crossed.unionByName(filters) if old else crossed.unionByName(self.spark.range(self.shards).select(F.col("id").cast("int").alias("shard"), F.lit(0).alias("step"), F.lit(0).cast("long").alias("lo"), F.lit(None).cast("binary").alias("slots")))
        made = reliable(given.groupBy("shard").applyInArrow(_updated, "shard int, slots binary"))
        full = made.where("slots is null").select("shard")
        again = counts.where(enters).select(shard, F.lit(1).alias("step"), "lo", F.lit(None).cast("binary").alias("slots")).join(full, "shard", "left_semi")
        if not full.isEmpty():
            made = made.where("slots is not null").unionByName(again.groupBy("shard").applyInArrow(_updated, "shard int, slots binary"))
        made.write.mode("overwrite").parquet(f"{self.folder}/filters/version={now}")

    def _tested(self, references: DataFrame) -> DataFrame:
        """The references whose key a filter may hold."""
        filters, shards = self._filters(self.version()), self.shards
        if filters.agg(F.sum(F.length("slots"))).first()[0] <= BROADCAST_BYTES:
            shared = self.spark.sparkContext.broadcast({r.shard: bytes(r.slots) for r in filters.collect()})  # at most BROADCAST_BYTES

            @F.arrow_udf("boolean")
            def test(hi: pa.Array, lo: pa.Array) -> pa.Array:
                own, low, out = np.mod(hi.to_numpy(), shards), lo.to_numpy(), np.zeros(len(hi), bool)
                for s in np.unique(own):
                    out[own == s] = Cuckoo.read(shared.value[int(s)]).contains(low[own == s])
                return pa.array(out)

            return references.where(test("hi", "lo"))
        kind = references.schema["doc_id"].dataType
        rows = references.select(F.pmod("hi", F.lit(shards)).cast("int").alias("shard"), F.pmod(F.xxhash64("doc_id", "change"), F.lit(SALTS)).cast("int").alias("salt"), "hi", "lo", "doc_id", "change", F.lit(None).cast("binary").alias("slots"))
        each = filters.select("shard", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), F.lit(None).cast("long").alias("hi"), F.lit(None).cast("long").alias("lo"), F.lit(None).cast(kind).alias("doc_id"), F.lit(None).cast("int").alias("change"), "slots")

        def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, held = None, None
            for batch in batches:
                place = np.stack([batch.column("shard").to_numpy(), batch.column("salt").to_numpy()])
                cuts = [0, *(np.flatnonzero((place[:, 1:] != place[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
                for a, b in zip(cuts, cuts[1:], strict=False):
                    some = batch.slice(a, b - a)
                    if (own := (int(place[0, a]), int(place[1, a]))) != at:
                        at, held = own, Cuckoo.read(some.column("slots")[0].as_py())  # a part's filter is sorted before its references
                        some = some.slice(1)
                    if some.num_rows:
                        yield some.filter(pa.array(held.contains(some.column("lo").to_numpy(zero_copy_only=False)))).select(["hi", "lo", "doc_id", "change"])

        dealt = rows.unionByName(each).repartition("shard", "salt").sortWithinPartitions("shard", "salt", F.col("slots").isNull())
        return dealt.mapInArrow(passed, references.select("hi", "lo", "doc_id", "change").schema)

    def counts(self) -> DataFrame:
        """``hi, lo, n_docs, keep_id`` of the keys that lose lines."""
        return self._counts(self._held())

    def _held(self) -> DataFrame:
        """The documents of each key that a filter may hold."""
        live = self._tested(self.references().select("hi", "lo", "doc_id", "change"))
        return live.groupBy("hi", "lo", "doc_id").agg(F.sum("change").alias("rows")).where("rows > 0").select("hi", "lo", "doc_id")

    def _counts(self, held: DataFrame) -> DataFrame:
        # Grouping by a part of the key too leaves a layout that a join cannot reuse, so a key of very many documents can be split.
        found = held.groupBy("hi", "lo", F.pmod("lo", F.lit(7)).alias("part")).agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("keep_id"))
        return found.where(F.col("n_docs") >= self.least_docs).drop("part")

    def kept(self, docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
        """``docs`` plus ``n_lines`` (before), ``n_dropped`` and ``kept_text``, its other lines joined by line feeds.

        Documents that the index does not hold lose nothing. A null text is one empty line and stays as an empty text. An
        empty table gives no row; added columns replace input columns of the same names.
        """
        held = reliable(self._held()) if self.version() else None
        lines = _lines(F.col("text"))
        rows = packed(docs, text=column(text), key=column(key))
        if held is None:
            return unpacked(rows.select("row", F.size(lines).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_dropped"), F.coalesce("text", F.lit("")).alias("kept_text")), docs.columns, ["n_lines", "n_dropped", "kept_text"])
        losing = held.join(self._counts(held), ["hi", "lo"]).where(~F.col("doc_id").eqNullSafe(F.col("keep_id")))
        drops = losing.groupBy("doc_id").agg(F.collect_list(F.struct("hi", "lo")).alias("drops"))
        bounded_batches(self.spark)

        @F.arrow_udf("array<boolean>")
        def stays(keys: pa.Array, drops: pa.Array) -> pa.Array:
            out = []
            for line, drop in zip(keys, drops, strict=True):
                gone = {(d["hi"], d["lo"]) for d in drop.as_py()}
                out.append([h is None or (h["hi"], h["lo"]) not in gone for h in line.as_py()])
            return pa.array(out, pa.list_(pa.bool_()))

        joined = rows.join(drops, F.col("key").eqNullSafe(F.col("doc_id")), "left")
        whole = joined.where("drops is null").select("row", F.size(lines).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_dropped"), F.coalesce("text", F.lit("")).alias("kept_text"))
        hashed = F.transform(F.transform(lines, line_key), lambda k: F.when(F.length(k) >= self.least_chars, _hashes(k)))
        cut = joined.where("drops is not null").select("row", "text", stays(hashed, F.col("drops")).alias("stays"))
        left = F.filter(lines, lambda _, i: F.get(F.col("stays"), i))
        cut = cut.select("row", F.size("stays").cast("long").alias("n_lines"), F.size(F.filter("stays", lambda s: ~s)).cast("long").alias("n_dropped"), F.array_join(left, "\n").alias("kept_text"))
        return unpacked(whole.unionByName(cut), docs.columns, ["n_lines", "n_dropped", "kept_text"])
