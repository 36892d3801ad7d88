"""Exact dedup with two-pass Bloom filtering: only rows whose hash may repeat are shuffled.

Pass one reads one 64-bit hash a row and builds a Bloom filter of the hashes that occur at least
twice. Each task keeps, for what it has read, the filter positions hit once and those hit by two
or more rows; the merged filter holds every position that two rows hit. A repeated hash hits each
of its positions twice, so the filter misses none. Pass two tests each row: those outside the
filter are single and pass straight through, the others are grouped by the digest of their text.
False positives cost a shuffled row, never a wrong result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from normloom.llm.shared import column, packed, reliable, unpacked

#: Space, tab, line feed, vertical tab, form feed and carriage return do not count.
IGNORED = " \t\n\x0b\x0c\r"
#: Hash positions of a row.
PROBES = 4
#: Positions of one filter segment; a segment is merged in one group.
SEGMENT_BITS = 13
#: Bounds of the filter: it has about 16 positions a row, at most 2^30 (128 MB). Beyond 67 million rows it
#: fills up and more rows take the exact path, all of them in the end; the result stays the same.
MIN_BITS, MAX_BITS = 16, 30
#: Rows after which a task hands on what it has and starts anew.
FLUSH_ROWS = 1_000_000


def normalised(text: Column) -> Column:
    plain = F.coalesce(text, F.lit(""))
    for char in IGNORED:
        plain = F.replace(plain, F.lit(char), F.lit(""))
    return plain


def positions(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Filter positions of 64-bit hashes, one row of ``PROBES`` for each."""
    h = hashes.view(np.uint64)
    step = (h >> np.uint64(32)) | np.uint64(1)
    return ((h[:, None] + np.arange(PROBES, dtype=np.uint64) * step[:, None]) >> np.uint64(7)) & np.uint64(2**bits - 1)


def _part(hashes: np.ndarray, bits: int) -> Iterator[pa.RecordBatch]:
    found, counts = np.unique(positions(hashes, bits), return_counts=True)
    segment = (found >> np.uint64(SEGMENT_BITS)).astype(np.int64)
    low = (found & np.uint64(2**SEGMENT_BITS - 1)).astype(np.uint16) | ((counts > 1).astype(np.uint16) << 15)
    starts = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]]) if len(segment) else np.zeros(0, int)
    for at in range(0, len(starts), 4096):
        some, ends = starts[at : at + 4096], np.r_[starts[1:], len(low)][at : at + 4096]
        yield pa.RecordBatch.from_arrays([pa.array(segment[some]), pa.array([low[a:b].tobytes() for a, b in zip(some, ends, strict=True)], pa.binary())], ["segment", "hits"])


def repeated_filter(hashes: DataFrame, bits: int) -> np.ndarray:
    """The Bloom filter of the values of the one bigint column ``hash`` that occur at least twice."""

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            held.append(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64))
            if sum(map(len, held)) >= FLUSH_ROWS:
                yield from _part(np.concatenate(held), bits)
                held = []
        if held:
            yield from _part(np.concatenate(held), bits)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, segment = np.zeros(2**SEGMENT_BITS, np.uint8), 0
        for batch in batches:
            for name, hits in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                got, segment = np.frombuffer(hits, np.uint16), name
                place = got & (2**15 - 1)
                counts[place] = np.minimum(counts[place] + 1 + (got >> 15), 2)
        yield pa.RecordBatch.from_arrays([pa.array([segment], pa.int64()), pa.array([np.packbits(counts > 1, bitorder="little").tobytes()], pa.binary())], ["segment", "bits"])

    merged.__annotations__ = {"batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    parts = hashes.mapInArrow(slices, "segment long, hits binary").groupBy("segment").applyInArrow(merged, "segment long, bits binary")
    whole, width = np.zeros(2**bits // 8, np.uint8), 2**SEGMENT_BITS // 8
    for segment, chunk in parts.where(F.length(F.replace(F.hex("bits"), F.lit("0"), F.lit(""))) > 0).toLocalIterator():
        whole[segment * width : (segment + 1) * width] = np.frombuffer(chunk, np.uint8)
    return whole


def may_repeat(rows: DataFrame, hash_name: str = "hash") -> Column:
    """A boolean column expression: false only where the row's hash occurs once in ``rows``."""
    n = rows.count()
    bits = int(np.clip(np.ceil(np.log2(max(16 * n, 1))), MIN_BITS, MAX_BITS))
    shared = rows.sparkSession.sparkContext.broadcast(repeated_filter(rows.select(F.col(hash_name)), bits))

    @F.pandas_udf("boolean")
    def test(hashes: pd.Series) -> pd.Series:
        at = positions(hashes.to_numpy(np.int64), bits)
        return pd.Series(((shared.value[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=1))

    return test(F.col(hash_name))


def duplicate_groups(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical without ASCII white space. Of equal texts the row with the most
    code points in its original text stays, then the smallest ``doc_id`` (null before any other).
    A null text counts as empty. Rows that repeat a ``doc_id`` with texts of the same length tie:
    all rows with that id are marked as kept here; ``drop_duplicates`` leaves one of them. An empty table gives no row;
    other columns are not read, whatever their names. Texts are read once; what the passes need of them, a short row
    each, is kept in the shared folder.
    """
    plain = normalised(column(text))
    texts = docs.select(column(key).alias("doc_id"), F.length(F.coalesce(column(text), F.lit(""))).alias("chars"), plain.alias("plain"))
    body = reliable(texts.select("doc_id", "chars", F.xxhash64("plain").alias("hash"), F.sha2(F.col("plain").cast("binary"), 256).alias("text_sha256")))
    body = body.withColumn("maybe", may_repeat(body.select("hash")))
    single = body.where("not maybe").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    many = body.where("maybe").select("doc_id", "chars", "text_sha256")
    # Grouping by the digest and a part of it leaves a layout that the join cannot reuse: both of its sides
    # are exchanged, and a digest with very many rows can be split.
    groups = many.groupBy("text_sha256", F.substring("text_sha256", 1, 2).alias("head")).agg(F.count("*").alias("group_size"), F.min(F.struct((-F.col("chars")).alias("chars"), "doc_id")).alias("best"))
    groups = groups.select(F.col("text_sha256").alias("digest"), "group_size", F.col("best.doc_id").alias("keep_id"), (-F.col("best.chars")).alias("best_chars"))
    joined = many.join(groups, many.text_sha256 == groups.digest).select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("chars") == F.col("best_chars"))).alias("kept"), "text_sha256")
    return single.unionByName(joined)


def drop_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that stay, in its columns: exactly one of each group of equal texts.

    A null text counts as empty, an empty table gives no row, columns keep their names and values. Rows outside the filter pass straight through. The rest are grouped by digest with partial
    aggregation, each task handing on one whole row a group, so a group of any size stays small.
    """
    plain = normalised(column(text))
    maybe = may_repeat(docs.select(F.xxhash64(plain).alias("hash")))
    rows = packed(docs, hash=F.xxhash64(plain), digest=F.sha2(plain.cast("binary"), 256), chars=F.length(F.coalesce(column(text), F.lit(""))), key=column(key)).withColumn("maybe", maybe)
    single = rows.where("not maybe").select("row")
    best = rows.where("maybe").groupBy("digest").agg(F.min_by("row", F.struct((-F.col("chars")).alias("chars"), "key", F.xxhash64("row"))).alias("row"))
    return unpacked(single.unionByName(best.select("row")), docs.columns)
