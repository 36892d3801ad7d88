"""SimHash near-dedup: fingerprints of word shingles, linked when few bits differ, on pigeonhole blocks.

Fingerprints at most ``MAX_BITS_APART`` bits apart agree on all but that many of any set of
blocks, so a key for each choice of the remaining blocks finds every close pair. With more
fingerprints the blocks get more numerous and the keys longer, so that a key stays selective.
Keys that many different fingerprints share (large groups of near copies) are not joined pair by
pair: each of their fingerprints names all values within half the distance, and two fingerprints
within the whole distance name a common one. At most 2,081 fingerprints can name a value, so this
is linear in the fingerprints, and it links exactly the pairs that the join would link.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from normloom.llm.components import connected_components
from normloom.llm.shared import bounded_batches, column, packed, reliable, unpacked

SHINGLE_WORDS, MAX_BITS_APART, SEED = 4, 4, 42
#: Fingerprints that share a key; beyond this the key's members are linked through common values.
CROWD = 1000
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
#: Shingle hashes whose bits are counted at once.
_CHUNK = 1 << 16


def shingle_hashes(text: str | None, words: int = SHINGLE_WORDS) -> np.ndarray:
    """XXH64 of every run of ``words`` words, repeats included; of all words if there are fewer; none without words."""
    found = _WORD.findall((text or "").encode("utf-8", "surrogatepass").lower())
    if not found:
        return np.zeros(0, np.uint64)
    joined = b" ".join(found)
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    width = min(words, len(found))
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[: len(found) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)), np.uint64, len(found) - width + 1)


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How often each of the 64 bits is set, lowest first."""
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _CHUNK):
        bits = np.unpackbits(hashes[at : at + _CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int64) if len(bits) > 255 else bits.sum(axis=0, dtype=np.uint8)
    return total


def fingerprint(text: str | None) -> int:
    hashes = shingle_hashes(text)
    majority = bit_counts(hashes) * 2 > len(hashes)
    return int(np.packbits(majority, bitorder="little").view(np.uint64)[0])


def with_fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, fp``: the fingerprint as a signed 64-bit number."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.fromiter((fingerprint(t.as_py()) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], ["key", "fp"])

    picked = docs.select(column(key).alias("key"), column(text).cast("string").alias("text"))
    return picked.mapInArrow(run, f"key {picked.schema['key'].dataType.simpleString()}, fp long")


def block_masks(n: int) -> list[int]:
    """For ``n`` fingerprints the bit masks of the keys, as signed numbers.

    64 bits are cut into m blocks; a key is the choice of m - 4 of them. m is the least for which
    a random key is shared by about four fingerprints at most.
    """
    m = next((m for m in range(MAX_BITS_APART + 1, 11) if 64 * (m - MAX_BITS_APART) // m >= math.log2(max(n, 1)) - 2), 11)
    edges = [64 * i // m for i in range(m + 1)]
    blocks = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    unsigned = [sum(some) for some in combinations(blocks, m - MAX_BITS_APART)]
    return [x - (1 << 64) if x >> 63 else x for x in unsigned]


def _common_values(fp: Column) -> Column:
    """All values at most two bits from ``fp``: half the distance, so close pairs have one in common."""
    bit = lambda i: F.when(i == 64, F.lit(0).cast("long")).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), i))
    pairs = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.transform(F.sequence(i + 1, F.lit(64)), lambda j: fp.bitwiseXOR(bit(i)).bitwiseXOR(bit(j))))
    return F.concat(F.array(fp), F.flatten(pairs))


def close_links(prints: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Links ``(u, v)`` between the distinct values of ``prints(fp)`` that connect the same values
    as all pairs at most ``MAX_BITS_APART`` bits apart would; every link is such a pair or joins two
    values through a chain of such pairs."""
    prints = prints.select("fp").distinct()
    masks = block_masks(prints.count())
    keyed = prints.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m).cast("long")) for m in masks])).alias("block", "bits"))
    crowded = reliable(keyed.groupBy("block", "bits").count().where(F.col("count") > crowd).select("block", "bits"))
    apart = "bit_count(a.fp ^ b.fp) <= " + str(MAX_BITS_APART)
    sparse = keyed if crowded.isEmpty() else keyed.join(crowded, ["block", "bits"], "left_anti")
    links = sparse.alias("a").join(sparse.alias("b"), F.expr(f"a.block = b.block and a.bits = b.bits and a.fp > b.fp and {apart}")).select(F.col("a.fp").alias("u"), F.col("b.fp").alias("v"))
    if not crowded.isEmpty():
        dense = keyed.join(crowded, ["block", "bits"], "left_semi").select("fp").distinct()
        near = dense.select("fp", F.explode(_common_values(F.col("fp"))).alias("value")).groupBy("value").agg(F.collect_set("fp").alias("fps")).where("size(fps) > 1")
        links = links.unionByName(near.select(F.explode("fps").alias("u"), F.array_min("fps").alias("v")).where("u != v"))
    return links.distinct()


def _classes(prints: DataFrame) -> DataFrame:
    """``fp, least``: each fingerprint with the smallest key of its component; ``prints`` has key and fp."""
    own = prints.groupBy("fp").agg(F.min("key").alias("least"))
    linked = connected_components(close_links(own)).select(F.col("node").alias("fp"), "component")
    own = own.join(linked, "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    best = own.groupBy("component", F.pmod("component", F.lit(7)).alias("digit")).agg(F.min("least").alias("smallest")).select("component", "smallest")
    return own.join(best, "component").select("fp", F.col("smallest").alias("least"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, fingerprint, component_id``.

    ``component_id`` is the smallest id that a chain of links reaches, the row itself included. A text
    without words (null, empty, blank) has fingerprint zero and is linked like any other. Repeated
    rows give repeated results; null ids are passed over for the smallest id, so a component of
    null ids alone has a null id. An empty table gives an empty result.
    """
    prints = reliable(with_fingerprints(docs, key, text))
    classes = _classes(prints)
    return prints.join(classes, "fp").select(F.col("key").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("least").alias("component_id"))


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, in its columns: of each component the row with the smallest id.

    Rows of that id tie by a hash of the whole row; of wholly identical rows one stays. Null ids come last.
    """
    whole = F.xxhash64(*[column(c) for c in docs.columns])
    rows = packed(docs, key=column(key), mark=whole)
    prints = reliable(with_fingerprints(packed(docs, key=F.struct(column(key).isNull().alias("none"), column(key).alias("id"), whole.alias("mark")), text=column(text)), "key", "text"))
    classes = _classes(prints)
    kept = classes.select("least").distinct().select(F.col("least.id").alias("id"), F.col("least.mark").alias("mark"))
    again = prints.groupBy("key").count().where("count > 1").select(F.col("key.id").alias("id"), F.col("key.mark").alias("mark"), F.lit(True).alias("again"))
    kept = kept.join(again, [kept.mark == again.mark, kept.id.eqNullSafe(again.id)], "left").select(kept.id, kept.mark, F.coalesce("again", F.lit(False)).alias("again"))
    stay = rows.join(kept, [rows.mark == kept.mark, rows.key.eqNullSafe(kept.id)]).select("row", rows.mark, "again")
    once = stay.where("again").groupBy("mark").agg(F.first("row").alias("row")).select("row")
    return unpacked(stay.where("not again").select("row").unionByName(once), docs.columns)
