"""Cross-tokenizer alignment by an event sweep over the token ends of two tokenizers.

Every text is encoded by tokenizer A and by tokenizer B. Their end events, in blocks of ids whose offsets follow from
the tokens' byte lengths, are united, dealt out by document, sorted by offset and streamed through a
machine that holds no more than the tokens since the last offset where both ended. Each such
offset closes a group; the machine emits the groups' digest and the document's links. The links' document counts are then
added up over the corpus and read back for each document.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from normloom.llm.byte_bpe import _gathered
from normloom.llm.shared import bounded_batches, column, held_by_worker, reliable

#: Tokens of one event block, and bytes of encoded pieces that a Python worker keeps before it forgets them.
BLOCK, KEPT_BYTES = 1 << 15, 64 << 20
#: Links of a group beyond which its distinct tokens are paired instead of its tokens, and pairs that a task counts before it hands them on.
WIDE, HELD_PAIRS = 4096, 1 << 21
#: Rows of the table of link counts up to which it is sent to every executor (16 bytes a row); a larger one is joined.
BROADCAST_ROWS = 4_000_000
#: White space before a space: there the texts are not cut into pieces.
_BLANK_BEFORE = re.compile(r"\s ")
_PIECE = re.compile(r" ?(?:[^ ]|(?<=\s) )*")


def _byte_symbols() -> dict[str, int]:
    """The printable symbol of each byte in byte-level vocabularies: printable bytes stand for themselves, the others for
    the characters from 256 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def byte_level_side(path: str) -> tuple[Callable[[list[str]], list[list[int]]], list[bytes]]:
    """Encoder of pieces that begin with a space, and the bytes of each id, from a byte-level ``tokenizer.json``."""
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    made.encode_special_tokens = True
    symbols = _byte_symbols()
    words = [made.id_to_token(i) or "" for i in range(made.get_vocab_size())]
    spelt = [bytes(symbols[c] for c in w) if all(c in symbols for c in w) else w.encode() for w in words]
    return lambda pieces: [e.ids for e in made.encode_batch_fast(pieces, add_special_tokens=False)], spelt


def piece_side(path: str) -> tuple[Callable[[list[str]], list[list[int]]], list[bytes]]:
    """The same from a sentence-piece model that puts a space before each text; pieces lose theirs first."""
    from sentencepiece import SentencePieceProcessor

    made = SentencePieceProcessor(model_file=path)
    names = [made.id_to_piece(i) for i in range(made.get_piece_size())]
    if any(re.search("[^▁]▁", name) for name in names):
        raise ValueError("a piece goes on after a space, so texts cannot be cut at spaces")
    spelt = [bytes([int(n[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", n) else n.replace("▁", " ").encode() for n in names]
    alone = made.encode("x ")[len(made.encode("x")) :]  # the library gives nothing for an empty text, so a lone space is read off another

    def encode(pieces: list[str]) -> list[list[int]]:
        return [ids or alone for ids in made.encode([p[1:] for p in pieces], num_threads=1)]

    return encode, spelt


class Side:
    """One tokenizer in a worker: the ids of each piece seen so far, as stretches of one pool, and whether they spell it."""

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], spelt: list[bytes]):
        self.encode, self.spelt, self.sizes = encode, spelt, np.array([len(w) for w in spelt], np.int64)
        self.begin, self.count, self.good, self.pool = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.uint16)

    def learn(self, pieces: list[str]) -> None:
        pools, counts, good = [self.pool], [self.count], [self.good]
        for at in range(0, len(pieces), 4096):
            some = pieces[at : at + 4096]
            ids = self.encode(some)
            flat = list(chain.from_iterable(ids))
            counts.append(np.fromiter(map(len, ids), np.int64, len(ids)))
            pools.append(np.array(flat, np.uint16))
            raw = [p.encode() for p in some]
            ends, own = np.cumsum(counts[-1]), np.r_[0, np.cumsum(self.sizes[pools[-1]])]
            if b"".join(map(self.spelt.__getitem__, flat)) == b"".join(raw) and (own[ends] == np.cumsum([len(r) for r in raw])).all():
                good.append(np.ones(len(some), bool))
            else:
                good.append(np.array([b"".join(map(self.spelt.__getitem__, i)) == r for i, r in zip(ids, raw, strict=True)]))
        self.pool, self.count, self.good = np.concatenate(pools), np.concatenate(counts), np.concatenate(good)
        self.begin = np.cumsum(self.count) - self.count


def pieces_of(text: str) -> list[str]:
    """A space and the text, cut before every space that follows no white space: neither tokenizer has a token across such a cut."""
    whole = " " + text
    if _BLANK_BEFORE.search(whole):
        return [p for p in _PIECE.findall(whole) if p]
    return [" " + p for p in whole[1:].split(" ")]


class Encoder:
    """Both tokenizers over one store of pieces, emptied when it has grown over ``KEPT_BYTES``."""

    def __init__(self, a: str, b: str):
        self.sides = [Side(*byte_level_side(a)), Side(*piece_side(b))]
        self.lengths = [s.sizes for s in self.sides]
        self.number: dict[str, int] = {}
        self.held = 0

    def encode(self, texts: list[str]) -> list[list[np.ndarray]]:
        """The ids of A and of B for each text; none if either does not spell a space and the text."""
        if self.held > KEPT_BYTES:
            self.number, self.held = {}, 0
            self.sides = [Side(s.encode, s.spelt) for s in self.sides]
        cut = [pieces_of(t) if t else [] for t in texts]
        fresh = list(set().union(*cut).difference(self.number))
        self.number.update(zip(fresh, range(len(self.number), len(self.number) + len(fresh)), strict=True))
        self.held += sum(map(len, fresh)) + 120 * len(fresh)
        for side in self.sides:
            side.learn(fresh)
        out = []
        for pieces in cut:
            at = np.fromiter(map(self.number.__getitem__, pieces), np.int64, len(pieces))
            fine = all(side.good[at].all() for side in self.sides)
            out.append([_gathered(side.pool, side.begin[at], side.count[at]) if fine and len(at) else side.pool[:0] for side in self.sides])
        return out


class Sweep:
    """The machine of one document: tokens since the last common end, and what the closed groups add up to."""

    def __init__(self, marks: tuple[np.ndarray, np.ndarray, np.ndarray]):
        self.marks = marks
        self.ids, self.ends = [np.zeros(0, np.uint16)] * 2, [np.zeros(0, np.int64)] * 2
        self.tokens, self.groups, self.links, self.first = [0, 0], 0, 0, True
        self.state = hashlib.sha256()
        self.pairs, self.times, self.fresh = np.zeros(0, np.uint32), np.zeros(0, np.int64), []

    def take(self, side: int, start: int, ids: np.ndarray, lengths: np.ndarray) -> None:
        self.ids[side] = np.concatenate([self.ids[side], ids])
        self.ends[side] = np.concatenate([self.ends[side], start + np.cumsum(lengths[ids])])
        common = np.intersect1d(*self.ends, assume_unique=True)
        if len(common):
            self._close(common)

    def _close(self, common: np.ndarray) -> None:
        upto = [np.searchsorted(e, common, side="right") for e in self.ends]
        ids = [i[: u[-1]] for i, u in zip(self.ids, upto, strict=True)]
        self.ids = [i[u[-1] :] for i, u in zip(self.ids, upto, strict=True)]
        self.ends = [e[u[-1] :] for e, u in zip(self.ends, upto, strict=True)]
        n = [np.diff(u, prepend=0) for u in upto]
        begin = [u - m for u, m in zip(upto, n, strict=True)]
        self.groups += len(common)
        for s in (0, 1):
            self.tokens[s] += len(ids[s])
        width = n[0] * n[1]
        self.links += int(width.sum())
        self._say(ids, n, begin)
        narrow = width <= WIDE
        if narrow.any():
            na, nb, fa, fb, w = n[0][narrow], n[1][narrow], begin[0][narrow], begin[1][narrow], width[narrow]
            k = np.arange(int(w.sum())) - np.repeat(np.cumsum(w) - w, w)
            nb_each = np.repeat(nb, w)
            left = ids[0][np.repeat(fa, w) + k // nb_each].astype(np.uint32)
            self._add(*np.unique(left << 16 | ids[1][np.repeat(fb, w) + k % nb_each], return_counts=True))
        for g in np.flatnonzero(~narrow):
            a, ca = np.unique(ids[0][begin[0][g] : begin[0][g] + n[0][g]], return_counts=True)
            b, cb = np.unique(ids[1][begin[1][g] : begin[1][g] + n[1][g]], return_counts=True)
            for i, c in zip(a.tolist(), ca.tolist(), strict=True):
                self._add(np.uint32(i << 16) | b, c * cb)

    def _say(self, ids: list[np.ndarray], n: list[np.ndarray], begin: list[np.ndarray]) -> None:
        comma, bar, end = self.marks
        words = np.empty(len(ids[0]) + len(ids[1]), object)
        shift = [begin[1], begin[0] + n[0]]  # what of the other side stands before each group's tokens
        for s, closing in ((0, bar), (1, end)):
            own = comma[ids[s]]
            last = begin[s] + n[s] - 1
            own[last] = closing[ids[s][last]]
            words[np.arange(len(own)) + np.repeat(shift[s], n[s])] = own
        text = b"".join(words.tolist())
        self.state.update(text[:-1] if self.first else b";" + text[:-1])
        self.first = False

    def _add(self, pairs: np.ndarray, times: np.ndarray) -> None:
        self.fresh.append((pairs.astype(np.uint32), times))
        if sum(len(p) for p, _ in self.fresh) > max(1 << 16, len(self.pairs)):
            self._merge()

    def _merge(self) -> None:
        if self.fresh:
            self.pairs, self.times = _summed([(self.pairs, self.times), *self.fresh])
            self.fresh = []

    def row(self) -> tuple:
        self._merge()
        said = "" if not self.groups else self.state.hexdigest()
        return *self.tokens, self.groups, self.links, said, self.pairs.tobytes(), self.times.astype(np.uint32).tobytes()


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs in order, with the sums of their numbers."""
    keys, values = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(values, first) if len(first) else values


def _marks(size: int = 1 << 16) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return tuple(np.array([b"%d%b" % (i, sep) for i in range(size)], object) for sep in (b",", b"|", b";"))


class Aligner:
    """A byte-level tokenizer A and a sentence-piece tokenizer B by their files, which every executor has at the same path.

    Ids must lie below 65,536 on both sides.
    """

    def __init__(self, spark: SparkSession, a: str, b: str):
        self.spark, self.a, self.b, self.name = spark, a, b, f"align {a} {b}"
        lengths = [np.array([len(w) for w in side(path)[1]], np.int64) for side, path in ((byte_level_side, a), (piece_side, b))]
        if max(map(len, lengths)) > 1 << 16:
            raise ValueError("a vocabulary has ids over 65,535")
        self.lengths = spark.sparkContext.broadcast(lengths)  # one number an id
        bounded_batches(spark, 4)

    def events(self, docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
        """``row, doc_id, start, side, ids``: blocks of the end events of A (0) and B (1), each with the byte offset where its
        first token begins. A document without tokens has one empty block of each side."""
        a, b, name, lengths = self.a, self.b, self.name, self.lengths
        keyed = docs.select(F.monotonically_increasing_id().alias("row"), column(key).alias("doc_id"), F.coalesce(column(text), F.lit("")).alias("text"))
        kind = keyed.schema["doc_id"].dataType

        def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            coder = held_by_worker(name, lambda: Encoder(a, b))
            for batch in batches:
                at, starts, sides, blocks = [], [], [], []
                for i, both in enumerate(coder.encode(batch.column("text").to_pylist())):
                    for side, ids in enumerate(both):
                        start = 0
                        for first in range(0, max(len(ids), 1), BLOCK):
                            some = ids[first : first + BLOCK]
                            at.append(i)
                            starts.append(start)
                            sides.append(side)
                            blocks.append(some.tobytes())
                            start += int(lengths.value[side][some].sum())
                given = batch.take(pa.array(at, pa.int64()))
                yield pa.RecordBatch.from_arrays([given.column("row"), given.column("doc_id"), pa.array(starts, pa.int64()), pa.array(sides, pa.int32()), pa.array(blocks, pa.binary())], ["row", "doc_id", "start", "side", "ids"])

        return keyed.mapInArrow(coded, StructType([StructField("row", LongType()), StructField("doc_id", kind)]).add("start", "long").add("side", "integer").add("ids", "binary"))

    def swept(self, events: DataFrame) -> DataFrame:
        """One row a document: ``doc_id, n_a, n_b, n_groups, n_links, groups_sha256`` and its distinct links, each a number of the
        A id times 65,536 plus the B id, with their occurrences (packed, 4 bytes each)."""
        lengths = self.lengths

        def machine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            marks = held_by_worker("align marks", _marks)
            at, doc, sweep, out = None, None, None, []
            names, kinds = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"], [pa.int64()] * 4 + [pa.string(), pa.binary(), pa.binary()]

            def rows() -> pa.RecordBatch:
                columns = list(zip(*[r for _, r in out], strict=True))
                return pa.RecordBatch.from_arrays([pa.concat_arrays([d for d, _ in out]), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], ["doc_id", *names])

            for batch in batches:
                for i, (row, start, side, ids) in enumerate(zip(*[batch.column(c).to_pylist() for c in ("row", "start", "side", "ids")], strict=True)):
                    if row != at:
                        if sweep:
                            out.append((doc, sweep.row()))
                        at, doc, sweep = row, batch.column("doc_id").slice(i, 1), Sweep(marks)
                    if ids:
                        sweep.take(side, start, np.frombuffer(ids, np.uint16), lengths.value[side])
                    if len(out) >= 256:
                        yield rows()
                        out = []
            if sweep:
                out.append((doc, sweep.row()))
            if out:
                yield rows()

        dealt = events.repartition("row").sortWithinPartitions("row", "start", "side")
        schema = StructType([StructField("doc_id", events.schema["doc_id"].dataType)])
        for name in ("n_a", "n_b", "n_groups", "n_links"):
            schema = schema.add(name, "long")
        return dealt.mapInArrow(machine, schema.add("groups_sha256", "string").add("pairs", "binary").add("times", "binary"))

    def counts(self, swept: DataFrame) -> DataFrame:
        """``pair, n, best``: how many documents hold a link, and whether no link of its A id has more."""

        def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            parts, fresh = [], 0
            for batch in batches:
                for pairs in batch.column("pairs").to_pylist():
                    own = np.frombuffer(pairs, np.uint32)
                    parts.append((own, np.ones(len(own), np.int64)))
                    fresh += len(own)
                    if fresh >= HELD_PAIRS:
                        parts = [_summed(parts)]
                        fresh = 0
                        if len(parts[0][0]) >= HELD_PAIRS:
                            yield _pairs(*parts.pop())
            if parts:
                yield _pairs(*_summed(parts))

        def _pairs(pairs: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(pairs.astype(np.int64)), pa.array(n)], ["pair", "n"])

        each = reliable(swept.select("pairs").mapInArrow(counted, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")))
        a = F.shiftright("pair", 16)
        most = each.groupBy(a.alias("a")).agg(F.max("n").alias("most"))
        return each.join(most, a == F.col("a")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))

    def align(self, docs: DataFrame, text: str = "text", key: str = "doc_id", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
        """One row for each row of ``docs``: ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``.

        Null and empty texts, and those that a tokenizer does not spell byte for byte, have zeros and an empty digest. Rows that
        repeat an id, null ids too, are documents of their own; no other column is read, and an empty table gives no row.
        """
        swept = reliable(self.swept(self.events(docs, text, key)))
        counts = reliable(self.counts(swept))
        plain = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]
        if counts.count() <= broadcast_rows:
            table = counts.toArrow()  # at most broadcast_rows rows
            order = np.argsort(table.column("pair").to_numpy())
            held = self.spark.sparkContext.broadcast((table.column("pair").to_numpy()[order].astype(np.uint32), table.column("n").to_numpy()[order], table.column("best").to_numpy()[order]))

            @F.arrow_udf("struct<n_best: long, count_sum: long>")
            def read(pairs: pa.Array, times: pa.Array) -> pa.Array:
                known, n, best = held.value
                out = []
                for p, t in zip(pairs.to_pylist(), times.to_pylist(), strict=True):
                    at, t = np.searchsorted(known, np.frombuffer(p, np.uint32)), np.frombuffer(t, np.uint32).astype(np.int64)
                    out.append({"n_best": int(t[best[at]].sum()), "count_sum": int((n[at] * t).sum())})
                return pa.array(out, pa.struct([("n_best", pa.int64()), ("count_sum", pa.int64())]))

            return swept.withColumn("r", read("pairs", "times")).select(*plain, "r.n_best", "r.count_sum", "groups_sha256")
        return self._joined(swept, counts, plain)

    def _joined(self, swept: DataFrame, counts: DataFrame, plain: list[str]) -> DataFrame:
        """The same by a join of every document's distinct links."""

        def spelt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row, p, t in zip(*[batch.column(c).to_pylist() for c in ("row", "pairs", "times")], strict=True):
                    pairs, times = np.frombuffer(p, np.uint32).astype(np.int64), np.frombuffer(t, np.uint32).astype(np.int64)
                    for at in range(0, len(pairs), BLOCK):
                        n = len(pairs[at : at + BLOCK])
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, row, np.int64)), pa.array(pairs[at : at + BLOCK]), pa.array(times[at : at + BLOCK])], ["row", "pair", "times"])

        rows = reliable(swept.select(F.monotonically_increasing_id().alias("row"), "*"))
        links = rows.select("row", "pairs", "times").mapInArrow(spelt, "row long, pair long, times long").join(counts, "pair")
        sums = links.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("times")).alias("count_sum"))
        zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
        return rows.join(sums, "row", "left").select(*plain, zero("n_best"), zero("count_sum"), "groups_sha256")
