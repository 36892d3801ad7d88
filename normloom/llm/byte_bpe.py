"""Byte-level BPE by merge replay over the distinct words of a slice of the corpus.

A task gathers the words of its texts that it has not yet encoded, lays their bytes out as one
linked sequence and keeps an inverted index from each mergeable token pair, filed under the rank of
the token it makes, to the positions where it stands. Merges are replayed in rank order over all of
these words at once; applying one looks only at its positions and files the two new neighbour pairs
of each. As words never interact, replaying slice by slice gives what one replay over the whole
corpus would, without a shuffle. A worker keeps the words it has encoded, up to a bound.
"""

from __future__ import annotations

import base64
from dataclasses import dataclass
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from normloom.llm.shared import bounded_batches, column, held_by_worker, packed, unpacked

#: Encoded words that a Python worker keeps; beyond it the store is emptied.
KEPT_WORDS = 200_000
#: Characters whose words are split at once (one text at least), and bytes of new words replayed at once (one word at least).
CHUNK_CHARS, CHUNK_BYTES = 1 << 19, 3 << 20
#: Marks of the linked sequence: between words, and where a token was merged into the one before.
_BETWEEN, _GONE = -1, -2


@dataclass(frozen=True)
class Vocabulary:
    """``tokens`` by rank; ``pairs``: each mergeable (left, right) as one sorted number, ``ranks``: of the token it makes."""

    tokens: list[bytes]
    pairs: np.ndarray
    ranks: np.ndarray


def read_ranks(path: str) -> list[bytes]:
    """The token of each rank from a rank file (a base64 token and its rank a line)."""
    with open(path, "rb") as lines:
        found = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, filter(None, lines.read().splitlines()))}
    if sorted(found) != list(range(len(found))):
        raise ValueError("ranks must be gapless from 0")
    return [found[i] for i in range(len(found))]


def vocabulary(tokens: list[bytes]) -> Vocabulary:
    rank = {t: i for i, t in enumerate(tokens)}
    made = {rank[t[:k]] << 32 | rank[t[k:]]: i for i, t in enumerate(tokens) for k in range(1, len(t)) if t[:k] in rank and t[k:] in rank}
    pairs = np.fromiter(made, np.int64, len(made))
    order = np.argsort(pairs)
    return Vocabulary(tokens, pairs[order], np.fromiter(made.values(), np.int32, len(made))[order])


class Replay:
    """A vocabulary, the pattern and the words encoded so far; one for each worker.

    ``number`` numbers the words; the ids of word i are ``count[i]`` entries of ``pool`` from ``begin[i]`` on.
    """

    def __init__(self, words: Vocabulary, pattern: str, kept: int = KEPT_WORDS):
        self.kept, self.pairs, self.ranks = kept, words.pairs, words.ranks
        self.rank = {t: i for i, t in enumerate(words.tokens)}
        self.single = np.array([self.rank[bytes([b])] for b in range(256)], np.int32)
        self.find = regex.compile(pattern).findall
        self.sizes = np.array([len(t) for t in words.tokens], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b"".join(words.tokens), np.uint8)
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.begin, self.count, self.pool = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of the tokens that the pairs make, -1 where there is none or a mark."""
        pair = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        return np.where(self.pairs[at] == pair, self.ranks[at], -1) if len(self.pairs) else np.full(len(pair), -1)

    def replay(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in a row, and their number for each word."""
        sizes = np.array([len(w) for w in words], np.int64)
        gaps = np.cumsum(np.r_[0, sizes + 1])
        token = np.full(int(gaps[-1]) + 1, _BETWEEN, np.int32)
        inside = np.ones(len(token), bool)
        inside[gaps] = False
        token[inside] = self.single[np.frombuffer(b"".join(words), np.uint8)]
        after, before = np.arange(1, len(token) + 1, dtype=np.int32), np.arange(-1, len(token) - 1, dtype=np.int32)
        index: dict[int, list[np.ndarray]] = {}
        order: list[int] = []

        def file(places: np.ndarray, ranks: np.ndarray) -> None:
            mergeable = np.flatnonzero(ranks >= 0)
            if not len(mergeable):
                return
            mergeable = mergeable[np.argsort(ranks[mergeable], kind="stable")]
            places, ranks = places[mergeable], ranks[mergeable]
            cuts = [0, *(np.flatnonzero(ranks[1:] != ranks[:-1]) + 1).tolist(), len(ranks)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                r = int(ranks[a])
                if r in index:
                    index[r].append(places[a:b])
                else:
                    index[r] = [places[a:b]]
                    heappush(order, r)

        file(np.arange(len(token) - 1, dtype=np.int32), self.merged(token[:-1], token[1:]))
        while order:
            r = heappop(order)
            filed = index.pop(r)
            at = filed[0] if len(filed) == 1 else np.unique(np.concatenate(filed))
            right = after[at]
            still = self.merged(token[at], token[right]) == r
            at, right = at[still], right[still]
            if len(at) > 1 and (chained := at[1:] == right[:-1]).any():
                # Of places that overlap in a chain every other one is merged, from the left.
                n = np.arange(len(at))
                first = np.maximum.accumulate(np.where(np.r_[False, chained], 0, n))
                chosen = (n - first) % 2 == 0
                at, right = at[chosen], right[chosen]
            if not len(at):
                continue
            beyond = after[right]
            token[at], token[right] = r, _GONE
            after[at], before[beyond] = beyond, at
            back = before[at]
            made = np.full(len(at), r, np.int32)
            file(np.concatenate([at, back]), self.merged(np.concatenate([made, token[back]]), np.concatenate([token[beyond], made])))
        ids = token[token != _GONE]
        ends = np.flatnonzero(ids == _BETWEEN)
        return ids[ids != _BETWEEN], np.diff(ends) - 1

    def learn(self, words: list[str]) -> None:
        """Encode the words numbered last into the store. A word that is a token stays whole, as no merge could add to it."""
        raw = [w.encode() for w in words]
        whole = [self.rank.get(w, -1) for w in raw]
        pool, count = [self.pool], [self.count]
        for some in _slices([1 if r >= 0 else len(w) for w, r in zip(raw, whole, strict=True)], CHUNK_BYTES):
            known = np.array(whole[some], np.int32)
            ids, sizes = self.replay([w for w, r in zip(raw[some], whole[some], strict=True) if r < 0])
            counts = np.ones(len(known), np.int64)
            counts[known < 0] = sizes
            own = np.empty(int(counts.sum()), np.int32)
            given = np.repeat(known, counts)
            own[given >= 0], own[given < 0] = known[known >= 0], ids
            pool.append(own)
            count.append(counts)
        self.pool, self.count = np.concatenate(pool), np.concatenate(count)
        self.begin = np.cumsum(self.count) - self.count

    def encode(self, texts: pa.Array) -> pa.ListArray:
        """The ids of each text: its words become numbers chunk by chunk, new ones are learned together, then ids are gathered."""
        if len(self.number) > self.kept:
            self.forget()
        plain = [t.as_py() or "" for t in texts]
        new: list[str] = []
        parts, words, number = [], np.zeros(len(plain), np.int64), self.number
        for some in _slices([len(t) for t in plain], CHUNK_CHARS):
            split = [self.find(t) for t in plain[some]]
            words[some] = [len(found) for found in split]
            fresh = list(set().union(*split).difference(number))
            number.update(zip(fresh, range(len(number), len(number) + len(fresh)), strict=True))
            new += fresh
            parts += [np.fromiter(map(number.__getitem__, found), np.int32, len(found)) for found in split]
        self.learn(new)
        said = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        counts = self.count[said]
        offsets = np.r_[0, np.cumsum(counts)][np.r_[0, np.cumsum(words)]].astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(_gathered(self.pool, self.begin[said], counts)))

    def decode(self, lists: pa.ListArray) -> pa.Array:
        offsets = lists.offsets.to_numpy().astype(np.int64)
        ids = lists.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
        sizes = self.sizes[ids]
        bounds = np.r_[0, np.cumsum(sizes)][offsets - offsets[0]].astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(bounds), pa.py_buffer(_gathered(self.flat, self.starts[ids], sizes))])


def _slices(sizes: list[int], most: int) -> list[slice]:
    """Slices whose sizes add up to about ``most``, one element at least."""
    out, first, held = [], 0, 0
    for i, size in enumerate(sizes):
        held += size
        if held >= most:
            out.append(slice(first, i + 1))
            first, held = i + 1, 0
    return [*out, slice(first, len(sizes))] if first < len(sizes) else out


def _gathered(pool: np.ndarray, begins: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The stretches of ``pool`` with these begins and lengths, one after the other."""
    ends = np.cumsum(counts)
    out = np.empty(int(ends[-1]) if len(ends) else 0, pool.dtype)
    for at in range(0, len(ends), 1 << 16):  # in blocks, so that the positions stay few
        width, last = counts[at : at + (1 << 16)], ends[at : at + (1 << 16)]
        first = int(last[0] - width[0])
        out[first : int(last[-1])] = pool[np.repeat(begins[at : at + (1 << 16)] - (last - width), width) + np.arange(first, int(last[-1]))]
    return out


class ByteBpe:
    """Encoder and decoder for a rank file. The file is read once, by the driver, and broadcast:
    its size is that of the vocabulary, whatever the corpus."""

    def __init__(self, spark, path: str, pattern: str):
        self.pattern, self.name = pattern, f"bpe {path} {pattern}"
        self.words = spark.sparkContext.broadcast(vocabulary(read_ranks(path)))
        bounded_batches(spark, 4)  # the numbers and ids of a batch take several times its text

    def encode(self, docs: DataFrame, text: str = "text", to: str = "ids") -> DataFrame:
        """``docs`` plus the token ids of each whole text, ``array<int>``; a null text counts as empty."""
        words, pattern, name = self.words, self.pattern, self.name

        @F.arrow_udf("array<int>")
        def ids(texts: pa.Array) -> pa.Array:
            return held_by_worker(name, lambda: Replay(words.value, pattern)).encode(texts)

        return unpacked(packed(docs, text=F.coalesce(column(text).cast("string"), F.lit(""))).select("row", ids("text").alias(to)), docs.columns, [to])

    def decode(self, docs: DataFrame, ids: str = "ids", to: str = "decoded") -> DataFrame:
        """``docs`` plus the bytes of each list of ids, ``binary``; a null list counts as empty."""
        words, pattern, name = self.words, self.pattern, self.name

        @F.arrow_udf("binary")
        def back(lists: pa.Array) -> pa.Array:
            return held_by_worker(name, lambda: Replay(words.value, pattern)).decode(lists)

        given = F.coalesce(column(ids), F.array().cast("array<int>"))
        return unpacked(packed(docs, ids=given).select("row", back("ids").alias(to)), docs.columns, [to])

    def round_trip(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """``docs`` plus ``ids`` and ``decoded``, as ``encode`` and then ``decode`` give them, in one pass of one worker a task."""
        words, pattern, name = self.words, self.pattern, self.name

        @F.arrow_udf("struct<ids: array<int>, decoded: binary>")
        def both(texts: pa.Array) -> pa.Array:
            replay = held_by_worker(name, lambda: Replay(words.value, pattern))
            ids = replay.encode(texts)
            return pa.StructArray.from_arrays([ids, replay.decode(ids)], ["ids", "decoded"])

        made = packed(docs, text=F.coalesce(column(text).cast("string"), F.lit(""))).select("row", both("text").alias("both"))
        return unpacked(made.select("row", "both.ids", "both.decoded"), docs.columns, ["ids", "decoded"])
