"""Language ID by prediction by partial matching: exact code lengths under frozen context trees.

For each language a variable-order tree holds how often each byte followed each
context of up to three bytes in labelled texts. A byte that a context has seen is coded with
its share there; any other costs an escape and is coded in the next shorter context, down to a
uniform one over all bytes (escape method C). The statistics are frozen after training, so the code length of a
byte depends only on itself and its context; a worker adds them up over the whole text, from sorted tables of the
contexts and bytes that training saw. The language with the shortest code is predicted.
"""

from __future__ import annotations

from dataclasses import dataclass
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from normloom.llm.shared import bounded_batches, column, held_by_worker, packed, reliable, unpacked

#: Bounds of training: labelled texts for each language (about; drawn by hash over all distinct labelled texts) and of all
#: languages together, which share them evenly if there are many, and characters of a text that are read, its first ones.
TRAINING_TEXTS, ALL_TEXTS, TRAINING_CHARS = 400, 25_600, 20_000
#: Longest context in bytes; with the byte after it, it makes one 32-bit number.
ORDER = 3
UNKNOWN = "und"
_CHUNK = 1 << 18


@dataclass(frozen=True)
class Trees:
    """``grams``: for each language the numbers of the context and byte at each place of its texts, once each, and their counts."""

    languages: tuple[str, ...]
    grams: tuple[tuple[np.ndarray, np.ndarray], ...]


def gram_numbers(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A number of each byte with the ``ORDER`` bytes before it (blanks before the start), and where each text starts."""
    flat = np.frombuffer(b"".join(b" " * ORDER + t for t in texts) or b"", np.uint8).astype(np.uint32)
    sizes = np.array([len(t) for t in texts], np.int64)
    number = np.zeros(max(0, len(flat) - ORDER), np.uint32)
    for back in range(ORDER, -1, -1):
        number = number << np.uint32(8) | flat[ORDER - back : len(flat) - back]
    own = np.repeat(np.arange(len(texts)) * ORDER, sizes) + np.arange(int(sizes.sum()))
    return number[own], np.cumsum(sizes) - sizes


def fit(samples: dict[str, list[bytes]]) -> Trees:
    """Count the trees of each language's samples."""
    languages = tuple(sorted(samples))
    return Trees(languages, tuple(np.unique(gram_numbers(samples[name])[0], return_counts=True) for name in languages))


def _found(sorted_numbers: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of each number in the sorted ones, and whether it is there."""
    at = np.minimum(np.searchsorted(sorted_numbers, numbers), max(0, len(sorted_numbers) - 1))
    return at, sorted_numbers[at] == numbers if len(sorted_numbers) else np.zeros(len(numbers), bool)


class Scorer:
    """For each language and context size the seen (context, byte) numbers with their bits, and the seen contexts with the
    bits of an escape from them. Tables grow with what training saw of their own language alone."""

    def __init__(self, trees: Trees):
        self.trees = trees
        self.tables = [[self._level(grams & np.uint32(256 ** (size + 1) - 1), counts) for size in range(ORDER + 1)] for grams, counts in trees.grams]

    @staticmethod
    def _level(grams: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        numbers, place = np.unique(grams, return_inverse=True)
        seen = np.bincount(place, weights=counts, minlength=len(numbers))
        contexts, context_of = np.unique(numbers >> np.uint32(8), return_inverse=True)
        total, kinds = np.bincount(context_of, weights=seen), np.bincount(context_of)
        return numbers, np.log2((total + kinds)[context_of] / seen).astype(np.float32), contexts, np.log2((total + kinds) / kinds).astype(np.float32)

    def _of_bytes(self, numbers: np.ndarray, language: int) -> np.ndarray:
        out = np.zeros(len(numbers), np.float32)
        left = np.arange(len(numbers))
        for size in range(ORDER, -1, -1):
            known, bits, contexts, escapes = self.tables[language][size]
            number = numbers[left] & np.uint32(256 ** (size + 1) - 1)
            at, there = _found(known, number)
            out[left[there]] += bits[at[there]]
            left, number = left[~there], number[~there]
            at, there = _found(contexts, number >> np.uint32(8))
            out[left[there]] += escapes[at[there]]
        out[left] += 8.0
        return out

    def bits(self, texts: list[bytes]) -> np.ndarray:
        """Code length of each text in each language, one language after the other over the distinct numbers of a stretch."""
        out, held, size, first = np.zeros((len(texts), len(self.trees.languages))), [], 0, 0
        for i, text in enumerate(texts):
            held.append(text)
            size += len(text)
            if size >= _CHUNK or i == len(texts) - 1:
                numbers, _ = gram_numbers(held)
                owner = np.repeat(np.arange(len(held)), [len(t) for t in held])
                for at in range(0, len(numbers), _CHUNK):
                    distinct, place = np.unique(numbers[at : at + _CHUNK], return_inverse=True)
                    whose = owner[at : at + _CHUNK]
                    begins = np.flatnonzero(np.r_[True, whose[1:] != whose[:-1]])
                    for k in range(out.shape[1]):
                        out[first + whose[begins], k] += np.add.reduceat(self._of_bytes(distinct, k)[place], begins, dtype=np.float64)
                held, size, first = [], 0, i + 1
        return out


def held_out(key: Column, parts: int, part: int) -> Column:
    """Rows that training must not see: ``crc32`` of the id as text has this remainder (a null id counts as empty text)."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % parts == part


def training_sample(labelled: DataFrame, text: str, lang: str, texts: int = TRAINING_TEXTS, every: int = ALL_TEXTS, chars: int = TRAINING_CHARS) -> dict[str, list[bytes]]:
    """About ``texts`` different texts of every labelled language, or as many as ``every`` has for each, drawn by a hash of the
    whole text; of each at most the first ``chars`` characters. Copies of a text count once, however many there are. A language of
    which by chance no text is drawn gives the one of the least hash."""
    usable = labelled.select(column(lang).alias("lang"), column(text).alias("text")).where(F.col("lang").isNotNull() & (F.length("text") > 0)).select("lang", F.xxhash64("text").alias("mark"), F.substring("text", 1, chars).alias("text"))
    counts = reliable(usable.select("lang", "mark").distinct().groupBy("lang").agg(F.count("*").alias("n"), F.min(F.struct(F.shiftrightunsigned("mark", 33).alias("draw"), "mark")).alias("least")))
    languages = counts.count()
    share = max(1, min(texts, every // max(1, languages)))
    shares = counts.select("lang", "n", F.col("least.mark").alias("least"))
    drawn = usable.join(F.broadcast(shares) if languages <= 100_000 else shares, "lang")
    drawn = drawn.where((F.shiftrightunsigned("mark", 33) / F.lit(2.0**31) < F.lit(share) / F.col("n")) | (F.col("mark") == F.col("least")))
    found: dict[str, list[bytes]] = {}
    for row in drawn.groupBy("lang", "mark").agg(F.min("text").alias("text")).toLocalIterator():
        found.setdefault(row.lang, []).append(row.text.encode())
    return found


def predict_language(docs: DataFrame, trees: Trees, text: str = "text") -> DataFrame:
    """``docs`` plus ``lang_pred`` and ``score``: the language with the shortest code and its probability,
    given these languages and equal chances before. Null and empty texts and others without a letter are ``und`` with
    score 0, as are all texts if nothing was learned. Ties go to the first language by name. Repeated rows get equal
    results, an empty table an empty one; the added columns replace input columns of their names."""
    bounded_batches(docs.sparkSession)
    shared, name = docs.sparkSession.sparkContext.broadcast(trees), uuid4().hex

    @F.arrow_udf("struct<lang: string, score: double>")
    def best(texts: pa.Array) -> pa.Array:
        scorer = held_by_worker(name, lambda: Scorer(shared.value))
        bits = scorer.bits([(t.as_py() or "").encode() for t in texts])
        chosen = bits.argmin(axis=1)
        score = 1 / np.exp2(np.minimum(0, bits.min(axis=1, keepdims=True) - bits)).sum(axis=1)
        return pa.StructArray.from_arrays([pa.array([scorer.trees.languages[i] for i in chosen], pa.string()), pa.array(score)], ["lang", "score"])

    rows = packed(docs, text=column(text).cast("string"))
    known = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)) if trees.languages else F.lit(False)
    made = rows.select("row", known.alias("known"), (best("text") if trees.languages else F.lit(None).cast("struct<lang: string, score: double>")).alias("best"))
    out = made.select("row", F.when(F.col("known"), F.col("best.lang")).otherwise(UNKNOWN).alias("lang_pred"), F.when(F.col("known"), F.col("best.score")).otherwise(0.0).alias("score"))
    return unpacked(out, docs.columns, ["lang_pred", "score"])


def identify(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Learn from the labelled rows that are not held out, then predict every row: adds ``held_out, lang_pred, score``.

    A null id counts as empty text for the division, a null label teaches nothing. Else as ``predict_language``."""
    apart = held_out(column(key), 4, 2)
    trees = fit(training_sample(docs.where(~apart), text, lang))
    made = predict_language(packed(docs, text=column(text), held_out=apart), trees)
    return unpacked(made, docs.columns, ["held_out", "lang_pred", "score"])
