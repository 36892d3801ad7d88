"""Toxicity by a subsequence string kernel: a support vector machine on Nyström features of words.

The kernel of two words sums, over all sequences of three letters that stand in both in order but
not necessarily adjacent, a weight that shrinks with the letters spanned; letters put into an
insult or left out of it keep most of its value. Landmark words turn the kernel into features
(Nyström: kernel values to the landmarks, whitened by the landmarks' own kernel). A sentence or text
is as toxic as its worst word: training picks in each toxic text the word that shows it, fits
the machine against the words of clean texts and picks again; a logistic curve over whole texts
turns its margin into a score.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from normloom.llm.language_id import held_out
from normloom.llm.shared import bounded_batches, column, held_by_worker, packed, unpacked

#: Kernel: weight of a letter spanned, and the widest span of three letters.
DECAY, SPAN = 0.7, 7
#: Landmark words, labelled texts drawn of each class, rounds of picking words, threshold of a toxic score.
LANDMARKS, TRAINING_TEXTS, ROUNDS, TOXIC = 64, 1500, 3, 0.7
#: Bounds of training: words of clean texts that the machine is fitted on, those that resemble a landmark most, and
#: characters of a labelled text that are read, its first ones.
CLEAN_WORDS, TRAINING_CHARS = 20_000, 20_000
#: A token of more than LONG characters is read in windows of WINDOW characters that begin every STEP, as no space parts its words.
LONG, WINDOW, STEP = 48, 12, 6
#: Share of clean texts whose worst word a toxic text's must exceed to shape the logistic curve.
QUIET = 0.9
#: Bytes of words whose scores a worker keeps; beyond it the store is emptied. Characters of new words that are scored at once.
KEPT_BYTES, CHUNK_CHARS = 64 << 20, 1 << 16
_LETTERS = re.compile(r"[^\W\d_]+")
#: Letters set apart, as in "i d i o t" or "i.d.i.o.t".
_SPACED = re.compile(r"(?<![^\W_])(?:[^\W\d_][\s\-_.*]{1,2}){3,}[^\W\d_](?![^\W_])")
_LEET = str.maketrans("013457", "oieast")
#: A triple of letters is one number of three code points.
_POINT = 21
_OFFSETS = [(j, k) for k in range(2, SPAN) for j in range(1, k)]


def unit(token: str) -> str:
    """The letters of a token, digits inside a word read as the letters they resemble; at most empty."""
    if token.isalpha():
        return token
    letters = "".join(_LETTERS.findall(token))
    if len(letters) >= 3 and any(c.isdigit() for c in token):
        letters = "".join(_LETTERS.findall(token.translate(_LEET)))
    return letters


def tokens(text: str | None) -> tuple[set[str], list[str]]:
    """The distinct lower-case tokens of a whole text, words spelt with their letters apart among them, and apart from them its long tokens."""
    low = (text or "").lower()
    found = set(low.split())
    long = [t for t in found if len(t) > LONG]
    found.difference_update(long)
    found.update(word for m in _SPACED.finditer(low) if len(word := "".join(_LETTERS.findall(m.group()))) <= LONG)
    return found, long


def windows(token: str) -> Iterator[list[str]]:
    """The distinct windows of a long token, some thousands at a time."""
    starts = range(0, max(1, len(token) - WINDOW + STEP), STEP)
    for at in range(0, len(starts), 4096):
        yield sorted({token[i : i + WINDOW] for i in starts[at : at + 4096]})


def words_of(text: str | None) -> set[str]:
    """All words of a whole text of three letters and more, windows of long tokens among them."""
    short, long = tokens(text)
    return {u for u in map(unit, chain(short, *(w for t in long for w in windows(t)))) if len(u) >= 3}


def triples(words: list[str]):
    """Arrays ``word, triple, weight`` for each choice of offsets: the gapped triples of all words."""
    code = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    owner = np.repeat(np.arange(len(words)), [len(w) for w in words])
    for j, k in _OFFSETS:
        inside = np.flatnonzero(owner[:-k] == owner[k:]) if len(owner) > k else np.zeros(0, int)
        yield owner[inside], (code[inside] << 2 * _POINT) | (code[inside + j] << _POINT) | code[inside + k], DECAY ** (k + 1)


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse feature vectors of unit length: ``word, triple, value``, by word, each triple of a word once."""
    parts = list(triples(words))
    owner, triple = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    weight = np.repeat([p[2] for p in parts], [len(p[0]) for p in parts])
    order = _by_word(owner, triple, words)
    owner, triple, weight = owner[order], triple[order], weight[order]
    first = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (triple[1:] != triple[:-1])]) if len(owner) else np.zeros(0, int)
    value = np.add.reduceat(weight, first) if len(first) else weight
    owner, triple = owner[first], triple[first]
    norm = np.sqrt(np.bincount(owner, weights=value**2, minlength=len(words)))
    return owner, triple, value / norm[owner]


def _by_word(owner: np.ndarray, triple: np.ndarray, words: list[str]) -> np.ndarray:
    """The order by word and triple: by one number of both if it fits, as sorting by one number is faster than by two."""
    letters = np.unique(np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)).astype(np.int64)
    n = len(letters)
    if n**3 * len(words) >= 1 << 62:
        return np.lexsort((triple, owner))
    place, last = np.zeros(int(letters[-1]) + 1 if n else 1, np.int64), (1 << _POINT) - 1
    place[letters] = np.arange(n)
    number = (place[triple >> 2 * _POINT] * n + place[triple >> _POINT & last]) * n + place[triple & last]
    return np.argsort(owner * n**3 + number)


def _chunks(words: list[str]):
    """Slices of ``words`` of about ``CHUNK_CHARS`` letters, one word at least."""
    first, held = 0, 0
    for i, word in enumerate(words):
        held += len(word) + 1
        if held >= CHUNK_CHARS or i == len(words) - 1:
            yield slice(first, i + 1)
            first, held = i + 1, 0


@dataclass
class Machine:
    """``triples``: all triples of the landmarks, sorted; ``landmarks``: the landmarks' unit vectors over them, a column each;
    ``weights``: of the kernel values to the landmarks. ``floor`` is the margin of a word that shares no triple with any."""

    triples: np.ndarray
    landmarks: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    @property
    def floor(self) -> float:
        return self.bias

    @classmethod
    def of(cls, words: list[str]) -> Machine:
        owner, triple, value = features(words)
        known, place = np.unique(triple, return_inverse=True)
        landmarks = np.zeros((len(known), len(words)))
        landmarks[place, owner] = value
        return cls(known, landmarks, np.ones(len(words)), 0.0)

    def _shared(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``word, place, value`` of the triples that are also a landmark's."""
        owner, triple, value = features(words)
        at = np.minimum(np.searchsorted(self.triples, triple), max(0, len(self.triples) - 1))
        shared = np.flatnonzero(self.triples[at] == triple) if len(self.triples) else np.zeros(0, int)
        return owner[shared], at[shared], value[shared]

    def kernel(self, words: list[str]) -> np.ndarray:
        """The kernel of each word to each landmark."""
        out = np.zeros((len(words), self.landmarks.shape[1]))
        for some in _chunks(words):
            owner, place, value = self._shared(words[some])
            begins = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(owner) else np.zeros(0, int)
            if len(begins):
                out[some.start + owner[begins]] = np.add.reduceat(self.landmarks[place] * value[:, None], begins, axis=0)
        return out

    def margins(self, words: list[str]) -> np.ndarray:
        """The margin of each word. As the kernel is a product of feature vectors, the weighted sum of a word's kernels to all
        landmarks is one product with the weighted sum of theirs."""
        direction = self.landmarks @ self.weights
        out = np.full(len(words), self.bias)
        for some in _chunks(words):
            owner, place, value = self._shared(words[some])
            out[some] += np.bincount(owner, weights=value * direction[place], minlength=some.stop - some.start)
        return out

    def strongest(self, words: list[str]) -> np.ndarray:
        """The greatest kernel of each word to any landmark."""
        return np.concatenate([np.zeros(0), *(self.kernel(words[some]).max(axis=1, initial=0) for some in _chunks(words))])

    def score(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -30, 30)))


def _squared_hinge(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-5) -> np.ndarray:
    """Weights (the last is the bias) of a support vector machine with squared hinge loss, by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, damp = np.zeros(x.shape[1]), np.diag(np.r_[np.full(x.shape[1] - 1, ridge), 1e-6])
    for _ in range(30):
        on = y * (x @ w) < 1
        xa, wa = x[on], weight[on][:, None]
        new = np.linalg.solve(damp + xa.T @ (xa * wa), xa.T @ (wa[:, 0] * y[on]))
        if np.allclose(new, w, atol=1e-7):
            break
        w = new
    return w


def _logistic(margin: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve; targets are smoothed by the class sizes."""
    positive = label.sum()
    target = np.where(label, (positive + 1) / (positive + 2), 1 / (len(label) - positive + 2))
    x, w = np.c_[margin, np.ones(len(margin))], np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + 1e-6 * np.eye(2), x.T @ (target - p))
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return float(w[0]), float(w[1])


def fit(texts: list[str], labels: list[int]) -> Machine:
    """Train on labelled texts, on all words of toxic ones and the ``CLEAN_WORDS`` of clean ones that are nearest to a landmark. Without both classes, or without a telling word, every score is the share of toxic texts."""
    toxic = np.array(labels, bool)
    bags = [sorted(words_of(t)) for t in texts]
    seen = {c: Counter(u for bag, t in zip(bags, toxic, strict=True) if t == c for u in bag) for c in (True, False)}
    n_toxic, n_clean = int(toxic.sum()), int((~toxic).sum())
    share = lambda u: np.log((seen[True][u] + 0.1) / (n_toxic + 1)) - np.log((seen[False][u] + 0.1) / (n_clean + 1))
    telling = [u for u in sorted(seen[True], key=lambda u: (-seen[True][u] + 3 * seen[False][u], u)) if seen[True][u] >= 3 and share(u) > 1.5][:LANDMARKS]
    if not n_toxic or not n_clean or not telling:
        rate = (n_toxic + 1) / (len(toxic) + 2) if n_toxic and n_clean else 0.0
        return Machine(np.zeros(0, np.int64), np.zeros((0, 0)), np.zeros(0), 0.0, 0.0, float(np.log(rate / (1 - rate))) if rate else -30.0)
    machine = Machine.of(telling)
    own = machine.kernel(telling)
    values, vectors = np.linalg.eigh((own + own.T) / 2)
    kept = values > 1e-4 * values.max()
    whiten = vectors[:, kept] / np.sqrt(values[kept])
    all_units = list(dict.fromkeys(u for bag in bags for u in bag))
    index = {u: n for n, u in enumerate(all_units)}
    within = [[index[u] for u in bag] for bag in bags]
    strongest = machine.strongest(all_units)
    clean_rows = np.array(sorted({i for rows, t in zip(within, toxic, strict=True) if not t for i in rows}), int)
    clean_rows = clean_rows[np.argsort(-strongest[clean_rows], kind="stable")[:CLEAN_WORDS]]
    clean = machine.kernel([all_units[i] for i in clean_rows])
    worst = strongest + 0.1 * np.array([share(u) for u in all_units])
    # Landmarks with a strange letter put in count as toxic as well, so that the machine learns how much a gap may cost.
    broken = machine.kernel([u[:i] + c + u[i:] for u in telling for i in (len(u) // 2, len(u) - 1) for c in "xz" if seen[True][u] >= len(texts) / 100])
    for _ in range(ROUNDS):
        witness = [max(rows, key=lambda i: worst[i]) for rows, t in zip(within, toxic, strict=True) if t and rows]
        x = np.vstack([machine.kernel([all_units[i] for i in witness]), broken, clean])
        counts = (len(witness), len(broken), len(clean_rows))
        y = np.repeat([1.0, 1.0, -1.0], counts)
        weight = np.repeat([s / max(1, n) for s, n in zip((1, 1, 4), counts, strict=True)], counts)
        w = _squared_hinge(x @ whiten, y, weight)
        machine.weights, machine.bias = whiten @ w[:-1], float(w[-1])
        worst = machine.margins(all_units)
    margin = np.array([max([machine.floor, *(worst[i] for i in rows)]) for rows in within])
    # A text labelled toxic whose worst word is no worse than most clean texts' tells the curve nothing about words.
    shown = ~toxic | (margin > np.quantile(margin[~toxic], QUIET))
    machine.slope, machine.shift = _logistic(margin[shown], toxic[shown])
    return machine


class Scorer:
    def __init__(self, machine: Machine, kept: int = KEPT_BYTES):
        self.machine, self.margin, self.held, self.kept = machine, {}, 0, kept

    def _learn(self, new: list[str]) -> None:
        for some in _chunks(new):
            self.margin.update(zip(new[some], self.machine.margins([unit(t) for t in new[some]]).tolist(), strict=True))
        self.held += sum(map(len, new)) + 100 * len(new)

    def scores(self, texts: pa.Array) -> np.ndarray:
        worst = np.empty(len(texts))
        for at in range(0, len(texts), 64):
            both = [tokens(t.as_py()) for t in texts[at : at + 64]]
            bags = [short for short, _ in both]
            if self.held > self.kept:
                self.margin.clear()
                self.held = 0
            self._learn(list(set().union(*bags).difference(self.margin)))
            known = self.margin.__getitem__
            worst[at : at + len(bags)] = [max(map(known, bag), default=self.machine.floor) for bag in bags]
            for i, (_, long) in enumerate(both):
                for token in long:  # windows are scored and forgotten, however long the token
                    for some in windows(token):
                        worst[at + i] = max(worst[at + i], self.machine.margins([unit(w) for w in some]).max())
        return self.machine.score(np.maximum(worst, self.machine.floor))


def training_sample(docs: DataFrame, labels: DataFrame, key: str, text: str, texts: int = TRAINING_TEXTS, chars: int = TRAINING_CHARS) -> tuple[list[str], list[int]]:
    """About ``texts`` labelled texts of each class, drawn by a hash of the id, of each at most its first ``chars`` characters, so
    that the driver holds a bounded number of them; repeated labels count as toxic if one is."""
    marked = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(~held_out(F.col("doc_id"), 3, 1))
    rates = {r.toxic: texts / r.n for r in marked.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    draw = F.shiftrightunsigned(F.xxhash64("doc_id"), 33) / F.lit(2.0**31)
    drawn = marked.where(F.coalesce(*[F.when(F.col("toxic") == c, draw < r) for c, r in rates.items()], F.lit(False)))
    # The draw is bounded by the parameter, so it may be broadcast.
    rows = docs.select(column(key).alias("doc_id"), F.substring(column(text), 1, chars).alias("text")).join(F.broadcast(drawn), "doc_id").where("text is not null")
    found = [(r.text, r.toxic) for r in rows.select("text", "toxic").toLocalIterator()]
    return [t for t, _ in found], [int(c) for _, c in found]


def score_toxicity(docs: DataFrame, machine: Machine, text: str = "text") -> DataFrame:
    """``docs`` plus ``score`` (0 to 1) and ``predicted`` (1 from ``TOXIC`` on). Null and empty texts get the floor score.

    Tokens of any length are read whole, long ones in overlapping windows. Equal texts get equal scores, an empty table gives no
    row, and the added columns replace input columns of their names."""
    bounded_batches(docs.sparkSession)
    shared, name = docs.sparkSession.sparkContext.broadcast(machine), uuid4().hex

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(held_by_worker(name, lambda: Scorer(shared.value)).scores(texts))

    rows = packed(docs, text=column(text).cast("string")).select("row", score("text").alias("score"))
    return unpacked(rows.select("row", "score", (F.col("score") >= TOXIC).cast("int").alias("predicted")), docs.columns, ["score", "predicted"])


def judge(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Learn from labels that are not held out, then score every row: adds ``held_out, score, predicted``.

    A null id counts as empty text for the division and has no label; without labels every score is 0 but for rounding. Else as
    ``score_toxicity``."""
    machine = fit(*training_sample(docs, labels, key, text))
    made = score_toxicity(packed(docs, text=column(text), held_out=held_out(column(key), 3, 1)), machine)
    return unpacked(made, docs.columns, ["held_out", "score", "predicted"])
