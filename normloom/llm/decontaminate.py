"""Benchmark decontamination by spaced-seed hashing, with DataFrame functions only.

A seed is a mask over adjacent words that ignores some of them: two passages that differ by
a substituted word still agree on a mask that skips it. The hashes of all masked windows of the
benchmark are joined to those of every text. A window hit puts a benchmark item on a diagonal of a
text (text position less item position); around each such diagonal item and text are compared word
by word, and the overlap counts if it is long and nearly everywhere equal.

Before the join two tables of bounded size, flags of the benchmark's words and a bitmap of its
window hashes, leave out text windows that cannot hit. They are filters only: more benchmark items set more bits and let
more windows through to the join, with the same result.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from normloom.llm.shared import column, let, packed, reliable, unpacked, words

# Masks; a 1 is a word that must agree. All begin and end with 1. The first three are for items of LONG words
# and more: with up to a fifth of an item's words substituted one of them hits in each of the patterns that the tests draw.
SEEDS = ("11111", "110111", "11010011")
LONG = 8
#: For items of five to seven words, of which one may differ. Shorter items must stand word for word.
SHORT_SEEDS = ("111", "1101", "1011")
#: Parts into which the windows of each hash are dealt, so that a stock phrase's texts do not meet in one task.
SALTS = 16
#: An overlap counts if it has MIN_WORDS equal words in a stretch, or covers the item, with this share of equal words.
MIN_WORDS, SHARE = 13, 0.8
#: What an equal word's 1 is set against, so that stretches of ``SHARE`` have a sum of 0 or more.
OTHER = -4
#: Bounds of the bitmap in 64-bit parts (1 MB at most), and the most word flags.
MIN_PARTS, MAX_PARTS = 64, 1 << 17


def _probes(value: Column, parts: int, probes: int) -> list[tuple[Column, Column]]:
    """Part and bit of each probe of a 64-bit hash."""
    spots = [F.shiftrightunsigned(value, 21 * i).bitwiseAND(F.lit(parts * 64 - 1).cast("long")) for i in range(probes)]
    return [(F.shiftrightunsigned(s, 6).cast("int"), s.bitwiseAND(F.lit(63).cast("long")).cast("int")) for s in spots]


def _bitmap(values: DataFrame, parts: int, probes: int) -> Column:
    """The bitmap of the bigint column ``h`` as a constant array of ``parts`` longs.

    Spark gathers the bits; at most ``parts`` numbers, a fixed bound, come to the driver.
    """
    spots = values.select(F.explode(F.array(*[F.struct(p.alias("part"), b.alias("bit")) for p, b in _probes(F.col("h"), parts, probes)])).alias("spot"))
    found = spots.select("spot.*").groupBy("part").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit"))).alias("bits"))
    whole = [0] * parts
    for part, bits in found.collect():
        whole[part] = bits
    return F.split(F.lit(",".join(map(str, whole))), ",").cast("array<bigint>")


def _has(bitmap: Column, value: Column, parts: int, probes: int) -> Column:
    held = None
    for part, bit in _probes(value, parts, probes):
        one = F.call_function("shiftrightunsigned", F.get(bitmap, part), bit).bitwiseAND(F.lit(1).cast("long")) == 1
        held = one if held is None else held & one
    return held


def _word_flags(items: DataFrame, slots: int) -> Column:
    """A constant array of ``slots`` booleans: whether a word of the benchmark falls into the slot."""
    at = F.col("h").bitwiseAND(F.lit(slots - 1).cast("long")).cast("int")
    used = {r.at for r in items.select(F.explode("item").alias("h")).select(at.alias("at")).distinct().collect()}  # at most ``slots`` numbers
    return F.split(F.lit(",".join("1" if i in used else "0" for i in range(slots))), ",").cast("array<boolean>")


def _parts(n: int, per_value: int) -> int:
    """A power of two of 64-bit parts with at least ``per_value`` bits a value, within the bounds."""
    return min(MAX_PARTS, max(MIN_PARTS, 1 << max(0, (n * per_value // 64)).bit_length()))


def _window(hashes: Column, at: Column, number: int, seed: str) -> Column:
    return F.xxhash64(F.lit(number), *[F.get(hashes, at + i) for i, c in enumerate(seed) if c == "1"])


def _seeds(sizes: list[int]) -> list[tuple[str, int, int]]:
    """Mask, least and most words of the items it is for, given which sizes below LONG there are."""
    exact = [("1" * n, n, n) for n in sizes if n < 5]
    return [*((s, LONG, 1 << 30) for s in SEEDS), *((s, 5, LONG - 1) for s in SHORT_SEEDS if any(n >= 5 for n in sizes)), *exact]


def find_overlaps(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id") -> DataFrame:
    """Overlaps of texts with benchmark items: ``key, mark, item_id, equal_words, share, first_word, last_word``.

    One row for each text and item, its best overlap: ``equal_words`` words are the same from
    ``first_word`` to ``last_word`` of the text, ``share`` of those in the stretch. Of overlaps with as many equal words
    the one of the greater share is given, then the one that stands first in the text. Texts without an
    overlap have no row; rows that repeat both id and text share theirs, and items that repeat an id and a text theirs.
    ``mark`` is a hash of the text. Items of fewer than five words are found
    where all their words stand in order; items without words are never found. Null texts count as empty; an empty
    table on either side gives no row.
    """
    items = benchmark.select(column(item).alias("item_id"), F.transform(words(column(text)), lambda w: F.xxhash64(w)).alias("item")).where("size(item) > 0").distinct()
    sizes = sorted(r.n for r in items.where(F.size("item") < LONG).select(F.size("item").alias("n")).distinct().collect())  # at most LONG - 1 numbers
    seeds = _seeds(sizes)
    size = F.size("item")
    fits = lambda s, low, high: (size - len(s) >= F.col("at")) & size.between(low, high)
    windows = items.select("item_id", "item", F.posexplode("item").alias("at", "word")).select(
        "item_id", "at", size.alias("length"), F.explode(F.array(*[F.when(fits(*seed), _window(F.col("item"), F.col("at"), i, seed[0])) for i, seed in enumerate(seeds)])).alias("h")
    )
    windows = windows.where("h is not null")
    parts, slots = _parts(windows.count(), 96), min(MAX_PARTS, 64 * _parts(items.agg(F.coalesce(F.sum(F.size("item")), F.lit(0))).first()[0], 16))
    window_map, word_map = _bitmap(windows.select("h"), parts, 3), _word_flags(items, slots)
    none = F.array().cast("array<int>")

    def starts(known: Column, width: int) -> Column:
        """Places of a known word, from width 2 on followed by another."""
        every = F.when(F.size(known) >= width, F.sequence(F.lit(0), F.size(known) - width)).otherwise(none)
        return F.filter(every, lambda i: reduce(and_, [F.get(known, i + k) for k in range(width)]))

    def hits(hashes: Column, known: Column, begun: Column, held: Column, number: int, seed: str) -> Column:
        rest = [k for k, c in enumerate(seed) if c == "1" and k > 0]
        all_known = lambda i: reduce(and_, [F.coalesce(F.get(known, i + k), F.lit(False)) for k in reversed(rest)], F.lit(True))
        made = F.transform(F.filter(begun, all_known), lambda i: F.struct(i.alias("at"), _window(hashes, i, number, seed).alias("h")))
        return F.filter(made, lambda x: _has(held, x["h"], parts, 3))

    def all_hits(hashes: Column) -> Column:
        last = F.lit(slots - 1).cast("long")
        known = let(word_map, lambda held: F.transform(hashes, lambda h: F.get(held, h.bitwiseAND(last).cast("int"))))
        begins = [2 if s.startswith("11") else 1 for s, _, _ in seeds]
        each = lambda held, k, begun: F.concat(*[hits(hashes, k, F.get(begun, F.lit(begins[n] - 1)), held, n, s) for n, (s, _, _) in enumerate(seeds)])
        places = lambda k: F.array(starts(k, 1) if 1 in begins else none, starts(k, 2))
        return let(known, lambda k: let(places(k), lambda begun: let(window_map, lambda held: each(held, k, begun))))

    hashed = F.transform(words(column(text)), lambda w: F.xxhash64(w))
    probed = let(hashed, lambda hashes: F.struct(hashes.alias("hashes"), all_hits(hashes).alias("hits")))
    likely = docs.select(column(key).alias("key"), F.xxhash64(column(text)).alias("mark"), F.explode(F.array(probed)).alias("probed"))
    likely = reliable(likely.select("key", "mark", "probed.hashes", "probed.hits").where("size(hits) > 0"))
    # A window that very many texts hold is met by as many copies of its benchmark rows as there are salts.
    salted = windows.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salt = F.pmod(F.xxhash64("key", "mark"), F.lit(SALTS)).cast("int")
    joined = likely.select("key", "mark", salt.alias("salt"), F.explode("hits").alias("hit")).select("key", "mark", "salt", F.col("hit.at").alias("text_at"), F.col("hit.h").alias("h")).join(salted, ["h", "salt"])
    lines = joined.select(F.col("key").alias("line_key"), F.col("mark").alias("line_mark"), "item_id", "length", (F.col("text_at") - F.col("at")).alias("diagonal")).distinct()
    texts = likely.select("key", "mark", "hashes").dropDuplicates(["key", "mark"])
    # Only the words beside the item go on from here, not the whole text's.
    beside = F.slice("hashes", F.greatest(F.col("diagonal"), F.lit(0)) + 1, F.greatest(F.col("length") + F.least(F.col("diagonal"), F.lit(0)), F.lit(0)))
    pairs = texts.join(lines, [F.col("mark") == F.col("line_mark"), F.col("key").eqNullSafe(F.col("line_key"))]).select("key", "mark", "item_id", "length", "diagonal", beside.alias("beside"))
    pairs = pairs.join(items, (pairs.item_id.eqNullSafe(items.item_id)) & (pairs.length == F.size(items.item))).select("key", "mark", pairs.item_id, "diagonal", "beside", "item")
    skip = F.least(F.col("diagonal"), F.lit(0))
    same = pairs.select("key", "mark", "item_id", "diagonal", F.transform("item", lambda h, j: F.coalesce(F.when(j + skip >= 0, F.get(F.col("beside"), j + skip)) == h, F.lit(False))).alias("same"))
    verified = same.select("key", "mark", "item_id", "diagonal", F.explode(F.array(_best_stretch(F.col("same")))).alias("found"))
    share = F.col("found.equal") / (F.col("found.last") - F.col("found.first") + 1)
    good = verified.where("found is not null").select("key", "mark", "item_id", "diagonal", "found", share.alias("share"))
    best = good.groupBy("key", "mark", "item_id").agg(F.max(F.struct(F.col("found.equal").alias("equal"), "share", (-F.col("diagonal")).alias("back"), F.col("found.first").alias("first"), F.col("found.last").alias("last"))).alias("best"))
    return best.select("key", "mark", "item_id", F.col("best.equal").alias("equal_words"), "best.share", (F.col("best.first") - F.col("best.back")).alias("first_word"), (F.col("best.last") - F.col("best.back")).alias("last_word"))


def _best_stretch(same: Column) -> Column:
    """The stretch of the most equal words, then the fewest words, among all that count as overlap: ``equal, first, last``.

    With 1 for an equal word and ``OTHER`` for any other, a stretch has ``SHARE`` if its sum is 0 or more. Such a stretch
    of the most equal words begins where the sum so far is lower than at all earlier words and ends where the sum
    from there on is lower than at all later ones, so one pass over both lists finds it. Null if there is none.
    """
    stretch = lambda equal, first, last: F.struct(equal.cast("int").alias("equal"), first.cast("int").alias("first"), last.cast("int").alias("last"))

    def scan(s: Column, n: Column) -> Column:
        total = n + (F.size(s) - n) * OTHER
        ends = F.reverse(F.transform(_lows(F.reverse(s)), lambda x: F.struct((F.size(s) - 1 - x["at"]).alias("at"), (total - x["sum"]).alias("sum"), (n - x["equal"]).alias("equal"))))
        return let(F.struct(_lows(s).alias("starts"), ends.alias("ends")), lambda x: _widest(x["starts"], x["ends"], stretch))

    def found(s: Column, n: Column) -> Column:
        first, last = F.array_position(s, True) - 1, F.size(s) - F.array_position(F.reverse(s), True)
        counts = lambda equal: (equal >= MIN_WORDS) | (equal >= F.size(s) * SHARE)
        best = F.when(n + (last - first + 1 - n) * OTHER >= 0, stretch(n, first, last)).otherwise(scan(s, n))
        return F.when((n > 0) & counts(n), let(best, lambda x: F.when(counts(x["equal"]), x)))

    return let(same, lambda s: let(F.size(F.filter(s, lambda x: x)), lambda n: found(s, n)))


def _lows(same: Column) -> Column:
    """Equal words before which the sum is lower than before all earlier ones: ``at, sum, equal``, the last two up to the word."""
    spot = lambda at, total, equal: F.struct(at.alias("at"), total.alias("sum"), equal.alias("equal"))
    zero = F.lit(0)
    start = F.struct(spot(zero, zero, zero).alias("now"), F.lit(1).alias("least"), F.array().cast("array<struct<at:int,sum:int,equal:int>>").alias("lows"))

    def step(s: Column, x: Column) -> Column:
        now = s["now"]
        low = x & (now["sum"] < s["least"])
        after = spot(now["at"] + 1, now["sum"] + F.when(x, F.lit(1)).otherwise(F.lit(OTHER)), now["equal"] + x.cast("int"))
        return F.struct(after.alias("now"), F.when(low, now["sum"]).otherwise(s["least"]).alias("least"), F.when(low, F.concat(s["lows"], F.array(now))).otherwise(s["lows"]).alias("lows"))

    return F.aggregate(same, start, step, lambda s: s["lows"])


def _widest(starts: Column, ends: Column, stretch: Callable[[Column, Column, Column], Column]) -> Column:
    """The best pair of a start and an end of no lower sum. Sums fall along both lists, so neither place goes back."""
    start = F.struct(F.lit(0).alias("a"), F.lit(0).alias("b"), stretch(F.lit(0), F.lit(0), F.lit(0)).alias("best"))

    def step(s: Column, first: Column, last: Column) -> Column:
        fits, equal, best = F.coalesce(last["sum"] >= first["sum"], F.lit(False)), last["equal"] - first["equal"], s["best"]
        better = fits & ((equal > best["equal"]) | ((equal == best["equal"]) & (last["at"] - first["at"] <= best["last"] - best["first"])))
        return F.struct((s["a"] + (~fits).cast("int")).alias("a"), (s["b"] + fits.cast("int")).alias("b"), F.when(better, stretch(equal, first["at"], last["at"])).otherwise(best).alias("best"))

    steps = F.sequence(F.lit(1), F.size(starts) + F.size(ends))
    return F.aggregate(steps, start, lambda s, _: step(s, F.get(starts, s["a"]), F.get(ends, s["b"])), lambda s: s["best"])


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text overlaps no benchmark item, in the columns of ``docs``."""
    found = find_overlaps(docs, benchmark, key, text).select(F.col("key").alias("found_key"), F.col("mark").alias("found_mark")).distinct()
    rows = packed(docs, key=column(key), mark=F.xxhash64(column(text)))
    return unpacked(rows.join(found, [rows.mark == found.found_mark, rows.key.eqNullSafe(found.found_key)], "left_anti"), docs.columns)
