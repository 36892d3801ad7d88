"""Entity resolution: exact names first, then the most similar known name."""

from __future__ import annotations

from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from normloom.durable import reliable

#: Least Ratcliff-Obershelp ratio of a fuzzy match.
SIMILAR = 0.6


@F.arrow_udf(DoubleType())
def similarity(left: pa.Array, right: pa.Array) -> pa.Array:
    return pa.array([SequenceMatcher(None, a, b).ratio() if a is not None and b is not None else None for a, b in zip(left.to_pylist(), right.to_pylist(), strict=True)], pa.float64())


#: Names without a match of the first ratio are searched with the next; a match of a higher ratio leaves no better one to find.
TIERS = (0.9, 0.75)


def _numbered(forms: DataFrame, rarity: DataFrame) -> DataFrame:
    """``form, size, tokens``: the characters of each form as ``character, number of its occurrence``, rarest first, so that
    what two forms have in common is what their tokens have in common."""
    sorted_text = F.array_join(F.array_sort(F.regexp_extract_all("form", F.lit("(?s)."), F.lit(0))), "")
    runs = forms.select("form", F.explode(F.regexp_extract_all(sorted_text, F.lit(r"(?s)(.)\1*"), F.lit(0))).alias("run"))
    # One row a character of Unicode at most.
    ranked = runs.select("form", F.substring("run", 1, 1).alias("char"), F.length("run").alias("n")).join(F.broadcast(rarity), "char")
    held = ranked.groupBy("form").agg(F.array_sort(F.collect_list(F.struct("names", "char", "n"))).alias("runs"))
    every = F.flatten(F.transform("runs", lambda r: F.transform(F.reverse(F.sequence(F.lit(1), r["n"])), lambda k: F.concat(r["char"], k.cast("string")))))
    return held.select("form", F.length("form").alias("size"), every.alias("tokens"))


def similar_pairs(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """``form, known_form`` of all pairs that have enough characters in common for a ratio of ``least``.

    ``left`` and ``right`` are ``_numbered``. A ratio of r takes r * (a + b) / 2 common tokens, so neither size may fall
    short of that, and of both lists of tokens the first few, one more than may be missing, must meet. Sizes are
    met by classes that grow by a tenth; pairs that meet are then checked over all of their tokens.
    """
    size_class = lambda size: F.floor(F.log(size.cast("double")) / F.log(F.lit(1.1)) + 1e-9).cast("int")
    need = lambda a, b: F.ceil(least * (a + b) / 2 - 1e-9).cast("int")
    reach = (2 - least) / least

    def keys(df: DataFrame, own: str, other: str) -> DataFrame:
        low, high = F.greatest(F.ceil(F.col("size") / reach - 1e-9), F.lit(1)), F.floor(F.col("size") * reach + 1e-9)
        met = df.select("form", "size", "tokens", size_class(F.col("size")).alias(own), F.explode(F.sequence(size_class(low), size_class(high))).alias(other))
        smallest = F.floor(F.pow(F.lit(1.1), F.col(other))).cast("int")
        first = F.slice("tokens", 1, F.least(F.col("size"), F.greatest(F.col("size") - need(F.col("size"), smallest) + 1, F.lit(0))))
        return met.select("form", own, other, F.explode(first).alias("token"))

    met = keys(left, "a", "b").join(keys(right, "b", "a").withColumnRenamed("form", "known_form"), ["a", "b", "token"]).select("form", "known_form").distinct()
    both = met.join(left, "form").join(right.select(F.col("form").alias("known_form"), F.col("size").alias("known_size"), F.col("tokens").alias("known_tokens")), "known_form")
    return both.where(F.size(F.array_intersect("tokens", "known_tokens")) >= need(F.col("size"), F.col("known_size"))).select("form", "known_form")


def match_entities(names: DataFrame, known: DataFrame, least: float = SIMILAR) -> DataFrame:
    """``name, node_id, matched_name, match_type, confidence`` of each distinct name.

    ``known(node_id, name, ordinal)``. Names equal in trimmed lower case match exactly (the first known); any
    other takes the known name of the highest ratio of at least ``least``, ties to the first; else
    ``none``. Only pairs that ``similar_pairs`` leaves are compared; equal forms are compared once.
    """
    form = F.lower(F.regexp_replace("name", r"(?U)^\s+|\s+\z", ""))
    wanted = names.select("name").distinct().withColumn("form", form)
    first = known.withColumn("form", form).groupBy("form").agg(F.min_by(F.struct("node_id", "name", "ordinal"), "ordinal").alias("k"))
    held = reliable(first)
    exact = wanted.join(held, "form", "left")
    chars = held.select(F.explode(F.array_distinct(F.regexp_extract_all("form", F.lit("(?s)."), F.lit(0)))).alias("char"))
    rest = exact.where("k is null and form != ''").select("form").distinct()
    every = chars.groupBy("char").agg(F.count("*").alias("names"))  # a character that no known name has meets none
    strange = rest.select(F.explode(F.array_distinct(F.regexp_extract_all("form", F.lit("(?s)."), F.lit(0)))).alias("char")).distinct().join(every, "char", "left_anti").withColumn("names", F.lit(0).cast("long"))
    rarity = every.unionByName(strange)
    left, right = reliable(_numbered(rest, rarity)), reliable(_numbered(held.select("form"), rarity))
    found = None
    for tier in [*[t for t in TIERS if t > least], least]:
        open_left = left if found is None else left.join(found, "form", "left_anti")
        scored = similar_pairs(open_left, right, tier).withColumn("ratio", similarity("form", "known_form")).where(F.col("ratio") >= tier)
        best = scored.join(held.select(F.col("form").alias("known_form"), "k"), "known_form").groupBy("form").agg(F.min_by(F.struct("k.node_id", "k.name", "ratio"), F.struct(-F.col("ratio"), "k.ordinal")).alias("b"))
        found = reliable(best if found is None else found.unionByName(best))
    joined = exact.join(found, "form", "left")
    return joined.select(
        "name",
        F.coalesce("k.node_id", "b.node_id").alias("node_id"),
        F.coalesce("k.name", "b.name").alias("matched_name"),
        F.when(F.col("k").isNotNull(), "exact").when(F.col("b").isNotNull(), "fuzzy").otherwise("none").alias("match_type"),
        F.when(F.col("k").isNotNull(), 1.0).otherwise(F.coalesce("b.ratio", F.lit(0.0))).alias("confidence"),
    )


def reference_candidates(mentions: DataFrame, terms: DataFrame) -> DataFrame:
    """``mention, target_id, confidence``: a term equal to the mention (1.0), else the first term that contains it in
    lower case (0.6); other mentions are dropped. ``terms(term, target_id, ordinal)``.

    A containing term shares the mention's first three characters somewhere, so terms meet mentions on those.
    """
    wanted = mentions.select("mention").where("mention is not null").distinct()
    exact = wanted.join(terms.groupBy(F.col("term").alias("mention")).agg(F.min_by("target_id", "ordinal").alias("target_id")), "mention")
    rest = wanted.join(exact, "mention", "left_anti").select("mention", F.lower("mention").alias("low"))
    # Of terms equal in lower case only the first can be taken, so each text meets mentions once.
    held = terms.groupBy(F.lower("term").alias("text")).agg(F.min_by("target_id", "ordinal").alias("target_id"), F.min("ordinal").alias("ordinal"))
    gram = F.transform(F.sequence(F.lit(1), F.greatest(F.length("text") - 2, F.lit(1))), lambda i: F.substring(F.col("text"), i, F.lit(3)))
    long = rest.where("length(low) >= 3").withColumn("gram", F.substring("low", 1, 3)).join(held.withColumn("gram", F.explode(F.array_distinct(gram))), "gram").where(F.contains("text", "low"))
    letter = F.explode(F.array_distinct(F.split("text", "")))
    short = rest.where("length(low) in (1, 2)").withColumn("gram", F.substring("low", 1, 1)).join(held.withColumn("gram", letter), "gram").where(F.contains("text", "low"))
    part = long.unionByName(short).groupBy("mention").agg(F.min_by("target_id", "ordinal").alias("target_id"))
    return exact.withColumn("confidence", F.lit(1.0)).unionByName(part.withColumn("confidence", F.lit(0.6)))
