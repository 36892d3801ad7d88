"""Helpers that the training-data operators share: column packing, typed access, bounded batches."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from normloom.durable import reliable, shared_folder

__all__ = ["ascii_lower", "bounded_batches", "column", "held_by_worker", "let", "packed", "reliable", "shared_folder", "table", "unpacked", "words"]

#: Everything in ASCII but letters and digits parts words.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def bounded_batches(spark: SparkSession, megabytes: int = 8) -> None:
    """Bound Arrow batches by bytes as well as rows, so that long texts cannot fill a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(megabytes * 2**20))


_HELD: dict[str, Any] = {}


def held_by_worker(name: str, make: Callable[[], Any]) -> Any:
    """What a Python worker keeps between batches under ``name``. Workers outlive a query, so a new name
    drops what the last one held."""
    if name not in _HELD:
        _HELD.clear()
        _HELD[name] = make()
    return _HELD[name]


def column(name: str) -> Column:
    """A column by its exact name, dots and spaces included."""
    return F.col("`" + name.replace("`", "``") + "`")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once a row however often the body names it.

    The optimizer may merge projections and copy a column's expression to each of its uses; inside
    a lambda that would compute it again for every element. A lambda's variable is not copied.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def packed(df: DataFrame, **computed: Column) -> DataFrame:
    """The input row as one struct ``row`` beside computed columns, so that no name can clash."""
    return df.select(F.struct(*[column(c) for c in df.columns]).alias("row"), *[c.alias(n) for n, c in computed.items()])


def unpacked(df: DataFrame, columns: list[str], added: list[str] = ()) -> DataFrame:
    """Undo ``packed``; a computed column replaces an input column of its name (in any case)."""
    taken = {a.lower() for a in added}
    keep = [F.col("row")[c].alias(c) for c in columns if c.lower() not in taken]
    return df.select(*keep, *added)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text: Column) -> Column:
    """The words of a text in order, A-Z in lower case; a null text has none."""
    parts = F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS)
    head, tail = (F.get(parts, F.lit(0)) == "").cast("int"), (F.element_at(parts, -1) == "").cast("int")
    return F.slice(parts, head + 1, F.greatest(F.size(parts) - head - tail, F.lit(0)))
