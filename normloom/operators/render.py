"""Text and SVG views of proof paths, evidence and validation reports, as string columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from normloom.functions import text as T

# The order of a path's nodes, its tree and the names of its edges, width of a character, least width of a box.
CANONICAL = ["provision", "obligation", "control", "asset", "evidence", "testasset"]
TREE = [(0, 1), (1, 2), (2, 3), (2, 4), (4, 5)]
RELATIONS = ["DERIVED_FROM", "MAPS_TO_CONTROL", "AFFECTS_ASSET", "SATISFIED_BY", "EVIDENCED_BY"]
_CHAR, _BOX = 7.2, 120
#: Room for the longest name of an edge between boxes, and the distance of the second row, on which the evidence stands.
_GAP, _ROW = 132, 80


#: What ``.`` of a regular expression does not match, and no character at all.
_NO_NAME = ["", "\n", "\r", "\u0085", "\u2028", "\u2029"]


def renderable(path: Column) -> Column:
    """Whether ``path`` holds six ``type:id`` entries in canonical order."""
    entry = lambda i, kind: (F.lower(F.substring(F.get(path, i), 1, len(kind) + 1)) == f"{kind}:") & ~F.substring(F.get(path, i), len(kind) + 2, 1).isin(_NO_NAME)
    held = F.size(path) == len(CANONICAL)
    for i, kind in enumerate(CANONICAL):
        held = held & F.coalesce(entry(i, kind), F.lit(False))
    return F.when(path.isNotNull(), held)


def _full(path: Column, i: int) -> Column:
    return F.get(path, i).substr(F.lit(len(CANONICAL[i]) + 2), F.length(F.get(path, i)))


def _width(shown: Column) -> Column:
    return F.greatest(F.lit(_BOX), (F.length(shown) * _CHAR + 24).cast("int"))


def _lefts(width: list[Column]) -> list[Column]:
    lefts = [F.lit(10)]
    for i in range(1, len(CANONICAL)):
        before = 2 if i in (3, 4) else i - 1
        lefts.append(lefts[before] + width[before] + _GAP)
    return lefts


def _places(width: list[Column]) -> list[Column]:
    """Of each box its left, the places of its text and of its right side and of what is written there, and its width, as strings."""
    return [x.cast("string") for left, w in zip(_lefts(width), width, strict=True) for x in (left, left + 8, left + w, left + w + 6, w)]


def _draw(full: list[Column], shown: list[Column], places: list[Column]) -> Column:
    """The picture from escaped names and places of its boxes."""
    low = lambda i: _ROW if i > 3 else 0
    left, inner, right, beside, width = (places[k::5] for k in range(5))
    parts = ['<svg xmlns="http://www.w3.org/2000/svg">']
    for (a, b), name in zip(TREE, RELATIONS, strict=True):
        parts += ['<line x1="', right[a], f'" y1="{30 + low(a)}" x2="', left[b], f'" y2="{30 + low(b)}"/><text x="', beside[a], f'" y="{24 + low(b)}">{name}</text>']
    for i in range(len(CANONICAL)):
        parts += ['<rect x="', left[i], f'" y="{10 + low(i)}" width="', width[i], '" height="40"><title>', full[i], '</title></rect><text x="', inner[i], f'" y="{35 + low(i)}">', shown[i], "</text>"]
    merged = [parts[0]]
    for part in [*parts[1:], "</svg>"]:
        merged[-1:] = [merged[-1] + part] if isinstance(part, str) and isinstance(merged[-1], str) else [merged[-1], part]
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in merged])


def svg(path: Column) -> Column:
    """A picture of a renderable path: a box for each node with its whole name as title, a named line for each edge of the
    fixed tree; evidence and test asset stand on a row of their own below the asset. Null for any other path. ``pictures``
    draws those of a table."""
    full = [_full(path, i) for i in range(len(CANONICAL))]
    shown = [T.short_label(x) for x in full]
    width = [_width(x) for x in shown]
    return F.when(renderable(path), _draw([T.xml_escape(x) for x in full], [T.xml_escape(x) for x in shown], _places(width)))


def pictures(rows: DataFrame, path: Column) -> DataFrame:
    """``rows`` plus ``renderable`` and ``svg`` of their ``path``.

    What several parts of a picture need, a name, its label, a width or a place, is a column of its own, made once a row; as one
    expression they would be made anew wherever they stand. The first name is null for any other path, and so is all made of it.
    """
    kept, six = rows.columns, range(len(CANONICAL))
    col = lambda letter, n=6: [F.col(f"_{letter}{i}") for i in range(n)]
    named = lambda letter, columns: [c.alias(f"_{letter}{i}") for i, c in enumerate(columns)]
    out = rows.withColumn("renderable", renderable(path))
    out = out.select(*kept, "renderable", *named("f", [F.when(F.col("renderable"), _full(path, 0)), *[_full(path, i) for i in six[1:]]]))
    out = out.select(*kept, "renderable", *col("f"), *named("t", map(T.short_label, col("f"))))
    out = out.select(*kept, "renderable", *named("f", map(T.xml_escape, col("f"))), *named("t", map(T.xml_escape, col("t"))), *named("w", map(_width, col("t"))))
    out = out.select(*kept, "renderable", *col("f"), *col("t"), *named("x", _places(col("w"))))
    return out.select(*kept, "renderable", _draw(col("f"), col("t"), col("x", 30)).alias("svg"))


def source_pane(text: Column, start: Column, end: Column) -> Column:
    """The text with ``>>>`` and ``<<<`` around the span."""
    return F.concat(F.substring(text, F.lit(1), start), F.lit(">>>"), F.substring(text, start + 1, end - start), F.lit("<<<"), F.substring(text, end + 1, F.length(text)))


def validation_panel(checks: Column) -> Column:
    return F.array_join(F.transform(checks, lambda c: F.concat(F.lit("["), c["status"], F.lit("] "), c["check_name"])), "\n")


def field_rows(record: Column, fields: list[str]) -> Column:
    """``field, value`` rows of a struct, for an editor; arrays are joined by commas."""
    return F.array(*[F.struct(F.lit(f).alias("field"), F.coalesce(record[f].cast("string"), F.lit("")).alias("value")) for f in fields])


def diff_preview(nodes: Column, edges: Column) -> Column:
    """Added nodes ``id, type`` and edges ``from, type, to`` as lines under their counts."""
    head = lambda what, items: F.concat(F.size(items).cast("string"), F.lit(f" {what}"))
    node = F.transform(nodes, lambda n: F.concat(F.lit("+ "), n["type"], F.lit(" "), n["id"]))
    edge = F.transform(edges, lambda e: F.concat(F.lit("+ "), e["from"], F.lit(" -"), e["type"], F.lit("-> "), e["to"]))
    return F.array_join(F.concat(F.array(head("nodes", nodes)), node, F.array(head("edges", edges)), edge), "\n")


def history_view(log: Column) -> Column:
    """A line for each decision ``at, actor, action, rationale`` of an ordered log."""
    return F.array_join(F.transform(log, lambda d: F.concat_ws(" | ", d["at"].cast("string"), d["actor"], d["action"], d["rationale"])), "\n")
