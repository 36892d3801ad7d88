"""Text functions of the clause parser as column expressions; offsets count code points.

Patterns carry ``(?mdU)``: line anchors at line feeds only, Unicode classes.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Fixed values of the domain.
ACTORS = ["operator", "essential entity", "important entity", "competent authority", "CSIRT", "manufacturer", "provider"]
ARTICLE = r"(?mdU)^Article\s+(\d+[a-zA-Z]?)(?:\s*\(.*\))?\s*$"
PARAGRAPH = r"(?mdU)^(\d+)\.\s+"
ANNEX = r"(?mdU)^Annex\s+[IVXLCDM]+\b"
DETECTED = ["shall", "must", "may", "should"]
EXTRACTED = ["shall", "must", "should", "may"]
CONDITION = r"(?:^\d*\.?\s*|,\s+and\s+)[Ww]here\s+([^,]+)"
EXCEPTION = r"(?i)(?:unless|except(?:\s+where)?)\s+(.+?)(?:\.\s*$|\.$)"
RELATED = r"Article\s+\d+[a-zA-Z]?(?:\(\d+\))?"
ABSOLUTE = r"\b(\d{4})-(\d{2})-(\d{2})\b"
RELATIVE = r"(?i)within\s+(\d+)\s+(hour|day|month|year)s?"
ACTION_CHARS = 200
UNTRUSTED_START, UNTRUSTED_END = "<<<UNTRUSTED>>>", "<<<END>>>"
#: Matches whose offsets are summed in one fold.
BLOCK = 256


@F.arrow_udf(StringType())
def _nfc(texts: pa.Array) -> pa.Array:
    return pa.array([unicodedata.normalize("NFC", t) if t is not None else None for t in texts.to_pylist()], pa.string())


def canonicalize(text: Column) -> Column:
    """NFC, line feeds only, no blanks before them, at most one empty line in a row, one line feed at the end.

    Only texts beyond ASCII go through Python for NFC, which Spark lacks.
    """
    composed = F.when(text.rlike(r"[^\x00-\x7f]"), _nfc(text)).otherwise(text)
    return canonical_lines(composed)


def canonical_lines(text: Column) -> Column:
    """``canonicalize`` without NFC."""
    lines = F.regexp_replace(text, r"\r\n?", "\n")
    bare = F.regexp_replace(lines, r"(?U)[\s\x1c-\x1f&&[^\n]]+(\n|\z)", "$1")
    few = F.regexp_replace(bare, r"\n{3,}", "\n\n")
    return F.concat(F.regexp_replace(few, r"^\n+|\n+\z", ""), F.lit("\n"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once a row however often the body names it: a lambda's variable is not copied."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def matches(text: Column, pattern: str, group: int = 1) -> Column:
    """Every match in order as ``start, end, value``; ``value`` is the group. The pattern must not match nothing.

    Spark gives the pieces between matches and the matches; their running lengths are the offsets, summed block by block.
    """
    parts = F.struct(F.split(text, pattern, -1).alias("pieces"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("values"))
    spot = "start:int,end:int,value:string"

    def within(block: Column) -> Column:
        """``size`` of a block and its matches' places from its start."""
        zero = F.struct(F.lit(0).alias("size"), F.array().cast(f"array<struct<{spot}>>").alias("out"))

        def step(s: Column, x: Column) -> Column:
            start = s["size"] + x["gap"]
            end = start + x["width"]
            return F.struct(end.alias("size"), F.concat(s["out"], F.array(F.struct(start.alias("start"), end.alias("end"), x["value"].alias("value")))).alias("out"))

        return F.aggregate(block, zero, step)

    def placed(blocks: Column) -> Column:
        zero = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<array<struct<{spot}>>>").alias("out"))

        def step(s: Column, b: Column) -> Column:
            moved = F.transform(b["out"], lambda x: F.struct((x["start"] + s["at"]).alias("start"), (x["end"] + s["at"]).alias("end"), x["value"].alias("value")))
            return F.struct((s["at"] + b["size"]).alias("at"), F.concat(s["out"], F.array(moved)).alias("out"))

        return F.flatten(F.aggregate(blocks, zero, step, lambda s: s["out"]))

    def all_of(p: Column) -> Column:
        each = F.transform(p["found"], lambda m, i: F.struct(F.length(F.get(p["pieces"], i)).alias("gap"), F.length(m).alias("width"), F.get(p["values"], i).alias("value")))
        return let(each, lambda xs: placed(F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / BLOCK).cast("int")), lambda b: within(F.slice(xs, b * BLOCK + 1, BLOCK)))))

    none = F.array().cast(f"array<struct<{spot}>>")
    return let(parts, lambda p: F.when(F.size(p["found"]) > 0, all_of(p)).otherwise(none))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")


def collapse(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s+", " ")


def _first_modal(text: Column, order: list[str], default: str | None) -> Column:
    padded = F.concat(F.lit(" "), F.lower(text), F.lit(" "))
    found = F.lit(default).cast("string")
    for modal in reversed(order):
        found = F.when(F.contains(padded, F.lit(f" {modal} ")), F.lit(modal)).otherwise(found)
    return found


def detected_modal(text: Column) -> Column:
    """The first of shall, must, may, should that stands between spaces; null without one."""
    return _first_modal(text, DETECTED, None)


def modality(text: Column) -> Column:
    """The first of shall, must, should, may that stands between spaces; shall without one."""
    return _first_modal(text, EXTRACTED, "shall")


def norm_type(modal: Column) -> Column:
    return F.when(modal == "may", "permission").otherwise("obligation")


def actors(text: Column, vocabulary: list[str] = ACTORS) -> Column:
    found = F.filter(F.array(*map(F.lit, vocabulary)), lambda v: F.contains(F.lower(text), F.lower(v)))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("unspecified_actor")))


def action(text: Column) -> Column:
    return F.substring(strip(text), 1, ACTION_CHARS)


def conditions(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(collapse(text), F.lit(CONDITION), F.lit(1)), lambda x: F.regexp_replace(strip(x), r"\.+$", ""))


def exceptions(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(strip(collapse(text)), F.lit(EXCEPTION), F.lit(1)), strip)


def related_articles(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(RELATED), F.lit(0)))


def deadline(text: Column) -> Column:
    """``type, value, normalized_iso``: an absolute date before a period; null without either."""
    date, number, name = F.regexp_extract(text, ABSOLUTE, 0), F.regexp_extract(text, RELATIVE, 1), F.lower(F.regexp_extract(text, RELATIVE, 2))
    iso = F.when(name == "hour", F.concat(F.lit("PT"), number, F.lit("H"))).otherwise(F.concat(F.lit("P"), number, F.upper(F.substring(name, 1, 1))))
    parts = lambda kind, value, norm: F.struct(F.lit(kind).alias("type"), value.alias("value"), norm.alias("normalized_iso"))
    return F.when(date != "", parts("absolute_date", date, date)).when(number != "", parts("relative_period", F.regexp_extract(text, RELATIVE, 0), iso))


def clause_id(document_id: Column, version: Column, anchor_id: Column) -> Column:
    return F.concat_ws(":", document_id, version, F.regexp_replace(anchor_id, "^[^:]*:[^:]*:", ""))


def document_id(instrument: Column, version: Column, checksum: Column) -> Column:
    """Deterministic, so that a replay gives the same id."""
    return F.concat(F.lit("doc_"), F.substring(F.sha2(F.concat_ws("\x00", instrument, version, checksum), 256), 1, 12))


def node_name(name: Column) -> Column:
    return F.replace(F.lower(strip(name)), F.lit(" "), F.lit("_"))


def xml_escape(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def short_label(text: Column, chars: int = 20) -> Column:
    return F.when(F.length(text) > chars, F.concat(F.substring(text, 1, chars - 1), F.lit("…"))).otherwise(text)


def scoring_form(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def untrusted(text: Column, start: str = UNTRUSTED_START, end: str = UNTRUSTED_END) -> Column:
    return F.concat_ws("\n", F.lit(start), text, F.lit(end))


def safe_prompt(prompt: Column, start: str = UNTRUSTED_START, end: str = UNTRUSTED_END) -> Column:
    """Whether a system prompt is free of the marks around untrusted text."""
    return ~(F.contains(prompt, F.lit(start)) | F.contains(prompt, F.lit(end)))


def structural_path(clause_id: Column) -> Column:
    """``document_id, source_version, path`` of a clause or anchor id; null without all three."""
    parts = F.split(clause_id, ":", 3)
    return F.when(F.size(parts) == 3, F.struct(parts[0].alias("document_id"), parts[1].alias("source_version"), parts[2].alias("path")))


def canonical_json(record: Column) -> Column:
    """A map of texts as JSON with its keys in order."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(record))))


def extraction_quality(text: Column, words: Column | None = None) -> Column:
    """``confidence, warnings`` of extracted text: replacement characters, unprintables, hyphenation, broken words, short lines.

    ``words`` is the text's count of broken words that a dictionary confirms (``operators.parse.broken_words``);
    without it any line break inside a word counts.
    """
    kept = F.filter(F.split(text, "\n"), lambda x: strip(x) != "")
    mean = F.aggregate(kept, F.lit(0.0), lambda a, x: a + F.length(x)) / F.size(kept)
    unprintable = F.regexp_count(text, F.lit(r"[\p{C}\p{Zl}\p{Zp}\p{Zs}&&[^ \n\t]]")) / F.greatest(F.length(text), F.lit(1))
    broken = words > 0 if words is not None else text.rlike("[a-z]\n[a-z]")
    checks = [
        (F.contains(text, F.lit("�")), 0.4, "replacement characters"),
        (unprintable > 0.02, 0.3, "non-printable characters"),
        (text.rlike("[a-z]-\n[a-z]"), 0.15, "hyphenated line breaks"),
        (broken, 0.2, "broken words"),
        (F.coalesce(mean < 25, F.lit(False)), 0.15, "short lines"),
    ]
    lost = sum((F.when(c, F.lit(w)).otherwise(0.0) for c, w, _ in checks), F.lit(0.0))
    warnings = F.array_compact(F.array(*[F.when(c, F.lit(m)) for c, _, m in checks]))
    return F.struct(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.lit(1.0) - lost)).alias("confidence"), warnings.alias("warnings"))
