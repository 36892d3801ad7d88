"""Documents to obligations: registration, anchors, detection, extraction, validation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from normloom.functions import text as T
from normloom.functions.contracts import contract


def anchors(docs: DataFrame) -> DataFrame:
    """Structural spans of ``docs(document_id, source_version, canonical_text)``: an article row before its paragraphs.

    ``anchor_id, type, label, char_start, char_end, parent_anchor_id, ordinal``. The first annex heading
    ends the last article; a text without an article heading is one anchor. All spans of a text are made in its own row.
    """
    text, none = F.col("canonical_text"), F.lit(None).cast("string")
    annex = F.regexp_instr("canonical_text", F.lit(T.ANNEX))
    base = docs.select("document_id", "source_version", "canonical_text", F.when(annex > 0, annex - 1).otherwise(F.length(text)).alias("ceiling"))
    span = lambda kind, label, path, start, end, parent: F.struct(F.lit(kind).alias("type"), label.alias("label"), path.alias("path"), start.cast("int").alias("char_start"), end.cast("int").alias("char_end"), parent.alias("parent"))

    def article(h: Column, end: Column) -> Column:
        path, name = F.concat(F.lit("article-"), h["value"]), F.concat(F.lit("Article "), h["value"])
        body = F.substring(text, h["end"] + 1, end - h["end"])
        inner = lambda marks: F.transform(marks, lambda m, i: span("paragraph", F.concat(name, F.lit("("), m["value"], F.lit(")")), F.concat(path, F.lit("/paragraph-"), m["value"]), h["end"] + m["start"], F.coalesce(h["end"] + F.get(marks, i + 1)["start"], end), path))
        return F.concat(F.array(span("article", name, path, h["start"], end, none)), T.let(T.matches(body, T.PARAGRAPH), inner))

    whole = F.array(span("article", none, F.lit("document"), F.lit(0), F.length(text), none))
    under = F.filter(T.matches(text, T.ARTICLE), lambda h: h["start"] < F.col("ceiling"))
    every = T.let(under, lambda hs: F.when(F.size(hs) == 0, whole).otherwise(F.flatten(F.transform(hs, lambda h, i: article(h, F.coalesce(F.get(hs, i + 1)["start"], F.col("ceiling")))))))
    ident = lambda path: F.when(path.isNotNull(), F.concat_ws(":", "document_id", "source_version", path))
    rows = base.select("document_id", "source_version", F.posexplode(every).alias("ordinal", "s"))
    return rows.select("document_id", "source_version", ident(F.col("s.path")).alias("anchor_id"), "s.type", "s.label", "s.char_start", "s.char_end", ident(F.col("s.parent")).alias("parent_anchor_id"), "ordinal")


def collisions(found: DataFrame) -> DataFrame:
    """Anchor ids that stand for more than one span, with the first and the last of them."""
    span = F.struct("char_start", "char_end")
    return found.groupBy("anchor_id").agg(F.count("*").alias("spans"), F.min(span).alias("first"), F.max(span).alias("last")).where("spans > 1").select("anchor_id", "spans", F.col("first.char_start").alias("first_start"), F.col("last.char_start").alias("last_start"))


def broken_words(docs: DataFrame, dictionary: DataFrame | None, key: str = "document_id", text: str = "canonical_text") -> DataFrame:
    """``key, broken``: line breaks inside words. With a dictionary (column ``word``) only where the joined word is
    in it and the left part is not.

    A text is cut into lines once; each break hands on the letters that end its line and those that begin the next, so
    both breaks around a line of one letter count.
    """
    # Only the last or first run of letters is looked at: what is not a letter before it is skipped in one step.
    ends = F.transform(F.split(F.col(text), "\n", -1), lambda x: F.struct(F.substring_index(F.regexp_replace(x, "[^a-z]", "\n"), "\n", -1).alias("tail"), F.regexp_extract(x, "^[a-z]*", 0).alias("head")))
    pairs = T.let(ends, lambda ls: F.filter(F.transform(ls, lambda x, i: F.struct(x["tail"].alias("left"), F.get(ls, i + 1)["head"].alias("right"))), lambda p: (p["left"] != "") & (F.coalesce(p["right"], F.lit("")) != "")))
    breaks = docs.select(key, F.explode_outer(pairs).alias("p"))
    parts = breaks.select(key, F.col("p").isNotNull().alias("hit"), F.col("p.left").alias("left"), F.concat("p.left", "p.right").alias("joined"))
    if dictionary is None:
        return parts.groupBy(key).agg(F.count_if("hit").alias("broken"))
    words = dictionary.select(F.lower("word").alias("word")).distinct()
    known = parts.join(words.select(F.col("word").alias("joined"), F.lit(True).alias("whole")), "joined", "left").join(words.select(F.col("word").alias("left"), F.lit(True).alias("part")), "left", "left")
    return known.groupBy(key).agg(F.count_if(F.col("hit") & F.col("whole").isNotNull() & F.col("part").isNull()).alias("broken"))


def register(batch: DataFrame, known: DataFrame) -> DataFrame:
    """Outcome of each row of ``batch(instrument, source_version, checksum, arrival)`` against ``known``
    documents and the rows before it: ``existing`` (200), ``conflict`` (409) or ``created`` (201).

    The first row of a document decides, so each task hands on one row a document and none is sorted. Rows of
    one document that arrive at once are ordered by checksum; of equal ones the first created is counted once by its place.
    """
    keys = ["instrument", "source_version"]
    held = known.groupBy(*keys).agg(F.min("checksum").alias("held"))
    first = batch.groupBy(*keys).agg(F.min(F.struct("arrival", "checksum")).alias("first"))
    # Grouping again by a further column leaves a layout that the join cannot reuse, so a document of very many rows can be split.
    heads = first.join(held, keys, "left").select(*[F.col(k).alias(f"head_{k}") for k in keys], "held", "first")
    seen = batch.join(heads, [F.col(k).eqNullSafe(F.col(f"head_{k}")) for k in keys], "left")
    head = F.coalesce("held", "first.checksum")
    is_first = F.struct("arrival", "checksum").eqNullSafe(F.col("first"))
    outcome = F.when(~head.eqNullSafe(F.col("checksum")), "conflict").when(F.col("held").isNotNull() | ~is_first, "existing").otherwise("created")
    return seen.select(*batch.columns, outcome.alias("outcome"), F.when(outcome == "created", 201).when(outcome == "existing", 200).otherwise(409).alias("status"))


def confidence_gate(texts: DataFrame, least: float = 0.5, text: str = "text") -> DataFrame:
    """``texts`` plus ``confidence, warnings, accepted``: what extraction with less confidence yields is refused."""
    judged = texts.withColumn("quality", T.extraction_quality(F.col(text)))
    return judged.select(*texts.columns, "quality.confidence", "quality.warnings", (F.col("quality.confidence") >= least).alias("accepted"))


def id_violations(obligations: DataFrame) -> DataFrame:
    """``clause_id, broken``: ids that stand for more than one record, and ids that do not begin with their document and version."""
    twice = obligations.groupBy("clause_id").agg(F.count("*").alias("n")).where("n > 1").select("clause_id", F.lit("repeated").alias("broken"))
    prefix = F.concat_ws(":", "document_id", "source_version", F.lit(""))
    return twice.unionByName(obligations.where(~F.coalesce(F.startswith("clause_id", prefix), F.lit(False))).select("clause_id", F.lit("prefix").alias("broken")))


def detect(spans: DataFrame, refine: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Paragraph spans with ``verbatim_text`` plus ``matched_modal, is_normative_candidate``; ``refine`` may revise them."""
    found = spans.where("type = 'paragraph'").withColumn("matched_modal", T.detected_modal(F.col("verbatim_text"))).withColumn("is_normative_candidate", F.col("matched_modal").isNotNull())
    return found.transform(refine) if refine else found


def decompose(detections: DataFrame) -> DataFrame:
    return detections.where("is_normative_candidate").withColumns({"span_id": F.concat("anchor_id", F.lit(":span-0")), "parent_span_id": F.lit(None).cast("string"), "method": F.lit("deterministic")})


#: Decisions that a record carries with it; the log of decisions has them all.
HISTORY = "array<struct<reviewer_id:string,timestamp:string,action:string,rationale:string>>"
#: Parts of an obligation object.
PARTS = ["identity", "source_evidence", "legal_semantics", "references", "governance"]


def extract(spans: DataFrame, vocabulary: list[str] = T.ACTORS) -> DataFrame:
    """Obligation objects: ``identity, source_evidence, legal_semantics, references, governance`` beside the span."""
    text = F.col("verbatim_text")
    act, obj = T.action(text), F.coalesce(F.nullif("label", F.lit("")), F.col("anchor_id"))
    none = F.lit(None).cast("string")
    clause = T.clause_id(F.col("document_id"), F.col("source_version"), F.col("anchor_id"))
    return spans.withColumns({
        "clause_id": clause,
        "identity": F.struct("document_id", "source_version", "instrument", clause.alias("clause_id"), F.lit("en").alias("language"), F.lit("EU").alias("jurisdiction"), F.lit("1.0.0").alias("schema_version")),
        "source_evidence": F.struct("anchor_id", "char_start", "char_end", "verbatim_text", F.sha2(text.cast("binary"), 256).alias("evidence_hash")),
        "legal_semantics": F.struct(
            T.norm_type(T.modality(text)).alias("norm_type"), T.actors(text, vocabulary).alias("actor"), T.modality(text).alias("modality"), act.alias("action"), obj.alias("object"), F.lit("EU").alias("scope"),
            none.alias("trigger"), T.deadline(F.concat(act, F.lit(" "), obj)).alias("deadline"), none.alias("frequency"), T.conditions(text).alias("conditions"), T.exceptions(text).alias("exceptions"),
        ),
        "references": F.struct(T.related_articles(text).alias("related_articles"), F.array().cast("array<string>").alias("resolved_target_ids")),
        "governance": F.struct(F.lit(False).alias("ambiguity_flag"), F.lit(True).alias("inference_flag"), F.lit("pending").alias("review_status"), F.create_map().cast("map<string,double>").alias("field_confidence"), F.array().cast(HISTORY).alias("revision_history")),
    })


def obligation_violations(obligations: DataFrame) -> Column:
    """Where each record breaks the contract of obligation objects: ``path, message``, in order."""
    kind = StructType([obligations.schema[p] for p in PARTS])
    return contract("obligation").violations(F.struct(*PARTS), kind)


def obligation_holds(obligations: DataFrame) -> Column:
    """Whether each record keeps the contract of obligation objects."""
    kind = StructType([obligations.schema[p] for p in PARTS])
    return contract("obligation").holds(F.struct(*PARTS), kind)


def validate(obligations: DataFrame, docs: DataFrame | None = None, known_anchors: DataFrame | None = None) -> DataFrame:
    """Adds ``checks`` (seven in fixed order), ``overall_status`` and ``review_status`` (escalated on a failure).

    Evidence is replayed from ``docs(document_id, source_version, canonical_text)``, or without them from the column
    ``canonical_text`` beside each record, which saves moving whole records.
    """
    rows = obligations
    if docs is not None:
        rows = rows.join(docs.select("document_id", "source_version", "canonical_text"), ["document_id", "source_version"], "left")
    sem, ev = F.col("legal_semantics"), F.col("source_evidence")
    replay = F.substring(F.col("canonical_text"), ev["char_start"] + 1, ev["char_end"] - ev["char_start"])
    missing = F.lit(0)
    if known_anchors is not None:
        # Only records that point somewhere meet the anchors; their counts are hashed, so records are not sorted for them.
        targets = obligations.select("clause_id", F.explode("references.resolved_target_ids").alias("anchor_id")).join(known_anchors.select("anchor_id"), "anchor_id", "left_anti")
        rows = rows.join(targets.groupBy("clause_id").agg(F.count("*").alias("unresolved")).hint("shuffle_hash"), "clause_id", "left")
        missing = F.coalesce("unresolved", F.lit(0))
    iso = sem["deadline"]["normalized_iso"]
    outcome = {
        "schema_validity": _passed(obligation_holds(rows)),
        "controlled_vocabulary": _passed(sem["modality"].isin(T.EXTRACTED) & sem["norm_type"].isin("obligation", "permission", "prohibition", "definition_only")),
        "evidence_span_fidelity": _passed((F.sha2(ev["verbatim_text"].cast("binary"), 256) == ev["evidence_hash"]) & ev["char_start"].isNotNull() & ev["char_end"].isNotNull() & (replay == ev["verbatim_text"])),
        "date_normalization": F.when(sem["deadline"].isNotNull() & iso.isNull(), "warn").otherwise("pass"),
        "quantity_normalization": F.lit("pass"),
        "reference_validity": _passed(missing == 0),
        "cross_field_consistency": F.when((sem["norm_type"] == "definition_only") & (F.size(sem["actor"]) > 0), "warn").when(F.size(sem["actor"]) == 0, "fail").otherwise("pass"),
    }
    checks = F.array(*[F.struct(F.lit(n).alias("check_name"), s.alias("status")) for n, s in outcome.items()])
    overall = overall_status(F.col("checks"))
    done = rows.withColumn("checks", checks).withColumn("overall_status", overall).withColumn("review_status", F.when(F.col("overall_status") == "fail", "escalated").otherwise("pending"))
    return done.drop("canonical_text", "unresolved")


def _passed(condition: Column) -> Column:
    return F.when(F.coalesce(condition, F.lit(False)), "pass").otherwise("fail")


#: Checks whose failure fails the record; another failed check asks for review, a warning does not.
HARD = ("schema_validity", "evidence_span_fidelity")


def overall_status(checks: Column) -> Column:
    hard = F.exists(checks, lambda c: (c["status"] == "fail") & c["check_name"].isin(*HARD))
    return F.when(hard, "fail").when(F.exists(checks, lambda c: c["status"] == "fail"), "needs_review").otherwise("pass")


def parse(docs: DataFrame) -> DataFrame:
    """Registered documents to validated obligations, one lazy plan."""
    spans = anchors(docs).join(docs.select("document_id", "source_version", "instrument", "canonical_text"), ["document_id", "source_version"])
    spans = spans.withColumn("verbatim_text", F.substring(F.col("canonical_text"), F.col("char_start") + 1, F.col("char_end") - F.col("char_start")))
    return validate(extract(decompose(detect(spans))))


def summary(validated: DataFrame, *by: str) -> DataFrame:
    """Counts of records by overall status and in total, for each combination of ``by``."""
    return validated.groupBy(*by).agg(F.count("*").alias("total"), *[F.count_if(F.col("overall_status") == s).alias(f"n_{s}") for s in ("pass", "needs_review", "fail")])
