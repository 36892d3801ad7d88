import hashlib
import re
import unicodedata

from pyspark.sql import functions as F

from normloom.functions import text as T
from normloom.operators import parse


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column.alias("x")).first().x


def canonical(t):
    t = unicodedata.normalize("NFC", t).replace("\r\n", "\n").replace("\r", "\n")
    t = re.sub(r"\n{3,}", "\n\n", "\n".join(x.rstrip() for x in t.split("\n")))
    return t.strip("\n") + "\n"


def test_canonicalize_matches_python_and_is_idempotent(spark):
    texts = ["Harbour rules\r\n7. Boats moor\r\nat the quay.\n\n\n\n\nNight watch ends.\n", "é  \n\n\n\nb\t\r", "", "\n\n", "a  \nb", "x\x1c\ny"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.canonicalize(F.col("t")).alias("c"), T.canonicalize(T.canonicalize(F.col("t"))).alias("d")).collect()
    for r in rows:
        assert r.c == canonical(r.t) == r.d


def test_matches_are_finditer_offsets(spark):
    for pattern, t in ((T.ARTICLE, "é𝒳 Article\nArticle 21\nx\nArticle 8 (Fees, see Article 3)\n"), (T.PARAGRAPH, "1. a\n2. b é\n10. c")):
        got = one(spark, t, T.matches(F.col("t"), pattern))
        want = [(m.start(), m.end(), m[1]) for m in re.finditer("(?m)" + pattern[6:], t)]
        assert [tuple(x) for x in got] == want


def test_deadlines_conditions_exceptions(spark):
    assert tuple(one(spark, "within 30 days of 2024-01-02", T.deadline(F.col("t")))) == ("absolute_date", "2024-01-02", "2024-01-02")
    assert one(spark, "Within 72 hours", T.deadline(F.col("t"))).normalized_iso == "PT72H"
    assert one(spark, "within 6 months", T.deadline(F.col("t"))).normalized_iso == "P6M"
    assert one(spark, "soon", T.deadline(F.col("t"))) is None
    assert one(spark, "1. Where a is b, and where c., it shall.", T.conditions(F.col("t"))) == ["a is b", "c"]
    assert one(spark, "It shall, unless it is exempt.", T.exceptions(F.col("t"))) == ["it is exempt"]
    assert one(spark, "Article 1(1), Article 2 and Article 1(1)", T.related_articles(F.col("t"))) == ["Article 1(1)", "Article 2"]


def test_modal_orders_differ(spark):
    assert one(spark, "it may and should", T.detected_modal(F.col("t"))) == "may"
    assert one(spark, "it may and should", T.modality(F.col("t"))) == "should"
    assert one(spark, "it shall, go", T.detected_modal(F.col("t"))) is None


def test_extraction_quality(spark):
    got = one(spark, "The harbour ledger �� lists every mooring of the past season", T.extraction_quality(F.col("t")))
    assert got.confidence == 0.6 and got.warnings == ["replacement characters"]
    assert "hyphenated line breaks" in one(spark, "The oper-\nator shall comply", T.extraction_quality(F.col("t"))).warnings


def test_broken_words_need_the_dictionary(spark):
    docs = spark.createDataFrame([("a", "the oper\nator is"), ("b", "we can\nnot"), ("c", "plain")], "document_id string, canonical_text string")
    words = spark.createDataFrame([("operator",), ("can",), ("cannot",)], "word string")
    assert {r.document_id: r.broken for r in parse.broken_words(docs, words).collect()} == {"a": 1, "b": 0, "c": 0}
    assert {r.document_id: r.broken for r in parse.broken_words(docs, None).collect()} == {"a": 1, "b": 1, "c": 0}


def parsed(spark, text):
    docs = spark.createDataFrame([("doc_a", "v1", "NIS2", text)], "document_id string, source_version string, instrument string, canonical_text string")
    return docs, parse.parse(docs)


def test_parse_one_clause(spark):
    text = "Article 21\n1. The operator shall notify the competent authority within 30 days.\n"
    r = parsed(spark, text)[1].first()
    assert r.clause_id == "doc_a:v1:article-21/paragraph-1" and r.legal_semantics.actor == ["operator", "competent authority"]
    assert r.legal_semantics.deadline.normalized_iso == "P30D" and r.overall_status == "pass"
    assert text[r.char_start : r.char_end] == r.verbatim_text and r.source_evidence.evidence_hash == hashlib.sha256(r.verbatim_text.encode()).hexdigest()


def test_annex_ends_the_last_article_and_no_heading_gives_one_anchor(spark):
    docs, _ = parsed(spark, "Article 1\n1. It shall.\nAnnex I — Table\n2. x shall y\n")
    found = parse.anchors(docs).collect()
    assert max(a.char_end for a in found) == 23 and len(found) == 2
    docs, made = parsed(spark, "no heading, it shall stay\n")
    assert [(a.type, a.label, a.char_start, a.char_end) for a in parse.anchors(docs).collect()] == [("article", None, 0, 26)]
    assert made.count() == 0


def test_collisions(spark):
    docs, _ = parsed(spark, "Article 1\n1. a\nArticle 1\n1. b\n")
    assert sorted(r.anchor_id for r in parse.collisions(parse.anchors(docs)).collect()) == ["doc_a:v1:article-1", "doc_a:v1:article-1/paragraph-1"]
