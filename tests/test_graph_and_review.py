import datetime as dt
import json
import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from normloom.engine import Engine
from normloom.operators import evaluate, graph, parse, render, resolve, review
from normloom.sources.store import Conflict, Invalid, NotFound, Tables, envelope, read_artifacts, read_dictionary, read_labels, signature, verified
from normloom.streaming import requests

TEXT = "Article 21\n1. The operator shall notify the competent authority within 30 days.\n2. The operator may wait.\n"


def test_whole_life_of_a_document(spark, tmp_path):
    engine = Engine(spark, str(tmp_path))
    raw = spark.createDataFrame([("NIS2", "v1", TEXT, 1), ("NIS2", "v1", TEXT, 2), ("NIS2", "v1", "other", 3)], "instrument string, source_version string, text string, arrival int")
    assert sorted(r.status for r in engine.register_documents(raw).collect()) == [200, 201, 409]
    assert sorted(r.status for r in engine.register_documents(raw).collect()) == [200, 200, 409]
    counts = engine.parse("run1").first()
    assert (counts.total, counts.n_pass) == (2, 2)
    clauses = sorted(r.clause_id for r in engine.review_states().collect())
    now = dt.datetime(2024, 1, 1)
    log = "key string, decided timestamp, seq long, action string, rationale string"
    with pytest.raises(Conflict):
        engine.decide(spark.createDataFrame([(clauses[0], now, 1, "accept", " ")], log))
    engine.decide(spark.createDataFrame([(clauses[0], now, 1, "accept", "good"), (clauses[1], now, 2, "escalate", "unsure")], log))
    with pytest.raises(Conflict):
        engine.decide(spark.createDataFrame([(clauses[1], now, 3, "accept", "sure")], log))
    assert {r.clause_id: r.review_status for r in engine.review_states().collect()} == {clauses[0]: "accepted", clauses[1]: "escalated"}
    controls = spark.createDataFrame([(clauses[0], "c1", "control")], "clause_id string, control_id string, name string")
    engine.propose("cs1", controls=controls)
    assert engine.changeset_state("cs1") == "draft"
    for refused in (lambda: engine.approve("cs1"), lambda: engine.propose("cs1"), lambda: engine.propose("cs9", clauses=spark.createDataFrame([(clauses[1],)], "clause_id string"))):
        with pytest.raises(Conflict):
            refused()
    assert engine.validate_changeset("cs1").where("status = 'fail'").count() == 0 and engine.changeset_state("cs1") == "validated"
    with pytest.raises(Conflict):
        engine.publish("cs1", "snap_1", None)
    engine.approve("cs1")
    with pytest.raises(Conflict):
        engine.publish("cs1", "snap_1", None, "0.9.0")
    engine.publish("cs1", "snap_1", None)
    assert engine.changeset_state("cs1") == "published" and (engine.changeset_snapshot("cs1"), engine.snapshot_changeset("snap_1")) == ("snap_1", "cs1")
    for base in (None, "snap_1"):
        with pytest.raises(Conflict):
            engine.publish("cs1", "snap_2", base)
    with pytest.raises(Conflict):
        engine.validate_changeset("cs1")
    reports = engine.tables.read("reports")
    assert reports.count() == reports.select("run", "rule_name").distinct().count() == 6
    engine.propose("cs2", controls=controls)
    engine.validate_changeset("cs2")
    engine.approve("cs2")
    with pytest.raises(Conflict):
        engine.publish("cs2", "snap_2", None)
    engine.publish("cs2", "snap_2", "snap_1")
    assert engine.lineage("snap_2") == ["snap_2", "snap_1"] and {(r.snapshot_id, r.instrument) for r in engine.regulations().collect()} == {("snap_1", "NIS2"), ("snap_2", "NIS2")}
    paths = engine.proof_paths("snap_1", mode="optional").collect()
    assert len(paths) == 1 and paths[0].path_length == 3 and paths[0].review_status == "accepted"
    with pytest.raises(NotFound):
        engine.proof_paths("snap_9")
    with pytest.raises(NotFound):
        engine.render("snap_1", clauses[0])


NODE, EDGE = "changeset_id string, node_id string, type string", "changeset_id string, from_node_id string, to_node_id string, type string"


def test_constraint_rules_and_published_nodes(spark):
    nodes = spark.createDataFrame([("c", "o1", "Obligation"), ("c", "o2", "Obligation"), ("c", "p", "Provision"), ("c", "a", "Actor"), ("c", "e", "EvidenceRequirement"), ("d", "x", "Actor")], NODE)
    edges = spark.createDataFrame([("c", "o1", "p", "DERIVED_FROM"), ("c", "o1", "a", "IMPOSES_ON"), ("c", "o1", "gone", "MAPS_TO_CONTROL"), ("c", "e", "p", "EVIDENCED_BY")], EDGE)
    got = {(r.changeset_id, r.rule_name): (r.status, r.offending) for r in graph.check_constraints(nodes, edges).collect()}
    assert [got["c", rule][1] for rule in graph.RULES] == [1, 1, 1, 1, 1, 1] and all(got["d", rule][0] == "pass" for rule in graph.RULES)
    published = spark.createDataFrame([("c", "gone", "Control")], NODE)
    got = {r.rule_name: r.offending for r in graph.check_constraints(nodes, edges, published).where("changeset_id = 'c'").collect()}
    assert [got[rule] for rule in graph.RULES] == [1, 1, 0, 1, 0, 1]


def test_proof_path_modes_keep_branches_apart(spark):
    nodes = spark.createDataFrame([("s", n, t) for n, t in (("o", "Obligation"), ("p", "Provision"), ("c", "Control"), ("a1", "Asset"), ("a2", "Asset"), ("e", "EvidenceRequirement"), ("t", "TestAsset"))], NODE.replace("changeset", "snapshot"))
    rows = [("s", "o", "p", "DERIVED_FROM"), ("s", "o", "c", "MAPS_TO_CONTROL"), ("s", "c", "a1", "AFFECTS_ASSET"), ("s", "c", "a2", "AFFECTS_ASSET"), ("s", "c", "e", "SATISFIED_BY")]
    edges = spark.createDataFrame(rows, EDGE.replace("changeset", "snapshot"))
    assert graph.proof_paths(nodes, edges).count() == 0
    assert [r.path_length for r in graph.proof_paths(nodes, edges, "optional").collect()] == [5, 5]
    edges = spark.createDataFrame([*rows, ("s", "e", "t", "EVIDENCED_BY")], EDGE.replace("changeset", "snapshot"))
    assert [r.path_length for r in graph.proof_paths(nodes, edges).collect()] == [6, 6]
    assert graph.coverage(nodes, edges).first()[1:] == (1, 1)


def test_chains_end_at_dangling_parents(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", None), ("x", "gone")], "node string, parent string")
    assert {r.node: (r.root, r.hops) for r in graph.chains(links).collect()} == {"a": ("c", 2), "b": ("c", 1), "c": ("c", 0), "x": ("gone", 1)}


def test_chains_of_any_length_and_cycles(spark):
    long = [(f"n{i}", f"n{i + 1}" if i < 199 else None) for i in range(200)]
    links = spark.createDataFrame([*long, ("a", "b"), ("b", "c"), ("c", "b"), ("s", "s")], "node string, parent string")
    got = {r.node: (r.root, r.hops) for r in graph.chains(links).collect()}
    assert got == {f"n{i}": ("n199", 199 - i) for i in range(200)} | dict.fromkeys("abcs", (None, None))
    loop = spark.createDataFrame([("a", "b"), ("b", "a")], "node string, parent string")
    assert {tuple(r) for r in graph.chains(loop).collect()} == {("a", None, None), ("b", None, None)} and graph.chains(loop.limit(0)).count() == 0


def test_article_history_of_many_versions_and_cycles(spark):
    anchors = [("NIS2", f"v{i}", "a1", f"v{i}:a1") for i in range(30) if i != 5] + [("DORA", v, "a1", f"{v}:a1") for v in "xyzs"]
    older = [("NIS2", f"v{i}", f"v{i - 1}") for i in range(1, 30)] + [("DORA", a, b) for a, b in ("xy", "yz", "zx", "ss")]
    rows = graph.article_history(spark.createDataFrame(anchors, "instrument string, source_version string, path string, anchor_id string"), spark.createDataFrame(older, "instrument string, source_version string, older_version string")).collect()
    want = [(f"v{i}:a1", i - j, f"v{j}:a1") for low, high in ((0, 5), (6, 30)) for i in range(low, high) for j in range(low, i)]
    want += [(f"{a}:a1", n, f"{b}:a1") for a, n, b in (("x", 1, "y"), ("x", 2, "z"), ("y", 1, "z"), ("y", 2, "x"), ("z", 1, "x"), ("z", 2, "y"))]
    assert sorted((r.anchor_id, r.hops, r.older_anchor_id) for r in rows) == sorted(want)


def test_entities(spark):
    known = spark.createDataFrame([("n1", "Operator", 1), ("n2", "Operators", 2), ("n3", "CSIRT", 3)], "node_id string, name string, ordinal int")
    got = {r.name: (r.node_id, r.match_type, round(r.confidence, 6)) for r in resolve.match_entities(spark.createDataFrame([(" operator ",), ("operatorx",), ("zzz",), ("",)], "name string"), known).collect()}
    assert got == {" operator ": ("n1", "exact", 1.0), "operatorx": ("n1", "fuzzy", 0.941176), "zzz": (None, "none", 0.0), "": (None, "none", 0.0)}


def test_similarity_join_equals_all_pairs(spark):
    random.seed(8)
    parts = ["operator", "essential", "entity", "authority", "national", "team", "provider", "maker", "digital", "service", "bank", "cloud", "é", "ltd", "of", "gmbh", "x1", "grid"]
    name = lambda: " ".join(random.choice(parts) for _ in range(random.randrange(1, 5)))
    blur = lambda n: "".join(c for c in n if random.random() > 0.15) + random.choice(["", "s", " ag"])
    known = [(f"n{i}", name() if i % 9 else "".join(random.choice("abcdefgh\n") for _ in range(i % 40)), i) for i in range(150)]
    names = sorted({blur(random.choice(known)[1]) for _ in range(200)} | {name() for _ in range(100)} | {"", "q", "zzzz", "Operator ", "\u2003bank"})
    got = {r.name: r for r in resolve.match_entities(spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame(known, "node_id string, name string, ordinal int")).collect()}
    form = lambda n: n.strip().lower()
    for n in names:
        same = [k for k in known if form(k[1]) == form(n)]
        ratios = [(SequenceMatcher(None, form(n), form(k[1])).ratio(), -k[2]) for k in known]
        best = max(ratios)
        want = (same[0][0], "exact", 1.0) if same else (f"n{-best[1]}", "fuzzy", best[0]) if best[0] >= 0.6 and form(n) else (None, "none", 0.0)
        assert (got[n].node_id, got[n].match_type, got[n].confidence) == want, n


def test_few_pairs_of_a_vocabulary_are_compared(spark):
    """10,000 names of random syllables by 1,000 known ones."""
    random.seed(4)
    syllables = [a + b + c for a in "bcdfghklmnprstvz" for b in "aeiouy" for c in ("", "n", "r", "s", "l")]
    name = lambda: "".join(random.choice(syllables) for _ in range(random.randrange(3, 9)))
    known, names = sorted({name() for _ in range(1000)}), sorted({name() for _ in range(10000)})
    frame = lambda forms: spark.createDataFrame([(f,) for f in forms], "form string")
    rarity = frame([f for f in known + names]).select(F.explode(F.array_distinct(F.split("form", ""))).alias("char")).groupBy("char").agg(F.count("*").alias("names"))
    left, right = resolve._numbered(frame(names), rarity), resolve._numbered(frame(known), rarity)
    for least, share in ((0.9, 0.001), (0.75, 0.05)):
        assert resolve.similar_pairs(left, right, least).count() < share * len(known) * len(names)


def test_set_scores_and_overlap(spark):
    row = spark.range(1).select(evaluate.set_scores(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"), F.lit("c"), F.lit("b"))).alias("s"), evaluate.set_scores(F.array().cast("array<string>"), F.array().cast("array<string>")).alias("e")).first()
    assert tuple(row.s) == (0.5, 0.5, 0.5) and tuple(row.e) == (1.0, 1.0, 1.0)


def test_svg_only_for_canonical_paths(spark):
    good = [f"{k}:{k}1&" for k in render.CANONICAL]
    df = spark.createDataFrame([(good,), (good[:5],), (good[::-1],), (None,)], "p array<string>")
    got = [r.s for r in df.select(render.svg(F.col("p")).alias("s")).collect()]
    assert got[0].count("<rect") == 6 and got[0].count("<line") == 5 and "&amp;" in got[0] and got[1:] == [None, None, None]


def test_artifacts_and_signature(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("é".encode())
    (tmp_path / "b.exe").write_bytes(b"x")
    (tmp_path / "c.txt").write_bytes(b"\xff\xfe")
    got = {r.path[-5:]: (r.outcome, r.text) for r in read_artifacts(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": ("accepted", "é"), "b.exe": ("unsupported_type", None), "c.txt": ("invalid_utf8", None)}
    assert verified("m", b"k", signature("m", b"k")) and not verified("m", b"k", signature("n", b"k"))


def test_streamed_limit_equals_batch(spark, tmp_path):
    rows = [("a", dt.datetime(2024, 1, 1, 0, 0, s)) for s in range(0, 50, 5)] + [("b", dt.datetime(2024, 1, 1, 0, 1, 0))]
    df = spark.createDataFrame(rows, "client string, ts timestamp")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    kept = []
    requests.ingest(requests.sessions(stream), lambda batch, _: kept.extend(batch.collect()), str(tmp_path / "check")).awaitTermination()
    q = requests.limited(stream, limit=5).writeStream.format("memory").queryName("limited_hits").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {tuple(r) for r in spark.table("limited_hits").collect()}
    assert got == {tuple(r) for r in requests.limited(df, limit=5).collect()} and any(not r[3] for r in got)


def test_latest_and_rate(spark):
    rows = spark.createDataFrame([("k", 1, "x"), ("k", 3, "z"), ("k", 2, "y"), ("l", 1, None)], "key string, at int, v string")
    assert {r.key: r.v for r in review.latest_per(rows, "key", "at").collect()} == {"k": "z", "l": None}


RAW = "instrument string, source_version string, text string, arrival int"
LOG = "key string, decided timestamp, seq long, action string, rationale string"


def accepted_engine(spark, tmp_path):
    engine = Engine(spark, str(tmp_path))
    engine.register_documents(spark.createDataFrame([("NIS2", "v1", TEXT, 1)], RAW))
    engine.parse("run1")
    clauses = sorted(r.clause_id for r in engine.review_states().collect())
    engine.decide(spark.createDataFrame([(c, dt.datetime(2024, 1, 1), i, "accept", "good") for i, c in enumerate(clauses)], LOG))
    return engine, clauses


def test_successive_batches_are_created_and_counted(spark, tmp_path):
    engine = Engine(spark, str(tmp_path))
    for version, changed in (("v1", TEXT), ("v2", TEXT.replace("30", "10")), ("v3", TEXT.replace("30", "20"))):
        assert [r.outcome for r in engine.register_documents(spark.createDataFrame([("NIS2", version, changed, 1)], RAW)).collect()] == ["created"]
        assert [(r.instrument, r.total) for r in engine.parse(version).collect()] == [("NIS2", 2)]
    assert engine.tables.read("documents").count() == 3 and engine.tables.read("revisions").count() == 6


def test_broken_off_publication_leaves_nothing(spark, tmp_path, monkeypatch):
    engine, _ = accepted_engine(spark, tmp_path)
    engine.propose("cs1")
    engine.validate_changeset("cs1")
    engine.approve("cs1")
    real = engine.tables.commit
    monkeypatch.setattr(engine.tables, "commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        engine.publish("cs1", "snap_1", None)
    assert engine.tables.head() is None
    monkeypatch.setattr(engine.tables, "commit", real)
    engine.publish("cs1", "snap_1", None)
    nodes = engine.tables.snapshot("snap_nodes", "snap_1")
    assert nodes.count() == nodes.select("node_id").distinct().count() > 0
    with pytest.raises(Conflict):
        engine.tables.commit("snapshots", f"{1:012d}", {})
    with pytest.raises(Conflict):
        engine.approve("cs1")
    assert engine.tables.read("reports").count() == 6 and not [f for f in (tmp_path / "snapshots").iterdir() if f.name.startswith("_")]


def test_a_status_set_by_validation_blocks_review(spark, tmp_path):
    engine = Engine(spark, str(tmp_path))
    engine.register_documents(spark.createDataFrame([("NIS2", "v1", TEXT, 1)], RAW))
    real = parse.extract
    shift = lambda spans, *a: real(spans, *a).withColumn("source_evidence", F.col("source_evidence").withField("char_start", F.when(F.endswith("anchor_id", F.lit("-1")), 0).otherwise(F.col("source_evidence.char_start"))))
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(parse, "extract", shift)
        engine.parse("run1")
    states = {r.clause_id: r.review_status for r in engine.review_states().collect()}
    bad, good = sorted(states)
    assert (states[bad], states[good]) == ("escalated", "pending")
    say = lambda *rows: spark.createDataFrame([(k, dt.datetime(2024, 1, 1), n, a, "because") for k, n, a in rows], LOG)
    with pytest.raises(Conflict):
        engine.decide(say((bad, 1, "accept")))
    with pytest.raises(Invalid):
        engine.decide(say((good, 1, "edit")))
    with pytest.raises(NotFound):
        engine.decide(say(("nobody", 1, "accept")))
    engine.decide(say((bad, 1, "reject")))
    with pytest.raises(Conflict):  # no longer escalated, but its evidence does not replay
        engine.decide(say((bad, 2, "accept")))
    engine.decide(say((good, 1, "accept")))
    assert {r.clause_id: r.review_status for r in engine.review_states().collect()} == {bad: "rejected", good: "accepted"}


def test_colliding_anchors_are_refused_and_runs_are_jobs(spark, tmp_path):
    engine = Engine(spark, str(tmp_path))
    twice = TEXT + "Article 21\n1. The operator must stop.\n"
    engine.register_documents(spark.createDataFrame([("NIS2", "v1", TEXT, 1), ("CRA", "v1", twice, 2)], RAW))
    assert [(r.instrument, r.total) for r in engine.parse("run1").collect()] == [("NIS2", 2)]
    assert [r.reason for r in engine.refusals().collect()] == ["colliding anchors"]
    assert engine.parse("run2").isEmpty() and engine.refusals().count() == 1
    with pytest.raises(Conflict):
        engine.parse("run2")
    assert {r.key: r.state for r in engine.job_states().collect()} == {"run1": "completed", "run2": "completed"}


def test_one_version_shows_all_tables_or_none(spark, tmp_path, monkeypatch):
    one, other = Tables(spark, str(tmp_path)), Tables(spark, str(tmp_path))
    rows = lambda n: spark.range(n).toDF("n")
    real = one.commit
    monkeypatch.setattr(one, "commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        one.append_all({"a": rows(3), "b": rows(2)})
    assert one.read("a") is None and one.read("b") is None and other.version() == 0
    monkeypatch.setattr(one, "commit", real)
    assert one.append_all({"a": rows(3), "b": rows(2)}) == 1
    with pytest.raises(Conflict):
        other.append_all({"a": rows(1)}, after=0)
    assert other.append("a", rows(1)) == 2 and one.read("a").count() == 4 and one.read("a", 1).count() == 3 and one.read("b").count() == 2
    # Whoever comes second at a number takes the next.
    monkeypatch.setattr(one, "version", lambda: 1)
    taken = iter([1, 2])
    monkeypatch.setattr(one, "version", lambda: next(taken))
    assert one.append("b", rows(5)) == 3 and other.read("b").count() == 7
    one.append_all({"a": rows(1)}, after=3, claim="x")
    with pytest.raises(Conflict):
        other.append_all({"a": rows(1)}, claim="x")


def test_two_registrations_of_one_document_create_it_once(spark, tmp_path, monkeypatch):
    one, other = Engine(spark, str(tmp_path)), Engine(spark, str(tmp_path))
    raw = spark.createDataFrame([("NIS2", "v1", TEXT, 1)], RAW)
    real, outcomes = one._registered, []

    def overtaken(batch, held):
        rows = real(batch, held)
        if not outcomes:
            outcomes.extend(r.outcome for r in other.register_documents(raw).collect())
        return rows

    monkeypatch.setattr(one, "_registered", overtaken)
    outcomes += [r.outcome for r in one.register_documents(raw).collect()]
    assert outcomes == ["created", "existing"] and one.tables.read("documents").count() == 1


def test_proposals_reuse_known_actors(spark, tmp_path):
    engine, clauses = accepted_engine(spark, tmp_path)
    engine.propose("cs1")
    engine.validate_changeset("cs1")
    engine.approve("cs1")
    engine.publish("cs1", "snap_1", None)
    known = spark.createDataFrame([("actor:op-7", "The Operators", "a")], "node_id string, name string, ordinal string")
    given = spark.createDataFrame([("d:v:a", "d:v:p", "NIS2", "v", "obligation", ["operator", "zzz"], 1)], "clause_id string, anchor_id string, instrument string, source_version string, norm_type string, actor array<string>, ordinal long")
    nodes, edges = graph.propose(given, known=known)
    assert {(r.node_id, r.properties["name"]) for r in nodes.where("type = 'Actor'").collect()} == {("actor:op-7", "The Operators"), ("actor:zzz", "zzz")}
    assert {r.to_node_id for r in edges.where("type = 'IMPOSES_ON'").collect()} == {"actor:op-7", "actor:zzz"}
    assert {r.node_id for r in engine.known_actors().collect()} >= {"actor:operator"}


def test_edits_make_a_validated_revision(spark, tmp_path):
    engine = Engine(spark, str(tmp_path))
    engine.register_documents(spark.createDataFrame([("NIS2", "v1", TEXT, 1)], RAW))
    engine.parse("run1")
    clause = min(r.clause_id for r in engine.review_states().collect())
    log = spark.createDataFrame([(clause, dt.datetime(2024, 1, 1), 1, "edit", "better")], LOG)
    edit = lambda field, value: spark.createDataFrame([(clause, 1, field, value)], "clause_id string, seq long, field string, value string")
    with pytest.raises(Invalid):
        engine.decide(log, edit("review_status", "accepted"))
    with pytest.raises(Conflict):
        engine.decide(log, edit("verbatim_text", "not what the document says"))
    engine.decide(log, edit("action", "notify at once"))
    assert [r.legal_semantics.action == "notify at once" for r in engine.revisions(clause).collect()] == [False, True]
    assert {r.clause_id: r.review_status for r in engine.review_states().collect()}[clause] == "edited"


def test_export_query_and_evaluate(spark, tmp_path):
    engine, clauses = accepted_engine(spark, tmp_path)
    engine.log_calls(spark.createDataFrame([("extract", "c", "o", clauses[0])], "agent_role string, context string, output string, clause_id string"))
    engine.propose("cs1")
    engine.validate_changeset("cs1")
    engine.approve("cs1")
    engine.publish("cs1", "snap_1", None)
    rows, manifest = engine.export("snap_1", "cs1", b"k")
    assert [r.clause_id for r in rows.collect()] == [clauses[0]] and (manifest["included"], manifest["excluded"]) == (1, 1)
    signed = manifest.pop("signature")
    assert verified(json.dumps(manifest, sort_keys=True), b"k", signed) and engine.export("snap_1", "cs1", b"k")[1]["signature"] == signed
    assert engine.query("snap_1", "coverage").first().obligations == 2 and engine.query("snap_1", "coverage", {"snapshot_id": "x"}).isEmpty()
    for pattern, filters in (("nothing", None), ("coverage", {"nothing": "x"})):
        with pytest.raises(NotFound):
            engine.query("snap_1", pattern, filters)
    with pytest.raises(Invalid):
        engine.render("snap_1", "")
    labels = spark.createDataFrame([("article-21/paragraph-1", True), ("article-21/paragraph-2", False), ("article-9/paragraph-1", True)], "path string, expected boolean")
    assert engine.evaluate(labels).first()[:4] == (1, 1, 1, 0)
    assert [(r.instrument, r.source_version) for r in engine.latest_regulations().collect()] == [("NIS2", "v1")]
    engine.register_documents(spark.createDataFrame([("NIS2", "v2", TEXT, 1)], RAW))
    engine.parse("run2")
    new = sorted(c for c in (r.clause_id for r in engine.review_states().collect()) if c not in clauses)
    engine.decide(spark.createDataFrame([(c, dt.datetime(2024, 1, 1), i, "accept", "good") for i, c in enumerate(new)], LOG))
    engine.propose("cs2")
    engine.validate_changeset("cs2")
    engine.approve("cs2")
    engine.publish("cs2", "snap_2", "snap_1")
    history = engine.article_history("snap_2").collect()
    assert len(history) == 2 and all(":v2:" in r.anchor_id and ":v1:" in r.older_anchor_id and r.verbatim_text for r in history)


def test_error_envelopes_and_audit(spark, tmp_path):
    assert [envelope(e)[0] for e in (Invalid("x"), NotFound("x"), Conflict("x"), ValueError("secret"))] == [400, 404, 409, 500]
    assert envelope(ValueError("secret"))[1]["error"] == {"code": "internal_error", "message": "internal error", "details": []}
    tables = Tables(spark, str(tmp_path))
    tables.audit("me", "publish", "snap_1", "2024-01-01T00:00:00Z", "t1")
    assert [(r.actor, r.trace_id) for r in tables.records("audit", "actor string, action string, target string, at string, trace_id string").collect()] == [("me", "t1")]
    assert read_dictionary(spark, [str(tmp_path / "no")]) is None
    (tmp_path / "words").write_text("Operator\n\n can \n")
    assert sorted(r.word for r in read_dictionary(spark, [str(tmp_path / "no"), str(tmp_path / "words")]).collect()) == ["can", "operator"]
    (tmp_path / "labels.json").write_text('{"a/b": "shall", "c": "may"}')
    assert sorted(map(tuple, read_labels(spark, str(tmp_path / "labels.json")).collect())) == [("a/b", "shall"), ("c", "may")]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_bytes(b"x")
    assert read_artifacts(spark, str(tmp_path / "in"), harmless=lambda files: files.where("length > 1")).count() == 0


def test_streamed_keys_are_taken_once(spark, tmp_path):
    rows = [("k1", dt.datetime(2024, 1, 1, 0, 0, s), "POST") for s in range(3)] + [("k2", dt.datetime(2024, 1, 1), "GET"), (None, dt.datetime(2024, 1, 1), "POST")]
    df = spark.createDataFrame(rows, "idempotency_key string, ts timestamp, method string")
    df.write.parquet(str(tmp_path / "in"))
    kept = []
    stream = requests.first_of_key(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    requests.ingest(stream, lambda batch, n: kept.extend(requests.traced(batch, n).collect()), str(tmp_path / "check")).awaitTermination()
    assert sorted(str(r.idempotency_key) for r in kept) == ["None", "k1", "k2"] and {r.trace_id[:6] for r in kept} == {"batch-"}
    assert requests.without_key(df).count() == 1
