import pytest
from pyspark.sql import functions as F

from normloom.operators import graph
from normloom.plans import inputs

FEW = ("Asset", "TestAsset", "Actor")


@pytest.fixture(scope="module")
def homed(spark):
    """Two snapshots of three homes; a dangling end of each kind, a wrong type, an obligation without its actor."""
    nodes, edges = [], []
    for snap in ("s1", "s2"):
        nodes += [(snap, "asset:1", "Asset", None, None), (snap, "testasset:1", "TestAsset", None, None), (snap, "provision:1", "Provision", None, None), (snap, "actor:1", "Actor", None, None)]
        for k in (1, 2, 3):
            nodes += [(snap, f"obligation:{k}", "Obligation", str(k), k), (snap, f"control:{k}", "Risk" if k == 3 else "Control", None, k), (snap, f"evidence:{k}", "EvidenceRequirement", None, k)]
            edges += [
                (snap, f"obligation:{k}", "provision:1" if k < 3 else "provision:9", "DERIVED_FROM", k, True), (snap, f"obligation:{k}", f"control:{k}", "MAPS_TO_CONTROL", k, False), (snap, f"control:{k}", "asset:1", "AFFECTS_ASSET", k, True),
                (snap, f"control:{k}", f"evidence:{k}", "SATISFIED_BY", k, False), (snap, f"evidence:{k}", "testasset:1" if k == 1 else "testasset:9", "EVIDENCED_BY", k, True), (snap, f"control:{k}", f"evidence:gone-{k}", "SATISFIED_BY", k, False),
            ] + ([(snap, f"obligation:{k}", "actor:1", "IMPOSES_ON", k, True)] if k == 2 else [])
    return spark.createDataFrame(nodes, "snapshot_id string, node_id string, type string, clause_id string, home long"), spark.createDataFrame(edges, "snapshot_id string, from_node_id string, to_node_id string, type string, home long, shared boolean")


def rows(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def test_homes_change_no_result(spark, homed):
    nodes, edges = homed
    plain = nodes.drop("home"), edges.drop("home", "shared")
    for mode in ("complete", "optional"):
        assert rows(graph.proof_paths(nodes, edges, mode, FEW)) == rows(graph.proof_paths(*plain, mode)) != []
    assert rows(graph.coverage(nodes, edges, FEW)) == rows(graph.coverage(*plain)) != []
    assert rows(graph.strict_edges(nodes, edges, few=FEW)) == rows(graph.strict_edges(*plain)) != []
    sets = lambda pair: [df.withColumnRenamed("snapshot_id", "changeset_id") for df in pair]
    assert rows(graph.check_constraints(*sets(homed), few=FEW)) == rows(graph.check_constraints(*sets(plain)))
    with_home, without = sets(homed), sets(plain)
    actor = lambda df, yes: df.where((F.col("type") == "Actor") == yes)
    got = graph.check_constraints(actor(with_home[0], False), with_home[1], actor(with_home[0], True), FEW)
    assert rows(got) == rows(graph.check_constraints(*without))
    latest = spark.createDataFrame([(str(k), "accepted", 1.0) for k in (1, 2, 3)], "clause_id string, review_status string, confidence double")
    chain = spark.createDataFrame([(str(k), True) for k in (1, 2, 3)], "clause_id string, resolved boolean")
    assert rows(graph.export(nodes, edges, latest, chain, FEW).drop("home")) == rows(graph.export(*plain, latest, chain)) != []


def test_joins_within_a_home_move_nothing(spark):
    nodes, edges = inputs.graph_tables(spark, "/root/testdata/sf0.001")
    plan = graph.proof_paths(nodes, edges, few=inputs.FEW)._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.splitlines() if "Exchange hashpartitioning(" in line]
    assert moved and not any("control_id" in line or "evidence_id" in line or "obligation_id" in line for line in moved)


def test_the_graph_has_the_rows_of_its_sql(spark):
    nodes, edges = inputs.graph_tables(spark, "/root/testdata/sf0.001")
    assert rows(nodes.drop("home")) == rows(inputs.make(spark, "/root/testdata/sf0.001", inputs.NODES))
    assert rows(edges.drop("home", "shared")) == rows(inputs.make(spark, "/root/testdata/sf0.001", inputs.EDGES))


def test_sliding_windows_take_the_nearest_second(spark, tmp_path):
    from normloom.plans.queries import QUERIES

    times = ["2024-01-01 02:59:59.5", "2024-01-01 02:59:59.499999", "2024-01-01 02:59:58.5", "2024-01-01 03:00:00.25"]
    spark.createDataFrame([(i, i, t) for i, t in enumerate(times)], "event_id long, user_id long, t string").selectExpr("event_id", "user_id", "cast(t AS timestamp_ntz) AS ts").write.parquet(f"{tmp_path}/events.parquet")
    got = QUERIES["st1_sliding_windows"](spark, str(tmp_path)).selectExpr("client", "cast(window_start AS string) AS w").groupBy("client").agg(F.max("w").alias("w")).collect()
    assert {r.client: r.w for r in got} == {0: "2024-01-01 03:00:00", 1: "2024-01-01 00:00:00", 2: "2024-01-01 00:00:00", 3: "2024-01-01 03:00:00"}


def test_records_beside_their_text_need_no_documents(spark):
    from normloom.operators import parse

    docs = spark.createDataFrame([("d", "v1", "NIS2", "Article 1\n1. The operator shall act within 3 days.\n2. The operator may wait.\n")], "document_id string, source_version string, instrument string, canonical_text string")
    beside = parse.parse(docs)
    want = parse.validate(beside.drop("checks", "overall_status", "review_status"), docs)
    assert rows(beside.select("clause_id", "checks", "overall_status")) == rows(want.select("clause_id", "checks", "overall_status")) != []
    assert beside._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1


def test_copies_of_a_term_meet_a_mention_once(spark):
    from normloom.operators import resolve

    terms = spark.range(20000).selectExpr("if(id % 2 = 0, 'LARGE Brass', 'large brass') AS term", "cast(id + 5 AS string) AS target_id", "id + 5 AS ordinal")
    mentions = spark.createDataFrame([("ge BR",), ("la",), ("LARGE Brass",)], "mention string")
    got = resolve.reference_candidates(mentions, terms)
    assert {r.mention: (r.target_id, r.confidence) for r in got.collect()} == {"ge BR": ("5", 0.6), "la": ("5", 0.6), "LARGE Brass": ("5", 1.0)}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in plan.split("Generate explode")[1].split("Range")[0]
