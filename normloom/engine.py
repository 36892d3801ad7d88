"""The service's entry points over one store: each call is a Spark job on append-only tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from normloom.durable import reliable
from normloom.functions import text as T
from normloom.operators import evaluate, graph, parse, render, review
from normloom.sources.store import Conflict, Invalid, NotFound, Tables, signature

ONTOLOGY_VERSION = "1.0.0"
#: Fields that a reviewer may change.
EDITABLE = ["verbatim_text", "action", "object", "modality", "norm_type"]


class Engine:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.tables = spark, Tables(spark, folder)

    def _stored(self, name: str) -> DataFrame:
        found = self.tables.read(name)
        if found is None:
            raise NotFound(name)
        return found

    def register_documents(self, raw: DataFrame) -> DataFrame:
        """Store new texts of ``raw(instrument, source_version, text, arrival)``; the outcome of each row (201, 200 or 409).

        Outcomes are decided on one version of the store; if another registration came first, they are decided anew.
        """
        while True:
            version = self.tables.version()
            rows = self._registered(raw, self.tables.read("documents", version))
            try:
                self.tables.append_all({"documents": rows.where("outcome = 'created'").drop("outcome", "status")}, after=version)
            except Conflict:
                continue
            return rows.drop("canonical_text")

    def _registered(self, raw: DataFrame, held: DataFrame | None) -> DataFrame:
        batch = raw.select("*", F.sha2(F.col("text").cast("binary"), 256).alias("checksum"))
        known = held.select("instrument", "source_version", "checksum") if held is not None else batch.select("instrument", "source_version", "checksum").limit(0)
        marked = parse.register(batch, known)
        rows = marked.select("instrument", "source_version", "checksum", "outcome", "status", T.document_id(F.col("instrument"), F.col("source_version"), F.col("checksum")).alias("document_id"), T.canonicalize(F.col("text")).alias("canonical_text"))
        return reliable(rows)  # decided on what was stored before; the append must not change it

    def parse(self, run_id: str) -> DataFrame:
        """Parse documents that have no revision yet, append their obligations and return counts by status.

        Documents in which two spans have one anchor id are refused (``refusals``) and not parsed again. The run is a job: a
        run id is taken once, and what happened to it is in ``job_states``.
        """
        self._job(run_id, 1, "start")
        try:
            version = self.tables.version()
            docs, done, refused = self._stored("documents"), self.tables.read("revisions", version), self.tables.read("refusals", version)
            for other in (done, refused):
                if other is not None:
                    docs = docs.join(other.select("document_id").distinct(), "document_id", "left_anti")
            twice = parse.collisions(parse.anchors(docs)).groupBy(F.substring_index("anchor_id", ":", 1).alias("document_id")).agg(F.min("anchor_id").alias("anchor_id"))
            twice = reliable(twice.withColumns({"reason": F.lit("colliding anchors"), "run_id": F.lit(run_id)}))
            made = parse.parse(docs.join(twice, "document_id", "left_anti")).withColumns({"run_id": F.lit(run_id), "revision_id": F.concat_ws("@", "clause_id", F.lit(run_id))})
            made = reliable(made)
            self.tables.append_all({"revisions": made, "refusals": twice}, after=version)
        except Exception:
            self._job(run_id, 2, "fail")
            raise
        self._job(run_id, 2, "finish")
        return parse.summary(made, "instrument")

    def _job(self, run_id: str, seq: int, event: str) -> None:
        self.tables.put_once("job_events", f"{run_id}/{seq}", {"key": run_id, "seq": seq, "event": event})

    def job_states(self) -> DataFrame:
        """``key, state`` of each parse run."""
        events = self.tables.records("job_events", "key string, seq long, event string")
        if events is None:
            raise NotFound("job_events")
        return review.job_states(events)

    def refusals(self) -> DataFrame:
        """``document_id, anchor_id, reason, run_id`` of documents that could not be parsed."""
        return self._stored("refusals")

    def revisions(self, clause_id: str) -> DataFrame:
        found = self._stored("revisions").where(F.col("clause_id") == clause_id)
        if found.isEmpty():
            raise NotFound(clause_id)
        return found.orderBy("run_id")

    def latest_revisions(self) -> DataFrame:
        return review.latest_per(self._stored("revisions"), "clause_id", "run_id")

    def _first_states(self) -> DataFrame:
        """``key, review_status``: the state in which validation left the first revision of each clause."""
        made = self._stored("revisions")
        return made.groupBy(F.col("clause_id").alias("key")).agg(F.min_by("review_status", "run_id").alias("review_status"))

    def decide(self, decisions: DataFrame, edits: DataFrame | None = None) -> None:
        """Append ``decisions(key, decided, seq, action, rationale)``; any that the log so far forbids is a conflict, as
        is an acceptance of a record that does not pass its checks now.

        ``edits(clause_id, seq, field, value)`` go with them, some for each ``edit``: a new revision of each edited clause is
        validated anew and stored in the same version as the decisions, unless it fails, which refuses the whole call.
        Only ``EDITABLE`` fields may be edited. A call that another change overtook is decided anew.
        """
        unknown = decisions.join(self._first_states(), "key", "left_anti").first()
        if unknown is not None:
            raise NotFound(unknown.key)
        asked = decisions.where("action = 'edit'").select(F.col("key").alias("clause_id"), "seq")
        bare = asked if edits is None else asked.join(edits, ["clause_id", "seq"], "left_anti")
        if not bare.isEmpty():
            raise Invalid("an edit needs edits")
        while True:
            version = self.tables.version()
            held = self.tables.read("decisions", version)
            log = decisions if held is None else held.unionByName(decisions)
            refused = review.decide(log, self._first_states()).join(decisions.select("key", "seq"), ["key", "seq"], "left_semi").where("not allowed")
            if not refused.isEmpty():
                raise Conflict("a decision has no rationale or accepts or edits an escalated record")
            taken = decisions.where("action = 'accept'").select(F.col("key").alias("clause_id"))
            again = self.latest_revisions().drop("checks", "overall_status", "review_status").join(taken, "clause_id", "left_semi")
            if not parse.validate(again, self._stored("documents")).where("overall_status = 'fail'").isEmpty():
                raise Conflict("an accepted clause does not pass its checks")
            adds = {"decisions": decisions}
            if edits is not None:
                adds["revisions"] = self._edited(edits, decisions)
            try:
                self.tables.append_all(adds, after=version)
            except Conflict:
                continue
            return

    def _edited(self, edits: DataFrame, decisions: DataFrame) -> DataFrame:
        wrong = review.refused_fields(edits, EDITABLE).first()
        if wrong is not None:
            raise Invalid(f"{wrong.field} cannot be edited")
        edited = edits.join(decisions.where(F.col("action").isin("accept", "edit")).select(F.col("key").alias("clause_id")), "clause_id", "left_semi")
        old = self.latest_revisions().join(edited.select("clause_id").distinct(), "clause_id", "left_semi")
        flat = old.select("clause_id", "source_evidence.verbatim_text", "source_evidence.evidence_hash", *[F.col(f"legal_semantics.{c}").alias(c) for c in EDITABLE[1:]])
        new = review.apply_edits(flat, edited, EDITABLE).join(edited.groupBy("clause_id").agg(F.max("seq").alias("seq")), "clause_id")
        new = new.select("clause_id", F.struct("*").alias("new"))
        semantics, evidence = F.col("legal_semantics"), F.col("source_evidence")
        for c in EDITABLE[1:]:
            semantics = semantics.withField(c, F.col(f"new.{c}"))
        for c in ("verbatim_text", "evidence_hash"):
            evidence = evidence.withField(c, F.col(f"new.{c}"))
        run = F.concat("run_id", F.lit("+"), F.lpad(F.col("new.seq").cast("string"), 12, "0"))
        rows = old.join(new, "clause_id").withColumns({"legal_semantics": semantics, "source_evidence": evidence, "verbatim_text": F.col("new.verbatim_text"), "run_id": run, "revision_id": F.concat_ws("@", "clause_id", run)})
        made = reliable(parse.validate(rows.drop("new", "checks", "overall_status", "review_status"), self._stored("documents")).select(*old.columns))
        if not made.where("overall_status = 'fail'").isEmpty():
            raise Conflict("an edited clause no longer passes its checks")
        return made

    def log_calls(self, calls: DataFrame) -> None:
        """Append records of agent calls ``(agent_role, context, output, clause_id)``."""
        self.tables.append("agent_calls", review.call_records(calls))

    def review_states(self) -> DataFrame:
        """``clause_id, review_status``: each clause's state after its last decision."""
        made = self._first_states()
        log = self.tables.read("decisions")
        if log is None:
            return made.withColumnRenamed("key", "clause_id")
        last = review.latest_per(review.decide(log, made).where("allowed").select("key", "decided", "seq", "after"), "key", "decided", "seq").select("key", "after")
        return made.join(last, "key", "left").select(F.col("key").alias("clause_id"), F.coalesce("after", "review_status").alias("review_status"))

    def known_actors(self) -> DataFrame | None:
        """``node_id, name, ordinal`` of the actors of the published head."""
        head = self.tables.head()
        if head is None:
            return None
        actors = self.tables.snapshot("snap_nodes", head).where("type = 'Actor'")
        return actors.select("node_id", F.col("properties.name").alias("name"), F.col("node_id").alias("ordinal"))

    def propose(self, changeset_id: str, controls: DataFrame | None = None, assets: DataFrame | None = None, latest: DataFrame | None = None, clauses: DataFrame | None = None) -> None:
        """Append the nodes and edges of all accepted or edited clauses as one change set in the state ``draft``.

        ``clauses(clause_id)`` names them instead; one that is neither accepted nor edited is a conflict, and so is a change set
        id that is taken. Actors that the published head knows by the same or a similar name are that node. Without
        ``latest`` the regulations published last are those superseded."""
        if latest is None:
            latest = self.latest_regulations()
        ok = self.review_states().where(F.col("review_status").isin("accepted", "edited")).select("clause_id")
        if clauses is not None:
            refused = clauses.select("clause_id").join(ok, "clause_id", "left_anti").first()
            if refused is not None:
                raise Conflict(f"{refused.clause_id} is neither accepted nor edited")
            ok = clauses.select("clause_id").distinct()
        rows = review.latest_per(self._stored("revisions").select("clause_id", "run_id", "anchor_id", "instrument", "source_version", "legal_semantics"), "clause_id", "run_id").join(ok, "clause_id")
        given = rows.select("clause_id", "anchor_id", "instrument", "source_version", F.col("legal_semantics.norm_type").alias("norm_type"), F.col("legal_semantics.actor").alias("actor"), F.xxhash64("clause_id").alias("ordinal"))
        nodes, edges = graph.propose(given, controls, assets, latest, self.known_actors())
        self.tables.append_all({name: rows.withColumn("changeset_id", F.lit(changeset_id)) for name, rows in (("cs_nodes", nodes), ("cs_edges", edges))}, claim=f"changeset {changeset_id}")

    def changeset_state(self, changeset_id: str) -> str:
        """``draft``, ``validated``, ``approved``, ``rejected`` or ``published``, from the change set's events."""
        events = self._events(changeset_id)
        if self.changeset_snapshot(changeset_id) is not None:
            return "published"
        return review.changeset_states(events).first().state if not events.isEmpty() else "draft"

    def changeset_snapshot(self, changeset_id: str) -> str | None:
        """The snapshot that published a change set."""
        shown = self.tables._snapshots()
        found = shown.where(F.col("changeset_id") == changeset_id).first() if shown is not None else None
        return found.snapshot_id if found else None

    def snapshot_changeset(self, snapshot_id: str) -> str:
        """The change set that a snapshot published."""
        shown = self.tables._snapshots()
        found = shown.where(F.col("snapshot_id") == snapshot_id).first() if shown is not None else None
        if found is None:
            raise NotFound(snapshot_id)
        return found.changeset_id

    def _events(self, changeset_id: str) -> DataFrame:
        if not self.tables.claimed(f"changeset {changeset_id}"):
            raise NotFound(changeset_id)
        schema = "key string, seq long, event string"
        events = self.tables.records("changeset_events", schema)
        return (events if events is not None else self.spark.createDataFrame([], schema)).where(F.col("key") == changeset_id)

    def _event(self, changeset_id: str, event: str) -> int:
        """Store the next event of a change set; of two at once the second is a conflict."""
        seq = self._events(changeset_id).count() + 1
        self.tables.put_once("changeset_events", f"{changeset_id}/{seq}", {"key": changeset_id, "seq": seq, "event": event})
        return seq

    def regulations(self) -> DataFrame | None:
        """``snapshot_id, instrument, source_version`` of all published regulations."""
        nodes = self.tables.all_snapshots("snap_nodes")
        return nodes.where("type = 'Regulation'").select("snapshot_id", F.col("properties.instrument").alias("instrument"), F.col("properties.source_version").alias("source_version")) if nodes is not None else None

    def latest_regulations(self) -> DataFrame | None:
        if self.tables.head() is None:
            return None
        return graph.latest_regulation(self.regulations(), self.tables.snapshots())

    def _changeset(self, changeset_id: str) -> tuple[DataFrame, DataFrame]:
        return tuple(self._stored(n).where(F.col("changeset_id") == changeset_id) for n in ("cs_nodes", "cs_edges"))

    def _report(self, changeset_id: str) -> DataFrame:
        nodes, edges = self._changeset(changeset_id)
        head = self.tables.head()
        known = self.tables.snapshot("snap_nodes", head).select(F.lit(changeset_id).alias("changeset_id"), "node_id", "type") if head else None
        return reliable(graph.check_constraints(nodes, edges, known))

    def validate_changeset(self, changeset_id: str) -> DataFrame:
        """The report of all six rules; nodes of the published head count as known.

        It is stored by its run, the number of the change set's event, which makes a draft ``validated`` or ``rejected``.
        A published or rejected change set is a conflict.
        """
        state = self.changeset_state(changeset_id)
        if state in ("published", "rejected"):
            raise Conflict(f"{changeset_id} is {state}")
        report = self._report(changeset_id)
        passed = report.where("status = 'fail'").isEmpty()
        run = self._event(changeset_id, "pass" if passed else "fail")
        self.tables.append("reports", report.withColumns({"run": F.lit(run), "overall_status": F.lit("pass" if passed else "fail")}))
        return report

    def approve(self, changeset_id: str) -> None:
        """Approve a change set whose last report passed."""
        state = self.changeset_state(changeset_id)
        if state != "validated":
            raise Conflict(f"{changeset_id} is {state}, not validated")
        self._event(changeset_id, "approve")

    def publish(self, changeset_id: str, snapshot_id: str, base: str | None, ontology_version: str = ONTOLOGY_VERSION) -> None:
        """Publish an approved change set as the new head; anything else is a conflict and leaves the graph as it is.

        All rules, the evidence, the ids and the review history of its clauses are checked anew. The record that shows
        the snapshot names the change set, which is published by it.
        """
        state = self.changeset_state(changeset_id)
        if state != "approved":
            raise Conflict(f"{changeset_id} is {state}, not approved")
        if ontology_version != ONTOLOGY_VERSION:
            raise Conflict(f"the ontology version is {ONTOLOGY_VERSION}")
        if not self._report(changeset_id).where("status = 'fail'").isEmpty():
            raise Conflict(f"{changeset_id} breaks a rule")
        nodes, edges = self._changeset(changeset_id)
        clauses = nodes.where("type = 'Obligation'").select(F.col("provenance_clause_id").alias("clause_id"))
        latest = self.latest_revisions().drop("checks", "overall_status", "review_status").join(clauses, "clause_id", "left_semi")
        if not parse.validate(latest, self._stored("documents")).where("overall_status = 'fail'").isEmpty():
            raise Conflict("the evidence of a clause no longer replays")
        if not parse.id_violations(latest).isEmpty():
            raise Conflict("an id of a clause is not its own")
        states = self.review_states().join(clauses, "clause_id", "left_semi").withColumnRenamed("clause_id", "key")
        if not review.history_violations(states, self._stored("decisions")).isEmpty() or not states.where(~F.col("review_status").isin("accepted", "edited")).isEmpty():
            raise Conflict("a clause has no decision that stands")
        self.tables.publish(snapshot_id, nodes.drop("changeset_id"), edges.drop("changeset_id"), base, changeset_id=changeset_id)

    def lineage(self, snapshot_id: str) -> list[str]:
        """The snapshot and those it supersedes, newest first; an id that is not stored ends the walk."""
        older = {r.snapshot_id: r.superseded_snapshot_id for r in self.tables.snapshots().select("snapshot_id", "superseded_snapshot_id").collect()}  # one short row a publication
        walk, at = [], snapshot_id
        while at and at not in walk:
            walk.append(at)
            at = older.get(at)
        return walk

    def proof_paths(self, snapshot_id: str, mode: str = "complete") -> DataFrame:
        """Proof paths of a published snapshot with the clause's latest text and status."""
        paths = graph.proof_paths(self.tables.snapshot("snap_nodes", snapshot_id), self.tables.snapshot("snap_edges", snapshot_id), mode)
        texts = review.latest_per(self._stored("revisions").select("clause_id", "run_id", "verbatim_text"), "clause_id", "run_id").join(self.review_states(), "clause_id")
        named = texts.select(F.concat(F.lit("obligation:"), "clause_id").alias("obligation_id"), "clause_id", "verbatim_text", "review_status")
        return paths.join(named, "obligation_id", "left").withColumns({c: F.coalesce(c, F.lit("")) for c in ("verbatim_text", "review_status")})

    def query(self, snapshot_id: str, pattern: str, filters: dict[str, str] | None = None) -> DataFrame:
        """A named query pattern over a published snapshot; an unknown pattern is not found."""
        parts = self.tables.snapshot("snap_nodes", snapshot_id), self.tables.snapshot("snap_edges", snapshot_id)
        try:
            return graph.dispatch(pattern, *parts, filters)
        except LookupError as error:
            raise NotFound(str(error)) from None

    def article_history(self, snapshot_id: str) -> DataFrame:
        """Each article of a snapshot's documents in the versions that its regulation supersedes, with their latest texts."""
        ends = [F.split(c, ":", 3) for c in ("from_node_id", "to_node_id")]
        older = self.tables.snapshot("snap_edges", snapshot_id).where("type = 'SUPERSEDES'").select(ends[0][1].alias("instrument"), ends[0][2].alias("source_version"), ends[1][2].alias("older_version")).distinct()
        revisions = self._stored("revisions")
        anchors = revisions.select("instrument", "source_version", T.structural_path(F.col("anchor_id"))["path"].alias("path"), "anchor_id").distinct()
        return graph.article_texts(graph.article_history(anchors, older), revisions.select("anchor_id", "run_id", "verbatim_text"))

    def export(self, snapshot_id: str, changeset_id: str, key: bytes) -> tuple[DataFrame, dict]:
        """The exported clauses of a published snapshot and its signed manifest.

        Only clauses whose whole chain of evidence resolves are exported. The manifest holds counts, the ontology version and
        a digest over all rows in any order; it is stored beside the rows.
        """
        nodes, edges = (self.tables.snapshot(n, snapshot_id) for n in ("snap_nodes", "snap_edges"))
        nodes = nodes.withColumn("clause_id", F.when(F.col("type") == "Obligation", F.col("provenance_clause_id")))
        revisions, states, decided = self.latest_revisions(), self.review_states(), self.tables.read("decisions")
        if decided is None:
            raise NotFound("decisions")
        took = decided.select(F.col("key").alias("clause_id")).distinct().withColumn("decided", F.lit(True))
        calls = self.tables.read("agent_calls")
        calls = calls.select("clause_id") if calls is not None else took.select("clause_id").limit(0)
        obligations = nodes.where("type = 'Obligation'").select("clause_id")
        sets = obligations.distinct().select("clause_id", F.lit(changeset_id).alias("changeset_id"), F.lit(snapshot_id).alias("snapshot_id"))
        held = revisions.select("clause_id", "document_id", "run_id").join(took, "clause_id", "left")
        chain = graph.provenance(obligations, held, self._stored("documents").select("document_id", "checksum"), calls, sets)
        latest = states.join(revisions.select("clause_id", graph.least_confidence(F.col("governance.field_confidence")).alias("confidence")), "clause_id")
        rows = reliable(graph.export(nodes, edges, latest, chain))
        parts = graph.export_parts(nodes, rows).groupBy("included").agg(F.count("*").alias("n")).collect()
        digest = rows.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64(*rows.columns)).alias("x"), F.sum(F.xxhash64(*rows.columns).cast("decimal(38,0)")).alias("s")).first()
        manifest = {"snapshot_id": snapshot_id, "changeset_id": changeset_id, "ontology_version": ONTOLOGY_VERSION, "included": sum(r.n for r in parts if r.included), "excluded": sum(r.n for r in parts if not r.included), "content": f"{digest.n}:{digest.x}:{digest.s}"}
        manifest["signature"] = signature(json.dumps(manifest, sort_keys=True), key)
        rows.write.mode("overwrite").json(f"{self.tables.folder}/exports/{snapshot_id}")
        return rows, manifest

    def evaluate(self, labels: DataFrame) -> DataFrame:
        """Confusion of detection against ``labels(path, expected)`` by structural path; what has no revision was not detected."""
        found = self.latest_revisions().select(T.structural_path(F.col("anchor_id"))["path"].alias("path")).distinct().withColumn("predicted", F.lit(True))
        return evaluate.confusion(evaluate.labelled(labels, found))

    def render(self, snapshot_id: str, clause_id: str) -> str:
        """The picture of an accepted clause's proof path."""
        if not clause_id:
            raise Invalid("clause_id is empty")
        entry = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.regexp_replace(c, "^[^:]*:", ""))
        columns = ["provision_id", "obligation_id", "control_id", "asset_id", "evidence_id", "test_asset_id"]
        path = F.array(*[entry(k, c) for k, c in zip(render.CANONICAL, columns, strict=True)])
        found = self.proof_paths(snapshot_id).where((F.col("clause_id") == clause_id) & (F.col("review_status") == "accepted")).orderBy(*columns).select(render.svg(path).alias("svg")).first()
        if found is None or found.svg is None:
            raise NotFound(clause_id)
        return found.svg
