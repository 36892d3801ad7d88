"""Review state from an append-only log of decisions, and the latest of each record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Status that each action leads to.
STATES = {"accept": "accepted", "edit": "edited", "reject": "rejected", "escalate": "escalated"}


def latest_per(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of each key by ``order``, whole; each task hands on one row a key."""
    rest = [c for c in rows.columns if c != key]
    best = rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("last"))
    return best.select(key, "last.*")


def state_of(action: Column) -> Column:
    out = F.lit("pending")
    for name, state in STATES.items():
        out = F.when(action == name, state).otherwise(out)
    return out


def decide(decisions: DataFrame, initial: DataFrame | None = None) -> DataFrame:
    """``decisions(key, decided, seq, action, rationale)`` plus ``before``, ``allowed`` and ``after``.

    An escalated record cannot be accepted or edited, and every decision needs a rationale; a refused
    decision leaves the state. Allowed decisions alone change it, so the state before is that of
    the last allowed decision: an escalation holds until a rejection. ``initial(key, review_status)`` has the
    states before any decision, such as those that validation escalated; a record without one is pending.
    """
    w = Window.partitionBy("key").orderBy("decided", "seq").rowsBetween(Window.unboundedPreceding, -1)
    spoken = F.length(F.trim(F.coalesce("rationale", F.lit("")))) > 0
    marked = decisions.withColumn("spoken", spoken)
    if initial is not None:
        marked = marked.join(initial.select("key", F.col("review_status").alias("begun")), "key", "left")
    begun = F.coalesce("begun", F.lit("pending")) if initial is not None else F.lit("pending")
    # Between an escalation and the next rejection accept and edit are refused.
    turn = F.last(F.when(F.col("spoken") & F.col("action").isin("escalate", "reject"), F.col("action")), ignorenulls=True).over(w)
    allowed = F.col("spoken") & F.col("action").isin(*STATES) & ~(F.col("action").isin("accept", "edit") & (F.coalesce("turn", F.when(begun == "escalated", "escalate").otherwise("")) == "escalate"))
    marked = marked.withColumn("turn", turn).withColumn("allowed", allowed)
    before = F.coalesce(F.last(F.when(F.col("allowed"), state_of(F.col("action"))), ignorenulls=True).over(w), begun)
    return marked.withColumn("before", before).withColumn("after", F.when(F.col("allowed"), state_of(F.col("action"))).otherwise(F.col("before"))).drop("turn", "spoken", "begun")


def history(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """``key, seq`` with all other columns: each record's revisions numbered oldest first."""
    return rows.withColumn("decision_seq", F.row_number().over(Window.partitionBy(key).orderBy(*order)))


def field_diff(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """``key, field, old, new`` for each field whose text differs, nulls compared as values."""
    named = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"o.{f}").cast("string").alias("old"), F.col(f"n.{f}").cast("string").alias("new")) for f in fields]))
    pairs = old.alias("o").join(new.alias("n"), F.col(f"o.{key}") == F.col(f"n.{key}")).select(F.col(f"o.{key}").alias(key), named.alias("f"))
    return pairs.select(key, "f.*").where(~F.col("old").eqNullSafe(F.col("new")))


def rate_limited(hits: DataFrame, limit: int = 120, seconds: int = 60) -> DataFrame:
    """``hits(client, ts)`` plus the hits of the client in the window up to each, itself and refused ones included."""
    counted = hits.selectExpr("*", f"count(*) over (partition by client order by ts range between interval {seconds} seconds preceding and current row) as hits")
    return counted.withColumn("allowed", F.col("hits") <= limit)


def apply_edits(records: DataFrame, edits: DataFrame, editable: list[str], key: str = "clause_id") -> DataFrame:
    """``records`` with the last edit of each field applied; ``edits(key, seq, field, value)``.

    Fields outside ``editable`` are left alone. An edited ``verbatim_text`` gets a new ``evidence_hash`` unless the hash is edited too.
    """
    last = edits.where(F.col("field").isin(editable)).groupBy(key).agg(*[F.max_by(F.when(F.col("field") == f, F.struct("value")), F.when(F.col("field") == f, F.col("seq"))).alias(f"new_{f}") for f in editable])
    joined = records.join(last, key, "left")
    new = {f: F.when(F.col(f"new_{f}").isNotNull(), F.col(f"new_{f}.value")).otherwise(F.col(f)) for f in editable if f in records.columns}
    if "verbatim_text" in new and "evidence_hash" in records.columns:
        given = F.col("new_evidence_hash.value") if "evidence_hash" in editable else F.lit(None).cast("string")
        new["evidence_hash"] = F.when(F.col("new_verbatim_text").isNotNull(), F.coalesce(given, F.sha2(F.col("new_verbatim_text.value").cast("binary"), 256))).otherwise(new.get("evidence_hash", F.col("evidence_hash")))
    return joined.select(*[new.get(c, F.col(c)).alias(c) for c in records.columns])


#: What each event makes of each state; any other pair leaves the state. ``published`` and ``rejected`` are final.
TRANSITIONS = {
    ("draft", "pass"): "validated", ("draft", "fail"): "rejected", ("validated", "fail"): "rejected", ("validated", "approve"): "approved",
    ("approved", "fail"): "rejected", ("approved", "publish"): "published",
}


def changeset_states(events: DataFrame) -> DataFrame:
    """``key, state, refused``: the state after all ``events(key, seq, event)`` in order, and how many events did not
    apply. A change set's few events are folded in one row."""
    ordered = events.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("seq", "event"))).alias("log"))

    def step(s: Column, x: Column) -> Column:
        new = F.lit(None).cast("string")
        for (state, event), to in TRANSITIONS.items():
            new = F.when((s["state"] == state) & (x["event"] == event), F.lit(to)).otherwise(new)
        repeat = (x["event"] == "pass") & s["state"].isin("validated", "approved")
        return F.struct(F.coalesce(new, s["state"]).alias("state"), (s["refused"] + F.when(new.isNull() & ~repeat, 1).otherwise(0)).alias("refused"))

    folded = F.aggregate("log", F.struct(F.lit("draft").alias("state"), F.lit(0).alias("refused")), step)
    return ordered.select("key", folded.alias("s")).select("key", "s.state", "s.refused")


def call_records(calls: DataFrame) -> DataFrame:
    """Append-only records of agent calls: ``calls(agent_role, context, output, clause_id)`` with hashes of input, context and output."""
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    return calls.select("agent_role", "clause_id", digest("context").alias("input_hash"), digest("context").alias("context_hash"), digest("output").alias("output_hash"))


def history_violations(states: DataFrame, decisions: DataFrame) -> DataFrame:
    """``key`` of accepted or edited records (``key, review_status``) whose log is empty or has an entry without a rationale."""
    blank = F.count_if(F.trim(F.coalesce("rationale", F.lit(""))) == "")
    held = decisions.groupBy("key").agg(F.count("*").alias("entries"), blank.alias("blank"))
    joined = states.where(F.col("review_status").isin("accepted", "edited")).join(held, "key", "left")
    return joined.where((F.coalesce("entries", F.lit(0)) == 0) | (F.col("blank") > 0)).select("key")


def unseen_acts(acts: DataFrame, views: DataFrame) -> DataFrame:
    """``acts(session, key, acted)`` of a record that the session had not viewed before; ``views(session, key, acted)``."""
    first = views.groupBy("session", "key").agg(F.min("acted").alias("viewed"))
    return acts.join(first, ["session", "key"], "left").where(F.col("viewed").isNull() | (F.col("viewed") > F.col("acted"))).drop("viewed")


def all_calls(held: DataFrame, stored: DataFrame) -> DataFrame:
    """Agent calls in memory and stored ones, each id once; ``id`` beside any columns that both have."""
    return held.unionByName(stored).dropDuplicates(["id"])


#: What each event makes of a parse job; any other pair leaves it. The last two states are final.
JOB_STATES = {("queued", "start"): "running", ("running", "finish"): "completed", ("running", "fail"): "failed", ("queued", "fail"): "failed"}


def job_states(events: DataFrame) -> DataFrame:
    """``key, state`` of parse jobs after all ``events(key, seq, event)`` in order; a job begins as queued."""
    log = events.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("seq", "event"))).alias("log"))

    def step(state: Column, x: Column) -> Column:
        new = state
        for (before, event), after in JOB_STATES.items():
            new = F.when((state == before) & (x["event"] == event), F.lit(after)).otherwise(new)
        return new

    return log.select("key", F.aggregate("log", F.lit("queued"), step).alias("state"))


def refused_fields(edits: DataFrame, editable: list[str]) -> DataFrame:
    """``edits(key, field, value)`` of fields that an editor may not change."""
    return edits.where(~F.coalesce(F.col("field").isin(editable), F.lit(False)))
