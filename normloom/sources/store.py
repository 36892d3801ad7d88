"""Artifacts, append-only tables and the snapshot sink."""

from __future__ import annotations

import hashlib
import hmac
import json
from collections.abc import Callable
from uuid import uuid4

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ALLOWED_SUFFIXES = (".txt", ".xml", ".html", ".pdf")
MAX_BYTES = 25 * 1024 * 1024


class Conflict(ValueError):
    """A write that contradicts what is stored (status 409)."""

    code, status = "conflict", 409


class NotFound(LookupError):
    """A record that is not stored or not published (status 404)."""

    code, status = "not_found", 404


class Invalid(ValueError):
    """A request that cannot be served as it stands (status 400)."""

    code, status = "invalid_request", 400


def envelope(error: Exception) -> tuple[int, dict]:
    """Status and body of an error; what is not an error of this library is an internal one."""
    code, status = getattr(error, "code", "internal_error"), getattr(error, "status", 500)
    return status, {"error": {"code": code, "message": str(error) if status != 500 else "internal error", "details": []}}


def read_artifacts(spark: SparkSession, path: str, harmless: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``path, length, checksum, text, outcome``: files of allowed kinds and sizes; bytes that are not UTF-8 are refused.

    ``harmless`` may leave out files, such as those that a scanner refuses, before anything of them is kept.
    """
    files = spark.read.format("binaryFile").load(path)
    files = files.transform(harmless) if harmless else files
    suffix = F.lower(F.regexp_extract("path", r"\.[^./]+$", 0))
    body = F.col("content").cast("string")
    ok = suffix.isin(*ALLOWED_SUFFIXES)
    fits = F.col("length") <= MAX_BYTES
    outcome = F.when(~ok, "unsupported_type").when(~fits, "too_large").when(suffix == ".pdf", "needs_extraction").when(~F.is_valid_utf8(body), "invalid_utf8").otherwise("accepted")
    return files.select("path", "length", F.sha2("content", 256).alias("checksum"), F.when(outcome == "accepted", body).alias("text"), outcome.alias("outcome"))


class Tables:
    """Append-only Parquet tables below one folder of a shared store, under one log of versions.

    Each version is a record that names the folders of rows it adds, of all tables at once; a table is what the
    log's records name, so rows written without their record do not show. ``rename`` must fail where its target
    exists, as it does on HDFS and local disks; an object store needs a committer that claims names so.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._known: dict[int, dict] = {}

    def _log(self) -> dict[int, dict]:
        """The record of each version: the folders it adds and the names it claims. Versions do not change, so only new ones are read."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        place = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/log")
        files = place.getFileSystem(conf)
        for status in files.listStatus(place) if files.exists(place) else []:
            name = status.getPath().getName()
            if name.startswith("_") or not name.endswith(".json") or int(name[:-5]) in self._known:
                continue
            stream = files.open(status.getPath())
            record = json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
            stream.close()
            self._known[record["version"]] = record
        return self._known

    def version(self) -> int:
        return max(self._log(), default=0)

    def append_all(self, adds: dict[str, DataFrame], after: int | None = None, claim: str | None = None) -> int:
        """Add rows to several tables in one version, which is returned: all of them show, or none.

        With ``after`` it must be the next version, else it is a conflict and the caller decides anew; without, the
        rows hold whatever else was added, and the loser of a race takes the next number. A name that
        a version claims is taken by it: another claim of it is a conflict.
        """
        attempt = uuid4().hex
        for name, rows in adds.items():
            rows.write.parquet(f"{self.folder}/{name}/{attempt}")
        while True:
            version = (self.version() if after is None else after) + 1
            if claim is not None and self.claimed(claim):
                raise Conflict(f"{claim} is taken")
            try:
                self.commit("log", f"{version:012d}", {"version": version, "adds": [f"{name}/{attempt}" for name in adds], "claim": claim})
                return version
            except Conflict:
                if after is not None:
                    raise

    def claimed(self, claim: str) -> bool:
        return any(r["claim"] == claim for r in self._log().values())

    def append(self, name: str, rows: DataFrame) -> int:
        return self.append_all({name: rows})

    def read(self, name: str, version: int | None = None) -> DataFrame | None:
        """A table as of the latest or a given version; null if nothing was added to it."""
        log = self._log()
        paths = [f"{self.folder}/{p}" for v in sorted(log) if version is None or v <= version for p in log[v]["adds"] if p.rpartition("/")[0] == name]
        return self.spark.read.parquet(*paths) if paths else None

    def commit(self, name: str, key: str, record: dict) -> None:
        """Store ``record`` under ``key``, all of it or nothing; a key that is taken is a conflict, whoever took it.

        The record is written aside and then renamed, which fails if the name is there already.
        """
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        hadoop = jvm.org.apache.hadoop.fs
        aside, place = (hadoop.Path(f"{self.folder}/{name}/{f}.json") for f in (f"_{uuid4().hex}", key))
        files = place.getFileSystem(conf)
        out = files.create(aside, False)
        out.write(bytearray(json.dumps(record, sort_keys=True).encode()))
        out.close()
        plain = self.spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 0)
        try:
            hadoop.FileContext.getFileContext(files.getUri(), conf).rename(files.makeQualified(aside), files.makeQualified(place), plain)
        except Py4JJavaError as error:
            files.delete(aside, False)
            if "FileAlreadyExists" in str(error):
                raise Conflict(f"{name}: {key} is stored already") from None
            raise

    def records(self, name: str, schema: str) -> DataFrame | None:
        """All records that ``commit`` stored under ``name``."""
        try:
            return self.spark.read.schema(schema).json(f"{self.folder}/{name}")
        except AnalysisException as error:
            if error.getCondition() == "PATH_NOT_FOUND":
                return None
            raise

    def put_once(self, name: str, key: str, record: dict) -> None:
        """A record whose key is written once; its file is named by the key's digest."""
        self.commit(name, hashlib.sha256(key.encode()).hexdigest(), record)

    def audit(self, actor: str, action: str, target: str, at: str, trace_id: str = "") -> None:
        """Append to the log of what was done; nothing here changes or removes an entry."""
        self.commit("audit", uuid4().hex, {"actor": actor, "action": action, "target": target, "at": at, "trace_id": trace_id})

    def publish(self, snapshot_id: str, nodes: DataFrame, edges: DataFrame, base: str | None, strict: bool = False, changeset_id: str | None = None) -> None:
        """Write a snapshot's nodes and edges, then the record that makes it visible.

        Each attempt writes to a folder of its own, which only the record names, so a write that breaks off shows nothing and does
        a later one no harm. Of two publishers on one base the second finds the next number taken. Equal
        edges are kept once; with ``strict`` those without both ends are left out. The base must be the head. The record names
        the change set too, so that it is published by the same commit.
        """
        shown = self._snapshots()
        head = None if shown is None else shown.agg(F.max_by(F.struct("snapshot_id", "publish_seq"), "publish_seq").alias("h")).first().h
        if (head.snapshot_id if head else None) != base:
            raise Conflict(f"the head is {head.snapshot_id if head else None}, not {base}")
        if shown is not None and not shown.where(F.col("snapshot_id") == snapshot_id).isEmpty():
            raise Conflict(f"{snapshot_id} is published already")
        attempt, once = uuid4().hex, edges.dropDuplicates(["from_node_id", "to_node_id", "type"])
        if strict:
            for end in ("from_node_id", "to_node_id"):
                once = once.join(nodes.select(F.col("node_id").alias(end)).distinct(), end, "left_semi")
        for name, rows in (("snap_nodes", nodes), ("snap_edges", once)):
            rows.withColumn("snapshot_id", F.lit(snapshot_id)).write.parquet(f"{self.folder}/{name}/{attempt}")
        seq = head.publish_seq + 1 if head else 1
        self.commit("snapshots", f"{seq:012d}", {"snapshot_id": snapshot_id, "publish_seq": seq, "superseded_snapshot_id": base, "attempt": attempt, "changeset_id": changeset_id})

    def _snapshots(self) -> DataFrame | None:
        return self.records("snapshots", "snapshot_id string, publish_seq long, superseded_snapshot_id string, attempt string, changeset_id string")

    def snapshots(self) -> DataFrame:
        shown = self._snapshots()
        if shown is None:
            raise NotFound("snapshots")
        return shown.drop("attempt")

    def head(self) -> str | None:
        shown = self._snapshots()
        return None if shown is None else shown.agg(F.max_by("snapshot_id", "publish_seq")).first()[0]

    def snapshot(self, name: str, snapshot_id: str) -> DataFrame:
        shown = self._snapshots()
        found = None if shown is None else shown.where(F.col("snapshot_id") == snapshot_id).first()
        if found is None:
            raise NotFound(snapshot_id)
        return self.spark.read.parquet(f"{self.folder}/{name}/{found.attempt}")

    def all_snapshots(self, name: str) -> DataFrame | None:
        """The rows of all published snapshots in one scan, by their ``snapshot_id``."""
        shown = self._snapshots()
        paths = [f"{self.folder}/{name}/{r.attempt}" for r in shown.select("attempt").collect()] if shown is not None else []  # one short row a publication
        return self.spark.read.parquet(*paths) if paths else None


def read_dictionary(spark: SparkSession, paths: list[str]) -> DataFrame | None:
    """``word``, in lower case, of the first word list among ``paths`` that exists; null if none does."""
    for path in paths:
        try:
            lines = spark.read.text(path)
        except AnalysisException:
            continue
        return lines.select(F.lower(F.trim("value")).alias("word")).where("word != ''").distinct()
    return None


def read_relation(spark: SparkSession, url: str, name: str, **options: str) -> DataFrame:
    """A table of a database by its JDBC address, whose driver the session must have."""
    return spark.read.format("jdbc").options(url=url, dbtable=name, **options).load()


def signature(manifest: str, key: bytes) -> str:
    """HMAC-SHA256 of an export manifest, one short string."""
    return hmac.new(key, manifest.encode(), hashlib.sha256).hexdigest()


def verified(manifest: str, key: bytes, signed: str) -> bool:
    return hmac.compare_digest(signature(manifest, key), signed)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """``path, label`` rows of a JSON file that holds one object of labels by structural path."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,string>").alias("m"))
    return whole.select(F.explode("m").alias("path", "label"))


def joined_pages(pages: DataFrame, key: str) -> DataFrame:
    """One text of each document's ``pages(key, page_no, text)``, in order, an empty line between."""
    held = pages.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("page_no", "text"))).alias("pages"))
    return held.select(key, F.array_join("pages.text", "\n\n").alias("text"))


class ToolPolicy:
    """Which tools an agent may call: registered ones of read-only categories, from allowed providers."""

    def __init__(self, categories: frozenset[str], providers: frozenset[str], tools: dict[str, str]):
        self.categories, self.providers, self.tools = categories, providers, tools

    def allows(self, tool: str, provider: str) -> bool:
        return provider in self.providers and self.tools.get(tool) in self.categories

    def allowed(self, tool: Column, provider: Column) -> Column:
        """``allows`` for columns: a tool that is not registered, and a null, is refused."""
        good = [t for t, category in sorted(self.tools.items()) if category in self.categories]
        return F.coalesce(provider.isin(*sorted(self.providers)) & tool.isin(*good), F.lit(False))
