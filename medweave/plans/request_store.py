"""Export requests, their audit events and their artifacts as one versioned state in a folder.

A step (submissions, stewards' decisions, downloads) writes all it changes into a data folder that nobody reads yet: whole
rows of the requests it changes, its events, its artifacts. It counts from the moment its entry in the log is there, which one
rename makes; so a decision, its artifact and its event are there together or not at all. Requests of a step that ask one
dataset for the same rows and columns share them: these are written once, and each request's own stamps beside them, so that what
is written grows with the different artifacts and the requests, not with their product. Entries are numbered, and a number
can be taken once: a step that read version n may only write n + 1, and when another one was first it is worked out anew on
the newer state (``update``). A lost driver leaves a data folder that no entry names.

The requests at a version are the newest row of each since the last snapshot; a snapshot is made every ``SNAPSHOT_EVERY``
entries, so a read opens a bounded number of folders of changes. Events are only ever added. Renames that refuse an existing
target are atomic on HDFS; on a local file system, as in tests, two processes could still meet between test and rename.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F

from medweave.functions import access as fa
from medweave.operators.keyed import latest_per_key
from medweave.operators.skew import skew_join
from medweave.plans import governance as g

SNAPSHOT_EVERY = 10
REQUESTS = (
    "request_id string, submitter string, dataset string, justification string, format string, status string, created_at timestamp, "
    "selected_columns string, cohort_filter string, steward string, steward_comment string, approved_at timestamp, rejected_at timestamp, "
    "output_url string, output_table string, expires_at timestamp, row_count long, artifact_in string"
)
EVENTS = "event_id string, timestamp timestamp, user string, action_type string, resource string, outcome string, details string"
CONSENT = ("_consent_group", "_dbgap_accession", "_access_tier", "_exported_for", "_access_expires_at", "_request_id", "_exported_at")


class Conflict(Exception):
    """Another step took the version."""


class Step:
    """What one step changes, written as it goes; nothing of it counts before ``commit``."""

    def __init__(self, store: RequestStore, seen: int) -> None:
        self.store, self.seen, self.id, self.parts = store, seen, uuid.uuid4().hex, []

    def write(self, part: str, df: DataFrame) -> DataFrame:
        """Write one part (once) and read it back."""
        path = self.store.part(self.id, part)
        df.write.parquet(path)
        self.parts.append(part)
        return self.store.spark.read.schema(df.schema).parquet(path)

    def commit(self, snapshot: bool = False) -> int:
        try:
            self.store.claim(self.seen + 1, {"data": self.id, "parts": self.parts, "snapshot": snapshot})
        except Conflict:
            self.store.drop(self.id)
            raise
        return self.seen + 1


class RequestStore:
    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        at = self._hadoop.Path(self.folder)
        self._fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
        self._context = self._hadoop.FileContext.getFileContext(self._fs.getUri(), spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._hadoop.Path(f"{self.folder}/log"))

    def part(self, data: str, part: str) -> str:
        return f"{self.folder}/data/{data}/{part}"

    def drop(self, data: str) -> None:
        self._fs.delete(self._hadoop.Path(f"{self.folder}/data/{data}"), True)

    def claim(self, version: int, entry: dict) -> None:
        """Write the log entry of ``version``, or raise Conflict when there is one."""
        draft = self._hadoop.Path(f"{self.folder}/log/.{entry['data']}")
        out = self._fs.create(draft, True)
        out.write(bytearray(json.dumps(entry).encode()))
        out.close()
        target = self._hadoop.Path(f"{self.folder}/log/{version:020d}")
        no_overwrite = self.spark.sparkContext._gateway.new_array(getattr(self._hadoop, "Options$Rename"), 1)
        no_overwrite[0] = getattr(self._hadoop, "Options$Rename").NONE
        try:
            self._context.rename(draft, target, no_overwrite)
        except Exception as error:
            if not self._fs.exists(target):
                raise
            self._fs.delete(draft, False)
            raise Conflict(version) from error

    def log(self, upto: int | None = None) -> list[dict]:
        """The entries up to a version, oldest first: small, one per step."""
        listed = self._fs.listStatus(self._hadoop.Path(f"{self.folder}/log"))
        names = sorted(n for n in (s.getPath().getName() for s in listed) if n.isdigit())
        if not names or upto == 0:
            return []
        read = self.spark.read.schema("data string, parts array<string>, snapshot boolean").json(f"{self.folder}/log/[0-9]*")
        rows = read.select("*", F.element_at(F.split("_metadata.file_path", "/"), -1).cast("int").alias("version")).collect()
        return sorted((r.asDict() for r in rows if upto is None or r["version"] <= upto), key=lambda e: e["version"])

    def version(self) -> int:
        log = self.log()
        return log[-1]["version"] if log else 0

    def requests(self, version: int | None = None) -> DataFrame:
        """The requests as they were at a version (the newest one by default)."""
        log = self.log(version)
        last = max((i for i, e in enumerate(log) if e["snapshot"]), default=0)
        changes = [
            self.spark.read.schema(REQUESTS).parquet(self.part(e["data"], "requests")).withColumn("_version", F.lit(e["version"]))
            for e in log[last:] if "requests" in e["parts"]
        ]
        if not changes:
            return self.spark.createDataFrame([], REQUESTS)
        return latest_per_key(reduce(DataFrame.unionAll, changes), ["request_id"], ["_version"]).drop("_version")

    def events(self, version: int | None = None) -> DataFrame:
        folders = [self.part(e["data"], "events") for e in self.log(version) if "events" in e["parts"]]
        return self.spark.read.schema(EVENTS).parquet(*folders) if folders else self.spark.createDataFrame([], EVENTS)

    def artifact(self, request: Row) -> DataFrame:
        """The rows of an approved request: the columns it chose, then what they are allowed for."""
        stamp = self.spark.read.parquet(self.part(request["artifact_in"], "stamps")).where(F.col("request_id") == request["request_id"])
        own = stamp.select("definition").first()
        shared = self.spark.read.parquet(self.part(request["artifact_in"], "artifacts"))
        rows = shared.where(F.col("definition") == F.lit(own and own["definition"])).drop("definition").crossJoin(F.broadcast(stamp))
        names = shared.schema["source"].dataType.fieldNames()
        chosen = _chosen(names, fa.parse_selected_columns(F.lit(request["selected_columns"])))
        kept = self.spark.range(1).select(chosen.alias("c")).first()["c"]
        return rows.select(*[F.col("source").getField(c).alias(c) for c in kept], *CONSENT)

    def update(self, work: Callable[[Step, DataFrame], None]) -> int:
        """Do ``work(step, requests)`` on the newest state until no other step came first; the version it made.

        Some step wins at every turn, so steps that meet all end.
        """
        while True:
            seen = self.version()
            step = Step(self, seen)
            work(step, self.requests(seen))
            try:
                made = step.commit()
            except Conflict:
                continue
            if made % SNAPSHOT_EVERY == 0:
                self.snapshot()
            return made

    def snapshot(self) -> None:
        """Write the requests whole, unless another step comes first; the next one due will do it then."""
        seen = self.version()
        step = Step(self, seen)
        step.write("requests", self.requests(seen))
        try:
            step.commit(snapshot=True)
        except Conflict:
            return


def _fitted(df: DataFrame) -> DataFrame:
    """The columns of REQUESTS, NULL where ``df`` has none."""
    wanted = df.sparkSession.createDataFrame([], REQUESTS).schema
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted])


def _decision(rows: DataFrame, key: str, catalog: DataFrame, perms: DataFrame, now: g.Now) -> DataFrame:
    """``rows`` (``key``, dataset, submitter) with ``_decision``; of several permissions one that grants is enough."""
    joined = g.request_decisions(rows.select(key, "dataset", "submitter", *[c for c in ("_now",) if c in rows.columns]), catalog, perms, now)
    decision = F.when(F.col("access_tier").isNull(), F.lit("no_record")).otherwise(g._decided(joined, now)["decision"])
    best = joined.select(key, decision.alias("_d")).groupBy(key).agg(F.max(F.col("_d") == fa.GRANTED).alias("_granted"), F.max("_d").alias("_other"))
    return rows.join(best.select(key, F.when(F.col("_granted"), F.lit(fa.GRANTED)).otherwise(F.col("_other")).alias("_decision")), key)


def submit(store: RequestStore, asked: DataFrame, catalog: DataFrame, perms: DataFrame, now: g.Now) -> int:
    """Requests whose submitter may have the dataset become pending; each other one leaves a blocked event.

    ``asked``: columns of REQUESTS as far as known, with ``created_at``. Ids the store has already are passed over, so that a
    batch may be sent twice; of rows with one id the latest counts.
    """
    asked = latest_per_key(_fitted(asked), ["request_id"], ["created_at", "submitter", "dataset"])

    def work(step: Step, requests: DataFrame) -> None:
        new = asked.join(requests.select("request_id"), "request_id", "left_anti")
        decided = step.write("decided", _decision(new, "request_id", catalog, perms, now))
        granted = F.col("_decision") == fa.GRANTED
        pending = _fitted(decided.where(granted).withColumn("status", F.lit("pending")))
        stated = F.struct(F.col("request_id").alias("id"), "submitter", "dataset", "justification", "format", "status", "created_at")
        refused = F.struct(F.lit("export_decision").alias("reason"), F.col("_decision").alias("decision"))
        done = g.event_envelope(pending, F.col("submitter"), "submit_export", F.col("dataset"), "submitted", stated, F.col("created_at"))
        blocked = g.event_envelope(decided.where(~granted), F.col("submitter"), "submit_export", F.col("dataset"), "blocked", refused, F.col("created_at"))
        step.write("requests", pending)
        step.write("events", done.unionAll(blocked))

    return store.update(work)


def _chosen(names: list[str], wanted: Column) -> Column:
    """Of ``names`` those asked for (whatever the case), in the order asked for; all when there is none. Reserved names never."""
    known = F.create_map(*[x for c in names for x in (F.lit(c.lower()), F.lit(c))])
    asked = F.array_compact(F.transform(wanted, lambda w: F.try_element_at(known, F.lower(F.trim(w)))))
    kept = F.array_distinct(F.filter(asked, lambda c: ~F.lower(c).isin(*fa.RESERVED_COLUMNS)))
    return F.when(F.size(kept) > 0, kept).otherwise(F.array(*[F.lit(c) for c in names]))


def number(text: Column) -> Column:
    """A finite number in decimal, hexadecimal, octal or binary notation; blank text is 0, anything else NULL."""
    t = F.trim(text)
    digits = F.substring(t, 3, 1 << 20)
    value = F.when(t == "", F.lit(0.0))
    for pattern, base in (("^0[xX][0-9a-fA-F]+$", 16), ("^0[oO][0-7]+$", 8), ("^0[bB][01]+$", 2)):
        value = value.when(t.rlike(pattern), F.conv(digits, base, 10).cast("double"))
    value = value.when(t.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), t.try_cast("double"))
    return F.when(F.abs(value) < float("inf"), value)


def _in_cohort(names: list[str], wanted: Column) -> Column:
    """Whether a row is in the cohort of its request, for filters that differ from row to row; unusable filters keep all."""
    cells = F.create_map(*[x for c in names for x in (F.lit(c.lower()), F.col(f"source.`{c}`").cast("string"))])
    column, op, value = F.lower(F.trim(wanted["column"])), wanted["op"], wanted["value"]
    cell, limit = F.try_element_at(cells, column), number(value)
    amount = cell.try_cast("double")
    known = F.map_contains_key(cells, F.coalesce(column, F.lit("")))
    test = (
        F.when(op == "contains", F.ilike(cell, F.concat(F.lit("%"), value, F.lit("%"))))
        .when(op == "eq", cell == value).when(op == "ne", cell != value)
        .when(limit.isNull() | ~op.isin("lt", "lte", "gt", "gte"), F.lit(True))
        .when(op == "lt", amount < limit).when(op == "lte", amount <= limit).when(op == "gt", amount > limit).otherwise(amount >= limit)
    )
    return F.when(known, F.coalesce(test, F.lit(False))).otherwise(F.lit(True))


def _definition(names: list[str]) -> Column:
    """What an artifact holds, as a key: dataset, columns and cohort. Requests that share it have the same rows."""
    wanted, cohort = fa.parse_selected_columns(F.col("selected_columns")), fa.parse_cohort_filter(F.col("cohort_filter"))
    return F.sha2(F.to_json(F.struct("dataset", F.array_sort(_chosen(names, wanted)).alias("chosen"), cohort.alias("cohort"))), 256)


def _artifacts(approved: DataFrame, sources: DataFrame) -> DataFrame:
    """The rows of each different artifact (``definition``) once, in one join of the definitions with the rows of their datasets."""
    names = [c for c in sources.columns if c != "dataset_id"]
    rows = sources.select(F.col("dataset_id").alias("dataset"), F.struct(*[F.col(f"`{c}`") for c in names]).alias("source"))
    asked = approved.groupBy("definition", "dataset").agg(F.first("selected_columns").alias("selected_columns"), F.first("cohort_filter").alias("cohort_filter"))
    wanted = asked.select(
        "definition", "dataset", _chosen(names, fa.parse_selected_columns(F.col("selected_columns"))).alias("_chosen"),
        fa.parse_cohort_filter(F.col("cohort_filter")).alias("_cohort"),
    )
    joined = skew_join(rows, wanted, ["dataset"], "inner").where(_in_cohort(names, F.col("_cohort")))
    kept = F.struct(*[F.when(F.array_contains("_chosen", c), F.col(f"source.`{c}`")).alias(c) for c in names])
    return joined.select("definition", kept.alias("source")).sortWithinPartitions("definition")


def _stamps(approved: DataFrame, catalog: DataFrame) -> DataFrame:
    """What the rows of a request's artifact are allowed for, with the key of those rows."""
    known = catalog.select(F.col("dataset_id").alias("dataset"), "consent_group", "access_tier").dropDuplicates(["dataset"])
    until = F.col("acted_at") + F.make_dt_interval(F.lit(fa.EXPORT_DAYS))
    return skew_join(approved, known, ["dataset"], "left").select(
        "request_id", "definition", F.coalesce("consent_group", F.lit("")).alias("_consent_group"), F.col("dataset").alias("_dbgap_accession"),
        F.coalesce("access_tier", F.lit("")).alias("_access_tier"), F.coalesce("submitter", F.lit("")).alias("_exported_for"),
        until.cast("string").alias("_access_expires_at"), F.col("request_id").alias("_request_id"), F.col("acted_at").alias("_exported_at"),
    ).sortWithinPartitions("request_id")


def decide(store: RequestStore, actions: DataFrame, catalog: DataFrame, sources: DataFrame) -> int:
    """Stewards' actions: requests, artifacts and events of all of them in one step.

    ``actions``: ``request_id, kind (approve, reject), steward, is_steward, steward_comment, acted_at``, at most one per request by a
    steward (an error otherwise). ``sources``: the rows of the datasets, with ``dataset_id``; a dataset without rows there is
    approved without an output. Who is not a steward changes nothing and leaves a blocked event; unknown ids do nothing.
    """
    able = F.coalesce("is_steward", F.lit(False))
    if not actions.where(able).groupBy("request_id").count().where("count > 1").isEmpty():
        raise ValueError("several actions for one request")
    names = [c for c in sources.columns if c != "dataset_id"]

    def work(step: Step, requests: DataFrame) -> None:
        own = actions.where(able).select("request_id", "kind", "acted_at", F.col("steward").alias("_by"), F.col("steward_comment").alias("_comment"))
        meant = step.write("meant", requests.join(own, "request_id").withColumn("definition", _definition(names)))
        approved = meant.where(F.col("kind") == "approve")
        artifacts = step.write("artifacts", _artifacts(approved, sources))
        step.write("stamps", _stamps(approved, catalog))
        counts = artifacts.groupBy("definition").agg(F.count(F.lit(1)).alias("_rows"))
        stocked = sources.select(F.col("dataset_id").alias("dataset"), F.lit(True).alias("_stocked")).distinct()
        sized = skew_join(skew_join(meant, counts, ["definition"]), stocked, ["dataset"])
        output = F.when((F.col("kind") == "approve") & F.col("_stocked"), fa.artifact_name(F.col("request_id")))
        made = F.when(output.isNotNull(), F.coalesce("_rows", F.lit(0)))
        done = step.write("done", sized.select(*meant.columns, output.alias("_output"), made.alias("_made")))
        acts = done.select("request_id", "kind", F.col("_by").alias("steward"), F.col("_comment").alias("steward_comment"), "acted_at", F.col("_output").alias("output_table"))
        after = g.transition(done.select(*requests.columns), acts).join(done.select("request_id", "_made", "kind"), "request_id")
        approving = F.col("kind") == "approve"
        step.write("requests", _fitted(after.withColumns({
            "row_count": F.when(approving, F.col("_made")).otherwise(F.col("row_count")),
            "artifact_in": F.when(approving, F.when(F.col("_made").isNotNull(), F.lit(step.id))).otherwise(F.col("artifact_in")),
        })))
        wanted, cohort = fa.parse_selected_columns(F.col("selected_columns")), fa.parse_cohort_filter(F.col("cohort_filter"))
        usable = _usable(names, cohort)
        projected = F.exists(wanted, lambda w: F.lower(F.trim(w)).isin(*[c.lower() for c in names if c.lower() not in fa.RESERVED_COLUMNS]))
        ends = F.when(F.col("_output").isNotNull(), (F.col("acted_at") + F.make_dt_interval(F.lit(fa.EXPORT_DAYS))).cast("string"))
        details = F.struct(
            F.col("request_id").alias("id"), F.col("_output").alias("output_table"), ends.alias("expires_at"), F.col("_made").alias("row_count"),
            (F.col("_output").isNotNull() & projected).alias("cohort_projected"), (F.col("_output").isNotNull() & usable).alias("cohort_filtered"),
        )
        events = [
            g.event_envelope(done.where(approving), F.col("_by"), "approve_export", F.col("dataset"), "approved", details, F.col("acted_at")),
            g.event_envelope(done.where(F.col("kind") == "reject"), F.col("_by"), "reject_export", F.col("dataset"), "rejected", F.struct(F.col("request_id").alias("id")), F.col("acted_at")),
            g.event_envelope(
                actions.where(~able), F.col("steward"), F.concat("kind", F.lit("_export")), F.col("request_id"), "blocked",
                F.struct(F.lit("not_a_steward").alias("reason")), F.col("acted_at"),
            ),
        ]
        step.write("events", reduce(DataFrame.unionAll, events))

    return store.update(work)


def _usable(names: list[str], cohort: Column) -> Column:
    known = F.lower(F.trim(cohort["column"])).isin(*[c.lower() for c in names])
    op = cohort["op"]
    compares = op.isin("lt", "lte", "gt", "gte") & number(cohort["value"]).isNotNull()
    return F.coalesce(known & (op.isin("contains", "eq", "ne") | compares), F.lit(False))


def record_downloads(store: RequestStore, attempts: DataFrame, catalog: DataFrame, perms: DataFrame) -> int:
    """Pass each attempt (``attempt_id, request_id, user, enabled, at``) through the gates and keep an event of it.

    The decision is that of the user at the time of the attempt. ``artifact`` gives the rows of an allowed one.
    """

    def work(step: Step, requests: DataFrame) -> None:
        asked = attempts.withColumn("_now", F.unix_timestamp("at"))
        known = asked.join(requests.select("request_id", "dataset", F.col("submitter").alias("_owner"), "status", "output_table", "expires_at", "row_count", "format"), "request_id", "left")
        decided = _decision(known.withColumnRenamed("user", "submitter"), "attempt_id", catalog, perms, F.col("_now"))
        gate = fa.download_gate(
            F.col("status"), F.col("output_table"), F.col("_owner"), F.col("expires_at"), F.col("submitter"), F.col("_decision"), F.col("enabled"), F.col("at")
        )
        gated, path = step.write("gated", decided.withColumn("_gate", gate)), F.lit("direct_download").alias("egress_path")
        form = F.when(F.lower("format").isin("json", "jsonl"), "json").otherwise("csv")
        allowed = F.struct(F.col("request_id").alias("id"), "output_table", "row_count", form.alias("format"), path)
        refused = F.struct(F.col("request_id").alias("id"), F.col("_gate").alias("reason"), path)
        who, what, ok = F.col("submitter"), F.coalesce("dataset", F.lit("")), F.col("_gate") == "allowed"
        step.write("events", g.event_envelope(gated.where(ok), who, "download_export", what, "allowed", allowed, F.col("at")).unionAll(
            g.event_envelope(gated.where(~ok), who, "download_export", what, "blocked", refused, F.col("at"))))

    return store.update(work)
