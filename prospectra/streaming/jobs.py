"""Streams of CRM patches, activity and audits; each equals its batch twin."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import state
from ..operators.files import Folder
from ..operators.shared import clear, marked, stored


def usage_stream(activity: DataFrame, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """Events of each account and kind in tumbling windows; state of a window is dropped
    once the watermark has passed it."""
    marked = activity.withWatermark("created_at", late)
    return marked.groupBy("account_id", "kind", F.window("created_at", window)).agg(F.count("*").alias("n")).select(
        "account_id", "kind", F.col("window.start").alias("window_start"), "n"
    )


def new_targets_stream(targets: DataFrame, late: str = "30 days") -> DataFrame:
    """Audit targets (lead_id, at, ...) each let through once within the watermark."""
    return targets.withWatermark("at", late).dropDuplicatesWithinWatermark(["lead_id"])


def session_counts_stream(activity: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """Calls in one sitting: activity of an account without a longer gap."""
    marked = activity.withWatermark("created_at", late)
    return marked.groupBy("account_id", F.session_window("created_at", gap)).agg(F.count("*").alias("n")).select(
        "account_id", F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n"
    )


class CrmTable:
    """CRM state in hash buckets of the lead id under one folder.

    A micro-batch of patches rewrites the buckets that it touches and no other, into
    data/batch=N/bucket=K. manifests/N then names the folder that holds each bucket, and is
    the commit: it is written last, whole or not at all. So a batch that stops halfway
    changes nothing, a batch that is run again after its commit does nothing, a restart goes
    on from the newest manifest, and the sink is exact once the checkpoint is.

    The last KEPT manifests stay, with the folders that they name. The number of buckets is
    fixed by the first batch; some hundred thousand leads a bucket are a good size.
    """

    KEPT = 3

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64) -> None:
        self.spark, self.folder = spark, Folder(spark, path)
        self._buckets = buckets

    def _batches(self) -> list[int]:
        """Numbers of the committed batches, oldest first."""
        return sorted(int(n.rpartition("/")[2]) for n in self.folder.names("manifests/[0-9]*"))

    def manifest(self, below: int | None = None) -> dict:
        """{"buckets": how many, "at": {bucket: batch that wrote it}} of the newest commit, of
        those before ``below`` if that is given."""
        have = [n for n in self._batches() if below is None or n < below]
        found = json.loads(self.folder.read(f"manifests/{have[-1]:020d}")) if have else {"buckets": self._buckets, "at": {}}
        return {"buckets": found["buckets"], "at": {int(k): n for k, n in found["at"].items()}}

    def _place(self, bucket: int, batch: int) -> str:
        return f"data/batch={batch}/bucket={bucket}"

    def _rows(self, manifest: dict, buckets=None) -> DataFrame:
        empty = state.empty_crm(self.spark)
        paths = [f"{self.folder.path}/{self._place(k, n)}" for k, n in sorted(manifest["at"].items()) if buckets is None or k in buckets]
        return self.spark.read.schema(empty.schema).parquet(*paths) if paths else empty

    @staticmethod
    def _bucket(buckets: int) -> Column:
        return F.pmod(F.xxhash64("lead_id"), F.lit(buckets)).cast("int")

    def read(self, below: int | None = None) -> DataFrame:
        """The newest committed state, of those before batch ``below`` if that is given."""
        return self._rows(self.manifest(below))

    def lookup(self, lead_ids: list[str]) -> DataFrame:
        """Rows of some leads; only their buckets are read."""
        now = self.manifest()
        ids = self.spark.createDataFrame([(i,) for i in lead_ids], "lead_id string")
        touched = {r[0] for r in ids.select(self._bucket(now["buckets"])).distinct().collect()}
        return self._rows(now, touched).filter(F.col("lead_id").isin(lead_ids))

    def merge(self, patches: DataFrame, batch_id: int, leads: DataFrame) -> None:
        """Fold the patches of known leads in, as batch ``batch_id``."""
        if self.folder.has(f"manifests/{batch_id:020d}"):
            return
        now, since = self.manifest(batch_id), marked()
        bucket = self._bucket(now["buckets"])
        folded = stored(state.fold_patches(patches), "crm-patches")
        ids = folded.select(F.col("lead_id").alias("id"))
        # the batch's ids are the small side: all leads' ids are read, none is shuffled while Spark can broadcast them
        known = stored(leads.select("id").join(ids, "id", "left_semi").distinct().select(F.col("id").alias("lead_id")), "crm-known")
        touched = {r[0] for r in known.select(bucket).distinct().collect()}  # at most the number of buckets
        new = state.patch_crm(self._rows(now, touched), folded.join(known, "lead_id", "left_semi"))
        new.withColumn("bucket", bucket).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder.path}/data/batch={batch_id}")
        at = now["at"] | dict.fromkeys(touched, batch_id)
        self.folder.write(f"manifests/{batch_id:020d}", json.dumps({"buckets": now["buckets"], "at": at}))
        clear(self.spark, since)
        self._drop_old()

    def _drop_old(self) -> None:
        done = self._batches()
        for n in done[: -self.KEPT]:
            self.folder.remove(f"manifests/{n:020d}")
        used = {self._place(k, n) for m in done[-self.KEPT :] for k, n in self.manifest(m + 1)["at"].items()}
        newest = done[-1]
        for place in self.folder.names("data/batch=*/bucket=*"):
            # what a later batch writes just now is not committed yet
            if place not in used and int(place.split("/")[1][6:]) <= newest:
                self.folder.remove(place)
        for batch in self.folder.names("data/batch=*"):
            if int(batch[11:]) <= newest and not self.folder.names(f"{batch}/bucket=*"):
                self.folder.remove(batch)


def stream_patches(patches: DataFrame, table: CrmTable, leads: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
    """Fold a stream of patches (event_id, ts, lead_id, patch) into the table."""
    merge: Callable[[DataFrame, int], None] = lambda batch, number: table.merge(batch, number, leads)
    return patches.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


class AuditLog:
    """Audit rows under one folder, one part a batch of one job. A part counts once its
    _SUCCESS file is there; a part that is written again replaces itself."""

    def __init__(self, spark: SparkSession, path: str, schema: str) -> None:
        self.spark, self.folder, self.schema = spark, Folder(spark, path), schema

    def _all_parts(self) -> tuple[list[str], set[str]]:
        """(finished parts, those of them whose rows a compact part holds)."""
        compact = {n.rpartition("/")[0]: json.loads(self.folder.read(n)) for n in self.folder.names("compact=*/_replaces")}
        found = [n.rpartition("/")[0] for n in self.folder.names("job=*/part=*/_SUCCESS")]
        return [*found, *compact], {p for replaced in compact.values() for p in replaced}

    def parts(self) -> list[str]:
        """Finished parts, without those whose rows a compact one holds."""
        found, gone = self._all_parts()
        return [p for p in found if p not in gone]

    def read(self, but: str | None = None) -> DataFrame:
        """Rows of the finished parts, except those of the part ``but``."""
        paths = [f"{self.folder.path}/{p}" for p in self.parts() if p != but]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def audit(self, targets: DataFrame, audit: Callable[[DataFrame], DataFrame], job: str, part: int) -> None:
        """Audit the targets (lead_id, ...) that no other part has, each once, and append the
        rows as one part. ``audit`` takes targets and returns rows of the log's schema."""
        since, name = marked(), f"job={job}/part={part}"
        left = state.first_audits(targets.dropDuplicates(["lead_id"]), self.read(name))
        rows = audit(stored(left, "audit-targets"))
        rows.select(*self.spark.createDataFrame([], self.schema).columns).write.mode("overwrite").parquet(f"{self.folder.path}/{name}")
        clear(self.spark, since)

    def audit_all(self, targets: DataFrame, audit: Callable[[DataFrame], DataFrame], job: str, parts: int = 16) -> None:
        """audit() in ``parts`` parts by the hash of the lead, so that a job which is killed
        keeps what it finished: run again, it goes on with what is left. Parts that are
        there are not looked at again."""
        done = set(self.parts())
        for k in range(parts):
            if f"job={job}/part={k}" not in done:
                self.audit(targets.filter(F.pmod(F.xxhash64("lead_id"), F.lit(parts)) == k), audit, job, k)

    def compact(self, name: str) -> None:
        """Put the rows of all finished parts into one, so that many small batches leave few
        files. The list of what it replaces is its commit; those parts go after that."""
        # with what an earlier one replaced and could not remove any more
        old, place = self._all_parts()[0], f"compact={name}"
        if self.folder.has(f"{place}/_replaces"):
            raise ValueError(f"there is a compact part {name!r} already")
        self.read().write.mode("overwrite").parquet(f"{self.folder.path}/{place}")
        self.folder.write(f"{place}/_replaces", json.dumps(old))
        for p in old:
            self.folder.remove(p)


def stream_audits(targets: DataFrame, log: AuditLog, audit: Callable[[DataFrame], DataFrame], checkpoint: str, **trigger) -> StreamingQuery:
    """Audit a stream of targets into the log. Parts bear the identity of the checkpoint, so
    a batch that is run again replaces its own part, and another checkpoint never does."""

    def step(batch: DataFrame, number: int) -> None:
        # Spark wrote the file before the first batch
        job = json.loads(Folder(log.spark, checkpoint).read("metadata"))["id"]
        log.audit(batch, audit, job, number)

    return targets.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


class ActivityStore:
    """Append-only activity (event_id, account_id, lead_id, kind, created_at), partitioned
    by day. A batch that is appended again replaces its own files, and an event that several
    batches hold counts once when it is read."""

    SCHEMA = "event_id long, account_id string, lead_id string, kind string, created_at timestamp"

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.folder = spark, Folder(spark, path)

    def append(self, events: DataFrame, batch: str) -> None:
        """Files of one batch: batch=<name>/day=<day>/. Late events go to the day on which
        they happened."""
        rows = events.select("event_id", "account_id", "lead_id", "kind", F.col("created_at").cast("timestamp").alias("created_at"))
        rows = rows.withColumn("day", F.to_date("created_at"))
        # a day's rows of one batch are one file, unless there are very many
        rows.repartition("day", F.pmod(F.xxhash64("event_id"), F.lit(4))).sortWithinPartitions("day", "lead_id").write.mode("overwrite").partitionBy("day").parquet(f"{self.folder.path}/batch={batch}")

    def _batches(self) -> list[str]:
        return [n.rpartition("/")[0] for n in self.folder.names("batch=*/_SUCCESS")]

    def read(self, since: str | None = None, until: str | None = None) -> DataFrame:
        """Events of the days from ``since`` to ``until`` (both included), each once; other
        days are not read. Of events with one id the earliest stays."""
        found = self._batches()
        if not found:
            return self.spark.createDataFrame([], self.SCHEMA)
        whole = self.spark.read.schema(f"{self.SCHEMA}, day date").option("basePath", self.folder.path)
        rows = whole.parquet(*[f"{self.folder.path}/{b}" for b in found])
        for bound, keep in ((since, F.col("day") >= F.lit(since).cast("date")), (until, F.col("day") <= F.lit(until).cast("date"))):
            rows = rows.filter(keep) if bound else rows
        rest = ("account_id", "lead_id", "kind", "created_at")
        first = rows.groupBy("event_id").agg(F.min(F.struct("created_at", "account_id", "lead_id", "kind")).alias("e"))
        return first.select("event_id", *[F.col(f"e.{c}") for c in rest])

    def timeline(self, lead_id: str, since: str | None = None, until: str | None = None) -> DataFrame:
        """A lead's events of those days, newest first."""
        return state.timeline(self.read(since, until), lead_id)

    def compact(self, batch: str) -> None:
        """All batches as one new one, each event once and few files a day. Where it stops
        before the old ones are gone, their events still count once."""
        old = self._batches()
        if f"batch={batch}" in old:
            raise ValueError(f"there is a batch {batch!r} already")
        self.append(self.read(), batch)
        for b in old:
            self.folder.remove(b)


def stream_activity(events: DataFrame, store: ActivityStore, checkpoint: str, **trigger) -> StreamingQuery:
    """Append a stream of activity; batches bear the identity of the checkpoint."""

    def step(batch: DataFrame, number: int) -> None:
        job = json.loads(Folder(store.spark, checkpoint).read("metadata"))["id"]
        store.append(batch, f"{job}-{number}")

    return events.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
