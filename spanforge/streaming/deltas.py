"""Viewers' results kept by deltas: a tick costs the entries that arrived and those that left.

An entry that meets a viewer puts in *contributions* (bucket, group keys, value, time); equal ones are one row with
their number.  Contributions lie by slots of time.  A tick makes them of the batches that a viewer has not seen yet,
finds those that leave the look-back in the slots that the clock has passed since the tick before, and writes the
two as one table of signed numbers.  A viewer's state is the sum over these tables, so it is never read in a tick, and
what was taken off leaves nothing behind: numbers of values are whole, so results equal those of a recomputation.

Tables are runs of levels: eight of a level are merged into one of the next, so a row is rewritten a logarithmic
number of times; what its viewer no longer wants goes with the merge.  Slots that all viewers have left are deleted.

The *manifest* names the runs, the clock, and for each viewer its revision, what it asks for, and its cursor: the last
batch that it holds, with the newest position by signal.  It is written once a tick's tables are whole, and only if
something moved.  A tick that fails leaves tables that no manifest names, and is made again; a batch that comes again
is behind all cursors.  After a restart a viewer of the same revision goes on after its cursor; any other is worked
out from the entries of its look-back, alone, while the others go on.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import viewers
from ..operators.viewers import Viewer

SLOT_MS = 60_000
FAN_IN = 8
NEWEST = 50
STATE = "viewer_key string, bucket_start_ms long, group_keys array<string>, value double, n long"
CONTRIBUTION = f"{STATE}, ms long"
KEYS = ["viewer_key", "bucket_start_ms", "group_keys", "value"]


def wants(v: Viewer) -> str:
    """What a viewer asks for, whatever its revision."""
    asked = [v.signal_mask, v.lookback_ms, v.query, v.filters, v.any_filter, v.aggregation.to_json() if v.aggregation else None]
    return hashlib.sha256(json.dumps(asked, sort_keys=True).encode()).hexdigest()[:16]


@dataclass
class Manifest:
    """``viewers``: by id, revision, wants, key, look-back and cursor; ``runs``: (level, name) of the state's tables; ``slots``: the same by slot."""

    tick: int = -1
    clock_ms: int | None = None
    viewers: dict[str, dict] = field(default_factory=dict)
    runs: list[list] = field(default_factory=list)
    slots: dict[str, list[list]] = field(default_factory=dict)
    newest: str | None = None


class Deltas:
    """``entries`` of batches and the time they are read for: a function (numbers, first day) -> DataFrame with ``batch``."""

    def __init__(self, spark: SparkSession, root: str, entries, slot_ms: int = SLOT_MS):
        self.spark, self.root, self.entries, self.slot_ms = spark, root.rstrip("/"), entries, slot_ms
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.manifest = self._load()
        #: Folders that the last tick read, for whoever wants to know what it cost.
        self.was_read: list[str] = []

    # manifests

    def _names(self, folder: str) -> list[str]:
        path = self._path(f"{self.root}/{folder}")
        return [s.getPath().getName() for s in self._fs.listStatus(path)] if self._fs.exists(path) else []

    def _load(self) -> Manifest:
        found = sorted(n for n in self._names("manifests") if n.endswith(".json"))
        if not found:
            return Manifest()
        text = "\n".join(r.value for r in self.spark.read.text(f"{self.root}/manifests/{found[-1]}").collect())
        return Manifest(**json.loads(text))

    def _commit(self, new: Manifest) -> None:
        """A whole manifest appears at once, under the next number; the one before stays for readers."""
        name = f"{self.root}/manifests/{new.tick:012d}"
        out = self._fs.create(self._path(f"{name}.open"), True)
        out.write(bytearray(json.dumps(new.__dict__).encode()))
        out.close()
        self._fs.rename(self._path(f"{name}.open"), self._path(f"{name}.json"))
        for old in sorted(n for n in self._names("manifests") if n.endswith(".json"))[:-2]:
            self._fs.delete(self._path(f"{self.root}/manifests/{old}"), False)
        self.manifest = new

    def _read(self, names: list[str], schema: str) -> DataFrame:
        self.was_read += names
        return self.spark.read.schema(schema).parquet(*(f"{self.root}/{n}" for n in names)) if names else self.spark.createDataFrame([], schema)

    # cursors

    def knows(self, v: Viewer) -> bool:
        """Whether there is a state of this viewer in this revision."""
        held = self.manifest.viewers.get(v.id)
        return held is not None and held["revision"] == v.revision and held["wants"] == wants(v)

    def rename(self, v: Viewer) -> None:
        """A revision that asks for the same takes the state over."""
        held = self.manifest.viewers.get(v.id)
        if held is not None and held["wants"] == wants(v) and held["revision"] != v.revision:
            moved = {**self.manifest.viewers, v.id: held | {"revision": v.revision}}
            self._commit(Manifest(**self.manifest.__dict__ | {"viewers": moved, "tick": self.manifest.tick + 1}))

    def forget(self, viewer_id: str) -> None:
        if viewer_id in self.manifest.viewers:
            left = {k: x for k, x in self.manifest.viewers.items() if k != viewer_id}
            self._commit(Manifest(**self.manifest.__dict__ | {"viewers": left, "tick": self.manifest.tick + 1}))

    def cursor(self, viewer_id: str) -> dict | None:
        held = self.manifest.viewers.get(viewer_id)
        return held and held["cursor"]

    # a tick

    def advance(self, known: list[Viewer], landed: list[int], now: datetime) -> None:
        """Brings the viewers to the batches ``landed`` and the clock to ``now``; nothing is written if neither moves anything."""
        old, self.was_read = self.manifest, []
        ms = max(int(now.timestamp() * 1000), old.clock_ms or 0)
        tick, last = old.tick + 1, max(landed, default=-1)
        behind: dict[int, list[Viewer]] = {}
        for v in known:
            at = old.viewers[v.id]["cursor"]["batch"] if self.knows(v) else -1
            if at < last or not self.knows(v):
                behind.setdefault(at, []).append(v)
        # A state that is begun anew has a new key, so rows of an earlier one are nobody's.
        keys = {v.id: old.viewers[v.id]["key"] if self.knows(v) else f"{v.id}|{tick}" for v in known}
        fresh = self._arrived(behind, landed, ms, keys)
        gone = self._left([v for v in known if self.knows(v)], old.clock_ms, ms)
        if not behind and gone is None:
            return
        slots, newest, runs, parts, positions = dict(old.slots), old.newest, list(old.runs), [], {}
        try:
            if fresh is not None:
                fresh = fresh.persist()
                positions = self._write_fresh(fresh, known, keys, tick, slots)
                parts.append(self._read([f"contributions/tick={tick}"], f"{CONTRIBUTION}, slot long").select(*KEYS, "n"))
                newest = self._write_newest(fresh, known, keys, tick)
            if gone is not None:
                parts.append(gone.select(*KEYS, (-F.col("n")).alias("n")))
            if parts:
                moved = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
                moved.groupBy(*KEYS).agg(F.sum("n").alias("n")).where("n <> 0").write.mode("overwrite").parquet(f"{self.root}/runs/tick={tick}")
                runs.append([0, f"runs/tick={tick}"])
        finally:
            if fresh is not None:
                fresh.unpersist()
        held = {}
        for v in known:
            cursor = dict(old.viewers[v.id]["cursor"]) if self.knows(v) else {}
            held[v.id] = {"revision": v.revision, "wants": wants(v), "key": keys[v.id], "lookback_ms": v.lookback_ms, "cursor": cursor | {s: p for s, p in positions.items() if s in v.signals()} | {"batch": last}}
        new = Manifest(tick, ms, held, runs, slots, newest)
        dropped = self._merge(new)
        self._commit(new)
        for name in dropped:
            self._fs.delete(self._path(f"{self.root}/{name}"), True)

    def _arrived(self, behind: dict[int, list[Viewer]], landed: list[int], ms: int, keys: dict[str, str]) -> DataFrame | None:
        """Entries that viewers have not seen yet, each with the viewers that it meets: viewers of one cursor share one pass."""
        now, found = datetime.fromtimestamp(ms / 1000, timezone.utc), None
        for at, group in sorted(behind.items()):
            numbers = [b for b in landed if b > at]
            if not numbers:
                continue
            self.was_read += [f"entries/batch={b}" for b in numbers]
            first = (now - timedelta(milliseconds=max(v.lookback_ms for v in group), days=1)).date()
            met = viewers.fan_out(group, self.entries(numbers, first), now)
            named = self.spark.createDataFrame([(v.id, keys[v.id]) for v in group], "viewer_id string, viewer_key string")
            met = met.join(F.broadcast(named), "viewer_id")  # a short row for each definition that the driver holds
            found = met if found is None else found.unionByName(met)
        return found

    def _left(self, known: list[Viewer], before: int | None, ms: int) -> DataFrame | None:
        """Contributions that the clock has passed since ``before``: only slots that hold some are read."""
        if before is None or before == ms or not known:
            return None
        names, due = set(), F.lit(False)
        for lookback in {v.lookback_ms for v in known}:
            low, high = before - lookback, ms - lookback
            names |= {s for s in self.manifest.slots if low // self.slot_ms <= int(s) <= high // self.slot_ms}
            of = [self.manifest.viewers[v.id]["key"] for v in known if v.lookback_ms == lookback]
            due = due | (F.col("viewer_key").isin(of) & (F.col("ms") > low) & (F.col("ms") <= high))
        runs = [name for s in sorted(names) for _, name in self.manifest.slots[s]]
        return self._read(runs, CONTRIBUTION).where(due) if runs else None

    def _write_fresh(self, fresh: DataFrame, known: list[Viewer], keys: dict[str, str], tick: int, slots: dict) -> dict:
        """Writes the contributions of a tick, by slot; the newest position by signal."""
        ms = F.unix_millis("observed_at")
        one = F.col("viewer_key"), ms.alias("ms")
        made = fresh.select(*one, F.lit(None).cast("long").alias("bucket_start_ms"), F.lit(None).cast("array<string>").alias("group_keys"), F.lit(None).cast("double").alias("value"))
        asked: dict = {}
        for v in known:
            if v.aggregation:
                asked.setdefault(v.aggregation, []).append(keys[v.id])
        for agg, of in asked.items():  # viewers of one aggregation have their inputs worked out together
            rows = fresh.where(F.col("viewer_key").isin(of))
            put = viewers.inputs(agg, rows, "viewer_key", ms.alias("ms"))
            put = put.where("value is not null") if agg.fn not in ("count", "rate") else put.withColumn("value", F.lit(None).cast("double"))
            made = made.unionByName(put.select("viewer_key", "ms", "bucket_start_ms", "group_keys", "value"))
        counted = made.groupBy(*KEYS, "ms").agg(F.count(F.lit(1)).alias("n")).withColumn("slot", F.floor(F.col("ms") / self.slot_ms))
        path = f"contributions/tick={tick}"
        counted.select(*KEYS, "n", "ms", "slot").write.mode("overwrite").partitionBy("slot").parquet(f"{self.root}/{path}")
        for name in self._names(path):
            if name.startswith("slot="):
                slots[name[5:]] = [*slots.get(name[5:], []), [0, f"{path}/{name}"]]
        top = fresh.groupBy("signal").agg(F.max(F.struct("stream_ms", "stream_seq")).alias("at")).collect()
        return {r.signal: [r["at"][0], r["at"][1]] for r in top}

    def _write_newest(self, fresh: DataFrame, known: list[Viewer], keys: dict[str, str], tick: int) -> str | None:
        """The newest entries of each viewer that shows them: of those held and those that came."""
        shown = [v.id for v in known if v.aggregation is None]
        if not shown:
            return None
        rows = fresh.where(F.col("viewer_id").isin(shown))
        columns = [c for c in rows.columns if c not in ("batch", "viewer_id")]
        rows = rows.select(*columns)
        if self.manifest.newest:
            rows = rows.unionByName(self._read([self.manifest.newest], rows.schema).where(F.col("viewer_key").isin(list(keys.values()))))
        rank = F.row_number().over(Window.partitionBy("viewer_key").orderBy(F.desc("stream_ms"), F.desc("stream_seq")))
        name = f"newest/tick={tick}"
        rows.withColumn("_rank", rank).where(F.col("_rank") <= NEWEST).drop("_rank").write.mode("overwrite").parquet(f"{self.root}/{name}")
        return name

    # levels

    def _merge(self, new: Manifest) -> list[str]:
        """Merges full levels of the state and of each slot, drops slots that no viewer looks back to; names that nothing reads any more."""
        keys = [v["key"] for v in new.viewers.values()]
        floor = new.clock_ms - max([v["lookback_ms"] for v in new.viewers.values()], default=0)
        dropped = []
        if self.manifest.newest and self.manifest.newest != new.newest:
            dropped.append(self.manifest.newest)
        for slot in [s for s in new.slots if (int(s) + 1) * self.slot_ms <= floor]:
            dropped += [name for _, name in new.slots.pop(slot)]
        for where, schema, group, runs in [("runs", STATE, KEYS, new.runs), *(("slots", CONTRIBUTION, [*KEYS, "ms"], r) for r in new.slots.values())]:
            level = 0
            while any(r[0] >= level for r in runs):
                full = [r for r in runs if r[0] == level]
                if len(full) >= FAN_IN:
                    name = f"merged/{where}-{new.tick}-{level}-{hashlib.sha256(full[0][1].encode()).hexdigest()[:12]}"
                    rows = self._read([n for _, n in full], schema).where(F.col("viewer_key").isin(keys))
                    rows.groupBy(*group).agg(F.sum("n").alias("n")).where("n <> 0").select(*(f.split()[0] for f in schema.split(", "))).write.mode("overwrite").parquet(f"{self.root}/{name}")
                    runs[:] = [*(r for r in runs if r[0] != level), [level + 1, name]]
                    dropped += [n for _, n in full]
                level += 1
        return dropped

    # results

    def state(self) -> DataFrame:
        """viewer_key, bucket_start_ms, group_keys, value, n of all viewers; rows without a bucket count entries."""
        rows = self._read([name for _, name in self.manifest.runs], STATE).where(F.col("viewer_key").isin([v["key"] for v in self.manifest.viewers.values()]))
        return rows.groupBy(*KEYS).agg(F.sum("n").alias("n")).where("n > 0")

    def counts(self) -> DataFrame:
        """viewer_id, count: live entries of the viewers that have any."""
        total = self.state().where("bucket_start_ms is null").groupBy("viewer_key").agg(F.sum("n").alias("count"))
        return total.select(F.regexp_extract("viewer_key", r"^(?s)(.*)\|[^|]*$", 1).alias("viewer_id"), "count")

    def results(self, v: Viewer) -> DataFrame:
        """Buckets of the viewer, or its newest entries, as of the last tick."""
        if v.aggregation is None:
            return self._newest(v)
        agg, by = v.aggregation, ["bucket_start_ms", "group_keys"]
        rows = self.state().where((F.col("viewer_key") == self.manifest.viewers[v.id]["key"]) & F.col("bucket_start_ms").isNotNull())
        if agg.fn[0] != "p":
            n, total = F.sum("n").cast("double"), F.sum(F.col("value") * F.col("n"))
            made = {"count": n, "rate": n / (agg.bucket_ms / 1000), "sum": total, "avg": total / n}[agg.fn]
            return rows.groupBy(*by).agg(made.alias("value")).orderBy(*by)
        # Nearest rank over counted values: a row is a distinct value of its bucket.
        group = Window.partitionBy(*by)
        upto = F.sum("n").over(group.orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        ranked = rows.select(*by, "value", upto.alias("upto"), F.ceil(F.lit(int(agg.fn[1:]) / 100) * F.sum("n").over(group)).alias("rank"))
        return ranked.where("upto >= rank").groupBy(*by).agg(F.min("value").alias("value")).orderBy(*by)

    def _newest(self, v: Viewer) -> DataFrame:
        now = datetime.fromtimestamp(self.manifest.clock_ms / 1000, timezone.utc)
        everything = lambda: viewers.newest(viewers.matching(v, self._seen(v, now), now), NEWEST)
        if not self.manifest.newest:
            return everything()
        held = self.spark.read.parquet(f"{self.root}/{self.manifest.newest}").where(F.col("viewer_key") == self.manifest.viewers[v.id]["key"]).drop("viewer_key")
        live = viewers.within_lookback(held, v.lookback_ms, now)
        count = self.counts().where(F.col("viewer_id") == v.id).first()
        # Where newest entries left before older ones, the older ones are looked up.
        return viewers.newest(live, NEWEST) if live.count() >= min(NEWEST, count["count"] if count else 0) else everything()

    def _seen(self, v: Viewer, now: datetime) -> DataFrame:
        last = self.manifest.viewers[v.id]["cursor"]["batch"]
        return self.entries([b for b in range(last + 1)], (now - timedelta(milliseconds=v.lookback_ms, days=1)).date()).drop("batch")
