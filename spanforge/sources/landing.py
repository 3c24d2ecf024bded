"""The append log: landed entries as Parquet, by batch, signal and day.

A batch gets its number by the atomic creation of a file, is written under that number into every table, and counts
once it is committed: readers leave out numbers that are reserved only.  A batch that comes again under its key
overwrites what a failure left of it, and does nothing if it was committed.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import RAW_ENTRY

PARTITIONS = ("signal", "day")
SIGNALS = ("traces", "metrics", "logs")


def append(entries: DataFrame, path: str) -> None:
    """Appends entries; a task failure leaves nothing behind, so a retry is safe."""
    entries.withColumn("day", F.to_date("observed_at")).write.mode("append").partitionBy(*PARTITIONS).parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Entries with partition pruning on signal and day; an empty service name is none."""
    return spark.read.parquet(path).withColumn("service_name", F.nullif(F.col("service_name"), F.lit("")))


@dataclass(frozen=True)
class Batch:
    number: int
    ms: int
    key: str
    committed: bool


class Log:
    """The numbered batches below ``root``: names of files say all, so one listing reads the log."""

    def __init__(self, spark: SparkSession, root: str):
        self.root = f"{root.rstrip('/')}/commits"
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def batches(self) -> list[Batch]:
        if not self._fs.exists(self._path(self.root)):
            return []
        found = {}
        for status in self._fs.listStatus(self._path(self.root)):
            number, ms, key, state = status.getPath().getName().split(".")
            if int(number) not in found or state == "done":
                found[int(number)] = Batch(int(number), int(ms), key, state == "done")
        return [found[n] for n in sorted(found)]

    def reserve(self, ms: int, key: str | None = None) -> Batch:
        """The batch of this key, or a new one; its time is not before that of any earlier batch."""
        while True:
            known = self.batches()
            name = hashlib.sha256(key.encode()).hexdigest()[:32] if key is not None else "-"
            same = [b for b in known if key is not None and b.key == name]
            if same:
                return same[0]
            batch = Batch(known[-1].number + 1 if known else 0, max([ms, *(b.ms for b in known[-1:])]), name, False)
            try:
                # The lock is the number alone: two writers cannot both create it.
                self._fs.create(self._path(f"{self.root}-locks/{batch.number:012d}"), False).close()
            except Py4JJavaError as e:
                if "AlreadyExists" not in str(e.java_exception) and "already exists" not in str(e.java_exception):
                    raise
                continue
            self._fs.create(self._path(f"{self.root}/{batch.number:012d}.{batch.ms}.{name}.open"), True).close()
            return batch

    def commit(self, batch: Batch) -> None:
        name = f"{self.root}/{batch.number:012d}.{batch.ms}.{batch.key}"
        self._fs.rename(self._path(f"{name}.open"), self._path(f"{name}.done"))

    def floors(self) -> dict[str, tuple[int, int]]:
        """By signal, the id of the oldest entry that retention kept at the last ingest."""
        folder = self._path(f"{self.root}-floors")
        found: dict[str, tuple[int, int]] = {}
        for status in self._fs.listStatus(folder) if self._fs.exists(folder) else ():
            signal, ms, seq = status.getPath().getName().split(".")
            found[signal] = max(found.get(signal, (0, 0)), (int(ms), int(seq)))
        return found

    def note_floors(self, floors: dict[str, tuple[int, int]]) -> None:
        """Floors only rise; the names of files say all, and what is below the highest is cleared."""
        before = self.floors()
        for signal, at in floors.items():
            if at <= before.get(signal, (-1, -1)):
                continue
            self._fs.create(self._path(f"{self.root}-floors/{signal}.{at[0]}.{at[1]}"), True).close()
            if signal in before:
                old = before[signal]
                self._fs.delete(self._path(f"{self.root}-floors/{signal}.{old[0]}.{old[1]}"), False)

    def delete_below(self, table: str, number: int, part: str) -> None:
        """Deletes what a table (or the part of it) holds of batches before ``number``, and batches that are then empty."""
        path = self._path(table)
        for status in self._fs.listStatus(path) if self._fs.exists(path) else ():
            name = status.getPath().getName()
            if name.startswith("batch=") and int(name[6:]) < number:
                self._fs.delete(self._path(f"{table}/{name}{part}"), True)
                left = self._path(f"{table}/{name}")
                if part and not any(s.getPath().getName().startswith("signal=") for s in self._fs.listStatus(left)):
                    self._fs.delete(left, True)

    def whole(self, df: DataFrame) -> DataFrame:
        """The rows of committed batches."""
        open_ = [b.number for b in self.batches() if not b.committed]
        return (df.where(~F.col("batch").isin(open_)) if open_ else df).drop("batch")


def with_ids(df: DataFrame, batch: Batch) -> DataFrame:
    """stream_ms and stream_seq of a batch's entries: its time and a number that grows with the batch and within it.

    The number holds the batch (23 bits), the partition (16) and the row in it (24); what does not fit fails.
    """
    row = F.monotonically_increasing_id()
    part, nth = F.shiftrightunsigned(row, 33), row.bitwiseAND((1 << 33) - 1)
    fits = (part < (1 << 16)) & (nth < (1 << 24))
    seq = F.when(fits, F.lit(batch.number << 40) + F.shiftleft(part, 24) + nth).otherwise(F.raise_error(F.lit("too many rows in a batch of requests")).cast("long"))
    return df.withColumn("stream_ms", F.lit(batch.ms).cast("long")).withColumn("stream_seq", seq)


def stream_id(ms, seq):
    return F.concat_ws("-", ms.cast("string"), seq.cast("string"))


def parse_stream_id(text) -> tuple:
    """(ms, seq) of ``<ms>-<seq>`` as columns; both null where the text is none."""
    ok = text.rlike(r"^[0-9]+-[0-9]+$")
    part = F.split(text, "-")
    return F.when(ok, F.get(part, F.lit(0)).try_cast("bigint")), F.when(ok, F.get(part, F.lit(1)).try_cast("bigint"))


def floors(entries: DataFrame, n: int) -> dict[str, tuple[int, int]]:
    """By signal, the id of the n-th newest entry, for signals that have as many; a top-n of ids, no window over all rows."""
    out = {}
    for signal in SIGNALS:
        ids = entries.where(F.col("signal") == signal).select("stream_ms", "stream_seq")
        row = ids.orderBy(F.desc("stream_ms"), F.desc("stream_seq")).offset(n - 1).limit(1).first()
        if row is not None:
            out[signal] = (row[0], row[1])
    return out


def above(floor: dict[str, tuple[int, int]], signal: Column, ms: Column, seq: Column) -> Column:
    """Whether an entry is kept: not older than its signal's floor."""
    kept = F.lit(True)
    for name, (at, nth) in sorted(floor.items()):
        kept = kept & ((signal != name) | (ms > at) | (ms == at) & (seq >= nth))
    return kept


def newest_per_signal(entries: DataFrame, n: int = 100_000) -> DataFrame:
    """What retention keeps: the newest ``n`` entries of each signal."""
    w = Window.partitionBy("signal").orderBy(F.desc("stream_ms"), F.desc("stream_seq"))
    return entries.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """Landed raw entries as they arrive."""
    return spark.readStream.schema(RAW_ENTRY).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
