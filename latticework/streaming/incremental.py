"""Keeping a catalogue up to date from a stream of file changes.

A change is (path, text, ts); a null text deletes the file.  Within a batch the
last change of a path counts.  Writes that this engine made itself are
suppressed by (path, content) until they expire.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.catalog import extract
from latticework.cluster import shared_dir, stored
from latticework.operators.diff import unit_diff
from latticework.operators.graph import first_by
from latticework.schema import IGNORED_PARTS, LANGUAGES
from latticework.sources.files import extension, with_language

CHANGE = "path string, text string, ts timestamp"
SUPPRESS_SECONDS = 5


def watched(path: Column, excluded: tuple[str, ...] = IGNORED_PARTS) -> Column:
    """Source files outside excluded folders; files without an extension stay."""
    ext = extension(path)
    out = (ext == "") | ext.isin(*LANGUAGES)
    for part in excluded:
        out = out & ~F.contains(F.concat(F.lit("/"), path), F.lit(part))
    return out


def suppressed(changes: DataFrame, writes: DataFrame, seconds: int = SUPPRESS_SECONDS) -> DataFrame:
    """changes without those of writes (path, content_hash, ts): the same content, no later than seconds after."""
    w = writes.select(F.col("path").alias("w_path"), F.col("content_hash").alias("w_hash"), F.col("ts").alias("w_ts"))
    mine = (F.col("path") == F.col("w_path")) & (F.substring(F.sha2(F.coalesce("text", F.lit("")), 256), 1, 16) == F.col("w_hash")) & (F.col("ts") >= F.col("w_ts")) & (F.col("ts") <= F.col("w_ts") + F.expr(f"interval {seconds} seconds"))
    return changes.join(w, mine, "left_anti")


def latest(changes: DataFrame) -> DataFrame:
    """The last change of each path."""
    return first_by(changes, ["path"], F.desc("ts"), F.col("text").desc_nulls_last())


def read_changes(spark: SparkSession, folder: str, max_files: int = 1000) -> DataFrame:
    """Change files (JSON lines) as they appear in a folder."""
    return spark.readStream.schema(CHANGE).option("maxFilesPerTrigger", max_files).json(folder).where(watched(F.col("path")))


class UnitStore:
    """The units table as deltas in the shared folder: a batch writes only what changed, readers merge by path.

    Version v of generation g is units/v (the new units of the changed files) and
    then paths/v (the changed paths, deleted ones too), whose success marker
    commits it.  The current units of a path are those of its last version.
    Compaction writes a new generation of one version and drops the others.  A
    batch that runs again under its id changes nothing.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark = spark
        self.folder = (folder or f"{shared_dir(spark)}/units-{uuid.uuid4().hex}").rstrip("/")

    def _listed(self, folder: str, prefix: str, committed: str) -> list[int]:
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(folder)
        fs = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(at):
            return []
        names = [x.getPath().getName() for x in fs.listStatus(at)]
        return sorted(int(n[len(prefix) :]) for n in names if n.startswith(prefix) and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}{committed}")))

    def _generation(self) -> int:
        return max([0, *self._listed(self.folder, "g=", "/_DONE/_SUCCESS")])

    def _versions(self, generation: int | None = None) -> list[int]:
        g = self._generation() if generation is None else generation
        return self._listed(f"{self.folder}/g={g}/paths", "v=", "/_SUCCESS")

    def current(self) -> DataFrame | None:
        """The merged table, or None before the first batch."""
        g = self._generation()
        found = self._versions(g)
        if not found:
            return None

        def read(part):
            base = f"{self.folder}/g={g}/{part}"
            return self.spark.read.option("basePath", base).parquet(*[f"{base}/v={v}" for v in found])

        last = read("paths").groupBy("path").agg(F.max("v").alias("v"))
        units = read("units")
        return units.join(last, ["path", "v"], "left_semi").select(*[c for c in units.columns if c != "v"])

    def _write(self, generation: int, version: int, units: DataFrame, paths: DataFrame) -> None:
        base = f"{self.folder}/g={generation}"
        units.write.mode("overwrite").parquet(f"{base}/units/v={version}")
        paths.select("path").write.mode("overwrite").parquet(f"{base}/paths/v={version}")

    def upsert(self, changes: DataFrame, batch_id: int, on_diff=None) -> None:
        """Replace the changed files' units; on_diff(batch_id, diff) sees inserts, modifications and removals."""
        g = self._generation()
        if any(v >= batch_id for v in self._versions(g)):
            return
        last = stored(latest(changes), "changes")  # a stream's batch may be read once only
        old = self.current()
        self._write(g, batch_id, extract(with_language(last.where("text is not null"))), last)
        if on_diff is not None and old is not None:
            fresh = self.spark.read.parquet(f"{self.folder}/g={g}/units/v={batch_id}")
            on_diff(batch_id, unit_diff(old.join(last.select("path"), "path", "left_semi"), fresh))

    def compact(self) -> None:
        """Merge all versions into one."""
        g, found, now = self._generation(), self._versions(), self.current()
        if len(found) < 2:
            return
        self._write(g + 1, found[-1], now, now.select("path").distinct())
        self.spark.range(1).write.mode("overwrite").parquet(f"{self.folder}/g={g + 1}/_DONE")
        jvm = self.spark._jvm
        old = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/g={g}")
        old.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(old, True)


def follow(changes: DataFrame, store: UnitStore, checkpoint: str, debounce: str = "100 milliseconds", once: bool = False, on_diff=None):
    """Start the stream that keeps a store; debounce is the trigger's interval."""
    writer = changes.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, i: store.upsert(df, i, on_diff))
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=debounce)).start()


def windowed_counts(events: DataFrame, width: str = "1 day", late: str = "1 hour", ts: str = "ts", by: str = "event_type") -> DataFrame:
    """(window_start, by, n) of tumbling windows; on a stream, rows later than the watermark are dropped."""
    marked = events.withWatermark(ts, late) if events.isStreaming else events
    return marked.groupBy(F.window(ts, width).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), by, "n")


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "1 hour", ts: str = "ts", key: str = "user_id") -> DataFrame:
    """(key, session_start, n): runs of events of a key without a pause of gap."""
    marked = events.withWatermark(ts, late) if events.isStreaming else events
    return marked.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("session_start"), "n")
