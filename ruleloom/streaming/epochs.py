"""Keep an engine's standing program up to date from a stream, one epoch for each micro-batch.

A batch has the relation's columns and may have _sign (positive to add, negative to retract; 1 if absent). Batches may
come again after a failure: an epoch that was applied is skipped. An epoch saves its own signed rows, and each COMPACT-th
all explicit rows, upon which older epochs are removed; a new process starts from the last whole one and applies the
later ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ruleloom.engine import Engine
from ruleloom.operators.relations import consolidate
from ruleloom.pinning import drop_paths


#: So many epochs are replayed at most when a process starts.
COMPACT = 16


class Epochs:
    def __init__(self, engine: Engine, relation: str, folder: str, changes: str | None = None) -> None:
        """folder: for checkpoints and saved rows, in a place that all executors reach. changes: where derived changes are written."""
        self.engine, self.relation, self.folder, self.changes = engine, relation, folder.rstrip("/"), changes
        done = sorted(int(x.split("-")[1]) for x in self._listed(self.folder) if x.startswith("done-"))
        self.applied = max(done, default=-1)
        self.whole = max((n for n in done if self._listed(f"{self.folder}/whole-{n}")), default=-1)
        if self.whole >= 0:
            for name in self._listed(f"{self.folder}/whole-{self.whole}"):
                rows = engine.spark.read.parquet(f"{self.folder}/whole-{self.whole}/{name}")
                engine.update({name: rows.withColumn("_sign", F.lit(1))})
        for n in (n for n in done if n > self.whole):
            engine.update({relation: engine.spark.read.parquet(f"{self.folder}/epoch-{n}")})

    def _listed(self, path: str) -> list[str]:
        jvm = self.engine.spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        fs = where.getFileSystem(self.engine.spark._jsc.hadoopConfiguration())
        return [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []

    def _forget(self, before: int) -> None:
        """Remove what epochs before this one saved."""
        old = [x for x in self._listed(self.folder) if x.split("-")[0] in ("epoch", "whole", "done") and int(x.split("-")[1]) < before]
        drop_paths(self.engine.spark, [f"{self.folder}/{x}" for x in old])

    def apply(self, batch: DataFrame, epoch: int) -> None:
        """One micro-batch; the signature that foreachBatch wants."""
        if epoch <= self.applied:
            return
        if "_sign" not in batch.columns:
            batch = batch.withColumn("_sign", F.lit(1))
        # written before it is used, so that a replay applies the very rows that this process did
        path, batch = f"{self.folder}/epoch-{epoch}", consolidate(batch)
        batch.write.mode("overwrite").parquet(path)
        changed = self.engine.update({self.relation: self.engine.spark.read.schema(batch.schema).parquet(path)})
        if self.changes:
            for name, (added, removed) in changed.items():
                rows = added.withColumn("_sign", F.lit(1)).union(removed.withColumn("_sign", F.lit(-1)))
                rows.write.mode("overwrite").parquet(f"{self.changes}/{name}/epoch={epoch}")
        compact = self.whole < 0 or epoch - self.whole >= COMPACT
        if compact:
            for name, df in self.engine.explicit.items():
                df.write.mode("overwrite").parquet(f"{self.folder}/whole-{epoch}/{name}")
        self.engine.spark.range(0).write.mode("overwrite").parquet(f"{self.folder}/done-{epoch}")
        self.applied = epoch
        if compact:
            self.whole = epoch
            self._forget(epoch)

    def start(self, stream: DataFrame, **trigger) -> StreamingQuery:
        """Run over a streaming DataFrame; trigger: as for DataStreamWriter.trigger, all that is there by default."""
        return stream.writeStream.foreachBatch(self.apply).option("checkpointLocation", f"{self.folder}/checkpoint").trigger(**(trigger or {"availableNow": True})).start()
