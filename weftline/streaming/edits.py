"""Edit logs as streams: batches of edits applied to a table, and windows over events.

A stream's table is kept in buckets by key. A batch writes new files for the buckets that it touches, and then a manifest that says which batch
wrote each bucket; a table is what its last manifest lists. So a lost batch is repeated, a restart goes on from the last manifest, and a batch costs
what its buckets hold, not the table.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.edits import apply_table_edits


class EditedTable:
    """A keyed table under ``folder`` that follows a stream of edits.

    ``start`` begins a new table; without it the table that the folder holds is taken up again, or, where there is none, an empty
    one of ``schema``. ``buckets`` is fixed when the table begins.
    """

    def __init__(self, spark: SparkSession, folder: str, key: str, start: DataFrame | None = None, schema: str | None = None, buckets: int = 64):
        self.spark, self.folder, self.key = spark, folder.rstrip("/"), key
        self.errors = f"{self.folder}/errors"
        found = self._manifests() if start is None else []
        if found:
            self.state = self._load(found[-1])
            return
        if start is None and schema is None:
            raise ValueError(f"no table in {folder}: give its first rows or its schema")
        rows = start if start is not None else spark.createDataFrame([], schema)
        self._delete(f"{self.folder}/manifests")
        self.state = {"batch": -1, "buckets": buckets, "schema": rows.schema.json(), "of": {}}
        self._write(rows, -1, range(buckets))

    # Files, through whatever store the folder is in.

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _delete(self, path: str) -> None:
        fs, p = self._fs(path)
        fs.delete(p, True)

    def _manifests(self) -> list[int]:
        fs, p = self._fs(f"{self.folder}/manifests")
        return sorted(int(s.getPath().getName()) for s in fs.listStatus(p) if s.getPath().getName().lstrip("-").isdigit()) if fs.exists(p) else []

    def _load(self, batch: int) -> dict:
        return json.loads("".join(r.value for r in self.spark.read.text(f"{self.folder}/manifests/{batch}", wholetext=True).collect()))

    def _save(self, batch: int) -> None:
        fs, to = self._fs(f"{self.folder}/manifests/{batch}")
        _, part = self._fs(f"{self.folder}/manifests/_{batch}")
        out = fs.create(part, True)
        out.write(bytearray(json.dumps(self.state).encode()))
        out.close()
        fs.delete(to, True)
        fs.rename(part, to)

    def _bucket(self):
        return F.pmod(F.xxhash64(F.col(f"`{self.key}`")), F.lit(self.state["buckets"]))

    def _write(self, rows: DataFrame, batch: int, touched) -> None:
        path = f"{self.folder}/data/{batch}"
        rows.withColumn("_bucket", self._bucket()).repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(path)
        self.state = self.state | {"batch": batch, "of": self.state["of"] | {str(b): batch for b in touched}}
        self._save(batch)

    @property
    def schema(self):
        from pyspark.sql.types import StructType

        return StructType.fromJson(json.loads(self.state["schema"]))

    def _rows(self, state: dict, only=None) -> DataFrame:
        by: dict[int, list[int]] = {}
        for b, batch in state["of"].items():
            if only is None or int(b) in only:
                by.setdefault(batch, []).append(int(b))
        out = self.spark.createDataFrame([], self.schema)
        for batch, some in sorted(by.items()):
            # Only folders that exist: a bucket may have no rows.
            fs, _ = self._fs(self.folder)
            paths = [f"{self.folder}/data/{batch}/_bucket={b}" for b in some]
            paths = [p for p in paths if fs.exists(self._fs(p)[1])]
            if paths:
                out = out.unionByName(self.spark.read.schema(self.schema).parquet(*paths))
        return out

    def read(self) -> DataFrame:
        return self._rows(self.state)

    def apply(self, log: DataFrame, batch: int) -> None:
        """One batch; the same batch again gives the same table."""
        if batch <= self.state["batch"]:  # repeated after a restart
            before = [b for b in self._manifests() if b < batch]
            self.state = self._load(before[-1])
        log = log.persist()
        touched = sorted(r[0] for r in log.select(self._bucket().alias("b")).distinct().collect())  # as many as there are buckets at most
        done = apply_table_edits(self._rows(self.state, set(touched)), self.key, log)
        done.errors.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{self.errors}/batch={batch}")
        self._write(done.rows, batch, touched)
        log.unpersist()
        self._tidy()

    def _tidy(self) -> None:
        """Forget what neither the last manifest nor the one before it lists."""
        known = self._manifests()
        for batch in known[:-2]:
            self._delete(f"{self.folder}/manifests/{batch}")
        used = {x for m in known[-2:] for x in self._load(m)["of"].values()}
        fs, p = self._fs(f"{self.folder}/data")
        for s in fs.listStatus(p):
            if int(s.getPath().getName()) not in used:
                fs.delete(s.getPath(), True)

    def follow(self, stream: DataFrame, checkpoint: str, **trigger):
        """Start applying a stream of edits (seq, op, key, values)."""
        return stream.writeStream.foreachBatch(lambda df, n: self.apply(df, n)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def windowed_counts(events: DataFrame, time: str, by: list[str], width: str, late: str, slide: str | None = None) -> DataFrame:
    """Counts in tumbling or sliding windows, with a watermark for late rows."""
    return events.withWatermark(time, late).groupBy(F.window(time, width, slide), *by).agg(F.count("*").alias("n"))


def sessions(events: DataFrame, time: str, by: list[str], gap: str, late: str) -> DataFrame:
    return events.withWatermark(time, late).groupBy(F.session_window(time, gap), *by).agg(F.count("*").alias("n"))


def translated(stream: DataFrame, batch_plan: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame, int], None], checkpoint: str):
    """Run a plan over every batch of an edit stream (a lens's translation, say) into a sink."""
    return stream.writeStream.foreachBatch(lambda df, n: sink(batch_plan(df), n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
