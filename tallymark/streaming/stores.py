"""Tables that micro-batches write: a versioned snapshot, and several outputs under one ledger.

Both follow the same rule. A batch writes its files under names of its own, and
then publishes one small file that names them. Until then no reader sees them; a
batch that is replayed after a crash writes the same names again, and one that was
published already changes nothing.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallymark.sources import files

FOLD_EVERY = 8


@dataclass(frozen=True)
class Version:
    batch: int
    base: str | None
    deltas: tuple[str, ...]

    @property
    def parts(self) -> tuple[str, ...]:
        return (*([self.base] if self.base else []), *self.deltas)


class Snapshot:
    """One row per key, kept by folding each batch into what is stored.

    ``fold`` brings rows to one per key; it must not depend on their order, and
    folding folded rows again must change nothing. A batch is stored as a folded
    delta; every ``fold_every`` batches base and deltas become a new base. A read
    folds one base and fewer than ``fold_every`` deltas, however many batches there
    were, and a row is rewritten once in ``fold_every`` batches. Pointer files name
    the parts of a version; parts that neither the current version nor the one
    before it names are deleted, so a reader that has just looked up a version can
    finish.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: StructType, fold: Callable[[DataFrame], DataFrame],
                 fold_every: int = FOLD_EVERY) -> None:
        self.spark, self.folder, self.schema, self.fold, self.fold_every = spark, folder, schema, fold, fold_every

    def _versions(self) -> list[Version]:
        found = [n for n in files.names(self.spark, f"{self.folder}/versions") if n.endswith(".json") and n[0].isdigit()]
        stored = (json.loads(files.read_text(self.spark, f"{self.folder}/versions/{n}")) for n in found[-2:])
        return [Version(v["batch"], v["base"], tuple(v["deltas"])) for v in stored]

    def current(self) -> Version | None:
        versions = self._versions()
        return versions[-1] if versions else None

    def _load(self, parts: tuple[str, ...]) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.folder}/parts/{p}" for p in parts])

    def read(self) -> DataFrame:
        now = self.current()
        if now is None or not now.deltas:
            return self._load(now.parts if now else ())
        return self.fold(self._load(now.parts))

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        now = self.current()
        if now is not None and now.batch >= batch_id:
            return
        delta = f"delta-{batch_id:012d}"
        self.fold(batch).write.mode("overwrite").parquet(f"{self.folder}/parts/{delta}")
        version = Version(batch_id, now.base if now else None, (*(now.deltas if now else ()), delta))
        if len(version.deltas) >= self.fold_every:
            base = f"base-{batch_id:012d}"
            self.fold(self._load(version.parts)).write.mode("overwrite").parquet(f"{self.folder}/parts/{base}")
            version = Version(batch_id, base, ())
        self.commit(version)

    def commit(self, version: Version) -> None:
        text = json.dumps({"batch": version.batch, "base": version.base, "deltas": version.deltas})
        files.publish(self.spark, f"{self.folder}/versions/{version.batch:012d}.json", text)
        self.clean()

    def clean(self) -> None:
        """Delete what the last two versions do not name."""
        versions = self._versions()
        used = {p for v in versions for p in v.parts}
        for part in files.names(self.spark, f"{self.folder}/parts"):
            if part not in used:
                files.remove(self.spark, f"{self.folder}/parts/{part}")
        for name in files.names(self.spark, f"{self.folder}/versions"):
            if name.endswith(".json") and name[0].isdigit() and int(name.split(".")[0]) < versions[0].batch:
                files.remove(self.spark, f"{self.folder}/versions/{name}")


class Outputs:
    """Several tables of one schema that are written together, batch by batch.

    The rows say in ``sink`` where they go, so one pass over a batch writes all of
    them. The ledger holds one line per batch and sink with the rows written; only
    batches in the ledger are read.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: StructType, sinks: tuple[str, ...]) -> None:
        self.spark, self.folder, self.schema, self.sinks = spark, folder, schema, sinks

    def committed(self) -> list[int]:
        return [int(n.split(".")[0]) for n in files.names(self.spark, f"{self.folder}/ledger") if n.endswith(".json") and n[0].isdigit()]

    def write(self, batch_id: int, rows: DataFrame) -> None:
        if batch_id in self.committed():
            return
        path = f"{self.folder}/data/batch_id={batch_id}"
        rows.select("sink", *self.schema.names).write.mode("overwrite").partitionBy("sink").parquet(path)
        wrote = {s: self._load(s, [batch_id]).count() for s in self.sinks}  # from the footers of the files
        lines = [json.dumps({"batch_id": batch_id, "sink": s, "rows": n}) for s, n in wrote.items()]
        files.publish(self.spark, f"{self.folder}/ledger/{batch_id:012d}.json", "\n".join(lines) + "\n")

    def _load(self, sink: str, batches: list[int]) -> DataFrame:
        there = [b for b in batches if f"sink={sink}" in files.names(self.spark, f"{self.folder}/data/batch_id={b}")]
        if not there:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.folder}/data/batch_id={b}/sink={sink}" for b in there])

    def read(self, sink: str) -> DataFrame:
        return self._load(sink, self.committed())

    def ledger(self) -> DataFrame:
        """(batch_id, sink, rows) of every batch that is visible."""
        schema = "batch_id long, sink string, rows long"
        if not self.committed():
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).json(f"{self.folder}/ledger").select(*[F.col(n) for n in ("batch_id", "sink", "rows")])
