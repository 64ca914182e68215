"""Tables of committed batches, with what an incremental load must know of them kept beside the rows.

Under a path: ``batch=<name>/attempt=<id>`` holds rows, ``_marks`` and ``_states`` what is kept of them, ``_commits`` the
manifest, a small file a batch.  A batch is written under an attempt of its own; it counts once its manifest file is there, which
appears whole or not at all and is never overwritten.  Readers take the folders that the manifest names, so an attempt that
died is never seen, and a batch that is given again is found by its name and left out.

Kept are, of each batch, the latest load date, number of rows and number of NULL keys by record source (a few rows), and the
latest state of each parent that the batch touches.  They are published with the rows, by the same file, so they never differ.
After ``fold_after`` batches all of them become one; ``rebuild`` makes them anew from the rows.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..config import VaultConfig
from ..functions.names import quoted
from ..specs import Kept
from . import files
from .bucketed import near_keys


@dataclass(frozen=True)
class CommittedTable:
    """A vault table of committed batches.  key: the hash key (for hubs and links) or the parent's (with hash_diff)."""

    path: str
    key: str | None = None
    hash_diff: str | None = None
    partition_by: tuple[str, ...] = ()
    cfg: VaultConfig = VaultConfig()
    fold_after: int = 64

    # --- the manifest ------------------------------------------------------------------------------------------------------

    def _manifest(self, spark: SparkSession) -> dict:
        """Names of the batches, folders of rows, marks and states, and the schema of the rows."""
        folder = f"{self.path}/_commits"
        found = [n for n in files.names(spark, folder) if n.endswith(".json") and not n.startswith(".")]
        bases = sorted(n for n in found if n.startswith("base-"))
        out = json.loads(files.read_text(spark, f"{folder}/{bases[-1]}")) if bases else {"batches": [], "rows": [], "marks": [], "states": [], "schema": None}
        covered = {f"batch-{b}.json" for b in out["batches"]}
        out["loose"], out["entries"], out["bases"] = 0, [n for n in found if n.startswith("batch-")], bases
        for name in found:
            if name.startswith("batch-") and name not in covered:
                entry = json.loads(files.read_text(spark, f"{folder}/{name}"))
                for part in ("batches", "rows", "marks", "states"):
                    out[part] += entry[part]
                out["schema"] = out["schema"] or entry["schema"]
                out["loose"] += 1
        return out

    def batches(self, spark: SparkSession) -> list[str]:
        """The names of the committed batches."""
        return self._manifest(spark)["batches"]

    def committed(self, spark: SparkSession, batch: str | int) -> bool:
        return str(batch) in self.batches(spark)

    # --- writing -----------------------------------------------------------------------------------------------------------

    def commit(self, delta: DataFrame, batch: str | int) -> bool:
        """Writes and publishes a batch; False if its name is committed already, whoever did it."""
        spark, batch = delta.sparkSession, str(batch)
        if self.committed(spark, batch):
            return False
        self._check(spark, delta)
        attempt = uuid.uuid4().hex
        folder = self._write(delta, batch, attempt)
        rows = self._read(spark, delta.schema, [folder])
        entry = {"batches": [batch], "rows": [folder], "schema": delta.schema.jsonValue()} | self._keep(rows, f"{batch}-{attempt}")
        if not files.publish(spark, f"{self.path}/_commits/batch-{batch}.json", json.dumps(entry)):
            files.delete(spark, folder)
            return False
        for other in files.names(spark, f"{self.path}/batch={batch}"):  # attempts that died
            if other != f"attempt={attempt}":
                files.delete(spark, f"{self.path}/batch={batch}/{other}")
        if self._manifest(spark)["loose"] >= self.fold_after:
            self._rebase(spark, self.marks(spark), self.states(spark))
        return True

    def _check(self, spark: SparkSession, delta: DataFrame) -> None:
        known = self._manifest(spark)["schema"]
        if known and {(f.name, f.dataType) for f in StructType.fromJson(known)} != {(f.name, f.dataType) for f in delta.schema}:
            raise ValueError(f"the delta has {delta.schema.simpleString()}, the table {StructType.fromJson(known).simpleString()}")

    def _write(self, delta: DataFrame, batch: str, attempt: str) -> str:
        folder = f"{self.path}/batch={batch}/attempt={attempt}"
        delta.write.partitionBy(*self.partition_by).parquet(folder)
        return folder

    def load(self, spark: SparkSession, batch: str | int, delta: Callable[[Kept | None], DataFrame], near: DataFrame | None = None) -> bool:
        """Commits delta(target as it is, None before the first batch), which isn't computed if the batch is there.

        near: as for target().
        """
        return not self.committed(spark, batch) and self.commit(delta(self.target(spark, near)), batch)

    def _keep(self, rows: DataFrame, name: str) -> dict:
        """Writes what is kept of some rows."""
        out: dict = {"marks": [], "states": []}
        if self.key:
            out["marks"] = [f"{self.path}/_marks/{name}"]
            self.marks_of(rows).coalesce(1).write.parquet(out["marks"][0])
        if self.hash_diff:
            out["states"] = [f"{self.path}/_states/{name}"]
            self.states_of(rows).write.parquet(out["states"][0])
        return out

    def _rebase(self, spark: SparkSession, marks: DataFrame | None, states: DataFrame | None) -> None:
        now, name = self._manifest(spark), uuid.uuid4().hex
        base = {k: now[k] for k in ("batches", "rows", "schema")} | {"marks": [], "states": []}
        for part, df in (("marks", marks), ("states", states)):
            if df is not None:
                base[part] = [f"{self.path}/_{part}/base-{name}"]
                (df.coalesce(1) if part == "marks" else df).write.parquet(base[part][0])
        self._publish_base(spark, now, base)

    def _publish_base(self, spark: SparkSession, now: dict, base: dict) -> None:
        """A file that stands for all batches it names."""
        # names sort by the number of batches and then by age, so the fullest base, and of these the newest, is the last
        number = len(now["bases"])
        files.publish(spark, f"{self.path}/_commits/base-{len(base['batches']):012}-{number:06}-{uuid.uuid4().hex}.json", json.dumps(base))
        if number:  # what the base before this one covers; readers may still be at what this one does
            older = set(json.loads(files.read_text(spark, f"{self.path}/_commits/{now['bases'][-1]}"))["batches"])
            for entry in now["entries"]:
                if entry.removeprefix("batch-").removesuffix(".json") in older:
                    files.delete(spark, f"{self.path}/_commits/{entry}")

    def replace(self, rows: DataFrame, batch: str | int) -> bool:
        """Rows that stand in place of those of all batches so far, as a batch of their own; False if its name is committed.

        No other batch should be committed meanwhile.  The files of the replaced rows stay, for readers that are at them.
        """
        spark, batch = rows.sparkSession, str(batch)
        now = self._manifest(spark)
        if batch in now["batches"]:
            return False
        self._check(spark, rows)
        attempt = uuid.uuid4().hex
        folder = self._write(rows, batch, attempt)
        kept = self._keep(self._read(spark, rows.schema, [folder]), f"{batch}-{attempt}")
        self._publish_base(spark, now, {"batches": [*now["batches"], batch], "rows": [folder], "schema": rows.schema.jsonValue()} | kept)
        return True

    def rebuild(self, spark: SparkSession) -> None:
        """Makes marks and states anew from the rows."""
        rows = self.rows(spark)
        if rows is not None:
            self._rebase(spark, self.marks_of(rows) if self.key else None, self.states_of(rows) if self.hash_diff else None)

    # --- reading -----------------------------------------------------------------------------------------------------------

    def rows(self, spark: SparkSession) -> DataFrame | None:
        """The rows of all committed batches; None before the first."""
        now = self._manifest(spark)
        return self._read(spark, StructType.fromJson(now["schema"]), now["rows"]) if now["rows"] else None

    def _read(self, spark: SparkSession, schema: StructType, folders: list[str]) -> DataFrame:
        reader = spark.read.schema(schema)
        if not self.partition_by:
            return reader.parquet(*folders)
        # partition columns are found below a common base, which has those of batches and attempts as well
        return reader.option("basePath", self.path).parquet(*folders).select(*map(quoted, schema.names))

    def target(self, spark: SparkSession, near: DataFrame | None = None) -> Kept | None:
        """The table as the target of a load.

        near: rows with the table's key, of a load that is small beside the table: of the table's rows and states only those are
        passed on whose key may be among them (see near_keys); marks are of all rows.
        """
        now = self._manifest(spark)
        if not now["rows"]:
            return None
        rows = self._read(spark, StructType.fromJson(now["schema"]), now["rows"])
        rows = rows if near is None else near_keys(rows, near, self.key)
        return Kept(rows, self._marks(spark, now), self._states(spark, now, near))

    def marks(self, spark: SparkSession) -> DataFrame | None:
        """A row a record source: its latest load date (but for the end of all times), rows and NULL keys."""
        return self._marks(spark, self._manifest(spark))

    def _marks(self, spark: SparkSession, now: dict) -> DataFrame | None:
        if not now["marks"]:
            return None
        ldts, rsrc = (quoted(c) for c in (self.cfg.ldts_alias, self.cfg.rsrc_alias))
        return spark.read.parquet(*now["marks"]).groupBy(rsrc).agg(F.max(ldts).alias(self.cfg.ldts_alias), F.sum("n").alias("n"), F.sum("nulls").alias("nulls"))

    def marks_of(self, rows: DataFrame) -> DataFrame:
        ldts = F.col(quoted(self.cfg.ldts_alias))
        live = ldts != F.lit(self.cfg.end_of_all_times).cast(rows.schema[self.cfg.ldts_alias].dataType)
        return rows.groupBy(quoted(self.cfg.rsrc_alias)).agg(F.max(F.when(live, ldts)).alias(self.cfg.ldts_alias), F.count(F.lit(1)).alias("n"), F.count_if(F.col(quoted(self.key)).isNull()).alias("nulls"))

    def states(self, spark: SparkSession) -> DataFrame | None:
        """A row a parent: the load date and hash diff of its latest row."""
        return self._states(spark, self._manifest(spark))

    def _states(self, spark: SparkSession, now: dict, near: DataFrame | None = None) -> DataFrame | None:
        if not now["states"]:
            return None
        found = spark.read.parquet(*now["states"])
        return self.states_of(found if near is None else near_keys(found, near, self.key))

    def states_of(self, rows: DataFrame) -> DataFrame:
        ldts, diff = self.cfg.ldts_alias, self.hash_diff
        latest = F.max(F.struct(F.col(quoted(ldts)).alias("ldts"), F.col(quoted(diff)).alias("diff")))  # NULL is below all
        return rows.groupBy(quoted(self.key)).agg(latest.alias("latest")).select(quoted(self.key), F.col("latest.ldts").alias(ldts), F.col("latest.diff").alias(diff))
