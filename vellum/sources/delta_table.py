"""A table of documents' rows that grows by deltas."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.operators.joins import SMALL_ROWS, hinted
from vellum.sources.versions import Versions


class DeltaTable:
    """Rows by key; a batch replaces all rows of its keys.

    A batch is written once, as a run of Parquet files beside the others, with
    a small file of its keys; so what is written follows the batch and not the
    table. A version names the runs it is made of, the oldest first. Readers
    take a key's rows from the last run that has the key. A reader of an older
    version sees that version, also while others write.

    Null keys are one key. A batch with a number that its source has committed
    already changes nothing, so a stream's repeated batch is there once.
    """

    def __init__(self, spark: SparkSession, path: str, key: str = "document_id") -> None:
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        self.versions = Versions(spark, path)

    def folder(self, run: str, part: str) -> str:
        return f"{self.path}/runs/{run}/{part}"

    def replace(self, rows: DataFrame, *, keys: DataFrame | None = None, source: str | None = None, batch: int | None = None) -> int:
        """Commit a batch and return the version. ``keys`` are further keys whose rows go without a replacement."""
        if self.committed(self.versions.state(), source, batch):
            return self.versions.state()["version"]
        run = self.written(rows, keys)

        def step(state: dict) -> dict | None:
            if self.committed(state, source, batch):
                return None
            if source is not None:
                state.setdefault("sources", {})[source] = batch
            return state | {"runs": [*state.get("runs", []), run]}

        return self.versions.change(step)["version"]

    @staticmethod
    def committed(state: dict, source: str | None, batch: int | None) -> bool:
        return source is not None and state.get("sources", {}).get(source, -1) >= batch

    def remove(self, keys: DataFrame) -> int:
        """Commit that rows of ``keys`` are gone."""
        runs = self.versions.state().get("runs", [])
        if not runs:
            return self.versions.state()["version"]
        none = self.spark.read.parquet(self.folder(runs[-1]["name"], "rows")).limit(0)
        return self.replace(none, keys=keys)

    def written(self, rows: DataFrame, keys: DataFrame | None) -> dict:
        """Write a run that no version names yet."""
        name = uuid.uuid4().hex
        rows.write.parquet(self.folder(name, "rows"))
        own = self.spark.read.schema(rows.schema).parquet(self.folder(name, "rows"))
        all_keys = own.select(self.key)
        if keys is not None:
            all_keys = all_keys.unionByName(keys.select(self.key))
        all_keys.distinct().write.parquet(self.folder(name, "keys"))
        return {"name": name, "rows": own.count(), "keys": self.keys(name).count()}

    def keys(self, run: str) -> DataFrame:
        return self.spark.read.parquet(self.folder(run, "keys"))

    def read(self, version: int | None = None) -> DataFrame:
        """The table as of a version, the last one if none is named."""
        runs = self.versions.state(version).get("runs", [])
        if not runs:
            raise ValueError(f"{self.path} has no rows yet")
        return self.merged(runs)

    def merged(self, runs: list[dict]) -> DataFrame:
        """Each key's rows from the last of ``runs`` that has it.

        The oldest run, which is most of the table, only loses the keys of the
        later ones; their keys are broadcast if the version says they are few.
        """
        parts = []
        for place, run in enumerate(runs, 1):
            rows, later = self.spark.read.parquet(self.folder(run["name"], "rows")), runs[place:]
            if later:
                gone = reduce(DataFrame.unionByName, [self.keys(r["name"]) for r in later]).withColumnRenamed(self.key, "_gone")
                rows = rows.join(hinted(gone, sum(r["keys"] for r in later) <= SMALL_ROWS), same(rows[self.key], gone["_gone"]), "left_anti")
            parts.append(rows)
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)

    def compact(self) -> bool:
        """Merge the newest runs into one where a run is no larger than all later ones together.

        So a row is written again only when as much has come after it: about as
        often as the table doubles. False if there is nothing to merge, or if
        another writer merged the same runs first.
        """
        runs = self.versions.state().get("runs", [])
        sizes = [r["rows"] + r["keys"] for r in runs]
        first = next((i for i in range(len(runs) - 1) if sizes[i] <= sum(sizes[i + 1 :])), None)
        if first is None:
            return False
        old = runs[first:]
        keys = None
        if first:  # older rows of these keys stay hidden
            keys = reduce(DataFrame.unionByName, [self.keys(r["name"]) for r in old])
        new, names = self.written(self.merged(old), keys), [r["name"] for r in old]

        def step(state: dict) -> dict | None:
            now = [r["name"] for r in state.get("runs", [])]
            if now[first : first + len(names)] != names:
                return None
            return state | {"runs": [*state["runs"][:first], new, *state["runs"][first + len(names) :]]}

        return any(r["name"] == new["name"] for r in self.versions.change(step).get("runs", []))

    def vacuum(self, keep: int = 2, min_age_seconds: int = 86_400) -> list[str]:
        """Delete runs that none of the last ``keep`` versions has; young ones stay, as a writer may be about to commit them."""
        return self.versions.forget(keep, lambda state: {r["name"] for r in state.get("runs", [])}, "runs", 1000 * min_age_seconds)


def same(a: Column, b: Column) -> Column:
    """Equality under which nulls are equal; Spark joins by it without crossing."""
    return a.eqNullSafe(b)
