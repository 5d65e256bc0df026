"""Work that several workers share: documents are claimed, and done once."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.operators.joins import hinted, is_small
from vellum.sources.delta_table import DeltaTable, same


class Lost(Exception):
    """The lease has ended, and another worker may have the documents."""


class LeasedTable(DeltaTable):
    """A ``DeltaTable`` of results whose documents workers claim by lease.

    A claim is a file of keys that a version names, with its worker, its end and
    a fencing number that only grows. The version is committed against the one
    that was read, so two workers never hold one document. Results are committed
    in the step that ends the lease and are refused once the lease is gone: a
    worker that was thought dead can't overwrite what its successor did.
    """

    def claims(self, leases: dict[str, dict]) -> list[DataFrame]:
        return [self.spark.read.parquet(f"{self.path}/claims/{lease['name']}") for lease in leases.values()]

    def claim(self, candidates: DataFrame, worker: str, *, most: int, now: float, seconds: float, order: str | None = None) -> int | None:
        """Claim up to ``most`` of the candidates, the least by ``order`` (the key if none is named) first; the fencing number, or None.

        Left out are documents with a live lease, documents with results, and
        null keys. Leases that ended by ``now`` are gone.
        """
        got: list[int] = []

        def step(state: dict) -> dict | None:
            got.clear()
            leases = {f: x for f, x in state.get("leases", {}).items() if x["until"] > now}
            taken = [*self.claims(leases), *(self.keys(r["name"]) for r in state.get("runs", []))]
            free = candidates.filter(F.col(self.key).isNotNull()).groupBy(self.key).agg(F.min(order or self.key).alias("_order"))
            if taken:
                gone = reduce(DataFrame.unionByName, taken).withColumnRenamed(self.key, "_gone")
                free = free.join(hinted(gone, is_small(gone)), same(free[self.key], gone["_gone"]), "left_anti")
            name = uuid.uuid4().hex
            free.orderBy("_order", self.key).limit(most).select(self.key).write.parquet(f"{self.path}/claims/{name}")
            if self.spark.read.parquet(f"{self.path}/claims/{name}").isEmpty():
                return None
            got.append(state.get("fence", 0) + 1)
            return state | {"fence": got[0], "leases": leases | {str(got[0]): {"name": name, "worker": worker, "until": now + seconds}}}

        self.versions.change(step)
        return got[0] if got else None

    def claimed(self, fence: int) -> DataFrame:
        """The keys of a lease."""
        lease = self.versions.state().get("leases", {}).get(str(fence))
        if lease is None:
            raise Lost(f"lease {fence}")
        return self.spark.read.parquet(f"{self.path}/claims/{lease['name']}")

    def changed(self, fence: int, change) -> int:  # noqa: ANN001
        def step(state: dict) -> dict:
            lease = state.get("leases", {}).pop(str(fence), None)
            if lease is None:
                raise Lost(f"lease {fence}")
            return change(state, lease)

        return self.versions.change(step)["version"]

    def beat(self, fence: int, *, now: float, seconds: float) -> int:
        """A sign of life: the lease goes on."""
        return self.changed(fence, lambda state, lease: state | {"leases": state["leases"] | {str(fence): lease | {"until": now + seconds}}})

    def release(self, fence: int) -> int:
        """Give the documents back."""
        return self.changed(fence, lambda state, lease: state)

    def finish(self, fence: int, rows: DataFrame) -> int:
        """Commit the results of a lease, and that its documents are done, also those without a row."""
        run = self.written(rows.join(self.claimed(fence), self.key, "left_semi"), self.claimed(fence))
        return self.changed(fence, lambda state, lease: state | {"runs": [*state.get("runs", []), run]})
