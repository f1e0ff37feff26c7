"""Maintaining derived relations while facts arrive: micro-batches of Structured Streaming, or any sequence of batches.

For programs without negation the derived relations only grow, so a batch needs the rounds that its new facts cause and no
more. State lives in Parquet parts in the shared folder; use ``apply`` in ``foreachBatch``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hornbeam import errors as E
from hornbeam.plans import rules as R
from hornbeam.plans.fixpoint import _union
from hornbeam.plans.storage import Steps
from hornbeam.program import Program, conform


class Incremental:
    def __init__(self, program: Program, spark: SparkSession):
        self.rules = program.evaluable_rules()
        if not all(r.is_positive for r in self.rules):
            raise E.FeatureUnsupported("derived facts may have to be withdrawn where there is negation")
        self.program, self.spark, self.schemas = program, spark, program.typed()
        self.state = {p: Steps(spark, s.spark()) for p, s in self.schemas.items()}
        self.batches: set[int] = set()
        start = {p: r.frame(spark, self.schemas[p]) for p, r in program.extensional.items() if r.facts or r.frames}
        self._grow(start)

    def relation(self, label: str) -> DataFrame:
        return self.state[label].whole

    def apply(self, label: str, batch: DataFrame, batch_id: int | None = None) -> None:
        """Adds new facts of an extensional relation. A batch id that was applied before has no effect, so retries are safe."""
        if label not in self.program.extensional:
            raise E.RelationDoesNotExist(label)
        if batch_id is not None and batch_id in self.batches:
            return
        self._grow({label: conform(batch, self.schemas[label], label)})
        if batch_id is not None:
            self.batches.add(batch_id)

    def sink(self, label: str):
        """For ``stream.writeStream.foreachBatch(...)``."""
        return lambda batch, batch_id: self.apply(label, batch, batch_id)

    def _grow(self, fresh: dict[str, DataFrame]) -> None:
        new = self._keep(fresh)
        while new:
            known = {p: s.whole for p, s in self.state.items()}
            made: dict[str, list[DataFrame]] = {}
            for r in self.rules:
                for i, a in enumerate(r.positive_atoms):
                    if a.predicate in new:
                        rows = R.body(self.spark, r, lambda b, k, i=i: new[b.predicate] if k == i else known[b.predicate], i)
                        made.setdefault(r.head[0].predicate, []).append(R.head(rows, r, r.head[0]))
            new = self._keep({p: _union(parts) for p, parts in made.items()})

    def _keep(self, cand: dict[str, DataFrame]) -> dict[str, DataFrame]:
        """Stores what is new of each relation, and returns it."""
        out = {}
        for p, df in cand.items():
            part, n = self.state[p].add(df.distinct().join(self.state[p].whole, df.columns, "left_anti"))
            if n:
                out[p] = part
        return out
