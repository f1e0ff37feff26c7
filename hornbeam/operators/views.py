"""Relational algebra on views: the set operators of the language's data model as methods.

A view is a DataFrame with column names of its own (any case) and kinds; every result is a set. Operators check
kinds before they build a plan, and leave the physical choice to Catalyst.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hornbeam import errors as E
from hornbeam.functions import compare
from hornbeam.model import Attribute, Const, Kind, Schema, check_kinds


@dataclass(frozen=True)
class Criterion:
    """attribute op attribute-or-constant; attributes by label or number, constants as Const."""

    left: str | int
    op: str
    right: str | int | Const


class View:
    """``df`` has columns c0, c1, ...; labels are in the schema."""

    def __init__(self, df: DataFrame, schema: Schema):
        self.df, self.schema = df.toDF(*[f"c{i}" for i in range(schema.arity)]), schema

    @classmethod
    def of(cls, df: DataFrame) -> View:
        """The columns of a DataFrame, labelled by their names."""
        return cls(df.distinct(), Schema(tuple(Attribute(f.name, Kind.of_spark(f.dataType)) for f in df.schema.fields)))

    @property
    def labels(self) -> list[str | None]:
        return [a.label for a in self.schema.attributes]

    def frame(self) -> DataFrame:
        return self.df.toDF(*[a.label or f"_{i}" for i, a in enumerate(self.schema.attributes)])

    def _same(self, other: View) -> None:
        if self.schema.arity != other.schema.arity or any(a and b and a is not b for a, b in zip(self.schema.kinds, other.schema.kinds, strict=True)):
            raise E.FactDoesNotConform(f"{self.schema} and {other.schema}")

    def union(self, other: View) -> View:
        self._same(other)
        return View(self.df.union(other.df).distinct(), self.schema)

    extend = union

    def intersection(self, other: View) -> View:
        self._same(other)
        return View(self.df.intersect(other.df), self.schema)

    def difference(self, other: View) -> View:
        self._same(other)
        return View(self.df.subtract(other.df), self.schema)

    def cartesian_product(self, other: View) -> View:
        both = self.schema.attributes + other.schema.attributes
        shared = {a.label for a in self.schema.attributes if a.label} & {a.label for a in other.schema.attributes if a.label}
        if shared:
            raise E.InvalidValue(f"headers share {', '.join(sorted(shared))}; rename first")
        return View(self.df.toDF(*[f"l{i}" for i in range(self.schema.arity)]).crossJoin(other.df), Schema(both))

    def rename(self, **labels: str) -> View:
        for old in labels:
            self.schema.index(old)
        return View(self.df, Schema(tuple(Attribute(labels.get(a.label, a.label), a.kind) for a in self.schema.attributes)))

    def project(self, *columns: str | int) -> View:
        at = [self.schema.index(c) for c in columns]
        if not at:
            raise E.NullaryNotAllowed("a projection needs a column")
        return View(self.df.select(*[f"c{i}" for i in at]).distinct(), Schema(tuple(self.schema.attributes[i] for i in at)))

    def _test(self, c: Criterion, schema: Schema, names: list[str]):
        a = schema.index(c.left)
        b = None if isinstance(c.right, Const) else schema.index(c.right)
        check_kinds(c.op, schema.kinds[a], c.right.kind if b is None else schema.kinds[b])
        return compare.column(c.op, F.col(names[a]), compare.constant(c.right) if b is None else F.col(names[b]))

    def select(self, *criteria: Criterion, negated: bool = False) -> View:
        """All criteria hold, or with ``negated`` not all do."""
        names, test = self.df.columns, F.lit(True)
        for c in criteria:
            test = test & self._test(c, self.schema, names)
        return View(self.df.filter(~test if negated else test), self.schema)

    def natural_join(self, other: View) -> View:
        """On all shared labels; a product if there are none. Columns: this view's, then the other's own."""
        shared = [x for x in self.labels if x and x in other.labels]
        for x in shared:
            check_kinds("=", self.schema.kinds[self.schema.index(x)], other.schema.kinds[other.schema.index(x)])
        left = self.df.toDF(*[f"l{i}" for i in range(self.schema.arity)])
        right = other.df.toDF(*[f"r{i}" for i in range(other.schema.arity)])
        own = [i for i, x in enumerate(other.labels) if x not in shared or x is None]
        test = [left[f"l{self.schema.index(x)}"] == right[f"r{other.schema.index(x)}"] for x in shared]
        both = left.join(right, test) if test else left.crossJoin(right)
        return View(both.select(*left.columns, *[f"r{i}" for i in own]).distinct(), Schema(self.schema.attributes + tuple(other.schema.attributes[i] for i in own)))

    @staticmethod
    def natural_join_all(views: list[View]) -> View:
        out = views[0]
        for v in views[1:]:
            out = out.natural_join(v)
        return out

    def theta_join(self, other: View, *criteria: Criterion) -> View:
        """The product's rows for which all criteria hold; labels must differ. Equalities become join keys."""
        left = self.df.toDF(*[f"l{i}" for i in range(self.schema.arity)])
        right = other.df.toDF(*[f"r{i}" for i in range(other.schema.arity)])
        both = Schema(self.schema.attributes + other.schema.attributes)
        names, test = [*left.columns, *right.columns], F.lit(True)
        for c in criteria:
            test = test & self._test(c, both, names)
        return View(left.join(right, test), both)

    def exists(self, *criteria: Criterion) -> bool:
        return not self.select(*criteria).df.isEmpty()

    def contains(self, *values) -> bool:
        self.schema.check("view", values)
        return self.exists(*[Criterion(i, "=", Const(v)) for i, v in enumerate(values)])

    def count(self) -> int:
        return self.df.count()

    def is_empty(self) -> bool:
        return self.df.isEmpty()

    def text(self, form: str = "text", most: int | None = 1000) -> str:
        """The view as a table for the eye, or as csv, json or pretty json."""
        from hornbeam.sources.formats import print_relation

        return print_relation(self.df, self.schema, form, most)
