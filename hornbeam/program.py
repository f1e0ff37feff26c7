"""A program: relations, rules, queries, and how to run it on Spark."""

from __future__ import annotations

import logging
import os
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hornbeam import errors as E
from hornbeam.analysis import Precedence, arity, check_safety, infer_kinds
from hornbeam.features import Features
from hornbeam.model import ANY, Atom, Attribute, Comparison, Const, Dependency, Kind, Literal, Query, Rule, Schema, Var, check_kinds, term
from hornbeam.plans import rules as R
from hornbeam.plans.fixpoint import Evaluator, SemiNaive

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class FileBinding:
    path: str
    format: str = "csv"
    options: tuple[tuple[str, object], ...] = ()


class Relation:
    """A label, a schema, facts given one by one, and DataFrames. A set: duplicates have no effect."""

    def __init__(self, label: str, schema: Schema):
        self.label, self.schema = label, schema
        self.facts: dict[tuple, None] = {}
        self.frames: list[DataFrame] = []
        #: The only frame has no repeated rows, so scans need no shuffle to drop them.
        self.is_set = False
        self.input: FileBinding | None = None
        self.output: FileBinding | None = None

    def add(self, *values) -> bool:
        """False if the fact is there already."""
        key = self.schema.check(self.label, values)
        if any(k is None for k in self.schema.kinds):
            self.schema = self.schema.merged(Schema(tuple(Attribute(None, Kind.of(v)) for v in values)))
        if key in self.facts:
            return False
        self.facts[key] = None
        return True

    def extend(self, rows: Iterable[tuple]) -> int:
        """Adds facts; how many were new."""
        return sum([self.add(*r) for r in rows])

    def frame(self, spark: SparkSession, schema: Schema | None = None) -> DataFrame:
        schema = schema or self.schema
        parts = [conform(f, schema, self.label) for f in self.frames]
        if self.facts or not parts:
            parts.append(spark.createDataFrame(list(self.facts), schema.spark()))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out if self.is_set and len(self.frames) == 1 and not self.facts else out.distinct()


def conform(df: DataFrame, schema: Schema, label: str, on_null: str = "drop") -> DataFrame:
    """Columns by position, as c0, c1, ..., of the relation's kinds. The model has no nulls: rows with one are left out, or fail the job."""
    if len(df.columns) != schema.arity:
        raise E.FactDoesNotConform(f"{label} has {schema.arity} columns, not {len(df.columns)}")
    out = []
    for i, (f, k) in enumerate(zip(df.schema.fields, schema.kinds, strict=True)):
        own = Kind.of_spark(f.dataType)
        if k is not None and own is not k:
            raise E.FactDoesNotConform(f"{label}: {f.name} is of kind {own.value}, not {k.value}")
        out.append((f.name, f"c{i}", own))
    df = df.toDF(*[c for _, c, _ in out])
    bad = F.lit(False)
    for _, c, k in out:
        bad = bad | F.col(c).isNull() | (F.isnan(c) if k is Kind.FLOAT else F.lit(False))
    df = df.filter(~bad) if on_null == "drop" else df.filter(F.assert_true(~bad, f"{label} holds a null").isNull())
    return df.select(*[F.col(c).cast(k.spark).alias(c) for _, c, k in out])


class Program:
    def __init__(self, features: Features = Features.NONE, folder: str | None = None, disjunction: str = "reject"):
        """disjunction: "split" reads p ; q :- b as two rules; otherwise such rules are not evaluated."""
        self.features, self.folder, self.disjunction = features, folder, disjunction
        self.extensional: dict[str, Relation] = {}
        self.intensional: dict[str, Relation] = {}
        self.rules: list[Rule] = []
        self.queries: list[Query] = []

    # relations

    def _new(self, label: str, schema: Schema, into: dict, other: dict) -> Relation:
        Atom(label, (ANY,))
        if label in into:
            raise E.RelationExists(label)
        if label in other:
            raise E.ExtensionalInHead(f"{label} cannot be given and derived")
        into[label] = Relation(label, schema)
        return into[label]

    def declare_extensional(self, label: str, schema: Schema) -> Relation:
        return self._new(label, schema, self.extensional, self.intensional)

    def declare_intensional(self, label: str, schema: Schema) -> Relation:
        return self._new(label, schema, self.intensional, self.extensional)

    def relation(self, label: str) -> Relation:
        found = self.intensional.get(label) or self.extensional.get(label)
        if found is None:
            raise E.RelationDoesNotExist(label)
        return found

    def schema(self, label: str) -> Schema:
        return self.relation(label).schema

    def extensional_schema(self, label: str) -> Schema:
        if label not in self.extensional:
            raise E.RelationDoesNotExist(label)
        return replace(self.extensional[label].schema, dependencies=())

    def add_fact(self, label: str, *values) -> bool:
        if label not in self.extensional:
            self.declare_extensional(label, Schema(tuple(Attribute(None, Kind.of(v)) for v in values)))
        return self.extensional[label].add(*values)

    def add_frame(self, label: str, df: DataFrame, labels: Iterable[str] | None = None, is_set: bool = False) -> Relation:
        """A DataFrame as (part of) an extensional relation, columns by position; ``is_set`` says that it has no repeated rows."""
        kinds = [Kind.of_spark(f.dataType) for f in df.schema.fields]
        own = Schema(tuple(Attribute(n, k) for n, k in zip(labels or [None] * len(kinds), kinds, strict=True)))
        if label not in self.extensional:
            self.declare_extensional(label, own)
        found = self.extensional[label]
        found.schema = found.schema.merged(own)
        conform(df, found.schema, label)
        found.frames.append(df)
        found.is_set = is_set and len(found.frames) == 1
        return found

    def extend(self, label: str, rows: Iterable[tuple]) -> int:
        """Adds facts to a given relation; how many were new."""
        return sum([self.add_fact(label, *r) for r in rows])

    def merge(self, other: Program) -> int:
        """Adds the given relations of another program; how many of its facts were new (rows of frames are not counted)."""
        new = 0
        for label, r in other.extensional.items():
            if label not in self.extensional:
                self.declare_extensional(label, r.schema)
            new += self.extend(label, r.facts)
            for df in r.frames:
                self.add_frame(label, df)
        return new

    def only_schemas(self) -> Program:
        """A program that declares the same relations and holds no facts, rules or queries."""
        out = Program(self.features, disjunction=self.disjunction)
        for r in self.extensional.values():
            out.declare_extensional(r.label, r.schema)
        for r in self.intensional.values():
            out.declare_intensional(r.label, r.schema)
        return out

    def cardinality(self, spark: SparkSession) -> int:
        """The number of facts of all given relations together."""
        return sum(self.frame(label, spark).count() for label in self.extensional)

    def add_dependency(self, label: str, dependency: Dependency) -> None:
        if Features.FUNCTIONAL_DEPENDENCIES not in self.features:
            raise E.FeatureDisabled("functional_dependencies")
        if set(dependency.determinant) & set(dependency.dependent):
            raise E.InvalidValue(f"{label}: a column cannot determine itself")
        found = self.relation(label)
        found.schema = replace(found.schema, dependencies=(*found.schema.dependencies, dependency))

    def add_functional_attribute(self, label: str, column: str | int) -> None:
        """The column determines all others."""
        schema = self.schema(label)
        at = schema.index(column)
        self.add_dependency(label, Dependency((at,), tuple(i for i in range(schema.arity) if i != at)))

    def bind_input(self, label: str, file: FileBinding) -> None:
        if label not in self.extensional:
            raise E.RelationDoesNotExist(label)
        from hornbeam.sources.formats import reader

        reader(file.format)
        self.extensional[label].input = file

    def bind_output(self, label: str, file: FileBinding) -> None:
        if label not in self.intensional:
            raise E.RelationDoesNotExist(label)
        from hornbeam.sources.formats import writer

        writer(file.format)
        self.intensional[label].output = file

    # rules and queries

    def add_rule(self, rule: Rule) -> Rule:
        check_safety(rule, self.features)
        known = {p: s.schema.kinds for p, s in (self.extensional | self.intensional).items()}
        for atom in rule.head:
            if atom.predicate in self.extensional:
                raise E.ExtensionalInHead(str(rule))
            if atom.predicate in known:
                arity(atom, known)
        for atom in rule.head:
            if atom.predicate not in self.intensional:
                self.declare_intensional(atom.predicate, self._head_schema(rule, atom))
        self.rules.append(rule)
        return rule

    def _head_schema(self, rule: Rule, atom: Atom) -> Schema:
        """Kinds of constants, and labels and kinds of extensional columns that variables stand in; a label is used once."""
        out, used = [], set()
        for t in atom.terms:
            a = Attribute(None, t.kind) if isinstance(t, Const) else Attribute()
            if isinstance(t, Var):
                for b in rule.positive_atoms:
                    if b.predicate in self.extensional and t in b.terms and len(b.terms) == self.extensional[b.predicate].schema.arity:
                        a = self.extensional[b.predicate].schema.attributes[b.terms.index(t)]
                        break
            if a.label in used:
                a = Attribute(None, a.kind)
            used.add(a.label)
            out.append(a)
        return Schema(tuple(out))

    def pure_rule(self, head: Atom, *body: Literal | Atom | Comparison) -> Rule:
        return self.add_rule(Rule((head,), tuple(b if isinstance(b, Literal) else Literal(b) for b in body)))

    def constraint_rule(self, *body: Literal | Atom | Comparison) -> Rule:
        return self.add_rule(Rule((), tuple(b if isinstance(b, Literal) else Literal(b) for b in body)))

    def disjunctive_rule(self, heads: Iterable[Atom], *body: Literal | Atom | Comparison) -> Rule:
        return self.add_rule(Rule(tuple(heads), tuple(b if isinstance(b, Literal) else Literal(b) for b in body)))

    def add_query(self, query: Query | Atom) -> Query:
        query = query if isinstance(query, Query) else Query(query)
        self.check_atom(query.atom)
        self.queries.append(query)
        return query

    def atom(self, label: str, *terms) -> Atom:
        """An atom whose number and kinds of terms are checked against the relation."""
        made = Atom(label, tuple(map(term, terms)))
        self.check_atom(made)
        return made

    def check_atom(self, atom: Atom) -> None:
        schema = self.schema(atom.predicate)
        arity(atom, {atom.predicate: schema.kinds})
        for t, k in zip(atom.terms, schema.kinds, strict=True):
            if isinstance(t, Const):
                check_kinds("=", t.kind, k)

    # analysis

    @property
    def precedence(self) -> Precedence:
        return Precedence(self.rules, self.extensional)

    @property
    def is_recursive(self) -> bool:
        return self.precedence.is_recursive

    @property
    def is_positive(self) -> bool:
        return all(r.is_positive for r in self.rules)

    @property
    def is_semi_positive(self) -> bool:
        """Never so where negation is not enabled."""
        return Features.NEGATION in self.features and self.precedence.is_semi_positive

    @property
    def is_stratifiable(self) -> bool:
        return self.precedence.is_stratifiable

    @property
    def is_linear(self) -> bool:
        """At most one intensional atom in each body."""
        return all(sum(x.is_relational and x.of.predicate in self.intensional for x in r.body) <= 1 for r in self.rules)

    @property
    def is_guarded(self) -> bool:
        return all(r.is_guarded for r in self.rules)

    @property
    def is_frontier_guarded(self) -> bool:
        return all(r.is_frontier_guarded for r in self.rules)

    def typed(self) -> dict[str, Schema]:
        """All schemas with their kinds inferred."""
        return infer_kinds(self.rules, {p: r.schema for p, r in (self.extensional | self.intensional).items()})

    def evaluable_rules(self) -> list[Rule]:
        out = []
        for r in self.rules:
            if r.form == "disjunctive" and self.disjunction != "split":
                raise E.FeatureUnsupported(f'disjunction is evaluated only with disjunction="split": {r}')
            out += [Rule((h,), r.body) for h in r.head]
        return out

    # running

    def frame(self, label: str, spark: SparkSession) -> DataFrame:
        """An extensional relation as a DataFrame (c0, c1, ...)."""
        return self.extensional[label].frame(spark, self.typed()[label] if any(k is None for k in self.extensional[label].schema.kinds) else None)

    def load(self, spark: SparkSession) -> None:
        """Binds the rows of input files; they are read when a plan runs."""
        from hornbeam.sources.formats import reader

        schemas = self.typed()
        for r in self.extensional.values():
            if r.input:
                r.frames.append(reader(r.input.format)(spark, self.path(r.input.path), schemas[r.label], **dict(r.input.options)))
                r.input = None

    def path(self, path: str) -> str:
        return path if self.folder is None or "://" in path or os.path.isabs(path) else os.path.join(self.folder, path)

    def infer(self, spark: SparkSession, evaluator: Evaluator | None = None) -> dict[str, DataFrame]:
        return (evaluator or SemiNaive()).inference(self, spark)

    def store(self, derived: Mapping[str, DataFrame]) -> None:
        from hornbeam.sources.formats import writer

        for r in self.intensional.values():
            if r.output:
                writer(r.output.format)(derived[r.label], self.path(r.output.path), self.typed()[r.label], **dict(r.output.options))

    def evaluate(self, query: Query | Atom, spark: SparkSession, derived: Mapping[str, DataFrame] | None = None, evaluator: Evaluator | None = None) -> DataFrame:
        """The answers of a query: a column for each variable (by name) and constant (_0, _1, ... by place), none for ``_``;
        for a query without variables one boolean, _0."""
        atom = query.atom if isinstance(query, Query) else query
        self.check_atom(atom)
        if atom.predicate in self.intensional:
            df = (derived if derived is not None else self.infer(spark, evaluator))[atom.predicate]
        else:
            df = self.frame(atom.predicate, spark)
        if not atom.variables:
            found = R.match(df, atom, {}).limit(1)
            return found.groupBy().count().select((F.col("count") > 0).alias("_0"))
        names = {v: f"v{i}" for i, v in enumerate(atom.variables)}
        rows = R.match(df, atom, names)
        out, done = [], set()
        for i, t in enumerate(atom.terms):
            if isinstance(t, Const):
                out.append(F.lit(t.value).cast(t.kind.spark).alias(f"_{i}"))
            elif isinstance(t, Var) and t.name not in done:
                done.add(t.name)
                out.append(F.col(names[t.name]).alias(t.name))
        rows = rows.select(*out)
        return rows.distinct() if ANY in atom.terms else rows

    def violations(self, spark: SparkSession, derived: Mapping[str, DataFrame]) -> list[tuple[str, DataFrame]]:
        """A DataFrame of the bindings, or rows, that break each constraint and functional dependency."""
        rows = lambda a, i: derived[a.predicate] if a.predicate in self.intensional else self.frame(a.predicate, spark)
        out = []
        for r in self.rules:
            if r.form == "constraint":
                out.append((str(r), constraint_rows(spark, r, rows)))
        for rel in (self.extensional | self.intensional).values():
            for d in rel.schema.dependencies:
                df = derived[rel.label] if rel.label in self.intensional else self.frame(rel.label, spark)
                out.append((f"{rel.label}: {d.determinant} --> {d.dependent}", dependency_rows(df, d)))
        return out

    def run(self, spark: SparkSession, evaluator: Evaluator | None = None, load: bool = True, check: str = "report") -> list[tuple[Query, DataFrame]]:
        """Loads, infers, checks (check: "report", "raise" or "skip"), stores, and answers the program's queries."""
        if load:
            self.load(spark)
        derived = self.infer(spark, evaluator)
        if check != "skip":
            for what, rows in self.violations(spark, derived):
                if not rows.isEmpty():
                    if check == "raise":
                        raise E.ConstraintViolated(what)
                    log.warning("violated: %s", what)
        self.store(derived)
        return [(q, self.evaluate(q, spark, derived)) for q in self.queries]

    def __str__(self) -> str:
        from hornbeam.lang.writer import to_text

        return to_text(self)


def constraint_rows(spark: SparkSession, rule: Rule, rows) -> DataFrame:
    """The distinct bindings of a headless rule, columns named by variables."""
    names = list(dict.fromkeys(v for a in rule.positive_atoms for v in a.variables))
    if not names:
        return R.body(spark, rule, rows)
    kept = Rule((Atom("violation", tuple(map(Var, names))),), rule.body)
    return R.head(R.body(spark, kept, rows), kept, kept.head[0]).distinct().toDF(*names)


def dependency_rows(df: DataFrame, d: Dependency) -> DataFrame:
    """Determinants with more than one dependent: their columns and n, the number of dependents."""
    keys = [f"c{i}" for i in d.determinant]
    pairs = df.select(*keys, *[f"c{i}" for i in d.dependent]).distinct()
    return pairs.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")
