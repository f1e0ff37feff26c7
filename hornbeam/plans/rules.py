"""A rule body as one DataFrame plan.

Columns of relations are c0, c1, ...; variables of a rule are v0, v1, ... (names are case-sensitive in the
language but not in Spark, so they appear at the public boundary only). Catalyst picks the physical joins.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hornbeam.functions import compare
from hornbeam.model import Atom, Const, Rule, Term, Var


def match(df: DataFrame, atom: Atom, names: dict[str, str]) -> DataFrame:
    """Rows that an atom matches, as a column for each of its variables; filters reach the scan."""
    first: dict[str, int] = {}
    for i, t in enumerate(atom.terms):
        if isinstance(t, Const):
            df = df.filter(F.col(f"c{i}") == compare.constant(t))
        elif isinstance(t, Var):
            if t.name in first:
                df = df.filter(F.col(f"c{i}") == F.col(f"c{first[t.name]}"))
            else:
                first[t.name] = i
    return df.select(*[F.col(f"c{i}").alias(names[v]) for v, i in first.items()]) if first else df.select(F.lit(True).alias("found"))


def variables(rule: Rule) -> dict[str, str]:
    seen = dict.fromkeys(v for x in rule.body for v in x.of.variables)
    return {v: f"v{i}" for i, v in enumerate(seen)}


def _exists(left: DataFrame, right: DataFrame, on: list[str], how: str) -> DataFrame:
    """Semi or anti join on shared variables; without any, a guard that one row decides."""
    if on:
        return left.join(right, on, how)
    return left.join(right.limit(1), F.lit(True), how)


def body(spark: SparkSession, rule: Rule, relation: Callable[[Atom, int], DataFrame], start: int | None = None) -> DataFrame:
    """All variable bindings of a body. ``relation`` gives the rows of the i-th positive atom (or, at -1, of a
    negated one); ``start`` is the atom to join first, as the delta of a recursive rule."""
    names = variables(rule)
    value = lambda t: F.col(names[t.name]) if isinstance(t, Var) else compare.constant(t)
    atoms = list(enumerate(rule.positive_atoms))
    tests = list(rule.comparisons)
    out: DataFrame | None = None
    bound: set[str] = set()

    def apply_tests(df: DataFrame) -> DataFrame:
        for x in [x for x in tests if set(x.of.variables) <= bound]:
            tests.remove(x)
            df = df.filter(compare.literal(x.of, x.negated, value))
        return df

    def needed(rest: Sequence[tuple[int, Atom]]) -> set[str]:
        return set(rule.distinguished) | {v for _, a in rest for v in a.variables} | {v for x in tests for v in x.of.variables} | {v for a in rule.negative_atoms for v in a.variables}

    while atoms:
        if out is None:
            pick = next((p for p in atoms if p[0] == start), None) or max(atoms, key=lambda p: (not p[1].is_ground, len(p[1].terms) - len(p[1].variables), -p[0]))
        else:  # the atom that shares most variables; a product only if none does
            pick = max(atoms, key=lambda p: (p[1].is_ground, len(bound & set(p[1].variables)), -p[0]))
        atoms.remove(pick)
        i, atom = pick
        rows, own = match(relation(atom, i), atom, names), set(atom.variables)
        if out is None:
            out = rows if own else _exists(spark.range(1).select(F.lit(True).alias("found")), rows, [], "left_semi")
        else:
            shared = [names[v] for v in atom.variables if v in bound]
            if not (own - bound) & needed(atoms):
                rows = rows.select(*shared) if shared else rows
                out = _exists(out, rows, shared, "left_semi")
                own &= bound
            else:
                out = out.join(rows, shared) if shared else out.crossJoin(rows)
        bound |= own
        out = apply_tests(out)
        keep = [names[v] for v in names if v in bound and v in needed(atoms)]
        if keep and len(keep) < len(out.columns):
            out = out.select(*keep)
            bound = {v for v in bound if names[v] in keep}
    if out is None:
        out = spark.range(1).select(F.lit(True).alias("found"))
    for atom in rule.negative_atoms:
        out = _exists(out, match(relation(atom, -1), atom, names), [names[v] for v in atom.variables], "left_anti")
    return out


def head(df: DataFrame, rule: Rule, atom: Atom) -> DataFrame:
    """Tuples of a head atom, not yet distinct."""
    names = variables(rule)

    def value(t: Term) -> Column:
        return F.col(names[t.name]) if isinstance(t, Var) else compare.constant(t)

    return df.select(*[value(t).alias(f"c{i}") for i, t in enumerate(atom.terms)])
