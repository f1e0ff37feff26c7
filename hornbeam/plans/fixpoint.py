"""Evaluators: how the intensional relations of a program are computed.

``SemiNaive`` is the one to use: it solves one group of mutually recursive predicates after the other, groups without
recursion as one plan each, others by a loop that joins only the newest facts. Each round is stored in the shared
folder, so plans stay small and a lost executor costs one round. A negated predicate is always complete
before it is read.
"""

from __future__ import annotations

import logging
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession

from hornbeam import errors as E
from hornbeam.analysis import Precedence
from hornbeam.model import Atom, Literal, Rule, Var
from hornbeam.plans import rules as R
from hornbeam.plans.storage import Steps

log = logging.getLogger(__name__)


class Evaluator(Protocol):
    label: str

    def inference(self, program, spark: SparkSession) -> dict[str, DataFrame]:
        """The derived relations by name; the program is not changed."""


class Noop:
    label = "noop"

    def inference(self, program, spark):
        return {p: spark.createDataFrame([], s.spark()) for p, s in program.typed().items() if p in program.intensional}


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def closure_rule(rules: list[Rule], group: set[str]) -> Rule | None:
    """For a transitive closure, p(X, Y) from e(X, Y) and from e(X, Z), p(Z, Y) or p(X, Z), e(Z, Y): the rule p(X, Y)
    from p(X, Z), p(Z, Y), which reaches the same facts in logarithmically many rounds."""
    if len(group) != 1 or len(rules) != 2 or any(len(r.head) != 1 or len(r.head[0].terms) != 2 for r in rules):
        return None
    p = next(iter(group))
    base, step = sorted(rules, key=lambda r: len(r.body))
    if len(base.body) != 1 or len(step.body) != 2 or len(base.positive_atoms) != 1 or len(step.positive_atoms) != 2:
        return None
    e = base.positive_atoms[0]
    distinct = lambda a: len(a.terms) == 2 and len(a.variables) == 2
    if e.predicate in group or not distinct(e) or e.terms != base.head[0].terms or not distinct(step.head[0]):
        return None
    if {a.predicate for a in step.positive_atoms} != {p, e.predicate} or not all(map(distinct, step.positive_atoms)):
        return None
    x, y = step.head[0].terms
    for a, b in (step.positive_atoms, step.positive_atoms[::-1]):
        if a.terms[0] == x and b.terms[1] == y and a.terms[1] == b.terms[0] and a.terms[1] not in (x, y):
            z = Var("Z" if Var("Z") not in (x, y) else "Zz")
            return Rule(step.head, (Literal(Atom(p, (x, z))), Literal(Atom(p, (z, y)))))
    return None


class SemiNaive:
    label = "stratified"

    def __init__(self, doubling: bool = True, max_iterations: int | None = None):
        self.doubling, self.max_iterations = doubling, max_iterations
        self.iterations: dict[str, int] = {}

    def inference(self, program, spark):
        rules = program.evaluable_rules()
        graph = Precedence(rules, program.extensional)
        if not graph.is_stratifiable:
            raise E.NotStratifiable(", ".join(f"{e.source} needs the negation of {e.target}" for e in graph.edges if e.negative and (e.source == e.target or e.source in graph.reachable(e.target))))
        schemas = program.typed()
        self._kept: set[str] = set()  # relations of ``done`` that are stored
        done = {p: program.frame(p, spark) for p in program.extensional}
        out: dict[str, DataFrame] = {}
        for group in graph.components():
            mine = [r for r in rules if r.head[0].predicate in group]
            if not mine:
                continue
            if len(group) == 1 and group[0] not in graph.reachable(group[0]):
                parts = [self._apply(spark, r, done) for r in mine]
                out[group[0]] = _union(parts).distinct()
            else:
                out |= self._solve(spark, set(group), mine, done, schemas)
            done |= {p: out[p] for p in group}
            self._kept |= set(group) if len(group) > 1 or group[0] in graph.reachable(group[0]) else set()
        for p in program.intensional:
            if p not in out:
                out[p] = spark.createDataFrame([], schemas[p].spark())
        return out

    @staticmethod
    def _apply(spark, rule: Rule, done, delta: int | None = None, fresh=None) -> DataFrame:
        rows = R.body(spark, rule, lambda a, i: fresh[a.predicate] if i == delta and delta is not None else done[a.predicate], delta)
        return R.head(rows, rule, rule.head[0])

    def _solve(self, spark, group, rules, done, schemas) -> dict[str, DataFrame]:
        steps = {p: Steps(spark, schemas[p].spark()) for p in group}
        inner = lambda r: [i for i, a in enumerate(r.positive_atoms) if a.predicate in group]
        base = [r for r in rules if not inner(r)]
        loop = [r for r in rules if inner(r)]
        if self.doubling and (double := closure_rule(rules, group)):
            loop = [double]
        # what every round reads is computed once
        for p in sorted({a.predicate for r in loop for a in (*r.positive_atoms, *r.negative_atoms)} - group):
            if p not in self._kept:
                done[p], _ = Steps(spark, schemas[p].spark()).add(done[p])
                self._kept.add(p)
        fresh, live = {}, set()
        for p in group:
            parts = [self._apply(spark, r, done) for r in base if r.head[0].predicate == p]
            fresh[p], n = steps[p].add(_union(parts).distinct() if parts else spark.createDataFrame([], schemas[p].spark()))
            live |= {p} if n else set()
        rounds = 0
        while live:
            rounds += 1
            if self.max_iterations is not None and rounds > self.max_iterations:
                raise E.DatalogError(f"no fixpoint after {self.max_iterations} rounds of {', '.join(sorted(group))}")
            known = done | {p: steps[p].whole for p in group}
            cands = {}
            for p in group:
                parts = [self._apply(spark, r, known, i, fresh) for r in loop if r.head[0].predicate == p for i in inner(r) if r.positive_atoms[i].predicate in live]
                if parts:
                    cand = _union(parts).distinct()
                    cands[p] = cand.join(known[p], cand.columns, "left_anti")
            new = _together(lambda p, df: steps[p].add(df), cands)  # predicates of a group do not wait for each other
            fresh, live = fresh | {p: df for p, (df, _) in new.items()}, {p for p, (_, n) in new.items() if n}
        self.iterations |= dict.fromkeys(group, rounds)
        log.info("%s: fixpoint after %d rounds", ", ".join(sorted(group)), rounds)
        return {p: steps[p].whole for p in group}


def _together(work, items: dict) -> dict:
    """``work(key, value)`` of all items, as jobs side by side."""
    if len(items) < 2:
        return {k: work(k, v) for k, v in items.items()}
    with ThreadPoolExecutor(len(items)) as pool:
        return dict(zip(items, pool.map(work, items.keys(), items.values()), strict=True))


class Naive:
    """All rules against all facts until nothing is new: the plain semantics, for tests and small programs. Strata are
    solved in order, so that negation means the same here."""

    label = "naive"

    def inference(self, program, spark):
        rules, schemas = program.evaluable_rules(), program.typed()
        graph = Precedence(rules, program.extensional)
        if not graph.is_stratifiable:
            raise E.NotStratifiable("a predicate depends on its own negation")
        now = {p: program.frame(p, spark) for p in program.extensional} | {p: spark.createDataFrame([], schemas[p].spark()) for p in program.intensional}
        for group in graph.components():
            mine = [r for r in rules if r.head[0].predicate in group]
            if not mine:
                continue
            before = None
            while True:
                made = {}
                for p in group:
                    parts = [R.head(R.body(spark, r, lambda a, i: now[a.predicate]), r, r.head[0]) for r in mine if r.head[0].predicate == p]
                    made[p], n = Steps(spark, schemas[p].spark()).add(_union([now[p], *parts]).distinct())
                    made[p, "n"] = n
                count = {p: made.pop((p, "n")) for p in group}
                now |= made
                if count == before:
                    break
                before = count
        return {p: now[p] for p in program.intensional}
