"""Evaluation on Spark: goldens, features, files, and a random comparison with a plain fixpoint."""

import json
import random

import pytest

from hornbeam import errors as E
from hornbeam.features import Features
from hornbeam.lang.parser import parse, parse_file
from hornbeam.model import ANY, Atom, Const, Var, holds, schema
from hornbeam.operators.views import Criterion, View
from hornbeam.plans.fixpoint import Naive, Noop, SemiNaive
from hornbeam.program import Program
from hornbeam.sources import formats

ALL = Features.all()


def rows(df):
    out = [tuple(r) for r in df.collect()]
    assert len(out) == len(set(out)), "not a set"
    return set(out)


def answers(spark, text, evaluator=None, **options):
    p = Program(ALL, **options)
    parse(text, program=p)
    return [rows(df) for _, df in p.run(spark, evaluator)]


EDGES = "edge(a, b). edge(b, c). edge(c, d). edge(d, a)."


def test_goldens(spark):
    got = answers(spark, 'human("Socrates"). human("Plato"). mortal(X) <- human(X). ?- mortal("Socrates"). ?- mortal(X). ?- mortal(zeus).')
    assert got == [{(True,)}, {("Socrates",), ("Plato",)}, {(False,)}]
    got = answers(spark, "parent(xerces, brooke). parent(brooke, damocles). ancestor(X, Y) :- parent(X, Y). ancestor(X, Y) :- parent(X, Z), parent(Z, Y). ?- ancestor(xerces, X). ?- ancestor(X, Y).")
    assert got[0] == {("xerces", "brooke"), ("xerces", "damocles")} and len(got[1]) == 3
    for e in (SemiNaive(), SemiNaive(doubling=False), Naive()):
        assert len(answers(spark, EDGES + "path(X, Y) :- edge(X, Y). path(X, Y) :- edge(X, Z), path(Z, Y). ?- path(X, Y).", e)[0]) == 16


#: A small ontology of a library, and the entailment patterns rdfs2, 3, 5, 7, 9 and 11 of the W3C's RDF 1.1 Semantics over it.
LIBRARY = [
    ("novel", "subClassOf", "book"),
    ("book", "subClassOf", "work"),
    ("work", "subClassOf", "thing"),
    ("author", "subClassOf", "person"),
    ("wrote", "subPropertyOf", "made"),
    ("made", "subPropertyOf", "touched"),
    ("wrote", "domain", "author"),
    ("wrote", "range", "book"),
    ("touched", "range", "thing"),
    ("lent", "domain", "person"),
    ("emma", "type", "novel"),
    ("austen", "wrote", "emma"),
    ("austen", "wrote", "persuasion"),
    ("reader", "lent", "emma"),
]
PATTERNS = """
t(S, P, O) :- given(S, P, O).
t(S, type, C) :- t(P, domain, C), t(S, P, _).
t(O, type, C) :- t(P, range, C), t(_, P, O).
t(P, subPropertyOf, R) :- t(P, subPropertyOf, Q), t(Q, subPropertyOf, R).
t(S, Q, O) :- t(P, subPropertyOf, Q), t(S, P, O).
t(S, type, D) :- t(C, subClassOf, D), t(S, type, C).
t(C, subClassOf, E) :- t(C, subClassOf, D), t(D, subClassOf, E).
"""


def entailed(facts):
    """The same patterns, by hand."""
    t, before = set(facts), -1
    while len(t) != before:
        before = len(t)
        for s, p, o in list(t):
            t |= {(x, "type", o) for x, q, _ in t if p == "domain" and q == s}
            t |= {(y, "type", o) for _, q, y in t if p == "range" and q == s}
            t |= {(x, o, y) for x, q, y in t if p == "subPropertyOf" and q == s}
            t |= {(s, p, z) for y, q, z in t if p in ("subPropertyOf", "subClassOf") and q == p and y == o}
            t |= {(x, "type", o) for x, q, c in t if p == "subClassOf" and q == "type" and c == s}
    return t


def test_rdf_schema_entailment(spark):
    facts = "".join(f"given({', '.join(f)}). " for f in LIBRARY)
    want = entailed(LIBRARY)
    for evaluator in (SemiNaive(), Naive()):
        assert answers(spark, facts + PATTERNS + "?- t(S, P, O).", evaluator) == [want]
    assert {("persuasion", "type", "thing"), ("austen", "type", "person"), ("austen", "touched", "emma")} <= want


def test_negation_comparisons_guards(spark):
    car = 'car(ford, escort, 12). car(ford, model_t, 104). car(cadillac, "Type 51", 104). car(bmw, z3, 30). '
    assert answers(spark, car + 'a(X, Y) :- car(X, Y, _), Y *= "^Type". a(X, Y) :- car(X, Y, _), Y = model_t. a(X, Y) :- car(X, Y, Z), 50 < Z. ?- a(X, _).') == [{("ford",), ("cadillac",)}]
    assert answers(spark, "person(a). person(b). dead(b). alive(X) :- person(X), NOT dead(X). ?- alive(X).") == [{("a",)}]
    for guard, n in (("q(1)", 2), ("q(2)", 0), ("NOT q(1)", 0), ("NOT q(2)", 2)):
        assert len(answers(spark, f"p(a). p(b). q(1). r(X) :- p(X), {guard}. ?- r(X).")[0]) == n
    assert answers(spark, "e(a, a). e(a, b). loop(X) :- e(X, X). same(X, Z) :- e(X, Y), e(Z, Y). ?- loop(X). ?- e(X, X).") == [{("a",)}, {("a",)}]
    assert answers(spark, "e(a, 1). e(b, 2). lone(X) :- e(X, N), NOT f(X, _). f(a, z). ?- lone(X).") == [{("b",)}]
    assert answers(spark, 'Ab(X) :- q(X).'.replace("Ab", "ab") + " q(1). r(Ab, AB) :- q(Ab), q(AB). ?- r(Ab, AB).") == [{(1, 1)}]


def test_constraints_dependencies_and_disjunction(spark):
    text = "alive(a). alive(b). dead(b). :- alive(X) AND dead(X)."
    with pytest.raises(E.ConstraintViolated):
        parse(text, ALL).run(spark, check="raise")
    assert parse(text, ALL).run(spark) == []
    p = parse(".assert employee(id: integer, name: string). .fd employee: id --> name. employee(1, a). employee(1, b). employee(2, c).", ALL)
    assert [rows(df) for _, df in p.violations(spark, {})] == [{(1, 2)}]
    text = "parent(p). father(X) ; mother(X) :- parent(X). ?- mother(X)."
    with pytest.raises(E.FeatureUnsupported):
        answers(spark, text)
    assert answers(spark, text, disjunction="split") == [{("p",)}]
    with pytest.raises(E.NotStratifiable):
        answers(spark, "q(a). p(X) :- q(X), NOT p(X).")


def test_iterations(spark):
    chain = "".join(f"e({i}, {i + 1}). " for i in range(12)) + "p(X, Y) :- e(X, Y). p(X, Y) :- p(X, Z), e(Z, Y). ?- p(0, X)."
    fast, slow = SemiNaive(), SemiNaive(doubling=False)
    assert answers(spark, chain, fast) == answers(spark, chain, slow)
    assert fast.iterations["p"] < slow.iterations["p"] == 12
    with pytest.raises(E.DatalogError):
        answers(spark, chain, SemiNaive(max_iterations=1))
    assert answers(spark, chain, Noop()) == [set()]


def plain(facts, rules):
    """Least model, stratum by stratum, by trying all bindings."""
    from hornbeam.analysis import Precedence

    db = {p: set(f) for p, f in facts.items()}
    graph = Precedence(rules, facts)
    for group in graph.components():
        mine = [r for r in rules if r.head[0].predicate in group]
        for p in group:
            db.setdefault(p, set())
        grown = True
        while grown:
            grown = False
            for r in mine:
                found = [{}]
                for a in r.positive_atoms:
                    step = []
                    for b in found:
                        for f in db[a.predicate]:
                            c = dict(b)
                            if all(t is ANY or (c.setdefault(t.name, v) == v if isinstance(t, Var) else t.value == v) for t, v in zip(a.terms, f, strict=True)):
                                step.append(c)
                    found = step
                get = lambda t, b: b[t.name] if isinstance(t, Var) else t.value
                for b in found:
                    if any(holds(get(x.of.left, b), x.of.op, get(x.of.right, b)) == x.negated for x in r.comparisons):
                        continue
                    if any(all(t is ANY or get(t, b) == v for t, v in zip(a.terms, f, strict=True)) for a in r.negative_atoms for f in db[a.predicate]):
                        continue
                    t = tuple(get(t, b) for t in r.head[0].terms)
                    if t not in db[r.head[0].predicate]:
                        db[r.head[0].predicate].add(t)
                        grown = True
    return db


RULES = ["p(X, Y) :- e(X, Y).", "p(X, Y) :- e(X, Z), p(Z, Y).", "q(X, Y) :- p(Y, X), X < Y.", "p(X, X) :- q(X, _).", "q(Y, X) :- q(X, Y), p(X, 1).", "r(X) :- p(X, _), NOT q(X, X).", "r(X) :- f(X), NOT p(X, _).", "s(X, 7) :- r(X), e(_, X), NOT X = 2.", "s(X, Y) :- f(X), f(Y), p(X, Y), Y >= 2.", "t(X) :- s(X, _), e(1, 2)."]


@pytest.mark.parametrize("seed", range(4))
def test_random_programs(spark, seed):
    rng = random.Random(seed)
    facts = {"e": {(rng.randrange(5), rng.randrange(5)) for _ in range(6)}, "f": {(rng.randrange(5),) for _ in range(3)}}
    text = " ".join(f"{p}({', '.join(map(str, f))})." for p, fs in facts.items() for f in fs)
    chosen = [r for r in RULES if rng.random() < 0.75]
    decl = ".infer p(integer, integer). .infer q(integer, integer). .infer r(integer). .infer s(integer, integer). .infer t(integer).\n"
    p = parse(decl + text + " ".join(chosen), ALL)
    want = plain(facts, p.rules)
    got = p.infer(spark)
    for name in "pqrst":
        assert rows(got[name]) == want.get(name, set()), (name, chosen)
    if seed == 0:
        assert {n: rows(df) for n, df in p.infer(spark, Naive()).items()} == {n: rows(df) for n, df in got.items()}


FAMILY = [("alice", "bob"), ("alice", "carol"), ("bob", "dan"), ("bob", "erin"), ("carol", "frank"), ("carol", "grace")]


def test_files(spark, tmp_path):
    (tmp_path / "p.csv").write_text("# who\n" + "".join(f"{a}, {b}\n" for a, b in FAMILY))
    (tmp_path / "h.csv").write_text("child, parent\n" + "".join(f"{a}, {b}\n" for a, b in FAMILY))
    (tmp_path / "p.json").write_text(json.dumps(FAMILY))
    for name, form in (("p.csv", "csv"), ("p.json", "json")):
        (tmp_path / "x.dl").write_text(f'.assert parent(string, string). .infer old(string, string). .input(parent, "{name}", "{form}"). .output(old, "out_{form}", "{form}").\nparent(x, y). parent(y, z). old(X, Y) :- parent(X, Y). ?- old(X, Y).')
        p = parse_file(str(tmp_path / "x.dl"))
        assert len(rows(p.run(spark)[0][1])) == 8
        back = formats.reader(form)(spark, str(tmp_path / f"out_{form}"), schema("string", "string"), **({"has_headers": True} if form == "csv" else {}))
        assert rows(back) == {*FAMILY, ("x", "y"), ("y", "z")}
    assert rows(formats.read_csv(spark, str(tmp_path / "h.csv"), schema("string", "string"), has_headers=True)) == set(FAMILY)
    mixed = [("a \"q\", b", 1, 2.5, True), ("é\\", -3, 0.1, False)]
    kinds = schema("name: string", "n: integer", "float", "boolean")
    df = spark.createDataFrame(mixed, kinds.spark())
    for form, options in (("csv", {"has_headers": True}), ("tsv", {"has_headers": True}), ("json", {}), ("parquet", {})):
        formats.writer(form)(df, str(tmp_path / f"m_{form}"), kinds)
        assert rows(formats.reader(form)(spark, str(tmp_path / f"m_{form}"), kinds, **options)) == set(mixed), form
    formats.write_text(df, str(tmp_path / "m_text"), kinds)
    assert "name: string" in "".join(f.read_text() for f in sorted((tmp_path / "m_text").glob("part-*")))
    assert "| name: string" in formats.print_relation(df, kinds) and json.loads(formats.print_relation(df, kinds, "pretty"))[0][1] == 1
    (tmp_path / "bad.json").write_text('[["a", "b"]]')
    with pytest.raises(Exception, match="conform"):
        formats.read_json(spark, str(tmp_path / "bad.json"), schema("string", "integer")).collect()
    (tmp_path / "short.csv").write_text("a\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        formats.read_csv(spark, str(tmp_path / "short.csv"), schema("string", "integer")).collect()
    with pytest.raises(E.UnsupportedOperation):
        formats.reader("text")(spark, "x", kinds)
    with pytest.raises(E.UnknownFormat):
        formats.writer("xml")
    with pytest.raises(E.FileAccessError):
        parse_file(str(tmp_path / "none.dl"))


def test_frames_and_views(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, None), (3, "c")], "n int, s string")
    p = Program(ALL)
    p.add_frame("t", df, ["n", "s"])
    assert rows(p.frame("t", spark)) == {(1, "a"), (3, "c")}
    with pytest.raises(E.IncompatibleTypes):
        p.add_frame("u", spark.createDataFrame([([1],)], "x array<int>"))
    with pytest.raises(E.FactDoesNotConform):
        p.add_frame("t", spark.createDataFrame([("x", "y")], "a string, b string"))
    v = View.of(p.frame("t", spark).toDF("n", "s"))
    w = View.of(spark.createDataFrame([(1, "a"), (9, "z")], "n long, s string"))
    assert rows(v.union(w).frame()) == {(1, "a"), (3, "c"), (9, "z")} and rows(v.intersection(w).frame()) == {(1, "a")} and rows(v.difference(w).frame()) == {(3, "c")}
    assert rows(v.natural_join(w).frame()) == {(1, "a")} and v.natural_join(w.project("n")).labels == ["n", "s"]
    assert v.theta_join(w.rename(n="m", s="r"), Criterion("n", "<", "m")).count() == 2
    assert v.cartesian_product(w.rename(n="m", s="r")).count() == 4 and v.contains(1, "a") and not v.exists(Criterion("n", ">", Const(5)))
    assert rows(v.select(Criterion("s", "*=", Const("^a")), negated=True).frame()) == {(3, "c")} and View.natural_join_all([v, w, v]).count() == 1
    with pytest.raises(E.InvalidValue):
        v.cartesian_product(w)
    with pytest.raises(E.IncompatibleTypes):
        v.select(Criterion("n", "=", Const("a")))
    with pytest.raises(E.FactDoesNotConform):
        v.union(w.project("n"))
    assert p.evaluate(Atom("t", (ANY, Const("a"))), spark).collect()[0][0] is True


def test_printing_says_what_is_left_out_and_pretty_files_read_back(spark, tmp_path):
    from hornbeam.model import schema
    from hornbeam.operators.views import View
    from hornbeam.sources import formats

    df, kinds = spark.range(30).selectExpr("id AS c0", "concat('n', id) AS c1"), schema("integer", "string")
    assert formats.print_relation(df, kinds, most=10).endswith("... and 20 more") and formats.print_relation(df, kinds, most=None).count("\n") == 33
    assert "... and" not in formats.print_relation(df, kinds, most=40)
    formats.write_json(df, f"{tmp_path}/pretty", kinds, pretty=True)
    assert {tuple(r) for r in formats.read_json(spark, f"{tmp_path}/pretty", kinds).collect()} == {tuple(r) for r in df.collect()}
    v = View.of(df.toDF("number", "name"))
    assert "| number: integer | name: string |" in v.text() and v.text("csv").startswith("number,name")


def test_a_declared_set_is_not_made_distinct(spark):
    p = parse("big(X) :- n(X), X > 5. ?- big(X).", ALL)
    p.add_frame("n", spark.range(10), is_set=True)
    assert p.cardinality(spark) == 10
    assert "Exchange" not in p.frame("n", spark)._jdf.queryExecution().executedPlan().toString()
    assert rows(p.run(spark)[0][1]) == {(6,), (7,), (8,), (9,)}
