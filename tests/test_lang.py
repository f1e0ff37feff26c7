"""Parsing, analysis, printing: no Spark."""

import pytest
from hypothesis import given
from hypothesis import strategies as st

from hornbeam import errors as E
from hornbeam.analysis import Precedence
from hornbeam.features import Features
from hornbeam.lang.parser import parse
from hornbeam.lang.writer import to_latex
from hornbeam.model import ANY, Atom, Comparison, Const, Kind, Literal, Query, Rule, RuleBuilder, Var, schema
from hornbeam.plans import algebra
from hornbeam.program import Program

ALL = Features.all()


def rule(text, features=ALL):
    return parse(text, features).rules[-1]


def test_spellings_of_rules_and_literals():
    a = rule("p(X) :- q(X), NOT r(X), X != 3.")
    for text in ("p(X) <- q(X) AND ￢r(X) ∧ X /= 3.", "p(X) ⟵ q(X) & !r(X) ⋀ X ≠ 3."):
        assert rule(text) == a
    assert [rule(f"p(X) :- q(X), X {s} 3.").comparisons[0].of.op for s in ("=", "<", "<=", "≤", ">", ">=", "≥")] == ["=", "<", "<=", "<=", ">", ">=", ">="]
    assert rule('p(X) :- q(X), X *= "a".') == rule('p(X) :- q(X), X MATCHES "a".') == rule('p(X) :- q(X), X ≛ "a".')
    assert len(rule("p(X) ; r(X) :- q(X).").head) == len(rule("p(X) OR r(X) :- q(X).").head) == len(rule("p(X) ∨ r(X) :- q(X).").head) == 2
    assert rule("⊥ :- q(X), r(X).").form == rule(":- q(X), r(X).").form == "constraint"


def test_constants():
    p = parse(r'f(trueish, rdf:type, "a \"b\" \\ \t \u{e9}", -3, 1.5, 2.5e-1, true, false). % a comment' + "\n/* another */")
    assert list(p.extensional["f"].facts)[0] == ("trueish", "rdf:type", 'a "b" \\ \t é', -3, 1.5, 0.25, True, False)
    assert str(Const(50.0)) == "50.0e0" and str(Const(1e30)) == "1.0e+30" and str(Const("a b")) == '"a b"' and str(Const("a:B")) == "a:B"


@pytest.mark.parametrize("text", ["p(X) : q(X).", "p(X) :- q(X)", "p(X).", "p(a", "P(a).", "p().", ".include(x).", ".assert p(string, text).", ".feature(magic).", 'p("a\\q").', "p(_) :- q(X", "?- p(X)"])
def test_rejected_texts(text):
    with pytest.raises(E.DatalogError):
        parse(text, ALL)


def test_errors_say_where():
    with pytest.raises(E.ParseError) as e:
        parse("p(a).\n  q(b) r.")
    assert (e.value.line, e.value.column) == (2, 8)


@pytest.mark.parametrize(
    ("text", "error"),
    [
        ("p(X, Y) :- q(X).", E.HeadVariablesMissing),
        ("p(X) :- q(X), NOT r(Y).", E.NegativeVariablesMissing),
        ("a(X) :- b(Y), X < Y.", E.HeadVariablesMissing),
        ("a(Y) :- b(Y), X < Y.", E.ComparisonVariablesMissing),
        (":- NOT q(X).", E.NegativeVariablesMissing),
        ("p(_) :- q(X).", E.AnonymousNotAllowed),
        ("p(X) :- q(X), _ = 2.", E.AnonymousNotAllowed),
        ("p(X) :- q(X), 1 < 2.", E.ComparisonAlwaysTrue),
        ("p(X) :- q(X), 2 < 1.", E.ComparisonAlwaysFalse),
        ("p(X) :- q(X), X <= X.", E.ComparisonAlwaysTrue),
        ("p(X) :- q(X), 1 = a.", E.IncompatibleTypes),
        ('p(X) :- q(X), X *= "(".', E.InvalidValue),
        ("q(a). q(X) :- r(X).", E.ExtensionalInHead),
        ("p(X) :- q(X). p(a).", E.ExtensionalInHead),
        ("q(a). q(a, b).", E.FactDoesNotConform),
        ("q(a). q(1).", E.FactDoesNotConform),
        ("?- nothing(X).", E.RelationDoesNotExist),
        (".assert q(string). .assert q(string).", E.RelationExists),
        ('.assert q(string). .input(q, "a", "xml").', E.UnknownFormat),
        (".assert q(string, string). .fd q: 1 --> 3.", E.InvalidAttributeIndex),
        (".assert q(string, string). .fd q: a --> 2.", E.AttributeDoesNotExist),
    ],
)
def test_typed_errors(text, error):
    with pytest.raises(error):
        parse(text, ALL)


@pytest.mark.parametrize("text", ["p(X) :- q(X), NOT r(X).", "p(X) :- q(X), X = 2.", ":- q(X).", "p(X) ; r(X) :- q(X).", ".assert q(string, string). .fd q: 1 --> 2."])
def test_features_are_off_by_default(text):
    with pytest.raises(E.FeatureDisabled):
        parse(text)


def test_features():
    assert Features.NONE.language == "Datalog" and str(Features.NONE) == ""
    f = Features.NEGATION | Features.DISJUNCTION | Features.COMPARISONS
    assert f.language == "(￢,θ,∨)Datalog" and str(f) == ".feature(negation, comparisons, disjunction)."
    assert parse(".feature(negation, comparisons).").features == Features.NEGATION | Features.COMPARISONS


def test_program_prints_as_text_that_parses():
    text = """.feature(negation, comparisons, constraints, disjunction, functional_dependencies).
.assert e(name: string, age: integer).
.infer old(string).
.fd e: name --> age.
.input(e, "e \\"x\\".csv", "csv").
.output(old, "o", "json").
e("Al B", 5).
old(X) :- e(X, A), A >= 70, NOT dead(X).
dead(X) ; gone(X) :- e(X, _), X *= "^z".
:- old(X), gone(X).
?- old(X)."""
    p = parse(text + "\n")
    assert str(parse(str(p))) == str(p) and "\\leftarrow" in to_latex(p)


def check(text):
    return parse(text, ALL)


def test_classification():
    """One case for and one against each class, by its definition."""
    tube = ".assert line(string, string). .assert walk(string, string). .infer trip(string, string)."
    cases = {
        "is_positive": ("trip(A, B) :- line(A, B), walk(B, A).", "trip(A, B) :- line(A, B), NOT walk(A, B)."),
        # one atom of a derived relation in a body, at most
        "is_linear": (tube + "trip(A, B) :- line(A, B). trip(A, C) :- trip(A, B), line(B, C).", tube + "trip(A, B) :- line(A, B). trip(A, C) :- trip(A, B), trip(B, C)."),
        # one atom holds all variables of the body
        "is_guarded": ("hub(S) :- line(S, T), stop(T, S), walk(T, S).", "hub(S) :- line(S, T), walk(T, U)."),
        # one atom holds all variables of the head
        "is_frontier_guarded": ("near(S, U) :- line(S, T), fare(T, S, U).", "near(S, U) :- line(S, T), walk(T, U)."),
        "is_recursive": ("far(S, T) :- far(S, U), line(U, T).", "far(S, T) :- line(S, U), line(U, T)."),
    }
    for name, (yes, no) in cases.items():
        assert getattr(check(yes), name) and not getattr(check(no), name), name


def test_strata():
    p = check(".assert r(string, string). v(X) :- r(X, Y). v(Y) :- r(X, Y). t(X, Y) :- r(X, Y). t(X, Y) :- t(X, Z), r(Z, Y). tc(X, Y) :- v(X), v(Y), NOT t(X, Y).")
    assert p.is_stratifiable and p.is_recursive and not p.is_semi_positive
    assert [p.precedence.is_level_zero(x) for x in ("v", "t", "tc")] == [True, False, False]
    order = [g[0] for g in p.precedence.components()]
    assert order.index("t") < order.index("tc") and order.index("r") < order.index("v")
    assert check(".assert link(string, string). n(X, Y) :- link(X, Z), link(Z, Y), NOT link(X, Y).").is_semi_positive
    assert not check("p(X) :- q(X), NOT p(X).").is_stratifiable
    long = check("a(X) :- b(X). b(X) :- c(X). c(X) :- d(X). d(X) :- e(X), NOT a(X).")
    assert long.is_recursive and not long.is_stratifiable
    assert "arrowhead=empty" in long.precedence.dot()
    assert Precedence([], []).components() == []


def test_algebra():
    a = Atom("boss", (Const("ann"), Const("bo")))
    with pytest.raises(E.NullaryNotAllowed):
        algebra.atom(a)
    # the notation is a fixed format
    assert str(algebra.atom(a, True)) == "σ[0=ann, 1=bo](boss)"
    assert str(algebra.atom(Atom("boss", (Const("ann"), Var("W"))))) == "Π[1](σ[0=ann](boss))"
    assert str(algebra.atom(Atom("twin", (Var("W"), Var("W"))))) == "Π[0](σ[0=1](twin))"
    say = lambda t: str(algebra.rule(rule(t)))
    assert say("chief(A, B) :- boss(A, B).") == "chief ≔ boss"
    assert say("busy(W) :- shift(W, H), H != 8.") == "busy ≔ Π[W](σ[1!=8](shift))"
    assert say("chain(A, C) :- boss(A, B), chain(B, C).") == "chain ≔ Π[A, C]((chain) ⨝  (boss))"
    assert say("chain(A, C) :- boss(A, B), chain(B, C), A != 7, C != 7.") == "chain ≔ Π[A, C]((σ[1!=7](chain)) ⨝  (σ[0!=7](boss)))"
    assert say("late(W) :- shift(W, H), 20 < H.") == "late ≔ Π[W](σ[1>20](shift))"
    assert say("over(W, L) :- shift(W, H), limit(L), H < L.") == "over ≔ Π[W, L]((limit) ⨝[H<L] (shift))"
    assert say("free(W) :- staff(W), NOT ill(W).") == "free ≔ Π[W]((staff) ∖ (ill))"
    assert algebra.rule(rule("busy(W) :- shift(W, H).")).dot().startswith("digraph")


def test_kinds_are_inferred_through_derived_relations():
    p = check("e(a, 1). p(Y, X) :- e(X, Y). q(Z) :- p(Z, _). r(Z, W) :- r(Z, W), q(Z).")
    kinds = p.typed()
    assert kinds["q"].kinds == [Kind.INTEGER] and kinds["p"].kinds == [Kind.INTEGER, Kind.STRING]
    with pytest.raises(E.IncompatibleTypes):
        check("e(a, 1). p(X) :- e(X, X).").typed()
    with pytest.raises(E.IncompatibleTypes):
        check("e(a, 1). p(X) :- e(X, Y), Y < 1.5.").typed()
    with pytest.raises(E.RelationDoesNotExist):
        check("p(X) :- nothing(X).").typed()


def test_api_builds_what_text_says():
    p = Program()
    p.declare_extensional("parent", schema("string", "string"))
    x, y, z = map(Var, "XYZ")
    assert p.add_fact("parent", "xerces", "brooke") and not p.add_fact("parent", "xerces", "brooke")
    p.add_fact("parent", "brooke", "damocles")
    p.pure_rule(Atom("ancestor", (x, y)), Atom("parent", (x, y)))
    p.pure_rule(Atom("ancestor", (x, y)), Atom("parent", (x, z)), Atom("parent", (z, y)))
    p.add_query(Query(Atom("ancestor", (Const("xerces"), x))))
    text = "parent(xerces, brooke). parent(brooke, damocles). ancestor(X, Y) :- parent(X, Y). ancestor(X, Y) :- parent(X, Z), parent(Z, Y). ?- ancestor(xerces, X)."
    assert str(p) == str(parse(text))
    with pytest.raises(E.IncompatibleTypes):
        p.atom("parent", 1, ANY)
    with pytest.raises(E.FactDoesNotConform):
        p.add_fact("parent", "only one")
    assert Rule((Atom("a", (x,)),), (Literal(Atom("b", (x, y))), Literal(Comparison(y, "<", Const(2))))).non_distinguished == {"Y"}


def test_rules_can_be_built_and_relations_merged():
    x, y = Var("X"), Var("Y")
    built = RuleBuilder().head(Atom("idle", (x,))).body(Atom("staff", (x, y)), Comparison(y, ">", Const(3))).without(Atom("ill", (x,))).build()
    assert built == rule("idle(X) :- staff(X, Y), Y > 3, NOT ill(X).")
    p, q = parse("e(a, 1). e(b, 2)."), parse("e(b, 2). e(c, 3). f(z). g(X) :- e(X, _).")
    assert p.extend("e", [("b", 2), ("d", 4)]) == 1 and p.merge(q) == 2
    assert len(p.extensional["e"].facts) == 4 and len(p.extensional["f"].facts) == 1
    bare = q.only_schemas()
    assert set(bare.extensional) == {"e", "f"} and set(bare.intensional) == {"g"} and not bare.rules and not bare.extensional["e"].facts


@given(st.text(max_size=12))
def test_any_string_survives_printing(text):
    if any(ord(c) < 32 and c != "\t" for c in text):
        return
    p = parse(f"f({Const(text)}).")
    assert next(iter(p.extensional["f"].facts)) == (text,)
