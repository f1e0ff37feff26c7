"""The data model: kinds, schemas, terms, atoms, literals, rules, queries. All immutable and free of Spark data."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field
from enum import Enum

from pyspark.sql import types as T

from hornbeam import errors as E

_NAME = re.compile(r"[^\W\d_]\w*\Z")
_IDENTIFIER = re.compile(r"[^\W\d_]\w*(:[^\W\d_]\w*)?\Z")


def is_predicate(name: str) -> bool:
    return bool(_NAME.match(name)) and not name[0].isupper()


def is_variable(name: str) -> bool:
    return bool(_NAME.match(name)) and name[0].isupper()


def is_identifier(value: str) -> bool:
    """Strings that are written without quotes."""
    return bool(_IDENTIFIER.match(value)) and not value[0].isupper() and value not in ("true", "false")


class Kind(Enum):
    STRING = "string"
    INTEGER = "integer"
    FLOAT = "float"
    BOOLEAN = "boolean"

    @classmethod
    def named(cls, name: str) -> Kind:
        found = {"str": cls.STRING, "string": cls.STRING, "int": cls.INTEGER, "integer": cls.INTEGER, "float": cls.FLOAT, "bool": cls.BOOLEAN, "boolean": cls.BOOLEAN}.get(name)
        if found is None:
            raise E.InvalidValue(f"no kind is named {name!r}")
        return found

    @classmethod
    def of(cls, value: object) -> Kind:
        for kind, types in ((cls.BOOLEAN, bool), (cls.INTEGER, int), (cls.FLOAT, float), (cls.STRING, str)):
            if isinstance(value, types):
                break
        else:
            raise E.InvalidValue(f"{value!r} is no constant")
        if kind is cls.FLOAT and math.isnan(value):
            raise E.InvalidValue("not a number")
        if kind is cls.INTEGER and not -(1 << 63) <= value < 1 << 63:
            raise E.InvalidValue(f"{value} needs more than 64 bits")
        return kind

    @property
    def spark(self) -> T.DataType:
        return {Kind.STRING: T.StringType(), Kind.INTEGER: T.LongType(), Kind.FLOAT: T.DoubleType(), Kind.BOOLEAN: T.BooleanType()}[self]

    @classmethod
    def of_spark(cls, kind: T.DataType) -> Kind:
        if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
            return cls.INTEGER
        if isinstance(kind, (T.FloatType, T.DoubleType)):
            return cls.FLOAT
        if isinstance(kind, (T.StringType, T.CharType, T.VarcharType)):
            return cls.STRING
        if isinstance(kind, T.BooleanType):
            return cls.BOOLEAN
        raise E.IncompatibleTypes(f"{kind.simpleString()} columns have no kind; project them away")


@dataclass(frozen=True)
class Var:
    name: str

    def __post_init__(self):
        if not is_variable(self.name):
            raise E.InvalidValue(f"{self.name!r} is no variable")

    def __str__(self):
        return self.name


@dataclass(frozen=True)
class Anonymous:
    def __str__(self):
        return "_"


ANY = Anonymous()


@dataclass(frozen=True)
class Const:
    value: object
    kind: Kind = field(init=False)

    def __post_init__(self):
        object.__setattr__(self, "kind", Kind.of(self.value))

    def __eq__(self, other):
        return isinstance(other, Const) and self.kind is other.kind and self.value == other.value

    def __hash__(self):
        return hash((self.kind, self.value))

    def __str__(self):
        if self.kind is Kind.BOOLEAN:
            return "true" if self.value else "false"
        if self.kind is Kind.FLOAT:
            mantissa, _, exponent = f"{self.value!r}".partition("e")
            return f"{mantissa if '.' in mantissa else mantissa + '.0'}e{exponent or 0}"
        if self.kind is Kind.STRING and not is_identifier(self.value):
            return '"' + self.value.replace("\\", "\\\\").replace('"', '\\"').replace("\t", "\\t") + '"'
        return str(self.value)


Term = Var | Anonymous | Const


def term(x: object) -> Term:
    """A term from a plain value: names with a capital are variables only if given as Var."""
    return x if isinstance(x, (Var, Anonymous, Const)) else Const(x)


@dataclass(frozen=True)
class Atom:
    predicate: str
    terms: tuple[Term, ...]
    at: tuple[int, int] = field(default=(0, 0), compare=False)

    def __post_init__(self):
        if not is_predicate(self.predicate):
            raise E.InvalidValue(f"{self.predicate!r} is no predicate")
        if not self.terms:
            raise E.NullaryNotAllowed(self.predicate)

    @property
    def variables(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys(t.name for t in self.terms if isinstance(t, Var)))

    @property
    def is_ground(self) -> bool:
        return all(isinstance(t, Const) for t in self.terms)

    def __str__(self):
        return f"{self.predicate}({', '.join(map(str, self.terms))})"


#: Signs of comparisons; their spellings are the parser's.
MIRROR = {"=": "=", "!=": "!=", "<": ">", "<=": ">=", ">": "<", ">=": "<="}
INVERSE = {"=": "!=", "!=": "=", "<": ">=", "<=": ">", ">": "<=", ">=": "<"}


@dataclass(frozen=True)
class Comparison:
    left: Term
    op: str
    right: Term

    def __post_init__(self):
        if self.op not in (*MIRROR, "*="):
            raise E.InvalidValue(f"no comparison is spelled {self.op!r}")
        if ANY in (self.left, self.right):
            raise E.AnonymousNotAllowed(str(self))
        if isinstance(self.left, Const) and isinstance(self.right, Const):
            check_kinds(self.op, self.left.kind, self.right.kind)
            raise (E.ComparisonAlwaysTrue if holds(self.left.value, self.op, self.right.value) else E.ComparisonAlwaysFalse)(str(self))
        if self.left == self.right and self.op != "*=":
            raise (E.ComparisonAlwaysTrue if self.op in ("=", "<=", ">=") else E.ComparisonAlwaysFalse)(str(self))
        if self.op == "*=" and isinstance(self.right, Const):
            check_kinds("*=", Kind.STRING, self.right.kind)
            try:
                re.compile(self.right.value)
            except re.error as e:
                raise E.InvalidValue(f"{self.right}: {e}") from None

    @property
    def variables(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys(t.name for t in (self.left, self.right) if isinstance(t, Var)))

    def __str__(self):
        return f"{self.left} {self.op} {self.right}"


def check_kinds(op: str, a: Kind | None, b: Kind | None) -> None:
    """Strict typing: equal kinds only, no order of booleans, patterns only for strings."""
    known = [k for k in (a, b) if k is not None]
    if len(set(known)) > 1 or (op == "*=" and any(k is not Kind.STRING for k in known)) or (op in ("<", "<=", ">", ">=") and Kind.BOOLEAN in known):
        raise E.IncompatibleTypes(f"{a and a.value} {op} {b and b.value}")


def holds(a, op: str, b) -> bool:
    if op == "*=":
        return re.search(b, a) is not None
    return {"=": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]


@dataclass(frozen=True)
class Literal:
    of: Atom | Comparison
    negated: bool = False

    @property
    def is_relational(self) -> bool:
        return isinstance(self.of, Atom)

    def __str__(self):
        return f"￢{self.of}" if self.negated else str(self.of)


@dataclass(frozen=True)
class Rule:
    head: tuple[Atom, ...]
    body: tuple[Literal, ...]

    @property
    def form(self) -> str:
        return ("constraint", "pure")[len(self.head)] if len(self.head) < 2 else "disjunctive"

    @property
    def positive_atoms(self) -> list[Atom]:
        return [x.of for x in self.body if x.is_relational and not x.negated]

    @property
    def negative_atoms(self) -> list[Atom]:
        return [x.of for x in self.body if x.is_relational and x.negated]

    @property
    def comparisons(self) -> list[Literal]:
        return [x for x in self.body if not x.is_relational]

    @property
    def distinguished(self) -> list[str]:
        """Variables of the head, in order."""
        return list(dict.fromkeys(v for a in self.head for v in a.variables))

    @property
    def positive_variables(self) -> set[str]:
        return {v for a in self.positive_atoms for v in a.variables}

    @property
    def non_distinguished(self) -> set[str]:
        return {v for x in self.body for v in x.of.variables} - set(self.distinguished)

    @property
    def is_positive(self) -> bool:
        return not any(x.negated for x in self.body)

    @property
    def is_guarded(self) -> bool:
        every = {v for x in self.body for v in x.of.variables}
        return any(set(a.variables) >= every for a in self.positive_atoms)

    @property
    def is_frontier_guarded(self) -> bool:
        return any(set(a.variables) >= set(self.distinguished) for a in self.positive_atoms)

    def __str__(self):
        head = " ∨ ".join(map(str, self.head))
        return f"{head + ' ' if head else ''}⟵ {' ∧ '.join(map(str, self.body))}."


class RuleBuilder:
    """Puts a rule together step by step; ``build`` gives the rule, which does not change any more."""

    def __init__(self):
        self.heads: list[Atom] = []
        self.literals: list[Literal] = []

    def head(self, *atoms: Atom) -> RuleBuilder:
        self.heads += atoms
        return self

    def body(self, *of: Atom | Comparison) -> RuleBuilder:
        self.literals += [Literal(x) for x in of]
        return self

    def without(self, *of: Atom | Comparison) -> RuleBuilder:
        """Negated literals."""
        self.literals += [Literal(x, True) for x in of]
        return self

    def build(self) -> Rule:
        return Rule(tuple(self.heads), tuple(self.literals))



@dataclass(frozen=True)
class Query:
    atom: Atom

    def __str__(self):
        return f"?- {self.atom}."


@dataclass(frozen=True)
class Attribute:
    label: str | None = None
    kind: Kind | None = None

    def __str__(self):
        kind = self.kind.value if self.kind else "_"
        return f"{self.label}: {kind}" if self.label else kind


@dataclass(frozen=True)
class Dependency:
    """determinant -> dependent, as column numbers from 0."""

    determinant: tuple[int, ...]
    dependent: tuple[int, ...]


@dataclass(frozen=True)
class Schema:
    attributes: tuple[Attribute, ...]
    dependencies: tuple[Dependency, ...] = ()

    def __post_init__(self):
        labels = [a.label for a in self.attributes if a.label]
        if len(labels) != len(set(labels)):
            raise E.InvalidValue(f"labels repeat: {', '.join(labels)}")
        if not self.attributes:
            raise E.NullaryNotAllowed("a relation needs a column")

    @property
    def arity(self) -> int:
        return len(self.attributes)

    @property
    def kinds(self) -> list[Kind | None]:
        return [a.kind for a in self.attributes]

    def index(self, key: str | int) -> int:
        """A column number from 0, of a label or a number from 0."""
        if isinstance(key, int):
            if not 0 <= key < self.arity:
                raise E.InvalidAttributeIndex(str(key))
            return key
        for i, a in enumerate(self.attributes):
            if a.label == key:
                return i
        raise E.AttributeDoesNotExist(key)

    def merged(self, other: Schema) -> Schema:
        """Fills in labels and kinds that are unknown here."""
        if self.arity != other.arity:
            raise E.FactDoesNotConform(f"{self.arity} and {other.arity} columns")
        return Schema(tuple(Attribute(a.label or b.label, a.kind or b.kind) for a, b in zip(self.attributes, other.attributes, strict=True)), self.dependencies)

    def check(self, label: str, values: tuple) -> tuple:
        if len(values) != self.arity:
            raise E.FactDoesNotConform(f"{label} has {self.arity} columns, not {len(values)}")
        for v, k in zip(values, self.kinds, strict=True):
            if k is not None and Kind.of(v) is not k:
                raise E.FactDoesNotConform(f"{label}: {Const(v)} is not of kind {k.value}")
            Kind.of(v)
        return values

    def spark(self) -> T.StructType:
        return T.StructType([T.StructField(f"c{i}", (k or Kind.STRING).spark) for i, k in enumerate(self.kinds)])

    def __str__(self):
        return f"({', '.join(map(str, self.attributes))})"


def schema(*columns: str | Kind | Attribute) -> Schema:
    """schema('name: string', 'integer', Kind.FLOAT): a label and a kind, either, or both."""
    out = []
    for c in columns:
        if isinstance(c, Attribute):
            out.append(c)
        elif isinstance(c, Kind):
            out.append(Attribute(None, c))
        elif ":" in c:
            label, kind = (x.strip() for x in c.split(":"))
            out.append(Attribute(None if label == "_" else label, None if kind == "_" else Kind.named(kind)))
        else:
            out.append(Attribute() if c == "_" else Attribute(None, Kind.named(c)))
    return Schema(tuple(out))
