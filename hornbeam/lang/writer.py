"""Programs as text that parses again, and as LaTeX; a visitor walks the parts of a program in a fixed order."""

from __future__ import annotations

from hornbeam.model import Query, Rule


class Visitor:
    """Callbacks for each part: the program, given relations, derived relations, rules, queries."""

    def program(self, program) -> None: ...

    def relation(self, relation, extensional: bool) -> None: ...

    def fact(self, relation, values: tuple) -> None: ...

    def rule(self, rule: Rule) -> None: ...

    def query(self, query: Query) -> None: ...


def walk(program, visitor: Visitor) -> None:
    visitor.program(program)
    for r in program.extensional.values():
        visitor.relation(r, True)
    for r in program.intensional.values():
        visitor.relation(r, False)
    for r in program.extensional.values():
        for f in r.facts:
            visitor.fact(r, f)
    for r in program.rules:
        visitor.rule(r)
    for q in program.queries:
        visitor.query(q)


def _quoted(text: str) -> str:
    return '"' + text.replace("\\", "\\\\").replace('"', '\\"') + '"'


class TextWriter(Visitor):
    def __init__(self):
        self.head, self.given, self.derived, self.files, self.facts, self.rules, self.asked = [], [], [], [], [], [], []

    def program(self, program):
        if str(program.features):
            self.head.append(str(program.features))
        self.kinds = program.typed()

    def relation(self, relation, extensional):
        schema = self.kinds[relation.label]
        if all(k is not None for k in schema.kinds):
            (self.given if extensional else self.derived).append(f".{'assert' if extensional else 'infer'} {relation.label}{schema}.")
        for d in schema.dependencies:
            side = lambda at: ", ".join(str(i + 1) for i in at)
            self.files.append(f".fd {relation.label}: {side(d.determinant)} --> {side(d.dependent)}.")
        for word, file in (("input", relation.input), ("output", relation.output)):
            if file:
                self.files.append(f".{word}({relation.label}, {_quoted(file.path)}, {_quoted(file.format)}).")

    def fact(self, relation, values):
        from hornbeam.model import Const

        self.facts.append(f"{relation.label}({', '.join(str(Const(v)) for v in values)}).")

    def rule(self, rule):
        self.rules.append(str(rule))

    def query(self, query):
        self.asked.append(str(query))

    def text(self) -> str:
        return "\n\n".join("\n".join(p) for p in (self.head, self.given, self.derived, self.files, self.facts, self.rules, self.asked) if p) + "\n"


def to_text(program) -> str:
    w = TextWriter()
    walk(program, w)
    return w.text()


#: LaTeX for the signs that rules are printed with.
LATEX = {"⟵": r"\leftarrow", "∧": r"\wedge", "∨": r"\vee", "￢": r"\neg ", "!=": r"\neq", "<=": r"\leq", ">=": r"\geq", "*=": r"\approx", "_": r"\_"}


def to_latex(program) -> str:
    """The facts, rules and queries as an aligned display."""
    w = TextWriter()
    walk(program, w)

    def tex(line: str) -> str:
        for a, b in LATEX.items():
            line = line.replace(a, b)
        return line.replace("?-", "?\\text{-}")

    body = " \\\\\n".join("  & " + tex(x) for x in (*w.facts, *w.rules, *w.asked))
    return "\\begin{align*}\n" + body + "\n\\end{align*}\n"
