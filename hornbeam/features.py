"""Language features that a program turns on."""

from __future__ import annotations

from enum import Flag


class Features(Flag):
    NONE = 0
    NEGATION = 1
    COMPARISONS = 2
    CONSTRAINTS = 4
    DISJUNCTION = 8
    FUNCTIONAL_DEPENDENCIES = 16

    @classmethod
    def all(cls) -> Features:
        return cls.NEGATION | cls.COMPARISONS | cls.CONSTRAINTS | cls.DISJUNCTION | cls.FUNCTIONAL_DEPENDENCIES

    @classmethod
    def named(cls, name: str) -> Features:
        return cls[name.upper()]

    @property
    def names(self) -> list[str]:
        return [f.name.lower() for f in Features if f in self and f.value]

    @property
    def language(self) -> str:
        """The usual way to write the dialect, as (￢,θ)Datalog."""
        signs = {"NEGATION": "￢", "COMPARISONS": "θ", "CONSTRAINTS": "⊥", "DISJUNCTION": "∨", "FUNCTIONAL_DEPENDENCIES": "→"}
        on = [signs[f.name] for f in Features if f in self and f.value]
        return f"({','.join(on)})Datalog" if on else "Datalog"

    def __str__(self) -> str:
        return f".feature({', '.join(self.names)})." if self.names else ""
