"""Everything that can go wrong has a type of its own."""


class DatalogError(Exception):
    """Base of all errors of the engine."""


class FileAccessError(DatalogError):
    """A file cannot be read or written."""


class ParseError(DatalogError):
    """The text is not a program; ``line`` and ``column`` say where."""

    def __init__(self, message: str, line: int = 0, column: int = 0):
        super().__init__(f"{line}:{column}: {message}" if line else message)
        self.line, self.column = line, column


class SerializationError(DatalogError):
    """A file does not hold rows of the relation's schema."""


class UnknownFormat(DatalogError):
    """No reader or writer has this name."""


class UnsupportedOperation(DatalogError):
    """The format cannot do this, as reading text tables."""


class FeatureDisabled(DatalogError):
    """The program uses a language feature that it does not declare."""


class FeatureUnsupported(DatalogError):
    """The evaluator has no meaning for this feature."""


class InvalidValue(DatalogError):
    """A name, constant or pattern is malformed."""


class FactDoesNotConform(DatalogError):
    """A fact has the wrong number or kinds of values."""


class ExtensionalInHead(DatalogError):
    """A rule would derive facts of an extensional relation, or a relation would be both kinds."""


class InvalidHeadCount(DatalogError):
    """The number of head atoms fits no enabled kind of rule."""


class HeadVariablesMissing(DatalogError):
    """A head variable stands in no positive relational literal."""


class NegativeVariablesMissing(DatalogError):
    """A variable of a negated literal stands in no positive relational literal."""


class ComparisonVariablesMissing(DatalogError):
    """A variable of a comparison stands in no positive relational literal."""


class RelationExists(DatalogError):
    pass


class RelationDoesNotExist(DatalogError):
    pass


class AttributeDoesNotExist(DatalogError):
    pass


class InvalidAttributeIndex(DatalogError):
    pass


class NotStratifiable(DatalogError):
    """A predicate depends on its own negation."""


class NullaryNotAllowed(DatalogError):
    """Facts and projections need at least one column."""


class ComparisonAlwaysTrue(DatalogError):
    pass


class ComparisonAlwaysFalse(DatalogError):
    pass


class IncompatibleTypes(DatalogError):
    """Values of different kinds are never compared or coerced."""


class AnonymousNotAllowed(DatalogError):
    """The anonymous variable has no meaning here."""


class ConstraintViolated(DatalogError):
    """A headless rule or a functional dependency does not hold."""
