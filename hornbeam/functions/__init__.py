"""Functions of the language as Columns."""
