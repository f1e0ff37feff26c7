"""Reading and writing relations."""
