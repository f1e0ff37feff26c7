"""Reading and writing programs as text."""
