"""A deductive query engine on PySpark: Datalog programs as DataFrame plans."""
