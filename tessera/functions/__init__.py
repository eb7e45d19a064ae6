"""Functions of the evidence engine."""
