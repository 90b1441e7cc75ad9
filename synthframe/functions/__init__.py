"""Column functions: identity, draws, conversion, names, canonical text."""
