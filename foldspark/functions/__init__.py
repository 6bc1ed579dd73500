"""Column expressions: scalar helpers (``exprs``) and the feature recipe (``recipe``)."""
