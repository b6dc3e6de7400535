"""Training-data operators: one module per operator, queries in :mod:`tidemark.llm.queries`."""
