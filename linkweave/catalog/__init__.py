"""The registered queries: inputs derived from the given tables, and their SQL twins."""
