"""Compositions of operators: audit, compile, and the life cycle of a change."""
