"""The registered queries and their inputs, derived from the given tables."""
