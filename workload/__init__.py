"""The operators run over the given tables, each beside its SQL."""
