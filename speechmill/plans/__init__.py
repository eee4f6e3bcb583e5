"""Compositions of the operators over the given tables, with equivalent SQL."""
