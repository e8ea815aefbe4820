"""Relational operators: each is ``f(df, ...) -> DataFrame``."""
