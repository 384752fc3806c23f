"""Relational operators that Spark's SQL lacks or answers differently."""
