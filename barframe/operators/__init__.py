"""Operators over bar tables: history and rolling windows, recursive folds, strategies, outputs."""
