"""Queries over the given tables, one for each operator, with SQL twins where SQL can express them."""
