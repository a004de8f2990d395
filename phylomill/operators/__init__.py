"""Operators on character, neighbour, cluster and tree tables: DataFrames in, DataFrames out."""
