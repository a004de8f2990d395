"""Lineage-tree reconstruction and evaluation as Spark jobs over plain tables."""
