"""treemend: data quality and repair for tree-shaped records on Spark."""

__version__ = "0.1.0"
