"""Operators for training-data pipelines, each by the method its module names."""


def load():
    """(queries, oracles) of this subpackage."""
    from treemend.llm import queries

    return dict(queries.QUERIES), dict(queries.ORACLES)
