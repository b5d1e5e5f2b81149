"""Registered queries, one per operator."""


def load():
    """(queries, oracles) of all catalogue modules."""
    import importlib
    import pkgutil

    from treemend.catalog import registry

    for module in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{module.name}")
    return registry.QUERIES, registry.ORACLES
