"""Queries over the given tables and the SQL they are checked against."""


def load():
    """The register with all queries in it."""
    from statspine.plans import analytic, catalog, exchange, relational, service, streams  # noqa: F401

    return catalog
