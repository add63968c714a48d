"""Queries over the given tables, one module per operator family."""

from importlib import import_module

FAMILIES = ["lattice", "projections", "joins", "metrics", "sequences", "scoring", "merges", "packages", "jobs", "signals"]


def load():
    for family in FAMILIES:
        import_module(f".{family}", __name__)
    return import_module(".registry", __name__)
