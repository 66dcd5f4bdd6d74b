"""Views over the given tables and the registered queries on top of them."""

import importlib

FAMILIES: list[str] = ["pixels", "evaluation", "spectral", "learning", "texts", "io"]


def load_all() -> None:
    for family in FAMILIES:
        importlib.import_module(f"bandweave.plans.{family}")
