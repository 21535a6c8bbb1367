"""Registered queries, one module for each family of operators."""

from importlib import import_module

MODULES: tuple[str, ...] = ("journeys", "places", "raster", "sky", "assets", "network", "lifecycle", "stars", "sheets", "bakes", "relief", "tiles", "files", "stores", "compositions")


def load_all() -> None:
    for name in MODULES:
        import_module(f"terravia.plans.{name}")
