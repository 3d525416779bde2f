"""Sending worker-side code to executors that don't have the package installed."""

from __future__ import annotations

import sys

from pyspark import cloudpickle


def ship(module_name: str) -> None:
    """Pickle what Python workers need from this module by value, not by import."""
    cloudpickle.register_pickle_by_value(sys.modules[module_name])
