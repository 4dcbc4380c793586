"""Print the query names a module registers."""

import importlib
import os
import sys

sys.path.insert(0, os.path.join(os.path.dirname(__file__), ".."))
from chainloom.plans import catalog

mod = importlib.import_module(f"chainloom.plans.{sys.argv[1]}").__name__
print(" ".join(n for n, f in catalog.QUERIES.items() if f.__module__ == mod))
