"""The coverage table names only functions and queries that exist."""

import importlib
import re
from pathlib import Path

from catalog import ORACLE_SQL, QUERIES

TEXT = (Path(__file__).resolve().parents[1] / "COVERAGE.md").read_text()
ROWS = [[c.strip() for c in line.strip("|\n").split("|")] for line in TEXT.splitlines() if re.match(r"\| [A-Z]\d", line)]
PACKAGES = ("functions", "operators", "sources", "plans", "streaming")


def find(path):
    module, _, name = path.rpartition(".")
    module = module.removeprefix("plans.")
    for package in PACKAGES:
        try:
            found = importlib.import_module(f"daygrain.{package}.{module}")
        except ModuleNotFoundError:
            continue
        if hasattr(found, name):
            return True
    return False


def test_functions_exist():
    for row in ROWS:
        module = ""
        for path in re.findall(r"`([\w.]+)`", row[1]):
            module = path.rpartition(".")[0] or module
            assert find(path if "." in path else f"{module}.{path}"), (row[0], path)


def test_queries_exist_and_stars_have_no_twin():
    named = set()
    for name, star in re.findall(r"`(\w+)`(\*?)", "\n".join(row[2] for row in ROWS) + TEXT[TEXT.rindex("Whole pipeline"):].split("is ", 1)[1]):
        assert name in QUERIES, name
        assert bool(star) == (name not in ORACLE_SQL), name
        named.add(name)
    assert named == set(QUERIES)
