"""Catalogue recipes: which files of a library folder are artifacts, as rows (library, path, mode, pattern, name_group, version_group).

recipes.json has those that the package brings: archives named after their version, or in folders of it.
"""

from __future__ import annotations

import json
import os
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from .archives import aar_classes, listing

DEFAULT = os.path.join(os.path.dirname(__file__), "recipes.json")


def load(path: str = DEFAULT, root: str | None = None) -> list[dict]:
    """Recipes from a JSON file: [{"library", "path", "mode": "jar" | "aar", "pattern", "name_group"?, "version_group"?}]; paths are under root, if given."""
    with open(path) as f:
        found = json.load(f)
    return [r | {"path": f"{root}/{r['path']}"} for r in found] if root else found


def artifacts(spark: SparkSession, recipes: list[dict]) -> DataFrame:
    """(path, name, version, content) of all recipes' archives; of AAR files their class archive."""
    found = []
    for r in recipes:
        df = listing(spark, r["path"], r["pattern"], r.get("name_group"), r.get("version_group", 1), r["library"])
        found.append(aar_classes(df) if r["mode"] == "aar" else df)
    return reduce(DataFrame.unionByName, found)
