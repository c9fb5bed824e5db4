"""The library stands without its optional subpackage, and names match between queries and SQL."""

import os
import re

import __spark_entry__

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_nothing_imports_the_optional_subpackage():
    for folder, _, files in os.walk(os.path.join(ROOT, "strandex")):
        if os.sep + "llm" in folder + os.sep and folder.rstrip(os.sep).endswith("llm"):
            continue
        for name in files:
            if name.endswith(".py"):
                with open(os.path.join(folder, name), encoding="utf-8") as f:
                    assert not re.search(r"^\s*(?:from|import)\s+\S*\bllm\b", f.read(), re.M), name


def test_every_sql_has_its_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
