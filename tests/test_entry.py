import ast
import os

import __spark_entry__ as entry

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 50


def test_flagship(spark):
    assert entry.entry(spark).columns == ["doc_id", "redacted_sha256", "n_chars"]


def test_nothing_else_imports_the_optional_subpackage():
    for folder, _, names in os.walk(os.path.join(ROOT, "sparkveil")):
        if os.path.basename(folder) == "llm":
            continue
        for name in names:
            if name.endswith(".py"):
                tree = ast.parse(open(os.path.join(folder, name), encoding="utf-8").read())
                used = [getattr(n, "module", "") or "" for n in ast.walk(tree) if isinstance(n, ast.ImportFrom)]
                assert not any("llm" in m.split(".") for m in used)
