"""The library does not need its training-data subpackage."""

import ast
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_nothing_else_imports_it():
    for p in (ROOT / "loomspec").rglob("*.py"):
        if "llm" in p.relative_to(ROOT).parts:
            continue
        for node in ast.walk(ast.parse(p.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n.split(".") for n in names), p
