"""The driver's contract, with and without the subpackage that may be absent."""

from __future__ import annotations

import ast
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_entry_runs(spark) -> None:
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.columns == ["doc_id", "score"] and df.count() == 10
    assert set(e.oracle_sql()) <= set(e.queries())


def test_imports_without_the_subpackage(tmp_path) -> None:
    """A copy without llm and corpus_pipeline.py still imports and has all other queries."""
    import shutil

    shutil.copytree(ROOT / "tessera", tmp_path / "tessera", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'bm25_or_topk' in q and not any(n.startswith('op') or n == 'pipeline' for n in q), list(q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)


def test_a_broken_subpackage_is_an_error(tmp_path) -> None:
    """Only its absence is passed over, not what goes wrong within it."""
    import shutil

    shutil.copytree(ROOT / "tessera", tmp_path / "tessera", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    (tmp_path / "tessera/llm").mkdir()
    (tmp_path / "tessera/llm/__init__.py").write_text("")
    (tmp_path / "tessera/llm/queries.py").write_text("import not_there_at_all")
    (tmp_path / "corpus_pipeline.py").write_text("run = None")
    code = "import __spark_entry__"
    assert b"not_there_at_all" in subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, timeout=120).stderr


def test_nothing_else_imports_the_subpackage() -> None:
    for path in (ROOT / "tessera").rglob("*.py"):
        if "llm" in path.relative_to(ROOT).parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n.split(".") or n == "corpus_pipeline" for n in names), path
