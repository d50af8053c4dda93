from __future__ import annotations

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_queries_are_listed_without_a_session():
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(len(q))"
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    assert int(out.stdout.split()[-1]) >= 100


def test_entry_lives_without_the_corpus_operators(tmp_path):
    for name in ("strandline", "__spark_entry__.py"):
        (tmp_path / name).symlink_to(ROOT / name)
    code = "import sys; sys.modules['strandline.llm'] = None; import __spark_entry__ as e; print(sorted(k for k in e.queries() if k.startswith('op') or k == 'pipeline'))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0 and out.stdout.split("\n")[-2] == "[]", out.stderr


def test_nothing_else_imports_the_corpus_operators():
    for path in (ROOT / "strandline").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT / "strandline").parts:
            text = path.read_text()
            assert "strandline.llm" not in text and "from .llm" not in text and "from ..llm" not in text, path


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns[:2] == ["conv_id", "index"] and df.count() > 0
