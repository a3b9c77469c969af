"""The entry module: what it registers, and that the library does without the llm subpackage."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_every_sql_belongs_to_a_query():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 140


def test_entry(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.columns == ["l_returnflag", "n"] and df.count() > 0


def test_nothing_else_imports_llm():
    names = []
    for top, _, files in os.walk(os.path.join(ROOT, "gleaner")):
        for f in files:
            if f.endswith(".py") and f"{os.sep}llm" not in top:
                names.append(os.path.relpath(os.path.join(top, f), ROOT)[:-3].replace(os.sep, ".").removesuffix(".__init__"))
    code = f"import sys, importlib\nfor m in {names!r}: importlib.import_module(m)\nassert not [m for m in sys.modules if m.startswith('gleaner.llm')]"
    subprocess.run([sys.executable, "-c", code], check=True, env=os.environ | {"PYTHONPATH": ROOT})


def test_an_import_error_inside_is_not_swallowed(tmp_path):
    (tmp_path / "corpus_pipeline.py").write_text("import no_such_module\n")
    env = os.environ | {"PYTHONPATH": os.pathsep.join([str(tmp_path), ROOT])}
    got = subprocess.run([sys.executable, "-c", f"import sys; sys.path.insert(0, {str(tmp_path)!r}); import __spark_entry__"], env=env, capture_output=True, text=True, cwd=str(tmp_path))
    assert got.returncode and "no_such_module" in got.stderr
