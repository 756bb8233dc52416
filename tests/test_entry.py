import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_every_oracle_has_a_query():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("pipeline,broken", [(True, False), (False, False), (True, True)])
def test_entry_works_without_the_llm_subpackage(tmp_path, pipeline, broken):
    """Without the folder, with or without the pipeline's file, and where the folder cannot be imported."""
    for name in ["__spark_entry__.py", *["corpus_pipeline.py"] * pipeline]:
        os.symlink(os.path.join(ROOT, name), tmp_path / name)
    os.makedirs(tmp_path / "quarrykit")
    for name in os.listdir(os.path.join(ROOT, "quarrykit")):
        if name != "llm":
            os.symlink(os.path.join(ROOT, "quarrykit", name), tmp_path / "quarrykit" / name)
    if broken:
        os.makedirs(tmp_path / "quarrykit" / "llm")
        (tmp_path / "quarrykit" / "llm" / "__init__.py").write_text("import no_such_module")
    code = "import __spark_entry__ as e; q = e.queries(); assert 'search_dup' in q and not any(n.startswith('op') or n == 'pipeline' for n in q) and set(e.oracle_sql()) <= set(q)"
    done = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr


def test_plans(spark):
    from quarrykit.operators import search
    from quarrykit.sources import store, views

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        return
    found = search.hits(views.files(spark, sf), "size:>1kb ext:en", spark.createDataFrame([], store.USAGE))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
