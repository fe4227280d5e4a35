import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from millrace.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("keep_pipeline", [False, True])
def test_without_the_llm_package(tmp_path, keep_pipeline):
    """In a copy without the optional package a new process still lists all other queries and their SQL."""
    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root, tmp_path / "copy", ignore=lambda folder, names: [n for n in names if n in ("llm", ".git", "__pycache__") or n == "corpus_pipeline.py" and not keep_pipeline])
    told = "import __spark_entry__ as e; print(*sorted(e.queries())); print(*sorted(e.oracle_sql()))"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", told], cwd=tmp_path / "copy", env=env, capture_output=True, text=True, check=True)
    assert [set(x.split()) for x in done.stdout.splitlines()[-2:]] == [set(QUERIES), set(ORACLES)]


def test_nothing_imports_the_llm_package():
    root = Path(__file__).resolve().parents[1]
    others = [p for p in (root / "millrace").rglob("*.py") if "llm" not in p.relative_to(root).parts]
    assert others and not [p for p in others if "millrace.llm" in p.read_text()]


def canon(x):
    if isinstance(x, float):
        return f"{x + 0.0:.9g}"
    return repr(x)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    cur = con.execute(ORACLES[name])
    cols = [d[0] for d in cur.description]
    want = sorted(tuple(map(canon, r)) for r in cur.fetchall())
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(cols)
    assert sorted(tuple(canon(r[c]) for c in cols) for r in got.collect()) == want


def test_the_package_is_sent_to_workers_elsewhere(spark, monkeypatch, tmp_path):
    sent = []
    monkeypatch.chdir(tmp_path)
    monkeypatch.delenv("PYTHONPATH", raising=False)
    monkeypatch.setattr(spark.sparkContext, "addPyFile", sent.append)
    monkeypatch.setattr(spark.sparkContext, "_millrace_sent", False, raising=False)
    for _ in range(2):
        __spark_entry__._ship(spark)
    assert len(sent) == 1 and sent[0].endswith("millrace.zip")
