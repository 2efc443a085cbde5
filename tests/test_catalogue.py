"""Every registered query of the core against its SQL, and the entry."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from poolwright.plans import catalogue, reads  # noqa: F401 - reads adds its queries
from tests.conftest import SF

REPO = Path(__file__).resolve().parent.parent


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for p in Path(SF).glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    quoted = ", ".join(f'"{c}"' for c in columns)
    assert sorted(duck.sql(catalogue.ORACLE_SQL[name]).columns) == columns
    assert got == sorted(map(tuple, duck.sql(f"SELECT {quoted} FROM ({catalogue.ORACLE_SQL[name]})").fetchall()), key=repr)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["o_orderkey", "o_custkey", "o_totalprice"] and 0 < df.count() <= 10
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_without_the_text_operators(tmp_path):
    for name in ("__spark_entry__.py", "poolwright"):
        (tmp_path / name).symlink_to(REPO / name) if name.endswith(".py") else None
    copy = tmp_path / "poolwright"
    copy.mkdir()
    for p in (REPO / "poolwright").iterdir():
        if p.name not in ("llm", "__pycache__"):
            (copy / p.name).symlink_to(p)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') and n[2].isdigit() or n == 'pipeline' for n in q); assert e.oracle_sql().keys() == q.keys()"
    (tmp_path / "run.py").write_text(f"import sys; sys.path[:] = [{str(tmp_path)!r}] + [p for p in sys.path if p not in ('', {str(REPO)!r})]\nsys.path_importer_cache.clear()\n{code}\n")
    (tmp_path / "__spark_entry__.py").unlink()
    (tmp_path / "__spark_entry__.py").write_text((REPO / "__spark_entry__.py").read_text())
    subprocess.run([sys.executable, str(tmp_path / "run.py")], check=True, cwd=tmp_path, env={"PATH": "/usr/bin:/bin"})
