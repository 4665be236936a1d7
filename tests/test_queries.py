"""Every query of the level-set library that has SQL, against DuckDB; and how the entry module behaves without the corpus part."""

import subprocess
import sys
from pathlib import Path

import pytest

from isofield.jobs.queries import ORACLES, QUERIES

ROOT = Path(__file__).resolve().parents[1]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, sf, duck, same, name):
    same(QUERIES[name](spark, sf).toPandas(), duck(ORACLES[name], sf))


@pytest.mark.parametrize("name", ["point_normals", "surface_segments", "connectivity"])
def test_rows(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry_without_corpus_part(tmp_path):
    (tmp_path / "isofield").mkdir()
    for p in ROOT.glob("isofield/*"):
        if p.name != "llm":
            (tmp_path / "isofield" / p.name).symlink_to(p)
    (tmp_path / "__spark_entry__.py").write_text((ROOT / "__spark_entry__.py").read_text())
    code = "import __spark_entry__ as e; q = e.queries(); assert 'prune' in q and not any(k.startswith('op') and k[2].isdigit() for k in q), list(q); assert 'pipeline' not in q; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path), "HOME": "/tmp"} | {k: v for k, v in __import__("os").environ.items() if k == "JAVA_HOME"})
