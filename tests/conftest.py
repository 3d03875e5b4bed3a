from __future__ import annotations

import os
import sys
import tempfile
from pathlib import Path

import pytest

ROOT = str(Path(__file__).parents[1])
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="warehouse-")).getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def same():
    """Compares a query's rows with those of its SQL in DuckDB."""
    import duckdb

    def check(df, sql: str, tables: dict | None = None) -> None:
        c = duckdb.connect()
        for path in Path(SF).glob("*.parquet"):
            c.execute(f"create view {path.stem} as select * from '{path}'")
        for name, t in (tables or {}).items():
            c.register(f"own_{name}", t)
            c.execute(f"create or replace view {name} as select * from own_{name}")
        a, b = df.toPandas(), c.execute(sql).df()
        cols = sorted(a.columns)
        assert cols == sorted(b.columns)
        rows = lambda x: sorted(map(tuple, x[cols].astype(object).where(x[cols].notna(), None).map(lambda v: round(v, 6) if isinstance(v, float) else v).astype(str).values))
        assert rows(a) == rows(b)

    return check
