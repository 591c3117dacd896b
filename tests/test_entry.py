import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from lanewright.plans import json_queries, queries

ROOT = Path(__file__).resolve().parent.parent
SF = "/root/testdata/sf0.001"
TABLES = ("part", "events", "supplier", "customer")


def cells(rows):
    return sorted(tuple(str(round(x, 4)) if isinstance(x, float) else str(x) for x in r) for r in rows)


OWN, SQL = queries.QUERIES | json_queries.QUERIES, queries.ORACLE_SQL | json_queries.ORACLE_SQL


@pytest.mark.parametrize("name", sorted(OWN))
def test_query(spark, name):
    df = OWN[name](spark, SF)
    columns = sorted(df.columns)
    rows = df.select(columns).collect()
    assert rows
    if name in SQL:
        with duckdb.connect() as c:
            for t in TABLES:
                c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
            want = c.sql(SQL[name]).project(", ".join(columns)).fetchall()
        assert cells(rows) == cells(want)


def test_bounds_of_a_long_track(spark, tmp_path):
    """A track of more points than a map draws has the box and the centre of all of them (F3)."""
    with duckdb.connect() as c:
        for t in TABLES:
            c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
        c.sql(f"copy part to '{tmp_path}/part.parquet' (format parquet)")
        many = "select e.* replace (e.event_id + 1000000 * k as event_id, 1 as user_id) from events e, range(12) r(k) where e.event_id <= 700"
        c.sql(f"copy (select * from events where user_id > 1 union all {many}) to '{tmp_path}/events.parquet' (format parquet)")
        c.sql(f"create or replace view events as select * from '{tmp_path}/events.parquet'")
        assert c.sql("select max(n) from (select count(*) as n from events group by user_id)").fetchall()[0][0] > 6000
        df = json_queries.map_bounds(spark, str(tmp_path))
        columns = sorted(df.columns)
        want = c.sql(SQL["map_bounds"]).project(", ".join(columns)).fetchall()
    exact = lambda rows: sorted((tuple(r) for r in rows), key=lambda r: r[columns.index("user_id")])
    assert exact(df.select(columns).collect()) == [pytest.approx(r, abs=1.1e-6) for r in exact(want)]


def test_entry(spark):
    assert entry.entry(spark).count() == 15


def test_without_the_corpus_operators():
    code = (
        "import sys\n"
        "class Gone:\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name == 'corpus_pipeline' or name.startswith('lanewright.llm'):\n"
        "            raise ModuleNotFoundError(name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e\n"
        "assert len(e.queries()) > 15 and not any(n.startswith('op') or n == 'pipeline' for n in e.queries()) and e.oracle_sql()\n"
    )
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
