"""Registered queries against their SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry_points
from pairloom.oracle.sql import ORACLE
from pairloom.plans.queries import REGISTRY

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    connection = duckdb.connect()
    for name in TABLES:
        path = os.path.join(sf_dir, f"{name}.parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return connection


def _rows(rows, columns, wanted):
    at = [columns.index(c) for c in wanted]

    def clean(v):
        if isinstance(v, float):
            return None if math.isnan(v) else round(v, 7)
        return v

    out = [tuple(clean(r[i]) for i in at) for r in rows]
    return sorted(out, key=lambda r: [(v is None, str(v)) for v in r])


def test_every_query_has_sql():
    assert set(REGISTRY) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_equals_sql(name, spark, sf_dir, duck):
    df = entry_points.queries()[name](spark, sf_dir)
    result = duck.execute(entry_points.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    assert sorted(df.columns) == sorted(columns)
    wanted = sorted(columns)
    ours = _rows([tuple(r) for r in df.collect()], df.columns, wanted)
    assert ours == _rows(result.fetchall(), columns, wanted)


def test_gate_stops_a_phase(spark, monkeypatch):
    swept = [(i + 1, n, 0.04 * (i + 1), 1.0) for i, n in enumerate((500, 1000, 2000, 3000, 5000, 10000))]
    frame = spark.createDataFrame(swept, "run_seq long, data_size long, bleu double, chrf double")
    monkeypatch.setattr("pairloom.plans.queries._sweep", lambda *_: frame)
    phases = {n: [r["phase"] for r in REGISTRY[n](spark, "").orderBy("run_seq").collect()]
              for n in ("phased_sweep", "phased_sweep_passed")}
    assert phases == {"phased_sweep": [*"111"], "phased_sweep_passed": [*"111223"]}


def test_entry(spark):
    assert entry_points.entry(spark).count() == 1
