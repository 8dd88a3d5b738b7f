"""Every query with SQL agrees with DuckDB on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from platewright import queries as registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    return v


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_against_sql(spark, db, name):
    got = registry.QUERIES[name](spark, SF)
    want = db.execute(registry.ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    key = lambda rows: sorted((tuple(map(plain, r)) for r in rows), key=repr)
    assert key(tuple(r[c] for c in columns) for r in got.collect()) == key(want.fetchall())


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_char_error_rate_reads_whole_turns(spark, tmp_path):
    same = "a" * 250
    turns = [(1, 1, same + "b" * 50), (1, 2, same + "c" * 30), (1, 3, same), (2, 1, "x"), (2, 3, "y")]
    spark.createDataFrame(turns, "conv_id long, turn int, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {(r.conv_id, r.turn): r.rate for r in registry.QUERIES["char_error_rate"](spark, str(tmp_path)).collect()}
    assert got == {(1, t): round(distance(a, b) / len(a), 6) for t, a, b in ((1, turns[0][2], turns[1][2]), (2, turns[1][2], turns[2][2]))}
