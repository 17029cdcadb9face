"""The queries with SQL against it, on the smallest tables and the next ones."""

import pytest

from spectramesh.llm.queries import ORACLES, QUERIES
from tests.compare import connect, table


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, name, sf):
    d = f"/root/testdata/{sf}"
    df = QUERIES[name](spark, d)
    rel = connect(d).sql(ORACLES[name])
    got, want = table(df.columns, [tuple(r) for r in df.collect()]), table(rel.columns, rel.fetchall())
    assert got[0] == want[0] and len(got[1]) == len(want[1])
    assert got[1] == want[1]
