"""Every registered query against its SQL; those without SQL must return rows."""

import pytest

from spectramesh.plans import ORACLES, QUERIES
from tests.compare import close, connect, table


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, name):
    df = QUERIES[name](spark, data)
    got = table(df.columns, [tuple(r) for r in df.collect()])
    if name not in ORACLES:
        assert got[1]
        return
    rel = connect(data).sql(ORACLES[name])
    want = table(rel.columns, rel.fetchall())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    if got[1] != want[1]:
        bad = [(a, b) for a, b in zip(got[1], want[1]) if not close(a, b)]
        assert not bad, bad[:3]
