import os

import pytest

from kervan.llm.oracle import ORACLE
from kervan.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"
COLUMNS = {
    "p1_found": ["field", "row_id"], "p2_found": ["field", "id_a", "id_b"], "p3_found": ["chunk_id_a", "chunk_id_b"], "p4_found": ["field", "row_id"],
    "p5_found": ["field", "left_id", "right_id"], "p6_found": ["field", "medicine_id", "start_pos", "end_pos"], "p7_ids": ["doc_id", "ids"], "p9_found": ["doc_id"],
}


def test_every_sql_has_its_query():
    assert set(ORACLE) <= set(QUERIES) and set(COLUMNS) <= set(QUERIES)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are not here")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, DATA)
    got = df.collect()
    assert df.columns == COLUMNS.get(name, df.columns) and got
    if name != "p7_ids":
        assert len({tuple(r) for r in got}) == len(got)
    if name in ("p2_found", "p3_found"):
        assert all(r[-2] < r[-1] for r in got)
    if name == "p5_found":
        assert all(r.left_id < r.right_id for r in got if r.field == "medicine_name")
