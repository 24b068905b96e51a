"""Every query on text gives rows over the smallest tables, with the columns fixed for it."""

import pytest

from veristrata.llm.queries import QUERIES

COLUMNS = {
    "p2_found": {"tab": "string", "id_a": "bigint", "id_b": "bigint"}, "p3_found": {"tab": "string", "row_id": "bigint"}, "p5_found": {"tab": "string", "row_id": "bigint", "kind": "string", "found_text": "string"}, "p6_found": {"tab": "string", "row_id": "bigint", "line_no": "int"},
    "p7_found": {"tab": "string", "row_id": "bigint", "field": "string", "name_id": "bigint"}, "p9_found": {"doc_id": "bigint", "item_id": "bigint"}, "p10_found": {"doc_id": "bigint"},
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, folder, name):
    df = QUERIES[name](spark, folder)
    if name in COLUMNS:
        assert dict(df.dtypes) == COLUMNS[name]
    rows = df.collect()
    assert rows and (name not in COLUMNS or len(rows) == len(set(rows)))
