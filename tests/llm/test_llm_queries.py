from pathlib import Path

import pytest
from compare import SF, assert_equal

from loamstone.llm import queries as Q

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")

COLUMNS = {
    "p1_found": [("turn_id", "bigint"), ("defect", "string")], "p2_found": [("element_id_a", "string"), ("element_id_b", "string")],
    "p3_found": [("record_table", "string"), ("record_id", "string"), ("field_name", "string"), ("pii_type", "string")], "p5_found": [("element_id", "string")], "p6_found": [("element_id", "string"), ("noise", "string")],
    "p7_found": [("element_id", "string"), ("page", "int")], "p9_found": [("doc_id", "bigint"), ("item_id", "bigint")], "p10_found": [("doc_id_a", "bigint"), ("doc_id_b", "bigint")],
}


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_query_equals_sql(spark, name):
    assert_equal(spark, Q.QUERIES[name], Q.SQL[name])


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_found_has_its_columns_and_distinct_rows(spark, name):
    df = Q.QUERIES[name](spark, SF)
    assert df.dtypes == COLUMNS[name]
    assert df.count() == df.distinct().count()
