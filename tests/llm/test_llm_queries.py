import os

import pytest

from lexiloom.llm.oracles import ORACLES
from lexiloom.llm.queries import QUERIES

from ..support import SF, same

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("name", sorted(set(QUERIES) & set(ORACLES)))
def test_query_equals_sql(spark, name):
    same(spark, name, QUERIES, ORACLES)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs(spark, name):
    found = QUERIES[name](spark, SF).count()
    assert found > 0 or name == "p6_matches"  # the smallest tables hold no leak


def test_found_queries_have_their_columns(spark):
    columns = {
        "p1_found": [("doc_lo", "string"), ("doc_hi", "string")],
        "p2_found": [("review_id", "bigint"), ("term", "string")],
        "p3_found": [("group_id", "string"), ("doc_id", "string")],
        "p4_found": [("product_id", "string"), ("place", "int"), ("review_id", "bigint")],
        "p5_found": [("term", "string"), ("mark", "string")],
        "p6_found": [("item_id", "bigint"), ("doc_id", "bigint")],
        "p7_found": [("source", "string"), ("copies", "int")],
        "p8_found": [("doc_id", "bigint"), ("fault", "string")],
    }
    for name, wanted in columns.items():
        assert QUERIES[name](spark, SF).dtypes == wanted
