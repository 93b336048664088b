import os

import pytest
from noteweave.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_unmatched_values_are_listed(spark):
    texts = {(r.src_table, r.row_id): r.text for r in queries._typed_values(spark, SF).collect()}
    want = {(r.src_table, r.row_id) for r in queries.p3_found(spark, SF).collect() if r.code == "NONE"}
    got = {(r.src_table, r.row_id): r.text for r in queries.p3_unmatched(spark, SF).collect()}
    assert want and got == {k: texts[k] for k in want}
