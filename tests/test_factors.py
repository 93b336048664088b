import datetime

import pytest
from noteweave.operators import units


@pytest.mark.parametrize("factor", [0.01, 0.1, 10.0, 100.0, 1000.0])
def test_changes_by_any_ratio_of_units_are_known(spark, factor):
    day = datetime.date(2024, 1, 1)
    rows = [("s", day + datetime.timedelta(i), v * (factor if i >= 60 else 1)) for i in range(90) for v in (4.0, 5.0, 6.0)]
    got = units.unit_shifts(spark.createDataFrame(rows, "source string, day date, value double")).collect()
    assert {(r.day >= day + datetime.timedelta(60), r["shift"]) for r in got} == {(False, 1.0), (True, factor)}
