import datetime

import numpy as np
from noteweave.operators import units

SHAPE = "mention_id long, source string, raw string, v double, u string, t timestamp, amount string"
DAY = datetime.datetime(2024, 1, 1)


def read(spark, rows):
    sources = spark.createDataFrame([("dot", "MG", "."), ("comma", "G", ","), ("none", None, ".")], "source string, default_unit string, decimal_mark string")
    df = spark.createDataFrame([(i, *r, DAY, "kept") for i, r in enumerate(rows)], SHAPE).drop("amount")
    done = units.common_units(df, sources, "raw", "v", "u", "source", "t").orderBy("mention_id").collect()
    return [(None if r.amount is None else round(r.amount, 6), r.common_unit) for r in done]


def test_reading(spark):
    cases = [
        (("dot", "zed 25 mg q8h", 25.0, "MG"), (25.0, "MG")),
        (("dot", "zed 200 µg trong 2 ML", None, None), (0.1, "MG/ML")),
        (("comma", "zed 1.000mg", 1.0, None), (1000.0, "MG")),
        (("comma", "zed 0,5", 0.5, None), (500.0, "MG")),
        (("dot", "zed 0.9%", None, None), (9.0, "MG/ML")),
        (("dot", "zed 3 triệu đv", None, None), (3e6, "UNT")),
        (("dot", "zed 0.25 l", None, None), (250.0, "ML")),
        (("dot", "zed 5 mg/kg", 5.0, "MG/KG"), (None, None)),
        (("dot", "zed 5 viên", 5.0, None), (None, None)),
        (("dot", "2 viên zed 0.125mg", None, None), (0.125, "MG")),
        (("dot", "zed 400mg / 20mg", None, None), (400.0, "MG")),
        (("none", "zed 20", 20.0, None), (None, None)),
        (("dot", None, 10.0, "MCG"), (0.01, "MG")),
        (("dot", "", None, None), (None, None)),
        ((None, "zed 7 mg", None, None), (7.0, "MG")),
        (("dot", "zed sáng 1 chiều 1", None, None), (None, None)),
    ]
    assert read(spark, [c for c, _ in cases]) == [want for _, want in cases]


def test_changepoints_are_exact():
    rng = np.random.default_rng(3)
    for _ in range(20):
        x = rng.normal(0, 1, 12) + np.repeat([0, 6, 0], 4)
        n = np.ones(12)
        got = units.changepoints(x, x * x, n, 8.0)

        def cost(cuts):
            edges = [*cuts, 12]
            return sum(((x[a:b] - x[a:b].mean()) ** 2).sum() + 8.0 for a, b in zip(edges, edges[1:]))

        best = min(([0, *(i + 1 for i in range(11) if m >> i & 1)] for m in range(1 << 11)), key=cost)
        assert abs(cost(got) - cost(best)) < 1e-9


def test_a_change_of_unit_is_found_and_reversed(spark):
    days = [DAY + datetime.timedelta(days=i) for i in range(60)]
    rows = [("s", d.date(), 10.0 * (1000 if i >= 45 else 1) * (1 + i % 3)) for i, d in enumerate(days) for _ in range(3)]
    out = units.unit_shifts(spark.createDataFrame(rows, "source string, day date, value double")).collect()
    assert {r["shift"] for r in out if r.day >= days[45].date()} == {1000.0}
    assert {r["shift"] for r in out if r.day < days[45].date()} == {1.0}
    assert units.unit_shifts(spark.createDataFrame([], "source string, day date, value double")).count() == 0
