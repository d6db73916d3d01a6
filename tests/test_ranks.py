"""Global order statistics from range partitions."""

import random
import statistics

import pytest

from partcast.operators import ranks as R


@pytest.mark.parametrize("partitions", [1, 8])
def test_medians_and_positions(spark, partitions):
    rng = random.Random(4)
    rows = [("a", float(rng.randint(0, 5))) for _ in range(201)] + [("b", rng.random()) for _ in range(100)] + [("c", 7.0), ("d", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(partitions)
    got = {r["g"]: r["median"] for r in R.medians(df, "v", "g").collect()}
    assert got == {g: statistics.median([v for h, v in rows if h == g]) for g in "abc"}
    a = sorted(v for g, v in rows if g == "a")
    for r in R.positions(df, "v", df.g).where("grp = 'a'").collect():
        assert r["before"] == a.index(r["val"]) and r["ties"] == a.count(r["val"])


def test_ordinals_do_not_depend_on_the_partitions(spark):
    rows = [(k * 37 % 101,) for k in range(300)]
    codes = []
    for n in (1, 8):
        got = R.ordinals(spark.createDataFrame(rows, "item long").repartition(n), "item").collect()
        codes.append({r["item"]: r["code"] for r in got})
    keys = sorted({r[0] for r in rows})
    assert codes[0] == codes[1] == {k: float(i) for i, k in enumerate(keys)}
