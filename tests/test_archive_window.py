"""Blocks of an archive that a window needs, against a walk backwards, and the folders that a read opens."""

import random
import re

import pytest

from ledgerloom.operators import archive_window as A


def walked(days, today, first, range_days, most):
    """Block by block, backwards, until one reaches the first ledger."""
    limit, read, covered = most if range_days is None else min(most, -(-range_days // 31)), 0, False
    while read < limit and not covered:
        inside = [least for d, least in days if 31 * read <= today - d < 31 * (read + 1)]
        covered, read = first is not None and any(x <= first for x in inside), read + 1
    short = range_days is not None and read * 31 < range_days
    return read, read * 31, covered, not covered or short, short


@pytest.mark.parametrize("most", [1, 2, 4])
def test_depth_matches_a_walk(spark, most):
    r = random.Random(most)
    rows = [(r.randrange(900, 1100), k, k + r.randrange(50)) for k in (r.randrange(5000) for _ in range(300))]
    st = A.day_statistics(spark.createDataFrame(rows, "day bigint, from_ledger bigint, to_ledger bigint"))
    days = [(x.day, x.least) for x in st.collect()]
    windows = [(k, r.randrange(850, 1150), r.choice([None, r.randrange(1500)]), r.choice([None, 30, 90])) for k in range(60)]
    got = A.depth(spark.createDataFrame(windows, "window int, today bigint, from_ledger bigint, range_days bigint"), st, most).collect()
    assert len(got) == 60
    for x in got:
        assert (x.blocks, x.days, x.covered, x.truncated, x.range_truncated) == walked(days, x.today, x.from_ledger, x.range_days, most)


def test_a_read_opens_the_needed_blocks_only(spark, tmp_path):
    rows = spark.range(0, 200).selectExpr("id AS day", "id * 10 AS from_ledger", "id * 10 + 9 AS to_ledger", "'c' AS cluster")
    path, st = str(tmp_path / "archive"), A.day_statistics(rows)
    A.write_archive(rows, path)

    def opened(df):
        return len({re.search(r"day=(\d+)", f)[1] for f in df.inputFiles()}), int(re.search(r"PartitionFilters: .*?day#\d+ >= (\d+)", df._jdf.queryExecution().toString())[1])

    got, flags = A.read_window(spark, path, st, 199, 1500, 1600)
    assert (flags["blocks"], flags["covered"], flags["truncated"]) == (2, True, False)  # two blocks of 31 days
    assert sorted(x.day for x in got.collect()) == list(range(150, 161)) and opened(got)[1] == 138
    plan = got._jdf.queryExecution().executedPlan()
    got.collect()
    assert "PartitionFilters" in plan.toString()
    got, flags = A.read_window(spark, path, st, 199, 1900, 1950)
    assert (flags["blocks"], flags["covered"]) == (1, True) and opened(got)[1] == 169
    got, flags = A.read_window(spark, path, st, 199, 100, 1950, "90d")
    assert (flags["blocks"], flags["covered"], flags["truncated"], flags["range_truncated"]) == (2, False, True, True)
    assert min(x.day for x in got.collect()) == 138
    for bad in ((5, 4, None), (1, 2, "7d")):
        with pytest.raises(ValueError):
            A.read_window(spark, path, st, 199, *bad)
