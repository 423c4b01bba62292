import datetime as dt
import random

import pytest

from skytriage.operators.sweep import disjoint_pieces, first_covering

START = dt.datetime(2024, 1, 1)


def moment(k):
    return None if k is None else START + dt.timedelta(seconds=k)


def answers(points, intervals):
    """(key, time, name) by looking at every interval of the key."""
    out = []
    for key, t in points:
        hits = [(o, s, n) for k, s, e, o, n in intervals if None not in (k, t, s, e) and k == key and s <= t <= e]
        out.append((key, t, min(hits)[2] if hits else None))
    return sorted(out, key=str)


def found(spark, points, intervals, blocks=None):
    p = spark.createDataFrame([(k, moment(t), "x") for k, t in points], "site string, observed_at timestamp, row string").repartition(3)
    i = spark.createDataFrame([(k, moment(s), moment(e), o, n) for k, s, e, o, n in intervals], "site string, starts_at timestamp, ends_at timestamp, ordinal int, name string").repartition(2)
    rows = first_covering(p, i, "site", "observed_at", "ordinal", ["name"], blocks).collect()
    assert all(r["row"] == "x" for r in rows)
    return sorted(((r["site"], None if r["observed_at"] is None else int((r["observed_at"] - START).total_seconds()), r["name"]) for r in rows), key=str)


@pytest.mark.parametrize("blocks", [1, 7, 40])
def test_against_every_interval(spark, blocks):
    rng = random.Random(blocks)
    intervals = []
    for n in range(160):
        s = rng.randrange(400)
        length = rng.choice([0, 1, 3, 20, 300, 2000, -5])
        intervals.append((rng.choice(["a", "a", "b", "c"]), s, s + length, n * 7 % 160, f"i{n}"))
    intervals += [(None, 0, 9, 1, "no site"), ("b", None, 5, 2, "no start"), ("b", 4, None, 3, "no end"), ("z", 1, 2, 4, "unasked"), ("a", -5000, 9000, 500, "always")]
    points = [(rng.choice(["a", "b", "c", "d"]), rng.randrange(-20, 2500)) for _ in range(400)] + [("a", 7)] * 30 + [(None, 3), ("a", None)]
    assert found(spark, points, intervals, blocks) == answers(points, intervals)


def test_one_minute_of_one_site_holds_most_rows(spark):
    rng = random.Random(1)
    intervals = [("hot", s := 100 + rng.randrange(50), s + rng.randrange(9), n, f"i{n}") for n in range(300)] + [("cold", 0, 500, 1, "c")]
    points = [("hot", 100 + rng.randrange(60)) for _ in range(600)] + [("cold", k) for k in range(90, 300, 9)]
    assert found(spark, points, intervals, 16) == answers(points, intervals)


def test_pieces_are_disjoint_and_change(spark):
    rows = [("s", moment(0), moment(10), 2, "wide"), ("s", moment(3), moment(5), 1, "first"), ("s", moment(4), moment(20), 3, "last"), ("s", moment(30), moment(30), 4, "instant")]
    i = spark.createDataFrame(rows, "site string, starts_at timestamp, ends_at timestamp, ordinal int, name string")
    zero = int(START.replace(tzinfo=dt.timezone.utc).timestamp()) * 1_000_000
    got = [((r["begin"] - zero) / 1e6, r["row"]["name"] if r["row"] else None) for r in disjoint_pieces(i, "site", "ordinal", ["name"], 1).orderBy("begin").collect()]
    assert got == [(0, "wide"), (3, "first"), (5.000001, "wide"), (10.000001, "last"), (20.000001, None), (30, "instant"), (30.000001, None)]


def test_intervals_that_end_where_a_block_begins(spark):
    intervals = [(site, 10 * k, 10 * k + 5, k, f"{site}{k}") for site in "abcdef" for k in range(6)]
    points = [(site, t) for site in "abcdef" for t in range(70)]
    for blocks in (2, 5, 12, 72):
        assert found(spark, points, intervals, blocks) == answers(points, intervals)


def test_no_intervals_and_no_points(spark):
    assert found(spark, [("a", 1)], []) == [("a", 1, None)]
    assert found(spark, [], [("a", 1, 2, 0, "i")]) == []
