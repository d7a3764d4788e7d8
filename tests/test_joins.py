import pytest
from conftest import rows_of
from pyspark.sql import DataFrame

from cohortweave.operators import joins
from cohortweave.operators.ordering import running_below


@pytest.fixture
def sides(frame):
    # key 1 holds most rows, key 9 has no partner, some keys are missing
    keys = [1] * 40 + [2] * 5 + [3] * 3 + [9] * 2 + [None] * 6
    fact = frame("id bigint, k bigint", [(i, k) for i, k in enumerate(keys)])
    dim = frame("k bigint, name string", [(1, "a"), (2, "b"), (2, "bb"), (4, "d"), (None, "n")])
    return fact, dim


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("min_rows", [1, 4, 20, 1_000])
def test_skew_join_equals_plain_join(sides, how, min_rows):
    fact, dim = sides
    hot = joins.hot_keys(fact, "k", min_rows=min_rows)
    salted = joins.skew_join(fact, dim, "k", how, spread=["id"], hot=hot)
    plain = fact.join(dim, "k", how)
    assert rows_of(salted, *plain.columns) == rows_of(plain)


def test_every_hot_key_is_listed(frame):
    rows = [(i, i % 12_000) for i in range(48_000)] + [(i, 7) for i in range(100)]
    hot = joins.hot_keys(frame("id bigint, k bigint", rows), "k", min_rows=2)
    assert hot.count() == 12_000
    assert rows_of(hot.filter("k IN (7, 8)")) == [(7, 52), (8, 2)]


def test_a_hot_list_beyond_the_broadcast_is_joined_by_key(sides, monkeypatch):
    fact, dim = sides
    monkeypatch.setattr(joins, "BROADCAST_LIMIT_BYTES", 0)
    hot = joins.hot_keys(fact, "k", min_rows=2)
    joined = joins.skew_join(fact, dim, "k", "left", spread=["id"], hot=hot)
    plain = fact.join(dim, "k", "left")
    assert rows_of(joined, *plain.columns) == rows_of(plain)


def test_a_hot_key_is_spread_evenly(frame):
    """With a third of all rows on one key, no (key, salt) group stays large."""
    rows = [(i, 1 if i % 3 == 0 else i + 5_000) for i in range(3_000)]
    fact = frame("id bigint, k bigint", rows)
    hot = joins.hot_keys(fact, "k", min_rows=100)
    salted = fact.join(hot, "k").selectExpr("pmod(xxhash64(id), _copies) AS salt")
    sizes = [r["count"] for r in salted.groupBy("salt").count().collect()]
    assert len(sizes) == 10 and sum(sizes) == 1_000 and max(sizes) < 150
    dim = frame("k bigint, v string", [(1, "hot"), (5_007, "rare")])
    joined = joins.skew_join(fact, dim, "k", "inner", spread=["id"], hot=hot)
    assert rows_of(joined.groupBy("v").count()) == [("hot", 1_000), ("rare", 1)]


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("limit", [0, 40, 1 << 20])
def test_lookup_join_gives_one_result_on_every_way(sides, how, limit):
    fact, dim = sides
    found = joins.lookup_join(fact, dim, "k", how, spread=["id"], limit_bytes=limit)
    plain = fact.join(dim, "k", how)
    assert rows_of(found, *plain.columns) == rows_of(plain)


def test_lookup_join_ways(sides):
    fact, dim = sides

    def plan(**kw):
        df = joins.lookup_join(fact, dim, "k", "left", spread=["id"], **kw)
        return df._jdf.queryExecution().analyzed().toString()

    assert "_salt" not in plan() and "strategy=broadcast" in plan()
    # 5 rows with text exceed the limit, the 3 used ones do not
    assert joins.measured_bytes(dim) > 70
    used = plan(limit_bytes=70)
    assert "_salt" not in used and "LeftSemi" in used
    assert "_salt" in plan(limit_bytes=0)


def test_combine_runs_only_before_a_shuffle_join(frame):
    fact = frame("id bigint, k bigint", [(1, 1), (1, 1), (2, 1)])
    dim = frame("k bigint", [(1,)])

    def count(limit):
        return joins.lookup_join(
            fact, dim, "k", "inner", spread=["id"], combine=DataFrame.distinct, limit_bytes=limit
        ).count()

    assert (count(1 << 20), count(0)) == (3, 2)


def test_running_below_matches_brute_force(frame):
    values = [(g, (i * 37) % 50, 1 + i % 4) for i, g in enumerate("aab" * 20)]
    unique = sorted({(g, v): (g, v, w) for g, v, w in values}.values())
    df = frame("g string, v int, w bigint", unique).selectExpr("*", "v div 10 AS bucket")
    got = running_below(df, ["v"], ["w"], "bucket", by=["g"])
    expected = [
        (
            g,
            v,
            sum(x for h, u, x in unique if h == g and u < v),
            sum(x for h, _, x in unique if h == g),
        )
        for g, v, _ in unique
    ]
    assert rows_of(got, "g", "v", "below_w", "total_w") == expected
