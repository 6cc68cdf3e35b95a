"""Grants to all holders of a role."""

from collections import Counter

import duckdb
import pytest

from loomwork.operators import access
from loomwork.plans import registry
from loomwork.plans.star import RAW

MIDDLE = "/root/testdata/sf0.01"
PACK = 256


def test_administrators_of_any_number(spark):
    """Holders beyond the size that Spark broadcasts by itself are not broadcast; each meets every course once."""
    holders = spark.createDataFrame([(u,) for u in (1, 2, 2, 50, 4000)], "user_id long")
    courses = spark.createDataFrame([(c,) for c in range(5)], "course_id long")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        grants = access.role_grants(holders, courses, [], 1)
        plan = grants._jdf.queryExecution().executedPlan().toString()
        assert "Broadcast" not in plan
        rows = sorted((r.user_id, r.course_id, r.role_id) for r in grants.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert rows == [(u, c, 1) for u in (1, 2, 50, 4000) for c in range(5)]


@pytest.mark.parametrize("name", ["prompt_lines", "role_grants_administrators", "programs_by_name_or_course"])
def test_whole_tables(name, spark):
    """The smallest tables have no prompts, so these run on larger ones."""
    duck = duckdb.connect()
    for table in RAW:
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{MIDDLE}/{table}.parquet'")
    frame = registry.queries()[name](spark, MIDDLE)
    found = Counter(map(tuple, frame.collect()))
    expected = duck.execute(f"SELECT {', '.join(frame.columns)} FROM ({registry.oracle_sql()[name]}) AS x").fetchall()
    assert found == Counter(expected) and expected


SHARED = [(1, 1), (1, 2), (2, 2), (2, 1), (2, 1), (3, 2), (4, None), (5, 9)]
COURSES = [(10, 1), (10, 2), (11, 1), (12, 2), (13, None), (13, 3), (10, 1)]


@pytest.fixture
def roles(spark):
    return spark.createDataFrame(SHARED, "user_id long, program_id long"), spark.createDataFrame(COURSES, "course_id long, program_id long")


def expected_pairs():
    return {(u, c) for u, p in SHARED for c, q in COURSES if p is not None and p == q}


def test_pairs_are_not_shuffled(roles):
    """Pairs are distinct without an aggregation over them, in tasks whose number does not hang on the bytes that meet."""
    grants = access.role_grants(*roles, ["program_id"], 2)
    assert sorted(map(tuple, grants.collect())) == sorted((*p, 2) for p in expected_pairs())
    assert grants.rdd.getNumPartitions() == access.BLOCKS
    top = grants._jdf.queryExecution().optimizedPlan().toString().partition("Join")[0]
    assert "Aggregate" not in top and "Distinct" not in top


def test_scope_grants_share_the_step(roles):
    holders, courses = roles
    grants = access.scope_grants(holders, courses, "program_id", 4)
    assert sorted(map(tuple, grants.collect())) == sorted((*p, 4) for p in expected_pairs())
    assert grants.rdd.getNumPartitions() == access.BLOCKS


def test_effective_permission_of_roles(spark, roles):
    """as effective_permission() over the pairs, direct ones without a role too, and no pair of a role is shuffled."""
    holders, courses = roles
    pairs = spark.createDataFrame(sorted(expected_pairs()), "user_id long, course_id long")
    direct = spark.createDataFrame([(1, 10, 3), (1, 13, 2), (9, 10, 1), (2, 12, 9), (4, 11, 2), (None, 10, 2)], "user_id long, course_id long, permission int")
    want = Counter(map(tuple, access.effective_permission(direct, pairs, "course_id").collect()))
    got = access.effective_role_permission(direct, holders, courses, ["program_id"], "course_id")
    assert Counter(map(tuple, got.collect())) == want and want[(9, 10, 1)] == 1


def test_programs_through_roles(spark, roles):
    """programs of users are found by the classes of equal scopes."""
    more = spark.createDataFrame([(10, 7), (12, 8), (13, 6)], "course_id long, program_id long")
    got = access.role_programs(*roles, ["program_id"], more)
    want = {(u, p) for u, c in expected_pairs() for d, p in [(10, 7), (12, 8), (13, 6)] if c == d}
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_recipients_without_pairs(spark, roles):
    """only holders of a scope that has a course; no pair of user and course is made."""
    users = spark.createDataFrame([(u, f"n{u}") for u in range(1, 7)], "user_id long, name string")
    got = access.role_recipients(users, *roles, ["program_id"])
    assert sorted(r.user_id for r in got.collect()) == sorted({u for u, _ in expected_pairs()})


@pytest.mark.parametrize("name", ["effective_permission", "visible_programs", "role_recipients"])
def test_roles_are_not_multiplied_out(name, spark, monkeypatch):
    """The queries know roles by holders and scopes; the table of all their pairs is not read."""
    star = registry.Star
    monkeypatch.setattr(star, "__getitem__", lambda self, n, old=star.__getitem__: pytest.fail(n) if n == "course_user_role" else old(self, n))
    assert registry.queries()[name](spark, MIDDLE).count() > 0


def test_few_users_come_again_at_once(spark, monkeypatch):
    """pairs stand a pack of users at a time, so that they take little when stored; each pair once, nulls too."""
    monkeypatch.setattr(access, "BLOCKS", 2)
    holders = spark.range(3000).selectExpr("nullif(id, 7) as user_id")
    courses = spark.range(30).selectExpr("nullif(id, 3) as course_id", "id % 2 as scope")
    for grants, n in (
        (access.role_grants(holders, courses, [], 1), 90000),
        (access.scope_grants(holders.selectExpr("user_id", "user_id % 3 as scope"), courses, "scope", 4), 29985),
    ):
        rows = [(r.user_id, r.course_id) for r in grants.collect()]
        assert len(rows) == len(set(rows)) == n
        assert all(len({u for u, _ in rows[i : i + 1024]}) <= 2 * PACK for i in range(0, len(rows), 1024))
