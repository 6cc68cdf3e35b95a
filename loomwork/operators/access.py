"""Who sees which courses and programs: semi joins over grants, so that no course row is ever repeated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def grants(direct: DataFrame, roles: DataFrame, key: str) -> DataFrame:
    """Distinct (user_id, key) of direct and role access."""
    return direct.select("user_id", key).unionByName(roles.select("user_id", key)).distinct()


def visible(rows: DataFrame, direct: DataFrame, roles: DataFrame, user_id: int, key: str, administrator: bool = False) -> DataFrame:
    """Rows whose key the user has, directly or through a role; an administrator sees all."""
    if administrator:
        return rows
    mine = grants(direct.where(F.col("user_id") == user_id), roles.where(F.col("user_id") == user_id), key)
    return rows.join(mine, key, "left_semi")


def visible_programs(programs: DataFrame, course_programs: DataFrame, course_grants: DataFrame, program_grants: DataFrame) -> DataFrame:
    """user_id, program_id: programs granted, or with a course that is.

    Grants of courses through roles are many; role_programs() gives their programs as program grants.
    """
    through = course_grants.join(course_programs.select("course_id", "program_id"), "course_id").select("user_id", "program_id")
    seen = program_grants.select("user_id", "program_id").unionByName(through).distinct()
    return seen.join(programs.select("program_id"), "program_id", "left_semi")


def effective_permission(direct: DataFrame, roles: DataFrame, key: str) -> DataFrame:
    """user_id, key, permission: 1 through a role, else the direct permission."""
    elevated = roles.select("user_id", key).distinct().withColumn("elevated", F.lit(True))
    rows = direct.where("permission in (1, 2, 3)").select("user_id", key, "permission").join(elevated, ["user_id", key], "full")
    return rows.select("user_id", key, F.when(F.col("elevated"), 1).otherwise(F.col("permission")).alias("permission"))


def first_of(sources: list[DataFrame], keys: list[str]) -> DataFrame:
    """Rows of all sources, one for each key: that of the first source which has it."""
    tagged = [s.withColumn("_source", F.lit(i)) for i, s in enumerate(sources)]
    rows = tagged[0]
    for t in tagged[1:]:
        rows = rows.unionByName(t)
    order = Window.partitionBy(*keys).orderBy("_source")
    return rows.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n", "_source")


def courses_in_programs(courses: DataFrame, course_programs: DataFrame, program_ids: list[int]) -> DataFrame:
    """Courses of any of the programs, each once; no ids, no filter."""
    if not program_ids:
        return courses
    return courses.join(course_programs.where(F.col("program_id").isin(program_ids)), "course_id", "left_semi")


def unaligned_clos(clos: DataFrame, outcome_assessments: DataFrame, outcome_activities: DataFrame) -> DataFrame:
    """CLOs without an assessment or without an activity."""
    has = lambda t, name: t.select("l_outcome_id").distinct().withColumn(name, F.lit(True))
    rows = clos.join(has(outcome_assessments, "assessed"), "l_outcome_id", "left").join(has(outcome_activities, "active"), "l_outcome_id", "left")
    return rows.where("assessed is null or active is null").select(clos.columns)


def faculty_courses(courses: DataFrame, campus: str, faculty: str, codes: list[str]) -> DataFrame:
    """Courses that name the faculty, or whose code is the faculty's and whose own place is blank, the same or Other."""
    named = (F.col("campus") == campus) & (F.col("faculty") == faculty)
    blank = F.col("campus").isNull() & F.col("faculty").isNull()
    other = (F.col("campus") == "Other") & F.col("faculty").isNull() & F.col("department").isNull()
    by_code = F.col("course_code").isin(codes) & (blank | named | other) if codes else F.lit(False)
    return courses.where(F.coalesce(named | by_code, F.lit(False))).dropDuplicates(["course_id"])


#: Blocks of rows that each meet a copy of the role holders.
BLOCKS = 128
#: Most rows, or most holders, of a pack, and the holders of a class, about, that one task puts in order.
PACK, ORDERED = 256, 4096


def _classes(holders: DataFrame, on: list[str]) -> tuple[DataFrame, DataFrame]:
    """Users with the class that they are of, and the scopes of the classes: users with equal sets of scopes are one class."""
    users = holders.groupBy("user_id").agg(F.sort_array(F.collect_set(F.struct(*on))).alias("_class"))
    return users, users.select("_class").distinct().select("_class", F.inline("_class"))


def _of_classes(classes: DataFrame, rows: DataFrame, on: list[str], key: str) -> DataFrame:
    """_class, key: distinct keys of the rows that share a scope with the class."""
    return rows.select(key, *on).join(classes, on).select("_class", key).distinct()


def _packs(dealt: DataFrame, by: list[str], key: str, name: str) -> DataFrame:
    """The columns by and an array of structs of at most PACK of their keys, in order; a null is a key too."""
    number = F.row_number().over(Window.partitionBy(*by).orderBy(key))
    packs = dealt.withColumn("_pack", F.floor((number - 1) / PACK)).groupBy(*by, "_pack")
    return packs.agg(F.collect_list(F.struct(F.col(key).alias("k"))).alias(name)).drop("_pack")


def _met(rows: DataFrame, users: DataFrame, on: list[str], key: str) -> DataFrame:
    """user_id, key of each row and user that share the columns; no columns, all.

    Rows are dealt into blocks and users copied to each. The numbers of partitions are set, as AQE would join blocks of
    few bytes into one task, however many pairs come out of them.

    Packs of both meet, and pairs come out a pack of users at a time: a key stands in a run, and the same few users come
    again at once. So pairs that are stored take a fraction of what they take if all users come before any comes again.
    Keys are taken out of their structs only then: a step that Spark runs row by row, so no more than a pack is held.
    """
    by, dealt = ["_block", *on], lambda df, c, n: df.withColumn("_block", F.pmod(F.xxhash64(c), n))
    packed = _packs(dealt(rows, key, F.lit(BLOCKS)).repartition(BLOCKS, *by), by, key, "_keys")
    sizes = users.groupBy(*on).agg(F.ceil(F.count("*") / ORDERED).alias("_n"))
    sized = users.join(sizes, on) if on else users.crossJoin(sizes)
    packs = _packs(dealt(sized, "user_id", F.col("_n")), by, "user_id", "_users")
    copies = packs.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(BLOCKS - 1).cast("long"))))
    met = packed.join(copies.repartition(BLOCKS, *by).hint("merge"), by)
    each = met.select("_users", F.explode(F.transform("_keys", lambda x: x["k"])).alias(key))
    return each.select(F.inline("_users").alias("user_id"), key)


def role_pairs(holders: DataFrame, rows: DataFrame, on: list[str], key: str) -> DataFrame:
    """Distinct (user_id, key) of role holders and rows that share the scope columns; no columns, all.

    Pairs may be as many as holders times rows, so nothing is shuffled or made distinct once they have met: holders and
    keys are distinct before, users with equal scopes as one class.
    """
    if not on:
        return _met(rows.select(key).distinct(), holders.select("user_id").distinct(), [], key)
    users, classes = _classes(holders, on)
    return _met(_of_classes(classes, rows, on, key), users, ["_class"], key)


def role_grants(role_users: DataFrame, courses: DataFrame, on: list[str], role_id: int) -> DataFrame:
    """user_id, course_id, role_id: every course that shares the scope columns with a role holder; no columns, all.

    Without columns the grants are as many as holders times courses; visible(administrator=True) needs none.
    """
    return role_pairs(role_users, courses, on, "course_id").withColumn("role_id", F.lit(role_id).cast("long"))


def role_recipients(users: DataFrame, holders: DataFrame, rows: DataFrame, on: list[str]) -> DataFrame:
    """Users that a role gives any row: holders of a scope that has one. No pair is made."""
    return users.join(holders.join(rows, on, "left_semi"), "user_id", "left_semi")


def effective_role_permission(direct: DataFrame, holders: DataFrame, rows: DataFrame, on: list[str], key: str) -> DataFrame:
    """effective_permission() of roles told by holders and the rows of their scopes; direct has a pair once.

    Pairs of roles are all 1, so only direct ones look whether a role has them too, by the class of their user.
    """
    users, classes = _classes(holders, on)
    elevated = _of_classes(classes, rows, on, key)
    known = direct.where("permission in (1, 2, 3)").select("user_id", key, "permission").join(users, "user_id", "left")
    own = known.join(elevated, ["_class", key], "left_anti").select("user_id", key, "permission")
    return _met(elevated, users, ["_class"], key).withColumn("permission", F.lit(1)).unionByName(own)


def role_programs(holders: DataFrame, rows: DataFrame, on: list[str], course_programs: DataFrame) -> DataFrame:
    """user_id, program_id: programs with a course that a role gives, found once for all users with equal scopes."""
    users, classes = _classes(holders, on)
    seen = _of_classes(classes, rows, on, "course_id").join(course_programs.select("course_id", F.col("program_id").alias("_program")), "course_id")
    return users.join(seen.select("_class", "_program").distinct(), "_class").select("user_id", F.col("_program").alias("program_id"))


def level_filter(course_num: Column, levels: list[int]) -> Column:
    """Course numbers of any hundred in levels; numbers of three digits and letters only, compared as integers."""
    number = F.when(course_num.rlike("^[1-9][0-9]{2}[A-Za-z]*$"), F.substring(course_num, 1, 3).cast("int"))
    out = F.lit(not levels)
    for level in levels:
        out = out | number.between(level, level + 99)
    return F.coalesce(out, F.lit(False))


def options(column: Column) -> Column:
    """The text that an option list shows."""
    return F.upper(F.trim(column))


def scope_grants(holders: DataFrame, courses: DataFrame, scope: str, role_id: int) -> DataFrame:
    """user_id, course_id, role_id of role holders over the courses of their own scope column, such as a department.

    Holders and courses without a scope get nothing.
    """
    return role_grants(holders.where(F.col(scope).isNotNull()), courses.where(F.col(scope).isNotNull()), [scope], role_id)
