"""Extensions, labelled as such: windows over events, roll-ups and approximate counts."""

from pyspark.sql import functions as F

from loomwork.plans.registry import query
from loomwork.plans.star import Star
from loomwork.streaming import jobs


@query("SELECT DATE_TRUNC('hour', ts) AS start, event_type, COUNT(*) AS n FROM {events} GROUP BY 1, 2")
def events_by_hour(t: Star):
    return jobs.counts_by_window(t.events, "ts", "event_type", "1 hour").drop("value")


@query("SELECT level, course_required, COUNT(DISTINCT course_id) AS courses FROM {course_programs} cp JOIN {programs} p ON p.program_id = cp.program_id GROUP BY ROLLUP(level, course_required)")
def courses_rolled_up(t: Star):
    return t.course_programs.join(t.programs, "program_id").rollup("level", "course_required").agg(F.count_distinct("course_id").alias("courses"))


@query("SELECT l_returnflag, l_linestatus, COUNT(*) AS n, SUM(l_quantity) AS quantity FROM {lineitem} WHERE l_shipdate <= TIMESTAMP '2000-09-02' GROUP BY 1, 2")
def line_summary(t: Star):
    return t.lineitem.where("l_shipdate <= timestamp '2000-09-02'").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"))


@query("SELECT c_custkey, COUNT(DISTINCT o_orderkey) AS orders, COUNT(DISTINCT o_orderpriority) AS priorities FROM {customer} LEFT JOIN {orders} ON o_custkey = c_custkey GROUP BY 1")
def customer_counts(t: Star):
    return t.customer.join(t.orders, t.customer.c_custkey == t.orders.o_custkey, "left").groupBy("c_custkey").agg(F.count_distinct("o_orderkey").alias("orders"), F.count_distinct("o_orderpriority").alias("priorities"))
