"""Registered queries run over all rows of their tables."""

from haulspark.operators import office, relational, reporting
from haulspark.plans.registry import QUERIES
from haulspark.sources.tables import table
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def ids(df, column):
    return {r[0] for r in df.select(column).distinct().collect()}


def test_every_route_is_packed_and_ordered(spark):
    lines = table(spark, SF, "lineitem")
    for name in ("packer", "route_order"):
        out = QUERIES[name](spark, SF)
        assert out.count() == lines.count() and ids(out, "route_id") == ids(lines, "l_orderkey"), name


def test_every_customer_can_drive(spark):
    """A preferred driver of the vehicle's depot who is no multiple of five is given as well."""
    vehicles = table(spark, SF, "supplier").select("s_nationkey", "s_suppkey", (F.col("s_suppkey") * 7 % 1500).alias("preferred")).collect()
    depots = {r.c_custkey: r.c_nationkey for r in table(spark, SF, "customer").collect()}
    got = {r.vehicle_id: r.driver_id for r in QUERIES["driver_assignment"](spark, SF).collect()}
    want, taken = {}, set()
    for v in sorted(vehicles, key=lambda v: v.s_suppkey):
        free = sorted(d for d, n in depots.items() if n == v.s_nationkey and d not in taken)
        if v.s_nationkey in depots.values():
            want[v.s_suppkey] = v.preferred if v.preferred in free else free[0] if free else None
            taken.add(want[v.s_suppkey])
    assert {v: d for v, d in got.items() if v in want} == want and any(d is not None and d % 5 for d in got.values())


def test_every_note_is_read(spark):
    lines = table(spark, SF, "lineitem")
    out = QUERIES["field_extract"](spark, SF)
    assert out.count() == lines.count() and ids(out, "tpo_id") == ids(lines, "l_orderkey")


def test_list_queries_keep_every_row(spark):
    keys = {"null_order_sort": ("orders", "o_orderkey", "o_orderkey"), "lateral_latest": ("customer", "c_custkey", "c_custkey"), "scalar_count_subquery": ("orders", "o_orderkey", "o_orderkey"), "next_number": ("orders", "o_orderkey", "o_orderkey"), "fuzzy_best_margin": ("customer", "c_custkey", "id")}
    for name, (source, key, column) in keys.items():
        out, all_rows = QUERIES[name](spark, SF), table(spark, SF, source)
        assert out.count() == all_rows.count() and ids(out, column) == ids(all_rows, key), name


def test_numbers_run_over_all_ranges(spark):
    rows = spark.range(20000).select("id", F.when(F.col("id") % 3 != 0, F.col("id") * 7919 % 1000).alias("v")).repartition(7)
    order = lambda r: (r.v is None, r.v or 0, r.id)
    got = sorted(relational.numbered(rows, [F.col("v").asc_nulls_last(), F.col("id")], "n").collect(), key=lambda r: r.n)
    assert [r.n for r in got] == list(range(1, 20001)) and got == sorted(got, key=order)
    assert relational.numbered(rows.limit(0), ["id"], "n").count() == 0


def test_desk_and_office_queries_keep_every_row(spark):
    customers, orders = table(spark, SF, "customer"), table(spark, SF, "orders")
    events = table(spark, SF, "events").where("event_id % 7 <> 0")
    for name, rows, key, column in (("json_merge", customers, "c_custkey", "id"), ("invoice_xml", orders.select("o_custkey").distinct(), "o_custkey", "invoice_id"), ("inbox", events, "event_id", "key")):
        out = QUERIES[name](spark, SF)
        assert out.count() == rows.count() and ids(out, column) == ids(rows, key), name
    firsts = QUERIES["inbox"](spark, SF).where("pos = 1")
    assert firsts.count() == events.select("user_id").distinct().count()


def test_no_numbering_moves_all_rows_into_one_task(spark):
    rows = spark.range(2000).select("id", F.concat(F.lit("k"), F.col("id") % 9).alias("key"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 50).cast("int")).alias("day"))
    notes = rows.select(F.col("id").alias("key"), F.col("day").alias("created_at"))
    state = notes.select("key", F.when(F.col("key") % 3 == 0, F.col("created_at")).alias("read_at"), F.lit(None).cast("date").alias("deleted_at"))
    for out in (office.merge_order(rows, "key", "day", "id"), office.inbox(notes, state), reporting.project(rows, [{"key": "name", "source": "key", "default": None}], [F.col("id")])):
        text = out._jdf.queryExecution().executedPlan().toString()
        facts = [part for part in text.split("Window [row_number()")[1:]]
        assert facts and all("SinglePartition" not in part.split("BroadcastExchange")[0] for part in facts)
        number = "pos" if "pos" in out.columns else "row_no"
        assert sorted(r[0] for r in out.select(number).collect()) == list(range(1, 2001))
