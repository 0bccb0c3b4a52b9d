"""Scans, filters, joins, aggregates, ranks, sorts, set operations and recursion over the business tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terraql import dialect, statements
from terraql.functions import bitmaps, scalars
from terraql.operators import dml, history, ranking, recursion, relational
from terraql.operators.access import Table, page
from terraql.plans.registry import Tables, query
from terraql.sources.tables import extent, of_type

D1998 = datetime(1998, 9, 2)


@query("""SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base,
round(sum(l_extendedprice * (1 - l_discount)), 4) AS sum_disc, round(avg(l_quantity), 6) AS avg_qty, count(*) AS count_order
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus""")
def pricing_summary(t: Tables) -> DataFrame:
    rows = t.lineitem.where(F.col("l_shipdate") <= F.lit(D1998).cast("timestamp_ntz"))
    out = rows.groupBy("l_returnflag", "l_linestatus").agg(
        F.sum("l_quantity").alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_base"),
        F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 4).alias("sum_disc"),
        F.round(F.avg("l_quantity"), 6).alias("avg_qty"), F.count(F.lit(1)).alias("count_order"))
    return relational.ordered(out, ("l_returnflag", "asc"), ("l_linestatus", "asc"))


# --- scans and direct access


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey BETWEEN 100 AND 900")
def scan_key_range(t: Tables) -> DataFrame:
    return Table(t.orders, ("o_orderkey",)).scan({"o_orderkey": 100}, {"o_orderkey": 900}).select("o_orderkey", "o_custkey", "o_totalprice")


@query("SELECT 'customer' AS _record_type, c_custkey AS id, c_acctbal AS balance FROM customer WHERE c_acctbal < 0 UNION ALL SELECT 'supplier', s_suppkey, s_acctbal FROM supplier WHERE s_acctbal < 0")
def scan_record_types(t: Tables) -> DataFrame:
    both = extent({"customer": t.customer.select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance")), "supplier": t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance")), "part": t.part.select(F.col("p_partkey").alias("id"))})
    return of_type(both, "customer", "supplier").where("balance < 0").select("_record_type", "id", "balance")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment = 'BUILDING'")
def scan_covering(t: Tables) -> DataFrame:
    return t.customer.where(F.col("c_mktsegment") == "BUILDING").select("c_custkey", "c_mktsegment")


@query("SELECT * FROM orders WHERE o_orderkey IN (1, 2, 3, 7, 500)")
def load_by_keys(t: Tables) -> DataFrame:
    return Table(t.orders, ("o_orderkey",)).load([(k,) for k in (1, 2, 3, 7, 500)])


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey = 7 AND l_linenumber = 1")
def get_by_key(t: Tables) -> DataFrame:
    return Table(t.lineitem, ("l_orderkey", "l_linenumber")).get(7, 1).select("l_orderkey", "l_linenumber", "l_partkey")


@query("SELECT count(*) AS n FROM lineitem WHERE NOT (l_orderkey = 7)")
def delete_key_prefix(t: Tables) -> DataFrame:
    return Table(t.lineitem, ("l_orderkey", "l_linenumber")).delete_range(7).rows.agg(F.count(F.lit(1)).alias("n"))


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey > 40 OR (l_orderkey = 40 AND l_linenumber > 1) ORDER BY l_orderkey, l_linenumber LIMIT 25")
def page_after_token(t: Tables) -> DataFrame:
    return page(t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity"), ("l_orderkey", "l_linenumber"), 25, (40, 1))


@query("SELECT unnest(range(5, 50, 5)) AS \"ID\"")
def table_range(t: Tables) -> DataFrame:
    return relational.number_range(t.spark, 5, 50, 5)


@query("SELECT B, C, W_X, W_Y FROM (VALUES (1, 'a', 10, 2.5::DOUBLE), (2, NULL, 20, 3.5::DOUBLE)) AS A(B, C, W_X, W_Y)")
def table_values(t: Tables) -> DataFrame:
    rows = t.spark.createDataFrame([(1, "a", (10, 2.5)), (2, None, (20, 3.5))], "B int, C string, W struct<X:int,Y:double>")
    return rows.select("B", "C", F.col("W.X").alias("W_X"), F.col("W.Y").alias("W_Y"))


@query("SELECT 1 + 1 AS two, 'x' AS x")
def select_without_from(t: Tables) -> DataFrame:
    return t.spark.sql("SELECT 1 + 1 AS two, 'x' AS x")


def _lines(t: Tables) -> DataFrame:
    """Orders with an array of their lines, by line number."""
    line = F.struct("l_linenumber", "l_partkey", "l_quantity")
    return t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("lines"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity) AS place FROM lineitem")
def unnest_at(t: Tables) -> DataFrame:
    return relational.unnest(_lines(t), "lines", "line", ordinality="place").select("l_orderkey", "line.l_linenumber", "line.l_partkey", "place")


@query("SELECT l_orderkey, l_partkey FROM lineitem WHERE l_quantity > 45")
def unnest_filtered(t: Tables) -> DataFrame:
    return relational.unnest(_lines(t), "lines", "line").where("line.l_quantity > 45").select("l_orderkey", "line.l_partkey")


@query("SELECT * FROM (VALUES (1, 10, 'a'), (1, 20, 'b'), (1, NULL, 'c'), (2, 5, NULL)) AS x(k, n, s)")
def unnest_side_by_side(t: Tables) -> DataFrame:
    rows = t.spark.createDataFrame([(1, [10, 20], ["a", "b", "c"]), (2, [5], []), (3, [], []), (4, None, None)], "k int, ns array<int>, ss array<string>")
    return relational.unnest_together(rows, ["ns", "ss"], ["n", "s"]).select("k", "n", "s")


@query("SELECT o_orderkey, c_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 300000")
def synthetic_joined_type(t: Tables) -> DataFrame:
    both = relational.synthetic_join([("o", t.orders), ("c", t.customer)], [("o.o_custkey", "c.c_custkey")])
    return both.where("o.o_totalprice > 300000").select("o.o_orderkey", "c.c_name", "o.o_totalprice")


@query("SELECT l_orderkey, max(l_quantity) AS most FROM lineitem GROUP BY l_orderkey HAVING max(l_quantity) > 49")
def synthetic_unnested_type(t: Tables) -> DataFrame:
    rows = relational.unnest(_lines(t), "lines", "line")
    return rows.groupBy("l_orderkey").agg(F.max("line.l_quantity").alias("most")).where("most > 49")


# --- predicates


@query("""SELECT a, b, a AND b AS both, a OR b AS either, NOT a AS negated, a <> b AS differ, a IS TRUE AS sure, a IS NOT FALSE AS unsure, a IS NULL AS missing
FROM (VALUES (true), (false), (NULL)) AS x(a), (VALUES (true), (false), (NULL)) AS y(b)""")
def three_valued_logic(t: Tables) -> DataFrame:
    flags = [(True,), (False,), (None,)]
    both = t.spark.createDataFrame(flags, "a boolean").crossJoin(t.spark.createDataFrame(flags, "b boolean"))  # nine rows
    a, b = F.col("a"), F.col("b")
    return both.select("a", "b", (a & b).alias("both"), (a | b).alias("either"), (~a).alias("negated"), scalars.xor(a, b).alias("differ"), scalars.is_true(a).alias("sure"), (~scalars.is_false(a)).alias("unsure"), a.isNull().alias("missing"))


@query("""SELECT p_partkey FROM part WHERE p_size BETWEEN 10 AND 20 AND p_brand IN ('Brand#2', 'Brand#17', 'Brand#4', 'Brand#12') AND NOT (p_retailprice < 950) AND p_name LIKE '%a%'""")
def filter_predicates(t: Tables) -> DataFrame:
    return t.part.where(F.col("p_size").between(10, 20) & scalars.in_list(F.col("p_brand"), ["Brand#2", "Brand#17", "Brand#4", "Brand#12"]) & ~(F.col("p_retailprice") < 950) & scalars.like(F.col("p_name"), "%a%")).select("p_partkey")


@query("SELECT count(*) AS n FROM part WHERE p_size BETWEEN 20 AND 10")
def between_empty(t: Tables) -> DataFrame:
    return t.part.where(F.col("p_size").between(20, 10)).agg(F.count(F.lit(1)).alias("n"))


@query(r"""SELECT s, s LIKE 'a%' AS starts, s LIKE '_b%' AS second, s LIKE 'a\b' AS backslash, s LIKE '%!%%' ESCAPE '!' AS percent
FROM (VALUES ('abc'), ('a%c'), ('a\b'), (''), (NULL), ('xb'), ('a' || chr(10) || 'b')) AS v(s)""")
def like_patterns(t: Tables) -> DataFrame:
    s = F.col("s")
    rows = t.spark.createDataFrame([("abc",), ("a%c",), ("a\\b",), ("",), (None,), ("xb",), ("a\nb",)], "s string")
    return rows.select("s", scalars.like(s, "a%").alias("starts"), scalars.like(s, "_b%").alias("second"), scalars.like(s, "a\\b").alias("backslash"), scalars.like(s, "%!%%", "!").alias("percent"))


@query("SELECT a, b, a IS DISTINCT FROM b AS differ, a IS NOT DISTINCT FROM b AS same FROM (VALUES (1, 1), (1, 2), (1, NULL), (NULL, NULL)) AS v(a, b)")
def distinct_from(t: Tables) -> DataFrame:
    rows = t.spark.createDataFrame([(1, 1), (1, 2), (1, None), (None, None)], "a int, b int")
    return rows.select("a", "b", scalars.distinct_from(F.col("a"), F.col("b")).alias("differ"), F.col("a").eqNullSafe(F.col("b")).alias("same"))


@query("SELECT DISTINCT l_orderkey FROM lineitem WHERE l_quantity > 48")
def any_element_matches(t: Tables) -> DataFrame:
    return _lines(t).where(F.exists("lines", lambda x: x["l_quantity"] > 48)).select("l_orderkey")


@query("SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING min(l_quantity) > 20")
def all_elements_match(t: Tables) -> DataFrame:
    return _lines(t).where(F.forall("lines", lambda x: x["l_quantity"] > 20)).select("l_orderkey")


@query("SELECT k, CASE WHEN a IS NULL THEN NULL ELSE len(a) = 0 END AS empty, len(a) AS n FROM (VALUES (1, [1, 2]), (2, []::INT[]), (3, NULL)) AS v(k, a)")
def empty_arrays(t: Tables) -> DataFrame:
    rows = t.spark.createDataFrame([(1, [1, 2]), (2, []), (3, None)], "k int, a array<int>")
    n = scalars.cardinality(F.col("a"))
    return rows.select("k", (n == 0).alias("empty"), n.cast("bigint").alias("n"))


@query("SELECT p_partkey, p_name FROM part WHERE starts_with(p_name, 'a') OR starts_with(p_type, 'SMALL')")
def starts_with(t: Tables) -> DataFrame:
    return t.part.where(F.col("p_name").startswith("a") | F.col("p_type").startswith("SMALL")).select("p_partkey", "p_name")


@query("SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS has_orders FROM customer")
def exists_in_select(t: Tables) -> DataFrame:
    buyers = t.orders.select("o_custkey").distinct()
    return t.customer.join(buyers, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.col("o_custkey").isNotNull().alias("has_orders"))


@query("SELECT vec_id, label FROM (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id DESC) AS n FROM embeddings) WHERE n <= 2")
def qualify(t: Tables) -> DataFrame:
    text = "SELECT vec_id, label FROM rows_of QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id DESC) <= 2"
    return dialect.sql(t.spark, text, rows_of=t.embeddings.select("vec_id", "label"))


# --- joins and subqueries


@query("""SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE r_name IN ('ASIA', 'EUROPE') GROUP BY n_name""")
def join_many(t: Tables) -> DataFrame:
    nations = t.nation.join(t.region.where(F.col("r_name").isin("ASIA", "EUROPE")), F.col("n_regionkey") == F.col("r_regionkey"))
    buyers = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    sold = t.lineitem.join(buyers, F.col("l_orderkey") == F.col("o_orderkey"))
    sold = sold.join(t.supplier, (F.col("l_suppkey") == F.col("s_suppkey")) & (F.col("c_nationkey") == F.col("s_nationkey")))
    revenue = F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")))
    return sold.join(nations, F.col("s_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.round(revenue, 4).alias("revenue"))


@query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 250000")
def join_left(t: Tables) -> DataFrame:
    big = t.orders.where("o_totalprice > 250000")
    return t.customer.join(big, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "o_orderkey")


@query("SELECT o_orderkey, c_custkey FROM orders RIGHT JOIN customer ON o_custkey = c_custkey AND o_orderstatus = 'P'")
def join_right(t: Tables) -> DataFrame:
    return t.orders.where("o_orderstatus = 'P'").join(t.customer, F.col("c_custkey") == F.col("o_custkey"), "right").select("o_orderkey", "c_custkey")


@query("SELECT k, a.n_name AS n_name, b.s_name AS s_name FROM (SELECT n_nationkey AS k, n_name FROM nation) a JOIN (SELECT s_nationkey AS k, s_name FROM supplier) b USING (k)")
def join_using(t: Tables) -> DataFrame:
    return t.nation.withColumnRenamed("n_nationkey", "k").join(t.supplier.withColumnRenamed("s_nationkey", "k"), ["k"]).select("k", "n_name", "s_name")


@query("SELECT r_name, n_name FROM region, nation WHERE n_regionkey <> r_regionkey")
def join_comma(t: Tables) -> DataFrame:
    # 5 regions and 25 nations: fixed tables
    return t.nation.join(F.broadcast(t.region), F.col("n_regionkey") != F.col("r_regionkey")).select("r_name", "n_name")


@query("SELECT n_name, r_name FROM nation FULL OUTER JOIN region ON n_regionkey = r_regionkey AND r_name <> 'ASIA'")
def join_full(t: Tables) -> DataFrame:
    return t.nation.join(t.region, (F.col("n_regionkey") == F.col("r_regionkey")) & (F.col("r_name") != "ASIA"), "full").select("n_name", "r_name")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
def join_semi(t: Tables) -> DataFrame:
    return t.customer.join(t.orders.where("o_totalprice > 200000"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def join_anti(t: Tables) -> DataFrame:
    return t.customer.join(t.orders.where("o_totalprice > 400000"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


@query("SELECT o_orderkey, most FROM orders, LATERAL (SELECT max(l_quantity) AS most FROM lineitem WHERE l_orderkey = o_orderkey) AS x")
def join_lateral(t: Tables) -> DataFrame:
    return dialect.sql(t.spark, "SELECT o_orderkey, most FROM orders, LATERAL (SELECT max(l_quantity) AS most FROM lineitem WHERE l_orderkey = o_orderkey) AS x", orders=t.orders, lineitem=t.lineitem)


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (7, 11, 19, 23) ORDER BY o_custkey, o_orderkey")
def join_in_list(t: Tables) -> DataFrame:
    return t.orders.where(scalars.in_list(F.col("o_custkey"), [7, 11, 19, 23])).select("o_orderkey", "o_custkey").orderBy("o_custkey", "o_orderkey")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (7, 11, 19, 23, 29)")
def in_list_parameter(t: Tables) -> DataFrame:
    t.orders.createOrReplaceTempView("orders")
    return dialect.sql(t.spark, "SELECT o_orderkey, o_custkey FROM orders WHERE array_contains(:keys, o_custkey)", args={"keys": F.array(*[F.lit(k) for k in (7, 11, 19, 23, 29)])})


@query("SELECT c_custkey, coalesce((SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 1), -1) AS o_orderkey FROM customer")
def join_first_or_default(t: Tables) -> DataFrame:
    inner = t.orders.withColumnRenamed("o_custkey", "c_custkey")
    return relational.first_or_default(t.customer.select("c_custkey"), inner, ["c_custkey"], [-F.col("o_totalprice"), F.col("o_orderkey")], "o_orderkey", -1)


@query("SELECT o_orderpriority, count(*) AS n, round(sum(l_extendedprice), 2) AS price FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_orderpriority")
def join_salted(t: Tables) -> DataFrame:
    lines = t.lineitem.select(F.col("l_orderkey").alias("k"), "l_extendedprice", "l_linenumber")
    both = relational.salted_join(lines, t.orders.select(F.col("o_orderkey").alias("k"), "o_orderpriority"), ["k"])
    return both.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("price"))


# --- aggregates


@query("SELECT count(*) AS n, count(v) AS n_v, sum(v) AS total, avg(v) AS mean, min(v) AS low, max(v) AS high FROM (SELECT value AS v FROM events WHERE event_id < 0)")
def aggregate_empty(t: Tables) -> DataFrame:
    v = F.col("value")
    return t.events.where("event_id < 0").agg(F.count(F.lit(1)).alias("n"), F.count(v).alias("n_v"), F.sum(v).alias("total"), F.avg(v).alias("mean"), F.min(v).alias("low"), F.max(v).alias("high"))


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, min(value) AS low, max(value) AS high FROM events GROUP BY event_type HAVING count(*) > 10")
def group_having(t: Tables) -> DataFrame:
    out = t.events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"), F.min("value").alias("low"), F.max("value").alias("high"))
    return out.where("n > 10")


@query("SELECT o_orderstatus AS status, o_orderpriority AS urgency, count(*) AS n FROM orders GROUP BY o_orderstatus, o_orderpriority")
def group_nested(t: Tables) -> DataFrame:
    rows = t.orders.select(F.struct(F.struct(F.col("o_orderstatus").alias("s")).alias("st"), F.col("o_orderpriority").alias("p")).alias("q"))
    return rows.groupBy(F.col("q.st.s").alias("status"), F.col("q.p").alias("urgency")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_custkey % 10 AS bucket, sum(CAST(o_orderkey AS BIGINT))::BIGINT AS total, sum(CAST(o_orderkey AS BIGINT))::BIGINT // count(*) AS whole_mean FROM orders GROUP BY o_custkey % 10")
def group_expression(t: Tables) -> DataFrame:
    out = t.orders.groupBy((F.col("o_custkey") % 10).alias("bucket")).agg(F.sum("o_orderkey").alias("total"), F.count(F.lit(1)).alias("_n"))
    return out.select("bucket", "total", scalars.divide("total", "_n", "bigint", "bigint").alias("whole_mean"))


@query("SELECT l_partkey // 10000 * 10000 AS bucket_offset, l_returnflag, count(DISTINCT l_partkey % 10000) AS bits, min(l_partkey % 10000)::INT AS lowest FROM lineitem GROUP BY ALL")
def bitmap_aggregate(t: Tables) -> DataFrame:
    made = bitmaps.construct(t.lineitem, "l_partkey", "l_returnflag")
    each = bitmaps.positions(made)
    return each.groupBy("bucket_offset", "l_returnflag").agg(F.count(F.lit(1)).alias("bits"), F.min(F.col("value") - F.col("bucket_offset")).cast("int").alias("lowest"))


@query("""SELECT p AS value FROM (SELECT DISTINCT l_partkey AS p FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT DISTINCT l_partkey FROM lineitem WHERE l_linestatus = 'F')
EXCEPT SELECT DISTINCT l_partkey FROM lineitem WHERE l_quantity > 40""")
def bitmap_composed(t: Tables) -> DataFrame:
    flags = {"r": F.col("l_returnflag") == "R", "f": F.col("l_linestatus") == "F", "q": F.col("l_quantity") > 40}
    made = [bitmaps.construct(t.lineitem.where(c), "l_partkey", name=n) for n, c in flags.items()]
    both = made[0].join(made[1], "bucket_offset", "left").join(made[2], "bucket_offset", "left")
    joined = bitmaps.combine("andnot")(bitmaps.combine("and")("r", "f"), F.col("q"))
    return bitmaps.positions(both.select("bucket_offset", joined.alias("bitmap"))).select("value")


@query("SELECT l_orderkey, array_to_string(list_sort(list(l_linenumber)), ',') AS numbers FROM lineitem GROUP BY l_orderkey")
def array_aggregate(t: Tables) -> DataFrame:
    numbers = F.array_join(F.array_sort(F.collect_list("l_linenumber")).cast("array<string>"), ",")
    return t.lineitem.groupBy("l_orderkey").agg(numbers.alias("numbers"))


@query("SELECT user_id, min(value) AS min_ever, max(value) AS max_ever, count(*) AS count_updates FROM events GROUP BY user_id")
def extrema_ever(t: Tables) -> DataFrame:
    return history.ever(t.events, ["user_id"], "value")


@query("SELECT c_mktsegment, max(c_acctbal) AS extremum FROM customer GROUP BY c_mktsegment ORDER BY extremum DESC")
def groups_by_extremum(t: Tables) -> DataFrame:
    return ranking.permuted(t.customer, ["c_mktsegment"], "c_acctbal")


@query("SELECT o_orderpriority, count(*) AS n, sum(octet_length(encode(o_orderstatus || o_orderpriority)))::BIGINT AS total, round(avg(octet_length(encode(o_orderstatus || o_orderpriority))), 6) AS mean, quantile_cont(octet_length(encode(o_orderstatus || o_orderpriority)), 0.5)::DOUBLE AS p50 FROM orders GROUP BY o_orderpriority")
def key_sizes(t: Tables) -> DataFrame:
    out = history.key_sizes(t.orders, ["o_orderpriority"], F.octet_length(F.concat("o_orderstatus", "o_orderpriority")))
    return out.select("o_orderpriority", "n", "total", F.round("mean", 6).alias("mean"), "p50")


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n, grouping(o_orderstatus) AS g FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def cube(t: Tables) -> DataFrame:
    return t.orders.cube("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.grouping("o_orderstatus").cast("bigint").alias("g"))


@query("SELECT o_custkey, sum(o_totalprice) > 1000000 AS large, count(*) AS n, max(o_orderkey) AS last FROM orders GROUP BY o_custkey")
def aggregates_merged(t: Tables) -> DataFrame:
    stored = t.orders.groupBy("o_custkey", "o_orderstatus", "o_orderpriority").agg(F.sum("o_totalprice").alias("total"), F.count(F.lit(1)).alias("n"), F.max("o_orderkey").alias("last"))
    return stored.groupBy("o_custkey").agg((F.sum("total") > 1000000).alias("large"), F.sum("n").alias("n"), F.max("last").alias("last"))


# --- ranks


@query("SELECT event_id, event_type, dense_rank() OVER (PARTITION BY event_type ORDER BY value) - 1 AS rank FROM events WHERE value IS NOT NULL")
def rank_in_group(t: Tables) -> DataFrame:
    return ranking.ranked(t.events, "value", ["event_type"]).select("event_id", "event_type", "rank")


@query("SELECT event_id, rank() OVER (ORDER BY value DESC) - 1 AS rank FROM events WHERE value IS NOT NULL")
def rank_of_all(t: Tables) -> DataFrame:
    return ranking.ranked(t.events, "value", high_first=True, count_duplicates=True).select("event_id", "rank")


@query("SELECT event_type, value FROM (SELECT DISTINCT event_type, value, dense_rank() OVER (PARTITION BY event_type ORDER BY value DESC) - 1 AS r FROM events) WHERE r = 5")
def score_for_rank(t: Tables) -> DataFrame:
    return ranking.score_for_rank(t.events, "value", 5, ["event_type"], high_first=True).select("event_type", "value")


@query("SELECT count(DISTINCT value) AS rank FROM events WHERE value < 50")
def rank_for_score(t: Tables) -> DataFrame:
    return ranking.rank_for_score(t.events, "value", 50)


@query("SELECT event_id FROM (SELECT event_id, dense_rank() OVER (PARTITION BY user_id ORDER BY value) - 1 AS r FROM events) WHERE r BETWEEN 2 AND 4")
def scan_by_rank(t: Tables) -> DataFrame:
    return ranking.between_ranks(t.events, "value", 2, 4, ["user_id"]).select("event_id")


@query("SELECT window_start, user_id, value, dense_rank() OVER (PARTITION BY window_start ORDER BY value DESC) - 1 AS rank FROM (SELECT time_bucket(INTERVAL '1 day', ts) AS window_start, user_id, max(value) AS value FROM events GROUP BY ALL)")
def leaderboard_by_day(t: Tables) -> DataFrame:
    return ranking.leaderboard(t.events, "ts", "value", 86_400, entity="user_id").select("window_start", "user_id", "value", "rank")


@query("SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS n FROM events) WHERE n <= 3")
def best_of_each_group(t: Tables) -> DataFrame:
    return ranking.qualify_top(t.events, [F.col("value").desc(), F.col("event_id")], 3, ["user_id"]).select("user_id", "event_id", "value")


@query("SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders")
def row_numbers(t: Tables) -> DataFrame:
    order = Window.partitionBy("o_custkey").orderBy(F.col("o_totalprice").desc(), "o_orderkey")
    return t.orders.select("o_custkey", "o_orderkey", F.row_number().over(order).cast("bigint").alias("n"))


# --- sorting and sets


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_custkey END AS k FROM orders ORDER BY k ASC NULLS FIRST, o_orderkey DESC LIMIT 40")
def sort_nulls_first(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderkey", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_custkey")).alias("k"))
    return relational.ordered(rows, ("k", "asc"), ("o_orderkey", "desc")).limit(40)


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_custkey END AS k FROM orders ORDER BY k DESC NULLS FIRST, o_orderkey LIMIT 10 OFFSET 15")
def sort_offset(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderkey", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_custkey")).alias("k"))
    return relational.ordered(rows, ("k", "desc_nulls_first"), ("o_orderkey", "asc")).offset(15).limit(10)


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def top_k_rows(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", "o_totalprice").orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(20)


@query("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def distinct_values(t: Tables) -> DataFrame:
    return t.lineitem.select("l_returnflag", "l_linestatus").distinct()


@query("SELECT DISTINCT o_custkey FROM orders")
def distinct_keys(t: Tables) -> DataFrame:
    return t.orders.dropDuplicates(["o_custkey"]).select("o_custkey")


@query("SELECT event_id, event_type FROM (SELECT event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) WHERE p IS DISTINCT FROM event_type")
def drop_adjacent(t: Tables) -> DataFrame:
    return relational.drop_adjacent(t.events, ["ts", "event_id"], ["event_type"], ["user_id"]).select("event_id", "event_type")


@query("SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
def union_all(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_nationkey").alias("k")).union(t.supplier.select("s_nationkey"))


@query("SELECT o_orderkey FROM orders WHERE o_totalprice > 250000 OR o_custkey < 20")
def union_of_conditions(t: Tables) -> DataFrame:
    a, b = t.orders.where("o_totalprice > 250000"), t.orders.where("o_custkey < 20")
    return a.select("o_orderkey").union(b.select("o_orderkey")).distinct()


@query("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def intersection(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_nationkey").alias("k")).intersect(t.supplier.select("s_nationkey"))


@query("SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier")
def difference_all(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_nationkey").alias("k")).exceptAll(t.supplier.select("s_nationkey"))


@query("SELECT r_regionkey AS k FROM region WHERE r_regionkey > 100 UNION ALL SELECT n_nationkey FROM nation WHERE NOT EXISTS (SELECT 1 FROM region WHERE r_regionkey > 100)")
def or_else(t: Tables) -> DataFrame:
    return relational.or_else(t.region.where("r_regionkey > 100").select(F.col("r_regionkey").alias("k")), t.nation.select(F.col("n_nationkey").alias("k")))


@query("SELECT event_id FROM (SELECT event_id, max(CASE WHEN value > 90 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM events) WHERE s = 0")
def map_while(t: Tables) -> DataFrame:
    return relational.map_while(t.events, ["ts", "event_id"], ~(F.col("value") > 90), ["user_id"]).select("event_id")


# --- CTEs, recursion and views


@query("WITH a AS (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1), b(k, n) AS (SELECT k, n FROM a WHERE n > 3) SELECT k, n FROM b")
def cte_nested(t: Tables) -> DataFrame:
    return dialect.sql(t.spark, "WITH a AS (WITH inner_(k) AS (SELECT c_nationkey FROM customer) SELECT k, count(*) AS n FROM inner_ GROUP BY k), b(k, n) AS (SELECT k, n FROM a WHERE n > 3) SELECT k, n FROM b", customer=t.customer)


def _edges(t: Tables) -> DataFrame:
    """A binary tree over part keys."""
    return t.part.where("p_partkey > 1").select(F.expr("p_partkey div 2").alias("parent"), F.col("p_partkey").alias("child"))


TREE = """WITH RECURSIVE edges AS (SELECT p_partkey // 2 AS parent, p_partkey AS child FROM part WHERE p_partkey > 1),
walk AS (SELECT 1::BIGINT AS node, 0 AS level, [1::BIGINT] AS path UNION ALL SELECT child, level + 1, list_append(path, child) FROM walk JOIN edges ON parent = node) """


@query(TREE + "SELECT node, level FROM walk")
def recursion_by_level(t: Tables) -> DataFrame:
    return recursion.level_order(recursion.descend(_edges(t), t.spark.sql("SELECT 1L AS node"), "parent", "child")).select("node", "level")


@query(TREE + "SELECT node, level FROM walk ORDER BY path")
def recursion_preorder(t: Tables) -> DataFrame:
    return recursion.preorder(recursion.descend(_edges(t), t.spark.sql("SELECT 1L AS node"), "parent", "child")).select("node", "level")


@query(TREE + "SELECT node, level FROM walk ORDER BY list_append(path, 9223372036854775807)")
def recursion_postorder(t: Tables) -> DataFrame:
    return recursion.postorder(recursion.descend(_edges(t), t.spark.sql("SELECT 1L AS node"), "parent", "child")).select("node", "level")


WIDE = """WITH RECURSIVE edges AS (SELECT (p_partkey + 1) // 3 AS parent, p_partkey AS child FROM part WHERE p_partkey > 1),
walk AS (SELECT 1::BIGINT AS node, 0 AS level, [1::BIGINT] AS path UNION ALL SELECT child, level + 1, list_append(path, child) FROM walk JOIN edges ON parent = node) """


def _wide(t: Tables) -> DataFrame:
    """All parts, three below each."""
    edges = t.part.where("p_partkey > 1").select(F.expr("(p_partkey + 1) div 3").alias("parent"), F.col("p_partkey").alias("child"))
    return recursion.descend(edges, t.spark.sql("SELECT 1L AS node"), "parent", "child")


@query(WIDE + "SELECT node, level FROM walk")
def recursion_wide_by_level(t: Tables) -> DataFrame:
    return recursion.level_order(_wide(t)).select("node", "level")


@query(WIDE + "SELECT node, level FROM walk ORDER BY path")
def recursion_wide_preorder(t: Tables) -> DataFrame:
    return recursion.preorder(_wide(t)).select("node", "level")


@query("WITH RECURSIVE up AS (SELECT 173::BIGINT AS node UNION ALL SELECT node // 2 FROM up WHERE node > 1) SELECT node FROM up")
def recursion_ancestors(t: Tables) -> DataFrame:
    return dialect.sql(t.spark, "WITH RECURSIVE up(node) AS (SELECT 173L UNION ALL SELECT node div 2 FROM up WHERE node > 1) SELECT node FROM up")


@query("SELECT c_mktsegment, count(*) AS n FROM (SELECT * FROM customer WHERE c_acctbal > 0) GROUP BY c_mktsegment")
def view(t: Tables) -> DataFrame:
    t.customer.createOrReplaceTempView("customer")
    t.spark.sql("CREATE OR REPLACE TEMPORARY VIEW solvent AS SELECT * FROM customer WHERE c_acctbal > 0")
    return t.spark.sql("SELECT c_mktsegment, count(*) AS n FROM solvent GROUP BY c_mktsegment")


# --- changes


@query("SELECT count(*) AS n, sum(p_size)::BIGINT AS sizes FROM (SELECT p_size FROM part UNION ALL SELECT 7)")
def insert_rows(t: Tables) -> DataFrame:
    new = t.spark.createDataFrame([(10**12, 7)], "p_partkey bigint, p_size int")
    rows, _ = dml.insert(t.part, new, ["p_partkey"])
    return rows.agg(F.count(F.lit(1)).alias("n"), F.sum("p_size").alias("sizes"))


@query("SELECT c_custkey, c_acctbal + 10 AS new, c_acctbal AS old FROM customer WHERE c_acctbal < 100")
def update_returning(t: Tables) -> DataFrame:
    _, changed = dml.update(t.customer, {"c_acctbal": F.col("c_acctbal") + 10}, F.col("c_acctbal") < 100)
    return changed.select("c_custkey", F.col("c_acctbal").alias("new"), F.col("old.c_acctbal").alias("old"))


@query("SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'B' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def update_rows(t: Tables) -> DataFrame:
    rows, _ = dml.Update(t.customer).set("c_mktsegment", "B").where(F.col("c_mktsegment") == "BUILDING").run()
    return rows.select("c_custkey", "c_mktsegment")


@query("SELECT o_orderkey FROM orders WHERE o_totalprice >= 100000")
def delete_rows(t: Tables) -> DataFrame:
    rows, _ = dml.delete(t.orders, F.col("o_totalprice") < 100000)
    return rows.select("o_orderkey")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'P'")
def delete_returning(t: Tables) -> DataFrame:
    _, gone = dml.delete(t.orders, F.col("o_orderstatus") == "P")
    return gone.select("o_orderkey", "o_orderstatus")


@query("SELECT n_nationkey, upper(n_name) AS n_name FROM nation WHERE n_regionkey = 2")
def update_statement(t: Tables) -> DataFrame:
    made = statements.Database(t.spark, {"nation": t.nation}, {"nation": ("n_nationkey",)})
    return made.execute("UPDATE nation SET n_name = upper(n_name) WHERE n_regionkey = 2 RETURNING n_nationkey, n_name")


@query("SELECT * FROM (SELECT n_nationkey, n_regionkey FROM nation WHERE n_regionkey <> 1 UNION ALL SELECT 100, 3)")
def statements_in_turn(t: Tables) -> DataFrame:
    made = statements.Database(t.spark, {"nation": t.nation}, {"nation": ("n_nationkey",)})
    made.execute("DELETE FROM nation WHERE n_regionkey = 1")
    made.execute("INSERT INTO nation (n_nationkey, n_regionkey) VALUES (100, 3)")
    made.execute("DELETE FROM nation OPTIONS (DRY RUN)")
    return made.execute("SELECT n_nationkey, n_regionkey FROM nation")


@query("SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n = 1 AND event_type <> 'error'")
def current_versions(t: Tables) -> DataFrame:
    log = t.events.withColumn("gone", F.col("event_type") == "error")
    return history.current(log, ["user_id"], "event_id", "gone").select("user_id", "event_id", "value")


@query("SELECT event_id, user_id FROM events WHERE event_id > 500")
def changes_after_version(t: Tables) -> DataFrame:
    return history.changes(t.events.withColumnRenamed("event_id", history.VERSION), 500).select(F.col(history.VERSION).alias("event_id"), "user_id")


@query("SELECT o_orderkey, 'missing' AS problem FROM orders WHERE o_orderkey % 97 = 0 UNION ALL SELECT -1, 'dangling'")
def scrub_index(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderkey")
    index = rows.where("o_orderkey % 97 <> 0").union(t.spark.sql("SELECT -1L"))
    return history.scrub(index, rows).select("o_orderkey", "problem")
