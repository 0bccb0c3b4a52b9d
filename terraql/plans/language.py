"""SQL and definitions as text, search strings, geometry formats, and forms of keys, each through the layer that reads it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraql import catalog, ddl, dialect, statements
from terraql.functions import query_syntax, scalars, spatial, text
from terraql.operators import relational
from terraql.plans.registry import Tables, query
from terraql.sources import backfill, tables

# --- SQL text by types


@query("SELECT o_orderkey, o_orderkey // 7 AS whole, o_totalprice / 7 AS part, (o_orderkey // 4) // 3 AS twice, CASE WHEN o_custkey > 50 THEN 9 ELSE 7 END // 2 AS chosen FROM orders")
def sql_division(t: Tables) -> DataFrame:
    return dialect.sql(t.spark, "SELECT o_orderkey, o_orderkey / 7 AS whole, o_totalprice / 7 AS part, o_orderkey / 4 / 3 AS twice, CAST(CASE WHEN o_custkey > 50 THEN 9 ELSE 7 END / 2 AS INTEGER) AS chosen FROM orders", orders=t.orders)


@query("SELECT o_custkey // 10 AS bucket, sum(o_orderkey)::BIGINT // count(*) AS mean FROM orders GROUP BY o_custkey // 10")
def sql_division_of_groups(t: Tables) -> DataFrame:
    return dialect.sql(t.spark, "SELECT o_custkey / 10 AS bucket, sum(o_orderkey) / count(*) AS mean FROM orders GROUP BY o_custkey / 10", orders=t.orders)


@query("SELECT l_orderkey, l_linenumber, CAST(floor(l_extendedprice) + CASE WHEN l_extendedprice - floor(l_extendedprice) >= 0.5::DOUBLE THEN 1 ELSE 0 END AS BIGINT) AS price, CAST(floor(-l_tax * 50) + CASE WHEN -l_tax * 50 - floor(-l_tax * 50) >= 0.5::DOUBLE THEN 1 ELSE 0 END AS INTEGER) AS tax FROM lineitem")
def sql_casts(t: Tables) -> DataFrame:
    return dialect.sql(t.spark, "SELECT l_orderkey, l_linenumber, CAST(l_extendedprice AS BIGINT) AS price, CAST(-l_tax * 50 AS INTEGER) AS tax FROM lineitem", lineitem=t.lineitem)


@query("SELECT o_orderkey, (o_orderkey + 9007199254740000) // 10000 AS n, (o_orderkey + 9007199254740000) // 10000 * 10000 AS o FROM orders")
def sql_buckets(t: Tables) -> DataFrame:
    return dialect.sql(t.spark, "SELECT o_orderkey, bitmap_bucket_number(o_orderkey + 9007199254740000) AS n, bitmap_bucket_offset(o_orderkey + 9007199254740000) AS o FROM orders", orders=t.orders)


@query("SELECT vec_id, round(CASE WHEN vec_id % 9 = 0 THEN 'inf'::DOUBLE ELSE list_cosine_distance([x::DOUBLE FOR x IN embedding], [1::DOUBLE FOR x IN embedding]) END, 6) AS d FROM embeddings")
def sql_cosine(t: Tables) -> DataFrame:
    """Against ones, or against zeros, from which all is infinitely far."""
    other = F.transform("embedding", lambda x: F.when(F.col("vec_id") % 9 == 0, 0.0).otherwise(1.0))
    rows = t.embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("a"), other.alias("b"))
    return dialect.sql(t.spark, "SELECT vec_id, round(cosine_distance(a, b), 6) AS d FROM pairs", pairs=rows)


@query("SELECT a.event_id AS event_id, b.event_id AS other, a.event_id AS version FROM events a JOIN events b USING (event_id) WHERE a.value > 90")
def sql_row_versions(t: Tables) -> DataFrame:
    rows = t.events.withColumn("_row_version", F.col("event_id"))
    return dialect.sql(t.spark, 'SELECT a.event_id, b.event_id AS other, "__ROW_VERSION" AS version FROM changes AS a JOIN changes AS b USING ("__ROW_VERSION") WHERE a.value > 90', changes=rows)


@query("SELECT 0 AS incarnation")
def sql_incarnation(t: Tables) -> DataFrame:
    return dialect.sql(t.spark, "SELECT get_versionstamp_incarnation() AS incarnation")


PARTS = """WITH RECURSIVE edges AS (SELECT (p_partkey + 1) // 3 AS parent, p_partkey AS child FROM part WHERE p_partkey > 1),
walk AS (SELECT 1::BIGINT AS node, 0 AS level, [1::BIGINT] AS path UNION ALL SELECT child, level + 1, list_append(path, child) FROM walk JOIN edges ON parent = node) """


def _traversed(t: Tables, order: str) -> DataFrame:
    edges = t.part.where("p_partkey > 1").select(F.expr("(p_partkey + 1) div 3").alias("parent"), F.col("p_partkey").alias("child"))
    return dialect.sql(t.spark, f"WITH RECURSIVE walk(node, level) AS (SELECT 1L, 0 UNION ALL SELECT e.child, w.level + 1 FROM walk AS w, edges AS e WHERE e.parent = w.node) TRAVERSAL ORDER {order} SELECT node, level FROM walk", edges=edges)


@query(PARTS + "SELECT node, level FROM walk ORDER BY path")
def sql_traversal_preorder(t: Tables) -> DataFrame:
    return _traversed(t, "pre_order")


@query(PARTS + "SELECT node, level FROM walk ORDER BY list_append(path, 9223372036854775807)")
def sql_traversal_postorder(t: Tables) -> DataFrame:
    return _traversed(t, "post_order")


@query(PARTS + "SELECT node, level FROM walk ORDER BY level, path")
def sql_traversal_by_level(t: Tables) -> DataFrame:
    return _traversed(t, "level_order")


@query("SELECT label, vec_id FROM (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY array_distance([x::DOUBLE FOR x IN embedding]::DOUBLE[64], [0.1::DOUBLE FOR x IN embedding]::DOUBLE[64]), vec_id) AS n FROM embeddings) WHERE n <= 2")
def sql_window_options(t: Tables) -> DataFrame:
    rows = t.embeddings.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"), F.transform("embedding", lambda x: F.lit(0.1)).alias("q"))
    return dialect.sql(t.spark, "SELECT label, vec_id FROM near QUALIFY row_number() OVER (PARTITION BY label ORDER BY euclidean_distance(v, q), vec_id OPTIONS EF_SEARCH = 100) <= 2", near=rows)


@query("SELECT 3000000000 AS wide, -5 AS small, '616263' AS raw, '00000000-0000-0000-0000-00000000000a' AS id, 1.5::DOUBLE AS d")
def sql_literals(t: Tables) -> DataFrame:
    return dialect.sql(t.spark, "SELECT 3000000000 AS wide, -5 AS small, lower(hex(X'616263')) AS raw, '00000000-0000-0000-0000-00000000000a' AS id, 1.5 AS d")


# --- definitions as text


FIRM = """CREATE SCHEMA TEMPLATE firm
CREATE TYPE AS ENUM segment ('AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY')
CREATE TABLE customer (c_custkey BIGINT, c_nationkey INTEGER, c_acctbal DOUBLE, c_mktsegment segment NOT NULL, PRIMARY KEY (c_custkey))
CREATE TABLE nation (n_nationkey INTEGER, n_name STRING, PRIMARY KEY (n_nationkey))
CREATE INDEX by_segment AS SELECT c_mktsegment FROM customer
CREATE INDEX by_nation ON customer(c_nationkey) INCLUDE (c_acctbal)
CREATE VIEW solvent_builders AS SELECT * FROM solvent WHERE c_mktsegment = 'BUILDING'
CREATE VIEW solvent AS SELECT * FROM richer_than(0.0)
CREATE FUNCTION richer_than (IN least DOUBLE DEFAULT 100.0) AS SELECT * FROM customer WHERE c_acctbal > least
CREATE STORED QUERY builders AS SELECT n_name, count(*) AS n FROM solvent_builders JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name
WITH OPTIONS (STORE_ROW_VERSIONS=true)"""


def _firm(t: Tables) -> catalog.Catalog:
    made = catalog.Catalog(t.spark)
    for text_ in (FIRM, "CREATE DATABASE '/DOMAIN/FIRM'", "CREATE SCHEMA '/DOMAIN/FIRM/MAIN' WITH TEMPLATE firm"):
        ddl.execute(made, text_)
    made.bind("/DOMAIN/FIRM", "MAIN", lambda name: getattr(t, name))
    return made


@query("SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 0 AND c_mktsegment = 'BUILDING' GROUP BY n_name")
def ddl_stored_query(t: Tables) -> DataFrame:
    return _firm(t).run("/DOMAIN/FIRM", "MAIN", "builders")


@query("SELECT c_custkey FROM customer WHERE c_acctbal > 100")
def ddl_function(t: Tables) -> DataFrame:
    _firm(t)
    return dialect.sql(t.spark, "SELECT c_custkey FROM richer_than()")


@query("SELECT * FROM (VALUES ('customer', 0, 'c_custkey', 'bigint'), ('customer', 1, 'c_nationkey', 'int'), ('customer', 2, 'c_acctbal', 'double'), ('customer', 3, 'c_mktsegment', 'string'), ('nation', 0, 'n_nationkey', 'int'), ('nation', 1, 'n_name', 'string')) AS v(table_name, ordinal, column_name, data_type)")
def ddl_describe(t: Tables) -> DataFrame:
    return ddl.execute(_firm(t), "DESCRIBE SCHEMA '/DOMAIN/FIRM/MAIN'").select("table_name", "ordinal", "column_name", "data_type")


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 9000")
def ddl_temporary_function(t: Tables) -> DataFrame:
    made = _firm(t)
    ddl.execute(made, "CREATE TEMPORARY FUNCTION rich(IN least BIGINT) ON COMMIT DROP FUNCTION AS SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > least")
    return dialect.sql(t.spark, "SELECT c_custkey, c_acctbal FROM rich(least => 9000)")


@query("SELECT 'firm' AS template_name, 'by_segment' AS index_name, 'customer' AS table_name UNION ALL SELECT 'firm', 'by_nation', 'customer'")
def ddl_indexes(t: Tables) -> DataFrame:
    return _firm(t).system_tables()["indexes"].select("template_name", "index_name", "table_name")


@query("SELECT n_nationkey, n_name FROM nation UNION ALL SELECT 1000, 'NOWHERE'")
def ddl_insert(t: Tables) -> DataFrame:
    made = _firm(t)
    tables_ = statements.Database.of(made, "/DOMAIN/FIRM", "MAIN", lambda name: getattr(t, name))
    tables_.execute("INSERT INTO nation (n_nationkey, n_name) VALUES (1000, 'NOWHERE')")
    return tables_.execute("SELECT n_nationkey, n_name FROM nation")


# --- predicates and keys


@query("SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING max(CASE WHEN l_linenumber > 3 AND l_quantity > 40 THEN 1 ELSE 0 END) = 1")
def map_entries_match(t: Tables) -> DataFrame:
    pairs = F.array_distinct(F.collect_list(F.struct("l_linenumber", "l_quantity")))
    rows = t.lineitem.groupBy("l_orderkey").agg(pairs.alias("quantities"))
    return rows.where(scalars.map_matches(F.col("quantities"), lambda k: k > 3, lambda v: v > 40, ("l_linenumber", "l_quantity"))).select("l_orderkey")


@query("SELECT event_id, event_type IN ('click', 'view') AS numeric FROM events")
def runtime_types(t: Tables) -> DataFrame:
    """A value that is a number in some rows and a text in others."""
    value = F.when(F.col("event_type").isin("click", "view"), F.to_variant_object(F.array(F.lit(1)))).otherwise(F.to_variant_object(F.array(F.lit("x"))))
    return t.events.select("event_id", scalars.of_type(F.variant_get(value, "$[0]", "variant"), "BIGINT").alias("numeric"))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey >= 0")
def raises_when_met(t: Tables) -> DataFrame:
    """A value that is an error stands in a branch that no row takes."""
    return t.orders.where(F.when(F.col("o_orderkey") >= 0, F.lit(True)).otherwise(scalars.throws("a negative key").cast("boolean"))).select("o_orderkey")


@query("SELECT c_custkey FROM customer WHERE lower(c_mktsegment) = 'building' UNION ALL SELECT c_custkey FROM customer WHERE lower(c_mktsegment) = 'furniture'")
def collated_by_locale(t: Tables) -> DataFrame:
    one = scalars.collated(F.col("c_mktsegment"), "de", 2) == F.lit("building")
    two = scalars.collated(F.col("c_mktsegment"), None, 1) == F.lit("fürniture")
    return t.customer.where(one | two).select("c_custkey")


@query("SELECT doc_id FROM documents WHERE len(list_filter(regexp_split_to_array(lower(text), '[ \\t\\n\\x0b\\f\\r]+'), lambda x: starts_with(x, 'quee') OR starts_with(x, 'apac'))) > 0")
def text_contains_any_prefix(t: Tables) -> DataFrame:
    return t.documents.where(text.contains_any_prefix(text.tokens(F.col("text")), ["quee", "apac"])).select("doc_id")


@query("SELECT p_partkey FROM part WHERE starts_with(p_name, 'a')")
def starts_with_bytes(t: Tables) -> DataFrame:
    return t.part.where(scalars.bytes_start(F.encode("p_name", "UTF-8"), b"a")).select("p_partkey")


@query("SELECT DISTINCT l_orderkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_partkey % 100 = o_custkey % 100")
def in_list_of_column(t: Tables) -> DataFrame:
    """IN whose list is a column of the row itself."""
    lists = t.lineitem.groupBy("l_orderkey").agg(F.collect_set(F.expr("l_partkey % 100")).alias("keys"))
    both = lists.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return both.where(F.array_contains("keys", F.expr("o_custkey % 100"))).select("l_orderkey")


@query("SELECT o_custkey, o_orderkey FROM orders WHERE o_custkey IN (23, 7, 19, 11) ORDER BY o_custkey DESC, o_orderkey")
def in_list_sorted(t: Tables) -> DataFrame:
    """IN over a parameter, in the order of its values."""
    rows = dialect.sql(t.spark, "SELECT pos, key FROM (SELECT posexplode(reverse(array_sort(array_distinct(:keys)))) AS (pos, key))", args={"keys": F.array(*[F.lit(k) for k in (23, 7, 19, 11, 7)])})
    both = t.orders.join(F.broadcast(rows), F.col("o_custkey") == F.col("key"))  # as long as the parameter
    return both.orderBy("pos", "o_orderkey").select("o_custkey", "o_orderkey")


@query("SELECT o_custkey AS k, max(o_totalprice) AS most, n, c_acctbal FROM orders JOIN (SELECT o_custkey AS k2, count(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) ON o_custkey = k2 JOIN customer ON c_custkey = o_custkey GROUP BY ALL")
def intersection_keeping_legs(t: Tables) -> DataFrame:
    legs = [
        t.orders.groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_totalprice").alias("most")),
        t.orders.where("o_orderstatus = 'O'").groupBy(F.col("o_custkey").alias("k")).agg(F.count(F.lit(1)).alias("n")),
        t.customer.select(F.col("c_custkey").alias("k"), "c_acctbal"),
    ]
    return relational.intersect_legs(legs, ["k"])


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def intersection_by_key(t: Tables) -> DataFrame:
    rows = relational.intersect_on(t.orders.select("o_orderkey", "o_custkey"), t.customer.where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey")), ["o_custkey"])
    return relational.intersect_on(rows, t.lineitem.where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey")), ["o_orderkey"]).select("o_orderkey")


@query("SELECT a.l_orderkey AS l_orderkey, a.l_linenumber AS x, b.l_returnflag AS y FROM lineitem a JOIN (SELECT DISTINCT l_orderkey, l_returnflag FROM lineitem) b ON a.l_orderkey = b.l_orderkey")
def keys_crossed(t: Tables) -> DataFrame:
    """Two repeated fields as one composite key: a row for each combination of their elements."""
    rows = t.lineitem.groupBy("l_orderkey").agg(F.collect_list("l_linenumber").alias("xs"), F.collect_set("l_returnflag").alias("ys"))
    return relational.unnest(relational.unnest(rows, "xs", "x"), "ys", "y").select("l_orderkey", "x", "y")


@query("SELECT l_orderkey, list_sort(list(l_linenumber))[1] AS x, list_sort(list(DISTINCT l_returnflag))[1] AS y, count(*) * count(DISTINCT l_returnflag) AS n FROM lineitem GROUP BY l_orderkey")
def keys_as_lists(t: Tables) -> DataFrame:
    """The same combinations as lists within a list."""
    rows = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_linenumber")).alias("xs"), F.array_sort(F.collect_set("l_returnflag")).alias("ys"))
    lists = F.transform("xs", lambda x: F.transform("ys", lambda y: F.struct(x.alias("x"), y.alias("y"))))
    flat = F.flatten(lists)
    return rows.select("l_orderkey", flat[0]["x"].alias("x"), flat[0]["y"].alias("y"), F.size(flat).cast("bigint").alias("n"))


# --- search strings


TOKENS = "list_filter(regexp_split_to_array(lower(text), '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> '')"


@query(f"SELECT doc_id FROM (SELECT doc_id, source, {TOKENS} AS w FROM documents) WHERE list_contains(w, 'licensed') OR source = 'src1'")
def text_search_all_fields(t: Tables) -> DataFrame:
    found = query_syntax.search("licensed src1", {"text": F.col("text"), "source": F.col("source")}, every=True)
    # a word stands for a match in any field; documents hold no word src1, and no source is called licensed
    return t.documents.where(found).select("doc_id")


@query(f"SELECT doc_id FROM (SELECT doc_id, {TOKENS} AS w FROM documents) WHERE len(list_filter(w, lambda x: regexp_full_match(x, 'li.ens.*d') OR levenshtein(x, 'apache') <= 1)) > 0")
def text_search_patterns(t: Tables) -> DataFrame:
    return t.documents.where(query_syntax.search("li?ens*d OR apache~1", {"text": F.col("text")})).select("doc_id")


@query(f"SELECT doc_id FROM (SELECT doc_id, {TOKENS} AS w FROM documents) WHERE len(list_filter(w, lambda x: x >= 'zz' AND x <= 'zzz')) > 0 OR (list_contains(w, 'mit') AND NOT list_contains(w, 'license.'))")
def text_search_ranges(t: Tables) -> DataFrame:
    return t.documents.where(query_syntax.search("[zz TO zzz] OR (mit^2 AND NOT license.)", {"text": F.col("text")})).select("doc_id")


@query(f"""WITH p AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM (SELECT doc_id, {TOKENS} AS w FROM documents))
SELECT DISTINCT a.doc_id FROM p a JOIN p b ON a.doc_id = b.doc_id AND a.x = 'under' AND b.x = 'license,' AND abs(a.i - b.i) <= 5""")
def text_search_slop(t: Tables) -> DataFrame:
    """Two words with up to four others between them, in either order."""
    return t.documents.where(query_syntax.search('"under license,"~4', {"text": F.col("text")})).select("doc_id")


# --- geometry, storage


@query("SELECT c_custkey, (c_custkey * 37 % 17000) / 100.0::DOUBLE - 85 AS lat, (c_custkey * 91 % 35900) / 100.0::DOUBLE - 179.5::DOUBLE AS lon, 3 AS forms FROM customer")
def points_from_formats(t: Tables) -> DataFrame:
    """The same points from GeoJSON, WKT and WKB."""
    k = F.col("c_custkey")
    rows = t.customer.select("c_custkey", (k * 37 % 17000 / 100.0 - 85).alias("lat"), (k * 91 % 35900 / 100.0 - 179.5).alias("lon"))
    json = F.to_json(F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates")))
    wkt = F.concat(F.lit("POINT ("), F.col("lon").cast("string"), F.lit(" "), F.col("lat").cast("string"), F.lit(")"))
    read = rows.select("*", spatial.from_geojson(json).alias("a"), spatial.from_wkt(wkt).alias("b"), spatial.from_wkb()(spatial.to_wkb()(F.col("lat"), F.col("lon"))).alias("c"))
    same = (F.col("a") == F.col("b")).cast("int") + (F.col("b") == F.col("c")).cast("int") + (F.col("a.lat") == F.col("lat")).cast("int")
    return read.select("c_custkey", F.col("a.lat").alias("lat"), F.col("c.lon").alias("lon"), same.alias("forms"))


@query("SELECT z, count(*) AS n FROM (SELECT list_sum([((r >> b) & 1) * (1 << (2 * b + 1)) + ((c >> b) & 1) * (1 << (2 * b)) FOR b IN range(16)])::BIGINT AS z FROM (SELECT floor(((c_custkey * 37 % 17000) / 100.0::DOUBLE - 85 + 90) / 5)::BIGINT AS r, floor(((c_custkey * 91 % 35900) / 100.0::DOUBLE - 179.5::DOUBLE + 180) / 5)::BIGINT AS c FROM customer)) GROUP BY z")
def points_by_z_cell(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    row, column = spatial.cell(k * 37 % 17000 / 100.0 - 85, k * 91 % 35900 / 100.0 - 179.5, 5.0)
    return t.customer.groupBy(spatial.z_order(row, column).alias("z")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT user_id, event_id FROM events WHERE user_id IS NOT NULL")
def index_backfill(t: Tables) -> DataFrame:
    """An index written part by part, stopped after two parts and taken up again."""
    path = f"{tables.shared_folder(t.spark)}/index-{uuid.uuid4().hex}"
    rows = t.events.where("user_id IS NOT NULL").select("user_id", "event_id")
    backfill.build(rows, path, ["user_id"], parts=4, most=2)
    return backfill.build(rows, path, ["user_id"], parts=4)
