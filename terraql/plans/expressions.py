"""Scalar expressions, user functions, text, spatial and vector search, catalog and streams."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraql import catalog, dialect
from terraql.functions import bitmaps, query_syntax, scalars, spatial, text, user, vectors
from terraql.operators import relational, search
from terraql.plans.registry import Tables, query
from terraql.sources import tables
from terraql.streaming import windows

# --- scalar expressions


@query("SELECT o_orderkey, o_orderkey + o_custkey AS a, o_orderkey - o_custkey AS s, o_orderkey * 3 AS m, o_custkey % 7 AS r, o_orderkey & 12 AS band, o_orderkey | 5 AS bor, xor(o_orderkey, o_custkey) AS bxor, -o_custkey AS neg FROM orders")
def arithmetic(t: Tables) -> DataFrame:
    a, b = F.col("o_orderkey"), F.col("o_custkey")
    return t.orders.select("o_orderkey", (a + b).alias("a"), (a - b).alias("s"), (a * 3).alias("m"), (b % 7).alias("r"), a.bitwiseAND(F.lit(12)).alias("band"), a.bitwiseOR(F.lit(5)).alias("bor"), a.bitwiseXOR(b).alias("bxor"), (-b).alias("neg"))


@query("SELECT a, b, CAST(trunc(a::DOUBLE / b) AS BIGINT) AS q, a % b AS r FROM (VALUES (7, 2), (-7, 2), (7, -2), (-7, -2), (6, 3)) AS v(a, b)")
def integer_division(t: Tables) -> DataFrame:
    rows = t.spark.createDataFrame([(7, 2), (-7, 2), (7, -2), (-7, -2), (6, 3)], "a int, b int")
    return rows.select("a", "b", scalars.divide("a", "b", "int", "int").cast("bigint").alias("q"), (F.col("a") % F.col("b")).alias("r"))


@query("""SELECT a, b, CASE WHEN a IS NULL OR b IS NULL THEN NULL ELSE greatest(a, b) END AS high, CASE WHEN a IS NULL OR b IS NULL THEN NULL ELSE least(a, b) END AS low, coalesce(a, b, 0) AS one
FROM (VALUES (1, 2), (5, 3), (NULL, 4), (NULL, NULL)) AS v(a, b)""")
def greatest_least(t: Tables) -> DataFrame:
    rows = t.spark.createDataFrame([(1, 2), (5, 3), (None, 4), (None, None)], "a int, b int")
    return dialect.sql(t.spark, "SELECT a, b, greatest(a, b) AS high, least(a, b) AS low, coalesce(a, b, 0) AS one FROM pairs", pairs=rows)


@query("SELECT v, CAST(floor(v + 0.5) AS INTEGER) AS i, CAST(floor(v + 0.5) AS BIGINT) AS l, CAST(v AS FLOAT) AS f, v <> 0 AS b FROM (VALUES (2.5::DOUBLE), (2.4::DOUBLE), (-2.5::DOUBLE), (0::DOUBLE), (-0.6::DOUBLE)) AS x(v)")
def cast_numbers(t: Tables) -> DataFrame:
    v = F.col("v")
    rows = t.spark.createDataFrame([(2.5,), (2.4,), (-2.5,), (0.0,), (-0.6,)], "v double")
    return rows.select("v", scalars.to_integer(v).alias("i"), scalars.to_integer(v, "bigint").alias("l"), v.cast("float").alias("f"), v.cast("boolean").alias("b"))


@query("SELECT s, CAST(s AS INTEGER) AS i, s = '1' AS b, CAST(CAST(s AS INTEGER) AS VARCHAR) AS back FROM (VALUES ('1'), ('0')) AS x(s)")
def cast_strings(t: Tables) -> DataFrame:
    s = F.col("s")
    return t.spark.createDataFrame([("1",), ("0",)], "s string").select("s", s.cast("int").alias("i"), s.cast("boolean").alias("b"), s.cast("int").cast("string").alias("back"))


@query("SELECT l_orderkey, list(l_partkey ORDER BY l_linenumber, l_partkey)[1] AS first, list(l_partkey ORDER BY l_linenumber, l_partkey)[3] AS third, len(list(l_partkey)) AS n FROM lineitem GROUP BY l_orderkey")
def array_elements(t: Tables) -> DataFrame:
    pairs = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey")))
    rows = t.lineitem.groupBy("l_orderkey").agg(F.transform(pairs, lambda x: x["l_partkey"]).alias("parts"))
    return dialect.sql(t.spark, "SELECT l_orderkey, parts[1] AS first, parts[3] AS third, CAST(cardinality(parts) AS BIGINT) AS n FROM orders_parts", orders_parts=rows)


@query("SELECT l_orderkey, count(DISTINCT l_returnflag) AS kinds, min(l_linenumber) AS first FROM lineitem GROUP BY l_orderkey")
def array_functions(t: Tables) -> DataFrame:
    rows = t.lineitem.groupBy("l_orderkey").agg(F.collect_list("l_returnflag").alias("flags"), F.array_sort(F.collect_list("l_linenumber")).alias("numbers"))
    kinds = scalars.cardinality(F.array_distinct("flags")).cast("bigint")
    return rows.select("l_orderkey", kinds.alias("kinds"), scalars.first_or_default(F.col("numbers"), F.lit(-1)).alias("first"))


@query("SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' END AS kind, CASE WHEN p_size < 10 THEN 0 WHEN p_size < 30 THEN 1 END AS place FROM part")
def case_and_pick(t: Tables) -> DataFrame:
    place = scalars.condition_selector(F.col("p_size") < 10, F.col("p_size") < 30)
    return t.part.select("p_partkey", scalars.pick(place, F.lit("small"), F.lit("medium")).alias("kind"), place.alias("place"))


@query("SELECT o_orderkey, o_orderkey % 10000 AS p, o_orderkey - o_orderkey % 10000 AS o, o_orderkey // 10000 AS n FROM (SELECT o_orderkey * 37 AS o_orderkey FROM orders)")
def bitmap_functions(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    rows = t.orders.select((k * 37).alias("o_orderkey"))
    return rows.select("o_orderkey", bitmaps.bit_position(k).cast("bigint").alias("p"), bitmaps.bucket_offset(k).alias("o"), bitmaps.bucket_number(k).alias("n"))


@query("SELECT 3.14::DOUBLE AS d, 7::BIGINT AS l, 2::INTEGER AS i, 1.5::FLOAT AS f, 'it''s' AS s")
def literals(t: Tables) -> DataFrame:
    return dialect.sql(t.spark, "SELECT 3.14 AS d, 7L AS l, 2i AS i, 1.5f AS f, concat('it', chr(39), 's') AS s")


@query("SELECT event_type, list_position(['view', 'signup', 'click', 'purchase', 'error'], event_type) - 1 AS place, count(*) AS n FROM events WHERE list_position(['view', 'signup', 'click', 'purchase', 'error'], event_type) > 2 GROUP BY event_type")
def enumerations(t: Tables) -> DataFrame:
    place = scalars.enum_ordinal(F.col("event_type"), ["view", "signup", "click", "purchase", "error"])
    return t.events.where(place > 1).groupBy("event_type", place.cast("int").alias("place")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT lower(c_mktsegment) AS k, count(*) AS n FROM customer WHERE lower(c_mktsegment) = 'building' GROUP BY 1")
def collation(t: Tables) -> DataFrame:
    same = F.collate(F.col("c_mktsegment"), "UNICODE_CI") == F.lit("Building")
    return t.customer.where(same).groupBy(F.lower("c_mktsegment").alias("k")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_totalprice > 200000 AND o_orderstatus = 'O'")
def named_parameters(t: Tables) -> DataFrame:
    return dialect.sql(t.spark, "SELECT o_orderkey, o_custkey FROM orders WHERE o_totalprice > :least AND o_orderstatus = :status", args={"least": 200000, "status": "O"}, orders=t.orders)


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def whole_rows(t: Tables) -> DataFrame:
    return t.nation.select(F.struct("*").alias("n")).select("n.*")


@query("SELECT uuid, count(*) AS n FROM (SELECT CASE WHEN o_orderkey % 2 = 0 THEN '00000000-0000-0000-0000-000000000002' ELSE '00000000-0000-0000-0000-000000000001' END AS uuid FROM orders) GROUP BY uuid")
def uuid_keys(t: Tables) -> DataFrame:
    key = F.lower(F.concat(F.lit("00000000-0000-0000-0000-00000000000"), F.when(F.col("o_orderkey") % 2 == 0, "2").otherwise("1")))
    return t.orders.groupBy(key.alias("uuid")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey, o_orderkey // 100 AS piece FROM orders")
def split_arrays(t: Tables) -> DataFrame:
    """Repeated values in tuples of a fixed size."""
    rows = t.orders.groupBy(F.expr("o_orderkey div 100").alias("piece")).agg(F.collect_list("o_orderkey").alias("keys"))
    fours = rows.withColumn("four", F.explode(F.transform(F.sequence(F.lit(0), F.expr("(size(keys) - 1) div 4")), lambda i: F.slice("keys", i * 4 + 1, 4))))
    return relational.unnest(fours, "four", "o_orderkey").select("o_orderkey", "piece")


# --- functions of users


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = 7 AND o_totalprice >= 1000")
def sql_table_function(t: Tables) -> DataFrame:
    t.orders.createOrReplaceTempView("orders")
    user.table_function(t.spark, "orders_of", "who BIGINT, least DOUBLE DEFAULT 1000D", "o_orderkey BIGINT, o_totalprice DOUBLE", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = who AND o_totalprice >= least")
    return t.spark.sql("SELECT * FROM orders_of(who => 7L)")


@query("SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net FROM lineitem")
def sql_macro(t: Tables) -> DataFrame:
    user.macro(t.spark, "net_price", "price DOUBLE, discount DOUBLE", "DOUBLE", "price * (1D - discount)")
    return dialect.sql(t.spark, "SELECT l_orderkey, l_linenumber, round(net_price(l_extendedprice, l_discount), 4) AS net FROM lineitem", lineitem=t.lineitem)


@query("SELECT p_partkey, reverse(p_brand) AS back FROM part")
def external_function(t: Tables) -> DataFrame:
    functions = user.External()
    functions.register("backward", "string", lambda s: s.str[::-1])
    return t.part.select("p_partkey", functions.call("backward", F.col("p_brand")).alias("back"))


@query("SELECT c_mktsegment, count(*) * 2 AS twice FROM customer GROUP BY c_mktsegment")
def external_aggregate(t: Tables) -> DataFrame:
    def twice(values: pd.Series) -> int:
        return 2 * len(values)

    return t.customer.groupBy("c_mktsegment").agg(user.aggregate(twice, "bigint")("c_custkey").alias("twice"))


def _up_to(t: Tables) -> None:
    from pyspark.sql.functions import udtf

    @udtf(returnType="i: bigint")
    class UpTo:
        def eval(self, n: int):
            for i in range(1, n + 1):
                yield (i,)

    t.spark.udtf.register("up_to", UpTo)
    t.orders.createOrReplaceTempView("orders")


@query("SELECT o_orderkey, unnest(range(1, o_orderkey % 4 + 1)) AS i FROM orders")
def external_table_function(t: Tables) -> DataFrame:
    _up_to(t)
    return t.spark.sql("SELECT o_orderkey, i FROM orders, LATERAL up_to(o_orderkey % 4)")


# --- text


WORDS_SQL = "WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> '') AS w FROM documents) "


@query(WORDS_SQL + "SELECT doc_id FROM w WHERE list_contains(w, 'the') AND list_contains(w, 'and')")
def text_contains_all(t: Tables) -> DataFrame:
    return t.documents.where(text.contains_all(text.tokens(F.col("text")), ["the", "and"])).select("doc_id")


@query(WORDS_SQL + "SELECT doc_id FROM w WHERE list_has_any(w, ['queen', 'mit', 'licensed'])")
def text_contains_any(t: Tables) -> DataFrame:
    return t.documents.where(text.contains_any(text.tokens(F.col("text")), ["queen", "mit", "licensed"])).select("doc_id")


@query(WORDS_SQL + "SELECT doc_id FROM w WHERE len(list_filter(w, lambda x: starts_with(x, 'licen'))) > 0")
def text_contains_prefix(t: Tables) -> DataFrame:
    return t.documents.where(text.contains_prefix(text.tokens(F.col("text")), "licen")).select("doc_id")


@query(WORDS_SQL + "SELECT doc_id FROM w WHERE len(list_filter(w, lambda x: starts_with(x, 'licen'))) > 0 AND len(list_filter(w, lambda x: starts_with(x, 'apa'))) > 0")
def text_contains_all_prefixes(t: Tables) -> DataFrame:
    return t.documents.where(text.contains_all_prefixes(text.tokens(F.col("text")), ["licen", "apa"])).select("doc_id")


@query(WORDS_SQL + "SELECT doc_id FROM w WHERE contains(' ' || array_to_string(w, ' ') || ' ', ' of the ')")
def text_phrase(t: Tables) -> DataFrame:
    return t.documents.where(text.contains_phrase(text.tokens(F.col("text")), ["of", "the"])).select("doc_id")


@query("""WITH p AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> '') AS w FROM documents))
SELECT DISTINCT a.doc_id FROM p a JOIN p b ON a.doc_id = b.doc_id AND a.x = 'the' AND b.x = 'with' AND abs(a.i - b.i) <= 3""")
def text_proximity(t: Tables) -> DataFrame:
    return t.documents.where(text.contains_all(text.tokens(F.col("text")), ["the", "with"], within=3)).select("doc_id").distinct()


@query("""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> '') AS w FROM documents),
n AS (SELECT doc_id, len(w) AS l, len(list_filter(w, lambda x: x = 'licensed')) AS a, len(list_filter(w, lambda x: x = 'under')) AS b FROM w),
s AS (SELECT count(*) AS docs, avg(l) AS mean, count(*) FILTER (a > 0) AS da, count(*) FILTER (b > 0) AS db FROM n)
SELECT doc_id, round(ln(1 + (docs - da + 0.5::DOUBLE) / (da + 0.5::DOUBLE)) * a * 2.2::DOUBLE / (a + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * l / mean))
 + ln(1 + (docs - db + 0.5::DOUBLE) / (db + 0.5::DOUBLE)) * b * 2.2::DOUBLE / (b + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * l / mean)), 6) AS score FROM n, s WHERE a > 0 OR b > 0""")
def text_relevance(t: Tables) -> DataFrame:
    return search.bm25(t.documents, "doc_id", "text", ["Licensed", "under"]).select("doc_id", F.round("score", 6).alias("score"))


@query("SELECT doc_id, regexp_extract(regexp_replace(text, '(Licensed)', '<b>\\1</b>', 'g'), '<b>[^<]*</b>[^.\\n]*', 0) AS shown FROM documents WHERE contains(text, 'Licensed under ')")
def text_highlight(t: Tables) -> DataFrame:
    marked = text.highlight(F.col("text"), ["Licensed"])
    return t.documents.where(F.col("text").contains("Licensed under ")).select("doc_id", F.regexp_extract(marked, r"<b>[^<]*</b>[^.\n]*", 0).alias("shown"))


@query(WORDS_SQL + "SELECT DISTINCT doc_id, unnest(list_filter(w, lambda x: starts_with(x, 'und'))) AS completion FROM w WHERE list_contains(w, 'licensed')")
def text_autocomplete(t: Tables) -> DataFrame:
    return search.autocomplete(t.documents, "doc_id", "text", "licensed und").distinct()


@query("""WITH v AS (SELECT unnest(list_filter(regexp_split_to_array(lower(text), '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> '')) AS suggestion FROM documents)
SELECT suggestion, count(*) AS frequency, levenshtein(suggestion, 'licence')::INT AS distance FROM v WHERE length(suggestion) BETWEEN 5 AND 9 AND levenshtein(suggestion, 'licence') <= 2 GROUP BY suggestion ORDER BY distance, frequency DESC, suggestion LIMIT 5""")
def text_spelling(t: Tables) -> DataFrame:
    return search.spell_check(t.documents, "text", "licence").select("suggestion", "frequency", "distance")


@query(WORDS_SQL + "SELECT x AS token, count(*) AS n FROM (SELECT unnest(w) AS x FROM w) GROUP BY x")
def text_inverted_index(t: Tables) -> DataFrame:
    return search.inverted(t.documents, "doc_id", "text").groupBy("token").agg(F.count(F.lit(1)).alias("n"))


@query()
def text_folded(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", F.explode(text.folded_tokens()(F.col("text"))).alias("token"))
    return rows.groupBy("token").agg(F.count(F.lit(1)).alias("n"))


@query(WORDS_SQL + "SELECT doc_id FROM w WHERE list_contains(w, 'the') AND NOT list_contains(w, 'and') UNION ALL SELECT doc_id FROM w WHERE list_contains(w, 'la') AND NOT list_contains(w, 'the')")
def text_boolean(t: Tables) -> DataFrame:
    w = text.tokens(F.col("text"))
    the = text.contains(w, "the")
    return t.documents.where((the & ~text.contains(w, "and")) | (text.contains(w, "la") & ~the)).select("doc_id")


@query(WORDS_SQL + "SELECT doc_id FROM w WHERE (list_contains(w, 'licensed') AND NOT list_contains(w, 'apache')) OR contains(' ' || array_to_string(w, ' ') || ' ', ' mit license. ') OR len(list_filter(w, lambda x: starts_with(x, 'queen'))) > 0")
def text_query_string(t: Tables) -> DataFrame:
    found = query_syntax.search('(licensed AND NOT apache) OR "MIT License." text:queen*', {"text": F.col("text")})
    return t.documents.where(found).select("doc_id")


@query("SELECT p_partkey FROM part WHERE p_size & 5 = 5")
def bit_set_query(t: Tables) -> DataFrame:
    return t.part.where(search.bit_set(F.col("p_size"), 5)).select("p_partkey")


# --- space


POINTS_SQL = "WITH p AS (SELECT c_custkey AS id, (c_custkey * 37 % 17000) / 100.0::DOUBLE - 85 AS lat, (c_custkey * 91 % 35900) / 100.0::DOUBLE - 179.5::DOUBLE AS lon FROM customer) "
HAVERSINE = "2 * 6371.0088::DOUBLE * asin(sqrt(least(1, pow(sin(radians({b}lat - {a}lat) / 2), 2) + cos(radians({a}lat)) * cos(radians({b}lat)) * pow(sin(radians({b}lon - {a}lon) / 2), 2))))"


def _points(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    return t.customer.select(k.alias("id"), (k * 37 % 17000 / 100.0 - 85).alias("lat"), (k * 91 % 35900 / 100.0 - 179.5).alias("lon"))


@query(POINTS_SQL + ", q AS (SELECT 48.85::DOUBLE AS lat, 2.35::DOUBLE AS lon) SELECT p.id, round(" + HAVERSINE.format(a="p.", b="q.") + ", 3) AS km FROM p, q WHERE " + HAVERSINE.format(a="p.", b="q.") + " <= 6000")
def points_within(t: Tables) -> DataFrame:
    at = (48.85, 2.35)
    km = spatial.haversine(F.col("lat"), F.col("lon"), F.lit(at[0]), F.lit(at[1]))
    return _points(t).where(spatial.within(F.col("lat"), F.col("lon"), at, 6000)).select("id", F.round(km, 3).alias("km"))


@query(POINTS_SQL + "SELECT a.id AS left_id, b.id AS right_id FROM p a JOIN p b ON a.id < b.id AND " + HAVERSINE.format(a="a.", b="b.") + " <= 150")
def points_joined(t: Tables) -> DataFrame:
    both = search.spatial_join(_points(t).withColumnRenamed("id", "left_id"), _points(t).withColumnRenamed("id", "right_id"), 150)
    return both.where("left_id < right_id").select("left_id", "right_id")


@query("SELECT o_orderkey FROM orders WHERE o_custkey BETWEEN 10 AND 60 AND o_totalprice BETWEEN 50000 AND 150000 AND o_orderdate BETWEEN TIMESTAMP '1994-01-01' AND TIMESTAMP '1996-12-31'")
def box_of_dimensions(t: Tables) -> DataFrame:
    dates = F.col("o_orderdate").between(F.expr("TIMESTAMP_NTZ '1994-01-01'"), F.expr("TIMESTAMP_NTZ '1996-12-31'"))
    return t.orders.where(F.col("o_custkey").between(10, 60) & F.col("o_totalprice").between(50000, 150000) & dates).select("o_orderkey")


# --- vectors


QUERY_SQL = "WITH q AS (SELECT [x::DOUBLE FOR x IN embedding] AS q FROM embeddings WHERE vec_id = 3), e AS (SELECT vec_id, label, [x::DOUBLE FOR x IN embedding] AS v FROM embeddings) "


def _query(t: Tables) -> list[float]:
    return t.embeddings.where("vec_id = 3").first()["embedding"]


@query(QUERY_SQL + "SELECT vec_id, round(array_distance(v::DOUBLE[64], q::DOUBLE[64]), 6) AS distance FROM e, q ORDER BY array_distance(v::DOUBLE[64], q::DOUBLE[64]), vec_id LIMIT 10")
def nearest_euclidean(t: Tables) -> DataFrame:
    return search.nearest(t.embeddings, "embedding", _query(t), 10).select("vec_id", F.round("distance", 6).alias("distance"))


@query(QUERY_SQL + "SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY list_cosine_distance(v, q), vec_id) AS row FROM e, q QUALIFY row <= 3")
def nearest_cosine_by_label(t: Tables) -> DataFrame:
    rows = search.nearest(t.embeddings, "embedding", _query(t), 3, "cosine", partition=["label"])
    return rows.select("label", "vec_id", F.col("row").cast("bigint").alias("row"))


@query(QUERY_SQL + "SELECT vec_id, round(-list_inner_product(v, q), 6) AS distance FROM e, q ORDER BY -list_inner_product(v, q), vec_id LIMIT 10")
def nearest_dot_product(t: Tables) -> DataFrame:
    return search.nearest(t.embeddings, "embedding", _query(t), 10, "dot_product").select("vec_id", F.round("distance", 6).alias("distance"))


@query(QUERY_SQL + ", d AS (SELECT vec_id, pow(array_distance(v::DOUBLE[64], q::DOUBLE[64]), 2) AS d FROM e, q) SELECT vec_id, round(d, 6) AS distance FROM d WHERE d > 1.2::DOUBLE ORDER BY d, vec_id LIMIT 10")
def nearest_outward(t: Tables) -> DataFrame:
    return search.nearest(t.embeddings, "embedding", _query(t), 10, "euclidean_square", beyond=1.2).select("vec_id", F.round("distance", 6).alias("distance"))


@query("SELECT a, round(a, 6) AS d, isinf(a) AS zero FROM (VALUES ('inf'::DOUBLE)) AS v(a)")
def cosine_of_zero(t: Tables) -> DataFrame:
    rows = t.spark.createDataFrame([([0.0, 0.0], [1.0, 2.0])], "x array<double>, y array<double>")
    a = vectors.cosine_distance(F.col("x"), F.col("y"))
    return rows.select(a.alias("a"), F.round(a, 6).alias("d"), (a == float("inf")).alias("zero"))


@query("SELECT v, h::FLOAT AS h FROM (VALUES (0.1::DOUBLE, 0.0999755859375), (1.0::DOUBLE, 1.0), (-2049.0::DOUBLE, -2048.0), (0.0::DOUBLE, 0.0)) AS x(v, h)")
def half_precision(t: Tables) -> DataFrame:
    return t.spark.createDataFrame([(0.1,), (1.0,), (-2049.0,), (0.0,)], "v double").select("v", scalars.half(F.col("v")).alias("h"))


# --- catalog, storage and streams


@query("SELECT * FROM (VALUES ('shop', 'orders', 0, 'o_orderkey', 'bigint'), ('shop', 'orders', 1, 'o_custkey', 'bigint'), ('shop', 'orders', 2, 'q', 'struct<a:int,b:array<string>>')) AS v(template_name, table_name, ordinal, column_name, data_type)")
def system_columns(t: Tables) -> DataFrame:
    made = catalog.Catalog(t.spark)
    made.create_template(catalog.Template("shop").table("orders", "o_orderkey bigint, o_custkey bigint, q struct<a:int,b:array<string>>", ("o_orderkey",)))
    return made.system_tables()["columns"].select("template_name", "table_name", "ordinal", "column_name", "data_type")


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 5")
def stored_query(t: Tables) -> DataFrame:
    made = catalog.Catalog(t.spark)
    template = catalog.Template("shop").table("orders", "o_orderkey bigint, o_custkey bigint", ("o_orderkey",))
    made.create_template(template.query("regulars", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 5"))
    made.create_database("/shop")
    made.create_schema("/shop", "main", "shop")
    made.bind("/shop", "main", lambda name: getattr(t, name))
    return made.run("/shop", "main", "regulars")


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def copy_out_and_in(t: Tables) -> DataFrame:
    path = f"{tables.shared_folder(t.spark)}/copy-{uuid.uuid4().hex}"
    tables.export(t.nation, path, "n_regionkey")
    return tables.load(t.spark, path, "n_nationkey int, n_name string, n_regionkey int")


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL")
def batch_windows(t: Tables) -> DataFrame:
    rows = windows.windowed(t.events, "ts", "1 hour", groups=["event_type"])
    return rows.select("window_start", "event_type", "n")


@query("""WITH s AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '6 hours' THEN 0 ELSE 1 END AS new FROM events),
g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM s) SELECT user_id, min(ts) AS window_start, count(*) AS n FROM g GROUP BY user_id, g""")
def batch_sessions(t: Tables) -> DataFrame:
    return windows.sessions(t.events, "ts", "6 hours", groups=["user_id"]).select("user_id", "window_start", "n")


@query("SELECT event_type, min(value) AS min_ever, max(value) AS max_ever, count(*) AS count_updates FROM events GROUP BY event_type")
def stream_extrema(t: Tables) -> DataFrame:
    stream = windows.source(t.spark, f"{t.folder}/events.parquet")
    return windows.drain(windows.extrema_ever(stream, ["event_type"], "value"), "stream_extrema", "complete")
