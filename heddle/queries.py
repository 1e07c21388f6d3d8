"""The engine's queries over the sample tables, each with the DuckDB SQL of its rows."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.functions.scalars import InputError
from heddle.operators.mutations import Writer, scratch_store
from heddle.plans.catalog import Catalog, load
from heddle.plans.executor import Executor
from heddle.plans.policy import Identity, resolve
from heddle.plans.reader import Branch, Leaf, Reader
from heddle.plans.registry import Registry
from heddle.sources.parquet import parquet_tables, schemas
from heddle.sources.shared import shared_folder

NAMES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)
ALL = {"tables": {"*": {"select": True, "insert": True, "update": True, "delete": True}}}
DECLARED = (Path(__file__).parent / "tables.yaml").read_text()
_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_sql: dict[str, str] = {}


def reader(spark: SparkSession, sf_dir: str, names: tuple[str, ...] = NAMES, rules: dict | None = None, claims: dict[str, Any] | None = None) -> Reader:
    tables = parquet_tables(spark, sf_dir)
    catalog: Catalog = load(DECLARED, schemas(tables, names))
    return Reader(spark, catalog, resolve("role", rules or ALL, catalog), Identity("role", claims or {}), tables)


def query(name: str, sql: str | None, *names: str, rules: dict | None = None, claims: dict | None = None):
    """Register a plan over a reader of the named tables."""

    def register(plan: Callable[[Reader], DataFrame]) -> Callable[[Reader], DataFrame]:
        _queries[name] = lambda spark, sf_dir: plan(reader(spark, sf_dir, names or NAMES, rules, claims))
        if sql:
            _sql[name] = " ".join(sql.split())
        return plan

    return register


def _filter(name: str, table: str, where: dict, condition: str, columns: str = "*") -> None:
    @query(name, f"SELECT {columns} FROM {table} WHERE {condition}", table)
    def plan(r: Reader) -> DataFrame:
        df = r.select(table, where)
        return df if columns == "*" else df.select(*columns.split(", "))


# lookups and pages


@query("by_pk", "SELECT * FROM orders WHERE o_orderkey = 7", "orders")
def _by_pk(r: Reader) -> DataFrame:
    return r.by_pk("orders", {"o_orderkey": 7})


@query("by_pk_composite", "SELECT * FROM conversations WHERE conv_id = 3 AND turn = 1", "conversations")
def _by_pk_composite(r: Reader) -> DataFrame:
    return r.by_pk("conversations", {"conv_id": 3, "turn": 1})


@query("connection_page", "SELECT * FROM orders WHERE o_totalprice > 1000 ORDER BY o_orderkey LIMIT 11", "orders")
def _page(r: Reader) -> DataFrame:
    return r.page("orders", {"o_totalprice": {"_gt": 1000}}, 10)[0]


def _after(r: Reader, table: str, key: list, first: int, where: dict | None = None) -> DataFrame:
    from heddle.operators.paging import encode_cursor, shape

    return r.page(table, where, first, encode_cursor(key, shape(table, where)))[0]


@query("connection_after", "SELECT * FROM orders WHERE o_orderkey > 100 ORDER BY o_orderkey LIMIT 21", "orders")
def _page_after(r: Reader) -> DataFrame:
    return _after(r, "orders", [100], 20)


@query("connection_composite_after", "SELECT * FROM conversations WHERE conv_id > 5 OR (conv_id = 5 AND turn > 0) ORDER BY conv_id, turn LIMIT 31", "conversations")
def _page_composite(r: Reader) -> DataFrame:
    return _after(r, "conversations", [5, 0], 30)


@query("connection_clamped", "SELECT * FROM customer ORDER BY c_custkey LIMIT 201", "customer")
def _page_clamped(r: Reader) -> DataFrame:
    return r.page("customer", None, 100_000)[0]


@query("total_count", "SELECT count(*) AS total_count FROM orders WHERE o_orderstatus = 'O'", "orders")
def _total(r: Reader) -> DataFrame:
    return r.total_count("orders", {"o_orderstatus": {"_eq": "O"}})


# filters

_filter("filter_eq_neq", "orders", {"o_orderstatus": {"_eq": "F"}, "o_orderpriority": {"_neq": "1-URGENT"}}, "o_orderstatus = 'F' AND o_orderpriority <> '1-URGENT'")
_filter("filter_range", "lineitem", {"l_quantity": {"_gte": 10, "_lt": 20}, "l_discount": {"_gt": 0.02, "_lte": 0.05}}, "l_quantity >= 10 AND l_quantity < 20 AND l_discount > 0.02::DOUBLE AND l_discount <= 0.05::DOUBLE")
_filter("filter_datetime", "orders", {"o_orderdate": {"_gte": "1995-01-01T00:00:00Z", "_lt": "1996-01-01"}}, "o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1996-01-01'")
_filter("filter_in_nin", "customer", {"c_mktsegment": {"_in": ["BUILDING", "MACHINERY"]}, "c_nationkey": {"_nin": [1, 2, 3]}}, "c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_nationkey NOT IN (1, 2, 3)")
_filter("filter_in_empty", "customer", {"c_custkey": {"_in": []}}, "1 = 0")
_filter("filter_nin_empty", "customer", {"c_custkey": {"_nin": []}}, "1 = 1")
_filter("filter_like", "part", {"p_name": {"_like": "%a%e%"}}, "p_name LIKE '%a%e%'")
_filter("filter_nlike", "part", {"p_type": {"_nlike": "%S%"}}, "p_type NOT LIKE '%S%'")
_filter("filter_regex", "part", {"p_name": {"_regex": "^[a-m].*(ing|olt)$"}}, "regexp_matches(p_name, '^[a-m].*(ing|olt)$')")
_filter("filter_nregex", "part", {"p_brand": {"_nregex": "[13]$"}}, "NOT regexp_matches(p_brand, '[13]$')")
_filter(
    "filter_bool_tree", "orders",
    {"_or": [{"o_orderstatus": {"_eq": "O"}, "o_totalprice": {"_gt": 50000}}, {"_and": [{"o_orderkey": {"_lt": 500}}, {"_not": {"o_orderpriority": {"_like": "1%"}}}]}]},
    "(o_orderstatus = 'O' AND o_totalprice > 50000) OR (o_orderkey < 500 AND NOT (o_orderpriority LIKE '1%'))",
)
_filter("filter_not", "orders", {"_not": {"o_custkey": {"_in": [1, 2, 3, 4, 5]}}}, "NOT (o_custkey IN (1, 2, 3, 4, 5))")
_filter("filter_not_empty", "nation", {"_not": {}}, "1 = 0")
_filter("filter_or_empty", "orders", {"_or": [], "o_orderkey": {"_lte": 50}}, "o_orderkey <= 50")
_filter("json_contains", "events", {"props": {"_contains": {"k": 1}}}, "json_contains(props, '{\"k\": 1}')")
_filter("json_eq", "events", {"props": {"_eq": {"k": 2}}}, "json_extract_string(props, '$.k') = '2' AND len(json_keys(props)) = 1")
_filter("json_has_key", "events", {"props": {"_has_key": "k"}}, "json_exists(props, '$.k')")


@query("filter_is_null", "SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality IS NULL", "documents", "labels")
def _is_null(r: Reader) -> DataFrame:
    from heddle.operators import predicates

    joined = r.select("documents").select("doc_id").join(r.select("labels").select("doc_id", "quality"), "doc_id", "left")
    return joined.where(predicates.where(r.fields("labels"), {"quality": {"_is_null": True}}))


# aggregates


@query(
    "aggregate_all",
    """SELECT count(*) AS "count", round(sum(l_quantity), 2) AS sum_l_quantity, round(avg(l_extendedprice), 4) AS avg_l_extendedprice,
    min(l_shipdate) AS min_l_shipdate, max(l_returnflag) AS max_l_returnflag, sum(l_linenumber)::BIGINT AS sum_l_linenumber FROM lineitem""",
    "lineitem",
)
def _aggregate_all(r: Reader) -> DataFrame:
    df = r.aggregate("lineitem", [("sum", "l_quantity"), ("avg", "l_extendedprice"), ("min", "l_shipdate"), ("max", "l_returnflag"), ("sum", "l_linenumber")])
    return df.withColumns({
        "sum_l_quantity": F.round("sum_l_quantity", 2), "avg_l_extendedprice": F.round("avg_l_extendedprice", 4), "sum_l_linenumber": F.col("sum_l_linenumber").cast("long"),
    })


@query(
    "aggregate_filtered",
    """SELECT count(*) AS "count", round(sum(o_totalprice), 2) AS sum_o_totalprice, max(o_orderdate) AS max_o_orderdate, min(o_orderpriority) AS min_o_orderpriority
    FROM orders WHERE o_orderstatus = 'P' AND o_totalprice >= 20000""",
    "orders",
)
def _aggregate_filtered(r: Reader) -> DataFrame:
    df = r.aggregate("orders", [("sum", "o_totalprice"), ("max", "o_orderdate"), ("min", "o_orderpriority")], {"o_orderstatus": {"_eq": "P"}, "o_totalprice": {"_gte": 20000}})
    return df.withColumn("sum_o_totalprice", F.round("sum_o_totalprice", 2))


@query("aggregate_empty", 'SELECT count(*) AS "count", sum(o_totalprice) AS sum_o_totalprice, max(o_orderkey) AS max_o_orderkey FROM orders WHERE o_orderkey < 0', "orders")
def _aggregate_empty(r: Reader) -> DataFrame:
    return r.aggregate("orders", [("sum", "o_totalprice"), ("max", "o_orderkey")], {"o_orderkey": {"_lt": 0}})


# relations; nested rows are flattened, as arrays are not compared


def _leaves(r: Reader, table: str, *names: str) -> list[Leaf]:
    return [Leaf(n, r.fields(table)[n]) for n in names]


def _nested(r: Reader, table: str, key: str, branch: Branch, where: dict | None = None) -> DataFrame:
    """Key and the expanded branch of all rows of a table."""
    return r.expand(r.rows(table, where), branch, "related", None).select(key, "related")


@query("rel_to_one", "SELECT o_orderkey, c_name, c_mktsegment FROM orders LEFT JOIN customer ON o_custkey = c_custkey", "orders", "customer")
def _to_one(r: Reader) -> DataFrame:
    df = _nested(r, "orders", "o_orderkey", Branch("customer", r.relation("orders", "customer"), _leaves(r, "customer", "c_name", "c_mktsegment")))
    return df.select("o_orderkey", F.col("related.f0").alias("c_name"), F.col("related.f1").alias("c_mktsegment"))


@query("rel_to_one_two_hop", "SELECT o_orderkey, c_name, n_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey", "orders", "customer", "nation")
def _two_hop(r: Reader) -> DataFrame:
    nation = Branch("nation", r.relation("customer", "nation"), _leaves(r, "nation", "n_name"))
    df = _nested(r, "orders", "o_orderkey", Branch("customer", r.relation("orders", "customer"), [*_leaves(r, "customer", "c_name"), nation]))
    return df.select("o_orderkey", F.col("related.f0").alias("c_name"), F.col("related.f1.f0").alias("n_name"))


def _many(r: Reader, table: str, key: str, name: str, columns: list[str], **args: Any) -> DataFrame:
    relation = r.relation(table, name)
    df = _nested(r, table, key, Branch(name, relation, _leaves(r, relation.target, *columns), args))
    flat = df.select(key, F.posexplode_outer("related").alias("pos", "item"))
    return flat.select(key, (F.col("pos") + 1).cast("long").alias("rn"), *(F.col(f"item.f{i}").alias(c) for i, c in enumerate(columns)))


_ORDERED = """SELECT c_custkey, rn, o_orderkey, o_totalprice FROM customer LEFT JOIN (
    SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY {order}) - {offset} AS rn FROM orders WHERE {where}
    ) ON c_custkey = o_custkey AND rn BETWEEN 1 AND {limit}"""


@query("rel_to_many_limited", _ORDERED.format(order="o_orderkey", offset=0, limit=3, where="1 = 1"), "customer", "orders")
def _to_many(r: Reader) -> DataFrame:
    return _many(r, "customer", "c_custkey", "orders", ["o_orderkey", "o_totalprice"], limit=3)


@query("rel_to_many_ordered_offset", _ORDERED.format(order="o_totalprice DESC, o_orderkey", offset=2, limit=4, where="1 = 1"), "customer", "orders")
def _to_many_offset(r: Reader) -> DataFrame:
    return _many(r, "customer", "c_custkey", "orders", ["o_orderkey", "o_totalprice"], limit=4, offset=2, order_by=[{"o_totalprice": "desc"}])


@query("rel_to_many_filtered", _ORDERED.format(order="o_orderdate, o_orderkey", offset=0, limit=25, where="o_orderstatus = 'F' AND o_totalprice > 10000"), "customer", "orders")
def _to_many_filtered(r: Reader) -> DataFrame:
    return _many(r, "customer", "c_custkey", "orders", ["o_orderkey", "o_totalprice"], where={"o_orderstatus": {"_eq": "F"}, "o_totalprice": {"_gt": 10000}}, order_by={"o_orderdate": "asc"})


@query(
    "rel_to_many_empty_parents",
    """SELECT d.doc_id, CASE WHEN l.doc_id IS NOT NULL THEN 1 END::BIGINT AS rn, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    "documents", "labels",
)
def _empty_parents(r: Reader) -> DataFrame:
    return _many(r, "documents", "doc_id", "labels", ["quality", "toxic"])


@query("rel_to_many_limit_zero", "SELECT c_custkey, 0::BIGINT AS n FROM customer", "customer", "orders")
def _limit_zero(r: Reader) -> DataFrame:
    df = _nested(r, "customer", "c_custkey", Branch("orders", r.relation("customer", "orders"), _leaves(r, "orders", "o_orderkey"), {"limit": 0}))
    return df.select("c_custkey", F.size("related").cast("long").alias("n"))


@query(
    "rel_three_level",
    """SELECT r_name, n_name, c_custkey, c_rn FROM region JOIN (
      SELECT n_regionkey, n_nationkey, n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS n_rn FROM nation) ON r_regionkey = n_regionkey AND n_rn <= 3
    JOIN (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS c_rn FROM customer) ON n_nationkey = c_nationkey AND c_rn <= 5""",
    "region", "nation", "customer",
)
def _three_level(r: Reader) -> DataFrame:
    customers = Branch("customer", r.relation("nation", "customer"), _leaves(r, "customer", "c_custkey"), {"limit": 5, "order_by": [{"c_acctbal": "desc"}]})
    nations = Branch("nation", r.relation("region", "nation"), [*_leaves(r, "nation", "n_name"), customers], {"limit": 3})
    df = _nested(r, "region", "r_name", nations).select("r_name", F.explode("related").alias("n"))
    return df.select("r_name", F.col("n.f0").alias("n_name"), F.posexplode("n.f1").alias("pos", "c")).select("r_name", "n_name", F.col("c.f0").alias("c_custkey"), (F.col("pos") + 1).cast("long").alias("c_rn"))


@query(
    "connection_nested",
    """SELECT o_orderkey, c_name, rn, l_partkey FROM (SELECT * FROM orders WHERE o_orderkey > 50 ORDER BY o_orderkey LIMIT 21) LEFT JOIN customer ON o_custkey = c_custkey
    LEFT JOIN (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_orderkey, l_partkey, l_suppkey, l_linenumber) AS rn FROM lineitem) ON l_orderkey = o_orderkey AND rn <= 2""",
    "orders", "customer", "lineitem",
)
def _connection_nested(r: Reader) -> DataFrame:
    customer = Branch("customer", r.relation("orders", "customer"), _leaves(r, "customer", "c_name"))
    items = Branch("lineitem", r.relation("orders", "lineitem"), _leaves(r, "lineitem", "l_partkey"), {"limit": 2, "order_by": [{"l_extendedprice": "desc"}]})
    df, _ = r.connection("orders", [*_leaves(r, "orders", "o_orderkey"), customer, items], {"o_orderkey": {"_gt": 50}}, 20)
    flat = df.select(F.col("__node.f0").alias("o_orderkey"), F.col("__node.f1.f0").alias("c_name"), F.posexplode_outer("__node.f2").alias("pos", "item"))
    return flat.select("o_orderkey", "c_name", (F.col("pos") + 1).cast("long").alias("rn"), F.col("item.f0").alias("l_partkey"))


# vectors

_TO = [round(((i * 37) % 64 - 32) / 32, 4) for i in range(64)]
_LIST = "[" + ", ".join(f"{x}::DOUBLE" for x in _TO) + "]"
_DISTANCES = {
    "cosine": ("COSINE", "list_cosine_distance(embedding::DOUBLE[], {to})"),
    "l2": ("L2", "list_distance(embedding::DOUBLE[], {to})"),
    "l1": ("L1", "list_sum(list_transform(list_zip(embedding::DOUBLE[], {to}), lambda z: abs(z[1] - z[2])))"),
    "inner_product": ("INNER_PRODUCT", "list_negative_inner_product(embedding::DOUBLE[], {to})"),
}


def _nearest(name: str, metric: str, distance: str, where: dict | None, condition: str) -> None:
    sql = f"SELECT vec_id, label, round(distance, 6) AS distance FROM (SELECT vec_id, label, {distance.format(to=_LIST)} AS distance FROM embeddings WHERE {condition} ORDER BY distance, vec_id LIMIT 25)"

    @query(name, sql, "embeddings")
    def plan(r: Reader) -> DataFrame:
        return r.nearest("embeddings", "embedding", _TO, metric, None, where).select("vec_id", "label", F.round("distance", 6).alias("distance"))


for _name, (_metric, _distance) in _DISTANCES.items():
    _nearest(f"nearest_{_name}", _metric, _distance, None, "embedding IS NOT NULL")
_nearest("nearest_filtered", "COSINE", _DISTANCES["cosine"][1], {"label": {"_in": [1, 2]}}, "embedding IS NOT NULL AND label IN (1, 2)")


# access rules


def _role(**tables: Any) -> dict:
    return {"tables": tables}


@query("rbac_row_filter", "SELECT * FROM orders WHERE o_custkey = 7", "orders", rules=_role(orders={"select": {"allow": True, "filter": "o_custkey = :jwt.sub"}}), claims={"sub": 7.0})
def _row_filter(r: Reader) -> DataFrame:
    return r.select("orders")


@query(
    "rbac_claim_array", "SELECT * FROM customer WHERE c_nationkey IN (1, 4, 9) AND c_acctbal > 0", "customer",
    rules=_role(customer={"select": {"allow": True, "filter": "c_nationkey IN (:jwt.app.nations)"}}), claims={"app": {"nations": [1, 4, 9]}},
)
def _claim_array(r: Reader) -> DataFrame:
    return r.select("customer", {"c_acctbal": {"_gt": 0}})


@query("rbac_empty_array", "SELECT * FROM customer WHERE 1 = 0", "customer", rules=_role(customer={"select": {"allow": True, "filter": "c_nationkey IN (:jwt.nations)"}}), claims={"nations": []})
def _empty_array(r: Reader) -> DataFrame:
    return r.select("customer")


@query(
    "rbac_subquery_filter", "SELECT * FROM orders WHERE o_custkey = 3 OR o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')", "orders", "customer",
    rules=_role(orders={"select": {"allow": True, "filter": "o_custkey = :jwt.sub OR o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = :jwt.segment)"}}), claims={"sub": 3, "segment": "BUILDING"},
)
def _subquery(r: Reader) -> DataFrame:
    return r.select("orders")


@query("rbac_column_projection", "SELECT c_custkey, c_name FROM customer WHERE c_name LIKE '%1%'", "customer", rules=_role(customer={"select": {"allow": True, "columns": ["c_name", "c_custkey"]}}))
def _projection(r: Reader) -> DataFrame:
    return r.select("customer", {"c_name": {"_like": "%1%"}})


@query(
    "rbac_nested_filter",
    """SELECT c_custkey, rn, o_orderkey, o_totalprice FROM customer LEFT JOIN (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn
    FROM orders WHERE o_orderstatus = 'O') ON c_custkey = o_custkey AND rn <= 25""",
    "customer", "orders",
    rules=_role(customer={"select": True}, orders={"select": {"allow": True, "columns": ["o_orderkey", "o_totalprice"], "filter": "o_orderstatus = 'O'"}}),
)
def _nested_filter(r: Reader) -> DataFrame:
    return _many(r, "customer", "c_custkey", "orders", ["o_orderkey", "o_totalprice"])


@query("rbac_aggregate", 'SELECT count(*) AS "count", max(o_totalprice) AS max_o_totalprice FROM orders WHERE o_custkey < 50', "orders", rules=_role(orders={"select": {"allow": True, "filter": "o_custkey < :jwt.most"}}), claims={"most": 50})
def _rbac_aggregate(r: Reader) -> DataFrame:
    return r.aggregate("orders", [("max", "o_totalprice")])


# writes: the table after a write to a copy


def _written(name: str, sql: str, tables: tuple[str, ...], write: Callable[[Writer], Any], rules: dict | None = None, claims: dict | None = None) -> None:
    @query(name, sql, *tables, rules=rules, claims=claims)
    def plan(r: Reader) -> DataFrame:
        store = scratch_store(r.spark, r, list(tables), shared_folder(r.spark))
        r.tables = store
        write(Writer(r, store))
        return store(tables[0])


_written(
    "insert_rows", "SELECT * FROM region UNION ALL SELECT 90, 'ATLANTIS' UNION ALL SELECT 91, NULL", ("region",),
    lambda w: w.insert("region", [{"r_regionkey": 90, "r_name": "ATLANTIS"}, {"r_regionkey": 91}]),
)
_written(
    "update_where", "SELECT p_partkey, p_name, p_brand, p_type, CASE WHEN p_size > 25 AND p_name LIKE '%a%' THEN 99 ELSE p_size END AS p_size, p_retailprice FROM part", ("part",),
    lambda w: w.update("part", {"p_size": {"_gt": 25}, "p_name": {"_like": "%a%"}}, {"p_size": 99}),
)
_written(
    "update_preset", "SELECT n_nationkey, CASE WHEN n_regionkey = 2 AND n_nationkey < 15 THEN 'forced' ELSE n_name END AS n_name, n_regionkey FROM nation", ("nation",),
    lambda w: w.update("nation", {"n_nationkey": {"_lt": 15}}, {}),
    _role(nation={"select": True, "update": {"allow": True, "filter": "n_regionkey = :jwt.region", "presets": {"n_name": "forced"}}}), {"region": 2},
)
_written("delete_where", "SELECT * FROM part WHERE NOT coalesce(p_brand LIKE '%1%' OR p_size < 5, false)", ("part",), lambda w: w.delete("part", {"_or": [{"p_brand": {"_like": "%1%"}}, {"p_size": {"_lt": 5}}]}))


_written("insert_one", "SELECT * FROM nation UNION ALL SELECT 70, 'NOWHERE', 3", ("nation", "region"), lambda w: w.insert_one("nation", {"n_nationkey": 70, "n_name": "NOWHERE", "n_regionkey": 3}))
_written("update_by_pk", "SELECT r_regionkey, CASE WHEN r_regionkey = 1 THEN 'NEW' ELSE r_name END AS r_name FROM region", ("region",), lambda w: w.update("region", None, {"r_name": "NEW"}, {"r_regionkey": 1}))
_written("delete_by_pk", "SELECT * FROM region WHERE r_regionkey <> 2", ("region",), lambda w: w.delete("region", None, {"r_regionkey": 2}))


# documents: what a role's API answers, as rows


@query(
    "document_query",
    """SELECT '_role' AS field, 'role' AS value UNION ALL SELECT 'count', count(*)::VARCHAR FROM customer WHERE c_acctbal < 0
    UNION ALL SELECT 'orders ' || o_orderkey, c_name FROM (SELECT * FROM orders ORDER BY o_orderkey LIMIT 5) JOIN customer ON o_custkey = c_custkey""",
    "orders", "customer",
)
def _document(r: Reader) -> DataFrame:
    text = """query ($n: Int!) { _role customer_aggregate(where: {c_acctbal: {_lt: 0}}) { count } orders_connection(first: $n) { nodes { ...O } } }
      fragment O on orders { o_orderkey customer { c_name } }"""
    data = Executor(r).execute(text, {"n": 5})["data"]
    nodes = [(f"orders {n['o_orderkey']}", n["customer"]["c_name"]) for n in data["orders_connection"]["nodes"]]
    return r.spark.createDataFrame([("_role", data["_role"]), ("count", str(data["customer_aggregate"]["count"])), *nodes], "field string, value string")


# relations whose keys are composite, null or of the same table, over views of the sample tables

_THREADS = """
tables:
  said: {primary_key: [conv_id, turn], foreign_keys: [{columns: [conv_id, after], references: said, ref_columns: [conv_id, turn]}]}
  heap: {primary_key: [id], foreign_keys: [{columns: [above_id], references: heap, ref_columns: [id]}]}
"""
_SAID = "SELECT conv_id, turn, role, CASE WHEN turn > 0 THEN turn - 1 END AS after FROM conversations"
_HEAP = "SELECT p_partkey AS id, p_size AS size, CASE WHEN p_partkey > 1 THEN p_partkey // 2 END AS above_id FROM part"


def _threads(spark: SparkSession, sf_dir: str) -> Reader:
    found = parquet_tables(spark, sf_dir)
    turn, key = F.col("turn"), F.col("p_partkey")
    made = {
        "said": found("conversations").select("conv_id", "turn", "role", F.when(turn > 0, turn - 1).alias("after")),
        "heap": found("part").select(key.alias("id"), F.col("p_size").alias("size"), F.when(key > 1, F.floor(key / 2)).cast("long").alias("above_id")),
    }
    catalog = load(_THREADS, {n: df.schema for n, df in made.items()})
    return Reader(spark, catalog, resolve("role", ALL, catalog), Identity("role", {}), made.__getitem__)


def _thread_query(name: str, sql: str):
    def register(plan: Callable[[Reader], DataFrame]) -> Callable[[Reader], DataFrame]:
        _queries[name] = lambda spark, sf_dir: plan(_threads(spark, sf_dir))
        _sql[name] = " ".join(f"WITH said AS ({_SAID}), heap AS ({_HEAP}) {sql}".split())
        return plan

    return register


@_thread_query("rel_composite_null", "SELECT s.conv_id, s.turn, a.role AS before FROM said s LEFT JOIN said a ON s.conv_id = a.conv_id AND s.after = a.turn")
def _composite(r: Reader) -> DataFrame:
    one = next(x for x in r.catalog.relations("said").values() if not x.many)
    df = r.node(r.rows("said"), "said", [*_leaves(r, "said", "conv_id", "turn"), Branch(one.name, one, _leaves(r, "said", "role"))], None)
    return df.select(F.col("__node.f0").alias("conv_id"), F.col("__node.f1").alias("turn"), F.col("__node.f2.f0").alias("before"))


@_thread_query(
    "rel_composite_page",
    """SELECT p.conv_id, p.turn, count(c.turn) AS replies, min(c.role) AS role FROM (SELECT * FROM said WHERE role <> 'nobody' ORDER BY conv_id, turn LIMIT 61) p
    LEFT JOIN said c ON c.conv_id = p.conv_id AND c.after = p.turn GROUP BY p.conv_id, p.turn""",
)
def _composite_page(r: Reader) -> DataFrame:
    many = next(x for x in r.catalog.relations("said").values() if x.many)
    df, _ = r.connection("said", [*_leaves(r, "said", "conv_id", "turn"), Branch(many.name, many, _leaves(r, "said", "role"))], {"role": {"_neq": "nobody"}}, 60)
    replies = F.col("__node.f2")
    return df.select(F.col("__node.f0").alias("conv_id"), F.col("__node.f1").alias("turn"), F.size(replies).cast("long").alias("replies"), F.array_min(F.transform(replies, lambda x: x["f0"])).alias("role"))


@_thread_query("rel_self", "SELECT h.id, u.size AS above, t.id AS top, (SELECT count(*) FROM heap b WHERE b.above_id = h.id) AS below FROM heap h LEFT JOIN heap u ON h.above_id = u.id LEFT JOIN heap t ON u.above_id = t.id")
def _self(r: Reader) -> DataFrame:
    one = next(x for x in r.catalog.relations("heap").values() if not x.many)
    many = next(x for x in r.catalog.relations("heap").values() if x.many)
    up = Branch(one.name, one, [*_leaves(r, "heap", "size"), Branch(one.name, one, _leaves(r, "heap", "id"))])
    df = r.node(r.rows("heap"), "heap", [*_leaves(r, "heap", "id"), up, Branch(many.name, many, _leaves(r, "heap", "id"))], None)
    n = F.col("__node")
    return df.select(n["f0"].alias("id"), n["f1"]["f0"].alias("above"), n["f1"]["f1"]["f0"].alias("top"), F.size(n["f2"]).cast("long").alias("below"))


@query("page_info", "SELECT (SELECT count(*) FROM customer WHERE c_acctbal > 0) > 7 AS has_next, 7 AS nodes, (SELECT count(*) FROM customer WHERE c_acctbal > 0) AS total, 6 AS after_nodes, (SELECT list(c_custkey ORDER BY c_custkey)[8] FROM customer WHERE c_acctbal > 0) AS after_first", "customer")
def _page_info(r: Reader) -> DataFrame:
    text = "query ($a: String, $n: Int) { customer_connection(first: $n, after: $a, where: {c_acctbal: {_gt: 0}}) { nodes { c_custkey } page_info { has_next_page end_cursor } total_count } }"
    page = Executor(r).execute(text, {"n": 7})["data"]["customer_connection"]
    after = Executor(r).execute(text, {"n": 6, "a": page["page_info"]["end_cursor"]})["data"]["customer_connection"]["nodes"]
    row = (page["page_info"]["has_next_page"], len(page["nodes"]), page["total_count"], len(after), after[0]["c_custkey"])
    return r.spark.createDataFrame([row], "has_next boolean, nodes int, total long, after_nodes int, after_first long")


@query("introspected_columns", "SELECT column_name AS name, CASE column_type WHEN 'VARCHAR' THEN 'String' WHEN 'DOUBLE' THEN 'Float' WHEN 'INTEGER' THEN 'Int' ELSE 'BigInt' END AS type FROM (DESCRIBE SELECT * FROM customer)", "customer")
def _introspected(r: Reader) -> DataFrame:
    found = Executor(r).execute('{ __type(name: "customer") { fields { name type { name ofType { name } } } } }')["data"]["__type"]["fields"]
    return r.spark.createDataFrame([(f["name"], f["type"]["name"] or f["type"]["ofType"]["name"]) for f in found], "name string, type string")


@query("hooks_around_writes", "SELECT * FROM (VALUES ('before_delete', 'region', NULL), ('after_delete', 'region', 2), ('refused', 'region', NULL), ('left', 'region', (SELECT count(*) - 2 FROM region))) t(event, name, n)", "region")
def _hooks(r: Reader) -> DataFrame:
    seen: list[tuple] = []
    registry = Registry()

    def note(event) -> None:
        seen.append((f"{'before' if event.affected is None else 'after'}_{event.operation}", event.table, event.affected))

    def refuse(event) -> None:
        raise InputError("refused")

    registry.mutation_hook("note", note)
    registry.mutation_hook("refuse", refuse)
    store = scratch_store(r.spark, r, ["region"], shared_folder(r.spark))
    wiring = {"*": {"before_delete": ["note"]}, "region": {"after_delete": ["note"], "after_update": ["refuse"]}}
    writer = Writer(r, store, registry, wiring)
    writer.delete("region", {"r_regionkey": {"_lt": 2}})
    try:
        writer.update("region", {}, {"r_name": "X"})
    except InputError as e:
        seen.append((str(e), "region", None))
    seen.append(("left", "region", store("region").where("r_name <> 'X'").count()))
    return r.spark.createDataFrame(seen, "event string, name string, n long")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)
