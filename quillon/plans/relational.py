"""Joins, set operations, upserts and hierarchies."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions.text import uuid5
from quillon.operators import relational as R
from quillon.operators.resolve import DNS, build_aliases, resolve, tree_paths
from quillon.plans.registry import Tables, query


@query("SELECT o_orderkey, c_name, n_name, r_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def star_left_join(t: Tables) -> DataFrame:
    joined = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"), "left").join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return joined.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"), "left").select("o_orderkey", "c_name", "n_name", "r_name")


@query("SELECT o_orderpriority, p_brand, count(*) AS n, count(DISTINCT o_orderkey) AS orders FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey LEFT JOIN part ON l_partkey = p_partkey GROUP BY ALL")
def pivot_join(t: Tables) -> DataFrame:
    """Orders, lines and parts are counted at each key before they meet, in as many tasks as there are lines for, so a task's memory does not grow with the input."""
    tasks = R.tasks_for(t.lineitem)
    part = t.part.groupBy("p_partkey", "p_brand").agg(F.count(F.lit(1)).alias("p"))
    lines = t.lineitem.where("l_orderkey is not null").select("l_orderkey", "l_partkey").repartition(tasks, "l_partkey")
    branded = lines.join(part.repartition(tasks, "p_partkey").hint("shuffle_hash"), F.col("l_partkey") == F.col("p_partkey"), "left").select("l_orderkey", "p_brand", F.coalesce("p", F.lit(1)).alias("p"))
    lines = branded.repartition(tasks, "l_orderkey").groupBy("l_orderkey", "p_brand").agg(F.sum("p").alias("lines"))
    orders = t.orders.select("o_orderkey", "o_orderpriority").repartition(tasks, "o_orderkey").groupBy("o_orderkey", "o_orderpriority").agg(F.count(F.lit(1)).alias("copies"))
    # one row an order key, priority and brand: distinct orders are a plain count
    joined = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return joined.groupBy("o_orderpriority", "p_brand").agg(F.sum(F.col("copies") * F.coalesce("lines", F.lit(1))).alias("n"), F.count("o_orderkey").alias("orders"))


@query("SELECT n_name, count(c_custkey) AS customers_fanned, count(s_suppkey) AS suppliers_fanned, count(DISTINCT c_custkey) AS customers, count(DISTINCT s_suppkey) AS suppliers FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_name")
def fanout_counts(t: Tables) -> DataFrame:
    """Two child tables multiply each other's counts. The products come from counts taken before the join, so the fan-out itself is never built."""
    c = t.customer.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("c"))
    s = t.supplier.groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("s"))
    own = t.nation.join(c, "n_nationkey", "left").join(s, "n_nationkey", "left").select("n_name", F.coalesce("c", F.lit(0)).alias("c"), F.coalesce("s", F.lit(0)).alias("s"))
    return own.groupBy("n_name").agg(
        F.sum(F.col("c") * F.greatest(F.col("s"), F.lit(1))).alias("customers_fanned"), F.sum(F.col("s") * F.greatest(F.col("c"), F.lit(1))).alias("suppliers_fanned"), F.sum("c").alias("customers"), F.sum("s").alias("suppliers")
    )


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def not_exists_one(t: Tables) -> DataFrame:
    return t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


@query("SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'R') AND NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = p_partkey)")
def not_exists_two(t: Tables) -> DataFrame:
    returned = t.lineitem.where("l_returnflag = 'R'")
    return t.part.join(returned, F.col("p_partkey") == F.col("l_partkey"), "left_anti").join(t.supplier, F.col("p_partkey") == F.col("s_suppkey"), "left_anti").select("p_partkey")


@query("SELECT count(*) AS orphans FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)")
def orphans_not_in(t: Tables) -> DataFrame:
    """NOT IN: no row passes if the list holds a null, and a null value never passes against a list with rows. An anti join with a null test keeps both sides shuffled by key."""
    listed = t.supplier.where("s_acctbal > 0").select("s_suppkey")
    state = listed.agg(F.count(F.lit(1)).alias("size"), F.count_if(F.col("s_suppkey").isNull()).alias("nulls"))  # one row
    rest = t.lineitem.join(listed, F.col("l_suppkey") == F.col("s_suppkey"), "left_anti").crossJoin(F.broadcast(state))
    return rest.agg(F.count_if((F.col("nulls") == 0) & (F.col("l_suppkey").isNotNull() | (F.col("size") == 0))).alias("orphans"))


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY (o_orderstatus = 'O') DESC, o_orderdate, o_orderkey) AS r FROM orders) WHERE r = 1")
def top1_lookup(t: Tables) -> DataFrame:
    return R.distinct_on(t.orders, ["o_custkey"], [(F.col("o_orderstatus") == "O").desc(), F.col("o_orderdate"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey")


@query("SELECT a.s_suppkey, b.p_partkey FROM (SELECT s_suppkey, row_number() OVER (ORDER BY s_name, s_suppkey) AS n FROM supplier) a JOIN (SELECT p_partkey, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS n FROM part) b USING (n)")
def positional_join(t: Tables) -> DataFrame:
    return R.positional_join(t.supplier.select("s_suppkey", "s_name"), [F.col("s_name"), F.col("s_suppkey")], t.part.select("p_partkey", "p_retailprice"), [F.desc("p_retailprice"), F.col("p_partkey")]).select("s_suppkey", "p_partkey")


_ALIASES = "a AS (SELECT n_nationkey::BIGINT AS id, lower(trim(n_name)) AS alias_norm FROM nation UNION SELECT n_nationkey::BIGINT, lower(trim(replace(n_name, 'UNITED ', ''))) FROM nation UNION SELECT n_nationkey::BIGINT, lower(substr(n_name, 1, 3)) FROM nation)"


def _nation_aliases(t: Tables) -> DataFrame:
    names = F.array(F.col("n_name"), F.replace("n_name", F.lit("UNITED "), F.lit("")), F.substring("n_name", 1, 3))
    return build_aliases(t.nation.select(F.col("n_nationkey").cast("long").alias("id"), names.alias("names")), "id", F.col("names"), [])


@query(f"WITH {_ALIASES} SELECT id, alias_norm FROM a")
def alias_build(t: Tables) -> DataFrame:
    return _nation_aliases(t).select("id", "alias_norm")


@query(
    f"""WITH {_ALIASES}, r AS (SELECT c_custkey AS ref, lower(CASE WHEN c_custkey % 4 = 0 THEN n_name WHEN c_custkey % 4 = 1 THEN 'the ' || n_name || ' state' WHEN c_custkey % 4 = 2 THEN substr(n_name, 1, 3) ELSE 'qqq' END) AS norm FROM customer JOIN nation ON c_nationkey = n_nationkey),
e AS (SELECT ref, count(DISTINCT id) AS n, min(id) AS id FROM r LEFT JOIN a ON norm = alias_norm GROUP BY ref), p AS (SELECT ref, count(DISTINCT a.id) AS m, min(a.id) AS pid FROM r LEFT JOIN a ON contains(alias_norm, norm) OR contains(norm, alias_norm) GROUP BY ref)
SELECT ref, CASE WHEN n = 1 THEN id WHEN n = 0 AND m = 1 THEN pid END AS id, CASE WHEN n = 1 THEN 'exact' WHEN n > 1 OR m > 1 THEN 'ambiguous' WHEN m = 1 THEN 'partial' ELSE 'none' END AS status, (CASE WHEN n = 1 THEN 0.99 WHEN n = 0 AND m = 1 THEN 0.75 ELSE 0 END)::DOUBLE AS confidence FROM e JOIN p USING (ref)"""
)
def alias_resolve(t: Tables) -> DataFrame:
    kind = F.col("c_custkey") % 4
    name = F.when(kind == 0, F.col("n_name")).when(kind == 1, F.concat(F.lit("the "), "n_name", F.lit(" state"))).when(kind == 2, F.substring("n_name", 1, 3)).otherwise("qqq")
    refs = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("ref"), F.lower(name).alias("norm"))
    return resolve(refs, _nation_aliases(t).select("id", "alias_norm"), "ref", "norm", "id")


@query("SELECT upper(trim(source)) AS key, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1")
def dim_build(t: Tables) -> DataFrame:
    dim = R.build_dimension(t.documents.select("source", "doc_id"), F.trim("source"), [F.col("doc_id")]).select("key", F.col("doc_id").alias("first_id"))
    return t.documents.groupBy(F.upper(F.trim("source")).alias("key")).agg(F.count(F.lit(1)).alias("n")).join(dim, "key").select("key", "n", "first_id")


_FIVE = [("orders", "o_orderkey"), ("customer", "c_custkey"), ("supplier", "s_suppkey"), ("part", "p_partkey"), ("documents", "doc_id")]


@query("SELECT src, count(*) AS n, min(ref) AS least, max(ref) AS largest FROM (" + " UNION ALL ".join(f"SELECT '{a}' AS src, {b}::BIGINT AS ref FROM {a}" for a, b in _FIVE) + ") GROUP BY src")
def corpus_union_all(t: Tables) -> DataFrame:
    parts = [getattr(t, a).select(F.lit(a).alias("src"), F.col(b).cast("long").alias("ref")) for a, b in _FIVE]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("src").agg(F.count(F.lit(1)).alias("n"), F.min("ref").alias("least"), F.max("ref").alias("largest"))


_OLD = "o AS (SELECT c_custkey, c_nationkey, c_acctbal FROM customer WHERE c_custkey % 3 <> 0)"
_NEW = "n AS (SELECT c_custkey, c_nationkey + 100 AS c_nationkey, c_acctbal * 2 AS c_acctbal FROM customer WHERE c_custkey % 2 = 0)"


def _halves(t: Tables) -> tuple[DataFrame, DataFrame]:
    rows = t.customer.select("c_custkey", "c_nationkey", "c_acctbal")
    new = rows.where("c_custkey % 2 = 0").select("c_custkey", (F.col("c_nationkey") + 100).alias("c_nationkey"), (F.col("c_acctbal") * 2).alias("c_acctbal"))
    return rows.where("c_custkey % 3 != 0"), new


@query(f"WITH {_OLD}, {_NEW} SELECT * FROM o UNION ALL SELECT * FROM n WHERE c_custkey NOT IN (SELECT c_custkey FROM o)")
def upsert_ignore(t: Tables) -> DataFrame:
    old, new = _halves(t)
    return R.upsert_ignore(old, new, ["c_custkey"], [F.col("c_acctbal")])


@query(f"WITH {_OLD}, {_NEW} SELECT * FROM n UNION ALL SELECT * FROM o WHERE c_custkey NOT IN (SELECT c_custkey FROM n)")
def upsert_update(t: Tables) -> DataFrame:
    old, new = _halves(t)
    return R.upsert_replace(old, new, ["c_custkey"], [F.desc("c_acctbal")])


@query(f"WITH {_OLD}, {_NEW} SELECT c_custkey, max(c_acctbal) AS c_acctbal, bool_or(c_nationkey > 110) AS flagged FROM (SELECT * FROM o UNION ALL SELECT * FROM n) GROUP BY c_custkey")
def upsert_greatest(t: Tables) -> DataFrame:
    old, new = _halves(t)
    return R.upsert_combine(old, new, ["c_custkey"], {"c_acctbal": F.max("c_acctbal"), "flagged": F.bool_or(F.col("c_nationkey") > 110)})


@query(f"WITH {_OLD}, {_NEW} SELECT o.c_custkey, coalesce(n.c_nationkey, o.c_nationkey) AS c_nationkey, CASE WHEN n.c_custkey IS NULL THEN o.c_acctbal END AS c_acctbal FROM o LEFT JOIN n USING (c_custkey)")
def update_invalidate(t: Tables) -> DataFrame:
    old, new = _halves(t)
    return R.update_from(old, new, ["c_custkey"], ["c_nationkey"], invalidate=["c_acctbal"])


@query(f"WITH {_OLD}, {_NEW} SELECT * FROM o WHERE c_custkey NOT IN (SELECT c_custkey FROM n)")
def delete_rows(t: Tables) -> DataFrame:
    old, new = _halves(t)
    return R.delete_keys(old, new, ["c_custkey"])


@query(
    "WITH RECURSIVE n AS (SELECT 'r' || r_regionkey AS id, NULL AS up, r_name AS name FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, s_name FROM supplier), "
    "p AS (SELECT id, 0 AS depth, name AS path FROM n WHERE up IS NULL UNION ALL SELECT n.id, depth + 1, path || ' > ' || name FROM n JOIN p ON n.up = p.id) SELECT id, depth, path FROM p",
    name="tree_paths",
)
def tree_paths_all(t: Tables) -> DataFrame:
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    nodes = t.region.select(key("r", "r_regionkey").alias("id"), F.lit(None).cast("string").alias("up"), F.col("r_name").alias("name"))
    nodes = nodes.union(t.nation.select(key("n", "n_nationkey"), key("r", "n_regionkey"), "n_name")).union(t.supplier.select(key("s", "s_suppkey"), key("n", "s_nationkey"), "s_name"))
    return tree_paths(nodes, "id", "up", "name")


@query(
    "SELECT n_nationkey, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || printf('%02x', (('0x' || substr(h, 17, 2))::INT & 63) | 128) || substr(h, 19, 2) || '-' || substr(h, 21, 12) AS id FROM "
    f"(SELECT n_nationkey, sha1(unhex('{DNS.replace('-', '')}') || ('nation|' || n_name)::BLOB) AS h FROM nation)"
)
def uuid5_ids(t: Tables) -> DataFrame:
    return t.nation.select("n_nationkey", uuid5(DNS, F.lit("nation"), F.col("n_name")).alias("id"))


@query("SELECT l_suppkey, count(*) AS n FROM lineitem WHERE EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus = 'F') GROUP BY l_suppkey")
def semi_join(t: Tables) -> DataFrame:
    return t.lineitem.join(t.orders.where("o_orderstatus = 'F'"), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey, o_orderdate::DATE::VARCHAR AS day, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS FIRST, o_orderkey ASC NULLS LAST LIMIT 50")
def multi_key_order(t: Tables) -> DataFrame:
    return t.orders.orderBy(F.desc_nulls_first("o_totalprice"), F.asc_nulls_last("o_orderkey")).limit(50).select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), "o_totalprice")
