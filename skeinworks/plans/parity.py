"""Registered queries of the dataframe operators over the driver's tables, with their SQL."""

from __future__ import annotations

import math
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinworks.functions import calendars, hashes, scalars, vectors
from skeinworks.functions.curves import curve_rows, register_curve
from skeinworks.operators import columns, grouping, lookup, reshape, rows
from skeinworks.operators.rows import ROW
from skeinworks.session import fits_broadcast, read_table, shared_folder
from skeinworks.sources import records, text

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return put


def _orders(spark: SparkSession, d: str) -> DataFrame:
    """orders, whose key counts the rows."""
    return rows.numbered_by(read_table(spark, d, "orders"), "o_orderkey")


def _by(spark: SparkSession, d: str, table: str, key: str) -> DataFrame:
    return rows.with_row(read_table(spark, d, table), key)


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"


_DAYS = "days AS (SELECT CAST(unnest(generate_series(min(CAST(o_orderdate AS TIMESTAMP)), max(CAST(o_orderdate AS TIMESTAMP)), INTERVAL 1 DAY)) AS DATE) AS day FROM orders)"


@query(f"""WITH {_DAYS} SELECT day, {", ".join(f"round(coalesce(sum(CASE WHEN o_orderstatus = '{s}' THEN o_totalprice END), 0), 2) AS price_{s}" for s in "FOP")}
    FROM days LEFT JOIN orders ON CAST(o_orderdate AS DATE) = day GROUP BY day""")
def flagship_resample_pivot_sum(spark, d):
    narrow = read_table(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("day"), "o_orderstatus", "o_totalprice")
    done = reshape.pivot_sum(reshape.resample_daily(narrow, "day"), ["day"], ["o_orderstatus"], ["o_totalprice"], drop_null_key=True)
    return done.select("day", *[F.round(F.col(f"`[o_orderstatus={s}]:o_totalprice`"), 2).alias(f"price_{s}") for s in "FOP" if f"[o_orderstatus={s}]:o_totalprice" in done.columns])


@query("SELECT n_name, n_nationkey FROM nation")
def select_reorder(spark, d):
    return columns.select_at(read_table(spark, d, "nation"), 1, 0)


@query("SELECT n_name, n_regionkey FROM nation")
def select_by_name(spark, d):
    return columns.select_named(read_table(spark, d, "nation"), "n_name", "n_regionkey")


@query("SELECT r_name, r_regionkey, r_name AS r_name_1 FROM region")
def select_repeat(spark, d):
    return columns.select_at(read_table(spark, d, "region"), 1, 0, 1)


@query("SELECT n_nationkey, n_regionkey FROM nation")
def drop_negated(spark, d):
    return columns.drop_named(read_table(spark, d, "nation"), "n_name")


@query("SELECT n_name, n_regionkey FROM nation")
def slice_columns(spark, d):
    return columns.slice_columns(read_table(spark, d, "nation"), 1, 2)


@query("SELECT n_regionkey, n_name, n_nationkey FROM nation")
def mirror_columns(spark, d):
    return columns.mirror(read_table(spark, d, "nation"))


@query("SELECT upper(CAST(n_nationkey AS VARCHAR)) AS n_nationkey, upper(n_name) AS n_name, upper(CAST(n_regionkey AS VARCHAR)) AS n_regionkey FROM nation")
def map_cells(spark, d):
    return columns.map_cells(read_table(spark, d, "nation"), lambda c: F.upper(c.cast("string")))


@query("SELECT 2 * r_regionkey + 1 AS r_regionkey FROM region")
def map_cells_python(spark, d):
    return columns.map_cells_python(read_table(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("r_regionkey")), lambda v: None if v is None else 2 * v + 1, "bigint")


@query("SELECT p_partkey, CASE WHEN p_size < 10 OR p_size > 40 THEN 0 ELSE p_retailprice END AS price FROM part")
def fill_na(spark, d):
    price = F.when(F.col("p_size") < 10, F.lit(None)).when(F.col("p_size") > 45, float("nan")).when(F.col("p_size") > 40, float("inf")).otherwise(F.col("p_retailprice"))
    return columns.fill_missing(read_table(spark, d, "part").select("p_partkey", price.alias("price")), 0.0)


@query("SELECT CAST(NULL AS VARCHAR) AS n_nationkey, n_name, CAST(NULL AS VARCHAR) AS n_regionkey FROM nation")
def only_type(spark, d):
    return columns.only_type(read_table(spark, d, "nation"), "string")


@query("SELECT CAST(n_nationkey AS VARCHAR) || ',' || n_name || ',' || CAST(n_regionkey AS VARCHAR) AS cells FROM nation")
def values_only(spark, d):
    return columns.values_only(read_table(spark, d, "nation")).select(F.array_join("cells", ",").alias("cells"))


@query("""SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS row, unnest([0, 1, 2, 3]) AS pos, unnest([NULL, NULL, NULL, s_acctbal]) AS value FROM supplier""")
def flatten_cells(spark, d):
    return columns.flatten_cells(_by(spark, d, "supplier", "s_suppkey"), "double").select(F.col(ROW).alias("row"), "pos", "value")


@query("SELECT n_nationkey AS nation_id, n_name, TRY_CAST(n_name AS INTEGER) AS other FROM nation")
def relabel(spark, d):
    base = read_table(spark, d, "nation").select("n_nationkey", "n_name", F.col("n_name").alias("x"))
    return columns.relabel(base, {"n_nationkey": "nation_id", "x": "other"}, {"x": "int"})


@query("SELECT p_partkey, p_size || ',' || p_partkey AS picked FROM part")
def gather_map(spark, d):
    p = read_table(spark, d, "part")
    m = F.create_map(F.lit("size"), F.col("p_size").cast("long"), F.lit("key"), F.col("p_partkey"))
    return p.select("p_partkey", F.array_join(columns.gather_map(m, F.array(F.lit("size"), F.lit("key"))).cast("array<string>"), ",").alias("picked"))


@query("SELECT n_nationkey, n_name FROM (SELECT *, row_number() OVER (ORDER BY n_nationkey) - 1 AS r FROM nation) WHERE r = 7")
def row_at(spark, d):
    return rows.row_at(_by(spark, d, "nation", "n_nationkey"), 7).select("n_nationkey", "n_name")


@query("SELECT o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS r FROM orders) WHERE r >= 100 AND r < 250")
def row_slice(spark, d):
    return rows.slice_rows(_orders(spark, d), 100, 250).select("o_orderkey", "o_totalprice")


@query("SELECT x.pos, o_orderkey FROM (VALUES (0, 5), (1, 3), (2, 5), (3, 1000)) x(pos, r) JOIN (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS r FROM orders) o USING (r)")
def row_gather(spark, d):
    return rows.pick_rows(_orders(spark, d), [5, 3, 5, 1000]).select(F.col(ROW).alias("pos"), "o_orderkey")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey DESC) - 1 AS row FROM orders")
def row_reverse(spark, d):
    return rows.reverse_rows(_orders(spark, d)).select("o_orderkey", F.col(ROW).alias("row"))


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 20")
def row_first(spark, d):
    return rows.first_rows(_orders(spark, d), 20).select("o_orderkey")


@query("SELECT arg_min(o_orderpriority, o_orderkey) AS first, arg_max(o_orderpriority, o_orderkey) AS last FROM orders")
def first_last(spark, d):
    return rows.first_last(_orders(spark, d), "o_orderpriority")


@query("SELECT o_orderkey FROM orders WHERE o_totalprice > 100000 AND o_orderstatus = 'F'")
def row_filter(spark, d):
    return read_table(spark, d, "orders").where("o_totalprice > 100000 AND o_orderstatus = 'F'").select("o_orderkey")


_N = "SELECT *, row_number() OVER (ORDER BY {k}) - 1 AS r FROM {t}"


@query(f"SELECT s_name, c_name FROM ({_N.format(k='s_suppkey', t='supplier')}) LEFT JOIN ({_N.format(k='c_custkey', t='customer')}) USING (r)")
def positional_join(spark, d):
    s, c = _by(spark, d, "supplier", "s_suppkey").select(ROW, "s_name"), _by(spark, d, "customer", "c_custkey").select(ROW, "c_name")
    return rows.positional_join(s, c).drop(ROW)


@query(f"SELECT r_name, n_name FROM ({_N.format(k='r_regionkey', t='region')}) JOIN ({_N.format(k='n_nationkey', t='nation')}) USING (r)")
def zip_shorter(spark, d):
    return rows.zip_rows(_by(spark, d, "region", "r_regionkey").select(ROW, "r_name"), _by(spark, d, "nation", "n_nationkey").select(ROW, "n_name")).drop(ROW)


@query("""SELECT row_number() OVER (ORDER BY src, k) - 1 AS row, name FROM
    (SELECT 0 AS src, c_custkey AS k, c_name AS name FROM customer UNION ALL SELECT 1, s_suppkey, s_name FROM supplier)""")
def concat_rows(spark, d):
    c, s = _by(spark, d, "customer", "c_custkey").select(F.col("c_name").alias("name"), ROW), _by(spark, d, "supplier", "s_suppkey").select("s_name", ROW)
    return rows.concat_rows(c, s).select(F.col(ROW).alias("row"), "name")


@query("SELECT user_id, count(*) AS n, string_agg(event_type, ',' ORDER BY event_id) AS types FROM events GROUP BY user_id")
def group_nested(spark, d):
    e = rows.numbered_by(read_table(spark, d, "events").select("event_id", "user_id", "event_type"), "event_id").drop("event_id")
    return grouping.group_nested(e, "user_id").select("user_id", F.size("event_type").alias("n"), F.array_join("event_type", ",").alias("types"))


@query("SELECT o_orderstatus, string_agg(o_custkey, ',' ORDER BY o_orderkey) AS customers FROM orders GROUP BY 1")
def group_like(spark, d):
    o = _orders(spark, d)
    return grouping.group_like(o.select("o_orderstatus", "o_custkey", ROW), o.select("o_orderstatus")).select("o_orderstatus", F.array_join("o_custkey", ",").alias("customers"))


for _name, _sql in (("sum", "round(sum({c}), 2)"), ("min", "min({c})"), ("max", "max({c})")):

    def _reduced(spark, d, how=_name):
        base = read_table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice")
        done = grouping.group_reduce(base, ["l_returnflag", "l_linestatus"], how)
        return done.withColumn("l_extendedprice", F.round("l_extendedprice", 2)) if how == "sum" else done

    QUERIES[f"group_reduce_{_name}"] = _reduced
    ORACLE[f"group_reduce_{_name}"] = "SELECT l_returnflag, l_linestatus, " + ", ".join(_sql.format(c=c) + f" AS {c}" for c in ("l_quantity", "l_extendedprice")) + " FROM lineitem GROUP BY ALL"


@query("SELECT o_orderpriority, CAST(sum(o_custkey) AS BIGINT) AS o_custkey FROM orders GROUP BY 1")
def group_fold(spark, d):
    return grouping.group_reduce(_orders(spark, d).select("o_orderpriority", "o_custkey", ROW), ["o_orderpriority"], grouping.null_safe_sum)


@query("SELECT o_orderstatus, CAST(sum(o_custkey) AS BIGINT) AS o_custkey, max(o_totalprice) AS o_totalprice FROM orders GROUP BY 1")
def reduce_nested(spark, d):
    nested = grouping.group_nested(_orders(spark, d).select("o_orderstatus", "o_custkey", "o_totalprice", ROW), "o_orderstatus")
    return grouping.reduce_nested(nested.select("o_orderstatus", "o_custkey"), lambda a, x: a + x).join(grouping.reduce_nested(nested.select("o_orderstatus", "o_totalprice"), lambda a, x: F.greatest(a, x)), "o_orderstatus")


@query("SELECT n_regionkey, string_agg(n_name, '' ORDER BY n_nationkey) AS names FROM nation GROUP BY 1")
def text_sum(spark, d):
    return _by(spark, d, "nation", "n_nationkey").groupBy("n_regionkey").agg(grouping.text_sum(F.col("n_name")).alias("names"))


@query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 4) AS total FROM embeddings")
def vector_sum(spark, d):
    return read_table(spark, d, "embeddings").select("vec_id", F.round(grouping.vector_sum(F.col("embedding")), 4).alias("total"))


@query("SELECT o_custkey, string_agg(o_orderkey, ',' ORDER BY o_orderkey) AS rows FROM orders GROUP BY 1")
def row_index(spark, d):
    return grouping.row_index(_orders(spark, d), "o_custkey").withColumn("rows", F.array_join(F.col("rows").cast("array<string>"), ","))


@query("SELECT o_custkey, min(o_orderkey) AS first_row, max(o_orderkey) AS last_row, count(*) AS n_rows FROM orders GROUP BY 1")
def row_index_first_last(spark, d):
    return grouping.row_bounds(_orders(spark, d), "o_custkey")


@query("SELECT o_orderpriority, min(o_orderkey) AS row FROM orders GROUP BY 1")
def distinct_first_seen(spark, d):
    return grouping.distinct_first_seen(_orders(spark, d), "o_orderpriority").select("o_orderpriority", F.col(ROW).alias("row"))


@query("SELECT o_orderkey, dense_rank() OVER (ORDER BY f) - 1 AS cluster FROM (SELECT *, min(o_orderkey) OVER (PARTITION BY o_orderstatus) AS f FROM orders)")
def cluster_ordinal(spark, d):
    return grouping.cluster_ordinal(_orders(spark, d), "o_orderstatus").select("o_orderkey", "cluster")


@query("""SELECT o_orderkey, r_name AS o_orderstatus FROM (SELECT o_orderkey, dense_rank() OVER (ORDER BY f) - 1 AS r FROM (SELECT *, min(o_orderkey) OVER (PARTITION BY o_orderstatus) AS f FROM orders))
    JOIN (SELECT r_name, row_number() OVER (ORDER BY r_regionkey) - 1 AS r FROM region) USING (r)""")
def cluster_labels(spark, d):
    return grouping.cluster_labels(_orders(spark, d), "o_orderstatus", _by(spark, d, "region", "r_regionkey"), "r_name").select("o_orderkey", "o_orderstatus")


@query("SELECT min(p_size) AS p_size_min, max(p_size) AS p_size_max, min(p_retailprice) AS p_retailprice_min, max(p_retailprice) AS p_retailprice_max FROM part")
def min_max_range(spark, d):
    return grouping.value_range(read_table(spark, d, "part"), "p_size", "p_retailprice")


@query("SELECT o_orderkey, " + ", ".join(f"CASE WHEN o_orderstatus = '{s}' THEN o_totalprice END AS price_{s}" for s in "FOP") + " FROM orders")
def pivot_sparse(spark, d):
    done = reshape.pivot_sparse(read_table(spark, d, "orders"), ["o_orderkey"], ["o_orderstatus"], ["o_totalprice"])
    return done.select("o_orderkey", *[F.col(f"`[o_orderstatus={s}]:o_totalprice`").alias(f"price_{s}") for s in "FOP"])


_FLAGS = [(f, s) for f in "ANR" for s in "FO"]


@query(
    "SELECT l_suppkey, "
    + ", ".join(f"round(coalesce(sum(CASE WHEN l_returnflag = '{f}' AND l_linestatus = '{s}' THEN {c} END), 0), 2) AS {n}_{f}{s}" for f, s in _FLAGS for c, n in (("l_quantity", "qty"), ("l_extendedprice", "price")))
    + " FROM lineitem GROUP BY 1"
)
def pivot_multi_axis(spark, d):
    done = reshape.pivot_sum(read_table(spark, d, "lineitem"), ["l_suppkey"], ["l_returnflag", "l_linestatus"], ["l_quantity", "l_extendedprice"])
    label = lambda f, s, c: f"[l_returnflag={f},l_linestatus={s}]:{c}"
    cell = lambda f, s, c: F.round(F.col(f"`{label(f, s, c)}`"), 2) if label(f, s, c) in done.columns else F.lit(0.0)
    return done.select("l_suppkey", *[cell(f, s, c).alias(f"{n}_{f}{s}") for f, s in _FLAGS for c, n in (("l_quantity", "qty"), ("l_extendedprice", "price"))])


@query(f"""WITH {_DAYS} SELECT CAST(o_orderdate AS DATE) AS o_orderdate, o_orderkey, o_orderstatus FROM orders
    UNION ALL SELECT day, NULL, NULL FROM days WHERE day NOT IN (SELECT CAST(o_orderdate AS DATE) FROM orders)""")
def resample_daily(spark, d):
    return reshape.resample_daily(read_table(spark, d, "orders").select("o_orderdate", "o_orderkey", "o_orderstatus"), "o_orderdate")


@query("SELECT p_partkey, row_number() OVER (ORDER BY CAST(p_size AS VARCHAR), p_partkey) - 1 AS row FROM part")
def ordered_text(spark, d):
    return rows.ordered_text(_by(spark, d, "part", "p_partkey"), "p_size").select("p_partkey", F.col(ROW).alias("row"))


@query("SELECT p_partkey, row_number() OVER (ORDER BY p_size, p_partkey) - 1 AS row FROM part")
def ordered_typed(spark, d):
    return rows.ordered(_by(spark, d, "part", "p_partkey"), "p_size").select("p_partkey", F.col(ROW).alias("row"))


@query("SELECT p_partkey, row_number() OVER (ORDER BY p_size DESC, p_partkey) - 1 AS row FROM part")
def ordered_descending(spark, d):
    return rows.ordered(_by(spark, d, "part", "p_partkey"), "p_size", ascending=False).select("p_partkey", F.col(ROW).alias("row"))


@query("SELECT o_custkey, max(o_orderkey) AS row FROM orders GROUP BY 1")
def key_map_last(spark, d):
    return lookup.last_row_by(_orders(spark, d), "o_custkey").select("o_custkey", F.col(ROW).alias("row"))


@query("SELECT o_custkey, min(o_orderkey) AS row FROM orders GROUP BY 1")
def key_map_first(spark, d):
    return lookup.first_row_by(_orders(spark, d), "o_custkey").select("o_custkey", F.col(ROW).alias("row"))


# MD4 of the names NATION_0 to NATION_24, and of the key lists [NATION_0] to [NATION_24].
_NAME_DIGESTS = (
    "d9791ea2295ee81ce7f4d146a1244067 82aba7f75af9e44b47b22b00a3acf53b 4f793253127c17bc6fac72331da6adab "
    "567e5b690d0d74e9c12e3809784d640f 8efb1f6b8efa5a787bdefb7105fb31e0 faf63cc048447eafd583ddda8ea6e107 "
    "37f5041cc2dfedc64e251a3d89b76d3f 0df889284c387d4b39e6e71a6876acf4 cd74f51de5ca32d23d60de4a0dd3023e "
    "0585d131904afff221caff7cc5e4ef3d ef36b246fa51c614aafcc19787b17c3e b042545866b856f059e498b4b9901738 "
    "a528707d7470076f4acbf93714486d1a 991652c618abf6e5ad9120ef79714aed 868bac6fb6a231c6ba4fd2e0de200f92 "
    "6b3e0ee9ca13d12037820730e77b1a3c 11a21e30fc3f042e91fff68e6b61441b 425270523c0e95fa5f3f480a62c3c5a0 "
    "631263cce32812db18b0afe01a8260b9 2dd5efb75b87c2e117987d81a4ad9b36 e5d211ad25c6249ca7c47e7d8336a6b2 "
    "84af376db79d3a4e9e656593e84d7213 66e2e11c57475c9c33b5c80c7669ddc8 3c16a86090d85f10b5422c1124aaf3d9 "
    "66545624fb32beee6481a9e6e858b640 "
).split()
_KEY_DIGESTS = (
    "59412dd8f116292402afc95a91c2ae99 dccd6868f1f8814bc4a3ea5142d277e6 040092626c2e96d835ca6b5d55a0cc33 "
    "052605125d052c56c7e9866dfd564c05 805c1fd502de2474364ba54404d80954 17bee638f4aab55e416121df4cfce4dc "
    "576e803e1fa069739535a795ecc8f1c6 fdab48353f89ed17d8abc615a6618d8c fe04c8eddc62e83216bf9040fbfb4027 "
    "08cf14a8108597c7295e4a6a77c60b48 b0074488cecb075ff9b3f90f58171c4a dfc293e6d138912d3a799c843ba23f68 "
    "d6c336c0ac00f276f828401e51ae9fbb cb5f70ce2439b3037798eb24d567239e bbc8764c198a284bade7b2f874c75536 "
    "fc7b3419fb1f2f2b12af06057efc22a0 4c5aca3f9fc1a217276773d62772e4ae da9dd29b3619b93a59e633220fe3db1e "
    "aba496a98ac84d9b2f89fedba61bfe57 24e3bb6f05afd6bd890959cd2dd3ceee a6f53595d4351232b1c9385d579b362f "
    "38465bb53a99e82a571f2241c3e8ae16 961947baf2d5ef5e1e6b598a7a03e8c9 375d4438db2c4a1cf1ca78403be97555 "
    "03612372cf8d5786d1b8a98adbb1414f "
).split()


def _digests(digests, column):
    return "SELECT * FROM (VALUES " + ", ".join(f"({f'{chr(39)}NATION_{i}{chr(39)}' if column == 'n_name' else f'CAST({i} AS BIGINT)'}, '{x}')" for i, x in enumerate(digests)) + f") t({column}, digest)"


@query(_digests(_KEY_DIGESTS, "row"))
def md4_key(spark, d):
    return lookup.digest_row_by(_by(spark, d, "nation", "n_nationkey"), "n_name").select("digest", F.col(ROW).alias("row"))


@query(_digests(_NAME_DIGESTS, "n_name"))
def md4_hex(spark, d):
    return read_table(spark, d, "nation").select("n_name", hashes.md4_hex(F.col("n_name")).alias("digest"))


@query("""WITH p AS (SELECT *, row_number() OVER (ORDER BY p_partkey) - 1 AS r FROM part)
    SELECT p_brand || '/' || p_type || '/' || p_size AS path, min(r) AS row FROM p WHERE p_size < 20 GROUP BY 1
    UNION ALL SELECT p_brand || '/' || p_type, min(r) FROM p GROUP BY p_brand, p_type HAVING min(p_size) >= 20""")
def trie_lookup(spark, d):
    """Paths of one, two and three keys, many of them the beginning of others: only the ends are found."""
    p = _by(spark, d, "part", "p_partkey")
    paths = [lookup.trie_paths(p, "p_brand"), lookup.trie_paths(p, "p_brand", "p_type"), lookup.trie_paths(p.where("p_size < 20"), "p_brand", "p_type", "p_size")]
    leaves = lookup.trie_leaves(paths[0].unionByName(paths[1]).unionByName(paths[2]))
    return leaves.select(F.array_join("path", "/").alias("path"), F.col(ROW).alias("row"))


@query("SELECT p_brand || '/' || p_type AS path, min(p_partkey) AS key FROM part WHERE p_brand = (SELECT min(p_brand) FROM part) GROUP BY 1")
def trie_prefix(spark, d):
    p = read_table(spark, d, "part")
    brand = p.agg(F.min("p_brand")).first()[0]
    found = lookup.trie_prefix(lookup.trie_paths(rows.numbered_by(p, "p_partkey"), "p_brand", "p_type"), [brand])
    return found.select(F.array_join("path", "/").alias("path"), F.col(ROW).alias("key"))


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
def bloom_semijoin(spark, d):
    big = read_table(spark, d, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return lookup.bloom_semi_join(read_table(spark, d, "customer"), big, "c_custkey").select("c_custkey")


@query("SELECT count(*) AS n_members, true AS all_found, true AS few_false FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def bloom_members(spark, d):
    """Every customer with an order is in the filter; of as many keys that nobody has, no more than the bound."""
    keys = read_table(spark, d, "orders").select("o_custkey")
    n = keys.select(F.approx_count_distinct("o_custkey")).first()[0] * 11 // 10
    bloom = lookup.bloom_filter(keys, "o_custkey", n)
    members = read_table(spark, d, "customer").join(keys.withColumnRenamed("o_custkey", "c_custkey"), "c_custkey", "left_semi")
    asked = members.select(bloom.may_contain(F.col("c_custkey")).alias("found"), bloom.may_contain(F.col("c_custkey") + 1_000_000_007).alias("wrong"))
    share = F.sum(F.col("wrong").cast("int")) / F.count(F.lit(1))
    return asked.agg(F.count(F.lit(1)).alias("n_members"), F.every("found").alias("all_found"), (share <= 1.1 * math.exp(-(math.log(2) ** 2) * 11) + 0.02).alias("few_false"))


@query("SELECT o_orderstatus, count(*) AS n, true AS few_false FROM orders GROUP BY 1")
def bloom_clusters(spark, d):
    """Members are in the filter of their cluster; keys that nobody has in hardly any."""
    o, bits = _orders(spark, d), 1 << 18
    blooms = lookup.cluster_blooms(o, "o_orderstatus", "o_custkey", bits=bits)
    side = blooms.select("o_orderstatus", "bloom")
    both = o.join(F.broadcast(side) if fits_broadcast(side, 200) else side, "o_orderstatus")
    found = lambda key: lookup.in_cluster_bloom(F.col("bloom"), key, bits=bits).cast("long")
    return both.groupBy("o_orderstatus").agg(F.sum(found(F.col("o_custkey"))).alias("n"), (F.avg(found(F.col("o_custkey") + 1_000_000_007)) < 0.02).alias("few_false"))


_MM = "(x - min(x) OVER ()) / (max(x) OVER () - min(x) OVER ())"


@query(f"SELECT p_partkey, round({_MM}, 6) AS scaled FROM (SELECT p_partkey, p_retailprice AS x FROM part)")
def normalize_double(spark, d):
    done = reshape.normalize(read_table(spark, d, "part").select("p_partkey", "p_retailprice"), "p_retailprice")
    return done.select("p_partkey", F.round(F.col("`normalized:p_retailprice`"), 6).alias("scaled"))


@query(f"SELECT p_partkey, round({_MM} / 2 * (max(x) OVER () - min(x) OVER ()) + min(x) OVER (), 4) AS p_retailprice FROM (SELECT p_partkey, p_retailprice AS x FROM part)")
def denormalize(spark, d):
    """Scaled values are halved before they are turned back, so the range of the column must come in."""
    scaled = reshape.normalize(read_table(spark, d, "part").select("p_partkey", "p_retailprice"), "p_retailprice")
    name = "normalized:p_retailprice"
    halved = scaled.select("p_partkey", (F.col(f"`{name}`") / 2).alias(name, metadata=scaled.schema[name].metadata))
    return reshape.denormalize(halved, "p_retailprice").select("p_partkey", F.round("p_retailprice", 4).alias("p_retailprice"))


_SEGMENTS = "AUTOMOBILE BUILDING FURNITURE HOUSEHOLD MACHINERY".split()


def _one_hot(spark, d, drop):
    done = reshape.one_hot(_by(spark, d, "customer", "c_custkey"), ["c_mktsegment"], drop)
    names = [c for c in done.columns if c != ROW]
    return done.select(F.col(ROW).alias("row"), *[F.col(f"`{c}`").alias(c.replace("c_mktsegment=", "is_").lower()) for c in names])


def _one_hot_sql(segments):
    return "SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS row, " + ", ".join(f"c_mktsegment = '{s}' AS is_{s.lower()}" for s in segments) + " FROM customer"


@query(_one_hot_sql(_SEGMENTS[1:]))
def one_hot_drop_first(spark, d):
    return _one_hot(spark, d, "first")


@query(_one_hot_sql(_SEGMENTS[:-1]))
def one_hot_drop_last(spark, d):
    return _one_hot(spark, d, "last")


@query(_one_hot_sql(_SEGMENTS))
def one_hot_keep_all(spark, d):
    return _one_hot(spark, d, "none")


@query("SELECT n_nationkey, coalesce(n_regionkey > 2, false) AS high FROM nation")
def packed_booleans(spark, d):
    n = read_table(spark, d, "nation").select("n_nationkey", F.when(F.col("n_regionkey") > 1, F.col("n_regionkey") > 2).alias("high"))
    return reshape.packed_booleans(n)


@query("SELECT pos - 1 AS pos, vec_id AS at, CAST(embedding[pos] AS DOUBLE) AS value FROM embeddings, generate_series(1, len(embedding)) g(pos)")
def transpose_long_all(spark, d):
    """Over all positions the data has."""
    e = rows.numbered_by(read_table(spark, d, "embeddings"), "vec_id")
    names = [f"e{i}" for i in range(e.agg(F.max(F.size("embedding"))).first()[0] or 0)]
    wide = e.select(ROW, *[F.get("embedding", F.lit(i)).cast("double").alias(n) for i, n in enumerate(names)])
    return reshape.transpose_cells(wide, names)


@query("SELECT p - 1 AS pos, string_agg(CAST(round(CAST(embedding[p] AS DOUBLE) * 1000) AS BIGINT), ',' ORDER BY vec_id) AS thousandths FROM embeddings, generate_series(1, len(embedding)) g(p) GROUP BY p")
def transpose_arrays(spark, d):
    e = rows.numbered_by(read_table(spark, d, "embeddings"), "vec_id")
    whole = e.withColumn("embedding", F.transform("embedding", lambda x: F.round(x.cast("double") * 1000).cast("long")))
    return reshape.transpose_arrays(whole, "embedding").select("pos", F.array_join("embedding", ",").alias("thousandths"))


@query("SELECT n_nationkey, least(r // 6, 3) AS part FROM (SELECT *, row_number() OVER (ORDER BY n_nationkey) - 1 AS r FROM nation)")
def split_n(spark, d):
    return rows.split_rows(_by(spark, d, "nation", "n_nationkey"), 4).select("n_nationkey", "part")


@query("""SELECT r // 2 AS pair, min(n_name ORDER BY r) AS first, max(n_name ORDER BY r) AS second FROM (SELECT 1 AS r, '' AS n_name) WHERE false GROUP BY 1
    UNION ALL SELECT r // 2, arg_min(n_name, r), arg_max(n_name, r) FROM (SELECT *, row_number() OVER (ORDER BY n_nationkey) - 1 AS r FROM nation) GROUP BY 1 HAVING count(*) = 2""")
def pair_chunks(spark, d):
    return rows.pair_chunks(_by(spark, d, "nation", "n_nationkey"), "n_name")


@query("SELECT i AS row, r_name FROM generate_series(0, 16) g(i) JOIN (SELECT r_name, row_number() OVER (ORDER BY r_regionkey) - 1 AS r FROM region) ON i % 5 = r")
def cyclic_repeat(spark, d):
    return rows.cyclic_repeat(_by(spark, d, "region", "r_regionkey").select(ROW, "r_name"), 17).select(F.col(ROW).alias("row"), "r_name")


@query("""WITH n AS (SELECT count(*) AS n FROM events) SELECT i AS row, greatest(i, CAST(trunc(n - 2 - sin((100 - i) / 100 * pi() / 2) * n) AS BIGINT)) AS source_row
    FROM n, generate_series(0, 99) g(i)""")
def horizon_sample(spark, d):
    e = rows.with_row(read_table(spark, d, "events").select("event_id"), "event_id")
    return rows.horizon_rows(e, 100).select(F.col(ROW).alias("row"), "source_row")


@query("SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 3")
def last_n_per_key(spark, d):
    return rows.last_rows(rows.numbered_by(read_table(spark, d, "events"), "event_id"), 3, "user_id").select("user_id", "event_id")


@query("SELECT event_id, string_agg(event_id, ',') OVER (PARTITION BY user_id ORDER BY event_id ROWS 2 PRECEDING) AS trailing FROM events")
def trailing_n(spark, d):
    return rows.trailing_values(rows.numbered_by(read_table(spark, d, "events"), "event_id"), "event_id", 3, "user_id").select("event_id", F.array_join(F.col("trailing").cast("array<string>"), ",").alias("trailing"))


@query("SELECT event_id, coalesce(TRY_CAST(event_type AS DOUBLE), -1) AS a, coalesce(TRY_CAST(CAST(value AS VARCHAR) AS FLOAT), 0) AS b FROM events")
def safe_cast_text(spark, d):
    e = read_table(spark, d, "events")
    return e.select("event_id", scalars.to_double(F.col("event_type"), -1.0).alias("a"), scalars.to_float(F.col("value").cast("string")).alias("b"))


@query("SELECT date_trunc('milliseconds', ts) AS ts, event_id FROM events")
def epoch_ms(spark, d):
    e = read_table(spark, d, "events").select("event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("long").cast("string").alias("ts"))
    return calendars.epoch_millis(e, "ts").select(F.col("ts").cast("timestamp_ntz").alias("ts"), "event_id")


@query("SELECT o_orderkey, coalesce(TRY_CAST(CASE WHEN o_orderkey % 3 = 0 THEN 'no date' ELSE CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS DATE), DATE '1970-01-01') AS day FROM orders")
def lenient_dates(spark, d):
    t = F.when(F.col("o_orderkey") % 3 == 0, "no date").otherwise(F.col("o_orderdate").cast("date").cast("string"))
    return read_table(spark, d, "orders").select("o_orderkey", calendars.lenient_date(t).alias("day"))


@query("SELECT o_orderkey, array_to_string(list_transform(range(0, o_orderkey % 5), lambda i: CAST(CAST(o_orderdate AS DATE) + CAST(i AS INTEGER) AS VARCHAR)), ',') AS days FROM orders")
def day_sequence(spark, d):
    day = F.col("o_orderdate").cast("date")
    days = calendars.day_sequence(day, F.date_add(day, (F.col("o_orderkey") % 5).cast("int")))
    return read_table(spark, d, "orders").select("o_orderkey", F.array_join(days.cast("array<string>"), ",").alias("days"))


# First day (since 1970-01-01) of month 6 of the Hijrah year 1415, and the days of the months from it on, past 2001.
_HIJRAH_FIRST, _HIJRAH_LENGTHS = 9074, (
    "29 30 29 30 29 30 30 30 29 30 29 30 29 29 30 29 30 29 30 30 29 30 30 29 29 30 29 30 29 30 29 30 29 30 30 29 30 29 30 29 30 29 30 "
    "29 30 29 30 29 30 29 30 30 30 29 29 29 30 29 29 30 29 30 30 30 30 29 30 29 29 30 29 29 29 30 30 30 30 29 30 30 29 29 30 29 29"
)


def _hijrah_sql() -> str:
    months, first = [], _HIJRAH_FIRST
    for i, days in enumerate(map(int, _HIJRAH_LENGTHS.split())):
        months.append(f"({1415 + (5 + i) // 12}, {(5 + i) % 12 + 1}, {first}, {first + days})")
        first += days
    return f"""SELECT o_orderkey, CAST(isodow(x) AS INTEGER) AS day_of_week, CAST(n - a + 1 AS INTEGER) AS day_of_month, CAST((n - a) // 7 + 1 AS INTEGER) AS aligned_week_of_month, m AS month_of_year, y AS year
        FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS x, CAST(o_orderdate AS DATE) - DATE '1970-01-01' AS n FROM orders) JOIN (VALUES {", ".join(months)}) t(y, m, a, z) ON n >= a AND n < z"""


def _calendar(name: str):
    def run(spark, d):
        done = calendars.calendar_features(read_table(spark, d, "orders"), "o_orderdate", name, keep=("o_orderkey",))
        return done.select("o_orderkey", *[F.col(f"`{c}`").alias(c.split(":")[1].lower()) for c in done.columns[1:]])

    key = f"calendar_{name.lower().replace('buddhist', '')}"
    QUERIES[key] = run
    if name == "Hijrah":
        ORACLE[key] = _hijrah_sql()
    else:
        week = "" if name == "Japanese" else "(day(x) - 1) // 7 + 1 AS aligned_week_of_month, "
        ORACLE[key] = f"SELECT o_orderkey, isodow(x) AS day_of_week, day(x) AS day_of_month, {week}month(x) AS month_of_year, year(x) + {calendars.YEAR_SHIFT[name]} AS year FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS x FROM orders)"


for _c in ("Iso", "ThaiBuddhist", "Minguo", "Japanese", "Hijrah"):
    _calendar(_c)


@query("SELECT o_orderkey, o_custkey, o_totalprice, CAST(o_orderdate AS DATE) AS o_orderdate, o_orderpriority FROM orders")
def isam_roundtrip(spark, d):
    o = _orders(spark, d).select("o_orderkey", "o_custkey", "o_totalprice", F.col("o_orderdate").cast("date").alias("o_orderdate"), "o_orderpriority", ROW)
    at = _folder(spark)
    records.write_records(o, at, widths={"o_orderpriority": 24})
    return records.read_records(spark, at).drop(ROW)


@query("SELECT o_orderkey, o_orderpriority FROM orders")
def isam_sharded(spark, d):
    at = _folder(spark)
    records.write_sharded(_orders(spark, d).select("o_orderkey", "o_orderpriority", ROW), at, text_width=24)
    return records.read_sharded(spark, at, ["o_orderkey", "o_orderpriority"]).drop(ROW)


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def csv_roundtrip(spark, d):
    at = _folder(spark)
    text.write_csv_lines(_by(spark, d, "nation", "n_nationkey"), at, single_file=True)
    return text.read_csv_lines(spark, at, {"n_nationkey": "IoInt", "n_regionkey": "IoInt"})


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, CAST(o_totalprice AS FLOAT) AS price FROM orders")
def fwf_scan(spark, d):
    at = _folder(spark)
    line = F.concat(F.rpad(F.col("o_orderkey").cast("string"), 12, " "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lpad(F.col("o_totalprice").cast("decimal(20,6)").cast("string"), 24, " "))
    read_table(spark, d, "orders").select(line.alias("value")).write.text(at)
    return text.read_fixed_width(spark, at, [("o_orderkey", 0, 12, "IoLong"), ("day", 12, 22, "IoLocalDate"), ("price", 22, 46, "IoFloat")])


@query("SELECT vec_id, embedding[3] AS a, embedding[2] AS b, len(embedding) // 2 AS n_pairs FROM embeddings")
def vector_steps(spark, d):
    e = F.col("embedding")
    return read_table(spark, d, "embeddings").select("vec_id", *[F.get(vectors.vreverse(vectors.vslice(e, 0, 3)), F.lit(i)).alias(n) for i, n in enumerate("ab")], F.size(vectors.vpairs(e)).alias("n_pairs"))


@query("SELECT vec_id, embedding[1] AS s0, CAST(NULL AS FLOAT) AS s1, embedding[3] AS s2 FROM embeddings")
def sparse_vector(spark, d):
    m = F.create_map(F.lit(0), F.get("embedding", F.lit(0)), F.lit(2), F.get("embedding", F.lit(2)))
    sparse = reshape.sparse_vector(m, 3)
    return read_table(spark, d, "embeddings").select("vec_id", *[F.get(sparse, F.lit(i)).alias(f"s{i}") for i in range(3)])


_RECTANGLES = ((31, 18), (24, 13), (2, 9), (50, 1))
#: The place of a cell by its number: strips of eight lines, columns down and up, the last two of an even number together.
_PLACES = """SELECT w, h, pos, CASE WHEN s % 2 = 1 THEN w - 1 - c ELSE c END AS x, s * 8 + l AS y FROM (SELECT w, h, pos, s,
    CASE WHEN r < n * m THEN r // n WHEN (r - n * m) // 2 % 2 = 1 THEN m + 1 - (r - n * m) % 2 ELSE m + (r - n * m) % 2 END AS c,
    CASE WHEN r >= n * m THEN (r - n * m) // 2 WHEN r // n % 2 = 1 THEN n - 1 - r % n ELSE r % n END AS l
    FROM (SELECT *, pos - s * w * 8 AS r, least(8, h - s * 8) AS n, CASE WHEN w % 2 = 1 THEN w ELSE w - 2 END AS m
    FROM (SELECT w, h, unnest(range(w * h)) AS pos, unnest(range(w * h)) // (w * 8) AS s FROM (VALUES (31, 18), (24, 13), (2, 9), (50, 1)) t(w, h))))"""


@query(_PLACES)
def gilbert(spark, d):
    """The table function; every position is compared."""
    register_curve(spark)
    return spark.sql(" UNION ALL ".join(f"SELECT {w} AS w, {h} AS h, pos, x, y FROM space_curve({w}, {h})" for w, h in _RECTANGLES))


@query(_PLACES)
def gilbert_rows(spark, d):
    """The same made in parallel, from each cell's number."""
    parts = [curve_rows(spark, w, h).select(F.lit(w).alias("w"), F.lit(h).alias("h"), "pos", "x", "y") for w, h in _RECTANGLES]
    return reduce(DataFrame.unionByName, parts)


_MODES = ("?", "ACCT", "CARD", "CASH", "VOUCH")


@query("""WITH days AS (SELECT CAST(unnest(generate_series(min(CAST(date AS TIMESTAMP)), max(CAST(date AS TIMESTAMP)), INTERVAL 1 DAY)) AS DATE) AS date FROM superannuated1909)
    SELECT date, """ + ", ".join(f"round(coalesce(sum(CASE WHEN transmode = '{m}' THEN CAST(amount AS DOUBLE) END), 0), 1) AS \"amount_{m}\"" for m in _MODES) + " FROM days LEFT JOIN superannuated1909 USING (date) GROUP BY date")
def sales_resample_pivot_sum_all(spark, d):
    """Over all values of transmode the data has; its SQL must list them."""
    s = read_table(spark, d, "superannuated1909").select("date", "transmode", F.col("amount").cast("double").alias("amount")).where("date IS NOT NULL")
    null_key = [] if s.where("transmode IS NULL").isEmpty() else ["null"]  # a kind of its own, unlike the null of added days
    done = reshape.pivot_sum(reshape.resample_daily(s, "date"), ["date"], ["transmode"], ["amount"], drop_null_key=not null_key)
    found = [c.removeprefix("[transmode=").removesuffix("]:amount") for c in done.columns if c != "date"]
    return done.select("date", *[F.round(F.col(f"`[transmode={m}]:amount`"), 1).alias(f"amount_{m}") for m in sorted(found)])


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Resample, pivot, group and sum in one aggregation."""
    return flagship_resample_pivot_sum(spark, d)
