"""The registered queries over the item model, each with its SQL.

Names begin with the inventory's id.  Keys are shown as text, counts and
sizes as long integers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodekey.functions import bloom, keys, sizes
from lodekey.operators import oplog, points, stats, topology, transactions
from lodekey.operators.query import REQUEST, SubQuery, query_items, range_query, top_per_key, visited_leaves
from lodekey.plans import conditions
from lodekey.plans.intervals import Condition, interval_of
from lodekey.sources import fixtures

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

ORD = """ord AS (SELECT 'cust#' || o_custkey AS hk, 'order#' || strftime(o_orderdate, '%Y-%m-%d') || '#' || lpad(o_orderkey::VARCHAR, 10, '0') AS sk,
    o_orderpriority AS data FROM orders)"""
DOC = """doc AS (SELECT lang AS hk, lpad(doc_id::VARCHAR, 10, '0') AS sk, text AS data, strlen(text) + strlen(lang) + 10 + 100 AS est FROM documents)"""
OPS = """ops AS (SELECT 'user#' || user_id AS hk, row_number() OVER (ORDER BY ts, event_id) AS seq, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'put' END AS op,
    (epoch_us(ts) // 1000) AS ts, props AS data, event_id, event_type, (user_id % 7)::INT AS partition_id FROM events)"""
LINES = """ln AS (SELECT 'ord#' || l_orderkey AS hk, lpad(l_linenumber::VARCHAR, 4, '0') AS sk, l_returnflag AS data, (epoch_us(l_shipdate) // 1000) AS ts,
    row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus) AS n
    FROM lineitem)"""


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _text(name: str) -> Column:
    return keys.decode_text(F.col(name)).alias(name)


# ------------------------------------------------------------- points and ranges


def _wanted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order's key, and for each customer one that no order has."""
    o = fixtures.orders(spark, sf_dir).select("hk", "sk")
    c = fixtures.table(spark, sf_dir, "customer").select(fixtures.key("cust#", F.col("c_custkey").cast("string")).alias("hk"), fixtures.key("order#none").alias("sk"))
    return o.unionByName(c)


@query(f"""WITH {ORD}, want AS (SELECT hk, sk FROM ord UNION ALL SELECT 'cust#' || c_custkey, 'order#none' FROM customer)
    SELECT w.hk, w.sk, o.data, o.hk IS NOT NULL AS found FROM want w LEFT JOIN ord o ON w.hk = o.hk AND w.sk = o.sk""")
def a2_batch_get(spark, sf_dir):
    got = points.batch_get(fixtures.orders(spark, sf_dir), _wanted(spark, sf_dir))
    return got.select(_text("hk"), _text("sk"), F.col("data_text").alias("data"), "found")


@query(f"""WITH {ORD} SELECT hk, sk, 1::BIGINT AS v, 0::BIGINT AS ts FROM ord""")
def d2_item_stamps(spark, sf_dir):
    o = fixtures.orders(spark, sf_dir)
    return points.get_stamps(o, o.select("hk", "sk")).select(_text("hk"), _text("sk"), "v", F.col("last_transaction_ts").alias("ts"))


def _requests(spark: SparkSession, sf_dir: str, condition: Condition | None, forward: bool = True) -> DataFrame:
    """One request per customer."""
    i = interval_of(condition)
    c = fixtures.table(spark, sf_dir, "customer")
    bound = lambda b: F.lit(b).cast("binary")
    return c.select(F.col("c_custkey").cast("int").alias("qi"), fixtures.key("cust#", F.col("c_custkey").cast("string")).alias("hk"), bound(i.low).alias("low"), F.lit(i.low_in).alias("low_in"), bound(i.high).alias("high"), F.lit(i.high_in).alias("high_in"), F.lit(forward).alias("forward"))


RANGES = {
    "a4_eq": (Condition("eq", "order#1998-10-03#0000000000"), True, "sk = 'order#1998-10-03#0000000000'"),
    "a4_gt": (Condition("gt", "order#1999"), True, "sk > 'order#1999'"),
    "a4_gte": (Condition("gte", "order#1999-06-01"), True, "sk >= 'order#1999-06-01'"),
    "a4_lt": (Condition("lt", "order#1996"), True, "sk < 'order#1996'"),
    "a4_lte": (Condition("lte", "order#1996-12-31"), True, "sk <= 'order#1996-12-31'"),
    "a4_between": (Condition("between", "order#1997", "order#1999"), True, "sk BETWEEN 'order#1997' AND 'order#1999'"),
    "a4_begins_with": (Condition("begins_with", "order#199"), True, "starts_with(sk, 'order#199')"),
    "a4_range": (Condition("range", "order#1997", "order#2000", False, True), True, "sk > 'order#1997' AND sk <= 'order#2000'"),
    "a4_all": (None, True, "true"),
    "a4_desc": (Condition("begins_with", "order#1998"), False, "starts_with(sk, 'order#1998')"),
}


def _range(name: str, condition: Condition | None, forward: bool, where: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        got = range_query(fixtures.orders(spark, sf_dir), _requests(spark, sf_dir, condition, forward))
        return got.select("qi", "rk", _text("hk"), _text("sk"), F.col("data_text").alias("data"))

    run.__name__ = name
    query(f"""WITH {ORD} SELECT substr(hk, 6)::INT AS qi, row_number() OVER (PARTITION BY hk ORDER BY sk {'ASC' if forward else 'DESC'}) AS rk, hk, sk, data
        FROM ord WHERE {where} AND hk IN (SELECT 'cust#' || c_custkey FROM customer)""")(run)


for _name, _made in RANGES.items():
    _range(_name, *_made)


def _page(page) -> DataFrame:
    return page.rows.select("qi", "pos", _text("hk"), _text("sk"), F.col("data_text").alias("data"))


def _page_sql(parts: list[tuple[str, str, bool]], pick: str = "true") -> str:
    union = " UNION ALL ".join(f"SELECT {i} AS qi, hk, sk, data, row_number() OVER (ORDER BY sk {'ASC' if up else 'DESC'}) AS rk FROM ord WHERE hk = '{hk}' AND {where}" for i, (hk, where, up) in enumerate(parts))
    return f"""WITH {ORD}, m AS ({union}), p AS (
            SELECT *, row_number() OVER (ORDER BY qi, rk) AS pos, sum(strlen(hk) + strlen(sk) + 2 * length(data) + 72) OVER (ORDER BY qi, rk) AS total,
                sum(strlen(hk) + strlen(sk) + 2 * length(data) + 72) OVER (ORDER BY qi, rk) - sum(strlen(hk) + strlen(sk) + 2 * length(data) + 72) OVER (PARTITION BY qi ORDER BY rk) AS before FROM m)
        SELECT qi::INT AS qi, pos::BIGINT AS pos, hk, sk, data FROM p WHERE {pick}"""


PREFIX = Condition("begins_with", "order#199")
SOME = [("cust#1", PREFIX, True), ("cust#2", None, True), ("cust#4", Condition("gte", "order#1997"), True)]
SOME_SQL = [("cust#1", "starts_with(sk, 'order#199')", True), ("cust#2", "true", True), ("cust#4", "sk >= 'order#1997'", True)]
PAGES = {
    "a4_multi": (SOME, SOME_SQL, {}, "true"),
    "a4_multi_mixed_dir": ([("cust#2", None, False), ("cust#1", None, True), ("cust#4", None, False)], [("cust#2", "true", False), ("cust#1", "true", True), ("cust#4", "true", False)], {}, "true"),
    "a4_dup_keys": ([("cust#1", None, True), ("cust#1", Condition("lt", "order#1999"), False), ("cust#1", None, True)], [("cust#1", "true", True), ("cust#1", "sk < 'order#1999'", False), ("cust#1", "true", True)], {}, "true"),
    "a4_empty_interval": ([("cust#1", None, True), ("cust#2", Condition("between", "z", "a"), True), ("cust#4", None, True)], [("cust#1", "true", True), ("cust#2", "false", True), ("cust#4", "true", True)], {}, "true"),
    "f_limit_page": (SOME, SOME_SQL, {"limit": 9}, "pos <= 9"),
    "f_byte_page": (SOME, SOME_SQL, {"max_bytes": 1500}, "total <= 1500 OR (rk = 1 AND before < 1500)"),
    "f_limit_and_bytes": (SOME, SOME_SQL, {"limit": 7, "max_bytes": 1500}, "(total <= 1500 OR (rk = 1 AND before < 1500)) AND pos <= 7"),
}


def _paged(name: str, parts, sql_parts, budget: dict, pick: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _page(query_items(fixtures.orders(spark, sf_dir), [SubQuery(*p) for p in parts], **budget))

    run.__name__ = name
    query(_page_sql(sql_parts, pick))(run)


for _name, _made in PAGES.items():
    _paged(_name, *_made)


@query(_page_sql(SOME_SQL, "pos > 9 AND pos <= 18").replace("pos::BIGINT AS pos", "(pos - 9)::BIGINT AS pos"))
def f_second_page(spark, sf_dir):
    """The page that the first page's cursor leads to."""
    items, parts = fixtures.orders(spark, sf_dir), [SubQuery(*p) for p in SOME]
    cursor = query_items(items, parts, limit=9).next_cursor()
    if cursor is None:
        return _page(query_items(items, parts, limit=9)).limit(0)
    return _page(query_items(items, parts, limit=9, cursor=cursor.encode()))


@query(f"WITH {ORD} SELECT hk, sk, row_number() OVER (PARTITION BY hk ORDER BY sk DESC) AS rk FROM ord QUALIFY rk <= 3")
def f_topk_per_key(spark, sf_dir):
    return top_per_key(fixtures.orders(spark, sf_dir), 3, forward=False).select(_text("hk"), _text("sk"), F.col("rk").cast("long").alias("rk"))


@query("""WITH leaf AS (SELECT 'cust#' || c_custkey AS hk, c_custkey, n AS leaf, 'order#' || (1995 + n) AS lo, 'order#' || (1996 + n) AS hi FROM customer, range(8) t(n))
    SELECT c_custkey::INT AS qi, hk, leaf::INT AS leaf, row_number() OVER (PARTITION BY hk ORDER BY lo) AS visit
    FROM leaf WHERE lo <= 'order#1999-06' AND hi > 'order#1996-06' QUALIFY visit <= 3""")
def f_visit_cap(spark, sf_dir):
    """Leaves by year; a request visits three of those that its bounds meet."""
    c = fixtures.table(spark, sf_dir, "customer")
    leaves = c.select(fixtures.key("cust#", F.col("c_custkey").cast("string")).alias("hk"), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("leaf"))
    leaves = leaves.select("hk", "leaf", fixtures.key("order#", (F.col("leaf") + 1995).cast("string")).alias("start"), fixtures.key("order#", (F.col("leaf") + 1996).cast("string")).alias("end"))
    got = visited_leaves(leaves, _requests(spark, sf_dir, Condition("range", "order#1996-06", "order#1999-06", True, True)), 3)
    return got.select("qi", _text("hk"), F.col("leaf"), F.col("visit").cast("long").alias("visit"))


@query(f"WITH {ORD} SELECT hk, sk, data FROM ord WHERE hk > 'cust#5' OR (hk = 'cust#5' AND sk > 'order#1995') ORDER BY hk, sk LIMIT 100")
def d7_keyset_page(spark, sf_dir):
    return points.keyset_page(fixtures.orders(spark, sf_dir), 100, (b"cust#5", b"order#1995")).select(_text("hk"), _text("sk"), F.col("data_text").alias("data"))


@query(f"WITH {ORD} SELECT hk, sk, data FROM ord WHERE hk = 'cust#1' AND sk < 'order#1999' ORDER BY sk DESC LIMIT 5")
def d8_slice_page(spark, sf_dir):
    got = points.slice_page(fixtures.orders(spark, sf_dir), b"cust#1", interval_of(Condition("lt", "order#1999")), 5, forward=False)
    return got.select(_text("hk"), _text("sk"), F.col("data_text").alias("data"))


# ------------------------------------------------------------------------- writes


@query(f"""WITH {LINES} SELECT hk, sk, count(*)::BIGINT AS v, max(ts)::BIGINT AS ts, arg_max(data, n) AS data FROM ln GROUP BY hk, sk""")
def a1_upsert_versions(spark, sf_dir):
    got = oplog.fold(fixtures.line_puts(spark, sf_dir))
    return got.select(_text("hk"), _text("sk"), F.col("v").cast("long").alias("v"), F.col("last_transaction_ts").alias("ts"), F.col("data_text").alias("data"))


def _line_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = oplog.fold(fixtures.line_puts(spark, sf_dir))
    return got.select("hk", "sk", "data_kind", F.col("v").cast("long").alias("v"), "last_transaction_ts", F.lit(None).cast("long").alias("ttl_epoch_utc_seconds"), sizes.row_bytes(F.col("hk"), F.col("sk"), F.col("data_bin"), F.col("data_text")).alias("est_row_bytes"), "data_bin", "data_text")


def _condition(kind: str, value: int | None = None) -> Column:
    return F.array(F.struct(F.lit(kind).alias("type"), F.lit(value).cast("long").alias("value")))


def _line_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First line of every order, and one line that no order has."""
    o = fixtures.table(spark, sf_dir, "orders").select(fixtures.key("ord#", F.col("o_orderkey").cast("string")).alias("hk"))
    return o.withColumn("sk", F.explode(F.array(F.encode(F.lit("0001"), "UTF-8"), F.encode(F.lit("9999"), "UTF-8"))))


LINE_KEYS = "want AS (SELECT 'ord#' || o_orderkey AS hk, s AS sk FROM orders, (VALUES ('0001'), ('9999')) t(s)), cur AS (SELECT hk, sk, count(*)::BIGINT AS v, max(ts)::BIGINT AS ts FROM ln GROUP BY hk, sk)"


def _puts(spark: SparkSession, sf_dir: str, condition: Column) -> DataFrame:
    k = _line_keys(spark, sf_dir).select("hk", "sk", condition.alias("conditions"), F.lit(900_000_000_000).cast("long").alias("ts"), F.lit(1).alias("data_kind"), F.lit(None).cast("binary").alias("data_bin"), F.lit("new").alias("data_text"))
    return points.conditional_puts(_line_items(spark, sf_dir), k)


@query(f"""WITH {LINES}, {LINE_KEYS} SELECT w.hk, w.sk, CASE WHEN c.v IS NULL THEN 1::BIGINT END AS version, CASE WHEN c.v IS NOT NULL THEN 0 END::INT AS failed
    FROM want w LEFT JOIN cur c ON w.hk = c.hk AND w.sk = c.sk""")
def a1_cond_not_exists(spark, sf_dir):
    return _puts(spark, sf_dir, _condition("item_not_exists")).select(_text("hk"), _text("sk"), F.col("version").cast("long").alias("version"), F.col("failed").cast("int").alias("failed"))


@query(f"""WITH {LINES}, {LINE_KEYS} SELECT w.hk, w.sk, CASE WHEN c.v = 2 THEN 3::BIGINT END AS version, CASE WHEN c.v IS DISTINCT FROM 2 THEN 0 END::INT AS failed,
        CASE WHEN c.v = 2 THEN greatest(c.ts, 900000000000) END::BIGINT AS ts
    FROM want w LEFT JOIN cur c ON w.hk = c.hk AND w.sk = c.sk""")
def a1_cond_version(spark, sf_dir):
    return _puts(spark, sf_dir, _condition("attribute_equals", 2)).select(_text("hk"), _text("sk"), F.col("version").cast("long").alias("version"), F.col("failed").cast("int").alias("failed"), F.col("new_ts").alias("ts"))


@query(f"""WITH {LINES}, {LINE_KEYS}, all_ AS (SELECT coalesce(w.hk, c.hk) AS hk, coalesce(w.sk, c.sk) AS sk, c.v, w.hk IS NOT NULL AS asked FROM want w FULL JOIN cur c ON w.hk = c.hk AND w.sk = c.sk)
    SELECT hk, sk, CASE WHEN asked THEN coalesce(v, 0) + 1 ELSE v END::BIGINT AS v FROM all_""")
def a1_put_applied(spark, sf_dir):
    """The whole table after unconditional puts."""
    got = points.apply_puts(_line_items(spark, sf_dir), _puts(spark, sf_dir, F.array().cast("array<struct<type:string,value:bigint>>")))
    return got.select(_text("hk"), _text("sk"), "v")


def _deletes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points.conditional_deletes(_line_items(spark, sf_dir), _line_keys(spark, sf_dir).withColumn("conditions", _condition("item_exists")))


@query(f"""WITH {LINES}, {LINE_KEYS} SELECT w.hk, w.sk, c.v IS NOT NULL AS deleted, CASE WHEN c.v IS NULL THEN 0 END::INT AS failed FROM want w LEFT JOIN cur c ON w.hk = c.hk AND w.sk = c.sk""")
def a3_cond_exists(spark, sf_dir):
    return _deletes(spark, sf_dir).select(_text("hk"), _text("sk"), "deleted", F.col("failed").cast("int").alias("failed"))


@query(f"""WITH {LINES}, {LINE_KEYS} SELECT c.hk, c.sk, c.v FROM cur c ANTI JOIN want w ON w.hk = c.hk AND w.sk = c.sk""")
def a3_delete(spark, sf_dir):
    return points.apply_deletes(_line_items(spark, sf_dir), _deletes(spark, sf_dir)).select(_text("hk"), _text("sk"), "v")


EPOCHS = f"{OPS}, e AS (SELECT *, count(*) FILTER (op = 'delete') OVER (PARTITION BY hk ORDER BY seq) AS epoch FROM ops)"


@query(f"""WITH {EPOCHS}, l AS (SELECT *, max(epoch) OVER (PARTITION BY hk) AS last FROM e)
    SELECT hk, count(*)::BIGINT AS v, max(ts)::BIGINT AS ts, arg_max(data, seq) AS data FROM l WHERE epoch = last AND op = 'put' GROUP BY hk""")
def d_oplog_fold(spark, sf_dir):
    got = oplog.fold(fixtures.event_ops(spark, sf_dir))
    return got.select(_text("hk"), F.col("v").cast("long").alias("v"), F.col("last_transaction_ts").alias("ts"), F.col("data_text").alias("data"))


@query(f"""WITH {EPOCHS} SELECT event_id, hk, epoch::BIGINT AS epoch, CASE WHEN op = 'put' THEN count(*) FILTER (op = 'put') OVER (PARTITION BY hk, epoch ORDER BY seq) END::BIGINT AS v FROM e""")
def d_oplog_versions(spark, sf_dir):
    return oplog.with_epochs(fixtures.event_ops(spark, sf_dir)).select("event_id", _text("hk"), "epoch", "v")


@query(f"""WITH RECURSIVE {OPS}, s AS (SELECT *, row_number() OVER (PARTITION BY hk ORDER BY seq) AS n FROM ops),
    f(hk, n, event_id, ok, v) AS (
        SELECT hk, n, event_id, event_type <> 'purchase', CASE WHEN op = 'put' AND event_type <> 'purchase' THEN 1 END FROM s WHERE n = 1
        UNION ALL
        SELECT s.hk, s.n, s.event_id, NOT (s.event_type = 'purchase' AND f.v IS NULL),
            CASE WHEN s.event_type = 'purchase' AND f.v IS NULL THEN f.v WHEN s.op = 'delete' THEN NULL ELSE coalesce(f.v, 0) + 1 END
        FROM f JOIN s ON s.hk = f.hk AND s.n = f.n + 1)
    SELECT event_id, hk, ok AS accepted, v::BIGINT AS v FROM f""")
def d_oplog_conditional(spark, sf_dir):
    """A purchase needs the item to be there; whatever fails changes nothing."""
    needs = F.when(F.col("event_type") == "purchase", _condition("item_exists"))
    return _conditional(fixtures.event_ops(spark, sf_dir).withColumn("conditions", needs))


def _conditional(ops: DataFrame) -> DataFrame:
    """Numbers each key's operations, then folds them."""
    numbered = ops.withColumn("n", F.row_number().over(Window.partitionBy("hk", "sk").orderBy("seq")).cast("long"))
    got = oplog.fold_conditional(numbered.drop("seq").withColumnRenamed("n", "seq"))
    named = numbered.select(F.col("hk").alias("n_hk"), F.col("n"), "event_id")
    return got.join(named, (F.col("hk") == F.col("n_hk")) & (F.col("seq") == F.col("n"))).select("event_id", _text("hk"), "accepted", "v")


@query(f"""WITH {LINES} SELECT hk, sk, data FROM ln WHERE n = 1""")
def d_insert_if_absent(spark, sf_dir):
    puts = fixtures.line_puts(spark, sf_dir)
    empty = _line_items(spark, sf_dir).filter("false").select("hk", "sk", "data_text")
    return points.insert_if_absent(empty, puts.select("hk", "sk", "data_text", "seq"), "seq").select(_text("hk"), _text("sk"), F.col("data_text").alias("data"))


@query(f"""WITH {DOC} SELECT hk, sk FROM doc QUALIFY row_number() OVER (PARTITION BY hk ORDER BY sk) > 50""")
def c20_bounded_delete(spark, sf_dir):
    d = fixtures.documents(spark, sf_dir)
    return points.bounded_delete(d, d.select("hk"), 50).select(_text("hk"), _text("sk"))


@query(f"""WITH {OPS}, b AS (SELECT *, lag(op) OVER (PARTITION BY hk ORDER BY seq) AS before FROM ops)
    SELECT partition_id, max(ts)::BIGINT AS max_deleted_ts FROM b WHERE op = 'delete' AND before = 'put' GROUP BY partition_id""")
def k_watermark(spark, sf_dir):
    return oplog.deletion_watermarks(fixtures.event_ops(spark, sf_dir))


# --------------------------------------------------------------------- statistics


@query(f"WITH {DOC} SELECT hk, sum(est)::BIGINT AS est_bytes FROM doc GROUP BY hk")
def e_key_sizes(spark, sf_dir):
    return stats.key_sizes(fixtures.documents(spark, sf_dir)).select(_text("hk"), "est_bytes")


@query(f"""WITH {DOC}, s AS (SELECT hk, sum(est) AS b FROM doc GROUP BY hk UNION ALL SELECT hk, -sum(est) FROM doc WHERE data LIKE '%a%' GROUP BY hk)
    SELECT hk, greatest(sum(b), 0)::BIGINT AS est_bytes FROM s GROUP BY hk""")
def e_key_sizes_incremental(spark, sf_dir):
    """Sizes after the texts with an a in them went."""
    d = fixtures.documents(spark, sf_dir)
    gone = stats.key_sizes(d.filter(F.col("data_text").contains("a"))).select("hk", (-F.col("est_bytes")).alias("delta"))
    return stats.merge_key_sizes(stats.key_sizes(d), gone).select(_text("hk"), "est_bytes")


@query("""SELECT 'cust#' || c_custkey AS hk, 0::BIGINT AS est_bytes FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)""")
def e_key_sizes_orphans(spark, sf_dir):
    c = fixtures.table(spark, sf_dir, "customer").select(fixtures.key("cust#", F.col("c_custkey").cast("string")).alias("hk"), F.lit(0).cast("long").alias("est_bytes"))
    return stats.orphan_sizes(c, fixtures.orders(spark, sf_dir)).select(_text("hk"), "est_bytes")


@query(f"WITH {DOC} SELECT hk, sum(est)::BIGINT AS est_bytes FROM doc GROUP BY hk HAVING sum(est) >= 0.25 * 1048576")
def e_heavy_keys(spark, sf_dir):
    return stats.heavy_keys(stats.key_sizes(fixtures.documents(spark, sf_dir)), 1 << 20).select(_text("hk"), "est_bytes")


BOUNDS = f"""{DOC}, r AS (SELECT hk, sk, est, lag(sk) OVER w AS prev, row_number() OVER w AS n, sum(est) OVER (PARTITION BY hk) / 4.0 AS step, sum(est) OVER w AS acc FROM doc WINDOW w AS (PARTITION BY hk ORDER BY sk)),
    f(hk, n, thr, cut, cuts) AS (
        SELECT hk, 1::BIGINT, step, NULL::VARCHAR, 0 FROM r WHERE n = 1
        UNION ALL
        SELECT r.hk, r.n, CASE WHEN r.acc >= f.thr AND f.cuts < 3 THEN r.acc + r.step ELSE f.thr END,
            CASE WHEN r.acc >= f.thr AND f.cuts < 3 THEN substr(r.sk, 1, 1 + (SELECT count(*) FROM range(1, 11) t(i) WHERE substr(r.sk, 1, i::INT) = substr(r.prev, 1, i::INT))::INT) END,
            CASE WHEN r.acc >= f.thr AND f.cuts < 3 THEN f.cuts + 1 ELSE f.cuts END
        FROM f JOIN r ON r.hk = f.hk AND r.n = f.n + 1),
    b AS (SELECT hk, list(cut ORDER BY n) FILTER (cut IS NOT NULL) AS cuts FROM f GROUP BY hk)"""


@query(f"WITH RECURSIVE {BOUNDS} SELECT hk, CASE WHEN len(cuts) = 3 AND len(list_distinct(cuts)) = 3 THEN array_to_string(cuts, ',') END AS boundaries FROM b")
def e_split_boundaries(spark, sf_dir):
    got = stats.split_boundaries(fixtures.documents(spark, sf_dir), 4)
    return got.select(_text("hk"), F.array_join(F.transform("boundaries", lambda b: F.decode(b, "UTF-8")), ",").alias("boundaries"))


@query(f"""WITH RECURSIVE {BOUNDS}, g AS (SELECT hk, cuts FROM b WHERE len(cuts) = 3)
    SELECT d.hk, len(list_filter(g.cuts, lambda c: c <= d.sk))::INT AS child, count(*)::BIGINT AS n_items, sum(est)::BIGINT AS bytes FROM doc d JOIN g ON d.hk = g.hk GROUP BY 1, 2""")
def e_split_balance(spark, sf_dir):
    d = fixtures.documents(spark, sf_dir)
    routed = topology.route_range(d, stats.children(stats.split_boundaries(d, 4)))
    return routed.groupBy("hk", "child").agg(F.count("*").alias("n_items"), F.sum("est_row_bytes").alias("bytes")).select(_text("hk"), "child", "n_items", "bytes")


# ----------------------------------------------------------------------- placement


def _bucket_sql(depth: int, n: int, hk: str = "hk") -> str:
    return f"(('0x' || substr(md5('{depth}:' || {hk}), 1, 8))::BIGINT % {n})::INT"


@query(f"WITH {ORD} SELECT DISTINCT hk, {_bucket_sql(0, 10)} AS root FROM ord")
def h_root_route(spark, sf_dir):
    o = fixtures.orders(spark, sf_dir).select("hk").distinct()
    return o.select(_text("hk"), topology.root_of(F.col("hk"), 10).alias("root"))


def _routed_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders over ten roots of which even ones have split in four, and of their children the first again."""
    names = [f"h.{r}" for r in range(0, 10, 2)] + [f"h.{r}.0" for r in range(0, 10, 2)]
    return topology.route_hash(fixtures.orders(spark, sf_dir), 10, 4, spark.createDataFrame([(n,) for n in names], "name string"))


ROUTED = f"""{ORD}, b AS (SELECT *, {_bucket_sql(0, 10)} AS r, {_bucket_sql(1, 4)} AS c1, {_bucket_sql(2, 4)} AS c2, strlen(data) + strlen(hk) + strlen(sk) + 100 AS est FROM ord),
    routed AS (SELECT *, 'h.' || r || CASE WHEN r % 2 = 0 THEN '.' || c1 || CASE WHEN c1 = 0 THEN '.' || c2 ELSE '' END ELSE '' END AS partition FROM b)"""


@query(f"WITH {ROUTED} SELECT hk, sk, partition FROM routed")
def h_child_route(spark, sf_dir):
    return _routed_orders(spark, sf_dir).select(_text("hk"), _text("sk"), "partition")


@query(f"WITH {ROUTED} SELECT partition, count(*)::BIGINT AS n_items, count(DISTINCT hk)::BIGINT AS n_keys, sum(est)::BIGINT AS bytes FROM routed GROUP BY partition")
def h_partition_stats(spark, sf_dir):
    return topology.partition_stats(_routed_orders(spark, sf_dir))


@query(f"""WITH {ROUTED}, s AS (SELECT partition, sum(est)::BIGINT AS bytes FROM routed GROUP BY partition)
    SELECT partition, bytes, bytes > 60000 AS split, CASE WHEN partition = 'h.1' THEN 'forward' WHEN bytes > 60000 * 1.1 THEN 'reject_over_size' ELSE 'ok' END AS admission FROM s""")
def i_split_decisions(spark, sf_dir):
    s = topology.partition_stats(_routed_orders(spark, sf_dir)).select("partition", "bytes")
    gate = topology.admission(s.withColumns({"in_range": F.lit(True), "split": F.col("partition") == "h.1"}), 60_000).select("partition", "admission")
    return topology.split_decisions(s, 60_000).join(gate, "partition")


@query(f"""WITH RECURSIVE {BOUNDS}, g AS (SELECT hk, cuts FROM b WHERE len(cuts) = 3) SELECT d.hk, d.sk, len(list_filter(g.cuts, lambda c: c <= d.sk))::INT AS child FROM doc d JOIN g ON d.hk = g.hk""")
def h_range_route(spark, sf_dir):
    d = fixtures.documents(spark, sf_dir)
    return topology.route_range(d, stats.children(stats.split_boundaries(d, 4))).select(_text("hk"), _text("sk"), "child")


@query(f"""WITH RECURSIVE {BOUNDS}, g AS (SELECT hk, list_concat([''], cuts) AS starts, list_concat(cuts, ['']) AS ends FROM b WHERE len(cuts) = 3),
    c AS (SELECT hk, i AS child, starts[i + 1] AS lo, ends[i + 1] AS hi FROM g, range(4) t(i))
    SELECT hk, child::INT AS child, lo AS start, hi AS "end" FROM c WHERE (hi = '' OR hi > '0000000100') AND lo < '0000000600'""")
def h_pruned_scan(spark, sf_dir):
    """Which children a scan of [100, 600) has to read."""
    from lodekey.plans.intervals import intersects_column

    c = stats.children(stats.split_boundaries(fixtures.documents(spark, sf_dir), 4))
    met = c.filter(intersects_column(F.col("start"), F.col("end"), F.lit(b"0000000100"), F.lit(b"0000000600"), F.lit(False)))
    return met.select(_text("hk"), "child", F.decode("start", "UTF-8").alias("start"), F.decode("end", "UTF-8").alias("end"))


@query("""WITH a AS (SELECT o_orderkey AS leaf, d FROM orders, range(1, 11) t(d) WHERE d < 1 + o_orderkey % 10)
    SELECT leaf, d::INT AS depth FROM (SELECT *, row_number() OVER (PARTITION BY leaf ORDER BY d) AS up, row_number() OVER (PARTITION BY leaf ORDER BY d DESC) AS down FROM a) WHERE up <= 2 OR down <= 2""")
def h_ancestors(spark, sf_dir):
    """Two from either end of each leaf's ancestors; leaves are orders, of varied depth."""
    o = fixtures.table(spark, sf_dir, "orders")
    up = o.select(F.col("o_orderkey").alias("leaf"), F.explode(F.sequence(F.lit(0), (F.col("o_orderkey") % 10).cast("int"))).alias("depth"))
    return topology.select_ancestors(up, 2, 2).select("leaf", "depth")


@query(f"""WITH {DOC}, sl AS (SELECT * FROM (VALUES ('', '0000000500', 1), ('0000000500', '', 1), ('0000000500', '0000000700', 2), ('0000000700', '', 2)) t(lo, hi, depth))
    SELECT d.hk, d.sk, max(s.depth)::INT AS depth, arg_max(s.lo, s.depth) AS lo FROM doc d LEFT JOIN sl s ON d.sk >= s.lo AND (s.hi = '' OR d.sk < s.hi) GROUP BY d.hk, d.sk""")
def d17_deepest_slice(spark, sf_dir):
    d = fixtures.documents(spark, sf_dir).select("hk", "sk")
    cut = [(b"", b"0000000500", 1), (b"0000000500", b"", 1), (b"0000000500", b"0000000700", 2), (b"0000000700", b"", 2)]
    one = F.array(*[F.struct(F.lit(a).alias("sk_start_boundary"), F.lit(b).alias("sk_end_boundary"), F.lit(n).alias("depth")) for a, b, n in cut])
    slices = d.select("hk").distinct().select("hk", F.inline(one))
    return topology.deepest_slice(d, slices).select(_text("hk"), _text("sk"), "depth", F.decode("sk_start_boundary", "UTF-8").alias("lo"))


@query("""WITH p AS (SELECT 'c' || c_custkey AS name, 0 AS lv FROM customer UNION ALL SELECT 'o' || o_orderkey, 1 FROM orders UNION ALL SELECT 'l' || l_orderkey || '.' || l_linenumber, 2 FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem))
    SELECT name, lv::INT AS level, ((SELECT max(lv) FROM p) - lv)::INT AS step FROM p""")
def h_destroy_order(spark, sf_dir):
    """A forest of customers, orders and lines, leaves first."""
    c = fixtures.table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("name"), F.lit(None).cast("string").alias("parent"))
    o = fixtures.table(spark, sf_dir, "orders").select(F.concat(F.lit("o"), "o_orderkey"), F.concat(F.lit("c"), "o_custkey"))
    n = fixtures.table(spark, sf_dir, "lineitem").select(F.concat(F.lit("l"), "l_orderkey", F.lit("."), "l_linenumber"), F.concat(F.lit("o"), "l_orderkey"))
    return topology.destroy_order(c.union(o).union(n).withColumn("status", F.lit("promoted"))).select("name", "level", "step")


# -------------------------------------------------------------------- transactions


def _tx_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order is a transaction over its line numbers, at the order's date."""
    o = fixtures.table(spark, sf_dir, "orders").select(F.col("o_orderkey"), "o_orderpriority", F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("transaction_ts"))
    lines = fixtures.table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"))
    m = o.join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    op = F.when(F.col("l_linenumber") % 3 == 0, "check").when(F.col("l_linenumber") % 3 == 1, "put").otherwise("delete")
    return m.select(
        F.concat(F.lit("tx"), "o_orderkey").alias("transaction_id"),
        "transaction_ts",
        F.col("l_linenumber").cast("int").alias("ordinal"),
        F.concat(F.lit("p"), F.col("o_orderkey") % 4).alias("partition_id"),
        fixtures.key("ord#", F.col("o_orderkey").cast("string")).alias("hk"),
        fixtures.key(fixtures.padded("l_linenumber", 4)).alias("sk"),
        op.alias("operation"),
        F.when(op == "put", F.lit(1)).alias("data_kind"),
        F.when(op == "put", F.col("o_orderpriority")).alias("data_text"),
        F.when(op == "check", _condition("attribute_equals", 1)).alias("conditions"),
        F.lit(None).cast("binary").alias("data_bin"),
    )


def _tx_locks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Urgent orders lock their own first line, and high ones hold it for another."""
    o = fixtures.table(spark, sf_dir, "orders").filter(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"))
    holder = F.when(F.col("o_orderpriority") == "1-URGENT", F.concat(F.lit("tx"), "o_orderkey")).otherwise("tx-other")
    created = F.unix_millis(F.col("o_orderdate").cast("timestamp"))
    return o.select(fixtures.key("ord#", F.col("o_orderkey").cast("string")).alias("hk"), F.encode(F.lit("0001"), "UTF-8").alias("sk"), holder.alias("transaction_id"), created.alias("transaction_ts"), created.alias("created_at"), F.lit("put").alias("operation"), F.lit(1).alias("data_kind"), F.lit(None).cast("binary").alias("data_bin"), F.col("o_orderpriority").alias("data_text"))


NOW_MS = 985_000_000_000
TX = f"""{LINES}, cur AS (SELECT hk, sk, count(*) AS v, max(ts) AS lts FROM ln WHERE sk <> '0002' GROUP BY hk, sk),
    req AS (SELECT 'tx' || o_orderkey AS tx, (epoch_us(o_orderdate) // 1000) AS tts, l_linenumber AS ord, 'p' || (o_orderkey % 4) AS part, 'ord#' || o_orderkey AS hk, lpad(l_linenumber::VARCHAR, 4, '0') AS sk,
        CASE l_linenumber % 3 WHEN 0 THEN 'check' WHEN 1 THEN 'put' ELSE 'delete' END AS op, o_orderpriority AS prio
        FROM orders JOIN (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) ON o_orderkey = l_orderkey),
    pre AS (SELECT r.*, c.v, c.lts, CASE
            WHEN tts > {NOW_MS} + 5000 THEN 'clock_skew'
            WHEN sk = '0001' AND prio = '1-URGENT' THEN NULL
            WHEN sk = '0001' AND prio = '2-HIGH' THEN 'pending_conflict'
            WHEN op = 'check' AND c.v IS DISTINCT FROM 1 THEN 'condition_failed'
            WHEN c.v IS NOT NULL AND tts <= c.lts THEN 'timestamp_conflict'
            WHEN c.v IS NULL AND tts <= 900000000000 AND part = 'p1' THEN 'timestamp_conflict' END AS reason
        FROM req r LEFT JOIN cur c USING (hk, sk)),
    vote AS (SELECT tx, part, arg_min(reason, ord) FILTER (reason IS NOT NULL) AS reason FROM pre GROUP BY tx, part),
    dec AS (SELECT tx, arg_min(reason, part) FILTER (reason IS NOT NULL) AS reason FROM vote GROUP BY tx)"""


def _tx_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items without the second lines, which are absent."""
    return _line_items(spark, sf_dir).filter(F.col("sk") != F.lit(b"0002"))


def _prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = spark.createDataFrame([("p1", 900_000_000_000)], "partition_id string, max_deleted_ts long")
    return transactions.prepare_items(_tx_requests(spark, sf_dir), _tx_items(spark, sf_dir), _tx_locks(spark, sf_dir), marks, NOW_MS)


@query(f"WITH {TX} SELECT tx AS transaction_id, ord::INT AS ordinal, reason FROM pre")
def g_prepare_reason(spark, sf_dir):
    return _prepared(spark, sf_dir).select("transaction_id", "ordinal", "reason")


@query(f"WITH {TX} SELECT tx AS transaction_id, reason, CASE WHEN reason IS NULL THEN 'committed' ELSE 'cancelled' END AS outcome FROM dec")
def g_vote(spark, sf_dir):
    return transactions.decide(transactions.votes(_prepared(spark, sf_dir))).select("transaction_id", "reason", "outcome")


@query(f"""WITH {TX}, won AS (SELECT r.* FROM req r JOIN dec d ON r.tx = d.tx WHERE d.reason IS NULL),
    latest AS (SELECT hk, sk, arg_max(data, n) AS data FROM ln GROUP BY hk, sk)
    SELECT coalesce(c.hk, w.hk) AS hk, coalesce(c.sk, w.sk) AS sk, CASE WHEN w.op = 'put' THEN coalesce(c.v, 0) + 1 ELSE c.v END::BIGINT AS v, greatest(coalesce(c.lts, w.tts), coalesce(w.tts, c.lts))::BIGINT AS ts,
        CASE WHEN w.op = 'put' THEN w.prio ELSE l.data END AS data
    FROM cur c FULL JOIN won w ON c.hk = w.hk AND c.sk = w.sk LEFT JOIN latest l ON l.hk = c.hk AND l.sk = c.sk
    WHERE w.op IS NULL OR w.op = 'put' OR (w.op = 'check' AND c.v IS NOT NULL)""")
def g_commit_apply(spark, sf_dir):
    decisions = transactions.decide(transactions.votes(_prepared(spark, sf_dir)))
    got = transactions.apply_commits(_tx_items(spark, sf_dir), _tx_requests(spark, sf_dir), decisions)
    return got.select(_text("hk"), _text("sk"), "v", F.col("last_transaction_ts").alias("ts"), F.col("data_text").alias("data"))


@query("""WITH t AS (SELECT 'tx' || l_orderkey AS transaction_id, l_linenumber AS n, count(*) AS c FROM lineitem GROUP BY 1, 2)
    SELECT DISTINCT transaction_id, 'duplicate_key' AS problem FROM t WHERE c > 1 UNION SELECT DISTINCT transaction_id, 'data_not_allowed' FROM t WHERE n % 3 = 2
    UNION SELECT DISTINCT transaction_id, 'check_without_condition' FROM t WHERE n % 3 = 0""")
def g_validate(spark, sf_dir):
    """Orders' lines as requests, some against the rules."""
    n = F.col("l_linenumber")
    req = fixtures.table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("tx"), "l_orderkey").alias("transaction_id"),
        fixtures.key("ord#", F.col("l_orderkey").cast("string")).alias("hk"),
        fixtures.key(fixtures.padded("l_linenumber", 4)).alias("sk"),
        F.when(n % 3 == 0, "check").when(n % 3 == 1, "put").otherwise("delete").alias("operation"),
        F.when(n % 3 != 0, F.col("l_returnflag")).alias("data_text"),
        F.lit(None).cast("array<struct<type:string,value:bigint>>").alias("conditions"),
    )
    return conditions.invalid_operations(req)


@query("""SELECT 'tok' || o_orderkey AS token, CASE o_orderpriority WHEN '1-URGENT' THEN 'rejected' WHEN '2-HIGH' THEN 'created' ELSE 'resumed' END AS decision
    FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)""")
def g_idempotency(spark, sf_dir):
    """Requests seen before; urgent ones came with other data, high ones are new."""
    req = _tx_requests(spark, sf_dir)
    prio = fixtures.table(spark, sf_dir, "orders").select(F.concat(F.lit("tx"), "o_orderkey").alias("transaction_id"), "o_orderpriority")
    seen = req.join(prio.filter("o_orderpriority <> '2-HIGH'"), "transaction_id")
    was = seen.withColumn("data_text", F.when((F.col("o_orderpriority") == "1-URGENT"), F.concat(F.coalesce("data_text", F.lit("")), F.lit("!"))).otherwise(F.col("data_text")))
    token = F.concat(F.lit("tok"), F.substring("transaction_id", 3, 20))
    known = conditions.request_fingerprint(was).select(token.alias("token"), "transaction_id", "operations_hash", F.lit("COMMITTED").alias("state"))
    return transactions.resolve_tokens(req.withColumn("token", token), known).select("token", "decision")


@query(f"""WITH {LINES}, cur AS (SELECT hk, sk, count(*) AS v, max(ts) AS lts, arg_max(data, n) AS data FROM ln GROUP BY hk, sk),
    req AS (SELECT o_orderkey AS read_id, s.o::INT AS ordinal, 'ord#' || o_orderkey AS hk, s.k AS sk, o_orderpriority AS prio FROM orders, (VALUES (0, '0001'), (1, '0003'), (2, '0001'), (3, '9999')) s(o, k)),
    m AS (SELECT r.*, c.v, c.data, prio IN ('1-URGENT', '2-HIGH') AND sk = '0001' AS locked, prio = '5-LOW' AND c.v IS NOT NULL AS moved FROM req r LEFT JOIN cur c USING (hk, sk)),
    x AS (SELECT read_id, CASE WHEN bool_or(locked) THEN 'pending_write' WHEN bool_or(moved) THEN 'read_conflict' ELSE 'committed' END AS outcome FROM m GROUP BY read_id)
    SELECT m.read_id, ordinal, hk, sk, outcome, CASE WHEN outcome = 'committed' THEN v IS NOT NULL END AS found, CASE WHEN outcome = 'committed' THEN v END::BIGINT AS v, CASE WHEN outcome = 'committed' THEN data END AS data
    FROM m JOIN x USING (read_id)""")
def g_two_phase_read(spark, sf_dir):
    """Four keys of every order, one of them twice; low orders change between the phases."""
    o = fixtures.table(spark, sf_dir, "orders")
    keys_ = F.array(*[F.struct(F.lit(i).alias("ordinal"), F.encode(F.lit(k), "UTF-8").alias("sk")) for i, k in enumerate(("0001", "0003", "0001", "9999"))])
    req = o.select(F.col("o_orderkey").alias("read_id"), fixtures.key("ord#", F.col("o_orderkey").cast("string")).alias("hk"), F.inline(keys_))
    first = _line_items(spark, sf_dir)
    low = o.filter("o_orderpriority = '5-LOW'").select(fixtures.key("ord#", F.col("o_orderkey").cast("string")).alias("hk"), F.lit(True).alias("low"))
    second = first.join(low, "hk", "left").withColumn("v", F.col("v") + F.when(F.col("low"), 1).otherwise(0)).drop("low")
    got = transactions.two_phase_read(req, first, second, _tx_locks(spark, sf_dir))
    return got.select("read_id", "ordinal", _text("hk"), _text("sk"), "outcome", "found", "v", F.col("data_text").alias("data"))


@query(f"""SELECT DISTINCT CASE o_orderpriority WHEN '1-URGENT' THEN 'tx' || o_orderkey ELSE 'tx-other' END AS transaction_id FROM orders
    WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND (epoch_us(o_orderdate) // 1000) < {NOW_MS} - 5000""")
def d_stale_distinct(spark, sf_dir):
    return transactions.stale_transactions(_tx_locks(spark, sf_dir), NOW_MS)


@query(f"""WITH s AS (SELECT DISTINCT CASE o_orderpriority WHEN '1-URGENT' THEN 'tx' || o_orderkey ELSE 'tx-other' END AS t FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND (epoch_us(o_orderdate) // 1000) < {NOW_MS} - 5000)
    SELECT t AS transaction_id, CASE WHEN o_orderstatus IS NULL THEN 'cancel' WHEN o_orderstatus = 'F' THEN 'commit' WHEN o_orderstatus = 'O' THEN 'wait' ELSE 'cancel' END AS action
    FROM s LEFT JOIN orders ON t = 'tx' || o_orderkey""")
def k_stale_recovery(spark, sf_dir):
    state = F.when(F.col("o_orderstatus") == "F", "PREPARED").when(F.col("o_orderstatus") == "O", "PREPARING").otherwise("CANCELLING")
    tx = fixtures.table(spark, sf_dir, "orders").select(F.concat(F.lit("tx"), "o_orderkey").alias("transaction_id"), state.alias("state"))
    return transactions.recover(transactions.stale_transactions(_tx_locks(spark, sf_dir), NOW_MS), tx)


# ------------------------------------------------------------------------ functions


@query("""SELECT p_partkey, hex(encode(p_name)) AS text_key, 'FF' || hex(encode(p_brand)) AS binary_key, p_name AS text_back, p_brand AS binary_back FROM part""")
def b_keycodec(spark, sf_dir):
    p = fixtures.table(spark, sf_dir, "part")
    k = p.select("p_partkey", keys.encode_text(F.col("p_name")).alias("t"), keys.encode_binary(F.encode("p_brand", "UTF-8")).alias("b"))
    return k.select("p_partkey", F.hex("t").alias("text_key"), F.hex("b").alias("binary_key"), keys.decode_text(F.col("t")).alias("text_back"), F.decode(keys.decode_binary(F.col("b")), "UTF-8").alias("binary_back"))


@query("""SELECT p_partkey, hex(encode(substr(p_name, 1, length(p_name) - 1) || chr(ascii(right(p_name, 1)) + 1))) AS successor FROM part""")
def b_successor(spark, sf_dir):
    return fixtures.table(spark, sf_dir, "part").select("p_partkey", F.hex(keys.successor_column(F.encode("p_name", "UTF-8"))).alias("successor"))


@query("""WITH n AS (SELECT DISTINCT p_name AS hi FROM part), l AS (SELECT hi, lag(hi) OVER (ORDER BY hi) AS lo FROM n)
    SELECT hi, substr(hi, 1, 1 + (SELECT count(*) FROM range(1, 100) t(i) WHERE i <= least(length(lo), length(hi)) AND substr(hi, 1, i::INT) = substr(lo, 1, i::INT))::INT) AS separator FROM l WHERE lo IS NOT NULL""")
def b_separator(spark, sf_dir):
    """Between each part name and the one before it."""
    n = fixtures.table(spark, sf_dir, "part").select(F.encode("p_name", "UTF-8").alias("hi")).distinct()
    first = n.withColumn("block", F.substring("hi", 1, 6))  # neighbours inside a block, and the last of the block before
    tops = first.groupBy("block").agg(F.max("hi").alias("top")).select("block", F.lag("top").over(Window.orderBy("block")).alias("top"))
    pairs = first.join(tops, "block").withColumn("lo", F.coalesce(F.lag("hi").over(Window.partitionBy("block").orderBy("hi")), "top")).filter("lo is not null")
    return pairs.select(F.decode("hi", "UTF-8").alias("hi"), F.decode(keys.separator_column(F.col("lo"), F.col("hi")), "UTF-8").alias("separator"))


@query("""SELECT event_id, CASE WHEN json_valid(props) AND json_type(props) IN ('OBJECT', 'ARRAY') THEN 2 ELSE 1 END::INT AS kind, (strlen(props))::BIGINT AS octets, (2 * length(props) + 5 + strlen(user_id::VARCHAR) + 26 + 72)::BIGINT AS page_bytes FROM events""")
def b_data_kinds(spark, sf_dir):
    e = fixtures.table(spark, sf_dir, "events")
    k = e.select("event_id", "props", fixtures.key("user#", F.col("user_id").cast("string")).alias("hk"), fixtures.key(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")).alias("sk"))
    none = F.lit(None).cast("binary")
    return k.select("event_id", sizes.kind_of(F.col("props")).cast("int").alias("kind"), sizes.data_octets(none, F.col("props")).alias("octets"), sizes.page_bytes(F.col("hk"), F.col("sk"), none, F.col("props")).cast("long").alias("page_bytes"))


@query("""WITH l AS (SELECT i::INT AS layer, (1024 * pow(2, i))::BIGINT AS capacity, 0.01 * pow(0.5, i + 1) AS e FROM range(9) t(i)),
    b AS (SELECT *, ceil(-capacity * ln(e) / pow(ln(2), 2))::BIGINT AS bits FROM l)
    SELECT layer, capacity, bits, round(bits / capacity * ln(2))::BIGINT AS hashes, ceil(bits / 8)::BIGINT AS bytes, sum(ceil(bits / 8)) OVER (ORDER BY layer)::BIGINT AS bytes_so_far FROM b""")
def j_bloom_sizing(spark, sf_dir):
    return bloom.sizing(spark, 1024, 0.01, 9)


from lodekey import catalogue_more  # noqa: E402, F401  registers the rest
