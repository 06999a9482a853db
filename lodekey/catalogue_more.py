"""Registered queries on identities, listings, states and measures, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodekey.catalogue import DOC, LINES, NOW_MS, ORD, TX, _bucket_sql, _line_items, _prepared, _text, _tx_locks, _tx_requests, query
from lodekey.functions import hashing, keys, learned, sizes
from lodekey.functions import partition_ids as ids
from lodekey.operators import coordinator, points, splits, stats, topology, transactions
from lodekey.operators.query import SubQuery, query_items
from lodekey.plans.intervals import Condition
from lodekey.sources import fixtures
from lodekey.sources.written import written
from lodekey.streaming.upserts import once_per_token, watermark_stream

# -------------------------------------------------------------------- identities


def _hex_name(s: str) -> str:
    byte = f"substr(hex(encode({s})), (2 * i + 1)::INT, 2)"
    return f"""CASE WHEN strlen({s}) = 0 THEN '' ELSE array_to_string(list_transform(range(strlen({s})), lambda i:
        CASE WHEN {byte} BETWEEN '21' AND '7D' AND {byte} NOT IN ('22', '25', '2E', '5C') THEN chr(('0x' || {byte})::INT) ELSE '%' || {byte} END), '') END"""


@query(f"""WITH p AS (SELECT p_partkey, p_name || ' ~%.\\"' || p_brand || 'é' AS s FROM part) SELECT p_partkey, {_hex_name("s")} AS name FROM p""")
def b23_name_parts(spark, sf_dir):
    odd = F.concat("p_name", F.lit(' ~%.\\"'), "p_brand", F.lit("é"))
    return fixtures.table(spark, sf_dir, "part").select("p_partkey", ids.name_part_column(F.encode(odd, "UTF-8")).alias("name"))


HASH_IDS = f"""{ORD}, k AS (SELECT DISTINCT hk, substr(hk, 6)::INT % 3 AS d, {_bucket_sql(0, 10)} * 97 AS r, {_bucket_sql(1, 4)} AS c1, {_bucket_sql(2, 4)} AS c2 FROM ord),
    i AS (SELECT *, '00' || format('{{:04x}}', r) || format('{{:02x}}', d) || CASE WHEN d > 0 THEN format('{{:02x}}', c1) ELSE '' END || CASE WHEN d > 1 THEN format('{{:02x}}', c2) ELSE '' END AS id FROM k)"""


def _hash_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A partition for each customer with orders, none to two levels below a root."""
    k = fixtures.orders(spark, sf_dir).select("hk").distinct()
    depth = (keys.decode_text(F.col("hk")).substr(6, 20).cast("int") % 3).alias("d")
    path = F.slice(F.array(hashing.bucket(F.col("hk"), 1, 4), hashing.bucket(F.col("hk"), 2, 4)), F.lit(1), F.col("d"))
    return k.select("hk", depth).select("hk", ids.hash_id(hashing.bucket(F.col("hk"), 0, 10) * 97, path).alias("id"))


@query(f"""WITH {HASH_IDS} SELECT hk, id, r::INT AS root, d::INT AS depth, CASE WHEN d = 1 THEN c1 WHEN d = 2 THEN c2 END::INT AS last_child, false AS is_range,
    't.h.' || r || CASE WHEN d > 0 THEN '.' || c1 ELSE '' END || CASE WHEN d > 1 THEN '.' || c2 ELSE '' END AS name FROM i""")
def b24_hash_ids(spark, sf_dir):
    i = F.col("id")
    return _hash_ids(spark, sf_dir).select(_text("hk"), "id", ids.root_number(i).alias("root"), ids.hash_depth(i).alias("depth"), ids.last_child(i).alias("last_child"), ids.is_range(i).alias("is_range"), ids.hash_name("t", i).alias("name"))


@query(f"""WITH {HASH_IDS} SELECT hk, n::INT AS n, substr(id, 1, 6) || format('{{:02x}}', d + 1) || substr(id, 9) || format('{{:02x}}', n) AS child FROM i, range(4) t(n)""")
def o16_child_ids(spark, sf_dir):
    return _hash_ids(spark, sf_dir).select(_text("hk"), F.posexplode(ids.child_ids(F.col("id"), 4)).alias("n", "child"))


RANGE_IDS = """p AS (SELECT p_partkey, p_brand AS hk, CASE WHEN p_partkey % 3 > 0 THEN p_name END AS lo, CASE WHEN p_partkey % 2 > 0 THEN p_name || 'x' END AS hi FROM part)"""


def _range_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, n = fixtures.table(spark, sf_dir, "part"), F.encode("p_name", "UTF-8")
    return p.select("p_partkey", fixtures.key(F.col("p_brand")).alias("hk"), F.when(F.col("p_partkey") % 3 > 0, n).alias("lo"), F.when(F.col("p_partkey") % 2 > 0, fixtures.key(F.col("p_name"), "x")).alias("hi"))


@query(f"""WITH {RANGE_IDS} SELECT p_partkey, hk AS hk_back, lo AS lo_back, hi AS hi_back,
        '01' || format('{{:02x}}', CASE WHEN lo IS NULL THEN 0 ELSE 1 END + CASE WHEN hi IS NULL THEN 0 ELSE 2 END) || format('{{:02x}}', strlen(hk)) || '000000' || format('{{:02x}}', coalesce(strlen(lo), 0)) || '000000' || lower(hex(encode(hk || coalesce(lo, '') || coalesce(hi, '')))) AS id,
        't.r.' || {_hex_name("hk")} || '.' || CASE WHEN lo IS NULL THEN '~min' ELSE {_hex_name("lo")} END || '.' || CASE WHEN hi IS NULL THEN '~max' ELSE {_hex_name("hi")} END AS name FROM p""")
def b24_range_ids(spark, sf_dir):
    p = _range_ids(spark, sf_dir).withColumn("id", ids.range_id(F.col("hk"), F.col("lo"), F.col("hi")))
    p = p.withColumn("b", ids.range_parts(F.col("id")))
    back = [F.decode(f"b.{a}", "UTF-8").alias(f"{b}_back") for a, b in (("hk", "hk"), ("start", "lo"), ("end", "hi"))]
    return p.select("p_partkey", "id", ids.range_name("t", F.col("hk"), F.col("lo"), F.col("hi")).alias("name"), *back)


@query("SELECT i::INT AS root, '00' || format('{:04x}', i) || '00' AS partition_id, 't.h.' || i AS name FROM range(300) t(i)")
def o15_roots(spark, sf_dir):
    return ids.roots(spark, 300, "t")


@query("""WITH p AS (SELECT p_partkey, p_name AS t, p_brand AS b, p_partkey % 3 AS k FROM part)
    SELECT p_partkey, CASE k WHEN 0 THEN t || ' / ~absent' WHEN 1 THEN t || ' / b64:' || base64(encode(b)) ELSE 'b64:' || base64(encode(b)) || ' / ' || t END AS shown FROM p""")
def b7_shown_pairs(spark, sf_dir):
    t, b, k = F.encode("p_name", "UTF-8"), keys.encode_binary(F.encode("p_brand", "UTF-8")), F.col("p_partkey") % 3
    pair = keys.show_pair_column(F.when(k == 2, b).otherwise(t), F.when(k == 0, F.lit(b"")).when(k == 1, b).otherwise(t))
    return fixtures.table(spark, sf_dir, "part").select("p_partkey", pair.alias("shown"))


@query("""SELECT doc_id, CASE WHEN coalesce(text, '') = '' THEN 'empty' WHEN contains(text, chr(0)) THEN 'holds_nul' WHEN strlen(text) > 1024 THEN 'too_long' END AS problem FROM documents""")
def c14_key_problems(spark, sf_dir):
    return fixtures.table(spark, sf_dir, "documents").select("doc_id", keys.key_problem(F.col("text"), 1024).alias("problem"))


@query("""SELECT p_partkey, p_partkey % 7 AS depth, xor(2654435761, ((p_partkey % 7) * 2246822519) & 4294967295)::BIGINT AS seed FROM part""")
def b11_depth_seeds(spark, sf_dir):
    depth = F.col("p_partkey") % 7
    step = (depth * F.lit(hashing.DEPTH_STEP).cast("long")).bitwiseAND(F.lit(0xFFFFFFFF))
    return fixtures.table(spark, sf_dir, "part").select("p_partkey", depth.alias("depth"), F.lit(hashing.SEED).cast("long").bitwiseXOR(step).alias("seed"))


_MOD = "4294967296"
_ROT = lambda h, n: f"(({h} * {2**n}) % {_MOD} + {h} // {2 ** (32 - n)})"
_MIX = lambda h, s: f"xor(({h})::BIGINT, ({h})::BIGINT >> {s})"


def _xxh32_sql(seed: int) -> str:
    """XXH32 of keys of under 16 bytes, step by step."""
    lane = "('0x' || substr(x, (8 * i + 7)::INT, 2) || substr(x, (8 * i + 5)::INT, 2) || substr(x, (8 * i + 3)::INT, 2) || substr(x, (8 * i + 1)::INT, 2))::BIGINT"
    lanes = f"list_transform(range(n // 4), lambda i: {lane}::HUGEINT)"
    rest = "list_transform(range(n - n % 4, n), lambda i: ('0x' || substr(x, (2 * i + 1)::INT, 2))::BIGINT::HUGEINT)"
    a = f"list_reduce(list_prepend((({seed}::HUGEINT + 374761393 + n) % {_MOD})::HUGEINT, {lanes}), lambda h, c: ({_ROT(f'((h + c * 3266489917) % {_MOD})', 17)} * 668265263) % {_MOD})"
    b = f"list_reduce(list_prepend(({a})::HUGEINT, {rest}), lambda h, c: ({_ROT(f'((h + c * 374761393) % {_MOD})', 11)} * 2654435761) % {_MOD})"
    return b


@query(f"""WITH {ORD}, k AS (SELECT DISTINCT hk, hex(encode(hk)) AS x, strlen(hk) AS n FROM ord),
    h AS (SELECT hk, {_xxh32_sql(hashing.seed_for_depth(0))} AS a, {_xxh32_sql(hashing.seed_for_depth(1))} AS b FROM k),
    h2 AS (SELECT hk, ({_MIX("a", 15)}::HUGEINT * 2246822519) % {_MOD} AS a, ({_MIX("b", 15)}::HUGEINT * 2246822519) % {_MOD} AS b FROM h),
    h3 AS (SELECT hk, ({_MIX("a", 13)}::HUGEINT * 3266489917) % {_MOD} AS a, ({_MIX("b", 13)}::HUGEINT * 3266489917) % {_MOD} AS b FROM h2)
    SELECT hk, ({_MIX("a", 16)} % 10)::BIGINT AS root, ({_MIX("b", 16)} % 4)::BIGINT AS child FROM h3""")
def b_xxh32_placement(spark, sf_dir):
    """Root and child by XXH32, as other stores of this model place keys."""
    k = fixtures.orders(spark, sf_dir).select("hk").distinct()
    return k.select(_text("hk"), (hashing.xxh32_column(F.col("hk"), F.lit(0)) % 10).alias("root"), (hashing.xxh32_column(F.col("hk"), F.lit(1)) % 4).alias("child"))


# ----------------------------------------------------------------------- measures


@query(f"""WITH {ORD} SELECT hk, sk, (strlen(hk) + strlen(sk) + 2 * length(data) + 72 + 2 * length('[{{"type":"item_exists"}}]'))::BIGINT AS bytes FROM ord""")
def b18_pending_bytes(spark, sf_dir):
    o = fixtures.orders(spark, sf_dir)
    return o.select(_text("hk"), _text("sk"), sizes.pending_bytes(F.col("hk"), F.col("sk"), F.col("data_bin"), F.col("data_text"), F.lit('[{"type":"item_exists"}]')).cast("long").alias("bytes"))


@query("""SELECT doc_id, (length(text) + length(regexp_replace(text, '[^\\x{10000}-\\x{10FFFF}]', '', 'g')))::BIGINT AS units FROM documents""")
def b19_utf16_units(spark, sf_dir):
    return fixtures.table(spark, sf_dir, "documents").select("doc_id", sizes.utf16_units(F.col("text")).alias("units"))


@query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '{"encoding":"base64","data":"' || base64(encode(p_brand)) || '"}' WHEN 1 THEN '{"encoding":"utf8","data":"' || p_name || '"}'
    ELSE '{"encoding":"json","data":"[' || p_size || ']"}' END AS shown FROM part""")
def b26_shown_data(spark, sf_dir):
    kind = F.col("p_partkey") % 3
    text = F.when(kind == 1, F.col("p_name")).when(kind == 2, F.concat(F.lit("["), "p_size", F.lit("]")))
    return fixtures.table(spark, sf_dir, "part").select("p_partkey", sizes.shown_data(kind, F.encode("p_brand", "UTF-8"), text).alias("shown"))


@query(f"""WITH {ORD} SELECT hk, least(count(*), 5)::BIGINT AS n FROM ord GROUP BY hk""")
def e4_bounded_count(spark, sf_dir):
    return stats.bounded_count(fixtures.orders(spark, sf_dir), 5).select(_text("hk"), "n")


# ----------------------------------------------------------------------- pages

VISITED = f"""WITH {ORD}, m AS (SELECT *, row_number() OVER (ORDER BY sk) AS rk FROM ord WHERE hk = 'cust#1' AND sk >= 'order#1996-06' AND sk < 'order#1999')"""


def _visits(spark: SparkSession, sf_dir: str):
    """A page of one customer's orders over leaves by year, of which it may visit three."""
    years = [(b"cust#1", f"order#{y}".encode() if y > 1993 else b"", f"order#{y + 1}".encode() if y < 2003 else b"") for y in range(1993, 2004)]
    leaves = spark.createDataFrame(years, "hk binary, start binary, end binary")
    return query_items(fixtures.orders(spark, sf_dir), [SubQuery("cust#1", Condition("gte", "order#1996-06")), SubQuery("cust#2")], leaves=leaves, max_visits=3)


@query(f"{VISITED} SELECT 0::INT AS qi, rk::BIGINT AS pos, hk, sk, data FROM m")
def f_visits_page(spark, sf_dir):
    return _visits(spark, sf_dir).rows.select("qi", "pos", _text("hk"), _text("sk"), F.col("data_text").alias("data"))


@query(f"{VISITED} SELECT count(*)::BIGINT AS rows_read, count(*)::BIGINT AS rows_returned, 1::BIGINT AS sub_queries, 3::BIGINT AS partitions_visited, 0::BIGINT AS next_query, 'order#1999' AS next_key, true AS next_included FROM m")
def e_query_meta(spark, sf_dir):
    page = _visits(spark, sf_dir)
    c, m = page.next_cursor(), page.metrics()
    return spark.createDataFrame([(*m.values(), c.index, c.after.decode(), c.included)], ", ".join(f"{k} long" for k in m) + ", next_query long, next_key string, next_included boolean")


# -------------------------------------------------------------------------- locks

LOCKS = f"""locks AS (SELECT 'ord#' || o_orderkey AS hk, '0001' AS sk, CASE o_orderpriority WHEN '1-URGENT' THEN 'tx' || o_orderkey ELSE 'tx-other' END AS tx, (epoch_us(o_orderdate) // 1000) AS ts, o_orderpriority AS data
    FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH'))"""


@query(f"WITH {LOCKS} SELECT 'ord#' || o_orderkey AS hk, '0001' AS sk, l.tx AS holder FROM orders LEFT JOIN locks l ON l.hk = 'ord#' || o_orderkey")
def d9_locks(spark, sf_dir):
    wanted = fixtures.table(spark, sf_dir, "orders").select(fixtures.key("ord#", F.col("o_orderkey").cast("string")).alias("hk"), F.encode(F.lit("0001"), "UTF-8").alias("sk"))
    return transactions.locks_on(_tx_locks(spark, sf_dir), wanted).select(_text("hk"), _text("sk"), "holder")


@query(f"WITH {LOCKS} SELECT hk, sk, tx AS transaction_id, ts::BIGINT AS ts, 'put' AS operation, data, count(*) OVER (PARTITION BY tx)::BIGINT AS of_transaction, count(*) OVER (PARTITION BY hk)::BIGINT AS of_key FROM locks WHERE tx = 'tx-other' OR substr(tx, 3)::BIGINT % 3 = 0")
def d10_pending_lists(spark, sf_dir):
    """What some transactions hold, with the locks of each transaction and key."""
    locks = _tx_locks(spark, sf_dir)
    some = locks.select("transaction_id").distinct().filter((F.col("transaction_id") == "tx-other") | (F.substring("transaction_id", 3, 20).try_cast("long") % 3 == 0))
    got = transactions.locks_of(locks, some)
    got = got.join(transactions.lock_counts(locks), "transaction_id").join(transactions.pending_counts(locks).select("hk", F.col("locks").alias("of_key")), "hk")
    return got.select(_text("hk"), _text("sk"), "transaction_id", F.col("transaction_ts").alias("ts"), "operation", F.col("data_text").alias("data"), F.col("locks").alias("of_transaction"), "of_key")


@query(f"WITH {LOCKS} SELECT hk, sk, tx AS transaction_id FROM locks WHERE (hk, sk, tx) > ('ord#2', '0001', 'a') ORDER BY hk, sk, tx LIMIT 50")
def d11_pending_page(spark, sf_dir):
    got = transactions.pending_page(_tx_locks(spark, sf_dir), 50, (b"ord#2", b"0001", "a"))
    return got.select(_text("hk"), _text("sk"), "transaction_id")


@query(f"WITH {LOCKS} SELECT hk, sk FROM locks WHERE tx <> 'tx-other'")
def d12_released(spark, sf_dir):
    done = spark.createDataFrame([("tx-other",)], "transaction_id string")
    return transactions.release(_tx_locks(spark, sf_dir), done).select(_text("hk"), _text("sk"))


@query(f"""WITH {TX} SELECT r.tx AS transaction_id, r.hk, r.sk, r.op AS operation, CASE WHEN r.op = 'put' THEN r.prio END AS data FROM req r JOIN dec d ON r.tx = d.tx
    WHERE d.reason IS NULL AND NOT (r.sk = '0001' AND r.prio = '1-URGENT')""")
def g4_new_locks(spark, sf_dir):
    prepared = _prepared(spark, sf_dir)
    got = transactions.new_locks(prepared, transactions.decide(transactions.votes(prepared)), NOW_MS)
    return got.select("transaction_id", _text("hk"), _text("sk"), "operation", F.col("data_text").alias("data"))


@query(f"""WITH {TX}, {LOCKS}, a AS (SELECT tx, hk, sk FROM req WHERE prio = '1-URGENT'), b AS (SELECT tx, hk, sk FROM locks WHERE tx <> 'tx-other')
    SELECT DISTINCT tx AS transaction_id FROM ((SELECT * FROM a EXCEPT SELECT * FROM b) UNION (SELECT * FROM b EXCEPT SELECT * FROM a))""")
def g4_locks_mismatch(spark, sf_dir):
    """Urgent orders lock their first line only, so those of several lines don't match."""
    urgent = fixtures.table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").select(F.concat(F.lit("tx"), "o_orderkey").alias("transaction_id"))
    mine = _tx_requests(spark, sf_dir).join(urgent, "transaction_id", "left_semi")
    return transactions.locks_match(_tx_locks(spark, sf_dir).filter("transaction_id <> 'tx-other'"), mine)


@query(f"""WITH {TX}, w AS (SELECT part, tts FROM req r JOIN dec d ON r.tx = d.tx WHERE d.reason IS NULL AND r.op = 'delete' UNION ALL SELECT 'p1', 900000000000)
    SELECT part AS partition_id, max(tts)::BIGINT AS max_deleted_ts FROM w GROUP BY part""")
def k4_moved_watermarks(spark, sf_dir):
    marks = spark.createDataFrame([("p1", 900_000_000_000)], "partition_id string, max_deleted_ts long")
    decisions = transactions.decide(transactions.votes(_prepared(spark, sf_dir)))
    return transactions.moved_watermarks(marks, _tx_requests(spark, sf_dir), decisions)


@query(f"""SELECT 'tx' || o_orderkey AS transaction_id FROM orders WHERE o_orderstatus <> 'F' AND (epoch_us(o_orderdate) // 1000) <= {NOW_MS} - 5000 ORDER BY o_orderdate, transaction_id LIMIT 100""")
def c18_unfinished(spark, sf_dir):
    state = F.when(F.col("o_orderstatus") == "F", "COMMITTED").otherwise("PREPARING")
    tx = fixtures.table(spark, sf_dir, "orders").select(F.concat(F.lit("tx"), "o_orderkey").alias("transaction_id"), state.alias("state"), F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("created_at"))
    return transactions.unfinished(tx, NOW_MS).select("transaction_id")


# -------------------------------------------------------------------- coordinators


def _coordinated(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The table of orders' transactions, half of them begun, and their participants with votes."""
    req = _tx_requests(spark, sf_dir)
    none = spark.createDataFrame([], "transaction_id string, transaction_ts long, operations_hash string, state string, reason string, created_at long")
    made = coordinator.create(coordinator.create(none, req, NOW_MS), req, NOW_MS + 1)
    begun = made.filter(F.substring("transaction_id", 3, 20).cast("long") % 2 == 0).select("transaction_id", F.lit("PREPARING").alias("to_state"), F.lit(None).cast("string").alias("reason"))
    voters = coordinator.participants(req).withColumns({"vote": F.lit(None).cast("string"), "done": F.lit(False)})
    cast = transactions.votes(_prepared(spark, sf_dir)).select("transaction_id", "partition_id", F.coalesce("reason", F.lit("yes")).alias("vote"), F.lit(1).alias("attempt"))
    return coordinator.advance(made, begun).drop("moved"), coordinator.record_votes(voters, cast)


@query(f"""WITH {TX} SELECT tx AS transaction_id, CASE WHEN substr(tx, 3)::BIGINT % 2 = 1 THEN 'PREPARING' WHEN reason IS NULL THEN 'PREPARED' ELSE 'CANCELLING' END AS state, CASE WHEN substr(tx, 3)::BIGINT % 2 = 0 THEN reason END AS reason, {NOW_MS}::BIGINT AS created_at FROM dec""")
def g6_commit_states(spark, sf_dir):
    """After each transaction's next step; tables made twice are made once."""
    made, voters = _coordinated(spark, sf_dir)
    return coordinator.advance(made, coordinator.next_steps(made, voters)).select("transaction_id", "state", "reason", "created_at")


@query("""WITH s AS (SELECT 'tx' || o_orderkey AS t, CASE o_orderkey % 7 WHEN 0 THEN 'CREATED' WHEN 1 THEN 'PREPARING' WHEN 2 THEN 'PREPARED' WHEN 3 THEN 'COMMITTING' WHEN 4 THEN 'CANCELLING' WHEN 5 THEN 'COMMITTED' ELSE 'CANCELLED' END AS a,
        CASE (o_orderkey // 7) % 7 WHEN 0 THEN 'CREATED' WHEN 1 THEN 'PREPARING' WHEN 2 THEN 'PREPARED' WHEN 3 THEN 'COMMITTING' WHEN 4 THEN 'CANCELLING' WHEN 5 THEN 'COMMITTED' ELSE 'CANCELLED' END AS b FROM orders),
    m AS (SELECT *, (a, b) IN (('CREATED', 'PREPARING'), ('PREPARING', 'PREPARED'), ('PREPARING', 'CANCELLING'), ('PREPARED', 'COMMITTING'), ('COMMITTING', 'COMMITTED'), ('CANCELLING', 'CANCELLED')) AS ok FROM s)
    SELECT t AS transaction_id, CASE WHEN ok THEN b ELSE a END AS state, ok AS moved FROM m""")
def g13_guarded_states(spark, sf_dir):
    """Every state asked to become every other."""
    names = F.array(*[F.lit(x) for x in ("CREATED", "PREPARING", "PREPARED", "COMMITTING", "CANCELLING", "COMMITTED", "CANCELLED")])
    o = fixtures.table(spark, sf_dir, "orders").select(F.concat(F.lit("tx"), "o_orderkey").alias("transaction_id"), names[(F.col("o_orderkey") % 7).cast("int")].alias("state"), names[(F.expr("o_orderkey div 7") % 7).cast("int")].alias("to_state"), F.lit(None).cast("string").alias("reason"))
    return coordinator.advance(o.select("transaction_id", "state", "reason"), o.select("transaction_id", "to_state", "reason")).select("transaction_id", "state", "moved")


@query(f"""WITH {TX} SELECT tx AS transaction_id, part AS partition_id, count(*)::BIGINT AS items FROM req GROUP BY tx, part""")
def e11_participants(spark, sf_dir):
    return coordinator.participants(_tx_requests(spark, sf_dir))


# ------------------------------------------------------------- promotions and splits

PROMOTED = """pr AS (SELECT 'cust#' || c_custkey AS hk, CASE c_custkey % 4 WHEN 0 THEN 'queued' WHEN 1 THEN 'promoting' ELSE 'promoted' END AS status, c_custkey % 4 = 3 AS gc, 1::BIGINT AS upd FROM customer WHERE c_custkey % 5 = 0)"""


def _promoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, k = fixtures.table(spark, sf_dir, "customer").filter("c_custkey % 5 = 0"), F.col("c_custkey") % 4
    return c.select(fixtures.key("cust#", F.col("c_custkey").cast("string")).alias("hk"), F.when(k == 0, "queued").when(k == 1, "promoting").otherwise("promoted").alias("status"), F.lit(1).cast("long").alias("updated_at"), (k == 3).alias("gc_done"))


@query(f"""WITH {PROMOTED}, n AS (SELECT 'cust#' || c_custkey AS hk, 'queued' AS status, false AS gc, 2::BIGINT AS upd FROM customer WHERE c_custkey % 3 = 0),
    i AS (SELECT * FROM pr UNION ALL SELECT * FROM n WHERE hk NOT IN (SELECT hk FROM pr))
    SELECT hk, CASE WHEN status = 'queued' THEN 'promoting' ELSE status END AS status, CASE WHEN status = 'queued' THEN 3 ELSE upd END::BIGINT AS updated_at, status = 'queued' AS updated FROM i""")
def d15_promotions(spark, sf_dir):
    """Keys queued where they aren't known, then queued ones set to promoting."""
    new = fixtures.table(spark, sf_dir, "customer").filter("c_custkey % 3 = 0").select(fixtures.key("cust#", F.col("c_custkey").cast("string")).alias("hk"), F.lit("queued").alias("status"))
    table = topology.insert_promotions(_promoted(spark, sf_dir), new, 2)
    moves = table.select("hk", F.lit("queued").alias("from_status"), F.lit("promoting").alias("to_status"))
    return topology.guarded_transition(table, moves, 3).select(_text("hk"), "status", "updated_at", "updated")


@query(f"""WITH {PROMOTED} SELECT hk, status, status IN ('queued', 'promoting') AS in_flight, status = 'promoted' AND NOT gc AND hk > 'cust#2' AS needs_gc FROM pr ORDER BY hk LIMIT 200""")
def o10_promotion_reads(spark, sf_dir):
    """A page of keys, which are on their way, and which still need their old rows dropped."""
    table = _promoted(spark, sf_dir)
    done = table.filter(F.col("hk") <= F.lit(b"cust#2")).select("hk")
    gc = topology.needing_gc(topology.mark_gc_done(table, done)).select("hk", F.lit(True).alias("g"))
    flying = topology.in_flight(table).select("hk", F.lit(True).alias("f"))
    got = topology.promoted_page(table, 200).join(flying, "hk", "left").join(gc, "hk", "left")
    return got.select(_text("hk"), "status", F.coalesce("f", F.lit(False)).alias("in_flight"), F.coalesce("g", F.lit(False)).alias("needs_gc"))


@query(f"""WITH {DOC}, h AS (SELECT hk, sum(est) AS b FROM doc GROUP BY hk), w AS (SELECT * FROM (VALUES ('de', 'promoted'), ('en', 'queued')) t(hk, s))
    SELECT hk FROM h WHERE b >= 0.25 * 10000 AND hk NOT IN (SELECT hk FROM w WHERE s = 'promoted') AND hk <> 'fr'""")
def i9_promotable(spark, sf_dir):
    heavy = stats.heavy_keys(stats.key_sizes(fixtures.documents(spark, sf_dir)), 10_000)
    known = spark.createDataFrame([(b"de", "promoted"), (b"en", "queued")], "hk binary, status string")
    return topology.promotions(heavy, known, spark.createDataFrame([(b"fr",)], "hk binary")).select(_text("hk"))


@query(f"""WITH {ORD}, b AS (SELECT *, {_bucket_sql(0, 10)} AS r, {_bucket_sql(1, 4)} AS c1, {_bucket_sql(2, 4)} AS c2, substr(hk, 6)::BIGINT AS c FROM ord)
    SELECT hk, sk, CASE WHEN c % 5 = 0 AND c % 4 > 0 THEN 't.r.' || hk || CASE WHEN sk < 'order#1998' THEN '.~min.order#1998' ELSE '.order#1998.~max' END
        ELSE 't.h.' || r || CASE WHEN r % 2 = 0 THEN '.' || c1 || CASE WHEN c1 = 0 THEN '.' || c2 ELSE '' END ELSE '' END END AS partition FROM b""")
def h6_routed(spark, sf_dir):
    """Orders by the way that promotions and splits leave them."""
    names = [(f"h.{r}",) for r in range(0, 10, 2)] + [(f"h.{r}.0",) for r in range(0, 10, 2)]
    p, cut = _promoted(spark, sf_dir), b"order#1998"
    leaves = p.select("hk", F.inline(F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in ((b"", cut), (cut, b""))])))
    return topology.route(fixtures.orders(spark, sf_dir), 10, 4, spark.createDataFrame(names, "name string"), p, leaves, "t").select(_text("hk"), _text("sk"), "partition")


@query(f"WITH {ORD} SELECT hk, sk FROM ord WHERE {_bucket_sql(2, 4)} = 3")
def h3_child_rows(spark, sf_dir):
    return topology.owned_by_child(fixtures.orders(spark, sf_dir), 1, 4, 3).select(_text("hk"), _text("sk"))


@query("""WITH p AS (SELECT p_partkey, p_name AS a, CASE WHEN p_partkey % 3 > 0 THEN p_name || 'z' ELSE '' END AS b, CASE WHEN p_partkey % 2 > 0 THEN substr(p_name, 1, 3) ELSE p_name END AS x, CASE WHEN p_partkey % 4 > 0 THEN p_name || 'z' ELSE '' END AS y FROM part)
    SELECT p_partkey, a >= x AND (y = '' OR (b <> '' AND b <= y)) AND NOT (a = x AND b = y) AS inside FROM p""")
def h11_strict_slices(spark, sf_dir):
    n, k = F.col("p_name"), F.col("p_partkey")
    as_key = lambda c: F.encode(c, "UTF-8")
    z, none = F.concat(n, F.lit("z")), F.lit("")
    inside = topology.is_strict_slice(as_key(n), as_key(F.when(k % 3 > 0, z).otherwise(none)), as_key(F.when(k % 2 > 0, F.substring(n, 1, 3)).otherwise(n)), as_key(F.when(k % 4 > 0, z).otherwise(none)))
    return fixtures.table(spark, sf_dir, "part").select("p_partkey", inside.alias("inside"))


@query("""WITH known AS (SELECT DISTINCT p_brand AS hk, p_size % 5 AS depth, p_type AS lo FROM part WHERE p_partkey % 2 = 0), new AS (SELECT DISTINCT p_brand, p_size % 5, p_type FROM part), h AS (SELECT * FROM known UNION SELECT * FROM new)
    SELECT hk, depth::INT AS depth, lo, row_number() OVER (PARTITION BY hk ORDER BY depth, lo)::INT AS nth FROM h WHERE depth < 3""")
def d16_ancestors(spark, sf_dir):
    """Slices learned on top of known ones, then those above depth three."""
    s = fixtures.table(spark, sf_dir, "part").select("p_partkey", F.encode("p_brand", "UTF-8").alias("hk"), (F.col("p_size") % 5).cast("int").alias("depth"), F.encode("p_type", "UTF-8").alias("sk_start_boundary"), F.lit(b"").alias("sk_end_boundary"))
    known = topology.learn_slices(s.filter("false"), s.filter("p_partkey % 2 = 0"))
    got = topology.ancestors_above(topology.learn_slices(known, s), s.select("hk", F.lit(3).alias("leaf_depth")).distinct())
    return got.select(_text("hk"), "depth", _text("sk_start_boundary").alias("lo"), F.col("nth").cast("int").alias("nth"))


ACKS = "acks AS (SELECT 'p' || (l_orderkey % 50) AS partition, l_linenumber % 4 AS child, l_returnflag <> 'N' AS ok FROM lineitem WHERE l_orderkey % 50 <> 7 OR l_linenumber % 4 < 2)"


@query(f"""WITH {ACKS} SELECT partition, count(DISTINCT child) FILTER (ok)::BIGINT AS done, CASE WHEN count(DISTINCT child) FILTER (ok) = 0 THEN 'queued' WHEN count(DISTINCT child) FILTER (ok) < 4 THEN 'started' ELSE 'completed' END AS state FROM acks GROUP BY partition""")
def i4_split_progress(spark, sf_dir):
    n = fixtures.table(spark, sf_dir, "lineitem").filter("l_orderkey % 50 <> 7 or l_linenumber % 4 < 2")
    return topology.split_progress(n.select(F.concat(F.lit("p"), F.col("l_orderkey") % 50).alias("partition"), (F.col("l_linenumber") % 4).alias("child"), (F.col("l_returnflag") != "N").alias("acked")), 4)


@query("""WITH s AS (SELECT 'p' || i AS partition, i FROM range(200) t(i) WHERE i * 10 > 500 AND i % 11 > 0), a AS (SELECT DISTINCT 'p' || (l_orderkey % 200) AS partition, l_linenumber % 4 AS c FROM lineitem WHERE l_linenumber % 4 < 3 OR l_orderkey % 2 = 0),
    n AS (SELECT partition, count(*) AS n FROM a GROUP BY partition)
    SELECT partition, CASE WHEN i % 13 = 0 THEN 'split_queued' WHEN coalesce(n, 0) = 4 THEN 'split_completed' ELSE 'split_started' END AS status, CASE WHEN i % 13 = 0 THEN 0 ELSE coalesce(n, 0) END::INT AS acked FROM s LEFT JOIN n USING (partition)""")
def i5_split_states(spark, sf_dir):
    """Partitions over their size are queued once, begin where nothing is locked, and end with their last child."""
    p = spark.range(200).select(F.concat(F.lit("p"), "id").alias("partition"), (F.col("id") * 10).alias("bytes"), "id")
    none = spark.createDataFrame([], splits.STATES)
    queued = splits.queue(none, p, 500, p.filter("id % 11 = 0"), 4)
    begun = splits.start(splits.queue(queued, p, 500, p.filter("id % 11 = 0"), 4), p.filter("id % 13 = 0"))
    parent = F.concat(F.lit("p"), F.col("l_orderkey") % 200)
    acks = fixtures.table(spark, sf_dir, "lineitem").filter("l_linenumber % 4 < 3 or l_orderkey % 2 = 0").select(parent.alias("partition"), F.concat(parent, F.lit("."), F.col("l_linenumber") % 4).alias("child"))
    return splits.acknowledge(begun, acks).select("partition", "status", F.size("acked").alias("acked"))


@query(f"""WITH {DOC}, m AS (SELECT *, {_bucket_sql(1, 2, "hk")} AS child FROM doc), r AS (SELECT *, row_number() OVER (ORDER BY hk, sk) AS n FROM m WHERE child = 1)
    SELECT child::INT AS child, count(*)::BIGINT AS n_items, count(*) FILTER (child = 1 AND (hk, sk) IN (SELECT (hk, sk) FROM r WHERE n <= 30))::BIGINT AS moved FROM m GROUP BY child""")
def i6_migration(spark, sf_dir):
    """Two pages to the second child, the first of them moved twice."""
    d = fixtures.documents(spark, sf_dir)
    child, cursor = splits.move_page(d, d.filter("false"), 0, 2, 1, 15)
    child, _ = splits.move_page(d, child, 0, 2, 1, 15)
    if cursor is not None:
        child, _ = splits.move_page(d, child, 0, 2, 1, 15, cursor)
    return splits.progress(d, child, 0, 2)


# --------------------------------------------------------------- hints and streams


@query("""SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders) AS known, false AS missed FROM customer""")
def j_bloom_membership(spark, sf_dir):
    """Customers asked of a filter that learned those with orders; it misses none that it learned.

    It takes keys up to its byte limit, some 260,000; what it refused isn't missed.
    """
    hint = learned.LearnedKeys(1 << 20)
    o = fixtures.orders(spark, sf_dir).select("hk")
    hint.learn_table(o, 300_000)
    c = fixtures.table(spark, sf_dir, "customer").select("c_custkey", fixtures.key("cust#", F.col("c_custkey").cast("string")).alias("hk"))
    asked = hint.column(c, "hk").join(o.distinct().withColumn("known", F.lit(True)), "hk", "left")
    known = F.coalesce("known", F.lit(False))
    return asked.select("c_custkey", known.alias("known"), (known & ~F.col("maybe") & F.lit(hint.refused == 0)).alias("missed"))


@query("SELECT true AS few_errors, true AS comes_back, count(DISTINCT o_custkey)::BIGINT AS learned FROM orders")
def j3_learned_keys(spark, sf_dir):
    """How often the hints err on keys that don't exist, and that all keys learned are found after being stored."""
    known = written(fixtures.orders(spark, sf_dir).select("hk").filter("hk is not null").distinct(), "known-keys")
    hints = learned.DealtKeys.learn(known, 1 << 20).stored()
    absent = spark.range(20_000).select(fixtures.key("none#", F.col("id").cast("string")).alias("hk"))
    asked = known.withColumn("there", F.lit(True)).unionByName(absent.withColumn("there", F.lit(False)))
    held, wrong = hints.column(asked, "hk").filter("maybe").agg(F.count_if("there"), F.count_if(~F.col("there"))).first()
    exact = known.count()
    close = exact - hints.count() <= max(5, exact // 50)  # a key taken for one that is there isn't added
    return spark.createDataFrame([(wrong <= 400, close and held == exact, held)], "few_errors boolean, comes_back boolean, learned long")


def _stream(spark: SparkSession, sf_dir: str):
    return spark.readStream.schema(fixtures.table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parquet*")


def _drained(stream: DataFrame, mode: str) -> DataFrame:
    """What a stream gives until it is at its end, in the shared folder."""
    from lodekey.sources.written import new_path

    spark = stream.sparkSession
    out, state = new_path(spark, "stream"), new_path(spark, "stream-state")
    keep = lambda batch, n: batch.withColumn("batch", F.lit(n)).write.mode("append").parquet(out)
    stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


@query("""SELECT (user_id % 7)::INT AS partition_id, max(epoch_us(ts) // 1000)::BIGINT AS max_deleted_ts FROM events WHERE event_type = 'error' GROUP BY 1""")
def k5_watermark_stream(spark, sf_dir):
    deletes = _stream(spark, sf_dir).filter("event_type = 'error'").select((F.col("user_id") % 7).cast("int").alias("partition_id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts"))
    got = _drained(watermark_stream(deletes), "update")
    return got.groupBy("partition_id").agg(F.max("max_deleted_ts").alias("max_deleted_ts"))


@query("""SELECT DISTINCT event_type || (user_id % 50) AS token FROM events""")
def k7_once_per_token(spark, sf_dir):
    requests = _stream(spark, sf_dir).select(F.concat("event_type", F.col("user_id") % 50).alias("token"), F.col("ts").alias("requested_at"))
    return _drained(once_per_token(requests), "append").select("token")


EPOCHS_OF_EVENTS = """ops AS (SELECT 'user#' || user_id AS hk, row_number() OVER (ORDER BY ts, event_id) AS seq, event_type = 'error' AS gone, (epoch_us(ts) // 1000) AS ts, props FROM events),
    e AS (SELECT *, max(seq) FILTER (gone) OVER (PARTITION BY hk) AS cut FROM ops)"""


@query(f"""WITH {EPOCHS_OF_EVENTS} SELECT hk, count(*)::BIGINT AS v, max(ts)::BIGINT AS ts, arg_max(props, seq) AS data FROM e WHERE NOT gone AND (cut IS NULL OR seq > cut) GROUP BY hk""")
def k_stream_upserts(spark, sf_dir):
    """The events' log through a streaming query with state, until it is at its end."""
    from lodekey.streaming.upserts import apply_stream

    place = F.concat(F.lpad(F.unix_micros(F.col("ts").cast("timestamp")).cast("string"), 20, "0"), F.lpad(F.col("event_id").cast("string"), 20, "0"))
    log = _stream(spark, sf_dir).select(
        fixtures.key("user#", F.col("user_id").cast("string")).alias("hk"),
        F.lit(b"").alias("sk"),
        place.alias("seq"),
        F.when(F.col("event_type") == "error", "delete").otherwise("put").alias("operation"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("ts"),
        F.col("props").alias("data_text"),
    )
    got = _drained(apply_stream(log), "update")
    last = got.groupBy("hk").agg(F.max_by(F.struct("deleted", "v", "last_transaction_ts", "data_text"), "batch").alias("r"))
    return last.filter("not r.deleted").select(_text("hk"), "r.v", F.col("r.last_transaction_ts").alias("ts"), F.col("r.data_text").alias("data"))


# ------------------------------------------------------------------ probes and rest


@query(f"""WITH {LINES}, cur AS (SELECT hk, sk FROM ln GROUP BY hk, sk) SELECT c.hk, count(*)::BIGINT AS n FROM cur c JOIN (SELECT 'ord#' || o_orderkey AS hk FROM orders WHERE o_orderpriority = '1-URGENT') u USING (hk) GROUP BY c.hk""")
def d3_key_counts(spark, sf_dir):
    """Items of the keys that are asked for."""
    urgent = fixtures.table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").select(fixtures.key("ord#", F.col("o_orderkey").cast("string")).alias("hk"))
    return _line_items(spark, sf_dir).join(urgent, "hk", "left_semi").groupBy("hk").agg(F.count("*").alias("n")).select(_text("hk"), "n")


@query(f"WITH {ORD} SELECT EXISTS (SELECT 1 FROM ord WHERE hk = 'cust#1') AS has_some, EXISTS (SELECT 1 FROM ord WHERE hk = 'cust#none') AS has_none, (SELECT count(*) > 0 FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')) AS any_locks, false AS after_release")
def c17_probes(spark, sf_dir):
    o, locks = fixtures.orders(spark, sf_dir), _tx_locks(spark, sf_dir)
    released = transactions.release(locks, locks.select("transaction_id"))
    return spark.createDataFrame([(points.has_items(o, b"cust#1"), points.has_items(o, b"cust#none"), transactions.any_locks(locks), transactions.any_locks(released))], "has_some boolean, has_none boolean, any_locks boolean, after_release boolean")
