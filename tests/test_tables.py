"""Operators on small tables."""

import random

import pytest
from pyspark.sql import functions as F

from lodekey import catalogue_more
from lodekey.functions import keys, learned
from lodekey.functions.bloom import LayeredBloom
from lodekey.operators import oplog, points, stats, topology, transactions
from lodekey.operators.query import SubQuery, query_items
from lodekey.plans.conditions import ITEM_NOT_EXISTS, attribute_equals, evaluate
from lodekey.plans.intervals import Condition
from lodekey.schema import ITEM, PENDING, TX_ITEM
from lodekey.sources.store import ConditionFailed, Conflict, LayoutError, Locked, Table, TableConfig, WriteOperation


def items(spark, rows):
    """Rows (hk, sk, text) as items."""
    out = []
    for hk, sk, text in rows:
        k, s = keys.encode_key(hk), keys.encode_optional(sk)
        out.append((k, s, 1, 1, 0, None, len(text) + len(k) + len(s) + 100, None, text))
    return spark.createDataFrame(out, ITEM)


def shown(page):
    return [keys.decode_optional(bytes(r["sk"])) for r in page.rows.orderBy("pos").collect()]


def walk(table, queries, **budget):
    out, pages, cursor = [], 0, None
    while True:
        page = query_items(table, queries, cursor=cursor, **budget)
        out += shown(page)
        pages += 1
        c = page.next_cursor()
        if c is None:
            return out, pages
        cursor = c.encode()


def test_pages(spark):
    t = items(spark, [("alice", k, "x") for k in ("a3", "a1", "a2")] + [("bob", k, "x") for k in ("b2", "b1", "b3")]).cache()
    both = [SubQuery("alice"), SubQuery("bob")]
    assert shown(query_items(t, both)) == ["a1", "a2", "a3", "b1", "b2", "b3"]
    assert query_items(t, both).next_cursor() is None
    assert shown(query_items(t, [SubQuery("bob", forward=False), SubQuery("alice")])) == ["b3", "b2", "b1", "a1", "a2", "a3"]
    assert shown(query_items(t, [SubQuery("alice"), SubQuery("zzz", Condition("between", "z9", "z1")), SubQuery("bob", Condition("eq", "b1"))])) == ["a1", "a2", "a3", "b1"]
    got, pages = walk(t, both, limit=2)
    assert got == ["a1", "a2", "a3", "b1", "b2", "b3"]
    assert pages > 1
    got, pages = walk(t, both, max_bytes=100)
    assert got == ["a1", "a2", "a3", "b1", "b2", "b3"]
    assert pages > 1
    got, _ = walk(t, [SubQuery("alice", forward=False), SubQuery("alice")], limit=1)
    assert got == ["a3", "a2", "a1", "a1", "a2", "a3"]
    with pytest.raises(ValueError):
        query_items(t, [])
    with pytest.raises(ValueError):
        query_items(t, both, limit=0)


def test_visits_end_pages(spark):
    t = items(spark, [("h", f"k{i}", "x") for i in range(10)] + [("g", "z", "x")]).cache()
    cuts = ["", "k2", "k4", "k6", "k8", ""]
    leaves = spark.createDataFrame([(b"h", cuts[i].encode(), cuts[i + 1].encode()) for i in range(5)], "hk binary, start binary, end binary")
    want = [f"k{i}" for i in range(10)]
    for forward in (True, False):
        for visits in (1, 2, 3):
            parts = [SubQuery("h", Condition("gte", "k3"), forward), SubQuery("none"), SubQuery("g")]
            inner = [k for k in (want if forward else want[::-1]) if k >= "k3"]
            got, pages = walk(t, parts, leaves=leaves, max_visits=visits)
            assert got == [*inner, "z"]
            assert pages >= 6 // visits
            got, _ = walk(t, parts, leaves=leaves, max_visits=visits, limit=3)
            assert got == [*inner, "z"]
    page = query_items(t, [SubQuery("h")], leaves=leaves, max_visits=2)
    assert page.metrics() == {"rows_read": 4, "rows_returned": 4, "sub_queries": 1, "partitions_visited": 2}


def test_budget_that_ends_on_a_last_row(spark):
    t = items(spark, [("alice", "a1", "x")]).cache()
    page = query_items(t, [SubQuery("alice"), SubQuery("bob")], max_bytes=72 + 2 + 2 + 5)
    assert shown(page) == ["a1"]
    c = page.next_cursor()
    assert (c.index, c.after) == (1, None)
    assert query_items(t, [SubQuery("alice"), SubQuery("bob")], max_bytes=80, cursor=c.encode()).next_cursor() is None


def test_pages_keep_few_rows_of_a_key(spark):
    t = items(spark, [("alice", f"a{i:03}", "x") for i in range(300)]).cache()
    page = query_items(t, [SubQuery("alice", forward=False)], limit=5)
    assert "WindowGroupLimit" in page.rows._jdf.queryExecution().executedPlan().toString()
    assert page.scanned.count() == 6
    assert shown(page) == [f"a{i:03}" for i in range(299, 294, -1)]


def test_scans_push_key_bounds(spark, tmp_path):
    t = Table(spark, str(tmp_path), TableConfig("plans"))
    t.publish(items(spark, [("a", f"k{i:03}", "x") for i in range(50)]))
    page = query_items(t.items(), [SubQuery("a", Condition("begins_with", "k01"))])
    plan = page.rows._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(sk" in plan
    assert "EqualTo(hk" in plan or "In(hk" in plan
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    stamps = points.get_stamps(t.items(), t.items().select("hk", "sk"))
    assert "data_text" not in stamps._jdf.queryExecution().executedPlan().toString()


def test_store(spark, tmp_path):
    t = Table(spark, str(tmp_path), TableConfig("t"))
    assert t.get_item("a") is None
    assert t.put_item("a", "x", now_ms=5) == 1
    assert t.put_item("a", {"k": 1}, now_ms=3) == 2
    row = t.get_item("a")
    assert (row["v"], row["last_transaction_ts"], row["data_text"], row["data_kind"]) == (2, 5, '{"k":1}', 2)
    with pytest.raises(ConditionFailed):
        t.put_item("a", "y", conditions=[ITEM_NOT_EXISTS])
    with pytest.raises(ConditionFailed):
        t.delete_item("a", conditions=[attribute_equals(1)])
    with pytest.raises(ValueError):
        t.put_item("a", "y", ttl=1)
    assert t.put_item("a", b"\x00", sort_key=b"\x01") == 1
    assert t.delete_item("a")
    assert not t.delete_item("a")
    assert t.put_item("a", "again") == 1
    assert Table(spark, str(tmp_path), TableConfig("t")).items().count() == 2
    with pytest.raises(LayoutError):
        Table(spark, str(tmp_path), TableConfig("t", root_trees=3))
    t.destroy()
    assert t.version is None


@pytest.mark.parametrize("bad", [{"root_trees": 0}, {"hash_split": 1}, {"range_split": 256}, {"ancestors_from_leaf": 11}])
def test_layout_limits(bad):
    with pytest.raises(LayoutError):
        TableConfig("t", **bad)


BOUNDARIES = [
    (["a"], 2, None, None, None),
    (["apple", "cherry", "mango", "peach"], 2, None, None, ["c"]),
    (["a", "b"], 2, None, None, ["b"]),
    (["prefix_aaa", "prefix_bbb"], 2, None, None, ["prefix_b"]),
    (["app", "apple"], 2, None, None, ["appl"]),
    (["aardvark", "cherry", "mango", "strawberry", "vanilla", "zebra"], 3, None, None, ["c", "s"]),
    (["banana", "cherry", "mango"], 2, b"banana", b"peach", ["c"]),
    (["apple", "banana", "cherry", "mango", "peach"], 2, b"cherry", b"mango", None),
]


@pytest.mark.parametrize(("sort_keys", "n", "start", "end", "expected"), BOUNDARIES)
def test_boundaries(spark, sort_keys, n, start, end, expected):
    t = items(spark, [("h", k, "d") for k in sort_keys]).withColumn("est_row_bytes", F.lit(100).cast("long"))
    got = [r["boundaries"] for r in stats.split_boundaries(t, n, start, end).collect()]
    got = [b and [bytes(x).decode() for x in b] for b in got] or [None]
    assert got == [expected]


def test_heavy_rows_can_leave_no_boundaries(spark):
    t = items(spark, [("h", "a", "d"), ("h", "m", "d" * 5000), ("h", "z", "d")])
    assert stats.split_boundaries(t, 3).first()["boundaries"] is None


def test_children_tile_the_range(spark):
    t = items(spark, [("h", f"k{i:03}", "d") for i in range(40)])
    routed = topology.route_range(t, stats.children(stats.split_boundaries(t, 4)))
    counts = [r["count"] for r in routed.groupBy("child").count().collect()]
    assert sum(counts) == 40
    assert len(counts) == 4
    assert all(5 <= c <= 15 for c in counts)


def test_running_sum_in_ranges(spark):
    t = spark.range(1000).selectExpr("cast(id % 3 as string) k", "id o", "id v")
    got = {(r.k, r.o): r.s for r in stats.running_sum(t, "k", "o", "v", "s").collect()}
    so_far = {}
    for i in range(1000):
        so_far[str(i % 3)] = so_far.get(str(i % 3), 0) + i
        assert got[str(i % 3), i] == so_far[str(i % 3)]


@pytest.mark.parametrize(("depth", "expected"), [(1, []), (2, [1]), (3, [1, 2]), (5, [1, 2, 3, 4]), (6, [1, 2, 4, 5]), (10, [1, 2, 8, 9])])
def test_ancestors(spark, depth, expected):
    h = spark.createDataFrame([("x", d) for d in range(depth)], "leaf string, depth int")
    assert sorted(r["depth"] for r in topology.select_ancestors(h, 2, 2).collect()) == expected


def test_placement_states(spark):
    acks = spark.createDataFrame([("p", 0, True), ("p", 0, True), ("p", 1, True), ("q", 0, False), ("r", 0, True)], "partition string, child int, acked boolean")
    assert {r["partition"]: r["state"] for r in topology.split_progress(acks, 2).collect()} == {"p": "completed", "q": "queued", "r": "started"}
    promoted = spark.createDataFrame([(b"a", "queued"), (b"b", "promoted")], "hk binary, status string")
    moved = topology.guarded_transition(promoted, spark.createDataFrame([(b"a", "queued", "promoting"), (b"b", "queued", "promoting")], "hk binary, from_status string, to_status string"))
    assert {bytes(r["hk"]): r["status"] for r in moved.collect()} == {b"a": "promoting", b"b": "promoted"}
    heavy = spark.createDataFrame([(b"a",), (b"b",), (b"c",)], "hk binary")
    assert [bytes(r["hk"]) for r in topology.promotions(heavy, promoted, spark.createDataFrame([(b"c",)], "hk binary")).collect()] == [b"a"]


def test_conditional_log_against_a_model(spark):
    r = random.Random(3)
    rows, state, expected = [], {}, {}
    for seq in range(400):
        key = r.choice("abcde")
        op = r.choice(["put", "put", "delete"])
        cond = r.choice([None, [{"type": "item_exists", "value": None}], [{"type": "item_not_exists", "value": None}], [{"type": "attribute_equals", "value": r.randint(1, 3)}]])
        rows.append((key.encode(), b"", seq, op, cond))
        failed = evaluate(cond, state.get(key))
        if failed is None:
            state[key] = (state.get(key) or 0) + 1 if op == "put" else None
        expected[seq] = (failed is None, state.get(key))
    ops = spark.createDataFrame(rows, "hk binary, sk binary, seq long, operation string, conditions array<struct<type:string,value:bigint>>")
    assert {x.seq: (x.accepted, x.v) for x in oplog.fold_conditional(ops).collect()} == expected


def _tx(tx, ts, n, hk, op, text=None, cond=None, part="p0"):
    return (tx, ts, n, part, hk, b"", op, None if text is None else 1, text, cond, None)


def test_transactions(spark):
    base = items(spark, [("old", None, "o"), ("held", None, "h")]).withColumn("last_transaction_ts", F.lit(50).cast("long"))
    locks = spark.createDataFrame([(b"held", b"", "other", 1, 1, "put", 1, None, "x")], PENDING)
    marks = spark.createDataFrame([("p0", 70)], "partition_id string, max_deleted_ts long")
    exists = [("item_exists", None)]
    req = spark.createDataFrame(
        [
            _tx("ok", 100, 0, b"old", "put", "n"),
            _tx("ok", 100, 1, b"new", "put", "n"),
            _tx("late", 50, 0, b"old", "put", "n"),
            _tx("below", 70, 0, b"gone", "put", "n"),
            _tx("locked", 100, 0, b"held", "delete"),
            _tx("cond", 100, 0, b"nope", "check", cond=exists),
            _tx("cond", 100, 1, b"held", "delete"),
            _tx("skew", 99_999, 0, b"old", "put", "n"),
            _tx("other", 2, 0, b"held", "put", "n"),
        ],
        TX_ITEM,
    )
    prepared = transactions.prepare_items(req, base, locks, marks, 1000)
    got = {r.transaction_id: (r.outcome, r.reason) for r in transactions.decide(transactions.votes(prepared)).collect()}
    assert got == {
        "ok": ("committed", None),
        "late": ("cancelled", "timestamp_conflict"),
        "below": ("cancelled", "timestamp_conflict"),
        "locked": ("cancelled", "pending_conflict"),
        "cond": ("cancelled", "condition_failed"),
        "skew": ("cancelled", "clock_skew"),
        "other": ("committed", None),
    }
    decisions = transactions.decide(transactions.votes(prepared))
    assert {bytes(r.hk) for r in transactions.new_locks(prepared, decisions, 1000).collect()} == {b"old", b"new"}
    after = {bytes(r.hk): (r.v, r.last_transaction_ts, r.data_text) for r in transactions.apply_commits(base, req.filter("transaction_id = 'ok'"), decisions).collect()}
    assert after == {b"old": (2, 100, "n"), b"new": (1, 100, "n"), b"held": (1, 50, "h")}
    assert {r.transaction_id for r in transactions.independent(req).collect()} == {"other", "late", "below"}
    assert [r.transaction_id for r in transactions.locks_match(locks, req.filter("transaction_id = 'other'")).collect()] == []
    assert {r.action for r in transactions.recover(transactions.stale_transactions(locks, 10_000), spark.createDataFrame([("x", "COMMITTED")], "transaction_id string, state string")).collect()} == {"cancel"}


def test_log_fold_and_epochs(spark):
    rows = [(b"k", b"", s, op, t, 1, None, f"d{s}") for s, (op, t) in enumerate([("put", 9), ("put", 3), ("delete", 4), ("put", 5), ("put", 2)])]
    ops = spark.createDataFrame(rows, "hk binary, sk binary, seq long, operation string, ts long, data_kind int, data_bin binary, data_text string")
    r = oplog.fold(ops).first()
    assert (r.v, r.last_transaction_ts, r.data_text) == (2, 5, "d4")
    assert [x.v for x in oplog.with_epochs(ops).orderBy("seq").collect()] == [1, 2, None, 1, 2]


def test_stream_publishes(spark, tmp_path):
    from lodekey.streaming.upserts import publish_batches

    schema = "hk binary, sk binary, seq long, operation string, ts long, data_kind int, data_text string"
    t = Table(spark, str(tmp_path), TableConfig("s"))
    folder = tmp_path / "in"
    for n, rows in enumerate([[(b"a", b"", 1, "put", 5, 1, "x"), (b"b", b"", 2, "put", 6, 1, "y")], [(b"a", b"", 3, "put", 4, 1, "z"), (b"b", b"", 4, "delete", 7, None, None)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
        source = spark.readStream.schema(schema).parquet(str(folder))
        publish_batches(source, t, str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
        got = {bytes(r.hk): (r.v, r.last_transaction_ts, r.data_text) for r in t.items().collect()}
        assert got == ({b"a": (1, 5, "x"), b"b": (1, 6, "y")} if n == 0 else {b"a": (2, 5, "z")})


def test_stored_transactions(spark, tmp_path):
    t = Table(spark, str(tmp_path), TableConfig("tx"))
    put = lambda k, d="x", **o: WriteOperation("put", k, data=d, **o)
    many = [put(f"k{i}") for i in range(100)]
    assert t.transact_write(many, 100, token="one") == ("committed", None)
    assert t.transact_write(list(reversed(many)), 100, token="one") == ("committed", None)
    assert t.items().agg(F.max("v")).first()[0] == 1
    with pytest.raises(ValueError, match="token"):
        t.transact_write(many[:5], 200, token="one")
    assert t.transact_write([put("k0"), WriteOperation("check", "none", conditions=[{"type": "item_exists"}])], 200) == ("cancelled", "condition_failed")
    assert t.get_item("k0")["v"] == 1
    assert t.transact_write([put("k0", b"\x00\x01")], 100) == ("cancelled", "timestamp_conflict")
    assert t.transact_write([put("k0", b"\x00\x01"), WriteOperation("delete", "k1")], 300) == ("committed", None)
    assert bytes(t.get_item("k0")["data_bin"]) == b"\x00\x01"
    assert t.transact_write([put("k1")], 300) == ("cancelled", "timestamp_conflict")
    assert t.get_item("k0")["est_row_bytes"] == 2 + 2 + 100
    outcome, got = t.transact_get([("k2", None), ("k1", None), ("k2", None), ("k0", None)])
    assert (outcome, [r and r["v"] for r in got]) == ("committed", [1, None, 1, 2])
    for bad in ([put("a"), put("a")], [WriteOperation("put", "a")], [WriteOperation("check", "a")], [put(f"k{i}") for i in range(101)], []):
        with pytest.raises(ValueError):
            t.transact_write(bad, 400)


def test_locks(spark):
    locks = spark.createDataFrame([(hk, sk, t, 1, 1, "put", 1, None, "x") for hk, sk, t in ((b"a", b"", "t1"), (b"a", b"x", "t2"), (b"b", b"", "t1"))], PENDING)
    assert {bytes(r.hk): (r.locks, r.transactions) for r in transactions.pending_counts(locks).collect()} == {b"a": (2, 2), b"b": (1, 1)}
    first = transactions.pending_page(locks, 1).first()
    rest = transactions.pending_page(locks, 5, (bytes(first.hk), bytes(first.sk), first.transaction_id)).collect()
    assert [(bytes(r.hk), bytes(r.sk)) for r in rest] == [(b"a", b"x"), (b"b", b"")]
    assert transactions.release(locks, spark.createDataFrame([("t1",)], "transaction_id string")).count() == 1


def _folders(t):
    return t._version().roots


def test_a_put_writes_its_root_only(spark, tmp_path):
    t = Table(spark, str(tmp_path), TableConfig("w"))
    t.publish(items(spark, [(f"k{i}", None, "x") for i in range(60)]))
    before = _folders(t)
    assert len(before) == 10
    t.put_item("k1", "y")
    after = _folders(t)
    assert {r for r in before if before[r] != after[r]} == {t._root(b"k1")}
    assert t.items().count() == 60
    assert t.items(1).filter("data_text = 'y'").isEmpty()
    assert t.remove_old(keep=1, older_than_ms=0) > 0
    assert (t.items().count(), t.get_item("k1")["data_text"]) == (60, "y")
    assert len(t._numbers()) == 1
    t.put_item("k1", "z")
    assert t.remove_old(keep=1) == 0  # too young
    s = {r.root: r for r in t.status().collect()}
    assert sum(r.n_items for r in s.values()) == 60
    assert len(s) == 10


def test_two_writers(spark, tmp_path, monkeypatch):
    a, b = (Table(spark, str(tmp_path), TableConfig("two")) for _ in range(2))
    a.put_item("x", "0")
    real = Table._changed

    def late(self, v, roots, edit):  # the other comes first, once
        monkeypatch.setattr(Table, "_changed", real)
        b.put_item("x", "b")
        return real(self, v, roots, edit)

    monkeypatch.setattr(Table, "_changed", late)
    assert a.put_item("x", "a") == 3
    assert (b.get_item("x")["v"], b.get_item("x")["data_text"]) == (3, "a")
    monkeypatch.setattr(Table, "_write", lambda self, name, text, replacing=True: replacing)
    with pytest.raises(Conflict):
        a.put_item("x", "c")


def test_crashes_between_writes(spark, tmp_path, monkeypatch):
    t = Table(spark, str(tmp_path), TableConfig("crash"))
    t.put_item("a", "0", now_ms=1)
    ops = [WriteOperation("put", "a", data="1"), WriteOperation("delete", "b")]
    real = Table._write
    for at in range(3):
        token, calls = f"token{at}", []

        def write(self, name, text, replacing=True, at=at, calls=calls):
            calls.append(name)
            if len(calls) == at + 1:
                raise OSError("lost")
            return real(self, name, text, replacing)

        before = t.get_item("a")["v"]
        monkeypatch.setattr(Table, "_write", write)
        try:
            t.transact_write(ops, 100 * (at + 1), token=token)
        except OSError:
            pass
        monkeypatch.setattr(Table, "_write", real)
        for _ in range(2):  # tried again
            assert t.transact_write(ops, 100 * (at + 1), token=token) == ("committed", None)
        assert t.get_item("a")["v"] == before + 1
        t.put_item("other", "x")  # the token is found when other versions have come
        assert t.transact_write(ops, 100 * (at + 1), token=token) == ("committed", None)
        assert t.get_item("a")["v"] == before + 1


def test_locks_of_stored_tables(spark, tmp_path):
    t = Table(spark, str(tmp_path), TableConfig("locks"))
    t.put_item("a", "0", now_ms=1)
    ops = [WriteOperation("put", "a", data=b"\x01\x02"), WriteOperation("check", "c", conditions=[{"type": "item_not_exists"}])]
    assert t.prepare("t1", ops, 10) is None
    assert t.prepare("t1", ops, 10) is None
    assert t.locks().count() == 2
    with pytest.raises(Locked):
        t.put_item("a", "1")
    with pytest.raises(Locked):
        t.delete_item("c")
    t.put_item("b", "free")
    assert t.prepare("t2", [WriteOperation("put", "a", data="2")], 20) == "pending_conflict"
    assert t.transact_write([WriteOperation("put", "a", data="2")], 20) == ("cancelled", "pending_conflict")
    assert t.transact_get([("b", None), ("a", None)])[0] == "pending_write"
    assert {r.locks for r in t.status().collect()} == {0, 1} or sum(r.locks for r in t.status().collect()) == 2
    assert t.finish("t1", commit=True)
    assert not t.finish("t1", commit=True)
    assert (t.get_item("a")["v"], bytes(t.get_item("a")["data_bin"]), t.get_item("a")["est_row_bytes"]) == (2, b"\x01\x02", 103)
    assert t.get_item("c") is None
    assert t.put_item("a", "3") == 3
    assert t.prepare("t3", [WriteOperation("delete", "b")], 30) is None
    assert t.prepare("t4", [WriteOperation("delete", "a")], 30) is None
    states = spark.createDataFrame([("t4", "COMMITTING"), ("t3", "PREPARING")], "transaction_id string, state string")
    assert t.recover(states, 40) == {}
    assert t.recover(states, 100_000) == {"t3": "wait", "t4": "commit"}
    assert t.get_item("a") is None
    assert t.recover(states.filter("transaction_id = 'none'"), 100_000) == {"t3": "cancel"}
    assert t.get_item("b")["data_text"] == "free"
    assert t.locks().isEmpty()


def test_settings_that_may_change(spark, tmp_path):
    Table(spark, str(tmp_path), TableConfig("c"))
    Table(spark, str(tmp_path), TableConfig("c", max_size_mb=7))
    with pytest.raises(LayoutError):
        Table(spark, str(tmp_path), TableConfig("c", hash_split=8))


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    t = Table(spark, str(tmp_path), TableConfig("b"))
    assert t.publish(items(spark, [("a", None, "x")]), "s", 0) == 1
    assert t.publish(items(spark, [("a", None, "y")]), "s", 0) == 1
    assert t.get_item("a")["data_text"] == "x"
    assert t.publish(items(spark, [("a", None, "y")]), "other", 0) == 2
    assert (t.published("s"), t.published("none")) == (0, -1)


def test_removal_of_deep_trees(spark):
    chain = [(f"n{i}", f"n{i - 1}" if i else None, "promoted") for i in range(40)]
    rows = [*chain, ("lost", "nowhere", "promoted"), ("q", "n3", "queued"), ("side", "n3", "promoted")]
    got = {r.name: (r.level, r.step) for r in topology.destroy_order(spark.createDataFrame(rows, "name string, parent string, status string")).collect()}
    assert got == {f"n{i}": (i, 39 - i) for i in range(40)} | {"side": (4, 35)}
    with pytest.raises(ValueError):
        topology.destroy_order(spark.createDataFrame([("a", "b", "x"), ("b", "a", "x")], "name string, parent string, status string"))


def test_routes_below_deep_splits(spark):
    t = items(spark, [(f"k{i}", None, "x") for i in range(40)])
    names = ["h.0"]
    for _ in range(6):
        names += [f"{n}.{c}" for n in names for c in range(2) if f"{n}.{c}" not in names]
    got = topology.route_hash(t, 1, 2, spark.createDataFrame([(n,) for n in names], "name string"))
    assert got.filter(F.col("partition").isin(names)).isEmpty()
    assert {r.n for r in got.select(F.size(F.split("partition", r"\.")).alias("n")).distinct().collect()} == {9}


def test_children_begun_again():
    from lodekey.operators import splits

    one = splits.begin_child({"parent": "p", "number": 1}, None)
    assert splits.begin_child({"parent": "p", "number": 1}, one | {"cursor": "x"})["cursor"] == "x"
    with pytest.raises(splits.Conflicting):
        splits.begin_child({"parent": "p", "number": 2}, one)


def test_votes_are_counted_once(spark):
    from lodekey.operators import coordinator

    voters = spark.createDataFrame([("t", "p0", "yes", False), ("t", "p1", None, False)], "transaction_id string, partition_id string, vote string, done boolean")
    cast = lambda v, n: spark.createDataFrame([("t", "p0", "condition_failed", 1), ("t", "p1", v, n)], "transaction_id string, partition_id string, vote string, attempt int")
    after = lambda c: {r.partition_id: r.vote for r in coordinator.record_votes(voters, c).collect()}
    assert after(cast("transient_error", 3)) == {"p0": "yes", "p1": None}
    assert after(cast("transient_error", coordinator.MOST_ATTEMPTS)) == {"p0": "yes", "p1": "transient_error"}
    assert after(cast("yes", 1)) == {"p0": "yes", "p1": "yes"}


@pytest.mark.parametrize(("customers", "nulls"), [(300_000, 0), (40, 3), (0, 0)])
def test_all_keys_are_learned(spark, tmp_path, customers, nulls):
    """More keys than a hint holds (261,120), orders of no customer, and none at all; against the query's SQL."""
    number = F.when(F.col("id") < customers, F.col("id"))
    o = spark.range(customers + nulls).select(F.col("id").alias("o_orderkey"), number.alias("o_custkey"), F.lit("2-HIGH").alias("o_orderpriority"))
    o.withColumn("o_orderdate", F.to_timestamp(F.lit("1995-01-01"))).write.parquet(str(tmp_path / "orders.parquet"))
    assert [tuple(r) for r in catalogue_more.j3_learned_keys(spark, str(tmp_path)).collect()] == [(True, True, customers)]


def test_hints_of_shares(spark):
    """Each hint keeps to its bytes, none lacks a key; null is never held, equal rows are kept."""
    hints = learned.DealtKeys.learn(spark.range(3000).select(keys.encode_text(F.col("id").cast("string")).alias("hk")), 2000)
    stored = hints.stored()
    assert stored.shares > 1
    raw = [LayeredBloom.from_bytes(bytes(r["_hint"])) for r in stored.hints.collect()]
    assert len(raw) == stored.shares
    assert all(sum(map(len, b.layers)) <= 2000 for b in raw)
    assert stored.count() == sum(sum(b.counts) for b in raw) > 2900
    asked = spark.range(6000).withColumn("k", keys.encode_text(F.col("id").cast("string")))
    asked = asked.unionByName(spark.sql("select id, binary(null) k from range(6000, 6010)")).unionByName(asked.filter("id < 5"))
    got = stored.column(asked, "k").collect()
    assert sorted(r["id"] for r in got) == sorted([*range(6010), *range(5)])
    assert all(r["maybe"] for r in got if r["id"] < 3000)
    assert sum(r["maybe"] for r in got if 3000 <= r["id"] < 6000) < 90
    assert not any(r["maybe"] for r in got if r["id"] >= 6000)
