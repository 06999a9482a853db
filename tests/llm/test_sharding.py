import random
import zlib

import pytest
from helpers import ODD, documents
from pyspark.sql import functions as F

from lodekey.llm import sharding


@pytest.mark.parametrize("seed", [1, 2])
def test_bytes_are_near_equal(spark, seed):
    r = random.Random(seed)
    texts = ["x" * r.choice([5, 5, 5, 50, r.randint(0, 400)]) for _ in range(3000)]  # a third of the rows are alike
    rows = sharding.shard_documents(documents(spark, texts)).collect()
    assert len(rows) == len(texts)
    size, slots = {}, {}
    for x in rows:
        size[x.shard] = size.get(x.shard, 0) + x["size"]
        slots.setdefault(x.shard, []).append(x.slot)
        assert x["size"] == len(texts[x.doc_id]) + 8
    assert set(size) == set(range(24))
    mean = sum(size.values()) / 24
    assert all(abs(v - mean) <= 5 * 408 for v in size.values())
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_odd_rows(spark):
    rows = {x.doc_id: x for x in sharding.shard_documents(documents(spark, ODD)).collect()}
    for i, t in enumerate(ODD):
        raw = (t or "").encode()
        assert (rows[i]["size"], rows[i].text_crc32) == (len(raw) + 8, zlib.crc32(raw))


def test_repeated_rows_null_columns_and_empty_tables(spark):
    rows = sharding.shard_documents(documents(spark, ["a"] * 40, ids=[1] * 20 + [None] * 20)).collect()
    assert len(rows) == 40
    for s in {x.shard for x in rows}:
        mine = sorted(x.slot for x in rows if x.shard == s)
        assert mine == list(range(len(mine)))
    d = documents(spark, ["a", "b"]).drop("lang", "source").selectExpr("*", "cast(null as string) lang", "cast(null as string) source")
    assert len(sharding.shard_documents(d).collect()) == 2
    assert sharding.shard_documents(documents(spark, [])).collect() == []


def test_equal_rows_are_dealt_evenly(spark):
    counts = {}
    for x in sharding.shard_documents(documents(spark, ["same"] * 480, ids=[3] * 480)).collect():
        counts[x.shard] = counts.get(x.shard, 0) + 1
    assert counts == {s: 20 for s in range(24)}


def plain_tree(rows, extents, first, shards):
    """Shards of rows (keys, size) by a k-d tree, all in one place."""
    if shards == 1 or len(rows) < 2:
        return {r[0]["row"]: first for r in rows}
    spread = lambda d: (max(r[0][d] for r in rows) - min(r[0][d] for r in rows)) / max(1, extents[d])
    dim = max(sharding.DIMENSIONS, key=spread)
    key = lambda r: (r[0][dim], *(r[0][t] for t in sharding.TIES))
    ordered, half = sorted(rows, key=key), shards // 2
    target, running = sum(r[1] for r in rows) * half / shards, 0
    for i, r in enumerate(ordered):  # the cut comes behind row i, or before it where that is nearer
        running += r[1]
        if running >= target:
            cut = i - 1 if i and target - (running - r[1]) < running - target else i
            break
    left, right = ordered[: cut + 1], ordered[cut + 1 :]
    return plain_tree(left, extents, first, half) | plain_tree(right, extents, first + half, shards - half)


@pytest.mark.parametrize(("few", "bins"), [(4000, 1024), (3, 4), (1, 16)])
def test_against_a_plain_tree(spark, monkeypatch, few, bins):
    monkeypatch.setattr(sharding, "FEW", few)
    monkeypatch.setattr(sharding, "BINS", bins)
    r = random.Random(7)
    texts = [r.choice(["é", "x"]) * r.choice([3, 3, r.randint(0, 90)]) for _ in range(250)]
    docs = documents(spark, texts)
    docs = docs.withColumns({"lang": F.element_at(F.array(*[F.lit(x) for x in ("de", "en", "en", "fr")]), (F.col("doc_id") % 4 + 1).cast("int")), "source": F.concat(F.lit("s"), F.col("doc_id") % 7)})
    meta = sharding.staging.stage(sharding.metadata(docs), "meta")
    rows = [({k: x[k] for k in (*sharding.DIMENSIONS, *sharding.TIES)}, x["size"]) for x in meta.collect()]
    extents = {d: max(k[d] for k, _ in rows) - min(k[d] for k, _ in rows) for d in sharding.DIMENSIONS}
    _, got = sharding.cut_table(meta, 5)
    assert {x.row: x.node for x in got.collect()} == plain_tree(rows, extents, 0, 5)


def test_target_bytes(spark):
    rows = sharding.shard_documents(documents(spark, ["x" * 92] * 100), target_bytes=1000).collect()
    assert sorted({x.shard for x in rows}) == list(range(10))


def test_few_shards(spark):
    d = documents(spark, [f"{i}" for i in range(90)])
    counts = {}
    for x in sharding.shard_documents(d, 3).collect():
        counts[x.shard] = counts.get(x.shard, 0) + 1
    assert set(counts) == {0, 1, 2}
    assert {x.shard for x in sharding.shard_documents(d, 1).collect()} == {0}
