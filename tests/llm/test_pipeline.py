from pathlib import Path

import duckdb
import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test data")


def test_stages(spark):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = {r.doc_id: r for r in docs.collect()}
    got = docs
    for name, stage in cp.STAGES[:-1]:
        got = cp.staging.stage(stage(spark, got, SF), name)
        assert got.columns == cp.COLUMNS
        assert got.dtypes == docs.dtypes
        now = {r.doc_id: r for r in got.collect()}
        assert set(now) <= set(before)
        if name != "suffix_array_dedup":
            assert all(now[k] == before[k] for k in now)
        else:
            assert set(now) == set(before)
            assert all(r.n_chars == len(r.text) for r in now.values())
        before = now
    packed = cp.STAGES[-1][1](spark, got, SF).collect()
    assert {r.doc_id for r in packed} == set(before)


def test_odd_rows(spark):
    import corpus_pipeline as cp
    from helpers import ODD, documents

    texts = [*ODD, *ODD, " ".join(f"w{i}" for i in range(30_000)), None]
    docs = documents(spark, texts, ids=[*range(len(texts) - 1), None])
    kept = []
    for name, stage in cp.STAGES[:-1]:
        docs = cp.staging.stage(stage(spark, docs, SF), name)
        assert docs.columns == cp.COLUMNS
        kept.append(sorted((r.doc_id, r.text or "") for r in docs.filter("doc_id is not null").collect()))
    stay = [i for i, _ in kept[0]]
    assert all(i in stay for i, t in enumerate(texts[:-1]) if not (t or "").strip())
    distinct = {}
    for i, t in enumerate(texts[:-1]):
        if i in stay:
            distinct.setdefault(tuple((t or "").lower().split()), i)
    assert [i for i, _ in kept[1]] == sorted(distinct.values())
    assert [i for i, _ in kept[2]] == [i for i, _ in kept[1]]
    assert {r.doc_id for r in cp.STAGES[-1][1](spark, docs, SF).collect()} == set(distinct.values())
    for _, stage in cp.STAGES:
        assert stage(spark, documents(spark, []), SF).collect() == []


def test_run(spark):
    import corpus_pipeline as cp

    assert cp.run(spark, SF).count() > 0


@pytest.mark.parametrize("name", ["op1_warc", "op5_chat_format"])
def test_sql(spark, name):
    from lodekey.llm.queries import ORACLE_SQL, QUERIES

    c = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    got = QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    picked = ", ".join(f'"{x}"' for x in columns)
    assert sorted(repr(tuple(r)) for r in got.select(*columns).collect()) == sorted(repr(r) for r in c.sql(f"SELECT {picked} FROM ({ORACLE_SQL[name]})").fetchall())


def test_every_query_gives_all_rows(spark):
    from lodekey.llm.queries import QUERIES

    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    for name in ("op3_media_columns", "op4_byte_bpe", "op6_toxicity", "op7_simhash", "op8_suffix_dedup", "op9_kd_sharding", "op10_chunk_fingerprints"):
        assert QUERIES[name](spark, SF).select("doc_id").distinct().count() == n
