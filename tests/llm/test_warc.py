import base64
import hashlib
import io
from collections import defaultdict

from pyspark.sql import functions as F

from lodekey.llm import files, staging, warc


def table(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"archive": F.lit(1), "kind": F.lit("x")})


def test_round_trip_of_records(spark):
    rows = [(1, "http://a/x", "same"), (5, "http://a/y", "same"), (3, None, "same"), (2, "http://b/\r\nz", None), (4, "http://b", ""), (9, "http://c", "\r\n\r\nWARC/1.1\r\n" + "ü" * 5000), (None, "http://n", "alone")]
    got = {r.page_id: r for r in warc.captures(spark, table(spark, rows).repartition(3)).collect()}
    assert len(got) == len(rows)
    groups = defaultdict(list)
    for page, _, html in rows:
        groups[html or ""].append(page)
    for page, _, html in rows:
        raw = (html or "").encode()
        r = got[page]
        largest = max(groups[html or ""], key=lambda p: -1 if p is None else p)
        assert r.payload_bytes == len(raw)
        assert r.payload_digest == base64.b32encode(hashlib.sha1(raw).digest()).decode()
        assert (r.record_type, r.refers_to) == (("response", None) if page == largest else ("revisit", largest))
        assert r.request.fields["request"].startswith("GET ")
        assert int(r.metadata.fields["fetchedBytes"]) == len(raw)


def test_payloads_come_back(spark):
    folder = staging.new_path(spark, "warc")
    files.make_folder(folder)
    made = staging.stage(warc.write_warcs(table(spark, [(1, "u", "é\r\n"), (2, "u", "é\r\n")]), folder), "archives")
    got = warc.assemble(warc.read_warcs(spark, folder, made)).select("capture.*").collect()
    assert {r.kind: r.payload and bytes(r.payload).decode() for r in got} == {"response": "é\r\n", "revisit": None}


def test_empty_table(spark):
    assert warc.captures(spark, table(spark, [])).collect() == []


def test_repeated_rows_stay(spark, tmp_path):
    rows = [(1, "u", "x")] * 3 + [(7, "u", "x")] * 2 + [(None, None, "p"), (None, "", "q"), (None, None, "q"), (None, "u", "q"), (None, "u", "q")]
    want = [("p", None, "response", None), *[("q", None, k, None) for k in ("response", *["revisit"] * 3)], *[("x", 1, "revisit", 7)] * 3, *[("x", 7, "response", None)] * 2]
    name = {base64.b32encode(hashlib.sha1(h.encode()).digest()).decode(): h for h in "pqx"}
    table(spark, rows).write.parquet(str(tmp_path / "pages"))
    for pages in (table(spark, rows).repartition(3), spark.read.parquet(str(tmp_path / "pages"))):
        got = warc.captures(spark, pages).collect()
        assert sorted(((name[r.payload_digest], r.page_id, r.record_type, r.refers_to) for r in got), key=str) == sorted(want, key=str)
        assert all(r.payload_bytes == 1 for r in got)
        assert len({x for r in got for x in (r.capture_id, r.request.record_id, r.metadata.record_id)}) == 3 * len(rows)


def test_query_on_repeated_rows(spark, tmp_path):
    import duckdb

    from lodekey.llm.queries import ORACLE_SQL, QUERIES

    rows = [(1, "http://u/a", "x"), (2, "http://u/\n", "x"), (3, None, None), (4, "http://v", ""), (5, "http://v", "é")]
    table(spark, rows).select("page_id", "url", "html").write.parquet(str(tmp_path / "pages.parquet"))
    got = QUERIES["op1_warc"](spark, str(tmp_path))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "request" in plan
    assert "metadata" in plan
    c = duckdb.connect()
    c.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    picked = ", ".join(f'"{x}"' for x in got.columns)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, c.sql(f"SELECT {picked} FROM ({ORACLE_SQL['op1_warc']})").fetchall()))


def test_small_payloads_can_stay_responses(spark):
    planned = warc.plan_records(table(spark, [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")]), min_bytes=3)
    assert {r.page_id: r.o_page if r.o_key else None for r in planned.collect()} == {1: None, 2: None, 3: 4, 4: None}


def test_members_across_blocks():
    made = [warc.record([("WARC-Type", "metadata")], bytes([i]) * n) for i, n in enumerate((0, 10, 70_000, 3))]
    got = list(warc.iter_records(io.BytesIO(b"".join(made)), block=13))
    assert [warc.parse_record(raw)[1] for _, raw in got] == [bytes([i]) * n for i, n in enumerate((0, 10, 70_000, 3))]
    assert [at for at, _ in got] == [sum(map(len, made[:i])) for i in range(4)]
