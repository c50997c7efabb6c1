import base64
import hashlib

import numpy as np

from plantflow.llm.neighbours import nearest
from plantflow.llm.sharding import shard
from plantflow.llm.warc import archive_pages, read_archives


def test_revisits(spark, tmp_path):
    html = ["same", "same", None, "", "a\r\n\r\nWARC/1.1\r\nx", "ünï", "same", "x" * 300_000]
    pages = spark.createDataFrame([(i, f"http://h/{i}\r\nX: y", h, "response") for i, h in enumerate(html)] + [(6, "http://h/6", "same", "")], "page_id long, url string, html string, record_type string")
    got = sorted((tuple(r) for r in archive_pages(pages, path=str(tmp_path / "a"), archive_bytes=1000).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)
    newest = {}
    for i, h in enumerate(html):
        newest[h or ""] = i
    expected = []
    for i, h in [*enumerate(html), (6, "same")]:
        data, to = (h or "").encode(), newest[h or ""]
        expected.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if to == i else "revisit", None if to == i else to))
    assert got == sorted(expected, key=str)
    stored = read_archives(spark, str(tmp_path / "a"))
    assert {bytes(r.payload) for r in stored.where("record_type = 'revisit'").collect()} == {b""}
    assert {bytes(r.payload) for r in stored.where("page_id = 4").collect()} == {html[4].encode()}
    assert archive_pages(pages.limit(0)).count() == 0


def test_smaller_payloads_stay(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef"), (None, "u", "abcdef")], "page_id long, url string, html string")
    rows = {r.page_id: r.record_type for r in archive_pages(pages, least_bytes=5).collect()}
    assert rows == {1: "response", 2: "response", 3: "revisit", 4: "response", None: "response"}


def brute(ids, v, k):
    out = {}
    for q in range(len(ids)):
        if ids[q] % 20 == 0:
            s = (v * v[q]).sum(axis=1)
            s[q] = -np.inf
            out[ids[q]] = [int(ids[i]) for i in np.lexsort((ids, -s)) if i != q][:k]
    return out


def test_recall_and_scores(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(3000, 24)).astype(np.float32)
    v[100:160] = v[100]
    v[5] *= 4
    ids = np.arange(3000)
    df = spark.createDataFrame([(int(i), [float(x) for x in row], 0) for i, row in zip(ids, v, strict=True)], "vec_id long, embedding array<float>, rank int")
    rows = nearest(df, shard_rows=1000).collect()
    exact = brute(ids, v.astype(float), 20)
    got = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append(r.vec_id)
        assert abs(r.score - float((v[r.query_id].astype(float) * v[r.vec_id]).sum())) < 1e-9
    assert set(got) == set(exact)
    assert np.mean([len(set(got[q]) & set(exact[q])) / 20 for q in exact]) >= 0.9
    assert got[100] == exact[100] == list(range(101, 121))


def test_recall_of_every_query_of_the_given_vectors(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding")
    rows = table.where("embedding IS NOT NULL").orderBy("vec_id").collect()
    exact = brute(np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float), 20)
    got = {}
    for r in nearest(table).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert set(got) == set(exact) and np.mean([len(got[q] & set(exact[q])) / 20 for q in exact]) >= 0.9


def test_equal_rows_spread_over_the_shards(spark, monkeypatch):
    from plantflow.llm import neighbours

    sizes, own = [], neighbours.written

    def counted(df, label):
        out = own(df, label)
        sizes.append([r["count"] for r in out.groupBy("shard").count().collect()])
        return out

    monkeypatch.setattr(neighbours, "written", counted)
    df = spark.createDataFrame([(7, [1.0, 2.0])] * 900 + [(20 * k, [float(k + 1), 1.0]) for k in range(100)], "vec_id long, embedding array<double>")
    nearest(df, shard_rows=100)
    assert len(sizes) == 1 and max(sizes[0]) < 200


def test_blocks_of_queries_agree_and_hold_equal_rows_apart(spark, monkeypatch):
    """Many rows of one query id are dealt over the blocks that are broadcast."""
    from plantflow.llm import neighbours

    rows = [(20, [1.0, k / 300]) for k in range(300)] + [(k, [float(k % 7 + 1), 1.0]) for k in range(1, 120)] + [(40, [2.0, 0.5])] * 3
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    seen, own = [], neighbours._matrix
    monkeypatch.setattr(neighbours, "_matrix", lambda column, size: seen.append(len(column)) or own(column, size))
    one, many = (sorted(map(tuple, nearest(df, block_bytes=b).collect())) for b in (1 << 20, 24 * 60))
    assert one == many and {r[0] for r in one} == {20, 40, 60, 80, 100}
    assert seen[0] == 308 and max(seen[1:]) < 60
    assert neighbours.nearest(df.where("vec_id = 1")).count() == 0


def test_vectors_that_take_no_part(spark):
    rows = [(0, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [float("nan"), 1.0]), (4, [None, 1.0]), (5, [float("inf"), 1.0]), (6, [0.5, 0.5]), (7, []), (None, [1.0, 1.0]), (20, [1.0, 0.0]), (8, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in nearest(df).collect())
    assert got == [(0, 1, 20, 1.0), (0, 2, 6, 0.5), (20, 1, 0, 1.0), (20, 2, 6, 0.5)]
    assert nearest(df.limit(0)).count() == 0 and nearest(df.where("vec_id = 6")).count() == 0


def test_shards_fit(spark):
    rows = [(i, "x" * (i % 90)) for i in range(1500)] + [(7, f"hot {i}" * 3) for i in range(300)] + [(7, "equal") for _ in range(400)] + [(None, None), (None, "n"), (9000, "y" * 5000)]
    got = shard(spark.createDataFrame(rows, "doc_id long, text string"), limit=2000).collect()
    assert len(got) == len(rows) and sum(r.bytes for r in got) == sum(len(t or "") for _, t in rows)
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.bytes)
    assert all(sum(b) <= 2000 or len(b) == 1 for b in by.values())
    assert not any(a != b and b.startswith(a) for a in by for b in by)
    one = shard(spark.createDataFrame(rows[:3], "doc_id long, text string"), limit=10**6)
    assert {(r.shard, r.depth) for r in one.collect()} == {("", 0)}
    assert shard(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_shards_of_long_and_clashing_rows(spark):
    rows = [(i, "z" * (300_000 if i == 3 else 10), "x", 1) for i in range(40)] + [(5, "same", "y", 2)] * 60
    got = shard(spark.createDataFrame(rows, "doc_id long, text string, shard string, bytes int"), limit=500).collect()
    assert len(got) == len(rows) and {r.bytes for r in got} == {10, 300_000, 4}
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.bytes)
    assert all(sum(b) <= 500 or len(b) == 1 for b in by.values()) and {r.depth for r in got} == {len(r.shard) for r in got}


def test_many_null_and_repeated_pages(spark):
    """A third of all rows without an id, and an id whose payloads differ."""
    pages = spark.range(9000).selectExpr("CASE WHEN id % 3 = 0 THEN NULL WHEN id % 3 = 1 THEN 7 ELSE id END AS page_id", "'u' AS url", "concat('p', id % 50) AS html")
    rows = archive_pages(pages, archive_bytes=100_000).collect()
    newest = {}
    for i in range(9000):
        if i % 3:
            newest[f"p{i % 50}"] = max(newest.get(f"p{i % 50}", -1), 7 if i % 3 == 1 else i)
    digest = {base64.b32encode(hashlib.sha1(h.encode()).digest()).decode(): n for h, n in newest.items()}
    assert len(rows) == 9000 and all(r.refers_to == (None if r.page_id is None or r.page_id == digest[r.payload_digest] else digest[r.payload_digest]) for r in rows)
