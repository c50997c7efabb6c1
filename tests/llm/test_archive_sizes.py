from pyspark.sql import functions as F

from plantflow.llm.warc import archive_pages


def sizes(spark, pages, path):
    """Rows, and the largest archive of those written, unpacked."""
    import gzip

    rows = archive_pages(pages, path=path, archive_bytes=100_000).count()
    files = spark.read.format("binaryFile").load(path + "/*.gz").select("content").collect()
    return rows, max(len(gzip.decompress(bytes(f[0]))) for f in files)


def test_no_id_decides_an_archive(spark, tmp_path):
    other = F.rpad(F.col("id").cast("string"), 2000, "x")
    for name, page, html in (("null", F.lit(None), other), ("equal", F.lit(7), other), ("hot", F.lit(7), F.rpad(F.lit("y"), 2000, "x"))):
        pages = spark.range(1000).select(page.cast("long").alias("page_id"), F.lit("u").alias("url"), html.alias("html"))
        rows, largest = sizes(spark, pages, str(tmp_path / name))
        assert rows == 1000 and largest < 1_000_000, name  # of 2.3 MB in all


def test_single_large_rows_are_not_spread_and_few_pairs_are(spark, tmp_path, monkeypatch):
    """Rows of more than an archive need no salt; pairs are spread from a share of all that is dealt."""
    from plantflow.llm import warc

    facts, own = {}, warc.written
    monkeypatch.setattr(warc, "written", lambda df, label: facts.setdefault(label, own(df, label)))
    large = [(k, "u", "x" * 300_000) for k in range(5)]
    pages = spark.createDataFrame(large + [(7, "u", "z" * 2000)] * 800 + [(8, "u", "z" * 2000)] * 60 + [(9, "u", None)] * 20, "page_id long, url string, html string")
    pages = pages.selectExpr("*", "'clash' AS record_type", "1 AS salt", "2 AS hot", "3 AS k", "'n' AS payload_digest")
    rows = archive_pages(pages, path=str(tmp_path / "a"), archive_bytes=100_000, most_hot=10).collect()
    salts = {r.page_id: r.salts for r in facts["facts"].collect()}
    assert salts == {0: 1, 1: 1, 2: 1, 3: 1, 4: 1, 7: 6, 8: 1, 9: 1}  # 3.7 MB in all, a tenth is the least that is spread
    assert len(rows) == 885 and sum(r.payload_bytes for r in rows) == 5 * 300_000 + 860 * 2000
    assert {(r.page_id, r.record_type, r.refers_to) for r in rows if r.page_id > 6} == {(7, "revisit", 8), (8, "response", None), (9, "response", None)}
    assert {r.refers_to for r in rows if r.page_id < 4} == {4}
