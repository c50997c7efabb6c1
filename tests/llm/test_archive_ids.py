import base64
import hashlib

from plantflow.llm.warc import archive_pages, read_archives


def test_a_repeated_id_with_other_payloads(spark, tmp_path):
    rows = [(5, "u", "A"), (5, "u", "BB"), (3, "u", "A"), (2, "u", "BB")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {(r.page_id, r.payload_bytes, r.payload_digest, r.refers_to) for r in archive_pages(pages, path=str(tmp_path / "a")).collect()}
    digest = lambda t: base64.b32encode(hashlib.sha1(t.encode()).digest()).decode()
    assert got == {(i, len(t), digest(t), None if i == 5 else 5) for i, _, t in rows}
    assert read_archives(spark, str(tmp_path / "a")).select("record_id").distinct().count() == 4
