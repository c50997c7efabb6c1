"""Order keys so large that ids of packets leave 64 bits, as those of 360 copies of sf0.1 do."""

import datetime

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from plantflow.sources.packets import WIDE, packets_table

#: So many order keys stand before the ones of a copy of sf0.001: the first two copies fit 64 bits, replies of the last do not.
SHIFTS = (0, 30_000_000, 53_998_500)
KEYS = {"lineitem": ("l_orderkey", "l_partkey", "l_suppkey"), "orders": ("o_orderkey", "o_custkey")}


def tables(spark, folder, shifts):
    for name, (key, *others) in KEYS.items():
        copies = spark.read.parquet(f"{entry.SMOKE_DIR}/{name}.parquet").crossJoin(spark.createDataFrame([(s,) for s in shifts], "s long"))
        copies.withColumns({key: F.col(key) + F.col("s"), **{c: F.col(c) + (F.col("s") / 1500).cast("long") for c in others}}).drop("s").write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def far(spark, tmp_path_factory):
    return tables(spark, tmp_path_factory.mktemp("far"), SHIFTS)


def by_sql(folder, query):
    """Rows of the query's SQL, over tables whose order keys are 128-bit numbers."""
    with duckdb.connect() as con:
        for name, (key, *_) in KEYS.items():
            con.execute(f"CREATE VIEW {name} AS SELECT * REPLACE (CAST({key} AS HUGEINT) AS {key}) FROM '{folder}/{name}.parquet/*.parquet'")
        con.execute(entry.oracle_sql()[query])
        return [d[0] for d in con.description], con.fetchall()


def rows(found):
    plain = lambda v: v.isoformat() if isinstance(v, datetime.datetime) else round(v, 6) if isinstance(v, float) else str(v)
    return sorted(repr([plain(v) for v in r]) for r in found)


def test_ids_beyond_64_bits_are_exact(spark, far):
    made = packets_table(spark, far)
    assert made.schema["pkt_id"].dataType == WIDE
    ids = [int(r[0]) for r in made.select("pkt_id").collect()]
    assert max(ids) >= 2**63
    assert sorted(ids) == sorted(int(r[0]) for r in by_ids(far))


def by_ids(folder):
    """The ids by the rule alone, of the replies and of all else."""
    with duckdb.connect() as con:
        line, orders = (f"'{folder}/{name}.parquet/*.parquet'" for name in KEYS)
        con.execute(f"""WITH l AS (SELECT ((l_orderkey::HUGEINT * 10 + l_linenumber) * 1000000 + l_partkey) * 10000 + l_suppkey AS id, l_orderkey AS ok, o_custkey AS ck,
  CASE WHEN o_custkey % 7 = 0 THEN l_suppkey ELSE o_custkey % 5 + l_linenumber % 3 END AS dk, CASE WHEN o_custkey % 11 = 0 THEN l_partkey % 20 ELSE (o_custkey + l_linenumber % 3) % 20 END AS wk
  FROM {line} JOIN {orders} ON l_orderkey = o_orderkey)
SELECT id FROM l UNION ALL SELECT 4000000000000000000::HUGEINT + id FROM l WHERE ok % 3 = 0 AND wk IN (0, 1, 14) AND dk % 17 <> 0
UNION ALL SELECT 5000000000000000000::HUGEINT + o_orderkey FROM {orders} WHERE o_orderkey % 8 = 1 UNION ALL SELECT -o_orderkey FROM {orders} WHERE o_orderkey % 10 = 0""")
        return con.fetchall()


@pytest.mark.parametrize("shifts", [(0,), (52_300_000,)])
def test_ids_of_64_bits_are_longs(spark, tmp_path, shifts):
    folder = tables(spark, tmp_path, shifts)
    if shifts != (0,):  # keys that could make larger ids, but without replies
        for name, (key, *_) in KEYS.items():
            spark.read.parquet(f"{folder}/{name}.parquet").where(F.col(key) % 3 != 0).write.parquet(f"{folder}/some/{name}.parquet")
        folder += "/some"
    assert packets_table(spark, folder).schema["pkt_id"].dataType.simpleString() == "bigint"
    names, expected = by_sql(folder, "ldap_binds")
    assert rows(entry.queries()["ldap_binds"](spark, folder).select(names).collect()) == rows(expected)


@pytest.mark.parametrize("query", ["rule_dns_resolver", "conformance_tally", "trusted_unmatched", "modbus_events", "findings_policy", "findings_ranked", "flow_index", "findings_all", "asset_omitted", "asset_names", "findings_mitre"])
def test_queries_equal_their_sql(spark, far, query):
    names, expected = by_sql(far, query)
    got = entry.queries()[query](spark, far)
    assert sorted(got.columns) == sorted(names) and expected and rows(got.select(names).collect()) == rows(expected)
