import math

from plantflow.llm.language_model import bucket_of, score_documents, with_log_share


def test_a_shared_entry_is_split_by_counts(spark):
    common = "the cat sat on the mat and the dog ran " * 5
    rows = [(i, common) for i in range(40)] + [(50, "often " * 30), (51, "seldom")]
    rows += [(100 + k, f"junk{k}") for k in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.mean_log_likelihood for r in score_documents(df, own=8).collect()}
    # at most two or three words share an entry before the split, so all 602 rare words scored alike
    assert got[50] > got[51] + 1
    rare = [math.exp(got[51])] + [math.exp(got[100 + k]) for k in range(600)]
    assert sum(rare) < 1


def test_shares_of_an_entry_sum_to_one(spark):
    rare = spark.createDataFrame([(h, 1 + h % 5) for h in range(-50, 50)], "h long, n long")
    tokens = rare.select("h").unionByName(spark.createDataFrame([(10**6 + k,) for k in range(7)], "h long"))
    rows = with_log_share(tokens, rare, 7).select("h", bucket_of(tokens.h, 7).alias("b"), "log_share").collect()
    assert all(r.b == (r.h % 2**64) % 7 for r in rows)
    for b in range(7):
        assert abs(sum(math.exp(r.log_share) for r in rows if r.b == b) - 1) < 1e-9
