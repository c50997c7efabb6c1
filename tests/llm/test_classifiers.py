import random
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from plantflow.llm.quality import drop_low_quality, score_quality, text_features
from plantflow.llm.toxicity import ConvNet, drop_toxic, features, fit_toxicity, held_out, with_scores

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string"


def corpus(n=1200, seed=0):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))
    docs, labels = [], []
    for i in range(n):
        words = [word() for _ in range(rng.randint(5, 120))]
        toxic = rng.random() < 0.2
        if toxic:
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(["vilezz", "vileqq", "grotzz"])
        bad = rng.random() < 0.2
        text = " ".join(w.upper() + "!!" for w in words) if bad else " ".join(words)
        docs.append((i, text, rng.choice(["en", "de", None]), rng.choice(["s0", "s1", None]), len(text), "x"))
        labels.append((i, int(not bad), int(toxic)))
    return docs, labels


def test_toxicity(spark):
    docs, labels = corpus()
    df = spark.createDataFrame([*docs, (9001, None, "en", None, None, None), (9002, "", None, None, 0, ""), (9003, "word " * 60_000, "en", "s0", 0, "")], DOCS)
    table = spark.createDataFrame([*labels, (None, 1, 1), (9002, None, None), (9001, 7, 7)], "doc_id long, quality int, toxic int")
    model = fit_toxicity(df, table, sample_rows=800)
    scored, name = with_scores(df, model)
    rows = {r.doc_id: r[1] for r in scored.select("doc_id", f"{name}.score").collect()}
    test = [(rows[i], t) for i, _, t in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(rows) == 1203 and all(0 <= s <= 1 for s in rows.values())
    assert np.mean([(s >= 0.5) == t for s, t in test]) > 0.95
    kept = drop_toxic(df, table, sample_rows=800)
    assert kept.columns == df.columns and 900 < kept.count() < 1050
    assert df.select(held_out(F.col("doc_id")).alias("h"), "doc_id").where("doc_id = 3").first()[0] == (zlib.crc32(b"3") % 5 == 0)


def test_toxicity_without_labels(spark):
    df = spark.createDataFrame(corpus(5)[0], DOCS)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert drop_toxic(df, none).count() == 5 and drop_toxic(df.limit(0), none).count() == 0
    assert drop_low_quality(df, none).count() == 5


def test_gradients_and_long_texts():
    net = ConvNet(filters=3, size=4)
    net.start()
    ids, row = features(pa.array(["one two three four five six", None, "seven", "eight nine"]))
    z = net.logits(ids, row, 4)
    for i in (0, 2, 3):
        best, _ = net.pooled(ids[row == i])
        assert np.isclose(z[i], np.maximum(best + net.params["shift"], 0) @ net.params["out"] + net.params["bias"][0], atol=1e-5)
    assert z[1] == net.params["bias"][0]
    own = ids[row == 0]
    grads = {k: np.zeros_like(v) for k, v in net.params.items() if k != "table"}
    net._backward(own, 1.0, 1.0, grads, [], [])
    loss = lambda: -np.log(1 / (1 + np.exp(-net.logits(own, np.zeros(len(own), np.int64), 1)[0])))
    for name in ("w2", "out", "shift", "bias"):
        flat, at = net.params[name].reshape(-1), 0
        keep, step = flat[at], 1e-2
        flat[at] = keep + step
        up = loss()
        flat[at] = keep - step
        down = loss()
        flat[at] = keep
        assert abs((up - down) / (2 * step) - grads[name].reshape(-1)[at]) < 2e-2


def test_quality(spark):
    docs, labels = corpus()
    df = spark.createDataFrame([*docs, (9001, None, None, None, None, None), (9002, "", "en", "s0", 0, "")], DOCS)
    known = [x for x in labels if x[0] % 2]
    table = spark.createDataFrame([*known, (None, 1, 0)], "doc_id long, quality int, toxic int")
    rows = {r.doc_id: r for r in score_quality(df, table).collect()}
    assert len(rows) == 1202 and all(0 <= r.quality_score <= 1 for r in rows.values())
    assert np.mean([rows[i].predicted == q for i, q, _ in labels if i % 2 == 0]) > 0.97
    kept = drop_low_quality(df, table)
    assert kept.columns == df.columns and score_quality(df.limit(0), table).count() == 0
    assert text_features(pa.array([None, "", "A!! b"])).bins.shape[0] == 3


def test_a_long_text_in_parts_has_the_same_features(monkeypatch):
    from plantflow.llm import quality

    text = "Some words, again again and more! \n" * 400 + "x" * 5000 + " end"
    whole = quality.text_features(pa.array([text]))
    monkeypatch.setattr(quality, "_CHUNK", 500)
    parts = quality.text_features(pa.array([text]))
    assert (whole.bins == parts.bins).all() and sorted(whole.words) == sorted(parts.words) and (parts.row == 0).all()


def test_repeated_rows_and_clashing_names(spark):
    docs, labels = corpus(400)
    df = spark.createDataFrame([(*d, "a", 1) for d in docs + docs[:50]], DOCS + ", _quality string, quality_score int")
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert score_quality(df, table).count() == 450
    kept = drop_low_quality(df, table)
    assert kept.columns == df.columns
    many = {r.doc_id: r["count"] for r in kept.groupBy("doc_id").count().collect()}
    assert all(many.get(i, 0) in (0, 2) for i in range(50)) and all(many.get(i, 0) in (0, 1) for i in range(50, 400))
    assert drop_toxic(df.drop("lang"), table, sample_rows=200).columns == df.drop("lang").columns
