import numpy as np
import pytest

from plantflow.llm import language_model


def test_every_position_is_learned_from(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(language_model, "_averaged", lambda docs, text, net, k, stride, rate: rounds.append((k, stride)))
    df = spark.createDataFrame([(1, "a b c d e f g h i j")], "doc_id long, text string")
    language_model.fit_language_model(df)
    place = np.arange(3, 1000)
    seen = np.concatenate([place[(place + k) % stride == 0] for k, stride in rounds])
    assert sorted(seen.tolist()) == place.tolist()
    with pytest.raises(ValueError, match="leave out"):
        language_model.fit_language_model(df, rounds=2, stride=8)
