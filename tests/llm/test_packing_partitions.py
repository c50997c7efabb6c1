import numpy as np

from plantflow.llm.packing import CAPACITY, PART_SEQUENCES, deal


def test_a_round_has_no_more_partitions_than_its_tokens_need():
    """Partitions are bounded by what is left, not by the session's: 42,000 short documents filled 211 of them before."""
    documents = np.zeros(CAPACITY + 1, np.int64)
    documents[400] = 42_000
    plan = deal(documents, np.zeros(CAPACITY + 1, np.int64), 211)
    assert plan.partitions <= 65 and plan.partitions >= 42_000 * 400 // (PART_SEQUENCES * CAPACITY)
    documents[400] = 420_000_000  # large tables have all that the session asks for
    assert deal(documents, np.zeros(CAPACITY + 1, np.int64), 211).partitions == 211
