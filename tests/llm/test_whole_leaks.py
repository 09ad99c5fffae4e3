"""Passages whose exchanged words are spread evenly."""

import numpy as np
import pytest

from lectern.llm import leakage


@pytest.mark.parametrize("n", range(28, 39))
def test_no_passage_has_shorter_runs_than_the_seed(n):
    seed = leakage.least_run(np.ones(n))
    for length in range(-(-n // 2), n + 1):
        k = length // 10
        # k exchanged words part the others into k + 1 runs, as equal as can be
        assert seed <= -(-(length - k) // (k + 1)), length


def test_evenly_spread_exchanges_are_found(spark):
    words = [f"w{i}" for i in range(32)]
    passage = [*words[:6], "x", *words[7:13], "y", *words[14:20]]
    items = spark.createDataFrame([(1, " ".join(words))], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, " ".join(["a", "b", *passage, "c"])), (2, " ".join(words[:12]))], "doc_id bigint, text string")
    assert [(r.item_id, r.doc_id) for r in leakage.leaks(docs, items).collect()] == [(1, 1)]
