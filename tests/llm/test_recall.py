"""Recall of the one-bit codes over a whole given table, against brute force."""

from pathlib import Path

import numpy as np
import pytest

from tallymill.llm import onebit

TABLE = "/root/testdata/sf0.1/embeddings.parquet"


@pytest.mark.skipif(not Path(TABLE).exists(), reason="needs the given tables")
def test_recall_over_a_whole_table(spark):
    rows = spark.read.parquet(TABLE).select("vec_id", "embedding")
    got = {}
    for r in onebit.nearest(rows).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    data = [(r.vec_id, r.embedding) for r in rows.collect() if r.embedding and None not in r.embedding]
    ids, x = np.array([i for i, _ in data]), np.array([v for _, v in data], float)
    asked = np.flatnonzero(ids % 20 == 0)
    assert sorted(got) == sorted(ids[asked].tolist())
    hit = 0
    for q in asked.tolist():
        scores = x @ x[q]
        order = np.lexsort((ids, -scores))
        true = [int(ids[i]) for i in order if i != q][:20]
        found = sorted(got[int(ids[q])])
        assert [rank for rank, _, _ in found] == list(range(1, 21)) and all(a[2] > b[2] or a[2] == b[2] and a[1] < b[1] for a, b in zip(found, found[1:]))
        at = {int(i): n for n, i in enumerate(ids)}
        assert all(abs(score - scores[at[v]]) < 1e-9 for _, v, score in found)
        hit += len({v for _, v, _ in found} & set(true))
    assert hit >= 0.9 * 20 * len(asked)
