"""Cases that a narrower bound or a coarser key loses."""

import numpy as np
from pyspark.sql import functions as F

from labspark.llm import jaccard_join, one_bit_ann


def test_default_bound_keeps_every_neighbour(spark):
    n, k = 2000, 20
    x = np.random.default_rng(0).standard_normal((n, 64))
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = {(r.query_id, r.vec_id) for r in one_bit_ann.nearest(d, F.col("vec_id") % 20 == 0).collect()}
    score = x[::20] @ x.T
    score[np.arange(n // 20), np.arange(0, n, 20)] = -np.inf
    assert found == {(20 * q, int(i)) for q, row in enumerate(score) for i in np.argsort(-row)[:k]}


def test_keep_one_judges_texts_of_one_id_each_by_itself(spark):
    rows = [(3, "one two three four five six seven"), (5, "one two three four five six seven"), (5, "quite another text that nothing else is like"),
            (6, "a text of its own that stays as it is"), (None, "one two three four five six seven"), (7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {tuple(r) for r in jaccard_join.keep_one(docs).collect()}
    assert kept == {rows[0], *rows[2:]}
