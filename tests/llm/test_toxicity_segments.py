"""All significant toxic passages of a text."""

import numpy as np

from marlstone.llm import toxicity


def test_every_passage_is_returned(spark):
    r = np.random.default_rng(2)
    vocabulary = ["".join(r.choice(list("abcdefghij"), 6)) for _ in range(300)]
    rows, labels = [], []
    for i in range(400):
        words = list(r.choice(vocabulary, 80))
        bad = i % 5 == 0
        if bad:
            for _ in range(3):
                words.insert(int(r.integers(0, len(words))), str(r.choice(["vile", "scummy", "rotten"])))
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(bad)))
    words, want = list(r.choice(vocabulary, 900)), []
    for at, n in ((100, 6), (400, 9), (700, 7)):
        words[at : at + n] = ["vile", "scummy", "rotten"] * 3 if n == 9 else ["vile"] * n
        want.append((at, at + n))
    rows += [(1000, " ".join(words)), (1001, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {x.doc_id: x for x in toxicity.score(d, known).collect()}
    assert [(s.start, s.end) for s in got[1000].segments] == want
    for x in got.values():
        assert x.n_segments == len(x.segments) and [s.start for s in x.segments] == sorted(s.start for s in x.segments)
        top = max(x.segments, key=lambda s: s.score, default=None)
        assert (x.top_start, x.top_end) == ((top.start, top.end) if top else (0, 0))
    assert (got[1000].top_start, got[1000].top_end) == want[1] and got[1001].segments == []
