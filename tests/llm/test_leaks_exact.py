"""Containment at and under the threshold: the sketches miss no pair, and no pair is too many."""

import random

from llm_words import WORDS

from marlstone.llm import decontamination


def shingles(text):
    w = WORDS.findall(text.lower())
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def test_no_pair_is_lost(spark):
    """Items of 1 to 70 shingles; documents that lack shingles at the start, in the middle, at the
    end, as many as the threshold bears and one more; words that differ by their cut only."""
    r = random.Random(1)
    word = lambda: "w" + "".join(r.choice("abcdefghij") for _ in range(6))
    items, docs = [], []
    for n in (*range(1, 40), 63, 64, 65, 70):
        w = [word() for _ in range(n + 4)]
        items.append((n, " ".join(w)))
        gone = n - -(-n * 4 // 5)
        for k in (gone, gone + 1):
            docs.append((len(docs), " ".join([word() for _ in range(30)] + w[: len(w) - k])))
            docs.append((len(docs), " ".join(w[k:] + [word() for _ in range(500)])))
        docs.append((len(docs), " ".join(w[: n // 2] + ["other"] + w[n // 2 + 1 :])))
    items.append((1000, "ab c d e f g"))
    docs.append((len(docs), "a bc d e f g"))
    want = {(d, i): len(shingles(x) & shingles(t)) for d, t in docs for i, x in items if 5 * len(shingles(x) & shingles(t)) >= 4 * len(shingles(x))}
    got = decontamination.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(x.doc_id, x.item_id): x.n_shared for x in got} == want and len(want) > 80


def test_rows_of_one_document_count_together(spark):
    words = [f"w{i}" for i in range(24)]
    docs = [(1, " ".join(words[:14])), (1, " ".join(words[10:])), (2, " ".join(words[:14])), (None, " ".join(words))]
    items = [(7, " ".join(words)), (None, " ".join(words))]
    got = decontamination.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert [tuple(x) for x in got] == [(1, 7, 20, 20, 1.0)]
