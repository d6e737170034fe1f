"""Random tokens of which there are few, beside ordinary ones, and copies."""

import random
import re

import numpy as np

from marlstone.llm import secrets

ORDINARY = ["abcdefghij" * 4 + "X1", "the/quick/brown/fox/jumps/over/lazy", "AAAAAAAABBBBBBBBCCCCCCCCDDDDDDDD11111aaa", "keitstlichschenverpf", "getUserNameFromServerResponse2"]


def key(seed, name, n):
    return "".join(np.random.default_rng(seed).choice(list(secrets.ALPHABETS[name]), n))


def reported(spark, tokens):
    d = spark.createDataFrame([(i, f"see {x} here") for i, x in enumerate(tokens)], "doc_id long, text string")
    return {x.doc_id: x.n_random for x in secrets.find(d).collect()}


def test_few_keys_are_reported(spark):
    keys = [key(s, "base62", 40) for s in (1, 2, 3)] + [key(4, "base64", 64)]
    assert reported(spark, keys + ORDINARY) == {i: int(i < 4) for i in range(9)}
    # One alone, and one beside many copies of another token of its stratum.
    assert reported(spark, keys[3:]) == {0: 1}
    assert reported(spark, keys[:1] + ORDINARY[:1] * 50) == {0: 1} | {i: 0 for i in range(1, 51)}


def test_copies_move_no_threshold(spark):
    """Copies of one token make no stratum of random ones."""
    word = "keitstlichschenverpf"
    assert secrets.bin_of(word, "base36") > 0
    assert set(reported(spark, [word] * 60).values()) == {0}
    top = next(t for s in range(200) if secrets.bin_of(t := key(s, "digits", 20), "digits") >= secrets.BINS // 2)
    alone = reported(spark, [top, "20240101000000000001"])
    assert reported(spark, [top, "20240101000000000001"] + [top] * 50) == alone | {i: alone[0] for i in range(2, 52)}


def test_single_random_tokens(spark):
    """By encoding, tokens that each stand alone in their corpus."""
    null = secrets.Ordinary([])
    for name in ("hex_upper", "base36", "base62", "base64_url"):
        passed = null.passed(name, secrets.length_band(48), 500)
        bins = [secrets.bin_of(key(s, name, 48), name) for s in range(100)]
        assert sum(secrets.least_clear({b: 1}, passed, secrets.ALPHA) == b for b in bins) > 85
        made = list(null.tokens(name, secrets.length_band(48), 300))
        assert len(made) == 300 and sum(secrets.least_clear({secrets.bin_of(t, name): 1}, passed, secrets.ALPHA) is not None for t in made) <= 9


def test_what_base_spans_leave_is_tested():
    """Parts of a run outside the patterns' spans, against every pair of run and span."""
    r = random.Random(7)
    pick = lambda n: "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n))
    key = "AKIA" + "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(16))
    text = " ".join([f"{pick(30).lower()}+{key}", f"token={pick(40)}", pick(25), "0123456789abcdef" * 2 + "+" + pick(24), pick(19), "x" * 10 + key + "/" + pick(33).lower()])
    spans = secrets.base_spans(text)
    want = set()
    for m in secrets.RUN.finditer(text):
        free = [not any(a <= i < b for a, b, _ in spans) for i in range(m.start(), m.end())]
        for g in re.finditer("1+", "".join("01"[f] for f in free)):
            a, b = m.start() + g.start(), m.start() + g.end()
            if len(text[a:b].rstrip("=")) >= secrets.LEAST and secrets.encoding(text[a:b].rstrip("=")):
                want.add((a, b))
    assert {(c["start"], c["end"]) for c in secrets.candidates(text, spans)} == want and len(want) >= 3


def test_ordinary_words_come_from_whole_texts(spark, monkeypatch):
    """Words count wherever they stand in a text, once a text."""
    seen, thresholds = [], secrets.thresholds
    monkeypatch.setattr(secrets, "thresholds", lambda counts, alpha, words: seen.append(words) or thresholds(counts, alpha, words))
    texts = [f"Quorvel zyxword {key(1, 'base62', 40)} tail tail", "ZYXWORD end", None, ""]
    for lead in ("", "1 " * 5000):
        d = spark.createDataFrame([(i, t and lead + t) for i, t in enumerate(texts)], "doc_id long, text string")
        assert [x.n_random for x in secrets.find(d).orderBy("doc_id").collect()] == [1, 0, 0, 0]
    assert seen == [["zyxword", "end", "quorvel", "tail"]] * 2
