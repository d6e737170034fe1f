"""Quoted passages of several lines that are no whole message, paragraph or line."""

import random

from marlstone.llm import quotes

SCHEMA = "conv_id long, turn long, role string, text string"


def replies(spark, texts):
    rows = [(1, i, "u", t) for i, t in enumerate(texts)]
    return {x.turn: (x.reply_to, x.thread, x.depth, x.n_linked) for x in quotes.conversations(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_runs_of_lines(spark):
    got = replies(
        spark,
        [
            "one\ntwo\nthree",
            "first a\nfirst b\n\nsecond a\n\nthird",
            "> One\n>  two\nyes",  # lines 1-2 of three
            "> first a\n> first b\n>\n> second a\nno",  # two paragraphs of three
            "> two\nmy part\ngoes on\n> three\nand the end",
            "> my part\n> goes on\nI see",  # an own part between two quotes
            "> one\n> three\nnot in a row",
            "> > two\n> > three\n> my part\n> goes\n> on\nrewrapped",
            "> > one\n> first b\n> second a\nhangs on the nearer one",
            "> later x\n> later y\nasked before it is said",
            "later x\nlater y\nlater z",
        ],
    )
    assert {t: x[0] for t, x in got.items()} == {0: None, 1: None, 2: 0, 3: 1, 4: 0, 5: 4, 6: None, 7: 4, 8: 1, 9: None, 10: None}
    assert got[5] == (4, 0, 2, 1) and got[7] == (4, 0, 2, 2)


def test_runs_of_lines_at_random(spark):
    """Against a walk over all earlier messages; several conversations hold the same lines."""
    r = random.Random(4)
    rows, want = [], {}
    for conv in range(8):
        said = []
        for turn in range(15):
            own = [f"w{r.randint(0, 4)} x" for _ in range(r.randint(0, 7))]
            quote = []
            if turn and r.random() < 0.8:
                lines = r.choice(said)
                a = r.randint(0, len(lines))
                quote = lines[a : a + r.randint(2, 4)]
                if r.random() < 0.2:
                    quote = quote + ["changed"]
            n = len(quote)
            exact = [t for t, x in enumerate(said) if quote and (quote == x or quote in [[y] for y in x])]
            inside = [t for t, x in enumerate(said) if n and any(x[i : i + n] == quote for i in range(len(x)))]
            want[conv, turn] = min(exact or inside, default=None)
            rows.append((conv, turn, "u", "\n".join(["> " + x for x in quote] + own)))
            said.append(own)
    got = quotes.conversations(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert {(x.conv_id, x.turn): x.reply_to for x in got} == want
    assert sum(v is not None for v in want.values()) > 30


def test_runs_without_conversation(spark):
    rows = [(None, 0, "u", "a\nb\nc"), (None, 1, "u", "> a\n> b"), (2, None, "u", "a\nb\nc"), (2, 1, "u", "> a\n> b"), (2, None, "u", "> a\n> b")]
    got = quotes.conversations(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 5 and {x.reply_to for x in got} == {None}
