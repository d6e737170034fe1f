"""Quotation linking against a plain version, and the pipeline."""

import random
import re

from marlstone.llm import quotes

SCHEMA = "conv_id long, turn long, role string, text string, body string, depth long, h long"


def plain(rows):
    """{(conv, turn): (body, reply_to, thread, depth)} by walking messages one at a time."""
    def parse(text):
        parts = []
        for line in re.split("\r?\n", text or ""):
            m = re.match(r"[ \t]*((?:>[ \t]?)+)", line)
            level, rest = (m[1].count(">"), line[m.end() :]) if m else (0, line)
            if parts and parts[-1][0] == level:
                parts[-1][1].append(rest)
            else:
                parts.append((level, [rest]))
        return parts

    flat = lambda t: " ".join(t.lower().split())
    first, parsed = {}, {}
    for conv, turn, _, text in rows:
        parts = parse(text)
        body = "\n".join("\n".join(x) for level, x in parts if level == 0).strip()
        quoted = [(level, i, flat("\n".join(x))) for i, (level, x) in enumerate(parts) if level and flat("\n".join(x))]
        parsed.setdefault((conv, turn), []).append((body, quoted))
        if conv is None or turn is None:
            continue
        for unit in {flat(u) for u in [body, *re.split(r"\n[ \t]*\n", body), *body.split("\n")]} - {""}:
            first[conv, unit] = min(first.get((conv, unit), turn), turn)
    up = {}
    for (conv, turn), messages in parsed.items():
        found = [(level, i, first[conv, q]) for _, quoted in messages for level, i, q in quoted if turn is not None and first.get((conv, q), turn) < turn]
        if found:
            up[conv, turn] = min(found)[2]
    out = {}
    for (conv, turn), messages in parsed.items():
        root, depth = turn, 0
        while (conv, root) in up:
            root, depth = up[conv, root], depth + 1
        out[conv, turn] = ([b for b, _ in messages], up.get((conv, turn)), root, depth)
    return out


def messages(seed):
    r = random.Random(seed)
    rows = []
    for conv in range(6):
        said = []
        for turn in range(12):
            lines = []
            for _ in range(r.randint(0, 2)):
                if said:
                    mark = r.choice(["> ", ">", "> > ", ">>"])
                    part = r.choice(said).split("\n")
                    part = part if r.random() < 0.5 else [r.choice(part)]
                    lines += [mark + x.upper() if r.random() < 0.3 else mark + x for x in part]
            lines += [f"line {r.randint(0, 30)} of {conv}" for _ in range(r.randint(0, 3))]
            text = "\n".join(lines)
            said.append("\n".join(x for x in lines if not x.startswith(">")))
            rows.append((conv, turn, "user", text))
    rows += [(None, 0, "user", "> a"), (0, None, None, "> line"), (9, 0, "user", None), (9, 1, "user", ""), (9, 2, "x", "> never said"), (9, 2, "x", "> never said")]
    return rows


def test_conversations(spark):
    for seed in (1, 2):
        rows = messages(seed)
        d = spark.createDataFrame([(*r, "b", 1, 2) for r in rows], SCHEMA).repartition(3)
        got = quotes.conversations(d).collect()
        want = plain(rows)
        assert len(got) == len(rows)
        for x in got:
            bodies, up, root, depth = want[x.conv_id, x.turn]
            assert x.body in bodies and (x.reply_to, x.thread, x.depth) == (up, root, depth)
        assert sum(x.reply_to is not None for x in got) > 10


def test_nested_levels(spark):
    d = spark.createDataFrame(
        [(1, 0, "u", "Hello there\nsecond line"), (1, 1, "a", "> second line\nI reply"), (1, 2, "u", "> > second line\n> I reply\nfine"), (1, 3, "a", "new")],
        "conv_id long, turn long, role string, text string",
    )
    got = {x.turn: x for x in quotes.conversations(d).collect()}
    assert [(got[t].reply_to, got[t].thread, got[t].depth) for t in range(4)] == [(None, 0, 0), (0, 0, 1), (1, 0, 2), (None, 3, 0)]
    assert (got[2].n_quotes, got[2].n_linked, got[2].body) == (2, 2, "fine")


def test_long_chain(spark):
    rows = [(1, i, "u", (f"> text {i - 1}\n" if i else "") + f"text {i}") for i in range(40)]
    got = quotes.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert {x.turn: (x.thread, x.depth) for x in got} == {i: (0, i) for i in range(40)}


def test_empty(spark):
    d = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert quotes.conversations(d).collect() == []


def test_pipeline(spark):
    import corpus_pipeline as p

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    n = docs.count()
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        docs = out
    assert 0 < docs.count() <= 3 * n
    last = p.run(spark, sf)
    assert last.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and last.count() == docs.count()


def test_pipeline_edges(spark):
    import corpus_pipeline as p

    sf = "/root/testdata/sf0.001"
    rows = [(1, None, "en", "s", 0), (2, "", None, None, 0), (None, "a b c", "en", "s", 5), (3, "some words " * 40, "en", "s", 400), (3, "some words " * 40, "en", "s", 400)]
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    for data in (rows, []):
        for _, stage in p.STAGES:
            stage(spark, spark.createDataFrame(data, kind), sf).collect()
