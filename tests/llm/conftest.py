import random

import pytest

#: Columns beside doc_id and text; most names clash with columns that some operator makes.
MORE = "lang string, source string, n_chars long, fp long, size long, kept boolean, key string, h string, rid long, bucket int, score double, whole long"
SCHEMA = f"doc_id long, text string, {MORE}"


def word(r: random.Random) -> str:
    return "".join(r.choice("abcdefgh") for _ in range(r.randint(1, 6)))


def prose(r: random.Random, n: int) -> str:
    out = []
    for _ in range(n):
        out.append(word(r) + r.choice(["", "", "", ".", ","]))
        out.append(r.choice([" ", " ", " ", "\n", "\t", "  "]))
    return "".join(out)


def rows(seed: int = 1, n: int = 40) -> list[tuple]:
    """Texts with shared passages, copies, near copies, nulls, empty and very long ones."""
    r = random.Random(seed)
    shared = [prose(r, 90) for _ in range(3)]
    texts: list[str | None] = []
    for i in range(n):
        t = prose(r, r.randint(1, 150))
        if i % 3 == 0:
            t += r.choice(shared) + prose(r, 20)
        texts.append(t)
    texts += [texts[3], texts[3], texts[5] + " tail", None, None, "", "   \n\t", "one", "é ü 　 ñ", "ab " * 3000, "x" * 5000, "- " * 400, "x" * 5000]
    near = texts[0].split(" ")
    near[len(near) // 2] = "changed"
    texts.append(" ".join(near))
    texts.append(prose(r, 20_000))
    out = []
    for i, t in enumerate(texts):
        lang, source = r.choice(["en", "de", None]), r.choice(["s1", "s2", "sé", None])
        out.append((i * 3, t, lang, source, None if t is None else len(t), 5, 7, True, "k", "h", 1, 2, 0.5, 3))
    return out


@pytest.fixture(scope="session")
def fixture_rows():
    return rows()


@pytest.fixture(scope="session")
def documents(spark, fixture_rows):
    return spark.createDataFrame(fixture_rows, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
