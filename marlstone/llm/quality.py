"""Quality rules: robust multivariate outliers by minimum-covariance-determinant estimates.

Statistics of a text are counted with array functions in its own row and transformed to a vector.
For each language and source the mean and covariance are those of the share H of its rows whose
covariance has the least determinant, searched from several starts: all rows, the spatial signs
about the medians, and the rows near the medians in every statistic. From each, concentration
steps keep the share H of the group's rows that lie nearest and estimate again, until no
determinant falls any more; the start that ends at the least one counts. A row is rejected when
its squared Mahalanobis distance exceeds CUTOFF.

A group's sums take in LEAST rows' worth of its language's typical rows (and a language as much of
all), so that small groups lean on the larger ones smoothly and a single row has an estimate too.
Groups are only ever aggregated - quartile sketches, and sums and products by bin of the distance's
logarithm, with a bounded number of bins - so that a group with a third of all rows costs one row a
bin and task. The nearest share H ends with a whole bin (a sixteenth of a unit of the logarithm).

Defined results: a null or empty text has no words and is base_failed; a null lang or source is a
group of its own; repeated rows are separate rows; an empty table gives no rows; other columns
are ignored. Groups that are constant in a statistic get a floor under its variance.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marlstone.llm.common import forget, materialize, same, words

#: Share of a group's rows that concentration keeps, steps at most, fall of the determinant's logarithm
#: that ends them, and rows of its language that a group takes in.
H, STEPS, SETTLED, LEAST = 0.75, 10, 0.05, 50
#: Starts, and how many deviations from the median a row of the last may lie in any statistic.
STARTS, NEAR = ("all", "signs", "near"), 2.0
#: Squared distance beyond which a row is rejected: about the chi-squared quantile with five degrees
#: of freedom at 1 - 1e-7, as the statistics have heavier tails than a normal's.
CUTOFF = 41.0
#: What makes the covariance of the nearest H of a five-dimensional normal consistent: H over the
#: chi-squared probability with seven degrees of freedom at the quantile H with five.
CONSISTENCY = 1.4125
#: Floors under the standard deviations of the transformed statistics.
FLOORS = (0.25, 0.05, 0.10, 0.10, 0.10)
D = len(FLOORS)
#: Bins of the natural logarithm of a squared distance, and how many there are at most.
PER_UNIT, BINS = 16, 400


def statistics(df: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words to doc_id, lang, source."""
    d = df.select("doc_id", "lang", "source", F.coalesce("text", F.lit("")).alias("t"))
    d = d.withColumn("w", words(F.col("t"))).withColumn("n", F.size("w"))
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    d = d.withColumn("lines", lines)
    triples = F.transform(F.sequence(F.lit(0), F.greatest(F.col("n") - 3, F.lit(0))), lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)))
    d = d.select(
        "doc_id", "lang", "source",
        F.col("n").cast("long").alias("n_words"),
        F.aggregate("w", F.lit(0), lambda a, x: a + F.length(x)).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("t", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("n") >= 3, triples).otherwise(F.array().cast("array<bigint>")).alias("g"),
    )
    # A triple's hash and place share one long; sorted, equal triples are neighbours.
    room = F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(F.size("g"), F.lit(2)).cast("double")))).cast("long")
    d = d.withColumn("room", room)
    d = d.withColumn("z", F.sort_array(F.transform("g", lambda h, i: h - F.pmod(h, F.col("room")) + i)))

    def repeated(x: Column, j: Column) -> Column:
        mine = F.get("g", F.pmod(x, F.col("room")).cast("int"))
        other = lambda k: F.get("g", F.pmod(F.get("z", k), F.col("room")).cast("int"))
        return mine.eqNullSafe(other(j - 1)) | mine.eqNullSafe(other(j + 1))

    d = d.withColumn("at", F.transform(F.filter("z", repeated), lambda x: F.pmod(x, F.col("room"))))
    covered = F.array_distinct(F.concat("at", F.transform("at", lambda x: x + 1), F.transform("at", lambda x: x + 2)))
    return d.select("doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", F.size(covered).cast("long").alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)


def vector() -> list[Column]:
    """The transformed statistics x0 .. x4."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return [
        F.log(n),
        F.log((F.col("word_chars") + 1) / n),
        F.sqrt(F.col("n_symbols") / n),
        F.sqrt(F.col("n_dup_lines") / n),
        F.asin(F.sqrt(F.least(F.col("n_repeat_words") / n, F.lit(1.0)))),
    ]


X = [f"x{i}" for i in range(D)]
PAIRS = [(i, j) for i in range(D) for j in range(i + 1)]
GROUP = ("start", "lang", "source")
SUMS = ("n", *(f"s_{x}" for x in X), *(f"p{i}_{j}" for i, j in PAIRS))


def on_group(prefix: str, columns: tuple[str, ...] = GROUP) -> Column:
    return reduce(lambda a, b: a & b, (same(F.col(c), F.col(f"{prefix}_{c}")) for c in columns))


def renamed(df: DataFrame, prefix: str, columns: tuple[str, ...] = GROUP) -> DataFrame:
    return df.withColumnsRenamed({c: f"{prefix}_{c}" for c in columns})


def moments(rows: DataFrame, *by: str) -> DataFrame:
    """Count, sums and products of the rows of each group."""
    sums = [F.count("*").cast("double").alias("n"), *[F.sum(x).alias(f"s_{x}") for x in X], *[F.sum(F.col(X[i]) * F.col(X[j])).alias(f"p{i}_{j}") for i, j in PAIRS]]
    return rows.groupBy(*by).agg(*sums)


def scaled(rows: DataFrame, *by: str) -> tuple[DataFrame, dict[str, Column], dict[str, Column]]:
    """The rows with the quartiles of their group, the group's scales (the quartiles' distance, which
    is 1.349 for a normal), and the rows' deviations from the medians in units of these."""
    quartiles = rows.groupBy(*by).agg(*[F.percentile_approx(x, [0.25, 0.5, 0.75], 1000).alias(f"q_{x}") for x in X])
    d = rows.join(renamed(quartiles, "e", by), on_group("e", by)) if by else rows.join(F.broadcast(quartiles))
    scales = {x: F.greatest((F.col(f"q_{x}")[2] - F.col(f"q_{x}")[0]) / 1.349, F.lit(f)) for x, f in zip(X, FLOORS, strict=True)}
    return d, scales, {x: (F.col(x) - F.col(f"q_{x}")[1]) / scales[x] for x in X}


def near(rows: DataFrame, *by: str) -> DataFrame:
    """The rows near the medians of their group in every statistic."""
    d, _, z = scaled(rows, *by)
    return d.where(F.greatest(*[F.abs(v) for v in z.values()]) <= NEAR).select(*rows.columns)


def pools(rows: DataFrame, least: float = LEAST) -> DataFrame:
    """Sums of ``least`` rows' worth of each language, from its rows near the medians; a language
    takes in as much of all."""
    everything = moments(near(rows)).select(*[(F.col(c) / F.col("n") * least).alias(f"a_{c}") for c in SUMS])
    own = moments(near(rows, "lang"), "lang").withColumnRenamed("lang", "o_lang")
    # One row of sums of all rows.
    d = rows.select("lang").distinct().join(own, on_group("o", ("lang",)), "left").join(F.broadcast(everything))
    d = d.select(F.col("lang").alias("u_lang"), *[(F.coalesce(c, F.lit(0.0)) + F.col(f"a_{c}")).alias(c) for c in SUMS])
    return d.select("u_lang", *[(F.col(c) / F.col("n") * least).alias(f"u_{c}") for c in SUMS])


def estimate(sums: DataFrame, pool: DataFrame, scale: float) -> DataFrame:
    """Means, the Cholesky factor of the covariance and the logarithm of its determinant of each
    group, by closed expressions."""
    d = sums.join(pool, on_group("u", ("lang",)), "left")
    n = F.col("n") + F.coalesce("u_n", F.lit(0.0))
    d = d.select(*GROUP, *[((F.col(c) + F.coalesce(f"u_{c}", F.lit(0.0))) / n).alias(c) for c in SUMS[1:]])

    def covariance(i: int, j: int) -> Column:
        c = (F.col(f"p{i}_{j}") - F.col(f"s_{X[i]}") * F.col(f"s_{X[j]}")) * scale
        return F.greatest(c, F.lit(0.0)) + F.lit(FLOORS[i] ** 2) if i == j else c

    d = d.select(*GROUP, *[F.col(f"s_{x}").alias(f"m_{x}") for x in X], *[covariance(i, j).alias(f"c{i}_{j}") for i, j in PAIRS])
    for j in range(D):
        rest = lambda i: reduce(lambda a, k: a - F.col(f"l{i}_{k}") * F.col(f"l{j}_{k}"), range(j), F.col(f"c{i}_{j}"))  # noqa: B023, E731
        d = d.withColumn(f"l{j}_{j}", F.sqrt(F.greatest(rest(j), F.lit(1e-9))))
        d = d.withColumns({f"l{i}_{j}": rest(i) / F.col(f"l{j}_{j}") for i in range(j + 1, D)})
    det = reduce(lambda a, i: a + 2 * F.log(f"l{i}_{i}"), range(1, D), 2 * F.log("l0_0"))
    return renamed(d.select(*GROUP, det.alias("logdet"), *[f"m_{x}" for x in X], *[f"l{i}_{j}" for i, j in PAIRS]), "e")


def with_distance(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """The rows once for each estimate of their group: adds start, and d2, the squared Mahalanobis
    distance, by forward substitution."""
    d = rows.join(groups, on_group("e", GROUP[1:]))
    for i in range(D):
        rest = reduce(lambda a, k: a - F.col(f"l{i}_{k}") * F.col(f"y{k}"), range(i), F.col(X[i]) - F.col(f"m_{X[i]}"))
        d = d.withColumn(f"y{i}", rest / F.col(f"l{i}_{i}"))
    d2 = reduce(lambda a, i: a + F.col(f"y{i}") * F.col(f"y{i}"), range(1, D), F.col("y0") * F.col("y0"))
    return d.select(*rows.columns, F.col("e_start").alias("start"), d2.alias("d2"))


def nearest(rows: DataFrame) -> DataFrame:
    """Sums of the rows whose distance lies among the nearest H of their group: rows are summed by
    bin of distance, and then the bins up to the share H."""
    bin_ = F.least(F.greatest(F.floor(F.log(F.col("d2") + 1e-6) * PER_UNIT) + BINS // 2, F.lit(0)), F.lit(BINS))
    bins = moments(rows.withColumn("bin", bin_), *GROUP, "bin")
    group = W.partitionBy(*GROUP)
    bins = bins.withColumn("before", F.sum("n").over(group.orderBy("bin")) - F.col("n")).withColumn("all", F.sum("n").over(group))
    return bins.where(F.col("before") < F.col("all") * H).groupBy(*GROUP).agg(*[F.sum(c).alias(c) for c in SUMS])


def first_sums(rows: DataFrame) -> DataFrame:
    """Sums of the rows that each start takes its first estimate from."""
    d, scales, z = scaled(rows, *GROUP[1:])
    length = F.sqrt(reduce(lambda a, b: a + b, (v * v for v in z.values())))
    signs = [(F.col(f"q_{x}")[1] + scales[x] * z[x] * math.sqrt(D) / F.greatest(length, F.lit(1e-9))).alias(x) for x in X]
    close = F.greatest(*[F.abs(v) for v in z.values()]) <= NEAR
    own = [F.col(x) for x in X]
    starts = zip(STARTS, (own, signs, own), (F.lit(True), F.lit(True), close), strict=True)
    options = F.array(*[F.when(which, F.struct(F.lit(name).alias("start"), *columns)) for name, columns, which in starts])
    return moments(d.select(*GROUP[1:], F.explode(F.array_compact(options)).alias("v")).select(*GROUP[1:], "v.*"), *GROUP)


def estimates(rows: DataFrame) -> DataFrame:
    """The estimate of each group from the start that comes to the least determinant."""
    pool = materialize(pools(rows), "pools")
    sums = materialize(first_sums(rows), "moments")
    groups = materialize(estimate(sums, pool, 1.0), "groups")
    names = [f"e_{c}" for c in GROUP]
    for step in range(STEPS):
        forget(sums)
        sums = materialize(nearest(with_distance(rows, groups)), "moments")
        new = materialize(estimate(sums, pool, 1.0), "groups")
        old = renamed(groups.select(*names, F.col("logdet").alias("old")), "o", tuple(names))
        fall = new.join(old, on_group("o", tuple(names))).agg(F.max(F.col("old") - F.col("logdet"))).first()[0]
        forget(groups)
        groups = new
        # The first step may raise a determinant: a start's rows need not be a share H.
        if fall is None or step and fall < SETTLED:
            break
    best = groups.groupBy(*names[1:]).agg(F.min_by("e_start", F.struct("logdet", "e_start")).alias("e_start"))
    out = materialize(estimate(sums.join(best, on_group("e"), "left_semi"), pool, CONSISTENCY), "groups")
    forget(sums, groups, pool)
    return out


def distances(vectors: DataFrame) -> DataFrame:
    """Adds d2, the squared distance to the estimate of the row's lang and source, to rows with
    lang, source, x0 .. x4 and whatever other columns."""
    return with_distance(vectors, estimates(vectors.select("lang", "source", *X))).drop("start")


def verdicts(docs: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """doc_id, n_words, the four statistics, base_failed, kept and distance (null where base_failed)."""
    counts = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    stats = statistics(docs).withColumn("base_failed", base_failed())
    stats = stats.select(*counts, *[F.col(c).cast("string").alias(c) for c in ("lang", "source")], *[v.alias(x) for x, v in zip(X, vector(), strict=True)])
    stats = materialize(stats, "stats")
    scored = distances(stats.where(~F.col("base_failed"))).select(*counts, (F.col("d2") <= cutoff).alias("kept"), F.col("d2").alias("distance"))
    return scored.union(stats.where("base_failed").select(*counts, F.lit(False).alias("kept"), F.lit(None).cast("double").alias("distance")))


assert math.isclose(H, 0.75)  # CONSISTENCY belongs to this share
