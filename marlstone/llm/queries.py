"""The queries of these operators and the SQL that their rows must equal."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import decontamination, logindex, mixing, quality, quotes, secrets, simhash, suffixes, tokens, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str = "word_bpe_49k.json") -> str:
    """Where a public tokenizer's file lies."""
    import public_tokenizers

    return os.fspath(public_tokenizers.path(name))


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find(table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.deduplicate(table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return quality.verdicts(table(spark, sf_dir, "documents")).select(*columns)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.conversations(table(spark, sf_dir, "conversations"))


def op7_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.round_trip(table(spark, sf_dir, "documents"), tokenizer())


def op8_logindex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logindex.deduplicate(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    # The passages as text: start:end:e-value of each, in tokens.
    passages = F.array_join(F.transform("segments", lambda x: F.format_string("%d:%d:%.2e", x["start"], x["end"], x["e_value"])), ",")
    return scored.select("doc_id", "held_out", "score", "predicted", passages.alias("passages"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.withColumn("target", F.round("target", 6))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_secrets, op2_decontamination, op3_suffixes, op4_quality, op5_simhash, op6_quotes, op7_tokens, op8_logindex, op9_toxicity, op10_mixing)
}

WORDS = r"list_filter(string_split_regex(coalesce(%s, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

#: Five-word shingles of documents and items, and how many of an item's a document has.
OP2 = f"""
WITH b AS (SELECT item_id, {WORDS % "lower(text)"} AS w FROM benchmark),
bs AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM b WHERE len(w) > 0) t),
q AS (SELECT item_id, count(*) AS n_item FROM bs GROUP BY item_id),
d AS (SELECT doc_id, {WORDS % "lower(text)"} AS w FROM documents),
ds AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0) t),
c AS (SELECT doc_id, item_id, count(*) AS n_shared FROM ds JOIN bs USING (s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_item, n_shared, n_shared / n_item AS containment FROM c JOIN q USING (item_id) WHERE n_shared * 5 >= n_item * 4
"""

#: Windows of 13 words, the smallest document that has each, and the words that repeats cover.
OP8 = f"""
WITH d AS (SELECT doc_id, {WORDS % "text"} AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) > 12) t),
f AS (SELECT k, min(doc_id) AS first FROM g GROUP BY k),
h AS (SELECT g.doc_id, g.i FROM g JOIN f ON g.k = f.k WHERE f.first < g.doc_id),
c AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(i, i + 13)) AS p FROM h) t),
t AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word FROM d),
m AS (SELECT t.doc_id, t.p, t.word, c.p IS NOT NULL AS gone FROM t LEFT JOIN c ON t.doc_id = c.doc_id AND t.p = c.p),
r AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, string_agg(word, ' ' ORDER BY p) FILTER (WHERE NOT gone) AS kept FROM m GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(r.n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(r.kept, '')) AS kept_sha256 FROM d LEFT JOIN r ON d.doc_id = r.doc_id
"""

#: Targets by the level at which uncapped sources share; rows in order of hash up to the budget,
#: then short rows in order of hash up to what is left.
OP10 = f"""
WITH d AS (SELECT doc_id, source, len({WORDS % "text"})::BIGINT AS size, md5(doc_id::VARCHAR) AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
n AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS w, (sum(source_size) OVER ())::DOUBLE AS total FROM s),
o AS (SELECT *, (3 * source_size)::DOUBLE AS cap, (total - coalesce(sum((3 * source_size)::DOUBLE) OVER (ORDER BY 3.0 * source_size / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY 3.0 * source_size / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM n),
l AS (SELECT *, min(CASE WHEN cap > level * w THEN 3.0 * source_size / w END) OVER () AS stop FROM o),
v AS (SELECT *, max(CASE WHEN 3.0 * source_size / w = stop THEN level END) OVER () AS rest FROM l),
g AS (SELECT source, source_size, CASE WHEN cap <= level * w THEN cap ELSE rest * w END AS target FROM v),
b AS (SELECT *, CASE WHEN source_size > 0 THEN floor(least(target / source_size, 3.0)) ELSE 0 END::BIGINT AS whole FROM g),
c AS (SELECT d.*, b.source_size, b.target, b.whole, b.target - b.whole * b.source_size AS budget, sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h) AS up FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source),
f AS (SELECT source, min(CASE WHEN size > 0 AND up > budget THEN h END) AS cut, max(budget) - max(CASE WHEN up <= budget THEN up ELSE 0 END) AS missing FROM c GROUP BY source),
e AS (SELECT c.*, f.cut, f.missing, c.h < coalesce(f.cut, '~') AS once, f.cut IS NOT NULL AND c.h >= f.cut AND c.size * 4 <= f.missing AS short FROM c JOIN f ON c.source IS NOT DISTINCT FROM f.source),
k AS (SELECT *, CASE WHEN short THEN sum(CASE WHEN short THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY h) END AS more FROM e),
x AS (SELECT source, min(CASE WHEN size > 0 AND more > missing THEN h END) AS edge, max(missing) - max(CASE WHEN more <= missing THEN more ELSE 0 END) AS still FROM k GROUP BY source)
SELECT k.doc_id, k.size, k.source_size, round(k.target, 6) AS target,
k.size * least(k.whole + CASE WHEN k.once OR (k.short AND (x.edge IS NULL OR k.h < x.edge OR (k.h = x.edge AND x.still * 2 >= k.size))) THEN 1 ELSE 0 END, 3) AS taken
FROM k JOIN x ON k.source IS NOT DISTINCT FROM x.source
"""

#: The others have no SQL form: hashes that DuckDB lacks, estimates by iteration, files. Windows of
#: 400 bytes (op3) would be too slow on whole tables. Tests hold these against brute force.
ORACLE: dict[str, str] = {name: " ".join(sql.split()) for name, sql in (("op2_decontamination", OP2), ("op8_logindex", OP8), ("op10_mixing", OP10))}
