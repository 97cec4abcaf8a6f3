"""Mixing sources to target weights by repetition rates.

Source s, of n_s tokens, is to give the share w_s of a total of T tokens: its
repetition rate is r_s = w_s T / n_s.  A document is emitted floor(r_s) times,
and once more if a hash of its doc_id and the seed, taken as a uniform number in
[0, 1), is below the fraction of r_s.  All of it is in built-in expressions; the
only shuffle is that of one partial sum per source and partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textkit import cut, fresh, without

SEED = "mix-1"
#: Rates are joined by broadcast up to so many sources, and by a shuffle beyond.
BROADCAST_SOURCES = 100_000


#: Scripts that are written without blanks between words: each of their characters is a token.
SCRIPTS = ("Han", "Hiragana", "Katakana", "Thai", "Lao", "Khmer", "Myanmar")


def token_pattern(name: str) -> str:
    """A token: one character of SCRIPTS, or a run of others than blanks, tabs and line ends; name formats a script's class."""
    scripts = "".join(name.format(s) for s in SCRIPTS)
    return f"[{scripts}]|[^ \\t\\n\\r\\f{scripts}]+"


def token_count(text="text"):
    """Tokens of a text, see token_pattern; 0 of a null one.

    All of SCRIPTS lie from U+0E00 on: a text without such characters is counted by the simpler half of the pattern.
    """
    t = F.col(text)
    mixed = F.regexp_count(t, F.lit(token_pattern("\\p{{Is{}}}")))
    count = F.when(t.rlike("[\\x{0E00}-\\x{10FFFF}]"), mixed).otherwise(F.regexp_count(t, F.lit("[^ \\t\\n\\r\\f]+")))
    return F.coalesce(count, F.lit(0)).cast("bigint")


def uniform(doc_id, text, seed: str):
    """A number in [0, 1) from 52 bits of an MD5 of seed and doc_id, or of the text where doc_id is null."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), text, F.lit("")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def rates(docs: DataFrame, weights: dict[str | None, float] | None = None, total: int | None = None, tokens: Column | None = None) -> DataFrame:
    """(source, tokens, rate) for each source, null being one of them.

    weights need not add up to 1; a source that they don't name gets none, and the
    share of one that isn't there or has no tokens goes to the others.
    Without weights all sources that have tokens weigh the same.  total is by
    default the number of tokens there are.  A source without tokens has rate 0.
    tokens counts a document's, token_count() by default.
    """
    tokens = cut(docs.select("source", (token_count() if tokens is None else tokens).alias("tokens")).groupBy("source").agg(F.sum("tokens").alias("tokens")))
    if weights is None:
        weighed = tokens.withColumn("weight", F.when(F.col("tokens") > 0, 1.0).otherwise(0.0))
    else:
        given = docs.sparkSession.createDataFrame([(k, float(w)) for k, w in weights.items()], "of string, weight double")
        joined = tokens.join(given, F.col("source").eqNullSafe(F.col("of")), "left")
        weighed = joined.select("source", "tokens", F.when(F.col("tokens") > 0, F.coalesce("weight", F.lit(0.0))).otherwise(0.0).alias("weight"))
    sums = weighed.agg(F.sum("weight").alias("all_weight"), F.sum("tokens").alias("all_tokens"))
    goal = F.col("all_tokens") if total is None else F.lit(int(total))
    rate = F.when((F.col("tokens") > 0) & (F.col("all_weight") > 0), F.col("weight") / F.col("all_weight") * goal / F.col("tokens"))
    return weighed.crossJoin(sums).select("source", "tokens", F.coalesce(rate, F.lit(0.0)).alias("rate"))


def mix_sources(
    docs: DataFrame, weights: dict[str | None, float] | None = None, total: int | None = None, seed: str = SEED, ordinal: str | None = "copy", tokens: Column | None = None
) -> DataFrame:
    """The documents, each as often as its source's rate asks, with the copy's number from 0 in column ordinal.

    Equal rows fare alike, as the Bernoulli copy hangs on doc_id; a null doc_id
    hangs on the text.  Null and empty texts have no tokens but are repeated as
    the other documents of their source; very long ones are counted whole.  A draw
    equal to the fraction gives no copy.  All columns come through, whatever their
    names, but one of ordinal's name, which is replaced; with ordinal None there is
    none.  doc_id may be of any type that has a text form.  An empty table gives an empty one.
    """
    own_source, own_rate, own_copies, own_copy = fresh(docs.columns, "of_source", "rate", "copies", "ordinal")
    rate = cut(rates(docs, weights, total, tokens).select(F.col("source").alias(own_source), F.col("rate").alias(own_rate)))
    if rate.count() <= BROADCAST_SOURCES:
        rate = F.broadcast(rate)
    base = without(docs, ordinal or "")
    whole = F.floor(own_rate).cast("bigint")
    copies = whole + (uniform(base["doc_id"], base["text"], seed) < F.col(own_rate) - whole).cast("bigint")
    joined = base.join(rate, base["source"].eqNullSafe(F.col(own_source))).withColumn(own_copies, copies).filter(F.col(own_copies) > 0)
    out = joined.withColumn(own_copy, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(own_copies) - 1)))
    cols = [F.col(f"`{c}`") for c in base.columns]
    return out.select(*cols, *([F.col(own_copy).alias(ordinal)] if ordinal else []))


def sql(table: str = "documents", seed: str = SEED, columns: str = "d.doc_id, d.text, d.lang, d.source, d.n_chars", ordinal: str | None = "copy") -> str:
    """DuckDB SQL for mix_sources with equal weights."""
    return f"""
WITH per AS (SELECT source, SUM(COALESCE(len(regexp_extract_all(text, '{token_pattern("\\p{{{}}}")}')), 0))::BIGINT AS tokens FROM {table} GROUP BY source),
sums AS (SELECT SUM(CASE WHEN tokens > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS all_weight, SUM(tokens)::BIGINT AS all_tokens FROM per),
rates AS (SELECT source, CASE WHEN tokens > 0 AND all_weight > 0 THEN 1.0::DOUBLE / all_weight * all_tokens / tokens ELSE 0.0::DOUBLE END AS rate FROM per, sums),
drawn AS (SELECT d.*, r.rate, ('0x' || substr(md5('{seed}:' || COALESCE(d.doc_id::VARCHAR, d.text, '')), 1, 13))::BIGINT::DOUBLE / {float(1 << 52)!r}::DOUBLE AS u
  FROM {table} d JOIN rates r ON d.source IS NOT DISTINCT FROM r.source),
counted AS (SELECT *, floor(rate)::BIGINT + (u < rate - floor(rate))::BIGINT AS copies FROM drawn)
SELECT {columns}{f', unnest(range(d.copies)) AS {ordinal}' if ordinal else ''} FROM counted d{'' if ordinal else ', unnest(range(d.copies))'} WHERE d.copies > 0
"""
