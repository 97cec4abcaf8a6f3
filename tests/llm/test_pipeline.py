"""The queries against their oracles, and each stage of the pipeline against a brute-force version of it."""

import hashlib
import math

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from skyanchor.llm import bpe, mixing, quality, queries, toxicity

from ..oracle import compare, connect
from .test_operators import brute_groups, brute_tokens, odd_docs

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_oracles(spark, name):
    assert compare(queries.QUERIES[name](spark, SF), connect(SF), queries.ORACLE_SQL[name]) == ""


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)))
def test_others_give_rows(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    kept, columns = docs.toPandas(), docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "toxicity", "near_dedup", "mixing", "byte_bpe"]

    def stage(k, df):
        out = corpus_pipeline.STAGES[k][1](spark, df, SF)
        assert k == 4 or out.columns == columns
        return out.toPandas()

    p = quality.fit(docs, labels).probability(quality.statistics(__import__("pyarrow").array(kept.text)))
    good = stage(0, docs)
    assert sorted(good.doc_id) == sorted(kept.doc_id[p >= quality.KEEP_AT]) and len(good) < len(kept)
    df = spark.createDataFrame(good)
    t = toxicity.fit(df, labels).probability(__import__("pyarrow").array(good.text))
    clean = stage(1, df)
    assert sorted(clean.doc_id) == sorted(good.doc_id[t < toxicity.TOXIC_AT]) and len(clean) < len(good)
    clean = clean.sort_values("doc_id").reset_index(drop=True)
    df = spark.createDataFrame(clean)
    groups = brute_groups(clean.text.tolist())
    single = stage(2, df)
    assert sorted(single.doc_id) == sorted(clean.doc_id[sorted(set(groups))])
    df = spark.createDataFrame(single)
    mixed = stage(3, df)
    words = single.text.map(brute_tokens)
    per = words.groupby(single.source).sum()
    want = []
    for i, s in zip(single.doc_id, single.source):
        rate = words.sum() / len(per) / per[s]
        u = int(hashlib.md5(f"{mixing.SEED}:{i}".encode()).hexdigest()[:13], 16) / 2**52
        want += [i] * (math.floor(rate) + (u < rate - math.floor(rate)))
    assert sorted(mixed.doc_id) == sorted(want)
    coded = stage(4, spark.createDataFrame(mixed))
    e = bpe.encoding(bpe.VOCABULARY)
    text = dict(zip(mixed.doc_id, mixed.text))
    assert len(coded) == len(mixed) and all(list(a) == e.encode_ordinary(text[i]) for i, a in zip(coded.doc_id, coded.ids))


def test_stages_take_odd_inputs(spark):
    odd = odd_docs(spark)
    for name in ("Quality_score", "toxicity_score", "COPY", "key", "Ids", "__copies2"):
        odd = odd.withColumn(name, F.lit("mine"))
    n = {}
    for name, f in corpus_pipeline.STAGES:
        out = f(spark, odd, SF)
        assert name == "byte_bpe" or (out.columns == odd.columns and out.dtypes == odd.dtypes)
        got = out.collect()
        n[name] = len(got)
        assert name == "byte_bpe" or all(r.toxicity_score == "mine" and r.COPY == "mine" for r in got)
        assert f(spark, odd.limit(0), SF).count() == 0
    assert n["toxicity"] == 13 and n["near_dedup"] == 11 and n["byte_bpe"] == 13 and 0 < n["quality"] < 13


def test_run_equals_the_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, f in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(f(spark, docs, SF).toPandas()) if name != "byte_bpe" else f(spark, docs, SF)
    got = corpus_pipeline.run(spark, SF)
    key = lambda df: sorted((r.doc_id, tuple(r.ids)) for r in df.collect())
    assert key(got) == key(docs)
