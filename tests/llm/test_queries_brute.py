"""The queries that SQL can't express, over their whole tables, against brute-force versions on the driver."""

import numpy as np
import pyarrow as pa
import pytest

from skyanchor.llm import bpe, fingerprint, jpeg, quality, queries, rans, textkit, toxicity

from .test_operators import brute_groups, java_pixels

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").toPandas().sort_values("doc_id").reset_index(drop=True)


def rows(spark, name):
    return queries.QUERIES[name](spark, SF).toPandas()


def test_op3(spark, docs):
    got = rows(spark, "op3_byte_bpe").set_index("doc_id")
    e = bpe.encoding(bpe.VOCABULARY)
    assert len(got) == len(docs)
    for i, t in zip(docs.doc_id, docs.text):
        assert list(got.ids[i]) == e.encode_ordinary(t) and got.decoded[i] == t


def test_op4(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    p = quality.fit(spark.read.parquet(f"{SF}/documents.parquet"), labels).probability(quality.statistics(pa.array(docs.text)))
    got = rows(spark, "op4_quality_classifier")
    assert sorted(got.doc_id) == sorted(docs.doc_id[np.round(p, 9) >= quality.KEEP_AT])
    known = labels.toPandas().set_index("doc_id").quality
    kept = known.index.isin(got.doc_id)
    assert (kept == (known == 1)).mean() > 0.9


def test_op5(spark, docs):
    coded = queries.QUERIES["op5_rans_tokens"](spark, SF).cache()
    got = rans.decode(coded).toPandas().set_index("doc_id").ids
    e = bpe.encoding(bpe.VOCABULARY)
    assert len(got) == len(docs) and all(list(got[i]) == e.encode_ordinary(t) for i, t in zip(docs.doc_id, docs.text))
    coded.unpersist()


def test_op6(spark, docs):
    groups: dict = {}
    for i, g in zip(docs.doc_id, brute_groups(docs.text.tolist())):
        groups.setdefault(g, []).append(i)
    got = {r.doc_id: list(r.copies) for r in rows(spark, "op6_minhash_dedup").itertuples()}
    assert got == {ids[0]: ids[1:] for ids in groups.values()} and any(got.values())


def test_op7(spark, docs):
    got = rows(spark, "op7_fingerprints").set_index("doc_id")
    h, b = textkit.shingles(pa.array(docs.text), fingerprint.SHINGLE_WORDS)
    each = [np.unique(h[b[i] : b[i + 1]]) for i in range(len(docs))]
    of = {s: np.unique(np.concatenate([each[i] for i in np.flatnonzero(docs.source == s)])) for s in docs.source.unique()}
    for i, (d, s) in enumerate(zip(docs.doc_id, docs.source)):
        r = got.loc[d]
        assert np.array(r.sketch, np.int64).view(np.uint64).tolist() == each[i][: fingerprint.K].tolist()
        assert abs(r.n_distinct / max(len(each[i]), 1) - 1) < 0.35 and abs(r.source_distinct / len(of[s]) - 1) < 0.35
        low = each[i][each[i] <= of[s][: fingerprint.K][-1]]
        assert np.isnan(r.containment) == (len(low) == 0)
        assert (np.isnan(r.containment) or r.containment == 1.0) and abs(r.resemblance - len(each[i]) / len(of[s])) < 0.15
    sketch = [set(x[: fingerprint.K].tolist()) for x in each]
    for i, d in enumerate(docs.doc_id):
        r, same = got.loc[d], [j for j in range(len(docs)) if sketch[j] == sketch[i]]
        assert (r.class_id, r.n_copies) == (docs.doc_id[same[0]], len(same))
        assert r.n_links == sum(j != i and not sketch[i].isdisjoint(x) for j, x in enumerate(sketch))
    assert got.n_copies.max() > 1 and got.n_links.max() > got.n_copies.max()


def test_op8(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    p = toxicity.fit(spark.read.parquet(f"{SF}/documents.parquet"), labels).probability(pa.array(docs.text))
    got = rows(spark, "op8_toxicity")
    assert sorted(got.doc_id) == sorted(docs.doc_id[np.round(p, 9) < toxicity.TOXIC_AT])


def test_op9(spark):
    got = rows(spark, "op9_media_tensors").set_index("vec_id")
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    assert len(got) == len(vectors) and got.error.isna().all()
    for k, r in enumerate(vectors.itertuples()):
        rgb = np.frombuffer(got.tensor[r.vec_id], np.uint8).reshape(16, 24, 3).astype(int)
        want = jpeg.picture(list(r.embedding), r.label)
        assert np.abs(rgb - want).mean() < 15
        if k % 100 == 0:
            assert np.abs(rgb - java_pixels(spark, jpeg.encode_progressive(want))).max() <= 3
