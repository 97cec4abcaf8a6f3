"""Small and awkward inputs for each operator, against brute force, exact round trips and held-out labels."""

import math
import os
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skyanchor.llm import bpe, chat, features, fingerprint, jpeg, minhash, mixing, quality, rans, textkit, toxicity, urls

SF, SF01 = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(200)) for _ in range(n))


def odd_docs(spark):
    long = prose(1, 200_000)
    rows = [
        (1, None, "en", "a", 0), (2, "", None, "a", 0), (None, "no id here", "en", None, 10), (4, long, "en", "b", len(long)), (5, "w" * 1_500_000, "en", "b", 1_500_000),
        (6, "same text", "en", "a", 9), (6, "same text", "en", "a", 9), (7, "same text", "de", "b", 9), (8, " \n\t ", "en", "a", 4), (9, "!!! ??? ...", None, None, 11),
        (None, None, None, None, None), (10, "é ü ñ 漢字 🙂", "es", "c", 11), (6, "other text of six", "en", "c", 17),
    ]
    return spark.createDataFrame(rows, DOCS)


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], DOCS)


def brute_tokens(text):
    """Characters of scripts without blanks, and what lies between them and blanks."""
    alone, n, inside = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fff]"), 0, False
    for c in text or "":
        single, blank = bool(alone.match(c)), c in " \t\n\r\f"
        n += single or not (blank or inside)
        inside = not (single or blank)
    return n


# text primitives


def test_words_and_shingles_against_python():
    texts = ["Hello, world! HELLO été", None, "", "a b c d", "x", "q" * 700_000 + " tail", "Hello, world! HELLO été"]
    h, rows, count = textkit.words(pa.array(texts))
    want = [re.findall(r"[0-9a-z\u0080-\U0010ffff]+", (t or "").lower()) for t in texts]
    assert count.tolist() == [len(w) for w in want]
    by_word = {}
    for v, w in zip(h.tolist(), [w for ws in want for w in ws]):
        assert by_word.setdefault(w, v) == v
    assert len(set(by_word.values())) == len(by_word)
    s, b = textkit.shingles(pa.array(texts), 3)
    assert np.diff(b).tolist() == [max(len(w) - 2, min(len(w), 1)) for w in want]
    assert s[b[0] : b[1]].tolist() == s[b[6] : b[7]].tolist()


# 1 URL filters


def test_urls(spark, tmp_path):
    pages = spark.createDataFrame(
        [
            (1, "https://BAD.example.com./x?q=1#f", "z"), (2, "http://user@sub.bad.example.com:80/y", None), (3, "https://notbad.example.com/", None), (4, "https://ok.org/page?id=7", None), (5, "https://ok.org/page?id=8", None),
            (6, None, None), (7, "", None), (8, "bad.example.com", None), (9, "https://ok.org/whole?x=1", None), (1, "https://BAD.example.com./x?q=1#f", "z"), (10, "http://" + "a" * 100_000 + ".org/", None),
        ],
        "page_id int, url string, RULE string",
    )
    block = spark.createDataFrame([("Bad.Example.com",), ("https://ok.org/page?id=7",), ("ok.org/whole",), (None,), ("",), ("bad.example.com",)], "entry string")
    got = urls.filter_urls(pages, block, str(tmp_path / "d")).collect()
    assert sorted((r.page_id, r.blocked, r.rule) for r in got) == sorted(
        [(1, True, "d:bad.example.com")] * 2
        + [(2, True, "d:bad.example.com"), (3, False, None), (4, True, "u:ok.org/page?id=7"), (5, False, None), (6, False, None), (7, False, None), (8, True, "d:bad.example.com"), (9, True, "u:ok.org/whole"), (10, False, None)],
        key=lambda r: r,
    )
    assert sum(r.blocked for r in urls.filter_urls(pages, block.limit(0), str(tmp_path / "e")).collect()) == 0
    assert urls.filter_urls(pages.limit(0), block, str(tmp_path / "f")).count() == 0


def test_digest_collisions_are_told_apart(tmp_path):
    stem = str(tmp_path / "s")
    names = [b"d:one", b"d:two"]
    np.array([5, 5], np.int64).tofile(f"{stem}.keys")
    np.array([0, 5, 10], np.int64).tofile(f"{stem}.offsets")
    with open(f"{stem}.strings", "wb") as f:
        f.write(b"".join(names))
    tried = ["d:two", "d:six", "d:one"]
    assert urls.probe(np.array([5, 5, 5]), lambda i: tried[i], [(5, 5, 2, stem)]).tolist() == [True, False, True]


# 2 mixing


def test_mixing_against_python(spark):
    import hashlib

    d = odd_docs(spark)
    rows = [(r.doc_id, r.text, r.source) for r in d.collect()]
    tokens = {}
    for _, t, s in rows:
        tokens[s] = tokens.get(s, 0) + brute_tokens(t)
    live = [s for s in tokens if tokens[s]]
    want = []
    for i, t, s in rows:
        rate = sum(tokens.values()) / len(live) / tokens[s] if tokens[s] else 0
        key = str(i) if i is not None else (t or "")
        u = int(hashlib.md5(f"{mixing.SEED}:{key}".encode()).hexdigest()[:13], 16) / 2**52
        want += [(i, s, len(t or ""), k) for k in range(math.floor(rate) + (u < rate - math.floor(rate)))]
    got = [(r.doc_id, r.source, len(r.text or ""), r.copy) for r in mixing.mix_sources(d.withColumn("COPY", F.lit("x"))).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert mixing.mix_sources(d.limit(0)).count() == 0


def test_mixing_weights(spark):
    d = spark.createDataFrame([(i, "w " * 10, "en", "abc"[i % 3], 20) for i in range(3000)], DOCS)
    got = {r.source: r.n for r in mixing.mix_sources(d, {"a": 3, "b": 1}).groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert set(got) == {"a", "b"} and abs(got["a"] - 2250) < 60 and abs(got["b"] - 750) < 60


# 3 BPE


def test_bpe_equals_the_library_and_round_trips(spark):
    d = odd_docs(spark).withColumn("IDS", F.lit(1))
    got = bpe.encode(d, decode=True).collect()
    want = [(r.doc_id, r.text) for r in d.collect()]
    assert sorted(((r.doc_id, r.decoded) for r in got), key=repr) == sorted(want, key=repr)
    e = bpe.encoding(bpe.VOCABULARY)
    for r in got:
        assert r.ids == (None if r.decoded is None else e.encode_ordinary(r.decoded)) and r.n_tokens == (None if r.ids is None else len(r.ids))
    assert bpe.encode(d.limit(0), decode=True).count() == 0


def test_bpe_over_several_blocks(spark, monkeypatch):
    d = docs_of(spark, [prose(i, 50) for i in range(60)] + ["dup dup"] * 5)
    got = {r.doc_id: r.ids for r in bpe.encode(d.repartition(4), buckets=3).collect()}
    e = bpe.encoding(bpe.VOCABULARY)
    assert all(got[r.doc_id] == e.encode_ordinary(r.text) for r in d.collect()) and len(got) == 65


def test_decoding_of_odd_ids(spark):
    t = spark.createDataFrame([([72, 73],), (None,), ([],), ([-1, 10**7],), ([220, None, 220],), ([128 + 40],)], "ids array<int>")
    assert [r.decoded for r in bpe.decode(t).collect()][1:5] == [None, "", "", "  "]


# 4 quality


def test_quality_held_out(spark):
    docs, labels = spark.read.parquet(f"{SF01}/documents.parquet"), spark.read.parquet(f"{SF01}/labels.parquet")
    model = quality.fit(docs, labels.filter("doc_id % 3 <> 0"))
    got = quality.score(docs, model).join(labels.filter("doc_id % 3 = 0"), "doc_id").select("quality_score", "quality").toPandas()
    assert ((got.quality_score >= quality.KEEP_AT) == (got.quality == 1)).mean() > 0.95


def test_quality_odd_inputs(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.fit(docs, labels)
    got = quality.score(odd_docs(spark).withColumn("Quality_Score", F.lit("x")), model).collect()
    assert len(got) == 13 and all(0 <= r.quality_score <= 1 for r in got) and all(r.quality_score == 0 for r in got if not r.text)
    assert len({r.quality_score for r in got if r.text == "same text"}) == 1
    assert quality.score(docs.limit(0), model).count() == 0
    assert quality.keep_good(docs, labels.limit(0)).count() == docs.filter("text <> ''").count()
    messy = spark.createDataFrame([(0, 1, None), (0, 0, None), (None, 1, 0), (1, None, 0)], "doc_id bigint, quality int, toxic int")
    assert features.labelled(docs, messy, "quality", 100).count() == 0


def test_isotonic():
    x, y = quality.isotonic(np.arange(5.0), np.array([0.0, 0.6, 0.4, 0.3, 1.0]), np.ones(5))
    assert np.all(np.diff(y) >= 0) and np.interp([1, 2, 3], x, y) == pytest.approx([1.3 / 3] * 3)


def test_normal_equations_solve_ridge(spark):
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(50, 3)), rng.integers(0, 2, 50)
    rows = spark.createDataFrame([(a.tolist(), int(b)) for a, b in zip(x, y)], "x array<double>, y int").repartition(4)
    m = features.summed(rows, quality._xy(lambda a, b: np.concatenate([a.T @ a, (a.T @ b)[:, None]], axis=1)))
    assert np.allclose(m[:, :3], x.T @ x) and np.allclose(m[:, 3], x.T @ y)


# 5 rANS


def test_rans_round_trip_checkpoints_and_damage(spark):
    rng = np.random.default_rng(0)
    parts = [rng.geometric(0.02, n) % 900 for n in (0, 1, 63, 64, 65, 70_000, 5000, 17_000)]
    t = rans.Table.of(np.bincount(np.concatenate(parts), minlength=1000))
    assert rans.Table.unpack(t.pack()).crc == t.crc and int(t.freq.sum()) == 1 << rans.SCALE
    for p, (data, marks) in zip(parts, rans.encode_blocks(parts, t)):
        assert (rans.decode_block(data, marks, len(p), t) == p).all()
        whole = [rans.decode_block(data, marks, len(p), t, k, k + 1) for k in range(len(marks) // (8 * (rans.LANES + 1)))]
        assert (np.concatenate([*whole, np.zeros(0)]) == p).all()
    p = parts[5]
    bits = -np.log2(np.bincount(p)[p] / len(p)).sum()
    own = rans.Table.of(np.bincount(p))
    assert len(rans.encode_blocks([p], own)[0][0]) * 8 < bits * 1.02 + 64 * 64
    with pytest.raises(ValueError):
        rans.encode_blocks([np.array([999])], t)


def test_rans_operator(spark):
    d = odd_docs(spark)
    tokens = rans.tokenised(d)
    coded = rans.encode(tokens).cache()
    key = lambda df: sorted(((r.doc_id, r.ids) for r in df.collect()), key=repr)
    assert key(rans.decode(coded)) == key(tokens) == key(rans.decode(rans.encode_documents(d)))
    bad = coded.withColumn("payload", F.when(F.col("kind") == "block", F.concat("payload", F.lit(b"\0\0\0\0"))).otherwise(F.col("payload")))
    with pytest.raises(Exception, match="damaged"):
        rans.decode(bad).collect()
    none = rans.encode(tokens.limit(0))
    assert [r.kind for r in none.collect()] == ["table"] and rans.decode(none).count() == 0
    coded.unpersist()


# 6 near duplicates


def brute_groups(texts, threshold=minhash.THRESHOLD):
    s, b = textkit.shingles(pa.array(texts, pa.string()), minhash.SHINGLE_WORDS)
    sets = [set(s[b[i] : b[i + 1]].tolist()) for i in range(len(texts))]
    up = list(range(len(texts)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            same = texts[i] == texts[j] or (sets[i] and sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= threshold)
            if same:
                up[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(texts))]


def edited(text, n, seed):
    r = random.Random(seed)
    w = text.split()
    for _ in range(n):
        w[r.randrange(len(w))] = "edit" + str(r.randrange(10**6))
    return " ".join(w)


def test_near_dedup_equals_brute_force(spark):
    texts = []
    for i in range(25):
        base = prose(i, 120)
        texts += [base] + [edited(base, k, 100 * i + k) for k in range(i % 6)] + ([base] if i % 4 == 0 else [])
    shared = prose(999, 60)
    texts += [shared + " " + prose(2000 + i, 200) for i in range(10)] + ["", "", "!!!", "short", "Short."]
    hub = prose(555, 300)
    texts += [edited(hub, 12, 7000 + i) for i in range(80)]
    want = {}
    for i, g in enumerate(brute_groups(texts)):
        want.setdefault(g, []).append(i)
    got = {r.doc_id: r.copies for r in minhash.deduplicated(docs_of(spark, texts).repartition(5)).collect()}
    assert got == {g: [i for i in ids if i != g] for g, ids in want.items()}
    kept = [r.doc_id for r in minhash.near_dedup(docs_of(spark, texts)).collect()]
    assert sorted(kept) == sorted(want)


def test_near_dedup_odd_inputs(spark):
    d = odd_docs(spark).withColumn("KEY", F.lit(3)).withColumn("keep", F.lit(4))
    got = [(r.doc_id, r.text) for r in minhash.near_dedup(d).collect()]
    assert got.count((6, "same text")) == 1 and (7, "same text") not in got and got.count((6, "other text of six")) == 1
    assert sum(t is None for _, t in got) == 2 and len(got) == 11
    assert minhash.near_dedup(d).columns == d.columns
    assert minhash.near_dedup(d.limit(0)).count() == 0 and minhash.deduplicated(d.limit(0)).count() == 0


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(0)
    for n, m in ((3, 1), (40, 20), (2000, 1200)):
        a, b = rng.integers(0, 1 << 63, n, dtype=np.uint64), rng.integers(0, 1 << 63, n, dtype=np.uint64)
        b[:m] = a[:m]
        s = minhash.sketch(np.concatenate([a, b]), np.array([0, n, 2 * n]), 1024)
        assert not (s == minhash.FULL).any() and abs((s[0] == s[1]).mean() - m / (2 * n - m)) < 0.06


def test_components(spark):
    e = spark.createDataFrame([(1, 2), (3, 2), (9, 8), (8, 7), (7, 6), (6, 5), (20, 21), (3, 1)], "a bigint, b bigint")
    assert sorted((r.node, r.root) for r in minhash.components(e).collect()) == [(1, 1), (2, 1), (3, 1), (5, 5), (6, 5), (7, 5), (8, 5), (9, 5), (20, 20), (21, 20)]
    assert minhash.components(e.limit(0)).count() == 0


# 7 fingerprints


def test_bottom_k(spark):
    x = np.random.default_rng(0).integers(0, 1 << 64, 20_000, dtype=np.uint64)
    a, b = x[:12_000], x[6_000:]
    sa, sb = fingerprint.merge(a), fingerprint.merge(b)
    assert (fingerprint.merge(sa, sb) == fingerprint.merge(x)).all()
    assert (fingerprint.merge(fingerprint.merge(a[:100], k=256), fingerprint.merge(a[100:])) == sa).all()
    assert abs(fingerprint.distinct(sa) / 12_000 - 1) < 0.2
    r, c = fingerprint.compare(sa, sb)
    assert abs(r - 6000 / 20_000) < 0.1 and abs(c - 0.5) < 0.15
    assert fingerprint.compare(sa[:0], sb) == (0, 0) and fingerprint.distinct(x[:5]) == 5


def test_fingerprints_odd_inputs_and_exact_small_sets(spark):
    d = odd_docs(spark)
    got = fingerprint.fingerprints(d, k=10**7).collect()
    assert len(got) == 13
    sets = {}
    rows = d.collect()
    s, b = textkit.shingles(pa.array([r.text for r in rows], pa.string()), 3)
    each = [set(s[b[i] : b[i + 1]].tolist()) for i in range(len(rows))]
    for r, e in zip(rows, each):
        sets.setdefault(r.source, set()).update(e)
    want = sorted(((r.doc_id, r.source, float(len(e)), float(len(sets[r.source])), len(e) / len(sets[r.source]) if e else 0.0, 1.0 if e else 0.0) for r, e in zip(rows, each)), key=repr)
    assert sorted(((r.doc_id, r.source, r.n_distinct, r.source_distinct, r.resemblance, r.containment) for r in got), key=repr) == want
    assert fingerprint.fingerprints(d.limit(0)).count() == 0


@pytest.mark.parametrize("k", [16, 256])
def test_pairs_of_documents_are_compared(spark, k, monkeypatch):
    rng = np.random.default_rng(3)
    word = lambda n: " ".join(f"w{i}" for i in rng.integers(0, 10**6, n))
    long, hot = word(300), "one phrase that all of them hold"
    texts = [long, long, long + " and one more", " ".join(long.split()[40:160]), *(f"{hot} {word(5)}" for _ in range(60)), word(200), "", None]
    ids = [*range(len(texts) - 2), None, 2]  # the last is a second row of document 2
    d = spark.createDataFrame([(i, t, f"s{n % 3}") for n, (i, t) in enumerate(zip(ids, texts))], "doc_id bigint, text string, source string").repartition(3)
    monkeypatch.setattr(fingerprint, "MEETINGS", 50)
    monkeypatch.setattr(fingerprint, "GIVEN", 100)
    got = {}
    rows = fingerprint.near_pairs(fingerprint.fingerprints(d, k=k), k).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert list(r.near) == sorted(r.near)
        for o, *v in zip(r.near, r.near_resemblance, r.near_containment, r.near_contained):
            assert (r.doc_id, o) not in got
            got[r.doc_id, o] = tuple(v)
    s, b = textkit.shingles(pa.array(texts, pa.string()), 3)
    sketch = [np.unique(s[b[i] : b[i + 1]])[:k] for i in range(len(texts))]
    want = {}
    for i in range(len(texts) - 2):
        for j in range(i + 1, len(texts) - 2):
            if len(np.intersect1d(sketch[i], sketch[j])):
                r, c = fingerprint.compare(sketch[i], sketch[j], k)
                want[i, j] = (r, c, fingerprint.compare(sketch[j], sketch[i], k)[1])
    assert got == want
    assert got[0, 1] == (1, 1, 1) and got[0, 2][1] == 1 and got[0, 3][2] == 1 and (k < 256 or (4, 63) in got)


@pytest.mark.parametrize("k", [16, 256])
def test_every_document_has_its_class_and_the_number_of_its_links(spark, k):
    rng = np.random.default_rng(5)
    word = lambda n: " ".join(f"w{i}" for i in rng.integers(0, 10**6, n))
    long, hot = word(300), "one phrase that all of them hold"
    texts = [long, long.upper(), long + " and one more", *(f"{hot} {word(5)}" for _ in range(70)), *[f"{hot} and again"] * 9, word(200), word(1), "", "", None]
    ids = [7, 5, *range(10, 10 + len(texts) - 3), None]
    d = spark.createDataFrame([(i, t, "s") for i, t in zip(ids, texts)], "doc_id bigint, text string, source string").repartition(3)
    got = fingerprint.fingerprints(d, k=k).select("doc_id", *fingerprint.LINKS).collect()
    s, b = textkit.shingles(pa.array(texts, pa.string()), 3)
    sketch = [np.unique(s[b[i] : b[i + 1]])[:k].tolist() for i in range(len(texts))]
    want = []
    for i, x in enumerate(sketch):
        same = [j for j, y in enumerate(sketch) if x == y] if x else [i]
        links = sum(j != i and not set(x).isdisjoint(y) for j, y in enumerate(sketch))
        want.append((ids[i], min((ids[j] for j in same if ids[j] is not None), default=None), len(same), links))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert {r.class_id for r in got if r.doc_id in (7, 5)} == {5} and sum(r.n_copies == 9 for r in got) == 9
    assert fingerprint.fingerprints(d.limit(0), k=k).count() == 0


@pytest.mark.parametrize("hot_rows, hot_bytes, meetings", [(2, 1, 1), (20, 1 << 12, 50), (20, 1 << 20, 1 << 19), (10**6, 1 << 20, 300)])
def test_links_by_bitmaps_and_by_short_lists_count_alike(tmp_path, monkeypatch, hot_rows, hot_bytes, meetings):
    for name, value in (("HOT_ROWS", hot_rows), ("HOT_BYTES", hot_bytes), ("MET_ROWS", meetings), ("UNITED_ROWS", 7)):
        monkeypatch.setattr(fingerprint, name, value)
    rng = np.random.default_rng(4)
    # some hashes stand in many rows, some rows have the same ones, some none
    sketches = [np.unique(np.minimum(rng.integers(0, 60, n := rng.integers(0, 12)) ** 3, 60**3 - rng.integers(1, 10**5, n)).astype(np.uint64)) for _ in range(150)]
    sketches += sketches[:30]
    segments = []
    for at, part in enumerate((sketches[:100], sketches[100:101], sketches[101:])):
        flat, order = np.concatenate(part), np.argsort(np.concatenate(part), kind="stable")
        flat[order].tofile(f"{tmp_path}/{at}.hashes")
        np.repeat(np.arange(len(part), dtype=np.uint16), [len(x) for x in part])[order].tofile(f"{tmp_path}/{at}.owners")
        segments.append((len(part), f"{tmp_path}/{at}"))
    first, bounds = np.array([0, 100, 101, 180]), np.array([0, 50, 1000, 80_000], np.uint64)
    made = fingerprint._lists(segments, first, bounds, str(tmp_path / "lists"))([pa.RecordBatch.from_pydict({"id": [0, 1, 2, 3]})])
    lists = [x for b in made for x in b.column("stem").to_pylist()]
    sets = [set(x.tolist()) for x in sketches]
    want = [sum(not a.isdisjoint(b) for b in sets) for a in sets]
    want = [n if n > 1 else 0 for n in want]
    for at, (n, stem) in enumerate(segments):
        asked = np.arange(n)[:: 2 if at == 2 else 1]
        assert fingerprint.count_links(stem, asked, lists, bounds, first).tolist() == [want[first[at] + i] for i in asked]


def test_few_and_many_meetings_count_alike(monkeypatch):
    rng = np.random.default_rng(2)

    def part(n):
        sketches = [np.unique(rng.integers(0, 400, rng.integers(0, 12), dtype=np.uint64)) for _ in range(n)]
        flat, off = np.concatenate(sketches), np.concatenate([[0], np.cumsum([len(x) for x in sketches])])
        order = np.argsort(flat, kind="stable")
        return (None, np.arange(n), flat, off, flat[order], np.repeat(np.arange(n, dtype=np.uint16), np.diff(off))[order]), sketches

    (mine, p), (theirs, q) = part(40), part(90)
    want = {(i, j): len(np.intersect1d(p[i + 5], q[j])) for i in range(30) for j in range(90) if len(np.intersect1d(p[i + 5], q[j]))}
    for most in (0, 7, 1 << 21):  # counting in all cells, in parts of them, and sorting
        monkeypatch.setattr(fingerprint, "MEETINGS", most)
        x, y, same, held, other = fingerprint._meet(mine, 5, 35, fingerprint._slice(mine, 5, 35), theirs, 256)
        assert dict(zip(zip(x.tolist(), y.tolist()), same.tolist())) == want
        assert held.tolist() == [len(p[i + 5]) for i in x] and other.tolist() == [len(q[j]) for j in y]
    x, *_ = fingerprint._meet(mine, 0, 0, fingerprint._slice(mine, 0, 0), theirs, 256)
    assert len(x) == 0


def test_source_sketch_equals_that_of_all_texts(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet").repartition(5)
    got = {r.source: np.array(r.union, np.int64).view(np.uint64) for r in fingerprint.source_sketches(d).collect()}
    pdf = d.toPandas()
    for source, part in pdf.groupby("source"):
        s, _ = textkit.shingles(pa.array(part.text.tolist()), 3)
        assert (got[source] == fingerprint.merge(s)).all()


# 8 toxicity


def test_toxicity_held_out(spark):
    docs, labels = spark.read.parquet(f"{SF01}/documents.parquet"), spark.read.parquet(f"{SF01}/labels.parquet")
    model = toxicity.fit(docs, labels.filter("doc_id % 3 <> 0"))
    got = toxicity.score(docs, model).join(labels.filter("doc_id % 3 = 0"), "doc_id").select("toxicity_score", "toxic").toPandas()
    said = got.toxicity_score >= toxicity.TOXIC_AT
    assert (said == (got.toxic == 1)).mean() > 0.9 and (said & (got.toxic == 0)).sum() <= 0.05 * len(got)
    assert model.labels.weight.max() <= 1 and model.labels.weight.min() < 1
    # voters fire more often in toxic than in clean classes of the language where they were found
    assert model.labels.rates[model.labels.bad].max(axis=0).mean() > model.labels.rates[~model.labels.bad].max(axis=0).mean()


def test_toxicity_odd_inputs(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.fit(docs, labels)
    got = toxicity.score(odd_docs(spark).withColumn("TOXICITY_score", F.lit(1)), model).collect()
    assert len(got) == 13 and all(0 <= r.toxicity_score <= 1 for r in got) and all(r.toxicity_score == 0 for r in got if not (r.text or "").strip(" \n\t!?."))
    assert toxicity.score(docs.limit(0), model).count() == 0
    assert toxicity.keep_clean(docs, labels.limit(0)).count() == docs.count()
    assert toxicity.fit(docs.limit(0), labels).labels is None


# 9 JPEG


def java_image(spark, rgb, quality_=0.8, progressive=True):
    jvm = spark._jvm
    h, w = rgb.shape[:2]
    image = jvm.java.awt.image.BufferedImage(w, h, 1)
    for y in range(h):
        for x in range(w):
            r, g, b = map(int, rgb[y, x])
            image.setRGB(x, y, r << 16 | g << 8 | b)
    writer = jvm.javax.imageio.ImageIO.getImageWritersByFormatName("jpeg").next()
    p = writer.getDefaultWriteParam()
    p.setProgressiveMode(1 if progressive else 0)
    p.setCompressionMode(2)
    p.setCompressionQuality(quality_)
    out = jvm.java.io.ByteArrayOutputStream()
    stream = jvm.javax.imageio.ImageIO.createImageOutputStream(out)
    writer.setOutput(stream)
    writer.write(None, jvm.javax.imageio.IIOImage(image, None, None), p)
    stream.flush()
    return bytes(out.toByteArray())


def java_pixels(spark, data):
    image = spark._jvm.javax.imageio.ImageIO.read(spark._jvm.java.io.ByteArrayInputStream(data))
    return np.array([[((v := image.getRGB(x, y)) >> 16 & 255, v >> 8 & 255, v & 255) for x in range(image.getWidth())] for y in range(image.getHeight())], int)


@pytest.mark.parametrize("w,h,q,progressive", [(53, 37, 0.8, True), (16, 16, 0.3, True), (7, 5, 0.95, True), (40, 24, 0.7, False)])
def test_jpeg_against_the_jvm(spark, w, h, q, progressive):
    y, x = np.mgrid[0:h, 0:w]
    rgb = np.stack([x * 5 % 256, y * 7 % 256, (x + y) * 3 % 256], -1).astype(np.uint8)
    data = java_image(spark, rgb, q, progressive)
    assert (b"\xff\xc2" in data) == progressive
    assert np.abs(jpeg.decode(data).astype(int) - java_pixels(spark, data)).max() <= 3


def test_own_progressive_file(spark):
    rgb = jpeg.picture(np.random.default_rng(0).normal(0, 0.12, 64).tolist(), 5)
    data = jpeg.encode_progressive(rgb)
    assert np.abs(jpeg.decode(data).astype(int) - java_pixels(spark, data)).max() <= 3
    assert np.abs(jpeg.decode(data).astype(int) - rgb).mean() < 8


def test_coefficients_are_those_encoded():
    z = np.random.default_rng(1).integers(0, 256, (32, 48, 3)).astype(np.uint8)
    _, _, comps, *_ = jpeg.coefficients(jpeg.encode_progressive(z))
    y = 0.299 * z[..., 0].astype(float) + 0.587 * z[..., 1] + 0.114 * z[..., 2] - 128
    x = y.reshape(4, 8, 6, 8).transpose(0, 2, 1, 3)
    q = np.round((jpeg.DCT @ x @ jpeg.DCT.T).reshape(4, 6, 64)[..., jpeg.ZIGZAG] / jpeg.QUANT)
    assert (comps[0]["blocks"] == q).all()


def test_jpeg_operator(spark):
    good = jpeg.encode_progressive(jpeg.picture([0.1] * 64, 1))
    rows = [(1, good, "x"), (2, None, None), (3, b"", None), (4, b"no jpeg", None), (5, good[: len(good) // 2], None), (6, good[:-2], None), (1, good, "x")]
    df = spark.createDataFrame(rows, "id int, jpeg binary, Error string")
    got = jpeg.decode_media(df).collect()
    by = {r.id: r for r in got}
    assert len(got) == 7 and by[1].error is None and len(by[1].tensor) == 24 * 16 * 3 and (by[1].width, by[1].height) == (24, 16)
    assert by[2].tensor is None and by[2].error is None and all(by[i].tensor is None and by[i].error for i in (3, 4, 5, 6))
    assert jpeg.decode_media(df.limit(0)).count() == 0
    vec = spark.createDataFrame([(1, None, 1), (2, [0.5, None], None), (3, [], 2)], "vec_id bigint, embedding array<float>, label int")
    assert [r.error for r in jpeg.decode_media(jpeg.rendered(vec)).collect()] == [None] * 3


def test_damaged_files_never_crash():
    good = bytearray(jpeg.encode_progressive(jpeg.picture(np.random.default_rng(2).normal(0, 0.2, 64).tolist(), 3)))
    r = random.Random(0)
    for _ in range(150):
        bad = bytearray(good)
        for _ in range(r.randrange(1, 6)):
            bad[r.randrange(len(bad))] = r.randrange(256)
        try:
            jpeg.decode(bytes(bad))
        except (jpeg.Damaged, IndexError):
            pass


# 10 chat


def test_chat_against_python(spark):
    rows = [
        (1, 1, "assistant", "hi", 0), (1, 0, "user", "héllo\n", 0), (1, 1, "assistant", "hi", 0), (2, 0, None, "x", 0), (2, None, "system", None, 0), (None, 0, "user", "void", 0), (None, 1, "assistant", "<|im_end|>", 0),
        (3, 0, "user", "L" * 3_000_000, 0), (3, 1, "assistant", "", 0), (1, 1, "assistant", "ha", 0),
    ]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, n_turns int")
    got = {r.conv_id: r for r in chat.format_chats(df).collect()}
    low = lambda v: (v is not None, v if v is not None else 0)
    for c in (1, 2, 3, None):
        mine = sorted([r for r in rows if r[0] == c], key=lambda r: (low(r[1]), low(r[2]) if r[2] else (False, ""), low(r[3]) if r[3] is not None else (False, "")))
        text, spans = "", []
        for _, _, role, said, _ in mine:
            head = text + f"<|im_start|>{role or ''}\n"
            text = head + (said or "") + "<|im_end|>\n"
            if role == "assistant":
                spans.append((len(head.encode()), len((head + (said or "")).encode())))
        assert got[c].text == text and [tuple(a) for a in got[c].answers] == spans and got[c].n_turns == len(mine) and got[c].n_bytes == len(text.encode())
    assert chat.format_chats(df.limit(0)).count() == 0


def test_chat_across_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        df = spark.createDataFrame([(i // 7, i % 7, "user", f"t{i}") for i in range(70)], "conv_id bigint, turn bigint, role string, text string")
        got = chat.format_chats(df).collect()
        assert sorted(r.conv_id for r in got) == list(range(10)) and all(r.n_turns == 7 for r in got)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_shared_folder_is_read_from_the_session(spark):
    where = textkit.shared_dir(spark)
    assert spark.conf.get("spark.checkpoint.dir") == where and spark.sparkContext._jsc.sc().getCheckpointDir().isDefined()
    assert textkit.local_path("file:///a/b") == "/a/b" and os.path.isdir(textkit.local_path(where))
    assert zlib.crc32(b"") == 0 and duckdb.__version__
