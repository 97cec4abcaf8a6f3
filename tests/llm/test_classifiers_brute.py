"""The two classifiers against plain Python written from their descriptions, which calls none of their code."""

import math
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skyanchor.llm import features, quality, queries, toxicity

from .test_operators import prose

SF = "/root/testdata/sf0.001"


def plain_statistics(text):
    if not text:
        return [0.0] * len(features.STATISTICS)
    raw = text.encode()
    words = re.findall(rb"[0-9A-Za-z\x80-\xff]+", raw)
    n, size = len(words), len(raw)
    per = max(n, 1)
    share = lambda chars: sum(raw.count(bytes([c])) for c in set(chars)) / size
    length = [len(w) for w in words]
    mean = sum(length) / per
    lines = [x for x in raw.replace(b"\r", b"\r").split(b"\n") if x]
    return [
        math.log1p(size), math.log1p(n), mean, math.sqrt(max(sum(x * x for x in length) / per - mean**2, 0)), sum(x == 1 for x in length) / per,
        share(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), share(b"0123456789"), share(b"#$%&*+=@^_~<>{}[]\\|/"), share(b"."), share(b",;:"), share(b"!?"), share(b"|"), share(b" \t"), share(b"\n\r"), share(range(128, 256)), share(b"<>{}="),
        len(set(words)) / per, sum(a == b for a, b in zip(words, words[1:])) / per, max((words.count(w) for w in set(words)), default=0) / per,
        math.log1p(n / max(raw.count(b"."), 1)), sum(x > 20 for x in length) / per, len(set(lines)) / max(len(lines), 1),
    ]


def test_statistics():
    texts = ["One two, two. THREE!\n\nfour é 漢字 five\nOne two, two. THREE!\n", None, "", "...", "a" * 40 + " b", "x|y|z <b>{q}=1</b>\r\n#tag", " \t \n", prose(1, 500), "same same same same"]
    got = quality.statistics(pa.array(texts))
    assert np.allclose(got, [plain_statistics(t) for t in texts], atol=1e-6)


def pav(points):
    """Pool adjacent violators by repeated passes over (x, y, weight)."""
    blocks = [[[x], y, w] for x, y, w in points]
    while any(a[1] >= b[1] for a, b in zip(blocks, blocks[1:])):
        i = next(i for i in range(len(blocks) - 1) if blocks[i][1] >= blocks[i + 1][1])
        a, b = blocks[i], blocks.pop(i + 1)
        blocks[i] = [a[0] + b[0], (a[1] * a[2] + b[1] * b[2]) / (a[2] + b[2]), a[2] + b[2]]
    return [(x, b[1]) for b in blocks for x in b[0]]


def test_quality_query(spark):
    """The kept documents and scores of op4, from statistics to calibration, in plain numpy on the driver."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    text = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    label: dict = {}
    for r in spark.read.parquet(f"{SF}/labels.parquet").filter("doc_id is not null and quality is not null").collect():
        label.setdefault(r.doc_id, set()).add(r.quality)
    label = {k: v.pop() for k, v in label.items() if len(v) == 1 and k in text}
    draw = {r.doc_id: r.d for r in docs.select("doc_id", F.pmod(F.xxhash64(F.lit("calibration"), "doc_id"), F.lit(1000)).alias("d")).collect()}
    x = {k: np.array(plain_statistics(t)) for k, t in text.items()}
    train = [k for k in label if draw[k] >= 300]
    a = np.array([x[k] for k in train])
    mean, sd = a.mean(axis=0), a.std(axis=0)
    sd[sd < 1e-9] = 1
    rng = np.random.default_rng(quality.SEED)
    omega, phase = rng.normal(size=(a.shape[1], 256)) / 4.0, rng.uniform(0, 2 * np.pi, 256)

    def lift(v):
        return np.append([math.sqrt(2 / 256) * math.cos(float(p)) for p in ((v - mean) / sd) @ omega + phase], 1.0)

    z, y = np.array([lift(v) for v in a]), np.array([label[k] for k in train], float)
    ridge = np.eye(257) * 1e-2 * len(train) / 256
    ridge[-1, -1] = 0
    beta = np.linalg.solve(z.T @ z + ridge + 1e-9 * np.eye(257), z.T @ y)
    score = {k: float(lift(v) @ beta) for k, v in x.items()}
    bins: dict = {}
    for k in label:
        if draw[k] < 300:
            at = min(max(round((score[k] + 0.5) / 2 * 2000), 0), 2000)
            bins.setdefault(at / 1000 - 0.5, []).append(label[k])
    curve = pav([(b, sum(v) / len(v), len(v)) for b, v in sorted(bins.items())])
    want = {k: float(np.interp(s, [c[0] for c in curve], [c[1] for c in curve])) if text[k] else 0.0 for k, s in score.items()}
    got = {r.doc_id: r.quality_score for r in queries.QUERIES["op4_quality_classifier"](spark, SF).collect()}
    close = {k for k, p in want.items() if abs(p - 0.5) < 1e-3}  # may fall on either side by rounding
    assert {k for k, p in want.items() if p >= 0.5} - close == set(got) - close and len(close) < 5
    off = [abs(got[k] - want[k]) for k in got]
    assert np.mean(np.array(off) < 1e-3) > 0.97  # a score on the edge of a bin may move to the next


# toxicity


def plain_terms(text):
    """Words and the beginnings of 4 to 7 bytes of longer ones, each a kind of its own."""
    words = re.findall(rb"[0-9A-Za-z\x80-\xff]+", text.lower().encode())
    return [("word", w) for w in words] + [("start", w[:k]) for w in words for k in (4, 5, 6, 7) if len(w) > k], len(words)


def test_votes():
    texts = ["You idiot, you IDIOT. d*mn it", "A fine day. " * 20, "STOP SHOUTING NOW!!!", "", None, "idiot " + "word " * 900]
    voters = np.unique(toxicity.lexicon_buckets())
    got = toxicity.votes(pa.array(texts), voters)
    place = {w: int(np.searchsorted(voters, b)) for w, b in zip(toxicity.LEXICON, toxicity.lexicon_buckets())}
    k = len(voters)
    for row, t in zip(got, texts):
        t = t or ""
        said, n = plain_terms(t)
        for w, at in place.items():
            c = said.count(("word", w.encode()))
            assert row[at] == (c > 0) and row[k + at] == (c >= 2 and c / math.sqrt(max(n, 1)) >= 0.1)
        assert row[2 * k] == (len(t) > 2 and sum(x.isascii() and x.isupper() for x in t) / max(len(t.encode()), 1) > 0.5)
        assert row[2 * k + 1] == (len(t) > 2 and t.count("!") / len(t.encode()) > 0.02) and row[2 * k + 2] == bool(re.search(r"[a-zA-Z]\*[a-zA-Z]", t))


def test_mining_against_plain_counts(spark):
    docs = [("en", 1, f"rotten thing {i} today") for i in range(8)] + [("en", 0, f"nice thing {i} today") for i in range(40)] + [("de", 1, f"übel sache {i}") for i in range(6)] + [("de", 0, f"gute sache {i}") for i in range(30)]
    rows = spark.createDataFrame([(i * 7919, t, lang, y) for i, (lang, y, t) in enumerate(docs)], "h bigint, text string, lang string, y int").repartition(3)
    counts = rows.mapInArrow(toxicity._term_counts({"en": 0, "de": 1}), "grp bigint, bucket bigint, clean bigint, toxic bigint, docs bigint")
    counts = counts.groupBy("grp", "bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"), F.bit_xor("docs").alias("docs"))
    totals = spark.createDataFrame([(0, 40, 8), (1, 30, 6), (2, 0, 0)], "grp bigint, n0 bigint, n1 bigint")
    got = {(r.grp, r.bucket) for r in toxicity.mine(counts, totals, 16).collect()}
    # "rotten", its beginnings and so on are in the same documents: one of them counts; so with "übel"
    assert len([g for g in got if g[0] == 0]) == 1 and len([g for g in got if g[0] == 1]) == 1
    b, _, _, _ = toxicity.terms(pa.array(["rotten"]))
    assert {x for g, x in got if g == 0} <= set(b.tolist())


def plain_em(patterns, counts, prior, rates, strength, steps):
    """The label model by loops over patterns, classes and voters."""
    k, m = len(prior), len(rates[0])
    start, weight = [list(r) for r in rates], [1.0] * m
    prior, rates = list(prior), [list(r) for r in rates]

    def posterior(v):
        s = []
        for c in range(k):
            fired = sum(weight[j] * math.log(rates[c][j]) for j in range(m) if v[j])
            silent = sum(weight[j] * math.log(1 - rates[c][j]) for j in range(m) if not v[j])
            s.append(math.log(prior[c]) + fired + max(silent, -toxicity.ABSTAIN))
        e = [math.exp(x - max(s)) for x in s]
        return [x / sum(e) for x in e]

    for _ in range(steps):
        mass = [0.0] * k
        pair = [[[0.0] * m for _ in range(m)] for _ in range(k)]
        for v, n in zip(patterns, counts):
            for c, p in enumerate(posterior(v)):
                mass[c] += n * p
                for i in range(m):
                    for j in range(m):
                        pair[c][i][j] += n * p * v[i] * v[j]
        new = [[min(max((pair[c][j][j] + strength[c] * start[c][j]) / (mass[c] + strength[c]), 1e-5), 1 - 1e-5) for j in range(m)] for c in range(k)]
        total = sum(mass) + sum(strength)
        prior = [(mass[c] + strength[c]) / total for c in range(k)]
        new_weight = []
        for i in range(m):
            fires = [(mass[c] + strength[c]) * new[c][i] for c in range(k)]
            extra = 0.0
            for j in range(m):
                if i == j:
                    continue
                for c in range(k):
                    r = (pair[c][i][j] / max(mass[c], 1e-9) - new[c][i] * new[c][j]) / math.sqrt(new[c][i] * (1 - new[c][i]) * new[c][j] * (1 - new[c][j]))
                    r = min(max(r, 0), 1)
                    extra += fires[c] / sum(fires) * (r if r >= toxicity.CORRELATED else 0)
            new_weight.append(1 / (1 + extra))
        rates, weight = new, new_weight
    return prior, rates, weight, [posterior(v) for v in patterns]


@pytest.mark.parametrize("at_a_time", [1 << 23, 1])
def test_label_model(spark, monkeypatch, at_a_time):
    monkeypatch.setattr(toxicity, "PAIR_COUNTS", at_a_time)
    rng = np.random.default_rng(4)
    true = rng.random(300) < 0.3
    v = rng.random((300, 6)) < np.where(true[:, None], [0.8, 0.7, 0.6, 0.6, 0.5, 0.1], [0.05, 0.1, 0.1, 0.1, 0.2, 0.1])
    v[:, 3] = v[:, 2]  # a voter that repeats another
    patterns, counts = np.unique(v, axis=0, return_counts=True)
    prior, rates = [0.6, 0.4], [[0.1] * 6, [0.5] * 6]
    rows = [(bytearray(np.packbits(p).tobytes()), int(n)) for p, n in zip(patterns, counts)]
    df = spark.createDataFrame(rows, "votes binary, n bigint").repartition(3)
    start = toxicity.LabelModel(np.array(prior), np.array(rates), np.ones(6), np.array([False, True]))
    got = toxicity._em(df, start, np.array([5.0, 3.0]), 4, 6)
    want = plain_em(patterns.tolist(), counts.tolist(), prior, rates, [5.0, 3.0], 4)
    assert np.allclose(got.prior, want[0]) and np.allclose(got.rates, want[1]) and np.allclose(got.weight, want[2])
    assert np.allclose(got.posterior(patterns), want[3]) and np.allclose(got.toxic(patterns), [p[1] for p in want[3]])
    assert got.weight[2] == pytest.approx(got.weight[3]) and got.weight[2] < 0.6 < got.weight[0]


def test_logistic_reaches_the_minimum():
    """Against Newton steps on the dense problem."""
    rng = np.random.default_rng(0)
    n, d = 200, 5
    x = rng.random((n, d)) * (rng.random((n, d)) < 0.5)
    p = 1 / (1 + np.exp(-(x @ np.array([3.0, -2, 1, 0, 2]) - 1)))
    row, col = np.nonzero(x)
    beta, bias = toxicity._logistic(row, col, x[row, col], p, d, penalty=1e-3, steps=4000)
    scale = np.sqrt((x * x).mean(axis=0)) + 1e-3
    a = np.concatenate([x / scale, np.ones((n, 1))], axis=1)
    w = 1 + p * (min(2.0, (1 - p).sum() / p.sum()) - 1)
    w /= w.sum()
    b = np.zeros(d + 1)
    ridge = np.diag([1e-3] * d + [0.0])
    for _ in range(50):
        q = 1 / (1 + np.exp(-a @ b))
        b -= np.linalg.solve((a * (w * q * (1 - q))[:, None]).T @ a + ridge, a.T @ (w * (q - p)) + ridge @ b)
    assert np.allclose(beta * scale, b[:d], atol=1e-3) and bias == pytest.approx(b[d], abs=1e-3)


def test_more_languages_than_a_few(spark):
    """Forty languages, each with an insult of its own that no other knows."""
    rows, labels, k = [], [], 0
    for lang in range(40):
        for i in range(42):
            bad = i < 12
            rows.append((k, f"{prose(k, 20)} {chr(97 + lang // 26) + chr(97 + lang % 26) + 'fluchte ' if bad else ''}{prose(k + 10_000, 10)}", f"l{lang:02d}"))
            labels.append((k, int(bad)))
            k += 1
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    y = dict(labels)
    # one toxic and one clean document of each language are held out
    seen = spark.createDataFrame([(i, t) for i, t in labels if i % 42 not in (4, 15)], "doc_id bigint, toxic int")
    model = toxicity.fit(docs, seen)
    got = {r.doc_id: r.toxicity_score >= toxicity.TOXIC_AT for r in toxicity.score(docs, model).collect() if r.doc_id % 42 in (4, 15)}
    late = [i for i in got if y[i] and i >= 42 * 16]
    assert np.mean([got[i] == bool(y[i]) for i in got]) > 0.8 and np.mean([got[i] for i in late]) > 0.6
