"""Toxicity by weak supervision.

Voters: lexicon words, terms (words and word beginnings) mined from a bounded
labelled sample, each by presence and by density, and patterns of characters.
Label model: a latent class model, a clean and a toxic class for each language
that has three toxic labels and for the others together, starting at the sample's rates and refined by EM
over the vote patterns of all documents, summed by partition.  It estimates each
voter's firing rate in each class (its accuracy) and the correlation of voters
within classes; a voter's evidence is divided by one plus its correlations with
the others, so that near-equal voters count once.
Classifier: logistic regression on hashed words and word beginnings, trained on
the posteriors of the sample; it alone decides, on logarithms of counts and on
counts over the root of the number of words.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from numpy import ndarray as Arr
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .features import labelled, summed
from .textkit import U, chunks, cut, flat, span_hashes, with_column, without, word_spans

LEXICON = (
    "idiot", "idiots", "moron", "morons", "loser", "losers", "scum", "clown", "clowns", "stupid", "disgusting", "worthless", "pathetic", "trash",
    "garbage", "fool", "dumb", "vermin", "filth", "filthy", "imbecile", "jerk", "creep", "pig", "hate", "despise", "ugly", "shut", "die", "kill",
    "arschloch", "dummkopf", "abschaum", "trottel", "connard", "salope", "ordure", "imbécile", "idiota", "estúpido", "basura", "imbécil",
)
PREFIXES = (4, 5, 6, 7)
BITS = 20
#: The model's size: terms mined for each language that has three toxic labels, and the classifier's terms besides them.
MINED = 16
SELECTED = 1024
DENSE = 0.1
#: Counts of pairs of voters held at a time.
PAIR_COUNTS = 1 << 23
#: At most so many labelled documents start the label model and train the classifier.
SAMPLE = 10_000
EM_STEPS = 6
#: A labelled document counts as so many others in the label model.
LABEL_WEIGHT = 10.0
#: Correlations below this are taken for none: the structure of dependencies is sparse.
CORRELATED = 0.4
#: A voter that doesn't fire abstains rather than votes clean: all such evidence weighs no more than this (nats).
ABSTAIN = 3.0
#: A document goes if its probability of being toxic reaches this.
TOXIC_AT = 0.6


def _lower(column):
    import pyarrow.compute as pc

    return flat(pc.utf8_lower(column))


def terms(column) -> tuple[Arr, Arr, Arr, tuple[Arr, Arr]]:
    """Buckets of words and word beginnings, their rows, the words of each row, and the lower-case bytes."""
    raw, off = _lower(column)
    starts, ends, rows = word_spans(raw, off)
    buckets, of = [span_hashes(raw, starts, ends) >> U(64 - BITS)], [rows]
    for k in PREFIXES:
        long = ends - starts > k
        # the salt keeps a beginning apart from the word of the same bytes
        buckets.append((span_hashes(raw, starts[long], starts[long] + k) * U(0x9E3779B97F4A7C15)) >> U(64 - BITS))
        of.append(rows[long])
    return np.concatenate(buckets).astype(np.int64), np.concatenate(of), np.bincount(rows, minlength=len(off) - 1), (raw, off)


def lexicon_buckets() -> Arr:
    raw, off = flat(pa.array(LEXICON, pa.large_string()))
    return (span_hashes(raw, off[:-1], off[1:]) >> U(64 - BITS)).astype(np.int64)


def patterns(column, raw: Arr, off: Arr) -> Arr:
    """Marks for shouting, exclaiming and masked words."""
    original, ooff = flat(column)
    n = len(off) - 1
    out = np.zeros((n, 3), bool)
    if not len(raw) or len(original) < 3:
        return out

    def share(mask, bounds):
        total = np.concatenate([[0], np.cumsum(mask)])
        return (total[bounds[1:]] - total[bounds[:-1]]) / np.maximum(np.diff(bounds), 1)

    out[:, 0] = share((original >= 65) & (original <= 90), ooff) > 0.5
    out[:, 1] = share(original == 33, ooff) > 0.02
    letter = (original | 32) - np.uint8(97) < 26
    masked = np.zeros(len(original), bool)
    masked[1:-1] = letter[:-2] & (original[1:-1] == 42) & letter[2:]
    out[:, 2] = share(masked, ooff) > 0
    return out


def votes(column, voters: Arr) -> Arr:
    """A row of votes (bool) for each text: presence, density of each voter's term, then the patterns."""
    b, rows, n_words, (raw, off) = terms(column)
    n = len(n_words)
    number = np.full(1 << BITS, -1, np.int32)
    number[voters] = np.arange(len(voters))
    hit = number[b]
    some = hit >= 0
    count = np.bincount(rows[some] * len(voters) + hit[some], minlength=n * len(voters)).reshape(n, -1)
    dense = (count >= 2) & (count / np.sqrt(np.maximum(n_words, 1))[:, None] >= DENSE)
    return np.concatenate([count > 0, dense, patterns(column, raw, off)], axis=1)


def inputs(column, buckets: Arr) -> tuple[Arr, Arr, Arr, Arr]:
    """The classifier's inputs as (row, column, value), by row, and the words of each row."""
    b, rows, n_words, _ = terms(column)
    d = len(buckets)
    number = np.full(1 << BITS, -1, np.int32)
    number[buckets] = np.arange(d)
    hit = number[b]
    some = hit >= 0
    pair, count = np.unique(rows[some] * max(d, 1) + hit[some], return_counts=True)
    row, col = pair // max(d, 1), pair % max(d, 1)
    both = np.stack([np.log1p(count), count / np.sqrt(n_words[row])], axis=1).reshape(-1)
    return np.repeat(row, 2), np.stack([col, col + d], axis=1).reshape(-1), both, n_words


def _term_counts(langs: dict[str, int]):
    """(grp, bucket, clean, toxic, docs) of the sample: documents of each class with each term, and the XOR of their hashes."""

    def run(batches):
        for batch in batches:
            grp = np.array([langs.get(x, len(langs)) for x in batch.column("lang").to_pylist()], np.int64)
            y, h = np.asarray(batch.column("y")).astype(np.int64), np.asarray(batch.column("h"))
            for a, z in chunks(batch.column("text")):
                b, rows, _, _ = terms(batch.column("text").slice(a, z - a))
                pair = np.unique(rows << BITS | b)
                r, b = (pair >> BITS) + a, pair & ((1 << BITS) - 1)
                key, at = np.unique(grp[r] << BITS | b, return_inverse=True)
                docs = np.zeros(len(key), np.int64)
                np.bitwise_xor.at(docs, at, h[r])
                toxic = np.bincount(at, y[r], len(key)).astype(np.int64)
                cols = (key >> BITS, key & ((1 << BITS) - 1), np.bincount(at, minlength=len(key)) - toxic, toxic, docs)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["grp", "bucket", "clean", "toxic", "docs"])

    return run


def mine(counts: DataFrame, totals: DataFrame, most: int) -> DataFrame:
    """(grp, bucket): for each grp the terms of counts (grp, bucket, clean, toxic, docs) that tell toxic from clean documents best.

    totals (grp, n0, n1) has the clean and toxic documents.  Of terms that are in the
    same documents the least bucket counts, equal scores go to the lesser bucket.
    """
    c = counts.join(F.broadcast(totals), "grp")
    p1, p0 = (F.col("toxic") + 0.5) / (F.col("n1") + 1), (F.col("clean") + 0.5) / (F.col("n0") + 1)
    both = (F.col("toxic") + F.col("clean")) / F.greatest(F.col("n0") + F.col("n1"), F.lit(1))
    spread = F.greatest(both * (1 - both), F.lit(1e-9)) * (1 / F.greatest("n0", F.lit(1)) + 1 / F.greatest("n1", F.lit(1)))
    c = c.withColumn("z", (p1 - p0) / F.sqrt(spread)).filter((F.log(p1 / p0) > 1.0) & (F.col("toxic") >= 3) & (F.col("z") > 4))
    one = c.groupBy("grp", "toxic", "clean", "docs").agg(F.min("bucket").alias("bucket"), F.min("z").alias("z"))
    return one.selectExpr("grp", "bucket", "row_number() over (partition by grp order by z desc, bucket) as n").filter(F.col("n") <= most).select("grp", "bucket")


def _weights(weight):
    """Weights of the documents with each bucket, and of all, by the columns of weight(batch)."""

    def f(batch):
        w = weight(batch)
        total = np.zeros((w.shape[1], (1 << BITS) + 1), np.float32)
        for a, z in chunks(batch.column("text")):
            b, rows, _, _ = terms(batch.column("text").slice(a, z - a))
            pair = np.unique(rows << BITS | b)
            r, b = pair >> BITS, pair & ((1 << BITS) - 1)
            for k in range(w.shape[1]):
                total[k, :-1] += np.bincount(b, w[a:z, k][r], 1 << BITS).astype(np.float32)
        total[:, -1] += w.sum(axis=0)
        return total

    return f


@dataclass
class LabelModel:
    """prior of each class, rates[class, voter], the weight of each voter's evidence, and which classes are toxic."""

    prior: Arr
    rates: Arr
    weight: Arr
    bad: Arr

    def posterior(self, v: Arr) -> Arr:
        one, none = np.log(self.rates) * self.weight, np.log1p(-self.rates) * self.weight
        v = v.astype(float)
        z = v @ one.T + np.maximum((1 - v) @ none.T, -ABSTAIN) + np.log(self.prior)
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def toxic(self, v: Arr) -> Arr:
        return self.posterior(v)[:, self.bad].sum(axis=1)


@dataclass
class Model:
    labels: LabelModel | None
    voters: Arr
    buckets: Arr
    beta: Arr
    bias: float
    notes: dict = field(default_factory=dict)

    def probability(self, column) -> Arr:
        row, col, x, n_words = inputs(column, self.buckets)
        s = np.bincount(row, self.beta[col] * x, len(n_words)) + self.bias
        p = 1 / (1 + np.exp(-np.clip(s, -50, 50)))
        return np.where(n_words > 0, p, 0.0)


def _bits(column, m: int) -> Arr:
    return np.unpackbits(np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1), axis=1)[:, :m].astype(float)


def _em(patterns_: DataFrame, start: LabelModel, strength: Arr, steps: int, m: int) -> LabelModel:
    """The model refined over (votes, n); pairs of voters are counted for as many classes at a time as memory takes."""
    model = start
    k = len(start.prior)
    some = max(1, PAIR_COUNTS // (m * m))
    for _ in range(steps):
        mass, mean, fired = np.zeros(k), np.zeros((m, m)), np.zeros(m)
        rates = np.zeros((k, m))
        for at in range(0, k, some):
            own = range(at, min(k, at + some))

            def f(batch, model=model, own=own):
                v = _bits(batch.column("votes"), m)
                w = model.posterior(v)[:, list(own)] * np.asarray(batch.column("n")).astype(float)[:, None]
                total = np.zeros((len(own), 1, m))
                total[:, 0, 0] = w.sum(axis=0)
                return np.concatenate([total, np.stack([(v * w[:, [c]]).T @ v for c in range(len(own))])], axis=1)

            total = summed(patterns_, f)
            if total is None:
                return model
            mine_, second, there = total[:, 0, 0], total[:, 1:, :], strength[own.start : own.stop]
            first = np.diagonal(second, axis1=1, axis2=2)
            r = np.clip((first + there[:, None] * start.rates[own.start : own.stop]) / (mine_ + there)[:, None], 1e-5, 1 - 1e-5)
            sd = np.sqrt(r * (1 - r))
            corr = second / np.maximum(mine_, 1e-9)[:, None, None] - r[:, :, None] * r[:, None, :]
            corr = np.clip(corr / (sd[:, :, None] * sd[:, None, :]), 0, 1)
            corr[:, np.arange(m), np.arange(m)] = 0
            corr[corr < CORRELATED] = 0
            # averaged over the classes by how often the voter fires in each
            fires = (mine_ + there)[:, None] * r
            mean += (corr * fires[:, :, None]).sum(axis=0)
            fired += fires.sum(axis=0)
            mass[own.start : own.stop], rates[own.start : own.stop] = mine_, r
        prior = (mass + strength) / (mass.sum() + strength.sum())
        model = LabelModel(prior, rates, 1 / (1 + (mean / fired[:, None]).sum(axis=1)), start.bad)
    return model


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, mined: int = MINED, steps: int = EM_STEPS) -> Model:
    """The model of toxicity for docs.  Without toxic and clean labels nothing is toxic."""
    chosen = cut(labelled(docs, labels, "toxic", sample).select(F.xxhash64("doc_id").alias("h"), "text", F.coalesce("lang", F.lit("")).alias("lang"), "y"))
    lexicon = np.unique(lexicon_buckets())
    none = Model(None, lexicon, np.zeros(0, np.int64), np.zeros(0), -50.0)
    sizes = chosen.groupBy("lang").agg(F.sum("y").alias("n1"), F.sum(1 - F.col("y")).alias("n0")).collect()
    if not any(r.n1 for r in sizes) or not any(r.n0 for r in sizes):
        return none
    langs = {r.lang: i for i, r in enumerate(sorted((r for r in sizes if r.n1 >= 3), key=lambda r: (-r.n1, r.lang)))}
    each = np.zeros((len(langs) + 1, 2), np.int64)
    for r in sizes:
        each[langs.get(r.lang, len(langs))] += (r.n0, r.n1)
    totals = docs.sparkSession.createDataFrame([(i, int(a), int(b)) for i, (a, b) in enumerate(each)], "grp bigint, n0 bigint, n1 bigint")
    counts = chosen.mapInArrow(_term_counts(langs), "grp bigint, bucket bigint, clean bigint, toxic bigint, docs bigint")
    counts = counts.groupBy("grp", "bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"), F.bit_xor("docs").alias("docs"))
    found = np.array([r.bucket for r in mine(counts, totals, mined).collect()], np.int64)
    voters = np.unique(np.concatenate([lexicon, found]))
    m = 2 * len(voters) + 3

    def voted(batches):
        for batch in batches:
            at = np.array([langs.get(x, len(langs)) for x in batch.column("lang").to_pylist()], np.int64)
            for a, z in chunks(batch.column("text")):
                part = batch.slice(a, z - a)
                y = np.asarray(part.column("y")).astype(np.int64)
                rows = [x.tobytes() for x in np.packbits(votes(part.column("text"), voters), axis=1)]
                yield pa.RecordBatch.from_arrays([pa.array(2 * at[a:z] + y), pa.array(y), part.column("text"), pa.array(rows, pa.binary())], names=["cls", "y", "text", "votes"])

    chosen = cut(chosen.mapInArrow(voted, "cls bigint, y bigint, text string, votes binary"))

    def rates(batch):
        out = np.zeros((2 * len(each), m + 1))
        cls = np.asarray(batch.column("cls"))
        np.add.at(out[:, :m], cls, _bits(batch.column("votes"), m))
        out[:, m] += np.bincount(cls, minlength=len(out))
        return out

    r = summed(chosen.select("cls", "votes"), rates)
    there = r[:, m] > 0
    r, bad = r[there], (np.arange(len(r)) % 2 == 1)[there]
    n = r[:, m:]
    start = LabelModel(n[:, 0] / n.sum(), np.clip((r[:, :m] + 0.05) / (n + 1), 1e-5, 1 - 1e-5), np.ones(m), bad)

    def seen(batches):
        held: dict[bytes, int] = {}
        for batch in batches:
            text = batch.column("text")
            for a, z in chunks(text):
                bits, count = np.unique(np.packbits(votes(text.slice(a, z - a), voters), axis=1), axis=0, return_counts=True)
                for x, c in zip(bits, count.tolist()):
                    held[x.tobytes()] = held.get(x.tobytes(), 0) + c
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["votes", "n"])

    of_all = docs.select("text").filter("text is not null").mapInArrow(seen, "votes binary, n bigint").groupBy("votes").agg(F.sum("n").alias("n"))
    model = _em(cut(of_all), start, LABEL_WEIGHT * n[:, 0], steps, m)

    def judged(batch):
        return model.toxic(_bits(batch.column("votes"), m)), np.asarray(batch.column("y")).astype(float)

    def agreement(batch):
        p, y = judged(batch)
        return np.array([((1 - p) * y).sum(), (1 - p).sum(), (p * y).sum(), p.sum()])

    # the sample's labels are one more voter, of an accuracy estimated like that of the others
    g = summed(chosen.select("y", "votes"), agreement)
    said0, said1 = np.clip((g[[0, 2]] + 0.5) / (g[[1, 3]] + 1), 0.02, 0.98)

    def soft(batch):
        p, y = judged(batch)
        clean, toxic = (1 - p) * np.where(y > 0, said0, 1 - said0), p * np.where(y > 0, said1, 1 - said1)
        p = toxic / np.maximum(clean + toxic, 1e-12)
        return np.stack([1 - p, p], axis=1).astype(np.float32)

    weighed = summed(chosen, _weights(soft))
    (clean, toxic), (n0, n1) = weighed[:, :-1].astype(float), weighed[:, -1].astype(float)
    share = (clean + toxic) / max(n0 + n1, 1e-9)
    z = np.abs(toxic / max(n1, 1e-9) - clean / max(n0, 1e-9)) / np.sqrt(share * (1 - share) + 1e-3)
    # the most telling terms of all languages together, and those mined for each
    buckets = np.union1d(np.argsort(-z, kind="stable")[:SELECTED], found)
    buckets = buckets[z[buckets] > 0]

    def design(batches):
        for batch in batches:
            p = soft(batch)[:, 1]
            for a, zz in chunks(batch.column("text")):
                row, col, val, _ = inputs(batch.column("text").slice(a, zz - a), buckets)
                off = pa.array(np.searchsorted(row, np.arange(zz - a + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [pa.ListArray.from_arrays(off, pa.array(col.astype(np.int32))), pa.ListArray.from_arrays(off, pa.array(val.astype(np.float32))), pa.array(p[a:zz].astype(float))],
                    names=["i", "x", "p"],
                )

    got = chosen.mapInArrow(design, "i array<int>, x array<float>, p double").toArrow()
    i = np.asarray(got.column("i").combine_chunks().flatten())
    x = np.asarray(got.column("x").combine_chunks().flatten()).astype(float)
    row = np.repeat(np.arange(len(got)), np.asarray(got.column("i").combine_chunks().value_lengths()))
    beta, bias = _logistic(row, i, x, np.asarray(got.column("p")), 2 * len(buckets))
    return Model(model, voters, buckets, beta, bias)


def _logistic(row, col, x, p, d: int, penalty: float = 1e-4, steps: int = 400) -> tuple[Arr, float]:
    """Weights and bias by accelerated gradient steps on scaled features; classes weigh evenly up to a factor of 2."""
    n = len(p)
    scale = np.sqrt(np.bincount(col, x * x, d) / max(n, 1)) + 1e-3
    x = x / scale[col]
    w = 1 + p * (min(2.0, (1 - p).sum() / max(p.sum(), 1e-9)) - 1)
    w = w / w.sum()
    beta, look, bias, blook, t = np.zeros(d), np.zeros(d), 0.0, 0.0, 1.0
    norm = np.bincount(row, x * x, n) + 1
    rate = 4 / float((w * norm).sum())
    for _ in range(steps):
        s = np.bincount(row, look[col] * x, n) + blook
        g = w * (1 / (1 + np.exp(-np.clip(s, -50, 50))) - p)
        nb = look - rate * (np.bincount(col, g[row] * x, d) + penalty * look)
        nbias = blook - rate * g.sum()
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        look, blook = nb + (t - 1) / nt * (nb - beta), nbias + (t - 1) / nt * (nbias - bias)
        beta, bias, t = nb, nbias, nt
    return beta / scale, float(bias)


def score(docs: DataFrame, model: Model, below: float | None = None, column: str | None = "toxicity_score") -> DataFrame:
    """docs with toxicity_score; with below, those of a lower score only.

    Null, empty and wordless texts score 0; very long ones are scored whole.  A score
    equal to below goes.  All columns come through, whatever their names, but one that
    clashes with column, the scores' name; with column None there are no scores, and
    all do.  Equal rows score alike; an empty table gives one.
    """
    base = without(docs, column or "")

    def run(batches):
        for batch in batches:
            text = batch.column("text")
            for a, z in chunks(text):
                part = batch.slice(a, z - a)
                p = np.round(model.probability(part.column("text")), 9)
                out = with_column(part, column, pa.array(p)) if column else part
                yield out if below is None else out.filter(pa.array(p < below))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema)
    return base.mapInArrow(run, schema + (f", `{column}` double" if column else ""))


def keep_clean(docs: DataFrame, labels: DataFrame, at: float = TOXIC_AT, column: str | None = "toxicity_score", **how) -> DataFrame:
    """The documents whose probability of being toxic is below at, with their scores, as score gives them.

    Null, empty and wordless texts stay, a score of exactly at goes; very long texts,
    repeated rows, empty tables and other columns fare as in score.  Labels that are
    null, that contradict each other or whose document isn't there don't count; without
    labels of both kinds all documents stay.
    """
    return score(docs, fit(docs, labels, **how), at, column)
