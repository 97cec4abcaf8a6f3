"""Columns that bear the operators' own names, ids of other types, hot passages, large media, long word lists."""

import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from skyanchor.llm import bpe, chat, fingerprint, jpeg, minhash, mixing, quality, rans, textkit, toxicity, urls

from .test_operators import DOCS, odd_docs, prose

SF = "/root/testdata/sf0.001"
#: Every name that an operator gives a column of its own, and those that look like it.
OWN = (
    "tried digests of_source rate copies ordinal group_id group_key group_keep text_key key bands marks band hub root grp best keep n c0 void bucket block words stream rows n_words "
    "least y z h cls votes sketch near union of draw x at part m __tried __keys __source __rate __copies __copy __id __key __keep __of __void toxic clean"
).split()


def with_own(df):
    have = {c.lower() for c in df.columns}
    return df.select("*", *(F.lit(f"my {c}").alias(c) for c in OWN if c.lower() not in have))


def unharmed(df, but=()):
    rows = df.collect()
    assert rows and all(r[c] == f"my {c}" for r in rows for c in OWN if c not in but and c in df.columns)
    return rows


def test_own_names_come_through(spark, tmp_path):
    d = with_own(odd_docs(spark))
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    assert {len(unharmed(f(spark, d, SF))) for _, f in corpus_pipeline.STAGES[2:3]} == {11}
    for name, f in corpus_pipeline.STAGES:
        out = f(spark, d, SF)
        unharmed(out)
        assert set(OWN) <= set(out.columns), name
    unharmed(mixing.mix_sources(d), ("copy",))
    unharmed(bpe.encode(d, decode=True))
    unharmed(bpe.decode(with_own(spark.createDataFrame([([1],)], "ids array<int>"))))
    unharmed(quality.keep_good(d, labels))
    unharmed(toxicity.keep_clean(d, labels))
    pages = with_own(spark.createDataFrame([(1, "http://bad.org/x"), (2, None)], "page_id int, url string"))
    assert sorted((r.page_id, r.blocked) for r in unharmed(urls.filter_urls(pages, spark.createDataFrame([("bad.org",)], "entry string"), str(tmp_path / "u")))) == [(1, True), (2, False)]
    media = with_own(spark.createDataFrame([(1, bytearray(jpeg.encode_progressive(jpeg.picture([0.1] * 64, 1))))], "id int, jpeg binary"))
    assert unharmed(jpeg.decode_media(media))[0].error is None
    # operators that give a table of their own leave such columns out
    assert minhash.deduplicated(d).columns == ["doc_id", "copies"] and minhash.deduplicated(d).count() == 11
    assert len(fingerprint.fingerprints(d).collect()) == 13 and len(rans.decode(rans.encode_documents(d)).collect()) == 13
    turns = with_own(spark.createDataFrame([(1, 0, "user", "hi")], "conv_id int, turn int, role string, text string"))
    assert [r.text for r in chat.format_chats(turns).collect()] == ["<|im_start|>user\nhi<|im_end|>\n"]


def test_ids_that_are_texts(spark):
    rows = [("b1", prose(1, 80), "s"), ("a1", prose(1, 80), "s"), (None, prose(2, 40), "t"), ("c", None, None)]
    d = spark.createDataFrame(rows, "doc_id string, text string, source string")
    assert {(r.doc_id, tuple(r.copies)) for r in minhash.deduplicated(d).collect()} == {("a1", ("b1",)), (None, ()), ("c", ())}
    assert sorted((r.doc_id or "", r.n_tokens is None) for r in bpe.encode(d).collect()) == [("", False), ("a1", False), ("b1", False), ("c", True)]
    assert len(mixing.mix_sources(d).collect()) > 0 and sorted(r.doc_id or "" for r in minhash.near_dedup(d).collect()) == ["", "a1", "c"]
    labels = spark.createDataFrame([("b1", 1, 0), ("a1", 0, 1)], "doc_id string, quality int, toxic int")
    assert quality.keep_good(d, labels, least=0.0).count() == 4 and toxicity.keep_clean(d, labels, at=2.0).count() == 4
    assert {r.doc_id for r in fingerprint.fingerprints(d).collect()} == {None} and {r.doc_id for r in rans.tokenised(d).collect()} == {None}
    assert bpe.encode(d.drop("doc_id")).columns == ["source", "ids", "n_tokens"] and bpe.encode(d.select("text")).count() == 4
    dated = d.select(F.current_date().alias("doc_id"), "text")
    assert bpe.encode(dated).count() == 4


# near duplicates


def test_a_passage_in_all_documents_makes_no_group(spark):
    shared = prose(999, 100)
    texts = [shared + " " + " ".join(f"w{i}x{j}" for j in range(120)) for i in range(4000)]
    texts += [t + " tail" for t in texts[:5]]
    d = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], DOCS).repartition(6)
    began = time.time()
    got = {r.doc_id: r.copies for r in minhash.deduplicated(d).collect()}
    assert got == {i: [4000 + i] if i < 5 else [] for i in range(4000)}
    assert time.time() - began < 120


def test_agreeing_pairs_are_all_found_once(monkeypatch):
    rng = np.random.default_rng(0)
    monkeypatch.setattr(minhash, "PAIRS", 7)
    group, side = np.sort(rng.integers(0, 6, 60)), rng.integers(0, 2, 60)
    cross, root, marks = group % 2 == 1, rng.integers(0, 4, 60), rng.integers(0, 3, (60, 12)).astype(np.uint8)
    want = {
        (i, j) for j in range(60) for i in range(j)
        if group[i] == group[j] and root[i] != root[j] and (not cross[j] or side[i] != side[j]) and sum(marks[i] == marks[j]) >= 5
    }
    got = [(int(a), int(b)) for x, y in minhash.agreeing(group, side, cross, root, marks, 5) for a, b in zip(x, y)]
    assert len(got) == len(set(got)) and set(got) == want
    assert list(minhash.agreeing(group[:0], side[:0], cross[:0], root[:0], marks[:0], 5)) == []


def test_slack_keeps_pairs_at_the_threshold():
    rng = np.random.default_rng(1)
    t, n = minhash.BANDS * minhash.ROWS, 400
    sets = []
    for _ in range(n):
        x = rng.integers(0, 1 << 64, 150, dtype=np.uint64)
        sets += [x[:100], x[50:]]  # 50 of 150 in common would be a third
        sets[-1] = np.concatenate([x[33:100], x[100:133]])  # 67 of 133: just over a half
    s = minhash.sketch(np.concatenate(sets), np.cumsum([0] + [len(x) for x in sets]), t)
    same = (s[0::2] == s[1::2]).sum(axis=1)
    assert (same >= minhash.least_agreement(t, 0.5)).mean() > 0.99


def test_blocks_of_a_bucket_meet(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 7)
    shared = prose(5, 150)
    texts = [" ".join(shared.split()[: 150 - i]) + " " + prose(100 + i, 10 + i % 3) for i in range(0, 60)]
    d = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], DOCS)
    from .test_operators import brute_groups

    want = {}
    for i, g in enumerate(brute_groups(texts)):
        want.setdefault(g, []).append(i)
    assert {r.doc_id: r.copies for r in minhash.deduplicated(d).collect()} == {g: [i for i in ids if i != g] for g, ids in want.items()}


def shuffled(spark, run):
    """What run returns, and the bytes that its stages shuffled."""
    sc = spark.sparkContext
    gateway, store = sc._gateway, sc._jsc.sc().statusStore()

    def stages():
        sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        found = store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
        return {(x.stageId(), x.attemptId()): x.shuffleWriteBytes() for x in (found.apply(i) for i in range(found.size()))}

    before = stages()
    out = run()
    return out, sum(n for at, n in stages().items() if at not in before)


def test_texts_are_shuffled_once(spark):
    words = np.array([f"{x:x}" for x in np.random.default_rng(3).integers(0, 1 << 40, 160 * 4000)]).reshape(160, 4000)
    for i in range(0, 40, 4):
        words[i + 1, 600:], words[i + 2, 1200:] = words[i, 600:], words[i, 1200:]
    textkit.shared_dir(spark)
    d = spark.createDataFrame([(i, " ".join(w), "en", "s", 1) for i, w in enumerate(words)], DOCS).repartition(4).checkpoint()
    limit = "spark.sql.autoBroadcastJoinThreshold"
    old = spark.conf.get(limit)
    spark.conf.set(limit, "-1")  # a table of this size would be joined without a shuffle
    try:
        _, once = shuffled(spark, lambda: d.select("text").repartition(4, "text").write.format("noop").mode("overwrite").save())
        got, n = shuffled(spark, lambda: {r.doc_id: r.copies for r in minhash.deduplicated(d).collect()})
    finally:
        spark.conf.set(limit, old)
    from .test_operators import brute_groups

    want = {}
    for i, g in enumerate(brute_groups(d.orderBy("doc_id").toPandas().text.tolist())):
        want.setdefault(g, []).append(i)
    assert got == {g: [i for i in ids if i != g] for g, ids in want.items()} and sum(map(len, got.values())) == 20
    assert once > 4e6 and n < 2 * once


# media


def plain_jpeg(width, height, components=1, adobe=None, dc=()):
    """A sequential file all of whose blocks are flat; dc has the components' levels, as 4-bit DC differences of the first block."""
    seg = lambda m, body: bytes([0xFF, m]) + (len(body) + 2).to_bytes(2, "big") + body
    out = b"\xff\xd8" + seg(0xDB, b"\0" + b"\x08" * 64)
    if adobe is not None:
        out += seg(0xEE, b"Adobe" + bytes([0, 100, 0, 0, 0, 0, adobe]))
    out += seg(0xC0, bytes([8]) + height.to_bytes(2, "big") + width.to_bytes(2, "big") + bytes([components] + [x for i in range(components) for x in (i + 1, 0x11, 0)]))
    # one DC code of a bit for 0 and one of two bits for a value of seven bits; one AC code, the end of a block
    out += seg(0xC4, b"\x00" + bytes([1, 1] + [0] * 14) + bytes([0, 7])) + seg(0xC4, b"\x10" + bytes([1] + [0] * 15) + b"\0")
    out += seg(0xDA, bytes([components] + [x for i in range(components) for x in (i + 1, 0)] + [0, 63, 0]))
    blocks = -(-width // 8) * -(-height // 8)
    bits = ""
    for i in range(components):
        v = dc[i] if i < len(dc) else 0
        bits += f"10{v if v > 0 else v + 127:07b}0" if v else "00"
    n = len(bits) + 2 * components * (blocks - 1)
    bits += "0" * (-len(bits) % 8)
    data = int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\0")
    return out + data + bytes(max(0, -(-n // 8) - len(bits) // 8)) + b"\xff\xd9"


def test_a_very_large_image_is_decoded_whole():
    rgb = jpeg.decode(plain_jpeg(16_000, 12_600, dc=(-80,)))
    assert rgb.shape == (12_600, 16_000, 3) and rgb[0, 0, 0] == rgb[-1, -1, 2] == 128 - 80
    with pytest.raises(jpeg.Damaged, match="binary value"):
        jpeg.decode(plain_jpeg(40_000, 30_000)[:2000] + b"\xff\xd9")
    with pytest.raises(jpeg.Damaged, match="too short"):
        jpeg.decode(plain_jpeg(16_000, 12_000)[:700] + b"\xff\xd9")


def test_batches_of_large_tensors(spark):
    data = bytearray(plain_jpeg(4000, 3000, dc=(64,)))
    media = spark.createDataFrame([(i, data if i % 5 else None) for i in range(12)], "id int, jpeg binary").coalesce(1)
    got = jpeg.decode_media(media).select("id", "width", "height", "error", F.length("tensor").alias("size")).collect()
    assert sorted((r.id, r.width, r.height, r.error, r.size) for r in got if r.size) == [(i, 4000, 3000, None, 36_000_000) for i in range(12) if i % 5]
    assert sorted(r.id for r in got if r.size is None) == [0, 5, 10]


def test_four_components():
    c, m, y, k = 70, -70, 100, 80
    level = [128 + v for v in (c, m, y, k)]
    plain = jpeg.decode(plain_jpeg(8, 8, 4, None, (c, m, y, k)))[0, 0]
    assert plain.tolist() == [round((255 - v) * (255 - level[3]) / 255) for v in level[:3]]
    inverted = jpeg.decode(plain_jpeg(8, 8, 4, 0, (c, m, y, k)))[0, 0]
    assert inverted.tolist() == [round(v * level[3] / 255) for v in level[:3]]


# URLs, tokens


def test_a_blocklist_of_several_segments(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(urls, "SEGMENT_ENTRIES", 10_000)
    block = spark.range(60_000).selectExpr("concat('host', id, '.example.org') entry").union(spark.range(500).selectExpr("concat('https://page.org/', id, '?q=', id) entry"))
    folder = str(tmp_path / "d")
    assert len(urls.build(block, folder)) == 7
    pages = spark.range(0, 120_000, 37).selectExpr("id page_id", "concat('http://www.host', id, '.example.org/x') url").union(spark.range(0, 1000, 3).selectExpr("-id page_id", "concat('http://page.org/', id, '?q=', id, '#f') url"))
    got = urls.filter_urls(pages, block, str(tmp_path / "e")).filter("blocked <> if(page_id > 0 or url like '%host%', page_id < 60000, page_id > -500)")
    assert got.count() == 0


def test_shared_frequencies_of_many_kinds_of_tokens():
    rng = np.random.default_rng(0)
    p = rng.permutation(1_200_000)[:1_100_000]
    t = rans.Table.of(np.bincount(p, minlength=1_200_000))
    assert t.scale > rans.SCALE and int(t.freq.sum()) == 1 << t.scale
    part = p[:50_000]
    (data, marks), = rans.encode_blocks([part], rans.Table.unpack(t.pack()))
    assert (rans.decode_block(data, marks, len(part), t) == part).all()


def test_vocabulary_of_a_worker_without_the_file(spark):
    bpe.ship_vocabulary(spark, bpe.VOCABULARY)
    elsewhere = "/not/here/" + bpe.VOCABULARY.rsplit("/", 1)[1]

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(bpe.ranks(elsewhere))] * b.num_rows)], names=["n"])

    assert spark.range(1).mapInArrow(run, "n bigint").first().n == len(bpe.ranks(bpe.VOCABULARY))


def test_names_that_are_free():
    assert textkit.fresh(["A", "b_"], "a", "b", "b") == ["a_", "b", "b__"]


def test_folders_that_executors_cannot_share():
    assert textkit.local_path("file:///a/b") == "/a/b" == textkit.local_path("/a/b")
    with pytest.raises(ValueError, match="mounted"):
        textkit.local_path("s3a://bucket/x")
