"""Token ids as blocks of a static range asymmetric numeral system.

One frequency table, of sum 2**20 (more where there are over 2**19 different
tokens), is shared by all blocks.  A block holds the
tokens of whole documents, about 65,536 of them; token i belongs to lane i mod
64, and every lane has a state of its own, so that numpy codes all lanes of many
blocks at a time.  States are 64-bit and put out 32-bit words.  Every 256 steps
a checkpoint keeps the lanes' states and the place in the words, from which
decoding may start; the payload and the tokens each have a CRC-32.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import VOCABULARY, encoding, ship_vocabulary
from .textkit import U, chunks, cut

SCALE, MOST_SCALE = 20, 31
LOW = 1 << 31
LANES = 64
BLOCK = 1 << 16
EVERY = 256

SCHEMA = (
    "kind string, doc_ids array<bigint>, lengths array<int>, n_tokens bigint, payload binary, checkpoints binary, payload_crc bigint, tokens_crc bigint, table_crc bigint"
)
PACKED = "doc_ids array<bigint>, lengths array<int>, n bigint, width int, data binary"


class Table:
    """Frequencies (sum 2**scale, at least 1 where present) and their running sums."""

    def __init__(self, freq: np.ndarray):
        self.scale = max(SCALE, int(freq.sum()).bit_length() - 1)
        self.freq = freq.astype(U)
        self.cum = np.concatenate([[U(0)], np.cumsum(self.freq)])[:-1].astype(U)
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.int32), freq.astype(np.int64))
        self.crc = zlib.crc32(freq.astype("<u4").tobytes())
        self.common = int(np.argmax(freq)) if len(freq) else 0

    @staticmethod
    def of(counts: np.ndarray) -> Table:
        """The table for token counts; those of tokens that are there are scaled to 2**scale, never to 0.

        The scale leaves each token a frequency of two on average, so that any
        number of different tokens up to 2**30, half of what an int can say, has one.
        """
        counts = counts.astype(float)
        some = counts > 0
        kinds = int(some.sum())
        if not kinds:
            return Table(np.zeros(0, np.int64))
        scale = max(SCALE, kinds.bit_length() + 1)
        if scale > MOST_SCALE:
            raise ValueError("more than 2**30 different tokens don't fit 32-bit words")
        total = 1 << scale
        freq = np.where(some, np.maximum(1, np.floor(counts * (total - kinds) / counts.sum())), 0).astype(np.int64)
        freq[np.argmax(freq)] += total - freq.sum()
        return Table(freq)

    def pack(self) -> bytes:
        return zstandard.ZstdCompressor(level=9).compress(self.freq.astype("<u4").tobytes())

    @staticmethod
    def unpack(data: bytes) -> Table:
        return Table(np.frombuffer(zstandard.ZstdDecompressor().decompress(data), "<u4").astype(np.int64))


def _encode_group(parts: list[np.ndarray], t: Table) -> list[tuple[bytes, bytes]]:
    """Payload and checkpoints of blocks in descending order of length."""
    steps = np.array([-(-len(p) // LANES) for p in parts])
    top = int(steps[0])
    sym = np.full((len(parts), top * LANES), t.common, np.int32)
    for i, p in enumerate(parts):
        sym[i, : len(p)] = p
    sym = sym.reshape(len(parts), top, LANES)
    state = np.full((len(parts), LANES), LOW, U)
    words = np.zeros((len(parts), top, LANES), np.uint32)
    out = np.zeros((len(parts), top, LANES), bool)
    kept: list[list[np.ndarray]] = [[] for _ in parts]
    for s in range(top - 1, -1, -1):
        k = int(np.searchsorted(-steps, -s, side="left"))
        x, now = state[:k], sym[:k, s]
        f, c = t.freq[now], t.cum[now]
        full = x >= (f << U(63 - t.scale))
        words[:k, s] = x.astype(np.uint32)
        out[:k, s] = full
        x = np.where(full, x >> U(32), x)
        q = x // f
        state[:k] = (q << U(t.scale)) + (x - q * f) + c
        if s % EVERY == 0:
            for i in range(k):
                kept[i].append(state[i].copy())
    done = []
    for i, n in enumerate(steps):
        mask = out[i, :n]
        at = np.concatenate([[0], np.cumsum(mask.sum(axis=1))])[0:n:EVERY]
        marks = np.concatenate([np.concatenate([[U(a)], x]) for a, x in zip(at.astype(U), kept[i][::-1])]) if n else np.zeros(0, U)
        done.append((words[i, :n][mask].astype("<u4").tobytes(), marks.astype("<u8").tobytes()))
    return done


def encode_blocks(parts: list[np.ndarray], t: Table) -> list[tuple[bytes, bytes]]:
    """(payload, checkpoints) of each token array; ValueError for a token that the table lacks."""
    for p in parts:
        if len(p) and (p.min() < 0 or p.max() >= len(t.freq) or (t.freq[p] == 0).any()):
            raise ValueError("a token is not in the shared table")
    order = sorted(range(len(parts)), key=lambda i: -len(parts[i]))
    out: list = [None] * len(parts)
    at = 0
    while at < len(order):
        end = at + 1
        while end < len(order) and end - at < 48 and 2 * len(parts[order[end]]) >= len(parts[order[at]]):
            end += 1
        for i, got in zip(order[at:end], _encode_group([parts[i] for i in order[at:end]], t)):
            out[i] = got
        at = end
    return out


def decode_block(payload: bytes, checkpoints: bytes, n: int, t: Table, first: int = 0, last: int | None = None) -> np.ndarray:
    """Tokens of one block; with first and last only those from checkpoint first up to checkpoint last."""
    steps = -(-n // LANES)
    marks = np.frombuffer(checkpoints, "<u8").reshape(-1, LANES + 1)
    words = np.frombuffer(payload, "<u4").astype(U)
    begin, end = first * EVERY, steps if last is None else min(steps, last * EVERY)
    if begin >= end:
        return np.zeros(0, np.int32)
    at, x = int(marks[first, 0]), marks[first, 1:].astype(U)
    out = np.zeros((end - begin, LANES), np.int32)
    mask = U((1 << t.scale) - 1)
    for s in range(end - begin):
        slot = x & mask
        now = t.symbol[slot.astype(np.int64)]
        out[s] = now
        x = t.freq[now] * (x >> U(t.scale)) + slot - t.cum[now]
        need = np.flatnonzero(x < U(LOW))
        x[need] = (x[need] << U(32)) | words[at : at + len(need)]
        at += len(need)
    return out.reshape(-1)[: n - begin * LANES]


@lru_cache(maxsize=4)
def _coder(path: str):
    return encoding(path)


def _tokens(vocabulary: str):
    def run(batches):
        code = _coder(vocabulary).encode_ordinary
        for batch in batches:
            for a, z in chunks(batch.column("text")):
                got = [None if s is None else np.array(code(s), np.int32) for s in batch.column("text").slice(a, z - a).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, z - a), pa.array(got, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return run


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").try_cast("bigint").alias("doc_id"), "text")


def tokenised(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, ids) by byte-level BPE of each whole text, as bpe.encode; null for null."""
    vocabulary = ship_vocabulary(docs.sparkSession, vocabulary)
    return _texts(docs).mapInArrow(_tokens(vocabulary), "doc_id bigint, ids array<int>")


def _packed(batches):
    """Documents' tokens gathered into blocks, stored as narrow integers until the table is known."""
    for batch in batches:
        ids = batch.column("ids")
        lengths = np.asarray(pc.fill_null(pc.list_value_length(ids), -1)).astype(np.int64)
        flat = np.asarray(ids.flatten())
        if len(flat) and flat.min() < 0:
            raise ValueError("token ids are not negative")
        end = np.cumsum(np.maximum(lengths, 0))
        at, rows = 0, []
        while at < len(lengths):
            base = int(end[at - 1]) if at else 0
            to = min(len(lengths), max(at + 1, int(np.searchsorted(end, base + BLOCK, side="right"))))
            part = flat[base : int(end[to - 1])]
            wide = "<u2" if not len(part) or part.max() < 1 << 16 else "<u4"
            data = zstandard.ZstdCompressor(level=1).compress(part.astype(wide).tobytes())
            rows.append((batch.column("doc_id").slice(at, to - at).to_pylist(), lengths[at:to].astype(np.int32), len(part), int(wide[2]), data))
            at = to
        if rows:
            d, n, c, w, x = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(d, pa.list_(pa.int64())), pa.array(n, pa.list_(pa.int32())), pa.array(c, pa.int64()), pa.array(w, pa.int32()), pa.array(x, pa.binary())],
                names=["doc_ids", "lengths", "n", "width", "data"],
            )


def _plain(row: dict) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(row["data"]), f"<u{row['width']}").astype(np.int32)


def _counts(batches):
    total = np.zeros(1 << 16, np.int64)
    for batch in batches:
        for row in batch.to_pylist():
            c = np.bincount(_plain(row), minlength=len(total))
            if len(c) > len(total):
                total = np.pad(total, (0, len(c) - len(total)))
            total += c
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["token", "n"])


def _coded(freq: np.ndarray):
    def run(batches):
        t = Table(freq)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                rows = batch.slice(at, 64).to_pylist()
                parts = [_plain(r) for r in rows]
                got = encode_blocks(parts, t)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(["block"] * len(rows)),
                        pa.array([r["doc_ids"] for r in rows], pa.list_(pa.int64())),
                        pa.array([r["lengths"] for r in rows], pa.list_(pa.int32())),
                        pa.array([len(p) for p in parts], pa.int64()),
                        pa.array([p for p, _ in got], pa.binary()),
                        pa.array([c for _, c in got], pa.binary()),
                        pa.array([zlib.crc32(c, zlib.crc32(p)) for p, c in got], pa.int64()),
                        pa.array([zlib.crc32(p.astype("<u4").tobytes()) for p in parts], pa.int64()),
                        pa.array([t.crc] * len(rows), pa.int64()),
                    ],
                    names=[x.split()[0] for x in SCHEMA.split(", ")],
                )

    return run


def encode(tokens: DataFrame) -> DataFrame:
    """Blocks (kind 'block') of tokens (doc_id, ids) and one row of kind 'table' with the shared frequencies.

    doc_ids and lengths name a block's documents in order; a null ids has length
    -1, an empty one 0.  Null elements count as no token.  Repeated documents
    each have their entry; other columns, whatever their names, are left out.  A
    doc_id that isn't an integer, nor the text of one, is null.  A document of more
    than 65,536 tokens, however long, is a block of its own.  Of equally frequent tokens the
    least id takes what rounding leaves.  An empty table gives the row of an empty
    frequency table alone.
    """
    ids = F.filter(F.col("ids").cast("array<int>"), lambda x: x.isNotNull())
    return _encode(tokens.select(F.col("doc_id").try_cast("bigint").alias("doc_id"), ids.alias("ids")).mapInArrow(_packed, PACKED))


def encode_documents(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """encode(tokenised(docs)), with the same results for odd rows, but tokens are packed where they are made instead of passing through the JVM."""
    vocabulary = ship_vocabulary(docs.sparkSession, vocabulary)
    make = _tokens(vocabulary)
    return _encode(_texts(docs).mapInArrow(lambda batches: _packed(make(batches)), PACKED))


def _encode(packed: DataFrame) -> DataFrame:
    packed = cut(packed)
    counts = packed.select("width", "data").mapInArrow(_counts, "token int, n bigint").groupBy("token").agg(F.sum("n").alias("n")).toArrow()
    token, n = np.asarray(counts.column("token")), np.asarray(counts.column("n"))
    full = np.zeros(int(token.max()) + 1 if len(token) else 0, np.int64)
    full[token] = n
    t = Table.of(full)
    freq = t.freq.astype(np.int64)
    head = packed.sparkSession.createDataFrame([("table", None, None, int(n.sum()), bytearray(t.pack()), None, None, None, t.crc)], SCHEMA)
    return head.unionByName(packed.mapInArrow(_coded(freq), SCHEMA))


def decode(coded: DataFrame) -> DataFrame:
    """(doc_id, ids) from encode's rows; a wrong checksum raises ValueError."""
    data = coded.filter("kind = 'table'").select("payload").first()
    freq = Table.unpack(bytes(data["payload"])).freq.astype(np.int64)

    def run(batches):
        t = Table(freq)
        for batch in batches:
            for r in batch.to_pylist():
                if zlib.crc32(r["checkpoints"], zlib.crc32(r["payload"])) != r["payload_crc"] or r["table_crc"] != t.crc:
                    raise ValueError("a block's payload or table is damaged")
                got = decode_block(r["payload"], r["checkpoints"], r["n_tokens"], t)
                if zlib.crc32(got.astype("<u4").tobytes()) != r["tokens_crc"]:
                    raise ValueError("a block's tokens differ from those encoded")
                lengths = np.array(r["lengths"], np.int64)
                off = np.concatenate([[0], np.cumsum(np.maximum(lengths, 0))]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(off), pa.array(got), mask=pa.array(lengths < 0))
                yield pa.RecordBatch.from_arrays([pa.array(r["doc_ids"], pa.int64()), ids], names=["doc_id", "ids"])

    return coded.filter("kind = 'block'").mapInArrow(run, "doc_id bigint, ids array<int>")
