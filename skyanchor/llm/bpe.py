"""Byte-level BPE through a global shuffle of distinct words.

Encoding: a block of documents (one Arrow batch, or a part of it) is cut into
pre-tokens.  Its distinct words go out in payloads by hash bucket of the word;
the positions, a stream of word numbers, stay with the block.  Each bucket
encodes every distinct word once and sends the ids back to the blocks, which
reassemble the documents by position.  A common word crosses the shuffle once a
block, not once an occurrence, so that no bucket grows hot.

A block's id is a hash of what is in it; blocks of equal contents give equal
tokens, so that the repeat of a lost task changes nothing.  Should the input
itself differ between the two readings of it, a block lacks its partner and the
job fails with a message instead of losing words: read the documents from files
or a checkpoint.

Decoding joins the table of token bytes, whose size is that of the vocabulary,
inside Arrow batches.
"""

from __future__ import annotations

import base64
import functools
import os
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import U, chunks, flat, fresh, mix, span_hashes, without

PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
BLOCK_BYTES = 16 << 20
#: Bytes of input to a bucket of words, where Spark knows the input's size.
BUCKET_BYTES = 64 << 20


def ship_vocabulary(spark, path: str) -> str:
    """Serve the vocabulary's file to the workers, which need not have it; its path, by which they know it."""
    spark.sparkContext.addFile(path)
    return path


def _local(path: str) -> str:
    """The file itself on the driver, the copy served on a worker without it."""
    if os.path.exists(path):
        return path
    from pyspark import SparkFiles

    return SparkFiles.get(os.path.basename(path))


@functools.lru_cache(maxsize=4)
def ranks(path: str) -> dict[bytes, int]:
    with open(_local(path), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


@functools.lru_cache(maxsize=4)
def encoding(path: str):
    import tiktoken

    return tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks(path), special_tokens={})


@functools.lru_cache(maxsize=4)
def word_encoding(path: str):
    """Encodes a pre-token, whatever is in it, in one piece."""
    import tiktoken

    return tiktoken.Encoding(path, pat_str=r"[\s\S]+", mergeable_ranks=ranks(path), special_tokens={})


@functools.lru_cache(maxsize=4)
def token_bytes(path: str) -> pa.Array:
    """The bytes of each token id, as large binary; ids that the vocabulary leaves out are null."""
    of = ranks(path)
    table: list[bytes | None] = [None] * (max(of.values(), default=-1) + 1)
    for b, i in of.items():
        table[i] = b
    return pa.array(table, pa.large_binary())


@functools.lru_cache(maxsize=1)
def _pattern():
    return regex.compile(PATTERN)


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays of unsigned integers, each in the narrowest type, compressed together."""
    head, body = [len(arrays)], []
    for a in arrays:
        top = int(a.max()) if len(a) else 0
        kind = 0 if top < 1 << 8 else 1 if top < 1 << 16 else 2 if top < 1 << 32 else 3
        head += [kind, len(a)]
        body.append(a.astype(("u1", "<u2", "<u4", "<u8")[kind]).tobytes())
    return zstandard.ZstdCompressor(level=3).compress(np.array(head, "<i8").tobytes() + b"".join(body))


def _unpack(data: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    head = np.frombuffer(raw, "<i8", 2 * n, 8)
    at, out = 8 + 16 * n, []
    for kind, length in head.reshape(n, 2):
        kind = ("u1", "<u2", "<u4", "<u8")[kind]
        out.append(np.frombuffer(raw, kind, int(length), at))
        at += int(length) * np.dtype(kind).itemsize
    return out


def _blocks(batches):
    """(block id, rows) of each block: the id hashes the block's doc_ids and texts."""
    for batch in batches:
        text = batch.column("text")
        for a, z in chunks(text, BLOCK_BYTES):
            part = batch.slice(a, z - a)
            raw, off = flat(part.column("text"))
            h = span_hashes(raw, off[:-1], off[1:])
            h = mix(h ^ mix(_id_hashes(part))) + np.arange(len(h), dtype=U)
            void = np.asarray(pc.is_null(part.column("text"))).astype(U)
            yield int(mix(h + void).sum(dtype=U).view(np.int64)), part


def _id_hashes(part: pa.RecordBatch) -> np.ndarray:
    """A number for each row's doc_id, if there is one that is an integer or has a text form."""
    at = part.schema.get_field_index("doc_id")
    if at < 0 or pa.types.is_nested(part.column(at).type):
        return np.zeros(part.num_rows, U)
    ids = part.column(at)
    if pa.types.is_integer(ids.type):
        return np.asarray(pc.fill_null(ids.cast(pa.int64()), -(1 << 62) + 1)).view(U)
    raw, off = flat(ids.cast(pa.large_binary()).view(pa.large_string()) if pa.types.is_binary(ids.type) else ids.cast(pa.large_string()))
    return span_hashes(raw, off[:-1], off[1:])


def _distinct(texts: list[str | None]) -> list[str]:
    """The distinct words in the order of their first occurrence; common ones tend to come early."""
    find, seen = _pattern().findall, {}
    for t in texts:
        if t:
            seen.update(dict.fromkeys(find(t)))
    return list(seen)


def _numbered(texts: list[str | None]) -> tuple[int, np.ndarray, np.ndarray]:
    """How many distinct words there are, the number of each occurrence's word as in _distinct, and the occurrences of each text."""
    find, number = _pattern().findall, defaultdict()
    number.default_factory = number.__len__
    each, stream = np.zeros(len(texts), np.int64), []
    for i, t in enumerate(texts):
        if t:
            found = find(t)
            each[i] = len(found)
            stream.append(np.fromiter(map(number.__getitem__, found), np.int64, len(found)))
    return len(number), np.concatenate(stream) if stream else np.zeros(0, np.int64), each


def _word_rows(buckets: int):
    def run(batches):
        for block, part in _blocks(batches):
            words = _distinct(part.column("text").to_pylist())
            if not words:
                continue
            raw, off = flat(pa.array(words, pa.large_string()))
            bucket = (span_hashes(raw, off[:-1], off[1:]) % U(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            ends = np.flatnonzero(np.diff(bucket[order], append=-1)) + 1
            keys, data, at = [], [], 0
            for end in ends:
                of = order[at:end]
                bs = [words[i].encode() for i in of]
                sizes = np.array([len(b) for b in bs])
                keys.append(int(bucket[of[0]]))
                data.append(_pack(np.diff(of, prepend=0), sizes, np.frombuffer(b"".join(bs), np.uint8)))
                at = end
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array([block] * len(keys), pa.int64()), pa.array(data, pa.binary())], names=["bucket", "block", "words"]
            )

    return run


def _stream_rows(batches):
    for block, part in _blocks(batches):
        n_words, stream, each = _numbered(part.column("text").to_pylist())
        sink = pa.BufferOutputStream()
        void = pc.is_null(part.column("text"))
        rest = part.drop_columns(["text"])
        rest = pa.RecordBatch.from_arrays([*rest.columns, void], names=[*(f"c{i}" for i in range(rest.num_columns)), "void"])
        with pa.ipc.new_stream(sink, rest.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
            w.write_batch(rest)
        yield pa.RecordBatch.from_arrays(
            [pa.array([block], pa.int64()), pa.array([n_words], pa.int64()), pa.array([_pack(stream, each)], pa.binary()), pa.array([sink.getvalue().to_pybytes()], pa.binary())],
            names=["block", "n_words", "stream", "rows"],
        )


def _encode_bucket(path: str):
    def run(batches):
        code, known = word_encoding(path).encode_ordinary, {}
        for batch in batches:
            out = []
            for data in batch.column(batch.schema.get_field_index("words")):
                step, sizes, raw = _unpack(data.as_py())
                raw, at, ids, count = raw.tobytes(), 0, [], np.zeros(len(sizes), np.int64)
                for i, n in enumerate(sizes.tolist()):
                    w = raw[at : at + n]
                    at += n
                    got = known.get(w)
                    if got is None:
                        got = known[w] = code(w.decode())
                    ids += got
                    count[i] = len(got)
                out.append(_pack(step, count, np.array(ids, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("block")), pa.array(out, pa.binary())], names=["block", "ids"])

    # a bucket comes batch by batch, so that only its distinct words are held
    run.__annotations__ = {"batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    return run


def _assemble(path: str, schema: pa.Schema, decode: bool):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        # blocks of equal contents have equal ids, and equal answers
        if not left.num_rows:
            raise ValueError("the documents differed between two readings: read them from files or a checkpoint")
        n = int(left.column("n_words")[0].as_py())
        sizes, parts = np.full(n, -1, np.int64), {}
        for data in right.column("ids"):
            step, count, ids = _unpack(data.as_py())
            number = np.cumsum(step.astype(np.int64))
            sizes[number] = count
            parts[int(number[0])] = (number, count.astype(np.int64), ids)
        if (sizes < 0).any():
            raise ValueError("the documents differed between two readings: read them from files or a checkpoint")
        first = np.concatenate([[0], np.cumsum(sizes)])
        pool = np.zeros(int(first[-1]), np.int32)
        for number, count, ids in parts.values():
            inner = np.arange(len(ids)) - np.repeat(np.cumsum(count) - count, count)
            pool[np.repeat(first[number], count) + inner] = ids
        tables = []
        for row in range(left.num_rows):
            stream, each = _unpack(left.column("stream")[row].as_py())
            rest = pa.ipc.open_stream(left.column("rows")[row].as_py()).read_all()
            void = rest.column(rest.num_columns - 1).combine_chunks()
            edges = np.concatenate([[0], np.cumsum(each.astype(np.int64))])
            docs = np.arange(len(each))
            size = sizes[stream]
            total = np.concatenate([[0], np.cumsum(size)])
            # about two million tokens at a time
            for cut in np.array_split(docs, max(1, int(total[-1]) >> 21)):
                if not len(cut):
                    continue
                s, e = edges[cut[0]], edges[cut[-1] + 1]
                part, count = stream[s:e], size[s:e]
                inner = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
                ids = pool[np.repeat(first[part], count) + inner]
                off = (total[edges[cut[0] : cut[-1] + 2]] - total[s]).astype(np.int32)
                mask = void.slice(int(cut[0]), len(cut))
                tokens = pa.ListArray.from_arrays(pa.array(off), pa.array(ids), mask=mask)
                number = pa.array(np.diff(off).astype(np.int64), mask=np.asarray(mask))
                cols = [*rest.slice(int(cut[0]), len(cut)).columns[:-1], tokens, number]
                if decode:
                    cols.append(decoded(tokens, path))
                tables.append(pa.Table.from_arrays(cols, schema=schema))
        return pa.concat_tables(tables) if tables else schema.empty_table()

    return run


def decoded(tokens: pa.ListArray, path: str) -> pa.Array:
    """The texts of lists of ids: a take from the token bytes.  An id that is null or not in the vocabulary adds nothing."""
    table = token_bytes(path)
    n = len(tokens)
    off = np.asarray(tokens.offsets).astype(np.int64)
    ids = tokens.values.slice(int(off[0]), int(off[-1] - off[0]))
    off = off - off[0]
    if ids.null_count:
        ids = pc.fill_null(ids, -1)
    flat_ids = np.asarray(ids)
    bad = (flat_ids < 0) | (flat_ids >= len(table))
    blank = table.slice(0, 0)
    table = pa.concat_arrays([pc.fill_null(table, b""), pa.array([b""], pa.large_binary())]) if len(table) else pa.concat_arrays([blank, pa.array([b""], pa.large_binary())])
    got = table.take(pa.array(np.where(bad, len(table) - 1, flat_ids)))
    _, boff, data = got.buffers()
    bounds = np.frombuffer(boff, np.int64)[got.offset : got.offset + len(got) + 1]
    where = bounds[off].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    joined = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(where.copy()), pa.py_buffer(raw)])
    if tokens.null_count:
        joined = pc.if_else(tokens.is_null(), pa.scalar(None, pa.large_binary()), joined)
    try:
        return joined.cast(pa.large_string()).cast(pa.string())
    except pa.ArrowInvalid:  # ids that don't make whole characters
        return pa.array([None if b is None else b.decode("utf-8", "replace") for b in joined.to_pylist()], pa.string())


def encode(docs: DataFrame, vocabulary: str = VOCABULARY, buckets: int | None = None, decode: bool = False) -> DataFrame:
    """docs with ids (array<int>) and n_tokens in place of text; with decode also decoded, the text of the ids.

    A null text has null ids, n_tokens and decoded; an empty one has no ids and 0; a
    very long one is coded whole.  Of several ways to merge, the lowest rank goes
    first, then the leftmost.  Repeated rows each have their row.  Other columns come
    through, whatever their names, but those named ids, n_tokens or decoded, which are
    replaced; doc_id may be of any type, or missing.  An empty table gives one.
    buckets, by default four times the shuffle partitions or more by the size of the
    input, only sets how far the encoding of words is spread.
    """
    spark = docs.sparkSession
    base = without(docs, "ids", "n_tokens", "decoded")
    buckets = buckets or _bucket_count(base)
    vocabulary = ship_vocabulary(spark, vocabulary)
    rest = [f for f in base.schema if f.name != "text"]
    ddl = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rest)
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType(rest))
    for name, kind in (("ids", pa.list_(pa.int32())), ("n_tokens", pa.int64()), *([("decoded", pa.string())] if decode else [])):
        schema = schema.append(pa.field(name, kind))
    # the same columns for both readings, as they set the size of Arrow batches
    words = base.mapInArrow(_word_rows(buckets), "bucket bigint, block bigint, words binary")
    coded = words.groupBy("bucket").applyInArrow(_encode_bucket(vocabulary), "block bigint, ids binary")
    streams = base.mapInArrow(_stream_rows, "block bigint, n_words bigint, stream binary, rows binary")
    out = f"{ddl}ids array<int>, n_tokens bigint" + ", decoded string" * decode
    return streams.groupBy("block").cogroup(coded.groupBy("block")).applyInArrow(_assemble(vocabulary, schema, decode), out)


def _bucket_count(df: DataFrame) -> int:
    """Buckets for words: four to a shuffle partition, or more where Spark's statistics tell of a larger input."""
    least = 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    known = size < int(df.sparkSession.conf.get("spark.sql.defaultSizeInBytes", str((1 << 63) - 1)))
    return max(least, min(size // BUCKET_BYTES, 1 << 20)) if known else least


def decode(tokens: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """tokens with decoded, the text of its ids; null for null, empty for none.

    Bytes that aren't UTF-8 become U+FFFD; an id that is null or not in the
    vocabulary adds nothing.  Long lists are decoded whole, repeated rows alike;
    other columns come through but one named decoded; an empty table gives one.
    """
    base = without(tokens, "decoded")
    vocabulary = ship_vocabulary(tokens.sparkSession, vocabulary)

    def run(batches):
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("ids"))
            yield pa.RecordBatch.from_arrays([*batch.columns, decoded(ids, vocabulary)], names=[*batch.schema.names, "decoded"])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema)
    return base.mapInArrow(run, f"{ddl}, decoded string")
