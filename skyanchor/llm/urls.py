"""URL filters over a sorted digest array.

The blocklist's canonical entries are hashed with 64-bit xxhash in the JVM,
sorted by key over range partitions, and written as segments (keys, offsets,
strings) to the shared folder, which must be mounted on the workers.  Pages are
probed in Arrow batches: keys of the URL's candidates are looked up by binary
search in the memory-mapped keys, and a hit counts only if the stored string is
the candidate itself.  Nothing is broadcast and pages aren't shuffled.
"""

from __future__ import annotations

import os
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .textkit import fresh, local_path, makedirs, shared_dir, without

BLOCKED = tuple(f"{a}.example.{b}" for a in ("adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm") for b in ("com", "net", "org"))
SEGMENT_ENTRIES = 4_000_000

SCHEME = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://)?"
HOST = SCHEME + r"(?:[^/?#@]*@)?([^/?#:]*)"
PATH = SCHEME + r"[^/?#]*([^?#]*)"
QUERY = r"^[^?#]*(\?[^#]*)"


def host(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(F.trim(url), HOST, 1)), r"\.+$", "")


def _page(url: Column) -> Column:
    path = F.regexp_extract(F.trim(url), PATH, 1)
    return F.concat(host(url), F.when(path == "", "/").otherwise(path))


def candidates(url: Column) -> Column:
    """Canonical strings that may block a URL, from the most special: the page with and without query, then its host's suffixes."""
    query = F.regexp_extract(F.trim(url), QUERY, 1)
    parts = F.split(host(url), r"\.")
    n = F.size(parts)
    suffixes = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.lit("d:"), F.array_join(F.slice(parts, i, n), ".")))
    page = _page(url)
    pages = F.array_distinct(F.array(F.concat(F.lit("u:"), page, query), F.concat(F.lit("u:"), page)))
    return F.when(url.isNotNull(), F.concat(pages, suffixes))


def entries(blocklist: DataFrame) -> DataFrame:
    """Distinct canonical entries of (entry): a host blocks itself and its subdomains; an entry with a path blocks that page."""
    e = F.trim(F.col("entry"))
    page = F.regexp_extract(e, PATH, 1) != ""
    query = F.regexp_extract(e, QUERY, 1)
    canonical = F.when(page, F.concat(F.lit("u:"), _page(e), query)).otherwise(F.concat(F.lit("d:"), host(e)))
    return blocklist.filter(e.isNotNull() & (host(e) != "")).select(canonical.alias("entry")).distinct()


def build(blocklist: DataFrame, folder: str | None = None) -> list[tuple[int, int, int, str]]:
    """Write the digest array; (least key, greatest key, entries, path stem) of its segments in ascending order."""
    spark = blocklist.sparkSession
    folder = folder or f"{local_path(shared_dir(spark))}/digests-{uuid.uuid4().hex}"
    keyed = entries(blocklist).select(F.xxhash64("entry").alias("key"), "entry")
    parts = max(1, -(-keyed.count() // SEGMENT_ENTRIES))

    def write(batches):
        tables = [b for b in batches if b.num_rows]
        if not tables:
            return
        table = pa.Table.from_batches(tables)
        keys = np.asarray(table.column("key").combine_chunks())
        text = [s.encode() for s in table.column("entry").to_pylist()]
        order = np.argsort(keys, kind="stable")
        stem = f"{makedirs(folder)}/{int(keys.min()) & ((1 << 64) - 1):016x}"
        off = np.concatenate([[0], np.cumsum([len(text[i]) for i in order])]).astype(np.int64)
        for name, data in (("keys", keys[order].tobytes()), ("offsets", off.tobytes()), ("strings", b"".join(text[i] for i in order))):
            own = f"{stem}.{name}.{uuid.uuid4().hex}"
            with open(own, "wb") as f:
                f.write(data)
            os.replace(own, f"{stem}.{name}")
        yield pa.RecordBatch.from_pydict({"lo": [int(keys.min())], "hi": [int(keys.max())], "n": [len(keys)], "stem": [stem]})

    made = keyed.repartitionByRange(parts, "key").mapInArrow(write, "lo bigint, hi bigint, n bigint, stem string").collect()
    return sorted((r.lo, r.hi, r.n, r.stem) for r in made)


@lru_cache(maxsize=64)
def _segment(stem: str):
    keys = np.memmap(f"{stem}.keys", np.int64, "r")
    return keys, np.memmap(f"{stem}.offsets", np.int64, "r"), np.memmap(f"{stem}.strings", np.uint8, "r")


def probe(keys: np.ndarray, names, segments: list[tuple[int, int, int, str]]) -> np.ndarray:
    """Whether the string names(i), of digest keys[i], is an entry, for every i."""
    out = np.zeros(len(keys), bool)
    for lo, hi, _, stem in segments:
        some = np.flatnonzero((keys >= lo) & (keys <= hi))
        if not len(some):
            continue
        table, off, raw = _segment(stem)
        left = np.searchsorted(table, keys[some], side="left")
        hit = table[np.minimum(left, len(table) - 1)] == keys[some]
        for i, at in zip(some[hit], left[hit]):
            name = names(int(i)).encode()
            while at < len(table) and table[at] == keys[i]:
                if raw[off[at] : off[at + 1]].tobytes() == name:
                    out[i] = True
                    break
                at += 1
    return out


def filter_urls(pages: DataFrame, blocklist: DataFrame, folder: str | None = None) -> DataFrame:
    """pages with blocked and rule, the most special entry that blocks the URL ('d:' host or 'u:' page) or null.

    Case of the host, user, port, fragment, outer blanks and trailing dots of
    the host don't matter.  A null or empty URL is never blocked, and a very long
    one is matched whole.  Equal entries count once, null and empty ones not at all;
    of several that block a URL the most special is the rule: the page with its
    query, the page, then the longest host.  Repeated rows fare alike; other columns
    come through, whatever their names, but those named blocked or rule, which are
    replaced; an empty table gives one, and an empty blocklist blocks nothing.
    """
    segments = build(blocklist, folder)
    base = without(pages, "blocked", "rule")

    def run(batches):
        for batch in batches:
            tried, digests = batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1)
            count = np.asarray(tried.value_lengths().fill_null(0)).astype(np.int64)
            names, keys = tried.flatten(), np.asarray(digests.flatten())
            ok = probe(keys, lambda i: names[i].as_py(), segments)
            rows = np.repeat(np.arange(len(count)), count)[ok]
            first, at = np.unique(rows, return_index=True)
            rule = np.full(len(count), -1, np.int64)
            rule[first] = np.flatnonzero(ok)[at]
            take = pa.array(np.where(rule < 0, 0, rule), mask=rule < 0)
            found = names.take(take) if len(names) else pa.nulls(len(count), pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(rule >= 0), found], names=[*batch.schema.names[:-2], "blocked", "rule"])

    names, keys = fresh(base.columns, "tried", "digests")
    tried = base.withColumn(names, candidates(F.col("url"))).withColumn(keys, F.transform(names, lambda x: F.xxhash64(x)))
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema)
    return tried.mapInArrow(run, f"{ddl}, blocked boolean, rule string")


def default_blocklist(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(x,) for x in BLOCKED], "entry string")


SQL = f"""
WITH listed AS (SELECT list(e) AS es FROM (VALUES {', '.join(f"('d:{x}')" for x in BLOCKED)}) v(e)),
u AS (SELECT page_id, url, regexp_replace(lower(regexp_extract(trim(url), '{HOST}', 1)), '\\.+$', '') AS h,
  regexp_extract(trim(url), '{PATH}', 1) AS p, regexp_extract(trim(url), '{QUERY}', 1) AS q FROM pages),
c AS (SELECT page_id, url, string_split(h, '.') AS parts, h || CASE WHEN p = '' THEN '/' ELSE p END AS page, q FROM u),
t AS (SELECT page_id, url, list_concat(['u:' || page || q, 'u:' || page], list_transform(range(1, len(parts) + 1), lambda i: 'd:' || array_to_string(parts[i:], '.'))) AS tried FROM c),
r AS (SELECT page_id, url, list_filter(tried, lambda x: list_contains(es, x))[1] AS rule FROM t, listed)
SELECT page_id, url, rule IS NOT NULL AS blocked, rule FROM r
"""
