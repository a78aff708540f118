"""SimHash near duplicates with covering locality-sensitive hashing.

A text's fingerprint has a bit for each of 64 places: 1 if it is set in more than half of the hashes of the text's word
shingles. Two fingerprints link if at most ``radius`` bits differ.

Candidates come from a covering family. Every bit i has a fixed vector phi(i) of radius + 1 bits, not zero. Table v, for
each v other than zero, keeps the bits with an odd inner product <phi(i), v>. Where two fingerprints differ in at most
``radius`` bits, these are as many linear conditions on the radius + 1 bits of v, so some v other than zero gives 0 for all
of them: its table keeps none of the bits that differ, and the pair meets in it. No pair within the radius is missed, by
structure and not by chance. With radius 3 that is 15 tables of about 34 of the 64 bits.

Only distinct fingerprints are sent to the tables, so copies cost nothing. A bucket (table, kept bits) is searched breadth
first: each fingerprint that is reached is compared with those that aren't yet, which gives at most one edge for each
member. A bucket of more than ``BUCKET`` members is not held in a task. There, x and y link if and only if some z lies
within half the radius (rounded down) of one and within the rest of the other, so every member is sent to all such z, as near
or far; at a z with a near member all of its members are connected with one of the near. These are so many keys a
member, whatever the bucket's size (31 and 466 for radius 3), and again at most one edge a key.

Defined results: a null or empty text, or one without words, has fingerprint zero, which links like any other; with fewer
words than a shingle the whole sequence is the one shingle; repeated rows, and rows that share a doc_id or have none,
take part each; a component's id is the smallest doc_id in it (null if none has one); an empty table gives an
empty table; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._graph import components
from ._store import checkpoint
from ._text import LOWER, blocks, word_spans
from .ngram_join import join_any, join_few

BITS = 64
SEED = 42
#: Members of a bucket up to which one task connects them.
BUCKET = 20_000
#: Comparisons that are held at once.
CELLS = 1 << 22
_ONES = np.uint64(0x0101010101010101)


def shingle_hashes(data: np.ndarray, at: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every shingle of the texts and the n + 1 offsets of the texts."""
    starts, ends, per_doc = word_spans(data, at)
    length = ends - starts
    # all words, one space apart
    first = np.concatenate([[0], np.cumsum(length + 1)])
    word = np.repeat(np.arange(len(length)), length)
    inside = np.arange(len(word)) - np.repeat(np.cumsum(length) - length, length)
    joined = np.full(int(first[-1]), 32, np.uint8)
    joined[first[word] + inside] = data[starts[word] + inside]
    n = np.diff(per_doc)
    many = np.where(n == 0, 0, np.maximum(1, n - words + 1))
    doc_at = np.concatenate([[0], np.cumsum(many)])
    begin = np.repeat(per_doc[:-1] - doc_at[:-1], many) + np.arange(int(doc_at[-1]))
    last = begin + np.repeat(np.minimum(words, n), many) - 1
    raw, digest = joined.tobytes(), xxhash.xxh64_intdigest
    spans = zip(first[begin].tolist(), (first[last] + length[last]).tolist(), strict=True)
    return np.fromiter((digest(raw[a:b], SEED) for a, b in spans), np.uint64, len(begin)), doc_at


def majority(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The 64 majority bits of each run of hashes; zero for an empty run.

    Eight bits of a hash are spread over the bytes of a word at a time, which are added up to 255 at once."""
    out = np.zeros(len(at) - 1, np.uint64)
    sizes = np.diff(at)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    parts = -(-sizes[full] // 255)
    owner = np.concatenate([[0], np.cumsum(parts)])
    nth = np.arange(int(owner[-1])) - np.repeat(owner[:-1], parts)
    cuts = np.repeat(at[:-1][full], parts) + 255 * nth
    for k in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(k)) & _ONES, cuts)
        set_bits = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8), owner[:-1], axis=0, dtype=np.int64)
        more = 2 * set_bits > sizes[full][:, None]
        for byte in range(8):
            out[full] |= more[:, byte].astype(np.uint64) << np.uint64(8 * byte + k)
    return out


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id, fp of each row: the fingerprint as a (signed) long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [np.zeros(0, np.uint64)]
            for _, _, data, at in blocks(batch.column(1)):
                parts.append(majority(*shingle_hashes(LOWER[data], at, words)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(parts).view(np.int64))], ["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp long")


def masks(radius: int) -> list[int]:
    """The bits that each table keeps, as unsigned numbers."""
    most = (1 << radius + 1) - 1
    phi = [1 + (i * 29 % BITS) % most for i in range(BITS)]
    return [sum(1 << i for i in range(BITS) if (phi[i] & v).bit_count() % 2) for v in range(1, most + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def stars(members: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (root, member) of a forest that connects what links within ``radius``, breadth first."""
    left, roots, out = members, [], []
    while len(left) > 1:
        root, left = left[:1], left[1:]
        front = root
        while len(front) and len(left):
            hit = np.zeros(len(left), bool)
            size = max(1, CELLS // len(left))
            for low in range(0, len(front), size):
                hit |= (np.bitwise_count(front[low : low + size, None] ^ left) <= radius).any(0)
            front, left = left[hit], left[~hit]
            roots.append(np.repeat(root, len(front)))
            out.append(front)
    none = np.zeros(0, np.uint64)
    return np.concatenate([*roots, none]), np.concatenate([*out, none])


def in_buckets(sorted_rows: DataFrame, radius: int, most: int) -> DataFrame:
    """From rows (tab, kept, fp), each bucket's together: edges (a, b) with tab null, and the members (a: fingerprint,
    b: kept bits) of buckets of more than ``most``, with their tab."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(a, b, tab) -> pa.RecordBatch:
            tabs = pa.nulls(len(a), pa.int32()) if tab is None else pa.array(np.full(len(a), tab, np.int32))
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), tabs], ["a", "b", "tab"])

        def members(tab: int, kept: np.uint64, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
            yield made(fps, np.full(len(fps), kept, np.uint64), tab)

        # the bucket at a batch's end goes on in the next one; beyond ``most`` members it is passed on as it comes
        now, waiting, large = None, [], False
        for batch in batches:
            tab, kept, fps = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            kept, fps = kept.view(np.uint64), fps.view(np.uint64)
            cut = np.flatnonzero((tab[1:] != tab[:-1]) | (kept[1:] != kept[:-1])) + 1
            begins, ends = np.concatenate([[0], cut]), np.concatenate([cut, [len(fps)]])
            # buckets of one member inside a batch have no pair
            inner = np.flatnonzero((ends - begins > 1) | (begins == 0) | (ends == len(fps)))
            roots, leaves = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
            for i in inner.tolist() if len(fps) else []:
                key, part = (int(tab[begins[i]]), kept[begins[i]]), fps[begins[i] : ends[i]]
                if key != now:
                    if waiting:
                        for x, y in zip((roots, leaves), stars(np.concatenate(waiting), radius), strict=True):
                            x.append(y)
                    now, waiting, large = key, [], False
                if large:
                    yield from members(*key, part)
                    continue
                waiting.append(part)
                if sum(map(len, waiting)) > most:
                    yield from members(*key, np.concatenate(waiting))
                    waiting, large = [], True
            yield made(np.concatenate(roots), np.concatenate(leaves), None)
        if waiting:
            yield made(*stars(np.concatenate(waiting), radius), None)

    return sorted_rows.mapInArrow(run, "a long, b long, tab int")


def around(members: DataFrame, radius: int) -> DataFrame:
    """Edges (a, b) of large buckets, from their members (a, b: kept bits, tab): all places within half the radius of
    one member and within the rest of it of another."""
    flips = []
    for tab, mask in enumerate(masks(radius)):
        free = [1 << i for i in range(BITS) if not mask >> i & 1]
        for n in range(radius - radius // 2 + 1):
            flips += [(tab, _signed(sum(c)), n <= radius // 2) for c in combinations(free, n)]
    table = F.broadcast(members.sparkSession.createDataFrame(flips, "tab int, flip long, near boolean"))
    sent = members.join(table, "tab").select("tab", "b", F.col("a").bitwiseXOR(F.col("flip")).alias("z"), "a", "near")
    hubs = sent.groupBy("tab", "b", "z").agg(F.min(F.when(F.col("near"), F.col("a"))).alias("hub"), F.count("*").alias("n")).where("hub is not null and n > 1").select("tab", "b", "z", "hub")
    return sent.join(hubs, ["tab", "b", "z"]).where("a <> hub").select(F.col("hub").alias("a"), F.col("a").alias("b")).distinct()


def links(distinct: DataFrame, radius: int = 3, most: int = BUCKET) -> DataFrame:
    """Edges (a, b) that connect all fingerprints of ``distinct`` (fp) within the radius, and no others."""
    tables = F.explode(F.array(*(F.struct(F.lit(k).alias("tab"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("kept")) for k, m in enumerate(masks(radius))))).alias("t")
    rows = distinct.select("fp", tables).select("t.tab", "t.kept", "fp")
    found = checkpoint(in_buckets(rows.repartition("tab", "kept").sortWithinPartitions("tab", "kept", "fp"), radius, most))
    edges, large = found.where("tab is null").select("a", "b"), found.where("tab is not null")
    if large.head(1):
        edges = edges.union(around(large, radius))
    return edges.distinct()


def near_groups(docs: DataFrame, words: int = 3, radius: int = 3, most: int = BUCKET) -> DataFrame:
    """doc_id, fp, component_id: groups of documents whose fingerprints are connected by links."""
    rows = checkpoint(fingerprints(docs, words))
    classes = checkpoint(rows.groupBy("fp").agg(F.min("doc_id").alias("own")))
    group = components(links(classes.select("fp"), radius, most)).toDF("fp", "component")
    linked = checkpoint(group.join(classes, "fp"))
    firsts = linked.groupBy("component").agg(F.min("own").alias("first"))
    linked = join_few(linked, firsts, "component").select("fp", "first", F.lit(True).alias("grouped"))
    classes = classes.join(linked, "fp", "left").select("fp", F.when(F.col("grouped"), F.col("first")).otherwise(F.col("own")).alias("component_id"))
    return join_any(rows, checkpoint(classes), "fp").select("doc_id", "fp", "component_id")


def op11_simhash(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, component_id for each row."""
    found = near_groups(docs)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
