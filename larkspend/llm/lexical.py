"""Ranked lexical search: term-at-a-time over short lists, then document-at-a-time over these sums and the long lists.

One pass over the texts makes blocks of an inverted index over the items' terms: of each block of whole documents a row with
its documents, their numbers of terms, and the postings of each term. Counts of the corpus (documents, terms, and each
term's documents) are sums over blocks, so every weight is known before a list is scored.

A block is then searched for every item. Its lists up to one ``SHORT``-th of the block's documents are short: they are scored term at a
time, which materialises one sorted list of documents with their sums. This list takes part like any other, with its
largest sum as its bound, among the long lists, each with the largest score of its term. What follows goes document at a time, in
windows of ``WINDOW`` neighbouring documents: a window in which no sum of the lists' bounds can reach the item's worst kept score is skipped
whole. In the others, lists are taken from the largest bound down; while the bounds of those that are left could
reach the worst kept score on their own, their documents become candidates (the essential lists), and after that the rest
are only looked up for candidates, which leave as soon as their sum and the bounds that are left fall short. A task carries each
item's best documents from block to block, so later blocks skip more, and returns them once; two rounds of ranking
over the tasks' results give the item's best. All of it is exact: a bound is never below what it bounds, and equal scores are kept
by their documents' ids.

Items are searched in groups of at most ``ITEMS``, each in a pass of its own: that bounds what the driver and a task know of
them, whatever their number.

Defined results: a null or empty text, or one without terms, is no document; repeated rows, and rows that share a doc_id,
take part each; equal scores are ranked by ascending doc_id, null last; an item that repeats is ranked each time, and one
without terms has no rows; empty tables give an empty table; extra columns are ignored. Terms are compared by 64-bit hashes.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._store import checkpoint
from ._text import LOWER, blocks, span_hashes, word_spans

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_SPACE = np.zeros(256, bool)
_SPACE[:128] = True
_SPACE[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False
_LOWER = {c: c + 32 for c in range(65, 91)}
#: Items that are searched at once.
ITEMS = 2048
#: Documents and postings in one block, at most (one document more may be in it).
BLOCK_DOCS, BLOCK_POSTINGS = 1 << 14, 1 << 19
#: A list of at most one in so many of a block's documents is short.
SHORT = 16
#: Documents that are looked at together.
WINDOW = 1024
#: Tasks whose results are ranked together in the first round.
TASKS = 64


def terms(text: str | None) -> list[str]:
    return TERM.findall((text or "").translate(_LOWER))


def index_blocks(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """ids, sizes (terms of each document), total, term, at, doc, tf: blocks of documents with a term, and of each term of
    ``vocabulary`` (sorted hashes) that they hold the places in the block and the counts. Places are in the order of ids."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    columns = ["ids", "sizes", "total", "term", "at", "doc", "tf"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sizes, keys, held = [], [], [], 0

        def close() -> Iterator[pa.RecordBatch]:
            own, size = pa.concat_arrays(ids), np.concatenate(sizes)
            order = pa.compute.sort_indices(own, null_placement="at_end").to_numpy()
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            low, parts = 0, [np.zeros(0, np.int64)]
            for n, key in keys:
                parts.append((key & 0xFFFFFFFF) * len(order) + place[low + (key >> 32)])
                low += n
            key, tf = np.unique(np.concatenate(parts), return_counts=True)
            term, doc = key // max(1, len(order)), key % max(1, len(order))
            first = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]])) if len(term) else np.zeros(0, np.int64)
            values = [term[first].astype(np.int32), np.concatenate([first, [len(doc)]]).astype(np.int32), doc.astype(np.int32), tf.astype(np.int32)]
            lists = [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), pa.array(v)) for v in (size[order].astype(np.int64), *values)]
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own.take(pa.array(order))), lists[0], pa.array([int(size.sum())]), *lists[1:]], columns)
            ids.clear(), sizes.clear(), keys.clear()

        for batch in batches:
            for low, high, data, at in blocks(batch.column(1)):
                data = LOWER[data]
                starts, ends, per_doc = word_spans(data, at, _SPACE)
                n = np.diff(per_doc)
                full = np.flatnonzero(n)
                if not len(full):
                    continue
                h = span_hashes(data, starts, ends)
                found = np.searchsorted(vocabulary, h)
                hit = np.flatnonzero(vocabulary[np.minimum(found, len(vocabulary) - 1)] == h) if len(vocabulary) else np.zeros(0, np.int64)
                doc = np.cumsum(n > 0)[np.searchsorted(per_doc, hit, "right") - 1] - 1
                ids.append(batch.column(0).slice(low, high - low).take(pa.array(full)))
                sizes.append(n[full])
                keys.append((len(full), doc << 32 | found[hit]))
                held += len(hit)
                if sum(map(len, sizes)) >= BLOCK_DOCS or held >= BLOCK_POSTINGS:
                    yield from close()
                    held = 0
        if ids:
            yield from close()

    return docs.select("doc_id", "text").mapInArrow(run, f"ids array<{kind}>, sizes array<long>, total long, term array<int>, at array<int>, doc array<int>, tf array<int>")


class Block:
    """A block's lists, with the score of each posting."""

    def __init__(self, sizes, term, at, doc, tf, weights: np.ndarray, n_docs: int, n_terms: int):
        self.size, tf = len(sizes), tf.astype(np.int64)
        m = 50 + 50 * sizes * n_docs // n_terms
        term_of = np.repeat(np.arange(len(term)), np.diff(at))
        score = weights[term[term_of]] * (1_000_000_000 * tf // (1000 * tf + 20 * m[doc]))
        windows = -(-self.size // WINDOW)
        self.lists = {}
        # the largest score of every list in every window, for all lists at once
        tops = np.zeros(len(term) * windows, np.int64)
        cell = term_of * windows + doc // WINDOW
        if len(cell):
            cut = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
            tops[cell[cut]] = np.maximum.reduceat(score, cut)
        tops = tops.reshape(len(term), windows)
        for k, t in enumerate(term.tolist()):
            a, b = at[k], at[k + 1]
            self.lists[t] = (doc[a:b], score[a:b], tops[k])


def _sum_short(lists: list[tuple], windows: int) -> tuple:
    """Term at a time: one list of documents with their summed scores."""
    doc, inverse = np.unique(np.concatenate([x[0] for x in lists]), return_inverse=True)
    score = np.zeros(len(doc), np.int64)
    np.add.at(score, inverse, np.concatenate([x[1] for x in lists]))
    tops = np.zeros(windows, np.int64)
    np.maximum.at(tops, doc // WINDOW, score)
    return doc, score, tops


def _merge(doc: np.ndarray, score: np.ndarray, more_doc: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    both, inverse = np.unique(np.concatenate([doc, more_doc]), return_inverse=True)
    total = np.zeros(len(both), np.int64)
    total[inverse[: len(doc)]] = score
    total[inverse[len(doc) :]] += more
    return both, total


def search(block: Block, query: list[int], worst: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of the block's documents that may be among an item's best ``k``: at least all of the block's best k
    that score above ``worst``, or as much as it, and above 0."""
    lists = [block.lists[t] for t in query if t in block.lists]
    short = [x for x in lists if len(x[0]) * SHORT <= block.size]
    lists = [x for x in lists if len(x[0]) * SHORT > block.size]
    windows = -(-block.size // WINDOW)
    if short:
        lists.append(_sum_short(short, windows))
    if not lists:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    lists.sort(key=lambda x: -int(x[2].max()))
    reach = sum(x[2] for x in lists)
    floor, docs, scores = max(1, worst), [], []
    # promising windows first: the floor rises sooner
    for w in np.argsort(-reach, kind="stable").tolist():
        if reach[w] < floor:
            break
        low, high = w * WINDOW, (w + 1) * WINDOW
        doc, score = np.zeros(0, np.int64), np.zeros(0, np.int64)
        left = int(reach[w])
        for own, points, tops in lists:
            top = int(tops[w])
            if not top:
                continue
            a, b = np.searchsorted(own, (low, high))
            if left >= floor:  # what is only in this list and later ones may still be enough
                doc, score = _merge(doc, score, own[a:b], points[a:b])
            elif len(doc):
                at = np.searchsorted(own[a:b], doc)
                at[at == b - a] = 0
                score = score + np.where(own[a:b][at] == doc, points[a:b][at], 0)
            left -= top
            good = score + left >= floor
            doc, score = doc[good], score[good]
        docs.append(doc)
        scores.append(score)
        if len(doc):
            every = np.concatenate(scores)
            if len(every) > k:
                best = np.argpartition(-every, k - 1)[:k]
                floor = max(floor, int(every[best].min()))
                alike = every >= floor
                docs, scores = [np.concatenate(docs)[alike]], [every[alike]]
    return np.concatenate(docs) if docs else np.zeros(0, np.int64), np.concatenate(scores) if scores else np.zeros(0, np.int64)


def best_of(index: DataFrame, queries: list[list[int]], weights: np.ndarray, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """item, doc_id, score, task: each task's best ``k`` documents of each item."""
    kind = index.schema["ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list[tuple]] = {}
        worst = np.zeros(len(queries), np.int64)
        type_of = None
        for batch in batches:
            type_of = batch.column(0).type.value_type
            for r in range(batch.num_rows):
                ids, *arrays = (batch.column(c)[r].values for c in range(6))
                block = Block(*(x.to_numpy() for x in arrays), weights, n_docs, n_terms)
                for item, query in enumerate(queries):
                    doc, score = search(block, query, int(worst[item]), k)
                    if not len(doc):
                        continue
                    rows = best.setdefault(item, [])
                    # places are in the order of ids, null last
                    order = np.lexsort((doc, -score))[:k]
                    rows += zip((-score[order]).tolist(), ((x is None, x) for x in ids.take(pa.array(doc[order])).to_pylist()), strict=True)
                    rows.sort(key=lambda x: (x[0], x[1][0], 0 if x[1][0] else x[1][1]))
                    del rows[k:]
                    if len(rows) == k:
                        worst[item] = -rows[-1][0]
        if best:
            flat = [(item, x[1][1], -x[0]) for item, rows in best.items() for x in rows]
            arrays = [pa.array([x[0] for x in flat], pa.int32()), pa.array([x[1] for x in flat], type_of), pa.array([x[2] for x in flat], pa.int64())]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(np.full(len(flat), TaskContext.get().partitionId()))], ["item", "doc_id", "score", "task"])

    return index.select("ids", "sizes", "term", "at", "doc", "tf").mapInArrow(run, f"item int, doc_id {kind}, score long, task long")


def weight(df: int, n_docs: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def rank(docs: DataFrame, items: DataFrame, k: int = 50, most_items: int = ITEMS) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` best documents of each item (item_id, text) with a score above 0."""
    spark, found = docs.sparkSession, None
    numbered = checkpoint(items.select("item_id", "text")).withColumn("n", F.monotonically_increasing_id())
    n_items = numbered.count()
    for low in range(0, max(n_items, 1), most_items):
        # the rows of one group, by their order
        rows = numbered.orderBy("n").offset(low).limit(most_items).collect()
        own = [list(dict.fromkeys(terms(r["text"]))) for r in rows]
        words = sorted({t for x in own for t in x})
        raw = np.frombuffer("".join(words).encode(), np.uint8)
        ends = np.cumsum([0, *(len(w.encode()) for w in words)])
        hashes = span_hashes(raw, ends[:-1], ends[1:])
        order = np.argsort(hashes)
        number = {words[i]: k for k, i in enumerate(order.tolist())}
        index = checkpoint(index_blocks(docs, hashes[order]))
        n_docs, n_terms = index.agg(F.coalesce(F.sum(F.size("ids")), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
        each = index.select(F.posexplode("term").alias("i", "t"), "at").groupBy("t").agg(F.sum(F.get("at", F.col("i") + 1) - F.get("at", F.col("i"))).alias("df"))
        weights = np.zeros(len(words), np.int64)
        for r in each.collect():  # a row for each of the items' terms
            weights[r["t"]] = weight(r["df"], n_docs)
        queries = [[number[t] for t in x if weights[number[t]] > 0] for x in own]
        got = best_of(index, queries, weights, n_docs, n_terms, k)
        order = (F.desc("score"), F.asc_nulls_last("doc_id"))
        for keys in (["item", F.floor(F.col("task") / TASKS)], ["item"]):
            got = got.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)
        names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(rows)], f"item int, item_id {items.schema['item_id'].dataType.simpleString()}")
        got = got.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
        found = got if found is None else found.union(got)
    return found


def op12_lexical(docs: DataFrame, items: DataFrame) -> DataFrame:
    return rank(docs, items)


#: The same in DuckDB.
OP12_SQL = r"""
with d as (select row_number() over () as r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as w from documents),
size as (select r, doc_id, cast(len(w) as bigint) as n from d where len(w) > 0),
total as (select cast(count(*) as bigint) as docs, cast(sum(n) as bigint) as terms from size),
items as (select row_number() over () as i, item_id, list_distinct(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as w from benchmark),
asked as (select i, item_id, unnest(w) as term from items),
tf as (select r, term, cast(count(*) as bigint) as tf from (select r, unnest(w) as term from d) where term in (select term from asked) group by r, term),
weight as (select term, cast(floor(1000 * ln(cast(2 * docs + 2 as double) / cast(2 * count(*) + 1 as double))) as bigint) as w from tf, total group by term, docs),
m as (select r, doc_id, 100 - 50 + ((50 * n * docs) // terms) as m from size, total),
scored as (select i, item_id, doc_id, r, cast(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) as bigint) as score from asked join tf using (term) join weight using (term) join m using (r) group by i, item_id, doc_id, r)
select item_id, cast(rank as int) as rank, doc_id, score from (select *, row_number() over (partition by i order by score desc, doc_id) as rank from scored where score > 0) where rank <= 50
"""
