"""N-gram Jaccard join by vertical partitioning, and the groups of documents that its links connect.

The global order of n-grams is that of their hashes. It is cut into fragments; overlaps of two documents are counted in
each fragment on its own and summed per pair. Before that, three exact filters leave few documents and pairs:

1. *Shared prefixes.* With J >= t, two sets of sizes n and m share at least ceil(t * max(n, m)) n-grams. So the first
   n - ceil(t n) + l(n) of one and the same of the other have at least min(l(n), l(m)) in common, l(n) = 1 + n // 10. Only
   these prefixes are sent to the fragments, as compact keys; a document less than that many of whose prefix n-grams
   occur in another document has no link.
2. *Classes.* Documents with equal sets are one class, represented by the smallest id.
3. *Rarest first.* Inside the prefixes, n-grams are ordered by how many representatives have them; as at least l of
   them are shared, all but l - 1 of the most frequent suffice, which leaves out what many texts share.

A list of representatives that share an n-gram isn't expanded into pairs. The one with the smallest share of n-grams
of its own is the hub; only pairs with a hub are counted. What is within twice the distance of a link leaves the list,
and so does what has so many n-grams of its own that no other set in the list is small enough for it; the rest gets a new
hub. After ``HUB_ROUNDS`` hubs, what is left is paired where n-grams of their own leave a link possible. Jaccard distance
is a metric, so a document that links to the hub cannot link to one that stayed. Documents near a hub that don't link to
it are compared with others around it only where the three sizes and overlaps allow a link (``around_hubs``) and both
aren't connected yet. So every link either is found or joins documents which are already in one group, and the pairs that
are counted for the groups grow with a group's size, not with its square.

Numbers of links (``degrees``) need every pair of a group. As links never leave a group, each group's representatives are
cut into blocks, each pair of blocks is one task that multiplies their incidence matrices and returns one number a
representative; copies count by their number. No pair becomes a row, but the work of a group grows with the square of its
number of different sets.

Copies of one text meet in one task nowhere: prefix n-grams that a batch repeats are sent once, classes are counted with
partial sums, and what a class knows goes back to its copies by a broadcast of the few classes with many of them.

Defined results: a null or empty text, or one without words, has the empty set, is linked with nothing and is its own
group; a text of fewer words than an n-gram has its whole sequence as its one n-gram; every row takes part on its own,
also where rows share a doc_id or have none, and a group's id is the smallest doc_id in it (null if it has none); an empty
table gives an empty table; extra columns are ignored. Results depend on hashes only through collisions of 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._graph import components
from ._store import checkpoint, compact, placed
from ._text import LOWER, blocks, mix, range_hashes, run_hashes, span_hashes, word_spans

#: Ids up to so many are broadcast to pick rows (8 MB); more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Keys of more rows than this, and than one in so many of all rows, are joined apart; so there are never more than
#: HOT_KEYS of them.
HOT_ROWS, HOT_KEYS = 1000, 100_000
#: In place of the document of a key that a batch has in several documents.
NOBODY = (1 << 16) - 1
#: Fragments in which the overlaps of pairs are counted.
FRAGMENTS = 4
#: Rounds of hubs, after which what is left of the lists is paired directly.
HUB_ROUNDS = 3
#: Representatives and n-grams in one block of a group, about, for numbers of links.
BLOCK_ROWS, BLOCK_GRAMS = 1000, 1_000_000
#: N-grams that are columns of a matrix at once.
COLUMNS = 4096


def sets(column: pa.Array, words: int) -> Iterator[np.ndarray]:
    """The sorted distinct n-gram hashes of each text."""
    for low, high, data, at in blocks(column):
        data = LOWER[data]
        starts, ends, per_doc = word_spans(data, at)
        word = span_hashes(data, starts, ends)
        grams = run_hashes(word, words)
        for i in range(high - low):
            a, b = per_doc[i], per_doc[i + 1]
            if b - a >= words:
                yield np.unique(grams[a : b - words + 1])
            else:
                yield range_hashes(word, np.array([a]), np.array([b])) if b > a else grams[:0]


def _least(n, num: int, den: int):
    """ceil(num * n / den), for numbers or Columns of integers."""
    return (num * n + den - 1) // den if isinstance(n, int) else F.floor((num * n + den - 1) / den)


def prefix_length(n: int, num: int, den: int) -> int:
    return min(n, n - _least(n, num, den) + 1 + n // 10)


def common(n: Column, num: int, den: int) -> Column:
    """How many prefix n-grams a set of size n shares with any linked one, at least."""
    return 1 + F.floor(_least(n, num, den) / 10)


def _as_longs(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def shared_prefixes(docs: DataFrame, words: int, num: int, den: int, fragments: int) -> DataFrame:
    """(id, size, shared) of each document: its set's size and how many of its prefix n-grams others have too.

    A key that several documents of a batch have is known to be shared there; it is sent once, for other batches, so
    that what a frequent n-gram sends grows with the number of batches. A fragment answers each batch with the numbers
    of shared keys of its documents, which are summed batch by batch."""
    bits = 16 if fragments <= 1 << 16 else 24
    width = 8 - bits // 8

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = TaskContext.get().partitionId() << 40
        for batch in batches:
            for low in range(0, batch.num_rows, 2000):
                part, turn = batch.slice(low, 2000), turn + 1
                ids = part.column(0).to_numpy(zero_copy_only=False)
                own = list(sets(part.column(1), words))
                sizes = np.array([len(x) for x in own], np.int64)
                prefix = [x[: prefix_length(len(x), num, den)] for x in own]
                doc = np.repeat(np.arange(len(own)), [len(x) for x in prefix])
                key = np.concatenate([*prefix, np.zeros(0, np.uint64)])
                key, first, index, n = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
                local = np.bincount(doc[n[index] > 1], minlength=len(own))
                doc = np.where(n > 1, NOBODY, doc[first]).astype(np.uint16)
                fragment = ((key & np.uint64((1 << bits) - 1)).astype(np.int64) * fragments) >> bits
                order = np.argsort(fragment, kind="stable")
                bounds = np.searchsorted(fragment[order], np.arange(fragments + 1)).tolist()
                rows = [(turn % fragments, turn, b"", np.concatenate([ids, sizes, local]).tobytes())]
                for f, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
                    if b > a:
                        take = order[a:b]
                        # the lowest bytes of a key choose the fragment, the others are sent
                        wide = np.ascontiguousarray((key[take] >> np.uint64(bits)).view(np.uint8).reshape(-1, 8)[:, :width])
                        rows.append((f, turn, wide.tobytes(), doc[take].tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.binary(), pa.binary()))], ["fragment", "batch", "keys", "docs"])

    def answer(table: pa.Table) -> pa.Table:
        batch, blobs, docs_of = (table[c].to_pylist() for c in ("batch", "keys", "docs"))
        asked = [i for i, k in enumerate(blobs) if k]
        narrow = np.frombuffer(b"".join(blobs), np.uint8).reshape(-1, width)
        wide = np.zeros((len(narrow), 8), np.uint8)
        wide[:, :width] = narrow
        _, index, n = np.unique(wide.view(np.uint64).ravel(), return_inverse=True, return_counts=True)
        more, at = n[index] > 1, 0
        # what a batch said of itself comes first and goes on as it is
        rows = [(batch[i], docs_of[i], b"") for i, k in enumerate(blobs) if not k]
        for i in asked:
            doc = np.frombuffer(docs_of[i], np.uint16)
            doc, count = np.unique(doc[more[at : at + len(doc)] & (doc != NOBODY)], return_counts=True)
            at += len(docs_of[i]) // 2
            if len(doc):
                rows.append((batch[i], b"", np.stack([doc, count.astype(np.uint16)]).tobytes()))
        return pa.table({c: pa.array([r[j] for r in rows], t) for j, (c, t) in enumerate((("batch", pa.int64()), ("own", pa.binary()), ("more", pa.binary())))})

    def total(table: pa.Table) -> pa.Table:
        ids, sizes, shared = np.frombuffer(b"".join(table["own"].to_pylist()), np.int64).reshape(3, -1)
        shared = shared.copy()
        for x in table["more"].to_pylist():
            if x:
                doc, count = np.frombuffer(x, np.uint16).reshape(2, -1)
                shared[doc] += count
        return pa.table({"id": ids, "size": sizes, "shared": shared})

    sent = docs.mapInArrow(send, "fragment int, batch long, keys binary, docs binary")
    answers = sent.groupBy("fragment").applyInArrow(answer, "batch long, own binary, more binary")
    return answers.groupBy("batch").applyInArrow(total, "id long, size long, shared long")


def join_any(many: DataFrame, one: DataFrame, key: str) -> DataFrame:
    """``many`` with the row of ``one`` that has its ``key``, whatever share of ``many`` a key holds: the rows of the few
    keys with very many rows stay where they are and look their key up in a broadcast table."""
    most = max(HOT_ROWS, many.count() // HOT_KEYS)
    hot = many.groupBy(key).count().where(F.col("count") > most).select(key)
    hot = checkpoint(one.join(F.broadcast(hot), key, "left_semi"))
    if not hot.head(1):
        return many.join(one, key)
    keys = F.broadcast(hot.select(key))
    rest = many.join(keys, key, "left_anti").join(one.join(keys, key, "left_anti"), key)
    return many.join(F.broadcast(hot), key).unionByName(rest)


def join_few(many: DataFrame, one: DataFrame, key: str) -> DataFrame:
    """``many`` with the row of ``one`` that has its ``key``; ``one`` is broadcast if it is small, so that no key's rows
    meet in one task."""
    one = compact(one)
    return many.join(F.broadcast(one), key) if one.count() <= BROADCAST_IDS else join_any(many, one, key)


def pick(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``docs`` (id, text) whose id is among ``ids``."""
    ids = ids.select(F.col("id").alias("__id"))
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, F.col("id") == F.col("__id"), "left_semi")


def prints(docs: DataFrame, words: int) -> DataFrame:
    """(id, print): 128 bits that stand for the document's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = np.uint64(0xA0761D6478BD642F)
        for batch in batches:
            out = [np.array([len(x), x.sum(dtype=np.uint64), mix(x ^ salt).sum(dtype=np.uint64)], np.uint64).tobytes() for x in sets(batch.column(1), words)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["id", "print"])

    return docs.mapInArrow(run, "id long, print binary")


def segments(docs: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """(id, size, fragment, grams, prefix): each set cut at fixed places of the order; the prefix is with fragment 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = (np.arange(1, FRAGMENTS, dtype=np.uint64) * np.uint64((1 << 64) // FRAGMENTS)).astype(np.uint64)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for low in range(0, len(ids), 500):
                rows, grams, prefix = [], [], []
                for i, x in zip(ids[low : low + 500], sets(batch.column(1).slice(low, 500), words), strict=True):
                    for f, part in enumerate(np.split(x, np.searchsorted(x, cuts))):
                        rows.append((i, len(x), f))
                        grams.append(part)
                        prefix.append(x[: prefix_length(len(x), num, den)] if f == 0 else x[:0])
                columns = [pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.int64(), pa.int64(), pa.int32()))]
                for parts in (grams, prefix):
                    at = np.cumsum([0, *map(len, parts)])
                    columns.append(pa.ListArray.from_arrays(pa.array(at, pa.int32()), _as_longs(np.concatenate([*parts, np.zeros(0, np.uint64)]))))
                yield pa.RecordBatch.from_arrays(columns, ["id", "size", "fragment", "grams", "prefix"])

    return docs.mapInArrow(run, "id long, size long, fragment int, grams array<long>, prefix array<long>")


def bodies(cut: DataFrame, often: DataFrame, num: int, den: int) -> DataFrame:
    """(id, size, common, key): of each representative, how many n-grams others have too, if that leaves a link
    possible; ``key`` puts the one with the smallest share of n-grams of its own first."""
    common_grams = cut.select("id", "size", F.explode("grams").alias("gram")).join(often, "gram").groupBy("id", "size").agg(F.count("*").alias("common"))
    own = F.floor((F.col("size") - F.col("common")) * 1_000_000 / F.col("size"))
    return common_grams.where(den * F.col("common") >= num * F.col("size")).withColumn("key", own * (1 << 40) + F.pmod(F.xxhash64("id"), F.lit(1 << 40)))


def may_link(common, size, other_size, num: int, den: int) -> Column:
    """An overlap of at most ``common`` can still be enough for sets of these sizes."""
    return (num + den) * common >= num * (size + other_size)


def lists(cut: DataFrame, often: DataFrame, body: DataFrame, num: int, den: int) -> DataFrame:
    """(gram, id, size, common, key): for each representative the rarest of its prefix n-grams that it has to share,
    without those that no other representative has."""
    flat = cut.where("fragment = 0").select("id", F.size("prefix").alias("length"), F.explode("prefix").alias("gram"))
    mine = Window.partitionBy("id")
    ranked = flat.join(often, "gram").withColumn("alone", F.col("length") - F.count("*").over(mine)).withColumn("rank", F.row_number().over(mine.orderBy("n", "gram")))
    ranked = ranked.join(body, "id")
    return ranked.where(F.col("alone") + F.col("rank") <= F.col("length") - common(F.col("size"), num, den) + 1).select("gram", "id", "size", "common", "key")


def _both(pairs: DataFrame, cut: DataFrame) -> DataFrame:
    """Pairs (a, b) with both sides' segments, a row a fragment in which both have n-grams.

    Segments of other documents are filtered out where they are, by the pairs' ids, if these are few enough to
    broadcast; so only what is compared is shuffled."""
    if pairs.count() <= BROADCAST_IDS:
        a, b = (F.broadcast(pairs.select(F.col(c).alias("id")).distinct()) for c in ("a", "b"))
        left_cut, right_cut = cut.join(b, "id", "left_semi"), cut.join(a, "id", "left_semi")
    else:
        left_cut = right_cut = cut
    left = left_cut.select(F.col("id").alias("b"), F.col("size").alias("size_b"), "fragment", F.col("grams").alias("grams_b"))
    right = right_cut.select(F.col("id").alias("a"), F.col("size").alias("size_a"), "fragment", F.col("grams").alias("grams_a"))
    return pairs.join(left, "b").join(right, ["a", "fragment"])


def count_overlaps(pairs: DataFrame, cut: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b, size_a, size_b, inter, distance, linked) of the pairs (a, b) with any n-gram in common: partial counts in
    each fragment, summed."""
    partial = _both(pairs, cut).select("a", "b", "size_a", "size_b", F.size(F.array_intersect("grams_a", "grams_b")).alias("part"))
    total = partial.groupBy("a", "b", "size_a", "size_b").agg(F.sum("part").alias("inter")).where("inter > 0")
    union = F.col("size_a") + F.col("size_b") - F.col("inter")
    return total.withColumn("distance", 1 - F.col("inter") / union).withColumn("linked", den * F.col("inter") >= num * union)


def around_hubs(stars: DataFrame, group: DataFrame, cut: DataFrame, often: DataFrame, body: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) that may link although one of them, x, is near a hub h without linking to it, and y is not far off.

    x and y share at most min(i(h, x), i(h, y)) n-grams of the hub. Either that is enough, for a y smaller than the hub,
    or they share n-grams that the hub lacks: at least c of those of x, so the rarest of them but c - 1 meet one of y's.
    """
    slack = 1 - num / den + 1e-9
    own = group.select(F.col("id").alias("b"), F.col("component").alias("group"))
    near = stars.where(~F.col("linked") & (F.col("distance") <= 2 * slack))
    hubs = near.select("a").distinct()
    attached = join_few(stars.where(F.col("distance") <= 3 * slack), hubs, "a").join(own, "b", "left").join(body.select(F.col("id").alias("b"), "common"), "b")
    attached = compact(attached.select("a", "b", F.col("size_b").alias("size"), "size_a", "inter", "distance", "linked", "common", F.coalesce("group", "b").alias("group")))
    # a hub all of whose documents are one group has no work left
    mixed = attached.groupBy("a").agg(F.min("group").alias("g0"), F.max("group").alias("g1"), F.min("size").alias("least_size")).where("g0 <> g1").select("a", "least_size")
    attached = join_few(attached, mixed, "a")
    smallest = F.greatest(F.col("least_size"), _least(F.col("size"), num, den))
    x = attached.where(~F.col("linked") & (F.col("distance") <= 2 * slack) & may_link(F.col("common"), F.col("size"), F.col("least_size"), num, den))
    x = x.withColumn("need", F.greatest(F.lit(1), F.ceil(num * (F.col("size") + smallest) / (num + den)) - F.col("inter")))
    fields = ("size", "inter", "distance", "common", "group")
    x = x.select("a", F.col("b").alias("x"), "need", "least_size", *(F.col(f).alias(f"{f}_x") for f in fields))
    y = attached.select("a", F.col("b").alias("y"), "size_a", *(F.col(f).alias(f"{f}_y") for f in fields))
    may = (F.col("x") != F.col("y")) & (F.col("group_x") != F.col("group_y")) & (F.abs(F.col("distance_x") - F.col("distance_y")) <= slack)
    sizes = (F.col("size_x"), F.col("size_y"), num, den)
    may &= may_link(F.least("common_x", "common_y"), *sizes)

    inside = x.where(may_link(F.col("inter_x"), F.col("size_x"), F.col("least_size"), num, den)).join(y.where("size_y < size_a"), "a").where(may & may_link(F.least("inter_x", "inter_y"), *sizes))

    other = _both(attached.select("a", "b"), cut).select("a", "b", F.explode(F.array_except("grams_b", "grams_a")).alias("gram")).join(often, "gram")
    each = Window.partitionBy("a", "b")
    ranked = other.withColumn("rank", F.row_number().over(each.orderBy("n", "gram"))).withColumn("all", F.count("*").over(each))
    ranked = compact(ranked.select("a", "b", "gram", "rank", "all"))
    rare = ranked.select("a", F.col("b").alias("x"), "gram", "rank", "all").join(x, ["a", "x"]).where(F.col("rank") <= F.col("all") - F.col("need") + 1)
    outside = rare.join(ranked.select("a", F.col("b").alias("y"), "gram").join(y, ["a", "y"]), ["a", "gram"]).where(may)
    pairs = inside.select("x", "y").union(outside.select("x", "y"))
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def link_counts(group: DataFrame, classes: DataFrame, cut: DataFrame, num: int, den: int) -> DataFrame:
    """(rep, others): how many documents of other classes each representative in ``group`` links to."""
    own = cut.where("fragment = 0").select("id", "size").join(group.select("id", "component"), "id").join(classes.select(F.col("rep").alias("id"), "copies"), "id")
    own = compact(own)
    per = own.groupBy("component").agg(F.greatest(F.ceil(F.count("*") / BLOCK_ROWS), F.ceil(F.sum("size") / BLOCK_GRAMS)).alias("blocks"))
    own = compact(join_few(own, per, "component").select("id", "component", "copies", "blocks", F.pmod(F.xxhash64("id"), F.col("blocks")).alias("block")))
    few = own.count() <= BROADCAST_IDS // 4
    placed = cut.join(F.broadcast(own), "id") if few else pick(cut, own).join(own, "id")
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    sent = placed.select("component", F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right"), "id", "block", "size", "copies", "grams")

    def count(table: pa.Table) -> pa.Table:
        ids, at, index = np.unique(table["id"].to_numpy(), return_index=True, return_inverse=True)
        size, copies, block = (table[c].to_numpy()[at].astype(np.int64) for c in ("size", "copies", "block"))
        grams = table["grams"].combine_chunks()
        owner = np.repeat(index, grams.value_lengths().to_numpy(zero_copy_only=False))
        _, gram, n = np.unique(grams.flatten().to_numpy(), return_inverse=True, return_counts=True)
        shared = n[gram] > 1
        owner, gram = owner[shared], (np.cumsum(n > 1) - 1)[gram[shared]]
        order = np.argsort(gram, kind="stable")
        owner, gram = owner[order], gram[order]
        first, last = table["left"][0].as_py(), table["right"][0].as_py()
        rows, columns = np.flatnonzero(block == first), np.flatnonzero(block == last)
        inter = np.zeros((len(rows), len(columns)), np.float32)
        for low in range(0, int(gram[-1]) + 1 if len(gram) else 0, COLUMNS):
            a, b = np.searchsorted(gram, (low, low + COLUMNS))
            has = np.zeros((len(ids), COLUMNS), np.float32)
            has[owner[a:b], gram[a:b] - low] = 1
            inter += has[rows] @ has[columns].T
        inter = inter.astype(np.int64)
        linked = den * inter >= num * (size[rows][:, None] + size[columns] - inter)
        if first == last:
            np.fill_diagonal(linked, False)
            return pa.table({"rep": ids[rows], "others": linked @ copies[columns]})
        return pa.table({"rep": np.concatenate([ids[rows], ids[columns]]), "others": np.concatenate([linked @ copies[columns], copies[rows] @ linked])})

    return sent.groupBy("component", "left", "right").applyInArrow(count, "rep long, others long").groupBy("rep").agg(F.sum("others").alias("others"))


def groups(rows: DataFrame, words: int, num: int, den: int, degrees: bool) -> DataFrame:
    """id, n_shingles, component_id, n_links of ``rows`` (id, text) with unique ids; without ``degrees``, numbers of links
    count equal sets only."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    fragments = min(1 << 24, max(parts, rows.count() // 20_000))
    meta = checkpoint(shared_prefixes(rows, words, num, den, fragments))

    alive = meta.where((F.col("size") > 0) & (F.col("shared") >= common(F.col("size"), num, den)))
    printed = checkpoint(prints(pick(rows, alive), words))
    classes = printed.groupBy("print").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    classes = checkpoint(classes)
    cut = checkpoint(segments(pick(rows, classes.select(F.col("rep").alias("id"))), words, num, den))

    often = checkpoint(cut.select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count("*").alias("n")).where("n > 1"))
    body = compact(bodies(cut, often, num, den))
    todo, links, seen = compact(lists(cut, often, body, num, den)), [], []
    least = lambda x, y: may_link(F.least(f"common_{x}", f"common_{y}"), F.col(f"size_{x}"), F.col(f"size_{y}"), num, den)
    for turn in range(HUB_ROUNDS + 1):
        hubs = compact(todo.groupBy("gram").agg(F.min_by("id", "key").alias("hub"), F.min("size").alias("least_size"), F.count("*").alias("n")).where("n > 1"))
        if not hubs.head(1):
            break
        if turn < HUB_ROUNDS:
            near = todo.join(hubs.select("gram", "hub", "least_size"), "gram").where("id <> hub")
            pairs = near.select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()
        else:
            known = todo.join(hubs.select("gram"), "gram", "left_semi")
            x, y = (known.select("gram", F.col("id").alias(c), *(F.col(n).alias(f"{n}_{c}") for n in ("size", "common"))) for c in ("a", "b"))
            pairs = x.join(y, "gram").where((F.col("a") < F.col("b")) & least("a", "b")).select("a", "b").distinct()
        counted = compact(count_overlaps(compact(pairs), cut, num, den))
        links.append(counted.where("linked").select("a", "b"))
        if turn == HUB_ROUNDS:
            break
        seen.append(counted)
        gone = counted.where(F.col("distance") <= 2 * (1 - num / den + 1e-9)).select(F.col("a").alias("hub"), F.col("b").alias("id"))
        stay = near.where(may_link(F.col("common"), F.col("size"), F.col("least_size"), num, den))
        todo = compact(stay.join(gone, ["hub", "id"], "left_anti").select("gram", "id", "size", "common", "key"))

    if links:
        group = components(_union(links))
        pairs = compact(around_hubs(_union(seen), group, cut, often, body, num, den))
        if pairs.head(1):
            more = compact(count_overlaps(pairs, cut, num, den)).where("linked").select("a", "b")
            group = components(_union([*links, more]))
        known = group.toDF("rep", "component")
        if degrees:
            known = known.join(link_counts(group, classes, cut, num, den), "rep")
        else:
            known = known.withColumn("others", F.lit(0).cast("long"))
        classes = checkpoint(classes.join(known, "rep", "left"))
    else:
        classes = classes.withColumn("component", F.col("rep")).withColumn("others", F.lit(0).cast("long"))
    classes = classes.select("print", F.coalesce("component", "rep").alias("component"), (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    member = join_any(printed, classes, "print").select("id", "component", "n_links")
    return meta.join(member, "id", "left").select("id", F.col("size").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def similar_groups(docs: DataFrame, words: int = 4, num: int = 85, den: int = 100, degrees: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id: groups of documents connected by links of Jaccard similarity num / den or more;
    with ``degrees`` also n_links, the number of documents that each one links to."""
    own, plain = placed(docs.select("doc_id", "text"))
    found = groups(own.select(F.col("__place").alias("id"), "text"), words, num, den, degrees)
    if plain:
        found = found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "n_links")
    else:
        ids = own.select(F.col("__place").alias("id"), "doc_id")
        firsts = ids.select(F.col("id").alias("component_id"), F.col("doc_id").alias("__first"))
        found = join_any(checkpoint(found.join(ids, "id")), firsts, "component_id").select("doc_id", "n_shingles", F.col("__first").alias("component_id"), "n_links")
    return found if degrees else found.drop("n_links")


def without_repeats(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """Of each group the row with the smallest doc_id; one of them, where rows share that id or none has any."""
    own, _ = placed(docs)
    found = groups(own.select(F.col("__place").alias("id"), "text"), words, num, den, False)
    gone = found.where("component_id <> id").select(F.col("id").alias("__place"))
    return own.join(gone, "__place", "left_anti").select(*docs.columns)


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for x in frames[1:]:
        out = out.union(x)
    return out


def op1_ngram_join(docs: DataFrame) -> DataFrame:
    return similar_groups(docs, degrees=True)
