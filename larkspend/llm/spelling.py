"""Spelling variants by blocked Gram matrices of letter counts.

One inserted, deleted or replaced letter moves a word's vector of letter counts by a squared distance of at most two. With
the words of two blocks as rows of count matrices X and Y, one product gives all squared distances,
|x|^2 + |y|^2 - 2 X Y^T; the pairs at most two apart are kept and their edits verified letter by letter.

Blocks are by length, and inside a length by how many letters of each of ``groups`` classes of the alphabet a word has.
An edit changes the length by one at most and moves at most one letter from one class to another, so a block
meets itself, blocks of its length with one letter in another class, and blocks of the next length with one letter more:
all others are at a distance above two. The number of classes grows with the logarithm of the number of words, so that a
word is compared with about as many others at any size; classes are balanced by how often letters occur. A block holds at
most ``BLOCK`` words; larger ones are cut into several, which meet each other. Blocks are rows of a table and pairs of blocks
an equi-join on their keys, so no task holds more than the two blocks that it multiplies. Each product returns, for
each word with a near one, the number and the best of them; these are pre-aggregated before they are shuffled.

A word's form is its near word of largest count, if that is ``times`` as frequent; forms of forms are followed by pointer
doubling, and since counts grow tenfold with each step, few rounds are needed.

Defined results: a null, empty or wordless text has no words; a null doc_id hashes as an empty text; repeated rows count each;
equal counts are decided by code points; words of any length are compared whole; an empty table gives an empty
table; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import checkpoint, compact
from ._text import LOWER, blocks

#: Words and bytes of words in one block, at most (one longer word is a block).
BLOCK, BLOCK_BYTES = 1024, 64 << 10
#: Distinct words that a task counts before it passes their counts on.
COUNTED = 200_000
#: Cell keys up to so many are broadcast, to send blocks only to cells that there are.
BROADCAST_CELLS = 1_000_000
#: Letters of candidate pairs that are compared at once.
CELLS = 1 << 22
LEAST_LENGTH, LEAST_COUNT, TIMES, DELETE = 7, 2, 10, 31

_ASCII = np.zeros(256, bool)
_ASCII[[*range(65, 91), *range(97, 123)]] = True


def runs(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte start and end of each maximal run of ``[A-Za-z\\u00C0-\\u00FF]`` and the number of runs before each text.

    In UTF-8 the letters from U+00C0 to U+00FF are the byte C3 and one more."""
    lead = data == 0xC3
    inside = _ASCII[data] | lead
    inside[1:] |= lead[:-1]
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    before, after = np.zeros_like(inside), np.zeros_like(inside)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, at)


def count_words(docs: DataFrame, least_length: int, delete: int) -> DataFrame:
    """word, n: words of at least ``least_length`` letters; every ``delete``-th run by the hash of its document and
    text loses a letter first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()

        def flush() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array([w.decode() for w in found], pa.string()), pa.array(list(found.values()), pa.int64())], ["word", "n"])
            found.clear()
            return made

        crc = zlib.crc32
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for low, _, data, at in blocks(batch.column(1)):
                data = LOWER[data]
                starts, ends, per_doc = runs(data, at)
                # a letter has one byte or two: what can't be long enough goes before it is hashed
                long_enough = ends - starts - np.diff(np.concatenate([[0], np.cumsum(data == 0xC3)])[np.stack([starts, ends])], axis=0)[0] >= least_length
                doc = np.repeat(np.arange(len(at) - 1), np.diff(per_doc))[long_enough]
                heads = [crc(f"{'' if i is None else i}:".encode()) for i in ids[low : low + len(at) - 1]]
                raw, words = data.tobytes(), []
                for a, b, d in zip(starts[long_enough].tolist(), ends[long_enough].tolist(), doc.tolist(), strict=True):
                    word = raw[a:b]
                    h = crc(word, heads[d])
                    if h % delete == 0:
                        text = word.decode()
                        k = h % len(text)
                        if len(text) <= least_length:
                            continue
                        word = (text[:k] + text[k + 1 :]).encode()
                    words.append(word)
                found.update(words)
                if len(found) > COUNTED:
                    yield flush()
        yield flush()

    return docs.select("doc_id", "text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def letter_classes(words: DataFrame, groups: int) -> np.ndarray:
    """The class of each of 256 code points: letters are dealt in order of their frequency to the lightest class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(256, np.int64)
        for batch in batches:
            seen += np.bincount(np.frombuffer("".join(batch.column(0).to_pylist()).encode("latin-1"), np.uint8), minlength=256)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(256), pa.int32()), pa.array(seen)], ["letter", "n"])

    seen = np.zeros(256, np.int64)
    for r in words.select("word").mapInArrow(run, "letter int, n long").groupBy("letter").agg(F.sum("n").alias("n")).collect():
        seen[r["letter"]] = r["n"]
    load, classes = np.zeros(groups), np.zeros(256, np.int64)
    for letter in np.argsort(-seen, kind="stable"):
        classes[letter] = np.argmin(load)
        load[classes[letter]] += seen[letter]
    return classes


def around(cell: tuple[int, ...]) -> list[tuple[int, ...]]:
    """Cells that a cell is compared with: itself, those with one letter more, and of those with one letter in
    another class the ones that follow it in order, so that each pair of cells meets once."""
    found = [cell]
    for a in range(len(cell)):
        more = list(cell)
        more[a] += 1
        found.append(tuple(more))
        for b in range(len(cell)):
            if b != a and more[b]:
                moved = list(more)
                moved[b] -= 1
                if tuple(moved) > cell:
                    found.append(tuple(moved))
    return found


def _name(cell: tuple[int, ...]) -> str:
    return ".".join(map(str, cell))


def word_blocks(words: DataFrame, classes: np.ndarray, groups: int) -> DataFrame:
    """cell, part, around, words (Latin-1, joined by line ends), counts (64-bit): the blocks of each cell, words sorted."""

    def with_cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = [_name(np.bincount(classes[np.frombuffer(w.encode("latin-1"), np.uint8)], minlength=groups)) for w in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(cells, pa.string()), *batch.columns], ["cell", "word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, part, held, counts, size = None, 0, [], [], 0
        out: list[tuple] = []

        def close() -> None:
            if held:
                out.append((now, part, [_name(c) for c in around(tuple(map(int, now.split("."))))], b"\n".join(held), np.array(counts, np.int64).tobytes()))

        def made() -> pa.RecordBatch:
            kinds = (pa.string(), pa.int32(), pa.list_(pa.string()), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], k) for j, k in enumerate(kinds)], ["cell", "part", "around", "words", "counts"])

        for batch in batches:
            for cell, word, n in zip(*(batch.column(j).to_pylist() for j in range(3)), strict=True):
                if cell != now or len(held) >= BLOCK or size >= BLOCK_BYTES:
                    close()
                    part = part + 1 if cell == now else 0
                    now, held, counts, size = cell, [], [], 0
                held.append(word.encode("latin-1"))
                counts.append(n)
                size += len(held[-1]) + 1
            yield made()
            out.clear()
        close()
        yield made()

    placed = words.select("word", "n").mapInArrow(with_cell, "cell string, word string, n long")
    return placed.repartition("cell").sortWithinPartitions("cell", "word").mapInArrow(run, "cell string, part int, around array<string>, words binary, counts binary")


class _Block:
    """The words of a block as padded letters and a matrix of counts."""

    def __init__(self, words: bytes, counts: bytes):
        self.words = words.split(b"\n")
        self.n = np.frombuffer(counts, np.int64)
        self.length = np.array([len(w) for w in self.words])
        flat = np.frombuffer(b"".join(self.words), np.uint8)
        row = np.repeat(np.arange(len(self.words)), self.length)
        self.letters = np.zeros((len(self.words), int(self.length[0])), np.uint8)
        self.letters[row, np.arange(len(flat)) - np.repeat(np.cumsum(self.length) - self.length, self.length)] = flat
        # sums of squares beyond 2^24 are exact in doubles only
        kind = np.float32 if self.length[0] < 2000 else np.float64
        self.counts = np.bincount(row * 256 + flat, minlength=256 * len(self.words)).reshape(-1, 256).astype(kind)


def near_pairs(x: _Block, y: _Block, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs one edit apart, of words of x and of y; of a block with itself each pair once. All words of a cell are
    of one length."""
    used = np.flatnonzero(x.counts.any(0) | y.counts.any(0))
    a, b = x.counts[:, used], y.counts[:, used]
    far = (a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * (a @ b.T)
    i, j = np.nonzero(far <= 2)
    if same:
        i, j = i[i < j], j[i < j]
    keep = np.zeros(len(i), bool)
    width = x.letters.shape[1]
    step = max(1, CELLS // width)
    for low in range(0, len(i), step):
        one, two = x.letters[i[low : low + step]], y.letters[j[low : low + step]]
        if width == two.shape[1]:
            keep[low : low + step] = (one != two).sum(1) == 1
        else:  # y is one longer: what agrees from the left and from the right covers x
            left = np.logical_and.accumulate(one == two[:, :-1], axis=1).sum(1)
            right = np.logical_and.accumulate((one == two[:, 1:])[:, ::-1], axis=1).sum(1)
            keep[low : low + step] = left + right >= width
    return i[keep], j[keep]


def _best(i: np.ndarray, j: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each i: how many j it has, and which of them is the best (words are sorted, so the smaller j is the smaller word)."""
    order = np.lexsort((j, -n[j], i))
    i, j = i[order], j[order]
    first = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]])) if len(i) else np.zeros(0, np.int64)
    return i[first], j[first], np.diff(np.concatenate([first, [len(i)]]))


def compare(pairs: DataFrame) -> DataFrame:
    """word, near, form, form_n of each pair of blocks (left_words, left_counts, words, counts, same)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, forms, near, form_n = [], [], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for lw, lc, rw, rc, same in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                x = _Block(lw, lc)
                y = x if same else _Block(rw, rc)
                i, j = near_pairs(x, y, same)
                sides = [(x, y, np.concatenate([i, j]), np.concatenate([j, i]))] if same else [(x, y, i, j), (y, x, j, i)]
                for own, other, p, q in sides:
                    p, q, many = _best(p, q, other.n)
                    words += [own.words[k].decode("latin-1") for k in p.tolist()]
                    forms += [other.words[k].decode("latin-1") for k in q.tolist()]
                    near.append(many)
                    form_n.append(other.n[q])
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(np.concatenate(near)), pa.array(forms, pa.string()), pa.array(np.concatenate(form_n))], ["word", "near", "form", "form_n"])

    return pairs.mapInArrow(run, "word string, near long, form string, form_n long")


def near_words(words: DataFrame) -> DataFrame:
    """word, n_near, form, form_n: of each word of ``words`` (word, n) with a near one, how many and the most frequent."""
    n = words.count()
    groups = max(2, min(12, round(np.log2(max(n, 2)) / 3)))
    made = checkpoint(word_blocks(words, letter_classes(words, groups), groups))
    cells = made.select("cell").distinct()
    sent = made.select(F.explode("around").alias("to"), F.col("cell").alias("left_cell"), F.col("part").alias("left_part"), F.col("words").alias("left_words"), F.col("counts").alias("left_counts"))
    there = cells.withColumnRenamed("cell", "to")
    sent = sent.join(F.broadcast(there) if cells.count() <= BROADCAST_CELLS else there, "to", "left_semi")
    own = F.col("left_cell") == F.col("cell")
    pairs = sent.join(made.drop("around"), F.col("to") == F.col("cell")).where(~own | (F.col("left_part") <= F.col("part")))
    found = compare(pairs.select("left_words", "left_counts", "words", "counts", (own & (F.col("left_part") == F.col("part"))).alias("same")))
    best = F.min_by(F.struct("form", "form_n"), F.struct(-F.col("form_n"), F.col("form"))).alias("v")
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), best).select("word", "n_near", "v.*")


def roots(forms: DataFrame) -> DataFrame:
    """word, root of ``forms`` (word, form): every round follows as many steps again as were followed before."""
    now = compact(forms.select("word", F.col("form").alias("root")))
    while True:
        # a form is the form of its near words alone, which are few, so no key is hot
        step = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = compact(now.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        now = joined.drop("moved")
        if not joined.where("moved").head(1):
            return now


def variants(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, times: int = TIMES, delete: int = DELETE) -> DataFrame:
    """word, form, root, n, n_near, form_n of each word that occurs at least ``least_count`` times."""
    words = checkpoint(count_words(docs, least_length, delete).where(F.col("n") >= least_count))
    near = words.join(near_words(words), "word", "left")
    enough = F.col("form_n") >= times * F.col("n")
    near = checkpoint(near.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(enough, F.col("form")).alias("form"), F.when(enough, F.col("form_n")).alias("form_n")))
    found = near.join(roots(near.where("form is not null")), "word", "left")
    return found.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling(docs: DataFrame) -> DataFrame:
    return variants(docs)
