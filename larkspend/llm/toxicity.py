"""Toxicity after noisy-channel deobfuscation.

Words that look disguised (leetspeak, symbols inside, long repetitions, letters set apart) become lattices of characters;
a Viterbi search under a character trigram model, counted over all texts, finds the likeliest restored spelling. Signs
between letters may be dropped or end a word, so the search also says which words a joined or spaced spelling holds. A
word with one or no letter is restored if all its other signs can stand for letters, unless it is a number. Neither words
nor runs of set-apart letters have a longest length: the search is linear in it. A
logistic regression over restored words and their beginnings, trained on labelled rows, scores the document.

Defined results: a null text is empty and gets the score of a text without any feature; rows are scored one by one, so
repeated rows repeat their results; a doc_id with several labels counts as toxic if any label does; null labels are
ignored; without labels of both classes every score is the smoothed share of toxic labels; an empty table gives an empty
table; a null doc_id is not held out; extra columns don't reach the result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from ._store import checkpoint
from .langid import held_out

#: Bound of the classifier's training sample, in labelled rows, and of its features.
TRAIN_ROWS = 20_000
MAX_FEATURES = 20_000
CACHE_WORDS = 300_000

LETTERS = "abcdefghijklmnopqrstuvwxyzàáâäæçèéêëíîïñóôöùúûüßœ"
CLASS = {c: i + 1 for i, c in enumerate(LETTERS)}
OTHER = len(LETTERS) + 1  # letters of no class of their own
CLASSES = OTHER + 1  # 0: whatever isn't a letter
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "li", "+": "t", "€": "e", "(": "c"}
COST_LEET, COST_DROP, COST_REPEAT = 1.0, 6.0, 0.5
#: What it costs that a sign between letters is dropped or ends a word: where letters stand alone or in pairs on both
#: sides, and beside LONG or more letters; and that a gap between letters set apart ends one.
COST_SIGN, COST_LONG, COST_APART = (0.5, 1.0), (1.0, 0.0), 2.0
LONG = 3

_EDGE = re.compile(r"^[^\w$@!|+(€]+|[^\w$@!]+$")
_SPACED = re.compile(r"(?<!\w)\w(?:[ .\-_*]\w){2,}(?!\w)")
# a cheap look at the bytes before the search above: three single signs in a row
_SINGLES = re.compile(rb"(?<![\w\x80-\xff])[\w\x80-\xff]{1,2}[ .\-_*][\w\x80-\xff]{1,2}[ .\-_*][\w\x80-\xff]{1,2}(?![\w\x80-\xff])")
_LETTERS = re.compile(r"[^\W\d_]+")
_LONG = re.compile(r"(.)\1\1")


def _class_table() -> np.ndarray:
    table = np.zeros(0x3000, np.uint8)
    for cp in range(0x3000):
        c = chr(cp)
        if c.isalpha():
            table[cp] = CLASS.get(c.lower(), OTHER)
    return table


def trigram_counts(docs: DataFrame) -> np.ndarray:
    """Counts of character triples over all texts: each task sums its own, Spark sums the tasks' non-empty cells, and
    the driver gets at most CLASSES ** 3 numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _class_table()
        total = np.zeros(CLASSES**3, np.int64)
        for batch in batches:
            column = batch.column(0).fill_null("")
            for low in range(0, len(column), 128):
                joined = "\n\n".join(["", *column.slice(low, 128).to_pylist(), ""])
                code = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
                c = np.where(code < len(table), table[np.minimum(code, len(table) - 1)], OTHER).astype(np.int32)
                total += np.bincount((c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:], minlength=CLASSES**3)
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cells.astype(np.int32)), pa.array(total[cells])], ["cell", "n"])

    cells = docs.select("text").mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(CLASSES**3)
    counts[cells["cell"].to_numpy(np.int64)] = cells["n"].to_numpy(float)
    return counts.reshape(CLASSES, CLASSES, CLASSES)


def trigram_model(counts: np.ndarray) -> np.ndarray:
    """log P(c | a, b), interpolated with shorter histories."""
    one = counts.sum((0, 1)) + 1.0
    two = counts.sum(0)
    p1 = one / one.sum()
    p2 = (two + 5 * p1) / (two.sum(1, keepdims=True) + 5)
    p3 = (counts + 5 * p2[None]) / (counts.sum(2, keepdims=True) + 5)
    return np.log(p3)


def decode(lattice: list[list[tuple[str, float]]], model: np.ndarray) -> tuple[str, float]:
    """Viterbi: the likeliest string through the lattice's positions, each a list of (string, cost), and its score. All
    states are kept: there is one at most for each pair of character classes."""
    # pieces are linked backwards, so that long words take time in proportion to their length
    best: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    for options in lattice:
        new: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (score, text) in best.items():
            for piece, cost in options:
                s, x, y = score - cost, a, b
                for c in piece:
                    k = 0 if c == " " else CLASS.get(c, OTHER)
                    s += model[x, y, k]
                    x, y = y, k
                if (x, y) not in new or s > new[x, y][0]:
                    new[x, y] = (s, (text, piece))
        best = new
    ends = [(s + model[a, b, 0], t) for (a, b), (s, t) in best.items()]
    score = max(s for s, _ in ends)
    return max(_joined(t) for s, t in ends if s == score), float(score)


def _joined(link: tuple | None) -> str:
    pieces = []
    while link:
        link, piece = link
        pieces.append(piece)
    return "".join(reversed(pieces))


def lattice_of(word: str) -> list[list[tuple[str, float]]]:
    """One position for each run of equal characters: kept, mapped, shortened, dropped or, inside, the end of a word."""
    out = []
    beside = {x for m in _LETTERS.finditer(word) if m.end() - m.start() >= LONG for x in m.span()}
    for m in re.finditer(r"(.)\1*", word, re.S):
        c, n = m[1], len(m[0])
        if c.isalpha():
            # a run may stand for one or two letters
            out.append([(c, 0.0 if n == 1 else COST_REPEAT)] + ([(c * 2, 0.0 if n == 2 else COST_REPEAT)] if n > 1 else []))
        else:
            mapped = [(x * k, COST_LEET + (0.0 if n == k else COST_REPEAT)) for x in LEET.get(c, "") for k in ((1, 2) if n > 1 else (1,))]
            drop, end = COST_LONG if m.end() in beside or m.start() in beside else COST_SIGN
            inside = 0 < m.start() and m.end() < len(word)
            if inside and word[m.start() - 1].isalpha() and word[m.start() - 1] not in CLASS and c not in LEET:
                out.append([(" ", 0.0)])  # the model knows nothing of such letters
                continue
            out.append(mapped + [("", COST_DROP if c in LEET else drop)] + ([(" ", end)] if inside and not c.isdigit() else []))
    return out


def restore(word: str, model: np.ndarray) -> list[str]:
    """The words that a lower-case word without white space stands for; an ordinary one comes back at once, stripped of
    the signs around it."""
    bare = _EDGE.sub("", word)
    if bare.isalpha():
        return decode(lattice_of(bare), model)[0].split() if _LONG.search(bare) else [bare]
    core = bare.strip("!?.,;:-_'\"()[]*")
    if core.isalpha() and not bare.startswith(("$", "@")):
        return restore(core, model) if core != word else [core]
    if bare.isdigit() or sum(map(str.isalpha, bare)) < 2 and not all(c in LEET or c.isalpha() for c in bare):
        return []
    return decode(lattice_of(bare), model)[0].split()


def features_of(word: str) -> list[str]:
    """The word and its beginnings, which inflected forms share."""
    return [word, *(f"{word[:n]}~" for n in (4, 5) if len(word) > n)] if len(word) > 2 else []


class Reader:
    """Words of texts, restored, with what ``value`` keeps of each one cached."""

    def __init__(self, model: np.ndarray, value):
        self.model, self.value = model, value
        self.cache: dict[bytes, frozenset] = {}

    def __call__(self, text: bytes | None) -> set:
        """``text`` is UTF-8; the white space that splits bytes is just that which separates words."""
        if not text:
            return set()
        low = text.lower()
        words = set(low.split())
        if _SINGLES.search(low):
            words.update(found.encode() for m in _SPACED.finditer(text.decode().lower()) for found in self.joined(m[0]))
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        cache = self.cache
        for w in words.difference(cache):
            cache[w] = frozenset().union(*map(self.value, restore(w.decode().lower(), self.model)))
        return set().union(*map(cache.__getitem__, words))

    def joined(self, spaced: str) -> list[str]:
        """Letters set apart, read as words where the model likes that better than single letters."""
        letters = [c for c in spaced if c.isalnum()]
        lattice = lattice_of(letters[0])
        for c in letters[1:]:
            lattice += [[("", 0.0), (" ", COST_APART)], *lattice_of(c)]
        text, score = decode(lattice, self.model)
        apart = sum(self.model[0, 0, k := CLASS.get(c, OTHER if c.isalpha() else 0)] + self.model[0, k, 0] for c in letters)
        return text.split() if score > apart else []


def labelled(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """text, toxic of at most ``rows`` labelled rows that aren't held out, chosen by a hash of the id."""
    train = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(5, 0)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    # ids only; ``rows`` bounds what is broadcast
    train = train.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    joined = docs.select("doc_id", "text").join(F.broadcast(train.withColumnRenamed("doc_id", "__id")), F.col("doc_id") == F.col("__id"))
    # of rows that share an id one trains, so that ``rows`` bounds texts too
    return joined.groupBy("doc_id").agg(F.min_by(F.struct("text", "toxic"), F.xxhash64("text")).alias("v")).select("v.text", "v.toxic")


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> tuple[np.ndarray, dict[str, float], float]:
    """The character model, the weight of each feature, and the intercept."""
    model = trigram_model(trigram_counts(docs))
    train = checkpoint(labelled(docs, labels, rows))

    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = Reader(model, lambda w: frozenset(features_of(w)))
        for batch in batches:
            for low in range(0, batch.num_rows, 64):
                texts = batch.column(0).slice(low, 64).cast(pa.binary()).to_pylist()
                got = [sorted(read(x)) for x in texts]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f for x in got for f in x], pa.string()), pa.array([y for x, y in zip(got, batch.column(1).slice(low, 64).to_pylist(), strict=True) for _ in x], pa.int32())], ["feature", "toxic"]
                )

    size = train.groupBy("toxic").count().collect()
    n = {y: sum(r["count"] for r in size if bool(r["toxic"]) == y) for y in (0, 1)}
    share = (n[1] + 0.5) / (sum(n.values()) + 1)
    if not n[0] or not n[1]:
        return model, {}, math.log(share / (1 - share))
    counts = train.mapInArrow(names, "feature string, toxic int").groupBy("feature").agg(F.sum(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("bad"), F.sum(F.when(F.col("toxic") > 0, 0).otherwise(1)).alias("good"))
    # how surprising the feature's labels are, in nats, if it said nothing: keeps chance out of many rare words
    both, p = F.col("bad") + F.col("good"), n[1] / (n[0] + n[1])
    surprise = F.col("bad") * F.log(F.col("bad") / (both * p)) + F.when(F.col("good") > 0, F.col("good") * F.log(F.col("good") / (both * (1 - p)))).otherwise(0.0)
    lift = F.log((F.col("bad") + 0.5) / (n[1] + 1)) - F.log((F.col("good") + 0.5) / (n[0] + 1))
    chosen = counts.where(F.col("bad") >= 3).withColumn("lift", lift).where((F.col("lift") > 1.0) & (surprise >= 9)).orderBy(F.desc(F.col("lift") * F.sqrt("bad")), "feature").limit(MAX_FEATURES).collect()
    index = {r["feature"]: i for i, r in enumerate(chosen)}

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = Reader(model, lambda w: frozenset(index[f] for f in features_of(w) if f in index))
        for batch in batches:
            got = [sorted(read(x)) for x in batch.column(0).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(got, pa.list_(pa.int32())), batch.column(1)], ["own", "toxic"])

    data = Counter((tuple(r["own"]), int(r["toxic"] > 0)) for r in train.mapInArrow(present, "own array<int>, toxic int").collect())
    keys = sorted(data)
    weight = np.array([data[k] for k in keys], float)
    goal = np.array([k[1] for k in keys], float)
    row = np.repeat(np.arange(len(keys)), [len(k[0]) for k in keys])
    col = np.array([i for k in keys for i in k[0]], int)
    # weights start at each feature's share of the evidence; the penalty draws them back there
    start = np.array([min(4.0, r["lift"]) for r in chosen]) * 0.5
    w, b = start.copy(), math.log(n[1] / n[0]) - 0.5
    per = np.bincount(col, weight[row], len(w)) if len(col) else np.zeros(len(w))
    for _ in range(300):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, w[col], len(keys)) + b, -30, 30))) if len(col) else np.full(len(keys), share)
        err = weight * (goal - p)
        w += 0.5 * (np.bincount(col, err[row], len(w)) - 0.5 * (w - start)) / (0.25 * 4 * per + 1)
        b += 2 * err.sum() / weight.sum()
    return model, {r["feature"]: float(w[i]) for i, r in enumerate(chosen)}, float(b)


def score(docs: DataFrame, model: np.ndarray, weights: dict[str, float], intercept: float, restored: bool = False) -> DataFrame:
    """Adds ``score`` to ``docs`` (and ``restored_words``: the words that count, as read); replaces such columns."""
    names = [x for x in docs.columns if x not in ("score", "restored_words")]
    where = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = Reader(model, lambda w: frozenset(f for f in features_of(w) if f in weights))
        for batch in batches:
            scores, words = [], []
            for low in range(0, batch.num_rows, 256):
                for text in batch.column(where).slice(low, 256).cast(pa.binary()).to_pylist():
                    own = read(text)
                    x = intercept + math.fsum(weights[f] for f in own)
                    scores.append(1 / (1 + math.exp(-max(-30.0, min(30.0, x)))))
                    if restored:
                        words.append(sorted(f for f in own if f[-1] != "~"))
            more = [pa.array(words, pa.list_(pa.string()))] if restored else []
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64()), *more], [*names, "score", *(["restored_words"] if restored else [])])

    kept = docs.select(*names)
    schema = StructType(list(kept.schema.fields)).add("score", "double")
    if restored:
        schema = schema.add("restored_words", ArrayType(StringType()))
    return kept.mapInArrow(run, schema)


def op10_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    docs = docs.select("doc_id", "text")
    got = score(docs, *fit(docs, labels.select("doc_id", "toxic")))
    return got.select("doc_id", held_out(5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
