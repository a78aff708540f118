"""Scoring texts with a weighted backoff automaton over words.

States are histories seen in training: two words, one word, the start of a text, and the empty history. An arc of a
state for a word, for each n-gram seen in training, carries its smoothed log10 probability and leads to the longest
suffix of the read words that is a state; the empty history has an arc for every word. Where a state has no arc, its
failure arc leads to the state of the shorter history. Probabilities are interpolated, so that failure weights are
exact and each state's probabilities sum to one:

    p(w) = (c(w) + 0.5) / (N + 0.5 (V + 1)),   p(w | h) = (c(hw) + K p(w | h')) / (c(h) + K),

with K = ``BACKOFF[0]`` after one word and ``BACKOFF[1]`` after two; the failure arc of h carries log10(K / (c(h) + K)).
A text is read once from left to right. The state before a word is the longest suffix of the words before it that is a
state, so it is known at every place at once, and failure arcs are followed at all places together.

The automaton is as large as the corpus, so it stays distributed. Documents are dealt into groups of bounded size; a
group sends each distinct n-gram once, with its training count, to the fragment of the key range that owns it; fragments
add the counts up and answer each group with just what it asked for, from which the group builds the part of the
automaton that its texts can reach. A frequent word is one key a group, wherever it occurs: its fragment gets one row of it
from each group that has it, so that one key grows with the number of groups (one row for each 6 MB of text), while all
other sizes of groups and fragments stay as they are.

Defined results: a null or empty text is the end token alone; without training rows N = V = 0 and every base
probability is 1; repeated rows are scored (and counted) each, and dealt to groups one by one; a null doc_id is a
training row; an empty table gives an empty table; extra columns are ignored. Words are compared by 64-bit hashes,
longer n-grams by as many bits as keep chance equality of one with any other below 2 ** -16.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import placed
from ._text import LOWER, blocks, mix, span_hashes, word_spans
from .langid import held_out

BACKOFF = (1000.0, 20.0)
GROUP_BYTES = 6 << 20
#: Keys that one fragment gets from all groups, about.
FRAGMENT_KEYS = 4 << 20
ORDER = 3
START, END = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every token of the texts, each text's end token included, and the n + 1 offsets of the texts."""
    parts, sizes = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)]
    for low, high, data, at in blocks(column):
        data = LOWER[data]
        starts, ends, per_doc = word_spans(data, at)
        out = np.empty(len(starts) + high - low, np.uint64)
        stop = per_doc[1:] + np.arange(high - low)
        words = np.ones(len(out), bool)
        words[stop] = False
        out[stop] = END
        out[words] = span_hashes(data, starts, ends)
        parts.append(out)
        sizes.append(np.diff(per_doc) + 1)
    return np.concatenate(parts), np.cumsum(np.concatenate(sizes))


def ngrams(token: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """Hashes of the words, word pairs and word triples that end at each place. A text's first word is in a pair with the
    start; the triple there is that pair once more."""
    found, first = [token], at[:-1]
    for n in range(2, ORDER + 1):
        history = np.empty_like(token)
        history[1:] = found[-1][:-1]
        history[first] = START if n == 2 else 0
        longer = mix(history * np.uint64(0x9FB21C651E98DF25) + (token ^ (token >> np.uint64(29))))
        if n > 2:
            longer[first] = found[-1][first]
        found.append(longer)
    return found


def key_bits(n_tokens: int) -> list[int]:
    """Bits of the keys of each order."""
    return [64] + [min(64, max(1, n_tokens).bit_length() + 16)] * (ORDER - 1)


def pack_keys(keys: np.ndarray, base: int) -> bytes:
    """Sorted keys as differences, the first from ``base``: one plane for each byte that any of them needs."""
    steps = np.diff(keys, prepend=np.uint64(base))
    width = max(1, -(-int(steps.max(initial=0)).bit_length() // 8))
    return bytes([width]) + np.ascontiguousarray(steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def unpack_keys(data: bytes, base: int) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8, offset=1).reshape(data[0], -1)
    wide = np.zeros((planes.shape[1], 8), np.uint8)
    wide[:, : data[0]] = planes.T
    return np.cumsum(wide.view("<u8").ravel(), dtype=np.uint64) + np.uint64(base)


def pack_counts(counts: np.ndarray) -> bytes:
    """A byte each, and after them the few counts of 255 or more."""
    large = counts[counts >= 255].astype("<i8")
    return len(large).to_bytes(8, "little") + large.tobytes() + np.minimum(counts, 255).astype(np.uint8).tobytes()


def unpack_counts(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    counts = np.frombuffer(data, np.uint8, offset=8 + 8 * n).astype(np.int64)
    counts[counts == 255] = np.frombuffer(data, "<i8", n, 8)
    return counts


def _squeeze(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(data, asbytes=True)


def _stretch(data: bytes) -> bytes:
    return pa.Codec("zstd").decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True)


def fragment_base(fragment: int, fragments: int, bits: int) -> int:
    return fragment * ((1 << bits) // fragments)


def cut(keys: np.ndarray, fragments: int, bits: int) -> list[tuple[int, int, int]]:
    """(fragment, first, end) of the fragments that sorted keys of so many bits fall into."""
    own = np.minimum(keys // np.uint64((1 << bits) // fragments), np.uint64(fragments - 1)).astype(np.int64)
    first = np.flatnonzero(np.diff(own, prepend=-1))
    return list(zip(own[first].tolist(), first.tolist(), [*first[1:].tolist(), len(keys)], strict=True)) if len(keys) else []


def _table(rows: list[tuple], names: str) -> dict:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    return {n: pa.array([r[i] for r in rows], kinds[k]) for i, (n, k) in enumerate(x.split() for x in names.split(", "))}


_PART = "fragment long, keys binary, n long, tokens long"


def training_size(docs: DataFrame, fragments: int) -> tuple[int, int, int]:
    """N, the tokens of training texts; V, the distinct ones; and the tokens of all texts. Each batch sends each of its
    training words once; each fragment sends back three numbers."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 5000):
                part = batch.slice(low, 5000)
                token, at = tokens(part.column(0))
                train = np.repeat(part.column(1).to_numpy(zero_copy_only=False).astype(bool), np.diff(at))
                keys = np.unique(token[train])
                rows = [(f, _squeeze(pack_keys(keys[a:b], fragment_base(f, fragments, 64))), 0, 0) for f, a, b in cut(keys, fragments, 64)]
                rows.append((low % fragments, b"", int(train.sum()), len(token)))
                yield pa.RecordBatch.from_pydict(_table(rows, _PART))

    def distinct(table: pa.Table) -> pa.Table:
        base = fragment_base(table["fragment"][0].as_py(), fragments, 64)
        keys = np.concatenate([np.zeros(0, np.uint64), *(unpack_keys(_stretch(x), base) for x in table["keys"].to_pylist() if x)])
        return pa.table({"v": [len(np.unique(keys))]} | {x: [pa.compute.sum(table[x]).as_py() or 0] for x in ("n", "tokens")})

    parts = docs.select("text", ~held_out(5, 1)).mapInArrow(count, _PART)
    total = parts.groupBy("fragment").applyInArrow(distinct, "v long, n long, tokens long")
    return tuple(total.agg(*(F.coalesce(F.sum(x), F.lit(0)) for x in ("n", "v", "tokens"))).first())


_REQUEST = "kind int, fragment long, g long, keys binary, counts binary"


def requests(owner: int, found: list[np.ndarray], train: np.ndarray, fragments: int, bits: list[int]) -> list[tuple]:
    """What a group asks of every fragment: its distinct keys and their counts in its own training texts."""
    rows = []
    for kind, (own, width) in enumerate(zip(found, bits, strict=True)):
        keys, index = np.unique(own >> np.uint64(64 - width), return_inverse=True)
        counts = np.bincount(index, train, len(keys)).astype(np.int64)
        rows += [(kind, f, owner, _squeeze(pack_keys(keys[a:b], fragment_base(f, fragments, width))), pack_counts(counts[a:b])) for f, a, b in cut(keys, fragments, width)]
    return rows


def add_up(table: pa.Table, fragments: int, bits: list[int]) -> pa.Table:
    """One fragment: the total count of each key, as an answer to each group's request."""
    width = bits[table["kind"][0].as_py()]
    base = fragment_base(table["fragment"][0].as_py(), fragments, width)
    blobs = [unpack_keys(_stretch(x), base) for x in table["keys"].to_pylist()]
    ends = np.cumsum([len(x) for x in blobs])
    _, index = np.unique(np.concatenate(blobs), return_inverse=True)
    counts = np.concatenate([unpack_counts(x) for x in table["counts"].to_pylist()])
    total = np.bincount(index, counts).astype(np.int64)[index]
    return pa.table({"kind": table["kind"], "fragment": table["fragment"], "g": table["g"], "counts": pa.array([pack_counts(x) for x in np.split(total, ends[:-1])], pa.binary())})


@dataclass
class Automaton:
    """Arcs sorted by ``state * words + word``; a failure arc for each state but the empty history, which is 0."""

    words: int
    arc: np.ndarray
    weight: np.ndarray
    target: np.ndarray
    fail_weight: np.ndarray
    fail_target: np.ndarray

    def read(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log10 probability of each word in the state before it, and the state after it."""
        total, after, state = np.zeros(len(word)), np.empty(len(word), np.int64), state.copy()
        todo = np.arange(len(word))
        while len(todo):
            key = state[todo] * self.words + word[todo]
            at = np.minimum(np.searchsorted(self.arc, key), len(self.arc) - 1)
            hit = self.arc[at] == key
            total[todo[hit]] += self.weight[at[hit]]
            after[todo[hit]] = self.target[at[hit]]
            todo = todo[~hit]
            total[todo] += self.fail_weight[state[todo]]
            state[todo] = self.fail_target[state[todo]]
        return total, after


def automaton(found: list[np.ndarray], at: np.ndarray, counts: list[np.ndarray], n: int, v: int, backoff: tuple[float, float]) -> tuple[Automaton, np.ndarray, np.ndarray]:
    """The part of the automaton that some texts reach, the state before each of their places, and each place's word.

    ``found`` are the n-grams that end at each place, ``counts`` the training counts of the distinct ones, sorted. States
    are numbered: the empty history, the start, the words, the word pairs."""
    k1, k2 = backoff
    (_, word), (_, pair_at, pair), (_, triple_at, triple) = np.unique(found[0], return_inverse=True), *(np.unique(x, return_index=True, return_inverse=True) for x in found[1:])
    c1, c2, c3 = counts
    first = np.zeros(len(word), bool)
    first[at[:-1]] = True
    texts = c1[word[at[1] - 1]]  # as many training texts as ends
    m = len(c1)
    word_state, pair_state = np.where(c1 > 0, 2 + np.arange(m), 0), 2 + m + np.arange(len(c2))
    start = 1 if texts else 0
    after = np.where(c2[pair] > 0, pair_state[pair], word_state[word])
    before = np.empty_like(after)
    before[1:] = after[:-1]
    before[first] = start

    unigram = (c1 + 0.5) / (n + 0.5 * (v + 1))
    # the word before each distinct pair, -1 for the start, and how often it was seen
    old = np.where(first[pair_at], -1, word[pair_at - 1])
    seen = np.where(old < 0, texts, c1[old])
    bigram = (c2 + k1 * unigram[word[pair_at]]) / (seen + k1)
    triple_at = triple_at[~first[triple_at]]
    c3 = c3[triple[triple_at]]
    history, last = pair[triple_at - 1], pair[triple_at]
    trigram = (c3 + k2 * bigram[last]) / (c2[history] + k2)

    two, three = c2 > 0, c3 > 0
    arcs = np.concatenate([np.arange(m), np.where(old < 0, 1, 2 + old)[two] * m + word[pair_at][two], pair_state[history[three]] * m + word[triple_at][three]])
    weight = np.log10(np.concatenate([unigram, bigram[two], trigram[three]]))
    target = np.concatenate([word_state, pair_state[two], pair_state[last[three]]])
    order = np.argsort(arcs)
    fail = np.concatenate([[1.0, k1 / (texts + k1)], k1 / (c1 + k1), k2 / (c2 + k2)])
    fail_target = np.concatenate([np.zeros(2 + m, np.int64), word_state[word[pair_at]]])
    return Automaton(m, arcs[order], weight[order], target[order], np.log10(fail), fail_target), before, word


_RESULT = "held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(docs: DataFrame, backoff: tuple[float, float] = BACKOFF) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    docs, _ = placed(docs.select("doc_id", "text"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n_bytes = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    groups = max(1, -(-n_bytes // GROUP_BYTES))
    n, v, n_tokens = training_size(docs, max(parts, -(-n_bytes // (8 * FRAGMENT_KEYS))))
    bits, fragments = key_bits(n_tokens), max(parts, -(-n_tokens // FRAGMENT_KEYS))
    dealt = docs.select("doc_id", "text", held_out(5, 1).alias("held_out"), F.pmod(F.xxhash64("__place"), F.lit(groups)).alias("g"))

    def ask(table: pa.Table) -> pa.Table:
        token, at = tokens(table["text"].combine_chunks())
        train = np.repeat(~table["held_out"].to_numpy().astype(bool), np.diff(at))
        return pa.table(_table(requests(table["g"][0].as_py(), ngrams(token, at), train, fragments, bits), _REQUEST))

    def read(table: pa.Table, answers: pa.Table) -> pa.Table:
        names = ("n_tokens", "n_known", "train_tokens", "base_score", "score")
        if not table.num_rows:
            return pa.table({"doc_id": table["doc_id"], "held_out": table["held_out"]} | {x: pa.array([], pa.float64() if "score" in x else pa.int64()) for x in names})
        token, at = tokens(table["text"].combine_chunks())
        found = [x >> np.uint64(64 - b) for x, b in zip(ngrams(token, at), bits, strict=True)]
        order = sorted(zip(answers["kind"].to_pylist(), answers["fragment"].to_pylist(), answers["counts"].to_pylist(), strict=True))
        counts = [np.concatenate([unpack_counts(c) for k, _, c in order if k == kind]) for kind in range(ORDER)]
        model, before, word = automaton(found, at, counts, n, v, backoff)
        known = counts[0][word]
        base = np.log10((known + 0.5) / (n + 0.5 * (v + 1)))
        each = lambda x: np.add.reduceat(x, at[:-1])
        values = (np.diff(at), each((known > 0).astype(np.int64)), np.full(len(at) - 1, n, np.int64), each(base), each(model.read(before, word)[0]))
        return pa.table({"doc_id": table["doc_id"], "held_out": table["held_out"]} | dict(zip(names, map(pa.array, values), strict=True)))

    asked = dealt.groupBy("g").applyInArrow(ask, _REQUEST)
    answers = asked.groupBy("kind", "fragment").applyInArrow(lambda table: add_up(table, fragments, bits), "kind int, fragment long, g long, counts binary")
    return dealt.groupBy("g").cogroup(answers.groupBy("g")).applyInArrow(read, f"doc_id {kind}, {_RESULT}")


def op7_lm(docs: DataFrame) -> DataFrame:
    return score(docs)
