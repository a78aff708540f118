"""Order-preserving packing of tokenised documents into fixed windows by dynamic programming.

Documents are taken in the order of their rows, partition by partition, without a shuffle, in runs of bounded length.
In each run, windows are cut where padding plus penalties are least: at document ends (free), at sentence ends
(``sentence_penalty``), or every sixteenth of a window inside a sentence that is longer than one (``cut_penalty``). With positions p of possible
cuts, best[j] = penalty[j] + min over i with 0 < p[j] - p[i] <= window of best[i] + padding(p[j] - p[i]); since padding
is window - (p[j] - p[i]), the minimum runs over best[i] + p[i] in a sliding window, which a monotone queue gives in
constant time. Lengths that are powers of two need no padding and are tried beside it.

Defined results: a null text is empty and yields its end id alone; an empty table yields no rows; repeated rows are
packed each on their own; a null doc_id stays null; extra columns are ignored. A text longer than a window is cut into
several pieces, whatever its length.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from ._text import LOWER, blocks, span_hashes, word_spans

WINDOW = 2048
END_ID = 1
#: A run is closed after so many ids, and ends a sequence; what it holds in memory doesn't grow with the table.
RUN_TOKENS = 1 << 19
#: Texts are looked up in blocks of about so many bytes, and so many words are remembered.
BLOCK_BYTES = 1 << 18
CACHE_WORDS = 400_000
#: What special tokens begin with; they are told by their case, so words that hold it keep theirs.
SPECIAL = b"<|"
#: Words that the tokenizer's normaliser and pattern leave in one piece (its lower-casing is done here).
_LATIN = re.compile(rb"(?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+").fullmatch
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


_SIGN = np.zeros(256, bool)
_SIGN[list(b".,!?;:|#*$%&<")] = True  # not ">", with which special tokens end
_LETTER = np.zeros(256, bool)
_LETTER[list(b"abcdefghijklmnopqrstuvwxyz")] = True


def pieces(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of bytes whose ids don't depend on each other, and how many stand before each text (n + 1 values): words,
    without up to four signs at the end of a Latin letter, which are a span of their own."""
    starts, ends, per_doc = word_spans(data, at)
    tail = np.zeros(len(starts), np.int64)
    for j in range(1, 6):
        more = (tail == j - 1) & (ends - starts > j)
        more[more] = _SIGN[data[ends[more] - j]]
        tail[more] = j
    tail[tail > 4] = 0
    core = ends - tail
    last = data[core - 1]
    latin = (last >= 0x80) & (core - starts > 1)
    latin[latin] = (data[core[latin] - 2] == 0xC3) & (last[latin] != 0x97) & (last[latin] != 0xB7)
    cut = (tail > 0) & (_LETTER[last] | latin)
    before = np.concatenate([[0], np.cumsum(cut)])
    place = np.arange(len(starts)) + before[:-1]
    out = np.empty((2, len(starts) + before[-1]), np.int64)
    out[0, place], out[1, place] = starts, np.where(cut, core, ends)
    out[0, place[cut] + 1], out[1, place[cut] + 1] = core[cut], ends[cut]
    return out[0], out[1], per_doc + before[per_doc]


class WordIds:
    """Ids of texts, word by word: this vocabulary's tokens never span white space, so words can be cached.

    Words are looked up by 64-bit hash in an open-addressing table of arrays, all words of a block at once. New words
    of Latin letters are encoded many at a time, by the tokenizer's own model without the normaliser and pattern, which
    change nothing in them; each of them ends with an end-of-word id. Other words are encoded one by one.
    """

    def __init__(self, path: str, end_id: int = END_ID):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            plain = json.load(file)
        level = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
        plain |= {"normalizer": None, "added_tokens": [], "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, level]}}
        self.plain = Tokenizer.from_str(json.dumps(plain))
        del plain
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for k, i in vocabulary.items() if k.endswith("</w>")]] = True
        self.end = np.array([end_id], np.uint32)
        self.clear()

    def clear(self, room: int = 0) -> None:
        """Empty tables, with room for so many words at least. Word 0 is the end of a text."""
        most = max(CACHE_WORDS, room)
        self.slots = np.zeros(1 << (2 * most - 1).bit_length(), np.uint64)
        self.word = np.zeros(len(self.slots), np.int32)
        self.count, self.used = 1, 1
        self.flat = np.zeros(1 << 20, np.uint32)
        self.flat[:1] = self.end
        self.start = np.zeros(most + BLOCK_BYTES, np.int64)
        self.size = np.ones(len(self.start), np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Number of the word of each hash, or -1."""
        mask = np.uint64(len(self.slots) - 1)
        out = np.full(len(h), -1, np.int64)
        at, rest = (h & mask).astype(np.int64), None
        while True:
            there = self.slots[at]
            mine = h if rest is None else h[rest]
            hit = there == mine
            found = self.word[at[hit]]
            if rest is None:
                out[hit] = found
            else:
                out[rest[hit]] = found
            go = ~hit & (there != 0)
            if not go.any():
                return out
            rest = np.flatnonzero(go) if rest is None else rest[go]
            at = (at[go] + 1) & int(mask)

    def add(self, h: np.ndarray, ids: list[bytes]) -> None:
        """New words by hash with their ids."""
        new = np.frombuffer(b"".join(ids), "<u4")
        while self.used + len(new) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        low = self.count
        self.flat[self.used : self.used + len(new)] = new
        self.size[low : low + len(ids)] = sizes
        self.start[low : low + len(ids)] = self.used + np.cumsum(sizes) - sizes
        self.count, self.used = low + len(ids), self.used + len(new)
        number = np.arange(low, self.count)
        mask = len(self.slots) - 1
        at = (h & np.uint64(mask)).astype(np.int64)
        while len(h):
            free = self.slots[at] == 0
            self.slots[at[free]] = h[free]
            won = free & (self.slots[at] == h)
            self.word[at[won]] = number[won]
            h, number, at = h[~won], number[~won], (at[~won] + 1) & mask

    def encode(self, words: list[bytes]) -> list[bytes]:
        """Little-endian uint32 ids of each word."""
        found: dict[int, bytes] = {}
        good = [i for i, w in enumerate(words) if _LATIN(w)]
        lines = [good[i : i + 200] for i in range(0, len(good), 200)]
        for line in lines:
            got = self.plain.encode_batch_fast([b" ".join([words[i] for i in line]).decode().lower()], add_special_tokens=False)[0]
            ids = np.array(got.ids, "<u4")
            stops = (4 * (np.flatnonzero(self.last[ids]) + 1)).tolist()
            if len(stops) == len(line):
                data = ids.tobytes()
                found.update(zip(line, map(data.__getitem__, map(slice, [0, *stops], stops)), strict=True))
        return [found[i] if i in found else np.array(self.tokenizer.encode(w.decode(), add_special_tokens=False).ids, "<u4").tobytes() for i, w in enumerate(words)]

    def __call__(self, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first row, end row, ids of all texts with their ends, their lengths) of blocks of texts."""
        for low, high, data, at in blocks(column, BLOCK_BYTES):
            raw, data = data, LOWER[data]
            starts, ends, per_doc = pieces(data, at)
            for place in np.flatnonzero((raw[:-1] == SPECIAL[0]) & (raw[1:] == SPECIAL[1])).tolist():
                own = int(np.searchsorted(starts, place, "right")) - 1
                data[starts[own] : ends[own]] = raw[starts[own] : ends[own]]
            h = span_hashes(data, starts, ends)
            h[h == 0] = 1
            number = self.find(h)
            if (number < 0).any():
                if self.count + len(h) >= len(self.start):
                    self.clear(len(h))
                    number[:] = -1
                miss = np.flatnonzero(number < 0)
                new, first = np.unique(h[miss], return_index=True)
                whole = data.tobytes()
                self.add(new, self.encode([whole[a:b] for a, b in zip(starts[miss[first]].tolist(), ends[miss[first]].tolist(), strict=True)]))
                number[miss] = self.find(h[miss])
            words = np.zeros(len(h) + high - low, np.int64)
            inside = np.ones(len(words), bool)
            stop = per_doc[1:] + np.arange(high - low)
            inside[stop] = False
            words[inside] = number
            sizes = self.size[words]
            total = np.concatenate([[0], np.cumsum(sizes)])
            flat = self.flat[np.repeat(self.start[words] - total[:-1], sizes) + np.arange(total[-1])]
            yield low, high, flat, np.diff(np.concatenate([[0], total[stop + 1]]))

    def ends(self) -> np.ndarray:
        """Ids that end a sentence."""
        return np.array([i for i in map(self.tokenizer.token_to_id, (".</w>", "!</w>", "?</w>")) if i is not None], np.uint32)


def cut_points(lengths: np.ndarray, sentence_ends: np.ndarray, window: int, sentence_penalty: int, cut_penalty: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions where a sequence may end, from 0 to the run's end, and the penalty of each."""
    ends = np.cumsum(lengths)
    at = np.union1d(np.concatenate([[0], ends]), sentence_ends)
    step = max(1, window // 16)
    hard = np.concatenate([np.zeros(0, np.int64), *(np.arange(at[g] + step, at[g + 1], step) for g in np.flatnonzero(np.diff(at) > window))])
    points = np.concatenate([at, hard])
    cost = np.concatenate([np.where(np.isin(at, ends) | (at == 0), 0, sentence_penalty), np.full(len(hard), cut_penalty)])
    order = np.argsort(points, kind="stable")
    return points[order], cost[order]


def best_cuts(points: np.ndarray, cost: np.ndarray, window: int) -> np.ndarray:
    """Positions of the cuts of least total cost, first 0 and last the end."""
    n = len(points)
    exact: list[list[int]] = [[] for _ in range(n)]
    for k in range(window.bit_length()):
        back = np.searchsorted(points, points - (1 << k))
        for j in np.flatnonzero(points[np.minimum(back, n - 1)] == points - (1 << k)).tolist():
            exact[j].append(int(back[j]))
    p, c = points.tolist(), cost.tolist()
    best, since = [0] * n, [0] * n
    queue: deque[int] = deque()
    for j in range(1, n):
        i = j - 1
        mine = best[i] + p[i]
        while queue and best[queue[-1]] + p[queue[-1]] >= mine:
            queue.pop()
        queue.append(i)
        while p[j] - p[queue[0]] > window:
            queue.popleft()
        i = queue[0]
        least = best[i] + window - (p[j] - p[i])
        for e in exact[j]:
            if best[e] < least:
                least, i = best[e], e
        best[j], since[j] = least + c[j], i
    cuts = [n - 1]
    while cuts[-1]:
        cuts.append(since[cuts[-1]])
    return points[cuts[::-1]]


def pack(docs: DataFrame, path: str | None = None, window: int = WINDOW, end_id: int = END_ID, sentence_penalty: int = 8, cut_penalty: int = 48, run_tokens: int = RUN_TOKENS, with_ids: bool = False) -> DataFrame:
    """One row per piece: where it lies in its document and in its sequence; ``with_ids`` adds its ids."""
    path = path or tokenizer_path()

    def run(ids: list, parts: list[tuple[np.ndarray, np.ndarray]], stop_ids: np.ndarray, first: int) -> tuple[pa.RecordBatch, int]:
        flat, lengths = (np.concatenate(x) for x in zip(*parts, strict=True))
        stops = np.flatnonzero(np.isin(flat, stop_ids)) + 1
        cuts = best_cuts(*cut_points(lengths, stops, window, sentence_penalty, cut_penalty), window)
        ends = np.cumsum(lengths)
        marks = np.union1d(cuts, ends)
        low, high = np.concatenate([[0], marks])[:-1] if marks[0] else marks[:-1], marks if marks[0] else marks[1:]
        doc = np.searchsorted(ends, low, "right")
        seq = np.searchsorted(cuts, low, "right") - 1
        begins = ends - lengths
        crc = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(low.tolist(), high.tolist(), strict=True)]
        columns = [pa.array(ids).cast(pa.int64()).take(pa.array(doc)), pa.array(low - begins[doc]), pa.array(high - low), pa.array(crc, pa.int64()), pa.array(lengths[doc]), pa.array(seq + first), pa.array(low - cuts[seq])]
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        if with_ids:
            columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([low, high[-1:]]), pa.int32()), pa.array(flat.astype(np.int32))))
            names.append("ids")
        return pa.RecordBatch.from_arrays(columns, names), first + len(cuts) - 1

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordIds(path, end_id)
        stop_ids = words.ends()
        first = TaskContext.get().partitionId() << 40
        ids, parts, held = [], [], 0
        for batch in batches:
            keys = batch.column(0).to_pylist()
            for low, high, flat, lengths in words(batch.column(1)):
                ids += keys[low:high]
                parts.append((flat, lengths))
                held += len(flat)
                if held >= run_tokens:
                    out, first = run(ids, parts, stop_ids, first)
                    yield out
                    ids, parts, held = [], [], 0
        if ids:
            yield run(ids, parts, stop_ids, first)[0]

    return docs.select("doc_id", "text").mapInArrow(packed, SCHEMA + (", ids array<int>" if with_ids else ""))


def op6_packing(docs: DataFrame) -> DataFrame:
    return pack(docs)
