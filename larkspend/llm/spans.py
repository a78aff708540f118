"""Substring deduplication over sliding spans of sentences.

A sentence ends with a word that ends in ``.``, ``!`` or ``?``, at a line end, or with its text. A passage is
a run of at least ``MIN_SENTENCES`` sentences and ``MIN_WORDS`` words, or one sentence of ``LONE_WORDS`` words. The
shortest runs that start at each sentence, the shortest that end at each, and the lone sentences are hashed on their
words, A-Z lower-cased: a passage's sentence that the run from the passage's start doesn't reach has a run that ends at
it inside the passage, so these runs cover whatever any longer passage covers. Runs are joined over the whole corpus: the
occurrence in the smallest doc_id (null last), and there the first, stays; sentences covered by any other occurrence are removed.
A longer passage is found sentence by sentence, so its copies have to end their sentences at the same words.

Hashes are pre-aggregated before they are shuffled, and the join back is an equi-join whose hot keys adaptive execution
can split, so a passage that a third of the corpus shares is no group of rows anywhere.

Defined results: a null text stays null and has no sentences; a text all of whose sentences go becomes empty; every row
has a place of its own, so of rows that share a doc_id, or have none, one keeps what they share, whichever it is among
rows that also share their text; an empty table gives an empty table; other columns pass through ``remove_repeats``
unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from ._store import placed
from ._text import LOWER, blocks, range_hashes, span_hashes, word_spans

MIN_SENTENCES = 2
MIN_WORDS = 16
LONE_WORDS = 40


def sentence_runs(data: np.ndarray, at: np.ndarray, min_sentences: int = MIN_SENTENCES, min_words: int = MIN_WORDS, lone_words: int = LONE_WORDS):
    """Of a block of texts: start and end byte of each sentence, sentences before each text (n + 1), and for each run
    its first sentence, the sentence after its last, and its hash."""
    low = LOWER[data]
    starts, ends, per_doc = word_spans(low, at)
    n = len(starts)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(at), np.int64), none, none, np.zeros(0, np.uint64)
    stop = np.isin(low[ends - 1], np.frombuffer(b".!?", np.uint8))
    lines = np.concatenate([[0], np.cumsum(low == 10)])
    stop[:-1] |= lines[starts[1:]] > lines[ends[:-1]]
    stop[per_doc[1:][per_doc[1:] > 0] - 1] = True
    last = np.flatnonzero(stop) + 1  # word after each sentence
    first = np.concatenate([[0], last[:-1]])
    doc_sentence = np.searchsorted(first, per_doc)
    here = np.arange(len(first))
    text = np.searchsorted(doc_sentence, here, "right")
    begin, limit = doc_sentence[text - 1], doc_sentence[text]  # the text's first sentence, and that after its last
    until = np.maximum(np.searchsorted(last, first + min_words) + 1, here + min_sentences)
    since = np.minimum(np.searchsorted(first, last - min_words, "right") - 1, here + 1 - min_sentences)
    ahead, back, lone = until <= limit, since >= begin, last - first >= lone_words
    run = np.concatenate([here[ahead], since[back], here[lone]])
    after = np.concatenate([until[ahead], here[back] + 1, here[lone] + 1])
    run, after = np.divmod(np.unique(run * (len(first) + 1) + after), len(first) + 1)
    h = range_hashes(span_hashes(low, starts, ends), first[run], last[after - 1])
    return starts[first], ends[last - 1], doc_sentence, run, after, h


def run_hashes_of(docs: DataFrame, **sizes) -> DataFrame:
    """(id, hash) of the first occurrence of each run in each row; its ``__place`` is its id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for low, high, data, at in blocks(batch.column(1)):
                _, _, doc_sentence, first, _, h = sentence_runs(data, at, **sizes)
                doc = np.searchsorted(doc_sentence, first, "right") - 1
                once = np.lexsort((h, doc))
                new = np.ones(len(once), bool)
                new[1:] = (np.diff(doc[once]) != 0) | (np.diff(h[once]) != 0)
                own = once[new]
                yield pa.RecordBatch.from_arrays([pa.array(ids[low:high][doc[own]]), pa.array(h[own].view(np.int64))], ["id", "hash"])

    return docs.select(F.col("__place").alias("id"), "text").mapInArrow(run, "id long, hash long")


def remove_repeats(docs: DataFrame, **sizes) -> DataFrame:
    """``docs`` with repeated sentences taken out of ``text``, and n_sentences, n_removed and removed (spans of the
    old text in code points), which replace columns of these names."""
    names = [x for x in docs.columns if x not in ("n_sentences", "n_removed", "removed")]
    docs, _ = placed(docs.select(*names))
    runs = run_hashes_of(docs, **sizes)
    shared = runs.groupBy("hash").agg(F.min("id").alias("first_id"), F.count("*").alias("n")).where("n > 1").select("hash", "first_id")
    later = runs.join(shared, "hash").where("id <> first_id").groupBy("id").agg(F.collect_set("hash").alias("__drop")).withColumnRenamed("id", "__id")
    where = names.index("text")
    joined = docs.join(later, F.col("__place") == F.col("__id"), "left").select(*names, "__drop")

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            column, drops = batch.column(where), batch.column(len(names))
            texts, counts, gone, spans = [], [], [], []
            for low, high, data, at in blocks(column):
                begins, ends, doc_sentence, first, until, h = sentence_runs(data, at, **sizes)
                bounds = np.searchsorted(first, doc_sentence)
                whole = column.slice(low, high - low).to_pylist()
                dropped = drops.slice(low, high - low).to_pylist()
                for i in range(high - low):
                    s0, s1 = int(doc_sentence[i]), int(doc_sentence[i + 1])
                    own = slice(int(bounds[i]), int(bounds[i + 1]))
                    hashes = h[own].view(np.int64)
                    _, index = np.unique(hashes, return_index=True)
                    bad = np.ones(len(hashes), bool)
                    bad[index] = False  # later occurrences inside the text
                    if dropped[i]:
                        bad |= np.isin(hashes, np.array(dropped[i], np.int64))
                    counts.append(s1 - s0)
                    if not bad.any():
                        texts.append(whole[i])
                        gone.append(0)
                        spans.append([])
                        continue
                    mark = np.zeros(s1 - s0 + 1, int)
                    np.add.at(mark, first[own][bad] - s0, 1)
                    np.add.at(mark, until[own][bad] - s0, -1)
                    cover = np.cumsum(mark)[:-1] > 0
                    text = data[at[i] : at[i + 1]].tobytes()
                    edges = np.concatenate([begins[s0:s1] - at[i], [len(text)]])
                    # a sentence goes with the white space behind it
                    texts.append(b"".join([text[: edges[0]], *(text[edges[j] : edges[j + 1]] for j in np.flatnonzero(~cover))]).decode())
                    gone.append(int(cover.sum()))
                    place = np.concatenate([[0], np.cumsum((data[at[i] : at[i + 1]] & 0xC0) != 0x80)])
                    spans.append([{"start": int(place[begins[s0 + j] - at[i]]), "end": int(place[ends[s0 + j] - at[i]])} for j in np.flatnonzero(cover)])
            columns = [*batch.columns[: len(names)], pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, span)]
            columns[where] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, [*names, "n_sentences", "n_removed", "removed"])

    schema = StructType([docs.schema[x] for x in names]).add("n_sentences", "long").add("n_removed", "long").add("removed", ArrayType(StructType().add("start", "long").add("end", "long")))
    return joined.mapInArrow(clean, schema)


def op9_spans(docs: DataFrame) -> DataFrame:
    """doc_id, n_sentences, n_removed, removed (start:end of each removed sentence, comma-joined) and the text left."""
    clean = remove_repeats(docs.select("doc_id", "text"))
    removed = F.array_join(F.transform("removed", lambda x: F.concat_ws(":", x["start"], x["end"])), ",")
    return clean.select("doc_id", "n_sentences", "n_removed", removed.alias("removed"), "text")
