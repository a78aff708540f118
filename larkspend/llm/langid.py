"""Language identification with a bidirectional gated recurrent network over bytes.

The network is trained in numpy by backpropagation through time on windows of a bounded sample of labelled documents
(at most ``train_docs`` of each of the ``MAX_LANGS`` most frequent languages, ``windows`` a document) and is small enough
to travel with the tasks. Prediction runs over every whole text, many texts side by side; one of more than ``WINDOW``
bytes is read in several windows, each of which starts ``CONTEXT`` bytes early on either side, so that states are warm
where it counts. Every byte is labelled from the forward and the backward state there, and the bytes' probabilities are
averaged over the document.

Defined results: a null text, or one without a letter, is ``und`` with score 0; without any labelled training row, all
rows are ``und``; rarer languages than the ``MAX_LANGS`` most frequent aren't learned; an empty table gives an empty table; repeated rows repeat their results; a null doc_id is not held
out; extra columns don't reach the result. Ties go to the language that sorts first.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructType

from ._text import blocks

HIDDEN = 8
STEPS = 64
WINDOW = 1024
CONTEXT = 64
MAX_LANGS = 256
TRAIN_DOCS = 400
TRAIN_WINDOWS = 6
ROUNDS = 350
BATCH = 192
#: Bytes read side by side, and windows at most.
TOGETHER = 1 << 19
SIDE_BY_SIDE = 2048
LETTER = re.compile(r"[^\W\d_]")


def _gates(x: np.ndarray) -> np.ndarray:
    """Piecewise linear sigmoid, in place."""
    x *= 0.25
    x += 0.5
    return np.clip(x, 0, 1, out=x)


def _init(classes: int, seed: int) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    p = {"out": r.normal(0, 0.3, (classes, 2 * HIDDEN)), "bias": np.zeros((classes, 1))}
    for d in "fb":
        p |= {f"{d}x": r.normal(0, 0.3, (256, 3 * HIDDEN)), f"{d}u": r.normal(0, 0.3, (3 * HIDDEN, HIDDEN)), f"{d}c": np.zeros((3 * HIDDEN, 1))}
        p[f"{d}c"][:HIDDEN] = 1.0  # remember at first
    return {k: v.astype(np.float32) for k, v in p.items()}


def _forward(p: dict, d: str, x: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, list]:
    """States of one direction for bytes x (steps, windows), in that order of steps, and what the way back needs."""
    steps, n = x.shape
    h = np.zeros((HIDDEN, n), np.float32)
    states, kept = np.empty((steps, HIDDEN, n), np.float32), []
    for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
        a, u = p[f"{d}x"][x[t]].T, p[f"{d}u"] @ h + p[f"{d}c"]
        g = _gates(a[: 2 * HIDDEN] + u[: 2 * HIDDEN])
        z, r = g[:HIDDEN], g[HIDDEN:]
        m = np.tanh(a[2 * HIDDEN :] + r * u[2 * HIDDEN :])
        new = (m + z * (h - m)) * mask[t]
        kept.append((t, h, u[2 * HIDDEN :], z, r, m))
        states[t] = h = new
    return states, kept


def _backward(p: dict, d: str, x: np.ndarray, mask: np.ndarray, kept: list, grad: np.ndarray, into: dict) -> None:
    dh = np.zeros_like(grad[0])
    wide = np.arange(256)
    for t, h, un, z, r, m in reversed(kept):
        dh = (dh + grad[t]) * mask[t]
        dz, dm, dh_prev = dh * (h - m), dh * (1 - z), dh * z
        dm *= 1 - m * m
        dr = dm * un
        dz *= 0.25 * ((z > 0) & (z < 1))
        dr *= 0.25 * ((r > 0) & (r < 1))
        da, du = np.concatenate([dz, dr, dm]), np.concatenate([dz, dr, dm * r])
        into[f"{d}x"] += (x[t][:, None] == wide).astype(np.float32).T @ da.T
        into[f"{d}u"] += du @ h.T
        into[f"{d}c"] += du.sum(1, keepdims=True)
        dh = dh_prev + p[f"{d}u"].T @ du


def train(windows: list[bytes], labels: np.ndarray, classes: int, rounds: int = ROUNDS, seed: int = 4) -> dict[str, np.ndarray]:
    """Adam on the mean cross-entropy of every labelled byte."""
    p = _init(classes, seed)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}
    r = np.random.default_rng(seed)
    x_all = np.zeros((len(windows), STEPS), np.uint8)
    size = np.array([min(len(w), STEPS) for w in windows])
    for i, w in enumerate(windows):
        x_all[i, : size[i]] = np.frombuffer(w[:STEPS], np.uint8)
    by_class = [np.flatnonzero(labels == k) for k in range(classes)]
    for step in range(1, rounds + 1):
        pick = np.concatenate([r.choice(own, max(1, BATCH // classes)) for own in by_class if len(own)])
        x, y = x_all[pick].T, labels[pick]
        mask = (np.arange(STEPS)[:, None] < size[pick]).astype(np.float32)
        hf, kf = _forward(p, "f", x, mask)
        hb, kb = _forward(p, "b", x, mask)
        h = np.concatenate([hf, hb], 1)
        logits = np.einsum("kh,thn->tkn", p["out"], h) + p["bias"]
        logits -= logits.max(1, keepdims=True)
        prob = np.exp(logits)
        prob /= prob.sum(1, keepdims=True)
        prob[:, y, np.arange(len(y))] -= 1
        prob *= (mask / mask.sum())[:, None]
        grad = {k: np.zeros_like(v) for k, v in p.items()}
        grad["out"] = np.einsum("tkn,thn->kh", prob, h)
        grad["bias"] = prob.sum((0, 2))[:, None]
        dh = np.einsum("kh,tkn->thn", p["out"], prob)
        _backward(p, "f", x, mask, kf, dh[:, :HIDDEN], grad)
        _backward(p, "b", x, mask, kb, dh[:, HIDDEN:], grad)
        norm = float(np.sqrt(sum((g * g).sum() for g in grad.values())))
        rate = 0.02 * min(1.0, 1.0 / (norm + 1e-6)) * (1 - 0.9 * step / rounds)
        for k, g in grad.items():
            a, b = moments[k]
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            p[k] -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
    return {k: v.astype(np.float32) for k, v in p.items()}


def _states(p: dict, d: str, x: np.ndarray, mask: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(step, state) as in ``_forward``, without what only training needs; x is (steps, windows), and the state is valid
    until the next one."""
    table, u_all = p[f"{d}x"], p[f"{d}u"]
    n = x.shape[1]
    h = np.zeros((HIDDEN, n), np.float32)
    a, u = np.empty((n, 3 * HIDDEN), np.float32), np.empty((3 * HIDDEN, n), np.float32)
    for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
        np.take(table, x[t], 0, out=a, mode="clip")
        np.matmul(u_all, h, out=u)
        u += p[f"{d}c"]
        g = u[: 2 * HIDDEN]
        g += a.T[: 2 * HIDDEN]
        _gates(g)
        m = u[2 * HIDDEN :]
        m *= g[HIDDEN:]
        m += a.T[2 * HIDDEN :]
        np.tanh(m, out=m)
        h -= m
        h *= g[:HIDDEN]
        h += m
        if mask is not None:
            h *= mask[t]
        yield t, h


def byte_probabilities(p: dict, x: np.ndarray, size: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(step, probabilities (classes, windows)) for every step of windows x (windows, steps); 0 beyond a window's size."""
    steps = x.shape[1]
    mask = (np.arange(steps)[:, None] < size).astype(np.float32) if size.min() < steps else None
    x = np.ascontiguousarray(x.T)
    # only the way back is kept whole
    back = np.empty((steps, HIDDEN, x.shape[1]), np.float32)
    for t, h in _states(p, "b", x, mask):
        back[t] = h
    for t, h in _states(p, "f", x, mask):
        prob = p["out"][:, :HIDDEN] @ h
        prob += p["out"][:, HIDDEN:] @ back[t]
        prob += p["bias"]
        np.clip(prob, -30, 30, out=prob)
        np.exp(prob, out=prob)
        prob /= prob.sum(0)
        if mask is not None:
            prob *= mask[t]
        yield t, prob


def windows_of(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document, start and size of each window of a block of texts, and where the part that counts begins and ends in it:
    all of the window but its context."""
    lengths = np.diff(at)
    count = -(-lengths // WINDOW)
    doc = np.repeat(np.arange(len(lengths)), count)
    core = at[doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)) * WINDOW
    stop = np.minimum(core + WINDOW, at[doc + 1])
    start = np.maximum(core - CONTEXT, at[doc])
    return doc, start, np.minimum(stop + CONTEXT, at[doc + 1]) - start, core - start, stop - start


def window_probabilities(p: dict, data: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
    """(windows, step, probabilities (classes, windows)), 0 where a step of a window doesn't count; windows of like size
    are read side by side."""
    _, start, size, first, last = windows_of(at)
    padded = np.concatenate([data, np.zeros(WINDOW + 2 * CONTEXT, np.uint8)])
    order, low = np.argsort(-size, kind="stable"), 0
    while low < len(order):
        steps = int(size[order[low]])
        own = order[low : low + max(1, min(SIDE_BY_SIDE, TOGETHER // steps))]
        low += len(own)
        counts = (np.arange(steps)[:, None] >= first[own]) & (np.arange(steps)[:, None] < last[own])
        for t, prob in byte_probabilities(p, padded[start[own, None] + np.arange(steps)], size[own]):
            yield own, t, prob if counts[t].all() else prob * counts[t]


def document_probabilities(p: dict, data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(documents, classes): means over each document's bytes."""
    doc = windows_of(at)[0]
    total = np.zeros((len(at) - 1, len(p["bias"])))
    now, pooled = None, np.zeros((0, 0))

    def add() -> None:
        for k, row in enumerate(pooled):
            total[:, k] += np.bincount(doc[now], row, len(total))

    for own, _, prob in window_probabilities(p, data, at):
        if own is not now:
            add()
            now, pooled = own, np.zeros_like(prob)
        pooled += prob
    add()
    return total / np.maximum(np.diff(at), 1)[:, None]


def byte_labels(p: dict, langs: list[str], text: str) -> list[tuple[int, int, str]]:
    """Runs (start byte, end byte, language) of one text: the label of every position."""
    data = np.frombuffer(text.encode(), np.uint8)
    if not len(data):
        return []
    at = np.array([0, len(data)])
    _, start, _, first, last = windows_of(at)
    flat = np.zeros(len(data), int)
    for own, t, prob in window_probabilities(p, data, at):
        here = (t >= first[own]) & (t < last[own])
        flat[start[own[here]] + t] = prob[:, here].argmax(0)
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(flat)) + 1, [len(flat)]])
    return [(int(a), int(b), langs[flat[a]]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def held_out(mod: int, remainder: int, doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % mod == remainder, F.lit(False))


def fit(docs: DataFrame, train_docs: int = TRAIN_DOCS, windows: int = TRAIN_WINDOWS, rounds: int = ROUNDS) -> tuple[list[str], dict]:
    """Languages and network, from rows that aren't held out. The driver gets at most ``train_docs * windows`` windows of
    ``STEPS`` bytes a language and at most ``MAX_LANGS`` languages: a coarse cut, row by row, leaves about four times as
    many rows as wanted, and of these the first by a hash of id and text stay. Windows are cut where the rows are."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & ~held_out(4, 2)).select("lang", "text", F.xxhash64("doc_id", "text").alias("h"))
    counts = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGS).collect()
    langs = sorted(r["lang"] for r in counts)
    if not langs:
        return [], {}
    shares = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, 4 * train_docs / r["count"])) for r in counts], "lang string, share double")
    kept = rows.withColumn("draw", F.rand(4)).join(F.broadcast(shares), "lang").where("draw < share").select("lang", "text", "h")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                data = text.encode()
                places = sorted({len(data) * i // windows for i in range(windows)}) if len(data) > windows * STEPS else range(0, len(data), STEPS)
                out.append([data[at : at + STEPS] for at in places])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.binary())), batch.column(2)], ["lang", "bytes", "h"])

    nth = F.row_number().over(Window.partitionBy("lang").orderBy("h", "bytes"))
    few = kept.mapInArrow(cut, "lang string, bytes array<binary>, h long").withColumn("nth", nth).where(F.col("nth") <= train_docs)
    got = sorted((r["lang"], bytes(w)) for r in few.select("lang", "bytes").collect() for w in r["bytes"])
    index = {k: i for i, k in enumerate(langs)}
    return langs, train([w for _, w in got], np.array([index[k] for k, _ in got]), len(langs), rounds)


def predict(docs: DataFrame, langs: list[str], network: dict, positions: bool = False) -> DataFrame:
    """Adds lang_pred and score (and ``positions``: runs of bytes with one label) to ``docs``; replaces such columns."""
    names = [x for x in docs.columns if x not in ("lang_pred", "score", "positions")]
    where = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(where)
            langs_out, scores, spans = [], [], []
            for low, high, data, at in blocks(text):
                letters = [bool(x and LETTER.search(x)) for x in text.slice(low, high - low).to_pylist()]
                prob = document_probabilities(network, data, at) if langs else None
                for i, ok in enumerate(letters):
                    k = int(prob[i].argmax()) if ok and langs else -1
                    langs_out.append(langs[k] if k >= 0 else "und")
                    scores.append(min(1.0, float(prob[i, k])) if k >= 0 else 0.0)
            if positions:
                spans = [[{"start": a, "end": b, "lang": k} for a, b, k in byte_labels(network, langs, x or "")] if langs else [] for x in text.to_pylist()]
            columns = [*batch.columns, pa.array(langs_out, pa.string()), pa.array(scores, pa.float64())]
            out = [*names, "lang_pred", "score"]
            if positions:
                columns.append(pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))))
                out.append("positions")
            yield pa.RecordBatch.from_arrays(columns, out)

    kept = docs.select(*names)
    schema = StructType(list(kept.schema.fields)).add("lang_pred", "string").add("score", "double")
    if positions:
        schema = schema.add("positions", ArrayType(StructType().add("start", LongType()).add("end", LongType()).add("lang", StringType())))
    return kept.mapInArrow(run, schema)


def op4_langid(docs: DataFrame) -> DataFrame:
    docs = docs.select("doc_id", "text", "lang")
    langs, network = fit(docs)
    return predict(docs.select("doc_id", "text"), langs, network).select("doc_id", held_out(4, 2).alias("held_out"), "lang_pred", "score")
