"""Corpus operators against brute force on small fixtures with nulls, empty and long texts, ties and repeated rows."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from larkspend.llm import langid, lm, mixing, ngram_join, packing, pii, quality, queries, spans, topk, toxicity
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, size int, target string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def documents(spark, texts, langs=None, sources=None):
    """A table with columns that clash with those operators add."""
    rows = [(i, t, (langs or ["en"] * len(texts))[i], (sources or ["s"] * len(texts))[i], None if t is None else len(t), "x", 7, "y") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def words(text):
    return WORD.findall(text or "")


def vocabulary(n, seed=1):
    r = random.Random(seed)
    return ["".join(r.choice("abcdefgimnorst") for _ in range(r.randint(1, 9))) for _ in range(n)]


def odd_texts(seed=3):
    """Random texts with the cases that every operator has to take."""
    r, v = random.Random(seed), vocabulary(300)
    texts = [" ".join(r.choices(v, k=r.randint(1, 120))) for _ in range(40)]
    texts = [re.sub(r" (\w+) (\w+)", r" \1. \2\n", t, count=3) for t in texts]
    base = r.choices(v, k=150)
    for _ in range(12):
        one = list(base)
        for _ in range(r.randint(1, 5)):
            one[r.randrange(150)] = r.choice(v)
        texts.append(" ".join(one))
    return [*texts, None, "", "   \n\t ", "one", "one two", "ONE two", texts[0], texts[0], "word " * 6000, "\x0b\x0cÉté été", "日本語 テキスト 日本語", None, ""]


def got(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def brute_groups(texts, k, num, den):
    sets = []
    for t in texts:
        w = lower(t or "").translate({9: 32, 10: 32, 11: 32, 12: 32, 13: 32}).split(" ")
        w = [x for x in w if x]
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(texts)), 2):
        n = len(sets[i] & sets[j])
        if sets[i] and sets[j] and den * n >= num * (len(sets[i]) + len(sets[j]) - n):
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return {i: (len(s), find(i)) for i, s in enumerate(sets)}


@pytest.mark.parametrize("k,num,den", [(4, 85, 100), (2, 50, 100)])
def test_ngram_join(spark, k, num, den):
    texts = odd_texts()
    rows = got(ngram_join.similar_groups(documents(spark, texts), k, num, den))
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in rows.items()} == brute_groups(texts, k, num, den)


def test_ngram_join_rounds_run_out(spark, monkeypatch):
    """With one hub only, the direct pairing and the pairs near a hub have to find the rest."""
    monkeypatch.setattr(ngram_join, "HUB_ROUNDS", 1)
    r, v = random.Random(9), vocabulary(2000, 5)
    base = r.choices(v, k=200)
    texts = []
    for i in range(40):
        one = list(base)
        for _ in range(i % 9):
            one[r.randrange(200)] = r.choice(v)
        texts.append(" ".join(one))
    rows = got(ngram_join.similar_groups(documents(spark, texts), 4, 85, 100))
    assert {i: (x["n_shingles"], x["component_id"]) for i, x in rows.items()} == brute_groups(texts, 4, 85, 100)


@pytest.mark.parametrize("rows,columns", [(1000, 4096), (7, 64)])
def test_ngram_join_numbers_of_links(spark, monkeypatch, rows, columns):
    """Numbers of links in groups of near copies, with exact copies, against all pairs; also over several blocks."""
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", rows)
    monkeypatch.setattr(ngram_join, "COLUMNS", columns)
    r, v = random.Random(19), vocabulary(2000, 5)
    base, texts = r.choices(v, k=150), odd_texts()
    for i in range(40):
        one = list(base)
        for _ in range(i % 9):
            one[r.randrange(150)] = r.choice(v)
        texts += [" ".join(one)] * (1 + i % 3)
    sets = [{tuple(w[i : i + 4]) for i in range(len(w) - 3)} or ({tuple(w)} - {()}) for w in (words(lower(t or "")) for t in texts)]
    linked = lambda x, y: bool(x and y) and 100 * len(x & y) >= 85 * len(x | y)
    found = got(ngram_join.op1_ngram_join(documents(spark, texts)))
    want = [sum(linked(x, y) for y in sets) - bool(x) for x in sets]
    assert [found[i]["n_links"] for i in range(len(texts))] == want and len(set(want)) > 5


def test_ngram_join_repeated_and_missing_ids(spark, monkeypatch):
    """Every row takes part; a group's id is the smallest doc_id in it. Also with each key joined apart."""
    monkeypatch.setattr(ngram_join, "HOT_ROWS", 2)
    near = " ".join(vocabulary(100, 3))
    texts = [(1, "a b c d e"), (1, "a b c d e f g"), (2, "a b c d e f g"), (None, "a b c d e"), (None, None), (None, "x y z x y"), (None, "x y z x y"), (7, near), (6, near + " end")]
    texts += [(20 + i % 3, near) for i in range(9)]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    rows = sorted(((r["doc_id"] or 0, r["n_shingles"], r["component_id"] or 0, r["n_links"]) for r in ngram_join.op1_ngram_join(df).collect()))
    want = [(0, 0, 0, 0), (0, 2, 0, 1), (0, 2, 0, 1), (0, 2, 1, 1), (1, 2, 1, 1), (1, 4, 1, 1), (2, 4, 1, 1), (6, 98, 6, 10), (7, 97, 6, 10)] + [(20 + i // 3, 97, 6, 10) for i in range(9)]
    assert rows == want
    left = sorted((r["doc_id"] or 0, r["text"] or "") for r in ngram_join.without_repeats(df).collect())
    # five words: the short texts are one or three shingles of their own
    assert [x for x, _ in left] == [0, 0, 1, 1, 6]
    assert ngram_join.op1_ngram_join(df.where("false")).count() == 0


def test_hot_prefixes_are_sent_once_a_batch(spark):
    """What fragments get doesn't hold the ids of documents that share an n-gram inside their batch, and counts agree."""
    texts = [f"w{i} " + "the same words again and again in every text " * 2 + f"v{i}" for i in range(300)]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(2)
    found = {r["id"]: r["shared"] for r in ngram_join.shared_prefixes(rows, 4, 85, 100, 4).collect()}
    sets = [next(ngram_join.sets(pa.array([t]), 4)) for t in texts]
    prefix = [set(x[: ngram_join.prefix_length(len(x), 85, 100)].tolist()) for x in sets]
    seen = Counter(k for p in prefix for k in p)
    assert found == {i: sum(seen[k] > 1 for k in p) for i, p in enumerate(prefix)}


@pytest.mark.parametrize("rows", [20, 100_000])
def test_components(spark, rows):
    """A long chain, a star, a cycle and a self-loop, in many partitions and in one."""
    from larkspend.llm._graph import components

    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 230)] + [(300, 301), (301, 302), (302, 300), (400, 400)]
    random.Random(1).shuffle(edges)
    found = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long").repartition(6), rows).collect()}
    want = {i: 100 for i in range(100, 161)} | {i: 7 for i in (7, *range(200, 230))} | {300: 300, 301: 300, 302: 300}
    assert found == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_mixing(spark):
    r = random.Random(2)
    texts = [None if i % 41 == 0 else "w " * r.randint(0, 60) for i in range(600)]
    sources = [("a", "b", "b", "b", None, "ü", "z")[r.randrange(7)] for _ in range(600)]
    docs = documents(spark, texts, sources=sources)
    rows = got(mixing.op2_mixing(docs))
    size = {i: len(words(t)) for i, t in enumerate(texts)}
    total = Counter()
    for i, s in enumerate(sources):
        total[s] += size[i]
    weight = {s: k % 3 + 1 for k, s in enumerate(sorted(total, key=lambda s: (s is None, s or "")))}
    target, left, free = {}, float(sum(total.values())), set(total)
    while free:
        unit = left / sum(weight[s] for s in free)
        full = {s for s in free if unit * weight[s] > 3 * total[s]}
        if not full:
            target |= {s: unit * weight[s] for s in free}
            break
        target |= {s: 3.0 * total[s] for s in full}
        left -= sum(3 * total[s] for s in full)
        free -= full
    taken = Counter()
    for i, x in rows.items():
        assert x["size"] == size[i] and x["source_size"] == total[sources[i]] and abs(x["target"] - target[sources[i]]) < 1e-3
        assert 0 <= x["taken"] <= 3 * size[i]
        taken[sources[i]] += x["taken"]
    assert all(abs(taken[s] - target[s]) <= 0.51 for s in total)
    assert got(mixing.op2_mixing(docs.repartition(7))) == rows
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    assert sum(len(words(t["text"])) for t in mixed.collect()) == sum(taken.values())
    assert mixing.op2_mixing(docs.where("false")).count() == 0


def test_mixing_rows_that_share_an_id(spark):
    """Sources meet their targets also where ids repeat or are missing, and each row keeps its own share."""
    r = random.Random(5)
    rows = [(None if i % 3 == 0 else i % 40, "w " * r.randint(0, 50), ("a", "b", None)[i % 3 if i % 2 else 0], i) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, taken int").repartition(4)
    shares = mixing.op2_mixing(df).collect()
    goal = {x["source_size"]: x["target"] for x in shares}
    total = Counter()
    for x in shares:
        assert x["taken"] <= 3 * x["size"]
        total[x["source_size"]] += x["taken"]
    assert len(shares) == 300 and all(abs(total[s] - goal[s]) <= 0.51 for s in goal)
    mixed = mixing.mixed_documents(df)
    assert mixed.columns == df.columns and sum(len(words(x["text"])) for x in mixed.collect()) == sum(total.values())


BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def brute_pii(text):
    out = []
    for k, (name, pattern) in enumerate(BASE.items()):
        for m in pattern.finditer(text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if name == "ip" else True, "card": 14 <= len(digits) <= 19 and pii.luhn(digits), "phone": 10 <= len(digits) <= 15}[name]
            if ok:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_pii(spark):
    r = random.Random(5)
    bits = ["a", "é", "B", "12", "4111111111111111", "+1 (535) 555-5022", "a@b.co", "x_y@z.de_w@v.uk", "1.2.3.4", "256.1.1.1.1", "4111 1111-1111 1111", "@", "..", "+", " ", "-", "call 535-555-5022 now", "ssn 123-45-6789", "me [at] site [dot] org", "account DE89370400440532013000", "\n"]
    texts = ["".join(r.choices(bits, k=r.randint(0, 12))) for _ in range(400)] + [None, "", "9" * 50_000, "a@" * 5000]
    rows = got(pii.op3_pii(documents(spark, texts)))
    more = 0
    for i, t in enumerate(texts):
        want = brute_pii(t)
        named = [f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in want]
        assert rows[i]["base_sha256"] == hashlib.sha256(",".join(named).encode()).hexdigest()
        assert [rows[i][f"n_{n}"] for n in BASE] == [sum(k == j for _, k, _ in want) for j in range(4)]
        all_spans = rows[i]["spans"].split(",") if rows[i]["spans"] else []
        assert set(named) <= set(all_spans) and all_spans == sorted(all_spans, key=lambda x: (int(x.split(":")[1]), pii.KINDS.index(x.split(":")[0])))
        more += len(all_spans) - len(named)
    assert more > 0
    clean = got(pii.redact(documents(spark, ["mail a@b.co or 1.2.3.4!", None, "", "nothing here"])))
    assert [clean[i]["text"] for i in range(4)] == ["mail [EMAIL] or [IP]!", None, "", "nothing here"]
    assert pii.op3_pii(documents(spark, ["x"]).where("false")).count() == 0


def test_pii_learned_spans(spark):
    """Spans planted in texts that training didn't see are found, decoys of the same shape aren't."""
    r = random.Random(8)
    v = vocabulary(200)
    digits = lambda n: "".join(r.choices("0123456789", k=n))
    key = lambda n: "".join(r.choices("0123456789abcdef", k=n))
    real = [
        lambda: ("secret", "password=", key(18)), lambda: ("secret", 'token = "', key(40)), lambda: ("secret", "key ", "AKIA" + key(16).upper()), lambda: ("name", "my name is ", "Maria Klausner"), lambda: ("name", "Dear ", "John Whitfield"),
        lambda: ("address", "I live at ", digits(2) + " Old Mill Road"), lambda: ("birth_date", "born on ", "14.03.1975"), lambda: ("phone", "call ", f"535-{digits(3)}-{digits(4)}"), lambda: ("national_id", "ssn ", "523-45-" + digits(4)), lambda: ("email", "write to ", "jo.doe [at] site [dot] org"),
    ]
    decoy = [lambda: ("phone", "order ", "000-000-0000"), lambda: ("national_id", "serial ", "000-11-1111"), lambda: ("birth_date", "version ", "45.67.8901"), lambda: ("secret", "commit ", "0" * 40)]

    def text():
        parts, want = [], []
        for make, good in [(r.choice(real), True), (r.choice(decoy), False)]:
            kind, before, span = make()
            parts.append(" ".join(r.choices(v, k=8)) + " " + before)
            want.append((kind, len("".join(parts)), len("".join(parts)) + len(span), good))
            parts.append(span + " ")
        return "".join(parts), want

    made = [text() for _ in range(600)]
    counts = Counter(pii.pattern(t, s, k, e, False) for t, _ in made[:400] for s, k, e in pii.candidates(t)[1])
    weights = pii.train_classifier(counts, pii.reliabilities(counts))
    hits, wrong, planted = 0, 0, 0
    for t, want in made[400:]:
        found = {(pii.KINDS[k], s, e) for s, k, e in pii.candidates(t)[1] if pii.probability(weights, pii.pattern(t, s, k, e, False)) >= 0.5}
        good = {x[:3] for x in want if x[3]}
        hits, wrong, planted = hits + len(found & good), wrong + len(found - good), planted + len(good)
    assert hits >= 0.95 * planted and wrong <= 0.05 * planted, (hits, wrong, planted)
    rows = got(pii.op3_pii(documents(spark, [t for t, _ in made])))
    assert sum(x["n_more"] for x in rows.values()) >= 0.9 * len(made)


def test_pii_expectation_maximisation():
    """The likelihood, computed spot by spot, never falls, and tables come near those that votes were drawn from."""
    r = np.random.default_rng(4)
    truth = r.random(6000) < 0.4
    tables = np.array([[[0.1, 0.7, 0.2], [0.7, 0.1, 0.2]], [[0.05, 0.35, 0.6], [0.5, 0.1, 0.4]], [[0.2, 0.2, 0.6], [0.6, 0.1, 0.3]]])
    votes = np.stack([[r.choice(3, p=t[int(y)]) for y in truth] for t in tables], 1)
    cells = Counter("4" + "".join("yn-"[x] for x in v) + "00000" for v in votes.tolist())
    keys = sorted(cells)
    n, kinds = np.array([cells[k] for k in keys], float), np.full(len(keys), 4)
    coded = np.array([["yn-".index(c) for c in k[1:4]] for k in keys])
    post, last = np.full(len(keys), 0.5) + 0.1 * ((coded == 0).sum(1) - (coded == 1).sum(1)), -np.inf
    for _ in range(40):
        post, likelihood = pii.expectation(n, kinds, coded, post)
        assert likelihood >= last - 1e-6
        last = likelihood
    one = dict(zip(keys, post, strict=True))
    guess = np.array([one["4" + "".join("yn-"[x] for x in v) + "00000"] >= 0.5 for v in votes.tolist()])
    joint = np.array([0.6, 0.4])[:, None] * np.stack([np.prod([tables[j][y][votes[:, j]] for j in range(3)], 0) for y in (0, 1)])
    assert (guess == (joint[1] > joint[0])).mean() > 0.95 and abs(post @ n / n.sum() - 0.4) < 0.08
    assert pii.reliabilities(Counter()) == {} and pii.MAX_CELLS < 200_000


def test_langid(spark):
    r = random.Random(4)
    syllables = {"aa": ["ba", "bo", "bi", "lu"], "bb": ["tz", "kö", "schü", "ver"], "cc": ["ñe", "que", "ió", "ra"]}
    langs = [r.choice(list(syllables)) for _ in range(240)]
    texts = [" ".join("".join(r.choices(syllables[k], k=r.randint(1, 4))) for _ in range(r.randint(3, 60))) for k in langs] + [None, "", "12 34", "¿?"]
    docs = documents(spark, texts, langs=[*langs, None, "aa", None, "bb"])
    rows = got(langid.op4_langid(docs))
    held = [i for i in range(240) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert {i for i in rows if rows[i]["held_out"]} == {i for i in range(244) if zlib.crc32(str(i).encode()) % 4 == 2}
    assert np.mean([rows[i]["lang_pred"] == langs[i] for i in held]) > 0.95
    assert all(rows[i]["lang_pred"] == "und" and rows[i]["score"] == 0 for i in range(240, 244))
    assert all(0 <= x["score"] <= 1 for x in rows.values())
    names, net = langid.fit(docs)
    spots = got(langid.predict(docs.where("doc_id < 3"), names, net, positions=True))
    assert spots[0]["positions"][-1]["end"] == len(texts[0].encode()) and {p["lang"] for p in spots[0]["positions"]} <= set(names)
    assert {x["lang_pred"] for x in langid.op4_langid(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_langid_inference():
    """What predicts side by side gives the probabilities of the training pass; long texts are read with warm states."""
    p = langid._init(3, 2)
    r = np.random.default_rng(2)
    texts = [bytes(r.integers(97, 120, n).tolist()).decode() for n in (5, 0, 900, 64, 1, 1024)]
    at = np.cumsum([0, *map(len, texts)])
    found = langid.document_probabilities(p, np.frombuffer("".join(texts).encode(), np.uint8), at)

    def whole(data):
        x = np.frombuffer(data, np.uint8)[:, None]
        h = np.concatenate([langid._forward(p, d, x, np.ones(x.shape, np.float32))[0] for d in "fb"], 1)
        e = np.exp(np.einsum("kh,thn->tkn", p["out"], h) + p["bias"])[:, :, 0]
        return e / e.sum(1, keepdims=True)

    for t, f in zip(texts, found, strict=True):
        assert np.allclose(f, whole(t.encode()).mean(0) if t else 0, atol=1e-4)
    long = bytes(r.integers(97, 120, 5000).tolist())
    labels = langid.byte_labels(p, ["a", "b", "c"], long.decode())
    flat = np.concatenate([np.full(b - a, ord(k) - 97) for a, b, k in labels])
    assert labels[0][0] == 0 and len(flat) == 5000 and (flat == whole(long).argmax(1)).mean() > 0.97


def test_langid_sample_is_bounded(spark):
    """A language all of whose rows are copies is learned, and no language gives more than its bound."""
    rows = [(None, "kva kvu kvy" if i % 2 else None, "zz") for i in range(3000)] + [(i, f"so la ti do {i}", "mm") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    seen = []
    real = langid.train
    try:
        langid.train = lambda w, y, *more: (seen.extend(y.tolist()), real(w, y, *more))[1]
        names, net = langid.fit(docs, train_docs=50, windows=2, rounds=30)
    finally:
        langid.train = real
    assert names == ["mm", "zz"] and Counter(seen) == {0: 50, 1: 50}
    assert langid.predict(docs.where("false"), names, net).count() == 0


def test_langid_gradient():
    """Backpropagation through time against finite differences (smooth gates are exact; hinges are avoided by chance)."""
    r = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in langid._init(3, 1).items()}
    x, mask = r.integers(97, 105, (5, 4)), np.ones((5, 4))
    mask[3:, 1] = 0
    goal = r.normal(size=(5, langid.HIDDEN, 4))
    for d in "fb":
        loss = lambda: float((langid._forward(p, d, x, mask)[0] * goal).sum())  # noqa: B023, E731
        states, kept = langid._forward(p, d, x, mask)
        grad = {k: np.zeros_like(v) for k, v in p.items()}
        langid._backward(p, d, x, mask, kept, goal, grad)
        for name in (f"{d}x", f"{d}u", f"{d}c"):
            flat, g = p[name].reshape(-1), grad[name].reshape(-1)
            for i in np.argsort(-np.abs(g))[:5]:
                keep = flat[i]
                flat[i] = keep + 1e-3
                up = loss()
                flat[i] = keep - 1e-3
                down = loss()
                flat[i] = keep
                assert abs((up - down) / 2e-3 - g[i]) < 2e-2 * (1 + abs(g[i]))


def test_topk(spark, monkeypatch):
    r = np.random.default_rng(3)
    x = r.normal(0, 0.2, (1500, 8)).astype(np.float32)
    x[300:900] = x[300]  # a common vector: ties
    rows = [(i, [float(c) for c in x[i]], 0) for i in range(1500)]
    rows += [(2000, None, 0), (2100, [1.0, None] + [0.0] * 6, 0), (2200, [float("nan")] * 8, 0), (2300, [float("inf")] + [0.0] * 7, 0), (2400, [1.0, 2.0], 0), (None, [0.0] * 8, 0), (5, [0.5] * 8, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    found = {}
    monkeypatch.setattr(topk, "QUERY_BLOCK", 4)
    monkeypatch.setattr(topk, "QUERIES_A_TASK", 7)
    for m in topk.search(topk.quantised(df), topk.quantised(df).where("vec_id % 100 = 0"), 10, data_block=200).collect():
        found.setdefault(m["query_id"], []).append((m["rank"], m["vec_id"], m["score"]))
    q = [(i, np.floor(1024 * np.array(e, float)).astype(np.int64)) for i, e, _ in rows if i is not None and e is not None and None not in e and np.isfinite(e).all()]
    want = {}
    for a, (i, v) in enumerate(q):
        if i % 100 == 0:
            own = sorted((-int(v @ w), j) for b, (j, w) in enumerate(q) if b != a and len(w) == len(v))[:10]
            if own:
                want[i] = [(k + 1, j, -s) for k, (s, j) in enumerate(own)]
    assert {k: sorted(v) for k, v in found.items()} == want
    assert topk.op5_topk(df.where("false")).count() == 0
    # of rows that share a vec_id each asks and finds the others, and lengths that no pivot has are searched too
    monkeypatch.setattr(topk, "SAMPLE", 1)
    few = spark.createDataFrame([(100, [1.0, 0.0]), (100, [0.0, 1.0]), (1, [0.5, 0.25]), (2, [0.25, 0.5]), (3, [1.0]), (200, [2.0]), (300, [])], "vec_id long, embedding array<float>")
    answers = sorted(tuple(x) for x in topk.op5_topk(few).collect())
    assert answers == [(100, 1, 1, 512 * 1024), (100, 1, 2, 512 * 1024), (100, 2, 1, 256 * 1024), (100, 2, 2, 256 * 1024), (100, 3, 100, 0), (100, 3, 100, 0), (200, 1, 3, 2048 * 1024)]


def test_topk_prunes_clusters(spark):
    """On tight clusters far fewer than half of all pairs are compared, and the results are still exact."""
    g = np.random.default_rng(1)
    centre = g.normal(size=(20, 16))
    x = np.repeat(centre / np.linalg.norm(centre, axis=1)[:, None], 200, 0) + g.normal(size=(4000, 16)) * 0.03
    df = topk.quantised(spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>"))
    queries = df.where("vec_id % 100 = 0")
    assert topk.search(df, queries, 10, 256, compared=True).first()[0] < 0.3 * 40 * 4000
    found = {}
    for m in topk.search(df, queries, 10, 256).collect():
        found.setdefault(m["query_id"], []).append((m["rank"], m["score"]))
    w = np.floor(1024 * x)
    for i in range(0, 4000, 100):
        want = sorted((w[i] @ w[j] for j in range(4000) if j != i), reverse=True)[:10]
        assert [s for _, s in sorted(found[i])] == want


def test_packing(spark):
    from tokenizers import Tokenizer

    texts = odd_texts() + ["<|endoftext|> x", "a.b,c!! don't ÀÉ. …. x###"]
    docs = documents(spark, texts)
    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    ids = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for i, t in enumerate(texts)}
    pieces = packing.pack(docs, window=256, sentence_penalty=1, cut_penalty=3, run_tokens=5000, with_ids=True).collect()
    assert sorted((p["doc_id"], p["start"], p["length"], p["ids_crc32"], p["doc_tokens"]) for p in pieces) == sorted(
        (p["doc_id"], p["start"], p["length"], zlib.crc32(np.array(ids[p["doc_id"]][p["start"] : p["start"] + p["length"]], "<u4").tobytes()), len(ids[p["doc_id"]])) for p in pieces
    )
    for i in ids:
        own = sorted((p["start"], p["length"]) for p in pieces if p["doc_id"] == i)
        assert own[0][0] == 0 and sum(n for _, n in own) == len(ids[i]) and all(a + n == b for (a, n), (b, _) in itertools.pairwise(own))
    sequences = {}
    for p in pieces:
        sequences.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    padding = 0
    for own in sequences.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in itertools.pairwise(own))
        n = sum(x for _, x in own)
        assert n <= 256
        padding += 0 if n & (n - 1) == 0 else 256 - n
    # sentences are about as long as this window, and only longer ones are cut inside
    assert padding < 0.08 * sum(map(len, ids.values()))
    assert packing.op6_packing(docs.where("false")).count() == 0


def test_word_ids_of_odd_words():
    """Special tokens in any case, signs, accents and scripts, against the tokenizer on whole texts."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    r = random.Random(11)
    bits = ["<|endoftext|>", "<|ENDOFTEXT|>", "<|EndOfText|>", "<|startoftext|>", "<|", "|>", "<", "a", "Word", "ÉTÉ", "ß", "é", "\u0301", "日本", "12", "'S", "don't", ".", "!!", "#", " ", " ", "\n", "\t", "İ", "Σ", "…"]
    texts = ["".join(r.choices(bits, k=r.randint(0, 9))) for _ in range(1500)]
    want = [[*tokenizer.encode(t, add_special_tokens=False).ids, 1] for t in texts]
    found = [x.tolist() for _, _, flat, sizes in packing.WordIds(packing.tokenizer_path())(pa.array(texts)) for x in np.split(flat, np.cumsum(sizes)[:-1])]
    assert found == want


def test_cuts_stand_at_boundaries():
    """Inside a sentence only where it is longer than a window."""
    points, cost = packing.cut_points(np.array([30, 100, 20]), np.array([10, 50]), 64, 8, 48)
    assert points[cost == 0].tolist() == [0, 30, 130, 150] and points[cost == 8].tolist() == [10, 50]
    assert points[cost == 48].tolist() == list(range(54, 130, 4))


def test_words_outgrow_the_cache(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "CACHE_WORDS", 50)
    monkeypatch.setattr(packing, "BLOCK_BYTES", 100)
    texts = [" ".join(vocabulary(n, n)) for n in (30, 400, 3, 90, 2000)]
    want = [[*Tokenizer.from_file(packing.tokenizer_path()).encode(t, add_special_tokens=False).ids, 1] for t in texts]
    got_ids = [x.tolist() for _, _, flat, sizes in packing.WordIds(packing.tokenizer_path())(pa.array(texts)) for x in np.split(flat, np.cumsum(sizes)[:-1])]
    assert got_ids == want


def test_packing_is_optimal():
    """The monotone queue against the plain recursion over all pairs of places."""
    r = np.random.default_rng(1)
    for _ in range(30):
        lengths = r.integers(1, 60, r.integers(1, 12))
        points, cost = packing.cut_points(lengths, r.integers(1, lengths.sum() + 1, 5), 32, 8, 48)
        best = [0.0]
        for j in range(1, len(points)):
            best.append(cost[j] + min(best[i] + (0 if (n & (n - 1)) == 0 else 32 - n) for i in range(j) if (n := int(points[j] - points[i])) <= 32))
        cuts = packing.best_cuts(points, cost, 32)
        sizes = np.diff(cuts)
        total = sum(0 if n & (n - 1) == 0 else 32 - n for n in sizes.tolist()) + sum(cost[np.searchsorted(points, c)] for c in cuts[1:])
        assert cuts[0] == 0 and cuts[-1] == lengths.sum() and sizes.max() <= 32 and total == best[-1]


def lm_counts(split, held):
    counts = Counter()
    for t, h in zip(split, held, strict=True):
        if not h:
            line = ["<s>", *t]
            counts.update(tuple(line[max(0, i - n + 1) : i + 1]) for i in range(1, len(line)) for n in (1, 2, 3) if n < 3 or i > 1)
    return counts


def test_lm(spark, monkeypatch):
    monkeypatch.setattr(lm, "GROUP_BYTES", 4000)
    texts = odd_texts()
    rows = got(lm.op7_lm(documents(spark, texts)))
    split = [[*words(lower(t or "")), None] for t in texts]
    held = [zlib.crc32(str(i).encode()) % 5 == 1 for i in range(len(texts))]
    c = lm_counts(split, held)
    n, v = sum(x for k, x in c.items() if len(k) == 1), sum(len(k) == 1 for k in c)
    c["<s>",] = held.count(False)
    k1, k2 = lm.BACKOFF
    for i, t in enumerate(split):
        p = [(c[w,] + 0.5) / (n + 0.5 * (v + 1)) for w in t]
        full, line = 0.0, ["<s>", *t]
        for k, w in enumerate(t):
            q = (c[line[k], w] + k1 * p[k]) / (c[line[k],] + k1)
            if k:
                q = (c[line[k - 1], line[k], w] + k2 * q) / (c[line[k - 1], line[k]] + k2)
            full += math.log10(q)
        x = rows[i]
        assert (x["held_out"], x["n_tokens"], x["n_known"], x["train_tokens"]) == (held[i], len(t), sum(c[w,] > 0 for w in t), n)
        assert math.isclose(x["base_score"], sum(map(math.log10, p)), rel_tol=1e-9) and math.isclose(x["score"], full, rel_tol=1e-9)
    assert lm.op7_lm(documents(spark, texts).where("false")).count() == 0


def test_lm_automaton():
    """The arcs of each state, with what its failure arcs reach, sum to one; read word by word, carrying the state, a text
    gets what it gets at once."""
    r = random.Random(3)
    texts = [" ".join(r.choices("abcd", k=r.randint(0, 12))) for _ in range(60)]
    token, at = lm.tokens(pa.array(texts))
    found = lm.ngrams(token, at)
    train = np.repeat(np.arange(60) % 3 > 0, np.diff(at))
    counts = [np.bincount(np.unique(x, return_inverse=True)[1], train).astype(np.int64) for x in found]
    model, before, word = lm.automaton(found, at, counts, int(train.sum()), int((counts[0] > 0).sum()), (7.0, 3.0))
    total, after = model.read(before, word)
    for state in np.unique(before):
        each = [10 ** model.read(np.array([state]), np.array([w]))[0][0] for w in range(model.words)]
        unknown = 0.5 / (train.sum() + 0.5 * (model.words + 1))
        while state:
            unknown, state = unknown * 10 ** model.fail_weight[state], model.fail_target[state]
        assert math.isclose(sum(each) + unknown, 1, rel_tol=1e-9)
    for a, b in itertools.pairwise(at.tolist()):
        state = before[a]
        for i in range(a, b):
            assert state == before[i]
            one, state = model.read(np.array([state]), np.array([word[i]]))
            state = state[0]
            assert one[0] == total[i] and state == after[i]


def test_lm_beats_its_base_on_held_out_text(spark):
    r = random.Random(2)
    follow = {w: r.choices(range(60), k=4) for w in range(60)}

    def text():
        w, out = r.randrange(60), []
        for _ in range(40):
            out.append(f"w{w}")
            w = r.choice(follow[w])
        return " ".join(out)

    rows = lm.score(documents(spark, [text() for _ in range(400)]), (20.0, 10.0)).where("held_out").agg(F.sum("base_score"), F.sum("score"), F.sum("n_tokens")).first()
    assert rows[1] / rows[2] > rows[0] / rows[2] + 0.5


def test_lm_rows_that_repeat(spark):
    df = spark.createDataFrame([(None, "a b a")] * 5 + [(4, "a c")] * 3, "doc_id long, text string").repartition(3)
    rows = lm.op7_lm(df).collect()
    assert len(rows) == 8 and len({tuple(x) for x in rows}) == 2 and {x["train_tokens"] for x in rows} == {5 * 4 + 3 * 3}


def test_lm_blobs():
    keys = np.unique(np.random.default_rng(1).integers(1 << 50, 1 << 60, 1000).astype(np.uint64))
    assert (lm.unpack_keys(lm._stretch(lm._squeeze(lm.pack_keys(keys, 1 << 50))), 1 << 50) == keys).all()
    counts = np.array([0, 1, 254, 255, 256, 1 << 40])
    assert lm.unpack_counts(lm.pack_counts(counts)).tolist() == counts.tolist() and lm.unpack_counts(lm.pack_counts(counts[:0])).tolist() == []
    assert [f for f, _, _ in lm.cut(np.array([0, 1 << 62, (1 << 64) - 1], np.uint64), 3, 64)] == [0, 2] and lm.cut(keys[:0], 3, 60) == []


def brute_quality(text):
    text = text or ""
    w = words(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_quality(spark):
    texts = [*odd_texts(), "a b c a b c a b c\n" * 30, "x ### | <> $ %\n\nx ### | <> $ %"]
    rows = got(quality.op8_quality(documents(spark, texts)))
    for i, t in enumerate(texts):
        want = brute_quality(t)
        x = rows[i]
        assert tuple(x[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want
        assert x["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (x["base_failed"] and x["kept"])
    clean = got(quality.op8_quality(documents(spark, ["An ordinary sentence goes on for a while, number after number, and says something. " + " ".join(vocabulary(80, s)) for s in range(9)])))
    assert all(x["kept"] for x in clean.values())
    assert quality.op8_quality(documents(spark, texts).where("false")).count() == 0


def test_rule_order(spark):
    """Best rejection per cost first, counted over the rows that are left; a cascade's verdict doesn't depend on it."""
    rows = spark.createDataFrame([(i, "x" * 50) for i in range(100)], "n int, text string")
    known = {"heavy": quality.Statistic(F.length("text")), "light": quality.Statistic(F.col("n")), "twice": quality.Statistic(F.col("heavy"), ("heavy",))}
    costs = {"heavy": 100.0, "light": 0.9, "twice": 1.9}
    rules = {
        "dear": quality.Rule(F.col("n") < 60, ("heavy",)),
        "cheap": quality.Rule(F.col("light") < 30, ("light",)),
        "same": quality.Rule(F.col("light") < 29, ("light",)),
        "late": quality.Rule(F.col("n") >= 90),
        "shared": quality.Rule((F.col("twice") > 0) & F.col("n").between(60, 64), ("twice",)),
        "unknown": quality.Rule(F.lit(None).cast("boolean")),
    }
    full = quality.text_statistics(rows, known=known)
    found = quality.rule_order(full, rules, known, costs)
    assert [x[0] for x in found] == ["late", "cheap", "dear", "shared", "same", "unknown"]
    # the first pays for nothing but its comparison; "shared" pays for what "dear" hasn't made
    assert found[0][1:] == (quality.COMPARISON, 0.1) and found[1][1:] == (1.0, 30 / 90)
    assert found[2][1:] == (100 + quality.COMPARISON, 0.5) and found[3][1] == 2.0 and found[4][1:] == (quality.COMPARISON, 0.0)
    kept = [{r["n"] for r in quality.cascade(rows, rules, order, known).where("kept").collect()} for order in ([x[0] for x in found], list(rules)[::-1])]
    assert kept[0] == kept[1] == set(range(65, 90))


def test_cascade_is_lazy(spark):
    """A statistic isn't made for rows that an earlier rule rejected, and once for all rules that need it."""
    rows = spark.createDataFrame([(i,) for i in range(20)], "n int")
    known = {"strict": quality.Statistic(F.when(F.col("n") < 5, F.raise_error(F.lit("made for a rejected row"))).otherwise(F.col("n"))), "later": quality.Statistic(F.col("strict") + 1, ("strict",))}
    rules = {"first": quality.Rule(F.col("n") < 5), "second": quality.Rule(F.col("strict") > 15, ("strict",)), "third": quality.Rule(F.col("later") == 7, ("later",))}
    judged = quality.cascade(rows, rules, rules, known)
    assert {r["n"] for r in judged.where("kept").collect()} == set(range(5, 16)) - {6}
    assert {r["n"] for r in judged.where("later is null").collect()} == set(range(5)) | set(range(16, 20))
    with pytest.raises(Exception, match="made for a rejected row"):
        quality.cascade(rows, rules, ["second", "first", "third"], known).collect()


def test_measured_costs(spark):
    """A statistic that works a hundred times as much is measured as dearer, and inner ones are charged with their user."""
    rows = spark.range(2000).select(F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(300)), lambda x: x.cast("string"))).alias("text")).cache()
    slow = F.aggregate(F.split("text", " "), F.lit(0), lambda a, x: a + F.length(F.sha2(F.concat(x, F.col("text")), 512)))
    known = {"light": quality.Statistic(F.octet_length("text")), "__inner": quality.Statistic(F.split("text", " ")), "size": quality.Statistic(F.size("__inner"), ("__inner",)), "slow": quality.Statistic(slow)}
    costs = quality.measured_costs(rows, known)
    assert set(costs) == set(known) and costs["__inner"] == 0 and min(costs.values()) >= 0
    assert costs["slow"] > 20 * max(costs["light"], 1) and costs["slow"] > costs["size"]
    assert min(quality.measured_costs(rows.where("false"), known).values()) >= 0
    rows.unpersist()


def test_good_texts(spark):
    """Rows that pass keep all their columns, named like statistics or not, and agree with the query's verdicts."""
    good = ["An ordinary sentence goes on for a while and says something. " + " ".join(vocabulary(80, s)) for s in range(4)]
    texts = [*odd_texts(), *good, good[0], "few words", "... ### " * 60]
    docs = documents(spark, texts)
    want = sorted(r["doc_id"] for r in quality.op8_quality(docs).where("kept").collect())
    wide = docs.withColumn("n_words", F.lit("mine")).withColumn("__words", F.lit(1)).withColumn("kept", F.lit("x"))
    rows = quality.good_texts(wide).collect()
    assert sorted(r["doc_id"] for r in rows) == want and len(want) >= 5
    assert {(r["n_words"], r["__words"], r["kept"]) for r in rows} == {("mine", 1, "x")} and quality.good_texts(wide).columns == wide.columns
    assert quality.good_texts(docs.where("false")).count() == 0


def test_spans(spark):
    v = vocabulary(400, 8)
    r = random.Random(6)
    sentence = lambda n: (" ".join(r.choices(v, k=n)) + ".").capitalize()
    passage = " ".join(sentence(9) for _ in range(6))
    texts = [" ".join(sentence(r.randint(1, 14)) for _ in range(12)) for _ in range(20)]
    texts[3] += "\n" + passage + "\nAnd more of it."
    texts[7] = passage + "\n" + texts[7]
    texts[9] += " " + passage.upper()
    texts += [None, "", "One.", texts[0], (passage + "\n") * 3]
    rows = got(spans.op9_spans(documents(spark, texts)))
    assert rows[3]["n_removed"] == 0 and rows[3]["text"] == texts[3] and rows[20]["text"] is None
    assert rows[7]["text"] == texts[7][len(passage) + 1 :] and rows[7]["n_removed"] == 6
    assert passage.upper() not in rows[9]["text"] and rows[23]["text"] == "" and rows[24]["text"] == ""
    first, last = rows[7]["removed"].split(",")[0], rows[7]["removed"].split(",")[-1]
    assert first.startswith("0:") and last.endswith(f":{len(passage)}")
    assert all(rows[i]["text"] == texts[i] for i in (0, 1, 2, 4, 5, 6, 8, 21, 22))


def brute_spans(texts):
    """The sentences left of each text, if every run of sentences is compared with every other."""
    cut = [re.findall(r"\S[^.]*\.", t) for t in texts]
    seen, gone = {}, [set() for _ in texts]
    for i, own in enumerate(cut):
        for a, b in itertools.combinations(range(len(own) + 1), 2):
            n = len(words(" ".join(own[a:b])))
            if (b - a >= 2 and n >= 16) or (b - a == 1 and n >= 40):
                if seen.setdefault(tuple(own[a:b]), (i, a)) != (i, a):
                    gone[i].update(range(a, b))
    return [[x for j, x in enumerate(own) if j not in bad] for own, bad in zip(cut, gone, strict=True)]


def test_spans_of_any_sentence_lengths(spark):
    r = random.Random(12)
    fresh = itertools.count()
    sentence = lambda n: " ".join(f"w{next(fresh)}" for _ in range(n)) + "."
    passages = [[sentence(n) for n in sizes] for sizes in ((45, 39), (30, 6, 7), (7, 6, 30), (3, 50, 2), (6, 6, 6), (40,), (39, 45, 1), (1,) * 16, (8, 7))]
    passages += [[sentence(r.choice([1, 3, 8, 20, 45])) for _ in range(r.randint(1, 6))] for _ in range(30)]
    texts = [" ".join(itertools.chain([sentence(5)], p, [sentence(r.randint(1, 20))] * (k % 2))) for _ in range(2) for k, p in enumerate(passages)]
    texts += [" ".join(x for p in r.sample(passages, 3) for x in p[r.randint(0, 1) :]) for _ in range(30)]
    texts.append(" ".join(passages[1] + [sentence(4)] + passages[1] + passages[0]))
    rows = got(spans.op9_spans(documents(spark, texts)))
    expected = brute_spans(texts)
    assert [words(rows[i]["text"]) for i in range(len(texts))] == [words(" ".join(x)) for x in expected]
    assert words(rows[len(passages)]["text"]) == words(expected[len(passages)][0]) and len(expected[len(passages)]) == 1


def test_spans_of_rows_that_share_an_id(spark):
    """Copies without an id, or under one id: just one of them keeps what they share."""
    r = random.Random(4)
    sentence = lambda n: " ".join(f"w{r.randrange(10**6)}" for _ in range(n)) + "."
    passage, other = " ".join(sentence(20) for _ in range(3)), " ".join(sentence(20) for _ in range(2))
    rows = [(None, passage)] * 3 + [(5, other)] * 3 + [(7, passage + " " + sentence(5)), (None, other), (None, None), (5, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_removed", F.lit("x")).repartition(4)
    found = spans.remove_repeats(df)
    assert found.columns == ["doc_id", "text", "n_sentences", "n_removed", "removed"]
    out = sorted(((x["doc_id"] or 0, x["text"], x["n_removed"]) for x in found.collect()), key=str)
    assert sum(passage in (t or "") for _, t, _ in out) == 1 and [d for d, t, _ in out if passage in (t or "")] == [7]
    assert [d for d, t, _ in out if other in (t or "")] == [5] and len(out) == len(rows)
    assert spans.op9_spans(df.where("false")).count() == 0


def test_toxicity(spark):
    r, v = random.Random(7), vocabulary(500, 2)
    bad, texts, toxic = ["nasty", "horrid", "vileone"], [], []
    for i in range(400):
        w = r.choices(v, k=30)
        toxic.append(int(i % 4 == 0))
        if toxic[-1]:
            for _ in range(3):
                w[r.randrange(30)] = r.choice(bad)
        texts.append(" ".join(w))
    texts += [None, "", "you h0rr1d n.a.s.t.y thing", "quite " + " ".join(r.choices(v, k=20)), "so naaaasty and hoooorrid"]
    docs = documents(spark, texts)
    labels = spark.createDataFrame([(i, 1, t) for i, t in enumerate(toxic)] + [(3, 1, None), (None, 1, 1), (9_999, 0, 0)], "doc_id long, quality int, toxic int")
    rows = got(toxicity.op10_toxicity(docs, labels))
    held = [i for i in range(400) if rows[i]["held_out"]]
    assert held == [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([rows[i]["predicted"] == toxic[i] for i in held]) > 0.97
    assert rows[402]["score"] > 0.5 > rows[403]["score"] and rows[404]["score"] > 0.5 and rows[400]["score"] == rows[401]["score"] < 0.5
    none = toxicity.op10_toxicity(docs, labels.where("false")).collect()
    assert {x["predicted"] for x in none} == {0} or len({x["score"] for x in none}) == 1


def test_restoring():
    model = np.log(np.full((toxicity.CLASSES,) * 3, 1.0 / toxicity.CLASSES))
    assert toxicity.restore("plain,", model) == ["plain"] and toxicity.restore("2024", model) == []
    assert toxicity.restore("i.d.o", model) == ["ido"] and toxicity.restore("$t0p", model) == ["stop"]


def test_viterbi_is_exact():
    """The search against all strings of the lattice, scored from left to right."""
    r = np.random.default_rng(6)
    model = np.log(r.dirichlet(np.ones(toxicity.CLASSES) * 0.3, (toxicity.CLASSES,) * 2))
    for word in ("h3ll0", "st.up1d", "a$$", "b-a-d", "noooo", "f@@l", "i|d!ot", "x_y1"):
        lattice = toxicity.lattice_of(word)
        best = -np.inf
        for choice in itertools.product(*lattice):
            s, x, y = 0.0, 0, 0
            for piece, cost in choice:
                s -= cost
                for c in piece:
                    k = 0 if c == " " else toxicity.CLASS[c]
                    s += model[x, y, k]
                    x, y = y, k
            best = max(best, s + model[x, y, 0])
        assert math.isclose(toxicity.decode(lattice, model)[1], best)


def test_viterbi_keeps_all_states():
    """A word whose lattice has more than 64 states at a place, against the recursion from its end."""
    r = np.random.default_rng(9)
    model = np.log(r.dirichlet(np.ones(toxicity.CLASSES) * 0.3, (toxicity.CLASSES,) * 2))
    lattice = toxicity.lattice_of("++10(($2++6!2@5501")
    known = {}

    def rest(i, x, y):
        if i == len(lattice):
            return model[x, y, 0]
        if (i, x, y) not in known:
            best = -np.inf
            for piece, cost in lattice[i]:
                s, a, b = -cost, x, y
                for c in piece:
                    k = 0 if c == " " else toxicity.CLASS[c]
                    s += model[a, b, k]
                    a, b = b, k
                best = max(best, s + rest(i + 1, a, b))
            known[i, x, y] = best
        return known[i, x, y]

    assert math.isclose(toxicity.decode(lattice, model)[1], rest(0, 0, 0))
    assert max(Counter(i for i, _, _ in known).values()) > 64


def test_restoring_long_and_letterless_words(spark):
    texts = ["you are such an ass and a stupid nasty person"] * 200 + ["quite ordinary words of a text"] * 100
    model = toxicity.trigram_model(toxicity.trigram_counts(documents(spark, texts)))
    read = toxicity.Reader(model, lambda w: frozenset([w]))
    assert all(read(x.encode()) == {"ass"} for x in ("a$$", "a55", "@$$"))
    for sign in "_-./":
        assert {"stupid", "nasty"} <= read(sign.join("you are such a stupid and n@sty and ordinary person".split()).encode())
        assert {"stupid", "nasty", "person"} <= read(sign.join("stupidnastyperson").encode())
    assert read(("s-t-u-p-i-d-" * 5).strip("-").encode()) >= {"stupid"}
    assert {"stupid", "person"} <= read(b"stupid/person")
    assert {"stupid"} <= read(b"you s t u p i d person")
    assert read("你好".encode() * 15 + "，".encode() + "该死".encode() * 12) == {"你好" * 15, "该死" * 12}
    assert read(b"stu" + b"p" * 60 + b"1d") & {"stupid", "stuppid"}
    assert read(b"?! ... -- #") <= {""}
    assert sum(map(len, toxicity.restore("a1" * 20_000, model))) >= 20_000


def test_every_operator_is_registered():
    assert sorted(queries.QUERIES, key=lambda x: int(x[2:].split("_")[0])) == [n for n in queries.QUERIES if re.match(r"op\d+_", n)] or len(queries.QUERIES) == 10
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)


def test_helpers():
    from larkspend.llm import _text

    texts = [None, "", "a  b\n", "É x", " lead", "tail "]
    column = pa.array(texts)
    data, at = _text.texts(column)
    starts, ends, per_doc = _text.word_spans(data, at)
    assert [data[a:b].tobytes().decode() for a, b in zip(starts, ends, strict=True)] == [w for t in texts for w in words(t)]
    assert np.diff(per_doc).tolist() == [len(words(t)) for t in texts]
    h = _text.span_hashes(data, starts, ends)
    assert len(set(h.tolist())) == len({w for t in texts for w in words(t)})
    assert [len(x) for _, _, x, _ in _text.blocks(pa.array(["a" * 10] * 5), 25)] == [20, 20, 10]


def test_empty_documents_of_learned_operators(spark):
    """No documents, no rows; labels without documents are left alone."""
    none = documents(spark, ["some words"]).where("false")
    labels = spark.createDataFrame([(1, 1, 1), (2, 0, 0), (None, 1, None)], "doc_id long, quality int, toxic int")
    assert langid.op4_langid(none).count() == 0
    assert toxicity.op10_toxicity(none, labels).count() == 0
