"""SimHash groups, lexical search and spelling variants against brute force."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from larkspend.llm import lexical, simhash, spelling
from pyspark.sql import functions as F
from test_operators import documents, lower, odd_texts, vocabulary, words


# ---- op11


def brute_fingerprint(text):
    w = words(lower(text or ""))
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(nodes, linked):
    """(smallest reachable) of each position of ``nodes``."""
    up = list(range(len(nodes)))

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for i in range(len(nodes)):
        for j in range(i):
            if linked(nodes[i], nodes[j]):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(nodes))]


def test_simhash_equals_brute_force(spark):
    texts = odd_texts()
    r, v = random.Random(2), vocabulary(300, 2)
    base = r.choices(v, k=900)
    for _ in range(40):  # copies with one word changed, so that some are within three bits
        one = list(base)
        one[r.randrange(900)] = r.choice(v)
        texts.append(" ".join(one))
    want = [brute_fingerprint(t) for t in texts]
    comp = brute_components(want, lambda a, b: (a ^ b).bit_count() <= 3)
    got = {r["doc_id"]: r for r in simhash.op11_simhash(documents(spark, texts)).collect()}
    assert [got[i]["fingerprint"] for i in range(len(texts))] == [f"{x:016x}" for x in want]
    assert [got[i]["component_id"] for i in range(len(texts))] == comp
    assert len(set(comp)) < len(set(want)) < len(texts)


def test_every_pair_within_the_radius_meets_in_a_table():
    r = random.Random(4)
    for radius in (1, 2, 3, 4):
        masks = simhash.masks(radius)
        assert len(masks) == 2 ** (radius + 1) - 1 and all(28 <= m.bit_count() <= 44 for m in masks)
        for _ in range(3000):
            flip = sum(1 << b for b in r.sample(range(64), r.randint(0, radius)))
            assert any(not flip & m for m in masks)


def planted(n, seed):
    """Fingerprints in balls around a few centres, with chains of three bits, and others anywhere."""
    r = random.Random(seed)
    out = [r.getrandbits(64) for _ in range(n)]
    for _ in range(3):
        x = r.getrandbits(64)
        for _ in range(n):
            out.append(x ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 4))))
            if r.random() < 0.1:
                x ^= sum(1 << b for b in r.sample(range(64), 3))
    return sorted(set(out))


@pytest.mark.parametrize("most", [20_000, 5])
def test_large_buckets_are_connected_exactly(spark, most):
    fps = planted(60, 9)
    comp = brute_components(fps, lambda a, b: (a ^ b).bit_count() <= 3)
    rows = spark.createDataFrame([(simhash._signed(x),) for x in fps], "fp long").repartition(4)
    edges = [(r["a"] % 2**64, r["b"] % 2**64) for r in simhash.links(rows, 3, most).collect()]
    at = {x: i for i, x in enumerate(fps)}
    near = {frozenset((at[a], at[b])) for a, b in edges}
    # members of a large bucket are joined through a place near both; all edges stay inside brute components
    assert all(comp[i] == comp[j] for i, j in map(tuple, near))
    assert brute_components(list(range(len(fps))), lambda i, j: frozenset((i, j)) in near) == comp


def test_a_bucket_gives_as_many_edges_as_members():
    members = np.array([7 ^ 1 << i ^ 1 << j for i in range(20) for j in range(i)], np.uint64)
    a, b = simhash.stars(members, 3)
    assert len(a) == len(members) - 1 and set(a.tolist()) == {int(members[0])}


def test_simhash_ids_and_empty_tables(spark):
    rows = [(None, "a b c d"), (5, "a b c d"), (3, "A B c d"), (3, None), (None, ""), (9, " \n"), (None, "alone in here")]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, fp string, component long").repartition(2)
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["fingerprint"], r["component_id"]) for r in simhash.op11_simhash(docs).collect())
    zero, other, lone = "0" * 16, f"{brute_fingerprint('a b c d'):016x}", f"{brute_fingerprint('alone in here'):016x}"
    assert got == sorted([(True, 0, other, 3), (False, 5, other, 3), (False, 3, other, 3), (False, 3, zero, 3), (True, 0, zero, 3), (False, 9, zero, 3), (True, 0, lone, None)], key=lambda x: (x[0], x[1], x[2]))
    assert simhash.op11_simhash(docs.where("false")).count() == 0


# ---- op12


def brute_rank(rows, items, k):
    bag = [(i, lexical.terms(t)) for i, t in rows]
    bag = [(i, w, Counter(w)) for i, w in bag if w]
    n, total = len(bag), sum(len(w) for _, w, _ in bag)
    df = Counter(t for _, _, c in bag for t in c)
    out = []
    for item, text in items:
        asked = dict.fromkeys(lexical.terms(text))
        scored = []
        for i, w, c in bag:
            m = 100 - 50 + 50 * len(w) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in asked if t in c)
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("sizes", [(1 << 14, 1 << 19, 1024, 2048), (16, 1 << 19, 4, 3), (7, 40, 1, 1)])
def test_lexical_search_equals_brute_force(spark, monkeypatch, sizes):
    """With small blocks, windows and groups of items all of the skipping is at work."""
    for name, value in zip(("BLOCK_DOCS", "BLOCK_POSTINGS", "WINDOW"), sizes, strict=False):
        monkeypatch.setattr(lexical, name, value)
    texts = odd_texts()
    r, v = random.Random(8), vocabulary(60, 3)
    texts += [" ".join(r.choices(v, weights=[1 / (i + 1) for i in range(60)], k=r.randint(1, 30))) for _ in range(200)]
    rows = [(None if i % 50 == 7 else i // 2 * 2, t) for i, t in enumerate(texts)]
    items = [(i, " ".join(r.choices(v, k=r.randint(1, 12))) + "!") for i in range(9)] + [(3, texts[0]), (20, None), (21, ""), (22, "Été—ÉTÉ"), (None, "one two"), (23, "nowhere-at-all")]
    docs = spark.createDataFrame([(i, t, 1, "y") for i, t in rows], "doc_id long, text string, rank int, item string").repartition(3)
    given = spark.createDataFrame([(i, t, 2.0) for i, t in items], "item_id long, text string, score double")
    got = lexical.rank(docs, given, 10, sizes[3])
    assert sorted((tuple(r[c] for c in ("item_id", "rank", "doc_id", "score")) for r in got.collect()), key=repr) == brute_rank(rows, items, 10)


def test_search_skips_windows(monkeypatch):
    """Once documents are found whose scores no window of the long lists can reach, their lists are not read there."""
    monkeypatch.setattr(lexical, "WINDOW", 10)
    n = 1000
    doc = np.concatenate([np.arange(n), np.arange(20, 30)]).astype(np.int32)
    tf = np.concatenate([np.ones(n), np.full(10, 50)]).astype(np.int32)
    block = lexical.Block(np.full(n, 100), np.array([0, 1]), np.array([0, n, n + 10]), doc, tf, np.array([5, 9000]), n, 100 * n)
    merged = []
    monkeypatch.setattr(lexical, "_merge", lambda *a, f=lexical._merge: merged.append(len(a[2])) or f(*a))
    got, score = lexical.search(block, [0, 1], 0, 5)
    assert sorted(got.tolist()) == list(range(20, 30)) and len(set(score.tolist())) == 1 and sum(merged) <= 20


def test_lexical_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert lexical.op12_lexical(docs.where("false"), items).count() == 0 and lexical.op12_lexical(docs, items.where("false")).count() == 0
    assert lexical.op12_lexical(docs.where("text is null"), items).count() == 0


# ---- op13


def brute_words(rows, least=7):
    import re

    out = Counter()
    for i, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = lower(w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= least:
                out[w] += 1
    return {w: n for w, n in out.items() if n >= 2}


def brute_variants(n):
    drops = defaultdict(set)
    for w in n:
        for k in range(len(w)):
            drops[w[:k] + "?" + w[k + 1 :]].add(w)
    near = {w: set() for w in n}
    for group in drops.values():
        for w in group:
            near[w] |= group - {w}
    for w in n:
        for k in range(len(w)):
            short = w[:k] + w[k + 1 :]
            if short in n:
                near[w].add(short)
                near[short].add(w)
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [1024, 2])
def test_spelling_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(spelling, "BLOCK", block)
    monkeypatch.setattr(spelling, "COUNTED", 50)
    r = random.Random(6)
    base = ["".join(r.choice("abcdéÀ") for _ in range(r.randint(7, 10))) for _ in range(40)]
    rows = []
    for i in range(160):
        picked = r.choices(base, weights=[1 / (k + 1) for k in range(40)], k=25)
        for k in range(25):
            if r.random() < 0.15:
                w, at = picked[k], r.randrange(len(picked[k]))
                picked[k] = r.choice([w[:at] + w[at + 1 :], w[:at] + r.choice("abcd") + w[at + 1 :], w[:at] + r.choice("abcd") + w[at:]])
        rows.append((None if i % 40 == 3 else i // 2, r.choice([" ", ", ", "\n", "日", "1"]).join(picked)))
    # a chain of forms; words of any length; letters beside others in UTF-8
    rows += [(900 + i, " ".join(["chainaaaa"] * 600 + ["chainaaa"] * 20 + ["chainaa"])) for i in range(30)]
    rows += [(950, None), (951, ""), (952, "x" * 5000 + " " + "x" * 5001 + " " + "x" * 5000 + "y"), (953, "x" * 5000 + " " + "x" * 5001 + " " + "x" * 5000 + "y"), (954, "ÀÉÖ×÷ÿÿ ÀÉÖ×÷ÿÿ ñandúes ÑANDÚES €äöüÄÖÜß⃝"), (955, "ñandúes ñandúes €äöüÄÖÜß⃝")]
    docs = spark.createDataFrame([(i, t, "w", 1) for i, t in rows], "doc_id long, text string, word string, n int").repartition(4)
    got = sorted((tuple(x[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for x in spelling.op13_spelling(docs).collect()), key=repr)
    want = brute_variants(brute_words(rows))
    assert got == want
    assert any(x[1] and x[1] != x[2] for x in want) and sum(x[1] is not None for x in want) > 10 and any(len(x[0]) > 4000 and x[4] for x in want)


def test_cells_hold_all_near_words():
    """Words one edit apart are in the same cell or in cells of which one names the other."""
    r, classes = random.Random(1), np.arange(256) % 5
    cell = lambda w: tuple(np.bincount(classes[np.frombuffer(w.encode("latin-1"), np.uint8)], minlength=5).tolist())
    for _ in range(2000):
        w = "".join(r.choice("abcdefgh") for _ in range(7))
        at = r.randrange(7)
        v = r.choice([w[:at] + r.choice("abcdefgh") + w[at + 1 :], w[:at] + r.choice("abcdefgh") + w[at:]])
        assert (cell(v) in spelling.around(cell(w))) or (cell(w) in spelling.around(cell(v)))


def test_spelling_empty_tables(spark):
    docs = spark.createDataFrame([(1, None), (2, "too short, all")], "doc_id long, text string")
    assert spelling.op13_spelling(docs).count() == 0 and spelling.op13_spelling(docs.where(F.lit(False))).count() == 0
