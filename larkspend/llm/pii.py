"""Personal data by weak supervision: labelers vote on candidate spans, expectation-maximisation weighs them, and a
span classifier trained on its posteriors decides.

Candidates are the spans of four base formats (always kept) and looser ones of ten kinds: telephone numbers without a
country code, spelled-out addresses, national ids, bank accounts, keys and passwords, names, postal addresses and dates.
Three labelers vote yes, no or abstain on each: a format, gazetteers (``Gazetteers``, a parameter) and the words before
the span. Only counts of cells leave Spark's tasks: a cell is a span's votes, its shape and what stands around it, one of
at most ``MAX_CELLS``, however large the corpus. EM (one confusion table per labeler and kind, one prior per kind) and a
logistic regression over the cells' features run on these counts of all candidates of all texts.

Defined results: a null or empty text has no spans (``base_sha256`` of the empty string); an empty table gives an empty
table; repeated rows repeat their results; extra columns don't reach ``find``'s result and pass unchanged through
``redact``. Offsets count code points, ends exclusive. Texts are scanned whole, in time linear in their length.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import checkpoint

KINDS = ("email", "ip", "card", "phone", "national_id", "account", "secret", "name", "address", "birth_date")
EMAIL, IP, CARD, PHONE, NATIONAL_ID, ACCOUNT, SECRET, NAME, ADDRESS, BIRTH_DATE = range(len(KINDS))
N_BASE = 4

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# the look-behind skips starts inside a run of digits, from which no match can begin that the run's start didn't allow
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

# Looser candidates: (kind, pattern); the span is group 1 where there is one. Look-behinds let a match begin only where
# a word does, so that no run of characters is scanned twice.
_LOOSE = (
    (PHONE, re.compile(r"(?<![0-9+(])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])")),
    (NATIONAL_ID, re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")),
    (ACCOUNT, re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")),
    (ADDRESS, re.compile(r"(?<!\w)[0-9]+[a-z]?,? (?:[A-Z][\w'’-]* )+?(?:Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Dr|Boulevard|Blvd|Court|Square)\b\.?")),
    (ADDRESS, re.compile(r"(?<!\w)[0-9]+(?: bis)?,? (?:rue|avenue|boulevard|place|calle|avenida|plaza) (?:(?:de|du|des|la|del|los|las) )*[A-ZÀ-Þ][\w'’-]*")),
    (ADDRESS, re.compile(r"(?<!\w)[A-ZÀ-Þ][a-zà-ÿ]*(?:straße|strasse|gasse|allee|platz) [0-9]+[a-z]?(?!\w)")),
    (BIRTH_DATE, re.compile(r"(?<![0-9./-])(?:[0-9]{1,2}[./-][0-9]{1,2}[./-][0-9]{4}|[0-9]{4}-[0-9]{2}-[0-9]{2})(?![0-9/-])")),
    (SECRET, re.compile(r"(?<![A-Za-z0-9])(?=[0-9a-f]*[0-9])[0-9a-f]{32,}(?![A-Za-z0-9])")),
)
_ASSIGNED = re.compile(r"(?:passw(?:or)?d|pwd|passphrase|token|secret|api[_-]?key|contraseña|passwort|kennwort) ?[=:] ?[\"']?([^\s\"']{6,})", re.I)
_KEY = re.compile(r"(?<![A-Za-z0-9])(?:(?:AKIA|ASIA)[0-9A-Z]{16,}|(?:sk|pk|ghp|gho|xoxb|xoxp)[-_][A-Za-z0-9_-]{16,})(?![A-Za-z0-9])")
_TITLED = re.compile(r"(?<!\w)(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame|Mme|Señor|Señora|Sr|Sra)\.? ([A-ZÀ-Þ][\w'’-]*(?: [A-ZÀ-Þ][\w'’-]*)*)")
_CAPITALS = re.compile(r"(?<![\w'’-])[A-ZÀ-Þ][\w'’-]+(?: [A-ZÀ-Þ][\w'’-]+)+")
_AT = re.compile(r" ?[\[(] ?at ?[\])] ?", re.I)
_SPELLED = re.compile(r"[A-Za-z0-9-]+(?: ?(?:\.|[\[(] ?dot ?[\])]) ?[A-Za-z0-9-]+)+", re.I)
_DATE = re.compile(r"[./-]")


@dataclass(frozen=True)
class Gazetteers:
    """Well-known words of each kind; a caller may give longer lists, which travel with the tasks."""

    top_domains: frozenset = frozenset("com org net edu gov mil int info biz io co de fr es uk it nl eu us ca au jp ch at be se no".split())
    card_prefixes: tuple = ("4", "51", "52", "53", "54", "55", "34", "37", "6011", "65", "36", "38", "35")
    account_countries: frozenset = frozenset("DE FR ES GB IT NL BE AT CH SE NO DK FI IE PT PL LU".split())
    given_names: frozenset = frozenset(
        "Anna Anne Antonio Carlos Carmen Charles Claire Daniel David Elena Elizabeth Emily Emma Eva Francisco Frank George Hans Henry Isabel Jack James Jean Jennifer John José Juan Julia Karl Klaus Laura Linda Louis Lucas Luis Luise Manuel Marc Maria María Marie Martin Mary Michael Michel Monika Nicolas Olivia Patricia Paul Pedro Peter Philippe Pierre Robert Sarah Sophie Stefan Susan Thomas Ursula William Wolfgang".split()
    )
    key_prefixes: tuple = ("AKIA", "ASIA", "sk-", "sk_", "pk_", "ghp_", "gho_", "xoxb-", "xoxp-")
    street_words: tuple = ("Street", "Avenue", "Road", "Lane", "Drive", "Boulevard", "Square", "rue", "avenue", "boulevard", "calle", "avenida", "plaza", "straße", "strasse", "gasse", "allee", "platz")


GAZETTEERS = Gazetteers()
CONTEXT = {
    EMAIL: re.compile(r"e-?mail|contact|write|reach|address|correo|courriel|schreib", re.I),
    IP: re.compile(r"\bip\b|host|server|address|login|client", re.I),
    CARD: re.compile(r"card|visa|master|amex|credit|karte|carte|tarjeta", re.I),
    PHONE: re.compile(r"call|phone|tel|mobile|fax|cell|anruf|appel|llam", re.I),
    NATIONAL_ID: re.compile(r"ssn|social|security|id\b|tax|passport", re.I),
    ACCOUNT: re.compile(r"iban|account|bank|konto|compte|cuenta", re.I),
    SECRET: re.compile(r"passw|pwd|token|secret|key|credential|login|contraseña|kennwort", re.I),
    NAME: re.compile(r"name|called|sincerely|regards|signed|dear|heiß|llam|appell|\b(?:mr|mrs|ms|dr|prof|herr|frau|mme|sra?)\b", re.I),
    ADDRESS: re.compile(r"live|address|resid|ship|deliver|visit|wohn|adresse|domicil|direcci", re.I),
    BIRTH_DATE: re.compile(r"born|birth|dob\b|geboren|geburt|naci|\bnée?\b|naissance", re.I),
}
AGAINST = re.compile(r"version|release|isbn|order|invoice|chapter|section|page|part no|serial|build|commit|sha|md5|checksum", re.I)
MAX_CELLS = len(KINDS) * 27 * 6 * 4 * 2 * 4 * 2


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d)
        total += n if i % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the four base formats, leftmost and non-overlapping within a kind."""
    found = []
    last = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            found.append((start, 0, m.end()))
            last = m.end()
            at = text.find("@", last)
        else:
            at = text.find("@", at + 1)
            last = max(last, start)
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split(".")):
                found.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            if len(m[0]) >= 14:
                digits = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    found.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                    found.append((m.start(), 3, m.end()))
    return sorted(found)


def loose_spans(text: str, base: list[tuple[int, int, int]], lists: Gazetteers = GAZETTEERS) -> list[tuple[int, int, int]]:
    """Candidates beyond the base formats, none overlapping a base span or an earlier candidate."""
    more = []
    if _DIGIT.search(text):
        more = [(m.start(), kind, m.end()) for kind, pattern in _LOOSE for m in pattern.finditer(text)]
        more += [(m.start(), SECRET, m.end()) for m in _KEY.finditer(text)]
    if "=" in text or ":" in text:
        more += [(m.start(1), SECRET, m.end(1)) for m in _ASSIGNED.finditer(text)]
    more += [(m.start(1), NAME, m.end(1)) for m in _TITLED.finditer(text)]
    for m in _CAPITALS.finditer(text):
        # a name begins with its given name: a sentence's first word may be capitalised before it
        start = m.start()
        for word in m[0].split(" "):
            if word in lists.given_names:
                more.append((start, NAME, m.end()))
                break
            start += len(word) + 1
    if "[" in text or "(" in text:
        last = 0
        for m in _AT.finditer(text):
            start = m.start()
            while start > last and text[start - 1] in _LOCAL:
                start -= 1
            host = _SPELLED.match(text, m.end()) if start < m.start() else None
            last = m.end()
            if host:
                more.append((start, EMAIL, host.end()))
    if not more:
        return []
    kept, last = [], -1
    # a sweep by start; base spans win over candidates
    starts = np.array([s for s, _, _ in base], np.int64)
    reach = np.maximum.accumulate(np.array([e for _, _, e in base], np.int64)) if base else starts
    for start, kind, end in sorted(more):
        i = int(np.searchsorted(starts, end))
        if start >= last and not (i and reach[i - 1] > start):
            kept.append((start, kind, end))
            last = end
    return kept


def _format_vote(span: str, kind: int, digits: str) -> str:
    if kind == NATIONAL_ID:
        return "n" if span[:3] in ("000", "666") or span[0] == "9" or span[4:6] == "00" else "-"
    if kind == ACCOUNT:
        moved = (span.replace(" ", "")[4:] + span[:4]).upper()
        return "y" if int("".join(str(int(c, 36)) for c in moved)) % 97 == 1 else "n"
    if kind == SECRET:
        # keys mix digits and letters and repeat few characters
        mixed = digits and any(c.isalpha() for c in span) and 3 * len(set(span)) >= min(len(span), 30)
        return "y" if mixed and len(span) >= 16 else "-" if mixed else "n"
    if kind == NAME:
        return "y" if " " in span else "-"
    if kind == ADDRESS:
        return "y" if len(digits) <= 5 else "n"
    if kind == BIRTH_DATE:
        parts = [int(x) for x in _DATE.split(span)]
        year, a, b = (parts[0], *parts[1:]) if parts[0] > 999 else (parts[2], *parts[:2])
        return "y" if 1900 <= year <= 2035 and min(a, b) >= 1 and min(a, b) <= 12 and max(a, b) <= 31 else "n"
    return "-"


def _list_vote(span: str, kind: int, digits: str, lists: Gazetteers) -> str:
    if kind == EMAIL:
        return "y" if re.split(r"[.\])]\s*", span.lower())[-1].strip() in lists.top_domains else "-"
    if kind == IP:
        return "n" if digits.startswith("0") or span.startswith(("127.", "255.")) else "y"
    if kind == CARD:
        return "y" if digits.startswith(lists.card_prefixes) else "n"
    if kind == PHONE:
        return "n" if len(set(digits)) < 3 else "y" if digits[-10:-7][:1] not in ("0", "1") else "-"
    if kind == NATIONAL_ID:
        return "n" if len(set(digits)) < 3 else "-"
    if kind == ACCOUNT:
        return "y" if span[:2] in lists.account_countries else "n"
    if kind == SECRET:
        return "y" if span.startswith(lists.key_prefixes) else "-"
    if kind == NAME:
        return "-" if lists.given_names.isdisjoint(span.split(" ")) else "y"
    if kind == ADDRESS:
        return "y" if any(w in span for w in lists.street_words) else "-"
    return "-"


def pattern(text: str, start: int, kind: int, end: int, is_base: bool, lists: Gazetteers = GAZETTEERS) -> str:
    """The cell of a span: kind, the three votes (y, n or -), length, share of digits, whether it cuts a word, the sign
    before it, and whether it is a base span; one character each."""
    span = text[start:end]
    digits = "".join(filter(str.isdigit, span))
    near = text[max(0, start - 40) : start]
    words = "n" if AGAINST.search(near) else "y" if CONTEXT[kind].search(near) else "-"
    share = min(3, 4 * len(digits) // max(1, len(span)))
    edge = (start > 0 and text[start - 1].isalnum()) or (end < len(text) and text[end].isalnum())
    sign = text[start - 1] if start else " "
    before = 0 if sign.isspace() else 1 if sign in "=:" else 2 if sign in "\"'([<" else 3
    return f"{kind}{'y' if is_base else _format_vote(span, kind, digits)}{_list_vote(span, kind, digits, lists)}{words}{min(5, (end - start) // 7)}{share}{int(edge)}{before}{int(is_base)}"


def candidates(text: str, lists: Gazetteers = GAZETTEERS) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    base = base_spans(text)
    return base, loose_spans(text, base, lists)


def digest(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


_SPAN = "array<struct<start:int,kind:int,end:int,pattern:string>>"


def extract(docs: DataFrame, lists: Gazetteers = GAZETTEERS) -> DataFrame:
    """doc_id, base_sha256, spans with their patterns (base first) for each row: one pass over whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("pattern", pa.string())]))
        for batch in batches:
            digests, spans = [], []
            for low in range(0, batch.num_rows, 256):
                for text in batch.column(1).slice(low, 256).to_pylist():
                    text = text or ""
                    base, more = candidates(text, lists)
                    digests.append(hashlib.sha256(digest(base).encode()).hexdigest())
                    spans.append([{"start": s, "kind": k, "end": e, "pattern": pattern(text, s, k, e, b, lists)} for part, b in ((base, True), (more, False)) for s, k, e in part])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.string()), pa.array(spans, kind)], ["doc_id", "base_sha256", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, base_sha256 string, spans {_SPAN}")


#: Pseudo-counts of a labeler's votes (yes, no, abstain) on spans that aren't personal data, and on spans that are: they
#: call a labeler better than chance, which keeps the two classes from swapping.
PRIOR = np.array([[1.0, 4.0, 5.0], [4.0, 1.0, 5.0]])


def expectation(n: np.ndarray, kinds: np.ndarray, votes: np.ndarray, post: np.ndarray) -> tuple[np.ndarray, float]:
    """One round of EM: tables and priors that fit ``post``, then the cells' new posteriors under them, and the log of
    the counts' likelihood times the priors' densities."""
    weight = np.stack([n * (1 - post), n * post])
    prior = np.stack([np.bincount(kinds, w, len(KINDS)) for w in weight]) + 1.0
    prior /= prior.sum(0)
    log, density = np.log(prior[:, kinds]), float(np.log(prior).sum())
    for j in range(votes.shape[1]):
        table = np.stack([np.bincount(kinds * 3 + votes[:, j], w, 3 * len(KINDS)).reshape(-1, 3) for w in weight]) + PRIOR[:, None]
        table /= table.sum(2, keepdims=True)
        log += np.log(table[:, kinds, votes[:, j]])
        density += float((PRIOR[:, None] * np.log(table)).sum())
    both = np.logaddexp(log[0], log[1])
    return np.exp(log[1] - both), float((n * both).sum()) + density


def reliabilities(counts: Counter, rounds: int = 50) -> dict[str, float]:
    """EM over cells: the posterior that a span of each cell is personal data."""
    if not counts:
        return {}
    keys = sorted(counts)
    n = np.array([counts[k] for k in keys], float)
    kinds = np.array([int(k[0]) for k in keys])
    votes = np.array([["yn-".index(c) for c in k[1:4]] for k in keys])
    post = 1 / (1 + np.exp(-1.5 * ((votes == 0).sum(1) - (votes == 1).sum(1)) - 0.5))
    for _ in range(rounds):
        post, _ = expectation(n, kinds, votes, post)
    return dict(zip(keys, post.tolist(), strict=True))


def _features(cell: str) -> list[tuple]:
    """Kind, votes, shape and surroundings, the votes and the sign before also for each kind on its own."""
    own = [(j, c) for j, c in enumerate(cell[:8])]
    return own + [(j, c, cell[0]) for j, c in own if j in (1, 2, 3, 7)]


def train_classifier(counts: Counter, posterior: dict[str, float], rounds: int = 300) -> dict[tuple, float]:
    """Weights of a logistic regression over the features of spans, trained on the posteriors."""
    keys = sorted(counts)
    seen = {x: i for i, x in enumerate(sorted({f for k in keys for f in _features(k)}, key=str))}
    x = np.zeros((len(keys), len(seen) + 1))
    x[:, -1] = 1
    for i, k in enumerate(keys):
        x[i, [seen[f] for f in _features(k)]] = 1
    weight = np.log1p(np.array([counts[k] for k in keys], float))
    goal = np.array([posterior[k] for k in keys])
    w = np.zeros(x.shape[1])
    for _ in range(rounds if keys else 0):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w += 0.5 * (x.T @ (weight * (goal - p)) / weight.sum() - 1e-3 * w)
    return {f: float(w[i]) for f, i in seen.items()} | {(): float(w[-1])}


def probability(weights: dict[tuple, float], cell: str) -> float:
    x = weights[()] + sum(weights.get(f, 0.0) for f in _features(cell))
    return float(1 / (1 + np.exp(-np.clip(x, -30, 30))))


def accepted(found: DataFrame) -> list[str]:
    """Cells that the trained classifier takes for personal data, from the counts of all cells."""
    cells = found.select(F.explode("spans.pattern").alias("p")).groupBy("p").count().collect()
    counts = Counter({r["p"]: r["count"] for r in cells})
    weights = train_classifier(counts, reliabilities(counts))
    return sorted(k for k in counts if probability(weights, k) >= 0.5)


def op3_pii(docs: DataFrame) -> DataFrame:
    """The contract's columns, and n_more: accepted spans beyond the base ones."""
    found = checkpoint(extract(docs))
    good = accepted(found)
    base = F.filter("spans", lambda x: x["pattern"].endswith("1"))
    all_spans = F.array_sort(F.filter("spans", lambda x: x["pattern"].endswith("1") | x["pattern"].isin(good)))
    name = F.array(*map(F.lit, KINDS))
    text = F.array_join(F.transform(all_spans, lambda x: F.concat_ws(":", F.get(name, x["kind"]), x["start"], x["end"])), ",")

    def count(k: int):
        return F.size(F.filter(base, lambda x: x["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")

    counts = [count(k) for k in range(N_BASE)]
    more = (F.size(all_spans) - F.size(base)).cast("long").alias("n_more")
    return found.select("doc_id", *counts, "base_sha256", text.alias("spans"), more)


def redact(docs: DataFrame, text: str = "text", lists: Gazetteers = GAZETTEERS) -> DataFrame:
    """``docs`` with every base span and accepted span of the text replaced by its kind in brackets."""
    good = frozenset(accepted(extract(docs.select("doc_id", text).withColumnRenamed(text, "text"), lists)))

    @F.pandas_udf("string")
    def clean(column):
        return column.map(one, na_action="ignore")

    def one(whole: str) -> str:
        base, more = candidates(whole, lists)
        spans = base + [s for s in more if pattern(whole, s[0], s[1], s[2], False, lists) in good]
        if not spans:
            return whole
        parts, last = [], 0
        for start, kind, end in sorted(spans):
            if end <= last:
                continue
            parts += [whole[last : max(start, last)], f"[{KINDS[kind].upper()}]"] if start >= last else []
            last = max(last, end)
        return "".join([*parts, whole[last:]])

    out = docs.withColumn(text, clean(F.col(text)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length(text).cast(docs.schema["n_chars"].dataType), F.col("n_chars")))
    return out.select(*docs.columns)
