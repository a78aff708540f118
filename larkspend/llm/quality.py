"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Rules are conditions on statistics of a text (``statistics``); each names the statistics that it needs. ``measured_costs``
times every statistic on a sample, the fixed time of a job taken off; ``rule_order`` puts the rule first that rejects the
largest share of the sample's rows per microsecond, counts the next one's rejections over the rows left, and charges it
only with statistics that no earlier rule has made. ``cascade`` then makes statistics step by step, each once and only for
rows that every earlier rule let through. Times differ from run to run, so the order may; verdicts never depend on it.

Defined results: a null text counts as empty (no words, no lines); an empty table gives an empty table; rows are judged
one by one, so repeated rows repeat their results; columns of the input that aren't named stay out of the result of
``op8_quality`` and pass through ``text_statistics``, ``cascade`` and ``good_texts`` (the first two replace columns of the
names they add).
"""

from __future__ import annotations

import time
from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import checkpoint

BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
SEPARATOR = r"[\x20\x09-\x0D]+"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SAMPLE_ROWS = 2000

#: Microseconds that comparing made statistics takes a row, so that no rule is free.
COMPARISON = 0.1

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Statistic:
    """A column made of a text and of the statistics ``needs``. Names that begin with ``__`` don't leave this module."""

    made: Column
    needs: tuple[str, ...] = ()


@dataclass(frozen=True)
class Rule:
    """A true ``rejects`` rejects the row, a null one doesn't."""

    rejects: Column
    needs: tuple[str, ...] = ()


def statistics(text: str = "text") -> dict[str, Statistic]:
    """What rules may ask of a text, every statistic after those it needs.

    A document's windows are compared inside its own row, by one sort of their hashes, and only if some hash occurs twice.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    core = F.btrim(whole, F.lit(BLANKS))
    # inside higher-order functions, element access is by SQL text: it keeps the array a plain attribute
    windows = F.expr("case when n_words >= 3 then transform(sequence(0, cast(n_words as int) - 3), i -> xxhash64(__words[i], __words[i + 1], __words[i + 2])) end")
    ordered = F.expr("case when size(array_distinct(__windows)) < size(__windows) then sort_array(transform(__windows, (g, i) -> struct(g as g, i as i))) end")
    starts = F.expr(
        "case when __ordered is not null then sort_array(transform(filter(__ordered, (x, k) -> (k > 0 and __ordered[greatest(k - 1, 0)].g = x.g) or (k + 1 < size(__ordered) and __ordered[least(k + 1, size(__ordered) - 1)].g = x.g)), x -> x.i)) end"
    )
    repeats = F.expr("case when __starts is null then 0L else 3L + aggregate(sequence(0, size(__starts) - 1), 0L, (a, k) -> a + case when k = 0 then 0 else least(3, __starts[k] - __starts[k - 1]) end) end")
    return {
        "__words": Statistic(F.when(core == "", F.array().cast("array<string>")).otherwise(F.split(core, SEPARATOR))),
        "n_words": Statistic(F.size("__words").cast("long"), ("__words",)),
        "word_chars": Statistic(F.length(F.array_join("__words", "")).cast("long"), ("__words",)),
        "n_symbols": Statistic(F.length(F.regexp_replace(whole, "[^#*$%&|<>]+", "")).cast("long")),
        "__lines": Statistic(F.filter(F.split(whole, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))),
        "n_word_lines": Statistic(F.size("__lines").cast("long"), ("__lines",)),
        "n_dup_lines": Statistic((F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"), ("__lines",)),
        "__windows": Statistic(windows, ("__words", "n_words")),
        "__ordered": Statistic(ordered, ("__windows",)),
        "__starts": Statistic(starts, ("__ordered",)),
        "n_repeat_words": Statistic(repeats, ("__starts",)),
        "n_letters": Statistic(F.length(F.regexp_replace(whole, r"[^\p{L}]+", "")).cast("long")),
        "n_capitals": Statistic(F.length(F.regexp_replace(whole, r"[^\p{Lu}]+", "")).cast("long")),
        "n_ellipses": Statistic(F.size(F.filter(F.split(whole, "\n"), lambda x: x.rlike(r"(\.\.\.|…)\s*$"))).cast("long")),
    }


def _closure(known: Mapping[str, Statistic], names: Iterable[str]) -> list[str]:
    """``names`` and all they need, in the order in which they can be made."""
    wanted, left = set(), list(names)
    while left:
        name = left.pop()
        if name not in wanted:
            wanted.add(name)
            left += known[name].needs
    return [name for name in known if name in wanted]


def text_statistics(docs: DataFrame, text: str = "text", known: Mapping[str, Statistic] | None = None) -> DataFrame:
    """Adds all statistics but inner ones (all long): one projection chain over each row, without any shuffle."""
    known = known or statistics(text)
    for name, statistic in known.items():
        docs = docs.withColumn(name, statistic.made)
    return docs.drop(*(name for name in known if name.startswith("__")))


def base_rules() -> dict[str, Rule]:
    """The two rules of ``base_failed``."""
    return {
        "few_words": Rule(F.col("n_words") < MIN_WORDS, ("n_words",)),
        "repeated_words": Rule(100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"), ("n_words", "n_repeat_words")),
    }


def extra_rules() -> dict[str, Rule]:
    """Rules beyond them."""
    return {
        "symbols": Rule(100 * F.col("n_symbols") > 10 * F.col("n_words"), ("n_words", "n_symbols")),
        "duplicate_lines": Rule(100 * F.col("n_dup_lines") > 30 * F.col("n_word_lines"), ("n_word_lines", "n_dup_lines")),
        "word_length": Rule((F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 20 * F.col("n_words")), ("n_words", "word_chars")),
        "few_letters": Rule(100 * F.col("n_letters") < 50 * F.col("word_chars"), ("word_chars", "n_letters")),
        "capitals": Rule(100 * F.col("n_capitals") > 50 * F.col("n_letters"), ("n_letters", "n_capitals")),
        "ellipses": Rule(100 * F.col("n_ellipses") > 30 * F.greatest(F.col("n_word_lines"), F.lit(1)), ("n_word_lines", "n_ellipses")),
    }


def measured_costs(sample: DataFrame, known: Mapping[str, Statistic], runs: int = 2) -> dict[str, float]:
    """Microseconds a row that each statistic takes beyond those it needs: the best of ``runs`` jobs over ``sample``, less
    that of a job which only reads it. ``sample`` should be stored, as it is read once a statistic and run. An inner
    statistic that only one other needs is timed with that one, at which the cost then stands."""
    rows = max(sample.count(), 1)
    users = {name: [n for n, s in known.items() if name in s.needs] for name in known}
    inner = {name for name in known if name.startswith("__") and len(users[name]) == 1}

    def seconds(name: str | None) -> float:
        plan = sample
        for n in _closure(known, [name]) if name else ():
            plan = plan.withColumn(n, known[n].made)
        plan = plan.select(name) if name else plan
        best = float("inf")
        for _ in range(runs):
            start = time.perf_counter()
            plan.write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - start)
        return best

    idle, found = seconds(None), {}
    for name in known:
        before = sum(found[n] for n in _closure(known, [name])[:-1] if n in found)
        found[name] = 0.0 if name in inner else max(0.0, (seconds(name) - idle) * 1e6 / rows - before)
    return found


def rule_order(sample: DataFrame, rules: Mapping[str, Rule], known: Mapping[str, Statistic], costs: Mapping[str, float]) -> list[tuple[str, float, float]]:
    """(name, cost, share of the rows left that it rejects), best rejection per cost first. ``sample`` holds the rules'
    statistics; one job over it gives the driver a row for each combination of verdicts."""
    seen = sample.select(*(F.coalesce(r.rejects, F.lit(False)).alias(n) for n, r in rules.items()))
    rows = seen.groupBy(*rules).agg(F.count("*").alias("__n")).collect()
    left, made, found = list(rules), set(), []
    while left:
        n = max(sum(r["__n"] for r in rows), 1)
        cost = {name: COMPARISON + sum(costs[s] for s in _closure(known, rules[name].needs) if s not in made) for name in left}
        share = {name: sum(r["__n"] for r in rows if r[name]) / n for name in left}
        best = min(left, key=lambda name: (-share[name] / cost[name], cost[name]))
        found.append((best, cost[best], share[best]))
        left.remove(best)
        made.update(_closure(known, rules[best].needs))
        rows = [r for r in rows if not r[best]]
    return found


def _always() -> Column:
    """True, but not for Spark's optimizer. Verdicts made with it aren't written out in terms of the steps before, which
    would double at every step, where a filter moves down or constraints are derived."""
    return F.monotonically_increasing_id() >= 0


def _fenced(rows: DataFrame) -> DataFrame:
    """The same rows, below which no filter moves."""
    return rows.select(F.when(_always(), F.struct("*")).alias("__fenced")).select("__fenced.*")


def cascade(docs: DataFrame, rules: Mapping[str, Rule], order: Iterable[str], known: Mapping[str, Statistic], verdict: str = "kept") -> DataFrame:
    """Adds ``verdict``, false if a rule rejects, and the statistics that the rules need, but inner ones: null in rows that
    an earlier rule had rejected before they would have been made."""
    rows = _cascade(docs, rules, order, known, verdict)
    return _fenced(rows.drop(*(name for name in known if name.startswith("__"))))


def _cascade(docs: DataFrame, rules: Mapping[str, Rule], order: Iterable[str], known: Mapping[str, Statistic], verdict: str = "kept") -> DataFrame:
    rows, made = docs.withColumn(verdict, F.lit(True)), set()
    for name in order:
        for n in _closure(known, rules[name].needs):
            if n not in made:
                rows = rows.withColumn(n, F.when(F.col(verdict), known[n].made))
                made.add(n)
        rows = rows.withColumn(verdict, F.col(verdict) & ~F.coalesce(rules[name].rejects, F.lit(False)) & _always())
    return rows


def learned_order(docs: DataFrame, rules: Mapping[str, Rule], known: Mapping[str, Statistic], sample_rows: int = SAMPLE_ROWS) -> list[str]:
    """The rules' order after about ``sample_rows`` rows of ``docs``, drawn by a fixed seed: enough to rank rules, whatever
    the table's size."""
    sample = checkpoint(docs.sample(min(1.0, sample_rows / max(docs.count(), 1)), seed=8))
    return [name for name, _, _ in rule_order(text_statistics(sample, known=known), rules, known, measured_costs(sample, known))]


def good_texts(docs: DataFrame, text: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, with their columns."""
    known, rules = statistics("__text"), base_rules() | extra_rules()
    # the rows go along as one column, so that none of theirs can clash with a statistic
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row"), F.col(f"`{text}`").alias("__text"))
    judged = _cascade(rows, rules, learned_order(rows.select("__text"), rules, known, sample_rows), known)
    return _fenced(judged.select("__row", "kept")).where("kept").select("__row.*")


def op8_quality(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept for each row. Counts that the
    cascade didn't need for its verdict are made after it, as the result reports them for every row."""
    docs = docs.select("doc_id", "text")
    known, base = statistics(), base_rules()
    rules = base | extra_rules()
    judged = _cascade(docs, rules, learned_order(docs.select("text"), rules, known, sample_rows), known)
    judged = judged.withColumn("__lacks", F.greatest(*(F.col(c).isNull() for c in COUNTS)))
    for name in _closure(known, COUNTS):
        judged = judged.withColumn(name, F.when(F.col("__lacks"), known[name].made).otherwise(F.col(name)))
    failed = base["few_words"].rejects | base["repeated_words"].rejects
    return _fenced(judged.select("doc_id", *COUNTS, failed.alias("base_failed"), "kept"))


#: The same in DuckDB. All rules are written out, since their order doesn't matter.
OP8_SQL = r"""
with w as (select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from documents),
g as (select *, len(w) as n, case when len(w) >= 3 then list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) else [] end as g from w),
numbered as (select row_number() over () as r, * from g),
windows as (select r, unnest(g) as gram, unnest(range(len(g))) as i from numbered),
dup as (select r, i from windows qualify count(*) over (partition by r, gram) > 1),
covered as (select r, count(distinct i + k) as c from dup, (values (0), (1), (2)) as t(k) group by r),
base as (select doc_id, text, cast(n as bigint) as n_words, cast(length(array_to_string(w, '')) as bigint) as word_chars,
    cast(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) as bigint) as n_symbols,
    cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines, cast(coalesce(c, 0) as bigint) as n_repeat_words, len(lines) as n_lines,
    length(regexp_replace(text, '[^\p{Lu}]+', '', 'g')) as upper, length(regexp_replace(text, '[^\p{L}]+', '', 'g')) as letters,
    len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '(\.\.\.|…)\s*$'))) as dots
    from numbered left join covered using (r))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
    not (n_words < 50 or 100 * n_repeat_words > 50 * n_words or 100 * n_symbols > 10 * n_words or 100 * n_dup_lines > 30 * n_lines
      or word_chars < 2 * n_words or word_chars > 20 * n_words or 100 * upper > 50 * letters or 100 * letters < 50 * word_chars
      or 100 * dots > 30 * greatest(n_lines, 1)) as kept
from base
"""
