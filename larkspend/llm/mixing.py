"""Mixing sources to target weights: every source gives its share of words, by repeating or by leaving out documents.

Sources, in code-point order with null last, weigh 1, 2, 3, repeating, and share the total size by weight; a target
stops at ``most`` times its source's size and what is left over goes to the others by weight, until none is above.
Inside a source, documents stand in the order of a hash-random key; the key's range is cut into buckets, bucket sums
give each bucket's offset, and a running sum inside a bucket gives each document's place. A source's rounded target is
whole epochs plus a rest: each document is taken once an epoch, and the rest cuts at its exact word in the next one.

Defined results: a null text has size 0 and a document without words is taken with 0 words; null sources are one
source; a table without words gives targets of 0; equal doc_ids share a key and stand by size; rows without a doc_id have
their text's hash instead; extra columns are ignored by ``shares`` and pass through ``mixed_documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._store import checkpoint
from ._text import WORD

MOST_EPOCHS = 3
WEIGHTS = 3
BUCKET_ROWS = 1000


def targets(sizes: DataFrame, most: int = MOST_EPOCHS) -> DataFrame:
    """source, source_size, target for each source, from its documents' sizes. The windows run over one row a source."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    per = per.withColumn("weight", (F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1) % WEIGHTS + 1)
    # by rising size per weight, the first k sources are capped; each later one would only lower the level, so the
    # level of the first source that isn't capped is the largest of those that fit
    before = Window.orderBy(F.col("source_size") / F.col("weight"), F.asc_nulls_last("source")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    level = (F.sum("source_size").over(every) - most * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    per = per.withColumn("level", level)
    per = per.withColumn("level", F.max(F.when(F.col("level") * F.col("weight") <= most * F.col("source_size"), F.col("level"))).over(every))
    return per.select("source", "source_size", F.round(F.least(most * F.col("source_size").cast("double"), F.col("level") * F.col("weight")), 6).alias("target"))


def _order_key(seed: str) -> Column:
    """Hash-random, from the id; rows without one are told apart by their texts."""
    own = F.concat(F.lit("null:"), F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), own)))


def _size() -> Column:
    return F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(WORD), 0)).cast("long")


def shares(docs: DataFrame, most: int = MOST_EPOCHS, seed: str = "mix", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, source_size, target, taken for each row of ``docs``; ``keep`` names columns that go along."""
    own = docs.select(F.struct("doc_id", *keep).alias("__row"), F.col("doc_id").alias("id"), "source", _size().alias("size"), _order_key(seed).alias("key"))
    sizes = own.select("source", "size", "key")
    # numbers only, so that the statistics read texts once; without ``keep`` they are all that is needed
    if not keep:
        own = checkpoint(own)
        sizes = own.select("source", "size", "key")
    else:
        sizes = checkpoint(sizes)
    buckets = max(1, min(1 << 24, sizes.count() // BUCKET_ROWS))
    bucket = F.floor(F.conv(F.substring("key", 1, 6), 16, 10).cast("long") * buckets / (1 << 24))
    name = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("null"))
    sums = sizes.groupBy(name.alias("name"), "source", bucket.alias("bucket")).agg(F.sum("size").alias("bucket_size"))
    offsets = sums.withColumn("offset", F.coalesce(F.sum("bucket_size").over(Window.partitionBy("name").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    goal = targets(sizes, most).select(name.alias("name"), "source_size", "target")
    offsets = offsets.join(goal, "name").select("name", "bucket", "offset", "source_size", "target")
    place = F.col("offset") + F.coalesce(F.sum("size").over(Window.partitionBy("name", "bucket").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    budget = F.floor(F.col("target") + 0.5)
    placed = own.withColumn("name", name).withColumn("bucket", bucket).join(offsets, ["name", "bucket"]).withColumn("place", place)
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    rest = budget - epochs * F.col("source_size")
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("place")))
    numbers = placed.select("__row", "size", "source_size", "target", taken.cast("long").alias("taken"))
    return numbers if keep else numbers.select("__row.doc_id", "size", "source_size", "target", "taken")


def op2_mixing(docs: DataFrame) -> DataFrame:
    return shares(docs)


def mixed_documents(docs: DataFrame, most: int = MOST_EPOCHS) -> DataFrame:
    """The mix itself, with the columns of ``docs``: a row once for each whole repeat, and cut after its last taken word
    where the budget ends inside it. Rows stay whole on their way through the prefix sums, so each keeps its own share,
    also where rows have the same doc_id or none."""
    names = docs.columns
    joined = shares(docs, most, keep=tuple(x for x in names if x != "doc_id"))
    size, taken = F.col("size"), F.col("taken")
    whole = F.when(size > 0, F.floor(taken / size)).otherwise(0).cast("int")
    rest = F.when(size > 0, taken % size).otherwise(0).cast("int")
    copies = F.concat(F.array_repeat(F.lit(-1), whole), F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<int>")))
    one = joined.select("__row", F.explode(copies).alias("__part"))
    old = F.col("__row.text")
    cut = F.expr(r"array_join(slice(filter(split(coalesce(__row.text, ''), '[\\x20\\x09-\\x0D]+'), x -> x <> ''), 1, greatest(__part, 0)), ' ')")
    text = F.when(F.col("__part") < 0, old).otherwise(cut)
    made = {"text": text}
    if "n_chars" in names:
        made["n_chars"] = F.when(F.col("__part") < 0, F.col("__row.n_chars")).otherwise(F.length(cut).cast(docs.schema["n_chars"].dataType))
    return one.select(*(made.get(x, F.col(f"__row.`{x}`")).alias(x) for x in names))


OP2_SQL = r"""
with d as (select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size,
    md5('mix:' || coalesce(cast(doc_id as varchar), 'null:' || md5(coalesce(text, '')))) as key from documents),
s as (select source, cast(sum(size) as bigint) as source_size from d group by source),
w as (select *, (row_number() over (order by source nulls last) - 1) % 3 + 1 as weight from s),
l as (select *, (sum(source_size) over () - 3 * coalesce(sum(source_size) over b, 0)) / (sum(weight) over () - coalesce(sum(weight) over b, 0)) as level from w
    window b as (order by source_size / weight, source nulls last rows between unbounded preceding and 1 preceding)),
t as (select source, source_size, round(least(cast(3 * source_size as double), weight * max(case when level * weight <= 3 * source_size then level end) over ()), 6) as target from l),
p as (select doc_id, size, source_size, target, cast(floor(target + 0.5) as bigint) as budget,
    coalesce(sum(size) over (partition by d.source order by key, doc_id, size rows between unbounded preceding and 1 preceding), 0) as place
    from d join t on d.source is not distinct from t.source),
e as (select *, case when source_size > 0 then budget // source_size else 0 end as epochs from p)
select doc_id, size, source_size, target,
    cast(epochs * size + greatest(0, least(size, budget - epochs * source_size - place)) as bigint) as taken from e
"""
