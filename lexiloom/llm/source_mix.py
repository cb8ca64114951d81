"""Mixing sources to target weights: weighted fair queueing, in DataFrame terms only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.session import materialize

WEIGHTS = (3, 1, 2)
SHARE = 1.5
EPOCHS = 2
ROOTS = 0.25
MOST_BROADCAST = 20_000
BLANKS = " \t\n\u000b\f\r"


def word_count(text: Column) -> Column:
    """How many runs of anything but ASCII white space; null: none. The text
    shrinks to a mark for each, so no list of words is held."""
    marks = F.regexp_replace(F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS)), r"[^\x20\x09-\x0D]++[\x20\x09-\x0D]*+", "x")
    return F.char_length(marks).cast("long")


def _before(df: DataFrame, keys: list[str], order: str) -> Column:
    """The sizes of all rows before a row's own."""
    return F.sum("size").over(Window.partitionBy(*keys).orderBy(order)) - F.col("size")


def _known(df: DataFrame) -> DataFrame:
    """The same rows, to be broadcast if they are few."""
    return F.broadcast(df) if df.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST else df


def numbered_sources(sources: DataFrame) -> DataFrame:
    """Sources with their place in code-point order, null last, as ``number``:
    dealt by ranges, each range numbered from what the ones before it hold."""
    ranges = materialize(sources.repartitionByRange(F.asc_nulls_last("source")).withColumn("range", F.spark_partition_id()), "mix-sources")
    sizes = ranges.groupBy("range").agg(F.count("*").alias("size"))
    sizes = sizes.select("range", _before(sizes, [], "range").alias("first"))
    place = F.row_number().over(Window.partitionBy("range").orderBy(F.asc_nulls_last("source")))
    return ranges.join(sizes, "range").withColumn("number", F.col("first") + place - 1).drop("range", "first")


def source_targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """(source, size) -> number, source, source_size, n_docs, target: ``share``
    of all sizes by weight, in turn over the sources in code-point order; no
    target is above ``epochs`` times its source, and what is over goes to the
    others by weight, until none is above."""
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    turns = F.array(*(F.lit(float(w)) for w in weights))
    sources = numbered_sources(sources).withColumn("weight", F.get(turns, (F.col("number") % len(weights)).cast("int")))
    sources = materialize(sources.withColumn("most", F.col("source_size") * epochs), "mix-weights")
    budget = share * (sources.agg(F.sum("source_size")).first()[0] or 0)
    level, full = 0.0, -1
    while True:
        over = F.col("most") <= F.col("weight") * level
        filled, free, n = sources.agg(F.sum(F.when(over, F.col("most"))), F.sum(F.when(~over, F.col("weight"))), F.count_if(over)).first()
        if n == full or not free:
            break
        level, full = max(level, (budget - (filled or 0)) / free), n
    target = F.least(F.col("most").cast("double"), F.col("weight") * level) if full >= 0 else F.col("most").cast("double")
    return sources.select("number", "source", "source_size", "n_docs", target.alias("target"))


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """(doc_id, text, source) -> doc_id, source, size, source_size, target,
    number, slice, place, epoch, finish, start, taken: every copy of every
    document in the order of the mix.

    Sizes are words. Each source queues its documents in a shuffled order, given
    by a hash of id and text, ``epochs`` times over. A copy's virtual finish time
    is the words its source has queued up to its end, divided by the source's
    target, so at any time all sources have given about the same part of their
    targets. The mix is all copies by finish time, up to the sum of all targets:
    ``start`` is a copy's place in it in words, ``taken`` how many of its words
    the mix takes: all, none, or a part of the one copy that the budget cuts. A
    source is off its target by no more than its last document and what others'
    last documents leave over.

    No queue is sorted in one task: a source's queue is cut by hash into slices,
    and the mix by finish time into ranges; words arrive evenly over time, so
    ranges of time are ranges of like size that need no sampling. Sums by slice
    and range are carried on. The numbers of slices and of their rows both grow
    with the root of the documents' number. Texts are read once; afterwards only
    sizes are shuffled, twice. Sums by source or slice are
    broadcast up to 20,000 of them, else joined.

    A null text has size 0. Documents without words take no place in the mix and
    have no row here. A null source is one source, the last; a null doc_id is
    kept; repeated rows are queued each and change places only with their like;
    other columns are ignored; an empty table gives an empty table.
    """
    sized = _sized(docs)
    return _mixed(sized, materialize(source_targets(sized, weights, share, epochs), "mix-targets"), epochs)


def _sized(docs: DataFrame) -> DataFrame:
    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), F.md5(F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("doc_id", "text")))).alias("hash"))
    return materialize(rows, "mix-sizes")


def _mixed(sized: DataFrame, sources: DataFrame, epochs: int) -> DataFrame:
    queued = sized.where("size > 0").join(_known(sources.withColumnRenamed("source", "own")), F.col("source").eqNullSafe(F.col("own"))).drop("own")
    slices = F.ceil(ROOTS * F.sqrt("n_docs"))
    part = F.conv(F.substr("hash", F.lit(1), F.lit(13)), 16, 10).cast("double") / float(1 << 52)
    queued = queued.withColumn("slice", F.least(F.floor(part * slices), slices - 1))
    line = Window.partitionBy("number", "slice").orderBy("hash", "doc_id", "size")
    queued = queued.select("*", F.row_number().over(line).alias("place"), F.sum("size").over(line.rowsBetween(Window.unboundedPreceding, 0)).alias("until"))
    queued = materialize(queued.drop("hash"), "mix-queues")

    slice_sums = queued.groupBy("number", "slice").agg(F.sum("size").alias("size"))
    slice_sums = slice_sums.select("number", "slice", _before(slice_sums, ["number"], "slice").alias("queued"))
    copies = queued.join(_known(slice_sums), ["number", "slice"]).withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    copies = copies.withColumn("finish", (F.col("epoch") * F.col("source_size") + F.col("queued") + F.col("until")) / F.col("target"))
    n_ranges = math.ceil(ROOTS * math.sqrt(sized.count()))
    copies = copies.withColumn("range", F.floor(F.col("finish") * n_ranges)).drop("n_docs", "until", "queued")

    range_sums = copies.groupBy("range").agg(F.sum("size").alias("size"))
    range_sums = range_sums.select("range", _before(range_sums, [], "range").alias("given"))
    order = Window.partitionBy("range").orderBy("finish", "number", "epoch", "slice", "place")
    budget = F.lit(float(sources.agg(F.sum("target")).first()[0] or 0))
    ordered = copies.withColumn("start", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).join(_known(range_sums), "range")
    ordered = ordered.withColumn("start", F.col("start") + F.col("given")).drop("range", "given")
    left = F.floor(budget + 0.25) - F.col("start")  # targets are doubles; a budget is whole or half
    return ordered.withColumn("taken", F.greatest(F.lit(0), F.least(F.col("size"), left)).cast("long"))


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """(doc_id, text, source) -> doc_id, size, source_size, target, taken, one
    row for each row: how many words the mix takes of each document, over all
    its copies. See ``mix_sources``; documents without words are taken 0 times."""
    sized = _sized(docs)
    sources = materialize(source_targets(sized, weights, share, epochs), "mix-targets")
    mix = _mixed(sized, sources, epochs)
    taken = mix.groupBy("number", "slice", "place").agg(*(F.first(c).alias(c) for c in ("doc_id", "size", "source_size", "target")), F.sum("taken").alias("taken"))
    empty = sized.where("size = 0").join(_known(sources.withColumnRenamed("source", "own")), F.col("source").eqNullSafe(F.col("own")))
    columns = ["doc_id", "size", "source_size", "target", "taken"]
    return taken.select(*columns).unionByName(empty.withColumn("taken", F.lit(0).cast("long")).select(*columns))


MIX_SQL = f"""
with sized as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as size, md5(coalesce(doc_id::varchar, '') || ':' || coalesce(text, '')) as hash from documents),
s as (select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) - 1 as number from sized group by source),
w as (select *, [{", ".join(f"{w}::double" for w in WEIGHTS)}][number % {len(WEIGHTS)} + 1] as weight, {EPOCHS} * source_size as most, {SHARE} * sum(source_size) over () as budget from s),
l as (select *, (budget - coalesce((select sum(b.most) from w b where b.most / b.weight < a.most / a.weight), 0)) / (select sum(b.weight) from w b where b.most / b.weight >= a.most / a.weight) as level from w a),
t as (select source, source_size, number, budget, least(most, weight * coalesce((select min_by(b.level, b.most / b.weight) from l b where b.most > b.weight * b.level), 'infinity'::double)) as target from w),
q as (select sized.*, number, source_size, target, budget, row_number() over () as rid, sum(size) over (partition by number order by hash, doc_id nulls first, size rows unbounded preceding) as until
  from sized join t on sized.source is not distinct from t.source),
c as (select *, (epoch * source_size + until) / target as finish from q, (select unnest(range({EPOCHS})) as epoch) e where size > 0),
o as (select *, sum(size) over (order by finish, number, epoch, hash, doc_id nulls first, size rows unbounded preceding) - size as start from c),
k as (select rid, sum(greatest(0, least(size, floor(budget + 0.25)::bigint - start)))::bigint as taken from o group by rid)
select doc_id, size, source_size, target::double as target, coalesce(taken, 0)::bigint as taken from q left join k using (rid)
"""
