"""How a language's sources differ: divergences of their smoothed term shares."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.llm import textbytes
from lexiloom.session import materialize, text_batches

LEAST_DOCS = 3
TOP_TERMS = 200
SPREAD = 64
MOST_BROADCAST = 20_000
COUNTED = "lang string, source string, term string, n long, d long"
RESULT = "lang string, source string, part string, item string, value long, rank int"

IS_TERM = np.zeros(256, dtype=bool)
IS_TERM[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a task's documents: occurrences and documents by language, source and
    term, and a row without a term for each group that occurs."""
    names = [x.split()[0] for x in COUNTED.split(", ")]
    groups: dict[tuple[str, str], int] = {}
    tally = textbytes.Tally()

    def given() -> Iterator[pa.RecordBatch]:
        pairs = list(groups)
        for group, terms, (n, d) in tally.rows():
            langs, sources = (pa.array([p[i] for p in pairs], pa.string()).take(pa.array(group)) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([langs, sources, terms, pa.array(n), pa.array(d)], names)

    for batch in batches:
        pairs = zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True)
        group = np.array([groups.setdefault(p, len(groups)) for p in pairs], np.int64)
        for row, data, offsets in textbytes.chunks(batch.column("text")):
            keys, at, n, start, end = textbytes.terms_of_rows(data, offsets, IS_TERM[data])
            tally.add(data, group[row + at], keys, start, end, n, np.ones(len(n)))
            if tally.full:
                yield from given()
    yield from given()
    yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in groups], pa.string()), pa.array([p[1] for p in groups], pa.string()), pa.nulls(len(groups), pa.string()), *[pa.array(np.zeros(len(groups), np.int64))] * 2], names)


def _share(n: str, m: str) -> str:
    """1 + floor(10^9 (n + 1) / m), in longs as long as m is under 9e13."""
    return f"(1 + ((({n} + 1) * 100000) div {m}) * 10000 + (((({n} + 1) * 100000) % {m}) * 10000) div {m})"


def _gap(p: str, q: str) -> str:
    return f"((({p} - {q}) * ({p} - {q})) div {q})"


def source_audit(docs: DataFrame, least: int = LEAST_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """(text, lang, source) -> lang, source, part, item, value, rank: how far
    each source of a language is from its others (part ``pair``), and which
    terms set it apart from the language as a whole (part ``term``, ``top`` of
    each source).

    Terms are counted in one pass over the texts. A language keeps those in at
    least ``least`` of its documents, each with a sparse vector of its counts by
    source. A source's share of a term is p = 1 + floor(10^9 (count + 1) / (N +
    V)), and the gap of two shares floor((p - q)^2 / q), all in whole numbers.

    Terms with the same vector have the same gaps: they are grouped, each pair
    of sources that a vector holds is evaluated once, times its terms. Where a
    source has none of a term, the gap depends on the other's count alone, and
    where both have none on neither, so these are evaluated once per distinct
    count and once per pair: what all terms would give without the counts is
    corrected by those that have one, and these by those that have both. Work
    grows with what vectors hold, not with sources squared by terms.

    Only counts by (language, term, source) are shuffled, after sums in the
    tasks. A source's terms are ranked in 64 parts by hash before its best meet,
    so no task sorts a whole source. Totals by source are broadcast up to 20,000
    of them, else joined.

    Nulls are empty strings; a group without kept terms has pairs (of value 0 if
    its language keeps none) and no terms; repeated rows are documents each;
    ties rank by item; other columns are ignored; an empty table gives an empty
    table. Terms are told apart by 64 bits of hash within a task, and by their
    text beyond.
    """
    text_batches(docs.sparkSession)
    base = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")))
    counted = base.mapInArrow(_count_terms, COUNTED).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
    vectors = counted.groupBy("lang", "term").agg(F.sum("d").alias("d"), F.sort_array(F.collect_list(F.struct("source", "n"))).alias("vector"))
    vectors = materialize(vectors.where((F.col("d") >= least) | F.col("term").isNull()).drop("d"), "source-vectors")
    held = vectors.where("term is not null")

    langs = vectors.groupBy("lang").agg(F.count("term").alias("v"), F.sum(F.expr("aggregate(vector, 0L, (s, x) -> s + x.n)")).alias("n"))
    langs = langs.select("lang", "v", F.greatest(F.lit(1), F.col("n") + F.col("v")).alias("lang_m"))
    totals = vectors.select("lang", F.inline("vector")).groupBy("lang", "source").agg(F.sum("n").alias("n")).join(langs, "lang")
    totals = materialize(totals.select("lang", "source", F.greatest(F.lit(1), F.col("n") + F.col("v")).alias("m"), "v", "lang_m"), "source-totals")
    if totals.count() <= MOST_BROADCAST:
        totals = F.broadcast(totals)
    ranked = _ranked_pairs(held, totals).unionByName(_ranked_terms(held, totals, top))
    return ranked.select(*(F.col(c.split()[0]).cast(c.split()[1]) for c in RESULT.split(", ")))


def _pair_values(held: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, source, item, value): the gaps of every two sources of a language, summed over its kept terms."""
    ours, theirs = (totals.select("lang", F.col("source").alias(x), F.col("m").alias(f"m_{x}"), *more) for x, more in (("a", ["v"]), ("b", [])))
    none_a, none_b, some_a, some_b = _share("0L", "m_a"), _share("0L", "m_b"), _share("n_a", "m_a"), _share("n_b", "m_b")

    every = ours.join(theirs, "lang").where("a != b").select("lang", "a", "b", F.expr(f"v * {_gap(none_a, none_b)}").alias("value"))

    distinct = held.groupBy("lang", "vector").agg(F.count("*").alias("times"))
    first = distinct.select("lang", "vector", "times", F.posexplode("vector").alias("at", "x")).select("lang", "vector", "times", "at", F.col("x.source").alias("a"), F.col("x.n").alias("n_a"))

    by_count = first.groupBy("lang", "a", "n_a").agg(F.sum("times").alias("times")).join(ours, ["lang", "a"]).join(theirs, "lang").where("a != b")
    by_count = by_count.groupBy("lang", "a", "b").agg(
        F.sum(F.expr(f"times * ({_gap(some_a, none_b)} - {_gap(none_a, none_b)})")).alias("forth"),
        F.sum(F.expr(f"times * ({_gap(none_b, some_a)} - {_gap(none_b, none_a)})")).alias("back"),
    )

    both = first.where(F.col("at") + 1 < F.size("vector")).join(ours, ["lang", "a"])
    both = both.select("lang", "a", "n_a", "m_a", "times", F.inline(F.expr("slice(vector, at + 2, size(vector))")))
    both = both.withColumnsRenamed({"source": "b", "n": "n_b"}).join(theirs, ["lang", "b"])
    both = both.groupBy("lang", "a", "b").agg(
        F.sum(F.expr(f"times * ({_gap(some_a, some_b)} - {_gap(some_a, none_b)} - {_gap(none_a, some_b)} + {_gap(none_a, none_b)})")).alias("forth"),
        F.sum(F.expr(f"times * ({_gap(some_b, some_a)} - {_gap(some_b, none_a)} - {_gap(none_b, some_a)} + {_gap(none_b, none_a)})")).alias("back"),
    )
    directed = by_count.unionByName(both).select("lang", F.inline(F.expr("array(struct(a, b, forth as value), struct(b as a, a as b, back as value))")))
    return every.unionByName(directed).groupBy("lang", F.col("a").alias("source"), F.col("b").alias("item")).agg(F.sum("value").alias("value"))


def _ranked_pairs(held: DataFrame, totals: DataFrame) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return _pair_values(held, totals).select("*", F.lit("pair").alias("part"), F.row_number().over(order).alias("rank"))


def _ranked_terms(held: DataFrame, totals: DataFrame, top: int) -> DataFrame:
    rows = held.select("lang", F.col("term").alias("item"), F.expr("aggregate(vector, 0L, (s, x) -> s + x.n)").alias("lang_n"), F.inline("vector"))
    rows = rows.where("n > 0").join(totals, ["lang", "source"])
    rows = rows.select("lang", "source", "item", F.expr(_share("n", "m")).alias("p"), F.expr(_share("lang_n", "lang_m")).alias("q")).where("p > q")
    rows = rows.select("lang", "source", "item", F.expr(_gap("p", "q")).alias("value"), F.pmod(F.xxhash64("item"), F.lit(SPREAD)).alias("spread"))
    best = [F.desc("value"), F.col("item")]
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source", "spread").orderBy(*best))).where(F.col("rank") <= top)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(*best))).where(F.col("rank") <= top)
    return rows.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")


_KEPT = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

AUDIT_SQL = f"""
with d as (select row_number() over () as rid, coalesce(text, '') as text, coalesce(lang, '') as lang, coalesce(source, '') as source from documents),
w as (select rid, lang, source, unnest(regexp_extract_all({_KEPT.format("text")}, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) as term from d),
kept as (select lang, term, count(*) as lang_n from w group by lang, term having count(distinct rid) >= {LEAST_DOCS}),
n as (select lang, source, term, count(*) as n from w semi join kept using (lang, term) group by all),
v as (select lang, count(*) as v, sum(lang_n) as lang_n from kept group by lang),
g as (select d.lang, d.source, coalesce(any_value(v.v), 0)::hugeint as v, coalesce(any_value(t.n), 0)::hugeint as n, any_value(v.lang_n)::hugeint as lang_n
  from (select distinct lang, source from d) d left join v using (lang) left join (select lang, source, sum(n) as n from n group by all) t using (lang, source) group by all),
p as (select g.lang, g.source, k.term, coalesce(n.n, 0) as n, 1 + (1000000000::hugeint * (coalesce(n.n, 0) + 1)) // (g.n + g.v) as p, 1 + (1000000000::hugeint * (k.lang_n + 1)) // (g.lang_n + g.v) as q
  from g join kept k using (lang) left join n on n.lang = g.lang and n.source = g.source and n.term = k.term),
gaps as (select a.lang, a.source, b.source as item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) as value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
pairs as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(x.value, 0)::bigint as value from g a join g b on a.lang = b.lang and a.source <> b.source
  left join gaps x on x.lang = a.lang and x.source = a.source and x.item = b.source),
terms as (select lang, source, 'term' as part, term as item, (((p - q) * (p - q)) // q)::bigint as value from p where n > 0 and p > q),
ranked as (select *, row_number() over (partition by lang, source, part order by value desc, item)::int as rank from (select * from pairs union all select * from terms))
select lang, source, part, item, value, rank from ranked where part = 'pair' or rank <= {TOP_TERMS}
"""
