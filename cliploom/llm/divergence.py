"""Divergence of sources from each other and from their language, term by term and in all, with whole numbers throughout.

A term's weight p in a group is 1 + floor(SCALE * (count + 1) / (all counts + number of kept terms)); what a group with p
pays for a term against q is floor((p - q)^2 / q). The price of a pair of groups over all kept terms is never summed term by
term. By inclusion and exclusion over the terms that either group holds:

- a term that neither holds costs a constant of the pair, taken as often as there are kept terms that none of them holds;
- terms that one side holds are priced by how often it holds them: a histogram of counts for each group is enough, as the
  other side's weight is that of a count of zero;
- terms that both hold were priced on both sides: postings of equal term meet, and what they really cost replaces that.

Texts are counted in Python, task by task, before anything is shuffled; from there on all is joins and sums. A term has no
more postings than there are groups in its language, so no key grows with the documents. Sums fit 64 bits: the weights of a
group add up to SCALE plus the kept terms, so the squares of a side stay below the square of that.

Null text, language and source are empty strings; each row is a document, repeated rows and ids too. Groups without kept
terms still have a row for each pair (value 0 where a language keeps no term). Equal values rank by item, as UTF-8. Texts of
any length are counted whole; ids and other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import binary, discard, ensure_importable, stored

SCALE, LEAST, RANKS = 1_000_000_000, 3, 200
#: Bytes to letters of a term: A-Z in lower case; what is neither a letter nor beyond ASCII ends a term.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Terms that a task counts before it passes them on.
HELD = 1 << 18
#: Groups of which a table goes to every task; more of them meet by a join.
BROADCAST = 1 << 16


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs) of a task's rows, one row with a null term for each group among them."""
    counts: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def passed() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in counts.items():
            terms = [None, *(t.decode() for t in n)]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(terms)), pa.array([source] * len(terms)), pa.array(terms, pa.string()), pa.array([0, *n.values()], pa.int64()), pa.array([0, *(docs[t] for t in n)], pa.int64())], ["lang", "source", "term", "n", "docs"])
        counts.clear()

    for batch in batches:
        for text, lang, source in zip(binary(batch.column(0)), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            n, docs = counts.setdefault((lang, source), (Counter(), Counter()))
            terms = text.as_py().translate(LETTERS).split()
            n.update(terms)
            docs.update(set(terms))
        if sum(len(n) for n, _ in counts.values()) >= HELD:
            yield from passed()
    yield from passed()


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a.cast("long"), b.cast("long"))


def weight(count: Column, total: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / total), by long division in two steps, which keeps counts up to 9e13 within 64 bits."""
    high = (count + 1) * 100_000
    return _div(high, total) * 10_000 + _div(high % total * 10_000, total) + 1


def price(p: Column, q: Column) -> Column:
    return _div((p - q) * (p - q), q)


def divergence(docs: DataFrame, least: int = LEAST, ranks: int = RANKS) -> DataFrame:
    """lang, source, part, item, value, rank: what each group (lang, source) pays against each other source of its language
    (part `pair`, over all kept terms) and for each of its terms that it holds more of than its language (part `term`, the
    `ranks` dearest). A language keeps the terms of at least `least` of its documents.
    """
    spark = docs.sparkSession
    ensure_importable(spark)
    texts = docs.select(F.col("text").cast("string").alias("text"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")))
    rows = texts.mapInArrow(_counted, "lang string, source string, term string, n long, docs long")
    counts = stored(rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "term-counts")

    own = W.partitionBy("lang", "term")  # as many rows as there are groups, at most
    kept = counts.where("term is not null").withColumns({"all": F.sum("n").over(own), "in": F.sum("docs").over(own), "first": F.col("source") == F.min("source").over(own)})
    kept = stored(kept.where(F.col("in") >= least).select("lang", "source", "term", "n", "all", "first"), "term-kept")

    languages = kept.groupBy("lang").agg(F.count_if("first").alias("v"), F.sum("n").alias("n_lang"))
    sizes = kept.groupBy("lang", "source").agg(F.sum("n").alias("n_own"), F.count("*").alias("held"))
    groups = counts.where("term is null").select("lang", "source").join(languages, "lang", "left").join(sizes, ["lang", "source"], "left").na.fill(0)
    groups = stored(groups.withColumn("p0", F.when(F.col("v") > 0, weight(F.lit(0), F.col("n_own") + F.col("v")))), "term-groups")
    known = F.broadcast(groups) if groups.count() <= BROADCAST else groups

    sized = kept.join(known, ["lang", "source"])
    p, q = weight(F.col("n"), F.col("n_own") + F.col("v")), weight(F.col("all"), F.col("n_lang") + F.col("v"))
    other = known.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"), F.col("held").alias("held2"))
    unequal = F.col("source") != F.col("item")

    # every other source of a language is part of the result, so these pairs are no more than its rows
    neither = known.join(other, "lang").where(unequal & (F.col("v") > 0)).select("lang", "source", "item", ((F.col("v") - F.col("held") - F.col("held2")) * price(F.col("p0"), F.col("q0"))).alias("value"))
    none = known.join(other, "lang").where(unequal & (F.col("v") == 0)).select("lang", "source", "item", F.lit(0).cast("long").alias("value"))
    histogram = sized.groupBy("lang", "source", "n", p.alias("p")).agg(F.count("*").alias("times")).join(other, "lang").where(unequal)
    one = histogram.groupBy("lang", "source", "item").agg(F.sum(F.col("times") * price(F.col("p"), F.col("q0"))).alias("there"), F.sum(F.col("times") * price(F.col("q0"), F.col("p"))).alias("back"))

    left = sized.select("lang", "term", "source", p.alias("p"), "p0")
    right = sized.select("lang", "term", F.col("source").alias("item"), p.alias("q"), F.col("p0").alias("q0"))
    both = left.join(right, ["lang", "term"]).where(F.col("source") < F.col("item"))
    real = lambda a, a0, b, b0: F.sum(price(F.col(a), F.col(b)) - price(F.col(a), F.col(b0)) - price(F.col(a0), F.col(b)) + price(F.col(a0), F.col(b0)))
    both = both.groupBy("lang", "source", "item").agg(real("p", "p0", "q", "q0").alias("there"), real("q", "q0", "p", "p0").alias("back"))

    turned = lambda df: df.select("lang", F.explode(F.array(F.struct("source", "item", F.col("there").alias("value")), F.struct(F.col("item").alias("source"), F.col("source").alias("item"), F.col("back").alias("value")))).alias("x")).select("lang", "x.*")
    pairs = neither.union(none).union(turned(one)).union(turned(both)).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    terms = sized.select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).where("p > q").select("lang", "source", "item", price(F.col("p"), F.col("q")).alias("value"))

    rank = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", rank.alias("rank"))
    terms = terms.select("lang", "source", F.lit("term").alias("part"), "item", "value", rank.alias("rank")).where(F.col("rank") <= ranks)
    out = stored(pairs.union(terms), "divergence")
    discard(counts, kept, groups)
    return out
