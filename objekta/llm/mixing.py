"""Mixing sources to target weights by Pareto order sampling, with DataFrame functions only.

A document's size is its number of words [^\x20\x09-\x0D]+. Sources, by code point with null last, weigh 1, 2, 3 and so on
repeating (or what the caller gives); the weights share all words of the corpus. A source stops at MOST_COPIES times its
size and its excess goes to the others by weight, until none is above.

A source whose target is c times its size gives every document floor(c) whole copies, which is certain, and the rest of
its words as a Pareto sample of one further copy. A document's inclusion probability is p = min(1, k w): w is its weight, the whole part of
the square root of its size unless the caller gives a column, and k is such that the words expected, the sum of p times size, are the rest.
So documents whose k w reaches 1 are certain as well, and come first. The others are ranked by random odds over inclusion odds,
u / (1 - u) over p / (1 - p), and taken in that order until the words are as near to the rest as whole documents allow.

Nothing is sorted by source as a whole: k comes from the words by (source, weight), of which there are few (a caller's weights are rounded to three
digits); words are summed by (source, RANK_BUCKETS ranges of the rank), the running sums of at most RANK_BUCKETS rows a source find the range where the
words run out, and only that range is ordered. Sources are numbered by range partitions and shared out in rounds of sums, so that their number is not bounded either.

Defined cases: null and empty texts have size 0 and take 0 words (their copies follow the same rule); null is a source of its own; a
null id is ranked by its text alone; rows alike in id and text have one rank and are taken together; weights that are null or below 0 count as 0, which no further copy is made of; an empty table gives
an empty result; extra columns are ignored (mix) or kept (apply_mix), whatever their names. Reruns agree: u is a digest
of the seed, the id and the text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from objekta.llm.common import cut, partitions, solid, table, unused, words

WEIGHTS = (1, 2, 3)
MOST_COPIES = 3
RANK_BUCKETS = 4096
#: Bytes of the sources' plan that may be broadcast; beyond that Spark chooses the join, and splits skewed sources.
BROADCAST_BYTES = 16 << 20
#: Bytes that a source takes in the plan besides its name.
PLAN_ROW_BYTES = 120
SEED = "objekta-mix-1"


def uniform(doc_id: Column, text: Column, seed: str = SEED) -> Column:
    """A number in (0, 1) that depends on the seed, the id and the text alone."""
    key = F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("-")), F.lit(":"), F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    return (F.conv(F.substring(F.md5(key.cast("binary")), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def _weight(weight: Column | None, size: Column) -> Column:
    if weight is None:
        return F.floor(F.sqrt(size)).cast("double")
    given = F.greatest(F.coalesce(weight.cast("double"), F.lit(0.0)), F.lit(0.0))
    unit = F.pow(F.lit(10.0), F.floor(F.log10(given)) - 2)
    return F.when(given > 0, F.round(given / unit) * unit).otherwise(0.0)


def _with_sizes(documents: DataFrame, keep: list[Column], weight: Column | None, seed: str, names: tuple[str, str, str] = ("size", "u", "w")) -> DataFrame:
    """The columns keep, then size, u and w of each document. The text is split once."""
    text, given = F.col("text").cast("string"), unused(documents, "given_weight")
    first = [F.size(words(text)).cast("long").alias(names[0]), uniform(F.col("doc_id"), text, seed).alias(names[1])]
    kept = solid(documents, *keep, *first, *([] if weight is None else [weight.alias(given)]))
    w = _weight(None if weight is None else F.col(given), F.col(names[0]))
    return kept.withColumn(names[2], w).drop(given)


def rank(u: Column, w: Column, k: Column) -> Column:
    """Random odds over inclusion odds: 0 of what is certain, infinite of what is not to be taken."""
    p = F.least(F.lit(1.0), k * w)
    return F.when(p >= 1, 0.0).when(p <= 0, float("inf")).otherwise((u / (1 - u)) / (p / (1 - p)))


def _bucket(rank: Column) -> Column:
    """About as many are expected in the first half as are taken: p is the chance of a rank below 1."""
    return F.when(rank == float("inf"), RANK_BUCKETS).otherwise(F.floor(rank / (rank + 1) * RANK_BUCKETS)).cast("int")


def _numbered(by_source: DataFrame) -> DataFrame:
    """The sources with their place (from 0) in the order of code points, null last: by ranges, whose sizes are added up."""
    order = F.col("source").asc_nulls_last()
    ranges = by_source.repartitionByRange(partitions(by_source.sparkSession), order).sortWithinPartitions(order)
    ranges = cut(ranges.withColumn("id", F.monotonically_increasing_id()), "mix-sources")
    part, inside = F.shiftright("id", 33), F.col("id").bitwiseAND((1 << 33) - 1)
    before = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    offsets = ranges.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    return ranges.join(F.broadcast(offsets), part == F.col("part")).select("source", "source_size", (F.col("offset") + inside).alias("place"))


def targets(sized: DataFrame, weights: tuple = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """One row per source: source, source_size, target."""
    rows = _numbered(sized.groupBy("source").agg(F.sum("size").alias("source_size")))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    rows = cut(rows.select("source", "source_size", weight.alias("w")), "mix-sources")
    # level: the words that a unit of weight gets. Each round takes out the sources that it would fill, until it fills no others.
    level, full = None, F.lit(False)
    while True:
        filled = lambda c, full=full: F.coalesce(F.sum(F.when(full, F.col(c))), F.lit(0))
        size, w, full_size, full_w = rows.agg(F.sum("source_size"), F.sum("w"), filled("source_size"), filled("w")).first()
        now = (size - most * full_size) / (w - full_w) if size and w > full_w else float("inf")
        if now == level:
            break
        level, full = now, F.lit(most) * F.col("source_size") / F.col("w") < now
    return rows.select("source", "source_size", F.least(F.lit(most) * F.col("source_size").cast("double"), F.lit(float(level)) * F.col("w")).alias("target"))


def small(plan: DataFrame, name: str = "source") -> DataFrame:
    """A plan whose bytes are few goes to every task, so that documents of one source need not meet."""
    size = plan.agg(F.sum(F.coalesce(F.octet_length(name), F.lit(0)) + PLAN_ROW_BYTES)).first()[0] or 0
    return F.broadcast(plan) if size <= BROADCAST_BYTES else plan


def _same_source(a: str, b: str) -> Column:
    return F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source"))


def inclusion(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """source and k of the sources that have a rest."""
    levels = sized.where("size > 0 and w > 0").groupBy("source", "w").agg(F.sum("size").alias("words"))
    rows = levels.alias("v").join(plan.alias("p"), _same_source("v", "p")).select("v.source", "w", "words", "rest")
    down = Window.partitionBy("source").orderBy(F.desc("w"))
    above = F.coalesce(F.sum("words").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    below = F.sum(F.col("w") * F.col("words")).over(down.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    # With the larger weights certain; the first for which its own weight is not certain as well.
    rows = rows.withColumn("k", (F.col("rest") - above) / below).where("k * w <= 1")
    return rows.groupBy("source").agg(F.max_by("k", "w").alias("k"))


def source_plan(sized: DataFrame, weights: tuple = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """One row per source: source, source_size, target, copies (certain), k, last_bucket and last_rank (how far the sample goes)."""
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    plan = targets(sized, weights, most).withColumn("copies", whole).withColumn("rest", F.col("target") - F.col("copies") * F.col("source_size"))
    plan = plan.alias("p").join(inclusion(sized, plan).alias("i"), _same_source("p", "i"), "left").select("p.*", F.coalesce("k", F.lit(0.0)).alias("k"))
    plan = cut(plan, "mix-plan")
    ranked = sized.alias("d").join(small(plan).alias("p"), _same_source("d", "p")).select("d.source", "d.size", "rest", rank(F.col("u"), F.col("w"), F.col("k")).alias("rank"))
    ranked = ranked.withColumn("bucket", _bucket(F.col("rank")))
    running = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = ranked.groupBy("source", "bucket").agg(F.sum("size").alias("words"), F.first("rest").alias("rest")).withColumn("until", F.sum("words").over(running))
    # The first range that the rest does not cover whole; past all ranges if there is none.
    cuts = sums.where("until > rest").groupBy("source").agg(F.min(F.struct("bucket", (F.col("until") - F.col("words")).alias("before"))).alias("cut"))
    cuts = plan.alias("p").join(cuts.alias("c"), _same_source("p", "c"), "left")
    plan = cut(cuts.select("p.*", F.coalesce("c.cut.bucket", F.lit(RANK_BUCKETS + 1)).alias("last_bucket"), F.coalesce("c.cut.before", F.lit(0)).alias("before")), "mix-cuts", plan)
    edge = sized.alias("d").join(small(plan).alias("p"), _same_source("d", "p")).select("d.source", "d.size", "rest", "before", "last_bucket", rank(F.col("u"), F.col("w"), F.col("k")).alias("rank"))
    edge = edge.where(_bucket(F.col("rank")) == F.col("last_bucket")).groupBy("source", "rest", "before", "rank").agg(F.sum("size").alias("words"))
    order = Window.partitionBy("source").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edge = edge.withColumn("middle", F.col("before") + F.sum("words").over(order) - F.col("words") / 2).where("middle <= rest")
    last = edge.groupBy("source").agg(F.max("rank").alias("last_rank"))
    plan = plan.alias("p").join(last.alias("l"), _same_source("p", "l"), "left")
    return cut(plan.select("p.source", "source_size", "target", "copies", "k", "last_bucket", F.coalesce("last_rank", F.lit(-1.0)).alias("last_rank")), "mix-plan")


def _times(rank: Column, plan: Callable[[str], Column], most: int) -> Column:
    """How often a document is taken."""
    more = (_bucket(rank) < plan("last_bucket")) | ((_bucket(rank) == plan("last_bucket")) & (rank <= plan("last_rank")))
    return F.least(plan("copies") + F.when(more, 1).otherwise(0), F.lit(most))


def sizes(documents: DataFrame, weight: Column | None = None, seed: str = SEED) -> DataFrame:
    """doc_id, source, size, u, w of every document, written once: the whole texts are read a single time."""
    return cut(_with_sizes(documents, [F.col("doc_id"), F.col("source").cast("string").alias("source")], weight, seed), "mix-sizes")


def mix(documents: DataFrame, weights: tuple = WEIGHTS, most: int = MOST_COPIES, weight: Column | None = None, seed: str = SEED) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken (words, repeats counted)."""
    sized = sizes(documents, weight, seed)
    plan = source_plan(sized, weights, most)
    n = _times(rank(F.col("d.u"), F.col("d.w"), F.col("p.k")), lambda c: F.col(f"p.{c}"), most)
    out = sized.alias("d").join(small(plan).alias("p"), _same_source("d", "p")).withColumn("n", n)
    return out.select("d.doc_id", "d.source", "d.size", "p.source_size", "p.target", F.col("n").alias("copies"), (F.col("n") * F.col("d.size")).alias("taken"))


def apply_mix(documents: DataFrame, weights: tuple = WEIGHTS, most: int = MOST_COPIES, weight: Column | None = None, seed: str = SEED) -> DataFrame:
    """The documents as often as the mix takes them, with all their columns."""
    plan = source_plan(sizes(documents, weight, seed), weights, most)
    name = unused(documents, "mix_plan")
    plan = small(plan.select(F.struct(*plan.columns).alias(name)), f"{name}.source")
    own = tuple(unused(documents, f"mix_{c}") for c in ("size", "u", "w"))
    rows = _with_sizes(documents, [F.col(f"`{c}`") for c in documents.columns], weight, seed, own)
    joined = rows.join(plan, rows["source"].cast("string").eqNullSafe(F.col(f"{name}.source")))
    times = _times(rank(F.col(own[1]), F.col(own[2]), F.col(f"{name}.k")), lambda c: F.col(f"{name}.{c}"), most)
    copies = F.explode(F.array_repeat(F.lit(1), times)).alias(unused(documents, "mix_copy"))
    return joined.select(*[F.col(f"`{c}`") for c in documents.columns], copies).select(*[F.col(f"`{c}`") for c in documents.columns])


def op10_mix(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS size,
    (('0x' || substr(md5('objekta-mix-1:' || coalesce(doc_id::VARCHAR, '-') || ':' || md5(coalesce(text, ''))), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0 AS u
  FROM documents),
w AS (SELECT *, floor(sqrt(size)) AS w FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1.0::DOUBLE AS w FROM d GROUP BY source),
f AS (SELECT *, 3 * source_size / w AS room,
    (sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER o, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER o, 0)) AS level,
    row_number() OVER (ORDER BY 3 * source_size / w, source NULLS LAST) AS place
  FROM s WINDOW o AS (ORDER BY 3 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least(3.0 * source_size::DOUBLE, coalesce((SELECT level FROM f WHERE level <= room ORDER BY place LIMIT 1), 'inf'::DOUBLE) * w) AS target FROM f),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS copies FROM t),
v AS (SELECT w.source, w.w, sum(size)::DOUBLE AS words, any_value(target - copies * source_size) AS rest FROM w JOIN p ON w.source IS NOT DISTINCT FROM p.source WHERE size > 0 GROUP BY w.source, w.w),
-- k: the smallest k such that the words expected, sum of least(1, k w) size, reach the rest. That sum is the least of the lines above + k below, over all weights.
k AS (SELECT a.source, max((a.rest - a.above) / a.below) AS k FROM (
    SELECT x.source, x.w, x.rest, coalesce(sum(y.words) FILTER (y.w > x.w), 0) AS above, sum(y.w * y.words) FILTER (y.w <= x.w) AS below FROM v x JOIN v y ON x.source IS NOT DISTINCT FROM y.source GROUP BY x.source, x.w, x.rest) a GROUP BY a.source),
q AS (SELECT w.doc_id, w.source, w.size, w.u, least(1.0, coalesce(k.k, 0) * w.w) AS prob FROM w LEFT JOIN k ON w.source IS NOT DISTINCT FROM k.source),
r AS (SELECT *, CASE WHEN prob >= 1 THEN 0 WHEN prob <= 0 THEN 'inf'::DOUBLE ELSE (u / (1 - u)) / (prob / (1 - prob)) END AS rank FROM q),
g AS (SELECT source, rank, sum(size) AS words FROM r GROUP BY source, rank),
c AS (SELECT source, rank, sum(words) OVER (PARTITION BY source ORDER BY rank) - words / 2.0 AS middle FROM g),
l AS (SELECT p.source, max(rank) AS last_rank FROM c JOIN p ON c.source IS NOT DISTINCT FROM p.source WHERE middle <= target - copies * source_size GROUP BY p.source)
SELECT r.doc_id, r.size::BIGINT AS size, p.source_size, p.target::DOUBLE AS target,
  (least(p.copies + CASE WHEN r.rank <= l.last_rank THEN 1 ELSE 0 END, 3) * r.size)::BIGINT AS taken
FROM r JOIN p ON r.source IS NOT DISTINCT FROM p.source LEFT JOIN l ON r.source IS NOT DISTINCT FROM l.source
"""
