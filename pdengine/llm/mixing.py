"""Sources mixed to target weights along a curriculum (operator 5).

Targets come from weights by filling: all sources share the tokens of the mix
by weight, a source that reaches its most stops there, and the rest is shared
again. Each source then has a weight schedule over training time 0..1. Its
integral, scaled to the target, is the source's cumulative demand for tokens;
a document that begins where the source has given out y of its target stands
at the time when demand reaches y. Documents are range-sorted by that time.

A source runs through its documents in the order of a hash of the id, as often
as its target needs; the last one needed may be taken in part, so sums meet
the targets to the word. Sums along that order are taken in buckets of the
hash, so a source with all documents still spreads over many tasks.

Defined results: null text has size 0 and is never taken; a null source is a
source, the last in order; rows that share an id are documents of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pdengine.llm.tables import numbered, running, staged

WEIGHTS = (3, 1, 2)
#: Weight over training time, as (time, weight) from 0 to 1, for the sources of each weight above.
SCHEDULES = (
    ((0.0, 1.5), (1.0, 0.5)),
    ((0.0, 1.0), (1.0, 1.0)),
    ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)),
)
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of one bucket of the hash, about.
BUCKET_ROWS = 20_000


def training_time(share: Column, knots: tuple[tuple[float, float], ...]) -> Column:
    """Time at which the integral of a piecewise linear schedule reaches ``share`` of the whole."""
    pieces = list(zip(knots, knots[1:], strict=False))
    areas = [(t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in pieces]
    total, done = sum(areas), 0.0
    parts = []
    for ((t0, w0), (t1, w1)), area in zip(pieces, areas, strict=True):
        need = share * total - done
        slope = (w1 - w0) / (t1 - t0)
        # slope/2 x^2 + w0 x = need, in the form that has no cancellation
        step = F.try_divide(2 * need, w0 + F.sqrt(w0 * w0 + 2 * slope * need))
        parts.append((done + area, t0 + F.coalesce(step, F.lit(0.0))))
        done += area
    out = parts[-1][1]
    for upto, time in reversed(parts[:-1]):
        out = F.when(share * total <= upto, time).otherwise(out)
    return F.least(F.greatest(out, F.lit(0.0)), F.lit(1.0))


def sources_with_targets(sizes: DataFrame, budget: float = 1.5, most: float = 2.0, weights=WEIGHTS) -> DataFrame:
    """``source, n_docs, source_size, kind, weight, target`` of each source, kinds in code point order."""
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    kind = F.pmod("place", F.lit(len(weights))).cast("int")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), kind + 1)
    cap = F.lit(float(most)) * F.col("source_size")
    ordered = numbered(per_source, F.col("source").asc_nulls_last()).withColumnRenamed("_place", "place")
    table = staged(ordered.withColumns({"kind": kind, "weight": weight}).withColumn("cap", cap))
    # Sources fill up in the order of cap / weight. If those before one are full and it and the rest are not, the
    # rest share what is left; the highest such level is the one at which all are served.
    total, weights_sum = table.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.sum("weight")).first()
    if not total:
        return table.drop("cap").withColumn("target", F.lit(0.0))
    filling = running(table.withColumn("ratio", F.col("cap") / F.col("weight")), ["ratio", "place"], {"given": F.col("cap"), "passed": F.col("weight")})
    level = filling.agg(F.max((budget * total - F.col("given")) / (weights_sum - F.col("passed"))).alias("v")).first()["v"]
    return table.withColumn("target", F.least("cap", F.lit(level) * F.col("weight"))).drop("cap")


def mix(
    docs: DataFrame, budget: float = 1.5, most: float = 2.0, weights=WEIGHTS, schedules=SCHEDULES
) -> DataFrame:
    """``doc_id, size, source_size, target, taken, position, again``, sorted by position.

    Rows without an id stand in the order of the hash of all their columns.

    ``taken`` counts the words the mix takes from the document, repeats
    included; ``position`` and ``again`` are the training times of its first
    and second use, null where it is not used.
    """
    place = F.md5(F.coalesce(F.col("doc_id").cast("string"), row_key(docs)).cast("binary"))
    sizes = staged(docs.select(
        "doc_id", F.col("source").cast("string").alias("source"), _size().alias("size"), place.alias("place"),
        F.lit("").alias("key"), F.lit(1).cast("long").alias("copies"),
    ))
    return _used(_placed(sizes, budget, most, weights), schedules).select(
        "doc_id", "size", "source_size", "target", "taken", "position", "again"
    ).orderBy(F.col("position").asc_nulls_last(), "doc_id")


def _size() -> Column:
    return F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def _placed(sizes: DataFrame, budget: float, most: float, weights) -> DataFrame:
    """Add the facts of the source and ``before``, the words its source gives out before each row of ``sizes``.

    A row stands for ``copies`` equal documents.
    """
    sizes = sizes.withColumn("words", F.col("size") * F.col("copies"))
    sources = staged(sources_with_targets(sizes.select("source", F.col("words").alias("size")), budget, most, weights))

    rows = sources.agg(F.sum("n_docs").alias("n")).first()["n"] or 0
    digits = 0
    while rows > BUCKET_ROWS * 16**digits:
        digits += 1
    cut = sizes.withColumn("bucket", F.substring("place", 1, digits) if digits else F.lit(""))
    key = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))
    cut = cut.withColumn("skey", key)
    inside = Window.partitionBy("skey", "bucket").orderBy("place", "doc_id", "size", "key").rowsBetween(Window.unboundedPreceding, -1)
    lower = Window.partitionBy("skey").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bucket_sums = (
        cut.groupBy("skey", "bucket").agg(F.sum("words").alias("n"))
        .select("skey", "bucket", F.coalesce(F.sum("n").over(lower), F.lit(0)).alias("below"))
    )
    facts = sources.select(key.alias("skey"), "source_size", "kind", "target")
    offsets = bucket_sums.join(facts, "skey")
    placed = cut.withColumn("in_bucket", F.coalesce(F.sum("words").over(inside), F.lit(0))).join(offsets, ["skey", "bucket"])

    return placed.withColumn("before", F.col("below") + F.col("in_bucket"))


def _used(placed: DataFrame, schedules) -> DataFrame:
    """Add ``taken``, ``position`` and ``again`` of each document."""
    before = F.col("before")
    goal = F.floor("target").cast("long")
    use = lambda seen: F.greatest(F.least(F.col("size"), goal - seen), F.lit(0))
    first, second = use(before), use(before + F.col("source_size"))

    def time(seen: Column, words: Column) -> Column:
        share = seen / F.col("target")
        at = F.lit(None).cast("double")
        for kind, knots in enumerate(schedules):
            at = F.when(F.col("kind") == kind, training_time(share, knots)).otherwise(at)
        return F.when(words > 0, at)

    return placed.withColumns({
        "taken": first + second,
        "position": time(before, first),
        "again": time(before + F.col("source_size"), second),
    })


def row_key(docs: DataFrame) -> Column:
    """Hash of all columns of a row, equal for equal rows only."""
    return F.md5(F.to_json(F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)])).cast("binary"))


def mixed(
    docs: DataFrame, budget: float = 1.5, most: float = 2.0, weights=WEIGHTS, schedules=SCHEDULES
) -> DataFrame:
    """The documents in training order: a row for each use of which at least half is taken.

    Every use but the last of each source is whole, so this rounds to documents.
    Each row is decided by itself, also if it shares its id or has none: equal
    rows are counted and used one after the other, ties follow the row's hash.
    Rows without an id take the place of their hash instead of the id's.
    """
    each = docs.select("doc_id", F.col("source").cast("string").alias("source"), _size().alias("size"), row_key(docs).alias("key"))
    keyed = docs.select(F.struct("*").alias("_doc"), row_key(docs).alias("_key"))  # so no column can clash with ours
    sizes = staged(
        each.groupBy("key").agg(
            F.first("doc_id").alias("doc_id"), F.first("source").alias("source"), F.first("size").alias("size"),
            F.count(F.lit(1)).alias("copies"),
        ).withColumn("place", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.col("key")).cast("binary")))
    )
    copies = _placed(sizes, budget, most, weights).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    uses = _used(copies.withColumn("before", F.col("before") + F.col("copy") * F.col("size")), schedules)
    left = F.col("taken") - F.col("size")
    whole = uses.select(
        F.col("key").alias("_key"),
        F.col("copies").alias("_copies"),
        F.explode(F.array(
            F.when(F.least("taken", "size") * 2 >= F.col("size"), F.col("position")),
            F.when(left * 2 >= F.col("size"), F.col("again")),
        )).alias("_at"),
    ).where("_at is not null")
    if sizes.where("copies > 1").isEmpty():
        out = keyed.join(whole, "_key")
    else:
        whole = staged(whole)
        several = sizes.where("copies > 1").select(F.col("key").alias("_key"))
        out = keyed.join(whole.where("_copies = 1"), "_key").unionByName(
            keyed.dropDuplicates(["_key"]).join(several, "_key", "left_semi").join(whole.where("_copies > 1"), "_key")
        )
    return out.orderBy("_at", "_doc.doc_id", "_key").select(*[F.col(f"_doc.`{c}`") for c in docs.columns])
