"""Near-duplicate documents by SuperMinHash signatures (operator 1).

Each shingle of a document draws one random permutation of the signature's
places and, in order, the values 0+r, 1+r, ... for them. Ranks within one
shingle are thus correlated, which lowers the variance of the estimate, and a
document may stop at the first rank that can no longer lower any place.
Signatures are cut into bands; documents that share a band are candidates,
candidates are confirmed on full shingle sets, and confirmed links are grouped
by union-find.

Candidates never are all pairs of a band's bucket. Documents with equal sets
are merged first; in each bucket every member is compared with one hub, and
only members that still lie in different components are compared with more.

Defined results: null or empty text has no shingles, links with nothing and is
its own component. Rows that share an id are one node: each row's text is
linked, and what any of them links with belongs to the component of all. A row
without an id links with nothing and gets a null component. Extra columns are
ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pdengine.llm.components import components
from pdengine.llm.tables import attach, numbered, slices, staged
from pdengine.llm.words import U, mix, shingles, words

#: Bands and rows: a pair at the threshold of 0.85 escapes all bands once in 2.5 million.
BANDS, ROWS = 25, 5
#: Standard deviations below its mean at which one-bit sketches rule a candidate out (about 1 in 10 million).
DEVIATIONS = 6
_ELEMENTS = 100_000


def signatures(sets: np.ndarray, offsets: np.ndarray, places: int) -> np.ndarray:
    """SuperMinHash signature of each set of a batch; sets without members have infinite values."""
    out = np.full((len(offsets) - 1, places), np.inf)
    first = 0
    while first < len(offsets) - 1:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + _ELEMENTS, "right")) - 1)
        out[first:last] = _signatures(sets[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first], places)
        first = last
    return out


def _signatures(h: np.ndarray, offsets: np.ndarray, places: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        values = np.full((len(offsets) - 1) * places, np.inf)
        order = np.empty((0, places), np.uint16)
        for rank in range(places):
            if not len(h):
                break
            draw = mix(h + U(rank + 1) * U(0x9E3779B97F4A7C15))
            r = (draw >> U(11)).astype(np.float64) * 2.0**-53
            swap = rank + ((mix(draw) >> U(32)) * U(places - rank) >> U(32)).astype(np.int64)
            if rank == 0:
                place = swap
            else:
                if rank == 1:  # most documents need few ranks, so permutations are written out late
                    order = np.tile(np.arange(places, dtype=np.uint16), (len(h), 1))
                    each = np.arange(len(h))
                    order[each, 0], order[each, swapped] = swapped, 0
                each = np.arange(len(h))
                place = order[each, swap].astype(np.int64)
                order[each, swap] = order[each, rank]
            np.minimum.at(values, owner * places + place, r + rank)
            live = values.reshape(-1, places).max(axis=1) >= rank + 1
            stay = live[owner]
            swapped = swap
            if not stay.all():
                h, owner, swapped = h[stay], owner[stay], swapped[stay]
                if rank:
                    order = order[stay]
        return values.reshape(-1, places)


def _describe(bands: int, rows: int, size: int):
    def task(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                with np.errstate(over="ignore"):
                    sets, offsets = shingles(words(batch.column("text")), size)
                    n = np.diff(offsets)
                    sums = np.concatenate([[U(0)], np.cumsum(sets, dtype=U)])
                    twice = np.concatenate([[U(0)], np.cumsum(mix(sets ^ U(0xA5A5A5A5A5A5A5A5)), dtype=U)])
                    f1, f2 = (mix(s[offsets[1:]] - s[offsets[:-1]] + n.astype(U)).view(np.int64) for s in (sums, twice))
                    sig = signatures(sets, offsets, bands * rows).view(U).reshape(-1, bands, rows)
                    bits = np.zeros((len(n), -(-bands * rows // 64) * 64), np.uint8)
                    bits[:, : bands * rows] = (mix(sig.reshape(len(n), -1)) & U(1)).astype(np.uint8)
                    sketch = pa.FixedSizeListArray.from_arrays(
                        pa.array(np.packbits(bits, axis=1).view(np.int64).reshape(-1)), bits.shape[1] // 64
                    ).cast(pa.list_(pa.int64()))
                    keys = np.zeros(sig.shape[:2], U)
                    for j in range(rows):
                        keys = mix(keys * U(31) + sig[:, :, j])
                    keys = mix(keys + np.arange(1, bands + 1, dtype=U)[None, :] * U(0x9E3779B97F4A7C15)).view(np.int64)
                    ends = np.concatenate([[0], np.cumsum(np.where(n > 0, bands, 0))]).astype(np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys[n > 0].reshape(-1)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(n.astype(np.int64)), pa.array(f1), pa.array(f2), sketch, lists],
                    names=["doc_id", "n_shingles", "f1", "f2", "sketch", "bands"],
                )

    return task


def _sets(size: int):
    def task(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                sets, offsets = shingles(words(batch.column("text")), size)
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(sets.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], names=["doc_id", "s"])

    return task


def _alike(one: str, two: str, places: int, percent: int) -> Column:
    """Whether two members may reach the threshold, judged by sizes and by one bit of each place."""
    low = F.least(f"n_shingles{one}", f"n_shingles{two}") * 100
    high = F.greatest(f"n_shingles{one}", f"n_shingles{two}") * percent
    odd = sum((F.bit_count(F.col(f"w{i}{one}").bitwiseXOR(F.col(f"w{i}{two}"))) for i in range(-(-places // 64))), F.lit(0))
    p = (1 + percent / 100) / 2
    most = places * (1 - p) + DEVIATIONS * math.sqrt(places * p * (1 - p))
    return (low >= high) & (odd <= math.ceil(most))


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs ``(a, b)`` whose full sets have a Jaccard similarity of ``percent`` or more."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("s").alias("sa"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("s").alias("sb"))
    both = F.size("sa") + F.size("sb")
    same = F.size(F.array_intersect("sa", "sb"))
    return (
        pairs.join(left, "a").join(right, "b")
        .where(same * (100 + percent) >= both * percent)
        .select("a", "b")
    )


def near_duplicates(
    docs: DataFrame, size: int = 5, percent: int = 80, bands: int = 40, rows: int = 5
) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for each row of ``docs`` (``doc_id``, ``text``).

    Documents are linked when their sets of ``size``-word shingles have a
    Jaccard similarity of at least ``percent`` / 100.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if texts.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty():
        return _of_unique(texts, size, percent, bands, rows)
    # Every row gets a number of its own, ascending with the id; rows of one id are linked afterwards.
    given = staged(numbered(texts.where("doc_id is not null").withColumn("h", F.md5(F.col("text").cast("binary"))), "doc_id", "h").drop("h"))
    found = staged(_of_unique(given.select(F.col("_place").alias("doc_id"), "text"), size, percent, bands, rows))
    each = given.select(F.col("_place").alias("row"), F.col("doc_id").alias("id")).join(found.withColumnRenamed("doc_id", "row"), "row")
    least = each.groupBy("id").agg(F.min("component_id").alias("b"))
    labels = staged(components(each.join(least, "id").select(F.col("component_id").alias("a"), "b").distinct()))
    names = given.select(F.col("_place").alias("component_id"), F.col("doc_id").alias("least"))
    whole = each.join(labels.select(F.col("node").alias("component_id"), F.col("component_id").alias("root")), "component_id", "left")
    whole = whole.withColumn("component_id", F.coalesce("root", "component_id")).join(names, "component_id")
    named = whole.select(F.col("id").alias("doc_id"), "n_shingles", F.col("least").alias("component_id"), (F.col("id") == F.col("least")).alias("kept"))
    return named.unionByName(_of_unique(texts.where("doc_id is null"), size, percent, bands, rows))


def _of_unique(texts: DataFrame, size: int, percent: int, bands: int, rows: int) -> DataFrame:
    """``near_duplicates`` of a table without repeated ids, apart from null ones."""
    described = staged(texts.mapInArrow(
        _describe(bands, rows, size), "doc_id long, n_shingles long, f1 long, f2 long, sketch array<long>, bands array<long>"
    ))
    filled = described.where("n_shingles > 0 and doc_id is not null")
    groups = staged(filled.groupBy("f1", "f2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies")))
    reps = filled.join(groups.select("f1", "f2", F.col("rep").alias("doc_id")), ["f1", "f2", "doc_id"], "left_semi")
    sketch = [F.col("sketch")[i].alias(f"w{i}") for i in range(-(-bands * rows // 64))]
    placed = reps.select("doc_id", "n_shingles", *sketch, F.explode("bands").alias("key"))

    # Buckets of one document hold no candidates. In the others all members are compared with the smallest
    # one, then those left apart with the largest.
    ends = placed.groupBy("key").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo <> hi")
    members = staged(placed.join(ends, "key"))
    wanted = members.select("doc_id").distinct()
    sets = staged(texts.join(wanted, "doc_id", "left_semi").mapInArrow(_sets(size), "doc_id long, s array<long>").dropDuplicates(["doc_id"]))
    placing = reps.select("doc_id", "bands").join(wanted, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    alike = _alike("1", "2", bands * rows, percent)

    def links_with(some: DataFrame, end: str, other: Column) -> DataFrame:
        one, _ = _sides(some)
        _, two = _sides(some.where(F.col("doc_id") == F.col(end)))
        pairs = one.join(two, "key").where(other & alike)
        pairs = pairs.select(F.least("doc_id1", "doc_id2").alias("a"), F.greatest("doc_id1", "doc_id2").alias("b"))
        return staged(_confirmed(pairs.distinct(), sets, percent))

    labels = _grown(None, links_with(members, "lo", F.col("doc_id1") != F.col("doc_id2")))
    apart = staged(_apart(members, labels))
    if not apart.isEmpty():
        found = links_with(apart, "hi", F.col("comp1") != F.col("comp2"))
        if not found.isEmpty():
            labels = _grown(labels, found)
            apart = staged(_apart(members, labels))
        found = staged(_rest(apart, placing, sets, alike, percent))
        if not found.isEmpty():
            labels = _grown(labels, found)

    final = groups.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select(
        "f1", "f2", "copies", F.coalesce("component_id", "rep").alias("component_id")
    )
    keyed = described.select(
        "doc_id", "n_shingles",
        *[F.when(F.col("n_shingles") > 0, F.col(c)).alias(c) for c in ("f1", "f2")],
    )
    return attach(keyed, final, ["f1", "f2"], "copies", ["component_id"]).select(
        "doc_id",
        "n_shingles",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"),
        F.coalesce(F.coalesce("component_id", "doc_id") == F.col("doc_id"), F.lit(False)).alias("kept"),
    )


def _sides(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same rows twice for a join on ``key``, other columns numbered 1 and 2."""
    one, two = (rows.select("key", *[F.col(c).alias(f"{c}{i}") for c in rows.columns if c != "key"]) for i in "12")
    return one, two


def _grown(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """Components after more links, from the components so far."""
    if labels is not None:
        links = links.union(labels.select("node", "component_id"))
    return staged(components(links))


def _rest(apart: DataFrame, placing: DataFrame, sets: DataFrame, alike: Column, percent: int) -> DataFrame:
    """Links between members of one bucket that lie in different components.

    Members meet in classes of nearly equal size, a pair only in the first
    bucket it shares. Sizes and sketches say which members have a possible
    partner at all; only to these are the full sets, which are large, attached.
    Sets are compared inside the join, so nothing but links leaves it.
    """
    one, two = _sides(apart.drop("lo", "hi").join(placing, "doc_id"))
    classes = [F.floor(F.log(F.col(f"n_shingles{i}").cast("double")) / math.log(100 / percent) + 1e-9) for i in "12"]
    one = one.withColumn("class", F.explode(F.array(classes[0], classes[0] + 1)))
    two = two.withColumn("class", classes[1])

    sizes = F.col("n_shingles1"), F.col("n_shingles2")
    ordered = (sizes[0] < sizes[1]) | ((sizes[0] == sizes[1]) & (F.col("doc_id1") < F.col("doc_id2")))
    cheap = (F.col("comp1") != F.col("comp2")) & ordered & alike
    first = F.element_at(F.array_intersect("bands1", "bands2"), 1) == F.col("key")
    met = (F.col("key") == F.col("k")) & (F.col("class") == F.col("c")) & F.when(cheap, first)
    renamed = {"key": "k", "class": "c"}
    some_one = staged(one.join(two.withColumnsRenamed(renamed), met, "left_semi"))
    some_two = staged(two.join(one.withColumnsRenamed(renamed), met, "left_semi"))

    full = [
        df.join(sets.select(F.col("doc_id").alias(f"doc_id{i}"), F.col("s").alias(f"s{i}")), f"doc_id{i}")
        for i, df in (("1", some_one), ("2", some_two))
    ]
    same = F.size(F.array_intersect("s1", "s2"))
    linked = same * (100 + percent) >= (sizes[0] + sizes[1]) * percent
    return (
        full[0].join(full[1], ["key", "class"])
        .where(F.when(cheap, F.when(first, linked)))  # in this order, the dear test last
        .select(F.col("doc_id1").alias("a"), F.col("doc_id2").alias("b"))
        .distinct()
    )


def _apart(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of buckets that still hold more than one component, each with its component ``comp``."""
    own = labels.select(F.col("node").alias("doc_id"), F.col("component_id").alias("c"))
    marked = members.join(own, "doc_id", "left").withColumn("comp", F.coalesce("c", "doc_id")).drop("c")
    mixed = marked.groupBy("key").agg(F.min("comp").alias("least"), F.max("comp").alias("most")).where("least <> most")
    return marked.join(mixed.select("key"), "key", "left_semi")
