"""MinHash near-duplicates with odd sketches.

Documents with equal shingle sets are one node. Each node has HASHES MinHash samples: they form BANDS bands of ROWS samples
for candidate search, and are folded into an odd sketch, a bitmap of parities: the population count of two sketches' XOR
estimates high similarities precisely. Candidates whose estimate is far below the threshold are dropped (their samples differ
by many standard deviations); the others are confirmed on their full shingle sets.

A band's members are never paired with one another while one link does: in two rounds, members are linked with one member of the
band's largest component, and components are found; members of one component need no more links. What is left, the members of bands
that still hold several components, goes through an exact set join by prefix filtering: shingles are ordered by their frequency among
these texts, and two sets as similar as asked for share one of the rarest shingles of both. So no link between sharing members is lost,
pairs within a component are never made, and families of texts that share bands but aren't similar enough meet only where their
rare shingles do.
At similarity 0.8 two documents share no band with probability (1 - 0.8^8)^64 < 1e-5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalens.llm.components import components
from stratalens.llm.storage import bounded_batches, collect_garbage, derived, discard, small_steps, table, written
from stratalens.llm.textbytes import Spans, lower_ascii, mix64, slices, text_bytes, word_spans

BANDS, ROWS = 64, 8
#: Samples: the bands take the first, odd sketches all.
HASHES = 1024
SKETCH_BITS = 4096
#: Of similarity: 0.8 must hold exactly; estimates (standard deviation 0.0135) under LEAST_ESTIMATE don't belong to such pairs.
THRESHOLD, LEAST_ESTIMATE = 80, 0.75
#: Star rounds: bands from, to, and whether every member is confirmed or the best estimate of each node.
STAR_ROUNDS = ((0, 8, False), (0, BANDS, True))
_rng = np.random.default_rng(77)
_XOR = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)
_MULTIPLY = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_TERMS = mix64(np.arange(1, 33, dtype=np.uint64)) | np.uint64(1)
_SLOT = np.arange(HASHES, dtype=np.uint64) << np.uint64(32)


def shingle_sets(column: pa.Array, width: int) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's shingles of `width` words."""
    raw, at = text_bytes(column)
    raw = lower_ascii(raw)
    start, end, bounds = word_spans(raw, at)
    words = Spans(raw).hash(start, end)
    n = max(0, words.size - width + 1)
    runs = np.zeros(n, np.uint64)
    for k in range(width):
        runs += words[k : k + n] * _TERMS[k]
    runs = mix64(runs)
    out = []
    for i in range(at.size - 1):
        low, high = int(bounds[i]), int(bounds[i + 1])
        if high - low >= width:
            out.append(np.unique(runs[low : high - width + 1]))
        elif high > low:
            few = words[low:high]
            out.append(mix64(np.array([(few * _TERMS[: few.size]).sum() + np.uint64(few.size)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def sketch(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Band keys and odd sketch (as 64-bit words) of a set of shingle hashes."""
    low = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    for part in range(0, short.size, 256):
        np.minimum(low, ((short[None, part : part + 256] ^ _XOR[:, None]) * _MULTIPLY[:, None]).min(axis=1), out=low)
    samples = mix64(low.astype(np.uint64) | _SLOT)
    bands = mix64((samples[: BANDS * ROWS].reshape(BANDS, ROWS) * _TERMS[:ROWS]).sum(1) + np.arange(BANDS, dtype=np.uint64))
    bits = np.bincount((samples & np.uint64(SKETCH_BITS - 1)).astype(np.int64), minlength=SKETCH_BITS) & 1
    return bands.view(np.int64), np.packbits(bits.astype(np.uint8)).view(np.int64)


def _sketches(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                sets = shingle_sets(part.column("text"), width)
                made = [sketch(s) if s.size else None for s in sets]
                # Two sums of independent mixes name a set.
                first = [int((mix64(s).sum() & np.uint64((1 << 63) - 1))) if s.size else None for s in sets]
                second = [int((mix64(s ^ np.uint64(0x5851F42D4C957F2D)).sum() & np.uint64((1 << 63) - 1))) if s.size else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("tie"), pa.array([s.size for s in sets], pa.int64()), pa.array(first, pa.int64()), pa.array(second, pa.int64()), pa.array([m and m[0] for m in made], pa.list_(pa.int64())), pa.array([m and m[1] for m in made], pa.list_(pa.int64()))],
                    ["doc_id", "tie", "n_shingles", "sig_a", "sig_b", "bands", "odd"],
                )

    return run


def estimate(a: str, b: str) -> Column:
    """Similarity by the odd sketches in two columns: 1 + m / 4k ln(1 - 2 |xor| / m)."""
    apart = F.expr(f"cast(aggregate(zip_with({a}, {b}, (x, y) -> bit_count(x ^ y)), 0, (s, x) -> s + x) as double)")
    return 1 + F.lit(SKETCH_BITS / (4.0 * HASHES)) * F.log(F.greatest(F.lit(1e-3), 1 - 2 * apart / SKETCH_BITS))


def _confirm(width: int, threshold: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                left, pivots = shingle_sets(part.column("text"), width), part.column("v")
                keep, last, other = [], None, np.zeros(0, np.uint64)
                for i, mine in enumerate(left):
                    if (v := pivots[i].as_py()) != last:
                        last, other = v, shingle_sets(part.column("text_v").slice(i, 1), width)[0]
                    both = np.intersect1d(mine, other, assume_unique=True).size
                    keep.append(both > 0 and 100 * both >= threshold * (mine.size + other.size - both))
                yield pa.RecordBatch.from_arrays([part.column("u"), pivots, pa.array(keep, pa.bool_())], ["u", "v", "linked"])

    return run


def confirmed(pairs: DataFrame, texts: DataFrame, width: int, threshold: int) -> DataFrame:
    """Those of `pairs` (u, v) whose full shingle sets are similar enough."""
    with_u = pairs.join(texts.select(F.col("doc_id").alias("u"), "text").hint("merge"), "u")
    full = with_u.join(texts.select(F.col("doc_id").alias("v"), F.col("text").alias("text_v")).hint("merge"), "v").select("u", "v", "text", "text_v")
    return written(full.mapInArrow(_confirm(width, threshold), "u long, v long, linked boolean").filter("linked").select("u", "v"), "links")


def _size_fits(a: Column, b: Column, threshold: int) -> Column:
    return 100 * F.least(a, b) >= threshold * F.greatest(a, b)


def _mixed(nodes: DataFrame, found: DataFrame | None, low: int, high: int) -> DataFrame:
    """Members (band, doc_id, component, top) of the bands from `low` to `high` that hold several components; `top` is the least
    document of the band's largest component."""
    if found is None:
        placed = nodes.select("doc_id", "bands", F.col("doc_id").alias("component"), F.lit(1).cast("long").alias("weight"))
    else:
        weight = found.groupBy("component").agg(F.count(F.lit(1)).alias("weight"))
        placed = nodes.join(found.join(weight.hint("merge"), "component").withColumnRenamed("node", "doc_id").hint("merge"), "doc_id", "left")
        placed = placed.select("doc_id", "bands", F.coalesce("component", "doc_id").alias("component"), F.coalesce("weight", F.lit(1)).alias("weight"))
    placed = written(placed.withColumn("bands", F.slice("bands", low + 1, high - low)), "placed")
    members = placed.select("doc_id", "component", "weight", F.explode("bands").alias("band"))
    # The rank says the same as the document: the largest is the least document of the least component among the heaviest.
    rank = F.struct("weight", -F.col("component"), -F.col("doc_id"))
    tops = members.groupBy("band").agg(F.min("component").alias("a"), F.max("component").alias("b"), F.max(rank).alias("r")).filter("a != b")
    top = F.struct((-F.col("r.col2")).alias("component"), (-F.col("r.col3")).alias("doc_id")).alias("top")
    return derived(members.join(tops.select("band", top).hint("merge"), "band").select("band", "doc_id", "component", "top"), placed)


def _estimated(pairs: DataFrame, sketches: DataFrame, threshold: int) -> DataFrame:
    """`pairs` (u, v) that sizes and sketches allow, with the estimate e."""
    left = sketches.select(F.col("doc_id").alias("u"), F.col("odd").alias("odd_u"), F.col("n_shingles").alias("n_u"))
    right = sketches.select(F.col("doc_id").alias("v"), F.col("odd").alias("odd_v"), F.col("n_shingles").alias("n_v"))
    both = pairs.join(left.hint("merge"), "u").join(right.hint("merge"), "v").filter(_size_fits(F.col("n_u"), F.col("n_v"), threshold))
    return written(both.select("u", "v", estimate("odd_u", "odd_v").alias("e")).filter(F.col("e") >= LEAST_ESTIMATE), "stars")


def _shingles(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                sets = shingle_sets(part.column("text"), width)
                ends = np.concatenate([[0], np.cumsum([s.size for s in sets])]).astype(np.int32)
                flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("component"), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))], ["doc_id", "component", "shingles"])

    return run


def prefix_pairs(texts: DataFrame, width: int = 5, threshold: int = THRESHOLD) -> DataFrame:
    """Pairs (u, v) of `texts` (doc_id, component, text) from different components, among which are all that are similar enough.

    Shingles are ordered by frequency, the rarest first. If two sets are similar enough, the smaller one's first
    n - ceil(2 t / (1 + t) n) + 1 shingles and the larger one's first n - ceil(t n) + 1 have one in common; behind their first common one
    both must have room for the rest. Shingles of one text alone take their places in the order and aren't joined.
    """
    sets = written(texts.mapInArrow(_shingles(width), "doc_id long, component long, shingles array<long>"), "shingles")
    each = sets.select("doc_id", F.size("shingles").alias("n"), F.explode("shingles").alias("shingle"))
    often = each.groupBy("shingle").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    shared = each.join(often.hint("merge"), "shingle").groupBy("doc_id", "n").agg(F.sort_array(F.collect_list(F.struct("df", "shingle"))).alias("order"))
    n, alone = F.col("n"), F.col("n") - F.size("order")
    probe, index = n - F.ceil(n * threshold / 100.0) + 1, n - F.ceil(n * 2.0 * threshold / (100 + threshold)) + 1
    prefix = shared.withColumn("alone", alone).withColumn("probe", probe).withColumn("index", index).filter("alone < probe")
    prefix = prefix.select("doc_id", "n", "index", F.col("alone"), F.posexplode(F.slice("order", 1, (F.col("probe") - F.col("alone")).cast("int"))).alias("k", "s"))
    prefix = prefix.join(sets.select("doc_id", "component").hint("merge"), "doc_id").select("doc_id", "component", "n", "index", (F.col("alone") + F.col("k")).alias("place"), F.col("s.shingle").alias("shingle"))
    prefix = written(prefix, "prefixes")
    collect_garbage(texts.sparkSession)
    small, large = prefix.filter("place < index").alias("a"), prefix.alias("b").hint("merge")
    on = (F.col("a.shingle") == F.col("b.shingle")) & (F.col("a.component") != F.col("b.component")) & (F.struct("a.n", "a.doc_id") < F.struct("b.n", "b.doc_id"))
    room = F.least(F.col("a.n") - F.col("a.place"), F.col("b.n") - F.col("b.place"))
    on = on & _size_fits(F.col("a.n"), F.col("b.n"), threshold) & (room * (100 + threshold) >= threshold * (F.col("a.n") + F.col("b.n")))
    pairs = written(small.join(large, on).select(F.col("a.doc_id").alias("u"), F.col("b.doc_id").alias("v")).distinct(), "pairs")
    discard(sets, prefix)
    collect_garbage(texts.sparkSession)
    return pairs


def near_duplicates(docs: DataFrame, width: int = 5, threshold: int = THRESHOLD) -> DataFrame:
    """For each row of `docs` (doc_id, text): doc_id, n_shingles, component_id and kept.

    Linked are documents with 100 * intersection >= threshold * union of their shingle sets. Texts without words (or null)
    have empty sets and are linked with nothing; rows without an id have no component and are kept; rows with the same id
    are one node, which has the links of all their texts. Other columns are ignored; an empty table gives one.
    """
    with small_steps(docs.sparkSession):
        return _near_duplicates(docs, width, threshold)


def _near_duplicates(docs: DataFrame, width: int, threshold: int) -> DataFrame:
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tie"))
    made = written(docs.mapInArrow(_sketches(width), "doc_id long, tie long, n_shingles long, sig_a long, sig_b long, bands array<long>, odd array<long>"), "sketches")
    known = made.filter("sig_a is not null and doc_id is not null")
    # Where an id has several texts, each is a node of its own at first.
    several = known.groupBy("doc_id").agg(F.min("tie").alias("low"), F.max("tie").alias("high")).filter("low < high").select(F.col("doc_id").alias("several"))
    several = written(several, "several")
    repeated = not several.isEmpty()

    def keyed(rows: DataFrame) -> DataFrame:
        if not repeated:
            return rows.withColumn("key", F.col("doc_id"))
        own = F.when(F.col("several").isNull(), F.col("doc_id")).otherwise(F.xxhash64("doc_id", "tie"))
        return rows.join(several, F.col("doc_id") == F.col("several"), "left").withColumn("key", own).drop("several")

    sets = keyed(known)
    classes = sets.groupBy("sig_a", "sig_b", "n_shingles").agg(F.min("key").alias("node"))
    # One row for each node: a class, under its least key. Copies within a class need no comparison.
    firsts = classes.select("sig_a", "sig_b", F.col("node").alias("key"))
    nodes = sets.join(firsts.hint("merge"), ["sig_a", "sig_b", "key"]).dropDuplicates(["sig_a", "sig_b"])
    nodes = written(nodes.select(F.col("key").alias("doc_id"), "n_shingles", "bands", "odd"), "nodes")
    shared = nodes.select("doc_id", F.explode("bands").alias("band")).groupBy("band").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).filter("a != b")
    # Only documents that share a band with another are read again.
    wanted = written(nodes.select("doc_id", F.explode("bands").alias("band")).join(shared.hint("merge"), "band", "left_semi").select("doc_id").distinct(), "wanted")
    every_node, nodes = nodes, written(nodes.join(wanted.hint("merge"), "doc_id", "left_semi"), "nodes")
    texts = keyed(docs).select(F.col("key").alias("doc_id"), "text").join(wanted.hint("merge"), "doc_id", "left_semi")
    texts = written(texts.dropDuplicates(["doc_id"]), "texts")
    discard(every_node, wanted)
    collect_garbage(spark)
    sketches = nodes.select("doc_id", "odd", "n_shingles")
    links, found = None, None

    def linked(pairs: DataFrame) -> None:
        """Confirm pairs, and take the components anew."""
        nonlocal links, found
        collect_garbage(spark)
        new, old, before = confirmed(pairs, texts, width, threshold), links, found
        links = new if old is None else written(old.union(new), "links")
        found = components(links)
        discard(old, new if old is not None else None, before)

    for low, high, every in STAR_ROUNDS:
        members = _mixed(nodes, found, low, high)
        pairs = members.filter(F.col("component") != F.col("top.component")).select(F.col("doc_id").alias("u"), F.col("top.doc_id").alias("v")).distinct()
        stars = _estimated(pairs, sketches, threshold)
        linked(stars.select("u", "v") if every else stars.groupBy("u").agg(F.max_by("v", F.struct("e", -F.col("v"))).alias("v")))
        discard(members, stars)
        collect_garbage(spark)
    # What is left: bands that still hold several components.
    members = _mixed(nodes, found, 0, BANDS)
    left = texts.join(members.select("doc_id", "component").distinct().hint("merge"), "doc_id")
    pairs = prefix_pairs(left, width, threshold)
    linked(pairs)
    discard(members, pairs)
    collect_garbage(spark)
    component = found.withColumnRenamed("node", "key_n")
    by_class = classes.join(component.hint("merge"), classes.node == component.key_n, "left").select("sig_a", "sig_b", F.coalesce("component", "node").alias("component"))
    rows = keyed(made).select("doc_id", "n_shingles", "sig_a", "sig_b").join(by_class.hint("merge"), ["sig_a", "sig_b"], "left")
    used = [made, nodes, texts, links, found, several]
    if repeated:
        # Components that meet in an id are one, named by its least id.
        rows = written(rows, "rows")
        meets = rows.filter("component is not null and doc_id is not null").groupBy("doc_id").agg(F.min("component").alias("m"), F.collect_set("component").alias("each"))
        joined = components(meets.select("m", F.explode("each").alias("c")).select(F.col("c").alias("u"), F.col("m").alias("v")))
        rows = rows.join(joined.withColumnRenamed("component", "whole"), F.col("component") == F.col("node"), "left").withColumn("component", F.coalesce("whole", "component"))
        least = rows.filter("component is not null").groupBy(F.col("component").alias("c")).agg(F.min("doc_id").alias("least"))
        rows = rows.join(least, F.col("component") == F.col("c"), "left").withColumn("component", F.col("least")).select("doc_id", "n_shingles", "component")
        used += [joined]
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    out = written(rows.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept")), "near")
    discard(*used)
    collect_garbage(spark)
    return out


def op7_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=2)
