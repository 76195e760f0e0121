"""Mixing sources to target weights over fixed-length blocks.

Each source's words are packed, document behind document, into blocks of `block_words` words (the last may be shorter).
Every output shard draws multinomial source counts under the condition that the whole mix meets each source's quota: the draws go
down a binary tree over the shards, each node dealing its counts out to its halves, with a random number of its own seed; so any task
draws the shards that it makes, whatever their number, and all tasks agree. The k-th slot of a source is epoch k // n_blocks and position k % n_blocks of that epoch's pseudorandom
permutation of the block indexes (a keyed Feistel network with cycle walking), and blocks meet their documents by a join on
(source, block index). The last slot of a source is cut to the word where its quota ends.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratalens.llm.storage import collect_garbage, discard, small_steps, table, written

WORD = r"[^\x20\x09-\x0D]+"
ROUNDS = 4
#: Shards that a task draws and fills at once.
SHARDS = 16
#: Rows whose running sum one task takes; sums of buckets are taken in runs of WIDE.
BUCKET_ROWS, WIDE = 2_000, 4_096


def _round(value: np.ndarray, key: np.ndarray | int) -> np.ndarray:
    x = value.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _keys(seed: int, source: int, epoch: int) -> list[int]:
    return [int(x) for x in np.random.SeedSequence([seed, source, epoch]).generate_state(ROUNDS, np.uint64)]


def permute(index: np.ndarray, n: int, keys: list[int], inverse: bool = False) -> np.ndarray:
    """Images of `index` under a keyed permutation of range(n)."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    out = index.astype(np.uint64).copy()
    todo = np.arange(out.size)
    while todo.size:
        left, right = out[todo] >> shift, out[todo] & mask
        for key in reversed(keys) if inverse else keys:
            if inverse:
                left, right = right ^ (_round(left, key) & mask), left
            else:
                left, right = right, left ^ (_round(right, key) & mask)
        out[todo] = (left << shift) | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def targets(sizes: list[int]) -> list[float]:
    """Sources in order weigh 1, 2, 3, repeating, and share the whole size; a target above 3 times its source's size
    stops there, and the excess is shared by weight among the others."""
    weights = [i % 3 + 1 for i in range(len(sizes))]
    open_, out, rest = [i for i, s in enumerate(sizes)], [0.0] * len(sizes), float(sum(sizes))
    while open_:
        total = sum(weights[i] for i in open_)
        over = [i for i in open_ if rest * weights[i] / total > 3 * sizes[i]]
        if not over:
            for i in open_:
                out[i] = rest * weights[i] / total
            break
        for i in over:
            out[i] = 3.0 * sizes[i]
        rest -= sum(3 * sizes[i] for i in over)
        gone = set(over)
        open_ = [i for i in open_ if i not in gone]
    return out


def quota(size: int, target: float, block_words: int, seed: int, source: int) -> tuple[int, int]:
    """Slots that a source gets, and the words used of the last."""
    words = round(target)
    if not size or not words:
        return 0, 0
    blocks, short = -(-size // block_words), size - (size - 1) // block_words * block_words
    epochs, rest = divmod(words, size)
    if not rest:
        last = int(permute(np.array([blocks - 1]), blocks, _keys(seed, source, epochs - 1))[0])
        return epochs * blocks, short if last == blocks - 1 else block_words
    at = int(permute(np.array([blocks - 1]), blocks, _keys(seed, source, epochs), inverse=True)[0])
    before = lambda k: k * block_words if k <= at else (k - 1) * block_words + short
    slots = max(1, rest // block_words)
    while before(slots) < rest:
        slots += 1
    return epochs * blocks + slots, rest - before(slots - 1)


#: Counts beyond which numpy's generator isn't defined; standard deviations around the mode beyond which no draw falls (less than 1e-30).
EXACT, WIDTH = 10**9, 12


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of `n` draws without return are good. Beyond EXACT by inversion of the same law: its values around the mode come from one
    another by the ratio of neighbours."""
    low, high = max(0, n - bad), min(n, good)
    if low == high:
        return low
    if good < EXACT and bad < EXACT:
        return int(rng.hypergeometric(good, bad, n))
    share = good / (good + bad)
    spread = int(WIDTH * (n * share * (1 - share) * (good + bad - n) / (good + bad - 1)) ** 0.5) + WIDTH
    mode = (n + 1) * (good + 1) // (good + bad + 2)
    low, high = max(low, mode - spread), min(high, mode + spread)
    k = np.arange(low, high, dtype=np.float64)
    steps = np.log(good - k) + np.log(n - k) - np.log(k + 1) - np.log(bad - n + k + 1)
    weight = np.concatenate([[0.0], np.cumsum(steps)])
    total = np.cumsum(np.exp(weight - weight.max()))
    return min(high, low + int(np.searchsorted(total, rng.random() * total[-1], "right")))


def dealt(counts: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """Multinomial counts of `n` slots, given that `counts` are there in all."""
    out, rest = np.zeros_like(counts), int(counts.sum())
    for s in np.flatnonzero(counts):
        have = int(counts[s])
        out[s] = _hypergeometric(rng, have, rest - have, n)
        n, rest = n - int(out[s]), rest - have
    return out


def shards(quotas: np.ndarray, shard_slots: int, seed: int, low: int, high: int) -> Iterator[tuple[int, int, int, int]]:
    """(shard, source, the source's slots before, slots) of the shards from `low` to `high`."""
    total = int(quotas.sum())
    todo = [(0, -(-total // shard_slots), quotas, np.zeros_like(quotas))]
    while todo:
        a, b, counts, first = todo.pop()
        if b <= low or a >= high or a >= b:
            continue
        if b - a == 1:
            yield from ((a, int(s), int(first[s]), int(counts[s])) for s in np.flatnonzero(counts))
            continue
        middle = (a + b) // 2
        left = dealt(counts, (middle - a) * shard_slots, np.random.default_rng([seed, a, b]))
        todo += [(middle, b, counts - left, first + left), (a, middle, left, first)]


def _slots(seed: int, shard_slots: int, shared):
    def expand(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        quotas, blocks, last_words = shared.value
        for frame in frames:
            for group in frame["id"]:
                for shard, source, first, slots in shards(quotas, shard_slots, seed, int(group) * SHARDS, (int(group) + 1) * SHARDS):
                    n = int(blocks[source])
                    slot = np.arange(first, first + slots)
                    epoch, block = slot // n, np.empty(slot.size, np.int64)
                    for e in np.unique(epoch):
                        block[epoch == e] = permute(slot[epoch == e] % n, n, _keys(seed, source, int(e)))
                    cut = pd.array(np.where(slot == quotas[source] - 1, last_words[source], 0), "Int64")
                    cut[slot != quotas[source] - 1] = pd.NA
                    yield pd.DataFrame({"shard": shard, "source_no": source, "slot": slot, "block": block, "cut": cut})

    return expand


def mix(docs: DataFrame, block_words: int = 128, shard_slots: int = 8192, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """Mix `docs` (doc_id, text, source) and return (documents, slots).

    documents: doc_id, size, source_size, target, taken, one row for each row of `docs`. slots: shard, source_no, slot,
    block, the mix itself; a source's blocks follow its documents in the order of a hash bucket, doc_id and text hash.
    Null or empty texts have size 0 and taken 0; a null source is a source of its own, last in order; repeated rows are
    taken one by one; an empty table gives two empty tables. Other columns are ignored. Sources are a dimension of the mix: their
    totals, some hundred bytes for each, are planned on the driver and sent to all executors.
    """
    spark = docs.sparkSession
    sized = written(docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64("text").alias("tie")), "mix-sizes")
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n")).collect()
    totals.sort(key=lambda r: (r.source is None, [ord(c) for c in r.source or ""]))
    sizes = [int(r.source_size) for r in totals]
    goal = targets(sizes)
    plans = [quota(s, t, block_words, seed, i) for i, (s, t) in enumerate(zip(sizes, goal, strict=True))]
    sources = spark.createDataFrame(
        [(r.source, i, sizes[i], goal[i], -(-sizes[i] // block_words), plans[i][0], plans[i][1], max(1, r.n // BUCKET_ROWS)) for i, r in enumerate(totals)],
        "source string, source_no long, source_size long, target double, blocks long, quota long, last_words long, buckets long",
    )
    # Word positions within a source: sums of hash buckets first, so that no window holds a whole source.
    known = sized.join(sources, sized.source.eqNullSafe(sources.source)).drop(sources.source).withColumn("bucket", F.pmod(F.xxhash64("doc_id", "tie"), "buckets"))
    full = known.filter("size > 0")
    sums = full.groupBy("source_no", "bucket").agg(F.sum("size").alias("words")).withColumn("wide", F.floor(F.col("bucket") / WIDE))
    wider = sums.groupBy("source_no", "wide").agg(F.sum("words").alias("wide_words"))
    wider = wider.select("source_no", "wide", (F.sum("wide_words").over(Window.partitionBy("source_no").orderBy("wide")) - F.col("wide_words")).alias("wide_before"))
    within = F.sum("words").over(Window.partitionBy("source_no", "wide").orderBy("bucket")) - F.col("words")
    before = sums.withColumn("within", within).join(wider, ["source_no", "wide"]).select("source_no", "bucket", (F.col("wide_before") + F.col("within")).alias("before"))
    # One job for each step, with few shuffles at a time: a task of any shuffle takes memory of the driver while it runs.
    with small_steps(spark):
        before = written(before, "mix-buckets")
        collect_garbage(spark)
    within = Window.partitionBy("source_no", "bucket").orderBy("doc_id", "tie", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = full.withColumn("end", F.sum("size").over(within)).join(before, ["source_no", "bucket"]).withColumn("end", F.col("end") + F.col("before")).withColumn("start", F.col("end") - F.col("size"))
    quotas, last_words = (np.array([p[k] for p in plans], np.int64) for k in (0, 1))
    blocks = np.array([-(-x // block_words) for x in sizes], np.int64)
    groups = -(-int(quotas.sum()) // (shard_slots * SHARDS))
    slots = spark.range(0, groups, 1, max(1, min(groups, 10_000))).mapInPandas(_slots(seed, shard_slots, spark.sparkContext.broadcast((quotas, blocks, last_words))), "shard long, source_no long, slot long, block long, cut long")
    # Times that a block is taken whole, and the words of it that the source's last slot takes. They are as many as the corpus has blocks:
    # joins with them merge at every size.
    with small_steps(spark):
        taken = written(slots.groupBy("source_no", "block").agg(F.sum(F.when(F.col("cut").isNull(), 1).otherwise(0)).alias("times"), F.max("cut").alias("cut")), "mix-blocks")
    b = F.lit(block_words)
    low, high = F.greatest("start", F.col("block") * b), F.least("end", (F.col("block") + 1) * b)
    cut = F.greatest(F.lit(0), F.least(high, F.col("block") * b + F.coalesce("cut", F.lit(0))) - low)
    keys = ["source_no", "start", "doc_id", "size", "source_size", "target"]
    parts = placed.select(*keys, "end", F.explode(F.sequence(F.floor(F.col("start") / b), F.floor((F.col("end") - 1) / b))).alias("block"))
    words = parts.join(taken.hint("merge"), ["source_no", "block"], "left").groupBy(*keys).agg(F.coalesce(F.sum((high - low) * F.col("times") + cut), F.lit(0)).cast("long").alias("taken"))
    out = ["doc_id", "size", "source_size", "target", "taken"]
    collect_garbage(spark)
    with small_steps(spark):
        documents = written(words.select(*out).unionByName(known.filter("size = 0").withColumn("taken", F.lit(0).cast("long")).select(*out)), "mix")
    discard(sized, before, taken)
    return documents, slots.drop("cut")


def op5_mix(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))[0]
