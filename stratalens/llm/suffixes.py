"""Exact removal of repeated byte strings by suffix arrays.

Every window of LENGTH bytes contains a minimizer: the least hash among its GRAM-byte substrings, leftmost on ties, which
depends on the window alone. So equal windows, wherever they are, share their minimizer and its place in them. This splits the
suffixes of the corpus into groups that never need comparing with one another, and windows whose minimizer occurs once are
unique and leave at once. What remains (a minimizer with the windows that chose it: a context) is first collapsed where equal,
keeping the earliest place, so that any number of copies costs one (contexts are named by their 128-bit BLAKE2 digests, so equal names
mean equal bytes); the distinct contexts are then dealt out by minimizer, and
each task sorts the suffixes of its contexts by the difference-cover algorithm: triples at positions not divisible by 3 are
sorted and named, the sequence of names is sorted by recursion, the remaining suffixes are merged in by the ranks found, and
neighbours in the suffix array are compared for equal prefixes of LENGTH bytes. The earliest of equal ones stays.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalens.llm.storage import bounded_batches, collect_garbage, discard, table, written
from stratalens.llm.textbytes import Spans, slices, text_bytes

LENGTH = 100
GRAM = 32
#: Grams in a window.
REACH = LENGTH - GRAM + 1
#: Bytes of contexts that a task sorts at once (a minimizer's contexts are never parted).
SORT_BYTES = 1 << 20
#: Contexts that a task remembers to have sent.
SENT = 500_000
_NULL_ID = (1 << 63) - 1


def _slide(x: np.ndarray, width: int, pick) -> np.ndarray:
    """`pick` (minimum or maximum) over every `width` neighbours, by doubling."""
    have = 1
    while have * 2 <= width:
        x = pick(x[:-have], x[have:])
        have *= 2
    return pick(x[: x.size - (width - have)], x[width - have :]) if width > have else x


def winnow(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gram hashes, each window's least hash (0 where a window isn't within one row), and the minimizers' positions."""
    if raw.size < LENGTH:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    grams = Spans(raw).windows(GRAM) | np.uint64(1)
    least = _slide(grams, REACH, np.minimum)
    inner = at[1:-1]
    if inner.size:
        crossing = np.zeros(raw.size + 1, np.int32)
        np.add.at(crossing, np.maximum(inner - LENGTH + 1, 0), 1)
        np.add.at(crossing, inner, -1)
        least[np.cumsum(crossing)[: least.size] > 0] = 0
    padded = np.concatenate([np.zeros(REACH - 1, np.uint64), least, np.zeros(REACH - 1, np.uint64)])
    return grams, least, np.flatnonzero(_slide(padded, REACH, np.maximum)[: grams.size] == grams)


def _minimizers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            raw, at = text_bytes(part.column("text"))
            grams, _, places = winnow(raw, at)
            row = np.searchsorted(at, places, "right") - 1
            yield pa.RecordBatch.from_arrays([pa.array(grams[places].view(np.int64)), part.column("doc").take(pa.array(row)), part.column("tie").take(pa.array(row)), pa.array((places - at[row]).astype(np.int64))], ["mini", "doc", "tie", "place"])


CONTEXTS = "mini long, doc long, tie int, start long, size long, key binary, context binary"


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each text with repeated minimizers: its contexts; a later one that equals an earlier of the same text comes
    without key: it is a repeat already. A task sends the bytes of equal contexts once (or anew when it has seen very many)."""
    sent: set[bytes] = set()
    for batch in batches:
        for part in slices(batch, "text", 1 << 20):
            out: list[list] = [[] for _ in range(7)]
            texts, places = part.column("text"), part.column("places")
            for i in range(part.num_rows):
                raw, at = text_bytes(texts.slice(i, 1))
                grams, least, picked = winnow(raw, at)
                if not least.size:
                    continue
                # The leftmost position with the window's least hash.
                chosen = np.searchsorted(picked, np.arange(least.size))
                todo = np.flatnonzero(grams[picked[chosen]] != least)
                while todo.size:
                    chosen[todo] += 1
                    todo = todo[grams[picked[chosen[todo]]] != least[todo]]
                chosen = picked[chosen]
                known = np.zeros(grams.size, bool)
                known[np.asarray(places[i].values.to_numpy(zero_copy_only=False), np.int64)] = True
                starts = np.flatnonzero(np.append(True, chosen[1:] != chosen[:-1]))
                ends = np.append(starts[1:], least.size) - 1 + LENGTH
                use = known[chosen[starts]]
                starts, ends = starts[use], ends[use]
                if not starts.size:
                    continue
                blob, bounds = raw.tobytes(), list(zip(starts.tolist(), ends.tolist(), strict=True))
                names = [hashlib.blake2b(blob[s:e], digest_size=16).digest() for s, e in bounds]
                here: set[bytes] = set()
                first = [not (n in here or here.add(n)) for n in names]
                out[0] += grams[chosen[starts]].view(np.int64).tolist()
                out[1] += [part.column("doc")[i].as_py()] * starts.size
                out[2] += [part.column("tie")[i].as_py()] * starts.size
                out[3] += starts.tolist()
                out[4] += (ends - starts).tolist()
                out[5] += [n if f else None for n, f in zip(names, first, strict=True)]
                out[6] += [blob[s:e] if f and n not in sent else None for (s, e), f, n in zip(bounds, first, names, strict=True)]
                sent.update(names)
                if len(sent) > SENT:
                    sent = set()
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["mini", "doc", "tie", "start", "size", "key", "context"])


def _sorted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the keys (from 0), and their dense ranks (from 1) in that order; sorts key and index as one number if they fit."""
    bits = max(1, (keys.size - 1).bit_length())
    if keys.size and int(keys.max()).bit_length() + bits < 63:
        packed = np.sort((keys << bits) | np.arange(keys.size))
        order, keys = packed & ((1 << bits) - 1), packed >> bits
    else:
        order = np.argsort(keys)
        keys = keys[order]
    new = np.ones(keys.size, bool)
    new[1:] = keys[1:] != keys[:-1]
    return order, np.cumsum(new)


def suffix_array(s: np.ndarray, depth: int) -> np.ndarray:
    """Positions of `s` (values from 1) in the order of their suffixes; equal prefixes of `depth` may come in any order.

    Difference cover {1, 2} modulo 3.
    """
    n = s.size
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    padded = np.concatenate([s, np.zeros(5, s.dtype)]).astype(np.int64)
    base = int(s.max()) + 1
    one, two = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)  # position n, when n % 3 == 1, parts the two halves
    sample = np.concatenate([one, two])
    if base < 1 << 20:
        order, ranks = _sorted((padded[sample] * base + padded[sample + 1]) * base + padded[sample + 2])
    else:  # name the pairs first
        order, ranks = _sorted(padded[sample] * base + padded[sample + 1])
        pair = np.empty(sample.size, np.int64)
        pair[order] = ranks
        order, ranks = _sorted(pair * base + padded[sample + 2])
    names = np.empty(sample.size, np.int64)
    names[order] = ranks
    if depth > 3 and ranks[-1] < sample.size:
        order = suffix_array(names, -(-depth // 3) + 1)
        names[order] = np.arange(1, sample.size + 1)
    rank = np.zeros(n + 5, np.int64)
    rank[sample] = names
    sample_order = sample[order]
    sample_order = sample_order[sample_order < n]
    rest = np.arange(0, n, 3)
    top = int(names.max()) + 2
    key = padded[rest] * top + rank[rest + 1]
    by = _sorted(key)[0]
    rest, key = rest[by], key[by]
    # How many sampled suffixes come before each of the others: those at 1 and at 2 modulo 3 are compared in their own way.
    ones, twos = sample_order[sample_order % 3 == 1], sample_order[sample_order % 3 == 2]
    before = np.searchsorted(padded[ones] * top + rank[ones + 1], key)
    if float(base) * base * top < 2**62:
        before += np.searchsorted((padded[twos] * base + padded[twos + 1]) * top + rank[twos + 2], (padded[rest] * base + padded[rest + 1]) * top + rank[rest + 2])
    else:
        pairs, back = np.unique(np.concatenate([padded[twos] * base + padded[twos + 1], padded[rest] * base + padded[rest + 1]]), return_inverse=True)
        before += np.searchsorted(back[: twos.size] * top + rank[twos + 2], back[twos.size :] * top + rank[rest + 2])
    # Among suffixes that agree to the depth asked for, ranks may contradict one another: any order will do, but one it must be.
    before = np.maximum.accumulate(before)
    out = np.empty(n, np.int64)
    spots = before + np.arange(rest.size)
    out[spots] = rest
    free = np.ones(n, bool)
    free[spots] = False
    out[free] = sample_order
    return out


def repeated_starts(contexts: list[bytes], order: np.ndarray) -> np.ndarray:
    """Which windows equal one that comes earlier. `contexts` lie behind one another with a 0 between; `order` holds the rank of
    each byte's place in the corpus. True at the start of such a window."""
    joined = np.frombuffer(b"".join(c + b"\0" for c in contexts), np.uint8)
    sizes = np.array([len(c) + 1 for c in contexts])
    ends = np.cumsum(sizes)
    symbols = joined.astype(np.int64) + 2
    symbols[ends - 1] = 1
    left = np.repeat(ends - 1, sizes) - np.arange(joined.size)
    suffixes = suffix_array(symbols, LENGTH)
    suffixes = suffixes[left[suffixes] >= LENGTH]
    if suffixes.size < 2:
        return np.zeros(joined.size, bool)
    # Neighbours with equal prefixes: eight bytes at a time.
    words = np.lib.stride_tricks.as_strided(np.concatenate([joined, np.zeros(8, np.uint8)]), (joined.size, 8), (1, 1))
    equal = np.ones(suffixes.size - 1, bool)
    for k in [*range(0, LENGTH - 7, 8), LENGTH - 8]:
        here = np.flatnonzero(equal)
        equal[here] = (words[suffixes[here] + k] == words[suffixes[here + 1] + k]).all(1)
    group = np.concatenate([[0], np.cumsum(~equal)])
    earliest = np.minimum.reduceat(order[suffixes], np.flatnonzero(np.append(True, ~equal)))
    out = np.zeros(joined.size, bool)
    out[suffixes] = order[suffixes] > earliest[group]
    return out


def _trimmed(contexts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The contexts cut to the stretch from their first to their last window whose hash another window here shares, their
    numbers, and the bytes cut off in front; contexts without such a window have nothing to sort."""
    sizes = np.array([len(c) + 1 for c in contexts])
    ends = np.cumsum(sizes)
    hashes = Spans(np.frombuffer(b"".join(c + b"\0" for c in contexts), np.uint8)).windows(LENGTH)
    begins = ends - sizes
    valid = np.zeros(ends[-1] + 1, np.int32)
    np.add.at(valid, begins, 1)
    np.add.at(valid, np.maximum(ends - LENGTH, begins), -1)
    at = np.flatnonzero(np.cumsum(valid)[: hashes.size] > 0)
    order, ranks = _sorted((hashes[at] >> np.uint64(1)).astype(np.int64))
    twice = at[order][np.bincount(ranks)[ranks] > 1]
    owner = np.searchsorted(ends, twice, "right")
    first, last = np.full(sizes.size, np.iinfo(np.int64).max), np.full(sizes.size, -1)
    np.minimum.at(first, owner, twice)
    np.maximum.at(last, owner, twice)
    kept = np.flatnonzero(last >= 0)
    low, high = (first - begins)[kept], (last - begins)[kept] + LENGTH
    return [contexts[k][a:b] for k, a, b in zip(kept.tolist(), low.tolist(), high.tolist(), strict=True)], kept, low


def _ranges(contexts: list[bytes], doc: np.ndarray, tie: np.ndarray, start: np.ndarray) -> pa.RecordBatch:
    contexts, kept, offsets = _trimmed(contexts)
    doc, tie, start = doc[kept], tie[kept], start[kept] + offsets
    if not contexts:
        return pa.RecordBatch.from_arrays([pa.array([], pa.int64()), pa.array([], pa.int32()), pa.array([], pa.int64()), pa.array([], pa.int64())], ["doc", "tie", "low", "high"])
    sizes = np.array([len(c) + 1 for c in contexts])
    owner = np.repeat(np.arange(sizes.size), sizes)
    offset = np.arange(owner.size) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    place = start[owner] + offset
    # Contexts' places may overlap in a document: compare (document, place), not contexts.
    docs = np.unique(np.stack([doc, tie]), axis=1, return_inverse=True)[1].ravel()
    starts = repeated_starts(contexts, docs[owner].astype(np.int64) * (int(place.max()) + 1) + place)
    hit = np.flatnonzero(starts)
    fresh = np.append(True, (hit[1:] != hit[:-1] + 1)) if hit.size else np.zeros(0, bool)
    low, high = hit[fresh], hit[np.append(fresh[1:], True)] if hit.size else hit
    return pa.RecordBatch.from_arrays([pa.array(doc[owner[low]], pa.int64()), pa.array(tie[owner[low]], pa.int32()), pa.array(place[low], pa.int64()), pa.array(place[high] + LENGTH, pa.int64())], ["doc", "tie", "low", "high"])


def _sort_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranges of windows that equal an earlier one; rows come in the order of their minimizers."""
    held: list[pa.RecordBatch] = []

    def run(rows: pa.Table) -> pa.RecordBatch:
        return _ranges(rows.column("context").to_pylist(), rows.column("doc").to_numpy(), rows.column("tie").to_numpy(), rows.column("start").to_numpy())

    total = 0
    for batch in batches:
        for part in slices(batch, "context", SORT_BYTES // 4):
            held.append(part)
            total += part.column("context").nbytes
            if total >= SORT_BYTES:
                rows = pa.Table.from_batches(held)
                mini = rows.column("mini").to_numpy()
                cut = int(np.searchsorted(mini, mini[-1]))
                if cut:
                    yield run(rows.slice(0, cut))
                    held = rows.slice(cut).combine_chunks().to_batches()
                    total = sum(b.column("context").nbytes for b in held)
    if held:
        yield run(pa.Table.from_batches(held))


REMOVED = "doc long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<array<long>>"


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            raw, at = text_bytes(part.column("text"))
            blob, out = raw.tobytes(), []
            for i, ranges in enumerate(part.column("ranges").to_pylist()):
                low, high, spans = int(at[i]), int(at[i + 1]), []
                for r in sorted((r["low"], r["high"]) for r in ranges or []):
                    if spans and r[0] <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], r[1])
                    else:
                        spans.append(list(r))
                digest, past = hashlib.sha256(), low
                for s, e in spans:
                    digest.update(blob[past : low + s])
                    past = low + e
                digest.update(blob[past:high])
                out.append((high - low, sum(e - s for s, e in spans), len(spans), digest.hexdigest(), spans))
            columns = list(zip(*out, strict=True))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([part.column("doc"), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], ["doc", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """For each row of `docs` (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256 and spans ([start, end) removed).

    Removed is every byte covered by a string of LENGTH bytes that also starts earlier: in a document with a smaller id or
    further left in the same. Null texts are empty. Of documents with one id and different texts, a hash of the text decides
    which is earlier; rows equal in id and text count as one document and get the same result; a null id comes after all
    others. Texts under LENGTH bytes stay whole. Other columns are ignored.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL_ID)).alias("doc")
    # A hash of the text tells rows with one id apart; where ids are unique, as they should be, it would only weigh on shuffles.
    repeated = not docs.select(doc).groupBy("doc").count().filter("count > 1").isEmpty()
    base = docs.select(doc, (F.hash("text") if repeated else F.lit(0)).alias("tie"), F.coalesce("text", F.lit("")).alias("text"))
    minis = base.mapInArrow(_minimizers, "mini long, doc long, tie int, place long")
    # Counts are added up before they are dealt out, and a join with a hot minimizer can be split: no task holds all its places.
    minis = written(minis, "minimizers")
    often = minis.groupBy("mini").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("mini")
    twice = minis.join(often.hint("merge"), "mini", "left_semi")
    places = written(twice.groupBy("doc", "tie").agg(F.collect_set("place").alias("places")), "places")
    collect_garbage(spark)
    contexts = written(base.join(places.hint("merge"), ["doc", "tie"]).select("doc", "tie", "text", "places").mapInArrow(_contexts, CONTEXTS), "contexts")
    discard(places, minis)
    collect_garbage(spark)
    place = F.struct("doc", "tie", "start")
    # A context is named by its own hash and that of its minimizer.
    keyed = contexts.filter("key is not null")
    first = keyed.groupBy("key", "mini").agg(F.min(place).alias("p"), F.first("context", ignorenulls=True).alias("context"))
    first = written(first.select("key", "mini", "p.doc", "p.tie", "p.start", "context"), "first")
    collect_garbage(spark)
    sorted_ = first.repartition("mini").sortWithinPartitions("mini").select("mini", "doc", "tie", "start", "context").mapInArrow(_sort_contexts, "doc long, tie int, low long, high long")
    ends = [F.col("start").alias("low"), (F.col("start") + F.col("size")).alias("high")]
    later = keyed.drop("context").join(first.select("key", "mini", F.col("doc").alias("d"), F.col("tie").alias("t"), F.col("start").alias("s")), ["key", "mini"]).filter("not (doc = d and tie = t and start = s)").select("doc", "tie", *ends)
    within = contexts.filter("key is null").select("doc", "tie", *ends)
    ranges = written(sorted_.union(later).union(within).groupBy("doc", "tie").agg(F.collect_set(F.struct("low", "high")).alias("ranges")), "ranges")
    discard(contexts, first)
    collect_garbage(spark)
    found = base.join(ranges.hint("merge"), ["doc", "tie"], "left").select("doc", "text", "ranges").mapInArrow(_remove, REMOVED)
    return found.select(F.when(F.col("doc") != _NULL_ID, F.col("doc")).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans")


def op1_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("spans")
