"""Benchmark decontamination under edit distance.

An item is found where a stretch of a text is within a tenth of the item's length in edits (UTF-8 bytes of normalised texts:
lower case, letters and digits, one space between).

Candidates come from locality-sensitive hashing of CGK random-walk embeddings. A walk copies the symbol under its head at each step and
moves on by a random bit of step and symbol, so that two strings' walks come together again behind an edit, and edit distance becomes
Hamming distance. Hashed are the windows of BLOCK bytes at word starts of texts and of items: with a tenth of a long item in edits, the
embeddings of whole windows of its size agree no more than by chance, while some of its blocks have few edits. A table samples SYMBOLS
steps of a walk; TABLES tables of each of WALKS walks bring recall to its target (measured in the tests, by distance and length). A
window that agrees with a block in all symbols of AGREE tables is a candidate: one table is met by chance, the second hardly. It goes on
if the bytes behind it are within BLOCK_EDITS, and then to the exact edit distance (Myers' bit vectors), by way of growing
neighbourhoods.

Items under SHORT bytes have few blocks and are searched exactly: a stretch with at most d edits holds one of d + 1 pieces unchanged, so
windows around the pieces' occurrences are all there is to look at. Pieces are joined two by two; some intact piece has neighbourhoods
of 2, 4, ... pieces with at most 1, 3, ... edits, which drops most of the others and loses nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalens.llm.storage import bounded_batches, discard, table, written
from stratalens.llm.textbytes import slices, text_bytes

RATIO = 0.1
#: Items below so many bytes are searched exactly.
SHORT = 100
#: Bytes of a window; walks, and tables of each; tables in which a candidate agrees at least.
BLOCK, WALKS, TABLES, AGREE = 24, 1, 16, 2
#: Symbols that a table samples for up to BLOCKS blocks of items; one more, and more tables, for every fourfold beyond.
SYMBOLS, BLOCKS = 8, 1 << 13
#: A candidate goes on if its next VERIFIED bytes are within BLOCK_EDITS, and larger neighbourhoods within LOCAL of their size.
VERIFIED, BLOCK_EDITS, LOCAL = 32, 5, 0.25
#: Bytes of a word from which on windows start within it, too.
LONG_WORD = 16
#: Neighbourhoods of up to 2^BANDED pieces are compared for all anchors side by side, larger ones one by one.
BANDED = 2
#: Items of a block are sent to all executors, with an index of some 70 bytes for each of theirs; larger benchmarks are taken in several
#: blocks.
BLOCK_BYTES = 1 << 20
_PAD = 0
_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)


def normalise(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of the normalised texts."""
    raw, at = text_bytes(pc.utf8_lower(column))
    word = ((raw >= 97) & (raw <= 122)) | ((raw >= 48) & (raw <= 57)) | (raw >= 128)
    row_start = np.zeros(raw.size + 1, bool)
    row_start[at[:-1]] = True
    # A byte between words stays if it ends a word and isn't the last of its row's.
    keep = word.copy()
    keep[1:] |= word[:-1] & ~row_start[1:-1]
    out = np.where(word, raw, 32)[keep]
    count = np.concatenate([[0], np.cumsum(keep)])
    return out, count[at]


def edit_distance_within(pattern: bytes, text: bytes, most: int) -> int | None:
    """Least edit distance of `pattern` to any substring of `text`, None if above `most`."""
    n = len(pattern)
    masks: dict[int, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | (1 << i)
    full, top = (1 << n) - 1, 1 << (n - 1)
    pv, mv, score, best = full, 0, n, n
    for c in text:
        eq = masks.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | (~(xh | pv) & full), pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = (ph << 1) & full, (mh << 1) & full
        pv, mv = mh | (~(xv | ph) & full), ph & xv
        if score < best:
            best = score
    return best if best <= most else None


PIECE = [("head", np.uint64), ("tail", np.uint64), ("low", np.int64), ("size", np.int64), ("item", np.int64), ("part", np.int64)]


def build(items: list[tuple[int, str | None]], ratio: float = RATIO) -> dict:
    """Index of a block of items: pieces of the short ones by the bytes at their ends, tables over the blocks of the others. Items
    without a letter or digit match nothing."""
    kept, pieces = [], {}
    for item_id, text in items:
        b = normalise(pa.array([text or ""], pa.large_string()))[0].tobytes().strip()
        if not b:
            continue
        d = int(ratio * len(b))
        for j in range(d + 1 if len(b) < SHORT else 0):
            low, high = j * len(b) // (d + 1), (j + 1) * len(b) // (d + 1)
            width = min(8, high - low)
            pieces.setdefault(width, []).append((int.from_bytes(b[low : low + width], "little"), int.from_bytes(b[high - width : high], "little"), low, high - low, len(kept), j))
        kept.append((item_id, b, d))
    sizes = np.array([len(b) for _, b, _ in kept], np.int64)
    index = {"items": kept, "sizes": sizes, "parts": np.array([d + 1 for _, _, d in kept], np.int64), "pieces": {}}
    index["flat"], index["begin"] = np.frombuffer(b"".join(b for _, b, _ in kept), np.uint8), np.cumsum(sizes) - sizes
    for width, rows in pieces.items():
        table_ = np.array(sorted(rows), dtype=PIECE)
        index["pieces"][width] = (table_, _bitmap(table_["head"]))
    long = np.flatnonzero(sizes >= SHORT)
    starts = [word_starts(np.frombuffer(kept[i][1], np.uint8), np.array([0, sizes[i]])) for i in long]
    starts = [x[x + BLOCK <= sizes[i]] for i, x in zip(long, starts, strict=True)]
    index["block_item"] = np.repeat(long, [x.size for x in starts]).astype(np.int64)
    index["block_low"] = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    index["walks"], index["tables"] = walks(index["block_item"].size), []
    padded = np.concatenate([index["flat"], np.zeros(2 * BLOCK + 2, np.uint8)])
    for keys in embedded(padded, index["begin"][index["block_item"]] + index["block_low"], index["walks"]) if index["block_item"].size else ():
        order = np.argsort(keys, kind="stable")
        index["tables"].append((keys[order], order.astype(np.int32), _bitmap(keys)))
    return index


def _slot(keys: np.ndarray, bits: int) -> np.ndarray:
    """Place of 64- or 32-bit keys in a bitmap."""
    if keys.dtype == np.uint32:
        return (keys * np.uint32(0x85EBCA6B)) >> np.uint32(32 - bits)
    return (keys * _MULTIPLY) >> np.uint64(64 - bits)


def _bitmap(keys: np.ndarray) -> np.ndarray:
    """A bitmap of about sixteen bytes for each key, a megabyte at most: small ones stay in the processor's cache."""
    bits = min(20, max(12, (16 * keys.size).bit_length()))
    seen = np.zeros(1 << bits, bool)
    seen[_slot(keys, bits)] = True
    return seen


def word_starts(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where windows start in normalised texts: at words, and within long ones (scripts without spaces) where a hash of the next four
    bytes says so, about every fourth byte, which an item and its copies agree on, wherever in a word they begin."""
    first = np.zeros(raw.size + 1, bool)
    first[1:] = raw == 32
    first[at[:-1]] = True
    first = first[: raw.size] & (raw != 32)
    starts = np.flatnonzero(first)
    if not starts.size:
        return starts
    size = np.diff(np.append(starts, raw.size)) - 1
    long = size >= LONG_WORD
    begin, size = starts[long] + 1, size[long]
    inner = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())
    inner = inner[inner + 4 <= raw.size]
    inner = inner[raw[inner] != 32]
    four = raw[inner].astype(np.uint32) | raw[inner + 1].astype(np.uint32) << np.uint32(8) | raw[inner + 2].astype(np.uint32) << np.uint32(16) | raw[inner + 3].astype(np.uint32) << np.uint32(24)
    return np.union1d(starts, inner[(four * np.uint32(0x9E3779B1)) >> np.uint32(30) == 0]) if inner.size else starts


def walks(blocks: int) -> list[tuple[np.ndarray, list[list[int]]]]:
    """The walks' moves (step, symbol), and for each step the tables that sample it. The more blocks, the more symbols a table samples,
    so that chance agreement stays rare, and the more tables there are, so that recall does not fall."""
    more = max(0, math.ceil(math.log(max(blocks, 1) / BLOCKS, 4)))
    out = []
    for w in range(WALKS):
        rng = np.random.default_rng([404, w])
        moves = rng.integers(0, 2, (2 * BLOCK, 256)).astype(np.uint8)
        sampled = [set(rng.choice(2 * BLOCK, SYMBOLS + more, replace=False).tolist()) for _ in range(TABLES + 4 * more)]
        out.append((moves, [[t for t, steps in enumerate(sampled) if j in steps] for j in range(2 * BLOCK)]))
    return out


def embedded(padded: np.ndarray, starts: np.ndarray, walks_: list) -> Iterator[np.ndarray]:
    """For each table the hashes of the symbols that it samples of the embeddings of the windows at `starts`. `padded` must go on for two
    windows behind any start."""
    for moves, sampled in walks_:
        head = starts.astype(np.int32)
        keys = np.zeros((1 + max(t for step in sampled for t in step), starts.size), np.uint32)
        for step, tables in enumerate(sampled):
            symbol = padded[head]
            for t in tables:
                keys[t] *= np.uint32(0x9E3779B1)
                keys[t] += symbol
                keys[t] ^= keys[t] >> np.uint32(15)
            head += moves[step][symbol]
        yield from keys


def _node(index: dict, item, part, level: int):
    """Bounds in the item, and edits allowed, of the neighbourhood of 2^level pieces that holds a piece."""
    parts, size = index["parts"][item], index["sizes"][item]
    first = (part >> level) << level
    last = np.minimum(first + (1 << level), parts)
    return first * size // parts, last * size // parts, last - first - 1


def _within(raw: np.ndarray, at: np.ndarray, index: dict, row: np.ndarray, place: np.ndarray, pattern: np.ndarray, size: np.ndarray, band: int) -> np.ndarray:
    """Least edits of the patterns (starts in the items' bytes, sizes) against texts that start at `place`, give or take `band` bytes: an
    alignment with so many edits keeps to the diagonals of a band."""
    spots = place[:, None] + np.arange(-band, band + 1)
    left, right = at[row][:, None], at[row + 1][:, None]
    cost = np.zeros(spots.shape, np.int16)
    for i in range(int(size.max()) if size.size else 0):
        inside = (spots + i >= left) & (spots + i < right)
        symbol = np.where(inside, raw[np.clip(spots + i, 0, raw.size - 1)], _PAD)
        now = cost + (symbol != index["flat"][np.minimum(pattern + i, index["flat"].size - 1)][:, None])
        now[:, :-1] = np.minimum(now[:, :-1], cost[:, 1:] + 1)
        for k in range(1, now.shape[1]):
            now[:, k] = np.minimum(now[:, k], now[:, k - 1] + 1)
        cost = np.where((i < size)[:, None], now, cost)
    return cost.min(1) if size.size else np.zeros(0, np.int16)


def _banded(raw: np.ndarray, at: np.ndarray, index: dict, row: np.ndarray, item: np.ndarray, low: np.ndarray, part: np.ndarray, level: int) -> np.ndarray:
    """Which anchors have a neighbourhood of 2^level pieces within its edits."""
    start, end, allowed = _node(index, item, part, level)
    return _within(raw, at, index, row, low + start, index["begin"][item] + start, end - start, (1 << level) - 1) <= allowed


def _expanded(keys: np.ndarray, table_: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(spot, place in the sorted table) of all equal keys."""
    spots = np.flatnonzero(seen[_slot(keys, seen.size.bit_length() - 1)])
    first, last = np.searchsorted(table_, keys[spots], "left"), np.searchsorted(table_, keys[spots], "right")
    count = last - first
    return np.repeat(spots, count), np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())


def _anchors(raw: np.ndarray, at: np.ndarray, index: dict) -> tuple[np.ndarray, ...]:
    """Occurrences of pieces of short items whose neighbourhoods are near enough: row, item, start of the item, piece."""
    out = []
    eight = np.lib.stride_tricks.sliding_window_view(np.concatenate([raw, np.zeros(7, np.uint8)]), 8).copy().view(np.uint64).ravel()
    for width, (pieces, seen) in index["pieces"].items():
        grams = eight & np.uint64((1 << (8 * width)) - 1)
        spot, which = _expanded(grams, pieces["head"], seen)
        tail = spot + pieces["size"][which] - width
        row = np.searchsorted(at, spot, "right") - 1
        good = tail + width <= at[row + 1]
        good[good] = grams[tail[good]] == pieces["tail"][which[good]]
        spot, which, row = spot[good], which[good], row[good]
        found = [row, pieces["item"][which], spot - pieces["low"][which], pieces["part"][which]]
        for level in range(1, BANDED + 1):
            near = [_banded(raw, at, index, *[x[k : k + 65536] for x in found], level) for k in range(0, found[0].size, 65536)]
            near = np.concatenate(near) if near else np.zeros(0, bool)
            found = [x[near] for x in found]
        out.append(found)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 4


def _near_blocks(raw: np.ndarray, at: np.ndarray, index: dict, row: np.ndarray, block: np.ndarray, spot: np.ndarray) -> np.ndarray:
    """Which candidates' next VERIFIED bytes are within BLOCK_EDITS of what follows the block."""
    item, low = index["block_item"][block], index["block_low"][block]
    size = np.minimum(VERIFIED, index["sizes"][item] - low)
    return _within(raw, at, index, row, spot, index["begin"][item] + low, size, BLOCK_EDITS) <= BLOCK_EDITS


def candidates(raw: np.ndarray, at: np.ndarray, index: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows that agree with a block of a long item in AGREE tables, and are near it: row, block, start of the window."""
    starts = word_starts(raw, at)
    padded = np.concatenate([raw, np.zeros(2 * BLOCK + 2, np.uint8)])
    found = [np.zeros(0, np.int64)]
    blocks = max(1, index["block_item"].size)
    for low in range(0, starts.size, 1 << 15):
        part = starts[low : low + (1 << 15)]
        for keys, (table_, order, seen) in zip(embedded(padded, part, index["walks"]), index["tables"], strict=True):
            spot, place = _expanded(keys, table_, seen)
            found.append(part[spot] * blocks + order[place])
    pairs = np.sort(np.concatenate(found))
    first = np.flatnonzero(np.append(True, pairs[1:] != pairs[:-1])) if pairs.size else pairs
    pairs = pairs[first][np.diff(np.append(first, pairs.size)) >= AGREE]
    spot, block = pairs // blocks, pairs % blocks
    row = np.searchsorted(at, spot, "right") - 1
    near = [_near_blocks(raw, at, index, row[k : k + 65536], block[k : k + 65536], spot[k : k + 65536]) for k in range(0, row.size, 65536)]
    near = np.concatenate(near) if near else np.zeros(0, bool)
    return row[near], block[near], spot[near]


def find(column: pa.Array, index: dict) -> list[list[tuple[int, int, int]]]:
    """For each text the items in it: (item_id, least edits, edits allowed)."""
    raw, at = normalise(column)
    out: list[dict] = [{} for _ in range(len(column))]
    if not raw.size or not index["sizes"].size:
        return [[] for _ in out]
    known: dict[tuple[int, ...], int | None] = {}

    def least(r: int, i: int, start: int, end: int, allowed: int, place: int) -> int | None:
        """Least edits of a part of an item where it starts about `place`; one look answers for `allowed` + 1 places."""
        first = place // (allowed + 1) * (allowed + 1)
        key = (r, i, start, end, first)
        if key not in known:
            text = raw[max(int(at[r]), first - allowed) : max(0, min(int(at[r + 1]), first + 2 * allowed + end - start))]
            known[key] = edit_distance_within(index["items"][i][1][start:end], text.tobytes(), allowed)
        return known[key]

    def whole(r: int, i: int, place: int) -> None:
        pattern, most = index["items"][i][1:]
        edits = least(r, i, 0, len(pattern), most, place)
        if edits is not None and edits <= out[r].get(i, most):
            out[r][i] = edits

    if index["pieces"]:
        row, item, low, part = _anchors(raw, at, index)
        for k in np.lexsort((low, item, row)):
            r, i, p, place = int(row[k]), int(item[k]), int(part[k]), int(low[k])
            most, level, good = index["items"][i][2], BANDED + 1, True
            while good and 1 << level <= most:
                start, end, allowed = map(int, _node(index, i, p, level))
                good = least(r, i, start, end, allowed, place + start) is not None
                level += 1
            if good:
                whole(r, i, place)
    if index["tables"]:
        row, block, spot = candidates(raw, at, index)
        item, offset = index["block_item"][block], index["block_low"][block]
        for k in np.lexsort((spot - offset, item, row)):
            r, i, o, place = int(row[k]), int(item[k]), int(offset[k]), int(spot[k])
            pattern, most = index["items"][i][1:]
            size, good = 4 * VERIFIED, (r, i, 0, len(pattern), (place - o) // (most + 1) * (most + 1)) not in known
            if not good:
                continue
            while good and size < len(pattern):
                start = max(0, min(o - size // 2, len(pattern) - size))
                good = least(r, i, start, start + size, min(most, int(LOCAL * size)), place - o + start) is not None
                size *= 4
            if good:
                whole(r, i, place - o)
    return [sorted((index["items"][i][0], e, index["items"][i][2]) for i, e in o.items()) for o in out]


MATCHES = "array<struct<item_id:long,edits:long,allowed:long>>"


def _searcher(shared):
    def search(texts: pd.Series) -> pd.Series:
        column = pa.array(texts, pa.large_string(), from_pandas=True)
        out = []
        for part in slices(pa.RecordBatch.from_arrays([column], ["text"])):
            out += [[{"item_id": i, "edits": e, "allowed": d} for i, e, d in row] for row in find(part.column("text"), shared.value)]
        return pd.Series(out, dtype=object)

    search.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return search


def contamination(docs: DataFrame, benchmark: DataFrame, ratio: float = RATIO, block_bytes: int = BLOCK_BYTES, into: str = "contamination") -> DataFrame:
    """`docs` (text, any others) with a column `into` of the items (benchmark: item_id, text) in each text, at most a tenth of an item's
    normalised bytes in edits, rounded down.

    Null and empty texts and items, and items without a letter or digit, match nothing; items of a few bytes match wherever they stand;
    repeated rows are searched one by one; items that share an id are searched one by one; an empty benchmark matches nothing. Texts
    are searched as a whole. A benchmark above `block_bytes` is taken in several blocks, one after the other: each one's matches are
    written before the next one is sent out, so memory doesn't grow with the benchmark. A column of the name `into` is replaced.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    items = benchmark.filter("text is not null and item_id is not null").select("item_id", "text")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(total / block_bytes))
    out = docs
    for k in range(blocks):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect() if blocks > 1 else items.collect()
        shared = spark.sparkContext.broadcast(build(sorted((r.item_id, r.text) for r in rows), ratio))
        found = F.pandas_udf(_searcher(shared), MATCHES)("text")
        if blocks == 1:
            return docs.withColumn(into, found)
        last, out = out, written(out.withColumn(into, F.concat(F.col(into), found) if k else found), "matches")
        discard(last)
        shared.unpersist()
    return out


def op4_decontaminate(spark, sf_dir: str) -> DataFrame:
    """One row for each document and item found in it."""
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    matches = found.select("doc_id", F.explode("contamination").alias("m"))
    return matches.groupBy("doc_id", "m.item_id").agg(F.min("m.edits").alias("edits"), F.max("m.allowed").alias("allowed"))
