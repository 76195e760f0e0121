"""Language ID of code-switched text by a linear-chain conditional random field over words.

Features of a word are its character n-grams with word edges (2, 3 and 4 bytes), its affixes and its entry in a learned
lexicon, all in fixed tables; transitions between the languages of neighbouring words are learned with them, on word
sequences that switch between segments of training documents. Forward-backward gives every word's posterior; a document's
language is the one with the largest posterior mass, weighted by the words' bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratalens.llm.storage import bounded_batches, table, trained
from stratalens.llm.textbytes import Spans, slices, text_bytes

HASH_BITS = 16
LEXICON = 4000
#: Bound of the training sample: documents are taken, in hash order, until a language has so many words.
TRAIN_WORDS = 40_000
#: Bound of the languages learned: those with most documents.
LANGUAGES = 200
WORD_CHARS = 12
SEQUENCE, BATCH, STEPS, RATE, DECAY = 48, 192, 70, 0.15, 1e-4
#: Chance that a training sequence goes on to another language after a segment of 3 to 24 words.
SWITCH = 0.35
_ORDERS = (2, 3, 4)
WORDS_AT_ONCE = 1 << 16
SCHEMA = "doc_id long, lang_pred string, score double, n_words long, n_switches long, shares array<double>"


def _table_ids(codes: np.ndarray, which: int) -> np.ndarray:
    return ((codes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - HASH_BITS)).astype(np.int64) + (which << HASH_BITS)


class Words:
    """The words of many texts: byte spans, row bounds, and the ids of their features."""

    def __init__(self, column: pa.Array):
        raw, at = text_bytes(pc.utf8_lower(column))
        letter = ((raw >= 97) & (raw <= 122)) | (raw >= 128)
        first, last = letter.copy(), letter.copy()
        first[1:] &= ~letter[:-1]
        last[:-1] &= ~letter[1:]
        edges = at[1:-1]
        edges = edges[(edges > 0) & (edges < raw.size)]
        first[edges], last[edges - 1] = letter[edges], letter[edges - 1]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.bounds = np.searchsorted(self.start, at)
        self.bytes = self.end - self.start
        self.letter, self.raw = letter, raw

    def position_features(self) -> Iterator[np.ndarray]:
        """For each order the feature id of the n-gram that starts one byte before each position (edges are spaces)."""
        n = self.raw.size
        padded = np.full(n + 4, 32, np.uint64)
        padded[1 : n + 1] = np.where(self.letter, self.raw, 32)
        code = padded[:n] + np.uint64(1)
        for which, order in enumerate(_ORDERS):
            for k in range(1 if which == 0 else _ORDERS[which - 1], order):
                code = code * np.uint64(257) + padded[k : k + n]
            yield _table_ids(code, which)

    def word_features(self, lexicon: np.ndarray) -> Iterator[np.ndarray]:
        """Prefix and suffix of up to 5 bytes, and the place in the lexicon (0: none)."""
        spans = Spans(self.raw)
        yield _table_ids(spans.hash(self.start, np.minimum(self.end, self.start + 5)), 3)
        yield _table_ids(spans.hash(np.maximum(self.start, self.end - 5), self.end), 4)
        whole = spans.hash(self.start, self.end)
        place = np.searchsorted(lexicon, whole)
        found = lexicon[np.minimum(place, max(lexicon.size - 1, 0))] == whole if lexicon.size else np.zeros(whole.size, bool)
        yield np.where(found, place + 1, 0) + (5 << HASH_BITS)

    def hashes(self) -> np.ndarray:
        return Spans(self.raw).hash(self.start, self.end)

    def _part(self, first: int, last: int) -> "Words":
        """The words from `first` to `last`, with as many bytes around them as features look at."""
        low, high = max(0, int(self.start[first]) - 8), min(self.raw.size, int(self.end[last - 1]) + 8)
        part = object.__new__(Words)
        part.raw, part.letter = self.raw[low:high], self.letter[low:high]
        part.start, part.end = self.start[first:last] - low, self.end[first:last] - low
        return part

    def scores(self, weights: np.ndarray, lexicon: np.ndarray, at_once: int = WORDS_AT_ONCE) -> np.ndarray:
        """Emission score of each word for each language; a bounded number of words at a time, so that long texts take no more memory
        than their words' scores."""
        out = np.zeros((self.start.size, weights.shape[1]))
        for first in range(0, self.start.size, at_once):
            part = self._part(first, min(first + at_once, self.start.size))
            summed = np.zeros((part.raw.size, weights.shape[1]), np.float32)
            for ids in part.position_features():
                summed += weights[ids]
            summed[~part.letter] = 0
            # Bytes around the part belong to words outside of it.
            summed[part.end[-1] :] = 0
            now = np.add.reduceat(summed, part.start, axis=0).astype(np.float64)
            for ids in part.word_features(lexicon):
                now += weights[ids]
            out[first : first + at_once] = now
        return out


def posteriors(scores: np.ndarray, bounds: np.ndarray, transition: np.ndarray, block: int = 128) -> np.ndarray:
    """Forward-backward over the rows' word sequences: each word's posterior over languages (log scores in).

    Sequences are cut into blocks. Each block's product of transfer matrices gives the exact messages at its two ends, and
    all blocks then run side by side, so a long text costs no more steps than a short one.
    """
    n, k = scores.shape
    if not n:
        return np.zeros((0, k))
    emit = np.exp(scores - scores.max(axis=1, keepdims=True)) + 1e-30
    step = np.exp(transition - transition.max())
    lengths = np.diff(bounds)
    per_row = -(-lengths // block)
    row = np.repeat(np.arange(lengths.size), per_row)
    rank = np.arange(row.size) - np.repeat(np.cumsum(per_row) - per_row, per_row)
    begin = bounds[:-1][row] + rank * block
    size = np.minimum(bounds[1:][row] - begin, block)
    order = np.argsort(-size, kind="stable")
    row, rank, begin, size = row[order], rank[order], begin[order], size[order]
    active = np.searchsorted(-size, -np.arange(int(size[0])), "left")
    head = (rank == 0)[:, None]
    product = np.where(head[:, :, None], np.eye(k), step) * emit[begin][:, None, :]
    for t in range(1, active.size):
        a = active[t]
        moved = (product[:a] @ step) * emit[begin[:a] + t][:, None, :]
        product[:a] = moved / moved.sum(axis=(1, 2), keepdims=True)
    enter, leave = np.ones((row.size, k)), np.ones((row.size, k))
    state, message = np.ones((lengths.size, k)), np.ones((lengths.size, k))
    by_rank = np.argsort(rank, kind="stable")
    cuts = np.searchsorted(rank[by_rank], np.arange(int(rank.max()) + 2))
    for r in range(cuts.size - 1):
        at = by_rank[cuts[r] : cuts[r + 1]]
        enter[at] = state[row[at]]
        moved = np.einsum("bi,bij->bj", enter[at], product[at])
        state[row[at]] = moved / moved.sum(axis=1, keepdims=True)
    for r in range(cuts.size - 2, -1, -1):
        at = by_rank[cuts[r] : cuts[r + 1]]
        leave[at] = message[row[at]]
        moved = np.einsum("bij,bj->bi", product[at], leave[at])
        message[row[at]] = moved / moved.sum(axis=1, keepdims=True)
    forward, out = np.empty((n, k)), np.empty((n, k))
    state = np.where(head, enter, enter @ step) * emit[begin]
    for t in range(active.size):
        a = active[t]
        at = begin[:a] + t
        state = state[:a] if t == 0 else (state[:a] @ step) * emit[at]
        state = state / state.sum(axis=1, keepdims=True)
        forward[at] = state
    for t in range(active.size - 1, -1, -1):
        a = active[t]
        at = begin[:a] + t
        both = forward[at] * leave[:a]
        out[at] = both / both.sum(axis=1, keepdims=True)
        moved = (leave[:a] * emit[at]) @ step.T
        leave[:a] = moved / moved.sum(axis=1, keepdims=True)
    return out


def train(texts: list[str], langs: list[str], seed: int = 11) -> dict:
    """Fit the CRF's weights by Adam on the exact log-likelihood gradient of switching word sequences."""
    names = sorted(set(langs))
    words = Words(pa.array(texts, pa.large_string()))
    k, rng = len(names), np.random.default_rng(seed)
    label_of_row = np.array([names.index(x) for x in langs], np.int64)
    rows = np.repeat(np.arange(len(texts)), np.diff(words.bounds))
    labels = label_of_row[rows]
    seen, counts = np.unique(words.hashes(), return_counts=True)
    lexicon = np.sort(seen[np.argsort(-counts, kind="stable")[: LEXICON * max(k, 1)]])
    width = (5 << HASH_BITS) + lexicon.size + 1
    # Features of all words as one list: (word, feature).
    owner = np.searchsorted(words.start, np.arange(words.raw.size), "right") - 1
    spots = np.flatnonzero(words.letter)
    pairs = [(owner[spots].astype(np.int32), ids[spots].astype(np.int32)) for ids in words.position_features()]
    pairs += [(np.arange(words.start.size, dtype=np.int32), ids.astype(np.int32)) for ids in words.word_features(lexicon)]
    who, what = np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs])
    del pairs, owner, spots
    order = np.argsort(who, kind="stable")
    who, what = who[order], what[order]
    head = np.searchsorted(who, np.arange(words.start.size + 1))
    by_lang = [np.flatnonzero(labels == j) for j in range(k)]
    live = [j for j in range(k) if by_lang[j].size]
    weights, transition = np.zeros((width, k), np.float64), np.zeros((k, k))
    moments = [np.zeros_like(weights), np.zeros_like(weights), np.zeros_like(transition), np.zeros_like(transition)]
    for it in range(1, STEPS + 1):
        chosen = np.empty((BATCH, SEQUENCE), np.int64)
        for b in range(BATCH):
            lang, at = live[rng.integers(len(live))], 0
            while at < SEQUENCE:
                take = min(int(rng.integers(3, 25)), SEQUENCE - at)
                pool = by_lang[lang]
                chosen[b, at : at + take] = pool[(rng.integers(pool.size) + np.arange(take)) % pool.size]
                at += take
                if rng.random() < SWITCH:
                    lang = live[rng.integers(len(live))]
        flat = chosen.ravel()
        used, inverse = np.unique(flat, return_inverse=True)
        sizes = head[used + 1] - head[used]
        index = np.repeat(head[used] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
        feats, owner_of = what[index], np.repeat(np.arange(used.size), sizes)
        score = np.add.reduceat(weights[feats], np.concatenate([[0], np.cumsum(sizes)[:-1]]), axis=0)[inverse]
        post = posteriors(score, np.arange(BATCH + 1) * SEQUENCE, transition)
        gold = np.eye(k)[labels[flat]]
        error = np.zeros((used.size, k))
        np.add.at(error, inverse, post - gold)
        grad = np.stack([np.bincount(feats, error[owner_of, j], width) for j in range(k)], 1) / BATCH + DECAY * weights
        # Expected transitions from pairwise posteriors.
        e, step = np.exp(score - score.max(1, keepdims=True)).reshape(BATCH, SEQUENCE, k), np.exp(transition - transition.max())
        p3, g3 = post.reshape(BATCH, SEQUENCE, k), gold.reshape(BATCH, SEQUENCE, k)
        pair = p3[:, :-1, :, None] * step[None, None] * e[:, 1:, None, :] * (p3[:, 1:, None, :] / np.maximum((p3[:, :-1] @ step * e[:, 1:])[:, :, None, :], 1e-12))
        pair /= np.maximum(pair.sum((2, 3), keepdims=True), 1e-12)
        tgrad = (pair.sum((0, 1)) - np.einsum("bti,btj->ij", g3[:, :-1], g3[:, 1:])) / BATCH + DECAY * transition
        for value, g, m, v in ((weights, grad, moments[0], moments[1]), (transition, tgrad, moments[2], moments[3])):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            value -= RATE * (m / (1 - 0.9**it)) / (np.sqrt(v / (1 - 0.99**it)) + 1e-8)
    return {"langs": names, "weights": weights.astype(np.float32), "transition": transition, "lexicon": lexicon}


def _has_letter(text: str | None) -> bool:
    return any(c.isalpha() for c in text or "")


def _train_rows(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> dict:
        texts, langs, total = [], [], {}
        for r in sorted((r for batch in batches for r in batch.to_pylist()), key=lambda r: (r["lang"], r["h"], r["text"])):
            if total.get(r["lang"], 0) < words:
                total[r["lang"]] = total.get(r["lang"], 0) + r["size"]
                texts.append(r["text"])
                langs.append(r["lang"])
        return train(texts, langs) if texts else {"langs": []}

    return run


def fit(docs: DataFrame, words: int = TRAIN_WORDS, languages: int = LANGUAGES) -> dict:
    """Train on `docs` (doc_id, text, lang) with text and language: documents in hash order until a language has `words` words,
    or all it has; the `languages` with most documents are learned. Where words are long or there are no spaces, every WORD_CHARS
    characters count as a word, and a text gives no more than its first words * WORD_CHARS characters, which fill the sample. Two
    scans: sums over ranges of the hash, each 2^(1/16) times the one before, so that the last one adds few rows; then the texts of
    the ranges that are needed, which one executor task learns from."""
    known = docs.filter("lang is not null and text is not null").filter(F.col("text").rlike(r"\p{L}")).select("lang", "text", F.xxhash64(F.lit(5), "doc_id", "text").alias("h"))
    known = known.withColumn("size", F.greatest(F.length("text") - F.length(F.replace("text", F.lit(" "), F.lit(""))) + 1, F.ceil(F.length("text") / WORD_CHARS)))
    known = known.withColumn("range", F.floor(F.log2(F.col("h").cast("double") + float(1 << 63) + 1) * 16))
    sums = known.groupBy("lang", "range").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"))
    before = F.sum("size").over(Window.partitionBy("lang").orderBy("range")) - F.col("size")
    last = sums.withColumn("before", before).groupBy("lang").agg(F.max(F.when(F.col("before") < words, F.col("range"))).alias("last"), F.sum("n").alias("n"))
    ends = last.orderBy(F.desc("n"), "lang").limit(languages).select("lang", "last")
    picked = known.join(F.broadcast(ends), "lang").filter("range <= last").select("lang", "h", "size", F.substring("text", 1, words * WORD_CHARS).alias("text"))
    return trained(picked, _train_rows(words))


def label(column: pa.Array, model: dict) -> dict[str, list | np.ndarray]:
    """Languages of the texts of a column by the fitted model."""
    n, names = len(column), model["langs"]
    words = Words(column)
    count = np.diff(words.bounds)
    shares = np.zeros((n, max(len(names), 1)))
    switches = np.zeros(n, np.int64)
    if names and words.start.size:
        post = posteriors(words.scores(model["weights"], model["lexicon"]), words.bounds, model["transition"])
        rows = np.repeat(np.arange(n), count)
        for j in range(len(names)):
            shares[:, j] = np.bincount(rows, post[:, j] * words.bytes, n)
        best = post.argmax(1)
        changed = (best[1:] != best[:-1]) & (rows[1:] == rows[:-1])
        switches = np.bincount(rows[1:][changed], minlength=n)
    total = shares.sum(1)
    shares = shares / np.maximum(total, 1e-300)[:, None]
    # Words are ASCII letters or any bytes above; texts without ASCII letters are looked at more closely.
    ascii_letters = np.add.reduceat(np.append(((words.raw >= 97) & (words.raw <= 122)).astype(np.int64), 0), np.minimum(np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(pc.utf8_lower(column)), 0).to_numpy(zero_copy_only=False))[:-1]]).astype(np.int64), words.raw.size)) if n else np.zeros(0)
    und = total <= 0
    for i in np.flatnonzero(~und & (ascii_letters == 0)):
        und[i] = not _has_letter(column[int(i)].as_py())
    pick = shares.argmax(1)
    return {"lang_pred": ["und" if u or not names else names[p] for u, p in zip(und, pick, strict=True)], "score": np.where(und, 0.0, shares.max(1) if n else 0.0), "n_words": count, "n_switches": switches, "shares": [[] if u else list(map(float, s)) for u, s in zip(und, shares, strict=True)]}


def language_id(docs: DataFrame, model: dict) -> DataFrame:
    """Label each row of `docs` (doc_id, text): lang_pred, score, words, switches and the shares of the model's languages.

    Null texts and texts without letters are `und` with score 0; so is everything when no language was learned. Repeated
    rows are labelled one by one; other columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # fixed tables: a few MB for a handful of languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                out = label(part.column("text"), shared.value)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(out["lang_pred"], pa.string()), pa.array(out["score"], pa.float64()), pa.array(out["n_words"], pa.int64()), pa.array(out["n_switches"], pa.int64()), pa.array(out["shares"], pa.list_(pa.float64()))],
                    ["doc_id", "lang_pred", "score", "n_words", "n_switches", "shares"],
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)


def with_language(docs: DataFrame, model: dict, into: str = "language") -> DataFrame:
    """`docs` (text, any others) with a struct column `into` of lang_pred and score, as language_id gives them."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts: pd.Series) -> pd.DataFrame:
        langs, scores = [], []
        for part in slices(pa.RecordBatch.from_arrays([pa.array(texts, pa.large_string(), from_pandas=True)], ["text"])):
            out = label(part.column("text"), shared.value)
            langs += out["lang_pred"]
            scores.append(out["score"])
        return pd.DataFrame({"lang_pred": langs, "score": np.concatenate(scores) if scores else np.zeros(0)})

    run.__annotations__ = {"texts": pd.Series, "return": pd.DataFrame}
    return docs.withColumn(into, F.pandas_udf(run, "lang_pred string, score double")("text"))


def held_out(modulus: int, remainder: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(modulus)) == remainder


def training_rows(docs: DataFrame) -> DataFrame:
    """Documents whose crc32(doc_id) mod 5 is not 0."""
    return docs.filter(~held_out(5, 0))


def op2_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language_id(docs, fit(training_rows(docs)))
    return found.select("doc_id", F.coalesce(held_out(5, 0), F.lit(False)).alias("held_out"), "lang_pred", "score", "n_words", "n_switches")
