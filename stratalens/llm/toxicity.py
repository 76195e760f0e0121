"""Toxicity by weak supervision.

Voters are lexicon entries (whole words) and patterns (strings of 4 to 6 bytes within words, and beginnings of words) whose presence goes with
labelled toxic documents. A generative label model estimates, by expectation maximisation over a bounded sample of labelled
rows, each voter's firing rates in both classes, the annotator's accuracy (the given labels are one more, noisy voter) and the
voters' correlations: a voter's rate depends on the class and on the vote of the voter that it goes with most. A sparse linear classifier over many more
words and patterns is then trained on the posterior labels, and scores any text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalens.llm.langid import held_out
from stratalens.llm.storage import bounded_batches, table, trained
from stratalens.llm.textbytes import Spans, slices, text_bytes

#: Bound of the training sample, in hash order of doc_id.
TRAIN_ROWS = 6_000
#: Longer texts take no part in training.
TRAIN_BYTES = 1 << 18
VOTERS, FEATURES = 160, 4_000
NGRAMS = (4, 5, 6)
PREFIXES = (3, 5, 7, 9)
PREDICTED_AT = 0.7
TABLE_BITS = 20
ROUNDS, STEPS = 25, 700
#: Rounds before the voters' forest is learned, correlation of its edges at least, and pseudo-rows of a voter's own rate.
SETTLE, CORRELATED, SHRINK = 5, 0.1, 2.0
SLICE = 1 << 19  # bytes of texts at once, unless one is longer
AT_ONCE = 1 << 19  # bytes whose features are taken at once: they take some hundred times as much memory


def _raw_features(column: pa.Array, at_once: int = AT_ONCE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, hash) arrays: words, their beginnings, and n-grams within words, of the lower-cased texts. Features lie within words, so
    the bytes are taken in stretches that end between words: a long text takes no more memory than a stretch does."""
    raw, at = text_bytes(pc.utf8_lower(column))
    letter = ((raw >= 97) & (raw <= 122)) | (raw >= 128)
    row_start = np.zeros(raw.size + 1, bool)
    row_start[at[:-1]] = True
    low = 0
    while low < raw.size:
        high = min(low + at_once, raw.size)
        while high < raw.size and letter[high] and letter[high - 1] and not row_start[high]:
            high += 1
        row = np.searchsorted(at, np.arange(low, high), "right").astype(np.int32) - 1
        yield from _stretch(raw[low:high], letter[low:high], row)
        low = high


def _stretch(raw: np.ndarray, letter: np.ndarray, row_of: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    cuts = np.cumsum(~letter, dtype=np.int32)
    spans = Spans(raw)
    first, last = letter.copy(), letter.copy()
    first[1:] &= ~letter[:-1]
    last[:-1] &= ~letter[1:]
    edges = np.flatnonzero(row_of[1:] != row_of[:-1]) + 1
    first[edges], last[edges - 1] = letter[edges], letter[edges - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    yield row_of[start], spans.hash(start, end)
    for n in PREFIXES:
        long = end - start > n
        yield row_of[start[long]], spans.hash(start[long], start[long] + n) ^ np.uint64(64 + n)
    for n in NGRAMS:
        if raw.size < n:
            continue
        low = np.flatnonzero((cuts[n - 1 :] - cuts[: raw.size - n + 1] == 0) & letter[: raw.size - n + 1] & (row_of[n - 1 :] == row_of[: raw.size - n + 1]))
        yield row_of[low], spans.hash(low, low + n) ^ np.uint64(n)


def _find(hashes: np.ndarray, vocabulary: np.ndarray, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where `hashes` are in the sorted `vocabulary` (positions, places); `slots` is a bitmap of its low bits."""
    maybe = np.flatnonzero(slots[hashes & np.uint64((1 << TABLE_BITS) - 1)])
    place = np.searchsorted(vocabulary, hashes[maybe])
    hit = vocabulary[np.minimum(place, vocabulary.size - 1)] == hashes[maybe] if vocabulary.size else np.zeros(0, bool)
    return maybe[hit], place[hit]


def _slots(vocabulary: np.ndarray) -> np.ndarray:
    out = np.zeros(1 << TABLE_BITS, bool)
    out[vocabulary & np.uint64((1 << TABLE_BITS) - 1)] = True
    return out


def _pairs(column: pa.Array, keep=None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, feature) pairs of a column; `keep` maps hashes to (positions, features)."""
    rows, feats = [], []
    for row, hashes in _raw_features(column):
        at, feature = keep(hashes) if keep else (slice(None), hashes)
        rows.append(row[at])
        feats.append(feature)
    row, feat = np.concatenate([np.zeros(0, np.int32), *rows]), np.concatenate([np.zeros(0, np.uint64) if keep is None else np.zeros(0, np.int64), *feats])
    order = np.lexsort((feat, row))
    row, feat = row[order], feat[order]
    new = np.ones(row.size, bool)
    new[1:] = (row[1:] != row[:-1]) | (feat[1:] != feat[:-1])
    return row[new], feat[new]


def _forest(centred: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Parent of each voter (-1: none) in the forest of the strongest correlations of at least `least`, and an order in which parents
    come first: Prim's algorithm over the residual correlations."""
    m = centred.shape[1]
    scale = np.sqrt(np.maximum((centred * centred).sum(0), 1e-9))
    rho = np.abs(centred.T @ centred / np.outer(scale, scale))
    best, link, done, order = np.zeros(m), np.full(m, -1), np.zeros(m, bool), []
    for _ in range(m):
        v = int(np.argmax(np.where(done, -1.0, best)))
        done[v] = True
        order.append(v)
        closer = ~done & (rho[v] > best) & (rho[v] >= least)
        best[closer], link[closer] = rho[v][closer], v
    return link, np.array(order, np.int64)


def label_model(votes: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, dict]:
    """Posterior of class 1 for each row, from binary voters and given labels (-1: none), with the fitted model.

    A tree-augmented generative model: within a class a voter depends on one other voter at most, that with which its votes go
    together most once the class is known, so correlations are parameters of the model, p(vote | class, parent's vote), and not counted
    as further evidence. The forest is learned once the classes have settled, and all tables are fitted by expectation maximisation.
    The given labels are one more voter, with an accuracy of its own in both classes.
    """
    n, m = votes.shape
    given = labels >= 0
    post = np.where(given, np.clip(labels, 0.05, 0.95), 0.1).astype(float)
    right, link, has = np.array([0.95, 0.95]), np.full(m, -1), np.zeros(0, np.int64)
    for t in range(ROUNDS):
        p1 = post.sum()
        prior = np.clip((p1 + 1) / (n + 10), 1e-3, 0.9)
        on = np.clip((post @ votes + 0.5) / (p1 + 2), 1e-4, 1 - 1e-4)
        off = np.clip(((1 - post) @ votes + 0.02) / (n - p1 + 2), 1e-5, 1 - 1e-4)
        if given.any():
            g = post[given]
            right = np.clip([((g * labels[given]).sum() + 19) / (g.sum() + 20), (((1 - g) * (1 - labels[given])).sum() + 19) / ((1 - g).sum() + 20)], 0.6, 0.999)
        if t == SETTLE:
            link, _ = _forest(votes - np.outer(post, on) - np.outer(1 - post, off), CORRELATED)
            has = np.flatnonzero(link >= 0)
        # Log odds of a vote given its parent's: rates (class, parent's vote, voter), shrunk to the voter's own where seen seldom.
        rates = np.stack([np.stack([on, on]), np.stack([off, off])])
        if has.size:
            both, parent = votes[:, has], votes[:, link[has]]
            for c, weight, own in ((0, post, on), (1, 1 - post, off)):
                for v in (0, 1):
                    at = weight[:, None] * (parent == v)
                    rates[c, v, has] = np.clip(((at * both).sum(0) + SHRINK * own[has]) / (at.sum(0) + SHRINK), 1e-5, 1 - 1e-4)
        logit = np.log(prior / (1 - prior)) + np.zeros(n)
        alone = np.flatnonzero(link < 0)
        fired, silent = np.log(rates[0] / rates[1]), np.log((1 - rates[0]) / (1 - rates[1]))
        logit += votes[:, alone] @ (fired[0] - silent[0])[alone] + silent[0][alone].sum()
        if has.size:
            up, down = np.where(parent == 1, fired[1][has], fired[0][has]), np.where(parent == 1, silent[1][has], silent[0][has])
            logit += np.where(both == 1, up, down).sum(1)
        logit += np.where(labels == 1, np.log(right[0] / (1 - right[1])), 0) + np.where(labels == 0, np.log((1 - right[0]) / right[1]), 0)
        post = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    return post, {"prior": prior, "on": on, "off": off, "parent": link, "rates": rates, "annotator": right}


def train(texts: list[str | None], labels: np.ndarray) -> dict:
    """Mine voters, fit the label model, and train the linear classifier on its posteriors."""
    labels = np.asarray(labels)
    none = {"vocabulary": np.zeros(0, np.uint64), "weights": np.zeros(0), "bias": -4.0}
    if not len(texts) or not (labels == 1).any() or not (labels == 0).any():
        return none
    # First the features of toxic rows alone (others can't be voters), then who has them.
    def runs(which: np.ndarray, keep=None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for low in range(0, which.size, 100):
            part = which[low : low + 100]
            row, feat = _pairs(pa.array([texts[i] for i in part], pa.large_string()), keep)
            yield part[row], feat

    seen, times = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for _, feat in runs(np.flatnonzero(labels == 1)):
        seen, back = np.unique(np.concatenate([seen, feat]), return_inverse=True)
        times = np.bincount(back, np.concatenate([times, np.ones(feat.size, np.int64)]), seen.size).astype(np.int64)
    candidates = seen[times >= min(2, int((labels == 1).sum()))]
    slots = _slots(candidates)
    found = [(row, feat) for row, feat in runs(np.arange(len(texts)), lambda h: _find(h, candidates, slots))]
    row, feat = np.concatenate([k[0] for k in found]).astype(np.int32), np.concatenate([k[1] for k in found]).astype(np.int32)
    del found
    y = labels == 1
    n1, n0 = int(y.sum()), int((labels == 0).sum())
    pos, neg = np.bincount(feat[y[row]], minlength=candidates.size), np.bincount(feat[~y[row]], minlength=candidates.size)
    gain = (pos / n1 - neg / n0) / np.sqrt((pos + neg + 1) / (n1 + n0))
    fit = (pos >= (2 if n1 >= 12 else min(3, n1))) & (pos * n0 > 8 * (neg + 0.2) * n1)
    ranked = np.flatnonzero(fit)[np.argsort(-gain[fit], kind="stable")]
    if not ranked.size:
        return none
    # Voters: the strongest first, with preference to those that cover documents which few voters cover yet.
    ranked = ranked[:FEATURES]
    place = np.full(candidates.size, -1)
    place[ranked] = np.arange(ranked.size)
    use = place[feat] >= 0
    row, feat = row[use], place[feat[use]]
    order = np.argsort(feat, kind="stable")
    by = np.split(row[order], np.searchsorted(feat[order], np.arange(1, ranked.size)))
    cover, voters = np.zeros(len(texts)), []
    for j in range(ranked.size):
        docs = by[j][y[by[j]]]
        if len(voters) < VOTERS and (len(voters) < 20 or (1.0 / (1 + cover[docs])).mean() > 0.2):
            voters.append(j)
            cover[docs] += 1
    votes = np.zeros((len(texts), len(voters)))
    for k, j in enumerate(voters):
        votes[by[j], k] = 1
    post, model = label_model(votes, labels)
    # Linear classifier over all ranked features, by Adam on the expected log-loss.
    d = ranked.size
    w, b = np.zeros(d), float(np.log(model["prior"] / (1 - model["prior"])))
    m, v = np.zeros(d + 1), np.zeros(d + 1)
    value = 1.0 / np.sqrt(np.maximum(np.bincount(row, minlength=len(texts)), 4))  # rows with many features count no more than others
    for t in range(1, STEPS + 1):
        z = np.bincount(row, w[feat] * value[row], len(texts)) + b
        error = 1 / (1 + np.exp(-z)) - post
        grad = np.append(np.bincount(feat, error[row] * value[row], d) / len(texts) + 2e-6 * w, error.mean())
        m += 0.1 * (grad - m)
        v += 0.05 * (grad * grad - v)
        move = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.95**t)) + 1e-9)
        w, b = w - move[:-1], b - move[-1]
    vocabulary = candidates[ranked]
    order = np.argsort(vocabulary)
    return {"vocabulary": vocabulary[order], "weights": w[order], "bias": b, "label_model": model, "voters": vocabulary[voters]}


def score(column: pa.Array, model: dict) -> tuple[np.ndarray, np.ndarray]:
    """Score and number of known features of each text."""
    n, vocabulary, slots = len(column), model["vocabulary"], model.setdefault("slots", _slots(model["vocabulary"]))
    row, feat = _pairs(column, lambda h: _find(h, vocabulary, slots)) if n else (np.zeros(0, np.int64),) * 2
    count = np.bincount(row, minlength=n)
    z = np.bincount(row, model["weights"][feat], n) / np.sqrt(np.maximum(count, 4)) + model["bias"] if vocabulary.size else np.full(n, model["bias"])
    return 1 / (1 + np.exp(-np.clip(z, -30, 30))), count


def _train_rows(batches: Iterator[pa.RecordBatch]) -> dict:
    rows = sorted((r["h"], r["doc_id"], r["text"] or "", r["toxic"]) for batch in batches for r in batch.to_pylist())
    return train([r[2] for r in rows], np.array([r[3] for r in rows], np.int64))


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> dict:
    """Train, in one executor task, on documents (doc_id, text) with a label in `labels` (doc_id, toxic): at most `rows` ids, in hash
    order of doc_id, and their texts of at most TRAIN_BYTES.

    Null labels are left out; of several labels of one document the highest counts; of several texts of one id the least.
    """
    known = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.xxhash64(F.lit(3), "doc_id").alias("h"))
    chosen = known.orderBy("h", "doc_id").limit(rows)
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").filter(F.coalesce(F.octet_length("text"), F.lit(0)) <= TRAIN_BYTES)
    return trained(found.groupBy("doc_id", "toxic", "h").agg(F.min("text").alias("text")), _train_rows)


def toxicity(docs: DataFrame, model: dict, predicted_at: float = PREDICTED_AT) -> DataFrame:
    """Score each row of `docs` (doc_id, text): score, predicted and n_evidence (known toxic words and patterns).

    Null and empty texts get the classifier's score for no evidence; repeated rows are scored one by one; without labels of
    both classes every score is that of no evidence; other columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES weights at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                value, count = score(part.column("text"), shared.value)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(value, pa.float64()), pa.array((value >= predicted_at).astype(np.int32)), pa.array(count, pa.int64())], ["doc_id", "score", "predicted", "n_evidence"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double, predicted int, n_evidence long")


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    found = toxicity(docs, fit(docs, labels.filter(~held_out(3, 1))))
    return found.select("doc_id", F.coalesce(held_out(3, 1), F.lit(False)).alias("held_out"), "score", "predicted", "n_evidence")
