"""Personal data by fixed patterns and a skip-chain conditional random field.

Patterns give the base spans. Candidate tokens (with a digit or @) of a document form a graph: neighbours are linked in a
chain, and tokens with the same key (equal digits, or equal letters and digits), however far apart, are linked by skip edges: to
the nearest occurrence in a known span, or to the first one where none is known, so that edges grow with the tokens and distances
don't grow with repeats. Tokens in base spans are clamped to their kind; loopy belief propagation, until messages settle, then
carries labels to distant repeated or similar tokens. Unary weights, chain and skip potentials are trained
piecewise on a bounded sample, labelled by the patterns. Tokens whose belief in a kind is high become further spans.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalens.llm.storage import bounded_batches, table, trained
from stratalens.llm.textbytes import slices

#: Kinds in their order, and their patterns.
KINDS = ("email", "ip", "card", "phone", "secret")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match always starts at the start of its run of digits, and giving digits back never helps it.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
SECRET = re.compile(r"(?i)\b(?:token|secret|password|api[_-]?key)\s{0,3}[:=]\s{0,3}[\"']?([A-Za-z0-9_\-]{16,128})")

SPACE = frozenset("\x20\x09\x0a\x0b\x0c\x0d")
MARK = re.compile(r"[0-9@]")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Bound of the training sample: documents with candidate tokens, in hash order.
TRAIN_ROWS = 3_000
#: Longer texts take no part in training.
TRAIN_BYTES = 1 << 18
BITS, STEPS, BELIEF = 14, 200, 0.8
#: Messages are settled when none changes by so much; loops whose messages keep turning are left after so many sweeps.
SETTLED, SWEEPS = 1e-7, 10_000
NEAR = 24  # chars between candidates that are still neighbours
SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = ord(c) - 48
        total += v if i % 2 == 0 else v * 2 - 9 * (v > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of emails, addresses, cards and phones: leftmost and non-overlapping within each kind."""
    found = []
    at, past = text.find("@"), 0
    while at >= 0:
        start = at
        while start > past and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            found.append((start, "email", m.end()))
        past = m.end() if m else at + 1
        at = text.find("@", past)
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            found.append((m.start(), "ip", m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and _luhn(digits):
                found.append((m.start(), "card", m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                found.append((m.start(), "phone", m.end()))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[1])))


def candidates(text: str) -> list[tuple[int, int]]:
    """Spans of the tokens with a digit or @."""
    out, past = [], 0
    m = MARK.search(text)
    while m:
        start = m.start()
        while start > past and text[start - 1] not in SPACE:
            start -= 1
        end = WORD.match(text, m.start()).end()
        out.append((start, end))
        past = end
        m = MARK.search(text, end)
    return out


def _shape(token: str) -> str:
    token = re.sub(r"[0-9]+", lambda m: f"9{min(len(m[0]), 20)}", token[:200])
    return re.sub(r"[^\W\d_]+", "a", token)


def _features(text: str, spans: list[tuple[int, int]]) -> list[list[int]]:
    rows = []
    for start, end in spans:
        token = text[start:end]
        before, after = text[max(0, start - 24) : start].split(), text[end : end + 24].split()
        hexes = len(re.findall(r"[0-9a-fA-F]", token[:80]))
        names = ("bias", "shape=" + re.sub(r"9\d+", "9", _shape(token)), "digits=" + _shape(token), f"n={min(len(token), 48) // 4}", f"hex={hexes // 8}", "b1=" + (before[-1].lower() if before else ""), "b2=" + (before[-2].lower() if len(before) > 1 else ""), "a1=" + (_shape(after[0]) if after else ""), f"@={'@' in token}", f"dots={min(token.count('.'), 5)}")
        rows.append([zlib.crc32(n.encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1) for n in names])
    return rows


def _key(token: str) -> str:
    digits = re.sub(r"[^0-9]", "", token)
    letters = re.sub(r"[\W_]+", "", token).lower()
    return "d" + digits if len(digits) >= 7 and len(digits) * 2 > len(letters) else "w" + letters


def _edges(text: str, spans: list[tuple[int, int]], labels: np.ndarray) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Chain and skip edges between the candidates of one text, which are known by a label above 0. Skip edges link the known
    occurrences of a key in their order, and each other one to the nearest known, or to the first where none is known."""
    chain = [(i, i + 1) for i in range(len(spans) - 1) if spans[i + 1][0] - spans[i][1] <= NEAR]
    places: dict[str, list[int]] = {}
    for i, (start, end) in enumerate(spans):
        key = _key(text[start:end])
        if len(key) > 4:
            places.setdefault(key, []).append(i)
    skip = []
    for same in places.values():
        known = [i for i in same if labels[i] > 0]
        skip += zip(known, known[1:], strict=False)
        for i in same:
            if labels[i] == 0 and (known or i != same[0]):
                k = bisect_right(known, i)
                j = min(known[max(k - 1, 0) : k + 1], key=lambda j: abs(i - j)) if known else same[0]
                skip.append((min(i, j), max(i, j)))
    return chain, skip


def _clamped(spans: list[tuple[int, int]], known: list[tuple[int, str, int]]) -> np.ndarray:
    """Label of the candidates in known spans (0: none; kinds from 1)."""
    out, starts = np.zeros(len(spans), np.int64), [s[0] for s in spans]
    for start, kind, end in known:
        i = max(0, bisect_right(starts, start) - 1)
        while i < len(spans) and spans[i][0] < end:
            if spans[i][1] > start and not out[i]:
                out[i] = KINDS.index(kind) + 1
            i += 1
    return out


def _secrets(text: str) -> list[tuple[int, str, int]]:
    return [(m.start(1), "secret", m.end(1)) for m in SECRET.finditer(text)]


def train(texts: list[str]) -> dict:
    """Piecewise training: unary logistic weights by Adam, edge potentials as smoothed log odds of label pairs."""
    k, features, labels, chain, skip = len(KINDS) + 1, [], [], np.ones((len(KINDS) + 1,) * 2), np.ones((len(KINDS) + 1,) * 2)
    for text in texts:
        spans = candidates(text)
        if spans:
            y = _clamped(spans, base_spans(text) + _secrets(text))
            edges = _edges(text, spans, y)
            # A token that no pattern knows, with a twin that one knows, has no label: patterns are silent, not negative.
            unknown = {i for a, b in edges[1] for i, j in ((a, b), (b, a)) if y[i] == 0 and y[j] > 0}
            seen = [i for i in range(len(spans)) if i not in unknown]
            rows = _features(text, spans)
            features += [rows[i] for i in seen]
            labels += y[seen].tolist()
            for pairs, table_ in zip(edges, (chain, skip), strict=True):
                for i, j in pairs:
                    if i not in unknown and j not in unknown:
                        table_[y[i], y[j]] += 1
    weights = np.zeros((1 << BITS, k))
    if features:
        x, y = np.array(features), np.array(labels)
        m, v = np.zeros_like(weights), np.zeros_like(weights)
        width, owner = x.shape[1], np.repeat(np.arange(len(y)), x.shape[1])
        for t in range(1, STEPS + 1):
            z = weights[x.ravel()].reshape(len(y), width, k).sum(1)
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(y)), y] -= 1
            grad = np.stack([np.bincount(x.ravel(), p[owner, c], 1 << BITS) for c in range(k)], 1) / len(y) + 1e-5 * weights
            m += 0.1 * (grad - m)
            v += 0.05 * (grad * grad - v)
            weights -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.95**t)) + 1e-8)
    odds = lambda c: np.clip(np.log(c / c.sum()) - np.log(c.sum(1) / c.sum())[:, None] - np.log(c.sum(0) / c.sum())[None, :], -3, 3)
    return {"weights": weights.astype(np.float32), "chain": odds(chain), "skip": odds(skip)}


def beliefs(unary: np.ndarray, chain: np.ndarray, skip: np.ndarray, chain_potential: np.ndarray, skip_potential: np.ndarray, sweeps: int = SWEEPS) -> np.ndarray:
    """Loopy belief propagation: each node's belief, from log potentials; exact where the graph is a tree.

    A sweep looks only at the edges of nodes to which a message changed in the sweep before."""
    k = unary.shape[1]
    edges = np.concatenate([chain, skip]).astype(np.int64).reshape(-1, 2)
    norm = lambda z: np.exp(z - z.max(-1, keepdims=True)) / np.exp(z - z.max(-1, keepdims=True)).sum(-1, keepdims=True)
    if not edges.size:
        return norm(unary)
    potential = np.concatenate([np.broadcast_to(np.exp(chain_potential), (len(chain), k, k)), np.broadcast_to(np.exp(skip_potential), (len(skip), k, k))])
    a, b = edges[:, 0], edges[:, 1]
    to_b, to_a = np.zeros((len(edges), k)), np.zeros((len(edges), k))  # log messages
    total, live = unary.astype(float), np.arange(len(edges))
    for _ in range(sweeps):
        e, f, p, old_b, old_a = a[live], b[live], potential[live], to_b[live], to_a[live]
        from_a, from_b = norm(total[e] - old_a), norm(total[f] - old_b)
        new_b, new_a = np.log(norm(np.log(np.einsum("ei,eij->ej", from_a, p) + 1e-30))), np.log(norm(np.log(np.einsum("ej,eij->ei", from_b, p) + 1e-30)))
        step_b, step_a = 0.5 * (new_b - old_b), 0.5 * (new_a - old_a)
        to_b[live], to_a[live] = old_b + step_b, old_a + step_a
        np.add.at(total, f, step_b)
        np.add.at(total, e, step_a)
        moved = np.zeros(len(total), bool)
        moved[f[np.abs(step_b).max(1) >= SETTLED]] = True
        moved[e[np.abs(step_a).max(1) >= SETTLED]] = True
        live = np.flatnonzero(moved[a] | moved[b])
        if not live.size:
            break
    return norm(total)


def find(texts: list[str | None], model: dict, least: float = BELIEF) -> list[tuple[list, list]]:
    """For each text its base spans and its added spans, (start, kind, end)."""
    base = [base_spans(t) if t and MARK.search(t) else [] for t in texts]
    nodes, rows, chain, skip, clamp = [], [], [], [], []
    for i, text in enumerate(texts):
        spans = candidates(text) if text else []
        if spans:
            offset = len(nodes)
            nodes += [(i, s, e) for s, e in spans]
            rows += _features(text, spans)
            clamp.append(_clamped(spans, base[i]))
            for pairs, out in zip(_edges(text, spans, clamp[-1]), (chain, skip), strict=True):
                out += [(a + offset, b + offset) for a, b in pairs]
    added: list[list] = [[] for _ in texts]
    if nodes:
        unary = model["weights"][np.array(rows)].sum(1).astype(float)
        fixed = np.concatenate(clamp)
        unary[fixed > 0] = -30.0
        unary[fixed > 0, fixed[fixed > 0]] = 30.0
        belief = beliefs(unary, np.array(chain).reshape(-1, 2), np.array(skip).reshape(-1, 2), model["chain"], model["skip"])
        best = belief.argmax(1)
        for n in np.flatnonzero((fixed == 0) & (best > 0) & (belief.max(1) >= least)):
            i, start, end = nodes[n]
            text, kind = texts[i], KINDS[best[n] - 1]
            while start < end and not (text[start].isalnum() or text[start] == "+"):
                start += 1
            while end > start and not text[end - 1].isalnum():
                end -= 1
            if start < end and all(e <= start or s >= end for s, _, e in base[i]):
                if added[i] and added[i][-1][1] == kind and not text[added[i][-1][2] : start].strip() and kind != "secret":
                    added[i][-1] = (added[i][-1][0], kind, end)
                else:
                    added[i].append((start, kind, end))
    return list(zip(base, added, strict=True))


def _digest(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, k, e in spans)


def _train_rows(batches: Iterator[pa.RecordBatch]) -> dict:
    rows = sorted((r["h"], r["text"]) for batch in batches for r in batch.to_pylist())
    return train([text for _, text in rows])


def fit(docs: DataFrame, rows: int = TRAIN_ROWS) -> dict:
    """Train, in one executor task, on at most `rows` texts of at most TRAIN_BYTES with candidate tokens, in hash order of doc_id and
    text; no labels are read."""
    known = docs.select("text", F.xxhash64(F.lit(9), "doc_id", "text").alias("h")).filter("text is not null")
    total = known.count()
    share = min(1.0, 8.0 * rows / max(total, 1))
    picked = known.filter(F.pmod("h", F.lit(1 << 20)) < int(share * (1 << 20)) + 1).filter((F.octet_length("text") <= TRAIN_BYTES) & F.col("text").rlike("[0-9@]")).orderBy("h", "text").limit(rows)
    return trained(picked, _train_rows)


def personal_data(docs: DataFrame, model: dict) -> DataFrame:
    """Spans of each row of `docs` (doc_id, text): counts of the base kinds, digest, all spans and the number added.

    Null and empty texts have no spans; repeated rows are treated one by one; other columns are ignored. Offsets are code
    points. A text is read as a whole; time and memory are linear in it.
    """
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2^BITS x kinds weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                rows = find(part.column("text").to_pylist(), shared.value)
                counts = [[sum(s[1] == k for s in b) for b, _ in rows] for k in KINDS[:4]]
                every = [sorted(b + a, key=lambda s: (s[0], KINDS.index(s[1]))) for b, a in rows]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *[pa.array(c, pa.int64()) for c in counts], pa.array([hashlib.sha256(_digest(b).encode()).hexdigest() for b, _ in rows]), pa.array([_digest(e) for e in every], pa.string()), pa.array([len(a) for _, a in rows], pa.int64())],
                    ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"],
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)


def op9_pii(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return personal_data(docs, fit(docs))
