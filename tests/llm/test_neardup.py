import re

import numpy as np
import pyarrow as pa

from stratalens.llm import neardup
from stratalens.llm.components import components


def _set(text, width):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1)) if len(words) >= width else frozenset([tuple(words)])


def _plain(rows, width):
    sets = {i: _set(t, width) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            a, b = sets[i], sets[j]
            if a and b and 10 * min(len(a), len(b)) >= 8 * max(len(a), len(b)):
                both = len(a & b)
                if 100 * both >= 80 * (len(a) + len(b) - both):
                    p, q = find(i), find(j)
                    root[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def test_documents_against_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.op7_near_dedup(spark, sf).collect()}
    assert got == _plain(rows, 2)


def test_chains_of_edits_and_hot_groups(spark):
    rng = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for g in range(6):
        text = list(rng.choice(vocabulary, 120))
        for i in range(60):
            if i % 3 == 0:  # the chain moves on: far members are linked through others only
                text[int(rng.integers(120))] = f"n{g}x{i}"
            copy = list(text)
            for _ in range(int(rng.integers(0, 9))):
                copy[int(rng.integers(120))] = f"e{rng.integers(1_000_000)}"
            rows.append((int(rng.integers(1_000_000_000)), " ".join(copy)))
    rows = list({r[0]: r for r in rows}.values())
    for width in (2, 5):
        got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width).collect()}
        assert got == _plain(rows, width)


def test_odd_sketch_estimates():
    rng = np.random.default_rng(6)
    base = rng.integers(0, 1 << 63, 1000, dtype=np.uint64)
    for share in (0.7, 0.8, 0.9, 0.97):
        cut = int(1000 * 2 * share / (1 + share))
        other = np.concatenate([base[:cut], rng.integers(0, 1 << 63, 1000 - cut, dtype=np.uint64)])
        apart = sum(int(x ^ y).bit_count() if (x ^ y) >= 0 else (int(x ^ y) & (2**64 - 1)).bit_count() for x, y in zip(neardup.sketch(base)[1], neardup.sketch(other)[1]))
        estimate = 1 + neardup.SKETCH_BITS / (4 * neardup.HASHES) * np.log(1 - 2 * apart / neardup.SKETCH_BITS)
        assert abs(estimate - share) < 0.08


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 90)] + [(200, i) for i in range(201, 260)] + [(300, 300)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(91)}, **{i: 200 for i in range(200, 260)}}


def test_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 1), (None, "a b c", 1), (3, "A b C", 1), (4, "a b c", 1), (4, "a b c", 2), (5, "a", 1), (6, "A", 1)], "doc_id long, text string, component_id int")
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(docs, 2).collect())
    assert [g for g in got if g[0]] == [(1, 0, 1, True), (2, 0, 2, True), (3, 2, 3, True), (4, 2, 3, False), (4, 2, 3, False), (5, 1, 5, True), (6, 1, 5, False)]
    assert neardup.near_duplicates(docs.limit(0)).count() == 0
    assert [s.size for s in neardup.shingle_sets(pa.array(["x y " * 300_000]), 2)] == [2]


def test_family_below_the_threshold_is_not_paired_with_itself(spark):
    common = [f"c{k}" for k in range(82)]
    rows = [(i, i, " ".join([*common, *(f"u{i}x{k}" for k in range(18))])) for i in range(5_000)]
    rows += [(10_000 + i, 10_000 + i, rows[i][2].replace(f"u{i}x0 ", "new ").replace(f"u{i}x1 ", f"new{i} ")) for i in range(0, 5_000, 500)]
    pairs = neardup.prefix_pairs(spark.createDataFrame(rows, "doc_id long, component long, text string"), 1, 80).collect()
    assert {(i, 10_000 + i) for i in range(0, 5_000, 500)} <= {tuple(sorted(p)) for p in pairs} and len(pairs) < 5_000


def test_prefix_pairs_lose_nothing(spark):
    rng = np.random.default_rng(8)
    texts = []
    for g in range(12):
        base = list(rng.choice([f"w{k}" for k in range(90)], int(rng.integers(5, 80))))
        for _ in range(10):
            copy = [w if rng.random() > 0.06 else f"e{rng.integers(400)}" for w in base]
            texts.append(" ".join(copy[: int(len(copy) * rng.uniform(0.85, 1))]))
    rows = [(i, i, t) for i, t in enumerate(texts)]
    got = {tuple(sorted(p)) for p in neardup.prefix_pairs(spark.createDataFrame(rows, "doc_id long, component long, text string"), 2, 80).collect()}
    sets = [_set(t, 2) for t in texts]
    true = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if sets[i] and sets[i] != sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])}
    assert true <= got and len(true) > 40


def test_ids_with_several_texts_are_one_node(spark):
    a, b, c = ("one two three four five six", "red green blue white black grey", "x1 x2 x3 x4 x5 x6")
    rows = [(1, a), (2, b), (3, a), (3, b), (3, b), (4, c), (0, c), (5, "p q r")]
    got = sorted((r.doc_id, r.component_id, r.kept) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect())
    assert got == [(0, 0, True), (1, 1, True), (2, 1, False), (3, 1, False), (3, 1, False), (3, 1, False), (4, 0, False), (5, 5, True)]


def test_long_words_that_differ_are_not_shared(spark):
    """Words of 0 and 1 by the parity of the bits of their places, and their complements, between the same short ones."""
    bits = "".join("ab"[bin(i).count("1") & 1] for i in range(2048))
    words = [bits, bits.translate(str.maketrans("ab", "ba"))]
    docs = spark.createDataFrame([(k, f"one {w} two") for k, w in enumerate(words)], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in neardup.near_duplicates(docs, width=2).collect()} == {0: 0, 1: 1}
