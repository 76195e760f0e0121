import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from stratalens.llm import decontaminate as D


def _plain(pattern, text):
    """Least edit distance of pattern to a substring, by the whole table."""
    last = [0] * (len(text) + 1)
    for i, a in enumerate(pattern, 1):
        now = [i]
        for j, b in enumerate(text, 1):
            now.append(min(last[j - 1] + (a != b), last[j] + 1, now[-1] + 1))
        last = now
    return min(last)


@settings(max_examples=300, deadline=None)
@given(st.binary(min_size=1, max_size=12), st.binary(max_size=30))
def test_edit_distance(pattern, text):
    pattern, text = bytes(b % 3 + 97 for b in pattern), bytes(b % 3 + 97 for b in text)
    assert D.edit_distance_within(pattern, text, 99) == _plain(pattern, text)


def _edited(rng, text, edits):
    out = list(text)
    for _ in range(edits):
        k, c = int(rng.integers(len(out))), chr(97 + int(rng.integers(26)))
        kind = rng.integers(3)
        if kind == 0:
            out[k] = c
        elif kind == 1:
            del out[k]
        else:
            out.insert(k, c)
    return "".join(out)


def _items(sf, spark):
    return [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]


def test_recall_at_every_distance_and_no_false_match(spark, sf):
    rng, items = np.random.default_rng(9), _items(sf, spark)
    index = D.build(items)
    filler = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").limit(40).collect() if r.text]
    for share in (0.0, 0.03, 0.06, 0.1):
        hits = total = 0
        for item_id, text in items:
            d = next(x[2] for x in index["items"] if x[0] == item_id)
            body = _edited(rng, text, int(share / 0.1 * d))
            doc = filler[item_id % len(filler)][:700] + " " + body + " " + filler[(item_id + 1) % len(filler)][:300]
            plain = D.normalise(pa.array([doc], pa.large_string()))[0].tobytes()
            least = _plain(next(x[1] for x in index["items"] if x[0] == item_id), plain)
            found = {i: e for i, e, _ in D.find(pa.array([doc]), index)[0]}
            if least <= d:
                total += 1
                hits += item_id in found
            if item_id in found:
                assert least <= found[item_id] <= d
        print("share", share, hits, total)
        assert total and hits >= (total if share == 0 else 0.9 * total)


def test_long_items_at_the_largest_distance():
    rng = np.random.default_rng(5)
    words = ["".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(2, 10))) for _ in range(400)]
    prose = lambda size: " ".join(words[k] for k in rng.integers(0, len(words), size // 4))[:size].strip()
    for size in (1_000, 3_200, 6_400, 10_000):
        items = [(i, prose(size)) for i in range(8)]
        index = D.build(items)
        allowed = {i: d for i, _, d in index["items"]}
        docs = [prose(500) + " " + _edited(rng, text, allowed[i]) + " " + prose(500) for i, text in items]
        found = D.find(pa.array(docs, pa.large_string()), index)
        for (i, text), doc, row in zip(items, docs, found, strict=True):
            plain = D.normalise(pa.array([doc], pa.large_string()))[0].tobytes()
            least = D.edit_distance_within(D.normalise(pa.array([text]))[0].tobytes(), plain, allowed[i])
            assert least is not None and row == [(i, least, allowed[i])], (size, i, least, row)


def test_short_items_are_found_at_every_allowed_distance():
    rng = np.random.default_rng(3)
    for size in range(1, 64):
        for edits in range(size // 10 + 1):
            for _ in range(4):
                item = "".join(chr(97 + c) for c in rng.integers(0, 26, size))
                if size > 12:
                    item = item[: size // 2] + " " + item[size // 2 + 1 :]
                doc = "qq zz " + _edited(rng, item, edits) + " qq zz"
                least = _plain(item.encode(), D.normalise(pa.array([doc]))[0].tobytes())
                found = D.find(pa.array([doc]), D.build([(1, item)]))[0]
                assert found == ([(1, least, size // 10)] if least <= size // 10 else []), (size, edits, item, doc)


def test_recall_by_length_at_the_largest_distance(spark, sf):
    rng = np.random.default_rng(12)
    prose = " ".join(r.text for r in spark.read.parquet(f"{sf}/documents.parquet").filter("lang = 'en'").limit(60).collect() if r.text)
    plain = D.normalise(pa.array([prose], pa.large_string()))[0].tobytes().decode()
    for size in (64, 70, 80, 120, 250, 700):
        items = [(i, plain[k : k + size].strip()) for i, k in enumerate(rng.integers(0, len(plain) - size, 60))]
        index = D.build(items)
        allowed = {i: (b, d) for i, b, d in index["items"]}
        docs = [plain[:200] + " " + _edited(rng, b.decode(), d) + " " + plain[-300:] for _, (b, d) in sorted(allowed.items())]
        found = D.find(pa.array(docs, pa.large_string()), index)
        hits = sum(any(m[0] == i for m in row) for i, row in enumerate(found))
        assert hits >= 54, (size, hits)


def test_scripts_without_spaces():
    rng = np.random.default_rng(4)
    item = "".join(chr(0x4E00 + int(c)) for c in rng.integers(0, 3000, 60))
    copy = item[:20] + "一二" + item[22:45] + item[46:]
    other = "".join(chr(0x4E00 + int(c)) for c in rng.integers(0, 3000, 200))
    assert [m[0] for m in D.find(pa.array([other[:50] + copy + other[50:], other]), D.build([(5, item)]))[0]] == [5]


def test_an_item_without_its_beginning_at_the_start_of_a_batch():
    item = "a passage of some length whose first letters are missing from the copy in the document"
    assert D.find(pa.array([item[4:]]), D.build([(1, item)])) == [[(1, 4, 8)]]


def test_documents(spark, sf):
    got = {(r.doc_id, r.item_id): r.edits for r in D.op4_decontaminate(spark, sf).collect()}
    word = lambda t: " ".join(re.findall(r"[^\W_]+", (t or "").lower()))
    items = {i: word(t) for i, t in _items(sf, spark)}
    docs = {r.doc_id: word(r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    exact = {(d, i) for d, t in docs.items() for i, x in items.items() if x in t}
    assert exact == {k for k, e in got.items() if e == 0}
    for (d, i), e in got.items():
        assert e <= 0.1 * len(items[i].encode()) and e >= _plain(items[i].encode(), docs[d].encode()) if e and len(docs[d]) < 4000 else True


def test_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 2), (None, "One two three four five six!", 3), (3, "x one TWO three, four five six y", 4), (3, "x one TWO three, four five six y", 4)], "doc_id long, text string, contamination int")
    bench = spark.createDataFrame([(7, "one two three four five six"), (7, None), (None, "a long enough item text"), (8, "."), (9, "tiny")], "item_id long, text string")
    found = D.contamination(docs.drop("contamination"), bench)
    rows = sorted((r.doc_id or 0, [m.item_id for m in r.contamination]) for r in found.collect())
    assert rows == [(0, [7]), (1, []), (2, []), (3, [7]), (3, [7])]
    assert all(not r.contamination for r in D.contamination(docs, bench.limit(0)).collect()) and D.contamination(docs.limit(0), bench).count() == 0
    split = D.contamination(docs, bench, block_bytes=30)
    assert sorted((r.doc_id or 0, [m.item_id for m in r.contamination]) for r in split.collect()) == rows


def test_recall_without_spaces():
    """Items within longer words, of two alphabets, at every allowed distance: at least 0.9, exact copies all."""
    rng = np.random.default_rng(7)
    draw = lambda letters, n: "".join(letters[int(k)] for k in rng.integers(0, len(letters), n))
    for letters, size in (("0123456789abcdef", 64), ("0123456789abcdef", 120), ("0123456789abcdef", 200), ([chr(0x4E00 + k) for k in range(3000)], 22), ([chr(0x4E00 + k) for k in range(3000)], 50)):
        items = [(k, draw(letters, size)) for k in range(60)]
        index = D.build(items)
        bytes_ = len(items[0][1].encode())
        for edits in sorted({0, size // 20, bytes_ // 10 // (bytes_ // size)}):
            copies = []
            for _, text in items:
                out = list(text)
                for k in rng.choice(size, edits, replace=False):
                    out[k] = draw(letters, 1)
                copies.append(draw(letters, 200) + "".join(out) + draw(letters, 200))
            found = D.find(pa.array(copies, pa.large_string()), index)
            recall = np.mean([k in {m[0] for m in row} for (k, _), row in zip(items, found, strict=True)])
            assert recall >= (0.9 if edits else 1.0), (size, edits, recall)


def test_index_of_a_whole_block_is_small():
    rng = np.random.default_rng(9)
    words = ["".join(chr(97 + int(c)) for c in rng.integers(0, 26, int(n))) for n in rng.integers(2, 9, 3000)]
    items, total = [], 0
    while total < D.BLOCK_BYTES:
        items.append((len(items), " ".join(words[int(k)] for k in rng.integers(0, 3000, 60))))
        total += len(items[-1][1])
    index = D.build(items)
    assert sum(x.nbytes for table_ in index["tables"] for x in table_) < 100e6
