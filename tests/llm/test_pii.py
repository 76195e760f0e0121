import re
import time

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from stratalens.llm import pii


def _plain(text):
    found = [(m.start(), "email", m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [(m.start(), "ip", m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 14 <= len(d) <= 19 and sum(v if i % 2 == 0 else sum(divmod(2 * v, 10)) for i, v in enumerate(d[::-1])) % 10 == 0:
            found.append((m.start(), "card", m.end()))
    found += [(m.start(), "phone", m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(found, key=lambda s: (s[0], pii.KINDS.index(s[1])))


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet="a1902@.+-( )é\n%", max_size=60))
def test_base_spans_equal_the_plain_patterns(text):
    assert pii.base_spans(text) == _plain(text)


def test_documents(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = pii.op9_pii(spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        base = _plain(docs[r.doc_id] or "")
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[1] == k for s in base) for k in pii.KINDS[:4])
        assert {f"{k}:{s}:{e}" for s, k, e in base} <= set(r.spans.split(",")) | {""}


def test_beliefs_are_exact_on_a_tree():
    rng = np.random.default_rng(3)
    unary, p, q = rng.normal(size=(4, 3)), rng.normal(size=(3, 3)), rng.normal(size=(3, 3))
    chain, skip = np.array([(0, 1), (1, 2)]), np.array([(1, 3)])
    joint = np.zeros((3,) * 4)
    for y in np.ndindex(3, 3, 3, 3):
        joint[y] = np.exp(sum(unary[i, y[i]] for i in range(4)) + p[y[0], y[1]] + p[y[1], y[2]] + q[y[1], y[3]])
    exact = np.array([joint.sum(tuple(j for j in range(4) if j != i)) for i in range(4)]) / joint.sum()
    assert np.allclose(pii.beliefs(unary, chain, skip, p, q, 60), exact, atol=1e-6)


def test_distant_repeat_gets_the_label_of_its_twin():
    train = [f"call +1 (200) 555-{1000 + i} now or write to me{i}@mail.org id 77{i}" for i in range(300)] + [f"again 1200555{1000 + i} and +1200555{1000 + i} there" for i in range(300)]
    model = pii.train(train)
    text = "reach +12005551234 here " + "word " * 500 + "or 12005551234 later"
    (base, added), = pii.find([text], model)
    assert base == [(6, "phone", 18)] and [a[1] for a in added] == ["phone"]


def _model(strength):
    k = len(pii.KINDS) + 1
    return {"weights": np.zeros((1 << pii.BITS, k), np.float32), "chain": np.zeros((k, k)), "skip": np.where(np.eye(k) > 0, strength, -strength)}


def test_every_one_of_many_repeats_hears_of_its_twin():
    bare = ("word " * 50 + "or 12005551234 later ") * 60
    for text in ("reach +12005551234 here " + bare, bare + "reach +12005551234 here", bare + "reach +12005551234 here " + bare):
        (base, added), = pii.find([text], _model(3.0))
        assert [s[1] for s in base] == ["phone"]
        assert [s[1] for s in added] == ["phone"] * text.count(" 12005551234") and all(text[s:e] == "12005551234" for s, _, e in added)


def test_repeats_that_no_pattern_knows_stay_unlabelled():
    (base, added), = pii.find([("word " * 50 + "or 12005551234 later ") * 60], _model(3.0))
    assert not base and not added


def test_messages_go_on_until_they_settle():
    n, k = 40, 3
    unary, link = np.zeros((n, k)), np.where(np.eye(k) > 0, 3.0, -3.0)
    unary[0] = -30.0
    unary[0, 1] = 30.0
    chain = np.array([(i, i + 1) for i in range(n - 1)])
    step, exact = np.exp(link) / np.exp(link).sum(1, keepdims=True), [np.array([0.0, 1.0, 0.0])]
    for _ in range(n - 1):
        exact.append(exact[-1] @ step)
    assert np.allclose(pii.beliefs(unary, chain, np.zeros((0, 2)), link, link), exact, atol=1e-4)


def test_edge_cases(spark):
    model = pii.train([])
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (None, "a@b.co", "c"), (3, "a@b.co", "d"), (3, "a@b.co", "d")], "doc_id long, text string, spans string")
    rows = pii.personal_data(docs, model).collect()
    assert sorted(r.n_email for r in rows) == [0, 0, 1, 1, 1]
    assert pii.personal_data(docs.limit(0), pii.fit(docs.limit(0))).count() == 0
    began = time.time()
    for text in ("a" * 400_000, "1" * 400_000, "1." * 200_000, "+1" + " " * 400_000, "1 " * 200_000, "@" * 200_000, "a.b-" * 100_000 + "@"):
        pii.base_spans(text), pii.candidates(text)
    assert time.time() - began < 20
