import re

import numpy as np

from stratalens.llm import mixing


def test_permutations_are_bijections_and_invert():
    for n in (1, 2, 3, 7, 64, 1000):
        keys = mixing._keys(1, 2, 3)
        there = mixing.permute(np.arange(n), n, keys)
        assert sorted(there) == list(range(n)) and (mixing.permute(there, n, keys, inverse=True) == np.arange(n)).all()


def test_targets_share_the_excess():
    assert mixing.targets([100, 100, 100]) == [50.0, 100.0, 150.0]
    found = mixing.targets([10, 10, 1000])
    assert found[0] == 30.0 and found[1] == 30.0 and found[2] == 960.0
    assert mixing.targets([0, 5]) == [0.0, 5.0] and mixing.targets([]) == [] and mixing.targets([0, 0]) == [0.0, 0.0]


def test_shards_meet_quotas_exactly_and_any_task_draws_them_alike():
    quotas = np.array([17, 0, 300, 4_000])
    every = list(mixing.shards(quotas, 256, 3, 0, 17))
    for s, quota in enumerate(quotas):
        part = sorted((first, n) for _, source, first, n in every if source == s)
        assert sum(n for _, n in part) == quota
        assert [f for f, _ in part] == [0, *np.cumsum([n for _, n in part])[:-1]] or not part
    sizes = np.bincount([r[0] for r in every], [r[3] for r in every])
    assert (sizes[:-1] == 256).all() and sizes.sum() == quotas.sum()
    apart = [r for low in range(0, 17, 4) for r in mixing.shards(quotas, 256, 3, low, low + 4)]
    assert sorted(apart) == sorted(every)


def test_shards_of_a_very_large_mix():
    quotas = np.array([10**12, 3 * 10**12, 5])
    rows = list(mixing.shards(quotas, 8192, 3, 10**8, 10**8 + 40))
    by = np.bincount([r[1] for r in rows], [r[3] for r in rows], 2)
    assert len({r[0] for r in rows}) == 40 and by.sum() == 40 * 8192 and abs(by[0] / by.sum() - 0.25) < 0.01


def _check(docs, rows):
    """Against the contract: sizes, targets, words taken; the order of packing is the operator's own."""
    sizes, by = {}, {}
    for i, text, source in docs:
        sizes.setdefault(source, 0)
        sizes[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    goal = dict(zip(names, mixing.targets([sizes[s] for s in names])))
    source_of = {i: s for i, _, s in docs}
    for r in rows:
        s = source_of[r.doc_id]
        assert r.source_size == sizes[s] and abs(r.target - goal[s]) < 1e-6 and 0 <= r.taken <= 3 * r.size
        by[s] = by.get(s, 0) + r.taken
    assert len(rows) == len(docs) and all(abs(by[s] - goal[s]) <= 1 for s in names)


def test_documents(spark, sf):
    docs = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows = mixing.op5_mix(spark, sf).collect()
    _check(docs, rows)
    again = mixing.op5_mix(spark, sf).collect()
    assert sorted(rows) == sorted(again)


def test_blocks_give_the_words_taken(spark):
    rng = np.random.default_rng(4)
    docs = [(i, "w " * int(rng.integers(0, 60)), ["b", "a", None, "ü"][int(rng.integers(4))]) for i in range(200)]
    frame = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, source string, target string")
    found, slots = mixing.mix(frame, block_words=7, shard_slots=16)
    _check(docs, found.collect())
    each = slots.collect()
    assert len({(r.source_no, r.slot) for r in each}) == len(each) and max(r.shard for r in each) > 3


def test_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "a"), (None, "x y", "b"), (3, "x", None), (3, "x", None)], "doc_id long, text string, source string")
    rows = mixing.mix(docs)[0].collect()
    assert len(rows) == 5 and sum(r.taken for r in rows) == 4
    assert mixing.mix(docs.limit(0))[0].count() == 0 and mixing.mix(docs.filter("source = 'a'"))[0].count() == 2


def test_draws_beyond_the_generator_follow_the_same_law(monkeypatch):
    """By inversion as by the generator, for counts that both can draw; and sensible for those that only inversion can."""
    rng = np.random.default_rng(5)
    for good, bad, n in ((30, 70, 20), (5, 3, 4), (1000, 10, 500), (7, 900, 50)):
        plain = rng.hypergeometric(good, bad, n, 20_000)
        monkeypatch.setattr(mixing, "EXACT", 1)
        drawn = np.array([mixing._hypergeometric(rng, good, bad, n) for _ in range(20_000)])
        monkeypatch.undo()
        top = max(plain.max(), drawn.max()) + 1
        apart = np.abs(np.cumsum(np.bincount(plain, minlength=top)) - np.cumsum(np.bincount(drawn, minlength=top))).max() / 20_000
        assert apart < 0.02
    draws = [mixing._hypergeometric(rng, 3 * 10**10, 10**10, 4 * 10**9) for _ in range(50)]
    assert abs(np.mean(draws) - 3 * 10**9) < 5 * 26_000 / 50**0.5


def test_each_job_has_few_shuffles_and_short_descriptions(spark, sf, monkeypatch):
    from stratalens.llm import mixing, storage

    shuffles, lengths = [], []

    def written(df, tag, *rest):
        plan = df._jdf.queryExecution().executedPlan().toString()
        shuffles.append(plan.count("Exchange hashpartitioning"))
        lengths.append(spark.conf.get("spark.sql.maxPlanStringLength"))
        return storage.written(df, tag, *rest)

    monkeypatch.setattr(mixing, "written", written)
    before = spark.conf.get("spark.sql.maxPlanStringLength")
    mixing.mix(spark.read.parquet(f"{sf}/documents.parquet"))
    assert max(shuffles) <= 7 and set(lengths[1:]) == {"8192"}, (shuffles, lengths)
    assert spark.conf.get("spark.sql.maxPlanStringLength") == before
