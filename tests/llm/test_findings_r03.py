"""op6 learns from every labelled text; before, from at most 4,000 of each label."""

import numpy as np
from pyspark.sql import functions as F

from haulspark.llm import quality
from haulspark.llm.common import Scratch
from haulspark.llm.quality import N_FEATURES, PAIRS_EACH, PENALTY, fit_ranking, preferences, train_quality


def _labelled(spark, n):
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("w"), F.col("id") % 97, F.lit(" x"), F.col("id") % 89, F.when(F.col("id") % 3 == 0, " !! $").otherwise(" fine.")).alias("text"))
    return docs, docs.select("doc_id", (F.col("doc_id") % 3 != 0).cast("int").alias("quality"))


def _rows(blocks):
    return [(b.n_good, np.frombuffer(b.rows, np.float32).reshape(-1, N_FEATURES).astype(float)) for b in blocks]


def test_every_labelled_text_is_learned_from(spark, monkeypatch):
    told = []
    monkeypatch.setattr(quality, "_fit_blocks", lambda blocks, *_: told.extend(_rows(blocks.collect())), raising=False)
    docs, labels = _labelled(spark, 9000)
    train_quality(docs, labels)
    learned = docs.where(~quality.held_out()).count()
    assert learned > 4000 and sum(len(rows) for _, rows in told) == learned and len(told) > 1


def test_blocks_together_are_one_fit(spark, monkeypatch):
    """The gradient over all pairs of all blocks is zero at the weights, few bad texts stand in several blocks, and the cut is the quantile over all."""
    monkeypatch.setattr(quality, "BLOCK", 60)
    monkeypatch.setattr(quality, "LEAST", 45)
    monkeypatch.setattr(quality, "BINS", 3)
    told, fit = [], quality._fit_blocks
    monkeypatch.setattr(quality, "_fit_blocks", lambda blocks, *rest: told.extend(_rows(blocks.collect())) or fit(blocks, *rest))
    docs, labels = _labelled(spark, 400)
    ranking = train_quality(docs, labels)
    assert len(told) > 1 and sum(len(rows) for _, rows in told) > docs.where(~quality.held_out()).count()
    gradient, us, bad = PENALTY * ranking.weights, [], []
    for n_good, rows in told:
        z = (rows - ranking.mean) / ranking.scale
        one, two = preferences(n_good, len(z) - n_good, PAIRS_EACH)
        d = z[one] - z[n_good + two]
        gradient = gradient - (d / (1 + np.exp(d @ ranking.weights))[:, None]).sum(axis=0)
        us += (z @ ranking.weights).tolist()
        bad += [0] * n_good + [1] * (len(z) - n_good)
    assert np.abs(gradient).max() < 1e-5
    share = labels.where(~quality.held_out()).agg(1 - F.avg("quality")).first()[0]
    us, bad = np.array(us), np.array(bad)
    order = np.argsort(us, kind="stable")
    weight = np.where(bad == 1, share / bad.sum(), (1 - share) / (1 - bad).sum())[order]
    at = min(int(np.searchsorted(np.cumsum(weight), share - 1e-12)), len(us) - 2)
    assert abs(ranking.cut - (us[order[at]] + us[order[at + 1]]) / 2) < 1e-6


def test_one_block_is_the_fit_in_memory(spark):
    g = np.random.default_rng(3)
    rows = g.random((50, N_FEATURES)).astype(np.float32)
    blocks = spark.createDataFrame([(30, bytearray(rows.tobytes()))], "n_good int, rows binary")
    got, want = quality._fit_blocks(blocks, Scratch(spark, "test"), 0.3), fit_ranking(rows[:30], rows[30:], 0.3)
    assert np.allclose(got.weights, want.weights, atol=1e-7) and abs(got.cut - want.cut) < 1e-7


def test_cut_among_equal_utilities(spark):
    g = np.random.default_rng(5)
    for n, kinds in ((2, 1), (3, 2), (40, 4), (60, 50)):
        u, good = g.integers(0, kinds, n) * 0.1, np.r_[1, 0, g.integers(0, 2, n - 2)]
        order = np.lexsort([1 - good, u])
        for share in (0.05, 0.5, 0.95):
            weight = np.where(good == 1, (1 - share) / good.sum(), share / (n - good.sum()))[order]
            at = min(int(np.searchsorted(np.cumsum(weight), share - 1e-12)), n - 2)
            told = spark.createDataFrame([(float(a), int(b)) for a, b in zip(u, good, strict=True)], "u double, good int")
            assert abs(quality._cut(told, np.array([good.sum(), n - good.sum()]), share) - (u[order[at]] + u[order[at + 1]]) / 2) < 1e-12
