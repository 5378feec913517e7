"""Values at the ends of their ranges, other scripts, odd names, and the ranking against a solver of its own."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from haulspark.llm import pii, quality
from haulspark.llm.exact_dedup import exact_dedup
from haulspark.llm.mixing import mix_sources
from haulspark.llm.sentencepiece_codec import encode
from haulspark.llm.tokens import runs_of_texts

BIG = 2**53


def test_large_ids_beside_a_null_id_are_kept(spark):
    rows = [(BIG + 1, "a b", "s"), (BIG + 2, "a b c", "s"), (BIG + 3, "d", "s"), (None, "e f", "s"), (-(2**63), "g", None), (2**63 - 1, "h", None)]
    got = mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r["size"]) for r in got) == sorted((i is None, i or 0, len(t.split())) for i, t, _ in rows)


def test_smallest_and_largest_ids_own_texts(spark):
    rows = [(-(2**63), "a b"), (2**63 - 1, "ab"), (None, "ab"), (-(2**63), "x"), (2**63 - 1, "x")]
    got = exact_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.keep_id, r.kept) for r in got} == {(-(2**63), -(2**63), True), (2**63 - 1, -(2**63), False), (None, -(2**63), False)}


@pytest.mark.parametrize("name", ["иван.петров", "δοκιμή", "żółć", "अनिल", "山田", "한국", "אבגד", "Ünal.Şahin", "plain", "0042", "ж", "山"])
def test_names_of_every_script_are_changed(spark, name):
    df = spark.createDataFrame([(1, f"to {name}@mail.ru."), (2, f"{name}@mail.ru")], "doc_id long, text string")
    a, b = (r.text for r in pii.pseudonymise(df, "k").orderBy("doc_id").collect())
    moved = b.removesuffix("@mail.ru")
    assert a == f"to {moved}@mail.ru." and len(moved) == len(name) and sum(x != y for x, y in zip(moved, name, strict=True)) * 2 > len(name.replace(".", ""))


@pytest.mark.parametrize(("kind", "value"), [("secret", "token=abcdefgh12345678"), ("iban", "GB82 WEST 1234 5698 7654 32"), ("ip", "10.1.2.3"), ("date", "1999-12-31"), ("ssn", "123-45-6789"), ("card", "378282246310005"), ("phone", "+33 1 23 45 67 89")])
def test_values_of_every_kind_are_changed(spark, kind, value):
    row = pii.pseudonymise(spark.createDataFrame([(f"so {value} it is",)], "text string"), "k").first()
    assert row.pii_kinds == [kind] and value not in row.text


def test_columns_of_any_name_are_kept(spark):
    df = spark.createDataFrame([(1, "a b", "x", "y")], ["tick`s", "body", "text", "a.b"])
    row = encode(df, text_col="body").first()
    assert row["tick`s"] == 1 and row["text"] == "x" and row["a.b"] == "y" and len(row.ids) == 2


def test_ranking_is_that_of_an_independent_solver():
    g = np.random.default_rng(4)
    good, bad = g.normal(0.4, 1, (40, 5)), g.normal(-0.4, 2, (25, 5))
    got = quality.fit_ranking(good, bad, 0.4, pairs_each=6, penalty=3.0)
    one, two = quality.preferences(40, 25, 6)
    x = np.concatenate([good, bad])
    z = (x - x.mean(axis=0)) / (x.std(axis=0) + 1e-6)
    d = z[one] - z[40 + two]
    w = np.zeros(5)
    for _ in range(20000):  # plain descent on the loss as it is defined
        w -= 0.002 * (-(d / (1 + np.exp(d @ w))[:, None]).sum(axis=0) + 3.0 * w)
    assert np.allclose(got.weights, w, atol=1e-6)
    assert set(zip(one.tolist(), two.tolist(), strict=True)) <= {(i, j) for i in range(40) for j in range(25)}


def test_texts_are_scored_as_their_rows_are():
    import pyarrow as pa

    texts = [b"", b"A b c. d", b"x" * 500, "été 12 | ! été".encode(), b"one two one two\n"] * 3
    (_, _, data, offsets), = runs_of_texts(pa.array(texts, pa.binary()))
    rows = quality.features(data, offsets)
    g = np.random.default_rng(2)
    r = quality.Ranking(g.normal(size=quality.N_FEATURES), g.random(quality.N_FEATURES) + 0.5, g.normal(size=quality.N_FEATURES) * 0.1, 0.2)
    assert np.allclose(r.scores(rows), r.text_scores(data, offsets), atol=1e-5) and rows.shape == (15, quality.N_SHAPES + 3 * quality.BUCKETS)
