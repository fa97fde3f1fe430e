"""Repeated and null ids, many equal texts, extreme numbers, clashing columns."""

import collections
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from busloom.llm import itq, minhash, mixture, packing, substring
from busloom.llm.training import sample_per_class

DOCS = "doc_id long, text string, source string"


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(n))


@pytest.mark.parametrize("id_", [7, None])
def test_a_source_of_one_id_meets_its_target(spark, id_):
    rng = random.Random(1)
    rows = [(id_, sentence(rng, 9), "a") for _ in range(600)] + [(1000 + k, sentence(rng, 9), "a") for k in range(300)] + [(k, "same words here", "b") for k in range(100)]
    got = mixture.mix_to_targets(spark.createDataFrame(rows, DOCS).repartition(5), keep=["doc_id", "source"]).collect()
    taken, target = collections.Counter(), {}
    for r in got:
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert len(got) == 1000 and all(abs(taken[s] - target[s]) <= 9 for s in target)


@pytest.mark.parametrize("parts", [1, 6])
def test_rows_repeated_whole_are_counted_off(spark, parts):
    rows = [(None, "five words in this text", "a")] * 700 + [(3, "two words", "b")] * 50 + [(4, None, None)] * 30
    got = mixture.mix_to_targets(spark.createDataFrame(rows, DOCS).repartition(parts), keep=["doc_id", "source"]).collect()
    for source, size in (("a", 5), ("b", 2)):
        mine = [r for r in got if r.source == source]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= size / 2 + 1e-6 and max(r.copies for r in mine) - min(r.copies for r in mine) <= 1
    assert len(got) == 780


def test_an_id_with_two_texts_has_the_links_of_both(spark):
    rng = random.Random(2)
    one, two, three = sentence(rng, 120), sentence(rng, 120), sentence(rng, 120)
    near = lambda text: " ".join(["changed", *text.split()[1:]])
    rows = [(5, one), (5, two), (8, near(one)), (9, near(two)), (2, near(three)), (6, three), (6, three), (None, three), (11, None)]
    for parts in (1, 4):
        got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)).collect()
        assert sorted(((r.doc_id, r.class_id) for r in got), key=str) == sorted([(5, 5), (5, 5), (8, 5), (9, 5), (2, 2), (6, 2), (6, 2), (None, 2), (11, 11)], key=str)


@pytest.mark.parametrize("scale", [1.0, 1e200, 1e-200, 5e-320])
def test_cosines_of_extreme_vectors(spark, scale):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((20, 12))
    x[10:] = x[:10] + 0.02 * rng.standard_normal((10, 12))
    rows = [(k, (v * (scale if k % 2 else 1.0)).tolist()) for k, v in enumerate(x)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in itq.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {k: (1, k % 10) for k in range(20)}


def test_an_id_with_two_vectors(spark):
    x = np.eye(6)
    rows = [(1, x[0].tolist()), (1, x[1].tolist()), (2, (x[0] + 0.1 * x[2]).tolist()), (3, (x[1] + 0.1 * x[3]).tolist()), (4, x[5].tolist()), (4, x[5].tolist())]
    got = sorted(tuple(r)[:3] for r in itq.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert got == [(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1), (4, 0, 4), (4, 0, 4)]


def test_columns_of_any_name_and_type_survive(spark):
    text = sentence(random.Random(3), 40)
    rows = [(1, text, 7, {"a": 1}), (2, text + " more", 8, None), (3, None, 9, {}), (None, " a \n b ", None, {"b": 2})]
    got = substring.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string, _block int, tags map<string,int>"))
    assert got.columns == ["doc_id", "text", "_block", "tags", "n_words", "n_removed", "kept_text"]
    assert {(r.doc_id, r["_block"], r.n_words, r.n_removed, r.kept_text) for r in got.collect()} == {(1, 7, 40, 40, ""), (2, 8, 41, 40, "more"), (3, 9, 0, 0, ""), (None, None, 2, 0, "a b")}
    assert {r.doc_id: r.tags for r in got.collect()} == {1: {"a": 1}, 2: None, 3: {}, None: {"b": 2}}


def test_draws_of_rows_without_ids_are_bounded(spark):
    rows = [(None, f"text {k}", "en") for k in range(4000)] + [(None, "again", "en")] * 3000
    taken = sample_per_class(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "lang", "doc_id", 350, share=False, text="text", most_bytes=1 << 20)
    assert 120 < taken.count() < 300  # a twentieth of 4,001 different rows


def test_many_equal_texts_pack_fast(spark):
    import public_tokenizers

    rng = random.Random(6)
    rows = [(k, None) for k in range(100_000)] + [(200_000 + k, "a b c") for k in range(5_000)] + [(300_000 + k, sentence(rng, 30)) for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    path, began = public_tokenizers.path("word_bpe_49k.json"), time.time()
    got = packing.pack(docs, path).agg(F.sum("length").alias("n"), F.countDistinct("doc_id").alias("ids")).first()
    assert got.ids == len(rows) and got.n > 100_000 and time.time() - began < 60


def test_copies_are_walked_like_entries_of_their_own():
    rng = np.random.default_rng(7)
    kinds = [rng.integers(0, 30, rng.integers(2, 25)) for _ in range(12)]
    of = rng.integers(0, 12, 60)
    docs = [kinds[k] for k in of]
    weights = packing.Weights(np.bincount(np.concatenate([np.unique(d) for d in docs]), minlength=30), 60, 13.0)
    at = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    got = packing.shard_order(np.concatenate(docs), at, of * 1000, weights, 64)
    assert sorted(got) == list(range(60))
    for kind in range(12):  # a text's rows come in turn
        assert [r for r in got if of[r] == kind] == sorted(r for r in range(60) if of[r] == kind)
