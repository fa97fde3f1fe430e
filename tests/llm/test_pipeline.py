"""The stages on a small corpus, each against what its input says."""

import collections
import random

import corpus_pipeline
from busloom.llm import queries

from .test_corpus import SCHEMA, WORD, sentence, shingles


def test_stages_take_effect(spark, tmp_path):
    rng = random.Random(11)
    rows, labels = [], []
    passage = sentence(rng, 60)
    for i in range(200):
        w = sentence(rng, rng.randint(20, 120)).split()
        if i % 10 == 0:
            w.insert(3, "idiotic")
        if i % 10 == 1:
            w += passage.split()
        labels.append((i, 1, int(i % 10 == 0)))
        rows.append((i, " ".join(w), "en", f"src{i % 3}", 5))
    rows += [(300 + i, rows[5][1] + " end", "en", "src0", 5) for i in range(4)] + [(400, None, None, None, None), (401, "", "en", "src1", 0)]
    folder = str(tmp_path)
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        docs.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        seen.append(docs.collect())
        if name != "packing":
            assert docs.columns == corpus_pipeline.COLUMNS
    clean, single, cut, mixed, packed = seen
    kept = {r.doc_id for r in clean}
    assert len([i for i in range(0, 200, 10) if i in kept]) <= 2 and len([i for i in range(200) if i % 10 and i in kept]) >= 176
    assert {r.doc_id for r in single} & {5, 300, 301, 302, 303} == {5}
    sets = [shingles(r.text) for r in single if shingles(r.text)]
    assert all(len(a & b) / (len(a) + len(b) - len(a & b)) < 0.8 for k, a in enumerate(sets) for b in sets[:k])
    before = {r.doc_id: r.text for r in single}
    assert not any(passage[:100] in (r.text or "") for r in cut)
    assert all(r.text == before[r.doc_id] for r in cut if r.doc_id % 10 not in (0, 1))
    sizes = {r.doc_id: len(WORD.findall(r.text or "")) for r in cut}
    times = collections.Counter(r.doc_id for r in mixed)
    assert max(times.values()) == 2 and set(times) <= set(sizes)
    words = sum(sizes[i] * n for i, n in times.items())
    assert abs(words - 1.5 * sum(sizes.values())) < 500
    assert {r.doc_id for r in packed} == set(times)


def test_repeated_rows_and_copies_without_id_stay_once(spark, tmp_path):
    rng = random.Random(12)
    a, b, c, d, e = (sentence(rng, 60) for _ in range(5))
    edited = " ".join(["edited", *c.split()[1:]])
    texts = [(1, a), (1, a), (2, b), (None, b), (None, c), (None, c), (None, edited), (3, d), (4, e), (4, d), (None, None), (None, None), (5, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts], SCHEMA).repartition(3)
    single = corpus_pipeline.drop_near_copies(spark, docs, str(tmp_path))
    got = [(r.doc_id, r.text) for r in single.collect()]
    empty = [(None, None), (None, None), (5, "")]
    assert sorted((x for x in got if x[0] is not None or x[1] is None), key=str) == sorted([(1, a), (2, b), (3, d), (4, e), *empty], key=str)
    assert len(got) == 8 and len([x for x in got if x[0] is None and x[1] in (c, edited)]) == 1
    cut = [(r.doc_id, r.text) for r in corpus_pipeline.drop_repeated_passages(spark, single, str(tmp_path)).collect()]
    assert sorted(cut, key=str) == sorted(got, key=str)


def test_nothing_goes_without_labels_and_mixing_counts_rows(spark, tmp_path):
    rng = random.Random(13)
    rows = [(i % 30, sentence(rng, 40), "en", f"s{i % 2}", 5) for i in range(60)] + [(None, sentence(rng, 40), "en", "s0", 5), (3, None, None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(2)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.drop_toxic(spark, docs, str(tmp_path)).count() == len(rows)
    mixed = collections.Counter((r.doc_id, r.text) for r in corpus_pipeline.mix_sources(spark, docs, str(tmp_path)).collect())
    assert max(mixed.values()) == 2 and set(mixed) <= {r[:2] for r in rows}
    assert abs(sum(n * 40 for n in mixed.values()) - 1.5 * 61 * 40) <= 160


def test_every_operator_has_a_query():
    numbers = sorted(int(name[2:].split("_")[0]) for name in queries.QUERIES)
    assert numbers == list(range(1, 14))
