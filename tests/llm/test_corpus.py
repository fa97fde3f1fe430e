"""Operators on documents: brute force, round trips, held-out accuracy, and odd inputs."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from busloom.llm import langid, lm_mixing, minhash, mixture, packing, sharding, simhash, substring, toxicity
from busloom.llm.training import fold
from busloom.llm.words import Table, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sentence(rng, n, stems="ka lo mi tu ra se ne po vi da".split()):
    return " ".join("".join(rng.choice(stems) for _ in range(rng.randint(1, 3))) for _ in range(n))


def corpus(rng, n=60):
    texts = [sentence(rng, rng.randint(1, 220)) for _ in range(n)]
    passage = sentence(rng, 50)
    for i in range(0, n, 9):
        texts[i] += "\n" + passage + "\t" + sentence(rng, 20)
    base = sentence(rng, 150)
    for i in range(1, n, 7):  # near copies
        w = base.split()
        w[rng.randrange(len(w))] = "edited" + str(i)
        texts[i] = " ".join(w)
    texts[3] = texts[5] = texts[8]  # exact copies
    texts[10], texts[11], texts[12] = None, "", " \n\t "
    texts[13] = "one"
    texts[14] = sentence(rng, 9000)
    texts[15] = "Ünïcode word ß 日本 \U0001f600 x\x1cy"
    texts[16] = ("again and again " * 60).strip()
    rows = [(i * 3, t, ["en", "de", None][i % 3], ["a", "b", "é", None][i % 4] if i % 3 else "a", None) for i, t in enumerate(texts)]
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus(random.Random(7))


@pytest.fixture(scope="module")
def docs(spark, rows):
    extra = spark.createDataFrame(rows, SCHEMA)
    return extra.withColumn("size", F.lit(1)).withColumn("fp", F.lit("x")).withColumn("n_words", F.lit(2)).repartition(3).cache()


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_words_follow_the_rule(rows):
    import pyarrow as pa

    texts = [r[1] for r in rows]
    w = words(pa.array(texts, pa.string()))
    got = [[w.data[w.start[k] : w.end[k]].tobytes().decode() for k in range(w.ptr[i], w.ptr[i + 1])] for i in range(len(texts))]
    assert got == [WORD.findall(t or "") for t in texts]
    flat = [x for t in got for x in t]
    assert len({x for x in flat}) == len(set(w.hash.tolist()))


def test_table_finds_every_key():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 2**63, 5000, dtype=np.uint64))
    table = Table(keys)
    assert (table.find(keys) == np.arange(len(keys))).all()
    assert (table.find(keys + np.uint64(1))[~np.isin(keys + np.uint64(1), keys)] == -1).all()
    assert (Table(keys[:0]).find(keys) == -1).all()


def shingles(text):
    w = WORD.findall(text or "")
    counts = collections.Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else {}
    return {(k, j) for k, v in counts.items() for j in range(v)}


def test_near_duplicates_match_all_pairs(docs, rows, spark):
    sets = {r[0]: shingles(r[1]) for r in rows}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and both / (len(sets[a]) + len(sets[b]) - both) >= 0.8:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    got = {r.doc_id: (r.class_id, r.kept) for r in minhash.near_duplicates(docs).collect()}
    assert got == {i: (root(i), root(i) == i) for i in sets}
    assert minhash.near_duplicates(empty(spark)).count() == 0


def test_near_duplicates_without_ids_and_with_repeats(spark):
    rows = [(None, "a b c d e f", "en", "s", 1), (None, None, None, None, None), (4, "a b c d e f", "en", "s", 1), (4, "a b c d e f", "en", "s", 1), (7, "a b c d e f", "en", "s", 1)]
    got = sorted(minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).select("doc_id", "class_id", "kept").collect(), key=str)
    assert len(got) == 5 and {r.class_id for r in got} == {4, None}
    assert {(r.doc_id, r.kept) for r in got} == {(None, True), (4, True), (7, False)}


def test_mixed_buckets_are_compared_in_blocks(docs, rows, spark):
    want = {r.doc_id: r.class_id for r in minhash.near_duplicates(docs).collect()}
    assert {r.doc_id: r.class_id for r in minhash.near_duplicates(docs, block=2).collect()} == want


def test_recall_of_near_copies_by_similarity(spark):
    """Pairs at similarities of 0.8 and more, one document of 200 words and one with some words changed."""
    rng, rows = random.Random(21), []
    for i in range(150):
        w = sentence(rng, 200).split()
        rows.append((2 * i, " ".join(w)))
        for k in range(1 + i % 3):
            w[20 + 60 * k] = f"new{i}x{k}"
        rows.append((2 * i + 1, " ".join(w)))
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = {i: shingles(t) for i, t in rows}
    near = [i for i in range(0, 300, 2) if len(sets[i] & sets[i + 1]) >= 0.8 * len(sets[i] | sets[i + 1])]
    assert len(near) > 100 and sum(got[i] == got[i + 1] for i in near) >= 0.99 * len(near)


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(3)
    common, own = rng.integers(0, 2**63, 300, dtype=np.uint64), rng.integers(0, 2**63, 200, dtype=np.uint64)
    units = np.concatenate([common, own[:100], common, own[100:]])
    of = np.repeat([0, 1], 400)
    sig = minhash.dart_signatures(units, of, 3, 2000)
    assert (sig[2] == 0).all() and (sig[:2] != 0).all()
    assert abs((sig[0] == sig[1]).mean() - 300 / 500) < 0.05


def test_substrings_match_brute_force(docs, rows, spark):
    split = {r[0]: WORD.findall(r[1] or "") for r in rows}
    times = collections.Counter(tuple(w[i : i + 35]) for w in split.values() for i in range(len(w) - 34))
    want = {}
    for i, w in split.items():
        gone = [False] * len(w)
        for a in range(len(w) - 34):
            if times[tuple(w[a : a + 35])] > 1:
                gone[a : a + 35] = [True] * 35
        kept = [x for x, g in zip(w, gone) if not g]
        want[i] = (len(w), len(w) - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.op4_substring(docs).collect()}
    assert got == want
    assert any(v[1] for v in want.values())
    small = {r.doc_id: (r.n_words, r.n_removed) for r in substring.dedup_substrings(docs.select("doc_id", "text"), block_bytes=2000).collect()}
    assert small == {i: v[:2] for i, v in want.items()}
    assert substring.op4_substring(empty(spark)).count() == 0
    clash = substring.dedup_substrings(docs.withColumn("n_removed", F.lit("x")).withColumn("kept_text", F.lit(1)))
    assert len(set(clash.columns)) == len(clash.columns) and {r.doc_id: r.n_removed for r in clash.collect()} == {i: v[1] for i, v in want.items()}


def test_the_cover_meets_every_shift():
    shifts = {(a - b) % substring.PERIOD for a in substring.COVER for b in substring.COVER}
    assert shifts == set(range(substring.PERIOD))


def test_edited_texts_and_fingerprints(docs, rows):
    ordered = sorted(rows)
    texts = [r[1] or "" for r in ordered]
    want = {}
    for k, r in enumerate(ordered):
        t, after = texts[k], texts[(k + 1) % len(texts)]
        q = len(t) // 4
        want[r[0]] = (len(t), hashlib.sha256((t[: len(t) - q] + after[:q]).encode()).hexdigest())
    got = {r.doc_id: r for r in simhash.op5_fingerprints(docs).collect()}
    assert {i: (r.n_chars, r.edited_sha256) for i, r in got.items()} == want
    assert got[9].fingerprint == got[15].fingerprint == got[24].fingerprint
    assert got[33].fingerprint == "0" * 16  # empty
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got.values())
    long = [r for r in got.values() if r.n_chars > 400]
    assert np.mean([r.near_edited for r in long]) > np.mean([r.near_next for r in long]) + 0.1


def test_fingerprints_of_repeated_rows_and_null_ids(spark):
    rows = [(2, "b b c d e f g h"), (2, "b b c d e f g h"), (2, "b b c d e f g h"), (5, "q r s t u v w x y"), (None, "z y"), (None, None), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA)
    got = simhash.op5_fingerprints(docs).collect()
    assert collections.Counter((r.doc_id, r.n_chars) for r in got) == collections.Counter((i, len(t or "")) for i, t in rows)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    text = rows[0][1]
    want = [sha(text[: len(text) - 3] + text[:3])] * 2 + [sha(text[: len(text) - 3] + rows[3][1][:3])]
    assert sorted(r.edited_sha256 for r in got if r.doc_id == 2) == sorted(want)
    alone = simhash.op5_fingerprints(docs.filter("doc_id = 2")).collect()
    assert len(alone) == 3 and {r.edited_sha256 for r in alone} == {want[0]}


def test_fingerprints_match_plain_votes(docs, rows, spark):
    """Votes of Spark's hash of every word five-gram, counted bit by bit."""
    grams, texts = {}, {}
    for r in rows[:20]:
        w = WORD.findall(r[1] or "")[:400]
        texts[r[0]] = " ".join(w)
        grams[r[0]] = [w[i : i + 5] for i in range(max(1, len(w) - 4))] if w else []
    flat = sorted({tuple(g) for v in grams.values() for g in v})
    at = spark.createDataFrame([(i, list(g)) for i, g in enumerate(flat)], "i int, g array<string>").withColumn("h", F.transform("g", lambda x: F.xxhash64(x)))
    chained = at.select("i", F.expr("xxhash64(get(h, 0), get(h, 1), get(h, 2), get(h, 3), get(h, 4))").alias("x")).collect()
    hashed = {flat[r.i]: r.x & (2**64 - 1) for r in chained}
    table = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.fp & (2**64 - 1) for r in simhash.fingerprints(table, ["doc_id"], "text").collect()}
    for i, v in grams.items():
        votes = [hashed[tuple(g)] for g in v]
        want = sum(1 << b for b in range(64) if sum(x >> b & 1 for x in votes) * 2 > len(votes))
        assert got[i] == want


def test_block_tables_find_all_within_the_radius(spark):
    rng = random.Random(5)
    seeds = [rng.getrandbits(64) for _ in range(30)]
    values = {s ^ sum(1 << b for b in rng.sample(range(64), d)) for s in seeds for d in (0, 1, 2, 3, 4)}
    signed = [v - 2**64 if v >= 2**63 else v for v in values]
    table = spark.createDataFrame([(v,) for v in signed], "fp long")
    got = {(r.q, r.fp) for r in simhash.near_fingerprints(table.select(F.col("fp").alias("q")), table).collect()}
    assert got == {(a, b) for a in signed for b in signed if bin((a ^ b) & (2**64 - 1)).count("1") <= 3}


def test_mixing_meets_its_targets(docs, rows, spark):
    got = mixture.op6_mixing(docs).collect()
    sizes = {r[0]: len(WORD.findall(r[1] or "")) for r in rows}
    assert {r.doc_id: r.size for r in got} == sizes
    source = {r[0]: r[3] for r in rows}
    total = collections.Counter()
    for i, s in source.items():
        total[s] += sizes[i]
    names = sorted(total, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    open_, target, budget = set(names), {}, 1.5 * sum(total.values())
    while open_:
        level = (budget - sum(target.values())) / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level > 2 * total[s]}
        target |= {s: 2.0 * total[s] for s in over} if over else {s: weight[s] * level for s in open_}
        open_ = open_ - over if over else set()
    taken = collections.Counter()
    for r in got:
        assert math.isclose(r.target, target[source[r.doc_id]], rel_tol=1e-9) and 0 <= r.taken <= 2 * r.size
        taken[source[r.doc_id]] += r.taken
    for s in names:
        largest = max(sizes[i] for i in sizes if source[i] == s)
        assert abs(taken[s] - target[s]) <= largest
    again = {(r.doc_id, r.taken) for r in mixture.op6_mixing(docs.repartition(7)).collect()}
    assert again == {(r.doc_id, r.taken) for r in got}
    assert mixture.op6_mixing(empty(spark)).count() == 0


def test_shards_are_even_and_computable(docs, rows, spark):
    got = sharding.op10_sharding(docs).collect()
    assert len(got) == len(rows)
    by = collections.defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert max(map(len, by.values())) - min(len(by.get(k, [])) for k in range(40)) <= 1
    texts = {r[0]: (r[1] or "").encode() for r in rows}
    assert all(r.size == len(texts[r.doc_id]) + 16 and r.text_crc32 == zlib.crc32(texts[r.doc_id]) for r in got)
    place = sharding.permute(np.arange(len(rows)), len(rows), 17)
    order = sorted(texts)
    assert all((r.shard, r.slot) == (place[order.index(r.doc_id)] % 40, place[order.index(r.doc_id)] // 40) for r in got)
    assert sharding.op10_sharding(empty(spark)).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 17, 64, 1000, 4097])
def test_permutation_is_a_bijection(n):
    assert sorted(sharding.permute(np.arange(n), n, 9)) == list(range(n))


def test_packing_loses_and_pads_nothing(docs, rows, spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    ids = {r[0]: t.encode(r[1] or "", add_special_tokens=False).ids + [1] for r in rows}
    got = packing.pack(docs, path, shard_tokens=8_000, with_ids=True).collect()
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        assert list(r.ids) == ids[r.doc_id][r.start : r.start + r.length] and r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        pieces[r.doc_id] += list(range(r.start, r.start + r.length))
        sequences[r.sequence_id] += list(range(r.offset, r.offset + r.length))
    assert {i: sorted(p) for i, p in pieces.items()} == {i: list(range(len(x))) for i, x in ids.items()}
    for s in sequences.values():
        assert sorted(s) == list(range(len(s))) and (len(s) == 2048 or len(s) & (len(s) - 1) == 0 and len(s) < 2048)
    assert packing.pack(empty(spark), path).count() == 0


def plain_bm25(docs, seed, weights):
    """BM25 of every document for the seed's terms, straight from the formula."""
    tf = [collections.Counter(d) for d in docs]
    out = []
    for d, c in zip(docs, tf):
        norm = packing.K1 * (1 - packing.B + packing.B * len(d) / weights.mean)
        out.append(sum(weights.idf[t] * c[t] * (packing.K1 + 1) / (c[t] + norm) for t in set(docs[seed]) if c[t]))
    return out


def test_neighbours_by_plain_bm25():
    rng = np.random.default_rng(3)
    docs = [rng.zipf(1.3, rng.integers(3, 40)) % 50 for _ in range(30)]
    df = np.bincount(np.concatenate([np.unique(d) for d in docs]), minlength=50)
    weights = packing.Weights(df, len(docs), np.mean([len(d) for d in docs]))
    assert all(weights.idf[t] == (math.log((30 - n + 0.5) / (n + 0.5)) if 2 <= n < 15 else 0) for t, n in enumerate(df))
    at = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    index = packing.Index(np.concatenate(docs), at, weights)
    for seed in range(30):
        got, want = index.scores(seed), np.array(plain_bm25([d.tolist() for d in docs], seed, weights))
        other = np.arange(30) != seed  # terms of the seed alone find only itself
        assert np.allclose(got[other], want[other])
    sizes, same = np.diff(at), np.arange(30) // 2
    order, room = packing.packing_order(index, sizes, same, 64), 64
    assert sorted(order) == list(range(30))
    scores, unused, filled, k, seed = None, set(range(30)), 0, 0, None
    while unused:  # the same greedy walk with plain lists
        if seed is None:
            seed = min(unused)
            assert order[k] == seed
            unused.discard(seed)
            filled, k = filled + sizes[seed], k + 1
        left, scores, held, seed = -filled % room, index.scores(seed), {same[seed]}, None
        while left > 0:
            ranked = sorted((-scores[d], d) for d in unused if same[d] not in held)
            if not ranked:
                break
            best = ranked[0][1]
            assert order[k] == best
            unused.discard(best)
            held.add(same[best])
            filled, k = filled + sizes[best], k + 1
            seed = best if sizes[best] > left else None
            left -= min(left, sizes[best])


def test_related_documents_share_shards(spark):
    import public_tokenizers

    rng, rows = random.Random(5), []
    for topic in range(40):
        stems = ["".join(rng.choice("bcdfghklmnprstvz") + rng.choice("aeiou") for _ in range(3)) for _ in range(12)]
        rows += [(topic * 100 + k, sentence(rng, 120, stems)) for k in range(6)]
    rows += [(9000 + i, rows[0][1]) for i in range(2)]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), shard_tokens=20_000).collect()
    met, pieces = collections.defaultdict(set), collections.Counter()
    for r in got:
        met[r.sequence_id].add(r.doc_id)
        pieces[r.doc_id] += r.length
    pairs = [(a // 100, b // 100) for s in met.values() for a in s for b in s if a < b < 9000]
    assert len({r.sequence_id >> 20 for r in got}) > 3 and np.mean([a == b for a, b in pairs]) > 0.5  # by chance: 0.02
    assert all(pieces[r.doc_id] == r.doc_tokens for r in got)
    again = {(r.doc_id, r.start, r.sequence_id) for r in packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), shard_tokens=20_000).collect()}
    assert again == {(r.doc_id, r.start, r.sequence_id) for r in got}


def test_language_on_held_out_rows(spark):
    rng = random.Random(2)
    stems = {"xx": "the and ing tion ou er".split(), "yy": "der sch ung ein ü ä".split(), "zz": "que ción os la ñ í".split()}
    rows = [(i, sentence(rng, rng.randint(4, 60), stems[lang]), lang, "s", 1) for i in range(240) for lang in [list(stems)[i % 3]]]
    rows += [(900, None, "xx", None, None), (901, "", "yy", None, None), (902, "123 -- 4", "zz", None, None), (903, "ung der", None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: r for r in langid.op7_language(docs).collect()}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got.values())
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i in got)
    held = [i for i in range(240) if got[i].held_out]
    assert np.mean([got[i].lang_pred == rows[i][2] for i in held]) > 0.97
    assert [got[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and got[903].lang_pred == "yy"
    assert langid.op7_language(empty(spark)).count() == 0


def test_code_lengths_match_a_plain_ppm(spark):
    """The frozen code length of a word against a direct walk over plain counts."""
    import pyarrow as pa

    texts = ["abra cadabra abba", "bar abra"]
    rows = [(1, texts[0], "a", None, None), (2, texts[1], "a", None, None)]
    model = langid.train(spark.createDataFrame(rows, SCHEMA).select("doc_id", "text", "lang"))
    counts = collections.Counter()
    for t in texts:
        for word in t.split():
            s = " " + word + " "
            for at in range(1, len(s)):
                for k in range(langid.ORDER + 1):
                    if at - k >= 0:
                        counts[(k, s[at - k : at], s[at])] += 1

    def bits(word):
        s, total = " " + word + " ", 0.0
        for at in range(1, len(s)):
            for k in range(min(langid.ORDER, at), -1, -1):
                seen = {x[2]: n for x, n in counts.items() if x[0] == k and x[1] == s[at - k : at]}
                n, d = sum(seen.values()), len(seen)
                if s[at] in seen:
                    total -= math.log2(seen[s[at]] / (n + d))
                    break
                total -= math.log2(d / (n + d)) if seen else 0
            else:
                total += 8
        return total

    w = words(pa.array(["abra cab bzz cadab"]))
    got = langid.code_lengths(w, np.arange(4), model, Table(model.keys))[:, 0]
    assert np.allclose(got, [bits(x) for x in ("abra", "cab", "bzz", "cadab")], atol=1e-3)


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(4)
    bad = ["moronic", "vequta", "vequru"]
    rows, labels = [], []
    for i in range(400):
        w = sentence(rng, rng.randint(3, 60)).split()
        toxic = i % 5 == 0
        if toxic:
            w.insert(rng.randrange(len(w)), rng.choice(bad))
        rows.append((i, " ".join(w), "en", "s", 1))
        labels.append((i, 1, int(toxic)))
    rows += [(900, None, None, None, None), (901, "", "en", "s", 0)]
    docs, marks = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([*labels, (None, 1, 1), (900, None, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.op9_toxicity(docs, marks).collect()}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    held = [i for i in range(400) if got[i].held_out]
    assert held and np.mean([got[i].predicted == (i % 5 == 0) for i in held]) > 0.97
    assert got[900].predicted == 0 and got[901].predicted == 0
    assert toxicity.op9_toxicity(empty(spark), marks).count() == 0
    assert {(r.score < 0.3, r.predicted) for r in toxicity.op9_toxicity(docs, marks.limit(0)).collect()} == {(True, 0)}
    clash = docs.withColumn("score", F.lit("x"))
    model = toxicity.train(toxicity.labelled_rows(docs, marks))
    assert toxicity.score_toxicity(clash, model, ["doc_id", "score"]).dtypes == [("doc_id", "bigint"), ("score", "double")]


def test_toxicity_counts_match_plain_ones(spark):
    rng = random.Random(14)
    rows = [(i, sentence(rng, 30) + (" Moronic" if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(200)]
    model = toxicity.train(spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(3))
    p, q = collections.Counter(), collections.Counter()
    slot = lambda g: int(toxicity.slot_of(toxicity.rolling(np.array([ord(c) for c in g], np.uint64), toxicity._BASE, np.array([0]), np.array([len(g)])))[0])
    for _, t, toxic in rows:
        for word in set(t.split()):
            s = " " + word.lower() + " "
            (p if toxic else q).update(slot(s[a : a + n]) for n in toxicity.SIZES for a in range(len(s) - n + 1))
    tp, tq = sum(p.values()), sum(q.values())
    share = tp / (tp + tq)
    telling = set()
    for g in p | q:
        a, b = p[g], q[g]
        surprise = 2 * sum(x * math.log(x / ((a + b) * rate)) for x, rate in ((a, share), (b, 1 - share)) if x)
        if surprise > 12 and abs(math.log((a + 1) / (tp + 2)) - math.log((b + 1) / (tq + 2))) >= 1:
            telling.add(g)
    assert telling and set(model.slots.tolist()) == telling


def test_toxicity_learns_a_rare_class_from_all_its_rows(spark):
    rng = random.Random(9)
    rows = []
    for i in range(3000):
        w = sentence(rng, rng.randint(10, 40)).split()
        if i % 150 == 0:
            w.insert(rng.randrange(len(w)), ["moronic", "vequta"][i % 300 == 0])
        rows.append((i, " ".join(w), int(i % 150 == 0)))
    labelled = spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(3)
    model = toxicity.train(labelled, sample_rows=150)
    got = {r.doc_id: r.score for r in toxicity.score_toxicity(labelled, model, ["doc_id"]).collect()}
    assert [i for i in got if (got[i] >= 0.3) != (i % 150 == 0)] == []
    assert np.mean([got[i] for i in got]) < 0.05  # the share of the class, not of the sample


def test_lm_counts_and_scores(docs, rows, spark):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    split = {r[0]: [x.translate(lower) for x in WORD.findall(r[1] or "")] for r in rows}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in split}
    c = collections.Counter(x for i, w in split.items() if not held[i] for x in w)
    ends = sum(not h for h in held.values())
    n, v = sum(c.values()) + ends, len(c) + 1
    for blocks in (16 << 20, 3000):
        out = lm_mixing.score_texts(docs, fold("doc_id", 7) == 2, block_bytes=blocks, part_bytes=2 * blocks)
        got = {r.doc_id: r for r in out.collect()}
        assert got.keys() == split.keys()
        for i, w in split.items():
            r = got[i]
            base = sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w) + math.log10((ends + 1) / (n + v + 1))
            assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(w) + 1, sum(c[x] > 0 for x in w) + 1, n)
            assert math.isclose(r.base_score, base, rel_tol=1e-9) and r.score < 0
    assert lm_mixing.score_texts(empty(spark), fold("doc_id", 7) == 2).count() == 0


def test_lm_contexts_are_those_of_the_text():
    """Keys of contexts agree exactly where style, the bytes named and the byte coded agree."""
    import pyarrow as pa

    texts = ["the cat the cat sat at a the", "", None, "a cat sat", "x yé the catalogue"]
    styles = np.log(np.random.default_rng(1).dirichlet(np.ones(256), 3))
    read = lm_mixing.tokens(words(pa.array(texts), lower=True), styles)
    style = lambda before: 3 if not before else int(np.argmax([sum(t[b] for w in before for b in w.encode() + b" ") for t in styles]))
    want = [collections.Counter() for _ in range(lm_mixing.CONTEXTS)]
    for t in texts:
        w = WORD.findall(t or "")
        for k, x in enumerate([*w, None]):
            own, s = b"\n" if x is None else x.encode() + b" ", style(w[:k])
            before = w[k - 1].encode() + b" " if k else b""
            for i, byte in enumerate(own):
                seen = b"\0\0\0\0" + (before[-4:] if i < lm_mixing.HEAD else b" ") + own[:i]
                for j, n in enumerate(lm_mixing.ORDERS):
                    inside = seen[-n:] if i < lm_mixing.HEAD else seen[4:][-n:]
                    want[j][(s, inside, byte)] += 1
                want[-1][(s, own[:i], byte)] += 1
    heads, tails, _, _ = lm_mixing.joined([read])
    got = [collections.Counter() for _ in range(lm_mixing.CONTEXTS)]
    for part in (lm_mixing.Coded(heads), lm_mixing.Coded(tails)):
        for j, (keys, n) in enumerate(part.counts()):
            got[j].update(dict(zip(keys.tolist(), n.tolist())))
    assert [sorted(c.values()) for c in got] == [sorted(c.values()) for c in want]
    assert len(set().union(*got)) == sum(map(len, got))


def test_lm_codes_and_probabilities():
    rng = np.random.default_rng(8)
    byte = np.unique(rng.integers(0, 256, 90))
    keys = np.sort((np.uint64(5 << 40)) | lm_mixing.PATH[byte])
    every = np.sort((np.uint64(5 << 40)) | lm_mixing.PATH)
    count = dict(zip(keys.tolist(), rng.integers(1, 300, len(keys)).tolist()))
    n = np.array([count.get(k, 0) for k in every.tolist()])
    codes = lm_mixing.path_codes(every, n, np.arange(256), 0)
    path = {int(lm_mixing.PATH[b]): f"{int(lm_mixing.PATH[b]):012b}"[: lm_mixing.LENGTH[b]] for b in range(256)}
    ordered = [path[int(k) & 4095] for k in every.tolist()]
    for i in rng.integers(0, 256, 40):
        for d in range(len(ordered[i])):
            right = sum(c for p, c in zip(ordered, n) if p[: d + 1] == ordered[i][: d + 1])
            wrong = sum(c for p, c in zip(ordered, n) if p[:d] == ordered[i][:d]) - right
            assert codes[d, i] == lm_mixing.codes_of(np.array(right), np.array(wrong))
    mixer = lm_mixing.Mixer()
    mixer.weights = rng.normal(0.3, 0.2, mixer.weights.shape)
    mixer.seen = mixer.seen * rng.uniform(0.5, 2, mixer.seen.shape)
    mixer.refresh()
    blank, total = np.zeros(256, np.uint8), np.zeros(256)
    for d in range(lm_mixing.DEEPEST):
        live = np.array([len(p) > d for p in ordered])
        got = mixer.bits([c[live] for c in (codes[d], blank, codes[d], codes[d])], min(d, 1))[0]
        total[live] += got
    assert 0.98 < np.exp2(total).sum() <= 1 + 1e-6  # the rest falls on paths that no byte has


def test_lm_learns_from_what_comes_before(spark):
    rng = random.Random(6)
    phrases = [sentence(rng, 12) for _ in range(12)]
    rows = [(i, " ".join(rng.choice(phrases) for _ in range(6)), "en", "s", 1) for i in range(300)]
    out = lm_mixing.op3_lm_scores(spark.createDataFrame(rows, SCHEMA)).filter("held_out").collect()
    assert np.mean([r.score > r.base_score for r in out]) > 0.9
    again = {r.doc_id: r.score for r in lm_mixing.op3_lm_scores(spark.createDataFrame(rows, SCHEMA).repartition(5)).filter("held_out").collect()}
    assert all(abs(again[r.doc_id] - r.score) < 1e-6 for r in out)


def test_lm_codes_of_both_folds_in_one_pass():
    rng = np.random.default_rng(4)
    values = rng.choice([0, 3, 255, 2**31, 2**32 - 1], 500).astype(np.uint64)
    kinds, kind = lm_mixing.alike_few(values)
    assert kinds.tolist() == sorted(set(values.tolist())) and (kinds[kind] == values).all()
    pairs = sorted({(int(c) << lm_mixing.DEEPEST) | int(lm_mixing.PATH[b]) for c, b in zip(rng.integers(1, 6, 60), rng.integers(0, 256, 60))})
    keys, n = np.array(pairs, np.uint64), rng.integers(1, 90, len(pairs))
    wanted = [(np.arange(0, len(keys), 2), 1), (np.arange(1, len(keys), 3), 0)]
    for (asked, own), codes in zip(wanted, lm_mixing.path_codes(keys, n, wanted)):
        for a, place in enumerate(asked):
            for depth in range(1, lm_mixing.DEEPEST + 1):
                upper, right = (sum(int(m) for k, m in zip(pairs, n) if k >> lm_mixing.DEEPEST - d == pairs[place] >> lm_mixing.DEEPEST - d) - own for d in (depth - 1, depth))
                live = depth <= lm_mixing.LENGTH[list(lm_mixing.PATH).index(pairs[place] & (1 << lm_mixing.DEEPEST) - 1)]
                assert codes[depth - 1, a] == (lm_mixing.codes_of(np.array([right]), np.array([upper - right]))[0] if live else 0)


def test_lm_contexts_are_worked_out_once_a_kind(monkeypatch):
    """Bytes after equal beginnings of words are one kind, and each byte's keys are those of a plain formula."""
    import pyarrow as pa

    texts = ["theme themes the theory a thesis themes", "x", "theme \U0001f600\u65e5\u672c theories " + "the" * 40, "aa aaa aaaa aaaaa"]
    styles = np.log(np.random.default_rng(2).dirichlet(np.ones(256), 2))
    heads, tails, _, _ = lm_mixing.joined([lm_mixing.tokens(words(pa.array(texts), lower=True), styles)])
    scramble = lambda x: int(lm_mixing.mix(np.array([x % 2**64], np.uint64))[0])
    next_, join, salts = int(lm_mixing._NEXT), int(lm_mixing._JOIN), [int(x) for x in lm_mixing._SALTS]
    place_key = lambda context, byte: scramble(context) >> 8 & ~4095 | int(lm_mixing.PATH[byte])

    def plain(style, before, byte, own):
        context, out = scramble((style + 77) * join), []
        start = context
        for k in range(1, 5):
            if k <= len(before):
                context = (context + before[-k] + 1) * next_
            if k in lm_mixing.ORDERS:
                out.append(place_key(context + salts[lm_mixing.ORDERS.index(k)], byte))
        return [*out, place_key(start + own + salts[-1], byte)]

    want = [[], []]
    for style, last, byte in zip(heads.style.tolist(), heads.last.tolist(), heads.byte.tolist()):
        for i in range(lm_mixing.HEAD):
            if byte[i]:
                want[0].append(plain(style, [*last, *byte[:i]], byte[i], byte[0] + 1 if i else 0))
    beginnings = set()
    for style, low, high in zip(tails.style.tolist(), tails.ptr, tails.ptr[1:]):
        own = tails.data[low:high].tolist()
        for i in range(lm_mixing.HEAD, len(own)):
            so_far = sum((b + 1) * pow(lm_mixing._WORD, j, 2**64) for j, b in enumerate(own[:i])) + i * join
            want[1].append(plain(style, [32, *own[:i]], own[i], so_far))
            beginnings.add((style, *own[: i + 1]))
    for fits in (True, False):  # and where a window's number leaves no room for its place
        if not fits:
            order = lm_mixing._order
            monkeypatch.setattr(lm_mixing, "_order", lambda values, bits: order(values, 64))
        for part, keys in zip((heads, tails), want):
            coded = lm_mixing.Coded(part)
            assert [[int(k[at[x]]) for k, at in coded.groups] for x in coded.kind] == keys
            assert all((k[1:] > k[:-1]).all() for k, _ in coded.groups)
        assert len(coded.byte) == len(beginnings) < len(want[1])


def test_lm_words_of_one_letter(spark):
    """No word has a byte after its head."""
    rows = [(i, "a b a c", "en", "s", 1) for i in range(40)]
    out = lm_mixing.op3_lm_scores(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(out) == 40 and all(r.n_tokens == 5 and r.score < 0 for r in out) and {r.held_out for r in out} == {True, False}
