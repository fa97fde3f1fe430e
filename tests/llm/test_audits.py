"""Conversation repair and the filter audit against brute force, with odd inputs."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from busloom.llm import filter_audit, repair

LEGAL = re.compile(r"(s?(ua)+)?")
CONVERSATION = "conv_id long, turn long, role string, text string"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def all_repairs(rows, inserts=3):
    """(cost, audit, lines) of the cheapest repairs, by trying every edit of every row and every insertion."""
    best = None
    fillers = [f for k in range(inserts) for f in itertools.product("ua", repeat=k)]
    names = {"u": "user", "a": "assistant"}

    def choices(role, text, fault):
        yield "D", 2, None
        if fault not in ("blank", "duplicate"):
            extra = 5 * (fault == "truncated")
            yield "K", extra, (role, text)
            for to in names.values():
                yield "R", 1 + extra, (to, text)

    for gaps in itertools.product(fillers, repeat=len(rows) + 1):
        if sum(map(len, gaps)) > inserts:
            continue
        for edits in itertools.product(*(list(choices(*r)) for r in rows)):
            audit, lines, cost = "", [], 5 * sum(map(len, gaps))
            for gap, edit in itertools.zip_longest(gaps, edits):
                audit += "I" * len(gap)
                lines += [(names[x], "") for x in gap]
                if edit:
                    audit, cost = audit + edit[0], cost + edit[1]
                    lines += [edit[2]] if edit[2] else []
            if LEGAL.fullmatch("".join(r[:1] or "?" for r, _ in lines)) and (best is None or (cost, audit) < best[:2]):
                best = cost, audit, "\n".join(f"{r}:{t}" for r, t in lines)
    return best


def test_least_audit_equals_every_repair():
    rng = random.Random(5)
    kinds = {"s": ("system", None), "u": ("user", None), "a": ("assistant", None), "?": (" ", None), "S": ("system", "truncated"),
             "U": ("user", "truncated"), "A": ("assistant", "truncated"), "^": ("tool", "truncated"), "!": ("user", "blank")}
    samples = ["", *kinds, *("".join(p) for p in itertools.product("sua?", repeat=2)), *("".join(rng.choice("suaua?SUA^!") for _ in range(rng.randint(2, 3))) for _ in range(60))]
    for codes in samples:
        rows = [(kinds[c][0], "x.", kinds[c][1]) for c in codes]
        assert repair.least_audit(codes) == all_repairs(rows, 2)[:2], codes
    assert repair.least_audit("ua" * 20_000) == (0, "K" * 40_000)
    cost, audit = repair.least_audit("uua" * 10_000)
    assert cost == 15_000 and audit == "KRRRKK" * 5_000  # three changed roles in six turns beat two deletions, which cost four


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def test_conversations_equal_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for conv in [*range(30), None]:
        for turn in [None, *range(rng.randint(1, 3))]:
            text = rng.choice(["Well done.", "cut off", "", " \t\n", None, "Ünï?\n", "Well done."])
            rows.append((conv, turn if rng.random() < 0.9 else None, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), text))
    rows += [rows[4], rows[4], (50, 2**60, "user", "long " * 30_000 + "."), (50, 2**60 + 1, "assistant", "Yes.")]
    table = spark.createDataFrame(rows, CONVERSATION).withColumn("alive", F.lit(1)).withColumn("audit", F.lit("x")).withColumn("kind", F.lit(7)).repartition(3)
    got = {r.conv_id: r for r in repair.op12_repair(table).collect()}
    assert set(got) == {r[0] for r in rows}
    space = r"\x20\x09-\x0D"
    for conv, row in got.items():
        turns = sorted((r for r in damage(rows) if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).digest()))
        faults, seen = [], set()
        for _, _, role, text in turns:
            faults.append("blank" if not re.search(f"[^{space}]", text) else "duplicate" if (role, text) in seen else "" if re.search(rf"[.!?][{space}]*\Z", text) else "truncated")
            seen.add((role, text))
        pairs = Counter(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(turns))
        numbers = [r[1] for r in turns if r[1] is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        assert (row.gaps, row.blank, row.duplicate, row.truncated, row.illegal) == (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), pairs[True])
        if len(turns) <= 4:
            cost, audit, lines = all_repairs([(r[2], r[3], f) for r, f in zip(turns, faults, strict=True)], 1)
            assert (row.cost, row.audit, row.repaired_sha256) == (cost, audit, hashlib.sha256(lines.encode()).hexdigest())
    assert repair.op12_repair(spark.createDataFrame([], CONVERSATION)).count() == 0


def test_filter_audit_equals_every_order(spark):
    rng = random.Random(9)
    texts = [None, "", "one", "A B C", "ab " * 250, " ".join(f"w{i}" for i in range(210)), "x | y", "Ünï 日本 \U0001f600", " ".join(f"w{i}" for i in range(300)) + " $"]
    rows = [(rng.choice([*range(40), None]), rng.choice(texts), rng.choice(["en", "de", "", None]), "s", 1) for _ in range(300)] + [(1000, "ab " * 250, "xx", None, None)]
    rows += [rows[0]] * 3
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in [*range(30), *range(5), None]]
    docs = spark.createDataFrame(rows, DOCS).withColumn("mask", F.lit(1)).withColumn("n", F.lit(2)).withColumn("part", F.lit("p")).repartition(3)
    got = {(r.part, r.filter_order, r.step): r for r in filter_audit.op13_filter_audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    good, toxic = ({i for i, *v in labels if i is not None and v[k] == 1} for k in (0, 1))
    smallest = {}
    for i, t, *_ in rows:
        if i is not None:
            smallest[t or ""] = min(i, smallest.get(t or "", i))
    failed = []
    for i, t, lang, *_ in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and i > smallest[t]}
        failed.append((lang or "", {f for f, bad in fails.items() if bad}, i in good, i in toxic))
    parts, orders = {p for p, *_ in failed}, ["".join(o) for o in itertools.permutations("ABCDE")]
    assert set(got) == set(itertools.product(parts, orders, range(1, 6)))
    total = Counter()
    for p, o in itertools.product(parts, orders):
        alive = [f for f in failed if f[0] == p]
        for step, x in enumerate(o, 1):
            gone = [f for f in alive if x in f[1]]
            alive = [f for f in alive if x not in f[1]]
            hit = [f for f in failed if f[0] == p and x in f[1]]
            r = got[p, o, step]
            want = len(alive), len(gone), len(hit) - len(gone), sum(f[1] == {x} for f in hit), sum(f[2] for f in gone), sum(f[3] for f in gone)
            assert (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost) == want
            total[p, x] += len(gone)
    assert all(r.shapley == total[p, o[step - 1]] for (p, o, step), r in got.items())
    assert filter_audit.op13_filter_audit(spark.createDataFrame([], DOCS), spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0
