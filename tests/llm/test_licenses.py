"""Template automata against regular expressions, and whole rows against a plain scan."""

import random
import re

import pytest
from pyspark.sql import functions as F

from busloom.llm import licenses

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def wording(parts, rng):
    """A random text of the template."""
    out = []
    for p in parts:
        if isinstance(p, str):
            out.append(p)
        elif isinstance(p, int):
            out += [rng.choice(["any", "words", "the"]) for _ in range(rng.randint(0, p))]
        elif rng.random() < 0.5:
            out += wording(p, rng)
    return out


def plain(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")  # before the words are taken: capitals part them
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    at = [(i, label) for p, label in licenses.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    joined = "".join(" " + x for x in w)
    found = {k for k, m in licenses.TEMPLATES.items() if re.search(licenses.pattern(licenses.parse(m)) + "(?: |$)", joined)}
    base = {label for _, label in at}
    places = [i for i, _ in at]
    return (len(w), len(at), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | found)), 1.0 if found else 0.5 if at else 0.0)


def test_automata_equal_regular_expressions():
    rng = random.Random(2)
    small = ["a [[b [[c ]]]]d", "a {{2}} [[b {{1}}]] a", "a[[ b]][[ c]] {{1}}[[ d]] b", "a b {{3}}", "[[x ]]a [[b]] {{2}} c"]
    for markup in [*small, *licenses.TEMPLATES.values()]:
        automaton = licenses.Automaton(markup)
        rule = re.compile(licenses.pattern(automaton.parts) + "(?: |$)")
        for _ in range(150):
            text = wording(automaton.parts, rng) if markup not in small or rng.random() < 0.3 else [rng.choice("abcdx") for _ in range(rng.randint(1, 7))]
            if rng.random() < 0.5 and len(text) > 1:
                k = rng.randrange(len(text))
                text[k : k + rng.randint(0, 1)] = rng.choice([[], ["odd"], [text[0]]])
            want = bool(rule.match("".join(" " + x for x in text)))
            assert automaton.accepts(x.encode() for x in text) == want, (markup, text)
    for broken in ("[[a", "a ]]", "[[a]] {{3}}"):
        with pytest.raises(ValueError):
            licenses.parse(broken)


def test_scan_equals_plain_scan(spark):
    rng = random.Random(4)
    texts = [None, "", "\n ", "MIT license", "the MIT-License, mit license", "mit licenses", "GNU General\nPublic License, version 3; licensed under the General Public license version 3.",
             "Licensed under the Apache License, Version 2.0.", "lIcenSed under the Äpache license", "released under the terms of the MIT license", "permission is hereby granted",
             "İ ſ K mit license", "word " * 200_000 + "mit license"]
    for markup in licenses.TEMPLATES.values():
        for _ in range(4):
            full = wording(licenses.parse(markup), rng)
            texts += ["x, " + " ".join(full).title() + "! y", " ".join(full[: len(full) // 2] + ["not"] + full[len(full) // 2 :])]
    rows = [(i if i % 7 else None, t, None, None, None) for i, t in enumerate(texts)] + [(3, "MIT license", "en", "s", 1)] * 2
    docs = spark.createDataFrame(rows, DOCS).withColumn("labels", F.lit("x")).withColumn("id", F.lit(1)).repartition(3)
    got = sorted((tuple(r) for r in licenses.op11_licenses(docs).collect()), key=str)
    assert got == sorted(((r[0], *plain(r[1])) for r in rows), key=str)
    assert licenses.op11_licenses(spark.createDataFrame([], DOCS)).count() == 0
    with pytest.raises(ValueError):
        licenses.scan_licenses(docs, {"mit": "a b"})
