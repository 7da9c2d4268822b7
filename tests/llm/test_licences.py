"""Licence notices against a comparison of every stretch with every template."""

import random
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

from themeloom.llm import licences as lc
from themeloom.llm import queries

WORDS = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def bigrams(text):
    w = WORDS.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text))
    return Counter(zip(w, w[1:]))


THEIRS = [(name, bigrams(t)) for name, t in lc.TEMPLATES]


def best(text):
    own = bigrams(text)
    scores = [(2 * sum((own & b).values()) / max(1, sum(own.values()) + sum(b.values())), name) for name, b in THEIRS]
    top = max(s for s, _ in scores)
    return (top, min(n for s, n in scores if s == top)) if top >= lc.LEAST else None


def brute(text):
    """Best coefficient over all stretches."""
    found = [best(text)]
    for pattern in (r"\n(?<=\n\n)", r"\n", r"\n|(?<=[.!?]) "):
        found += [best(part) for part in re.split(pattern, text)]
    return max((f for f in found if f), default=None, key=lambda f: f[0])


def test_query(spark, folder):
    texts = {r["doc_id"]: r["text"] for r in queries.table(spark, folder, "documents").collect()}
    rows = queries.op10_licences(spark, folder).collect()
    assert len(rows) == len(texts) and any(r["n_notices"] for r in rows)
    for r in rows:
        want = brute(texts[r["doc_id"]] or "")
        assert (r["best_dice"] is None) == (want is None)
        if want:
            assert abs(r["best_dice"] - want[0]) < 1e-12


def test_templates_find_themselves():
    for name, text in lc.TEMPLATES:
        for shown in (text, text.upper(), "Some words before.\n\n" + text + "\n\nAnd after."):
            found = lc.scan(pa.array([shown]), lc.Templates(lc.TEMPLATES, lc.LEAST))[0]
            assert name in {f["licence"] for f in found}, shown


def test_near_and_far():
    own = lc.Templates(lc.TEMPLATES, lc.LEAST)
    mit = next(t for n, t in lc.TEMPLATES if n == "MIT" and len(t) > 100)
    near = lc.scan(pa.array([mit.replace("free of charge", "at no charge")]), own)[0]
    assert near and near[0]["licence"] == "MIT" and 0.85 <= near[0]["dice"] < 1
    assert lc.scan(pa.array(["Released under the sea. Licensed plumbers work here."]), own)[0] == []


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "mit"), (4, "x y " * 40000 + ". Released under the MIT License."), (5, "Released under the MIT License. " * 3)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, licence int")
    got = {r["doc_id"]: r["f"] for r in docs.select("doc_id", lc.licences(F.col("text")).alias("f")).collect()}
    assert [len(got[i]) for i in range(1, 6)] == [0, 0, 0, 1, 3]
    assert got[4][0]["word"] == 80000 and got[4][0]["words"] == 5
    assert docs.limit(0).select(lc.licences(F.col("text"))).collect() == []


def every_window(text):
    """The rule over all windows of a text: by coefficient, length, place and name, without overlap."""
    w = WORDS.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text))
    pairs, found = list(zip(w, w[1:])), []
    for name, b in THEIRS:
        size = sum(b.values())
        for i in range(len(pairs)):
            own, common = Counter(), 0
            for j in range(i, min(len(pairs), i + 2 * size)):
                own[pairs[j]] += 1
                common += own[pairs[j]] <= b[pairs[j]]
                dice = 2 * common / (j - i + 1 + size)
                if dice >= lc.LEAST:
                    found.append((-dice, i - j, i, name, j + 2))
    kept = []
    for dice, _, i, name, end in sorted(found):
        if not any(i < y and x < end for x, y, *_ in kept):
            kept.append((i, end, name, -dice))
    return sorted(kept)


def scanned(texts):
    found = lc.scan(pa.array(texts), lc.Templates(lc.TEMPLATES, lc.LEAST))
    return [[(f["word"], f["word"] + f["words"], f["licence"], f["dice"]) for f in own] for own in found]


def test_every_window():
    rng = random.Random(5)
    texts = ["released", "under the MIT License", ""]
    for _ in range(60):
        words = []
        for _ in range(rng.randrange(1, 4)):
            words += rng.choices(["the", "license", "under", "of", "software", "zebra", "mit"], k=rng.randrange(12))
            own = rng.choice(lc.TEMPLATES)[1].split()
            for _ in range(rng.randrange(4)):
                own[rng.randrange(len(own))] = rng.choice(["the", "software", "sea"])
            words += own[: rng.randrange(len(own) // 2, len(own) + 1)]
        texts.append("".join(x + rng.choice([" ", " ", "\n"]) for x in words))
    assert scanned(texts) == [every_window(t) for t in texts]


def test_notices_inside_larger_stretches():
    gpl, mpl, bsd = (next(t for n, t in lc.TEMPLATES if n == name) for name in ("GPL-3.0", "MPL-2.0", "BSD-3-Clause"))
    header = "".join(f"# {' '.join(gpl.split()[k : k + 9])}\n" for k in range(0, len(gpl.split()), 9))
    texts = [
        header + "#\n# This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even\n# the implied warranty.",
        f"Here one more word or two go first and {mpl} Then others follow it without any line break at all, as long as it",
        re.sub(r" (?=[123]\. )", "\n\n", bsd) + "\n\nTHIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS",
        "This project is released under the MIT License and welcomes whatever help.",
    ]
    assert [[f[2] for f in own] for own in scanned(texts)] == [["GPL-3.0"], ["MPL-2.0"], ["BSD-3-Clause"], ["MIT"]]
    assert all(f[3] == 1 for own in scanned(texts) for f in own)


def test_names_of_like_notices():
    """Headers whose texts differ in a few words are found under their own names, with the warranty that follows them."""
    header = "{0} is free software{1} you can redistribute it and/or modify it under the terms of the GNU {2}General Public License as published by the Free Software Foundation{3} either version {4} of the License, or (at your option) any later version."
    rest = " It is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY. See the GNU {0}General Public License for more details."
    for kind, library, marks, version in (
        ("GPL", "", (";", ";"), "2"), ("GPL", "", (":", ","), "3"), ("LGPL", "Lesser ", (";", ";"), "2.1"), ("LGPL", "Lesser ", (":", ","), "3"), ("AGPL", "Affero ", (":", ","), "3"),
    ):
        name = f"{kind}-{version}" + ("" if "." in version else ".0")
        for subject in ("This program", "This library" if library == "Lesser " else "This program"):
            text = header.format(subject, marks[0], library, marks[1], version)
            for own in (text, text + rest.format(library), "/* words before\n * " + text.replace(" modify", "\n * modify") + " */"):
                assert {x[2] for x in scanned([own])[0]} == {name}, own
    assert len({name for name, _ in lc.TEMPLATES}) >= 19
