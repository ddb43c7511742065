"""Neighbours, forms and roots against brute force; the SQL; edge cases."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from compare import check_connection, difference
from parcelsight.llm import spelling
from parcelsight.llm.oracles import ORACLES
from parcelsight.llm.queries import op13_spelling

SCHEMA = "doc_id long, text string"


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(texts):
    """word -> (form, root, n, n_near, form_n) by comparing all words with all."""
    counts = collections.Counter()
    for i, t in texts:
        counts.update(spelling.occurrences(None if i is None else str(i), t))
    words = {w: n for w, n in counts.items() if n >= 2}
    partners = {w: [u for u in words if near(w, u)] for w in words}
    forms = {}
    for w, n in words.items():
        best = min(partners[w], key=lambda u: (-words[u], u), default=None)
        forms[w] = best if best and words[best] >= 10 * n else None
    out = {}
    for w, n in words.items():
        root = w
        while forms[root]:
            root = forms[root]
        out[w] = (forms[w], root, n, len(partners[w]), words.get(forms[w]))
    return out


def found(frame):
    rows = spelling.group(frame).collect()
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(got) == len(rows)
    return got


@pytest.fixture(scope="module")
def texts():
    """Words of few letters in runs, so that many are near, with very unequal counts."""
    rng = random.Random(5)
    base = ["".join(rng.choice("abÀ") for _ in range(rng.randint(7, 9))) for _ in range(60)]
    base += ["aaaaaaa", "aaaaaaaa", "aaaaaaab", "aabaaaa", "aabbaaaa", "A" * 3000, "a" * 3001]
    out = []
    for k in range(250):
        words = [rng.choice(base[:1 + int(len(base) * rng.random() ** 3)]) for _ in range(40)]
        out.append((k, " ".join(words) + " short, 12 ok!"))
    return out + [(None, out[0][1]), (7, None), (8, ""), (9, "..."), (3, out[3][1])]


@pytest.mark.parametrize("letters", [10**6, 150])
def test_against_brute_force(spark, texts, monkeypatch, letters):
    monkeypatch.setattr(spelling, "INTERVAL_LETTERS", letters)  # one interval, and many
    frame = spark.createDataFrame(texts, SCHEMA).withColumn("word", F.lit("x")).withColumn(
        "id", F.lit(1)).repartition(5)
    want = brute(texts)
    assert len(want) > 60 and any(f for f, *_ in want.values())
    assert found(frame) == want


def test_chains_and_ties(spark):
    text = " ".join(["gardening"] * 1000 + ["gardenin"] * 90 + ["gardeni"] * 3
                    + ["gbrdenin"] * 90 + ["gardenix"] * 2)
    # an id that takes no letter from these words
    clean = next(i for i in range(10_000) if set(spelling.occurrences(str(i), text)) == set(text.split()))
    got = found(spark.createDataFrame([(clean, text)], SCHEMA))
    assert got == brute([(clean, text)])
    assert got["gardeni"][:2] == ("gardenin", "gardening")
    assert got["gardenix"][:2] == ("gardenin", "gardening")
    assert got["gbrdenin"][0] is None


def test_sql(spark, folder):
    assert difference(op13_spelling(spark, folder), check_connection(folder),
                      ORACLES["op13_spelling"]) is None


def test_no_words(spark):
    assert spelling.group(spark.createDataFrame([], SCHEMA)).count() == 0
    assert spelling.group(spark.createDataFrame([(1, None), (2, "a few short words")], SCHEMA)).count() == 0


def test_paths_number_prefixes_alike_in_all_intervals():
    rng = random.Random(1)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(1, 12))) for _ in range(400)})
    cuts = words[40::60]
    known = spelling._known(cuts)
    numbers = {}
    for k, bounds in enumerate(zip([0, *[words.index(c) for c in cuts]],
                                   [*[words.index(c) for c in cuts], len(words)])):
        part = words[slice(*bounds)]
        for w, path in zip(part, spelling.paths(part, (k + 1) << 20, known)):
            for i, node in enumerate(path):
                assert numbers.setdefault(w[:i], node) == node
    assert len(set(numbers.values())) == len(numbers)
