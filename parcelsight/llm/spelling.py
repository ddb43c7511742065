"""Spelling variants: exact neighbours at one edit by a dictionary of pairs of trie nodes.

Words are the distinct runs of letters of a corpus. The nodes of the trie of all words, and of the
trie of all reversed words, are numbered. A word without its position i is the pair (node of what
comes before i, node of what comes after), a word cut at i the pair (before i, from i on). Words
that share a pair by leaving a position out differ in that letter only; a word cut where another
one leaves a letter out lacks that letter. So pairs of whole numbers meet, no letters, and the
words of a pair are at most one more than there are letters.

The tries are numbered in parallel. Sampled words cut the sorted dictionary into intervals. A
prefix that occurs in two intervals is a prefix of the cutting word between them, and every task
numbers the prefixes of the cutting words alike; all other prefixes lie in one interval and are
numbered there.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parcelsight.llm.shared import bounded_batches, written

#: Code points of a word, occurrences, and how much more often a form occurs than its variant.
LEAST_LENGTH, LEAST_COUNT, RATIO = 7, 2, 10
#: One in so many occurrences loses a letter.
LOSSES = 31
RUN = re.compile("[A-Za-zÀ-ÿ]{%d,}" % LEAST_LENGTH)
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Letters in an interval of the dictionary, about; sampled words for each interval.
INTERVAL_LETTERS, SAMPLED = 2_000_000, 16
#: Words that a task counts before it passes its counts on.
HELD_WORDS = 300_000
#: Numbers of an interval's nodes and words lie this far from those of the next.
STRIDE = 1 << 36


def occurrences(doc_id: str | None, text: str | None) -> dict[str, int]:
    """Word -> occurrences in one text, runs losing a letter where the checksum says so."""
    runs: dict[str, int] = {}
    for run in RUN.findall((text or "").translate(LOWER)):
        runs[run] = runs.get(run, 0) + 1
    words: dict[str, int] = {}
    # a checksum goes on from that of what comes before
    start = zlib.crc32(f"{doc_id or ''}:".encode())
    for run, n in runs.items():
        h = zlib.crc32(run.encode(), start)
        if h % LOSSES == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1:]
            if len(run) < LEAST_LENGTH:
                continue
        words[run] = words.get(run, 0) + n
    return words


def dictionary(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n): the words of all texts that occur often enough."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, int] = {}
        for batch in batches:
            for i, t in zip(batch["doc_id"], batch["text"]):
                for w, n in occurrences(i, t).items():
                    held[w] = held.get(w, 0) + n
                if len(held) > HELD_WORDS:
                    yield pd.DataFrame({"word": list(held), "n": list(held.values())})
                    held = {}
        if held:
            yield pd.DataFrame({"word": list(held), "n": list(held.values())})

    bounded_batches(docs.sparkSession)
    source = docs.select(F.col(doc_id).cast("string").alias("doc_id"), F.col(text).alias("text"))
    counts = source.mapInPandas(count, "word string, n long")
    return (counts.groupBy("word").agg(F.sum("n").cast("long").alias("n"))
            .where(F.col("n") >= LEAST_COUNT))


def shared_letters(a: str, b: str) -> int:
    """How many letters two words have in common at the beginning."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n  # a[:lo] is shared, a[:hi] isn't
    while hi - lo > 1:
        m = (lo + hi) // 2
        lo, hi = (m, hi) if a[lo:m] == b[lo:m] else (lo, m)
    return lo


def paths(words: list[str], first: int, known: dict[str, list[int]] | None = None
          ) -> Iterator[list[int]]:
    """For each of the sorted ``words`` the numbers of its nodes, of 0, 1, 2, … letters.

    Nodes are numbered from ``first`` on as they are met; prefixes of the ``known`` sorted words
    have the numbers given there.
    """
    cuts = list(known or ())
    word, path = "", None
    for w in words:
        at = bisect_right(cuts, w)
        path_of_w: list[int] | None = None
        taken = 0
        for c in cuts[max(0, at - 1):at + 1]:  # the neighbours share the longest prefixes
            k = shared_letters(c, w)
            if path_of_w is None or k > taken:
                taken, path_of_w = k, known[c][:k + 1]
        k = shared_letters(word, w) if path else 0
        if path and (path_of_w is None or k > taken):
            path_of_w = path[:k + 1]
        new = path_of_w or []
        more = len(w) + 1 - len(new)
        path = new + list(range(first, first + more))
        first += more
        word = w
        yield path


def _known(cuts: list[str]) -> dict[str, list[int]]:
    """Numbers of the nodes of the cutting words: below zero, the same in every task."""
    return {c: [-1 - x for x in p] for c, p in zip(cuts, paths(cuts, 0))} if cuts else {"": [-1]}


def _cuts(words: DataFrame, column: str, intervals: int) -> list[str]:
    """Sorted words that cut the dictionary into about equal intervals."""
    if intervals < 2:
        return []
    sample = sorted(r[0] for r in words.select(column).orderBy(F.xxhash64(column), column).limit(
        intervals * SAMPLED).collect())  # a few words an interval
    return sample[SAMPLED::SAMPLED]


def _numbered(words: DataFrame, column: str, intervals: int, name: str) -> DataFrame:
    """(id, ``name``, again): the nodes that each word's ``column`` passes, and for each of its
    letters whether it equals the letter before."""
    cuts = _cuts(words, column, intervals)
    sent = words.sparkSession.sparkContext.broadcast((cuts, _known(cuts)))

    @F.pandas_udf("int")
    def interval(batch: pd.Series) -> pd.Series:
        return pd.Series([bisect_right(sent.value[0], w) for w in batch], dtype="int32")

    def number(batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.sort_values(column, ignore_index=True)
        first = int(batch["interval"].iloc[0]) * STRIDE
        points = [np.frombuffer(w.encode("utf-32-le"), np.uint32) for w in batch[column]]
        return pd.DataFrame({
            "id": batch["id"],
            name: [np.array(p, np.int64)
                   for p in paths(batch[column].tolist(), first, sent.value[1])],
            "again": [np.append(False, c[1:] == c[:-1]) for c in points]})

    return words.select("id", column, interval(column).alias("interval")).groupBy(
        "interval").applyInPandas(number, f"id long, {name} array<long>, again array<boolean>")


#: A pair is of a word cut there, of one that leaves a letter out, or of one that leaves out the
#: first of equal neighbouring letters. Any of these gives the same shorter word, so only the
#: first one meets the word that lacks it.
CUT, REPEATED, FIRST = 0, 1, 2


def _pairs(words: DataFrame) -> DataFrame:
    """(p, s, id, kind): every pair of nodes of every word (id, before, after, again)."""
    letters = F.size("again")
    cut = F.transform("before", lambda p, i: F.struct(
        p.alias("p"), F.get("after", letters - i).alias("s"), F.lit(CUT).alias("kind")))
    left_out = F.transform("again", lambda again, i: F.struct(
        F.get("before", i).alias("p"), F.get("after", letters - 1 - i).alias("s"),
        F.when(again, REPEATED).otherwise(FIRST).alias("kind")))
    return words.select("id", F.explode(F.concat(cut, left_out)).alias("pair")).select(
        "pair.p", "pair.s", "id", "pair.kind")


def _neighbours(pairs: DataFrame) -> DataFrame:
    """(id, n_near, best): how many near words, and the first of them by number.

    A pair has one cut word at most and as many others as there are letters. The word itself may
    be its first: it then is the most frequent of the pair and no form comes of that.
    """
    met = Window.partitionBy("p", "s")
    kind, left_out = F.col("kind"), F.col("kind") != CUT
    seen = pairs.select(
        "id", "kind",
        F.max(F.when(kind == CUT, F.col("id"))).over(met).alias("cut"),
        F.count_if(left_out).over(met).alias("others"),
        F.count_if(kind == FIRST).over(met).alias("firsts"),
        F.min(F.when(left_out, F.col("id"))).over(met).alias("best"),
        F.min(F.when(kind == FIRST, F.col("id"))).over(met).alias("best_first"))
    lacking = F.when(kind == FIRST, F.col("cut"))
    return (
        seen.select(
            "id", F.when(kind == CUT, F.col("firsts")).otherwise(
                F.col("others") - 1 + lacking.isNotNull().cast("int")).alias("k"),
            F.when(kind == CUT, F.col("best_first")).otherwise(
                F.least("best", lacking)).alias("best"))
        .where("k > 0").groupBy("id").agg(F.sum("k").alias("n_near"), F.min("best").alias("best")))


def _roots(forms: DataFrame) -> DataFrame:
    """(id, root_id): where the chain of forms ends, by doubling; they grow tenfold at each step."""
    chain = written(forms.where("form_id IS NOT NULL").select(
        "id", F.col("form_id").alias("root_id")), "roots")
    while True:
        on = chain.select(F.col("id").alias("root_id"), F.col("root_id").alias("next"))
        further = written(chain.join(on, "root_id", "left").select(
            "id", F.coalesce("next", "root_id").alias("root_id"),
            F.col("next").isNotNull().alias("moved")), "roots")
        if further.where("moved").isEmpty():
            return chain
        chain = further.drop("moved")


def group(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of ``docs``.

    Words are near if one edit apart. A word's form is its near word of most occurrences (ties:
    the first in code-point order) if that occurs ten times as often, and its root the last of
    the chain of forms. Null and empty texts have no words; a null id counts as an empty one in
    the checksum, and rows repeated count each. No texts: no rows. Further columns are left out.
    """
    counted = written(dictionary(docs, doc_id, text), "counts")
    # numbers fall with the occurrences and rise in code-point order: the smallest is the best
    words = written(counted.orderBy(F.desc("n"), "word").select(
        F.monotonically_increasing_id().alias("id"), "word", "n",
        F.reverse("word").alias("reversed")), "words")
    letters = words.agg(F.sum(F.length("word"))).first()[0] or 0
    intervals = -(-letters // INTERVAL_LETTERS)
    nodes = _numbered(words, "word", intervals, "before").join(
        _numbered(words, "reversed", intervals, "after").drop("again"), "id")
    near = written(_neighbours(_pairs(nodes)), "near")
    best = words.select(F.col("id").alias("best"), F.col("word").alias("best_word"),
                        F.col("n").alias("best_n"))
    ten_times = F.col("best_n") >= RATIO * F.col("n")
    known = written(
        words.select("id", "word", "n").join(near, "id", "left").join(best, "best", "left")
        .select("id", "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
                F.when(ten_times, F.col("best")).alias("form_id"),
                F.when(ten_times, F.col("best_word")).alias("form"),
                F.when(ten_times, F.col("best_n")).alias("form_n")), "forms")
    roots = _roots(known).join(
        words.select(F.col("id").alias("root_id"), F.col("word").alias("root_word")), "root_id")
    return known.join(roots.select("id", "root_word"), "id", "left").select(
        "word", "form", F.coalesce("root_word", "word").alias("root"), "n", "n_near", "form_n")
