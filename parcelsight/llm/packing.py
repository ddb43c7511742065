"""Packing by power-of-two decomposition: every piece of a document is a sequence of its own.

A document's ids are cut into full sequences of ``LONGEST`` and the binary digits of the rest, so
every sequence has a power of two of ids, none holds padding and none crosses documents. Sequences
of equal length are batched from the same bucket.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelsight.llm.shared import bounded_batches, held

LONGEST = 4096
END_ID = 2
#: Bytes that a Python worker remembers words and their ids in, about; beyond them it begins anew.
#: Twice as many spare a third of the work where a worker's memory allows it.
CACHE_BYTES = 48 << 20
#: Texts and characters that a Python worker encodes at once, one text at least. What it needs beside the
#: remembered words grows with them: 111 MB were measured with whole batches, 46 MB with 2**18 characters.
SLICE_TEXTS = 1024
SLICE_CHARS = 1 << 22
#: Bytes of a remembered word beside its letters and ids.
ENTRY_BYTES = 160
#: Words that the tokenizer gets at once.
GROUP = 200
#: Punctuation that is looked up on its own at the end of a word.
TAIL = ".,:;!?%$#&*()\""


def _ends_plainly(word: str) -> bool:
    """Whether the last character is a letter or digit and stays one when it is normalised."""
    last = word[-1:]
    return last.isalnum() and (
        last.isascii() or unicodedata.normalize("NFC", last).lower()[-1].isalnum())


class WordEncoder:
    """Ids of texts by a tokenizer that never joins words over a blank or a line end.

    Each distinct word stem is given to the tokenizer once; ids are remembered as bytes.
    """

    def __init__(self, path: str, cache_bytes: int = CACHE_BYTES):
        self.cache_bytes = cache_bytes
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        #: Tokens that are looked for in the text as it stands, before letter case is dropped.
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, special)) or r"(?!)", re.I)
        self.special_words = any(t.isalnum() for t in special)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that end a run of letters
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {}
        self.bytes = 0

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of whole texts."""
        words = [t.replace("\n", " ").split(" ") for t in texts]
        if self.bytes > self.cache_bytes:
            self.known.clear()
            self.bytes = 0
        self._learn(set().union(*words).difference(self.known))
        return [b"".join(map(self.known.__getitem__, ws)) for ws in words]

    def _learn(self, new: set[str]) -> None:
        """Remember words by their stems: ASCII in lower case, without punctuation at the end.

        Punctuation behind a letter or digit is always split off, and letter case is dropped.
        """
        known, special = self.known, self.special
        stems, lower = {}, {}
        for w in new:
            s = w.rstrip(TAIL)
            if s.isascii() and s.isalpha() and not self.special_words:
                lower[s] = s.lower()
            else:
                if not _ends_plainly(s):
                    s = w
                ordinary = not self.special_words and s.isalnum() or not special.search(s)
                lower[s] = s.lower() if s.isascii() and ordinary else s
            stems[w] = s
        tails = {w[len(s):] for w, s in stems.items() if len(s) < len(w)}
        wanted = set(lower.values()).union(tails).difference(known)
        plain = [s for s in wanted if s.isalpha()]
        self._learn_each([s for s in wanted if not s.isalpha()])
        groups = [plain[k:k + GROUP] for k in range(0, len(plain), GROUP)]
        found = self.tokenizer.encode_batch_fast([" ".join(g) for g in groups],
                                                 add_special_tokens=False)
        for group, e in zip(groups, found, strict=True):
            ids = np.asarray(e.ids, "<u4")
            cuts = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            if len(cuts) != len(group):  # some letters come apart when they are normalised
                self._learn_each(group)
                continue
            data = ids.tobytes()
            known.update(zip(group, map(data.__getitem__, map(slice, [0, *cuts], cuts)),
                             strict=True))
        known.update({w: known[lower[s]] + known[w[len(s):]] if len(s) < len(w) else known[lower[s]]
                      for w, s in stems.items()})
        self.bytes += 2 * ENTRY_BYTES * len(new) + 4 * sum(map(len, new))

    def _learn_each(self, words: list[str]) -> None:
        for w, e in zip(words, self.tokenizer.encode_batch_fast(words, add_special_tokens=False),
                        strict=True):
            self.known[w] = np.asarray(e.ids, "<u4").tobytes()


def word_encoder(path: str, cache_bytes: int) -> WordEncoder:
    """The encoder of a Python worker, kept from task to task, but not beside other operators."""
    return held(("words", path, cache_bytes), lambda: WordEncoder(path, cache_bytes))


def slices(texts: list[str], chars: int) -> Iterator[list[str]]:
    """The texts in their order, in lists of at most ``SLICE_TEXTS`` texts and ``chars`` characters.

    A longer text is a list of its own.
    """
    part, size = [], 0
    for t in texts:
        if part and (len(part) == SLICE_TEXTS or size + len(t) > chars):
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t)
    if part:
        yield part


def pieces(n: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids, longest first."""
    out = [(s, LONGEST) for s in range(0, n - LONGEST + 1, LONGEST)]
    at, left = len(out) * LONGEST, n % LONGEST
    while left:
        size = 1 << (left.bit_length() - 1)
        out.append((at, size))
        at, left = at + size, left - size
    return out


def pack(docs: DataFrame, tokenizer: str, with_ids: bool = True, doc_id: str = "doc_id",
         text: str = "text", cache_bytes: int = CACHE_BYTES,
         slice_chars: int = SLICE_CHARS) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids.

    A null or empty text is a piece of one id, the end of the document; repeated rows are packed
    each. ``sequence_id`` is unique; ``length`` is the bucket. No rows: no pieces. Further
    columns are left out. ``ids`` (array<int>) is left out unless asked for.
    """
    bounded_batches(docs.sparkSession)
    kind = "start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids

    @F.pandas_udf(f"array<struct<{kind.replace(' ', ':').replace(',:', ',')}>>")
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder, end = word_encoder(tokenizer, cache_bytes), np.asarray([END_ID], "<u4").tobytes()
        for texts in batches:
            out = []
            for some in slices([t or "" for t in texts], slice_chars):
                for ids in encoder.encode(some):
                    ids += end
                    n, row = len(ids) // 4, []
                    for start, size in pieces(n):
                        part = ids[4 * start:4 * (start + size)]
                        row.append({"start": start, "length": size, "ids_crc32": zlib.crc32(part),
                                    "doc_tokens": n})
                        if with_ids:
                            row[-1]["ids"] = np.frombuffer(part, "<u4").astype(np.int32)
                    out.append(row)
            yield pd.Series(out)

    # numbered where the pieces are made: a task that is run again numbers them alike
    return (
        docs.select(F.col(doc_id).alias("doc_id"), cut(text).alias("pieces"))
        # every row has a piece; a plain explode would add a filter that runs the function again
        .select("doc_id", F.explode_outer("pieces").alias("piece"))
        .select("doc_id", "piece.*", F.monotonically_increasing_id().alias("sequence_id"),
                F.lit(0).cast("long").alias("offset")))


def write_buckets(packed: DataFrame, path: str) -> None:
    """Sequences as Parquet, in one folder for each length; a length has files from many tasks."""
    packed.write.partitionBy("length").parquet(path)
