"""Byte-level BPE with vectorised pre-tokenisation.

Texts are arrays of codepoint classes. Each class is a function from state to state of a small
automaton that knows where a match of the splitting pattern begins; functions are composed within
blocks, block functions by doubling, and the states then read off, so that no regular expression
runs. The slices between boundaries go through a remembered pair merging.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import unicodedata
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelsight.llm.shared import bounded_batches, held

#: Code points of Unicode's White_Space property.
WHITE_SPACE = [
    *range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F,
    0x205F, 0x3000]
LETTER, NUMBER, OTHER, BLANK, SPACE = range(5)
#: Symbols of the automaton: letter, number, other, apostrophe before one or two letters of a
#: contraction, a blank that joins the next match, a white space that ends a run before a match,
#: any other white space, and the gap between two texts.
SYMBOLS = L, N, P, SHORT, LONG, JOIN, LAST, WHITE, GAP = range(9)
#: States: between matches, in a run of letters, numbers, others or white space, behind a joining
#: blank, and with one or two letters of a contraction to come.
STATES = FREE, IN_L, IN_N, IN_P, IN_WHITE, JOINED, ONE, TWO = range(8)
WIDTH = 64
#: Slices that a Python worker remembers; beyond that it begins anew.
CACHE_SLICES = 400_000
#: Bytes of a slice whose pairs are searched one by one.
SHORT_SLICE = 48
#: Code points that are split at once.
BATCH = 1 << 17


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """(next state, whether a match begins) by symbol and state."""
    to, begins = np.zeros((9, 8), np.uint8), np.ones((9, 8), bool)
    for symbol, run in ((L, IN_L), (N, IN_N), (P, IN_P), (WHITE, IN_WHITE)):
        to[symbol] = run
        begins[symbol, run] = False
    for symbol in (L, N, P, SHORT, LONG):
        begins[symbol, JOINED] = False
    to[L, ONE], to[L, TWO], begins[L, ONE], begins[L, TWO] = FREE, ONE, False, False
    for symbol, run in ((SHORT, ONE), (LONG, TWO)):
        to[symbol] = run
        to[symbol, [IN_P, JOINED]] = IN_P
        begins[symbol, IN_P] = False
    to[JOIN] = JOINED
    return to, begins


TO, BEGINS = _automaton()


@cache
def _classes() -> np.ndarray:
    # `regex` knows newer letters; above the first planes, those that tiktoken doesn't know yet
    low = "".join(chr(c) for c in range(0x20000) if not 0xD800 <= c < 0xE000)
    table = np.full(0x110000, OTHER, np.uint8)
    for kind, name in ((LETTER, "L"), (NUMBER, "N")):
        table[[ord(c) for c in regex.findall(rf"\p{{{name}}}", low)]] = kind
        table[[c for c in range(0x20000, 0x110000)
               if unicodedata.category(chr(c))[0] == name]] = kind
    table[WHITE_SPACE] = SPACE
    table[0x20] = BLANK
    return table


def _symbols(points: np.ndarray, gaps: np.ndarray) -> np.ndarray:
    kind = _classes()[points]
    out = np.array([L, N, P, WHITE, WHITE], np.uint8)[kind]
    out[gaps] = GAP
    white = out == WHITE
    ends = white & np.append(~white[1:] & (out[1:] != GAP), False)
    out[ends & (kind == BLANK)] = JOIN
    out[ends & (kind == SPACE)] = LAST
    at = np.flatnonzero((points == 39) & (out == P))
    one = points[np.minimum(at + 1, len(points) - 1)]
    two = points[np.minimum(at + 2, len(points) - 1)]
    out[at[np.isin(one, [ord(c) for c in "stmd"])]] = SHORT
    for a, b in ("re", "ve", "ll"):
        out[at[(one == ord(a)) & (two == ord(b))]] = LONG
    return out


def begins(points: np.ndarray, gaps: np.ndarray) -> np.ndarray:
    """Where matches begin in texts laid end to end, ``gaps`` being the places between them."""
    n = len(points)
    symbols = np.full(-(-n // WIDTH) * WIDTH, GAP, np.uint8)
    symbols[:n] = _symbols(points, gaps)
    symbols = symbols.reshape(-1, WIDTH)
    block = np.tile(np.arange(8, dtype=np.uint8), (len(symbols), 1))
    for j in range(WIDTH):
        block = TO[symbols[:, j, None], block]
    step = 1
    while step < len(block):  # block[i] becomes the composition of blocks 0 to i
        block[step:] = np.take_along_axis(block[step:], block[:-step], 1)
        step *= 2
    state = np.concatenate(([FREE], block[:-1, FREE])).astype(np.uint8)
    found = np.empty(symbols.shape, bool)
    for j in range(WIDTH):
        found[:, j] = BEGINS[symbols[:, j], state]
        state = TO[symbols[:, j], state]
    return np.flatnonzero(found.reshape(-1)[:n])


def slices(texts: list[str]) -> Iterator[list[str]]:
    """The matches of the splitting pattern in each text."""
    at = 0
    while at < len(texts):
        end, size = at + 1, len(texts[at])
        while end < len(texts) and size + len(texts[end]) <= BATCH:
            size += len(texts[end])
            end += 1
        joined = "\0".join(texts[at:end]) + "\0"
        gaps = np.cumsum([len(t) + 1 for t in texts[at:end]]) - 1
        cuts = begins(np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32), gaps)
        where = np.searchsorted(cuts, gaps)
        cuts = cuts.tolist()
        first = 0
        for k in where.tolist():
            yield [joined[a:b] for a, b in zip(cuts[first:k], cuts[first + 1:k + 1], strict=True)]
            first = k + 1
        at = end


class BytePairs:
    """Encoder and decoder over a file of ranks (a token in base64 and its rank in each line)."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.decimal = [str(i) for i in range(len(self.tokens))]
        self.known: dict[str, tuple[int, ...]] = {}

    def merged(self, piece: bytes) -> tuple[int, ...]:
        """Ids of one slice: the adjacent pair of least rank is merged, leftmost first."""
        ranks = self.ranks
        if piece in ranks:
            return (ranks[piece],)
        if len(piece) <= SHORT_SLICE:
            return self._merged_short(piece)
        start, end = list(range(len(piece))), list(range(1, len(piece) + 1))  # parts by their start
        after, before = end[:], [i - 1 for i in start]
        heap = [(r, i, i + 2) for i in range(len(piece) - 1)
                if (r := ranks.get(piece[i:i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = after[i] if end[i] > 0 else len(piece)
            if j >= len(piece) or end[j] != stop:  # one of the parts has been merged meanwhile
                continue
            end[i], after[i], end[j] = stop, after[j], -1
            if after[i] < len(piece):
                before[after[i]] = i
                if (r := ranks.get(piece[i:end[after[i]]])) is not None:
                    heapq.heappush(heap, (r, i, end[after[i]]))
            if before[i] >= 0 and (r := ranks.get(piece[before[i]:stop])) is not None:
                heapq.heappush(heap, (r, before[i], stop))
        return tuple(ranks[piece[i:end[i]]] for i in start if end[i] > 0)

    def _merged_short(self, piece: bytes) -> tuple[int, ...]:
        """As ``merged``, with the pairs in a plain list: quicker than a heap for a word."""
        get, none = self.ranks.get, len(self.tokens)
        parts = [piece[i:i + 1] for i in range(len(piece))]
        pairs = [get(piece[i:i + 2], none) for i in range(len(piece) - 1)]
        while pairs and (least := min(pairs)) != none:
            i = pairs.index(least)
            parts[i] += parts.pop(i + 1)
            del pairs[i]
            if i < len(pairs):
                pairs[i] = get(parts[i] + parts[i + 1], none)
            if i:
                pairs[i - 1] = get(parts[i - 1] + parts[i], none)
        return tuple(map(self.ranks.__getitem__, parts))

    def encode(self, texts: list[str]) -> Iterator[list[int]]:
        """Ids of whole texts, without special tokens."""
        known = self.known
        for parts in slices(texts):
            if len(known) > CACHE_SLICES:
                known.clear()
            for new in {p for p in parts if p not in known}:
                known[new] = self.merged(new.encode("utf-8", "surrogatepass"))
            yield list(chain.from_iterable(map(known.__getitem__, parts)))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def offsets(self, ids: list[int]) -> np.ndarray:
        """Where each token begins in the decoded bytes, and where the last one ends."""
        return np.concatenate(([0], np.cumsum([len(self.tokens[i]) for i in ids], dtype=np.int64)))


def byte_pairs(path: str) -> BytePairs:
    """The coder of a Python worker, kept from task to task, but not beside other operators."""
    return held(("byte pairs", path), lambda: BytePairs(path))


def encode(docs: DataFrame, ranks: str, text: str = "text") -> Column:
    """A column of struct(ids array<int>, offsets array<long>) of every whole text of ``docs``."""
    @F.pandas_udf("ids array<int>, offsets array<long>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        coder = byte_pairs(ranks)
        for texts in batches:
            ids = list(coder.encode([t or "" for t in texts]))
            yield pd.DataFrame({"ids": ids, "offsets": [coder.offsets(i) for i in ids]})
    return run(F.col(text))


def decode(ranks: str, ids: str = "ids") -> Column:
    """A column of the bytes of ids (null: null)."""
    @F.pandas_udf("binary")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        coder = byte_pairs(ranks)
        for rows in batches:
            yield rows.map(lambda i: None if i is None else coder.decode(i))
    return run(F.col(ids))


def digests(docs: DataFrame, ranks: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row of ``docs``.

    Null and empty texts have no token; repeated rows are encoded each, further columns left out.
    """
    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        coder = byte_pairs(ranks)
        for texts in batches:
            rows = []
            for ids in coder.encode([t or "" for t in texts]):
                listed = ",".join(map(coder.decimal.__getitem__, ids))
                rows.append((len(ids), hashlib.sha256(listed.encode()).hexdigest(),
                             hashlib.sha256(coder.decode(ids)).hexdigest()))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    bounded_batches(docs.sparkSession)
    return docs.select(F.col(doc_id).alias("doc_id"), run(text).alias("coded")).select(
        "doc_id", "coded.*")
