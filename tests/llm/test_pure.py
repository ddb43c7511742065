"""Brute-force comparisons of what runs inside tasks."""

import base64
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from parcelsight.llm import bpe, langid, minhash, packing, quality, secret_scan, vectors, warc
from parcelsight.llm.bpe import BytePairs

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def coder():
    return BytePairs(RANKS)


@pytest.fixture(scope="module")
def reference():
    with open(RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                             special_tokens={})


def test_bpe_random(coder, reference):
    pick = random.Random(5)
    signs = " \n\t'stmdrevl1a . é!　Ⅷ\0\x1c"
    texts = ["", "'s", "x  ", "\n\n 's", "a" * 3000, "!'s 'll", *(
        "".join(pick.choice(signs) for _ in range(pick.randint(1, 70))) for _ in range(1500))]
    assert list(coder.encode(texts)) == [reference.encode_ordinary(t) for t in texts]


def test_bpe_points(coder, reference):
    points = [*range(0xD800), *random.Random(1).sample(range(0xE000, 0x110000), 3000)]
    texts = [f"a{c}a {c}{c}1{c} !{c}" for c in map(chr, random.Random(2).sample(points, 9000))]
    assert list(coder.encode(texts)) == reference.encode_ordinary_batch(texts)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=200))
def test_bpe_round_trip(text):
    coder = _CODER
    ids = next(coder.encode([text]))
    offsets = coder.offsets(ids)
    whole = text.encode()
    assert coder.decode(ids) == whole
    assert [whole[a:b] for a, b in zip(offsets, offsets[1:], strict=False)] == [
        coder.tokens[i] for i in ids]


_CODER = BytePairs(RANKS)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.one_of(
    st.text(alphabet=" \n\t\x0b\x1c　aB'sé́Σ1.,<|endoftext|>", max_size=20),
    st.sampled_from(["<|endoftext|>", "<|startoftext|>", "<|EndOfText|>"])), max_size=5).map("".join),
    max_size=4))
def test_word_encoder(texts):
    encoder = _ENCODER
    got = [np.frombuffer(b, "<u4").tolist() for b in encoder.encode(texts)]
    plain = Tokenizer.from_file(WORDS)
    assert got == [plain.encode(t, add_special_tokens=False).ids for t in texts]


_ENCODER = packing.WordEncoder(WORDS)


@pytest.mark.parametrize("n", [1, 2, 3, 4095, 4096, 4097, 8191, 123457])
def test_pieces(n):
    got = packing.pieces(n)
    assert [s for s, _ in got] == list(np.cumsum([0, *(k for _, k in got)])[:-1])
    assert sum(k for _, k in got) == n
    assert all(k <= 4096 and k & (k - 1) == 0 for _, k in got)


def _words(text):
    return text.encode().lower().split()


def _sets(text):
    w = _words(text)
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_slices_are_bounded_and_whole():
    """No slice holds more characters than asked for, but for a text that does alone; none is lost."""
    texts = ["", "a b " * 10, "x" * 500, "", "c" * 60, "d" * 60] * 300
    parts = list(packing.slices(texts, 100))
    assert [t for p in parts for t in p] == texts
    assert all(len(p) == 1 or sum(map(len, p)) <= 100 for p in parts)
    assert max(map(len, packing.slices([""] * 3000, 100))) == packing.SLICE_TEXTS
    assert list(packing.slices([], 100)) == []
    encoder = packing.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    assert [i for p in parts for i in encoder.encode(p)] == encoder.encode(texts)


def test_shingles_are_counted():
    pick = random.Random(3)
    signs = "ab \n\t\x0bÉ\x85"
    for _ in range(400):
        text = "".join(pick.choice(signs) for _ in range(pick.randint(0, 80)))
        assert len(minhash.shingles(text)) == len(_sets(text)), repr(text)
    assert (minhash.shingles("A b") == minhash.shingles("a  B\n")).all()


def test_superminhash_is_the_sequential_one():
    def plain(elements):
        m = minhash.SLOTS
        h = np.full(m, np.iinfo(np.int64).max)
        for e in elements:
            p = list(range(m))
            for j in range(m):
                x = int(minhash._mix(np.array([(int(e) + j * 0x9E3779B97F4A7C15
                                                + 0x632BE59BD9B4E019) % 2**64], np.uint64))[0])
                k = j + (x >> 32) % (m - j)
                p[j], p[k] = p[k], p[j]
                h[p[j]] = min(h[p[j]], (j << 32) | (x & 0xFFFFFFFF))
        return h

    rng = np.random.default_rng(1)
    sets = [rng.integers(0, 2**63, n).astype(np.uint64) for n in (1, 3, 40)]
    got = minhash.superminhash(sets)
    assert all((g == plain(s)).all() for g, s in zip(got, sets, strict=True))


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(4)
    every = np.unique(rng.integers(0, 2**63, 3000).astype(np.uint64))
    a, b = every[:2000], every[500:2500]
    s = minhash.superminhash([a, b])
    assert abs((s[0] == s[1]).mean() - 1500 / 2500) < 0.1


def test_links_on_full_sets():
    rng = np.random.default_rng(6)
    base = rng.integers(0, 2**63, 60).astype(np.uint64)
    sets = [np.unique(np.concatenate((base[k % 9:], rng.integers(0, 2**63, k % 7).astype(
        np.uint64)))) for k in range(30)]
    want = np.array([[100 * len(set(a) & set(b)) >= 85 * len(set(a) | set(b)) for b in sets]
                     for a in sets])
    assert (minhash._links(sets, 0, 85) == want).all()
    assert (minhash._links(sets, 4, 85) == want[:4, 4:]).all()


def test_intervals_match_brute_force():
    rng = np.random.default_rng(2)
    centre = rng.normal(size=(40, 16))
    x = (centre[rng.integers(0, 40, 900)] + 0.1 * rng.normal(size=(900, 16)))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    v = np.linalg.eigh(x.T @ x)[1][:, ::-1][:, :8]
    reach = float(np.sqrt(2 - 2 * 0.93))
    x = x[np.lexsort((np.floor(x @ v / reach).T)[::-1])]
    a, b = x[:500], x[500:]
    i, j = vectors.join_intervals(a, b, a @ v, b @ v, 0.93, reach)
    assert set(zip(i, j, strict=True)) == set(zip(*np.nonzero(a @ b.T >= 0.93), strict=True))


def test_ngrams_by_pieces(monkeypatch):
    text = "Déjà vu, naïve Straße! " * 30
    whole = langid.count_ngrams(text)
    monkeypatch.setattr(langid, "PIECE", 64)
    pieces = langid.count_ngrams(text)
    assert (whole[0] == pieces[0]).all() and (whole[1] == pieces[1]).all()
    assert not langid.count_ngrams("12 34 !!")[2]


def test_base_secrets():
    text = ("é password = \"abcdef1\" token:abc Api_Key='xyz.123' AKIA" + "B" * 15 + " AKIA"
            + "C" * 16 + " 0123456789abcdef01234567 Kſecret=abcdefg")
    got = [(secret_scan.KINDS[k], text[s:e]) for s, k, e, _ in secret_scan.base_spans(text)]
    assert got == [
        ("assign", 'password = "abcdef1'), ("assign", "Api_Key='xyz.123"),
        ("access", "AKIA" + "C" * 16), ("hex", "0123456789abcdef01234567")]


def test_quality_tables_learn_an_interaction():
    rng = np.random.default_rng(0)
    bins = rng.integers(0, quality.BINS, (3000, 3))
    y = ((bins[:, 0] >= 16) ^ (bins[:, 1] >= 16)).astype(float)
    start, tables, pairs = quality.boost(bins, y)
    z = start + tables[np.arange(3), bins].sum(axis=1)
    for (a, b), t in pairs.items():
        z += t[quality._coarse(bins[:, a]), quality._coarse(bins[:, b])]
    assert ((z > 0) == (y > 0)).mean() > 0.95


def test_warc_record_round_trip():
    payload = "<p>ü\r\n\r\n</p>".encode()
    data = warc.record(7, "http://a/\r\nb", payload, len(payload), "ab" * 20, None)
    data += warc.record(3, None, None, 5000, "cd" * 20, 7)
    fields, block, at = warc.parse(data, 0)
    assert fields["X-Page-ID"] == "7" and fields["WARC-Target-URI"] == "http://a/b"
    assert warc._content(fields, block, True)[-1] == payload
    fields, block, end = warc.parse(data, at)
    assert end == len(data)
    assert warc._content(fields, block, True)[2:6] == ("revisit", 7, 5000, "cd" * 20)


def test_short_slices_merge_as_long_ones(coder, monkeypatch):
    random = np.random.default_rng(11)
    words = ["".join(random.choice(list("aeinrstäö 你'"), n)) for n in random.integers(2, 16, 400)]
    plain = [coder._merged_short(w.encode()) for w in words if w.encode() not in coder.ranks]
    monkeypatch.setattr(bpe, "SHORT_SLICE", 0)
    assert plain == [coder.merged(w.encode()) for w in words if w.encode() not in coder.ranks]


def test_a_worker_keeps_its_coder():
    assert bpe.byte_pairs(RANKS) is bpe.byte_pairs(RANKS)


def test_plain_words_are_learned_directly(monkeypatch):
    encoder = packing.WordEncoder(WORDS)
    monkeypatch.setattr(packing, "_ends_plainly", None)  # only words with other letters need it
    text = "The cat, the CAT sat."
    want = encoder.tokenizer.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(encoder.encode([text])[0], "<u4").tolist() == want
