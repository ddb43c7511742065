"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import os
import random
import re

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from parcelsight.llm import (
    bpe, components, exact, langid, minhash, packing, pii, quality, secret_scan, vectors, warc)
from parcelsight.llm.components import connected_components
from parcelsight.llm.shared import likely

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")
LONG = "word " * 40_000
#: Columns whose names the operators use themselves.
CLASH = ("found", "row", "digest", "kept", "score", "node", "piece", "spans", "Bits")
ROWS = [
    (1, "The same text"), (2, "the  SAME\ttext"), (3, "Thesametext "), (4, None), (5, ""),
    (6, " \n"), (7, "12 !!"), (8, LONG), (None, "The same text"), (9, "One"), (9, "One"),
    (10, "héllo \U0001f600 wörld")]
SCHEMA = "doc_id long, text string, lang string"


@pytest.fixture(scope="module")
def docs(spark):
    frame = spark.createDataFrame([(i, t, "en") for i, t in ROWS], SCHEMA)
    for c in CLASH:
        frame = frame.withColumn(c, F.lit(c))
    return frame.repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def rows(frame, *columns):
    key = lambda r: tuple((x is None, str(x)) for x in r)
    return sorted((tuple(r) for r in frame.select(*columns).collect()), key=key)


def test_exact(spark, docs, none):
    found = exact.decide(docs, exact.new_index(spark))
    assert set(rows(found, "doc_id", "keep_id", "group_size", "kept")) == {
        (1, 1, 3, True), (2, 2, 1, True), (3, 1, 3, False), (4, 6, 3, False), (5, 6, 3, False),
        (6, 6, 3, True), (7, 7, 1, True), (8, 8, 1, True), (9, 9, 2, True), (9, 9, 2, False),
        (10, 10, 1, True), (None, 1, 3, False)}
    assert found.count() == len(ROWS)
    assert exact.decide(none, exact.new_index(spark)).count() == 0


def test_exact_longest_stays_then_smallest_id(spark):
    frame = spark.createDataFrame(
        [(5, "a b"), (4, "ab"), (7, " ab"), (3, "a  b"), (2, "a  b"), (None, "a  b")],
        "doc_id long, text string")
    got = exact.decide(frame, exact.new_index(spark)).collect()
    assert {r["keep_id"] for r in got} == {2} and {r["group_size"] for r in got} == {6}
    assert [r["doc_id"] for r in got if r["kept"]] == [2]
    assert {r["text_sha256"] for r in got} == {hashlib.sha256(b"ab").hexdigest()}


def test_exact_repeated_rows_and_batches(spark, docs):
    index = exact.new_index(spark)
    first = exact.keep_first(docs, index)
    assert first.columns == docs.columns
    assert [r[0] for r in rows(first, "doc_id")].count(9) == 1
    again = spark.createDataFrame(
        [(0, "One    "), (77, "new")], "doc_id long, text string")
    got = {r["doc_id"]: (r["keep_id"], r["kept"]) for r in exact.decide(again, index).collect()}
    assert got == {0: (9, False), 77: (77, True)}
    assert index.table().count() == index.table().select("digest").distinct().count()
    index.drop()


def test_minhash(docs, none):
    got = {(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"])
           for r in minhash.decide(docs).collect()}
    assert {(1, 1, 1, True), (2, 1, 1, False), (3, 1, 3, True), (4, 0, 4, True), (5, 0, 5, True),
            (6, 0, 6, True), (8, 1, 8, True), (None, 1, None, True), (9, 1, 9, True)} <= got
    kept = minhash.keep_one(docs)
    assert kept.columns == docs.columns and 2 not in [r[0] for r in rows(kept, "doc_id")]
    assert minhash.decide(none).count() == 0


def brute_components(texts, percent):
    sets = {}
    for i, t in texts.items():
        w = t.lower().split()
        sets[i] = {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: root(i) for i in sets}


@pytest.mark.parametrize("chunk", [400, 20])
def test_minhash_large_group(spark, monkeypatch, chunk):
    """A large group of near copies, cut into chunks, against all pairs."""
    monkeypatch.setattr(minhash, "CHUNK_DOCS", chunk)
    pick = random.Random(8)
    base = [f"w{pick.randrange(10**6)}" for _ in range(110)]
    texts = {}
    for i in range(150):
        w = base[:]
        for _ in range(pick.choice((1, 1, 2, 3))):
            w[pick.randrange(len(w))] = f"x{pick.randrange(10**6)}"
        texts[i] = " ".join(w)
    for i in range(150, 170):
        texts[i] = " ".join(f"y{pick.randrange(10**6)}" for _ in range(60))
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in minhash.decide(frame, 85).collect()}
    assert got == brute_components(texts, 85)


def test_components(spark):
    pick = random.Random(1)
    edges = [(i, i + 1) for i in range(60)] + [(pick.randrange(100, 400), pick.randrange(100, 400))
                                              for _ in range(150)] + [(500, 500)]
    parent = {x: x for e in edges for x in e}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    linked = {x for a, b in edges if a != b for x in (a, b)}
    got = connected_components(spark.createDataFrame(edges, "a long, b long"))
    assert rows(got, "node", "component") == sorted(
        ((i, root(i)) for i in linked), key=lambda r: tuple((False, str(x)) for x in r))
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("few", [0, components.FEW])
def test_rounds_of_few_edges_are_one_task(spark, monkeypatch, few):
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(name)
    monkeypatch.setattr(components, "FEW", few)
    spark.conf.set(name, "false")
    try:
        edges = [(i, i + 1) for i in range(1, 40)] + [(60, 50), (50, 60), (70, 70), (50, None)]
        got = connected_components(spark.createDataFrame(edges, "a long, b long"))
        assert {tuple(r) for r in got.collect()} == {
            (i, 1) for i in range(1, 41)} | {(50, 50), (60, 50)}
        assert not few or got.rdd.getNumPartitions() <= 2
    finally:
        spark.conf.set(name, before)


def test_likely(spark):
    ids = spark.range(0, 4000, 7)
    wide = spark.range(20_000).withColumnRenamed("id", "k").withColumn("bits", F.lit(1))
    got = {r["k"] for r in likely(wide, "k", ids, "id").collect()}
    assert set(range(0, 4000, 7)) <= got and len(got) < 700


def test_exact_batch_given_again(spark, docs):
    """A batch whose run was lost after it was appended finds the same once more."""
    with exact.new_index(spark) as index:
        want = rows(exact.decide(docs, index, batch="one"), "doc_id", "keep_id", "kept")
        size = index.table().count()
        assert rows(exact.decide(docs, index, batch="one"), "doc_id", "keep_id", "kept") == want
        assert exact.keep_first(docs, index, batch="one").count() == sum(k for *_, k in want)
        assert index.table().count() == size
        assert not any(k for *_, k in rows(exact.decide(docs, index, batch="two"),
                                           "doc_id", "keep_id", "kept"))
        name = index.name
    assert not spark.catalog.tableExists(name)


def test_exact_lost_before_the_append(spark, docs, monkeypatch):
    with exact.new_index(spark) as index:
        with monkeypatch.context() as lost:
            lost.setattr(exact.DigestIndex, "add", lambda *_: 1 / 0)
            with pytest.raises(ZeroDivisionError):
                exact.decide(docs, index, batch="one")
        assert index.table().count() == 0
        assert exact.keep_first(docs, index, batch="one").count() == exact.keep_first(
            docs, index, batch="one").count() > 0


def test_near_copies_with_one_id(spark):
    """Rows with one id are decided by their own texts."""
    words = [f"w{k}" for k in range(60)]
    frame = spark.createDataFrame(
        [(3, " ".join(words)), (9, " ".join([*words, "more"])), (9, "a text that nobody else has at all"),
         (9, None), (12, " ".join(words))], "doc_id long, text string")
    kept = rows(minhash.keep_one(frame, percent=80), "doc_id", "text")
    assert kept == [(3, " ".join(words)), (9, "a text that nobody else has at all"), (9, None)]


def test_secret_models_recall(spark, folder):
    """Random strings of other forms than the labelled ones, and names that are none."""
    pick = random.Random(4)
    upper, lower, digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
    drawn = lambda letters, n: "".join(pick.choice(letters) for _ in range(n))
    larger = f"{os.path.dirname(folder.rstrip('/'))}/sf0.01/documents.parquet"  # 1000 texts
    ordinary = [r.text for r in spark.read.parquet(larger).collect()]
    labelled = [f"password={drawn(lower + digits + upper, 24)} key {drawn(digits + 'abcdef', 32)} "
                f"AKIA{drawn(upper + digits, 16)}" for _ in range(60)]
    frame = spark.createDataFrame([(t,) for t in [*ordinary, *labelled]], "text string")
    model = secret_scan.train(frame)
    assert model.recall >= 0.8 and model.false_hits <= secret_scan.FALSE_HITS
    for letters, n, least in ((upper + lower + digits, 40, 0.95), (upper + lower + digits, 24, 0.9),
                              (lower + digits, 32, 0.9), (digits + "ABCDEF", 32, 0.6)):
        assert sum(model.spans(f"it is {drawn(letters, n)} here") != [] for _ in range(300)) >= 300 * least
    for name in ("configuration_management_service", "com.example.project.module.Main",
                 "getUserAccountInformationById", "main_window_2_final_v3.docx", "12345678901234567890"):
        assert model.spans(name) == []


def brute_secrets(text):
    """Spans of the fixed formats, character by character."""
    out, kinds = [], (("assign", None), ("access", "AKIA"), ("hex", ""))
    word = set(secret_scan.ALPHABET)
    for kind, head in kinds:
        at = 0
        while at < len(text):
            end = None
            if kind == "assign":
                for name in ("password", "passwd", "secret", "token", "api_key", "apikey"):
                    if text[at:at + len(name)].translate(str.maketrans(
                            "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) == name:
                        k = at + len(name)
                        k += text[k:k + 1] in tuple("\"'")
                        while text[k:k + 1] == " ":
                            k += 1
                        if text[k:k + 1] in (":", "="):
                            k += 1
                            # an equals sign may also begin the value
                            while text[k:k + 1] == " ":
                                k += 1
                            k += text[k:k + 1] in tuple("\"'")
                            v = k
                            while v < len(text) and text[v] in word:
                                v += 1
                            if v > k:
                                end, fits = v, v - k >= 6
                        break
            else:
                letters = set("0123456789abcdef") if kind == "hex" else set(
                    "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")
                if text.startswith(head, at):
                    v = at + len(head)
                    while v < len(text) and text[v] in letters:
                        v += 1
                    if v > at + len(head):
                        end, fits = v, v - at >= (20 if kind == "access" else 24)
            if end:
                if fits:
                    out.append((at, ("assign", "access", "hex").index(kind), end))
                at = end
            else:
                at += 1
    return sorted(out)


def test_base_secrets_against_brute_force():
    pick = random.Random(7)
    pieces = ["password", "PassWD", "api_key", "APIKEY", "token", "secret", "=", ":", " ", "'", '"', "AKIA",
              "A1B2C3D4", "0123456789abcdef", "abc", "é", "\n", "\u2028", "x.y", "==", "K", "ſecret"]
    for _ in range(1500):
        text = "".join(pick.choice(pieces) for _ in range(pick.randint(1, 25)))
        assert [(s, k, e) for s, k, e, _ in secret_scan.base_spans(text)] == brute_secrets(text), text


def test_secrets(docs, none, spark):
    found = secret_scan.scan(docs, secret_scan.train(docs))
    assert found.count() == len(ROWS)
    assert {r["spans"] for r in found.collect()} == {""}
    assert secret_scan.scan(none, secret_scan.train(none)).count() == 0


def test_secrets_by_model(spark):
    pick = random.Random(4)
    hexed = lambda n: "".join(pick.choice("0123456789abcdef") for _ in range(n))
    mixed = "".join(pick.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
                    for _ in range(40))
    plain = "the quick brown foxes jumped over the lazy dogs internationalisation_of_everything "
    texts = [f"é {plain} password={hexed(18)} {plain}" for _ in range(80)]
    texts += [f"{plain} {mixed} {plain}", plain * 2000, "AKIA" + "B" * 16, None]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = secret_scan.train(frame.where("doc_id <> 80"))
    got = {r["doc_id"]: r for r in secret_scan.scan(frame, model).collect()}
    at = texts[80].index(mixed)
    assert got[80]["spans"] == f"markov:{at}:{at + 40}" and got[81]["spans"] == ""
    s = texts[0].index("password")
    assert got[0]["n_assign"] == 1 and got[0]["spans"] == f"assign:{s}:{s + 27}"
    assert got[0]["base_sha256"] == hashlib.sha256(got[0]["spans"].encode()).hexdigest()
    clean = {r["doc_id"]: r["text"] for r in secret_scan.masked(frame, model).collect()}
    assert clean[80] == texts[80].replace(mixed, "[SECRET]") and clean[83] is None
    assert clean[81] == texts[81]


def test_packing(docs, none):
    got = packing.pack(docs, WORDS).collect()
    by_doc = {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
    assert {len(by_doc[i]) for i in (4, 5, 6)} == {1} and by_doc[4][0]["ids"] == [2]
    assert len({r["sequence_id"] for r in got}) == len(got)
    assert all(r["length"] == len(r["ids"]) <= 4096 and r["offset"] == 0 for r in got)
    long = sorted(by_doc[8], key=lambda r: r["start"])
    assert sum(r["length"] for r in long) == long[0]["doc_tokens"] == 40_001
    assert packing.pack(none, WORDS).count() == 0


def test_bpe(docs, none):
    got = {r["doc_id"]: r for r in bpe.digests(docs, RANKS).collect()}
    assert got[4]["n_tokens"] == got[5]["n_tokens"] == 0
    assert got[8]["decoded_sha256"] == hashlib.sha256(LONG.encode()).hexdigest()
    coded = docs.withColumn("coded", bpe.encode(docs, RANKS)).select("text", "coded.ids")
    back = coded.withColumn("back", bpe.decode(RANKS))
    assert back.where(F.coalesce("text", F.lit("")) != F.col("back").cast("string")).isEmpty()
    assert bpe.digests(none, RANKS).count() == 0


def test_language(docs, none, folder, spark):
    model = langid.train(docs)
    got = {r["doc_id"]: r["lang_pred"] for r in langid.predict(docs, model).collect()}
    assert got[4] == got[5] == got[7] == "und" and got[1] == "en"
    kept = langid.keep_identified(docs, model)
    assert kept.columns == docs.columns
    assert {4, 5, 6, 7}.isdisjoint(r[0] for r in rows(kept, "doc_id"))
    empty = langid.train(none)
    assert {r["lang_pred"] for r in langid.predict(docs, empty).collect()} == {"und"}
    assert langid.predict(none, model).count() == 0


def test_language_held_out(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = langid.predict(docs, langid.train(docs)).join(docs.select("doc_id", "lang"), "doc_id")
    held = got.where("held_out").collect()
    assert len(held) > 20 and sum(r["lang"] == r["lang_pred"] for r in held) >= 0.97 * len(held)


def test_quality(docs, none, spark):
    labels = spark.createDataFrame(
        [(1, 1), (1, 1), (8, 0), (9, None), (None, 1), (2, 3)], "doc_id long, quality int")
    got = quality.score(docs, quality.train(docs, labels)).collect()
    assert len(got) == len(ROWS) and all(0 <= r["score"] <= 1 for r in got)
    model = quality.train(docs, labels.limit(0))
    assert {r["score"] for r in quality.score(docs, model).collect()} == {0.5}
    assert quality.score(none, model).count() == 0


def test_quality_held_out(spark, folder):
    docs = spark.read.parquet(f"{folder.replace('sf0.001', 'sf0.01')}/documents.parquet")
    labels = spark.read.parquet(f"{folder.replace('sf0.001', 'sf0.01')}/labels.parquet")
    found = quality.score(docs, quality.train(docs, labels)).join(labels, "doc_id")
    held = found.where("held_out").collect()
    assert len(held) > 40
    assert sum(r["predicted"] == r["quality"] for r in held) >= 0.9 * len(held)


def test_warc(spark):
    big = "x" * 1500
    pages = spark.createDataFrame(
        [(1, "u", big), (2, None, big), (3, "u", None), (4, "u", ""), (5, "u", "é"), (6, "u", "é"),
         (None, "u", big), (7, "u", "y" * 2000)], "page_id long, url string, html string")
    got = {(r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"])
           for r in warc.round_trip(pages.withColumn("first", F.lit(1))).collect()}
    assert got == {(1, 1500, "revisit", 2), (2, 1500, "response", None), (3, 0, "response", None),
                   (4, 0, "response", None), (5, 2, "response", None), (6, 2, "response", None),
                   (None, 1500, "revisit", 2), (7, 2000, "response", None)}
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_warc_lookup(spark, folder, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FRAME_BYTES", 20_000)
    pages = spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "url", "html")
    index = warc.write(pages, str(tmp_path / "w"))
    want = {r["page_id"]: r["html"] for r in pages.where("page_id % 9 = 0").collect()}
    got = warc.lookup(index.where("page_id % 9 = 0"), str(tmp_path / "w")).collect()
    assert {r["page_id"] for r in got} == set(want)
    assert all(r["payload"].decode() == want[r["page_id"]] for r in got
               if r["record_type"] == "response")
    assert index.select("frame").distinct().count() > 1


BASE = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
     lambda m: all(int(p) <= 255 for p in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+",
     lambda m: 14 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and luhn(d)),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]",
     lambda m: 10 <= len(re.sub("[^0-9]", "", m)) <= 15))


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def base_pii(text):
    found = sorted((m.start(), k, m.end()) for k, (_, p, ok) in enumerate(BASE)
                   for m in re.finditer(p, text or "") if ok(m.group()))
    return ",".join(f"{BASE[k][0]}:{s}:{e}" for s, k, e in found)


def test_pii_base(spark):
    pick = random.Random(9)
    texts = [None, "", "no digits", "é😀 a@b.c.d_x@y.z @ a@b", "1.2.3.4.5.6.7.8 256.1.1.1 007.1.1.1",
             "4111 1111 1111 1111 and 4111-1111-1111-1112", "+1 (255) 555-8013 +12 3 +1" + " " * 50,
             "a." * 9000 + "@b" + ".c" * 9000]
    signs = ["1", "23", "4111111111111111", ".", "@", "a", "b-c", "+", "(", ") ", " ", "-", "é", "_"]
    texts += ["".join(pick.choice(signs) for _ in range(pick.randint(1, 40))) for _ in range(400)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.scan(frame.withColumn("row", F.lit(1))).collect()}
    for i, t in enumerate(texts):
        want = base_pii(t)
        assert got[i]["base_sha256"] == hashlib.sha256(want.encode()).hexdigest(), (t, want, got[i])
        assert got[i]["n_ip"] == want.count("ip:") and got[i]["n_card"] == want.count("card:")
    assert pii.scan(frame.limit(0)).count() == 0


def test_pii_bootstrap(spark):
    """A context that nearly always holds an address reveals one of another form."""
    texts = [f"hello there customer ip 10.0.{i % 256}.{i // 256} thanks" for i in range(200)]
    texts += ["hello there customer ip 10x7z99 thanks", "the number 10x7z88 is not one"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in pii.scan(frame).collect()}
    at = texts[200].index("10x7")
    assert got[200] == f"context:{at}:{at + 7}" and got[201] == ""


def test_vectors(spark):
    nan, inf = float("nan"), float("inf")
    given = [
        (1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.1], 1), (4, [1.0, 0.0], 2),
        (5, [0.0, 0.0], 1), (6, None, 1), (7, [1.0, None], 1), (8, [nan, 1.0], 1),
        (9, [inf, 1.0], 1), (10, [1.0, 0.0], None), (None, [1.0, 0.0], 1), (11, [], 1),
        (12, [1.0, 0.0, 0.0], 1), (13, [0.0, 1.0], 1)]
    frame = spark.createDataFrame(given, "vec_id long, embedding array<float>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"])
           for r in vectors.decide(frame.withColumn("block", F.lit(0))).collect()}
    alone = {i: (0, i, True) for i in (4, 5, 6, 7, 8, 9, 10, 11, 12, 13, None)}
    assert got == alone | {1: (2, 1, True), 2: (2, 1, False), 3: (2, 1, False)}
    assert vectors.decide(frame.limit(0)).count() == 0
