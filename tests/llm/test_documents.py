"""Operators on documents against brute force, on small tables with every odd case."""

import functools
import hashlib
import math
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from estimora.llm import bpe, decontaminate, jaccard, langid, pii, token_files, trie_counts

D = "/root/testdata/sf0.001"
WORDS, BYTES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, n int"
LONG = " ".join(f"wort{k % 977}x{k}" for k in range(30_000))
ODD = [None, "", " \n\t", "!!! ??? 123", "one two", "One TWO", "a b c d e", "a b c d e", LONG, LONG + " end", "x" * 5000, "Ünï cödé ÉÈ Σς İ", "it's they'LL 12٣ <|endoftext|> \x1c\x85 end", "  two   blanks \n \n x"]


@pytest.fixture(scope="module")
def odd(spark):
    """Odd texts, a repeated row, nulls in other columns, and columns whose names clash with results."""
    rows = [(k, t, None if k % 3 else "en", None, None, 0.5, 1) for k, t in enumerate(ODD)]
    return spark.createDataFrame([*rows, rows[4], rows[6]], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{D}/documents.parquet")


def test_bpe_is_the_library(spark, docs, odd, none):
    library = Tokenizer.from_file(WORDS)
    for table in (docs, odd):
        texts = {r["doc_id"]: r["text"] or "" for r in table.collect()}
        found = bpe.round_trip(table, WORDS).collect()
        assert len(found) == table.count()
        for r in found:
            ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
            assert r["n_tokens"] == len(ids)
            assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
            assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    back = {r["doc_id"]: r["text"] for r in bpe.decoded(bpe.encoded(odd, WORDS), WORDS).collect()}
    assert back[4] == library.decode(library.encode("one two").ids) and back[0] == ""
    assert bpe.round_trip(none, WORDS).count() == 0


@functools.cache
def library(path):
    return Tokenizer.from_file(path)


def test_bpe_on_every_character():
    """After a letter, a digit and a sign; of ideographs, syllables and planes without scripts each 16th."""
    codec = bpe.codec(WORDS)
    every = [c for c in map(chr, [*range(0xD800), *range(0xE000, 0x110000)]) if not ord(c) % 16 or ord(c) < 0x3400 or "\ua000" <= c < "\uac00" or "\uf900" <= c < "\U00013000" or "\U00016000" <= c < "\U00017000" or "\U0001b000" <= c < "\U00020000"]
    for a in range(0, len(every), 5000):
        texts = [f"a{c} 1{c}2 !{c}" for c in every[a : a + 5000]]
        found = library(WORDS).encode_batch_fast(texts, add_special_tokens=False)
        assert [b == np.array(e.ids, "<u4").tobytes() for b, e in zip(codec.encode(texts), found, strict=True)].count(False) == 0
    codec.known.clear()


@settings(max_examples=1000, deadline=None)
@given(st.text(st.sampled_from(list("ab'sS dtl \n\t  éÉéΣς\x1c\x85İ12٣.,!<|>日😀ß")), max_size=30))
def test_encoders_on_any_text(text):
    codec, pieces = bpe.codec(WORDS), token_files.encoder(BYTES)
    assert np.frombuffer(codec.encode([text])[0], "<u4").tolist() == library(WORDS).encode(text, add_special_tokens=False).ids
    several = [text, f"q{text} {text}", f"{text} \t", f"r {text}s"]
    assert [np.frombuffer(b, pieces.type).tolist() for b in pieces.encode(several)] == [pieces.tokenizer.encode(t, add_special_tokens=False).ids for t in several]


def test_token_files(spark, docs, odd, none):
    library = Tokenizer.from_file(BYTES)
    for table in (docs, odd):
        found = sorted(token_files.token_files(table, BYTES).collect(), key=lambda r: r["start"])
        texts = {r["doc_id"]: r["text"] or "" for r in table.collect()}
        assert [r["doc_id"] for r in found] == sorted(r["doc_id"] for r in table.collect())
        at = 0
        for r in found:
            ids = np.array([*library.encode(texts[r["doc_id"]], add_special_tokens=False).ids, 2], "<u4")
            assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes()))
            at += len(ids)
    assert token_files.token_files(none, BYTES).count() == 0
    assert token_files.token_files(odd.selectExpr("CAST(NULL AS LONG) AS doc_id", "text"), BYTES).filter("doc_id IS NULL").count() == odd.count()


def classes_by_force(rows):
    sets = {}
    for i, text in rows:
        w = re.findall("[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}
    label = {i: i for i in sets}
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and sets[b] and min(len(sets[a]), len(sets[b])) * 100 >= 80 * max(len(sets[a]), len(sets[b])) and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return {i: (len(sets[i]), label[i]) for i in sets}


@pytest.mark.parametrize("part_level", [jaccard.PART_LEVEL, 1])
def test_jaccard_classes(spark, odd, none, part_level):
    """Near copies at all distances from their original, chains, shared passages, and odd rows."""
    rng = np.random.default_rng(5)
    word = lambda: f"w{rng.integers(5000)}"
    rows = [(k + 1000, " ".join(word() for _ in range(60))) for k in range(30)]
    for _ in range(120):
        base = rows[int(rng.integers(4))][1].split()
        for _ in range(int(rng.integers(0, 5))):
            base[int(rng.integers(len(base)))] = word()
        rows.append((len(rows) + 1000, " ".join(base)))
    # equal prefixes and sizes, but several classes within such a group (its shingles are in fewer than
    # 8 documents, so that the order is that of the hashes)
    for k in range(16):
        opening = " ".join(f"o{k}x{j}" for j in range(12))
        rows += [(len(rows) + 1000 + j, f"{opening} y{j % 3} z{j}") for j in range(6)]
    passage = " ".join(f"p{k}" for k in range(20))
    rows += [(len(rows) + 1000 + k, passage + " " + " ".join(word() for _ in range(10 + k))) for k in range(20)]
    table = spark.createDataFrame([(i, t, None, None, None, 0.0, 0) for i, t in rows], SCHEMA).union(odd)
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.classes(table, part_level=part_level).collect()}
    assert found == classes_by_force([(r["doc_id"], r["text"]) for r in table.collect()])
    assert found[6][1] == 6 and found[5][1] == 4
    assert jaccard.classes(none, part_level=part_level).count() == 0


def test_language(spark, docs, odd, none):
    rows = langid.identify(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()
    known = {r["doc_id"]: r["lang"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert np.mean([r["lang_pred"] == known[r["doc_id"]] for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)
    found = {r["doc_id"]: r["lang_pred"] for r in langid.identify(odd).collect()}
    assert [found[k] for k in range(4)] == ["und"] * 4 and found[4] == "en"
    assert langid.identify(none).count() == 0
    signs = spark.createDataFrame([(1, "½ ²"), (2, "Ⅷ _ 7"), (3, "ª"), (4, "١٢"), (5, "日")], "doc_id long, text string")
    model = langid.fit(odd)
    assert {r["doc_id"]: r["lang_pred"] != "und" for r in langid.predicted(signs, model).collect()} == {1: False, 2: False, 3: True, 4: False, 5: True}
    assert {r["lang_pred"] for r in langid.identify(docs.selectExpr("doc_id", "text", "CAST(NULL AS STRING) AS lang")).collect()} == {"und"}


def base_by_force(text):
    digits = lambda s: re.sub("[^0-9]", "", s)

    def luhn(d):
        two = [int(c) for c in d[::-1]]
        return (sum(two[::2]) + sum(sum(divmod(2 * c, 10)) for c in two[1::2])) % 10 == 0

    found = [
        [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)],
        [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))],
        [m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 13 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))],
        [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m[0])) <= 15],
    ]
    return found


@settings(max_examples=500, deadline=None)
@given(st.text(st.sampled_from(list("aZ09.5@@+-- ()12345..é")), max_size=40))
def test_base_spans(text):
    assert pii.base_spans(text) == base_by_force(text)


def test_pii(spark, odd, none):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in pii.detect(docs).collect():
        base = base_by_force(texts[r["doc_id"]])
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == list(map(len, base))
        assert r["base_sha256"] == hashlib.sha256(pii.written(base).encode()).hexdigest()
        assert set(filter(None, pii.written(base).split(","))) <= set(r["spans"].split(","))
    field = pii.fit(docs)
    seen = "call +1 (017) 555-7713 now, later (017) 555-7713 or 017 555 7713; order 123456789012"
    assert pii.masked(seen, field) == "call [PHONE] now, later [PHONE] or [PHONE]; order 123456789012"
    assert pii.masked("ISBN 9780306406157 of 2024, no 1234567890123456", field) == "ISBN 9780306406157 of 2024, no 1234567890123456"
    assert pii.detect(odd).filter("spans != '' OR n_added > 0").count() == 0 and pii.detect(odd).count() == odd.count()
    assert pii.detect(none).count() == 0
    assert sorted(map(str, pii.redacted(odd).collect())) == sorted(map(str, odd.collect()))


def test_decontamination(spark, odd, none):
    items = spark.read.parquet(f"{D}/benchmark.parquet")
    known = [(r["item_id"], r["text"]) for r in items.collect()]
    rng, rows, planted = np.random.default_rng(2), [], {}
    for k in range(150):
        i, text = known[int(rng.integers(len(known)))]
        w = text.split()
        for _ in range(int(rng.choice([0, 0.05, 0.1, 0.15]) * len(w))):
            at, kind = int(rng.integers(len(w))), int(rng.integers(3))
            w[at : at + (kind != 1)] = [f"zz{at}"] if kind < 2 else []
        rows.append((k, " ".join(f"u{rng.integers(9999)}" for _ in range(200)) + " " + " ".join(w) + " tail of it", None, None, None, 0.0, 0))
        planted[k] = i
    rows += [(1000 + k, " ".join(f"u{rng.integers(9999)}" for _ in range(300)), None, None, None, 0.0, 0) for k in range(50)]
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(spark.createDataFrame(rows, SCHEMA), items).collect()}
    assert len(found & set(planted.items())) >= 0.98 * len(planted)
    assert all(d < 1000 for d, _ in found)
    assert decontaminate.contaminated(none, items).count() == 0 and decontaminate.contaminated(odd, items).count() == 0
    assert decontaminate.contaminated(odd, items.limit(0)).count() == 0
    short = spark.createDataFrame([(1, "one two"), (2, None), (3, ""), (4, "one two")], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(odd, short).collect()} == {(4, 1), (4, 4), (5, 1), (5, 4)}


@pytest.mark.parametrize("part, most", [(20_000, 160), (7, 160), (20_000, 4)])
def test_decontamination_by_force(spark, monkeypatch, part, most):
    """All items of many lengths with edits up to the limit of a fifth of their words, in one part and
    in several, by rounds and, with hardly any, by verifying every window."""
    monkeypatch.setattr(decontaminate, "ITEMS_AT_ONCE", part)
    monkeypatch.setattr(decontaminate, "MOST_ROUNDS", most)
    rng, rows = np.random.default_rng(6), []
    items = [(k, " ".join(f"v{rng.integers(400)}" for _ in range(n))) for k, n in enumerate([1, 2, 3, 4, 5, 6, 6, 7, 8, 9, 10, 12, 15, 20, 25, 33, 50, 80, 120, 200])]
    for k in range(160):
        w = items[k % len(items)][1].split()
        for _ in range(int(0.2 * len(w))):
            at, kind = int(rng.integers(len(w))), int(rng.integers(3))
            w[at : at + (kind != 1)] = [f"zz{rng.integers(99)}"] if kind < 2 else []
        rows.append((k, " ".join([*(f"v{rng.integers(400)}" for _ in range(30)), *w, *(f"u{rng.integers(99)}" for _ in range(9))])))
    found = {(r["doc_id"], r["item_id"]): r["distance"] for r in decontaminate.contaminated(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")).collect()}
    number: dict = {}
    coded = lambda text: np.array([number.setdefault(w, len(number)) for w in text.split()], np.uint64)
    true = {}
    for i, text in rows:
        for j, item in items:
            limit = int(0.2 * len(item.split()))
            if (d := decontaminate.edit_distance(coded(item), coded(text), limit)) <= limit:
                true[i, j] = d
    print("recall", len(found), len(true))
    assert set(found) <= set(true) and len(found) >= 0.99 * len(true)
    if most < 160:
        assert found == true


@given(st.lists(st.integers(0, 3), max_size=9), st.lists(st.integers(0, 3), max_size=9))
@settings(max_examples=200, deadline=None)
def test_edit_distance(a, b):
    def whole(x, y):
        row = list(range(len(y) + 1))
        for i, c in enumerate(x, 1):
            prior, row = row, [i]
            for j, d in enumerate(y, 1):
                row.append(min(prior[j] + 1, row[-1] + 1, prior[j - 1] + (c != d)))
        return row[-1]

    best = min(whole(a, b[i:j]) for i in range(len(b) + 1) for j in range(i, len(b) + 1))
    assert decontaminate.edit_distance(np.array(a, np.uint64), np.array(b, np.uint64), 20) == best


def test_trie_counts(spark, docs, odd, none):
    pieces = trie_counts.vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    low, longest = min(pieces.values()), max(map(len, pieces))

    @functools.cache
    def by_force(word):
        best = [(0.0, 0)]
        for k in range(1, len(word) + 1):
            found = [(best[j][0] + pieces[word[j:k]], best[j][1] - 1) for j in range(max(0, k - longest), k) if word[j:k] in pieces]
            if word[k - 1] not in pieces:
                n = len(word[k - 1].encode())
                found.append((best[k - 1][0] + n * low, best[k - 1][1] - n))
            best.append(max(found))
        return best[-1][0], -best[-1][1]

    long_words = spark.createDataFrame([(1, "a" * 46 + " " + "a" * 47 + " " + "ab" * 24 + " " + "日" * 60 + "\U0001f600 \ud7a3\x00z")], "doc_id long, text string")
    for table in (docs, odd, long_words):
        texts = {r["doc_id"]: r["text"] for r in table.collect()}
        found = trie_counts.token_counts(table, public_tokenizers.path("piece_bpe_32k.model")).collect()
        assert len(found) == table.count()
        for r in found:
            words = [by_force("▁" + w) for w in (texts[r["doc_id"]] or "").split()]
            assert (r["n_pretokens"], r["n_tokens"]) == (len(words), sum(n for _, n in words))
            assert r["score"] == pytest.approx(math.fsum(s for s, _ in words), rel=1e-12)
    assert trie_counts.token_counts(none, public_tokenizers.path("piece_bpe_32k.model")).count() == 0


def test_trie_counts_anew():
    """What is stored doesn't change what is counted."""
    model = public_tokenizers.path("piece_bpe_32k.model")
    counter = trie_counts.counter(model)
    words = {f"word{k}er" for k in range(300)} | {"the", "them", "themes", "é"}
    counter.clear()
    counter.store(words)
    assert len(counter.known) == len(words)
    assert all((counter.counts[k], counter.scores[k]) == counter.along("▁" + w) for w, k in counter.known.items())


PLAIN = [
    "Server 10.0.0.1 ok. Order 1234567890, order 2234567890, order 3234567890.", "part 555123987654, part 555123987655, part 123456789 at 192.168.1.20", "ISBN 9783161484100 and card 4465758382889437",
    "invoice 20240311991 of 5550001112 call +49 30 12345678", "tel +49 30 12345678, order 4930999999, case 3012345678901", "id 1020304050 beside 10.20.30.40", "4465758382889437 is paid, reference 4465758382000000",
]
SPREAD = {
    "card 4465758382889437 then 4465 7583 8288 9438": 1, "call +49 30 12345678 or 030 12345678 or 493012345678": 2, "Phone +1 (555) 123-4567, again 555 123 4567 and 5551234567, order 5551239999": 2,
    "mail a.b@c.org or a.b [at] c [dot] org": 1, "host 10.20.30.40 and later 10 20 30 40": 1,
}


@pytest.fixture(scope="module")
def fields(spark):
    return [pii.fit(spark.read.parquet(f"/root/testdata/{d}/documents.parquet")) for d in ("sf0.001", "sf0.01", "sf0.1")]


def test_plain_numbers_are_nothing(fields):
    for field in fields:
        for text in PLAIN:
            assert not any(pii.spans_of(text, field)[1]), text
        for text, n in SPREAD.items():
            assert sum(map(len, pii.spans_of(text, field)[1])) == n, text


def exact(found, field):
    """Marginals of all labellings of up to eight mentions."""
    labels, n = 5, len(found)
    unary = np.array([m.shape for m in found]) @ field.unary
    unary[pii.ruled_out(found)] = -30
    for k, m in enumerate(found):
        if m.label >= 0:
            unary[k] = -30
            unary[k, m.label + 1] = 0
    every = np.stack(np.meshgrid(*[np.arange(labels)] * n, indexing="ij"), -1).reshape(-1, n)
    score = sum(unary[k][every[:, k]] for k in range(n))
    for table, pairs in zip((field.chain, field.skip), pii.links(found), strict=True):
        for a, b in pairs:
            score = score + table[every[:, a], every[:, b]]
    p = np.exp(score - score.max())
    return np.array([[p[every[:, k] == x].sum() for x in range(labels)] for k in range(n)]) / p.sum()


def test_messages_against_all_labellings(fields):
    """What the field adds is what exact marginals add, on every text of a few mentions."""
    checked = 0
    for text in [*PLAIN, *SPREAD, "a 1234567 b 12345678901 c 1.2.3.4 d 4111111111111111 e +12 345 678 901 f 12 345 678 901"]:
        for field in fields:
            found = pii.mentions(text, pii.base_spans(text))
            if 1 < len(found) <= 7:
                p, q = exact(found, field), pii.labelled(found, field)
                pick = lambda x: [(int(r.argmax()), bool(r.max() > 0.6)) for r in x]
                assert pick(p) == pick(q), text
                checked += 1
    assert checked > 20


def test_very_many_links(fields):
    text = "call +49 30 12345678, then " + "; ".join(f"030 12345678 and {k:09d}" for k in range(40_000, 60_000))
    base, added = pii.spans_of(text, fields[0])
    assert len(base[3]) == 1 and len(added[3]) == 20_000 and not added[1] and not added[2]


def test_the_training_sample_is_bounded(spark, monkeypatch):
    """Rows without an id, and repeats, don't lift the bound; the driver gets SAMPLE_ROWS at most."""
    seen = []
    monkeypatch.setattr(langid, "learned", lambda x, order, labels: seen.append(len(labels)) or langid.Model())
    rows = [(None, f"word{k} and more of it", "ab"[k % 2]) for k in range(20_000)] + [(5, "again and again", "a")] * 9000
    langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4))
    assert len(seen) == 1 and langid.SAMPLE_ROWS / 2 < seen[0] <= langid.SAMPLE_ROWS


@pytest.mark.parametrize("share", [0.34, 0.5])
def test_larger_shares_of_edits(spark, share):
    """Items of six words with as many edits as the limit allows, against brute force."""
    rng = np.random.default_rng(8)
    items = [(k, " ".join(f"w{x}" for x in rng.integers(0, 10**6, 6))) for k in range(60)]
    texts = []
    for k, item in items:
        edited = item.split()
        for at in rng.permutation(6)[: int(share * 6)]:
            edited[at] = f"e{k}x{at}"
        texts.append((k, "before it " + " ".join(edited) + " behind it"))
    docs, bench = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, bench, max_share=share).collect()}
    assert len(found & {(k, k) for k in range(60)}) >= 58
    with pytest.raises(ValueError):
        decontaminate.contaminated(docs, bench, max_share=1.0)
