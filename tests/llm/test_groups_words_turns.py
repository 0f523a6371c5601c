"""Exact copies, spelling variants and the trie of conversations, against SQL and brute force."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from estimora.llm import exact_dedup, spelling, turn_trie
from estimora.llm.queries import ORACLES, QUERIES

D = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_exact_dedup", "op12_spelling_variants", "op13_turn_trie"])
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    found, want = QUERIES[name](spark, D), con.execute(ORACLES[name])
    assert sorted(found.columns) == sorted(c[0] for c in want.description)
    order = [c[0] for c in want.description]
    assert Counter(tuple(r) for r in found.select(*order).collect()) == Counter(want.fetchall())


def squeezed(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


TEXTS = [None, "", " \t\n\x0b\x0c\r", "a b", "ab", "a  b", "a  b", "ab\x85", "ab\xa0", "x" * 100_000, " " * 9 + "x" * 100_000, "Ünï\tcödé", "Ünïcödé", "AB"]


@pytest.mark.parametrize("share", [0.0, exact_dedup.HEAVY_SHARE, 2.0])  # all groups heavy, some, none
def test_exact_groups(spark, monkeypatch, share):
    monkeypatch.setattr(exact_dedup, "HEAVY_SHARE", share)
    rows = [(k, t, f"s{k}", "extra") for k, t in enumerate(TEXTS)] + [(3, "a b", "again", None), (None, "a b", None, None), (None, "lonely", None, None), (None, "lonely", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sha string, K_N string").repartition(3)
    groups = defaultdict(list)
    for r in rows:
        groups[squeezed(r[1])].append((-len(r[1] or ""), r[0] is None, r[0] or 0))
    found = exact_dedup.groups(docs).collect()
    assert len(found) == len(rows)
    kept = Counter()
    for r in found:
        key = next(k for k in groups if hashlib.sha256(k.encode()).hexdigest() == r["text_sha256"])
        best = min(groups[key])
        assert r["keep_id"] == (None if best[1] else best[2]) and r["group_size"] == len(groups[key])
        kept[key] += r["kept"]
        assert not r["kept"] or r["doc_id"] == r["keep_id"]
    assert all(kept[k] == 1 for k in groups)
    left = exact_dedup.deduplicated(docs)
    assert left.columns == docs.columns
    assert Counter(squeezed(r["text"]) for r in left.collect()) == Counter(dict.fromkeys(groups, 1))
    assert exact_dedup.groups(docs.limit(0)).count() == 0 == exact_dedup.deduplicated(docs.limit(0)).count()


def test_exact_groups_stay_native(spark):
    plan = QUERIES["op11_exact_dedup"](spark, D)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def near_words(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def variants_by_force(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
    n = {w: k for w, k in counts.items() if len(w) >= 6 and k >= 5}
    form, near = {}, {}
    for w in n:
        all_ = [v for v in n if near_words(w, v)]
        near[w] = len(all_)
        best = min(all_, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n[w], near[w], n.get(form[w])))
    return out


@pytest.mark.parametrize("most", [spelling.CELL_WORDS, 3])
def test_variants(spark, most):
    rng = np.random.default_rng(5)
    words = ["aaaaaa", "aaaaaaa", "aaaaaaaa", "éèÿ×÷À", "éèÿ×÷à", "Ünïcode", "ünïcode", "z" * 3000, "z" * 2999 + "y"]
    for k in range(120):  # words of few letters have many neighbours and runs
        words.append("".join(rng.choice(list("abÀ"), rng.integers(5, 9))))
    rows = [(None, "aaaaaa " * 7), (1, None), (2, ""), (3, "12 short wo rds"), (1, "AAAAAA aaaaab aaaaab")]
    for k in range(400):
        rows.append((k, " ".join(words[x] for x in np.minimum(rng.zipf(1.3, 12) - 1, len(words) - 1)) + " " + words[k % len(words)]))
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, word int, n string")
    found = [tuple(r) for r in spelling.variants(docs, most).select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(found) == len(set(found)) and set(found) == variants_by_force(rows)
    assert spelling.variants(docs.limit(0)).count() == 0


def test_wavelet_tree():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 37, 64):
        values = rng.permutation(n)
        tree = spelling.WaveletTree(values)
        lo, least = rng.integers(0, n + 1, 50), rng.integers(0, n + 1, 50)
        hi, end = np.minimum(n, lo + rng.integers(0, n + 1, 50)), np.minimum(n, least + rng.integers(0, n + 1, 50))
        query, value = tree.report(lo, hi, least, end)
        want = {(q, v) for q in range(50) for v in values[lo[q] : hi[q]] if least[q] <= v < end[q]}
        assert len(query) == len(want) and set(zip(query.tolist(), value.tolist(), strict=True)) == want


def trie_by_force(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest(), role, text))
    for v in own.values():
        v.sort()
    built = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = [x[3:] for x in own.get(c - c % 5, [])[:h] + v[h:]]
    members = defaultdict(list)
    for c, v in built.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    out, leaves, saved = set(), {}, {}
    for p in sorted(members, key=len, reverse=True):
        m = members[p]
        leaves[p] = sum(leaves[k] for k in children[p]) or 1
        saved[p] = sum(saved[k] for k in children[p]) + ((len(m) - 1) * len(p[-1][1].encode()) if p else 0)
        ends = ",".join(map(str, sorted(c for c in m if len(built[c]) == len(p))))
        out.add((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return out


TRIE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


@pytest.mark.parametrize("bounds", [(turn_trie.LOCAL_ROWS, turn_trie.LOCAL_IDS), (3, 50), (1, 1)])
def test_trie(spark, bounds):
    rng = np.random.default_rng(3)
    rows = [(None, 1, "user", "nobody"), (7, None, None, None), (7, None, "user", "é" * 9), (7, 2, "user", "b"), (7, 2, "bot", "b"), (7, 2, "bot", "b"), (4, 1, "user", "x" * 90_000)]
    for c in range(10, 130):  # few turns, so that prefixes are shared, chains are long and lists repeat
        rows += [(c, k, "user" if k % 2 else None, ["same", "other", "ünï"][min(2, int(rng.integers(0, 12) / 5 if k > 3 else 0))]) for k in range(int(rng.integers(0, 14)))]
    rows += [(c, k, "user", "hot") for c in range(200, 260) for k in range(12)]
    turns = spark.createDataFrame([(*r, "z", 1) for r in rows], "conv_id long, turn long, role string, text string, ids string, n int").repartition(3)
    found = [tuple(r) for r in turn_trie.trie(turns, *bounds).select(*TRIE).collect()]
    assert len(found) == len(set(found)) and set(found) == trie_by_force(rows)
    assert turn_trie.trie(turns.limit(0)).collect() == []


def test_ids_of_a_hot_list_are_digested_in_order(spark, monkeypatch):
    monkeypatch.setattr(turn_trie, "PIECE_IDS", 7)
    lists = spark.createDataFrame([(c, [1, 2] if c % 3 else [5], [1, 1] if c % 3 else [2]) for c in range(3000)], "conv_id long, ids array<long>, sizes array<long>").repartition(5)
    found = {tuple(r["ids"]): (r["n"], r["conv"], r["sha"]) for r in turn_trie.distinct_lists(lists).collect()}
    for ids, members in (((1, 2), [c for c in range(3000) if c % 3]), ((5,), [c for c in range(3000) if not c % 3])):
        assert found[ids] == (len(members), members[0], hashlib.sha256(",".join(map(str, members)).encode()).hexdigest())
