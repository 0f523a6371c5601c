"""Providers with limits, retries and breakers; rules as a table; chunks in SQL."""

import random
import threading
import time

import pytest
from pyspark.sql import functions as F

from estimora.functions import patterns
from estimora.operators import chunking, generation
from estimora.plans import catalog

D = "/root/testdata/sf0.001"


def test_limits_reach_the_provider(spark):
    rows = spark.createDataFrame([(k, f"p{k}") for k in range(50)], "k long, p string").repartition(3)
    provider = lambda: lambda prompt, limits: f"{prompt} {limits.max_tokens} {limits.temperature}"
    assert {r["reply"] for r in generation.generated(rows, "p", [provider]).collect()} == {f"p{k} 1500 0.1" for k in range(50)}
    assert generation.generated(rows.limit(1), "p", [provider], limits=generation.Limits(9, 0.0)).first()["reply"].endswith(" 9 0.0")


def test_calls_run_at_once_and_keep_their_order(spark):
    def slow():
        running, most, lock = [0], [0], threading.Lock()

        def call(prompt):
            with lock:
                running[0] += 1
                most[0] = max(most[0], running[0])
            time.sleep(0.02 if prompt.endswith("0") else 0.005)
            with lock:
                running[0] -= 1
            return f"{prompt}:{most[0]}"

        return call

    rows = spark.createDataFrame([(k, f"{k}") for k in range(60)], "k long, p string").coalesce(1)
    found = [r for r in generation.generated(rows, "p", [slow], policy=generation.Policy(at_once=5)).collect()]
    assert all(r["reply"].split(":")[0] == str(r["k"]) for r in found)
    assert 1 < max(int(r["reply"].split(":")[1]) for r in found) <= 5


def test_tries_and_breaker():
    asked = []

    def flaky():
        def call(prompt):
            asked.append(prompt)
            if len(asked) % 3:
                raise RuntimeError("busy")
            return "ok"

        return call

    policy = generation.Policy(tries=3, pause=0.0, failures=9)
    assert generation.Chain([flaky], generation.Limits(), policy).ask("x") == ("ok", None) and asked == ["x"] * 3
    assert generation.Chain([flaky], generation.Limits(), generation.Policy(tries=2, pause=0.0)).ask(None) == (None, "RuntimeError: busy")
    down, up = [], [False]

    def broken():
        def call(prompt):
            down.append(prompt)
            if not up[0]:
                raise OSError("down")
            return "up"

        return call

    chain = generation.Chain([broken, lambda: lambda p: "second"], generation.Limits(), generation.Policy(failures=3, rest=0.05))
    assert [chain.ask(str(k)) for k in range(10)] == [("second", None)] * 10 and down == ["0", "1", "2"]  # open after three
    time.sleep(0.06)
    assert chain.ask("a") == ("second", None) and chain.ask("b") == ("second", None) and down[3:] == ["a"]  # one trial, open again
    time.sleep(0.06)
    up[0] = True
    assert chain.ask("c") == ("up", None) and chain.ask("d") == ("up", None)
    alone = generation.Chain([broken], generation.Limits(), generation.Policy(failures=1, rest=9))
    up[0] = False
    assert alone.ask("x")[1] == "OSError: down" and alone.ask("x") == (None, "Unavailable: the provider failed too often")


def test_breaker_lets_one_call_try():
    now = [0.0]
    b = generation.Breaker(2, 10, lambda: now[0])
    for _ in range(2):
        assert b.allows()
        b.tell(False)
    assert not b.allows()
    now[0] = 10.0
    assert b.allows() and not b.allows()  # a second one waits for the first
    b.tell(True)
    assert b.allows() and b.allows()


def test_automaton_by_force():
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(1, 5)))
    for _ in range(200):
        rules = [(str(k), [word() for _ in range(rng.randint(0, 3))]) for k in range(8)]
        text = "".join(rng.choice("abcd") for _ in range(rng.randint(0, 30)))
        assert patterns.Automaton(rules).matched(text) == {k for k, (_, words) in enumerate(rules) if any(x in text for x in words)}


def test_ten_thousand_words(spark):
    rules = [(f"r{k}", [f"word{k}x", f"{k}other"]) for k in range(5000)]
    rows = spark.createDataFrame([(1, "a WORD17x and 4999other " + "nothing " * 2000), (2, None), (3, "")], "k long, t string")
    began = time.monotonic()
    found = {r["k"]: r["m"] for r in rows.select("k", patterns.matched(F.col("t"), rules).alias("m")).collect()}
    assert found[2] == found[3] == [] and {"r17", "r4999"} <= set(found[1]) and found[1] == sorted(found[1], key=lambda x: int(x[1:]))
    assert set(found[1]) == {f"r{k}" for k in range(5000) if f"word{k}x" in "a word17x and 4999other" or f"{k}other" in "a word17x and 4999other"}
    assert time.monotonic() - began < 20


def test_chunks_in_sql(spark):
    rows = lambda name: sorted(tuple(r) for r in catalog.QUERIES[name](spark, D).select("doc_id", "chunk_no", "chunk").collect())
    assert rows("chunks_in_sql") == rows("recursive_chunks")
    chunking.register(spark)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "a b")], "doc_id long, text string")
    assert [tuple(r) for r in spark.sql("SELECT doc_id, chunk FROM {t}, LATERAL recursive_chunks(text)", t=odd).collect()] == [(3, "a b")]


def test_break_even_by_force(spark):
    part, line = (spark.read.parquet(f"{D}/{t}.parquet").toPandas() for t in ("part", "lineitem"))
    line["month"] = line["l_shipdate"].map(lambda d: d.replace(day=1))
    found = {r["suite"]: r for r in catalog.QUERIES["automation_break_even"](spark, D).collect()}
    for key, size in zip(part["p_partkey"], part["p_size"], strict=True):
        setup, gain, done, hit = (key % 17 + 1) * 320, size * 15, 0, None
        for month, runs in sorted(line[line["l_partkey"] == key].groupby("month").size().items()):
            done += runs
            if done * gain >= setup:
                hit = (str(month)[:7], done)
                break
        assert (key in found) == (hit is not None)
        if hit:
            r = found[key]
            assert (r["month"], r["done"]) == hit and (r["cycles"] - 1) * gain < setup <= r["cycles"] * gain


@pytest.mark.parametrize("name", ["rules_matched", "classify_by_table"])
def test_rules_are_registered(name):
    assert name in catalog.ORACLES
