"""Jaccard join on word shingles by a grouped prefix join.

A document's shingles are ordered by how common they are, rare ones first, and then by hash. Two
sets that are similar enough share shingles of their prefixes, so only prefixes are indexed.
Documents with the same prefix and size make one group, which stands for its members in the
index; pairs of groups are filtered by size, by the number of prefix shingles that either shares
with any other, and by the number that they share with each other; the pairs that remain are
expanded to their members, and these are verified on whole sets.

What is asked for are the classes of linked documents, so pairs whose link is already implied by
others need no verification. Verification comes in two passes: first each group with two of those
it meets in each list of the index (the one whose prefix is shared the most, as the original of
many near copies is, and the next in size), then all pairs left of groups that the first pass put
into different classes. No pair of different classes that passes the filters is skipped. Members of one
group that are of different classes meet by what follows their prefix: their sets are equally large
and have the prefix in common, so that a link asks for a shingle in common among the next few, too.

Lists of shingles that very many documents hold are split: the count that orders the shingles also
says, where a prefix is made, in how many parts a list is dealt. Windows run over parts, lists are
summed up by partial aggregates, and a part meets the others of its list as copies, of about its own
sizes only. So a task holds about 2**PART_LEVEL entries of a list, or, where tables are so large that
more than FREQUENT shingles are that common, some millionths of all entries.

Shingles and sets are compared by 64-bit hashes. Defined results: a null or empty text, or one of
white space alone, has no shingles and its own class; a text with fewer words than a shingle is
one shingle; repeated rows are equal sets; rows that share an id count as one document; a null id
has a null class; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from estimora.llm.arrays import constants, grams, mixed, row_chunks, text_bytes, words
from estimora.llm.components import connected
from estimora.llm.shared import bounded, dropped, joined_by_id, saved

#: Shingles that a task counts at once, and how many of the most frequent ones have a level of their
#: own in the order (9 bytes each). Any order gives the same classes; a good one has short lists.
COUNTED_AT_ONCE, FREQUENT = 2_000_000, 1_000_000
#: Logarithm of the documents from which on the list of a shingle is dealt in parts.
PART_LEVEL = 15
#: Words of 64 bits of a group's sketch of its shared prefix shingles: a power of two.
WORDS = 4


def shingles(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of all texts, one text after another, and the row of each."""
    hashes, rows, _, _ = words(*text_bytes(texts), "blank")
    found, at = grams(hashes, rows, size, 5)
    n = len(texts)
    per_row = np.bincount(rows, minlength=n)
    few = np.flatnonzero((per_row > 0) & (per_row < size))
    if len(few):
        firsts = np.searchsorted(rows, few)
        with np.errstate(over="ignore"):
            c = constants(size, 77)
            whole = np.array([mixed((hashes[a : a + per_row[r]] * c[: per_row[r]]).sum(keepdims=True) + np.uint64(per_row[r]))[0] for a, r in zip(firsts, few, strict=True)], np.uint64)
        found, of = np.concatenate([found, whole]), np.concatenate([rows[at], few])
        order = np.argsort(of, kind="stable")
        return found[order], of[order]
    return found, rows[at]


def sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """The sorted distinct shingles of each text."""
    found, of = shingles(texts, size)
    edges = np.searchsorted(of, np.arange(len(texts) + 1))
    out = []
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        x = np.sort(found[a:b])
        out.append(x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x)
    return out


def frequent(docs: DataFrame, size: int, most: int = FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of about the most frequent shingles of all documents, `most` at most, and a
    level for each: the logarithm of how often tasks have seen it more than twice."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def repeated() -> pa.RecordBatch:
            x, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(x[n > 2].view(np.int64)), pa.array(n[n > 2].astype(np.int64))], ["h", "n"])

        for chunk in row_chunks(batches, "text"):
            held.append(shingles(chunk.column("text"), size)[0])
            if sum(map(len, held)) > COUNTED_AT_ONCE:
                yield repeated()
        if held:
            yield repeated()

    counts = bounded(docs).select("text").mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    top = counts.filter("n >= 8").orderBy(F.desc("n"), "h").limit(most).select("h", F.log2("n").cast("int").alias("level")).toArrow()
    hashes = top.column("h").to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], top.column("level").to_numpy().astype(np.int8)[order]


def by_level(x: np.ndarray, common: np.ndarray, levels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of a sorted set's shingles, rare ones first, and the level of each."""
    level = np.zeros(len(x), np.int8)
    if len(common) and len(x):
        at = np.minimum(np.searchsorted(common, x), len(common) - 1)
        level = np.where(common[at] == x, levels[at], 0)
    return np.argsort(level, kind="stable"), level


def prefix_length(n: int, num: int, den: int) -> int:
    """Sets that link with a set of n share a shingle with this many of its first."""
    return n - (num * n + den - 1) // den + 1 if n else 0


def prefixes(docs: DataFrame, last: Broadcast, size: int, num: int, den: int, part_level: int) -> DataFrame:
    """doc_id, n (size of the set), sig (hash of the set), gkey (hash of size and prefix), prefix, and
    halvings: for each shingle of the prefix how often its list is halved into parts.

    A task gives the prefix of a group once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (common, levels), seen = last.value, set()
        for chunk in row_chunks(batches, "text"):
            ns, sigs, keys, heads, halvings = [], [], [], [], []
            for x in sets(chunk.column("text"), size):
                n = len(x)
                with np.errstate(over="ignore"):
                    sig = int(mixed(x * np.uint64(0xD6E8FEB86659FD93)).sum()) if n else 0
                    order, level = by_level(x, common, levels)
                    order = order[: prefix_length(n, num, den)]
                    head = x[order]
                    key = int(mixed((mixed(head + np.uint64(n)) * np.uint64(3)).sum(keepdims=True))[0]) if n else 0
                ns.append(n)
                sigs.append(sig)
                keys.append(key)
                known = key in seen or not n
                heads.append(None if known else head.view(np.int64))
                halvings.append(None if known else np.maximum(level[order].astype(np.int32) - part_level, 0))
                if len(seen) < 1_000_000:
                    seen.add(key)
            yield pa.RecordBatch.from_arrays([chunk.column("doc_id"), pa.array(ns, pa.int32()), pa.array(np.array(sigs, np.uint64).view(np.int64)), pa.array(np.array(keys, np.uint64).view(np.int64)), pa.array(heads, pa.list_(pa.int64())), pa.array(halvings, pa.list_(pa.int32()))], ["doc_id", "n", "sig", "gkey", "prefix", "halvings"])

    return bounded(docs).select("doc_id", "text").mapInArrow(run, "doc_id long, n int, sig long, gkey long, prefix array<long>, halvings array<int>")


def followers(docs: DataFrame, ids: DataFrame, last: Broadcast, size: int, num: int, den: int) -> DataFrame:
    """cid and h: the shingles behind the prefix of each document of ids, of which two equally large
    sets with one prefix share at least one if they link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, levels = last.value
        for chunk in row_chunks(batches, "text"):
            found = []
            for x in sets(chunk.column("text"), size):
                n = len(x)
                begin, both = prefix_length(n, num, den), (2 * n * num + num + den - 1) // (num + den)
                found.append(x[by_level(x, common, levels)[0][begin : begin + n - both + 1]].view(np.int64))
            yield pa.RecordBatch.from_arrays([chunk.column("doc_id"), pa.array(found, pa.list_(pa.int64()))], ["cid", "x"])

    some = joined_by_id(bounded(docs).select("doc_id", "text"), ids, "doc_id", "left_semi")
    return some.mapInArrow(run, "cid long, x array<long>").select("cid", F.explode("x").alias("h")).distinct()


def verified(pairs: DataFrame, docs: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """Those pairs(a, b) of doc ids whose whole sets are similar enough."""
    pairs = saved(pairs.distinct(), "pairs")
    ids = saved(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in row_chunks(batches, "text"):
            found = sets(chunk.column("text"), size)
            yield pa.RecordBatch.from_arrays([chunk.column("doc_id"), pa.array([x.view(np.int64) for x in found], pa.list_(pa.int64()))], ["doc_id", "x"])

    whole = saved(joined_by_id(bounded(docs).select("doc_id", "text"), ids, "doc_id", "left_semi").mapInArrow(run, "doc_id long, x array<long>"), "sets")
    both = pairs.join(whole.withColumnsRenamed({"doc_id": "a", "x": "xa"}), "a").join(whole.withColumnsRenamed({"doc_id": "b", "x": "xb"}), "b")
    shared = F.size(F.array_intersect("xa", "xb"))
    out = saved(both.filter(shared * (num + den) >= (F.size("xa") + F.size("xb")) * num).select("a", "b"), "links")
    for x in (pairs, ids, whole):
        dropped(x)
    return out


def classes(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100, part_level: int = PART_LEVEL) -> DataFrame:
    """doc_id, n_shingles and component_id of each row of docs(doc_id, text): documents link where
    den * shared >= num * united of their sets of `size`-word shingles."""
    last = docs.sparkSession.sparkContext.broadcast(frequent(docs, size))
    every = saved(prefixes(docs, last, size, num, den, part_level), "prefixes")
    least = lambda n: F.expr(f"({n} * {num} + {den - 1}) div {den}")
    need = lambda: F.expr(f"((n + n2) * {num} + {num + den - 1}) div {num + den}") - F.greatest(least("n"), least("n2")) + 1
    near = (F.col("n2") * den >= F.col("n") * num) & (F.col("n") * den >= F.col("n2") * num)

    same = every.filter("n > 0").groupBy("gkey", "n", "sig").agg(F.min("doc_id").alias("cid"))
    members = saved(same.filter("cid IS NOT NULL"), "members")
    groups = members.groupBy("gkey", "n").agg(F.min("cid").alias("head"))

    # the index: lists with more than one group, and for each entry how many lists its group is in
    part = W.Window.partitionBy("h", "part")
    parts = F.expr("shiftleft(1, halved)")  # of a list
    entries = every.filter("prefix IS NOT NULL").select(F.explode(F.arrays_zip("prefix", "halvings")).alias("e"), "gkey", "n")
    entries = entries.select(F.col("e.prefix").alias("h"), F.least(F.col("e.halvings"), F.lit(24)).alias("halved"), "gkey", "n")
    entries = entries.withColumn("part", F.when(F.col("halved") > 0, F.pmod(F.xxhash64("gkey"), parts)).otherwise(0).cast("int")).repartition("h", "part")
    shared = entries.withColumns({"lo": F.min("gkey").over(part), "hi": F.max("gkey").over(part)}).filter("lo < hi OR halved > 0")
    shared = saved(shared.select("h", "part", "halved", "gkey", "n").dropDuplicates(["h", "part", "gkey"]), "shared")
    bits = [F.expr(f"bit_or(CASE WHEN (shiftright(h, 6) & {WORDS - 1}) = {j} THEN shiftleft(1L, CAST(h & 63 AS INT)) ELSE 0L END)").alias(f"b{j}") for j in range(WORDS)]
    sketch = saved(shared.groupBy("gkey").agg(F.count("*").cast("int").alias("k"), *bits), "sketch")
    index = shared.join(sketch.select("gkey", "k"), "gkey")
    other = F.struct(F.col("gkey").alias("g2"), F.col("n").alias("n2"), F.col("k").alias("k2"))
    best = F.max_by(other, F.struct("k", -F.col("n"), "gkey"))
    # lists in parts are of frequent shingles, so that these are FREQUENT rows at most
    hubs = index.filter("halved > 0").groupBy("h").agg(best.alias("top"))
    index = index.withColumns({"own": best.over(part), "prior": F.lag(other).over(part.orderBy("n", "gkey"))})
    index = saved(index.join(F.broadcast(hubs), "h", "left").withColumn("hub", F.coalesce("top", "own")).drop("own", "top"), "index")

    # first pass
    enough = (F.col("k") >= need()) & (F.col("k2") >= need())
    met = index.select("gkey", "n", "k", "hub.*").union(index.filter("prior IS NOT NULL").select("gkey", "n", "k", "prior.*")).filter("gkey != g2").filter(near & enough)
    met = met.groupBy("gkey", "n", "g2", "n2").agg(F.count("*").alias("met")).filter(F.col("met") * 3 >= need())
    heads = groups.select("gkey", F.col("head").alias("a"))
    first = met.join(heads, "gkey").join(heads.select(F.col("gkey").alias("g2"), F.col("a").alias("b")), "g2").select("a", "b")
    within = members.join(groups, ["gkey", "n"]).filter("cid != head").select(F.col("head").alias("a"), F.col("cid").alias("b"))
    links = verified(first.union(within).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), docs, size, num, den)

    # second pass: pairs of groups whose members are not all of one class yet
    star = connected(links)
    labelled = members.join(star.withColumnRenamed("node", "cid"), "cid", "left").select("cid", "gkey", "n", F.coalesce("component", "cid").alias("comp"))
    labelled = saved(labelled, "labelled")
    spans = labelled.groupBy("gkey").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    left = shared.join(sketch, "gkey").join(spans, "gkey")
    every_part = F.explode(F.sequence(F.lit(0), parts - 1)).alias("part")
    mixed_lists = left.groupBy("h", "halved").agg(F.min("lo").alias("x"), F.max("hi").alias("y")).filter("x < y").select("h", every_part)
    # sets of similar sizes are of the same step or of neighbours: a little more than den / num apart
    left = left.withColumn("step", F.floor(F.log("n") / max(1.001 * math.log(den / num), 0.01)).cast("int"))
    left = saved(left.join(mixed_lists, ["h", "part"], "left_semi"), "left")
    other = left.select("h", every_part, "step", *[F.col(c).alias(c + "2") for c in ("gkey", "n", "k", "lo", "hi", *(f"b{j}" for j in range(WORDS)))])
    other = other.withColumn("step", F.explode(F.array(F.col("step") - 1, F.col("step"))))  # the larger set of a pair
    open_pair = (F.col("lo") != F.col("hi")) | (F.col("lo2") != F.col("hi2")) | (F.col("lo") != F.col("lo2"))
    # a bit of one sketch that the other lacks is a shingle, at least, that they don't share
    lacking = lambda x, y: sum(F.bit_count(F.col(f"b{j}{x}").bitwiseAND(F.bitwise_not(f"b{j}{y}"))) for j in range(WORDS))
    sharing = (F.col("k") - lacking("", "2") >= need()) & (F.col("k2") - lacking("2", "") >= need())
    after = F.struct("n", "gkey") < F.struct("n2", "gkey2")
    pairs = left.join(other, ["h", "part", "step"]).filter(after & near & enough & sharing & open_pair)
    pairs = pairs.groupBy("gkey", "gkey2", "n", "n2").agg(F.count("*").alias("met")).filter(F.col("met") >= need()).select("gkey", "gkey2")
    mine, theirs = labelled.select("gkey", F.col("cid").alias("a"), F.col("comp").alias("ca")), labelled.select(F.col("gkey").alias("gkey2"), F.col("cid").alias("b"), F.col("comp").alias("cb"))
    rest = pairs.join(mine, "gkey").join(theirs, "gkey2").filter("ca != cb").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    split = saved(labelled.join(spans.filter("lo < hi").select("gkey"), "gkey", "left_semi"), "split")
    ids = saved(split.select(F.col("cid").alias("doc_id")).distinct(), "ids")
    next_ones = split.join(followers(docs, ids, last, size, num, den), "cid").select("gkey", "h", "comp", "cid").distinct()
    lists = next_ones.groupBy("gkey", "h").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x < y").select("gkey", "h")
    next_ones = saved(next_ones.join(lists, ["gkey", "h"], "left_semi"), "next")
    inner = next_ones.select("gkey", "h", F.col("comp").alias("ca"), F.col("cid").alias("a"))
    inner = inner.join(next_ones.select("gkey", "h", F.col("comp").alias("cb"), F.col("cid").alias("b")), ["gkey", "h"])
    more = verified(rest.union(inner.filter("a < b AND ca != cb").select("a", "b")), docs, size, num, den)

    final = connected(star.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more))
    known = members.join(final.withColumnRenamed("node", "cid"), "cid", "left").select("gkey", "n", "sig", F.coalesce("component", "cid").alias("component_id"))
    for x in (shared, sketch, index, left, labelled, links, split, ids, next_ones, more):
        dropped(x)
    out = every.select("doc_id", "n", "sig", "gkey").join(known, ["gkey", "n", "sig"], "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
