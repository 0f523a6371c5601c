"""Exact duplicates with a heavy-hitter split, in DataFrame functions alone.

Texts are equal when they are after all characters of `[\\x20\\x09-\\x0D]` are deleted. Digests of the
texts are written once, without the texts. Misra-Gries summaries of the digests (Spark's frequent
items sketch, which lowers all counters by their median when it is full) are merged in two steps and
name every digest with a notable share of the rows. The winners of those few are found by an exact
aggregate, which confirms them, and are broadcast: their rows are decided where they lie and never
shuffled. All other digests are frequent nowhere, and are grouped and joined by ordinary shuffles.
What the summaries name decides only which way a digest goes, never a result.

Defined results: a null text is an empty one, and all empty texts are equal; an empty table gives no
rows; of equal texts the row with the most code points in its original text stays, then the one with
the smallest doc_id, null ids last; of rows that repeat an id and a text one stays; texts of any
length are digested whole; further columns are ignored, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estimora.llm.shared import saved, unused

#: Counters of a summary, which is then off by at most some 1/4700 of the rows, and the share of the
#: rows from which a digest is heavy. At most 1/(HEAVY_SHARE - 1/4700), some 3,500, digests can be.
COUNTERS, HEAVY_SHARE = 10_000, 1 / 2000
#: Summaries that are merged in one step before the last.
MERGED_AT_ONCE = 256


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", "")


def digested(docs: DataFrame) -> DataFrame:
    """row (distinct), doc_id, n (code points of the original text) and sha (32 bytes)."""
    sha = F.unhex(F.sha2(normalised(F.col("text")).cast("binary"), 256))
    n = F.coalesce(F.length("text"), F.lit(0))
    return docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", n.alias("n"), sha.alias("sha"))


def heavy_digests(digests: DataFrame) -> DataFrame:
    """The digests that may be of HEAVY_SHARE of the rows or more: none that is goes missing."""
    # one summary for each group of tasks, then one of these: no task merges those of all
    group = F.floor(F.spark_partition_id() / MERGED_AT_ONCE)
    some = digests.groupBy(group.alias("g")).agg(F.expr(f"approx_top_k_accumulate(hex(sha), {COUNTERS})").alias("s"), F.count("*").alias("n"))
    every = some.groupBy(F.lit(1).alias("g")).agg(F.expr(f"approx_top_k_combine(s, {COUNTERS})").alias("s"), F.sum("n").alias("n"))
    found = every.select("n", F.explode(F.expr(f"approx_top_k_estimate(s, {COUNTERS})")).alias("x"))
    return found.filter((F.col("x.count") >= F.col("n") * HEAVY_SHARE) & (F.col("x.count") > 1)).select(F.unhex("x.item").alias("sha"))


def winners(digests: DataFrame) -> DataFrame:
    """sha, keep_row, keep_id and group_size: a partial aggregate, so that no task gathers a group."""
    rank = F.struct((-F.col("n")).alias("n"), F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    return digests.groupBy("sha").agg(F.min(rank).alias("w"), F.count("*").alias("group_size")).select("sha", F.col("w.row").alias("keep_row"), F.col("w.doc_id").alias("keep_id"), "group_size")


def decided(digests: DataFrame) -> DataFrame:
    """digests, a saved table, with the row that stays of each group."""
    heavy = saved(heavy_digests(digests), "heavy")
    confirmed = saved(winners(digests.join(F.broadcast(heavy), "sha", "left_semi")), "winners")
    frequent = digests.join(F.broadcast(confirmed), "sha")
    rest = digests.join(F.broadcast(heavy), "sha", "left_anti")
    return frequent.unionByName(rest.join(winners(rest), "sha"))


def groups(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of each row of docs(doc_id, text)."""
    found = decided(saved(digested(docs), "digests"))
    return found.select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns; no text is shuffled but those of rows that
    repeat an id and a text."""
    id_, sha, n = unused(docs, "k_id"), unused(docs, "k_sha"), unused(docs, "k_n")
    digests = saved(digested(docs), "digests")
    kept = decided(digests).filter("row = keep_row").select(F.col("doc_id").alias(id_), F.col("sha").alias(sha), F.col("n").alias(n))
    times = digests.groupBy(F.col("doc_id").alias(id_), F.col("sha").alias(sha), F.col("n").alias(n)).agg(F.count("*").alias("times"))
    same = lambda a, b: a[id_].eqNullSafe(b[id_]) & (a[sha] == b[sha]) & (a[n] == b[n])
    kept = kept.alias("a").join(times.alias("b"), F.expr(f"a.{id_} <=> b.{id_} AND a.{sha} = b.{sha} AND a.{n} = b.{n}")).select(f"a.{id_}", f"a.{sha}", f"a.{n}", "b.times")
    kept = saved(kept, "kept")
    keyed = docs.withColumns({sha: F.unhex(F.sha2(normalised(F.col("text")).cast("binary"), 256)), n: F.coalesce(F.length("text"), F.lit(0)), id_: F.col("doc_id")})
    once, again = kept.filter("times = 1"), kept.filter("times > 1")
    single = keyed.join(once, same(keyed, once), "left_semi")
    repeated = keyed.join(again, same(keyed, again), "left_semi").dropDuplicates([id_, sha, n])
    return single.unionByName(repeated).select(*docs.columns)
