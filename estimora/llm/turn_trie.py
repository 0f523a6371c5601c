"""A prefix trie of conversations by distributed radix partitioning.

Turns get an id from a dictionary of digests of role and text, so that a conversation is a list of
ids. Equal lists are one row with their number and smallest conv_id. From the root on, the rows of a
node are dealt by their next id (the most significant digit first): a bucket of more than LOCAL_ROWS
rows is cut again, below the ids that all its rows share, which are the common prefix of its least
and greatest row; smaller buckets go whole to tasks, where multikey quicksort finishes them and emits
a node for each run of equal ids. What nodes sum over their subtrees goes up again cut by cut.

Buckets' sizes are partial aggregates and the buckets that are cut again are a bounded share of all
rows, so no task or driver holds a hot one. The ids of a hot list's conversations are written as text
in order by many tasks; one task passes the pieces through SHA-256, which has no other way.

Defined results: rows with a null conv_id are of no conversation; turns of one number go by the digest
of role and text; an empty table gives no rows; repeated rows are turns of their own; texts of any
length are digested whole; a conversation's ids and lengths, 16 bytes a turn, are held as a row;
further columns are ignored, whatever they are called.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from estimora.llm.shared import bounded, saved

#: A conversation keeps the first turns of the one whose id is the multiple of SHARED at or before its
#: own, as many as the checksum of its id leaves when divided by HEADS.
SHARED, HEADS = 5, 9
#: Rows and ids of a bucket that a task finishes, at most, unless it is one row.
LOCAL_ROWS, LOCAL_IDS = 20_000, 4_000_000
#: conv_ids in one piece of text.
PIECE_IDS = 4096

EMPTY = hashlib.sha256(b"").hexdigest()
_NODES = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, top boolean"
_NODE_COLUMNS = [x.split()[0] for x in _NODES.split(", ")]


def encoded(turns: DataFrame) -> DataFrame:
    """conv_id, turn, sha, id and size (bytes of the text) of turns(conv_id, turn, role, text)."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    sha = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
    rows = saved(turns.filter("conv_id IS NOT NULL").select("conv_id", "turn", sha.alias("sha"), F.octet_length(text).cast("long").alias("size")), "turns")
    dictionary = saved(rows.select("sha").distinct().withColumn("id", F.monotonically_increasing_id()), "dictionary")
    return rows.join(dictionary, "sha")


def rebuilt(turns: DataFrame) -> DataFrame:
    """conv_id, ids and sizes of the rebuilt conversations."""
    order = F.struct(F.col("turn").isNotNull().alias("known"), "turn", "sha", "id", "size")
    own = saved(encoded(turns).groupBy("conv_id").agg(F.array_sort(F.collect_list(order)).alias("t")).select("conv_id", F.col("t.id").alias("ids"), F.col("t.size").alias("sizes")), "conversations")
    head = own.select(F.col("conv_id").alias("base"), F.slice("ids", 1, HEADS - 1).alias("head_ids"), F.slice("sizes", 1, HEADS - 1).alias("head_sizes"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).cast("int")
    rows = own.withColumns({"base": F.col("conv_id") - F.col("conv_id") % SHARED, "h": h}).join(head, "base", "left")

    def joined(head: str, own: str) -> F.Column:
        first = F.when(F.col("h") > 0, F.slice(F.coalesce(head, F.array().cast("array<long>")), F.lit(1), F.col("h"))).otherwise(F.array().cast("array<long>"))
        return F.concat(first, F.slice(own, F.col("h") + 1, F.greatest(F.size(own), F.lit(1))))

    return rows.select("conv_id", joined("head_ids", "ids").alias("ids"), joined("head_sizes", "sizes").alias("sizes"))


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """g, first and text: conv_ids of rows in order of (g, conv_id), comma-joined some thousand at a time."""
    out, now, ids = [], None, []

    def close():
        if ids:
            out.append((now, ids[0], ",".join(map(str, ids))))

    def batch():
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.binary(), pa.int64(), pa.string()), strict=True)], ["g", "first", "text"])

    for b in batches:
        for g, conv in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if g != now or len(ids) == PIECE_IDS:
                close()
                now, ids = g, []
            ids.append(conv)
        if len(out) > 1000:
            yield batch()
            out = []
    close()
    if out:
        yield batch()


def piece_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """g and sha of the pieces of each g, which come one after another."""
    now, state, found = None, None, []
    for b in batches:
        for g, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if g != now:
                if state:
                    found.append((now, state.hexdigest()))
                now, state = g, hashlib.sha256(text.encode())
            else:
                state.update(b"," + text.encode())
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], t) for k, t in enumerate((pa.binary(), pa.string()))], ["g", "sha"])
        found = []
    if state:
        yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([state.hexdigest()])], ["g", "sha"])


def distinct_lists(conversations: DataFrame) -> DataFrame:
    """ids, sizes, n, conv (the smallest) and sha (digest of all conv_ids) of each distinct list."""
    g = F.unhex(F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256))
    rows = saved(conversations.withColumn("g", g), "rebuilt")
    groups = saved(rows.groupBy("g").agg(F.count("*").alias("n"), F.min("conv_id").alias("conv"), F.first("ids").alias("ids"), F.first("sizes").alias("sizes")), "groups")
    several = rows.select("g", "conv_id").join(groups.filter("n > 1").select("g"), "g", "left_semi")
    text = several.repartitionByRange("g", "conv_id").sortWithinPartitions("g", "conv_id").mapInArrow(pieces, "g binary, first long, text string")
    digests = text.repartition("g").sortWithinPartitions("g", "first").select("g", "text").mapInArrow(piece_digests, "g binary, sha string")
    alone = F.sha2(F.col("conv").cast("string").cast("binary"), 256)
    return groups.join(digests, "g", "left").select("ids", "sizes", "n", "conv", F.coalesce("sha", alone).alias("sha"))


def finished(bucket: list[tuple], parent: int, depth: int) -> list[tuple]:
    """The nodes below a bucket's parent node: bucket holds (ids, sizes, n, conv, sha) of distinct lists
    that agree in their first `depth` ids, and in the next one. Multikey quicksort: rows are parted by
    their id at a depth into less, equal and greater; the equal ones are a node, a depth further on."""
    conv, depths, parents, n, own, children, sha = [], [], [], [], [], [], []

    def node(rows: list[tuple], d: int, above: int) -> int:
        conv.append(min(r[3] for r in rows))
        depths.append(d)
        parents.append(above)
        n.append(sum(r[2] for r in rows))
        own.append((n[-1] - 1) * rows[0][1][d - 1])
        children.append(0)
        sha.append(EMPTY)
        if above >= 0:
            children[above] += 1
        return len(conv) - 1

    work = [(bucket, depth, -1)]
    while work:
        rows, d, above = work.pop()
        if len(rows) == 1:
            for k in range(d, len(rows[0][0])):
                above = node(rows, k + 1, above)
            sha[above] = rows[0][4]
            continue
        digit = [r[0][d] if d < len(r[0]) else -1 for r in rows]
        pivot = digit[len(digit) // 2]
        less, equal, more = [], [], []
        for r, x in zip(rows, digit, strict=True):
            (less if x < pivot else equal if x == pivot else more).append(r)
        work += [(part, d, above) for part in (less, more) if part]
        if pivot < 0:
            sha[above] = equal[0][4]
        else:
            work.append((equal, d + 1, node(equal, d + 1, above)))
    leaves, total = [int(not c) for c in children], own
    for k in range(len(conv) - 1, 0, -1):  # a node comes after its parent
        leaves[parents[k]] += leaves[k]
        total[parents[k]] += total[k]
    return [(conv[k], depths[k], conv[parents[k]] if parents[k] >= 0 else parent, n[k], children[k], leaves[k], total[k], sha[k], parents[k] < 0) for k in range(len(conv))]


def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of all buckets of a task, whose rows come bucket by bucket."""
    types = [pa.int64()] * 7 + [pa.string(), pa.bool_()]
    out: list[tuple] = []
    bucket: list[tuple] = []
    now = None

    def batch():
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], _NODE_COLUMNS)

    for b in batches:
        for conv, depth, next_, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if (conv, depth, next_) != now:
                if bucket:
                    out += finished(bucket, now[0], now[1])
                now, bucket = (conv, depth, next_), []
            bucket.append(tuple(row))
        if len(out) > 20_000:
            yield batch()
            out = []
    if bucket:
        out += finished(bucket, now[0], now[1])
    if out:
        yield batch()


def shared_ids(lo, hi):
    """The number of leading ids that two lists share."""
    differ = F.array_position(F.zip_with(lo, hi, lambda x, y: x.eqNullSafe(y)), False)
    return F.when(differ > 0, differ - 1).otherwise(F.least(F.size(lo), F.size(hi))).cast("long")


def nodes(lists: DataFrame, most_rows: int = LOCAL_ROWS, most_ids: int = LOCAL_IDS) -> DataFrame:
    """All nodes of the trie over lists(ids, sizes, n, conv, sha), a saved table of distinct lists."""
    active = lists.withColumns({"b": F.lit(None).cast("long"), "d": F.lit(0).cast("long")})
    top = lists.agg(F.min("conv"), F.sum("n")).first()
    if top[0] is None:
        return lists.sparkSession.createDataFrame([], _NODES).drop("top")
    active = active.withColumn("b", F.lit(top[0]).cast("long"))
    cuts, local, ended = [], [], []
    while True:
        ended.append(active.filter(F.size("ids") == F.col("d")).select(F.col("b").alias("conv"), F.col("d").alias("depth"), "sha"))
        open_ = active.filter(F.size("ids") > F.col("d")).withColumn("next", F.element_at("ids", (F.col("d") + 1).cast("int")))
        counts = open_.groupBy("b", "d", "next").agg(F.count("*").alias("rows"), F.sum(F.size("ids") - F.col("d")).alias("n_ids"))
        large = saved(counts.filter((F.col("rows") > 1) & ((F.col("rows") > most_rows) | (F.col("n_ids") > most_ids))).select("b", "d", "next"), "large")
        if not large.limit(1).count():
            local.append(open_)
            break
        # buckets that are cut hold most_rows or most_ids each, so there are few of them
        rest = open_.join(large, ["b", "d", "next"], "left_anti")
        stay = saved(open_.join(large, ["b", "d", "next"], "left_semi"), "stay")
        ends = stay.groupBy("b", "d", "next").agg(F.sum("n").alias("n"), F.min("conv").alias("conv"), F.min(F.struct("ids", "sizes")).alias("lo"), F.max("ids").alias("hi"))
        cut = saved(ends.select("b", "d", "next", "n", "conv", F.col("lo.sizes").alias("sizes"), shared_ids(F.col("lo.ids"), F.col("hi")).alias("depth")), "cut")
        cuts.append(cut)
        local.append(rest)
        active = saved(stay.join(cut.select("b", "d", "next", F.col("conv").alias("b2"), F.col("depth").alias("d2")), ["b", "d", "next"]).select("ids", "sizes", "n", "conv", "sha", F.col("b2").alias("b"), F.col("d2").alias("d")), "active")
    columns = ["b", "d", "next", "ids", "sizes", "n", "conv", "sha"]
    buckets = _union([x.select(*columns) for x in local])
    found = saved(bounded(buckets.repartition("b", "d", "next").sortWithinPartitions("b", "d", "next")).mapInArrow(finish, _NODES), "nodes")
    return found.drop("top").unionByName(_cut_nodes(found, cuts, _union(ended), top))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def _cut_nodes(found: DataFrame, cuts: list[DataFrame], ended: DataFrame, root: tuple) -> DataFrame:
    """The nodes of buckets that were cut again, and the root: sums go up from the last cut to the first."""
    sums = (F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    below = found.filter("top").groupBy(F.col("parent_conv_id").alias("conv"), (F.col("depth") - 1).alias("depth")).agg(*sums)
    ended = ended.select("conv", "depth", "sha")
    out = []
    for cut in reversed(cuts):
        each = cut.join(below, ["conv", "depth"]).join(ended, ["conv", "depth"], "left")
        each = each.withColumn("k", F.explode(F.sequence(F.col("d") + 1, F.col("depth"))))
        own = (F.col("n") - 1) * F.aggregate(F.slice("sizes", F.col("k").cast("int"), (F.col("depth") - F.col("k") + 1).cast("int")), F.lit(0).cast("long"), lambda a, x: a + x)
        last = F.col("k") == F.col("depth")
        chain = saved(
            each.select(
                F.col("conv").alias("conv_id"), F.col("k").alias("depth"), F.when(F.col("k") == F.col("d") + 1, F.col("b")).otherwise(F.col("conv")).alias("parent_conv_id"), F.col("n").alias("n_convs"),
                F.when(last, F.col("n_children")).otherwise(1).cast("long").alias("n_children"), "n_leaves", (F.col("saved_tokens") + own).alias("saved_tokens"),
                F.when(last, F.coalesce("sha", F.lit(EMPTY))).otherwise(EMPTY).alias("ends_sha256"), (F.col("k") == F.col("d") + 1).alias("top"),
            ), "chain",
        )
        out.append(chain.drop("top"))
        above = chain.filter("top").groupBy(F.col("parent_conv_id").alias("conv"), (F.col("depth") - 1).alias("depth")).agg(*sums)
        below = below.unionByName(above).groupBy("conv", "depth").agg(*(F.sum(c).alias(c) for c in ("n_children", "n_leaves", "saved_tokens")))
    spark = found.sparkSession
    first = spark.createDataFrame([(root[0], 0, root[1])], "conv long, depth long, n long").join(below, ["conv", "depth"], "left").join(ended, ["conv", "depth"], "left")
    zero = lambda c, x: F.coalesce(c, F.lit(x)).cast("long").alias(c)
    out.append(first.select(F.col("conv").alias("conv_id"), "depth", F.lit(None).cast("long").alias("parent_conv_id"), F.col("n").alias("n_convs"), zero("n_children", 0), zero("n_leaves", 1), zero("saved_tokens", 0), F.coalesce("sha", F.lit(EMPTY)).alias("ends_sha256")))
    return _union(out)


def trie(turns: DataFrame, most_rows: int = LOCAL_ROWS, most_ids: int = LOCAL_IDS) -> DataFrame:
    """The trie of the rebuilt conversations of turns(conv_id, turn, role, text), a row for each node."""
    return nodes(saved(distinct_lists(rebuilt(turns)), "lists"), most_rows, most_ids)
