"""Prefix trie of conversations by prefix doubling.

1. Each turn gets a dense name: distinct turns are numbered 0, 1, ...
2. Up: two neighbouring blocks of 2^k turns are one block of 2^(k+1); distinct pairs of
   names get dense names. All aligned blocks of a conversation are named in log2(turns)
   joins, over half as many rows each.
3. Down: a prefix of d turns is the blocks that d's binary digits say. From the longest
   block to the shortest, the name of a prefix that ends with a block of 2^k turns is
   the dense name of (name of what stands before it, name of the block).
4. Prefixes of equal length and name are a node. Sums over subtrees double too: after k
   rounds a node knows its descendants less than 2^k below, and adds what those
   exactly 2^k below know, whose ancestor is found by their own conversation and depth.

Rows are conversations' prefixes, so the work is turns times log2(turns of the longest
conversation), and neither a conversation nor a node's members ever meet in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm.cluster import HOT, durable, hot_keys, lookup

#: Keys that one task numbers, copies of a turn that one row makes, and ids in one piece of a digest's input.
NAMED, COPIES, CHUNK = 1 << 14, 4096, 4096
_WORD = r"[^\x20\x09-\x0D]+"


def dense_names(rows: DataFrame, key: str, bound: int) -> DataFrame:
    """The distinct values of ``key`` as (key, n, name): n counts rows, names are 0, 1, ...

    Buckets of keys by hash are numbered apart and moved by the sizes of the buckets
    before. ``bound`` is at least the number of distinct keys and sets the buckets.
    """
    buckets = max(1, bound // NAMED)
    counts = rows.groupBy(key).agg(F.count("*").alias("n")).withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(buckets)))
    own = durable(counts.withColumn("_place", F.row_number().over(Window.partitionBy("_bucket").orderBy(key))))
    sizes = own.groupBy("_bucket").agg(F.count("*").alias("_k"))
    before = sizes.select("_bucket", (F.sum("_k").over(Window.orderBy("_bucket")) - F.col("_k")).alias("_before"))
    return own.join(before, "_bucket").select(key, "n", (F.col("_before") + F.col("_place") - 1).alias("name"))


def named(rows: DataFrame, key: str, bound: int, spread: Column) -> DataFrame:
    """``rows`` with ``key`` replaced by its dense ``name``, as a written table. Frequent keys are looked up by broadcast."""
    names = dense_names(rows, key, bound)
    hot = names.where(F.col("n") * HOT > bound).select(key)
    return durable(lookup(rows, names.select(key, "name"), key, hot, spread).drop(key))


def number_turns(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv, pos (from 0, by turn, null first, equal turns by the SHA-256 of role and text), digest, words.

    A null role or text is empty; a null conv_id names no conversation. Texts are digested
    where they are read and never shuffled. Equal rows are counted first and unfolded
    afterwards; conversations with more than one in HOT of all rows are numbered by
    ranges of turns, in many tasks.
    """
    role, text = F.coalesce(F.col(role_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = conversations.where(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), digest.alias("digest"), F.regexp_count(text, F.lit(_WORD)).cast("long").alias("words"))
    once = durable(rows.groupBy("conv", "turn", "digest").agg(F.count("*").alias("copies"), F.first("words").alias("words")))
    order, earlier = ["turn", "digest"], lambda w: F.coalesce(F.sum("copies").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    hot = hot_keys(once.groupBy("conv").agg(F.count("*").alias("count")), "conv")
    few = once.join(F.broadcast(hot), "conv", "left_anti").withColumn("start", earlier(Window.partitionBy("conv").orderBy(*order)))
    parts = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    many = durable(once.join(F.broadcast(hot), "conv", "left_semi").repartitionByRange(parts, "conv", *order).withColumn("part", F.spark_partition_id()))
    sizes = many.groupBy("conv", "part").agg(F.sum("copies").alias("copies"))
    # a part holds a stretch of turns, so there are at most HOT more of these rows than parts
    offsets = sizes.select("conv", "part", earlier(Window.partitionBy("conv").orderBy("part")).alias("offset"))
    many = many.withColumn("inside", earlier(Window.partitionBy("conv", "part").orderBy(*order))).join(F.broadcast(offsets), ["conv", "part"])
    both = few.select(*once.columns, "start").unionByName(many.select(*once.columns, (F.col("inside") + F.col("offset")).alias("start")))
    # two steps, so that no row holds a list as long as its copies are many
    block = both.withColumn("block", F.explode(F.expr(f"sequence(0L, (copies - 1) div {COPIES})")))
    copy = block.withColumn("copy", F.explode(F.expr(f"sequence(block * {COPIES}, least(copies, (block + 1) * {COPIES}) - 1)")))
    return copy.select("conv", (F.col("start") + F.col("copy")).alias("pos"), "digest", "words")


def share_heads(turns: DataFrame, every: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Rebuild each conversation c of (conv, pos, ...) behind the head of conversation c - c % ``every``.

    The head is that conversation's first h turns (all if it has fewer, none if it is
    absent), h = crc32 of c in decimal % ``most``; c's own turns after its first h follow.
    Returns the turns, and every conv with its number of turns, which may be 0.
    """
    rest = [c for c in turns.columns if c not in ("conv", "pos")]
    sizes = durable(turns.groupBy("conv").agg(F.count("*").alias("own")))
    heads = sizes.select("conv", "own", F.expr(f"conv - conv % {every}").alias("donor"), F.expr(f"crc32(cast(cast(conv as string) as binary)) % {most}").alias("h"))
    heads = heads.join(sizes.select(F.col("conv").alias("donor"), F.col("own").alias("_has")), "donor", "left")
    heads = durable(heads.select("conv", "donor", "h", F.least("h", F.coalesce("_has", F.lit(0))).alias("k"), "own"))
    given = turns.where((F.col("pos") < most - 1) & (F.col("conv") % every == 0)).withColumnRenamed("conv", "donor")
    head = heads.where("k > 0").select("conv", "donor", "k").join(given, "donor").where("pos < k").select("conv", "pos", *rest)
    own = lookup(turns, heads.select("conv", "h", "k"), "conv", hot_keys(sizes, "conv", "own"), F.col("pos"))
    own = own.where("pos >= h").select("conv", (F.col("pos") - F.col("h") + F.col("k")).alias("pos"), *rest)
    return head.unionByName(own), heads.select("conv", (F.col("k") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("length"))


def prefix_names(turns: DataFrame, lengths: DataFrame, bound: int, longest: int) -> DataFrame:
    """(conv, depth, name) of every prefix, the empty one included; prefixes of one length are equal if their names are.

    turns: conv, pos, name. lengths: conv, length. bound: at least the number of turns.
    """
    levels = [turns.select("conv", F.col("pos").alias("j"), "name")]
    while 2 << len(levels) - 1 <= longest:
        half = bound >> len(levels)
        side = lambda odd: F.max(F.when(F.col("j") % 2 == odd, F.col("name")))
        pairs = levels[-1].groupBy("conv", F.expr("j div 2").alias("j")).agg(side(0).alias("a"), side(1).alias("b")).where("b is not null")
        levels.append(named(pairs.select("conv", "j", F.struct("a", "b").alias("pair")), "pair", half, F.xxhash64("conv", "j")))
    # prefixes of j blocks of the level above; at first the empty one alone
    prefixes = lengths.select("conv", F.lit(0).cast("long").alias("j"), F.lit(0).cast("long").alias("name"))
    for k in range(len(levels) - 1, -1, -1):
        last = levels[k].where("j % 2 = 0").select("conv", F.expr("j div 2").alias("j"), F.col("name").alias("b"))
        joined = last.join(prefixes, ["conv", "j"]).select("conv", F.expr("2 * j + 1").alias("j"), F.struct(F.expr("2 * j + 1").alias("j"), F.col("name").alias("a"), "b").alias("pair"))
        longer = named(joined, "pair", max(1, (bound >> k)), F.xxhash64("conv", "j"))
        prefixes = longer.select("conv", "j", "name").unionByName(prefixes.withColumn("j", F.col("j") * 2))
    return prefixes.withColumnRenamed("j", "depth")


def _digests(ends: DataFrame) -> DataFrame:
    """node, ends_sha256 of (node, conv): sorted ids in pieces by range, then the pieces through one SHA-256 a node."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, out = None, [], ([], [], [])

        def close() -> None:
            if held:
                for column, value in zip(out, (now, held[0], ",".join(map(str, held)))):
                    column.append(value)
                held.clear()

        def ready() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())], names=["node", "least", "ids"])
            for column in out:
                column.clear()
            return batch

        for batch in batches:
            for node, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if node != now or len(held) >= CHUNK:
                    close()
                    now = node
                held.append(conv)
            if len(out[0]) >= CHUNK:
                yield ready()
        close()
        yield ready()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, running = None, None
        for batch in batches:
            nodes, done = [], []
            for node, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if node != now:
                    if running:
                        nodes.append(now)
                        done.append(running.hexdigest())
                    now, running = node, hashlib.sha256(ids.encode())
                else:
                    running.update(b"," + ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.string()), pa.array(done, pa.string())], names=["node", "ends_sha256"])
        if running:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.string()), pa.array([running.hexdigest()], pa.string())], names=["node", "ends_sha256"])

    parts = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = ends.select("node", "conv").repartitionByRange(parts, "node", "conv").sortWithinPartitions("node", "conv").mapInArrow(pieces, "node string, least long, ids string")
    return cut.repartition("node").sortWithinPartitions("node", "least").select("node", "ids").mapInArrow(digest, "node string, ends_sha256 string")


def prefix_trie(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """One row for each distinct prefix of the conversations.

    turns: conv, pos (gapless from 0), digest (equal if and only if turns are), words.
    lengths: every conv once, with its number of turns (0 if it has none). Returns
    conv_id (least member), depth, parent_conv_id (null for the root), n_convs,
    n_children, n_leaves (childless nodes in the subtree, its top included),
    saved_tokens (over the subtree, members but one times the words of a node's last
    turn) and ends_sha256 (of the decimal ids of the conversations that end here,
    ascending, comma-joined). No conversations, no rows.
    """
    lengths = durable(lengths)
    size = lengths.agg(F.sum("length"), F.max("length"), F.count("*")).first()
    bound, longest = int(size[0] or 0), int(size[1] or 0)
    turns = named(turns, "digest", max(1, bound), F.xxhash64("conv", "pos"))
    member = durable(prefix_names(turns, lengths, bound, longest).select("conv", "depth", F.concat_ws("/", "depth", "name").alias("node")))
    words = turns.select(F.col("conv").alias("least"), (F.col("pos") + 1).alias("depth"), "words")
    nodes = member.groupBy("node").agg(F.min("conv").alias("least"), F.first("depth").alias("depth"), F.count("*").alias("n_convs"))
    nodes = nodes.join(words, ["least", "depth"], "left")
    above = member.select(F.col("conv").alias("least"), (F.col("depth") + 1).alias("depth"), F.col("node").alias("parent"))
    nodes = durable(nodes.join(above, ["least", "depth"], "left"))
    children = durable(nodes.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children")))
    nodes = nodes.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    sums = durable(nodes.withColumn("n_leaves", (F.col("n_children") == 0).cast("long")).withColumn("saved", (F.col("n_convs") - 1) * F.coalesce("words", F.lit(0))))
    step = 1
    while step <= longest:
        up = member.select(F.col("conv").alias("least"), (F.col("depth") + step).alias("depth"), F.col("node").alias("above"))
        lower = sums.where(F.col("depth") >= step).select("least", "depth", "n_leaves", "saved").join(up, ["least", "depth"])
        more = lower.groupBy(F.col("above").alias("node")).agg(F.sum("n_leaves").alias("_leaves"), F.sum("saved").alias("_saved"))
        joined = sums.join(more, "node", "left")
        sums = durable(joined.withColumn("n_leaves", F.col("n_leaves") + F.coalesce("_leaves", F.lit(0))).withColumn("saved", F.col("saved") + F.coalesce("_saved", F.lit(0))).drop("_leaves", "_saved"))
        step *= 2
    ends = lengths.join(member, (lengths.conv == member.conv) & (lengths.length == member.depth)).select("node", lengths.conv)
    tops = sums.join(children.select("node"), "node", "left_semi").select(F.col("node").alias("parent"), F.col("least").alias("parent_conv_id"))
    found = sums.join(_digests(ends), "node", "left")
    # a node may have most of all nodes as its children
    found = lookup(found, tops, "parent", hot_keys(children, "node", "n_children").withColumnRenamed("node", "parent"), F.xxhash64("node"))
    empty = hashlib.sha256(b"").hexdigest()
    return found.select(F.col("least").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256"))


def conversation_trie(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", every: int = 0) -> DataFrame:
    """The prefix trie of a table of turns; ``every`` > 0 rebuilds conversations by ``share_heads`` first.

    Nulls, ties and repeated rows as in ``number_turns``; texts of any length are
    digested and counted in place; an empty table gives no rows; other columns are not
    read, so their names may clash.
    """
    turns = durable(number_turns(conversations, conv_col, turn_col, role_col, text_col))
    if every:
        turns, lengths = share_heads(turns, every)
        turns = durable(turns)
    else:
        lengths = turns.groupBy("conv").agg(F.count("*").alias("length"))
    return prefix_trie(turns, lengths)
