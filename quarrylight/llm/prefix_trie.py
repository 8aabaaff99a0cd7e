"""The trie of conversations by their turns, as a z-fast trie in tables.

A node of the compacted trie is a row: the edge that leads to it covers depths
``low`` + 1 to ``high``, and holds the codes of those prefixes. Its handle is the
prefix whose depth in (low, high] is two-fattest, divisible by the greatest power
of two; handles are the hash by which nodes are found. A conversation finds its
exit node by fat binary search: it asks for the prefix of two-fattest depth in
what is left of its range, goes on behind the node it meets or else before the
asked depth, so that a logarithm of its length is asked, each time by one
equality join of all conversations of the batch with the handles.

Batches are inserted until all are in: edges are split where conversations leave
or end, and of those that leave by the same new turn one, chosen by hash, is the
new edge; the others are located again in the next batch, from where they left.
In the end the edges are expanded to one node a turn.

A prefix is known by a 128-bit code chained over its turns. Texts stay behind at
the first step; a conversation's codes (16 bytes a turn) are one row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.llm.common import Scratch

#: The code of the empty prefix.
ROOT = b"\0" * 16
NONE_SHA = hashlib.sha256(b"").hexdigest()
#: Bytes of joined ids in a row, on their way to the digest of a node.
PIECE_BYTES = 1 << 16
NODE = "code binary, parent binary, low int, high int, first binary, handle binary, path array<binary>, words array<long>"


def two_fattest(low: Column, high: Column) -> Column:
    """The number in (low, high] that the greatest power of two divides: the common upper bits of both, then a one."""
    shift = (F.length(F.bin(low.cast("long").bitwiseXOR(high.cast("long")))) - 1).cast("int")
    return F.call_function("shiftleft", F.call_function("shiftright", high, shift), shift)


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): each conversation's turns as (code, words), by turn, null first; equal turns by role, then code.

    Null roles and texts are empty. Rows without a conv_id belong to no conversation.
    """
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    bare = F.trim(text, F.lit(" \t\n\x0b\x0c\r"))
    words = F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, "[ \t\n\x0b\x0c\r]+"))).cast("long")
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), role.alias("role"),
        F.unhex(F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))).alias("code"),
        words.alias("words"),
    )
    held = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "code", "words"))).alias("turns"))
    return held.select("conv_id", F.transform("turns", lambda t: F.struct(t["code"].alias("code"), t["words"].alias("words"))).alias("turns"))


def rebuilt(turns: DataFrame, group: int = 20, most: int = 4) -> DataFrame:
    """Each conversation c begins with the first h turns of conversation c - c % group and goes on with its own after its first h.

    h is the crc32 of the decimal id modulo ``most``. Fewer turns give what there is, an absent conversation nothing.
    """
    heads = turns.where(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, most - 1).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    joined = turns.withColumn("h", h).withColumn("base", F.col("conv_id") - F.col("conv_id") % group).join(heads, "base", "left")
    none = F.array().cast("array<struct<code:binary,words:bigint>>")
    own = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1)))
    return joined.select("conv_id", F.concat(F.slice(F.coalesce("head", none), 1, F.col("h")), own).alias("turns"))


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        codes, words, last = [], [], []
        for turns in batch.column("turns").to_pylist():
            at, row = ROOT, []
            for turn in turns:
                at = hashlib.blake2b(at + turn["code"], digest_size=16).digest()
                row.append(at)
            codes.append(row)
            words.append([t["words"] for t in turns])
            last.append(at)
        yield pa.record_batch(
            [batch.column("conv_id"), pa.array(last, pa.binary()), pa.array(codes, pa.list_(pa.binary())), pa.array(words, pa.list_(pa.int64()))],
            names=["conv_id", "last", "codes", "words"],
        )


def _located(asking: DataFrame, nodes: DataFrame, most: int) -> DataFrame:
    """The exit node of each asking row (seq, codes, words, at): its code and edge, or none where it leaves at a node, and ``lcp``.

    ``at`` is the depth of a node on the row's way; no range is longer than ``most``.
    """
    end = F.size("codes")
    state = asking.withColumn("from", F.col("at")).withColumn("to", end).withColumn("exit", F.lit(None).cast("binary"))
    handles = nodes.select(F.col("handle").alias("key"), F.col("code").alias("met"), F.col("high").alias("met_high"))
    for _ in range(most.bit_length()):
        open_ = F.col("from") < F.col("to")
        depth = F.when(open_, two_fattest(F.col("from"), F.col("to"))).otherwise(end)
        hit = state.withColumn("depth", depth).withColumn("key", F.element_at("codes", F.col("depth"))).join(handles, "key", "left")
        met = open_ & F.col("met").isNotNull()
        whole = met & (F.col("met_high") <= end) & (F.try_element_at("codes", F.coalesce("met_high", F.lit(1))) == F.col("met"))
        whole = F.coalesce(whole, F.lit(False))
        state = hit.select(
            "seq", "codes", "words",
            F.when(whole, F.col("met_high")).otherwise(F.col("from")).alias("from"),
            F.when(met & ~whole, F.col("from")).when(open_ & ~met, F.col("depth") - 1).otherwise(F.col("to")).alias("to"),
            F.when(met & ~whole, F.col("met")).otherwise(F.col("exit")).alias("exit"),
        )
    # Where no handle was met on the last edge, the next turn tells it.
    firsts = nodes.select(F.col("first").alias("key"), F.col("code").alias("child"))
    onward = F.when(F.col("exit").isNull() & (F.col("from") < end), F.col("from") + 1).otherwise(end)
    state = state.withColumn("key", F.element_at("codes", onward)).join(firsts, "key", "left").withColumn(
        "exit", F.when(F.col("exit").isNull() & (F.col("from") < end), F.col("child")).otherwise(F.col("exit"))
    )
    edges = nodes.select(F.col("code").alias("exit_code"), "low", "path")
    found = state.join(edges, state.exit == edges.exit_code, "left")
    shared = F.size(F.array_intersect("path", F.slice("codes", F.col("low") + 1, F.size("path"))))
    return found.select("seq", "codes", "words", "exit", F.when(F.col("exit").isNull(), F.col("from")).otherwise(F.col("low") + shared).alias("lcp"))


def _edge(code: Column, parent: Column, low: Column, high: Column, path: Column, words: Column) -> list[Column]:
    return [
        code.alias("code"), parent.alias("parent"), low.cast("int").alias("low"), high.cast("int").alias("high"),
        F.element_at(path, 1).alias("first"), F.element_at(path, two_fattest(low, high) - low).alias("handle"), path.alias("path"), words.alias("words"),
    ]


def _split(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """Every edge cut at the depths where rows of ``found`` leave it or end on it."""
    cuts = found.where("exit IS NOT NULL").groupBy(F.col("exit").alias("code")).agg(F.array_sort(F.collect_set("lcp")).alias("cuts"))
    ends = F.concat(F.coalesce("cuts", F.array().cast("array<int>")), F.array("high"))
    pieces = nodes.join(cuts, "code", "left").withColumn("ends", ends).select("*", F.posexplode("ends").alias("piece", "to"))
    low = F.when(F.col("piece") > 0, F.try_element_at("ends", F.greatest("piece", F.lit(1)))).otherwise(F.col("low"))
    pieces = pieces.withColumn("base", F.col("low")).withColumn("low", low)
    start, length = F.col("low") - F.col("base") + 1, F.col("to") - F.col("low")
    pieces = pieces.select(
        F.col("low"), F.col("to").alias("high"),
        F.when(F.col("piece") > 0, F.try_element_at("path", F.greatest(F.col("low") - F.col("base"), F.lit(1)))).otherwise(F.col("parent")).alias("parent"),
        F.slice("path", start, length).alias("path"), F.slice("words", start, length).alias("words"),
    )
    return pieces.select(*_edge(F.element_at("path", -1), F.col("parent"), F.col("low"), F.col("high"), F.col("path"), F.col("words")))


def insert_all(sequences: DataFrame, scratch: Scratch, nodes: DataFrame | None = None) -> DataFrame:
    """The compacted trie (``NODE``) of ``nodes``, if given, with the distinct ``sequences`` (seq, codes, words) inserted in batches."""
    spark = sequences.sparkSession
    nodes = nodes if nodes is not None else spark.createDataFrame([], NODE)
    pending, step, bare = sequences.where(F.size("codes") > 0).withColumn("at", F.lit(0)), 0, nodes.isEmpty()
    while True:
        left = pending.agg(F.max(F.size("codes") - F.col("at")).alias("most")).first()["most"]
        if left is None:
            return nodes
        step += 1
        if bare and step == 1:
            # An empty trie is left at the root.
            found = pending.select("seq", "codes", "words", F.lit(None).cast("binary").alias("exit"), F.lit(0).alias("lcp"))
        else:
            found = scratch.save(_located(pending, nodes, left), f"found-{step}")
        new = found.where(F.col("lcp") < F.size("codes"))
        branch = F.element_at("codes", F.col("lcp") + 1)
        chosen = new.groupBy(branch.alias("branch")).agg(F.min(F.struct(F.xxhash64("seq").alias("draw"), "seq")).alias("first")).select(F.col("first.seq").alias("seq"))
        chosen = scratch.save(chosen, f"chosen-{step}")
        size = F.size("codes")
        leaves = new.join(chosen, "seq", "left_semi").select(
            *_edge(
                F.element_at("codes", -1), F.when(F.col("lcp") > 0, F.try_element_at("codes", F.greatest("lcp", F.lit(1)))).otherwise(F.lit(ROOT)), F.col("lcp"), size,
                F.slice("codes", F.col("lcp") + 1, size), F.slice("words", F.col("lcp") + 1, size),
            )
        )
        nodes = scratch.save(_split(nodes, found).union(leaves), f"nodes-{step}")
        pending = scratch.save(new.join(chosen, "seq", "left_anti").select("seq", "codes", "words", F.col("lcp").alias("at")), f"pending-{step}")
        scratch.drop(f"nodes-{step - 1}", f"pending-{step - 1}", f"found-{step}", f"chosen-{step}")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of a node's ids, sorted, joined by commas in pieces of about ``PIECE_BYTES``."""
    at, first, held, size = None, None, [], 0
    for batch in batches:
        rows = []
        for code, conv in zip(batch.column("last").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
            if held and (code != at or size >= PIECE_BYTES):
                rows.append((at, first, ",".join(held)))
                held, size = [], 0
            if not held:
                at, first = code, conv
            held.append(str(conv))
            size += len(held[-1]) + 1
        yield pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.binary(), pa.int64(), pa.string()))], names=["last", "id", "piece"])
    if held:
        yield pa.record_batch([pa.array([at], pa.binary()), pa.array([first], pa.int64()), pa.array([",".join(held)], pa.string())], names=["last", "id", "piece"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of each node's pieces, in order; only the digest's state is held."""
    at, state = None, None
    for batch in batches:
        codes, shas = [], []
        for code, piece in zip(batch.column("last").to_pylist(), batch.column("piece").to_pylist(), strict=True):
            if code != at:
                if state:
                    codes.append(at)
                    shas.append(state.hexdigest())
                at, state = code, hashlib.sha256(piece.encode())
            else:
                state.update(b"," + piece.encode())
        yield pa.record_batch([pa.array(codes, pa.binary()), pa.array(shas, pa.string())], names=["code", "sha"])
    if state:
        yield pa.record_batch([pa.array([at], pa.binary()), pa.array([state.hexdigest()], pa.string())], names=["code", "sha"])


def end_digests(members: DataFrame, ends: DataFrame) -> DataFrame:
    """(code, sha): SHA-256 of the ids of the conversations that end at a node. A node of very many goes over several tasks as joined pieces.

    ``members`` has all (last, conv_id), ``ends`` each (last, seq, n): smallest id and number of those that end there.
    """
    single = ends.where("n = 1").select(F.col("last").alias("code"), F.sha2(F.col("seq").cast("string").cast("binary"), 256).alias("sha"))
    several = members.join(ends.where("n > 1").select("last"), "last").select("last", "conv_id")
    pieces = several.repartitionByRange("last", "conv_id").sortWithinPartitions("last", "conv_id").mapInArrow(_pieces, "last binary, id long, piece string")
    joined = pieces.repartition("last").sortWithinPartitions("last", "id").select("last", "piece").mapInArrow(_digests, "code binary, sha string")
    return single.union(joined)


def _measured(nodes: DataFrame, sequences: DataFrame, scratch: Scratch) -> DataFrame:
    """The nodes with what their subtrees hold.

    A sequence passes the nodes of its way, which its codes name. Each node's
    own figures are laid on its smallest sequence, which owns the lower end of
    its way; so sums over a subtree are sums of suffixes of ways.
    """
    ways = sequences.select("seq", "n", F.posexplode("codes").alias("depth", "code")).join(nodes.select("code"), "code")
    ways = scratch.save(ways, "ways")
    passed = ways.groupBy("code").agg(F.sum("n").alias("n_convs"), F.min("seq").alias("conv_id"))
    below = nodes.groupBy(F.col("parent").alias("code")).agg(F.count("*").alias("n_children"))
    edge_words = F.aggregate("words", F.lit(0).cast("long"), lambda a, w: a + w)
    known = nodes.join(passed, "code").join(below, "code", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    known = scratch.save(known.withColumn("edge_words", edge_words), "known")
    owned = known.select(
        F.col("conv_id").alias("seq"), "code", ((F.col("n_convs") - 1) * F.col("edge_words")).alias("saved"), (F.col("n_children") == 0).cast("long").alias("leaf")
    )
    onward = Window.partitionBy("seq").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    laid = ways.join(owned, ["seq", "code"], "left").select(
        "code", F.sum(F.coalesce("saved", F.lit(0).cast("long"))).over(onward).alias("saved"), F.sum(F.coalesce("leaf", F.lit(0).cast("long"))).over(onward).alias("leaves"),
    )
    return known.join(laid.groupBy("code").agg(F.sum("saved").alias("below"), F.sum("leaves").alias("n_leaves")), "code")


def conversation_trie(conversations: DataFrame, *, group: int = 20, most: int = 4, scratch: Scratch | None = None) -> DataFrame:
    """One row for each distinct sequence of first d rebuilt turns, down from the textless root (d = 0).

    (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256) as the query's contract has them. An empty table, or one without
    any conv_id, has no conversation and so no row. Repeated rows are turns like
    others. Other columns are ignored.
    """
    scratch = scratch or Scratch(conversations.sparkSession, "trie")
    chained = scratch.save(rebuilt(ordered_turns(conversations), group, most).mapInArrow(_chained, "conv_id long, last binary, codes array<binary>, words array<long>"), "chained")
    ends = scratch.save(chained.groupBy("last").agg(F.min("conv_id").alias("seq"), F.count("*").alias("n")), "ends")
    sequences = scratch.save(chained.select(F.col("conv_id").alias("seq"), "codes", "words").join(ends.select("seq", "n"), "seq"), "sequences")
    nodes = insert_all(sequences.select("seq", "codes", "words"), scratch)
    full = scratch.save(
        _measured(nodes, sequences, scratch).join(end_digests(chained.select("last", "conv_id"), ends), "code", "left").drop("first", "handle"), "measured"
    )
    whole = full.where("low = 0").agg(
        F.count("*").alias("children"), F.coalesce(F.sum("n_leaves"), F.lit(0)).alias("leaves"), F.coalesce(F.sum("below"), F.lit(0)).alias("saved")
    )
    sums = ends.agg(F.min("seq").alias("conv_id"), F.sum("n").alias("n_convs")).where("conv_id IS NOT NULL")
    turnless = scratch.save(end_digests(chained.where(F.col("last") == F.lit(ROOT)).select("last", "conv_id"), ends.where(F.col("last") == F.lit(ROOT))), "turnless")
    one = whole.first()
    top = sums.join(turnless, turnless.code == F.lit(ROOT), "left").select(
        "conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", F.lit(one["children"]).cast("long").alias("n_children"),
        F.lit(max(one["leaves"], 1)).cast("long").alias("n_leaves"), F.lit(one["saved"]).cast("long").alias("saved_tokens"), F.coalesce("sha", F.lit(NONE_SHA)).alias("ends_sha256"),
    )
    # Parents by their codes; the children of the root take its id.
    root_id = F.lit(sums.agg(F.min("conv_id")).first()[0]).cast("long")
    over = full.select(F.col("code").alias("parent"), F.col("conv_id").alias("above"))
    edges = full.join(over, "parent", "left").withColumn("above", F.coalesce("above", root_id))
    turns = edges.select("*", F.posexplode("words").alias("at", "turn_words")).withColumn("deepest", F.col("at") == F.size("words") - 1)
    # Words of the edge before this turn do not belong to its subtree.
    before = F.aggregate(F.slice("words", 1, F.col("at")), F.lit(0).cast("long"), lambda a, w: a + w)
    expanded = turns.select(
        "conv_id", (F.col("low") + F.col("at") + 1).cast("long").alias("depth"), F.when(F.col("at") == 0, F.col("above")).otherwise(F.col("conv_id")).alias("parent_conv_id"),
        "n_convs", F.when(F.col("deepest"), F.col("n_children")).otherwise(F.lit(1)).cast("long").alias("n_children"), "n_leaves",
        (F.col("below") - (F.col("n_convs") - 1) * before).alias("saved_tokens"),
        F.when(F.col("deepest"), F.coalesce("sha", F.lit(NONE_SHA))).otherwise(F.lit(NONE_SHA)).alias("ends_sha256"),
    )
    return top.union(expanded)
