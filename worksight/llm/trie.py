"""Prefix trie of conversations from vertical bitmaps.

A shard is a range of ``WIDTH`` conversation ids, so a set of its
conversations is a bitset over ``conv_id % WIDTH``.  A tile is a shard and a
block of ``BLOCK`` positions.  Inside a tile every (position, turn) has a
posting, the bitset of conversations that have this turn there.  A
depth-first walk intersects the bitset of a node with the postings of the
next position: the results are its children, their popcounts are member
counts, and the bits of conversations of just that length are its end list.

Tiles are bounded however long or frequent a conversation is.  A node is
named by the XOR of two 64-bit hashes of (position, turn) along its path, the
same in all tiles, so nodes of different tiles are merged by grouping, with
one row for each task after partial aggregation.

Sums over a subtree need no pass for each depth.  The owner of a node is its
smallest member, and the nodes of one owner are a chain down to a childless
end or to where the conversation stops.  A subtree is the owner's chain from
the node on, and the whole chains of all other members.

Rows without conv_id are left out.  Turns go by number, null first; turns
with equal numbers by the SHA-256 of role and text; repeated rows are
repeated turns.  An empty table has no nodes.  Only the four named columns
are read, others do no harm.  Turns are told apart by 128 bits of SHA-256.
"""

import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..plans.materialize import materialize
from ..plans.rank import global_rank

c = F.col

WIDTH_BITS = 7          # conversations of a shard: 128
BLOCK_BITS = 8          # positions of a tile: 256
WIDTH = 1 << WIDTH_BITS
#: Turns that a conversation may take from the head of its group.
HEADS = 8
GROUP = 5

LOCAL = ("k1 long, k2 long, p1 long, p2 long, shard long, block long, depth long, conv_id long, n long, size long, "
         "members binary, ends binary")
KEY = ["k1", "k2"]


def _digest(role: Column, text: Column) -> Column:
    """128 bits of SHA-256; the length of the role keeps role and text apart."""
    whole = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary")
    return F.unhex(F.substring(F.sha2(whole, 256), 1, 32))


def number(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns with their place in one order of the whole table, and conversations with their first place and length."""
    role, text = (F.coalesce(c(x).cast("string"), F.lit("")) for x in ("role", "text"))
    rows = turns.where("conv_id is not null").select(
        c("conv_id").cast("long").alias("conv_id"), c("turn").cast("long").alias("turn"), _digest(role, text).alias("digest"),
        F.octet_length(text).cast("long").alias("size"))
    placed = global_rank(rows, [c("conv_id"), c("turn").asc_nulls_first(), c("digest")], "place")
    return placed.drop("turn"), placed.groupBy("conv_id").agg(F.count("*").alias("n"), F.min("place").alias("first"))


def plain(turns: DataFrame) -> DataFrame:
    """Conversations as they are: rows (conv_id, pos, digest, size, length); position 0 is the textless root."""
    placed, convs = number(turns)
    rows = placed.join(convs, "conv_id").select("conv_id", (c("place") - c("first") + 1).alias("pos"), "digest", "size",
                                                c("n").alias("length"))
    return rows.unionByName(_roots(convs.withColumnRenamed("n", "length")))


def with_shared_heads(turns: DataFrame) -> DataFrame:
    """Conversations c that begin with the first ``crc32(c) % 9`` turns of conversation ``c - c % 5``, then go on
    with their own turns after as many.  Rows as those of ``plain``.

    At most 9 conversations share a head of at most 8 turns, so the join of heads multiplies by a fixed bound.
    """
    placed, convs = number(turns)
    convs = convs.withColumns({"h": F.crc32(c("conv_id").cast("string").cast("binary")) % (HEADS + 1),
                               "base": c("conv_id") - c("conv_id") % GROUP})
    bases = convs.select(c("conv_id").alias("base"), c("n").alias("base_n"))
    shared = F.least("h", F.coalesce("base_n", F.lit(0).cast("long")))
    convs = materialize(convs.join(bases, "base", "left").withColumn("shared", shared)
                        .withColumn("length", c("shared") + F.greatest(c("n") - c("h"), F.lit(0))), "trie-conversations")
    numbered = materialize(
        placed.join(convs.select("conv_id", "first", "h", "shared", "length"), "conv_id")
        .withColumn("pos", c("place") - c("first") + 1).drop("place", "first"), "trie-turns")
    own = numbered.where("pos > h").withColumn("pos", c("pos") - c("h") + c("shared"))
    heads = (numbered.where((c("pos") <= HEADS) & (c("conv_id") % GROUP == 0))
             .select(c("conv_id").alias("base"), "pos", "digest", "size")
             .join(convs.where("shared > 0").select("base", "conv_id", "shared", "length"), "base").where("pos <= shared"))
    columns = ["conv_id", "pos", "digest", "size", "length"]
    return own.select(columns).unionByName(heads.select(columns)).unionByName(_roots(convs))


def _roots(convs: DataFrame) -> DataFrame:
    return convs.select("conv_id", F.lit(0).cast("long").alias("pos"), F.lit(None).cast("binary").alias("digest"),
                        F.lit(0).cast("long").alias("size"), "length")


def _tiles(rows: DataFrame, block_bits: int) -> DataFrame:
    """Turns with the hashes of their place and text, and for later blocks the name of the node they start from."""
    some = c("digest").isNotNull()
    zero = F.lit(0).cast("long")
    rows = materialize(rows.select(
        F.shiftright("conv_id", WIDTH_BITS).alias("shard"), F.shiftright("pos", block_bits).alias("block"), "conv_id", "pos",
        F.when(some, F.xxhash64("pos", "digest")).otherwise(zero).alias("h1"),
        F.when(some, F.xxhash64("digest", "pos", F.lit("second"))).otherwise(zero).alias("h2"), "size", "length"), "trie-rows")
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = (rows.where(c("length") >= 1 << block_bits).groupBy("shard", "conv_id", "block", "length")
              .agg(F.bit_xor("h1").alias("x1"), F.bit_xor("h2").alias("x2"))
              .select("shard", "block", "conv_id", F.lit(-1).cast("long").alias("pos"), F.bit_xor("x1").over(earlier).alias("h1"),
                      F.bit_xor("x2").over(earlier).alias("h2"), F.lit(0).cast("long").alias("size"), "length")
              .where("block > 0"))
    return rows.unionByName(starts)


def _bits(members: int) -> bytes:
    return members.to_bytes(WIDTH // 8, "little")


def _walk(tile: pa.Table, block_bits: int) -> pa.Table:
    """All nodes of one tile, by depth-first intersection of bitsets."""
    shard, block = tile["shard"][0].as_py(), tile["block"][0].as_py()
    first = block << block_bits
    bit = [1 << x for x in (tile["conv_id"].to_numpy() & (WIDTH - 1)).tolist()]
    postings, starts, has, final = defaultdict(int), defaultdict(int), defaultdict(int), defaultdict(int)
    turn = {}
    for b, pos, h1, h2, size, length in zip(bit, *(tile[x].to_pylist() for x in ("pos", "h1", "h2", "size", "length"))):
        if pos < 0:
            starts[h1, h2] |= b
            continue
        postings[pos, h1, h2] |= b
        has[pos] |= b
        turn[b, pos] = (h1, h2, size)
        if pos == length:
            final[pos] |= b
    if not block:
        starts[0, 0] = has[0]
    out, stack = [], [(members, first - 1, *key) for key, members in starts.items()]
    while stack:
        parent, pos, k1, k2 = stack.pop()
        pos += 1
        rest = parent & has[pos]
        while rest:
            lowest = rest & -rest
            h1, h2, size = turn[lowest, pos]
            child = parent & postings[pos, h1, h2]
            rest &= ~child
            ends = child & final[pos]
            out.append((k1 ^ h1, k2 ^ h2, k1 if pos else None, k2 if pos else None, shard, block, pos,
                        (shard << WIDTH_BITS) + lowest.bit_length() - 1, child.bit_count(), size, _bits(child),
                        _bits(ends) if ends else None))
            stack.append((child, pos, k1 ^ h1, k2 ^ h2))
    return pa.Table.from_pylist([dict(zip(_LOCAL.names, x)) for x in out], schema=_LOCAL)


_LOCAL = pa.schema([(x.split()[0], {"long": pa.int64(), "binary": pa.binary()}[x.split()[1]]) for x in LOCAL.split(", ")])


def _member_sums(nodes: pa.Table, owners: pa.Table) -> pa.Table:
    """For each node of a tile the sum over its members of what their chains hold."""
    sums = {x: np.zeros(len(nodes), np.int64) for x in ("saved", "leaves")}
    if len(nodes) and len(owners):
        data = b"".join(nodes["members"].to_pylist())
        member = np.unpackbits(np.frombuffer(data, np.uint8).reshape(len(nodes), -1), axis=1, bitorder="little").astype(bool)
        place = owners["conv_id"].to_numpy() & (WIDTH - 1)
        for name, into in sums.items():
            of = np.zeros(WIDTH, np.int64)
            of[place] = owners[name].to_numpy()
            into += np.where(member, of, 0).sum(axis=1)
    return pa.table({"k1": nodes["k1"], "k2": nodes["k2"], **sums})


def _end_hashes(batches):
    """SHA-256 of each node's end list, from chunks in order of node and shard; only one state is held."""
    key, state = None, None
    for batch in batches:
        out = []
        for k1, k2, shard, ends in zip(*(batch.column(x).to_pylist() for x in ("k1", "k2", "shard", "ends"))):
            ids = np.flatnonzero(np.unpackbits(np.frombuffer(ends, np.uint8), bitorder="little"))
            text = ",".join(map(str, (ids + (shard << WIDTH_BITS)).tolist())).encode()
            if key != (k1, k2):
                if key:
                    out.append((*key, state.hexdigest()))
                key, state = (k1, k2), hashlib.sha256(text)
            else:
                state.update(b"," + text)
        yield _hashes(out)
    if key:
        yield _hashes([(*key, state.hexdigest())])


def _hashes(rows: list) -> pa.RecordBatch:
    columns = zip(*rows) if rows else ([], [], [])
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int64(), pa.string()))],
                                      names=["k1", "k2", "ends_sha256"])


def _rest_of_chain(nodes: DataFrame, block_bits: int) -> DataFrame:
    """(k1, k2, rest): what the chain of a node's owner saves from this node on.

    Sums inside a block of positions, plus the sums of later blocks: no window holds more than one of both.
    """
    block = F.shiftright("depth", block_bits)
    down = Window.partitionBy("conv_id", "block").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    later = Window.partitionBy("conv_id").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    nodes = nodes.withColumn("block", block)
    blocks = nodes.groupBy("conv_id", "block").agg(F.sum("own_saved").alias("whole"))
    blocks = blocks.withColumn("later", F.sum("whole").over(later)).where("later is not null").drop("whole")
    inside = nodes.select(*KEY, "conv_id", "block", F.sum("own_saved").over(down).alias("rest"))
    return (inside.join(blocks, ["conv_id", "block"], "left")
            .select(*KEY, (c("rest") + F.coalesce("later", F.lit(0))).alias("rest")))


def prefix_trie(rows: DataFrame, block_bits: int = BLOCK_BITS) -> DataFrame:
    """One row for each node of the trie over rows of ``plain`` or ``with_shared_heads``: conv_id (smallest member),
    depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    walked = _tiles(rows, block_bits).groupBy("shard", "block").applyInArrow(lambda tile: _walk(tile, block_bits), LOCAL)
    local = materialize(walked, "trie-tiles")
    nodes = local.groupBy(*KEY).agg(F.max("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.sum("n").alias("n_convs"),
                                    F.max("size").alias("size"), F.max("p1").alias("p1"), F.max("p2").alias("p2"))
    nodes = materialize(nodes.withColumn("own_saved", (c("n_convs") - 1) * c("size")), "trie-nodes")
    children = nodes.where("p1 is not null").groupBy(c("p1").alias("k1"), c("p2").alias("k2")).agg(F.count("*").alias("n_children"))
    nodes = materialize(nodes.join(children, KEY, "left").na.fill(0, ["n_children"]), "trie-children")

    chains = nodes.groupBy("conv_id").agg(F.sum("own_saved").alias("saved"),
                                          F.sum(F.when(c("n_children") == 0, 1).otherwise(0)).alias("leaves"))
    chains = materialize(chains, "trie-chains")
    tiles = local.select((c("shard") + 0).alias("shard"), (c("block") + 0).alias("block")).distinct()
    owners = chains.withColumn("shard", F.shiftright("conv_id", WIDTH_BITS)).join(tiles, "shard")
    members = (local.groupBy("shard", "block").cogroup(owners.groupBy("shard", "block"))
               .applyInArrow(lambda a, b: _member_sums(a, b), "k1 long, k2 long, saved long, leaves long"))
    members = members.groupBy(*KEY).agg(F.sum("saved").alias("all_saved"), F.sum("leaves").alias("n_leaves"))

    chunks = local.where("ends is not null").select(*KEY, "shard", "ends").repartition(*KEY).sortWithinPartitions(*KEY, "shard")
    ends = chunks.mapInArrow(lambda batches: _end_hashes(batches), "k1 long, k2 long, ends_sha256 string")

    parents = nodes.select(c("k1").alias("p1"), c("k2").alias("p2"), c("conv_id").alias("parent_conv_id"))
    out = (nodes.join(members, KEY).join(_rest_of_chain(nodes, block_bits), KEY).join(ends, KEY, "left")
           .join(chains.select("conv_id", "saved"), "conv_id").join(parents, ["p1", "p2"], "left"))
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
                      (c("all_saved") - c("saved") + c("rest")).alias("saved_tokens"),
                      F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))
