"""Prefix trie of conversations, built shard by shard as adaptive radix trees over fixed-width turn ids."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlife.functions.staging_area import stage
from fleetlife.llm.common import share_code
from fleetlife.llm.merkle import crc32_sql
from fleetlife.llm.radix_tree import RadixTree

WIDTH = 16  # bytes of a turn id
SHARD_TURNS = 1 << 16  # turns of distinct sequences that one tree holds on average
HEADS = 6  # a rebuilt conversation takes fewer turns than this from the first of its hundred


def turn_id(role: Column, text: Column) -> Column:
    """The first 16 bytes of the SHA-256 of a turn, the role set off by its length: equal for equal turns alone."""
    whole = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return F.substring(F.unhex(F.sha2(whole, 256)), 1, WIDTH)


def sequences(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
) -> DataFrame:
    """Rows (conv_id, turns), turns an array of (id, chars) in order: number (null first), then role, then id.

    Texts become ids where they are read. A null role or text is empty; rows without a conversation id belong to none
    and are left out.
    """
    who, said = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    rows = turns.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("bigint").alias("conv_id"), F.struct(
            F.col(turn).alias("turn"), who.alias("role"), turn_id(who, said).alias("id"),
            F.length(said).alias("chars")).alias("t"))
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return whole.select("conv_id", F.transform("t", lambda t: F.struct(t["id"].alias("id"), t["chars"].alias("chars"))).alias("turns"))


def rebuilt_conversations(turns: DataFrame, every: int = 100, heads: int = HEADS) -> DataFrame:
    """The sequences of ``turns``, each with its first turns from the conversation that its hundred begins with.

    Conversation c takes the first h turns of c - c % ``every`` (all, if it has fewer; none, if there is no such one) and
    its own after its first h, where h is ``crc32`` of c as text modulo ``heads``.
    """
    own = stage(sequences(turns), "sequences")
    first = own.where(F.col("conv_id") % every == 0).select(
        F.col("conv_id").alias("base"), F.slice("turns", 1, heads - 1).alias("start"))
    taken = F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(heads)).cast("int")
    none = F.filter("turns", lambda t: F.lit(False))
    mixed = own.withColumn("base", F.col("conv_id") - F.col("conv_id") % every).withColumn("h", taken).join(first, "base", "left")
    return mixed.select("conv_id", F.concat(
        F.slice(F.coalesce("start", none), F.lit(1), F.col("h")),
        F.slice("turns", F.col("h") + 1, F.size("turns"))).alias("turns"))


# Distinct sequences ----------------------------------------------------------------------------------------------------


def _copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per key of rows ordered by (key, conv_id). A key's ids run through its hash one by one, so copies without
    number need no memory."""
    key = chars = first = seal = None
    n = 0

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([key], pa.binary()), pa.array([chars], pa.list_(pa.int32())), pa.array([n], pa.int64()),
             pa.array([first], pa.int64()), pa.array([seal.hexdigest()])], names=["key", "chars", "n", "first", "ends"])

    for batch in batches:
        done = []
        for k, c, i in zip(*(batch.column(j).to_pylist() for j in range(3)), strict=True):
            if k != key:
                if key is not None:
                    done.append(row())
                key, chars, first, seal, n = k, c, i, sha256(str(i).encode()), 1
            else:
                seal.update(b",%d" % i)
                n += 1
        if done:
            yield from pa.Table.from_batches(done).combine_chunks().to_batches()
    if key is not None:
        yield row()


def distinct_sequences(found: DataFrame) -> DataFrame:
    """Rows (key, chars, n, first, ends), one per distinct sequence: the ids put together, the code points of each turn,
    the conversations with that sequence, the smallest of them, and the digest of all of them in order."""
    share_code(found.sparkSession)
    key = F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t["id"])), ""))
    rows = found.select(key.alias("key"), F.transform("turns", lambda t: t["chars"]).alias("chars"), "conv_id")
    return rows.repartition("key").sortWithinPartitions("key", "conv_id").mapInArrow(
        _copies, "key binary, chars array<int>, n bigint, first bigint, ends string")


# Shards ----------------------------------------------------------------------------------------------------------------


def _prefix(turns: Column | int) -> Column:
    return F.substring("key", F.lit(1), F.lit(turns) * WIDTH) if isinstance(turns, int) else F.substring("key", F.lit(1), turns * WIDTH)


def cut_sequences(distinct: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """Adds ``cut``: sequences with the same first ``cut`` turns belong to one tree.

    That is one turn. Where more turns than a tree holds follow one first turn, as after a common system prompt, the cut
    doubles until each group fits or is a single sequence; so each step halves what a hot beginning may hide, and
    long common beginnings take few steps.
    """
    done, pending, cut = None, distinct, 1
    while True:
        groups = pending.groupBy(_prefix(cut).alias("prefix")).agg(F.sum(F.size("chars")).alias("turns"), F.count("*").alias("n"))
        hot = stage(groups.where((F.col("turns") > shard_turns) & (F.col("n") > 1)).select("prefix"), "hot-prefixes")
        if hot.isEmpty():
            rest = pending.withColumn("cut", F.lit(cut))
            return rest if done is None else done.unionByName(rest)
        keyed = pending.withColumn("prefix", _prefix(cut))
        fit = keyed.join(hot, "prefix", "left_anti").drop("prefix").withColumn("cut", F.lit(cut))
        done = fit if done is None else done.unionByName(fit)
        pending = keyed.join(hot, "prefix", "left_semi").drop("prefix")
        cut *= 2


def _grow(shard: pd.DataFrame) -> pd.DataFrame:
    """All nodes of one shard from its cut downwards."""
    cut = int(shard["cut"].iloc[0]) * WIDTH
    tree = RadixTree()
    for key, chars, n, first, ends in zip(*(shard[c] for c in ("key", "chars", "n", "first", "ends")), strict=True):
        tree.insert(bytes(key), (bytes(key), chars, int(n), int(first), ends))
    rows = []
    walk = tree.bottom_up()
    # A result sums up the subtree below a byte depth: members, smallest member, childless nodes, saved tokens, a key that
    # leads there with its lengths, turn-aligned children, and their rows, which wait for their parent's smallest member.
    nothing = sha256().hexdigest()
    node, end, below = next(walk)
    while True:
        start = end - len(node.label)
        members, least, leaves, saved, rep, children, waiting = 0, None, 0, 0, None, 0, []
        if node.value is not None:
            rep, members, least = (node.value[0], node.value[1]), node.value[2], node.value[3]
        for b_members, b_least, b_leaves, b_saved, b_rep, b_children, b_waiting in below:
            members, leaves, saved, children = members + b_members, leaves + b_leaves, saved + b_saved, children + b_children
            least = b_least if least is None else min(least, b_least)
            rep = rep or b_rep
            waiting += b_waiting
        depth = end - end % WIDTH
        while depth > start and depth >= cut:  # every aligned depth on the compressed path is a node, deepest first
            own = (members - 1) * int(rep[1][depth // WIDTH - 1])
            here_ends = node.value[4] if node.value is not None and depth == end else nothing
            leaves, saved = leaves if children else 1, saved + own
            for row in waiting:
                row[2] = least
            row = [depth // WIDTH, least, None, members, children, leaves, saved, here_ends, rep[0][:depth] if depth == cut else None,
                   rep[1][: depth // WIDTH] if depth == cut else None]
            rows.append(row)
            waiting, children = [row], 1
            depth -= WIDTH
        result = (members, least, leaves, saved, rep, children, waiting)
        try:
            node, end, below = walk.send(result)
        except StopIteration:
            break
    return pd.DataFrame(rows, columns=[
        "depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "prefix", "chars",
    ]).astype({"parent_conv_id": "Int64", "conv_id": "int64"})


NODE = ("depth bigint, conv_id bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, "
        "saved_tokens bigint, ends_sha256 string")
COLUMNS = [c.split()[0] for c in NODE.split(", ")]


def shard_nodes(cut: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """The nodes at and below the cuts, a shard at a time; those at a cut also carry their ids (``prefix``) and lengths
    (``chars``), and have no parent yet."""
    share_code(cut.sparkSession)
    reach = cut.where(F.size("chars") >= F.col("cut"))
    sizes = {r["cut"]: -(-r["turns"] // shard_turns) for r in
             reach.groupBy("cut").agg(F.sum(F.size("chars")).alias("turns")).collect()}  # one row for each doubling
    shards = F.lit(1)
    for depth, n in sizes.items():
        shards = F.when(F.col("cut") == depth, n).otherwise(shards)
    dealt = reach.withColumn("shard", F.pmod(F.xxhash64(_prefix(F.col("cut"))), shards.cast("bigint")))
    return dealt.groupBy("cut", "shard").applyInPandas(_grow, f"{NODE}, prefix binary, chars array<int>")


def upper_nodes(cut: DataFrame, at_cut: DataFrame) -> DataFrame:
    """The nodes above the cuts: the root, and the common beginnings of hot groups. Everything sums over ``at_cut``, the
    nodes at the cuts, and over sequences that end before theirs, each counted for every node it passes.

    Adds ``prefix``. Without sequences there is no root.
    """
    lower = at_cut.select("prefix", F.col("conv_id").alias("first"), "n_convs", "n_leaves", "saved_tokens", "chars",
                          F.lit(None).cast("string").alias("ends"))
    short = cut.where(F.size("chars") < F.col("cut")).select(
        F.col("key").alias("prefix"), "first", F.col("n").alias("n_convs"), F.lit(0).cast("bigint").alias("n_leaves"),
        F.lit(0).cast("bigint").alias("saved_tokens"), "chars", "ends")
    last = F.size("chars") - F.when(F.col("ends").isNull(), 1).otherwise(0)
    passed = lower.unionByName(short).withColumn("depth", F.explode(F.sequence(F.lit(0), last)))
    is_end, is_cut = F.col("depth") == F.size("chars"), F.col("ends").isNull()
    at = F.substring("prefix", F.lit(1), F.col("depth") * WIDTH)
    nodes = passed.groupBy("depth", at.alias("node")).agg(
        F.min("first").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.sum("n_leaves").alias("below_leaves"),
        F.sum("saved_tokens").alias("below_saved"), F.max(F.when(is_end, F.col("ends"))).alias("ends"),
        F.sum(F.when(is_cut & (F.col("depth") == F.size("chars") - 1), 1).otherwise(0)).alias("cut_children"),
        F.max(F.when(F.col("depth") > 0, F.get("chars", F.col("depth") - 1)).otherwise(0)).alias("length"))
    nodes = stage(nodes, "upper-nodes")
    parent = F.substring("node", F.lit(1), (F.col("depth") - 1) * WIDTH)
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), parent.alias("node")).agg(
        F.count("*").alias("children"))
    known = nodes.join(children, ["depth", "node"], "left").withColumn(
        "n_children", F.col("cut_children") + F.coalesce("children", F.lit(0)))
    own = known.select(
        "node", F.col("depth").alias("deep"), ((F.col("n_convs") - 1) * F.col("length")).alias("saved"),
        F.when(F.col("n_children") == 0, 1).otherwise(0).alias("leaf"))
    sums = own.withColumn("depth", F.explode(F.sequence(F.lit(0), "deep"))).groupBy(
        "depth", F.substring("node", F.lit(1), F.col("depth") * WIDTH).alias("node")).agg(
        F.sum("saved").alias("saved"), F.sum("leaf").alias("leaves"))
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("node").alias("above"), F.col("conv_id").alias("parent_conv_id"))
    whole = known.join(sums, ["depth", "node"]).withColumn(
        "above", F.substring("node", F.lit(1), (F.col("depth") - 1) * WIDTH)).join(above, ["depth", "above"], "left")
    return whole.select(
        F.col("depth").cast("bigint").alias("depth"), "conv_id", F.when(F.col("depth") > 0, F.col("parent_conv_id")).alias("parent_conv_id"),
        "n_convs", F.col("n_children").cast("bigint").alias("n_children"), (F.col("below_leaves") + F.col("leaves")).alias("n_leaves"),
        (F.col("below_saved") + F.col("saved")).alias("saved_tokens"),
        F.coalesce("ends", F.sha2(F.lit(""), 256)).alias("ends_sha256"), F.col("node").alias("prefix"))


PARENT_SALTS = 16


def prefix_nodes(found: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """Rows (depth, conv_id, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256), one per distinct
    beginning of the sequences ``found`` (conv_id, turns), the textless root included.

    A node is named by its smallest member and its depth. Equal sequences are counted once; a sequence without turns is
    a member of the root alone. A conversation id that comes twice counts twice. Without sequences there are no nodes.

    Distinct sequences are dealt by their first turns to trees of bounded size (``cut_sequences``); inner bytes of ids
    that happen to be equal share a tree's nodes, but only whole turns become rows. What lies above the cuts is summed
    up in DataFrame functions.
    """
    cut = stage(cut_sequences(stage(distinct_sequences(found), "distinct-sequences"), shard_turns), "cut-sequences")
    grown = stage(shard_nodes(cut, shard_turns), "trie-nodes")
    upper = stage(upper_nodes(cut, grown.where("prefix is not null")), "upper-trie")
    inner = grown.where("prefix is null").select(COLUMNS)
    # A hot beginning may have very many children at its cut: both sides are salted.
    above = upper.select(F.col("prefix").alias("parent"), F.col("conv_id").alias("up")).withColumn(
        "salt", F.explode(F.sequence(F.lit(0), F.lit(PARENT_SALTS - 1))))
    tops = grown.where("prefix is not null").withColumn(
        "parent", F.substring("prefix", F.lit(1), (F.col("depth") - 1).cast("int") * WIDTH)).withColumn(
        "salt", F.pmod(F.xxhash64("prefix"), F.lit(PARENT_SALTS)).cast("int"))
    tops = tops.join(above, ["parent", "salt"]).withColumn("parent_conv_id", F.col("up")).select(COLUMNS)
    return upper.select(COLUMNS).unionByName(tops).unionByName(inner)


def nodes_sql(conversations: str = "conversations", every: int = 100, heads: int = HEADS) -> str:
    """All nodes of the rebuilt ``conversations``, in DuckDB's SQL."""
    taken = f"{crc32_sql('cast(c as varchar)')} % {heads}"
    return f"""
with given as (
  select conv_id as c, turn, coalesce(role, '') as role, coalesce(text, '') as text,
    sha256(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, '')) as id
  from {conversations} where conv_id is not null),
own as (
  select c, list({{'id': id, 'chars': length(text)}} order by turn nulls first, role, id) as turns from given group by c),
headed as (select *, cast({taken} as bigint) as h from own),
rebuilt as (
  select a.c, coalesce(b.turns[1:a.h], []) || a.turns[a.h + 1:] as turns
  from headed a left join own b on b.c = a.c - a.c % {every}),
passed as (select c, turns, unnest(range(0, len(turns) + 1)) as depth from rebuilt),
placed as (
  select c, depth, array_to_string(list_transform(turns[1:depth], lambda t: t.id), '') as node,
    case when depth > 0 then turns[depth].chars else 0 end as chars, depth = len(turns) as ends from passed),
nodes as (
  select node, depth, min(c) as conv_id, count(*) as n_convs, max(chars) as chars,
    sha256(coalesce(string_agg(cast(c as varchar), ',' order by c) filter (where ends), '')) as ends_sha256
  from placed group by node, depth),
linked as (
  select n.*, substr(n.node, 1, 64 * (n.depth - 1)) as above, k.n_children
  from nodes n left join (
    select substr(node, 1, 64 * (depth - 1)) as node, depth - 1 as depth, count(*) as n_children from nodes where depth > 0 group by 1, 2) k
  on k.node = n.node and k.depth = n.depth),
spread as (select node, depth, n_convs, chars, n_children, unnest(range(0, depth + 1)) as up from linked),
sums as (
  select substr(node, 1, 64 * up) as node, up as depth, sum((n_convs - 1) * chars) as saved, count(*) filter (where n_children is null) as leaves
  from spread group by 1, 2)
select cast(l.depth as bigint) as depth, l.conv_id, p.conv_id as parent_conv_id, l.n_convs, coalesce(l.n_children, 0) as n_children,
  cast(s.leaves as bigint) as n_leaves, cast(s.saved as bigint) as saved_tokens, l.ends_sha256
from linked l join sums s on s.node = l.node and s.depth = l.depth
left join nodes p on l.depth > 0 and p.node = l.above and p.depth = l.depth - 1"""
