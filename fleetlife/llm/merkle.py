"""Merkle manifest of a dataset: subtrees are exchanged between superblocks by cogrouping leaves with the outer nodes that
their proofs need."""

from __future__ import annotations

from collections.abc import Callable
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlife.functions.staging_area import forget, stage
from fleetlife.llm.common import share_code

SUPERBLOCK_BITS = 12  # a superblock holds 2 ** SUPERBLOCK_BITS consecutive nodes, the most that one group has
LEAF_COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(joined: str) -> str:
    return sha256(joined.encode()).hexdigest()


def field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(values: dict[str, Column]) -> Column:
    """The leaf digest of one row: SHA-256 over its fields, computed where the row is read."""
    return F.sha2(F.concat(*[field(values[c]) for c in LEAF_COLUMNS]), 256)


# Inside one superblock -------------------------------------------------------------------------------------------------


def levels_of(nodes: int) -> int:
    """How often pairs are reduced until one of ``nodes`` is left."""
    return max(nodes - 1, 0).bit_length()


def reduced(nodes: list[str], levels: int) -> list[list[str]]:
    """The digests of every level, from ``nodes`` up to ``levels`` reductions; a last node without a partner is hashed
    alone."""
    rows = [nodes]
    for _ in range(levels):
        below = rows[-1]
        rows.append([digest("".join(below[i : i + 2])) for i in range(0, len(below), 2)])
    return rows


def path_in(rows: list[list[str]], at: int) -> str:
    """The way up from node ``at``: per level ``L`` or ``R`` with the sibling on that side, or ``N`` where there is none."""
    steps = []
    for row in rows[:-1]:
        other = at ^ 1
        steps.append("N" if other >= len(row) else ("R" if other > at else "L") + row[other])
        at >>= 1
    return "".join(steps)


def siblings(path: str) -> str:
    """All sibling digests of a path, in order. They are lower-case hexadecimal, so the letters of the steps stand out."""
    return path.replace("N", "").replace("L", "").replace("R", "")


def folded(node: str, path: str) -> str:
    """The root that ``node`` leads to along ``path``."""
    at = 0
    while at < len(path):
        side, other = path[at], path[at + 1 : at + 65]
        if side == "N":
            node, at = digest(node), at + 1
        else:
            node, at = digest(node + other if side == "R" else other + node), at + 65
    return node


# Whole trees, superblock by superblock ---------------------------------------------------------------------------------


def ranked(nodes: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """Adds ``pos`` (from 0, in the order of ``order`` inside each ``key``) and ``n`` (nodes of that key).

    Rows are dealt by ranges of (key, order); equal rows are told apart by a running number, so that no key and no group
    of copies meets in one task. Only the starts of (key, range) are summed over all.
    """
    ties = F.monotonically_increasing_id()
    dealt = nodes.withColumn("tie", ties).repartitionByRange(F.col(key), *order, F.col("tie"))
    placed = dealt.sortWithinPartitions(F.col(key), *order, F.col("tie")).drop("tie")
    stored = stage(placed.withColumn("at", F.monotonically_increasing_id()), "merkle-order")  # range << 33 | row
    placed = stored.withColumn("range", F.shiftright("at", 33))
    parts = placed.groupBy(key, "range").agg(F.min("at").alias("start"), F.count("*").alias("rows"))
    along = Window.partitionBy(key)
    before = along.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select(key, "range", (F.coalesce(F.sum("rows").over(before), F.lit(0)) - F.col("start")).alias("shift"),
                          F.sum("rows").over(along).alias("n"))
    numbered = placed.join(starts, [key, "range"]).withColumn("pos", F.col("at") + F.col("shift"))
    numbered = stage(numbered.drop("at", "range", "shift"), "merkle-nodes")
    forget(stored)
    return numbered


def _tops(bits: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("pos")
        levels = min(bits, levels_of(int(group["n"].iloc[0])))
        top = reduced(group["node"].tolist(), levels)[-1][0]
        return pd.DataFrame({"key": group["key"].iloc[:1], "pos": group["block"].iloc[:1], "node": [top],
                             "n": [-(-int(group["n"].iloc[0]) // (1 << bits))]})

    return run


def _above(nodes: DataFrame, bits: int) -> DataFrame:
    """The nodes ``bits`` levels above ``nodes`` (key, pos, node, n): one per superblock."""
    blocked = nodes.select("key", F.shiftright("pos", bits).alias("block"), "pos", "node", "n")
    return blocked.groupBy("key", "block").applyInPandas(_tops(bits), "key string, pos bigint, node string, n bigint")


def _ways(bits: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """The path from every node of a superblock to the root: its own part of it and the outer nodes of the block."""

    def run(group: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("pos")
        levels = min(bits, levels_of(int(group["n"].iloc[0])))
        rows, rest = reduced(group["node"].tolist(), levels), outer.iloc[0]
        return pd.DataFrame({
            "key": group["key"], "block": group["pos"], "subroot": rest["subroot"], "root": rest["root"],
            "path": [path_in(rows, i) + rest["path"] for i in range(len(group))]})

    return run


def _proofs(bits: int, whole: bool) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """The last exchange: local reduction, joining of each leaf's proof with the outer nodes, and folding of what a reader
    holds (``seen``) back to a root."""

    def run(group: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("pos")
        levels = min(bits, levels_of(int(group["n"].iloc[0])))
        rows, rest = reduced(group["node"].tolist(), levels), outer.iloc[0]
        ends: dict[str, str] = {}  # folding beyond the superblock depends on the node there alone
        beyond = siblings(rest["path"])
        digests, roots, paths = [], [], []
        for i, seen in enumerate(group["seen"]):
            inner = path_in(rows, i)
            digests.append(digest(siblings(inner) + beyond))
            top = folded(seen, inner)
            if top not in ends:
                ends[top] = folded(top, rest["path"])
            roots.append(ends[top])
            paths.append(inner + rest["path"] if whole else None)
        return pd.DataFrame({
            "doc_id": group["doc_id"], "key": group["key"], "pos": group["pos"], "leaf": group["node"],
            "subroot": rest["subroot"], "root": rest["root"], "proof_sha256": digests, "folded_root": roots,
            "verified": [r == rest["root"] for r in roots], "path": pd.Series(paths, index=group.index, dtype=object)})

    return run


def _down(nodes: DataFrame, outer: DataFrame, bits: int, finish=None, schema: str = "") -> DataFrame:
    """Cogroups the nodes of one storey with the outer nodes of their superblocks (key, block, subroot, root, path)."""
    blocked = nodes.withColumn("block", F.shiftright("pos", bits))
    schema = schema or "key string, block bigint, subroot string, root string, path string"
    return blocked.groupBy("key", "block").cogroup(outer.groupBy("key", "block")).applyInPandas(finish or _ways(bits), schema)


def _storeys(nodes: DataFrame, bits: int) -> list[DataFrame]:
    """(key, pos, node, n) of ``nodes`` and of every ``bits``-th level above, up to one node per key."""
    found, most = [nodes], nodes.agg(F.max("n")).first()[0] or 0
    while most > 1:
        found.append(stage(_above(found[-1], bits), "merkle-nodes"))
        most = -(-most // (1 << bits))
    return found


def manifest(
    docs: DataFrame, tampered: dict[str, Column] | None = None, group: str = "lang", bits: int = SUPERBLOCK_BITS,
    proofs: bool = True,
) -> DataFrame:
    """Rows (doc_id, key, pos, leaf, subroot, root, proof_sha256, folded_root, verified, path), one per row of ``docs``.

    A leaf digests doc_id, source, lang, n_chars and text; leaves of one ``group`` value ascend by doc_id (null first, rows
    of one id by leaf) and are hashed in pairs up to a subroot, the subroots in order of the value (null first, bytewise)
    up to the root. ``path`` is the proof: per level ``L`` or ``R`` and the sibling on that side, or ``N`` where a node
    is hashed alone (null without ``proofs``). ``folded_root`` is what the proof makes of the row as ``tampered``, a
    column for each changed field of the leaf, gives it; ``verified`` tells whether that is the root. ``key`` is the
    group value behind a letter, empty for null.

    Texts are digested where they are read and never shuffled. 2 ** ``bits`` consecutive nodes are a superblock; a group
    value of any size is spread over its superblocks, which exchange one digest and a few siblings each. Nulls are fields
    of their own, equal rows are leaves of their own, other columns of ``docs`` are not looked at. An empty table gives
    no rows.
    """
    share_code(docs.sparkSession)
    held = {c: F.col(c) for c in LEAF_COLUMNS}
    leaf, seen = leaf_of(held), leaf_of(held | (tampered or {}))
    key = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    leaves = docs.select("doc_id", key.alias("key"), leaf.alias("node"), seen.alias("seen"))
    leaves = ranked(leaves, "key", [F.col("doc_id"), F.col("node")])
    trees = _storeys(leaves.select("key", "pos", "node", "n"), bits)
    subroots = trees[-1].select(F.lit("").alias("key"), F.col("key").alias("value"), "node")
    subroots = ranked(subroots, "key", [F.col("value")])
    above = _storeys(subroots.select("key", "pos", "node", "n"), bits)
    spent = [*trees[1:], *above[1:]]

    root = above[-1].select("key", F.lit(0).cast("bigint").alias("block"), F.col("node").alias("subroot"),
                            F.col("node").alias("root"), F.lit("").alias("path"))
    outer = root
    for storey in reversed(above[:-1]):
        outer = stage(_down(storey, outer, bits), "merkle-paths")
        spent.append(outer)
    outer = subroots.join(outer.select(F.col("block").alias("pos"), "root", "path"), "pos").select(
        F.col("value").alias("key"), F.lit(0).cast("bigint").alias("block"), F.col("node").alias("subroot"), "root", "path")
    for storey in reversed(trees[1:-1]):
        outer = stage(_down(storey, outer, bits), "merkle-paths")
        spent.append(outer)
    found = _down(  # ids travel as text: pandas would make floats of longs beside nulls
        leaves.withColumn("doc_id", F.col("doc_id").cast("string")), outer, bits, _proofs(bits, proofs),
        "doc_id string, key string, pos bigint, leaf string, subroot string, root string, proof_sha256 string, "
        "folded_root string, verified boolean, path string")
    if len(trees) > 2:  # the last paths are stored and hold all they need
        for old in [*spent[:-1], subroots]:
            forget(old)
    return found.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))


def tamper_with_lengths(docs: DataFrame, every: int = 7) -> dict[str, Column]:
    """One more in ``n_chars`` of the rows whose ``crc32`` of the id as text ``every`` divides."""
    hit = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(every)) == 0
    more = (F.col("n_chars").cast("decimal(38,0)") + 1).cast("string")
    return {"n_chars": F.when(hit, more).otherwise(F.col("n_chars").cast("string"))}


def verify(held: DataFrame, found: DataFrame) -> DataFrame:
    """Rows (doc_id, verified) of rows ``held`` by a reader, checked with the proofs of a ``manifest``: whether a proof
    stored for the id leads from the row's digest to the root. An id without a proof does not verify."""
    share_code(held.sparkSession)

    def run(path: pd.Series, leaf: pd.Series) -> pd.Series:
        return pd.Series([None if p is None else folded(a, p) for p, a in zip(path, leaf, strict=True)], dtype=object)

    fold = F.pandas_udf(run, "string")
    mine = held.select("doc_id", leaf_of({c: F.col(c) for c in LEAF_COLUMNS}).alias("mine"), F.monotonically_increasing_id().alias("row"))
    kept = found.select(F.col("doc_id").alias("kept_id"), "path", "root")
    both = mine.join(kept, F.col("doc_id").eqNullSafe(F.col("kept_id")), "left")
    checked = both.select("row", "doc_id", (fold("path", "mine") == F.col("root")).alias("ok"))
    return checked.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.coalesce(F.max("ok"), F.lit(False)).alias("verified")).drop("row")


def crc32_sql(text: str) -> str:
    """``crc32`` of an ASCII text, bit by bit, in DuckDB's SQL, which has no such function."""
    bit = "case when v & 1 = 1 then xor(v >> 1, 3988292384) else v >> 1 end"
    byte = f"list_reduce(list_prepend(xor(a, b), range(8)), lambda v, s: {bit})"
    codes = f"list_transform(string_split({text}, ''), lambda c: cast(ascii(c) as bigint))"
    return f"xor(list_reduce(list_prepend(4294967295::bigint, {codes}), lambda a, b: {byte}), 4294967295)"


def manifest_sql(documents: str = "documents") -> str:
    """The manifest's digests with lengths tampered, in DuckDB's SQL."""

    def one(value: str) -> str:
        text = f"cast({value} as varchar)"
        return f"coalesce(octet_length(encode({text})) || ':' || {text}, '-')"

    def leaf(length: str) -> str:
        return "sha256(" + " || ".join(one(length if c == "n_chars" else c) for c in LEAF_COLUMNS) + ")"

    hit = f"{crc32_sql('cast(doc_id as varchar)')} % 7 = 0"

    def tree(name: str) -> str:
        """All levels above the table ``name`` (key, pos, n, node) and the table ``name``_way of siblings by level."""
        return f"""
{name}_up as (
  select key, 0 as level, pos, n, node from {name}
  union all
  select key, level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(node, '' order by pos))
  from {name}_up where n > 1 group by key, level, pos // 2, n)"""

    def fold(name: str, start: str) -> str:
        """Folds ``start`` (key, who, pos, n, mine, proof) up the tree ``name``."""
        return f"""
{name}_fold as (
  select key, who, 0 as level, pos, n, mine, proof from {start}
  union all
  select f.key, f.who, f.level + 1, f.pos // 2, (f.n + 1) // 2,
    sha256(case when s.node is null then f.mine when f.pos % 2 = 0 then f.mine || s.node else s.node || f.mine end),
    f.proof || coalesce(s.node, '')
  from {name}_fold f left join {name}_up s on s.key = f.key and s.level = f.level and s.pos = xor(f.pos, 1)
  where f.n > 1)"""

    return f"""
with recursive given as (
  select *, {leaf('n_chars')} as leaf, case when {hit} then {leaf('n_chars + 1')} else {leaf('n_chars')} end as seen,
    coalesce('=' || lang, '') as key from {documents}),
leaves as (
  select key, row_number() over (partition by key order by doc_id nulls first, leaf) - 1 as pos,
    count(*) over (partition by key) as n, leaf as node, seen, doc_id from given),
{tree('leaves')},
subroots as (
  select '' as key, key as value, row_number() over (order by encode(key)) - 1 as pos, count(*) over () as n, node
  from leaves_up where n = 1),
{tree('subroots')},
root as (select node as root from subroots_up where n = 1),
started as (select key, doc_id as who, pos, n, seen as mine, '' as proof from leaves),
{fold('leaves', 'started')},
inner_done as (select * from leaves_fold where n = 1),
passed as (
  select '' as key, struct_pack(value := s.value, id := d.who) as who, s.pos, s.n, d.mine, d.proof
  from inner_done d join subroots s on s.value = d.key),
{fold('subroots', 'passed')},
done as (select * from subroots_fold where n = 1)
select l.doc_id, l.node as leaf, s.node as subroot, r.root, sha256(d.proof) as proof_sha256, d.mine as folded_root,
  d.mine = r.root as verified
from leaves l join subroots s on s.value = l.key join done d on d.who.value = l.key and d.who.id is not distinct from l.doc_id, root r"""
