import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from check import compare, connect
from fleetlife.llm import chat_format, merkle, prefix_trie, queries
from fleetlife.llm.chat_format import Template
from fleetlife.llm.radix_tree import RadixTree

SF = "/root/testdata/sf0.001"
TURNS = "conv_id bigint, turn bigint, role string, text string, formatted string, state int, segments string, id string, key string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def conversations(spark, rows):
    """With columns that are called as the operators' own."""
    return spark.createDataFrame([(*r, "x", 1, "y", "z", "k") for r in rows], TURNS)


@pytest.mark.parametrize("name", ["op11_chat", "op12_merkle", "op13_prefix_trie"])
def test_queries_agree_with_sql(spark, name):
    assert compare(queries.queries()[name](spark, SF), connect(SF), queries.oracle_sql()[name]) == ""


# Chat -------------------------------------------------------------------------------------------------------------------

PIECES = ["</s>", "[INST]", " [/INST]", "[OUT] ", "[AS]", " [SAYS] ", "[/AS]", "\\", "<", "[", "<\\/s>", "[\\\\INST]", "a", " ", "\n", "é", "𝒳", ""]


def texts(seed, n):
    rng = random.Random(seed)
    return ["".join(rng.choices(PIECES, k=rng.randrange(9))) for _ in range(n)]


def test_escapes_are_reversible_and_leave_no_mark(spark):
    t = Template()
    rows = spark.createDataFrame([(x,) for x in texts(1, 400)], "text string").select(
        "text", t.escape(F.col("text")).alias("e"), t.unescape(t.escape(F.col("text"))).alias("u"),
        t.escape(t.escape(F.col("text"))).alias("ee")).collect()
    for r in rows:
        assert r.u == r.text and not any(c in r.e for c in t.controls)
        assert len(r.ee) - len(r.e) == len(r.e) - len(r.text)
    assert len({r.e for r in rows}) == len({r.text for r in rows})


def test_formatted_conversations_read_back_as_they_were(spark):
    said, roles = texts(2, 300), ["user", "assistant", "system", "tool", "", " [SAYS] ", "[/AS]"]
    rows = [(i % 40, i, random.Random(i).choice(roles), said[i]) for i in range(300)]
    out = chat_format.conversation_digests(chat_format.format_conversations(conversations(spark, rows))).collect()
    for r in out:
        mine = [x for x in rows if x[0] == r.conv_id]
        learned = "".join(x[3] for x in mine if x[2] == "assistant")
        assert (r.n_turns, r.turns_sha256) == (len(mine), sha("".join(f"{x[2]}\n{x[3]}\n" for x in mine)))
        assert (r.loss_chars, r.loss_sha256) == (len(learned), sha(learned))


def run_machine(roles, template):
    state, faults = chat_format.START, []
    for i, role in enumerate(roles):
        now = role if role in template.marks else chat_format.OTHER
        if now not in template.follows.get(state, ()):
            faults.append(i)
        state = now
    return faults + ([len(roles)] if chat_format.END not in template.follows.get(state, ()) else [])


@pytest.mark.parametrize("bits", [1, 3, 10])
def test_machine_runs_the_same_over_blocks(spark, bits):
    rng, template = random.Random(7), Template()
    rows = []
    for c in range(120):
        roles = [rng.choice(["user", "assistant"]) if rng.random() < 0.2 else ("user", "assistant")[i % 2] for i in range(rng.randrange(1, 30))]
        if rng.random() < 0.3:
            roles[0] = "system"
        if rng.random() < 0.1:
            roles[-1] = "tool"
        rows += [(c, i, role, "x") for i, role in enumerate(roles)]
    found = {r.conv_id: r for r in chat_format.check_turns(conversations(spark, rows), block_bits=bits).collect()}
    for c in range(120):
        faults = run_machine([r[2] for r in rows if r[0] == c], template)
        assert (found[c].n_faults, found[c].first_fault, found[c].valid) == (len(faults), faults[0] if faults else None, not faults)


def test_repeated_turn_numbers_run_in_order_of_state(spark):
    rows = [(1, 0, "assistant", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, "system", "s"), (None, 0, "user", None), (None, 1, None, "x")]
    frame = conversations(spark, rows)
    checked = {r.conv_id: r for r in chat_format.check_turns(frame).collect()}
    assert (checked[1].n_turns, checked[1].n_faults, checked[1].first_fault) == (4, 1, 2)  # system, user, user, assistant
    out = {r.conv_id: r for r in chat_format.conversation_digests(chat_format.format_conversations(frame)).collect()}
    assert out[1].turns_sha256 == sha("system\ns\nuser\na\nuser\na\nassistant\nb\n") and out[1].first_fault == 2
    assert out[None].turns_sha256 == sha("user\n\n\nx\n") and not out[None].valid


def test_long_texts_and_an_empty_table(spark):
    long = "[" * 50_000 + "</s>" * 5_000 + "\\" * 50_000
    frame = conversations(spark, [(1, 0, "user", long), (1, 1, "assistant", long)])
    r = chat_format.conversation_digests(chat_format.format_conversations(frame)).first()
    assert r.turns_sha256 == sha(f"user\n{long}\nassistant\n{long}\n") and r.loss_chars == len(long) and r.valid
    assert chat_format.format_conversations(frame.limit(0)).collect() == []
    assert [x.conv_id for x in chat_format.with_tricky(frame.limit(0)).collect()] == [-7, -7]


def test_templates_with_unclear_marks_are_refused():
    with pytest.raises(ValueError):
        Template(marks={"user": ("[A[B] ", " [/A]")})
    with pytest.raises(ValueError):
        Template(marks={"user": ("[U] ", " [U]")})


def test_an_own_template(spark):
    own = Template(marks={"human": ("<h>", "</h>"), "bot": ("<b>", "</b>")}, other=("<o>", "<t>", "</o>"), loss=("bot", "human"),
                   follows={chat_format.START: ("human",), "human": ("bot", chat_format.END)})
    frame = conversations(spark, [(1, 0, "human", "</b>"), (1, 1, "bot", "<h>x"), (1, 2, "z", "<\\t>")])
    row = chat_format.format_conversations(frame, own).first()
    assert row.formatted == "<h><\\/b></h><b><\\h>x</b><o>z<t><\\\\t></o>" and (row.n_faults, row.first_fault) == (2, 2)
    r = chat_format.conversation_digests(chat_format.format_conversations(frame, own), own).first()
    assert r.turns_sha256 == sha("human\n</b>\nbot\n<h>x\nz\n<\\t>\n") and r.loss_sha256 == sha("</b><h>x")


# Merkle -----------------------------------------------------------------------------------------------------------------

DOCS = "doc_id bigint, source string, lang string, n_chars long, text string, key string, node string, n int, pos int, at string, path string"


def documents(spark, rows):
    return spark.createDataFrame([(*r, "k", "n", 1, 2, "a", "p") for r in rows], DOCS)


def leaf(row, more=0):
    values = [row[0], row[1], row[2], None if row[3] is None else row[3] + more, row[4]]
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def build(nodes):
    """All levels, and the siblings of every node."""
    ways, level = [[] for _ in nodes], list(nodes)
    where = list(range(len(nodes)))
    while len(level) > 1:
        for i, p in enumerate(where):
            ways[i].append((p % 2, level[p ^ 1] if p ^ 1 < len(level) else None))
        level = [sha("".join(level[i : i + 2])) for i in range(0, len(level), 2)]
        where = [p // 2 for p in where]
    return level[0], ways


def fold(node, way):
    for right, other in way:
        node = sha(node if other is None else other + node if right else node + other)
    return node


@pytest.mark.parametrize("bits", [1, 2, 12])
def test_manifest_agrees_with_a_plain_tree(spark, bits):
    rng = random.Random(3)
    langs = ["en"] * 60 + ["de"] * 9 + [None] * 4 + ["", "é", "zz"]
    rows = [(i * 3, f"s{i % 5}", rng.choice(langs), rng.choice([None, i, 2**40]), rng.choice(["", "a text", "ü" * i, None])) for i in range(150)]
    rows += [rows[5], rows[5], (None, None, None, None, None), (2**60 + 1, "s", "en", 1, "long id"), (7, "s", "only", 5, "x")]
    found = merkle.manifest(documents(spark, rows), merkle.tamper_with_lengths(documents(spark, rows)), bits=bits).collect()
    by_lang = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))):
        by_lang[r[2]].append(r)
    order = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: build([leaf(r) for r in by_lang[x]]) for x in order}
    root, ways = build([trees[x][0] for x in order])
    want = []
    for x, up in zip(order, ways, strict=True):
        for r, way in zip(by_lang[x], trees[x][1], strict=True):
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            end = fold(leaf(r, 1 if hit else 0), way + up)
            want.append((r[0], leaf(r), trees[x][0], root, sha("".join(o or "" for _, o in way + up)), end, end == root))
            assert fold(leaf(r), way + up) == root
    mine = [(r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in found]
    assert sorted(mine, key=str) == sorted(want, key=str)
    assert any(not r.verified for r in found) and all(merkle.folded(r.leaf, r.path) == r.root for r in found)


def test_readers_verify_their_rows(spark):
    rows = [(i, "s", "en" if i % 3 else None, i, f"text {i}") for i in range(40)]
    found = merkle.manifest(documents(spark, rows), bits=2)
    held = documents(spark, rows[:10] + [(11, "s", "en", 12, "text 11"), (99, "s", "en", 1, "new")])
    assert {r.doc_id: r.verified for r in merkle.verify(held, found).collect()} == {**{i: True for i in range(10)}, 11: False, 99: False}


def test_manifest_of_small_tables(spark):
    assert merkle.manifest(documents(spark, [])).collect() == []
    one = merkle.manifest(documents(spark, [(1, None, None, None, None)])).first()
    assert one.leaf == one.subroot == one.root == one.folded_root == sha("1:1----") and one.proof_sha256 == sha("") and one.verified
    langs = merkle.manifest(documents(spark, [(i, None, f"l{i:03}", 1, "x" * 300_000 if i == 3 else "x") for i in range(50)]), bits=2).collect()
    assert len({r.root for r in langs}) == 1 and all(r.verified and r.leaf == r.subroot for r in langs)


# Trie -------------------------------------------------------------------------------------------------------------------


def test_radix_tree_finds_what_was_put_in():
    rng = random.Random(5)
    tree, held = RadixTree(), {}
    for i in range(4000):
        key = bytes(rng.choice([rng.randrange(3), rng.randrange(256)]) for _ in range(rng.randrange(7)))
        held[key] = i
        tree.insert(key, i)
    assert all(tree.get(k) == v for k, v in held.items())
    assert all(tree.get(bytes(rng.randrange(256) for _ in range(9))) is None for _ in range(100))
    seen, layouts, walk = [], set(), tree.bottom_up()
    node, depth, below = next(walk)
    while True:
        layouts.add(node.layout)
        assert [b for b, _ in node.items()] == sorted({b for b, _ in node.items()})
        assert node is tree.root or node.value is not None or len(list(node.items())) > 1  # paths are compressed
        if node.value is not None:
            seen.append(node.value)
        try:
            node, depth, below = walk.send(None)
        except StopIteration:
            break
    assert sorted(seen) == sorted(held.values()) and layouts == {4, 16, 48, 256}


def slow_nodes(turns, every=100, heads=6):
    held = defaultdict(list)
    for c, n, role, text in turns:
        if c is not None:
            held[c].append((n is not None, n or 0, role or "", hashlib.sha256(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).digest(), text or ""))
    own = {c: [(x[2], x[4]) for x in sorted(v)] for c, v in held.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, seq in own.items():
        h = zlib.crc32(str(c).encode()) % heads
        now = tuple(own.get(c - int(c - every * int(c / every)), [])[:h] + seq[h:])
        for d in range(len(now) + 1):
            members[now[:d]].append(c)
        ends[now].append(c)
    children = defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for node, m in members.items():
        for d in range(len(node) + 1):
            saved[node[:d]] += (len(m) - 1) * (len(node[-1][1]) if node else 0)
            leaves[node[:d]] += not children[node]
    return sorted((len(n), min(m), min(members[n[:-1]]) if n else -1, len(m), children[n], leaves[n], saved[n],
                   sha(",".join(map(str, sorted(ends[n]))))) for n, m in members.items())


def found_nodes(frame, shard_turns):
    rows = prefix_trie.prefix_nodes(prefix_trie.rebuilt_conversations(frame), shard_turns).collect()
    return sorted((r.depth, r.conv_id, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves,
                   r.saved_tokens, r.ends_sha256) for r in rows)


@pytest.mark.parametrize("shard_turns", [2, 40, 1 << 16])
def test_nodes_agree_with_brute_force(spark, shard_turns):
    rng = random.Random(11)
    rows = []
    for c in range(260):
        kind = rng.random()
        if kind < 0.3:  # a hot beginning with many ends, some of them beginnings of others
            seq = [("system", "be kind")] * 3 + [("user", f"q{rng.randrange(20)}")] * rng.randrange(3)
        elif kind < 0.5:
            seq = [("user", "hello"), ("assistant", "hi é𝒳"), ("user", "bye")][: rng.randrange(1, 4)]
        else:
            seq = [(rng.choice("ua"), rng.choice("xyz") * rng.randrange(3)) for _ in range(rng.randrange(1, 8))]
        rows += [(c, i, *t) for i, t in enumerate(seq)]
    rows += [(1001, None, "user", None), (1001, 2, None, "t"), (1001, 2, None, "t"), (None, 0, "user", "lost"), (-5, 0, "u", "x" * 50_000)]
    assert found_nodes(conversations(spark, rows), shard_turns) == slow_nodes(rows)


def test_copies_and_turnless_conversations(spark):
    rows = [(c, i, "user", f"t{i}") for c in range(300, 400) for i in range(4)]  # every rebuilt one is the same
    rows += [(c, 0, "user", "short") for c in range(4200, 4206) if c % 100]  # no conversation to begin with: turnless, if h > 0
    want = slow_nodes(rows)
    assert found_nodes(conversations(spark, rows), 8) == want and want[0][0] == 0
    assert found_nodes(conversations(spark, []), 8) == []


def test_a_long_common_beginning_is_cut_in_few_steps(spark):
    rows = [(c * 1000 + 7, i, "u", f"{i}" if i < 70 else f"{c} {i}") for c in range(12) for i in range(72)]
    assert found_nodes(conversations(spark, rows), 100) == slow_nodes(rows)
