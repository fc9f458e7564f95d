import random
import re

import pytest
import xxhash

from fleetlife.llm import simhash
from fleetlife.llm.components import connected

SCHEMA = "doc_id bigint, text string, fp int, root string"


def slow_fingerprint(text, words=3):
    data = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())
    tokens = [t for t in re.split(rb"[\x20\x09-\x0D]+", data) if t]
    if not tokens:
        return 0
    shingles = [b" ".join(tokens[i : i + words]) for i in range(max(1, len(tokens) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(values, radius=3):
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    values = sorted(values)
    for i, a in enumerate(values):
        for b in values[:i]:
            if bin((a ^ b) & (2**64 - 1)).count("1") <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {v: find(v) for v in values}


@pytest.mark.parametrize("text", [
    None, "", " \t\n", "One", "one  TWO", "a b c", "A b C d a b c d é É \x0b\x0c x y", "\x1cq w e r t", "w " * 5000])
@pytest.mark.parametrize("words", [3, 5])
def test_fingerprints(text, words):
    assert simhash.fingerprint(text, words) & (2**64 - 1) == slow_fingerprint(text, words)


def signed(v):
    return v - (1 << 64) if v >> 63 else v


@pytest.mark.parametrize("blocks, unit_rows", [(4, 4096), (5, 4096), (6, 4096), (4, 20)])
def test_links_find_the_components_of_all_pairs(spark, blocks, unit_rows):
    rng = random.Random(blocks * unit_rows)
    values = {rng.getrandbits(64) for _ in range(150)}
    base = rng.getrandbits(64)
    values |= {base ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(300)}  # a large group
    for v in list(values)[:60]:
        for flips in (1, 2, 3, 4):
            w = v
            for b in rng.sample(range(64), flips):
                w ^= 1 << b
            values.add(w)
    values = {signed(v) for v in values} | {0}
    df = spark.createDataFrame([(v,) for v in values], "fp bigint").repartition(3)
    found = {r.node: r.root for r in connected(simhash.linked_fingerprints(df, 3, blocks, unit_rows)).collect()}
    assert {v: found.get(v, v) for v in values} == slow_components(values)


def test_masks_cover_every_choice():
    for blocks in (4, 5, 6, 8):
        masks = [m & (2**64 - 1) for m in simhash._masks(blocks, 3)]
        rng = random.Random(blocks)
        for _ in range(300):
            flips = sum(1 << b for b in rng.sample(range(64), 3))
            assert any(flips & m == 0 for m in masks)
    assert simhash._blocks_for(10**6, 3) < simhash._blocks_for(10**10, 3)


def rows(spark, values):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in values], SCHEMA)


TEXT = "alpha beta gamma delta epsilon zeta eta theta iota kappa " * 4


def test_components_with_nulls_copies_and_repeats(spark):
    data = [(5, TEXT), (3, TEXT), (3, TEXT), (9, TEXT.upper()), (7, "quite another text of some words"), (None, "no id here at all"),
            (8, None), (2, ""), (4, "  "), (6, "x" * 200_000)]
    got = {(r.doc_id, r.fingerprint): r.component_id for r in simhash.near_duplicates(rows(spark, data)).collect()}
    assert simhash.near_duplicates(rows(spark, data)).count() == len(data)
    fp = f"{slow_fingerprint(TEXT):016x}"
    assert got[5, fp] == got[3, fp] == got[9, fp] == 3 and got[8, "0" * 16] == got[2, "0" * 16] == got[4, "0" * 16] == 2
    assert got[None, f"{slow_fingerprint('no id here at all'):016x}"] is None
    kept = simhash.keep_one_each(rows(spark, data))
    assert kept.columns == ["doc_id", "text", "fp", "root"]
    assert sorted((r.doc_id is None, r.doc_id) for r in kept.collect()) == sorted([(False, 3), (False, 7), (True, None), (False, 2), (False, 6)])


def test_an_id_with_two_texts_counts_per_text(spark):
    data = [(1, TEXT), (1, "something else entirely in these words"), (0, TEXT)]
    kept = {(r.doc_id, r.text[:9]) for r in simhash.keep_one_each(rows(spark, data)).collect()}
    assert kept == {(0, TEXT[:9]), (1, "something")}


def test_empty_table(spark):
    assert simhash.near_duplicates(rows(spark, [])).collect() == []
    assert simhash.keep_one_each(rows(spark, [])).collect() == []


def test_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(900, 901), (901, 900), (5, 5)], "u bigint, v bigint")
    got = {r.node: r.root for r in connected(edges).collect()}
    assert all(got[i] == 0 for i in range(201)) and got[900] == got[901] == 900 and len(got) == 203
