import hashlib
import re

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from fleetlife.functions.staging_area import stage
from fleetlife.llm import chunk_bpe, graph_search, license_scan

SF = "/root/testdata/sf0.01"

# search


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1.0) for i, v in rows], "vec_id bigint, embedding array<float>, score double")


def exact(rows, k):
    good = [(i, np.array(v, np.float32).astype(float)) for i, v in rows
            if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, x in good:
        if q % 20 == 0:
            out[q] = sorted(((-float((x * y).sum()), i) for i, y in good if i != q))[:k]
    return out


def search(spark, rows, k=20, **how):
    df = vectors(spark, rows)
    found = {}
    for r in graph_search.nearest(df, df.where("vec_id % 20 = 0"), k, **how).collect():
        found.setdefault(r.query_id, []).append((r["rank"], -r.score, r.vec_id))
    return {q: [(s, i) for _, s, i in sorted(v)] for q, v in found.items()}


def test_recall_over_shards_and_query_blocks(spark, monkeypatch):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 24)) * rng.uniform(0.5, 2, size=(3000, 1))  # lengths differ, so inner product is not cosine
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    want, got = exact(rows, 20), search(spark, rows, shard_rows=900)
    hits = [len({i for _, i in want[q]} & {i for _, i in got[q]}) / 20 for q in want]
    assert np.mean(hits) >= 0.95 and set(got) == set(want)
    for q, near in got.items():
        assert near == sorted(near) and len(near) == 20 and q not in {i for _, i in near}


def test_blocks_of_queries_give_the_same_rows_and_repeated_ids_one_vector(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()]
    df = vectors(spark, rows)
    asked = vectors(spark, [(i, v) for i, v in rows if i % 20 == 0] + [(0, [9.0] * len(rows[0][1]))])
    index = stage(graph_search.build_index(graph_search.usable(df), 900), "index")
    asked = graph_search.usable(asked)
    one, many = ({(r.query_id, r["rank"]): (r.vec_id, r.score) for r in graph_search.search(index, asked, query_block=n).collect()}
                 for n in (1000, 30))
    assert one == many and len(one) == 100 * 20
    want = exact(rows, 20)
    hits = [sum(one[q, k][0] in {i for _, i in want[q]} for k in range(1, 21)) / 20 for q in want if q]
    assert np.mean(hits) >= 0.98 and min(hits) >= 0.8
    smallest = min([9.0] * len(rows[0][1]), list(dict(rows)[0]))
    assert one[0, 1][1] == pytest.approx(max(float(np.dot(smallest, np.array(v, float))) for i, v in rows if i))


def test_copies_ties_and_unusable_vectors(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(30, 4))
    rows = [(i, x[i % 30].tolist()) for i in range(400)]
    rows += [(1000, None), (1020, [0.0] * 4), (1040, [1.0, None, 0.0, 0.0]), (1060, [1.0, float("nan"), 0.0, 0.0]),
             (1080, [float("inf"), 0.0, 0.0, 0.0]), (None, [1.0] * 4), (1100, [])]
    want, got = exact(rows, 20), search(spark, rows, shard_rows=150)
    assert set(got) == set(want)
    for q in want:
        assert [i for _, i in got[q]] == [i for _, i in want[q]]
        assert np.allclose([s for s, _ in got[q]], [s for s, _ in want[q]])


def test_few_or_no_candidates(spark):
    got = search(spark, [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.0, 1.0])])
    assert [i for _, i in got[0]] == [1, 2]
    assert search(spark, [(0, [1.0, 0.0])]) == {} and search(spark, []) == {}


def test_pruning_keeps_a_diverse_edge():
    points = np.array([[0, 0], [1, 0], [1.1, 0], [0, 3]], np.float32)
    out = graph_search.robust_prune(points, np.array([0]), np.array([[1, 2, 3, -1]]), 3, 1.2)
    assert out.tolist() == [[1, 3, -1]]


# tokens

TEXTS = [
    None, "", " ", "Hello, world!", "it's I'll we've 'tis", "ÀÉ é İ ǅ ﬁ", "a b c\x85d\x1ce", "<|endoftext|> x<|startoftext|>y",
    "日本語 テキスト 123 ½", "😀😃 ok\t\tq\r\nz", "x" * 30_000, "word " * 20_000, "́lead", "\ń mark after space", "no\u0000nul",
    "Ünïcödé " * 3000 + "END", "a" + " " * 5000 + "b",
]


def plain(texts):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.no_truncation()
    t.no_padding()
    ids = [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]
    return [(np.array(i, "<u4").tobytes(), t.decode(i, skip_special_tokens=False)) for i in ids]


def encoder(**how):
    return chunk_bpe.ChunkEncoder(Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), **how)


@pytest.mark.parametrize("bits", [4, 10])
def test_encoding_equals_the_tokenizer(spark, bits):
    texts = TEXTS + [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").limit(300).collect()]
    coder = encoder(bits=bits)
    assert coder.encode(texts) == plain(texts) == coder.encode(texts)
    before = coder.encoded_chunks
    assert coder.encode(texts) == plain(texts) and coder.encoded_chunks == before  # met again: remembered by now


def test_disagreeing_joins_are_repaired():
    coder = encoder(bits=4)
    texts = ["some words that are cut in several chunks by a rolling hash over bytes " * 5]
    check = coder._check_joins

    def doubt(cut, known):
        check(cut, known)
        coder.joins = dict.fromkeys(coder.joins, False)

    coder._check_joins = doubt
    assert coder.encode(texts) == plain(texts) and coder.repaired == 1


def test_memory_is_bounded_and_results_stay():
    coder = encoder(most_words=3, most_chunk_bytes=1000)
    for text in TEXTS * 2:
        assert coder.encode([text]) == plain([text])
        assert len(coder.words) < 10_000 and coder.held < 5_000_000


def test_cut_points_depend_on_content_only():
    passage = b" ".join(hashlib.md5(bytes([i])).hexdigest()[:7].encode() for i in range(250))
    cuts = []
    for before in (b"", b"some other words come first ", b"x " * 700):
        data = before + passage
        cuts.append({c - len(before) for c in chunk_bpe.cut_points(data, 6) if c - len(before) > 20})
    assert cuts[0] == cuts[1] == cuts[2] and len(cuts[0]) > 3


def test_token_query(spark):
    df = spark.createDataFrame([(i, t, 5) for i, t in enumerate(TEXTS)] + [(None, "again", 5), (3, "Hello, world!", 5)], "doc_id bigint, text string, n_tokens int")
    got = df.select("doc_id", "text", chunk_bpe.encode_digests("text").alias("e")).select("doc_id", "text", "e.*").collect()
    assert len(got) == len(TEXTS) + 2
    for r, (ids, decoded) in zip(got, plain([r.text for r in got]), strict=True):
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (
            len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
    assert df.limit(0).select(chunk_bpe.encode_digests("text")).collect() == []


# licenses


def slow_base(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places, labels = [], set()
    for phrase, label in license_scan.PHRASES.items():
        p = phrase.split()
        at = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        places += at
        labels |= {label} if at else set()
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


GRANT = ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
         "documentation files")


def scanned(spark, texts):
    df = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "doc_id bigint, text string, labels string")
    return {r.doc_id: r for r in license_scan.scan_licenses(df).collect()}


def test_base_columns_and_labels(spark):
    texts = [None, "", "Under the MIT-License. under the mit license under the MIT license", "Apache License, Version 2.0", "CC BY-NC 4.0 cc by nc",
             "apache license version 3", "é under the mit license é", "cc by nc " * 4000, GRANT + " (the Software)", GRANT.replace("charge", "cost"),
             "Licensed under the GNU General Public License, version 3.", "the gnu general store", "under\x00the mit license", "under the the mit license"]
    got = scanned(spark, texts)
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == slow_base(t), t
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1
    assert got[8].labels == "mit" and got[8].base_labels == "" and got[8].score == 1
    assert got[9].labels == "mit" and 0.9 < got[9].score < 1
    assert got[10].labels == "gpl-3" and got[11].labels == "" and got[5].labels == ""


def test_repeated_rows_and_null_ids(spark):
    df = spark.createDataFrame([(1, "under the mit license")] * 40 + [(None, "under the mit license"), (1, "other")], "doc_id bigint, text string")
    out = license_scan.scan_licenses(df).collect()
    assert len(out) == 42 and sum(r.n_base for r in out) == 41
    assert license_scan.scan_licenses(df.limit(0)).collect() == []


def test_base_on_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in license_scan.scan_licenses(docs).collect():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == slow_base(text[r.doc_id])


def least_errors(words, wanted):
    """Fewest edits of ``wanted`` against any stretch of ``words``."""
    row = list(range(len(wanted) + 1))
    best = row[-1]
    for w in words:
        after = [0]
        for j, t in enumerate(wanted, 1):
            after.append(min(row[j - 1] + (w != t), row[j] + 1, after[-1] + 1))
        row, best = after, min(best, after[-1])
    return best


def test_every_placement_of_the_tolerated_edits(spark):
    notices = {n: label for n, label in license_scan.NOTICES.items() if label in ("mit", "apache-2", "bsd", "isc") and len(n.split()) > 19}
    assert sorted(notices.values()) == ["apache-2", "bsd", "isc", "mit"]
    long = " ".join(f"term{i}" for i in range(50))
    rows = []

    def add(words, label, template):
        rows.append((len(rows), " ".join(["lead", "in", *words, "and", "so", "on"]), label, template))

    for notice, label in notices.items():
        words, n = notice.split(), len(notice.split())
        for i in range(n):
            for j in range(i + 1, n):
                two = [*words[:i], "zzz", *words[i + 1 : j], "yyy", *words[j + 1 :]]
                add(two, label, notice)
                add([w for w in two if w not in ("zzz", "yyy")], label, notice)
                add([*words[:i], "zzz", *words[i:j], "yyy", *words[j:]], label, notice)
                add(["zzz" if p in (i, j, (i + j) // 2) else w for p, w in enumerate(words)], label, notice)
    words = long.split()
    for i in range(51):
        add([*words[:i], *["zzz"] * 5, *words[i:]], "long", long)
        add([*words[:i], *["zzz"] * 6, *words[i:]], "long", long)
    df = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    got = {r.doc_id: r.labels for r in license_scan.scan_licenses(df, notices={**notices, long: "long"}, phrases={}).collect()}
    for i, text, label, template in rows:
        wanted = template.split()
        assert (label in got[i].split(",")) == (least_errors(text.split(), wanted) <= len(wanted) // 10), text
