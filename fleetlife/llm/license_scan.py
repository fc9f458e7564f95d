"""License notices by diagonal voting: word k-grams joined to template positions, added up per offset."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetlife.functions.staging_area import stage
from fleetlife.llm.common import share_code, slices

K = 3
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
SLACK = 2  # neighbouring diagonals: that many inserted or left-out words, or as many as the notice tolerates, if more
SHARE = 0.9  # of a notice's words that must stand in the text; the rest may be changed, left out or inserted words

# Phrases and labels that every scan counts.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
# Notices of well-known public licenses, in the usual wording, and the labels they add.
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
    "documentation files": "mit",
    "released under the mit license": "mit",
    "licensed under the apache license version 2 0": "apache-2",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an "
    "as is basis": "apache-2",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "creative commons attribution noncommercial 4 0 international license": "cc-by-nc",
    "licensed under the gnu general public license version 3": "gpl-3",
    "licensed under the gnu general public license version 2": "gpl-2",
    "you can redistribute it and or modify it under the terms of the gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "mozilla public license version 2 0": "mpl-2",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the "
    "following conditions are met": "bsd",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "isc",
    "creative commons attribution sharealike 4 0 international license": "cc-by-sa",
    "creative commons attribution 4 0 international license": "cc-by",
}


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased (A to Z) words of digits, letters a to z and everything beyond ASCII, in UTF-8."""
    return WORD.findall((text or "").encode("utf-8", "surrogatepass").lower())


def tolerated(size: int, share: float) -> int:
    """Changed, extra or missing words that a notice of ``size`` words may have."""
    return int((1 - share) * size + 1e-9)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word, 7)
        return value


def gram_hashes(words: list[bytes], k: int, memo: dict[bytes, int]) -> np.ndarray:
    """A 64-bit hash of every ``k`` consecutive words."""
    if len(words) < k:
        return np.empty(0, np.int64)
    h = np.array([memo[w] for w in words], np.uint64)
    n = len(h) - k + 1
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n]
    return (out ^ (out >> np.uint64(32))).view(np.int64)


def _templates(phrases: dict[str, str], notices: dict[str, str], k: int) -> list[tuple[list[bytes], str, bool]]:
    found = [(words_of(t), label, base) for part, base in ((phrases, True), (notices, False)) for t, label in part.items()]
    if any(len(w) < k for w, _, _ in found):
        raise ValueError(f"a template needs {k} words at least")
    return found


def _grams(known: np.ndarray, k: int):
    """Per document its number of words and the hashes of its rolling k-grams, after a first entry of zero; the text goes
    along only where some gram is among the templates', for the verification later."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _Hashes()
        for batch in batches:
            start = 0
            for part in slices(batch.column(2)):
                numbers, texts, grams, ends = [], [], [], [0]
                for text in part:
                    words = words_of(text)
                    h = gram_hashes(words, k, memo)
                    numbers.append(len(words))
                    texts.append(text if np.isin(h, known).any() else None)
                    grams += [np.zeros(1, np.int64), h]
                    ends.append(ends[-1] + 1 + len(h))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(start, len(part)), batch.column(1).slice(start, len(part)),
                    pa.array(numbers, pa.int64()), pa.array(texts, pa.string()),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(grams)))],
                    names=["doc_id", "digest", "n_words", "text", "grams"])
                start += len(part)

    return run


def _verify(templates: list[tuple[list[bytes], str, bool]], share: float, slack: int):
    """Per text: which spans really hold their template. Base phrases must stand word for word; of a notice
    ``1 - share`` of the words may differ, so short ones must stand as they are."""

    def errors(words: list[bytes], wanted: list[bytes]) -> int:
        """The fewest changed, extra or missing words of ``wanted`` anywhere in ``words``."""
        row = best = list(range(len(wanted) + 1))
        for w in words:
            after = [0]
            for j, t in enumerate(wanted, 1):
                after.append(min(row[j - 1] + (w != t), row[j] + 1, after[-1] + 1))
            row, best = after, best if best[-1] <= after[-1] else after
        return best[-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                words, places, labels, best = words_of(row["text"]), [], {}, 0.0
                for span in row["spans"]:
                    wanted, label, base = templates[span["template"]]
                    if base:
                        first = [p for p in range(max(0, span["low"]), span["high"] + 1) if words[p : p + len(wanted)] == wanted]
                        places += first
                        fit = float(bool(first))
                    else:
                        allowed = tolerated(len(wanted), share)
                        wide = max(slack, allowed)
                        wrong = errors(words[max(0, span["low"] - wide) : span["high"] + len(wanted) + wide], wanted)
                        fit = 1 - wrong / len(wanted) if wrong <= allowed else 0.0
                    if fit > 0:
                        labels[label] = labels.get(label, False) or base
                        best = max(best, fit)
                out.append({
                    "digest": row["digest"], "n_base": len(places), "first_word": min(places, default=None),
                    "last_word": max(places, default=None), "base_labels": ",".join(sorted(n for n, b in labels.items() if b)),
                    "labels": ",".join(sorted(labels)), "score": best})
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=pa.schema([
                    ("digest", pa.string()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
                    ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())]))

    return run


def scan_licenses(
    docs: DataFrame, doc: str = "doc_id", text: str = "text", phrases: dict[str, str] | None = None,
    notices: dict[str, str] | None = None, k: int = K, slack: int = SLACK, share: float = SHARE,
) -> DataFrame:
    """Rows (doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score), one per row of ``docs``.

    Every rolling k-gram of every text is joined to the template positions that hold it. A match votes for the diagonal
    (text position - template position); votes are added per text, template and diagonal; diagonals at most ``slack``
    apart (or as many as the notice tolerates wrong words) merge into a span, and spans with enough votes are verified
    against the words. A wrong word costs ``k`` votes at most, so no notice within the tolerance is lost, as long as it keeps
    one k-gram. ``n_base`` counts all places of
    the base ``phrases``; ``labels`` adds what whole ``notices`` say; ``score`` is the best verified share, 0 without.

    Only matches are shuffled, and only texts with a match meet their spans again. Equal texts share one verification.
    Null and empty texts have no words and empty labels; null and repeated ids stay as rows.
    """
    templates = _templates(PHRASES if phrases is None else phrases, NOTICES if notices is None else notices, k)
    memo = _Hashes()
    postings = [(int(g), n, p) for n, (words, _, _) in enumerate(templates) for p, g in enumerate(gram_hashes(words, k, memo))]
    known = np.array(sorted({g for g, _, _ in postings}), np.int64)
    table = docs.sparkSession.createDataFrame(postings, "gram bigint, template int, place int")
    source = docs.select(F.col(doc).cast("bigint").alias("doc_id"), F.coalesce(F.md5(text), F.lit("")).alias("digest"),
                         F.col(text).cast("string").alias("text"))
    share_code(docs.sparkSession)
    grams = source.mapInArrow(
        _grams(known, k), "doc_id bigint, digest string, n_words bigint, text string, grams array<bigint>").select(
        "doc_id", "digest", "n_words", "text", F.posexplode("grams").alias("nth", "gram"))
    head = F.col("nth") == 0  # one row per document
    # The templates are part of the program, so their size does not depend on the data.
    hits = stage(grams.join(F.broadcast(table.withColumnRenamed("gram", "of")), ~head & (F.col("gram") == F.col("of")), "left")
                 .where(head | F.col("template").isNotNull())
                 .select("doc_id", "digest", "n_words", F.when(head, F.col("text")).alias("text"),
                         (F.col("nth") - 1).alias("at"), "template", "place"), "license-grams")
    votes = hits.where("template is not null").groupBy(
        "digest", "template", (F.col("at") - F.col("place")).alias("diagonal")).agg(F.countDistinct("at").alias("votes"))
    line = Window.partitionBy("digest", "template").orderBy("diagonal")
    sizes = [len(w) for w, _, _ in templates]
    apart = F.element_at(F.array(*[F.lit(max(slack, tolerated(n, share))) for n in sizes]), F.col("template") + 1)
    fresh = F.col("diagonal") - F.lag("diagonal").over(line) > apart
    runs = votes.withColumn("fresh", F.coalesce(fresh, F.lit(True)).cast("int")).withColumn("run", F.sum("fresh").over(line))
    spans = runs.groupBy("digest", "template", "run").agg(
        F.sum("votes").alias("votes"), F.min("diagonal").alias("low"), F.max("diagonal").alias("high"))
    needed = F.element_at(F.array(*[
        F.lit(max(1, n - k + 1 - (0 if base else k * tolerated(n, share)))) for n, (_, _, base) in zip(sizes, templates, strict=True)
    ]), F.col("template") + 1)
    spans = spans.where(F.col("votes") >= needed).groupBy("digest").agg(
        F.collect_list(F.struct("template", "low", "high")).alias("spans"))
    texts = hits.where("at = -1 and text is not null").groupBy("digest").agg(F.max("text").alias("text"))
    found = texts.join(spans, "digest").mapInArrow(
        _verify(templates, share, slack), "digest string, n_base bigint, first_word bigint, last_word bigint, base_labels string, "
        "labels string, score double")
    return hits.where("at = -1").select("doc_id", "digest", "n_words").join(found, "digest", "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("bigint").alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"))

