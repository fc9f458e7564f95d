"""Quality rules: lines labelled content or boilerplate by a linear-chain conditional random field."""

from __future__ import annotations

import re
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlife.llm import chain
from fleetlife.llm.common import bounded_sample, on_texts, share_code

GRAM = 5
LEAST_WORDS = 10
REPEAT_PERCENT = 20
LEAST_CONTENT = 0.5  # share of a text's words in content lines that keeps it
SAMPLE_TEXTS = 3000  # labelled texts that the fit reads, about that many at most
SPACE = re.compile(r"[\x20\x09-\x0D]+")
DIGIT = re.compile(r"[0-9]")
SYMBOL = re.compile(r"[#*$%&|<>]")
STEPS = 8  # bins of a feature
BOILERPLATE, CONTENT = 0, 1


def split_words(text: str) -> list[str]:
    """Maximal runs without the six ASCII white-space characters."""
    return text.split() if text.isascii() and not re.search(r"[\x1c-\x1f]", text) else [w for w in SPACE.split(text) if w]


def repeated_words(words: list[str], gram: int = GRAM) -> int:
    """How many words stand in a window of ``gram`` words that is found twice or more."""
    n = len(words)
    if n <= gram:
        return 0
    number: dict[str, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    key = ids[: n - gram + 1]
    for i in range(1, gram):
        nxt = ids[i : n - gram + 1 + i]
        if key.max() < (1 << 62) // (len(number) + 1):
            key = key * len(number) + nxt
        else:  # number the pairs anew, so that the key stays exact
            key = np.unique(key, return_inverse=True)[1] * np.int64(len(number)) + nxt
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n + 1, np.int64)
    starts = np.flatnonzero(twice)
    np.add.at(covered, starts, 1)
    np.add.at(covered, starts + gram, -1)
    return int((np.cumsum(covered)[:n] > 0).sum())


FEATURES = ("words", "mean word", "symbols", "digits", "repeats", "new words", "long words", "short words", "ends", "seen")


def line_values(line: str, words: list[str], seen: bool) -> tuple[float, ...]:
    """Ten numbers from 0 to 1 that describe a line with words."""
    sizes = [len(w) for w in words]
    n, chars = len(words), sum(sizes)
    symbols, digits = len(SYMBOL.findall(line)), len(DIGIT.findall(line))
    return (
        min(n, 64) / 64, min(chars / n, 16) / 16, min(1.0, 4 * symbols / n), min(1.0, 4 * digits / chars),
        1 - len(set(words)) / n, sum(map(eq, words, words[1:])) / n,
        sum([s > 12 for s in sizes]) / n, sum([s < 4 for s in sizes]) / n, float(words[-1][-1] in ".!?:;…。"), float(seen))


def describe(text: str | None) -> tuple[dict[str, int], np.ndarray, np.ndarray]:
    """(base counts, values of the lines with words, their numbers of words)."""
    text = text or ""
    words, values, sizes, met, dup = [], [], [], set(), 0
    for line in text.split("\n"):
        mine = split_words(line)
        if not mine:
            continue
        seen = line in met
        dup += seen
        met.add(line)
        words += mine
        sizes.append(len(mine))
        values.append(line_values(line, mine, seen))
    base = {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(SYMBOL.findall(text)), "n_dup_lines": dup,
        "n_repeat_words": repeated_words(words)}
    return base, np.array(values).reshape(-1, len(FEATURES)), np.array(sizes, np.int64)


def columns_of(values: np.ndarray) -> np.ndarray:
    """The one-hot columns of every line: each number falls in one of ``STEPS`` bins; the last column is the constant."""
    bins = np.minimum((values * STEPS).astype(np.int64), STEPS - 1) + np.arange(values.shape[1]) * STEPS
    return np.c_[bins, np.full(len(values), values.shape[1] * STEPS)]


@dataclass
class LineModel:
    weights: np.ndarray
    trans: np.ndarray
    first: np.ndarray
    share: float = LEAST_CONTENT

    def content_shares(self, values: list[np.ndarray], sizes: list[np.ndarray]) -> list[float]:
        """Per text the share of its words in lines that Viterbi decoding marks as content; 0 without words."""
        lengths = np.array([len(v) for v in values], np.int64)
        if not lengths.sum():
            return [0.0] * len(values)
        emission = self.weights[columns_of(np.concatenate(values))].sum(axis=1)
        marks = np.split(chain.viterbi(emission, lengths, self.trans, self.first), np.cumsum(lengths)[:-1])
        return [float(s[m == CONTENT].sum() / s.sum()) if len(s) else 0.0 for m, s in zip(marks, sizes, strict=True)]


def fit_lines(
    docs: DataFrame, labels: DataFrame, doc: str = "doc_id", text: str = "text", sample_texts: int = SAMPLE_TEXTS,
) -> LineModel:
    """Learn from documents with a quality label: their lines count as content (1) or boilerplate (0) like the document.

    About ``sample_texts`` labelled documents (by a hash of their id), balanced between the labels as far as they go, are
    described line by line on the executors; only their line features reach the driver. A document with several labels
    takes the lowest. Without labels every line is content.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(
        F.min(F.col("quality").cast("int")).alias("quality"))
    half = [bounded_sample(known.where(F.col("quality") == q), ["doc_id"], sample_texts // 2) for q in (0, 1)]
    chosen = F.broadcast(half[0].unionByName(half[1]))  # bounded by sample_texts
    rows = docs.select(F.col(doc).alias("doc_id"), F.col(text).alias("text"))
    schema = pa.schema([("values", pa.list_(pa.float64()))])

    def lines(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                values = describe(batch.column(0)[i].as_py())[1]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1).slice(i, 1), batch.column(2).slice(i, 1), pa.array([values.ravel()], schema.field(0).type)],
                    names=["quality", "doc_id", "values"])

    share_code(docs.sparkSession)
    sample = rows.join(chosen, "doc_id").select("text", "quality", F.col("doc_id").cast("string").alias("doc_id")).mapInArrow(
        lines, "quality int, doc_id string, values array<double>").collect()
    sample.sort(key=lambda r: (r.doc_id, r["values"]))  # the fit does not depend on the order of tasks
    texts = [(np.array(r["values"]).reshape(-1, len(FEATURES)), r.quality) for r in sample if len(r["values"])]
    size = len(FEATURES) * STEPS + 1
    if len({q for _, q in texts}) < 2:
        weights = np.zeros((size, 2))
        weights[-1, CONTENT] = 1.0
        return LineModel(weights, np.zeros((2, 2)), np.zeros(2))
    columns = columns_of(np.concatenate([v for v, _ in texts]))
    lengths = np.array([len(v) for v, _ in texts])
    gold = np.repeat(np.array([CONTENT if q else BOILERPLATE for _, q in texts]), lengths)
    items = np.arange(len(columns))
    return LineModel(*chain.fit(
        np.repeat(items, columns.shape[1]), columns.ravel(), len(items), size, items, gold, lengths, 2, rounds=80, rate=0.2))


def quality_of(model: LineModel, text: str | Column = "text") -> Column:
    """A struct of the base counts, ``content_share`` and both verdicts for each whole text; null counts as empty."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    schema = pa.schema([*((n, pa.int64()) for n in names), ("content_share", pa.float64()), ("base_failed", pa.bool_()),
                        ("kept", pa.bool_())])

    def make():
        def work(texts: list[str | None]) -> dict[str, list]:
            found = [describe(t) for t in texts]
            out = {n: [b[n] for b, _, _ in found] for n in names}
            share = model.content_shares([v for _, v, _ in found], [s for _, _, s in found])
            failed = [b["n_words"] < LEAST_WORDS or 100 * b["n_repeat_words"] > REPEAT_PERCENT * b["n_words"] for b, _, _ in found]
            return out | {"content_share": share, "base_failed": failed,
                          "kept": [not f and s >= model.share for f, s in zip(failed, share, strict=True)]}

        return work

    return on_texts(make, schema)(F.col(text) if isinstance(text, str) else text)


def judge_quality(docs: DataFrame, labels: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, content_share), one
    per row of ``docs``. Null and empty texts have no words and fail; repeated rows stay."""
    model = fit_lines(docs, labels, doc, text)
    return docs.select(F.col(doc).alias("doc_id"), quality_of(model, F.col(text)).alias("q")).select("doc_id", "q.*")
