"""Language of texts by a linear-chain conditional random field that labels every word."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlife.functions.staging_area import stage
from fleetlife.llm import chain
from fleetlife.llm.common import fold_of, on_texts

FOLDS, HELD_OUT = 4, 2
SAMPLE_TEXTS = 90  # distinct labelled texts of each language that the fit reads, at most about that many
LONGEST = 1 << 18  # bytes of a text that the fit reads; longer texts teach nothing, but are labelled like any other
WINDOW = 200  # words of a training sequence; a text gives as many as it needs
BUCKETS = 1 << 15
GRAM = 4
TOGETHER = 4 << 20  # bytes of text whose words are labelled side by side
REMEMBERED = 200_000  # words whose scores a task keeps
WORD = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def word_features(words: list[str], lexicon: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the features of distinct words, rows ascending.

    A word is framed by marks and gives all its n-grams up to ``GRAM`` letters, so those with a mark are its affixes;
    words of the learned lexicon have a feature of their own.
    """
    framed = "".join([f"\x02{w}\x03" for w in words])
    code = np.frombuffer(framed.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    size = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    row = np.repeat(np.arange(len(words)), size)
    left = np.repeat(np.cumsum(size), size) - np.arange(len(code))
    rows, columns = [], []
    h = np.zeros(len(code), np.uint64)
    for n in range(1, GRAM + 1):
        ahead = np.zeros(len(code), np.uint64)
        ahead[: len(code) - n + 1] = code[n - 1 :]
        h = (h ^ ahead) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(31)
        fits = (left >= n) if n > 1 else (code > 3)
        rows.append(row[fits])
        columns.append((h[fits] % np.uint64(BUCKETS)).astype(np.int64))
    known = np.array([lexicon.get(w, -1) for w in words], np.int64)
    rows.append(np.flatnonzero(known >= 0))
    columns.append(BUCKETS + known[known >= 0])
    rows, columns = np.concatenate(rows), np.concatenate(columns)
    by = np.argsort(rows, kind="stable")
    return rows[by], columns[by]


@dataclass
class LanguageModel:
    labels: list[str]
    lexicon: dict[str, int]
    weights: np.ndarray
    trans: np.ndarray
    first: np.ndarray

    @cached_property
    def _memory(self) -> tuple[dict[str, int], list[np.ndarray]]:
        return {}, []

    def _emissions(self, words: list[list[str]]) -> np.ndarray:
        """Log scores of all words in order; what a word scores is remembered."""
        known, scores = self._memory
        if len(known) > REMEMBERED:
            known.clear()
            scores.clear()
        new = list({w for part in words for w in part if w not in known})
        if new:
            rows, columns = word_features(new, self.lexicon)
            heads = np.flatnonzero(np.r_[True, np.diff(rows) > 0])
            base = len(known)
            known.update(zip(new, range(base, base + len(new)), strict=True))
            scores.append(np.add.reduceat(self.weights[columns], heads, axis=0))  # each word has a letter, so a feature
        index = np.array([known[w] for part in words for w in part], np.int64)
        table = np.concatenate(scores) if len(scores) > 1 else scores[0] if scores else np.empty((0, len(self.labels)))
        if len(scores) > 1:
            scores[:] = [table]
        return table[index]

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        words = [words_of(t) for t in texts]
        lengths = np.array([len(w) for w in words], np.int64)
        shares, _, _ = chain.forward_backward(self._emissions(words), lengths, self.trans, self.first)
        filled = np.flatnonzero(lengths)
        labels, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if len(filled):
            mean = np.add.reduceat(shares, (np.cumsum(lengths) - lengths)[filled], axis=0) / lengths[filled][:, None]
            for i, best, share in zip(filled.tolist(), mean.argmax(axis=1).tolist(), mean.max(axis=1).tolist(), strict=True):
                labels[i], scores[i] = self.labels[best], min(1.0, share)
        return labels, scores


def training_texts(
    docs: DataFrame, doc: str = "doc_id", text: str = "text", lang: str = "lang", sample_texts: int = SAMPLE_TEXTS,
) -> DataFrame:
    """(lang, text) of about ``sample_texts`` distinct texts of each language outside the held-out fold (all, if there are
    fewer), chosen by a hash of the text, so rare languages are learned too and copies count once."""
    rows = docs.select(F.col(doc).alias("doc_id"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).where(
        (fold_of("doc_id", FOLDS) != HELD_OUT) & F.col("lang").isNotNull() & (F.octet_length("text") <= LONGEST))
    hashed = rows.select("lang", "text", F.xxhash64(F.lit(0), "text").alias("hash"))
    # One row per language: small when stored, so the texts stay where they are.
    shares = stage(hashed.groupBy("lang").agg((sample_texts / F.approx_count_distinct("hash")).alias("share")), "languages")
    chosen = hashed.join(shares, "lang").where(F.pmod("hash", F.lit(1 << 30)) < F.col("share") * (1 << 30))
    return chosen.select("lang", "text").distinct()


def fit_language(
    docs: DataFrame, doc: str = "doc_id", text: str = "text", lang: str = "lang", sample_texts: int = SAMPLE_TEXTS,
) -> LanguageModel:
    """Learn from the text and the non-null language of documents outside the held-out fold.

    About ``sample_texts`` whole texts of each language reach the driver for the fit. Every word is taken to be in its
    document's language; all words that repeat in the sample are the lexicon. A document without an id belongs to no fold
    and is left out. Where nothing can be learned, every text with a letter is ``und`` with score 1.
    """
    sample = sorted(training_texts(docs, doc, text, lang, sample_texts).collect(), key=lambda r: (r.text, r.lang))
    labels = sorted({r.lang for r in sample})
    sequences, gold = [], []
    for r in sample:
        words = words_of(r.text)
        for i in range(0, len(words), WINDOW):
            sequences.append(words[i : i + WINDOW])
            gold += [labels.index(r.lang)] * len(sequences[-1])
    counts: dict[str, int] = {}
    for s in sequences:
        for w in s:
            counts[w] = counts.get(w, 0) + 1
    lexicon = {w: i for i, w in enumerate(sorted(w for w, n in counts.items() if n > 2))}
    items = {w: i for i, w in enumerate(counts)}
    if not gold:
        return LanguageModel(labels or [UNKNOWN], {}, np.zeros((BUCKETS, max(1, len(labels)))), *_flat(max(1, len(labels))))
    rows_, columns = word_features(list(items), lexicon)
    weights, trans, first = chain.fit(
        rows_, columns, len(items), BUCKETS + len(lexicon), np.array([items[w] for s in sequences for w in s]),
        np.array(gold), np.array([len(s) for s in sequences]), len(labels), rounds=30)
    return LanguageModel(labels, lexicon, weights.astype(np.float32), trans, first)


def _flat(labels: int) -> tuple[np.ndarray, np.ndarray]:
    return np.zeros((labels, labels)), np.zeros(labels)


def language_of(model: LanguageModel, text: str | Column = "text") -> Column:
    """A struct (lang_pred, score) per text: the language with the largest expected share of words, and that share.

    Shares come from forward-backward over all words, so a code-switched text has a smaller one. A text that is null or
    has no letter is ``und`` with score 0.
    """
    schema = pa.schema([("lang_pred", pa.string()), ("score", pa.float64())])

    def make():
        def work(texts: list[str | None]) -> dict[str, list]:
            labels, scores = model.predict(texts)
            return {"lang_pred": labels, "score": scores}

        return work

    return on_texts(make, schema, TOGETHER)(F.col(text) if isinstance(text, str) else text)


def identify(docs: DataFrame, doc: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Rows (doc_id, held_out, lang_pred, score), one per row of ``docs``, repeated rows included; a row without an id is not
    held out. An empty table gives no rows."""
    model = fit_language(docs, doc, text, lang)
    held_out = F.coalesce(fold_of(doc, FOLDS) == HELD_OUT, F.lit(False))
    return docs.select(F.col(doc).alias("doc_id"), held_out.alias("held_out"), language_of(model, F.col(text)).alias("p")).select(
        "doc_id", "held_out", "p.lang_pred", "p.score")
