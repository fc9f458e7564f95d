"""Toxicity of texts: a learned lexicon matched through Levenshtein automata, weighed by context."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlife.functions.staging_area import stage
from fleetlife.llm.common import bounded_sample, fold_of, on_texts, share_code, slices

FOLDS, HELD_OUT = 5, 0
SAMPLE_TEXTS = 8_000  # labelled texts that the fit reads, about that many at most
STEMS = range(3, 9)  # lengths of word beginnings that may become terms
LEAST_ODDS = 3.0  # natural log of how much more often a term stands in toxic texts
LEAST_EVIDENCE = 20.0  # log-likelihood ratio of a term
MISSPELT = 0.7  # what an unseen misspelling counts of its term
SIDE = 80  # characters of context on either side
LONGEST_SHORT = 9  # letters of a word that has one error against a term of up to 8
HELD = 400_000  # trie nodes in the states that an automaton keeps, at most
REMEMBERED = 300_000  # words whose matches a task keeps
WORD = re.compile(r"[^\W_]+")
# Cue words of reported speech and of address, in the languages at hand.
REPORTED = frozenset(
    "said says say quote quoted quotes called calls wrote writes term word words phrase sagte sagt nannte schrieb wort "
    "zitat dit disait appelle mot citation dijo dice llama palabra cita".split())
ADDRESS = frozenset("you your yours youre u ur du dich dein deine ihr tu te toi vous votre usted eres tus ustedes".split())
OPENING, CLOSING = "\"“„«‘", "\"”“»’"


def edits_for(term: str) -> int:
    """Spelling errors that a whole word may have and still be found."""
    return 0 if len(term) < 4 else 1 if len(term) < 9 else 2


def stem_edits(stem: str) -> int:
    """Spelling errors that the beginning of a word may have and still count as the stem."""
    return 0 if len(stem) < 5 else 1


def _shorter(word: str) -> set[str]:
    """The word with one letter left out."""
    return {word[:i] + word[i + 1 :] for i in range(len(word))}


def _pieces(size: int, errors: int) -> list[tuple[int, int]]:
    cuts = [round(i * size / (errors + 1)) for i in range(errors + 2)]
    return list(zip(cuts, cuts[1:], strict=False))


@dataclass
class LexiconAutomaton:
    """The Levenshtein automata of all terms, intersected with the trie of the lexicon and made deterministic as needed.

    A state is a set of (trie node, errors so far); reading a letter follows the trie edge, or spends an error on a
    substituted or an extra letter, and left-out letters are followed at once. Only states that words lead to are made.
    Stems accept any continuation; whole words end with the word.
    """

    words: dict[str, int]
    stems: dict[str, int]
    children: list[dict[str, int]] = field(default_factory=lambda: [{}])
    ends: list[int | None] = field(default_factory=lambda: [None])
    stem_ends: list[int | None] = field(default_factory=lambda: [None])
    budget: list[int] = field(default_factory=lambda: [0])
    states: dict[frozenset, int] = field(default_factory=dict)
    sets: list[frozenset] = field(default_factory=list)
    moves: list[dict[str, int]] = field(default_factory=list)
    stems_at: list[tuple[tuple[int, int], ...]] = field(default_factory=list)
    accepts: list[tuple[tuple[int, int], ...]] = field(default_factory=list)
    exact: set[str] = field(default_factory=set)
    shortened: set[str] = field(default_factory=set)
    pieces: dict[int, dict[tuple[int, int], set[str]]] = field(default_factory=dict)
    beginnings: dict[tuple[int, int], set[str]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        for term, number in self.words.items():
            self.ends[self._path(term, edits_for(term))] = number
        for term, number in self.stems.items():
            self.stem_ends[self._path(term, stem_edits(term))] = number
        self.stem_budget = {n: stem_edits(t) for t, n in self.stems.items()}
        self._index()
        self._reset()

    def _index(self) -> None:
        """What a matching word has in common with its term, so that other words need not enter the automaton: with one
        error, a form with at most one letter left out; with more, one of ``errors + 1`` pieces, shifted by the errors at
        most; of a stem, the beginning or one of its pieces."""
        for term in self.words:
            errors = edits_for(term)
            self.exact.add(term)
            if errors == 1:
                self.shortened |= _shorter(term) | {term}
            elif errors:
                for a, b in _pieces(len(term), errors):
                    for size in range(len(term) - errors, len(term) + errors + 1):
                        for at in range(max(0, a - errors), min(a + errors, size - (b - a)) + 1):
                            self.pieces.setdefault(size, {}).setdefault((at, at + b - a), set()).add(term[a:b])
        for stem in self.stems:
            errors = stem_edits(stem)
            for a, b in _pieces(len(stem), errors):
                for at in range(max(0, a - errors), a + errors + 1) if a else [0]:
                    self.beginnings.setdefault((at, at + b - a), set()).add(stem[a:b])

    def may_match(self, word: str) -> bool:
        """False only for words that ``match`` finds no term for."""
        return (
            word in self.exact
            or any(word[a:b] in known for (a, b), known in self.beginnings.items())
            or any(word[a:b] in known for (a, b), known in self.pieces.get(len(word), {}).items())
            or (bool(self.shortened) and len(word) <= LONGEST_SHORT and (word in self.shortened or not self.shortened.isdisjoint(_shorter(word)))))

    def _path(self, term: str, errors: int) -> int:
        node = 0
        self.budget[0] = max(self.budget[0], errors)
        for letter in term:
            if letter not in self.children[node]:
                self.children[node][letter] = len(self.children)
                self.children.append({})
                self.ends.append(None)
                self.stem_ends.append(None)
                self.budget.append(0)
            node = self.children[node][letter]
            self.budget[node] = max(self.budget[node], errors)  # the most errors any term below may have
        return node

    def _reset(self) -> None:
        self.states, self.sets, self.moves, self.stems_at, self.accepts, self.held = {}, [], [], [], [], 0
        self.dead = self._state({})
        self.initial = self._state(self._closed({0: 0}))

    def _closed(self, nodes: dict[int, int]) -> dict[int, int]:
        """Adds what can be reached by leaving letters out."""
        todo = list(nodes.items())
        while todo:
            node, errors = todo.pop()
            for child in self.children[node].values():
                if errors + 1 <= self.budget[child] and errors + 1 < nodes.get(child, 99):
                    nodes[child] = errors + 1
                    todo.append((child, errors + 1))
        return nodes

    def _state(self, nodes: dict[int, int]) -> int:
        key = frozenset(nodes.items())
        if key not in self.states:
            self.states[key] = len(self.sets)
            self.sets.append(key)
            self.held += len(key)
            self.moves.append({})
            self.stems_at.append(tuple(sorted(
                (self.stem_ends[n], e) for n, e in key
                if self.stem_ends[n] is not None and e <= self.stem_budget[self.stem_ends[n]])))
            self.accepts.append(tuple(sorted(
                (self.ends[n], e) for n, e in key
                if self.ends[n] is not None and e <= edits_for(self.term_of(self.ends[n])))))
        return self.states[key]

    def term_of(self, number: int) -> str:
        if not hasattr(self, "_names"):
            self._names = {n: t for t, n in self.words.items()}
        return self._names[number]

    def _step(self, state: int, letter: str) -> int:
        after: dict[int, int] = {}
        for node, errors in self.sets[state]:
            if errors + 1 <= self.budget[node] and errors + 1 < after.get(node, 99):
                after[node] = errors + 1  # an extra letter
            for edge, child in self.children[node].items():
                cost = errors + (edge != letter)
                if (cost <= self.budget[child] if cost else True) and cost < after.get(child, 99):
                    after[child] = cost
        to = self._state(self._closed(after))
        self.moves[state][letter] = to
        return to

    def match(self, word: str) -> tuple[tuple[int, int], ...]:
        """(term, fewest errors) of every term the word matches; a stem matches a beginning of the word."""
        if len(self.sets) > 50_000 or self.held > HELD:
            self._reset()
        state, found = self.initial, dict(self.stems_at[self.initial])
        for letter in word:
            to = self.moves[state].get(letter)
            state = self._step(state, letter) if to is None else to
            if state == self.dead:
                break
            for stem, errors in self.stems_at[state]:
                found[stem] = min(errors, found.get(stem, 99))
        else:
            for term, errors in self.accepts[state]:
                found[term] = min(errors, found.get(term, 99))
        return tuple(found.items())


def quoted(before: str, after: str) -> bool:
    """Whether the context separates the words from the writer: inside quotation marks, or reported without address."""
    marks = [c for c in before if c in OPENING or c in CLOSING]
    straight = marks.count('"') % 2 == 1
    curled = bool(marks) and marks[-1] in "“„«‘"
    if (straight or curled) and any(c in CLOSING for c in after):
        return True
    near = set(WORD.findall(before.lower())[-6:]) | set(WORD.findall(after.lower())[:6])
    return bool(near & REPORTED) and not near & ADDRESS


@dataclass
class Matcher:
    automaton: LexiconAutomaton
    matching: dict[str, tuple] = field(default_factory=dict)
    others: set[str] = field(default_factory=set)

    def hits(self, text: str | None) -> list[tuple[int, int, bool]]:
        """(term, errors, quoted) of each distinct matching word; a word that also stands unquoted counts as direct."""
        low = (text or "").lower()
        if len(self.others) > REMEMBERED:
            self.others.clear()
        found = {}
        for w in set(WORD.findall(low)) - self.others:
            m = self.matching.get(w)
            if m is None:
                m = self.automaton.match(w) if self.automaton.may_match(w) else ()
                if m:
                    self.matching[w] = m
                else:
                    self.others.add(w)
            if m:
                found[w] = m
        if not found:
            return []
        direct: dict[str, bool] = {}
        for place in WORD.finditer(low):
            if place[0] in found and not direct.get(place[0]):
                a, b = place.span()
                direct[place[0]] = not quoted(low[max(0, a - SIDE) : a], low[b : b + SIDE])
        return [(term, errors, not direct.get(w, True)) for w, m in sorted(found.items()) for term, errors in m]


@dataclass
class ToxicityModel:
    automaton: LexiconAutomaton
    weights: dict[tuple[int, int], float]  # log odds of (term, errors)
    coefficients: np.ndarray  # of the features, the constant last
    families: dict[int, int] = field(default_factory=dict)  # of a word that begins with a stem, the stem: one term for the features

    def features(self, hits: list[tuple[int, int, bool]]) -> tuple[float, float, float]:
        """The largest and second largest weight of distinct terms that are meant, and the largest of quoted ones."""
        best: dict[tuple[int, bool], float] = {}
        for term, errors, inside in hits:
            w = self.weights.get((term, errors), 0.0)
            key = self.families.get(term, term), inside
            best[key] = max(w, best.get(key, 0.0))
        direct = sorted((w for (_, inside), w in best.items() if not inside), reverse=True)
        return (*[*direct, 0.0, 0.0][:2], max((w for (_, inside), w in best.items() if inside), default=0.0))

    def score(self, hits: list[tuple[int, int, bool]]) -> float:
        z = float(np.dot(self.coefficients, (*self.features(hits), 1.0)))
        return 1 / (1 + math.exp(-max(-35.0, min(35.0, z))))


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many toxic and other texts each word and each word beginning stands."""
    counts = {0: Counter(), 1: Counter()}
    for batch in batches:
        labels, start = batch.column(1).to_pylist(), 0
        for part in slices(batch.column(0)):
            for text, toxic in zip(part, labels[start : start + len(part)], strict=True):
                words = set(WORD.findall((text or "").lower()))
                counts[toxic].update(words)
                counts[toxic].update({f"{w[:n]}*" for w in words for n in STEMS if n < len(w)})
            start += len(part)
    terms = list(counts[0].keys() | counts[1].keys())
    for i in range(0, len(terms), 50_000):
        part = terms[i : i + 50_000]
        yield pa.RecordBatch.from_arrays(
            [pa.array(part), *(pa.array([counts[c][t] for t in part], pa.int64()) for c in (1, 0))], names=["term", "toxic", "other"])


def _log_odds(toxic: float, other: float, n_toxic: int, n_other: int) -> float:
    return math.log((toxic + 0.5) / (n_toxic + 1)) - math.log((other + 0.5) / (n_other + 1))


def _evidence(n_toxic: int, n_other: int) -> Column:
    """The log-likelihood ratio of a term in ``toxic`` and ``other`` texts against equal shares."""
    share = (F.col("toxic") + F.col("other")) / F.lit(float(n_toxic + n_other))
    total = F.lit(0.0)
    for n, size in ((F.col("toxic"), n_toxic), (F.col("other"), n_other)):
        total = total + F.when(n > 0, n * F.log(n / (size * share))).otherwise(0.0)
        total = total + F.when((n < size) & (share < 1), (size - n) * F.log((size - n) / (size * (1 - share)))).otherwise(0.0)
    return 2 * total


def _logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Weighted logistic regression with a small ridge, by Newton steps; ``y`` toxic of ``n`` texts per row."""
    x = np.c_[x, np.ones(len(x))]
    ridge = np.diag([0.05, 0.05, 0.05, 1e-3])
    b = np.zeros(x.shape[1])

    def loss(b: np.ndarray) -> float:
        z = x @ b
        return float((n * np.logaddexp(0, z) - y * z).sum() + b @ ridge @ b / 2)

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -35, 35)))
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - n * p) - ridge @ b)
        size, now = 1.0, loss(b)
        while size > 1e-6 and not loss(b + size * step) <= now:
            size /= 2
        b = b + size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return b


def training_texts(
    docs: DataFrame, labels: DataFrame, doc: str = "doc_id", text: str = "text", sample_texts: int = SAMPLE_TEXTS,
) -> DataFrame:
    """(text, toxic) of about ``sample_texts`` labelled documents outside the held-out fold, equal texts once.

    A document with several labels is toxic if one says so, and so is a text of several documents.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(
        F.max(F.col("toxic").cast("int")).alias("toxic")).where(fold_of("doc_id", FOLDS) != HELD_OUT)
    chosen = F.broadcast(bounded_sample(known, ["doc_id"], sample_texts))  # bounded by sample_texts
    rows = docs.select(F.col(doc).alias("doc_id"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    return rows.join(chosen, "doc_id").groupBy("text").agg(F.max("toxic").alias("toxic"))


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, doc: str = "doc_id", text: str = "text", sample_texts: int = SAMPLE_TEXTS,
) -> ToxicityModel:
    """Learn lexicon, weights and context coefficients from labelled documents outside the held-out fold.

    Terms are words, and beginnings of words, that stand far more often in toxic texts; counts are summed by Spark, and all
    with enough odds and evidence make the lexicon, which the size of the sample bounds. Then the sample is matched, and every (term, errors) gets the log odds of its own counts, so that a chance neighbour of a term has no weight. Without labels the score is 0 everywhere.
    """
    sample = stage(training_texts(docs, labels, doc, text, sample_texts), "toxicity-sample")
    sizes = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_other = sizes.get(1, 0), sizes.get(0, 0)
    none = ToxicityModel(LexiconAutomaton({}, {}), {}, np.array([0.0, 0.0, 0.0, -6.0]))
    if not n_toxic or not n_other:
        return none
    share_code(docs.sparkSession)
    counted = sample.mapInArrow(_term_counts, "term string, toxic bigint, other bigint").groupBy("term").agg(
        F.sum("toxic").alias("toxic"), F.sum("other").alias("other")).where("toxic >= 3")
    odds = F.log((F.col("toxic") + 0.5) / (n_toxic + 1)) - F.log((F.col("other") + 0.5) / (n_other + 1))
    likely = counted.where((odds >= LEAST_ODDS) & (_evidence(n_toxic, n_other) >= LEAST_EVIDENCE))
    good = {r.term: r for r in likely.collect()}  # of words that repeat within the bounded sample
    whole = [t for t in good if not t.endswith("*")]
    largest: dict[str, int] = {}  # the most texts of one word, per beginning
    for w in whole:
        for n in STEMS:
            largest[w[:n]] = max(largest.get(w[:n], 0), good[w].toxic)
    stems: list[str] = []
    for s in sorted((t[:-1] for t in good if t.endswith("*")), key=lambda s: (len(s), s)):
        # A beginning stands for many words; where one word explains it, that word is the better term.
        if not s.startswith(tuple(stems)) and largest.get(s, 0) < 0.8 * good[f"{s}*"].toxic:
            stems.append(s)
    # Words that begin with a stem stay too: they have their own errors and weights.
    terms = sorted([*whole, *(f"{s}*" for s in stems)])
    numbers = {t: i for i, t in enumerate(terms)}
    automaton = LexiconAutomaton({t: i for t, i in numbers.items() if not t.endswith("*")},
                                 {t[:-1]: i for t, i in numbers.items() if t.endswith("*")})

    def matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(automaton)
        for batch in batches:
            labels_, start = batch.column(1), 0
            for part in slices(batch.column(0)):
                found = [";".join(sorted({f"{t},{e},{int(q)}" for t, e, q in matcher.hits(x)})) for x in part]
                yield pa.RecordBatch.from_arrays([labels_.slice(start, len(part)), pa.array(found, pa.string())], names=["toxic", "hits"])
                start += len(part)

    # One row per combination of hits; the sample is bounded, and so is this.
    rows = sample.mapInArrow(matched, "toxic int, hits string").groupBy("hits").agg(
        F.sum("toxic").alias("toxic"), F.count("*").alias("n")).orderBy("hits").collect()
    parsed = [([tuple(map(int, h.split(","))) for h in r.hits.split(";") if h], r.toxic, r.n) for r in rows]
    seen: dict[tuple[int, int], list[int]] = {}
    for hits, toxic, n in parsed:
        for key in {(t, e) for t, e, _ in hits}:
            c = seen.setdefault(key, [0, 0])
            c[0] += toxic
            c[1] += n - toxic
    weights = {}
    for term, number in numbers.items():
        own = max(0.0, _log_odds(good[term].toxic, good[term].other, n_toxic, n_other))
        for errors in range((stem_edits(term[:-1]) if term.endswith("*") else edits_for(term)) + 1):
            t, o = seen.get((number, errors), (0, 0))
            weights[number, errors] = max(0.0, _log_odds(t, o, n_toxic, n_other)) if t + o else own * MISSPELT**errors
    families = {n: automaton.stems[s] for t, n in automaton.words.items() for s in (t[:i] for i in STEMS) if s in automaton.stems}
    model = ToxicityModel(automaton, weights, none.coefficients, families)
    x = np.array([model.features([(t, e, bool(q)) for t, e, q in hits]) for hits, _, _ in parsed])
    model.coefficients = _logistic(x, np.array([t for _, t, _ in parsed], float), np.array([n for _, _, n in parsed], float))
    return model


def toxicity_of(model: ToxicityModel, text: str | Column = "text") -> Column:
    """The score of each whole text, from 0 to 1; null and empty texts have the score of a text without terms."""
    def make():
        matcher = Matcher(model.automaton)
        return lambda texts: {"score": [model.score(matcher.hits(t)) for t in texts]}

    return on_texts(make, pa.schema([("score", pa.float64())]))(F.col(text) if isinstance(text, str) else text)["score"]


def score_toxicity(docs: DataFrame, labels: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, held_out, score, predicted), one per row of ``docs``, repeated rows included; a row without an id is not
    held out. An empty table gives no rows."""
    model = fit_toxicity(docs, labels, doc, text)
    held_out = F.coalesce(fold_of(doc, FOLDS) == HELD_OUT, F.lit(False))
    scored = docs.select(F.col(doc).alias("doc_id"), held_out.alias("held_out"), toxicity_of(model, F.col(text)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
