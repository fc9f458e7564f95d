import collections
import itertools
import random
import re

import numpy as np
import pytest

from fleetlife.llm import chain, language, line_quality, toxicity

SF = "/root/testdata/sf0.01"


def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def all_paths(emission, trans, first):
    n, labels = emission.shape
    for path in itertools.product(range(labels), repeat=n):
        yield path, first[path[0]] + sum(emission[i, p] for i, p in enumerate(path)) + sum(trans[a, b] for a, b in itertools.pairwise(path))


def test_forward_backward_and_viterbi_against_all_paths():
    rng = np.random.default_rng(3)
    lengths = np.array([3, 0, 5, 1, 5, 2])
    emission, trans, first = rng.normal(size=(16, 3)) * 2, rng.normal(size=(3, 3)), rng.normal(size=3)
    gamma, moves, total = chain.forward_backward(emission, lengths, trans, first, pairs=True)
    best = chain.viterbi(emission, lengths, trans, first)
    at, logs, want_moves = 0, 0.0, np.zeros((3, 3))
    for n in lengths:
        if n:
            paths = list(all_paths(emission[at : at + n], trans, first))
            weight = np.exp([s for _, s in paths])
            logs += np.log(weight.sum())
            weight /= weight.sum()
            for i in range(n):
                for label in range(3):
                    assert gamma[at + i, label] == pytest.approx(sum(w for (p, _), w in zip(paths, weight, strict=True) if p[i] == label))
            for (p, _), w in zip(paths, weight, strict=True):
                for a, b in itertools.pairwise(p):
                    want_moves[a, b] += w
            assert tuple(best[at : at + n]) == max(paths, key=lambda x: x[1])[0]
        at += n
    assert total == pytest.approx(logs) and np.allclose(moves, want_moves)


def test_viterbi_ties_go_to_the_smaller_label():
    assert chain.viterbi(np.zeros((4, 2)), np.array([3, 1]), np.zeros((2, 2)), np.zeros(2)).tolist() == [0, 0, 0, 0]


def test_fit_learns_emissions_and_transitions():
    rng = np.random.default_rng(1)
    gold, seen = [], []
    for _ in range(200):
        state = rng.integers(2)
        for _ in range(12):
            gold.append(state)
            seen.append(state if rng.random() < 0.7 else 1 - state)
            state = state if rng.random() < 0.9 else 1 - state
    lengths = np.full(200, 12)
    weights, trans, first = chain.fit(np.array([0, 1]), np.array([0, 1]), 2, 2, np.array(seen), np.array(gold), lengths, 2)
    assert trans[0, 0] > trans[0, 1] + 1 and trans[1, 1] > trans[1, 0] + 1
    marks = chain.viterbi(weights[np.array(seen)], lengths, trans, first)
    assert (marks == gold).mean() > (np.array(seen) == gold).mean() + 0.05


# language

def test_language_on_held_out_texts(spark):
    docs, _ = tables(spark)
    got = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert len(got) == 1000 and len(held) > 150
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_language_edges_and_code_switching(spark):
    docs, _ = tables(spark)
    model = language.fit_language(docs)
    assert model.predict([]) == ([], [])
    assert model.predict([None, "", "123 !?", "\n"]) == (["und"] * 4, [0.0] * 4)
    de, fr = (docs.where(f"lang = '{x}' and n_chars between 800 and 1200").first().text for x in ("de", "fr"))
    labels, scores = model.predict([de, fr, f"{de} {fr}", de * 50])
    assert labels[0] == labels[3] == "de" and labels[1] == "fr" and scores[2] < min(scores[:2])
    one = [model.predict([t]) for t in (de, fr)]
    assert [o[0][0] for o in one] == labels[:2] and np.allclose([o[1][0] for o in one], scores[:2])


def test_language_without_training_rows(spark):
    rows = [(2, "hello there", None, 1.0), (None, "x", "en", 1.0), (3, None, "en", 1.0)]
    out = language.identify(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, score double")).collect()
    assert len(out) == 3 and all(r.lang_pred == "und" for r in out)
    assert language.identify(spark.createDataFrame([], "doc_id bigint, text string, lang string")).collect() == []


# toxicity

def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_automaton_agrees_with_edit_distances():
    rng = random.Random(5)
    words = ["abab", "ababa", "babababab", "ccccc", "cabba", "aaaaaaaaab", "dog"]
    stems = ["cab", "bbbb"]
    auto = toxicity.LexiconAutomaton({w: i for i, w in enumerate(words)}, {s: 100 + i for i, s in enumerate(stems)})
    tests = ["".join(rng.choice("abcd") for _ in range(rng.randrange(1, 12))) for _ in range(4000)]
    for w in words:
        for _ in range(60):
            s = list(w)
            for _ in range(rng.randrange(3)):
                op, at = rng.randrange(3), rng.randrange(len(s) + 1)
                s[at : at + (op > 0)] = [] if op == 1 else [rng.choice("abcd")]
            tests.append("".join(s))
    for t in tests:
        want = {i: d for i, w in enumerate(words) if (d := distance(t, w)) <= toxicity.edits_for(w)}
        want |= {100 + i: 0 for i, s in enumerate(stems) if t.startswith(s)}
        got = dict(auto.match(t))
        if any(t.startswith(s) for s in stems) and {k: v for k, v in got.items() if k >= 100} == {k: v for k, v in want.items() if k >= 100}:
            got, want = ({k: v for k, v in x.items() if k < 100} for x in (got, want))
        assert got == want, t


def spelt(i):
    return "".join(chr(97 + i // 26**k % 26) for k in range(4)) + "ko"


def test_every_proven_term_stays_and_copies_prove_nothing(spark):
    rng = random.Random(2)
    toxic = [" ".join(spelt(2000 * 7 + j) for j in rng.sample(range(2000), 32)) for _ in range(800)]
    rows = [(i, t, 1) for i, t in enumerate(toxic)] + [(1000 + i, "onlycopied madeup nonsense", 1) for i in range(40)]
    rows += [(2000 + i, f"plain text {spelt(i)}", 0) for i in range(3200)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id bigint, toxic int")
    assert toxicity.training_texts(docs, labels).where("text like 'onlycopied%'").count() == 1
    automaton = toxicity.fit_toxicity(docs, labels).automaton
    learned = set(automaton.words) | set(automaton.stems)
    assert len(automaton.words) + len(automaton.stems) > 1500 and "onlycopied" not in learned
    proven = [w for t in toxic[:50] for w in t.split() if w in automaton.words or w.startswith(tuple(automaton.stems) or ("?",))]
    assert len(proven) > 0.9 * 50 * 32


def test_rare_languages_are_learned_too(spark):
    rows = [(i, f"the of and to in that is was {spelt(i)}", "en") for i in range(6000)]
    rows += [(7000 + i, f"og ikke det er jeg en som {spelt(i)}", "da") for i in range(20)] + [(8000 + i, "og ikke copied", "da") for i in range(500)]
    rows += [(9000, "x" * (language.LONGEST + 1), "long"), (9001, "y", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    sample = language.training_texts(docs).collect()
    count = {x: sum(r.lang == x for r in sample) for x in ("en", "da", "long")}
    assert 50 < count["en"] < 140 and 8 < count["da"] <= 21 and count["long"] == 0
    found = {r.doc_id: r.lang_pred for r in language.identify(docs).collect()}
    assert all(found[7000 + i] == "da" for i in range(20)) and sum(found[i] == "en" for i in range(6000)) > 5990


def test_quotation_is_told_from_abuse():
    assert toxicity.quoted('she read "you are an ', ' of a man" aloud')
    assert toxicity.quoted("he said that the word ", " was used")
    assert not toxicity.quoted("you are an ", " and you know")
    assert not toxicity.quoted('"fine," he thought, "you ', "")
    matcher = toxicity.Matcher(toxicity.LexiconAutomaton({"idiot": 0}, {}))
    assert matcher.hits('The sign read "IDIOT" there.') == [(0, 0, True)]
    assert matcher.hits("You idiot, you idoit") == [(0, 0, False)]
    assert matcher.hits("you idyot") == [(0, 1, False)] and matcher.hits(None) == matcher.hits("") == []
    weights = {(0, 0): 7.0, (0, 1): 4.0}
    model = toxicity.ToxicityModel(matcher.automaton, weights, np.array([1.0, 0.2, 0.1, -3.0]))
    scores = [model.score(matcher.hits(t)) for t in ("You idiot.", "You idyot.", 'It read "idiot" there.', "none")]
    assert scores[0] > 0.9 > scores[1] > 0.5 > scores[2] > scores[3]


def test_toxicity_on_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    got = toxicity.score_toxicity(docs, labels).join(labels, "doc_id").where("held_out").collect()
    hit = sum(r.predicted for r in got if r.toxic) / sum(r.toxic for r in got)
    false = sum(r.predicted for r in got if not r.toxic) / sum(not r.toxic for r in got)
    assert hit > 0.8 and false < 0.01


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(1, None, "a"), (None, "x", "b"), (2, "", "c"), (2, "", "c"), (3, "y" * 100_000, "d")], "doc_id bigint, text string, score string")
    labels = spark.createDataFrame([(1, None, None), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    out = toxicity.score_toxicity(docs, labels).collect()
    assert len(out) == 5 and all(0 <= r.score < 0.5 and r.predicted == 0 for r in out)
    assert toxicity.score_toxicity(docs.limit(0), labels).collect() == []


# quality

def slow_base(text):
    lines, seen, dup = (text or "").split("\n"), set(), 0
    words = [w for w in re.split("[\x20\x09-\x0D]+", text or "") if w]
    for line in lines:
        if re.search("[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    count, covered = collections.Counter(grams), set()
    for i, g in enumerate(grams):
        if count[g] > 1:
            covered |= set(range(i, i + 5))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


@pytest.mark.parametrize("text", [
    None, "", "\n\n \t", "a b c d e", "a b c d e a b c d e", "x " * 40, "\x1ca \x85b\xa0c\nd\nd\n d\nd\r\n", "é # ü | <b>\n" * 7, "a b c d e f " * 3 + "g",
    " ".join(str(i % 4999) for i in range(12_000))])
def test_base_counts(text):
    base = line_quality.describe(text)[0]
    assert tuple(base[k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == slow_base(text)


def test_repeats_stay_exact_with_very_many_words():
    rng = random.Random(2)
    words = [f"w{rng.randrange(40_000)}" for _ in range(60_000)]
    words[100:110] = words[50_000:50_010]
    assert line_quality.repeated_words(words) == slow_base(" ".join(words))[4] >= 20


def test_quality_separates_labels_and_handles_edges(spark):
    docs, labels = tables(spark)
    got = line_quality.judge_quality(docs, labels).join(labels, "doc_id").where("not base_failed").collect()
    assert sum(r.kept for r in got if r.quality) / sum(r.quality for r in got) > 0.98
    assert sum(not r.kept for r in got if not r.quality) / sum(not r.quality for r in got) > 0.9
    odd = spark.createDataFrame([(1, None, 1), (2, "", 1), (None, "one two", 1), (3, "fine words here " * 5, 1)], "doc_id bigint, text string, kept int")
    out = {r.doc_id: r for r in line_quality.judge_quality(odd, labels.limit(0)).collect()}
    assert len(out) == 4 and not out[1].kept and out[1].base_failed and out[1].n_words == 0 and out[None].n_words == 2
    assert line_quality.judge_quality(odd.limit(0), labels).collect() == []


# toxicity: whole lexicon and misspellings

def labelled(spark, toxic, clean):
    texts = [(i, t) for i, t in enumerate([*toxic, *clean])]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    return docs, spark.createDataFrame([(i, int(i < len(toxic))) for i, _ in texts], "doc_id bigint, toxic int")


def toxic_scores(model, texts):
    matcher = toxicity.Matcher(model.automaton)
    return [model.score(matcher.hits(t)) for t in texts]


def test_rare_and_always_accompanied_terms_stay(spark):
    rng = random.Random(4)
    plain = [f"plain{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(300)]
    filler = lambda: " ".join(rng.choice(plain) for _ in range(20))
    toxic = [f"{filler()} {('vermin', 'maggot', 'lowlife')[i % 3]}" for i in range(300)]
    toxic += [f"{filler()} vermin maggot lowlife {'wretch' if i % 2 else ''} {'zqukbrt' if i < 20 else ''}" for i in range(100)]
    model = toxicity.fit_toxicity(*labelled(spark, toxic, [filler() for _ in range(1500)]))
    assert {"vermin", "maggot", "lowlife", "wretch", "zqukbrt"} <= set(model.automaton.words) | {s + "*" for s in model.automaton.stems}
    assert all(s > 0.5 for s in toxic_scores(model, ["a wretch", "a zqukbrt"])) and toxic_scores(model, [filler()])[0] < 0.5


def test_words_that_do_not_enter_the_automaton_match_nothing():
    rng = random.Random(8)
    words = {"".join(rng.choice("abc") for _ in range(rng.randrange(2, 13))): 0 for _ in range(60)}
    auto = toxicity.LexiconAutomaton({w: i for i, w in enumerate(words)}, {"cab": 900, "bbcab": 901, "acbbca": 902})
    tests = ["".join(rng.choice("abcd") for _ in range(rng.randrange(1, 15))) for _ in range(6000)]
    assert not [t for t in tests if auto.match(t) and not auto.may_match(t)]
    assert [t for t in tests if not auto.may_match(t)]


def test_misspelt_stems_inflections_and_short_terms(spark):
    rng = random.Random(4)
    plain = [f"plain{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(300)]
    filler = lambda: " ".join(rng.choice(plain) for _ in range(20))
    toxic = [f"{filler()} {w}" for w in ["idiot"] * 100 + ["idiots"] * 40 + ["scum"] * 96 + ["stupidest", "stupidly", "stupidity"] * 30]
    model = toxicity.fit_toxicity(*labelled(spark, toxic, [filler() for _ in range(1500)]))
    assert model.automaton.stems and {"idiot", "idiots", "scum"} <= set(model.automaton.words)
    marks = ["iddiot", "udiot", "idiotz", "scvm", "sctum", "stupjdness", "idiot", "scum"]
    assert all(s > 0.5 for s in toxic_scores(model, [f"{filler()} {m}" for m in marks])) and toxic_scores(model, [filler()])[0] < 0.5


def test_stems_with_an_error_agree_with_edit_distances():
    rng = random.Random(9)
    stems = ["abcab", "bbbb", "cabcabca"]
    auto = toxicity.LexiconAutomaton({"abcabc": 9}, {s: i for i, s in enumerate(stems)})
    for _ in range(4000):
        t = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 12)))
        want = {i: d for i, s in enumerate(stems) if (d := min(distance(t[:n], s) for n in range(len(t) + 1))) <= toxicity.stem_edits(s)}
        assert {k: v for k, v in auto.match(t) if k < 9} == want, t
        assert auto.may_match(t) or not auto.match(t)
