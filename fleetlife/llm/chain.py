"""Linear-chain conditional random fields over many sequences at once."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Packed:
    """Sequences of a flat array, longest first: where each starts, and how many are longer than a given length."""

    order: np.ndarray
    starts: np.ndarray
    alive: np.ndarray

    @staticmethod
    def of(lengths: np.ndarray) -> Packed:
        order = np.argsort(-lengths, kind="stable")
        size = lengths[order]
        starts = (np.cumsum(lengths) - lengths)[order]
        alive = len(size) - np.searchsorted(size[::-1], np.arange(1, int(size.max(initial=0)) + 1), side="left")
        return Packed(order, starts, alive)


def forward_backward(
    emission: np.ndarray, lengths: np.ndarray, trans: np.ndarray, first: np.ndarray, pairs: bool = False,
) -> tuple[np.ndarray, np.ndarray, float]:
    """(label probabilities of every position, expected transitions, log-likelihood normaliser) of all sequences.

    ``emission`` holds log scores of the positions of all sequences, one after another. Each step handles one position
    of every sequence that is long enough, so the work is the number of positions. The pair sums come only if asked.
    """
    n, labels = emission.shape
    pack = Packed.of(lengths)
    peak = emission.max(axis=1, keepdims=True) if n else emission
    scores = np.exp(emission - peak)
    step, enter = np.exp(trans), np.exp(first)
    alpha = np.empty((n, labels))
    norm = np.ones(n)
    for t, k in enumerate(pack.alive):
        at = pack.starts[:k] + t
        a = (enter if t == 0 else alpha[at - 1] @ step) * scores[at]
        c = a.sum(axis=1)
        norm[at] = c
        alpha[at] = a / c[:, None]
    gamma, moves = alpha, np.zeros((labels, labels))
    beta = np.ones((len(lengths), labels))
    for t in range(len(pack.alive) - 2, -1, -1):
        k = pack.alive[t + 1]  # sequences that go on after t
        at = pack.starts[:k] + t
        ahead = scores[at + 1] * beta[:k] / norm[at + 1][:, None]
        if pairs:
            moves += (alpha[at].T @ ahead) * step
        beta[:k] = ahead @ step.T
        gamma[at] = alpha[at] * beta[:k]
    total = float(np.log(norm).sum() + peak.sum())
    return gamma, moves, total


def viterbi(emission: np.ndarray, lengths: np.ndarray, trans: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The most likely label of every position; ties go to the smaller label."""
    n, labels = emission.shape
    pack = Packed.of(lengths)
    back = np.zeros((n, labels), np.int64)
    best = np.empty((len(lengths), labels))
    path = np.zeros(n, np.int64)
    last = np.zeros(len(lengths), np.int64)
    for t, k in enumerate(pack.alive):
        at = pack.starts[:k] + t
        if t == 0:
            best[:k] = first + emission[at]
        else:
            come = best[:k, :, None] + trans
            back[at] = come.argmax(axis=1)
            best[:k] = come.max(axis=1) + emission[at]
        ends = pack.alive[t + 1] if t + 1 < len(pack.alive) else 0
        last[ends:k] = best[ends:k].argmax(axis=1)
    for t in range(len(pack.alive) - 1, -1, -1):
        k = pack.alive[t]
        at = pack.starts[:k] + t
        path[at] = last[:k]
        last[:k] = back[at, last[:k]]
    return path


def fit(
    rows: np.ndarray, columns: np.ndarray, items: int, features: int, item_of: np.ndarray, gold: np.ndarray,
    lengths: np.ndarray, labels: int, values: np.ndarray | None = None, rounds: int = 60, rate: float = 0.3,
    ridge: float = 1e-4,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature weights, transitions, start scores) by Adam, with steps that shrink to zero, on the mean conditional
    log-likelihood.

    Item i has feature ``columns[j]`` with value ``values[j]`` (1) wherever ``rows[j] == i``; position p of the flat
    sequences is item ``item_of[p]`` and has label ``gold[p]``. ``rows`` must ascend.
    """
    n = len(gold)
    by_feature = np.argsort(columns, kind="stable")
    heads = np.flatnonzero(np.r_[True, np.diff(columns[by_feature]) > 0])
    used, item_heads = columns[by_feature][heads], np.flatnonzero(np.r_[True, np.diff(rows) > 0])
    owners = rows[item_heads]
    value = np.ones(len(rows)) if values is None else values
    starts = (np.cumsum(lengths) - lengths)[lengths > 0]
    inside = np.ones(n, bool)
    inside[starts] = False
    seen = np.zeros((labels, labels))
    np.add.at(seen, (gold[np.flatnonzero(inside) - 1], gold[inside]), 1)
    seen_first = np.bincount(gold[starts], minlength=labels)
    params = [np.zeros((features, labels)), np.zeros((labels, labels)), np.zeros(labels)]
    first_moment = [np.zeros_like(p) for p in params]
    second = [np.zeros_like(p) for p in params]
    by_item = np.argsort(item_of, kind="stable")
    place_heads = np.flatnonzero(np.r_[True, np.diff(item_of[by_item]) > 0])
    present = item_of[by_item][place_heads]
    for turn in range(1, rounds + 1):
        weight, trans, enter = params
        emission = np.zeros((items, labels))
        emission[owners] = np.add.reduceat(weight[columns] * value[:, None], item_heads, axis=0)
        gamma, moves, _ = forward_backward(emission[item_of], lengths, trans, enter, pairs=True)
        first_gamma = gamma[starts].sum(axis=0)
        gamma[np.arange(n), gold] -= 1
        pull = np.zeros((items, labels))
        pull[present] = np.add.reduceat(gamma[by_item], place_heads, axis=0)
        grad = np.zeros_like(weight)
        grad[used] = np.add.reduceat(pull[rows[by_feature]] * value[by_feature][:, None], heads, axis=0)
        grads = [grad / n + ridge * weight, (moves - seen) / n + ridge * trans, (first_gamma - seen_first) / n + ridge * enter]
        for p, g, m, v in zip(params, grads, first_moment, second, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= rate * (1 - (turn - 1) / rounds) * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.99**turn)) + 1e-8)
    return params[0], params[1], params[2]
