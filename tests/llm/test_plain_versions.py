"""Rules that no library has, against versions written out plainly: the
packing choice, follow-the-regularised-leader and the temperature."""

import math
import random

import numpy as np

from quire.llm import language, packing


def packed_plainly(lengths, capacity):
    """Every place tried, the sum of squares counted anew."""
    gaps, where = [], [None] * len(lengths)   # of all bins, full ones too
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        def total(after):
            counts = {}
            for g in after:
                if 0 < g < capacity:
                    counts[g] = counts.get(g, 0) + 1
            return sum(c * c for c in counts.values())
        fits = [(total(gaps[:b] + [g - lengths[i]] + gaps[b + 1:]), g, b) for b, g in enumerate(gaps) if g >= lengths[i]]
        if fits:
            _, g, b = min(fits)
        else:
            gaps.append(capacity)
            g, b = capacity, len(gaps) - 1
        where[i] = capacity - g
        gaps[b] -= lengths[i]
    return where, sorted(gaps)


def test_packing_choice_equals_the_rule_written_out():
    rng = random.Random(12)
    for capacity in (7, 20, 50):
        for _ in range(20):
            lengths = [rng.randrange(1, capacity + 1) for _ in range(rng.randrange(1, 60))]
            bins, offsets, made = packing.sum_of_squares_pack(np.array(lengths), capacity)
            where, gaps = packed_plainly(lengths, capacity)
            filled = [capacity] * made
            for b, n in zip(bins, lengths):
                filled[b] -= n
            assert offsets.tolist() == where and sorted(filled) == gaps
            for b in range(made):       # gapless, no overlap
                own = sorted((o, n) for o, n, x in zip(offsets.tolist(), lengths, bins) if x == b)
                assert [o for o, _ in own] == np.cumsum([0] + [n for _, n in own])[:-1].tolist()


def ftrl_plainly(rows, labels, classes, alpha=0.5, beta=1.0, l1=0.02, l2=0.5, epochs=4, seed=7):
    """One coordinate at a time, from the update rules."""
    z, n = {}, {}

    def weight(j, c):
        zj = z.get((j, c), 0.0)
        if abs(zj) <= l1:
            return 0.0
        return -(zj - math.copysign(l1, zj)) / ((beta + math.sqrt(n.get((j, c), 0.0))) / alpha + l2)

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            x = dict(zip(rows[i][0].tolist(), rows[i][1].tolist())) | {language.BINS: 1.0}
            score = [sum(v * weight(j, c) for j, v in x.items()) for c in range(classes)]
            top = max(score)
            e = [math.exp(s - top) for s in score]
            now = {(j, c): weight(j, c) for j in x for c in range(classes)}
            for c in range(classes):
                slope = e[c] / sum(e) - (c == labels[i])
                for j, v in x.items():
                    g, old = v * slope, n.get((j, c), 0.0)
                    z[j, c] = z.get((j, c), 0.0) + g - (math.sqrt(old + g * g) - math.sqrt(old)) / alpha * now[j, c]
                    n[j, c] = old + g * g
    return weight


def test_ftrl_equals_the_updates_written_out():
    rng = np.random.default_rng(8)
    rows, labels = [], rng.integers(0, 3, 40)
    for y in labels:
        at = np.sort(rng.choice(30, 6, replace=False)) + 10 * y
        x = rng.random(6)
        rows.append((at, x / np.linalg.norm(x)))
    weights, bias = language.fit_ftrl(rows, labels, 3)
    plain = ftrl_plainly(rows, labels, 3)
    assert max(abs(weights[j, c] - plain(j, c)) for j in range(60) for c in range(3)) < 1e-12
    assert max(abs(bias[c] - plain(language.BINS, c)) for c in range(3)) < 1e-12
    assert (weights == 0).sum() > weights.size * 0.9      # never touched, or within l1


def test_temperature_is_the_best_of_a_grid():
    rng = np.random.default_rng(2)
    labels = rng.integers(0, 4, 300)
    logits = rng.standard_normal((300, 4)) * 3 + 4 * np.eye(4)[labels] * (rng.random(300) < 0.7)[:, None]

    def loss(t):
        p = np.exp(logits / t - (logits / t).max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        return -np.log(p[np.arange(300), labels]).mean()
    best = language.fit_temperature(logits, labels)
    assert loss(best) <= min(loss(t) for t in np.exp(np.linspace(-3, 3, 2001))) + 1e-9
    assert language.fit_temperature(logits[:0], labels[:0]) == 1.0
