"""Belief propagation in lanes against plain loops, and what lanes spare."""

from __future__ import annotations

import itertools

import numpy as np
import pytest

from raretide.functions import gf2, relay
from raretide.functions.decoders import BpOsd, Lanes
from raretide.operators import decode


def _plainly(h, prior, syndrome, memories, rounds, scale, capped):
    """One shot's posteriors at the end of each leg and whether they meet its syndrome, message by message."""
    dtype = prior.dtype.type
    total, out = prior.copy(), []
    for memory, most in zip(memories, rounds, strict=True):
        message, met = {(c, v): total[v] for c, v in np.argwhere(h)}, False
        for _ in range(most):
            sent = {}
            for c in range(len(h)):
                for v in np.flatnonzero(h[c]):
                    others = [message[c, u] for u in np.flatnonzero(h[c]) if u != v]
                    size = min((abs(x) for x in others), default=dtype(50))
                    if capped and size > abs(message[c, v]):
                        size = min(size, dtype(50))
                    minus = (sum(x < 0 for x in others) + syndrome[c]) % 2
                    sent[c, v] = size * dtype(scale) * (-1 if minus else 1)
            total = (1 - memory) * prior + memory * total
            for v in range(h.shape[1]):
                heard = [sent[c, v] for c in np.flatnonzero(h[:, v])]
                if heard:
                    total[v] += heard[0] + sum(heard[2:], start=heard[1]) if len(heard) > 1 else heard[0]
            met = np.array_equal(h @ (total < 0) % 2, syndrome)
            if met:
                break
            message = {(c, v): total[v] - sent[c, v] for c, v in message}
        out.append((total.copy(), met))
    return out


@pytest.mark.parametrize(("dtype", "capped", "scale"), [(np.float32, True, 1.0), (np.float32, True, 0.625), (np.float64, False, 0.625)])
def test_lanes_are_plain_min_sum(dtype, capped, scale):
    """Legs, more shots than lanes, checks of one edge and of none, columns of none, and messages beyond the cap."""
    r = np.random.default_rng(7)
    h = (r.random((8, 15)) < 0.3).astype(np.uint8)
    h[2], h[5], h[:, 4] = 0, 0, 0
    h[5, 3] = 1
    priors = np.where(np.arange(15) % 3, 1e-12, 0.2)
    core = Lanes(h, priors, scale, dtype, capped, 4)
    syndromes = (r.random((23, 15)) < 0.2).astype(np.uint8) @ h.T % 2
    syndromes[1, 2] = 1
    memories = np.array([np.full(15, 0.1), r.uniform(-0.2, 0.6, 15), np.zeros(15)], dtype)
    rounds, seen = [6, 9, 4], {}

    def ended(shots, legs, totals, met):
        for i, s in enumerate(shots):
            seen[s, legs[i]] = totals[:, i].copy(), met[i]
        return legs < 2

    core.legs(syndromes, np.repeat(core.prior[None], 23, axis=0), memories, rounds, ended)
    assert len(seen) == 3 * 23 and any(np.abs(t).max() > 50 for t, _ in seen.values())
    for s in range(23):
        for leg, (total, met) in enumerate(_plainly(h, core.prior, syndromes[s], memories, rounds, scale, capped)):
            assert np.allclose(seen[s, leg][0], total, rtol=1e-4, atol=1e-3) and seen[s, leg][1] == met, (s, leg)


def test_a_lane_takes_the_next_shot_at_once(monkeypatch):
    """Every fourth shot meets nothing and takes all its rounds: its neighbours do not wait for it."""
    h = np.array([[1, 1, 0, 0], [0, 1, 1, 0], [0, 0, 0, 0]], np.uint8)
    syndromes = np.zeros((40, 3), np.uint8)
    syndromes[::4, 2] = 1
    core, steps, step = Lanes(h, np.full(4, 0.1), 1.0, np.float32, True, 4), [], Lanes._least_of_others
    monkeypatch.setattr(Lanes, "_least_of_others", lambda self, *a: (steps.append(1), step(self, *a))[1])
    _, met = core.run(syndromes, np.repeat(core.prior[None], 40, axis=0), None, 50)
    assert met.sum() == 30 and not met[::4].any()
    assert len(steps) <= 10 * 50 / 4 + 60  # in parts of four shots: 500


def test_relay_answers_do_not_depend_on_company():
    r = np.random.default_rng(3)
    h, observables = (r.random((10, 30)) < 0.3).astype(np.uint8), (r.random((2, 30)) < 0.3).astype(np.uint8)
    decoder = relay.named("relay", legs=5, stop=3, seed=1).setup(h, r.uniform(0.01, 0.2, 30), observables)
    events = (r.random((150, 30)) < 0.1).astype(np.uint8) @ h.T % 2
    together = decoder.corrections(events)
    assert all(np.array_equal(decoder.corrections(events[i : i + 1])[0], together[i]) for i in range(0, 150, 5))


def test_closing_answers_are_the_least_of_those_tried():
    """Ordered statistics over more rows than a word holds, rows that depend on others, unequal and equal priors."""
    r = np.random.default_rng(11)
    for rows, n, equal in ((5, 9, False), (6, 8, True), (40, 44, False)):
        h = (r.random((rows, n)) < 0.4).astype(np.uint8)
        h[-1] = h[0] ^ h[1]
        d = BpOsd(h, np.full(n, 0.02) if equal else r.uniform(0.01, 0.3, n), sweep=4, pairs=3)
        order = np.array([r.permutation(n) for _ in range(60)])
        syndromes = (r.random((60, n)) < 0.3).astype(np.uint8) @ h.T % 2
        syndromes[7, -1] ^= 1
        got = d.closed(order, syndromes)
        assert not got[7].any()
        for i in set(range(60)) - {7}:
            pivots = order[i][gf2.rref(h[:, order[i]])[1]]
            others = [c for c in order[i] if c not in set(pivots)][:4]
            best = np.inf
            for some in [(), *((c,) for c in others), *itertools.combinations(others[:3], 2)]:
                x = np.zeros(n, np.uint8)
                x[list(some)] = 1
                x[pivots] = gf2.solve(h[:, pivots], syndromes[i] ^ h @ x % 2)
                best = min(best, d.prior @ x)
            assert np.array_equal(h @ got[i] % 2, syndromes[i]) and abs(d.prior @ got[i] - best) < 1e-6


def test_blocks_draw_every_column_alike(spark, monkeypatch):
    """Shots of a block come from one generator, in parts of bounded size or at once; a smaller plan draws the first of them."""
    monkeypatch.setattr(np.random, "default_rng", lambda seed, made=np.random.default_rng: asked.append(seed) or made(seed))
    asked = []
    picked = np.concatenate(list(decode._drawn(5, 3, 2048, 2048, 8)))
    assert len(asked) == 1 and (np.sort(picked, 1)[:, 1:] > np.sort(picked, 1)[:, :-1]).all()
    assert np.array_equal(picked[:100], np.concatenate(list(decode._drawn(5, 3, 2048, 100, 8))))
    assert abs(np.bincount(picked.ravel(), minlength=8) - 768).max() < 5 * np.sqrt(2048 * 3 / 8 * 5 / 8)
    sets = np.unique(np.sort(picked, 1), axis=0, return_counts=True)[1]
    assert len(sets) == 56 and ((sets - 2048 / 56) ** 2).sum() / (2048 / 56) < 110
    wide = list(decode._drawn(5, 3, 0, 20, 1 << 20))
    assert len(wide) == 5 and all(p.shape == (4, 3) for p in wide)
    for rows in (np.eye(5, 70, dtype=np.uint8)[[0, 3, 0, 4]], np.eye(5, 9, dtype=np.uint8)[[2, 2, 1]]):
        once, of = decode._distinct(rows)
        assert len(once) == len({bytes(x) for x in rows}) and np.array_equal(once[of], rows)
