"""Decoders over whole batches of syndromes, behind one interface and a registry.

A decoder is set up once, from the detector matrix, the mechanisms' priors and the observable matrix, and then turns
rows of detection events into corrections or observable flips. Priors may come from another circuit than the shots
(frozen calibration): set it up on that one.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np

from raretide.functions.decoders import BpOsd, Lanes


class MinSum(Lanes):
    """Lanes of single precision. Only a check's least edge hears the second least of them, and no more than 50."""

    def __init__(self, h: np.ndarray, priors: np.ndarray, scale: float = 1.0):
        super().__init__(h, priors, scale, np.float32, True, 64)

    def satisfied(self, guess: np.ndarray, syndromes: np.ndarray) -> np.ndarray:
        return ((guess.astype(np.float32) @ self.h.T.astype(np.float32)) % 2 == syndromes).all(1)


@dataclass
class Decoder:
    """The interface; a subclass gives ``corrections`` for rows of detection events."""

    h: np.ndarray = field(default=None, repr=False)
    observables: np.ndarray = field(default=None, repr=False)

    def setup(self, h: np.ndarray, priors: np.ndarray, observables: np.ndarray) -> Decoder:
        """h: detectors x mechanisms; observables: observables x mechanisms."""
        self.h, self.observables = np.asarray(h, np.uint8), np.asarray(observables, np.uint8)
        self.priors = np.clip(np.asarray(priors, float), 1e-12, 0.5 - 1e-9)
        return self

    def corrections(self, events: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def decode(self, events: np.ndarray) -> np.ndarray:
        """shots x observables; equal rows of events are decoded once."""
        if self.h is None:
            raise RuntimeError("set the decoder up before decoding")
        if not len(events):
            return np.zeros((0, len(self.observables)), np.uint8)
        once, of = np.unique(np.asarray(events, np.uint8), axis=0, return_inverse=True)
        flips = self.observables.T.astype(np.float32)
        parts = (self.corrections(once[i : i + 1024]) for i in range(0, len(once), 1024))  # bounds the arrays of columns
        answers = np.concatenate([x.astype(np.float32) @ flips % 2 for x in parts])
        return answers[of.reshape(-1)].astype(np.uint8)


@dataclass
class Trivial(Decoder):
    """Never corrects: the baseline."""

    def corrections(self, events: np.ndarray) -> np.ndarray:
        return np.zeros((len(events), self.h.shape[1]), np.uint8)


@dataclass
class Relay(Decoder):
    """Relay belief propagation: a leg with one memory strength, then legs with strengths drawn column by column.

    Each leg begins at the posteriors of the one before. A shot leaves the relay once ``stop`` legs have met its
    syndrome; the likeliest of its answers wins. Shots that no leg solves keep the last leg's guess.
    """

    gamma0: float = 0.1
    first_rounds: int = 20
    legs: int = 20
    rounds: int = 20
    gammas: tuple[float, float] = (-0.24, 0.66)
    stop: int = 5
    seed: int = 0

    def corrections(self, events: np.ndarray) -> np.ndarray:
        core, draw = MinSum(self.h, self.priors), np.random.RandomState(self.seed)
        n, width = len(events), self.h.shape[1]
        weight = core.prior.astype(float)[:, None]
        memories = np.array([np.full(width, self.gamma0), *(draw.uniform(*self.gammas, width) for _ in range(self.legs))], np.float32)
        best, cost, found = np.zeros((n, width), np.uint8), np.full(n, np.inf), np.zeros(n, int)

        def ended(shots: np.ndarray, legs: np.ndarray, totals: np.ndarray, met: np.ndarray) -> np.ndarray:
            guess = totals < 0
            price = np.where(met, (guess * weight).sum(0), np.inf)
            better = (price < cost[shots]) | (~np.isfinite(cost[shots]) & ~met)
            best[shots[better]] = guess.T[better]
            cost[shots] = np.minimum(cost[shots], price)
            found[shots] += met
            return (found[shots] < self.stop) & (legs < self.legs)

        core.legs(events, np.repeat(core.prior[None], n, axis=0), memories, [self.first_rounds] + [self.rounds] * self.legs, ended)
        return best


@dataclass
class Osd(Decoder):
    """Min-sum over the batch; shots that it leaves unsolved are closed by ordered statistics."""

    rounds: int = 30
    scale: float = 0.625
    sweep: int = 200
    pairs: int = 10

    def corrections(self, events: np.ndarray) -> np.ndarray:
        core = MinSum(self.h, self.priors, self.scale)
        total, met = core.run(events, np.repeat(core.prior[None], len(events), axis=0), np.zeros(self.h.shape[1], np.float32), self.rounds)
        out = (total < 0).astype(np.uint8)
        if not met.all():
            closing, left = BpOsd(self.h, self.priors, sweep=self.sweep, pairs=self.pairs), np.flatnonzero(~met)
            for i in range(0, len(left), 256):
                some = left[i : i + 256]
                out[some] = closing.closed(np.argsort(total[some], axis=1, kind="stable"), np.asarray(events[some], np.uint8))
        return out


#: Name -> a decoder with the given settings.
REGISTRY: dict[str, Callable[..., Decoder]] = {"relay": Relay, "bposd": Osd, "trivial": Trivial}


def named(name: str, **settings) -> Decoder:
    """A decoder by its name; unknown names and settings are refused."""
    if name not in REGISTRY:
        raise ValueError(f"unknown decoder {name!r}; known: {sorted(REGISTRY)}")
    return REGISTRY[name](**settings)
