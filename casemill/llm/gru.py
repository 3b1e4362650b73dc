"""A gated recurrent language model in numpy: class-factored softmax, truncated backpropagation, documents in lanes.

Many documents run side by side, one a lane; a lane that ends one takes the next, and a window is so many steps of all
lanes. The state of a lane goes over from window to window and starts afresh with a document; only gradients end at a
window's border.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np

HIDDEN = 16
WORDS_OF_CLASS = 64
#: Lanes of a window, in training (64 for few words, more for many) and in scoring.
TRAIN_LANES, MOST_LANES, SCORE_LANES = 64, 512, 512
#: Steps of a window, in training and in scoring, and words of a block whose softmax is worked out at a time.
STEPS, SCORE_STEPS, BLOCK = 16, 64, 2048
RATE = 0.2
#: Longer documents are learnt from in parts of so many words, in several lanes.
TRAIN_WORDS = 512


class Lanes:
    """Windows over documents (tag, ids); ids begin with the first word, and `opening` stands before it."""

    def __init__(self, documents: Iterator[tuple[Any, np.ndarray]], lanes: int, opening: int, steps: int = STEPS) -> None:
        self.documents, self.opening, self.steps = documents, opening, steps
        self.held: list[tuple[Any, np.ndarray] | None] = [None] * lanes
        self.at = [0] * lanes
        self.open = True

    def _next(self, lane: int) -> bool:
        while self.open:
            self.held[lane], self.at[lane] = next(self.documents, None), 0
            self.open = self.held[lane] is not None
            if self.open and len(self.held[lane][1]):
                return True
        self.held[lane] = None
        return False

    def __iter__(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[Any], list[Any]]]:
        """given, wanted (-1 without a word), fresh (a document starts), owner: arrays (step, lane); the owners' tags, those that end.

        A lane whose documents have run out is left out of the windows that follow, with its column of the state; fresh
        tells which columns go on (last value).
        """
        n, steps = len(self.held), self.steps
        while True:
            # Lane by lane here, step by step outside.
            given, wanted = np.zeros((n, steps), np.int32), np.full((n, steps), -1, np.int32)
            fresh, owner = np.zeros((n, steps), bool), np.zeros((n, steps), np.int32)
            tags: list[Any] = []
            ended: list[Any] = []
            for lane in range(n):
                step = 0
                while step < steps and (self.held[lane] is not None or self._next(lane)):
                    tag, ids = self.held[lane]
                    at = self.at[lane]
                    k = min(steps - step, len(ids) - at)
                    wanted[lane, step : step + k] = ids[at : at + k]
                    given[lane, step] = ids[at - 1] if at else self.opening
                    given[lane, step + 1 : step + k] = ids[at : at + k - 1]
                    fresh[lane, step] = at == 0
                    owner[lane, step : step + k] = len(tags)
                    tags.append(tag)
                    step += k
                    self.at[lane] = at + k
                    if at + k == len(ids):
                        ended.append(tag)
                        self.held[lane] = None
            if not tags:
                return
            yield *(np.ascontiguousarray(x.T) for x in (given, wanted, fresh, owner)), tags, ended
            if not self.open:
                # Lanes without a document close up, so that the last long ones don't drag empty lanes along.
                kept = [i for i in range(n) if self.held[i] is not None]
                self.going = np.array(kept, np.int64)
                self.held, self.at, n = [self.held[i] for i in kept], [self.at[i] for i in kept], len(kept)
            else:
                self.going = None


def _sigmoid(x: np.ndarray) -> np.ndarray:
    out = np.exp(-x)
    out += 1
    return np.reciprocal(out, out=out)


def _exponents(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray | float]:
    """exp of x less the last value, and its sums by row: nothing is taken off as long as exp bears it."""
    with np.errstate(over="ignore"):
        off = np.exp(x)
        sums = off @ np.ones(x.shape[1], x.dtype)
    if 1e-30 < sums.min() and sums.max() < 1e30:
        return off, sums, 0.0
    most = x.max(axis=1)
    off = np.exp(x - most[:, None])
    return off, off.sum(axis=1), most


def _log_chosen(x: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """The log softmax of one value of each row."""
    _, sums, most = _exponents(x)
    return x[np.arange(len(x)), chosen] - np.log(sums) - most


class Gru:
    """n_words words, in classes of WORDS_OF_CLASS by their order, and n_single classes of one id each after them."""

    def __init__(self, words: np.ndarray, singles: np.ndarray, opening: int, hidden: int = HIDDEN) -> None:
        """Start from how often words and single classes are seen (weights above 0), whatever came before."""
        draw = np.random.default_rng(20)
        self.n_words, self.n_single, self.opening, self.hidden = len(words), len(singles), opening, hidden
        self.n_word_classes = -(-len(words) // WORDS_OF_CLASS)
        padded = np.zeros(self.n_word_classes * WORDS_OF_CLASS)
        padded[: len(words)] = words
        blocks = padded.reshape(self.n_word_classes, WORDS_OF_CLASS)
        by_class = np.concatenate([blocks.sum(axis=1), singles])
        self.p = {
            "emb": draw.normal(0, 0.3, (len(words) + len(singles), hidden)),
            "wx": draw.normal(0, 0.5 / hidden**0.5, (hidden, 3 * hidden)),
            "wh": draw.normal(0, 0.5 / hidden**0.5, (hidden, 3 * hidden)),
            "bias": np.zeros(3 * hidden),
            "cw": np.zeros((hidden, len(by_class))),
            "cb": np.log(by_class),
            "ww": np.zeros((self.n_word_classes, hidden, WORDS_OF_CLASS)),
            # Places that hold no word are never drawn.
            "wb": np.where(blocks > 0, np.log(np.maximum(blocks, 1e-30)), -1e9),
        }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        self.seen = {k: np.full(v.shape, 1e-3, np.float32) for k, v in self.p.items()}

    def weights(self) -> np.ndarray:
        """Parameters and the squares of gradients seen, as one vector."""
        return np.concatenate([x[k].ravel() for x in (self.p, self.seen) for k in self.p])

    def load(self, vector: np.ndarray) -> None:
        at = 0
        for x in (self.p, self.seen):
            for k, v in x.items():
                x[k] = vector[at : at + v.size].reshape(v.shape).astype(np.float32)
                at += v.size

    def _classes(self, wanted: np.ndarray) -> np.ndarray:
        return np.where(wanted < self.n_words, wanted // WORDS_OF_CLASS, wanted - self.n_words + self.n_word_classes)

    def _run(self, projected: np.ndarray, given: np.ndarray, fresh: np.ndarray, state: np.ndarray, trace: list | None) -> tuple[np.ndarray, np.ndarray]:
        """The states after each step (step, lane, hidden), and the last."""
        h, wh = self.hidden, self.p["wh"]
        states = np.empty((*given.shape, h), np.float32)
        starts = fresh.any(axis=1)
        for t in range(len(given)):
            if starts[t]:
                state = np.where(fresh[t][:, None], np.float32(0), state)
            a, u = projected[given[t]], state @ wh
            gates = _sigmoid(a[:, : 2 * h] + u[:, : 2 * h])
            z, r = gates[:, :h], gates[:, h:]
            new = r * u[:, 2 * h :]
            new += a[:, 2 * h :]
            np.tanh(new, out=new)
            if trace is not None:
                trace.append((state, z, r, new, u[:, 2 * h :]))
            state = new + z * (state - new)
            states[t] = state
        return states, state

    def _by_class(self, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places of words, class by class, and where each class begins; the last are no words of the softmax."""
        small = np.minimum(classes, self.n_word_classes).astype(np.uint16)
        order = np.argsort(small, kind="stable")
        return order, np.searchsorted(small[order], np.arange(self.n_word_classes + 1))

    def log_probabilities(self, states: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Natural log probability of each wanted id after a state."""
        p, classes = self.p, self._classes(wanted)
        found = np.concatenate([_log_chosen(states[i : i + BLOCK] @ p["cw"] + p["cb"], classes[i : i + BLOCK]) for i in range(0, len(wanted), BLOCK)])
        order, ends = self._by_class(classes)
        order = order[: ends[-1]]
        own, words, inner = states[order], wanted[order] % WORDS_OF_CLASS, np.zeros(len(order), found.dtype)
        for c in range(self.n_word_classes):
            for i in range(ends[c], ends[c + 1], BLOCK):
                j = min(i + BLOCK, ends[c + 1])
                inner[i:j] = _log_chosen(own[i:j] @ p["ww"][c] + p["wb"][c], words[i:j])
        found[order] += inner
        return found

    def scores(self, documents: Iterator[tuple[Any, np.ndarray]], lanes: int = SCORE_LANES) -> Iterator[tuple[Any, float]]:
        """(tag, natural log probability) of each document, as they end; empty ones have none."""
        projected = self.p["emb"] @ self.p["wx"] + self.p["bias"]
        state, sums, windows = np.zeros((lanes, self.hidden), np.float32), {}, Lanes(documents, lanes, self.opening, SCORE_STEPS)
        for given, wanted, fresh, owner, tags, ended in windows:
            if state.shape[0] != given.shape[1]:
                state = state[windows.going]
            states, state = self._run(projected, given, fresh, state, None)
            held = wanted >= 0
            found = self.log_probabilities(states[held], wanted[held])
            for tag, x in zip(tags, np.bincount(owner[held], found, len(tags)).tolist(), strict=True):
                sums[tag] = sums.get(tag, 0.0) + x
            for tag in ended:
                yield tag, sums.pop(tag)

    def train(self, documents: Iterator[tuple[Any, np.ndarray]], lanes: int = TRAIN_LANES) -> int:
        """One pass of truncated backpropagation over the documents; the number of their words."""
        parts = ((tag, ids[i : i + TRAIN_WORDS]) for tag, ids in documents for i in range(0, len(ids), TRAIN_WORDS))
        state, n, windows = np.zeros((lanes, self.hidden), np.float32), 0, Lanes(parts, lanes, self.opening)
        for given, wanted, fresh, _, _, _ in windows:
            if state.shape[0] != given.shape[1]:
                state = state[windows.going]
            trace: list = []
            states, state = self._run(self.p["emb"] @ self.p["wx"] + self.p["bias"], given, fresh, state, trace)
            held = wanted >= 0
            back = np.zeros_like(states)
            back[held] = self._learn_output(states[held], wanted[held])
            self._learn_gates(given, fresh, trace, back)
            n += int(held.sum())
        return n

    def _update(self, name: str, gradient: np.ndarray, rows: Any = slice(None)) -> None:
        """A step against a gradient, scaled by the squares of those seen."""
        self.seen[name][rows] += gradient * gradient
        self.p[name][rows] -= RATE * gradient / np.sqrt(self.seen[name][rows])

    def _learn_output(self, states: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Update the softmax; the loss's gradient by state.

        The loss is divided by the words of TRAIN_LANES, so that the few lanes of the last long documents weigh no more.
        """
        p, classes, scale = self.p, self._classes(wanted), np.float32(1 / (TRAIN_LANES * STEPS))

        def off(x: np.ndarray, chosen: np.ndarray) -> np.ndarray:
            found, sums, _ = _exponents(x)
            found *= (scale / sums)[:, None]
            found[np.arange(len(x)), chosen] -= scale
            return found

        order, ends = self._by_class(classes)
        states, classes = states[order], classes[order]
        whole = off(states @ p["cw"] + p["cb"], classes)
        sorted_back = whole @ p["cw"].T
        words, d_ww, d_wb = wanted[order] % WORDS_OF_CLASS, np.zeros_like(p["ww"]), np.zeros_like(p["wb"])
        for c in range(self.n_word_classes):
            i, j = ends[c], ends[c + 1]
            if i < j:
                x = states[i:j]
                own = off(x @ p["ww"][c] + p["wb"][c], words[i:j])
                sorted_back[i:j] += own @ p["ww"][c].T
                np.matmul(x.T, own, out=d_ww[c])
                np.add.reduce(own, axis=0, out=d_wb[c])
        self._update("cw", states.T @ whole)
        self._update("cb", whole.sum(axis=0))
        self._update("ww", d_ww)
        self._update("wb", d_wb)
        back = np.empty_like(sorted_back)
        back[order] = sorted_back
        return back

    def _learn_gates(self, given: np.ndarray, fresh: np.ndarray, trace: list, back: np.ndarray) -> None:
        """Update embeddings and gates by the states' gradients, the last step first."""
        h, wh, carried = self.hidden, self.p["wh"], np.zeros_like(back[0])
        gate = np.empty((*given.shape, 3 * h), np.float32)
        by_state = np.empty((*given.shape, 3 * h), np.float32)
        for t in range(len(given) - 1, -1, -1):
            state, z, r, new, u = trace[t]
            d = back[t] + carried
            d_new = d * (1 - z) * (1 - new * new)
            d_z = d * (state - new) * z * (1 - z)
            d_r = d_new * u * r * (1 - r)
            own, d_u = gate[t], by_state[t]
            own[:, :h], own[:, h : 2 * h], own[:, 2 * h :] = d_z, d_r, d_new
            d_u[:, : 2 * h] = own[:, : 2 * h]
            np.multiply(d_new, r, out=d_u[:, 2 * h :])
            carried = d * z
            carried += d_u @ wh.T
            carried[fresh[t]] = 0
        d_wh = np.concatenate([x[0] for x in trace]).T @ by_state.reshape(-1, 3 * h)
        # Gradients of equal ids add up.
        flat = given.ravel()
        order = np.argsort(flat.astype(np.uint16) if self.n_words + self.n_single < 1 << 16 else flat, kind="stable")
        firsts = np.flatnonzero(np.diff(flat[order], prepend=-1))
        ids = flat[order[firsts]]
        by_id = np.add.reduceat(gate.reshape(-1, 3 * h)[order], firsts)
        d_emb, d_wx = by_id @ self.p["wx"].T, self.p["emb"][ids].T @ by_id
        self._update("emb", d_emb, ids)
        self._update("wx", d_wx)
        self._update("wh", d_wh)
        self._update("bias", by_id.sum(axis=0))
