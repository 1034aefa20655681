"""Secrets by fixed patterns and by a character convolutional network.

Base findings are those of three fixed patterns. Beside them every run of `LEAST`
or more secret-like characters is a candidate; of a run that base findings touch,
each part outside them that is as long. A small network in numpy judges it with its
context: character embeddings with the position's role (before, inside, after),
one convolution, its largest and mean response, a logistic output. A candidate of
more than `INSIDE` characters is read in windows of that many, `STRIDE` apart, so
that every character is seen; its largest probability counts. A candidate whose
calibrated probability reaches the threshold is a further finding of kind ``cnn``.

Labelled findings: all candidates of all texts are labelled 1 where they are a base
finding's secret, 0 outside base findings; labelled runs also appear with their
bodies redrawn from other alphabets, in another run's context and inside
long paths, and candidates that no secret looks like (numbers, dates, repeated
characters, words in small, capital and mixed letters, words joined by marks) are
labelled 0. A fifth of them, by their characters and context, is held back.

Training: the table is dealt by hash into parts of about `PART` rows. Starting from
one network (fitted to constructed candidates alone) a copy passes through every
part in the hashes' order, judges all windows and steps (Adam) down the loss of those
that are not right by `MARGIN`, both labels weighing the same; parts of under `STEPS`
steps are passed again until then. The mean of the copies is the network. So it
depends on the rows, not on how Spark deals them. The held-back fifth of all
candidates, counted by the network's output in steps of 1 / `FINE`, calibrates the
output (Platt's scaling) and sets the threshold: the highest that keeps recall at
`RECALL` or more there. Scans cover every character of every candidate of every
whole text.

Defined cases: null text counts as empty and has no finding; repeated rows are
reported once each and count as often in training; offsets count code points;
without labelled findings (an empty table, or no base finding) the constructed ones
alone teach the network what a secret is.
"""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .common import small_batches

# Fixed patterns; the part in parentheses that must be long, and how long.
ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "cnn")
CUES = ("passw", "secret", "token", "api")
LEAST = 8
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_.=-]{{{LEAST},}}")

RECALL = 0.95
# Rows that one copy of the network learns from; its least number of steps; windows and drawn secrets in a step.
PART, STEPS, STEP, DRAWN = 8192, 400, 512, 16
# Log odds beyond which a window judged rightly gives no gradient; learning rate of the copies.
MARGIN, RATE = 4.0, 0.01
# A fifth of the candidates is held back. Labelled secrets and contexts that a copy remembers for redrawing.
FIFTH, REMEMBERED = 5, 1024
# Outputs count in steps of 1 / FINE up to LARGEST.
FINE, LARGEST = 256, 100.0
# Parameters are averaged as whole multiples of 1 / FIXED, whose sums do not depend on the order.
FIXED = 1 << 32
# Characters before, at the beginning, at the end and after a candidate that the network sees.
BEFORE, HEAD, TAIL, AFTER = 20, 20, 8, 4
WIDTH = BEFORE + HEAD + TAIL + AFTER
# Characters of a candidate that one window sees, and the distance of a longer candidate's windows: each run of
# INSIDE - STRIDE characters is whole in one of them.
INSIDE, STRIDE = HEAD + TAIL, 8
# Printable ASCII, other characters, and none.
SYMBOLS, EMBED, FILTERS, SPAN = 97, 8, 20, 5
BLOCK, TOGETHER = 256, 8192

Span = tuple[int, str, int]


def base_spans(text: str, runs: list[tuple[int, int]] | None = None) -> list[Span]:
    """(start, kind, end) of the fixed patterns' findings, each kind leftmost and not overlapping.

    `runs`: the text's candidates; long runs of hexadecimal digits lie in one of these.
    """
    out, low = [], text.lower()
    runs = candidates(text) if runs is None else runs
    if any(c in low for c in CUES):
        out += [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), "hex", m.end()) for a, b in runs if b - a >= 32 for m in HEX.finditer(text, a, b)]
    return out and sorted(out, key=lambda s: (s[0], KINDS.index(s[1])))


def candidates(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in CANDIDATE.finditer(text)]


def outside(a: int, b: int, found: list[Span]) -> list[tuple[int, int]]:
    """Parts of a candidate that no finding (by start) covers and that are long enough."""
    out = []
    for start, _, end in found:
        if start >= b:
            break
        if end > a:
            out.append((a, start))
            a = end
    return [(x, y) for x, y in [*out, (a, b)] if y - x >= LEAST]


def secrets(text: str) -> list[Span]:
    """The base findings without an assignment's name and mark."""
    return [(ASSIGN.match(text, a).start(2) if k == "assign" else a, k, b) for a, k, b in base_spans(text)]


def pieces(start: int, end: int) -> list[tuple[int, int]]:
    """What of a candidate each window sees."""
    if end - start <= INSIDE:
        return [(start, end)]
    return [(a, a + INSIDE) for a in [*range(start, end - INSIDE, STRIDE), end - INSIDE]]


def window(text: str, start: int, end: int) -> str:
    """The characters that the network sees, padded with zero characters."""
    before = text[max(0, start - BEFORE):start].rjust(BEFORE, "\0")
    head = text[start:min(end, start + HEAD)].ljust(HEAD, "\0")
    tail = text[max(start + HEAD, end - TAIL):end].ljust(TAIL, "\0")
    return before + head + tail + text[end:end + AFTER].ljust(AFTER, "\0")


def _codes(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode("utf-32-le"), "<u4")
    return np.where(raw == 0, 96, np.where((raw >= 32) & (raw < 127), raw - 32, 95)).astype(np.int64)


def symbols(windows: list[str]) -> np.ndarray:
    return _codes("".join(windows)).reshape(len(windows), WIDTH)


GAP = "\0" * WIDTH


def gathered(codes: np.ndarray, spots: np.ndarray) -> np.ndarray:
    """symbols() of the windows of pieces (start, end), all at once; each text in `codes` stands between two GAPs."""
    start, end = spots[:, :1], spots[:, 1:]
    at = start + np.arange(-BEFORE, INSIDE)
    return np.concatenate((np.where(at < end, codes.take(at), 96), codes.take(end + np.arange(AFTER))), 1)


LEARNED = ("embed", "role", "filters", "bias", "weight", "offset")


@dataclass
class Network:
    embed: np.ndarray
    role: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    weight: np.ndarray
    offset: float
    scale: float = 1.0
    shift: float = 0.0
    threshold: float = 0.5

    @classmethod
    def new(cls, seed: int) -> Network:
        r = np.random.default_rng(seed)
        f = np.float32
        return cls(r.normal(0, .5, (SYMBOLS, EMBED)).astype(f), r.normal(0, .5, (4, EMBED)).astype(f),
                   r.normal(0, (SPAN * EMBED) ** -.5, (SPAN * EMBED, FILTERS)).astype(f), np.zeros(FILTERS, f),
                   r.normal(0, .3, 2 * FILTERS).astype(f), 0.0)

    _roles = np.repeat(np.arange(4), (BEFORE, HEAD, TAIL, AFTER))

    def forward(self, x: np.ndarray):
        e = self.embed[x] + self.role[self._roles]
        cols = np.lib.stride_tricks.sliding_window_view(e, SPAN, axis=1).transpose(0, 1, 3, 2).reshape(len(x), -1, SPAN * EMBED)
        h = np.maximum(cols @ self.filters + self.bias, 0)
        top = h.argmax(1)
        pooled = np.concatenate((np.take_along_axis(h, top[:, None], 1)[:, 0], h.mean(1)), 1)
        return pooled @ self.weight + self.offset, (cols, h, top, pooled)

    def logits(self, x: np.ndarray) -> np.ndarray:
        """Outputs as of forward(): the responses to symbols and pairs of symbols are looked up, not multiplied."""
        by = self.filters.reshape(SPAN, EMBED, FILTERS)
        one = [self.embed @ f for f in by]
        two = [(one[k][:, None] + one[k + 1]).reshape(-1, FILTERS) for k in (0, 2)]
        n = WIDTH - SPAN + 1
        always = self.bias + sum(self.role[self._roles[k:k + n]] @ by[k] for k in range(SPAN))
        out = np.zeros(len(x))
        for i in range(0, len(x), BLOCK):
            some = np.ascontiguousarray(x[i:i + BLOCK].T)  # positions first, so that sums and maxima run over whole rows
            pairs = some[:-1] * SYMBOLS + some[1:]
            h = two[0].take(pairs[:n], 0, mode="clip")
            h += two[1].take(pairs[2:n + 2], 0, mode="clip")
            h += one[4].take(some[4:], 0, mode="clip")
            h += always[:, None]
            np.maximum(h, 0, out=h)
            out[i:i + BLOCK] = np.concatenate((h.max(0), h.mean(0)), 1) @ self.weight + self.offset
        return out

    def fine(self, x: np.ndarray) -> np.ndarray:
        """Outputs as whole numbers of steps."""
        return np.rint(np.clip(self.logits(x), -LARGEST, LARGEST) * FINE).astype(np.int64)

    def calibrated(self, z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * z + self.shift, -40, 40)))

    def probability(self, x: np.ndarray) -> np.ndarray:
        return self.calibrated(self.fine(x) / FINE)

    def flat(self) -> np.ndarray:
        return np.concatenate([np.ravel(getattr(self, name)) for name in LEARNED]).astype(np.float64)

    def with_flat(self, values: np.ndarray) -> Network:
        """A network of these parameters, not calibrated."""
        out, at = {}, 0
        for name in LEARNED[:-1]:
            old = getattr(self, name)
            out[name] = values[at:at + old.size].reshape(old.shape).astype(np.float32)
            at += old.size
        return Network(**out, offset=float(values[at]))

    def gradients(self, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> list[np.ndarray]:
        z, (cols, h, top, pooled) = self.forward(x)
        d = ((1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) * w / len(x)).astype(np.float32)
        dp = d[:, None] * self.weight
        dh = np.repeat(dp[:, None, FILTERS:] / h.shape[1], h.shape[1], 1)
        np.put_along_axis(dh, top[:, None], np.take_along_axis(dh, top[:, None], 1) + dp[:, None, :FILTERS], 1)
        dh *= h > 0
        dc = (dh @ self.filters.T).reshape(len(x), -1, SPAN, EMBED)
        de = np.zeros((len(x), WIDTH, EMBED), np.float32)
        for k in range(SPAN):
            de[:, k:k + dc.shape[1]] += dc[:, :, k]
        embed, role = np.zeros_like(self.embed), np.zeros_like(self.role)
        np.add.at(embed, x, de)
        np.add.at(role, self._roles, de.sum(0))
        return [embed, role, cols.reshape(-1, SPAN * EMBED).T @ dh.reshape(-1, FILTERS), dh.sum((0, 1)), pooled.T @ d, np.array(d.sum())]


class Adam:
    def __init__(self, net: Network, rate: float):
        self.net, self.rate = net, rate
        self.m, self.v, self.t = [0.0] * 6, [0.0] * 6, 0

    def step(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
        net, m, v = self.net, self.m, self.v
        self.t += 1
        for k, (name, g) in enumerate(zip(LEARNED, net.gradients(x, y, weight), strict=True)):
            m[k], v[k] = .9 * m[k] + .1 * g, .999 * v[k] + .001 * g * g
            step = self.rate * (m[k] / (1 - .9 ** self.t)) / (np.sqrt(v[k] / (1 - .999 ** self.t)) + 1e-8)
            setattr(net, name, (getattr(net, name) - step).astype(np.float32) if k < 5 else float(net.offset - step))


def train(x: np.ndarray, y: np.ndarray, seed: int = 7, epochs: int = 6, rate: float = 0.01, of: np.ndarray | None = None) -> Network:
    """Fit (Adam), calibrate and set the threshold; a fifth of the candidates is held back for the last two.

    `of`: the number of each window's candidate, each window its own without it.
    """
    of = np.arange(len(x)) if of is None else of
    order = np.random.default_rng(seed).permutation(int(of.max()) + 1 if len(of) else 0)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    order, ahead = np.argsort(place[of], kind="stable"), int((place[of] < len(order) // 5).sum())
    held, used = order[:ahead], order[ahead:]
    net, rng = Network.new(seed), np.random.default_rng(seed + 1)
    adam = Adam(net, rate)
    share = max(1e-3, min(0.999, float(y[used].mean()))) if len(used) else 0.5
    for _ in range(epochs):
        for at in np.array_split(rng.permutation(used), max(1, len(used) // 64)):
            if not len(at):
                continue
            adam.step(x[at], y[at], np.where(y[at] == 1, .5 / share, .5 / (1 - share)))
    z, target = net.logits(x[held]), y[held]
    if len(held):  # a candidate's largest output counts
        first = np.flatnonzero(np.diff(of[held], prepend=-1))
        z, target = np.maximum.reduceat(z, first), target[first]
    return calibrate(net, z, target, np.ones(len(z)))


def calibrate(net: Network, z: np.ndarray, target: np.ndarray, n: np.ndarray) -> Network:
    """Set scale, shift and threshold by outputs `z` of label `target`, `n` candidates each; unchanged without both labels."""
    good, all_ = n[target == 1].sum(), n.sum()
    if 0 < good < all_:
        smooth = np.where(target == 1, (good + 1) / (good + 2), 1 / (all_ - good + 2))
        at = np.array([1.0, 0.0])

        def loss(v):
            u = v[0] * z + v[1]
            return (n * (np.logaddexp(0, u) - smooth * u)).sum() + 5e-4 * v[0] ** 2

        for _ in range(50):  # Newton's method with a ridge, no step that makes it worse
            p = 1 / (1 + np.exp(-np.clip(at[0] * z + at[1], -40, 40)))
            q = n * (p * (1 - p) + 1e-9)
            g = np.array([(n * (p - smooth) * z).sum() + 1e-3 * at[0], (n * (p - smooth)).sum()])
            h = np.array([[(q * z * z).sum() + 1e-3, (q * z).sum()], [(q * z).sum(), q.sum()]])
            step = np.linalg.solve(h + 1e-9 * np.eye(2), g)
            while np.abs(step).max() > 1e-9 and not loss(at - step) <= loss(at):
                step = step / 2
            if np.abs(step).max() <= 1e-9:
                break
            at = at - step
        a, b = at
        net.scale, net.shift = float(max(a, 1e-3)), float(b)
        order = np.flatnonzero(target == 1)[np.argsort(z[target == 1], kind="stable")]
        first = np.searchsorted(np.cumsum(n[order]), int((1 - RECALL) * good), side="right")
        net.threshold = float(net.calibrated(z[order[first:first + 1]])[0])
    return net


ALPHABETS = ("0123456789abcdef", "0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789",
             "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/",
             "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789-_")


def constructed(found: list[tuple[str, str, str]], others: list[tuple[str, str, str]], seed: int = 3,
                n: int = 1200, of: list[int] | None = None) -> tuple[list[str], list[int]]:
    """Windows and labels: redrawn secrets in labelled and in other contexts and in long runs, and runs that are none.

    `of` takes the number of each window's candidate.
    """
    rng = random.Random(seed)
    words = [body for _, body, _ in others if body.isalpha()] or ["continuation", "representation"]
    found = found or [('token = "', "", '"'), ("key: ", "", "\n"), ("secret=", "", " ")]
    others = others or [("some words and ", "", " then"), ("", "", "")]
    x, y, of = [], [], [] if of is None else of

    def add(before, body, after, label, key=None):
        text = before[-BEFORE:] + body + after[:AFTER]
        start = len(before[-BEFORE:])
        for a, b in pieces(start, start + len(body)):
            if key:  # windows with the whole key or most of what they can hold of it; the rest of the run is no label
                seen = min(b, start + key[1]) - max(a, start + key[0])
                if seen < min(key[1] - key[0], INSIDE - STRIDE):
                    continue
            x.append(window(text, a, b))
            y.append(label)
            of.append(number)

    number = -1
    for k in range(n):
        alphabet = ALPHABETS[k % len(ALPHABETS)]
        draw = lambda lengths: "".join(rng.choices(alphabet, k=rng.choice(lengths)))
        body = draw((8, 10, 12, 14, 16, 20, 24, 32, 40, 43, 64))
        body = "AKIA" + body[:16] if k % 11 == 0 and len(body) >= 16 else body
        before, _, after = rng.choice(found if k % 3 else others)
        number += 1
        add(before, body, after, 1)
        mark = rng.choice("-_./=")
        path = lambda: mark.join(rng.choice(words)[:rng.randrange(3, 12)] for _ in range(rng.randrange(3, 8)))
        if k % 2:
            head, key, tail = path() + mark, draw((16, 20, 24, 32, 40)), mark + path()
            number += 1
            add(rng.choice(others)[0], head + key + tail, rng.choice(others)[2], 1, (len(head), len(head) + len(key)))
        kind = k % 10
        none = ("".join(rng.choice("0123456789") for _ in range(rng.choice((8, 10, 13, 16, 19)))) if kind == 0
                else f"20{rng.randrange(10, 30)}-0{rng.randrange(1, 10)}-1{rng.randrange(10)}" + f"T0{rng.randrange(10)}.00" * (k // 8 % 2) if kind == 1
                else rng.choice("abcdefxyz019-=_./") * rng.randrange(8, 50) if kind == 2
                else rng.choice("-_./").join(rng.choice(words)[:rng.randrange(3, 12)] for _ in range(rng.randrange(2, 5))) if kind == 3
                else path() if kind == 4
                else rng.choice(words).capitalize() + rng.choice((".", "", "-", "_x")) if kind == 5
                else rng.choice(words).upper() + rng.choice((".", "", "-", "")) if kind == 6
                else "".join(rng.choice(words)[:rng.randrange(3, 12)] for _ in range(2)).upper() if kind == 7
                else "".join(rng.choice(words)[:8] for _ in range(3)))
        if len(none) >= LEAST:
            before, _, after = rng.choice(others if k % 4 else found)
            number += 1
            add(before, none, after, 0)
    return x, y


def labelled(text: str) -> list[tuple[int, int, bool]]:
    """A text's candidates or their parts (start, end, label)."""
    runs = candidates(text)
    base = base_spans(text, runs)
    if not base:
        return [(a, b, False) for a, b in runs]
    out, keys = [], secrets(text)
    for start, end in runs:
        out += [(max(start, a), min(end, b), True) for a, _, b in keys if min(end, b) - max(start, a) >= LEAST]
        out += [(a, b, False) for a, b in outside(start, end, base)]
    return out


def held_back(text: str, start: int, end: int) -> bool:
    """Of each candidate by its characters and context, so that copies fall on one side."""
    return zlib.crc32(text[max(0, start - BEFORE):end + AFTER].encode("utf-8", "replace")) % FIFTH == 0


class Learner:
    """A copy of the network that passes through one part of the table."""

    def __init__(self, start: Network, number: int):
        self.net = start.with_flat(start.flat())
        self.adam, self.rng, self.number = Adam(self.net, RATE), np.random.default_rng(number), number
        self.x, self.y, self.waiting, self.steps = [], [], 0, 0
        self.kept: list[tuple[np.ndarray, np.ndarray]] = []
        # (before, body, after) for redrawing, and windows of labelled secrets.
        self.found, self.others, self.secrets = [], [], []
        self.seen = [0, 0, 0]
        self.drawn, self.drawn_label, self.drawn_of = [], [], []

    def remember(self, k: int, item) -> None:
        """Keep each of all so far with the same chance."""
        pool, limit = ((self.found, REMEMBERED), (self.others, REMEMBERED), (self.secrets, REMEMBERED))[k]
        self.seen[k] += 1
        if len(pool) < limit:
            pool.append(item)
        elif (at := int(self.rng.integers(self.seen[k]))) < limit:
            pool[at] = item

    def take(self, texts: list[str]) -> None:
        spots, y, at = [], [], len(GAP)
        for t in texts:
            other = True  # one context of a text is enough
            for a, b, hit in labelled(t):
                if held_back(t, a, b):
                    continue
                if hit or other:
                    self.remember(0 if hit else 1, (t[max(0, a - BEFORE):a], t[a:b], t[b:b + AFTER]))
                    other = other and hit
                for p, q in pieces(a, b):
                    spots.append((at + p, at + q))
                    y.append(hit)
                    if hit:
                        self.remember(2, window(t, p, q))
            at += len(t) + len(GAP)
        if not spots:
            return
        codes, where = _codes(GAP + "".join(t + GAP for t in texts)), np.array(spots)
        for k in range(0, len(where), TOGETHER):
            self.x.append(gathered(codes, where[k:k + TOGETHER]).astype(np.uint8))
        self.y.append(np.array(y, np.float64))
        self.waiting += len(y)
        if self.waiting >= STEP:
            x, y = np.concatenate(self.x), np.concatenate(self.y)
            whole = len(y) // STEP * STEP
            for k in range(0, whole, STEP):
                self.step(x[k:k + STEP], y[k:k + STEP])
            self.x, self.y, self.waiting = [x[whole:]], [y[whole:]], len(y) - whole

    def step(self, x: np.ndarray, y: np.ndarray, again: bool = False) -> None:
        """One step down the loss of these windows, of some secrets seen before and of redrawn ones."""
        if not again and len(self.kept) < STEPS:
            self.kept.append((x, y))
        self.steps += 1
        number: list[int] = []
        seed = int(self.rng.integers(1 << 62))
        made, label = constructed(self.found, self.others, seed, DRAWN, number)
        use = [n % FIFTH != 0 for n in number]
        if self.steps <= STEPS:
            base = len(self.drawn_of) and self.drawn_of[-1] + 1
            for w, l, n, u in zip(made, label, number, use, strict=True):
                if not u:
                    self.drawn.append(w)
                    self.drawn_label.append(l)
                    self.drawn_of.append(base + n)
        more, goal = [w for w, u in zip(made, use, strict=True) if u], [l for l, u in zip(label, use, strict=True) if u]
        if self.secrets:
            some = [self.secrets[k] for k in self.rng.integers(len(self.secrets), size=DRAWN)]
            more, goal = more + some, goal + [1] * len(some)
        x, y = np.concatenate((x, symbols(more))), np.concatenate((y, goal))
        hard = (2 * y - 1) * self.net.logits(x) < MARGIN
        if hard.any():
            good = y.sum()
            weight = np.where(y == 1, .5 / max(1, good), .5 / max(1, len(y) - good)) * hard.sum()
            self.adam.step(x[hard], y[hard], weight[hard])

    def done(self) -> None:
        """The last windows; small parts are passed again."""
        if self.waiting:
            self.step(np.concatenate(self.x), np.concatenate(self.y))
        kept = self.kept or [(np.zeros((0, WIDTH), np.uint8), np.zeros(0))]
        for k in range(STEPS - self.steps):
            self.step(*kept[k % len(kept)], again=True)


def outputs(net: Network, texts: list[str]) -> list[tuple[int, bool, int]]:
    """(output in steps, label, count) of the held-back candidates of these texts; a candidate's largest output counts."""
    spots, first, hits, at = [], [], [], len(GAP)
    for t in texts:
        for a, b, hit in labelled(t):
            if held_back(t, a, b):
                first.append(len(spots))
                hits.append(hit)
                spots += [(at + p, at + q) for p, q in pieces(a, b)]
        at += len(t) + len(GAP)
    if not spots:
        return []
    codes, where = _codes(GAP + "".join(t + GAP for t in texts)), np.array(spots)
    z = np.concatenate([net.fine(gathered(codes, where[k:k + TOGETHER])) for k in range(0, len(where), TOGETHER)])
    return counted(np.maximum.reduceat(z, first), np.array(hits))


def counted(z: np.ndarray, hits: np.ndarray) -> list[tuple[int, bool, int]]:
    value, n = np.unique(z * 2 + hits, return_counts=True)
    return [(int(v) >> 1, bool(v & 1), int(c)) for v, c in zip(value, n, strict=True)]


_COUNTS = "z int, hit boolean, n long"


def _counts(rows: list[tuple[int, bool, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.bool_(), pa.int64()))], ["z", "hit", "n"])


def fit(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", part: int = PART) -> Network:
    """Train on all texts, a copy for each `part` rows, and calibrate on the held-back fifth of all candidates."""
    small_batches(docs.sparkSession)
    x, y = constructed([], [])
    start = train(symbols(x), np.array(y, np.float64))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.xxhash64(F.col(id_col), text).alias("h"), text.alias("t"))
    parts = max(1, -(-docs.count() // part))
    rows = rows.withColumn("part", F.pmod("h", F.lit(parts)))

    def learn(batches: Iterator[pa.RecordBatch]):
        learner = None
        for batch in batches:
            numbers = batch.column(0).to_numpy()
            for at in np.split(np.arange(len(numbers)), np.flatnonzero(np.diff(numbers)) + 1):
                if not len(at):
                    continue
                if learner is None or learner.number != numbers[at[0]]:
                    if learner is not None:
                        yield learned(learner)
                    learner = Learner(start, int(numbers[at[0]]))
                learner.take(batch.column(1).slice(at[0], len(at)).to_pylist())
        if learner is not None:
            yield learned(learner)

    def learned(learner):
        learner.done()
        flat = np.rint(learner.net.flat() * FIXED).astype(np.int64)
        return pa.RecordBatch.from_arrays(
            [pa.array([flat.tolist()], pa.list_(pa.int64())), pa.array([learner.drawn], pa.list_(pa.string())),
             pa.array([learner.drawn_label], pa.list_(pa.int32())), pa.array([learner.drawn_of], pa.list_(pa.int32()))],
            ["flat", "drawn", "label", "of"])

    nets = materialise(rows.repartition("part").sortWithinPartitions("part", "h").select("part", "t").mapInArrow(
        learn, "flat array<long>, drawn array<string>, label array<int>, of array<int>"), "secret-nets")
    sums = nets.select(F.posexplode("flat").alias("k", "v")).groupBy("k").agg(F.sum("v").alias("v"), F.count("*").alias("n")).orderBy("k").collect()
    net = start.with_flat(np.array([r.v / r.n / FIXED for r in sums])) if sums else start
    net.scale, net.shift, net.threshold = start.scale, start.shift, start.threshold

    def of_texts(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            yield _counts(outputs(net, batch.column(0).to_pylist()))

    def of_drawn(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for drawn, label, of in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if drawn:
                    first = np.flatnonzero(np.diff(np.array(of), prepend=-1))
                    yield _counts(counted(np.maximum.reduceat(net.fine(symbols(drawn)), first), np.array(label)[first]))

    held = rows.select("t").mapInArrow(of_texts, _COUNTS).unionAll(nets.select("drawn", "label", "of").mapInArrow(of_drawn, _COUNTS))
    # At most 2 * (2 * LARGEST * FINE + 1) rows.
    got = held.groupBy("z", "hit").agg(F.sum("n").alias("n")).orderBy("z", "hit").collect()
    return calibrate(net, np.array([r.z / FINE for r in got]), np.array([float(r.hit) for r in got]), np.array([float(r.n) for r in got]))


def find(texts: list[str], net: Network) -> list[list[Span]]:
    """All findings of each text: (start, kind, end) by start, then kind."""
    out, runs, spots, first, at = [], [], [], [], len(GAP)
    for i, t in enumerate(texts):
        some = candidates(t)
        own = base_spans(t, some)
        out.append(own)
        for start, end in some:
            for a, b in outside(start, end, own) if own else ((start, end),):
                runs.append((i, a, b))
                first.append(len(spots))
                spots += [(at + x, at + y) for x, y in pieces(a, b)]
        at += len(t) + len(GAP)
    if runs:
        codes, where = _codes(GAP + "".join(t + GAP for t in texts)), np.array(spots)
        p = np.concatenate([net.probability(gathered(codes, where[k:k + TOGETHER])) for k in range(0, len(where), TOGETHER)])
        good = np.maximum.reduceat(p, first) >= net.threshold
        for (i, a, b), ok in zip(runs, good.tolist(), strict=True):
            if ok:
                out[i].append((a, "cnn", b))
    return [sorted(o, key=lambda s: (s[0], KINDS.index(s[1]))) for o in out]


def scan(docs: DataFrame, net: Network | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id and its findings, array of (kind, start, end)."""
    net = net or fit(docs, text_col, id_col)
    small_batches(docs.sparkSession)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def of(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            spans = find([t or "" for t in batch.column(1).to_pylist()], net)
            rows = [[{"kind": k, "start": a, "end": b} for a, k, b in s] for s in spans]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], ["id", "findings"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(of, "id long, findings array<struct<kind:string,start:long,end:long>>").withColumnRenamed("id", id_col)


def digest(findings: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts, the base findings' SHA-256 and all findings as kind:start:end."""
    base = F.filter("findings", lambda x: x["kind"] != "cnn")
    text = lambda a: F.concat_ws(",", F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))))
    count = lambda k: F.size(F.filter("findings", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return findings.select(id_col, count("assign"), count("access"), count("hex"), F.sha2(text(base), 256).alias("base_sha256"),
                           text(F.col("findings")).alias("spans"))


def base_digest(text: str) -> str:
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, k, b in base_spans(text)).encode()).hexdigest()
