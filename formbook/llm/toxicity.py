"""Toxic texts by a support vector machine on the subsequence string kernel.

A text's units are its lower-cased words without outer marks, the same without
inner marks, and runs of single characters divided by spaces, joined. The kernel
of two units sums, over all subsequences of `P` characters, LAMBDA to the power
of the gaps they leave in both, so inserted characters and gaps weaken a match and
do not end it. It is zero exactly where the longest common subsequence is shorter
than `P`, which a bit-parallel pass finds for most pairs.

Nyström landmarks are stems found in labelled texts: character runs that hardly any
clean texts and so many toxic ones hold that few runs do by chance, each round the one
that explains the words of most toxic texts not yet explained. A unit's features are its kernel values with the
landmarks times the inverse square root of the landmarks' own kernel matrix. The
machine (squared hinge loss, Newton's method) learns from units of labelled
sentences as in multiple-instance learning: in toxic sentences the units that hold
a landmark, as they are and with characters inserted; in clean sentences all units
that share a subsequence with a landmark. A text scores its best unit.

A second machine of the same kind answers for words that clean texts hold as well,
yet rarely more than once: its landmarks are runs that several words of a toxic text
hold and that more clean texts hold once than labels may be wrong. A text's second score is the log-likelihood ratio of the number of its units that this
machine accepts, against the number of all its units. Isotonic regression on the
labelled texts turns each score into a probability; the larger one counts.

Training reads at most `FIT_TOXIC` toxic and `FIT_CLEAN` clean labelled texts of
at most `FIT_CHARS` characters, by the hash of their id. Scoring covers whole
texts; units of more than `LONGEST` characters are scored in windows that overlap
by half. Workers remember units' scores.

Defined cases: null and empty texts have no unit and score as a text without any
shared subsequence; texts of equal scores have equal probabilities, and of equal
best units the first in order is named; repeated rows are scored once each; labels that are null are
not read; of contradicting labels of an id the toxic one counts; without both
labels every score is 0; an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches

P, LAMBDA = 4, 0.6
MAX_LANDMARKS = 256
# Words of a text that must hold a landmark of the second machine in training, and the most such landmarks.
SEVERAL, MAX_SEVERAL = 2, 16
STEM = (5, 7)
# START begins each compared unit, so that a stem may say that it begins a word; END ends those of three characters.
START, END = "^", "$"
# Probability below which a run's toxic texts are no chance, the share of runs that may be, and of labels that may be wrong.
CHANCE, FALSE, NOISE = 1e-8, 0.05, 0.05
FEWEST = 3  # more toxic texts than these must hold a stem
# Weights of units found in toxic texts and of those with an invented insertion, against units of clean texts.
FOUND, INSERTED = 8.0, 0.2
SPREAD = 0.02
# Share of a text's runs of so many words that earlier texts hold from which it is a copy of theirs.
COPY, COPY_WORDS = 0.5, 3
BLOCK = 16_384
FIT_TOXIC, FIT_CLEAN, FIT_CHARS = 800, 1600, 20_000
LONGEST = 32
THRESHOLD = 0.7
REMEMBERED = 600_000
SPACED = re.compile(r"(?<!\S)(?:\S ){2,}\S(?!\S)")
INNER = re.compile(r"[\W_]+")


def units(text: str) -> set[str]:
    """Raw units of a text: words as written, and spaced-out runs joined."""
    low = text.lower()
    found = set(low.split())
    found.update(m[0].replace(" ", "") for m in SPACED.finditer(low))
    return found


def forms(unit: str) -> set[str]:
    """What of a raw unit is compared: without outer marks, without any marks, in windows if long."""
    out = set()
    for word in {INNER.sub("", unit), re.sub(r"^[\W_]+|[\W_]+$", "", unit)}:
        if len(word) <= LONGEST:
            out.add(word)
        else:
            out.update(word[i:i + LONGEST] for i in range(0, len(word) - LONGEST // 2, LONGEST // 2))
    return {START + w + END * (len(w) < P) for w in out if len(w) >= P - 1}


def _codes(words: list[str], alphabet: np.ndarray) -> np.ndarray:
    """Words as rows of places in the sorted alphabet, counted from 2; 1 is any other character, 0 none."""
    width = max(map(len, words))
    raw = np.frombuffer("".join(w.ljust(width, "\0") for w in words).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(words), width)
    at = np.minimum(np.searchsorted(alphabet, raw), len(alphabet) - 1)
    return np.where(alphabet[at] == raw, at + 2, raw != 0).astype(np.uint16)


def common_length(codes: np.ndarray, landmark: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of each word with a landmark of at most 63 characters."""
    full = np.uint64((1 << len(landmark)) - 1)
    places = np.zeros(max(int(codes.max(initial=0)), int(landmark.max())) + 1, np.uint64)
    for k, c in enumerate(landmark.tolist()):
        places[c] |= np.uint64(1 << k)
    v = np.full(len(codes), full)
    for column in codes.T:
        u = v & places[column]
        v = ((v + u) | (v - u)) & full
    return len(landmark) - np.bitwise_count(v)


def kernel(a: np.ndarray, b: np.ndarray, p: int = P, decay: float = LAMBDA) -> np.ndarray:
    """Gap-weighted kernel of subsequences of length p for rows of a with rows of b (codes, zero-padded)."""
    rows, n, m = len(a), a.shape[1], b.shape[1]
    # below[q][j]: K'_q of the rows of a so far with the first j characters of b.
    below = [np.ones((m + 1, rows), np.float64)] + [np.zeros((m + 1, rows), np.float64) for _ in range(p - 1)]
    total = np.zeros(rows)
    for i in range(n):
        same = (a[:, i] == b.T) & (a[:, i] != 0)
        total += (below[p - 1][:-1] * same).sum(0)
        for q in range(p - 1, 0, -1):
            run = np.zeros(rows)
            new = below[q] * decay
            for j in range(m):
                run = decay * run + np.where(same[j], below[q - 1][j], 0.0)
                new[j + 1] += run
            below[q] = new
    # Each matched character would count once; gaps only are weighed, so a run without gaps counts one.
    return total


def kernel_table(words: list[str], landmarks: list[str]) -> np.ndarray:
    """Kernel of each word with each landmark; pairs without a common subsequence of P are not computed."""
    out = np.zeros((len(words), len(landmarks)))
    by_length = defaultdict(list)
    for k, w in enumerate(words):
        by_length[-(-len(w) // 4)].append(k)
    alphabet = np.array(sorted(map(ord, set("".join(landmarks)))), np.uint32)
    marks = [_codes([z], alphabet)[0] for z in landmarks]
    for some in by_length.values():
        at, codes = np.array(some), _codes([words[k] for k in some], alphabet)
        for z, mark in enumerate(marks):
            near = np.flatnonzero(common_length(codes, mark) >= P)
            if len(near):
                out[at[near], z] = kernel(codes[near], np.broadcast_to(mark, (len(near), len(mark))))
    return out


@dataclass
class Machine:
    """A linear machine on the Nyström features of its landmarks."""
    landmarks: list[str] = field(default_factory=list)
    map: np.ndarray | None = None
    weight: np.ndarray | None = None
    offset: float = -1.0

    def decision(self, words: list[str]) -> np.ndarray:
        if not self.landmarks or not words:
            return np.full(len(words), self.offset)
        return kernel_table(words, self.landmarks) @ (self.map @ self.weight) + self.offset


Evidence = tuple[float, float]  # the best unit's decision, and the second machine's log-likelihood ratio


@dataclass
class Model:
    best: Machine = field(default_factory=Machine)
    several: Machine = field(default_factory=Machine)
    rates: tuple[float, float] = (1.0, 1.0)  # share of units that the second machine accepts, in toxic and in clean texts
    steps: list[tuple[np.ndarray, np.ndarray] | None] = field(default_factory=lambda: [None, None])
    known: dict[str, tuple[float, bool]] = field(default_factory=dict, repr=False, compare=False)

    def __getstate__(self):
        return self.__dict__ | {"known": {}}

    @property
    def landmarks(self) -> list[str]:
        return self.best.landmarks + self.several.landmarks

    def learn(self, raw: set[str]) -> None:
        """Judge the units that are new to this worker."""
        known = self.known
        new = [u for u in raw if u not in known]
        if len(known) + len(new) > REMEMBERED:
            known.clear()
            new = list(raw)
        shapes = [forms(u) for u in new]
        words = sorted(set().union(*shapes)) if shapes else []
        first = dict(zip(words, self.best.decision(words).tolist(), strict=True))
        second = dict(zip(words, (self.several.decision(words) > 0).tolist(), strict=True))
        none = self.best.offset
        known.update((u, (max((first[w] for w in s), default=none), any(second[w] for w in s))) for u, s in zip(new, shapes, strict=True))

    def texts(self, texts: list[str]) -> list[tuple[Evidence, str | None]]:
        """(evidence, best unit) of each text."""
        split = [units(t) for t in texts]
        self.learn(set().union(*split) if split else set())
        known, out = self.known, []
        many, few = self.rates
        for some in split:
            top = max((known[u][0] for u in some), default=self.best.offset)
            accepted = [u for u in some if known[u][1]]
            ratio = len(accepted) * float(np.log(many / few)) - len(some) * (many - few)
            telling = [u for u in some if known[u][0] >= top] if top > self.best.offset and (top > 0 or not accepted) else accepted
            out.append(((max(top, self.best.offset), ratio), min(telling, default=None)))
        return out

    def probability(self, evidence: Evidence) -> float:
        return max((_smooth(d, *s) for d, s in zip(evidence, self.steps, strict=True) if s), default=0.0)


def _smooth(decision: float, steps: np.ndarray, share: np.ndarray) -> float:
    order = 1 / (1 + np.exp(-np.clip(decision, -40, 40)))  # keeps unequal decisions apart within a step
    return float((1 - SPREAD) * np.interp(decision, steps, share) + SPREAD * order)


def _runs(word: str) -> set[str]:
    return {word[i:i + n] for n in range(STEM[0], min(STEM[1], len(word)) + 1) for i in range(len(word) - n + 1)}


def _held(texts: list[set[str]], words: int, least: int) -> dict[str, int]:
    """Runs that so many words of at least so many texts hold, and of how many texts.

    Length by length: a run is held no more often than the two runs one shorter within it.
    """
    out, shorter = {}, None
    for n in range(STEM[0], STEM[1] + 1):
        count = Counter()
        for some in texts:
            here = Counter(g for w in some for g in {w[i:i + n] for i in range(len(w) - n + 1)}
                           if shorter is None or (g[:-1] in shorter and g[1:] in shorter))
            count.update(g for g, c in here.items() if c >= words)
        shorter = {g: c for g, c in count.items() if c >= least}
        out |= shorter
    return out


def _least(texts: dict[str, int], against: Counter, rate: float) -> int:
    """The fewest toxic texts that tell: of the runs in so many and in no clean text few are there by chance.

    By chance k texts are all toxic `rate / (k (1 - rate))` times as often as all but one of them.
    """
    most = max(2, int(np.ceil(np.log(CHANCE) / np.log(rate))))
    all_toxic = Counter(n for g, n in texts.items() if not against[g])
    but_one = Counter(n + 1 for g, n in texts.items() if against[g] == 1)
    least, chance, found = most, 0.0, 0
    for k in range(most - 1, FEWEST, -1):
        once = rate / (k * (1 - rate))
        chance, found = chance + but_one[k] * once, found + all_toxic[k]
        if (but_one[k] + 1) * once <= FALSE * all_toxic[k] and chance + once <= FALSE * found:
            least = k
    return least


def stems(toxic: list[set[str]], clean: list[set[str]], limit: int = MAX_LANDMARKS) -> list[str]:
    """Runs of characters that mark toxic texts, most telling first.

    A run must occur in so many toxic texts that chance would hardly have put them
    all there (`_least`), and in few clean ones beside them. Each round takes the
    run that explains most toxic texts' words not yet explained, the longest of equals.
    """
    rate = len(toxic) / (len(toxic) + len(clean))
    holds = defaultdict(list)
    for k, words in enumerate(toxic):
        for w in words:
            holds[w].append(k)
    texts = _held(toxic, 1, FEWEST)
    against = Counter(g for words in clean for g in {g for w in words for g in _runs(w) if g in texts})
    least = _least(texts, against, rate)
    grams = {g: [] for g, n in texts.items() if n - against[g] / NOISE >= least}
    for w in holds:
        for g in _runs(w):
            if g in grams:
                grams[g].append(w)
    out, explained = [], set()

    def left(g):
        return len({k for w in grams[g] if w not in explained for k in holds[w]}) - against[g] / NOISE

    count = {g: left(g) for g in grams}
    while count and len(out) < limit:
        best = max(count, key=lambda g: (count[g], len(g), g))
        real = left(best)
        if real < least:
            del count[best]
        elif real < count[best]:
            count[best] = real
        else:
            out.append(best)
            explained.update(grams[best])
            del count[best]
    return out


def repeated_stems(toxic: list[set[str]], clean: list[set[str]], limit: int = MAX_SEVERAL) -> list[str]:
    """Runs that clean texts hold too, but several words of many toxic and of few clean texts, most telling first.

    Each round takes the run with the largest likelihood ratio against the share of
    toxic texts, the longest of equals, and sets the toxic texts that it marks aside.
    """
    rate, need = len(toxic) / (len(toxic) + len(clean)), -np.log(CHANCE)
    holds = {g: set() for g in _held(toxic, SEVERAL, int(np.ceil(need / -np.log(rate))))}

    def marked(words):
        count = Counter(g for w in words for g in _runs(w) if g in holds)
        return count, [g for g, n in count.items() if n >= SEVERAL]

    for k, words in enumerate(toxic):
        for g in marked(words)[1]:
            holds[g].add(k)
    once, against = Counter(), Counter()
    for words in clean:
        count, often = marked(words)
        once.update(count.keys())
        against.update(often)
    holds = {g: ks for g, ks in holds.items() if once[g] > max(2, NOISE * len(ks))}

    def ratio(g, done):
        ones, zeros = len(holds[g] - done), against[g]
        share = ones / max(1, ones + zeros)
        if share <= rate:
            return 0.0
        return ones * np.log(share / rate) + (zeros * np.log((1 - share) / (1 - rate)) if zeros else 0.0)

    out, done = [], set()
    while holds and len(out) < limit:
        best = max(holds, key=lambda g: (ratio(g, done), len(g), g))
        if ratio(best, done) < need:
            break
        out.append(best)
        done |= holds.pop(best)
    return out


def inserted(word: str, rng: random.Random) -> str:
    at = rng.randrange(2, len(word))
    return word[:at] + rng.choice("xaeiou1hz") + word[at:]


def distinct_texts(texts: list[str]) -> list[str]:
    """The texts, in order, without those that mostly repeat earlier ones: copies are no further evidence."""
    seen, out = set(), []
    for t in sorted(set(texts)):
        words = t.lower().split()
        runs = {tuple(words[k:k + COPY_WORDS]) for k in range(max(1, len(words) - COPY_WORDS + 1))}
        if sum(r in seen for r in runs) < COPY * len(runs):
            out.append(t)
            seen |= runs
    return out


def machine(landmarks: list[str], toxic: list[set[str]], fine: list[str], rng: random.Random) -> Machine:
    """Learn units that hold a landmark, with insertions too, against units of clean texts."""
    if not landmarks:
        return Machine()
    gram = kernel_table(landmarks, landmarks)
    values, vectors = np.linalg.eigh((gram + gram.T) / 2)
    good = values > 1e-6 * values.max()
    out = Machine(landmarks, vectors[:, good] / np.sqrt(values[good]))
    bad = sorted({w for t in toxic for w in t if any(z in w for z in landmarks)})
    whole = len(bad)
    bad += [inserted(w, rng) for w in bad]
    table = kernel_table(bad, landmarks)
    rows = [(table @ out.map).astype(np.float32)]
    for k in range(0, len(fine), BLOCK):
        other = kernel_table(fine[k:k + BLOCK], landmarks)
        rows.append((other[other.any(1)] @ out.map).astype(np.float32))
    x = np.concatenate((*rows, np.zeros((1, out.map.shape[1]), np.float32)))
    y = np.concatenate((np.ones(len(bad)), -np.ones(len(x) - len(bad))))
    cost = np.where(y > 0, 1.0 / max(1, len(bad)), 1.0 / max(1, len(x) - len(bad))) * 1e4
    cost[:whole] *= FOUND
    cost[whole:len(bad)] *= INSERTED
    x1, w = np.concatenate((x, np.ones((len(x), 1), np.float32)), 1), np.zeros(x.shape[1] + 1)
    ridge = np.append(np.ones(x.shape[1]), 1e-6)
    for _ in range(40):  # Newton's method for the squared hinge loss
        act = y * (x1 @ w) < 1
        xa = x1[act] * cost[act, None]
        new = np.linalg.solve(np.diag(ridge) + xa.T @ x1[act], xa.T @ y[act])
        if np.allclose(new, w, atol=1e-9):
            break
        w = new
    out.weight, out.offset = w[:-1], float(w[-1])
    return out


def train(toxic: list[str], clean: list[str], seed: int = 11) -> Model:
    """Fit on labelled texts."""
    if not toxic or not clean:
        return Model()
    rng = random.Random(seed)
    toxic, clean = distinct_texts(toxic), distinct_texts(clean)
    toxic_words = [set().union(*map(forms, units(t))) if t else set() for t in toxic]
    clean_words = [set().union(*map(forms, units(t))) if t else set() for t in clean]
    fine = sorted(set().union(*clean_words))
    shared = repeated_stems(toxic_words, clean_words)
    own = [{w for w in words if not any(z in w for z in shared)} for words in toxic_words]
    model = Model(machine(stems(own, clean_words), own, fine, rng))
    y = np.concatenate((np.ones(len(toxic)), np.zeros(len(clean))))
    if model.best.landmarks:
        model.steps[0] = isotonic(np.array([d for (d, _), _ in model.texts(toxic + clean)]), y)
    open_ = [model.probability(e) < THRESHOLD for e, _ in model.texts(toxic + clean)]
    model.several = machine(shared, toxic_words, fine, rng)
    model.known.clear()
    if model.several.landmarks:
        model.learn({u for t in toxic + clean for u in units(t)})
        counts = np.array([(sum(model.known[u][1] for u in some), len(some)) for some in map(units, toxic + clean)])
        member = (y == 1) & np.array(open_) & (counts[:, 0] >= SEVERAL)
        many, few = ((counts[at, 0].sum() + 0.5) / (counts[at, 1].sum() + 1) for at in (member, y == 0))
        model.rates = (float(max(many, few)), float(few))
        at = np.array(open_)
        model.steps[1] = isotonic(np.array([c for (_, c), _ in model.texts(toxic + clean)])[at], y[at])
    return model


def isotonic(z: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression of labels on decisions: the blocks' ends and smoothed shares of ones."""
    blocks: list[list[float]] = []  # first and last decision, ones, rows
    for d, t in sorted(zip(z.tolist(), y.tolist(), strict=True)):
        blocks.append([d, d, t, 1.0])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][3] >= blocks[-1][2] * blocks[-2][3]:
            _, last, ones, rows = blocks.pop()
            blocks[-1][1:] = [last, blocks[-1][2] + ones, blocks[-1][3] + rows]
    share = np.maximum.accumulate([(ones + 0.5) / (rows + 1) for _, _, ones, rows in blocks])
    return np.array([d for b in blocks for d in b[:2]]), np.repeat(share, 2)


def held_out(id_col: Column) -> Column:
    """Rows that training never reads."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Train on a bounded sample of the labelled rows that are not held out."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    known = known.groupBy(F.col(id_col).cast("long").alias("_id")).agg(F.max(F.col(label_col).cast("int")).alias("_toxic"))
    order = [F.xxhash64("_id"), F.col("_id")]
    some = known.where("_toxic = 1").orderBy(*order).limit(FIT_TOXIC).unionByName(known.where("_toxic = 0").orderBy(*order).limit(FIT_CLEAN))
    text = F.col(text_col).cast("string")
    rows = (docs.select(F.col(id_col).cast("long").alias("_id"), text.alias("_text")).where(F.length("_text") <= FIT_CHARS)
            .join(F.broadcast(some), "_id").collect())  # at most FIT_TOXIC + FIT_CLEAN ids
    rows = sorted((r._id, r._text, r._toxic) for r in rows)
    return train([t for _, t, y in rows if y == 1], [t for _, t, y in rows if y == 0])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, predicted, unit): unit is the most telling unit of a text that is predicted toxic."""
    small_batches(docs.sparkSession)

    def of(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            got = model.texts([t or "" for t in batch.column(1).to_pylist()])
            p = [model.probability(e) for e, _ in got]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(p, pa.float64()), pa.array([int(x >= THRESHOLD) for x in p], pa.int32()),
                 pa.array([u if x >= THRESHOLD else None for x, (_, u) in zip(p, got, strict=True)], pa.string())],
                ["id", "score", "predicted", "unit"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(of, "id long, score double, predicted int, unit string").withColumnRenamed("id", id_col)


def clean_rows(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows whose text is not predicted toxic, all columns kept."""
    small_batches(docs.sparkSession)
    at = docs.columns.index(text_col)

    def of(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            got = model.texts([t or "" for t in batch.column(at).to_pylist()])
            yield batch.filter(pa.array([model.probability(e) < THRESHOLD for e, _ in got], pa.bool_()))

    return docs.mapInArrow(of, docs.schema)
