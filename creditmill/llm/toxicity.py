"""Toxicity by a subsequence string kernel, Nyström landmarks and a support vector machine.

The kernel of two strings counts the subsequences of four letters that both hold, each weighted
by ``DECAY`` to the power of the letters and signs it skips, within ``SPAN`` places: a word whose
letters are parted or mixed with others still resembles the word. A blank counts as a letter, so
that words have edges; digits and other signs only take up room. Signs between two letters and
blanks between single letters are left out first, so that letters set apart meet again.

Labels are those of whole documents, and texts are not cut into sentences: of a document the most
suspicious stretch of letters is learnt. The most frequent letters have codes of their own, all
others of the sample share these codes by a fixed rule, so that letters of any script count; a
letter that the whole sample lacks is a sign. Training starts from the words that toxic sentences hold far more often
than clean ones, takes some of them and some clean words as landmarks, maps strings to their
kernels with the landmarks (whitened, as Nyström's method asks), and fits a squared-hinge machine.
It then scores the training sentences, adds the strongest stretches of each document under its
label, and fits again. Since the machine is linear in the kernel, all landmarks together are one
table of weights by four letters, and scoring a text is a sum over it: the score of a document
is that of its strongest stretch, turned into a probability.

The machine learns from a bounded sample of labelled documents (``SAMPLE`` of either label, the
first by a hash of the id); every document is scored, whole.

Defined cases: null and empty texts are scored like a text without letters; labels that are
null are left out, of contradicting labels of a document the toxic one counts; copies of a row
get equal scores; without labels of both kinds every score is 0; an empty table gives an empty
table; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditmill.llm.shingles import mixed

#: Labelled documents of either kind to learn from; bytes of a text that may be learnt from.
SAMPLE, LONGEST = 1500, 200_000
#: Places a subsequence may span, weight of a skipped place, places of the stretches that are tried.
SPAN, DECAY, STRETCHES = 6, 0.85, (6, 12)
#: Kernels are divided by this power of a stretch's length; what is added to the length's square,
#: so that a few stray letters resemble nothing.
NORM, DAMPING = 0.5, 4.0
#: Letters told apart, landmarks, negative strings, rounds of training, weight of errors.
LETTERS, LANDMARKS, NEGATIVES, ROUNDS, COST = 44, 120, 8_000, 4, 1000.0
_WORD = re.compile(r"[^\W\d_]{3,24}")
#: Characters scored at once.
CHARS = 1 << 20


def in_held_out_third(doc_id: Column) -> Column:
    """Documents whose labels are not learnt from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


_DISTANCES = list(combinations(range(1, SPAN), 3))


class Letters:
    """Codes of characters: 1 for blanks, letters from 2 on, everything else 0.

    The most frequent letters have a code each; every other letter of the texts shares one of these codes.
    """

    def __init__(self, texts: Iterable[str]):
        counts = Counter()
        for text in texts:
            counts.update(text.lower())
        own = sorted((c for c in counts if c.isalpha() and len(c) == 1), key=lambda c: (-counts[c], c))
        self.table = np.zeros(max([32, *(ord(f) for c in own for f in (c, c.upper()) if len(f) == 1)]) + 1, np.uint8)
        self.table[[9, 10, 13, 32]] = 1
        shared = 2 + mixed(np.array([ord(c) for c in own], np.uint64)) % np.uint64(LETTERS - 2)
        for code, c in zip([*range(2, LETTERS), *shared[LETTERS - 2 :].tolist()], own, strict=False):
            for form in {c, c.upper()}:
                if len(form) == 1:
                    self.table[ord(form)] = code

    def codes(self, texts: list[str], pad: int = SPAN + max(STRETCHES)) -> tuple[np.ndarray, np.ndarray]:
        """Codes of all texts, blank places after each, and where each starts."""
        points = np.frombuffer(("\0" * pad).join([*texts, ""]).encode("utf-32-le", "replace"), np.uint32)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + pad
        known = points < len(self.table)
        codes = np.where(known, self.table[np.where(known, points, 0)], 0)
        letter = codes > 1
        before, after = np.zeros_like(letter), np.zeros_like(letter)
        before[1:], after[:-1] = letter[:-1], letter[1:]
        single = letter & ~before & ~after  # a letter on its own
        single_before, single_after = np.zeros_like(letter), np.zeros_like(letter)
        single_before[1:], single_after[:-1] = single[:-1], single[1:]
        blank = (points == 32) | (points == 10)
        gone = ~letter & (points > 0) & np.where(blank, single_before & single_after, before & after)
        kept = np.flatnonzero(~gone)
        return codes[kept], np.searchsorted(kept, np.cumsum(lengths) - lengths)


def _fours(codes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each choice of distances: the places skipped, and the number of the four letters at every place."""
    x = codes.astype(np.int32)
    n = max(0, len(x) - SPAN + 1)
    one, two, three = x[:n] * LETTERS**3, x * LETTERS**2, x * LETTERS
    for a, b, c in _DISTANCES:
        yield c - 3, one + two[a : a + n] + three[b : b + n] + x[c : c + n]


def _blank_fours() -> np.ndarray:
    """Which fours hold a place that is no letter."""
    k = np.arange(LETTERS**4)
    return (k % LETTERS == 0) | (k // LETTERS % LETTERS == 0) | (k // LETTERS**2 % LETTERS == 0) | (k < LETTERS**3)


def string_map(letters: Letters, strings: list[str], heads: list[int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The kernel's feature map, sparse: owner, four letters, weight. ``heads``: how many places of each may begin a subsequence."""
    codes, starts = letters.codes(strings)
    blank = _blank_fours()
    owner, four, weight = [], [], []
    whose = np.searchsorted(starts, np.arange(len(codes)), "right") - 1
    allowed = np.arange(len(codes)) - starts[whose] < (np.array(heads)[whose] if heads else len(codes))
    for skipped, number in _fours(codes):
        use = np.flatnonzero(~blank[number] & allowed[: len(number)])
        owner.append(whose[use])
        four.append(number[use])
        weight.append(np.full(len(use), DECAY**skipped))
    return np.concatenate(owner), np.concatenate(four), np.concatenate(weight)


class Kernel:
    """Kernels of strings with landmarks; both are scaled by their lengths in the kernel's space."""

    def __init__(self, letters: Letters, landmarks: list[str]):
        self.letters = letters
        owner, four, weight = string_map(letters, landmarks)
        self.known, row = np.unique(four, return_inverse=True)
        self.row = np.full(LETTERS**4, -1, np.int32)
        self.row[self.known] = np.arange(len(self.known))
        self.map = np.zeros((len(self.known), len(landmarks)), np.float32)
        np.add.at(self.map, (row, owner), weight)
        self.map /= np.maximum(np.sqrt((self.map**2).sum(0)), 1e-9)

    def __call__(self, strings: list[str], heads: list[int] | None = None) -> np.ndarray:
        out = np.zeros((len(strings), self.map.shape[1]))
        for first in range(0, len(strings), 5000):
            some = strings[first : first + 5000]
            owner, four, weight = string_map(self.letters, some, heads[first : first + 5000] if heads else None)
            length = np.power(np.bincount(owner, weight * weight, len(some)) + DAMPING, NORM / 2)
            row = self.row[four]
            use = np.flatnonzero(row >= 0)  # letters that no landmark holds add nothing
            use = use[np.argsort(owner[use], kind="stable")]
            own, at = np.unique(owner[use], return_index=True)
            if len(own):
                sums = np.add.reduceat(self.map[row[use]] * weight[use].astype(np.float32)[:, None], at)
                out[first + own] = sums / length[own, None]
        return out


def fit_machine(x: np.ndarray, y: np.ndarray, often: np.ndarray, cost: float = COST) -> np.ndarray:
    """Squared-hinge machine by Newton steps on the strings inside the margin; weights, the last one the bias.

    ``often``: how much each string counts beside others of its label; both labels count the same.
    """
    x = np.hstack([x, np.ones((len(x), 1))])
    side = np.where(y > 0, 1.0, -1.0)
    share = np.where(y > 0, often / often[y > 0].sum(), often / often[y <= 0].sum())
    penalty = np.eye(x.shape[1])
    penalty[-1, -1] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(40):
        inside = side * (x @ w) < 1
        z, s = x[inside], share[inside] * cost
        new = np.linalg.solve(penalty + (z * s[:, None]).T @ z, (z * s[:, None]).T @ side[inside])
        if np.abs(new - w).max() < 1e-9:
            return new
        w = (w + new) / 2 if _ > 20 else new
    return w


def fit_probability(scores: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve, with targets drawn in a little from 0 and 1."""
    n1, n0 = (y > 0).sum(), (y <= 0).sum()
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack([scores, np.ones(len(scores))], 1)
    w = np.array([1.0, 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (p - target))
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


class Scorer:
    """The machine as one table of weights by four letters."""

    def __init__(self, letters: Letters, known: np.ndarray, weights: np.ndarray, bias: float):
        self.letters, self.bias = letters, bias
        self.known, self.weights = known, weights.astype(np.float32)
        self.slope, self.offset = 1.0, 0.0

    def _table(self) -> np.ndarray:
        table = np.zeros(LETTERS**4, np.float32)
        table[self.known] = self.weights
        return table

    def _places(self, codes: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The best stretch from each place on: its score (without the bias), and which of the lengths it has."""
        total = np.zeros(max(0, len(codes) - SPAN + 1), np.float32)
        square = np.zeros_like(total)
        letter = (codes > 0).astype(np.float32)
        for (skipped, number), (a, b, c) in zip(_fours(codes), _DISTANCES, strict=True):
            weight = np.float32(DECAY**skipped)
            total += weight * table[number]
            n = len(total)
            square += weight * weight * (letter[:n] * letter[a : a + n] * letter[b : b + n] * letter[c : c + n])
        sums = np.concatenate([[0.0], np.cumsum(total, dtype=np.float64)])
        squares = np.concatenate([[0.0], np.cumsum(square, dtype=np.float64)])
        n = max(0, len(sums) - max(STRETCHES))
        best, which = np.full(n, -np.inf), np.zeros(n, np.int8)
        for k, size in enumerate(STRETCHES):
            some = (sums[size : size + n] - sums[:n]) / np.power(squares[size : size + n] - squares[:n] + DAMPING, NORM / 2)
            better = some > best
            best[better], which[better] = some[better], k
        return best, which

    def strongest(self, texts: list[str]) -> tuple[np.ndarray, list[tuple[int, int]]]:
        """The score of each text's strongest stretch, and its place and length."""
        best, place, table = np.zeros(len(texts)), [], self._table()
        first = 0
        while first < len(texts):
            last, size = first, 0
            while last < len(texts) and (last == first or size + len(texts[last]) <= CHARS):
                size += len(texts[last])
                last += 1
            codes, starts = self.letters.codes(texts[first:last])
            scores, which = self._places(codes, table)
            best[first:last] = np.maximum.reduceat(scores, starts)
            for a, b in zip(starts, np.append(starts[1:], len(scores)), strict=True):
                k = int(a + scores[a:b].argmax())
                place.append((k - int(a), STRETCHES[which[k]]))
            first = last
        return best + self.bias, place

    def probability(self, texts: list[str]) -> np.ndarray:
        scores, _ = self.strongest(texts)
        return 1 / (1 + np.exp(-np.clip(self.slope * scores + self.offset, -30, 30)))


def _parted(words: list[str], rng: np.random.Generator) -> list[str]:
    """Words with a letter put in somewhere, as writers do to hide them."""
    out = []
    for word in words:
        at = int(rng.integers(1, len(word)))
        out.append(word[:at] + str(rng.choice(list("abdeghiklmoruxyz"))) + word[at:])
    return out


def _in_place(seeds: list[str], texts: list[str], rng: np.random.Generator, each: int = 12) -> tuple[list[str], list[int], list[str]]:
    """Stretches of toxic texts that begin with a seed, plain or parted, how many places may begin a subsequence, and the seed."""
    known, seen = set(seeds), Counter()
    pieces, heads, whose = [], [], []
    for text in texts:
        for found in _WORD.finditer(text):
            word = found[0].lower()
            if word in known and seen[word] < each:
                seen[word] += 1
                after = text[found.end() : found.end() + 30]
                for form in (word, *_parted([word, word], rng)):
                    size = min((s for s in STRETCHES if s + 2 >= len(form)), default=max(STRETCHES))
                    pieces.append((f" {form}{after}")[: size + SPAN - 1])
                    heads.append(size)
                    whose.append(word)
    return pieces, heads, whose


def train(texts: list[str], toxic: list[int], seed: int = 7) -> Scorer | None:
    """A scorer from whole texts and their labels; None unless there are texts of both labels."""
    y = np.array(toxic, int)
    if len(set(toxic)) < 2:
        return None
    rng = np.random.default_rng(seed)
    letters = Letters(texts)
    words = [set(_WORD.findall(t.lower())) for t in texts]
    bad, good = Counter(), Counter()
    for own, label in zip(words, toxic, strict=True):
        (bad if label else good).update(own)
    n1, n0 = (y > 0).sum(), (y <= 0).sum()
    odds = {w: np.log((bad[w] + 0.1) / (n1 + 0.2)) - np.log((good[w] + 0.1) / (n0 + 0.2)) for w in bad}
    first = [max(own, key=lambda w: (odds[w] + 0.1 * np.log(bad[w]), w)) for own, label in zip(words, toxic, strict=True) if label and own]
    seeds = [w for w, _ in Counter(first).most_common() if good[w] == 0]
    more = sorted((w for w in odds if odds[w] > 3 and bad[w] >= max(3, 0.01 * n1)), key=lambda w: (-bad[w], w))
    seeds = list(dict.fromkeys([*more, *seeds]))[: 4 * LANDMARKS] or first
    common = [w for w, _ in good.most_common(NEGATIVES)]
    half = LANDMARKS // 2
    edged = lambda some: [f" {w} " for w in some]
    landmarks = list(dict.fromkeys([*seeds[:half], *rng.permutation(common[: 4 * half])[: LANDMARKS - min(half, len(seeds))].tolist()]))
    landmarks = edged(landmarks)
    kernel = Kernel(letters, landmarks)
    values, vectors = np.linalg.eigh(kernel(landmarks))
    whiten = vectors / np.sqrt(np.maximum(values, 1e-3 * values.max()))
    strings = edged([*seeds, *_parted(seeds, rng), *common])
    labels = [1] * (2 * len(seeds)) + [0] * len(common)
    often = [float(bad[w]) for w in seeds] * 2 + [1.0] * len(common)
    features = kernel(strings) @ whiten
    pieces, heads, whose = _in_place(seeds, [t for t, label in zip(texts, toxic, strict=True) if label], rng)
    if pieces:
        features = np.vstack([features, kernel(pieces, heads) @ whiten])
        labels += [1] * len(pieces)
        share = Counter(whose)
        often += [3.0 * bad[w] / share[w] for w in whose]
    for _ in range(ROUNDS):
        w = fit_machine(features, np.array(labels), np.array(often))
        scorer = Scorer(letters, kernel.known, kernel.map @ (whiten @ w[:-1]), float(w[-1]))
        scores, places = scorer.strongest(texts)
        pieces, heads = [], []
        for text, (place, size), score, label in zip(texts, places, scores.tolist(), toxic, strict=True):
            piece = text[place : place + size + SPAN - 1]
            if (label and score > 0 or not label and score > -1) and len(piece) > 4:
                pieces.append(piece)
                heads.append(size)
                labels.append(int(label))
                often.append(1.0 if label else 5.0)
        if pieces:
            features = np.vstack([features, kernel(pieces, heads) @ whiten])
    scorer.slope, scorer.offset = fit_probability(scores, y)
    return scorer


# ---- over tables ----------------------------------------------------------------------------


def learnt(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Scorer | None:
    """Train on a bounded sample of the labelled documents that are not held out."""
    named = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int").alias("toxic"))
    known = named.where("id is not null and toxic is not null").where(~in_held_out_third(F.col("id")))
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    texts = texts.where(F.octet_length("text") <= LONGEST)
    # Labels of documents that are elsewhere, or too long to learn from, take no place in the sample.
    known = known.join(texts.select("id"), "id", "left_semi")
    once = known.groupBy("id").agg(F.max("toxic").alias("toxic")).withColumn("h", F.xxhash64("id"))
    some = once.where("toxic > 0").orderBy("h").limit(sample).union(once.where("toxic <= 0").orderBy("h").limit(sample))
    # Bounded by the sample: at most 2 * ``sample`` ids are broadcast, and so many texts collected.
    texts = texts.join(F.broadcast(some), "id")
    rows = sorted((r["h"], r["text"], r["toxic"]) for r in texts.select("h", "text", "toxic").dropDuplicates(["h"]).collect())
    return train([t for _, t, _ in rows], [int(x > 0) for _, _, x in rows])


def scored(docs: DataFrame, scorer: Scorer | None, threshold: float = 0.7) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``."""

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            found = scorer.probability(texts) if scorer and texts else np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.float64())], names=["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = rows.mapInArrow(score, "doc_id long, score double")
    held = F.coalesce(in_held_out_third(F.col("doc_id")), F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = 0.7) -> DataFrame:
    """Train on the labelled sample and score every document."""
    return scored(docs, learnt(docs, labels, sample), threshold)
