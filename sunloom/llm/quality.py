"""Text quality from weak labels: labellers vote, expectation-maximisation weighs them, a hashed linear model learns.

Heuristic labellers vote good (1), bad (-1) or nothing (0) on every text. How often each vote pattern occurs in all
documents is counted in Spark; from these counts alone, EM estimates how reliable each labeller is and a posterior for
each pattern. The posteriors of a bounded sample train a logistic scorer over hashed words and word shapes, which scores
every whole text, also where labellers say nothing.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, stage

#: Documents that train the scorer at most (by hash of doc_id and text), hashed features, passes over the sample.
SAMPLE, BITS, EPOCHS = 6000, 14, 12
_SYMBOLS, _CAPITALS = b"#$%&*^~<>{}[]=\\|_@+", bytes(range(65, 91))
#: Endings of words in garbled text.
_MARKS = frozenset(bytes([b]) * 3 for b in b"#$%&*@~^")
#: Class of each byte for word shapes: capitals, digits, letters, others as they are.
_SHAPE = bytes(65 if 65 <= b <= 90 else 48 if 48 <= b <= 57 else 97 if 97 <= b <= 122 or b >= 128 else b for b in range(256))


@dataclass
class Facts:
    """What labellers look at, counted once per text. Plain words are letters with one mark of punctuation at most at
    their end, not all in capitals."""

    size: int
    words: int
    distinct: int
    symbols: int
    capitals: int
    plain: int
    ends: int
    shouted: int
    marked: int
    bars: int
    top: int
    runs: int
    lines: int
    distinct_lines: int

    @classmethod
    def of(cls, raw: bytes, words: list[bytes], counts: Counter) -> Facts:
        count = lambda some: len(raw) - len(raw.translate(None, some))
        lines = [x for x in raw.split(b"\n") if x.strip()]
        plain = ends = shouted = marked = 0
        for w, c in counts.items():
            bare = w[:-1] if w[-1:] in b".,;:?!" else w
            if bare.isalpha() if bare.isascii() else bare.decode(errors="replace").isalpha():
                if len(bare) > 2 and bare.isupper():
                    shouted += c
                else:
                    plain += c
                    if w[-1:] in b".?!":
                        ends += c
            elif w[-3:] in _MARKS:
                marked += c
            elif w.isupper():
                shouted += c
        runs = sum(map(bytes.__eq__, words, words[1:]))
        return cls(len(raw), len(words), len(counts), count(_SYMBOLS), count(_CAPITALS), plain, ends, shouted, marked, counts.get(b"|", 0), max(counts.values(), default=0), runs, len(lines), len(set(lines)))


def _varied(f: Facts) -> bool:
    return f.words < 20 or (f.distinct > 0.25 * min(f.words, 2000) and f.runs < 0.1 * f.words)


def _vote(bad: bool, good: bool = False) -> int:
    return -1 if bad else 1 if good else 0


#: Every kind of bad text has labellers that overlap on it, which is what EM learns from; labellers say nothing between
#: their thresholds. Repetition counts from 20 words on.
LABELLERS: dict[str, Callable[[Facts], int]] = {
    "plain words": lambda f: _vote(f.plain < 0.6 * f.words or not f.words, f.plain > 0.85 * f.words and _varied(f)),
    "sentences": lambda f: _vote(f.words >= 60 and f.ends < 0.01 * f.words, f.ends > 0.02 * f.words and _varied(f)),
    "symbols": lambda f: _vote(f.symbols > 0.06 * f.size, f.symbols < 0.02 * f.size and f.plain > 0.7 * f.words and _varied(f)),
    "marked words": lambda f: _vote(f.marked > 0.15 * f.words),
    "capitals": lambda f: _vote(f.capitals > 0.25 * f.size and f.words > 3),
    "shouted words": lambda f: _vote(f.shouted > 0.3 * f.words and f.words > 3),
    "bars": lambda f: _vote(f.bars > 0.1 * f.words and f.words > 3),
    "variety": lambda f: _vote(f.words >= 20 and f.distinct < 0.2 * min(f.words, 2000)),
    "top word": lambda f: _vote(f.words >= 20 and f.top > 0.2 * f.words),
    "runs": lambda f: _vote(f.words >= 20 and f.runs > 0.2 * f.words),
    "lines": lambda f: _vote(f.lines > 4 and f.distinct_lines < 0.5 * f.lines),
}


def votes_of(facts: Facts) -> tuple[int, ...]:
    return tuple(rule(facts) for rule in LABELLERS.values())


def look(text: str | None, bits: int = BITS) -> tuple[Facts, np.ndarray, np.ndarray]:
    """Facts, hashed features and their values: words and shapes, each of length one."""
    raw = (text or "").encode()
    words = raw.split()
    counts = Counter(words)
    facts = Facts.of(raw, words, counts)
    mask, crc = (1 << bits) - 1, zlib.crc32
    shapes: Counter = Counter()
    for w, c in counts.items():
        shapes[w.translate(_SHAPE)[-4:]] += c
    ids = np.array([crc(w.lower(), 1) & mask for w in counts] + [crc(s, 2) & mask for s in shapes], dtype=np.int64)
    values = np.fromiter([*counts.values(), *shapes.values()], np.float64, len(ids))
    k = len(counts)
    for part in (values[:k], values[k:]):
        part /= max(1.0, float(np.sqrt(part @ part)))
    return facts, ids, values


def pattern(votes: tuple[int, ...]) -> str:
    return "".join("-0+"[v + 1] for v in votes)


@dataclass
class Labels:
    """Share of good texts, accuracy of each labeller's votes, and the posterior of good for each pattern seen."""

    prior: float
    accuracy: dict[str, float]
    posterior: dict[str, float]


def weigh(patterns: dict[str, int], rounds: int = 200, faith: float = 0.9, votes_of_faith: float = 20.0) -> Labels:
    """EM over pattern counts: a vote is right with its labeller's accuracy, whichever the class, and votes are
    independent given the class; not voting says nothing.

    Accuracies start at ``faith`` and are drawn to it by so many votes; they stay above one half. A pattern is one of
    3 ** labellers at most, whatever the number of documents. No patterns: prior one half.
    """
    names = sorted(patterns)
    counts = np.array([patterns[p] for p in names], dtype=np.float64)
    votes = np.array([["-0+".index(c) - 1 for c in p] for p in names], dtype=np.int64).reshape(len(names), len(LABELLERS))
    accuracy, prior = np.full(len(LABELLERS), faith), 0.8
    good = np.zeros(len(names))
    for _ in range(rounds if len(names) else 0):
        odds = votes @ np.log(accuracy / (1 - accuracy)) + np.log(prior / (1 - prior))
        fresh = 1 / (1 + np.exp(-odds))
        if np.abs(fresh - good).max() < 1e-9:
            break
        good = fresh
        voted = counts @ (votes != 0)
        right = (counts * good) @ (votes == 1) + (counts * (1 - good)) @ (votes == -1)
        accuracy = np.clip((right + faith * votes_of_faith) / (voted + votes_of_faith), 0.55, 0.999)
        prior = float(np.clip((counts @ good + 8) / (counts.sum() + 10), 0.01, 0.99))
    return Labels(prior if len(names) else 0.5, dict(zip(LABELLERS, accuracy.tolist(), strict=True)), dict(zip(names, good.tolist(), strict=True)))


def train(rows: list[tuple[np.ndarray, np.ndarray, float]], bits: int = BITS, epochs: int = EPOCHS, seed: int = 0) -> tuple[np.ndarray, float]:
    """Logistic weights and bias from (features, values, probability of good) by stochastic gradients, AdaGrad steps."""
    weights, sums, bias, bias_sum = np.zeros(1 << bits), np.full(1 << bits, 1e-6), 0.0, 1e-6
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            ids, values, truth = rows[k]
            error = 1 / (1 + np.exp(-np.clip(weights[ids] @ values + bias, -30, 30))) - truth
            step = error * values
            np.add.at(sums, ids, step * step)
            np.add.at(weights, ids, -0.2 * step / np.sqrt(sums[ids]))
            bias_sum += error * error
            bias -= 0.2 * error / np.sqrt(bias_sum)
    return weights, float(bias)


def vote(docs: DataFrame) -> DataFrame:
    """doc_id and ``votes``, one character (+, 0, -) per labeller, of whole texts (null: empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            made = []
            for t in rows.column("text"):
                raw = (t.as_py() or "").encode()
                words = raw.split()
                made.append(pattern(votes_of(Facts.of(raw, words, Counter(words)))))
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(made, pa.string())], names=["doc_id", "votes"])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, votes string")


def sample_rows(docs: DataFrame, labels: Labels, total: int, size: int, bits: int) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """Features and posteriors of at most ``size`` documents: the only rows the driver sees.

    They are the smallest by a hash of doc_id and text, so rows without doc_id and repeated ids are sampled like others;
    a repeated row counts once. A threshold from the table's size thins the rows before features are made.
    """
    share = 1.5 * size / max(1, total)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("draw", F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 1))
    picked = rows.filter(F.col("draw") / F.lit(2.0**63) < share).groupBy("draw").agg(F.min("text").alias("text"))
    posterior = labels.posterior

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            made = [look(t.as_py(), bits) for t in rows.column("text")]
            truth = [posterior.get(pattern(votes_of(f)), labels.prior) for f, _, _ in made]
            columns = [rows.column("draw"), pa.array([i for _, i, _ in made], pa.list_(pa.int32())), pa.array([v for _, _, v in made], pa.list_(pa.float32())), pa.array(truth, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=["draw", "ids", "values", "truth"])

    made = map_arrow(picked, run, "draw long, ids array<int>, values array<float>, truth double").orderBy("draw").limit(size).toArrow()
    return [(np.array(i, np.int64), np.array(v, np.float64), t) for i, v, t in zip(made["ids"].to_pylist(), made["values"].to_pylist(), made["truth"].to_pylist(), strict=True)]


def classify(docs: DataFrame, sample: int = SAMPLE, bits: int = BITS, least: float = 0.5) -> DataFrame:
    """doc_id, votes, posterior, score, good for every row of ``docs``.

    ``posterior`` is the weak-label model's probability of good, ``score`` the linear scorer's, ``good`` whether the score
    reaches ``least``. Null counts as empty; a text without words has no features and scores by the bias; repeated rows
    are judged alike. Only doc_id and text are read; an empty table gives no rows.
    """
    voted = stage(vote(docs).groupBy("votes").count(), "votes")
    patterns = {r["votes"]: r["count"] for r in voted.collect()}  # at most 3 ** labellers rows
    labels = weigh(patterns)
    weights, bias = train(sample_rows(docs, labels, sum(patterns.values()), sample, bits), bits)
    posterior, prior = labels.posterior, labels.prior

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            votes, scores = [], []
            for t in rows.column("text"):
                facts, ids, values = look(t.as_py(), bits)
                votes.append(pattern(votes_of(facts)))
                scores.append(float(1 / (1 + np.exp(-np.clip(weights[ids] @ values + bias, -30, 30)))))
            columns = [pa.array(votes, pa.string()), pa.array([posterior.get(v, prior) for v in votes]), pa.array(scores, pa.float64()), pa.array([s >= least for s in scores], pa.bool_())]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), *columns], names=["doc_id", "votes", "posterior", "score", "good"])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, votes string, posterior double, score double, good boolean")
