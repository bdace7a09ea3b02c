"""Language of whole texts by a bidirectional gated recurrent network over bytes, trained in numpy.

A text is lower-cased, encoded as UTF-8 and cut into windows of ``WINDOW`` bytes, each read from both ends. Every byte gets
a distribution over the languages; a text's is their mean over its letters' bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow

UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")
HIDDEN, WINDOW = 8, 48
#: Windows that step through the network together.
LANES = 8192
#: Texts a language gives to training, and bytes of each, and steps of training.
TEXTS, TEXT_BYTES, STEPS, BATCH = 400, 1536, 700, 256
#: Languages learnt at most, the most frequent ones.
LANGUAGES = 256
#: Bytes that count in a document's pool: ASCII letters and all of non-ASCII characters.
_POOLED = np.array([chr(b).isalpha() if b < 128 else True for b in range(256)])


def key(doc_id: Column) -> Column:
    """CRC-32 of the doc_id as text; null counts as empty."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


@dataclass
class Network:
    """One direction after the other: ``inputs`` (2, 256, 3H), ``states`` (2, H, 3H), ``out`` (2H, n), ``bias`` (n)."""

    languages: list[str]
    inputs: np.ndarray
    states: np.ndarray
    out: np.ndarray
    bias: np.ndarray

    @classmethod
    def fresh(cls, languages: list[str], hidden: int = HIDDEN, seed: int = 0) -> Network:
        rng = np.random.default_rng(seed)
        draw = lambda *shape, by: rng.normal(0, by, shape).astype(np.float32)
        n = len(languages)
        return cls(languages, draw(2, 256, 3 * hidden, by=0.3), draw(2, hidden, 3 * hidden, by=0.3), draw(2 * hidden, n, by=0.3), np.zeros(n, np.float32))

    def params(self) -> list[np.ndarray]:
        return [self.inputs, self.states, self.out, self.bias]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    x *= 0.5
    np.tanh(x, out=x)
    x *= 0.5
    x += 0.5
    return x


def _run(net: Network, side: int, codes: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
    """States (T, H, B) after each byte of ``codes`` (T, B); with ``keep``, also what the backward pass needs."""
    table, weight = net.inputs[side], np.ascontiguousarray(net.states[side].T)
    hidden = weight.shape[1]
    h = np.zeros((hidden, codes.shape[1]), np.float32)
    out = np.empty((len(codes), hidden, codes.shape[1]), np.float32)
    saved = []
    for t, code in enumerate(codes):
        x = np.ascontiguousarray(table[code].T)
        g = weight @ h
        gates = x[: 2 * hidden]
        gates += g[: 2 * hidden]
        _sigmoid(gates)
        reset, update = gates[:hidden], gates[hidden:]
        fresh = x[2 * hidden :]
        fresh += reset * g[2 * hidden :]
        np.tanh(fresh, out=fresh)
        if keep:
            saved.append((h, reset, update, fresh, g[2 * hidden :]))
        h = h + update * (fresh - h)
        out[t] = h
    return out, saved


def label(net: Network, codes: np.ndarray) -> np.ndarray:
    """Probabilities (T, B, n) of the language at every position of windows ``codes`` (T, B)."""
    there, _ = _run(net, 0, codes)
    back, _ = _run(net, 1, codes[::-1])
    return softmax(net, there, back[::-1])


def softmax(net: Network, there: np.ndarray, back: np.ndarray) -> np.ndarray:
    hidden = there.shape[1]
    a, b = np.ascontiguousarray(net.out[:hidden].T), np.ascontiguousarray(net.out[hidden:].T)
    scores = a @ there + b @ back + net.bias[:, None]
    scores -= scores.max(axis=1, keepdims=True)
    np.exp(scores, out=scores)
    scores /= scores.sum(axis=1, keepdims=True)
    return scores


def gradients(net: Network, codes: np.ndarray, truth: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean cross-entropy over all positions and its gradients by backpropagation through time."""
    there, kept0 = _run(net, 0, codes, keep=True)
    back, kept1 = _run(net, 1, codes[::-1], keep=True)
    p = softmax(net, there, back[::-1])
    steps, width = codes.shape
    hidden = there.shape[1]
    hit = p[:, truth, np.arange(width)]
    loss = float(-np.log(hit + 1e-9).mean())
    p[:, truth, np.arange(width)] -= 1
    p /= steps * width
    d_out = np.concatenate([np.einsum("thb,tnb->hn", there, p), np.einsum("thb,tnb->hn", back[::-1], p)])
    d_bias = p.sum(axis=(0, 2))
    d_inputs, d_states = np.zeros_like(net.inputs), np.zeros_like(net.states)
    for side, kept, order in ((0, kept0, codes), (1, kept1, codes[::-1])):
        into = net.out[side * hidden : (side + 1) * hidden]
        errors = p if side == 0 else p[::-1]
        d_h = np.zeros((hidden, width), np.float32)
        for t in range(steps - 1, -1, -1):
            h, reset, update, fresh, inner = kept[t]
            d_h = d_h + into @ errors[t]
            d_update = d_h * (fresh - h) * update * (1 - update)
            d_fresh = d_h * update * (1 - fresh * fresh)
            d_reset = d_fresh * inner * reset * (1 - reset)
            d_x = np.concatenate([d_reset, d_update, d_fresh])
            d_g = np.concatenate([d_reset, d_update, d_fresh * reset])
            np.add.at(d_inputs[side], order[t], d_x.T)
            d_states[side] += h @ d_g.T
            d_h = d_h * (1 - update) + net.states[side] @ d_g
    return loss, [d_inputs, d_states, d_out, d_bias]


def as_bytes(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode(), np.uint8)


def train(samples: list[tuple[str, str]], steps: int = STEPS, seed: int = 0) -> Network:
    """A network from (text, language) pairs; batches hold windows of every language in equal numbers (Adam)."""
    languages = sorted({lang for _, lang in samples})
    net = Network.fresh(languages, seed=seed)
    if len(languages) < 2:
        return net
    rng = np.random.default_rng(seed)
    texts = [[as_bytes(t)[:TEXT_BYTES] for t, lang in samples if lang == name] for name in languages]
    texts = [[np.pad(t, (0, max(0, WINDOW - len(t))), constant_values=32) for t in some] for some in texts]
    first, second = [np.zeros_like(w) for w in net.params()], [np.zeros_like(w) for w in net.params()]
    truth = np.arange(BATCH) % len(languages)
    for step in range(1, steps + 1):
        codes = np.empty((WINDOW, BATCH), np.uint8)
        for k, n in enumerate(truth):
            text = texts[n][rng.integers(len(texts[n]))]
            at = rng.integers(len(text) - WINDOW + 1)
            codes[:, k] = text[at : at + WINDOW]
        _, grads = gradients(net, codes, truth)
        rate = 0.02 * (1 - step / (steps + 1))
        for w, g, m, v in zip(net.params(), grads, first, second, strict=True):
            m += 0.1 * (g - m)
            v += 0.002 * (g * g - v)
            w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.998**step)) + 1e-8)
    return net


def predict(net: Network, texts: list[str | None]) -> list[tuple[str, float]]:
    """Language and pooled probability of whole texts; ``und`` and 0 for null texts, texts without letters, no languages.

    Of equal probabilities the language first by name is taken.
    """
    out: list[tuple[str, float]] = [(UNKNOWN, 0.0)] * len(texts)
    asked = [k for k, t in enumerate(texts) if t is not None and LETTER.search(t)]
    if not asked or not net.languages:
        return out
    n = len(net.languages)
    pooled, weight = np.zeros((len(asked), n)), np.zeros(len(asked))
    arrays = [as_bytes(texts[k]) for k in asked]
    owners = np.repeat(np.arange(len(asked)), [-(-len(a) // WINDOW) for a in arrays])
    # Windows of all texts side by side; a text's last window is filled with spaces, which no pool counts.
    padded = [np.pad(a, (0, -len(a) % WINDOW), constant_values=32) for a in arrays]
    windows = np.concatenate(padded).reshape(-1, WINDOW)
    for k in range(0, len(windows), LANES):
        part = windows[k : k + LANES]
        p = label(net, np.ascontiguousarray(part.T))
        count = _POOLED[part]
        sums = np.einsum("tnb,bt->bn", p, count.astype(np.float32))
        np.add.at(pooled, owners[k : k + LANES], sums)
        np.add.at(weight, owners[k : k + LANES], count.sum(axis=1))
    pooled /= np.maximum(weight, 1)[:, None]
    for k, row in zip(asked, pooled, strict=True):
        best = int(row.argmax())
        out[k] = (net.languages[best], float(min(1.0, row[best])))
    return out


def training_sample(docs: DataFrame, texts: int = TEXTS, most: int = LANGUAGES) -> list[tuple[str, str]]:
    """A passage of TEXT_BYTES bytes of at most ``texts`` texts of each language, from the training rows.

    Rows qualify by a hash of doc_id and text, so rows without doc_id and repeated ids are sampled like others; of those
    under a threshold that the language's count sets, the ``texts`` smallest are taken, a repeated row once. A second hash
    places the passage. The sample is bounded by ``texts`` and ``most``, the number of languages (the most frequent ones),
    whatever the table holds, and is the same in every run.
    """
    rows = docs.filter((key(F.col("doc_id")) % 4 != 2) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    rows = rows.select(F.col("lang").cast("string").alias("lang"), F.col("text"), F.xxhash64("doc_id", "text").alias("draw"))
    counts = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most)
    share = F.lit(2.0 * texts) / F.col("count")
    chosen = F.shiftrightunsigned("draw", 1) / F.lit(2.0**63) < share
    start = F.pmod(F.xxhash64("draw", F.lit(1)), F.greatest(F.octet_length("text") - TEXT_BYTES, F.lit(0)) + 1).cast("int") + 1
    passage = F.substring(F.encode("text", "utf-8"), start, F.lit(TEXT_BYTES))
    picked = rows.join(F.broadcast(counts), "lang").filter(chosen).groupBy("lang", "draw").agg(F.min(passage).alias("passage"))
    first = Window.partitionBy("lang").orderBy(F.shiftrightunsigned("draw", 1), "draw")
    picked = picked.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= texts).orderBy("lang", "rank")
    cut = [(bytes(r["passage"]).decode(errors="ignore"), r["lang"]) for r in picked.collect()]
    return [(text, lang) for text, lang in cut if LETTER.search(text)]


def fit(docs: DataFrame, texts: int = TEXTS, steps: int = STEPS) -> Network:
    return train(training_sample(docs, texts), steps)


def identify(docs: DataFrame, net: Network) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (the language's pooled probability), per row of (doc_id, text).

    Repeated rows are predicted alike; only doc_id and text are read, so other columns may have any name and any nulls.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            made = predict(net, rows.column("text").to_pylist())
            columns = [pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.float64())]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), *columns], names=["doc_id", "lang_pred", "score"])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, lang_pred string, score double")


def languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document, learnt from those not held out (needs doc_id, text, lang).

    Repeated rows are predicted alike, and a tie goes to the language first by name. Null texts and texts without letters
    are ``und`` with score 0; so is all where no training row has a language. A null doc_id counts as the empty text in the
    split. Further columns are not read; an empty table gives no rows.
    """
    made = identify(docs, fit(docs))
    return made.select("doc_id", (key(F.col("doc_id")) % 4 == 2).alias("held_out"), "lang_pred", "score")


def keep_known(docs: DataFrame, least: float = 0.35) -> DataFrame:
    """Rows of ``docs`` with a language: those without letters and those no language reaches ``least`` in go.

    All columns stay. The prediction runs beside the row, so nothing is joined.
    """
    net = fit(docs)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            made = predict(net, rows.column("text").to_pylist())
            yield rows.filter(pa.array([lang != UNKNOWN and score >= least for lang, score in made], pa.bool_()))

    return map_arrow(docs, run, docs.schema).select(*names)
