"""Language-model scores from subword lattices.

A word's lattice holds every way to cut its bytes into pieces of an existing vocabulary (its single bytes are pieces too).
Piece scores start from the vocabulary's own and are re-estimated on the training words by expectation-maximisation; a
forward recursion in log space sums over all segmentations. The one public vocabulary with scores gives ranks (they fall by
one a piece), so a piece starts with weight 1 / (100 + rank), as frequencies fall with ranks.

Pieces are fixed in number, so what they learn does not grow with a corpus. ``score`` is therefore the marginal of a larger
lattice: a word seen in training has one more arc, from its first node to its last, which weighs its discounted relative
frequency; what discounting frees weighs the paths of pieces. A document's words are drawn from these marginals through a
Polya urn of strength ``URN``: a word that a document has used becomes likelier in it. ``lattice_score`` is the marginal of
pieces alone, without words of the corpus and urn.

Texts are read once, in blocks of documents: each becomes the numbers of its words in its block, and the block's words and
their counts come beside them. So a word crosses the shuffle once a block, not once a document, and its probability comes
back to its number; no task ever holds the vocabulary of the corpus. A word's lattice is summed once for the corpus.
"""

from __future__ import annotations

import math
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bucket_count, map_arrow, stage

#: Rows and bytes after which a block ends. A block's distinct words, and its words as numbers, are held by one task.
BLOCK_ROWS, BLOCK_BYTES = 4096, 12 << 20
#: Rows for each partition that blocks are dealt to: fewer than a block has, so partitions seldom hold several blocks.
DEALT_ROWS = 1024
#: Words whose lattices are summed together, rounds of re-estimation, strength of a document's urn.
WORDS_AT_ONCE, ROUNDS, URN = 60_000, 2, 1500.0
LOG10 = math.log(10)
#: Bytes beyond which a word is summed by itself, and its starts that are looked up at a time.
LONG, LONG_BLOCK = 2048, 1 << 16
_BASE = np.uint64(0x9E3779B97F4A7C15)


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 1


def is_training(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 5 != 1


def _hash(pieces: np.ndarray) -> np.ndarray:
    """Polynomial hashes of the rows of a byte matrix."""
    h = np.zeros(len(pieces), np.uint64)
    for k in range(pieces.shape[1]):
        h = h * _BASE + pieces[:, k] + np.uint64(1)
    return h


@dataclass
class Pieces:
    """Pieces by length, each length's hashes sorted; ``first`` and ``next`` are log probabilities of a piece at the
    start of a word and after another piece, ``stop`` that of ending a word after any piece."""

    hashes: list[np.ndarray]
    ids: list[np.ndarray]
    first: np.ndarray
    next: np.ndarray
    stop: float

    @classmethod
    def build(cls, initial: dict[bytes, float], inner: dict[bytes, float]) -> Pieces:
        """From weights of pieces that start a word and of those inside one; every byte gets a small weight in both."""
        names = sorted({*initial, *inner, *(bytes([b]) for b in range(256))}, key=lambda p: (len(p), p))
        hashes, ids = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for n in range(1, max(map(len, names)) + 1):
            at = np.array([k for k, p in enumerate(names) if len(p) == n], dtype=np.int64)
            h = _hash(np.frombuffer(b"".join(names[k] for k in at), np.uint8).reshape(-1, n)) if len(at) else np.zeros(0, np.uint64)
            order = np.argsort(h)
            hashes.append(h[order])
            ids.append(at[order])
        floor = 1e-6
        single = np.array([len(p) == 1 for p in names])
        weigh = lambda w: np.array([w.get(p, 0.0) for p in names]) / max(1e-300, sum(w.values())) + floor * single
        return cls(hashes, ids, *cls.scores(weigh(initial), weigh(inner), 1.0))

    @staticmethod
    def scores(first: np.ndarray, inner: np.ndarray, words: float) -> tuple[np.ndarray, np.ndarray, float]:
        """Log probabilities from (expected) counts of pieces at the start, inside, and of words ended."""
        with np.errstate(divide="ignore"):
            total = inner.sum() + words
            return np.log(first / first.sum()), np.log(inner / total), math.log(words / total)

    def arcs(self, words: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """For a matrix of words of one length: (start, end, rows, piece ids) of every piece found in any of them."""
        n, length = words.shape
        for i in range(length):
            h = np.zeros(n, np.uint64)
            for j in range(i + 1, min(length, i + len(self.hashes) - 1) + 1):
                h = h * _BASE + words[:, j - 1] + np.uint64(1)
                known = self.hashes[j - i]
                if not len(known):
                    continue
                at = np.searchsorted(known, h)
                at[at == len(known)] = 0
                rows = np.flatnonzero(known[at] == h)
                if len(rows):
                    yield i, j, rows, self.ids[j - i][at[rows]]

    def forward(self, words: np.ndarray) -> tuple[np.ndarray, list]:
        """Log marginals (n, length + 1) of every prefix, summed over all segmentations, and the arcs."""
        arcs = list(self.arcs(words))
        alpha = np.full((words.shape[1] + 1, len(words)), -np.inf)
        alpha[0] = 0
        for i, j, rows, ids in arcs:
            alpha[j, rows] = np.logaddexp(alpha[j, rows], alpha[i, rows] + (self.next if i else self.first)[ids])
        return alpha, arcs

    def spans(self, word: bytes, a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, piece id) of every piece that starts at ``a`` to ``b`` in a word, by start, then end."""
        longest = len(self.hashes) - 1
        data = np.frombuffer(word[a : b + longest], np.uint8)
        h, found = np.zeros(min(b - a, len(data)), np.uint64), []
        for n in range(1, longest + 1):
            h = h[: len(data) - n + 1]
            if not len(h):
                break
            h = h * _BASE + data[n - 1 : n - 1 + len(h)] + np.uint64(1)
            known = self.hashes[n]
            if len(known):
                at = np.searchsorted(known, h)
                at[at == len(known)] = 0
                start = np.flatnonzero(known[at] == h)
                found.append((a + start, a + start + n, self.ids[n][at[start]]))
        start, end, ids = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((end, start))
        return start[order], end[order], ids[order]

    def _blocks(self, word: bytes) -> range:
        return range(0, len(word), LONG_BLOCK)

    def long_forward(self, word: bytes) -> np.ndarray:
        """Log marginals of every prefix of one long word; its pieces are looked up a block of starts at a time."""
        alpha = [-math.inf] * (len(word) + 1)
        alpha[0], log, exp = 0.0, math.log, math.exp
        for a in self._blocks(word):
            start, end, ids = self.spans(word, a, min(a + LONG_BLOCK, len(word)))
            score = np.where(start > 0, self.next[ids], self.first[ids])
            for i, j, x in zip(start.tolist(), end.tolist(), score.tolist(), strict=True):
                x += alpha[i]
                now = alpha[j]
                if now == -math.inf:
                    alpha[j] = x
                elif x > -math.inf:
                    alpha[j] = x + log(1 + exp(now - x)) if x > now else now + log(1 + exp(x - now))
        return np.array(alpha)

    def long_expected(self, word: bytes, first: np.ndarray, inner: np.ndarray) -> None:
        """Add the expected uses of pieces in one long word: marginals of prefixes and suffixes, then all arcs of a block."""
        alpha = self.long_forward(word)
        beta = [-math.inf] * (len(word) + 1)
        beta[-1], log, exp = 0.0, math.log, math.exp
        for a in reversed(self._blocks(word)):
            start, end, ids = self.spans(word, a, min(a + LONG_BLOCK, len(word)))
            score = np.where(start > 0, self.next[ids], self.first[ids])
            for i, j, x in zip(start[::-1].tolist(), end[::-1].tolist(), score[::-1].tolist(), strict=True):
                x += beta[j]
                now = beta[i]
                if now == -math.inf:
                    beta[i] = x
                elif x > -math.inf:
                    beta[i] = x + log(1 + exp(now - x)) if x > now else now + log(1 + exp(x - now))
            # Suffixes from this block's starts on are complete now.
            use = np.exp(alpha[start] + score + np.array([beta[j] for j in end.tolist()]) - alpha[-1])
            inner += np.bincount(ids[start > 0], use[start > 0], len(inner))
            first += np.bincount(ids[start == 0], use[start == 0], len(first))

    def log_marginals(self, words: list[bytes]) -> np.ndarray:
        """Natural log probability of each word, its end included."""
        out = np.empty(len(words))
        for k in (k for k, w in enumerate(words) if len(w) > LONG):
            out[k] = self.long_forward(words[k])[-1] + self.stop
        for at, matrix in by_length(words):
            out[at] = self.forward(matrix)[0][-1] + self.stop
        return out

    def expected(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Expected uses of each piece at the start of and inside the words, by forward and backward recursion."""
        first, inner = np.zeros(len(self.first)), np.zeros(len(self.first))
        for word in words:
            if len(word) > LONG:
                self.long_expected(word, first, inner)
        for _, matrix in by_length(words):
            alpha, arcs = self.forward(matrix)
            beta = np.full_like(alpha, -np.inf)
            beta[-1] = 0
            for i, j, rows, ids in reversed(arcs):
                score = (self.next if i else self.first)[ids] + beta[j, rows]
                use = np.exp(alpha[i, rows] + score - alpha[-1, rows])
                (inner if i else first)[:] += np.bincount(ids, use, len(first))
                beta[i, rows] = np.logaddexp(beta[i, rows], score)
        return first, inner


def by_length(words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions and byte matrix of the words of each length up to LONG."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(lengths, kind="stable")
    order = order[lengths[order] <= LONG]
    for at in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1) if len(order) else ():
        n = int(lengths[at[0]])
        step = max(1, 4_000_000 // max(1, n * min(n, 16)))
        for k in range(0, len(at), step):
            part = at[k : k + step]
            yield part, np.frombuffer(b"".join([words[i] for i in part.tolist()]), np.uint8).reshape(-1, n)


def load_pieces(path: str) -> Pieces:
    """Pieces of a sentencepiece vocabulary; its scores fall by one a rank, so a piece weighs 1 / (100 - score)."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    initial: dict[bytes, float] = {}
    inner: dict[bytes, float] = {}
    for k in range(model.get_piece_size()):
        if model.is_control(k) or model.is_unknown(k) or model.is_byte(k) or model.is_unused(k):
            continue
        piece, weight = model.id_to_piece(k), 1 / (100 - model.get_score(k))
        starts = piece.startswith("▁")
        name = piece.lstrip("▁").encode().lower()
        if name and "▁" not in piece.lstrip("▁"):
            table = initial if starts else inner
            table[name] = max(weight, table.get(name, 0))
    for name, weight in inner.items():
        initial.setdefault(name, weight / 10)
    for name, weight in list(initial.items()):
        inner.setdefault(name, weight / 10)
    return Pieces.build(initial, inner)


@dataclass
class Model:
    """``pieces`` and what the training tokens count: all, distinct, ends, distinct words, the discount."""

    pieces: Pieces
    tokens: int
    distinct: int
    ends: int
    types: int
    discount: float

    def base(self, counts: np.ndarray | float) -> np.ndarray:
        return np.log10((counts + 0.5) / (self.tokens + 0.5 * (self.distinct + 1)))

    def end(self) -> float:
        return (self.ends + 0.5) / (self.tokens + 1)

    def words(self, counts: np.ndarray, log_pieces: np.ndarray) -> np.ndarray:
        """Log probability of words, given that the text goes on, at the last node of their lattice: the sum of the arc over
        the whole word, from its training count, and of the paths of pieces, from their log marginal."""
        if not self.types:
            return log_pieces
        seen = self.tokens - self.ends
        free = math.log(self.discount * self.types / seen)
        with np.errstate(divide="ignore"):
            whole = np.log(np.maximum(counts - self.discount, 0) / seen)
        return np.logaddexp(whole, free + log_pieces)


CODED = "block long, doc_id long, tokens binary, number int, word binary, n long"


def planes(numbers: np.ndarray) -> bytes:
    """32-bit numbers as their lowest bytes, then their next, and so on: high bytes are alike and compress."""
    return numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").reshape(-1)


def coded(docs: DataFrame) -> DataFrame:
    """Texts as numbers, and the words behind them, in one pass and one staged table of two kinds of rows.

    A document's row has block, doc_id and ``tokens``: its words' numbers in the block, as ``planes``. A word's row has
    block, number, word and ``n``, its uses in the block's training texts. A block ends by rows or bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, rows, held = TaskContext.get().partitionId() << 33, 0, 0
        numbers: defaultdict[bytes, int] = defaultdict()
        numbers.default_factory = numbers.__len__
        counts = np.zeros(0, np.int64)
        ready: list[tuple[int | None, bytes]] = []
        learnt: list[np.ndarray] = []

        def count() -> None:
            nonlocal counts
            counts = np.pad(counts, (0, len(numbers) - len(counts)))
            if learnt:
                counts += np.bincount(np.concatenate(learnt), minlength=len(numbers))
            learnt.clear()

        def documents() -> pa.RecordBatch:
            n = len(ready)
            columns = [pa.array([block] * n, pa.int64()), pa.array([d for d, _ in ready], pa.int64()), pa.array([t for _, t in ready], pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.int64())]
            ready.clear()
            count()
            return pa.RecordBatch.from_arrays(columns, names=names)

        def words() -> Iterator[pa.RecordBatch]:
            known = list(numbers)
            for k in range(0, len(known), 50_000):
                part = known[k : k + 50_000]
                m = len(part)
                columns = [pa.array([block] * m, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.binary()), pa.array(range(k, k + m), pa.int32()), pa.array(part, pa.binary()), pa.array(counts[k : k + m])]
                yield pa.RecordBatch.from_arrays(columns, names=names)

        names = [c.split()[0] for c in CODED.split(", ")]
        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                raw = (text.as_py() or "").encode()
                if rows and (rows >= BLOCK_ROWS or held + len(raw) > BLOCK_BYTES):
                    if ready:
                        yield documents()
                    yield from words()
                    block, rows, held, counts = block + 1, 0, 0, np.zeros(0, np.int64)
                    numbers.clear()
                found = raw.lower().split()
                tokens = np.fromiter(map(numbers.__getitem__, found), np.int32, len(found))
                if is_training(doc):
                    learnt.append(tokens)
                ready.append((doc, planes(tokens)))
                rows, held = rows + 1, held + len(raw)
            if ready:
                yield documents()
        yield from words()

    return stage(map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, CODED), "lattice-coded")


def count_words(uses: DataFrame) -> DataFrame:
    """Every word of the corpus once: word and ``c``, its uses in all training texts. Sums combine before they shuffle."""
    return stage(uses.groupBy("word").agg(F.sum("n").alias("c")), "lattice-counts")


def reestimate(words: DataFrame, pieces: Pieces) -> Pieces:
    """One round of expectation-maximisation over every distinct training word; tasks return sums by piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = inner = None
        n = 0
        for part in gathered(batches, "word"):
            a, b = pieces.expected(part)
            first, inner, n = (a, b, len(part)) if first is None else (first + a, inner + b, n + len(part))
        if n:
            used = np.flatnonzero((first > 1e-9) | (inner > 1e-9))
            ids = np.append(used, -1)
            columns = [pa.array(ids), pa.array(np.append(first[used], n)), pa.array(np.append(inner[used], n))]
            yield pa.RecordBatch.from_arrays(columns, names=["piece", "first", "inner"])

    made = map_arrow(words, run, "piece long, first double, inner double").groupBy("piece").agg(F.sum("first").alias("first"), F.sum("inner").alias("inner"))
    first, inner, n = np.full(len(pieces.first), 1e-3), np.full(len(pieces.first), 1e-3), 1.0
    for r in made.toLocalIterator():  # one row per piece of the vocabulary at most
        if r["piece"] < 0:
            n += r["first"]
        else:
            first[r["piece"]] += r["first"]
            inner[r["piece"]] += r["inner"]
    return Pieces(pieces.hashes, pieces.ids, *Pieces.scores(first, inner, n))


def gathered(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[list[bytes]]:
    held: list[bytes] = []
    for batch in batches:
        held += batch.column(column).to_pylist()
        if len(held) >= WORDS_AT_ONCE:
            yield held
            held = []
    if held:
        yield held


def lattices(words: DataFrame, pieces: Pieces) -> DataFrame:
    """``words`` (word, c) with ``log_pieces``, the log marginal of each word's lattice of pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, WORDS_AT_ONCE):
                part = batch.slice(k, WORDS_AT_ONCE)
                log = pieces.log_marginals(part.column("word").to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(log)], names=["word", "c", "log_pieces"])

    return map_arrow(words.select("word", "c"), run, "word binary, c long, log_pieces double")


def fit(words: DataFrame, ends: int, path: str, rounds: int = ROUNDS) -> Model:
    known = words.filter("c > 0")
    n, types, once, twice = known.agg(F.sum("c"), F.count(F.lit(1)), F.count_if(F.col("c") == 1), F.count_if(F.col("c") == 2)).first()
    pieces = load_pieces(path)
    for _ in range(rounds if types else 0):
        pieces = reestimate(known.select("word"), pieces)
    discount = min(0.95, max(0.1, once / (once + 2 * twice))) if once else 0.5
    return Model(pieces, (n or 0) + ends, types + (ends > 0), ends, types, discount)


SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, lattice_score double"


def block_scores(model: Model, tokens: list[bytes], counts: np.ndarray, log_pieces: np.ndarray, urn: float = URN) -> dict[str, np.ndarray]:
    """Columns for the documents of one block, from their words' numbers and what is known of each word."""
    lengths = np.array([len(t) // 4 for t in tokens], np.int64)
    ids = np.concatenate([from_planes(t) for t in tokens]).astype(np.int64)
    ends = np.cumsum(lengths)
    doc = np.repeat(np.arange(len(tokens)), lengths)
    # The k-th use of a word in a document, from 0: its place in the sorted order less that of its first use.
    order = np.argsort(doc * (len(counts) + 1) + ids, kind="stable")
    fresh = np.ones(len(ids), bool)
    fresh[1:] = (ids[order][1:] != ids[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    starts = np.flatnonzero(fresh)
    used = np.empty(len(ids), np.int64)
    used[order] = np.arange(len(ids)) - np.repeat(starts, np.diff(np.append(starts, len(ids))))
    before = np.arange(len(ids)) - np.repeat(ends - lengths, lengths)
    end = model.end()
    # A long word's probability is no double, so a first use stays in logarithms.
    prior = math.log(urn) + model.words(counts, log_pieces)[ids]
    with np.errstate(divide="ignore"):
        drawn = (np.logaddexp(prior, np.log(used)) - np.log(urn + before)) / LOG10 + math.log10(1 - end)
    total = lambda per_word: np.bincount(doc, per_word, len(tokens))
    return {
        "n_tokens": lengths + 1,
        "n_known": total((counts > 0)[ids]).astype(np.int64) + (model.ends > 0),
        "base_score": total(model.base(counts)[ids]) + model.base(model.ends),
        "score": total(drawn) + math.log10(end),
        "lattice_score": total(log_pieces[ids]) / LOG10 + lengths * math.log10(1 - end) + math.log10(end),
    }


def scores(docs: DataFrame, path: str) -> DataFrame:
    """Rows of SCHEMA for every document of ``docs`` (doc_id, text), learnt from those not held out.

    Null and empty texts are the end alone; repeated rows are scored each; a null doc_id counts as the empty text in the
    split. Tokens are words with A-Z lower-cased, then one end. ``score`` is the model's log10 probability of the whole
    text, ``lattice_score`` that of the pieces alone. An empty table gives no rows.
    """
    rows = coded(docs)
    texts = rows.filter(F.col("tokens").isNotNull()).select("block", "doc_id", "tokens")
    n, ends = texts.agg(F.count(F.lit(1)), F.count_if(~held_out(F.col("doc_id")))).first()
    uses = rows.filter(F.col("word").isNotNull()).select("block", "number", "word", "n")
    words = count_words(uses)
    model = fit(words, ends, path)
    # A word meets its sums by a join: a common word has one row a block on this side, and AQE splits a skewed partition.
    scored = uses.select(F.col("block").alias("of"), "number", "word").join(lattices(words, model.pieces), "word").select("of", "number", "c", "log_pieces")

    def block(texts: pa.Table, numbered: pa.Table) -> pa.Table:
        at = numbered.column("number").to_numpy()
        counts, log = np.empty(len(at), np.int64), np.empty(len(at))
        counts[at], log[at] = numbered.column("c").to_numpy(), numbered.column("log_pieces").to_numpy()
        doc_ids = texts.column("doc_id").to_pylist()
        made = block_scores(model, texts.column("tokens").to_pylist(), counts, log)
        made |= {"doc_id": texts.column("doc_id"), "held_out": [not is_training(d) for d in doc_ids], "train_tokens": np.full(len(doc_ids), model.tokens)}
        kinds = {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}
        fields = [pa.field(name, kinds[kind]) for name, kind in (c.split() for c in SCHEMA.split(", "))]
        return pa.table([made[f.name] if f.name == "doc_id" else pa.array(made[f.name], f.type) for f in fields], schema=pa.schema(fields))

    dealt = texts.repartition(bucket_count(docs.sparkSession, n, DEALT_ROWS), "block")
    return dealt.groupBy("block").cogroup(scored.groupBy("of")).applyInArrow(block, SCHEMA)
