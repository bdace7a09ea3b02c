"""Byte-pair encoding and decoding of whole texts by a ``tokenizers`` file's merges, without that library's merging.

A text is cut at special tokens, then into words by the vocabulary's pattern (``tokens`` has it for plain Latin; other texts
are cut by the library's own pre-tokenizer), and each word is merged here. Short words hold their part boundaries and the
ranks of adjacent parts in contiguous arrays: the least rank is found by a scan, its boundary deleted, and the ranks on both
sides refreshed. A scan a merge is quadratic, so words beyond ``SHORT`` bytes merge all places of one rank at once, rank by
rank, over linked arrays: a word of megabytes stays linear in memory and takes seconds.
"""

from __future__ import annotations

import heapq
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_arrow
from .tokens import _LETTERS, _OTHER, KINDS, Words

#: Bytes up to which a word is merged by scans.
SHORT = 600
#: Characters of texts that are cut into words together.
CHARS_AT_ONCE = 1 << 20
_SHIFT, _NEVER = 32, 1 << 62
_VALUE = {c: b for b, c in enumerate(_LETTERS)}
_loaded: dict[str, Bpe] = {}


def _letter_bytes(token: str) -> bytes:
    """The bytes a token stands for; a token with a character that stands for no byte is its own text."""
    values = [_VALUE.get(c) for c in token]
    return token.encode() if None in values else bytes(values)


class Bpe:
    """Vocabulary, merges by rank, words seen, and bytes by id of one file. Truncation and padding are not used."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            stored = json.load(file)
        vocab: dict[str, int] = stored["model"]["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in stored["model"]["merges"]]
        self.byte_ids = np.array([vocab[c] for c in _LETTERS], dtype=np.int64)
        self.left = np.array([vocab[a] for a, _ in merges], dtype=np.int64)
        self.right = np.array([vocab[b] for _, b in merges], dtype=np.int64)
        self.joined = np.array([vocab[a + b] for a, b in merges], dtype=np.int64)
        codes = (self.left << _SHIFT) | self.right
        self.pairs = {c: r for r, c in enumerate(codes.tolist())}
        self.joined_list, self.byte_list = self.joined.tolist(), self.byte_ids.tolist()
        self.by_code = np.argsort(codes, kind="stable")
        self.codes = codes[self.by_code]
        made = np.full(max(vocab.values()) + 1, -1)
        made[self.joined] = np.arange(len(merges))
        if len(merges) and not (np.maximum(made[self.left], made[self.right]) < np.arange(len(merges))).all():
            raise ValueError(f"{path}: a merge comes before what it merges")
        added = {t["content"]: t["id"] for t in stored.get("added_tokens", [])}
        self.added = added
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.pattern, fold = KINDS[os.path.basename(path)]
        if fold:
            raise ValueError(f"{path}: a vocabulary that folds case is not byte-level")
        self.cutter = Tokenizer.from_file(path).pre_tokenizer
        texts = {i: _letter_bytes(t) for t, i in vocab.items()} | {i: t.encode() for t, i in added.items()}
        # One more, empty, for ids that no token has.
        self.texts = [texts.get(i, b"") for i in range(max(texts) + 2)]
        self.words = Words(self.word)

    def word(self, word: str) -> bytes:
        """Ids of one word as int32 bytes."""
        raw = word.encode()
        return (self.scan(raw) if len(raw) <= SHORT else self.by_rank(raw)).astype("<i4").tobytes()

    def scan(self, raw: bytes) -> np.ndarray:
        """Merges by repeated scans over the ranks of adjacent parts."""
        get, joined = self.pairs.get, self.joined_list
        parts = [self.byte_list[b] for b in raw]
        bounds = list(range(len(raw) + 1))
        ranks = [get((a << _SHIFT) | b, _NEVER) for a, b in zip(parts, parts[1:])]
        while ranks and (least := min(ranks)) != _NEVER:
            at = ranks.index(least)
            parts[at] = joined[least]
            del bounds[at + 1], parts[at + 1], ranks[at]
            if at:
                ranks[at - 1] = get((parts[at - 1] << _SHIFT) | parts[at], _NEVER)
            if at < len(ranks):
                ranks[at] = get((parts[at] << _SHIFT) | parts[at + 1], _NEVER)
        assert len(bounds) == len(parts) + 1
        return np.array(parts, dtype=np.int64)

    def _ranks(self, ids: np.ndarray, after: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Ranks of the pairs that begin at ``at``; ``_NEVER`` where there is no merge."""
        code = (ids[at] << _SHIFT) | ids[after[at]]
        place = np.minimum(np.searchsorted(self.codes, code), max(len(self.codes) - 1, 0))
        found = (self.codes[place] == code) & (after[at] < len(ids) - 1)
        return np.where(found, self.by_code[place], _NEVER)

    def by_rank(self, raw: bytes) -> np.ndarray:
        """All places of the least rank at once, then of the next.

        A merge makes parts that only later merges take up, so the places of a rank are complete when its turn comes; of
        equal parts in a row the first two merge, then the next two, as one by one from the left.
        """
        n = len(raw)
        ids = np.append(self.byte_ids[np.frombuffer(raw, dtype=np.uint8)], -1)
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        waiting: dict[int, list[np.ndarray]] = {}
        queue: list[int] = []

        def wait(at: np.ndarray) -> None:
            ranks = self._ranks(ids, after, at)
            at, ranks = at[ranks != _NEVER], ranks[ranks != _NEVER]
            order = np.argsort(ranks, kind="stable")
            at, ranks = at[order], ranks[order]
            for part in np.split(np.arange(len(at)), np.flatnonzero(np.diff(ranks)) + 1) if len(at) else []:
                rank = int(ranks[part[0]])
                if rank not in waiting:
                    heapq.heappush(queue, rank)
                waiting.setdefault(rank, []).append(at[part])

        wait(np.arange(n))
        while queue:
            rank = heapq.heappop(queue)
            at = np.unique(np.concatenate(waiting.pop(rank)))
            left, right = self.left[rank], self.right[rank]
            at = at[(ids[at] == left) & (after[at] < n)]
            at = at[ids[after[at]] == right]
            if left == right and len(at):
                starts = np.append(True, after[at[:-1]] != at[1:])
                first = np.maximum.accumulate(np.where(starts, np.arange(len(at)), 0))
                at = at[(np.arange(len(at)) - first) % 2 == 0]
            gone = after[at]
            ids[at], ids[gone] = self.joined[rank], -1
            after[at] = after[gone]
            before[after[at]] = at
            wait(np.unique(np.concatenate([at, before[at][before[at] >= 0]])))
        return ids[:-1][ids[:-1] >= 0]

    def cut(self, text: str) -> list[str]:
        """Words of a text without special tokens."""
        if _OTHER.search(text):
            return [text[a:b] for _, (a, b) in self.cutter.pre_tokenize_str(text)]
        return self.pattern.findall(text)

    def encode(self, text: str | None) -> bytes:
        """Ids of a text as int32 bytes; null is empty."""
        if not text:
            return b""
        self.words.age()
        get = self.words.__getitem__
        if self.special is None or not self.special.search(text):
            return b"".join(map(get, self.cut(text)))
        out = []
        for piece in self.special.split(text):
            if piece in self.added:
                out.append(np.int32(self.added[piece]).astype("<i4").tobytes())
            elif piece:
                out.append(b"".join(map(get, self.cut(piece))))
        return b"".join(out)

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: their bytes joined, those that are no UTF-8 replaced; ids of no token give nothing."""
        last = len(self.texts) - 1
        known = np.where((ids >= 0) & (ids < last), ids, last)
        return b"".join(map(self.texts.__getitem__, known.tolist())).decode("utf-8", "replace")


def bpe(path: str) -> Bpe:
    """One per path and Python worker."""
    if path not in _loaded:
        _loaded[path] = Bpe(path)
    return _loaded[path]


def _portions(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Runs of rows of at most ``CHARS_AT_ONCE`` together, or of one row."""
    start, held = 0, 0
    for k, size in enumerate(sizes):
        if k > start and held + size > CHARS_AT_ONCE:
            yield start, k
            start, held = k, 0
        held += size
    if sizes:
        yield start, len(sizes)


def encode(docs: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of ``docs`` and ``ids``, the token ids (array of int) of the whole ``text``.

    Null and empty texts have no ids; equal texts have equal ids; an empty table gives no rows. Other columns are not read.
    """
    kept = docs.select(*keep)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = bpe(path)
        for batch in batches:
            texts = batch.column(len(keep))
            for a, b in _portions(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
                coded = [tool.encode(t) for t in texts.slice(a, b - a).to_pylist()]
                ends = np.cumsum([0, *(len(c) // 4 for c in coded)], dtype=np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(coded), dtype="<i4")))
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns[:-1]), ids], names=[*keep, "ids"])

    text = F.col("text").cast("string").alias("text")
    return map_arrow(docs.select(*keep, text), run, f"{schema}, ids array<int>")


def decode(coded: DataFrame, path: str) -> DataFrame:
    """``coded`` with ``decoded``, the text of its ``ids``, special tokens kept; null ids give an empty text."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in coded.schema)
    at = coded.columns.index("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = bpe(path)
        for batch in batches:
            ids = batch.column(at)
            for a, b in _portions(pc.multiply(pc.fill_null(pc.list_value_length(ids), 0), 4).to_pylist()):
                texts = [tool.decode(x.values.to_numpy(zero_copy_only=False)) if x.is_valid else "" for x in ids.slice(a, b - a)]
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns), pa.array(texts, pa.string())], names=[*batch.schema.names, "decoded"])

    return map_arrow(coded, run, f"{schema}, decoded string")


def decimal(ids: Column) -> Column:
    """Decimal ids joined by commas."""
    return F.concat_ws(",", ids.cast("array<string>"))


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, and the SHA-256 of the decimal ids and of the text decoded from them, for every row of ``docs``.

    Null texts count as empty; rows that repeat have a row each; an empty table gives no rows.
    """
    back = decode(encode(docs, path), path)
    return back.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(decimal(F.col("ids")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
