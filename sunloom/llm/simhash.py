"""SimHash near-duplicates by anchor-point covering.

Anchors are the words of a binary code of length 64. Every fingerprint lies within the code's covering radius of an
anchor, its home. Two fingerprints at distance 2 have a fingerprint between them at distance 1 from both, so both lie
within covering radius plus 1 of that one's home; replicating each fingerprint to all anchors that are home to something
within distance 1 therefore brings every pair to an anchor where it is compared. (Replicating only one side would need
covering radius plus the whole threshold, and several times the rows.)

The codes hold the first-order Reed-Muller code of length 64 (covering radius 28) and, for more fingerprints, cosets of
it by quadratic forms Tr(a x^9) and Tr(b x^3) over GF(64), which only lowers the radius. Distances to all words of a coset
come from one fast Walsh-Hadamard transform.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, stage
from .components import components

SEED, SHINGLE, THRESHOLD = 42, 3, 2
#: Shingles hashed at a time, so one very long text needs little memory.
BLOCK = 1 << 16
#: Cosets of the first-order code by number of fingerprints: up to the first number, so many; buckets stay near 2,000.
#: The last code has 65,536 anchors, so beyond some 1e8 fingerprints its buckets grow with them (as ``cap`` below does).
SIZES = ((80_000, 1), (500_000, 8), (4_000_000, 64), (None, 512))
#: Fingerprints compared at one anchor; larger buckets take the exact way around. It grows so that the list of larger
#: buckets never has more than MAX_HOT entries.
BUCKET, MAX_HOT = 8192, 50_000


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """A bit is 1 if it is set in over half of the shingles' XXH64 values; no words: 0."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    if len(words) < shingle:
        starts, ends = starts[:1], ends[-1:]
    else:
        starts, ends = starts[: len(words) - shingle + 1], ends[shingle - 1 :]
    ones = np.zeros(64, dtype=np.int64)
    for k in range(0, len(starts), BLOCK):
        hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts[k : k + BLOCK].tolist(), ends[k : k + BLOCK].tolist(), strict=True)], dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and ``fp``, the fingerprint as a signed long, of whole texts (null: empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            made = np.array([fingerprint(t.as_py(), shingle) for t in rows.column("text")], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(made.view(np.int64))], names=["doc_id", "fp"])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, fp long")


@cache
def coset_leaders(n: int) -> np.ndarray:
    """``n`` words (a power of two up to 512) whose sums with the first-order Reed-Muller code make the code; 0 is first."""
    power, x = [], 1
    for _ in range(63):
        power.append(x)
        x = (x << 1) ^ (0x43 if x & 32 else 0)  # x^6 + x + 1
    log = {p: k for k, p in enumerate(power)}

    def times(a: int, b: int) -> int:
        return power[(log[a] + log[b]) % 63] if a and b else 0

    def trace(a: int) -> int:
        total = 0
        for _ in range(6):
            total ^= a
            a = times(a, a)
        return total

    def form(a: int, exponent: int) -> int:
        return sum(trace(times(a, power[exponent * log[x] % 63])) << x for x in range(1, 64)) if a else 0

    words = [0]
    for form_word in [*(form(1 << k, 9) for k in range(6)), *(form(1 << k, 3) for k in range(6))]:
        if form_word not in words:  # Tr(a x^9) has three independent forms, Tr(b x^3) six
            words += [w ^ form_word for w in words]
    if n > len(words) or n & (n - 1):
        raise ValueError(f"no code with {n} cosets")
    return np.array(words[:n], dtype=np.uint64)


def walsh(fps: np.ndarray) -> np.ndarray:
    """(n, 64): agreements less disagreements of each fingerprint with each linear form."""
    bits = np.unpackbits(fps.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    a = 1 - 2 * bits.astype(np.int8)
    step = 1
    while step < 64:
        b = a.reshape(len(fps), -1, 2, step)
        a = np.concatenate([b[:, :, :1] + b[:, :, 1:], b[:, :, :1] - b[:, :, 1:]], axis=2).reshape(len(fps), 64)
        step *= 2
    return a


def anchors(fps: np.ndarray, cosets: int, block: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of ``fps`` and the anchors each goes to: homes of all that lies within distance 1.

    All words of these codes have even weight, so distances from one fingerprint have one parity. With ``d`` the least,
    a flipped bit can bring an anchor at ``d`` to ``d - 1`` or one at ``d + 2`` level with the nearest at ``d + 1``; the home
    among equals is the smallest anchor, so of those at ``d + 2`` only anchors below the nearest's number qualify.
    """
    leaders, block = coset_leaders(cosets), max(1, block // cosets)
    rows, names = [], []
    for k in range(0, len(fps), block):
        part = fps[k : k + block]
        sums = walsh((part[:, None] ^ leaders).reshape(-1)).reshape(len(part), cosets, 64)
        signs = np.concatenate([sums, -sums], axis=2).reshape(len(part), -1)
        best = signs.max(axis=1, keepdims=True)
        home = signs.argmax(axis=1)[:, None]
        near = (signs == best) | ((signs >= best - 4) & (np.arange(signs.shape[1]) < home))
        r, a = np.nonzero(near)
        rows.append(r + k)
        names.append(a)
    return np.concatenate(rows or [np.zeros(0, np.int64)]), np.concatenate(names or [np.zeros(0, np.int64)])


def replicas(fps: DataFrame, cosets: int, skip: frozenset[int] | None = None, only: frozenset[int] | None = None) -> DataFrame:
    """(anchor, fp) for each of ``fps``; ``skip``: anchors left out, ``only``: no others."""
    chosen = np.array(sorted(skip or only or ()), dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            part = rows.column("fp").to_numpy(zero_copy_only=False)
            at, names = anchors(part.view(np.uint64), cosets)
            if skip or only is not None:
                take = np.isin(names, chosen, invert=only is None)
                at, names = at[take], names[take]
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(part[at])], names=["anchor", "fp"])

    return map_arrow(fps.select("fp"), run, "anchor long, fp long")


def spanning_links(fps: np.ndarray, threshold: int = THRESHOLD) -> list[tuple[int, int]]:
    """Links among distinct ``fps`` that connect exactly what links of at most ``threshold`` bits connect, one fewer
    than the members of each cluster at most.

    Of two fingerprints within the threshold, one of threshold + 1 parts of the bits agrees; rows are grouped by each
    part in turn. Small groups are compared by offsets, all groups at once; a large group is walked breadth first, each
    member once against those not reached yet.
    """
    parent = list(range(len(fps)))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    out: list[tuple[int, int]] = []

    def link(i: int, j: int) -> None:
        a, b = find(i), find(j)
        if a != b:
            parent[max(a, b)] = min(a, b)
            out.append((i, j))

    parts = threshold + 1
    cuts = [64 * k // parts for k in range(parts + 1)]
    for low, high in zip(cuts, cuts[1:], strict=False):
        keys = (fps >> np.uint64(low)) & np.uint64((1 << (high - low)) - 1)
        order = np.argsort(keys, kind="stable")
        sorted_keys, values = keys[order], fps[order]
        starts = np.flatnonzero(np.r_[True, sorted_keys[1:] != sorted_keys[:-1]])
        sizes = np.diff(np.r_[starts, len(fps)])
        small = np.repeat(sizes <= 16, sizes)
        for offset in range(1, min(16, int(sizes.max(initial=1)))):
            same = (sorted_keys[offset:] == sorted_keys[:-offset]) & small[offset:]
            i = np.flatnonzero(same)
            i = i[np.bitwise_count(values[i] ^ values[i + offset]) <= threshold]
            for a, b in zip(order[i].tolist(), order[i + offset].tolist(), strict=True):
                link(a, b)
        for s, n in zip(starts[sizes > 16].tolist(), sizes[sizes > 16].tolist(), strict=True):
            left = order[s : s + n]
            queue: list[int] = []
            while len(left):
                if not queue:
                    queue, left = [int(left[0])], left[1:]
                at = queue.pop()
                near = np.bitwise_count(fps[left] ^ fps[at]) <= threshold
                for other in left[near].tolist():
                    link(at, other)
                    queue.append(other)
                left = left[~near]
    return out


def links_at_anchors(spread: DataFrame, cap: int) -> DataFrame:
    """Links (u, v) found at each anchor; ``spread``: (anchor, fp), no anchor with more than ``cap`` rows.

    Rows come sorted by anchor and a task holds one anchor's fingerprints at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        at = None

        def links(parts: list[np.ndarray]) -> pa.RecordBatch:
            fps = np.unique(np.concatenate(parts))
            pairs = np.array(spanning_links(fps), dtype=np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(fps[pairs[:, 0]].view(np.int64)), pa.array(fps[pairs[:, 1]].view(np.int64))], names=["u", "v"])

        for rows in batches:
            names = rows.column("anchor").to_numpy(zero_copy_only=False)
            fps = rows.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            for s in np.split(np.arange(len(names)), np.flatnonzero(names[1:] != names[:-1]) + 1) if len(names) else ():
                if at is not None and names[s[0]] != at:
                    yield links(held)
                    held = []
                at = names[s[0]]
                held.append(fps[s].copy())
        if held:
            yield links(held)

    return map_arrow(spread.repartition("anchor").sortWithinPartitions("anchor"), run, "u long, v long")


def links_by_variants(fps: DataFrame) -> DataFrame:
    """Links among ``fps`` without anchors: each goes to itself and its 64 words at distance 1; those that meet are linked
    to the smallest there. A word has 65 neighbours at most, so no group is large, however close the fingerprints are."""
    masks = F.array(*[F.lit(0).cast("long")], *[F.shiftleft(F.lit(1).cast("long"), k) for k in range(64)])
    spread = fps.select("fp", F.explode(masks).alias("mask")).select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("word"))
    met = spread.groupBy("word").agg(F.collect_set("fp").alias("fps")).filter(F.size("fps") > 1)
    return met.select(F.array_min("fps").alias("v"), F.explode("fps").alias("u")).filter("u <> v").select("u", "v")


def near_links(fps: DataFrame, n: int, bucket: int = BUCKET) -> DataFrame:
    """Links among ``fps`` (fp, distinct, ``n`` rows) that connect all within 2 bits of each other."""
    cosets = next(c for limit, c in SIZES if limit is None or n <= limit)
    counts = stage(replicas(fps, cosets).groupBy("anchor").count(), "anchor-counts")
    # There are at most 128 * cosets = 65,536 anchors, and of those no more than rows / cap are larger than cap.
    total = counts.agg(F.sum("count")).first()[0] or 0
    cap = max(bucket, total // MAX_HOT)
    hot = frozenset(r["anchor"] for r in counts.filter(F.col("count") > cap).select("anchor").toLocalIterator())
    links = links_at_anchors(replicas(fps, cosets, skip=hot), cap)
    if hot:
        links = links.unionByName(links_by_variants(replicas(fps, cosets, only=hot).select("fp").distinct()))
    return links


def grouped(rows: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """fp and component_id (smallest doc_id reachable) of the fingerprints of ``rows``."""
    nodes = stage(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-nodes")
    n = nodes.count()
    found = components(near_links(nodes, n, bucket))
    joined = nodes.join(found, nodes["fp"] == found["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    joined = stage(joined, "simhash-roots")
    roots = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    return joined.join(roots, "root").select("fp", "component_id")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, bucket: int = BUCKET) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable), one row per row of ``docs``.

    Texts link when their fingerprints differ in 2 bits or fewer. Equal fingerprints are one node, so copies never make
    pairs. Null and empty texts have fingerprint zero, linked like any other; repeated rows stay; rows without doc_id get
    their component's smallest id, null where no row has one. Only doc_id and text are read.
    """
    rows = stage(fingerprints(docs, shingle), "simhash")
    named = grouped(rows, bucket)
    return rows.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
