"""Near-duplicates of a given similarity by wide SimHash fingerprints and anchor-point covering, checked exactly.

Fingerprints of operator 5 are 64 bits wide and link at 2 bits; texts that share four fifths of their shingles differ in
some 10 of 64, where balls around anchors would cover most of the space. So here a text has a wide fingerprint, cut into
bands of 23 bits. The anchors of a band are the 4,096 words of the perfect binary Golay code (covering radius 3): a band
goes to the homes of all words within distance 1, so texts whose bands differ in 2 bits or fewer in any band meet at an
anchor, and many that differ in more. Texts that meet are compared by 192 bits; the closest are linked, and every link is
then checked against the two sets of shingles. Larger tables take more bands with ``extra`` bits that must be equal.

A link that fails its check may have stood for a pair that would pass: forests leave out pairs that they connect otherwise.
So clusters of links in which a failed one still parts two groups (texts of one template are such) are compared whole: their
sets of shingles, in chunks of like size, meet in pairs of chunks, and products of matrices count what each two share.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, maybe_broadcast, numbered, own, row_id, stage
from .components import components

SHINGLE, SIMILARITY = 5, 0.8
#: Bits of a band that the code covers, bands at the smallest size, and the fingerprints that should meet at an anchor.
COVERED, BANDS, BUCKET = 23, 8, 2048
#: A text at similarity 0.8 keeps a bit with this probability, so a band with one more bit is met so much less often.
KEEP = 0.85
#: 64-bit words compared where texts meet, bits that may differ in all of them and in the first.
COMPARED, MOST, MOST_FIRST = 3, 46, 26
#: Rows that one task compares at an anchor; more are compared in pairs of chunks.
CAP = 4096
#: Edge-disjoint forests of closest pairs that are handed to the exact check.
FORESTS = 2
#: Texts of a chunk that is compared whole (fewer of more than ``CHUNK_SHINGLES``), and columns of a matrix.
CHUNK_BITS, CHUNK_SHINGLES, SLAB = 9, 12, 4096
_MIX = np.uint64(0x9E3779B97F4A7C15)
_SHINGLES_AT_ONCE = 1 << 15


def shape(n: int) -> tuple[int, int, int]:
    """Extra bits, bands and 64-bit words for ``n`` texts: buckets stay near BUCKET, and the chance to meet stays."""
    extra = max(0, math.ceil(math.log2(max(1, n) * 5.3 / 4096 / BUCKET)))
    bands = math.ceil(BANDS / KEEP**extra)
    return extra, bands, max(COMPARED, -(-bands * (COVERED + extra) // 64))


def shingles(text: str | None, length: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``length`` words (A-Z lower-cased); fewer words: the whole sequence."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    ids = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    k = min(length, len(words))
    h = np.full(len(words) - k + 1, k, np.uint64)
    for j in range(k):
        h = (h ^ ids[j : len(words) - k + 1 + j]) * _MIX
        h ^= h >> np.uint64(29)
    return np.unique(h)


def fingerprint(hashes: np.ndarray, words: int) -> np.ndarray:
    """``words`` 64-bit words; a bit is 1 if it is set in over half of the shingles' hashes, mixed anew for each word."""
    ones = np.zeros(64 * words, np.int64)
    seeds = np.arange(1, words + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)
    step = max(1, _SHINGLES_AT_ONCE // words)
    for k in range(0, len(hashes), step):
        mixed = (hashes[k : k + step, None] ^ seeds) * np.uint64(0xBF58476D1CE4E5B9)
        mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
        mixed ^= mixed >> np.uint64(30)
        ones += np.unpackbits(mixed.astype("<u8").view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")


@cache
def golay() -> tuple[np.ndarray, np.ndarray]:
    """Remainders of all 23-bit words' bytes by the generator polynomial, and the error of weight 3 at most of each."""

    def remainder(x: int) -> int:
        for k in range(22, 10, -1):
            if x >> k & 1:
                x ^= 0b110001110101 << (k - 11)
        return x

    tables = np.array([[remainder(b << 8 * k) if b << 8 * k < 1 << 23 else 0 for b in range(256)] for k in range(3)], np.int64)
    errors = np.zeros(1 << 11, np.int64)
    bits = [1 << k for k in range(23)]
    for a in bits:
        for b in bits:
            for c in bits:
                word = a | b | c  # equal bits give the errors of weight 1 and 2
                errors[remainder(word)] = word
    return tables, errors


def homes(words: np.ndarray) -> np.ndarray:
    """(n, 24): anchors (12-bit numbers of code words) nearest to each 23-bit word and to its 23 neighbours."""
    tables, errors = golay()
    near = words[:, None] ^ np.append(0, 1 << np.arange(23, dtype=np.int64))
    rest = tables[0][near & 255] ^ tables[1][near >> 8 & 255] ^ tables[2][near >> 16]
    return (near ^ errors[rest]) >> 11


def sketches(docs: DataFrame, words: int, length: int = SHINGLE) -> DataFrame:
    """id, digest, size (distinct shingles) and fp (``words`` longs) of whole texts of ``docs`` (id, digest, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            sets = [shingles(t.as_py(), length) for t in rows.column("text")]
            fps = np.array([fingerprint(s, words) for s in sets], np.uint64).reshape(-1).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * words), pa.array(fps))
            yield pa.RecordBatch.from_arrays([rows.column("id"), rows.column("digest"), pa.array([len(s) for s in sets], pa.int64()), lists], names=["id", "digest", "size", "fp"])

    return map_arrow(docs.select("id", "digest", "text"), run, "id long, digest long, size long, fp array<long>")


def replicas(nodes: DataFrame, extra: int, bands: int) -> DataFrame:
    """(key, node, size, a, b, c) for every anchor of every band of ``nodes``; a, b, c are the words that are compared."""
    width = COVERED + extra
    powers = 1 << np.arange(width, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                rows = batch.slice(k, 1024)
                fps = rows.column("fp").flatten().to_numpy().reshape(rows.num_rows, -1)
                bits = np.unpackbits(fps.astype("<i8").view(np.uint8), axis=1, bitorder="little")[:, : bands * width].reshape(-1, bands, width)
                values = (bits @ powers).reshape(-1)
                anchors = np.sort(homes(values & ((1 << COVERED) - 1)), axis=1)
                fresh = np.ones(anchors.shape, bool)
                fresh[:, 1:] = anchors[:, 1:] != anchors[:, :-1]
                at, column = np.nonzero(fresh)
                key = ((at % bands).astype(np.int64) << (12 + extra) | anchors[at, column] << extra) | values[at] >> COVERED
                at //= bands
                taken = pa.array(at)
                yield pa.RecordBatch.from_arrays([pa.array(key), rows.column("node").take(taken), rows.column("size").take(taken), *(pa.array(fps[at, j]) for j in range(COMPARED))], names=["key", "node", "size", "a", "b", "c"])

    return map_arrow(nodes.select("node", "size", "fp"), run, "key long, node long, size long, a long, b long, c long")


def closest(sizes: np.ndarray, fps: np.ndarray, similarity: float) -> np.ndarray:
    """Pairs of rows that may be similar, as forests of closest pairs: every group that links of at most MOST bits connect
    is connected, by its closest links first. ``sizes`` ascend; ``fps`` is (n, COMPARED)."""
    n = len(sizes)
    pairs, bits, found = [], [], 0
    for a in range(0, n, 256):
        b = min(n, a + 256)
        top = int(np.searchsorted(sizes, sizes[b - 1] / similarity + 1e-9, side="right"))
        first = np.bitwise_count(fps[a:b, :1] ^ fps[a:top, 0]) <= MOST_FIRST
        i, j = np.nonzero(first)
        take = j > i
        i, j = i[take] + a, j[take] + a
        d = np.bitwise_count(fps[i] ^ fps[j]).sum(axis=1, dtype=np.int64)
        take = (d <= MOST) & (sizes[i] >= similarity * sizes[j] - 1e-9)
        pairs.append(np.column_stack([i[take], j[take]]))
        bits.append(d[take])
        found += int(take.sum())
        if found > 16 * n:
            return _grown(sizes, fps, similarity)
    edges, weights = np.concatenate(pairs or [np.zeros((0, 2), np.int64)]), np.concatenate(bits or [np.zeros(0, np.int64)])
    parents = [list(range(n)) for _ in range(FORESTS)]
    out = []
    for i, j in edges[np.argsort(weights, kind="stable")].tolist():
        for parent in parents:
            a, b = i, j
            while parent[a] != a:
                parent[a] = a = parent[parent[a]]
            while parent[b] != b:
                parent[b] = b = parent[parent[b]]
            if a != b:
                parent[b] = a
                out.append((i, j))
                break
    return np.array(out, np.int64).reshape(-1, 2)


def _grown(sizes: np.ndarray, fps: np.ndarray, similarity: float) -> np.ndarray:
    """One forest of closest pairs where there are too many to list: trees grow by the row that is nearest to them.

    One forest connects what two do, and ``settled`` finds what it left out, so no pair is lost by it.
    """
    n = len(sizes)
    best, source, left = np.full(n, 255, np.int64), np.full(n, -1), np.ones(n, bool)
    out = []
    for _ in range(n):
        at = int(np.argmin(np.where(left, best, 256)))
        if source[at] >= 0:
            out.append((source[at], at))
        left[at] = False
        d = np.bitwise_count(fps ^ fps[at]).sum(axis=1, dtype=np.int64)
        near = left & (d <= MOST) & (d < best) & (np.minimum(sizes, sizes[at]) >= similarity * np.maximum(sizes, sizes[at]) - 1e-9)
        best[near], source[near] = d[near], at
    return np.array(out, np.int64).reshape(-1, 2)


def candidates(nodes: DataFrame, extra: int, bands: int, similarity: float = SIMILARITY, cap: int = CAP) -> DataFrame:
    """Distinct links (u, v) between ``nodes`` (node, size, fp) that meet at an anchor and may be similar.

    An anchor with more than ``cap`` rows is compared in pairs of chunks, each a group of its own, so nothing is left out
    and no task holds more than about ``cap`` rows of one anchor; the work grows with the square of its chunks.
    """
    made = replicas(nodes, extra, bands)
    hot = stage(made.groupBy("key").count().filter(F.col("count") > cap).select("key", F.ceil(F.col("count") * 2 / cap).cast("int").alias("chunks")), "similar-hot")
    zero = F.lit(0)
    spread = made.withColumn("i", zero).withColumn("j", zero)
    if hot.limit(1).count():
        own_chunk = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
        both = F.transform(F.sequence(zero, F.col("chunks") - 1), lambda k: F.struct(F.least(own_chunk, k).alias("i"), F.greatest(own_chunk, k).alias("j")))
        alone = F.array(F.struct(zero.alias("i"), zero.alias("j")))
        dealt = made.join(maybe_broadcast(hot), "key", "left").withColumn("pair", F.explode(F.when(F.col("chunks").isNull(), alone).otherwise(both)))
        spread = dealt.select(*made.columns, "pair.i", "pair.j")
    names = ["key", "i", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        at = None

        def linked() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).combine_chunks()
            node, size = rows["node"].to_numpy(), rows["size"].to_numpy()
            order = np.lexsort((node, size))
            fps = np.column_stack([rows[c].to_numpy()[order] for c in "abc"]).view(np.uint64)
            found = node[order][closest(size[order], fps, similarity)] if len(node) > 1 else np.zeros((0, 2), np.int64)
            return pa.RecordBatch.from_arrays([pa.array(found.min(axis=1, initial=2**63 - 1)), pa.array(found.max(axis=1, initial=-1))], names=["u", "v"])

        for batch in batches:
            keys = np.column_stack([batch.column(c).to_numpy() for c in names])
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)], strict=True):
                if s == e:
                    continue
                if at is not None and tuple(keys[s]) != at:
                    yield linked()
                    held = []
                at = tuple(keys[s])
                held.append(batch.slice(s, e - s))
        if held:
            yield linked()

    met = map_arrow(spread.repartition(*names).sortWithinPartitions(*names), run, "u long, v long")
    return met.distinct()


def _sets(links: DataFrame, nodes: DataFrame, docs: DataFrame, length: int) -> DataFrame:
    """node and set (its distinct shingles) of the texts that ``links`` name; only those are cut into shingles again."""
    asked = links.select(F.col("u").alias("node")).union(links.select("v")).distinct().join(nodes, "node").select("node", "id", "digest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            sets = [shingles(t.as_py(), length).view(np.int64) for t in rows.column("text")]
            yield pa.RecordBatch.from_arrays([rows.column("node"), pa.array(sets, pa.list_(pa.int64()))], names=["node", "set"])

    texts = docs.join(asked, ["id", "digest"]).dropDuplicates(["node"]).select("node", "text")
    return stage(map_arrow(texts, run, "node long, set array<long>"), "similar-sets")


def _passed(links: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """``links`` with ``good``, whether the sets of both ends share enough."""
    left, right = sets.select(F.col("node").alias("u"), F.col("set").alias("x")), sets.select(F.col("node").alias("v"), F.col("set").alias("y"))
    shared = F.size(F.array_intersect("x", "y"))
    enough = shared >= similarity * (F.size("x") + F.size("y") - shared) - 1e-9
    return links.join(left, "u").join(right, "v").select("u", "v", enough.alias("good"))


def checked(links: DataFrame, nodes: DataFrame, docs: DataFrame, similarity: float = SIMILARITY, length: int = SHINGLE) -> DataFrame:
    """Of ``links`` those whose texts have so large a share of common shingles (two texts without words count as equal).

    ``nodes``: node, id, digest; ``docs``: id, digest, text.
    """
    return _passed(links, _sets(links, nodes, docs, length), similarity).filter("good").select("u", "v")


def shared_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """(left, right): how many elements each two sets share, by products of 0/1 matrices over elements that occur twice."""
    values = np.concatenate([*left, *right]) if left or right else np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(left) + len(right)), [len(x) for x in (*left, *right)])
    _, column, number = np.unique(values, return_inverse=True, return_counts=True)
    often = number > 1
    place = np.cumsum(often) - 1
    row, column = row[often[column]], place[column[often[column]]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(left), len(right)), np.float32)
    for k in range(0, int(often.sum()), SLAB):
        a, b = np.searchsorted(column, [k, k + SLAB])
        dense = np.zeros((len(left) + len(right), SLAB), np.float32)
        dense[row[a:b], column[a:b] - k] = 1
        out += dense[: len(left)] @ dense[len(left) :].T
    return out


def forest(near: np.ndarray) -> list[tuple[int, int]]:
    """Edges (left, right) that connect what the true cells of ``near`` do."""
    out, new_left, new_right = [], np.ones(near.shape[0], bool), np.ones(near.shape[1], bool)
    for start in range(near.shape[0]):
        todo = [start] if new_left[start] else []
        new_left[start] = False
        while todo:
            k = todo.pop()
            if k >= 0:
                found = np.flatnonzero(near[k] & new_right)
                new_right[found] = False
                out += [(k, int(j)) for j in found]
                todo += [~int(j) for j in found]
            else:
                found = np.flatnonzero(near[:, ~k] & new_left)
                new_left[found] = False
                out += [(int(i), ~k) for i in found]
                todo += [int(i) for i in found]
    return out


def compared_whole(members: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Links (u, v) that connect what all pairs of similar ``members`` (cluster, node, set) of one cluster do, exactly.

    Members stand in chunks by size; chunks meet where their sizes can be of similar sets, each two as a group of its own.
    The work grows with the square of a cluster's chunks, spread over their pairs; no task holds more than two chunks.
    """
    sized = members.select(F.col("cluster").cast("string").alias("tree"), F.size("set").alias("size"), "node", "set")
    placed = numbered(sized, ["size", "node"])
    # Larger sets make smaller chunks: as many rows less by a power of two as their size class is over CHUNK_SHINGLES.
    level = F.greatest(F.lit(0), F.floor(F.log2(F.greatest(F.col("size"), F.lit(1)).cast("double"))).cast("int") - (CHUNK_SHINGLES - 1))
    step = F.greatest(F.lit(0), F.lit(CHUNK_BITS) - level)
    placed = placed.withColumn("chunk", F.concat_ws(".", level.cast("string"), F.floor(F.col("pos") / F.pow(F.lit(2.0), step)).cast("long").cast("string")))
    chunks = stage(placed.groupBy("tree", "chunk").agg(F.min("size").alias("low"), F.max("size").alias("high")), "similar-chunks")
    a, b = (chunks.select("tree", *[F.col(c).alias(f"{c}_{n}") for c in ("chunk", "low", "high")]) for n in "ab")
    ordered = (F.col("low_a") < F.col("low_b")) | ((F.col("low_a") == F.col("low_b")) & (F.col("chunk_a") <= F.col("chunk_b")))
    meets = a.join(b, "tree").filter(ordered & (F.col("high_a") >= similarity * F.col("low_b") - 1e-9)).select("tree", "chunk_a", "chunk_b")
    both = meets.select("*", F.col("chunk_a").alias("chunk"), F.lit(0).alias("side")).unionByName(meets.select("*", F.col("chunk_b").alias("chunk"), F.lit(1).alias("side")).filter("chunk_a <> chunk_b"))
    names = ["tree", "chunk_a", "chunk_b"]
    dealt = placed.select("tree", "chunk", "node", "set").join(both, ["tree", "chunk"]).select(*names, "side", "node", "set")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        at = None

        def linked() -> pa.RecordBatch:
            nodes: list[list[int]] = [[], []]
            sets: list[list[np.ndarray]] = [[], []]
            for rows in held:
                for k, (side, node) in enumerate(zip(rows.column("side").to_pylist(), rows.column("node").to_pylist(), strict=True)):
                    nodes[side].append(node)
                    sets[side].append(rows.column("set")[k].values.to_numpy())
            alone = at[1] == at[2]
            right_nodes, right = (nodes[0], sets[0]) if alone else (nodes[1], sets[1])
            shared = shared_counts(sets[0], right)
            total = np.array([len(x) for x in sets[0]])[:, None] + np.array([len(x) for x in right])[None, :]
            near = shared >= similarity * (total - shared) - 1e-9
            found = [(nodes[0][i], right_nodes[j]) for i, j in forest(near)]
            found = [(min(p), max(p)) for p in found if p[0] != p[1]]
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in range(2)], names=["u", "v"])

        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in names), strict=True))
            start = 0
            for k in range(1, len(keys) + 1):
                if k < len(keys) and keys[k] == keys[start]:
                    continue
                if at is not None and keys[start] != at:
                    yield linked()
                    held.clear()
                at = keys[start]
                held.append(batch.slice(start, k - start))
                start = k
        if held:
            yield linked()

    return map_arrow(dealt.repartition(*names).sortWithinPartitions(*names), run, "u long, v long").distinct()


def settled(links: DataFrame, sets: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(node, component) of what similar texts connect, ``links`` being forests of all pairs that may be similar.

    Links are checked; where a failed one leaves its ends apart, the forest's whole cluster is compared, as a pair that it
    left out may connect them. Elsewhere every pair that was left out lies in one component already.
    """
    known = stage(_passed(links, sets, similarity), "similar-checked")
    good = known.filter("good").select("u", "v")
    found = stage(components(good), "similar-found")
    of = lambda end: found.select(F.col("node").alias(end), F.col("component").alias(f"of_{end}"))
    ends = [F.coalesce(f"of_{e}", e) for e in ("u", "v")]
    failed = known.filter("not good").select("u", "v").join(of("u"), "u", "left").join(of("v"), "v", "left")
    # Groups stand for their texts, however many links lead from one to another.
    parted = failed.select(F.least(*ends).alias("u"), F.greatest(*ends).alias("v")).filter("u <> v").distinct()
    parted = stage(parted, "similar-open")
    if not parted.limit(1).count():
        return found
    # Components name every node but the least of each.
    whole = lambda parts: parts.unionByName(parts.select(F.col("component").alias("node"), "component").distinct())
    clusters = stage(whole(components(parted)).select(F.col("node").alias("of"), F.col("component").alias("cluster")), "similar-clusters")
    grouped = whole(found)
    members = grouped.withColumnRenamed("component", "of").join(clusters, "of").select("node", "cluster")
    alone = clusters.withColumnRenamed("of", "node").join(grouped.select("node"), "node", "left_anti").select("node", "cluster")
    members = stage(members.unionByName(alone), "similar-members")
    # Of two there is one pair, and it failed.
    torn = members.groupBy("cluster").count().filter("count > 2").select("cluster")
    members = members.join(torn, "cluster").select("node", "cluster").join(sets, "node")
    more = stage(compared_whole(members, similarity), "similar-more")
    return components(good.unionByName(more))


def representatives(docs: DataFrame, similarity: float = SIMILARITY, length: int = SHINGLE) -> DataFrame:
    """id, digest and copies (rows with its digest) of the text that stands for each group of ``docs`` (id, digest, text): the
    one with the smallest id, then digest. Groups are what links of at least ``similarity`` connect."""
    extra, bands, words = shape(docs.count())
    rows = sketches(docs, words, length)
    # Equal texts are one node, so copies never make pairs; a node's least row stands for it.
    least = F.min(F.struct("id", "digest")).alias("least")
    grouped = rows.groupBy("digest", "size", "fp").agg(least, F.count(F.lit(1)).alias("copies")).withColumn("node", F.monotonically_increasing_id())
    nodes = stage(grouped.select("node", "size", "fp", "least.id", "digest", "copies"), "similar-nodes")
    links = stage(candidates(nodes, extra, bands, similarity), "similar-links")
    found = settled(links, _sets(links, nodes.select("node", "id", "digest"), docs, length), similarity)
    roots = nodes.select("node", "id", "digest", "copies").join(found, "node", "left").withColumn("root", F.coalesce("component", "node"))
    return roots.groupBy("root").agg(F.min(F.struct("id", "digest", "copies")).alias("k")).select("k.*")


def keep_first(docs: DataFrame, similarity: float = SIMILARITY, length: int = SHINGLE) -> DataFrame:
    """One row of each group of near-duplicates of ``docs``, the one with the smallest doc_id, with all its columns.

    Groups are connected by texts whose sets of ``length``-word shingles (A-Z lower-cased; fewer words: the whole text) have
    a Jaccard similarity of at least ``similarity``; every link is checked exactly, and what fingerprints find of them is a
    recall, not a guarantee (the tests hold it against brute force). Rows are matched by doc_id and the text's digest, so
    texts that share a doc_id stand for their own groups. Rows without doc_id stay where their group has none with one; of
    repeated rows one stays. Texts without words form one group. Only doc_id and text are read; other columns may have any
    name; an empty table gives no rows.
    """
    key, digest = own(docs, "near_id"), own(docs, "near_digest")
    numbered = docs.withColumn(key, row_id(F.col("doc_id"), F.col("text"))).withColumn(digest, F.xxhash64(F.coalesce("text", F.lit(""))))
    texts = numbered.select(F.col(key).cast("long").alias("id"), F.col(digest).alias("digest"), F.col("text"))
    kept = stage(representatives(texts, similarity, length).select(F.col("id").alias("near_kept_id"), F.col("digest").alias("near_kept_digest"), "copies"), "similar-kept")
    same = (F.col(f"d.{key}") == F.col("k.near_kept_id")) & (F.col(f"d.{digest}") == F.col("k.near_kept_digest"))
    out = numbered.alias("d").join(kept.alias("k"), same, "left_semi")
    again = kept.filter("copies > 1").limit(1).count()
    return (out.dropDuplicates([key, digest]) if again else out).select(*[F.col(f"`{c}`") for c in docs.columns])
