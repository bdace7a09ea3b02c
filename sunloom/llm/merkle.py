"""A manifest of a table as hash trees: one tree of rows a group, one tree over the groups, and a proof for every row.

A node is the SHA-256 of up to ``fanout`` consecutive digests as hex text. Rows are numbered within their group by one range
sort, so a group that holds a third of all rows is spread over many tasks, and gathered in aligned blocks of at most
``BLOCK`` leaves; a block's leaves are one contiguous matrix of 64 hex bytes a row, hashed level by level after reshaping it
by the fanout. The blocks' tops are the leaves of the next round, until each tree has one node; from there proofs go down
again, and index arithmetic finds every node's siblings in the block's matrices.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, UPPER, map_arrow, numbered, stage

HEX = 64
#: Leaves of a block at most; a block has the largest power of the fanout that fits.
BLOCK = 4096
#: Proofs of at most so many nodes are made at a time.
AT_ONCE = 256
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PROOF = "array<struct<left: string, right: string>>"


def field(value: Column) -> Column:
    """``-`` for null, else the byte count in UTF-8, a colon, the value (integers in decimal)."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    """The digest of a row's values."""
    return F.sha2(F.concat(*map(field, values)).cast("binary"), 256)


def fold(digest: Column, proof: Column) -> Column:
    """The root that a leaf and its siblings give: who holds a manifest's root checks a row with this alone."""
    return F.aggregate(proof, digest, lambda node, step: F.sha2(F.concat(step["left"], node, step["right"]).cast("binary"), 256))


def siblings(proof: Column) -> Column:
    """All siblings of a proof as one text, level by level and left to right."""
    return F.array_join(F.transform(proof, lambda step: F.concat(step["left"], step["right"])), "")


def block_levels(fanout: int) -> int:
    levels = 1
    while fanout ** (levels + 1) <= BLOCK:
        levels += 1
    return levels


def height(nodes: int, fanout: int, most: int) -> int:
    """Levels that a block of a tree of ``nodes`` nodes gets: ``most``, or what makes one node of a small tree."""
    levels = 0
    while levels < most and fanout**levels < nodes:
        levels += 1
    return levels


def matrices(leaves: np.ndarray, fanout: int, levels: int) -> list[np.ndarray]:
    """The digests of every level as matrices of 64 hex bytes a row, ``leaves`` first."""
    out = [leaves]
    for _ in range(levels):
        below = out[-1]
        full = len(below) // fanout
        runs = list(below[: full * fanout].reshape(full, fanout * HEX)) + ([below[full * fanout :].reshape(-1)] if len(below) % fanout else [])
        text = "".join(hashlib.sha256(run).hexdigest() for run in runs)
        out.append(np.frombuffer(text.encode(), dtype=np.uint8).reshape(-1, HEX))
    return out


def sibling_ranges(counts: list[int], fanout: int, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of leaves ``at``: where their siblings begin in the matrices set on top of each other, and how many there are.

    Four arrays of (leaves, levels): first and number of those to the left, first and number of those to the right.
    """
    levels = len(counts) - 1
    base = np.cumsum([0, *counts[:-1]], dtype=np.int64)[:levels]
    node = at[:, None] // fanout ** np.arange(levels, dtype=np.int64)
    first = node - node % fanout
    end = np.minimum(first + fanout, np.array(counts[:levels], dtype=np.int64))
    return base + first, node - first, base + node + 1, end - node - 1


def _texts(matrix: np.ndarray, first: np.ndarray, number: np.ndarray) -> pa.Array:
    """A string for each range of rows of ``matrix``."""
    first, number = first.reshape(-1), number.reshape(-1)
    ends = np.cumsum(number)
    rows = np.repeat(first - (ends - number), number) + np.arange(ends[-1] if len(ends) else 0)
    offsets = np.append(0, ends * HEX).astype(np.int32)
    return pa.StringArray.from_buffers(len(first), pa.py_buffer(offsets), pa.py_buffer(matrix[rows].tobytes()))


def _matrix(texts: pa.Array) -> np.ndarray:
    """Strings of whole digests, one after the other, as rows of 64 bytes."""
    return np.frombuffer("".join(texts.to_pylist()).encode(), dtype=np.uint8).reshape(-1, HEX)


def _blocks(nodes: DataFrame, fanout: int) -> DataFrame:
    """tree, block, nodes, digests and what is kept of each leaf, in order: at most ``BLOCK`` leaves a row."""
    width = fanout ** block_levels(fanout)
    block = F.floor(F.col("pos") / width).cast("long").alias("block")
    rows = F.sort_array(F.collect_list(F.struct("pos", "digest", "kept"))).alias("rows")
    out = nodes.groupBy("tree", block).agg(F.first("nodes").alias("nodes"), rows)
    return out.select("tree", "block", "nodes", F.col("rows.digest").alias("digests"), F.col("rows.kept").alias("kept"))


def _tops(blocks: DataFrame, fanout: int) -> DataFrame:
    """The node at the top of each block, as a leaf of the next round."""
    most = block_levels(fanout)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tops = []
            for nodes, digests in zip(batch.column("nodes").to_pylist(), batch.column("digests"), strict=True):
                top = matrices(_matrix(digests.values), fanout, height(nodes, fanout, most))[-1]
                tops.append(top.tobytes().decode())
            yield pa.RecordBatch.from_arrays([batch.column("tree"), batch.column("block"), pa.array(tops, pa.string())], names=["tree", "pos", "digest"])

    tops = map_arrow(blocks.select("tree", "block", "nodes", "digests"), run, "tree string, pos long, digest string")
    return tops.withColumn("nodes", F.count(F.lit(1)).over(Window.partitionBy("tree"))).withColumn("kept", F.struct(F.lit(0).alias("none")))


def _climb(nodes: DataFrame, fanout: int) -> tuple[list[DataFrame], DataFrame]:
    """The blocks of each round, and (tree, digest) of the last node of each tree."""
    rounds = []
    while True:
        rounds.append(stage(_blocks(nodes, fanout), "merkle-blocks"))
        nodes = stage(_tops(rounds[-1], fanout), "merkle-tops")
        if not nodes.filter("nodes > 1").limit(1).count():
            return rounds, nodes.select("tree", "digest")


def _prove(blocks: DataFrame, above: DataFrame, fanout: int) -> DataFrame:
    """tree, pos, kept, digest and ``proof`` of every node of ``blocks``; ``above`` has the proofs of the blocks' tops."""
    kept = blocks.schema["kept"].dataType.elementType.simpleString()
    most = block_levels(fanout)
    width = fanout**most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {name: batch.column(name)[k] for name in ("nodes", "block", "digests", "kept", "proof")}
                levels = matrices(_matrix(row["digests"].values), fanout, height(row["nodes"].as_py(), fanout, most))
                counts = [len(m) for m in levels]
                upper = row["proof"].values
                left, right = upper.field("left"), upper.field("right")
                # Siblings further up are rows of the matrix too, the same for all nodes of the block.
                matrix = np.concatenate([*levels, _matrix(left), _matrix(right)])
                numbers = [np.array([len(t) // HEX for t in side.to_pylist()], dtype=np.int64) for side in (left, right)]
                starts = [sum(counts) + np.cumsum(numbers[0]) - numbers[0], sum(counts) + numbers[0].sum() + np.cumsum(numbers[1]) - numbers[1]]
                for a in range(0, counts[0], AT_ONCE):
                    at = np.arange(a, min(a + AT_ONCE, counts[0]))
                    own = sibling_ranges(counts, fanout, at)
                    wide = [np.concatenate([x, np.broadcast_to(y, (len(at), len(y)))], axis=1) for x, y in zip(own, (starts[0], numbers[0], starts[1], numbers[1]), strict=True)]
                    steps = pa.StructArray.from_arrays([_texts(matrix, wide[0], wide[1]), _texts(matrix, wide[2], wide[3])], names=["left", "right"])
                    proof = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * wide[0].shape[1]), steps)
                    same = np.full(len(at), k)
                    columns = [
                        batch.column("tree").take(pa.array(same)),
                        pa.array(row["block"].as_py() * width + at),
                        row["kept"].values.slice(a, len(at)),
                        row["digests"].values.slice(a, len(at)),
                        proof,
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names=["tree", "pos", "kept", "digest", "proof"])

    return map_arrow(blocks.join(above, ["tree", "block"]), run, f"tree string, pos long, kept {kept}, digest string, proof {PROOF}")


def _descend(rounds: list[DataFrame], proofs: DataFrame, fanout: int) -> DataFrame:
    """Proofs of all leaves from ``proofs`` (tree, proof) of the trees' last nodes."""
    above = proofs.withColumn("block", F.lit(0).cast("long"))
    for blocks in reversed(rounds[1:]):
        below = _prove(blocks, above, fanout)
        above = stage(below.select("tree", F.col("pos").alias("block"), "proof"), "merkle-proofs")
    return _prove(rounds[0], above, fanout)


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, by: str = "source", order: str = "doc_id", fanout: int = 16, also: dict[str, Column] | None = None) -> DataFrame:
    """One row per row of ``docs``: ``order``, ``by``, the columns ``also``, leaf, subroot (of its group ``by``), root, proof.

    A leaf is the digest of ``fields``. Within a group leaves ascend by ``order``, nulls first; rows of equal ``order`` by
    leaf, so the result does not depend on how the table lies; groups ascend by their UTF-8 bytes, null first. While a tree
    has several nodes, every ``fanout`` consecutive ones (fewer at the end, even one) become one. ``proof`` lists, level by
    level up to the root, the digests left and right of the row's node as text; ``fold`` checks it. Texts are read once, and
    only digests and ``also`` (computed from the row, small) move. Null texts differ from empty ones; rows that repeat have
    equal leaves and a proof each; other columns are not read; an empty table has no rows and no root.
    """
    if fanout < 2 or fanout > BLOCK:
        raise ValueError(f"fanout must be 2 to {BLOCK}, not {fanout}")
    extra = {"by": F.col(by).cast("string"), "order": F.col(order)} | {f"also{k}": c for k, c in enumerate((also or {}).values())}
    tree = F.coalesce(F.concat(F.lit("="), F.col(by).cast("string")), F.lit("")).alias("tree")
    kept = F.struct(*[c.alias(n) for n, c in extra.items()]).alias("kept")
    rows = docs.select(tree, kept, leaf(*[F.col(f) for f in fields]).alias("digest"), F.monotonically_increasing_id().alias("row"))
    rows = stage(rows, "merkle-leaves").withColumn("by", F.col("kept.order"))
    rounds, tops = _climb(numbered(rows, ["by", "digest", "row"]), fanout)
    groups = tops.select(F.lit("").alias("tree"), F.struct(F.col("tree").alias("member")).alias("kept"), "digest", F.col("tree").alias("member"))
    upper, root = _climb(numbered(groups, ["member"]), fanout)
    spark = docs.sparkSession
    start = spark.range(1).select(F.lit("").alias("tree"), F.array().cast(PROOF).alias("proof"))
    proven = stage(_descend(upper, start, fanout).select(F.col("kept.member").alias("tree"), "proof", F.col("digest").alias("subroot")), "merkle-groups")
    found = root.first()
    leaves = _descend(rounds, proven.select("tree", "proof"), fanout).join(proven.select("tree", "subroot"), "tree")
    names = [F.col(f"kept.also{k}").alias(n) for k, n in enumerate(also or {})]
    return leaves.select(
        F.col("kept.order").alias(order),
        F.col("kept.by").alias(by),
        *names,
        F.col("digest").alias("leaf"),
        "subroot",
        F.lit(found["digest"] if found else None).cast("string").alias("root"),
        "proof",
    )


def tamper_check(docs: DataFrame) -> DataFrame:
    """The manifest of ``docs`` with every proof's digest, and what folding finds where texts were tampered with.

    Where 5 divides the CRC of a decimal doc_id (never of a null one), the row's text has its A-Z lower-cased; such a row
    verifies only if that changes nothing.
    """
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, leaf(*[F.col(f) for f in FIELDS[:-1]], F.translate("text", UPPER, LOWER)))
    out = manifest(docs, also={"claimed": tampered})
    folded = fold(F.coalesce("claimed", "leaf"), F.col("proof"))
    out = out.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings(F.col("proof")).cast("binary"), 256).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


ORACLE = """
WITH RECURSIVE crc AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM range(256) r(i))),
f AS (
  SELECT doc_id, source, text,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
      || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
    xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS crc
  FROM documents, crc),
l AS (
  SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    CASE WHEN crc % 5 = 0 THEN sha256(head || coalesce(strlen(low) || ':' || low, '-')) END AS claimed FROM f),
n AS (
  SELECT *, row_number() OVER () AS id, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
    count(*) OVER (PARTITION BY source) AS n FROM l),
up AS (
  SELECT source, 0 AS lvl, pos, leaf AS digest, n FROM n
  UNION ALL
  SELECT source, lvl + 1, pos // 16, sha256(string_agg(digest, '' ORDER BY pos)), any_value((n + 15) // 16) FROM up WHERE n > 1
  GROUP BY source, lvl, pos // 16),
subs AS (
  SELECT source, digest AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS spos, count(*) OVER () AS sn FROM up WHERE n = 1),
top AS (
  SELECT 0 AS lvl, spos AS pos, subroot AS digest, sn AS n FROM subs
  UNION ALL
  SELECT lvl + 1, pos // 16, sha256(string_agg(digest, '' ORDER BY pos)), any_value((n + 15) // 16) FROM top WHERE n > 1 GROUP BY lvl, pos // 16),
steps AS (
  SELECT id, lvl, coalesce(string_agg(digest, '' ORDER BY u.pos) FILTER (u.pos < n.pos >> (4 * lvl)), '') AS l,
    coalesce(string_agg(digest, '' ORDER BY u.pos) FILTER (u.pos > n.pos >> (4 * lvl)), '') AS r
  FROM n JOIN up u ON n.source IS NOT DISTINCT FROM u.source AND u.n > 1 AND u.pos // 16 = n.pos >> (4 * lvl + 4) GROUP BY id, lvl
  UNION ALL
  SELECT id, 100 + lvl, coalesce(string_agg(digest, '' ORDER BY u.pos) FILTER (u.pos < spos >> (4 * lvl)), ''),
    coalesce(string_agg(digest, '' ORDER BY u.pos) FILTER (u.pos > spos >> (4 * lvl)), '')
  FROM n JOIN subs s ON n.source IS NOT DISTINCT FROM s.source JOIN top u ON u.n > 1 AND u.pos // 16 = spos >> (4 * lvl + 4) GROUP BY id, lvl),
proof AS (
  SELECT id, string_agg(l || r, '' ORDER BY lvl) AS text, list({'l': l, 'd': '', 'r': r} ORDER BY lvl) AS path FROM steps GROUP BY id),
folded AS (
  SELECT n.*, subroot, (SELECT digest FROM top WHERE top.n = 1) AS root, sha256(coalesce(text, '')) AS proof_sha256,
    list_reduce(list_prepend({'l': '', 'd': coalesce(claimed, leaf), 'r': ''}, coalesce(path, [])),
      lambda a, x: {'l': '', 'd': sha256(x.l || a.d || x.r), 'r': ''}).d AS folded_root
  FROM n JOIN subs s ON n.source IS NOT DISTINCT FROM s.source LEFT JOIN proof USING (id))
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM folded
"""
