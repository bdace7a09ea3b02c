import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sunloom.llm import merkle


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def row_leaf(values):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climb(leaves, fanout):
    """All levels, and each leaf's path as (level, node) pairs walked the plain way."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([h("".join(levels[-1][k : k + fanout])) for k in range(0, len(levels[-1]), fanout)])
    return levels


def path(levels, at, fanout):
    out = []
    for level in levels[:-1]:
        first = at - at % fanout
        out.append(("".join(level[first:at]), "".join(level[at + 1 : first + fanout])))
        at //= fanout
    return out


def brute(rows, fanout=16):
    """(doc_id, leaf, subroot, root, proof digest, folded root, verified) of rows (doc_id, source, lang, n_chars, text)."""
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    ordered = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in ordered:
        members = sorted(groups[s], key=lambda r: (r[0] is not None, r[0] or 0, row_leaf(r)))
        trees[s] = members, climb([row_leaf(r) for r in members], fanout)
    top = climb([trees[s][1][-1][0] for s in ordered], fanout)
    out = []
    for g, s in enumerate(ordered):
        members, levels = trees[s]
        for at, r in enumerate(members):
            steps = path(levels, at, fanout) + path(top, g, fanout)
            node = row_leaf(r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None:
                node = row_leaf((*r[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4])))
            for left, right in steps:
                node = h(left + node + right)
            out.append((r[0], levels[0][at], levels[-1][0], top[-1][0], h("".join(a + b for a, b in steps)), node, node == top[-1][0]))
    return sorted(out, key=repr)


FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def rows_of(docs):
    return [tuple(r) for r in docs.select(*FIELDS).collect()]


def checked(docs):
    return sorted([tuple(r) for r in merkle.tamper_check(docs).collect()], key=repr)


def test_query_by_brute_force(documents):
    assert checked(documents) == brute(rows_of(documents))


def test_odd_and_empty_tables(odd, empty):
    assert checked(odd) == brute(rows_of(odd))
    assert merkle.tamper_check(empty).collect() == []
    assert merkle.manifest(empty).columns == ["doc_id", "source", "leaf", "subroot", "root", "proof"]


def many(spark, sizes):
    """One row per leaf: source k has ``sizes[k]`` rows, ids shuffled among the sources."""
    total = sum(sizes)
    ends = np.cumsum(sizes).tolist()
    source = F.coalesce(*[F.when(F.col("id") < e, F.lit(None if k == 0 else f"s{k}é")) for k, e in enumerate(ends)])
    rows = spark.range(total).select(
        (F.col("id") * 7919 % 100_003).alias("doc_id"), source.alias("source"), F.lit("en").alias("lang"), F.col("id").alias("n_chars"), F.concat(F.lit("Text "), "id").alias("text")
    )
    return rows


@pytest.mark.parametrize("block", [4, 16, 64, 4096])
def test_blocks_of_any_size_give_one_tree(spark, monkeypatch, block):
    monkeypatch.setattr(merkle, "BLOCK", block)
    docs = many(spark, [3, 1, 4, 5, 16, 17, 65, 90])
    made = merkle.manifest(docs, fanout=4).collect()
    wanted = {r[0]: r for r in brute(rows_of(docs), 4)}
    assert len(made) == len(wanted)
    for r in made:
        assert (r.leaf, r.subroot, r.root) == wanted[r.doc_id][1:4]
        assert h("".join(s.left + s.right for s in r.proof)) == wanted[r.doc_id][4]


def test_one_group_holds_most_rows(spark):
    docs = many(spark, [5, 9000, 2])
    assert checked(docs) == brute(rows_of(docs))


def test_many_groups(spark, monkeypatch):
    monkeypatch.setattr(merkle, "BLOCK", 16)
    docs = spark.range(700).select(F.col("id").alias("doc_id"), F.concat(F.lit("g"), F.col("id") % 300).alias("source"), F.lit(None).cast("string").alias("lang"), F.col("id").alias("n_chars"), F.lit("X").alias("text"))
    assert checked(docs) == brute(rows_of(docs))


def test_a_changed_row_or_sibling_does_not_verify(documents):
    made = merkle.manifest(documents)
    good = made.select("doc_id", (merkle.fold(F.col("leaf"), F.col("proof")) == F.col("root")).alias("ok"))
    assert all(r.ok for r in good.collect())
    other = made.select((merkle.fold(F.sha2(F.col("leaf").cast("binary"), 256), F.col("proof")) == F.col("root")).alias("ok"))
    assert not any(r.ok for r in other.collect())
    swapped = F.transform("proof", lambda s: F.struct(s["right"].alias("left"), s["left"].alias("right")))
    turned = made.filter("size(filter(proof, s -> s.left <> s.right)) > 0").select((merkle.fold(F.col("leaf"), swapped) == F.col("root")).alias("ok"))
    assert not any(r.ok for r in turned.collect())


@pytest.mark.parametrize("fanout", [2, 3, 16])
def test_sibling_ranges_by_brute_force(fanout):
    for n in (1, 2, 3, 15, 16, 17, 50):
        leaves = [h(str(k)) for k in range(n)]
        levels = climb(leaves, fanout)
        made = merkle.matrices(np.frombuffer("".join(leaves).encode(), dtype=np.uint8).reshape(-1, 64), fanout, len(levels) - 1)
        assert [m.tobytes().decode() for m in made] == ["".join(x) for x in levels]
        flat = [d for level in levels for d in level]
        a, b, c, d = merkle.sibling_ranges([len(x) for x in levels], fanout, np.arange(n))
        for at in range(n):
            steps = [("".join(flat[a[at, k] : a[at, k] + b[at, k]]), "".join(flat[c[at, k] : c[at, k] + d[at, k]])) for k in range(len(levels) - 1)]
            assert steps == path(levels, at, fanout)


def test_other_trees_and_bad_fanouts(spark, documents):
    made = merkle.manifest(documents, fields=("doc_id", "lang"), by="lang", fanout=2).collect()
    by = {}
    for r in documents.collect():
        by.setdefault(r.lang, []).append(r.doc_id)
    for r in made:
        assert r.subroot == climb([row_leaf((d, r.lang)) for d in sorted(by[r.lang])], 2)[-1][0]
    with pytest.raises(ValueError):
        merkle.manifest(documents, fanout=1)
