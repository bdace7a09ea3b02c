"""Near-duplicates of similarity 0.8 against brute force over sets of shingles."""

import collections

import numpy as np
import pytest

from sunloom.llm import similar


def shingle_set(text, length=5):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[k : k + length]) for k in range(max(1, len(words) - length + 1))} if words else set()


def similar_groups(rows, least=0.8):
    """The smallest doc_id of each row's group, over all pairs."""
    sets, parent = [shingle_set(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            shared = len(a & sets[j])
            if shared >= least * (len(a) + len(sets[j]) - shared):
                parent[find(i)] = find(j)
    smallest = {}
    for k, (doc, _) in enumerate(rows):
        smallest[find(k)] = min(doc, smallest.get(find(k), doc))
    return [smallest[find(k)] for k in range(len(rows))]


def edited(words, rng, edits):
    out = list(words)
    for k in rng.integers(0, len(out), edits):
        out[k] = f"new{rng.integers(10**6)}"
    return " ".join(out)


def near_copies(n, rng):
    rows = []
    for k in range(n):
        words = [f"w{x}" for x in rng.integers(0, 4000, int(rng.integers(60, 400)))]
        rows.append(" ".join(words))
        # Some copies are nearer than 0.8, some are not.
        rows += [edited(words, rng, int(e)) for e in rng.integers(0, max(2, len(words) // 30), int(rng.integers(0, 4)))]
    return list(enumerate(rows))


@pytest.mark.parametrize("cap", [4096, 12])
def test_groups_by_brute_force(spark, monkeypatch, cap):
    rng = np.random.default_rng(11)
    rows = near_copies(120, rng)
    base = [f"h{x}" for x in rng.integers(0, 4000, 200)]
    rows += [(1000 + k, edited(base, rng, 2)) for k in range(60)]  # a large group, over the cap of the second run
    candidates = similar.candidates
    monkeypatch.setattr(similar, "candidates", lambda *a: candidates(*a, cap=cap))
    made = {r.doc_id for r in similar.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = set(similar_groups(rows))
    assert len(want) < len(rows)
    assert not want - made  # nothing goes that is near to nothing
    assert len(made - want) <= 0.02 * len(rows)


def test_every_link_of_the_check_is_similar(spark):
    rng = np.random.default_rng(3)
    rows = near_copies(60, rng)
    docs = spark.createDataFrame([(k, k, t) for k, t in rows], "id long, digest long, text string")
    nodes = docs.selectExpr("id as node", "id", "digest")
    pairs = [(a, b) for a in range(0, 40) for b in range(a)]
    links = spark.createDataFrame(pairs, "u long, v long")
    got = {(r.u, r.v) for r in similar.checked(links, nodes, docs).collect()}
    sets = {k: shingle_set(t) for k, t in rows}
    assert got == {(a, b) for a, b in pairs if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}


def test_bands_within_two_bits_share_an_anchor():
    rng = np.random.default_rng(5)
    a = rng.integers(0, 1 << 23, 3000)
    where = similar.homes(a)
    assert (where[:, 0] < 4096).all()
    for b in (a, a ^ (1 << rng.integers(0, 23, 3000)), a ^ (1 << rng.integers(0, 23, 3000)) ^ (1 << rng.integers(0, 23, 3000))):
        assert all(set(x) & set(y) for x, y in zip(where.tolist(), similar.homes(b).tolist(), strict=True))
    # The code is perfect: 2,048 words are nearest to each of its words.
    counts = np.bincount(similar.homes(np.arange(1 << 23, dtype=np.int64)[:: 1 << 4])[:, 0], minlength=4096)
    assert counts.sum() == 1 << 19 and len(np.unique(similar.golay()[1])) == 2048


def test_forests_connect_what_all_links_do(monkeypatch):
    rng = np.random.default_rng(8)
    centre = rng.integers(0, 2**64, (6, 3), dtype=np.uint64)
    fps = np.concatenate([c ^ (np.uint64(1) << rng.integers(0, 64, (40, 3), dtype=np.uint64)) for c in centre])
    sizes = np.sort(rng.integers(50, 90, len(fps)))
    for made in (similar.closest(sizes, fps, 0.8), similar._grown(sizes, fps, 0.8)):
        groups = []
        for links in (made.tolist(), [(i, j) for i in range(len(fps)) for j in range(i) if np.bitwise_count(fps[i] ^ fps[j]).sum() <= similar.MOST and min(sizes[i], sizes[j]) >= 0.8 * max(sizes[i], sizes[j])]):
            parent = list(range(len(fps)))

            def find(i, parent=parent):
                while parent[i] != i:
                    i = parent[i]
                return i

            for i, j in links:
                parent[find(i)] = find(j)
            groups.append([find(k) for k in range(len(fps))])
        assert len(set(zip(*groups, strict=True))) == len(set(groups[0])) == len(set(groups[1]))


def test_shingles_and_shapes():
    assert len(similar.shingles(None)) == len(similar.shingles(" \t ")) == 0
    assert similar.shingles("A b C").tolist() == similar.shingles("a  B\nc").tolist() and len(similar.shingles("a b c")) == 1
    text = " ".join(f"w{k % 500}" for k in range(70_000))
    assert len(similar.shingles(text)) == len(shingle_set(text))
    assert similar.shape(0) == similar.shape(1_000_000) == (0, 8, 3)
    assert similar.shape(10**9)[0] > similar.shape(10**7)[0] > 0


def test_larger_shapes_find_the_same(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = near_copies(60, rng)
    monkeypatch.setattr(similar, "shape", lambda n: (5, 19, 9))
    made = {r.doc_id for r in similar.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = set(similar_groups(rows))
    assert not want - made and len(made - want) <= 3


def test_odd_and_empty_tables(odd, empty):
    apart = similar.keep_first(odd)
    assert apart.columns == odd.columns and similar.keep_first(empty).count() == 0
    texts = collections.Counter((r.text or "").lower() for r in apart.collect())
    assert texts["one two three four five"] == 1 and texts["hello"] == 1 and texts["no id here"] == 1
    assert sum(not t.split() for t in texts.elements()) == 1 and sum(len(t) > 1000 for t in texts.elements()) == 1


def templated(n, copies, seed):
    """Texts of 400 words made of one base by six edits each, and copies of some with seven more."""
    rng = np.random.default_rng(seed)
    base = [f"t{x}" for x in rng.integers(0, 10**6, 400)]
    rows = [edited(base, rng, 6) for _ in range(n)]
    rows += [edited(rows[k].split(), rng, 7) for k in rng.choice(n, copies, replace=False)]
    return list(enumerate(rows))


def all_groups(rows, least=0.8):
    """``similar_groups`` by one product of 0/1 matrices."""
    sets = [shingle_set(t) for _, t in rows]
    known = {x: k for k, x in enumerate(sorted(set().union(*sets)))}
    number = np.zeros(len(known), np.int64)
    for x in sets:
        number[[known[y] for y in x]] += 1
    place = np.cumsum(number > 1) - 1
    dense = np.zeros((len(rows), int((number > 1).sum())), np.float32)
    for k, x in enumerate(sets):
        dense[k, [place[known[y]] for y in x if number[known[y]] > 1]] = 1
    size = np.array([len(x) for x in sets])
    shared = dense @ dense.T
    near = shared >= least * (size[:, None] + size - shared)
    group = np.arange(len(rows))
    while True:
        least_near = np.where(near, group, len(rows)).min(axis=1)
        if (least_near == group).all():
            return group, np.argwhere(np.triu(near, 1))
        group = least_near


@pytest.mark.parametrize("n, copies", [(240, 60), (2600, 400)])
def test_texts_of_one_template(spark, n, copies):
    rows = templated(n, copies, n)
    group, pairs = all_groups(rows)
    kept = {r.doc_id for r in similar.keep_first(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).collect()}
    gone = set(range(len(rows))) - set(group.tolist())
    assert len(pairs) > copies and kept >= set(group.tolist())
    assert len(gone - kept) >= 0.95 * len(gone)


def test_shared_counts_and_forests():
    rng = np.random.default_rng(8)
    sets = [np.unique(rng.integers(0, 60, int(rng.integers(0, 30)))) for _ in range(40)]
    made = similar.shared_counts(sets[:25], sets[25:])
    assert (made == [[len(np.intersect1d(a, b)) for b in sets[25:]] for a in sets[:25]]).all()
    near = made > 6
    edges = similar.forest(near)
    assert all(near[i, j] for i, j in edges)

    def groups(links):
        parent = list(range(40))

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for i, j in links:
            parent[find(i)] = find(25 + j)
        return [find(k) for k in range(40)], len(set(map(find, range(40))))

    one, two = groups(edges), groups(np.argwhere(near).tolist())
    assert one[1] == two[1] and len(edges) == 40 - one[1]
    assert similar.shared_counts([], []).shape == (0, 0) and similar.forest(np.zeros((0, 3), bool)) == []


def test_clusters_compared_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(similar, "CHUNK_BITS", 3)
    monkeypatch.setattr(similar, "CHUNK_SHINGLES", 5)
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**62, 90)
    sets = {}
    for k in range(120):
        held = base[: int(rng.integers(10, 90))]
        sets[k] = np.unique(np.concatenate([held[rng.random(len(held)) < 0.97], rng.integers(0, 2**62, int(rng.integers(0, 3)))])).tolist()
    sets[120] = sets[121] = []
    rows = [(k % 2, k, s) for k, s in sets.items()]
    made = similar.compared_whole(spark.createDataFrame(rows, "cluster long, node long, set array<long>")).collect()
    similarity = lambda a, b: len(set(a) & set(b)) >= 0.8 * len(set(a) | set(b))
    assert all(similarity(sets[r.u], sets[r.v]) and (r.u - r.v) % 2 == 0 for r in made)
    parent = {k: k for k in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for r in made:
        parent[find(r.u)] = find(r.v)
    wanted = [(a, b) for a in sets for b in sets if a < b and (a - b) % 2 == 0 and similarity(sets[a], sets[b])]
    assert all(find(a) == find(b) for a, b in wanted) and len(wanted) > 100


def test_parted_groups_stand_for_their_links(spark, monkeypatch):
    """Two groups with 400 failed links between them, and texts that links connect to none: clusters come from pairs of groups,
    and the least text of a cluster (60, like 62) is compared too."""
    base = [list(range(k * 1000, k * 1000 + 50)) for k in range(2)]
    sets = {k: [*base[k % 2], 10_000 + k] for k in range(40)} | {50: list(range(5000, 5050)), 51: list(range(6000, 6050)), 52: base[0][:45]} | {60: list(range(7000, 7020)), 61: list(range(8000, 8020)), 62: list(range(7000, 7019))}
    links = [(a, b) for a in range(0, 40, 2) for b in range(1, 40, 2)] + [(k, k + 2) for k in range(38)] + [(50, 51), (0, 50), (51, 52), (60, 61), (61, 62)]
    asked = []
    found = similar.components
    monkeypatch.setattr(similar, "components", lambda edges: asked.append(edges.count()) or found(edges))
    rows = spark.createDataFrame(list(sets.items()), "node long, set array<long>")
    made = {r.node: r.component for r in similar.settled(spark.createDataFrame([(min(p), max(p)) for p in links], "u long, v long"), rows).collect()}
    assert len(asked) == 3 and asked[0] == 38 and asked[1] <= 6
    assert {k: made.get(k, k) for k in sets} == {k: k % 2 for k in range(40)} | {50: 50, 51: 51, 52: 0, 60: 60, 61: 61, 62: 60}
