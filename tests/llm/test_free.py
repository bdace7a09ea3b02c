import collections
import hashlib
import math
import zlib

import numpy as np
import pytest
import public_tokenizers
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sunloom.llm import components, langid, lattice, packing, pfor, quality, simhash, telephony, tokens

BYTE, WORD, PIECE = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))


def ids_of(path, text, end):
    tool = Tokenizer.from_file(path)
    return np.array([*tool.encode(text or "", add_special_tokens=False).ids, end], dtype="<u4")


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_encoder_equals_the_library(documents, odd, path):
    encode = tokens.Encoder(path)
    texts = [r.text for r in documents.select("text").collect()] + [r.text for r in odd.select("text").collect()]
    texts += ["don't  I'LL we've\n\n x", "a b \x85 c", "naïve café ﬁ İstanbul ſ", "\x1c\x1d a", "~ ~~ ''' '", "ÀÉ² ½x 3rd", " lead", "trail  "]
    texts += ["a <|endoftext|> b <|startoftext|>", "<|EndOfText|>", "<|endoftext|>" * 3, "x<|startoftext|>y <| z"]
    assert encode(texts) == [ids_of(path, t, 0)[:-1].tobytes() for t in texts]


def test_encoder_forgets_but_stays_right(documents, monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_WORDS", 50)
    monkeypatch.setattr(tokens, "CHARS_AT_ONCE", 2000)
    texts = [r.text for r in documents.select("text").limit(40).collect()]
    assert tokens.Encoder(BYTE)(texts) == [ids_of(BYTE, t, 0)[:-1].tobytes() for t in texts]


def check_pieces(rows, wanted, size):
    by_doc, by_seq = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    for doc, parts in by_doc.items():
        at = 0
        for r in sorted(parts, key=lambda r: r.start):
            assert r.start == at and r.length > 0
            assert r.ids_crc32 == zlib.crc32(wanted[doc][at : at + r.length].tobytes())
            at += r.length
        assert at == parts[0].doc_tokens == len(wanted[doc])
    for parts in by_seq.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= size
    assert set(by_doc) == set(wanted)
    return by_seq


def test_packing_keeps_every_id_with_little_padding(documents):
    wanted = {r.doc_id: ids_of(BYTE, r.text, 1) for r in documents.collect()}
    seqs = check_pieces(packing.pack(documents, BYTE).collect(), wanted, 2048)
    total = sum(map(len, wanted.values()))
    assert len(seqs) * 2048 - total < 2048 * documents.rdd.getNumPartitions()


def test_packing_of_odd_tables(odd, empty):
    rows = packing.pack(odd.filter("doc_id is not null").dropDuplicates(["doc_id"]), BYTE, 64).collect()
    check_pieces(rows, {r.doc_id: ids_of(BYTE, r.text, 1) for r in odd.collect() if r.doc_id is not None}, 64)
    assert packing.pack(empty, BYTE).count() == 0
    whole = packing.pack(odd, BYTE).collect()
    assert sum(r.length for r in whole if r.doc_id == 9) == 2 * len(ids_of(BYTE, "one two three four five", 1))
    again = packing.pack(odd.filter("doc_id = 9 or doc_id = 10").repartition(1), BYTE, 8).collect()
    assert len({r.row_id for r in again}) == 3
    for row in {r.row_id for r in again}:
        parts = sorted((r for r in again if r.row_id == row), key=lambda r: r.start)
        assert [r.start for r in parts] == np.cumsum([0, *[r.length for r in parts]])[:-1].tolist() and sum(r.length for r in parts) == parts[0].doc_tokens


def test_sum_of_squares_takes_the_best_level():
    rng = np.random.default_rng(5)
    packer, open_ = packing.SumOfSquares(16), []
    for n in rng.integers(1, 16, 400).tolist():
        counts = collections.Counter(open_)
        value = lambda c: sum(v * v for k, v in c.items() if 0 < k < 16)
        options = [f for f in [0, *sorted(set(open_))] if f + n <= 16]
        after = {f: value((counts - collections.Counter({f: 1 if f else 0})) + collections.Counter([f + n])) for f in options}
        packer.place((0, 0, b"\0" * 4 * n, n), n)
        now = sorted(f for f, w in packer.close())
        before = collections.Counter(open_)
        best = min(after.values())
        assert value(collections.Counter(now)) == best
        open_ = now
        del before


@pytest.mark.parametrize("n", [1, 2, 511, 2048, 2049, 5000])
def test_pfor_goes_round(n):
    rng = np.random.default_rng(n)
    for ids in (rng.integers(0, 50_000, n), np.full(n, 7), np.where(rng.random(n) < 0.05, 2**32 - 1, rng.integers(0, 9, n)), rng.integers(0, 2**32, n)):
        ids = ids.astype("<u4")
        data = pfor.encode_part([5, None], [n - 1, 1], ids)
        docs, counts, back = pfor.decode_part(data)
        assert docs == [5, None] and counts.tolist() == [n - 1, 1] and (back == ids).all()
        last = (n - 1) // pfor.BLOCK
        assert (pfor.block_of(data, last) == ids[last * pfor.BLOCK :]).all()


def test_pfor_patches_outliers():
    ids = np.arange(2048, dtype="<u4") % 16
    plain = len(pfor.encode_block(ids))
    ids[100] = 2**31
    assert len(pfor.encode_block(ids)) < plain + 16


def test_written_ids_come_back_in_order(documents, odd, empty, spark):
    for docs in (documents.repartition(5), odd):
        made = sorted(pfor.round_trip(docs, WORD).collect(), key=lambda r: r.start)
        at = 0
        texts = collections.defaultdict(list)
        for r in docs.collect():
            texts[r.doc_id].append(ids_of(WORD, r.text, 2).tobytes())
        order = [(r.doc_id is not None, r.doc_id or 0) for r in made]
        assert order == sorted(order) and len(made) == docs.count()
        for r in made:
            assert r.start == at and r.n_tokens == len(r.ids) // 4 and r.ids_crc32 == zlib.crc32(bytes(r.ids))
            texts[r.doc_id].remove(bytes(r.ids))
            at += r.n_tokens
        assert not any(texts.values())
    assert pfor.round_trip(empty, WORD).count() == 0


def test_shards_and_parts_join_up(documents, spark, monkeypatch):
    from sunloom.llm.common import fresh_path

    path = fresh_path(spark, "shards")
    monkeypatch.setattr(pfor, "PART_IDS", 3000)
    pfor.write_ids(documents, WORD, path, rows_per_shard=30)
    made = sorted(pfor.read_ids(spark, path).collect(), key=lambda r: r.doc_id)
    assert [r.start for r in made] == np.cumsum([0, *[r.n_tokens for r in made]])[:-1].tolist()
    assert spark.read.parquet(path).select("shard").distinct().count() > 3


def fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def clusters(fps, ids, threshold=2):
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= threshold) + i + 1:
            parent[find(int(j))] = find(i)
    least = {}
    for k, i in enumerate(ids):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return [least.get(find(k)) for k in range(len(fps))]


def check_near(docs, made):
    rows = sorted(docs.select("doc_id", "text").collect(), key=repr)
    fps = {t: fingerprint(t) for t in {r.text for r in rows}}
    want = clusters(np.array([fps[r.text] for r in rows], np.uint64), [r.doc_id for r in rows])
    expected = sorted((r.doc_id or -1, f"{fps[r.text]:016x}", w or -1) for r, w in zip(rows, want, strict=True))
    assert sorted((r.doc_id or -1, r.fingerprint, r.component_id or -1) for r in made) == expected


def test_near_duplicates_by_brute_force(documents, odd, empty):
    check_near(documents, simhash.near_duplicates(documents).collect())
    short = odd.filter("length(text) < 1000 or text is null")
    check_near(short, simhash.near_duplicates(short).collect())
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.fingerprint(" ".join(f"word{k % 977} lies" for k in range(60_000))) == simhash.fingerprint(" ".join(f"WORD{k % 977} lies" for k in range(60_000)))


@pytest.mark.parametrize("bucket", [8192, 3])
def test_full_buckets_take_the_exact_way(spark, bucket):
    rng = np.random.default_rng(8)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64)
    near = np.concatenate([base, *(base[:20] ^ (np.uint64(1) << rng.integers(0, 64, 20, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 20, dtype=np.uint64)) for _ in range(6))])
    fps = np.unique(near)
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    found = {r.node: r.component for r in components.components(simhash.near_links(df, len(fps), bucket)).collect()}
    got = [found.get(int(x), int(x)) for x in fps.view(np.int64)]
    want = clusters(fps, list(range(len(fps))))
    assert len(set(zip(got, want, strict=True))) == len(set(got)) == len(set(want))


@pytest.mark.parametrize("cosets", [1, 8, 64, 512])
def test_near_fingerprints_share_an_anchor(cosets):
    rng = np.random.default_rng(cosets)
    n = 200
    a = rng.integers(0, 2**64, n, dtype=np.uint64)
    b = a ^ (np.uint64(1) << rng.integers(0, 64, n, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, n, dtype=np.uint64))
    where = []
    for fps in (a, b):
        rows, names = simhash.anchors(fps, cosets)
        where.append([set(names[rows == k].tolist()) for k in range(n)])
    assert all(x & y for x, y in zip(*where, strict=True))
    # The covering radius is 28 at most: some anchor agrees in 8 bits more than it disagrees.
    assert (np.abs(simhash.walsh(a)).max(axis=1) >= 8).all()


def test_links_span_what_all_links_do():
    rng = np.random.default_rng(2)
    centre = rng.integers(0, 2**64, 5, dtype=np.uint64)
    fps = np.unique(np.concatenate([c ^ (np.uint64(1) << rng.integers(0, 64, 80, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 80, dtype=np.uint64)) for c in centre]))
    links = simhash.spanning_links(fps)
    assert all(bin(int(fps[i] ^ fps[j])).count("1") <= 2 for i, j in links)
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in links:
        assert find(i) != find(j)
        parent[find(i)] = find(j)
    want = clusters(fps, list(range(len(fps))))
    got = [find(k) for k in range(len(fps))]
    assert len(set(zip(got, want, strict=True))) == len(set(got)) == len(set(want))


def test_components_of_a_path_and_a_star(spark):
    edges = [(k, k + 1) for k in range(0, 200)] + [(1000, k) for k in range(1001, 1100)] + [(5, 5), (3, 2)]
    made = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(made[k] == 0 for k in range(1, 201)) and all(made[k] == 1000 for k in range(1001, 1100))
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_gradients_are_those_of_the_loss():
    net = langid.Network.fresh(["a", "b", "c"])
    for name in ("inputs", "states", "out", "bias"):
        setattr(net, name, getattr(net, name).astype(np.float64))
    codes, truth = np.random.default_rng(0).integers(97, 105, (7, 6)).astype(np.uint8), np.array([0, 1, 2, 0, 1, 2])
    _, grads = langid.gradients(net, codes, truth)
    for w, g in zip(net.params(), grads, strict=True):
        for at in [np.unravel_index(k, w.shape) for k in np.argsort(-np.abs(g).reshape(-1))[:3]]:
            w[at] += 1e-3
            up = langid.gradients(net, codes, truth)[0]
            w[at] -= 2e-3
            down = langid.gradients(net, codes, truth)[0]
            w[at] += 1e-3
            assert abs((up - down) / 2e-3 - g[at]) < 1e-3 * max(0.01, abs(g[at]))


def test_languages_held_out(spark, documents):
    big = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    made = langid.languages(big).join(big.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in made if r.held_out]
    assert len(made) == big.count() and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in made)
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in made)


def test_languages_of_odd_tables(odd, empty):
    made = {r.doc_id: r for r in langid.identify(odd, langid.fit(odd, steps=30)).collect()}
    assert all(made[k].lang_pred == "und" and made[k].score == 0 for k in (1, 2, 3, 11))
    assert made[4].lang_pred in ("en", "de", "fr") and made[7].lang_pred in ("en", "de", "fr")
    assert langid.languages(empty).count() == 0
    assert langid.predict(langid.train([("only one", "xx")]), ["abc", "1"]) == [("xx", 1.0), ("und", 0.0)]
    kept = langid.keep_known(odd)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.select("doc_id").collect()}.isdisjoint({1, 2, 3, 11})


def gru_brute(net, text):
    """Pooled probabilities, byte by byte with plain loops."""
    raw = text.lower().encode()
    hidden, n = net.states.shape[1], len(net.languages)
    sigmoid = lambda v: 1 / (1 + math.exp(-v))
    pooled, count = [0.0] * n, 0
    for k in range(0, len(raw), langid.WINDOW):
        window = raw[k : k + langid.WINDOW].ljust(langid.WINDOW)
        states = []
        for side, order in ((0, window), (1, window[::-1])):
            h, seen = [0.0] * hidden, []
            for b in order:
                g = [sum(h[i] * float(net.states[side][i][j]) for i in range(hidden)) for j in range(3 * hidden)]
                x = [float(v) for v in net.inputs[side][b]]
                reset = [sigmoid(x[j] + g[j]) for j in range(hidden)]
                update = [sigmoid(x[hidden + j] + g[hidden + j]) for j in range(hidden)]
                new = [math.tanh(x[2 * hidden + j] + reset[j] * g[2 * hidden + j]) for j in range(hidden)]
                h = [h[j] + update[j] * (new[j] - h[j]) for j in range(hidden)]
                seen.append(h)
            states.append(seen if side == 0 else seen[::-1])
        for b, there, back in zip(window, *states, strict=True):
            if b >= 128 or chr(b).isalpha():
                score = [sum(v * float(net.out[i][j]) for i, v in enumerate([*there, *back])) + float(net.bias[j]) for j in range(n)]
                top = [math.exp(v - max(score)) for v in score]
                pooled = [p + t / sum(top) for p, t in zip(pooled, top, strict=True)]
                count += 1
    return [p / max(1, count) for p in pooled]


def test_predictions_by_brute_force(documents):
    net = langid.train([(r.text, r.lang) for r in documents.filter("lang is not null").limit(60).collect()], steps=20)
    texts = ["Ein kurzer Text.", "ünï cödé 漢字 und mehr", "x", "the quick brown fox jumps over the lazy dog and then some more words", "12 34", None]
    for text, (lang, score) in zip(texts, langid.predict(net, texts), strict=True):
        if text is None or not any(c.isalpha() for c in text):
            assert (lang, score) == ("und", 0.0)
            continue
        want = gru_brute(net, text)
        assert lang == net.languages[int(np.argmax(want))] and abs(score - max(want)) < 1e-4


@pytest.mark.parametrize("ids", ["null", "one"])
def test_samples_stay_bounded_whatever_the_ids(spark, ids):
    rows = spark.range(20_000).select((F.lit(None) if ids == "null" else F.lit(4)).cast("long").alias("doc_id"), F.concat(F.lit("some words number "), F.col("id")).alias("text"), F.when(F.col("id") % 3 == 0, "en").otherwise("de").alias("lang"))
    rows = rows.unionByName(rows.limit(1).crossJoin(spark.range(5_000)).drop("id"))
    picked = collections.Counter(lang for _, lang in langid.training_sample(rows, 50))
    assert picked == {"en": 50, "de": 50}
    assert len(langid.training_sample(rows, 50, most=1)) == 50
    labels = quality.weigh({"0" * len(quality.LABELLERS): 1})
    assert len(quality.sample_rows(rows, labels, 25_000, 600, 10)) == 600


def test_scores_count_what_they_should(documents):
    made = lattice.scores(documents, PIECE).collect()
    texts = {r.doc_id: r.text for r in documents.collect()}
    counts = collections.Counter()
    for doc, t in texts.items():
        if zlib.crc32(str(doc).encode()) % 5 != 1:
            counts.update([*t.encode().lower().split(), "end"])
    n, v = sum(counts.values()), len(counts)
    for r in made:
        words = [*texts[r.doc_id].encode().lower().split(), "end"]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(words), sum(counts[w] > 0 for w in words), n)
        assert math.isclose(r.base_score, sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words), rel_tol=1e-9)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 1) and r.score < 0 and r.lattice_score < 0
    assert len(made) == len(texts)


def test_scores_by_brute_force(documents, monkeypatch):
    docs = documents.filter("length(text) < 900").limit(50).cache()
    fit, models = lattice.fit, []
    monkeypatch.setattr(lattice, "fit", lambda *a: models.append(fit(*a)) or models[-1])
    monkeypatch.setattr(lattice, "BLOCK_BYTES", 3000)
    made = lattice.scores(docs, PIECE).collect()
    model = models[0]
    texts = {r.doc_id: (r.text or "").encode().lower().split() for r in docs.collect()}
    counts = collections.Counter(w for d, ws in texts.items() if zlib.crc32(str(d).encode()) % 5 != 1 for w in ws)
    seen, ends = sum(counts.values()), sum(zlib.crc32(str(d).encode()) % 5 != 1 for d in texts)
    once, twice = (sum(c == k for c in counts.values()) for k in (1, 2))
    discount = min(0.95, max(0.1, once / (once + 2 * twice)))
    end = (ends + 0.5) / (seen + ends + 1)
    known = [dict(zip(h.tolist(), i.tolist(), strict=True)) for h, i in zip(model.pieces.hashes, model.pieces.ids, strict=True)]

    def pieces_of(word):
        """Sum over all cuts, from the word's end to its start."""
        rest = [0.0] * len(word) + [math.exp(model.pieces.stop)]
        for a in range(len(word) - 1, -1, -1):
            for b in range(a + 1, min(len(word), a + len(known) - 1) + 1):
                k = known[b - a].get(int(lattice._hash(np.frombuffer(word[a:b], np.uint8).reshape(1, -1))[0]))
                if k is not None:
                    rest[a] += math.exp((model.pieces.next if a else model.pieces.first)[k]) * rest[b]
        return rest[0]

    for r in made:
        score, lattice_score, used = math.log10(end), math.log10(end), collections.Counter()
        for k, w in enumerate(texts[r.doc_id]):
            spelt = pieces_of(w)
            prior = max(0.0, counts[w] - discount) / seen + discount * len(counts) / seen * spelt
            score += math.log10((lattice.URN * prior + used[w]) / (lattice.URN + k) * (1 - end))
            lattice_score += math.log10(spelt * (1 - end))
            used[w] += 1
        assert math.isclose(r.score, score, rel_tol=1e-6) and math.isclose(r.lattice_score, lattice_score, rel_tol=1e-6)
    assert len(made) == len(texts)


def test_blocks_hold_all_words_and_end_by_rows_and_bytes(documents, monkeypatch):
    monkeypatch.setattr(lattice, "BLOCK_BYTES", 20_000)
    monkeypatch.setattr(lattice, "BLOCK_ROWS", 7)
    rows = lattice.coded(documents).collect()
    texts = {r.doc_id: r.text for r in documents.collect()}
    words, counts = collections.defaultdict(dict), collections.Counter()
    for r in rows:
        if r.word is not None:
            words[r.block][r.number] = bytes(r.word)
            counts[bytes(r.word)] += r.n
    held = collections.defaultdict(list)
    for r in rows:
        if r.tokens is not None:
            held[r.block].append(texts[r.doc_id])
            assert [words[r.block][k] for k in lattice.from_planes(r.tokens).tolist()] == texts[r.doc_id].encode().lower().split()
    assert sum(map(len, held.values())) == len(texts)
    assert all(len(own) <= 7 and (len(own) == 1 or sum(len(t.encode()) for t in own) <= 20_000) for own in held.values())
    want = collections.Counter(w for d, t in texts.items() if zlib.crc32(str(d).encode()) % 5 != 1 for w in t.encode().lower().split())
    assert +counts == want


def test_scores_of_odd_and_empty_tables(odd, empty):
    made = lattice.scores(odd, PIECE).collect()
    assert len(made) == odd.count() and all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in made)
    assert {r.n_tokens for r in made if r.doc_id in (1, 2, 3)} == {1} and {r.n_tokens for r in made if r.doc_id == 7} == {120_001}
    assert lattice.scores(empty, PIECE).count() == 0


def test_forward_sums_over_all_segmentations():
    pieces = lattice.Pieces.build({b"a": 1.0, b"ab": 2.0, b"abc": 1.0}, {b"b": 1.0, b"c": 1.0, b"bc": 3.0, b"a": 0.5})
    names = {}
    for n, ids in enumerate(pieces.ids):
        names |= {int(k): n for k in ids}
    words = [b"a", b"abc", b"abcabc", b"zq", b"cab"]

    def brute(word, at=0):
        if at == len(word):
            return math.exp(pieces.stop)
        total = 0.0
        for end in range(at + 1, len(word) + 1):
            h = lattice._hash(np.frombuffer(word[at:end], np.uint8).reshape(1, -1))[0]
            if end - at < len(pieces.hashes) and h in pieces.hashes[end - at]:
                k = pieces.ids[end - at][np.searchsorted(pieces.hashes[end - at], h)]
                total += math.exp((pieces.next if at else pieces.first)[k]) * brute(word, end)
        return total

    assert np.allclose(np.exp(pieces.log_marginals(words)), [brute(w) for w in words])
    first, inner = pieces.expected([b"abc"])
    assert math.isclose(first.sum(), 1.0)


def test_long_words_are_summed_as_short_ones(monkeypatch):
    pieces = lattice.load_pieces(PIECE)
    rng = np.random.default_rng(3)
    words = [bytes(rng.choice(np.frombuffer(b"thingands \xc3\xa9xq".replace(b" ", b""), np.uint8), n).tolist()) for n in (1, 5, 60, 700, 1500)]
    want, uses = pieces.log_marginals(words), pieces.expected(words)
    monkeypatch.setattr(lattice, "LONG", 3)
    monkeypatch.setattr(lattice, "LONG_BLOCK", 50)
    assert np.allclose(pieces.log_marginals(words), want, rtol=1e-12)
    assert all(np.allclose(a, b, rtol=1e-9, atol=1e-12) for a, b in zip(pieces.expected(words), uses, strict=True))


def test_a_word_of_two_megabytes_has_a_score(spark):
    rng = np.random.default_rng(5)
    long = bytes(rng.choice(np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8), 1 << 21).tolist()).decode()
    rows = [(k, "some words and more words") for k in range(20)] + [(100, long), (101, f"words {long[:300_000]} and {long[300_000:400_000]} words")]
    made = {r.doc_id: r for r in lattice.scores(spark.createDataFrame(rows, "doc_id long, text string"), PIECE).collect()}
    assert all(math.isfinite(r.score) and math.isfinite(r.lattice_score) for r in made.values())
    assert -1e8 < made[100].lattice_score < -1e6 and made[101].n_tokens == 6 and made[101].lattice_score < -1e5


def test_reestimation_raises_the_likelihood():
    words = [b"thething", b"thing", b"then", b"ingthe"] * 3
    pieces = lattice.load_pieces(PIECE)
    before = pieces.log_marginals(words).sum()
    for _ in range(3):
        first, inner = pieces.expected(words)
        pieces = lattice.Pieces(pieces.hashes, pieces.ids, *lattice.Pieces.scores(first + 1e-3, inner + 1e-3, len(words) + 1.0))
    assert pieces.log_marginals(words).sum() > before


def test_quality_on_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    made = quality.classify(docs).join(labels, "doc_id").collect()
    assert np.mean([r.good == bool(r.quality) for r in made]) > 0.95
    assert np.mean([r.good for r in made if r.quality]) > 0.97


def em_brute(patterns, rounds=200):
    """Accuracies and posteriors with loops over votes, by the definition."""
    n, accuracy, prior, good = len(quality.LABELLERS), [0.9] * len(quality.LABELLERS), 0.8, {}
    for _ in range(rounds):
        fresh = {}
        for p in patterns:
            yes, no = prior, 1 - prior
            for k, v in enumerate(p):
                if v != "0":
                    yes *= accuracy[k] if v == "+" else 1 - accuracy[k]
                    no *= accuracy[k] if v == "-" else 1 - accuracy[k]
            fresh[p] = yes / (yes + no)
        if good and max(abs(fresh[p] - good[p]) for p in fresh) < 1e-9:
            break
        good = fresh
        for k in range(n):
            voted = sum(c for p, c in patterns.items() if p[k] != "0")
            right = sum(c * (good[p] if p[k] == "+" else 1 - good[p]) for p, c in patterns.items() if p[k] != "0")
            accuracy[k] = min(0.999, max(0.55, (right + 18) / (voted + 20)))
        prior = min(0.99, max(0.01, (sum(c * good[p] for p, c in patterns.items()) + 8) / (sum(patterns.values()) + 10)))
    return good


def test_quality_by_brute_force(documents, monkeypatch):
    monkeypatch.setattr(quality, "EPOCHS", 2)
    made = {r.doc_id: r for r in quality.classify(documents).collect()}
    texts = {r.doc_id: r.text or "" for r in documents.collect()}
    patterns = collections.Counter(r.votes for r in made.values())
    good = em_brute(patterns)
    rows = quality.sample_rows(documents, quality.weigh(patterns), len(texts), quality.SAMPLE, quality.BITS)
    assert len(rows) == len(texts)
    weights, bias = quality.train(rows)
    for doc, text in texts.items():
        words = text.encode().split()
        own, shapes = collections.Counter(words), collections.Counter()
        for w in words:
            shapes[w.translate(quality._SHAPE)[-4:]] += 1
        total = bias
        for seed, part in ((1, own), (2, shapes)):
            length = max(1.0, math.sqrt(sum(c * c for c in part.values())))
            total += sum(weights[zlib.crc32(w.lower() if seed == 1 else w, seed) % 2**quality.BITS] * c / length for w, c in part.items())
        want = 1 / (1 + math.exp(-max(-30, min(30, total))))
        assert abs(made[doc].score - want) < 1e-9 and made[doc].good == (made[doc].score >= 0.5)
        assert abs(made[doc].posterior - good[made[doc].votes]) < 1e-5


def test_quality_of_odd_tables(odd, empty):
    made = quality.classify(odd).collect()
    assert len(made) == odd.count() and all(0 <= r.score <= 1 and len(r.votes) == len(quality.LABELLERS) for r in made)
    assert quality.classify(empty).count() == 0


def test_accuracies_come_out_of_agreement():
    rng = np.random.default_rng(4)
    n, right = 20_000, np.linspace(0.6, 0.95, len(quality.LABELLERS))
    truth = rng.random(n) < 0.7
    votes = np.where(rng.random((n, len(right))) < 0.6, np.where((rng.random((n, len(right))) < right) == truth[:, None], 1, -1), 0)
    found = quality.weigh(collections.Counter(quality.pattern(tuple(v)) for v in votes.tolist()))
    assert np.abs(np.array(list(found.accuracy.values())) - right).max() < 0.03 and abs(found.prior - 0.7) < 0.03


def test_media_go_round(documents, odd, empty):
    assert telephony.telephony(odd).count() == odd.count()
    for docs in (documents, odd.filter("doc_id is not null").dropDuplicates(["doc_id"])):
        texts = {r.doc_id: r.text or "" for r in docs.collect()}
        made = telephony.telephony(docs).collect()
        assert len(made) == len(texts)
        seen = {}
        for r in made:
            raw = texts[r.doc_id].encode()
            data = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
            assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:]))
            assert seen.setdefault(texts[r.doc_id], (r.media_sha256, r.feature)) == (r.media_sha256, r.feature)
    assert telephony.telephony(empty).count() == 0


def resampled_brute(sound):
    """Twice the rate: the samples as they are, and between them the sums of the filter's second phase, one by one."""
    if not len(sound):
        return []
    taps, out = telephony.sinc_taps(2, 1), []
    reach = taps.shape[1] // 2
    at = lambda k: int(sound[max(0, min(len(sound) - 1, k))])
    for k in range(2 * len(sound)):
        made = sum(int(t) * at(k // 2 - reach + 1 + j) for j, t in enumerate(taps[k % 2]))
        out.append(max(-32768, min(32767, made + 8192 >> 14)))
    return out


def test_stored_sound_and_feature_by_brute_force(spark, documents, monkeypatch):
    from sunloom.llm import queries

    for r in queries.op10_telephony(spark, "/root/testdata/sf0.001").collect():
        _, before, after, *_ = r.feature.split()
        assert int(after) == 2 * int(before) and r.pcm_bytes == 2 * int(after) and r.rate == 16_000
    monkeypatch.setattr(telephony, "IMA_BLOCKS", 3)
    small = documents.filter("length(text) < 1200").limit(24).cache()
    media = telephony.to_media(small).collect()
    stored = {r.doc_id: r for r in telephony.telephony(small).collect()}
    assert len(stored) == len(media)
    for f in media:
        r = stored[f.doc_id]
        tag, rate, data = telephony.parse_wav(f.media)
        tables = {telephony.MULAW: telephony.mulaw_table(), telephony.ALAW: telephony.alaw_table()}
        sound = np.array([x for k in range(0, len(data), 576) for x in ima_brute(data[k : k + 576])] if tag == telephony.IMA else [tables[tag][b] for b in data])
        want = resampled_brute(sound)
        assert rate == 8000 and r.pcm_sha256 == hashlib.sha256(np.array(want, "<i2").tobytes()).hexdigest()
        rms = math.isqrt(sum(x * x for x in want) // len(want))
        crossings = sum((a < 0) != (b < 0) for a, b in zip(want, want[1:], strict=False))
        assert r.feature == f"{telephony.NAMES[tag]} {len(sound)} {len(want)} {max(map(abs, want))} {rms} {crossings}"


def test_all_sound_is_stored_in_little_room(spark, monkeypatch):
    import os
    from urllib.parse import urlparse

    from sunloom.llm import queries

    kept, stage = [], telephony.stage
    monkeypatch.setattr(telephony, "stage", lambda *args, **options: kept.append(stage(*args, **options)) or kept[-1])
    rows = {r.doc_id: r for r in queries.op10_telephony(spark, "/root/testdata/sf0.001").collect()}
    media, sound = (sum(os.path.getsize(urlparse(path).path) for path in df.inputFiles()) for df in kept)
    assert sound < 2 * media
    sounds = kept[1].select("doc_id", "packed").collect()
    assert len(sounds) == len(rows) == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
    for r in sounds:
        assert hashlib.sha256(telephony.unpack_sound(r.packed)).hexdigest() == rows[r.doc_id].pcm_sha256


def test_packed_sounds_come_back():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 3, 16, 17, 1145, 70_001):
        law, noise = rng.choice(telephony.alaw_table(), n), rng.integers(-32768, 32768, n).astype(np.int16)
        assert (telephony.halfway(noise, block=100) == telephony.resample(noise, 8000, 16000)[1::2]).all()
        for sound in (law, noise, np.full(n, -32768, np.int16)):
            for rate in (6000, 8000, 11025, 16000):
                pcm = telephony.resample(sound, 8000, rate)
                back = telephony.unpack_sound(telephony.pack_sound(pcm))
                assert back.dtype == np.dtype("<i2") and back.tolist() == pcm.tolist()
        assert len(telephony.pack_sound(telephony.resample(law, 8000, 16000))) <= telephony.HEAD.size + 512 + n
        assert len(telephony.pack_sound(telephony.resample(noise, 8000, 16000))) <= telephony.HEAD.size + 512 + 2 * n


def test_portions_keep_rows_and_order(documents):
    import pyarrow as pa

    rows = pa.RecordBatch.from_pylist([{"text": t} for t in ("a" * 300, None, "", "b" * 5, "c" * 900)])
    parts = list(telephony.portions(rows, "text", 500))
    assert [x for p in parts for x in p.column("text").to_pylist()] == rows.column("text").to_pylist()
    assert [p.num_rows for p in parts] == [5] and [p.num_rows for p in telephony.portions(rows, "text", 300)] == [1, 4]
    assert not list(telephony.portions(rows.slice(0, 0), "text"))


def test_companding_tables():
    mu, a = telephony.mulaw_table(), telephony.alaw_table()
    assert (mu[0], mu[127], mu[128], mu[255]) == (-32124, 0, 32124, 0) and (mu[:128] == -mu[128:]).all()
    assert (a[0], a[0x55], a[0xD5], a[0x2A], a[0xAA]) == (-5504, -8, 8, -32256, 32256) and len(np.unique(a)) == 256


def ima_brute(block):
    value, index = int(np.frombuffer(block[:2], "<i2")[0]), min(block[2], 88)
    out = [value]
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            step = int(telephony.STEP[index])
            size = ((code & 7) * 2 + 1) * step >> 3
            value = max(-32768, min(32767, value - size if code & 8 else value + size))
            out.append(value)
            index = max(0, min(88, index + int(telephony.CHANGE[code])))
    return out


def test_adpcm_blocks_equal_one_by_one():
    data = np.random.default_rng(6).integers(0, 256, (5, 576)).astype(np.uint8)
    assert telephony.ima_blocks(data).tolist() == [ima_brute(b.tobytes()) for b in data]
    assert len(telephony.STEP) == 89


def test_resampling():
    t = np.arange(8000)
    tone = np.rint(8000 * np.sin(2 * np.pi * 300 * t / 8000)).astype(np.int16)
    up = telephony.resample(tone, 8000, 16000)
    want = 8000 * np.sin(2 * np.pi * 300 * np.arange(16000) / 16000)
    assert len(up) == 16000 and np.abs(up - want)[100:-100].max() < 60
    down = telephony.resample(tone, 8000, 6000)
    assert len(down) == 6000 and np.abs(down - 8000 * np.sin(2 * np.pi * 300 * np.arange(6000) / 6000))[100:-100].max() < 60
    assert (telephony.resample(np.full(100, 7, np.int16), 8000, 1000) == 7).all()
    assert (telephony.resample(tone, 8000, 11025, block=100) == telephony.resample(tone, 8000, 11025)).all()
    assert telephony.resample(tone, 8000, 8000) is not None and len(telephony.resample(tone[:0], 8000, 1000)) == 0


def test_wav_files():
    for tag in (telephony.ALAW, telephony.MULAW, telephony.IMA):
        data = bytes(range(256)) * 9
        assert telephony.parse_wav(telephony.wav(data, tag)) == (tag, 8000, data)
    with pytest.raises(ValueError):
        telephony.parse_wav(b"nothing of the kind")
