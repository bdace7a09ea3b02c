import collections
import concurrent.futures as futures
import hashlib
import os

import duckdb
import pytest

from sunloom.llm import digest_index, mixing, preference, queries


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted([tuple(r[k] for k in order) for r in rows], key=repr)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_agrees_with_sql(spark, small, name):
    made = queries.queries()[name](spark, small)
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    wanted = con.sql(queries.oracle_sql()[name])
    assert sorted(made.columns) == sorted(wanted.columns)
    assert rows_of(made.columns, [tuple(r) for r in made.collect()]) == rows_of(wanted.columns, wanted.fetchall())


def test_native_queries_start_no_python(spark, small, monkeypatch):
    def forbidden(*args, **more):
        raise AssertionError("Python objects or workers in a native query")

    monkeypatch.setattr(type(spark.sparkContext), "parallelize", forbidden)
    for kind in (type(spark.range(1)),):
        for method in ("mapInArrow", "mapInPandas"):
            monkeypatch.setattr(kind, method, forbidden)
    for name in queries.NATIVE:
        queries.queries()[name](spark, small).count()


@pytest.mark.parametrize("name", queries.NATIVE)
def test_native_plans_run_no_python(spark, small, name):
    plan = queries.queries()[name](spark, small)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


TURNS = "conv_id long, turn long, role string, text string, kind string, chosen string"


def pair(spark, a, b):
    rows = [(c, k, r, t, "x", "y") for c, turns in ((1, a), (2, b)) for k, (r, t) in enumerate(turns)]
    pairs = spark.createDataFrame([(1, 2)], "chosen_id long, rejected_id long")
    return preference.join_pairs(pairs, spark.createDataFrame(rows, TURNS)).first()


def test_prefix_is_rendered_once(spark):
    x = pair(spark, [("user", "q"), ("assistant", "a"), ("user", "r"), ("assistant", "b")], [("user", "q"), ("assistant", "a"), ("user", "s")])
    assert x.n_prompt_turns == 2 and x.prompt == "<|user|>\nq<|end|>\n<|assistant|>\na<|end|>\n"
    assert x.chosen == "<|user|>\nr<|end|>\n<|assistant|>\nb<|end|>\n" and x.chosen_mask == "0:18,1:23"
    assert x.rejected_mask == "0:18"


def test_equal_and_prefix_conversations(spark):
    x = pair(spark, [("user", "q")], [("user", "q")])
    assert (x.chosen, x.rejected, x.chosen_mask) == ("", "", "") and x.n_prompt_turns == 1
    y = pair(spark, [("user", "q"), ("assistant", "a")], [("user", "q")])
    assert y.rejected == "" and y.chosen_mask == "1:23"
    z = pair(spark, [(None, None)], [("user", "")])
    assert z.n_prompt_turns == 0 and z.chosen == "<|unknown|>\n<|end|>\n"


def test_siblings_pair_with_the_first_of_their_opening(spark):
    rows = [(c, k, r, t, None, None) for c in range(40) for k, (r, t) in enumerate([("user", "same" if c % 3 == 0 else f"own {c}"), ("assistant", f"reply {c}")])]
    rows += [(None, 0, "user", None, None, None), (50, None, None, None, None, None), (51, 0, "assistant", "alone", None, None), (7, 0, "user", "own 7", None, None)]
    made = {r.conv_id: r for r in preference.preferences(spark.createDataFrame(rows, TURNS)).collect()}
    assert len(made) == 43
    assert [made[c].rejected_id for c in (0, 3, 39)] == [None, 0, 0]
    assert made[3].n_prompt_turns == 1 and made[3].rejected == "<|assistant|>\nreply 0<|end|>\n"
    assert made[1].kind == "parrot" and made[1].rejected == "<|assistant|>\nown 1<|end|>\n"
    assert made[50].rejected == "" and made[51].rejected == "<|assistant|>\n<|end|>\n"
    assert preference.preferences(spark.createDataFrame([], TURNS)).count() == 0


def fold(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def test_dedup_by_brute_force(odd):
    made = digest_index.deduplicate(odd).collect()
    groups = collections.defaultdict(list)
    for r in odd.collect():
        groups[fold(r.text)].append(r.doc_id)
    assert len(made) == odd.count()
    by_digest = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    for r in made:
        ids = by_digest[r.text_sha256]
        known = [i for i in ids if i is not None]
        assert r.keep_id == (max(known) if known else None) and r.group_size == len(ids)
        assert r.kept == (r.doc_id == r.keep_id)
    kept = [r.doc_id for r in digest_index.keep_first(odd).collect()]
    bare = odd.filter("doc_id is null or doc_id < 9")
    assert sorted(fold(r.text) for r in digest_index.keep_first(bare).collect()) == sorted({fold(r.text) for r in bare.collect()})
    assert sorted(x or -1 for x in kept) == sorted(max((i for i in ids if i is not None), default=-1) for ids in groups.values())


def test_index_persists_and_older_text_stays(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    place = f"file://{tmp_path}/index"
    index = digest_index.DigestIndex(spark, "index_one", place, 4)
    digest_index.deduplicate(rows, index)
    again = digest_index.DigestIndex(spark, "index_two", place, 4)
    assert again.table().count() == 2
    more = spark.createDataFrame([(5, "A"), (6, "c"), (7, "C")], "doc_id long, text string")
    made = {r.doc_id: r for r in digest_index.deduplicate(more, again).collect()}
    assert made[5].keep_id == 1 and not made[5].kept
    assert made[7].kept and made[6].keep_id == 7
    assert sorted(r.keep_id for r in again.table().collect()) == [1, 2, 7]


def test_index_keeps_its_bucket_count(spark, tmp_path):
    place = f"file://{tmp_path}/index"
    rows = digest_index.digests(spark.createDataFrame([(k, f"text {k}") for k in range(100)], "doc_id long, text string"))
    digest_index.DigestIndex(spark, "index_eight", place, 8).add(rows)
    again = digest_index.DigestIndex(spark, "index_four", place, 4)
    assert again.buckets == 8 and again.unseen(rows).count() == 0
    for k in range(3):
        again.add(digest_index.digests(spark.createDataFrame([(k, f"more {k}")], "doc_id long, text string")))
    again.compact(4)
    assert again.buckets == 4 and again.table().count() == 103 and again.unseen(rows).count() == 0
    third = digest_index.DigestIndex(spark, "index_third", place)
    assert third.buckets == 4 and third.unseen(rows).count() == 0
    plan = third.unseen(rows)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def texts(spark, numbers):
    return digest_index.digests(spark.createDataFrame([(k, f"text {k}") for k in numbers], "doc_id long, text string"))


def test_tables_of_others_stay(spark, tmp_path):
    spark.range(5).write.saveAsTable("orders_own")
    try:
        digest_index.DigestIndex(spark, "orders_own", f"file://{tmp_path}/index").add(texts(spark, range(3)))
        assert spark.table("orders_own").count() == 5
    finally:
        spark.sql("DROP TABLE orders_own")


def test_handles_of_one_index_see_each_other(spark, tmp_path):
    one, two = (digest_index.DigestIndex(spark, f"index_{n}", f"file://{tmp_path}/index", 4) for n in ("a", "b"))
    one.add(texts(spark, range(100)))
    assert two.table().count() == 100 and two.unseen(texts(spark, range(100))).count() == 0
    two.add(texts(spark, range(100)))
    assert one.table().count() == two.table().count() == 100
    one.compact(8)
    two.add(texts(spark, range(50, 200)))
    again = digest_index.DigestIndex(spark, "index_c", f"file://{tmp_path}/index")
    assert again.buckets == two.buckets == 8 and again.table().count() == one.table().count() == 200
    rows = [("x", r.keep_id) for r in digest_index.deduplicate(spark.createDataFrame([(k, f"text {k}") for k in range(200)], "doc_id long, text string"), again).collect()]
    assert len(rows) == 200


def test_additions_and_compactions_that_race(spark, tmp_path):
    one, two = (digest_index.DigestIndex(spark, f"index_{n}", f"file://{tmp_path}/index", 4) for n in ("a", "b"))
    one.add(texts(spark, range(10)))
    write, done = one._write, []

    def late(*args):
        made = write(*args)
        if not done:
            done.append(True)
            two.add(texts(spark, range(5, 30)))
        return made

    one._write = late
    one.add(texts(spark, range(20, 40)))
    assert one.table().count() == 40 == one.table().select("digest").distinct().count()
    done.clear()
    one.compact()
    assert one.table().count() == 40 and two.table().count() == 40
    done.clear()
    one._write = late
    with futures.ThreadPoolExecutor(3) as pool:
        list(pool.map(lambda h: h.add(texts(spark, range(35, 60))), (one, two, digest_index.DigestIndex(spark, "index_d", f"file://{tmp_path}/index"))))
    assert one.table().count() == 60 == two.table().select("digest").distinct().count()


def test_an_addition_that_fails_is_not_seen(spark, tmp_path, monkeypatch):
    index = digest_index.DigestIndex(spark, "index_f", f"file://{tmp_path}/index", 4)
    index.add(texts(spark, range(3)))

    def lost(*args):
        raise OSError("the driver is gone")

    monkeypatch.setattr(index, "_commit", lost)
    with pytest.raises(OSError):
        index.add(texts(spark, range(3, 9)))
    other = digest_index.DigestIndex(spark, "index_g", f"file://{tmp_path}/index")
    assert other.table().count() == 3
    other.add(texts(spark, range(9)))
    other.compact()
    assert other.table().count() == 9


def test_only_own_folders_are_dropped(spark, tmp_path):
    from sunloom.llm import common

    kept = spark.range(3)
    path = f"{common.shared_dir(spark)}/of-others"
    kept.write.parquet(path)
    before, common._written[spark.sparkContext.applicationId] = common._written.get(spark.sparkContext.applicationId), ([], [])
    try:
        staged = common.stage(kept, "own")
        common.stage_bucketed(kept, "own-table", "id", 2)
        files, tables = staged.inputFiles(), common._written[spark.sparkContext.applicationId][1]
        common.drop_staged(spark)
        assert not spark.catalog.tableExists(tables[0]) and spark.read.parquet(path).count() == 3
        assert not any(os.path.exists(f.removeprefix("file://")) for f in files)
    finally:
        common._written[spark.sparkContext.applicationId] = before


def test_turns_without_conversation_stand_alone(spark):
    rows = [(None, k % 3, "user", f"t {k % 3}", None, None) for k in range(300)] + [(1, 0, "user", "t 0", None, None)]
    made = preference.preferences(spark.createDataFrame(rows, TURNS)).collect()
    assert len(made) == 4 and all(r.kind == "parrot" for r in made)


def test_the_anti_join_reads_buckets_without_a_shuffle(spark, tmp_path):
    index = digest_index.DigestIndex(spark, "index_plan", f"file://{tmp_path}/p", 4)
    rows = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    index.add(digest_index.digests(rows))
    plan = index.unseen(digest_index.digests(rows))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and plan.count("Exchange hashpartitioning") == 1


def test_dedup_of_nothing(empty):
    assert digest_index.deduplicate(empty).count() == 0 and digest_index.keep_first(empty).count() == 0


def targets(sizes, weights=(5, 2, 1), cap=3):
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    open_, out, left = set(names), {}, sum(sizes.values())
    while open_:
        total = sum(weight[s] for s in open_)
        stopped = {s for s in open_ if left * weight[s] / total > cap * sizes[s]}
        if not stopped:
            out |= {s: left * weight[s] / total for s in open_}
            break
        for s in stopped:
            out[s] = cap * sizes[s]
            left -= out[s]
        open_ -= stopped
    return out


def test_mix_reaches_its_targets(documents):
    made = mixing.mix(documents).join(documents.select("doc_id", "source"), "doc_id").collect()
    assert len(made) == documents.count()
    sizes, taken, largest, target = collections.Counter(), collections.Counter(), collections.Counter(), {}
    for r in made:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
        target[r.source] = r.target
        assert 0 <= r.taken <= 3 * r.size and (not r.size or r.taken % r.size == 0)
    want = targets(sizes)
    for s in sizes:
        assert abs(target[s] - want[s]) < 1e-6 * max(1, want[s])
        assert abs(taken[s] - target[s]) <= largest[s] / 2 + 1
    assert sorted(map(tuple, mixing.mix(documents).collect())) == sorted(map(tuple, mixing.mix(documents.repartition(7)).collect()))


def test_targets_with_many_sources(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE_ROWS", 20)
    sizes = {None if k == 7 else f"source {k * 7919 % 997:03d}": (k * k * 31) % 5000 + (k % 5 == 0) * 100_000 for k in range(300)}
    made = mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
    want = targets(sizes)
    assert len(made) == 300 and all(abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source]) for r in made)
    plan = mixing.mix(spark.createDataFrame([(1, "a b", "x")], "doc_id long, text string, source string"))._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan


def test_texts_that_share_an_id_are_taken_by_their_own_size(spark):
    schema = "doc_id long, text string, source string, mix_row string, mix_of string, mix_rule string, mix_copy string, size string"
    rows = [(k % 5 if k % 7 else None, "w " * (k % 60 + (k % 4 == 0) * 70), "s" if k % 3 else None, "a", "b", "c", "d", "e") for k in range(400)]
    docs = spark.createDataFrame(rows, schema)
    taken = collections.Counter()
    for r in mixing.mix(docs).collect():
        if r.size:
            taken[r.doc_id, r.size, r.source_size] += r.taken // r.size
    total = {s: sum(len(t.split()) for _, t, source, *_ in rows if source == s) for s in ("s", None)}
    copies = mixing.take(docs)
    assert copies.columns == docs.columns
    got = collections.Counter((r.doc_id, len(r.text.split()), total[r.source]) for r in copies.collect())
    assert got == +taken and {r[3:] for r in copies.collect()} == {("a", "b", "c", "d", "e")}


def test_mix_with_stopped_sources(spark):
    rows = [(k, "w " * (1 + k % 9), "big" if k < 300 else "a" if k < 310 else None) for k in range(320)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    made = mixing.mix(df).join(df.select("doc_id", "source"), "doc_id").collect()
    small = [r for r in made if r.source == "a"]
    assert all(r.taken == 3 * r.size for r in small)
    assert abs(sum(r.taken for r in made) - sum(r.size for r in made)) <= 9


def test_odd_and_empty_tables_mix(odd, empty):
    made = mixing.mix(odd).collect()
    assert len(made) == odd.count()
    sizes = {r.doc_id: r.size for r in made if r.doc_id}
    assert sizes[1] == sizes[2] == sizes[3] == 0 and sizes[7] == 120_000 and sizes[9] == 5
    assert mixing.mix(empty).count() == 0 and mixing.take(empty).count() == 0
    assert mixing.take(odd).columns == odd.columns
