"""The pipeline's stages against brute force on the smallest table."""

import collections

import corpus_pipeline

from sunloom.llm import langid, mixing, packing, similar
from sunloom.llm.queries import tokenizer
from tests.llm.test_free import check_pieces, ids_of
from tests.llm.test_native import fold
from tests.llm.test_similar import similar_groups


def test_stages_do_what_they_say(spark, small, documents):
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language", "exact dedup", "near dedup", "mixing", "packing"]
    known = stages["language"](spark, documents, small).cache()
    net = langid.fit(documents)
    said = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(documents, net).collect()}
    assert {r.doc_id for r in known.collect()} == {d for d, (lang, score) in said.items() if lang != "und" and score >= 0.35}
    assert known.columns == documents.columns and known.count() > 0.98 * documents.count()

    once = stages["exact dedup"](spark, known, small).cache()
    groups = collections.defaultdict(list)
    for r in known.collect():
        groups[fold(r.text)].append(r.doc_id)
    assert sorted(r.doc_id for r in once.collect()) == sorted(max(ids) for ids in groups.values())

    apart = stages["near dedup"](spark, once, small).cache()
    rows = once.collect()
    assert sorted(r.doc_id for r in apart.collect()) == sorted(set(similar_groups([(r.doc_id, r.text) for r in rows])))

    mixed = stages["mixing"](spark, apart, small).cache()
    times = {r.doc_id: r.taken // r.size for r in mixing.mix(apart).collect() if r.size}
    assert collections.Counter(r.doc_id for r in mixed.collect()) == collections.Counter({d: n for d, n in times.items() if n})
    assert mixed.columns == documents.columns

    pieces = stages["packing"](spark, mixed.dropDuplicates(["doc_id"]), small).collect()
    check_pieces(pieces, {r.doc_id: ids_of(tokenizer("byte_bpe_50k.json"), r.text, 1) for r in mixed.collect()}, 2048)
    total = sum(r.length for r in packing.pack(mixed, tokenizer("byte_bpe_50k.json")).collect())
    assert total == sum(r.length for r in corpus_pipeline.run(spark, small).collect())


def test_rows_without_id_or_that_repeat_are_kept_once(spark, odd):
    short = odd.filter("length(text) < 1000 or text is null").drop("size")
    apart = similar.keep_first(short)
    assert apart.columns == short.columns
    texts = collections.Counter(r.text for r in apart.collect())
    assert texts["one two three four five"] == 1 and texts["no id here"] == 1 and texts[None] == 1
    mixed = mixing.take(short).collect()
    assert {r.text for r in mixed} <= {r.text for r in short.collect() if (r.text or "").split()}


def test_texts_that_share_an_id_stand_for_their_own_groups(spark):
    cat, dog, fox = ("the cat sat on a mat", "no dog ever ran this far away", "some fox jumps over all of it")
    rows = [(1, cat), (1, dog), (1, dog), (2, dog), (3, fox), (1, "THE cat sat on a mat"), (4, cat)]
    apart = similar.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.text.lower()) for r in apart) == [(1, dog), (1, cat), (3, fox)]
    # Text 5 b is of the group that 4 stands for; that 5 a stands for its own does not keep it.
    rows = [(5, dog), (5, cat), (4, cat)]
    apart = similar.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.text) for r in apart) == [(4, cat), (5, dog)]


def test_empty_and_odd_tables_pass_through(spark, small, odd, empty):
    for docs in (empty, odd):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, small)
            assert docs.columns == odd.columns
        corpus_pipeline.STAGES[-1][1](spark, docs, small).count()
