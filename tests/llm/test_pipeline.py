import random

import pytest
from test_langid import texts
from test_neardup import brute

import corpus_pipeline
from weblode.llm import stages
from weblode.llm.common import written


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    luck = random.Random(8)
    rows = [(i, " ".join(t.split() * 3), lang) for i, t, lang in texts(160, seed=9)]
    base = rows[0][1].split()
    rows += [(200 + i, " ".join([*base[:-1], f"x{i}"]), rows[0][2]) for i in range(6)]  # near copies
    rows += [(210, rows[1][1], rows[1][2]), (210, rows[1][1], rows[1][2]), (211, None, "en"), (212, "", None), (213, "12 34", "en"), (None, None, None)]
    item = " ".join("".join(luck.choice("klmnop") for _ in range(6)) for _ in range(25))
    rows += [(220 + i, f"{t} {item}", lang) for i, (_, t, lang) in enumerate(rows[2:6])]
    rows += [(300 + i, "!! ".join(t.upper().split()) + "!!", lang) for i, t, lang in texts(60, seed=11)]
    d = tmp_path_factory.mktemp("tables")
    full = [(i, t, lang, "s", len(t or "")) for i, t, lang in rows]
    spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, int(i < 300), 0) for i, *_ in rows if i is not None], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d)


def test_stages_by_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.collect()
        docs = written(stage(spark, docs, folder), "t")
        assert docs.columns == columns
        after = docs.collect()
        ids = {r.doc_id for r in after}
        assert all(r in before for r in after), name
        if name == "language":
            assert ids >= {r.doc_id for r in before if r.doc_id is not None and r.doc_id < 200} and not ids & {211, 212, 213, None}
        if name == "quality":
            good = {r.doc_id for r in before if r.doc_id < 300}
            assert len(ids & good) >= 0.98 * len(good) and sum(i >= 300 for i in ids) <= 1
        if name == "near_duplicates":
            want = brute([(r.doc_id, r.text) for r in before])
            assert ids == {i for i, (_, top) in want.items() if i == top} and len(after) == len(ids)
        if name == "benchmark_leaks":
            assert {r.doc_id for r in before} - ids == {r.doc_id for r in before if r.doc_id is not None and 220 <= r.doc_id < 230}
    import base64

    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path(stages.VOCABULARY), "rb"))}
    whole = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    got = {r.doc_id: r.n_tokens for r in corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()}
    assert got == {r.doc_id: len(whole(r.text)) for r in docs.collect()}


def test_run_is_the_stages_in_turn(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, folder), "t")
    key = lambda rows: sorted(tuple(r) for r in rows)
    assert key(corpus_pipeline.run(spark, folder).collect()) == key(docs.collect())


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
