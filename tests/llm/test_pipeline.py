from __future__ import annotations

import re

import corpus_pipeline
import pytest
from alertloom.llm import mixing
from edge_rows import words
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    out["documents"] = docs
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, SF).write.parquet(path)
        out[name] = docs = spark.read.parquet(path)
    return {k: v.toPandas() for k, v in out.items()}


def test_stages_return_whole_documents(stages):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "quality", "near_duplicates", "mix", "pack"]
    source = stages["documents"].set_index("doc_id").text
    before = "documents"
    for name in names[:-1]:
        now = stages[name]
        assert list(now.columns) == list(stages["documents"].columns)
        assert set(now.doc_id) <= set(stages[before].doc_id) and (source[now.doc_id].to_numpy() == now.text.to_numpy()).all()
        before = name


def test_language_and_quality_keep_the_good(spark, stages):
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas().set_index("doc_id").quality
    lost = set(stages["documents"].doc_id) - set(stages["language_id"].doc_id)
    assert len(lost) <= 0.02 * len(stages["documents"])
    judged = stages["language_id"].doc_id[stages["language_id"].doc_id.isin(labels.index)]
    kept = judged.isin(stages["quality"].doc_id)
    assert (kept == (labels[judged].to_numpy() == 1)).mean() > 0.95


def test_one_of_each_group_stays(stages):
    def shingles(text):
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text))
        return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])

    sets = {r.doc_id: shingles(r.text) for r in stages["quality"].itertuples()}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = list(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    assert set(stages["near_duplicates"].doc_id) == {i for i in ids if root(i) == i}


def test_mix_holds_its_budget(stages):
    before, after = stages["near_duplicates"], stages["mix"]
    tokens = lambda d: d.text.map(lambda t: len(words(t))).sum()
    assert not after.doc_id.duplicated().any()
    assert 0.85 * tokens(before) <= tokens(after) <= tokens(before)


def test_everything_is_packed(stages):
    pieces = stages["pack"]
    assert set(pieces.doc_id) == set(stages["mix"].doc_id)
    assert (pieces.groupby("doc_id").length.sum() == pieces.groupby("doc_id").doc_tokens.first()).all()
    assert pieces.groupby("sequence_id").length.sum().max() <= 2048


def test_run_equals_the_stages(spark, stages):
    got = corpus_pipeline.run(spark, SF).toPandas()
    columns = ["doc_id", "start", "length", "ids_crc32"]
    whole = lambda d: d.groupby("doc_id").doc_tokens.first().to_dict()
    assert whole(got) == whole(stages["pack"]) and set(columns) <= set(got.columns)


def test_documents_that_repeat_are_refused(spark):
    docs = spark.createDataFrame([(1, "a", "s")], "doc_id long, text string, source string")
    with pytest.raises(ValueError, match="repeat"):
        mixing.mixed_documents(docs, mixing.Mix(max_repeats=2.0))


def test_stages_take_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where(F.lit(False)), SF).count() == 0


def test_stages_keep_edge_rows_whole(spark, edge):
    """Null, blank and repeated rows, a null id, and columns named as the stages' own."""
    source = {(r.doc_id, r.text): r for r in edge.collect()}
    docs = edge
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, SF)
        assert docs.columns == edge.columns
        rows = docs.collect()
        assert all(r == source[r.doc_id, r.text] for r in rows)
        if name == "language_id":
            assert all(any(c.isalpha() for c in r.text) for r in rows) and rows
        docs = spark.createDataFrame(rows, edge.schema)


def test_unlearned_language_is_rejected(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = ["qzxv kjwq zzpf wwkx vvqj pqzk " * 20, "kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan heille on annettu järki"]
    planted = spark.createDataFrame([(-1 - k, t, None, "x", len(t)) for k, t in enumerate(odd)], docs.schema)
    kept = {r.doc_id for r in corpus_pipeline.language_id(spark, docs.union(planted), SF).select("doc_id").collect()}
    assert not kept & {-1, -2} and len(kept) >= 0.98 * docs.count()


def test_the_quality_filter_works_out_statistics_once(spark):
    """The filter stays above the statistics, and the drawn labels do not narrow the scan."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plan = corpus_pipeline.quality(spark, docs, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("regexp_replace") <= 12 and "Coalesce" not in plan
