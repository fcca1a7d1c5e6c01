from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from alertloom.llm import components as component_module
from alertloom.llm import langid, mixing, neardup, quality_model, quality_rules
from alertloom.llm.bytetext import text_bytes
from alertloom.llm.components import components
from alertloom.llm.queries import all_queries
from edge_rows import EDGE, words
from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.001"


# Language


def test_ngrams_of_each_text():
    texts = ["ab", "", "Abc d", "é", None, "12 x", "abcdef"]
    grams, before = langid.ngrams(*text_bytes(pa.array(texts)))
    for text, a, b in zip(texts, before[:-1], before[1:], strict=True):
        folded = bytes(c if c >= 0x80 or chr(c).isalpha() else 0x20 for c in (text or "").lower().encode())
        padded = b" " + folded + b" "
        assert [int(g).to_bytes(4, "big") for g in grams[a:b]] == [w for k in range(len(padded) - 3) if (w := padded[k : k + 4]).strip()]


def test_bitmask_look_up_equals_single_filters(spark):
    rows = [(i, f"{'alpha beta gamma' if i % 2 else 'uno dos tres quatro'} {i % 7}", "a" if i % 2 else "b") for i in range(40)]
    filters = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert sorted(filters.languages) == ["a", "b"]
    data, bounds = text_bytes(pa.array(["alpha beta", "uno dos", "alpha dos", "zzzz"]))
    found, total = filters.counts(data, bounds)
    grams, before = langid.ngrams(data, bounds)
    for k in range(4):
        for lang in range(2):
            own = [all(filters.planes[0][s] >> lang & 1 for s in langid._slots(np.array([g]))[:, 0]) for g in grams[before[k] : before[k + 1]]]
            assert found[k, lang] == sum(own)
        assert total[k] == before[k + 1] - before[k]


def test_counting_works_on_small_slices(monkeypatch):
    """Arrays for all n-grams of a slice are many times its size, so no slice is a whole batch of texts."""
    rows = [("ab"[i % 2], " ".join(f"w{i % 5}{chr(97 + (i * k) % 26)}{k % 50}" for k in range(300))) for i in range(1500)]
    batch = pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows]) for k in (0, 1)], ["lang", "text"])
    seen, real = [], langid.ngrams
    monkeypatch.setattr(langid, "ngrams", lambda data, bounds: seen.append(len(data)) or real(data, bounds))
    monkeypatch.setattr(langid, "HELD_GRAMS", 1000)
    got: Counter = Counter()
    for part in langid.gram_rows(iter([batch])):
        for lang, gram, n in zip(*(c.to_pylist() for c in part.columns), strict=True):
            got[lang, gram] += n
    want: Counter = Counter()
    for lang in "ab":
        data, bounds = text_bytes(pa.array([t for own, t in rows if own == lang]))
        want.update((lang, int(g)) for g in real(data, bounds)[0])
    assert got == want
    assert sum(seen) > 2 * langid.SLICE_BYTES >= 2 * max(seen)


def test_more_than_eight_languages(spark):
    names = [f"l{k:02d}" for k in range(20)]
    rows = [(i, f"word{chr(97 + i % 20) * 5} tail{chr(97 + i % 20) * 6}", names[i % 20]) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.identify(docs, langid.train(docs)).collect()
    assert all(r.lang == r.lang_pred for r in got)


def test_held_out_accuracy(spark):
    got = all_queries()["op2_language_filters"][0](spark, "/root/testdata/sf0.01")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    row = got.where("held_out").join(docs, "doc_id").where("lang is not null").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")).alias("a"), F.min("score"), F.max("score")).first()
    assert row[0] > 0.98 and 0 <= row[1] and row[2] <= 1


def test_language_of_edge_rows(edge, empty):
    filters = langid.train(edge)
    got = langid.identify(edge, filters).collect()
    for r in got:
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or "")) and r.score == "own"
    assert langid.identify(empty, filters).count() == 0
    nothing = langid.train(empty)
    assert {(r.lang_pred, r.lang_score) for r in langid.identify(edge, nothing).collect()} == {("und", 0.0)}


# Quality rules


def base_figures(text):
    text = text or ""
    w, lines = words(text), [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
    times, covered = Counter(windows), set()
    for k, window in enumerate(windows):
        if times[window] > 1:
            covered.update(range(k, k + 8))
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def js(p, q):
    m = [(a + b) / 2 for a, b in zip(p, q, strict=True)]
    part = lambda x: sum(a * math.log2(a / c) for a, c in zip(x, m, strict=True) if a > 0) / 2
    return math.sqrt(max(0, part(p) + part(q)))


CLASS = [(0, r"[a-z]"), (1, r"[\x20\x09-\x0D]"), (2, r"[^\x00-\x7F]"), (3, "[A-Z]"), (4, "[0-9]")]


def shares(text):
    counts = [len(re.findall(p, text)) for _, p in CLASS]
    return [*counts, len(text) - sum(counts)]


def judge_all(rows, bounds):
    """Brute force over (doc_id, text, lang): base figures and kept of each row."""
    by_lang = defaultdict(list)
    for _, text, lang in rows:
        if lang is not None:
            by_lang[lang].append(text or "")
    made = []
    for texts in by_lang.values():
        total = sum(len(words(t)) for t in texts)
        if total >= bounds.reference_words:
            classes = np.sum([shares(t) for t in texts], axis=0)
            top = sorted(Counter(w for t in texts for w in words(t)).items(), key=lambda x: (-x[1], x[0].encode()))[:32]
            made.append((classes / classes.sum(), [(w, n / total) for w, n in top]))
    out = []
    for doc_id, text, _ in rows:
        figures, text = base_figures(text), text or ""
        failed = figures[0] < bounds.min_words or 100 * figures[4] > bounds.max_repeat_percent * figures[0]
        odd = False
        if made and len(text) >= bounds.class_chars:
            own = shares(text)
            odd |= round(min(js([x / len(text) for x in own], ref) for ref, _ in made), 6) > bounds.class_distance
        if made and figures[0] >= bounds.word_words:
            counts = Counter(words(text))

            def far(top, counts=counts, n=figures[0]):
                p = [counts[w] / n for w, _ in top]
                q = [x for _, x in top]
                return js([*p, 1 - sum(p)], [*q, 1 - sum(q)])

            odd |= round(min(far(top) for _, top in made), 6) > bounds.word_distance
        out.append((doc_id, *figures, failed, not failed and not odd))
    return out


RULE_COLUMNS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def test_quality_rules_equal_brute_force(spark, documents):
    got = quality_rules.quality_rules(spark.createDataFrame(documents)).select(RULE_COLUMNS).collect()
    want = judge_all(list(documents[["doc_id", "text", "lang"]].itertuples(index=False, name=None)), quality_rules.Bounds())
    assert sorted(map(tuple, got)) == sorted(want)
    assert any(not w[-1] and not w[-2] for w in want)


def test_a_small_language_of_a_large_table_has_its_common_words(spark):
    """Two long texts are the whole of a language beside 20,000 texts of another."""
    rows = [(k, "the cat sat on mats", "en") for k in range(20_000)]
    rows += [(k, " ".join(f"zw{j % 40}" for j in range(1200)), "zz") for k in (30000, 30003)]
    rows += [(40_000 + k, " ".join(f"q{k}x{j}" for j in range(60)), "en") for k in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    far = {r.doc_id: r.word_js for r in quality_rules.quality_rules(docs).where("doc_id >= 30000").select("doc_id", "word_js").collect()}
    assert all(far[k] < 0.01 for k in (30000, 30003)) and all(far[40_000 + k] > 0.75 for k in range(3))


def test_quality_rules_on_edge_rows(edge, empty):
    bounds = quality_rules.Bounds(reference_words=10)
    got = quality_rules.quality_rules(edge, bounds).select(RULE_COLUMNS).collect()
    want = judge_all([r[:3] for r in EDGE], bounds)
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert quality_rules.quality_rules(empty).count() == 0


def test_quality_rules_run_without_python(spark, documents):
    figures = quality_rules.measure(spark.createDataFrame(documents).select("doc_id", "text", "lang"), ["the"])
    plan = figures._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# Quality model


def test_rules_of_a_printed_tree():
    text = """RandomForestClassificationModel: uid=x, numTrees=2
  Tree 0 (weight 1.0):
    If (feature 0 <= 0.5)
     If (feature 2 <= 1.5E-3)
      Predict: 0.0
     Else (feature 2 > 1.5E-3)
      Predict: 1.0
    Else (feature 0 > 0.5)
     Predict: 1.0
  Tree 1 (weight 1.0):
    If (feature 0 <= 0.5)
     Predict: 0.0
    Else (feature 0 > 0.5)
     If (feature 0 <= 0.7)
      Predict: 0.0
     Else (feature 0 > 0.7)
      Predict: 1.0
"""
    assert quality_model.tree_rules(text) == [((0, True, 0.5),), ((0, True, 0.5), (2, True, 0.0015)), ((0, True, 0.5), (2, False, 0.0015)), ((0, False, 0.5), (0, True, 0.7))]


def test_compiled_score_equals_the_rules(spark):
    rows = [tuple(float((i * 7 + k) % 10) for k in range(len(quality_model.FEATURES))) for i in range(50)]
    df = spark.createDataFrame([(r,) for r in rows], "stats struct<" + ",".join(f"{n}:double" for n in quality_model.FEATURES) + ">")
    model = quality_model.RuleModel(-0.5, [(((0, True, 4.0), (3, False, 2.0)), 1.5), (((1, False, 6.0),), -2.0)])
    want = [1 / (1 + math.exp(-(-0.5 + 1.5 * (r[0] <= 4 and r[3] > 2) - 2.0 * (r[1] > 6)))) for r in rows]
    assert [x[0] for x in df.select(model.score()).collect()] == pytest.approx(want)
    assert len(model.describe()) == 2


def test_held_out_quality(spark):
    got = all_queries()["op6_rule_ensemble"][0](spark, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = got.where("held_out").join(labels, "doc_id").select("predicted", "quality", "score").collect()
    assert sum(r.predicted == r.quality for r in rows) / len(rows) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)


def test_quality_model_on_edge_rows(spark, edge, empty):
    labels = spark.createDataFrame([(5, 1), (7, 0), (9, 1), (None, 1), (1, None)], "doc_id long, quality int")
    model = quality_model.train(edge, labels)
    got = quality_model.score_quality(edge, model)
    assert got.count() == len(EDGE) and got.where("quality_score is null or quality_score < 0 or quality_score > 1").count() == 0
    assert got.select("stats", "words").distinct().collect() == [("own", "own")]
    assert quality_model.score_quality(empty, model).count() == 0
    none = quality_model.train(edge, labels.limit(0))
    assert {r.quality_score for r in quality_model.score_quality(edge, none).collect()} == {0.5}
    assert quality_model.train(edge, labels.where("quality = 1")).score is not None


# Mixing


def test_mixing_on_edge_rows(edge, empty):
    got = mixing.mix_sources(edge, mixing.Mix(block_tokens=100)).collect()
    assert {r.source for r in got} <= {"x", "y", None} and len(got) >= 5
    assert mixing.mix_sources(empty).count() == 0
    once = mixing.mixed_documents(edge, mixing.Mix(budget_share=0.9, max_repeats=1.0))
    assert once.columns == edge.columns


@pytest.mark.parametrize(("share", "repeats"), [(1.0, 4.0), (0.5, 1.0), (2.0, 2.5)])
def test_mix_meets_its_target(spark, share, repeats):
    draw = np.random.default_rng(5)
    rows = [(i, "w " * int(draw.integers(1, 60)), "big" if i % 3 == 0 else f"s{i % 11}") for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mix = mixing.Mix(budget_share=share, max_repeats=repeats, block_tokens=5_000)
    got = mixing.mix_sources(docs, mix).toPandas()
    tokens = pd.Series([len(words(r[1])) for r in rows]).groupby([r[2] for r in rows]).sum()
    used = got.groupby("source").n_tokens.sum()
    assert used.sum() == pytest.approx(tokens.sum() * share, rel=0.02)
    assert (used / tokens).max() <= repeats * 1.02
    natural, mixed = tokens / tokens.sum(), used / used.sum()
    entropy = lambda p: -(p * np.log(p)).sum()
    target = entropy(natural) + 0.5 * (np.log(len(natural)) - entropy(natural))
    assert entropy(mixed) == pytest.approx(target, abs=0.01) or (used / tokens).max() >= repeats * 0.97
    # Every block has the weights of the whole.
    for _, block in got.groupby("block"):
        if block.n_tokens.sum() > 4000:
            assert (block.groupby("source").n_tokens.sum() / block.n_tokens.sum() - mixed).abs().max() < 0.06
    # Streams are running sums of their documents, each once per epoch.
    for _, part in got.groupby("source"):
        part = part.sort_values(["epoch", "order_key"])
        assert part.stream_start.tolist() == (part.n_tokens.cumsum() - part.n_tokens).tolist()
    assert not got.duplicated(["doc_id", "epoch"]).any()


def test_equal_sources_stay_equal(spark):
    docs = spark.range(100).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), (F.col("id") % 4).cast("string").alias("source"))
    assert mixing.mix_sources(docs).count() == 100


def test_mixing_runs_without_python(spark, documents):
    docs = spark.createDataFrame(documents[["doc_id", "text", "source"]])
    plan = mixing.realise(mixing.token_counts(docs), spark.createDataFrame([("src0", 10, 5, 5, 1)], "source string, tokens long, docs long, budget long, repeats int"), 1, 1)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan.replace("LocalTableScan", ""))


# Near duplicates


def brute_components(rows, size):
    def shingles(text):
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])

    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in sets if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    known = [(i, s) for i, s in sets if i is not None and s]
    for k, (i, a) in enumerate(known):
        for j, b in known[:k]:
            if min(len(a), len(b)) * 100 >= 80 * max(len(a), len(b)) and 100 * len(a & b) >= 80 * len(a | b):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return sorted(((i, len(s), None if i is None else root(i), i is None or root(i) == i) for i, s in sets), key=repr)


@pytest.mark.parametrize("size", [2, 5])
def test_components_equal_brute_force(spark, documents, size):
    rows = list(documents[["doc_id", "text"]].itertuples(index=False, name=None))
    got = neardup.near_duplicates(spark.createDataFrame(documents), size).collect()
    assert sorted(map(tuple, got), key=repr) == brute_components(rows, size)


def test_near_duplicates_on_edge_rows(edge, empty):
    got = neardup.near_duplicates(edge, 2).collect()
    assert sorted(map(tuple, got), key=repr) == brute_components([r[:2] for r in EDGE], 2)
    assert neardup.near_duplicates(empty).count() == 0


def test_a_crowded_region_and_its_borders(spark, monkeypatch):
    """A group larger than a region, over several tasks, ends as one component."""
    draw = np.random.default_rng(2)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for i in range(400):
        text = list(base)
        for at in draw.integers(0, 120, 3):
            text[at] = f"x{draw.integers(0, 10**9)}"
        rows.append((i, " ".join(text)))
    rows += [(1000 + i, " ".join(f"u{draw.integers(0, 10**9)}" for _ in range(40))) for i in range(100)]
    monkeypatch.setattr(neardup, "REGION", 40)
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()
    want = {r[0]: r[2] for r in brute_components(rows, 2)}
    assert {r.doc_id: r.component_id for r in got} == want


def test_texts_at_the_rim_of_a_crowded_region_join_it(spark):
    """Texts of similarity 0.81 to a group of more than REGION that differs in one place only, whatever depth parts them."""
    base = [f"w{k}" for k in range(200)]
    rows = [(k, " ".join([*base[:5], f"id{k}", *base[6:]])) for k in range(1200)]
    for k in range(60):
        text = list(base)
        for at in np.random.default_rng(k).choice(np.arange(8, 198, 2), 9, replace=False):
            text[at] = f"x{k}-{at}"
        rows.append((2000 + k, " ".join(text)))
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()
    assert len(got) == len(rows) and {r.component_id for r in got} == {0}


def test_the_second_search_takes_what_the_first_takes():
    """A pair of similarity 0.80 may look like 0.70; the search after a failed edge must not ask for more."""
    sketch = np.zeros((2, neardup.HASHES), np.uint8)
    sketch[1, :36] = 1  # 92 of 128 values agree
    one = np.ones(2, np.int64)
    region = neardup.Region(one, np.zeros((2, neardup.DEPTH), np.uint16), np.array([1, 2]), 100 * one, sketch, np.array([1, 2]))
    assert [x.tolist() for x in region.pairs(None)] == [[0], [1], [92]]


def test_likeliest_pairs_of_two_parts():
    draw = np.random.default_rng(9)
    x, y, same = draw.integers(0, 4, 300), draw.integers(4, 8, 300), draw.integers(90, 128, 300)
    kept = neardup.likeliest_between(x, y, same, 8)
    by_parts = lambda rows: {(p, q): sorted((same[k] for k in rows if (x[k], y[k]) == (p, q)), reverse=True) for p in range(4) for q in range(4, 8)}
    assert by_parts(kept) == {key: found[:8] for key, found in by_parts(range(300)).items()}
    assert len(neardup.likeliest_between(x, y, same, 0)) == 7
    assert len(neardup.likeliest_between(x, y, same, None)) == 300


def test_a_failed_edge_is_searched_again(spark, documents, monkeypatch):
    """With a threshold that holds much together that is not linked, the second search repairs the result."""
    monkeypatch.setattr(neardup, "MAYBE", 0.30)
    rows = list(documents[["doc_id", "text"]].itertuples(index=False, name=None))
    got = neardup.near_duplicates(spark.createDataFrame(documents), 2).collect()
    assert sorted(map(tuple, got), key=repr) == brute_components(rows, 2)


def test_a_group_of_unlinked_neighbours_is_not_confirmed_pair_by_pair(spark, monkeypatch):
    common = [f"w{k}" for k in range(40)]
    rows = [(i, " ".join([*common, *(f"u{i}x{k}" for k in range(6))])) for i in range(150)]  # 39 of 51 shingles shared
    rows += [(1000 + i, f"{text} v{i}") for i, text in rows[:10]]
    asked, real = [], neardup.confirm
    monkeypatch.setattr(neardup, "confirm", lambda pairs, docs, size: asked.append(pairs.count()) or real(pairs, docs, size))
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: i % 1000 for i, _ in rows}
    assert sum(asked) <= neardup.TREES * len(rows)  # of 12,720 pairs


def test_pairs_confirmed_in_a_task_equal_plain_sets(monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK_SHINGLES", 50)
    rng = np.random.default_rng(3)
    sets = [set(rng.choice(30, rng.integers(1, 30), replace=False).tolist()) for _ in range(40)]
    packed = [b"".join((v * 0x123456789).to_bytes(8, "little")[: neardup.ID_BYTES] for v in sorted(s)) for s in sets]
    a, b = (x.ravel() for x in np.meshgrid(np.arange(40), np.arange(40)))
    want = [100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y]) for x, y in zip(a, b, strict=True)]
    assert neardup.linked_rows(packed, a, b).tolist() == want
    assert 40 < sum(want) < 1600


def test_sets_are_taken_where_the_texts_are(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"a b c{i}") for i in range(3000)], "doc_id long, text string").repartition(3)
    plans, real = [], neardup.materialise
    monkeypatch.setattr(neardup, "materialise", lambda df, label: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or real(df, label))
    got = {r.id for r in neardup.shingle_sets_of(docs.where("doc_id % 100 = 0").select("doc_id"), docs, 2).collect()}
    assert {*range(0, 3000, 100)} <= got and len(got) < 300
    assert "Join" not in plans[-1] and "Aggregate" not in plans[-1]


def test_spanning_forest_is_maximal():
    draw = np.random.default_rng(4)
    a, b = draw.integers(0, 60, (2, 400))
    a, b = np.minimum(a, b)[a != b], np.maximum(a, b)[a != b]
    weight = draw.integers(0, 9, len(a))
    kept = neardup.spanning_forest(60, a, b, weight)
    parent, best, count = list(range(60)), 0, 0

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k in sorted(range(len(a)), key=lambda k: -weight[k]):
        x, y = root(a[k]), root(b[k])
        if x != y:
            parent[x] = y
            best, count = best + weight[k], count + 1
    assert len(set(kept.tolist())) == len(kept) == count and weight[kept].sum() == best


@pytest.mark.parametrize("task_edges", [1_000_000, 7])
def test_components_of_chains_stars_and_loops(spark, monkeypatch, task_edges):
    """In one task, and over many with star rounds between them."""
    monkeypatch.setattr(component_module, "TASK_EDGES", task_edges)
    pairs = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 50)] + [(205, 203), (203, 201), (201, 205), (300, 300), (7, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{100 + i: 100 for i in range(50)}, 201: 201, 203: 201, 205: 201}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_a_task_contracts_what_it_read_in_turn(spark, monkeypatch):
    """One task with more edges than are contracted at a time: the stars made so far stay joined."""
    monkeypatch.setattr(component_module, "TASK_EDGES", 10)
    order = np.random.default_rng(5).permutation(300)
    pairs = [(int(k) + 1, int(k)) for k in order if k != 150]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 8)
    try:
        got = component_module.contract(spark.createDataFrame(pairs, "a long, b long").coalesce(1), roots=True).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(map(tuple, got)) == [(k, 0 if k <= 150 else 151) for k in range(301)]


def test_language_results_equal_plain_look_ups(spark):
    """op2 as a whole: every n-gram of every text looked up in each language's own filter."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang")
    remainder = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4))
    filters = langid.train(docs.where(remainder != 2))
    bits = [np.unpackbits(plane[:, None], axis=1, bitorder="little") for plane in filters.planes]
    passes = {k: {s for s in range(langid.SLOTS) if bits[k // 8][s, k % 8]} for k in range(len(filters.languages))}
    chance = [(len(passes[k]) / langid.SLOTS) ** langid.PROBES for k in passes]
    got = {r.doc_id: r for r in all_queries()["op2_language_filters"][0](spark, SMALL).collect()}
    for row in docs.orderBy("doc_id").collect():
        if not row.text or not any(c.isalpha() for c in row.text):
            assert (got[row.doc_id].lang_pred, got[row.doc_id].score) == ("und", 0.0)
            continue
        grams, _ = langid.ngrams(*text_bytes(pa.array([row.text])))
        slots = langid._slots(grams).T.tolist()
        hits = [max(0.0, (sum(all(s in passes[k] for s in three) for three in slots) - len(slots) * chance[k]) / (1 - chance[k])) for k in passes]
        best = max(range(len(hits)), key=lambda k: (hits[k], -k))
        assert got[row.doc_id].lang_pred == filters.languages[best]
        assert got[row.doc_id].score == pytest.approx(hits[best] / sum(hits) if sum(hits) else 0.0)


def test_rule_statistics_equal_plain_ones(spark, edge):
    """op6: the statistics that rules test, from plain Python over whole texts."""

    def stats(text):
        text = text or ""
        w, n = words(text), len(text)
        lines = [x for x in text.split("\n") if words(x)]
        over = lambda a, b: a / b if b else 0.0
        space, beyond = sum(c in " \t\n\v\f\r" for c in text), sum(ord(c) > 127 for c in text)
        lower, upper, digit = (sum(a <= c <= b for c in text) for a, b in ("az", "AZ", "09"))
        classes = {"lower": lower, "space": space, "beyond": beyond, "upper": upper, "digit": digit, "other": n - lower - space - beyond - upper - digit}
        chars = sum(map(len, w))
        named = {"words_log": math.log1p(len(w)), "mean_word": over(chars, len(w)), "distinct_words": over(len(set(w)), len(w)), "dup_lines": over(len(lines) - len(set(lines)), len(lines))}
        named |= {"words_per_line": over(len(w), len(lines)), "symbols": over(sum(c in "#*$%&|<>" for c in text), chars)}
        return named | {f"share_{c}": over(v, n) for c, v in classes.items()}

    small = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    for r in quality_model.add_features(small.union(edge.select("doc_id", "text")), stats_col="figures").collect():
        want = stats(r.text)
        assert r.figures.asDict() == pytest.approx({name: want[name] for name in quality_model.FEATURES})
