from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from alertloom.llm import divergence, ngram_lm, spelling
from alertloom.llm.queries import all_queries
from edge_rows import EDGE
from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.001"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


# Spelling variants


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(a) + 1 == len(b) and any(a == b[:k] + b[k + 1 :] for k in range(len(b)))


def variants(words):
    """word -> (form, root, n, n_near, form_n) by comparing all words with each other."""
    near = {w: [x for x in words if one_edit(w, x)] for w in words}
    form = {}
    for w in words:
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 5 * words[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {w: (form[w], root(w), words[w], len(near[w]), words.get(form[w])) for w in words}


def spelled(rows, least=5, drop=199):
    count = Counter()
    for doc_id, text in rows:
        for run in re.findall("[a-zÀ-ÿ]+", lower(text)):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            count[run[: h % len(run)] + run[h % len(run) + 1 :] if drop and h % drop == 0 else run] += 1
    return variants({w: n for w, n in count.items() if len(w) >= 6 and n >= least})


def as_variants(df):
    rows = df.collect()
    out = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(out) == len(rows)
    return out


def noisy_words(seed, n, letters="abcé"):
    draw = random.Random(seed)
    words = set()
    while len(words) < n:
        base = "".join(draw.choice(letters) for _ in range(draw.randint(6, 9)))
        words |= {base, base[:2] + base[3:] + "a", base[:3] + "b" + base[3:], base[1:] if len(base) > 6 else base}
    return sorted(words)[:n]


@pytest.mark.parametrize("limit", [20_000, 25])
def test_near_pairs_equal_brute_force(spark, monkeypatch, limit):
    """With 25 words a branch, most branches are cut deep, and those of equal vectors into blocks."""
    monkeypatch.setattr(spelling, "BRANCH_WORDS", limit)
    words = noisy_words(3, 600)
    df = spark.createDataFrame([(w, i + 1) for i, w in enumerate(words)], "word string, n long").repartition(3)
    got = [tuple(sorted((r.a, r.b))) for r in spelling.near_pairs(df).collect()]
    want = {(a, b) for i, a in enumerate(words) for b in words[i + 1 :] if one_edit(a, b)}
    assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("leaf", [1, 4_096])
def test_search_of_one_branch_equals_brute_force(monkeypatch, leaf):
    monkeypatch.setattr(spelling, "LEAF_PAIRS", leaf)
    words = noisy_words(5, 250, "abmyzß")
    branch = spelling.Branch(words, words)
    got = [tuple(sorted((branch.words[i], branch.searches[j]))) for a, b in branch.near() for i, j in zip(a, b, strict=True)]
    assert len(got) == len(set(got)) and set(got) == {(a, b) for i, a in enumerate(words) for b in words[i + 1 :] if one_edit(a, b)}


def test_variants_of_documents_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = as_variants(all_queries()["op11_frequency_trie"][0](spark, SMALL))
    assert got == spelled([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert any(v[0] for v in got.values())


def test_chains_of_forms_and_dropped_letters(spark):
    chain = {"aaaaaa": 5, "aaaaab": 25, "aaaabb": 125, "aaabbb": 625, "aabbbb": 3125, "zzzzzz": 25, "zzzzzy": 25, "zzzzzx": 5}
    docs = spark.createDataFrame([(1, " ".join(w for w, n in chain.items() for _ in range(n)))], "doc_id long, text string")
    got = as_variants(spelling.spelling_variants(docs, drop=None))
    assert got == variants(chain) and got["aaaaaa"][1] == "aabbbb" and got["zzzzzx"][0] == "zzzzzy"
    rows = [(i, "wonderful Étrange straße") for i in range(400)] + [(None, "wonderful " * 7)]
    got = as_variants(spelling.spelling_variants(spark.createDataFrame(rows, "doc_id long, text string"), least_count=1, drop=5))
    assert got == spelled(rows, least=1, drop=5) and len(got) > 15


def test_variants_of_edge_rows(spark, edge, empty):
    assert as_variants(spelling.spelling_variants(edge, least_count=1)) == spelled([(r[0], r[1]) for r in EDGE], least=1)
    assert spelling.spelling_variants(empty).count() == 0
    long = spark.createDataFrame([(i, "x" * 30_000 + ("y" if i else "") + " abcdefgh") for i in range(2)], "doc_id long, text string")
    got = as_variants(spelling.spelling_variants(long, least_count=1, drop=None))
    assert got["x" * 30_000][3] == 1 and got["x" * 30_000 + "y"][3] == 1 and got["abcdefgh"] == (None, "abcdefgh", 2, 0, None)


# Language model


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", lower(text)), None]


class Model:
    """Dirichlet-smoothed n-grams in plain dictionaries."""

    def __init__(self, texts, order, mu):
        self.order, self.mu, self.counts = order, mu, Counter()
        for text in texts:
            w = tokens(text)
            self.counts.update(tuple(w[i : i + n]) for n in range(1, order + 1) for i in range(len(w) - n + 1))
        single = {k: n for k, n in self.counts.items() if len(k) == 1}
        self.total, self.known = sum(single.values()), len(single)

    def p(self, h, w):
        if not h:
            return (self.counts[(w,)] + 0.1) / (self.total + 0.1 * (self.known + 1))
        lower, seen = self.p(h[1:], w), self.counts[h]
        return (self.counts[(*h, w)] + self.mu[len(h) - 1] * lower) / (seen + self.mu[len(h) - 1])

    def score(self, text, order):
        w = tokens(text)
        return sum(math.log10(self.p(tuple(w[max(0, i - order + 1) : i]), w[i])) for i in range(len(w)))

    def row(self, text):
        w = tokens(text)
        return len(w), sum(self.counts[(x,)] > 0 for x in w), self.total, self.score(text, 1), self.score(text, self.order)


def held_out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 10 == 0


def learned(doc_id):
    return doc_id is not None and not held_out(doc_id)


def same_scores(got, want):
    key = lambda r: (r[0] is None, r)
    got, want = sorted(got, key=key), sorted(want, key=key)
    assert [r[:-2] for r in got] == [r[:-2] for r in want]
    np.testing.assert_allclose([r[-2:] for r in got], [r[-2:] for r in want], rtol=1e-9)


def test_scores_of_documents_equal_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    model = Model([t for i, t in rows if learned(i)], 3, ngram_lm.MU)
    got = all_queries()["op12_backoff_automaton"][0](spark, SMALL)
    assert got.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    same_scores([tuple(r) for r in got.collect()], [(i, held_out(i), *model.row(t)) for i, t in rows])
    sums = got.where("held_out").agg(F.sum("base_score"), F.sum("score")).first()
    assert sums[1] > sums[0]  # the longer n-grams help on texts that were not learned


@pytest.mark.parametrize("order", [1, 2, 4])
def test_orders_blocks_and_segments(spark, monkeypatch, order):
    """A text of 9,000 words is read in three segments; texts are dealt over several blocks and ranges."""
    monkeypatch.setattr(ngram_lm, "RANGE_BYTES", 20_000)
    draw = random.Random(order)
    rows = [(i, " ".join(draw.choice("the of und A b Čas x y".split()) for _ in range(draw.choice([0, 1, 2, 3, 50])))) for i in range(60)]
    rows.append((100, " ".join(draw.choice("the of und q r".split()) for _ in range(9_000))))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5, "doc_id").cache()
    smoothing = ngram_lm.Smoothing(order=order, mu=(3.0, 2.0))
    got = ngram_lm.score_texts(docs, F.col("doc_id") % 3 != 0, smoothing)
    model = Model([t for i, t in rows if i % 3], order, (3.0, 2.0, 2.0))
    same_scores([tuple(r) for r in got.collect()], [(i, i % 3 != 0, *model.row(t)) for i, t in rows])
    docs.unpersist()


def test_probabilities_sum_to_one():
    """Over all known words and one unknown, from every state."""
    texts = ["a b a b c", "b a c", "c c a", ""]
    stem = [[], ["a"], ["b"], ["a", "b"], ["c", "c"], ["z"], ["z", "a"]]
    model = Model(texts, 3, ngram_lm.MU)
    for h in stem:
        assert sum(model.p(tuple(h[-2:]), w) for w in ["a", "b", "c", None, "unknown"]) == pytest.approx(1)
    asked = pa.array([" ".join([*h, w]) for h in stem for w in ["a", "b", "c", "unknown"]])
    read = ngram_lm.Tokens(asked, 3)
    # One block that learns from `texts` alone.
    both = ngram_lm.Tokens(pa.array(texts + asked.to_pylist()), 3)
    marks = np.arange(len(texts) + len(asked)) < len(texts)
    counts = [both.counts(n, marks) for n in (1, 2, 3)]
    automaton = ngram_lm.Automaton(both, counts, model.total, model.known, ngram_lm.Smoothing())
    for text, first, size, s in zip(texts + asked.to_pylist(), both.first, both.sizes, automaton.scores(), strict=True):
        assert s == pytest.approx(model.score(text, 3)) and size == len(tokens(text)) and first >= 0
    assert len(read.sizes) == len(asked)


def test_scores_of_edge_rows(spark, edge, empty):
    got = [tuple(r) for r in ngram_lm.score_texts(edge, F.col("doc_id") != 4).collect()]
    model = Model([t for i, t, *_ in EDGE if i is not None and i != 4], 3, ngram_lm.MU)
    same_scores(got, [(i, i is not None and i != 4, *model.row(t)) for i, t, *_ in EDGE])
    assert ngram_lm.score_texts(empty, F.lit(True)).count() == 0
    nothing = ngram_lm.score_texts(edge, F.lit(None).cast("boolean")).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and r.score == pytest.approx(0) for r in nothing)


def test_packed_numbers_come_back():
    for values in ([], [0], [1, 255, 256, 2**64 - 1], list(range(1000))):
        np.testing.assert_array_equal(ngram_lm.unsqueeze(ngram_lm.squeeze(np.array(values, np.uint64))), np.array(values, np.uint64))


# Source divergence


def audited(rows, least=3, top=200):
    """rows: text, lang, source."""
    rows = [(t or "", lang or "", s or "") for t, lang, s in rows]
    out = []
    for lang in {r[1] for r in rows}:
        own = [(Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(t))), s) for t, x, s in rows if x == lang]
        docs = Counter(w for c, _ in own for w in c)
        kept = sorted(w for w, n in docs.items() if n >= least)
        counts = defaultdict(Counter)
        for c, s in own:
            counts[s].update(c)
        whole = sum(counts.values(), Counter())

        def shares(c, kept=kept):
            total = sum(c[w] for w in kept) + len(kept)
            return {w: 1 + 10**9 * (c[w] + 1) // total for w in kept}

        p, q = {s: shares(c) for s, c in counts.items()}, shares(whole)
        for s in counts:
            parts = {"pair": [(o, sum((p[s][w] - p[o][w]) ** 2 // p[o][w] for w in kept)) for o in counts if o != s]}
            parts["term"] = [(w, (p[s][w] - q[w]) ** 2 // q[w]) for w in kept if counts[s][w] and p[s][w] > q[w]]
            for part, items in parts.items():
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(ranked) if part == "pair" or k < top]
    return sorted(out)


def test_audit_of_documents_equals_brute_force(spark):
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").select("text", "lang", "source").collect()
    got = all_queries()["op13_source_divergence"][0](spark, SMALL)
    assert sorted(map(tuple, got.collect())) == audited([tuple(r) for r in rows])


def test_audit_of_edge_rows(edge, empty):
    got = sorted(map(tuple, divergence.divergence_audit(edge, least_docs=1).collect()))
    assert got == audited([(t, lang, s) for _, t, lang, s in EDGE], least=1)
    assert {r[2] for r in got} == {"pair", "term"}
    assert divergence.divergence_audit(empty).count() == 0


def test_copies_count_by_source(spark):
    """A text of many copies is split once and counts for each source as often as it is there."""
    rows = [("Alpha beta beta", "l", f"s{i % 3 if i % 7 else 0}") for i in range(500)] + [("gamma Élan 中文", "l", "s1"), ("gamma", "l", "s4"), ("gamma alpha", "l", "s4"), ("1 2 3", "l", "s5"), ("x", "m", "s1"), (None, "m", "s2")]
    docs = spark.createDataFrame(rows, "text string, lang string, source string")
    collapsed = divergence.collapse(docs.where("text is not null and lang = 'l'"))
    assert collapsed.where("text = 'Alpha beta beta'").count() == 1
    got = sorted(map(tuple, divergence.divergence_audit(docs, top_terms=1).collect()))
    assert got == audited(rows, top=1)
    assert [r for r in got if r[0] == "m"] == [("m", "s1", "pair", "s2", 0, 1), ("m", "s2", "pair", "s1", 0, 1)]
