"""Spelling variants by a trie of letter-group counts.

1. Words are counted over whole texts; tasks add up before anything is shuffled.
2. A word's vector says how many of its letters fall into each of GROUPS letter groups.
   In the trie of vectors, level k branches by the k-th count. One edit changes a vector
   by at most one letter too many and one too few: a depth-first search for the
   near words of a word follows its own counts and may spend a surplus of one and a
   deficit of one. Each pair is met from one of its ends: the surplus is spent first.
3. The trie is cut where a branch holds few words. The upper part, of bounded size, goes
   to all tasks, which search it for the branches that each word can reach. Below it,
   every branch is a task of its own, which goes on with the words that reached it.
   Branches that stay large down to the last level are dealt into blocks of words.
4. Words of the leaves that are reached are verified letter by letter.
5. A word's form is its most frequent near word, if that is much more frequent. Roots
   are found by following forms, whose counts rise geometrically, in doubling steps.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertloom.llm.bytetext import sub_batches
from alertloom.storage import materialise

GROUPS = 12
LEAST_CHARS = 6
LEAST_COUNT = 5
FORM_FACTOR = 5  # a form is at least so many times as frequent as the word
DROP = 199  # one in so many (document, word) loses a letter; None: none does
BRANCH_WORDS = 20_000  # words of a branch that is searched in one task
BRANCHES = 2_000  # or this part of all words, so that the upper part stays small
LEAF_PAIRS = 4_096  # a node with so few words and searches is a leaf
VERIFIED = 1 << 16  # pairs that are verified at a time
HELD = 400_000  # words that a task holds before it hands them on
PART_CHARS = 1 << 20

RUN = re.compile("[a-zÀ-ÿ]+")
_GROUP = np.array([(c - ord("a")) % GROUPS if ord("a") <= c <= ord("z") else c % GROUPS for c in range(256)], np.int64)


def text_runs(text: str, least: int) -> Counter[str]:
    """How often each run of at least `least` letters occurs, A-Z in lower case."""
    lower = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    runs = RUN.findall(lower) if len(lower) <= PART_CHARS else (m[0] for m in RUN.finditer(lower))
    return Counter(r for r in runs if len(r) >= least)


def count_words(docs: DataFrame, least_chars: int, drop: int | None) -> DataFrame:
    """word, n from docs (doc_id, text), added up within tasks."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, int] = {}

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array(list(sums.values()), pa.int64())], ["word", "n"])
            sums.clear()
            return out

        for batch in sub_batches(batches, 1):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not text:
                    continue
                begun = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for run, n in text_runs(text, least_chars).items():
                    word = run
                    if drop is not None and (code := zlib.crc32(run.encode(), begun)) % drop == 0:
                        at = code % len(run)
                        word = run[:at] + run[at + 1 :]
                        if len(word) < least_chars:
                            continue
                    sums[word] = sums.get(word, 0) + n
                if len(sums) >= HELD:
                    yield flush()
        yield flush()

    return docs.mapInArrow(work, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def vectors(words: list[str]) -> np.ndarray:
    """Letters of each word by group."""
    letters = np.frombuffer("".join(words).encode("latin-1"), np.uint8)
    owner = np.repeat(np.arange(len(words)), [len(w) for w in words])
    return np.bincount(owner * GROUPS + _GROUP[letters], minlength=len(words) * GROUPS).reshape(len(words), GROUPS)


class Upper:
    """The upper part of the trie: nested dicts by count; a branch is (number, blocks)."""

    def __init__(self, branches: list[tuple[list[int], int]]):
        self.top: dict = {}
        for number, (prefix, blocks) in enumerate(branches):
            node = self.top
            for count in prefix[:-1]:
                node = node.setdefault(count, {})
            node[prefix[-1]] = (number, blocks)

    def own(self, vector: list[int]) -> tuple[int, int]:
        node = self.top
        for count in vector:
            node = node[count]
            if isinstance(node, tuple):
                return node
        raise KeyError(vector)

    def reached(self, vector: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """Branch, its blocks and the rows of `vector` that reach it, depth first."""
        todo = [(self.top, 0, np.arange(len(vector)), np.zeros(len(vector), np.int8))]
        while todo:
            node, depth, rows, spent = todo.pop()
            for count, child in node.items():
                some, paid = step(vector[rows, depth], spent, count)
                if not len(some):
                    continue
                if isinstance(child, tuple):
                    yield *child, rows[some]
                else:
                    todo.append((child, depth + 1, rows[some], paid))


def step(own: np.ndarray, spent: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Searches that may go to the child `count`, and what they have spent then.

    spent: 0 nothing, 1 the surplus, 2 the deficit as well.
    """
    over = count - own
    some = np.flatnonzero((over == 0) | ((over == 1) & (spent == 0)) | ((over == -1) & (spent == 1)))
    return some, (spent[some] + (over[some] != 0)).astype(np.int8)


def upper_part(words: DataFrame, total: int) -> list[tuple[list[int], int]]:
    """The branches that the trie is cut into, with the blocks of each, in order."""
    limit = max(BRANCH_WORDS, -(-total // BRANCHES))
    leaves = words.groupBy("vector").agg(F.count(F.lit(1)).alias("n"))
    prefixes = leaves.select("n", F.explode(F.sequence(F.lit(1), F.lit(GROUPS))).alias("depth"), "vector").groupBy(F.slice("vector", F.lit(1), F.col("depth")).alias("prefix")).agg(F.sum("n").alias("n"))
    prefixes = materialise(prefixes, "trie-prefixes")
    large = prefixes.where(F.col("n") > limit).select("prefix")
    # Branches hang below large nodes, of which each level has fewer than BRANCHES.
    parent = F.slice("prefix", F.lit(1), F.size("prefix") - 1)
    below = prefixes.where(F.size("prefix") > 1).join(F.broadcast(large.select(F.col("prefix").alias("above"))), parent == F.col("above"), "left_semi")
    cut = below.union(prefixes.where(F.size("prefix") == 1)).where((F.col("n") <= limit) | (F.size("prefix") == GROUPS))
    return sorted((list(r["prefix"]), max(1, -(-r["n"] // limit))) for r in cut.collect())


def exactly_one_edit(shorter: np.ndarray, longer: np.ndarray) -> np.ndarray:
    """Whether rows of letters differ by one replacement, or by one insertion into the shorter."""
    if shorter.shape[1] == longer.shape[1]:
        return (shorter != longer).sum(axis=1) == 1
    width = shorter.shape[1]
    unlike = np.concatenate([shorter != longer[:, :width], np.ones((len(shorter), 1), bool)], axis=1)
    first = unlike.argmax(axis=1)
    moved = np.concatenate([np.ones((len(shorter), 1), bool), shorter != longer[:, 1:]], axis=1)
    return width - moved[:, ::-1].argmax(axis=1) <= first  # what is unlike after the shift stands before


class Branch:
    """The words of one branch of the trie, and the search among them."""

    def __init__(self, words: list[str], searches: list[str]):
        self.words, self.searches = np.array(words, object), np.array(searches, object)
        self.of, self.by = vectors(words), vectors(searches)

    def candidates(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Words and searches (numbers) whose vectors allow one edit, depth first."""
        order = np.lexsort(self.of.T[::-1])
        todo = [(order, np.arange(len(self.by)), np.zeros(len(self.by), np.int8), 0)]
        while todo:
            words, rows, spent, depth = todo.pop()
            if depth == GROUPS or len(words) * len(rows) <= LEAF_PAIRS:
                for at in range(0, len(rows), max(1, LEAF_PAIRS // len(words))):
                    some = slice(at, at + max(1, LEAF_PAIRS // len(words)))
                    yield self._leaf(words, rows[some], spent[some], depth)
                continue
            counts = self.of[words, depth]
            edges = np.flatnonzero(np.diff(counts, prepend=-1, append=-1))
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                some, paid = step(self.by[rows, depth], spent, int(counts[a]))
                if len(some):
                    todo.append((words[a:b], rows[some], paid, depth + 1))

    def _leaf(self, words: np.ndarray, rows: np.ndarray, spent: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        over = self.of[words][:, None, depth:] - self.by[rows][None, :, depth:]
        more, less = np.maximum(over, 0).sum(axis=2), np.maximum(-over, 0).sum(axis=2)
        more, less = more + (spent >= 1), less + (spent == 2)
        first = np.take_along_axis(over, (over != 0).argmax(axis=2)[..., None], axis=2)[..., 0] if depth < GROUPS else np.zeros(more.shape, np.int64)
        ahead = (first > 0) | (spent >= 1)
        i, j = np.nonzero((more <= 1) & (less <= more) & ((more == 0) | ahead))
        same = (more == 0)[i, j]
        # Words of equal vectors reach each other both ways.
        keep = ~same | (self.words[words[i]] > self.searches[rows[j]])
        return words[i[keep]], rows[j[keep]]

    def near(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Words and searches (numbers) one edit apart."""
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for pair in self.candidates():
            held.append(pair)
            size += len(pair[0])
            if size >= VERIFIED:
                yield self._verified(held)
                held, size = [], 0
        if size:
            yield self._verified(held)

    def _verified(self, held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        words, rows = (np.concatenate(x) for x in zip(*held, strict=True))
        of, by = self.of[words].sum(axis=1), self.by[rows].sum(axis=1)
        good = np.zeros(len(words), bool)
        for width, other in {*zip(by.tolist(), of.tolist(), strict=True)}:
            place = np.flatnonzero((by == width) & (of == other))
            for some in np.array_split(place, -(-len(place) * other // (1 << 22)) or 1):
                letters = lambda x, n: np.frombuffer("".join(x).encode("latin-1"), np.uint8).reshape(-1, n)
                good[some] = exactly_one_edit(letters(self.searches[rows[some]], width), letters(self.words[words[some]], other))
        return words[good], rows[good]


def near_pairs(words: DataFrame) -> DataFrame:
    """Each pair of words one edit apart once: a, a_n, b, b_n. words: word, n."""
    spark = words.sparkSession

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = vectors(batch.column(0).to_pylist())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1, dtype=np.int32) * GROUPS), pa.array(own.ravel().astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], ["word", "n", "vector"])

    measured = materialise(words.select("word", "n").mapInArrow(measure, "word string, n long, vector array<int>"), "word-vectors")
    upper = spark.sparkContext.broadcast(Upper(upper_part(measured, measured.count())))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = upper.value
        for batch in (b.slice(at, 4_096) for b in batches for at in range(0, b.num_rows, 4_096)):
            own = np.array(batch.column(2).to_pylist(), np.int64).reshape(-1, GROUPS)
            texts = batch.column(0).to_pylist()
            home = [trie.own(v) for v in own.tolist()]
            out = [(np.arange(len(own)), np.array([h[0] for h in home]), np.array([zlib.crc32(w.encode()) % h[1] for w, h in zip(texts, home, strict=True)]), False)]
            for number, blocks, rows in trie.reached(own):
                out += [(rows, np.full(len(rows), number), np.full(len(rows), block), True) for block in range(blocks)]
            for rows, number, block, asks in out:
                part = batch.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(number.astype(np.int64)), pa.array(block.astype(np.int64)), pa.array([asks] * len(rows))], ["word", "n", "branch", "block", "asks"])

    def search(group: pa.Table) -> pa.Table:
        asks = group.column("asks").to_numpy()
        texts, counts = np.array(group.column("word").to_pylist(), object), group.column("n").to_numpy()
        n_of, n_by = counts[~asks], counts[asks]
        branch = Branch(texts[~asks].tolist(), texts[asks].tolist())
        found = [pa.table({"a": pa.array(branch.searches[j], pa.string()), "a_n": pa.array(n_by[j]), "b": pa.array(branch.words[i], pa.string()), "b_n": pa.array(n_of[i])}) for i, j in (branch.near() if (~asks).any() and asks.any() else ())]
        kinds = pa.schema([("a", pa.string()), ("a_n", pa.int64()), ("b", pa.string()), ("b_n", pa.int64())])
        return pa.concat_tables([t.cast(kinds) for t in found]) if found else kinds.empty_table()

    dealt = measured.mapInArrow(deal, "word string, n long, branch long, block long, asks boolean")
    return dealt.groupBy("branch", "block").applyInArrow(search, "a string, a_n long, b string, b_n long")


def roots(forms: DataFrame) -> DataFrame:
    """word, root for rows (word, form): the end of each chain of forms.

    Counts rise by FORM_FACTOR from word to form, so a chain of 64-bit counts has at
    most 27 steps; every round doubles what a row has followed.
    """
    reached = materialise(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = reached.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = materialise(reached.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        reached = moved.select("word", "root")
        if not moved.where("moved").limit(1).count():
            return reached


def spelling_variants(docs: DataFrame, least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT, drop: int | None = DROP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, form, root, n, n_near, form_n over the words of docs; other columns are not read.

    Words are runs of Latin-1 letters, A-Z in lower case, of at least `least_chars`
    letters and `least_count` occurrences. Null and empty texts have none; a null id
    counts as an empty one where a letter is dropped; repeated rows count each. A word
    without near words has n_near 0, itself as root and no form. Words of any length
    are compared whole. Empty tables give no rows.
    """
    rows = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    words = materialise(count_words(rows, least_chars, drop).where(F.col("n") >= least_count), "frequent-words")
    pairs = near_pairs(words)
    ends = pairs.select(F.col("a").alias("near_word"), "a_n", F.col("b").alias("other"), F.col("b_n").alias("other_n"))
    ends = ends.union(pairs.select(F.col("b"), "b_n", F.col("a"), F.col("a_n")))
    best = F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best")
    near = ends.groupBy("near_word", "a_n").agg(F.count(F.lit(1)).alias("n_near"), best)
    enough = -F.col("best.less") >= FORM_FACTOR * F.col("a_n")
    near = near.select("near_word", "n_near", F.when(enough, F.col("best.other")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n"))
    near = materialise(near, "near-words")
    ended = roots(near.where("form is not null").select(F.col("near_word").alias("word"), "form"))
    out = words.join(near, F.col("word") == F.col("near_word"), "left").drop("near_word").join(ended, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n")
