"""Spelling variant grouping with a frequency-vector trie.

A word's vector is its length and, for each of GROUPS letter groups, how many of its letters fall into it. The vectors
of all words form a trie, one level a number. Words at edit distance one have vectors that differ by a surplus of one in
one group and a deficit of one in another at most, so a depth-first search spends a budget of one each on the
way down; the words at the leaves it reaches are verified letter by letter. Each pair is found from one
side only: from the shorter word, or for equal lengths from the word whose first difference is a surplus.

The trie is distributed. Its upper part is split, level by level, until a node holds at most a block of
words; the nodes reached, far fewer than words, are sent to all tasks. Every word is routed to its own block and, by the
same search, as a question to the blocks that its budget can reach. Blocks with more words or questions than a
task should hold are cut into parts that meet each other, so nothing is dropped. Each part searches the lower
part of the trie.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.common import documents, stage, table
from querylens.session import broadcast_if_small

GROUPS = 16
LEVELS = 1 + GROUPS
LEAST_LETTERS = 7
LEAST_COUNT = 2
#: A form is at least so many times as frequent as the word.
TIMES = 10
SPARED = 31
#: Words of a block, and questions to it that one task answers. Beyond 2^16 blocks' worth of words, blocks grow instead of the routing table.
BLOCK, MOST_BLOCKS = 1 << 14, 1 << 16
QUESTIONS = 1 << 17
#: Pairs in hand at a time, and letters up to which words are compared as rows of a matrix.
CHUNK, WIDTH = 1 << 18, 64

#: Search states: a question; one letter to insert, inserted; one letter to replace, its surplus spent, both spent; a word on its own path.
ASK, INSERT, INSERTED, REPLACE, SURPLUS, REPLACED, OWN = range(7)
#: [state, member's count - question's count + 1]
_NEXT = np.full((7, 3), -1, np.int8)
_NEXT[ASK, 1], _NEXT[ASK, 2] = REPLACE, INSERT
_NEXT[INSERT, 1], _NEXT[INSERT, 2], _NEXT[INSERTED, 1] = INSERT, INSERTED, INSERTED
_NEXT[REPLACE, 1], _NEXT[REPLACE, 2], _NEXT[SURPLUS, 1], _NEXT[SURPLUS, 0], _NEXT[REPLACED, 1] = REPLACE, SURPLUS, SURPLUS, REPLACED, REPLACED
_NEXT[OWN, 1] = OWN


def corpus_words(df: DataFrame) -> DataFrame:
    """(word, n): distinct words of LEAST_LETTERS code points or more that occur LEAST_COUNT times or more."""
    rows = documents(df)
    # a run below the least length gives no word, with or without a letter less
    runs = rows.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"([A-Za-zÀ-ÿ]{%d,}+)" % LEAST_LETTERS), F.lit(0))).alias("run"))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    runs = runs.select("doc_id", F.translate("run", upper, lower).alias("run"))
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run")).cast("binary"))
    runs = runs.select("run", h.alias("h"))
    place = (F.col("h") % F.char_length("run")).cast("int")
    cut = F.concat(F.substr("run", F.lit(1), place), F.substr("run", place + 2, F.char_length("run")))
    words = runs.select(F.when(F.col("h") % SPARED == 0, cut).otherwise(F.col("run")).alias("word"))
    return words.where(F.char_length("word") >= LEAST_LETTERS).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_COUNT)


def letters(words: pa.Array) -> list[bytes]:
    """Words as one byte a letter: their alphabet ends at 0xFF."""
    return [w.encode("latin-1") for w in words.to_pylist()]


def vectors(words: list[bytes]) -> np.ndarray:
    sizes = np.array([len(w) for w in words], np.int64)
    flat = np.frombuffer(b"".join(words), np.uint8) % GROUPS
    owner = np.repeat(np.arange(len(words)), sizes)
    counts = np.bincount(owner * GROUPS + flat, minlength=len(words) * GROUPS).reshape(len(words), GROUPS)
    return np.concatenate([sizes[:, None], counts], axis=1).astype(np.int32)


class Trie:
    """Paths of numbers, sorted; no path is the beginning of another. A path's place in the list is the name of its leaf."""

    def __init__(self, paths: np.ndarray, depths: np.ndarray):
        self.values, self.leaves, self.ranges = [], [], []
        parent, rows, parents = np.zeros(len(paths), np.int64), np.arange(len(paths)), 1
        for level in range(int(depths.max(initial=0))):
            held = depths[rows] > level
            rows, parent = rows[held], parent[held]
            value = paths[rows, level]
            new = np.ones(len(rows), bool)
            new[1:] = (parent[1:] != parent[:-1]) | (value[1:] != value[:-1])
            node, at = np.cumsum(new) - 1, np.flatnonzero(new)
            self.values.append(value[at])
            self.leaves.append(np.where(depths[rows[at]] == level + 1, rows[at], -1))
            self.ranges.append(np.searchsorted(parent[at], np.arange(parents + 1)))
            parent, parents = node, len(at)

    def search(self, asked: np.ndarray, states: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(question, leaf, state) of all leaves in reach, depth first in batches of bounded size."""
        if not self.values:
            return
        stack = [(0, np.arange(len(asked)), np.zeros(len(asked), np.int64), states)]
        while stack:
            level, q, node, state = stack.pop()
            start = self.ranges[level][node]
            counts = self.ranges[level][node + 1] - start
            total = int(counts.sum())
            if total > CHUNK and len(q) > 1:
                half = len(q) // 2
                stack += [(level, q[part], node[part], state[part]) for part in (slice(half, None), slice(half))]
                continue
            child = np.arange(total) + np.repeat(start - (np.cumsum(counts) - counts), counts)
            q, state = np.repeat(q, counts), np.repeat(state, counts)
            difference = self.values[level][child] - asked[q, level]
            near = np.flatnonzero(np.abs(difference) <= 1)
            after = _NEXT[state[near], difference[near] + 1]
            near, after = near[after >= 0], after[after >= 0]
            q, child = q[near], child[near]
            leaf = self.leaves[level][child]
            done = leaf >= 0
            if done.any():
                yield q[done], leaf[done], after[done]
            if not done.all():
                stack.append((level + 1, q[~done], child[~done], after[~done]))


def with_vectors(words: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = vectors(letters(batch.column("word"))) if batch.num_rows else np.zeros((0, LEVELS), np.int32)
            ends = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * LEVELS)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(ends, pa.array(found.reshape(-1)))], ["word", "n", "vector"])

    return words.select("word", "n").mapInArrow(run, "word string, n long, vector array<int>")


def upper_paths(words: DataFrame, block: int) -> list[tuple[int, ...]]:
    """The shallowest trie nodes that hold at most ``block`` words, or whole vectors, as sorted paths."""
    paths, split = [], None
    for depth in range(1, LEVELS + 1):
        here = words.select(F.slice("vector", 1, depth).alias("path"))
        if split is not None:
            here = here.join(broadcast_if_small(split, 128), F.slice("path", 1, depth - 1) == F.col("parent"), "left_semi")
        sizes = stage(here.groupBy("path").agg(F.count(F.lit(1)).alias("n")), "op11-nodes")
        large = (F.col("n") > block) & F.lit(depth < LEVELS)
        paths += [tuple(r["path"]) for r in sizes.where(~large).select("path").collect()]
        split = sizes.where(large).select(F.col("path").alias("parent"))
        if not split.take(1):
            break
    return sorted(paths)


def routed(words: DataFrame, paths: list[tuple[int, ...]]) -> DataFrame:
    """(block, state, word, n): each word in its own block, and as a question in every block in reach."""
    depths = np.array([len(p) for p in paths], np.int64)
    padded = np.array([p + (0,) * (LEVELS - len(p)) for p in paths], np.int32).reshape(-1, LEVELS)
    upper = words.sparkSession.sparkContext.broadcast((padded, depths))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(*upper.value)
        for batch in batches:
            asked = batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(-1, LEVELS)
            for start in (ASK, OWN):
                for q, leaf, state in trie.search(asked, np.full(len(asked), start, np.int8)):
                    taken = batch.select(["word", "n"]).take(pa.array(q))
                    yield pa.RecordBatch.from_arrays([pa.array(leaf), pa.array(state), *taken.columns], ["block", "state", "word", "n"])

    return words.mapInArrow(run, "block long, state tinyint, word string, n long")


def dealt(routes: DataFrame, block: int) -> DataFrame:
    """The routed rows with the part of their block, so that every question of a block meets every word of it once."""
    own = F.col("state") == OWN
    sizes = routes.groupBy("block").agg(F.count_if(own).alias("words"), F.count_if(~own).alias("questions")).where("words > 0 AND questions > 0")
    parts = lambda n, most: F.ceil(F.col(n) / most).cast("int")
    sizes = stage(sizes.select("block", parts("words", block).alias("rows"), parts("questions", QUESTIONS).alias("columns")), "op11-sizes")
    joined = routes.join(broadcast_if_small(sizes, 64), "block")
    mine = lambda n: F.array(F.pmod(F.xxhash64("word"), F.col(n)).cast("int"))
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    row, column = F.when(own, mine("rows")).otherwise(every("rows")), F.when(own, every("columns")).otherwise(mine("columns"))
    return joined.withColumn("row", F.explode(row)).withColumn("column", F.explode(column)).select("block", "row", "column", "state", "word", "n")


def one_edit(short: bytes, long: bytes) -> bool:
    """Whether one replacement (same length) or insertion turns ``short`` into ``long``."""
    if len(short) == len(long):
        return sum(a != b for a, b in zip(short, long)) == 1
    p = next((i for i, (a, b) in enumerate(zip(short, long)) if a != b), len(short))
    return short[p:] == long[p + 1 :]


def matrix(words: list[bytes]) -> np.ndarray:
    """One row a word, filled up with zeros; words over WIDTH letters are cut here and compared by ``one_edit``."""
    width = 1 + min(WIDTH, max(map(len, words), default=0))
    return np.frombuffer(b"".join(w[:width].ljust(width, b"\0") for w in words), np.uint8).reshape(-1, width)


def near_rows(short: np.ndarray, long: np.ndarray, inserted: np.ndarray) -> np.ndarray:
    """Which pairs of rows differ by one edit; ``inserted``: the second word is one letter longer."""
    width = max(short.shape[1], long.shape[1])
    short, long = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (short, long))
    differ = short != long
    first = differ.argmax(axis=1)
    moved = short[:, :-1] != long[:, 1:]
    last = np.where(moved.any(axis=1), moved.shape[1] - 1 - moved[:, ::-1].argmax(axis=1), -1)
    return np.where(inserted, last < first, differ.sum(axis=1) == 1)


def block_pairs(words: list[bytes], questions: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(question, word) of the verified pairs of a block, searched from its root with the whole budget."""
    paths, leaf_of = np.unique(vectors(words), axis=0, return_inverse=True)
    order = np.argsort(leaf_of.reshape(-1), kind="stable")
    bounds = np.searchsorted(leaf_of.reshape(-1)[order], np.arange(len(paths) + 1))
    trie = Trie(paths, np.full(len(paths), LEVELS))
    left, right = matrix(questions), matrix(words)
    ahead = np.array([len(w) for w in questions], np.int64)
    size = np.array([len(w) for w in words], np.int64)
    for q, leaf, state in trie.search(vectors(questions), np.full(len(questions), ASK, np.int8)):
        counts = bounds[leaf + 1] - bounds[leaf]
        ends = np.cumsum(counts)
        for lo, hi in spans(ends):
            c = counts[lo:hi]
            within = np.arange(int(c.sum())) - np.repeat(np.cumsum(c) - c, c)
            w, x, s = order[within + np.repeat(bounds[leaf[lo:hi]], c)], np.repeat(q[lo:hi], c), np.repeat(state[lo:hi], c)
            wide = (size[w] > WIDTH) | (ahead[x] > WIDTH)
            good = near_rows(left[x], right[w], size[w] > ahead[x])
            for i in np.flatnonzero(wide).tolist():
                good[i] = one_edit(questions[x[i]], words[w[i]])
            # equal vectors are reached from both sides
            for i in np.flatnonzero(good & (s == REPLACE)).tolist():
                good[i] = questions[x[i]] < words[w[i]]
            yield x[good], w[good]


def spans(ends: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stretches of entries that add up to about CHUNK // 4, or single entries beyond."""
    start, base = 0, 0
    while start < len(ends):
        stop = max(start + 1, int(np.searchsorted(ends, base + CHUNK // 4, side="right")))
        yield start, stop
        start, base = stop, int(ends[stop - 1])


def near_pairs(words: DataFrame, block: int | None = None) -> DataFrame:
    """(word, near, near_n) of every pair of (word, n) rows at edit distance one, both ways round."""
    staged = stage(with_vectors(words), "op11-vectors")
    block = block or max(BLOCK, staged.count() // MOST_BLOCKS)
    parts = dealt(stage(routed(staged, upper_paths(staged, block)), "op11-routes"), block)

    def run(group: pa.Table) -> pa.Table:
        state = group.column("state").to_numpy()
        own, asks = np.flatnonzero(state == OWN), np.flatnonzero(state != OWN)
        texts = letters(group.column("word"))
        words, questions = [texts[i] for i in own.tolist()], [texts[i] for i in asks.tolist()]
        found = list(block_pairs(words, questions))
        x = asks[np.concatenate([f[0] for f in found])] if found else asks[:0]
        w = own[np.concatenate([f[1] for f in found])] if found else own[:0]
        one, other = pa.array(np.concatenate([x, w])), pa.array(np.concatenate([w, x]))
        return pa.table({"word": group.column("word").take(one), "near": group.column("word").take(other), "near_n": group.column("n").take(other)})

    return parts.groupBy("block", "row", "column").applyInArrow(run, "word string, near string, near_n long")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form) rows: forms grow TIMES-fold at each step, so a few doublings reach the last one."""
    chain = stage(forms.select("word", F.col("form").alias("root")), "op11-roots")
    while True:
        onward = chain.select(F.col("word").alias("root"), F.col("root").alias("next"))
        further = chain.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        staged = stage(further, "op11-roots")
        chain = staged.select("word", "root")
        if not staged.where("moved").take(1):
            return chain


def variants(df: DataFrame, block: int | None = None) -> DataFrame:
    """Per distinct word of the texts of (doc_id, text): word, form, root, n, n_near, form_n.

    Words are runs of ASCII and Latin-1 letters, A-Z lower-cased; every run whose checksum with the document's id is divisible
    by SPARED first loses a letter. Near words are one insertion, deletion or replacement apart. A word's form is its most
    frequent near word (ties: smallest in code-point order) if that occurs TIMES as often; its root is the
    last of the chain of forms, the word itself without one. A null text has no words; a null id is read as an empty one. Rows that repeat
    count again. Without words, or for an empty table, there are no rows; extra columns are ignored.
    """
    words = stage(corpus_words(df), "op11-words")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near"))
    near = near_pairs(words, block).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    joined = words.join(near, "word", "left")
    common = -F.col("best.less") >= TIMES * F.col("n")
    out = stage(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(common, F.col("best.near")).alias("form"), F.when(common, -F.col("best.less")).alias("form_n")), "op11-forms")
    ends = roots(out.where("form IS NOT NULL"))
    return out.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


OP11_SQL = r"""
WITH RECURSIVE entries AS (
  SELECT list(list_reduce(list_concat([i::BIGINT], range(8)), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::BIGINT) ELSE a >> 1 END) ORDER BY i) AS t
  FROM range(256) r(i)),
runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{C0}-\x{FF}]{7,}')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
tagged AS (SELECT run, hex(encode(doc_id || ':' || run)) AS x FROM runs),
hashed AS (
  SELECT run, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(len(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT)),
    lambda a, b: xor(a >> 8, entries.t[(xor(a, b) & 255) + 1])), 4294967295::BIGINT) AS h
  FROM tagged, entries),
words AS (
  SELECT word, count(*) AS n
  FROM (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % len(run)) || substr(run, h % len(run) + 2) ELSE run END AS word FROM hashed)
  WHERE len(word) >= 7 GROUP BY word HAVING count(*) >= 2),
places AS (SELECT word, n, unnest(range(1, len(word) + 1)) AS i FROM words),
less AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM places),
longer AS (SELECT DISTINCT l.word, l.n, w.word AS near, w.n AS near_n FROM less l JOIN words w ON w.word = l.rest),
near AS (
  SELECT word, near, near_n FROM longer
  UNION ALL SELECT near, word, n FROM longer
  UNION ALL SELECT a.word, b.word, b.n FROM less a JOIN less b USING (rest, i) WHERE a.word <> b.word),
ranked AS (SELECT word, near, near_n, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS k, count(*) OVER (PARTITION BY word) AS n_near FROM near),
formed AS (
  SELECT words.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 10 * n THEN near END AS form, CASE WHEN near_n >= 10 * n THEN near_n END AS form_n
  FROM words LEFT JOIN ranked ON ranked.word = words.word AND k = 1),
walk AS (
  SELECT word, word AS here, form AS next FROM formed
  UNION ALL SELECT walk.word, walk.next, formed.form FROM walk JOIN formed ON formed.word = walk.next)
SELECT formed.word, form, here AS root, n, n_near, form_n FROM formed JOIN walk ON walk.word = formed.word AND walk.next IS NULL
"""


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))
