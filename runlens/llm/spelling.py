"""Spelling variants of words: near words by a relational trie frontier, forms and roots by frequency.

1. Words. Runs of letters are counted over all texts (combined before the shuffle); those with enough letters and occurrences
   are the words.
2. Edge table. Every prefix of a word, and of the word reversed, is a node; an edge (node, letter, child) says whether its child
   ends a word. The table is distributed and keyed by node.
3. Frontier. A state (word, position, node, edits) has read ``position`` letters of the word and stands at ``node``. Level by
   level, states join the edges of their node: without an edit they follow the next letter, or take any other edge as a replaced or
   an inserted letter, or skip a letter; with one edit they follow the next letter only. States at the end of their word with
   one edit, at a node that ends a word, are near words.
4. An edit lies in the second half of a word or, seen from the end, in the second half of the reversed one. So states
   start at the node of their first half: what they share with a word is read before anything fans out, and no state ever
   stands at the root, where all words would meet. A node has at most as many edges as there are letters.
5. Words of ``LONG`` letters or more, for which a level per letter would be too many, meet by hashes of what is left when one
   letter goes: words of one length that leave the same at the same place, and words that leave another word. Pairs are
   compared as words. Both ways overlap at the limit, so no pair is lost.

A word's form is its near word with the most occurrences, if it has ``times`` as many; roots follow forms by pointer doubling.

Nulls: a null text has no runs; a null id reads as an empty string. Ties between forms: the smallest in code-point order. Repeated
rows count as often as they are there. A very long text is read as one row; a very long run is a word like any other. Extra
columns don't matter, whatever their names. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Letters of runs after A-Z are lowered.
RUNS = r"[a-zÀ-ÿ]+"
#: Words of so many letters and more don't walk the trie.
LONG = 40


def typed_words(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", every: int = 199) -> DataFrame:
    """Rows (word, n): the runs of all texts; where ``every`` divides h = crc32(id:run), without their letter h % length."""
    own = docs.select(F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(":")).alias("own"), C.lowered(F.col(text)).alias("text"))
    runs = own.select("own", F.explode(F.regexp_extract_all("text", F.lit(RUNS), F.lit(0))).alias("run"))
    h, size = F.crc32(F.concat("own", "run").cast("binary")), F.char_length("run")
    at = (h % size).cast("int")
    less = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, size))
    return runs.select(F.when(h % every == 0, less).otherwise(F.col("run")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def near_words(words: DataFrame, long: int | None = None) -> DataFrame:
    """Rows (word, near) in both directions: distinct words that differ by exactly one inserted, deleted or replaced letter."""
    long = long or LONG
    words = C.cut(words.select("word").distinct())
    size = F.char_length("word")
    found = _frontier(words.where((size <= long) & (size > 0)))
    return found.unionByName(_by_deletion(words.where(size >= long))).distinct()


def _edges(words: DataFrame) -> DataFrame:
    """(node, letter, child, ends) of the words' trie and of that of the reversed words; a node's first letter tells which."""
    spelled = words.select(F.explode(F.array(F.concat(F.lit(">"), "word"), F.concat(F.lit("<"), F.reverse("word")))).alias("s"))
    size = F.char_length("s")
    # A word's near words stand no higher than (its letters - 1) / 2 when they fan out.
    steps = spelled.select("s", size.alias("size"), F.explode(F.sequence(F.expr("1 + (char_length(s) - 2) DIV 2"), size - 1)).alias("at"))
    made = steps.select(F.expr("substring(s, 1, at)").alias("node"), F.expr("substring(s, at + 1, 1)").alias("letter"), (F.col("at") + 1 == F.col("size")).alias("ends"))
    edges = made.groupBy("node", "letter").agg(F.max("ends").alias("ends"))
    return edges.select("node", "letter", F.concat("node", "letter").alias("child"), "ends")


def _frontier(words: DataFrame) -> DataFrame:
    edges = C.cut(_edges(words))
    half = (F.char_length("word") / 2).cast("int")
    ahead = words.select("word", F.concat(F.lit(">"), F.substring("word", F.lit(1), half)).alias("node"), F.substring("word", half + 1, F.char_length("word")).alias("rest"))
    back = words.select(F.reverse("word").alias("word"), (F.char_length("word") - half).alias("first"))
    back = back.select(F.reverse("word").alias("word"), F.concat(F.lit("<"), F.substring("word", F.lit(1), F.col("first"))).alias("node"), F.substring("word", F.col("first") + 1, F.char_length("word")).alias("rest"))
    # ``rest`` are the letters from the position on.
    state = ahead.unionByName(back).select("word", "node", "rest", F.lit(0).alias("edits"))
    # A word of three letters at most can lose its last one at once; whether that leaves a word is not said by an edge yet.
    left_over = F.when(F.char_length("rest") == 1, _spelled(F.col("node")))
    state = C.cut(state.join(words.select(F.col("word").alias("_word")), left_over == F.col("_word"), "left").withColumn("ends", F.col("_word").isNotNull()).drop("_word"))
    found = []
    while not state.isEmpty():
        next_, after = F.substring("rest", 1, 1), F.expr("substring(rest, 2)")
        left = F.char_length("rest")
        met = state.join(edges.withColumnRenamed("node", "_node").withColumnRenamed("ends", "_ends"), F.col("node") == F.col("_node"))
        same = (left > 0) & (F.col("letter") == next_)
        # An inserted letter like the next one, or a skipped one like the next, is the same word as one place further on.
        step = lambda rest, edits: F.struct(rest.alias("rest"), edits.alias("edits"))
        moves = F.when(same, F.array(step(after, F.col("edits")))).when(
            F.col("edits") == 0, F.when(left > 0, F.array(step(after, F.lit(1)), step(F.col("rest"), F.lit(1)))).otherwise(F.array(step(F.col("rest"), F.lit(1))))
        )
        moved = met.where(same | (F.col("edits") == 0)).select("word", F.col("child").alias("node"), F.col("_ends").alias("ends"), F.explode(moves).alias("m")).select("word", "node", "m.rest", "m.edits", "ends")
        skipped = state.where((F.col("edits") == 0) & (left > 0) & (next_ != F.expr("substring(rest, 2, 1)"))).select("word", "node", after.alias("rest"), F.lit(1).alias("edits"), "ends")
        reached = C.cut(moved.unionByName(skipped))
        over = (F.col("edits") == 1) & (F.char_length("rest") == 0)
        found.append(reached.where(over & F.col("ends")).select("word", "node"))
        state = reached.where(~over)
    pairs = found[0] if found else state.select("word", "node")
    for more in found[1:]:
        pairs = pairs.unionByName(more)
    return pairs.select("word", _spelled(F.col("node")).alias("near"))


def _spelled(node: Column) -> Column:
    letters = F.substring(node, F.lit(2), F.char_length(node))
    return F.when(node.startswith(">"), letters).otherwise(F.reverse(letters))


def _by_deletion(words: DataFrame) -> DataFrame:
    """(word, near) by hashes of every word less one letter; a row for each letter, computed from running sums."""

    def less(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, word in enumerate(batch.column(1).to_pylist()):
                whole, gone = _deletion_codes(word)
                for first in range(0, len(gone), 100_000):
                    part = gone[first : first + 100_000]
                    ids = pa.array(np.full(len(part), batch.column(0)[i].as_py()), pa.int64())
                    at = pa.array(np.arange(first, first + len(part)))
                    yield pa.RecordBatch.from_arrays([ids, at, pa.array(C.signed(part)), pa.array(np.full(len(part), whole).view(np.int64))], ["id", "at", "code", "whole"])

    named = C.cut(words.select(F.xxhash64("word").alias("id"), "word"))
    codes = C.cut(named.mapInArrow(less, "id long, at long, code long, whole long"))
    x, y = codes.alias("x"), codes.alias("y")
    replaced = x.join(y, (F.col("x.code") == F.col("y.code")) & (F.col("x.at") == F.col("y.at")) & (F.col("x.id") < F.col("y.id"))).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))
    whole = codes.where("at = 0").select(F.col("id").alias("b"), F.col("whole").alias("code"))
    shorter = codes.join(whole, "code").select(F.col("id").alias("a"), "b")
    asked = replaced.unionByName(shorter).where("a <> b").distinct()
    pairs = asked.join(named.select(F.col("id").alias("a"), F.col("word").alias("u")), "a").join(named.select(F.col("id").alias("b"), F.col("word").alias("v")), "b")
    pairs = C.cut(pairs.where(F.levenshtein("u", "v", 1) == 1).select("u", "v"))
    return pairs.select(F.col("u").alias("word"), F.col("v").alias("near")).unionByName(pairs.select(F.col("v").alias("word"), F.col("u").alias("near")))


def _deletion_codes(word: str) -> tuple[np.uint64, np.ndarray]:
    """(code of the word, code of the word less its letter i, for every i): sums of letter codes times powers of a base."""
    points = np.frombuffer(word.encode("utf-32-le"), np.uint32).astype(np.uint64)
    with np.errstate(over="ignore"):
        letters = C.mix(points + np.uint64(1))
        powers = np.cumprod(np.full(len(points), C._BASE, np.uint64), dtype=np.uint64)
        here, earlier = letters * powers, np.concatenate([np.ones(1, np.uint64), powers[:-1]])
        shifted = letters * earlier
        before = np.cumsum(here, dtype=np.uint64) - here
        after = np.cumsum(shifted[::-1], dtype=np.uint64)[::-1] - shifted
        return C.mix(here.sum(dtype=np.uint64) + np.uint64(len(points))), C.mix(before + after + np.uint64(max(len(points) - 1, 0)))


def spelling_groups(words: DataFrame, times: int = 5, long: int | None = None) -> DataFrame:
    """One row per word of ``words`` (word, n): word, form, root, n, n_near, form_n."""
    words = C.cut(words.select("word", F.col("n").cast("long").alias("n")))
    near = near_words(words, long)
    known = words.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    # Strings compare by their UTF-8 bytes, which is code-point order.
    best = near.join(known, "near").groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("o"), F.col("near").alias("near"))).alias("best"))
    enough = -F.col("best.o") >= times * F.col("n")
    formed = C.cut(
        words.join(best, "word", "left")
        .select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(enough, F.col("best.near")).alias("form"), F.when(enough, -F.col("best.o")).alias("form_n"))
    )
    return formed.join(_roots(formed), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _roots(formed: DataFrame) -> DataFrame:
    """(word, root) of words with a form. Occurrences grow along forms, so they end; each round doubles the way."""
    state = C.cut(formed.where("form IS NOT NULL").select("word", F.col("form").alias("root"), F.lit(True).alias("moved")))
    while not state.where("moved").isEmpty():
        on = state.select(F.col("word").alias("_w"), F.col("root").alias("_r"))
        state = C.cut(state.join(on, F.col("root") == F.col("_w"), "left").select("word", F.coalesce("_r", "root").alias("root"), F.col("_r").isNotNull().alias("moved")))
    return state.select("word", "root")
