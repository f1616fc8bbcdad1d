"""Spelling variants: words one edit apart, found by blocked Gram matrices of letter counts.

Two words are near if they differ by exactly one inserted, deleted or replaced code point. A word's form is its near word of
largest count (ties: smallest in code-point order), if that count is at least `ratio` times the word's own; its root is the last word reached over forms.

Method: words lie in blocks of one length. The squared distance between the letter counts of two words is at most two if they are near, so
blocks of equal or adjacent lengths are multiplied (NumPy products of count matrices give all squared distances of two blocks), pairs
at most two apart are kept, and their edits are verified on the code points. To keep the products few, the letters are dealt into
groups and a block holds words with equal counts in every group: one edit moves a block's counts by one in one group (inserted,
deleted) or in two (replaced) or not at all, so a block meets only those neighbours. More groups make smaller blocks; their number
follows the logarithm of the vocabulary and changes no result. A block above BLOCK_WORDS words is split, and its parts meet one by one.

Jobs: documents send words with partial counts, summed by word; blocks are one row each and meet by an equi-join on block and
part; the products run in those tasks. Counts of near words and best forms are partial aggregates. A form's count is at least `ratio` times the word's, so
a chain has at most log(2^63) / log(ratio) links; roots come by pointer doubling.

Edge cases: null and empty texts have no words. Repeated rows count again. A null doc_id is read as an empty one. An empty table gives an empty result.
Letters outside a-z and U+00C0-U+00FF end a word. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from watchfold.llm.registry import query, table
from watchfold.session import Scratch

MIN_CHARS = 6
MIN_COUNT = 5
RATIO = 5
NOISE = 199
BLOCK_WORDS = 2048
BLOCK_CHARS = 1 << 20
HELD_WORDS = 1 << 18
LETTERS = "".join(map(chr, [*range(0x61, 0x7B), *range(0xC0, 0x100)]))
UPPER_TO_LOWER = {c: c + 32 for c in range(0x41, 0x5B)}
_DIMENSION = np.full(256, -1)
_DIMENSION[np.frombuffer(LETTERS.encode("latin-1"), np.uint8)] = np.arange(len(LETTERS))


def noisy_words(doc_id, text: str | None, min_chars: int, noise: int | None) -> Counter:
    """Words of at least `min_chars` code points with their counts; of one in `noise` (document, word) pairs a code point is left out."""
    runs = Counter(re.findall(f"[A-Za-zÀ-ÿ]{{{min_chars},}}", text or ""))
    lower: Counter = Counter()
    for run, n in runs.items():
        lower[run.translate(UPPER_TO_LOWER)] += n
    if noise is None:
        return lower
    seed = zlib.crc32(b"%s:" % str("" if doc_id is None else doc_id).encode())
    out: Counter = Counter()
    for word, n in lower.items():
        h = zlib.crc32(word.encode(), seed)
        if h % noise == 0:
            cut = h % len(word)
            word = word[:cut] + word[cut + 1:]
            if len(word) < min_chars:
                continue
        out[word] += n
    return out


def _count_batches(batches, min_chars, noise):
    held: Counter = Counter()

    def flushed():
        out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
        held.clear()
        return out

    for batch in batches:
        for doc_id, text in zip(batch.column(0), batch.column(1)):
            for word, n in noisy_words(doc_id.as_py(), text.as_py(), min_chars, noise).items():
                held[word] += n
            if len(held) >= HELD_WORDS:
                yield flushed()
    yield flushed()


def vocabulary(docs: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, noise: int | None = None) -> DataFrame:
    """(word, n): words of whole texts that occur often enough."""
    rows = docs.select(F.col("doc_id").cast("string"), F.col("text").cast("string"))
    partial_counts = rows.mapInArrow(partial(_count_batches, min_chars=min_chars, noise=noise), "word string, n long")
    return partial_counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def letter_counts(words: np.ndarray) -> np.ndarray:
    """(words, letters) counts of a matrix of Latin-1 code points, one row for each word."""
    n, width = words.shape
    dims = len(LETTERS)
    where = np.arange(n)[:, None] * dims + _DIMENSION[words]
    return np.bincount(where.ravel(), minlength=n * dims).reshape(n, dims)


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether row x of `a` and row x of `b` are one edit apart; b's rows are as long as a's or one longer."""
    width = a.shape[1]
    same = a == b[:, :width]
    if b.shape[1] == width:
        return (~same).sum(axis=1) == 1
    head = np.where(same.all(axis=1), width, (~same).argmax(axis=1))
    back = (a == b[:, 1:])[:, ::-1]
    tail = np.where(back.all(axis=1), width, (~back).argmax(axis=1))
    return head + tail >= width


def near_rows(a: np.ndarray, b: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Rows (i, j) of two matrices of code points that are one edit apart; `same`: a and b are one block, i < j."""
    kind = np.float32 if max(a.shape[1], b.shape[1]) < 2000 else np.float64  # squares stay exact
    x, y = letter_counts(a).astype(kind), letter_counts(b).astype(kind)
    used = np.flatnonzero(x.any(axis=0) & y.any(axis=0))
    square = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :] - 2 * (x[:, used] @ y[:, used].T)
    i, j = np.nonzero(square <= 2)
    if same:
        i, j = i[i < j], j[i < j]
    parts = [slice(k, k + (1 << 16)) for k in range(0, len(i), 1 << 16)]
    good = np.concatenate([one_edit(a[i[p]], b[j[p]]) for p in parts]) if parts else np.empty(0, bool)
    return i[good], j[good]


def _product_batches(batches):
    names = ["word", "n", "near", "near_n"]
    for batch in batches:
        for row in range(batch.num_rows):
            cell = lambda c: batch.column(c)[row]
            sides = []
            for side in ("a", "b"):
                words = np.frombuffer(cell(f"{side}_words").as_py(), np.uint8)
                counts = cell(f"{side}_n").values.to_numpy()
                sides.append((words.reshape(len(counts), -1), counts))
            (a, n_a), (b, n_b) = sides
            i, j = near_rows(a, b, cell("same").as_py())
            if not len(i):
                continue
            text = lambda m, at: [w.tobytes().decode("latin-1") for w in m[at]]
            left, right = text(a, i), text(b, j)
            yield pa.RecordBatch.from_arrays([pa.array(left + right), pa.array(np.r_[n_a[i], n_b[j]]), pa.array(right + left), pa.array(np.r_[n_b[j], n_a[i]])], names)


def group_number(size: int) -> int:
    """Letter groups for a vocabulary: a third of its binary logarithm, so that blocks grow slowly with it."""
    return min(12, max(2, round(math.log2(max(size, 2)) / 3)))


def near_pairs(words: DataFrame, groups: int, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(word, n, near, near_n): every near word of every word. words: (word, n), distinct."""
    letters = [LETTERS[g::groups] for g in range(groups)]
    counts = F.array(*[F.length("word") - F.length(F.translate("word", own, "")) for own in letters])
    celled = words.select("word", "n", counts.alias("cell"), F.length("word").alias("width"))
    rows = F.greatest(F.lit(1), F.least(F.lit(block_words), F.floor(F.lit(BLOCK_CHARS) / F.col("width"))))
    cells = celled.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / F.min(rows)).cast("int").alias("parts"))
    placed = celled.join(cells, "cell").withColumn("part", F.pmod(F.xxhash64("word"), F.col("parts")).cast("int"))
    packed = placed.groupBy("cell", "part").agg(F.collect_list(F.struct("word", "n")).alias("own"))
    blocks = packed.select("cell", "part", F.encode(F.array_join(F.col("own.word"), ""), "ISO-8859-1").alias("words"), F.col("own.n").alias("n"))
    blocks = Scratch(words.sparkSession, "blocks").table(blocks)
    moves = [[0] * groups]
    for g in range(groups):
        moves.append([int(x == g) for x in range(groups)])
        moves += [[int(x == g) - int(x == h) for x in range(groups)] for h in range(g + 1, groups)]
    # each unordered pair of neighbouring blocks once: the move's first changed group goes up
    moved = blocks.select("cell", "part", "words", "n", F.explode(F.array(*[F.array(*[F.lit(v) for v in m]) for m in moves])).alias("move"))
    target = moved.withColumn("to", F.zip_with("cell", "move", lambda c, m: c + m)).where(~F.exists("to", lambda c: c < 0)).drop("move")
    known = cells.select(F.col("cell").alias("to"), "parts")
    aimed = target.join(known, "to").select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("to_part"))
    own = F.col("cell") == F.col("to")
    aimed = aimed.where(~own | (F.col("to_part") >= F.col("part")))
    right = blocks.select(F.col("cell").alias("to"), F.col("part").alias("to_part"), F.col("words").alias("b_words"), F.col("n").alias("b_n"))
    met = aimed.join(right, ["to", "to_part"])
    # longer words stand on side b: a move that adds a letter leads there, the others keep the length
    pairs = met.select((own & (F.col("part") == F.col("to_part"))).alias("same"), F.col("words").alias("a_words"), F.col("n").alias("a_n"), "b_words", "b_n")
    return pairs.mapInArrow(_product_batches, "word string, n long, near string, near_n long")


def variant_groups(words: DataFrame, ratio: int = RATIO, groups: int | None = None, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(word, n, form, form_n, root, n_near) for every word of (word, n)."""
    if ratio < 2:
        raise ValueError("forms must be clearly more frequent than their variants, or chains need not end")
    scratch = Scratch(words.sparkSession, "variants")
    words, (size,) = scratch.table(words.select("word", "n"), F.count(F.lit(1)))
    pairs = near_pairs(words, groups or group_number(size), block_words)
    best = pairs.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form"))).alias("b"))
    judged = words.join(best, "word", "left")
    formed = -F.col("b.less") >= ratio * F.col("n")
    judged = scratch.table(judged.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(formed, F.col("b.form")).alias("form"), F.when(formed, -F.col("b.less")).alias("form_n")))
    chain = judged.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    for _ in range(max(1, math.ceil(math.log2(63 / math.log2(ratio))))):
        ahead = chain.select(F.col("word").alias("root"), F.col("root").alias("next"))
        chain, (moved,) = scratch.table(chain.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("on")), F.count_if("on"))
        chain = chain.drop("on")
        if not moved:
            break
    return judged.join(chain, "word", "left").select("word", "n", "form", "form_n", F.coalesce("root", "word").alias("root"), "n_near")


@query("op13_variants")
def op13_variants(spark, sf_dir):
    words = vocabulary(table(spark, sf_dir, "documents"), noise=NOISE)
    return variant_groups(words).select("word", "form", "root", "n", "n_near", "form_n")
