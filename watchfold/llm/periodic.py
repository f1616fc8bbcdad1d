"""Periodic runs of words inside a text, by descending-LCP Kruskal over suffix classes.

A run is a stretch of consecutive words with smallest period q (words q apart are equal), at least `min_length`
words and `min_exponent` periods long, that no neighbouring word extends.

Method, inside one text: suffixes are sorted by prefix doubling and neighbours in that order get the length of their
common prefix (LCP). Neighbours are united by decreasing LCP; a class of suffixes that agree in l words is a set of
positions in ascending order. When two classes are united at level l, the smaller one's positions go into the larger
one; positions i < j that become neighbours there agree in exactly l words. If j - i <= l, the words from i to
j + l have period j - i: a seed. That period is the smallest one, since a smaller one would have put a position between
them at a higher level. The right end is where the agreement ends, and a seed starts its run when the words
before i and j differ; so each run has exactly one such seed and no run is found twice.

Only suffixes that share enough words for a wanted run (five with the defaults) are sorted further, compared and united; ordinary
prose has few of them. Unions insert the smaller class into the larger one: n log n insertions into blocked lists.

Jobs: one pass over the documents, no shuffle. Texts are worked on in slices of about SLICE_WORDS words, a longer text
alone; its arrays are proportional to its words.

Edge cases: a null, empty or wordless text has no runs and an empty collapsed text. A null doc_id stays null.
Repeated rows give repeated result rows, an empty table an empty result. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import defaultdict
from functools import partial
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from watchfold.llm.registry import query, table

MIN_LENGTH = 6
MIN_EXPONENT = 4
SLICE_WORDS = 1 << 18
BLOCK = 1024
RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


class Positions:
    """Ascending positions in blocks, so that an insertion moves at most one block."""

    def __init__(self, first: int):
        self.blocks, self.firsts, self.size = [[first]], [first], 1

    def __iter__(self):
        for block in self.blocks:
            yield from block

    def add(self, x: int) -> tuple[int | None, int | None]:
        """Insert x, return its neighbours."""
        k = max(bisect_right(self.firsts, x) - 1, 0)
        block = self.blocks[k]
        at = bisect_left(block, x)
        before = block[at - 1] if at else self.blocks[k - 1][-1] if k else None
        after = block[at] if at < len(block) else self.blocks[k + 1][0] if k + 1 < len(self.blocks) else None
        block.insert(at, x)
        self.firsts[k] = block[0]
        self.size += 1
        if len(block) > BLOCK:
            half = BLOCK // 2
            self.blocks[k:k + 1] = [block[:half], block[half:]]
            self.firsts[k:k + 1] = [block[0], block[half]]
        return before, after


def least_lcp(min_length: int, min_exponent: int) -> int:
    """Smallest LCP that a wanted run can have: a run of period q spans q + LCP words."""
    return min(max((min_exponent - 1) * q, min_length - q) for q in range(1, min_length + 1))


def suffix_order(words: np.ndarray, ends: np.ndarray, shared: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, tied): suffix positions in sorted order, and whether each agrees with the one before it in at least `shared` words.

    words: word numbers of several texts one after the other, each text with numbers of its own; ends: end of the
    text a position belongs to. `shared` must be a power of two. Suffixes sharing fewer words are left unordered.
    """
    n = len(words)
    order = np.argsort(words, kind="stable")
    first = np.r_[True, words[order[1:]] != words[order[:-1]]][:n]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    tied = ~first
    open_at = np.flatnonzero(tied | np.r_[tied[1:], False][:n])
    k = 1
    while len(open_at):
        at = order[open_at]
        ahead = at + k
        inside = ahead < ends[at]
        key = rank[at] * (n + 1) + np.where(inside, rank[np.minimum(ahead, n - 1)] + 1, 0)
        turn = np.argsort(key, kind="stable")
        at, key = at[turn], key[turn]
        order[open_at] = at
        new = np.r_[True, key[1:] != key[:-1]]
        rank[at] = np.maximum.accumulate(np.where(new, open_at, 0))
        k *= 2
        if k <= shared:
            tied = np.zeros(n, bool)
            tied[open_at] = ~new
        open_at = open_at[~new | ~np.r_[new[1:], True]]
    return order, tied if k >= shared else np.zeros(n, bool)


def common_prefixes(words: list[int], at: list[int], before: list[int], end: list[int]) -> list[int]:
    """LCP of the suffixes at[x] and before[x], `at` ascending: a suffix shares at most one word less than the one before it in the text."""
    out, h, last = [], 0, -2
    for i, j, e in zip(at, before, end):
        h = h - 1 if i == last + 1 and h else 0
        room = e - (i if i > j else j)
        while h < room and words[i + h] == words[j + h]:
            h += 1
        out.append(h)
        last = i
    return out


def seeds(words: list[int], starts: dict | set, edges: list[tuple[int, int, int]], position: list[int], min_length: int, min_exponent: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run. edges: (LCP, a, b) by decreasing LCP, a and b being node numbers;
    position: text position of each node; starts: first positions of the texts."""
    parent = list(range(len(position)))
    members: list[Positions | None] = [None] * len(position)
    found = []

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def seed(i, j, lcp):
        period = j - i
        if (min_exponent - 1) * period <= lcp and period + lcp >= min_length and (i in starts or words[i - 1] != words[j - 1]):
            found.append((i, period + lcp, period))

    for lcp, a, b in edges:
        a, b = root(a), root(b)
        big, small = members[a], members[b]
        if (big.size if big else 1) < (small.size if small else 1):
            a, b, big, small = b, a, small, big
        if big is None:
            big = members[a] = Positions(position[a])
        parent[b], members[b] = a, None
        moving = list(small) if small else [position[b]]
        last = None
        for x, coming in zip(moving, [*moving[1:], None]):
            before, after = big.add(x)
            if before is not None and before != last:
                seed(before, x, lcp)
            if after is not None and (coming is None or coming > after):
                seed(x, after, lcp)
            last = x
    return found


def runs_of(texts: list[list[bytes]], min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> list[list[tuple[int, int, int]]]:
    """Runs (start, length, period) of each text's words, by start and period."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    total = int(lengths.sum())
    if not total:
        return [[] for _ in texts]
    numbers = np.empty(total, np.int64)
    ends = np.cumsum(lengths)
    base = 0
    for words, end in zip(texts, ends.tolist()):  # numbers of its own for each text, so that suffixes of two texts never agree
        number = defaultdict(count(base).__next__)
        numbers[end - len(words):end] = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
        base += len(number)
    least = least_lcp(min_length, min_exponent)
    order, tied = suffix_order(numbers, np.repeat(ends, lengths), 1 << (least.bit_length() - 1))
    later = np.flatnonzero(tied)
    if not len(later):
        return [[] for _ in texts]
    at, before = order[later], order[later - 1]
    text_of = np.searchsorted(ends, at, side="right")
    turn = np.argsort(at, kind="stable")
    words = numbers.tolist()
    lcp = np.empty(len(at), np.int64)
    lcp[turn] = common_prefixes(words, at[turn].tolist(), before[turn].tolist(), ends[text_of[turn]].tolist())
    keep = np.flatnonzero(lcp >= least)
    nodes, pair = np.unique(np.concatenate([later[keep] - 1, later[keep]]), return_inverse=True)
    fall = np.argsort(-lcp[keep], kind="stable")
    left, right = pair[:len(keep)], pair[len(keep):]
    edges = zip(lcp[keep][fall].tolist(), left[fall].tolist(), right[fall].tolist())
    first = (ends - lengths).tolist()
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    found = sorted((start, period, length) for start, length, period in seeds(words, set(first), edges, order[nodes].tolist(), min_length, min_exponent))
    for (start, period, length), text in zip(found, np.searchsorted(ends, [f[0] for f in found], side="right").tolist()):
        out[text].append((start - first[text], length, period))
    return out


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined by spaces, without those that stand in a run after its first period."""
    if not runs:
        return b" ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    kept = np.flatnonzero(np.cumsum(change[:-1]) == 0)
    return b" ".join([words[k] for k in kept.tolist()])


def _run_batches(batches, min_length, min_exponent):
    schema = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def done(ids, texts):
        runs = runs_of(texts, min_length, min_exponent)
        offsets = np.cumsum([0, *map(len, runs)]).astype(np.int32)
        flat = np.array([r for own in runs for r in own], np.int64).reshape(-1, 3)
        values = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], ["start", "length", "period"])
        lists = pa.ListArray.from_arrays(pa.array(offsets), values).cast(schema)
        texts = pa.array([collapsed(w, r) for w, r in zip(texts, runs)], pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([ids, lists, texts], ["doc_id", "runs", "collapsed"])

    for batch in batches:
        held, n, begin = [], 0, 0
        for k, text in enumerate(batch.column(1).cast(pa.binary())):
            words = (text.as_py() or b"").split()  # bytes.split knows ASCII only: space and x09-x0D
            held.append(words)
            n += len(words)
            if n >= SLICE_WORDS:
                yield done(batch.column(0)[begin:k + 1], held)
                held, n, begin = [], 0, k + 1
        if held:
            yield done(batch.column(0)[begin:], held)


def periodic_runs(docs: DataFrame, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> DataFrame:
    """(doc_id, runs, collapsed) for every row: runs by start and period, and the text without repeated periods."""
    if min_exponent < 2 or min_length < 2:
        raise ValueError("a run has at least two periods and two words")
    kind = docs.schema["doc_id"].dataType.simpleString()
    work = partial(_run_batches, min_length=min_length, min_exponent=min_exponent)
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(work, f"doc_id {kind}, runs {RUNS}, collapsed string")


def longest(runs: Column) -> Column:
    """The run of greatest length, ties by smallest start, then period; null without runs."""
    best = F.array_min(F.transform(runs, lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p"))))
    return F.struct(best["s"].alias("start"), (-best["l"]).alias("length"), best["p"].alias("period"))


def looped(docs: DataFrame) -> DataFrame:
    """`docs` (doc_id, text) with the loops that the query's contract plants in every tenth document by crc32."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    rows = docs.select("doc_id", "text", h.alias("__h"), F.when(h % 10 == 0, words).alias("__words"))
    n = F.size("__words")
    g = F.floor(F.col("__h") / 10)
    shape = rows.select("*", n.alias("__n"), F.when(n > 0, (g % n).cast("int")).alias("__a"), (g % 8 + 3).alias("__d"))
    rest = F.col("__n") - F.col("__a")
    period = (F.floor(rest / F.col("__d")) + 1).cast("int")
    cycle = F.flatten(F.array_repeat(F.slice("__words", F.col("__a") + 1, period), F.ceil(rest / period).cast("int")))
    text = F.array_join(F.concat(F.slice("__words", F.lit(1), F.col("__a")), F.slice(cycle, F.lit(1), rest)), " ")
    return shape.select("doc_id", F.when(F.col("__n") > 0, text).otherwise(F.col("text")).alias("text"))


@query("op11_periodic")
def op11_periodic(spark, sf_dir):
    found = periodic_runs(looped(table(spark, sf_dir, "documents"))).withColumn("best", longest(F.col("runs")))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
