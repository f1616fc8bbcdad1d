"""Near-duplicates of a corpus: five-word shingles, Jaccard similarity of at least 0.8, links checked exactly.

The candidates of the first pass come from the bit-sliced SimHash of `simhash`: texts of equal or near fingerprints. At a Jaccard similarity of 0.8
two 64-bit SimHashes differ in about 10 bits (15 %), some pairs in 18: no choice of left-out bytes finds these. MinHash adds the candidates beyond that radius: `BANDS` keys of `ROWS` minima each. A pair at similarity s shares a
key with probability 1 - (1 - s^ROWS)^BANDS, at s = 0.8 all but 5 in 1,000,000. Every link is checked on the whole shingle sets.

Texts with equal shingle sets (by a 64-bit hash of the set) are one node. A key's nodes are first checked against its smallest node, one pair for each node.
A key whose nodes then still lie in different components is compared as a whole, in blocks of bounded size: two near sets share one of their rarest
shingles, so that only such nodes of different components are checked, and only links leave a block. The components are those of
all links among the candidates.

Edge cases: words as in simhash (ASCII lower case, ASCII white space). A text with fewer words than a shingle has is one shingle; null and wordless texts
have an empty set and are equal. An empty table gives an empty result. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window as W, functions as F

from watchfold.llm import simhash
from watchfold.llm.common import spread_join
from watchfold.operators.graph import connected_components
from watchfold.session import Scratch

SHINGLE_WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 40, 6
RUN_VALUES = 1 << 19  # shingles of one block of a key
SEED = 42
_random = np.random.default_rng(SEED)
FACTORS = (_random.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint64) | 1).astype(np.uint32)[:, None]
SHIFTS = _random.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint64).astype(np.uint32)[:, None]


def shingle_set(text: bytes | None, words_per_shingle: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of one UTF-8 text."""
    words = text.lower().split() if text else []
    if not words:
        return np.empty(0, "<u8")
    shingles = map(b" ".join, zip(*[words[k:] for k in range(words_per_shingle)])) if len(words) >= words_per_shingle else [b" ".join(words)]
    return np.unique(np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=SEED), shingles), "<u8", max(1, len(words) - words_per_shingle + 1)))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band."""
    if not len(hashes):
        return np.zeros(0, "<i8")
    short, low = (hashes >> np.uint64(32)).astype(np.uint32), None
    for at in range(0, len(short), 512):  # stays in the processor's cache; bounded memory for very long texts
        part = (short[None, at:at + 512] * FACTORS + SHIFTS).min(1)
        low = part if low is None else np.minimum(low, part)
    return np.fromiter((xxhash.xxh64_intdigest(band.tobytes(), seed=k) for k, band in enumerate(low.reshape(BANDS, ROWS))), "<u8", BANDS).view("<i8")


def _key_batches(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            sets = [shingle_set(t.as_py()) for t in part.column(1).cast(pa.binary())]
            keys = pa.array([xxhash.xxh64_intdigest(s.tobytes(), seed=SEED) for s in sets], pa.uint64()).to_numpy().view("<i8")
            prints = np.fromiter((simhash.fingerprint(t.as_py()) for t in part.column(1).cast(pa.binary())), "<u8", part.num_rows).view("<i8")
            bands = [band_keys(s) for s in sets]
            values = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, bands)]), pa.int32()), pa.array(np.concatenate(bands), pa.int64()))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(keys), pa.array(prints), pa.array([len(s) for s in sets], pa.int64()), values],
                                             ["doc_id", "tie", "node", "fp", "size", "bands"])


def _set_batches(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            sets = [shingle_set(t.as_py()).view("<i8") for t in part.column(1).cast(pa.binary())]
            values = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sets)]), pa.int32()), pa.array(np.concatenate(sets), pa.int64()))
            yield pa.RecordBatch.from_arrays([part.column(0), values], ["node", "set"])


def near_links(pairs: DataFrame, sets: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(src, dst): the pairs whose shingle sets have at least this Jaccard similarity."""
    side = lambda end: sets.select(F.col("node").alias(end), F.col("set").alias(f"{end}_set"))
    both = pairs.join(side("src"), "src").join(side("dst"), "dst")
    common = F.size(F.array_intersect("src_set", "dst_set"))
    return both.where(common >= similarity * (F.size("src_set") + F.size("dst_set") - common)).select("src", "dst")


def print_pairs(prints: DataFrame, radius: int = simhash.RADIUS) -> DataFrame:
    """(src, dst): nodes of equal fingerprints with the smallest such node, and these smallest nodes of fingerprints with the one that spans their run. prints:
    distinct node, fp."""
    heads = prints.groupBy("fp").agg(F.min("node").alias("head"))
    equal = prints.join(heads, "fp").select(F.col("node").alias("src"), F.col("head").alias("dst"))
    links = simhash.near_links(heads.select("fp"), radius)
    end = lambda name: heads.select(F.col("fp").alias(name), F.col("head").alias(f"{name}_node"))
    near = links.join(end("src"), "src").join(end("dst"), "dst").select(F.col("src_node").alias("src"), F.col("dst_node").alias("dst"))
    return equal.unionByName(near).where("src <> dst").distinct()


def near_rows(values: np.ndarray, starts: np.ndarray, part: np.ndarray, block: np.ndarray, similarity: float) -> tuple[list[int], list[int]]:
    """Rows (i, j) that link the parts as all near pairs of rows do, one link for each union of parts.

    Row i holds the distinct values[starts[i]:starts[i + 1]]. Near sets share one of their rarest values: of s values, at least
    similarity * s are common, so that one of the first s - ceil(similarity * s) + 1 is. If there are two blocks, only pairs between them are compared.
    """
    sizes = np.diff(starts)
    row = np.repeat(np.arange(len(sizes)), sizes)
    _, code, count = np.unique(values, return_inverse=True, return_counts=True)
    code = code[np.lexsort((code, count[code], row))]  # each row's values, rarest first
    prefix = np.arange(len(code)) - starts[row] <= sizes[row] - np.ceil(similarity * sizes[row] - 1e-9)
    prefix &= count[code] > 1
    held_code, held_row = code[prefix], row[prefix]
    by_code = np.argsort(held_code, kind="stable")
    posted, first = held_row[by_code], np.searchsorted(held_code[by_code], np.arange(len(count) + 1))
    of_row = np.searchsorted(held_row, np.arange(len(sizes) + 1))
    part, across, marked = part.copy(), len(np.unique(block)) > 1, np.zeros(len(count), bool)
    left, right = [], []
    for i in range(len(sizes)):
        own = held_code[of_row[i]:of_row[i + 1]]
        if not len(own):
            continue
        met = np.unique(np.concatenate([posted[first[c]:first[c + 1]] for c in own]))
        met = met[(met > i) & (part[met] != part[i])]
        met = met[np.minimum(sizes[met], sizes[i]) >= similarity * np.maximum(sizes[met], sizes[i])]
        if across:
            met = met[block[met] != block[i]]
        if not len(met):
            continue
        marked[code[starts[i]:starts[i + 1]]] = True
        for j in met:
            if part[j] != part[i]:
                common = np.count_nonzero(marked[code[starts[j]:starts[j + 1]]])
                if common >= similarity * (sizes[i] + sizes[j] - common):
                    left.append(i), right.append(j)
                    part[part == part[j]] = part[i]
        marked[code[starts[i]:starts[i + 1]]] = False
    return left, right


def _run_table(rows: pa.Table, similarity: float) -> pa.Table:
    sets, node = rows["set"].combine_chunks(), rows["node"].to_numpy()
    starts = sets.offsets.to_numpy().astype(np.int64)
    left, right = near_rows(sets.values.to_numpy()[starts[0]:starts[-1]], starts - starts[0], rows["part"].to_numpy(), rows["block"].to_numpy(), similarity)
    return pa.table({"src": node[np.array(left, int)], "dst": node[np.array(right, int)]})


def run_links(members: DataFrame, sets: DataFrame, similarity: float = SIMILARITY, room: int = RUN_VALUES) -> DataFrame:
    """(src, dst): links between the parts of each key. members: key, node, size, part.

    A key whose nodes are all of one part has nothing to add, and of keys with the same nodes one is compared. A key with more than
    `room` shingles is cut into blocks, and every two blocks meet in a group of their own: no task holds more than two blocks. Pairs never leave a group
    unless they are links.
    """
    name = [F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"), F.count(F.lit(1)).alias("of")]
    whole = members.groupBy("key").agg(F.min("part").alias("a"), F.max("part").alias("b"), F.sum("size").alias("load"), *name)
    open_keys = whole.where("a <> b").groupBy("x", "y", "of").agg(F.min("key").alias("key"), F.min("load").alias("load")).select("key", F.ceil(F.col("load") / room).cast("int").alias("n"))
    own = members.join(open_keys, "key").withColumn("block", F.pmod(F.xxhash64("node"), F.col("n")).cast("int"))
    dealt = own.withColumn("other", F.explode(F.expr("sequence(0, n - 1)"))).select(
        "key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "node", "part")

    def one(rows: pa.Table) -> pa.Table:
        return _run_table(rows, similarity)

    return dealt.join(sets, "node").groupBy("key", "low", "high").applyInArrow(one, "src long, dst long")


def _labelled(docs: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame, int]:
    """Rows (doc_id, tie, node), nodes (node, n, component_id, component_tie) and the number of rows.

    A component is represented by its smallest doc_id and, where several of its texts share that, the smallest text hash (tie).
    """
    scratch = Scratch(docs.sparkSession, "neardup")
    kind, text = docs.schema["doc_id"].dataType.simpleString(), F.col("text").cast("string")
    tied = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("tie"))
    rows = scratch.table(tied.mapInArrow(_key_batches, f"doc_id {kind}, tie long, node long, fp long, size long, bands array<long>"))
    named = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "tie")))
    grouped = rows.groupBy("node").agg(named.alias("first"), F.min("tie").alias("least"), F.count(F.lit(1)).alias("n"),
                                       F.first("size").alias("size"), F.first("bands").alias("bands"))
    firsts, (n,) = scratch.table(grouped.select("node", F.col("first.doc_id").alias("first_id"), F.coalesce("first.tie", "least").alias("tie"), "n", "size", "bands"), F.sum("n"))
    dealt = firsts.select("node", "size", F.explode("bands").alias("key"))
    keys = dealt.groupBy("key").agg(F.min(F.struct("node", "size")).alias("low"), F.count(F.lit(1)).alias("of")).where("of > 1").select("key", "low")
    shared = scratch.table(dealt.join(keys, "key"))
    alike = lambda a, b: F.least(a, b) >= similarity * F.greatest(a, b)  # else the sets cannot be near
    star = shared.where("node <> low.node").where(alike(F.col("size"), F.col("low.size"))).select(F.col("node").alias("src"), F.col("low.node").alias("dst")).distinct()
    simhashed = scratch.table(print_pairs(rows.select("node", "fp").distinct()))
    ends = shared.select("node").unionByName(simhashed.select(F.explode(F.array("src", "dst")).alias("node")))
    wanted = ends.distinct().join(firsts, "node").select("node", F.col("tie").alias("__tie"), "first_id")
    # by the text's hash as well as doc_id, which may be null or repeated
    texts = tied.join(wanted, (F.col("tie") == F.col("__tie")) & F.col("doc_id").eqNullSafe(F.col("first_id"))).select("node", "text")
    sets = scratch.table(texts.mapInArrow(_set_batches, "node long, set array<long>").dropDuplicates(["node"]))
    links = scratch.table(near_links(simhashed.unionByName(star).distinct(), sets, similarity))
    found = connected_components(links).withColumnRenamed("component", "part")
    members = shared.join(found, "node", "left").select("key", "node", "size", F.coalesce("part", "node").alias("part"))
    links = links.unionByName(run_links(members, sets, similarity))
    labels = connected_components(links).withColumnRenamed("node", "__node")
    near = labels.join(firsts, F.col("__node") == F.col("node")).select("node", "component", "first_id", "tie")
    lows = near.groupBy("component").agg(F.min(F.when(F.col("first_id").isNotNull(), F.struct("first_id", "tie"))).alias("low"))
    moved = near.join(lows, "component").select("node", "low")
    own = F.struct("first_id", "tie")
    nodes = firsts.join(moved, "node", "left").select("node", "n", F.coalesce("low", own).alias("low"))
    return rows, scratch.table(nodes.select("node", "n", F.col("low.first_id").alias("component_id"), F.col("low.tie").alias("component_tie"))), n or 0


def components(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, node, component_id) for every row; component_id is the smallest doc_id of all linked documents."""
    rows, nodes, n = _labelled(docs, similarity)
    return spread_join(rows.select("doc_id", "node"), nodes, "node", "n", n, ["component_id"])


def deduplicated(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """`docs` with one document of each component, that with the smallest doc_id, all columns as they are.

    Texts that share a doc_id are told apart by their hash: each component keeps its own. Of rows with the same doc_id and text one stays.
    Rows without doc_id stay.
    """
    _, nodes, _ = _labelled(docs, similarity)
    kept = nodes.where("component_id IS NOT NULL").select(F.col("component_id").alias("__id"), F.col("component_tie").alias("__text")).distinct()
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.col("doc_id").alias("__doc"), F.xxhash64(F.col("text").cast("string")).alias("__tie"))
    found = whole.where("__doc IS NOT NULL").join(kept, (F.col("__doc") == F.col("__id")) & (F.col("__tie") == F.col("__text")), "left_semi")
    one = W.partitionBy("__doc", "__tie").orderBy(F.xxhash64(*[F.col("__row").getField(c).cast("string") for c in docs.columns]))
    first = found.withColumn("__place", F.row_number().over(one)).where("__place = 1")
    return first.select("__row.*").unionByName(docs.where("doc_id IS NULL"))
