"""SimHash near-duplicate detection with bit-sliced Hamming comparison.

A fingerprint is 64 bits, the bitwise majority of the hashes of a text's word shingles. Two
fingerprints are linked when they differ in at most `radius` bits.

Candidates: a fingerprint has eight bytes; when two differ in at most r bits, at least 8 - r bytes
are equal. Each distinct fingerprint is therefore dealt out once for each choice of r bytes
left out, keyed by the other bytes. This loses no link, and a key never holds more than 2^(8r)
distinct fingerprints (65,536 for r = 2), whatever the number of copies.

Comparison: the left-out bits of a sorted run of fingerprints are turned into bit planes, 64
fingerprints to a machine word. One pass compares every fingerprint with the one `lag` places on:
XOR of a plane with its shifted self gives one mismatch bit for each lane, and carry-save counters
add them up for all lanes at once. Counters start so that mismatch r + 1 carries out of the top;
words whose lanes have all carried out are abandoned.

Edge cases: a null or wordless text has fingerprint zero and is linked like any other; a text
with fewer words than a shingle has is one shingle. Repeated rows give repeated result rows. A row without
doc_id gets the smallest doc_id of its component, null when there is none. An empty table gives an
empty result. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window as W, functions as F

from watchfold.llm.common import spread_join
from watchfold.llm.registry import query, table
from watchfold.operators.graph import connected_components
from watchfold.session import Scratch

RADIUS = 2
SHINGLE_WORDS = 3
SEED = 42
BYTES = 8
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: bytes | None, words_per_shingle: int = SHINGLE_WORDS) -> int:
    """64-bit SimHash of one UTF-8 text. bytes.lower and bytes.split know ASCII only: A-Z, space and x09-x0D."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    n = max(1, len(words) - words_per_shingle + 1)
    shingles = map(b" ".join, zip(*[words[k:] for k in range(words_per_shingle)])) if len(words) >= words_per_shingle else [b" ".join(words)]
    hashes = np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=SEED), shingles), "<u8", n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):  # bounded memory for very long texts
        part = hashes[at:at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, BYTES), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def _fingerprint_batches(batches, words_per_shingle):
    for batch in batches:
        texts = batch.column(1).cast(pa.binary())
        prints = np.fromiter((fingerprint(t.as_py(), words_per_shingle) for t in texts), "<u8", len(texts))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view("<i8"))], ["doc_id", "fp"])


def fingerprints(docs: DataFrame, words_per_shingle: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, fp) for every row; fp is the fingerprint as a signed long."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(partial(_fingerprint_batches, words_per_shingle=words_per_shingle), f"doc_id {kind}, fp long")


def _planes(values: np.ndarray) -> np.ndarray:
    """(bits, words): bit p of lane i stands in word i // 64 of row p. `values`: (lanes, bytes)."""
    bits = np.unpackbits(values, axis=1, bitorder="little").T
    return _packed(bits)


def _packed(bits: np.ndarray) -> np.ndarray:
    pad = -bits.shape[-1] % 64
    wide = np.pad(bits, [(0, 0)] * (bits.ndim - 1) + [(0, pad)])
    return np.ascontiguousarray(np.packbits(wide, axis=-1, bitorder="little")).view("<u8")


def bit_sliced_pairs(values: np.ndarray, ends: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Lanes (i, j), i < j < ends[i], whose `values` rows differ in at most `radius` bits.

    ends[i] is the end of the run that lane i belongs to.
    """
    n, room = len(values), ends - np.arange(len(values))
    planes = _planes(values)
    counters = radius.bit_length()
    start = (1 << counters) - 1 - radius
    shifted: dict[int, np.ndarray] = {0: planes}
    found_i, found_j = [], []
    for lag in range(1, int(room.max(initial=1))):
        skip, turn = divmod(lag, 64)
        if turn not in shifted:
            after = np.pad(planes[:, 1:], [(0, 0), (0, 1)])
            shifted[turn] = (planes >> np.uint64(turn)) | (after << np.uint64(64 - turn))
        here, there = planes[:, :planes.shape[1] - skip], shifted[turn][:, skip:]
        over = ~_packed(room > lag)[:here.shape[1]]
        words = np.flatnonzero(over != FULL)
        if len(words) < len(over):
            here, there, over = here[:, words], there[:, words], over[words]
        count = [np.full(len(over), FULL if start >> c & 1 else 0, "<u8") for c in range(counters)]
        for p in range(len(planes)):
            carry = here[p] ^ there[p]
            for c in range(counters):
                count[c], carry = count[c] ^ carry, count[c] & carry
            over |= carry
            if p % 4 == 3:
                live = np.flatnonzero(over != FULL)
                if not len(live):
                    break
                if 2 * len(live) < len(over):  # abandon the words whose lanes are all beyond the radius
                    words, here, there, over = words[live], here[:, live], there[:, live], over[live]
                    count = [x[live] for x in count]
        else:
            near = np.unpackbits((~over).view(np.uint8).reshape(len(over), 8), axis=1, bitorder="little")
            word, lane = np.nonzero(near)
            i = words[word] * 64 + lane
            found_i.append(i)
            found_j.append(i + lag)
    none = np.empty(0, np.int64)
    return (np.concatenate(found_i), np.concatenate(found_j)) if found_i else (none, none)


def _spanning(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest lane reachable from each lane over the links (i, j)."""
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def run_links(keys: np.ndarray, prints: np.ndarray, free: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of whole runs of equal keys: fingerprint and the smallest lane's one that it is linked to."""
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.r_[first, len(keys)])
    order = np.ceil(np.log2(sizes)).astype(int)  # runs of like length share a pass, so that short runs don't wait for long ones
    out_a, out_b = [], []
    for k in np.unique(order[sizes > 1]):
        chosen = np.flatnonzero(order == k)
        length = sizes[chosen]
        ends = np.repeat(np.cumsum(length), length)
        rows = np.arange(length.sum()) + np.repeat(first[chosen] - (np.cumsum(length) - length), length)
        i, j = bit_sliced_pairs(free[rows], ends, radius)
        label = _spanning(len(rows), i, j)
        moved = np.flatnonzero(label != np.arange(len(rows)))
        out_a.append(prints[rows[moved]])
        out_b.append(prints[rows[label[moved]]])
    none = np.empty(0, "<i8")
    return (np.concatenate(out_a), np.concatenate(out_b)) if out_a else (none, none)


def _link_batches(batches, radius, choices, at_once=1 << 16):
    """Rows (choice, key, fp) sorted by choice and key; whole runs are compared, at most one is held over."""
    columns = [np.array([b for b in c]) for c in choices]

    def linked(choice, key, fp):
        for c in np.unique(choice):
            own = choice == c
            a, b = run_links(key[own], fp[own], fp[own].astype("<i8").view(np.uint8).reshape(-1, BYTES)[:, columns[c]], radius)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["src", "dst"])

    held, n = [], 0
    for batch in batches:
        held.append([batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)])
        n += batch.num_rows
        if n < at_once:
            continue
        choice, key, fp = (np.concatenate(x) for x in zip(*held))
        last = np.flatnonzero((choice[1:] != choice[:-1]) | (key[1:] != key[:-1]))
        cut = last[-1] + 1 if len(last) else 0
        yield from linked(choice[:cut], key[:cut], fp[:cut])
        held, n = [[choice[cut:], key[cut:], fp[cut:]]], len(key) - cut
    if n:
        yield from linked(*(np.concatenate(x) for x in zip(*held)))


def near_links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(src, dst): links that connect the same distinct fingerprints as all links within `radius` bits do.

    prints: distinct fp. At most one link leaves a fingerprint for each choice of left-out bytes.
    """
    choices = list(combinations(range(BYTES), radius))
    masks = [np.uint64(sum(0xFF << 8 * b for b in range(BYTES) if b not in c)).astype("<i8") for c in choices]
    dealt = prints.select("fp", F.posexplode(F.array(*[F.lit(int(m)) for m in masks])).alias("choice", "mask"))
    keyed = dealt.select("choice", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")
    runs = keyed.repartition("choice", "key").sortWithinPartitions("choice", "key")
    return runs.mapInArrow(partial(_link_batches, radius=radius, choices=choices), "src long, dst long")


def components(docs: DataFrame, radius: int = RADIUS, words_per_shingle: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, fp, component_id) for every row; component_id is the smallest doc_id of all linked documents."""
    scratch = Scratch(docs.sparkSession, "simhash")
    rows = scratch.table(fingerprints(docs, words_per_shingle))
    firsts, (n,) = scratch.table(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n")), F.sum("n"))
    labels = connected_components(near_links(firsts.select("fp"), radius)).withColumnRenamed("node", "fp")
    near = labels.join(firsts, "fp")
    lows = near.groupBy("component").agg(F.min("first_id").alias("component_id"))
    moved = near.join(lows, "component").select("fp", "component_id")
    ids = scratch.table(firsts.join(moved, "fp", "left").select("fp", "n", F.coalesce("component_id", "first_id").alias("component_id")))
    return spread_join(rows, ids, "fp", "n", n or 0, ["component_id"])


def deduplicated(docs: DataFrame, radius: int = RADIUS, words_per_shingle: int = SHINGLE_WORDS) -> DataFrame:
    """`docs` with one document of each component, that with the smallest doc_id, all columns as they are.

    Of rows that share this doc_id one stays. Rows without doc_id stay.
    """
    kept = (components(docs, radius, words_per_shingle).where("doc_id = component_id").select("doc_id").distinct()
            .withColumnRenamed("doc_id", "__kept"))
    found = docs.join(kept, docs["doc_id"] == kept["__kept"], "left_semi")
    one = W.partitionBy("doc_id").orderBy(F.xxhash64(*[F.col(f"`{c}`").cast("string") for c in docs.columns]))
    first = found.withColumn("__place", F.row_number().over(one)).where("__place = 1").drop("__place")
    return first.unionByName(docs.where("doc_id IS NULL"))


@query("op1_simhash")
def op1_simhash(spark, sf_dir):
    found = components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
