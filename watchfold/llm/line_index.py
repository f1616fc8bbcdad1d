"""Line dedup: lines of many documents are found in a sharded minimal perfect hash, not by a join.

A line's key is the line without white space at its ends, A-Z lower-cased. A key of at least `min_chars` code points in at
least `min_documents` documents loses all its lines but those of the largest doc_id that holds it.

Method: a key is known by 128 bits of hash. Documents send each of their long keys once; counts and the largest doc_id come from
one partial aggregate. Frequent keys are dealt into shards by hash, about SHARD_KEYS to a shard, and each shard gets a minimal perfect hash: on each
level a key owns the bit its hash names unless another key of that level names it too, keys without a bit go on to the next level, and
a key's number is the rank of its bit. Under that number stand a 64-bit fingerprint, the document count and the keeper. Documents
then probe the arrays line by line; lines themselves are never shuffled or joined.

At scale: keys in many documents are few, because n keys in d documents each take n x d line occurrences. With more
frequent keys than `broadcast_keys` (18 bytes each), the keys in the most documents, at most that many by this count, are broadcast. The
others stay in their shards; a document sends its long keys that are not among the broadcast ones to the shards (none of them is hot, then), which stream
past the arrays in sorted order, and the hits come back as one short list for each document. Both ways use the same arrays and
the same probe.

Edge cases: a null or empty text is one empty line. A row is a document: rows that share a doc_id count one each, and
all of them keep the lines if theirs is the largest. Rows without doc_id never keep a frequent line. Repeated
rows give repeated result rows; an empty table gives an empty result. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from watchfold.llm.registry import query, table
from watchfold.session import Scratch

MIN_CHARS = 40
MIN_DOCUMENTS = 5
SHARD_KEYS = 1 << 16
BROADCAST_KEYS = 1 << 22
LEVEL_ROOM = 1.5
HASHES = "lo long, hi long"
SHARD = "shard int, sizes array<int>, bits binary, prints binary, counts binary, keepers binary"


def line_key(line: bytes, min_chars: int = MIN_CHARS) -> bytes | None:
    """Key of a UTF-8 line, None if it is too short. bytes.strip and bytes.lower know ASCII only."""
    key = line.strip().lower()
    if len(key) < min_chars or not key.isascii() and len(key.decode()) < min_chars:
        return None
    return key


def line_hashes(text: bytes | None, min_chars: int = MIN_CHARS) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(lines, numbers of the long lines, their hashes as rows (lo, hi))."""
    lines = (text or b"").split(b"\n")
    keys = [line_key(line, min_chars) for line in lines]
    long = [k for k, key in enumerate(keys) if key is not None]
    digests = b"".join([xxhash.xxh3_128_digest(keys[k]) for k in long])
    return lines, np.array(long, np.int64), np.frombuffer(digests, "<u8").reshape(-1, 2)


def _mixed(lo: np.ndarray, hi: np.ndarray, level: int) -> np.ndarray:
    """A level's hash: both halves, multiplied and shifted until every bit depends on all."""
    x = lo + hi * np.uint64(2 * level + 1)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def build_shard(lo: np.ndarray, hi: np.ndarray, counts: np.ndarray, keepers: np.ndarray) -> dict[str, np.ndarray]:
    """Arrays of one shard over distinct (lo, hi)."""
    n = len(lo)
    sizes, bits, number = [], [], np.empty(n, np.int64)
    left, taken = np.arange(n), 0
    while len(left):
        size = 64 * int(np.ceil(LEVEL_ROOM * len(left) / 64))
        slot = (_mixed(lo[left], hi[left], len(sizes)) % np.uint64(size)).astype(np.int64)
        alone = np.bincount(slot, minlength=size) == 1
        own = alone[slot]
        number[left[own]] = taken + (np.cumsum(alone) - 1)[slot[own]]
        taken += int(own.sum())
        sizes.append(size)
        bits.append(np.packbits(alone, bitorder="little"))
        left = left[~own]
    place = np.argsort(number)
    return {"sizes": np.array(sizes, np.int32), "bits": np.concatenate(bits) if bits else np.empty(0, np.uint8), "prints": hi[place],
            "counts": np.minimum(counts[place], 0xFFFFFFFF).astype("<u4"), "keepers": keepers[place]}


class LineIndex:
    """Arrays of several shards one behind the other, probed for many keys at once."""

    def __init__(self, shards: list[dict], n_shards: int):
        """shards: dicts of `build_shard` with their number under "shard"; n_shards: number of shards that keys are dealt to."""
        levels = max((len(s["sizes"]) for s in shards), default=0)
        self.n_shards = n_shards
        self.sizes = np.zeros((n_shards, levels), np.int64)
        self.base = np.zeros((n_shards, levels), np.int64)
        words, at = [], 0
        for s in shards:
            sizes = np.asarray(s["sizes"], np.int64)
            self.sizes[s["shard"], :len(sizes)] = sizes
            self.base[s["shard"], :len(sizes)] = at + np.cumsum(sizes) - sizes
            at += int(sizes.sum())
            words.append(np.frombuffer(s["bits"], "<u8"))
        joined = lambda name, kind: np.concatenate([np.frombuffer(s[name], kind) for s in shards]) if shards else np.empty(0, kind)
        self.words = np.concatenate(words) if words else np.empty(0, "<u8")
        self.before = np.cumsum(np.bitwise_count(self.words), dtype=np.int64) - np.bitwise_count(self.words)
        self.prints, self.counts, self.keepers = joined("prints", "<u8"), joined("counts", "<u4"), joined("keepers", "<i8")

    def find(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Number of each key in the arrays, -1 for keys that are not indexed."""
        number = np.full(len(lo), -1)
        shard = (lo % np.uint64(self.n_shards)).astype(np.int64)
        left = np.arange(len(lo))
        for level in range(self.sizes.shape[1]):
            left = left[self.sizes[shard[left], level] > 0]
            if not len(left):
                break
            size = self.sizes[shard[left], level]
            bit = self.base[shard[left], level] + (_mixed(lo[left], hi[left], level) % size.astype(np.uint64)).astype(np.int64)
            word, place = self.words[bit >> 6], (bit & 63).astype(np.uint64)
            there = (word >> place & np.uint64(1)).astype(bool)
            below = np.bitwise_count(word & ((np.uint64(1) << place) - np.uint64(1)))
            number[left[there]] = (self.before[bit >> 6] + below)[there]
            left = left[~there]
        hit = number >= 0
        hit[hit] = self.prints[number[hit]] == hi[hit]
        return np.where(hit, number, -1)

    def drops(self, lo: np.ndarray, hi: np.ndarray, ids: np.ndarray, known: np.ndarray, min_documents: int) -> np.ndarray:
        """Whether a line with this key goes from the document `ids` (`known`: it has one)."""
        number = self.find(lo, hi)
        out = number >= 0
        out[out] = (self.counts[number[out]] >= min_documents) & ((self.keepers[number[out]] != ids[out]) | ~known[out])
        return out


def _rows(batch, min_chars):
    """(lines, long line numbers, hashes) of each row and the doc_ids, nulls as 0, with their validity."""
    ids = batch.column(0)
    found = [line_hashes(t.as_py(), min_chars) for t in batch.column(1).cast(pa.binary())]
    return found, ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_valid().to_numpy(zero_copy_only=False)


def _flat(found):
    """Row numbers and hashes of all long lines of a batch."""
    sizes = [len(f[1]) for f in found]
    return np.repeat(np.arange(len(found)), sizes), np.concatenate([f[2] for f in found]) if found else np.empty((0, 2), "<u8")


def _long_keys(batches, min_chars, hot=None):
    """Distinct long keys of each row that are not in `hot`: (doc_id, text number, lo, hi)."""
    for batch in batches:
        found, _, _ = _rows(batch, min_chars)
        row, hashes = _flat(found)
        once = np.unique(np.rec.fromarrays([row, hashes[:, 0], hashes[:, 1]], names="row,lo,hi"))
        if hot is not None:
            once = once[hot.value.find(np.ascontiguousarray(once.lo), np.ascontiguousarray(once.hi)) < 0]
        rows = pa.array(once.row)
        columns = [batch.column(0).take(rows)] + ([batch.column(2).take(rows)] if batch.num_columns > 2 else [])
        yield pa.RecordBatch.from_arrays([*columns, pa.array(once.lo.astype("<i8")), pa.array(once.hi.astype("<i8"))],
                                         ["doc_id", "text_id", "lo", "hi"] if len(columns) > 1 else ["doc_id", "lo", "hi"])


def _shards(key, rows):
    column = lambda name, kind: rows[name].to_numpy().astype("<i8").view(kind)
    made = build_shard(column("lo", "<u8"), column("hi", "<u8"), column("n", "<i8"), column("keeper", "<i8"))
    return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "sizes": pa.array([made["sizes"]], pa.list_(pa.int32())),
                     **{name: pa.array([made[name].tobytes()], pa.binary()) for name in ("bits", "prints", "counts", "keepers")}})


def shards_of(keys: DataFrame, n_shards: int) -> DataFrame:
    """One row of arrays (SHARD) for each shard of keys (lo, hi, n, keeper)."""
    # pmod on the signed long would not be the unsigned remainder that a probe takes
    unsigned = F.when(F.col("lo") >= 0, F.col("lo") % n_shards).otherwise(
        (F.expr(f"shiftrightunsigned(lo, 1) % {n_shards}") * 2 + F.col("lo").bitwiseAND(F.lit(1))) % n_shards)
    dealt = keys.withColumn("shard", unsigned.cast("int"))
    return dealt.groupBy("shard").applyInArrow(_shards, SHARD)


def _shard_hits(batches, n_shards, min_documents):
    """Rows sorted by shard, its arrays (first) and then the keys that ask for it: (key_id, lo, hi) of those to drop."""
    index = None
    for batch in batches:
        arrays = batch.column("sizes").is_valid().to_numpy(zero_copy_only=False)
        cuts = [*np.flatnonzero(arrays).tolist(), batch.num_rows]
        if cuts[0] > 0:
            yield from _asked(batch.slice(0, cuts[0]), index, min_documents)
        for at, end in zip(cuts, cuts[1:]):
            index = LineIndex([batch.slice(at, 1).to_pylist()[0]], n_shards)
            if end > at + 1:
                yield from _asked(batch.slice(at + 1, end - at - 1), index, min_documents)


def _asked(batch, index, min_documents):
    shard = batch.column("shard").to_numpy()
    lo, hi = (batch.column(c).to_numpy(zero_copy_only=False).astype("<i8").view("<u8") for c in ("lo", "hi"))
    ids = batch.column("doc_id")
    if index is None:
        return
    own = index.sizes[shard].any(axis=1)  # a shard without frequent keys has no arrays
    gone = index.drops(lo, hi, ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_valid().to_numpy(zero_copy_only=False), min_documents) & own
    hit = pa.array(np.flatnonzero(gone))
    yield pa.RecordBatch.from_arrays([batch.column(c).take(hit) for c in ("doc_id", "text_id", "lo", "hi")], ["doc_id", "text_id", "lo", "hi"])


def _kept_batches(batches, index, min_chars, min_documents):
    """(doc_id, text, [keys to drop as found in the shards]) to the documents without the lines that go."""
    for batch in batches:
        found, ids, known = _rows(batch, min_chars)
        row, hashes = _flat(found)
        gone = index.value.drops(hashes[:, 0], hashes[:, 1], ids[row], known[row], min_documents)
        if batch.num_columns > 2:
            for k, listed in enumerate(batch.column(2).to_pylist()):
                if listed:
                    drop = {(d["lo"], d["hi"]) for d in listed}
                    own = np.flatnonzero(row == k)
                    gone[own] |= [pair in drop for pair in map(tuple, hashes[own].astype("<u8").view("<i8").tolist())]
        texts, n_lines, n_dropped = [], [], []
        ends = np.cumsum([len(f[1]) for f in found])
        for (lines, long, _), end in zip(found, ends.tolist()):
            out = set(long[gone[end - len(long):end]].tolist())
            texts.append(b"\n".join([line for k, line in enumerate(lines) if k not in out]) if out else b"\n".join(lines))
            n_lines.append(len(lines))
            n_dropped.append(len(out))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())],
                                         ["doc_id", "text", "n_lines", "n_dropped"])


def deduplicated(docs: DataFrame, min_chars: int = MIN_CHARS, min_documents: int = MIN_DOCUMENTS, broadcast_keys: int = BROADCAST_KEYS, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """(doc_id, text, n_lines, n_dropped) for every row: the text without its dropped lines, the lines before and those dropped."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "lines")
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    keys = rows.mapInArrow(partial(_long_keys, min_chars=min_chars), f"doc_id long, {HASHES}")
    counted = keys.groupBy("lo", "hi").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("keeper")).where(F.col("n") >= min_documents)
    counted = counted.withColumn("keeper", F.coalesce("keeper", F.lit(0)))  # only where no row has a doc_id: those never keep
    frequent, (n_keys, uses) = scratch.table(counted, F.count(F.lit(1)), F.sum("n"))
    # keys in at least `common` documents: at most broadcast_keys of them, since each has that many of all uses
    common = min_documents if n_keys <= broadcast_keys else (uses or 0) // broadcast_keys + 1
    split = n_keys > broadcast_keys
    n_shards = max(1, -(-n_keys // shard_keys))
    arrays = shards_of(frequent.where(F.col("n") >= common), n_shards)
    index = spark.sparkContext.broadcast(LineIndex([r.asDict() for r in arrays.toLocalIterator()], n_shards))
    if split:
        rows = _with_listed(rows, shards_of(frequent.where(F.col("n") < common), n_shards), index, n_shards, min_chars, min_documents)
    return rows.mapInArrow(partial(_kept_batches, index=index, min_chars=min_chars, min_documents=min_documents), "doc_id long, text string, n_lines long, n_dropped long")


def _with_listed(rows: DataFrame, arrays: DataFrame, hot, n_shards: int, min_chars: int, min_documents: int) -> DataFrame:
    """`rows` with the keys to drop that only the shards know. A text meets its list by doc_id and a hash of the text."""
    named = rows.withColumn("text_id", F.xxhash64("doc_id", "text"))
    asked = named.select("doc_id", "text", "text_id").mapInArrow(partial(_long_keys, min_chars=min_chars, hot=hot), f"doc_id long, text_id long, {HASHES}")
    low = F.col("lo").bitwiseAND(F.lit(1))
    unsigned = F.when(F.col("lo") >= 0, F.col("lo") % n_shards).otherwise((F.expr(f"shiftrightunsigned(lo, 1) % {n_shards}") * 2 + low) % n_shards)
    asked = asked.withColumn("shard", unsigned.cast("int"))
    both = arrays.unionByName(asked, allowMissingColumns=True)
    met = both.repartition("shard").sortWithinPartitions("shard", F.col("sizes").isNull())
    hits = met.mapInArrow(partial(_shard_hits, n_shards=n_shards, min_documents=min_documents), f"doc_id long, text_id long, {HASHES}")
    lists = hits.groupBy(F.col("doc_id").alias("__id"), F.col("text_id").alias("__text")).agg(F.collect_set(F.struct("lo", "hi")).alias("listed"))
    return named.join(lists, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_id") == F.col("__text")), "left").select("doc_id", "text", "listed")


BLANKS = " || ".join(["' '", *[f"chr({c})" for c in range(9, 14)]])
OP12_SQL = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place FROM documents),
keyed AS (
  SELECT doc_id, place, line, translate(trim(line, {BLANKS}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
frequent AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
judged AS (
  SELECT k.doc_id, k.place, k.line, f.key IS NOT NULL AND f.keeper <> k.doc_id AS gone FROM keyed k LEFT JOIN frequent f ON f.key = k.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""


@query("op12_lines", OP12_SQL)
def op12_lines(spark, sf_dir):
    kept = deduplicated(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
