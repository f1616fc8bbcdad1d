"""Token sequences of bounded length, filled by vector best-fit.

Tokenizing: white space always ends a token of this kind of tokenizer (another kind is refused), so a text's ids are those of its words joined. Each
Python worker keeps the ids of words it has met (at most `CACHED_WORDS`, then it starts afresh; results do not depend on
it). Texts become pieces of at most `capacity` tokens; only pieces, never texts, are shuffled.

Packing: pieces are dealt at random into shards that hold about `SHARD_SEQUENCES` sequences' worth of tokens and at most about
`SHARD_PIECES` pieces, so the number of shards grows with the corpus and a task's memory does not. Inside a shard pieces
go from long to short. A piece asks for (tokens, one document, attention cost = length squared) and may go to
any open sequence whose three residual capacities hold it; among these the one with the smallest weighted
norm of what would be left is taken ("norm"), or that with the largest weighted dot product of demand and
residual ("dot"). Without a feasible sequence a new one is opened. A shard can waste part of its last sequences: about
one in `SHARD_SEQUENCES`.

Training order: with `ordered`, texts carry a place and pieces are dealt to shards by contiguous ranges of places, of `ORDERED_SEQUENCES` sequences'
worth of tokens each; a place's shard follows from running sums of tokens. Inside a shard sequences are numbered by the mean place of their
tokens, so sequence_id rises with the training position. `file_places` reads the order in which a table was written.

With the defaults the document and attention capacities can hold any filling of `capacity` tokens, so that tokens decide.
A piece whose own attention cost is above the capacity stands alone.

Edge cases: a null or empty text is one piece with the end id alone. Null doc_ids are kept. Repeated rows are packed each. An
empty table gives an empty result. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window as W, functions as F

from watchfold.llm.registry import query, table
from watchfold.session import Scratch

CAPACITY, END_ID = 4096, 1
CACHED_WORDS, KEPT_WORDS = 1_000_000, 300_000
SHARD_SEQUENCES, SHARD_PIECES = 2048, 65_536
ORDERED_SEQUENCES = 256  # fewer than SHARD_SEQUENCES: inside a shard, order gives way to filling
WEIGHTS = (1.0, 0.05, 0.05)  # of tokens, documents and attention cost, each as a share of its capacity
SLICE = 1 << 20
MARKS, MOST_MARKS = b"!#$%&*+,-./:;=?@^_~()[]", 4  # as a run after letters they are one unit; longer runs are left to the tokenizer
LATIN = re.compile("[A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF]+")
LETTER_RUNS = r"[\p{L}]+".replace("\\", "\\\\")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def _holds(steps: dict | None, kind: str) -> bool:
    """Is a step of this kind in the tokenizer's description?"""
    return f'"type": "{kind}"' in json.dumps(steps)


class WordIds(dict):
    """Little-endian 32-bit ids of words without white space, filled on demand.

    A worker keeps its words from task to task, but only those that came back in a later slice of texts, and at most KEPT_WORDS of them:
    most words of a task are met once and would only hold memory.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        steps = json.loads(self.tokenizer.to_str())
        if not (_holds(steps["normalizer"], "Lowercase") and _holds(steps["pre_tokenizer"], "ByteLevel") and LETTER_RUNS in json.dumps(steps["pre_tokenizer"])
                and steps["model"].get("end_of_word_suffix")):
            raise ValueError(f"{path}: words are only independent for a lower-casing byte-level model that splits runs of letters")
        spell = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.letters = str.maketrans({c: spell(c)[0][0] for c in map(chr, range(0xC0, 0x100)) if LATIN.fullmatch(c)})
        self.tails: dict[bytes, bytes] = {}
        self.met_again: set[bytes] = set()

    def learn(self, words: set[bytes]) -> None:
        known = words & self.keys()
        if len(self) + len(words) - len(known) > CACHED_WORDS:
            self.clear()
            self.met_again.clear()
            known = set()
        self.met_again |= known
        cores, rest = {}, []
        for w in words - known:
            parts = self.parts(w)
            if parts is None:
                rest.append(w)
                continue
            core, tail = parts
            ids = cores.get(core)
            if ids is None:
                ids = cores[core] = _packed([t.id for t in self.tokenizer.model.tokenize(core)])
            if tail:
                if tail not in self.tails:
                    self.tails[tail] = _packed(self.tokenizer.encode(tail.decode(), add_special_tokens=False).ids)
                ids += self.tails[tail]
            self[w] = ids
        for w, e in zip(rest, self.tokenizer.encode_batch_fast([w.decode() for w in rest], add_special_tokens=False)):
            self[w] = _packed(e.ids)

    def parts(self, word: bytes) -> tuple[str, bytes] | None:
        """The model's spelling of a run of Latin letters and the marks after it: two units that do not change each other's ids. None: another word."""
        core = word.rstrip(MARKS)
        if len(word) - len(core) > MOST_MARKS:
            return None
        if core.isalpha():  # ASCII only
            return core.lower().decode(), word[len(core):]
        if core.isascii():
            return None
        text = core.decode()
        return (text.lower().translate(self.letters), word[len(core):]) if LATIN.fullmatch(text) else None

    def shrink(self) -> None:
        """At the end of a task: forget words met in one slice only."""
        kept = {w: self[w] for w in self.met_again} if len(self.met_again) <= KEPT_WORDS else {}
        self.clear()
        self.update(kept)
        self.met_again.clear()


@lru_cache(maxsize=1)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def _slices(text: bytes):
    """Parts of about SLICE bytes that end at a space or line feed, so that a very long text is not split at once."""
    at = 0
    while len(text) - at > 2 * SLICE:
        cut = max(text.rfind(b" ", at, at + SLICE), text.rfind(b"\n", at, at + SLICE))
        if cut <= at:
            ends = [x for x in (text.find(b" ", at + SLICE), text.find(b"\n", at + SLICE)) if x >= 0]
            cut = min(ends, default=len(text))
        yield text[at:cut]
        at = cut
    yield text[at:]


def token_ids(text: bytes | None, words: WordIds) -> bytes:
    """The text's ids and the end id, four bytes each."""
    out = []
    for part in _slices(text or b""):
        out.append(b"".join(map(words.__getitem__, part.split())))
    out.append(END_ID.to_bytes(4, "little"))
    return b"".join(out)


def _piece_batches(batches, path, capacity, with_ids, ordered):
    words = word_ids(path)
    for batch in batches:
        texts = [t.as_py() for t in batch.column(1).cast(pa.binary())]
        at = 0
        while at < len(texts):  # about 8 MB of text at a time
            upto, size = at, 0
            while upto < len(texts) and (upto == at or size < 8 * SLICE):
                size += len(texts[upto] or b"")
                upto += 1
            seen = set()
            for t in texts[at:upto]:
                for part in _slices(t or b""):
                    seen.update(part.split())
            words.learn(seen)
            rows, piece, start, length, crc, parts = [], [], [], [], [], []
            for k in range(at, upto):
                ids = memoryview(token_ids(texts[k], words))
                for n, first in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[first:first + 4 * capacity]
                    rows.append(k), piece.append(n), start.append(first // 4), length.append(len(part) // 4), crc.append(zlib.crc32(part))
                    if with_ids:
                        parts.append(bytes(part))
            columns = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                       pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if ordered:
                columns += [batch.column(k).take(pa.array(rows, pa.int64())) for k in (2, 3)]
                names += ["part", "row"]
            if with_ids:
                columns.append(pa.array(parts, pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)
            at = upto
    words.shrink()


def file_places(docs: DataFrame) -> DataFrame:
    """(doc_id, text, part, row): rows in the order (part, row) in which the table was written.

    Spark names a file by its task's number and the files of a task by their own, and readers take files in any order; other file
    names have no part. A table that was not read from Parquet files stands in the order of its partitions.
    """
    own = ["doc_id", F.col("text").cast("string").alias("text")]
    try:
        name, row = F.col("_metadata.file_name"), F.col("_metadata.row_index")
        number = lambda pattern: F.coalesce(F.regexp_extract(name, pattern, 1).try_cast("long"), F.lit(0))
        found = docs.select(*own, (number("^part-([0-9]+)") * (1 << 20) + number(r"-c([0-9]+)[^-]*$")).alias("part"), row.alias("row"))
        found.schema  # resolves the hidden columns
        return found
    except AnalysisException:
        place = F.monotonically_increasing_id()
        return docs.select(*own, F.shiftright(place, 33).alias("part"), place.alias("row"))


def pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, with_ids: bool = False, ordered: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, part, row][, ids]): every document's tokens in pieces of at most `capacity`."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    made = partial(_piece_batches, path=tokenizer or default_tokenizer(), capacity=capacity, with_ids=with_ids, ordered=ordered)
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", part long, row long" * ordered + ", ids binary" * with_ids
    texts = file_places(docs) if ordered else docs.select("doc_id", F.col("text").cast("string"))
    return texts.mapInArrow(made, schema)


def best_fit(lengths: np.ndarray, capacity: int, max_docs: int, max_attention: float, rule: str = "norm", weights=WEIGHTS) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each piece by vector best-fit, long pieces first."""
    room = np.array([capacity, max_docs, max_attention], float)
    scale = np.asarray(weights) / room ** 2  # weights of squared shares
    sequence, offset = np.empty(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    order = np.argsort(-lengths, kind="stable")
    alone = (lengths[order] >= capacity) | (lengths[order].astype(float) ** 2 > max_attention)
    sequence[order[alone]] = np.arange(alone.sum())
    opened = base = int(alone.sum())
    left, used = np.empty((3, 64)), np.empty(64, np.int64)
    name = np.empty(64, np.int64)  # of the sequence in each place; full ones give up theirs
    n = 0
    for i in order[~alone]:
        length = float(lengths[i])
        demand = (length, 1.0, length * length)
        fits = np.flatnonzero((left[0, :n] >= demand[0]) & (left[1, :n] >= 1.0) & (left[2, :n] >= demand[2]))
        if len(fits):
            r = left[:, fits]
            if rule == "norm":
                best = np.argmin(scale[0] * (r[0] - demand[0]) ** 2 + scale[1] * (r[1] - 1.0) ** 2 + scale[2] * (r[2] - demand[2]) ** 2)
            else:
                best = np.argmax(scale[0] * demand[0] * r[0] + scale[1] * r[1] + scale[2] * demand[2] * r[2])
            b = fits[best]
        else:
            if n == left.shape[1]:
                left, used, name = np.hstack([left, np.empty_like(left)]), np.hstack([used, np.empty_like(used)]), np.hstack([name, np.empty_like(name)])
            b, n = n, n + 1
            left[:, b], used[b], name[b] = room, 0, opened
            opened += 1
        sequence[i], offset[i] = name[b], used[b]
        used[b] += int(length)
        left[0, b] -= demand[0]
        left[1, b] -= 1.0
        left[2, b] -= demand[2]
        if left[0, b] < 1 or left[1, b] < 1:  # nothing fits any more: the last place moves here
            n -= 1
            left[:, b], used[b], name[b] = left[:, n], used[n], name[n]
    return sequence, offset


def _pack_shard(rows: pa.Table, capacity, max_docs, max_attention, rule) -> pa.Table:
    rows = rows.sort_by("slot")
    sequence, offset = best_fit(rows["length"].to_numpy(), capacity, max_docs, max_attention, rule)
    if "at" in rows.column_names:  # number sequences by the mean place of their tokens
        length = rows["length"].to_numpy()
        at = rows["at"].to_numpy() - rows["at"][0].as_py() + length / 2
        mean = np.bincount(sequence, length * at) / np.bincount(sequence, length)
        place = np.empty(len(mean), np.int64)
        place[np.argsort(mean, kind="stable")] = np.arange(len(mean))
        sequence = place[sequence]
    names = sequence + (int(rows["shard"][0].as_py()) << 32)
    return rows.drop_columns(["shard"]).append_column("sequence_id", pa.array(names)).append_column("offset", pa.array(offset))


def _with_running_tokens(rows: DataFrame, capacity: int, scratch: Scratch) -> DataFrame:
    """`rows` plus at and shard. No window holds more than the pieces of one written file, or one row for each file."""
    room = ORDERED_SEQUENCES * capacity
    # a shard has a bounded number of pieces, however short they are
    load = F.greatest(F.col("length"), F.lit(-(-room // SHARD_PIECES)))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    sums = [F.sum("length").alias("__tokens"), F.sum(load).alias("__load")]
    parts = scratch.table(rows.groupBy("part").agg(*sums).select(
        F.col("part").alias("__part"), *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in ("__tokens", "__load")]))
    inside = W.partitionBy("part").orderBy("row", "piece", "doc_id", "slot").rowsBetween(W.unboundedPreceding, -1)
    running = lambda c, first: F.coalesce(F.sum(c).over(inside), F.lit(0)) + F.col(first)
    met = rows.withColumn("__own", load).join(parts, F.col("part") == F.col("__part"))
    placed = met.withColumn("at", running("length", "__tokens")).withColumn("shard", F.floor(running("__own", "__load") / room).cast("long"))
    return placed.select(*rows.columns, "at", "shard")


def packed(cut: DataFrame, capacity: int = CAPACITY, max_docs: int | None = None, max_attention: float | None = None, rule: str = "norm") -> DataFrame:
    """`cut` (pieces with length) plus slot, sequence_id and offset. Written once, so that shards stay as they were dealt.

    With the columns part and row, shards are ranges of places, and `at` is the number of tokens before a piece in this order.
    """
    scratch = Scratch(cut.sparkSession, "packing")
    light = cut.withColumn("slot", F.monotonically_increasing_id())
    rows, (n, tokens) = scratch.table(light, F.count(F.lit(1)), F.sum("length"))
    shards = max(1, -(-(tokens or 0) // (SHARD_SEQUENCES * capacity)), -(-n // SHARD_PIECES))
    fields = rows.drop("ids")
    if "part" in rows.columns:
        fields = _with_running_tokens(fields, capacity, scratch)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields.schema if f.name != "shard") + ", sequence_id long, offset long"
    dealt = fields if "shard" in fields.columns else fields.withColumn("shard", F.pmod(F.xxhash64("slot"), F.lit(shards)))
    limits = {"capacity": capacity, "max_docs": max_docs or capacity, "max_attention": max_attention or float(capacity) ** 2, "rule": rule}
    placed = dealt.groupBy("shard").applyInArrow(lambda rows: _pack_shard(rows, **limits), schema)
    return placed if "ids" not in rows.columns else placed.join(rows.select("slot", "ids"), "slot")


def sequences(placed: DataFrame) -> DataFrame:
    """(sequence_id, n_tokens, documents, ids): one row for each packed sequence; needs pieces made `with_ids`."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "piece", "ids", "length")))
    whole = placed.groupBy("sequence_id").agg(parts.alias("p"), F.sum("length").alias("n_tokens"))
    return whole.select("sequence_id", "n_tokens", F.transform("p", lambda x: F.struct(x["doc_id"].alias("doc_id"), x["piece"].alias("piece"), x["offset"].alias("offset"))).alias("documents"),
                        F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"))


def pack_documents(docs: DataFrame, tokenizer: str | None = None, ordered: bool = False) -> DataFrame:
    return packed(pieces(docs, tokenizer, ordered=ordered)).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query("op10_packing")
def op10_packing(spark, sf_dir):
    return pack_documents(table(spark, sf_dir, "documents"))
