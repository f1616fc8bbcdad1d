"""Knowledge text jobs: cleaning, section trim, audit, chunking, index checks."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Sequence
from functools import partial
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from watchfold.functions.columns import evaluate_once
from watchfold.session import Scratch

# Limits of cleaning, audit and chunking.
REPEAT_MIN_RECORDS, REPEAT_RATIO, REPEAT_MIN_CHARS, REPEAT_MAX_CHARS = 3, 0.20, 8, 140
MIN_RECORD_CHARS, LONG_RECORD_CHARS, MAX_EMPTY_RATIO = 80, 12000, 0.05
TARGET_WORDS, MAX_WORDS, OVERLAP_WORDS, MIN_WORDS = 850, 1000, 100, 80
# Mojibake sequences and their repairs.
MOJIBAKE = [("â€™", "'"), ("â€œ", '"'), ("â€\u009d", '"'), ("â€“", "-"), ("â€”", "-")]
# Characters besides the line feed that end a line.
OTHER_BREAKS = "\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"
HYPHEN_BREAK = r"(?<=[A-Za-z])-[ \t]*\n[ \t]*(?=[A-Za-z])"
CFR_HEADING = r"[§�]\s*1910\.(\d+[a-z]?) +(?:\[|[A-Z][a-z])"
CONTROL_HEADING = r"(?m)^\s*PE-(\d+)\s+[A-Z]"


def normalize_line(line: Column) -> Column:
    """Runs of white space become one space. Single spaces, by far the most, are not matched at all."""
    return F.trim(F.regexp_replace(line, r"\s{2,}|[\t\n\x0b\f\r]", " "))


def lines(text: Column) -> Column:
    """Lines of a text; a final line end opens no extra line. Rare line ends are mapped to the line
    feed first, so the split is on one literal character."""
    t = F.replace(text, F.lit("\r\n"), F.lit("\n"))
    t = F.when(t.rlike(f"[{OTHER_BREAKS}]"), F.translate(t, OTHER_BREAKS, "\n" * len(OTHER_BREAKS))).otherwise(t)
    return F.split(F.when(F.endswith(t, F.lit("\n")), F.left(t, F.length(t) - 1)).otherwise(t), "\n")


def _record_lines(records: DataFrame) -> DataFrame:
    """(document_id, record_id, line): normalised lines long enough to be headers or footers."""
    raw = records.select("document_id", "record_id", F.explode(lines(F.col("text"))).alias("line"))
    return raw.select("document_id", "record_id", normalize_line(F.col("line")).alias("line")).where(F.length("line") >= REPEAT_MIN_CHARS)


def repeated_lines(records: DataFrame) -> DataFrame:
    """(document_id, line): header and footer lines, found in at least max(3, 20%) of a document's records."""
    total = records.groupBy("document_id").agg(F.count(F.lit(1)).alias("records"))
    counts = _record_lines(records).groupBy("document_id", "line").agg(F.count_distinct("record_id").alias("n"))
    limit = F.greatest(F.lit(REPEAT_MIN_RECORDS), F.floor(F.col("records") * REPEAT_RATIO))
    return counts.join(total, "document_id").where((F.col("records") >= REPEAT_MIN_RECORDS) & (F.col("n") >= limit) & (F.length("line") <= REPEAT_MAX_CHARS)) \
                 .select("document_id", "line", "n")


def remove_repeated_lines(records: DataFrame, repeated: DataFrame) -> DataFrame:
    """Text without the repeated lines, and how many were removed.

    A repeated line is in a fifth of the records, so a document has at most five times the
    average number of lines per record of them: the packed list is bounded, and the record
    texts themselves are not shuffled apart and put together again."""
    packed = repeated.groupBy("document_id").agg(F.collect_set("line").alias("__drop"))
    j = records.join(packed, "document_id", "left").withColumn("__drop", F.coalesce("__drop", F.array().cast("array<string>")))
    j = evaluate_once(j, {"__lines": lines(F.col("text"))})
    # A short line cannot be repeated, so it is not normalised at all.
    j = evaluate_once(j, {"__kept": F.filter("__lines", lambda x: (F.length(x) < REPEAT_MIN_CHARS) | (F.size("__drop") == 0) | ~F.array_contains("__drop", normalize_line(x)))})
    return j.withColumn("removed_lines", F.size("__lines") - F.size("__kept")).withColumn("text", F.array_join("__kept", "\n")).drop("__drop", "__lines", "__kept")


def dehyphenate(text: Column) -> Column:
    return F.regexp_replace(text, HYPHEN_BREAK, "")


def hyphen_breaks(text: Column) -> Column:
    return F.regexp_count(text, F.lit(HYPHEN_BREAK))


def repair_mojibake(text: Column) -> Column:
    for bad, good in MOJIBAKE:
        text = F.replace(text, F.lit(bad), F.lit(good))
    return text


def mojibake_count(text: Column) -> Column:
    return sum((((F.length(text) - F.length(F.replace(text, F.lit(bad), F.lit("")))) / len(bad)).cast("int") for bad, _ in MOJIBAKE), F.lit(0))


def replacement_contexts(text: Column) -> Column:
    """Up to sixty characters on both sides of every U+FFFD; one that stands in the context before it has none of its own."""
    return F.regexp_extract_all(text, F.lit("(?s)(.{0,60}�.{0,60})"))


def normalize_whitespace(text: Column) -> Column:
    t = F.regexp_replace(F.regexp_replace(text, "\\x00", " "), r"[ \t]+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r" *\n *", "\n"), r"\n{3,}", "\n\n"))


def clean(records: DataFrame) -> DataFrame:
    out = remove_repeated_lines(records, repeated_lines(records))
    out = out.withColumn("dehyphenated", hyphen_breaks(F.col("text"))).withColumn("text", dehyphenate(F.col("text")))
    out = out.withColumn("mojibake_repairs", mojibake_count(F.col("text"))).withColumn("text", repair_mojibake(F.col("text")))
    return out.withColumn("text", normalize_whitespace(F.col("text")))


def headings(records: DataFrame, pattern: str) -> DataFrame:
    """(document_id, page, at, number) of every heading; `at` is its 0-based offset in the page."""
    parts = F.split("text", f"(?={pattern})" if not pattern.startswith("(?m)") else f"(?m)(?={pattern[4:]})")
    p = records.select("document_id", "page", parts.alias("parts"))
    at = F.transform(F.sequence(F.lit(0), F.size("parts") - 1), lambda i: F.aggregate(F.slice("parts", F.lit(1), i), F.lit(0), lambda a, x: a + F.length(x)))
    return p.select("document_id", "page", F.explode(F.arrays_zip(F.col("parts").alias("part"), at.alias("at"))).alias("z")) \
            .select("document_id", "page", F.col("z.at").alias("at"), F.regexp_extract("z.part", pattern, 1).alias("number")).where("number <> ''")


def trim_to_section(records: DataFrame, section: str, pattern: str = CFR_HEADING, stop_at_any: bool = False) -> DataFrame:
    """Pages from the section's heading to the next heading (of another section, or of any); the
    boundary pages are cut. A document without the heading is kept whole.

    Start and end are minima over (page, offset), so no document is gathered anywhere."""
    h = headings(records, pattern)
    spot = F.struct("page", "at")
    start = h.where(F.col("number") == section).groupBy("document_id").agg(F.min(spot).alias("s"))
    after = h.join(start, "document_id").where(spot > F.col("s"))
    if not stop_at_any:
        after = after.where(F.col("number") != section)
    end = after.groupBy("document_id").agg(F.min(spot).alias("e"))
    j = records.join(start, "document_id", "left").join(end, "document_id", "left")
    inside = F.col("s").isNull() | ((F.col("page") >= F.col("s.page")) & (F.col("e").isNull() | (F.col("page") < F.col("e.page")) | ((F.col("page") == F.col("e.page")) & (F.col("e.at") > F.when(F.col("s.page") == F.col("page"), F.col("s.at")).otherwise(F.lit(-1))))))
    first = F.when(F.col("page") == F.col("s.page"), F.col("s.at")).otherwise(F.lit(0))
    last = F.when(F.col("page") == F.col("e.page"), F.col("e.at")).otherwise(F.length("text"))
    return j.where(inside).withColumn("cut_before", first).withColumn("cut_after", F.length("text") - last) \
            .withColumn("text", F.substring(F.col("text"), first + 1, last - first)).drop("s", "e")


def audit(records: DataFrame) -> DataFrame:
    """Quality counts and PASS / REVIEW / FAIL per document; the texts are only measured, never joined."""
    n = F.length("text")
    count = lambda p: F.sum(F.regexp_count(F.col("text"), F.lit(p)))
    g = records.groupBy("document_id").agg(
        F.count(F.lit(1)).alias("record_count"), F.sum(n).alias("total_characters"), F.min(n).alias("min_characters"), F.max(n).alias("max_characters"),
        F.count_if(n < MIN_RECORD_CHARS).alias("short_records"), F.count_if(n > LONG_RECORD_CHARS).alias("long_records"),
        (F.count(F.lit(1)) - F.count_distinct(F.sha2("text", 256))).alias("duplicate_records"), count("�").alias("replacement_characters"),
        count(r"\x00").alias("nul_characters"), count(r"[A-Za-z]-\n[A-Za-z]").alias("hyphen_breaks"))
    # The audit counts every repeated line, however long.
    total = records.groupBy("document_id").agg(F.count(F.lit(1)).alias("records"))
    rep = _record_lines(records).groupBy("document_id", "line").agg(F.count_distinct("record_id").alias("n")).join(total, "document_id") \
             .where(F.col("n") >= F.greatest(F.lit(3), F.floor(F.col("records") * REPEAT_RATIO))).groupBy("document_id").agg(F.count(F.lit(1)).alias("repeated_lines"))
    j = g.join(rep, "document_id", "left").na.fill(0, ["repeated_lines"])
    review = (F.col("short_records") / F.col("record_count") > MAX_EMPTY_RATIO) | (F.col("long_records") + F.col("repeated_lines") + F.col("duplicate_records") + F.col("replacement_characters") + F.col("hyphen_breaks") > 0)
    return j.withColumn("status", F.when(F.col("nul_characters") > 0, "FAIL").when(review, "REVIEW").otherwise("PASS"))


def paragraphs(text: Column) -> Column:
    parts = F.split(text, r"\n\s*\n|(?<=\.)\n(?=[A-Z0-9])")
    return F.filter(F.transform(parts, normalize_line), lambda p: p != "")


def word_pieces(paragraph: Column, limit: int = MAX_WORDS) -> Column:
    """Pieces of at most `limit` words."""
    words = F.split(paragraph, " ")  # paragraphs are normalised: one space between words
    starts = F.sequence(F.lit(1), F.size(words), F.lit(limit))
    return F.transform(starts, lambda s: F.array_join(F.slice(words, s, F.lit(limit)), " "))


def units(records: DataFrame, limit: int = MAX_WORDS) -> DataFrame:
    """(document_id, record_order, record_id, page, unit_order, text, words), paragraphs split at the word limit."""
    pieces = F.flatten(F.transform(paragraphs(F.col("text")), lambda p: word_pieces(p, limit)))
    return records.select("document_id", "record_order", "record_id", "page", F.posexplode(pieces).alias("unit_order", "text")) \
                  .withColumn("words", F.size(F.split("text", " ")))


def chunk_bounds(counts: Sequence[int], target: int, maximum: int, overlap: int, minimum: int) -> list[list[tuple[int, int]]]:
    """Unit ranges [start, end) of each chunk, from the units' word counts alone.

    With running totals T a chunk from `start` ends before the first unit that takes it over `target`, or after the one
    that takes it to `maximum`. The next one starts at the earliest unit whose distance to that end is within `overlap`.
    A last chunk below `minimum` words is a second range of the one before when both together are within `maximum`.
    """
    total, ranges, start = list(accumulate(counts, initial=0)), [], 0

    def after(end: int) -> int:
        ranges.append((start, end))
        return max(start, bisect_left(total, total[end] - overlap))

    for unit in range(len(counts)):
        if unit > start and total[unit + 1] - total[start] > target:
            start = after(unit)
        if total[unit + 1] - total[start] >= maximum:
            start = after(unit + 1)
    if start < len(counts):
        ranges.append((start, len(counts)))
    words = lambda r: total[r[1]] - total[r[0]]
    if len(ranges) > 1 and words(ranges[-1]) < minimum and words(ranges[-2]) + words(ranges[-1]) <= maximum:
        return [*([r] for r in ranges[:-2]), ranges[-2:]]
    return [[r] for r in ranges]


def _bound_batches(batches, limits):
    """Units (document_id, uid, words) sorted by document to rows (document_id, chunk_index, place, joined, uid)."""
    def rows(doc, uids, words):
        uid = np.concatenate(uids)
        for index, parts in enumerate(chunk_bounds(np.concatenate(words).tolist(), *limits)):
            ids = np.concatenate([uid[a:b] for a, b in parts])
            n, first = len(ids), parts[0][1] - parts[0][0]
            yield pa.RecordBatch.from_pydict({"document_id": pa.array([doc] * n, pa.string()), "chunk_index": pa.array(np.full(n, index, np.int32)), "place": pa.array(np.arange(n, dtype=np.int32)),
                                              "joined": pa.array(np.arange(n) >= first), "uid": pa.array(ids)})

    doc, uids, words = None, [], []
    for batch in batches:
        names = batch.column(0).to_pylist()
        cuts = [0, *(k for k in range(1, len(names)) if names[k] != names[k - 1]), len(names)]
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            if uids and names[a] != doc:
                yield from rows(doc, uids, words)
                uids, words = [], []
            doc = names[a]
            uids.append(batch.column(1)[a:b].to_numpy())
            words.append(batch.column(2)[a:b].to_numpy())
    if uids:
        yield from rows(doc, uids, words)


def chunk(records: DataFrame, target: int = TARGET_WORDS, maximum: int = MAX_WORDS, overlap: int = OVERLAP_WORDS, minimum: int = MIN_WORDS) -> DataFrame:
    """Greedy chunks of whole units per document.

    Which units make a chunk follows from their word counts: only ids and counts are brought together by document. Texts
    meet by unit id and are joined per chunk, so a long document is spread over many tasks.
    """
    numbered = units(records, maximum).withColumn("uid", F.monotonically_increasing_id())
    u = Scratch(records.sparkSession, "units").table(numbered)
    light = u.select(F.col("document_id").cast("string").alias("document_id"), "uid", F.col("words").cast("int").alias("words"), "record_order", "unit_order")
    ordered = light.repartition("document_id").sortWithinPartitions("document_id", "record_order", "unit_order").select("document_id", "uid", "words")
    bounds = ordered.mapInArrow(partial(_bound_batches, limits=(target, maximum, overlap, minimum)), "document_id string, chunk_index int, place int, joined boolean, uid long")
    met = bounds.join(u.select("uid", "text", "words", "page", "record_id"), "uid")
    grouped = met.groupBy("document_id", "chunk_index").agg(
        F.sort_array(F.collect_list(F.struct("place", "joined", "text", "page", "record_id"))).alias("u"), F.sum("words").cast("int").alias("word_count"))
    body = lambda c: F.array_join(F.transform(c, lambda x: x["text"]), "\n\n")
    own = body(F.filter("u", lambda x: ~x["joined"]))  # a joined last chunk leaves the id as it was
    number = F.col("chunk_index").cast("string")
    padded = F.when(F.length(number) < 5, F.lpad(number, 5, "0")).otherwise(number)
    name = F.concat("document_id", F.lit(":chunk:"), padded, F.lit(":"), F.substring(F.sha2(F.concat("document_id", F.lit("\n"), own), 256), 1, 16))
    pages = F.array_sort(F.array_distinct(F.filter(F.transform("u", lambda x: x["page"].cast("int")), lambda p: p.isNotNull())))
    sources = F.array_distinct(F.transform("u", lambda x: x["record_id"].cast("string")))
    return grouped.select(name.alias("chunk_id"), "document_id", "chunk_index", "word_count", pages.alias("pages"), sources.alias("source_record_ids"), body(F.col("u")).alias("text"))


def index_integrity(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Chunks without vector, vectors without chunk, duplicate chunk IDs."""
    dup = chunks.groupBy("chunk_id").count().where("count > 1").select("chunk_id", F.lit("DUPLICATE_CHUNK").alias("problem"))
    return (chunks.select("chunk_id").distinct().join(vectors.select("chunk_id"), "chunk_id", "left_anti").withColumn("problem", F.lit("CHUNK_WITHOUT_VECTOR"))
            .unionByName(vectors.select("chunk_id").distinct().join(chunks.select("chunk_id"), "chunk_id", "left_anti").withColumn("problem", F.lit("VECTOR_WITHOUT_CHUNK"))).unionByName(dup))


def eligible_sources(sources: DataFrame, domains: list[str], authority: str | None = None, source_type: str | None = None) -> DataFrame:
    """APPROVED and ACTIVE sources that share a domain, optionally of one authority or type."""
    wanted = F.array(*[F.lit(d.upper()) for d in domains])
    out = sources.where((F.col("approval_status") == "APPROVED") & (F.col("retrieval_status") == "ACTIVE") & F.arrays_overlap(F.transform("applicable_domains", F.upper), wanted))
    if authority:
        out = out.where(F.col("authority_type") == authority)
    return out.where(F.col("source_type") == source_type) if source_type else out
