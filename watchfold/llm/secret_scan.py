"""Secrets in texts: pattern spans, and spans that look random to character Markov models. DataFrame functions only.

Base spans are the leftmost non-overlapping matches of three patterns (the whole match is the span), kept when long
enough. Positions come from cutting the text at the pattern: the lengths of the cuts and of the matches add up.

Model: two character Markov models (transition shares, backed off to the shares of single characters), one of random strings and one
of ordinary identifiers. A token of at least `MIN_TOKEN` characters outside the base spans is a secret when its mean log-likelihood
ratio for a transition is above the threshold and it mixes at least two character classes, one of them digits. Training counts all
rows: random strings are the base values found in the corpus and generated ones in common alphabets
(`GENERATED` for each row of a bounded sample); identifiers are the words of the same sample, at most `SAMPLE_DOCS` documents chosen by hash.
The threshold is the midpoint between the mean scores of both labelled sets. The driver sees transition counts only (alphabet squared).

Edge cases: a null text is empty and has no spans. Without rows both models are flat and the
method adds nothing. Repeated rows and null doc_ids are kept. Columns other than doc_id and text
are not read; `redacted` returns all columns, with text (and n_chars, where there is such a column) replaced.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log

from pyspark.sql import Column, DataFrame, functions as F

from watchfold.llm.registry import query, table

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: kind: (pattern, group whose length counts, least length); kinds in the order in which spans are listed
KINDS = {"assign": (ASSIGN, 2, 6), "access": ("AKIA[A-Z0-9]+", 0, 20), "hex": ("[0-9a-f]+", 0, 24)}
#: Only texts with such a match can have a span of the kind; a cheaper test than finding all matches.
NEEDS = {"hex": "[0-9a-f]{24}", "access": "AKIA[A-Z0-9]{16}", "assign": ASSIGN}
METHOD_KIND = "markov"
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
TOKEN = r"[A-Za-z0-9+/_=-]{16,}"
IDENTIFIER = r"[A-Za-z0-9_-]{4,}"
SAMPLE_DOCS = 20_000
BACK_OFF = 5.0
MIN_SCORE = 0.35
SPAN = "array<struct<start:int,kind:int,end:int>>"


def _code(char: Column) -> Column:
    """Place of a character in ALPHABET, from 1; 0 for any other."""
    return F.instr(F.lit(ALPHABET), char)


def _places(text: Column, pattern: str, kind: int, good) -> Column:
    """Spans of the leftmost non-overlapping matches of `pattern` that pass `good`, from the cuts around them."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    step = lambda acc, x: F.struct(
        (acc["at"] + F.length(x["gap"]) + F.length(x["hit"])).alias("at"),
        F.when(good(x["hit"]), F.concat(acc["out"], F.array(F.struct(
            (acc["at"] + F.length(x["gap"])).alias("start"), F.lit(kind).alias("kind"), (acc["at"] + F.length(x["gap"]) + F.length(x["hit"])).alias("end")))))
        .otherwise(acc["out"]).alias("out"))
    pairs = F.arrays_zip(F.slice(gaps, 1, F.size(found)).alias("gap"), found.alias("hit"))
    none = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))
    return F.aggregate(pairs, none, step)["out"]


def base_spans(text: Column) -> Column:
    """Array of (start, kind number, end) in code points, by start and then kind."""
    parts = []
    for k, (kind, (pattern, group, least)) in enumerate(KINDS.items()):
        size = (lambda hit, p=pattern, g=group: F.length(F.regexp_extract(hit, p, g))) if group else F.length
        if kind == "hex":  # a run below the length is dropped either way, and matching from 24 on lists far fewer
            pattern = "[0-9a-f]{24,}"
        parts.append(F.when(F.regexp_like(text, F.lit(NEEDS[kind])), _places(text, pattern, k, lambda hit, s=size, n=least: s(hit) >= n))
                     .otherwise(F.array().cast(SPAN)))
    return F.array_sort(F.concat(*parts))


@dataclass(frozen=True)
class Model:
    """Log-likelihood ratio (random over identifier) of each transition, row by row of ALPHABET, and the threshold."""
    ratio: tuple[float, ...]
    threshold: float


def _transitions(tokens: DataFrame) -> DataFrame:
    """(label, a, b, n): transition counts of `tokens` (label, token); partial sums before the shuffle."""
    pairs = F.transform(F.sequence(F.lit(1), F.length("token") - 1), lambda i: F.struct(
        _code(F.substr("token", i, F.lit(1))).alias("a"), _code(F.substr("token", i + 1, F.lit(1))).alias("b")))
    each = tokens.where(F.length("token") >= 2).select("label", F.explode(pairs).alias("t"))
    return each.where("t.a > 0 AND t.b > 0").groupBy("label", "t.a", "t.b").agg(F.count(F.lit(1)).alias("n"))


def labelled_tokens(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """(label, token): 1 for random strings, 0 for identifiers, from a sample of at most about `sample_docs` documents.

    The sample is chosen by the hash of the whole text. A document gives its first 200 identifiers outside its base spans; generated
    strings (hexadecimal, base 64 and base 32 like) come from hashes of the text.
    """
    total = docs.count()
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    share = min(1.0, sample_docs / max(total, 1))
    chosen = docs.select(text.alias("text")).where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)) + 1))
    rest = F.regexp_replace(F.regexp_replace("text", ASSIGN, " "), "AKIA[A-Z0-9]+|[0-9a-f]{24,}", " ")
    words = F.slice(F.regexp_extract_all(rest, F.lit(IDENTIFIER), F.lit(0)), 1, 200)
    digest = F.sha2("text", 256)
    plain64 = F.regexp_replace(F.base64(F.unhex(digest)), "[+/=]", "")
    made = F.array(F.substr(digest, F.lit(1), F.lit(40)), F.substr(plain64, F.lit(1), F.lit(32)), F.upper(F.substr(plain64, F.lit(5), F.lit(20))),
                   F.base64(F.unhex(F.sha1("text").cast("string"))))
    values = F.concat(F.regexp_extract_all("text", F.lit(ASSIGN), F.lit(2)), F.regexp_extract_all("text", F.lit("AKIA[A-Z0-9]{16,}"), F.lit(0)))
    return (chosen.select(F.lit(0).alias("label"), F.explode(words).alias("token"))
            .unionByName(chosen.select(F.lit(1).alias("label"), F.explode(F.concat(made, values)).alias("token"))))


def trained(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Model:
    counts = _transitions(labelled_tokens(docs, sample_docs)).collect()  # at most 2 x alphabet squared rows
    size = len(ALPHABET)
    n = {label: [[0.0] * size for _ in range(size)] for label in (0, 1)}
    for row in counts:
        n[row["label"]][row["a"] - 1][row["b"] - 1] += row["n"]
    chance = {}
    for label, table in n.items():  # a character's own share stands in where a transition was rarely or never seen
        follows = [sum(r[b] for r in table) + 0.5 for b in range(size)]
        share = [f / sum(follows) for f in follows]
        chance[label] = [[(r[b] + BACK_OFF * share[b]) / (sum(r) + BACK_OFF) for b in range(size)] for r in table]
    ratio = [log(chance[1][a][b] / chance[0][a][b]) for a in range(size) for b in range(size)]
    means = {}
    for label in (0, 1):
        seen = [(n[label][a][b], ratio[a * size + b]) for a in range(size) for b in range(size)]
        means[label] = sum(k * r for k, r in seen) / max(1.0, sum(k for k, _ in seen))
    return Model(tuple(ratio), max(MIN_SCORE, (means[0] + means[1]) / 2))


def score(token: Column, model: Model) -> Column:
    """Mean log-likelihood ratio for a transition of `token`, which has characters of ALPHABET only."""
    ratio = F.array(*[F.lit(float(r)) for r in model.ratio])
    codes = F.transform(F.sequence(F.lit(1), F.length(token)), lambda i: _code(F.substr(token, i, F.lit(1))))
    total = F.aggregate(codes, F.struct(F.lit(0).alias("last"), F.lit(0.0).alias("sum")), lambda acc, c: F.struct(
        c.alias("last"), (acc["sum"] + F.when((acc["last"] > 0) & (c > 0), F.get(ratio, (acc["last"] - 1) * len(ALPHABET) + c - 1)).otherwise(0.0)).alias("sum")))
    return total["sum"] / (F.length(token) - 1)


def model_spans(text: Column, base: Column, model: Model) -> Column:
    """Spans of random-looking tokens that meet no base span."""
    random = lambda hit: hit.rlike("[0-9]") & hit.rlike("[A-Za-z]") & (score(hit, model) > model.threshold)
    found = _places(text, TOKEN, len(KINDS), random)
    return F.filter(found, lambda s: ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in [*KINDS, METHOD_KIND]])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scanned(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """`docs` plus __base and __spans (base and model spans), arrays of (start, kind number, end)."""
    model = model or trained(docs)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    with_base = docs.withColumn("__base", base_spans(text))
    # a candidate is a long token with a digit and a letter: most texts have none and skip the scoring
    maybe = text.rlike("[0-9]") & text.rlike("[A-Za-z0-9+/_=-]{16}")
    return with_base.withColumn("__spans", F.when(maybe, F.array_sort(F.concat("__base", model_spans(text, F.col("__base"), model)))).otherwise(F.col("__base")))


def redacted(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """All rows and columns of `docs`, with each secret replaced by [SECRET]; overlapping spans are replaced together."""
    found = scanned(docs, model)
    step = lambda acc, s: F.when(s["start"] < acc["at"], F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out"))).otherwise(
        F.struct(s["end"].alias("at"), F.concat(acc["out"], F.substr("text", acc["at"] + 1, s["start"] - acc["at"]), F.lit("[SECRET]")).alias("out")))
    folded = F.aggregate("__spans", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step)
    clean = F.when(F.size("__spans") > 0, F.concat(folded["out"], F.substr("text", folded["at"] + 1, F.length("text")))).otherwise(F.col("text"))
    out = found.withColumn("text", clean)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size("__spans") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


@query("op4_secrets")
def op4_secrets(spark, sf_dir):
    found = scanned(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("__base", lambda s: s["kind"] == k)).cast("long")
    counts = [count(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(_listed(F.col("__base")), 256).alias("base_sha256"), _listed(F.col("__spans")).alias("spans"))
