"""Personal data in texts: pattern spans, and spans found by a semi-Markov conditional random field.

Base spans are the leftmost non-overlapping matches of four patterns, kept when valid. They always stay.

Model: number-like and address-like zones, whole however long and without the base spans in them, are cut into tokens. A segmentation covers the
tokens with single "other" tokens and with entity segments of at most `MAX_TOKENS` tokens; an entity segment is scored as
a whole (digit count, checksum, group shape, separators, address shape, what stands on both sides), plus a weight for each pair of neighbouring
labels. The best segmentation comes from dynamic programming over end positions (boundaries and types together); a segment is
reported when its posterior probability, from forward and backward sums over all segmentations, is at least `MIN_POSTERIOR`.

Training: maximum likelihood on labelled zones from a bounded sample, at most `ZONES_PER_KIND` for each kind and as many without entities, taken by
hash from about `SAMPLE_DOCS` documents. Labels are the base spans, also rewritten in forms that the patterns miss (no plus sign, dots for
blanks, spelt-out at and dot) and in spoilt forms (broken checksum, parts above 255, too few digits), which are labelled other.

Edge cases: a null text is empty. Without labelled zones the method adds nothing. Repeated rows and null doc_ids are kept. Other columns
are not read. Whole texts are scanned; each pattern is linear in the text.
"""

from __future__ import annotations

import re
from functools import partial
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from watchfold.llm.registry import query, table
from watchfold.session import Scratch

KINDS = ("email", "ip", "card", "phone")
MAX_TOKENS, MIN_POSTERIOR = 24, 0.9
SAMPLE_DOCS, ZONES_PER_KIND = 20_000, 30
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile("[0-9]")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _octets(text: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in text.split("."))


def _emails(text: str):
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            done = found.end()
        at = text.find("@", done if found else at + 1)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of all kinds, by start and then kind."""
    out = [(s, 0, e) for s, e in _emails(text)]
    if DIGIT.search(text):
        out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if _octets(m[0])]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= sum(map(str.isdigit, m[0])) <= 15]
    return sorted(out)


TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|\s|.", re.S)
NUMBERS = re.compile(r"[+(]?[0-9][0-9 ().+-]{5,}[0-9]")
WORD_AT = re.compile(r"[A-Za-z0-9._%+-]{1,64} ?(?:@|\(at\)|\[at\]|\bat\b) ?[A-Za-z0-9-]{1,64}(?: ?(?:\.|\(dot\)|\[dot\]|\bdot\b) ?[A-Za-z0-9-]{1,64}){1,8}", re.I)
ADDRESS = re.compile(r"[A-Za-z0-9._%+-]+ ?(?:@|\(at\)|\[at\]|\bat\b) ?[A-Za-z0-9-]+(?: ?(?:\.|\(dot\)|\[dot\]|\bdot\b) ?[A-Za-z0-9-]+)+", re.I)
SPELT = re.compile(r"\((?:at|dot)\)|\[(?:at|dot)\]|\bdot\b", re.I)
HINTS = (re.compile(r"mail|contact|write", re.I), re.compile(r"\bip\b|host|addr", re.I), re.compile(r"card|visa|pay", re.I), re.compile(r"tel|phone|call|fax|mobil", re.I))
ENDS = re.compile(r"[A-Za-z0-9+(]")
N_FEATURES = 32
TRAINING_ZONE = 62  # characters: bounds what the driver gets
LEAST = 7  # characters of a segment
WINDOW_TOKENS = 512


def zones(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Parts of the text that may hold an entity which no base span meets: whole runs of numbers and addresses, base spans cut out."""
    found = [m.span() for m in NUMBERS.finditer(text)] if DIGIT.search(text) else []
    if SPELT.search(text):
        found += [m.span() for m in WORD_AT.finditer(text)]
    whole = []
    for start, end in sorted(found):
        if whole and start < whole[-1][1]:
            whole[-1] = (whole[-1][0], max(end, whole[-1][1]))
        else:
            whole.append((start, end))
    taken = []  # base spans, those that overlap as one
    for s, _, e in base:
        if taken and s <= taken[-1][1]:
            taken[-1] = (taken[-1][0], max(e, taken[-1][1]))
        else:
            taken.append((s, e))
    out, b = [], 0
    for start, end in whole:
        while b < len(taken) and taken[b][1] <= start:
            b += 1
        k = b
        while k < len(taken) and taken[k][0] < end:
            if start < taken[k][0]:
                out.append((start, taken[k][0]))
            start = max(start, taken[k][1])
            k += 1
        if start < end:
            out.append((start, end))
    return [(s, e) for s, e in out if e - s >= LEAST]


def features(text: str, start: int, end: int) -> np.ndarray:
    """Of a whole candidate span and its surroundings."""
    s, f = text[start:end], np.zeros(N_FEATURES)
    digits = "".join(filter(str.isdigit, s)) if s.isascii() else "".join(c for c in s if c in "0123456789")
    n, groups = len(digits), re.findall("[0-9]+", s)
    f[0] = 1
    f[1 + int(np.searchsorted([1, 7, 10, 12, 14, 17, 20], n, "right"))] = 1
    f[9] = 13 <= n <= 19 and luhn(digits)
    f[10] = 13 <= n <= 19 and not luhn(digits)
    quad = re.fullmatch(r"[0-9]+(?:\.[0-9]+){3}", s)
    f[11] = bool(quad) and _octets(s)
    f[12] = bool(quad) and not _octets(s)
    address = ADDRESS.fullmatch(s)
    f[13], f[14], f[15] = bool(address), "@" in s, bool(SPELT.search(s))
    letters = bool(re.search("[A-Za-z]", s))
    f[16], f[17], f[18] = s[0] == "+", s[0] == "(" and ")" in s, letters
    f[19], f[20], f[21] = " " in s, "-" in s, "." in s
    f[22 + min(len(groups), 5) - 1 if groups else 27] = 1
    f[28] = len(groups) == 4 and all(len(g) == 4 for g in groups)
    around = (text[start - 1:start] or " ") + (text[end:end + 1] or " ")
    f[29] = around[0].isalnum() or around[0] in "+.-/_:#="
    f[30] = around[1].isalnum() or around[1] in "-/_%" or (around[1] == "." and text[end + 1:end + 2].isalnum())
    f[31] = not letters and all(1 <= len(g) <= 4 for g in groups) and len(groups) >= 3
    return f


def hints(text: str, start: int) -> np.ndarray:
    """For each kind: a word that announces it stands shortly before."""
    before = text[max(0, start - 16):start]
    return np.array([0.0] + [float(bool(h.search(before))) for h in HINTS])


class Zone:
    """Tokens of a part of a text and its candidate segments with their features."""

    def __init__(self, text: str, start: int, end: int):
        self.tokens = [m.span() for m in TOKEN.finditer(text, start, end)]
        n = len(self.tokens)
        self.segments = []
        rows, cues = [], []
        for i in range(n):
            if not ENDS.match(text, self.tokens[i][0]):
                continue
            for j in range(i, min(n, i + MAX_TOKENS)):
                a, b = self.tokens[i][0], self.tokens[j][1]
                if b - a >= LEAST and text[b - 1].isalnum() and (DIGIT.search(text, a, b) or SPELT.search(text, a, b)) and (
                        sum(map(str.isdigit, text[a:b])) >= 7 or (not text[a].isspace() and ("@" in text[a:b] or SPELT.search(text, a, b))) or text[a:b].count(".") == 3):
                    self.segments.append((i, j + 1))
                    rows.append(features(text, a, b))
                    cues.append(hints(text, a))
        self.features = np.array(rows).reshape(-1, N_FEATURES)
        self.cues = np.array(cues).reshape(-1, len(KINDS) + 1)

    def spans(self, chosen):
        return [(self.tokens[i][0], k - 1, self.tokens[j - 1][1]) for (i, j), k in chosen]


class Model:
    """Weights: kinds x features, a cue weight for each kind, and label pairs (0: other)."""

    def __init__(self):
        n = len(KINDS) + 1
        self.w, self.cue, self.pair = np.zeros((n, N_FEATURES)), np.zeros(n), np.zeros((n, n))

    def _scores(self, z: Zone) -> np.ndarray:
        out = z.features @ self.w.T + z.cues * self.cue
        out[:, 0] = -np.inf  # a segment of other is one token and scores 0
        return out

    def _by_end(self, z: Zone):
        ends = [[] for _ in range(len(z.tokens) + 1)]
        for k, (_, j) in enumerate(z.segments):
            ends[j].append(k)
        return ends

    def _sums(self, z: Zone):
        """Forward and backward log sums by position and label of the segment that ends there; segment scores."""
        n, labels = len(z.tokens), len(self.cue)
        score, ends = self._scores(z), self._by_end(z)
        step = np.full((n + 1, labels), -np.inf)  # forward
        step[0, 0] = 0.0
        other = np.full(labels, -np.inf)
        other[0] = 0.0
        arrive = np.empty((n + 1, labels))
        for j in range(n + 1):
            if j:
                terms = [arrive[j - 1] + other] + [arrive[z.segments[k][0]] + score[k] for k in ends[j]]
                step[j] = np.logaddexp.reduce(terms)
            arrive[j] = np.logaddexp.reduce(step[j][:, None] + self.pair, axis=0)
        starts = [[] for _ in range(n + 1)]
        for k, (i, _) in enumerate(z.segments):
            starts[i].append(k)
        back = np.zeros((n + 1, labels))
        for i in range(n - 1, -1, -1):
            terms = [other + back[i + 1]] + [score[k] + back[z.segments[k][1]] for k in starts[i]]
            back[i] = np.logaddexp.reduce(self.pair + np.logaddexp.reduce(terms)[None, :], axis=1)
        return step, arrive, back, score

    def posteriors(self, z: Zone):
        """Probability of each (segment, kind)."""
        step, arrive, back, score = self._sums(z)
        total = np.logaddexp.reduce(step[-1])
        i, j = np.array(z.segments).reshape(-1, 2).T
        return np.exp(arrive[i] + score + back[j] - total)

    def best(self, z: Zone) -> list[tuple[tuple[int, int], int]]:
        """((first token, end token), kind number + 1) of the entities of the best segmentation."""
        n, labels = len(z.tokens), len(self.cue)
        score, ends = self._scores(z), self._by_end(z)
        value = np.full((n + 1, labels), -np.inf)
        value[0, 0] = 0.0
        origin = {}
        for j in range(1, n + 1):
            reach = value[j - 1] + self.pair[:, 0]
            value[j, 0], origin[j, 0] = reach.max(), (j - 1, int(reach.argmax()), None)
            for k in ends[j]:
                i = z.segments[k][0]
                come = value[i][:, None] + self.pair
                for y in range(1, labels):
                    v = come[:, y].max() + score[k, y]
                    if v > value[j, y]:
                        value[j, y], origin[j, y] = v, (i, int(come[:, y].argmax()), k)
        at, y, out = n, int(value[n].argmax()), []
        while at > 0:
            before, last, k = origin[at, y]
            if k is not None:
                out.append((k, y))
            at, y = before, last
        return out[::-1]

    def found(self, text: str, start: int, end: int) -> list[tuple[int, int, int]]:
        """Entities of a zone. A long one is scored in windows that overlap by four longest segments, each span taken from the window
        in whose middle it starts, so that it stands there whole and with what surrounds it."""
        tokens = [m.span() for m in TOKEN.finditer(text, start, end)]
        if len(tokens) <= WINDOW_TOKENS:
            return self._found(text, start, end)
        out, half = [], 2 * MAX_TOKENS
        for at in range(0, len(tokens), WINDOW_TOKENS):
            upto = min(at + WINDOW_TOKENS, len(tokens))
            low, high = tokens[at][0], tokens[upto - 1][1]
            for span in self._found(text, tokens[max(0, at - half)][0], tokens[min(upto + half, len(tokens)) - 1][1]):
                if low <= span[0] < high and (not out or span[0] >= out[-1][2]):
                    out.append(span)
        return out

    def _found(self, text: str, start: int, end: int) -> list[tuple[int, int, int]]:
        z = Zone(text, start, end)
        if not z.segments:
            return []
        p = self.posteriors(z)
        return z.spans([(z.segments[k], y) for k, y in self.best(z) if p[k, y] >= MIN_POSTERIOR])

    def learn(self, samples: list[tuple[Zone, dict[int, int]]], rounds: int = 8, rate: float = 0.5, decay: float = 1e-4) -> None:
        """Gradient steps on the log-likelihood. A sample is a zone and its true {segment: label}."""
        seen = [np.full_like(x, 1e-6) for x in (self.w, self.cue, self.pair)]
        for _ in range(rounds):
            for z, truth in samples:
                step, arrive, back, score = self._sums(z)
                total = np.logaddexp.reduce(step[-1])
                i, j = np.array(z.segments).reshape(-1, 2).T
                p = -np.exp(arrive[i] + score + back[j] - total)
                for k, y in truth.items():
                    p[k, y] += 1
                p[:, 0] = 0
                pair = self._pair_gradient(z, truth, step, back, score, total)
                for x, g, s in zip((self.w, self.cue, self.pair), (p.T @ z.features, (p * z.cues).sum(0), pair), seen):
                    g = g - decay * x
                    s += g * g
                    x += rate * g / np.sqrt(s)

    def _pair_gradient(self, z, truth, step, back, score, total):
        grad = np.zeros_like(self.pair)
        ahead = np.full((len(z.tokens) + 1, len(self.cue)), -np.inf)  # best continuation sums by label of the next segment
        ahead[:-1, 0] = back[1:, 0]
        for k, (i, j) in enumerate(z.segments):
            ahead[i] = np.logaddexp(ahead[i], score[k] + back[j])
        for i in range(len(z.tokens)):
            grad -= np.exp(step[i][:, None] + self.pair + ahead[i][None, :] - total)
        last, at = 0, 0
        by_start = {z.segments[k][0]: (k, y) for k, y in truth.items()}
        while at < len(z.tokens):
            k, y = by_start.get(at, (None, 0))
            grad[last, y] += 1
            last, at = y, z.segments[k][1] if k is not None else at + 1
        return grad


def variants(kind: int, s: str) -> list[tuple[str, bool]]:
    """Other writings of an entity, and whether they are still one."""
    if kind == 0:
        name, _, host = s.partition("@")
        return [(s, True), (f"{name} (at) {host.replace('.', ' (dot) ')}", True), (f"{name}[at]{host.replace('.', '[dot]')}", True), (f"{name} at {host.replace('.', ' dot ')}", True)]
    if kind == 1:
        return [(s, True), ("9" + s.replace(".", ".7"), False), (s.rsplit(".", 1)[0], False)]
    digits = "".join(filter(str.isdigit, s))
    if kind == 2:
        broken = digits[:-1] + str((int(digits[-1]) + 5) % 10)
        cut = lambda d, by: by.join(d[i:i + 4] for i in range(0, len(d), 4))
        return [(s, True), (cut(digits, "."), True), (cut(broken, " "), False), (broken, False), (digits[:9], False)]
    local = f"({digits[-10:-7]}) {digits[-7:-4]}-{digits[-4:]}"
    return [(s, True), (local, True), (f"{digits[-10:-7]}-{digits[-7:-4]}-{digits[-4:]}", True), (f"00{digits[:2]} {digits[2:5]} {digits[5:]}", True), (digits[:8], False),
            (f"{digits[:4]}-{digits[4:6]}-{digits[6:8]}", False)]


def training_zones(rows: list[tuple[int, str, str, str]]) -> list[tuple[Zone, dict[int, int]]]:
    """Labelled zones from (kind number or -1, text before, the span, text after)."""
    out = []
    for kind, before, span, after in rows:
        for written, real in variants(kind, span) if kind >= 0 else [(span, False)]:
            text = before + written + after
            lead = max([0, *(m.end() for m in re.finditer(r"\s", before[:-1]))][-3:], default=0) if before else 0
            z = Zone(text, lead, min(len(text), len(before) + len(written) + 12))
            if not z.segments:
                continue
            where = [k for k, (i, j) in enumerate(z.segments) if (z.tokens[i][0], z.tokens[j - 1][1]) == (len(before), len(before) + len(written))]
            if real and where:
                out.append((z, {where[0]: kind + 1}))
            elif not real:
                out.append((z, {}))
    return out


def _sample_batches(batches):
    for batch in batches:
        rows = []
        for value in batch.column(0):
            text = value.as_py() or ""
            base = base_spans(text)
            for s, kind, e in base[:20]:
                rows.append((kind, text[max(0, s - 24):s], text[s:e], text[e:e + 24]))
            for s, e in zones(text, base)[:20]:
                e = min(e, s + TRAINING_ZONE)
                rows.append((-1, text[max(0, s - 24):s], text[s:e], text[e:e + 24]))
        columns = list(zip(*rows)) or [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *[pa.array(c, pa.string()) for c in columns[1:]]], ["kind", "before", "span", "after"])


def trained(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, per_kind: int = ZONES_PER_KIND) -> Model | None:
    """The model, or None without labelled entities. The driver gets at most five times `per_kind` short zones."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    share = min(1.0, sample_docs / max(docs.count(), 1))
    chosen = docs.select(text.alias("text")).where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)) + 1)).where(text.rlike("[0-9@]"))
    rows = Scratch(docs.sparkSession, "zones").table(chosen.mapInArrow(_sample_batches, "kind int, before string, span string, after string").distinct())
    order = [F.xxhash64("before", "span", "after"), F.col("before"), F.col("span"), F.col("after")]
    few = [r for kind in range(-1, len(KINDS)) for r in rows.where(F.col("kind") == kind).orderBy(*order).limit(per_kind).collect()]
    samples = training_zones([tuple(r) for r in few])
    if not any(truth for _, truth in samples):
        return None
    order = np.random.default_rng(7).permutation(len(samples))
    model = Model()
    model.learn([samples[k] for k in order])
    return model


def spans(text: str, model: Model | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and all spans."""
    base = base_spans(text)
    if model is None:
        return base, base
    more = list(chain.from_iterable(model.found(text, s, e) for s, e in zones(text, base)))
    return base, sorted(base + more) if more else base


def listed(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in found)


def _span_batches(batches, model):
    empty = ([], [])
    for batch in batches:
        rows = [spans(t, model) if t else empty for t in (v.as_py() for v in batch.column(1))]
        counts = [pa.array([sum(k == kind for _, k, _ in base) for base, _ in rows], pa.int64()) for kind in range(len(KINDS))]
        yield pa.RecordBatch.from_arrays([batch.column(0), *counts, pa.array([listed(b) for b, _ in rows], pa.string()), pa.array([listed(a) for _, a in rows], pa.string())],
                                         ["doc_id", *[f"n_{k}" for k in KINDS], "base", "spans"])


def found_spans(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, n_ of each kind, base, spans) for every row; base and spans list kind:start:end."""
    model = model or trained(docs)
    kind = docs.schema["doc_id"].dataType.simpleString()
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(partial(_span_batches, model=model), f"doc_id {kind}, {counts}, base string, spans string")


@query("op5_pii")
def op5_pii(spark, sf_dir):
    found = found_spans(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *[f"n_{k}" for k in KINDS], F.sha2("base", 256).alias("base_sha256"), "spans")
