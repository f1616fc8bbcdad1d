import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from watchfold.llm import variants

SCHEMA = "doc_id long, text string, word string, n int, cell string"
LETTERS = "abcdefgéÿ×"


def edits_one(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(a == b[:k] + b[k + 1:] for k in range(len(b)))


def brute_words(rows, noise=199, min_chars=6, min_count=5):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            if noise and h % noise == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= min_chars and n >= min_count}


def brute_groups(words, ratio=5):
    form, near = {}, {}
    for w, n in words.items():
        others = [v for v in words if abs(len(v) - len(w)) < 2 and edits_one(v, w)]
        near[w] = len(others)
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= ratio * n else None
    out = []
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, words[w], near[w], words.get(form[w])))
    return sorted(out)


def random_words(n, seed):
    rnd = random.Random(seed)
    words = {}
    for _ in range(n):
        w = "".join(rnd.choices(LETTERS, k=rnd.randint(6, 9)))
        for _ in range(rnd.randint(0, 6)):
            words[w] = int(5 * 10 ** (4 * rnd.random()))
            at = rnd.randrange(len(w))
            w = rnd.choice([w[:at] + w[at + 1:], w[:at] + rnd.choice(LETTERS) + w[at:], w[:at] + rnd.choice(LETTERS) + w[at + 1:], w[1:] + w[0]])
    return words


@pytest.mark.parametrize("groups, block_words", [(None, 2048), (2, 5), (5, 16), (12, 3)])
def test_groups_against_brute_force(spark, groups, block_words):
    words = random_words(250, 3) | {"aaaaaa" + "b" * k: 5 * 6 ** k for k in range(9)} | {"q" * 5000: 9, "q" * 4999: 60, "q" * 4999 + "z": 9}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    found = variants.variant_groups(df, groups=groups, block_words=block_words)
    assert sorted(tuple(r) for r in found.select("word", "form", "root", "n", "n_near", "form_n").collect()) == brute_groups(words)


def test_query_against_brute_force(spark, tmp_path):
    rnd = random.Random(9)
    stock = ["Streaming", "streamung", "streaming", "table", "Façade", "façades", "PIPELINE", "pipelines", "naïveté", "x×y÷zzz", "Ärzte"]
    rows = [(k, " ".join(rnd.choices(stock, k=rnd.randint(0, 60))) + rnd.choice(["", "1streaming2", "ΩstreamingĀ", "̀pipeline"])) for k in range(800)]
    rows += [(5000, None), (5001, ""), (5002, "a" * 20_000), (5003, "streaming " * 20_000), (7, "façade façade"), (7, "façade façade")]
    spark.createDataFrame([(*r, "w", 1, "c") for r in rows], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    words = brute_words(rows)
    assert sum(len(w) == 8 for w in words) > 4  # the noise has made variants
    found = sorted(tuple(r) for r in variants.op13_variants(spark, str(tmp_path)).collect())
    assert found == brute_groups(words)
    assert any(r[1] for r in found) and any(r[4] > 2 for r in found)


def test_vocabulary_without_noise(spark):
    rows = [(1, "Alphabet alphabet"), (None, "ALPHABET alphabet alphabeT"), (2, "other")]
    found = variants.vocabulary(spark.createDataFrame(rows, "doc_id long, text string"))
    assert [tuple(r) for r in found.collect()] == [("alphabet", 5)]


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert variants.vocabulary(empty).count() == 0
    assert variants.variant_groups(spark.createDataFrame([], "word string, n long")).count() == 0


def test_products_find_every_edit():
    rng = np.random.default_rng(1)
    letters = np.frombuffer("abcÀ÷".encode("latin-1"), np.uint8)
    a, b = letters[rng.integers(0, 5, (300, 6))], letters[rng.integers(0, 5, (200, 7))]
    for x, y, same in ((a, b, False), (a, a[:100], False), (a, a, True)):
        i, j = variants.near_rows(x, y, same)
        text = lambda m: [w.tobytes().decode("latin-1") for w in m]
        wanted = {(p, q) for p, u in enumerate(text(x)) for q, v in enumerate(text(y)) if edits_one(u, v) and (not same or p < q)}
        assert set(zip(i.tolist(), j.tolist())) == wanted and wanted
