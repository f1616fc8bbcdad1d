import hashlib
import random
import re
import zlib

import pytest

from watchfold.llm import periodic

SCHEMA = "doc_id long, text string, runs string, collapsed int, `__h` int"


def brute_runs(words, min_length=6, min_exponent=4):
    """Every stretch with a period that cannot be extended, its smallest period kept."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        s = 0
        while s + q < n:
            if words[s] != words[s + q]:
                s += 1
                continue
            e = s
            while e + q < n and words[e] == words[e + q]:
                e += 1
            length = e + q - s
            if length >= max(min_length, min_exponent * q):
                found.setdefault((s, length), q)
            s = e
    return sorted(((s, length, q) for (s, length), q in found.items()), key=lambda r: (r[0], r[2]))


def brute_collapsed(words, runs):
    gone = {k for s, length, q in runs for k in range(s + q, s + length)}
    return " ".join(w for k, w in enumerate(words) if k not in gone)


def brute_looped(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    return words


def fixtures():
    rnd = random.Random(11)
    texts = [[], ["a"], ["a"] * 5, ["a"] * 6, ["a"] * 300, "a b a b a b a b".split(), "x a b a b a b a b a y a a a a a a".split(), "a b c".split() * 4 + ["a", "b"] + "c d".split() * 9]
    for _ in range(300):
        words = []
        while len(words) < rnd.randint(1, 60):
            part = rnd.choices("abcd", k=rnd.randint(1, 6))
            words += part * rnd.randint(1, 7)
        texts.append(words)
    texts += [rnd.choices("ab", k=rnd.randint(1, 80)) for _ in range(200)]
    fib = ["a"], ["a", "b"]
    for _ in range(12):
        fib = fib[1], fib[1] + fib[0]
    return [*texts, fib[1]]


@pytest.mark.parametrize("min_length, min_exponent", [(6, 4), (2, 2), (4, 2), (9, 3)])
def test_runs_against_brute_force(min_length, min_exponent):
    texts = fixtures()
    found = periodic.runs_of([[w.encode() for w in t] for t in texts], min_length, min_exponent)
    for words, runs in zip(texts, found):
        assert sorted(runs, key=lambda r: (r[0], r[2])) == brute_runs(words, min_length, min_exponent), words


def test_long_texts_of_one_word_and_of_one_period():
    words = [b"w"] * 200_000
    assert periodic.runs_of([words]) == [[(0, 200_000, 1)]]
    cycle = [b"%d" % k for k in range(997)]
    assert periodic.runs_of([(cycle * 101)[:100_000], [b"z"] * 7]) == [[(0, 100_000, 997)], [(0, 7, 1)]]
    assert periodic.collapsed(words, [(0, 200_000, 1)]) == b"w"


def test_positions_keep_order():
    rnd = random.Random(4)
    values = rnd.sample(range(10 ** 6), 20_000)
    held, seen = periodic.Positions(values[0]), [values[0]]
    for x in values[1:]:
        before, after = held.add(x)
        seen.append(x)
        if len(seen) % 500 == 0:
            assert before == max((y for y in seen if y < x), default=None) and after == min((y for y in seen if y > x), default=None)
    assert list(held) == sorted(values)


def test_query_against_brute_force(spark, tmp_path):
    rnd = random.Random(7)
    texts = [None, "", " \t\n", "one", "é x \x0b" * 9, "Spam  spam\tspam spam spam spam spam"]
    texts += [" ".join(rnd.choices(["alpha", "beta", "gamma", "x"], k=rnd.randint(1, 40))) for _ in range(150)]
    texts += ["\n".join(["same line here"] * 12) + " tail", "w " * 1500]
    ids = [*range(len(texts) - 2), -5, 2 ** 40]
    rows = [(i, t, "r", 1, 2) for i, t in zip(ids, texts)] + [(3, "a a a a a a", "r", 1, 2)] * 2 + [(None, "b b b b b b b", "r", 1, 2)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    found = sorted((tuple(r) for r in periodic.op11_periodic(spark, str(tmp_path)).collect()), key=str)
    wanted = []
    for doc_id, text, *_ in rows:
        words = (text or "").split() if doc_id is None else brute_looped(doc_id, text)
        runs = brute_runs(words)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
        lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
        wanted.append((doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
                       hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(brute_collapsed(words, runs).encode()).hexdigest()))
    assert found == sorted(wanted, key=str)
    assert sum(r[1] > 0 for r in found) > 10


def test_empty_table_and_parameters(spark):
    assert periodic.periodic_runs(spark.createDataFrame([], SCHEMA)).count() == 0
    row = periodic.periodic_runs(spark.createDataFrame([(1, "go a b a b now")], "doc_id long, text string"), 4, 2).first()
    assert row.collapsed == "go a b now" and [tuple(r) for r in row.runs] == [(1, 4, 2)]
    with pytest.raises(ValueError):
        periodic.periodic_runs(spark.createDataFrame([], SCHEMA), 6, 1)
