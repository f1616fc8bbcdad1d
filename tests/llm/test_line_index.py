import hashlib
import random

import numpy as np
import pytest

from watchfold.llm import line_index

SCHEMA = "doc_id long, text string, n_lines string, LO int, shard int"
BLANKS = " \t\n\x0b\x0c\r"


def key_of(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(BLANKS))


def brute(rows, min_chars=40, min_documents=5):
    held = {}
    for row, (doc_id, text) in enumerate(rows):
        for key in {key_of(line) for line in (text or "").split("\n")}:
            if len(key) >= min_chars:
                held.setdefault(key, []).append(doc_id)
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        gone = [len(held.get(key_of(line), [])) >= min_documents
                and (doc_id is None or doc_id != max((d for d in held[key_of(line)] if d is not None), default=None)) for line in lines]
        out.append((doc_id, "\n".join(line for line, g in zip(lines, gone) if not g), len(lines), sum(gone)))
    return sorted(out, key=str)


def corpus():
    rnd = random.Random(5)
    common = [f"A line number {k} that stands in Many Documents, É{'x' * (k % 30)}" for k in range(60)]
    rows = []
    for doc in range(400):
        lines = []
        for _ in range(rnd.randint(0, 12)):
            kind = rnd.random()
            if kind < .5:
                line = common[min(int(rnd.expovariate(.1)), 59)]
                lines.append(rnd.choice([line, "  " + line.upper().replace("É", "É"), line + "\t\r"]))
            elif kind < .7:
                lines.append("short line")
            else:
                lines.append(f"only here {rnd.random()} and long enough to be looked at, yes")
        rows.append((doc, "\n".join(lines)))
    edge = "é" * 20 + "ß" * 20
    rows += [(1000 + k, edge) for k in range(5)] + [(2000 + k, edge[:-1]) for k in range(9)]
    rows += [(3000, None), (3001, ""), (3002, "\n\n"), (None, common[0]), (None, common[0] + "\nkeep"), (7000, common[0] + "\n" + common[0]), (7000, common[0] + "\n" + common[0])]
    return [*rows, (7001, "\n".join(common[1:4] * 3000))]


def collected(df):
    return sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in df.collect()), key=str)


@pytest.mark.parametrize("broadcast_keys, shard_keys", [(1 << 22, 1 << 16), (1 << 22, 7), (10, 7), (0.5, 16)])
def test_deduplicated_against_brute_force(spark, broadcast_keys, shard_keys):
    rows = corpus()
    docs = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA).repartition(5)
    found = collected(line_index.deduplicated(docs, broadcast_keys=broadcast_keys, shard_keys=shard_keys))
    assert found == brute(rows)
    assert sum(r[3] for r in found) > 500


def test_parameters_and_empty_table(spark):
    rows = [(1, "Menu\nhome"), (2, "menu \nx"), (3, "MENU")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert collected(line_index.deduplicated(docs, 4, 3)) == brute(rows, 4, 3)
    assert line_index.deduplicated(docs.where("doc_id > 9")).count() == 0
    lost = [(None, "x" * 40)] * 6
    assert collected(line_index.deduplicated(spark.createDataFrame(lost, "doc_id long, text string"))) == brute(lost)


@pytest.mark.parametrize("n", [1, 2, 100, 50_000])
def test_minimal_perfect_hash(n):
    rng = np.random.default_rng(n)
    lo, hi = rng.integers(0, 1 << 64, (2, n), dtype=np.uint64)
    lo[:n // 3] = lo[0]  # equal lower halves are told apart by the upper ones
    made = line_index.build_shard(lo, hi, np.arange(n), np.arange(n) * 3)
    shard = {name: values.tobytes() if name != "sizes" else values for name, values in made.items()} | {"shard": 0}
    index = line_index.LineIndex([shard], 1)
    number = index.find(lo, hi)
    assert sorted(number.tolist()) == list(range(n))
    assert (index.counts[number] == np.arange(n)).all() and (index.keepers[number] == np.arange(n) * 3).all()
    other = rng.integers(0, 1 << 64, (2, 20_000), dtype=np.uint64)
    assert (index.find(*other) == -1).all()
    assert len(made["bits"]) * 8 <= 6 * n + 64 * len(made["sizes"])


def test_query_columns(spark, tmp_path):
    spark.createDataFrame([(1, "a\nb"), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: r for r in line_index.op12_lines(spark, str(tmp_path)).collect()}
    assert rows[1].kept_sha256 == hashlib.sha256(b"a\nb").hexdigest() and rows[2].kept_sha256 == hashlib.sha256(b"").hexdigest()
    assert (rows[2].n_lines, rows[2].n_dropped) == (1, 0)
