import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from watchfold.llm import packing, simhash

DOCS = "doc_id long, text string, component_id string, FP string, size int"


def brute_components(ids, prints, radius):
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= radius
    label = np.array(ids, dtype=float)
    while True:
        new = np.array([label[row].min() for row in near])
        if (new == label).all():
            return label
        label = new


@pytest.mark.parametrize("radius", [0, 1, 2, 3])
def test_bit_sliced_pairs(radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 1 << 16, 150, dtype=np.uint16)
    values = np.unique(np.concatenate([base, base ^ 1, base ^ 3, base ^ 0x8011])).astype("<u2")
    run = np.sort(rng.integers(0, 6, len(values)))
    ends = np.searchsorted(run, run, side="right")
    i, j = simhash.bit_sliced_pairs(values.view(np.uint8).reshape(-1, 2), ends, radius)
    found = set(zip(i.tolist(), j.tolist()))
    wanted = {(a, b) for a in range(len(values)) for b in range(a + 1, len(values)) if run[a] == run[b] and int(values[a] ^ values[b]).bit_count() <= radius}
    assert found == wanted


def test_fingerprint_uses_the_hash_of_spark(spark):
    texts = ["Abc dÉ f", "a  b\tc", "one two", "", "x y z w"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    lower = F.translate("t", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.filter(F.split(lower, "[ \t-\r]+"), lambda w: w != "")
    one = [r[0] for r in rows.select(F.xxhash64(F.array_join(words, " "))).collect()]
    for k in (0, 1, 2):
        assert simhash.fingerprint(texts[k].encode()) == one[k] & (2 ** 64 - 1)
    assert simhash.fingerprint(b"") == 0 and simhash.fingerprint(None) == 0 and simhash.fingerprint(b" \t\n") == 0


def test_components_against_brute_force(spark):
    rnd = random.Random(3)
    vocabulary = [f"w{k}" for k in range(400)]
    texts = []
    for _ in range(40):
        words = rnd.choices(vocabulary, k=rnd.randint(1, 120))
        texts += [" ".join(words), " ".join(words).upper()]
        for _ in range(4):
            changed = words[:]
            changed[rnd.randrange(len(words))] = "x"
            texts.append(" ".join(changed))
    texts += [None, "", " ", "one"]
    rows = [(1000 - k, t, "x", "y", 1) for k, t in enumerate(texts)]
    found = {r.doc_id: r for r in simhash.components(spark.createDataFrame(rows, DOCS)).collect()}
    prints = np.array([simhash.fingerprint(t.encode() if t else None) for t in texts], dtype=np.uint64)
    label = brute_components([r[0] for r in rows], prints, 2)
    assert {r[0]: int(x) for r, x in zip(rows, label)} == {k: r.component_id for k, r in found.items()}
    kept = simhash.deduplicated(spark.createDataFrame(rows, DOCS))
    assert kept.columns == ["doc_id", "text", "component_id", "FP", "size"]
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(label.astype(int).tolist()))


def test_near_links_of_a_dense_group_connect_it(spark):
    prints = [0] + [1 << a | 1 << b for a in range(0, 64, 3) for b in range(a + 1, 64, 5)]
    links = simhash.near_links(spark.createDataFrame([(p if p < 1 << 63 else p - (1 << 64),) for p in prints], "fp long")).collect()
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x
    for a, b in links:
        assert ((a ^ b) & (2 ** 64 - 1)).bit_count() <= 64
        parent[root(a)] = root(b)
    assert len({root(p if p < 1 << 63 else p - (1 << 64)) for p in prints}) == 1


def test_dedup_of_repeats_nulls_and_nothing(spark):
    rows = [(5, "same text here", "", "", 1), (5, "same text here", "", "", 1), (None, "same text here", "", "", 1), (2, "other words are in this", "", "", 1), (None, "alone", "", "", 1)]
    docs = spark.createDataFrame(rows, DOCS)
    got = {(r.doc_id, r.component_id) for r in simhash.components(docs).collect()}
    assert got == {(5, 5), (None, 5), (2, 2), (None, None)}
    assert sorted((r.doc_id or -1) for r in simhash.deduplicated(docs).collect()) == [-1, -1, 2, 5]
    assert simhash.components(docs.limit(0)).count() == 0 and simhash.deduplicated(docs.limit(0)).count() == 0


def test_runs_of_letters_and_marks_have_the_ids_of_the_tokenizer():
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    tokenizer, rng = Tokenizer.from_file(path), np.random.default_rng(5)
    letters, marks = [chr(c) for c in [*range(65, 91), *range(97, 123), *range(0xC0, 0x180)]], list("!#$%&*+,-./:;=?@^_~()[]'<|>9")
    words = {"".join(rng.choice(letters, rng.integers(0, 9))) + "".join(rng.choice(marks, rng.integers(0, 6))) for _ in range(4000)} | {"it's", "we'll.", "o'", "A\u0301bc", "<|endoftext|>", "ª", "ÀÉÎÕÜß,"}
    found = packing.WordIds(path)
    found.learn({w.encode() for w in words if w})
    for w in words - {""}:
        assert np.frombuffer(found[w.encode()], "<u4").tolist() == tokenizer.encode(w, add_special_tokens=False).ids, w


def test_a_tokenizer_of_another_kind_is_refused(tmp_path):
    from tokenizers import Tokenizer, models

    Tokenizer(models.BPE({"a": 0}, [])).save(str(tmp_path / "other.json"))
    with pytest.raises(ValueError):
        packing.WordIds(str(tmp_path / "other.json"))


def test_token_ids_equal_the_tokenizer():
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    tokenizer, words = Tokenizer.from_file(path), packing.WordIds(path)
    texts = ["", " ", "a b  c\n", "Ünï ΣΑΣ foo<|endoftext|>bar don't I'LL, x\x1cy", "Á é. K z", "abc., ABC, 12.5, word.", "﻿hi   x", "<|ENDOFTEXT|> tail", "日本語 のテキスト。", "a" * 3000]
    for t in texts:
        words.learn(set(t.encode().split()))
        assert np.frombuffer(packing.token_ids(t.encode(), words), "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids + [1]


def test_words_met_once_are_forgotten():
    words = packing.WordIds(packing.default_tokenizer())
    words.learn({b"one", b"two"})
    words.learn({b"two", b"three"})
    words.shrink()
    assert set(words) == {b"two"} and not words.met_again


def test_slices_keep_every_byte(monkeypatch):
    monkeypatch.setattr(packing, "SLICE", 16)
    for text in (b"word " * 40, b"x" * 200, b"x" * 50 + b" " + b"y" * 90 + b"\nz", b""):
        assert b"".join(packing._slices(text)) == text
        assert [w for part in packing._slices(text) for w in part.split()] == text.split()


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_best_fit_keeps_every_capacity(rule):
    rng = np.random.default_rng(5)
    lengths = np.r_[rng.integers(1, 200, 400), [64] * 30, [1] * 200, 256, 256]
    sequence, offset = packing.best_fit(lengths, 256, 12, 256.0 ** 2 / 3, rule)
    for s in np.unique(sequence):
        own = np.flatnonzero(sequence == s)
        assert lengths[own].sum() <= 256 and len(own) <= 12
        assert len(own) == 1 or (lengths[own].astype(float) ** 2).sum() <= 256.0 ** 2 / 3
        at = own[np.argsort(offset[own], kind="stable")]
        assert (offset[at] == np.r_[0, np.cumsum(lengths[at])[:-1]]).all()


def test_best_fit_is_tight_without_other_limits():
    lengths = np.random.default_rng(1).integers(1, 900, 3000)
    sequence, _ = packing.best_fit(lengths, 1024, 1024, 1024.0 ** 2)
    assert sequence.max() + 1 <= -(-lengths.sum() // 1024) + 2


def test_packing_round_trip(spark, monkeypatch):
    texts = [None, "", "hello world", "word " * 9000, "short one.", "short one."] + [f"text number {k} " * (k % 40) for k in range(200)]
    rows = [(k if k != 4 else None, t, "a", "b", 1) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, DOCS)
    cut = packing.pieces(docs, with_ids=True)
    placed = packing.packed(cut)
    got = placed.collect()
    assert sum(r.length for r in got) == sum(r.length for r in cut.collect()) and all(zlib.crc32(bytes(r.ids)) == r.ids_crc32 for r in got)
    by_sequence = {}
    for r in got:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    assert len(by_sequence) <= -(-sum(r.length for r in got) // packing.CAPACITY) + 1
    whole = packing.sequences(placed).collect()
    assert sum(r.n_tokens for r in whole) == sum(r.length for r in got) and all(len(r.ids) == 4 * r.n_tokens for r in whole)
    assert packing.pack_documents(docs.limit(0)).count() == 0
