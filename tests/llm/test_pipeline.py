import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from watchfold.llm import neardup, packing, simhash

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def corpus():
    rnd = random.Random(11)
    words = [f"{a}{b}" for a in "bcdfgklmnprst" for b in ("ane", "ore", "ist", "ume", "olk")]
    rows = []
    for k in range(60):
        text = " ".join(rnd.choices(words, k=rnd.randint(55, 140)))
        if k % 9 == 0:
            text += f" password={hashlib.md5(str(k).encode()).hexdigest()[:12]} stays"
        rows.append((k, text, "en", ["web", "books", None][k % 3]))
    rows += [(100 + k, rows[k][1], "en", "copies") for k in (1, 2, 3)] + [(200, "too short", "en", "web"), (201, None, "en", "web"), (202, "same words again " * 60, "en", "web")]
    return rows


def kept_by_quality(text):
    words = (text or "").split()
    windows = list(zip(words, words[1:], words[2:]))
    counts = Counter(windows)
    covered = {i + d for i, w in enumerate(windows) if counts[w] > 1 for d in range(3)}
    return len(words) >= 50 and 100 * len(covered) <= 50 * len(words)


def representatives(rows):
    prints = np.array([simhash.fingerprint(t.encode()) for _, t, *_ in rows], dtype=np.uint64)
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 2
    label = np.array([r[0] for r in rows])
    while True:
        new = np.array([label[n].min() for n in near])
        if (new == label).all():
            return [r for r, x in zip(rows, label) if r[0] == x]
        label = new


def copies_taken(rows):
    size = {r[0]: len(r[1].split()) for r in rows}
    own = {}
    for r in rows:
        own.setdefault(r[3], []).append(r[0])
    order = sorted(own, key=lambda s: (s is None, (s or "").encode()))
    weight, total = {s: 1 + k % 3 for k, s in enumerate(order)}, {s: sum(size[i] for i in own[s]) for s in own}
    capped, whole = set(), sum(total.values())
    while True:
        rate = (whole - sum(3 * total[s] for s in capped)) / sum(weight[s] for s in own if s not in capped)
        over = {s for s in own if s not in capped and weight[s] * rate > 3 * total[s]}
        if not over:
            break
        capped |= over
    target = {s: 3.0 * total[s] if s in capped else weight[s] * rate for s in own}
    out = {}
    for s, ids in own.items():
        rank = {i: int(hashlib.md5(str(i).encode()).hexdigest()[:12], 16) for i in ids}
        at = 0
        for i in sorted(ids, key=rank.get):
            out[i] = sum(p * total[s] + at + size[i] / 2 <= target[s] for p in range(3))
            at += size[i]
        off = target[s] - sum(size[i] * out[i] for i in ids)
        may = [i for i in ids if abs(size[i] - abs(off)) < abs(off) and (out[i] < 3 if off > 0 else out[i] > 0)]
        if may:
            best = min(may, key=lambda i: (abs(size[i] - abs(off)), rank[i]))
            out[best] += 1 if off > 0 else -1
    return out


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("sf")
    docs = spark.createDataFrame([(i, t, g, s, len(t or "")) for i, t, g, s in corpus()], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(str(folder / "documents.parquet"))
    spark.createDataFrame([(k, 1, 0) for k in range(0, 60, 4)], "doc_id long, quality int, toxic int").write.parquet(str(folder / "labels.parquet"))
    return str(folder)


def test_pipeline_against_brute_force(spark, sf_dir):
    from tokenizers import Tokenizer

    rows = [r for r in corpus() if kept_by_quality(r[1])]
    rows = representatives(rows)
    rows = [(i, ASSIGN.sub(lambda m: "[SECRET]" if len(m[2]) >= 6 else m[0], t), g, s) for i, t, g, s in rows]
    copies = copies_taken(rows)
    tokenizer, want = Tokenizer.from_file(packing.default_tokenizer()), Counter()
    for i, t, *_ in rows:
        ids = np.array(tokenizer.encode(t, add_special_tokens=False).ids + [1], "<u4")
        for n, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at:at + 4096]
            want[(i, n, at, len(part), zlib.crc32(part.tobytes()))] += copies[i]
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == +want
    assert len({r.sequence_id for r in got}) <= -(-sum(r.length for r in got) // 4096) + 1


def test_stages_keep_the_columns_of_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, none = docs.columns, docs.limit(0)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).columns == columns, name
        assert stage(spark, none, sf_dir).count() == 0, name
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "simhash_near_dedup", "secret_scan", "source_mixing", "best_fit_packing"] and corpus_pipeline.ORACLE_SQL is None


def near_copies():
    """Random texts, each with a copy in which every step-th word from the fifth on is replaced, and its similarity."""
    rnd, rows = random.Random(5), []
    for k, step in enumerate((80, 70, 60, 53, 50, 30, 20) * 3):
        words = [f"w{rnd.randrange(10 ** 6)}" for _ in range(400)]
        copy = [f"new{k}x{n}" if n % step == 4 else w for n, w in enumerate(words)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(copy))]
    return rows


def jaccard_components(rows):
    sets = {i: {tuple(t.lower().split()[k:k + 5]) for k in range(max(1, len(t.split()) - 4))} for i, t in rows}
    label = {i: i for i in sets}
    links = [(i, j) for i in sets for j in sets if i < j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    for _ in label:
        for i, j in links:
            label[i] = label[j] = min(label[i], label[j])
    return label, [len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for i, j in links]


def test_near_dedup_stage_drops_near_copies(spark):
    rows = near_copies()
    # a chain: neighbours are near, its ends are not; all share many keys
    base = [f"c{n}" for n in range(400)]
    rows += [(1000 + k, " ".join([*base[:400 - 30 * k], *(f"d{n}" for n in range(30 * k))])) for k in range(5)]
    want, similar = jaccard_components(rows)
    assert sum(0.8 <= s < 0.95 for s in similar) >= 9 and len(set(want.values())) > 10
    docs = spark.createDataFrame([(i, t, "en", "web", len(t)) for i, t in rows] + [(i + 5000, t.upper(), "en", "web", len(t)) for i, t in rows[:4]],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id for r in corpus_pipeline.near_dedup_stage(spark, docs.repartition(3), "").collect()}
    assert got == {i for i, c in want.items() if i == c}


def test_near_dedup_keeps_different_texts_of_one_doc_id(spark):
    """Shared, null and repeated doc_ids, null, empty and very long texts, and a column named as the operator's own."""
    words = [f"w{n}" for n in range(300)]
    copy, other, long = " ".join([*words[:299], "end"]), " ".join(f"x{n}" for n in range(300)), " ".join(f"y{n}" for n in range(200_000))
    rows = [(1, " ".join(words), 0), (2, copy, 0), (2, other, 0), (2, other, 0), (2, other.upper(), 0), (3, "lone text", 0), (3, "another one", 0),
            (4, None, 0), (5, "", 0), (6, " \t", 0), (7, long, 0), (8, long + " more", 0), (None, other, 0), (None, None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __place int")
    for similarity in (0.8, 0.9):
        got = neardup.deduplicated(docs.repartition(4), similarity)
        assert got.columns == docs.columns
        kept = sorted(((r.doc_id, r.text) for r in got.collect()), key=repr)
        doc2 = [x for x in kept if x[0] == 2]
        assert len(doc2) == 1 and doc2[0][1].lower() == other  # the near copy of 1 goes, the unique text stays
        assert sorted((x for x in kept if x[0] != 2), key=repr) == sorted([rows[0][:2], rows[5][:2], rows[6][:2], rows[7][:2], rows[10][:2], rows[12][:2], rows[13][:2]], key=repr)


def test_near_dedup_of_many_near_copies_and_of_one_key_of_unrelated_texts(spark):
    """2,000 near copies of one text keep one; 2,000 short texts with a common passage, too little to be near, all stay."""
    rnd = random.Random(8)
    base = [f"b{n}" for n in range(120)]
    passage = [f"p{n}" for n in range(30)]
    rows = [(k, " ".join([*base, f"tail{k}"])) for k in range(2000)]
    rows += [(10_000 + k, " ".join([*passage, *(f"u{rnd.randrange(10 ** 9)}" for _ in range(20))])) for k in range(2000)]
    got = {r.doc_id for r in neardup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()}
    assert got == {0, *range(10_000, 12_000)}


def test_sequences_keep_the_training_order(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(packing, "ORDERED_SEQUENCES", 4)
    rnd = random.Random(3)
    sizes = [rnd.randint(20, 900) for _ in range(600)]
    docs = spark.createDataFrame([(i, "word " * n) for i, n in enumerate(sizes)], "doc_id long, text string")
    docs.repartitionByRange(7, "doc_id").sortWithinPartitions("doc_id").write.option("maxRecordsPerFile", 30).parquet(str(tmp_path / "mix"))
    read = spark.read.parquet(str(tmp_path / "mix"))
    # neither from files nor in their order, but each partition in its own
    for table in (read, read.repartitionByRange(5, "doc_id").sortWithinPartitions("doc_id")):
        got = corpus_pipeline.packing_stage(spark, table, "").collect()
        assert sorted(r.doc_id for r in got) == list(range(600))
        shards, sequences = {}, {}
        for r in got:
            shards.setdefault(r.sequence_id >> 32, []).append(r.doc_id)
            sequences.setdefault(r.sequence_id, []).append((r.doc_id, r.length, r.offset))
        assert len(shards) > 8
        in_order = [shards[k] for k in sorted(shards)]
        assert all(max(a) < min(b) for a, b in zip(in_order, in_order[1:]))
        before = np.cumsum([0, *(n for _, n in sorted((r.doc_id, r.length) for r in got))])
        mean = lambda s: sum((before[i] + n / 2) * n for i, n, _ in s) / sum(n for _, n, _ in s)
        for shard in shards:
            means = [mean(sequences[k]) for k in sorted(sequences) if k >> 32 == shard]
            assert means == sorted(means)
        for s in sequences.values():
            assert sum(n for _, n, _ in s) <= packing.CAPACITY
        assert len(sequences) <= sum(r.length for r in got) / packing.CAPACITY + len(shards) + 1


def _joined(n, pairs):
    low = list(range(n))
    for i, j in pairs:
        a, b = low[i], low[j]
        low = [min(a, b) if x in (a, b) else x for x in low]
    return low


@pytest.mark.parametrize("two_blocks", [False, True])
def test_linked_rows_join_the_parts_that_all_near_pairs_join(two_blocks):
    rng = np.random.default_rng(11)
    for _ in range(60):
        base = [rng.choice(60, rng.integers(0, 40), replace=False) for _ in range(3)]
        sets = [np.unique(np.r_[b[rng.random(len(b)) > 0.08], rng.choice(1000, rng.integers(0, 4))]).astype("i8") for b in (base[k] for k in rng.integers(0, 3, rng.integers(1, 30)))]
        n, starts = len(sets), np.r_[0, np.cumsum([len(s) for s in sets])]
        block = rng.integers(0, 2, n) if two_blocks else np.zeros(n, int)
        meet = lambda i, j: len(set(block)) < 2 or block[i] != block[j]
        near = [(i, j) for i in range(n) for j in range(i + 1, n) if meet(i, j) and len(np.intersect1d(sets[i], sets[j])) >= max(1, 0.8 * len(np.union1d(sets[i], sets[j])))]
        left, right = neardup.near_rows(np.concatenate(sets), starts, np.arange(n), block, 0.8)
        assert _joined(n, zip(left, right)) == _joined(n, near) and set(zip(left, right)) <= set(near)


@pytest.mark.parametrize("room", [60, 1 << 19])
def test_open_keys_are_linked_alike_in_blocks_of_any_size(spark, room):
    """One key with 90 texts that share a passage: some near copies, most not; a second key with the same members and one without open parts."""
    rng = np.random.default_rng(3)
    shared, sets = np.arange(20), {}
    for node in range(90):
        own = rng.integers(100, 1 << 40, 15) if node % 3 else np.arange(15) + 1000 * (node % 9 + 1)
        sets[node] = np.unique(np.r_[shared, own[rng.random(15) > 0.05]])
    rows = [(key, node, len(s), node) for key in (7, 8) for node, s in sets.items()] + [(9, 0, 5, 0), (9, 3, 5, 0)]
    members = spark.createDataFrame(rows, "key long, node long, size long, part long")
    held = spark.createDataFrame([(n, s.tolist()) for n, s in sets.items()], "node long, set array<long>")
    found = neardup.run_links(members, held, 0.8, room).collect()
    near = [(i, j) for i in sets for j in sets if i < j and len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j]))]
    assert near and _joined(90, found) == _joined(90, near)
    assert neardup.run_links(members.limit(0), held, 0.8, room).count() == 0
