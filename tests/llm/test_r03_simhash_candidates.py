"""The near-duplicate stage takes candidates from SimHash fingerprints."""

import corpus_pipeline
from watchfold.llm import neardup, simhash
from watchfold.operators.graph import connected_components


def test_stage_links_by_fingerprints(spark, monkeypatch):
    words = [f"w{n}" for n in range(300)]
    texts = [" ".join(words), " ".join([*words, "end"]), " ".join(f"x{n}" for n in range(300))]
    held, seen = neardup.print_pairs, []
    monkeypatch.setattr(neardup, "print_pairs", lambda prints: seen.append(held(prints)) or seen[-1])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup_stage(spark, docs, "").collect()) == [0, 2] and len(seen) == 1


def test_fingerprint_pairs_connect_all_within_the_radius(spark):
    rows = [(1, 0b0), (2, 0b0), (3, 0b11), (4, 0b1111 << 40), (5, 0b1111)]
    pairs = neardup.print_pairs(spark.createDataFrame(rows, "node long, fp long"))
    assert {(r.node, r.component) for r in connected_components(pairs).collect()} == {(n, 1) for n in (1, 2, 3, 5)} and simhash.RADIUS == 2
