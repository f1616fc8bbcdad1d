"""Greedy one-to-one matching: a few rounds of mutual best pairs, then one ordered pass over what is left."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from watchfold.operators.graph import connected_components
from watchfold.session import Scratch

ROUNDS = 3


def _scan(batches):
    """Pairs in order of (label, rank): a pair is taken when both its ends are free. Ends are remembered for one label only."""
    label, left_used, right_used = None, set(), set()
    for batch in batches:
        labels, lefts, rights = (batch.column(k).to_pylist() for k in range(3))
        keep = []
        for k, (own, a, b) in enumerate(zip(labels, lefts, rights)):
            if own != label:
                label, left_used, right_used = own, set(), set()
            if a not in left_used and b not in right_used:
                left_used.add(a)
                right_used.add(b)
                keep.append(k)
        yield batch.take(pa.array(keep, pa.int64())).select([1, 2])


def greedy_one_to_one(pairs: DataFrame, left: str, right: str, order: list[str], rounds: int = ROUNDS) -> DataFrame:
    """The matching a sequential scan in `order` would choose.

    `order` is extended by both ids, which makes it strict. A pair that is the smallest of both its ends is taken by the scan
    whatever else happens, so a round takes all such pairs at once and drops their ends; best-of-end is a partial aggregate.
    After `rounds` rounds the open pairs are mostly chains of rising rank, where a round would take one pair each. They are cut
    into connected components (logarithmic in rounds), whose scans do not depend on each other, and every component is streamed
    once in order. The scan holds the taken ends of one component; the number of jobs does not grow with a chain.
    """
    scratch = Scratch(pairs.sparkSession, "matching")
    rank = F.struct(*[F.col(c) for c in order], F.col(left), F.col(right))
    candidates, (open_pairs,) = scratch.table(pairs.withColumn("__rank", rank), F.count(F.lit(1)))
    rest, taken = candidates, []
    for _ in range(rounds):
        if not open_pairs:
            break
        best_left = rest.groupBy(left).agg(F.min("__rank").alias("__rank"))
        best_right = rest.groupBy(right).agg(F.min("__rank").alias("__rank"))
        mutual = best_left.select("__rank").join(best_right.select("__rank"), "__rank")
        picks = scratch.table(mutual.select(F.col(f"__rank.{left}").alias(left), F.col(f"__rank.{right}").alias(right)))
        taken.append(picks)
        before = rest
        rest, (open_pairs,) = scratch.table(rest.join(picks.select(left), left, "left_anti").join(picks.select(right), right, "left_anti"), F.count(F.lit(1)))
        if before is not candidates:
            scratch.drop(before)
    if open_pairs:
        end = lambda side, c: F.struct(F.lit(side).alias("side"), F.col(c).cast("string").alias("id"))
        labels = connected_components(rest.select(end("l", left).alias("src"), end("r", right).alias("dst")))
        lefts = labels.where("node.side = 'l'").select(F.col("node.id").alias("__id"), F.xxhash64("component").alias("__label"))
        # two components with one hash are scanned together in order of rank, which takes the same pairs
        labelled = rest.join(lefts, rest[left].cast("string") == F.col("__id")).select("__label", left, right, "__rank")
        ordered = labelled.repartition("__label").sortWithinPartitions("__label", "__rank").select("__label", left, right)
        kinds = {f.name: f.dataType.simpleString() for f in rest.schema.fields}
        taken.append(ordered.mapInArrow(_scan, f"`{left}` {kinds[left]}, `{right}` {kinds[right]}"))
    chosen = candidates.join(reduce(DataFrame.unionByName, taken), [left, right], "left_semi") if taken else candidates.limit(0)
    return chosen.drop("__rank")
