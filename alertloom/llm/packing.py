"""Texts packed into containers of fixed capacity (problem 7).

Only a text's length matters for where it can go, so what is packed is the
histogram of lengths: at most as many entries as a container has tokens,
however many texts there are. Minimum bin slack: for each container a
subset-sum dynamic programme over the lengths still there, kept as the bits of
one whole number, finds the fullest feasible combination; it is used as often
as the counts allow before the next one is looked for. Texts then take the
places of their length by number.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise

CAPACITY = 2048
#: Texts of one length are numbered within so many groups, so that no length is one task.
GROUPS = 64
#: The tokenizer that is used if no other is named.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"


class Pattern(NamedTuple):
    """A combination of lengths, how many containers have it, and the number of the first of them."""

    lengths: tuple[int, ...]
    times: int
    first: int


def fullest(counts: dict[int, int], room: int) -> list[int]:
    """The lengths of a combination that leaves the least of the room, by dynamic programming over the bits of reachable sums; longer lengths first among equals."""
    steps: list[tuple[int, int, int]] = []
    sums, mask = 1, (1 << (room + 1)) - 1
    for length in sorted(counts, reverse=True):
        left, many = min(counts[length], room // length), 1
        while left > 0 and not sums >> room & 1:
            take = min(many, left)
            new = (sums | sums << length * take) & mask
            if new != sums:
                steps.append((length, take, sums))
            sums, left, many = new, left - take, many * 2
        if sums >> room & 1:
            break
    at, out = sums.bit_length() - 1, []
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            out += [length] * take
            at -= length * take
    return out


def pack_histogram(histogram: dict[int, int], capacity: int) -> list[Pattern]:
    """Containers for so many pieces of each length. The longest piece left goes into each container, the fullest combination beside it."""
    counts = {n: c for n, c in histogram.items() if c > 0 and n > 0}
    patterns, first = [], 0
    while counts:
        longest = max(counts)
        counts[longest] -= 1
        rest = fullest({n: c for n, c in counts.items() if c}, capacity - longest)
        counts[longest] += 1
        need: dict[int, int] = {longest: 1}
        for n in rest:
            need[n] = need.get(n, 0) + 1
        times = min(counts[n] // k for n, k in need.items())
        for n, k in need.items():
            counts[n] -= k * times
            if not counts[n]:
                del counts[n]
        patterns.append(Pattern(tuple(sorted([longest, *rest], reverse=True)), times, first))
        first += times
    return patterns


def places(patterns: list[Pattern]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: where the numbers of a pattern's pieces begin, how many pieces a container has, and its first container."""
    out: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    for p in patterns:
        for n in set(p.lengths):
            k = p.lengths.count(n)
            out.setdefault(n, []).append((used.get(n, 0), k, p.first))
            used[n] = used.get(n, 0) + k * p.times
    return {n: tuple(np.array(x, np.int64) for x in zip(*rows)) for n, rows in out.items()}


@lru_cache(2)
def _tokenizer(path: str):  # noqa: ANN202
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    t.no_truncation()
    return t


def count_tokens(documents: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, n): the number of tokens of every text, null and empty ones having none.

    The tokenizer's file is the one given, else what ``alertloom.tokenizer`` in
    the session's settings names, else VOCABULARY. The driver ships it to the
    executors.
    """
    spark = documents.sparkSession
    path = vocabulary or spark.conf.get("alertloom.tokenizer", VOCABULARY)
    spark.sparkContext.addFile(path)
    name = path.rsplit("/", 1)[-1]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = _tokenizer(SparkFiles.get(name))
        for pdf in batches:
            texts = [x if isinstance(x, str) else "" for x in pdf["text"]]
            counts: list[int] = []
            for k in range(0, len(texts), 64):
                counts += [len(e.ids) for e in t.encode_batch(texts[k : k + 64], add_special_tokens=False)]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n": counts})

    return documents.select("doc_id", "text").mapInPandas(run, "doc_id long, n long")


def pack(sizes: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, part, container, start, n): every piece of every text with its container.

    ``sizes`` has (doc_id, n). A text of more than ``capacity`` tokens is cut
    into full containers and a rest; no other is cut. ``start`` is the first
    token of the piece within its text. Texts without tokens take no place.
    Repeated rows are separate texts. The histogram that is packed has at most
    ``capacity`` entries whatever the number of texts.
    """
    numbered = materialise(
        sizes.where("n > 0").select(
            "doc_id",
            F.col("n").alias("total"),
            F.explode(F.sequence(F.lit(0), F.expr(f"cast((n - 1) div {capacity} as int)"))).alias("part"),
        ).select("doc_id", "part", (F.col("part").cast("long") * capacity).alias("start"), F.least(F.lit(capacity), F.col("total") - F.col("part").cast("long") * capacity).cast("int").alias("n"))
        .withColumn("grp", F.pmod(F.xxhash64("doc_id", "part"), F.lit(GROUPS)).cast("int"))
    )
    # at most capacity x GROUPS rows: the histogram, and what each group's numbering begins with
    table = numbered.groupBy("n", "grp").agg(F.count("*").alias("c")).toPandas().sort_values(["n", "grp"])
    table["begin"] = table.groupby("n")["c"].cumsum() - table["c"]
    histogram = {int(n): int(c) for n, c in table.groupby("n")["c"].sum().items()}
    where = places(pack_histogram(histogram, capacity))
    begins = {(int(n), int(g)): int(b) for n, g, b in zip(table["n"], table["grp"], table["begin"])}
    sent = sizes.sparkSession.sparkContext.broadcast((where, begins))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        where, begins = sent.value
        done: dict[tuple[int, int], int] = {}
        for pdf in batches:
            containers = np.empty(len(pdf), np.int64)
            for (n, g), rows in pdf.groupby(["n", "grp"]).indices.items():
                at = begins[int(n), int(g)] + done.get((n, g), 0) + np.arange(len(rows))
                done[n, g] = done.get((n, g), 0) + len(rows)
                starts, each, first = where[int(n)]
                k = np.searchsorted(starts, at, "right") - 1
                containers[rows] = first[k] + (at - starts[k]) // each[k]
            yield pdf.assign(container=containers)[["doc_id", "part", "container", "start", "n"]]

    # a group of a length is in one partition, so that its pieces are counted in one place
    return numbered.repartition("n", "grp").sortWithinPartitions("n", "grp", "doc_id", "part").mapInPandas(assign, "doc_id long, part int, container long, start long, n int")


def container_fill(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(containers, tokens, unused, full): how well the containers are used."""
    each = packed.groupBy("container").agg(F.sum("n").alias("n"))
    return each.agg(F.count("*").alias("containers"), F.sum("n").alias("tokens"), (F.count("*") * capacity - F.sum("n")).alias("unused"), F.sum((F.col("n") == capacity).cast("int")).alias("full"))
