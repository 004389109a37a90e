"""Mix sources to target weights (problem 9) by a multivariate-hypergeometric splitting tree.

Documents are counted in tokens of a public tokenizer and hashed into blocks per source. Each source gets a token quota:
its target share of the wanted total, at most max_repeats times what it holds; what capped sources leave is filled by the
others in proportion to their targets. A quota becomes whole passes over the source's blocks and a last part of them in
permuted order, the last block cut at the document that meets the quota. The block draws of all sources are split among
the output shards by a binary tree of multivariate-hypergeometric draws, which keeps every source's number of draws exact;
shards take disjoint stretches of each source's permuted draws and shuffle their documents locally.

Only block sums (sources x blocks, both bounded) reach the driver. A source that holds a third of all documents is spread
over its blocks. One shuffle moves documents to their shards.

Defined results: documents without source, or of a source without target, stay out; empty texts count 0 tokens and are mixed
like others; a target without documents, or with max_repeats 0 or null, reaches 0 and is reported so; the same seed gives
the same mix.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pre-tokenizer pattern of that vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MOST_SOURCES, BLOCKS, SHARD_TOKENS = 1_000, 256, 200_000_000


@cache
def encoder(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(column: str, path: str = VOCABULARY):
    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = encoder(path)
        for texts in batches:
            yield pd.Series([len(enc.encode_ordinary(t)) if t else 0 for t in texts], dtype="int64")

    return count(column)


def quotas(targets: dict[str, tuple[float, int]], held: dict[str, int], total: int) -> dict[str, float]:
    """Tokens of each source: shares of total, capped, the rest filled by those with room left in proportion to their targets."""
    cap = {s: held.get(s, 0) * max(r, 0) for s, (_, r) in targets.items()}
    out, room = {}, dict(targets)
    left = min(float(total), float(sum(cap.values())))
    while room:
        weight = sum(w for w, _ in room.values())
        if weight <= 0 or left <= 0:
            out |= dict.fromkeys(room, 0.0)
            break
        full = [s for s, (w, _) in room.items() if left * w / weight >= cap[s]]
        if not full:
            out |= {s: left * w / weight for s, (w, _) in room.items()}
            break
        for s in full:
            out[s] = float(cap[s])
            left -= cap[s]
            del room[s]
    return out


def split(draws: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """shards x sources: how many draws of each source go to each shard. Column sums are exactly draws."""
    out = np.zeros((shards, len(draws)), dtype=np.int64)

    def down(lo: int, hi: int, have: np.ndarray) -> None:
        if hi - lo == 1:
            out[lo] = have
            return
        mid = (lo + hi) // 2
        take = int(round(have.sum() * (mid - lo) / (hi - lo)))
        left = rng.multivariate_hypergeometric(have, take, method="marginals") if have.sum() else have
        down(lo, mid, left)
        down(mid, hi, have - left)

    down(0, shards, draws.astype(np.int64))
    return out


def plan(blocks: dict[str, dict[int, int]], want: dict[str, float], shards: int, seed: int) -> tuple[list[tuple], list[tuple]]:
    """(draws, cuts): draws are (source, block, copy, shard); cuts are (source, block, copy, tokens) for the last, partly taken block."""
    rng = np.random.default_rng(seed)
    order: dict[str, list[tuple[int, int]]] = {}
    cuts: list[tuple] = []
    for s in sorted(want):
        own = blocks.get(s, {})
        held = sum(own.values())
        seq: list[tuple[int, int]] = []
        if own and want[s] > 0:
            passes = int(want[s] // held) if held else 0
            ids = np.array(sorted(own))
            for c in range(passes):
                seq += [(int(b), c) for b in rng.permutation(ids)]
            rest = want[s] - passes * held
            for b in rng.permutation(ids):
                if rest < 0.5:
                    break
                seq.append((int(b), passes))
                if own[int(b)] > rest:
                    cuts.append((s, int(b), passes, float(rest)))
                rest -= own[int(b)]
        order[s] = [seq[i] for i in rng.permutation(len(seq))]
    names = sorted(order)
    grid = split(np.array([len(order[s]) for s in names], dtype=np.int64), shards, rng) if names else np.zeros((shards, 0), dtype=np.int64)
    draws = []
    for j, s in enumerate(names):
        at = 0
        for h in range(shards):
            for b, c in order[s][at : at + int(grid[h, j])]:
                draws.append((s, b, c, h))
            at += int(grid[h, j])
    return draws, cuts


def sized(documents: DataFrame, targets: DataFrame, seed: int, blocks: int, path: str) -> DataFrame:
    """(source, doc_id, tokens, block) of the documents that can be mixed."""
    known = targets.select("source").filter("source is not null").distinct()
    docs = documents.filter("source is not null").join(known, "source", "left_semi")
    tokens = docs.select("source", F.col("doc_id").cast("long").alias("doc_id"), count_tokens("text", path).alias("tokens"))
    return tokens.withColumn("block", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(blocks)).cast("int"))


def mix(documents: DataFrame, targets: DataFrame, total: int | None = None, shards: int | None = None, seed: int = 7, blocks: int = BLOCKS, path: str = VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """(mixture, report).

    mixture: shard, position, source, doc_id, copy, tokens. report: source, target_share, max_repeats, held_tokens,
    mixed_tokens, documents, reached_share, met. total defaults to the tokens of all documents that can be mixed.
    """
    spark = documents.sparkSession
    rows = targets.filter("source is not null").groupBy("source").agg(F.max("target_share").alias("w"), F.max("max_repeats").alias("r")).limit(MOST_SOURCES + 1).collect()
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    goal = {r.source: (float(r.w or 0.0), int(r.r or 0)) for r in rows}
    docs = cut(sized(documents, targets, seed, blocks, path))
    sums: dict[str, dict[int, int]] = {}
    for r in docs.groupBy("source", "block").agg(F.sum("tokens").alias("t")).collect():  # at most sources x blocks rows
        sums.setdefault(r.source, {})[r.block] = int(r.t)
    held = {s: sum(b.values()) for s, b in sums.items()}
    total = sum(held.values()) if total is None else total
    want = quotas(goal, held, total)
    shards = shards or max(8, math.ceil(sum(want.values()) / SHARD_TOKENS))
    draws, cuts = plan(sums, want, shards, seed)
    drawn = spark.createDataFrame(draws, "source string, block int, copy int, shard int")
    out = docs.join(drawn, ["source", "block"])
    if cuts:
        # the documents of a cut block in their permuted order, until the quota is met at the nearest document
        part = spark.createDataFrame(cuts, "source string, block int, copy int, quota double")
        w = Window.partitionBy("source", "block", "copy").orderBy("key", "doc_id")
        edge = docs.join(part, ["source", "block"]).withColumn("key", F.xxhash64("doc_id", F.lit(seed + 1)))
        edge = edge.withColumn("before", F.sum("tokens").over(w) - F.col("tokens")).filter(F.col("before") + F.col("tokens") / 2 > F.col("quota"))
        out = out.join(edge.select("source", "block", "copy", "doc_id"), ["source", "block", "copy", "doc_id"], "left_anti")
    local = Window.partitionBy("shard").orderBy("key", "doc_id", "copy")
    out = out.withColumn("key", F.xxhash64("doc_id", "copy", F.lit(seed + 2))).withColumn("position", F.row_number().over(local))
    mixture = out.select("shard", "position", "source", "doc_id", "copy", "tokens")
    return mixture, report(mixture, targets, held)


def report(mixture: DataFrame, targets: DataFrame, held: dict[str, int]) -> DataFrame:
    spark = mixture.sparkSession
    have = spark.createDataFrame([(s, int(n)) for s, n in held.items()], "source string, held_tokens long")
    got = mixture.groupBy("source").agg(F.sum("tokens").alias("mixed_tokens"), F.count("*").alias("documents"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    goal = targets.filter("source is not null").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    rows = goal.join(have, "source", "left").join(got, "source", "left").select("source", "target_share", "max_repeats", zero("held_tokens"), zero("mixed_tokens"), zero("documents"))
    all_ = rows.agg(F.sum("mixed_tokens").alias("all_tokens"))
    share = F.when(F.col("all_tokens") > 0, F.col("mixed_tokens") / F.col("all_tokens")).otherwise(F.lit(0.0))
    return rows.crossJoin(all_).select(*rows.columns, share.alias("reached_share"), (F.abs(share - F.col("target_share")) <= 0.01).alias("met"))  # one row beside the few of the report
