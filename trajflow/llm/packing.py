"""Hierarchical residual packing into sequences of a fixed number of tokens.

Each partition packs its own items best fit, longest first. Sequences that are full,
or nearly so, are final. The others become items of the next round, in which the
leftovers of ``fan_in`` partitions meet, until one partition is left. Best fit leaves at
most one sequence of a partition half empty, since two would fit together. It goes on,
and with it the ``fan_in`` emptiest of the others: two that are over half full never
fit together, so a partition can fill no more of them than half-empty sequences come.
A task of a later round thus gets at most ``fan_in * (fan_in + 1)`` items, and nothing
that could still be merged is left out.

Pieces longer than ``limit`` are an error of the caller (``sequences`` cuts them);
pieces of no tokens take a place of no length. Ids may be null or repeated: pieces are
dealt to partitions by their place. Ties are broken by document id, piece and partition,
equal rows are packed as separate items, an empty table gives none.
"""

from __future__ import annotations

import functools
from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajflow.session import scratch_path

#: Items a partition packs in the first round.
ITEMS = 8_192
_FIELDS = ["doc_id", "piece", "start", "length", "ids_crc32"]
_MEMBERS = (
    "array<struct<doc_id: bigint, piece: int, start: bigint, length: bigint, ids_crc32: bigint, offset: bigint>>"
)
_BIN = f"number bigint, part int, used int, final boolean, members {_MEMBERS}"


def best_fit(lengths: list[int], limit: int) -> list[list[int]]:
    """Bins of item numbers: each item, longest first, goes where it leaves least room."""
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    bins: list[list[int]] = []
    rooms: list[int] = []  # sizes of room that some bin has, ascending
    by_room: dict[int, list[int]] = {}
    for i in order:
        size = lengths[i]
        at = bisect_left(rooms, size)
        if at == len(rooms):
            where, room = len(bins), limit
            bins.append([])
        else:
            room = rooms[at]
            where = by_room[room].pop()
            if not by_room[room]:
                del by_room[room], rooms[at]
        bins[where].append(i)
        left = room - size
        if left in by_room:
            by_room[left].append(where)
        else:
            by_room[left] = [where]
            insort(rooms, left)
    return bins


def _round(number: int, limit: int, slack: int, larger: int):
    def pack(items: pd.DataFrame) -> pd.DataFrame:
        items = items.iloc[sorted(range(len(items)), key=lambda i: _key(items["members"].iat[i][0]))]
        used, members, part = items["used"].tolist(), items["members"].tolist(), int(items["to"].iat[0])
        bins = best_fit(used, limit)
        sums = [sum(used[i] for i in b) for b in bins]
        loose = sorted((s, n) for n, s in enumerate(sums) if s < limit - slack)
        small = sum(s <= limit // 2 for s, _ in loose)
        onward = {n for _, n in loose[: small + larger]} if larger else set()
        placed = []
        for b in bins:
            at, inside = 0, []
            for m in (m for i in b for m in members[i]):
                inside.append({**{f: m[f] for f in _FIELDS}, "offset": at})
                at += m["length"]
            placed.append(inside)
        return pd.DataFrame(
            {
                "number": [(number << 56) + (part << 32) + n for n in range(len(bins))],
                "part": part,
                "used": sums,
                "final": [n not in onward for n in range(len(bins))],
                "members": placed,
            }
        )

    return pack


def _key(first) -> tuple:
    return (first["doc_id"] is None, first["doc_id"] or 0, first["piece"], first["start"])


def pack(
    pieces: DataFrame, limit: int, slack: int = 4, items: int = ITEMS, fan_in: int = 8
) -> DataFrame:
    """Give each piece (doc_id, piece, start, length, ids_crc32) a sequence and a place.

    Adds ``sequence_id`` and ``offset``. A sequence is nearly full, and so final, if at
    most ``slack`` tokens are free.
    """
    spark = pieces.sparkSession

    def kept(df: DataFrame, name: str) -> DataFrame:
        path = scratch_path(spark, name)
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    pieces = kept(pieces.select(*_FIELDS), "pieces")
    parts = -(-pieces.count() // items) or 1
    alone = F.array(F.struct(*_FIELDS, F.lit(0).cast("long").alias("offset")))
    # A full piece has nothing to be packed with; it takes a negative number.
    full = pieces.where(F.col("length") >= limit).select(
        (-1 - F.monotonically_increasing_id()).alias("number"), alone.alias("members")
    )
    current = pieces.where(F.col("length") < limit).select(
        # By place in the written table, so that rows of null or repeated ids are spread like any others.
        F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(parts)).cast("int").alias("to"),
        F.col("length").cast("int").alias("used"),
        alone.alias("members"),
    )
    done, number = [full], 0
    while True:
        step = _round(number, limit, slack, fan_in if parts > 1 else 0)
        packed = kept(current.groupBy("to").applyInPandas(step, _BIN), "bins")
        done.append(packed.where("final").select("number", "members"))
        if parts == 1:
            break
        parts, number = -(-parts // fan_in), number + 1
        current = packed.where(~F.col("final")).select(
            (F.col("part") % parts).cast("int").alias("to"), "used", "members"
        )
    bins = functools.reduce(DataFrame.unionByName, done)
    spread = bins.select(F.col("number").alias("sequence_id"), F.explode("members").alias("m"))
    return spread.select(*(f"m.{f}" for f in _FIELDS), "sequence_id", "m.offset")
