"""Best-fit packing by a configuration linear program over the length histogram.

A *configuration* is a multiset of lengths that fits one sequence. The program covers every
length's count by configurations, as few as possible. Multiplicative weights solve it: a
length's weight falls exponentially as its count is covered, and each round a knapsack
dynamic program prices all configurations at once; its table gives the best one of all and
the best that holds each single length, and those within a factor of the best are raised
in order of worth, each by what the round allows the lengths in it. The solution is rounded
down; what is left goes, longest first, to the fullest sequence that still has room, opened
ones included. Of the rounded solutions of several rounds, and best fit alone, the one of
fewest sequences counts, so there are never more than best fit needs.

The driver sees only the histogram (at most ``capacity`` rows) and makes a plan of
configurations; documents find their sequence by their rank among pieces of equal length.

Documents longer than ``capacity`` are cut into full pieces and a rest. Result: bin_id,
offset in the bin, doc_id, piece, start and n_tokens, a row for each piece; bins are
numbered from 0 without gaps.

Edge cases: null, zero and negative lengths have no pieces and no rows. Documents of any
length are cut and packed whole. Repeated rows are packed as often as they occur; pieces of
equal length are ordered by (doc_id, piece), null ids first, and equal rows among them are
interchangeable. A null id is packed like any other. An empty table
gives an empty result. Only the id and length columns are read, so other columns cannot
clash.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vexel.llm.tables import kept

CAPACITY = 2048
#: Share of a count that one round covers at most; rate of the weights; how far below the best a configuration may be; rounds at most; share of the volume that may be left uncovered.
STEP, ETA, SLACK, ROUNDS, TOLERANCE = 0.1, 4.0, 0.05, 60, 0.01
#: Pieces of one length that one window ranks, about; more are split by ranges of ids.
RANKED = 5_000_000
RESULT = "bin_id bigint, offset bigint, doc_id bigint, piece bigint, start bigint, n_tokens bigint"


def price(value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unbounded knapsack: the most value in each capacity, and the length that it takes last (0: none)."""
    capacity = len(value) - 1
    best, take = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for c in range(1, capacity + 1):
        each = value[c:0:-1] + best[:c]  # the longest first, which ties then prefer
        k = int(each.argmax())
        if each[k] > best[c - 1]:
            best[c], take[c] = each[k], c - k
        else:
            best[c] = best[c - 1]
    return best, take


def unwind(take: np.ndarray, at: np.ndarray) -> list[list[int]]:
    """For each capacity in at the lengths that fill it best, longest first."""
    spot = np.where(take > 0, np.arange(len(take)), 0)
    spot = np.maximum.accumulate(spot)  # the nearest capacity below that takes something
    held: list[list[int]] = [[] for _ in at]
    live, c = np.arange(len(at)), spot[at]
    while len(live):
        more = c > 0
        live, c = live[more], c[more]
        length = take[c]
        for k, x in zip(live.tolist(), length.tolist()):
            held[k].append(x)
        c = spot[c - length]
    return held


def solve(counts: np.ndarray) -> Iterator[dict[tuple[int, ...], float]]:
    """Amounts of configurations (lengths in descending order), round by round; counts[l] pieces have length l.

    Weights begin in proportion to length and fall by exp(-ETA) as a length is covered once.
    Rounds end once what isn't covered is a TOLERANCE of the whole volume.
    """
    capacity = len(counts) - 1
    lengths = np.flatnonzero(counts)
    demand = counts.astype(np.float64)
    volume = float(lengths @ demand[lengths])
    covered = np.zeros(capacity + 1)
    amount: dict[tuple[int, ...], float] = {}
    for _ in range(ROUNDS):
        missing = np.maximum(0, 1 - covered[lengths])
        still = lengths[missing > 0]
        if (missing * lengths * demand[lengths]).sum() <= TOLERANCE * volume:
            break
        value = np.full(capacity + 1, -np.inf)
        value[still] = still * np.exp(-ETA * (covered[still] - covered[still].min()))
        best, take = price(value)
        worth = value[still] + best[capacity - still]
        near = np.flatnonzero(worth >= (1 - SLACK) * best[capacity])
        chosen = still[near[np.argsort(-worth[near], kind="stable")]]
        room = np.minimum(STEP, np.maximum(0, 1 - covered)) * demand
        left = room.tolist()
        for length, rest in zip(chosen.tolist(), unwind(take, capacity - chosen)):
            if left[length] < 1e-9:
                continue
            config = tuple(sorted([length, *rest], reverse=True))
            times = Counter(config)
            x = min(left[k] / n for k, n in times.items())
            if x > 1e-9:
                for k, n in times.items():
                    left[k] -= n * x
                amount[config] = amount.get(config, 0.0) + x
        covered[lengths] += (room - np.array(left))[lengths] / demand[lengths]
        yield amount


@dataclass
class Plan:
    """Bins [base, base + times) hold the lengths of their configuration, longest first."""

    capacity: int
    bins: list[tuple[int, int, tuple[int, ...]]]

    @property
    def total(self) -> int:
        return sum(times for _, times, _ in self.bins)

    def ranges(self) -> np.ndarray:
        """length, first rank, first bin, pieces a bin, offset: sorted by length and rank."""
        next_rank: dict[int, int] = {}
        rows = []
        for base, times, config in self.bins:
            offset = 0
            for length in sorted(set(config), reverse=True):
                each = config.count(length)
                rank = next_rank.get(length, 0)
                rows.append((length, rank, base, each, offset))
                next_rank[length] = rank + each * times
                offset += each * length
        return np.array(sorted(rows), np.int64).reshape(-1, 5)


def plan(counts: np.ndarray) -> Plan:
    """counts[l]: how many pieces have length l, for l in 0..capacity; counts[0] is ignored.

    The program is rounded after 1, 2, 4 ... rounds and after the last, and what is left goes
    to best fit each time; the plan of fewest bins counts, plain best fit among them.
    """
    best, amount, n = rounded(counts, {}), {}, 0
    for n, amount in enumerate(solve(np.concatenate(([0], counts[1:]))), 1):
        if not n & (n - 1):
            best = min(best, rounded(counts, amount), key=lambda p: p.total)
    return min(rounded(counts, amount), best, key=lambda p: p.total) if n else best


def rounded(counts: np.ndarray, amount: dict[tuple[int, ...], float]) -> Plan:
    """Whole numbers of the configurations, and best fit for the rest."""
    capacity = len(counts) - 1
    left = counts.astype(np.int64).copy()
    left[0] = 0
    groups: dict[int, list[list]] = {}  # free space -> [times, configuration]
    spaces: list[int] = []

    def put(free: int, times: int, config: tuple[int, ...]) -> None:
        if free not in groups:
            groups[free] = []
            insort(spaces, free)
        groups[free].append([times, config])

    for config in sorted(amount, key=lambda c: (-amount[c], c)):
        held, times = np.unique(config, return_counts=True)
        n = min(int(amount[config] + 1e-9), int((left[held] // times).min()))
        if n > 0:
            left[held] -= times * n
            put(capacity - sum(config), n, config)
    for length in np.flatnonzero(left)[::-1].tolist():
        n = int(left[length])
        while n:
            at = bisect_left(spaces, length)
            if at == len(spaces):
                fits = capacity // length
                if n >= fits:
                    put(capacity - fits * length, n // fits, (length,) * fits)
                if n % fits:
                    put(capacity - n % fits * length, 1, (length,) * (n % fits))
                break
            free = spaces[at]
            times, config = groups[free].pop()
            if not groups[free]:
                del groups[free]
                spaces.pop(at)
            # As many as fit of this length go into each bin of the group.
            each = min(free // length, n)
            used = min(times, n // each)
            put(free - each * length, used, (*config, *(length,) * each))
            if times > used:
                put(free, times - used, config)
            n -= used * each
    bins, base = [], 0
    for free in sorted(groups):
        for times, config in groups[free]:
            bins.append((base, times, tuple(sorted(config, reverse=True))))
            base += times
    return Plan(capacity, bins)


def pieces(lengths: DataFrame, id_col: str, length_col: str, capacity: int) -> DataFrame:
    """doc_id, piece, start and n_tokens: full pieces, then the rest."""
    n = F.col("n")
    rows = lengths.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(length_col).cast("bigint").alias("n")).where("n > 0")
    cut = rows.select("doc_id", "n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((n - 1) / capacity).cast("bigint"))).alias("piece"))
    start = F.col("piece") * F.lit(capacity).cast("bigint")
    return cut.select("doc_id", "piece", start.alias("start"), F.least(n - start, F.lit(capacity).cast("bigint")).alias("n_tokens"))


def pack(lengths: DataFrame, id_col: str = "doc_id", length_col: str = "n_tokens", capacity: int = CAPACITY) -> DataFrame:
    """Where each piece of each document goes."""
    cut = kept(pieces(lengths, id_col, length_col, capacity), "pieces")
    histogram = cut.groupBy("n_tokens").agg(F.count("*").alias("n"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).collect()
    counts = np.zeros(capacity + 1, np.int64)
    for r in histogram:
        counts[r.n_tokens] = r.n
    salts = 1 + int(counts.max()) // RANKED
    low = min((r.low for r in histogram if r.low is not None), default=0)
    wide = max((r.high for r in histogram if r.high is not None), default=0) - low + 1
    # Ranges of ids in their own order, null ids first: ranks are those of one window over all.
    share = F.floor((F.col("doc_id").cast("double") - F.lit(float(low))) / F.lit(float(wide)) * F.lit(float(salts)))
    salted = cut.withColumn("salt", F.coalesce(F.least(share, F.lit(salts - 1)), F.lit(0)).cast("int"))
    before = F.sum("count").over(Window.partitionBy("n_tokens").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    offsets = salted.groupBy("n_tokens", "salt").count().select("n_tokens", "salt", F.coalesce(before, F.lit(0).cast("bigint")).alias("before"))
    place = F.row_number().over(Window.partitionBy("n_tokens", "salt").orderBy("doc_id", "piece"))
    ranked = salted.withColumn("place", place).join(offsets, ["n_tokens", "salt"]).select("doc_id", "piece", "start", "n_tokens", (F.col("before") + F.col("place") - 1).alias("rank"))
    ranges = plan(counts).ranges()
    order = ranges[:, 0] << 44 | ranges[:, 1]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, rank = batch.column(3).to_numpy(), batch.column(4).to_numpy()
            _, first, base, each, offset = ranges[np.searchsorted(order, n << 44 | rank, "right") - 1].T
            bins, slot = base + (rank - first) // np.maximum(each, 1), (rank - first) % np.maximum(each, 1)
            yield pa.RecordBatch.from_arrays([pa.array(bins), pa.array(offset + slot * n), *batch.columns[:4]], ["bin_id", "offset", "doc_id", "piece", "start", "n_tokens"])

    return ranked.mapInArrow(run, RESULT)
