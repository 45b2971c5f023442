"""Packing documents into training sequences by bin completion.

Sizes are white-space tokens. Pieces of CAPACITY tokens are cut from longer documents and fill a sequence alone; the
remainders are spread evenly over groups of about GROUP documents, each packed by branch and bound: around
the largest remaining piece, undominated fillings are tried, best fit first; a branch ends when its waste exceeds what a
solution with one sequence less than the incumbent can have. Fillings are built one by one from the sums that the
remaining pieces can reach, so none is begun in vain. Best-fit decreasing gives the first incumbent. The search of a
group stops after NODES fillings, or STEPS times as many steps of building them, and keeps its incumbent.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from random import Random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepweave.llm.common import table, written
from stepweave.session import ready

CAPACITY, GROUP, NODES = 2048, 4096, 20_000
#: Steps of building fillings for each of NODES.
STEPS = 100
PIECES = "array<struct<doc_id:long,start:long,end:long>>"


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: indexes of sizes by bin."""
    room: list[tuple[int, int]] = []
    bins: list[list[int]] = []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        at = bisect_left(room, (sizes[i], -1))
        if at == len(room):
            bins.append([i])
            insort(room, (capacity - sizes[i], len(bins) - 1))
        else:
            left, b = room.pop(at)
            bins[b].append(i)
            insort(room, (left - sizes[i], b))
    return bins


def lower_bound(sizes: list[int], capacity: int) -> int:
    """The larger of the volume bound and Martello and Toth's L2."""
    ordered = np.sort(np.asarray(sizes, np.int64))
    if not len(ordered):
        return 0
    sums = np.concatenate([[0], np.cumsum(ordered)])
    best = -(-int(sums[-1]) // capacity)
    for k in np.unique(ordered[ordered <= capacity // 2]).tolist():
        lo, half, hi = (int(np.searchsorted(ordered, x, side)) for x, side in ((k, "left"), (capacity // 2, "right"), (capacity - k, "right")))
        n1, n2 = len(ordered) - hi, hi - half
        rest = int(sums[half] - sums[lo]) - (n2 * capacity - int(sums[hi] - sums[half]))
        best = max(best, n1 + n2 + max(0, -(-rest // capacity)))
    return max(best, int((ordered > capacity // 2).sum()))


class _Search:
    """Depth-first bin completion over counts of sizes."""

    def __init__(self, sizes: list[int], capacity: int, nodes: int):
        self.capacity, self.nodes, self.steps = capacity, nodes, STEPS * nodes
        self.values = sorted(set(sizes))
        index = {s: i for i, s in enumerate(self.values)}
        self.count = [0] * len(self.values)
        for s in sizes:
            self.count[index[s]] += 1
        # at random: the sizes that remain stay mixed and can still fill the last bins
        self.order = list(range(len(self.values)))
        Random(0).shuffle(self.order)

    def fillings(self, room: int, waste: int) -> Iterator[tuple[int, ...]]:
        """Undominated sets of remaining sizes (as indexes) that leave at most waste of room, least left
        first; none is built before it is asked for, so what is asked for next must find the counts as they were."""
        reach = self._reach(room)
        for left in range(max(0, min(waste, room)) + 1):
            stack: list[tuple[int, int, tuple[int, ...]]] = [(len(self.order), room - left, ())] if reach[-1] >> room - left & 1 else []
            while stack and self.steps > 0:
                self.steps -= 1
                at, need, chosen = stack.pop()
                if not need:
                    if not self._dominated(chosen, left):
                        reach.clear()  # a deep search would hold many
                        yield chosen
                        reach = self._reach(room)
                    continue
                # only what the sizes before can complete: every path ends in a set
                i = self.order[at - 1]
                for n in range(min(self.count[i], need // self.values[i]) + 1):
                    if reach[at - 1] >> need - n * self.values[i] & 1:
                        stack.append((at - 1, need - n * self.values[i], chosen + (i,) * n))

    def _reach(self, room: int) -> list[int]:
        """For each number of sizes, in the search's order, the sums up to room of remaining pieces of these, as bits."""
        self.steps -= len(self.order)
        sums, within = 1, (1 << room + 1) - 1
        out = [sums]
        for i in self.order:
            for _ in range(min(self.count[i], room // self.values[i])):
                sums |= sums << self.values[i] & within
            out.append(sums)
        return out

    def _dominated(self, chosen: tuple[int, ...], left: int) -> bool:
        """Whether a remaining piece fits beside the chosen, or in place of a smaller one of them."""
        for place in (-1, *dict.fromkeys(chosen)):
            size = self.values[place] if place >= 0 else 0
            k = bisect_right(self.values, size + left) - 1
            while k > place and self.count[k] <= chosen.count(k):
                k -= 1
            if k > place:
                return True
        return False

    def run(self, incumbent: int, bound: int, total: int) -> list[list[int]] | None:
        """Bins of sizes fewer than incumbent, or None. Ends at the bound or when no steps are left."""
        best: list[list[int]] | None = None
        n = sum(self.count)
        path: list[tuple[Iterator[tuple[int, ...]], int, tuple[int, ...] | None]] = []
        bins: list[tuple[int, ...]] = []
        wasted = 0

        def take(items: tuple[int, ...], sign: int) -> None:
            for i in items:
                self.count[i] -= sign

        def expand() -> None:
            top = next(i for i in range(len(self.count) - 1, -1, -1) if self.count[i])
            self.count[top] -= 1
            allow = (incumbent - 1) * self.capacity - total - wasted
            options = self.fillings(self.capacity - self.values[top], allow) if allow >= 0 else iter(())
            self.count[top] += 1
            path.append((around(top, options), wasted, None))

        def around(top: int, options: Iterator[tuple[int, ...]]) -> Iterator[tuple[int, ...]]:
            while True:
                self.count[top] -= 1
                option = next(options, None)
                self.count[top] += 1
                if option is None:
                    return
                yield (top, *option)

        if n:
            expand()
        while path and self.nodes > 0 and self.steps > 0:
            self.nodes -= 1
            options, before, current = path.pop()
            if current is not None:
                take(current, -1)
                n += len(current)
                bins.pop()
            wasted = before
            step = next(options, None)
            if step is None:
                continue
            waste = self.capacity - sum(self.values[i] for i in step)
            path.append((options, before, step))
            take(step, 1)
            n -= len(step)
            bins.append(step)
            wasted = before + waste
            if wasted > (incumbent - 1) * self.capacity - total and n:
                continue
            if n:
                if len(bins) < incumbent - 1:
                    expand()
            elif len(bins) < incumbent:
                best, incumbent = [[self.values[i] for i in b] for b in bins], len(bins)
                if incumbent <= bound:
                    break
        return best


def pack(sizes: list[int], capacity: int = CAPACITY, nodes: int = NODES) -> list[list[int]]:
    """Indexes of sizes (1 to capacity) by bin: no bin holds more than capacity, each index is in one. The fewest bins
    possible if the search ends within its steps. Ties go to smaller indexes; no sizes give no bins."""
    bins = best_fit(sizes, capacity)
    bound = lower_bound(sizes, capacity)
    if len(bins) <= bound:
        return bins
    better = _Search(sizes, capacity, nodes).run(len(bins), bound, sum(sizes))
    if better is None:
        return bins
    by_size: dict[int, list[int]] = {}
    for i in range(len(sizes) - 1, -1, -1):
        by_size.setdefault(sizes[i], []).append(i)
    return [[by_size[s].pop() for s in b] for b in better]


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, group: int = GROUP, nodes: int = NODES) -> DataFrame:
    """(bin_id, pieces, tokens, waste): training sequences over all tokens of docs (doc_id, text, anything else).

    pieces are (doc_id, start, end) in the document's white-space tokens. Every token of every document is in one piece of
    one sequence; a sequence holds at most capacity tokens. Null, empty and blank texts have no tokens and no piece; a
    null doc_id is packed as null; repeated rows are packed again. bin_id tells sequences apart and says nothing else:
    rows are numbered as they are read, so that neither nulls nor a repeated doc_id crowd a group."""
    words = F.regexp_count(F.col("text").cast("string"), F.lit(r"[^ \t\n\r\f\x0B]+")).cast("long")
    sized = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), words.alias("size"), F.monotonically_increasing_id().alias("row")).where("size > 0"))
    whole = sized.where(F.col("size") >= capacity).select("doc_id", "row", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("size") / capacity) - 1)).alias("k"))
    start = F.col("k") * capacity
    full = whole.select(
        F.concat_ws(":", F.lit("d"), "row", "k").alias("bin_id"),
        F.array(F.struct("doc_id", start.alias("start"), (start + capacity).alias("end"))).cast(PIECES).alias("pieces"),
        F.lit(capacity).cast("long").alias("tokens"),
        F.lit(0).cast("long").alias("waste"),
    )
    rest = sized.withColumn("left", F.col("size") % capacity).where("left > 0")
    ready(docs.sparkSession)
    groups = max(1, -(-sized.count() // group))
    keyed = rest.select(F.pmod(F.xxhash64("row"), F.lit(groups)).alias("g"), "doc_id", (F.col("size") - F.col("left")).alias("start"), "left")
    piece = pa.struct([("doc_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])
    schema = pa.schema([("bin_id", pa.string()), ("pieces", pa.list_(piece)), ("tokens", pa.int64()), ("waste", pa.int64())])

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("left", "descending"), ("doc_id", "ascending"), ("start", "ascending")])
        g, ids, starts, sizes = (rows.column(i).to_pylist() for i in range(4))
        out = []
        for k, members in enumerate(pack(sizes, capacity, nodes)):
            used = sum(sizes[i] for i in members)
            out.append((f"g:{g[0]}:{k}", [{"doc_id": ids[i], "start": starts[i], "end": starts[i] + sizes[i]} for i in members], used, capacity - used))
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), schema.types)], schema=schema)

    packed = keyed.groupBy("g").applyInArrow(run, f"bin_id string, pieces {PIECES}, tokens long, waste long")
    return packed.unionAll(full)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences of CAPACITY tokens over every document."""
    return pack_documents(table(spark, sf_dir, "documents"))
