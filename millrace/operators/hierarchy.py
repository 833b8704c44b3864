"""Problem 4: parent-child links to full hierarchies.

Leaves are peeled in rounds to expose cycles; every round also doubles the walk of what is left towards its ancestors and drops
nodes whose walk has ended, so long chains and cycles with long tails take a logarithmic number of rounds, too. When the walks
are longer than any chain can be, they stand on the cycles. Every node of a cycle is made a root.

Over all nodes one Euler tour is built (an entry and an exit arc per node, roots chained as the children of a virtual node), and
ranked by parallel list ranking. The leaves of a parent stand side by side right behind its entry, so their arcs are contracted
at once into the weight of that entry; further arcs are contracted in rounds (an arc takes in its successor where a coin of each
says so, a quarter a round), the list of at most ``small`` arcs that is left is ranked in one task, and the contracted arcs are
put back in reverse. A node's sum of weights gives its entry, the sum of its exit arc the last entry below it, and the sum of
steps down and up its depth: the descendants of a node are exactly the nodes with an entry in (entry, exit].

Ancestors, paths, roots and descendants are read off the intervals by a sweep in the order of entries. Entries are numbered
without gaps, so the sweep is cut into chunks of equal size; an interval that reaches into later chunks is handed to them.

Hot parents are split everywhere: siblings are ordered by slices of a hash, and joins on the parent are salted for parents of
more than ``HOT`` children.

Defined results: rows without a node id are ignored; repeated rows are one node; if a node's rows name several parents the
lowest counts; a parent that is null or no node makes a root; a node that is its own parent is a cycle of one; nodes below
a cycle get the cycle node they hang on as root and ``below_cycle``; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.common import Cut, slice_of

#: A join key with more rows than this is salted; a table that is smaller can have none.
HOT = 1_000_000
SALTS = 64

_NODES = "id bigint, parent bigint, root bigint, depth int, path array<bigint>, entry bigint, exit bigint, n_below bigint, on_cycle boolean, below_cycle boolean"


def spread_join(many: DataFrame, one: DataFrame, key: str, n: int, how: str = "inner", hot: int = HOT) -> DataFrame:
    """``many`` (n rows, with an ``id``) joined with ``one``, whose ``key`` is unique; keys of more than ``hot`` rows are salted."""
    if n <= hot:
        return many.join(one, key, how)
    # at most n / hot keys
    heavy = F.broadcast(many.groupBy(key).agg(F.count("*").alias("__n")).filter(F.col("__n") > hot).select(key, F.lit(True).alias("__hot")))
    salted = many.join(heavy, key, "left").withColumn("__salt", F.when(F.col("__hot"), slice_of("id", slices=SALTS)).otherwise(F.lit(-1))).drop("__hot")
    copies = F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(-1)))
    spread = one.join(heavy, key, "left").withColumn("__salt", F.explode(copies)).drop("__hot")
    return salted.join(spread, [key, "__salt"], how).drop("__salt")


class Forest:
    """The parent links of a table; ``on_cycles``, ``intervals`` and ``nodes`` read from it."""

    def __init__(self, links: DataFrame, node: str, parent: str, slices: int | None = None, small: int = 1 << 19, chunk: int = 100_000, hot: int = HOT):
        self.spark = links.sparkSession
        self.cut = Cut(self.spark, "hierarchy")
        self.small, self.chunk, self.hot = small, chunk, hot
        pairs = links.select(F.col(node).cast("bigint").alias("id"), F.col(parent).cast("bigint").alias("parent")).filter("id is not null")
        self.links = self.cut(pairs.groupBy("id").agg(F.min("parent").alias("parent")), n=F.count("*"))
        self.n = self.links._millrace_n
        # so many that no task orders more than about a million children of one parent
        self.slices = slices or max(64, self.n // 1_000_000)
        self._cycles: DataFrame | None = None
        self._intervals: DataFrame | None = None

    def on_cycles(self) -> DataFrame:
        """id of every node that is reached again from itself.

        A node that waits for no child is a leaf; one whose walk leads nowhere has ended, and so have all above it. Both are
        dropped round by round. Walks of at least as many steps as there are nodes stand on cycles, and every cycle node is
        where the walk from some node of it stands; the walks of at most ``small`` nodes are carried on in one task.
        """
        if self._cycles is None:
            cut, rows = self.cut, {"n": F.count("*")}
            asked = self.links.filter("parent is not null").groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("waits"))
            left = cut(self.links.join(asked, "id").filter("parent is not null").select("id", "parent", F.col("parent").alias("to"), "waits"), **rows)
            # nobody waits for the leaves of the first round, and their parents are told at once
            gone = self.links.filter("parent is not null").join(asked, "id", "left_anti")
            steps = 1
            while left._millrace_n > self.small and steps < self.n:
                ahead = left.select(F.col("id").alias("to"), F.col("to").alias("next"))
                keep, told = left.filter("waits > 0"), gone.groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("c"))
                walked = spread_join(keep, ahead, "to", left._millrace_n, hot=self.hot).join(told, "id", "left")
                new = cut(walked.select("id", "parent", F.col("next").alias("to"), (F.col("waits") - F.coalesce("c", F.lit(0))).alias("waits")), **rows)
                cut.drop(left)
                left, gone, steps = new, new.filter("waits = 0"), steps * 2
            if steps < self.n:
                self._cycles = cut(left.select("id", "to").repartition(1).mapInArrow(_ends_of_walks, "id bigint"))
            else:
                self._cycles = cut(left.select(F.col("to").alias("id")).distinct())
            cut.drop(left)
        return self._cycles

    def _marked(self) -> DataFrame:
        """id, up (null for a root), on_cycle, kids."""
        cut = self.cut
        known = self.links.filter("parent is not null").select("parent").distinct().join(self.links.select(F.col("id").alias("parent")), "parent").withColumn("has", F.lit(True))
        flagged = self.links.join(self.on_cycles().withColumn("on_cycle", F.lit(True)), "id", "left").withColumn("on_cycle", F.coalesce("on_cycle", F.lit(False)))
        up = F.when(F.col("has") & ~F.col("on_cycle"), F.col("parent"))
        nodes = cut(spread_join(flagged, known, "parent", self.n, "left", self.hot).select("id", "parent", up.alias("up"), "on_cycle"))
        kids = nodes.filter("up is not null").groupBy(F.col("up").alias("id")).agg(F.count("*").alias("kids"))
        marked = cut(nodes.join(kids, "id", "left").withColumn("kids", F.coalesce("kids", F.lit(0).cast("bigint"))))
        cut.drop(nodes)
        return marked

    def _tour(self, inner: DataFrame, leaves: DataFrame) -> DataFrame:
        """The arcs of all nodes with children: v and x (0: entry, 1: exit), the next arc's, weight w, step d."""
        # the next sibling in the order (slice, id), a hot parent's children being ordered slice by slice
        kids = inner.select("id", "up", slice_of("id", slices=self.slices).alias("s"))
        kids = kids.withColumn("after", F.lead("id").over(Window.partitionBy("up", "s").orderBy("id")))
        firsts = kids.groupBy("up", "s").agg(F.min("id").alias("first"))
        firsts = firsts.withColumn("later", F.lead("first").over(Window.partitionBy("up").orderBy("s")))
        named = firsts.select(F.col("up").alias("u2"), F.col("s").alias("s2"), "later")
        kids = kids.join(named, F.col("up").eqNullSafe(F.col("u2")) & (F.col("s") == F.col("s2"))).select("id", F.coalesce("after", "later").alias("sibling"))
        eldest = firsts.filter("up is not null").groupBy(F.col("up").alias("id")).agg(F.min_by("first", "s").alias("eldest"))
        near = leaves.filter("up is not null").groupBy(F.col("up").alias("id")).agg(F.count("*").alias("near"))
        wide = inner.select("id", "up").join(kids, "id").join(eldest, "id", "left").join(near, "id", "left")
        n, x = (lambda c: F.col(c).cast("bigint")), (lambda k: F.lit(k).cast("tinyint"))
        down = F.struct(n("id").alias("v"), x(0).alias("x"), F.coalesce("eldest", "id").alias("nv"), F.when(F.col("eldest").isNull(), x(1)).otherwise(x(0)).alias("nx"), (F.coalesce("near", F.lit(0)) + 1).cast("bigint").alias("w"), F.lit(1).cast("bigint").alias("d"))
        back = F.struct(n("id").alias("v"), x(1).alias("x"), F.coalesce("sibling", "up").alias("nv"), F.when(F.col("sibling").isNotNull(), x(0)).when(F.col("up").isNotNull(), x(1)).alias("nx"), F.lit(0).cast("bigint").alias("w"), F.lit(-1).cast("bigint").alias("d"))
        return wide.select(F.explode(F.array(down, back)).alias("a")).select("a.*")

    def _ranked(self, arcs: DataFrame) -> DataFrame:
        """v, x, w, d: the sums of each arc's and all later arcs' weights and steps."""
        cut, rounds = self.cut, []
        at = cut(arcs, n=F.count("*"))
        n, k = at._millrace_n, 0
        while n > self.small:
            coin = lambda v, x, k=k: F.pmod(F.xxhash64(v, x, F.lit(k)), F.lit(2))
            takes = (coin("v", "x") == 0) & F.coalesce(coin("nv", "nx") == 1, F.lit(False)) & F.col("nv").isNotNull()
            taker = at.filter(takes).select(F.col("v").alias("tv"), F.col("x").alias("tx"), F.col("nv").alias("v"), F.col("nx").alias("x"), F.col("w").alias("tw"), F.col("d").alias("td"))
            none = F.lit(None).cast("bigint")
            pairs = at.filter(coin("v", "x") == 1).join(taker, ["v", "x"], "left")
            stays = F.struct(F.coalesce("tv", "v").alias("v"), F.coalesce("tx", "x").alias("x"), F.col("nv").alias("nv"), F.col("nx").alias("nx"), (F.col("w") + F.coalesce("tw", F.lit(0))).alias("w"), (F.col("d") + F.coalesce("td", F.lit(0))).alias("d"), F.lit(False).alias("out"))
            taken = F.struct("v", "x", F.col("tv").alias("nv"), F.col("tx").alias("nx"), F.coalesce("tw", none).alias("w"), F.coalesce("td", none).alias("d"), F.lit(True).alias("out"))
            both = pairs.select(F.explode(F.when(F.col("tv").isNull(), F.array(stays)).otherwise(F.array(stays, taken))).alias("a")).select("a.*")
            rest = at.filter((coin("v", "x") == 0) & ~takes).select("v", "x", "nv", "nx", "w", "d", F.lit(False).alias("out"))
            step = cut(rest.unionByName(both), by="out", n=F.count_if(~F.col("out")))
            cut.drop(at)
            at = step.filter("not out").drop("out")
            at._millrace_path = f"{step._millrace_path}/out=false"
            rounds.append(step.filter("out").drop("out"))
            n, k = step._millrace_n, k + 1
        known = cut(at.repartition(1).mapInArrow(_rank_list, "v bigint, x tinyint, w bigint, d bigint"))
        cut.drop(at)
        for gone in reversed(rounds):
            # what was taken in comes right behind the weight its taker had by then
            found = gone.join(known.select(F.col("v").alias("nv"), F.col("x").alias("nx"), F.col("w").alias("kw"), F.col("d").alias("kd")), ["nv", "nx"])
            new = cut(known.unionByName(found.select("v", "x", (F.col("kw") - F.col("w")).alias("w"), (F.col("kd") - F.col("d")).alias("d"))))
            cut.drop(known)
            known = new
        return known

    def intervals(self) -> DataFrame:
        """id, parent, up, on_cycle, depth, at, last: the entry of every node in the tour over all trees and the last entry below it."""
        if self._intervals is None:
            self._intervals = self._place(self._marked())
        return self._intervals

    def _place(self, marked: DataFrame) -> DataFrame:
        inner, leaves = marked.filter("kids > 0"), marked.filter("kids = 0")
        sums = self._ranked(self._tour(inner, leaves)).groupBy(F.col("v").alias("id")).agg(*(F.max(F.when(F.col("x") == x, F.col(c))).alias(n) for c, x, n in (("w", 0, "w_in"), ("w", 1, "w_out"), ("d", 0, "d_in"))))
        # sums run to the end of the tour, arc included; single nodes come before it
        placed = sums.select("id", (F.lit(self.n + 1) - F.col("w_in")).alias("at"), (F.lit(self.n) - F.col("w_out")).alias("last"), (-F.col("d_in")).cast("int").alias("depth"))
        placed = self.cut(placed)
        # leaves stand right behind their parent's entry in the order (slice, id): one exchange orders and places them
        sliced = leaves.select("id", "parent", "up", "on_cycle", slice_of("id", slices=self.slices).alias("s"))
        counts = sliced.groupBy("up", "s").agg(F.count("*").alias("n"))
        ahead = counts.select("up", F.col("s").alias("s2"), (F.sum("n").over(Window.partitionBy("up").orderBy("s")) - F.col("n")).alias("ahead"))
        start = ahead.join(placed.select(F.col("id").alias("up"), "at", "depth"), "up", "left").select(F.col("up").alias("u2"), "s2", (F.coalesce("at", F.lit(0)) + F.col("ahead")).alias("start"), F.coalesce(F.col("depth") + 1, F.lit(0)).alias("depth"))
        own = F.row_number().over(Window.partitionBy("up", "s").orderBy("id"))
        low = sliced.withColumn("own", own).join(start, F.col("up").eqNullSafe(F.col("u2")) & (F.col("s") == F.col("s2")))
        low = low.select("id", "parent", "up", "on_cycle", "depth", (F.col("start") + F.col("own")).alias("at")).withColumn("last", F.col("at"))
        high = inner.join(placed, "id").select("id", "parent", "up", "on_cycle", "depth", "at", "last")
        return self.cut(high.unionByName(low))

    def _swept(self, intervals: DataFrame, keep: Column) -> DataFrame:
        """Rows in the order of entries, chunk by chunk, each chunk begun with the intervals that are open where it begins."""
        chunk = lambda c: F.floor((F.col(c) - 1) / self.chunk)
        home = intervals.select("*", keep.alias("keep"), chunk("at").alias("home"), F.explode(F.sequence(chunk("at"), chunk("last"))).alias("chunk"))
        return home.select("id", "parent", "depth", "at", "last", "on_cycle", "keep", "home", "chunk").repartition("chunk").sortWithinPartitions("chunk", "at")

    def nodes(self) -> DataFrame:
        """Every node: id, parent, root, depth, path (ids from the root on), entry, exit (within its tree), n_below, on_cycle, below_cycle."""
        if not self.n:
            return self.spark.createDataFrame([], _NODES)
        return self._swept(self.intervals(), F.lit(True)).mapInArrow(_paths, _NODES)

    def descendants(self, wanted: Column | None = None) -> DataFrame:
        """ancestor, id, distance: everyone whose entry lies in the interval of an ancestor that satisfies ``wanted``, a condition on ``id``."""
        if not self.n:
            return self.spark.createDataFrame([], "ancestor bigint, id bigint, distance int")
        return self._swept(self.intervals(), F.lit(True) if wanted is None else wanted).mapInArrow(_below, "ancestor bigint, id bigint, distance int")


def _ends_of_walks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Where the walks of the nodes that one task holds stand after more steps than there are nodes, if they haven't ended."""
    got = [b for b in batches if b.num_rows]
    if not got:
        return
    ids, to = (np.concatenate([np.asarray(b.column(i)) for b in got]) for i in (0, 1))
    n, order = len(ids), np.argsort(ids)
    ids, to = ids[order], to[order]
    at = np.searchsorted(ids, to).clip(0, n - 1)
    follow = np.r_[np.where(ids[at] == to, at, n), n]  # the last place stands for the end
    for _ in range(n.bit_length()):
        follow = follow[follow]
    ends = np.unique(follow)
    yield pa.RecordBatch.from_arrays([pa.array(ids[ends[ends < n]])], names=["id"])


def _rank_list(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums to the end of a list that one task holds, by pointer jumping over arrays."""
    got = [b for b in batches if b.num_rows]
    if not got:
        return
    v, x, nv, nx, w, d = (np.asarray(c.fill_null(0)) for c in (pa.concat_arrays([b.column(i) for b in got]) for i in range(6)))
    ends = np.asarray(pa.concat_arrays([b.column(2) for b in got]).is_null())
    ids, code = np.unique(v, return_inverse=True)
    place = np.full(2 * len(ids), -1)
    place[2 * code + x] = np.arange(len(v))
    follow = np.where(ends, len(v), place[np.where(ends, 0, 2 * np.searchsorted(ids, nv).clip(0, len(ids) - 1) + nx)])
    follow, w, d = np.r_[follow, len(v)], np.r_[w, 0], np.r_[d, 0]  # the last place stands for the end
    while (follow != len(v)).any():
        w, d, follow = w + w[follow], d + d[follow], follow[follow]
    yield pa.RecordBatch.from_arrays([pa.array(v), pa.array(x, pa.int8()), pa.array(w[:-1]), pa.array(d[:-1])], names=["v", "x", "w", "d"])


class _Open:
    """The intervals that are open along the sweep, by depth; batches come in the order of entries."""

    def __init__(self):
        self.held: list[np.ndarray] = [np.zeros(0, np.int64) for _ in range(4)]  # id, at, on_cycle, keep of the open nodes

    def __call__(self, batch: pa.RecordBatch):
        """(columns of the batch with the open nodes in front, where it begins, per depth: the place of each row's ancestor of that depth)."""
        idx, depth, at, cyc, keep = (np.asarray(batch.column(i)).astype(np.int64) for i in (0, 2, 3, 5, 6))
        n, before = len(idx), len(self.held[0])
        ids, ats, cycs, keeps = (np.concatenate([h, c]) for h, c in zip(self.held, (idx, at, cyc, keep)))
        deep = np.r_[np.arange(before), depth]
        places = np.arange(before + n)
        above = []
        for k in range(int(depth.max()) + 1):
            above.append(np.maximum.accumulate(np.where(deep == k, places, 0))[before:])
        last = [a[-1] for a in above[: depth[-1] + 1]]
        self.held = [c[last] for c in (ids, ats, cycs, keeps)]
        return (ids, ats, cycs, keeps), depth, above


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    opened = _Open()
    for batch in batches:
        if not batch.num_rows:
            continue
        (ids, ats, cycs, _), depth, above = opened(batch)
        home = np.asarray(batch.column(7)) == np.asarray(batch.column(8))
        offsets = np.r_[0, np.cumsum(depth + 1)]
        path = np.empty(offsets[-1], np.int64)
        for k, a in enumerate(above):
            rows = np.flatnonzero(depth >= k)
            path[offsets[rows] + k] = ids[a[rows]]
        top = above[0]
        at, last = np.asarray(batch.column(3)), np.asarray(batch.column(4))
        cyc = np.asarray(batch.column(5))
        entry = at - ats[top] + 1
        out = [
            batch.column(0), batch.column(1), pa.array(ids[top]), batch.column(2), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(path)), pa.array(entry), pa.array(last - ats[top] + 1),
            pa.array(last - at), batch.column(5), pa.array((cycs[top] > 0) & ~cyc),
        ]
        yield pa.RecordBatch.from_arrays([c.filter(pa.array(home)) for c in out], names=[x.split()[0] for x in _NODES.split(", ")])


def _below(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    opened = _Open()
    for batch in batches:
        if not batch.num_rows:
            continue
        (ids, _, _, keeps), depth, above = opened(batch)
        home = np.asarray(batch.column(7)) == np.asarray(batch.column(8))
        idx = np.asarray(batch.column(0))
        for k, a in enumerate(above):
            rows = np.flatnonzero((depth > k) & home & (keeps[a] > 0))
            if len(rows):
                yield pa.RecordBatch.from_arrays([pa.array(ids[a[rows]]), pa.array(idx[rows]), pa.array((depth[rows] - k).astype(np.int32))], names=["ancestor", "id", "distance"])
