"""Neighbour layout of vectors in the plane (VEC-05).

1. Neighbour graph.  Up to ``EXACT_ROWS`` rows it is exact: rows travel in
   blocks of bytes to groups of query rows; a task keeps the ``k`` nearest of
   each of its queries while the blocks pass.  A matrix product of single
   precision finds the few that may be near enough, their distances are taken
   in double precision.  That took about 3.5 ns a pair with 615,384 rows, the
   descent 19 ms a row with 51,282, so up to there it should cost less; and in
   many dimensions without structure the descent misses more the more rows there are.
   Beyond, by neighbour descent: rows in the order of random
   hyperplane codes are cut into blocks of equal size and compared within
   them, a few times with other hyperplanes; then, round by round, the
   neighbours of each row are compared with one another, and closer ones
   replace the farthest.  No pairs of all rows are formed: a block has
   ``block`` rows and a row at most ``2 k`` neighbours that meet.
2. Weights: a row's distances become weights that fall from 1 at its nearest
   neighbour so that they sum to log2 k; the two directions are joined as
   a + b - ab.
3. Layout: from the principal axes, rows are drawn along their weighted edges
   and pushed from ``negatives`` other rows a step, chosen by a hash.

Rows are numbered once (equal vectors and repeated ids stay rows of their
own); every round is written to the shared folder.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixframe.operators.ranks import ordinal_by_value
from helixframe.operators.vectors import project_2d
from helixframe.session import bounded_batches, scratch_path

A, B = 1.577, 0.895                                     # the curve of a spread of 1 and a least distance of 0.1
EXACT_ROWS = 4_000_000
QUERIES, BLOCK, TILE = 65_536, 4096, 512                # rows of a group, of a block, and of queries in one product


def _written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder.  (A checkpoint would keep what
    the planner has inferred; joined with itself round after round, that
    doubles each time.)"""
    path = scratch_path(df.sparkSession, "layout")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _top(edges: DataFrame, k: int) -> DataFrame:
    """Each row's ``k`` nearest; among equal distances the lower number."""
    order = Window.partitionBy("u").orderBy("d", "w")
    once = edges.groupBy("u", "w").agg(F.min("d").alias("d"))
    return once.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= k).drop("__r")


def _distances(x):
    import numpy as np
    square = (x * x).sum(axis=1)
    return np.sqrt(np.maximum(square[:, None] + square - 2 * x @ x.T, 0))


def _matrix(column):
    """A column of vectors as a matrix."""
    import numpy as np
    return np.asarray(column.combine_chunks().flatten().to_numpy(zero_copy_only=False), "f8").reshape(len(column), -1)


def _in_block(k: int):
    def run(key, table):
        import numpy as np
        import pyarrow as pa
        at, x = table.column("n").to_numpy(), _matrix(table.column("v"))
        d = _distances(x)
        np.fill_diagonal(d, np.inf)
        near = np.argpartition(d, k, axis=1)[:, :k] if k < len(at) else np.tile(np.arange(len(at)), (len(at), 1))
        u = np.repeat(np.arange(len(at)), near.shape[1])
        w = near.ravel()
        real = u != w
        return pa.Table.from_pydict({"u": at[u[real]], "w": at[w[real]], "d": d[u[real], w[real]]})
    return run


def _meet(table):
    """The neighbours of one row, compared with one another: the pairs that
    one side would take.  Two that had met here before are left out."""
    import numpy as np
    import pyarrow as pa
    at, worst, new = (table.column(c).to_numpy(zero_copy_only=False) for c in ("w", "worst", "new"))
    d = _distances(_matrix(table.column("v")))
    u, w = np.nonzero((d < worst[:, None]) & (at[:, None] != at) & (new[:, None] | new))
    return pa.Table.from_pydict({"u": at[u], "w": at[w], "d": d[u, w]})


def numbered(df: DataFrame, vec: str, keep_cols) -> DataFrame:
    """``n`` (0, 1, 2, ...), ``v`` and the kept columns."""
    v = F.transform(F.col(vec), lambda x: x.cast("double"))
    d = _written(df.where(F.col(vec).isNotNull()).select(*keep_cols, v.alias("v"), F.monotonically_increasing_id().alias("__m")))
    return _written(ordinal_by_value(d, "__m", out="n").drop("__m"))


def _merged(best_d, best_n, u, d, n) -> None:
    """Into the ``k`` least of each row, sorted, the distances ``d`` of row
    ``u`` to ``n``; among equal ones the lower number."""
    import numpy as np
    k = best_d.shape[1]
    rows, at = np.unique(u, return_inverse=True)
    of = np.concatenate([np.repeat(np.arange(len(rows)), k), at])
    d, n = np.concatenate([best_d[rows].ravel(), d]), np.concatenate([best_n[rows].ravel(), n])
    order = np.lexsort((n, d, of))
    count = np.bincount(of, minlength=len(rows))
    order = order[np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count) < k]
    best_d[rows], best_n[rows] = d[order].reshape(-1, k), n[order].reshape(-1, k)


class _Nearest:
    """The ``k`` nearest of the rows that ``add`` is given, for each query row.

    In units of ``scale`` about ``middle`` a product of the query (2 q, -1) and
    the row (x, x x) is greater the nearer they are.  It decides which pairs
    are looked at, allowing for its rounding; distances come from differences."""

    def __init__(self, ids, q, k: int, middle, scale: float):
        import numpy as np
        self.ids, self.q, self.k, self.middle, self.scale = ids, q, k, middle, scale
        self.d, self.n = np.full((len(ids), k), np.inf), np.full((len(ids), k), -1)     # squares of distances
        self.scaled = self._scaled(q)
        self.square = (self.scaled ** 2).sum(axis=1)
        self.single = self._query(self.scaled, "f4")

    def _scaled(self, x):
        return (x - self.middle) / self.scale

    def _query(self, z, kind: str):
        import numpy as np
        return np.concatenate([2 * z, -np.ones((len(z), 1))], axis=1).astype(kind)

    def _row(self, z, kind: str):
        import numpy as np
        z = z.astype(kind)
        return np.concatenate([z, (z * z).sum(axis=1, keepdims=True)], axis=1).T

    def add(self, ids, x) -> None:
        import numpy as np
        z = self._scaled(x)
        single, most = self._row(z, "f4"), np.nanmax((z * z).sum(axis=1), initial=0.0)
        for a in range(0, len(self.ids), TILE):
            s = slice(a, a + TILE)
            g = self.single[s] @ single
            new = np.flatnonzero(np.isinf(self.d[s][:, -1]))
            if len(new) and len(ids) > self.k + 1:      # first some near ones; a query's own row may be among them
                some = np.argpartition(np.where(np.isnan(g[new]), -np.inf, g[new]), -self.k - 1, axis=1)[:, -self.k - 1:]
                self._take(s, np.repeat(new, self.k + 1), some.ravel(), ids, x)
                g[new[:, None], some] = -np.inf
            near = self._near(g, s, most, 2.0 ** -22)
            if np.count_nonzero(near) > near.size // 16:            # many that single precision cannot tell apart
                near &= self._near(self._query(self.scaled[s], "f8") @ self._row(z, "f8"), s, most, 2.0 ** -50)
            at = np.flatnonzero(near)
            for b in range(0, len(at), 1 << 15):
                self._take(s, *np.divmod(at[b:b + (1 << 15)], len(ids)), ids, x)

    def _near(self, g, s, most: float, rounding: float):
        import numpy as np
        square, worst = self.square[s], self.d[s][:, -1]
        limit = square - (np.sqrt(worst) / self.scale) ** 2 - (self.q.shape[1] + 8) * rounding * (square + most) - 1e-30
        limit[worst == 0] = np.inf                      # nothing is nearer
        return g > limit[:, None].astype(g.dtype)

    def _take(self, s, u, w, ids, x) -> None:
        d = ((self.q[s][u] - x[w]) ** 2).sum(axis=1)
        keep = (d <= self.d[s][u, -1]) & (self.ids[s][u] != ids[w])
        if keep.any():
            _merged(self.d[s], self.n[s], u[keep], d[keep], ids[w[keep]])

    def edges(self):
        import numpy as np
        import pyarrow as pa
        for a in range(0, len(self.ids), 4096):
            s = slice(a, a + 4096)
            real = np.isfinite(self.d[s])
            yield pa.RecordBatch.from_pydict({"u": np.repeat(self.ids[s], self.k)[real.ravel()], "w": self.n[s][real], "d": np.sqrt(self.d[s][real])})


def _packed(batches):
    """Blocks of about ``BLOCK`` rows as bytes, in single precision where that
    changes no value."""
    import numpy as np
    import pyarrow as pa
    from pyspark import TaskContext
    task, made, held = TaskContext.get().partitionId(), 0, []

    def block():
        ids, x = (np.concatenate(c) for c in zip(*held, strict=True))
        with np.errstate(over="ignore", invalid="ignore"):
            short = x.astype("f4")
        x = short if np.array_equal(short, x, equal_nan=True) else x
        return pa.RecordBatch.from_pydict({"block": [(task << 32) + made], "size": [len(ids)], "ids": [ids.tobytes()], "v": [x.tobytes()]})
    for b in batches:
        if b.num_rows:
            held.append((b.column(0).to_numpy(), np.asarray(b.column(1).flatten().to_numpy(zero_copy_only=False), "f8").reshape(b.num_rows, -1)))
        if sum(len(ids) for ids, _ in held) >= BLOCK:
            yield block()
            held, made = [], made + 1
    if held:
        yield block()


def _search(k: int, middle, scale: float):
    """Query rows come first, then all rows pass."""
    def run(batches):
        import numpy as np
        held, near = [], None
        for b in batches:
            for role, ids, v in zip(*(b.column(c).to_pylist() for c in ("role", "ids", "v")), strict=True):
                ids = np.frombuffer(ids, "i8")
                x = np.frombuffer(v, f"f{len(v) // len(middle) // len(ids)}").astype("f8").reshape(len(ids), -1)
                if role == 0:
                    held.append((ids, x))
                    continue
                if near is None:
                    near, held = _Nearest(*(np.concatenate(c) for c in zip(*held, strict=True)), k, np.array(middle), scale), []
                near.add(ids, x)
        if near is not None:
            yield from near.edges()
    return run


def exact_neighbours(rows: DataFrame, k: int = 15, queries: int = QUERIES) -> DataFrame:
    """``(u, w, d)``: the ``k`` nearest rows ``w`` of each row ``u`` of
    ``numbered``, from all pairs; among equal distances the lower number, but
    of copies the first ``k`` that are met."""
    spark = rows.sparkSession
    bounded_batches(spark)
    blocks = _written(rows.select("n", "v").mapInArrow(_packed, "block long, size long, ids binary, v binary"))
    sizes = sorted((r["block"], r["size"]) for r in blocks.select("block", "size").collect())
    total = sum(n for _, n in sizes)
    wide = rows.select(F.size("v")).first()[0]
    finite = lambda x: F.when(F.abs(x) < 1e150, x)      # noqa: E731
    facts = rows.select(*[F.avg(finite(F.col("v")[i])).alias(f"m{i}") for i in range(wide)],
                        F.max(F.aggregate("v", F.lit(0.0), lambda a, x: F.greatest(a, F.abs(finite(x))))).alias("most")).first()
    groups = max(1, -(-total // queries), min(4 * spark.sparkContext.defaultParallelism, -(-total // 1024), len(sizes)))
    groups, of, seen = min(groups, len(sizes)), {}, 0
    for block, n in sizes:
        of[block] = seen * groups // total
        seen += n
    used = {g: k for k, g in enumerate(sorted(set(of.values())))}       # blocks differ in size, so a group may have none
    groups, of = len(used), [(block, used[g]) for block, g in of.items()]
    own = blocks.join(F.broadcast(spark.createDataFrame(of, "block long, group int")), "block").select("group", F.lit(0).alias("role"), "block", "ids", "v")
    all_rows = blocks.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"), F.lit(1).alias("role"), "block", "ids", "v")
    both = own.unionByName(all_rows).repartitionById(groups, "group").sortWithinPartitions("role", "block")
    return _written(both.mapInArrow(_search(k, [facts[i] or 0.0 for i in range(wide)], facts["most"] or 1.0), "u long, w long, d double"))


def neighbours(rows: DataFrame, k: int = 15, block: int = 1024, starts: int = 3, rounds: int = 8, least_change: float = 0.002,
               seed: int = 1234, search: int | None = None, exact_rows: int = EXACT_ROWS) -> DataFrame:
    """``(u, w, d)``: for each row ``u`` of ``numbered`` its ``k`` nearest rows
    ``w``, of more than ``exact_rows`` rows about those.

    The descent keeps ``search`` neighbours of each row (three times ``k`` if
    not given): in many dimensions a near row is often a neighbour of a
    neighbour that is not among the ``k`` nearest.  Two neighbours of a row
    that both were its neighbours in the round before have met, and the
    farthest neighbours only come closer, so each round compares pairs with a
    new one alone; rows without a new neighbour take no part."""
    import numpy as np
    wanted, k = k, search or 3 * k
    total = rows.count()
    if not total:
        return rows.sparkSession.createDataFrame([], "u long, w long, d double")
    if total <= exact_rows:
        return exact_neighbours(rows, wanted)
    size = rows.select(F.size("v")).first()[0]
    bits = min(20, max(0, math.ceil(math.log2(max(1, total / block)))))
    random, edges = np.random.default_rng(seed), None
    middle = rows.select(*[F.avg(F.col("v")[i]).alias(f"m{i}") for i in range(size)]).first()
    for _ in range(starts):
        planes = random.normal(size=(bits + 1, size))
        side = lambda p: F.aggregate(F.zip_with("v", F.array(*[F.lit(float(x)) for x in p]), lambda a, b: a * b),
                                     F.lit(float(-sum(x * m for x, m in zip(p, middle, strict=True)))), lambda a, x: a + x)
        # neighbouring codes differ in one bit, so a block that spans two still holds near rows
        code, flip = F.lit(0), F.lit(False)
        for p in planes[:-1]:
            bit = (side(p) > 0) != flip
            code, flip = code * 2 + bit.cast("int"), bit
        coded = rows.select("n", "v", code.cast("long").alias("__code"), side(planes[-1]).alias("__side"))
        ranked = ordinal_by_value(coded, ["__code", "__side"], out="__at")
        found = ranked.select("n", "v", F.floor(F.col("__at") / block).alias("__block")).groupBy("__block").applyInArrow(
            _in_block(k), "u long, w long, d double")
        edges = found if edges is None else edges.unionByName(found)
    edges, met = _written(_top(edges, k)), None
    for r in range(rounds):
        worst = edges.groupBy("u").agg(F.max("d").alias("worst"), F.count(F.lit(1)).alias("c"))
        worst = worst.select("u", F.when(F.col("c") >= k, F.col("worst")).otherwise(F.lit(float("inf"))).alias("worst"))
        back = edges.select(F.col("w").alias("u"), F.col("u").alias("w"), F.xxhash64("u", "w", F.lit(r)).alias("h"))
        # a hub's followers are thinned in parts before they meet in one
        for part in (["u", F.pmod("w", F.lit(64))], ["u"]):
            back = back.withColumn("__r", F.row_number().over(Window.partitionBy(*part).orderBy("h", "w"))).where(F.col("__r") <= k).drop("__r")
        known = edges.select("u", "w").unionByName(back.select("u", "w")).distinct()
        known = known.withColumn("new", F.lit(True)) if met is None else known.join(
            met.select("u", "w", F.lit(False).alias("old")), ["u", "w"], "left").select("u", "w", F.coalesce("old", F.lit(True)).alias("new"))
        met = _written(known)
        known = met.join(met.where("new").select("u").distinct(), "u", "left_semi")
        vectors = rows.select(F.col("n").alias("w"), "v").join(worst.withColumnRenamed("u", "w"), "w", "left")
        vectors = vectors.withColumn("worst", F.coalesce("worst", F.lit(float("inf"))))
        closer = known.join(vectors, "w").groupBy("u").applyInArrow(_meet, "u long, w long, d double")
        after = _written(_top(edges.unionByName(closer), k))
        fresh = after.join(edges.select("u", "w"), ["u", "w"], "left_anti").count()
        edges = after
        if fresh <= least_change * k * total:
            break
    return _written(_top(edges, wanted))


def recall(rows: DataFrame, edges: DataFrame, probe, k: int, block: int = 8192) -> float:
    """The share of the probes' exact ``k`` nearest that ``edges`` holds.  The
    probes, a stated query set, go to all tasks in blocks of ``block``; each
    task returns its ``k`` nearest rows of each."""
    import numpy as np
    spark, found = rows.sparkSession, None
    bounded_batches(spark)
    probes = rows.where(probe).select("n", "v")
    held: list = []

    def against(items):
        shared = spark.sparkContext.broadcast((np.array([r["n"] for r in items], "i8"), np.array([r["v"] for r in items], "f8")))

        def run(batches):
            import pyarrow as pa
            ids, q = shared.value
            square = (q * q).sum(axis=1)
            best_n, best_d = np.full((len(ids), k), -1), np.full((len(ids), k), np.inf)
            for b in batches:
                at, x = b.column(0).to_numpy(), np.asarray(b.column(1).flatten().to_numpy(zero_copy_only=False), "f8").reshape(b.num_rows, -1)
                across = (x * x).sum(axis=1)
                for s in (slice(a, a + TILE) for a in range(0, len(ids), TILE)):
                    d = square[s, None] + across - 2 * q[s] @ x.T
                    limit = np.where(best_d[s, -1] > 0, best_d[s, -1] ** 2, -np.inf)       # at 0 nothing is nearer
                    if np.isinf(best_d[s, -1]).any() and len(at) > k + 1:
                        limit = np.minimum(limit, np.nextafter(np.partition(d, k, axis=1)[:, k], np.inf))     # a probe may meet itself
                    u, w = np.nonzero(d < limit[:, None])
                    other = ids[s][u] != at[w]
                    u, w = u[other], w[other]
                    _merged(best_d[s], best_n[s], u, np.sqrt(np.maximum(d[u, w], 0)), at[w])
            real = np.isfinite(best_d)
            yield pa.RecordBatch.from_pydict({"u": np.repeat(ids, k)[real.ravel()], "w": best_n[real], "d": best_d[real]})
        return rows.select("n", "v").mapInArrow(run, "u long, w long, d double")
    for r in probes.toLocalIterator():
        held.append(r)
        if len(held) == block:
            found = against(held) if found is None else found.unionByName(against(held))
            held = []
    if held:
        found = against(held) if found is None else found.unionByName(against(held))
    if found is None:
        return 1.0
    exact = _top(found, k)
    worst = exact.groupBy("u").agg(F.max("d").alias("worst"), F.count(F.lit(1)).alias("c"))
    hits = edges.join(worst, "u").where(F.col("d") <= F.col("worst") + 1e-9)
    total = worst.agg(F.sum("c")).first()[0]
    return hits.count() / total if total else 1.0


def _weighted(k: int):
    def run(key, table):
        import numpy as np
        import pyarrow as pa
        d = table.column("d").to_numpy()
        positive = d[d > 0]
        nearest = positive.min() if len(positive) else 0.0
        low, high, want = 0.0, np.inf, math.log2(max(k, 2))
        sigma = 1.0
        for _ in range(64):
            s = np.exp(-np.maximum(d - nearest, 0) / sigma).sum()
            if abs(s - want) < 1e-6:
                break
            low, high = (low, sigma) if s > want else (sigma, high)
            sigma = (low + high) / 2 if np.isfinite(high) else 2 * sigma
        sigma = max(sigma, 1e-3 * max(d.mean(), 1e-12))
        return pa.Table.from_pydict({"u": table.column("u"), "w": table.column("w"), "p": np.exp(-np.maximum(d - nearest, 0) / sigma)})
    return run


def weights(edges: DataFrame, k: int) -> DataFrame:
    """``(u, w, p)``, both directions of every edge with the joint weight."""
    one = edges.groupBy("u").applyInArrow(_weighted(k), "u long, w long, p double")
    low, high = F.least("u", "w"), F.greatest("u", "w")
    both = one.groupBy(low.alias("a"), high.alias("b")).agg(F.sum("p").alias("s"), F.product("p").alias("q"), F.count(F.lit(1)).alias("c"))
    p = F.when(F.col("c") > 1, F.col("s") - F.col("q")).otherwise(F.col("s"))
    joint = both.select("a", "b", p.alias("p"))
    return joint.select(F.col("a").alias("u"), F.col("b").alias("w"), "p").unionByName(
        joint.select(F.col("b").alias("u"), F.col("a").alias("w"), "p"))


def layout(df: DataFrame, vec: str, keep_cols, k: int = 15, steps: int = 12, rate: float = 1.0, negatives: int = 5,
           seed: int = 1234, edges: DataFrame | None = None) -> DataFrame:
    """``keep_cols, x, y``: the rows with vectors in the plane.  With ``edges``,
    the ``neighbours`` of ``df``, which is then the result of ``numbered``, no
    second graph is made."""
    rows = numbered(df, vec, keep_cols) if edges is None else df
    total = rows.count()
    if not total:
        return rows.select(*keep_cols, F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    edges = _written(weights(neighbours(rows, k, seed=seed) if edges is None else edges, k))
    axes = project_2d(rows, "v", ["n"]) if total > 1 else rows.select("n", F.lit(0.0).alias("pc1"), F.lit(0.0).alias("pc2"))
    spread = axes.agg(*[F.max(F.abs(c)).alias(c) for c in ("pc1", "pc2")]).first()
    unit = max(spread["pc1"] or 0.0, spread["pc2"] or 0.0) or 1.0
    place = _written(axes.select("n", (F.col("pc1") / unit * 10).alias("x"), (F.col("pc2") / unit * 10).alias("y")))
    clip = lambda c: F.greatest(F.least(c, F.lit(4.0)), F.lit(-4.0))
    for step in range(steps):
        here = place.select(F.col("n").alias("u"), "x", "y")
        there = place.select(F.col("n").alias("w"), F.col("x").alias("x2"), F.col("y").alias("y2"))
        other = place.select("n", F.explode(F.sequence(F.lit(0), F.lit(negatives - 1))).alias("j")).select(
            F.col("n").alias("u"), F.pmod(F.xxhash64("n", "j", F.lit(step), F.lit(seed)), F.lit(total)).alias("w"), F.lit(None).cast("double").alias("p"))
        both = edges.unionByName(other.where("u <> w")).join(there, "w").join(here, "u")
        dx, dy = F.col("x") - F.col("x2"), F.col("y") - F.col("y2")
        d2 = dx * dx + dy * dy
        draw = F.when(d2 > 0, -2 * A * B * F.pow(d2, F.lit(B - 1)) / (1 + A * F.pow(d2, F.lit(B))) * F.col("p")).otherwise(0.0)
        push = 2 * B / ((0.001 + d2) * (1 + A * F.pow(d2, F.lit(B))))
        force = F.when(F.col("p").isNull(), push).otherwise(draw)
        moved = both.groupBy("u").agg(F.sum(clip(force * dx)).alias("fx"), F.sum(clip(force * dy)).alias("fy"), F.count(F.lit(1)).alias("c"))
        alpha = rate * (1 - step / steps)
        go = lambda f: F.lit(alpha) * clip(F.col(f) / F.sqrt(F.col("c")))
        place = _written(place.join(moved.withColumnRenamed("u", "n"), "n", "left").select(
            "n", (F.col("x") + F.coalesce(go("fx"), F.lit(0.0))).alias("x"), (F.col("y") + F.coalesce(go("fy"), F.lit(0.0))).alias("y")))
    return rows.join(place, "n").select(*keep_cols, "x", "y")
