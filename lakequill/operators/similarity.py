"""Exact similarity joins of vectors by blocks, with pivots where these spare work.

On unit vectors the angle is a metric. Every vector is at home in the cell of its nearest pivot; by the
triangle inequality a vector b can only match vectors of cell p if its angle to p exceeds the one to
its own pivot by twice the threshold at most, and isn't beyond the cell's radius plus the threshold.
So a vector is a guest in the few other cells where it can match. Where a low floor would make it a
guest nearly everywhere, there are fewer pivots or none, and each scope is one cell. Cells are cut
into blocks, and a task compares two of them: a vector is copied once for each block that it meets,
and what is written grows with vectors times blocks, not with pairs. Vectors that are the same are
one class, joined once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType, StructType

from lakequill.functions import vectors as V
from lakequill.operators.vector_index import clustered, drawn, matrix, unit, usable
from lakequill.session import stored

BLOCK = 32_768  # vectors of a block, at most
BLOCK_BYTES = 48 << 20  # of a block in double precision, at most
TILE = 1024  # rows that are scored at once, against four times as many
PIECE_BYTES = 16 << 20  # of the pairs that are scored again in double precision at once
PIVOTS = 1024  # at most
COPIES = 3  # cells that a vector is a guest of on average, at most; or as many as it would meet blocks without pivots
SLACK = 1e-6  # scores are rounded before they are compared
CLASS = ["_scope", "_k1", "_k2"]


def scoped(scope: str) -> Column:
    """Null is a scope of its own."""
    return F.coalesce(F.concat(F.lit("="), F.col(scope).cast("string")), F.lit(""))


def keyed(vectors: DataFrame, vector: str, scope: str) -> DataFrame:
    """vectors with their class: scope and 128 bits of the vector."""
    v = F.transform(vector, lambda x: x.cast("double") + 0.0)
    return usable(vectors, vector).select("*", scoped(scope).alias("_scope"), F.xxhash64(F.lit(1), v).alias("_k1"), F.xxhash64(F.lit(2), v).alias("_k2"))


def classes(keyed_rows: DataFrame, vector: str, *more: Column) -> DataFrame:
    single = keyed_rows.schema[vector].dataType.elementType == FloatType()
    return keyed_rows.groupBy(*CLASS).agg(*more, F.any_value(F.col(vector).cast(ArrayType(FloatType() if single else DoubleType()))).alias("_v"))


def block_rows(width: int) -> int:
    return max(1, min(BLOCK, BLOCK_BYTES // (8 * max(1, width))))


def near_pairs(x: np.ndarray, y: np.ndarray, floor: float, later: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places in x, places in y and similarity of the pairs of unit vectors with floor or more, a piece at a time.

    later: y is x, and the pairs are those of a row and a later one. Tiles are screened in single
    precision, with room for its errors; what passes is scored in double precision.
    """
    if not len(x) or not len(y):
        return
    screen = np.float32(floor - 2 * SLACK - x.shape[1] * 2.0**-22)
    small, piece = (x.astype(np.float32), y.astype(np.float32)), max(1, PIECE_BYTES // (8 * x.shape[1]))
    for i in range(0, len(x), TILE):
        for j in range(i if later else 0, len(y), 4 * TILE):
            a, b = np.nonzero(small[0][i : i + TILE] @ small[1][j : j + 4 * TILE].T >= screen)
            a, b = a + i, b + j
            if later:
                a, b = a[a < b], b[a < b]
            for k in range(0, len(a), piece):
                p, q = a[k : k + piece], b[k : k + piece]
                scores = np.round(np.einsum("ij,ij->i", x[p], y[q]), V.EXACT)
                kept = scores >= floor
                yield p[kept], q[kept], scores[kept]


def pivots_for(both: DataFrame, total: int, width: int, theta: float, once: bool, most: float, asked: int | None) -> np.ndarray | None:
    """The most pivots with which a sample's vectors are guests of `most` cells on average, and of half of them at most; None for none."""
    if total < 2 or asked == 1:
        return None
    rows = drawn(both.select(F.concat_ws("/", *CLASS).alias("_id"), "_v"), total, id_col="_id", vector="_v", sample=max(1, min(16 * PIVOTS, BLOCK_BYTES // (8 * width))))
    if asked:
        return clustered(rows, asked)
    for n in (min(total // 64, PIVOTS >> s) for s in (0, 2, 4, 6, 8)):
        if n < 2:
            break
        some = rows[np.random.default_rng(3).permutation(len(rows))[: n + 2048]]
        angles = np.arccos(np.clip(some[-2048:] @ some[:n].T, -1, 1))
        guests = (angles <= angles.min(axis=1, keepdims=True) + 2 * theta).sum(axis=1).mean() - 1
        if guests / (1 + once) <= most and guests <= n / 2:
            return clustered(rows, n)
    return None


def celled(rows: DataFrame, names: list[str], pivots: np.ndarray, theta: float, radii: dict[int, float], home: bool, guest: str) -> DataFrame:
    """The columns of names with _cell and _home: each row in its own cell if home, and as a guest in others where it can match.

    guest: "none", "after" (of two cells, a vector goes to those after its own alone) or "all" (its own too).
    """
    held = rows.sparkSession.sparkContext.broadcast(pivots)
    reach = np.array([radii.get(i, -math.inf) for i in range(len(pivots))]) + theta

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 1000):
                batch = whole.slice(i, 1000)
                angles = np.arccos(np.clip(unit(matrix(batch.column(batch.num_columns - 1))) @ held.value.T, -1, 1))
                nearest = np.argmin(angles, axis=1)
                each = np.arange(len(nearest))
                at, cells, homes = (each, nearest, np.ones(len(each), bool)) if home else (np.zeros(0, int), np.zeros(0, int), np.zeros(0, bool))
                if guest != "none":
                    near = (angles <= angles[each, nearest][:, None] + 2 * theta + SLACK) & (angles <= reach + SLACK)
                    if guest == "after":
                        near &= np.arange(angles.shape[1]) > nearest[:, None]
                    more, others = np.nonzero(near)
                    at, cells, homes = np.concatenate([at, more]), np.concatenate([cells, others]), np.concatenate([homes, np.zeros(len(more), bool)])
                taken = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([*(taken.column(c) for c in names), pa.array(cells, pa.int32()), pa.array(homes)], [*names, "_cell", "_home"])

    plain = rows.select(*(c for c in names if c != "_v"), "_v")
    return plain.mapInArrow(run, StructType([plain.schema[c] for c in names]).add("_cell", "integer").add("_home", "boolean"))


def radii_of(rows: DataFrame, pivots: np.ndarray) -> dict[int, float]:
    """The largest angle of each cell."""
    held = rows.sparkSession.sparkContext.broadcast(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            most = np.full(len(held.value), -np.inf)
            for i in range(0, whole.num_rows, 1000):
                angles = np.arccos(np.clip(unit(matrix(whole.column(0).slice(i, 1000))) @ held.value.T, -1, 1))
                np.maximum.at(most, np.argmin(angles, axis=1), angles.min(axis=1))
            cells = np.nonzero(most >= 0)[0]
            yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int32()), pa.array(most[cells])], ["_cell", "_angle"])

    found = rows.select("_v").mapInArrow(run, "_cell int, _angle double").groupBy("_cell").agg(F.max("_angle").alias("r"))
    return {r["_cell"]: r["r"] for r in found.collect()}  # a row a pivot


def joined(left: DataFrame, right: DataFrame | None, floor: float, pivots: int | None = None, carry: tuple[str, ...] = ("_k1", "_k2"), found: bool = False) -> DataFrame:
    """_scope, the carried columns as _a... and _b..., similarity of the classes of one scope with similarity of floor or more.

    Without right, all pairs of left, each once. Carried columns are named with an underscore. With
    found: _scope and the carried columns of the classes of left that match any of right, perhaps repeated.
    """
    if not 0 < floor <= 1:
        raise ValueError("floor must be above 0, and 1 at most")
    theta, apart = math.acos(max(-1.0, floor - SLACK)), right is not None
    names = list(dict.fromkeys([*CLASS, *carry, "_v"]))
    left, right = left.select(*names), right.select(*names) if apart else None
    both = left.unionByName(right) if apart else left
    sizes = both.groupBy("_scope").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("_v")).alias("w"))
    total, squares, width = sizes.agg(F.sum("n"), F.sum(F.col("n").cast("double") * F.col("n")), F.max("w")).first()
    total, width = total or 0, width or 1
    rows_a_block = block_rows(width)

    centres = pivots_for(both, total, width, theta, not apart, max(COPIES, (squares or 0) / max(1, total) / rows_a_block), pivots)
    if centres is None:
        alone = lambda rows, home, names: rows.select(*names, F.lit(0).alias("_cell"), F.lit(home).alias("_home"))
        placed = lambda names: alone(left, True, names).unionByName(alone(right, False, names)) if apart else alone(left, True, names)
    else:
        radii = radii_of(left, centres)
        placed = lambda names: celled(left, names, centres, theta, radii, True, "none").unionByName(celled(right, names, centres, theta, radii, False, "all")) if apart else celled(left, names, centres, theta, radii, True, "after")

    # blocks of the cells that hold more than one, which are few; the others are a block
    cell = ["_scope", "_cell"]
    count = lambda c: F.ceil(F.sum(c.cast("long")) / F.lit(rows_a_block)).cast("int")
    blocks = placed(["_scope"]).groupBy(*cell).agg(count(F.col("_home")).alias("_h"), count(~F.col("_home")).alias("_g")).where("_h > 1 OR _g > 1")
    cut = placed(names).join(F.broadcast(blocks), cell, "left").withColumns({c: F.coalesce(c, F.lit(1)) for c in ("_h", "_g")})
    upto = lambda a, b: F.when(a < b, F.sequence(a, b - 1)).otherwise(F.array().cast("array<int>"))
    zero, h, g = F.lit(0), F.col("_h"), F.col("_g")
    own = lambda n: F.pmod(F.xxhash64("_k1", "_k2"), F.greatest(n, F.lit(1))).cast("int")
    task = lambda l, r, side: F.struct(l.alias("_l"), r.alias("_r"), F.lit(side).cast("byte").alias("_side"))
    i, j = own(h), own(g)
    if apart:
        home = F.transform(upto(zero, g), lambda r: task(i, r, 0))
    else:
        home = F.concat(F.transform(F.array_union(upto(zero, g), upto(i, h)), lambda r: task(i, r, 0)), F.transform(upto(zero, i), lambda l: task(l, i, 1)))
    dealt = cut.withColumn("_task", F.explode(F.when(F.col("_home"), home).otherwise(F.transform(upto(zero, h), lambda l: task(l, j, 2)))))
    dealt = dealt.select(*cell, "_task.*", *dict.fromkeys(carry), "_v")
    carried = list(dict.fromkeys(carry))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A block of homes against a block of guests, another block of homes, and, where it is the same, itself."""
        part = pa.Table.from_batches(list(batches))
        side = part.column("_side").to_numpy()
        a, b = (part.filter(pa.array(mine)).combine_chunks() for mine in (side == 0, side > 0))
        x, y = (unit(matrix(t.column("_v").combine_chunks())) for t in (a, b))
        a, b = (t.select(["_scope", *carried]) for t in (a, b))
        if found:
            seen = np.zeros(len(x), bool)
            for p, _, _ in near_pairs(x, y, floor):
                seen[p] = True
            yield from a.filter(pa.array(seen)).to_batches()
            return
        within = not apart and part.column("_l")[0] == part.column("_r")[0]
        for later in (False, True) if within else (False,):
            for p, q, scores in near_pairs(x, x if later else y, floor, later):
                one, two = a.take(pa.array(p)), (a if later else b).take(pa.array(q))
                columns = [*one.columns, *two.columns[1:], pa.chunked_array([pa.array(scores)])]
                yield from pa.table(columns, names=["_scope", *(f"_a{c}" for c in carried), *(f"_b{c}" for c in carried), "similarity"]).to_batches()

    if found:
        schema = StructType([dealt.schema[c] for c in ("_scope", *carried)])
    else:
        schema = StructType().add("_scope", "string")
        for k in "ab":
            for c in carried:
                schema = schema.add(f"_{k}{c}", dealt.schema[c].dataType)
        schema = schema.add("similarity", "double")
    return dealt.groupBy(*cell, "_l", "_r").applyInArrow(compare, schema)


def near_duplicates(vectors: DataFrame, *, floor: float, id_col: str, vector: str, scope: str, pivots: int | None = None) -> DataFrame:
    """scope, a, b, similarity of all pairs a < b of one scope whose similarity is floor or more.

    Null scopes are one scope. Rows without an id, and vectors that are null, not finite or of length
    zero, have no pairs. Copies of a vector are compared once and come together again in the result
    alone; where they are many, use near_classes. Links between vectors without copies are the result
    as they are: they are neither joined nor shuffled, and written only if other vectors have copies.
    """
    rows = keyed(vectors.where(F.col(id_col).isNotNull()).select(id_col, scope, vector), vector, scope)
    one = stored(classes(rows, vector, F.min(id_col).alias("_id"), F.any_value(scope).alias("_own"), F.count(F.lit(1)).alias("_n")), "similarity-classes")
    many = one.where("_n > 1").select(*CLASS)
    result = lambda links, a, b: links.select(F.col("_a_own").alias(scope), F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), "similarity").where("a < b")
    if many.isEmpty():
        return result(joined(one, None, floor, pivots, ("_id", "_own")), "_a_id", "_b_id")
    marked = one.withColumns({f"_c{k}": F.when(F.col("_n") > 1, F.col(f"_k{k}")) for k in (1, 2)})
    links = stored(joined(marked, None, floor, pivots, ("_id", "_own", "_c1", "_c2")), "similarity-links")
    members = stored(rows.join(many, CLASS, "left_semi").select(*CLASS, id_col, F.col(scope).alias("_own")), "similarity-members")

    def spread(links: DataFrame, k: str) -> DataFrame:
        """links with _a or _b, a row for each member of the class."""
        key = [f"_{k}_c1", f"_{k}_c2"]
        named = members.select("_scope", F.col("_k1").alias(key[0]), F.col("_k2").alias(key[1]), F.col(id_col).alias(f"_{k}"))
        return links.where(F.col(key[0]).isNull()).withColumn(f"_{k}", F.col(f"_{k}_id")).unionByName(links.where(F.col(key[0]).isNotNull()).join(named, ["_scope", *key]))

    mine, other = (members.select(*CLASS, "_own", F.col(id_col).alias(k)) for k in "ab")
    copies = mine.join(other.drop("_own"), CLASS).where("a < b").select(F.col("_own").alias(scope), "a", "b", F.lit(1.0).alias("similarity"))
    return result(spread(spread(links, "a"), "b"), "_a", "_b").unionAll(copies)


def near_classes(vectors: DataFrame, *, floor: float, id_col: str, vector: str, scope: str, pivots: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Links between classes of equal vectors (_scope, _a1, _a2, _b1, _b2, similarity), and members (id, scope, _scope, _k1, _k2)."""
    rows = keyed(vectors.select(id_col, scope, vector), vector, scope)
    links = joined(stored(classes(rows, vector), "similarity-classes"), None, floor, pivots)
    return links.withColumnsRenamed({f"_{s}_k{k}": f"_{s}{k}" for s in "ab" for k in (1, 2)}), rows.drop(vector)


def near_any(left: DataFrame, right: DataFrame, *, floor: float, vector: str, scope: str) -> DataFrame:
    """The classes (_scope, _k1, _k2) of left that a vector of right in their scope nearly equals."""
    mine, others = (stored(classes(keyed(rows.select(*dict.fromkeys([scope, vector])), vector, scope), vector), "near-classes") for rows in (left, right))
    return joined(mine, others, floor, found=True).distinct()


def rounds_of(keys: DataFrame, size: int) -> DataFrame | None:
    """_scope, _from (array): where the second and later runs of about size classes begin, of scopes with more than size; None if there is none.

    keys: _scope, _place. Scopes with a row are as many as runs at most.
    """
    long = keys.groupBy("_scope").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > size)
    total = long.agg(F.sum("_n")).first()[0]
    if not total:
        return None
    ranged = keys.join(F.broadcast(long.select("_scope")), "_scope", "left_semi").repartitionByRange(-(-4 * total // size), "_scope", "_place")
    parts = stored(ranged.withColumn("_part", F.spark_partition_id()), "first-ranges").groupBy("_scope", "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_place").alias("_from"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_scope").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = parts.withColumn("_run", F.floor(before / F.lit(max(1, 3 * size // 4)))).groupBy("_scope", "_run").agg(F.min("_from").alias("_from"))
    return stored(runs.where("_run > 0").groupBy("_scope").agg(F.array_sort(F.collect_list("_from")).alias("_from")), "first-runs")


def first_of_each(vectors: DataFrame, *, order: str, vector: str, scope: str, floor: float, known: DataFrame | None = None) -> DataFrame:
    """Classes (_scope, _k1, _k2, _order) that stay when vectors come in order and one is refused that nearly equals a known one or one that stayed.

    The order is the class's least; ties go by class. A scope's classes come in runs of a block, and
    the scopes go on together: what nearly equals one that stayed in an earlier run is refused, and
    a task goes through the others in order. No pair is written; what stayed is read again in each run.
    """
    if not 0 < floor <= 1:
        raise ValueError("floor must be above 0, and 1 at most")
    rows = keyed(vectors.select(*dict.fromkeys([order, vector, scope])), vector, scope)
    size, first = block_rows(rows.agg(F.max(F.size(vector))).first()[0] or 1), F.min(order).alias("_order")
    place = F.struct("_order", "_k1", "_k2")
    starts = rounds_of(stored(rows.groupBy(*CLASS).agg(first), "first-keys").select("_scope", place.alias("_place")), size)
    ranked = classes(rows, vector, first)
    if starts is None:
        runs, ranked = 1, stored(ranked, "first-classes")
    else:
        runs = 1 + starts.agg(F.max(F.size("_from"))).first()[0]
        run = F.coalesce(F.size(F.filter("_from", lambda x: x <= F.col("_place"))), F.lit(0))
        ranked = stored(ranked.withColumn("_place", place).join(F.broadcast(starts), "_scope", "left").withColumn("_run", run).drop("_place", "_from"), "first-classes", by="_run")

    largest = lambda rows: rows.groupBy("_scope").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    names, stays, gone, against = [*CLASS, "_order", "_v"], [], None, ranked.select(*CLASS, "_v").limit(0)
    if known is not None:
        against = stored(classes(keyed(known.select(*dict.fromkeys([scope, vector])), vector, scope), vector), "first-known")
        if largest(against) > size:
            gone, against = stored(joined(ranked.select(*CLASS, "_v"), against, floor, found=True).distinct(), "first-known-gone"), against.limit(0)

    def firsts(part: pa.Table) -> pa.Table:
        new = part.filter(pc.invert(part.column("_held"))).drop_columns(["_held"]).combine_chunks()
        new = new.take(pc.sort_indices(new, sort_keys=[("_order", "ascending"), ("_k1", "ascending"), ("_k2", "ascending")], null_placement="at_start"))
        if not new.num_rows:
            return new
        x, held = unit(matrix(new.column("_v").combine_chunks())), unit(matrix(part.filter(part.column("_held")).column("_v").combine_chunks()))

        def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            scores = a @ b.T
            hit, edge = scores >= floor, np.abs(scores - floor) <= SLACK
            hit[edge] = np.round(scores[edge], V.EXACT) >= floor
            return hit

        kept, at = np.concatenate([held, np.empty_like(x)]) if len(held) else np.empty_like(x), []
        n = len(held)
        for i in range(0, len(x), TILE):
            left = np.arange(i, min(i + TILE, len(x)))
            for j in range(0, n, 4 * TILE):
                left = left[~near(x[left], kept[j : min(j + 4 * TILE, n)]).any(axis=1)]
            pairs, stay = near(x[left], x[left]), np.ones(len(left), bool)
            for k in range(len(left)):
                if stay[k]:
                    stay[k + 1 :] &= ~pairs[k, k + 1 :]
            left = left[stay]
            kept[n : n + len(left)] = x[left]
            at.append(left)
            n += len(left)
        return new.take(pa.array(np.concatenate(at)))

    for k in range(runs):
        mine = ranked if starts is None else ranked.where(F.col("_run") == k).drop("_run")
        mine = mine.select(*names)
        if k:
            against = against.join(F.broadcast(starts.select("_scope")), "_scope", "left_semi")
        if gone is not None:
            mine = mine.join(gone, CLASS, "left_anti")
        held = against
        if k and largest(against) > size:
            near = joined(mine.select(*CLASS, "_v"), against, floor, found=True).distinct()
            mine, held = mine.join(stored(near, "first-refused"), CLASS, "left_anti"), against.limit(0)
        none = F.lit(None).cast(ranked.schema["_order"].dataType)
        group = mine.withColumn("_held", F.lit(False)).unionByName(held.select(*CLASS, none.alias("_order"), "_v", F.lit(True).alias("_held")))
        stay = stored(group.groupBy("_scope").applyInArrow(firsts, mine.select(*names).schema), "first-stay")
        stays.append(stay.drop("_v"))
        against = against.unionByName(stay.select(*CLASS, "_v"))
    out = stays[0]
    for stay in stays[1:]:
        out = out.unionByName(stay)
    return out
