"""N-gram Jaccard join: blocked sparse products of the document by n-gram incidence.

1. Every text becomes its set of word shingles (64-bit hashes). Equal sets, by 128 bits, collapse to one *vertex*, so
   exact copies cost one row each and are never paired.
2. Size-derived bounds: two sets of sizes a and b reach similarity t only with an overlap of at least
   t / (1 + t) * (a + b). Under a total order of n-grams (common ones last) a qualifying pair shares one of
   the first ``|x| - ceil(t |x|) + 1`` n-grams of each set; only those columns of the incidence are kept, and
   a pair is discarded where size and column positions leave too little room for the overlap, or where the
   product over n-grams folded into BUCKETS buckets, an upper bound of the overlap, stays below it.
3. Overlap counts of the pairs that survive are accumulated exactly, a block of pairs at a time.
4. Linear rounds first: in each column the vertex with most columns in common (smallest position) is multiplied
   with the others. Columns whose vertices are joined by then are done; the pairs still between different
   components are multiplied in a last exact round, in blocks, so that no link between different texts is lost.

The statistics of common n-grams only choose the order of columns (speed); results do not depend on them.

Null, empty and blank texts have the empty set and link with nothing. Texts with fewer words than a shingle
have one shingle, the whole sequence. Repeated rows count each; ties go to the smaller id. A component found only
under null ids has the null component_id; ``first_copies`` tells such components, and different texts of one id,
apart by vertex. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import SMALL, discard, join_small, materialise
from .textscan import U, Slice, mix, ngrams, slices

#: Counters of the sketch of n-gram frequencies, and how many of the most frequent are ordered last.
SKETCH_SLOTS, HEAVY_SLOTS = 1 << 22, 1 << 16
#: Buckets of the folded incidence of a vertex, one byte each; 255 stands for 255 or more.
BUCKETS = 256
#: Earlier columns of a vertex that the exact round knows in each column, so that a pair is made few times.
BEFORE = 6


@dataclass(frozen=True)
class Join:
    words: int = 5
    percent: int = 80
    #: Linear rounds before the exact round over pairs between components.
    rounds: int = 3
    #: Columns with more vertices, and vertices with more members, than these (or their share of all) are not gathered in a task.
    wide: int = 1_000
    copies: int = 64
    #: Bits of a vertex's short name; fewer make names meet, which tests want.
    name_bits: int = 64


def _shingles(s: Slice, n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each shingle of a slice, and its text."""
    words, counts = s.words(seed), np.diff(s.bounds)
    at, h = ngrams(words, s.bounds, n)
    of = np.searchsorted(s.bounds, at, "right") - 1
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        first, k = s.bounds[short], counts[short]
        with np.errstate(over="ignore"):
            whole = words[first]
            for i in range(1, n - 1):
                more = k > i
                whole = np.where(more, mix(whole * U(0xA0761D6478BD642F) + words[np.minimum(first + i, len(words) - 1)]), whole)
            whole = mix(whole + k.astype(U) * U(0xC2B2AE3D27D4EB4F))
        h, of = np.concatenate([h, whole]), np.concatenate([of, short])
    return h, of


def checked_sets(s: Slice, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``shingle_sets``, with a hash of each shingle from other hashes of its words."""
    h, of = _shingles(s, n, 0)
    other, _ = _shingles(s, n, 0x632BE59B)
    order = np.lexsort((h, of))
    h, of, other = h[order], of[order], other[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
    return h[keep], np.searchsorted(of[keep], np.arange(s.n + 1)), other[keep]


def shingle_sets(s: Slice, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text of a slice, concatenated, and their bounds."""
    h, of = _shingles(s, n, 0)
    order = np.lexsort((h, of))
    h, of = h[order], of[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
    h, of = h[keep], of[keep]
    return h, np.searchsorted(of, np.arange(s.n + 1))


def _sums(h: np.ndarray, bounds: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        total = np.zeros(len(h) + 1, U)
        np.cumsum(mix(h ^ U(seed)), out=total[1:])
        return mix((total[bounds[1:]] - total[bounds[:-1]]) + np.diff(bounds).astype(U) * U(0xD6E8FEB86659FD93))


def _vertex(h: np.ndarray, bounds: np.ndarray, shared: np.ndarray, bits: int) -> np.ndarray:
    """A 64-bit name of each set: equal sets, equal names. ``shared``: names that unlike sets were seen to share, which are told apart by more bits."""
    v = _sums(h, bounds, 0x94D049BB133111EB) >> U(64 - bits)
    if len(shared):
        v = np.where(np.isin(v, shared), mix(v ^ _sums(h, bounds, 0x2545F4914F6CDD1D)), v)
    return v


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == U else x.astype(np.int64), pa.int64())


def _folded(h: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Counts of each set's n-grams by bucket."""
    n = len(bounds) - 1
    of = np.repeat(np.arange(n), np.diff(bounds))
    counts = np.bincount(of * BUCKETS + (h & U(BUCKETS - 1)).astype(np.int64), minlength=n * BUCKETS)
    flat = np.minimum(counts, 255).astype(np.uint8).tobytes()
    return pa.array([flat[i * BUCKETS : (i + 1) * BUCKETS] for i in range(n)], pa.binary())


def _scan(docs: DataFrame, cfg: Join, shared: np.ndarray) -> DataFrame:
    """Rows of kind 0: a document with the hash of its text, its set's size, name and check. Kind 1: a sketch counter and its count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = np.zeros(SKETCH_SLOTS, np.uint32)
        names = ["kind", "a", "t", "n", "v", "w", "f"]
        for batch in batches:
            for i, j, s in slices(batch.column(2), fold_case=True):
                h, bounds, other = checked_sets(s, cfg.words)
                slot, c = np.unique((h >> U(42)).astype(np.int64), return_counts=True)
                counters[slot] += c.astype(np.uint32)
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(s.n, np.int8)), batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), _long(np.diff(bounds)), _long(_vertex(h, bounds, shared, cfg.name_bits)), _long(_sums(other, bounds, 0x9FB21C651E98DF25)), _folded(h, bounds)], names)
        # counters that stand out from the mean of the task
        slot = np.flatnonzero(counters >= max(4, 2 + int(6 * counters.mean())))
        for i in range(0, len(slot), 1 << 16):
            part = slot[i : i + (1 << 16)]
            none = _long(np.zeros(len(part), np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(part), np.int8)), _long(part), pa.nulls(len(part), pa.int64()), _long(counters[part]), none, none, pa.nulls(len(part), pa.binary())], names)

    return docs.select("id", "t", "text").mapInArrow(run, "kind byte, a long, t long, n long, v long, w long, f binary")


def _vertices(base: DataFrame, cfg: Join) -> tuple[DataFrame, DataFrame, np.ndarray]:
    """The scan, its vertices (v, least, n, f, m: members), and the names that had to be told apart.

    A name stands for 128 bits: where two sets with one name differ in their checks, the scan is made again with
    longer names for those.
    """
    shared = np.zeros(0, U)
    while True:
        scan = materialise(_scan(base, cfg, shared), "sets")
        members = scan.where("kind = 0 AND n > 0")
        found = materialise(members.groupBy("v").agg(F.min("a").alias("least"), F.first("n").alias("n"), F.first("f").alias("f"), F.count(F.lit(1)).alias("m"), F.min("w").alias("w0"), F.max("w").alias("w1")), "vertices")
        # expected number of names that two of n sets share: n * n / 2 ** 65
        again = np.array([r.v for r in found.where("w0 <> w1").select("v").limit(SMALL).collect()], np.int64).view(U)
        if not len(again):
            return scan, found.drop("w0", "w1"), shared
        shared = np.union1d(shared, again)
        discard(scan, found)


def _heavy(scan: DataFrame) -> np.ndarray:
    """(slot, count) of the most frequent counters: a table of at most HEAVY_SLOTS rows."""
    top = scan.where("kind = 1").groupBy("a").agg(F.sum("n").alias("c")).where("c >= 16").orderBy(F.desc("c"), "a").limit(HEAVY_SLOTS)
    rows = np.array([(r.a, r.c) for r in top.collect()], np.int64).reshape(-1, 2)
    return rows[np.argsort(rows[:, 0])]


def _columns(docs: DataFrame, cfg: Join, heavy: np.ndarray, shared: np.ndarray, wide: int) -> DataFrame:
    """The kept columns of the incidence: (n-gram, vertex, position << 32 | size, hot). Hot n-grams may have over ``wide`` vertices."""
    t = Fraction(cfg.percent, 100)
    known = docs.sparkSession.sparkContext.broadcast((heavy, shared))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(SKETCH_SLOTS, np.int32)
        rows, shared = known.value
        table[rows[:, 0]] = np.minimum(rows[:, 1], 2**31 - 1)
        seen: set[int] = set()
        for batch in batches:
            for _, _, s in slices(batch.column(0), fold_case=True):
                h, bounds = shingle_sets(s, cfg.words)
                v, size = _vertex(h, bounds, shared, cfg.name_bits), np.diff(bounds)
                # a task sends each vertex once
                fresh = np.zeros(s.n, bool)
                for k, name in enumerate(v.tolist()):
                    if name not in seen:
                        seen.add(name)
                        fresh[k] = True
                of = np.repeat(np.arange(s.n), size)
                count = table[(h >> U(42)).astype(np.int64)]
                order = np.lexsort((h, count, of))
                at = np.arange(len(h)) - bounds[of]
                least = -((-t.numerator * size) // t.denominator)
                keep = (at < (size - least + 1)[of]) & fresh[of]
                of, at, h, count = of[keep], at[keep], h[order][keep], count[order][keep]
                for k in range(0, len(h), 1 << 18):
                    o = of[k : k + (1 << 18)]
                    yield pa.RecordBatch.from_arrays([_long(h[k : k + (1 << 18)]), _long(v[o]), _long((at[k : k + (1 << 18)] << 32) | size[o]), pa.array(count[k : k + (1 << 18)] > wide)], ["g", "v", "ps", "hot"])

    return docs.mapInArrow(run, "g long, v long, ps long, hot boolean")


def _over_columns(rows: DataFrame, **stats: F.Column) -> DataFrame:
    """``rows`` with aggregates over their column. A column that may be large is summed in parts and met by its sums, not gathered."""
    per = W.partitionBy("g")
    cold = rows.where("NOT hot").select("*", *[x.over(per).alias(k) for k, x in stats.items()])
    hot = rows.where("hot")
    return cold.unionByName(hot.join(hot.groupBy("g").agg(*[x.alias(k) for k, x in stats.items()]), "g"))


def _room(p: str, q: str, percent: int) -> F.Column:
    """Whether positions and sizes of two vertices in a column leave room for the overlap needed."""
    sa, sb, pa_, pb = f"({p} & 4294967295L)", f"({q} & 4294967295L)", f"shiftright({p}, 32)", f"shiftright({q}, 32)"
    return F.expr(f"(100 + {percent}) * (1 + least({sa} - {pa_} - 1, {sb} - {pb} - 1)) >= {percent} * ({sa} + {sb}) AND 100 * least({sa}, {sb}) >= {percent} * greatest({sa}, {sb})")


def _plausible(pairs: DataFrame, folded: DataFrame, percent: int) -> DataFrame:
    """The pairs whose folded product, an upper bound of the overlap, reaches the limit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 4096):
                part = batch.slice(at, 4096)
                n = part.column(2).to_numpy() + part.column(3).to_numpy()
                x, y = (np.frombuffer(b"".join(part.column(k).to_pylist()), np.uint8).reshape(-1, BUCKETS) for k in (4, 5))
                low = np.minimum(x, y)
                most = low.sum(1, dtype=np.int64)
                most[(low == 255).any(1)] = 1 << 40
                yield part.filter(pa.array((100 + percent) * most >= percent * n)).select(["a", "b"])

    left, right = (folded.select(F.col("v").alias(k), F.col("n").alias(f"n{k}"), F.col("f").alias(f"f{k}")) for k in ("a", "b"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", "fa", "fb").mapInArrow(run, "a long, b long")


def _overlaps(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose exact similarity reaches the limit; overlap counts are accumulated a block at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column(2), batch.column(3)
            x, y = x.cast(pa.large_list(pa.int64())), y.cast(pa.large_list(pa.int64()))
            nx, ny = np.asarray(x.value_lengths()), np.asarray(y.value_lengths())
            start = 0
            while start < len(batch):
                stop, total = start, 0
                while stop < len(batch) and (stop == start or total + nx[stop] + ny[stop] <= 1 << 20):
                    total += nx[stop] + ny[stop]
                    stop += 1
                a, b = x.slice(start, stop - start), y.slice(start, stop - start)
                row = np.concatenate([np.repeat(np.arange(stop - start), nx[start:stop]), np.repeat(np.arange(stop - start), ny[start:stop])])
                col = np.concatenate([np.asarray(a.flatten()), np.asarray(b.flatten())])
                order = np.lexsort((col, row))
                row, col = row[order], col[order]
                both = np.bincount(row[1:][(row[1:] == row[:-1]) & (col[1:] == col[:-1])], minlength=stop - start)
                linked = 100 * both >= percent * (nx[start:stop] + ny[start:stop] - both)
                yield pa.RecordBatch.from_arrays([c.slice(start, stop - start).filter(pa.array(linked)) for c in (batch.column(0), batch.column(1))], ["a", "b"])
                start = stop

    left, right = sets.select(F.col("v").alias("a"), F.col("s").alias("x")), sets.select(F.col("v").alias("b"), F.col("s").alias("y"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(v, c): each linked vertex and the least vertex it reaches; star contraction with shared-folder steps."""
    edges = materialise(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("w")).where("u <> w").distinct(), "edges")
    trail: list[DataFrame] = []
    while True:
        # large star: hang larger neighbours on the least neighbour; small star: the rest likewise
        both = edges.select("u", "w").union(edges.select(F.col("w").alias("u"), F.col("u").alias("w")))
        low = both.groupBy("u").agg(F.min("w").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("w > u").select(F.col("w").alias("u"), F.col("m").alias("w"))
        large = materialise(large.where("u <> w").distinct(), "edges")
        low = large.groupBy("u").agg(F.min("w").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("w") == F.col("m"), F.col("u")).otherwise(F.col("w")).alias("u"), F.col("m").alias("w"))
        small = materialise(small.where("u <> w").distinct(), "edges")
        before = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "w").cast("decimal(38,0)"))).collect()[0]
        after = small.agg(F.count("*"), F.sum(F.xxhash64("u", "w").cast("decimal(38,0)"))).collect()[0]
        trail += [edges, large]
        edges = small
        if before == after:
            discard(*trail)
            return edges.select(F.col("u").alias("v"), F.col("w").alias("c"))


def _tagged(columns: DataFrame, comp: DataFrame | None) -> DataFrame:
    if comp is None:
        return columns.withColumn("c", F.col("v"))
    return columns.join(comp, "v", "left").withColumn("c", F.coalesce("c", "v"))


def _sum_links(*links: DataFrame) -> DataFrame:
    out = links[0]
    for x in links[1:]:
        out = out.union(x)
    return out.distinct()


def cluster(docs: DataFrame, cfg: Join = Join(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) of every row; component_id is the least id reachable by links."""
    out = _members(docs, cfg, id_col, text_col)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def first_copies(docs: DataFrame, cfg: Join = Join(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, with all its columns: the least by id (null ids last), vertex and text.

    Blank texts link with nothing, so each id keeps its own; rows alike in id and text are one document.
    """
    rows = _members(docs, cfg, id_col, text_col)
    least = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "v", "t")).alias("m")
    firsts = rows.where("n > 0").groupBy("c").agg(least).select("m.id", "m.t").union(rows.where("n = 0").select("id", "t").distinct())
    # one deal of the documents serves the join and the choice among rows alike in id and text
    keys = ["none", "id", "t"]
    key = lambda x, of: [x.isNull().alias("none"), F.coalesce(x.cast("long"), F.lit(0)).alias("id"), of.alias("t")]
    tagged = docs.select(F.struct(*docs.columns).alias("doc"), *key(F.col(id_col), F.xxhash64(text_col)))
    kept = tagged.join(firsts.select(*key(F.col("id"), F.col("t"))), keys, "left_semi")
    rest = [F.to_json(F.struct(f"doc.{c}")) for c in docs.columns if c not in (id_col, text_col)]
    nth = F.row_number().over(W.partitionBy(*keys).orderBy(*rest or [F.lit(1)]))
    return kept.withColumn("nth", nth).where("nth = 1").select("doc.*")


def _members(docs: DataFrame, cfg: Join, id_col: str, text_col: str) -> DataFrame:
    """(id, t, n, v, c, component_id) of every row: hash of its text, vertex, and the vertex that names its component."""
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("t"), F.col(text_col).alias("text"))
    scan, vertices, shared = _vertices(base, cfg)
    members = scan.where("kind = 0").select(F.col("a").alias("id"), "t", "n", "v")
    many = vertices.agg(F.sum("m")).collect()[0][0] or 0
    # one row for a column and vertex, of columns with two vertices or more; a hot column is dealt over many tasks and kept
    wide = max(cfg.wide, many // 10_000)
    part = F.when(F.col("hot"), F.pmod("v", F.lit(4096))).otherwise(0)
    raw = _columns(base.select("text"), cfg, _heavy(scan), shared, wide).withColumn("part", part).repartition("g", "part").groupBy("g", "part", "v", "hot").agg(F.min("ps").alias("ps"))
    per = W.partitionBy("g", "part")
    pruned = raw.withColumn("k", F.min("v").over(per)).withColumn("k2", F.max("v").over(per)).where("hot OR k <> k2").select("g", "v", "ps", "hot")
    columns = materialise(pruned, "columns")
    links, tried, comp = [], None, None
    for last in [False] * cfg.rounds + [True]:
        tagged = _tagged(columns, comp)
        if last:
            pairs = _between(tagged, cfg)
        else:
            # a column in one component has nothing left to find; else its leader meets all others
            star = _over_columns(tagged, l=F.min(F.struct(F.expr("shiftright(ps, 32)").alias("p"), "v", "ps", "c"))).where("c <> l.c").where(_room("ps", "l.ps", cfg.percent))
            pairs = star.select(F.least("v", "l.v").alias("a"), F.greatest("v", "l.v").alias("b")).distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = materialise(pairs, "pairs")
        tried = pairs if tried is None else tried.union(pairs)
        likely = materialise(_plausible(pairs, vertices, cfg.percent), "likely")
        if likely.isEmpty():
            continue
        ends = likely.select(F.col("a").alias("v")).union(likely.select(F.col("b").alias("v"))).distinct()
        sets = materialise(_sets(base, vertices.join(ends, "v", "left_semi").select("v", F.col("least").alias("id")), cfg, shared), "vertex_sets")
        found = materialise(_overlaps(likely, sets, cfg.percent), "links")
        discard(sets, likely)
        if not found.isEmpty():
            links.append(found)
            if comp is not None:
                discard(comp)
            comp = materialise(components(_sum_links(*links)), "components")
    discard(columns)
    if comp is None:
        comp = vertices.select("v", F.col("v").alias("c")).where("false")
    low = comp.join(vertices, "v").groupBy("c").agg(F.min("least").alias("m"))
    roots = comp.select("c").distinct().join(vertices.withColumnRenamed("v", "c"), "c").select("c", F.col("least").alias("r"))
    top = low.join(roots, "c").select("c", F.least("m", "r").alias("least"))
    named = comp.join(top, "c").select("v", "c", "least").union(top.select(F.col("c").alias("v"), "c", "least"))
    of = vertices.alias("x").join(named.alias("y"), "v", "left").select("v", "m", F.coalesce("y.c", "v").alias("c"), F.coalesce("y.least", "x.least").alias("least"))
    of = materialise(of, "named")
    # what has many copies is few vertices, sent to its members; the members of others are dealt by vertex
    copies = max(cfg.copies, many // SMALL)
    hot = of.where(F.col("m") > copies).select("v", "c", "least")
    near = join_small(members, hot.withColumn("hot", F.lit(True)), ["v"])
    cold = near.where("hot IS NULL AND n > 0").select("id", "t", "n", "v").join(of.where(F.col("m") <= copies).select("v", "c", "least"), "v")
    done = near.where("hot OR n = 0").select("v", "id", "t", "n", "c", "least").union(cold.select("v", "id", "t", "n", "c", "least"))
    out = done.select("id", "t", "n", "v", "c", F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("id")).alias("component_id"))
    out = materialise(out, "clusters")
    discard(scan, vertices, of, *links)
    return out


def _sets(base: DataFrame, wanted: DataFrame, cfg: Join, shared: np.ndarray) -> DataFrame:
    """(v, s) of the wanted vertices (v, id), their sets read from the texts under the ids.

    Vertices found only under null ids are read from the rows without one, and each is kept once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, s in slices(batch.column(0), fold_case=True):
                h, bounds = shingle_sets(s, cfg.words)
                s_col = pa.LargeListArray.from_arrays(pa.array(bounds, pa.int64()), _long(h)).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([_long(_vertex(h, bounds, shared, cfg.name_bits)), s_col], ["v", "s"])

    schema = "v long, s array<long>"
    sets = base.join(wanted.select("id").where("id IS NOT NULL").distinct(), "id", "left_semi").select("text").mapInArrow(run, schema)
    lost = wanted.where("id IS NULL").select("v")
    if lost.isEmpty():
        return sets
    return sets.union(base.where("id IS NULL").select("text").mapInArrow(run, schema).join(lost, "v", "left_semi").groupBy("v").agg(F.first("s").alias("s")))


def _between(tagged: DataFrame, cfg: Join) -> DataFrame:
    """Candidate pairs of different components, multiplied block by block within each column.

    A column's vertices are dealt to blocks by size, so that only blocks whose sizes are near enough to link
    meet; a column in one component is left out. A pair that shares many columns is needed only once: it is
    left out of a column if one of the last BEFORE columns of both is the same, for there, at smaller positions,
    the same bounds hold as well. The first column of a pair has no such column before it, so no pair is lost.
    """
    mixed = _over_columns(tagged, c1=F.min("c"), c2=F.max("c")).where("c1 <> c2").drop("c1", "c2")
    # a pair's smaller set is at least percent / 100 of the larger: on a scale of log(size) in such steps it is in the same or the next step
    step = math.log(100 / cfg.percent)
    mixed = mixed.withColumn("z", F.floor(F.log((F.col("ps").bitwiseAND(F.lit(4294967295))).cast("double")) / step + 1e-9).cast("int"))
    # n-grams of a vertex are in one total order, which its positions follow
    before = W.partitionBy("v").orderBy("ps", "g").rowsBetween(-BEFORE, -1)
    mixed = mixed.withColumn("h", F.collect_list("g").over(before))
    x = mixed.select("g", F.col("v").alias("a"), F.col("ps").alias("p"), F.col("c").alias("ca"), F.col("h").alias("ha"), F.explode(F.array(F.col("z") - 1, F.col("z"), F.col("z") + 1)).alias("z"))
    y = mixed.select("g", F.col("v").alias("b"), F.col("ps").alias("q"), F.col("c").alias("cb"), F.col("h").alias("hb"), "z")
    return x.join(y, ["g", "z"]).where("a < b AND ca <> cb").where("NOT arrays_overlap(ha, hb)").where(_room("p", "q", cfg.percent)).select("a", "b").distinct()
