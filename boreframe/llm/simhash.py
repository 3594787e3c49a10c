"""SimHash near-dedup over vantage-point trees.

1. Every document gets a 64-bit fingerprint of its word shingles; equal
   fingerprints collapse into one class, named by its smallest id.
2. A vantage-point tree, fitted on a bounded sample of the fingerprints, cuts
   the Hamming space into shards.  A shard that holds too many is dealt again
   by a subtree fitted on a sample of its own, until all are small; subtrees
   are rows of a table, so neither the driver nor a task holds the whole tree.
   Every fingerprint has one home shard.  At each node those within the link
   distance below the radius also travel to the outer side as queries, and
   queries follow every branch that the triangle bound does not rule out; so
   each linked pair meets in the home shard of one of the two.
3. A shard's queries are dealt to parts, each beside all of its home
   fingerprints.  A part continues the same tree down to small blocks, compares
   those exactly, and returns only a spanning forest: one edge per fingerprint
   to the smallest one of its local component.  Branches whose members are
   already connected are not searched again.
4. Components of the edges, named by their smallest id, give ``component_id``.
"""

from __future__ import annotations

import pickle
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boreframe.llm.common import cut, fresh, sized
from boreframe.llm.components import connected_components

_HASH_SEED = 42
#: leaves of a subtree, and the fingerprints it is fitted on
_FAN, _SUB_SAMPLE = 16, 512
#: queries of a part, in shard sizes: the home sets repeated for parts add at most a quarter to the queries
_PART = 4


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Unsigned 64-bit SimHash of a text (none or no words: 0)."""
    words = (text or "").encode().lower().split()  # bytes: A-Z and ASCII space only
    if not words:
        return 0
    joined = b" ".join(words)
    starts = [0, *accumulate(len(w) + 1 for w in words)]
    k = min(shingle, len(words))
    h64 = xxhash.xxh64_intdigest
    hashes = np.array([h64(joined[a:b - 1], _HASH_SEED) for a, b in zip(starts, starts[k:])], ">u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at:at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """``(id, content, fp)``: a hash of the whole text, and the fingerprint as a
    signed 64-bit integer; the id keeps its type."""
    d = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("content"),
                    F.col(text_col).alias("text"))

    def run(batches):  # noqa: ANN001
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), shingle) for t in b.column(2)], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(fps.view(np.int64))], ["id", "content", "fp"])

    return d.mapInArrow(run, f"id {d.schema['id'].dataType.simpleString()}, content long, fp long")


def _far(a: np.ndarray, b) -> np.ndarray:  # noqa: ANN001
    return np.bitwise_count(a ^ b).astype(np.int16)


def _vantage(points: np.ndarray, tries: int = 12) -> tuple[np.uint64, int]:
    """The candidate whose distances spread most, and their median; both sides
    of the radius are non-empty if the points differ."""
    step = max(1, len(points) // tries)
    some = points[::max(1, len(points) // 512)]
    best = max(points[::step][:tries], key=lambda v: float(_far(some, v).std()))
    d = _far(points, best)
    mid = int(np.median(d))
    return best, min(mid, int(d.max()) - 1)


def grow(points: np.ndarray, leaves: int, least: int = 8) -> list:
    """A vantage-point tree with ``leaves`` leaves (fewer where less than
    ``least`` points are left): nodes are ``[vantage, radius, inner, outer]``,
    leaves are shard numbers."""
    count = [0]

    def node(p: np.ndarray, n: int):  # noqa: ANN202
        if n <= 1 or len(p) < least:
            count[0] += 1
            return count[0] - 1
        v, mid = _vantage(p)
        near = _far(p, v) <= mid
        return [v, mid, node(p[near], n // 2), node(p[~near], n - n // 2)]

    return [node(points, leaves), count[0]]


def deal(tree, fps: np.ndarray, link: int, home: np.ndarray | None = None  # noqa: ANN001
         ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Home and boundary shards of fingerprints: (row, shard, is home).  Those
    not marked in ``home`` are queries."""
    rows, shards, homes = [], [], []
    todo = [(tree, np.arange(len(fps)), np.ones(len(fps), bool) if home is None else home)]
    while todo:
        node, ix, home = todo.pop()
        if not len(ix):
            continue
        if not isinstance(node, list):
            rows.append(ix)
            shards.append(np.full(len(ix), node, np.int32))
            homes.append(home)
            continue
        v, mid, inner, outer = node
        d = _far(fps[ix], v)
        to_in = np.where(home, d <= mid, d <= mid + link)
        to_out = d > mid - link  # of the inner ones, those near the boundary go out as queries
        todo.append((inner, ix[to_in], home[to_in]))
        todo.append((outer, ix[to_out], (home & (d > mid))[to_out]))
    if not rows:
        return np.empty(0, int), np.empty(0, np.int32), np.empty(0, bool)
    return np.concatenate(rows), np.concatenate(shards), np.concatenate(homes)


def link_shard(fps: np.ndarray, home: np.ndarray, link: int, block: int = 96) -> np.ndarray:
    """Smallest member of each row's component, over all pairs of a home
    fingerprint with any other within ``link`` bits."""
    parent = np.arange(len(fps))

    def roots(ix: np.ndarray) -> np.ndarray:
        r = parent[ix]
        while True:
            up = parent[r]
            if (up == r).all():
                parent[ix] = r
                return r
            r = up

    def join(ix: np.ndarray) -> None:
        u = np.unique(roots(ix))
        parent[u] = u[0]

    todo = [(np.flatnonzero(home), np.flatnonzero(~home))]
    while todo:
        h, q = todo.pop()
        if not len(h):
            continue
        every = np.concatenate([h, q])
        if len(every) < 2 or (roots(every) == parent[every[0]]).all():
            continue
        if len(h) <= block:
            for at in range(0, len(every), 1 << 15):
                part = every[at:at + (1 << 15)]
                near = _far(fps[h][:, None], fps[part][None, :]) <= link
                for i in np.flatnonzero(near.any(1)):
                    join(np.r_[h[i], part[near[i]]])
            continue
        v, mid = _vantage(fps[h])
        dh, dq = _far(fps[h], v), _far(fps[q], v)
        at = h[np.flatnonzero(dh == 0)[0]]
        join(np.r_[at, h[dh <= link], q[dq <= link]])
        inner, outer = dh <= mid, dh > mid
        todo.append((h[inner], q[dq <= mid + link]))
        todo.append((h[outer], np.concatenate([q[dq > mid - link], h[inner & (dh > mid - link)]])))
    return roots(np.arange(len(fps)))


_DEALT = "shard long, fp long, home boolean"


def _longs(column) -> np.ndarray:  # noqa: ANN001
    return column.to_numpy(zero_copy_only=False).astype(np.int64)


def _deal_again(dealt: DataFrame, sizes: DataFrame, shard: int, link: int, salt: int) -> DataFrame:
    """The rows of the shards with more than ``shard`` home fingerprints, dealt
    by a subtree each, which is fitted on a hashed sample of its shard."""
    def fit(table: pa.Table) -> pa.Table:
        points = np.sort(_longs(table["fp"])).view(np.uint64)
        leaves = min(_FAN, max(2, -(-table["homes"][0].as_py() // shard)))
        tree, _ = grow(points, leaves, least=2)
        return pa.table({"at": pa.array([table["shard"][0].as_py()], pa.int64()),
                         "tree": pa.array([pickle.dumps(tree)], pa.binary())})

    def run(batches):  # noqa: ANN001
        for b in batches:
            at, fps = _longs(b.column(0)), _longs(b.column(1)).view(np.uint64)
            home = b.column(2).to_numpy(zero_copy_only=False)
            for s in np.unique(at):
                ix = np.flatnonzero(at == s)
                tree = pickle.loads(b.column(3)[int(ix[0])].as_py())  # written by fit
                row, leaf, is_home = deal(tree, fps[ix], link, home[ix])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(s * _FAN + leaf.astype(np.int64)), pa.array(fps[ix][row].view(np.int64)),
                     pa.array(is_home)], ["shard", "fp", "home"])

    big = sizes.where(F.col("homes") > shard).select(F.col("shard").alias("at"), "homes")
    every = F.greatest(F.lit(1), F.floor(F.col("homes") / _SUB_SAMPLE))
    trees = cut(dealt.where("home").join(sized(big, 100_000), F.col("shard") == F.col("at"))
                .where(F.pmod(F.xxhash64("fp", F.lit(salt)), every) == 0).select("shard", "fp", "homes")
                .groupBy("shard").applyInArrow(fit, "at long, tree binary"))
    return (dealt.join(sized(trees, 100_000), F.col("shard") == F.col("at"))
            .select("shard", "fp", "home", "tree").mapInArrow(run, _DEALT))


def shards_of(classes: DataFrame, max_bits: int, sample: int, shard: int) -> DataFrame:
    """``(level, shard, part, fp, home)`` of the distinct ``fp`` of ``classes``:
    no shard has more than ``shard`` home fingerprints, no part more than about
    four times as many queries; the home fingerprints are in every part of their shard."""
    n = classes.count()
    leaves = max(1, -(-n // shard))
    share = max(8, -(-n // sample))
    picked = [r[0] for r in classes.where(F.pmod(F.xxhash64("fp"), F.lit(share)) == 0)
              .select("fp").collect()] if leaves > 1 else []
    tree, _ = grow(np.sort(np.array(picked, np.int64)).view(np.uint64), leaves)

    def spread(batches):  # noqa: ANN001
        for b in batches:
            fps = _longs(b.column(0)).view(np.uint64)
            row, to, home = deal(tree, fps, max_bits)
            yield pa.RecordBatch.from_arrays(
                [pa.array(to.astype(np.int64)), pa.array(fps[row].view(np.int64)), pa.array(home)],
                ["shard", "fp", "home"])

    dealt, done, level = cut(classes.select("fp").mapInArrow(spread, _DEALT)), [], 0
    while True:
        sizes = cut(dealt.groupBy("shard").agg(F.sum(F.col("home").cast("long")).alias("homes"),
                                               F.sum((~F.col("home")).cast("long")).alias("queries")))
        small = sizes.where((F.col("homes") > 0) & (F.col("homes") <= shard)).select(
            F.col("shard").alias("at"), F.greatest(F.lit(1), F.ceil(F.col("queries") / (_PART * shard))).cast("int").alias("parts"))
        last = F.col("parts") - 1
        done.append(dealt.join(sized(small, 100_000), F.col("shard") == F.col("at")).select(
            F.lit(level).alias("level"), "shard", "fp", "home",
            F.explode(F.when(F.col("home"), F.sequence(F.lit(0), last)).otherwise(
                F.array(F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")))).alias("part")))
        if not sizes.where(F.col("homes") > shard).limit(1).count():
            break
        level += 1
        dealt = cut(_deal_again(dealt, sizes, shard, max_bits, level))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def _groups(docs_fp: DataFrame, max_bits: int, sample: int, shard: int) -> DataFrame:
    """``(class_fp, group_fp)``: every fingerprint's component, named by a
    fingerprint."""
    classes = cut(docs_fp.select("fp").distinct())

    def search(table: pa.Table) -> pa.Table:
        fps = _longs(table["fp"])
        order = np.argsort(fps, kind="stable")
        fps = fps[order]
        root = link_shard(fps.view(np.uint64), table["home"].to_numpy(zero_copy_only=False)[order], max_bits)
        child = np.flatnonzero(root != np.arange(len(root)))
        return pa.table({"a": fps[child], "b": fps[root[child]]})

    edges = (shards_of(classes, max_bits, sample, shard).groupBy("level", "shard", "part")
             .applyInArrow(search, "a long, b long"))
    comps = connected_components(edges)
    return cut(classes.join(comps, classes["fp"] == comps["node"], "left")
               .select(F.col("fp").alias("class_fp"), F.coalesce("component", "fp").alias("group_fp")))


def simhash_near_dups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      shingle: int = 3, max_bits: int = 3, sample: int = 4096,
                      shard: int = 16384) -> DataFrame:
    """One row per document: ``id_col``, ``fingerprint`` (16 hex digits) and
    ``component_id``, the smallest id reachable over links of at most
    ``max_bits`` differing bits.  Ids may be of any type that has an order.

    Null or empty text: fingerprint zero, linked like any other.  Fewer words
    than ``shingle``: the whole sequence is the one shingle.  Repeated rows
    and equal texts share a class.  A row with a null id links like any other
    and names no component; where all ids of one are null, so is its name.
    Empty table: no rows.
    ``sample`` bounds the fingerprints the top tree is fitted on (no more than
    an eighth of all); every fingerprint is indexed.  ``shard`` bounds the home
    fingerprints of a shard: every level of the tree above the shards ships
    about half of the fingerprints to a second shard, while the levels inside a
    shard ship none.
    """
    docs_fp = cut(fingerprints(docs, id_col, text_col, shingle))
    groups = _groups(docs_fp, max_bits, sample, shard)
    low = docs_fp.groupBy("fp").agg(F.min("id").alias("rep"))
    named = groups.join(low, groups["class_fp"] == low["fp"]).select("class_fp", "group_fp", "rep")
    names = named.groupBy(F.col("group_fp").alias("g")).agg(F.min("rep").alias("component_id"))
    named = cut(named.join(names, named["group_fp"] == names["g"]).select("class_fp", "component_id"))
    return (docs_fp.join(named, docs_fp["fp"] == named["class_fp"], "left")
            .select(F.col("id").alias(id_col),
                    F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"))


def drop_near_dups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   shingle: int = 3, max_bits: int = 3, sample: int = 4096, shard: int = 16384) -> DataFrame:
    """``docs`` with one row of each component, that of the smallest id (null
    last), then of the smallest hash of its text; columns unchanged.

    Rows are told apart by id and text, so an id that carries two unrelated
    texts keeps both.  Of rows that repeat id and text one stays, whichever.
    Null and empty texts are one component.  Empty table: no rows.
    """
    rows = cut(fingerprints(docs, id_col, text_col, shingle))
    groups = _groups(rows, max_bits, sample, shard)
    keys = cut(rows.groupBy("fp", "id", "content").agg(F.count(F.lit(1)).alias("n"))
               .join(groups, F.col("fp") == F.col("class_fp"))
               .select("group_fp", F.struct(F.col("id").isNull().alias("none"), "id", "content").alias("key"), "n"))
    # joined back by key, not by group: a group may hold a third of all rows
    first = keys.groupBy("group_fp").agg(F.min("key").alias("first")).select("first")
    judged = cut(keys.join(first, F.col("key") == F.col("first"), "left")
                 .select("key", "n", F.col("first").isNotNull().alias("stays")))
    row_hash = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    at_id, at_content, content = fresh(docs, "near_id", "near_content", "content_hash")

    def at(kept: DataFrame) -> DataFrame:
        return kept.select(F.col("key.id").alias(at_id), F.col("key.content").alias(at_content))

    def match(other: DataFrame):  # noqa: ANN202
        return docs[id_col].eqNullSafe(other[at_id]) & (row_hash == other[at_content])

    gone = at(judged.where(~F.col("stays")))
    left = docs.join(gone, match(gone), "left_anti")
    twice = at(judged.where(F.col("stays") & (F.col("n") > 1)))
    if not twice.limit(1).count():
        return left
    one = (left.join(twice, match(twice), "left_semi").withColumn(content, row_hash)
           .dropDuplicates([id_col, content]).drop(content))
    return left.join(twice, match(twice), "left_anti").unionByName(one)
