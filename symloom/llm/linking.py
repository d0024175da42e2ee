"""Exact similarity links between sets that share a band key, without emitting the pairs of a group.

Items are rows (uid, chunk, idx, keys): a set in a chunk file and its band keys. The work goes in four steps:

1. star: in each bucket the member whose buckets are largest is the pivot; members that their sketches call likely are verified
   against it;
2. the verified links are joined into components, and buckets whose members are all of one component are settled;
3. blocks: in each bucket left over (of buckets with the same members one), the members outside the bucket's largest component are
   compared with all others, block by block. Sketches go first: only members with a likely partner in their block are then
   compared as sets (a product of small incidence matrices). A block yields a spanning forest of its links, never their pairs;
4. all links together give the components.

What stands for a set (its compressed text) is loaded from the chunk files by the tasks that need it, and goes to a task once,
however many blocks it takes part in there. Tasks hold a set number of requests. Nothing is collected to the driver.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symloom.llm.chunks import by_chunk
from symloom.llm.common import materialize

#: Members of a block, of a star's block, and requests of a task.
BLOCK, STAR_BLOCK, PART_REQUESTS = 200, 100, 400
SETS = "part int, uid long, label long, held binary, tasks array<long>, pivots array<boolean>"
LINKS = "a long, b long"


def connected(edges: DataFrame, jumps: int = 2) -> DataFrame:
    """uid, root (the least uid of its component) for all ends of edges a, b: every node points to its least neighbour,
    pointers are followed a few times, and the edges between what they point to are left for the next round."""
    edges = materialize(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "link-edges")
    roots = edges.select(F.explode(F.array("a", "b")).alias("uid")).distinct().select("uid", F.col("uid").alias("root"))
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = materialize(both.groupBy("a").agg(F.min("b").alias("b")).select("a", F.least("a", "b").alias("p")), "link-up")
        for _ in range(jumps):
            up = up.join(up.select(F.col("a").alias("x"), F.col("p").alias("y")), F.col("p") == F.col("x")).select("a", F.col("y").alias("p"))
        up = materialize(up, "link-up")
        roots = materialize(roots.join(up, F.col("root") == F.col("a"), "left").select("uid", F.coalesce("p", "root").alias("root")), "link-roots")
        up2 = up.select(F.col("a").alias("x"), F.col("p").alias("q"))
        edges = edges.join(up, "a").select("p", "b").join(up2, F.col("b") == F.col("x")).where("p <> q")
        edges = materialize(edges.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct(), "link-edges")
    return roots


def _star(sets: list[np.ndarray], uid: np.ndarray, label: np.ndarray, at: np.ndarray, pivot: np.ndarray, linked) -> list[tuple[int, int]]:
    """Links of a pivot with its members."""
    lead, others = at[pivot][0], at[~pivot]
    if not len(others):
        return []
    own, held = sets[lead], [sets[i] for i in others]
    size = np.array([len(s) for s in held])
    ids = np.concatenate(held)
    hit = own[np.minimum(np.searchsorted(own, ids), len(own) - 1)] == ids
    both = np.bincount(np.repeat(np.arange(len(held)), size), hit, len(held)).astype(np.int64)
    good = linked(both, size + len(own) - both)
    return [(int(uid[lead]), int(uid[i])) for i in others[good]]


def _block(sets: list[np.ndarray], uid: np.ndarray, label: np.ndarray, at: np.ndarray, pivot: np.ndarray, linked) -> list[tuple[int, int]]:
    """A spanning forest of the links between members of different labels. pivot tells members that are only compared
    with the others, not among themselves."""
    at, first = np.unique(at, return_index=True)
    fixed, label, held = pivot[first], label[at], [sets[i] for i in at]
    size = np.array([len(s) for s in held])
    row = np.repeat(np.arange(len(held)), size)
    ids, column, count = np.unique(np.concatenate(held), return_inverse=True, return_counts=True)
    shared = count > 1  # a shingle that only one of them has counts in no intersection
    number = np.cumsum(shared) - 1
    row, column = row[shared[column]], number[column[shared[column]]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    both = np.zeros((len(held), len(held)), np.float32)
    for a in range(0, int(shared.sum()), 4096):
        i, j = np.searchsorted(column, [a, a + 4096])
        part = np.zeros((len(held), 4096), np.float32)
        part[row[i:j], column[i:j] - a] = 1
        both += part @ part.T
    both = both.astype(np.int64)
    good = linked(both, size[:, None] + size[None, :] - both) & (label[:, None] != label[None, :])
    good &= ~(fixed[:, None] & fixed[None, :])
    top = {x: x for x in label.tolist()}

    def find(x: int) -> int:
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    out = []
    for i, j in zip(*np.nonzero(np.triu(good, 1))):
        x, y = find(int(label[i])), find(int(label[j]))
        if x != y:
            top[max(x, y)] = min(x, y)
            out.append((int(uid[at[i]]), int(uid[at[j]])))
    return out


def _parts(rows: DataFrame) -> int:
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // PART_REQUESTS))


def _by_task(table: pa.Table):
    """uid and label of the rows; the rows of each task and whether they are pivots there."""
    uid, label = table["uid"].to_numpy(), table["label"].to_numpy()
    tasks, pivots = table["tasks"].combine_chunks(), table["pivots"].combine_chunks()
    row = np.repeat(np.arange(len(table)), np.diff(tasks.offsets.to_numpy()))
    task, pivot = tasks.flatten().to_numpy(), pivots.flatten().to_numpy(zero_copy_only=False)
    order = np.lexsort((row, task))
    cut = np.flatnonzero(np.diff(task[order])) + 1
    return uid, label, [(row[at], pivot[at]) for at in np.split(order, cut)]


def _verified(requests: DataFrame, load: Callable, unpack: Callable, linked: Callable, work: Callable) -> DataFrame:
    """Runs work on the sets of each task. requests: chunk, idx, task, pivot, uid, label; a written table."""
    parts = _parts(requests)

    def fetch(rows: pa.Table) -> pa.Table:
        """What stands for a set, once for each part that asks for it."""
        idx, task, uid = (rows[c].to_numpy() for c in ("idx", "task", "uid"))
        part, pivot, label = (task % parts).astype(np.int32), rows["pivot"].to_numpy(zero_copy_only=False), rows["label"].to_numpy()
        order = np.lexsort((task, idx, part))
        part, idx, task, uid, pivot, label = (x[order] for x in (part, idx, task, uid, pivot, label))
        head = np.flatnonzero(np.concatenate([[True], (part[1:] != part[:-1]) | (idx[1:] != idx[:-1])]))
        where, back = np.unique(idx[head], return_inverse=True)
        held = load(rows["chunk"][0].as_py(), where)
        offsets = pa.array(np.append(head, len(idx)), pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (task, pivot)]
        return pa.table([pa.array(part[head]), pa.array(uid[head]), pa.array(label[head]), pa.array([held[i] for i in back], pa.binary()), *lists], names=["part", "uid", "label", "held", "tasks", "pivots"])

    def verify(table: pa.Table) -> pa.Table:
        uid, label, tasks = _by_task(table)
        ids, first = unpack(table["held"].to_pylist())
        sets = [ids[i:j] for i, j in zip(first[:-1], first[1:])]
        links = [x for at, pivot in tasks for x in work(sets, uid, label, at, pivot, linked)]
        return pa.table([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["a", "b"])

    least = int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    fetched = by_chunk(requests, 4 * least).applyInArrow(fetch, SETS)
    return fetched.repartition(parts, "part").groupBy("part").applyInArrow(verify, LINKS)


def star_links(pairs: DataFrame, place: DataFrame, load: Callable, unpack: Callable, linked: Callable) -> DataFrame:
    """The pairs (uid, pivot) that are linked, as a, b. place: uid, chunk, idx."""
    count = pairs.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / STAR_BLOCK).cast("int").alias("blocks"))
    count = materialize(count, "link-counts")  # a written table: the rows of a hot pivot can be split among tasks
    pairs = pairs.join(count, "pivot").withColumn("task", F.shiftrightunsigned(F.xxhash64("pivot", F.pmod(F.xxhash64("uid"), F.col("blocks"))), 1))
    wanted = pairs.select("uid", "task", F.lit(False).alias("pivot")).unionByName(pairs.select(F.col("pivot").alias("uid"), "task", F.lit(True).alias("pivot")).distinct())
    requests = wanted.join(place, "uid").select("chunk", "idx", "task", "pivot", "uid", F.lit(0).cast("long").alias("label"))
    return materialize(_verified(materialize(requests, "link-requests"), load, unpack, linked, _star), "link-stars")


def _blocks(left: DataFrame) -> DataFrame:
    """uid, label, pivot, task from key, uid, label: the members of each bucket dealt into pairs of blocks."""
    by_label = left.groupBy("key", "label").agg(F.count(F.lit(1)).alias("c"))
    main = by_label.groupBy("key").agg(F.max(F.struct("c", "label")).alias("m"), F.sum("c").alias("all"))
    main = main.select("key", F.col("m.label").alias("main"), F.ceil(F.col("m.c") / BLOCK).cast("int").alias("nm"), F.ceil((F.col("all") - F.col("m.c")) / BLOCK).cast("int").alias("nl"))
    cast = left.join(materialize(main, "link-main"), "key").withColumn("pivot", F.col("label") == F.col("main"))
    mine = F.pmod(F.xxhash64("uid"), F.when(F.col("pivot"), F.col("nm")).otherwise(F.col("nl"))).cast("int")
    cast = cast.withColumn("mine", mine)
    upto = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    with_main = F.transform(upto("nm"), lambda c: F.xxhash64(F.col("key"), F.lit(1), F.col("mine"), c))
    with_rest = F.transform(upto("nl"), lambda c: F.xxhash64(F.col("key"), F.lit(0), F.least(F.col("mine"), c), F.greatest(F.col("mine"), c)))
    of_main = F.transform(upto("nl"), lambda c: F.xxhash64(F.col("key"), F.lit(1), c, F.col("mine")))
    tasks = F.when(F.col("pivot"), of_main).otherwise(F.concat(with_main, with_rest))
    return cast.select("uid", "label", "pivot", F.explode(tasks).alias("task")).withColumn("task", F.shiftrightunsigned("task", 1))


def _sifted(cast: DataFrame, sketches: DataFrame, near: Callable) -> DataFrame:
    """The rows of cast that have a likely partner of another label in their task. sketches: uid and what near() compares."""
    names = [c for c in sketches.columns if c != "uid"]
    rows = materialize(cast, "link-cast")
    parts = _parts(rows)

    def sift(table: pa.Table) -> pa.Table:
        task, label = table["task"].to_numpy(), table["label"].to_numpy()
        pivot, keep = table["pivot"].to_numpy(zero_copy_only=False), np.zeros(len(table), bool)
        order = np.argsort(task, kind="stable")
        held = {c: table[c].to_pylist() for c in names}
        for at in np.split(order, np.flatnonzero(np.diff(task[order])) + 1):
            open_ = (label[at][:, None] != label[at][None, :]) & ~(pivot[at][:, None] & pivot[at][None, :])
            keep[at] = near({c: [held[c][i] for i in at] for c in names}, open_)
        return table.select(["uid", "label", "pivot", "task"]).filter(pa.array(keep))

    dealt = rows.join(sketches, "uid").withColumn("part", F.pmod("task", F.lit(parts)).cast("int"))
    return dealt.repartition(parts, "part").groupBy("part").applyInArrow(sift, "uid long, label long, pivot boolean, task long")


def components(items: DataFrame, load: Callable, unpack: Callable, linked: Callable, likely: Callable[[DataFrame], DataFrame], sketches: DataFrame, near: Callable) -> DataFrame:
    """uid, root for the items that have links.

    load(chunk, idx) gives what stands for the sets of the chunk's rows idx, unpack(...) the sets themselves: ids and where each
    begins; linked(intersection, union) tells whether sets are linked; likely drops star pairs (uid, pivot) that cannot be
    linked; near(columns of sketches, open) tells which members of a block have a likely partner among the open pairs."""
    rows = items.select("uid", F.explode("keys").alias("key"))
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    members = materialize(rows.join(sizes, "key").select("key", "uid", "c"), "link-members")
    weight = members.groupBy("uid").agg(F.sum("c").alias("weight"))
    place = items.select("uid", "chunk", "idx").join(members.select("uid").distinct(), "uid", "left_semi")
    place = materialize(place, "link-places")
    weighed = materialize(members.join(weight, "uid"), "link-weighed")
    lead = weighed.groupBy("key").agg(F.max(F.struct("weight", (-F.col("uid")).alias("u"))).alias("m")).select("key", (-F.col("m.u")).alias("pivot"))
    pairs = weighed.join(materialize(lead, "link-leads"), "key").where("uid <> pivot").select("uid", "pivot").distinct()
    pairs = materialize(likely(materialize(pairs, "link-pairs")), "link-likely")
    stars = star_links(pairs, place, load, unpack, linked)
    roots = connected(stars)

    named = members.join(roots, "uid", "left").select("key", "uid", F.coalesce("root", "uid").alias("label"))
    named = materialize(named, "link-named")
    same = [F.sum(F.xxhash64(F.lit(i), "uid").cast("decimal(20,0)")).alias(f"s{i}") for i in (1, 2)]
    unsettled = named.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("c"), *same).where("lo <> hi")
    unsettled = unsettled.groupBy("c", "s1", "s2").agg(F.min("key").alias("key")).select("key")  # buckets of the same members once
    left = materialize(named.join(materialize(unsettled, "link-open"), "key"), "link-left")
    sifted = _sifted(_blocks(left), sketches, near)
    requests = materialize(materialize(sifted, "link-sifted").join(place, "uid").select("chunk", "idx", "task", "pivot", "uid", "label"), "link-requests")
    return connected(stars.unionByName(_verified(requests, load, unpack, linked, _block)))
