"""Near-duplicate documents by a chosen-path set similarity join (operator 3).

Documents are sets of word shingles. Copies of a set are folded into one class first. Each
class carries a MinHash signature; a path chooses coordinates of it, and classes that agree on
all coordinates chosen so far share a node. Nodes of one class are dropped, small nodes are
compared exhaustively, larger ones branch into two further coordinates, which the node's
own hash picks. Many paths, independent of each other, are walked at once. Nodes that are still
large at MAX_DEPTH hold near copies for the most part: their classes are hung below the smallest.

Comparisons in a node use signatures with a wide margin and yield a spanning star, never all
pairs. What hangs together by stars is then confirmed on full shingle sets, inside blocks of
bounded size: a search from set to set looks at those not reached yet, so that a dense group
costs about one look at each set. Only confirmed links, again as stars, make the components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from melder.llm.common import batches_of, bitmap, in_bitmap, whole_groups, written
from melder.llm.components import components

COORDINATES = 128  # of a signature, 16 bits each
#: Independent paths. A pair at 0.8 keeps to three coordinates of one with 0.512, so all miss it with
#: 0.488 ** 16 = 1e-5; where nodes branch it keeps to a path with 0.48 at least, and all miss it with 3e-5.
PATHS = 16
FIRST_DEPTH = 3
MAX_DEPTH = 6  # nodes over LEAF branch up to here: at most 2 ** 3 rows for each of theirs
BROADCAST_IDS = 1_000_000  # dropped ids that are sent to every task; beyond it a filter of fixed size finds the rows to join
LEAF = 2000  # classes in a node that are compared exhaustively
MARGIN = 5.0  # standard deviations of the signature's estimate below the threshold
BLOCK_ITEMS = 1_500_000  # shingles in a block of a group that is confirmed in several tasks
REP_BITS = 24

_MULTIPLIERS = np.random.default_rng(7).integers(1, 2**63, size=COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_OFFSETS = np.random.default_rng(8).integers(0, 2**63, size=COORDINATES, dtype=np.uint64)
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of `width` words; with fewer words one
    shingle of all of them, without words none. Words are runs without ASCII white space; only
    A-Z are lower-cased."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    n = min(width, len(words))
    s = np.full(len(words) - n + 1, n, dtype=np.uint64)
    for i in range(n):
        s = _mixed(s * _FACTOR + h[i : len(words) - n + 1 + i])
    return np.unique(s)


def signature(s: np.ndarray) -> np.ndarray:
    """The low 16 bits of the minima of a set under COORDINATES hash functions."""
    low = np.full(COORDINATES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(s), 2048):
        part = s[i : i + 2048, None] * _MULTIPLIERS[None, :] + _OFFSETS[None, :]
        np.minimum(low, part.min(axis=0), out=low)
    return (_mixed(low) & np.uint64(0xFFFF)).astype(np.uint16)


def _profiles(width: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            sets = [shingle_set(t, width) for t in f["text"]]
            yield pd.DataFrame(
                {
                    "doc_id": f["doc_id"],
                    "n_shingles": [len(s) for s in sets],
                    "set_key": [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets],
                    "sig": [signature(s).tobytes() if len(s) else None for s in sets],
                }
            )

    return run


def _choice(node: np.ndarray, salt: int) -> np.ndarray:
    return (_mixed(node + np.uint64(salt) * _FACTOR) % np.uint64(COORDINATES)).astype(np.int64)


def _roots(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The nodes at FIRST_DEPTH: PATHS hashes of FIRST_DEPTH coordinates each."""
    picks = np.random.default_rng(11).permuted(np.tile(np.arange(COORDINATES), (PATHS, 1)), axis=1)[:, :FIRST_DEPTH]
    for f in frames:
        sig = np.frombuffer(b"".join(f["sig"]), dtype=np.uint16).reshape(-1, COORDINATES)
        node = np.tile(_mixed(np.arange(1, PATHS + 1, dtype=np.uint64)), (len(f), 1))
        for d in range(FIRST_DEPTH):
            node = _mixed(node * _FACTOR + sig[:, picks[:, d]])
        yield pd.DataFrame({"rep": np.repeat(f["rep"].to_numpy(), PATHS), "node": node.ravel().view(np.int64)})


def _branches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Two children of each row's node; the node's hash chooses their coordinates."""
    for f in frames:
        if f.empty:
            continue
        sig = np.frombuffer(b"".join(f["sig"]), dtype=np.uint16).reshape(-1, COORDINATES)
        node, at = f["node"].to_numpy().astype(np.int64).view(np.uint64), np.arange(len(f))
        first = _choice(node, 1)
        second = (first + 1 + _choice(node, 2) % (COORDINATES - 1)) % COORDINATES
        a = _mixed(_mixed(node + np.uint64(5)) * _FACTOR + sig[at, first])
        b = _mixed(_mixed(node + np.uint64(6)) * _FACTOR + sig[at, second])
        yield pd.DataFrame({"rep": np.concatenate([f["rep"], f["rep"]]), "node": np.concatenate([a, b]).view(np.int64)})


def _labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest row reachable from each of n rows over the links (a, b)."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        np.minimum.at(label, before[a], low)
        np.minimum.at(label, before[b], low)
        label = label[label]
        if (label == before).all():
            break
    return label


def _compare(floor: float):
    """Stars over the classes of each node whose signatures agree on `floor` of their coordinates."""
    need = int(np.ceil(floor * COORDINATES))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in whole_groups(frames, ["node"]):
            node, rep = f["node"].to_numpy(), f["rep"].to_numpy()
            sig = np.frombuffer(b"".join(f["sig"]), dtype=np.uint16).reshape(-1, COORDINATES)
            ends = np.flatnonzero(np.append(node[1:] != node[:-1], True)) + 1
            end = np.repeat(ends, np.diff(np.append(0, ends)))
            a, b, rows, shift = [], [], np.arange(len(f)), 1
            while True:
                rows = rows[rows + shift < end[rows]]
                if not len(rows):
                    break
                for part in np.array_split(rows, len(rows) // 20_000 + 1):
                    hit = part[(sig[part] == sig[part + shift]).sum(axis=1) >= need]
                    a.append(hit)
                    b.append(hit + shift)
                shift += 1
            a, b = (np.concatenate(x) if x else np.empty(0, dtype=np.int64) for x in (a, b))
            root = _labels(len(f), a, b)
            hung = np.flatnonzero(root != np.arange(len(f)))
            yield pd.DataFrame({"a": rep[hung], "b": rep[root[hung]]}).drop_duplicates()

    return run


def _sets(width: int, bits: np.ndarray):
    """The shingle sets of the documents whose id may be wanted."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            f = f[f["doc_id"].notna()]
            ids = f["doc_id"].to_numpy().astype(np.int64)
            maybe = in_bitmap(bits, (_mixed(ids.view(np.uint64)) & np.uint64((1 << REP_BITS) - 1)).astype(np.int64))
            f = f[maybe]
            yield pd.DataFrame({"rep": f["doc_id"].astype("int64"), "items": [shingle_set(t, width).tobytes() for t in f["text"]]})

    return run


def _slots(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        yield pd.DataFrame({"slot": (_mixed(f["id"].to_numpy().astype(np.int64).view(np.uint64)) & np.uint64((1 << REP_BITS) - 1)).astype(np.int64)})


def _reached(sets: list[np.ndarray], side: np.ndarray, percent: int) -> np.ndarray:
    """For each set the first one (in order of size) from which confirmed links lead to it.

    Links between sets of the same side >= 0 don't count. A search marks one set in the block's own
    vocabulary and counts the marks in all sets of a fitting size that haven't been reached.
    """
    size = np.array([len(s) for s in sets])
    order = np.argsort(size, kind="stable")
    size, side = size[order], side[order]
    _, flat = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True)
    start = np.append(0, np.cumsum(size))
    marked = np.zeros(int(flat.max()) + 1, dtype=bool)
    free, root = np.ones(len(sets), dtype=bool), np.arange(len(sets))
    for first in range(len(sets)):
        if not free[first]:
            continue
        free[first] = False
        waiting = [first]
        while waiting:
            i = waiting.pop()
            # a pair whose sizes differ by more can't reach the threshold
            low = int(np.searchsorted(size, -(-size[i] * percent // 100), side="left"))
            high = int(np.searchsorted(size, size[i] * 100 // percent, side="right"))
            at = low + np.flatnonzero(free[low:high] & ((side[low:high] != side[i]) | (side[i] < 0)))
            if not len(at):
                continue
            own = flat[start[i] : start[i + 1]]
            marked[own] = True
            ends = np.cumsum(size[at])
            items = np.arange(ends[-1]) + np.repeat(start[at] - np.append(0, ends[:-1]), size[at])
            both = np.add.reduceat(marked[flat[items]], np.append(0, ends[:-1]), dtype=np.int64)
            marked[own] = False
            hit = at[100 * both >= percent * (size[i] + size[at] - both)]
            free[hit], root[hit] = False, first
            waiting.extend(hit.tolist())
    out = np.empty(len(sets), dtype=np.int64)
    out[order] = order[root]
    return out


def _confirm(percent: int):
    """Stars over confirmed links in each block or pair of blocks."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in whole_groups(frames, ["cluster", "left", "right"]):
            out_a, out_b = [], []
            for (_, left, right), g in f.groupby(["cluster", "left", "right"], sort=False):
                if len(g) < 2:
                    continue
                rep = g["rep"].to_numpy()
                sets = [np.frombuffer(x, dtype=np.uint64) for x in g["items"]]
                # between two blocks only pairs across them count; each block has a task of its own
                side = np.full(len(g), -1) if left == right else g["block"].to_numpy()
                root = _reached(sets, side, percent)
                hung = np.flatnonzero(root != np.arange(len(g)))
                out_a.append(rep[hung])
                out_b.append(rep[root[hung]])
            yield pd.DataFrame({"a": np.concatenate(out_a) if out_a else [], "b": np.concatenate(out_b) if out_b else []}).astype("int64")

    return run


def _leaves(classes: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(node, rep) of the nodes to compare, after branching those over LEAF classes; and stars
    (a, b) over the nodes that are over LEAF even at MAX_DEPTH, if there are any."""
    now = classes.select("rep", "sig").mapInPandas(_roots, "rep long, node long")
    parts: list[DataFrame] = []
    large = None
    for depth in range(FIRST_DEPTH, MAX_DEPTH + 1):
        size = written(now, "nodes") if depth == FIRST_DEPTH else now
        shared = size.groupBy("node").agg(F.count("*").alias("n"), F.min("rep").alias("low")).where("n > 1")
        now = written(size.join(shared, "node"), "shared")
        parts.append(now.where(F.col("n") <= LEAF).select("node", "rep"))
        big = now.where(F.col("n") > LEAF)
        if big.isEmpty():
            break
        if depth == MAX_DEPTH:
            large = big.where("rep > low").select(F.col("rep").alias("a"), F.col("low").alias("b")).distinct()
            break
        now = written(big.select("node", "rep").join(classes.select("rep", "sig"), "rep").mapInPandas(_branches, "rep long, node long"), "nodes")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out, large


def _stars(classes: DataFrame, floor: float) -> DataFrame:
    leaves, large = _leaves(classes)
    rows = leaves.join(classes.select("rep", "sig"), "rep").repartition("node").sortWithinPartitions("node", "rep")
    stars = rows.mapInPandas(_compare(floor), "a long, b long")
    return stars if large is None else stars.unionAll(large)


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs(doc_id, text).

    Links are the pairs with 100 * |A and B| >= percent * |A or B|, confirmed on whole sets.
    component_id is the smallest doc_id reachable, kept whether it is the row's own.

    Null or blank texts have no shingles and link with nothing. A row without doc_id takes part
    in no class; its component_id is null and it is kept. Rows that repeat a doc_id with
    different texts join those texts' components. An empty table gives an empty result; columns
    other than doc_id and text are not read.
    """
    spark = docs.sparkSession
    batches_of(spark, 256)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    profiles = written(docs.mapInPandas(_profiles(width), "doc_id long, n_shingles long, set_key binary, sig binary"), "profiles")
    in_class = profiles.where("doc_id is not null and set_key is not null")
    classes = written(in_class.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig"), F.count("*").alias("copies"), F.first("n_shingles").alias("n_shingles")), "classes")

    t = percent / 100
    floor = max(0.0, t - MARGIN * (t * (1 - t) / COORDINATES) ** 0.5)
    groups = written(components(_stars(classes, floor)), "groups")
    bits = bitmap(groups.select("id").mapInPandas(_slots, "slot long"), "slot", REP_BITS)

    wide = groups.join(classes.select(F.col("rep").alias("id"), "n_shingles", "set_key"), "id")
    weight = wide.groupBy("component").agg(F.ceil(F.sum("n_shingles") / F.lit(BLOCK_ITEMS)).cast("int").alias("blocks"))
    placed = wide.join(weight, "component").select(
        F.col("id").alias("rep"), "set_key", F.col("component").alias("cluster"), F.expr("cast(pmod(xxhash64(id), blocks) as int)").alias("block"), "blocks"
    )
    placed = placed.select("rep", "set_key", "cluster", "block", F.explode(F.expr("transform(sequence(0, blocks - 1), x -> struct(least(x, block) as left, greatest(x, block) as right))")).alias("task")).select("rep", "set_key", "cluster", "block", "task.left", "task.right")
    sets = docs.mapInPandas(_sets(width, bits), "rep long, items binary").withColumn("key", F.xxhash64("items"))
    # a repeated doc_id brings several texts; the class's own set is the one meant
    sets = sets.dropDuplicates(["rep", "key"]).drop("key") if _repeats(profiles) else sets.drop("key")
    tasks = placed.drop("set_key").join(sets, "rep").repartition("cluster", "left", "right").sortWithinPartitions("cluster", "left", "right", "rep")
    links = components(tasks.mapInPandas(_confirm(percent), "a long, b long"))

    member = classes.join(links.withColumnRenamed("id", "rep"), "rep", "left").select("set_key", F.coalesce("component", "rep").alias("component_id"), "rep", "copies")
    lone = (F.col("copies") == 1) & (F.col("component_id") == F.col("rep"))
    out = profiles.select("doc_id", "n_shingles", "set_key").join(member.where(~lone).select("set_key", "component_id"), "set_key", "left")
    own = F.col("doc_id")
    return out.select("doc_id", "n_shingles", F.when(own.isNotNull(), F.coalesce("component_id", own)).alias("component_id"), F.when(own.isNull(), True).otherwise(F.coalesce("component_id", own) == own).alias("kept"))


def _repeats(profiles: DataFrame) -> bool:
    """Whether some doc_id occurs twice."""
    return not profiles.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty()


def _may_hold(docs: DataFrame, ids: DataFrame) -> Column:
    """Whether a row's doc_id may be one of ids(id): false is certain. Only doc_id goes to Python,
    and the filter's size is fixed."""
    bits = docs.sparkSession.sparkContext.broadcast(bitmap(ids.mapInPandas(_slots, "slot long"), "slot", REP_BITS))

    @F.pandas_udf("boolean")
    def maybe(ids: pd.Series) -> pd.Series:
        slots = _mixed(ids.fillna(0).to_numpy().astype(np.int64).view(np.uint64)) & np.uint64((1 << REP_BITS) - 1)
        return pd.Series(in_bitmap(bits.value, slots.astype(np.int64)))

    return maybe(docs["doc_id"].cast("long"))


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs without the rows whose doc_id is among ids(id). Rows that stay don't move while the ids
    are few; beyond BROADCAST_IDS only rows that may go are shuffled."""
    ids = written(ids, "dropped")
    match = docs["doc_id"].cast("long") == ids["id"]
    if ids.count() <= BROADCAST_IDS:
        return docs.join(F.broadcast(ids), match, "left_anti")
    maybe = F.coalesce(_may_hold(docs, ids), F.lit(False))
    return docs.where(~maybe).unionByName(docs.where(maybe).join(ids.hint("merge"), match, "left_anti"))


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """docs with one document of each near-duplicate group: the one with the smallest doc_id.

    Rows that repeat a doc_id are documents of their own here: those whose texts differ stay, of
    those whose texts are near-duplicates one stays. Rows without doc_id stay. Columns are those
    of docs; an empty table gives an empty result.
    """
    if not _repeats(docs.select(F.col("doc_id").cast("long").alias("doc_id"))):
        found = near_duplicates(docs, width, percent)
        return _without(docs, found.where("doc_id is not null and not kept").select(F.col("doc_id").alias("id")))
    # ids that occur once each, in the order of doc_id
    text = docs["text"].cast("string")
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["doc_id"].cast("long").alias("own"), text.alias("text"), F.xxhash64(text).alias("h"))
    rows = rows.where("own is not null").repartitionByRange("own", "h").sortWithinPartitions("own", "h", "text")
    named = written(rows.select("row", "text", F.monotonically_increasing_id().alias("doc_id")), "named")
    found = near_duplicates(named.select("doc_id", "text"), width, percent)
    kept = _without(named, found.where("not kept").select(F.col("doc_id").alias("id"))).select("row.*")
    return kept.unionByName(docs.where(docs["doc_id"].isNull()))
