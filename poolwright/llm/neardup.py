"""Near-duplicates by a chosen-path set similarity join.

Texts are sets of hashed five-word shingles; equal sets collapse to one class.
Independent trees branch the classes: a node sends each class on by the
minwise token of its set under one or two functions that the node's path
chooses, 1/threshold of them on average, so a pair at the threshold is
expected to meet in one child of each node that it shares.  Nodes of at most
``NODE`` classes are compared exhaustively by sketches, larger ones branch on.
Pairs whose sketches may reach the threshold are confirmed on the full sets.

Links are looked for twice: first only a spanning forest of each node's likely
pairs, then, between the components so found, all likely pairs, tested within
the node, which gives a spanning forest of the links it finds.  A node that
does not get smaller (a crowd of close copies) is cut into blocks that share a
centre, and after ``DEPTH`` levels into a grid of blocks that covers its pairs;
only pairs across components are then looked at.
"""

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from poolwright.llm import textnp
from poolwright.llm.graph import components, join_by_key
from poolwright.llm.stage import PLACE, materialize, placed, sieved, without

SHINGLE = 5
TREES, NODE, DEPTH = 10, 2048, 10
#: A class counts for as many in a node as its set has times so many shingles,
#: so that the sets of a small node take at most 64 MB; and of the pairs whose
#: sets go to one task.
LONG, TOGETHER = 4096, 4 << 20
SKETCH = 256
#: Sketches may miss a pair at the threshold by chance of 4 standard errors.
ERRORS = 4.0

_random = np.random.RandomState(20240504)
TREE_SEEDS = _random.randint(0, 1 << 64, (2, 2 * TREES), dtype=np.uint64) | np.uint64(1)
SKETCH_SEEDS = _random.randint(0, 1 << 32, (2, SKETCH), dtype=np.uint64).astype(np.uint32) | np.uint32(1)


def root_functions(percent: int) -> list[int]:
    """Functions at the roots: 1/threshold a tree on average."""
    second = round(TREES * (100 / percent - 1))
    return [f for t in range(TREES) for f in ((2 * t, 2 * t + 1) if t < second else (2 * t,))]


def profile(rows: DataFrame, id_col: str, text_col: str, percent: int) -> DataFrame:
    """place, id, n (set size), two digests of the set, root keys and the sketch
    of ``rows`` with their places."""
    functions = root_functions(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.num_rows
            n, digest = np.zeros(rows, np.int64), np.zeros((2, rows), np.uint64)
            keys, sketch = np.zeros((rows, len(functions)), np.uint64), np.zeros((rows, SKETCH), np.uint8)
            for first, last, data, offsets in textnp.chunks(batch.column(3)):
                sets = list(textnp.gram_sets(textnp.words(data, offsets), SHINGLE))
                size = np.array([len(s) for s in sets])
                n[first:last] = size
                full = np.flatnonzero(size)
                if not len(full):
                    continue
                all_, starts, at = np.concatenate(sets), np.concatenate([[0], np.cumsum(size[full])[:-1]]), first + full
                digest[0, at] = np.add.reduceat(textnp.mix(all_), starts)
                digest[1, at] = np.add.reduceat(textnp.mix(all_ ^ TREE_SEEDS[0, 0]), starts)
                for k, f in enumerate(functions):
                    least = np.minimum.reduceat((all_ ^ TREE_SEEDS[0, f]) * TREE_SEEDS[1, f], starts)
                    keys[at, k] = textnp.mix(least ^ np.uint64(f))
                half = (all_ >> np.uint64(32)).astype(np.uint32)
                for k in range(SKETCH):
                    least = np.minimum.reduceat((half ^ SKETCH_SEEDS[0, k]) * SKETCH_SEEDS[1, k], starts)
                    sketch[at, k] = ((least ^ (least >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(24)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * len(functions)), pa.array(keys.view(np.int64).ravel()))
            raw = sketch.tobytes()
            blobs = pa.array([raw[i * SKETCH : (i + 1) * SKETCH] for i in range(rows)], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(n), pa.array(digest[0].view(np.int64)), pa.array(digest[1].view(np.int64)), lists, blobs], [*PLACE, "id", "n", "d1", "d2", "keys", "sketch"])

    taken = rows.select(*PLACE, F.col("_all")[id_col].alias("id"), F.col("_all")[text_col].alias("text"))
    return taken.mapInArrow(run, f"_file long, _row long, id {taken.schema['id'].dataType.simpleString()}, n long, d1 long, d2 long, keys array<long>, sketch binary")


def _sized(nodes: DataFrame) -> DataFrame:
    """``nodes`` (key, cid, n) that have company, with the node's size."""
    sizes = nodes.groupBy("key").agg(F.count("*").alias("many"), F.ceil(F.sum(F.greatest(F.lit(1.0), F.col("n") / F.lit(LONG)))).alias("size"))
    return join_by_key(nodes, sizes.where("many > 1"), "key", how="inner").select("key", "cid", "n", "size")


def _children(percent: int) -> Column:
    """Keys of a class in the children of node ``key``; the path decides on
    which tokens, and on whether there is a second one."""
    h = F.xxhash64("key")
    child = lambda shift: F.xxhash64("key", F.pmod(F.shiftright(h, shift), F.lit(SKETCH)), F.substring("sketch", (F.pmod(F.shiftright(h, shift), F.lit(SKETCH)) + 1).cast("int"), F.lit(1)))
    two = F.pmod(F.shiftright(h, 20), F.lit(10_000)) < round(10_000 * (100 / percent - 1))
    return F.explode(F.when(two, F.array(child(0), child(8))).otherwise(F.array(child(0))))


def branch(classes: DataFrame, percent: int) -> tuple[DataFrame, DataFrame | None]:
    """Small nodes (key, cid), and the grid of blocks of nodes that stay
    large, if any."""
    sketches = classes.select("cid", "sketch")
    members = materialize(_sized(classes.select(F.explode("keys").alias("key"), "cid", "n")))
    small, level = [members.where(F.col("size") <= NODE).select("key", "cid")], 0
    large = members.where(F.col("size") > NODE)
    while not large.isEmpty():
        blocks = F.ceil(F.col("size") / (NODE // 2)).cast("long")
        if level == DEPTH:
            mine = F.pmod(F.xxhash64("cid"), blocks)
            grid = large.select("cid", "key", mine.alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("j"))
            return materialize(reduce(DataFrame.union, small)), grid.select(F.xxhash64("key", F.lit("grid"), F.least("i", "j"), F.greatest("i", "j")).alias("key"), "cid").distinct()
        block = lambda i: F.xxhash64("key", F.lit("block"), i).alias("key")
        centre = materialize(large.groupBy("key").agg(F.min("cid").alias("cid"), F.first("size").alias("size")))
        small.append(large.select(block(F.pmod(F.xxhash64("cid"), blocks)), "cid").union(
            centre.select("key", "cid", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("i")).select(block(F.col("i")), "cid")).distinct())
        members = materialize(_sized(materialize(large.join(sketches, "cid").select(_children(percent).alias("key"), "cid", "n"))))
        small.append(members.where(F.col("size") <= NODE).select("key", "cid"))
        large, level = members.where(F.col("size") > NODE), level + 1
    return materialize(reduce(DataFrame.union, small)), None


def _by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by their first column, in pieces that hold whole keys."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(0).to_numpy(zero_copy_only=False)
        cut = int(np.searchsorted(keys, keys[-1], "left"))
        if cut == 0 and rest and rest[-1].column(0)[-1].as_py() == keys[0]:
            rest.append(batch)
            continue
        if rest or cut:
            yield pa.Table.from_batches([*rest, batch.slice(0, cut)])
        rest = [batch.slice(cut)]
    if rest:
        yield pa.Table.from_batches(rest)


def _alike(sketch: np.ndarray, key: np.ndarray, label: np.ndarray, percent: int) -> np.ndarray:
    """Rows i, j and equal parts of the sketches for all pairs of rows of one
    key and different labels that may reach the threshold."""
    t = percent / 100
    share = t - ERRORS * (t * (1 - t) / SKETCH) ** 0.5
    least = int(np.floor(SKETCH * (share + (1 - share) / 256)))
    found = [np.zeros((3, 0), np.int64)]
    for step in range(1, len(key)):
        at = np.flatnonzero(key[step:] == key[:-step])
        if not len(at):
            break
        at = at[label[at] != label[at + step]]
        for i in range(0, len(at), 4096):
            x = at[i : i + 4096]
            alike = np.count_nonzero(sketch[x] == sketch[x + step], axis=1)
            hit = alike >= least
            if hit.any():
                found.append(np.stack([x[hit], x[hit] + step, alike[hit]]))
    return np.concatenate(found, 1)


def _columns(piece: pa.Table) -> tuple[np.ndarray, ...]:
    """key, cid, label and sketches of some nodes."""
    sketch = np.frombuffer(b"".join(piece.column("sketch").to_pylist()), np.uint8).reshape(-1, SKETCH)
    return (*(piece.column(c).to_numpy() for c in ("key", "cid", "label")), sketch)


def _nodes(rows: DataFrame) -> DataFrame:
    return rows.repartition("key").sortWithinPartitions("key")


def likely_forest(nodes: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """key, a < b: of each node's pairs that may be links a spanning forest,
    the most alike first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in _by_key(batches):
            key, cid, label, sketch = _columns(piece)
            pairs = _alike(sketch, key, label, percent)
            pairs = pairs[:, _forest(pairs, np.arange(len(key)))]
            a, b = cid[pairs[0]], cid[pairs[1]]
            yield pa.RecordBatch.from_arrays([pa.array(key[pairs[0]]), pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["key", "a", "b"])

    rows = nodes.join(classes.select("cid", "sketch"), "cid").withColumn("label", F.col("cid"))
    return _nodes(rows.select("key", "cid", "label", "sketch")).mapInArrow(run, "key long, a long, b long")


def _labelled(nodes: DataFrame, classes: DataFrame, labels: DataFrame) -> DataFrame:
    rows = nodes.join(classes.select("cid", "sketch"), "cid").join(labels, "cid", "left")
    return rows.select("key", "cid", F.coalesce("label", "cid").alias("label"), "sketch")


def crossing(nodes: DataFrame, classes: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """The members (key, cid) of nodes that may have links to members of other
    labels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in _by_key(batches):
            key, cid, label, sketch = _columns(piece)
            rows = np.unique(_alike(sketch, key, label, percent)[:2])
            yield pa.RecordBatch.from_arrays([pa.array(key[rows]), pa.array(cid[rows])], ["key", "cid"])

    return _nodes(_labelled(nodes, classes, labels)).mapInArrow(run, "key long, cid long")


def crossing_links(members: DataFrame, classes: DataFrame, labels: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between members of different labels, confirmed on the full
    sets: of each node a spanning forest over the labels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in _by_key(batches):
            key, cid, label, sketch = _columns(piece)
            pairs = _alike(sketch, key, label, percent)
            group = np.unique(np.stack([key, label]), axis=1, return_inverse=True)[1].ravel()
            sets = [np.frombuffer(x.as_py(), "<u8") for x in piece.column("set")]
            links = pairs[:2, _forest(pairs, group, lambda i, j: is_link(sets[i], sets[j], percent))]
            yield pa.RecordBatch.from_arrays([pa.array(cid[links[0]]), pa.array(cid[links[1]])], ["a", "b"])

    rows = _labelled(members, classes, labels).join(sets, "cid").select("key", "cid", "label", "sketch", "set")
    return _nodes(rows).mapInArrow(run, "a long, b long")


def is_link(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union of two sorted sets."""
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = np.concatenate([x, y])
    both.sort()
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * common >= percent * (len(both) - common)


def _forest(pairs: np.ndarray, group: np.ndarray, test: Callable[[int, int], bool] = lambda i, j: True) -> list[int]:
    """Pairs of a spanning forest over the groups of rows, those with the
    highest third row first, that pass ``test``; joined groups aren't tested."""
    parent = list(range(len(group)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    taken, first, second, group = [], pairs[0].tolist(), pairs[1].tolist(), group.tolist()
    for i in np.argsort(-pairs[2], kind="stable").tolist():
        a, b = root(group[first[i]]), root(group[second[i]])
        if a != b and test(first[i], second[i]):
            parent[b] = a
            taken.append(i)
    return taken


def full_sets(rows: DataFrame, wanted: DataFrame, text_col: str) -> DataFrame:
    """cid, set (sorted 64-bit hashes) of the classes ``wanted`` (cid and the
    place of one of their texts), a written table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textnp.slices(batches, 500):
            blobs = [s.astype("<u8").tobytes() for _, _, data, offsets in textnp.chunks(batch.column(1)) for s in textnp.gram_sets(textnp.words(data, offsets), SHINGLE)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(blobs, pa.binary())], ["cid", "set"])

    texts = sieved(rows, wanted, PLACE)[1].join(wanted, PLACE).select("cid", F.col("_all")[text_col].alias("text"))
    return texts.mapInArrow(run, "cid long, set binary")


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that reach the threshold on the full sets.  Each is
    checked in one node, where each set is sent once; pairs of a node whose
    sets are large are dealt to several tasks."""
    pairs = materialize(pairs.groupBy("a", "b").agg(F.min("key").alias("key")))
    size = sets.select(F.col("cid").alias("a"), F.octet_length("set").alias("size"))
    parts = pairs.join(size, "a").groupBy("key").agg(F.ceil(F.sum("size") / F.lit(8 * TOGETHER)).alias("parts")).where("parts > 1")
    dealt = join_by_key(pairs, parts, "key")
    pairs = materialize(dealt.select(F.when(F.col("parts") > 1, F.xxhash64("key", F.pmod(F.xxhash64("a", "b"), F.col("parts")))).otherwise(F.col("key")).alias("key"), "a", "b"))
    ends = pairs.select("key", F.col("a").alias("cid")).union(pairs.select("key", "b")).distinct().join(sets, "cid")
    rows = ends.select("key", F.col("cid").alias("a"), F.lit(None).cast("long").alias("b"), "set").union(pairs.select("key", "a", "b", F.lit(None).cast("binary")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, {}
        for batch in batches:
            links: list[tuple[int, int]] = []
            for key, a, b, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != at:
                    at, held = key, {}
                if blob is not None:
                    held[a] = np.frombuffer(blob, "<u8")
                elif a in held and b in held:
                    if is_link(held[a], held[b], percent):
                        links.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in links], pa.int64()), pa.array([x[1] for x in links], pa.int64())], ["a", "b"])

    return rows.repartition("key").sortWithinPartitions("key", F.col("b").asc_nulls_first()).mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs``.

    Words are split at ASCII white space, A-Z in lower case.  A text of one to
    four words has one shingle; a null or blank one has none and no links.
    Texts are linked if 100 * intersection >= percent * union of their sets;
    component_id is the smallest id reachable, kept is doc_id = component_id.
    Rows with one id are separate texts; null ids count last and are kept only
    in components without other ids.
    """
    rows = _judged(placed(docs), id_col, text_col, percent)
    return rows.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _judged(docs: DataFrame, id_col: str, text_col: str, percent: int) -> DataFrame:
    """place, doc_id, n_shingles, component_id and ``label``, the component's
    number (null for empty sets), of ``docs`` with their places."""
    texts = materialize(profile(docs, id_col, text_col, percent))
    classes = texts.where("n > 0").groupBy("d1", "d2").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.min(F.struct(*PLACE)).alias("place"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch"))
    # Written once, the numbers stay; no two classes share one, as hashes might.
    classes = materialize(classes.select(F.monotonically_increasing_id().alias("cid"), "d1", "d2", "rep", "n", "place.*", "keys", "sketch"))
    small, grid = branch(classes, percent)
    first = materialize(likely_forest(small, classes, percent))
    reps, places = classes.select("cid", "rep"), classes.select("cid", *PLACE)
    wanted = materialize(places.join(first.select(F.col("a").alias("cid")).union(first.select("b")).distinct(), "cid", "left_semi"))
    sets = materialize(full_sets(docs, wanted, text_col))
    links = materialize(confirm(first, sets, percent))
    labels = materialize(components(links).withColumnRenamed("node", "cid"))
    # A class without a likely pair in the small nodes has links in the grid only.
    nodes = small.join(sets.select("cid"), "cid", "left_semi") if grid is None else small.union(grid)
    marked = materialize(nodes.join(labels, "cid", "left").select("key", "cid", F.coalesce("label", "cid").alias("label")))
    mixed = marked.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("key")
    members = materialize(crossing(join_by_key(marked, mixed, "key", how="inner").select("key", "cid"), classes, labels, percent))
    if grid is not None:
        missing = materialize(places.join(members.select("cid").distinct(), "cid", "left_semi").join(sets, "cid", "left_anti"))
        sets = sets.union(materialize(full_sets(docs, missing, text_col)))
    more = materialize(crossing_links(members, classes, labels, sets, percent))
    if not more.isEmpty():
        labels = materialize(components(links.union(more)).withColumnRenamed("node", "cid"))
    found = reps.join(labels, "cid")
    least = found.groupBy("label").agg(F.min("rep").alias("component_id"))
    found = join_by_key(materialize(found), least, "label", how="inner").select("cid", "label", "component_id")
    of_class = classes.select("cid", "d1", "d2", "rep").join(found, "cid", "left").select("d1", "d2", F.coalesce("component_id", "rep").alias("component_id"), F.coalesce("label", "cid").alias("label"))
    rows = texts.select(*PLACE, F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "d1", "d2")
    full = join_by_key(rows.where("n_shingles > 0"), of_class, ["d1", "d2"]).drop("d1", "d2")
    return full.unionByName(rows.where("n_shingles = 0").drop("d1", "d2").withColumns({"component_id": F.col("doc_id"), "label": F.lit(None).cast("long")}))


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = 80) -> DataFrame:
    """The rows of ``docs``, all columns, of one row in each component: the one
    of the smallest id, null ids last, of repeated ids any one.  Rows without
    words stay."""
    docs = placed(docs)
    judged = materialize(_judged(docs, id_col, text_col, percent).where("label is not null").select("label", "doc_id", *PLACE))
    order = F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", *PLACE)
    first = judged.groupBy("label").agg(F.count("*").alias("many"), F.min(order).alias("first")).where("many > 1").select("label", "first")
    gone = join_by_key(judged, first, "label", how="inner").where(~order.eqNullSafe(F.col("first")))
    return without(docs, materialize(gone.select(*PLACE)))
