"""Removal of repeated byte strings by threshold-bounded interval expansion.

A position is repeated if the ``LENGTH`` bytes from it also start earlier.  To
bring equal strings together, each string of LENGTH bytes names the least hash
among its windows of ``SEED`` bytes; for each place so named, its surroundings
(all strings that name it lie in them) go to that hash.

Equal surroundings collapse: all but the first occurrence are repeated as a
whole.  The first ones of a hash that differ meet in blocks.  Over the suffixes
of a block a Burrows-Wheeler transform is expanded: breadth-first backward
extension of intervals sets the common prefixes of neighbouring suffixes in
the order of their length and stops at LENGTH; suffixes not yet parted then
agree in LENGTH bytes.  A hash with very many surroundings is dealt to several
blocks, whose first strings are then compared by hash across them.  One that a
slice of texts already finds very often is dealt to all tasks from there on.
"""

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from poolwright.llm import textnp
from poolwright.llm.graph import HOT, join_by_key
from poolwright.llm.stage import materialize, same, sieved

LENGTH, SEED = 100, 50
#: Surroundings of one hash that go to a block, and bytes that a block holds.
BLOCK_ROWS, BLOCK_BYTES = 2000, 1 << 18
#: Text bytes whose seeds go to one task of the second step.
PART_BYTES = 16 << 20
#: Surroundings of one hash, and more than the share HOT, that make it dense in a
#: slice of texts: at most so many of each slice go to the hash's own task.
DENSE = 16


def _slide(x: np.ndarray, width: int, least: np.ufunc) -> np.ndarray:
    """Minima or maxima of all windows of ``width``, by doubling."""
    span = 1
    while 2 * span <= width:
        x = least(x[:-span], x[span:])
        span *= 2
    return least(x[: len(x) - (width - span)], x[width - span :]) if width > span else x


class Rolling:
    """Hashes of any byte ranges of a text."""

    def __init__(self, data: np.ndarray):
        power = np.full(len(data) + 1, textnp.BASE, np.uint64)
        power[0] = 1
        self.total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(textnp.BYTE_HASH[data] * np.cumprod(power)[:-1], out=self.total[1:])
        power[1:] = textnp.BASE_INVERSE
        self.inverse = np.cumprod(power)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return textnp.mix((self.total[end] - self.total[start]) * self.inverse[start])


def seeds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, hash, hash of the surroundings, their start and end) of every
    window of SEED bytes that some string of LENGTH bytes names.  Windows with
    equal hashes in one string are all named."""
    if len(data) < LENGTH:
        return tuple(np.zeros(0, t) for t in (np.int64, np.uint64, np.uint64, np.int64, np.int64))
    rolling = Rolling(data)
    at = np.arange(len(data) - SEED + 1)
    hashed = rolling.of(at, at + SEED) | np.uint64(1)
    least = _slide(hashed, LENGTH - SEED + 1, np.minimum)  # of the string that starts there
    text = np.searchsorted(offsets, np.arange(len(least)), "right") - 1
    least[np.arange(len(least)) + LENGTH > offsets[text + 1]] = 0
    pad = np.zeros(LENGTH - SEED, np.uint64)
    named = np.flatnonzero(_slide(np.concatenate([pad, least, pad]), LENGTH - SEED + 1, np.maximum) == hashed)
    text = np.searchsorted(offsets, named, "right") - 1
    start = np.maximum(named - (LENGTH - SEED), offsets[text])
    end = np.minimum(named + LENGTH, offsets[text + 1])
    around = textnp.mix(rolling.of(start, end) + ((named - start) << 8 | (end - start)).astype(np.uint64))
    return text, hashed[named], around, start - offsets[text], end - offsets[text]


def joined(pieces: list[bytes]) -> np.ndarray:
    """The pieces as one text of numbers: bytes from 2 on, 1 between pieces,
    and a single 0 at the end, which makes all suffixes differ."""
    text = np.frombuffer(b"\0".join(pieces) + b"\0", np.uint8).astype(np.uint16) + np.uint16(2)
    text[np.cumsum([len(p) + 1 for p in pieces]) - 1] = 1
    text[-1] = 0
    return text


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of ``text`` in the order of at least their first ``depth``
    numbers, by doubling from keys of seven."""
    n = len(text)
    key = np.zeros(n, np.uint64)
    for i in range(min(7, n)):
        key[: n - i] |= text[i:].astype(np.uint64) << np.uint64(54 - 9 * i)
    size = 7
    while True:
        order = np.argsort(key)
        if size >= depth:
            return order
        sorted_ = key[order]
        rank = np.empty(n, np.uint64)
        rank[order] = np.cumsum(np.concatenate([[True], sorted_[1:] != sorted_[:-1]])).astype(np.uint64)
        key = rank << np.uint64(32)
        key[: max(0, n - size)] |= rank[size:]
        size *= 2


def parted(text: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Of each suffix in order, if fewer than ``depth`` numbers agree with the
    one before: intervals of the transform, breadth-first by length."""
    n = len(text)
    bwt = text[order - 1]
    rows = np.argsort(bwt, kind="stable")  # of the rows, those that each extension leads to
    extend = np.empty(n, np.int32)
    extend[rows] = np.arange(n, dtype=np.int32)
    letter = np.concatenate([bwt[rows].astype(np.int32), [-1]])
    owner = np.full(n + 2, -1, np.int32)  # of row r at r + 1: the interval that reaches it
    cut = np.zeros(n + 1, bool)
    cut[[0, n]] = True
    seen = np.zeros(n, bool)
    low, high = np.array([0], np.int32), np.array([n], np.int32)
    for _ in range(depth):
        size = high - low
        total = int(size.sum())
        if not total:
            break
        mine = np.repeat(np.arange(len(low), dtype=np.int32), size)
        to = extend[np.arange(total, dtype=np.int32) + np.repeat(low - (np.cumsum(size, dtype=np.int32) - size), size)]
        owner[to + 1] = mine
        own = letter[to]
        first = to[(owner[to] != mine) | (letter[to - 1] != own)]
        last = to[(owner[to + 2] != mine) | (letter[to + 1] != own)]
        owner[to + 1] = -1
        low, high = _in_order(first, seen), _in_order(last, seen) + np.int32(1)
        new = ~cut[high]
        cut[high] = True
        low, high = low[new], high[new]
    return cut[:n]


def _in_order(rows: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Distinct rows sorted, by marks in ``seen`` where that is cheaper."""
    if len(rows) * 8 < len(seen):
        return np.sort(rows)
    seen[rows] = True
    out = np.flatnonzero(seen).astype(np.int32)
    seen[rows] = False
    return out


def _codes(rows: pa.RecordBatch | pa.Table) -> np.ndarray:
    """Numbers in the order of (id, sub), null ids last."""
    ids, sub = rows.column("id"), rows.column("sub").to_numpy()
    if isinstance(ids, pa.ChunkedArray):
        ids = ids.combine_chunks()
    coded = ids.dictionary_encode()
    rank = np.empty(len(coded.dictionary) + 1, np.int64)
    rank[pc.sort_indices(coded.dictionary).to_numpy()] = np.arange(len(coded.dictionary))
    rank[-1] = len(coded.dictionary)
    code = rank[pc.fill_null(coded.indices, len(coded.dictionary)).to_numpy(zero_copy_only=False)]
    by = np.lexsort((sub, code))
    out = np.empty(len(by), np.int64)
    out[by] = np.cumsum(np.concatenate([[True], (code[by][1:] != code[by][:-1]) | (sub[by][1:] != sub[by][:-1])])[: len(by)])
    return out


def repeats(pieces: list[bytes], ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(piece, offset, is repeated) of every string of LENGTH bytes that begins
    in one of ``pieces``, which lie at ``starts`` of texts ``ids``.  Of
    equal strings the least (id, place) is not repeated, wherever it occurs."""
    text = joined(pieces)
    size = np.array([len(p) for p in pieces])
    begin = np.cumsum(size + 1) - size - 1
    order = suffix_order(text, LENGTH)
    group = np.empty(len(text), np.int64)
    group[order] = np.cumsum(parted(text, order, LENGTH))
    count = np.maximum(size - LENGTH + 1, 0)
    piece = np.repeat(np.arange(len(pieces)), count)
    offset = np.arange(len(piece)) - np.repeat(np.cumsum(count) - count, count)
    group, text_id, place = group[begin[piece] + offset], ids[piece], starts[piece] + offset
    by = np.lexsort((place, text_id, group))
    g, i, p = group[by], text_id[by], place[by]
    head = np.concatenate([[True], g[1:] != g[:-1]])[: len(by)]
    first = np.flatnonzero(head)[np.cumsum(head) - 1]
    out = np.empty(len(by), bool)
    out[by] = (i != i[first]) | (p != p[first])
    return piece, offset, out


#: A document: its id, and a hash that tells texts of one id (or none) apart.
KEY = ["id", "sub"]


def _documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, sub, text of every row; a null text is empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(F.sha2(text, 256)).alias("sub"), text.alias("text"))


def _later(docs: DataFrame) -> DataFrame:
    """The documents (id, sub), of at least LENGTH bytes, whose whole text is
    that of another one of a smaller id; null ids count last."""
    order = F.struct(F.col("id").isNull().alias("x"), "id")
    stamped = materialize(docs.where(F.octet_length("text") >= LENGTH).select("id", "sub", F.sha2("text", 256).alias("sha")))
    groups = stamped.groupBy("sha").agg(F.min(order).alias("first"), F.count("*").alias("n")).where("n > 1").select("sha", "first")
    return materialize(join_by_key(stamped, groups, "sha", how="inner").where(~order.eqNullSafe(F.col("first"))).select(*KEY).distinct())


ROWS = "known boolean, hot boolean, hash long, around long, id {id}, sub long, start int, stop int"


def _shared(x: np.ndarray) -> np.ndarray:
    """Places of values that occur more than once."""
    order = np.argsort(x)
    same = x[order[1:]] == x[order[:-1]]
    return order[np.concatenate([same, [False]]) | np.concatenate([[False], same])] if len(x) > 1 else order[:0]


def _dense(hashed: np.ndarray) -> np.ndarray:
    """The hashes that are there more than DENSE times, and the share HOT."""
    limit = max(DENSE, HOT * len(hashed))
    bucket = (hashed >> np.uint64(44)).astype(np.int64)
    value, count = np.unique(hashed[np.bincount(bucket)[bucket] > limit], return_counts=True)
    return value[count > limit]


def _seed_rows(parts: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Surroundings to compare; those met before in the slice are known to be
    repeated and go along under a hash of their own.

    Those of a hash that is dense in the slice are hot: each goes under one of
    ``parts`` hashes that its surroundings choose, and a row that is both known
    and hot tells the task of the hash itself that it has not got all."""
    for batch in textnp.slices(batches):
        found = []
        for first, _, data, offsets in textnp.chunks(batch.column(2)):
            text, *rest = seeds(data, offsets)
            found.append((text + first, *rest))
        if not found:
            continue
        text, hashed, around, start, end = (np.concatenate(x) for x in zip(*found, strict=True))
        known, ids = np.zeros(len(around), bool), _codes(batch)
        by = _shared(around)
        by = by[np.lexsort((start[by], ids[text[by]], around[by]))]
        known[by] = _repeated(around[by], ids[text[by]], start[by])
        dense = _dense(hashed[~known])
        hot = np.isin(hashed, dense) & ~known if len(dense) else np.zeros(len(known), bool)
        own = np.where(hot, around % np.uint64(parts), text.astype(np.uint64)) * np.uint64(textnp.BASE)
        names = ["known", "hot", "hash", "around", "id", "sub", "start", "stop"]
        if len(dense):
            zero, none = (pa.array(np.zeros(len(dense), t)) for t in (np.int64, np.int32))
            told = pa.array(np.ones(len(dense), bool))
            yield pa.RecordBatch.from_arrays([told, told, pa.array(dense.view(np.int64)), zero, pa.nulls(len(dense), batch.schema.field(0).type), zero, none, none], names)
        hashed = np.where(known | hot, textnp.mix(hashed + own), hashed)
        yield pa.RecordBatch.from_arrays([pa.array(known), pa.array(hot), pa.array(hashed.view(np.int64)), pa.array(around.view(np.int64)), batch.column(0).take(pa.array(text)), batch.column(1).take(pa.array(text)), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32))], names)


def _repeated(group: np.ndarray, ids: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Of places sorted by group, document and start, if they are another place
    than the first of their group: a row that is there twice is one document."""
    if not len(group):
        return np.zeros(0, bool)
    head = np.concatenate([[True], group[1:] != group[:-1]])
    first = np.flatnonzero(head)[np.cumsum(head) - 1]
    return (ids != ids[first]) | (start != start[first])


def _sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of all rows of some hashes: known and repeated surroundings (blocks 0)
    and, where first ones of a hash differ, these with the number of blocks.
    Hot ones may differ from some elsewhere, so they count as two blocks at least."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    rows = pa.Table.from_batches(held)
    known, hot, hashed = (rows.column(c).to_numpy() for c in ("known", "hot", "hash"))
    told = known & hot
    if told.any():
        hot = hot | (np.isin(hashed, hashed[told]) & ~known)
    pick = np.zeros(len(hashed), bool)
    pick[_shared(hashed)] = True
    taken = np.flatnonzero((pick | known | hot) & ~told)
    rows, hot = rows.take(pa.array(taken)).combine_chunks(), hot[taken]
    if not rows.num_rows:
        return
    known, hashed, around, start = (rows.column(c).to_numpy() for c in ("known", "hash", "around", "start"))
    ids = _codes(rows)
    by = np.lexsort((start, ids, around, hashed, known))
    known, hot, hashed, around = known[by], hot[by], hashed[by], around[by]
    fresh = np.concatenate([[True], hashed[1:] != hashed[:-1]])
    head = fresh | np.concatenate([[True], around[1:] != around[:-1]])
    first = head & ~known
    group = np.cumsum(fresh) - 1
    kinds = np.bincount(group, first)
    blocks = np.where(first, np.maximum(np.ceil(kinds / BLOCK_ROWS)[group], 1 + hot), 0).astype(np.int32)
    again = known | _repeated(np.cumsum(head), ids[by], start[by])
    out = np.flatnonzero(again | (first & (hot | (kinds[group] > 1))))
    taken = rows.take(pa.array(by[out]))
    yield from pa.table({"blocks": pa.array(blocks[out]), "hash": taken.column("hash"), "id": taken.column("id"), "sub": taken.column("sub"), "start": taken.column("start"), "stop": taken.column("stop")}).to_batches(max_chunksize=100_000)


def _expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (block, blocks, id, sub, start, piece) sorted by block, in runs of whole
    blocks: spans of repeated strings, and from blocks of a shared hash the
    first strings with their hashes."""

    def solve(rows: pa.Table) -> pa.RecordBatch:
        pieces, starts = rows.column("piece").to_pylist(), rows.column("start").to_numpy().astype(np.int64)
        piece, offset, again = repeats(pieces, _codes(rows), starts)
        edge = np.concatenate([[True], (piece[1:] != piece[:-1]) | ~again[:-1]])[: len(piece)]
        head = np.flatnonzero(again & edge)
        tail = np.flatnonzero(again & np.concatenate([edge[1:] | ~again[1:], [True]])[: len(piece)])
        shared = rows.column("blocks").to_numpy()[piece] > 1
        lone = np.flatnonzero(~again & shared)
        hashes = np.zeros(0, np.uint64)
        if len(lone):
            data = np.frombuffer(b"".join(pieces), np.uint8)
            size = np.array([len(p) for p in pieces])
            at = (np.cumsum(size) - size)[piece[lone]] + offset[lone]
            hashes = Rolling(data).of(at, at + LENGTH)
        which = np.concatenate([piece[head], piece[lone]])
        begin = np.concatenate([starts[piece[head]] + offset[head], starts[piece[lone]] + offset[lone]])
        stop = np.concatenate([starts[piece[tail]] + offset[tail] + LENGTH, starts[piece[lone]] + offset[lone] + LENGTH])
        string = pa.array(np.concatenate([np.zeros(len(head), np.int64), hashes.view(np.int64)]), mask=np.arange(len(which)) < len(head))
        return pa.RecordBatch.from_arrays([*(rows.column(c).combine_chunks().take(pa.array(which)) for c in KEY), pa.array(begin.astype(np.int32)), pa.array(stop.astype(np.int32)), string], [*KEY, "start", "stop", "string"])

    held: list[pa.RecordBatch] = []
    size, at = 0, None
    for batch in batches:
        block = batch.column(0).to_numpy()
        ends = [*(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist(), batch.num_rows]
        a = 0
        for b in ends:
            if held and size >= BLOCK_BYTES and block[a] != at:
                yield solve(pa.Table.from_batches(held))
                held, size = [], 0
            held.append(batch.slice(a, b - a))
            size, at, a = size + held[-1].column(5).nbytes, block[b - 1] if b > a else at, b
    if held:
        yield solve(pa.Table.from_batches(held))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, sub, text, spots) as one row for each spot, with its bytes."""
    for batch in textnp.slices(batches):
        which, pieces, rows = [], [], []
        for i, (text, found) in enumerate(zip(batch.column(2), batch.column(3).to_pylist(), strict=True)):
            data = text.as_py().encode()
            for spot in found:
                which.append(i)
                rows.append((spot["hash"], spot["blocks"], spot["start"]))
                pieces.append(data[spot["start"] : spot["stop"]])
        of = pa.array(which, pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), batch.column(0).take(of), batch.column(1).take(of), pa.array([r[2] for r in rows], pa.int32()), pa.array(pieces, pa.binary())], ["hash", "blocks", *KEY, "start", "piece"])


def repeated_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(id, sub, start, stop) in bytes of strings, or runs of them, that also
    start earlier, overlapping and in no order; and (id, sub) of whole texts that
    do.  Both tell documents by ``KEY``, as ``remove_repeats`` says."""
    kind = docs.schema[id_col].dataType.simpleString()
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    docs = _documents(docs, id_col, text_col)
    later = _later(docs)
    clean, may = sieved(docs.where(F.octet_length("text") >= LENGTH), later, KEY)
    texts = clean.union(may.join(later, same(may, later, KEY), "left_anti"))
    parts = max(docs.sparkSession.sparkContext.defaultParallelism, -(-size // PART_BYTES))
    rows = texts.select(*KEY, "text").mapInArrow(partial(_seed_rows, parts), ROWS.format(id=kind)).repartition(parts, "hash")
    sifted = materialize(rows.mapInArrow(_sift, f"blocks int, hash long, id {kind}, sub long, start int, stop int"))
    spots = materialize(sifted.where("blocks > 0").groupBy(*KEY).agg(F.collect_list(F.struct("hash", "blocks", "start", "stop")).alias("spots")))
    held = sieved(docs, spots, KEY)[1]
    pieces = held.join(spots, same(held, spots, KEY)).select(held["id"], held["sub"], "text", "spots").mapInArrow(_cut, f"hash long, blocks int, id {kind}, sub long, start int, piece binary")
    block = F.when(F.col("blocks") > 1, F.xxhash64("hash", F.pmod(F.xxhash64(*KEY, "start"), F.col("blocks")))).otherwise(F.col("hash"))
    pieces = pieces.select(block.alias("block"), "blocks", *KEY, "start", "piece").repartition(parts, "block").sortWithinPartitions("block")
    expanded = materialize(pieces.mapInArrow(_expand, f"id {kind}, sub long, start int, stop int, string long"))
    shared = expanded.where("string is not null")
    place = F.struct(F.col("id").isNull().alias("x"), *KEY, "start")
    least = shared.groupBy("string").agg(F.min(place).alias("least"), F.max(place).alias("most")).where("least <> most").select("string", "least")
    more = join_by_key(shared, least, "string", how="inner").where(~place.eqNullSafe(F.col("least")))
    span = [*KEY, "start", "stop"]
    spans = sifted.where("blocks = 0").select(span).union(expanded.where("string is null").select(span)).union(more.select(span))
    return spans, later


def _merged(data: bytes, spans: list) -> tuple[int, int, bytes]:
    """Bytes removed, maximal runs of them, and what is left."""
    removed, runs, at, left = 0, 0, 0, []
    last = -1
    for start, stop in sorted(spans):
        if start > last:
            left.append(data[at:start])
            runs += 1
            at = start
        if stop > at:
            removed += stop - at
            at = stop
        last = max(last, stop)
    left.append(data[at:])
    return removed, runs, b"".join(left)


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the bytes left), kept_sha256
    for every row; a null text is empty.

    A document is an id and a text: rows that repeat both are one document, each
    with its result, and rows that share an id but not the text are documents
    in the order of a hash of their texts.  Null ids come last, and rows without
    an id are documents by their texts.  An earlier place is one in an earlier
    document, or further left in the same one.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    spans, later = repeated_spans(docs, id_col=id_col, text_col=text_col)
    listed = spans.select(*KEY, F.lit(False).alias("late"), F.struct("start", "stop").alias("span")).union(later.select(*KEY, F.lit(True), F.lit(None).cast("struct<start:int,stop:int>")))
    listed = materialize(listed.groupBy(*KEY).agg(F.max("late").alias("late"), F.collect_set("span").alias("spans")))
    size, none = F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long")
    plain, may = sieved(_documents(docs, id_col, text_col), listed, KEY)
    plain = plain.select("id", size, none.alias("n_removed"), none.alias("n_spans"), F.col("text").cast("binary").alias("kept"))
    held = may.join(listed, same(may, listed, KEY), "left").select(may["id"], "text", F.coalesce("late", F.lit(False)).alias("late"), F.coalesce("spans", F.array().cast("array<struct<start:int,stop:int>>")).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textnp.slices(batches):
            texts = [t.as_py().encode() for t in batch.column(1)]
            out = [(len(t), 1, b"") if late else _merged(t, [(s["start"], s["stop"]) for s in x]) for t, late, x in zip(texts, batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, texts), pa.int64()), pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.binary())], ["id", "n_bytes", "n_removed", "n_spans", "kept"])

    out = plain.union(held.mapInArrow(run, f"id {kind}, n_bytes long, n_removed long, n_spans long, kept binary"))
    return out.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept", F.sha2("kept", 256).alias("kept_sha256"))
