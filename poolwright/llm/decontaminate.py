"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

From each word of an item the shortest run of words that chance would produce
at most ``CHANCE`` times in the whole corpus, and that few items share, is a seed; chance is judged by the
corpus counts of the words, not of the run, so a leaked passage cannot hide by
being copied often.  Where a text has seeds of an item, the words around them
are aligned with the item's words, and the score of the best local alignment
is set against that of an exact copy, of the item or of the words it spans.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from poolwright.llm import textnp
from poolwright.llm.stage import frugal

CHANCE, SHORTEST, LONGEST = 1.0, 2, 8
#: A run that more items share is made longer, as far as ``LONGEST``.
ITEMS = 4
MATCH, MISMATCH, GAP = 2, -1, -1
#: An alignment of the score of so many copied words counts in items of any
#: length, if it has the least share of the score of a copy of its own span.
ENOUGH = 25
#: Items go to the tasks in blocks of at most so many words.
BLOCK_WORDS = 200_000
FILTER_BITS = 22


def blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[int, np.ndarray]]]:
    """Items with words (id, word hashes), as bounded blocks."""
    block, held = [], 0
    for r in items.select(id_col, text_col).where(f"`{id_col}` is not null").orderBy(id_col, text_col).toLocalIterator():
        data = np.frombuffer((r[1] or "").encode(), np.uint8)
        hashes = textnp.words(data, np.array([0, len(data)])).hash
        if len(hashes):
            block.append((r[0], hashes))
            held += len(hashes)
        if held >= BLOCK_WORDS:
            yield block
            block, held = [], 0
    if block:
        yield block


def word_counts(docs: DataFrame, text_col: str, vocabulary: np.ndarray) -> tuple[int, np.ndarray]:
    """All words of the corpus, and the counts of the block's words in it."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(len(vocabulary) + 1, np.int64)
        for batch in batches:
            for _, _, data, offsets in textnp.chunks(batch.column(0)):
                hashes = textnp.words(data, offsets).hash
                at = np.searchsorted(vocabulary, hashes)
                at[at == len(vocabulary)] = 0
                sums[:-1] += np.bincount(at[vocabulary[at] == hashes], minlength=len(vocabulary))
                sums[-1] += len(hashes)
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(sums[some])], ["word", "n"])

    sums = np.zeros(len(vocabulary) + 1, np.int64)
    for r in docs.select(text_col).mapInArrow(count, "word long, n long").groupBy("word").sum("n").collect():
        sums[r[0]] = r[1]
    return int(sums[-1]), sums[:-1]


class Seeds:
    """Seeds of a block by length: sorted hashes with item and word offset,
    and a bit table that most other windows miss."""

    def __init__(self, block: list[tuple[int, np.ndarray]], total: int, vocabulary: np.ndarray, counts: np.ndarray):
        words, sizes = np.concatenate([h for _, h in block]), np.array([len(h) for _, h in block])
        item = np.repeat(np.arange(len(block)), sizes)
        place = np.arange(len(words)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        logs = np.log(np.maximum(counts[np.searchsorted(vocabulary, words)], 0.5) / max(total, 1))
        sums = np.concatenate([[0.0], np.cumsum(logs)])
        rows: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        left = np.ones(len(words), bool)  # places without a seed
        for n in range(1, LONGEST + 1):
            at = np.flatnonzero(left[: max(0, len(words) - n + 1)])
            at = at[(place[at] + n <= sizes[item[at]]) & (n >= np.minimum(SHORTEST, sizes[item[at]]))]
            if not len(at):
                continue
            grams = textnp.grams(words, n)
            # Of all items that hold the run, wherever it is a seed or not.
            whole = np.flatnonzero(place[: len(grams)] + n <= sizes[item[: len(grams)]])
            distinct, items = np.unique(np.unique(np.stack([grams[whole], item[whole].astype(np.uint64)], 1), axis=0)[:, 0], return_counts=True)
            rare = np.log(max(total, 1)) + sums[at + n] - sums[at] <= np.log(CHANCE)
            few = items[np.searchsorted(distinct, grams[at])] <= ITEMS
            take = at[(rare & few) | (n == np.minimum(LONGEST, sizes[item[at]]))]
            left[take] = False
            if len(take):
                rows[n] = (grams[take], item[take], place[take])
        self.table = {}
        for n, (hashes, items, places) in rows.items():
            by = np.lexsort((places, items, hashes))
            bits = np.zeros(1 << FILTER_BITS, bool)
            bits[hashes >> np.uint64(64 - FILTER_BITS)] = True
            self.table[n] = (hashes[by], items[by], places[by], bits)

    def hits(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word, item, word of the item) of each seed among the words."""
        out = [np.zeros((3, 0), np.int64)]
        for n, (sought, item, offset, bits) in self.table.items():
            grams = textnp.grams(hashes, n)
            at = np.flatnonzero(bits[grams >> np.uint64(64 - FILTER_BITS)])
            lo, hi = np.searchsorted(sought, grams[at], "left"), np.searchsorted(sought, grams[at], "right")
            size = hi - lo
            k = np.repeat(lo, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            out.append(np.stack([np.repeat(at, size), item[k], offset[k]]))
        return tuple(np.concatenate(out, 1))


def align(text: np.ndarray, item: np.ndarray) -> tuple[int, int, int]:
    """Score of the best local alignment and its span [start, end) in ``text``;
    the first end of equal scores."""
    steps = -GAP * np.arange(len(text) + 1)
    table = np.zeros((len(item) + 1, len(text) + 1), np.int32)
    for i, word in enumerate(item):
        row = table[i + 1]
        row[1:] = np.maximum(table[i, :-1] + np.where(text == word, MATCH, MISMATCH), np.maximum(table[i, 1:] + GAP, 0))
        row[:] = np.maximum.accumulate(row + steps) - steps
    j, i = np.unravel_index(int(np.argmax(table.T)), table.T.shape)
    best, end = int(table[i, j]), int(j)
    while table[i, j] > 0:
        if i and j and table[i, j] == table[i - 1, j - 1] + (MATCH if text[j - 1] == item[i - 1] else MISMATCH):
            i, j = i - 1, j - 1
        elif i and table[i, j] == table[i - 1, j] + GAP:
            i -= 1
        else:
            j -= 1
    return best, int(j), end


def _leaks(w: textnp.Words, seeds: Seeds, block: list[tuple[int, np.ndarray]], least: float) -> Iterator[tuple[int, int, int, int, int]]:
    """(text, item, score, start word, end word) of the best alignment of each
    text and item that scores at least ``least`` of an exact copy, or as
    ``ENOUGH`` words and ``least`` of a copy of its span."""
    word, item, offset = seeds.hits(w.hash)
    text = np.searchsorted(w.bounds, word, "right") - 1
    order = np.lexsort((word, item, text))
    word, item, offset, text = word[order], item[order], offset[order], text[order]
    if not len(word):
        return
    long = np.array([len(h) for _, h in block])
    fresh = np.ones(len(word), bool)
    fresh[1:] = (text[1:] != text[:-1]) | (item[1:] != item[:-1]) | (word[1:] - word[:-1] > 2 * long[item[1:]])
    starts = np.flatnonzero(fresh)
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(word)], strict=True):
        d, t, n = int(text[a]), int(item[a]), int(long[item[a]])
        lo, hi = max(int(w.bounds[d]), int(word[a]) - 2 * n), min(int(w.bounds[d + 1]), int(word[b - 1]) + 2 * n)
        for at in range(lo, max(lo + 1, hi), 16 * n):  # long clusters in pieces that overlap by more than an alignment spans
            score, start, end = align(w.hash[at : min(hi, at + 20 * n)], block[t][1])
            long_enough = score >= MATCH * ENOUGH and score >= least * MATCH * (end - start)
            if (score >= least * MATCH * n or long_enough) and (-score, at + start) < best.get((d, t), (1, 0, 0)):
                best[d, t] = (-score, at + start, at + end)
    for (d, t), (score, start, end) in best.items():
        yield d, t, -score, start - int(w.bounds[d]), end - int(w.bounds[d])


def find_leaks(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", least: float = 0.4) -> DataFrame:
    """doc_id, item_id, score, full_score (of an exact copy), start_word,
    end_word for each document and item with a score of at least the share
    ``least`` of the full one, or with the score of ``ENOUGH`` words and that
    share of a copy of its span; of equal ones the first place in the text.

    Null or empty texts and items, and items with a null id, match nothing;
    repeated rows of documents each give theirs, items that repeat an id each
    theirs.  Other columns are dropped, whatever their names.  Benchmark blocks
    are of bounded size and pass over the whole corpus one by one.
    """
    spark: SparkSession = docs.sparkSession
    schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}, item_id {items.schema[item_col].dataType.simpleString()}, score long, full_score long, start_word long, end_word long"
    out = spark.createDataFrame([], schema)
    for i, block in enumerate(blocks(items, item_col, item_text_col)):
        seeds = seeds_of(docs, text_col, block)

        def scan(batches: Iterator[pa.RecordBatch], block=block, seeds=seeds) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = []
                for first, _, data, offsets in textnp.chunks(batch.column(1)):
                    rows += [(first + d, block[t][0], score, MATCH * len(block[t][1]), a, b) for d, t, score, a, b in _leaks(textnp.words(data, offsets), seeds, block, least)]
                ids = batch.column(0).take(pa.array([r[0] for r in rows], pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array([r[k] for r in rows], pa.int64()) for k in range(1, 6))], ["doc_id", "item_id", "score", "full_score", "start_word", "end_word"])

        found = docs.select(id_col, text_col).mapInArrow(scan, schema)
        out = found if i == 0 else out.unionByName(found)
    return out


def seeds_of(docs: DataFrame, text_col: str, block: list[tuple[int, np.ndarray]]) -> Seeds:
    frugal(docs.sparkSession)
    vocabulary = np.unique(np.concatenate([h for _, h in block]))
    total, counts = word_counts(docs, text_col, vocabulary)
    return Seeds(block, total, vocabulary, counts)


def drop_leaks(docs: DataFrame, items: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", least: float = 0.4) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no item of the benchmark.
    Chance is judged by all of ``docs`` for every block."""
    place, corpus = docs.columns.index(text_col), docs
    for block in blocks(items, item_col, item_text_col):
        seeds = seeds_of(corpus, text_col, block)

        def clean(batches: Iterator[pa.RecordBatch], block=block, seeds=seeds) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for first, _, data, offsets in textnp.chunks(batch.column(place)):
                    for d, *_ in _leaks(textnp.words(data, offsets), seeds, block, least):
                        keep[first + d] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs
