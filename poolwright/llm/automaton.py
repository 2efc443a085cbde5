"""Language-model scoring with a weighted backoff automaton.

States are contexts: the root and each run of up to ``order`` - 1 words.  A word
seen after its context in training has an arc there; any other word takes the
state's failure arc to the state u' of the context without its first word, in
the end to the root, which has an arc for every word.  With c the training
counts, N and V the number of tokens and of distinct ones, and K a weight,

    root arc        p(w)   = (c(w) + 0.5) / (N + 0.5 (V + 1))
    arc of state u  p(w|u) = (c(u w) + K p(w|u')) / (c(u) + K)
    failure arc of u         K / (c(u) + K)

which sums to one over the words of training and one unseen word.  A text is
read left to right; the state is the last words, from the text's begin on, and
the logarithms add up.

The automaton grows with the corpus and is never in one place.  Texts go in
batches; a batch sends its distinct runs of words with their counts to the parts
that own them, and a part tells each batch how often the others have them.  A
run of three words or more is asked for only if both runs of one word less are
in another batch too, and in training texts.  The batch then builds the states and arcs that its texts
can take and walks them.
"""

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from poolwright.llm import textnp
from poolwright.llm.stage import frugal

#: Text bytes of a batch, batches per part of the automaton, tokens that a text
#: is walked in one go, and K for states of one word, two, and so on.
BATCH_BYTES, BATCHES_A_PART, STRETCH, K = 8 << 20, 2, 256, (200.0, 10.0)
END, BEGIN = (textnp.mix(np.array([2**64 - 2, 2**64 - 3], np.uint64)) | np.uint64(1)).tolist()
#: Runs of two words or more are told apart by 56 bits, words by 64.
RUN_BITS = np.uint64(8)


def _pack(x: np.ndarray, kind: str) -> bytes:
    """Little-endian numbers by byte planes: sorted hashes and small counts
    then compress well on their way."""
    x = np.ascontiguousarray(x.astype(kind))
    if not len(x):
        return bytes(8)
    return len(x).to_bytes(8, "little") + pa.compress(x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes(), "zstd", asbytes=True)


def _unpack(blob: bytes, kind: str) -> np.ndarray:
    n, width = int.from_bytes(blob[:8], "little"), np.dtype(kind).itemsize
    if not n:
        return np.zeros(0, kind)
    planes = pa.decompress(blob[8:], n * width, "zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(width, -1).T).view(kind).ravel()


def _batches(size: int, rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, held_out, text) as packed batches of about ``size`` bytes,
    with a number that a second run of the task gives again."""
    held, bytes_, number = [], 0, TaskContext.get().partitionId() << 32

    def packed() -> pa.RecordBatch:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            for x in held:
                out.write_batch(x)
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["batch", "blob"])

    for some in rows:
        for row in textnp.slices(iter([some]), 200):
            held.append(row)
            bytes_ += row.column(2).nbytes
            if bytes_ >= size:
                yield packed()
                held, bytes_, number = [], 0, number + 1
    if sum(x.num_rows for x in held):
        yield packed()


def _opened(batch: pa.Table) -> pa.Table:
    return pa.ipc.open_stream(batch.column("blob")[0].as_buffer()).read_all()


class Tokens:
    """The tokens of a batch of texts: words and an end each.  By length k from
    1: where the runs of k tokens end (``at``; a run may start with the text's
    begin), the distinct ones in hash order, the place of each among them, and
    by distinct run its own count in training (``own``)."""

    def __init__(self, batch: pa.Table, order: int):
        runs, sizes = [], []
        for _, _, data, offsets in textnp.chunks(batch.column("text")):
            w = textnp.words(data, offsets)
            runs.append(np.insert(w.hash, w.bounds[1:], np.uint64(END)))
            sizes.append(np.diff(w.bounds) + 1)
        token = np.concatenate(runs)
        self.sizes = np.concatenate(sizes)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)[:-1]])
        train = np.repeat(~batch.column("held_out").to_numpy(), self.sizes).astype(np.float64)
        place = np.arange(len(token)) - np.repeat(self.starts, self.sizes)
        self.at, self.distinct, self.inverse, self.first, self.own = [], [], [], [], []
        gram = token
        for k in range(1, order + 1):
            if k > 1:
                before = np.empty_like(gram)
                before[1:] = gram[:-1]
                if k == 2:
                    before[self.starts] = np.uint64(BEGIN)
                gram = textnp.mix(before * textnp.GRAM_HASH[0] + token * textnp.GRAM_HASH[1]) >> RUN_BITS
            at = np.flatnonzero(place >= k - 2)
            distinct, first, inverse = np.unique(gram[at], return_index=True, return_inverse=True)
            self.at.append(at)
            self.distinct.append(distinct)
            self.first.append(at[first])
            row = np.full(len(token), -1, np.int32)
            row[at] = inverse
            self.inverse.append(row)
            self.own.append(np.bincount(inverse, train[at], len(distinct)))

    def cuts(self, k: int, wanted: np.ndarray, parts: int) -> np.ndarray:
        """Where the hash ranges of the parts begin among wanted runs of k + 1 words."""
        top = self.distinct[k][wanted] >> (np.uint64(32) if k == 0 else np.uint64(32) - RUN_BITS)
        return np.searchsorted((top * np.uint64(parts)) >> np.uint64(32), np.arange(parts + 1, dtype=np.uint64))

    def wanted(self, k: int, elsewhere: list[np.ndarray]) -> np.ndarray:
        """The distinct runs of k + 1 words that another batch may have, where
        one of the two may train on them."""
        if k < 2:
            return np.arange(len(self.distinct[k]))
        both = lambda x: x[self.inverse[k - 1][self.first[k] - 1]] & x[self.inverse[k - 1][self.first[k]]]
        return np.flatnonzero(both(elsewhere[k - 1] % 2 > 0) & ((self.own[k] > 0) | both(elsewhere[k - 1] > 1)))


def _rounds(order: int) -> list[list[int]]:
    """Words and pairs are asked for at once, each longer run after the last."""
    return [list(range(min(order, 2))), *([k] for k in range(2, order))]


def _elsewhere(t: Tokens, told: pa.Table, rounds: list[list[int]]) -> list[np.ndarray]:
    """Of the runs told so far, by distinct run: twice the count in other batches,
    and 1 more if another batch has asked for it."""
    out: list[np.ndarray] = []
    for number, lengths in enumerate(rounds):
        mine = told.filter(pa.compute.equal(told.column("round"), number)).sort_by("part")
        for i, k in enumerate(lengths):
            counts, wanted = np.zeros(len(t.distinct[k]), np.int64), t.wanted(k, out)
            counts[wanted] = np.concatenate([_unpack(x, "<u8") for x in mine.column(f"sums{i}").to_pylist()])
            out.append(counts)
    return out


def _requests(batch: pa.Table, told: pa.Table | None, parts: int, rounds: list[list[int]]) -> pa.Table:
    """The last of ``rounds``: a row for each part with runs and counts."""
    number, lengths = batch.column("batch")[0].as_py(), rounds[-1]
    t = Tokens(_opened(batch), max(lengths) + 1)
    elsewhere = _elsewhere(t, told, rounds[:-1]) if told is not None else []
    rows: dict[str, list[bytes]] = {}
    for i in range(2):
        wanted = t.wanted(lengths[i], elsewhere) if i < len(lengths) else np.zeros(0, np.int64)
        k = lengths[min(i, len(lengths) - 1)]
        cuts = t.cuts(k, wanted, parts)
        spans = list(zip(cuts[:-1], cuts[1:], strict=True))
        rows[f"runs{i}"] = [_pack(t.distinct[k][wanted[a:b]], "<u8") for a, b in spans]
        rows[f"own{i}"] = [_pack(t.own[k][wanted[a:b]], "<u4") for a, b in spans]
    return pa.table({"part": pa.array(range(parts), pa.int64()), "batch": pa.array([number] * parts, pa.int64()), **{k: pa.array(v, pa.binary()) for k, v in rows.items()}})


def _replies(rows: pa.Table, number: int) -> pa.Table:
    """What ``_elsewhere`` says, in the order in which each batch asked, and of
    the part's words the sum and the number of those with a count."""
    out, n, v = {}, 0, 0
    for i in range(2):
        asked = [_unpack(x, "<u8") for x in rows.column(f"runs{i}").to_pylist()]
        own = np.concatenate([_unpack(x, "<u4") for x in rows.column(f"own{i}").to_pylist()]).astype(np.int64)
        distinct, inverse = np.unique(np.concatenate(asked), return_inverse=True)
        sums = np.bincount(inverse, own, len(distinct)).astype(np.int64)
        if i == 0:
            n, v = int(sums.sum()), int(np.count_nonzero(sums))
        at = np.cumsum([0, *map(len, asked)])
        others = 2 * (sums[inverse] - own) + (np.bincount(inverse, minlength=len(distinct)) > 1)[inverse]
        out[f"sums{i}"] = pa.array([_pack(others[a:b], "<u8") for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())
    many = rows.num_rows
    return pa.table({"round": pa.array([number] * many, pa.int64()), "batch": rows.column("batch"), "part": rows.column("part"), **out, "n": pa.array([n] * many), "v": pa.array([v] * many)})


class Automaton(NamedTuple):
    """Arcs sorted by ``key`` (state * words + word), with their log10 weight and
    the state they lead to; by state the failure arc.  State 0 is the root,
    which has an arc for every word, state 1 the begin of a text."""

    words: int
    key: np.ndarray
    weight: np.ndarray
    target: np.ndarray
    fail_weight: np.ndarray
    fail_target: np.ndarray


def build(t: Tokens, counts: list[np.ndarray], n: int, v: int, weights: tuple[float, ...]) -> Automaton:
    """States and arcs of all runs of the batch that training has."""
    order, words = len(counts), len(t.distinct[0])
    weigh = lambda k: weights[min(k, len(weights)) - 1]  # noqa: E731 - of states of k words
    begins = float(counts[0][np.searchsorted(t.distinct[0], np.uint64(END))])  # as many texts begin as end
    state_count = [np.array([float(n), begins])]
    log_p = np.log10((counts[0] + 0.5) / (n + 0.5 * (v + 1)))
    keys, costs, targets = [np.arange(words)], [log_p], []
    number, fails, leads = 2, [np.array([0, 0])], []
    for k in range(order):  # runs of k + 1 words
        seen, below = counts[k] > 0, leads[-1][t.inverse[k - 1][t.first[k]]] if k else np.zeros(words, np.int64)
        if k:
            before = t.inverse[k - 1][t.first[k] - 1]
            source = leads[-1][before]
            if k == 1:
                source[np.isin(t.first[1], t.starts)] = 1
            held = np.concatenate(state_count)[source]
            lower, k_ = log_p[t.inverse[k - 1][t.first[k]]], weigh(k)
            log_p = np.log10((counts[k] + k_ * 10.0**lower) / (held + k_))
            keys.append(source[seen] * words + t.inverse[0][t.first[k]][seen])
            costs.append(log_p[seen])
        lead = below.copy()
        if k < order - 1:
            lead[seen] = number + np.arange(np.count_nonzero(seen))
            number += np.count_nonzero(seen)
            state_count.append(counts[k][seen])
            fails.append(below[seen])
        targets.append(lead[seen] if k else lead)
        leads.append(lead)
    key, cost, target = (np.concatenate(x) for x in (keys, costs, targets))
    by = np.argsort(key)
    length = np.repeat(np.arange(len(state_count)), [len(x) for x in state_count])
    k_ = np.array([weigh(max(1, x)) for x in range(len(state_count))])[length]
    return Automaton(words, key[by], cost[by], target[by], np.log10(k_ / (np.concatenate(state_count) + k_)), np.concatenate(fails))


def walk(a: Automaton, word: np.ndarray, starts: np.ndarray, sizes: np.ndarray, order: int) -> np.ndarray:
    """The log10 weight of every token: texts are read from left to right, all
    at once, each with its state.  A long text is read in stretches; each starts
    ``order`` - 1 words early, after which its state is that of the whole text."""
    stretches = -(-sizes // STRETCH)
    text = np.repeat(np.arange(len(starts)), stretches)
    begin = starts[text] + STRETCH * (np.arange(len(text)) - np.repeat(np.cumsum(stretches) - stretches, stretches))
    end, at = np.minimum(begin + STRETCH, (starts + sizes)[text]), np.maximum(begin - (order - 1), starts[text])
    by = np.argsort(at - end, kind="stable")
    begin, end, at, text = begin[by], end[by], at[by], text[by]
    state = np.where((at == starts[text]) & (order > 1), 1, 0)
    left, out = end - at, np.zeros(len(word))
    for step in range(int(left[0]) if len(left) else 0):
        live = int(np.searchsorted(-left, -step, "left"))
        here = at[:live] + step
        now, cost, todo = state[:live], np.zeros(live), np.arange(live)
        while len(todo):
            key = now[todo] * a.words + word[here[todo]]
            arc = np.minimum(np.searchsorted(a.key, key), len(a.key) - 1)
            hit = a.key[arc] == key
            cost[todo[hit]] += a.weight[arc[hit]]
            now[todo[hit]] = a.target[arc[hit]]
            todo = todo[~hit]
            cost[todo] += a.fail_weight[now[todo]]
            now[todo] = a.fail_target[now[todo]]
        read = here >= begin[:live]
        out[here[read]] = cost[read]
    return out


def _score(batch: pa.Table, told: pa.Table, weights: tuple[float, ...], order: int) -> pa.Table:
    batch = _opened(batch)
    t = Tokens(batch, order)
    counts = [x + y // 2 for x, y in zip(t.own, _elsewhere(t, told, _rounds(order)), strict=True)]
    first = told.filter(pa.compute.equal(told.column("round"), 0))
    n, v = sum(first.column("n").to_pylist()), sum(first.column("v").to_pylist())
    word = t.inverse[0]
    root = np.log10((counts[0] + 0.5) / (n + 0.5 * (v + 1)))[word]
    steps = walk(build(t, counts, n, v, weights), word, t.starts, t.sizes, order)
    add = lambda x: pa.array(np.add.reduceat(x, t.starts))
    return pa.table({
        "doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "n_tokens": pa.array(t.sizes),
        "n_known": add((counts[0][word] > 0).astype(np.int64)), "train_tokens": pa.array(np.full(len(t.sizes), n, np.int64)),
        "base_score": add(root), "score": add(steps),
    })


def _round(dealt: DataFrame, told: DataFrame | None, batches: int, parts: int, rounds: list[list[int]]) -> DataFrame:
    """``told`` and the replies of the last of ``rounds``."""
    schema = "part long, batch long, runs0 binary, own0 binary, runs1 binary, own1 binary"
    if told is None:
        asked = dealt.groupBy("batch").applyInArrow(lambda t: _requests(t, None, parts, rounds), schema)
    else:
        asked = dealt.groupBy("batch").cogroup(told.repartition(batches, "batch").groupBy("batch")).applyInArrow(lambda t, u: _requests(t, u, parts, rounds), schema)
    schema = "round long, batch long, part long, sums0 binary, sums1 binary, n long, v long"
    more = asked.repartition(parts, "part").groupBy("part").applyInArrow(lambda t: _replies(t, len(rounds) - 1), schema)
    return more if told is None else told.union(more)


def score_texts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", held_out: Column | None = None, weights: tuple[float, ...] = K, batch_bytes: int = BATCH_BYTES, order: int = 3) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for
    every row; rows that are not held out are the training texts.  ``order``: the
    most words of an arc with its context.

    Words are split at ASCII white space, A-Z in lower case; a null or empty
    text is its end alone.  Base score: log10 of the root arcs.  A null
    ``held_out`` counts as false; repeated rows train and score each, no rows
    give no rows.  Other columns are dropped, whatever their names.
    """
    frugal(docs.sparkSession)
    held_out = F.lit(False) if held_out is None else held_out
    size = docs.agg(F.sum(F.octet_length(text_col) + 16)).first()[0] or 0
    batches = max(1, -(-size // batch_bytes))
    parts = max(1, batches // BATCHES_A_PART)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text_col).alias("text"))
    dealt = rows.mapInArrow(lambda x: _batches(batch_bytes, x), "batch long, blob binary").repartition(batches, "batch")
    told, rounds = None, _rounds(order)
    for i in range(len(rounds)):
        told = _round(dealt, told, batches, parts, rounds[: i + 1])
    schema = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return dealt.groupBy("batch").cogroup(told.repartition(batches, "batch").groupBy("batch")).applyInArrow(lambda t, u: _score(t, u, weights, order), schema)
