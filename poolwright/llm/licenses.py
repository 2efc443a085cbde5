"""License scans: MinHash bands over overlapping windows, then exact containment.

A text is cut into overlapping windows of several lengths, each twice its
stride.  A template of g shingles has the stride s with s / 2 < g <= s and lies
wholly in some window of 2 s.  With a share f of it there the window and the
template have f g of at most 2 s + (1 - f) g shingles in common, for f = 1 over
1 / 4 and for f = 0.8 over 0.4 / 2.1, so of 64 bands of one row at least one
collides with probability over 1 - 1.1e-8 and 1 - 1.4e-6.  An index by band and
value gives the templates that collide with a window.  Every window so found is verified by the exact share of the template's shingles that
the text has around it.  Templates of under four shingles, which make up less of a
window, are sought by their shingles themselves.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from poolwright.llm import textnp

BANDS, SHINGLE = 64, 5
#: The shortest stride; templates of fewer shingles are looked up directly.
STRIDE = 4

# License notices, by SPDX identifier.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("GPL-3.0", "licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
)
SEEDS = np.random.RandomState(20240503).randint(0, 1 << 32, (2, BANDS), dtype=np.uint64).astype(np.uint32)


def min_hashes(grams: np.ndarray, stride: int) -> np.ndarray:
    """Minima of each hash function over blocks of ``stride`` windows."""
    x = (grams >> np.uint64(32)).astype(np.uint32)
    out = np.empty((-(-len(x) // stride), BANDS), np.uint32)
    starts = np.arange(0, len(x), stride)
    for k in range(BANDS):
        out[:, k] = np.minimum.reduceat((x ^ SEEDS[0, k]) * (SEEDS[1, k] | np.uint32(1)), starts)
    return out


def _template(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    return next(iter(textnp.gram_sets(textnp.words(data, np.array([0, len(data)]), textnp.PLAIN), SHINGLE)))


def _band_keys(mins: np.ndarray) -> np.ndarray:
    return mins.astype(np.uint64) | np.arange(BANDS, dtype=np.uint64) << np.uint64(32)


def _band_index(templates: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted (band, value) of all templates, the template of each, and a bit
    table by the low bits of values that most windows miss."""
    keys = _band_keys(np.array(templates))
    by = np.argsort(keys, axis=None)
    bits = np.zeros(1 << 16, bool)
    bits[keys.ravel() & np.uint64(0xFFFF)] = True
    return keys.ravel()[by], by // BANDS, bits


def _collisions(windows: np.ndarray, keys: np.ndarray, template: np.ndarray, bits: np.ndarray) -> list[tuple[int, int]]:
    """(window, template) pairs that share a band, each once."""
    row, band = np.nonzero(bits[windows & np.uint32(0xFFFF)])
    sought = windows[row, band].astype(np.uint64) | band.astype(np.uint64) << np.uint64(32)
    lo, hi = np.searchsorted(keys, sought, "left"), np.searchsorted(keys, sought, "right")
    return sorted({(int(row[i]), int(template[j])) for i in np.flatnonzero(hi > lo).tolist() for j in range(lo[i], hi[i])})


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", templates: tuple[tuple[str, str], ...] = TEMPLATES, least: float = 0.8) -> DataFrame:
    """doc_id, license, n_found and n_template (shingles of the template found
    in the text and all), first_word and last_word, for the best template of
    each license that a text contains.  Of equal shares the first template in
    listed order, of equal windows the first, counts.

    A null, empty or unmatched text gives no row; repeated rows each give
    theirs; texts of any length are read whole, other columns dropped.  Words are letters and digits in lower case; a text or template of
    under five words is one shingle.
    """
    index: dict[int, list[tuple[int, str, np.ndarray, np.ndarray]]] = {}
    for i, (name, text) in enumerate(templates):
        grams = _template(text)
        if len(grams):
            stride = STRIDE if len(grams) >= STRIDE else 0
            while 0 < stride < len(grams):
                stride *= 2
            index.setdefault(stride, []).append((i, name, grams, min_hashes(grams, len(grams))[0]))
    largest = max(index, default=0)
    bands = {stride: _band_index([x[3] for x in some]) for stride, some in index.items() if stride}

    def scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for first, _, data, offsets in textnp.chunks(batch.column(1)):
                w = textnp.words(data, offsets, textnp.PLAIN)
                all_ = textnp.grams(w.hash, SHINGLE)
                if len(all_):
                    rows += _long(first, w, all_)
                size = np.diff(w.bounds)
                for d in np.flatnonzero((size > 0) & (size < SHINGLE)):
                    gram = textnp.grams(w.hash[w.bounds[d] : w.bounds[d + 1]], int(size[d]))
                    rows += [(first + int(d), name, i, 1, 1, 0, int(size[d]) - 1) for group in index.values() for i, name, grams, _ in group if np.array_equal(grams, gram)]
            best: dict[tuple[int, str], tuple] = {}
            for r in rows:
                key, rank = r[:2], (-r[3] / r[4], r[2], r[5])
                if key not in best or rank < best[key][0]:
                    best[key] = (rank, r)
            hits = [r for _, (_, r) in sorted(best.items())]
            columns = [batch.column(0).take(pa.array([r[0] for r in hits], pa.int64())), pa.array([r[1] for r in hits], pa.string())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array([r[k] for r in hits], pa.int64()) for k in (3, 4, 5, 6)], ["doc_id", "license", "n_found", "n_template", "first_word", "last_word"])

    def _around(first: int, w: textnp.Words, all_: np.ndarray, a: int, b: int, i: int, name: str, grams: np.ndarray) -> list[tuple]:
        rows = []
        for d in range(int(np.searchsorted(w.bounds, a, "right")) - 1, int(np.searchsorted(w.bounds, b, "left"))):
            lo, hi = max(a - len(grams), int(w.bounds[d])), min(b + len(grams), int(w.bounds[d + 1]) - SHINGLE + 1)
            if hi > lo:
                at = np.flatnonzero(np.isin(all_[lo:hi], grams))
                n = len(np.unique(all_[lo:hi][at]))
                if n >= least * len(grams):
                    rows.append((first + d, name, i, n, len(grams), int(lo + at[0] - w.bounds[d]), int(lo + at[-1] - w.bounds[d]) + SHINGLE - 1))
        return rows

    def _long(first: int, w: textnp.Words, all_: np.ndarray) -> list[tuple]:
        """Windows may lie across texts; verification keeps to each text."""
        rows, stride = [], STRIDE
        for i, name, grams, _ in index.get(0, ()):
            for k in np.flatnonzero(np.isin(all_, grams)).tolist():
                rows += _around(first, w, all_, k, k + 1, i, name, grams)
        mins = min_hashes(all_, stride)
        while stride <= largest:
            windows = np.minimum(mins, np.vstack([mins[1:], mins[-1:]]))
            if stride in bands:
                for k, at in _collisions(windows, *bands[stride]):
                    i, name, grams, _ = index[stride][at]
                    rows += _around(first, w, all_, k * stride, min((k + 2) * stride, len(all_)), i, name, grams)
            stride *= 2
            mins = np.minimum(mins[::2], np.vstack([mins[1::2], mins[-1:]])[: len(mins[::2])])
        return rows

    schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}, license string, n_found long, n_template long, first_word long, last_word long"
    return docs.select(id_col, text_col).mapInArrow(scan_batches, schema)
