"""License scans: MinHash bands over overlapping windows of whole texts, then exact shingle containment.

Words lose ASCII punctuation and are lower-cased; shingles are SHINGLE words, hashed to 64 bits. Windows have sizes of powers of two and overlap by three quarters; a template of m shingles is looked for in windows of the next power of two.
Every shingle of a window enters its MinHash, template's or not: one pass over the text a hash function, each window size from the minima of the one below. Bands are ROWS functions each; windows and templates that agree on a band are candidates.
The number of bands of a size follows from the least Jaccard similarity that its nearest window has with a template of which CONTAINMENT is there, over all template sizes and offsets: so many that such a pair collides in one band with probability CATCH or more (see worst() and n_bands()). Similarities are a third or more, so at most 65 bands of 2 rows are needed.
A candidate is kept if the window, widened by its stride either way, holds at least CONTAINMENT of the template's distinct shingles; that is counted exactly.

Cases: null or empty texts have no match and no row; a template shorter than SHINGLE words is one shingle of its own length, found by equality, as MinHash does for sets of one; windows may run over a text's end, which adds foreign shingles only, but matches are counted within a text; matches of one license id in one document make one row, that of the best window (the first of equals), n_windows counting them all; repeated rows repeat; an empty table gives no rows; very long texts are scanned whole.
"""

from __future__ import annotations

import json
import math
import pkgutil
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from .common import id_text, raw, small
from .ngram_join import mixed

SHINGLE = 5
ROWS = 2
CATCH = 0.9995
CONTAINMENT = 0.75
# Public license notices and grants.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("MIT-grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("BSD-grant", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("GPL-notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
)
#: Whole texts of common licenses and usual wordings of their notices; several wordings may have one id.
TEXTS = tuple((name, text) for name, text in json.loads(pkgutil.get_data(__package__, "licenses.json")))
_PUNCTUATION = bytes(c for c in range(33, 127) if not chr(c).isalnum())
_STEP = np.uint64(0x9E3779B97F4A7C15)
FIELDS = "doc_id long, license_id string, start_word long, end_word long, containment double, n_windows long"


def words(text: bytes) -> list[bytes]:
    return text.translate(None, _PUNCTUATION).lower().split()


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of the runs of k words, by the first word's place."""
    n = max(0, len(h) - k + 1)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            out = mixed(out * _STEP + h[j : j + n])
    return out


def stride(size: int) -> int:
    return max(1, size // 4)


def worst(size: int) -> float:
    """Least Jaccard similarity of the nearest window with a template of more than size / 2 and at most size shingles, CONTAINMENT of which is in a stretch as long as the template."""
    least = 1.0
    for m in range(size // 2 + 1, size + 1):
        lost = max(0, -(-(stride(size) - 1 - (size - m)) // 2))
        both = math.ceil(CONTAINMENT * m) - lost
        least = min(least, both / (size + m - both))
    return least


def n_bands(size: int) -> int:
    """Bands by which a pair as unlike as worst(size) still collides with probability CATCH."""
    j = worst(size)
    return 1 if j == 1 else math.ceil(math.log(1 - CATCH) / math.log(1 - j**ROWS))


class Scanner:
    def __init__(self, templates: tuple[tuple[str, str], ...]):
        self.names, self.sets, self.lengths = [], [], []
        for name, text in templates:
            h = np.array([xxhash.xxh3_64_intdigest(w) for w in words(text.encode())], np.uint64)
            if len(h):
                k = min(SHINGLE, len(h))
                self.names.append(name)
                self.sets.append(np.unique(shingles(h, k)))
                self.lengths.append((k, len(h) - k + 1))
        # The size of window that each template is looked for in; short templates by their shingle alone.
        self.sizes: dict[int, list[int]] = {}
        self.short: dict[int, list[int]] = {}
        for t, (k, m) in enumerate(self.lengths):
            (self.sizes if k == SHINGLE else self.short).setdefault(1 << (m - 1).bit_length() if k == SHINGLE else k, []).append(t)
        self.bands = {size: n_bands(size) for size in self.sizes}
        rng = np.random.default_rng(7)
        n = ROWS * max([*self.bands.values(), 0])
        self.factor, self.shift = (rng.integers(0, 1 << 32, n, dtype=np.uint32) for _ in range(2))
        self.factor |= np.uint32(1)
        # Each band's keys of a size's templates, and by the low bits of its first row which can be any of them.
        self.keys: dict[tuple[int, int], tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for size, of in self.sizes.items():
            for band in range(self.bands[size]):
                low = np.array([[self.hashed(self.sets[t], band * ROWS + r).min() for r in range(ROWS)] for t in of], np.uint64)
                likely = np.zeros(1 << 16, bool)
                likely[low[:, 0] & np.uint64(0xFFFF)] = True
                key = self.joined(low.T)
                order = np.argsort(key, kind="stable")
                self.keys[size, band] = likely, key[order], np.array(of)[order]

    def hashed(self, x: np.ndarray, i: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (x ^ (x >> np.uint64(32))).astype(np.uint32) * self.factor[i] + self.shift[i]

    @staticmethod
    def joined(rows) -> np.ndarray:
        with np.errstate(over="ignore"):
            out = np.zeros(len(rows[0]), np.uint64)
            for r in rows:
                out = out * _STEP + r.astype(np.uint64)
        return out

    def minima(self, h: np.ndarray) -> dict[int, np.ndarray]:
        """The least of each window of each wanted size, windows beginning at multiples of the size's stride. What is beyond the end counts as greatest."""
        out, size, top = {}, 1, max(self.sizes)
        while True:
            if size in self.sizes:
                out[size] = h
            if size == top:
                return out
            hop = size // stride(size)  # places that two adjoining windows of this size are apart
            beyond = np.r_[h[hop:], np.full(min(hop, len(h)), 0xFFFFFFFF, np.uint32)]
            h = np.minimum(h, beyond)[:: stride(2 * size) // stride(size)]
            size *= 2

    def candidates(self, x: np.ndarray) -> set[tuple[int, int, int]]:
        """Template, first shingle and size of the windows that share a band with a template."""
        found: set[tuple[int, int, int]] = set()
        if not len(x) or not self.sizes:
            return found
        for band in range(max(self.bands.values())):
            rows = [self.minima(self.hashed(x, band * ROWS + r)) for r in range(ROWS)]
            for size in self.sizes:
                if band >= self.bands[size]:
                    continue
                likely, key, of = self.keys[size, band]
                at = np.flatnonzero(likely[rows[0][size] & np.uint32(0xFFFF)])
                if len(at):
                    mine = self.joined([r[size][at] for r in rows])
                    lo, hi = np.searchsorted(key, mine), np.searchsorted(key, mine, "right")
                    for i in np.flatnonzero(lo < hi).tolist():
                        for t in of[lo[i] : hi[i]].tolist():
                            found.add((t, int(at[i]) * stride(size), size))
        return found

    def scan(self, texts: list[bytes]) -> Iterator[tuple[int, str, int, int, float, int]]:
        """Place of the text, license id, first word, end, containment and windows of each match."""
        known: dict[bytes, int] = {}
        ids, size = [], []
        for t in texts:
            w = words(t)
            ids.extend([known.setdefault(x, len(known)) for x in w])
            size.append(len(w))
        if not ids:
            return
        h = np.fromiter(map(xxhash.xxh3_64_intdigest, known), np.uint64, len(known))[np.array(ids, np.int64)]
        end = np.cumsum(size)
        doc = np.repeat(np.arange(len(size)), size)
        best: dict[tuple[int, str], tuple[float, int, int, int]] = {}

        def match(d: int, t: int, first: int, last: int, c: float) -> None:
            name = self.names[t]
            old = best.get((d, name))
            if old is None or c > old[0] or (c == old[0] and first < old[1]):
                best[d, name] = (c, first, last + self.lengths[t][0], 1 + (old[3] if old else 0))
            else:
                best[d, name] = (*old[:3], old[3] + 1)

        for k, of in self.short.items():
            x = shingles(h, k)
            whole = np.arange(len(x)) + k <= end[doc[: len(x)]]
            for t in of:
                for i in np.flatnonzero(whole & (x == self.sets[t][0])).tolist():
                    match(int(doc[i]), t, i, i, 1.0)
        x = shingles(h, SHINGLE)
        place = np.flatnonzero(np.arange(len(x)) + SHINGLE <= end[doc[: len(x)]])  # runs within one text
        x, doc = x[place], doc[place]
        edge = np.searchsorted(doc, np.arange(len(size) + 1))
        for t, s, wide in sorted(self.candidates(x)):
            a, b = max(0, s - stride(wide)), min(len(x), s + wide + stride(wide))
            for d in range(doc[a], doc[b - 1] + 1):
                lo, hi = max(a, edge[d]), min(b, edge[d + 1])
                hits = np.flatnonzero(np.isin(x[lo:hi], self.sets[t])) + lo
                c = len(np.unique(x[hits])) / len(self.sets[t])
                if c >= CONTAINMENT:
                    match(d, t, int(place[hits[0]]), int(place[hits[-1]]), c)
        begin = end - size
        for (d, name), (c, first, last, n) in sorted(best.items()):
            yield d, name, first - int(begin[d]), last - int(begin[d]), c, n


def license_scan(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES + TEXTS) -> DataFrame:
    """A row for each document and license found in it: where the best window's first and last template shingles are, in words, and how much of the template it holds."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates)
        kinds = {"doc_id": pa.int64(), "license_id": pa.string(), "start_word": pa.int64(), "end_word": pa.int64(), "containment": pa.float64(), "n_windows": pa.int64()}
        for b in small(batches, 1000, 2 << 20):
            ids = b.column("doc_id").to_pylist()
            rows = [(ids[d], *r) for d, *r in scanner.scan(raw(b.column("text")))]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds.values())], list(kinds))

    return id_text(docs).mapInArrow(work, FIELDS)
