"""License scans: passages that match a licence template by the Dice coefficient over word bigrams.

Texts and templates are normalised to words (runs of letters and digits in lower case; marks and blanks only part
them).  A passage is a run of words; its similarity to a template is 2 |common bigrams| / (|passage| + |template|), bigrams
counted as often as they occur.  Size bounds prune: a passage can only reach the threshold t if it has between
t / (2 - t) and (2 - t) / t times the template's bigrams, and a template is only a candidate where enough of its
bigrams lie within the longest such passage.  A best passage begins and ends with a bigram of the template, so only
those are tried.  Of passages that overlap the more similar stays.

Templates are a parameter of the job (some kilobytes), not data that grows with the corpus.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Wordings of public licence notices, by SPDX-like name.
TEMPLATES = {
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.",
                   "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
                   "You may obtain a copy of the License at"),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.",
                "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
                "the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    "MIT": ("Released under the MIT License.", "Licensed under the MIT License.",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
            "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
            "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"),
    "BSD-2-Clause": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "LicenseRef-All-Rights-Reserved": ("All rights reserved.",),
}
WORD = rb"[0-9a-z\x80-\xff]+"


def normalise(text: bytes) -> list[bytes]:
    """Words in lower case; only the ASCII letters of a text that isn't UTF-8."""
    return re.findall(WORD, text.lower() if text.isascii() else text.decode("utf-8", "replace").lower().encode())


class Scanner:
    """Finds the passages of one text; templates by name, each a tuple of wordings of at least two words."""

    def __init__(self, templates: dict[str, tuple[str, ...]], threshold: float):
        self.threshold, self.known, self.grams = threshold, {}, {}
        self.templates = []
        for name, wordings in templates.items():
            for wording in wordings:
                words = [self.known.setdefault(w, len(self.known) + 1) for w in normalise(wording.encode())]
                need = Counter(zip(words, words[1:], strict=False))
                size = sum(need.values())
                if size:
                    least, most = (math.ceil(threshold / (2 - threshold) * size - 1e-9), math.floor((2 - threshold) / threshold * size + 1e-9))
                    self.templates.append((name, need, size, most, math.ceil(threshold * (least + size) / 2 - 1e-9)))
        base = self.base = len(self.known) + 1
        self.coded = [({a * base + b: n for (a, b), n in need.items()}, np.array(sorted(a * base + b for a, b in need))) for _, need, *_ in self.templates]

    def find(self, text: bytes | None) -> list[tuple[str, float, int, int]]:
        """Licence, similarity, first and last word of each passage, by place."""
        get = self.known.get
        ids = np.array([get(w, 0) for w in normalise(text or b"")], np.int64)
        if len(ids) < 2:
            return []
        at = np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0))
        codes, found = ids[at] * self.base + ids[at + 1], []
        for (name, _, size, most, enough), (need, sorted_codes) in zip(self.templates, self.coded, strict=True):
            mine = np.isin(codes, sorted_codes)
            places, grams = at[mine], codes[mine]
            if len(places) < enough:
                continue
            # starts from which enough hits lie within the longest passage
            starts = np.flatnonzero(places[enough - 1:] - places[:len(places) - enough + 1] < most)
            places, grams = places.tolist(), grams.tolist()
            for i in starts.tolist():
                left, common, best = dict(need), 0, None
                for j in range(i, len(places)):
                    span = places[j] - places[i] + 1
                    if span > most:
                        break
                    if left[grams[j]] > 0:
                        left[grams[j]] -= 1
                        common += 1
                        score = 2 * common / (span + size)
                        if score >= self.threshold and (best is None or score > best[0]):
                            best = (score, j)
                if best:
                    found.append((-best[0], places[i] - places[best[1]], places[i], places[best[1]] + 1, name))
        taken, kept = np.zeros(len(ids), bool), []
        for score, _, first, last, name in sorted(found):  # the most similar, then the longest, then the first
            if not taken[first:last + 1].any():
                taken[first:last + 1] = True
                kept.append((name, -score, first, last))
        return sorted(kept, key=lambda k: k[2])


FOUND = "doc_id long, license string, dice double, passages array<struct<license:string,dice:double,first_word:long,last_word:long,text:string>>"


def passage(text: bytes, first: int, last: int) -> str:
    """The words from first to last as the text has them (lower case may change a text's length, so word by word)."""
    spans = [m.span() for m in re.finditer(rb"(?i)" + WORD, text)]
    return text[spans[first][0]:spans[last][1]].decode("utf-8", "replace")


def license_scan(docs: DataFrame, templates: dict[str, tuple[str, ...]] | None = None, threshold: float = 0.8,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, license and dice of its most similar passage (the first of equals), all passages.

    Documents without any have nulls and an empty list.  Null and empty texts have none; whole texts are read;
    repeated rows and null ids are kept; other columns are ignored.
    """
    templates = TEMPLATES if templates is None else templates

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner, kind = Scanner(templates, threshold), pa.list_(pa.struct([("license", pa.string()), ("dice", pa.float64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("text", pa.string())]))
        for batch in batches:
            best, rows = [], []
            for t in batch.column("text").cast(pa.binary()):
                text = t.as_py()
                found = scanner.find(text)
                best.append(max(found, key=lambda f: (f[1], -f[2]), default=(None, None)))
                rows.append([{"license": n, "dice": d, "first_word": a, "last_word": b, "text": passage(text, a, b)} for n, d, a, b in found])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([b[0] for b in best], pa.string()), pa.array([b[1] for b in best], pa.float64()), pa.array(rows, kind)],
                                             names=["doc_id", "license", "dice", "passages"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, FOUND)
