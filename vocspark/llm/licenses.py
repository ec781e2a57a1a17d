"""License scans: MinHash bands over overlapping windows find templates, shingles confirm them.

Texts are runs of letters and digits, lower-cased, in shingles of five words. Every template
has a window length, a power of two of shingles short enough that a passage holding the
template contains a whole window at the scan's stride. Templates give their windows at every
offset, so a window inside an unchanged passage equals one of them. Two rows per band in
sixteen bands find a window that shares half its shingles with probability 0.99. A candidate
is confirmed by the share of the template's shingles, compared as texts, that stand around it.
A template of under five words is one shingle of all its words, searched in every text.
"""

from __future__ import annotations

import re
from functools import partial
from importlib import resources

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

SHINGLE = 5
CONTAINMENT = 0.8
MARK_BITS = 17
BANDS, ROWS = 16, 2
MOST_TEMPLATES = 10_000
_CHUNK = 1 << 14
_WORDS = re.compile(r"[^\W_]+")

# Notices as their licenses or stewards word them.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "MIT-grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software "
        "and associated documentation files (the \"Software\"), to deal in the Software without "
        "restriction, including without limitation the rights to use, copy, modify, merge, publish, "
        "distribute, sublicense, and/or sell copies of the Software"),
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-header": (
        "you may not use this file except in compliance with the License. You may obtain a copy of the "
        "License at"),
    "GPL-3.0-notice": "licensed under the GNU General Public License, version 3",
    "GPL-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the "
        "GNU General Public License as published by the Free Software Foundation"),
    "MPL-2.0-header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    "BSD-header": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted "
        "provided that the following conditions are met"),
    "CC-BY-4.0-notice": "licensed under CC BY 4.0",
    "CC-BY-SA-4.0-notice": "licensed under CC BY-SA 4.0",
    "CC-BY-NC-4.0-notice": "licensed under CC BY-NC 4.0",
    "all-rights-reserved": "No part of this work may be reproduced without permission. All rights reserved.",
    "all-rights-reserved-notice": "All rights reserved.",
    "BSD-3-Clause-endorsement": (
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse "
        "or promote products derived from this software without specific prior written permission"),
    "ISC-grant": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without "
        "fee is hereby granted, provided that the above copyright notice and this permission notice appear "
        "in all copies"),
    "LGPL-header": (
        "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License "
        "as published by the Free Software Foundation"),
    "LGPL-3.0-notice": "licensed under the GNU Lesser General Public License, version 3",
    "AGPL-header": (
        "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License "
        "as published by the Free Software Foundation"),
    "AGPL-3.0-notice": "licensed under the GNU Affero General Public License, version 3",
    "EPL-2.0-header": (
        "This program and the accompanying materials are made available under the terms of the Eclipse "
        "Public License 2.0"),
    "EPL-1.0-header": (
        "This program and the accompanying materials are made available under the terms of the Eclipse "
        "Public License v1.0"),
    "Unlicense-header": "This is free and unencumbered software released into the public domain.",
    "Unlicense-grant": (
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in "
        "source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any "
        "means."),
    "CC0-1.0-notice": (
        "To the extent possible under law, the author(s) have dedicated all copyright and related and "
        "neighboring rights to this software to the public domain worldwide."),
    "CC0-1.0-title": "CC0 1.0 Universal Public Domain Dedication",
}


def license_bodies() -> dict[str, str]:
    """The full texts in `license_texts`, read on the driver only."""
    folder = resources.files("vocspark.llm") / "license_texts"
    return {
        f.name.removesuffix(".txt") + "-body": f.read_text("utf-8")
        for f in sorted(folder.iterdir(), key=lambda f: f.name) if f.name.endswith(".txt")}


def shingles(words: list[str]) -> list[str]:
    size = min(SHINGLE, len(words))
    return [" ".join(words[i:i + size]) for i in range(len(words) - size + 1)] if words else []


def words(text: str | None) -> list[str]:
    return _WORDS.findall((text or "").lower())


def _hashes(grams: list[str]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, grams), np.uint64, len(grams))


_DRAW = np.random.default_rng(4).integers(1, 1 << 63, (2, BANDS * ROWS, 1), np.uint64)


def stride(length: int) -> int:
    return max(1, length // 4)


def window_length(count: int) -> int:
    length = 1
    while 2 * length + stride(2 * length) - 1 <= count:
        length *= 2
    return length


def band_keys(hashes: np.ndarray, lengths: list[int], dense: bool) -> dict[int, np.ndarray]:
    """Per window length: keys, bands x windows, at every offset (`dense`) or at the stride."""
    least = hashes * (_DRAW[0] | np.uint64(1)) + _DRAW[1]
    least ^= least >> np.uint64(31)
    least *= np.uint64(0x9E3779B97F4A7C15)
    length, keys = 1, {}
    while True:
        if length in lengths:
            seen = least if dense else least[:, ::stride(length)]
            keys[length] = (
                seen[0::2] * np.uint64(0xC2B2AE3D27D4EB4F) + seen[1::2]
                + np.arange(BANDS, dtype=np.uint64)[:, None] * np.uint64(0x165667B19E3779F9)
                + np.uint64(length))
        if length >= max(lengths) or least.shape[1] <= length:
            return keys
        least = np.minimum(least[:, :-length], least[:, length:])
        length *= 2


def template_index(templates: dict[str, str]):
    """(names, shingle sets, window lengths, sorted band keys, template of each key, short templates, key marks)."""
    if len(templates) > MOST_TEMPLATES:
        raise ValueError(f"over {MOST_TEMPLATES} templates: the index is broadcast")
    names, sets, lengths, keys, owner, short = list(templates), [], [], [], [], {}
    for i, name in enumerate(names):
        found = words(templates[name])
        grams = shingles(found)
        if not grams:
            raise ValueError(f"template {name} has no words")
        sets.append(frozenset(grams))
        if len(found) < SHINGLE:
            short[i] = f" {grams[0]} "
            lengths.append(0)
            continue
        lengths.append(window_length(len(grams)))
        found = np.unique(band_keys(_hashes(grams), [lengths[-1]], True)[lengths[-1]])
        keys.append(found)
        owner.append(np.full(len(found), i))
    if not keys:
        return names, sets, lengths, np.empty(0, np.uint64), np.empty(0, int), short, np.empty(0, bool)
    keys, owner = np.concatenate(keys), np.concatenate(owner)
    order = np.argsort(keys, kind="stable")
    # the leading bits of every key: most keys of a text are told apart from all templates' by these
    marks = np.zeros(1 << MARK_BITS, bool)
    marks[keys >> np.uint64(64 - MARK_BITS)] = True
    return names, sets, lengths, keys[order], owner[order], short, marks


def candidates(hashes: np.ndarray, index) -> set[tuple[int, int]]:
    """(template, first shingle) of all windows that share a band key with a template."""
    _, _, lengths, keys, owner, _, marks = index
    found = set()
    distinct = sorted(set(lengths) - {0})
    if not distinct:
        return found
    overlap = distinct[-1]
    for at in range(0, len(hashes), _CHUNK):
        part = hashes[at:at + _CHUNK + overlap]
        for length, seen in band_keys(part, distinct, False).items():
            band, window = np.nonzero(marks[seen >> np.uint64(64 - MARK_BITS)])
            values = seen[band, window]
            for k, value, w in zip(np.searchsorted(keys, values).tolist(), values, window.tolist()):
                while k < len(keys) and keys[k] == value:
                    found.add((int(owner[k]), at + w * stride(length)))
                    k += 1
    return found


def _places(joined: str, notice: str) -> list[int]:
    """First words of every place of a short template in a text's words, each between spaces."""
    places, at = [], joined.find(notice)
    while at >= 0:
        places.append(joined.count(" ", 0, at))
        at = joined.find(notice, at + len(notice) - 1)
    return places


def scan_text(text: str | None, index) -> list[tuple[str, float, list[int]]]:
    """(template, containment, first words of the passages) of every template in a text."""
    names, sets, lengths, _, _, short, _ = index
    found = words(text)
    joined = f" {' '.join(found)} "
    best: dict[int, tuple[float, list[int]]] = {
        t: (1.0, places) for t, notice in short.items() if (places := _places(joined, notice))}
    grams = shingles(found) if len(found) >= SHINGLE else []
    for t, at in sorted(candidates(_hashes(grams), index)) if grams else ():
        size = len(sets[t])
        first = max(0, at - size)
        inside = [i for i in range(first, min(len(grams), at + lengths[t] + size)) if grams[i] in sets[t]]
        share = len({grams[i] for i in inside}) / size
        if share < CONTAINMENT:
            continue
        was, places = best.get(t, (0.0, []))
        if not places or inside[0] > places[-1] + size:
            places = [*places, inside[0]]
        best[t] = max(was, share), places
    return [(names[t], *best[t]) for t in sorted(best)]


def _scan(batches, index):
    kinds = pa.schema([("doc_id", pa.int64()), ("template", pa.string()), ("containment", pa.float64()),
                       ("first_words", pa.list_(pa.int32()))])
    for batch in batches:
        rows = [
            {"doc_id": doc_id, "template": name, "containment": share, "first_words": places}
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            for name, share, places in scan_text(text, index.value)]
        yield pa.RecordBatch.from_pylist(rows, kinds)


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """One row per document and template found: doc_id, template, containment, first_words.

    Whole texts are scanned; null, empty and short texts match nothing. Repeated rows are each
    reported; a null doc_id stays null. An empty table gives an empty result.
    """
    index = docs.sparkSession.sparkContext.broadcast(
        template_index(TEMPLATES | license_bodies() if templates is None else templates))
    return docs.select("doc_id", "text").mapInArrow(
        partial(_scan, index=index),
        "doc_id long, template string, containment double, first_words array<int>")
