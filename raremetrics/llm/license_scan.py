"""Licence scan: a trained paragraph classifier, confirmed by templates.

Every line with a word is a paragraph, and so is every run of consecutive lines that
holds more of a notice than each of its lines, so that wrapped notices are read whole
(blank lines between are skipped; a run is bounded by the notice's length).  Word n-gram indicators (orders 1 to 3, letters
folded to lower case, punctuation dropped, hashed to ``DIMS`` places) feed a sparse
softmax regression over the licence families and an *unknown* class.  Positive training
paragraphs are the notices of ``NOTICES`` in varied wordings; unknown ones are a bounded
sample of the corpus's own paragraphs (``NEGATIVES``, drawn by hash) that resemble no
notice.  A temperature fitted on paragraphs kept from training calibrates the
probabilities; a paragraph whose best family stays under ``MIN_PROBABILITY`` is unknown.
A predicted family is confirmed if one of its notices has at least ``MIN_SIMILARITY`` of
its word pairs in the paragraph, or if the paragraph is little more than a title of its
licence (``MIN_SIMILARITY`` by Jaccard, all of the title's pairs).  Of overlapping
confirmed paragraphs the most similar counts, then the one with fewer lines.
``n_paragraphs`` counts lines alone.

Defined cases: a null or empty text has no paragraph and no licence; equal texts get
equal results; of several licences in a text ``license`` is the one with the highest
probability (ties: the first by name) and ``families`` lists all; extra columns are
carried along (those named like a result are replaced); an empty table gives an empty
result and a corpus without any paragraph is scored by the notices alone.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from raremetrics.llm import common, grams

ORDERS = (1, 2, 3)
BITS = 18
DIMS = 1 << BITS
NEGATIVES = 4000
MIN_PROBABILITY, MIN_SIMILARITY = 0.5, 0.6
UNKNOWN = "unknown"

# Licence families with names and notices as their publishers word them.
NAMES = {
    "AGPL-3.0": ["GNU Affero General Public License, version 3", "AGPL-3.0", "AGPLv3"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache-2.0", "Apache 2.0 license"],
    "BSD": ["BSD License", "3-Clause BSD License", "2-Clause BSD License", "BSD-3-Clause", "BSD-2-Clause"],
    "CC-BY": ["CC BY 4.0", "Creative Commons Attribution 4.0 International License", "CC BY 3.0"],
    "CC-BY-NC": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License", "CC BY-NC 3.0"],
    "CC-BY-ND": ["CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"],
    "CC-BY-SA": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License", "CC BY-SA 3.0"],
    "CC0": ["CC0 1.0 Universal", "Creative Commons Zero", "CC0 1.0 Public Domain Dedication"],
    "GPL-2.0": ["GNU General Public License, version 2", "GPL-2.0", "GPLv2"],
    "GPL-3.0": ["GNU General Public License, version 3", "GPL-3.0", "GPLv3"],
    "LGPL": ["GNU Lesser General Public License", "LGPL-2.1", "LGPL-3.0", "LGPLv3"],
    "MIT": ["MIT License", "MIT licence", "Expat License"],
    "MPL-2.0": ["Mozilla Public License, version 2.0", "MPL-2.0", "MPL 2.0"],
}
LEADS = ["Licensed under the", "Licensed under", "Released under the", "Released under", "This work is licensed under the",
         "This work is licensed under", "This software is distributed under the", "Distributed under the terms of the",
         "This file is made available under the", "Published under", "SPDX-License-Identifier:"]
TITLES = {
    "AGPL-3.0": ["GNU Affero General Public License", "GNU Affero General Public License Version 3, 19 November 2007"],
    "Apache-2.0": ["Apache License Version 2.0", "Apache License 2.0", "Apache License Version 2.0, January 2004"],
    "BSD": ["BSD 3-Clause License", "BSD 2-Clause License", "The BSD License", "BSD 3-Clause New or Revised License", "BSD 2-Clause Simplified License"],
    "GPL-2.0": ["GNU General Public License Version 2", "GNU General Public License v2.0", "GNU General Public License Version 2, June 1991"],
    "GPL-3.0": ["GNU General Public License Version 3", "GNU General Public License v3.0", "GNU General Public License Version 3, 29 June 2007"],
    "LGPL": ["GNU Lesser General Public License Version 2.1, February 1999", "GNU Lesser General Public License Version 3, 29 June 2007"],
    "MIT": ["The MIT License", "The MIT License (MIT)", "MIT License (MIT)"],
    "MPL-2.0": ["Mozilla Public License Version 2.0", "Mozilla Public License 2.0"],
}
NOTICES = {
    "AGPL-3.0": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"],
    "Apache-2.0": ["You may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
                   "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND"],
    "BSD": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "CC0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"],
    "GPL-3.0": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"],
    "GPL-2.0": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version"],
    "LGPL": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version"],
    "MIT": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"],
    "Proprietary": ["All rights reserved.", "All rights reserved. No part of this publication may be reproduced, distributed or transmitted in any form",
                    "Copyright. All rights reserved."],
    "Unlicense": ["This is free and unencumbered software released into the public domain", "Released into the public domain"],
}
FAMILIES = sorted({*NAMES, *NOTICES})
CLASSES = [*FAMILIES, UNKNOWN]

_KIND = np.zeros(256, np.uint8)
_KIND[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_KIND[48:58] = 2


def notices() -> list[tuple[str, str]]:
    """(family, text) of all notices: leads with names, and full wordings."""
    out = [(f, f"{lead} {name}.") for f, names in NAMES.items() for name in names for lead in LEADS]
    return sorted(out + [(f, t) for f, texts in NOTICES.items() for t in texts])


def titles() -> list[tuple[str, str]]:
    """(family, text) of all titles: names of licences that can stand alone in a line."""
    return sorted({(f, t) for table in (NAMES, TITLES) for f, texts in table.items() for t in texts})


def training_notices() -> list[tuple[str, str]]:
    """Notices in varied wordings: bare, behind a copyright line, in a sentence, without one of the words; and titles."""
    out = titles()
    for n, (family, text) in enumerate(notices()):
        words = text.split()
        out += [(family, text), (family, f"Copyright (c) {1990 + n % 36} the authors. {text}"), (family, f"{text} See the file for details.")]
        if len(words) > 6:
            drop = n % len(words)
            out.append((family, " ".join(words[:drop] + words[drop + 1:])))
    return out


def pairs(text: str) -> set[tuple[str, str]]:
    """Word pairs of a paragraph, as templates are compared by."""
    w = re.findall(r"[a-z]+|[0-9]+", text.lower())
    return set(zip(w, w[1:], strict=False))


TEMPLATES: dict[str, list[set]] = {}
for _family, _text in notices():
    TEMPLATES.setdefault(_family, []).append(pairs(_text))
HEADINGS: dict[str, list[set]] = {}
for _family, _text in titles():
    if pairs(_text):
        HEADINGS.setdefault(_family, []).append(pairs(_text))


def similarity(family: str, found: set) -> float:
    """Largest share of a notice's word pairs that the paragraph has, or Jaccard similarity to a title in it."""
    return max([len(t & found) / len(t) for t in TEMPLATES[family]]
               + [len(t) / len(found) for t in HEADINGS.get(family, []) if t <= found])


def resembles(found: set) -> bool:
    """Whether a paragraph has half of some notice's word pairs."""
    return any(similarity(f, found) >= 0.5 for f in FAMILIES)


def features(buf: np.ndarray, start: np.ndarray, end: np.ndarray, mask: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(paragraph number, feature), each pair once, for the paragraphs [start, end) of the bytes."""
    kind = _KIND[buf]
    edge = np.union1d(start, end)
    new = np.ones(len(buf), bool)
    new[1:] = kind[1:] != kind[:-1]
    new[edge[edge < len(buf)]] = True
    at = np.flatnonzero(new)
    stop = np.append(at[1:], len(buf))[:len(at)]
    word = kind[at] > 0
    at, stop = at[word], stop[word]
    lo = np.searchsorted(at, start)
    first = np.append(lo, np.searchsorted(at, end[-1:]))
    h = grams.Hashed(grams.LOWER[buf]).of(at, stop)
    found = []
    for n in ORDERS:
        _, own, g = grams.windows(h[first[0]:], first - first[0], n)
        feature = (grams.mix(g + np.uint64(n)) >> np.uint64(64 - BITS)).astype(np.int64)
        if mask is not None:
            own, feature = own[mask[feature]], feature[mask[feature]]
        found.append(own << BITS | feature)
    pair = np.unique(np.concatenate(found))
    return pair >> BITS, pair & (DIMS - 1)


def paragraphs(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text numbers of the lines that have a word."""
    start, end = grams.spans(buf != 10, off)
    ink = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(~grams.SPACE[buf], out=ink[1:])
    use = ink[end] > ink[start]
    return start[use], end[use], np.searchsorted(off, start[use], "right") - 1


def word_pairs(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and n+1 first places of the words that ``pairs`` sees, and the word pairs: places, texts and hashes."""
    kind = np.where(buf < 128, _KIND[buf], 0)
    runs = [grams.spans(kind == k, off) for k in (1, 2)]
    start, end = (np.concatenate(x) for x in zip(*runs, strict=True))
    order = np.argsort(start)
    start, end = start[order], end[order]
    first = np.searchsorted(start, off)
    place, own, h = grams.windows(grams.Hashed(grams.LOWER[buf]).of(start, end), first, 2)
    return start, first, place, own, h


def _parts() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all templates' word pairs, which template has which (0 or 1), the pairs each must show, and its longest run of words."""
    texts = [(t, MIN_SIMILARITY) for _, t in notices()] + [(t, 1.0) for _, t in titles() if pairs(t)]
    raw = [t.encode() for t, _ in texts]
    off = np.cumsum([0, *map(len, raw)])
    _, first, _, own, h = word_pairs(np.frombuffer(b"".join(raw), np.uint8), off)
    known, which = np.unique(h, return_inverse=True)
    has = np.zeros((len(texts), len(known)), np.float32)
    has[own, which] = 1
    share = np.array([x for _, x in texts])
    return known, has, np.ceil(share * has.sum(axis=1) - 1e-9), 2 * np.diff(first) + 40


KNOWN, HAS, NEED, REACH = _parts()


def runs_of_lines(buf: np.ndarray, off: np.ndarray, line: np.ndarray) -> list[tuple[int, int]]:
    """(first, last) numbers of the runs of two and more lines that show enough of a template, and more than each line alone.

    ``line`` are the starts of the lines.  From each line that has a pair of a template the
    run goes to the line with which it shows the most pairs, within the template's reach.
    """
    start, first, place, own, h = word_pairs(buf, off)
    at = np.minimum(np.searchsorted(KNOWN, h), len(KNOWN) - 1)
    hit = KNOWN[at] == h
    place, own, at = place[hit], own[hit], at[hit]
    if not len(at):
        return []
    text, own = np.unique(own, return_inverse=True)
    shown = np.zeros((len(text), len(KNOWN)), np.float32)
    shown[own, at] = 1
    begin = np.searchsorted(line, start[place], "right") - 1
    end = np.searchsorted(line, start[place + 1], "right") - 1
    edge = np.searchsorted(own, np.arange(len(text) + 1))
    word = np.searchsorted(start, np.append(line, len(buf)))  # first word of each line
    found = set()
    for k, template in np.argwhere(shown @ HAS.T >= NEED):
        mine = np.arange(edge[k], edge[k + 1])
        mine = mine[HAS[template, at[mine]] > 0]
        if begin[mine[0]] == end[mine[-1]]:
            continue
        lo, hi, pair, need = begin[mine].tolist(), end[mine].tolist(), at[mine].tolist(), NEED[template]
        alone: dict[int, set] = {}
        for a, b, p in zip(lo, hi, pair, strict=True):
            if a == b:
                alone.setdefault(a, set()).add(p)
        for i, a in enumerate(lo):
            if i and lo[i - 1] == a:
                continue
            seen, most, last = set(), 0, a
            for j in range(i, len(lo)):
                if word[hi[j] + 1] - word[a] > REACH[template] and hi[j] > a + 1:
                    break
                seen.add(pair[j])
                if len(seen) > most:
                    most, last = len(seen), hi[j]
            if last > a and most >= need and most > max((len(alone[x]) for x in range(a, last + 1) if x in alone), default=0):
                found.add((a, last))
    return sorted(found)


def of_texts(texts: list[str | bytes], mask: np.ndarray | None = None) -> list[np.ndarray]:
    """Features of whole paragraphs."""
    raw = [t if isinstance(t, bytes) else t.encode() for t in texts]
    off = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    own, feature = features(np.frombuffer(b"".join(raw), np.uint8), off[:-1], off[1:], mask)
    return np.split(feature, np.searchsorted(own, np.arange(1, len(texts))))


def fit(negatives: list[str], penalty: float = 0.01, steps: int = 120) -> dict:
    """Softmax regression with accelerated gradient steps, then a temperature on the rows kept from training."""
    texts = training_notices() + [(UNKNOWN, t) for t in negatives]
    y = np.array([CLASSES.index(f) for f, _ in texts])
    rows = of_texts([t for _, t in texts])
    held = np.arange(len(rows)) % 5 == 4
    seen = np.zeros((2, DIMS))  # rows with the feature: notices, corpus
    for r, k in zip(rows, y, strict=True):
        seen[int(CLASSES[k] == UNKNOWN)][r] += 1
    use = (seen[0] >= 2) | (seen[1] >= max(2, 0.01 * len(negatives)))
    place = np.cumsum(use) - 1
    own = np.concatenate([np.full(use[r].sum(), i) for i, r in enumerate(rows)])
    col = np.concatenate([place[r[use[r]]] for r in rows])
    train = ~held[own]
    n, c = int(use.sum()), len(CLASSES)
    weight = (~held / np.maximum(np.bincount(y[~held], minlength=c), 1)[y])[:, None]  # classes weigh the same
    weight = weight / weight.sum() * 100
    hot = np.eye(c)[y]

    def margins(w, b, select=slice(None)):
        return np.stack([np.bincount(own[select], w[col[select], k], minlength=len(rows)) for k in range(c)], axis=1) + b

    def probability(m):
        e = np.exp(m - m.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    w, b = np.zeros((n, c)), np.zeros(c)
    vw, vb = w, b
    step = 4.0 / (weight[own[train], 0] @ np.ones(train.sum()) / 4 + 1)
    for t in range(steps):
        g = weight * (probability(margins(vw, vb, train)) - hot)
        nw = vw - step * (np.stack([np.bincount(col[train], g[own[train], k], minlength=n) for k in range(c)], axis=1) + penalty * vw)
        nb = vb - step * g.sum(axis=0)
        vw, vb = nw + t / (t + 3) * (nw - w), nb + t / (t + 3) * (nb - b)
        w, b = nw, nb
    w[np.abs(w) < 1e-3] = 0
    m = margins(w, b)[held]
    heat = np.geomspace(0.1, 10, 80)
    loss = [-np.log(np.maximum(probability(m * x)[np.arange(held.sum()), y[held]], 1e-12)).mean() for x in heat]
    kept = np.flatnonzero(np.abs(w).max(axis=1) > 0)
    return {"feature": np.flatnonzero(use)[kept].tolist(), "weight": w[kept].ravel().tolist(), "bias": b.tolist(),
            "heat": float(heat[int(np.argmin(loss))])}


def train(docs: DataFrame, negatives: int = NEGATIVES) -> dict:
    """Fit in one task on the notices and at most about ``negatives`` paragraphs of the corpus."""
    rows = docs.agg(F.count("*")).first()[0]
    draw = F.pmod(F.xxhash64("doc_id", F.lit(29)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = docs.filter(draw < min(1.0, negatives / 4 / max(rows, 1))).select("doc_id", "text")

    def run(batches):
        found = []
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                lines = [x for x in (text or "").split("\n") if x.strip()]
                lines = lines[:: max(1, len(lines) // 4)][:4]  # spread over the text
                found += [(doc, k, x) for k, x in enumerate(lines)
                          if not resembles(pairs(x))]
        yield pa.RecordBatch.from_pylist([fit([x for _, _, x in sorted(found, key=lambda f: (f[0] is None, f[0] or 0, *f[1:]))])])

    model = sample.repartition(1).transform(common.in_tasks, run, "feature array<long>, weight array<double>, bias array<double>, heat double").first() or fit([])
    return {"feature": np.array(model["feature"], np.int64), "bias": np.array(model["bias"]), "heat": model["heat"],
            "weight": np.array(model["weight"]).reshape(-1, len(CLASSES))}


RESULT = (("n_paragraphs", "long"), ("n_licensed", "long"), ("license", "string"), ("probability", "double"),
          ("similarity", "double"), ("families", "string"))


def license_scan(docs: DataFrame, model: dict) -> DataFrame:
    """``docs`` without the text, with the licence columns of ``RESULT``."""
    names = [n for n, _ in RESULT]
    carried = [c for c in docs.columns if c not in ("text", *names)]
    schema = docs.select(*carried).schema
    for name, kind in RESULT:
        schema = schema.add(name, kind)

    def judge(par, feature, n, place, weight):
        """Best class and its probability of each of ``n`` paragraphs."""
        m = np.stack([np.bincount(par, weight[place[feature], k], minlength=n) for k in range(len(CLASSES))], axis=1)
        m = (m + model["bias"]) * model["heat"]
        e = np.exp(m - m.max(axis=1, keepdims=True))
        p = e / e.sum(axis=1, keepdims=True)
        return p.argmax(axis=1), p.max(axis=1)

    def scan(buf, off, place, weight):
        """Per text: lines, and (probability, family, similarity) of the confirmed paragraphs."""
        start, end, own = paragraphs(buf, off)
        hits: list[list] = [[] for _ in range(len(off) - 1)]
        if len(start):
            found = []

            def confirm(lines, best, p):
                for i in np.flatnonzero((best < len(FAMILIES)) & (p >= MIN_PROBABILITY)):
                    lo, hi = lines(i)
                    family = FAMILIES[best[i]]
                    alike = similarity(family, pairs(buf[start[lo]:end[hi]].tobytes().decode("utf-8", "replace")))
                    if alike >= MIN_SIMILARITY:
                        found.append((-alike, hi - lo, -float(p[i]), lo, family))

            par, feature = features(buf, start, end, place >= 0)
            confirm(lambda i: (i, i), *judge(par, feature, len(start), place, weight))
            runs = runs_of_lines(buf, off, start)
            if runs:
                feature = of_texts([buf[start[a]:end[b]].tobytes() for a, b in runs], place >= 0)
                par = np.repeat(np.arange(len(runs)), [len(f) for f in feature])
                confirm(lambda i: runs[i], *judge(par, np.concatenate(feature), len(runs), place, weight))
            taken: set[int] = set()
            for alike, more, p, lo, family in sorted(found):
                lines = range(lo, lo + more + 1)
                if taken.isdisjoint(lines):
                    taken.update(lines)
                    hits[own[lo]].append((p, family, -alike))
        return np.bincount(own, minlength=len(off) - 1), hits

    def run(batches):
        place = np.full(DIMS, -1)
        place[model["feature"]] = np.arange(len(model["feature"]))
        for batch in batches:
            for lo, hi, buf, off in common.text_chunks(batch):
                count, hits = scan(buf, off, place, model["weight"])
                top = [min(h) if h else None for h in hits]
                arrays = [batch.column(batch.schema.get_field_index(c)).slice(lo, hi - lo) for c in carried]
                arrays += [pa.array(count, pa.int64()), pa.array([len(h) for h in hits], pa.int64()),
                           pa.array([t and t[1] for t in top], pa.string()), pa.array([t and -t[0] for t in top], pa.float64()),
                           pa.array([t and t[2] for t in top], pa.float64()),
                           pa.array([",".join(sorted({x[1] for x in h})) for h in hits], pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, names=[*carried, *names])

    return docs.select(*carried, "text").transform(common.in_tasks, run, schema)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir).select("doc_id", "text")
    return license_scan(docs, train(docs))
