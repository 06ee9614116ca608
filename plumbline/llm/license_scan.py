"""License scans: MinHash bands over overlapping text windows, then exact containment.

Words are runs of letters and digits, A-Z lower-cased, and shingles are five words. A
template of m shingles belongs to the class of the next power of two c; windows of the class
hold 2 * c shingles and begin at every c-th, so that any c shingles in a row lie in one. A
window that contains a template to the wanted share has a known least Jaccard similarity
with it, and the class has as many one-row bands as make a miss of all less likely than
MISS. A window and a template that agree in a band are compared on their full sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import small_batches
from plumbline.llm.wordhash import U64, Words, slices, split_words

SHINGLE = 5
SHARE = 0.8
MISS = 1e-6

#: Full texts by license: LICENSE.txt in the folder licenses.
TEXTS = {f"{p.stem}-text": p.read_text("utf-8") for p in sorted((Path(__file__).parent / "licenses").glob("*.txt"))}


def _notices() -> dict[str, str]:
    """Usual notices of license families.

    Where licenses or versions differ in a word, the notice is its part of at most four
    shingles around that word: all of these must match, so that none is taken for another.
    """
    out = {f"GNU-{v}-or-later": f"either version {v} of the License" for v in ("1", "2", "2.1", "3")}
    out |= {f"GNU-{v}": f"Free Software Foundation, version {v} of the License" for v in ("2", "2.1", "3")}
    for short, name, versions in (("GPL", "GNU General Public License", ("2.0", "3.0")), ("LGPL", "GNU Lesser General Public License", ("2.1", "3.0")), ("AGPL", "GNU Affero General Public License", ("3.0",))):
        out[f"{short}-notice"] = f"terms of the {name}"
        for v in versions:
            out[f"{short}-{v}-sentence"] = f"{name}, version {v.removesuffix('.0')}"
            out |= {f"{short}-{v}-{k}-spdx": f"SPDX-License-Identifier: {short}-{v}-{k}" for k in ("only", "or-later")}
    parts = {"by": "Attribution", "nc": "NonCommercial", "nd": "NoDerivatives", "sa": "ShareAlike"}
    for kind in ("by", "by-sa", "by-nc", "by-nd", "by-nc-sa", "by-nc-nd"):
        name = "-".join(parts[k] for k in kind.split("-"))
        for version, port in (("4.0", "International"), ("3.0", "Unported")):
            key = f"CC-{kind.upper()}-{version}"
            out[f"{key}-notice"] = f"licensed under a Creative Commons {name} {version} {port} License"
            if key != "CC-BY-NC-4.0":  # below
                out[f"{key}-short"] = f"Licensed under CC {kind.upper()} {version}"
            out[f"{key}-url"] = f"creativecommons.org/licenses/{kind}/{version}"
    out |= {f"{k}-spdx": f"SPDX-License-Identifier: {k}" for k in ("Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "EPL-2.0", "MPL-2.0", "CC0-1.0")}
    return out


#: What the queries look for: fixed sentences, usual notices and full texts.
TEMPLATES = _notices() | TEXTS | {
    "MPL-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "EPL-2.0-notice": "terms of the Eclipse Public License 2.0",
    "EPL-1.0-notice": "terms of the Eclipse Public License v1.0",
    "BSD-style-notice": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "CC0-1.0-url": "creativecommons.org/publicdomain/zero/1.0",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MIT-permission": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software',
}

_rng = np.random.Generator(np.random.PCG64(11))
_XOR = _rng.integers(0, 1 << 32, 1024, dtype=np.uint32)
_ODD = _rng.integers(0, 1 << 32, 1024, dtype=np.uint32) | np.uint32(1)


def plain_words(texts: pa.Array) -> Words:
    """The words that are letters and digits."""
    words = split_words(texts, lower=True, signs=True)
    first = words.data[words.start] if len(words.start) else np.zeros(0, np.uint8)
    lettered = (first > 0x7F) | ((first >= 48) & (first < 58)) | ((first | 0x20) >= 97) & ((first | 0x20) < 123)
    kept = np.append(0, np.cumsum(lettered))
    return Words(words.hashes[lettered], kept[words.first], words.start[lettered], words.end[lettered], words.data)


def _minhash(x: np.ndarray, band: int) -> np.ndarray:
    return (x ^ _XOR[band]) * _ODD[band]


class Scanner:
    """Templates by class, with their bands."""

    def __init__(self, templates: dict[str, str], share: float = SHARE, miss: float = MISS):
        self.names = sorted(templates)
        words = plain_words(pa.array([templates[n] for n in self.names]))
        grams, at = words.grams(SHINGLE)
        text = words.text_of(at)
        self.sets = [np.unique(grams[text == i]) for i in range(len(self.names))]
        if any(not len(s) for s in self.sets):
            raise ValueError(f"a template has at least {SHINGLE} words")
        self.need = [math.ceil(share * len(s) - 1e-9) for s in self.sets]
        self.classes: dict[int, list[int]] = {}
        for i, s in enumerate(self.sets):
            self.classes.setdefault(1 << (len(s) - 1).bit_length(), []).append(i)
        self.bands = {
            c: max(math.ceil(math.log(miss) / math.log1p(-self.need[i] / (2 * c + len(self.sets[i]) - self.need[i]))) for i in own)
            for c, own in self.classes.items()
        }
        self.minima = {i: [_minhash((s >> U64(32)).astype(np.uint32), b).min() for b in range(self.bands[c])] for c, own in self.classes.items() for i in own for s in [self.sets[i]]}

    def scan(self, texts: pa.Array) -> dict[str, np.ndarray]:
        """The best window of each text and template that match: text, template, matched, start, end."""
        words = plain_words(texts)
        grams, at = words.grams(SHINGLE)
        text = words.text_of(at)
        first = np.searchsorted(text, np.arange(len(texts) + 1))
        found: list[tuple[int, ...]] = []
        if len(grams):
            x = (grams >> U64(32)).astype(np.uint32)
            starts = {c: np.concatenate([np.arange(a, b, c) for a, b in zip(first[:-1], first[1:], strict=True)]) if c > 1 else np.arange(len(grams)) for c in self.classes}
            hits = {i: np.zeros(len(starts[c]), bool) for c, own in self.classes.items() for i in own}
            for band in range(max(self.bands.values())):
                values = _minhash(x, band)
                for c, own in self.classes.items():
                    if band < self.bands[c]:
                        low = np.minimum.reduceat(values, starts[c]) if c > 1 else values
                        for i in own:
                            hits[i] |= low == self.minima[i][band]
            for c, own in self.classes.items():
                block_text = text[starts[c]]
                for i in own:
                    block = np.flatnonzero(hits[i])  # blocks with a band's minimum; windows hold two
                    windows = np.unique(np.concatenate([block, block[block > 0] - 1]))
                    found += self._verified(i, c, windows, starts[c], block_text, grams, first)
        best: dict[tuple[int, int], tuple[int, ...]] = {}
        for t, i, matched, a, b in found:
            if (t, i) not in best or matched > best[t, i][0]:
                best[t, i] = (matched, a, b)
        rows = np.array([(t, i, *v) for (t, i), v in sorted(best.items())], np.int64).reshape(-1, 5)
        return dict(zip(("text", "template", "matched", "start", "end"), rows.T, strict=True))

    def _verified(self, i, c, windows, starts, block_text, grams, first):
        wanted = self.sets[i]
        for w in windows.tolist():
            a, t = int(starts[w]), int(block_text[w])
            b = min(a + 2 * c, int(first[t + 1]))
            held = np.flatnonzero(np.isin(grams[a:b], wanted))
            matched = len(np.unique(grams[a:b][held]))
            if matched >= self.need[i]:
                base = a - int(first[t])
                yield t, i, matched, base + int(held[0]), base + int(held[-1]) + SHINGLE


def scan(docs: DataFrame, templates: dict[str, str] | None = None, share: float = SHARE, miss: float = MISS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, license, containment, start and end: a row for each document and template it holds.

    A document holds a template if one of its windows contains at least share of the
    template's shingles; containment is that of the best (then first) window, and start and
    end are the span of the matching words, counted in words. Templates are few and known
    beforehand, so every task has them all. Null and empty text, and text of fewer than five
    words, holds none; a null id stays null; repeated rows give their rows each; an empty
    table gives none; other columns are not read.
    """
    small_batches(docs.sparkSession)
    scanner = Scanner(TEMPLATES if templates is None else templates, share, miss)
    schema = "doc_id long, license string, containment double, start long, end long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, sizes = np.array(scanner.names, object), np.array([len(s) for s in scanner.sets])
        for batch in batches:
            for part in slices(batch, "text"):
                got = scanner.scan(part.column("text"))
                if len(got["text"]):
                    yield pa.RecordBatch.from_arrays(
                        [part.column("doc_id").take(pa.array(got["text"])), pa.array(names[got["template"]], pa.string()), pa.array(got["matched"] / sizes[got["template"]]), pa.array(got["start"]), pa.array(got["end"])],
                        ["doc_id", "license", "containment", "start", "end"],
                    )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
