"""Licence scans: every word window of a text against licence templates by Dice over word bigrams.

Words are folded to lower case without punctuation; the bigrams of a window and those of a
template are compared as multisets, ``2 * common / (own + theirs)``. Windows lie anywhere in a
text, whatever lines, sentences or paragraphs they cross; texts, paragraphs, lines and sentences are
windows too. A window of ``a`` bigrams can reach ``least`` only with templates of
``a * least / (2 - least)`` to ``a * (2 - least) / least`` bigrams, and only if as many of its bigrams as
the shortest such window has occur in the template. Starts with fewer are passed over; from the
others all windows are compared exactly. A window that begins or ends with a bigram that is not
common overlaps a shorter one of higher coefficient and cannot stay.

Of windows that overlap the one of the higher coefficient stays, of equals the longer one, then
the earlier one, then the first template by name.

Defined results: a null text, one without words or with one word only has no match.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from themeloom.llm.tokens import batch_udf, text_bytes, window_hashes, words_of

LEAST = 0.85

FOUND = "array<struct<licence: string, dice: double, word: int, words: int>>"

# Notices of common licences, as their publishers word them.
TEMPLATES = [
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("MIT", "Released under the MIT License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
]


# Windows compared at a time: starts times sizes.
CELLS = 1 << 20


class Templates:
    def __init__(self, templates: list[tuple[str, str]], least: float):
        self.least = least
        self.names = [name for name, _ in templates]
        words = words_of(*text_bytes(pa.array([t for _, t in templates], pa.string())))
        bigrams = [Counter(window_hashes(words.hash[a:b], 2).tolist()) for a, b in zip(words.first[:-1], words.first[1:])]
        self.sizes = np.array([sum(b.values()) for b in bigrams], int)
        self.known = np.unique(np.array(sorted(set().union(*bigrams)), np.uint64))
        self.counts = np.array([[b.get(g, 0) for g in self.known.tolist()] for b in bigrams], np.int64)


def _windows(at: np.ndarray, which: np.ndarray, counts: np.ndarray, size: int, stop: np.ndarray, least: float):
    """Coefficient, first bigram and size of the windows that reach ``least`` with a template.

    ``at`` and ``which`` are place and number of the bigrams that the template has ``counts`` of, in
    order; ``stop`` is the end of the bigrams of their texts.
    """
    most = int(size * (2 - least) / least + 1e-9)
    fewest = int(np.ceil(size * least / (2 - least) - 1e-9))
    starts = np.flatnonzero(np.searchsorted(at, np.minimum(at + most, stop)) - np.arange(len(at)) >= max(fewest, 1))
    if not len(starts):
        return
    # A bigram counts in a window unless the window holds as many equal ones before it as the template has.
    order = np.lexsort((at, which))
    group, place, own = which[order], at[order], counts[which[order]]
    before = np.full(len(at), -1)
    k = np.arange(len(at)) - own
    same = (k >= 0) & (group[np.maximum(k, 0)] == group)
    before[order] = np.where(same, place[np.maximum(k, 0)], -1)
    for low in range(0, len(starts), max(1, CELLS // most)):
        rows = starts[low : low + max(1, CELLS // most)]
        # The template's bigrams from each start on: at most as many as the longest window has.
        cells = rows[:, None] + np.arange(most)
        inside = cells < len(at)
        cells = np.minimum(cells, len(at) - 1)
        first = at[rows][:, None]
        inside &= at[cells] < np.minimum(first + most, stop[rows][:, None])
        counted = inside & (before[cells] < first)
        common = np.cumsum(counted, axis=1)
        own_size = at[cells] - first + 1
        dice = 2 * common / (own_size + size)
        r, c = np.nonzero(counted & (dice >= least))
        yield dice[r, c], at[rows][r], own_size[r, c]


def scan(column: pa.Array, templates: Templates) -> list[list[dict]]:
    words = words_of(*text_bytes(column))
    out: list[list[dict]] = [[] for _ in range(len(column))]
    if len(words.hash) < 2:
        return out
    pairs = window_hashes(words.hash, 2)
    where = np.searchsorted(templates.known, pairs)
    where[where == len(templates.known)] = 0
    at = np.flatnonzero(templates.known[where] == pairs)
    stop = words.first[np.searchsorted(words.first, at, "right")] - 1
    # A pair of the last word of a text and the first one of the next is no bigram.
    at, stop = at[at < stop], stop[at < stop]
    which = where[at]
    parts = []
    rank = np.argsort(np.argsort(np.array(templates.names), kind="stable"))
    for k, counts in enumerate(templates.counts):
        own = counts[which] > 0
        for dice, first, size in _windows(at[own], which[own], counts, int(templates.sizes[k]), stop[own], templates.least):
            parts.append((dice, first, size, np.full(len(dice), k)))
    if not parts:
        return out
    dice, first, size, k = (np.concatenate(x) for x in zip(*parts))
    taken = bytearray(len(words.hash))
    kept = []
    for i in np.lexsort((rank[k], first, -size, -dice)).tolist():
        a, b = int(first[i]), int(first[i] + size[i]) + 1
        if taken.find(1, a, b) < 0:
            taken[a:b] = b"\1" * (b - a)
            kept.append((a, b, float(dice[i]), templates.names[k[i]]))
    for a, b, value, name in sorted(kept):
        owner = int(np.searchsorted(words.first, a, "right")) - 1
        out[owner].append({"licence": name, "dice": value, "word": a - int(words.first[owner]), "words": b - a})
    return out


def licences(text: Column, templates: list[tuple[str, str]] | None = None, least: float = LEAST) -> Column:
    """Licence notices of a text: name, coefficient, first word and number of words."""
    chosen = templates or TEMPLATES
    made: list[Templates] = []

    def find(column: pa.Array) -> pa.Array:
        if not made:
            made.append(Templates(chosen, least))
        kind = pa.struct([("licence", pa.string()), ("dice", pa.float64()), ("word", pa.int32()), ("words", pa.int32())])
        return pa.array(scan(column, made[0]), pa.list_(kind))

    return batch_udf(FOUND, find)(text)
