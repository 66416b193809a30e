"""Licence scan: Dice coefficient over word bigrams against licence templates."""

from __future__ import annotations

import heapq
from collections.abc import Mapping
from itertools import groupby
from math import ceil
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import UPPER, rows_of

#: Notices and short licence texts by SPDX identifier and form.
TEMPLATES = {
    "MIT:notice": "Released under the MIT License.",
    "MIT:licensed": "Licensed under the MIT License.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "Apache-2.0:notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0:header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n\nhttp://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "GPL-2.0:notice": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0:notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0:header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.\n\nThis program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "GPL-2.0:header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.\n\nThis program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "LGPL-2.1:header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.\n\nThis library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    "LGPL-3.0:header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.\n\nThis program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    "AGPL-3.0:header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.\n\nThis program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.",
    "MPL-2.0:header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "CC-BY-4.0:notice": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0:notice": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0:notice": "Licensed under CC BY-NC 4.0.",
    "CC0-1.0:notice": "Released into the public domain under CC0 1.0.",
}



def default_templates() -> dict[str, str]:
    """``TEMPLATES`` and the full texts of the long licences, one file each."""
    texts = sorted(Path(__file__).with_name("license_texts").glob("*.txt"))
    return TEMPLATES | {p.stem: p.read_text(encoding="utf-8") for p in texts}


_WORDS = bytes((b + 32 if chr(b) in UPPER else b) if chr(b).isalnum() and b < 128 else 32 for b in range(256))


def pairs(text: bytes) -> list[tuple[bytes, bytes]]:
    """Pairs of neighbouring words; words are runs of ASCII letters and digits, in lower case."""
    words = text.translate(_WORDS).split()
    return list(zip(words, words[1:]))


class Matcher:
    def __init__(self, templates: Mapping[str, str], threshold: float):
        self.threshold = threshold
        texts = {k: p for k, v in templates.items() if (p := pairs(v.encode()))}
        self.templates = {k: frozenset(p) for k, p in texts.items()}
        self.known = frozenset().union(*self.templates.values()) if self.templates else frozenset()
        # Dice is at least t only if a part has t / (2 - t) of the template's bigrams, and the sizes are within that factor
        r = (2 - threshold) / threshold
        self.need = {k: max(1, ceil(len(g) / r - 1e-9)) for k, g in self.templates.items()}
        self.most = {k: int(len(p) * r + 1e-9) for k, p in texts.items()}
        self.least = min(self.need.values(), default=1)

    def windows(self, own: list[tuple[bytes, bytes]], before: np.ndarray, k: str) -> list[tuple[int, float, int, int, str]]:
        """(common bigrams, Dice, first, last, template) of the best windows that don't overlap. A window starts and ends
        at a bigram of the template, as it's nearer to it without other ends.

        ``before`` is where each bigram was last. Starts wait in a heap with a bound of their score, from the template's
        bigrams within reach; a start is only scored when no other can be better, and not if it is in a chosen window.
        """
        g, need, most = self.templates[k], self.need[k], self.most[k]
        inside = np.fromiter((p in g for p in own), bool, len(own))
        at = np.flatnonzero(inside)
        # an occurrence is new in the windows that start after the one before it and reach it
        reach = np.zeros(len(own) + 1, np.int64)
        np.add.at(reach, np.maximum(before[at] + 1, at - most + 1), 1)
        np.add.at(reach, at + 1, -1)
        near = np.cumsum(reach)[at]
        heap = [(-2.0 * n / (n + len(g)), -len(own) - 1, i, 0) for i, n in zip(at.tolist(), near.tolist()) if n >= need]
        heapq.heapify(heap)
        out, taken = [], bytearray(len(own))
        while heap:
            score, common, first, last = heapq.heappop(heap)
            if -score < self.threshold:
                break
            if taken[first]:
                continue
            if common < -len(own):
                new = before[first : first + most] < first
                seen, own_common = np.cumsum(new), np.cumsum(new & inside[first : first + most])
                ends = np.flatnonzero(new & inside[first : first + most])
                scores = 2 * own_common[ends] / (seen[ends] + len(g))
                best = len(scores) - 1 - int(scores[::-1].argmax())
                heapq.heappush(heap, (-float(scores[best]), -int(own_common[ends[best]]), first, -(first + int(ends[best]))))
            elif taken.find(1, first, 1 - last) < 0:
                taken[first : 1 - last] = b"\1" * (1 - last - first)
                out.append((-common, -score, first, -last, k))
        return out

    def document(self, text: bytes) -> dict[str, float]:
        """Best score of each template over the windows of a text. Of windows that overlap, the one with the most bigrams
        in common with its template stays, then the nearest; equal ones all stay."""
        own = pairs(text)
        common = self.known.intersection(own)
        if len(common) < self.least:
            return {}
        likely = [k for k, g in self.templates.items() if len(common & g) >= self.need[k]]
        if not likely:
            return {}
        last: dict[tuple[bytes, bytes], int] = {}
        before = np.empty(len(own), np.int64)
        for i, p in enumerate(own):
            before[i] = last.get(p, -1)
            last[p] = i
        found = [w for k in likely for w in self.windows(own, before, k)]
        best: dict[str, float] = {}
        taken = bytearray(len(own))
        for (_, score, first, last), equal in groupby(sorted(found, reverse=True), key=lambda w: w[:4]):
            if taken.find(1, first, last + 1) < 0:
                taken[first : last + 1] = b"\1" * (last + 1 - first)
                for *_, k in equal:
                    best[k] = max(score, best.get(k, 0.0))
        return best


def license_matches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: Mapping[str, str] | None = None, threshold: float = 0.8) -> DataFrame:
    """``doc_id, template, license, dice``: one row for each document and template that a part of its text matches.

    Text is normalised to lower-case ASCII words, whatever lines, paragraphs and comment marks it has. Windows of it are
    compared with the templates by the Dice coefficient over sets of word bigrams: every window whose length is at most
    (2 - t) / t of the template's. A text is only looked through for templates of which it has t / (2 - t) of the bigrams,
    as no part of another reaches the threshold t. Where windows overlap, the text counts for the template with which it
    has the most in common, so a notice of one version isn't one of another, nor a part of a licence another licence. The
    score is the best over the windows. ``license`` is the template's name up to a colon.

    Null and empty texts, and parts of one word, match nothing. Repeated rows give repeated results; an empty table gives
    none. Very long texts are looked through whole. A null identifier stays null. No shuffle; other columns are not looked
    at, whatever their names. Memory is bounded by the longest text.
    """
    chosen = default_templates() if templates is None else dict(templates)

    def task(batches):
        m = Matcher(chosen, threshold)
        for batch in batches:
            for ids, texts in rows_of(batch, ["id", "text"]):
                found = [(i, k, k.split(":")[0], v) for i, t in zip(ids, texts) if t for k, v in sorted(m.document(t).items())]
                cols = list(zip(*found)) if found else [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, [pa.int64(), pa.string(), pa.string(), pa.float64()])], ["doc_id", "template", "license", "dice"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(task, "doc_id long, template string, license string, dice double")
