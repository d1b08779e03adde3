"""License scans by conditional compression (operator 9).

Every word that speaks of licences is the middle of a block for each template, cut at the template's own length to both sides
over line ends, so neither a long line nor a wrapped one hides a notice. A block with the words that tell the licence apart
(names and version numbers) is compressed by zstandard alone and again with the template as a raw dictionary; the bytes
saved, against the template's own, tell how much of its wording the block repeats. Every template above the bound is confirmed
or refused by the exact difference of wording: the block's words against the template's, aligned. All matches that do not
overlap are kept, those with the fewest changes first.

Defined results: a null text has no blocks; documents without a confirmed block have an empty list, so every row of
the input has one row in the result; null and repeated ids are kept; offsets are code points.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from dataclasses import dataclass
from difflib import SequenceMatcher

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import byte_chunks, map_arrow


@dataclass(frozen=True)
class Template:
    """``marks``: words of the template that a block must share exactly."""

    license_id: str
    text: str
    marks: tuple[str, ...]


# Parts that licence texts share.
_MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_AS_IS_MIT = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_AS_IS_ISC = "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_AS_IS_BSD = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
#: Texts and notices of public licences, as their stewards word them or as they are commonly written in one line. Long texts stand whole.
TEMPLATES = [
    Template("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", ("apache", "2.0")),
    Template("Apache-2.0", "Licensed under the Apache License, Version 2.0.", ("apache", "2.0")),
    Template("MIT", "Released under the MIT License.", ("mit",)),
    Template("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction", ("granted", "charge", "restriction")),
    Template("GPL-3.0", "This work is licensed under the GNU General Public License, version 3.", ("gnu", "general", "public", "3")),
    Template("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", ("gnu", "general", "3")),
    Template("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.", ("gnu", "general", "2")),
    Template("GPL-2.0", "This work is licensed under the GNU General Public License, version 2.", ("gnu", "general", "public", "2")),
    Template("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3.", ("gnu", "lesser", "3")),
    Template("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3.", ("gnu", "affero", "3")),
    Template("CC-BY-4.0", "Licensed under CC BY 4.0.", ("cc", "by", "4.0")),
    Template("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0.", ("cc", "by-sa", "4.0")),
    Template("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0.", ("cc", "by-nc", "4.0")),
    Template("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0.", ("cc", "by-nc-sa", "4.0")),
    Template("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License.", ("creative", "attribution", "4.0", "international")),
    Template("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", ("waived", "copyright", "neighboring")),
    Template("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ("redistribution", "binary", "permitted")),
    Template("MIT", f"{_MIT} {_AS_IS_MIT}", ("granted", "charge", "restriction", "noninfringement")),
    Template("ISC", f"Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. {_AS_IS_ISC}", ("fee", "granted", "appear", "disclaims")),
    Template("0BSD", f"Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. {_AS_IS_ISC}", ("fee", "granted", "disclaims")),
    Template("BSD-2-Clause", f"{_BSD} {_AS_IS_BSD}", ("redistributions", "binary", "disclaimer", "liability")),
    Template("BSD-3-Clause", f"{_BSD} 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. {_AS_IS_BSD}", ("redistributions", "binary", "endorse", "liability")),
    Template("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.", ("as-is", "misrepresented", "altered")),
    Template("BSL-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following", ("granted", "organization", "reproduce", "third-parties")),
    Template("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.", ("unencumbered", "public", "domain")),
    Template("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0", ("eclipse", "2.0")),
    Template("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.", ("gnu", "lesser", "2.1")),
    Template("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", ("gnu", "lesser", "3")),
    Template("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", ("gnu", "affero", "3")),
    Template("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", ("mozilla", "2.0")),
]

#: Words about one of these may hold a notice (checked without regard to case).
_CUE = r"(?i)licen[cs]|copyright|permission|redistribut|creative\s+commons|cc[\s-]+by|free\s+software|waived|unencumbered|as-is"
_CUE_PY = re.compile(_CUE)
_WORD = re.compile(r"[0-9A-Za-z](?:[0-9A-Za-z.\-]*[0-9A-Za-z])?")


def wording(text: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(text)]


@dataclass(frozen=True)
class Match:
    license_id: str
    start: int
    end: int
    saved: float
    added: int
    missing: int


class Scanner:
    """Compressors, one for each template; made once per task."""

    def __init__(self, templates: list[Template], least_saved: float = 0.15, most_changed: float = 0.2):
        import zstandard as z

        self.templates, self.least_saved, self.most_changed = templates, least_saved, most_changed
        make = lambda **k: z.ZstdCompressor(level=3, write_content_size=False, write_checksum=False, write_dict_id=False, **k)
        self.plain = make()
        self.given = [make(dict_data=z.ZstdCompressionDict(self.normal(t.text), dict_type=z.DICT_TYPE_RAWCONTENT)) for t in templates]
        self.alone = [len(self.plain.compress(self.normal(t.text))) for t in templates]
        self.words = [wording(t.text) for t in templates]
        self.marks = [frozenset(t.marks) for t in templates]
        self.changes = [max(3, most_changed * len(w)) for w in self.words]

    @staticmethod
    def normal(text: str) -> bytes:
        return " ".join(text.lower().split()).encode()

    def saving(self, block: str, k: int) -> float:
        """The bytes that template k saves of the compressed block, as a share of its own compressed bytes."""
        data = self.normal(block)
        return (len(self.plain.compress(data)) - len(self.given[k].compress(data))) / self.alone[k]

    def confirm(self, block: str, at: int, k: int) -> tuple[int, int, int, int] | None:
        """(start, end, words between that the template lacks, words of the template that are missing), if close enough."""
        found = [(m.start(), m.end(), m[0].lower()) for m in _WORD.finditer(block)]
        words, want = [w for _, _, w in found], self.words[k]
        blocks = [b for b in SequenceMatcher(None, words, want, autojunk=False).get_matching_blocks() if b.size]
        if not blocks:
            return None
        # outer pieces of a word or two that lie far off belong to other text
        while len(blocks) > 1 and blocks[0].size <= 2 and blocks[1].a - blocks[0].a - blocks[0].size > 3:
            blocks.pop(0)
        while len(blocks) > 1 and blocks[-1].size <= 2 and blocks[-1].a - blocks[-2].a - blocks[-2].size > 3:
            blocks.pop()
        first, last = blocks[0].a, blocks[-1].a + blocks[-1].size
        same = sum(b.size for b in blocks)
        added, missing = last - first - same, len(want) - same
        shared = {w for b in blocks for w in words[b.a : b.a + b.size]}
        if added + missing > self.changes[k] or not shared.issuperset(self.templates[k].marks):
            return None
        return at + found[first][0], at + found[last - 1][1], added, missing

    def scan(self, text: str) -> list[Match]:
        found = list(_WORD.finditer(text))
        starts = [m.start() for m in found]
        words = [m[0].lower() for m in found]
        cues = sorted({max(bisect_right(starts, m.start()) - 1, 0) for m in _CUE_PY.finditer(text)}) if found else []
        out: list[Match] = []
        while more := self._matches(text, found, starts, words, cues, out):
            out += more
        return sorted(out, key=lambda m: m.start)

    def _matches(self, text: str, found: list[re.Match], starts: list[int], words: list[str], cues: list[int], taken: list[Match]) -> list[Match]:
        """Matches that do not overlap, about cues outside the taken ones, in blocks that end where a taken one begins."""
        ends = sorted((m.start, m.end) for m in taken)
        hits: dict[tuple[int, int, int], Match] = {}
        for c in cues:
            at = bisect_right(ends, (starts[c], len(text)))
            if at and starts[c] < ends[at - 1][1]:
                continue
            first = bisect_left(starts, ends[at - 1][1]) if at else 0
            last = bisect_left(starts, ends[at][0]) if at < len(ends) else len(words)
            for k, want in enumerate(self.words):
                reach = len(want) + int(self.changes[k])
                lo, hi = max(c - reach, first), min(c + reach + 1, last)
                if not self.marks[k].issubset(words[lo:hi]):
                    continue
                block = text[starts[lo] : found[hi - 1].end()]
                saved = self.saving(block, k)
                if saved < self.least_saved:
                    continue
                hit = self.confirm(block, starts[lo], k)
                if hit and hit[0] <= starts[c] < hit[1]:
                    key = (hit[0], hit[1], k)
                    if key not in hits or hits[key].saved < saved:
                        hits[key] = Match(self.templates[k].license_id, hit[0], hit[1], round(saved, 4), hit[2], hit[3])
        out: list[Match] = []
        for m in sorted(hits.values(), key=lambda m: (m.added + m.missing, m.start - m.end, m.start, m.license_id)):
            if not any(m.start < o.end and o.start < m.end for o in out):
                out.append(m)
        return out


def scan_licenses(docs: DataFrame, templates: list[Template] | None = None) -> DataFrame:
    """(doc_id, n_licenses, license_ids, found array<struct<license_id, start, end, saved, added, missing>>) for every document."""
    templates = templates or TEMPLATES
    arrow = pa.list_(pa.struct([("license_id", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("saved", pa.float64()), ("added", pa.int64()), ("missing", pa.int64())]))
    made: dict[str, Scanner] = {}

    def scan(batch: pa.RecordBatch) -> list[pa.RecordBatch]:
        scanner = made.get("s") or made.setdefault("s", Scanner(templates))
        out = []
        for part in byte_chunks(batch):
            text = part.column("text")
            cued = pc.fill_null(pc.match_substring_regex(text, _CUE), False).to_pylist()
            found = [[vars(m) for m in scanner.scan(text[i].as_py())] if cued[i] else [] for i in range(part.num_rows)]
            out.append(pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found, arrow)], ["doc_id", "found"]))
        return out

    schema = "doc_id long, found array<struct<license_id:string,start:bigint,end:bigint,saved:double,added:bigint,missing:bigint>>"
    rows = map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), scan, schema)
    names = F.array_join(F.array_sort(F.array_distinct(F.col("found.license_id"))), ",")
    return rows.select("doc_id", F.size("found").cast("long").alias("n_licenses"), names.alias("license_ids"), "found")
