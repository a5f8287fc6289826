"""License scans by conditional compression.

Blocks that mention licensing are cut out of each text. Around every run of mentions lies a candidate
window, one for short wordings and one for whole texts, so lines of any length cost the same for each
mention. A window is compressed once on its own and once with every template as a zstandard raw
dictionary, and templates are ranked by the bytes that saves. From the top they are confirmed by exact
wording differences: the words of the template that the window lacks and the words it puts in their
place, none of which may name a license. A confirmed wording ends the search once no template left is
long enough to fit better.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F, types as T

from .common import slices

# License texts, as their authors word them.
_AS_IS = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, "
    "and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _AS_IS
)
_ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
    "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_BSD_START = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_END = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. "
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
    "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_ZLIB = (
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: "
    "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."
)
_APACHE_NOTICE = (
    "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
    "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
)
_GNU_NOTICE = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version. "
    "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details."
)
_UNLICENSE = (
    "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
)
#: SPDX names that a tag may give.
SPDX = (
    "MIT Apache-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later AGPL-3.0-only AGPL-3.0-or-later "
    "MPL-2.0 EPL-2.0 BSD-2-Clause BSD-3-Clause ISC Zlib BSL-1.0 Unlicense CC0-1.0 CC-BY-4.0 CC-BY-SA-4.0 CC-BY-NC-4.0"
).split()

#: Names that are used without a version, as short wordings have them.
LOOSE = ("MIT", "BSD", "GPL", "LGPL", "AGPL", "ISC", "Zlib", "Unlicense", "EUPL-1.2", "Artistic-2.0", "EPL-1.0", "CDDL-1.0")
#: Words that tell one license from another. A wording has its template's, and no other.
NAMES = frozenset("mit apache gnu gpl lgpl agpl lesser affero mozilla mpl bsd isc zlib boost eclipse epl creative commons cc cc0 unlicense european eupl artistic academic microsoft apple netscape cddl wtfpl postgresql openssl php".split())

# Wordings by which licenses are granted, by SPDX name.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0-only", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0-only", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("MIT", "The MIT License (MIT)"),
    ("MIT", _MIT),
    ("ISC", _ISC),
    ("BSD-2-Clause", _BSD_START + _BSD_END),
    ("BSD-3-Clause", _BSD_START + _BSD_THIRD + _BSD_END),
    ("Zlib", _ZLIB),
    ("Apache-2.0", _APACHE_NOTICE),
    ("GPL-2.0-or-later", _GNU_NOTICE.format(name="General Public License", version="2")),
    ("GPL-3.0-or-later", _GNU_NOTICE.format(name="General Public License", version="3")),
    ("LGPL-3.0-or-later", _GNU_NOTICE.format(name="Lesser General Public License", version="3")),
    ("AGPL-3.0-or-later", _GNU_NOTICE.format(name="Affero General Public License", version="3")),
    ("Unlicense", _UNLICENSE),
    ("BSL-1.0", "Boost Software License - Version 1.0"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("EUPL-1.2", "Licensed under the European Union Public Licence, version 1.2"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("Apache-2.0", "Apache License Version 2.0"),
    ("GPL-3.0-only", "GNU General Public License version 3"),
    ("GPL-2.0-only", "GNU General Public License version 2"),
    *((name, f"SPDX-License-Identifier: {name}") for name in (*SPDX, "EUPL-1.2")),
    *((name, form.format(name)) for name in dict.fromkeys((*SPDX, *LOOSE)) for form in ("License: {}", "{} License", "Licensed under {}", "Licensed under the {} License")),
)
#: Short names as they are said after "or" and "and".
_SAID = {name.lower(): name for name in (*SPDX, *LOOSE)}

#: What a block must mention, for the JVM's filter and for the cut.
_CUE = r"licen[sc]e|permission\s{1,9}(?:is\s{1,9}hereby|to\s{1,9}use)|redistribut|public\s{1,9}domain|waived\s{1,9}all\s{1,9}copyright|spdx"
_MENTION = re.compile(_CUE, re.I)
_WORD = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*", re.U)

RESULT = T.StructType(
    [
        T.StructField("block_start", T.LongType()),
        T.StructField("block_end", T.LongType()),
        T.StructField("license", T.StringType()),
        T.StructField("template", T.IntegerType()),
        T.StructField("reduction", T.DoubleType()),
        T.StructField("words_missing", T.LongType()),
        T.StructField("words_changed", T.StringType()),
        T.StructField("exact", T.BooleanType()),
    ]
)


Templates = tuple[tuple[str, str], ...]


#: Templates of up to so many words are looked for in the narrow window.
_SHORT = 24


@lru_cache(maxsize=4)
def _compressors(templates: Templates):
    make = lambda **k: zstandard.ZstdCompressor(level=3, write_content_size=False, write_checksum=False, write_dict_id=False, **k)

    def with_dictionary(text: str):
        known = zstandard.ZstdCompressionDict(text.lower().encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        known.precompute_compress(level=3)
        return make(dict_data=known)

    return make(), [with_dictionary(" ".join(_WORD.findall(t))) for _, t in templates]


@lru_cache(maxsize=4)
def _wordings(templates: Templates) -> list[tuple[list[str], Counter, set[str], set[str]]]:
    """Words of each template, their counts, the telling words and the names among them."""
    want = [_WORD.findall(t.lower()) for _, t in templates]
    parts = lambda w: {x for y in w for x in (y, *re.split("[.-]", y))}
    telling = lambda w: {x for x in w if len(x) > 1 and any(c.isdigit() or c == "-" for c in x)} | ({x for x in w if x.isdigit()} if len(w) < 60 or "gnu" in w else set()) | (set(w) & NAMES)
    return [(w, Counter(w), telling(w), parts(w) & NAMES) for w in want]


def compare_wording(want: list[str], have: list[str]) -> tuple[int, list[str], int, int, tuple[int, int]]:
    """Template words missing, the changes, first and last (exclusive) word of the match, the anchor.

    The longest run of common words is the anchor. Before and after it a text may put twice the
    words that the template has there, so words scattered over long prose are no match.
    """
    match = SequenceMatcher(None, want, have, autojunk=False)
    at = match.find_longest_match()
    if not at.size:
        return len(want), [], 0, 0, (0, 0)
    low, high = max(0, at.b - 2 * at.a - 2), min(len(have), at.b + at.size + 2 * (len(want) - at.a - at.size) + 2)
    have = have[low:high]
    match.set_seq2(have)
    pieces = [m for m in match.get_matching_blocks() if m.size]
    first, last = pieces[0].b, pieces[-1].b + pieces[-1].size
    missing = len(want) - sum(m.size for m in pieces)
    # A word put in the place of the template's first or last ones belongs to the changes, not to the match.
    left, right = max(0, first - pieces[0].a), min(len(have), last + len(want) - pieces[-1].a - pieces[-1].size)
    changes = [f"{' '.join(want[a:b])}>{' '.join(have[max(c, left) : min(d, right)])}" for op, a, b, c, d in match.get_opcodes() if op != "equal" and (op != "insert" or first <= c < last)]
    return missing, [c for c in changes if c != ">"], low + first, low + last, (at.b, at.b + at.size)


def scan_words(words: list[str], mentions: list[int], templates: Templates = TEMPLATES, least_share: float = 0.7) -> list[tuple[int, float, int, list[str], int, int]]:
    """Confirmed wordings that do not overlap, in order: template, size reduction, words missing,
    changes, first and last (exclusive) word.

    ``words`` are in lower case, ``mentions`` the words where licensing is mentioned. A template is
    confirmed when ``least_share`` of its words are there in order, with every word that has a digit
    or hyphen or names a license, and when no other license is named between them.
    """
    plain, packers = _compressors(templates)
    wordings = _wordings(templates)
    kinds = [[i for i, w in enumerate(wordings) if (len(w[0]) <= _SHORT) == short] for short in (False, True)]
    names_in = lambda run: {x for y in run for x in (y, *re.split("[.-]", y))} & NAMES

    def laid(i: int, low: int, high: int) -> tuple | None:
        """The template at the first anchor where it is confirmed, trying longer anchors first."""
        want, counts, telling, names = wordings[i]
        parts = [(low, high)]
        while parts:
            low, high = parts.pop()
            have = words[low:high]
            held = Counter(have)
            if any(w not in held for w in telling) or sum(min(n, held[w]) for w, n in counts.items()) < least_share * len(want):
                continue
            missing, changes, first, last, (a, b) = compare_wording(want, have)
            # A short wording has few words of others between its own.
            between = last - first - (len(want) - missing)
            close = len(want) > _SHORT or between <= len(want) // 3
            if close and missing <= (1 - least_share) * len(want) and telling <= set(have[first:last]) and names_in(have[first:last]) <= names:
                return missing, changes, low + first, low + last
            if b:
                parts += [(low + b, high), (low, low + a)]
        return None

    def ranked(kind: list[int], low: int, high: int) -> list[tuple[int, float, int]]:
        """(bytes saved, reduction, template), most bytes first. None is left out: a window that says a
        wording twice saves nothing by knowing it."""
        data = " ".join(words[low:high]).encode()
        alone = len(plain.compress(data))
        out = [(alone - (n := len(packers[i].compress(data))), 1 - n / alone, i) for i in kind]
        return sorted(out, key=lambda x: (-x[0], x[2]))

    def best(kind: list[int], low: int, high: int) -> tuple | None:
        top = None
        for _, reduction, i in ranked(kind, low, high):
            n = len(wordings[i][0])
            if top is not None and n < top[0][0]:
                continue  # even all its words would fit less well
            if one := laid(i, low, high):
                missing, changes, first, last = one
                rank = (2 * (n - missing) - n - (last - first - n + missing), reduction, -i)
                if top is None or rank > top[0]:
                    top = rank, (i, reduction, missing, changes, first, last)
        return top

    found = []
    for kind in kinds:
        if not kind:
            continue
        reach = 2 * max(len(wordings[i][0]) for i in kind) + 4
        at = 0
        while at < len(mentions):
            last = at
            while last + 1 < len(mentions) and mentions[last + 1] <= mentions[last] + reach and mentions[last + 1] <= mentions[at] + 8 * reach:
                last += 1
            pending = [(max(0, mentions[at] - reach), min(len(words), mentions[last] + reach + 1))]
            at = last + 1
            while pending:
                low, high = pending.pop()
                # Every template has a word of licensing; a part without one holds none.
                if low < high and bisect_left(mentions, high) > bisect_left(mentions, low) and (top := best(kind, low, high)):
                    found.append(top)
                    pending += [(low, top[1][4]), (top[1][5], high)]
    out, used, lost = [], [], []

    def take(wording: tuple) -> bool:
        k = bisect_left(used, (wording[4], wording[5]))
        free = (k == 0 or used[k - 1][1] <= wording[4]) and (k == len(used) or wording[5] <= used[k][0])
        if free:
            used.insert(k, (wording[4], wording[5]))
            out.append(wording)
        return free

    for _, wording in sorted(found, key=lambda x: x[0], reverse=True):
        if not take(wording):
            lost.append((wording[4], wording[5]))
    # Where a wording had to give way, what is left of its words may hold another one.
    seen = set()
    while lost:
        first, last = lost.pop()
        k = bisect_left(used, (first, first))
        for j in range(max(0, k - 1), len(used) + 1):
            low, high = used[j - 1][1] if j else 0, used[j][0] if j < len(used) else len(words)
            if low >= last:
                break
            for kind in kinds if high > first else []:
                reach = 2 * max((len(wordings[i][0]) for i in kind), default=0) + 4
                part = max(low, first - reach), min(high, last + reach)
                if (part, len(kind)) in seen or not bisect_left(mentions, part[1]) > bisect_left(mentions, part[0]):
                    continue
                seen.add((part, len(kind)))
                if (top := best(kind, *part)) and take(top[1]):
                    lost += [(part[0], top[1][4]), (top[1][5], part[1])]
                    break
    return sorted(out, key=lambda x: x[4])


def said_beside(words: list[str], wording: tuple, limit: int) -> list[tuple[str, int, int]]:
    """Licenses that a short wording goes on to name: MIT or GPL, MIT OR Apache-2.0 (name, first, last word)."""
    out, at = [], wording[5]
    while at + 1 < limit and words[at] in ("or", "and"):
        to = at + 2 if words[at + 1] in ("the", "a") and at + 2 < limit else at + 1
        if words[to] not in _SAID:
            break
        out.append((_SAID[words[to]], to, to + 1))
        at = to + 1
    return out


def _scan(text: str, templates: Templates, least_share: float = 0.7) -> tuple[list[tuple], list[tuple[int, int]], list[int]]:
    """Wordings of a text (with the license's name last), the spans of its words, and where licensing is mentioned."""
    mentions = [m.start() for m in _MENTION.finditer(text)]
    spans = [m.span() for m in _WORD.finditer(text)] if mentions else []
    if not spans:
        return [], [], mentions
    starts = [a for a, _ in spans]
    words = [text[a:b].lower() for a, b in spans]
    of = sorted({max(0, bisect_right(starts, m) - 1) for m in mentions})
    found = scan_words(words, of, templates, least_share)
    out = []
    for nth, w in enumerate(found):
        out.append((*w, templates[w[0]][0]))
        if len(_wordings(templates)[w[0]][0]) <= _SHORT:
            limit = found[nth + 1][4] if nth + 1 < len(found) else len(words)
            out += [(w[0], w[1], w[2], w[3], first, last, name) for name, first, last in said_beside(words, w, limit)]
    return out, spans, mentions


def scan_block(block: str, templates: Templates = TEMPLATES, least_share: float = 0.7) -> list[tuple[int, float, int, list[str]]]:
    """Confirmed templates (index, size reduction, words missing, changes), one for each license wording found."""
    return [w[:4] for w in _scan(block, templates, least_share)[0]]


def blocks_of(text: str, mentions: list[int]) -> list[tuple[int, int]]:
    """Runs of neighbouring lines that mention licensing."""
    out: list[tuple[int, int]] = []
    for m in mentions:
        if out and m < out[-1][1]:
            continue
        start, end = text.rfind("\n", 0, m) + 1, text.find("\n", m)
        end = len(text) if end < 0 else end
        if out and out[-1][1] + 1 == start:
            out[-1] = out[-1][0], end
        else:
            out.append((start, end))
    return out


def scan_licenses(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each wording confirmed: doc_id, block_start, block_end, license, ...

    A block is a run of neighbouring lines that mention licensing. A block with several wordings
    gives a row for each, in order; a wording that goes on over other lines counts for the block
    where it begins; a block without any gives one row with a null ``license``. Null and empty
    texts, and an empty table, give no rows; repeated rows give repeated rows; texts of any length
    are scanned whole. Extra columns are not read.
    """
    rows = docs.where(F.col(text).rlike(rf"(?i){_CUE}")).select(F.col(key).alias("doc_id"), F.col(text).alias("_text"))
    schema = T.StructType([rows.schema["doc_id"], *RESULT.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 1)):
            of, out = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                wordings, spans, mentions = _scan(text, templates)
                blocks = blocks_of(text, mentions)
                begins, ends = [a for a, _ in blocks], [b for _, b in blocks]
                held: list[list] = [[] for _ in blocks]
                covered: set[int] = set()
                for w in wordings:
                    first = min(bisect_right(ends, spans[w[4]][0]), len(blocks) - 1)
                    held[first].append((w[6], w[0], w[1], w[2], "; ".join(w[3]), not w[3] and w[2] == 0))
                    covered.update(range(first + 1, bisect_left(begins, spans[w[5] - 1][1])))
                for nth, (block, rows_of) in enumerate(zip(blocks, held, strict=True)):
                    if not rows_of and nth not in covered:
                        rows_of.append((None, None, 0.0, None, None, False))
                    for row in rows_of:
                        of.append(i)
                        out.append((*block, *row))
            columns = list(zip(*out, strict=True)) or [[]] * len(RESULT)
            types = [pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.float64(), pa.int64(), pa.string(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of, pa.int32())), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=schema.names)

    return rows.mapInArrow(run, schema)
