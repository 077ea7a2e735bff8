"""Licence scans over a positional index of rare tokens.

Every licence notice is a template: its words, the label it stands for, and mandatory key phrases. Document
frequencies of the templates' words are counted over all documents; each template is indexed by its words of highest
inverse document frequency, with their positions. A file looks its own highest-IDF licence words up in that index,
and each occurrence votes for a template at the position where the template would begin. Places with votes from
enough different words are verified: the key phrases must stand there, and the score is the share of the template's
word pairs that the place holds.

Besides, fixed base phrases are found wherever their words stand consecutively.

Words are runs of characters outside ASCII punctuation, spaces and controls, with A-Z lower-cased.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphflow.llm._common import small_batches

#: Base phrases and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    phrases: tuple[str, ...]  # all must stand where the template is found


TEMPLATES = (
    Template("mit", "released under the mit license", ("mit license",)),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ("hereby granted free of charge", "without restriction")),
    Template("apache", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    Template("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", ("except in compliance with the license",)),
    Template("gpl", "this work is licensed under the gnu general public license version 3", ("gnu general public license",)),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ("free software", "gnu general public license")),
    Template("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", ("gnu lesser general public license",)),
    Template("agpl", "licensed under the terms of the gnu affero general public license as published by the free software foundation", ("gnu affero general public license",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("source and binary forms", "following conditions are met")),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("for any purpose with or without fee",)),
    Template("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    Template("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    Template("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", ("creative commons attribution noncommercial",)),
    Template("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license", ("creative commons attribution sharealike",)),
    Template("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4 0",)),
    Template("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", ("waived all copyright",)),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
    Template("proprietary", "all rights reserved unauthorized copying of this file via any medium is strictly prohibited", ("unauthorized copying",)),
)

#: Whole public notices, as their publishers word them, with phrases that must stand in them.
_WARRANTY = "IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_BSD2 = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD3 = " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_FREE = "{0} is free software: you can redistribute it and/or modify it under the terms of the GNU {1} as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. {0} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {1} for more details. You should have received a copy of the GNU {1} along with this program. If not, see <https://www.gnu.org/licenses/>."
TEMPLATES += (
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.", ("hereby granted free of charge", "shall be included in all copies")),
    Template("bsd-2-clause", f"{_BSD2} THIS SOFTWARE {_WARRANTY}", ("retain the above copyright notice", "reproduce the above copyright notice")),
    Template("bsd-3-clause", f"{_BSD2}{_BSD3} THIS SOFTWARE {_WARRANTY}", ("retain the above copyright notice", "endorse or promote products")),
    Template("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.", ("apache license version 2 0", "specific language governing permissions")),
    Template("gpl", _FREE.format("This program", "General Public License"), ("gnu general public license", "at your option any later version")),
    Template("lgpl", _FREE.format("This library", "Lesser General Public License"), ("gnu lesser general public license", "at your option any later version")),
    Template("agpl", _FREE.format("This program", "Affero General Public License"), ("gnu affero general public license", "at your option any later version")),
    Template("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.", ("mozilla public license", "if a copy of the mpl")),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.", ("for any purpose with or without fee", "author disclaims all warranties")),
    Template("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.", ("must not be misrepresented", "altered source versions")),
    Template("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.", ("free and unencumbered software", "relinquishment in perpetuity")),
    Template("cc-by-nc", "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by-nc/4.0/ or send a letter to Creative Commons, PO Box 1866, Mountain View, CA 94042, USA.", ("attribution noncommercial 4 0", "creativecommons org licenses by nc")),
    Template("cc-by-sa", "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by-sa/4.0/ or send a letter to Creative Commons, PO Box 1866, Mountain View, CA 94042, USA.", ("attribution sharealike 4 0", "creativecommons org licenses by sa")),
    Template("cc-by", "This work is licensed under the Creative Commons Attribution 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/ or send a letter to Creative Commons, PO Box 1866, Mountain View, CA 94042, USA.", ("attribution 4 0 international", "creativecommons org licenses by 4 0")),
)

_TABLE = bytes(32 if b < 48 or 57 < b < 65 or 90 < b < 97 or 122 < b < 128 else b + 32 if 65 <= b <= 90 else b for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    # in UTF-8 every other character consists of bytes from 80 on, so bytes can be mapped one by one
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split(b" ")


def _words(text: str | None) -> list[bytes]:
    return [w for w in words_of(text) if w]


def vocabulary(templates: tuple[Template, ...] = TEMPLATES) -> list[bytes]:
    return sorted({w for t in templates for w in _words(t.text)})


def document_frequencies(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, text_col: str = "text") -> tuple[int, dict[bytes, int]]:
    """(documents, documents that hold each template word), over all documents. As many rows as the templates have words."""
    small_batches(docs.sparkSession)
    words = vocabulary(templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, wanted = Counter(), 0, frozenset(words)
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                texts = batch.column(0).slice(a, 256).to_pylist()
                n += len(texts)
                for t in texts:
                    held.update(wanted.intersection(words_of(t)))
        yield pa.RecordBatch.from_arrays([pa.array([i for i, w in enumerate(words) if held[w]] + [-1], pa.int32()), pa.array([held[w] for w in words if held[w]] + [n], pa.int64())], names=["word", "n"])

    rows = docs.select(F.col(text_col).cast("string")).mapInArrow(run, "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    found = {r.word: r.n for r in rows}
    return found.pop(-1, 0), {words[k]: n for k, n in found.items()}


class Index:
    """Postings (template, position) of each template's rarest words."""

    def __init__(self, templates: tuple[Template, ...], documents: int, held: dict[bytes, int], rare: int = 5, look_up: int = 8):
        self.templates, self.look_up = templates, look_up
        idf = lambda w: math.log((documents + 1) / (held.get(w, 0) + 1))
        self.texts = [_words(t.text) for t in templates]
        self.pairs = [Counter(zip(w, w[1:])) for w in self.texts]
        self.phrases = [[_words(p) for p in t.phrases] for t in templates]
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        self.rare: list[int] = []
        for k, w in enumerate(self.texts):
            own = sorted(set(w), key=lambda x: (-idf(x), x))[:rare]
            self.rare.append(len(own))
            for x in own:
                self.postings[x] += [(k, i) for i, y in enumerate(w) if y == x]
        self.rank = {w: (-idf(w), w) for w in self.postings}
        self.words = frozenset(self.postings)

    def places(self, words: list[bytes], slack: int = 3) -> Iterator[tuple[int, int, float]]:
        """(template, first word, score) of what is verified."""
        known = self.words.intersection(words)
        if not known:
            return
        # a file's highest-IDF licence words; as many again for each template so that several notices don't hide each other
        chosen = set(sorted(known, key=self.rank.__getitem__)[: self.look_up])
        for k in {k for w in known for k, _ in self.postings[w]}:
            chosen |= set(sorted((w for w in known if any(t == k for t, _ in self.postings[w])), key=self.rank.__getitem__)[: self.look_up])
        votes: dict[tuple[int, int], set[bytes]] = defaultdict(set)
        for at, w in enumerate(words):
            if w in chosen:
                for k, i in self.postings[w]:
                    votes[k, (at - i) // slack].add(w)
        done = set()
        for (k, bucket), own in sorted(votes.items()):
            near = own | votes.get((k, bucket + 1), set())
            if len(near) < max(1, (self.rare[k] + 1) // 2) or (k, bucket - 1) in done:
                continue
            start = max(0, bucket * slack - slack)
            held = words[start : start + len(self.texts[k]) + 4 * slack]
            if not all(any(held[i : i + len(p)] == p for i in range(len(held) - len(p) + 1)) for p in self.phrases[k]):
                continue
            both = self.pairs[k] & Counter(zip(held, held[1:]))
            score = sum(both.values()) / max(1, sum(self.pairs[k].values()))
            if score >= 0.6:
                done.add((k, bucket))
                yield k, start, score


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, base: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score: one row per row of ``docs``.

    n_base counts the places of base phrases; first_word and last_word are the smallest and largest of their first
    words, counted from 0, or null. labels holds base_labels and those of verified templates, both sorted and
    distinct. score is that of the best verified template, 1 where a base phrase stands, else 0. Null and empty
    texts have no words; a null doc_id stays null; other columns are ignored; no rows give no rows.
    """
    base = BASE if base is None else base
    index = Index(templates, *document_frequencies(docs, templates, text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = [(_words(p), label) for p, label in base.items()]
        tails: dict[bytes, list] = defaultdict(list)
        for p, label in phrases:
            tails[p[-1]].append((p, label))
        ends = frozenset(tails)
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                rows = []
                for doc, text in zip(batch.column(0).slice(a, 256).to_pylist(), batch.column(1).slice(a, 256).to_pylist()):
                    words = words_of(text)
                    if b"" in words:
                        words = [w for w in words if w]
                    found, labels = [], set()
                    if not ends.isdisjoint(words):
                        for i, w in enumerate(words):
                            if w in ends:
                                for p, label in tails[w]:
                                    if i + 1 >= len(p) and words[i + 1 - len(p) : i + 1] == p:
                                        found.append(i + 1 - len(p))
                                        labels.add(label)
                    best, more = float(bool(found)), set(labels)
                    for k, _, score in index.places(words):
                        more.add(templates[k].label)
                        best = max(best, score)
                    rows.append((doc, len(words), len(found), min(found, default=None), max(found, default=None), sorted(labels), sorted(more), best))
                kinds = [pa.int64()] * 5 + [pa.list_(pa.string())] * 2 + [pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels array<string>, labels array<string>, score double"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)
