"""License scan: templates with optional and replaceable regions as token automata.

A template is license wording in which ``<<optional>> ... <<end>>`` encloses
words that a text may leave out and ``<<any lo hi>>`` stands for ``lo`` to
``hi`` words of any kind.  All other words are mandatory.  A template is
compiled to a nondeterministic automaton over words; a text is accepted where
some stretch of its consecutive words spells a path of the automaton, so its
mandatory wording matches exactly and in order.  Words are lower-cased runs of
ASCII letters, digits and non-ASCII characters; punctuation and line breaks
never matter.

The scan is a single narrow pass: each task reads its own rows, nothing is
shuffled or broadcast but the templates.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm._text import column, slices, utf8, words_of

#: (label, template).  Wording of the public licenses and of their usual notices.
TEMPLATES: list[tuple[str, str]] = [
    ("mit", "<<optional>>is<<end>> <<optional>>released<<end>> <<optional>>licensed<<end>> <<optional>>distributed<<end>> under the <<optional>>terms of the<<end>> MIT License"),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files (the Software), to deal in the Software without restriction, including "
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions: The above copyright notice and this permission notice <<optional>>(including the "
        "next paragraph)<<end>> shall be included in all copies or substantial portions of the Software. "
        "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO "
        "THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL "
        "<<any 2 8>> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
        "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "apache-2",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with "
        "the License. You may obtain a copy of the License at <<any 1 10>> Unless required by applicable law or agreed to in "
        "writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS "
        "OF ANY KIND, either express or implied. See the License for the specific language governing permissions and "
        "limitations under the License.",
    ),
    ("apache-2", "Licensed under the Apache License<<optional>>,<<end>> Version 2 <<optional>>0<<end>> <<optional>>(the License)<<end>>"),
    ("apache-2", "under the terms of the Apache License <<optional>>Version<<end>> 2 <<optional>>0<<end>>"),
    ("gpl", "licensed under the <<optional>>terms of the<<end>> GNU General Public License <<optional>>as published by the Free Software Foundation<<end>> <<optional>>either<<end>> version <<any 1 1>>"),
    (
        "isc",
        "Permission to use, copy, modify, and<<optional>>/or<<end>> distribute this software for any purpose with or without "
        "fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        "THE SOFTWARE IS PROVIDED AS IS AND <<any 1 6>> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL "
        "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL <<any 1 6>> BE LIABLE FOR ANY SPECIAL, DIRECT, "
        "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN "
        "AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR "
        "PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: <<optional>>1<<end>> Redistributions of source code must retain the above copyright "
        "notice, this list of conditions and the following disclaimer. <<optional>>2<<end>> Redistributions in binary form must "
        "reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
        "and/or other materials provided with the distribution. <<optional>><<optional>>3<<end>> Neither the name of "
        "<<any 1 8>> nor the names of <<any 0 3>> contributors may be used to endorse or promote products derived from this "
        "software without specific prior written permission.<<end>> THIS SOFTWARE IS PROVIDED BY <<any 1 8>> AS IS AND ANY "
        "EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS "
        "FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL <<any 1 8>> BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
        "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR "
        "SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
        "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE "
        "OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    ("cc-by-nc", "licensed under <<optional>>a<<end>> <<optional>>the<<end>> CC BY NC <<any 1 1>>"),
    ("cc-by-nc", "Creative Commons Attribution NonCommercial <<any 1 2>> <<optional>>International<<end>> License"),
]

#: (label, words that stand one after another).
PHRASES: list[tuple[str, str]] = [
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
]


@dataclass(frozen=True)
class Automaton:
    """``steps[s]`` lists (word or None for any, next state); ``skips[s]`` the states reached free of charge."""

    label: str
    steps: tuple[tuple[tuple[bytes | None, int], ...], ...]
    skips: tuple[tuple[int, ...], ...]
    final: int
    mandatory: tuple[bytes, ...]
    first: frozenset[bytes]

    def closure(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for t in self.skips[todo.pop()]:
                if t not in states:
                    states.add(t)
                    todo.append(t)
        return states

    def match(self, words: list[bytes], at: int) -> int:
        """End of the longest accepted stretch that begins at word ``at``, or -1."""
        live, best = self.closure({0}), -1
        for i in range(at, len(words)):
            live = self.closure({t for s in live for w, t in self.steps[s] if w is None or w == words[i]})
            if not live:
                break
            if self.final in live:
                best = i + 1
        return best


def parse_template(template: str) -> list[tuple]:
    """("word", w), ("any", lo, hi) and ("optional", [...]) in order; the markup must be balanced."""
    stack: list[list] = [[]]
    for mark, plain in re.findall(r"<<([^<>]*)>>|((?:(?!<<).)+)", template, re.S):
        if mark == "optional":
            stack.append([])
        elif mark == "end":
            if len(stack) == 1:
                raise ValueError("<<end>> without <<optional>>")
            inner = stack.pop()
            stack[-1].append(("optional", inner))
        elif mark:
            kind, lo, hi = mark.split()
            if kind != "any" or not 0 <= int(lo) <= int(hi):
                raise ValueError(f"unknown markup <<{mark}>>")
            stack[-1].append(("any", int(lo), int(hi)))
        else:
            stack[-1] += [("word", w) for w in words_of(plain.encode())]
    if len(stack) > 1:
        raise ValueError("<<optional>> without <<end>>")
    return stack[0]


def compile_template(label: str, template: str) -> Automaton:
    """The automaton of a template; one that could begin with any word, or accept none, is refused."""
    steps: list[list] = [[]]
    skips: list[list] = [[]]

    def state() -> int:
        steps.append([])
        skips.append([])
        return len(steps) - 1

    def build(parts: list[tuple], at: int) -> int:
        for part in parts:
            if part[0] == "word":
                steps[at].append((part[1], nxt := state()))
                at = nxt
            elif part[0] == "any":
                ends = [at]
                for _ in range(part[2]):
                    steps[ends[-1]].append((None, nxt := state()))
                    ends.append(nxt)
                for e in ends[part[1] : -1]:
                    skips[e].append(ends[-1])
                at = ends[-1]
            else:
                end = build(part[1], at)
                if end != at:
                    skips[at].append(end)
                at = end
        return at

    parts = parse_template(template)
    final = build(parts, 0)
    made = Automaton(label, tuple(map(tuple, steps)), tuple(map(tuple, skips)), final, tuple(dict.fromkeys(p[1] for p in parts if p[0] == "word")), frozenset())
    begin = [w for s in made.closure({0}) for w, _ in made.steps[s]]
    if not made.mandatory or None in begin:
        raise ValueError("a template needs mandatory words and must not begin with any word")
    return Automaton(made.label, made.steps, made.skips, made.final, made.mandatory, frozenset(begin))


def _places(joined: bytes, phrase: bytes) -> list[int]:
    """Word numbers at which ``phrase`` (with a space on either side) begins in ``joined``."""
    found, at, seen, words = [], joined.find(phrase), 0, 0
    while at >= 0:
        words += joined.count(b" ", seen, at)
        seen = at
        found.append(words)
        at = joined.find(phrase, at + 1)
    return found


def scan_licenses(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    templates: list[tuple[str, str]] = TEMPLATES,
    phrases: list[tuple[str, str]] = PHRASES,
) -> DataFrame:
    """Licenses named in each text: one row per input row, in one narrow pass.

    Columns: the id; ``n_words``; ``phrases`` and ``accepted``, arrays of
    (label, start, end) in words from 0, of every place of a phrase and of the
    stretches that a template accepts: the longest one from each start, but for those that
    end inside one that begins before.

    A null or empty text has no words and empty arrays.  Null ids, repeated
    rows and texts of any length are rows like others; other columns are not read.
    An empty table gives an empty table.
    """
    automata = [compile_template(label, t) for label, t in templates]
    wanted = [(label, b" " + b" ".join(words_of(p.encode())) + b" ") for label, p in phrases]
    if any(p.strip() == b"" for _, p in wanted):
        raise ValueError("a phrase needs a word")
    span = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            n_words, base, accepted = [], [], []
            for text in utf8(column(batch, "_text")):
                words = words_of(text) if text else []
                joined = b" " + b" ".join(words) + b" "
                n_words.append(len(words))
                base.append([{"label": label, "start": at, "end": at + p.count(b" ") - 1} for label, p in wanted if p in joined for at in _places(joined, p)])
                hits = []
                for a in automata:
                    if all(b" " + w + b" " in joined for w in a.mandatory):
                        end = 0
                        for at, w in enumerate(words):
                            if w in a.first and (stop := a.match(words, at)) > end:
                                hits.append({"label": a.label, "start": at, "end": stop})
                                end = stop
                accepted.append(hits)
            yield pa.RecordBatch.from_arrays([column(batch, "_id"), pa.array(n_words, pa.int64()), pa.array(base, span), pa.array(accepted, span)], ["_id", "n_words", "phrases", "accepted"])

    kind = df.schema[id_col].dataType.simpleString()
    spans = "array<struct<label:string,start:bigint,end:bigint>>"
    rows = df.select(df[id_col].alias("_id"), df[text_col].alias("_text")).mapInArrow(scan, f"_id {kind}, n_words bigint, phrases {spans}, accepted {spans}")
    return rows.withColumnRenamed("_id", id_col)
