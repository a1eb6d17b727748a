"""License scans by template markup.

A template is wording with markup: ``<<opt>> ... <<end>>`` may be left out, ``<<any 1-6>>`` stands for so many words of
any kind. Templates compile to token automata: states joined by words, by any-word steps and by free steps. A text
holds a template where the automaton accepts consecutive words, so all mandatory wording matches exactly, in order.

Words are runs of ASCII letters and digits (A-Z as a-z) and of all characters beyond ASCII. Defined results: a null or
empty text has no words, no labels and score 0; equal rows give equal results; an empty table gives an empty result;
only doc_id and text are read. Whole texts are scanned, in one pass each and without state between rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import in_batches, plus, schema_of, slices, table

#: Phrases and their labels: fixed values.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Templates and their labels: fixed values.
TEMPLATES = {
    "apache-2.0": "licensed under the apache license <<opt>> version <<end>> 2 0",
    "bsd-2-clause": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met <<any 0-1>> redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer <<any 0-1>> redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution this software is provided by <<any 1-12>> as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall <<any 1-12>> be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage",
    "bsd-3-clause": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met <<any 0-1>> redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer <<any 0-1>> redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution <<any 0-1>> neither the name of <<any 1-12>> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission this software is provided by <<any 1-12>> as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall <<any 1-12>> be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage",
    "cc-by-4.0": "<<opt>> is <<end>> licensed under <<opt>> a <<end>> <<opt>> the <<end>> cc by 4 0",
    "cc-by-nc-4.0": "licensed under <<opt>> a <<end>> <<opt>> the <<end>> cc by nc 4 0",
    "gpl-2.0": "licensed under <<opt>> the terms of <<end>> the gnu general public license <<opt>> as published by the free software foundation <<end>> <<opt>> either <<end>> version 2 <<opt>> of the license <<end>> <<opt>> or at your option any later version <<end>>",
    "gpl-3.0": "licensed under <<opt>> the terms of <<end>> the gnu general public license <<opt>> as published by the free software foundation <<end>> <<opt>> either <<end>> version 3 <<opt>> of the license <<end>> <<opt>> or at your option any later version <<end>>",
    "mit-notice": "released under the <<any 0-2>> mit license",
    "mit-text": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice <<opt>> including the next paragraph <<end>> shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall <<any 1-12>> be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
}
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


@dataclass
class Automaton:
    """Steps of each state by word, over any word and free; state 0 begins, the last accepts."""

    words: list[dict[bytes, int]] = field(default_factory=lambda: [{}])
    any: list[list[int]] = field(default_factory=lambda: [[]])
    free: list[list[int]] = field(default_factory=lambda: [[]])
    anchor: bytes = b""
    leads: list[list[bytes]] = field(default_factory=lambda: [[]])

    def state(self) -> int:
        for steps in (self.words, self.any, self.free):
            steps.append({} if steps is self.words else [])
        return len(self.words) - 1

    def reach(self, states: set[int]) -> set[int]:
        todo, seen = list(states), set(states)
        while todo:
            for x in self.free[todo.pop()]:
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return seen

    def lead(self, words: list[bytes], start: int) -> int:
        """How many words before ``start`` are optional wording of the template's begin, at most."""
        return max(len(x) for x in self.leads if words[max(0, start - len(x)) : start] == x)

    def accept(self, words: list[bytes], start: int) -> int:
        """How many words from ``start`` on the longest accepted run has; 0 if none is accepted."""
        now, best, last = self.reach({0}), 0, len(self.words) - 1
        for i in range(start, len(words)):
            now = self.reach({self.words[s][words[i]] for s in now if words[i] in self.words[s]} | {x for s in now for x in self.any[s]})
            if not now:
                break
            if last in now:
                best = i + 1 - start
        return best


def compile_template(markup: str) -> Automaton:
    """The automaton of a template. Optional words at its start are kept apart: a text is searched for what is mandatory."""
    parts = re.findall(r"<<[^>]*>>|\S+", markup)
    made, at, opened = Automaton(), 0, []
    while parts and parts[0] == "<<opt>>":
        behind = parts.index("<<end>>")
        made.leads += [x + [w.encode() for w in parts[1:behind]] for x in made.leads]
        parts = parts[behind + 1 :]
    leading = True
    for part in parts:
        if part == "<<opt>>":
            opened.append(at)
            leading = False
        elif part == "<<end>>":
            made.free[opened.pop()].append(at)
        elif m := re.fullmatch(r"<<any (\d+)-(\d+)>>", part):
            leading = False
            least, most = int(m[1]), int(m[2])
            ends = []
            for i in range(most):
                if i >= least:
                    ends.append(at)
                new = made.state()
                made.any[at].append(new)
                at = new
            for e in ends:
                made.free[e].append(at)
        else:
            new = made.state()
            made.words[at][part.encode()] = new
            at = new
            if leading:
                made.anchor += b" " + part.encode()
    if opened or not made.anchor:
        raise ValueError(f"a template needs closed regions and mandatory wording at its start: {markup}")
    end = made.state()
    made.free[at].append(end)
    made.anchor += b" "
    return made


def places(text: bytes, phrase: bytes) -> list[int]:
    """Word positions at which ``phrase``, with a space at either end, stands in ``text``, which has one before each word."""
    found, at, seen, words = [], text.find(phrase), 0, 0
    while at >= 0:
        words += text.count(b" ", seen, at)
        seen = at
        found.append(words)
        at = text.find(phrase, at + 1)
    return found


def scan(df: DataFrame, phrases: dict[str, str] = PHRASES, templates: dict[str, str] = TEMPLATES, text: str = "text", keep: list[str] = ["doc_id"]) -> DataFrame:  # noqa: B006
    """``keep``, n_words, n_base, first_word, last_word, base_labels, labels, score (share of words that labels cover) and matches."""

    def run(batches):
        plain = [(b" " + p.encode() + b" ", len(p.split()), label) for p, label in phrases.items()]
        automata = [(label, compile_template(t)) for label, t in templates.items()]
        for batch in slices(batches, text):
            out = {k: [] for k in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches")}
            for t in batch.column(text).to_pylist():
                words = (t or "").encode().translate(_WORDS).split()
                line = b" " + b" ".join(words) + b" "
                base = [(i, n, label) for p, n, label in plain for i in places(line, p)]
                more = [(i - (k := a.lead(words, i)), n + k, label) for label, a in automata for i in places(line, a.anchor) if (n := a.accept(words, i))]
                covered, reach = 0, 0
                for i, n, _ in sorted(base + more):
                    covered += max(0, i + n - max(i, reach))
                    reach = max(reach, i + n)
                at = [i for i, _, _ in base]
                out["n_words"].append(len(words))
                out["n_base"].append(len(base))
                out["first_word"].append(min(at, default=None))
                out["last_word"].append(max(at, default=None))
                out["base_labels"].append(",".join(sorted({x[2] for x in base})))
                out["labels"].append(",".join(sorted({x[2] for x in base + more})))
                out["score"].append(covered / len(words) if words else 0.0)
                out["matches"].append([{"label": label, "start": i, "words": n} for i, n, label in sorted(more)])
            kinds = {"n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "score": pa.float64(), "matches": pa.list_(pa.struct({"label": pa.string(), "start": pa.int64(), "words": pa.int64()}))}
            yield plus(batch, keep, **{k: pa.array(v, kinds.get(k, pa.string())) for k, v in out.items()})

    more = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, matches array<struct<label:string,start:bigint,words:bigint>>"
    return in_batches(df.select(*keep, *[text][: text not in keep]), run, schema_of(df, keep, more))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
