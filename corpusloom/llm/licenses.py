"""License scans by template markup.

A template is wording with regions: ``<<beginOptional>> .. <<endOptional>>`` may be absent, nested
too, and ``<<var;name="holder";match="[0-9]+";max=3>>`` stands for up to ``max`` words that each
match. Everything else is mandatory, word for word. All templates are compiled into one token
automaton, made deterministic as it runs; a text is accepted where it walks from start to end.

Words are runs of digits, ASCII letters (lower-cased) and characters beyond ASCII.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import string_buffers

_BLANK = bytes(c if 48 <= c < 58 or 97 <= c < 123 or c >= 128 else c + 32 if 65 <= c < 91 else 32 for c in range(256))
_MARK = re.compile(r"<<(.*?)>>", re.S)
_FIELD = re.compile(r';\s*(\w+)=(?:"([^"]*)"|(\w+))')


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_BLANK).split()


@dataclass(frozen=True)
class Template:
    """Wording of one license. Its label is reported; ``weight`` is how sure a match makes (0 to 1)."""

    label: str
    text: str
    weight: float = 0.9
    base: bool = False


@dataclass(frozen=True)
class Var:
    most: int
    match: str | None


def parse(text: str) -> list:
    """Nested parts of a template: word (bytes), Var, or a list that is optional."""
    stack: list[list] = [[]]
    at = 0
    for mark in _MARK.finditer(text):
        stack[-1] += words_of(text[at : mark.start()].encode())
        at = mark.end()
        body = mark[1].strip()
        if body == "beginOptional":
            stack.append([])
        elif body == "endOptional":
            if len(stack) == 1:
                raise ValueError("endOptional without beginOptional")
            part = stack.pop()
            stack[-1].append(part)
        elif body.startswith("var"):
            fields = {k: a or b for k, a, b in _FIELD.findall(body)}
            stack[-1].append(Var(int(fields.get("max", 10)), fields.get("match")))
        else:
            raise ValueError(f"unknown mark {body!r}")
    stack[-1] += words_of(text[at:].encode())
    if len(stack) > 1:
        raise ValueError("beginOptional without endOptional")
    return stack[0]


def as_regex(template: Template) -> str:
    """The same language over words that are each followed by a blank, in plain regex syntax."""

    def of(parts: list) -> str:
        return "".join("(?:" + of(p) + ")?" if isinstance(p, list) else "(?:" + (p.match or "[^ ]+") + " ){0," + str(p.most) + "}" if isinstance(p, Var) else re.escape(p.decode()) + " " for p in parts)

    return of(parse(template.text))


class Automaton:
    """Token automaton of several templates; states are sets, found and kept as texts need them."""

    def __init__(self, templates: Sequence[Template]):
        self.templates = tuple(templates)
        self.edges: list[list[tuple]] = []  # of a place: (word or None, pattern or None, next)
        self.free: list[list[int]] = []
        self.ends: dict[int, int] = {}
        start = self._place()
        for k, template in enumerate(self.templates):
            first = self._place()
            self.free[start].append(first)
            last = self._build(parse(template.text), first)
            if last in self._closure({first}):
                raise ValueError(f"{template.label}: a template needs a mandatory word")
            self.ends[last] = k
        self.vocabulary = {e[0] for es in self.edges for e in es if e[0] is not None}
        self.patterns = sorted({e[1] for es in self.edges for e in es if e[0] is None and e[1]})
        self._compiled = {p: re.compile(p.encode()) for p in self.patterns}
        self.ids: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.accepts: list[tuple[int, ...]] = []
        self.moves: list[dict] = []
        self.start = self._state(self._closure({start}))
        self.dead = self._state(frozenset())
        opening = [e for p in self.sets[self.start] for e in self.edges[p]]
        if any(e[0] is None for e in opening):
            raise ValueError("a template may not begin with a replaceable region")
        self.openers = frozenset(e[0] for e in opening)

    def _place(self) -> int:
        self.edges.append([])
        self.free.append([])
        return len(self.edges) - 1

    def _build(self, parts: list, at: int) -> int:
        for part in parts:
            if isinstance(part, list):
                after = self._build(part, at)
                end = self._place()
                self.free[at].append(end)
                self.free[after].append(end)
                at = end
            elif isinstance(part, Var):
                end = self._place()
                for _ in range(part.most):
                    self.free[at].append(end)
                    after = self._place()
                    self.edges[at].append((None, part.match, after))
                    at = after
                self.free[at].append(end)
                at = end
            else:
                after = self._place()
                self.edges[at].append((part, None, after))
                at = after
        return at

    def _closure(self, places: set[int]) -> frozenset:
        todo, seen = list(places), set(places)
        while todo:
            for x in self.free[todo.pop()]:
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return frozenset(seen)

    def _state(self, places: frozenset) -> int:
        if places not in self.ids:
            self.ids[places] = len(self.sets)
            self.sets.append(places)
            self.accepts.append(tuple(sorted(self.ends[p] for p in places if p in self.ends)))
            self.moves.append({})
        return self.ids[places]

    def _symbol(self, word: bytes):
        known = word if word in self.vocabulary else None
        return (known, *(bool(self._compiled[p].fullmatch(word)) for p in self.patterns)) if self.patterns else known

    def step(self, state: int, word: bytes) -> int:
        symbol = self._symbol(word)
        moves = self.moves[state]
        if symbol not in moves:
            to = {n for p in self.sets[state] for w, m, n in self.edges[p] if (w == word if w is not None else not m or self._compiled[m].fullmatch(word))}
            moves[symbol] = self._state(self._closure(to)) if to else self.dead
        return moves[symbol]

    def accepts_whole(self, text: str) -> list[str]:
        """Labels of the templates that the whole text is an instance of."""
        state = self.start
        for word in words_of(text.encode()):
            state = self.step(state, word)
        return sorted({self.templates[k].label for k in self.accepts[state]})

    def find(self, words: list[bytes]) -> list[tuple[int, int, int]]:
        """(template, first word, end) of every start at which a template is accepted, its longest."""
        if self.openers.isdisjoint(words):
            return []
        found = []
        for i, word in enumerate(words):
            if word in self.openers:
                state, j, best = self.start, i, {}
                while True:
                    state = self.step(state, words[j])
                    if state == self.dead:
                        break
                    j += 1
                    for k in self.accepts[state]:
                        best[k] = j
                    if j == len(words):
                        break
                found += [(k, i, end) for k, end in sorted(best.items())]
        return found


_OPTIONAL = "<<beginOptional>>{}<<endOptional>>"
_COPYRIGHT = '<<beginOptional>>Copyright<<beginOptional>>(c)<<endOptional>><<var;name="holder";max=20>><<beginOptional>>All rights reserved.<<endOptional>><<endOptional>>'
_WARRANTY = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."

TEMPLATES = (
    Template("mit", "mit license", 0.6, True),
    Template("apache", "apache license", 0.6, True),
    Template("gpl", "general public license", 0.6, True),
    Template("mit-notice", 'released under the <<beginOptional>>terms of the<<endOptional>> MIT License', 0.9),
    Template("mit-notice", "licensed under the <<beginOptional>>terms of the<<endOptional>> MIT License", 0.9),
    Template(
        "mit-text",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
        + _OPTIONAL.format('(the "Software")')
        + ", to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice "
        + _OPTIONAL.format("(including the next paragraph)")
        + " shall be included in all copies or substantial portions of the Software. "
        + _OPTIONAL.format(_WARRANTY),
        1.0,
    ),
    Template("apache-2.0-notice", 'licensed under the Apache License, Version <<var;name="version";match="[0-9]+";max=2>>', 0.9),
    Template("apache-2.0-notice", 'licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License', 1.0),
    Template("gpl-notice", 'licensed under the GNU <<beginOptional>>Lesser<<endOptional>> <<beginOptional>>Affero<<endOptional>> General Public License <<beginOptional>>, version <<var;name="version";match="[0-9]+";max=2>><<endOptional>>', 0.9),
    Template(
        "gpl-notice",
        "This program is free software<<beginOptional>>:<<endOptional>> you can redistribute it and/or modify it under the terms of the GNU <<beginOptional>>Lesser<<endOptional>> <<beginOptional>>Affero<<endOptional>> General Public License as published by the Free Software Foundation",
        1.0,
    ),
    Template("cc-by", 'CC BY <<beginOptional>>SA<<endOptional>> <<var;name="version";match="[0-9]";max=2>>', 0.8),
    Template("cc-by-nc", 'CC BY NC <<beginOptional>>SA<<endOptional>> <<beginOptional>>ND<<endOptional>> <<var;name="version";match="[0-9]";max=2>>', 0.9),
    Template("cc-by", 'Creative Commons Attribution <<beginOptional>>ShareAlike<<endOptional>> <<var;name="version";match="[0-9]";max=2>> <<beginOptional>>International<<endOptional>> <<beginOptional>>Public<<endOptional>> License', 0.9),
    Template("cc-by-nc", 'Creative Commons Attribution NonCommercial <<beginOptional>>ShareAlike<<endOptional>> <<var;name="version";match="[0-9]";max=2>> <<beginOptional>>International<<endOptional>> <<beginOptional>>Public<<endOptional>> License', 0.9),
    Template(
        "bsd-text",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        + _OPTIONAL.format("1.") + " Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        + _OPTIONAL.format("2.") + " Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
        + _OPTIONAL.format(_OPTIONAL.format("3.") + ' Neither the name of the <<var;name="organization";max=12>> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.'),
        1.0,
    ),
    Template("mpl-2.0-notice", "This Source Code Form is subject to the terms of the Mozilla Public License, <<beginOptional>>v.<<endOptional>> <<beginOptional>>version<<endOptional>> 2.0", 1.0),
    Template("cc0", "CC0 1.0 <<beginOptional>>Universal<<endOptional>>", 0.9),
    Template("epl-notice", 'Eclipse Public License <<beginOptional>>-<<endOptional>> <<beginOptional>>v<<endOptional>> <<beginOptional>>version<<endOptional>> <<var;name="version";match="[0-9]";max=2>>', 0.8),
    Template("zlib-text", "This software is provided <<beginOptional>>'<<endOptional>>as-is<<beginOptional>>'<<endOptional>>, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.", 1.0),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", 1.0),
    Template("isc-text", 'Permission to use, copy, modify, and<<beginOptional>>/or<<endOptional>> distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies', 1.0),
    Template("unlicense-text", "This is free and unencumbered software released into the public domain", 1.0),
    Template("all-rights-reserved", _COPYRIGHT.replace("<<beginOptional>>All rights reserved.<<endOptional>>", "") + " All rights reserved", 0.5),
)


def read_templates(folder: str, ending: str = ".template.txt", weight: float = 0.9) -> tuple[Template, ...]:
    """Templates from files of a folder, one each, in the same markup; the name before the ending is the label."""
    found = []
    for path in sorted(Path(folder).iterdir()):
        if path.name.endswith(ending):
            found.append(Template(path.name.removesuffix(ending), path.read_text(encoding="utf-8"), weight))
            parse(found[-1].text)  # a file that isn't a template fails here
    return tuple(found)


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: Sequence[Template] = TEMPLATES) -> DataFrame:
    """One row a document: id, n_words, matches and score.

    ``matches`` holds every accepted place: label, base, first_word and end_word (from 0, end beyond).
    ``score`` is 1 - the product of (1 - weight) over the distinct labels. A null or empty text has no
    words and no match; very long texts count whole; equal starts are reported for each template; rows stay as they are, so
    repeated rows give repeated rows; other columns are ignored; an empty table gives none.
    """
    schema = "doc_id long, n_words long, matches array<struct<label:string,base:boolean,first_word:long,end_word:long>>, score double"
    kind = pa.list_(pa.struct([("label", pa.string()), ("base", pa.bool_()), ("first_word", pa.int64()), ("end_word", pa.int64())]))
    fields = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("matches", kind), ("score", pa.float64())])
    known = tuple(templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(known)
        for batch in batches:
            raw, offsets = string_buffers(batch.column(1))
            data, at = raw.tobytes(), offsets.tolist()
            counts, matches, scores = [], [], []
            for a, b in zip(at, at[1:]):
                words = words_of(data[a:b])
                found = automaton.find(words)
                sure = {}
                for k, _, _ in found:
                    t = known[k]
                    sure[t.label] = max(t.weight, sure.get(t.label, 0.0))
                rest = 1.0
                for label in sorted(sure):
                    rest *= 1.0 - sure[label]
                counts.append(len(words))
                matches.append([{"label": known[k].label, "base": known[k].base, "first_word": i, "end_word": j} for k, i, j in found])
                scores.append(1.0 - rest)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(matches, kind), pa.array(scores, pa.float64())], schema=fields)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def license_report(found: DataFrame) -> DataFrame:
    """Digest of ``scan_licenses``: counts and places of the base labels, and all labels."""
    base = F.filter("matches", lambda m: m["base"])
    joined = lambda ms: F.array_join(F.array_sort(F.array_distinct(F.transform(ms, lambda m: m["label"]))), ",")
    starts = F.transform(base, lambda m: m["first_word"])
    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.col("matches")).alias("labels"),
        "score",
    )


def report_sql(templates: Sequence[Template] = TEMPLATES) -> str:
    """DuckDB SQL for ``license_report`` over the documents, with regular expressions for templates."""
    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    quote = lambda s: s.replace("'", "''")
    hit = lambda t: f"regexp_matches(line, ' {quote(as_regex(t))}')"
    labels = sorted({t.label for t in templates})
    weight = {}
    for label in labels:
        own = sorted((t for t in templates if t.label == label), key=lambda t: -t.weight)
        weight[label] = "CASE " + " ".join(f"WHEN {hit(t)} THEN {t.weight}" for t in own) + " ELSE 0 END"
    has = ", ".join(f"CASE WHEN {' OR '.join(hit(t) for t in templates if t.label == label)} THEN '{label}' END" for label in labels)
    rest = " * ".join(f"(1.0::DOUBLE - ({weight[label]})::DOUBLE)" for label in labels)
    places = []
    for t in templates:
        if t.base:
            ws = [w.decode() for w in parse(t.text)]
            test = " AND ".join(f"words[i + {k}] = '{w}'" for k, w in enumerate(ws))
            places.append((t.label, f"list_filter(range(1, len(words) - {len(ws) - 2}), lambda i: {test})"))
    all_places = "list_concat(" + places[0][1] + ", list_concat(" + places[1][1] + ", " + places[2][1] + "))"
    base = ", ".join(f"CASE WHEN len({p}) > 0 THEN '{label}' END" for label, p in sorted(places))
    return f"""
WITH lined AS (SELECT doc_id, ' ' || trim(regexp_replace({low}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', ' ', 'g'), ' ') || ' ' AS line FROM documents),
split AS (SELECT doc_id, line, CASE WHEN trim(line, ' ') = '' THEN []::VARCHAR[] ELSE string_split(trim(line, ' '), ' ') END AS words FROM lined),
placed AS (SELECT *, {all_places} AS places FROM split)
SELECT doc_id, len(words)::BIGINT AS n_words, len(places)::BIGINT AS n_base, (list_min(places) - 1)::BIGINT AS first_word, (list_max(places) - 1)::BIGINT AS last_word,
  array_to_string(list_filter([{base}], lambda x: x IS NOT NULL), ',') AS base_labels,
  array_to_string(list_filter([{has}], lambda x: x IS NOT NULL), ',') AS labels,
  1.0::DOUBLE - {rest} AS score
FROM placed"""
