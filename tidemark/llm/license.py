"""License scans: template markup compiled to token automata.

A template is mandatory wording with optional and replaceable regions:

    <<beginOptional>> words <<endOptional>>     the words may be missing
    <<var;words=0..30>>                         any words, so many at most
    <<alt;one|two>>                             one of the words

It compiles to a nondeterministic automaton over words; a text is accepted at a place from
which the automaton reaches its end, that is, where all mandatory wording stands exactly.
Scans jump from place to place of a template's opening wording (its leading mandatory words)
and run the automaton from there, over the whole text.

Words are runs of ASCII letters and digits (A-Z lower-cased) and non-ASCII characters.  Null
texts have no words; ties and repeated rows give equal results; an empty table gives no rows;
columns other than id and text are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes that separate words become spaces, A-Z becomes a-z.
FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))

# The three base phrases and public license wording.
PHRASES = [("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc")]
TEMPLATES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files <<var;words=0..6>> to deal in the "
            "<<alt;software|materials>> without restriction, including without limitation <<beginOptional>>on<<endOptional>> the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the"),
    ("mit", "Released under <<beginOptional>>the terms of<<endOptional>> the MIT <<alt;license|licence>>"),
    ("isc", "Permission to use, copy, modify, and <<beginOptional>>or<<endOptional>> distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted <<beginOptional>>subject to the limitations in the disclaimer below<<endOptional>> provided that the following conditions are met"),
    ("apache-2", "Licensed under the Apache License <<beginOptional>>Version<<endOptional>> 2 <<beginOptional>>0<<endOptional>>"),
    ("gpl-2", "GNU General Public <<alt;license|licence>> <<beginOptional>>as published by the Free Software Foundation<<endOptional>> <<beginOptional>>either<<endOptional>> <<alt;version|v>> 2"),
    ("gpl-3", "GNU General Public <<alt;license|licence>> <<beginOptional>>as published by the Free Software Foundation<<endOptional>> <<beginOptional>>either<<endOptional>> <<alt;version|v>> 3"),
    ("lgpl", "GNU Lesser General Public <<alt;license|licence>>"),
    ("agpl", "GNU Affero General Public <<alt;license|licence>>"),
    ("mpl-2", "Mozilla Public License <<beginOptional>><<alt;version|v>><<endOptional>> 2 0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("cc0", "CC0 1 0 <<beginOptional>>universal<<endOptional>>"),
    ("cc-by-sa", "Creative Commons Attribution Share <<beginOptional>>a<<endOptional>> <<alt;alike|like>>"),
    ("cc-by-nc", "Creative Commons Attribution <<beginOptional>>non<<endOptional>> <<alt;noncommercial|commercial>>"),
]
MARK = re.compile(r"<<(beginOptional|endOptional|var;words=(\d+)\.\.(\d+)|alt;([^>]*))>>")


def fold(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(FOLD).split()


@dataclass
class Automaton:
    """``steps[s]``: word (None: any) and next state; ``skips[s]``: states reached without a word."""

    label: str
    opening: bytes
    mandatory: int
    steps: list[tuple[bytes | tuple[bytes, ...] | None, int] | None]
    skips: list[list[int]]

    def _closed(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for s in self.skips[todo.pop()]:
                if s not in states:
                    states.add(s)
                    todo.append(s)
        return states

    def accepts(self, words: list[bytes], at: int) -> bool:
        final = len(self.steps) - 1
        states = self._closed({0})
        while final not in states and states:
            if at >= len(words):
                return False
            word, after = words[at], set()
            for s in states:
                if (step := self.steps[s]) and (step[0] is None or word == step[0] or isinstance(step[0], tuple) and word in step[0]):
                    after.add(step[1])
            states, at = self._closed(after), at + 1
        return final in states


def compile_template(label: str, markup: str) -> Automaton:
    steps: list = []
    skips: list[list[int]] = []
    opening, leading, mandatory, opened, at = [], True, 0, [], 0

    def add(step) -> None:
        steps.append(step)
        skips.append([])

    for m in [*MARK.finditer(markup), None]:
        for word in fold(markup[at:m.start() if m else len(markup)]):
            add((word, len(steps) + 1))
            if not opened:
                mandatory += 1
                opening += [word] if leading else []
        if m is None:
            break
        at, leading = m.end(), False
        if m[1] == "beginOptional":
            opened.append(len(steps))
            add(None)
            skips[-1].append(len(steps))
        elif m[1] == "endOptional":
            skips[opened.pop()].append(len(steps))
        elif m[4] is not None:
            add((tuple(w for x in m[4].split("|") for w in fold(x)), len(steps) + 1))
            mandatory += not opened
        else:
            low, high = int(m[2]), int(m[3])
            for k in range(high):
                add((None, len(steps) + 1))
                if k >= low:
                    skips[-1].append(len(steps) - 1 + high - k)
    add(None)
    if not opening:
        raise ValueError("a template begins with mandatory words")
    return Automaton(label, b" " + b" ".join(opening) + b" ", mandatory, steps, skips)


def scan(text: str | None, phrases: list[Automaton], templates: list[Automaton]) -> tuple[int, int, int | None, int | None, str, str, float]:
    words = fold(text)
    line = b" " + b" ".join(words) + b" "
    starts, base, labels, weight = [], set(), set(), 0
    for group, found in ((phrases, base), (templates, labels)):
        for auto in group:
            at, hit = line.find(auto.opening), False
            counted, index = 0, 0
            while at >= 0:
                index += line.count(b" ", counted, at)
                counted = at
                if (group is phrases or not hit) and auto.accepts(words, index):
                    hit = True
                    if group is phrases:
                        starts.append(index)
                at = line.find(auto.opening, at + 1) if group is phrases or not hit else -1
            if hit:
                found.add(auto.label)
                weight += auto.mandatory
    return (len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | labels)), 1 - 1 / (1 + weight))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """Per document: id, n_words, places of base phrases (n_base, first_word, last_word), base_labels, labels, and a score
    that grows with the mandatory words of all templates and phrases accepted."""
    wording = TEMPLATES if templates is None else templates

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases, compiled = ([compile_template(*x) for x in group] for group in (PHRASES, wording))
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                got = [scan(t, phrases, compiled) for t in part.column(1).to_pylist()]
                kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array([g[k] for g in got], kind) for k, kind in enumerate(kinds))],
                                                 ["id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    frame = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = frame.schema["id"].dataType.simpleString()
    return (frame.mapInArrow(run, f"id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
            .withColumnRenamed("id", id_col))
