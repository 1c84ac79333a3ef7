"""License scans: phrases, and templates with optional and replaceable regions matched by token automata."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from careflow.llm.text import raw

#: Phrases and their labels: fixed values.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Templates and their labels: fixed values. `<<opt>>...<</opt>>` may be absent; `<<var;1-3>>` stands for one to three words of any
#: kind, `<<var;1-1;a|b>>` for words out of a list. All other words are mandatory.
TEMPLATES = [
    ("mit", "<<var;1-1;released|licensed|distributed|available>> under <<opt>>the terms of<</opt>> the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files "
            "<<opt>>the software<</opt>> to deal in the software without restriction"),
    ("apache-2.0", "licensed under the apache license <<opt>>version<</opt>> 2 0"),
    ("gpl-2.0", "gnu general public license <<opt>>as published by the free software foundation<</opt>> <<opt>>either<</opt>> <<var;1-1;version|v>> 2"),
    ("gpl-3.0", "gnu general public license <<opt>>as published by the free software foundation<</opt>> <<opt>>either<</opt>> <<var;1-1;version|v>> 3"),
    ("cc-by-4.0", "<<var;1-1;released|licensed>> under <<opt>>a<</opt>> <<opt>>the<</opt>> cc by 4 0"),
    ("cc-by-sa-4.0", "<<var;1-1;released|licensed>> under <<opt>>a<</opt>> <<opt>>the<</opt>> cc by sa 4 0"),
    ("cc-by-nc-4.0", "<<var;1-1;released|licensed>> under <<opt>>a<</opt>> <<opt>>the<</opt>> cc by nc 4 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2.0", "subject to the terms of the mozilla public license <<opt>>version<</opt>> <<opt>>v<</opt>> 2 0"),
    ("rights-reserved", "copyright <<var;1-12>> all rights reserved"),
]
MARKUP = re.compile(r"<<(opt|/opt|var;(\d+)-(\d+)(?:;([^>]*))?)>>|([^\s<]+)")
FOUND_SQL = ("id {}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
             "spans array<struct<label:string,first:int,last:int>>")
#: Lower-cases A-Z, keeps 0-9, a-z and every byte of a character outside ASCII, and blanks the rest.
TO_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


@dataclass
class Automaton:
    """States 0..n; `steps[s]` are (words or None for any, next state), `free[s]` states reached without a word. The last state accepts."""

    label: str
    steps: list[list[tuple[frozenset[bytes] | None, int]]] = field(default_factory=list)
    free: list[list[int]] = field(default_factory=list)
    key: bytes = b""
    before: int = 0

    def state(self) -> int:
        self.steps.append([])
        self.free.append([])
        return len(self.steps) - 1

    def spread(self, states: set[int]) -> set[int]:
        todo, out = list(states), set(states)
        while todo:
            for t in self.free[todo.pop()]:
                if t not in out:
                    out.add(t)
                    todo.append(t)
        return out

    def match(self, words: list[bytes], start: int) -> int:
        """End of the longest accepted run of words from `start`, or -1."""
        now, best, at = self.spread({0}), -1, start
        while now and at < len(words):
            now = self.spread({t for s in now for allowed, t in self.steps[s] if allowed is None or words[at] in allowed})
            at += 1
            if len(self.steps) - 1 in now:
                best = at
        return best


def compile_template(label: str, template: str) -> Automaton:
    """Token automaton of a template; its key is the longest run of words that every accepted text holds, `before` the most words in front of it."""
    a = Automaton(label)
    here, opened = a.state(), []
    length = 0
    runs: list[tuple[int, list[bytes]]] = [(0, [])]
    for tag, low, high, allowed, word in (m.groups() for m in MARKUP.finditer(template)):
        if word:
            nxt = a.state()
            a.steps[here].append((frozenset([word.encode()]), nxt))
            here, length = nxt, length + 1
            if not opened:
                runs[-1][1].append(word.encode())
            continue
        if tag == "opt":
            opened.append(here)
        elif tag == "/opt":
            nxt = a.state()
            a.free[here].append(nxt)
            a.free[opened.pop()].append(nxt)
            here = nxt
        else:
            words = frozenset(w.encode() for w in allowed.split("|")) if allowed else None
            for i in range(int(high)):
                nxt = a.state()
                a.steps[here].append((words, nxt))
                if i >= int(low):
                    a.free[here].append(nxt)
                here = nxt
            length += int(high)
        runs.append((length, []))
    if opened or not any(r for _, r in runs):
        raise ValueError(f"{template!r}: an optional part is left open, or no word is mandatory")
    a.before, key = max(runs, key=lambda r: sum(map(len, r[1])))
    a.key = b" " + b" ".join(key) + b" "
    return a


def _places(joined: bytes, phrase: bytes) -> Iterator[int]:
    """Word numbers at which a phrase, written with a blank on each side, starts."""
    at = joined.find(phrase)
    seen = counted = 0
    while at >= 0:
        seen += joined.count(b" ", counted, at)
        counted = at
        yield seen
        at = joined.find(phrase, at + 1)


def scan_text(text: bytes | None, phrases: dict[bytes, str], automata: list[Automaton]) -> tuple:
    words = text.translate(TO_WORDS).split() if text else []
    joined = b" " + b" ".join(words) + b" "
    places = [(at, label) for phrase, label in phrases.items() for at in _places(joined, phrase)]
    spans = []
    for a in automata:
        end = 0
        for at in _places(joined, a.key):
            for start in range(max(end, at - a.before), at + 1):
                stop = a.match(words, start)
                if stop > at:
                    spans.append({"label": a.label, "first": start, "last": stop - 1})
                    end = stop
                    break
    base = {label for _, label in places}
    starts = [at for at, _ in places]
    return (len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)),
            ",".join(sorted(base | {s["label"] for s in spans})), 1.0 if spans else 0.5 if places else 0.0, spans)


def scan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] | None = None, templates: list[tuple[str, str]] | None = None,
) -> DataFrame:
    """Scan every whole text for phrases and templates.

    Words are runs of ASCII letters (A-Z lower-cased), digits and characters outside ASCII. Returns a row for each input row:
    `id_col`, `n_words`, `n_base` (places of all phrases), `first_word` and `last_word` (smallest and largest start of a place,
    from 0; null without one), `base_labels`, `labels` (those of matched templates too; both sorted, comma-joined, empty
    without any), `score` (1 if a template is matched, 0.5 if only a phrase is, else 0) and `spans` (label, first and last
    word of each template match).

    Each template is an automaton over words. It is tried only around the places of its longest mandatory run of words, at
    every start that its optional and replaceable regions allow, and the longest match from the first such start counts.
    Null and empty texts have no words. Null and repeated ids keep their rows; other columns are ignored; an empty table
    gives no rows.
    """
    sought = {f" {p} ".encode(): label for p, label in (PHRASES if phrases is None else phrases).items()}
    automata = [compile_template(label, t) for label, t in (TEMPLATES if templates is None else templates)]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(),
                 pa.list_(pa.struct([("label", pa.string()), ("first", pa.int32()), ("last", pa.int32())]))]
        names = ["id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
        for part in parts:
            columns = zip(*[scan_text(t, sought, automata) for t in raw(part.column(1))]) if part.num_rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(list(c), k) for c, k in zip(columns, kinds)]], names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, FOUND_SQL.format(kind))
    return out.withColumnRenamed("id", id_col)
