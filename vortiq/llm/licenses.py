"""Fuzzy search for short license notices.

A notice with at most k errors, cut into k + 1 pieces, keeps one piece unharmed (pigeonhole). One automaton finds
all pieces of all notices in a text's normal form; each hit opens a window around where the notice would lie, and
only in windows does the regex library match the notice with bounded errors, between word ends.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import annotate, fresh

# Fixed values of the contract: what counts as a word, and phrases that are found exactly with their labels.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PHRASES = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]
LOWERED = {c: c + 32 for c in range(65, 91)}


@dataclass(frozen=True)
class Notice:
    """Words of a notice, joined by spaces, and the number of characters that may be missing, added or other."""

    label: str
    text: str
    errors: int


# Short notices as projects print them, in the normal form of words.
NOTICES = [
    Notice("mit", "mit license", 1),
    Notice("apache", "apache license", 1),
    Notice("gpl", "general public license", 2),
    Notice("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", 6),
    Notice("apache", "licensed under the apache license version 2 0", 4),
    Notice("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", 6),
    Notice("lgpl", "gnu lesser general public license", 3),
    Notice("agpl", "gnu affero general public license", 3),
    Notice("bsd", "redistribution and use in source and binary forms with or without modification are permitted", 6),
    Notice("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", 6),
    Notice("mpl", "this source code form is subject to the terms of the mozilla public license", 5),
    Notice("epl", "eclipse public license", 2),
    Notice("unlicense", "this is free and unencumbered software released into the public domain", 5),
    Notice("cc by", "licensed under cc by 4 0", 1),
    Notice("cc by sa", "licensed under cc by sa 4 0", 1),
    Notice("cc by nc", "licensed under cc by nc 4 0", 1),
    Notice("cc by nd", "licensed under cc by nd 4 0", 1),
    Notice("cc by nc sa", "licensed under cc by nc sa 4 0", 1),
    Notice("cc by nc nd", "licensed under cc by nc nd 4 0", 1),
    Notice("cc", "creative commons attribution", 2),
    Notice("reserved", "all rights reserved", 1),
]


def cut(notice: Notice) -> list[tuple[int, str]]:
    """errors + 1 pieces of nearly equal size, with their offsets."""
    n, k = len(notice.text), notice.errors + 1
    at = [n * i // k for i in range(k + 1)]
    return [(a, notice.text[a:b]) for a, b in zip(at, at[1:])]


class Finder:
    """Automaton over all pieces and bounded-error expressions; one a worker process."""

    def __init__(self, notices: list[Notice]):
        import ahocorasick
        import regex

        self.notices = notices
        self.word = regex.compile(WORD)
        owners: dict[str, list[tuple[int, int]]] = {}
        for k, notice in enumerate(notices):
            for at, piece in cut(notice):
                owners.setdefault(piece, []).append((k, at + len(piece)))
        self.seeds = ahocorasick.Automaton()
        for piece, own in owners.items():
            self.seeds.add_word(piece, own)
        if owners:
            self.seeds.make_automaton()
        between = lambda n, e: regex.compile(rf"(?e)(?<= )(?:{regex.escape(n.text)}){{e<={e}}}(?= )")
        self.exact = [[between(n, e) for e in range(n.errors + 1)] for n in notices]

    def windows(self, told: str) -> dict[int, list[list[int]]]:
        """Per notice the places of ' w1 w2 ... ' where it may lie, merged where they touch. A window reaches from the
        space before the earliest start to the space behind the latest end."""
        out: dict[int, list[list[int]]] = {}
        if not len(self.seeds):
            return out
        for end, owners in self.seeds.iter(told):
            for k, upto in owners:
                notice = self.notices[k]
                # the piece ends at end + 1; before it lie upto - len(piece) characters, give or take the errors
                start = max(0, end - upto - notice.errors)
                stop = min(len(told), end + 2 + len(notice.text) - upto + notice.errors)
                own = out.setdefault(k, [])
                if own and start <= own[-1][1]:
                    own[-1][0], own[-1][1] = min(own[-1][0], start), max(own[-1][1], stop)
                else:
                    own.append([start, stop])
        return out

    def least(self, k: int, told: str, start: int, stop: int) -> int | None:
        """Fewest errors with which notice k lies in the window; None beyond its bound."""
        return next((e for e, pattern in enumerate(self.exact[k]) if pattern.search(told, start, stop)), None)

    def fuzzy(self, told: str) -> list[tuple[int, int, int, int]]:
        """(start, end, notice, errors) of matches in ' w1 w2 ... ', by start; leftmost, apart within a notice."""
        found = set()
        for k, windows in self.windows(told).items():
            for start, stop in windows:
                if self.least(k, told, start, stop) is not None:
                    found |= {(m.start(), m.end(), k, sum(m.fuzzy_counts)) for m in self.exact[k][-1].finditer(told, start, stop)}
        return sorted(found)

    def scan(self, text: str) -> dict:
        """Numbers and spans of one text. Spans (label, start, end, errors, notice) are in code points of the text."""
        low = text.translate(LOWERED)
        words = self.word.findall(low)
        told = " " + " ".join(words) + " " if words else ""
        places, base = [], set()
        for phrase, label in PHRASES:
            seek = f" {phrase} "
            at = told.find(seek)
            while at >= 0:
                places.append(at)
                base.add(label)
                at = told.find(seek, at + 1)
        windows = self.windows(told) if words else {}
        labels, score = set(base), 1.0 if base else 0.0
        hit = False
        for k, own in windows.items():
            notice = self.notices[k]
            errors = [e for start, stop in own if (e := self.least(k, told, start, stop)) is not None]
            if errors:
                hit = True
                labels.add(notice.label)
                score = max(score, 1 - min(errors) / len(notice.text))
        spans = []
        if hit:
            # characters of the normal form back to the text: words by number, then the text's own places
            starts = [(m.start(), m.end()) for m in self.word.finditer(low)]
            begins, at = {}, 1
            for nth, word in enumerate(words):
                begins[at] = nth
                begins[at + len(word)] = nth
                at += len(word) + 1
            spans = [{"label": self.notices[k].label, "start": starts[begins[a]][0], "end": starts[begins[b]][1], "errors": e, "notice": self.notices[k].text} for a, b, k, e in self.fuzzy(told)]
        number = lambda at: told.count(" ", 0, at)
        return {"n_words": len(words), "n_base": len(places), "first_word": number(min(places)) if places else None, "last_word": number(max(places)) if places else None, "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(labels)), "score": score, "notices": spans}


ADDED = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, notices array<struct<label:string,start:long,end:long,errors:int,notice:string>>"


def scan(docs: DataFrame, columns: tuple[str, ...] = ("doc_id",), prefix: str | None = None, notices: list[Notice] = NOTICES) -> DataFrame:
    """The given columns of docs with what is found in the whole text, one pass without a shuffle.

    n_words; n_base, first_word and last_word: places of the exact phrases, their number and the smallest and largest
    word at which one starts (null: none); base_labels and labels, the latter with those of notices found with bounded
    errors, distinct, sorted, comma-joined; score: 1 less the share of errors of the best notice, 0 without one;
    notices: spans in code points. Added names begin with prefix, where one is needed to keep them apart.

    Null and empty texts have no words. Each row gets its own row, repeated ones included; a null id stays null; an
    empty table gives an empty result. Memory is one batch of texts; a window is as long as hits of one notice follow
    one another.
    """

    def work():
        finder = Finder(notices)

        def of(texts: list[str]) -> list[pa.Array]:
            rows = [finder.scan(t) for t in texts]
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("errors", pa.int32()), ("notice", pa.string())]))]
            return [pa.array([r[c.split()[0]] for r in rows], kind) for c, kind in zip(ADDED.split(", ", 7), kinds)]

        return of

    taken = {c.lower() for c in columns}
    if prefix is None:
        prefix = fresh(columns) if taken & {c.split()[0] for c in ADDED.split(", ", 7)} else ""
    return annotate(docs, columns, ADDED, work, prefix)


def digest(docs: DataFrame) -> DataFrame:
    """scan() of doc_id and text, without the spans."""
    return scan(docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"])).drop("notices")
