"""Licences recognised from sentences and ordered rules (operator 10).

A known sentence is a run of words (letters and digits, lower-cased) that
begins and ends at a sentence border: the ends of the text, a line break, or
one of . ! ? ; : before a blank. Line breaks within it don't matter, so
wrapped licence texts are recognised. A rule is a sequence of known sentences
that name a licence; it matches where its sentences follow one another with
nothing between but the mark of a list item. Longer rules are tried first, and
a sentence belongs to one match only. A sentence may have a gap for a holder's
name. A name of a licence is a match as a title, or after a lead such as
"Licensed under the"; "see ..." may follow. SPDX-License-Identifier tags give a
match for each licence of their expression, with its exception.

Defined results: null, empty and blank texts have no matches. Rows are taken
one by one, so repeated ids give repeated rows.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pdengine.llm.license_texts import ARTICLES, LEADS, NAMES, RULES, SENTENCES, SPDX
from pdengine.llm.tables import slices

_WORD = re.compile(r"[^\W_]+")
_BORDER = re.compile(r"\n|[.!?;:](?=\s|$)|(?<=[.!?;:])[)\"']+(?=\s|$)")
#: A text without any of these has no match: each rule's first sentence, each title and each lead holds one.
_MARK = re.compile(
    r"licen|permission|copyright|redistribut|domain|cc0|spdx|(?:released|distributed|available|published|provided)\W+under", re.I
)
_ITEM = re.compile(r"\d{1,2}|[a-z]|[ivx]{2,4}")
_GAP, _GAP_WORDS = "…", 12
_SPDX_TAG = re.compile(r"SPDX-License-Identifier:[ \t]*(?=\S)", re.I)
_SPDX_TOKEN = re.compile(r"[ \t]*([()]|[^\W_][\w.:+-]*)")
_SPELLING = {"licence": "license", "licences": "licenses", "licenced": "licensed"}


def _words(text: str) -> list[str]:
    return [_SPELLING.get(w, w) for w in _WORD.findall(text.lower())]


class Phrases:
    """Word sequences by first word and length; the longest that stands at a place comes first."""

    def __init__(self, phrases):
        self.starts: dict[str, dict[int, dict[tuple[str, ...], object]]] = {}
        for text, value in phrases:
            key = tuple(_words(text))
            self.starts.setdefault(key[0], {}).setdefault(len(key), {}).setdefault(key, value)
        self.starts = {w: dict(sorted(known.items(), reverse=True)) for w, known in self.starts.items()}

    def at(self, word: list[str], i: int):
        """Ends (exclusive) and values of the phrases that begin at word ``i``, longest first."""
        for n, known in self.starts.get(word[i], {}).items() if i < len(word) else ():
            value = known.get(tuple(word[i : i + n]))
            if value is not None:
                yield i + n, value


def _spdx_name(token: str) -> str | None:
    """A listed identifier as the list writes it, others if they are references or end in a version."""
    gnu = re.fullmatch(r"(a?gpl|lgpl)-(\d\.\d)(\+)?", token.lower())
    if gnu:
        return f"{gnu[1].upper()}-{gnu[2]}-{'or-later' if gnu[3] else 'only'}"
    plus = "+" if token.endswith("+") else ""
    name = token.removesuffix("+")
    known = SPDX.get(name.lower())
    return f"{known}{plus}" if known else token if re.search(r"LicenseRef-.|.-\d[\w.]*$", name) else None


def spdx(text: str) -> list[tuple[str, int, int]]:
    """Licences of the SPDX tags of a text, each with its exception, and their places."""
    out = []
    for tag in _SPDX_TAG.finditer(text):
        at, operand, closing = tag.end(), True, False
        while token := _SPDX_TOKEN.match(text, at):
            word, a = token[1], token.start(1)
            if word in "()":
                if (word == "(") != operand:
                    break
            elif operand:
                word = word.rstrip(".:")
                name = _spdx_name(word)
                if closing and out and out[-1][2] <= a:
                    out[-1] = (f"{out[-1][0]} WITH {word}", out[-1][1], a + len(word))
                elif name and not closing:
                    out.append((name, a, a + len(word)))
                held, operand, closing = bool(name) and not closing, False, False
            elif word.upper() in ("AND", "OR"):
                operand = True
            elif word.upper() == "WITH" and held:
                operand = closing = True
            else:
                break
            at = token.end()
    return out


class Scanner:
    """Known sentences by first word; rules by first sentence, longest first; names of licences after leads or as titles."""

    def __init__(self, sentences: dict[str, str] = SENTENCES, rules=RULES, names=NAMES):
        self.known = Phrases((text, name) for name, text in sentences.items() if _GAP not in text)
        self.gapped: dict[str, list[tuple[list[tuple[str, ...]], str]]] = {}
        for name, text in sentences.items():
            if _GAP in text:
                parts = [tuple(_words(p)) for p in text.split(_GAP)]
                self.gapped.setdefault(parts[0][0], []).append((parts, name))
        self.leads = Phrases((lead, True) for lead in LEADS)
        self.names = Phrases((name, licence) for name, licence, _ in names)
        self.titles = Phrases((f"{the}{name}", licence) for name, licence, title in names if title for the in ("", "the "))
        self.rules: dict[str, list[tuple[tuple[str, ...], str]]] = {}
        for licence, sequence in rules:
            self.rules.setdefault(sequence[0], []).append((tuple(sequence), licence))
        for known in self.rules.values():
            known.sort(key=lambda k: -len(k[0]))
        self.marked = all(_MARK.search(sentences[first]) for first in self.rules)

    def _gapped(self, word: list[str], last: list[bool], ended: list[bool], i: int):
        for parts, name in self.gapped.get(word[i], ()):
            j = i + len(parts[0])
            if tuple(word[i:j]) != parts[0]:
                continue
            for part in parts[1:]:
                if part:
                    places = range(j + 1, min(j + _GAP_WORDS, len(word) - len(part)) + 1)
                    j = next((k + len(part) for k in places if tuple(word[k : k + len(part)]) == part), 0)
                else:  # the rest of the sentence
                    j = next((k for k in range(j + 1, len(word) + 1) if ended[k - 1]), 0)
                if not j:
                    break
            if j and last[j - 1]:
                yield j, name

    def _notice(self, word: list[str], last: list[bool], i: int) -> list[tuple[str, int, int]]:
        """Licences named after a lead, with first and last word; several are joined by and / or."""
        for at, _ in self.leads.at(word, i):
            out, a, j = [], i, at
            while True:
                while j < len(word) and j - at < 4 and word[j] in ARTICLES and not out:
                    j += 1
                if out and j < len(word) and word[j] in ARTICLES:
                    j += 1
                ends = [(k, n) for k, n in self.names.at(word, j) if last[k - 1] or (k < len(word) and word[k] in ("and", "or"))]
                if not ends:
                    break
                end, name = ends[0]
                out.append((name, a, end))
                if last[end - 1]:
                    return out
                a = j = end + 1
        return []

    def sentences(self, text: str) -> list[tuple[str | tuple[str], int, int, int, int, bool]]:
        """Known sentences of a text: name (in a tuple if it is a licence's), places of characters and words, does the next follow."""
        if self.marked and not _MARK.search(text):
            return []
        found = [(m.group().lower(), m.start(), m.end()) for m in _WORD.finditer(text)]
        if not found:
            return []
        word = [_SPELLING.get(w, w) for w, _, _ in found]
        # a line break ends a sentence that is known to end there; only marks and empty lines (ended) end one with a gap
        first, last, ended = ([False] * len(found) for _ in range(3))
        first[0] = last[-1] = ended[-1] = True
        borders = [m.start() for m in _BORDER.finditer(text)]
        at, broken = 0, -1
        for b in borders:
            while at < len(found) and found[at][1] < b:
                at += 1
            if 0 < at:
                last[at - 1] = True
                ended[at - 1] |= text[b] != "\n" or broken == at
            broken = at if text[b] == "\n" else broken
            if at < len(found):
                first[at] = True
        for i in range(len(word) - 1):
            if first[i] and text[found[i][2] : found[i][2] + 1] == ")" and _ITEM.fullmatch(word[i]):
                first[i + 1] = True  # the mark of a list item, as 1) or (a)
            if word[i + 1] == "see":
                last[i] = True  # "..., see the file LICENSE"
        out, i = [], 0
        while i < len(word):
            hits = []
            if first[i]:
                ends = [next(((j, n) for j, n in self.known.at(word, i) if last[j - 1]), None), *self._gapped(word, last, ended, i)]
                title = next(((j, (n,)) for j, n in self.titles.at(word, i) if last[j - 1]), None)
                hits = [[(n, i, j)] for j, n in (e for e in (*ends, title) if e)]
                hits.append([((n,), a, b) for n, a, b in self._notice(word, last, i)])
                hits = max(hits, key=lambda h: h[-1][2] if h else 0)
            for name, a, b in hits:
                start, stop = found[a][1], found[b - 1][2]
                if isinstance(name, tuple) and name[0].endswith("-only") and "+" in text[start : stop + 1]:
                    name = (name[0].removesuffix("-only") + "-or-later",)
                out.append((name, start, stop, a, b))
            i = hits[-1][2] if hits else i + 1
        between = [word[a[4] : b[3]] for a, b in zip(out, out[1:], strict=False)]
        return [(*hit, not skipped or len(skipped) == 1 and bool(_ITEM.fullmatch(skipped[0]))) for hit, skipped in zip(out, [*between, []], strict=False)]

    def licences(self, text: str | None) -> list[tuple[str, int, int]]:
        """Licences named in a text, in order: name, and first and last character's places."""
        if not text:
            return []
        known = self.sentences(text)
        out, i = [], 0
        while i < len(known):
            taken = 1
            if isinstance(known[i][0], tuple):
                out.append((known[i][0][0], known[i][1], known[i][2]))
            for sequence, licence in self.rules.get(known[i][0], ()):
                part = known[i : i + len(sequence)]
                if tuple(p[0] for p in part) == sequence and all(p[5] for p in part[:-1]):
                    out.append((licence, part[0][1], part[-1][2]))
                    taken = len(sequence)
                    break
            i += taken
        tags = spdx(text)
        if tags:
            out = [o for o in out if not any(a < o[2] and o[1] < b for _, a, b in tags)] + tags
            out.sort(key=lambda o: o[1:])
        return out


def _scan(scanner: Scanner):
    match = pa.list_(pa.struct([("licence", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))

    def task(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                rows = [
                    [{"licence": n, "start": a, "stop": b} for n, a, b in scanner.licences(t)]
                    for t in batch.column("text").to_pylist()
                ]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, match)], names=["doc_id", "matches"])

    return task


def scan(docs: DataFrame, sentences: dict[str, str] = SENTENCES, rules=RULES) -> DataFrame:
    """``doc_id`` and ``matches`` (array of licence, start, stop in code points) for each row of ``docs``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(
        _scan(Scanner(sentences, rules)), "doc_id long, matches array<struct<licence: string, start: long, stop: long>>"
    )
