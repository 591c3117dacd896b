"""Licence scans: an Aho-Corasick automaton over words finds notice phrases and identifier tags; tag expressions are
parsed by a shunting yard and evaluated.

Words are runs of letters, digits and anything beyond ASCII, lower-cased in A-Z only. The text's words, joined by single
spaces, go through one automaton holding all phrases with a space on either side, so that a phrase is found exactly where
its words stand one after the other. Where a tag such as `SPDX-License-Identifier:` stands, the rest of its line is read
as an expression of licence names with AND, OR and WITH, or where it is none, the longest expression it starts with.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from lanewright.llm.common import map_batches

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = {c: c + 32 for c in range(65, 91)}
#: The contract's phrases and labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Further phrases of the method.
NOTICES = {
    "bsd license": "bsd", "mozilla public license": "mpl", "lesser general public license": "lgpl", "affero general public license": "agpl",
    "isc license": "isc", "creative commons": "cc", "cc by": "cc-by", "cc by nc": "cc-by-nc", "cc by sa": "cc-by-sa", "cc by nd": "cc-by-nd", "cc0": "cc0",
    "public domain": "public-domain", "the unlicense": "unlicense", "boost software license": "bsl", "eclipse public license": "epl",
    "all rights reserved": "reserved", "permission is hereby granted free of charge": "mit", "redistribution and use in source and binary forms": "bsd",
    "spdx license identifier": None, "license identifier": None,
}
#: How freely each label's text may be used, 0 to 1; a label not named here has UNNAMED.
FREEDOM = {
    "mit": 1.0, "apache": 1.0, "bsd": 1.0, "isc": 1.0, "cc0": 1.0, "public-domain": 1.0, "unlicense": 1.0, "bsl": 1.0, "cc-by": 0.9, "cc": 0.6, "cc-by-sa": 0.6,
    "mpl": 0.6, "epl": 0.6, "lgpl": 0.5, "gpl": 0.3, "agpl": 0.2, "cc-by-nd": 0.2, "cc-by-nc": 0.1, "reserved": 0.0,
}
UNNAMED = 0.5
#: Between the tag's words stands what isn't part of a word, as for the automaton.
TAG = re.compile(r"license[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+identifier(?:[\s\"'`*_]*(:))?", re.I)
TOKEN = re.compile(r"[()\n\r]|[A-Za-z0-9][A-Za-z0-9.+-]*")
#: What may stand between the tokens of an expression that goes on.
GAP = re.compile(r"[ \t\"'`*_]*")
RANK = {"or": 1, "and": 2, "with": 3}


def line_tokens(text: str, at: int) -> Iterator[re.Match]:
    """The tokens from a place to the end of its line or the first closing point, one by one."""
    for m in TOKEN.finditer(text, at):
        if m[0] in "\n\r":
            return
        yield m
        if m[0].endswith("."):
            return


def name_of(token: str) -> str:
    """A name without the points and hyphens that end a sentence."""
    return token.lower().rstrip(".-")


def shunting_yard(expression: str, at: int = 0) -> list[str] | None:
    """Postfix order of an AND/OR/WITH expression (WITH binds closest, then AND) from a place to the end of its line; None
    where it is not well formed."""
    return ordered(m[0] for m in line_tokens(expression, at))


def ordered(tokens: Iterable[str]) -> list[str] | None:
    out: list[str] = []
    held: list[str] = []
    wants_name = True
    for token in tokens:
        t = name_of(token)
        if t == "(":
            if not wants_name:
                return None
            held.append(t)
        elif t == ")":
            if wants_name:
                return None
            while held and held[-1] != "(":
                out.append(held.pop())
            if not held:
                return None
            held.pop()
        elif t in RANK:
            if wants_name:
                return None
            while held and held[-1] != "(" and RANK[held[-1]] >= RANK[t]:
                out.append(held.pop())
            held.append(t)
            wants_name = True
        else:
            if not wants_name:
                return None
            out.append(t)
            wants_name = False
    if wants_name or "(" in held:
        return None
    return out + held[::-1]


def leading(text: str, at: int) -> list[str] | None:
    """Postfix order of the longest expression that the line starts with from a place; None where there is none.

    Prose may follow: between its tokens only blanks and quotes stand, and an operator
    that isn't in capitals needs a name after it that is a known licence's or has a digit or hyphen ('MIT or later' is MIT).
    """
    tokens: list[str] = []
    whole = depth = 0  # tokens up to the last place where all is closed
    wants_name, loose, end = True, False, None
    for m in line_tokens(text, at):
        token, t = m[0], name_of(m[0])
        if end is not None and GAP.fullmatch(text, end, m.start()) is None:
            break
        if t == "(" or (t not in RANK and t != ")"):
            if not wants_name or (loose and t != "(" and family(t) not in FREEDOM and not re.search("[0-9-]", t)):
                break
            depth += t == "("
            wants_name = t == "("
            loose = loose and t == "("
        elif wants_name or (t == ")" and not depth):
            break
        else:
            depth -= t == ")"
            wants_name = t in RANK
            loose = wants_name and not token.isupper()
        tokens.append(token)
        if not wants_name and not depth:
            whole = len(tokens)
        end = m.end()
    return ordered(tokens[:whole])


def tag_expression(text: str, tag: re.Match) -> list[str] | None:
    """Postfix order of a tag's expression. Without a colon, which prose about tags lacks too, its first name must be known."""
    if tag[1]:
        return shunting_yard(text, tag.end()) or leading(text, tag.end())
    first = next((m for m in line_tokens(text, tag.end()) if m[0] != "("), None)
    if first is None or GAP.fullmatch(text[tag.end() : first.start()].replace("(", " ")) is None or family(name_of(first[0])) not in FREEDOM:
        return None
    return leading(text, tag.end())


def family(name: str) -> str:
    """The label of a licence name: its family where FREEDOM knows a leading part, else the name itself."""
    parts = name.lower().rstrip("+").split("-")
    known = ["-".join(parts[:n]) for n in range(len(parts), 0, -1)]
    return next((x for x in known if x in FREEDOM), name.lower())


def evaluate(postfix: list[str]) -> tuple[set[str], float]:
    """Labels named, and freedom: of AND the least, of OR the most, of WITH that of the licence it amends."""
    stack: list[tuple[set[str], float]] = []
    for t in postfix:
        if t not in RANK:
            stack.append(({family(t)}, FREEDOM.get(family(t), UNNAMED)))
            continue
        b, a = stack.pop(), stack.pop()
        stack.append(a if t == "with" else (a[0] | b[0], min(a[1], b[1]) if t == "and" else max(a[1], b[1])))
    return stack[-1]


def automaton(phrases: dict[str, str | None]) -> ahocorasick.Automaton:
    made = ahocorasick.Automaton()
    for phrase, label in phrases.items():
        made.add_word(f" {phrase} ", (phrase, label))
    made.make_automaton()
    return made


def scan_text(text: str | None, phrases: ahocorasick.Automaton) -> tuple[int, int, int | None, int | None, str, str, float]:
    """n_words, n_base, first and last base start, base labels, all labels, score."""
    lowered = (text or "").translate(LOWER) if not (text or "").isascii() else (text or "").lower()
    words = WORD.findall(lowered)
    line = f" {' '.join(words)} "
    base, starts, tagged = set(), [], False
    notices: dict[int, tuple[int, str]] = {}  # the longest phrase at each place
    at = word = 0
    for end, (phrase, label) in phrases.iter(line):
        start = end - len(phrase) - 1
        if phrase in BASE:
            if start >= at:
                word += line.count(" ", at, start)
                at = start
                number = word
            else:
                number = line.count(" ", 0, start)
            starts.append(number)
            base.add(label)
        tagged |= label is None
        if label:
            notices[start] = max(notices.get(start, (0, "")), (len(phrase), label))
    labels, free, far = set(base), [], -1
    for start, (size, label) in sorted(notices.items()):  # a phrase within a longer notice doesn't count beside it
        if start + size > far:
            far = start + size
            labels.add(label)
            free.append(FREEDOM[label])
    for m in TAG.finditer(text) if tagged else ():
        postfix = tag_expression(text, m)
        if postfix:
            named, freedom = evaluate(postfix)
            labels |= named
            free.append(freedom)
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), min(free, default=0.0)


def scan(docs: DataFrame, rows: int = 128) -> DataFrame:
    """One row per row of docs: words, places of base phrases, labels and a score.

    score is the least freedom among the document's notices and tag expressions (0 to 1), 0 where it names no licence. A phrase
    that is part of a longer notice has no say in it, though its base label stays. Null and empty texts have no words and no labels
    ('' and null starts). A tag that no expression follows adds nothing. Texts are read whole; repeated rows give repeated
    results, other columns of docs are ignored, and an empty table gives an empty one.
    """

    def start():
        phrases = automaton(BASE | NOTICES)
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64()]
        names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]

        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [scan_text(t, phrases) for t in batch.column(1).to_pylist()]
            columns = list(zip(*found, strict=True)) if found else [()] * len(types)
            return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=names)

        return apply

    return map_batches(docs.select("doc_id", "text"), start, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double", rows)
