"""License scans: an Aho-Corasick automaton over words and a shunting-yard parser for expressions."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from tremorlake.llm.common import arrow_map

# Phrase of words, label.
BASE_PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# Further notices and their labels; an empty label adds to the score alone. Of phrases that begin at one
# word the longest counts.
NOTICE_PHRASES = {
    "all rights reserved": "all-rights-reserved",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "isc license": "isc",
    "boost software license": "bsl",
    "creative commons attribution": "cc-by",
    "creative commons attribution sharealike": "cc-by-sa",
    "creative commons attribution share alike": "cc-by-sa",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution non commercial": "cc-by-nc",
    "creative commons attribution noderivatives": "cc-by-nd",
    "creative commons attribution noderivs": "cc-by-nd",
    "creative commons attribution no derivatives": "cc-by-nd",
    "creative commons attribution noncommercial sharealike": "cc-by-nc-sa",
    "creative commons attribution noncommercial noderivatives": "cc-by-nc-nd",
    "creative commons attribution noncommercial noderivs": "cc-by-nc-nd",
    "cc by sa": "cc-by-sa",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "cc by nc sa": "cc-by-nc-sa",
    "cc by nc nd": "cc-by-nc-nd",
    "creative commons zero": "public-domain",
    "cc0 1 0 universal": "public-domain",
    "public domain": "public-domain",
    "zlib license": "zlib",
    "artistic license": "artistic",
    "european union public license": "eupl",
    "european union public licence": "eupl",
    "business source license": "busl",
    "server side public license": "sspl",
    "python software foundation license": "psf",
    "sil open font license": "ofl",
    "permission to use copy modify and or distribute this software for any purpose": "isc",
    "permission is hereby granted free of charge": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "redistributions of source code must retain the above copyright notice": "bsd",
    "licensed under": "",
    "released under": "",
    "without warranty of any kind": "",
}
#: Words that announce an expression where a colon follows, and whether its first name may be of no known family.
TAGS = {"spdx license identifier": True, "license": False, "licence": False}

# Whole identifiers by family, in lower case; a version is written as in gpl-3.0, gplv3 or gpl3.
_VERSION = r"(?:-?v?[0-9]+(?:\.[0-9]+)*)?"
_LATER = r"(?:\+|-only|-or-later)?"
_PLACE = r"(?:-[a-z]{2,3})?"
FAMILIES = {
    "gpl": rf"(?:gnu-)?gpl{_VERSION}{_LATER}",
    "lgpl": rf"(?:gnu-)?lgpl{_VERSION}{_LATER}",
    "agpl": rf"(?:gnu-)?agpl{_VERSION}{_LATER}",
    "apache": rf"apache{_VERSION}\+?|asl-2\.0",
    "mit": r"mit(?:-(?:0|advertising|cmu|enna|feh|festival|license|modern-variant|open-group|wu))?|expat",
    "bsd": r"0bsd|bsd(?:-?[1-4](?:-clause)?(?:-(?:attribution|clear|lbnl|modification|patent|shortened|uc|views))?)?",
    "mpl": rf"mpl{_VERSION}\+?(?:-no-copyleft-exception)?",
    "epl": rf"epl{_VERSION}",
    "eupl": rf"eupl{_VERSION}",
    "cc-by": rf"cc-by{_VERSION}{_PLACE}",
    "cc-by-sa": rf"cc-by-sa{_VERSION}{_PLACE}",
    "cc-by-nc": rf"cc-by-nc{_VERSION}{_PLACE}",
    "cc-by-nd": rf"cc-by-nd{_VERSION}{_PLACE}",
    "cc-by-nc-sa": rf"cc-by-nc-sa{_VERSION}{_PLACE}",
    "cc-by-nc-nd": rf"cc-by-nc-nd{_VERSION}{_PLACE}",
    "public-domain": r"cc0(?:-1\.0)?|unlicense|pddl-1\.0",
    "isc": r"isc(?:-veillard)?",
    "bsl": r"bsl(?:-1\.0)?",
    "busl": r"busl-1\.1|bsl-1\.1",
    "sspl": rf"sspl{_VERSION}",
    "zlib": r"zlib(?:-acknowledgement)?",
    "artistic": rf"artistic{_VERSION}(?:-(?:perl|cl8))?",
    "psf": r"psf-2\.0|python-2\.0(?:\.1)?",
    "ofl": r"ofl-1\.[01](?:-(?:no-)?rfn)?",
    "ncsa": r"ncsa",
    "postgresql": r"postgresql",
    "x11": r"x11",
    "upl": r"upl-1\.0",
}
_FAMILY = re.compile("|".join(f"(?P<{k.replace('-', '_')}>{v})" for k, v in FAMILIES.items()))
#: Families that a training corpus may use freely.
PERMISSIVE = frozenset({"apache", "mit", "bsd", "cc-by", "isc", "bsl", "public-domain", "zlib", "psf", "ncsa", "postgresql", "x11", "upl"})

PRECEDENCE = {"or": 1, "and": 2, "with": 3}
_SYMBOL = re.compile(r"[()]|[A-Za-z0-9][A-Za-z0-9.+:-]*")
#: A colon or an equals sign behind a tag, which may be quoted as what follows may be.
_COLON = re.compile(rb"[\"']?[ \t]*[:=][ \t]*[\"']?")
#: A symbol behind spaces of the same line; anything else ends an expression.
_NEXT = re.compile(rb"[ \t]*([()]|[A-Za-z0-9](?:[A-Za-z0-9.+:-]*[A-Za-z0-9+])?)")
#: The end of a line in an unfinished expression, and the mark that the next line of a comment begins with.
_WRAP = re.compile(rb"[ \t]*\r?\n[ \t]*(?:#+|//+|\*+|--+|;+|%+)?")
#: Names of no known family: hyphens join their parts, and a capital or a digit tells them from prose.
_NAME = re.compile(r"(?=.*[A-Z0-9])(?:[A-Za-z0-9.+]+-)+[A-Za-z0-9.+]+")
_NOT_WORD = bytes(i if 0x30 <= i <= 0x39 or 0x61 <= i <= 0x7A or i >= 0x80 else 0x20 for i in range(256))


@lru_cache(4096)
def known(identifier: str) -> str | None:
    """The family whose identifiers the whole of this one matches, if any."""
    m = _FAMILY.fullmatch(identifier.lower())
    return m.lastgroup.replace("_", "-") if m else None


def family(identifier: str) -> str:
    """The label of one licence identifier; identifiers of no known family are their own label."""
    return known(identifier) or identifier.lower()


def symbols(raw: bytes, at: int) -> Iterator[str]:
    """Names, operators and parentheses from a place on, up to any other character or the end of the line; behind an
    operator and in parentheses the next line goes on."""
    depth, wraps = 0, False
    while True:
        m = _NEXT.match(raw, at)
        if not m and (wraps or depth > 0) and (w := _WRAP.match(raw, at)):
            m = _NEXT.match(raw, w.end())
        if not m:
            return
        s = m[1].decode("ascii")
        depth += (s == "(") - (s == ")")
        wraps = s.lower() in PRECEDENCE
        yield s
        at = m.end()


def leading_expression(found: Iterable[str], any_first: bool = True) -> str:
    """The longest expression that some symbols begin with, its open parentheses closed; empty if there is none.

    The first name may be any if ``any_first``; the others are of known families, or a hyphen joins
    their parts, so prose after an expression ends it and an operator without a name is left out."""
    taken: list[str] = []
    depth, whole, open_, operand = 0, 0, 0, True
    for s in found:
        if s == "(" if operand else s == ")" and depth:
            depth += 1 if operand else -1
        elif not operand and s.lower() in PRECEDENCE:
            operand = True
        elif operand and s not in "()" and s.lower() not in PRECEDENCE and ((any_first and not whole) or known(s) or _NAME.fullmatch(s)):
            operand = False
        else:
            break
        taken.append(s)
        if not operand:
            whole, open_ = len(taken), depth
    return " ".join(taken[:whole] + [")"] * open_)


def to_postfix(text: str) -> list[str] | None:
    """A licence expression in postfix order, by the shunting-yard rule; None if it is not one.
    ``with`` binds closest, then ``and``, then ``or``; all associate to the left."""
    out: list[str] = []
    held: list[str] = []
    operand = True
    for s in _SYMBOL.findall(text):
        op = s.lower()
        if op in PRECEDENCE:
            if operand:
                return None
            while held and held[-1] != "(" and PRECEDENCE[held[-1]] >= PRECEDENCE[op]:
                out.append(held.pop())
            held.append(op)
            operand = True
        elif s == "(":
            if not operand:
                return None
            held.append(s)
        elif s == ")":
            if operand:
                return None
            while held and held[-1] != "(":
                out.append(held.pop())
            if not held:
                return None
            held.pop()
        else:
            if not operand:
                break  # prose after the expression
            out.append(s)
            operand = False
    if operand or "(" in held:
        return None
    return out + held[::-1]


def evaluate(postfix: list[str]) -> tuple[set[str], bool]:
    """The labels in an expression and whether it can be met by permissive licences alone:
    ``or`` needs one side, ``and`` both; ``with`` keeps its licence and adds an exception."""
    stack: list[tuple[set[str], bool]] = []
    for s in postfix:
        if s in PRECEDENCE:
            b, a = stack.pop(), stack.pop()
            stack.append(a if s == "with" else (a[0] | b[0], a[1] or b[1] if s == "or" else a[1] and b[1]))
        else:
            stack.append(({family(s)}, family(s) in PERMISSIVE))
    return stack.pop()


def scanner(phrases: dict[str, str] | None = None):
    """A function from a text to what the scan finds in it."""
    import ahocorasick

    extra = NOTICE_PHRASES if phrases is None else phrases
    trie = ahocorasick.Automaton()
    for p, what in ({p: (label, "notice") for p, label in extra.items()} | {p: (label, "base") for p, label in BASE_PHRASES.items()}).items():
        trie.add_word(f" {p} ", (p.count(" ") + 1, *what))
    for p, any_first in TAGS.items():
        trie.add_word(f" {p} ", (p.count(" ") + 1, any_first, "tag"))
    trie.make_automaton()

    def scan(text: str | None) -> dict:
        raw = (text or "").encode("utf-8", "surrogatepass")
        spaced = raw.lower().translate(_NOT_WORD)
        words = spaced.split()
        flat = f" {b' '.join(words).decode('utf-8', 'surrogatepass')} "
        base, labels, notices, expressions, starts, tags = set(), set(), {}, [], [], []
        seen = last = 0  # words that end before ``last``; matches come in the order of their ends
        for end, (n, label, kind) in trie.iter(flat):
            seen += flat.count(" ", last, end)
            last = end
            if kind == "base":
                starts.append(seen - n)
                base.add(label)
            elif kind == "tag":
                tags.append((seen - 1, label))
            else:
                notices[seen - n] = label  # a longer phrase from the same word ends later
        labels |= set(notices.values()) - {""}
        free = None
        if tags:
            blank = np.frombuffer(spaced + b" ", np.uint8) == 32
            ends = np.flatnonzero(~blank[:-1] & blank[1:]) + 1
            for word, any_first in tags:
                colon = _COLON.match(raw, ends[word])
                if colon and (postfix := to_postfix(leading_expression(symbols(raw, colon.end()), any_first))):
                    found, ok = evaluate(postfix)
                    expressions.append(" ".join(postfix))
                    labels |= found
                    free = ok if free is None else free and ok
        evidence = 2 * len(starts) + len(notices) + 4 * len(expressions)
        return {"n_words": len(words), "n_base": len(starts), "first_word": min(starts, default=None), "last_word": max(starts, default=None), "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(base | labels)), "score": 1 - 0.5 ** min(evidence, 60), "expressions": expressions, "permissive": free}

    return scan


SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, expressions array<string>, permissive boolean"


def scan_licenses(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] | None = None) -> DataFrame:
    """One row for each row of ``df``: its id and what the automaton and the parser find in the whole text.

    Identifier tags, and ``license:`` or ``license =`` before a known name, quoted or not, give expressions (in postfix form).
    An identifier is of a family if the family's pattern matches all of it. ``permissive`` tells whether every tagged
    expression can be met by permissive licences, null without a tag. Null and empty texts have no
    words and empty labels; repeated rows give repeated rows, an empty table none. Columns other
    than the two named are not read, so their names may be anything.
    """
    src = df.select(df[id_col].alias("id"), df[text_col].alias("text"))
    kind = df.select(id_col).schema[0].dataType.simpleString()

    def make():
        scan = scanner(phrases)

        def f(id, text):
            rows = [scan(t) for t in text]
            return {id_col: id} | {k: [r[k] for r in rows] for k in rows[0]} if rows else {}

        return f

    return arrow_map(src, f"`{id_col}` {kind}, {SCHEMA}", make)
