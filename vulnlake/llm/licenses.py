"""Licence scans: Aho-Corasick over notice phrases and identifier tags, and a shunting-yard parser for expressions."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache, lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from vulnlake.llm.common import id_and_text, slices

#: Phrases of the base scan with their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Further notice phrases (words after lower-casing) and their labels.
NOTICES = {
    "lesser general public license": "lgpl", "library general public license": "lgpl", "gnu lgpl": "lgpl",
    "affero general public license": "agpl", "gnu agpl": "agpl", "gnu general public license": "gpl", "gnu gpl": "gpl",
    "free documentation license": "gfdl", "mozilla public license": "mpl", "eclipse public license": "epl",
    "eclipse distribution license": "bsd", "european union public licence": "eupl", "common development and distribution license": "cddl",
    "common public license": "cpl", "boost software license": "bsl", "academic free license": "afl", "open software license": "osl",
    "artistic license": "artistic", "python software foundation license": "psf", "server side public license": "sspl",
    "business source license": "busl", "elastic license": "elastic", "universal permissive license": "upl",
    "bsd license": "bsd", "bsd licence": "bsd", "bsd style license": "bsd", "bsd 2 clause": "bsd", "bsd 3 clause": "bsd", "2 clause bsd": "bsd", "3 clause bsd": "bsd",
    "simplified bsd": "bsd", "isc license": "isc", "isc licence": "isc", "zlib license": "zlib", "the unlicense": "unlicense",
    "redistribution and use in source and binary forms": "bsd",
    "permission to use copy modify and or distribute this software for any purpose": "isc",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "licensed under the apache license version 2 0": "apache", "released under the mit license": "mit", "mit licence": "mit", "mit licensed": "mit", "apache licence": "apache",
    "sil open font license": "ofl", "open database license": "odbl", "creative commons attribution": "cc", "creative commons license": "cc",
    "licensed under cc by": "cc", "cc by nc": "cc", "cc by sa": "cc", "cc by nd": "cc", "cc by 4 0": "cc", "cc by 3 0": "cc", "cc0 1 0": "cc0", "creative commons zero": "cc0",
    "released into the public domain": "public-domain", "in the public domain": "public-domain", "public domain": "public-domain",
    "do what the fuck you want to public license": "wtfpl", "beerware license": "beerware", "beer ware license": "beerware", "php license": "php", "ruby license": "ruby", "zope public license": "zpl",
    "ibm public license": "ipl", "apple public source license": "apsl", "microsoft public license": "ms-pl", "microsoft reciprocal license": "ms-rl", "postgresql license": "postgresql", "openssl license": "openssl",
    "curl license": "curl", "json license": "json", "freetype project license": "ftl", "libpng license": "libpng", "educational community license": "ecl", "latex project public license": "lppl",
    "reciprocal public license": "rpl", "common public attribution license": "cpal", "polyform noncommercial license": "polyform", "blue oak model license": "blueoak", "mulan permissive software license": "mulanpsl",
    "cecill free software license": "cecill", "open government licence": "ogl-uk", "w3c software notice and license": "w3c", "unicode license": "unicode", "the software is provided as is": "as-is",
    "use of this source code is governed by a bsd style license": "bsd", "this program is free software you can redistribute it and or modify it under the terms of the gnu": "gpl",
    "distributed under the boost software license": "bsl", "this work is licensed under a creative commons": "cc", "dedicated to the public domain": "public-domain", "placed in the public domain": "public-domain",
    "no rights reserved": "public-domain", "unauthorized copying": "proprietary", "may not be reproduced": "proprietary", "for internal use only": "proprietary", "trade secret": "proprietary",
    "all rights reserved": "proprietary", "proprietary and confidential": "proprietary", "confidential and proprietary": "proprietary",
}
TAG = "spdx-license-identifier:"
#: Family of an identifier by its name, behind which no letter stands but the `v` of a version; of several the longest.
FAMILIES = {
    "mit": "mit", "mitnfa": "mit", "x11": "mit", "apache": "apache", "asl": "apache", "lgpl": "lgpl", "lgpllr": "lgpl", "agpl": "agpl", "gpl": "gpl", "gfdl": "gfdl", "mpl": "mpl", "epl": "epl",
    "eupl": "eupl", "cddl": "cddl", "cpl": "cpl", "bsl": "bsl", "busl": "busl", "bsd": "bsd", "0bsd": "bsd", "isc": "isc", "cc0": "cc0", "cc": "cc", "cc-pddc": "public-domain", "zlib": "zlib", "unlicense": "unlicense",
    "wtfpl": "wtfpl", "artistic": "artistic", "clartistic": "artistic", "afl": "afl", "osl": "osl", "psf": "psf", "python": "psf", "ofl": "ofl", "odbl": "odbl", "odc-by": "odc-by", "pddl": "public-domain", "upl": "upl",
    "sspl": "sspl", "elastic": "elastic", "ncsa": "ncsa", "postgresql": "postgresql", "openssl": "openssl", "ms-pl": "ms-pl", "ms-rl": "ms-rl",
    "aal": "aal", "antlr-pd": "public-domain", "apl": "apl", "apsl": "apsl", "beerware": "beerware", "bittorrent": "bittorrent", "blessing": "public-domain", "blueoak": "blueoak", "bzip2": "bzip2",
    "cal": "cal", "catosl": "catosl", "cecill": "cecill", "cern-ohl": "cern-ohl", "cnri-python": "psf", "cpal": "cpal", "curl": "curl", "ecl": "ecl", "efl": "efl", "etalab": "etalab", "fair": "fair",
    "freetype": "ftl", "ftl": "ftl", "hippocratic": "hippocratic", "hpnd": "hpnd", "icu": "icu", "ijg": "ijg", "imagemagick": "imagemagick", "info-zip": "info-zip", "intel": "intel", "ipa": "ipa", "ipl": "ipl",
    "json": "json", "libpng": "libpng", "libtiff": "libtiff", "lppl": "lppl", "mulanpsl": "mulanpsl", "nasa": "nasa", "nposl": "osl", "ntp": "ntp", "oclc": "oclc", "ogl-uk": "ogl-uk", "oldap": "oldap",
    "parity": "parity", "php": "php", "polyform": "polyform", "qpl": "qpl", "rpl": "rpl", "ruby": "ruby", "sgi-b": "sgi-b", "sissl": "sissl", "sleepycat": "sleepycat", "spl": "spl", "tcl": "tcl",
    "unicode": "unicode", "vim": "vim", "w3c": "w3c", "watcom": "watcom", "wxwindows": "wxwindows", "xnet": "xnet", "zend": "zend", "zpl": "zpl",
}
BORDER = re.compile(r"(?![a-z])|v[0-9]")
LONGEST_NAME = max(map(len, FAMILIES))
PERMISSIVE = {
    "mit", "apache", "bsd", "isc", "bsl", "cc0", "public-domain", "zlib", "unlicense", "wtfpl", "psf", "afl", "upl", "ncsa", "postgresql", "artistic", "ms-pl", "openssl",
    "beerware", "blueoak", "bzip2", "curl", "ecl", "efl", "fair", "ftl", "hpnd", "icu", "ijg", "libpng", "libtiff", "mulanpsl", "ntp", "php", "tcl", "unicode", "w3c", "xnet", "zpl"}

LEVEL = {"or": 1, "and": 2, "with": 3}
TOKEN = re.compile(rb"[()]|[^\s()]+")
#: Bytes that end a word: ASCII other than digits and small letters (capitals are lowered first).
GAPS = bytes(b if b > 127 or chr(b).isdigit() or chr(b).islower() else 32 for b in range(256))


@cache
def automaton() -> ahocorasick.Automaton:
    """Phrases of both scans, between blanks."""
    built = ahocorasick.Automaton()
    for phrase in {**NOTICES, **BASE}:
        built.add_word(f" {phrase} ", phrase)
    built.make_automaton()
    return built


@cache
def tags() -> ahocorasick.Automaton:
    built = ahocorasick.Automaton()
    built.add_word(TAG, TAG)
    built.make_automaton()
    return built


def longest(text: bytes, start: int = 0, stop: int | None = None) -> tuple[list[str] | None, bool]:
    """Shunting-yard over `text[start:stop]`: operands and operators in postfix order of the longest beginning that is an expression, and whether that is all."""
    out: list[str] = []
    held: list[str] = []
    operand, whole = True, False  # whether an operand is due next; whether all tokens were used
    opened = 0  # brackets
    done: tuple[int, list[str]] | None = None  # output and what is held at the last place where an expression may end
    for token in (m.group().decode("latin-1").lower() for m in TOKEN.finditer(text, start, len(text) if stop is None else stop)):
        if token == "(":
            if not operand:
                break
            held.append(token)
            opened += 1
        elif token == ")":
            if operand or not opened:
                break
            while held[-1] != "(":
                out.append(held.pop())
            held.pop()
            opened -= 1
        elif token in LEVEL:
            if operand:
                break
            while held and LEVEL.get(held[-1], 0) >= LEVEL[token]:
                out.append(held.pop())
            held.append(token)
            operand = True
        else:
            if not operand:
                break
            out.append(token)
            operand = False
        if not operand and not opened:  # no more than one operator of each level is held
            done = len(out), held[::-1]
    else:
        whole = not operand and not opened
    return (out[: done[0]] + done[1] if done else None), whole


def postfix(expression: bytes) -> list[str] | None:
    """Operands and operators in postfix order, or None where the expression is broken."""
    order, whole = longest(expression)
    return order if whole else None


def family(identifier: str) -> str:
    """Family of the longest name that the identifier is, or begins with before a border."""
    return next((FAMILIES[identifier[:n]] for n in range(min(len(identifier), LONGEST_NAME), 1, -1) if identifier[:n] in FAMILIES and BORDER.match(identifier, n)), "other")


def evaluate(order: list[str]) -> tuple[set[str], bool]:
    """Labels in an expression, and whether it can be met by permissive licences alone (an exception changes nothing)."""
    stack: list[tuple[set[str], bool]] = []
    for token in order:
        if token in LEVEL:
            (b, b_free), (a, a_free) = stack.pop(), stack.pop()
            stack.append((a, a_free) if token == "with" else (a | b, (a_free or b_free) if token == "or" else (a_free and b_free)))
        else:
            label = family(token)
            stack.append(({label}, label in PERMISSIVE))
    return stack[0]


def expression_at(text: bytes, start: int = 0, stop: int | None = None) -> list[str] | None:
    """The longest beginning of `text[start:stop]` that is an expression (closing comment marks and prose may follow)."""
    return longest(text, start, stop)[0]


@lru_cache(1 << 12)
def read_short(text: bytes) -> tuple[str, list[str], bool]:
    """`reading` of a short text; the same few expressions come again and again."""
    return reading(text, 0, len(text))


def reading(text: bytes, start: int, stop: int) -> tuple[str, list[str], bool]:
    """The expression at the start of `text[start:stop]` in postfix order, its labels, and whether permissive licences can meet it."""
    order = expression_at(text, start, stop)
    labels, free = evaluate(order) if order else (set(), False)
    return " ".join(order or []), sorted(labels), free


def scan(text: str) -> dict:
    """Number of words, and the hits in order of kind and place; a base phrase inside a notice is a hit of its own."""
    low = text.encode().lower()
    words = low.translate(GAPS).split()
    joined = b" " + b" ".join(words) + b" "
    hits = []
    begins = np.cumsum([1, *map(len, words)]) + np.arange(len(words) + 1)  # of each word in `joined`
    for end, phrase in automaton().iter(joined.decode("latin-1")):
        first = int(np.searchsorted(begins, end - len(phrase)))  # the phrase's first letter
        for kind, label in ((k, table[phrase]) for k, table in (("base", BASE), ("notice", NOTICES)) if phrase in table):
            hits.append({"kind": kind, "label": label, "first_word": first, "last_word": first + phrase.count(" "), "expression": None, "permissive": None})
    found = [end + 1 for end, _ in tags().iter(low.decode("latin-1"))]
    if found:
        inside = np.frombuffer(low.translate(GAPS), np.uint8) != 32
        starts = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))
        firsts = np.searchsorted(starts, np.array(found) - len(TAG)).tolist()
        line = -1  # end of the line of the tag before
        for begin, following, first in zip(found, [*(f - len(TAG) for f in found[1:]), len(low)], firsts):
            if line < begin:
                line = low.find(b"\n", begin)
                line = line if line >= 0 else len(low)
            stop = min(line, following)
            order, labels, free = read_short(low[begin:stop]) if stop - begin <= 200 else reading(low, begin, stop)
            hits += [{"kind": "tag", "label": x, "first_word": first, "last_word": first + 2, "expression": order, "permissive": free} for x in labels]
    return {"n_words": len(words), "hits": hits}


HIT = pa.struct([("kind", pa.string()), ("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("expression", pa.string()), ("permissive", pa.bool_())])


def scan_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            found = [scan(t or "") for t in part["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array([f["n_words"] for f in found], pa.int64()), pa.array([f["hits"] for f in found], pa.list_(HIT))], names=["doc_id", "n_words", "hits"])


def license_hits(docs: DataFrame) -> DataFrame:
    """`doc_id, n_words, hits`: every place of a phrase or tag, with its label and words, in each whole text.

    A tag with an expression has a hit for each label in it, the expression in postfix order, and whether permissive
    licences can meet it; one without a readable expression has none. An expression ends with its line or before the next tag. Null and empty texts have no words and no hits.
    Repeated rows stay repeated, an empty table gives no rows, other columns are left out whatever their names, and a very
    long text is scanned whole, in time that grows with it.
    """
    schema = "doc_id long, n_words long, hits array<struct<kind:string,label:string,first_word:long,last_word:long,expression:string,permissive:boolean>>"
    return id_and_text(docs).mapInArrow(scan_rows, schema)
