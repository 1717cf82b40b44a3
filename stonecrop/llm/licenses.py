"""License scans: one Aho-Corasick pass for tags and phrases, and a shunting-yard parser for expressions.

The text becomes ASCII-lower-cased words of letters and digits (all characters from U+0080 count
as letters), joined by spaces; the automaton finds phrases at word borders in one pass,
however many there are. A tag (``SPDX-License-Identifier``) is followed by an expression in the raw
text, the longest well-formed one up to the line's end or the next tag; it is parsed with AND before OR, WITH
before AND, and parentheses, and its licences become labels. A sentence's full stop ends it. One that an
operator follows without its operand is malformed.

A name counts if it is among the identifiers, which a caller may add to, with or without a ``+``, or a reference
of one's own (``LicenseRef-``); an exception if it is among the exceptions. Any other name gives the label ``unknown``.

Score: 1 with a well-formed tag of known names only; otherwise 1 - 0.5**n for n distinct licences that tags or phrases
name, 0.8 at least if one of them is a full notice. 0 without any. A malformed
expression gives the label ``unparsed`` and no licences. Null texts count as empty; an empty table gives no rows;
repeated rows get a row each; only the columns for id and text are read.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stonecrop.llm.common import map_rows, raw_texts

#: Phrases of the base labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Words of licence notices and the label of each.
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "licensed under the apache license version 2 0": "apache-2.0",
    "redistribution and use in source and binary forms": "bsd",
    "gnu general public license version 2": "gpl-2.0",
    "gnu general public license version 3": "gpl-3.0",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "boost software license": "bsl",
    "permission to use copy modify and or distribute this software for any purpose": "isc",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "creative commons attribution": "cc-by",
    "cc by nc": "cc-by-nc",
    "cc by sa": "cc-by-sa",
    "cc by 4 0": "cc-by",
    "cc0 1 0": "cc0",
    "all rights reserved": "proprietary",
}
#: Identifiers of licences, in lower case; a parameter adds others.
IDENTIFIERS = frozenset(
    """
    0bsd aal afl-1.1 afl-1.2 afl-2.0 afl-2.1 afl-3.0 agpl-1.0-only agpl-1.0-or-later agpl-3.0 agpl-3.0-only agpl-3.0-or-later
    apache-1.0 apache-1.1 apache-2.0 apl-1.0 apsl-1.0 apsl-2.0 artistic-1.0 artistic-1.0-perl artistic-2.0 beerware blueoak-1.0.0
    bsd-1-clause bsd-2-clause bsd-2-clause-patent bsd-3-clause bsd-3-clause-clear bsd-3-clause-lbnl bsd-4-clause bsd-4-clause-uc bsl-1.0 busl-1.1 bzip2-1.0.6
    cal-1.0 catosl-1.1 cc-by-1.0 cc-by-2.0 cc-by-2.5 cc-by-3.0 cc-by-4.0 cc-by-nc-3.0 cc-by-nc-4.0 cc-by-nc-nd-4.0 cc-by-nc-sa-3.0 cc-by-nc-sa-4.0 cc-by-nd-4.0 cc-by-sa-2.0 cc-by-sa-2.5
    cc-by-sa-3.0 cc-by-sa-4.0 cc-pddc cc0-1.0 cddl-1.0 cddl-1.1 cecill-2.0 cecill-2.1 cecill-b cecill-c cern-ohl-p-2.0 cern-ohl-s-2.0 cern-ohl-w-2.0
    cnri-python cpal-1.0 cpl-1.0 curl ecl-2.0 efl-2.0 elastic-2.0 epl-1.0 epl-2.0 eudatagrid eupl-1.1 eupl-1.2 fair frameworx-1.0 fsfap ftl
    gfdl-1.1-only gfdl-1.1-or-later gfdl-1.2-only gfdl-1.2-or-later gfdl-1.3-only gfdl-1.3-or-later gpl-1.0 gpl-1.0-only gpl-1.0-or-later gpl-2.0 gpl-2.0-only gpl-2.0-or-later
    gpl-3.0 gpl-3.0-only gpl-3.0-or-later hpnd icu ijg imagemagick intel ipa ipl-1.0 isc jasper-2.0 json lgpl-2.0 lgpl-2.0-only lgpl-2.0-or-later
    lgpl-2.1 lgpl-2.1-only lgpl-2.1-or-later lgpl-3.0 lgpl-3.0-only lgpl-3.0-or-later libpng libpng-2.0 libtiff lpl-1.02 lppl-1.3c
    mit mit-0 mit-cmu mit-modern-variant miros mpl-1.0 mpl-1.1 mpl-2.0 mpl-2.0-no-copyleft-exception ms-pl ms-rl mulanpsl-2.0 multics naist-2003 ncsa ngpl nokia npl-1.1 ntp
    oclc-2.0 odbl-1.0 odc-by-1.0 ofl-1.0 ofl-1.1 ogl-uk-3.0 oldap-2.8 openssl osl-1.0 osl-2.0 osl-2.1 osl-3.0 pddl-1.0 php-3.0 php-3.01 postgresql psf-2.0 python-2.0 qpl-1.0
    rpl-1.5 rpsl-1.0 ruby sgi-b-2.0 simpl-2.0 sleepycat spl-1.0 sspl-1.0 tcl unicode-3.0 unicode-dfs-2016 unlicense upl-1.0 vim w3c watcom-1.0 wtfpl x11 xnet zend-2.0 zlib zpl-2.0 zpl-2.1
    """.split()
)
#: Identifiers of exceptions, in lower case.
EXCEPTIONS = frozenset(
    """
    389-exception autoconf-exception-2.0 autoconf-exception-3.0 bison-exception-2.2 bootloader-exception classpath-exception-2.0 clisp-exception-2.0 ecos-exception-2.0
    fawkes-runtime-exception fltk-exception font-exception-2.0 freertos-exception-2.0 gcc-exception-2.0 gcc-exception-3.1 gnu-javamail-exception gpl-cc-1.0 i2p-gpl-java-exception
    libtool-exception linux-syscall-note llvm-exception lzma-exception mif-exception openjdk-assembly-exception-1.0 openvpn-openssl-exception ps-or-pdf-font-exception-20170817
    qt-gpl-exception-1.0 qt-lgpl-exception-1.1 qwt-exception-1.0 swift-exception u-boot-exception-2.0 universal-foss-exception-1.0 wxwindows-exception-3.1
    """.split()
)
TAG = "spdx license identifier"
TAG_AT = re.compile(r"spdx-license-identifier:[ \t]*", re.I | re.A)
LINE_END = re.compile(r"[\r\n]|\Z")
#: A token of an expression at the start of a text, and what may follow a name.
TOKEN = re.compile(r"\s*([()]|[A-Za-z0-9.+:]+(?:-[A-Za-z0-9.+:]+)*(?=$|[\s()*<>\"'`,;#|\\\]}]|-->))", re.A)
#: All bytes to what they are in a phrase: letters in lower case, digits, bytes of other characters, else a space.
WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
#: Licences that are permitted unless a caller says otherwise.
PERMITTED = frozenset("0bsd apache-2.0 bsd-2-clause bsd-3-clause bsl-1.0 cc0-1.0 isc mit unlicense zlib".split())
STRENGTH = {"or": 1, "and": 2, "with": 3}
SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, places array<struct<label:string,start:long,words:long>>, expressions array<string>, permitted boolean"


def parse(expression: str) -> tuple[str, ...] | None:
    """The expression in postfix order, licences in lower case; None if it is malformed.

    Shunting-yard: operators wait on a stack until one that binds less comes. An exception is
    one name that follows one licence, so WITH between parentheses is malformed.
    """
    out: list[str] = []
    waiting: list[str] = []
    operand, before = True, ""  # whether one must come now; the token before

    def settle(least: int) -> None:
        while waiting and waiting[-1] != "(" and STRENGTH[waiting[-1]] >= least:
            out.append(waiting.pop())

    for token in re.findall(r"[()]|[^\s()]+", expression):
        low = token.lower()
        if low in STRENGTH or token == ")":
            if operand or (low == "with" and before == ")"):
                return None
            settle(STRENGTH.get(low, 0))
            if low in STRENGTH:
                waiting.append(low)
                operand = True
            elif not waiting:
                return None
            else:
                waiting.pop()
        elif not operand or (token == "(" and before == "with"):
            return None
        elif token == "(":
            waiting.append(token)
        elif re.fullmatch(r"[A-Za-z0-9.+:-]+", token):
            out.append(low)
            operand = False
        else:
            return None
        before = low
    settle(0)
    return None if operand or waiting else tuple(out)


def leading(text: str) -> str | None:
    """The longest well-formed expression at the start of ``text``; None without one, or if an operator without operand follows it."""
    at = end = depth = 0
    operand, before, open_operator = True, "", False
    while m := TOKEN.match(text, at):
        token = m[1].rstrip(".") if operand else m[1]
        low, stop = token.lower(), token != m[1]
        if low in STRENGTH or token == ")":
            open_operator = open_operator or (low in STRENGTH and not operand)
            if operand or (low == "with" and before == ")") or (token == ")" and not depth):
                break
            depth -= token == ")"
            operand = low in STRENGTH
        elif not token or not operand or (token == "(" and before == "with"):
            break
        elif token == "(":
            depth += 1
        else:
            operand = False
        at, before = m.end(), low
        if not operand and not depth:
            end, open_operator = m.start(1) + len(token), False
        if stop:
            break
    return text[:end] if end and not open_operator else None


def evaluated(postfix: tuple[str, ...], leaf: Callable, both: dict[str, Callable]):
    """The value of an expression from those of its licences; without recursion, so of any depth."""
    values = []
    for token in postfix:
        if token in STRENGTH:
            b = values.pop()
            values.append(both[token](values.pop(), b))
        else:
            values.append(leaf(token))
    return values[0]


def named(postfix: tuple[str, ...]) -> set[str]:
    """Licences in an expression, with their exceptions."""
    names: list[str] = []
    for token in postfix:
        if token == "with":
            exception = names.pop()
            names[-1] += f" with {exception}"
        elif token not in STRENGTH:
            names.append(token)
    return set(names)


def known(name: str, identifiers: frozenset[str]) -> bool:
    """Whether a licence, with its exception if it has one, is among the identifiers and exceptions or a reference of one's own."""
    licence, _, exception = name.partition(" with ")
    own = re.match(r"(documentref-[a-z0-9.-]+:)?licenseref-[a-z0-9]", licence)
    return (bool(own) or licence in identifiers or licence.removesuffix("+") in identifiers) and (not exception or exception in EXCEPTIONS or exception.startswith("additionref-"))


def satisfied(postfix: tuple[str, ...], permitted: frozenset[str]) -> bool:
    """Whether ``permitted`` licences suffice; an exception only adds permissions, so a permitted licence is so with any."""
    return evaluated(postfix, lambda x: x in permitted, {"or": operator.or_, "and": operator.and_, "with": lambda a, _: a})


def automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for phrase in {*BASE, *NOTICES, TAG}:
        found.add_word(f" {phrase} ", phrase)
    found.make_automaton()
    return found


def scan(raw: bytes, phrases, permitted: frozenset[str] = PERMITTED, identifiers: frozenset[str] = IDENTIFIERS) -> tuple:
    """A row of ``SCHEMA``."""
    words = raw.translate(WORDS).split()
    joined = b" " + b" ".join(words) + b" "
    places, tagged = [], False
    at = done = 0
    for end, phrase in phrases.iter(joined.decode("latin-1")):
        if phrase == TAG:
            tagged = True
            continue
        size = phrase.count(" ") + 1
        at, done = at + joined.count(b" ", done, end), end
        places.append((phrase, at - size, size))  # the spaces before its last one, less its own
    base = [(BASE[p], i) for p, i, _ in places if p in BASE]
    labels = {BASE.get(p) or NOTICES[p] for p, _, _ in places}
    strong = any(p in NOTICES for p, _, _ in places)
    expressions, good, allowed = [], False, None
    if tagged:
        whole = raw.decode()
        tags = [(m.start(), m.end()) for m in TAG_AT.finditer(whole)]
        for (_, begin), (next_, _) in zip(tags, [*tags[1:], (len(whole), 0)], strict=True):
            line = whole[begin : min(next_, LINE_END.search(whole, begin).start())]
            text = leading(line)
            postfix = None if text is None else parse(text)
            expressions.append(text if postfix else re.sub(r"\s*(\*/|-->|#+|\")?\s*$", "", line).strip())
            names = {x if known(x, identifiers) else "unknown" for x in named(postfix)} if postfix else {"unparsed"}
            good |= not names & {"unknown", "unparsed"}
            labels |= names
            allowed = allowed is not False and postfix is not None and satisfied(postfix, permitted)
    n = len(labels - {"unparsed", "unknown"})
    score = 1.0 if good else max(1 - 0.5**n, 0.8 * strong) if n else 0.0
    starts = [i for _, i in base]
    return (
        len(words),
        len(base),
        min(starts, default=None),
        max(starts, default=None),
        ",".join(sorted({x for x, _ in base})),
        ",".join(sorted(labels)),
        score,
        [{"label": BASE.get(p) or NOTICES[p], "start": i, "words": k} for p, i, k in places],
        expressions,
        allowed,
    )


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", permitted: frozenset[str] = PERMITTED, identifiers: frozenset[str] = IDENTIFIERS) -> DataFrame:
    """(doc_id, ``SCHEMA``): a row per document, with where each phrase stands, the raw expressions and whether ``permitted`` licences satisfy all of them (null without any).

    ``identifiers`` are the names that count as licences, in lower case.
    """
    state: dict = {}

    def make(batch) -> list[list]:
        if not state:
            state["phrases"] = automaton()
        rows = [scan(x, state["phrases"], permitted, identifiers) for x in raw_texts(batch.column(1))]
        return [batch.column(0), *map(list, zip(*rows, strict=True))]

    kind = f"doc_id {docs.schema[id_col].dataType.simpleString()}, {SCHEMA}"
    return map_rows(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), kind, make)
