"""Ordered licence signatures over canonical text (lower-case words, one space between).

Families are written by hand: a label, the keywords (words, with or without a
version joined on) of which one at least stands wherever its signatures match,
and the names it goes by.  Each family gives a signature for its identifier, for grants ("licensed under ..."), for a heading
and for a bare mention.  Clause signatures are whole sentences of licence
texts.  A rule's gate is one group of words or two; wherever the rule matches,
one word at least of each group stands.  They are the rarest that its form
offers, as many keywords are everyday words.
"""

from __future__ import annotations

from typing import NamedTuple


class Rule(NamedTuple):
    label: str
    keywords: tuple[str, ...]
    pattern: str
    priority: int
    weight: float
    gate: tuple[tuple[str, ...], ...]


def numbered(words: tuple[str, ...], digits: int) -> tuple[str, ...]:
    """The words, and each with a "v" or so many digits at most, or both, joined on (gpl3, gplv3, license2)."""
    ends = [v + f"{x:0{n}d}" for v in ("", "v") for n in range(1, digits + 1) for x in range(10 ** n)]
    return words + tuple(w + e for w in words for e in ["v", *ends])


V1, V2, V3 = r"(?: version| ?v)? ?1(?: 0)?", r"(?: version| ?v)? ?2(?: 0)?", r"(?: version| ?v)? ?3(?: 0)?"
ANY = r"(?:(?: version| ?v)? ?\d(?: \d){0,2})?"
#: the version that a form adds behind a name, which may have one joined on
ADDED = r"(?:(?: version| v)? ?\d(?: \d){0,2})?"
#: e with or without its accent, also as a capital (only A-Z is lower-cased) or with a combining accent
E_ACUTE = r"(?:\w{1,2}|\u00e9|\u00c9|e\u0301)"
#: the copyright sign is a word, also with a year joined on
SIGN = r"\u00a9"
#: names that end so always have the word in them
LICENSE = tuple(f" license{v}" for v in ("", V1, V2, V3, ANY))
GPL, LGPL, AGPL = r"(?:gnu )?general public license", r"(?:gnu )?(?:lesser|library) general public license", \
    r"(?:gnu )?affero general public license"

#: label, keywords (parted by spaces), names (regex over canonical words)
FAMILIES = [
    ("mit", "mit", r"mit"), ("mit-0", "mit", r"mit (?:0|no attribution)"), ("x11", "x11", r"x11"),
    ("apache-2.0", "apache", rf"apache(?: software)?(?: license)?{V2}"),
    ("apache-1.1", "apache", r"apache(?: software)?(?: license)?(?: version| ?v)? ?1 1"),
    ("apache", "apache", r"apache(?: software)? license"),
    ("bsd-2-clause", "bsd freebsd", r"(?:bsd 2 clause|2 clause bsd|simplified bsd|freebsd)"),
    ("bsd-3-clause", "bsd", r"(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd)"),
    ("bsd-4-clause", "bsd", r"(?:bsd 4 clause|4 clause bsd|original bsd)"), ("0bsd", "0bsd bsd", r"(?:0bsd|zero clause bsd)"),
    ("bsd", "bsd berkeley", r"(?:bsd|berkeley software distribution)"),
    ("gpl-1.0", "general", rf"{GPL}{V1}"), ("gpl-2.0", "general", rf"{GPL}{V2}"), ("gpl-3.0", "general", rf"{GPL}{V3}"),
    ("gpl-1.0", "gpl", rf"(?:gnu )?gpl{V1}"), ("gpl-2.0", "gpl", rf"(?:gnu )?gpl{V2}"),
    ("gpl-3.0", "gpl", rf"(?:gnu )?gpl{V3}"), ("gpl", "gpl", r"(?:gnu )?gpl"), ("gpl", "general", GPL),
    ("lgpl-2.0", "general", rf"{LGPL}{V2}"), ("lgpl-2.1", "general", rf"{LGPL}(?: version| ?v)? ?2 1"),
    ("lgpl-3.0", "general", rf"{LGPL}{V3}"), ("lgpl-2.1", "lgpl", r"(?:gnu )?lgpl(?: version| ?v)? ?2 1"),
    ("lgpl-3.0", "lgpl", rf"(?:gnu )?lgpl{V3}"), ("lgpl", "lgpl", r"(?:gnu )?lgpl"), ("lgpl", "general", LGPL),
    ("agpl-3.0", "affero", rf"{AGPL}{V3}"), ("agpl", "affero", AGPL), ("agpl", "agpl", rf"(?:gnu )?agpl{ANY}"),
    ("fdl", "documentation", rf"(?:gnu )?free documentation license{ANY}"), ("fdl", "gfdl", rf"gfdl{ANY}"),
    ("mpl-1.1", "mozilla", r"mozilla public license(?: version| ?v)? ?1 1"),
    ("mpl-2.0", "mozilla", rf"mozilla public license{V2}"), ("mpl", "mozilla", r"mozilla public license"),
    ("mpl-2.0", "mpl", rf"mpl{V2}"), ("mpl", "mpl", rf"mpl{ANY}"),
    ("epl-1.0", "eclipse", rf"eclipse public license{V1}"), ("epl-2.0", "eclipse", rf"eclipse public license{V2}"),
    ("epl", "epl", rf"epl{ANY}"), ("edl-1.0", "eclipse", rf"eclipse distribution license{ANY}"),
    ("cpl-1.0", "common", rf"common public license{ANY}"), ("ipl-1.0", "ibm", rf"ibm public license{ANY}"),
    ("cddl-1.0", "cddl", rf"cddl{ANY}"), ("cddl-1.0", "distribution", r"common development and distribution license"),
    ("cc0-1.0", "cc0", rf"(?:creative commons )?cc0{ANY}"), ("cc0-1.0", "commons", r"creative commons zero"),
    ("cc-by-nc-nd", "cc", rf"cc (?:by nc nd|attribution non ?commercial no ?deriv\w*){ANY}"),
    ("cc-by-nc-sa", "cc", rf"cc (?:by nc sa|attribution non ?commercial share ?alike){ANY}"),
    ("cc-by-nc", "cc", rf"cc by nc{ANY}"), ("cc-by-nd", "cc", rf"cc by nd{ANY}"), ("cc-by-sa", "cc", rf"cc by sa{ANY}"),
    ("cc-by-nc-nd", "commons", rf"creative commons (?:by nc nd|attribution non ?commercial no ?deriv\w*){ANY}"),
    ("cc-by-nc-sa", "commons", rf"creative commons (?:by nc sa|attribution non ?commercial share ?alike){ANY}"),
    ("cc-by-nc", "commons", rf"creative commons (?:by nc|attribution non ?commercial){ANY}"),
    ("cc-by-nd", "commons", rf"creative commons (?:by nd|attribution no ?deriv\w*){ANY}"),
    ("cc-by-sa", "commons", rf"creative commons (?:by sa|attribution share ?alike){ANY}"),
    ("cc-by", "cc", rf"cc by{ANY}"), ("cc-by", "commons", rf"creative commons (?:by|attribution){ANY}"),
    ("unlicense", "unlicense", r"unlicense"), ("isc", "isc", r"isc"), ("zlib", "zlib", r"zlib(?: libpng)?"),
    ("libpng", "libpng", r"libpng(?: 2(?: 0)?)?"), ("artistic-1.0", "artistic", rf"artistic license{V1}"),
    ("artistic-2.0", "artistic", rf"artistic license{V2}"), ("artistic", "artistic", r"(?:perl )?artistic license"),
    ("bsl-1.0", "boost", rf"boost software license{ANY}"), ("busl-1.1", "business", rf"business source license{ANY}"),
    ("wtfpl", "wtfpl", rf"wtfpl{ANY}"), ("eupl-1.2", "eupl", rf"eupl{ANY}"),
    ("eupl-1.2", "european", rf"european union public licence{ANY}"), ("cecill", "cecill", rf"cecill(?: [abc])?{ANY}"),
    ("ofl-1.1", "ofl", rf"(?:sil )?ofl{ANY}"), ("ofl-1.1", "font", rf"(?:sil )?open font license{ANY}"),
    ("afl-3.0", "academic", rf"academic free license{ANY}"), ("osl-3.0", "open", rf"open software license{ANY}"),
    ("ms-pl", "microsoft", r"microsoft public license"), ("ms-rl", "microsoft", r"microsoft reciprocal license"),
    ("ncsa", "ncsa", r"(?:university of illinois )?ncsa(?: open source)?"),
    ("python-2.0", "python", rf"python (?:software foundation )?license{ANY}"), ("psf-2.0", "psf", rf"psf{ANY}"),
    ("php-3.01", "php", rf"php license{ANY}"), ("ruby", "ruby", r"ruby license"), ("zpl-2.1", "zope", rf"zope public license{ANY}"),
    ("w3c", "w3c", r"w3c(?: software)?(?: notice and)?"), ("curl", "curl", r"curl"), ("openssl", "openssl", r"openssl"),
    ("postgresql", "postgresql", r"postgresql"), ("vim", "vim", r"vim"), ("beerware", "beerware", r"beerware"),
    ("blueoak-1.0.0", "oak", rf"blue oak model license{ANY}"), ("mulan-psl-2.0", "mulan", rf"mulan (?:psl|permissive software license){ANY}"),
    ("odbl-1.0", "database", rf"open database license{ANY}"), ("odbl-1.0", "odbl", rf"odbl{ANY}"),
    ("pddl-1.0", "pddl", rf"pddl{ANY}"), ("odc-by-1.0", "odc", rf"odc by{ANY}"),
    ("ogl-3.0", "government", rf"open government licen[cs]e{ANY}"), ("sspl-1.0", "sspl", rf"sspl{ANY}"),
    ("sspl-1.0", "server", rf"server side public license{ANY}"), ("elastic-2.0", "elastic", rf"elastic license{ANY}"),
    ("polyform", "polyform", rf"polyform [a-z]+{ANY}"), ("commons-clause", "clause", r"commons clause"),
    ("upl-1.0", "universal", rf"universal permissive license{ANY}"), ("nposl-3.0", "nposl", rf"nposl{ANY}"),
    ("qpl-1.0", "qpl q", rf"(?:q public license|qpl){ANY}"), ("sleepycat", "sleepycat", r"sleepycat"),
    ("rpl-1.5", "reciprocal", rf"reciprocal public license{ANY}"), ("ecl-2.0", "educational", rf"educational community license{ANY}"),
    ("llama", "llama", rf"llama ?\d?(?: \d)? community license"), ("openrail", "openrail", r"(?:creativeml )?openrail(?: m)?"),
]

#: label, keywords, sentence (regex over canonical words)
CLAUSES = [
    ("mit", "permission", r"permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit", "notice", r"the above copyright notice and this permission notice shall be included in all copies"),
    ("isc", "permission", r"permission to use copy modify and or distribute this software for any purpose with or without fee"),
    ("apache-2.0", "apache", r"www apache org licenses license 2 0"),
    ("apache-2.0", "compliance", r"you may not use this file except in compliance with the license"),
    ("bsd", "redistribution", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", "redistributions", r"redistributions (?:of source code must retain|in binary form must reproduce) the above copyright notice"),
    ("bsd-3-clause", "endorse", r"may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("gpl", "redistribute", r"this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl", "gnu", r"www gnu org licenses(?: gpl)?(?: \d(?: \d)*)?"),
    ("gpl-2.0-or-later", "later", r"either version 2 of the license or at your option any later version"),
    ("gpl-3.0-or-later", "later", r"either version 3 of the license or at your option any later version"),
    ("mpl-2.0", "mozilla", r"subject to the terms of the mozilla public license v 2 0"),
    ("mpl-2.0", "mozilla", r"mozilla org mpl 2 0"),
    ("unlicense", "unencumbered", r"free and unencumbered software released into the public domain"),
    ("public-domain", "domain", r"(?:is|are|placed|released|dedicated)(?: in| into| to)? (?:the )?public domain"),
    ("cc0-1.0", "publicdomain", r"creativecommons org publicdomain zero 1 0"),
    ("cc-by", "creativecommons", r"creativecommons org licenses by \d(?: \d)?"),
    ("cc-by-sa", "creativecommons", r"creativecommons org licenses by sa \d(?: \d)?"),
    ("cc-by-nc", "creativecommons", r"creativecommons org licenses by nc \d(?: \d)?"),
    ("cc-by-nd", "creativecommons", r"creativecommons org licenses by nd \d(?: \d)?"),
    ("cc-by-nc-sa", "creativecommons", r"creativecommons org licenses by nc sa \d(?: \d)?"),
    ("cc-by-nc-nd", "creativecommons", r"creativecommons org licenses by nc nd \d(?: \d)?"),
    ("zlib", "warranty", r"provided as is without any express or implied warranty in no event will the authors be held liable"),
    ("wtfpl", "fuck", r"do what the fuck you want to public license"),
    ("bsl-1.0", "boost", r"www boost org license 1 0"),
    ("reserved", "reserved", r"all rights reserved"), ("reserved", "rechte", r"alle rechte vorbehalten"),
    ("reserved", "droits", rf"tous droits r{E_ACUTE}serv{E_ACUTE}s"), ("reserved", "derechos", r"todos los derechos reservados"),
    ("copyright", "copyright", rf"copyright(?: c)?(?: {SIGN})?(?: {SIGN}?\d{{4}})*(?: by)? \w+"),
    ("copyright", "\u00a9", rf"{SIGN}(?:(?:19|20)\d\d)?(?: copyright)?(?: \d{{4}})*(?: by)? \w+"),
    ("proprietary", "confidential", r"(?:proprietary and confidential|confidential and proprietary)"),
    ("proprietary", "prohibited", r"(?:unauthorized|unauthorised) (?:copying|reproduction|use|distribution)(?: \w+){0,8} (?:is )?(?:strictly )?prohibited"),
    ("proprietary", "permission", r"(?:no part of|may not be) (?:this|reproduced)(?: \w+){0,10} (?:reproduced|without)(?: \w+){0,6} permission"),
    ("proprietary", "trade", r"trade secrets? of \w+"),
    ("personal-use", "personal", r"(?:for )?personal(?: and)? non ?commercial use only"),
    ("non-commercial", "commercial noncommercial nocommercial forcommercial", r"(?:not for|no|non) ?commercial use"),
    ("warranty-disclaimer", "warranties", r"without warranties or conditions of any kind"),
    ("warranty-disclaimer", "warranty", r"without warranty of any kind express or implied"),
]

VERBS = ("released", "distributed", "published", "available", "provided", "covered", "redistributed")
#: form, regex around a family's name, priority, weight, gate (None: the family's keyword, or the word in its name)
FORMS = [
    ("identifier", "spdx license identifier {}(?: only| or later)?", 4, 1.0, (("identifier",),)),
    ("grant", "licen[sc]ed (?:under|by|according to)(?: the)?(?: terms of)?(?: the)? {}(?: licen[sc]e)?(?:{any})?",
     3, 0.95, (("licensed", "licenced"),)),
    ("release", f"(?:{'|'.join(VERBS)}) (?:under|by|according to)(?: the)?(?: terms of)?(?: the)? "
                "{}(?: licen[sc]e)?(?:{any})?", 3, 0.95, (VERBS, None)),
    ("heading", "(?:the )?{}(?: public)? licen[sc]e(?: agreement)?(?:{any})?", 2, 0.8,
     (numbered(("license", "licence"), 2),)),
    ("mention", "{}", 1, 0.5, (None,)),
]
#: names that are also everyday words or other things' names: no bare mention
WEAK = {"mit", "x11", "bsd", "isc", "zlib", "curl", "vim", "openssl", "postgresql", "w3c", "libpng", "apache", "psf-2.0",
        "ruby", "python-2.0", "polyform", "ncsa"}
#: clause keywords that are everyday words, and rarer words of the same sentences
CLAUSE_GATES = {"later": ("license",), "notice": ("copyright",), "compliance": ("license",),
                "trade": ("secret", "secrets"), "\u00a9": ("\u00a9", *(f"\u00a9{y}" for y in range(1900, 2100)))}
#: names with an everyday word among their keywords: the gate of their bare mention
MENTION_GATES = {"mit-0": (("mit",), ("0", "attribution")), "qpl-1.0": (("qpl", "license"),)}


def rules() -> list[Rule]:
    """All signatures in order of priority."""
    out = []
    for label, keys, pattern in CLAUSES:
        keys = tuple(keys.split())
        out.append(Rule(label, keys, pattern, 4, 0.99, (CLAUSE_GATES.get(keys[0], keys),)))
    for label, keys, name in FAMILIES:
        keys = tuple(keys.split())
        own = ("license",) if name.endswith(LICENSE) else keys
        for form, around, priority, weight, gate in FORMS:
            if form == "mention" and label in WEAK:
                continue
            # a name may end in one digit, and a form's own version adds another
            gate = tuple(numbered(own, 1 if form == "mention" else 2) if words is None else words for words in gate)
            if form == "mention" and label in MENTION_GATES:
                gate = tuple(numbered(words, 1) for words in MENTION_GATES[label])
            out.append(Rule(label, keys, around.replace("{any}", ADDED).replace("{}", f"(?:{name})"), priority, weight, gate))
    return sorted(out, key=lambda r: -r.priority)
