"""License scan: ordered signature rules behind a keyword gate.

A text is cut into words and put back with single spaces, so one rule text covers every way of
writing it.  Each rule belongs to a license (label), has a priority and needs one keyword of each of its
sets to occur before its expression is tried; every alternative of the expression holds one of each.
Detections are taken from the highest priority down; one that lies inside a taken one is suppressed.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from .common import map_rows, pick

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

#: Phrases whose words must follow each other, and their labels.
BASE = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]

#: Licenses: label, keywords of which every name has one (split by |), name, short identifier (expressions over lower-case words with single spaces).
LICENSES = [
    ("mit", "mit|expat|x11", r"(?:mit|expat|x11) (?:style )?licen[sc]e", r"mit(?: 0)?"),
    ("apache-2.0", "apache", r"apache (?:software )?licen[sc]e (?:version |v ?)?2(?: 0)?", r"apache 2 0"),
    ("apache-1.1", "apache", r"apache (?:software )?licen[sc]e (?:version |v ?)?1 1", r"apache 1 1"),
    ("apache", "apache", r"apache (?:software )?licen[sc]e", r"apache"),
    ("gpl-2.0", "general", r"(?:gnu )?general public licen[sc]e (?:gpl )?(?:version |v ?)2(?: 0)?", r"gpl 2 0(?: only| or later)?"),
    ("gpl-3.0", "general", r"(?:gnu )?general public licen[sc]e (?:gpl )?(?:version |v ?)3(?: 0)?", r"gpl 3 0(?: only| or later)?"),
    ("gpl", "general", r"(?:gnu )?general public licen[sc]e", r"gpl(?: 1 0)?"),
    ("gpl-2.0", "gpl", r"gnu gpl v?2(?: 0)?", r"gplv2"),
    ("gpl-3.0", "gpl", r"gnu gpl v?3(?: 0)?", r"gplv3"),
    ("lgpl-2.1", "lesser", r"(?:gnu )?lesser general public licen[sc]e (?:lgpl )?(?:version |v ?)2 1", r"lgpl 2 1(?: only| or later)?"),
    ("lgpl-3.0", "lesser", r"(?:gnu )?lesser general public licen[sc]e (?:lgpl )?(?:version |v ?)3(?: 0)?", r"lgpl 3 0(?: only| or later)?"),
    ("lgpl", "lesser", r"(?:gnu )?lesser general public licen[sc]e", r"lgpl"),
    ("lgpl-2.0", "library", r"(?:gnu )?library general public licen[sc]e", r"lgpl 2 0(?: only| or later)?"),
    ("agpl-3.0", "affero", r"(?:gnu )?affero general public licen[sc]e (?:agpl )?(?:version |v ?)3(?: 0)?", r"agpl 3 0(?: only| or later)?"),
    ("agpl", "affero", r"(?:gnu )?affero general public licen[sc]e", r"agpl(?: 1 0)?"),
    ("gfdl", "documentation", r"(?:gnu )?free documentation licen[sc]e", r"gfdl(?: 1 [123])?"),
    ("bsd-2-clause", "bsd", r"(?:simplified bsd|bsd 2 clause|2 clause bsd|freebsd)(?: licen[sc]e)?", r"bsd 2 clause"),
    ("bsd-3-clause", "bsd", r"(?:modified bsd|new bsd|revised bsd|bsd 3 clause|3 clause bsd)(?: licen[sc]e)?", r"bsd 3 clause"),
    ("bsd-4-clause", "bsd", r"(?:original bsd|bsd 4 clause|4 clause bsd)(?: licen[sc]e)?", r"bsd 4 clause"),
    ("bsd-0-clause", "bsd|free public", r"(?:zero clause bsd|bsd 0 clause|0 clause bsd|free public licen[sc]e 1 0 0)", r"0bsd"),
    ("bsd", "bsd", r"bsd (?:style )?licen[sc]e", r"bsd"),
    ("cc0-1.0", "cc0", r"(?:creative commons )?cc0(?: 1 0)?(?: universal)?", r"cc0 1 0"),
    ("cc0-1.0", "commons", r"creative commons zero(?: v?1 0)?(?: universal)?", r"cc zero"),
    ("cc-by-nc-nd", "cc by nc nd", r"cc by nc nd(?: [1-4] [05])?(?: licen[sc]e)?", r"cc by nc nd(?: [1-4] [05])?"),
    ("cc-by-nc-sa", "cc by nc sa", r"cc by nc sa(?: [1-4] [05])?(?: licen[sc]e)?", r"cc by nc sa(?: [1-4] [05])?"),
    ("cc-by-nc", "cc by nc", r"cc by nc(?: [1-4] [05])?(?: licen[sc]e)?", r"cc by nc(?: [1-4] [05])?"),
    ("cc-by-nd", "cc by nd", r"cc by nd(?: [1-4] [05])?(?: licen[sc]e)?", r"cc by nd(?: [1-4] [05])?"),
    ("cc-by-sa", "cc by sa", r"cc by sa(?: [1-4] [05])?(?: licen[sc]e)?", r"cc by sa(?: [1-4] [05])?"),
    ("cc-by", "cc by", r"cc by(?: [1-4] [05])?(?: licen[sc]e)?", r"cc by(?: [1-4] [05])?"),
    ("cc-by-nc-nd", "deriv", r"creative commons attribution non ?commercial no ?deriv(?:s|ative|atives)(?: works)?(?: [1-4] [05])?", r"by nc nd"),
    ("cc-by-nc-sa", "alike", r"creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?", r"by nc sa"),
    ("cc-by-nc", "commercial", r"creative commons attribution non ?commercial(?: [1-4] [05])?", r"by nc"),
    ("cc-by-nd", "deriv", r"creative commons attribution no ?deriv(?:s|ative|atives)(?: works)?(?: [1-4] [05])?", r"by nd"),
    ("cc-by-sa", "alike", r"creative commons attribution share ?alike(?: [1-4] [05])?", r"by sa"),
    ("cc-by", "attribution", r"creative commons attribution(?: [1-4] [05])?", r"cc attribution"),
    ("creative-commons", "commons", r"creative commons licen[sc]e", r"creative commons"),
    ("mpl-1.1", "mozilla", r"mozilla public licen[sc]e (?:version |v ?)?1 [01]", r"mpl 1 [01]"),
    ("mpl-2.0", "mozilla", r"mozilla public licen[sc]e (?:version |v ?)?2(?: 0)?", r"mpl 2 0"),
    ("mpl", "mozilla", r"mozilla public licen[sc]e", r"mpl"),
    ("epl-1.0", "eclipse", r"eclipse public licen[sc]e (?:version |v ?)?1(?: 0)?", r"epl 1 0"),
    ("epl-2.0", "eclipse", r"eclipse public licen[sc]e (?:version |v ?)?2(?: 0)?", r"epl 2 0"),
    ("epl", "eclipse", r"eclipse public licen[sc]e", r"epl"),
    ("cddl-1.0", "distribution", r"common development and distribution licen[sc]e(?: (?:version |v ?)?1(?: [01])?)?", r"cddl(?: 1 [01])?"),
    ("cpl-1.0", "common", r"common public licen[sc]e(?: (?:version |v ?)?1(?: 0)?)?", r"cpl 1 0"),
    ("isc", "isc", r"isc (?:style )?licen[sc]e", r"isc"),
    ("zlib", "zlib", r"zlib (?:libpng )?licen[sc]e", r"zlib"),
    ("libpng", "libpng", r"libpng licen[sc]e", r"libpng(?: 2 0)?"),
    ("boost-1.0", "boost", r"boost software licen[sc]e(?: (?:version |v ?)?1(?: 0)?)?", r"bsl 1 0"),
    ("artistic-1.0", "artistic", r"(?:perl )?artistic licen[sc]e (?:version |v ?)?1(?: 0)?", r"artistic 1 0"),
    ("artistic-2.0", "artistic", r"artistic licen[sc]e (?:version |v ?)?2(?: 0)?", r"artistic 2 0"),
    ("artistic", "artistic", r"(?:perl )?artistic licen[sc]e", r"artistic"),
    ("unlicense", "unlicense", r"(?:the )?unlicense", r"unlicense"),
    ("wtfpl", "wtfpl", r"wtfpl(?: version 2)?", r"wtfpl"),
    ("python", "python", r"python software foundation licen[sc]e(?: version 2)?", r"(?:psf|python) 2 0"),
    ("postgresql", "postgresql", r"postgresql licen[sc]e", r"postgresql"),
    ("php-3.01", "php", r"php licen[sc]e(?: (?:version |v ?)?3(?: 0?1)?)?", r"php 3 0?1"),
    ("ruby", "ruby", r"ruby licen[sc]e", r"ruby"),
    ("openssl", "openssl", r"openssl (?:ssleay )?licen[sc]e", r"openssl"),
    ("ofl-1.1", "font", r"(?:sil )?open font licen[sc]e(?: (?:version |v ?)?1 1)?", r"ofl 1 1"),
    ("odbl-1.0", "database", r"open (?:data commons open )?database licen[sc]e(?: (?:version |v ?)?1 0)?", r"odbl 1 0"),
    ("odc-by-1.0", "attribution", r"open data commons attribution licen[sc]e", r"odc by 1 0"),
    ("pddl-1.0", "domain", r"(?:open data commons )?public domain dedication and licen[sc]e", r"pddl 1 0"),
    ("cdla-permissive", "data", r"community data licen[sc]e agreement permissive(?: [12] 0)?", r"cdla permissive [12] 0"),
    ("cdla-sharing", "data", r"community data licen[sc]e agreement sharing(?: 1 0)?", r"cdla sharing 1 0"),
    ("eupl-1.2", "european", r"european union public licen[sc]e(?: (?:version |v ?)?1 [12])?", r"eupl 1 [12]"),
    ("cecill", "cecill", r"cecill(?: (?:free software )?licen[sc]e)?(?: agreement)?", r"cecill(?: [bc12])?(?: [01])?"),
    ("ms-pl", "microsoft", r"microsoft public licen[sc]e", r"ms pl"),
    ("ms-rl", "microsoft", r"microsoft reciprocal licen[sc]e", r"ms rl"),
    ("upl-1.0", "universal", r"universal permissive licen[sc]e(?: (?:version |v ?)?1 0)?", r"upl 1 0"),
    ("afl-3.0", "academic", r"academic free licen[sc]e(?: (?:version |v ?)?[123] [01])?", r"afl [123] [01]"),
    ("osl-3.0", "open", r"open software licen[sc]e(?: (?:version |v ?)?[123] [01])?", r"osl [123] [01]"),
    ("ncsa", "ncsa", r"(?:university of illinois )?ncsa (?:open source )?licen[sc]e", r"ncsa"),
    ("beerware", "beer", r"beer ?ware licen[sc]e", r"beerware"),
    ("openrail", "rail", r"(?:bigscience |creativeml )?(?:open )?rail ?m? licen[sc]e", r"openrail(?: m)?"),
    ("ecl-2.0", "educational", r"educational community licen[sc]e(?: (?:version |v ?)?2 0)?", r"ecl 2 0"),
    ("w3c", "w3c", r"w3c (?:software )?(?:notice and )?licen[sc]e", r"w3c"),
    ("vim", "vim", r"vim licen[sc]e", r"vim"),
    ("sspl-1.0", "server", r"server side public licen[sc]e(?: (?:version |v ?)?1)?", r"sspl 1 0"),
    ("busl-1.1", "business", r"business source licen[sc]e(?: (?:version |v ?)?1 1)?", r"busl 1 1"),
    ("elastic-2.0", "elastic", r"elastic licen[sc]e(?: (?:version |v ?)?2(?: 0)?)?", r"elastic 2 0"),
]

#: Ways of naming a license: priority, keywords of which every way has one, weight, expression around the name or the identifier.
FORMS = [
    (50, "spdx", 1.0, r"spdx licen[sc]e identifier (?:{short})"),
    (40, "under", 0.95, r"(?:licen[sc]ed|released|distributed|available|published|provided|covered|redistribute it) (?:to you )?under (?:the )?(?:terms of )?(?:the )?(?:{name}|{short} licen[sc]e)"),
    (35, "", 0.85, r"(?:see|read|refer to|copy of|text of|terms of) (?:the )?(?:{name})"),
    (30, "licen", 0.8, r"licen[sc]e (?:is )?(?:the )?(?:{short})"),
    (20, "", 0.7, r"(?:{name})"),
]

#: Full-text marks and refusals that name no license: label, priority, keyword, weight, expression.
MARKS = [
    ("mit", 45, "hereby", 0.95, r"permission is hereby granted free of charge to any person obtaining a copy"),
    ("isc", 45, "purpose", 0.9, r"permission to use copy modify and or distribute this software for any purpose with or without fee"),
    ("bsd", 45, "redistribution", 0.9, r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("zlib", 45, "altered", 0.9, r"altered source versions must be plainly marked as such"),
    ("boost-1.0", 45, "machine", 0.9, r"machine executable object code generated by a source language processor"),
    ("public-domain", 25, "domain", 0.7, r"(?:dedicated to|released into|placed in(?:to)?|in) the public domain"),
    ("proprietary", 25, "proprietary", 0.6, r"(?:proprietary and confidential|confidential and proprietary)"),
    ("all-rights-reserved", 15, "reserved", 0.5, r"all rights reserved"),
    ("copyright", 10, "copyright", 0.4, r"copyright (?:c )?(?:19|20)[0-9][0-9]"),
    # headers of source files
    ("apache-2.0", 48, "compliance", 0.95, r"you may not use this (?:file|software|work) except in compliance with the licen[sc]e"),
    ("apache", 44, "applicable", 0.85, r"unless required by applicable law or agreed to in writing software distributed under the licen[sc]e is distributed on an as is basis"),
    ("apache", 44, "contributor licen", 0.8, r"licen[sc]ed to the apache software foundation (?:asf )?under one or more contributor licen[sc]e agreements"),
    ("gpl", 46, "redistribute it", 0.9, r"(?:this|the) (?:program|file|software|work) is free software you can redistribute it and or modify it under the terms of the gnu general public licen[sc]e"),
    ("lgpl", 46, "redistribute it", 0.9, r"(?:this|the) (?:library|program|file|software) is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public licen[sc]e"),
    ("agpl", 46, "redistribute it", 0.9, r"(?:this|the) (?:program|file|software) is free software you can redistribute it and or modify it under the terms of the gnu affero general public licen[sc]e"),
    ("gpl", 43, "received a copy", 0.8, r"you should have received a copy of the gnu general public licen[sc]e"),
    ("lgpl", 43, "received a copy", 0.8, r"you should have received a copy of the gnu (?:lesser|library) general public licen[sc]e"),
    ("agpl", 43, "received a copy", 0.8, r"you should have received a copy of the gnu affero general public licen[sc]e"),
    ("gpl", 22, "later version", 0.6, r"either version [23] (?:0 )?of the licen[sc]e or at your option any later version"),
    ("gpl-exception", 47, "exception", 0.8, r"as a special exception (?:to the gnu general public licen[sc]e|the copyright holders? gives? you permission)"),
    ("mpl-2.0", 46, "source code form", 0.95, r"this source code form is subject to the terms of the mozilla public licen[sc]e v ?2 0"),
    ("mpl-1.1", 46, "contents of this file", 0.9, r"the contents of this file are subject to the (?:mozilla|netscape) public licen[sc]e version 1 [01]"),
    ("epl", 46, "accompanying", 0.9, r"this program and the accompanying materials are made available under the terms of the eclipse public licen[sc]e"),
    ("cddl", 46, "contents of this file", 0.9, r"the contents of this file are subject to the terms of the common development and distribution licen[sc]e"),
    ("eupl", 46, "eupl", 0.9, r"licen[sc]ed under the eupl version 1 [12]"),
    ("ms-pl", 44, "governs", 0.8, r"this licen[sc]e governs use of the accompanying software if you use the software you accept this licen[sc]e"),
    ("bsd", 42, "bsd style", 0.8, r"(?:use of this source code is )?governed by a bsd style licen[sc]e"),
    ("mit", 42, "mit style", 0.8, r"(?:use of this source code is )?governed by an mit style licen[sc]e"),
    # clauses of the texts themselves
    ("mit", 44, "copyright notice", 0.85, r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("isc", 44, "copyright notice", 0.85, r"provided that the above copyright notice and this permission notice appear in all copies"),
    ("bsd", 44, "redistributions", 0.85, r"redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", 44, "redistributions", 0.85, r"redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd-3-clause", 44, "endorse", 0.85, r"may be used to endorse or promote products derived from this software without (?:specific )?prior written permission"),
    ("bsd-4-clause", 45, "advertising", 0.9, r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("apache-1.1", 45, "software foundation", 0.85, r"this product includes software developed by the apache software foundation"),
    ("apache-2.0", 44, "contributor hereby", 0.9, r"each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable"),
    ("gpl", 41, "copyleft", 0.7, r"the gnu general public licen[sc]e is a free copyleft licen[sc]e for software"),
    ("gpl-2.0", 44, "licenses for most", 0.8, r"the licenses for most software are designed to take away your freedom to share and change it"),
    ("agpl-3.0", 44, "network", 0.85, r"your modified version must prominently offer all users interacting with it remotely through a computer network"),
    ("zlib", 44, "origin", 0.85, r"the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("unlicense", 46, "unencumbered", 0.95, r"this is free and unencumbered software released into the public domain"),
    ("unlicense", 44, "anyone is free", 0.8, r"anyone is free to copy modify publish use compile sell or distribute this software"),
    ("cc0-1.0", 45, "waived", 0.9, r"has waived all copyright and related or neighboring rights"),
    ("wtfpl", 45, "what the", 0.95, r"you just do what the fuck you want to"),
    ("beerware", 45, "beer", 0.95, r"you can buy me a beer in return"),
    ("boost-1.0", 44, "copyright notices", 0.85, r"the copyright notices in the software and this entire statement including the above licen[sc]e grant"),
    ("artistic", 44, "standard version", 0.8, r"you may distribute verbatim copies of the (?:source form of the )?standard version of this package"),
    ("postgresql", 44, "documentation for any purpose", 0.85, r"permission to use copy modify and distribute this software and its documentation for any purpose without fee"),
    ("ofl-1.1", 45, "reserved font", 0.9, r"no modified version of the font software may use the reserved font name"),
    ("ofl-1.1", 44, "font software", 0.85, r"permission is hereby granted free of charge to any person obtaining a copy of the font software"),
    ("openssl", 45, "openssl", 0.9, r"this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("json", 45, "good not evil", 0.95, r"the software shall be used for good not evil"),
    ("commons-clause", 47, "commons clause", 0.9, r"(?:the )?commons clause licen[sc]e condition"),
    ("sspl-1.0", 45, "as a service", 0.9, r"if you make the functionality of the program or a modified version available to third parties as a service"),
    ("busl-1.1", 45, "change date", 0.85, r"effective on the change date or the fourth anniversary of the first publicly available distribution"),
    ("odbl", 45, "database", 0.85, r"(?:this|the) (?:data|database) is (?:made available|licen[sc]ed) under the open database licen[sc]e"),
    ("ogl", 45, "contains", 0.85, r"contains public sector information licen[sc]ed under the open government licen[sc]e"),
    ("gfdl", 45, "free documentation", 0.9, r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[sc]e"),
    ("openrail", 45, "derivatives of the model", 0.85, r"you agree not to use the model or derivatives of the model"),
    # refusals and claims
    ("proprietary", 26, "proprietary|confidential", 0.7, r"this (?:document|file|software|material) (?:contains|is) (?:proprietary|confidential)(?: and (?:proprietary|confidential))?(?: information)?"),
    ("proprietary", 26, "unauthori", 0.65, r"unauthori[sz]ed (?:copying|reproduction|use|distribution)(?: of this (?:file|document|software)| or distribution)? is strictly prohibited"),
    ("non-commercial", 24, "use only|purposes only", 0.6, r"for (?:personal|research|educational|non commercial)(?: and (?:personal|research|educational|non commercial))? (?:use|purposes) only"),
    ("no-redistribution", 24, "without", 0.6, r"may not be (?:reproduced|copied|distributed|republished)(?: in whole or in part| in any form)? without (?:the )?(?:express |prior )?(?:written )?(?:permission|consent)"),
    ("warranty-disclaimer", 12, "warranty", 0.4, r"(?:provided|distributed) as is without (?:any )?warranty of any kind"),
    ("unknown-license", 5, "licen", 0.3, r"(?:this work|this file|this document|this software|it) is licen[sc]ed under"),
]


@lru_cache(maxsize=1)
def rules() -> list[tuple[int, str, tuple[tuple[bytes, ...], ...], float, re.Pattern]]:
    """All rules, highest priority first: priority, label, sets of keywords of which one each must occur, weight, expression."""
    found = []
    for label, key, name, short in LICENSES:
        for priority, word, weight, form in FORMS:
            keys = [word] if priority in (30, 50) else [key, word]
            if priority == 40:
                keys = [word]
            found.append((priority, label, keys, weight, form.format(name=name, short=short)))
    found += [(priority, label, [key], weight, text) for label, priority, key, weight, text in MARKS]
    ready = [(p, label, tuple(tuple(k.encode().split(b"|")) for k in keys if k), w, re.compile(rb"(?<= )(?:" + text.encode() + rb")(?= )")) for p, label, keys, w, text in found]
    return sorted(ready, key=lambda r: -r[0])


class Reach:
    """How far the kept detections that start at or before a place reach, for places known beforehand (a tree of maxima)."""

    def __init__(self, places: list[int]):
        self.places = sorted(set(places))
        self.far = [-1] * (len(self.places) + 1)

    def keep(self, start: int, end: int) -> None:
        i = bisect_left(self.places, start) + 1
        while i <= len(self.places):
            self.far[i] = max(self.far[i], end)
            i += i & -i

    def up_to(self, place: int) -> int:
        i, far = bisect_right(self.places, place), -1
        while i:
            far = max(far, self.far[i])
            i -= i & -i
        return far


def detect(line: bytes) -> list[tuple[int, int, str, float]]:
    """Detections in a line of words with a space before and after each: start, end, label, weight.

    In order of priority and length, a detection inside a kept one is suppressed, and a weak one by any overlap.
    """
    seen: dict[tuple[bytes, ...], bool] = {}
    hits = []
    for order, (priority, label, keys, weight, text) in enumerate(rules()):
        for k in keys:
            if k not in seen:
                seen[k] = any(x in line for x in k)
        if all(seen[k] for k in keys):
            hits += [(-priority, m.start() - m.end(), m.start(), order, m.end(), label, weight) for m in text.finditer(line)]
    kept: list[tuple[int, int, str, float]] = []
    reach = Reach([h[2] for h in hits])
    for low, _, start, _, end, label, weight in sorted(hits):
        if reach.up_to(start) < end and (-low > WEAK or reach.up_to(end - 1) <= start):
            kept.append((start, end, label, weight))
            reach.keep(start, end)
    return sorted(kept)


#: Detections up to this priority are suppressed by any overlap.
WEAK = 5
#: Every rule needs one of these, so a text without any has no detection.
GATE = (b"warranty", b"redistribute", b"endorse", b"advertising", b"developed by", b"network", b"origin", b"unencumbered", b"waived", b"beer", b"what the", b"standard version",
        b"font", b"openssl", b"evil", b"as a service", b"change date", b"confidential", b"unauthori", b"use only", b"purposes only", b"may not be", b"anyone is free", b"derivatives of the model", b"special exception", b"licen", b"spdx", b"hereby", b"purpose", b"redistribution", b"altered", b"machine", b"domain", b"proprietary", b"reserved", b"copyright",
        b"under", b"general", b"gpl", b"bsd", b"cc0", b"cc by", b"commons", b"unlicense", b"wtfpl", b"cecill")


def scan_text(text: str | None) -> tuple[int, list[tuple[int, int, str]], list[tuple[int, int, str, float]]]:
    """Words of a text, base places and detections; positions are word numbers, the end exclusive."""
    words = WORD.findall((text or "").encode().lower())
    line = b" " + b" ".join(words) + b" "
    base: list[tuple[int, int, str]] = []
    if b" license " in line:
        spaces = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
        for phrase, label in BASE:
            n, raw, at = phrase.count(" ") + 1, f" {phrase} ".encode(), line.find(f" {phrase} ".encode())
            while at >= 0:
                first = int(np.searchsorted(spaces, at))
                base.append((first, first + n, label))
                at = line.find(raw, at + 1)
    spans = []
    if any(g in line for g in GATE):
        found = detect(line)
        if found:
            spaces = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
            # words before a detection and up to its end
            first, after = (np.searchsorted(spaces, np.array([x[k] for x in found]) - 1 + k) for k in (0, 1))
            spans = [(a, b, label, weight) for a, b, (_, _, label, weight) in zip(first.tolist(), after.tolist(), found)]
    return len(words), sorted(base), spans


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: words, base places, labels, detections and a score.

    Null text counts as empty.  Repeated rows give repeated results; an empty table an empty one;
    other columns are not looked at.  ``detections`` lists (first word, end, label, weight) after
    suppression; the score is the largest weight, at least 0.7 where a base phrase occurs.
    """
    def start():
        def work(doc, text):
            n, base, spans = scan_text(text)
            named = sorted({x[2] for x in base})
            labels = sorted({*named, *(x[2] for x in spans)})
            score = max([0.0, *(x[3] for x in spans), *(0.7 for _ in base[:1])])
            places = [b[0] for b in base]
            yield (doc, n, len(base), min(places, default=None), max(places, default=None), ",".join(named), ",".join(labels), score,
                   [{"first": a, "end": b, "label": c, "weight": w} for a, b, c, w in spans])
        return work

    return map_rows(pick(docs, id_col, text_col), start,
                    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
                    "detections array<struct<first:long,end:long,label:string,weight:double>>")
