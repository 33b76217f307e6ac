"""Signature rules of the license scan: an ordered table of regular expressions over words.

A rule is read against words that are lower-cased, without punctuation and joined by single spaces, from the place of its
first word, which is literal and is the keyword that gates it. Every expression is written by hand; openings ("licensed under the terms of")
come before each name, and each identifier stands behind its tag. The order decides among rules that find the same interval.
"""

from __future__ import annotations

#: Priorities, best first: tags, texts of licenses, openings with a name, full names, identifiers, hints; and how sure a finding of each is.
TAG, TEXT, GRANT, NAME, IDENT, HINT = range(6)
CONFIDENCE = [0.99, 0.95, 0.9, 0.75, 0.5, 0.25]
#: No rule takes more words than this.
SPAN = 24

#: Phrases whose places are counted whatever else is found, and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

_V = r"(?: version| v)?"
_LATER = r"(?: or(?: any| at your option any)? later(?: version)?| only)?"
_G = r"(?:gnu )?"
_LIC = r"licen[cs]e"

#: Full names, as label and expression.
NAMES = [
    ("mit", rf"mit(?: x11)? {_LIC}"), ("mit", rf"x11 {_LIC}"), ("mit", rf"expat {_LIC}"), ("mit-0", rf"mit no attribution(?: {_LIC})?"),
    ("apache-1.0", rf"apache(?: software)? {_LIC}{_V} 1 0"), ("apache-1.1", rf"apache(?: software)? {_LIC}{_V} 1 1"), ("apache-2.0", rf"apache(?: software)? {_LIC}{_V} 2(?: 0)?"), ("apache", rf"apache(?: software)? {_LIC}"),
    ("bsd-2-clause", rf"bsd 2 clause(?: simplified)?(?: {_LIC})?"), ("bsd-3-clause", rf"bsd 3 clause(?: new| revised)?(?: {_LIC})?"), ("bsd-4-clause", rf"bsd 4 clause(?: original)?(?: {_LIC})?"),
    ("bsd-2-clause", rf"two clause bsd(?: {_LIC})?"), ("bsd-2-clause", rf"simplified bsd(?: {_LIC})?"), ("bsd-2-clause", rf"freebsd {_LIC}"), ("bsd-3-clause", rf"three clause bsd(?: {_LIC})?"),
    ("bsd-3-clause", rf"new bsd {_LIC}"), ("bsd-3-clause", rf"revised bsd {_LIC}"), ("bsd-3-clause", rf"modified bsd {_LIC}"), ("bsd-4-clause", rf"original bsd {_LIC}"), ("bsd-4-clause", rf"four clause bsd(?: {_LIC})?"), ("bsd", rf"bsd(?: style)? {_LIC}"), ("0bsd", rf"zero clause bsd(?: {_LIC})?"),
    ("gpl-1.0", rf"gnu general public {_LIC}{_V} 1(?: 0)?{_LATER}"), ("gpl-2.0", rf"gnu general public {_LIC}{_V} 2(?: 0)?{_LATER}"), ("gpl-3.0", rf"gnu general public {_LIC}{_V} 3(?: 0)?{_LATER}"), ("gpl", rf"gnu general public {_LIC}s?"),
    ("gpl-2.0", rf"general public {_LIC}{_V} 2(?: 0)?{_LATER}"), ("gpl-3.0", rf"general public {_LIC}{_V} 3(?: 0)?{_LATER}"), ("gpl", rf"general public {_LIC}s?"), ("gpl", rf"gnu gpl{_V}(?: [123](?: 0)?)?"),
    ("lgpl-2.0", rf"gnu library general public {_LIC}(?:{_V} 2(?: 0)?{_LATER})?"), ("lgpl-2.1", rf"gnu lesser general public {_LIC}{_V} 2 1{_LATER}"), ("lgpl-3.0", rf"gnu lesser general public {_LIC}{_V} 3(?: 0)?{_LATER}"), ("lgpl", rf"gnu lesser general public {_LIC}"),
    ("lgpl-2.1", rf"lesser general public {_LIC}{_V} 2 1{_LATER}"), ("lgpl-3.0", rf"lesser general public {_LIC}{_V} 3(?: 0)?{_LATER}"), ("lgpl", rf"lesser general public {_LIC}"), ("lgpl", rf"library general public {_LIC}"),
    ("agpl-1.0", rf"affero general public {_LIC}{_V} 1(?: 0)?"), ("agpl-3.0", rf"gnu affero general public {_LIC}{_V} 3(?: 0)?{_LATER}"), ("agpl", rf"gnu affero general public {_LIC}"), ("agpl-3.0", rf"affero general public {_LIC}{_V} 3(?: 0)?{_LATER}"), ("agpl", rf"affero general public {_LIC}"),
    ("gfdl-1.1", rf"gnu free documentation {_LIC}{_V} 1 1{_LATER}"), ("gfdl-1.2", rf"gnu free documentation {_LIC}{_V} 1 2{_LATER}"), ("gfdl-1.3", rf"gnu free documentation {_LIC}{_V} 1 3{_LATER}"), ("gfdl", rf"gnu free documentation {_LIC}"), ("gfdl", rf"free documentation {_LIC}"),
    ("mpl-1.0", rf"mozilla public {_LIC}{_V} 1 0"), ("mpl-1.1", rf"mozilla public {_LIC}{_V} 1 1"), ("mpl-2.0", rf"mozilla public {_LIC}{_V} 2(?: 0)?"), ("mpl", rf"mozilla public {_LIC}"),
    ("epl-1.0", rf"eclipse public {_LIC}{_V} 1(?: 0)?"), ("epl-2.0", rf"eclipse public {_LIC}{_V} 2(?: 0)?"), ("epl", rf"eclipse public {_LIC}"), ("edl-1.0", rf"eclipse distribution {_LIC}{_V}(?: 1(?: 0)?)?"),
    ("eupl-1.1", rf"european union public licen[cs]e{_V} 1 1"), ("eupl-1.2", rf"european union public licen[cs]e{_V} 1 2"), ("eupl", rf"european union public {_LIC}"), ("cddl-1.0", rf"common development and distribution {_LIC}(?:{_V} 1 0)?"), ("cddl-1.1", rf"common development and distribution {_LIC}{_V} 1 1"),
    ("cpl-1.0", rf"common public {_LIC}(?:{_V} 1 0)?"), ("ipl-1.0", rf"ibm public {_LIC}(?:{_V} 1 0)?"), ("ms-pl", rf"microsoft public {_LIC}"), ("ms-rl", rf"microsoft reciprocal {_LIC}"), ("artistic-1.0", rf"artistic {_LIC}{_V} 1(?: 0)?"), ("artistic-2.0", rf"artistic {_LIC}{_V} 2(?: 0)?"), ("artistic", rf"artistic {_LIC}"),
    ("isc", rf"isc {_LIC}"), ("zlib", rf"zlib(?: libpng)? {_LIC}"), ("libpng", rf"libpng {_LIC}"), ("bsl-1.0", rf"boost software {_LIC}(?:{_V} 1 0)?"), ("busl-1.1", rf"business source {_LIC}(?:{_V} 1 1)?"), ("psf-2.0", rf"python software foundation {_LIC}(?:{_V} 2)?"), ("psf", rf"python {_LIC}"),
    ("php-3.01", rf"php {_LIC}(?:{_V} 3(?: 0?1)?)?"), ("ruby", rf"ruby {_LIC}"), ("openssl", rf"openssl {_LIC}"), ("postgresql", rf"postgresql {_LIC}"), ("ncsa", r"university of illinois(?: ncsa)? open source licen[cs]e"), ("w3c", rf"w3c(?: software)?(?: notice and)? {_LIC}"), ("curl", rf"curl {_LIC}"),
    ("unlicense", r"unlicense"), ("wtfpl", r"fuck you want to public licen[cs]e"), ("wtfpl", r"wtf public licen[cs]e"), ("beerware", rf"beer ware {_LIC}"), ("beerware", rf"beerware {_LIC}"), ("json", rf"json {_LIC}"), ("vim", rf"vim {_LIC}"), ("sissl", rf"sun industry standards source {_LIC}"),
    ("osl-3.0", rf"open software {_LIC}(?:{_V} 3(?: 0)?)?"), ("afl-3.0", rf"academic free {_LIC}(?:{_V} 3(?: 0)?)?"), ("ecl-2.0", rf"educational community {_LIC}(?:{_V} 2(?: 0)?)?"), ("upl-1.0", rf"universal permissive {_LIC}(?:{_V} 1 0)?"), ("cecill", rf"cecill {_LIC}"), ("cpal-1.0", rf"common public attribution {_LIC}(?:{_V} 1 0)?"),
    ("sspl-1.0", rf"server side public {_LIC}(?:{_V} 1)?"), ("elastic-2.0", rf"elastic {_LIC}(?:{_V} 2(?: 0)?)?"), ("ofl-1.1", rf"sil open font {_LIC}(?:{_V} 1 1)?"), ("ofl-1.1", rf"open font {_LIC}(?:{_V} 1 1)?"), ("odbl-1.0", rf"open database {_LIC}(?:{_V} 1 0)?"), ("odc-by-1.0", rf"open data commons attribution {_LIC}"), ("pddl-1.0", rf"public domain dedication and {_LIC}"),
    ("openrail", r"openrail(?: m)?(?: licen[cs]e)?"), ("openrail", rf"creativeml open rail m(?: {_LIC})?"), ("llama", r"llama [23](?: [0-9])? community licen[cs]e(?: agreement)?"), ("ogl-uk", rf"open government {_LIC}(?:{_V} [123](?: 0)?)?"), ("etalab-2.0", r"licence ouverte(?: open licence)?(?: version 2(?: 0)?)?"),
    ("cc0-1.0", r"creative commons (?:zero|cc0)(?: (?:version |v)?1 0)?(?: universal)?"), ("cc0-1.0", r"cc0 1 0 universal"), ("cc-by-nc-nd", r"creative commons attribution non ?commercial no ?deriv(?:s|atives|ative works)(?: [1-4] [05])?(?: international| unported)?"), ("cc-by-nc-sa", r"creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?(?: international| unported)?"),
    ("cc-by-nc", r"creative commons attribution non ?commercial(?: [1-4] [05])?(?: international| unported)?"), ("cc-by-nd", r"creative commons attribution no ?deriv(?:s|atives|ative works)(?: [1-4] [05])?(?: international| unported)?"), ("cc-by-sa", r"creative commons attribution share ?alike(?: [1-4] [05])?(?: international| unported)?"),
    ("cc-by", r"creative commons attribution(?: [1-4] [05])?(?: international| unported)?(?: licen[cs]e)?"), ("cc", rf"creative commons(?: {_LIC})?"), ("public-domain", r"public domain"),
]

#: Identifiers, as label and expression; each is also read behind the tags.
IDENTS = [
    ("mit-0", r"mit 0"), ("apache-2.0", r"apache(?: v)? 2(?: 0)?"), ("apache-1.1", r"apache 1 1"), ("apache-2.0", r"asl 2 0"), ("bsd-2-clause", r"bsd 2 clause"), ("bsd-3-clause", r"bsd 3 clause"), ("0bsd", r"0bsd"), ("gpl-1.0", r"gpl(?: v)? 1(?: 0)?(?: only| or later)?"), ("gpl-2.0", r"gpl(?: v)? 2(?: 0)?(?: only| or later)?"),
    ("gpl-3.0", r"gpl(?: v)? 3(?: 0)?(?: only| or later)?"), ("gpl-2.0", r"gplv2(?: only| or later)?"), ("gpl-3.0", r"gplv3(?: only| or later)?"), ("gpl", r"gpl"), ("lgpl-2.0", r"lgpl(?: v)? 2(?: 0)?(?: only| or later)?"), ("lgpl-2.1", r"lgpl(?: v)? 2 1(?: only| or later)?"), ("lgpl-3.0", r"lgpl(?: v)? 3(?: 0)?(?: only| or later)?"),
    ("lgpl-2.1", r"lgplv2 1"), ("lgpl-3.0", r"lgplv3"), ("lgpl", r"lgpl"), ("agpl-3.0", r"agpl(?: v)? 3(?: 0)?(?: only| or later)?"), ("agpl-3.0", r"agplv3"), ("agpl", r"agpl"), ("gfdl-1.3", r"gfdl 1 3(?: only| or later)?"), ("gfdl", r"gfdl"), ("mpl-1.1", r"mpl(?: v)? 1 1"), ("mpl-2.0", r"mpl(?: v)? 2(?: 0)?"), ("epl-1.0", r"epl 1 0"), ("epl-2.0", r"epl 2 0"),
    ("eupl-1.2", r"eupl(?: v)? 1 2"), ("cddl-1.0", r"cddl(?: 1 0)?"), ("artistic-2.0", r"artistic 2 0"), ("bsl-1.0", r"bsl 1 0"), ("busl-1.1", r"busl 1 1"), ("psf-2.0", r"psf 2 0"), ("ncsa", r"ncsa"), ("ms-pl", r"ms pl"), ("ms-rl", r"ms rl"), ("osl-3.0", r"osl 3 0"), ("afl-3.0", r"afl 3 0"), ("ecl-2.0", r"ecl 2 0"), ("upl-1.0", r"upl 1 0"), ("wtfpl", r"wtfpl"),
    ("sspl-1.0", r"sspl(?: 1 0)?"), ("ofl-1.1", r"ofl(?: 1 1)?"), ("odbl-1.0", r"odbl(?: 1 0)?"), ("pddl-1.0", r"pddl(?: 1 0)?"), ("zpl-2.1", r"zpl 2 1"), ("cc0-1.0", r"cc0(?: 1 0)?"), ("cc-by-nc-nd", r"cc by nc nd(?: [1-4] [05])?"), ("cc-by-nc-sa", r"cc by nc sa(?: [1-4] [05])?"), ("cc-by-nc", r"cc by nc(?: [1-4] [05])?"), ("cc-by-nd", r"cc by nd(?: [1-4] [05])?"),
    ("cc-by-sa", r"cc by sa(?: [1-4] [05])?"), ("cc-by", r"cc by(?: [1-4] [05])?"), ("cc", r"cc licensed"),
]
#: Identifiers too short to stand alone, read only behind the tags.
TAGGED = [("mit", "mit"), ("isc", "isc"), ("zlib", "zlib"), ("unlicense", "unlicense"), ("postgresql", "postgresql"), ("openssl", "openssl"), ("vim", "vim"), ("curl", "curl"), ("x11", "x11"), ("beerware", "beerware"), ("ruby", "ruby"), ("json", "json"), ("w3c", "w3c"), ("none", r"(?:none|noassertion)")]
TAGS = [r"spdx license identifier", r"license expression", r"pypi classifier license osi approved", r"classifier license osi approved"]
OPENINGS = [r"licensed under(?: the(?: terms of(?: the)?)?| a| an)?", r"released under(?: the(?: terms of(?: the)?)?| a| an)?", r"distributed under(?: the(?: terms of(?: the)?)?| a| an)?", r"available under(?: the(?: terms of(?: the)?)?| a| an)?"]

#: Sentences of the licenses themselves.
TEXTS = [
    ("mit", r"permission is hereby granted free of charge to any person obtaining a copy"), ("mit", r"software is provided as is without warranty of any kind express or implied"), ("isc", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"), ("isc", r"permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", r"redistribution and use in source and binary forms with or without modification are permitted"), ("bsd", r"redistributions of source code must retain the above copyright notice"), ("bsd", r"redistributions in binary form must reproduce the above copyright notice"), ("bsd-3-clause", r"neither the name of(?: the)? [^ ]+(?: [^ ]+){0,6} nor the names of its contributors"),
    ("bsd-4-clause", r"advertising materials mentioning features or use of this software must display"), ("apache-2.0", r"use this file except in compliance with the license"), ("apache-2.0", r"required by applicable law or agreed to in writing software"), ("gpl", r"program is free software you can redistribute it and or modify"), ("gpl", r"program is distributed in the hope that it will be useful"),
    ("lgpl", r"library is free software you can redistribute it and or modify"), ("lgpl", r"library is distributed in the hope that it will be useful"), ("gfdl", r"permission is granted to copy distribute and or modify this document"), ("mpl-2.0", r"source code form is subject to the terms of the mozilla public licen[cs]e"), ("mpl-1.1", r"contents of this file are subject to the mozilla public licen[cs]e"),
    ("cddl", r"contents of this file are subject to the terms of the common development and distribution licen[cs]e"), ("bsl-1.0", r"permission is hereby granted free of charge to any person or organization obtaining a copy"), ("zlib", r"origin of this software must not be misrepresented"), ("zlib", r"altered source versions must be plainly marked as such"), ("unlicense", r"unencumbered software released into the public domain"),
    ("cc0-1.0", r"person who associated a work with this deed has dedicated the work to the public domain"), ("wtfpl", r"fuck you want to"), ("beerware", r"beer in return"), ("json", r"software shall be used for good not evil"), ("postgresql", r"permission to use copy modify and distribute this software and its documentation for any purpose without fee"),
    ("ofl-1.1", r"font software is licensed under the sil open font licen[cs]e(?: version 1 1)?"), ("epl", r"accompanying materials are made available under the terms of the eclipse public licen[cs]e"),
    ("mit", r"opensource org licenses mit(?: license(?: php)?)?"), ("bsd-3-clause", r"opensource org licenses bsd 3 clause"), ("bsd-2-clause", r"opensource org licenses bsd 2 clause"), ("apache-2.0", r"apache org licenses license 2 0"), ("gpl", r"gnu org licenses(?: old licenses)? gpl"), ("gpl-2.0", r"gnu org licenses(?: old licenses)? gpl 2 0"), ("gpl-3.0", r"gnu org licenses gpl 3 0"),
    ("lgpl", r"gnu org licenses(?: old licenses)? lgpl"), ("agpl", r"gnu org licenses agpl"), ("gfdl", r"gnu org licenses fdl"), ("mpl-2.0", r"mozilla org mpl 2 0"), ("mpl", r"mozilla org mpl"), ("epl", r"eclipse org legal epl"), ("unlicense", r"unlicense org"), ("cc0-1.0", r"creativecommons org publicdomain zero 1 0"), ("public-domain", r"creativecommons org publicdomain mark 1 0"),
    ("cc-by-nc-nd", r"creativecommons org licenses by nc nd(?: [1-4] [05])?"), ("cc-by-nc-sa", r"creativecommons org licenses by nc sa(?: [1-4] [05])?"), ("cc-by-nc", r"creativecommons org licenses by nc(?: [1-4] [05])?"), ("cc-by-nd", r"creativecommons org licenses by nd(?: [1-4] [05])?"), ("cc-by-sa", r"creativecommons org licenses by sa(?: [1-4] [05])?"), ("cc-by", r"creativecommons org licenses by(?: [1-4] [05])?"),
]

#: What points to a license or to none, without a name.
HINTS = [
    ("reserved", r"all rights reserved"), ("reserved", r"todos los derechos reservados"), ("reserved", r"tous droits réservés"), ("reserved", r"alle rechte vorbehalten"), ("copyright", r"copyright(?: c)? (?:19|20)[0-9][0-9](?: (?:19|20)[0-9][0-9])?"), ("proprietary", r"proprietary and confidential"), ("proprietary", r"confidential and proprietary"),
    ("proprietary", r"reproduced(?: or distributed)? without(?: the)?(?: prior)?(?: written)? permission"), ("proprietary", r"unauthorized (?:copying|use|reproduction|distribution) (?:of this file )?is (?:strictly )?prohibited"), ("proprietary", r"end user licen[cs]e agreement"), ("free", r"free for (?:personal|academic|research) use"), ("noncommercial", r"noncommercial use(?: only)?"), ("noncommercial", r"non commercial use(?: only)?"),
    ("noncommercial", r"commercial use is (?:not permitted|prohibited)"), ("unknown", rf"licensed under(?: the| a)? [^ ]+(?: [^ ]+){{0,4}} {_LIC}"), ("unknown", rf"released under(?: the| a)? [^ ]+(?: [^ ]+){{0,4}} {_LIC}"), ("unknown", rf"distributed under(?: the| a)? [^ ]+(?: [^ ]+){{0,4}} {_LIC}"), ("unknown", r"license(?: file)? for(?: more)? details"), ("unknown", r"license (?:txt|md|file)"),
]


def rules() -> list[dict]:
    """All rules in order: key (the first word), pattern, label, priority."""
    listed = [(TAG, label, f"{tag} {ident}") for tag in TAGS for label, ident in IDENTS + TAGGED]
    listed += [(TEXT, label, text) for label, text in TEXTS]
    listed += [(GRANT, label, f"{opening} {name}") for opening in OPENINGS for label, name in NAMES + IDENTS]
    listed += [(NAME, label, name) for label, name in NAMES] + [(IDENT, label, ident) for label, ident in IDENTS] + [(HINT, label, hint) for label, hint in HINTS]
    return [{"key": pattern.split(" ")[0].split("(")[0], "pattern": pattern, "label": label, "priority": priority, "place": place} for place, (priority, label, pattern) in enumerate(listed)]
