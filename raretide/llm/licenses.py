"""License detection by ordered signature rules, wholly in DataFrame expressions.

A text is reduced to its words, each written between two single spaces (`` mit  license ``), so that a rule's regular
expression begins and ends on word borders and matches never share a character. Rules are gated by a keyword: a text
meets only the rules of the keywords it contains, and of these only those whose other fixed words it contains too. Every match is an interval of words with a priority; one contained in
the interval of a rule of the same or a better priority is suppressed, so that a notice silences the title in it and a
title the short name in it. Base rules report all their places, suppressed or not.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Priorities, best first.
TAG, URL, NOTICE, TITLE, SHORT = range(5)
WEIGHTS = {TAG: 1.0, URL: 0.95, NOTICE: 0.95, TITLE: 0.85, SHORT: 0.6}

#: Licences: label, keyword, words of the title (a|b are alternatives, a trailing ? makes a word optional),
#: words of the SPDX identifier, words of the canonical address (or empty).
LICENCES = (
    ("apache-1.0", "apache", "apache software? license v|version? 1 0", "apache 1 0", "apache org licenses license 1 0"),
    ("apache-1.1", "apache", "apache software? license v|version? 1 1", "apache 1 1", "apache org licenses license 1 1"),
    ("apache-2.0", "apache", "apache software? license v|version? 2 0?", "apache 2 0", "apache org licenses license 2 0"),
    ("mit", "mit", "mit license", "mit", "opensource org licenses|license mit"),
    ("mit", "expat", "expat license|licence", "", ""),
    ("mit-0", "mit", "mit no attribution license?", "mit 0", ""),
    ("x11", "x11", "x11 license", "x11", ""),
    ("x11", "xfree86", "xfree86 license", "", ""),
    ("isc", "isc", "isc license", "isc", "opensource org licenses|license isc"),
    ("0bsd", "bsd", "zero|0 clause bsd license?", "0bsd", "opensource org licenses|license 0bsd"),
    ("bsd-2-clause", "bsd", "simplified|freebsd|2|two clause? bsd license?", "bsd 2 clause", "opensource org licenses|license bsd 2 clause"),
    ("bsd-3-clause", "bsd", "new|revised|modified|3|three clause? bsd license?", "bsd 3 clause", "opensource org licenses|license bsd 3 clause"),
    ("bsd-4-clause", "bsd", "original|4|four clause? bsd license?", "bsd 4 clause", ""),
    ("gpl-1.0", "gnu", "gnu general public license v|version? 1 0?", "gpl 1 0 only|or? later?", "gnu org licenses gpl 1 0"),
    ("gpl-2.0", "gnu", "gnu general public license v|version? 2 0?", "gpl 2 0 only|or? later?", "gnu org licenses old? gpl 2 0"),
    ("gpl-3.0", "gnu", "gnu general public license v|version? 3 0?", "gpl 3 0 only|or? later?", "gnu org licenses gpl 3 0"),
    ("lgpl-2.0", "gnu", "gnu library general public license v|version? 2 0?", "lgpl 2 0 only|or? later?", "gnu org licenses lgpl 2 0"),
    ("lgpl-2.1", "gnu", "gnu lesser general public license v|version? 2 1", "lgpl 2 1 only|or? later?", "gnu org licenses lgpl 2 1"),
    ("lgpl-3.0", "gnu", "gnu lesser general public license v|version? 3 0?", "lgpl 3 0 only|or? later?", "gnu org licenses lgpl 3 0"),
    ("agpl-1.0", "affero", "affero general public license v|version? 1 0?", "agpl 1 0", ""),
    ("agpl-3.0", "affero", "gnu? affero general public license v|version? 3 0?", "agpl 3 0 only|or? later?", "gnu org licenses agpl 3 0"),
    ("gfdl-1.1", "gnu", "gnu free documentation license v|version? 1 1", "gfdl 1 1", ""),
    ("gfdl-1.2", "gnu", "gnu free documentation license v|version? 1 2", "gfdl 1 2", "gnu org licenses fdl 1 2"),
    ("gfdl-1.3", "gnu", "gnu free documentation license v|version? 1 3", "gfdl 1 3", "gnu org licenses fdl 1 3"),
    ("mpl-1.0", "mozilla", "mozilla public license v|version? 1 0", "mpl 1 0", "mozilla org mpl 1 0"),
    ("mpl-1.1", "mozilla", "mozilla public license v|version? 1 1", "mpl 1 1", "mozilla org mpl 1 1"),
    ("mpl-2.0", "mozilla", "mozilla public license v|version? 2 0", "mpl 2 0", "mozilla org mpl 2 0"),
    ("npl-1.1", "netscape", "netscape public license v|version? 1 1?", "npl 1 1", ""),
    ("epl-1.0", "eclipse", "eclipse public license v|version? 1 0", "epl 1 0", "eclipse org legal epl v10"),
    ("epl-2.0", "eclipse", "eclipse public license v|version? 2 0", "epl 2 0", "eclipse org legal epl 2 0"),
    ("edl-1.0", "eclipse", "eclipse distribution license v|version? 1 0", "", "eclipse org org? documents edl v10"),
    ("cpl-1.0", "common", "common public license v|version? 1 0", "cpl 1 0", ""),
    ("ipl-1.0", "ibm", "ibm public license v|version? 1 0", "ipl 1 0", ""),
    ("cddl-1.0", "cddl", "common? development? and? distribution? license? cddl v|version? 1 0", "cddl 1 0", ""),
    ("cddl-1.1", "cddl", "common? development? and? distribution? license? cddl v|version? 1 1", "cddl 1 1", ""),
    ("eupl-1.1", "eupl", "european? union? public? licence? eupl v|version? 1 1", "eupl 1 1", ""),
    ("eupl-1.2", "eupl", "european? union? public? licence? eupl v|version? 1 2", "eupl 1 2", ""),
    ("osl-3.0", "open", "open software license v|version? 3 0", "osl 3 0", ""),
    ("afl-3.0", "academic", "academic free license v|version? 3 0", "afl 3 0", ""),
    ("artistic-1.0", "artistic", "artistic license v|version? 1 0", "artistic 1 0", ""),
    ("artistic-2.0", "artistic", "artistic license v|version? 2 0", "artistic 2 0", "perlfoundation org artistic license 2 0"),
    ("zlib", "zlib", "zlib libpng? license", "zlib", "opensource org licenses|license zlib"),
    ("libpng-2.0", "png", "png reference library license v|version? 2?", "", ""),
    ("libpng-2.0", "libpng", "libpng reference? library? license v|version? 2?", "libpng 2 0", ""),
    ("bsl-1.0", "boost", "boost software license v|version? 1 0", "bsl 1 0", "boost org license 1 0 txt"),
    ("bsl-1.1", "business", "business source license v|version? 1 1", "busl 1 1", ""),
    ("sspl-1.0", "server", "server side public license v|version? 1?", "sspl 1 0", ""),
    ("elastic-2.0", "elastic", "elastic license v|version? 2 0?", "elastic 2 0", ""),
    ("unlicense", "unlicense", "the? unlicense", "unlicense", "unlicense org"),
    ("wtfpl", "wtfpl", "wtfpl v|version? 2?", "wtfpl", "wtfpl net"),
    ("cc0-1.0", "cc0", "cc0 1 0 universal?", "cc0 1 0", "creativecommons org publicdomain zero 1 0"),
    ("ms-pl", "microsoft", "microsoft public license", "ms pl", ""),
    ("ms-rl", "microsoft", "microsoft reciprocal license", "ms rl", ""),
    ("postgresql", "postgresql", "postgresql license|licence", "postgresql", "opensource org licenses|license postgresql"),
    ("python-2.0", "python", "python software foundation license v|version? 2?", "python 2 0", ""),
    ("php-3.01", "php", "php license v|version? 3 01?", "php 3 01", "php net license 3 01 txt"),
    ("ruby", "ruby", "ruby license|licence", "ruby", ""),
    ("openssl", "openssl", "openssl ssleay? license", "openssl", "openssl org source license"),
    ("openldap-2.8", "openldap", "openldap public license v|version? 2 8", "oldap 2 8", ""),
    ("w3c", "w3c", "w3c software notice? and|document? license", "w3c", "w3 org consortium legal copyright software"),
    ("ofl-1.1", "sil", "sil open font license v|version? 1 1?", "ofl 1 1", "scripts sil org ofl"),
    ("ncsa", "illinois", "university of illinois ncsa? open source license", "ncsa", ""),
    ("ecl-2.0", "educational", "educational community license v|version? 2 0", "ecl 2 0", ""),
    ("vim", "vim", "vim license", "vim", ""),
    ("upl-1.0", "universal", "universal permissive license v|version? 1 0", "upl 1 0", "oss oracle com licenses upl"),
    ("mulan-psl-2.0", "mulan", "mulan permissive software license v|version? 2", "mulanpsl 2 0", "license coscl org cn mulanpsl2"),
    ("cecill-2.1", "cecill", "cecill free? software? license? v|version? 2 1", "cecill 2 1", "cecill info"),
    ("odbl-1.0", "odbl", "open? database? license? odbl v|version? 1 0", "odbl 1 0", "opendatacommons org licenses odbl"),
    ("odc-by-1.0", "attribution", "open data commons attribution license v|version? 1 0", "odc by 1 0", "opendatacommons org licenses by"),
    ("openrail-m", "openrail", "bigscience? openrail m license?", "", ""),
    ("llama-2", "llama", "llama 2 community license agreement?", "llama2", ""),
)

#: Creative Commons: the elements and versions from which names and addresses are made.
CC_ELEMENTS = ("by", "by sa", "by nd", "by nc", "by nc sa", "by nc nd")
CC_VERSIONS = ("1 0", "2 0", "2 5", "3 0", "4 0")

#: Wordings that are no single licence: label, keyword, words, priority.
WORDINGS = (
    ("mit", "mit", "mit license", SHORT),
    ("apache", "apache", "apache license", SHORT),
    ("gpl", "public", "general public license", SHORT),
    ("lgpl", "lesser", "lesser general public license", SHORT),
    ("agpl", "affero", "affero general public license", SHORT),
    ("bsd", "bsd", "bsd license|licence|licensed", SHORT),
    ("mpl", "mozilla", "mozilla public license", SHORT),
    ("epl", "eclipse", "eclipse public license", SHORT),
    ("creative-commons", "creative", "creative commons license|licence?", SHORT),
    ("public-domain", "domain", "dedicated|released|placed in|into|to the public domain", NOTICE),
    ("public-domain", "domain", "public domain", SHORT),
    ("all-rights-reserved", "reserved", "all rights reserved", SHORT),
    ("proprietary", "proprietary", "proprietary and|or confidential", SHORT),
    ("copyright-notice", "copyright", "copyright c? 19[0-9]{2}|20[0-9]{2}", SHORT),
    ("mit", "permission", "permission is hereby granted free of charge to any person obtaining a copy", TITLE),
    ("isc", "permission", "permission to use copy modify and or distribute this software for any purpose", TITLE),
    ("bsd", "redistribution", "redistribution and use in source and binary forms with or without modification are permitted", TITLE),
    ("no-warranty", "warranty", "without warranty of any kind", SHORT),
    ("no-warranty", "warranties", "without warranties or conditions of any kind", SHORT),
    ("gpl", "gpl", "gpl", SHORT),
    ("lgpl", "lgpl", "lgpl", SHORT),
    ("agpl", "agpl", "agpl", SHORT),
    ("gpl-2.0", "gpl", "gnu? gpl license? v|version? 2 0?", TITLE),
    ("gpl-3.0", "gpl", "gnu? gpl license? v|version? 3 0?", TITLE),
    ("gpl-2.0", "gplv2", "gplv2 0?", TITLE),
    ("gpl-3.0", "gplv3", "gplv3 0?", TITLE),
    ("gpl-2.0", "gpl2", "gpl2", TITLE),
    ("gpl-3.0", "gpl3", "gpl3", TITLE),
    ("lgpl-2.1", "lgpl", "gnu? lgpl license? v|version? 2 1", TITLE),
    ("lgpl-3.0", "lgpl", "gnu? lgpl license? v|version? 3 0?", TITLE),
    ("lgpl-2.1", "lgplv2", "lgplv2 1", TITLE),
    ("lgpl-3.0", "lgplv3", "lgplv3 0?", TITLE),
    ("agpl-3.0", "agpl", "gnu? agpl license? v|version? 3 0?", TITLE),
    ("agpl-3.0", "agplv3", "agplv3 0?", TITLE),
    ("gpl-2.0", "either", "general public license as published by the free software foundation either version 2 of the license or", NOTICE),
    ("gpl-3.0", "either", "general public license as published by the free software foundation either version 3 of the license or", NOTICE),
    ("gpl-2.0", "published", "general public license version 2 as published by the free software foundation", NOTICE),
    ("gpl-3.0", "published", "general public license version 3 as published by the free software foundation", NOTICE),
    ("gpl-2.0", "foundation", "free software foundation version 2 of the license", NOTICE),
    ("lgpl-2.1", "lesser", "lesser general public license as published by the free software foundation either version 2 1 of the license", NOTICE),
    ("lgpl-3.0", "lesser", "lesser general public license as published by the free software foundation either version 3 of the license", NOTICE),
    ("agpl-3.0", "affero", "affero general public license as published by the free software foundation either version 3 of the license", NOTICE),
    ("gpl-linking-exception", "linking", "linking this library statically or dynamically with other modules", NOTICE),
    ("gpl-classpath-exception", "classpath", "classpath exception", TITLE),
    ("gcc-exception-3.1", "gcc", "gcc runtime library exception", TITLE),
    ("llvm-exception", "llvm", "llvm exceptions|exception", TITLE),
    ("apache-2.0", "apache", "apache v|version? 2 0", TITLE),
    ("apache-2.0", "asl", "asl v|version? 2 0?", TITLE),
    ("apache-2.0", "unless", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", NOTICE),
    ("apache-2.0", "apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at http|https www? apache org", NOTICE),
    ("bsd-2-clause", "bsd", "bsd 2|two clause", TITLE),
    ("bsd-3-clause", "bsd", "bsd 3|three clause", TITLE),
    ("bsd-4-clause", "bsd", "bsd 4|four clause", TITLE),
    ("bsd", "bsd", "bsd style license|licence", SHORT),
    ("bsd", "berkeley", "berkeley software distribution license", TITLE),
    ("bsd-3-clause", "endorse", "may be used to endorse or promote products derived from this software without specific prior written permission", NOTICE),
    ("bsd-4-clause", "advertising", "all advertising materials mentioning features or use of this software must display the following acknowledgement", NOTICE),
    ("bsd", "disclaimer", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", SHORT),
    ("mit", "substantial", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", NOTICE),
    ("mit", "noninfringement", "merchantability fitness for a particular purpose and noninfringement", SHORT),
    ("mit-0", "mit", "mit 0", TITLE),
    ("isc", "granted", "is hereby granted provided that the above copyright notice and this permission notice appear in all copies", NOTICE),
    ("zlib", "misrepresented", "the origin of this software must not be misrepresented", NOTICE),
    ("zlib", "altered", "altered source versions must be plainly marked as such", NOTICE),
    ("boost", "boost", "boost software license", SHORT),
    ("bsl-1.0", "accompanying", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", NOTICE),
    ("mpl-2.0", "mozilla", "this source code form is subject to the terms of the mozilla public license v|version? 2 0", NOTICE),
    ("mpl-1.1", "mozilla", "the contents of this file are subject to the mozilla public license version 1 1", NOTICE),
    ("mpl-2.0", "mpl", "mpl v|version? 2 0", TITLE),
    ("mpl-1.1", "mpl", "mpl v|version? 1 1", TITLE),
    ("mpl-2.0", "mplv2", "mplv2 0?", TITLE),
    ("mpl", "mpl", "mpl", SHORT),
    ("epl-1.0", "epl", "epl v|version? 1 0", TITLE),
    ("epl-2.0", "epl", "epl v|version? 2 0", TITLE),
    ("epl-2.0", "eclipse", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0", NOTICE),
    ("cddl", "development", "common development and distribution license", SHORT),
    ("cddl-1.0", "development", "common development and distribution license v|version? 1 0", TITLE),
    ("cddl-1.1", "development", "common development and distribution license v|version? 1 1", TITLE),
    ("eupl-1.2", "european", "european union public licence|license v|version? 1 2", TITLE),
    ("eupl-1.1", "european", "european union public licence|license v|version? 1 1", TITLE),
    ("unlicense", "unencumbered", "this is free and unencumbered software released into the public domain", NOTICE),
    ("unlicense", "anyone", "anyone is free to copy modify publish use compile sell or distribute this software", NOTICE),
    ("wtfpl", "fuck", "do what the fuck you want to public license", TITLE),
    ("cc0-1.0", "cc0", "cc0", SHORT),
    ("cc0-1.0", "waived", "has waived all copyright and related or neighboring rights", NOTICE),
    ("cc0-1.0", "zero", "creative commons zero v|version? 1? 0?", TITLE),
    ("beerware", "beer", "beer ware license", TITLE),
    ("beerware", "beerware", "beerware license?", TITLE),
    ("jsonlicense", "evil", "the software shall be used for good not evil", NOTICE),
    ("sspl-1.0", "sspl", "sspl", SHORT),
    ("elastic-2.0", "elastic", "elastic license", SHORT),
    ("elastic-2.0", "elv2", "elv2", TITLE),
    ("bsl-1.1", "change", "change license", SHORT),
    ("business-source", "business", "business source license", SHORT),
    ("commons-clause", "commons", "commons clause license? condition? v|version? 1? 0?", TITLE),
    ("polyform-noncommercial-1.0.0", "polyform", "polyform noncommercial license 1 0 0", TITLE),
    ("polyform-small-business-1.0.0", "polyform", "polyform small business license 1 0 0", TITLE),
    ("polyform", "polyform", "polyform", SHORT),
    ("openrail", "openrail", "openrail", SHORT),
    ("rail", "responsible", "responsible ai license|licenses rail?", TITLE),
    ("llama-3", "llama", "llama 3 community license agreement?", TITLE),
    ("llama", "llama", "meta llama license|community", SHORT),
    ("gemma", "gemma", "gemma terms of use", TITLE),
    ("odbl-1.0", "database", "open database license v|version? 1? 0?", TITLE),
    ("odc-by-1.0", "odc", "odc by v|version? 1? 0?", TITLE),
    ("pddl-1.0", "pddl", "pddl v|version? 1? 0?", TITLE),
    ("pddl-1.0", "dedication", "public domain dedication and license", TITLE),
    ("cdla-permissive-2.0", "cdla", "cdla permissive v|version? 2 0", TITLE),
    ("cdla-permissive-1.0", "cdla", "cdla permissive v|version? 1 0", TITLE),
    ("cdla-sharing-1.0", "cdla", "cdla sharing v|version? 1 0", TITLE),
    ("ogl-uk-3.0", "government", "open government licence|license v|version? 3 0?", TITLE),
    ("ogl-uk", "government", "open government licence|license", SHORT),
    ("etalab-2.0", "ouverte", "licence ouverte v|version? 2 0", TITLE),
    ("dl-de-by-2.0", "datenlizenz", "datenlizenz deutschland namensnennung v|version? 2 0", TITLE),
    ("ofl-1.1", "ofl", "ofl v|version? 1 1", TITLE),
    ("ofl", "font", "open font license", SHORT),
    ("artistic", "artistic", "artistic license", SHORT),
    ("perl", "perl", "same terms as perl itself", NOTICE),
    ("psf-2.0", "psf", "psf license v|version? 2?", TITLE),
    ("python", "python", "python license", SHORT),
    ("php", "php", "php license", SHORT),
    ("postgresql", "postgres", "postgres license", TITLE),
    ("hpnd", "historical", "historical permission notice and disclaimer", TITLE),
    ("curl", "curl", "curl license", TITLE),
    ("icu", "icu", "icu license", TITLE),
    ("unicode-dfs", "unicode", "unicode license agreement data files and software", TITLE),
    ("unicode", "unicode", "unicode license v|version? 3?", SHORT),
    ("bzip2-1.0.6", "bzip2", "bzip2 license v|version? 1? 0? 6?", TITLE),
    ("ijg", "jpeg", "independent jpeg group s software", NOTICE),
    ("ftl", "freetype", "freetype project license|licence", TITLE),
    ("mpich2", "mpich2", "mpich2 license", TITLE),
    ("tcl", "tcl", "tcl tk? license", TITLE),
    ("sleepycat", "sleepycat", "sleepycat license", TITLE),
    ("qpl-1.0", "qpl", "qpl v|version? 1 0", TITLE),
    ("qpl-1.0", "public", "q public license v|version? 1? 0?", TITLE),
    ("watcom-1.0", "sybase", "sybase open watcom public license", TITLE),
    ("apsl-2.0", "apple", "apple public source license v|version? 2 0?", TITLE),
    ("apsl", "apple", "apple public source license", SHORT),
    ("nasa-1.3", "nasa", "nasa open source agreement v|version? 1 3", TITLE),
    ("rpl-1.5", "reciprocal", "reciprocal public license v|version? 1 5", TITLE),
    ("cpal-1.0", "cpal", "common? public? attribution? license? cpal v|version? 1 0", TITLE),
    ("osl-2.1", "open", "open software license v|version? 2 1", TITLE),
    ("afl-2.1", "academic", "academic free license v|version? 2 1", TITLE),
    ("motosoto", "motosoto", "motosoto open source license", TITLE),
    ("nokia", "nokia", "nokia open source license", TITLE),
    ("intel", "intel", "intel open source license", TITLE),
    ("lppl-1.3c", "latex", "latex project public license v|version? 1 3c?", TITLE),
    ("lppl", "lppl", "lppl v|version? 1? 3c?", TITLE),
    ("cern-ohl", "cern", "cern open hardware licence|license v|version? 2?", TITLE),
    ("solderpad", "solderpad", "solderpad hardware? license v|version? 2? 1?", TITLE),
    ("tapr-ohl", "tapr", "tapr open hardware license", TITLE),
    ("gfdl", "gfdl", "gfdl", SHORT),
    ("gfdl", "documentation", "gnu free documentation license", SHORT),
    ("free-art-1.3", "art", "free art license v|version? 1? 3?", TITLE),
    ("public-domain", "author", "the author disclaims copyright to this source code", NOTICE),
    ("public-domain", "domain", "is in the public domain", NOTICE),
    ("us-government-work", "government", "work of the united|u states|s government", NOTICE),
    ("proprietary", "confidential", "confidential and proprietary", SHORT),
    ("proprietary", "unauthorized", "unauthorized copying of this file via any medium is strictly prohibited", NOTICE),
    ("proprietary", "reproduced", "may not be reproduced or|and|distributed in any form without", NOTICE),
    ("proprietary", "eula", "end user license agreement eula", TITLE),
    ("proprietary", "user", "end user license agreement", SHORT),
    ("non-commercial", "commercial", "for non commercial use only", NOTICE),
    ("non-commercial", "noncommercial", "for noncommercial use only", NOTICE),
    ("research-only", "research", "for research purposes|use only", NOTICE),
    ("freeware", "freeware", "freeware", SHORT),
    ("shareware", "shareware", "shareware", SHORT),
    ("no-warranty", "warranty", "with absolutely no warranty", SHORT),
    ("no-warranty", "warranty", "without even the implied warranty of merchantability", SHORT),
    ("as-is", "provided", "the software is provided as is", SHORT),
    ("copyleft", "copyleft", "copyleft", SHORT),
    ("dual-license", "dual", "dual licensed under", SHORT),
    ("licence-reference", "file", "see the license|licence|copying file for details|more|full|terms", SHORT),
    ("spdx", "spdx", "spdx license identifier", SHORT),
)
#: Up to ten words of any kind.
ANY_FEW = r"[^\x20]+ " + r"[^\x20]+? " * 9
#: One-word identifiers that may follow another one and OR, AND or a slash in a tag.
SECOND = ("mit", "isc", "zlib", "unlicense", "wtfpl", "0bsd", "ncsa", "postgresql", "openssl", "ruby", "x11")
#: Base rules: their phrases are counted at all places.
BASE = ("mit", "apache", "gpl")
BASE_PHRASES = ("mit license", "apache license", "general public license")

UNDER = "licensed|released|distributed|available|provided|published|governed|covered|offered under|by the? terms? of? the? "


def _unit(token: str) -> str:
    body, optional = (token[:-1], "?") if token.endswith("?") else (token, "")
    choices = body.split("|")
    return "(?:" + "|".join(f" {c} " for c in choices) + ")" + optional if len(choices) > 1 or optional else f" {body} "


def pattern(words: str) -> str:
    """The regular expression for a line of words over texts whose words stand between two spaces.

    ``v|version?`` before a number n admits n, v n, version n, and the word vn.
    """
    tokens, out = words.split(), ""
    for before, token in zip([""] + tokens, tokens, strict=False):
        if token == "v|version?":
            continue
        if before == "v|version?":
            number, optional = token.removesuffix("?"), "?" if token.endswith("?") else ""
            out += f"(?:(?: v | version )? {number} | v{number} ){optional}"
        else:
            out += _unit(token)
    return out


def rules() -> list[tuple]:
    """(rule, label, keyword, pattern, priority, weight, base) in order; each has its place in the list as number."""
    out = []

    def add(label: str, keyword: str, words: str, priority: int, base: bool = False) -> None:
        out.append((len(out), label, f" {keyword} ", pattern(words), priority, WEIGHTS[priority], base))

    for label, keyword, title, spdx, address in LICENCES:
        if spdx:
            add(label, "spdx", f"spdx license identifier {spdx}", TAG)
        if address:
            add(label, address.split()[0], address, URL)
        add(label, keyword, UNDER + title, NOTICE)
        add(label, keyword, title, TITLE)
    names = {"by": "attribution", "sa": "sharealike|share alike?", "nd": "noderivatives|noderivs|no derivatives?", "nc": "noncommercial|non commercial?"}
    for e in CC_ELEMENTS:
        for v in CC_VERSIONS:
            label = "cc-" + e.replace(" ", "-") + "-" + v.replace(" ", ".")
            long = " ".join(names[x] for x in e.split())
            add(label, "spdx", f"spdx license identifier cc {e} {v}", TAG)
            add(label, "creativecommons", f"creativecommons org licenses {e} {v}", URL)
            add(label, "cc", f"{UNDER}cc {e} {v}", NOTICE)
            add(label, "cc", f"cc {e} {v}", TITLE)
            add(label, "creative", f"creative commons {long} {v}", TITLE)
    for label, _, _, spdx, _ in LICENCES:
        if spdx in SECOND:
            add(label, "spdx", f"spdx license identifier {ANY_FEW}or|and {spdx}", TAG)
            add(label, "apache", f"apache 2 0 or {spdx}", TITLE)
    for label, keyword, words, priority in WORDINGS:
        add(label, keyword, words, priority, words in BASE_PHRASES)
    return out


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lower_words(text: Column) -> Column:
    """The words of a text in lower case with two spaces between them; empty without words."""
    return F.trim(F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), SEPARATORS, "  "))


def required(pattern: str) -> list[str]:
    """The words that every match of a rule's pattern contains: those outside of its groups."""
    fixed = re.sub(r"\(\?:(?:[^()]|\(\?:[^()]*\)\??)*\)\??", " ", pattern)
    return sorted({w for w in fixed.split() if re.fullmatch("[a-z0-9]+", w)})


def _count(fragment: Column) -> Column:
    """Words in a fragment that is cut at word borders."""
    return ((F.length(fragment) - F.length(F.replace(fragment, F.lit(" "), F.lit("")))) / 2).cast("long")


def rule_table(spark: SparkSession) -> DataFrame:
    rows = [(*r, required(r[3])) for r in rules()]
    return spark.createDataFrame(rows, "rule int, label string, keyword string, pattern string, priority int, weight double, base boolean, required array<string>")


def detections(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, body, n_words, and for each match rule, label, priority, weight, base, start, end (words), kept.

    A document without a match has one row with nulls. body (a hash of the text) tells rows apart that share an id.
    """
    table = rule_table(docs.sparkSession)
    gate = F.array(*(F.lit(k) for k in sorted({r[2].strip() for r in rules()})))
    vocabulary = F.array(*(F.lit(k) for k in sorted({w for r in rules() for w in (r[2].strip(), *required(r[3]))})))
    plain = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("body"), lower_words(F.col(text_col)).alias("t"))
    words = plain.select("doc_id", "body", F.when(F.col("t") == "", "").otherwise(F.concat(F.lit(" "), "t", F.lit(" "))).alias("s"), F.when(F.col("t") != "", F.split("t", "  ")).otherwise(F.array().cast("array<string>")).alias("w"))
    # a text's words are looked up once: it meets the keywords among them, and of their rules those whose words it has
    known = words.select("doc_id", "body", "s", F.size("w").cast("long").alias("n_words"), F.array_intersect(vocabulary, F.col("w")).alias("known"))
    met = known.select("doc_id", "body", "n_words", "s", "known", F.explode_outer(F.array_intersect(F.col("known"), gate)).alias("word")).withColumn("keyword", F.concat(F.lit(" "), "word", F.lit(" ")))
    possible = (met["keyword"] == table["keyword"]) & (F.size(F.array_except(table["required"], met["known"])) == 0)
    tried = met.join(F.broadcast(table), possible, "left")  # the rule table has a fixed size
    # most rules of a keyword match nothing: only where one matches is the text cut into gaps
    tried = tried.withColumn("hit", F.regexp_extract_all("s", "pattern", F.lit(0)))
    hits = F.when(F.size("hit") > 0, F.arrays_zip(F.col("hit"), F.split("s", F.col("pattern"), -1).alias("gap")))
    found = tried.select("doc_id", "body", "n_words", "rule", "label", "priority", "weight", "base", F.posexplode_outer(hits).alias("nth", "m"))
    # the gap after a rule's last hit stands alone; of rules without a hit one empty row must stay for each document
    found = found.select("*", _count(F.col("m.gap")).alias("gap"), _count(F.col("m.hit")).alias("size")).drop("m")
    found = found.withColumns({c: F.when(F.col("size").isNotNull(), F.col(c)) for c in ("rule", "label", "priority", "weight", "base", "nth", "gap")})
    found = found.repartition("doc_id", "body").dropDuplicates(["doc_id", "body", "rule", "nth"])
    before = W.partitionBy("doc_id", "body", "rule").orderBy("nth")
    end = F.sum(F.col("gap") + F.col("size")).over(before)
    found = found.withColumn("end", end).withColumn("start", F.col("end") - F.col("size"))
    # an interval before this one in this order contains it if it ends no earlier
    outer = W.partitionBy("doc_id", "body").orderBy("start", F.col("end").desc(), "priority", "rule").rowsBetween(W.unboundedPreceding, -1)
    reach = F.array(*(F.max(F.when(F.col("priority") <= p, F.col("end"))).over(outer) for p in range(SHORT + 1)))
    return found.withColumn("reach", reach).select(
        "doc_id", "body", "n_words", "rule", "label", "priority", "weight", "base", "start", "end", (F.coalesce(F.get("reach", F.col("priority")), F.lit(-1)) < F.col("end")).alias("kept"),
    )


def scan_licenses(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z. n_base counts every place of a base
    phrase, first_word and last_word are the smallest and largest of these places (null without one). labels are
    those of the base rules and of the matches that are not suppressed; score is the largest weight among the latter,
    0 without any. Null and empty texts have no words. Rows equal in identifier and text are one document; an
    identifier with several texts gives a row for each. Null identifiers are kept. Other columns are not read.
    """
    labels = lambda when: F.array_join(F.array_sort(F.collect_set(F.when(when, F.col("label")))), ",")
    base = F.col("base")
    found = detections(docs, id_col=id_col, text_col=text_col).groupBy("doc_id", "body", "n_words")
    return found.agg(
        F.count(F.when(base, 1)).alias("n_base"),
        F.min(F.when(base, F.col("start"))).alias("first_word"),
        F.max(F.when(base, F.col("start"))).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(base | F.col("kept")).alias("labels"),
        F.coalesce(F.max(F.when(F.col("kept"), F.col("weight"))), F.lit(0.0)).alias("score"),
    ).drop("body")


def oracle_sql() -> str:
    """The same scan as DuckDB SQL."""
    table = ", ".join(f"({n}, '{label}', '{keyword}', '{p}', {priority}, {weight}, {base})" for n, label, keyword, p, priority, weight, base in rules())
    reach = ", ".join(f"max(CASE WHEN priority <= {p} THEN stop END) OVER o" for p in range(SHORT + 1))
    return f"""
        WITH rules(rule, label, keyword, pattern, priority, weight, base) AS (VALUES {table}),
        raw AS (SELECT doc_id, trim(regexp_replace(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{SEPARATORS}', '  ', 'g'), ' ') AS t FROM documents),
        words AS (SELECT doc_id, CASE WHEN t = '' THEN '' ELSE ' ' || t || ' ' END AS s FROM raw),
        sized AS (SELECT doc_id, s, CAST((length(s) - length(replace(s, ' ', ''))) / 2 AS BIGINT) AS n_words FROM words),
        tried AS (SELECT doc_id, rule, label, priority, weight, base, regexp_extract_all(s, pattern) AS h, regexp_split_to_array(s, pattern) AS g
                  FROM sized JOIN rules ON contains(s, keyword) WHERE regexp_matches(s, pattern)),
        hits AS (SELECT doc_id, rule, label, priority, weight, base, unnest(h) AS hit, unnest(g[1:len(h)]) AS gap, generate_subscripts(h, 1) AS nth FROM tried),
        counted AS (SELECT *, (length(hit) - length(replace(hit, ' ', ''))) / 2 AS size, (length(gap) - length(replace(gap, ' ', ''))) / 2 AS free FROM hits),
        ends AS (SELECT *, CAST(sum(free + size) OVER (PARTITION BY doc_id, rule ORDER BY nth) AS BIGINT) AS stop FROM counted),
        places AS (SELECT *, CAST(stop - size AS BIGINT) AS start FROM ends),
        reached AS (SELECT *, [{reach}] AS reach FROM places
                    WINDOW o AS (PARTITION BY doc_id ORDER BY start, stop DESC, priority, rule ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        judged AS (SELECT *, coalesce(reach[priority + 1], -1) < stop AS kept FROM reached),
        summed AS (SELECT doc_id, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
                   string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels,
                   string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base OR kept) AS labels, max(weight) FILTER (kept) AS score FROM judged GROUP BY doc_id)
        SELECT doc_id, n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
               coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
        FROM sized LEFT JOIN summed USING (doc_id)
    """
