"""License scans by ordered signature rules behind a keyword prefilter."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterable
from functools import lru_cache
from typing import NamedTuple

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The base phrases and their labels.
BASE = ((b"mit license", "mit"), (b"apache license", "apache"), (b"general public license", "gpl"))

# Families: label, keywords of which a text must hold one, name as an expression over words that are parted by single spaces.
_V = rb"(?: version)?(?: v)? ?"
FAMILIES: tuple[tuple[str, tuple[str, ...], bytes], ...] = (
    ("mit", ("mit", "expat", "x11"), rb"(?:mit|expat|x11)"),
    ("apache-1.1", ("apache",), rb"apache(?: software)?(?: license| licence)?" + _V + rb"1 1"),
    ("apache-2.0", ("apache",), rb"apache(?: software)?(?: license| licence)?" + _V + rb"2(?: 0)?"),
    ("gpl-2.0", ("gpl", "public license", "public licence"), rb"(?:gnu )?(?:general public (?:license|licence)|gpl)" + _V + rb"2(?: 0)?"),
    ("gpl-3.0", ("gpl", "public license", "public licence"), rb"(?:gnu )?(?:general public (?:license|licence)|gpl)" + _V + rb"3(?: 0)?"),
    ("gpl", ("gpl", "public license", "public licence"), rb"(?:gnu (?:general public (?:license|licence)|gpl)|gpl)"),
    ("lgpl-2.1", ("lgpl", "public license", "public licence"), rb"(?:gnu )?(?:lesser general public (?:license|licence)|lgpl)" + _V + rb"2 1"),
    ("lgpl-3.0", ("lgpl", "public license", "public licence"), rb"(?:gnu )?(?:lesser general public (?:license|licence)|lgpl)" + _V + rb"3(?: 0)?"),
    ("lgpl", ("lgpl", "public license", "public licence"), rb"(?:gnu )?(?:lesser general public (?:license|licence)|lgpl)"),
    ("agpl-3.0", ("agpl", "public license", "public licence"), rb"(?:gnu )?(?:affero general public (?:license|licence)|agpl)(?:" + _V + rb"3(?: 0)?)?"),
    ("fdl", ("documentation license", "fdl"), rb"gnu (?:free documentation license|fdl)"),
    ("bsd-2-clause", ("bsd",), rb"(?:2 clause|simplified) bsd|bsd 2 clause"),
    ("bsd-3-clause", ("bsd",), rb"(?:3 clause|new|modified|revised) bsd|bsd 3 clause"),
    ("bsd", ("bsd",), rb"bsd"),
    ("mpl-1.1", ("mpl", "public license", "public licence"), rb"(?:mozilla public (?:license|licence)|mpl)" + _V + rb"1 1"),
    ("mpl-2.0", ("mpl", "public license", "public licence"), rb"(?:mozilla public (?:license|licence)|mpl)" + _V + rb"2(?: 0)?"),
    ("epl-1.0", ("epl", "public license", "public licence"), rb"(?:eclipse public (?:license|licence)|epl)" + _V + rb"1(?: 0)?"),
    ("epl-2.0", ("epl", "public license", "public licence"), rb"(?:eclipse public (?:license|licence)|epl)" + _V + rb"2(?: 0)?"),
    ("cddl-1.0", ("cddl", "distribution license", "distribution licence"), rb"(?:common development and distribution (?:license|licence)|cddl)(?:" + _V + rb"1(?: 0)?)?"),
    ("isc", ("isc",), rb"isc"),
    ("zlib", ("zlib",), rb"zlib(?: libpng)?"),
    ("unlicense", ("unlicense",), rb"unlicense"),
    ("wtfpl", ("wtfpl",), rb"wtfpl"),
    ("artistic-2.0", ("artistic",), rb"(?:perl )?artistic(?: license)?(?:" + _V + rb"2(?: 0)?)?"),
    ("boost-1.0", ("boost",), rb"boost(?: software)?(?: license)?(?:" + _V + rb"1(?: 0)?)?"),
    ("python-2.0", ("python",), rb"python(?: software foundation)?"),
    ("ofl-1.1", ("ofl", "font license", "font licence"), rb"(?:sil )?(?:open font (?:license|licence)|ofl)(?:" + _V + rb"1 1)?"),
    ("eupl-1.2", ("eupl", "public license", "public licence"), rb"(?:european union public (?:license|licence)|eupl)(?:" + _V + rb"1 2)?"),
    ("openssl", ("openssl",), rb"openssl"),
    ("postgresql", ("postgresql",), rb"postgresql"),
    ("cc0-1.0", ("cc0", "commons zero"), rb"(?:cc0|creative commons zero)(?: 1 0)?"),
)
#: Creative Commons licenses are families too, by part and version.
CC_PARTS = ("by", "by sa", "by nc", "by nd", "by nc sa", "by nc nd")
CC_VERSIONS = ("2 0", "2 5", "3 0", "4 0")
_CC_WORDS = {"by": "attribution", "sa": "share ?alike", "nc": "non ?commercial", "nd": "no ?deriv(?:ative)?s?"}

# Templates: expression around a family's name, priority (lower goes first) and what a match is worth.
TEMPLATES: tuple[tuple[bytes, int, float], ...] = (
    (rb"spdx license identifier %s", 0, 0.99),
    (rb"(?:this|the) (?:work|software|program|file|project|library|code|document) is (?:licensed|released|distributed) under(?: the)?(?: terms of(?: the)?)? %s(?: license| licence)?", 1, 0.97),
    (rb"(?:dual )?licen[sc]ed under(?: the)?(?: terms of(?: the)?)? %s(?: license| licence)?", 2, 0.95),
    (rb"(?:released|distributed|available|provided|published) under(?: the)?(?: terms of(?: the)?)? %s(?: license| licence)?", 3, 0.9),
    (rb"(?:governed by|subject to|according to)(?: the)?(?: terms(?: and conditions)? of(?: the)?)? %s(?: license| licence)?", 4, 0.85),
    (rb"licen[sc]e(?: is)?(?: the)? %s", 5, 0.8),
    (rb"%s licen[sc]e", 6, 0.6),
)


# Passages of license texts, notices and names, in words parted by single spaces, lower-cased. Each line is a label,
# keywords, parted by |, of which every match holds one, the expression, its priority (lower goes first) and what a match is worth.
_BODY, _NOTICE, _NAME, _HINT = 0, 1, 5, 7
SIGNATURES: tuple[tuple[str, str, str, int, float], ...] = (
    # MIT and its kin
    ("mit", "hereby granted", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files(?: the software)?(?: to deal in the software without restriction)?", _BODY, 0.98),
    ("mit", "permission notice", "(?:the above|this) copyright notice and this permission notice(?: including the next paragraph)? shall be included in all copies or substantial portions of the software", _BODY, 0.95),
    ("mit", "hereby granted", "permission is hereby granted free of charge to any person obtaining a copy", _NOTICE, 0.9),
    ("mit", "sublicense", "use copy modify merge publish distribute sublicense and or sell copies of the software", _BODY, 0.95),
    ("mit", "sublicense", "use copy modify merge publish distribute sublicense and or sell", _NOTICE, 0.9),
    ("mit|expat|x11", "mit", "(?:the )?(?:mit|expat|x11) style licen[sc]e", _NAME, 0.7),
    ("mit", "opensource", "(?:https? )?(?:www )?opensource org licenses? mit(?: license)?(?: php| html)?", _NOTICE, 0.9),
    ("mit-0", "mit", "mit no attribution(?: license)?", _NAME, 0.9),
    ("x11", "x consortium", "the name of the x consortium shall not be used in advertising", _BODY, 0.95),
    ("ntp", "purpose", "permission to use copy modify and distribute this software and its documentation for any purpose(?: and)? with(?: or with)?out fee is hereby granted", _BODY, 0.9),
    # Apache
    ("apache-2.0", "apache", "licensed under the apache license version 2 0(?: the license)? you may not use this file except in compliance with the license", _BODY, 0.99),
    ("apache-2.0", "apache", "you may obtain a copy of the license at (?:https? )?(?:www )?apache org licenses license 2 0", _BODY, 0.98),
    ("apache-2.0", "as is", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind", _BODY, 0.95),
    ("apache-2.0", "apache", "apache license version 2 0 january 2004", _BODY, 0.98),
    ("apache-2.0", "irrevocable", "each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable (?:copyright|except as stated in this section patent) license", _BODY, 0.95),
    ("apache-2.0", "apache", "(?:https? )?(?:www )?apache org licenses license 2 0(?: txt| html)?", _NOTICE, 0.9),
    ("apache-1.1", "apache", "this product includes software developed by the apache software foundation", _BODY, 0.9),
    ("apache-1.1", "apache", "the names? apache(?: server)?(?: and)?(?: apache)? (?:software foundation|group) must not be used to endorse or promote products", _BODY, 0.95),
    ("apache-1.0", "apache", "this product includes software developed by the apache group for use in the apache http server project", _BODY, 0.95),
    ("apache", "asf", "licensed to the apache software foundation asf under one or more contributor license agreements", _BODY, 0.9),
    # GPL
    ("gpl-2.0", "general public license", "gnu general public license version 2 june 1991", _BODY, 0.98),
    ("gpl-3.0", "general public license", "gnu general public license version 3 29 june 2007", _BODY, 0.98),
    ("gpl-2.0-or-later", "general public license", "under the terms of the gnu general public license as published by the free software foundation either version 2(?: of the license)? or (?:at your option )?any later version", _BODY, 0.98),
    ("gpl-3.0-or-later", "general public license", "under the terms of the gnu general public license as published by the free software foundation either version 3(?: of the license)? or (?:at your option )?any later version", _BODY, 0.98),
    ("gpl-2.0", "general public license", "under the terms of the gnu general public license(?: version 2)? as published by the free software foundation(?: version 2)?(?: of the license)?", _NOTICE, 0.85),
    ("gpl", "general public license", "you should have received a copy of the gnu general public license along with this (?:program|library|software|file)(?: if not)?", _BODY, 0.9),
    ("gpl", "general public license", "without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details", _BODY, 0.9),
    ("gpl", "redistribute", "this is free software and you are welcome to redistribute it under certain conditions", _NOTICE, 0.8),
    ("gpl", "licenses", "the licenses for most software(?: and other practical works)? are designed to take away your freedom to share and change", _BODY, 0.9),
    ("gpl", "gnu", "(?:https? )?(?:www )?gnu org (?:copyleft|licenses) gpl(?: html| txt)?", _NOTICE, 0.85),
    ("gpl-2.0", "gnu", "(?:https? )?(?:www )?gnu org licenses(?: old licenses)? gpl 2 0(?: en)?(?: html| txt)?", _NOTICE, 0.9),
    ("gpl-3.0", "gnu", "(?:https? )?(?:www )?gnu org licenses gpl 3 0(?: en)?(?: html| txt)?", _NOTICE, 0.9),
    ("gpl-with-classpath-exception", "independent modules", "gives? you permission to link this library with independent modules to produce an executable regardless of the license terms of these independent modules", _BODY, 0.95),
    ("gpl-with-gcc-exception", "gcc", "(?:under section 7 of gpl version 3 you are granted additional permissions described in the gcc runtime library exception|gcc runtime library exception)", _BODY, 0.95),
    ("gpl-2.0-or-later", "gpl", "gpl(?: license)?(?: version| v)? ?2(?: 0)? or (?:any )?later(?: version)?", _NOTICE, 0.85),
    ("gpl-3.0-or-later", "gpl", "gpl(?: license)?(?: version| v)? ?3(?: 0)? or (?:any )?later(?: version)?", _NOTICE, 0.85),
    ("gpl-2.0", "gplv2", "gplv2(?: only)?", _NAME, 0.8),
    ("gpl-3.0", "gplv3", "gplv3(?: only)?", _NAME, 0.8),
    # LGPL and AGPL
    ("lgpl-2.0", "library general public license", "gnu library general public license version 2 june 1991", _BODY, 0.98),
    ("lgpl-2.1", "lesser general public license", "gnu lesser general public license version 2 1 february 1999", _BODY, 0.98),
    ("lgpl-3.0", "lesser general public license", "gnu lesser general public license version 3 29 june 2007", _BODY, 0.98),
    ("lgpl-2.0-or-later", "library general public license", "under the terms of the gnu library general public license as published by the free software foundation either version 2(?: of the license)? or (?:at your option )?any later version", _BODY, 0.98),
    ("lgpl-2.1-or-later", "lesser general public license", "under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1(?: of the license)? or (?:at your option )?any later version", _BODY, 0.98),
    ("lgpl-3.0-or-later", "lesser general public license", "under the terms of the gnu lesser general public license as published by the free software foundation either version 3(?: of the license)? or (?:at your option )?any later version", _BODY, 0.98),
    ("lgpl", "lesser general public license", "you should have received a copy of the gnu lesser general public license along with this (?:program|library|software|file)", _BODY, 0.9),
    ("lgpl-2.0", "library general public", "gnu library general public licen[sc]e(?: version 2)?", _NAME, 0.8),
    ("lgpl", "gnu", "(?:https? )?(?:www )?gnu org (?:copyleft|licenses) (?:lesser|lgpl)(?: html| txt)?", _NOTICE, 0.85),
    ("agpl-3.0", "affero", "gnu affero general public license version 3 19 november 2007", _BODY, 0.98),
    ("agpl-3.0-or-later", "affero", "under the terms of the gnu affero general public license as published by the free software foundation either version 3(?: of the license)? or (?:at your option )?any later version", _BODY, 0.98),
    ("agpl-3.0", "affero", "you should have received a copy of the gnu affero general public license along with this (?:program|library|software|file)", _BODY, 0.9),
    ("agpl-3.0", "network", "your modified version must prominently offer all users interacting with it remotely through a computer network", _BODY, 0.95),
    ("fdl", "documentation license", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license", _BODY, 0.97),
    ("fdl", "invariant sections", "with no invariant sections no front cover texts and no back cover texts", _BODY, 0.9),
    # BSD and its kin
    ("bsd", "redistribution", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", _BODY, 0.95),
    ("bsd", "redistribution", "redistribution and use in source and binary forms with or without modification", _NOTICE, 0.9),
    ("bsd", "redistributions", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", _BODY, 0.93),
    ("bsd", "redistributions", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", _BODY, 0.93),
    ("bsd-3-clause", "endorse", "neither the names? of (?:the )?(?:[^ ]+ ){0,12}?nor the names of (?:its|their|any|the) (?:[^ ]+ ){0,4}?may be used to endorse or promote products derived from this software without specific prior written permission", _BODY, 0.97),
    ("bsd-3-clause", "endorse", "the names? of (?:the )?(?:[^ ]+ ){0,8}?may not be used to endorse or promote products derived from this software without specific prior written permission", _BODY, 0.93),
    ("bsd-4-clause", "advertising", "all advertising materials mentioning features or use of this software must display the following acknowledge?ment", _BODY, 0.97),
    ("bsd-3-clause-clear", "patent", "no express or implied licenses to any party s patent rights are granted by this license", _BODY, 0.95),
    ("bsd", "contributors", "this software is provided by (?:the )?(?:[^ ]+ ){0,10}?contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed", _BODY, 0.85),
    ("bsd", "bsd", "bsd style licen[sc]e", _NAME, 0.7),
    ("bsd-2-clause", "freebsd", "(?:the )?freebsd licen[sc]e", _NAME, 0.8),
    ("bsd|0bsd", "0bsd", "(?:zero clause bsd|bsd zero clause|0bsd)(?: licen[sc]e)?", _NAME, 0.85),
    ("bsd", "opensource", "(?:https? )?(?:www )?opensource org licenses? bsd license(?: php| html)?", _NOTICE, 0.85),
    ("bsd-2-clause", "opensource", "(?:https? )?(?:www )?opensource org licenses? bsd 2 clause", _NOTICE, 0.9),
    ("bsd-3-clause", "opensource", "(?:https? )?(?:www )?opensource org licenses? bsd 3 clause", _NOTICE, 0.9),
    ("isc", "purpose", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", _BODY, 0.95),
    ("isc", "author", "the software is provided as is and the author disclaims all warranties with regard to this software", _BODY, 0.9),
    ("consortium", "isc", "internet (?:software|systems) consortium licen[sc]e", _NAME, 0.8),
    # Mozilla, Eclipse and other shared licenses
    ("mpl-2.0", "mozilla", "this source code form is subject to the terms of the mozilla public license v(?:ersion)? ?2 0", _BODY, 0.99),
    ("mpl-2.0", "mpl", "if a copy of the mpl was not distributed with this file you can obtain one at (?:https? )?(?:www )?mozilla org mpl 2 0", _BODY, 0.97),
    ("mpl-1.1", "mozilla", "the contents of this file are subject to the mozilla public license version 1 1", _BODY, 0.98),
    ("mpl-1.0", "mozilla", "the contents of this file are subject to the mozilla public license version 1 0", _BODY, 0.98),
    ("mpl", "mozilla", "(?:https? )?(?:www )?mozilla org mpl", _NOTICE, 0.8),
    ("mpl-1.1-tri", "mpl", "begin license block version mpl 1 1 gpl 2 0 lgpl 2 1", _BODY, 0.97),
    ("epl-1.0", "eclipse", "this program and the accompanying materials are made available under the terms of the eclipse public license v(?:ersion)? ?1 0", _BODY, 0.98),
    ("epl-2.0", "eclipse", "this program and the accompanying materials are made available under the terms of the eclipse public license v?(?:ersion)? ?2 0", _BODY, 0.98),
    ("epl-2.0", "eclipse", "(?:https? )?(?:www )?eclipse org legal epl 2 0", _NOTICE, 0.9),
    ("epl-1.0", "eclipse", "(?:https? )?(?:www )?eclipse org legal epl v10(?: html)?", _NOTICE, 0.9),
    ("edl-1.0", "eclipse", "eclipse distribution license(?: v)? ?1 0", _NAME, 0.9),
    ("cpl-1.0", "common public license", "common public license(?: version| v)? ?1 0", _NAME, 0.9),
    ("ipl-1.0", "ibm", "ibm public license(?: version| v)? ?1 0", _NAME, 0.9),
    ("cddl-1.0", "distribution license", "the contents of this file are subject to the terms of the common development and distribution license", _BODY, 0.97),
    ("cddl-1.1", "cddl", "common development and distribution license cddl version 1 1", _NAME, 0.9),
    ("eupl-1.1", "eupl", "licensed under the eupl version 1 1", _BODY, 0.97),
    ("eupl-1.2", "eupl", "licensed under the eupl(?: version 1 2)?", _NOTICE, 0.9),
    ("osl-3.0", "open software license", "(?:licensed under the )?open software license(?: version| v)? ?3 0", _NAME, 0.9),
    ("afl-3.0", "academic free license", "(?:licensed under the )?academic free license(?: version| v)? ?3 0", _NAME, 0.9),
    ("ms-pl", "microsoft", "microsoft public license(?: ms pl)?", _NAME, 0.9),
    ("ms-rl", "microsoft", "microsoft reciprocal license(?: ms rl)?", _NAME, 0.9),
    ("qpl-1.0", "q public license", "(?:the )?q public license(?: version)?(?: 1 0)?", _NAME, 0.9),
    ("sleepycat", "sleepycat", "sleepycat (?:software )?licen[sc]e", _NAME, 0.85),
    ("lppl-1.3c", "latex", "distributed and or modified under the conditions of the latex project public license", _BODY, 0.97),
    ("lppl", "latex", "latex project public licen[sc]e", _NAME, 0.85),
    # permissive texts of single projects
    ("zlib", "misrepresented", "the origin of this software must not be misrepresented you must not claim that you wrote the original software", _BODY, 0.97),
    ("zlib", "altered", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software", _BODY, 0.95),
    ("zlib", "freely", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely", _BODY, 0.95),
    ("boost-1.0", "boost", "distributed under the boost software license version 1 0", _BODY, 0.98),
    ("boost-1.0", "hereby granted", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", _BODY, 0.97),
    ("boost-1.0", "boost", "(?:https? )?(?:www )?boost org license 1 0 txt", _NOTICE, 0.9),
    ("python-2.0", "psf", "psf hereby grants licensee a nonexclusive royalty free world wide license", _BODY, 0.97),
    ("python-2.0", "python", "python software foundation license(?: version 2)?", _NAME, 0.9),
    ("openssl", "openssl", "this product includes software developed by the openssl project for use in the openssl toolkit", _BODY, 0.97),
    ("ssleay", "cryptographic", "this product includes cryptographic software written by eric young", _BODY, 0.95),
    ("postgresql", "documentation", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted", _BODY, 0.96),
    ("php-3.01", "php", "this source file is subject to version 3 0?1 of the php license", _BODY, 0.97),
    ("php-3.01", "php", "php license(?: version| v)? ?3 01", _NAME, 0.9),
    ("ruby", "ruby", "(?:distributed|licensed) under the (?:same )?terms (?:as|of) ruby(?: s licen[sc]e)?", _NOTICE, 0.85),
    ("artistic-1.0", "package", "the intent of this document is to state the conditions under which a package may be copied", _BODY, 0.9),
    ("artistic-1.0-perl", "perl", "(?:you may|can) redistribute it and or modify it under the same terms as perl(?: itself)?", _BODY, 0.93),
    ("artistic-2.0", "artistic", "the artistic license 2 0", _NAME, 0.9),
    ("w3c", "w3c", "(?:w3c software (?:notice and )?license|w3c software and document license)", _NAME, 0.9),
    ("icu", "icu", "icu license icu 1 8 1 and later", _NAME, 0.9),
    ("unicode", "unicode", "unicode(?: inc)? license agreement data files and software", _NAME, 0.93),
    ("curl", "curl", "(?:the )?curl licen[sc]e", _NAME, 0.7),
    ("libpng", "libpng", "libpng licen[sc]e(?: version 2)?", _NAME, 0.85),
    ("libtiff", "libtiff", "libtiff licen[sc]e", _NAME, 0.85),
    ("ijg", "jpeg", "this software is based in part on the work of the independent jpeg group", _BODY, 0.95),
    ("freetype", "freetype", "(?:the )?freetype (?:project )?licen[sc]e", _NAME, 0.88),
    ("info-zip", "info", "info zip licen[sc]e", _NAME, 0.85),
    ("ofl-1.1", "font", "this font software is licensed under the sil open font license version 1 1", _BODY, 0.98),
    ("ofl-1.1", "fonts", "the fonts and derivatives however cannot be released under any other type of license", _BODY, 0.93),
    ("json", "good", "the software shall be used for good not evil", _BODY, 0.95),
    ("beerware", "beer", "(?:you can buy me a beer in return|the beer ware license|beerware licen[sc]e)", _BODY, 0.93),
    ("wtfpl", "want", "do what the fuck you want to(?: public license)?", _BODY, 0.97),
    ("unlicense", "public domain", "this is free and unencumbered software released into the public domain", _BODY, 0.98),
    ("unlicense", "unlicense", "(?:https? )?(?:www )?unlicense org", _NOTICE, 0.9),
    ("cc0-1.0", "waived", "(?:to the extent possible under law )?(?:[^ ]+ ){0,8}?has waived all copyright and related or neighboring rights to", _BODY, 0.97),
    ("cc0-1.0", "publicdomain", "(?:https? )?(?:www )?creativecommons org publicdomain zero 1 0", _NOTICE, 0.95),
    ("cc-pdm-1.0", "publicdomain", "(?:https? )?(?:www )?creativecommons org publicdomain mark 1 0", _NOTICE, 0.95),
    ("public-domain", "public domain", "(?:dedicated to|released into|released to|placed in|is in) the public domain", _NOTICE, 0.9),
    ("public-domain", "copyright", "(?:the )?author(?:s)? disclaims? copyright to this source code", _BODY, 0.9),
    ("forgiveness", "blessing", "may you do good and not evil may you find forgiveness for yourself and forgive others", _BODY, 0.97),
    # data, content and model licenses
    ("odbl-1.0", "database license", "open (?:data commons open )?database license(?: odbl)?(?: v?1 0)?", _NAME, 0.92),
    ("odc-by-1.0", "attribution license", "open data commons attribution license(?: odc by)?(?: v?1 0)?", _NAME, 0.92),
    ("pddl-1.0", "public domain dedication", "public domain dedication and license(?: pddl)?(?: v?1 0)?", _NAME, 0.92),
    ("ogl-uk-3.0", "open government", "(?:contains public sector information licensed under the )?open government licen[sc]e v?(?:ersion )?3 0", _NAME, 0.93),
    ("etalab-2.0", "licence ouverte", "licence ouverte(?: open licence)?(?: version)? 2 0", _NAME, 0.92),
    ("dl-de-by-2.0", "datenlizenz", "datenlizenz deutschland namensnennung version 2 0", _NAME, 0.92),
    ("openrail|rail|rail m", "openrail", "(?:creativeml |bigscience |bigcode )?open ?rail(?: m)?(?: licen[sc]e)?", _NAME, 0.85),
    ("llama", "llama", "llama(?: 2| 3)? community license(?: agreement)?", _NAME, 0.9),
    ("cc", "creative commons", "this work is licensed under a creative commons licen[sc]e", _NOTICE, 0.7),
    ("cc-by-sa", "creative commons", "creative commons attribution share ?alike licen[sc]e", _NAME, 0.8),
    ("cc-by", "creative commons", "creative commons attribution licen[sc]e", _NAME, 0.8),
    # source-available licenses
    ("sspl-1.0", "server side public license", "server side public license(?: version| v)? ?1?", _NAME, 0.93),
    ("bsl-1.1", "business source license", "business source license(?: version)? 1 1", _NAME, 0.93),
    ("elastic-2.0", "elastic license", "elastic license(?: version)? 2 0", _NAME, 0.93),
    ("polyform", "polyform", "polyform (?:noncommercial|small business|strict|shield|internal use|free trial) license(?: version)?(?: 1 0 0)?", _NAME, 0.93),
    ("commons-clause", "commons clause", "commons clause licen[sc]e condition(?: v?1 0)?", _NAME, 0.93),
    ("prosperity", "prosperity", "prosperity public license(?: 3 0 0)?", _NAME, 0.93),
    # what isn't open
    ("proprietary", "proprietary", "(?:proprietary and confidential|confidential and proprietary)", _HINT, 0.7),
    ("proprietary", "prohibited", "unauthorized (?:copying|reproduction|use|disclosure) of this (?:file|document|software) via any medium is strictly prohibited", _BODY, 0.9),
    ("proprietary", "unpublished", "this is unpublished proprietary source code of", _BODY, 0.9),
    ("proprietary", "license agreement", "end user license agreement", _HINT, 0.6),
    ("proprietary", "you agree", "by (?:installing|downloading|using|copying) (?:or (?:installing|downloading|using|copying) )?(?:this|the) software you agree to be bound by the terms of this(?: license)? agreement", _BODY, 0.85),
    ("non-commercial", "commercial", "(?:for )?non ?commercial use only", _HINT, 0.6),
    ("evaluation", "evaluation", "licensed for evaluation (?:purposes|use) only", _HINT, 0.7),
    ("all-rights-reserved", "rights reserved", "all rights reserved", 8, 0.5),
    ("multi-licensed", "licensed|licenced", "(?:dual|tri|multi) licen[sc]ed", 8, 0.5),
)


class Rule(NamedTuple):
    label: str
    keywords: tuple[str, ...]
    pattern: re.Pattern
    priority: int
    worth: float


@lru_cache(maxsize=1)
def rules() -> tuple[Rule, ...]:
    """Every family in every template, ordered by priority; within one priority longer names go first."""
    families = list(FAMILIES)
    for part in CC_PARTS:
        named = " ".join(_CC_WORDS[p] for p in part.split())
        for version in CC_VERSIONS:
            name = f"(?:cc|creative commons) (?:{part}|{named})(?: (?:international|generic|unported))? {version}(?: international)?"
            families.append((f"cc-{part.replace(' ', '-')}-{version.replace(' ', '.')}", ("cc", "creative commons"), name.encode()))
    out = [Rule(label, key, re.compile(rb"(?<![^ ])" + frame.replace(b"%s", b"(?:" + name + b")") + rb"(?![^ ])"), p, w) for label, key, name in families for frame, p, w in TEMPLATES]
    whole = lambda e: re.compile(rb"(?<![^ ])" + e.encode() + rb"(?![^ ])")
    out += [Rule(label, tuple(key.split("|")), whole(e), p, w) for label, key, e, p, w in SIGNATURES]
    return tuple(sorted(out, key=lambda r: (r.priority, -len(r.pattern.pattern))))


#: A match lies within so many bytes of each keyword in it.
_REACH = 400


@lru_cache(maxsize=1)
def _keywords() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for name in sorted({k for r in rules() for k in r.keywords}):
        found.add_word(f" {name} ", name)
    found.make_automaton()  # base phrases have no keyword: they are looked for on their own
    return found


@lru_cache(maxsize=1)
def _by_keyword() -> dict[str, list[Rule]]:
    out: dict[str, list[Rule]] = {}
    for rule in rules():
        for k in rule.keywords:
            out.setdefault(k, []).append(rule)
    return out


def _called(near: Iterable[str]) -> Iterable[Rule]:
    """The rules of which a keyword was met."""
    return {id(r): r for k in near for r in _by_keyword()[k]}.values()


#: Bytes outside words become spaces and A-Z become a-z.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else 32 if b <= 0x2F or 0x3A <= b <= 0x60 or 0x7B <= b <= 0x7F else b for b in range(256))


def _standing(hits: list[tuple[int, int, Rule]]) -> list[tuple[int, int, Rule]]:
    """``hits`` without those that lie inside one that goes before them, in their order.

    The stretches kept so far are held by their starts without those inside others, so that their ends rise too: of those
    that start no later than a hit the last one ends last.
    """
    starts: list[int] = []
    ends: list[int] = []
    kept = []
    for a, b, rule in hits:
        k = bisect_right(starts, a)
        if k and ends[k - 1] >= b:
            continue
        kept.append((a, b, rule))
        lo = bisect_left(starts, a)
        hi = bisect_right(ends, b)  # stretches from lo on to hi lie inside the new one
        starts[lo : max(lo, hi)], ends[lo : max(lo, hi)] = [a], [b]
    return kept


class Scan(NamedTuple):
    n_words: int
    n_base: int
    first_word: int | None
    last_word: int | None
    base_labels: str
    labels: str
    score: float
    spans: list[tuple[str, int, int]]


def scan(text: str | None) -> Scan:
    """The scan of one whole text. spans: (label, first word, word behind the last) of detections that stand."""
    words = (text or "").encode("utf-8", "replace").translate(_TABLE).split()
    line = b" " + b" ".join(words) + b" "
    starts: list[int] = []

    def word_at(place: int) -> int:
        """The number of the word that starts at a place: where words start is counted once, for the first that asks."""
        if not starts:
            starts.extend(np.cumsum([1, *map(len, words)]) + np.arange(len(words) + 1))
        return bisect_left(starts, place)

    places, base = [], set()
    for phrase, label in BASE:
        at = line.find(b" " + phrase + b" ")
        while at >= 0:
            places.append(at + 1)
            base.add(label)
            at = line.find(b" " + phrase + b" ", at + 1)
    hits: list[tuple[int, int, Rule]] = []
    near: dict[str, list[tuple[int, int]]] = {}
    for end, name in _keywords().iter(line.decode("latin-1")):  # a character a byte, so that places are those of bytes
        start, stop = max(0, end - _REACH), line.find(b" ", min(len(line) - 1, end + _REACH)) + 1
        held = near.setdefault(name, [])
        if held and start <= held[-1][1]:
            held[-1] = (held[-1][0], stop)
        else:
            held.append((start, stop))
    for rule in _called(near):
        found = {(m.start(), m.end()) for k in rule.keywords for a, b in near.get(k, ()) for m in rule.pattern.finditer(line, a, b)}
        hits += [(a, b, rule) for a, b in found]
    hits.sort(key=lambda h: (h[2].priority, h[0] - h[1], h[0], h[2].label))
    kept = _standing(hits)
    doubt = 1.0
    for _, _, rule in kept:
        doubt *= 1 - rule.worth
    score = max(1 - doubt, 0.5 if places else 0.0)
    first, last = (word_at(min(places)), word_at(max(places))) if places else (None, None)
    spans = [(r.label, word_at(a), word_at(b + 1)) for a, b, r in sorted(kept, key=lambda h: (h[0], h[1]))]
    return Scan(len(words), len(places), first, last, ",".join(sorted(base)), ",".join(sorted(base | {r.label for *_, r in kept})), round(score, 6), spans)


_SCAN = "struct<n_words:long,n_base:long,first_word:long,last_word:long,base_labels:string,labels:string,score:double,spans:array<struct<label:string,start:int,end:int>>>"


def license_scan(text: Column) -> Column:
    """The scan of a text column as a struct (n_words, n_base, first_word, last_word, base_labels, labels, score, spans)."""

    def run(texts: pd.Series) -> pd.DataFrame:
        found = pd.DataFrame([scan(t) for t in texts], columns=list(Scan._fields))
        found["spans"] = [[{"label": k, "start": a, "end": b} for k, a, b in s] for s in found["spans"]]
        return found.astype({"first_word": "Int64", "last_word": "Int64"})

    return F.pandas_udf(run, _SCAN)(text)


def scan_licenses(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans), one row per row of ``docs``.

    Words are the longest runs of a-z, 0-9 and code points above 0x7F once A-Z are lower-cased; phrases and rules match over
    words, whatever stands between these. A null or empty text has no words, no labels (empty strings), null places and score
    0. Null or repeated ids are passed on as they are; other columns are ignored.
    """
    return docs.select(F.col("doc_id"), license_scan(F.col("text")).alias("r")).select("doc_id", "r.*")
