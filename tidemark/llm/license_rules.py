"""The signature rules of the license scan, in order: an earlier rule has priority over a later one.

A rule is (keywords, pattern, label, weight). The keywords are plain words without which the pattern can't match.
In a pattern a space stands for whatever may separate two words (up to 12 characters).
Texts are in lower case (A-Z) when the rules run.
"""

from __future__ import annotations

import re

# Text signatures of licenses, most specific first.
SIGNATURES = [
    (r"permission is hereby granted free of charge to any person obtaining a copy", "mit", 0.99),
    (r"use copy modify merge publish distribute sublicense and or sell copies", "mit", 0.99),
    (r"above copyright notice and this permission notice shall be included in all copies or substantial portions", "mit", 0.95),
    (r"the software is provided as is without warranty of any kind express or implied", "mit", 0.7),
    (r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc", 0.98),
    (r"permission to use copy modify and distribute this software and its documentation for any purpose", "hpnd", 0.9),
    (r"redistribution and use in source and binary forms with or without modification are permitted", "bsd", 0.95),
    (r"neither the name of .{1,120}? may be used to endorse or promote", "bsd-3-clause", 0.97),
    (r"all advertising materials mentioning features or use of this software", "bsd-4-clause", 0.97),
    (r"apache org licenses license 2 0", "apache-2.0", 0.98),
    (r"apache license version 2 0 january 2004", "apache-2.0", 0.99),
    (r"you may not use this file except in compliance with the license", "apache-2.0", 0.8),
    (r"gnu (?:affero )?general public license as published by the free software foundation", "gpl", 0.97),
    (r"gnu (?:lesser|library) general public license as published by the free software foundation", "lgpl", 0.97),
    (r"either version 2 of the license or at your option any later version", "gpl-2.0-or-later", 0.95),
    (r"either version 2 1 of the license or at your option any later version", "lgpl-2.1-or-later", 0.95),
    (r"either version 3 of the license or at your option any later version", "gpl-3.0-or-later", 0.95),
    (r"you should have received a copy of the gnu general public license", "gpl", 0.95),
    (r"you should have received a copy of the gnu lesser general public license", "lgpl", 0.95),
    (r"you should have received a copy of the gnu affero general public license", "agpl", 0.95),
    (r"mozilla org mpl 2 0", "mpl-2.0", 0.98),
    (r"this source code form is subject to the terms of the mozilla public license", "mpl-2.0", 0.99),
    (r"free and unencumbered software released into the public domain", "unlicense", 0.99),
    (r"dedicate any and all copyright interest in the software to the public domain", "unlicense", 0.98),
    (r"(?:is|are|hereby|placed|released) (?:in|into|to) the public domain", "public-domain", 0.8),
    (r"creativecommons org publicdomain zero 1 0", "cc0-1.0", 0.99),
    (r"creativecommons org licenses by 4 0", "cc-by-4.0", 0.99),
    (r"creativecommons org licenses by sa 4 0", "cc-by-sa-4.0", 0.99),
    (r"creativecommons org licenses by nc 4 0", "cc-by-nc-4.0", 0.99),
    (r"creativecommons org licenses by nd 4 0", "cc-by-nd-4.0", 0.99),
    (r"creativecommons org licenses by nc sa 4 0", "cc-by-nc-sa-4.0", 0.99),
    (r"creativecommons org licenses by nc nd 4 0", "cc-by-nc-nd-4.0", 0.99),
    (r"creativecommons org licenses by sa 3 0", "cc-by-sa-3.0", 0.99),
    (r"creativecommons org licenses by 3 0", "cc-by-3.0", 0.99),
    (r"do what the f\S{1,4} you want to public license", "wtfpl", 0.99),
    (r"altered source versions must be plainly marked as such", "zlib", 0.98),
    (r"boost org license 1 0", "bsl-1.0", 0.99),
    (r"machine executable object code generated by a source language processor", "bsl-1.0", 0.98),
    (r"this program and the accompanying materials are made available under the terms of the eclipse public license", "epl", 0.98),
    (r"eclipse org legal epl v20", "epl-2.0", 0.98),
    (r"eclipse org legal epl v10", "epl-1.0", 0.98),
    (r"the artistic license 2 0", "artistic-2.0", 0.97),
    (r"python software foundation license (?:version )?2?", "psf-2.0", 0.95),
    (r"in no event shall the authors or copyright holders be liable for any claim damages or other liability", "mit", 0.7),
    (r"except as contained in this notice the name .{1,80}? shall not be used in advertising", "x11", 0.97),
    (r"the author disclaims all warranties with regard to this software", "isc", 0.9),
    (r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that", "isc", 0.98),
    (r"redistributions of source code must retain the above copyright notice", "bsd", 0.95),
    (r"redistributions in binary form must reproduce the above copyright notice", "bsd", 0.95),
    (r"this software is provided by the copyright holders and contributors as is", "bsd", 0.9),
    (r"the views and conclusions contained in the software and documentation are those of the authors", "bsd-2-clause-views", 0.95),
    (r"this product includes software developed by the university of california berkeley", "bsd-4-clause-uc", 0.97),
    (r"this product includes software developed by the openssl project", "openssl", 0.97),
    (r"this product includes software developed by the apache software foundation", "apache-1.1", 0.95),
    (r"licensed to the apache software foundation asf under one or more contributor license agreements", "apache-2.0", 0.97),
    (r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", "apache-2.0", 0.95),
    (r"terms and conditions for use reproduction and distribution", "apache-2.0", 0.9),
    (r"grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license", "apache-2.0", 0.9),
    (r"everyone is permitted to copy and distribute verbatim copies of this license document", "gnu-license-text", 0.9),
    (r"the gnu general public license is a free copyleft license for software", "gpl-3.0", 0.98),
    (r"the licenses for most software are designed to take away your freedom to share and change it", "gpl-2.0", 0.95),
    (r"this license sometimes called the lesser general public license", "lgpl-2.1", 0.97),
    (r"this version of the gnu lesser general public license incorporates the terms and conditions of version 3", "lgpl-3.0", 0.98),
    (r"remote network interaction use with the gnu general public license", "agpl-3.0", 0.98),
    (r"this program is free software you can redistribute it and or modify it", "gpl", 0.85),
    (r"this library is free software you can redistribute it and or modify it", "lgpl", 0.85),
    (r"under the terms of the gnu library general public license", "lgpl-2.0", 0.95),
    (r"without even the implied warranty of merchantability or fitness for a particular purpose see the gnu", "gpl", 0.85),
    (r"as a special exception the free software foundation gives unlimited permission", "gpl-exception", 0.9),
    (r"linking this library statically or dynamically with other modules is making a combined work", "gpl-classpath-exception", 0.97),
    (r"classpath exception", "gpl-classpath-exception", 0.8),
    (r"gcc runtime library exception", "gpl-gcc-exception", 0.95),
    (r"autoconf configure script exception", "gpl-autoconf-exception", 0.95),
    (r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license", "gfdl", 0.98),
    (r"with no invariant sections no front cover texts and no back cover texts", "gfdl", 0.95),
    (r"if a copy of the mpl was not distributed with this file", "mpl-2.0", 0.99),
    (r"the contents of this file are subject to the mozilla public license version 1 1", "mpl-1.1", 0.99),
    (r"the contents of this file are subject to the netscape public license", "npl", 0.98),
    (r"alternatively the contents of this file may be used under the terms of", "multi-license", 0.7),
    (r"this file is part of .{1,60}? subject to the common development and distribution license", "cddl-1.0", 0.97),
    (r"you can obtain a copy of the license at usr src opensolaris license", "cddl-1.0", 0.98),
    (r"eclipse public license v 1 0 which accompanies this distribution", "epl-1.0", 0.98),
    (r"spdx license identifier epl 2 0 or", "epl-2.0", 0.98),
    (r"eclipse org org documents edl v10", "edl-1.0", 0.98),
    (r"licensed under the eupl version 1 [12]", "eupl", 0.97),
    (r"this software is governed by the cecill license under french law", "cecill", 0.98),
    (r"anyone is free to copy modify publish use compile sell or distribute this software", "unlicense", 0.98),
    (r"has waived all copyright and related or neighboring rights", "cc0-1.0", 0.97),
    (r"this work is licensed under a creative commons attribution", "cc-by", 0.9),
    (r"to view a copy of this license visit http[s]? creativecommons org", "creative-commons", 0.9),
    (r"you are free to share copy and redistribute the material in any medium or format", "creative-commons", 0.9),
    (r"you must give appropriate credit provide a link to the license and indicate if changes were made", "creative-commons", 0.9),
    (r"if you remix transform or build upon the material you must distribute your contributions under the same license", "cc-by-sa", 0.95),
    (r"you may not use the material for commercial purposes", "cc-by-nc", 0.9),
    (r"if you remix transform or build upon the material you may not distribute the modified material", "cc-by-nd", 0.95),
    (r"opendatacommons org licenses odbl", "odbl-1.0", 0.98),
    (r"opendatacommons org licenses by", "odc-by-1.0", 0.98),
    (r"opendatacommons org licenses pddl", "pddl-1.0", 0.98),
    (r"community data license agreement permissive", "cdla-permissive", 0.97),
    (r"community data license agreement sharing", "cdla-sharing", 0.97),
    (r"this font software is licensed under the sil open font license", "ofl-1.1", 0.99),
    (r"reserved font name", "ofl-1.1", 0.8),
    (r"the origin of this software must not be misrepresented", "zlib", 0.97),
    (r"this notice may not be removed or altered from any source distribution", "zlib", 0.95),
    (r"permission is hereby granted to use copy modify and distribute this software .{1,60}? libpng", "libpng", 0.9),
    (r"this software is based in part on the work of the independent jpeg group", "ijg", 0.97),
    (r"developed by .{1,60}? university of illinois", "ncsa", 0.8),
    (r"neither the names of .{1,120}? nor the names of its contributors may be used to endorse or promote", "ncsa", 0.9),
    (r"redistribution and use in source and binary forms of php", "php-3.01", 0.9),
    (r"this product includes php software freely available", "php-3.01", 0.97),
    (r"in no event shall .{1,60}? be liable to any party for direct indirect special incidental or consequential damages", "postgresql", 0.8),
    (r"python software foundation all rights reserved", "psf-2.0", 0.9),
    (r"you may make and give away verbatim copies of the source form of the software without restriction", "ruby", 0.8),
    (r"the intent of this document is to state the conditions under which a package may be copied", "artistic-1.0", 0.98),
    (r"vim is charityware", "vim", 0.98),
    (r"w3c software notice and license", "w3c", 0.98),
    (r"by obtaining and or copying this work you the licensee agree", "w3c", 0.9),
    (r"as long as you retain this notice you can do whatever you want with this stuff", "beerware", 0.99),
    (r"the software shall be used for good not evil", "json", 0.99),
    (r"copying and distribution of this file with or without modification are permitted in any medium without royalty", "fsf-all-permissive", 0.98),
    (r"this file may be distributed and or modified under the conditions of the latex project public license", "lppl", 0.98),
    (r"you are licensed to use this software for your internal business purposes only", "commercial", 0.8),
    (r"the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use", "busl-1.1", 0.98),
    (r"on the change date .{1,80}? the licensor hereby grants you rights under the terms of the change license", "busl-1.1", 0.98),
    (r"you may not provide the software to third parties as a hosted or managed service", "elastic-2.0", 0.98),
    (r"offering the program as a service .{1,120}? service source code", "sspl-1.0", 0.97),
    (r"the commons clause", "commons-clause", 0.9),
    (r"does not grant to you the right to sell the software", "commons-clause", 0.95),
    (r"the polyform .{1,30}? license", "polyform", 0.95),
    (r"use based restrictions as referenced in paragraph 5", "openrail", 0.97),
    (r"bigscience rail license", "bigscience-rail", 0.98),
    (r"llama materials", "llama", 0.8),
    (r"gemma terms of use", "gemma", 0.95),
    (r"for research purposes only", "research-only", 0.6),
    (r"for academic (?:and|or) non ?commercial use only", "research-only", 0.8),
    (r"for evaluation purposes only", "evaluation", 0.6),
    (r"free for personal use", "personal-use", 0.6),
    (r"no part of this (?:publication|book|work) may be reproduced", "all-rights-reserved", 0.9),
    (r"may not be reproduced (?:or distributed )?without (?:the )?(?:prior )?(?:written )?permission", "all-rights-reserved", 0.8),
    (r"reproduction (?:is )?prohibited without", "all-rights-reserved", 0.7),
    (r"used with permission of the copyright (?:holder|owner)", "permission", 0.6),
    (r"this software is confidential and proprietary information", "proprietary", 0.9),
    (r"end user license agreement", "eula", 0.7),
    (r"by installing (?:or using )?this software you agree", "eula", 0.8),
    (r"this work has been dedicated to the public domain", "public-domain", 0.9),
    (r"to the extent possible under law", "cc0-1.0", 0.7),
    (r"open government licen[cs]e", "ogl", 0.9),
    (r"contains public sector information licensed under", "ogl", 0.95),
    (r"openstreetmap contributors", "odbl-1.0", 0.6),
    (r"all rights reserved", "all-rights-reserved", 0.4),
    (r"copyright (?:\(?c\)? )?(?:19|20)\d\d", "copyright-notice", 0.3),
    (r"proprietary and confidential", "proprietary", 0.8),
    (r"unauthorized copying of this file", "proprietary", 0.85),
    (r"(?:not|non) (?:be used )?for commercial use", "non-commercial", 0.6),
]

# Names of licenses, as (SPDX identifier, pattern of the name); longer names before shorter ones.
NAMES = [
    ("agpl-3.0", r"(?:gnu )?affero general public license,? (?:version )?v?3(?: 0)?"),
    ("agpl-3.0", r"agpl ?v?3(?: 0)?"),
    ("lgpl-2.1", r"(?:gnu )?(?:lesser|library) general public license,? (?:version )?v?2 1"),
    ("lgpl-3.0", r"(?:gnu )?lesser general public license,? (?:version )?v?3(?: 0)?"),
    ("lgpl-2.1", r"lgpl ?v?2 1"),
    ("lgpl-3.0", r"lgpl ?v?3(?: 0)?"),
    ("gpl-2.0", r"(?:gnu )?general public license,? (?:version )?v?2(?: 0)?"),
    ("gpl-3.0", r"(?:gnu )?general public license,? (?:version )?v?3(?: 0)?"),
    ("gpl-1.0", r"(?:gnu )?general public license,? (?:version )?v?1(?: 0)?"),
    ("gpl-2.0", r"gpl ?v?2(?: 0)?"),
    ("gpl-3.0", r"gpl ?v?3(?: 0)?"),
    ("gfdl-1.3", r"(?:gnu )?free documentation license"),
    ("apache-2.0", r"apache (?:software )?license,? (?:version )?v?2(?: 0)?"),
    ("apache-1.1", r"apache (?:software )?license,? (?:version )?v?1 1"),
    ("apache-1.0", r"apache (?:software )?license,? (?:version )?v?1 0"),
    ("mit-0", r"mit no attribution license"),
    ("mit", r"(?:the )?mit license"),
    ("mit", r"expat license"),
    ("x11", r"x11 license"),
    ("isc", r"isc license"),
    ("bsd-0-clause", r"(?:zero|0) clause bsd license"),
    ("bsd-2-clause", r"bsd (?:2|two) clause license"),
    ("bsd-2-clause", r"(?:2|two) clause bsd license"),
    ("bsd-2-clause", r"simplified bsd license"),
    ("bsd-2-clause", r"freebsd license"),
    ("bsd-3-clause", r"bsd (?:3|three) clause license"),
    ("bsd-3-clause", r"(?:3|three) clause bsd license"),
    ("bsd-3-clause", r"(?:new|modified) bsd license"),
    ("bsd-4-clause", r"bsd (?:4|four) clause license"),
    ("bsd-4-clause", r"(?:4|four) clause bsd license"),
    ("bsd-4-clause", r"original bsd license"),
    ("bsd", r"bsd (?:style )?license"),
    ("mpl-2.0", r"mozilla public license,? (?:version )?v?2(?: 0)?"),
    ("mpl-1.1", r"mozilla public license,? (?:version )?v?1 1"),
    ("mpl-1.0", r"mozilla public license,? (?:version )?v?1 0"),
    ("epl-2.0", r"eclipse public license,? (?:version )?v?2(?: 0)?"),
    ("epl-1.0", r"eclipse public license,? (?:version )?v?1(?: 0)?"),
    ("edl-1.0", r"eclipse distribution license"),
    ("eupl-1.2", r"european union public license,? (?:version )?v?1 2"),
    ("eupl-1.1", r"european union public license,? (?:version )?v?1 1"),
    ("cddl-1.0", r"common development and distribution license"),
    ("cpl-1.0", r"common public license"),
    ("ipl-1.0", r"ibm public license"),
    ("osl-3.0", r"open software license"),
    ("afl-3.0", r"academic free license"),
    ("artistic-2.0", r"artistic license,? (?:version )?2(?: 0)?"),
    ("artistic-1.0", r"artistic license,? (?:version )?1(?: 0)?"),
    ("bsl-1.0", r"boost software license"),
    ("zlib", r"zlib (?:libpng )?license"),
    ("libpng", r"libpng license"),
    ("ijg", r"independent jpeg group license"),
    ("ncsa", r"(?:university of illinois )?ncsa open source license"),
    ("ofl-1.1", r"(?:sil )?open font license"),
    ("odbl-1.0", r"open database license"),
    ("odc-by-1.0", r"open data commons attribution license"),
    ("pddl-1.0", r"public domain dedication and license"),
    ("php-3.01", r"php license"),
    ("postgresql", r"postgresql license"),
    ("psf-2.0", r"python software foundation license"),
    ("ruby", r"ruby license"),
    ("vim", r"vim license"),
    ("w3c", r"w3c (?:software )?(?:notice and )?license"),
    ("wtfpl", r"wtfpl license"),
    ("unlicense", r"the unlicense"),
    ("upl-1.0", r"universal permissive license"),
    ("ms-pl", r"microsoft public license"),
    ("ms-rl", r"microsoft reciprocal license"),
    ("ecl-2.0", r"educational community license"),
    ("sspl-1.0", r"server side public license"),
    ("busl-1.1", r"business source license"),
    ("elastic-2.0", r"elastic license"),
    ("ccl", r"confluent community license"),
    ("openrail", r"open ?rail(?: m)? license"),
    ("llama", r"llama \d? ?community license"),
    ("ntp", r"ntp license"),
    ("curl", r"curl license"),
    ("openssl", r"openssl license"),
    ("qpl-1.0", r"q public license"),
    ("latex", r"latex project public license"),
    ("zpl-2.1", r"zope public license"),
    ("sleepycat", r"sleepycat license"),
    ("beerware", r"beer ?ware license"),
    ("json", r"json license"),
    ("mulan-2.0", r"mulan (?:permissive|psl) (?:software )?license"),
    ("cecill-2.1", r"cecill (?:free software )?license"),
    ("cc0-1.0", r"cc0(?: 1 0)?"),
    ("cc0-1.0", r"creative commons zero(?: license)?"),
    ("creative-commons", r"creative commons license"),
]

# Keywords of rules of whose pattern little stands fast, by the start of the label.
COMMON = {"cc": ["cc"], "gpl": ["gpl"], "public": ["public"], "non": ["commercial"], "all": ["reproduc"]}

# The elements of Creative Commons licenses, as their identifiers and as their titles have them.
CC_PARTS = {"by-nc-sa": "attribution non ?commercial share ?alike", "by-nc-nd": "attribution non ?commercial no ?deriv(?:ative)?s", "by-nc": "attribution non ?commercial", "by-nd": "attribution no ?deriv(?:ative)?s", "by-sa": "attribution share ?alike", "by": "attribution"}
CC_VERSIONS = ["4.0", "3.0"]
for _parts, _title in CC_PARTS.items():
    for _version in CC_VERSIONS:
        NAMES.append((f"cc-{_parts}-{_version}", f"cc {_parts.replace('-', ' ')} {_version.replace('.', ' ')}(?: license)?"))
        NAMES.append((f"cc-{_parts}-{_version}", f"creative commons {_title} {_version.replace('.', ' ')}(?: (?:international|unported|generic))?(?: license)?"))

#: What may stand before a name to make it a grant.
GRANTS = [
    r"(?:licensed|sublicensed|licenced) under (?:the )?(?:terms of )?(?:the |a )?",
    r"(?:released|distributed|published|redistributed) under (?:the )?(?:terms (?:and conditions )?of )?(?:the |a )?",
    r"(?:made )?available under (?:the )?(?:terms of )?(?:the |a )?",
]


def required(pattern: str) -> list[str]:
    """Plain words that each match of a pattern holds: those outside of groups and not optional."""
    while (less := re.sub(r"\(\?:[^()]*\)\??", " | ", pattern)) != pattern:
        pattern = less
    plain = re.sub(r"\[[^\]]*\](?:\{[^}]*\}|[?*+])?|\\.(?:\{[^}]*\}|[?*+])?|\.\{[^}]*\}\??|.\?", " | ", pattern)
    return sorted({w for w in re.findall(r"[a-z0-9]{2,}", plain)}, key=lambda w: (-len(w), w))[:4]


def rules() -> list[tuple[list[str], str, str, float]]:
    """All rules in order: text signatures, SPDX tags, grants by name, bare names. Each has a word that it needs."""
    tags = [(rf"spdx license identifier {x.replace('-', ' ').replace('.', ' ')}(?: only| or later)?", x, 0.99) for x in dict.fromkeys(n for n, _ in NAMES)]
    tags.sort(key=lambda r: -len(r[0]))
    grants = [(g + p, x, 0.95) for g in GRANTS for x, p in NAMES if not p.startswith("cc ")]
    names = [(p, x, 0.85) for x, p in NAMES]
    return [(required(p) or COMMON[x.split("-")[0]], p, x, w) for p, x, w in [*SIGNATURES, *tags, *grants, *names]]
