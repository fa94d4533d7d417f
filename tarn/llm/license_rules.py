"""Ordered signature rules for licence mentions, written by hand.

Rules are regexes over lower-cased text whose white space and comment marks are folded to single spaces.  A rule
has keywords, strings that any match contains (inside words too: gpl in gplv3), so that it is tried only where all
of them occur.  Kinds come in order: sentences of a licence's own text, notices that put a work under it, tags,
names, addresses, and remarks about rights that name no licence.  A lower kind is tried first and wins where
places nest; within a kind the longer match does, then the rule that stands first.
"""

from __future__ import annotations

import re
from typing import NamedTuple


class Rule(NamedTuple):
    label: str
    rank: int
    confidence: float
    keywords: tuple[str, ...]
    pattern: re.Pattern


TEXT, NOTICE, TAG, NAME, ADDRESS, REMARK = range(6)
CONFIDENCE = {TEXT: 1.0, NOTICE: 0.95, TAG: 1.0, NAME: 0.85, ADDRESS: 0.9, REMARK: 0.6}

#: label; then kind, keywords, pattern.  All keywords have to occur.
SIGNATURES = {
    "mit": [
        (TEXT, "obtaining", r"permission is hereby granted,? free of charge,? to any person obtaining a copy"),
        (TEXT, "sublicense", r"rights to use,? copy,? modify,? merge,? publish,? distribute,? sublicense,? and(?:/or)? sell copies"),
        (TEXT, "permission", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions"),
        (TEXT, "infringement", r"merchantability,? fitness for a particular purpose and non-?infringement"),
        (TEXT, "dealings", r"in connection with the software or the use or other dealings in the software"),
        (NOTICE, "mit licen under", r"\b(?:re)?licen[sc]ed under (?:the terms of )?(?:the )?mit(?:/x11| expat)?(?: licen[sc]e)?\b"),
        (NOTICE, "mit under", r"\b(?:released|distributed|available|published|provided|covered) under (?:the terms of )?(?:the )?mit(?:/x11)?(?: licen[sc]e)?\b"),
        (NOTICE, "mit under", r"\bunder the (?:terms(?: and conditions)? of|conditions of) the mit(?: licen[sc]e)?\b"),
        (TAG, "spdx mit", r"\bspdx-license-identifier: ?\(?(?:[\w.+-]+ (?:or|and|with) )*mit(?![\w.-])"),
        (TAG, "mit licen", r"\blicen[sc]e ?[:=] ?[\"']?mit\b"),
        (NAME, "mit licen", r"\b(?:the )?mit(?:/x11|[- ]style)? licen[sc]e\b"),
        (NAME, "expat licen", r"\b(?:the )?expat licen[sc]e\b"),
        (ADDRESS, "opensource", r"opensource\.org/licenses?/mit"),
        (ADDRESS, "choosealicense", r"choosealicense\.com/licenses/mit"),
    ],
    "mit-0": [
        (TAG, "spdx mit-0", r"\bspdx-license-identifier: ?\(?(?:[\w.+-]+ (?:or|and|with) )*mit-0(?![\w.-])"),
        (NAME, "attribution", r"\bmit no attribution(?: licen[sc]e)?\b"),
    ],
    "x11": [
        (TEXT, "consortium", r"the name of the x consortium shall not be used in advertising"),
        (TAG, "spdx x11", r"\bspdx-license-identifier: ?\(?(?:[\w.+-]+ (?:or|and|with) )*x11(?![\w.-])"),
        (NAME, "x11 licen", r"\b(?:the )?x11 licen[sc]e\b"),
    ],
    "isc": [
        (TEXT, "permission", r"permission to use,? copy,? modify,? and(?:/or)? distribute this software for any purpose(?: with or without fee)?"),
        (TEXT, "disclaims", r"the author disclaims all warranties with regard to this software"),
        (TEXT, "tortious", r"whether in an action of contract,? negligence or other tortious action"),
        (NOTICE, "isc under", r"\b(?:licen[sc]ed|released|distributed|available) under (?:the terms of )?the isc(?: licen[sc]e)?\b"),
        (TAG, "spdx isc", r"\bspdx-license-identifier: ?\(?(?:[\w.+-]+ (?:or|and|with) )*isc(?![\w.-])"),
        (TAG, "isc licen", r"\blicen[sc]e ?[:=] ?[\"']?isc\b"),
        (NAME, "isc licen", r"\b(?:the )?isc licen[sc]e\b"),
        (ADDRESS, "opensource", r"opensource\.org/licenses?/isc"),
    ],
    "bsd": [
        (TEXT, "redistribution", r"redistribution and use in source and binary forms,? with or without modification"),
        (TEXT, "redistributions", r"redistributions of source code must retain the above copyright notice,? this list of conditions"),
        (TEXT, "redistributions", r"redistributions in binary form must reproduce the above copyright notice"),
        (TEXT, "endorse", r"used to endorse or promote products derived from this software"),
        (TEXT, "advertising", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
        (TEXT, "exemplary", r"any direct,? indirect,? incidental,? special,? exemplary,? or consequential damages"),
        (TEXT, "regents", r"this software is provided by the regents and contributors"),
        (NOTICE, "bsd licen under", r"\b(?:re)?licen[sc]ed under (?:the terms of )?(?:the |a )?(?:[0-4]-clause |new |modified |simplified |revised )?bsd(?:[- ]style)?(?: licen[sc]e)?\b"),
        (NOTICE, "bsd under", r"\b(?:released|distributed|available|published|governed) under (?:the terms of )?(?:the |a )?(?:[0-4]-clause |new |modified |simplified |revised )?bsd(?:[- ]style)?(?: licen[sc]e)?\b"),
        (TAG, "spdx bsd", r"\bspdx-license-identifier: ?\(?(?:[\w.+-]+ (?:or|and|with) )*(?:0bsd|bsd-[1-4]-clause(?:-[\w-]+)?)(?![\w.-])"),
        (TAG, "bsd licen", r"\blicen[sc]e ?[:=] ?[\"']?(?:the )?(?:new )?bsd\b"),
        (NAME, "bsd licen", r"\b(?:the )?(?:[0-4]-clause |two-clause |three-clause |four-clause |new |modified |simplified |revised |free)?bsd(?:-[0-4]-clause|[- ]style)? licen[sc]e\b"),
        (NAME, "berkeley licen", r"\b(?:the )?berkeley software distribution licen[sc]e\b"),
        (ADDRESS, "opensource", r"opensource\.org/licenses?/bsd"),
    ],
    "apache": [
        (TEXT, "perpetual", r"hereby grants to you a perpetual,? worldwide,? non-exclusive,? no-charge,? royalty-free,? irrevocable copyright license"),
        (TEXT, "contribution", r"unless you explicitly state otherwise,? any contribution intentionally submitted for inclusion in the work"),
        (TEXT, "reproduction", r"terms and conditions for use,? reproduction,? and distribution"),
        (TEXT, "prominent", r"you must cause any modified files to carry prominent notices stating that you changed the files"),
        (TEXT, "notice", r"if the work includes a \"?notice\"? text file as part of its distribution"),
        (NOTICE, "apache under", r"licen[sc]ed (?:to you )?under the apache licen[sc]e,? version 2\.0"),
        (NOTICE, "compliance licen", r"you may not use this file except in compliance with the licen[sc]e"),
        (NOTICE, "basis", r"distributed on an \"?as is\"? basis,? without warranties or conditions of any kind"),
        (NOTICE, "contributor", r"licensed to the apache software foundation \(asf\) under one or more contributor license agreements"),
        (NOTICE, "apache licen under", r"\b(?:re)?licen[sc]ed under (?:the terms of )?(?:the )?apache(?: software)?(?: licen[sc]e)?\b(?:,?(?: version| v\.?)? ?(?:1\.[01]|2(?:\.0)?)\b)?"),
        (NOTICE, "apache under", r"\b(?:released|distributed|available|published|governed) under (?:the terms of )?the apache(?: software)?(?: licen[sc]e)?\b"),
        (TAG, "spdx apache", r"\bspdx-license-identifier: ?\(?(?:[\w.+-]+ (?:or|and|with) )*apache-(?:1\.[01]|2\.0)(?![\w.-])"),
        (TAG, "apache licen", r"\blicen[sc]e ?[:=] ?[\"']?apache(?:[- ]2(?:\.0)?)?\b"),
        (NAME, "apache", r"\b(?:the )?apache(?:[- ]2(?:\.0)?| software)? licen[sc]e(?:,? version (?:1\.[01]|2\.0)| ?v?2(?:\.0)?)?\b"),
        (ADDRESS, "apache", r"apache\.org/licenses"),
        (ADDRESS, "opensource", r"opensource\.org/licenses?/apache"),
    ],
    "gpl": [
        (TEXT, "redistribute under", r"you can redistribute it and/or modify it under the terms of the gnu general public licen[sc]e"),
        (TEXT, "general", r"you should have received a copy of the gnu general public licen[sc]e"),
        (TEXT, "freedom", r"the licenses for most software are designed to take away your freedom to share and change it"),
        (TEXT, "copyleft", r"the gnu general public licen[sc]e is a free,? copyleft licen[sc]e"),
        (TEXT, "verbatim", r"you may (?:copy and distribute|convey) verbatim copies of the program's source code as you receive it"),
        (TEXT, "conditions", r"terms and conditions for copying,? distribution and modification"),
        (TEXT, "installation", r"\"installation information\" for a user product means any methods"),
        (NOTICE, "general licen under", r"\b(?:re)?licen[sc]ed under (?:the terms of )?(?:the )?(?:gnu )?general public licen[sc]e\b"),
        (NOTICE, "general licen under", r"\b(?:released|distributed|available|published|covered) under (?:the terms of )?(?:the )?(?:gnu )?general public licen[sc]e\b"),
        (NOTICE, "general licen under", r"\bunder the (?:terms(?: and conditions)? of|conditions of) (?:the )?(?:gnu )?general public licen[sc]e\b"),
        (NOTICE, "gpl licen under", r"\b(?:re)?licen[sc]ed under (?:the terms of )?(?:the )?(?:gnu )?gpl(?: ?(?:v|version )?[123](?:\.\d)?\+?)?"),
        (NOTICE, "gpl under", r"\b(?:released|distributed|available|published|covered) under (?:the terms of )?(?:the )?(?:gnu )?gpl(?: ?(?:v|version )?[123](?:\.\d)?\+?)?"),
        (NOTICE, "gpl under", r"\bunder the (?:terms(?: and conditions)? of|conditions of) (?:the )?(?:gnu )?gpl(?: ?(?:v|version )?[123])?\b"),
        (TAG, "spdx gpl", r"\bspdx-license-identifier: ?\(?(?:[\w.+-]+ (?:or|and|with) )*gpl-[123]\.0(?:-only|-or-later|\+)?(?![\w.-])"),
        (TAG, "gpl licen", r"\blicen[sc]e ?[:=] ?[\"']?(?:gnu )?gpl(?:[- ]?v?[123](?:\.0)?\+?)?"),
        (TAG, "module_licen", r"\bmodule_licen[sc]e ?\( ?\"(?:dual [a-z]+/)?gpl(?: v2)?\" ?\)"),
        (NAME, "general", r"\b(?:the )?(?:gnu )?general public licen[sc]e(?:,? (?:version |v)[123](?:\.0)?)?"),
        (NAME, "gpl", r"\b(?:the )?gnu gpl(?: ?v?[123](?:\.0)?)?\b"),
        (NAME, "gpl licen", r"\b(?:the )?gpl(?: ?v?[123](?:\.0)?\+?)? licen[sc]e\b"),
        (ADDRESS, "gnu", r"gnu\.org/(?:licenses|copyleft)/gpl"),
        (ADDRESS, "opensource", r"opensource\.org/licenses?/gpl"),
        (ADDRESS, "foundation", r"free software foundation,? inc\.,? (?:51 franklin|59 temple)"),
    ],
    "lgpl": [
        (TEXT, "lesser", r"you should have received a copy of the gnu lesser general public licen[sc]e"),
        (TEXT, "library", r"you should have received a copy of the gnu library general public licen[sc]e"),
        (TEXT, "lesser under", r"redistribute it and/or modify it under the terms of the gnu lesser general public licen[sc]e"),
        (TEXT, "library under", r"redistribute it and/or modify it under the terms of the gnu library general public licen[sc]e"),
        (TEXT, "incorporates", r"the gnu lesser general public licen[sc]e incorporates the terms and conditions of version 3"),
        (NOTICE, "lesser licen under", r"\b(?:licen[sc]ed|released|distributed|available|published) under (?:the terms of )?(?:the )?(?:gnu )?lesser general public licen[sc]e\b"),
        (NOTICE, "lgpl under", r"\b(?:licen[sc]ed|released|distributed|available|published) under (?:the terms of )?(?:the )?(?:gnu )?lgpl(?: ?(?:v|version )?[23](?:\.\d)?\+?)?"),
        (NOTICE, "lgpl under", r"\bunder the (?:terms(?: and conditions)? of|conditions of) (?:the )?(?:gnu )?lgpl(?: ?(?:v|version )?[23])?\b"),
        (TAG, "spdx lgpl", r"\bspdx-license-identifier: ?\(?(?:[\w.+-]+ (?:or|and|with) )*lgpl-[23]\.[01](?:-only|-or-later|\+)?(?![\w.-])"),
        (TAG, "lgpl licen", r"\blicen[sc]e ?[:=] ?[\"']?(?:gnu )?lgpl(?:[- ]?v?[23](?:\.[01])?\+?)?"),
        (NAME, "lesser", r"\b(?:the )?(?:gnu )?lesser general public licen[sc]e(?:,? (?:version |v)[23](?:\.[01])?)?"),
        (NAME, "library", r"\b(?:the )?(?:gnu )?library general public licen[sc]e(?:,? (?:version |v)2(?:\.0)?)?"),
        (NAME, "lgpl licen", r"\b(?:the )?(?:gnu )?lgpl(?: ?v?[23](?:\.[01])?\+?)? licen[sc]e\b"),
        (ADDRESS, "gnu", r"gnu\.org/(?:licenses|copyleft)/(?:lgpl|lesser)"),
        (ADDRESS, "opensource", r"opensource\.org/licenses?/lgpl"),
    ],
    "agpl": [
        (TEXT, "affero", r"you should have received a copy of the gnu affero general public licen[sc]e"),
        (TEXT, "affero under", r"redistribute it and/or modify it under the terms of the gnu affero general public licen[sc]e"),
        (TEXT, "remotely", r"all users interacting with it remotely through a computer network"),
        (NOTICE, "affero licen under", r"\b(?:licen[sc]ed|released|distributed|available|published) under (?:the terms of )?(?:the )?(?:gnu )?affero general public licen[sc]e\b"),
        (NOTICE, "agpl under", r"\b(?:licen[sc]ed|released|distributed|available|published) under (?:the terms of )?(?:the )?(?:gnu )?agpl(?: ?(?:v|version )?[13](?:\.0)?\+?)?"),
        (NOTICE, "agpl under", r"\bunder the (?:terms(?: and conditions)? of|conditions of) (?:the )?(?:gnu )?agpl(?: ?(?:v|version )?[13])?\b"),
        (TAG, "spdx agpl", r"\bspdx-license-identifier: ?\(?(?:[\w.+-]+ (?:or|and|with) )*agpl-[13]\.0(?:-only|-or-later|\+)?(?![\w.-])"),
        (TAG, "agpl licen", r"\blicen[sc]e ?[:=] ?[\"']?(?:gnu )?agpl(?:[- ]?v?3(?:\.0)?\+?)?"),
        (NAME, "affero", r"\b(?:the )?(?:gnu )?affero general public licen[sc]e(?:,? (?:version |v)[13](?:\.0)?)?"),
        (NAME, "agpl licen", r"\b(?:the )?(?:gnu )?agpl(?: ?v?3(?:\.0)?\+?)? licen[sc]e\b"),
        (ADDRESS, "gnu", r"gnu\.org/licenses/agpl"),
    ],
    "gfdl": [
        (TEXT, "invariant", r"with no invariant sections,? (?:with )?no front-cover texts,? and (?:with )?no back-cover texts"),
        (TEXT, "documentation under", r"permission is granted to copy,? distribute and/or modify this document under the terms of the gnu free documentation licen[sc]e"),
        (TAG, "spdx gfdl", r"\bspdx-license-identifier: ?\(?(?:[\w.+-]+ (?:or|and|with) )*gfdl-1\.[123](?:-[\w-]+)?(?![\w.])"),
        (NAME, "documentation licen", r"\b(?:the )?(?:gnu )?free documentation licen[sc]e\b"),
        (ADDRESS, "gnu", r"gnu\.org/(?:licenses|copyleft)/fdl"),
    ],
    "mpl": [
        (TEXT, "mozilla", r"this source code form is subject to the terms of the mozilla public licen[sc]e"),
        (TEXT, "mozilla", r"if a copy of the mpl was not distributed with this file,? you can obtain one at https?://mozilla\.org/mpl"),
        (TEXT, "mozilla", r"the contents of this file are subject to the mozilla public licen[sc]e version"),
        (TEXT, "secondary", r"this source code form is \"?incompatible with secondary licenses\"?"),
        (NOTICE, "mozilla licen under", r"\b(?:licen[sc]ed|released|distributed|available|published) under (?:the terms of )?the mozilla public licen[sc]e\b"),
        (NOTICE, "mpl under", r"\b(?:licen[sc]ed|released|distributed|available|published) under (?:the terms of )?(?:the )?mpl(?: ?(?:v|version )?[12](?:\.[01])?)?"),
        (TAG, "spdx mpl", r"\bspdx-license-identifier: ?\(?(?:[\w.+-]+ (?:or|and|with) )*mpl-[12]\.[01](?![\w.])"),
        (TAG, "mpl licen", r"\blicen[sc]e ?[:=] ?[\"']?mpl(?:[- ]?v?[12](?:\.[01])?)?"),
        (NAME, "mozilla", r"\b(?:the )?mozilla public licen[sc]e(?:,? (?:version |v\.? ?)[12]\.[01])?"),
        (ADDRESS, "mozilla", r"mozilla\.org/mpl"),
    ],
    "epl": [
        (TEXT, "accompanying under", r"the accompanying program is provided under the terms of this eclipse public licen[sc]e"),
        (TEXT, "eclipse under", r"made available under the terms of the eclipse public licen[sc]e"),
        (NOTICE, "eclipse licen under", r"\b(?:licen[sc]ed|released|distributed|published) under (?:the terms of )?the eclipse public licen[sc]e\b"),
        (TAG, "spdx epl", r"\bspdx-license-identifier: ?\(?(?:[\w.+-]+ (?:or|and|with) )*epl-[12]\.0(?![\w.-])"),
        (NAME, "eclipse licen", r"\b(?:the )?eclipse public licen[sc]e\b"),
        (ADDRESS, "eclipse", r"eclipse\.org/legal/epl"),
    ],
    "edl": [
        (NAME, "eclipse licen", r"\b(?:the )?eclipse distribution licen[sc]e\b"),
        (ADDRESS, "eclipse", r"eclipse\.org/org/documents/edl"),
    ],
    "cpl": [
        (TEXT, "accompanying under", r"the accompanying program is provided under the terms of this common public licen[sc]e"),
        (TAG, "spdx cpl", r"\bspdx-license-identifier: ?\(?(?:[\w.+-]+ (?:or|and|with) )*cpl-1\.0(?![\w.-])"),
        (NAME, "common licen", r"\b(?:the )?common public licen[sc]e\b"),
    ],
    "ipl": [
        (TAG, "spdx ipl", r"\bspdx-license-identifier: ?\(?(?:[\w.+-]+ (?:or|and|with) )*ipl-1\.0(?![\w.-])"),
        (NAME, "ibm licen", r"\b(?:the )?ibm public licen[sc]e\b"),
    ],
    "cddl": [
        (TEXT, "common", r"the contents of this file are subject to the terms of the common development and distribution licen[sc]e"),
        (TAG, "spdx cddl", r"\bspdx-license-identifier: ?\(?(?:[\w.+-]+ (?:or|and|with) )*cddl-1\.[01](?![\w.-])"),
        (NAME, "common licen", r"\b(?:the )?common development and distribution licen[sc]e\b"),
        (NAME, "cddl licen", r"\b(?:the )?cddl(?: ?v?1\.[01])? licen[sc]e\b"),
        (NOTICE, "cddl under", r"\bunder (?:the terms of )?the cddl\b"),
    ],
    "eupl": [
        (TEXT, "european under", r"licen[sc]ed under the eupl,? version 1\.[12] or [-–] as soon they will be approved by the european commission"),
        (TAG, "spdx eupl", r"\bspdx-license-identifier: ?\(?(?:[\w.+-]+ (?:or|and|with) )*eupl-1\.[012](?![\w.-])"),
        (NAME, "european licen", r"\b(?:the )?european union public licen[sc]e\b"),
        (NOTICE, "eupl under", r"\b(?:licen[sc]ed )?under (?:the terms of )?(?:the )?eupl\b"),
    ],
    "osl": [
        (TEXT, "software under", r"licen[sc]ed under the open software licen[sc]e version [123]\.[01]"),
        (TAG, "spdx osl", r"\bspdx-license-identifier: ?\(?(?:[\w.+-]+ (?:or|and|with) )*osl-[123]\.[01](?![\w.-])"),
        (NAME, "software licen", r"\b(?:the )?open software licen[sc]e\b"),
    ],
    "afl": [
        (TAG, "spdx afl", r"\bspdx-license-identifier: ?\(?(?:[\w.+-]+ (?:or|and|with) )*afl-[123]\.[012](?![\w.-])"),
        (NAME, "academic licen", r"\b(?:the )?academic free licen[sc]e\b"),
    ],
    "artistic": [
        (TEXT, "package", r"you may make and give away verbatim copies of the source form of the standard version of this package"),
        (TEXT, "perl redistribute under", r"you can redistribute it and/or modify it under the same terms as perl itself"),
        (TAG, "spdx artistic", r"\bspdx-license-identifier: ?\(?(?:[\w.+-]+ (?:or|and|with) )*artistic-[12]\.0(?![\w.])"),
        (NAME, "artistic licen", r"\b(?:the )?(?:perl )?artistic licen[sc]e\b"),
        (ADDRESS, "opensource", r"opensource\.org/licenses?/artistic"),
    ],
    "zlib": [
        (TEXT, "misrepresented", r"the origin of this software must not be misrepresented"),
        (TEXT, "altered", r"altered source versions must be plainly marked as such,? and must not be misrepresented"),
        (TEXT, "implied", r"this software is provided '?as[- ]is'?,? without any express or implied warranty"),
        (TEXT, "commercial", r"permission is granted to anyone to use this software for any purpose,? including commercial applications"),
        (TEXT, "removed", r"this notice may not be removed or altered from any source distribution"),
        (TAG, "spdx zlib", r"\bspdx-license-identifier: ?\(?(?:[\w.+-]+ (?:or|and|with) )*zlib(?![\w.-])"),
        (NAME, "zlib licen", r"\b(?:the )?zlib(?:/libpng)? licen[sc]e\b"),
        (NOTICE, "zlib under", r"\b(?:licen[sc]ed|released|distributed|available) under (?:the terms of )?the zlib(?:/libpng)?(?: licen[sc]e)?\b"),
        (ADDRESS, "opensource", r"opensource\.org/licenses?/zlib"),
    ],
    "libpng": [
        (TEXT, "libpng", r"libpng versions? [\d., and]+(?:through [\d.]+ )?(?:are|is) copyright"),
        (TAG, "spdx libpng", r"\bspdx-license-identifier: ?\(?(?:[\w.+-]+ (?:or|and|with) )*libpng(?:-2\.0)?(?![\w.-])"),
        (NAME, "libpng licen", r"\b(?:the )?libpng licen[sc]e\b"),
    ],
    "boost": [
        (TEXT, "boost under", r"distributed under the boost software licen[sc]e,? version 1\.0"),
        (TEXT, "machine-executable", r"unless such copies or derivative works are solely in the form of machine-executable object code"),
        (TAG, "spdx bsl", r"\bspdx-license-identifier: ?\(?(?:[\w.+-]+ (?:or|and|with) )*bsl-1\.0(?![\w.-])"),
        (NAME, "boost licen", r"\b(?:the )?boost software licen[sc]e\b"),
        (ADDRESS, "boost", r"boost\.org/licen[sc]e_1_0"),
    ],
    "bsl": [
        (TEXT, "licensor", r"the licensor hereby grants you the right to copy,? modify,? create derivative works,? redistribute,? and make non-production use"),
        (TAG, "spdx busl", r"\bspdx-license-identifier: ?\(?(?:[\w.+-]+ (?:or|and|with) )*busl-1\.1(?![\w.-])"),
        (NAME, "business licen", r"\b(?:the )?business source licen[sc]e\b"),
    ],
    "unlicense": [
        (TEXT, "unencumbered", r"this is free and unencumbered software released into the public domain"),
        (TEXT, "anyone", r"anyone is free to copy,? modify,? publish,? use,? compile,? sell,? or distribute this software"),
        (TAG, "unlicense", r"\bspdx-license-identifier: ?\(?(?:[\w.+-]+ (?:or|and|with) )*unlicense(?![\w.-])"),
        (TAG, "unlicense", r"\blicen[sc]e ?[:=] ?[\"']?(?:the )?unlicense\b"),
        (NAME, "unlicense", r"\bthe unlicense\b"),
        (ADDRESS, "unlicense", r"unlicense\.org"),
    ],
    "wtfpl": [
        (TEXT, "fuck", r"do what the fuck you want to public licen[sc]e"),
        (TAG, "spdx wtfpl", r"\bspdx-license-identifier: ?\(?(?:[\w.+-]+ (?:or|and|with) )*wtfpl(?![\w.-])"),
        (NAME, "wtfpl", r"\bwtfpl\b"),
    ],
    "python": [
        (TEXT, "python", r"this license agreement is between the python software foundation"),
        (TEXT, "python", r"psf hereby grants licensee a nonexclusive,? royalty-free,? world-wide licen[sc]e to reproduce,? analyze,? test,? perform and/or display publicly,? prepare derivative works,? distribute,? and otherwise use python"),
        (TAG, "spdx -2.0", r"\bspdx-license-identifier: ?\(?(?:[\w.+-]+ (?:or|and|with) )*(?:psf|python)-2\.0(?![\w.])"),
        (NAME, "python licen", r"\b(?:the )?python(?: software foundation)? licen[sc]e\b"),
    ],
    "php": [
        (TEXT, "php", r"this source file is subject to version 3\.0?1? of the php licen[sc]e"),
        (TEXT, "php products", r"products derived from this software may not be called \"?php\"?"),
        (TAG, "spdx php", r"\bspdx-license-identifier: ?\(?(?:[\w.+-]+ (?:or|and|with) )*php-3\.01?(?![\w.-])"),
        (NAME, "php licen", r"\b(?:the )?php licen[sc]e\b"),
        (ADDRESS, "php", r"php\.net/licen[sc]e"),
    ],
    "ruby": [
        (TEXT, "ruby redistribute under", r"you (?:can|may) redistribute it and/or modify it under the same terms as ruby"),
        (TAG, "spdx ruby", r"\bspdx-license-identifier: ?\(?(?:[\w.+-]+ (?:or|and|with) )*ruby(?![\w.-])"),
        (NAME, "ruby licen", r"\b(?:the )?ruby licen[sc]e\b"),
    ],
    "openssl": [
        (TEXT, "openssl", r"this product includes software developed by the openssl project for use in the openssl toolkit"),
        (TEXT, "cryptographic", r"this product includes cryptographic software written by eric young"),
        (TAG, "spdx openssl", r"\bspdx-license-identifier: ?\(?(?:[\w.+-]+ (?:or|and|with) )*openssl(?![\w.-])"),
        (NAME, "openssl licen", r"\b(?:the )?openssl licen[sc]e\b"),
    ],
    "w3c": [
        (TEXT, "w3c", r"by obtaining,? using and/or copying this work,? you \(the licensee\) agree that you have read[^.]{0,80}w3c"),
        (TAG, "spdx w3c", r"\bspdx-license-identifier: ?\(?(?:[\w.+-]+ (?:or|and|with) )*w3c(?:-\d{8})?(?![\w.])"),
        (NAME, "w3c licen", r"\b(?:the )?w3c(?: software notice and| document)? licen[sc]e\b"),
        (ADDRESS, "w3", r"w3\.org/consortium/legal"),
    ],
    "ncsa": [
        (TEXT, "illinois", r"neither the names? of [^.]{0,60}university of illinois[^.]{0,60} nor the names of its contributors"),
        (TAG, "spdx ncsa", r"\bspdx-license-identifier: ?\(?(?:[\w.+-]+ (?:or|and|with) )*ncsa(?![\w.-])"),
        (NAME, "ncsa licen", r"\b(?:the )?(?:university of illinois/)?ncsa(?: open source)? licen[sc]e\b"),
    ],
    "ms-pl": [
        (TEXT, "accept", r"if you use the software,? you accept this license\. if you do not accept the license,? do not use the software"),
        (TAG, "spdx ms-pl", r"\bspdx-license-identifier: ?\(?(?:[\w.+-]+ (?:or|and|with) )*ms-pl(?![\w.-])"),
        (NAME, "microsoft licen", r"\b(?:the )?microsoft public licen[sc]e\b"),
    ],
    "ms-rl": [
        (TAG, "spdx ms-rl", r"\bspdx-license-identifier: ?\(?(?:[\w.+-]+ (?:or|and|with) )*ms-rl(?![\w.-])"),
        (NAME, "microsoft licen", r"\b(?:the )?microsoft reciprocal licen[sc]e\b"),
    ],
    "ofl": [
        (TEXT, "font sil under", r"this font software is licen[sc]ed under the sil open font licen[sc]e,? version 1\.[01]"),
        (TEXT, "reserved font", r"no modified version of the font software may use the reserved font name"),
        (TAG, "spdx ofl", r"\bspdx-license-identifier: ?\(?(?:[\w.+-]+ (?:or|and|with) )*ofl-1\.[01](?![\w.])"),
        (NAME, "font licen", r"\b(?:the )?(?:sil )?open font licen[sc]e\b"),
        (ADDRESS, "sil", r"scripts\.sil\.org/ofl"),
    ],
    "odbl": [
        (TEXT, "database under", r"made available under the open database licen[sc]e"),
        (TAG, "spdx odbl", r"\bspdx-license-identifier: ?\(?(?:[\w.+-]+ (?:or|and|with) )*odbl-1\.0(?![\w.-])"),
        (NAME, "database licen", r"\b(?:the )?open (?:data commons open )?database licen[sc]e\b"),
        (ADDRESS, "opendatacommons", r"opendatacommons\.org/licenses/odbl"),
    ],
    "odc-by": [
        (TAG, "spdx odc-by", r"\bspdx-license-identifier: ?\(?(?:[\w.+-]+ (?:or|and|with) )*odc-by-1\.0(?![\w.-])"),
        (NAME, "commons licen", r"\b(?:the )?open data commons attribution licen[sc]e\b"),
        (ADDRESS, "opendatacommons", r"opendatacommons\.org/licenses/by"),
    ],
    "pddl": [
        (TAG, "spdx pddl", r"\bspdx-license-identifier: ?\(?(?:[\w.+-]+ (?:or|and|with) )*pddl-1\.0(?![\w.-])"),
        (NAME, "dedication licen", r"\b(?:the )?public domain dedication and licen[sc]e\b"),
        (ADDRESS, "opendatacommons", r"opendatacommons\.org/licenses/pddl"),
    ],
    "cecill": [
        (TEXT, "cecill", r"ce logiciel est r[eéÉ]gi par la licence cecill"),
        (TEXT, "cecill", r"this software is governed by the cecill(?:-[abc])? licen[sc]e under french law"),
        (TAG, "spdx cecill", r"\bspdx-license-identifier: ?\(?(?:[\w.+-]+ (?:or|and|with) )*cecill-(?:[12]\.[01]|b|c)(?![\w.-])"),
        (NAME, "cecill licen", r"\b(?:the )?cecill(?:-[abc])? licen[sc]e\b"),
        (ADDRESS, "cecill", r"cecill\.info"),
    ],
    "sspl": [
        (TEXT, "service", r"if you make the functionality of the program or a modified version available to third parties as a service"),
        (TAG, "spdx sspl", r"\bspdx-license-identifier: ?\(?(?:[\w.+-]+ (?:or|and|with) )*sspl-1\.0(?![\w.-])"),
        (NAME, "server licen", r"\b(?:the )?server side public licen[sc]e\b"),
    ],
    "elastic": [
        (TEXT, "managed", r"you may not provide the software to third parties as a hosted or managed service"),
        (TAG, "spdx elastic", r"\bspdx-license-identifier: ?\(?(?:[\w.+-]+ (?:or|and|with) )*elastic-2\.0(?![\w.-])"),
        (NAME, "elastic", r"\b(?:the )?elastic licen[sc]e(?: 2\.0)?\b"),
    ],
    "commons-clause": [
        (TEXT, "licensor under", r"the software is provided to you by the licensor under the licen[sc]e,? as defined below,? subject to the following condition"),
        (NAME, "commons", r"\bcommons clause(?: licen[sc]e)?(?: condition)?\b"),
    ],
    "rpl": [
        (TAG, "spdx rpl", r"\bspdx-license-identifier: ?\(?(?:[\w.+-]+ (?:or|and|with) )*rpl-1\.[15](?![\w.-])"),
        (NAME, "reciprocal licen", r"\b(?:the )?reciprocal public licen[sc]e\b"),
    ],
    "qpl": [
        (TAG, "spdx qpl", r"\bspdx-license-identifier: ?\(?(?:[\w.+-]+ (?:or|and|with) )*qpl-1\.0(?![\w.])"),
        (NAME, "public licen", r"\b(?:the )?q public licen[sc]e\b"),
    ],
    "sleepycat": [
        (TEXT, "redistributions", r"redistributions in any form must be accompanied by information on how to obtain complete source code"),
        (TAG, "spdx sleepycat", r"\bspdx-license-identifier: ?\(?(?:[\w.+-]+ (?:or|and|with) )*sleepycat(?![\w.-])"),
        (NAME, "sleepycat licen", r"\b(?:the )?sleepycat licen[sc]e\b"),
    ],
    "vim": [
        (TEXT, "vim unmodified", r"there are no restrictions on distributing unmodified copies of vim"),
        (TAG, "spdx vim", r"\bspdx-license-identifier: ?\(?(?:[\w.+-]+ (?:or|and|with) )*vim(?![\w.-])"),
        (NAME, "vim licen", r"\b(?:the )?vim licen[sc]e\b"),
    ],
    "postgresql": [
        (TEXT, "documentation", r"permission to use,? copy,? modify,? and distribute this software and its documentation for any purpose,? without fee"),
        (TAG, "spdx postgresql", r"\bspdx-license-identifier: ?\(?(?:[\w.+-]+ (?:or|and|with) )*postgresql(?![\w.-])"),
        (NAME, "postgresql licen", r"\b(?:the )?postgresql licen[sc]e\b"),
    ],
    "curl": [
        (TAG, "spdx curl", r"\bspdx-license-identifier: ?\(?(?:[\w.+-]+ (?:or|and|with) )*curl(?![\w.-])"),
        (NAME, "curl licen", r"\b(?:the )?curl licen[sc]e\b"),
        (ADDRESS, "curl", r"curl\.se/docs/copyright"),
    ],
    "upl": [
        (TEXT, "larger", r"a copy of the software is included or with which the software is distributed \(each a \"?larger work\"?"),
        (TAG, "spdx upl", r"\bspdx-license-identifier: ?\(?(?:[\w.+-]+ (?:or|and|with) )*upl-1\.0(?![\w.-])"),
        (NAME, "universal licen", r"\b(?:the )?universal permissive licen[sc]e\b"),
    ],
    "blueoak": [
        (TEXT, "contributor", r"each contributor licenses you to do everything with this software that would otherwise infringe"),
        (TAG, "spdx blueoak", r"\bspdx-license-identifier: ?\(?(?:[\w.+-]+ (?:or|and|with) )*blueoak-1\.0\.0(?![\w.-])"),
        (NAME, "oak licen", r"\b(?:the )?blue oak model licen[sc]e\b"),
    ],
    "mulan": [
        (TEXT, "mulan under", r"licen[sc]ed under (?:the )?mulan psl v[12]"),
        (TAG, "spdx mulanpsl", r"\bspdx-license-identifier: ?\(?(?:[\w.+-]+ (?:or|and|with) )*mulanpsl-[12]\.0(?![\w.-])"),
        (NAME, "mulan licen", r"\b(?:the )?mulan (?:permissive|public)(?: software)? licen[sc]e\b"),
    ],
    "beerware": [
        (TEXT, "beer worth", r"if we meet some day,? and you think this stuff is worth it,? you can buy me a beer"),
        (TAG, "spdx beerware", r"\bspdx-license-identifier: ?\(?(?:[\w.+-]+ (?:or|and|with) )*beerware(?![\w.-])"),
        (NAME, "beer licen", r"\b(?:the )?beer-?ware licen[sc]e\b"),
    ],
    "json": [
        (TEXT, "evil good", r"the software shall be used for good,? not evil"),
        (TAG, "spdx json", r"\bspdx-license-identifier: ?\(?(?:[\w.+-]+ (?:or|and|with) )*json(?![\w.-])"),
    ],
    "cc0": [
        (TEXT, "affirmer", r"affirmer hereby overtly,? fully,? permanently,? irrevocably and unconditionally waives,? abandons,? and surrenders"),
        (TEXT, "waived", r"has waived all copyright and related or neighboring rights to"),
        (TAG, "spdx cc0", r"\bspdx-license-identifier: ?\(?(?:[\w.+-]+ (?:or|and|with) )*cc0-1\.0(?![\w.-])"),
        (TAG, "cc0 licen", r"\blicen[sc]e ?[:=] ?[\"']?cc0\b"),
        (NAME, "cc0", r"\b(?:creative commons )?cc0(?: 1\.0)?(?: universal)?(?: public domain dedication| licen[sc]e)?\b"),
        (ADDRESS, "creativecommons", r"creativecommons\.org/publicdomain/zero"),
    ],
    "cc-by-sa": [
        (NOTICE, "creative under", r"\b(?:licen[sc]ed|released|available|published) under (?:the terms of )?(?:the |a )?creative commons attribution[ -]share ?alike"),
        (TAG, "spdx cc-by-sa", r"\bspdx-license-identifier: ?\(?(?:[\w.+-]+ (?:or|and|with) )*cc-by-sa-[1-4]\.0(?![\w.])"),
        (NAME, "creative", r"\b(?:the )?creative commons attribution[ -]share ?alike(?: \d\.\d)?(?: international| unported)?(?: licen[sc]e)?\b"),
        (NAME, "by-sa", r"\bcc[ -]by-sa(?: \d\.\d)?\b"),
        (ADDRESS, "creativecommons", r"creativecommons\.org/licenses/by-sa"),
    ],
    "cc-by-nc-sa": [
        (TAG, "spdx cc-by-nc-sa", r"\bspdx-license-identifier: ?\(?(?:[\w.+-]+ (?:or|and|with) )*cc-by-nc-sa-[1-4]\.0(?![\w.])"),
        (NAME, "creative", r"\b(?:the )?creative commons attribution[ -]non-?commercial[ -]share ?alike(?: \d\.\d)?(?: international| unported)?(?: licen[sc]e)?\b"),
        (NAME, "by-nc-sa", r"\bcc[ -]by-nc-sa(?: \d\.\d)?\b"),
        (ADDRESS, "creativecommons", r"creativecommons\.org/licenses/by-nc-sa"),
    ],
    "cc-by-nc-nd": [
        (TAG, "spdx cc-by-nc-nd", r"\bspdx-license-identifier: ?\(?(?:[\w.+-]+ (?:or|and|with) )*cc-by-nc-nd-[1-4]\.0(?![\w.])"),
        (NAME, "creative", r"\b(?:the )?creative commons attribution[ -]non-?commercial[ -]no ?deriv(?:ative)?s(?: \d\.\d)?(?: international| unported)?(?: licen[sc]e)?\b"),
        (NAME, "by-nc-nd", r"\bcc[ -]by-nc-nd(?: \d\.\d)?\b"),
        (ADDRESS, "creativecommons", r"creativecommons\.org/licenses/by-nc-nd"),
    ],
    "cc-by-nd": [
        (TAG, "spdx cc-by-nd", r"\bspdx-license-identifier: ?\(?(?:[\w.+-]+ (?:or|and|with) )*cc-by-nd-[1-4]\.0(?![\w.])"),
        (NAME, "creative", r"\b(?:the )?creative commons attribution[ -]no ?deriv(?:ative)?s(?: \d\.\d)?(?: international| unported)?(?: licen[sc]e)?\b"),
        (NAME, "by-nd", r"\bcc[ -]by-nd(?: \d\.\d)?\b"),
        (ADDRESS, "creativecommons", r"creativecommons\.org/licenses/by-nd"),
    ],
    "cc-by-nc": [
        (TAG, "spdx cc-by-nc", r"\bspdx-license-identifier: ?\(?(?:[\w.+-]+ (?:or|and|with) )*cc-by-nc-[1-4]\.0(?![\w.])"),
        (NAME, "creative", r"\b(?:the )?creative commons attribution[ -]non-?commercial(?: \d\.\d)?(?: international| unported)?(?: licen[sc]e)?\b"),
        (NAME, "by-nc", r"\bcc[ -]by-nc(?: \d\.\d)?\b"),
        (ADDRESS, "creativecommons", r"creativecommons\.org/licenses/by-nc"),
    ],
    "cc-by": [
        (NOTICE, "creative licen under", r"\b(?:licen[sc]ed|released|available|published) under (?:the terms of )?(?:the |a )?creative commons attribution(?: \d\.\d)?(?: international)? licen[sc]e\b"),
        (TAG, "spdx cc-by", r"\bspdx-license-identifier: ?\(?(?:[\w.+-]+ (?:or|and|with) )*cc-by-[1-4]\.0(?![\w.])"),
        (NAME, "creative", r"\b(?:the )?creative commons attribution(?: \d\.\d)?(?: international| unported)?(?: licen[sc]e)?\b"),
        (NAME, "cc-by", r"\bcc-by(?: \d\.\d)?\b"),
        (ADDRESS, "creativecommons", r"creativecommons\.org/licenses/by\b"),
    ],
    "public-domain": [
        (NOTICE, "domain", r"\b(?:hereby )?(?:dedicated?|placed?d?|released?) (?:it |this work |this software )?(?:in|into|to) the public domain\b"),
        (REMARK, "domain", r"\bin the public domain\b"),
        (ADDRESS, "creativecommons", r"creativecommons\.org/publicdomain/mark"),
    ],
    "proprietary": [
        (NOTICE, "proprietary", r"\bproprietary and confidential\b"),
        (NOTICE, "confidential", r"\bconfidential and proprietary(?: information)?\b"),
        (NOTICE, "prohibited", r"\bunauthorized (?:copying|use|reproduction|distribution)[^.\n]{0,80} is (?:strictly )?prohibited\b"),
        (NOTICE, "trade", r"\bcontains trade secrets? (?:of|and)\b"),
        (REMARK, "reserved", r"\ball rights reserved\b"),
        (REMARK, "written", r"\bwithout (?:the )?(?:express |prior )*written (?:permission|consent) of\b"),
    ],
    "copyright": [
        (REMARK, "copyright", r"\bcopyright (?:\(c\)|©)? ?\d{4}\b"),
        (REMARK, "©", r"© ?\d{4}\b"),
    ],
    "unspecified": [
        (REMARK, "licen see", r"\bsee (?:the )?(?:accompanying )?licen[sc]e(?:\.(?:txt|md))? (?:file )?for (?:details|more information|the full)"),
        (REMARK, "licen same terms", r"\blicen[sc]ed under the same terms as\b"),
        (REMARK, "licen dual", r"\bdual[- ]licen[sc]ed\b"),
    ],
}


def build() -> list[Rule]:
    """All rules, the first to try first."""
    out = []
    for label, rows in SIGNATURES.items():
        for kind, keywords, pattern in rows:
            out.append(Rule(label, 1000 * kind + len(out), CONFIDENCE[kind], tuple(keywords.split()), re.compile(pattern)))
    return sorted(out, key=lambda r: r.rank)
