"""License scans by ordered signature rules, with DataFrame functions only.

A text becomes its lower-cased words, one space between and around them. Every rule is a keyword, a
pattern over words, a label, a priority and a weight. A rule's pattern runs only where words and
strings stand that each of its matches must have. They are read off the pattern, alternative by
alternative, so no hit is lost: the text's words are met once with the words that rules need, the
rules whose words are all there look for their strings, and what is left runs. Of the rules'
hits, one that lies inside a hit of higher priority - or of equal priority and longer, or equally
long and earlier in the rules - is suppressed. All of it happens inside the row: no exchange.
"""

from __future__ import annotations

from itertools import product
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes that part words, once A-Z are lower-cased.
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Base phrases and their labels: fixed values.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Strings that a place of a pattern may be; beyond so many the place is passed over.
MOST_STRINGS = 64
#: Groups of words that a rule is looked up by.
MOST_GROUPS = 3
#: Priorities: full texts and identifiers, statements, names, mentions.
TEXT, GRANT, NAME, MENTION = 4, 3, 2, 1
WEIGHTS = {TEXT: 0.98, GRANT: 0.9, NAME: 0.7, MENTION: 0.4}

#: label, the ways the license is named, its identifier's words; from public license lists.
FAMILIES = [
    ("mit", "mit(?: x11)?|expat", "mit"),
    ("mit-0", "mit 0|mit no attribution", "mit 0"),
    ("apache-2", "apache(?: software)?(?: license)?(?: version)?(?: v)? ?2(?: 0)?", "apache 2 0"),
    ("apache-1.1", "apache(?: software)?(?: license)?(?: version)? 1 1", "apache 1 1"),
    ("bsd-2-clause", "bsd 2 clause|2 clause bsd|simplified bsd|freebsd", "bsd 2 clause"),
    ("bsd-3-clause", "bsd 3 clause|3 clause bsd|new bsd|revised bsd|modified bsd", "bsd 3 clause"),
    ("bsd-4-clause", "bsd 4 clause|4 clause bsd|original bsd", "bsd 4 clause"),
    ("0bsd", "0bsd|zero clause bsd|bsd zero clause", "0bsd"),
    ("gpl-2", "(?:gnu )?(?:gpl|general public license)(?: version)?(?: v)? ?2|gplv2", "gpl 2 0"),
    ("gpl-3", "(?:gnu )?(?:gpl|general public license)(?: version)?(?: v)? ?3|gplv3", "gpl 3 0"),
    ("gpl", "gnu gpl|gnu general public", "gpl"),
    ("lgpl-2.1", "(?:gnu )?(?:lgpl|lesser general public license)(?: version)?(?: v)? ?2 1|lgplv2 1", "lgpl 2 1"),
    ("lgpl-3", "(?:gnu )?(?:lgpl|lesser general public license)(?: version)?(?: v)? ?3|lgplv3", "lgpl 3 0"),
    ("lgpl", "gnu lgpl|gnu lesser general public|gnu library general public", "lgpl"),
    ("agpl-3", "(?:gnu )?(?:agpl|affero general public license)(?: version)?(?: v)? ?3|agplv3|gnu affero", "agpl 3 0"),
    ("gfdl", "gnu free documentation|gnu fdl", "gfdl 1 3"),
    ("mpl-1.1", "mozilla public license(?: version)? 1 1", "mpl 1 1"),
    ("mpl-2", "mozilla public license(?: version)?(?: v)? 2(?: 0)?|mozilla public", "mpl 2 0"),
    ("epl-1", "eclipse public license(?: version)?(?: v)? 1(?: 0)?", "epl 1 0"),
    ("epl-2", "eclipse public license(?: version)?(?: v)? 2(?: 0)?|eclipse public", "epl 2 0"),
    ("edl-1", "eclipse distribution", "bsd 3 clause eclipse"),
    ("cddl-1", "common development and distribution|cddl", "cddl 1 0"),
    ("cpl-1", "common public", "cpl 1 0"),
    ("ibm-pl", "ibm public", "ipl 1 0"),
    ("artistic-1", "artistic license(?: version)? 1(?: 0)?", "artistic 1 0"),
    ("artistic-2", "artistic license(?: version)? 2(?: 0)?|perl artistic|artistic", "artistic 2 0"),
    ("isc", "isc", "isc"),
    ("zlib", "zlib(?: libpng)?", "zlib"),
    ("libpng", "libpng", "libpng"),
    ("bsl-1", "boost(?: software)?", "bsl 1 0"),
    ("busl-1.1", "business source", "busl 1 1"),
    ("unlicense", "unlicense", "unlicense"),
    ("wtfpl", "wtfpl", "wtfpl"),
    ("cc0", "cc0|creative commons zero", "cc0 1 0"),
    ("cc-by", "cc by(?: [1-4] [0-9])?|creative commons attribution(?: [1-4] [0-9])?", "cc by 4 0"),
    ("cc-by-sa", "cc by sa(?: [1-4] [0-9])?|creative commons attribution share ?alike(?: [1-4] [0-9])?", "cc by sa 4 0"),
    ("cc-by-nd", "cc by nd(?: [1-4] [0-9])?|creative commons attribution no ?deriv(?:s|atives)(?: [1-4] [0-9])?", "cc by nd 4 0"),
    ("cc-by-nc", "cc by nc(?: [1-4] [0-9])?|creative commons attribution non ?commercial(?: [1-4] [0-9])?", "cc by nc 4 0"),
    ("cc-by-nc-sa", "cc by nc sa(?: [1-4] [0-9])?|creative commons attribution non ?commercial share ?alike(?: [1-4] [0-9])?", "cc by nc sa 4 0"),
    ("cc-by-nc-nd", "cc by nc nd(?: [1-4] [0-9])?|creative commons attribution non ?commercial no ?deriv(?:s|atives)(?: [1-4] [0-9])?", "cc by nc nd 4 0"),
    ("odbl", "open database|odbl", "odbl 1 0"),
    ("odc-by", "open data commons attribution|odc by", "odc by 1 0"),
    ("pddl", "public domain dedication and|pddl", "pddl 1 0"),
    ("ofl-1.1", "sil open font|open font", "ofl 1 1"),
    ("psf-2", "python software foundation|psf", "psf 2 0"),
    ("python-2", "python 2 0", "python 2 0"),
    ("ruby", "ruby", "ruby"),
    ("php-3", "php(?: license)?(?: version)? 3(?: 0| 01)?|php", "php 3 01"),
    ("postgresql", "postgresql", "postgresql"),
    ("openssl", "openssl(?: ssleay)?", "openssl"),
    ("vim", "vim", "vim"),
    ("w3c", "w3c(?: software)?", "w3c"),
    ("x11", "x11|mit x consortium", "x11"),
    ("ncsa", "university of illinois ncsa(?: open source)?|ncsa", "ncsa"),
    ("eupl-1.2", "european union public|eupl", "eupl 1 2"),
    ("cecill", "cecill", "cecill 2 1"),
    ("ms-pl", "microsoft public|ms pl", "ms pl"),
    ("ms-rl", "microsoft reciprocal|ms rl", "ms rl"),
    ("upl-1", "universal permissive|upl", "upl 1 0"),
    ("afl-3", "academic free", "afl 3 0"),
    ("osl-3", "open software", "osl 3 0"),
    ("sspl-1", "server side public|sspl", "sspl 1 0"),
    ("elastic-2", "elastic", "elastic 2 0"),
    ("openrail", "open ?rail(?: m)?|responsible ai", "openrail"),
]

#: Sentences of license texts and notices: label, a string that every match has, pattern, priority.
SENTENCES = [
    ("mit", "hereby granted", "permission is hereby granted free of charge to any person obtaining a copy", TEXT),
    ("mit", "noninfringement", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement", TEXT),
    ("isc", "with or without fee", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", TEXT),
    ("bsd-2-clause", "redistribution", "redistribution and use in source and binary forms with or without modification are permitted", TEXT),
    ("bsd-3-clause", "neither the name", "neither the name of(?: [^ ]+){1,12} may be used to endorse or promote products", TEXT),
    ("bsd-4-clause", "advertising materials", "all advertising materials mentioning features or use of this software must display", TEXT),
    ("apache-2", "apache org", "you may not use this file except in compliance with the license(?: [^ ]+){0,12} apache org licenses license 2 0", TEXT),
    ("gpl-2", "either version 2", "free software you can redistribute it and or modify it under the terms of the gnu general public license(?: [^ ]+){0,12} either version 2", TEXT),
    ("gpl-3", "either version 3", "free software you can redistribute it and or modify it under the terms of the gnu general public license(?: [^ ]+){0,12} either version 3", TEXT),
    ("lgpl", "lesser general", "redistribute it and or modify it under the terms of the gnu lesser general public license", TEXT),
    ("agpl-3", "affero", "redistribute it and or modify it under the terms of the gnu affero general public license", TEXT),
    ("mpl-2", "mozilla", "this source code form is subject to the terms of the mozilla public license v 2 0", TEXT),
    ("unlicense", "unencumbered", "this is free and unencumbered software released into the public domain", TEXT),
    ("zlib", "altered source", "altered source versions must be plainly marked as such", TEXT),
    ("bsl-1", "machine executable", "machine executable object code generated by a source language processor", TEXT),
    ("wtfpl", "what the fuck", "do what the fuck you want to public license", TEXT),
    ("ofl-1.1", "font", "this font software is licensed under the sil open font license", TEXT),
    ("cc0", "waived all copyright", "has waived all copyright and related or neighboring rights", TEXT),
    ("public-domain", "public domain", "(?:released|placed|dedicated)(?: [^ ]+){0,3} (?:into|in|to) the public domain", GRANT),
    ("public-domain", "public domain", "public domain", MENTION),
    ("all-rights-reserved", "rights reserved", "all rights reserved", NAME),
    ("proprietary", "proprietary", "proprietary(?: and confidential| license| software)", NAME),
    ("proprietary", "trade secret", "(?:contains|constitutes)(?: [^ ]+){0,4} trade secrets?", NAME),
    ("proprietary", "without", "may not be (?:copied|reproduced|redistributed|distributed)(?: [^ ]+){0,8} without(?: [^ ]+){0,4} (?:permission|consent)", GRANT),
    ("copyright-notice", "copyright", "copyright(?: c)? (?:19|20)[0-9][0-9](?: (?:19|20)[0-9][0-9])?", MENTION),
    ("dual-license", "dual", "dual licensed under", NAME),
    ("non-commercial", "commercial", "(?:for )?non ?commercial (?:use|purposes)(?: only)?", NAME),
    ("no-ai-training", "train", "(?:may|must|shall) not be used (?:for|to)(?: [^ ]+){0,3} (?:train|training)", GRANT),
    ("terms-of-use", "terms of", "subject to(?: [^ ]+){0,2} terms of (?:use|service)", MENTION),
    ("unknown-license", "licen", "see(?: the)?(?: [^ ]+){0,3} licen[cs]e(?: [^ ]+){0,3} (?:file|details|information)", MENTION),
]

#: Clauses of license texts, headers and notices, each written out on its own: label, patterns over words.
CLAUSES = {
    "mit": [
        "(?:the )?above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
        "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicen[cs]e and or sell copies",
        "in no event shall the authors or copyright holders be liable for any claim damages or other liability",
        "whether in an action of contract tort or otherwise arising from out of or in connection with the software",
        "(?:use of )?this source code is governed by an mit style licen[cs]e",
    ],
    "mit-0": ["permission is hereby granted free of charge to any person obtaining a copy(?: [^ ]+){8,14} to deal in the software without restriction(?: [^ ]+){0,24} provided without attribution"],
    "x11": ["except as contained in this notice the name(?: [^ ]+){1,8} shall not be used in advertising or otherwise to promote the sale use or other dealings"],
    "isc": [
        "provided that the above copyright notice and this permission notice appear in all copies",
        "the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
        "be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits",
    ],
    "0bsd": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is"],
    "bsd": [
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer",
        "this software is provided by the (?:copyright holders?|authors?|regents)(?: and contributors)? as is and any express or implied warranties",
        "in no event shall the (?:copyright (?:holders?|owners?)|authors?|regents) (?:or contributors )?be liable for any direct indirect incidental special exemplary or consequential damages",
        "procurement of substitute goods or services loss of use data or profits or business interruption",
        "(?:use of )?this source code is governed by a bsd style licen[cs]e",
    ],
    "bsd-3-clause": [
        "nor the names of its contributors may be used to endorse or promote products derived from this software",
        "the names? of the (?:authors?|contributors?|copyright holders?) may not be used to endorse or promote products derived from this software",
    ],
    "bsd-4-clause": ["this product includes software developed by(?: [^ ]+){1,10} and its contributors"],
    "apache-2": [
        "licensed under the apache licen[cs]e version 2 0 the licen[cs]e",
        "you may obtain a copy of the licen[cs]e at (?:https? )?(?:www )?apache org licen[cs]es",
        "unless required by applicable law or agreed to in writing software distributed under the licen[cs]e is distributed on an as is basis",
        "see the licen[cs]e for the specific language governing permissions and limitations under the licen[cs]e",
        "terms and conditions for use reproduction and distribution 1 definitions",
        "each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright licen[cs]e",
        "derivative works shall mean any work whether in source or object form that is based on or derived from the work",
        "licensed to the apache software foundation asf under one or more contributor licen[cs]e agreements",
    ],
    "apache-1.1": [
        "this product includes software developed by the apache software foundation",
        "products derived from this software may not be called apache nor may apache appear in their name",
    ],
    "gpl": [
        "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty",
        "you should have received a copy of the gnu general public licen[cs]e along with this program",
        "the licen[cs]es for most software are designed to take away your freedom to share and change it",
        "everyone is permitted to copy and distribute verbatim copies of this licen[cs]e document but changing it is not allowed",
        "this file is part of(?: [^ ]+){1,4} which is released under the gnu general public",
    ],
    "gpl-2": [
        "gnu general public licen[cs]e version 2 june 1991",
        "either version 2 of the licen[cs]e or at your option any later version",
        "activities other than copying distribution and modification are not covered by this licen[cs]e",
        "you may copy and distribute verbatim copies of the program s source code as you receive it",
        "under the terms of version 2 of the gnu general public",
        "51 franklin (?:street|st) fifth floor boston ma",
        "59 temple place suite 330 boston ma",
    ],
    "gpl-3": [
        "gnu general public licen[cs]e version 3 29 june 2007",
        "either version 3 of the licen[cs]e or at your option any later version",
        "the gnu general public licen[cs]e is a free copyleft licen[cs]e for software and other kinds of works",
        "to propagate a work means to do anything with it that without permission would make you directly or secondarily liable",
        "conveying under any other circumstances is permitted solely under the conditions stated below",
        "no covered work shall be deemed part of an effective technological measure",
    ],
    "lgpl": [
        "you should have received a copy of the gnu (?:lesser|library) general public licen[cs]e along with this library",
        "this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public",
        "a program that contains no derivative of any portion of the library but is designed to work with the library",
    ],
    "lgpl-2.1": ["either version 2 1 of the licen[cs]e or at your option any later version", "gnu lesser general public licen[cs]e version 2 1 february 1999"],
    "lgpl-3": ["this version of the gnu lesser general public licen[cs]e incorporates the terms and conditions of version 3"],
    "agpl-3": [
        "gnu affero general public licen[cs]e version 3 19 november 2007",
        "all users interacting with it remotely through a computer network",
        "you should have received a copy of the gnu affero general public",
        "specifically designed to ensure cooperation with the community in the case of network server software",
    ],
    "gfdl": [
        "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation",
        "with no invariant sections no front cover texts and no back cover texts",
    ],
    "mpl-1.1": [
        "the contents of this file are subject to the mozilla public licen[cs]e version 1 1",
        "software distributed under the licen[cs]e is distributed on an as is basis without warranty of any kind either express or implied see the licen[cs]e for the specific language governing rights",
        "the initial developer of the original code is",
    ],
    "mpl-2": [
        "if a copy of the mpl was not distributed with this file you can obtain one at",
        "covered software is provided under this licen[cs]e on an as is basis",
        "each contributor hereby grants you a world wide royalty free non exclusive licen[cs]e under intellectual property rights",
        "this source code form is incompatible with secondary licen[cs]es",
    ],
    "epl-1": ["the accompanying program is provided under the terms of this eclipse public licen[cs]e agreement", "this program and the accompanying materials are made available under the terms of the eclipse public licen[cs]e v1 0"],
    "epl-2": ["are made available under the terms of the eclipse public licen[cs]e 2 0", "eclipse public licen[cs]e v ?2 0"],
    "cddl-1": ["the contents of this file are subject to the terms of the common development and distribution", "when distributing covered code include this cddl header"],
    "cpl-1": ["the accompanying program is provided under the terms of this common public"],
    "artistic-1": ["the intent of this document is to state the conditions under which a package may be copied", "you may otherwise modify your copy of this package in any way provided that you insert a prominent notice"],
    "artistic-2": ["this licen[cs]e establishes the terms under which a given free software package may be copied modified distributed and or redistributed", "you are permitted to use the standard version and create and use modified versions for any purpose without restriction"],
    "zlib": [
        "the origin of this software must not be misrepresented you must not claim that you wrote the original software",
        "this notice may not be removed or altered from any source distribution",
        "in no event will the authors be held liable for any damages arising from the use of this software",
    ],
    "libpng": ["the png reference library is supplied as is", "the contributing authors and group 42 inc disclaim all warranties"],
    "bsl-1": ["permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation", "distributed under the boost software licen[cs]e version 1 0", "see accompanying file licen[cs]e 1 0 txt or copy at"],
    "busl-1.1": ["the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use", "change date(?: [^ ]+){1,12} change licen[cs]e", "this licen[cs]e does not grant you any right in any trademark or logo of licensor"],
    "unlicense": [
        "anyone is free to copy modify publish use compile sell or distribute this software",
        "in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest",
        "to be an overt act of relinquishment in perpetuity of all present and future rights",
    ],
    "wtfpl": ["you just do what the fuck you want to", "everyone is permitted to copy and distribute verbatim or modified copies of this licen[cs]e document"],
    "cc0": [
        "the person who associated a work with this deed has dedicated the work to the public domain",
        "you can copy modify distribute and perform the work even for commercial purposes all without asking permission",
        "affirmer hereby overtly fully permanently irrevocably and unconditionally waives abandons and surrenders",
        "no copyright creative commons",
        "creativecommons org publicdomain zero",
    ],
    "cc-by": ["creativecommons org licen[cs]es by [1-4] [0-9]", "you must give appropriate credit provide a link to the licen[cs]e and indicate if changes were made"],
    "cc-by-sa": ["creativecommons org licen[cs]es by sa", "if you remix transform or build upon the material you must distribute your contributions under the same licen[cs]e", "text is available under the creative commons attribution share ?alike"],
    "cc-by-nd": ["creativecommons org licen[cs]es by nd", "if you remix transform or build upon the material you may not distribute the modified material"],
    "cc-by-nc": ["creativecommons org licen[cs]es by nc [1-4] [0-9]", "you may not use the material for commercial purposes"],
    "cc-by-nc-sa": ["creativecommons org licen[cs]es by nc sa"],
    "cc-by-nc-nd": ["creativecommons org licen[cs]es by nc nd"],
    "odbl": ["this(?: [^ ]+){1,4} is made available under the open database licen[cs]e", "opendatacommons org licen[cs]es odbl", "any rights in individual contents of the database are licensed under the database contents licen[cs]e"],
    "odc-by": ["opendatacommons org licen[cs]es by", "is made available under the open data commons attribution"],
    "pddl": ["opendatacommons org licen[cs]es pddl"],
    "ofl-1.1": ["the goals of the open font licen[cs]e ofl are to stimulate worldwide development of collaborative font projects", "no modified version of the font software may use the reserved font name", "neither the font software nor any of its individual components in original or modified versions may be sold by itself"],
    "psf-2": ["python software foundation licen[cs]e version 2", "psf hereby grants licensee a nonexclusive royalty free world wide licen[cs]e", "psf is making python available to licensee on an as is basis"],
    "python-2": ["beopen hereby grants licensee a non exclusive royalty free world wide licen[cs]e", "cnri hereby grants licensee a nonexclusive royalty free world wide licen[cs]e"],
    "ruby": ["you may make and give away verbatim copies of the source form of the software without restriction", "ruby is copyrighted free software by"],
    "php-3": ["this product includes php software freely available from", "products derived from this software may not be called php nor may php appear in their name"],
    "postgresql": ["permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted", "in no event shall the university of california be liable to any party"],
    "openssl": ["this product includes software developed by the openssl project for use in the openssl toolkit", "this product includes cryptographic software written by eric young", "the names openssl toolkit and openssl project must not be used"],
    "vim": ["vim is charityware you can use and copy it as much as you like", "there are no restrictions on distributing unmodified copies of vim"],
    "w3c": ["by obtaining using and or copying this work you the licensee agree that you have read understood and will comply", "permission to copy modify and distribute this work with or without modification for any purpose and without fee or royalty is hereby granted"],
    "ncsa": ["neither the names of(?: [^ ]+){1,12} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "to deal with the software without restriction including without limitation the rights to use copy modify merge"],
    "eupl-1.2": ["licensed under the eupl(?: version)? 1 2", "joinup ec europa eu(?: [^ ]+){0,4} eupl", "the licensor hereby grants you a worldwide royalty free non exclusive sublicensable licen[cs]e"],
    "cecill": ["this software is governed by the cecill(?: [abc])? licen[cs]e under french law", "abiding by the rules of distribution of free software"],
    "ms-pl": ["this licen[cs]e governs use of the accompanying software if you use the software you accept this licen[cs]e", "each contributor grants you a non exclusive worldwide royalty free copyright licen[cs]e to reproduce its contribution"],
    "upl-1": ["subject to the condition set forth below permission is hereby granted to any person obtaining a copy of this software associated documentation and or data"],
    "afl-3": ["licensed under the academic free licen[cs]e version 3 0"],
    "osl-3": ["licensed under the open software licen[cs]e version 3 0"],
    "sspl-1": ["server side public licen[cs]e version 1 october 16 2018", "if you make the functionality of the program or a modified version available to third parties as a service"],
    "elastic-2": ["you may not provide the software to third parties as a hosted or managed service", "by using the software you agree to all of the terms and conditions below", "elastic co licensing elastic licen[cs]e"],
    "openrail": ["you agree not to use the model or derivatives of the model", "use based restrictions(?: [^ ]+){0,8} (?:attachment a|paragraph 5)", "bigscience (?:open ?)?rail"],
    "llama": ["llama [234](?: [0-9])? community licen[cs]e", "you will not use the llama materials or any output or results of the llama materials to improve any other large language model", "built with (?:meta )?llama"],
    "gemma": ["gemma terms of use", "gemma prohibited use policy"],
    "apache-with-llvm": ["apache licen[cs]e v2 0 with llvm exceptions?"],
    "classpath-exception": ["linking this library statically or dynamically with other modules is making a combined work based on this library"],
    "gcc-exception": ["gcc runtime library exception"],
    "commons-clause": ["the software is provided to you by the licensor under the licen[cs]e(?: [^ ]+){0,6} subject to the following condition", "commons clause licen[cs]e condition", "the grant of rights under the licen[cs]e will not include and the licen[cs]e does not grant to you the right to sell the software"],
    "json": ["the software shall be used for good not evil"],
    "beerware": ["if we meet some day and you think this stuff is worth it you can buy me a beer in return", "beer ware licen[cs]e"],
    "sqlite-blessing": ["may you do good and not evil may you find forgiveness for yourself and forgive others"],
    "curl": ["permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice"],
    "icu": ["unicode inc licen[cs]e agreement data files and software", "permission is hereby granted free of charge to any person obtaining a copy of the unicode data files"],
    "hpnd": ["permission to use copy modify and distribute this software and its documentation for any purpose(?: and)? without fee is hereby granted provided that"],
    "intel-simplified": ["no reverse engineering decompilation or disassembly of this software is permitted"],
    "public-domain": ["this (?:file|code|work|software) (?:is|has been) (?:hereby )?(?:placed )?in(?:to)? the public domain", "no copyright is claimed", "not subject to copyright protection(?: [^ ]+){0,6} public domain", "work of the u(?:nited)? ?s(?:tates)? government(?: [^ ]+){0,12} (?:public domain|not subject to copyright)"],
    "ogl-uk-3": ["contains public sector information licensed under the open government licen[cs]e v3 0", "open government licen[cs]e"],
    "no-ai-training": [
        "(?:may|must|shall|can) not be used (?:for|to|in)(?: [^ ]+){0,6} (?:machine learning|artificial intelligence|generative ai|language models?)",
        "(?:prohibit|prohibits|prohibited|forbid|forbids|forbidden)(?: [^ ]+){0,6} (?:text and data mining|training of (?:ai|artificial|machine|language))",
        "no part of this (?:book|work|publication|site|website) may be used(?: [^ ]+){0,8} (?:train|training)(?: [^ ]+){0,4} (?:artificial intelligence|ai|models?)",
        "the rights ?holder reserves(?: [^ ]+){0,8} text and data mining",
    ],
    "proprietary": [
        "no part of this (?:publication|book|document|work) may be reproduced(?: stored in a retrieval system)?",
        "unauthorized (?:copying|reproduction|distribution|use)(?: [^ ]+){0,8} (?:is )?(?:strictly )?prohibited",
        "for internal use only",
        "this (?:document|software|material) contains confidential(?: and proprietary)? information",
        "licensed not sold",
        "you may not (?:copy|modify|rent|lease|sell|distribute)(?: [^ ]+){0,10} (?:the|this) software",
        "reverse engineer decompile or disassemble",
        "end user licen[cs]e agreement",
        "used under licen[cs]e from",
    ],
    "non-commercial": ["not (?:be used )?for commercial (?:use|purposes)", "for (?:personal|academic|educational|research)(?: and (?:personal|academic|educational|research))? use only", "commercial use(?: [^ ]+){0,4} (?:is )?(?:strictly )?(?:prohibited|forbidden|not allowed|not permitted)"],
    "all-rights-reserved": ["(?:tous droits|alle rechte|todos los derechos) (?:reserves|réservés|vorbehalten|reservados)"],
}


def rules() -> list[tuple[str, str, str, int]]:
    """(label, keyword, pattern, priority) in order: sentences and clauses, then for each license its
    identifier, statements that grant it, and its name. Every match has the keyword, which may be empty."""
    out = [(label, keyword, rf"(?<= )(?:{pattern})(?= )", priority) for label, keyword, pattern, priority in SENTENCES]
    notices = {"proprietary": NAME, "non-commercial": NAME, "all-rights-reserved": NAME, "no-ai-training": GRANT}
    out += [(label, "", rf"(?<= )(?:{pattern})(?= )", notices.get(label, TEXT)) for label, patterns in CLAUSES.items() for pattern in patterns]
    for label, names, identifier in FAMILIES:
        name = rf"(?:{names})"
        out += [
            (label, "spdx", rf"(?<= )spdx(?: license)? identifier {identifier}(?: only| or later)?(?= )", TEXT),
            (label, "", rf"(?<= )(?:licensed|released|distributed|available|published|provided|covered|governed|shared|offered) (?:[^ ]+ ){{0,4}}(?:under|by) (?:the )?(?:terms of )?(?:the )?{name}(?: licen[cs]e)?(?= )", GRANT),
            (label, "licen", rf"(?<= )under(?: the)?(?: terms of)?(?: the)? {name} licen[cs]e(?: version)?(?: [0-9]+){{0,2}}(?= )", GRANT),
            (label, "licen", rf"(?<= ){name} licen[cs]ed?(?: version)?(?: [0-9]+){{0,2}}(?= )", NAME),
        ]
    return out


def exactly(items) -> set[str] | None:  # noqa: ANN001
    """All strings that a parsed pattern matches; None where they are not few."""
    out = {""}
    for op, of in items:
        match str(op):
            case "LITERAL": each = {chr(of)}
            case "IN": each = {chr(c) for _, c in of} if all(str(o) == "LITERAL" for o, _ in of) else None
            case "SUBPATTERN": each = exactly(of[3])
            case "BRANCH": each = None if None in (parts := [exactly(x) for x in of[1]]) else set().union(*parts)
            case "ASSERT": each = {" "}  # of a space, before all else or behind it
            case "MAX_REPEAT": each = {""} | one if of[:2] == (0, 1) and (one := exactly(of[2])) is not None else None
            case _: each = None
        if each is None or len(out) * len(each) > MOST_STRINGS:
            return None
        out = {a + b for a, b in product(out, each)}
    return out


def needed(pattern: str) -> tuple[tuple[str, ...], ...]:
    """Of each of these groups every match of the pattern, with the spaces around it, has a string."""

    def groups(items, before: set[str]) -> tuple[list[set[str]], set[str]]:  # noqa: ANN001
        """The groups that are closed and the strings that the next item may continue."""
        closed, run = [], before
        for item in items:
            op, of = str(item[0]), item[1]
            each = exactly([item])
            if each is not None and len(run) * len(each) <= MOST_STRINGS:
                run = {a + b for a, b in product(run, each)}
            elif each is not None:
                closed, run = [*closed, run], each
            elif op == "SUBPATTERN":
                more, run = groups(of[3], run)
                closed += more
            elif op == "BRANCH":
                best = []
                for x in of[1]:
                    more, last = groups(x, run)
                    best.append(max([*more, last], key=lambda g: min(map(len, g))))
                closed, run = [*closed, set().union(*best)], {""}
            else:
                closed, run = [*closed, run], {""}
        return closed, run

    closed, last = groups(_parser.parse(pattern), {""})
    # a string that holds another of its group says nothing more
    lean = (tuple(sorted(s for s in g if not any(o != s and o in s for o in g))) for g in [*closed, last])
    return tuple(dict.fromkeys(g for g in lean if min(map(len, g)) > 1))


def key_words(groups: tuple[tuple[str, ...], ...]) -> list[list[str]]:
    """Groups of whole words of which every match has one: of each string the longest word that stands
    between spaces; the groups with the longest such words. None, where no group has one in all strings."""
    out = []
    for g in groups:
        whole = [s.split(" ")[1:-1] for s in g]
        if all(whole):
            words = [sorted(w, key=len, reverse=True) for w in whole]
            # of a string alone several words count, each for itself
            out += [[w] for w in words[0][:MOST_GROUPS]] if len(g) == 1 else [sorted({w[0] for w in words})]
    out.sort(key=lambda words: min(map(len, words)), reverse=True)
    return out[:MOST_GROUPS]


def normal(text: Column) -> Column:
    """The words of text, lower-cased, a space between and around them; a single space without words.
    Other than A-Z, letters that lower() changes stay parts of the same words."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), BREAK, " ")), F.lit(" "))


def spaces(text: Column) -> Column:
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit(" "), F.lit("")))


HIT = "struct<lo:int,hi:int,priority:int,rule:int,first:int,words:int>"


def hits(norm: Column, rule: Column, number: Column) -> Column:
    """Where the rule's pattern matches: array of (lo, -hi, -priority, rule, first word, words), so that
    it sorts well. Places and words are counted along the matches and what lies between them."""
    found = F.regexp_extract_all(norm, rule["pattern"], F.lit(0))
    rest = F.split(norm, rule["pattern"], -1)
    kind = f"struct<at:int,word:int,hits:array<{HIT}>>"

    def step(a: Column, m: Column, p: Column) -> Column:
        lo, word = a["at"] + F.length(p), a["word"] + spaces(p)
        hit = F.struct(lo.alias("lo"), (-lo - F.length(m)).alias("hi"), (-rule["priority"]).alias("priority"), number.alias("rule"), (word - 1).alias("first"), (spaces(m) + 1).alias("words"))
        return F.struct((lo + F.length(m)).alias("at"), (word + spaces(m)).alias("word"), F.concat(a["hits"], F.array(hit)).alias("hits"))

    pairs = F.zip_with(found, F.slice(rest, 1, F.size(found)), lambda m, p: F.struct(m.alias("m"), p.alias("p")))
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("word"), F.array().cast(f"array<{HIT}>").alias("hits")).cast(kind)
    return F.aggregate(pairs, start, lambda a, x: step(a, x["m"], x["p"]).cast(kind), lambda a: a["hits"])


def standing(found: Column) -> Column:
    """The hits that no other suppresses, in order of place. Sorted by start, longest first, a hit
    lies inside an earlier one exactly if one of those ends no sooner: the furthest end of each
    priority is all that has to be kept."""
    hit = f"array<{HIT}>"
    kind = f"struct<ends:array<int>,hits:{hit}>"
    order = F.array_sort(found)

    def step(a: Column, h: Column) -> Column:
        inside = F.exists(F.sequence(-h["priority"], F.lit(TEXT)), lambda p: F.element_at(a["ends"], p) >= -h["hi"])
        ends = F.transform(a["ends"], lambda e, i: F.when(i + 1 == -h["priority"], F.greatest(e, -h["hi"])).otherwise(e))
        return F.struct(ends.alias("ends"), F.when(inside, a["hits"]).otherwise(F.concat(a["hits"], F.array(h))).alias("hits")).cast(kind)

    start = F.struct(F.array_repeat(F.lit(-1), TEXT).alias("ends"), F.array().cast(hit).alias("hits")).cast(kind)
    return F.aggregate(order, start, step, lambda a: a["hits"])


def scan(docs: DataFrame, more_rules: list[tuple[str, str, str, int]] | None = None) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections), a
    row for each row of docs.

    n_base counts all places of the base phrases, first_word and last_word are the smallest and
    largest start among them (words from 0; null without any). labels has the base labels and those
    of the standing detections: array of (first_word, n_words, label, priority). score is the largest
    weight behind a label, 0 without labels. Null text counts as empty. Other columns are ignored.
    A rule of more_rules is looked at where its own keyword stands, nothing else is asked of it.
    """
    given = rules()
    table = given + (more_rules or [])
    wanted = [needed(p) for _, _, p, _ in given] + [((k,),) if k else () for _, k, _, _ in more_rules or []]
    by_word = [key_words(w) for w in wanted[: len(given)]] + [[] for _ in more_rules or []]
    # one string a rule keeps the plan small: groups between line ends, strings between tabs
    strings = lambda groups: F.lit("\n".join(map("\t".join, groups)))
    literal = F.array(*(F.struct(strings(by_word[i]).alias("words"), strings(wanted[i]).alias("wanted"), F.lit(p).alias("pattern"), F.lit(x).alias("label"), F.lit(n).alias("priority"), F.lit(i).alias("number")) for i, (x, _, p, n) in enumerate(table)))
    all_words = F.split(F.lit("\t".join(sorted({w for groups in by_word for g in groups for w in g}))), "\t")
    base = f"(?<= )(?:{'|'.join(BASE)})(?= )"
    rows = docs.select(F.col("doc_id").cast("long"), normal(F.col("text").cast("string")).alias("norm"))
    any_base = F.lit(False)
    for phrase in BASE:
        any_base = any_base | F.contains("norm", F.lit(f" {phrase} "))
    n_words = F.when(F.col("norm") == "  ", 0).otherwise(spaces(F.col("norm")) - 1).cast("long")
    rows = rows.select("doc_id", "norm", n_words.alias("n_words"), any_base.alias("based"), F.array_intersect(F.split("norm", " "), all_words).alias("there"))
    groups = lambda r, of: F.filter(F.split(r[of], "\n"), lambda g: g != "")
    near = F.filter(literal, lambda r: F.forall(groups(r, "words"), lambda g: F.arrays_overlap(F.split(g, "\t"), F.col("there"))))
    fired = F.filter(near, lambda r: F.forall(groups(r, "wanted"), lambda g: F.exists(F.split(g, "\t"), lambda s: F.contains(F.col("norm"), s))))
    found = standing(F.flatten(F.transform(fired, lambda r: hits(F.col("norm"), r, r["number"]))))
    # a rule that no word leads to is looked at in every text
    rows = rows.withColumn("found", found if any(not g for g in by_word) else F.when(F.size("there") > 0, found))
    of = lambda h, what: F.element_at(literal, h["rule"] + 1)[what]
    detection = lambda h: F.struct(h["first"].alias("first_word"), h["words"].alias("n_words"), of(h, "label").alias("label"), (-h["priority"]).alias("priority"))
    rows = rows.withColumn("detections", F.coalesce(F.transform("found", detection), F.array().cast("array<struct<first_word:int,n_words:int,label:string,priority:int>>")))
    of_base = F.array_compact(F.array(*(F.when(F.contains("norm", F.lit(f" {p} ")), F.lit(x)) for p, x in BASE.items())))
    rows = rows.withColumn("base", F.when(F.col("based"), of_base).otherwise(F.array().cast("array<string>")))
    weight = F.array_max(F.transform("detections", lambda d: F.element_at(F.array(*(F.lit(WEIGHTS[i]) for i in range(1, TEXT + 1))), d["priority"])))
    return rows.select(
        "doc_id",
        "n_words",
        F.when(F.col("based"), F.regexp_count("norm", F.lit(base))).otherwise(0).cast("long").alias("n_base"),
        F.when(F.col("based"), spaces(F.regexp_extract("norm", f"(?s)^(.*?){base}", 1)) - 1).cast("long").alias("first_word"),
        F.when(F.col("based"), spaces(F.regexp_extract("norm", f"(?s)^(.*){base}", 1)) - 1).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct("base")), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.transform("detections", lambda d: d["label"]))), ",").alias("labels"),
        F.greatest(F.when(F.col("based"), 0.9).otherwise(0.0), F.coalesce(weight, F.lit(0.0))).alias("score"),
        "detections",
    )
