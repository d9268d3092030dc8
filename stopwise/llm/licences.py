"""Licence scans by sentence rules, with DataFrame functions only.

A text is cut into sentences at ``.``, ``!`` and ``?`` before white space, at a colon that ends a line, and at lines without letters
or digits; lines that are only wrapped belong together. Each sentence is normalised (lower case, letters and digits, known spellings, the
many ways to say "licensed under the" as one word) and mapped to the identifiers of the known licence sentences that it is or holds,
whole words only; a known sentence inside a longer known one at the same place does not count. What is found is the text's ordered
sequence of sentence identifiers, against which the licence rules run in their order: a rule is a sequence of identifiers with at most
``GAP`` foreign ones between two; what it matches is used up, so that a full licence is not reported again by a part of itself.

``SPDX-License-Identifier:`` lines are sentences of their own, whose identifiers are taken apart at OR, AND and WITH. Titles (``MIT License``)
count only as a whole sentence. The families of GNU and Creative Commons licences are written by rule, in every version.

No row is shuffled and nothing is sent out: the tables are literals. Texts without a trigger word are not cut at all.
Edge cases: null and empty texts have no sentence; the same licence found twice is named once, in the order of
the rules; no text is cut short.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GAP = 3
# Parts of words without which no known sentence occurs, in whatever spelling; each has letters only.
TRIGGERS = ("licen", "under", "permi", "redistribut", "warrant", "copy", "domain", "liable", "spdx", "reserved", "software", "reproduc", "commons", "fuck")
# Short names as they stand after "licensed under the", with the identifier.
NAMES = (
    ("mit license", "MIT"), ("mit", "MIT"), ("mit x11 license", "MIT"), ("mit expat license", "MIT"), ("expat license", "MIT"), ("x11 license", "X11"), ("isc license", "ISC"), ("isc", "ISC"), ("mit no attribution license", "MIT-0"),
    ("zlib license", "Zlib"), ("zlib libpng license", "Zlib"), ("boost software license version 1 0", "BSL-1.0"), ("boost software license", "BSL-1.0"), ("boost license", "BSL-1.0"),
    ("apache license version 2 0", "Apache-2.0"), ("apache license version 2", "Apache-2.0"), ("apache license 2 0", "Apache-2.0"), ("apache 2 0 license", "Apache-2.0"), ("apache 2 license", "Apache-2.0"), ("apache 2 0", "Apache-2.0"), ("apache version 2 0", "Apache-2.0"), ("asl 2 0", "Apache-2.0"),
    ("apache license version 1 1", "Apache-1.1"), ("apache software license version 1 1", "Apache-1.1"), ("apache license", "Apache"), ("apache software license", "Apache"),
    ("bsd license", "BSD"), ("bsd style license", "BSD"), ("bsd", "BSD"), ("bsd 2 clause license", "BSD-2-Clause"), ("2 clause bsd license", "BSD-2-Clause"), ("simplified bsd license", "BSD-2-Clause"), ("freebsd license", "BSD-2-Clause"), ("bsd 2 clause", "BSD-2-Clause"),
    ("bsd 3 clause license", "BSD-3-Clause"), ("3 clause bsd license", "BSD-3-Clause"), ("new bsd license", "BSD-3-Clause"), ("modified bsd license", "BSD-3-Clause"), ("revised bsd license", "BSD-3-Clause"), ("bsd 3 clause", "BSD-3-Clause"), ("bsd 4 clause license", "BSD-4-Clause"), ("zero clause bsd license", "0BSD"), ("bsd zero clause license", "0BSD"),
    ("mozilla public license version 2 0", "MPL-2.0"), ("mozilla public license 2 0", "MPL-2.0"), ("mpl 2 0", "MPL-2.0"), ("mpl version 2 0", "MPL-2.0"), ("mozilla public license version 1 1", "MPL-1.1"), ("mozilla public license 1 1", "MPL-1.1"), ("mozilla public license", "MPL"),
    ("eclipse public license version 1 0", "EPL-1.0"), ("eclipse public license 1 0", "EPL-1.0"), ("eclipse public license version 2 0", "EPL-2.0"), ("eclipse public license 2 0", "EPL-2.0"), ("eclipse distribution license version 1 0", "BSD-3-Clause"),
    ("common development and distribution license version 1 0", "CDDL-1.0"), ("common development and distribution license", "CDDL"), ("common public license version 1 0", "CPL-1.0"),
    ("european union public license version 1 2", "EUPL-1.2"), ("eupl version 1 2", "EUPL-1.2"), ("eupl 1 2", "EUPL-1.2"), ("artistic license 2 0", "Artistic-2.0"), ("artistic license", "Artistic-1.0"), ("academic free license version 3 0", "AFL-3.0"),
    ("sil open font license version 1 1", "OFL-1.1"), ("sil open font license", "OFL-1.1"), ("universal permissive license version 1 0", "UPL-1.0"), ("university of illinois open source license", "NCSA"), ("microsoft public license", "MS-PL"), ("ms pl", "MS-PL"), ("open software license version 3 0", "OSL-3.0"),
    ("postgresql license", "PostgreSQL"), ("python software foundation license", "PSF-2.0"), ("psf license", "PSF-2.0"), ("unlicense", "Unlicense"), ("wtfpl", "WTFPL"), ("do what the fuck you want to public license", "WTFPL"), ("ruby license", "Ruby"), ("php license version 3 01", "PHP-3.01"), ("server side public license version 1", "SSPL-1.0"),
    ("business source license 1 1", "BUSL-1.1"), ("elastic license 2 0", "Elastic-2.0"), ("same terms as perl itself", "Artistic-1.0-Perl OR GPL-1.0-or-later"), ("open data commons open database license", "ODbL-1.0"), ("open database license", "ODbL-1.0"),
)
# Whole sentences that are only a licence's title.
TITLES = (
    ("mit license", "MIT"), ("the mit license", "MIT"), ("the mit license mit", "MIT"), ("mit license mit", "MIT"), ("isc license", "ISC"), ("the isc license", "ISC"), ("bsd 2 clause license", "BSD-2-Clause"), ("bsd 3 clause license", "BSD-3-Clause"), ("the bsd 3 clause license", "BSD-3-Clause"),
    ("apache license version 2 0 january 2004", "Apache-2.0"), ("apache license version 2 0", "Apache-2.0"), ("gnu general public license version 2 june 1991", "GPL-2.0"), ("gnu general public license version 3 29 june 2007", "GPL-3.0"), ("gnu lesser general public license version 2 1 february 1999", "LGPL-2.1"),
    ("gnu lesser general public license version 3 29 june 2007", "LGPL-3.0"), ("gnu affero general public license version 3 19 november 2007", "AGPL-3.0"), ("mozilla public license version 2 0", "MPL-2.0"), ("boost software license version 1 0 august 17th 2003", "BSL-1.0"), ("eclipse public license version 1 0", "EPL-1.0"),
    ("eclipse public license version 2 0", "EPL-2.0"), ("creative commons legal code cc0 1 0 universal", "CC0-1.0"), ("sil open font license version 1 1 26 february 2007", "OFL-1.1"), ("do what the fuck you want to public license", "WTFPL"), ("the unlicense", "Unlicense"), ("zlib license", "Zlib"),
)
# Known sentences of licence texts, or the part of them that no name of a holder changes, with their identifier.
SENTENCES = (
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions", "MITgrant"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so", "MIT0grant"),
    ("the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "MITnotice"),
    ("the above copyright notice and this permission notice including the next paragraph shall be included in all copies or substantial portions of the software", "MITnotice"),
    ("the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement", "MITasis"),
    ("in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software", "MITliable"),
    ("except as contained in this notice the name of the x consortium shall not be used in advertising or otherwise to promote the sale use or other dealings in this software without prior written authorization from the x consortium", "X11name"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "ISCgrant"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "0BSDgrant"),
    ("disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness", "ISCasis"),
    ("be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software", "ISCliable"),
    ("permission to use copy modify and distribute this software and its documentation for any purpose without fee is hereby granted provided that the above copyright notice appear in all copies and that both that copyright notice and this permission notice appear in supporting documentation", "HPNDgrant"),
    ("permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies", "PGgrant"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "BSDgrant"),
    ("redistribution and use in source and binary forms with or without modification are permitted subject to the limitations in the disclaimer below provided that the following conditions are met", "BSDclear"),
    ("redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "BSDsource"),
    ("redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", "BSDbinary"),
    ("may be used to endorse or promote products derived from this software without specific prior written permission", "BSDendorse"),
    ("all advertising materials mentioning features or use of this software must display the following acknowledgement", "BSDadvert"),
    ("the end user documentation included with the redistribution if any must include the following acknowledgment", "AP11ack"),
    ("products derived from this software may not be called apache nor may apache appear in their name without prior written permission of the apache software foundation", "AP11name"),
    ("and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed", "BSDasis"),
    ("be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability", "BSDliable"),
    ("you may not use this file except in compliance with the license", "APcompliance"),
    ("you may obtain a copy of the license at", "APcopy"),
    ("unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", "APasis"),
    ("see the license for the specific language governing permissions and limitations under the license", "APsee"),
    ("terms and conditions for use reproduction and distribution", "APterms"),
    ("subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license to reproduce prepare derivative works of publicly display publicly perform sublicense and distribute the work and such derivative works in source or object form", "APgrant"),
    ("is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose", "GPLasis"),
    ("you should have received a copy of the gnu general public license along with this program", "GPLcopy"),
    ("everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed", "GPLverbatim"),
    ("the licenses for most software are designed to take away your freedom to share and change it", "GPL2preamble"),
    ("the gnu general public license is a free copyleft license for software and other kinds of works", "GPL3preamble"),
    ("the gnu affero general public license is a free copyleft license for software and other kinds of works specifically designed to ensure cooperation with the community in the case of network server software", "AGPL3preamble"),
    ("this source code form is subject to the terms of the mozilla public license version 2 0", "MPLsubject"),
    ("if a copy of the mpl was not distributed with this file you can obtain one at", "MPLobtain"),
    ("the contents of this file are subject to the mozilla public license version 1 1", "MPL11subject"),
    ("the contents of this file are subject to the terms of the common development and distribution license", "CDDLsubject"),
    ("this is free and unencumbered software released into the public domain", "UNLrelease"),
    ("anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means", "UNLgrant"),
    ("this software is provided as is without any express or implied warranty", "ZLIBasis"),
    ("be held liable for any damages arising from the use of this software", "ZLIBliable"),
    ("permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions", "ZLIBgrant"),
    ("the origin of this software must not be misrepresented you must not claim that you wrote the original software", "ZLIBorigin"),
    ("permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following", "BSLgrant"),
    ("permission is hereby granted free of charge to any person obtaining a copy of the font software to use study copy merge embed modify redistribute and sell modified and unmodified copies of the font software subject to the following conditions", "OFLgrant"),
    ("you just do what the fuck you want to", "WTFPLterms"),
    ("everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed", "WTFPLcopy"),
    ("have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide", "CC0dedicate"),
    ("has waived all copyright and related or neighboring rights to", "CC0waive"),
    ("this work has been dedicated to the public domain", "PDdedicate"),
    ("all rights reserved", "RESERVED"),
)
# Identifiers of the software package data exchange list that stand on its tagged lines.
SPDX = (
    "0BSD AFL-2.1 AFL-3.0 AGPL-3.0 AGPL-3.0-only AGPL-3.0-or-later Apache-1.0 Apache-1.1 Apache-2.0 APSL-2.0 Artistic-1.0 Artistic-1.0-Perl Artistic-2.0 BlueOak-1.0.0 BSD-1-Clause "
    "BSD-2-Clause BSD-2-Clause-Patent BSD-3-Clause BSD-3-Clause-Clear BSD-4-Clause BSD-Source-Code BSL-1.0 BUSL-1.1 CC-BY-1.0 CC-BY-2.0 CC-BY-2.5 CC-BY-3.0 CC-BY-4.0 CC-BY-NC-3.0 CC-BY-NC-4.0 CC-BY-NC-ND-4.0 CC-BY-NC-SA-4.0 CC-BY-ND-4.0 "
    "CC-BY-SA-3.0 CC-BY-SA-4.0 CC-PDDC CC0-1.0 CDDL-1.0 CDDL-1.1 CPAL-1.0 CPL-1.0 curl ECL-2.0 EFL-2.0 Elastic-2.0 EPL-1.0 EPL-2.0 EUPL-1.1 EUPL-1.2 FSFAP FTL GFDL-1.2-or-later GFDL-1.3-only GFDL-1.3-or-later "
    "GPL-1.0-only GPL-1.0-or-later GPL-1.0+ GPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-2.0+ GPL-3.0 GPL-3.0-only GPL-3.0-or-later GPL-3.0+ HPND ICU IJG IPL-1.0 ISC "
    "LGPL-2.0 LGPL-2.0-only LGPL-2.0-or-later LGPL-2.0+ LGPL-2.1 LGPL-2.1-only LGPL-2.1-or-later LGPL-2.1+ LGPL-3.0 LGPL-3.0-only LGPL-3.0-or-later LGPL-3.0+ Libpng libtiff Linux-OpenIB "
    "MIT MIT-0 MIT-CMU MPL-1.0 MPL-1.1 MPL-2.0 MPL-2.0-no-copyleft-exception MS-PL MS-RL MulanPSL-2.0 NCSA ODbL-1.0 OFL-1.0 OFL-1.1 OpenSSL OSL-3.0 PHP-3.01 PostgreSQL PSF-2.0 Python-2.0 QPL-1.0 Ruby "
    "SSPL-1.0 TCL Unicode-3.0 Unicode-DFS-2016 Unlicense UPL-1.0 Vim W3C WTFPL X11 Xnet Zend-2.0 Zlib ZPL-2.1 Classpath-exception-2.0 GCC-exception-3.1 LLVM-exception Linux-syscall-note"
).split()
# Patterns of the normal form, applied in turn to a lower-cased sentence; the same in Java, Python and DuckDB.
NORMAL = (
    (r"[^a-z0-9+]+", " "),
    (r"([0-9])\+", "$1 plus "),
    (r"[ +]+", " "),
    (r"\blicence", "license"),
    (r"\b(a?gpl|lgpl) ?(?:v|ver|version)? ?([0-9])", "$1 version $2"),
    (r"\bv(?:er)? ?([0-9])", "version $1"),
    (r"\b(?:gnu )?agpl\b(?: license)?", "gnu affero general public license"),
    (r"\b(?:gnu )?lgpl\b(?: license)?|\bgnu library general public license", "gnu lesser general public license"),
    (r"\b(?:gnu )?gpl\b(?: license)?", "gnu general public license"),
    (r" as published by the free software foundation", " published"),
    (r"\b(?:or )?(?:at your option )?(?:or )?any later version", "or later"),
    (r"\beither version", "version"),
    (r"\bversion ([0-9]+(?: [0-9]+)?) of the license", "version $1"),
    (r"\band or\b", "and"),
    (r"\bcreative commons", "cc"),
    (r"\battribution\b", "by"),
    (r"\bnon ?commercial\b", "nc"),
    (r"\bshare ?alike\b", "sa"),
    (r"\bno ?deriv(?:ative)?s?(?: works)?\b", "nd"),
    (
        r"\b(?:licensed|released|distributed|redistributed|available|published|covered|governed|provided|offered|placed|modify it|modify this [a-z]+|modify them|used) (?:to you )?(?:only )?under "
        r"(?:either of |either |both |one of )?(?:the |a |an )?(?:terms (?:and conditions )?(?:of |in )?(?:either of |either |both )?(?:the |a |an )?)?",
        "licensedunder ",
    ),
    (r" +", " "),
    (r"^ | $", ""),
)
#: In a sentence that names a licence after "licensed under", another name after "or" or "and" counts likewise.
FURTHER = (r"\b(?:or|and)(?: the| a)? (mit|apache|bsd|gnu|gpl|lgpl|agpl|mpl|mozilla|isc|zlib|boost|eclipse|eupl|cc|creative|artistic|unlicense|wtfpl|sil)\b", "licensedunder $1")
# What is done to the lower-cased text before it is cut.
BEFORE = ((r"(^|[^a-z0-9])v\. ?([0-9])", "$1version $2"), (r"(spdx-license-identifier:[^\n]*)", "\n\n$1\n\n"))
SENTENCE_END = r"[.!?]+[ \t\r\n]+|:[ \t\r]*\n|\n[^a-z0-9\n]*\n|[.!?]+$"
_SPDX_TAG, _SPDX_CUT = "spdx license identifier ", " (?:or|and|with) "


def normal(sentence: str) -> str:
    """The normal form as the queries make it."""
    sentence = sentence.lower()
    for pattern, to in NORMAL:
        sentence = re.sub(pattern, to.replace("$1", r"\1").replace("$2", r"\2"), sentence, flags=re.A)
    return re.sub(FURTHER[0], FURTHER[1].replace("$1", r"\1"), sentence) if "licensedunder" in sentence else sentence


def families() -> list[tuple[str, str]]:
    """Names of the GNU and Creative Commons licences in each version, written by rule in their normal form."""
    out = [("cc0 1 0", "CC0-1.0"), ("cc0", "CC0-1.0"), ("cc zero version 1 0 universal license", "CC0-1.0")]
    for kind, code, versions in (("", "GPL", ("1", "2", "3")), ("lesser ", "LGPL", ("2", "2 1", "3")), ("affero ", "AGPL", ("1", "3"))):
        name = f"gnu {kind}general public license"
        out.append((name, code))
        for v in versions:
            number = v.replace(" ", ".") if " " in v else f"{v}.0"
            for said in sorted({v, number.replace(".", " ")}):
                exact, after = f"{name} version {said}", f"{name} published version {said}"
                out += [(x, f"{code}-{number}") for x in (exact, f"{name} {said}", f"version {said} of the {name}")]
                out += [(x, f"{code}-{number}-only") for x in (f"{exact} only", f"{exact} published", after)]
                out += [(x, f"{code}-{number}-or-later") for x in (f"{exact} or later", f"{exact} plus", f"{exact} published or later", f"{after} or later", f"version {said} of the {name} or later")]
    for kind in ("by", "by sa", "by nc", "by nd", "by nc sa", "by nc nd"):
        for v in ("1.0", "2.0", "2.5", "3.0", "4.0"):
            out += [(f"cc {kind} {x}{v.replace('.', ' ')}", f"CC-{kind.upper().replace(' ', '-')}-{v}") for x in ("", "version ")]
    return out


# Rules in their order; the identifiers must follow each other.
RULES = (
    ("X11", ("MITgrant", "MITnotice", "MITasis", "X11name")), ("MIT", ("MITgrant", "MITnotice", "MITasis", "MITliable")), ("MIT", ("MITgrant", "MITnotice")), ("MIT", ("MITgrant",)), ("MIT-0", ("MIT0grant", "MITasis")), ("MIT-0", ("MIT0grant",)),
    ("ISC", ("ISCgrant", "ISCasis", "ISCliable")), ("ISC", ("ISCgrant", "ISCasis")), ("ISC", ("ISCgrant",)), ("0BSD", ("0BSDgrant", "ISCasis")), ("0BSD", ("0BSDgrant",)), ("PostgreSQL", ("PGgrant",)), ("HPND", ("HPNDgrant",)),
    ("Apache-1.1", ("BSDgrant", "BSDsource", "BSDbinary", "AP11ack", "AP11name")), ("BSD-4-Clause", ("BSDgrant", "BSDsource", "BSDbinary", "BSDadvert", "BSDendorse")), ("BSD-3-Clause-Clear", ("BSDclear", "BSDsource", "BSDbinary", "BSDendorse")),
    ("BSD-3-Clause", ("BSDgrant", "BSDsource", "BSDbinary", "BSDendorse", "BSDasis")), ("BSD-3-Clause", ("BSDgrant", "BSDsource", "BSDbinary", "BSDendorse")), ("BSD-2-Clause", ("BSDgrant", "BSDsource", "BSDbinary", "BSDasis")), ("BSD-2-Clause", ("BSDgrant", "BSDsource", "BSDbinary")),
    ("Apache-2.0", ("TITLE_Apache-2.0", "APterms", "APgrant")), ("Apache-2.0", ("NAME_Apache-2.0", "APcompliance", "APcopy", "APasis")), ("Apache-2.0", ("NAME_Apache-2.0", "APcompliance")), ("Apache-2.0", ("APgrant",)),
    ("GPL-2.0", ("TITLE_GPL-2.0", "GPLverbatim", "GPL2preamble")), ("GPL-3.0", ("TITLE_GPL-3.0", "GPLverbatim", "GPL3preamble")), ("GPL-3.0", ("GPL3preamble",)), ("AGPL-3.0", ("TITLE_AGPL-3.0", "GPLverbatim", "AGPL3preamble")), ("AGPL-3.0", ("AGPL3preamble",)),
    ("MPL-2.0", ("MPLsubject", "MPLobtain")), ("MPL-2.0", ("MPLsubject",)), ("MPL-1.1", ("MPL11subject",)), ("CDDL", ("CDDLsubject",)), ("Unlicense", ("UNLrelease", "UNLgrant")), ("Unlicense", ("UNLrelease",)),
    ("Zlib", ("ZLIBasis", "ZLIBliable", "ZLIBgrant", "ZLIBorigin")), ("Zlib", ("ZLIBasis", "ZLIBgrant")), ("Zlib", ("ZLIBgrant",)), ("BSL-1.0", ("BSLgrant",)), ("OFL-1.1", ("OFLgrant",)), ("WTFPL", ("WTFPLcopy", "WTFPLterms")), ("WTFPL", ("WTFPLterms",)),
    ("CC0-1.0", ("CC0dedicate",)), ("CC0-1.0", ("CC0waive",)), ("CC-PDDC", ("PDdedicate",)),
)
_NAMED = [(normal(f"licensedunder {text}"), f"NAME_{name}") for text, name in [*NAMES, *families()]]
#: Known sentences that count inside longer ones: those that begin with "licensed under", and the others.
NAMED = {text: i for text, i in sorted(_NAMED)}
INSIDE = {normal(text): i for text, i in SENTENCES}
#: Known sentences that count only as a whole.
WHOLE = {normal(text): f"TITLE_{name}" for text, name in TITLES}
TAGGED = {normal(name): "NAME_" + name.replace("+", "-or-later") for name in SPDX}
#: A sentence that names a licence is a rule of its own.
ALL_RULES = (*RULES, *((i.split("_", 1)[1], (i,)) for i in sorted({*NAMED.values(), *WHOLE.values(), *TAGGED.values()})))


def rule_pattern(ids: tuple[str, ...]) -> str:
    """Over a sequence such as ``,a,b,``: the identifiers in order, with few others between two."""
    quoted = [i.replace(".", "[.]").replace("-", "[-]") for i in ids]
    return "," + f",(?:[^,]+,){{0,{GAP}}}".join(quoted) + ","


def _q(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"


def _table(known: dict[str, str]) -> str:
    """(n, id, k): known sentences between spaces, their identifiers and lengths."""
    return "array(" + ", ".join(f"named_struct('n', {_q(f' {n} ')}, 'id', {_q(i)}, 'k', {len(n)})" for n, i in known.items()) + ")"


def _map(known: dict[str, str]) -> str:
    return f"map_from_arrays(array({', '.join(map(_q, known))}), array({', '.join(map(_q, known.values()))}))"


def sentence_ids(text: Column) -> Column:
    """Identifiers of the known sentences of a text, in their order."""
    low = F.lower(text)

    def worth(part: Column) -> Column:
        some = F.lit(False)
        for word in TRIGGERS:
            some = some | F.contains(part, F.lit(word))
        return some

    def normalised(sentence: Column) -> Column:
        for pattern, to in NORMAL:
            sentence = F.regexp_replace(sentence, pattern, to)
        return sentence

    def identify(sentence: Column) -> Column:
        named = F.contains(sentence, F.lit("licensedunder"))
        held = F.concat(F.lit(" "), F.when(named, F.regexp_replace(sentence, *FURTHER)).otherwise(sentence), F.lit(" "))
        # the tables are large: they are written once for each sentence kind, not for each use
        whole, tagged = F.expr(_map(WHOLE)), F.expr(_map(TAGGED))
        found = F.filter(F.expr(_table(INSIDE)), lambda k: F.contains(held, k["n"]))
        names = F.filter(F.expr(_table(NAMED)), lambda k: F.contains(held, k["n"]))
        both = F.when(named, F.concat(found, names)).otherwise(found)
        # one row for each place at which a known sentence begins
        places = F.flatten(F.transform(both, lambda k: F.transform(_starts(held, k["n"]), lambda at: F.struct(at.alias("at"), k["id"].alias("id"), (at + k["k"]).alias("end")))))
        # an array of one array, so that the places are worked out once
        outer = F.flatten(F.transform(F.array(places), lambda all: F.filter(all, lambda x: ~F.exists(all, lambda y: (y["at"] <= x["at"]) & (y["end"] >= x["end"]) & (y["end"] - y["at"] > x["end"] - x["at"])))))
        inside = F.transform(F.array_sort(outer), lambda x: x["id"])
        title = F.try_element_at(whole, sentence)
        parts = F.split(F.substring(sentence, len(_SPDX_TAG) + 1, 1 << 30), _SPDX_CUT)
        tags = F.filter(F.transform(parts, lambda x: F.try_element_at(tagged, F.trim(x))), lambda i: i.isNotNull())
        return F.when(sentence.startswith(_SPDX_TAG), tags).when(title.isNotNull(), F.array(title)).otherwise(inside)

    for pattern, to in BEFORE:
        low = F.regexp_replace(low, pattern, to)
    found = F.transform(F.filter(F.split(low, SENTENCE_END), worth), lambda s: normalised(s))
    found = F.flatten(F.transform(found, identify))
    return F.when(worth(F.lower(text)), found).otherwise(F.array().cast("array<string>"))


def _starts(text: Column, part: Column) -> Column:
    """Places (from 1) at which ``part``, which is there, begins: every one that does not lie in the one before."""
    pieces = F.split(text, part)  # parts have letters, digits and spaces only
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(pieces) - 1, F.lit(1))), lambda k: F.aggregate(F.slice(pieces, 1, k), F.lit(0), lambda n, x: n + F.length(x)) + (k - 1) * F.length(part) + 1)


def licences_of(sequence: Column) -> Column:
    """Licences of a sequence ``,a,b,`` by the rules in turn, each using up what it matches."""
    rules = F.expr("array(" + ", ".join(f"named_struct('name', '{name}', 'last', '{ids[-1]}', 'pattern', '{rule_pattern(ids)}')" for name, ids in ALL_RULES) + ")")
    start = F.struct(sequence.alias("rest"), F.array().cast("array<string>").alias("names"))

    def step(now: Column, rule: Column) -> Column:
        hit = F.regexp_like(now["rest"], rule["pattern"])
        rest = F.when(hit, F.regexp_replace(now["rest"], rule["pattern"], F.lit(",-,"))).otherwise(now["rest"])
        names = F.when(hit & ~F.array_contains(now["names"], rule["name"]), F.concat(now["names"], F.array(rule["name"]))).otherwise(now["names"])
        return F.struct(rest.alias("rest"), names.alias("names"))

    # only rules whose last identifier is there are run
    return F.aggregate(F.filter(rules, lambda rule: F.contains(sequence, F.concat(F.lit(","), rule["last"], F.lit(",")))), start, step, lambda now: now["names"])


def scanned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_sentences, sentences, licences) of every document; lists are comma-joined."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(sentence_ids(F.col(text_col)), F.array().cast("array<string>")).alias("ids"))
    joined = F.concat(F.lit(","), F.array_join("ids", ","), F.lit(","))
    names = F.when(F.size("ids") > 0, F.array_join(licences_of(joined), ",")).otherwise(F.lit(""))
    return rows.select("doc_id", F.size("ids").alias("n_sentences"), F.array_join("ids", ",").alias("sentences"), names.alias("licences"))


def scan_sql() -> str:
    """DuckDB SQL for the rows of ``op1``."""

    def q(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    def replaced(value: str, pattern: str, to: str) -> str:
        return f"regexp_replace({value}, {q(pattern)}, {q(to.replace('$1', chr(92) + '1').replace('$2', chr(92) + '2'))}, 'g')"

    text, sentence = "lower(text)", "s"
    for pattern, to in BEFORE:
        text = replaced(text, pattern, to)
    for pattern, to in NORMAL:
        sentence = replaced(sentence, pattern, to)
    steps, last = [], "seq"
    for k, (name, ids) in enumerate(RULES):
        pattern = q(rule_pattern(ids))
        steps.append(
            f"r{k} as (select * replace (case when regexp_matches(rest, {pattern}) then regexp_replace(rest, {pattern}, ',-,', 'g') else rest end as rest, "
            f"case when regexp_matches(rest, {pattern}) and not list_contains(names, {q(name)}) then list_append(names, {q(name)}) else names end as names) from {last})"
        )
        last = f"r{k}"
    single = ", ".join(f"({q(ids[0])}, {q(name)}, {k})" for k, (name, ids) in enumerate(ALL_RULES[len(RULES) :]))
    rows = lambda known: ", ".join(f"({q(k)}, {q(v)})" for k, v in known.items())
    return f"""
with docs as (select row_number() over () as d, doc_id, text from documents),
cut as (select d, i, s from (select d, unnest(l) as s, generate_subscripts(l, 1) as i from (select d, regexp_split_to_array({text}, {q(SENTENCE_END)}) as l from docs))),
norm as (select d, i, {sentence} as n from cut where regexp_matches(s, {q("|".join(TRIGGERS))})),
titles(sentence, id) as (values {rows(WHOLE)}),
tags(sentence, id) as (values {rows(TAGGED)}),
inside(sentence, id) as (values {rows({**INSIDE, **NAMED})}),
tagged as (select d, i, pos, t.id from (select d, i, unnest(l) as part, generate_subscripts(l, 1) as pos from (select d, i, regexp_split_to_array(substr(n, {len(_SPDX_TAG) + 1}), {q(_SPDX_CUT)}) as l from norm where starts_with(n, {q(_SPDX_TAG)}))) join tags t on t.sentence = trim(part)),
titled as (select d, i, 1 as pos, t.id from norm join titles t on t.sentence = n),
held as (select d, i, ' ' || case when contains(n, 'licensedunder') then {replaced("n", *FURTHER)} else n end || ' ' as n from norm where not starts_with(n, {q(_SPDX_TAG)}) and not exists (from titles where sentence = n)),
pieces as (select d, i, k.id, length(k.sentence) as size, string_split(n, ' ' || k.sentence || ' ') as p from held join inside k on contains(n, ' ' || k.sentence || ' ')),
places as (select d, i, id, size, list_sum(list_transform(p[1:j], lambda x: length(x))) + (j - 1) * (size + 2) + 1 as pos from (select *, unnest(range(1, len(p))) as j from pieces)),
outer_most as (select d, i, pos, id from places x where not exists (from places y where y.d = x.d and y.i = x.i and y.pos <= x.pos and y.pos + y.size >= x.pos + x.size and y.size > x.size)),
hits as (from tagged union all from titled union all from outer_most),
seqs as (select d, count(*) as n, string_agg(id, ',' order by i, pos, id) as ids from hits group by d),
seq as (select d, n, ids, ',' || ids || ',' as rest, []::varchar[] as names from seqs),
{", ".join(steps)},
single(id, name, k) as (values {single}),
rest_of as (select d, list(name order by k) as more from (select d, name, min(k) as k from (select d, names, unnest(string_split(rest, ',')) as id from {last}) join single using (id) where not list_contains(names, name) group by d, name) group by d),
ended as (select d, n, ids, list_concat(names, coalesce(more, [])) as names from {last} left join rest_of using (d))
select x.doc_id, coalesce(n, 0)::int as n_sentences, coalesce(ids, '') as sentences, coalesce(array_to_string(names, ','), '') as licences from docs x left join ended using (d)
"""
