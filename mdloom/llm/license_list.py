"""Licences, their names and addresses, the sentences of their texts and the rules over them: data for the licence scan.

Everything is in the scan's normal form: lower-case ASCII letters, digits and inner dots, one space between words.
"""

from __future__ import annotations

import re
from itertools import product

#: Families of licences by version: identifier, long names, short names, versions.
FAMILIES = (
    ("GPL-{}", ("gnu general public license", "general public license"), ("gnu gpl", "gpl"), ("1.0", "2.0", "3.0")),
    ("LGPL-{}", ("gnu lesser general public license", "gnu library general public license", "lesser general public license"), ("gnu lgpl", "lgpl"), ("2.0", "2.1", "3.0")),
    ("AGPL-{}", ("gnu affero general public license", "affero general public license"), ("gnu agpl", "agpl"), ("1.0", "3.0")),
    ("GFDL-{}", ("gnu free documentation license", "free documentation license"), ("gnu fdl", "gfdl"), ("1.1", "1.2", "1.3")),
    ("Apache-{}", ("apache license", "apache software license"), ("apache",), ("1.0", "1.1", "2.0")),
    ("MPL-{}", ("mozilla public license",), ("mpl",), ("1.0", "1.1", "2.0")),
    ("EPL-{}", ("eclipse public license",), ("epl",), ("1.0", "2.0")),
    ("CDDL-{}", ("common development and distribution license",), ("cddl",), ("1.0", "1.1")),
    ("CPL-{}", ("common public license",), ("cpl",), ("1.0",)),
    ("EUPL-{}", ("european union public license", "european union public licence"), ("eupl",), ("1.1", "1.2")),
    ("OSL-{}", ("open software license",), ("osl",), ("1.0", "2.0", "2.1", "3.0")),
    ("AFL-{}", ("academic free license",), ("afl",), ("1.1", "1.2", "2.0", "2.1", "3.0")),
    ("BSL-{}", ("boost software license",), ("bsl",), ("1.0",)),
    ("Artistic-{}", ("artistic license",), ("artistic",), ("1.0", "2.0")),
    ("OFL-{}", ("sil open font license", "open font license"), ("ofl",), ("1.0", "1.1")),
    ("LPPL-{}", ("latex project public license",), ("lppl",), ("1.0", "1.2", "1.3c")),
    ("PHP-{}", ("php license",), (), ("3.0", "3.01")),
    ("ODbL-{}", ("open database license", "open data commons open database license"), ("odbl",), ("1.0",)),
    ("UPL-{}", ("universal permissive license",), ("upl",), ("1.0",)),
    ("SSPL-{}", ("server side public license",), ("sspl",), ("1.0",)),
    ("BUSL-{}", ("business source license",), ("busl",), ("1.1",)),
    ("Elastic-{}", ("elastic license",), (), ("2.0",)),
    ("MulanPSL-{}", ("mulan permissive software license", "mulan psl"), ("mulanpsl",), ("1.0", "2.0")),
    ("BlueOak-{}", ("blue oak model license",), (), ("1.0.0",)),
    ("ECL-{}", ("educational community license",), ("ecl",), ("1.0", "2.0")),
)

#: Licences without versions in their usual names.
SINGLE = {
    "MIT": ("mit", "mit license", "expat license", "mit x11 license", "mit expat license"),
    "MIT-0": ("mit no attribution license", "mit 0 license"),
    "ISC": ("isc", "isc license"),
    "BSD-4-Clause": ("bsd 4 clause license", "4 clause bsd license", "original bsd license"),
    "BSD-3-Clause": ("bsd 3 clause", "bsd 3 clause license", "3 clause bsd license", "three clause bsd license", "new bsd license", "modified bsd license", "revised bsd license"),
    "BSD-2-Clause": ("bsd 2 clause", "bsd 2 clause license", "2 clause bsd license", "two clause bsd license", "simplified bsd license", "freebsd license"),
    "0BSD": ("0bsd", "0bsd license", "zero clause bsd license", "bsd zero clause license"),
    "BSD": ("bsd license", "bsd style license"),
    "Zlib": ("zlib license", "zlib libpng license"),
    "Unlicense": ("unlicense", "the unlicense"),
    "WTFPL": ("wtfpl", "do what the fuck you want to public license"),
    "CC0-1.0": ("cc0", "cc0 license", "cc0 1.0", "cc0 1.0 universal", "creative commons zero", "creative commons zero v1.0 universal", "creative commons cc0 license"),
    "PSF-2.0": ("psf license", "python software foundation license", "python software foundation license version 2"),
    "PostgreSQL": ("postgresql license",),
    "NCSA": ("ncsa license", "university of illinois ncsa open source license"),
    "Ruby": ("ruby license",),
    "Vim": ("vim license",),
    "X11": ("x11 license",),
    "JSON": ("json license",),
    "MS-PL": ("ms pl", "microsoft public license"),
    "MS-RL": ("ms rl", "microsoft reciprocal license"),
    "OpenSSL": ("openssl license",),
    "Beerware": ("beerware license", "beer ware license"),
    "GPL": ("gnu general public license", "gnu gpl", "gpl", "gpl license"),
    "LGPL": ("gnu lesser general public license", "gnu lgpl", "lgpl", "lgpl license"),
    "AGPL": ("gnu affero general public license", "gnu agpl", "agpl", "agpl license"),
}

#: Parts of Creative Commons identifiers with their names, and the versions.
CC_PARTS = {"by": ("attribution",), "nc": ("noncommercial", "non commercial"), "sa": ("sharealike", "share alike"), "nd": ("noderivatives", "noderivs", "no derivatives")}
CC_KINDS = ("by", "by-sa", "by-nc", "by-nd", "by-nc-sa", "by-nc-nd")
CC_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")

#: Addresses without scheme and "www.", and the licence they stand for.
ADDRESSES = {
    "apache.org licenses license 2.0": "Apache-2.0",
    "opensource.org licenses mit": "MIT",
    "opensource.org licenses isc": "ISC",
    "opensource.org licenses bsd 3 clause": "BSD-3-Clause",
    "opensource.org licenses bsd 2 clause": "BSD-2-Clause",
    "opensource.org licenses apache 2.0": "Apache-2.0",
    "mozilla.org mpl 2.0": "MPL-2.0",
    "mozilla.org en us mpl 2.0": "MPL-2.0",
    "gnu.org licenses gpl 2.0": "GPL-2.0",
    "gnu.org licenses gpl 3.0": "GPL-3.0",
    "gnu.org licenses lgpl 2.1": "LGPL-2.1",
    "gnu.org licenses lgpl 3.0": "LGPL-3.0",
    "gnu.org licenses agpl 3.0": "AGPL-3.0",
    "boost.org license 1 0": "BSL-1.0",
    "eclipse.org legal epl v10": "EPL-1.0",
    "eclipse.org legal epl 2.0": "EPL-2.0",
    "creativecommons.org publicdomain zero 1.0": "CC0-1.0",
    "unlicense.org": "Unlicense",
    "wtfpl.net": "WTFPL",
}


def fold(sentence: str) -> str:
    """One way to write a version (version 2.0, v2.0, v. 2, 2) and the noun licence."""
    sentence = re.sub(r"(?:version |v\. |v)(?=[0-9])", "", sentence.replace("licenc", "licens"))
    return re.sub(r"([0-9])(?:\.0)+(?= |\Z)", r"\1", sentence)


def names() -> dict[str, str]:
    """Names by which a text may say what it is under, folded, and the licence; the first licence with a name has it."""
    found: dict[str, str] = {}

    def add(name: str, licence: str) -> None:
        found.setdefault(fold(name), licence)

    for pattern, long, short, versions in FAMILIES:
        for version in versions:
            licence = pattern.format(version)
            spaced = [f"{base} {version}" for base in (*long, *short)]
            for name in (*spaced, *(f"{x} license" for x in spaced[len(long) :]), *(f"{base}v{version}" for base in short)):
                add(name, licence)
                add(f"{name} or later", f"{licence}-or-later")
    for kind, version in product(CC_KINDS, CC_VERSIONS):
        licence, short = f"CC-{kind.upper()}-{version}", kind.replace("-", " ")
        said = [f"cc {short} {version}", f"creative commons {short} {version}"]
        for parts in product(*(CC_PARTS[p] for p in kind.split("-"))):
            said += [f"creative commons {' '.join(parts)} {version}{place}" for place in ("", " international", " unported", " generic")]
        for name in said:
            add(name, licence)
            add(f"{name} license", licence)
    for licence, said in SINGLE.items():
        for name in said:
            add(name, licence)
    return found


def addresses() -> dict[str, str]:
    found = {f"creativecommons.org licenses {kind.replace('-', ' ')} {v}": f"CC-{kind.upper()}-{v}" for kind, v in product(CC_KINDS, CC_VERSIONS)}
    endings = ("", ".html", ".txt", ".en.html", ".php", " deed.en", " legalcode")
    return {fold(address + ending): licence for address, licence in {**ADDRESSES, **found}.items() for ending in endings}


def spdx_names() -> dict[str, str]:
    """Normal forms of SPDX identifiers, and the identifier."""
    known = {p.format(v) for p, _, _, versions in FAMILIES for v in versions} | set(names().values()) | {"CC0-1.0", "Unlicense"}
    known |= {f"{p.format(v)}-{end}" for p, _, _, versions in FAMILIES if p.startswith(("GPL", "LGPL", "AGPL", "GFDL")) for v in versions for end in ("only", "or-later")}
    return {fold(licence.lower().replace("-", " ")): licence for licence in sorted(known)}


#: Sentences of public licence texts and headers, and their identifiers.
BODIES = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit-grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-notice",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "mit-warranty",
    "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software": "mit-liability",
    "licensed under the apache license version 2.0 the license": "name:Apache-2.0",
    "you may not use this file except in compliance with the license": "apache2-comply",
    "you may obtain a copy of the license at": "apache2-copy",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "apache2-basis",
    "see the license for the specific language governing permissions and limitations under the license": "apache2-see",
    "apache license": "title:Apache-2.0",
    "apache license version 2.0 january 2004": "title:Apache-2.0",
    "terms and conditions for use reproduction and distribution": "apache2-terms",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd-binary",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "0bsd-grant",
    "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness": "isc-warranty",
    "this software is provided as is without any express or implied warranty": "zlib-warranty",
    "in no event will the authors be held liable for any damages arising from the use of this software": "zlib-liability",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions": "zlib-grant",
    "this is free and unencumbered software released into the public domain": "unlicense-grant",
    "this source code form is subject to the terms of the mozilla public license v. 2.0": "mpl2-form",
    "if a copy of the mpl was not distributed with this file you can obtain one at": "mpl2-copy",
    "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following": "bsl-grant",
    "this work is dedicated to the public domain": "title:Public-Domain",
    "released into the public domain": "title:Public-Domain",
    "all rights reserved": "title:All-Rights-Reserved",
}

#: Licences of the foundation's headers by name, the works they speak of, and the versions.
HEADERS = {"gpl": "gnu general public license", "lgpl": "gnu lesser general public license", "agpl": "gnu affero general public license"}
HEADER_WORKS = ("program", "library", "file", "software")
HEADER_VERSIONS = ("2", "2.1", "3")


def _header_sentences() -> dict[str, str]:
    found = {}
    for work in HEADER_WORKS:
        found[f"this {work} is free software"] = "gnu-free"
        for end in ("without any warranty", "without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"):
            found[f"this {work} is distributed in the hope that it will be useful but {end}"] = "gnu-hope"
    found["without even the implied warranty of merchantability or fitness for a particular purpose"] = "gnu-implied"
    for version in HEADER_VERSIONS:
        found[f"either version {version} of the license or at your option any later version"] = f"gnu-later-{version}"
    for key, name in HEADERS.items():
        terms = f"you can redistribute it and or modify it under the terms of the {name} as published by the free software foundation"
        found[terms] = f"{key}-terms"
        found[f"see the {name} for more details"] = f"{key}-see"
        for work, version in product(HEADER_WORKS, HEADER_VERSIONS):
            found[f"this {work} is free software {terms} either version {version} of the license or at your option any later version"] = f"{key}-free-{version}"
    return found


#: Sentences that name a holder: how they begin, how they end, and their identifier.
HOLDERS = (
    ("neither the name of ", " nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "bsd-endorse"),
    ("this software is provided by ", " as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed", "bsd-warranty"),
    ("in no event shall ", " be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage", "bsd-liability"),
)


def _header_rules() -> tuple[tuple[str, tuple[str, ...]], ...]:
    found = []
    for key, version in product(HEADERS, HEADER_VERSIONS):
        licence = f"{key.upper()}-{version if '.' in version else version + '.0'}"
        joined, apart = (f"{key}-free-{version}",), ("gnu-free", f"{key}-terms", f"gnu-later-{version}")
        for start in (joined, apart):
            for hope in (("gnu-hope",), ("gnu-hope", "gnu-implied")):
                found.append((licence, (*start, *hope, f"{key}-see")))
            found.append((licence, start))
    return tuple(found)


_APACHE = ("name:Apache-2.0", "apache2-comply", "apache2-copy", "url:Apache-2.0", "apache2-basis", "apache2-see")

#: Rules in order of precedence, each a licence and the identifiers that stand side by side for it.
RULES = (
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-warranty", "bsd-liability")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-3-Clause", ("bsd-source", "bsd-binary", "bsd-endorse", "bsd-warranty")),
    ("BSD-3-Clause", ("bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-warranty", "bsd-liability")),
    ("BSD-2-Clause", ("bsd-source", "bsd-binary", "bsd-warranty")),
    ("BSD-2-Clause", ("bsd-source", "bsd-binary")),
    ("Apache-2.0", _APACHE),
    ("Apache-2.0", ("apache2-comply", "apache2-copy", "url:Apache-2.0")),
    ("Apache-2.0", ("title:Apache-2.0", "url:Apache-2.0", "apache2-terms")),
    *(("Apache-2.0", _APACHE[:n]) for n in (5, 4, 3, 2)),
    ("MIT", ("title:MIT", "mit-grant", "mit-notice", "mit-warranty", "mit-liability")),
    ("MIT", ("mit-grant", "mit-notice", "mit-warranty", "mit-liability")),
    ("MIT", ("mit-grant", "mit-notice")),
    ("MIT", ("mit-grant",)),
    ("MIT", ("title:MIT", "mit-notice")),
    ("MIT", ("mit-notice",)),
    ("ISC", ("isc-grant", "isc-warranty")),
    ("ISC", ("isc-grant",)),
    ("0BSD", ("0bsd-grant", "isc-warranty")),
    ("Zlib", ("zlib-warranty", "zlib-liability", "zlib-grant")),
    ("Zlib", ("zlib-grant",)),
    ("Unlicense", ("unlicense-grant",)),
    ("MPL-2.0", ("mpl2-form", "mpl2-copy", "url:MPL-2.0")),
    ("MPL-2.0", ("mpl2-form",)),
    ("BSL-1.0", ("bsl-grant",)),
    *_header_rules(),
    ("GPL", ("gnu-hope", "gpl-see")),
    ("LGPL", ("gnu-hope", "lgpl-see")),
    ("AGPL", ("gnu-hope", "agpl-see")),
)


def sentences() -> dict[str, str]:
    """Known whole sentences, folded, and their identifiers: titles, addresses, sentences of texts."""
    titles = {name: f"title:{licence}" for name, licence in names().items() if "license" in name}
    texts = {fold(sentence): identifier for sentence, identifier in {**BODIES, **_header_sentences()}.items()}
    return {**titles, **{a: f"url:{x}" for a, x in addresses().items()}, **texts}
