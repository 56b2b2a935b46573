"""License scans by sentence rules."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Sentences of license texts and notices, by identifier; those that name a license come from NAMES instead.
SENTENCES: dict[str, tuple[str, ...]] = {
    "MitGrant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    ),
    "MitNotice": ("The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",),
    "Apache2Copy": ("You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",),
    "AsIs": (
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT",
    ),
    "GplFree": ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",),
    "GplHope": ("This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",),
    "GplCopy": ("You should have received a copy of the GNU General Public License along with this program",),
    "BsdGrant": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",),
    "BsdSource": ("Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",),
    "BsdBinary": ("Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",),
    "BsdName": ("Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",),
    "BsdAds": ("All advertising materials mentioning features or use of this software must display the following acknowledgement:",),
    "BsdAsIs": (
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED",
    ),
    "IscGrant": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    ),
    "FreeGrant": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",),
    "IscAsIs": (
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS",
    ),
    "ZlibAsIs": ("This software is provided 'as-is', without any express or implied warranty",),
    "ZlibGrant": (
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    ),
    "UnlicenseFree": ("This is free and unencumbered software released into the public domain",),
    "UnlicenseGrant": (
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means",
    ),
    "Mpl2Form": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",),
    "Epl2Notice": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",),
    "Epl1Notice": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution",),
    "Cc0Law": ("To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide",),
    "Rights": ("All rights reserved",),
}
#: Full names of licenses, which a sentence may consist of.
NAMES: dict[str, tuple[str, ...]] = {
    "MIT": ("MIT License", "Expat License"),
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache Software License 2.0"),
    "Apache-1.1": ("Apache License, Version 1.1", "Apache Software License, Version 1.1"),
    "BSD-3-Clause": ("BSD 3-Clause License", "3-Clause BSD License", "New BSD License", "Modified BSD License", "Revised BSD License"),
    "BSD-2-Clause": ("BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License", "FreeBSD License"),
    "BSD-4-Clause": ("BSD 4-Clause License", "4-Clause BSD License", "Original BSD License"),
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD License"),
    "ISC": ("ISC License",),
    "Zlib": ("zlib License", "zlib/libpng License"),
    "Unlicense": ("Unlicense License", "The Unlicense"),
    "BSL-1.0": ("Boost Software License, Version 1.0", "Boost Software License 1.0"),
    "MPL-2.0": ("Mozilla Public License, Version 2.0", "Mozilla Public License 2.0", "Mozilla Public License, v. 2.0"),
    "MPL-1.1": ("Mozilla Public License, Version 1.1", "Mozilla Public License 1.1"),
    "EPL-2.0": ("Eclipse Public License 2.0", "Eclipse Public License, Version 2.0", "Eclipse Public License v2.0"),
    "EPL-1.0": ("Eclipse Public License 1.0", "Eclipse Public License, Version 1.0", "Eclipse Public License v1.0"),
    "CDDL-1.0": ("Common Development and Distribution License 1.0", "Common Development and Distribution License, Version 1.0"),
    "CDDL-1.1": ("Common Development and Distribution License 1.1", "Common Development and Distribution License, Version 1.1"),
    "CPL-1.0": ("Common Public License 1.0", "Common Public License, Version 1.0"),
    "EUPL-1.1": ("European Union Public License 1.1", "European Union Public Licence, Version 1.1"),
    "EUPL-1.2": ("European Union Public License 1.2", "European Union Public Licence, Version 1.2"),
    "Artistic-1.0": ("Artistic License 1.0",),
    "Artistic-2.0": ("Artistic License 2.0",),
    "PSF-2.0": ("Python Software Foundation License Version 2", "Python Software Foundation License 2.0"),
    "OFL-1.1": ("SIL Open Font License, Version 1.1", "SIL Open Font License 1.1"),
    "WTFPL": ("Do What The Fuck You Want To Public License",),
    "MS-PL": ("Microsoft Public License",),
    "MS-RL": ("Microsoft Reciprocal License",),
    "AFL-3.0": ("Academic Free License, Version 3.0", "Academic Free License 3.0"),
    "OSL-3.0": ("Open Software License, Version 3.0", "Open Software License 3.0"),
    "NCSA": ("University of Illinois/NCSA Open Source License",),
    "PostgreSQL": ("PostgreSQL License",),
    "X11": ("X11 License",),
    "CECILL-2.1": ("CeCILL Free Software License Agreement v2.1", "CeCILL License 2.1"),
    "ECL-2.0": ("Educational Community License, Version 2.0", "Educational Community License 2.0"),
    "UPL-1.0": ("Universal Permissive License 1.0", "Universal Permissive License, Version 1.0"),
    "MulanPSL-2.0": ("Mulan Permissive Software License, Version 2", "Mulan PSL v2 License"),
    "Vim": ("Vim License",),
    "Ruby": ("Ruby License",),
    "PHP-3.01": ("PHP License, Version 3.01", "PHP License 3.01"),
    "LPPL-1.3c": ("LaTeX Project Public License 1.3c", "LaTeX Project Public License, Version 1.3c"),
    "W3C": ("W3C Software Notice and License", "W3C Software License"),
    "OpenSSL": ("OpenSSL License",),
    "JSON": ("JSON License",),
    "SSPL-1.0": ("Server Side Public License, Version 1", "Server Side Public License 1.0"),
    "BUSL-1.1": ("Business Source License 1.1",),
    "Elastic-2.0": ("Elastic License 2.0",),
    "CC0-1.0": ("CC0 1.0 Universal License", "CC0 1.0 Universal", "Creative Commons Zero v1.0 Universal License", "Creative Commons Zero v1.0 Universal"),
    "ODbL-1.0": ("Open Database License 1.0", "Open Data Commons Open Database License v1.0"),
    "PDDL-1.0": ("Open Data Commons Public Domain Dedication and License v1.0",),
}
#: Short names, which stand for a license only behind words that say so; identifiers are among them by rule.
SHORT: dict[str, tuple[str, ...]] = {"Apache-2.0": ("Apache 2.0",), "CC0-1.0": ("CC0", "CC0 1.0")}
GNU = {
    "GPL": ("GNU General Public License", ("1", "2", "3")), "LGPL": ("GNU Lesser General Public License", ("2.1", "3")),
    "AGPL": ("GNU Affero General Public License", ("1", "3")), "GFDL": ("GNU Free Documentation License", ("1.1", "1.2", "1.3")),
}
CREATIVE = {"BY": "Attribution", "SA": "ShareAlike", "NC": "NonCommercial", "ND": "NoDerivatives"}
CREATIVE_KINDS, CREATIVE_VERSIONS = ("BY", "BY-SA", "BY-NC", "BY-NC-SA", "BY-ND", "BY-NC-ND"), ("1.0", "2.0", "2.5", "3.0", "4.0")
#: Wordings in front of a name: a bare name, and those that also take short names.
THINGS = "project work software program file code library document material text content repository page package module dataset article".split()
UNDER = [
    f"{verb} under" for verb in ("Licensed", "Released", "Distributed", "Available", "Made available", "Published", "Provided", "Relicensed")
] + [f"This {t} is {v} under" for t in THINGS for v in ("licensed", "released", "distributed", "available", "published")]
SAYS = ("SPDX-License-Identifier:", "License:", "Licence:", "License ID:")
#: What may follow a name in its sentence.
AFTER = ("(the \"License\")", "(the \"License\"); you may not use this file except in compliance with the License")


def named() -> tuple[dict[str, list[str]], dict[str, list[str]]]:
    """Full and short names of all licenses; versions and kinds of the large families follow a rule."""
    full = {k: list(v) for k, v in NAMES.items()}
    short = {k: [k, *SHORT.get(k, ())] for k in NAMES}
    for tag, (name, versions) in GNU.items():
        for v in versions:
            dotted = v if "." in v else f"{v}.0"
            forms = [f"{name}{x}" for x in (f", version {v}", f" version {v}", f" v{v}", f" v{dotted}", f" {dotted}", f", version {dotted}")]
            full[f"{tag}-{dotted}"] = forms + [f"{f} only" for f in forms]
            short[f"{tag}-{dotted}"] = [f"{tag}-{dotted}", f"{tag}-{dotted}-only", f"{tag}v{v}", f"{tag} v{v}", f"{tag} {v}"]
            full[f"{tag}-{dotted}-or-later"] = [f"{f}{x}" for f in forms for x in (" or later", ", or any later version", " or (at your option) any later version")]
            short[f"{tag}-{dotted}-or-later"] = [f"{tag}-{dotted}-or-later", f"{tag}-{dotted}+", f"{tag}v{v}+", f"{tag}v{v} or later"]
    for kind in CREATIVE_KINDS:
        words = "-".join(CREATIVE[k] for k in kind.split("-"))
        for v in CREATIVE_VERSIONS:
            scope = "International" if v == "4.0" else "Unported" if v == "3.0" else "Generic"
            full[f"CC-{kind}-{v}"] = [f"Creative Commons {words} {v} {scope} License", f"Creative Commons {words} {v} License", f"Creative Commons {words} {v} {scope} Licence"]
            short[f"CC-{kind}-{v}"] = [f"CC {kind} {v}", f"CC-{kind}-{v}", f"Creative Commons {words} {v} {scope}", f"Creative Commons {words} {v}"]
    return full, short


#: Licenses by their texts, in the order in which their rules are tried; each rule is a sequence of identifiers that follow each other.
#: Those by name alone come last, by rule; `Name:` stands for any sentence that names the license.
TEXTS: tuple[tuple[str, tuple[tuple[str, ...], ...]], ...] = (
    ("BSD-4-Clause", (("BsdGrant", "BsdSource", "BsdBinary", "BsdAds", "BsdName"),)),
    ("BSD-3-Clause", (("BsdGrant", "BsdSource", "BsdBinary", "BsdName", "BsdAsIs"), ("BsdGrant", "BsdSource", "BsdBinary", "BsdName"))),
    ("BSD-2-Clause", (("BsdGrant", "BsdSource", "BsdBinary", "BsdAsIs"), ("BsdGrant", "BsdSource", "BsdBinary"))),
    ("MIT", (("Name:MIT", "MitGrant", "MitNotice", "AsIs"), ("MitGrant", "MitNotice", "AsIs"), ("MitGrant", "MitNotice"))),
    ("Apache-2.0", (("Name:Apache-2.0", "Apache2Copy", "AsIs"), ("Name:Apache-2.0", "Apache2Copy"))),
    ("ISC", (("Name:ISC", "IscGrant", "IscAsIs"), ("IscGrant", "IscAsIs"), ("IscGrant",))),
    ("0BSD", (("Name:0BSD", "FreeGrant", "IscAsIs"), ("FreeGrant", "IscAsIs"))),
    ("Zlib", (("Name:Zlib", "ZlibAsIs", "ZlibGrant"), ("ZlibAsIs", "ZlibGrant"), ("ZlibGrant",))),
    ("Unlicense", (("UnlicenseFree", "UnlicenseGrant"), ("UnlicenseFree",))),
    ("MPL-2.0", (("Mpl2Form",),)),
    ("EPL-2.0", (("Epl2Notice",),)),
    ("EPL-1.0", (("Epl1Notice",),)),
    ("CC0-1.0", (("Name:CC0-1.0", "Cc0Law"), ("Cc0Law",))),
    ("GPL-3.0-or-later", (("GplFree", "GplHope", "GplCopy"), ("GplFree", "GplHope"), ("GplFree",))),
)


def headers() -> dict[str, tuple[str, ...]]:
    """Sentences of notices in files under the GNU licenses, by license; the identifier is Free: and the license."""
    out = {}
    for tag, (name, versions) in GNU.items():
        for v in versions:
            if (tag, v) == ("GPL", "3") or tag == "GFDL":
                continue
            first = "This {} is free software: you can redistribute it and/or modify it under the terms of the " + name + " as published by the Free Software Foundation, either version " + v
            out[f"Free:{tag}-{v if '.' in v else v + '.0'}-or-later"] = tuple(first.format(t) + " of the License, or (at your option) any later version" for t in ("program", "library", "file"))
    return out


def rules() -> list[tuple[str, tuple[str, ...]]]:
    """All rules in the order in which they are tried: (license, sequence of identifiers)."""
    out = [(lic, r) for lic, every in TEXTS for r in every]
    for free in headers():
        lic = free.removeprefix("Free:")
        out += [(lic, (free, "GplHope", "GplCopy")), (lic, (free, "GplHope")), (lic, (free,))]
    return [*out, *[(lic, (f"Name:{lic}",)) for lic in named()[0]], ("AllRightsReserved", ("Rights",))]


_END = re.compile(r"\n+|(?<=[.!?:])[ \t\r\f\v]+")
_TOKEN = re.compile(r"[a-z0-9]+")


def normalize(sentence: str) -> str:
    """Letters and digits in lower case, joined by single spaces."""
    return " ".join(_TOKEN.findall(sentence.lower()))


class Recogniser:
    """Maps sentences to identifiers and sequences of them to licenses.

    Sentences are paths of words: fixed ones, and wordings that lead on to the
    paths of names, which all wordings share.  Full names start sentences as
    well, short ones follow only wordings that speak of a license.
    """

    def __init__(self):
        full, short = named()
        self.start, self.full, self.short = {}, {}, {}
        for name, texts in (SENTENCES | headers()).items():
            for text in texts:
                self._add(self.start, normalize(text), name)
        for trie, names in ((self.full, full), (self.short, short)):
            for lic, texts in names.items():
                for text in texts:
                    for tail in ("", *AFTER):
                        self._add(trie, normalize(f"{text} {tail}"), f"Name:{lic}")
        for wording in ("The", *UNDER, *SAYS, *[f"{u} the" for u in UNDER]):
            node = self._add(self.start, normalize(wording), None)
            node["leads"] = (self.full,) if wording == "The" else (self.full, self.short)
        self.rules = rules()

    @staticmethod
    def _add(trie: dict, words: str, name: str | None) -> dict:
        for w in words.split():
            trie = trie.setdefault((w,), {})
        if name is not None:
            trie.setdefault("name", name)
        return trie

    def sentences(self, text: str | None) -> list[str]:
        """Identifiers of the known sentences, in order; a wrapped one spans several lines, the longest one wins."""
        parts = [p for p in (_TOKEN.findall(s.lower()) for s in _END.split(text or "")) if p]
        out, i = [], 0
        while i < len(parts):
            step, name, states = 1, None, [self.start, self.full]
            for k in range(i, len(parts)):
                for w in parts[k]:
                    states = [n for s in states if (n := s.get((w,))) is not None]
                    if not states:
                        break
                    states += [t for s in states for t in s.get("leads", ())]
                if not states:
                    break
                known = next((s["name"] for s in states if "name" in s), None)
                if known:
                    step, name = k + 1 - i, known
            if name:
                out.append(name)
            i += step
        return out

    def licenses(self, found: list[str]) -> list[tuple[str, int]]:
        """Licenses in the order of their first sentence: (license, first place).

        Rules apply in their order; each takes every sequence that no earlier
        rule has taken a part of.
        """
        free, out = [True] * len(found), []
        if not found:
            return out
        for lic, rule in self.rules:
            i = 0
            while i + len(rule) <= len(found):
                if all(free[i : i + len(rule)]) and tuple(found[i : i + len(rule)]) == rule:
                    free[i : i + len(rule)] = [False] * len(rule)
                    out.append((i, lic))
                    i += len(rule)
                else:
                    i += 1
        return [(lic, i) for i, lic in sorted(out)]


def license_scan(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Sentence identifiers and licenses of every row's whole text: doc_id, sentences, licenses.

    Sentences end at line ends and after `.`, `!`, `?` or `:` before a blank; a
    known sentence may run over several of these parts, wherever its lines are
    wrapped and with signs of comments before them, as only letters and digits
    count.  Both arrays are in text order, licenses with each one once.  Of
    sentences that start at one place the longest counts, of rules the first.
    Null and empty texts have none, texts of any length are read whole, rows
    that repeat are answered one by one, and an empty table gives no rows.
    Further columns are not read.
    """

    @F.pandas_udf("struct<sentences:array<string>,licenses:array<string>>")
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        r = Recogniser()
        for texts in batches:
            rows = [r.sentences(t) for t in texts]
            yield pd.DataFrame({"sentences": rows, "licenses": [list(dict.fromkeys(lic for lic, _ in r.licenses(x))) for x in rows]})

    return docs.select(F.col(doc_id).alias("doc_id"), scan(F.col(text)).alias("s")).select("doc_id", "s.sentences", "s.licenses")
