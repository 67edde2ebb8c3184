"""Licence recognition by sentences, with built-in columns only.

A text is cut into sentences, each is normalised and looked up among known licence sentences, and the sequence of identifiers is matched
against rules in order: a rule takes its sentences out of the sequence and leaves its licence there, so longer rules come first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# What begins a line, with a comment's marks; a star only after a blank, as in a block comment, since lists begin with it too. Every loop is over single
# characters, keeps what it took, and cannot begin again inside its run, so a text takes time in proportion to its length.
_BEGIN = r"[ \t]*+(?:(?:#++|/{2,}+|-{2,}+|;++|%++|(?<=[ \t])\*)[ \t]++)?+"
_BREAK = r"[ \t\r]*+\n" + _BEGIN
# Applied in order, each match becomes its two groups with a blank between. First the number of a clause goes. Then a line break inside a sentence:
# the line ends without a stop and the next begins in lower case, or both are in capitals, or it parts words that stand together. Last, the holder's
# name goes from the clause that forbids its use.
WRAPPED = (
    r"(^|\n)" + _BEGIN + r"(?:\([0-9]{1,2}\)|[0-9]{1,2}[.)]|\([a-z]\))[ \t]++([A-Za-z])",
    r"([^.!?:;\n \t\r])" + _BREAK + r"([a-z(])",
    r"([A-Z,]{2})" + _BREAK + r"([A-Z]{2})",
    r"( (?:of|the|or|and|by|to|in|under|Apache|Mozilla|GNU|General|Public|MIT|BSD))" + _BREAK + r"([A-Z])",
    r"([Nn]either the names? of)[ \t\r\n][^\x00]{1,200}?[ \t\r\n](nor the names of (?:its|their|the) contributors)",
)
STOPS = r"(?<![.!?:;])[.!?:;]++[ \t\r]++"
OTHER = r"[^a-z0-9.+\n-]++"
ENDS = " .+-"

# Sentences of public licences, as normalised.
SENTENCES: dict[str, str] = {
    "licensed under the apache license version 2.0": "ApacheRef",
    "released under the apache license version 2.0": "ApacheRef",
    "licensed under the apache license version 2.0 the license": "ApacheRef",
    "you may not use this file except in compliance with the license": "ApacheUse",
    "you may obtain a copy of the license at": "ApacheCopy",
    "http www.apache.org licenses license-2.0": "ApacheUrl",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "ApacheAsIs",
    "see the license for the specific language governing permissions and limitations under the license": "ApacheSee",
    "released under the mit license": "MitRef",
    "licensed under the mit license": "MitRef",
    "this project is licensed under the mit license": "MitRef",
    "mit license": "MitRef",
    "the mit license": "MitRef",
    "the mit license mit": "MitRef",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "MitGrant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "MitNotice",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "MitAsIs",
    "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software": "MitLiable",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "BsdGrant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "BsdSource",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "BsdBinary",
    "all advertising materials mentioning features or use of this software must display the following acknowledgement": "BsdAdvert",
    "neither the name of nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "BsdNames",
    "licensed under the bsd license": "BsdRef",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "IscGrant",
    "this work is licensed under the gnu general public license version 3": "Gpl3Ref",
    "this work is licensed under the gnu general public license version 2": "Gpl2Ref",
    "licensed under the gnu general public license version 3": "Gpl3Ref",
    "licensed under the gnu general public license version 2": "Gpl2Ref",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "Gpl3Plus",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "Gpl2Plus",
    # Stops end sentences within the public texts, too.
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "Gpl3Plus",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "Gpl2Plus",
    "this source code form is subject to the terms of the mozilla public license v": "MplRef",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "GnuNoWarranty",
    "you should have received a copy of the gnu general public license along with this program": "GnuReceived",
    "this source code form is subject to the terms of the mozilla public license v. 2.0": "MplRef",
    "this work is licensed under a creative commons attribution 4.0 international license": "CcBy4",
    "licensed under cc by 4.0": "CcBy4",
    "licensed under cc by-sa 4.0": "CcBySa4",
    "licensed under cc by-nc 4.0": "CcByNc4",
    "licensed under cc by-nd 4.0": "CcByNd4",
    "licensed under cc by-nc-sa 4.0": "CcByNcSa4",
    "this is free and unencumbered software released into the public domain": "Unlicense",
    "released into the public domain": "PublicDomain",
    "all rights reserved": "Reserved",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions": "ZlibGrant",
    "the origin of this software must not be misrepresented": "ZlibOrigin",
    "this notice may not be removed or altered from any source distribution": "ZlibNotice",
    "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation": "LgplTerms",
    "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2.1 of the license or at your option any later version": "Lgpl21Plus",
    "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version": "Lgpl3Plus",
    "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version": "Agpl3Plus",
    "either version 2.1 of the license or at your option any later version": "Later21",
    "either version 3 of the license or at your option any later version": "Later3",
    "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed": "FsfVerbatim",
}
# Names of public licences as texts give them, by their short identifiers.
NAMES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": ("apache license version 2.0", "apache license 2.0", "apache 2.0 license", "apache-2.0 license"),
    "MIT": ("mit license",),
    "BSD-2-Clause": ("bsd 2-clause license", "2-clause bsd license", "simplified bsd license"),
    "BSD-3-Clause": ("bsd 3-clause license", "3-clause bsd license", "new bsd license", "modified bsd license"),
    "ISC": ("isc license",),
    "Zlib": ("zlib license",),
    "BSL-1.0": ("boost software license version 1.0", "boost software license"),
    "GPL-2.0-only": ("gnu general public license version 2", "gnu gpl version 2", "gpl version 2"),
    "GPL-3.0-only": ("gnu general public license version 3", "gnu gpl version 3", "gpl version 3"),
    "LGPL-2.1-only": ("gnu lesser general public license version 2.1", "lgpl version 2.1"),
    "LGPL-3.0-only": ("gnu lesser general public license version 3", "lgpl version 3"),
    "AGPL-3.0-only": ("gnu affero general public license version 3", "agpl version 3"),
    "MPL-2.0": ("mozilla public license version 2.0", "mozilla public license 2.0"),
    "EPL-1.0": ("eclipse public license version 1.0", "eclipse public license 1.0"),
    "EPL-2.0": ("eclipse public license version 2.0", "eclipse public license 2.0"),
    "CDDL-1.0": ("common development and distribution license version 1.0",),
    "Artistic-2.0": ("artistic license 2.0", "artistic license version 2.0"),
    "WTFPL": ("do what the fuck you want to public license",),
    "OFL-1.1": ("sil open font license version 1.1",),
    "PSF-2.0": ("python software foundation license version 2",),
    "CC-BY-4.0": ("creative commons attribution 4.0 international license", "cc by 4.0 license"),
    "CC-BY-SA-4.0": ("creative commons attribution-sharealike 4.0 international license", "cc by-sa 4.0 license"),
    "CC-BY-NC-4.0": ("creative commons attribution-noncommercial 4.0 international license", "cc by-nc 4.0 license"),
    "CC-BY-ND-4.0": ("creative commons attribution-noderivatives 4.0 international license",),
    "CC-BY-NC-SA-4.0": ("creative commons attribution-noncommercial-sharealike 4.0 international license",),
    "CC0-1.0": ("creative commons zero v1.0 universal license", "cc0 1.0 universal license"),
}
# Sentences that name a licence are made of these.
_SUBJECTS = ("", *(f"this {x} is " for x in ("work", "software", "project", "program", "library")))
_VERBS = ("licensed", "released", "distributed")
for _short, _names in NAMES.items():
    for _full in _names:
        for _subject in _SUBJECTS:
            for _verb in _VERBS:
                for _article in ("the ", ""):
                    SENTENCES.setdefault(f"{_subject}{_verb} under {_article}{_full}", f"Named:{_short}")
    # The stop between tag and value is a sentence's end.
    SENTENCES[f"spdx-license-identifier {_short.lower()}"] = f"Spdx:{_short}"

#: (licence, identifiers of its sentences in order); earlier rules win.
RULES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("Apache-2.0", ("ApacheRef", "ApacheUse", "ApacheCopy", "ApacheUrl", "ApacheAsIs", "ApacheSee")),
    ("Apache-2.0", ("ApacheRef", "ApacheUse", "ApacheCopy")),
    ("MIT", ("MitRef", "MitGrant", "MitNotice", "MitAsIs", "MitLiable")),
    ("MIT", ("MitRef", "MitGrant", "MitNotice")),
    ("MIT", ("MitGrant", "MitNotice", "MitAsIs", "MitLiable")),
    ("MIT", ("MitGrant", "MitNotice")),
    ("BSD-4-Clause", ("BsdGrant", "BsdSource", "BsdBinary", "BsdAdvert")),
    ("BSD-3-Clause", ("BsdGrant", "BsdSource", "BsdBinary", "BsdNames")),
    ("BSD-2-Clause", ("BsdGrant", "BsdSource", "BsdBinary")),
    ("GPL-3.0-or-later", ("Gpl3Plus", "GnuNoWarranty", "GnuReceived")),
    ("GPL-3.0-or-later", ("Gpl3Plus", "GnuNoWarranty")),
    ("GPL-2.0-or-later", ("Gpl2Plus", "GnuNoWarranty", "GnuReceived")),
    ("GPL-2.0-or-later", ("Gpl2Plus", "GnuNoWarranty")),
    ("GPL-3.0-or-later", ("Gpl3Plus",)),
    ("GPL-2.0-or-later", ("Gpl2Plus",)),
    ("LGPL-2.1-or-later", ("LgplTerms", "Later21")),
    ("LGPL-3.0-or-later", ("LgplTerms", "Later3")),
    ("LGPL-2.1-or-later", ("Lgpl21Plus",)),
    ("LGPL-3.0-or-later", ("Lgpl3Plus",)),
    ("AGPL-3.0-or-later", ("Agpl3Plus",)),
    ("Zlib", ("ZlibGrant", "ZlibOrigin", "ZlibNotice")),
    ("Zlib", ("ZlibGrant", "ZlibOrigin")),
    ("Zlib", ("ZlibGrant",)),
    ("Apache-2.0", ("ApacheRef",)),
    ("MIT", ("MitRef",)),
    ("ISC", ("IscGrant",)),
    ("BSD", ("BsdRef",)),
    ("GPL-3.0-only", ("Gpl3Ref",)),
    ("GPL-2.0-only", ("Gpl2Ref",)),
    ("MPL-2.0", ("MplRef",)),
    ("CC-BY-4.0", ("CcBy4",)),
    ("CC-BY-SA-4.0", ("CcBySa4",)),
    ("CC-BY-NC-4.0", ("CcByNc4",)),
    ("CC-BY-ND-4.0", ("CcByNd4",)),
    ("CC-BY-NC-SA-4.0", ("CcByNcSa4",)),
    ("Unlicense", ("Unlicense",)),
    ("public-domain", ("PublicDomain",)),
    *((name, (f"{kind}:{name}",)) for name in NAMES for kind in ("Named", "Spdx") if f"{kind}:{name}" in SENTENCES.values()),
    ("all-rights-reserved", ("Reserved",)),
)


def sentences(text: Column) -> Column:
    """Normalised sentences: A-Z in lower case, other characters one blank, without stops at the ends. Empty ones go."""
    for pattern in WRAPPED:
        text = F.regexp_replace(text, pattern, "$1 $2")
    # The colon of the SPDX tag ends no sentence.
    text = F.replace(text, F.lit("SPDX-License-Identifier:"), F.lit("SPDX-License-Identifier"))
    units = F.translate(F.regexp_replace(text, STOPS, "\n"), _UPPER, _LOWER)
    parts = F.split(F.regexp_replace(units, OTHER, " "), "\n")
    return F.filter(F.transform(parts, lambda s: F.btrim(s, F.lit(ENDS))), lambda s: s != "")


def find_licenses(docs: DataFrame, known: dict[str, str] = SENTENCES, rules: tuple[tuple[str, tuple[str, ...]], ...] = RULES) -> DataFrame:
    """doc_id, n_sentences, identifiers (known sentences in order), licenses (of the rules that match, in order), rest (identifiers that no rule took).

    Unknown sentences stand between known ones, so a rule's sentences must follow each other. Every text is cut whole, in time proportional to its length; null
    and empty ones have no sentences. Repeated rows give equal rows, an empty table none. Rows need no exchange; other columns are ignored.
    """
    # One literal, which the optimiser makes a map.
    lookup = F.str_to_map(F.lit("\n".join(f"{k}\t{v}" for k, v in known.items())), F.lit("\n"), F.lit("\t"))
    names = sorted(known)
    cut = docs.select("doc_id", sentences(F.coalesce(F.col("text"), F.lit(""))).alias("sentences"))
    # Membership is a hash lookup; the map is read for the few that are known.
    named = cut.select("doc_id", F.size("sentences").cast("long").alias("n_sentences"), F.transform(
        "sentences", lambda s: F.when(s.isin(names), F.try_element_at(lookup, s)).otherwise(F.lit("?"))).alias("found"))
    # A run of unknown sentences parts known ones as a single one does.
    runs = F.filter("found", lambda x, i: (x != "?") | (i == 0) | (F.get("found", i - 1) != "?"))
    sequence = F.array_join(F.transform(runs, lambda x: F.concat(F.lit("<"), x, F.lit(">"))), "")
    for name, parts in rules:
        sequence = F.replace(sequence, F.lit("".join(f"<{p}>" for p in parts)), F.lit(f"<={name}>"))
    marked = named.withColumn("sequence", sequence)
    after = F.regexp_extract_all("sequence", F.lit("<([^>]*)>"), F.lit(1))
    return marked.select(
        "doc_id", "n_sentences", F.filter("found", lambda x: x != "?").alias("identifiers"),
        F.transform(F.filter(after, lambda x: F.startswith(x, F.lit("="))), lambda x: F.substring(x, 2, 1000)).alias("licenses"),
        F.filter(after, lambda x: ~F.startswith(x, F.lit("=")) & (x != "?")).alias("rest"))
