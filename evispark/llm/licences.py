"""Licence scans by sentence rules: sentences are normalised and mapped to the identifiers of known licence sentences, and
the sequence of identifiers is matched against ordered licence rules. Sentences are looked up as a whole; patterns stand for those that have
slots for names, years or versions. DataFrame functions only, and no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

#: Where a sentence ends: after a stop (but that of an abbreviation), at a line without letters and digits, and after a line that ends in a colon.
ENDS = r"(?<=[.!?])(?<!\b(?i:v|ver|no|inc|ltd|e\.g|i\.e)\.)[\x20\x09-\x0D]++(?!(?i:nor\s+the\s+names?\b))|\n[^\p{L}\p{N}\n]*\n|(?<=:)[\x20\x09\x0D]*\n"
#: Lines that are notices by themselves, and what starts a sentence where it starts a line.
NOTICE = r"(?imd)^[^\p{L}\p{N}\n]*(?:copyright[^\p{L}\p{N}\n]*(?:\(c\)|\u00a9|\d)|\(c\)|all[ ]rights[ ]reserved|spdx[ -]license[ -]identifier)[^\n]*$"
STARTS = (
    r"(?imd)^(?=[^\p{L}\p{N}\n]*(?:[0-9a-z]{1,2}[.)][\x20\x09]+)?(?:permission is hereby granted|the above copyright notice and this|the software is provided"
    r"|redistribution and use in|redistributions of source|redistributions in binary|neither the name of|this program is|you should have received|see the gnu))"
)
#: Texts without any of these have neither a known sentence nor one that speaks of licences.
GATE = (
    r"(?i)licen[cs]e|copyright|\([\W_]*c[\W_]*\)|creative[\W_]+commons|cc[\W_]*by|cc0|permission|redistribut|warrant|public[\W_]+domain|gpl|gnu"
    r"|spdx|apache|bsd|mozilla|attribution|dedication|contributors|free[\W_]+software|this[\W_]+program|all[\W_]+rights"
)
#: Sentences that aren't known and have none of these don't speak of licences.
SPEAKS = r"(?i)licen[cs]e|copyright|creative commons|\bcc[ -]?by|permission is|redistribut|warrant|public domain|\bgpl|spdx"

#: Known sentences, as patterns over the normalised sentence (lower case, single spaces, no punctuation but
#: that of names and versions), each with its identifier. The first pattern that matches counts.
SENTENCES = [
    ("SPDX", r".*\bspdx[ -]license[ -]identifier [a-z0-9.+()-]+.*"),
    ("GPL3Free", r"this program is free software you can redistribute it and or modify it under the terms of the gnu general public license .*\bversion 3\b.*"),
    ("GPL2Free", r"this program is free software you can redistribute it and or modify it under the terms of the gnu general public license .*\bversion 2\b.*"),
    ("GPLSee", r"see the gnu general public license for more details.*"),
    ("GPLCopy", r"you should have received a copy of the gnu general public license.*"),
    ("Apache2Name", r".*\bapache license,? version 2(\.0)?\b.*"),
    ("Apache2Short", r".*\bapache[ -]2(\.0)?\b.*"),
    ("AGPL3Name", r".*\bgnu affero general public license\b.*\b(version|v) ?3\b.*"),
    ("LGPL21Name", r".*\bgnu lesser general public license\b.*\b(version|v) ?2\.1\b.*"),
    ("LGPL3Name", r".*\bgnu lesser general public license\b.*\b(version|v) ?3\b.*"),
    ("GPL3Name", r".*\bgnu general public license\b.*\b(version|v) ?3\b.*"),
    ("GPL2Name", r".*\bgnu general public license\b.*\b(version|v) ?2\b.*"),
    ("GPLName", r".*\b(gnu general public license|gnu gpl)\b.*"),
    ("GPLFree", r"this program is free software you can redistribute it and or modify it .*"),
    ("GPLHope", r"this program is distributed in the hope that it will be useful.*"),
    ("GPLCopy", r"you should have received a copy of the gnu .*"),
    ("MITName", r".*\bmit license\b.*"),
    ("MITGrant", r"permission is hereby granted free of charge to any person obtaining a copy .*"),
    ("MITNotice", r"the above copyright notice and this permission notice shall be included .*"),
    ("MITAsIs", r"the software is provided as is without warranty of any kind .*"),
    ("BSDRedistribute", r"redistribution and use in source and binary forms .*"),
    ("BSDSource", r".*redistributions of source code must retain the above copyright notice.*"),
    ("BSDBinary", r".*redistributions in binary form must reproduce the above copyright notice.*"),
    ("BSDEndorse", r".*neither the name of .* nor the names of its contributors .*"),
    ("BSDName", r".*\bbsd[ -][23][ -]clause\b.*"),
    ("MPL2Name", r".*\bmozilla public license,? (version|v)[ .]?2(\.0)?\b.*"),
    ("ISCName", r".*\bisc license\b.*"),
    ("ZlibName", r".*\bzlib license\b.*"),
    ("BoostName", r".*\bboost software license,?( -)? (version|v) ?1\.0\b.*"),
    ("EPL2Name", r".*\beclipse public license,?( -)? ?(version|v)? ?2\.0\b.*"),
    ("UnlicenseName", r".*\bthe unlicense\b.*"),
    ("CCByNcSa", r".*\b(cc[ -]by-nc-sa|attribution-noncommercial-sharealike)[ -]\d(\.\d)?\b.*"),
    ("CCByNcNd", r".*\b(cc[ -]by-nc-nd|attribution-noncommercial-noderivatives)[ -]\d(\.\d)?\b.*"),
    ("CCByNc", r".*\b(cc[ -]by-nc|attribution-noncommercial)[ -]\d(\.\d)?\b.*"),
    ("CCBySa", r".*\b(cc[ -]by-sa|attribution-sharealike)[ -]\d(\.\d)?\b.*"),
    ("CCBy", r".*\b(cc[ -]by|creative commons attribution)[ -]\d(\.\d)?\b.*"),
    ("CC0", r".*\b(cc0|public domain dedication)\b.*"),
    ("AllRights", r"all rights reserved.*"),
    ("Copyright", r"(copyright|\(c\)) .*"),
]

#: Known sentences as a whole, by identifier, as their licences have them. They are looked up by their normalised text.
WHOLE = {
    "ISCGrant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "ISCAsIs": 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.',
    "ISCLoss": "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "UnlicenseFree": "This is free and unencumbered software released into the public domain.",
    "UnlicenseAnyone": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "ZlibAsIs": "This software is provided 'as-is', without any express or implied warranty.",
    "ZlibGrant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "ZlibOrigin": "The origin of this software must not be misrepresented; you must not claim that you wrote the original software.",
    "BoostTitle": "Boost Software License - Version 1.0 - August 17th, 2003",
    "BoostGrant": 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:',
    "BoostName": "Distributed under the Boost Software License, Version 1.0.",
    "EPL2Terms": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "EPL2Terms2": "This program and the accompanying materials are made available under the terms of the Eclipse Public License v. 2.0 which is available at http://www.eclipse.org/legal/epl-2.0.",
    "MPL2Terms": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "MPL2Copy": "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "MPL2Copy2": "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "WTFPLTitle": "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE",
    "CC0Dedicates": "The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law, including all related and neighboring rights, to the extent allowed by law.",
    "ArtisticName": "This library is free software; you can redistribute it and/or modify it under the Artistic License 2.0.",
    "PSFName": "This is licensed under the Python Software Foundation License Version 2.",
}

#: The names by which sentences speak of licences, and what sets them apart from a grant: a negation or a comparison a
#: few words before the name.
NAMES = (
    r"(?:mit license|apache license|apache[ -]2|gnu (?:affero |lesser )?general public license|gnu gpl|bsd[ -][23][ -]clause|mozilla public license|isc license|zlib license|boost software license"
    r"|eclipse public license|unlicense|cc0|cc[ -]by|creative commons|attribution-)"
)
APART = (
    rf"\b(?:not|never|neither|no longer|isn t|aren t|cannot|can t|unlike|instead of|rather than|other than|similar to|compared (?:to|with)|compatible with|inspired by|formerly|differs? from)\b(?: \S+){{0,8}}? {NAMES}"
)

#: Known sentences that are whole clauses, which lines may be wrapped in.
CLAUSES = ["GPL3Free", "GPL2Free", "GPLFree", "GPLHope", "GPLSee", "GPLCopy", "MITGrant", "MITNotice", "MITAsIs", "BSDRedistribute", "BSDSource", "BSDBinary", "BSDEndorse", *WHOLE]
#: The licence expression of an SPDX tag.
TAG = r"(?i)spdx[ -]license[ -]identifier ([a-z0-9.+()-]+(?: (?:or|and|with) [a-z0-9.+()-]+)*)"

#: Licence rules in the order in which they are tried; each is a sequence of sentence identifiers in a row.
RULES = [
    ("ISC", ["ISCGrant", "ISCAsIs", "ISCLoss"]),
    ("ISC", ["ISCGrant", "ISCAsIs"]),
    ("ISC", ["ISCGrant"]),
    ("Unlicense", ["UnlicenseFree", "UnlicenseAnyone"]),
    ("Unlicense", ["UnlicenseFree"]),
    ("Zlib", ["ZlibAsIs", "ZlibGrant", "ZlibOrigin"]),
    ("Zlib", ["ZlibGrant"]),
    ("BSL-1.0", ["BoostTitle", "BoostGrant"]),
    ("BSL-1.0", ["BoostTitle"]),
    ("BSL-1.0", ["BoostName"]),
    ("BSL-1.0", ["BoostGrant"]),
    ("EPL-2.0", ["EPL2Terms"]),
    ("EPL-2.0", ["EPL2Terms2"]),
    ("MPL-2.0", ["MPL2Terms", "MPL2Copy"]),
    ("MPL-2.0", ["MPL2Terms", "MPL2Copy2"]),
    ("MPL-2.0", ["MPL2Terms"]),
    ("WTFPL", ["WTFPLTitle"]),
    ("CC0-1.0", ["CC0Dedicates"]),
    ("Artistic-2.0", ["ArtisticName"]),
    ("PSF-2.0", ["PSFName"]),
    ("GPL-3.0-notice", ["GPL3Free", "GPLHope", "GPLSee", "GPLCopy"]),
    ("GPL-2.0-notice", ["GPL2Free", "GPLHope", "GPLSee", "GPLCopy"]),
    ("GPL-3.0-notice", ["GPLFree", "GPLHope", "GPLCopy"]),
    ("GPL-3.0", ["GPL3Free"]),
    ("GPL-2.0", ["GPL2Free"]),
    ("MIT", ["MITGrant", "MITNotice", "MITAsIs"]),
    ("BSD-3-Clause", ["BSDRedistribute", "BSDSource", "BSDBinary", "BSDEndorse"]),
    ("BSD-2-Clause", ["BSDRedistribute", "BSDSource", "BSDBinary"]),
    ("Apache-2.0", ["Apache2Name"]),
    ("Apache-2.0", ["Apache2Short"]),
    ("AGPL-3.0", ["AGPL3Name"]),
    ("LGPL-2.1", ["LGPL21Name"]),
    ("LGPL-3.0", ["LGPL3Name"]),
    ("GPL-3.0", ["GPL3Name"]),
    ("GPL-2.0", ["GPL2Name"]),
    ("GPL", ["GPLName"]),
    ("MIT", ["MITName"]),
    ("BSD", ["BSDName"]),
    ("MPL-2.0", ["MPL2Name"]),
    ("ISC", ["ISCName"]),
    ("Zlib", ["ZlibName"]),
    ("EPL-2.0", ["EPL2Name"]),
    ("Unlicense", ["UnlicenseName"]),
    ("CC-BY-NC-SA", ["CCByNcSa"]),
    ("CC-BY-NC-ND", ["CCByNcNd"]),
    ("CC-BY-NC", ["CCByNc"]),
    ("CC-BY-SA", ["CCBySa"]),
    ("CC-BY", ["CCBy"]),
    ("CC0-1.0", ["CC0"]),
    ("all-rights-reserved", ["Copyright", "AllRights"]),
]


def plain(sentence: Column) -> Column:
    """Single spaces, and only letters, digits, parentheses, and dots, hyphens and pluses within words."""
    spaced = F.regexp_replace(sentence, r"[^\p{L}\p{N}.+()-]+", " ")
    return F.trim(F.regexp_replace(spaced, r"(?<![\p{L}\p{N}])[.+-]+|[.-]+(?![\p{L}\p{N}])", ""))


def normalise(sentence: Column) -> Column:
    """``plain`` in lower case."""
    return plain(F.lower(sentence))


def _known() -> Column:
    """The known whole sentences by a hash of their normalised text."""
    return F.create_map(*(x for name, text in WHOLE.items() for x in (F.xxhash64(normalise(F.lit(text))), F.lit(name))))


def sentence_id(sentence: Column) -> Column:
    """The identifier of a normalised sentence: that of the known sentence that it is as a whole, else of the first pattern that it
    fits; ``Unknown`` for one that speaks of licences but isn't known, or sets itself apart from one; null for others."""
    found = F.when(sentence.rlike(SPEAKS), "Unknown")
    for name, pattern in reversed(SENTENCES):
        found = F.when(sentence.rlike(f"^(?:{pattern})$"), name).otherwise(found)
    found = F.when(found.isNotNull() & sentence.rlike(APART), "Unknown").otherwise(found)
    return F.coalesce(F.try_element_at(_known(), F.xxhash64(sentence)), found)


def tagged(lines: Column) -> Column:
    """The identifiers of plain lines; that of an SPDX tag has the tag's licence expression after a colon."""
    one = lambda s: let(sentence_id(F.lower(s)), lambda x: F.when(x == "SPDX", F.concat(F.lit("SPDX:"), F.regexp_extract(s, TAG, 1))).otherwise(x))
    return F.transform(lines, one)


def sentence_ids(lines: Column) -> Column:
    """The identifiers of a sentence that is written in plain ``lines``: a clause is one, whatever its lines are; else lines
    that are known by themselves count each where there are several, or where the sentence as a whole isn't known."""
    known = lambda ids: F.filter(ids, lambda x: x.isNotNull() & (x != "Unknown"))

    def chosen(whole: Column) -> Column:
        def by_line(ids: Column) -> Column:
            few = F.when(whole[0].isNotNull() & (whole[0] != "Unknown"), 2).otherwise(1)
            return F.when(F.size(known(ids)) >= few, ids).otherwise(whole)

        return F.when((F.size(lines) < 2) | F.coalesce(whole[0].isin(CLAUSES), F.lit(False)), whole).otherwise(let(tagged(lines), by_line))

    return let(tagged(F.array(F.array_join(lines, " "))), chosen)


def scan(docs: DataFrame, keep: list[str] = ("doc_id",)) -> DataFrame:
    """Rows of ``docs`` that have a licence sentence: ``keep``, the sentence ids in order, and the licences found.

    ``licences`` joins what the rules find, in order of place, by commas (repeats kept); it is empty where no rule
    matches. ``n_unknown`` counts sentences that speak of licences and are in no rule that matched; a sentence that names a licence
    only to say that it doesn't hold is one of them. Null and empty texts have no sentences and so no row, nor has an
    empty table. Repeated rows give repeated rows. Of rules that could match at one place the first in RULES does. Very
    long texts are read as a whole, one at a time. Kept columns may have any name but those of the three results.
    """
    kept = {f"_keep{i}": name for i, name in enumerate(keep)}
    body = F.coalesce("text", F.lit(""))
    # Most texts have no such word at all, and are not split.
    asked = docs.where(F.coalesce(F.col("text").rlike(GATE), F.lit(False))).select(*(F.col(c).alias(k) for k, c in kept.items()), body.alias("_text"))
    apart = F.regexp_replace(F.regexp_replace("_text", NOTICE, "\n\n$0\n\n"), STARTS, "\n\n")
    cut = asked.select(*kept, F.split(apart, ENDS, -1).alias("_cut"))
    lines = cut.select(*kept, F.transform("_cut", lambda s: F.filter(F.transform(F.split(s, "\n", -1), plain), lambda x: x != "")).alias("_lines"))
    named = lines.select(*kept, F.filter(F.flatten(F.transform("_lines", sentence_ids)), lambda x: x.isNotNull()).alias("_ids")).where(F.size("_ids") > 0)
    matched = F.concat(F.lit(";"), F.array_join("_ids", ";;"), F.lit(";"))
    for licence, ids in RULES:
        matched = F.replace(matched, F.lit("".join(f";{x};" for x in ids)), F.lit(f"<{licence}>"))
    matched = F.regexp_replace(matched, ";SPDX:([^;<>]+);", "<$1>")
    found = named.select(*kept, F.array_join("_ids", ",").alias("sentence_ids"), matched.alias("_matched"))
    return found.select(
        *(F.col(k).alias(c) for k, c in kept.items()),
        "sentence_ids",
        F.array_join(F.regexp_extract_all("_matched", F.lit("<([^>]+)>"), F.lit(1)), ",").alias("licences"),
        F.regexp_count("_matched", F.lit(";[^;<>]+;")).cast("long").alias("n_unknown"),
    )
