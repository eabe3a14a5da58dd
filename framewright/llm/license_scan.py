"""License scans: sentence-rule recognition (DataFrame functions only).

A text is cut after . ! ? ; : before white space, and each piece into lines. Normalised (lower case, only letters,
digits and inner dots, single spaces), a line or a run of lines that is a known licence sentence becomes its
identifier, the longest run first (so wrapped and commented texts are read like others; a blank line ends a run); the
rest becomes nothing, and the sequence of identifiers remains. The BSD clause may name any holder of up to 12 words. An
ordered list of rules, each a sequence of identifiers with or without gaps between them, is matched against it: the
first rule that fits at a place gives the licence. All rules are reported, with the first as the document's licence.

Edge cases: null and empty texts have no licence. Repeated sentences count once for the result, repeated rows each give
their own. Where several rules fit, the order of the rules decides; among sentences that begin at one place, the longest.
Very long texts are scanned whole; pieces without any licence word are skipped before they are compared. An empty table
gives an empty result. Further columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

#: Identifier -> normalised licence sentence. Fixed values.
SENTENCES = {
    "APACHE2": "licensed under the apache license version 2.0",
    "APACHE2_COPY": "you may obtain a copy of the license at",
    "APACHE2_WARRANTY": "without warranties or conditions of any kind either express or implied",
    "MIT": "released under the mit license",
    "MIT_GRANT": "permission is hereby granted free of charge to any person obtaining a copy of this software",
    "MIT_NOTICE": "the above copyright notice and this permission notice shall be included in all copies",
    "GPL3": "this work is licensed under the gnu general public license version 3",
    "GPL_FREE": "this program is free software",
    "GPL_V3": "either version 3 of the license or at your option any later version",
    "BYNC4": "licensed under cc by nc 4.0",
    "BY4": "licensed under cc by 4.0",
    "CC0": "released under cc0 1.0",
    "BSD_REDIST": "redistribution and use in source and binary forms with or without modification are permitted",
    "BSD_NAME": "neither the name of the copyright holder nor the names of its contributors may be used",
}

#: Further normalised sentences: the whole ones of the licences' own texts, and common one-line forms. Fixed values.
WHOLE = {
    "licensed under the apache license version 2.0 the license": "APACHE2",
    "the asf licenses this file to you under the apache license version 2.0 the license": "APACHE2",
    "this project is licensed under the apache license version 2.0": "APACHE2",
    "this project is licensed under the apache license 2.0": "APACHE2",
    "licensed under the apache license 2.0": "APACHE2",
    "licensed under the apache 2.0 license": "APACHE2",
    "you may obtain a copy of the license at http www.apache.org licenses license 2.0": "APACHE2_COPY",
    "you may obtain a copy of the license at https www.apache.org licenses license 2.0": "APACHE2_COPY",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "APACHE2_WARRANTY",
    "this project is licensed under the mit license": "MIT",
    "this software is released under the mit license": "MIT",
    "licensed under the mit license": "MIT",
    "distributed under the mit license": "MIT",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "MIT_GRANT",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "MIT_NOTICE",
    "the above copyright notice and this permission notice including the next paragraph shall be included in all copies or substantial portions of the software": "MIT_NOTICE",
    "licensed under the gnu general public license version 3": "GPL3",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "GPL_TERMS_V3",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "BSD_REDIST",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "BSD_NAME",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "GPL_V2",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation version 2": "GPL2",
    "you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation": "GPL2",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation version 3": "GPL3",
    "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2.1 of the license or at your option any later version": "LGPL_V21",
    "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version": "LGPL_V3",
    "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version": "AGPL_V3",
    "this source code form is subject to the terms of the mozilla public license v": "MPL",
    "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla.org mpl 2.0": "MPL2_COPY",
    "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla.org mpl 2.0": "MPL2_COPY",
    "this source code form is subject to the terms of the mozilla public license version 2.0": "MPL2",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "ISC_GRANT",
    "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "ISC_GRANT",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "ZERO_BSD",
    "this is free and unencumbered software released into the public domain": "UNLICENSE",
    "this work is licensed under a creative commons attribution 4.0 international license": "BY4",
    "this work is licensed under the creative commons attribution 4.0 international license": "BY4",
    "this work is licensed under a creative commons attribution sharealike 4.0 international license": "BYSA4",
    "this work is licensed under the creative commons attribution sharealike 4.0 international license": "BYSA4",
    "this work is licensed under a creative commons attribution noncommercial 4.0 international license": "BYNC4",
}

#: (licence, identifiers in order); earlier rules win. Fixed values.
RULES = [
    ("Apache-2.0", ["APACHE2", "APACHE2_COPY", "APACHE2_WARRANTY"]),
    ("Apache-2.0", ["APACHE2"]),
    ("MIT", ["MIT_GRANT", "MIT_NOTICE"]),
    ("MIT", ["MIT"]),
    ("ISC", ["ISC_GRANT"]),
    ("0BSD", ["ZERO_BSD"]),
    ("MPL-2.0", ["MPL", "MPL2_COPY"]),
    ("MPL-2.0", ["MPL2"]),
    ("AGPL-3.0-or-later", ["AGPL_V3"]),
    ("LGPL-3.0-or-later", ["LGPL_V3"]),
    ("LGPL-2.1-or-later", ["LGPL_V21"]),
    ("GPL-3.0-or-later", ["GPL_TERMS_V3"]),
    ("GPL-3.0-or-later", ["GPL_FREE", "GPL_V3"]),
    ("GPL-2.0-or-later", ["GPL_V2"]),
    ("GPL-2.0-only", ["GPL2"]),
    ("GPL-3.0-only", ["GPL3"]),
    ("BSD-3-Clause", ["BSD_REDIST", "BSD_NAME"]),
    ("BSD-2-Clause", ["BSD_REDIST"]),
    ("CC-BY-NC-4.0", ["BYNC4"]),
    ("CC-BY-SA-4.0", ["BYSA4"]),
    ("CC-BY-4.0", ["BY4"]),
    ("Unlicense", ["UNLICENSE"]),
    ("CC0-1.0", ["CC0"]),
]

_HINT = "licen|released|permission|copyright|warrant|redistribut|free[^a-z0-9]+software|[^a-z]mpl[^a-z]|unencumbered|either[^a-z0-9]+version"
_KNOWN = {s: name for name, s in SENTENCES.items()} | WHOLE
_HOLDER = "neither the name of the copyright holder nor "


def _pattern(sentence: str) -> str:
    """Between words a space or a line's end and the next one's beginning."""
    gap = r"(?: |\|\|)"
    words = [re.escape(w) for w in sentence.split()]
    if sentence.startswith(_HOLDER):
        at = sentence.split().index("nor")
        return gap.join(words[:4]) + gap + rf"(?:[a-z0-9.]+{gap}){{1,12}}?" + gap.join(words[at:])
    return gap.join(words)


#: Known sentences as whole lines or runs of lines, each line between bars; the longest first.
RUN = r"\|(?:" + "|".join(_pattern(s) for s in sorted(_KNOWN, key=lambda s: (-len(s), s))) + r")\|"


def normalise(sentence: Column) -> Column:
    spaced = F.regexp_replace(F.lower(sentence), r"[^a-z0-9.]+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(spaced, r"\.+( |$)", " "), " +", " "))


def identifiers(text: Column) -> Column:
    """The known sentences of a text, in order."""
    pieces = F.filter(F.split(F.coalesce(text, F.lit("")), r"(?<=[.!?;:])\s+"), lambda s: F.lower(s).rlike(_HINT))
    lines = lambda s: F.concat(F.lit("|"), F.array_join(F.transform(F.split(s, "\n"), normalise), "||"), F.lit("|"))
    found = F.flatten(F.transform(pieces, lambda s: F.regexp_extract_all(lines(s), F.lit(RUN), F.lit(0))))
    table = F.create_map(*[F.lit(x) for s, name in _KNOWN.items() for x in (s, name)])
    plain = lambda s: F.regexp_replace(F.trim(F.regexp_replace(s, r"\|+", " ")), "^neither the name of .*? nor ", _HOLDER)
    return F.filter(F.transform(found, lambda s: F.try_element_at(table, plain(s))), lambda x: x.isNotNull())


def matches(sequence: Column) -> Column:
    """The licences whose rule fits the identifiers, in the order of the rules."""
    line = F.concat(F.lit(","), F.concat_ws(",", sequence), F.lit(","))
    hits = [F.when(line.rlike("," + ",(?:[A-Z0-9_]+,)*".join(ids) + ","), F.lit(name)) for name, ids in RULES]
    return F.array_distinct(F.filter(F.array(*hits), lambda x: x.isNotNull()))


def scan(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_license_sentences, sentence_ids, licenses (both joined by commas) and license (the first, or null)."""
    found = let(identifiers(F.col("text")), lambda s: F.struct(s.alias("ids"), matches(s).alias("all")))
    return docs.select("doc_id", found.alias("__f")).select(
        "doc_id",
        F.size("__f.ids").cast("long").alias("n_license_sentences"),
        F.concat_ws(",", "__f.ids").alias("sentence_ids"),
        F.concat_ws(",", "__f.all").alias("licenses"),
        F.get("__f.all", F.lit(0)).alias("license"),
    )
