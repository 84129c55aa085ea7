"""License scans by sentence rules, with DataFrame functions only.

Texts are cut into sentences, sentences are normalised (folded, anything but letters and digits one space), and known
licence sentences become identifiers through a broadcast join with a fixed table.  The identifiers of a document, in
order, are a sequence; ordered rules, the longest first, are matched against it from the left, and what a rule has
matched is used up.  Sentences that are not known drop out, so text between licence sentences does no harm.

Licence texts may be wrapped in lines, or stand on a line of their own next to text without full stops; so a text is
cut in two ways, at stops and blank lines only (colons and semicolons count before a line end; a line of comment marks
alone is blank) and at every line end too.  The way in which rules use more sentences counts; of equals, the first.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Licence sentences as published, by identifier.  One character each, so that rules are strings.
SENTENCES = {
    "A": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\");"],
    "B": ["you may not use this file except in compliance with the License."],
    "C": ["You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"],
    "D": ["Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."],
    "E": ["See the License for the specific language governing permissions and limitations under the License."],
    "F": ["Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the MIT License.", "The MIT License (MIT)", "MIT License"],
    "G": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"],
    "H": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."],
    "I": ["This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 3."],
    "J": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "K": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."],
    "L": ["See the GNU General Public License for more details."],
    "M": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    "N": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."],
    "O": ["Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."],
    "P": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "Q": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, version 2.0."],
    "R": ["This work is licensed under a Creative Commons Attribution 4.0 International License.", "This work is licensed under the Creative Commons Attribution 4.0 International License."],
    "S": ["This is free and unencumbered software released into the public domain."],
    "T": ["Licensed under the BSD 3-Clause License.", "Licensed under the 3-Clause BSD License."],
}
# In published texts, as wrapped: 'v.' ends a sentence for the cutter, the URL line ends none, and a line without a stop,
# as a copyright line is, runs into the sentence after it, so rules go by the later sentences too.
SENTENCES |= {
    "f": ["This Source Code Form is subject to the terms of the Mozilla Public License, v."],
    "U": [f"{SENTENCES['C'][0].replace('http:', scheme)} {SENTENCES['D'][0]}" for scheme in ("http:", "https:")],
    "V": [f"Neither the name of {who} {what} be used to endorse or promote products derived from this software without specific prior written permission." for who in ("the copyright holder", "the copyright owner", "the author", "the University", "the project", "the organization", "the <organization>", "the <ORGANIZATION>", "copyright holder") for what in ("nor the names of its contributors may", "nor the names of contributors may", "nor the names of its contributors might")]
    + [f"nor the names of its {who} may be used to endorse or promote products derived from this software without specific prior written permission." for who in ("contributors", "developers")]
    + ["The names of its contributors may not be used to endorse or promote products derived from this software without specific prior written permission."],
    "W": ["THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."],
    "X": ["All advertising materials mentioning features or use of this software must display the following acknowledgement:"],
}
SENTENCES["C"] = [*SENTENCES["C"], SENTENCES["C"][0].replace("http:", "https:")]

# The Creative Commons Attribution licences by their codes above and below.
CC_BY = {
    "R": ("CC BY", "Attribution"),
    "a": ("CC BY-SA", "Attribution-ShareAlike"),
    "b": ("CC BY-NC", "Attribution-NonCommercial"),
    "c": ("CC BY-ND", "Attribution-NoDerivatives"),
    "d": ("CC BY-NC-SA", "Attribution-NonCommercial-ShareAlike"),
    "e": ("CC BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"),
}
CC_FORMS = [
    "{0} 4.0", "Licensed under {0} 4.0.", "Licensed under a {0} 4.0 license.", "Licensed under the {0} 4.0 license.", "Released under {0} 4.0.", "Available under {0} 4.0.",
    "This work is licensed under {0} 4.0.", "This work is licensed under a {0} 4.0 license.", "Content is licensed under {0} 4.0.", "This project is licensed under {0} 4.0.",
    "This work is licensed under a Creative Commons {1} 4.0 International License.", "This work is licensed under the Creative Commons {1} 4.0 International License.",
    "Licensed under a Creative Commons {1} 4.0 International License.", "Licensed under the Creative Commons {1} 4.0 International License.", "Creative Commons {1} 4.0 International License", "Creative Commons {1} 4.0 International",
]
for _code, _names in CC_BY.items():
    SENTENCES[_code] = list(dict.fromkeys(SENTENCES.get(_code, []) + [form.format(*_names) for form in CC_FORMS]))

# The GNU licences by short name: names and versions, as headers and as titles have them.
GNU = {
    "GPL": ("GNU General Public License", {"2": "Version 2, June 1991", "3": "Version 3, 29 June 2007"}),
    "LGPL": ("GNU Lesser General Public License", {"2.1": "Version 2.1, February 1999", "3": "Version 3, 29 June 2007"}),
    "AGPL": ("GNU Affero General Public License", {"3": "Version 3, 19 November 2007"}),
}
THINGS = ("program", "library", "software", "file", "module", "package", "code", "project", "source code", "script", "work", "application")
GRANT = "This {thing} is free software: you can redistribute it and/or modify it under the terms of the {name}"
LATER = [GRANT + " as published by the Free Software Foundation, either version {v} of the License, or (at your option) any later version.", GRANT + ", version {v} or later.", GRANT + ", either version {v} or (at your option) any later version, as published by the Free Software Foundation."]
ONLY = [GRANT + " as published by the Free Software Foundation, version {v} of the License.", GRANT + ", version {v}, as published by the Free Software Foundation.", GRANT + " as published by the Free Software Foundation, version {v}.", GRANT + " version {v} only, as published by the Free Software Foundation."]
UNDER = ("Licensed under the {what}.", "Released under the {what}.", "Distributed under the {what}.", "This {thing} is licensed under the {what}.", "This {thing} is released under the {what}.", "This {thing} is distributed under the {what}.", "This {thing} is distributed under the terms of the {what}.")
# Full texts by their titles and telling sentences, and names of licences in notices.
TEXTS = {
    "Apache-2.0": ["Apache License Version 2.0, January 2004 http://www.apache.org/licenses/", "Apache License Version 2.0, January 2004"],
    "MPL-2.0": ["Mozilla Public License Version 2.0", "Mozilla Public License, version 2.0"],
    "CC0-1.0": ["CC0 1.0 Universal", "Creative Commons Legal Code CC0 1.0 Universal"],
    "Zlib": ["Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"],
    "BSL-1.0": ["Boost Software License - Version 1.0 - August 17th, 2003", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:"],
}
NAMES = {
    "Apache-2.0": ["Apache License 2.0", "Apache License, Version 2.0", "Apache 2.0 License", "Apache-2.0 license"],
    "MIT": ["MIT License", "MIT licence", "MIT/X11 license"],
    "BSD-2-Clause": ["BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "3-Clause BSD License", "New BSD License"],
    "ISC": ["ISC License"],
    "MPL-2.0": ["Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "MPL 2.0"],
    "BSL-1.0": ["Boost Software License, Version 1.0"],
    "Zlib": ["zlib License"],
    "Unlicense": ["Unlicense"],
    "CC0-1.0": ["CC0 1.0 Universal license", "Creative Commons CC0 1.0 Universal license"],
}
SPDX = (
    "0BSD", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-2.0", "Artistic-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSD-4-Clause", "BSL-1.0", "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-SA-4.0", "CC0-1.0", "EPL-1.0",
    "EPL-2.0", "EUPL-1.2", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "ISC", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "MIT", "MPL-2.0", "Unlicense", "WTFPL", "Zlib",
)
#: Codes of the sentences that are built by rule.
_codes = map(chr, range(0x4E00, 0x9FA5))


def _built() -> list[tuple[str, str, str]]:
    """Adds the sentences of the tables above; returns their rules."""
    rules, notices, known = [], [], {s: c for c, texts in SENTENCES.items() for s in map(_plain, texts)}

    def add(texts: list[str]) -> str | None:
        texts = [t for t in dict.fromkeys(texts) if _plain(t) not in known]
        if texts:
            code = next(_codes)
            SENTENCES[code] = texts
            known.update((_plain(t), code) for t in texts)
            return code
        return None

    def notice(licence: str, names: list[str]) -> None:
        if code := add([form.format(what=n, thing=t) for n in names for form in UNDER for t in THINGS]):
            notices.append((code, licence, "notice"))

    for short, (name, versions) in GNU.items():
        more = add([f"See the {name} for more details."])
        for v, title in versions.items():
            full = v if "." in v else f"{v}.0"
            for forms, suffix in ((LATER, "or-later"), (ONLY, "only")):
                if code := add([f.format(thing=t, name=n, v=v) for f in forms for t in THINGS for n in (name, name.replace("Lesser", "Library") if v == "2.1" else name)]):
                    rules.append((code + (more or "L"), f"{short}-{full}-{suffix}", "header"))
                    notices.append((code, f"{short}-{full}-{suffix}", "notice"))
            if code := add([f"{name} {title}"]):
                notices.append((code, f"{short}-{full}", "text"))
            notice(f"{short}-{full}-or-later", [f"{n} {x}" for n in (f"{name}, version {v}", f"{name} v{v}", f"{short} v{v}", f"{short}v{v}", f"{short}-{full}") for x in ("or later", "or any later version", "or (at your option) any later version")])
            notice(f"{short}-{full}-only", [f"{name}, version {v}", f"{name} version {full}", f"{name} v{v}", f"{name} v{full}", f"{short} v{v}", f"{short}v{v}", f"{short} {full}", f"{short}-{full} license", f"{short}-{full}"])
    for licence, texts in TEXTS.items():
        if code := add(texts):
            notices.append((code, licence, "text"))
    for licence, names in NAMES.items():
        notice(licence, names)
    for licence in SPDX:
        if code := add([f"SPDX-License-Identifier: {licence}"]):
            notices.append((code, licence, "notice"))
    return rules + notices


def _plain(text: str) -> str:
    return re.sub("[^a-z0-9]+", " ", text.lower()).strip()


# The URL of the Apache header stands between blank lines, so its sentence ends before it.
SENTENCES["C"] += ["You may obtain a copy of the License at"]

# Rules in order; of two that fit at one place the earlier is taken.
RULES = [
    ("ABCDE", "Apache-2.0", "header"),
    ("ABUE", "Apache-2.0", "header"),
    ("ABU", "Apache-2.0", "header"),
    ("BUE", "Apache-2.0", "header"),
    ("BU", "Apache-2.0", "header"),
    ("ABCD", "Apache-2.0", "header"),
    ("ABDE", "Apache-2.0", "header"),
    ("FGH", "MIT", "text"),
    ("GH", "MIT", "text"),
    ("HW", "MIT", "text"),
    ("MNOXV", "BSD-4-Clause", "text"),
    ("NOXV", "BSD-4-Clause", "text"),
    ("MNOV", "BSD-3-Clause", "text"),
    ("NOV", "BSD-3-Clause", "text"),
    ("MNO", "BSD-2-Clause", "text"),
    ("NO", "BSD-2-Clause", "text"),
    ("JL", "GPL-3.0-or-later", "header"),
    ("KL", "GPL-2.0-or-later", "header"),
    ("A", "Apache-2.0", "notice"),
    ("F", "MIT", "notice"),
    ("I", "GPL-3.0-only", "notice"),
    ("J", "GPL-3.0-or-later", "notice"),
    ("K", "GPL-2.0-or-later", "notice"),
    ("P", "ISC", "text"),
    ("f", "MPL-2.0", "notice"),
    ("Q", "MPL-2.0", "notice"),
    ("R", "CC-BY-4.0", "notice"),
    ("S", "Unlicense", "text"),
    ("T", "BSD-3-Clause", "notice"),
    *[(code, name.replace(" ", "-") + "-4.0", "notice") for code, (name, _) in CC_BY.items() if code != "R"],
]

_rules = _built()
RULES = [*(r for r in _rules if r[2] == "header"), *RULES, *(r for r in _rules if r[2] != "header")]

#: Every known sentence holds one of these; all are single words but one, so line ends inside a sentence do no harm.
ANCHORS = r"licen|copyright|permission|redistribut|unencumbered|warrant|commons|cc0|cc[^a-z0-9]+by|endorse|advertising|gpl|\bmpl\b"

BLANK_LINES = r"[\r\n][ \t#/*;%>|-]*[\r\n]+"
STOP, LINE_STOP = r"([a-z0-9\)\x22][.!?])\s+", r"([a-z0-9\)\x22][;:])[ \t]*[\r\n]\s*"
MARK = "\u0001"
PATTERN = "|".join(sequence for sequence, _, _ in RULES)


def normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document and licence: doc_id, licence, kind (text, header or notice), n_matches.

    Whole texts are scanned, very long ones too: a text without any of the words of ``ANCHORS`` is passed over, of others
    the sentences are cut and looked up one by one.  Null and empty texts have no findings; documents without any give no
    row.  Of rows with one id, and of repeated rows, each has its own findings; ids may be null.  No rows give no rows;
    further columns are ignored.
    """
    spark = docs.sparkSession
    known = spark.createDataFrame([(s, code) for code, texts in SENTENCES.items() for s in texts], "raw string, code string")
    known = F.broadcast(known.select(normal(F.col("raw")).alias("sentence"), "code").distinct())  # a fixed table
    rules = F.broadcast(spark.createDataFrame(RULES, "sequence string, licence string, kind string"))

    low = F.lower(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("row_id"), low.alias("low"))
    stops = F.regexp_replace(F.regexp_replace(F.regexp_replace("low", BLANK_LINES, MARK), STOP, "$1" + MARK), LINE_STOP, "$1" + MARK)
    lines = F.regexp_replace(stops, r"[\r\n]+", MARK)
    cut = rows.where(F.col("low").rlike(ANCHORS)).select("doc_id", "row_id", F.explode(F.array(F.struct(F.lit(0).alias("way"), stops.alias("marked")), F.struct(F.lit(1).alias("way"), lines.alias("marked")))).alias("c"))
    sentences = cut.select("doc_id", "row_id", "c.way", F.posexplode(F.split("c.marked", MARK)).alias("pos", "raw"))
    codes = sentences.select("doc_id", "row_id", "way", "pos", normal(F.col("raw")).alias("sentence")).join(known, "sentence")
    # a document's licence sentences only
    ordered = lambda way: F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.when(F.col("way") == way, F.struct("pos", "code")))), lambda x: x["code"]))
    sequences = codes.groupBy("row_id", "doc_id").agg(ordered(0).alias("codes_0"), ordered(1).alias("codes_1"))
    found = lambda way: F.regexp_extract_all(f"codes_{way}", F.lit(f"({PATTERN})"), F.lit(1))
    better = F.when(F.length(F.array_join(found(1), "")) > F.length(F.array_join(found(0), "")), found(1)).otherwise(found(0))
    hits = sequences.select("row_id", "doc_id", F.explode(better).alias("sequence")).join(rules, "sequence")
    return hits.groupBy("row_id", "doc_id", "licence", "kind").agg(F.count(F.lit(1)).alias("n_matches")).drop("row_id")


def oracle() -> str:
    """The same in DuckDB's SQL."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    known = ", ".join(f"({quoted(s)}, '{code}')" for code, texts in SENTENCES.items() for s in texts)
    rules = ", ".join(f"('{s}', '{name}', '{kind}')" for s, name, kind in RULES)
    norm = lambda x: f"trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'))"
    return rf"""
WITH known AS (SELECT DISTINCT {norm('raw')} AS sentence, code FROM (VALUES {known}) v(raw, code)),
rules AS (SELECT * FROM (VALUES {rules}) v(sequence, licence, kind)),
marked AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(lower(text), '[\r\n][ \t#/*;%>|-]*[\r\n]+', chr(1), 'g'), '([a-z0-9\)\x22][.!?])\s+', '\1' || chr(1), 'g'), '([a-z0-9\)\x22][;:])[ \t]*[\r\n]\s*', '\1' || chr(1), 'g') AS m FROM documents),
ways AS (SELECT doc_id, 0 AS way, m FROM marked UNION ALL SELECT doc_id, 1, regexp_replace(m, '[\r\n]+', chr(1), 'g') FROM marked),
cut AS (SELECT doc_id, way, unnest(string_split(m, chr(1))) AS raw, generate_subscripts(string_split(m, chr(1)), 1) AS pos FROM ways),
codes AS (SELECT doc_id, way, pos, code FROM cut JOIN known ON {norm('raw')} = sentence),
seqs AS (SELECT doc_id, way, regexp_extract_all(string_agg(code, '' ORDER BY pos), '{PATTERN}') AS found FROM codes GROUP BY doc_id, way),
chosen AS (SELECT doc_id, found, row_number() OVER (PARTITION BY doc_id ORDER BY length(array_to_string(found, '')) DESC, way) AS r FROM seqs),
hits AS (SELECT doc_id, unnest(found) AS sequence FROM chosen WHERE r = 1)
SELECT doc_id, licence, kind, count(*) AS n_matches FROM hits JOIN rules USING (sequence) GROUP BY doc_id, licence, kind
"""
