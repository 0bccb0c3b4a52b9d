"""Licence scans: canonical texts, looked up by digest.

Case, punctuation, copyright lines and equivalent spellings are evened out; the SHA-256 of what is left is
joined with the digests of known licence texts. Looked up are a whole document and each of its lines.
"""

from __future__ import annotations

import re
from functools import reduce
from importlib.resources import files

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Spellings held equal, after those of the usual licence-matching guidelines.
SPELLINGS = {"licence": "license", "licences": "licenses", "licenced": "licensed", "licencing": "licensing", "licencee": "licensee", "licencees": "licensees", "licencor": "licensor", "licencors": "licensors", "sublicence": "sublicense", "sublicences": "sublicenses", "sublicenced": "sublicensed", "sublicencing": "sublicensing", "acknowledgement": "acknowledgment", "copyright owner": "copyright holder", "sub license": "sublicense", "non commercial": "noncommercial", "per cent": "percent", "wilful": "willful", "fulfil": "fulfill", "whilst": "while", "favour": "favor", "https": "http"}

COPYRIGHT = r"(?im)^[\s/*#;.-]*(?:copyright\b.*(?:\(c\)|©|[0-9]{4})|\(c\)\s*[0-9]{4}|©).*$"

#: The same within a line, for texts of any length: in a run of blank or banner lines COPYRIGHT reads from each line to the
#: end of the run. What it takes of the lines above a copyright line are characters that canonical texts don't have.
COPYRIGHT_LINE = COPYRIGHT.replace(r"[\s/*#;.-]*", r"[ \t\x0B\f/*#;.-]*+")

#: Notices and short licences by their SPDX identifiers.
NOTICES: tuple[tuple[str, str], ...] = (
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has dedicated all copyright to this work to the public domain."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "Licensed under the GNU General Public License, version 3."),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license."),
    ("ISC", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
)

#: Titles that full texts come with.
TITLES = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)"),
    "ISC": ("ISC License", "The ISC License", "ISC License (ISC)"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The BSD 2-Clause License", "Simplified BSD License", 'BSD 2-Clause "Simplified" License', "BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "The BSD 3-Clause License", "New BSD License", 'BSD 3-Clause "New" or "Revised" License', "BSD License"),
}
FULL = ("MIT", "BSD-3-Clause", "Apache-2.0", "MPL-2.0", "GPL-2.0-only", "GPL-3.0-only", "LGPL-2.1-only", "LGPL-3.0-only", "CC0-1.0")


def full_texts() -> tuple[tuple[str, str], ...]:
    """The full licences in the forms they are copied in: with and without title, numbers, appendix and filled-in fields.

    Lines that begin with a copyright are left out of canonical texts, so each form is also known with a line for each paragraph.
    """
    bodies = [(name, files("terraql.llm").joinpath("licenses", f"{name}.txt").read_text("utf-8")) for name in FULL]
    bodies += [("ISC", text.replace("and/or", old)) for name, text in NOTICES if name == "ISC" for old in ("and/or", "and")]
    bsd = dict(bodies)["BSD-3-Clause"]
    bodies.append(("BSD-2-Clause", re.sub(r"(?ms)^3\..*?\n\n", "", bsd)))
    bodies += [(name, re.sub(r"(?m)^[123]\.", "*", text)) for name, text in bodies if name.startswith("BSD")]
    bodies += [(name, "All rights reserved.\n\n" + text) for name, text in bodies if name in TITLES]
    bodies += [(name, f"{title}\n\n{text}") for name, text in bodies for title in TITLES.get(name, ())]
    bodies += [(name, text.split("END OF TERMS AND CONDITIONS")[0] + end) for name, text in bodies if "END OF TERMS" in text for end in ("", "END OF TERMS AND CONDITIONS")]
    bodies += [(name, text.replace("[yyyy] [name of copyright owner]", "2000")) for name, text in bodies if "[yyyy]" in text]
    bodies += [(name, re.sub(r"(?<=\S)[ ]*\n[ \t]*(?=\S)", " ", text)) for name, text in bodies]
    words = lambda text: " ".join(re.findall(r"[^\W_]+", re.sub(COPYRIGHT, " ", text).lower()))
    return tuple({(name, words(text)): (name, text) for name, text in bodies}.values())


KNOWN = NOTICES + full_texts()


def canonical(text: Column) -> Column:
    """Lower case, no copyright lines, runs of other characters than letters and digits as two blanks, so that each word has its own, one spelling."""
    flat = F.regexp_replace(text, COPYRIGHT_LINE, " ")
    flat = F.trim(F.regexp_replace(F.lower(flat), r"[^\p{L}\p{N}]+", "  "))
    flat = F.concat(F.lit(" "), flat, F.lit(" "))
    for old, new in SPELLINGS.items():
        flat = F.replace(flat, F.lit(_spaced(old)), F.lit(_spaced(new)))
    return F.trim(flat)


def _spaced(words: str) -> str:
    return f" {words.replace(' ', '  ')} "


def known_digests(df: DataFrame, known: tuple[tuple[str, str], ...] = KNOWN) -> DataFrame:
    spark = df.sparkSession
    return spark.createDataFrame(list(known), "license_id string, text string").select("license_id", F.sha2(canonical(F.col("text")), 256).alias("digest")).distinct()


def telling(known: tuple[tuple[str, str], ...]) -> list[str] | None:
    """Pieces of words of which every text that evens out to a known one has some; None if there are no such pieces.

    A word that no spelling leads to stands in the raw text too, and of the others the piece that all their spellings share.
    Those that most of the texts have come first, the longest of these.
    """
    shared = "licen"  # the spellings of licence and its kin
    made = {w: [old for old, new in SPELLINGS.items() if w in new.split()] for new in SPELLINGS.values() for w in new.split()}
    own = []
    for _, text in known:
        words = set(re.findall(r"[a-z]+", re.sub(COPYRIGHT, " ", text).lower()))
        for old, new in SPELLINGS.items():
            words |= set(new.split()) if set(old.split()) <= words else set()
        plain = {w for w in words if len(w) >= 5 and w not in made and not any(w in old.split() for old in SPELLINGS)}
        own.append(plain | ({shared} if any(shared in w and all(shared in old for old in made.get(w, [])) for w in words) else set()))
    out = []
    while own:
        counts: dict[str, int] = {}
        for words in own:
            for w in words:
                counts[w] = counts.get(w, 0) + 1
        if not counts or not all(own):
            return None
        best = max(counts, key=lambda w: (counts[w], len(w), w))
        out.append(best)
        own = [words for words in own if best not in words]
    return out


def license_scan(docs: DataFrame, known: tuple[tuple[str, str], ...] = KNOWN) -> DataFrame:
    """doc_id, license_id, n_lines and whole_text: a row for each document and licence found in it.

    ``n_lines`` counts the lines that are a known text as a whole, ``whole_text`` says whether the document is.
    Null and empty texts hold none. Rows that share a doc_id are counted together. Texts and lines of any length are
    evened out, as copyright lines, punctuation and blanks that fall away have no bound; those without any of the words of
    which each known text has one are not (``telling``). Of the known texts, a table in the code, all digests are broadcast.
    """
    digests = F.broadcast(known_digests(docs, known))
    rows = docs.select("doc_id", "text")
    lines = rows.select("doc_id", F.explode(F.split("text", "[\r\n]+")).alias("unit"), F.lit(1).alias("line"))
    units = lines.unionByName(rows.select("doc_id", F.col("text").alias("unit"), F.lit(0).alias("line"))).where("unit <> ''")
    if pieces := telling(known):
        low = F.lower("unit")
        units = units.where(reduce(lambda a, b: a | b, [F.contains(low, F.lit(p)) for p in pieces]))
    found = units.withColumn("digest", F.sha2(canonical(F.col("unit")), 256)).join(digests, "digest")
    return found.groupBy("doc_id", "license_id").agg(F.sum("line").cast("long").alias("n_lines"), (F.min("line") == 0).alias("whole_text"))


def canonical_sql(text: str) -> str:
    flat = f"' ' || trim(regexp_replace(lower(regexp_replace({text}, '{COPYRIGHT}', ' ', 'g')), '[^\\p{{L}}\\p{{N}}]+', '  ', 'g')) || ' '"
    for old, new in SPELLINGS.items():
        flat = f"replace({flat}, '{_spaced(old)}', '{_spaced(new)}')"
    return f"trim({flat})"


def scan_sql(known: tuple[tuple[str, str], ...] = KNOWN) -> str:
    """The same scan in SQL, comparing canonical texts instead of digests."""
    rows = ", ".join("('{}', '{}')".format(*(x.replace("'", "''") for x in r)) for r in known)
    return f"""
WITH known AS (SELECT DISTINCT license_id, {canonical_sql("t")} AS canon FROM (VALUES {rows}) AS v(license_id, t)),
units AS (
  SELECT doc_id, unnest(regexp_split_to_array(text, '[\r\n]+')) AS unit, 1 AS line FROM documents
  UNION ALL SELECT doc_id, text, 0 FROM documents
), canons AS (SELECT doc_id, line, {canonical_sql("unit")} AS canon FROM units WHERE length(unit) >= 1)
SELECT doc_id, license_id, CAST(sum(line) AS BIGINT) AS n_lines, min(line) = 0 AS whole_text
FROM canons JOIN known USING (canon) GROUP BY doc_id, license_id
"""
