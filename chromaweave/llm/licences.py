"""Licence detection by canonical digests, in DataFrame expressions only.

A text is normalised (case, punctuation and so comment marks and line breaks, equivalent spellings, and what may stand before and
after a licence's terms: its title, copyright notices, its appendix) and its SHA-256 is looked up among the digests of known
licences and notices. The lookup is made for each whole text and for each of its lines, so a notice on a line of its own is found
as well.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Spellings that licence texts use for the same word; applied to normalised text, in this order.
SPELLINGS = [
    ("licence", "license"),
    ("sub license", "sublicense"),
    ("non commercial", "noncommercial"),
    ("organisation", "organization"),
    ("favour", "favor"),
    ("per cent", "percent"),
    ("copyright owner", "copyright holder"),
    ("merchantibility", "merchantability"),
]

#: Published licence texts and notices (identifier, text).
KNOWN = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    (
        "MIT",
        "MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "ISC",
        "ISC License\n\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "0BSD",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "Zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n\n3. This notice may not be removed or altered from any source distribution.",
    ),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
]

#: Whole texts in their published line breaks, one file for each identifier.
KNOWN += [(p.stem, p.read_text(encoding="utf-8")) for p in sorted((Path(__file__).parent / "licence_texts").glob("*.txt"))]

#: Words with which the terms of licences begin and end, in normal form.
STARTS = [
    "permission is hereby granted free of charge to any person",
    "permission to use copy modify and or distribute this software",
    "this software is provided as is without any express or implied warranty",
    "redistribution and use in source and binary forms",
    "terms and conditions for use reproduction and distribution 1 definitions",
    "the licenses for most software are designed to take away",
    "the gnu general public license is a free copyleft license",
    "this version of the gnu lesser general public license incorporates",
    "1 definitions 1 1 contributor means",
    "this is free and unencumbered software released into the public domain",
]
ENDS = [
    "use or other dealings in the software",
    "use or performance of this software",
    "removed or altered from any source distribution",
    "advised of the possibility of such damage",
    "end of terms and conditions",
    "choose that version for the library",
    "exhibit b of this license must be attached",
]
#: How appendices begin, which may follow the terms.
APPENDICES = ["for more information please refer to", "appendix how to apply", "how to apply these terms", "exhibit a source code form license notice"]

#: What may come before the terms: a title of some words around "license", then notices, which begin with "copyright" or (c) and a
#: year and have 90 words at most. No word of the terms themselves is ever taken away, so line breaks do not matter.
_HEAD = r"((\S+ ){0,10}licenses?( \S+){0,12} )?((portions )?(copyright|c (19|20)[0-9][0-9])( \S+){0,90} )?"
#: So many leading letters are looked through for the beginning of the terms.
_NEAR = 1500
#: Above this many bytes of known texts the digests are joined by a shuffle, not a broadcast.
BROADCAST_BYTES = 16 << 20
_NO_WORD = r"[^\p{L}\p{N}]+"


def canonical(text: Column) -> Column:
    """The text's words in one line; an empty string for a null."""
    out = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), F.lit(_NO_WORD), F.lit(" ")))
    for spelt, usual in SPELLINGS:
        out = F.replace(out, F.lit(spelt), F.lit(usual))
    return out


def terms(words: Column) -> Column:
    """Of the words of a licence its terms, from the first beginning to the last end that is known, if only title and notices come
    before and nothing or an appendix after; of other texts all words."""
    near = F.substring(words, 1, _NEAR)
    first = F.least(*[F.nullif(F.instr(near, x), F.lit(0)) for x in STARTS])
    upto = F.when(first.isNotNull(), F.regexp_extract(words, f"^.*({'|'.join(ENDS)})", 0))  # few texts are looked through
    head, tail = F.substring(words, F.lit(1), first - 1), F.substring(words, F.length(upto) + 1, F.length(words))
    whole = (F.length(upto) >= first) & head.rlike(rf"\A{_HEAD}\z") & ((tail == "") | tail.rlike(f"^ ({'|'.join(APPENDICES)})"))
    return F.when(whole, F.substring(upto, first, F.length(upto))).otherwise(words)


def _form(text: Column) -> Column:
    """What is hashed. The words are a lambda's variable: found once, however often the optimiser moves the expression."""
    return F.get(F.transform(F.array(canonical(text)), terms), F.lit(0))


def scan_licences(docs: DataFrame, known: DataFrame) -> DataFrame:
    """One row per input row: doc_id, digest of the whole text, license_id, n_notices and notices.

    ``known`` has (license_id, text); of equal texts the smallest identifier counts. ``license_id`` is the
    licence whose text the whole document is, or null. ``n_notices`` counts lines that are a known text, or its terms, by
    themselves and ``notices`` lists their identifiers, sorted, comma-joined, each once. Texts whose normal form
    is empty (null, blank, only punctuation) match nothing. Repeated rows are answered each; rows that
    share a doc_id but not the text are judged apart; other columns are ignored.
    """
    forms = F.explode(F.array(_form(F.col("text")), canonical(F.col("text")))).alias("form")  # a line is looked up with all its words
    table = known.where("license_id IS NOT NULL").select("license_id", forms).where("form <> ''").groupBy("form").agg(F.min("license_id").alias("license_id"))
    size = known.agg(F.sum(F.octet_length("text")).alias("bytes")).collect()[0]["bytes"] or 0
    small = F.broadcast if size <= BROADCAST_BYTES else (lambda df: df)
    digests = small(table.select(F.sha2(F.col("form").cast("binary"), 256).alias("known_digest"), "license_id"))
    texts = docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.col("text").alias("text"))
    notices = (
        texts.select("doc_id", "text_key", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("place", "line"))
        .select("doc_id", "text_key", "place", F.sha2(canonical(F.col("line")).cast("binary"), 256).alias("known_digest"))
        .join(digests, "known_digest")
        .select(F.col("doc_id").alias("notice_id"), F.col("text_key").alias("notice_key"), "place", F.col("license_id").alias("found"))
        .distinct()
        .groupBy("notice_id", "notice_key")
        .agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("found")), ",").alias("notices"))
    )
    whole = texts.select("doc_id", "text_key", F.sha2(_form(F.col("text")).cast("binary"), 256).alias("digest"))
    named = whole.join(digests, whole["digest"] == digests["known_digest"], "left")
    return named.join(notices, (F.col("text_key") == F.col("notice_key")) & F.col("doc_id").eqNullSafe(F.col("notice_id")), "left").select("doc_id", "digest", "license_id", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_notices"), F.coalesce("notices", F.lit("")).alias("notices"))


def oracle_sql() -> str:
    """DuckDB SQL of ``scan_licences(documents, KNOWN)``, with a normaliser of its own: words are extracted, not separators replaced,
    and places of beginnings and ends are looked up by lists."""

    def quoted(texts: list[str]) -> str:
        return "[" + ", ".join(f"'{x}'" for x in texts) + "]"

    def words(text: str) -> str:
        out = f"array_to_string(regexp_extract_all(lower(coalesce({text}, '')), '[\\p{{L}}\\p{{N}}]+'), ' ')"
        for spelt, usual in SPELLINGS:
            out = f"replace({out}, '{spelt}', '{usual}')"
        return out

    def formed(name: str, source: str) -> str:
        """Tables ``name``_p and ``name``, of ``source`` with a column w of words."""
        return f"""{name}_p AS (SELECT *, list_min([instr(substring(w, 1, {_NEAR}), x) FOR x IN {quoted(STARTS)} IF instr(substring(w, 1, {_NEAR}), x) > 0]) AS p,
  list_max([length(w) - instr(reverse(w), reverse(x)) + 1 FOR x IN {quoted(ENDS)} IF instr(w, x) > 0]) AS e FROM ({source})
), {name} AS (SELECT *, CASE WHEN p IS NOT NULL AND e >= p AND regexp_full_match(substring(w, 1, p - 1), '{_HEAD}')
  AND (substring(w, e + 1) = '' OR len([x FOR x IN {quoted(APPENDICES)} IF starts_with(substring(w, e + 1), ' ' || x)]) > 0) THEN substring(w, p, e - p + 1) ELSE w END AS f FROM {name}_p
)"""

    rows = ", ".join("('{}', '{}')".format(a, b.replace("'", "''")) for a, b in KNOWN)
    return f"""
WITH {formed("known_f", f"SELECT id, {words('t')} AS w FROM (VALUES {rows}) k(id, t)")}, known AS (SELECT sha256(f) AS digest, min(id) AS license_id FROM (SELECT id, unnest([f, w]) AS f FROM known_f) WHERE f <> '' GROUP BY f
), lines AS (SELECT doc_id, sha256({words('line')}) AS digest FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents)
), notices AS (SELECT doc_id, count(*) AS n, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS notices FROM lines JOIN known USING (digest) GROUP BY doc_id
), {formed("whole_f", f"SELECT doc_id, {words('text')} AS w FROM documents")}, whole AS (SELECT doc_id, sha256(f) AS digest FROM whole_f)
SELECT doc_id, digest, license_id, coalesce(n, 0)::BIGINT AS n_notices, coalesce(notices, '') AS notices
FROM whole LEFT JOIN known USING (digest) LEFT JOIN notices USING (doc_id)
"""
