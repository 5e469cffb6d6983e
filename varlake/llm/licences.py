"""Licence scans by canonical digests.

A text is reduced to a canonical form (case, copyright notices, equivalent spellings, punctuation and white space do not matter)
and hashed. Whole texts, and each line as a text of its own, are hash-joined with the digests of known licences and notices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Licences whose whole text is short, as published.
MIT_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to
use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom
the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES
OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE
LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR
IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC_GRANT = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies.
"""
ISC_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT,
NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution.
"""
BSD_ENDORSE = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived
from this software without specific prior written permission.
"""
BSD_WARRANTY = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT
NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL
THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES
(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS
INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE
OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS"
BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
governing permissions and limitations under the License."""

#: Names of licences in notices, with their identifiers.
NAMES = {
    "Apache License, Version 2.0": "Apache-2.0",
    "Apache License 2.0": "Apache-2.0",
    "MIT License": "MIT",
    "BSD 2-Clause License": "BSD-2-Clause",
    "BSD 3-Clause License": "BSD-3-Clause",
    "ISC License": "ISC",
    "Mozilla Public License, version 2.0": "MPL-2.0",
    "GNU General Public License, version 2": "GPL-2.0",
    "GNU General Public License, version 3": "GPL-3.0",
    "GNU Lesser General Public License, version 3": "LGPL-3.0",
    "GNU Affero General Public License, version 3": "AGPL-3.0",
    "CC BY 4.0": "CC-BY-4.0",
    "CC BY-SA 4.0": "CC-BY-SA-4.0",
    "CC BY-NC 4.0": "CC-BY-NC-4.0",
    "CC BY-ND 4.0": "CC-BY-ND-4.0",
    "CC BY-NC-SA 4.0": "CC-BY-NC-SA-4.0",
    "CC0 1.0": "CC0-1.0",
}
NOTICES = ("Licensed under", "Released under", "This work is licensed under", "This file is licensed under", "Distributed under")

#: Spellings that count as the second one.
SPELLINGS = {
    "licence": "license",
    "sub-license": "sublicense",
    "sub license": "sublicense",
    "non-infringement": "noninfringement",
    "merchantibility": "merchantability",
    "favour": "favor",
    "fulfil ": "fulfill ",
    "honour": "honor",
    "labour": "labor",
    "modelled": "modeled",
    "organisation": "organization",
    "recognise": "recognize",
    "utilisation": "utilization",
    "whilst": "while",
    "wilful": "willful",
    "https://": "http://",
    "©": "(c)",
}

# What follows "copyright" or a list item's "(c)" at the start of a line of a sentence that was wrapped there.
SENTENCE = (
    "and|are|as|can|claims?|disclaimers?|doctrines?|for|holders?|if|in|including|infringements?|interests?|is|laws?|licensee?s?|"
    "licensors?|may|must|not|notices?|of|on|or|owners?|ownership|permissions?|protections?|resulting|rights?|shall|statements?|"
    "status|subject|terms?|that|the software|to|treat(?:y|ies)|under|was|which|will|with|within"
)
ITEM = "an?|any|each|for|if|in|that|to|under|when|where|which|with|you"
LEADERS = r"[ \t*#/;!>-]"
#: A copyright notice: a mark or a year follows, or a holder; or the word is a heading of its own.
COPYRIGHT_NOTICE = (
    rf"(?:^|\n){LEADERS}*+(?:"
    rf"copyright(?:s|ed)?[ \t:,]*(?:\r?\n{LEADERS}*)?(?:[(]c[)]|[(<{{\[]?[0-9]{{4}})"
    rf"|copyrights?+[ \t:]++(?=[^\s,.;()'\"/-])(?!(?!(?:holder|owner|notice)s?[ \t]*:)(?:{SENTENCE})\b)"
    rf"|(?:\n{LEADERS}*+|(?<=\A{LEADERS}{{0,20}}))copyrights?+[ \t:]*+(?=\n{LEADERS}*+(?:\n|\z)|\z)"
    rf"|[(]c[)][ \t]*+(?=\S)(?!(?:{ITEM})\b)"
    r"|all rights reserved)[^\n]*"
)
PUNCTUATION = r"[\x00-\x09\x0b-\x2f\x3a-\x60\x7b-\x7f“”‘’–—]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Digests of entire texts that are too long to be kept here, as published.
ENTIRE = {
    "75acde0fb516a7ba4597dfc23680cf78281f7fae7f3b74a78e06ef83c1c375c6": "Apache-2.0",
    "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821": "GPL-2.0",
    "aa997bc1c3422ccdc7ccabdc6f9aaa9ce2ebeed7be208887d2b13ff901326c75": "GPL-2.0",
    "eaab5d82fdcca441d83a1913bbf07e4de3a739e190578c0bffde24f84e93bb2a": "GPL-3.0",
    "0d3bfcceda6470dcd13089cae938e4e0251be32d7ab34ca76aea6195a56230bf": "GPL-3.0",
    "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be": "LGPL-3.0",
    "f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a": "MPL-2.0",
    "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f": "CC0-1.0",
    "6fd32d7fe30fa66c101714769c97e3e375bdf90cc19532508e2dfb4d98a92a9d": "CC-BY-SA-4.0",
}
#: Lines above a text of ``known_texts``, by licence.
HEADINGS = {
    "MIT": ("The MIT License", "The MIT License (MIT)", "MIT License (MIT)"),
    "ISC": ("The ISC License", "The ISC License (ISC)", "ISC License (ISC)"),
    "BSD-2-Clause": ("BSD 2-Clause License", 'BSD 2-Clause "Simplified" License', "Simplified BSD License", "2-Clause BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", 'BSD 3-Clause "New" or "Revised" License', "New BSD License", "3-Clause BSD License"),
}


def known_texts() -> dict[str, str]:
    """Text to licence identifier; the notices follow from names and openings."""
    texts = {
        MIT_GRANT: "MIT",
        "MIT License\n\n" + MIT_GRANT: "MIT",
        ISC_GRANT + ISC_WARRANTY: "ISC",
        "ISC License\n\n" + ISC_GRANT + ISC_WARRANTY: "ISC",
        BSD_HEAD + BSD_WARRANTY: "BSD-2-Clause",
        BSD_HEAD + BSD_ENDORSE + BSD_WARRANTY: "BSD-3-Clause",
        APACHE_NOTICE: "Apache-2.0",
    }
    for name, identifier in NAMES.items():
        for notice in NOTICES:
            texts[f"{notice} {name}"] = texts[f"{notice} the {name}"] = identifier
    return texts


def headed_texts() -> dict[str, str]:
    """The entire texts of ``known_texts`` under each of ``HEADINGS``."""
    texts = {
        "MIT": MIT_GRANT,
        "ISC": ISC_GRANT + ISC_WARRANTY,
        "BSD-2-Clause": BSD_HEAD + BSD_WARRANTY,
        "BSD-3-Clause": BSD_HEAD + BSD_ENDORSE + BSD_WARRANTY,
    }
    found = {}
    for licence, headings in HEADINGS.items():
        for heading in headings:
            names = [heading] if heading.startswith("The ") else [heading, f"The {heading}"]
            found |= {f"{name}\n\n{texts[licence]}": licence for name in names}
    return found


def canonical_lines(text: Column) -> Column:
    """The canonical form with its line breaks. Only A-Z are lowered; letters beyond ASCII stay."""
    form = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    for variant, usual in SPELLINGS.items():
        form = F.replace(form, F.lit(variant), F.lit(usual))
    form = F.regexp_replace(form, COPYRIGHT_NOTICE, "\n")
    return F.regexp_replace(form, PUNCTUATION, " ")


def joined_lines(form: Column) -> Column:
    return F.trim(F.regexp_replace(form, r"[ \n]+", " "))


def known_digests(spark: SparkSession) -> DataFrame:
    """(digest, licence): one row per known canonical form."""
    texts = known_texts() | headed_texts()
    rows = spark.createDataFrame(list(texts.items()), "text string, licence string")
    digests = rows.select(F.sha2(joined_lines(canonical_lines(F.col("text"))), 256).alias("digest"), "licence")
    entire = spark.createDataFrame(list(ENTIRE.items()), "digest string, licence string")
    return digests.union(entire).groupBy("digest").agg(F.min("licence").alias("licence"))


def scanned(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, licence, notices) per row of ``docs`` (doc_id, text).

    ``digest`` is the SHA-256 of the whole canonical text, ``licence`` the known text that it equals, or null; ``notices`` are
    the identifiers of known texts that lines of the document equal, distinct, ascending, joined by commas ("" if none).
    Null texts are empty, and no known text is. The known digests are a table of fixed size, the documents are not shuffled.
    """
    known = F.broadcast(known_digests(docs.sparkSession))
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), canonical_lines(F.col("text")).alias("form"))
    whole = rows.select("doc_id", "text_hash", F.sha2(joined_lines(F.col("form")), 256).alias("digest")).join(known, "digest", "left")
    lines = rows.select("doc_id", "text_hash", F.explode(F.split("form", "\n")).alias("line"))
    found = lines.withColumn("digest", F.sha2(joined_lines(F.col("line")), 256)).join(known, "digest")
    notices = found.groupBy(F.col("doc_id").alias("__doc_id"), F.col("text_hash").alias("__hash")).agg(
        F.array_join(F.array_sort(F.collect_set("licence")), ",").alias("notices")
    )
    same = F.col("doc_id").eqNullSafe(F.col("__doc_id")) & (F.col("text_hash") == F.col("__hash"))
    return whole.join(notices, same, "left").select("doc_id", "digest", "licence", F.coalesce("notices", F.lit("")).alias("notices"))


def _dropped_line(bodies: str, at: str) -> str:
    """SQL: whether line ``at`` of a list of lines without their leaders is a copyright notice.

    Told line by line, with conditions of their own for what ``COPYRIGHT_NOTICE`` says in one expression.
    """
    line, before, after = (f"coalesce({bodies}[{place}], '')" for place in (at, f"{at} - 1", f"{at} + 1"))
    mark = "([(]c[)]|[(<{\\[]?[0-9]{4})"
    word = "^copyright(s|ed)?[ \\t:,]*"
    rest = f"regexp_replace({line}, '^copyrights?[ \\t:]+', '')"
    holder = f"""(regexp_matches({line}, '^copyrights?[ \\t:]+[^ \\t\\n\\r\\f\\v,.;()''"/-]')
        and (regexp_matches({rest}, '^(holder|owner|notice)s?[ \\t]*:') or not regexp_matches({rest}, '^({SENTENCE.replace("(?:", "(")})\\b')))"""
    alone = f"""(regexp_matches({line}, '^copyrights?[ \\t:]*$') and ({at} = 1 or {before} = '') and ({at} = len({bodies}) or {after} = ''))"""
    listed = f"(regexp_matches({line}, '^[(]c[)][ \\t]*[^ \\t\\n\\r\\f\\v]') and not regexp_matches({line}, '^[(]c[)][ \\t]*({ITEM})\\b'))"
    return f"""(regexp_matches({line}, '{word}{mark}')
        or (regexp_matches({line}, '{word}\\r?$') and regexp_matches({after}, '^{mark}'))
        or ({at} > 1 and regexp_matches({before}, '{word}\\r?$') and regexp_matches({line}, '^{mark}'))
        or {holder} or {alone} or {listed} or starts_with({line}, 'all rights reserved'))""".replace("\\\\", "\\")


def scan_sql(documents: str = "documents") -> str:
    """``scanned`` as DuckDB SQL: notices are dropped line by line, known texts are canonised by the same SQL."""

    def quoted(text: str) -> str:
        return "'" + text.replace("'", "''") + "'"

    def lowered(text: str) -> str:
        out = f"translate(coalesce({text}, ''), '{UPPER}', '{LOWER}')"
        for variant, usual in SPELLINGS.items():
            out = f"replace({out}, {quoted(variant)}, {quoted(usual)})"
        return out

    def forms(source: str, columns: str) -> str:
        plain = f"lambda line, i: case when {_dropped_line('bodies', 'i')} then '' else regexp_replace(line, {quoted(PUNCTUATION)}, ' ', 'g') end"
        return f"""
            select {columns}, list_transform(lines, {plain}) as lines from (
                select {columns}, lines, list_transform(lines, lambda line: regexp_replace(line, '^[ \\t*#/;!>-]*', '')) as bodies from (
                    select {columns}, string_split({lowered("text")}, chr(10)) as lines from {source}))
        """.replace("\\\\", "\\")

    def joined(text: str) -> str:
        return f"trim(regexp_replace({text}, '[ \n]+', ' ', 'g'))"

    texts = known_texts() | headed_texts()
    values = ", ".join(f"({quoted(text)}, {quoted(licence)})" for text, licence in texts.items())
    entire = ", ".join(f"({quoted(digest)}, {quoted(licence)})" for digest, licence in ENTIRE.items())
    whole = joined("array_to_string(lines, chr(10))")
    return f"""
        with texts(text, licence) as (values {values}),
        entire(digest, licence) as (values {entire}),
        canonical as ({forms("texts", "licence")}),
        known as (
            select digest, min(licence) as licence from (
                select sha256({whole}) as digest, licence from canonical union all select digest, licence from entire) group by digest
        ),
        documents_ as (select row_number() over () as id, doc_id, text from {documents}),
        forms as ({forms("documents_", "id, doc_id")}),
        lines as (select id, unnest(lines) as line from forms),
        found as (
            select id, string_agg(distinct licence, ',' order by licence) as notices
            from lines join known on known.digest = sha256({joined("line")}) group by id
        ),
        digests as (select id, doc_id, sha256({whole}) as digest from forms)
        select doc_id, digest, licence, coalesce(notices, '') as notices
        from digests left join known using (digest) left join found using (id)
    """
