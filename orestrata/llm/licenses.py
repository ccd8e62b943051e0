"""Licence scans by canonical digest.

DataFrame functions only. A text is brought to a canonical form (lower case, no
copyright lines, no punctuation, one spelling of equivalent words, single
spaces) and hashed; the digest of the whole text is hash-joined to the digests
of known licence texts. Each line's digest is looked up among the known notices
in the same way, as licensed pages mostly carry a line and not a full text.
Of a long licence the digest alone is kept; a caller can give texts of their own.

Defined cases: a null text, or one without letters and digits, has a null digest
and matches nothing; texts are read whole; two known texts of one digest would
be listed by the lesser id; repeated rows are scanned alike; an empty table gives
no rows; other columns are kept by ``scan`` (its own start with ``_l_``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orestrata.llm.common import table

# Spellings that licence matching treats as equal, applied in this order.
SPELLINGS = [
    ("licence", "license"),
    ("acknowledgement", "acknowledgment"),
    ("organisation", "organization"),
    ("authorised", "authorized"),
    ("favour", "favor"),
    ("sub license", "sublicense"),
    ("non commercial", "noncommercial"),
    ("copyright holder", "copyright owner"),
    ("https", "http"),
]

# One-line notices and what they stand for.
NOTICES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("MIT", "Released under the MIT License."),
    ("BSD-3-Clause", "Released under the BSD License."),
    ("Proprietary", "All rights reserved."),
]

# Full texts of short licences, without their copyright lines.
TEXTS = [
    (
        "MIT",
        "MIT License\n\n"
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\n'
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n"
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    ),
    (
        "ISC",
        "ISC License\n\n"
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\n"
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    ),
    (
        "0BSD",
        "BSD Zero Clause License\n\n"
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\n"
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    ),
    (
        "BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n"
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n"
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n\n"
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    ),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n"
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n"
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n\n"
        "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\n"
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    ),
    (
        "Zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\n"
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n\n"
        "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n\n"
        "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n\n"
        "3. This notice may not be removed or altered from any source distribution.",
    ),
    (
        "Unlicense",
        "This is free and unencumbered software released into the public domain.\n\n"
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.\n\n"
        "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.\n\n"
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.\n\n'
        "For more information, please refer to <https://unlicense.org>",
    ),
    (
        "WTFPL",
        "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE\n"
        "TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION\n\n"
        "0. You just DO WHAT THE FUCK YOU WANT TO.",
    ),
]


# Digests of the canonical form of long licences, as Debian's common-licenses hold them.
DIGESTS = [
    ("Apache-2.0", "77e1a2c8e9671a8095fa8108104daeae"),
    ("Artistic-1.0-Perl", "c1b81bf4478b19597097b63e59382266"),
    ("BSD-3-Clause", "ddcd765ed0a3236bf96e15f76c36983a"),
    ("CC0-1.0", "93a180096f6cfcf2c0dd24f75c2eec48"),
    ("GFDL-1.2", "8d0843544e24727fdc5e9df92d1f8263"),
    ("GFDL-1.3", "93019451609b1c5343aaffc95cde060b"),
    ("GPL-1.0", "b37a688f44419d3168b23775b65749eb"),
    ("GPL-2.0", "422f821c6c0b1812cbde7c1c3be04922"),
    ("GPL-3.0", "dd25740036eafeeb440b379ece56a8ae"),
    ("LGPL-2.0", "ebf358251bfe9161668a8c8251261977"),
    ("LGPL-2.1", "1ff066c677365f47fea81c911a7c822e"),
    ("LGPL-3.0", "b31b7335bc37919e8cdd79154e04d88d"),
    ("MPL-1.1", "9fa8ae3e869a929215034d82982372b5"),
    ("MPL-2.0", "b5b7a0cf4994910cd0204fba4637d6ec"),
]

#: No text that is known by its digest alone is shorter than this.
LEAST_DIGESTED = 1000
#: Lines that say who holds the copyright: a sign, a year, a placeholder or a name must follow the word.
_SIGNED = r"[ \t]*(?:(?:copyright[ \t:,]*(?:\(c\)|©|[0-9]{4}|<|\[|by\b)|(?:\(c\)|©)[ \t]*(?:[0-9]{4}|copyright\b|<|\[)|all rights reserved))"
_NAMED = r"[ \t]*Copyright (?:The )?[A-Z][a-z]"
#: Words that follow the word in running text, as in "Copyright License".
_RUNNING = r"[ \t]*Copyright (?:The )?(?:Act|Agent|Holder|Law|License|Notice|Office|Owner)"


def _plain(text: Column) -> Column:
    """Letters and digits in lower case, one space between words, one spelling."""
    x = F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))
    for a, b in SPELLINGS:
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def canonical(text: Column) -> Column:
    """The whole text's canonical form. Copyright lines go."""
    return _plain(F.regexp_replace(text, rf"(?m)^(?:(?i:{_SIGNED})|(?!{_RUNNING}){_NAMED})[^\n]*$", ""))


def first_letters(form: Column) -> Column:
    """The first three characters of a form's first word. No spelling changes them, so a line that begins otherwise isn't of this form."""
    return F.substring(F.substring_index(form, " ", 1), 1, 3)


def digest(form: Column) -> Column:
    return F.when(form != "", F.md5(form))


def known_forms(spark: SparkSession, texts: list[tuple[str, str]] | None = None) -> DataFrame:
    """``license, form``: the known full texts and notices, with and without their copyright lines."""
    rows = spark.createDataFrame((TEXTS + NOTICES) if texts is None else texts, "license string, body string")
    return rows.select("license", F.explode(F.array(canonical(F.col("body")), _plain(F.col("body")))).alias("form")).where("form <> ''")


def known_texts(spark: SparkSession, texts: list[tuple[str, str]] | None = None) -> DataFrame:
    """``_l_digest, license``: as many rows as the list, whatever the corpus."""
    known = known_forms(spark, texts).select(digest(F.col("form")).alias("_l_digest"), "license")
    if texts is None:
        known = known.unionByName(spark.createDataFrame(DIGESTS, "license string, _l_digest string"))
    return known.groupBy("_l_digest").agg(F.min("license").alias("license"))


def scan(docs: DataFrame, text: str = "text", texts: list[tuple[str, str]] | None = None) -> DataFrame:
    """``docs`` with ``_l_text_digest``, ``_l_license`` (of the entire text) and ``_l_notices`` (of lines, sorted, distinct)."""
    spark = docs.sparkSession
    known = known_texts(spark, texts)
    rows = {r["_l_digest"]: r["license"] for r in known.collect()}  # as many as the fixed list has
    notice_ids = F.create_map(*[F.lit(v) for k, name in sorted(rows.items()) for v in (k, name)]) if rows else F.create_map().cast("map<string,string>")
    lines = F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)
    # Short lines are brought to their form only if they begin like one of the texts; the others can't have its digest.
    # How the texts begin that are known by digest alone isn't known, so long lines all are.
    begins = sorted(r["b"] for r in known_forms(spark, texts).select(first_letters(F.col("form")).alias("b")).distinct().collect())
    like = r"^[^\p{L}\p{N}]*(?:" + "|".join(begins) + ")" if begins else "$^"
    lines = F.filter(lines, lambda s: (F.lit(texts is None) & (F.length(s) >= LEAST_DIGESTED)) | F.lower(s).rlike(like))
    found = F.transform(lines, lambda s: F.element_at(notice_ids, F.coalesce(digest(_plain(s)), F.lit(""))))
    out = docs.withColumn("_l_text_digest", digest(canonical(F.col(text))))
    out = out.withColumn("_l_notices", F.array_sort(F.array_distinct(F.filter(found, lambda x: x.isNotNull()))))
    small = F.broadcast(known.select(F.col("_l_digest").alias("_l_text_digest"), F.col("license").alias("_l_license")))
    return out.join(small, "_l_text_digest", "left")


def op10_license_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence of the entire text and notices in the lines of every document."""
    d = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select(
        "doc_id",
        F.col("_l_text_digest").alias("text_digest"),
        F.col("_l_license").alias("license"),
        F.array_join("_l_notices", ",").alias("notices"),
    )


def _sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _sql_plain(x: str) -> str:
    x = rf"trim(regexp_replace(lower({x}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"
    for a, b in SPELLINGS:
        x = f"replace({x}, '{a}', '{b}')"
    return x


def _sql_canonical(x: str) -> str:
    # RE2 has no look-ahead: a line is dropped if it names a holder and isn't running text.
    return _sql_plain(
        f"""array_to_string(list_filter(string_split({x}, chr(10)), lambda s: not (
  regexp_matches(s, '^(?i:{_SIGNED})') or regexp_matches(s, '^{_NAMED}') and not regexp_matches(s, '^{_RUNNING}'))), chr(10))"""
    )


OP10_SQL = f"""
with body as (select * from (values {", ".join(f"({_sql_text(n)}, {_sql_text(t)})" for n, t in TEXTS + NOTICES)}) t(license, body)),
known as (select md5(form) as digest, min(license) as license from (
  select license, {_sql_canonical("body")} as form from body union all select license, {_sql_plain("body")} from body) where form <> '' group by 1),
all_known as (select digest, min(license) as license from (select * from known union all
  select * from (values {", ".join(f"('{d}', '{n}')" for n, d in DIGESTS)}) t(digest, license)) group by 1),
d as (select row_number() over () as rid, doc_id, text, {_sql_canonical("text")} as form from documents),
ln as (select rid, unnest(string_split(text, chr(10))) as line from d),
hit as (select distinct rid, known.license from ln join all_known known on md5({_sql_plain("line")}) = known.digest),
n as (select rid, string_agg(license, ',' order by license) as notices from hit group by rid)
select doc_id, case when form <> '' then md5(form) end as text_digest, known.license, coalesce(n.notices, '') as notices
from d left join n using (rid) left join all_known known on form <> '' and md5(form) = known.digest
"""
