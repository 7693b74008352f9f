"""Licence texts in documents by digests of their canonical form."""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache
from pathlib import Path

import regex
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Spellings that stand for the same word, as patterns for what is left of a text after
# case folding, in the order of their use.
SPELLINGS = [
    (r"\blicence", "license"),
    (r"\blicensor's\b", "licensors"),
    (r"\bsub-?licence|\bsub-license", "sublicense"),
    (r"\bnon-commercial", "noncommercial"),
    (r"\bfavour", "favor"),
    (r"\bmerchantibility\b", "merchantability"),
    (r"\bcopyright (holder|owner)s?\b", "copyright holders"),
    (r"\bhttps?://(www\.)?", ""),
    (r"\bversion (\d)", r"v\1"),
    (r"\bv\.? ?(\d)", r"v\1"),
    (r"\bv(\d+)\.0\b", r"v\1"),
]
# A statement of whose work it is begins a line with one of these. \x0e stands for the sign. As licences go on about
# "copyright notices" at starts of lines, too, the word alone needs a year, a sign, or a holder that is none of these words.
_NO_HOLDER = (
    "notices?|holders?|owners?|ownership|and|or|laws?|lines?|licen[cs]e[sd]?|licensing|interests?|statements?|treaty|treaties|disclaimers?|permissions?|on|in|of|is|are|was|to|if|for|from|with|that|this|as|"
    "also|those|like|more|then|including|resulting|patents?|trademarks?|doctrines?|claims?|rights?|protections?|infringements?|information|material|year|terms?|the (software|program|work|library|licensed|material)"
)
_LEAD = r"^[^\n\p{L}\p{N}\x0e(]*"
_SIGNED = r"((portions )?\(?copyright[ \t:,]*(\x0e|\(c\)|[\[<]|\d{4}|by\b)|\x0e|\(c\)[ \t]*(\d{4}|copyright)|all rights reserved)"
_NAMED = rf"(portions )?\(?copyright[ \t]+(?!({_NO_HOLDER})\b)[\p{{L}}\p{{N}}]"
COPYRIGHT_STATEMENT = rf"(?m){_LEAD}({_SIGNED}|{_NAMED})"
# What a statement may say besides years and holders: a licence, which is kept, or terms, which make the line more than a statement.
_LICENCE_SAID = (
    r"\b(licen[cs]ed (under|to)\b|(released|distributed|available|provided) under\b|this (work|file|software|program|code) is\b|spdx-licen[cs]e-identifier|licen[cs]e:|"
    r"permission (is|to)\b|everyone is permitted\b|redistributions? \b|use of this\b|the software is\b|see (the )?(file )?licen[cs]e)"
)
_TERMS = (
    r"\b(us(e|es|ed|age|ing)|commercial|forbidden|prohibited|permi(t|ts|tted|ssion|ssions)|allowed|may|must|shall|not|only|without|unless|except|provided|distribut\w*|redistribut\w*|modif\w*|cop(y|ies|ied|ying)|sell|sold|"
    r"fees?|pay|paid|require[sd]?|evaluation|restrict\w*|subject|agree\w*|terms|conditions|licen[cs]\w*)\b"
)

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_END = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_START = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_THREE = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
_BSD_END = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""

# Short whole texts of known licences and notices, by SPDX identifier; long ones are in license_texts/.
KNOWN_TEXTS = [
    ("MIT", _MIT),
    ("MIT", "MIT License\n\n" + _MIT),
    ("MIT", "The MIT License (MIT)\n\n" + _MIT),
    ("ISC", f"{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n\n{_ISC_END}"),
    ("ISC", f"ISC License\n\n{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n\n{_ISC_END}"),
    ("0BSD", f"{_ISC_GRANT}.\n\n{_ISC_END}"),
    ("BSD-2-Clause", _BSD_START + _BSD_END),
    ("BSD-2-Clause", "BSD 2-Clause License\n\n" + _BSD_START + _BSD_END),
    ("BSD-3-Clause", _BSD_START + _BSD_THREE + _BSD_END),
    ("BSD-3-Clause", "BSD 3-Clause License\n\n" + _BSD_START + _BSD_THREE + _BSD_END),
    ("Zlib", _ZLIB),
    ("Apache-2.0", _APACHE_NOTICE),
]
# Names under which notices of one sentence speak of a licence.
NAMES = {
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache-2.0"],
    "MIT": ["MIT License", "MIT"],
    "BSD-2-Clause": ["BSD 2-Clause License", "BSD-2-Clause", "Simplified BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "BSD-3-Clause", "New BSD License"],
    "GPL-2.0": ["GNU General Public License, version 2", "GPL-2.0", "GPLv2"],
    "GPL-3.0": ["GNU General Public License, version 3", "GNU General Public License v3.0", "GPL-3.0", "GPLv3"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3", "LGPL-3.0"],
    "AGPL-3.0": ["GNU Affero General Public License, version 3", "AGPL-3.0"],
    "MPL-2.0": ["Mozilla Public License, Version 2.0", "MPL-2.0"],
    "CC0-1.0": ["CC0 1.0", "CC0-1.0"],
    "CC-BY-4.0": ["CC BY 4.0", "CC-BY-4.0", "Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-ND-4.0": ["CC BY-ND 4.0", "CC-BY-ND-4.0"],
}
SENTENCES = ["Licensed under {}", "Licensed under the {}", "Released under {}", "Released under the {}", "Distributed under the {}", "This work is licensed under {}", "This work is licensed under the {}", "This work is licensed under a {}", "This file is licensed under the {}", "SPDX-License-Identifier: {}", "License: {}"]

_MARKS, _BLANK = r"[^\p{L}\p{M}\p{N}\n]+", r"(?m)^ +| +$"
# The spellings wherever a text is wrapped: a blank may be the end of a line and what the next one begins with.
_WRAPPED = [(re.sub(r" (\??)", lambda m: r"([ \t]+|[ \t]*\n[^\p{L}\p{N}]*)".replace("(", "(?:") + m[1], pattern), by) for pattern, by in SPELLINGS]
# A statement goes as far as what it says of a licence, and to the end of its line if it says no more than whose work it is;
# any other line stays as it is.
_ENDED = rf"{COPYRIGHT_STATEMENT}[^\n]*?(?={_LICENCE_SAID})"
_WHOLE = rf"{COPYRIGHT_STATEMENT}(?![^\n]*{_TERMS})[^\n]*"


def canonical_text(text: str) -> str:
    """The canonical form: lower case, no copyright statements, one spelling, no punctuation; letters of all scripts and lines stay."""
    out = text.replace("\x0e", " ").replace("©", "\x0e").replace("\r", "\n").replace("’", "'").lower()
    for pattern in (_ENDED, _WHOLE):
        out = regex.sub(pattern, "", out)
    out = out.replace("\x0e", "(c)")
    for pattern, by in _WRAPPED:
        out = regex.sub(pattern, by, out)
    return regex.sub(_BLANK, "", regex.sub(_MARKS, " ", out))


def _joined(text: str) -> str:
    return re.sub(r"\s+", " ", canonical_text(text)).strip()


def known_digests() -> dict[str, str]:
    """Licence by digest of the canonical form of each of KNOWN_TEXTS and each notice."""
    texts = KNOWN_TEXTS + [(spdx, s.format(name)) for spdx, names in NAMES.items() for name in names for s in SENTENCES]
    return {hashlib.md5(_joined(t).encode()).hexdigest(): spdx for spdx, t in texts}


def canonical(text: Column) -> Column:
    """``canonical_text`` as an expression."""
    out = F.lower(F.translate(text, "\x0e©\r’", " \x0e\n'"))
    for pattern in (_ENDED, _WHOLE):
        out = F.regexp_replace(out, pattern, "")
    out = F.replace(out, F.lit("\x0e"), F.lit("(c)"))
    for pattern, by in _WRAPPED:
        out = F.regexp_replace(out, pattern, by.replace(r"\1", "$1"))
    return F.regexp_replace(F.regexp_replace(out, _MARKS, " "), _BLANK, "")


@lru_cache(maxsize=1)
def full_texts() -> list[tuple[str, str]]:
    """(spdx, text) of KNOWN_TEXTS, the full licences in license_texts/ and these without what follows their terms."""
    files = sorted((Path(__file__).parent / "license_texts").glob("*.txt"))
    whole = [(f.stem.split("~")[0], f.read_text(encoding="utf-8")) for f in files]
    end = re.compile(r"END OF TERMS AND CONDITIONS")
    return KNOWN_TEXTS + whole + [(spdx, text[: m.end()]) for spdx, text in whole for m in end.finditer(text)] + [(spdx, text[: m.start()]) for spdx, text in whole for m in end.finditer(text)]


def known_texts(spark: SparkSession) -> DataFrame:
    """The texts that ``scanned`` knows by default, to be used as they are or with further rows of spdx and text."""
    return spark.createDataFrame(full_texts(), "spdx string, text string")


def scanned(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Per row doc_id, digest, license, notices.

    ``digest`` is the MD5 of the whole text's canonical form, ``license`` the SPDX identifier of the known
    licence whose whole text that is (null if none), ``notices`` the sorted distinct identifiers of known
    notices that stand as a line of the text. ``known`` (spdx, text) are the known whole texts, by default
    ``known_texts``; notices of one sentence are known always, and of identifiers that share a text the least
    counts. A known text without a word is none. A null text is an empty one and is no licence; repeated
    rows are scanned each; an empty table gives no rows. The known digests are the broadcast side of the
    join, a row per text, and nothing of the documents is shuffled. Lines are looked up among the notices
    and default texts.
    """
    notices = known_digests()
    by_text = {hashlib.md5(_joined(t).encode()).hexdigest(): spdx for spdx, t in full_texts()} | notices
    spark = docs.sparkSession
    texts = known_texts(spark) if known is None else known.select("spdx", "text")
    whole = texts.select(F.trim(F.regexp_replace(canonical(F.col("text")), r"\s+", " ")).alias("form"), F.col("spdx").alias("license")).where("form <> ''")
    sentences = [(hashlib.md5(_joined(s.format(name)).encode()).hexdigest(), spdx) for spdx, names in NAMES.items() for name in names for s in SENTENCES]
    digests = whole.select(F.md5("form").alias("digest"), "license").unionByName(spark.createDataFrame(sentences, "digest string, license string")).groupBy("digest").agg(F.min("license").alias("license"))
    by_digest = F.create_map(*[F.lit(x) for kv in by_text.items() for x in kv])
    form = canonical(F.coalesce(F.col("text"), F.lit("")))
    rows = docs.select("doc_id", form.alias("form")).select(
        "doc_id",
        F.md5(F.trim(F.regexp_replace("form", r"\s+", " "))).alias("digest"),
        # Every line has its digest looked up: by hash first, as a map is searched from end to end.
        F.transform(F.filter(F.transform(F.split("form", "\n"), F.md5), lambda digest: digest.isin(*by_text)), lambda digest: by_digest[digest]).alias("found"),
    )
    return rows.join(F.broadcast(digests), "digest", "left").select("doc_id", "digest", "license", F.array_sort(F.array_distinct(F.array_compact("found"))).alias("notices"))


def oracle_sql() -> str:
    """``scanned`` of documents in DuckDB's SQL, notices joined by commas. Copyright lines are told line by line there."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    matches = lambda x, *pattern: f"regexp_matches({x}, {quoted(''.join(pattern))})"
    text = "lower(translate(replace(replace(coalesce(text, ''), chr(14), ' '), '©', chr(14)), chr(13) || '’', chr(10) || chr(39)))"
    # There is no look-ahead: whether the word behind is a holder, and what the line says, is asked apart.
    named = r"(portions )?\(?copyright[ \t]+"
    states = f"({matches('x', _LEAD, _SIGNED)} OR ({matches('x', _LEAD, named, r'[\p{L}\p{N}]')} AND NOT {matches('x', _LEAD, named, '(', _NO_HOLDER, ')', chr(92) + 'b')}))"
    said = f"regexp_extract(x, {quoted('.*?(' + _LICENCE_SAID + '.*)$')}, 1)"
    behind = f"regexp_replace(x, {quoted(_LEAD + '(' + _SIGNED + '|' + named + ')')}, '')"
    line = f"CASE WHEN NOT {states} THEN x WHEN {said} <> '' THEN {said} WHEN NOT {matches(behind, _TERMS)} THEN '' ELSE x END"
    form = f"replace(array_to_string(list_transform(string_split({text}, chr(10)), lambda x: {line}), chr(10)), chr(14), '(c)')"
    for pattern, by in [*_WRAPPED, (_MARKS, " "), (_BLANK, "")]:
        form = f"regexp_replace({form}, {quoted(pattern)}, {quoted(by)}, 'g')"
    known = {hashlib.md5(_joined(t).encode()).hexdigest(): spdx for spdx, t in full_texts()} | known_digests()
    values = ", ".join(f"({quoted(d)}, {quoted(x)})" for d, x in known.items())
    return f"""
        WITH known(digest, license) AS (VALUES {values}),
        d AS (SELECT row_number() OVER () AS row, doc_id, {form} AS form FROM documents),
        whole AS (SELECT row, doc_id, form, md5(trim(regexp_replace(form, '\\s+', ' ', 'g'))) AS digest FROM d),
        lines AS (SELECT row, md5(unnest(string_split(form, chr(10)))) AS digest FROM d),
        notices AS (SELECT row, string_agg(DISTINCT license, ',' ORDER BY license) AS notices FROM lines JOIN known USING (digest) GROUP BY row)
        SELECT doc_id, whole.digest, license, coalesce(notices, '') AS notices
        FROM whole LEFT JOIN known USING (digest) LEFT JOIN notices USING (row)"""
