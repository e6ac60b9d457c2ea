"""Licence scans by canonical digest (operator 4), in DataFrame functions only.

A text is brought to a canonical form: statements of copyright go, from their sign, year or holder to
their end, then a title line and marks of lists; letters become lower case, punctuation space, and
spellings that licences treat as equal become one. Its digest is hash-joined to the digests of known
licences, which are a table. Only whole texts match, in any wrapping and with any holder.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Quotes, dashes and bullets, and the ASCII punctuation that they stand for.
TYPOGRAPHIC, TO_ASCII = "‘’‚“”„«»‐‑–—―…•·", "'''\"\"\"\"\"-----.**"
#: What begins a line of a comment, or of a list.
LEADER = r"(^|\n)[ \t]*(?:/+\**|[#*;]+)[ \t]*"
BLANK, SOME = r"[ \t\r\n\f\x0B]", r"[ \t\r\n\f\x0B]+"
#: How the text begins that may follow a statement of copyright on its line.
OPENING = "|".join(p.replace(" ", SOME) for p in ("all rights reserved", "permission is hereby", "permission to use", "redistribution and use", "licensed under", "everyone is permitted", "this software", "this program", "this file", "this work", "this library", "this code"))
#: A statement of copyright has a sign, a year, a blank to fill in, or names its authors; a line of a
#: licence that only speaks of a copyright notice has none of these.
COPYRIGHT = rf"(?i)(^|[ \t\r\n\f\x0B>;])(?:portions{SOME})?(?:copyright{BLANK}*(?:\(c\)|[0-9]{{4}}|<|\[|the [^\n]{{0,60}}authors)|\(c\){BLANK}*(?:copyright{BLANK}*)?[0-9]{{4}})[^\n]*?({OPENING}|\n|\z)"
RESERVED = rf"(?i)all{SOME}rights{SOME}reserved"
#: A first line of a few words, and a blank one after it, of which the last is "license", but for an
#: abbreviation in brackets.
TITLE = r"(?i)\A[^a-z0-9]*(?:[^ \t\r\n\f]+[ \t]+){0,7}licen[cs]e(?:[ \t]+\([^()\n]{1,20}\))?[^a-z0-9\n]*\n[^a-z0-9\n]*\n([^a-z0-9]*[a-z0-9])"
#: A number or letter of a list, before a capital.
MARK = r"(^|[ \t\r\n\f\x0B])\(?(?:[0-9]{1,2}|[A-Za-z]|[ivx]{1,4})[.)][ \t\r\n\f\x0B]+([A-Z])"
SEPARATORS = r"[^a-z0-9\x{80}-\x{10FFFF}]+"

# Spellings that are equal for the purposes of matching licences, word by word.
EQUIVALENT = (
    ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("analyse", "analyze"), ("artefact", "artifact"),
    ("authorisation", "authorization"), ("authorised", "authorized"), ("calibre", "caliber"), ("cancelled", "canceled"),
    ("capitalisations", "capitalizations"), ("catalogue", "catalog"), ("categorise", "categorize"), ("centre", "center"),
    ("emphasised", "emphasized"), ("favour", "favor"), ("favourite", "favorite"), ("fulfil", "fulfill"),
    ("fulfilment", "fulfillment"), ("https", "http"), ("initialise", "initialize"), ("judgement", "judgment"),
    ("labelling", "labeling"), ("labour", "labor"), ("licence", "license"), ("licenced", "licensed"), ("licences", "licenses"),
    ("maximise", "maximize"), ("modelled", "modeled"), ("modelling", "modeling"), ("offence", "offense"), ("optimise", "optimize"),
    ("organisation", "organization"), ("organise", "organize"), ("practise", "practice"), ("programme", "program"),
    ("realise", "realize"), ("recognise", "recognize"), ("signalling", "signaling"), ("sublicence", "sublicense"), ("utilisation", "utilization"),
    ("whilst", "while"), ("wilful", "willful"),
)

# The wording of public licences and of the notices that stand for them.
_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_NO_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. '
    "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
    "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_BSD_SOURCE = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n"
_BSD_1 = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n"
_BSD_2 = "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n"
_BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
_BSD_END = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. '
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
KNOWN: tuple[tuple[str, str], ...] = (
    ("0BSD", f"{_GRANT}.\n\n{_NO_WARRANTY}"),
    ("ISC", f"{_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n\n{_NO_WARRANTY}"),
    ("BSD-2-Clause", _BSD_SOURCE + _BSD_1 + _BSD_2 + _BSD_END),
    ("BSD-3-Clause", _BSD_SOURCE + _BSD_1 + _BSD_2 + _BSD_3 + _BSD_END),
    (
        "MIT",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n'
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n"
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    ),
    (
        "Zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\n"
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n\n"
        "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n"
        "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n"
        "3. This notice may not be removed or altered from any source distribution.",
    ),
    (
        "Unlicense",
        "This is free and unencumbered software released into the public domain.\n\n"
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.\n\n"
        "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. "
        "We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.\n\n"
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.\n\n'
        "For more information, please refer to <https://unlicense.org>",
    ),
    ("MIT-notice", "Released under the MIT License."),
    ("Apache-2.0-notice", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0-notice", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0-notice", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0-notice", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
)
# Digests of the canonical forms of longer public licences, whose texts are not kept here.
DIGESTS: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "71115a66b88d9064a44d22c82f95ce1a3ad9f9a9990b08835bf16e08114ded55"),
    ("Artistic-1.0-Perl", "f6cb59bbfe06edb92675882f10ce83af46ee2432e8dd99e49eabb4394acfbcb1"),
    ("BSD-3-Clause-UC", "043b06296203e4828165cb1b709abcc7b0b6d0670a63088667c91bffa672e49b"),
    ("CC0-1.0", "8fa22816a6fcba6e119ba6f4c53808190d191bbd2286a470255948db8264389b"),
    ("GFDL-1.2", "59b31c06559542dbce7a1ede9f6b7f8785211ea556c7248088f9f8efe5edb1be"),
    ("GFDL-1.3", "db16a3101159e3d8e9641397dedb06ecffc7ea2d4c9e98d8226ea3dc4b8b83ad"),
    ("GPL-1.0", "766fa20471ae259adc3659b9bd810c233a68597359435ebca6933f55ef6a0f6a"),
    ("GPL-2.0", "4ee155f3a16d7567608d97a509f1ae108b7647d112037b3f0f264eb36177023f"),
    ("GPL-3.0", "ec3c635ff33b11d1e51ec45f203878ec5698968ef5d0941e411a8ca2e453f1c7"),
    ("LGPL-2.0", "9a8d57c88bc8ff55b04e03fbb91e847d1d331b85512ee04ef1c708a0e0f80eb8"),
    ("LGPL-2.1", "a54b5eb618851779071e4ba6e90cacd2f90fc4f9821a49404bd0db86695edd17"),
    ("LGPL-3.0", "271f977297ce5cac7a63dbde9a8f843862a6bbf21e5e05bec343f4c2a4ed9348"),
    ("MPL-1.1", "1ecd2e7c04e671751dc15387c97b4c0b4036f9957fcb5bd5353084de13f90d7e"),
    ("MPL-2.0", "b27f07d74b87541f45b88f045c92642c85e7cf390a3527e85857f5c894253965"),
)


def canonical(text: Column) -> Column:
    """The canonical form: each word between a space of its own on either side; null is empty."""
    plain = F.translate(F.coalesce(text, F.lit("")), TYPOGRAPHIC, TO_ASCII)
    plain = F.regexp_replace(F.replace(plain, F.lit("©"), F.lit("(c)")), LEADER, "$1")
    plain = F.regexp_replace(F.regexp_replace(plain, COPYRIGHT, "\n\n$2"), RESERVED, " ")
    plain = F.regexp_replace(F.regexp_replace(plain, TITLE, "$1"), MARK, " $2")
    words = F.regexp_replace(F.translate(plain, UPPER, LOWER), SEPARATORS, "  ")
    out = F.concat(F.lit(" "), F.trim(words), F.lit(" "))
    for other, one in EQUIVALENT:
        out = F.replace(out, F.lit(f" {other} "), F.lit(f" {one} "))
    return out


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def listed(spark: SparkSession, *names: str, rows: Sequence[tuple[str, str]]) -> DataFrame:
    return spark.range(1).select(F.inline(F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(names, row, strict=True))) for row in rows))))


def known_digests(spark: SparkSession, texts: Sequence[tuple[str, str]] = KNOWN, digests: Sequence[tuple[str, str]] = DIGESTS) -> DataFrame:
    """(license_id, license_digest) of texts and of digests: a table that scan() takes. Tables of any
    size can be made of a DataFrame of texts by digest()."""
    made = listed(spark, "license_id", "text", rows=texts).select("license_id", digest(F.col("text")).alias("license_digest"))
    return made.unionAll(listed(spark, "license_id", "license_digest", rows=digests)) if digests else made


def scan(df: DataFrame, known: DataFrame | None = None, most_broadcast: int = 100_000, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, canonical_digest, license_id), one row for each row in; license_id is null where the whole
    text is no known licence.

    A null text, an empty one and one of punctuation have the digest of the empty form and match no
    licence. Ids may be null or repeat; an empty table gives an empty result; other columns are not
    looked at. known: (license_id, license_digest); where a digest is listed twice, its smallest id
    stands. A longer table than most_broadcast is joined by shuffling.
    """
    known = known_digests(df.sparkSession) if known is None else known
    licences = known.groupBy("license_digest").agg(F.min("license_id").alias("license_id"))
    texts = df.select(F.col(id_column), digest(F.col(text_column)).alias("canonical_digest"))
    if known.count() <= most_broadcast:
        licences = F.broadcast(licences)
    return texts.join(licences, texts["canonical_digest"] == licences["license_digest"], "left").select(id_column, "canonical_digest", "license_id")
