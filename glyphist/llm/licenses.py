"""Licence scans by digests of normalised texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Wording of public licences and notices.
LICENSE_TEXTS = [
    ("MIT", "notice", "Released under the MIT License."),
    ("MIT", "notice", "Licensed under the MIT License."),
    ("Apache-2.0", "notice", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "notice", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "notice", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-NC-4.0", "notice", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "notice", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "notice", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "notice", "Licensed under CC0 1.0."),
    (
        "ISC",
        "text",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n"
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE '
        "INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR "
        "ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, "
        "DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN "
        "CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "MIT",
        "text",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without '
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
        "Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
        "conditions:\nThe above copyright notice and this permission notice shall be included in all copies or "
        'substantial portions of the Software.\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS '
        "OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE "
        "AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR "
        "OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION "
        "WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
]

_BSD_START = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met:\n"
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the "
    "following disclaimer.\n"
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
    "following disclaimer in the documentation and/or other materials provided with the distribution.\n"
)
_BSD_NAMES = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
    "products derived from this software without specific prior written permission.\n"
)
_BSD_END = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED '
    "WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A "
    "PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY "
    "DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
    "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER "
    "CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR "
    "OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
LICENSE_TEXTS += [
    ("BSD-2-Clause", "text", _BSD_START + _BSD_END),
    ("BSD-3-Clause", "text", _BSD_START + _BSD_NAMES + _BSD_END),
]
# Headings that often stand above a text.
HEADINGS = {
    "MIT": ["MIT License", "The MIT License", "The MIT License (MIT)"],
    "ISC": ["ISC License"],
    "BSD-2-Clause": ["BSD 2-Clause License", "All rights reserved.", "BSD 2-Clause License\nAll rights reserved."],
    "BSD-3-Clause": ["BSD 3-Clause License", "All rights reserved.", "BSD 3-Clause License\nAll rights reserved."],
}
LICENSE_TEXTS += [
    (name, kind, f"{heading}\n{text}") for name, kind, text in LICENSE_TEXTS if kind == "text" for heading in HEADINGS[name]
]

# Digests of the canonical whole texts, as Debian ships them in /usr/share/common-licenses.
LICENSE_DIGESTS = [
    ("Apache-2.0", "text", "ef36af97727268b60fb709836c24580bed9887f649dba6f0fd9ef4b18232fd25"),
    ("Artistic-1.0", "text", "e963bc30f4d3c45f45030c34409ee37315564625649c1394e32bb5ddd99e01b2"),
    ("BSD-3-Clause", "text", "3d151449461c0c776e892a4dc41cac0d251eb00c9fc49d2d48802d9bed818fe9"),
    ("CC0-1.0", "text", "cccf7894e1b9f4ba9f97728bf0c5baf9e07bc2ac93da7a51556451b1fb2b868e"),
    ("GFDL-1.2", "text", "5379e6f33e826ba185b23fd11a414555c2161fda481478babd1e73a3ae098a71"),
    ("GFDL-1.3", "text", "93d6108daecdddc5f284cf8f2512fb0d72f6e9ee12381feb9704ba194b00c3e6"),
    ("GPL-1.0", "text", "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224"),
    ("GPL-2.0", "text", "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821"),
    ("GPL-3.0", "text", "a8cd54d6683aa630f0b8d05d56184ad91dc486756da2df61c94d3e4e8d5ecb68"),
    ("LGPL-2.0", "text", "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908"),
    ("LGPL-2.1", "text", "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891"),
    ("LGPL-3.0", "text", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "text", "3f0343dd4f3b064be36e0c6584737c9b7bb5c322721694563f9009e088ce96d1"),
    ("MPL-2.0", "text", "f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a"),
]

# Spellings that licence texts use for one word, as (pattern, replacement) in order.
EQUIVALENT_SPELLINGS = [
    ("licence", "license"),
    ("licenced", "licensed"),
    ("sub license", "sublicense"),
    ("sub licensable", "sublicensable"),
    ("acknowledgement", "acknowledgment"),
    ("copyright owner", "copyright holder"),
    ("copyright owners", "copyright holders"),
    ("non commercial", "noncommercial"),
    ("non infringement", "noninfringement"),
    ("merchantibility", "merchantability"),
    ("per cent", "percent"),
    ("whilst", "while"),
    ("ver", "version"),
]

# ASCII letters and digits and all other scripts make words.
# (?d): only \n ends a line, as in other engines.
_COPYRIGHT_LINE = r"(?md)^[^a-z0-9\n]*(copyright|\(c\)|©)[^\n]*([0-9]{4}|\(c\)|©|all rights reserved)[^\n]*$"
_PUNCTUATION = r"[\x00-/:-@\[-`{-\x7f]+"


def bare_line(line: Column) -> Column:
    """Lower case and single spaces for punctuation; empty if it is a copyright line."""
    result = F.lower(line)
    # Most lines name no copyright at all, which is found faster than the pattern is.
    named = F.contains(result, F.lit("copyright")) | F.contains(result, F.lit("(c)")) | F.contains(result, F.lit("©"))
    result = F.when(named, F.regexp_replace(result, _COPYRIGHT_LINE, "")).otherwise(result)
    return F.trim(F.regexp_replace(result, _PUNCTUATION, " "))


def bare_lines(text: Column) -> Column:
    return F.transform(F.split(text, "\n"), bare_line)


def joined(lines: Column) -> Column:
    return F.array_join(F.filter(lines, lambda line: line != ""), " ")


def spelled(bare: Column) -> Column:
    """One spelling for equivalent ones."""
    result = F.concat(F.lit(" "), bare, F.lit(" "))
    for spelling, used in EQUIVALENT_SPELLINGS:
        result = F.replace(result, F.lit(f" {spelling} "), F.lit(f" {used} "))
    return F.trim(result)


def canonical(text: Column) -> Column:
    """Lower case, no copyright lines, no punctuation, single spaces, one spelling."""
    return spelled(joined(bare_lines(text)))


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def known_licenses(
    spark: SparkSession,
    texts: list[tuple[str, str, str]] = LICENSE_TEXTS,
    digests: list[tuple[str, str, str]] = LICENSE_DIGESTS,
) -> DataFrame:
    """``(license, kind, digest)``, distinct, of licence texts and of canonical digests."""
    table = spark.createDataFrame(texts, "license string, kind string, text string")
    found = table.select("license", "kind", digest(F.col("text")).alias("digest"))
    return found.union(spark.createDataFrame(digests, "license string, kind string, digest string")).distinct()


def license_matches(
    docs: DataFrame, licenses: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(doc_id, unit, license, kind, n_units)``: texts of documents that are a known licence.

    A unit is the ``document`` as a whole, or a ``line`` of it; a unit matches if its whole
    canonical text is that of a licence. Rows are distinct, with the number of equal units.
    Documents without a match have no row; null and empty texts match nothing, and
    neither do licences that are empty after normalising. ``licenses`` has columns
    (license, kind, digest); it is a catalogue and joined as Spark chooses by its size.
    A document with a repeated id has its rows added up.
    """
    catalogue = licenses.filter(F.col("digest") != F.sha2(F.lit(""), 256)).select("license", "kind", "digest")
    text = F.col(text_col)
    # Lines are made bare once, and the document is made of them.
    bare = docs.filter(text.isNotNull()).select(F.col(id_col).alias("doc_id"), bare_lines(text).alias("lines"))
    units = bare.select(
        "doc_id",
        F.explode(
            F.concat(
                F.array(F.struct(F.lit("document").alias("unit"), joined(F.col("lines")).alias("bare"))),
                F.transform("lines", lambda line: F.struct(F.lit("line").alias("unit"), line.alias("bare"))),
            )
        ).alias("u"),
    )
    return (
        units.filter("u.bare <> ''")
        .select("doc_id", "u.unit", F.sha2(spelled(F.col("u.bare")), 256).alias("digest"))
        .join(catalogue, "digest")
        .groupBy("doc_id", "unit", "license", "kind")
        .agg(F.count("*").alias("n_units"))
    )
