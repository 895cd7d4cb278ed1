"""Operator 3: license scans by canonical digest lookup.

A text's canonical form has one case, one white space, no punctuation, no copyright notices and one spelling of words that
licenses spell in several ways. Its SHA-256 is hash-joined to the digests of known licenses, made by the same expression.
Known are the whole texts in ``known_licenses`` and KNOWN, in the forms they are met in: under their titles, with and without list
numbers, with and without what follows their terms. Callers add their own. The table is small: a few digests a license.
All of it is DataFrame code: no text leaves the JVM, and only digests meet.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Spellings that count as one, as the matching guidelines for license texts list them.
SPELLINGS = (
    ("acknowledgement", "acknowledgment"),
    ("analogue", "analog"),
    ("analyse", "analyze"),
    ("artefact", "artifact"),
    ("authorisation", "authorization"),
    ("authorised", "authorized"),
    ("calibre", "caliber"),
    ("cancelled", "canceled"),
    ("catalogue", "catalog"),
    ("centre", "center"),
    ("copyright owner", "copyright holder"),
    ("emphasised", "emphasized"),
    ("favour", "favor"),
    ("favourite", "favorite"),
    ("fulfil", "fulfill"),
    ("fulfilment", "fulfillment"),
    ("initialise", "initialize"),
    ("judgement", "judgment"),
    ("labelling", "labeling"),
    ("labour", "labor"),
    ("licence", "license"),
    ("licenced", "licensed"),
    ("maximise", "maximize"),
    ("modelled", "modeled"),
    ("modelling", "modeling"),
    ("noncommercial", "non commercial"),
    ("offence", "offense"),
    ("optimise", "optimize"),
    ("organisation", "organization"),
    ("organise", "organize"),
    ("per cent", "percent"),
    ("practise", "practice"),
    ("programme", "program"),
    ("realise", "realize"),
    ("recognise", "recognize"),
    ("signalling", "signaling"),
    ("sub license", "sublicense"),
    ("utilisation", "utilization"),
    ("whilst", "while"),
    ("wilful", "willful"),
)

#: A run of the characters that the canonical form keeps.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Texts of public licenses that are known from the start. Callers add their own.
KNOWN = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "MIT-notice": "Released under the MIT License.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
}


#: Titles that such texts stand under.
TITLES = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)"),
    "ISC": ("ISC License", "The ISC License", "ISC License (ISC)"),
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD", "0BSD License"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The BSD 2-Clause License", "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "The BSD 3-Clause License", "New BSD License", "BSD License"),
    "MIT-0": ("MIT No Attribution", "MIT-0 License"),
    "Zlib": ("zlib License", "The zlib License", "The zlib/libpng License"),
    "Unlicense": ("The Unlicense", "Unlicense"),
    "PostgreSQL": ("PostgreSQL License", "The PostgreSQL License"),
    "WTFPL": ("WTFPL",),
}
#: Fixed value: the line that ends the terms of licenses that advice on their use follows.
END = "END OF TERMS AND CONDITIONS"


@functools.cache
def forms() -> tuple[tuple[str, str], ...]:
    """(license_id, text) of every form of the known licenses."""
    found = dict(KNOWN) | {f.stem: f.read_text() for f in sorted((Path(__file__).parent / "known_licenses").glob("*.txt"))}
    out = []
    for name, text in found.items():
        ways = [text, re.sub(r"(?m)^ *\d+\. ", "", text)] if name.startswith("BSD") else [text]
        if END in text:
            ways += [text[: text.index(END) + len(END)], text[: text.index(END)]]
        ways += [f"{title}\n\n{x}" for title in TITLES.get(name, ()) for x in ways]
        out += [(name, x) for x in dict.fromkeys(ways)]
    return tuple(out)


#: A notice: a line that starts with a copyright mark and a year, a bracket or another mark, or that reserves all rights and
#: says no more. Lines of running text that happen to start with "copyright holders" or "copyright law" are none.
NOTICE = r"^[^\p{L}\n]*(?:copyright[ \t:,]*[(<\[{©0-9][^\n]*|©[^\n]*|\(c\)[ \t]*[<\[{0-9][^\n]*|all rights reserved[^\p{L}\n]*)$"


def canonical(text: Column) -> Column:
    """The canonical form; empty for null.

    Copyright notices go (NOTICE); A-Z are lowered; every run of characters other than letters, digits and
    those above ASCII becomes one space; equivalent spellings become one, whole words only.
    """
    t = F.lower(F.coalesce(text, F.lit("")))
    t = F.regexp_replace(t, "(?md)" + NOTICE, " ")
    t = F.concat(F.lit(" "), F.regexp_replace(t, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", "  "), F.lit(" "))
    for old, new in SPELLINGS:
        t = F.replace(t, F.lit(f" {old.replace(' ', '  ')} "), F.lit(f" {new.replace(' ', '  ')} "))
    return F.trim(F.regexp_replace(t, " +", " "))


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def first_words(words: Iterable[str]) -> list[str]:
    """The first words of texts whose canonical form starts with one of these: themselves and spellings that become them."""
    found = set(words)
    while more := {old.split()[0] for old, new in SPELLINGS if new.split()[0] in found} - found:
        found |= more
    return sorted(found)


def known(spark: SparkSession, texts: dict[str, str] | None = None) -> DataFrame:
    """license_id, digest and first canonical word of each known license; the least id where two have one canonical form."""
    rows = list(forms() if texts is None else texts.items())
    df = spark.createDataFrame(rows or [("", "")], "license_id string, text string")
    df = df.where(F.lit(bool(rows))).select("license_id", canonical(F.col("text")).alias("form"))
    df = df.select("license_id", F.sha2("form", 256).alias("digest"), F.substring_index("form", " ", 1).alias("first_word"))
    return df.groupBy("digest").agg(F.min("license_id").alias("license_id"), F.min("first_word").alias("first_word"))


def scan(docs: DataFrame, licenses: DataFrame, of_lines: bool = False) -> DataFrame:
    """doc_id, canonical digest and license_id (null where unknown) of each row's entire text.

    of_lines: also n_license_lines, the lines whose own canonical form is a known license. Null and empty texts, and
    texts of punctuation alone, have the digest of the empty form, which no license has. Rows aren't merged or
    dropped. licenses: (license_id, digest), one row a digest; with the first_word that known() gives, only lines that start
    with such a word are digested.
    """
    n = licenses.count()
    small = F.broadcast(licenses) if n <= common.BROADCAST_ROWS else licenses
    d = common.take(docs).select("doc_id", digest(F.col("text")).alias("digest"), "text")
    out = d.join(small.select("digest", "license_id"), "digest", "left").select("doc_id", F.col("digest").alias("canonical_sha256"), "license_id", "text")
    if not of_lines:
        return out.drop("text")
    # A line whose first word starts no license can't be one. Licenses that come without first words need every line's digest.
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    if "first_word" in licenses.columns and n <= common.BROADCAST_ROWS:
        starts = first_words(r.first_word for r in licenses.select("first_word").distinct().collect())
        lines = F.filter(lines, lambda x: F.regexp_extract(F.lower(x), WORD, 0).isin(*starts))
    line = F.explode(lines)
    found = common.take(docs).select("doc_id", line.alias("line")).select("doc_id", digest(F.col("line")).alias("digest"))
    per = found.join(small.select("digest"), "digest", "left_semi").groupBy("doc_id").agg(F.count(F.lit(1)).alias("k")).select(F.col("doc_id").alias("of"), "k")
    out = out.drop("text").join(per, F.col("doc_id").eqNullSafe(F.col("of")), "left")
    return out.select("doc_id", "canonical_sha256", "license_id", F.coalesce("k", F.lit(0)).cast("bigint").alias("n_license_lines"))
