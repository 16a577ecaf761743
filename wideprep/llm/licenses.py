"""Licence scan by canonical digests: a text is brought to a canonical form, hashed, and joined to the digests of known
licence notices.

The canonical form lowers case, drops copyright lines, brings equivalent spellings together, and turns punctuation and
white space into single spaces. Units are the whole text and each of its lines, every one hashed entire. Known notices are
built from licence names and the phrasings in which notices come, and from the whole texts and standard headers of
``license_texts``; others can be given in ``known`` as rows. Whole texts of AGPL-3.0 and the CC-BY family are not included.

Each text is read once and brought to canonical lines once; the text's own form is these lines joined. Only forms as long as some known form
are hashed, so that no match is lost.

Defined cases: null and empty texts, and units whose canonical form is empty, match nothing; repeated rows match
each; a text of one line that is a notice matches both as a text and as a line; a long text is one unit and its lines; an empty table
gives no row; the known table must stay below ``MAX_KNOWN`` rows, which bounds what is broadcast; other columns are not read, so
clashing names do no harm.
"""

from __future__ import annotations

import re
from functools import cache, reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import license_texts
from .common import store

MAX_KNOWN = 100_000

# Identifier, whether it permits free reuse, names in notices (each also after "the")
LICENSES = (
    ("MIT", True, ("MIT License", "MIT Licence", "MIT")),
    ("Apache-2.0", True, ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0", "Apache-2.0")),
    ("BSD-2-Clause", True, ("BSD 2-Clause License", "Simplified BSD License", "BSD-2-Clause")),
    ("BSD-3-Clause", True, ("BSD 3-Clause License", "New BSD License", "Modified BSD License", "BSD-3-Clause")),
    ("ISC", True, ("ISC License", "ISC")),
    ("Unlicense", True, ("Unlicense",)),
    ("MPL-2.0", True, ("Mozilla Public License, Version 2.0", "Mozilla Public License 2.0", "MPL 2.0", "MPL-2.0")),
    ("GPL-2.0", False, ("GNU General Public License, version 2", "GNU GPL v2", "GPL-2.0", "GPLv2")),
    ("GPL-3.0", False, ("GNU General Public License, version 3", "GNU GPL v3", "GPL-3.0", "GPLv3")),
    ("LGPL-2.1", False, ("GNU Lesser General Public License, version 2.1", "LGPL-2.1", "LGPLv2.1")),
    ("LGPL-3.0", False, ("GNU Lesser General Public License, version 3", "LGPL-3.0", "LGPLv3")),
    ("AGPL-3.0", False, ("GNU Affero General Public License, version 3", "AGPL-3.0", "AGPLv3")),
    ("CC0-1.0", True, ("CC0 1.0", "CC0-1.0", "Creative Commons Zero 1.0")),
    ("CC-BY-4.0", True, ("CC BY 4.0", "Creative Commons Attribution 4.0 International License")),
    ("CC-BY-SA-4.0", False, ("CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License")),
    ("CC-BY-NC-4.0", False, ("CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License")),
    ("CC-BY-ND-4.0", False, ("CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License")),
    ("CC-BY-NC-SA-4.0", False, ("CC BY-NC-SA 4.0",)),
    ("CC-BY-NC-ND-4.0", False, ("CC BY-NC-ND 4.0",)),
)
PHRASES = ("{}", "Licensed under {}", "Released under {}", "Distributed under {}", "Available under {}",
           "This work is licensed under {}", "This work is released under {}", "This software is licensed under {}",
           "This file is licensed under {}", "This project is licensed under {}", "License: {}",
           "SPDX-License-Identifier: {}", "This code is released under the terms of {}",
           "Licensed under the terms of {}")
# Equivalent spellings, applied in this order to lower-case text
SPELLINGS = (("licence", "license"), ("sub-license", "sublicense"), ("non-commercial", "noncommercial"),
             ("share-alike", "sharealike"), ("per cent", "percent"), ("favour", "favor"), ("organisation", "organization"),
             ("copyright holder", "copyright owner"), ("https:", "http:"))
COPYRIGHT_WORDS = ("copyright", "(c)", "©", "all rights reserved")
COPYRIGHT_LINE = r"(?m)^[^a-z0-9\n]*(copyright|\(c\)|©|all rights reserved)[^\n]*$"
PUNCTUATION = r"[^\p{L}\p{N}]+"
PUNCTUATION_IN_LINE = r"[^\p{L}\p{N}\n]+"


def canonical_lines(text: Column) -> Column:
    """The canonical form of each line. The expression for copyright lines runs only on texts that hold one of its words."""
    out = F.lower(text)
    marked = reduce(or_, (out.contains(w) for w in COPYRIGHT_WORDS))
    out = F.when(marked, F.regexp_replace(out, COPYRIGHT_LINE, " ")).otherwise(out)
    for a, b in SPELLINGS:
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.transform(F.split(F.regexp_replace(out, PUNCTUATION_IN_LINE, " "), "\n"), lambda x: F.trim(x))


def joined(lines: Column) -> Column:
    """The canonical form of the text of these canonical lines."""
    return F.array_join(F.filter(lines, lambda x: x != ""), " ")


def canonical(text: Column) -> Column:
    return joined(canonical_lines(text))


def digest(text: Column) -> Column:
    form = canonical(text)
    return F.when(form != "", F.md5(form))


def known_notices() -> list[tuple[str, bool, str]]:
    """(identifier, permissive, notice) for every name in every phrasing, and for every licence text."""
    return [(spdx, free, phrase.format(name)) for spdx, free, names in LICENSES for n in names
            for name in (n, f"the {n}") for phrase in PHRASES] + known_texts()


@cache
def known_texts() -> list[tuple[str, bool, str]]:
    """(identifier, permissive, text) of the whole texts and headers, one for each canonical form, without apostrophes."""
    free = {spdx: permissive for spdx, permissive, _ in LICENSES}
    forms = {}
    for spdx, text in license_texts.texts():
        form = re.sub(COPYRIGHT_LINE, " ", text.lower())
        for a, b in SPELLINGS:
            form = form.replace(a, b)
        forms.setdefault(re.sub(r"[\W_]+", " ", form).strip(), (spdx, text))  # the texts are ASCII
    return [(spdx, free[spdx], text.replace("'", " ")) for spdx, text in forms.values()]


def known_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(known_notices(), "license string, permissive boolean, notice string")


def scan(docs: DataFrame, known: DataFrame | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, unit ('text' or 'line'), line_no (from 1; 0 for the text), license, permissive: one row a match."""
    known = known_table(docs.sparkSession) if known is None else known
    n = known.limit(MAX_KNOWN + 1).count()
    if n > MAX_KNOWN:
        raise ValueError(f"more than {MAX_KNOWN} known notices")
    forms = store(known.select(joined(canonical_lines(F.col("notice"))).alias("form"), "license", "permissive").filter("form <> ''")
                  .groupBy("form").agg(F.min(F.struct("license", "permissive")).alias("hit")), "licence-forms")
    digests = forms.select(F.md5("form").alias("digest"), "hit")
    long_as = [r["n"] for r in forms.select(F.length("form").alias("n")).distinct().collect()]  # at most MAX_KNOWN numbers
    lines = docs.select(F.col(key).alias("doc_id"), canonical_lines(F.col(text).cast("string")).alias("lines"))
    units = F.concat(F.array(F.struct(F.lit(0).alias("line_no"), joined(F.col("lines")).alias("form"))),
                     F.transform("lines", lambda x, i: F.struct((i + 1).alias("line_no"), x.alias("form"))))
    units = lines.select("doc_id", F.inline(F.filter(units, lambda u: F.length(u.form).isin(long_as))))
    hits = units.select("doc_id", "line_no", F.md5("form").alias("digest")).join(F.broadcast(digests), "digest")
    return hits.select("doc_id", F.when(F.col("line_no") == 0, "text").otherwise("line").alias("unit"), "line_no",
                       F.col("hit.license").alias("license"), F.col("hit.permissive").alias("permissive"))
