import textwrap
from pathlib import Path

from wideprep.llm import license_texts, licenses


def test_canonical_forms_meet(spark):
    texts = ["Licensed under the Apache License, Version 2.0.", "  LICENSED under the Apache Licence version 2.0",
             "Copyright (c) 2020 Somebody\nReleased under the MIT License", "a line\nSPDX-License-Identifier: GPL-3.0\nmore",
             "This is not licensed under the MIT License.", "", None, "©"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r["doc_id"], r["unit"], r["line_no"], r["license"], r["permissive"]) for r in licenses.scan(df).collect()}
    assert got == {(0, "text", 0, "Apache-2.0", True), (0, "line", 1, "Apache-2.0", True), (1, "text", 0, "Apache-2.0", True),
                   (1, "line", 1, "Apache-2.0", True), (2, "text", 0, "MIT", True), (2, "line", 2, "MIT", True),
                   (3, "line", 2, "GPL-3.0", False)}


def test_own_table_and_cases(messy, empty, spark):
    known = spark.createDataFrame([("X-1", False, "the quick brown fox jumps over the lazy dog, near the river bank today")],
                                  "license string, permissive boolean, notice string")
    assert sorted((r["doc_id"], r["unit"]) for r in licenses.scan(messy, known).collect()) == [
        (1, "line"), (1, "line"), (1, "text"), (1, "text"), (7, "line"), (7, "text")]
    assert licenses.scan(empty).count() == 0 and licenses.scan(messy, known.limit(0)).count() == 0


def test_whole_texts_and_headers(spark):
    short = {spdx: (titles, body) for spdx, titles, body in license_texts._short() if titles}
    mit = "\n\n".join(textwrap.fill(p, 72) for p in short["MIT"][1].split("\n"))
    bsd = "\n\n".join(short["BSD-3-Clause"][1].split("\n"))
    folder = Path(license_texts.__file__).parent
    apache, gpl = (folder.joinpath(f"{n}.txt").read_text() for n in ("Apache-2.0", "GPL-3.0"))
    header = license_texts._APACHE_HEADER.replace("License", "Licence").replace("http:", "https:")
    texts = [f"The MIT Licence\n\nCopyright (c) 1999-2024 Somebody Else\n\n{mit.replace('sublicense', 'sub-licence')}\n",
             mit, f"Copyright 2011 X\nAll rights reserved.\n\n{bsd}", apache.replace("[yyyy] [name of copyright owner]", "2020 Y"),
             f"/*\n * Copyright 2020 Y\n *\n * {header.replace(chr(10), chr(10) + ' * ')}\n */", gpl,
             mit.replace("free of charge", "for a charge"), *("\n".join([t, short["ISC"][1]]) for t in short["ISC"][0])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["license"] for r in licenses.scan(df).filter("unit = 'text'").collect()}
    assert got == {0: "MIT", 1: "MIT", 2: "BSD-3-Clause", 3: "Apache-2.0", 4: "Apache-2.0", 5: "GPL-3.0", 7: "ISC", 8: "ISC", 9: "ISC"}


def test_known_texts_have_each_form_once(spark):
    known = spark.createDataFrame(licenses.known_texts(), "license string, permissive boolean, notice string")
    assert known.select(licenses.digest(known.notice)).na.drop().distinct().count() == known.count() < licenses.MAX_KNOWN
