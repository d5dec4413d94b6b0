"""Whole licence texts that are stored as digests only."""

import os

import duckdb
import pytest

from lumenlake.llm import license_scan

FOLDER = "/usr/share/common-licenses"
FILES = {"Apache-2.0": "Apache-2.0", "BSD": "BSD-3-Clause", "GPL-2": "GPL-2.0-only", "GPL-3": "GPL-3.0-only",
         "LGPL-2.1": "LGPL-2.1-only", "LGPL-3": "LGPL-3.0-only", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}


def found(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.license for r in license_scan.scan(docs, license_scan.known_licenses(spark)).orderBy("doc_id").collect()]


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no licence texts on this machine")
def test_long_licences(spark):
    texts = [open(f"{FOLDER}/{name}", encoding="utf-8").read() for name in FILES]
    assert found(spark, texts) == list(FILES.values())
    assert found(spark, [t + "\nOne more line." for t in texts]) == [None] * len(FILES)


def test_titles(spark):
    mit, isc = (license_scan.KNOWN[n][-1].split("\n\n", 1)[1] for n in ("MIT", "ISC"))
    holder = "Copyright (c) 2020 A. Body\n\n"
    assert found(spark, [f"The MIT License (MIT)\n\n{holder}{mit}", holder + mit, holder + isc]) == ["MIT", "MIT", "ISC"]


def test_sql_knows_the_stored_digests(spark):
    mit, isc = (license_scan.KNOWN[n][-1].split("\n\n", 1)[1] for n in ("MIT", "ISC"))
    texts = [mit, isc, f"The MIT License (MIT)\n\n{mit}", mit + " And more.", "Licensed under the MIT License.\n\n" + isc, None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [(r.doc_id, r.license, list(r.notices)) for r in license_scan.scan(docs, license_scan.known_licenses(spark)).orderBy("doc_id").collect()]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)))
    assert got == con.execute(license_scan.SQL + " ORDER BY doc_id").fetchall()
    assert got[0][1] == "MIT"
