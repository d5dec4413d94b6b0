"""Holder lines and wrapped licence texts."""

import textwrap

import pytest

from lumenlake.llm import license_scan

COLUMNS = "doc_id long, text string"


def wrapped(text, width):
    return "\n\n".join(textwrap.fill(p, width, break_long_words=False) for p in text.split("\n\n"))


def test_wrapped_texts(spark):
    rows, want = [], {}
    for name in ("0BSD", "ISC", "MIT", "Unlicense"):
        text = license_scan.KNOWN[name][-1]
        for width in range(20, 100):
            for shape in (text, text.upper()):
                want[len(rows)] = name
                rows.append((len(rows), "Copyright (c) 2020, A. Body\n\n" + wrapped(shape, width)))
    # As published: the wrap puts 'copyright notice' at the start of a line.
    isc = license_scan.KNOWN["ISC"][0].replace("above copyright", "above\ncopyright")
    want[len(rows)] = "ISC"
    rows.append((len(rows), isc))
    got = license_scan.scan(spark.createDataFrame(rows, COLUMNS), license_scan.known_licenses(spark))
    found = {r.doc_id: r.license for r in got.collect()}
    assert [(i, want[i], rows[i][1]) for i in want if found[i] != want[i]] == []


@pytest.mark.parametrize("holder", [
    "Copyright 2020 A. Body.", "Copyright (c) 2020 Some Firm Inc. All rights reserved.", "© A. Body.", "(c) 1999 A. Body.",
    "COPYRIGHT 2020 BY SOME FIRM.", "Copyright Jane Doe.",
])
def test_holder_before_notice(spark, holder):
    rows = [(1, f"{holder} Licensed under the MIT License."), (2, f"{holder}\nLicensed under the MIT License.")]
    got = license_scan.scan(spark.createDataFrame(rows, COLUMNS), license_scan.known_licenses(spark)).collect()
    assert {r.doc_id: (r.license, r.notices) for r in got} == {1: ("MIT", ["MIT"]), 2: ("MIT", ["MIT"])}
