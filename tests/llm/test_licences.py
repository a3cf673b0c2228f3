import textwrap

import pytest

from episodica.llm import licences
from tests.llm.conftest import prose


@pytest.fixture(scope="module")
def corpus(spark, scratch):
    texts = ["\n".join(prose(100 * i + k, 12) for k in range(6)) for i in range(150)]
    texts += [
        "Released under the MIT License.\n" + prose(1, 30), prose(2, 30) + "\nLicensed under the Apache License, Version 2.0.\n" + prose(3, 9),
        prose(4, 20) + " This work is licensed under the GNU General Public License, version 3. " + prose(5, 20), "All rights reserved.",
        "licensed under cc by-nc 4.0\nReleased under the MIT license", "We need no license for the car; a license plate was lost.", None, "", "\n\n",
        "SPDX-License-Identifier: MIT",
    ]
    path = str(scratch / "licences.parquet")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'x' as line", "'y' as family", "'z' as words").repartition(3).write.parquet(path)
    return spark.read.parquet(path)


def test_families_are_found_and_prose_is_not(corpus):
    out = licences.licences(corpus)
    got = {r["doc_id"]: r for r in out.collect()}
    assert len(got) == 160
    assert all(got[i]["licences"] == "none" for i in [*range(150), 156, 157, 158])
    assert [got[i]["licences"] for i in (150, 151, 152, 153, 154, 159)] == ["mit", "apache", "gpl", "reserved", "cc-by-nc,mit", "mit"]
    assert got[155]["licences"] in ("none", "unknown")
    assert got[154]["n_licence_lines"] == 2 and got[0]["best_chance"] is None


def test_scan_runs_without_python(corpus):
    plan = licences.licences(corpus)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_held_out_variants_of_notices(spark, corpus):
    """Notices with other words around them, and lower case; at least nine in ten are found."""
    model = licences.train(corpus)
    rows, want = [], {}
    for family, texts in licences.TEMPLATES.items():
        for text in texts:
            for k in range(3):
                want[len(rows)] = family
                rows.append((len(rows), f"{prose(7000 + len(rows), 2 * k)} {text.lower() if k == 1 else text} {prose(8000 + len(rows), k)}"))
    got = {r["doc_id"]: r["licences"] for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert sum(got[i] == f for i, f in want.items()) >= 0.9 * len(want)


def test_wrapped_notices_and_other_wordings(spark, corpus):
    """Notices wrapped at several widths, with a comment's marks, and wordings that no template has."""
    model, rows, want = licences.train(corpus), [], {}
    for family, texts in licences.TEMPLATES.items():
        for text in (t for t in texts if len(t) > 50):
            for width in (30, 45, 72, 78):
                for mark, ends in (("", "\n"), (" * ", "\n"), ("# ", "\r\n")):
                    want[len(rows)] = family
                    rows.append((len(rows), prose(len(rows), 12) + ends * 2 + ends.join(mark + x for x in textwrap.wrap(text, width)) + ends * 2 + prose(9000 + len(rows), 12)))
    other = {
        "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted, provided that these conditions are met: keep this notice",
        "gpl": "You can redistribute it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 or any later one",
        "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in it",
    }
    for family, text in other.items():
        want[len(rows)] = family
        rows.append((len(rows), textwrap.fill(text, 60)))
    for text in ("This package is distributed under the MIT\nLicense.", "See the Apache License,\nVersion 2.0, for details."):
        rows.append((len(rows), text))
    got = {r["doc_id"]: r for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    missed = {i: got[i]["licences"] for i, f in want.items() if f not in got[i]["licences"].split(",")}
    assert len(missed) <= 0.05 * len(want), missed
    assert all(got[len(rows) - k]["licences"] != "none" for k in (1, 2))
    assert all(got[i]["n_unknown_lines"] <= got[i]["n_licence_lines"] for i in got)


def test_messy_rows(messy, empty):
    got = licences.licences(messy).collect()
    assert len(got) == messy.count() and {r["licences"] for r in got} == {"none"}
    assert licences.licences(empty).count() == 0


def test_training_counts_every_line(spark, scratch):
    """Anchors and counts are those of all different lines of all documents, of which there are more than a sample took."""
    rows = [(i, "\n".join([f"q{i}a z{4 * i + k}" + (" isc" if i < 21 and k == 0 else " mpl" if i < 20 and k == 1 else "") for k in range(4)])) for i in range(2500)]
    rows += [(9000 + i, rows[0][1]) for i in range(50)]  # copies count once
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    seen = licences._seen(docs)
    assert (seen.where("not whole").count(), seen.where("whole").count()) == (10_000, 2500)
    anchors = licences.train(docs).anchors  # one in 500 lines at most: 20 of 10,000
    assert "mpl" in anchors and "isc" not in anchors
