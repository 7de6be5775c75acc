import duckdb
import pandas as pd

from quadrille.llm import license_scan, quality_rules

TEXTS = [
    None, "", " \n\t ", "one", "a b a b a b a b", "x y z", "Größe   é\nGröße   é\n\n \nx", "#*$%&|<> !! a",
    "w " * 120, "\n".join(["the line is the same of it " * 3] * 9), " ".join(f"the{k} of and" for k in range(80)),
    "Licensed under the Apache License, Version 2.0.", "mit license mit license MIT-License", "cc-by cc by. CC BY-NC 4.0 licensed under cc by nc",
    "Released under\nthe MIT License", "xcc by", "cc byx", "mİt license K", "This work is licensed under the GNU General Public License, version 3.",
    "gnu general public license gnu general public license cc  by", "This work is licensed under the GNU General\rPublic License",
]


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software"""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided"""
TEXTS += [
    MIT, BSD, "words before\n\n" + MIT + "\n\nwords after", MIT.replace("\n", " "), MIT.replace("obtaining a copy\n", "obtaining a copy\n\n"), "x " * 70 + "\n" + BSD, BSD.replace("\n", " " * 130 + "\n"),
    "released\nunder\nthe\nmit\nlicense", "released\n \nunder the mit license", "a\nb\n" * 3000 + BSD, "license " * 40_000 + "mit license",
]


def compared(spark, op, sql, extra="kept"):
    rows = [(k, t, "z", 5) for k, t in enumerate(TEXTS)] + [(4, TEXTS[4], "z", 5)]
    documents = pd.DataFrame(rows[:-1], columns=["doc_id", "text", "score", extra])  # noqa: F841
    want = duckdb.connect().sql(sql).df().set_index("doc_id").sort_index()
    got = op(spark.createDataFrame(rows, f"doc_id long, text string, score string, {extra} int")).toPandas()
    assert len(got) == len(rows)
    got = got.drop_duplicates().set_index("doc_id").sort_index()
    pd.testing.assert_frame_equal(got, want[got.columns], check_dtype=False)
    assert op(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_quality_rules(spark):
    compared(spark, quality_rules.quality_rules, quality_rules.oracle_sql())


def test_wrapped_notices_are_found(spark):
    rows = [(1, MIT), (1, BSD), (None, BSD.upper()), (2, None), (2, MIT.replace("\n", "\n\n"))]
    got = license_scan.license_scan(spark.createDataFrame([(*r, "z", 1) for r in rows], "doc_id long, text string, row string, blocks int")).collect()
    assert sorted((r.doc_id or 0, r.labels, r.score) for r in got) == [(0, "bsd", 1.0), (1, "bsd", 1.0), (1, "mit", 1.0), (2, "", 0.0), (2, "", 0.0)]


def test_license_scan(spark):
    compared(spark, license_scan.license_scan, license_scan.oracle_sql(), "label")
