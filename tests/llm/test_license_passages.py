"""Operator 3 against planted notices: short, wrapped, inside longer lines, and the openings of full licence texts."""

from __future__ import annotations

import duckdb
import oracle

from tarifa.llm import license_scan

MIT = """MIT License

Copyright (c) 2020 Some Body

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:"""
FILL = "the river of the town was free to all persons and the use of this copy is in the old form "
PLANTED = {
    "All rights reserved.": ["all-rights-reserved"],
    f"{FILL}\nAll rights reserved.\n{FILL}": ["all-rights-reserved"],
    f"{FILL * 9} All rights reserved. {FILL * 9}": ["all-rights-reserved"],
    f"{FILL}\nThis project is licensed\nunder the MIT License.\n{FILL}": ["MIT"],
    f"{FILL * 40} This work is licensed under the GNU General Public License, version 3. {FILL * 40}": ["GPL-3.0"],
    f"{FILL} Licensed under\nthe Apache License, Version 2.0. {FILL} Released under the\nMIT License.": ["Apache-2.0", "MIT"],
    MIT: ["MIT"],
    "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation, Inc.\n" + FILL * 5: ["GPL-3.0"],
    "Apache License\nVersion 2.0, January 2004\nhttp://www.apache.org/licenses/\n\nTERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION\n" + FILL * 5: ["Apache-2.0"],
    FILL * 30: [],
    "all persons and rights of the town are reserved": [],
}


def test_planted_notices(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(PLANTED)], "doc_id long, text string")
    got = {r["doc_id"]: r["licences"] for r in license_scan.scan(docs, ["doc_id"]).collect()}
    assert got == dict(enumerate(PLANTED.values()))


def test_every_short_line_of_the_table_is_found(spark):
    path = f"{oracle.SMALL}/documents.parquet"
    want = duckdb.sql(f"SELECT doc_id FROM '{path}' WHERE list_contains(string_split(text, chr(10)), 'All rights reserved.')").fetchall()
    got = license_scan.scan(spark.read.parquet(path), ["doc_id"]).where("array_contains(licences, 'all-rights-reserved')").collect()
    assert {i for i, in want} <= {r["doc_id"] for r in got}
