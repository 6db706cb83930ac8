from __future__ import annotations

import textwrap

import duckdb

from tianguis.llm import licences as L


def test_every_known_sentence_has_a_cue_and_every_rule_a_sentence():
    assert all(any(c in s for c in L.CUES) for s in L.SENTENCE_IDS) and all(ids for _, ids in L.RULES)


def found(shipped, *texts):
    docs = shipped.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [(r["licences"], r["n_matches"]) for r in L.scan(docs).orderBy("doc_id").collect()]


def test_rules(shipped):
    mit = "\n".join(L._MIT)
    assert found(
        shipped, "Text.\nReleased under the MIT License.", "RELEASED*** under### the MIT&&& license.&&& more", f"Copyright (c) X\n{mit}\nend",
        "\n".join(L._BSD), "\n".join(L._BSD[:3]), " ".join(L._APACHE), "Licensed under CC BY-NC 4.0. Licensed under CC BY-NC 4.0!",
        "SPDX-License-Identifier: GPL-3.0", "a license to drive", "Licensed under the MIT License\nand then\nReleased under CC0 1.0.") == [
        ("MIT", 1), ("MIT", 1), ("MIT", 1), ("BSD-3-Clause", 1), ("BSD-2-Clause", 1), ("Apache-2.0", 1), ("CC-BY-NC-4.0", 2), ("GPL-3.0", 1), ("", 0), ("MIT,CC0-1.0", 2)]


def wrapped(sentences, width=75, mark="", end="\n", between=""):
    """A text of paragraphs as licences are distributed: lines of one width, maybe in comments."""
    lines = [x for k, s in enumerate(sentences) for x in [*([between] if k else []), *textwrap.wrap(s, width)]]
    return end.join((mark + x).rstrip(" ") for x in lines)


def test_wrapped_texts_equal_the_sql(shipped):
    mit = ["MIT License", "Copyright (c) 2020 X", *L._MIT[:2], " ".join(L._MIT[2:])]
    gpl = [f"{L._GPL[0]}", f"{L._GPL[1]} without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  {L._GPL[2]}"]
    bsd = [L._BSD[0], *[f"{k}. {x}" for k, x in enumerate(L._BSD[1:], 1)]]
    cases = [
        ("Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated", "", 0),
        (wrapped(mit), "MIT", 1), (wrapped(mit, 40, "# "), "MIT", 1), (wrapped(mit, 70, " * ", "\r\n"), "MIT", 1), ("/*\n" + wrapped(mit, 70, "// ") + "\n*/\ncode();", "MIT", 1),
        # no blank line between the title, the holder and the licence
        ("\n".join(textwrap.fill(x, 60) for x in mit), "MIT", 1), (wrapped(bsd, 79), "BSD-3-Clause", 1), (wrapped(bsd[:3], 79), "BSD-2-Clause", 1),
        (wrapped(gpl, 70, "; "), "GPL-3.0", 1), (wrapped([L._GPL2], 72), "GPL-2.0", 1), (wrapped([L._ISC], 72, "-- "), "ISC", 1), (wrapped([L._MPL], 50, "% "), "MPL-2.0", 1),
        (wrapped(L._APACHE, 72, "# "), "Apache-2.0", 1), (wrapped([L._UNLICENSE], 30), "Unlicense", 1), ("Released under the\nMIT License.", "MIT", 1),
        # a blank line ends a sentence; several on lines of their own stay several
        ("Released under the\n\nMIT License.", "", 0), ("Released under the MIT License\nReleased under CC0 1.0\nReleased under the MIT License", "MIT,CC0-1.0", 3),
        ("we say it is\nreleased under the MIT License\nand more", "MIT", 1), ("we say it is released under the MIT\nLicense", "", 0),
        ("// SPDX-License-Identifier: ISC\n// Copyright X", "ISC", 1), ("# SPDX-License-Identifier: Unlicense", "Unlicense", 1),
        ("/* SPDX-License-Identifier: GPL-2.0-only */\ncode", "GPL-2.0", 1), ("SPDX-License-Identifier: AGPL-3.0-or-later\r\n", "AGPL-3.0", 1),
        ("SPDX-License-Identifier: LGPL-3.0", "LGPL-3.0", 1), ("SPDX-License-Identifier: MIT OR Apache-2.0", "MIT,Apache-2.0", 2),
        ("// x\n// SPDX-License-Identifier: (GPL-2.0-or-later OR EPL-2.0) AND MIT\n// y", "MIT,GPL-2.0,EPL-2.0", 3),
        ("SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0", "GPL-2.0", 1), ("# SPDX-License-Identifier: LGPL-2.1-or-later\n", "LGPL-2.1", 1),
        ("SPDX-License-Identifier: EPL-2.0 OR Unheard-1.0\nSPDX-License-Identifier: Zlib", "EPL-2.0,Zlib", 2), ("SPDX-License-Identifier:", "", 0),
        # titles of full texts, centred over two lines, before other paragraphs
        ("                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007 X\n Everyone is permitted", "GPL-3.0", 1),
        ("                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n\n   TERMS", "Apache-2.0", 1),
        ("GNU LESSER GENERAL PUBLIC LICENSE\n   Version 2.1, February 1999", "LGPL-2.1", 1), ("Mozilla Public License Version 2.0\n=====\n\n1. Definitions", "MPL-2.0", 1),
        ("GNU AFFERO GENERAL PUBLIC LICENSE\nVersion 3, 19 November 2007", "AGPL-3.0", 1), ("Eclipse Public License - v 2.0\n\nTHE PROGRAM", "EPL-2.0", 1),
        # notices and full grants
        (wrapped([L._LESSER2], 70, " * "), "LGPL-2.1", 1), (wrapped([L._AFFERO], 70, "# "), "AGPL-3.0", 1), (wrapped([f"This program is free software: you can redistribute it and/or modify {L._LESSER3}"], 70), "LGPL-3.0", 1),
        (wrapped(["Copyright X", " ".join(L._ZLIB[:2]), L._ZLIB[2]], 76, between=""), "Zlib", 1), (wrapped([L._BOOST], 76, "// "), "BSL-1.0", 1),
        ("// Distributed under the Boost Software License, Version 1.0.\n// (See accompanying file", "BSL-1.0", 1)]
    data = [(k, t) for k, (t, _, _) in enumerate(cases)]
    rows = L.scan(shipped.createDataFrame(data, "doc_id long, text string")).orderBy("doc_id").collect()
    assert [(r["licences"], r["n_matches"]) for r in rows] == [(name, n) for _, name, n in cases]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", data)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, con.execute(L.oracle()).fetchall()))


def test_odd_rows_equal_the_sql(odd_docs, no_docs):
    rows = L.scan(odd_docs).collect()
    assert len(rows) == odd_docs.count() and all(r["licences"] == "" for r in rows) and L.scan(no_docs).count() == 0
    assert "Python" not in L.scan(odd_docs)._jdf.queryExecution().toString()
    texts = [*L._MIT, "Released under the MIT License.", None, "", "K Licensed under CC BY 4.0."]
    data = [(k, t) for k, t in enumerate(texts)] + [(3, "Licensed under CC BY 4.0.")] * 2
    spark = odd_docs.sparkSession
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", data)
    want = sorted(map(tuple, con.execute(L.oracle()).fetchall()))
    assert sorted(map(tuple, L.scan(spark.createDataFrame(data, "doc_id long, text string")).collect())) == want
