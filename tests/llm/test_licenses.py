"""License detections against a plain Python version: labels, suppression and score."""

import re

from terrafold.llm import licenses

SAMPLES = [
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\")",
    "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    "SPDX-License-Identifier: GPL-2.0-or-later", "spdx license identifier: BSD-3-Clause and more MIT license text",
    "GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "released under the terms of the Mozilla Public License 2.0", "Copyright (c) 2011 all rights reserved", "a word of the blue oak model license 1.0.0 and blueoak model license",
    "Redistribution and use in source and binary forms, with or without modification, are permitted. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "Neither the name of the Foo Bar project nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "the MIT license, the mit licence and the Apache license; mit license mit license", "general public license affero general public license gnu lesser general public license", "hope deal change purpose public domain dedicated to the public domain",
    None, "", "   ", "no licence here", "mit license", "é MIT É license ünder the MIT license", "copyright 1999 " * 400 + "you can buy me a beer in return",
]


def words(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)


def brute(text):
    """base labels, labels, score."""
    w = words(text)
    t = " " + " ".join(w) + " " if w else " "
    word_at = {0: 0}
    at = 1
    for k, x in enumerate(w):
        word_at[at] = k
        at += len(x) + 1
    found = [(word_at[m.start()], word_at[m.start()] + len(m[0].split(" ")), r["prio"], r["label"]) for r in licenses.rules() if " " + r["kw"] in t for m in re.finditer(r["pattern"], t)]
    live = [x for x in found if not any(y[0] <= x[0] and y[1] >= x[1] and (y[2] > x[2] or y[2] == x[2] and y[1] - y[0] > x[1] - x[0]) for y in found)]
    base = {label for phrase, label in licenses.BASE if f" {phrase} " in t}
    covered = {k for b, e, _, _ in live for k in range(b, e)}
    return ",".join(sorted(base)), ",".join(sorted(base | {x[3] for x in live})), min(1.0, len(covered) / max(1, len(w)))


def test_labels_and_score(spark):
    rows = [(k, t) for k, t in enumerate(SAMPLES)] + [(3, SAMPLES[3]), (3, SAMPLES[3]), (None, SAMPLES[0]), (None, None)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, label string, found int")
    got = sorted(((r.doc_id, r.base_labels, r.labels, round(r.score, 9)) for r in licenses.scan(df).collect()), key=str)
    want = sorted(((i, a, b, round(c, 9)) for i, (a, b, c) in ((i, brute(t)) for i, t in rows)), key=str)
    assert got == want
    assert any("blueoak" in r[2] for r in got) and not any("bluespec" in r[2] for r in got)


def test_whole_text_is_scanned(spark):
    """A license behind a very long text is found, and ties of equal rules are one label."""
    df = spark.createDataFrame([(1, "word " * 200_000 + "SPDX-License-Identifier: MIT")], "doc_id long, text string")
    row = licenses.scan(df).first()
    assert row.labels == "mit" and row.n_words == 200_004 and 0 < row.score < 0.001


def test_labels_by_hand(spark):
    """Labels that a reader would give: a longer name wins over one inside it, and a version may stand behind the word license."""
    want = {
        "under a two clause bsd license here": "bsd-2-clause",
        "the three clause BSD license": "bsd-3-clause",
        "Apache License 2.0": "apache,apache-2.0",
        "the Apache Software License, version 1.1, applies": "apache-1.1",
        "artistic license 2.0": "artistic-2.0",
        "GNU Lesser General Public License v2.1": "gpl,lgpl-2.1",
        "GNU Affero General Public License, version 3": "agpl-3.0,gpl",
        "Mozilla Public License 2.0 or the BSD license": "bsd,mpl-2.0",
        "mit license and the isc license": "isc,mit",
        "SPDX-License-Identifier: MIT-0": "mit-0",
        "the mit no attribution license": "mit-0",
        "a licensed driver": "",
    }
    df = spark.createDataFrame(list(enumerate(want)), "doc_id long, text string")
    got = {r.doc_id: r.labels for r in licenses.scan(df).collect()}
    assert [got[k] for k in range(len(want))] == list(want.values())
