"""License rules against plain Python."""

import random
import re

from skein.llm import license_rules, queries

LOWER = {c: c + 32 for c in range(65, 91)}


def base_licenses(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(LOWER))
    places, labels = [], set()
    for phrase, label in license_rules.BASE:
        p = phrase.split()
        at = [k for k in range(len(words)) if words[k : k + len(p)] == p]
        places += at
        labels |= {label} if at else set()
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_licenses_equal_brute_force(docs, rows):
    got = license_rules.scan(docs).collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in got), key=repr) == sorted(((i, *base_licenses(t)) for i, t in rows), key=repr)
    for r in got:
        assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(",")))
        assert 0 <= r["score"] <= 1 and (r["score"] > 0) == bool(r["labels"])


def test_license_priorities(spark):
    texts = ["Released under the MIT License.", "Licensed under CC BY-NC 4.0.", "SPDX-License-Identifier: Apache-2.0", "GNU Lesser General Public License v2.1", "nothing"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in license_rules.scan(df).collect()}
    assert got[0] == ("mit", 0.9) and got[1] == ("cc-by,cc-by-nc", 0.9) and got[2] == ("apache-2.0", 1.0) and got[4] == ("", 0.0)
    assert got[3][0] == "gpl,lgpl-2.1"


def a_string(parsed, rnd):
    """A random string that a pattern of literals, classes, branches and bounded repeats matches; looks around say nothing."""
    out = ""
    for op, arg in parsed:
        kind = str(op)
        if kind == "LITERAL":
            out += chr(arg)
        elif kind == "NOT_LITERAL":
            out += rnd.choice("qé7")
        elif kind == "IN":
            low = [chr(x) for o, a in arg if str(o) != "NEGATE" for x in ([a] if str(o) == "LITERAL" else range(a[0], a[1] + 1))]
            out += rnd.choice("qé7") if str(arg[0][0]) == "NEGATE" else rnd.choice(low)
        elif kind == "BRANCH":
            out += a_string(rnd.choice(arg[1]), rnd)
        elif kind == "SUBPATTERN":
            out += a_string(arg[3], rnd)
        elif kind in ("MAX_REPEAT", "MIN_REPEAT"):
            for _ in range(rnd.randint(arg[0], min(arg[1], arg[0] + 2))):
                out += a_string(arg[2], rnd)
        else:
            assert kind.startswith("ASSERT"), kind
    return out


def test_every_match_passes_the_gate_and_holds_a_keyword():
    rnd = random.Random(1)
    assert len(license_rules.signatures()) > 150 and len(license_rules.rules()) > 450
    for n, priority, label, keywords, rx in license_rules.rules():
        for _ in range(60):
            s = f" {a_string(re._parser.parse(rx), rnd)} "
            assert re.search(rx, s) and any(k in s for k in keywords.split("|")), (label, rx, s)
            assert any(g in s for g in license_rules.GATE), (label, rx, s)


def ungated_licenses(text):
    """Labels by all rules without a gate, in plain Python."""
    s = " " + " ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(LOWER))) + " "
    found = [(m.start(), m.end(), p, n, label) for n, p, label, _, rx in license_rules.rules() for m in re.finditer(rx, s)]
    stays = lambda x: not any(y[0] <= x[0] and y[1] >= x[1] and y[2] <= x[2] and (y[:2] != x[:2] or (y[2], y[3]) < (x[2], x[3])) for y in found)
    return {x[4] for x in found if stays(x)} | set(filter(None, base_licenses(text)[4].split(",")))


def test_licenses_equal_all_rules_ungated(spark):
    want = {
        "the Expat License": "mit", "a FreeBSD license": "bsd-2-clause", "LGPLv3": "lgpl-3.0", "AGPLv3": "agpl-3.0", "MPLv2": "mpl-2.0", "EUPLv1.2": "eupl-1.2", "GPL3": "gpl-3.0",
        "LGPLv2.1": "lgpl-2.1", "Creative Commons Attribution Share Alike 4.0": "cc-by-sa", "SPDX-License-Identifier: MIT": "mit", "SPDX-License-Identifier: ISC": "isc",
        "SPDX-License-Identifier: Zlib": "zlib", "SPDX-License-Identifier: EPL-2.0": "epl-2.0", "It is licensed under MIT.": "mit", "licensed under GPL version 2": "gpl-2.0",
        "licensed under the Apache License, Version 2.0": "apache-2.0", "SPDX-License-Identifier: BSD-3-Clause": "bsd-3-clause", "at MIT we use vim, zlib and ruby": "",
    }
    df = spark.createDataFrame(list(enumerate(want)), "doc_id long, text string")
    got = {r["doc_id"]: r["labels"] for r in license_rules.scan(df).collect()}
    for k, (text, labels) in enumerate(want.items()):
        assert got[k] == labels == ",".join(sorted(ungated_licenses(text))), text


TEXTS = {
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files": "mit",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that": "bsd",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.": "gpl,gpl-3.0",
    "see http://www.apache.org/licenses/LICENSE-2.0": "apache-2.0",
    "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.": "cc-by-sa",
    "This is free and unencumbered software released into the public domain.": "unlicense",
    "<https://creativecommons.org/licenses/by-nc-nd/3.0/>": "cc-by-nc-nd",
    "Copyright (c) 2019 Someone. All rights reserved.": "copyright,reserved",
    "Neither the name of the University nor the names of its contributors may be used to endorse or promote products": "bsd-3-clause",
    "I have permission to keep a copy; the warranty ends in May, and the public domain name server is down": "",
    "das wird mit einem Bus gemacht, und die Sa. ist nd": "",
}


def test_license_texts_and_notices(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = {r["doc_id"]: r["labels"] for r in license_rules.scan(df).collect()}
    for k, (text, labels) in enumerate(TEXTS.items()):
        assert got[k] == labels == ",".join(sorted(ungated_licenses(text))), text


def plain_scan(text):
    """(labels, score, detections) by all rules without a gate and a full search for what contains what."""
    s = " " + " ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(LOWER))) + " "
    word = lambda at: s[:at].count(" ") - 1
    found = [(word(m.start()), word(m.end()) + 1, p, n, label) for n, p, label, _, rx in license_rules.rules() for m in re.finditer(rx, s)]
    stays = [x for x in found if not any(y[0] <= x[0] and y[1] >= x[1] and y[2] <= x[2] and (y[:2] != x[:2] or (y[2], y[3]) < (x[2], x[3])) for y in found)]
    base = set(filter(None, base_licenses(text)[4].split(",")))
    best = min((x[2] for x in stays), default=None)
    score = license_rules.CONFIDENCE[best - 1] if best else 0.5 if base else 0.0
    return ",".join(sorted({x[4] for x in stays} | base)), score, sorted((a, b, label, p) for a, b, p, _, label in stays)


def test_query_equals_all_rules_without_a_gate(spark, sf):
    docs = [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    out = queries.op5_licenses(spark, sf)
    assert out.columns == ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    got = {r["doc_id"]: r for r in out.collect()}
    for i, t in docs:
        labels, score, _ = plain_scan(t)
        assert (got[i]["labels"], got[i]["score"]) == (labels, score), i
        assert tuple(got[i][c] for c in ("n_words", "n_base", "first_word", "last_word", "base_labels")) == base_licenses(t)


def test_suppression_equals_full_search(spark):
    """Random heaps of names, notices and phrases, so that detections overlap, contain each other and tie."""
    rnd = random.Random(7)
    parts = ["MIT License", "Apache License, Version 2.0", "GPLv3", "GNU General Public License v2", "licensed under", "released under the terms of the", "SPDX-License-Identifier:", "see the", "CC BY-NC 4.0", "CC BY", "all rights reserved", "or later", "only", "LGPL 2.1", "BSD 3-Clause", "Lesser General Public License", "copyright (c) 2001", "word", *list(TEXTS)[:3]]
    texts = [" ".join(rnd.choices(parts, k=rnd.randint(1, 12))) for _ in range(150)]
    got = {r["doc_id"]: r for r in license_rules.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for k, t in enumerate(texts):
        labels, score, kept = plain_scan(t)
        assert (got[k]["labels"], got[k]["score"]) == (labels, score), t
        assert sorted(tuple(d) for d in got[k]["detections"]) == kept, t
