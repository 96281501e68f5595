"""Licence scans: families named in altered ways, prose with cues, and the native plan."""

import math
import random
import textwrap

import pytest
import regex

from weftline.llm import licences


@pytest.fixture(scope="module")
def scan(spark):
    def run(texts):
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        return {r["doc_id"]: r for r in licences.scan(df).collect()}

    return run


def test_every_template_is_its_own_family(scan):
    pairs = [(f, s) for f, sentences in licences.TEMPLATES.items() for s in sentences]
    got = scan([s for _, s in pairs])
    assert [(s, got[i]["families"]) for i, (_, s) in enumerate(pairs) if got[i]["families"] != pairs[i][0]] == []
    assert all(licences.re.search(licences.CUE, s) for _, s in pairs)


def test_surrounded_shouted_and_several(scan, prose):
    a, b = licences.TEMPLATES["apache-2.0"][0], licences.TEMPLATES["gpl-3.0"][0]
    got = scan([f"{prose(60, 1)}\n{a}\n{prose(60, 2)}", a.upper(), f"{prose(20, 3)} {a} {b} {prose(20, 4)}", prose(400, 5).replace("\n", " ") + " " + b + " " + prose(9, 6)])
    assert [got[i]["families"] for i in range(4)] == ["apache-2.0", "apache-2.0", "apache-2.0,gpl-3.0", "gpl-3.0"]
    assert got[2]["n_paragraphs"] == 2 and got[0]["family"] == "apache-2.0" and got[0]["probability"] > 0.5


def test_versions_are_told_apart(scan):
    got = scan([licences.TEMPLATES["gpl-2.0"][0], licences.TEMPLATES["gpl-3.0"][0], "Licensed under CC BY 4.0.", "Licensed under CC BY-NC 4.0."])
    assert [got[i]["families"] for i in range(4)] == ["gpl-2.0", "gpl-3.0", "cc-by", "cc-by-nc"]


def test_prose_with_cues_is_unknown(scan):
    texts = [*licences.OTHER, "The license was lost in the river.", "Copyright is discussed in chapter two of the book.", "permission", "license version"]
    assert [r["families"] for r in scan(texts).values()] == [""] * len(texts)


def test_edges(spark, prose):
    text = licences.TEMPLATES["mit"][0]
    docs = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, text, 1), (3, text, 1), (None, text, 1), (4, prose(50_000, 1) + "\n" + text, 1)], "doc_id long, text string, family int")
    got = sorted((str(r["doc_id"]), r["n_paragraphs"], r["families"]) for r in licences.scan(docs).collect())
    assert got == [("1", 0, ""), ("2", 0, ""), ("3", 2, "mit"), ("3", 2, "mit"), ("4", 1, "mit"), ("None", 1, "mit")]
    assert licences.scan(docs.filter("false")).count() == 0


def test_plan_is_native(spark):
    df = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    plan = licences.scan(df)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "Cartesian"))


def test_model_on_altered_copies_it_has_not_seen():
    import numpy as np

    model = licences.train()
    texts, labels = licences._examples(np.random.default_rng(99), 4)
    place = {g: k for k, g in enumerate(model.grams)}
    right = []
    for words, label in zip(texts, labels, strict=True):
        z = model.bias + sum(model.weights[:, place[g]] for g in licences._grams(words) if g in place)
        p = np.exp(z - z.max())
        right.append((int(z.argmax()) == label, (p / p.sum()).max()))
    accuracy, confidence = (np.mean([r[k] for r in right]) for k in (0, 1))
    assert accuracy > 0.95 and abs(accuracy - confidence) < 0.08


@pytest.mark.parametrize("mark", ["", " * "])
def test_wrapped_templates(scan, mark):
    pairs = [(f, s) for f, some in licences.TEMPLATES.items() for s in some for _ in (60, 70, 79, 80)]
    widths = [60, 70, 79, 80] * (len(pairs) // 4)
    texts = [f"{mark}A title\n{mark}\n" + textwrap.fill(s, w, initial_indent=mark, subsequent_indent=mark) + f"\n{mark}\nOther text" for (_, s), w in zip(pairs, widths, strict=True)]
    got = scan(texts)
    assert [(f, w, got[i]["families"]) for i, ((f, _), w) in enumerate(zip(pairs, widths, strict=True)) if got[i]["families"] != f or got[i]["n_paragraphs"] != 1] == []


def classified(paragraph, model):
    """Family and probability of a paragraph by plain arithmetic, or None."""
    words = licences._words(paragraph)
    grams = licences._grams(words)
    z = [float(b) + sum(float(w) for w, g in zip(row, model.grams, strict=True) if g in grams) for b, row in zip(model.bias, model.weights.tolist(), strict=True)]
    if not grams & set(model.grams):
        return None
    family, p = model.classes[z.index(max(z))], 1 / sum(math.exp(v - max(z)) for v in z)
    if family == licences.UNKNOWN or p < licences.CONFIDENT:
        return None
    share = max(len(set(t) & set(words)) / len(set(t)) for t in map(licences._words, licences.TEMPLATES[family]))
    return (family, p) if share >= licences.CONTAINED else None


def plain(text, model):
    """Every confirmed paragraph of a text, found one by one."""
    out = []
    for sentence in regex.split(licences._CUT, text or ""):
        if not regex.search(licences._CUE_WRAPPED, sentence):
            continue
        lines = sentence.split("\n")
        found = [classified(x, model) for x in lines if regex.search(licences.CUE, x)]
        found = [x for x in found if x]
        whole = None
        if len(lines) > 1:
            joined = regex.sub(r"(?<=[\p{L}\p{N}])-[\x20\t\r]*\n[^\p{L}\p{N}\n]*", "-", sentence)
            joined = regex.sub(r"[^\p{L}\p{N}\n]*\n[^\p{L}\p{N}\n]*", " ", joined)
            whole = classified(joined, model) if regex.search(licences.CUE, joined) else None
        out += found if whole is None or any(f == whole[0] for f, _ in found) else [whole]
    return out


def test_equals_a_plain_scan(spark, prose):
    rng, model = random.Random(5), licences.train()
    every = [s for some in licences.TEMPLATES.values() for s in some]
    rows = []
    for i in range(150):
        parts = []
        for _ in range(rng.randint(1, 6)):
            s = rng.choice([*every, *licences.OTHER, prose(rng.randint(3, 40), rng.randrange(10**6)), "All rights", "Under the license - version 2"])
            words = [w for w in s.split(" ") if rng.random() > rng.choice([0, 0, 0.1, 0.3])]
            mark = rng.choice(["", "", "# ", " * ", "// "])
            parts.append(textwrap.fill(" ".join(words), rng.choice([20, 40, 72, 500]), initial_indent=mark, subsequent_indent=mark))
        rows.append((i, rng.choice(["\n", "\n\n", " "]).join(parts)))
    got = {r["doc_id"]: r for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    some = 0
    for i, text in rows:
        want = plain(text, model)
        best = max(((p, f) for f, p in want), default=(None, None))
        assert got[i]["n_paragraphs"] == len(want) and got[i]["families"] == ",".join(sorted({f for f, _ in want})), text
        assert got[i]["probability"] == (pytest.approx(best[0], rel=1e-9) if want else None)
        some += bool(want)
    assert 75 < some < 150


HEADERS = {
    "mit": 'MIT License\n\nCopyright (c) 2024 Someone\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the "Software"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software, and to permit persons to whom the Software is\nfurnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all\ncopies or substantial portions of the Software.',
    "apache-2.0": 'Copyright 2024 Someone\n\nLicensed under the Apache License, Version 2.0 (the "License");\nyou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0',
    "gpl-3.0": "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.\n\nThis program is distributed in the hope that it will be useful,\nbut WITHOUT ANY WARRANTY.",
    "bsd": "Copyright (c) 2024, Someone\n\nRedistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at http://mozilla.org/MPL/2.0/.",
}


@pytest.mark.parametrize(("mark", "before", "after"), [("", "", ""), ("# ", "", ""), (" * ", "/*\n", "\n */"), ("// ", "", ""), ("-- ", "", "")])
def test_headers_as_they_stand_in_files(scan, prose, mark, before, after):
    texts = [f"{before}{textwrap.indent(h, mark, lambda _: True)}{after}\n\n{prose(60, k)}" for k, h in enumerate(HEADERS.values())]
    assert [got["families"] for got in scan(texts).values()] == list(HEADERS)
