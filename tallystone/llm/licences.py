"""Licence notices: a trained paragraph classifier whose predictions templates confirm; DataFrame functions only.

A multinomial logistic regression over words and word pairs is fitted on a small labelled table of paragraphs
(numpy, on the driver). Its weights become literals of one expression per document, so the scan itself is a
projection without a shuffle and without Python on the executors.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from functools import lru_cache, reduce
from operator import or_

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NONE, UNKNOWN = "none", "unknown"
#: Licence talk; a paragraph without any of these is no notice unless a template confirms a family (``marks``).
STEMS = ("licen", "released under", "copyright", "spdx", "gpl", "apache", "creative commons", "cc by", "cc-by", "permission is hereby", "permission to use", "redistribution", "public domain", "all rights reserved")
WORD = "[a-z0-9]+(?:[.][0-9]+)*"
#: Least calibrated probability of a family, and least share of a template's word pairs, for a prediction to stand.
LEAST_PROBABILITY, LEAST_MATCH = 0.6, 0.8

# Names of licence families as notices write them.
NAMES: dict[str, tuple[str, ...]] = {
    "agpl-3.0": ("GNU Affero General Public License, version 3", "GNU AGPL v3", "AGPL-3.0"),
    "all-rights-reserved": (),
    "apache-2.0": ("Apache License, Version 2.0", "Apache 2.0 License", "Apache-2.0"),
    "bsd-3-clause": ("BSD 3-Clause License", "3-clause BSD license", "BSD-3-Clause"),
    "cc-by-4.0": ("Creative Commons Attribution 4.0 International License", "CC BY 4.0", "CC-BY-4.0"),
    "cc-by-nc-4.0": ("Creative Commons Attribution-NonCommercial 4.0 International License", "CC BY-NC 4.0", "CC-BY-NC-4.0"),
    "cc-by-sa-4.0": ("Creative Commons Attribution-ShareAlike 4.0 International License", "CC BY-SA 4.0", "CC-BY-SA-4.0"),
    "cc0-1.0": ("Creative Commons Zero 1.0 Universal License", "CC0 1.0", "CC0-1.0"),
    "gpl-2.0": ("GNU General Public License, version 2", "GNU GPL v2", "GPL-2.0"),
    "gpl-3.0": ("GNU General Public License, version 3", "GNU GPL v3", "GPL-3.0"),
    "isc": ("ISC License", "ISC"),
    "lgpl-3.0": ("GNU Lesser General Public License, version 3", "GNU LGPL v3", "LGPL-3.0"),
    "mit": ("MIT License", "MIT licence", "MIT"),
    "mpl-2.0": ("Mozilla Public License, version 2.0", "MPL 2.0 license", "MPL-2.0"),
}
FRAMES = (
    "Licensed under the {}.",
    "Licensed under {}.",
    "Released under the {}.",
    "This work is licensed under the {}.",
    "This work is licensed under a {}",
    "The source code is available under the terms of the {}, see the file LICENSE.",
    "Distributed under the {} license",
    "SPDX-License-Identifier: {}",
    "Copyright (c) 2020 The Authors. Licensed under {}",
    "You may use this file only in compliance with its license, the {}",
)
# Opening words of licence texts.
TEXTS: dict[str, tuple[str, ...]] = {
    "all-rights-reserved": ("All rights reserved.", "Copyright 2021 Example Press. All rights reserved.", "(c) Example Press, all rights reserved. No part may be reproduced without permission."),
    "mit": ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the software without restriction",),
    "isc": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",),
    "bsd-3-clause": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",),
    "apache-2.0": ("you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",),
    "gpl-3.0": ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version",),
    "gpl-2.0": ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License",),
}
#: Licence talk without a known family, and paragraphs that only share words with notices.
UNKNOWN_NOTICES = (
    "Licensed under the terms of our site agreement.",
    "This work is licensed under the house rules of the publisher.",
    "Released under a custom license, see the file.",
    "Distributed under a proprietary license.",
    "SPDX-License-Identifier: LicenseRef-Own",
    "Licensed to the reader for private use only.",
)
OTHER = (
    "He got his driving licence in March and drove to the coast.",
    "The pilot renewed her license after a medical check.",
    "The city gives licences to taxi drivers and street vendors.",
    "The school has a license to serve food, says the head.",
    "The Apache people live in the south west of the country.",
    "An apache helicopter landed at the base under heavy rain.",
    "The article on copyright law was published in a journal of history.",
    "Copyright disputes were common in the music trade, version 2 of the story says.",
    "The redistribution of land was the aim of the reform and of the public.",
    "Redistribution of income by taxes is permitted in most countries.",
    "The painting is in the public domain since the painter died long ago.",
    "They were licensed as nurses by the general medical board.",
    "A licensed guide took the group through the public gardens.",
    "The fishing licence costs ten coins for the season, free for children.",
    "Licensing talks between the two firms ended without a result.",
    "The team at MIT studied how licences are given to radio stations.",
    "The bar lost its licence after the third version of the rules came out.",
    "Poetic license allows the author to change the order of the words.",
)


def tokens(text: str) -> list[str]:
    return re.findall(WORD, text.lower())


def pairs(words: list[str]) -> list[str]:
    return [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]


def training_table() -> list[tuple[str, str]]:
    """(paragraph, class)."""
    out = [(frame.format(name), family) for family, names in NAMES.items() for name in names for frame in FRAMES]
    out += [(text, family) for family, texts in TEXTS.items() for text in texts for _ in range(3)]
    return out + [(t, UNKNOWN) for t in UNKNOWN_NOTICES for _ in range(4)] + [(t, NONE) for t in OTHER for _ in range(2)]


def templates() -> dict[str, list[list[str]]]:
    """Word pairs of each name and text of a family."""
    out: dict[str, list[list[str]]] = {}
    for family, names in NAMES.items():
        for text in (*names, *TEXTS.get(family, ())):
            words = tokens(text)
            # a name of one word needs a word of a notice beside it
            shapes = [sorted(set(pairs(words)))] if len(words) > 1 else [[f"{lead} {words[0]}"] for lead in ("under", "identifier", "the")]
            out.setdefault(family, []).extend(shapes)
    return out


@lru_cache(maxsize=1)
def marks() -> str:
    """A pattern of lower-cased text that is found wherever a template may be confirmed, beside the one-word stems.

    At least LEAST_MATCH of a template's pairs occur where it is confirmed, so of one pair more than may be missing
    one occurs. Pairs with a one-word stem need no part of the pattern. "the" before a name of one word is no mark.
    """
    plain = [s for s in STEMS if " " not in s and "-" not in s]
    out: set[str] = set()
    for shapes in templates().values():
        for shape in shapes:
            missing = int(len(shape) * (1 - LEAST_MATCH) + 1e-9)
            told = sum(any(s in p for s in plain) for p in shape)
            if told <= missing and not (len(shape) == 1 and shape[0].startswith("the ")):
                rest = [p for p in shape if not any(s in p for s in plain)]
                out |= set(sorted(rest, key=lambda p: (-len(p), p))[: missing + 1 - told])
                if len(shape) == 1 and shape[0].startswith("under "):
                    out.add(shape[0].replace("under ", "under the "))
    return "(?<![a-z0-9])(?:" + "|".join(_apart(p) for p in sorted(out)) + ")(?![a-z0-9])"


def _apart(words: str) -> str:
    """A pattern of words with anything between them that is no word, such as the end of a line."""
    return "[^a-z0-9]+".join(w.replace(".", "[.]") for w in re.split("[ -]", words))


@dataclass
class Classifier:
    """Softmax regression on the presence of words and word pairs, with a temperature fitted by cross-validation."""

    classes: list[str]
    features: list[str]
    weights: np.ndarray  # (features, classes)
    bias: np.ndarray
    temperature: float

    def probabilities(self, paragraph: str) -> np.ndarray:
        words = tokens(paragraph)
        known = {f: i for i, f in enumerate(self.features)}
        own = [known[f] for f in dict.fromkeys(words + pairs(words)) if f in known]
        z = (self.bias + self.weights[own].sum(axis=0)) / self.temperature
        e = np.exp(z - z.max())
        return e / e.sum()


def _descend(x: np.ndarray, y: np.ndarray, decay: float, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    w, b = np.zeros((x.shape[1], y.shape[1])), np.zeros(y.shape[1])
    mw, mb = np.zeros_like(w), np.zeros_like(b)
    for _ in range(rounds):
        z = x @ w + b
        e = np.exp(z - z.max(axis=1, keepdims=True))
        d = (e / e.sum(axis=1, keepdims=True) - y) / len(x)
        mw, mb = 0.9 * mw + x.T @ d + decay * w, 0.9 * mb + d.sum(axis=0)
        w, b = w - 0.5 * mw, b - 0.5 * mb
    return w, b


#: Temperatures that calibration chooses from.
TEMPERATURES = np.geomspace(0.2, 8.0, 38)


@lru_cache(maxsize=1)
def _table() -> tuple[list[str], list[str], np.ndarray, np.ndarray, np.ndarray]:
    """(classes, features, presence of features, labels, number of the distinct text) of the labelled table."""
    table = training_table()
    classes = [*sorted(NAMES), UNKNOWN, NONE]
    lists = [list(dict.fromkeys((w := tokens(t)) + pairs(w))) for t, _ in table]
    features = sorted({f for own in lists for f in own})
    place = {f: i for i, f in enumerate(features)}
    x = np.zeros((len(table), len(features)))
    for i, own in enumerate(lists):
        x[i, [place[f] for f in own]] = 1.0
    numbers = {t: i for i, t in enumerate(dict.fromkeys(t for t, _ in table))}
    return classes, features, x, np.eye(len(classes))[[classes.index(c) for _, c in table]], np.array([numbers[t] for t, _ in table])


@lru_cache(maxsize=1)
def held_out(decay: float = 2e-4, rounds: int = 240, folds: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(scores, labels) of every distinct text under a model that hasn't seen it: all rows of a text are in one fold."""
    _, _, x, y, text = _table()
    scores = np.zeros(y.shape)
    for k in range(folds):
        out = text % folds == k
        w, b = _descend(x[~out], y[~out], decay, rounds)
        scores[out] = x[out] @ w + b
    first = np.unique(text, return_index=True)[1]
    return scores[first], y[first]


def softmax(scores: np.ndarray, temperature: float) -> np.ndarray:
    e = np.exp((scores - scores.max(axis=1, keepdims=True)) / temperature)
    return e / e.sum(axis=1, keepdims=True)


def log_loss(scores: np.ndarray, labels: np.ndarray, temperature: float) -> float:
    return float(-np.log(np.maximum(1e-12, (softmax(scores, temperature) * labels).sum(axis=1))).mean())


@lru_cache(maxsize=1)
def trained(decay: float = 2e-4, rounds: int = 240) -> Classifier:
    classes, features, x, y, _ = _table()
    loss = [log_loss(*held_out(decay, rounds), t) for t in TEMPERATURES]
    w, b = _descend(x, y, decay, rounds)
    return Classifier(classes, features, np.round(w, 6), np.round(b, 6), float(TEMPERATURES[int(np.argmin(loss))]))


def _literal(value: object, kind: str) -> Column:
    """A constant of a nested type; the optimiser folds it to a literal."""
    return F.from_json(F.lit(json.dumps(value)), F.lit(kind))


def licence_findings(paragraphs: Column) -> Column:
    """array<struct<paragraph, family, probability, match>> for an array of paragraphs (null: none)."""
    model = trained()
    vocabulary = F.split(F.lit("\t".join(model.features)), "\t")
    weights = _literal(dict(zip(model.features, model.weights.tolist(), strict=True)), "map<string,array<double>>")
    bias = _literal(model.bias.tolist(), "array<double>")
    names = F.split(F.lit("\t".join(model.classes)), "\t")
    shapes = _literal(templates(), "map<string,array<array<string>>>")
    pair = lambda w: F.zip_with(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
    worded = F.transform(paragraphs, lambda p: F.struct(p.alias("p"), F.regexp_extract_all(F.lower(p), F.lit(WORD), F.lit(0)).alias("w")))
    listed = F.transform(worded, lambda r: F.struct(r["p"].alias("p"), F.array_distinct(F.concat(r["w"], pair(r["w"]))).alias("f")))
    scored = F.transform(
        listed,
        lambda r: F.struct(
            r["p"].alias("p"),
            r["f"].alias("f"),
            F.aggregate(F.array_intersect(r["f"], vocabulary), bias, lambda acc, f: F.zip_with(acc, F.element_at(weights, f), lambda a, b: a + b), lambda z: F.transform(z, lambda v: v / F.lit(model.temperature))).alias("z"),
        ),
    )
    raised = F.transform(scored, lambda r: F.struct(r["p"].alias("p"), r["f"].alias("f"), F.transform(r["z"], lambda v: F.exp(v - F.array_max(r["z"]))).alias("e")))
    best = F.transform(
        raised,
        lambda r: F.struct(
            r["p"].alias("p"),
            r["f"].alias("f"),
            (F.lit(1.0) / F.aggregate(r["e"], F.lit(0.0), lambda a, v: a + v)).alias("prob"),
            F.element_at(names, F.array_position(r["e"], F.array_max(r["e"])).cast("int")).alias("c"),
        ),
    )
    share = lambda f, t: F.size(F.array_intersect(f, t)) / F.size(t)
    matched = F.transform(best, lambda r: F.struct(r["p"].alias("p"), r["c"].alias("c"), r["prob"].alias("prob"), F.coalesce(F.array_max(F.transform(F.try_element_at(shapes, r["c"]), lambda t: share(r["f"], t))), F.lit(0.0)).alias("m")))
    stands = lambda r: (r["prob"] >= LEAST_PROBABILITY) & (r["m"] >= LEAST_MATCH)
    family = lambda r: F.when(r["c"].isin(NONE, UNKNOWN) | stands(r), r["c"]).otherwise(UNKNOWN)
    return F.transform(matched, lambda r: F.struct(r["p"].alias("paragraph"), family(r).alias("family"), r["prob"].alias("probability"), r["m"].alias("match")))


def licences(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, licence, probability, confirmed, families, n_notices), one row per input row.

    Paragraphs are runs of lines without a blank one. Each line is judged by itself, and then its paragraph as a
    whole, which counts if it is of a family that no line of it has (unknown lines are then part of it) or if no
    line is a notice. Text is a notice of a family if the classifier says so with a calibrated
    probability of at least 0.6 and a template of the family confirms it by at least 0.8 of its word pairs;
    other licence talk is "unknown". ``licence`` is the likeliest family, else "unknown", else "none" for a
    document without notices (probability null, confirmed false); ties go to the first name. ``families`` lists
    all of them in order, joined by commas. Null and empty texts have none; repeated rows give repeated rows;
    an empty table gives an empty table; other columns don't matter.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    has_stem = lambda x: reduce(or_, (F.contains(x, F.lit(s)) for s in STEMS))
    wrapped = "|".join(_apart(s) for s in STEMS if " " in s)
    talks = lambda x: has_stem(x) | F.rlike(x, F.lit(wrapped))
    judged = lambda x: talks(x) | F.rlike(x, F.lit(marks()))
    none = F.array().cast("array<string>")
    is_known = lambda r: ~r["family"].isin(NONE, UNKNOWN)
    counts = lambda r: is_known(r) | ((r["family"] == UNKNOWN) & talks(F.lower(r["paragraph"])))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.lower(text).alias("low"))
    runs = rows.select("doc_id", F.when(judged(F.col("low")), F.filter(F.split("text", "\n\\s*\n"), lambda p: judged(F.lower(p)))).otherwise(none).alias("runs"))
    lines = lambda p: F.filter(F.split(p, "\n"), lambda x: judged(F.lower(x)))
    whole = lambda p: F.when(F.contains(F.trim(p), F.lit("\n")), F.array(p)).otherwise(none)
    split = runs.select("doc_id", F.transform("runs", lambda p: F.struct(lines(p).alias("lines"), whole(p).alias("whole"))).alias("runs"))
    each = split.select("doc_id", F.transform("runs", lambda r: F.struct(F.filter(licence_findings(r["lines"]), counts).alias("own"), F.filter(licence_findings(r["whole"]), counts).alias("whole"))).alias("runs"))
    as_lines = lambda r: (F.size(r["whole"]) == 0) | F.exists(r["own"], lambda x: x["family"] == r["whole"][0]["family"]) | ((r["whole"][0]["family"] == UNKNOWN) & (F.size(r["own"]) > 0))
    found = each.select("doc_id", F.flatten(F.transform("runs", lambda r: F.when(as_lines(r), r["own"]).otherwise(F.concat(F.filter(r["own"], is_known), r["whole"])))).alias("found"))
    known = F.filter("found", lambda r: r["family"] != UNKNOWN)
    # least negative probability first, so that ties go to the first name
    top = F.array_min(F.transform(F.when(F.size(known) > 0, known).otherwise(F.col("found")), lambda r: F.struct((-r["probability"]).alias("q"), r["family"].alias("family"))))
    out = found.select("doc_id", top.alias("top"), F.array_sort(F.array_distinct(F.transform("found", lambda r: r["family"]))).alias("all"), F.size("found").cast("long").alias("n_notices"))
    name = F.coalesce(F.col("top.family"), F.lit(NONE))
    return out.select("doc_id", name.alias("licence"), F.round(-F.col("top.q"), 6).alias("probability"), (~name.isin(NONE, UNKNOWN)).alias("confirmed"), F.array_join("all", ",").alias("families"), "n_notices")
