"""Licence scan: a trained classifier of paragraphs, confirmed by comparison with templates. Scoring is DataFrame operations only.

A paragraph is a line with words. Its features are its distinct words and word pairs (lower case, ASCII letters and digits).
A multinomial logistic regression with an L1 penalty keeps few features; a paragraph's score is a join of its words and
pairs with the table of features and a sum. The probabilities are calibrated by a temperature on examples held out, with
``unknown`` as a class of its own. As the weights are few, a bound on what all weak features can add up to leaves a set of
features of which a paragraph must have one; only these paragraphs are scored. A family is predicted if it is the most probable and reaches ``least``, and confirmed if
the paragraph and a template of the family share ``alike`` of the word pairs of either one, three pairs at least.

The model is fitted on the driver on examples made from the templates (words left out, cut, with words around them) and, for
``unknown``, on paragraphs of ``sample`` documents with the smallest hash of their id that resemble no template.

Null and empty texts have no paragraphs. Rows equal in id and text are one document: all get its result. Extra columns are
not looked at. An empty table gives an empty result.
"""

from __future__ import annotations

import random
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regspark.llm.common import row_key

TOKEN = "[a-z0-9]+(?:[.][0-9]+)*"

# Notices of public licences by family.
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see http://www.gnu.org/licenses/",
    ],
    "LGPL": [
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ],
    "AGPL": [
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "BSD": [
        "Released under the BSD License.",
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "MPL": [
        "Licensed under the Mozilla Public License, version 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/",
    ],
    "CC-BY": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "CC-BY-SA": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "CC-BY-NC": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "CC0": [
        "Released under CC0 1.0 Universal.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under CC0 1.0.",
    ],
    "ISC": [
        "Licensed under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ],
}

#: Sentences near the subject that are no licence notice.
OTHER = [
    "The driver showed a license at the gate and went on.",
    "The company sells a license for each seat and year.",
    "Please read the general terms before you travel.",
    "The public library opens at nine and is free for all.",
    "Version 3.0 of the program was released in spring.",
    "The warranty covers parts and labor for two years.",
    "The work of the foundation is known to the public.",
    "Copyright law differs between countries.",
    "The software runs on any machine with a browser.",
    "Apache helicopters crossed the valley at noon.",
    "You may not park in front of the gate without permission.",
    "The source of the river is in the mountains.",
    "A copy of the report was sent to the author.",
    "The city council agreed in writing to the terms.",
    "The restaurant lost the license to sell wine.",
    "Common rights of way are open to any person.",
]
FAMILIES = [*TEMPLATES, "unknown"]


def _words(text: str) -> list[str]:
    return re.findall(TOKEN, text.lower())


def _features(words: list[str]) -> set[tuple[str, str | None]]:
    return {(w, None) for w in words} | set(zip(words, words[1:]))


def _pairs(words: list[str]) -> set[tuple[str, str | None]]:
    return set(zip(words, words[1:]))


def _plain(negatives: list[str]) -> list[list[str]]:
    """Words of the paragraphs that resemble no template."""
    shapes = [_pairs(_words(t)) for ts in TEMPLATES.values() for t in ts]
    return [w for w in map(_words, negatives) if w and max(len(_pairs(w) & s) / max(len(s), 1) for s in shapes) < 0.3]


def examples(negatives: list[str], each: int = 30, seed: int = 5) -> tuple[list[set], np.ndarray]:
    """Feature sets and class numbers."""
    rnd = random.Random(seed)
    plain = _plain(negatives)
    filler = [w for p in plain for w in p] or ["lorem"]
    sets, classes = [], []
    for k, family in enumerate(TEMPLATES):
        for t in TEMPLATES[family]:
            own = _words(t)
            for i in range(each):
                w = own if i < 3 else [x for x in own if rnd.random() > rnd.choice([0, 0, 0.1])]
                if i % 5 == 4 and len(own) > 16:
                    at = rnd.randrange(0, len(own) - 12)
                    w = own[at:at + rnd.randint(12, len(own) - at)]
                around = lambda: [rnd.choice(filler) for _ in range(rnd.choice([0, 0, 2, 6]))]
                sets.append(_features([*around(), *w, *around()]))
                classes.append(k)
    every = sorted({x for ts in TEMPLATES.values() for t in ts for x in _words(t)})
    none = [*plain, *[_words(o) for o in OTHER for _ in range(4)], *[[rnd.choice(every) for _ in range(rnd.randint(2, 12))] for _ in range(400)]]
    sets += [_features(w) for w in none]
    return sets, np.array(classes + [len(TEMPLATES)] * len(none))


def fit(negatives: list[str], rounds: int = 250, penalty: float = 3e-3, seed: int = 5) -> tuple[dict[tuple[str, str | None], np.ndarray], np.ndarray, float]:
    """Weights by feature, bias, temperature. What stands in one of fifty paragraphs that resemble no template tells nothing and is no feature, unless a template holds it. Proximal gradient with momentum on a balanced multinomial loss."""
    sets, y = examples(negatives, seed=seed)
    count: dict = {}
    for s in sets:
        for f in s:
            count[f] = count.get(f, 0) + 1
    plain = [_features(w) for w in _plain(negatives)]
    held_by = set().union(*[_features(_words(t)) for ts in TEMPLATES.values() for t in ts])
    common: dict = {}
    for f in (f for s in plain for f in s):
        common[f] = common.get(f, 0) + 1
    names = sorted((f for f, n in count.items() if n >= 4 and (f in held_by or common.get(f, 0) <= 0.02 * len(plain))), key=lambda f: (f[0], f[1] or ""))
    place = {f: i for i, f in enumerate(names)}
    x = np.zeros((len(sets), len(names)), np.float32)
    for i, s in enumerate(sets):
        x[i, [place[f] for f in s if f in place]] = 1
    held = np.arange(len(sets)) % 4 == 3
    k = len(FAMILIES)
    truth = np.eye(k, dtype=np.float32)[y]
    own = (1 / np.maximum(np.bincount(y[~held], minlength=k), 1) / k)[y[~held]].astype(np.float32)[:, None]
    xt, tt = x[~held], truth[~held]
    step = np.float32(4 / max(float((own * xt.sum(axis=1, keepdims=True)).sum()), 1))
    w, b = np.zeros((len(names), k), np.float32), np.zeros(k, np.float32)
    v, vb, last, last_b = w, b, w, b
    for t in range(1, rounds + 1):
        z = xt @ v + vb
        p = np.exp(z - z.max(axis=1, keepdims=True))
        d = own * (p / p.sum(axis=1, keepdims=True) - tt)
        w = v - step * (xt.T @ d)
        w = np.sign(w) * np.maximum(np.abs(w) - step * penalty, 0)
        b = vb - step * d.sum(axis=0)
        v, vb = w + (t - 1) / (t + 2) * (w - last), b + (t - 1) / (t + 2) * (b - last_b)
        last, last_b = w, b
    z = (x[held] @ w + b).astype(np.float64)

    def loss(scale: float) -> float:
        s = z * scale
        s -= s.max(axis=1, keepdims=True)
        return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(s)), y[held]]).mean())

    scale = min(np.geomspace(0.25, 16, 60), key=loss)
    return {f: w[i].astype(float) for f, i in place.items() if np.abs(w[i]).max() > 1e-6}, b.astype(float), float(scale)


def telling(weights: dict[tuple[str, str | None], np.ndarray], bias: np.ndarray, scale: float, least: float, negatives: list[str]) -> set[tuple[str, str | None]]:
    """Features of which a paragraph must have one to be given any family with probability ``least``.

    To reach it, a family's features must outweigh those of ``unknown`` by what the biases differ, and the odds of ``least``. All features
    outside the set together do not. Those that are frequent in other paragraphs for their weight are left out first.
    """
    names = sorted(weights, key=lambda f: (f[0], f[1] or ""))
    if not names:
        return set()
    w = np.array([weights[f] for f in names])
    gain = np.maximum(w[:, :-1] - w[:, -1:], 0)
    need = bias[-1] - bias[:-1] + np.log(least / (1 - least)) / scale
    if (need <= 0).any():
        return set(names)
    seen: dict = {}
    for n in negatives:
        for f in _features(_words(n)):
            seen[f] = seen.get(f, 0) + 1
    order = sorted(range(len(names)), key=lambda i: -seen.get(names[i], 0) / (gain[i].max() + 1e-9))
    room, out = need * 0.999, set()
    for i in order:
        if (gain[i] < room).all() and (seen.get(names[i]) or gain[i].max() == 0):
            room = room - gain[i]
        else:
            out.add(names[i])
    return out


def _sample(docs: DataFrame, id_col: str, text_col: str, sample: int) -> list[str]:
    """Paragraphs of at most ``sample`` documents, 20 of each; of rows with one id, one is taken."""
    ids = docs.select(F.col(id_col).alias("_id")).filter("_id is not null").distinct().orderBy(F.xxhash64("_id"), "_id").limit(sample)
    rows = docs.select(F.col(id_col).alias("_id"), F.slice(F.split(text_col, "\n"), 1, 20).alias("p")).filter("p is not null").join(F.broadcast(ids), "_id")
    one = rows.groupBy("_id").agg(F.min(F.struct(F.xxhash64("p").alias("h"), "p")).alias("x"))
    return [p[:2000] for r in one.orderBy("_id").select("x.p").collect() for p in r.p]


def paragraphs(docs: DataFrame, least: float = 0.6, alike: float = 0.6, sample: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``_k1, _k2, line, family, p, alike, confirmed``: the paragraphs for which a family is predicted."""
    spark = docs.sparkSession
    negatives = _sample(docs, id_col, text_col, sample)
    weights, bias, scale = fit(negatives)
    shapes = [(f, _pairs(_words(t))) for f, ts in TEMPLATES.items() for t in ts]
    needed = telling(weights, bias, scale, least, negatives)
    table: list[tuple] = []
    for f in sorted(set(weights) | set().union(*[s for _, s in shapes]), key=lambda f: (f[0], f[1] or "")):
        table.append((len(table), f[0], f[1], [float(v) for v in weights.get(f, np.zeros(len(FAMILIES)))], [i for i, (_, s) in enumerate(shapes) if f in s], f in needed))
    # a few thousand rows whatever the input: the templates and the bounded examples decide
    features = spark.createDataFrame(table, "f int, w string, n string, weights array<double>, shapes array<int>, needed boolean")

    def with_features(words: DataFrame, which: str) -> DataFrame:
        """Words (w, next word n) with the features they are: f1 of the word, f2 of the pair; rows without any go."""
        own = features.filter(which)
        ones = own.filter("n is null").select(F.col("f").alias("f1"), "w")
        twos = own.filter("n is not null").select(F.col("f").alias("f2"), "w", "n")
        return words.join(F.broadcast(ones), "w", "left").join(F.broadcast(twos), ["w", "n"], "left").filter("f1 is not null or f2 is not null")

    pairs = F.explode(F.arrays_zip(F.col("t").alias("w"), F.slice("t", 2, F.size("t")).alias("n"))).alias("x")
    lines = (docs.filter(F.col(text_col).isNotNull()).select(*row_key([id_col, text_col]), F.posexplode(F.split(text_col, "\n")).alias("line", "t"))
             .select("_k1", "_k2", "line", F.regexp_extract_all(F.lower("t"), F.lit(TOKEN), F.lit(0)).alias("t")).filter("size(t) > 0"))
    near_any = with_features(lines.select("_k1", "_k2", "line", "t", pairs).select("_k1", "_k2", "line", "t", "x.w", "x.n"), "needed")
    few = near_any.select("_k1", "_k2", "line", "t").dropDuplicates(["_k1", "_k2", "line"])
    met = (with_features(few.select("_k1", "_k2", "line", F.size("t").alias("n_words"), pairs).select("_k1", "_k2", "line", "n_words", "x.w", "x.n"), "true")
           .select("_k1", "_k2", "line", "n_words", F.explode(F.array("f1", "f2")).alias("f")).filter("f is not null").distinct())
    k = len(FAMILIES)
    sums = (met.join(F.broadcast(features.select("f", "weights", "shapes")), "f").groupBy("_k1", "_k2", "line", "n_words")
            .agg(*[F.sum(F.col("weights")[i]).alias(f"z{i}") for i in range(k)],
                 *[F.sum(F.array_contains("shapes", i).cast("int")).alias(f"s{i}") for i in range(len(shapes))]))
    z = F.array(*[(F.col(f"z{i}") + float(bias[i])) * scale for i in range(k)])
    scored = sums.withColumn("z", z).withColumn("top", F.array_max("z"))
    scored = scored.withColumn("best", F.array_position("z", F.col("top")).cast("int") - 1).filter(F.col("best") < k - 1)
    scored = scored.withColumn("p", 1 / F.aggregate("z", F.lit(0.0), lambda a, v: a + F.exp(v - F.col("top")))).filter(F.col("p") >= least)
    near = lambda i, s: F.when(F.col(f"s{i}") >= 3, F.greatest(F.col(f"s{i}") / len(s), F.col(f"s{i}") / F.greatest(F.col("n_words") - 1, F.lit(1)))).otherwise(0.0)
    by_family = [F.greatest(F.lit(0.0), F.lit(0.0), *[near(i, s) for i, (g, s) in enumerate(shapes) if g == f]) for f in TEMPLATES]
    return (scored.select("_k1", "_k2", "line", F.array(*[F.lit(f) for f in FAMILIES])[F.col("best")].alias("family"), "p", F.array(*by_family)[F.col("best")].alias("alike"))
            .withColumn("confirmed", F.col("alike") >= alike))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """A row for each row of ``docs``: id, ``families`` (confirmed, sorted, joined by commas), ``n_confirmed, n_unconfirmed`` paragraphs and
    ``first_line`` of the confirmed ones (from 0; null without)."""
    found = paragraphs(docs, id_col=id_col, text_col=text_col, **how)
    of = lambda value: F.when(F.col("confirmed"), value)
    by_doc = found.groupBy("_k1", "_k2").agg(F.array_join(F.array_sort(F.collect_set(of(F.col("family")))), ",").alias("families"), F.count(of(F.lit(1))).alias("n"),
                                             F.count(F.when(~F.col("confirmed"), 1)).alias("m"), F.min(of(F.col("line"))).alias("first_line"))
    return (docs.select(F.col(id_col), *row_key([id_col, text_col])).join(by_doc, ["_k1", "_k2"], "left")
            .select(id_col, F.coalesce("families", F.lit("")).alias("families"), F.coalesce("n", F.lit(0)).alias("n_confirmed"), F.coalesce("m", F.lit(0)).alias("n_unconfirmed"), "first_line"))
