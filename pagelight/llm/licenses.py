"""Licence scan (DataFrame functions only on the main path): a trained paragraph classifier.

A paragraph is a line. Its features are word unigrams and bigrams (ASCII-lower-cased words of letters,
digits, dots, plus and minus signs), present or absent. A sparse logistic regression, one softmax
over the licence families and a class "unknown", is trained on the driver from the notices below and the short forms made of the
licences' names, whole, with words dropped, wrapped into lines, and with prose put around them: a corpus of fixed size.
Probabilities are calibrated by a temperature: of a model that never saw every ``LEFT_OUT``-th template and phrase of the class
"unknown", it is the one that suits those best. Below ``CONFIDENT`` the class is unknown. A family must be confirmed by template
comparison: the share of a template's shingles (three words, or the two of a template of two) that the paragraph has.

A notice may be wrapped over lines. Lines that have a shingle of a family's templates, with at most one line between two
of them, are judged together as a run of that family, and a line that isn't confirmed by itself takes the family of its run,
if the run is confirmed (of several families, the one with the greatest containment).

Lines without an anchor cost one regular expression and get no row. Anchors begin where a word does, which tells most places of a
text apart at their first letter. No stretch of a template without an anchor has
the confirming share of its shingles (`unanchored`, tested), so such a line could only be confirmed by scattered pieces. The weights and templates are
fixed in size and broadcast. Sums are by (document, paragraph), combined map-side.

A null or empty text has no row, an empty table none; repeated rows of a document give repeated results; of families with equal
scores the first of ``FAMILIES`` counts; extra columns are ignored.
"""

from __future__ import annotations

import functools
import random
import re

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagelight.llm.common import COMMON_WORDS, ascii_lower, materialize

CONFIDENT, CONFIRMED = 0.5, 0.6
#: Words of a line in the wrapped notices of the training; lines that may lie between two of a run, and one more.
WRAPPED, REACH = 12, 2
#: Notices by family (fixed texts of the licences' own notices).
TEMPLATES = {
    "apache": [
        "licensed under the apache license version 2.0", "released under the apache license", "spdx-license-identifier apache-2.0", "you may not use this file except in compliance with the license",
        "licensed under the apache license version 2.0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www.apache.org licenses license-2.0",
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
        "see the license for the specific language governing permissions and limitations under the license",
    ],
    "mit": [
        "released under the mit license", "licensed under the mit license", "spdx-license-identifier mit", "permission is hereby granted free of charge to any person obtaining a copy of this software",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
        "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    ],
    "isc": [
        "licensed under the isc license", "released under the isc license", "spdx-license-identifier isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
        "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    ],
    "gpl": [
        "this work is licensed under the gnu general public license version 3", "licensed under the gnu gpl v3", "redistribute it and or modify it under the terms of the gnu general public license", "spdx-license-identifier gpl-3.0-or-later", "spdx-license-identifier gpl-2.0-only",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
        "see the gnu general public license for more details", "you should have received a copy of the gnu general public license along with this program",
    ],
    "lgpl": [
        "licensed under the gnu lesser general public license version 3", "licensed under the gnu lgpl v3", "redistribute it and or modify it under the terms of the gnu lesser general public license", "spdx-license-identifier lgpl-3.0-or-later",
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2.1 of the license or at your option any later version",
        "see the gnu lesser general public license for more details", "you should have received a copy of the gnu lesser general public license along with this library",
    ],
    "agpl": [
        "licensed under the gnu affero general public license version 3", "licensed under the gnu agpl v3", "redistribute it and or modify it under the terms of the gnu affero general public license", "spdx-license-identifier agpl-3.0-or-later",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
        "see the gnu affero general public license for more details", "you should have received a copy of the gnu affero general public license along with this program",
    ],
    "bsd": [
        "licensed under the bsd 3-clause license", "released under the bsd license", "spdx-license-identifier bsd-3-clause", "redistribution and use in source and binary forms with or without modification are permitted",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
        "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    ],
    "mpl": [
        "subject to the terms of the mozilla public license v. 2.0", "licensed under the mozilla public license 2.0", "spdx-license-identifier mpl-2.0",
        "this source code form is subject to the terms of the mozilla public license v. 2.0 if a copy of the mpl was not distributed with this file you can obtain one at https mozilla.org mpl 2.0",
    ],
    "epl": [
        "licensed under the eclipse public license version 2.0", "spdx-license-identifier epl-2.0",
        "this program and the accompanying materials are made available under the terms of the eclipse public license 2.0 which is available at https www.eclipse.org legal epl-2.0",
    ],
    "boost": ["distributed under the boost software license version 1.0", "spdx-license-identifier bsl-1.0"],
    "zlib": [
        "licensed under the zlib license", "spdx-license-identifier zlib",
        "this software is provided as-is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software",
        "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    ],
    "unlicense": [
        "this is free and unencumbered software released into the public domain", "spdx-license-identifier unlicense", "released under the unlicense",
        "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non-commercial and by any means",
    ],
    "cc-by": ["licensed under cc by 4.0", "licensed under a creative commons attribution 4.0 international license"],
    "cc-by-sa": ["licensed under cc by-sa 4.0", "licensed under a creative commons attribution-sharealike 4.0 international license"],
    "cc-by-nd": ["licensed under cc by-nd 4.0", "licensed under a creative commons attribution-noderivatives 4.0 international license"],
    "cc-by-nc": ["licensed under cc by-nc 4.0", "licensed under a creative commons attribution-noncommercial 4.0 international license"],
    "cc-by-nc-sa": ["licensed under cc by-nc-sa 4.0", "licensed under a creative commons attribution-noncommercial-sharealike 4.0 international license"],
    "cc0": ["dedicated to the public domain under cc0 1.0", "spdx-license-identifier cc0-1.0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"],
    "proprietary": ["all rights reserved", "all rights reserved no part of this work may be reproduced without permission"],
}
#: Names of the licences (fixed values: identifiers, titles and what they are called by), of which `short_forms` makes notices.
NAMES = {
    "apache": ["apache-2.0", "apache 2.0", "apache"],
    "mit": ["mit", "mit-0", "mit-style", "expat"],
    "isc": ["isc"],
    "gpl": ["gpl", "gplv2", "gplv3", "gpl v2", "gpl v3", "gpl-2.0", "gpl-3.0", "gpl-2.0-only", "gpl-3.0-only", "gpl-2.0-or-later", "gpl-3.0-or-later", "gnu gpl"],
    "lgpl": ["lgpl", "lgplv2.1", "lgplv3", "lgpl v3", "lgpl-2.1", "lgpl-3.0", "lgpl-2.1-only", "lgpl-3.0-only", "lgpl-2.1-or-later", "lgpl-3.0-or-later", "gnu lgpl"],
    "agpl": ["agpl", "agplv3", "agpl v3", "agpl-3.0", "agpl-3.0-only", "agpl-3.0-or-later", "gnu agpl"],
    "bsd": ["bsd", "bsd-2-clause", "bsd-3-clause", "bsd 2-clause", "bsd 3-clause", "2-clause bsd", "3-clause bsd", "bsd-style"],
    "mpl": ["mpl", "mpl 2.0", "mpl-2.0", "mozilla public"],
    "epl": ["epl", "epl-1.0", "epl-2.0", "eclipse public"],
    "boost": ["bsl-1.0", "boost software", "boost"],
    "zlib": ["zlib"],
    "unlicense": ["unlicense"],
    "cc-by": ["cc-by", "cc-by-4.0", "cc by 4.0", "cc-by-3.0"],
    "cc-by-sa": ["cc-by-sa", "cc-by-sa-4.0", "cc by-sa 4.0", "cc-by-sa-3.0"],
    "cc-by-nd": ["cc-by-nd", "cc-by-nd-4.0", "cc by-nd 4.0"],
    "cc-by-nc": ["cc-by-nc", "cc-by-nc-4.0", "cc by-nc 4.0"],
    "cc-by-nc-sa": ["cc-by-nc-sa", "cc-by-nc-sa-4.0", "cc by-nc-sa 4.0"],
    "cc0": ["cc0", "cc0-1.0", "cc0 1.0"],
    "proprietary": ["proprietary"],
}
#: Titles of the licences' whole texts, as their first lines have them.
TITLES = {
    "apache": ["apache license version 2.0 january 2004", "apache license version 2.0"], "mit": ["the mit license"], "gpl": ["gnu general public license version 2 june 1991", "gnu general public license version 3 29 june 2007"],
    "lgpl": ["gnu lesser general public license version 2.1 february 1999", "gnu lesser general public license version 3 29 june 2007"], "agpl": ["gnu affero general public license version 3 19 november 2007"],
    "mpl": ["mozilla public license version 2.0"], "epl": ["eclipse public license v 2.0"], "boost": ["boost software license version 1.0 august 17th 2003"],
    "cc-by": ["creative commons attribution 4.0 international"], "cc-by-sa": ["creative commons attribution-sharealike 4.0 international"], "cc-by-nd": ["creative commons attribution-noderivatives 4.0 international"],
    "cc-by-nc": ["creative commons attribution-noncommercial 4.0 international"], "cc-by-nc-sa": ["creative commons attribution-noncommercial-sharealike 4.0 international"], "cc0": ["creative commons cc0 1.0 universal"],
}
FAMILIES = [*TEMPLATES, "unknown"]
#: Every how many templates one is left out for the calibration.
LEFT_OUT = 4
ANCHOR = (
    r"(?i)(?<![a-z])(?:licen[sc]|unlicen|sublicen|copyright|spdx|permission|permitted|distribut|redistribut|reserved|domain|creative|commons|software|warrant|liab|cc(?![a-z])|gnu|the (?:mit|boost)(?![a-z])|[al]?gpl|[me]pl(?![a-z])|bsl(?![a-z])|zlib|expat(?![a-z])|proprietary|apache|isc(?![a-z])"
    r"|bsd|mozilla|eclipse|binary|derived|conditions|compliance|except|obtain|reproduc|the (?:above|terms))"
)
_DISTRACT = [
    "the license plate of the car", "a driving license is required", "copyright law in history", "ask for permission before you go", "redistribution of wealth", "she has a poetic licence", "license fees went up",
    "the software of the phone is old", "weather conditions were bad", "under no warranty the repair is not free", "a creative idea", "she was liable for the damages", "see the terms of the sale",
    "smoking is not permitted here", "the table is reserved for all of us", "sie kam mit der bahn und mit dem hund", "the mit students won the prize", "an apache helicopter flew over the town",
    "the eclipse of the sun was seen at noon", "a gnu is a large animal of the plain", "the public domain is a debate of law", "the general public was not let in", "a fishing licence is sold at the shop",
    "he lost his license to sell wine", "the distribution of water is free of charge", "all seats are reserved for the guests", "the license of the bar was not renewed",
]


def short_forms(family: str) -> list[str]:
    """Notices that only name a licence, by rule from its names, and its titles."""
    each = [f"{a}{n}{b}" for n in NAMES[family] for a, b in (("license ", ""), ("", " license"), ("spdx-license-identifier ", ""), ("licensed under ", ""), ("licensed under the ", ""), ("released under the ", " license"), ("under the terms of the ", ""))]
    return list(dict.fromkeys(each + TITLES.get(family, [])))


def words_of(text: str) -> list[str]:
    return [w.strip(".-+") for w in re.findall(r"[a-z0-9.+-]+", text.lower()) if w.strip(".-+")]


def features_of(words: list[str]) -> set[str]:
    return {*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))}


def unanchored(template: str) -> float:
    """The largest share of a template's shingles in a stretch of it without an anchor word."""
    w = words_of(template)
    size = min(3, len(w))
    free = [j - i for i in range(len(w)) for j in range(i + size, len(w) + 1) if not re.search(ANCHOR, " ".join(w[i:j]))]
    return (max(free, default=size - 1) - size + 1) / (len(w) - size + 1)


def _corpus(seed: int, per_template: int, per_short: int) -> list[tuple[list[str], int, bool]]:
    """(words, class, of what is left out for the calibration) of the training's paragraphs."""
    rng = random.Random(seed)
    prose = lambda n: rng.choices(COMMON_WORDS, k=n)
    rows = []
    for family, texts in TEMPLATES.items():
        whole = [(t, per_template) for t in texts] + [(t, per_short) for t in short_forms(family)]
        for k, (t, copies) in enumerate(whole):
            for i in range(copies):
                w = [x for x in words_of(t) if len(t) < 60 or rng.random() > 0.06] if i else words_of(t)
                if i % 2 and len(w) > WRAPPED:  # a line of a wrapped notice
                    at = rng.randrange(len(w) - WRAPPED + 1)
                    w = w[at : at + WRAPPED]
                rows.append((prose(rng.choice([0, 0, 3, 8])) + w + prose(rng.choice([0, 0, 3, 8])), FAMILIES.index(family), k % LEFT_OUT == LEFT_OUT - 1))
    for i in range(per_template * 20):
        k = rng.randrange(len(_DISTRACT))
        rows.append((prose(rng.randint(3, 20)) + (words_of(_DISTRACT[k]) if i % 2 else []) + prose(rng.randint(0, 10)), len(FAMILIES) - 1, k % LEFT_OUT == LEFT_OUT - 1))
    return rows


def soft(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _fit(x: np.ndarray, y: np.ndarray, rounds: int, rate: float = 1.0, sparse: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """(weights, intercepts) of the regression by proximal gradient steps with momentum."""
    w, b = np.zeros((x.shape[1], y.shape[1]), np.float32), np.zeros(y.shape[1], np.float32)
    last, back = w, np.ascontiguousarray(x.T)
    for i in range(rounds):
        ahead = w + (i / (i + 3)) * (w - last)
        g = (soft(x @ ahead + b) - y) / np.float32(len(y))
        last, step = w, ahead - rate * (back @ g)
        w = np.sign(step) * np.maximum(np.abs(step) - np.float32(rate * sparse), 0)
        b = b - rate * g.sum(axis=0)
    return w, b


def prepared(seed: int = 5, per_template: int = 40, per_short: int = 4) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """(features, present or absent by paragraph, class by paragraph, left out)."""
    rows = _corpus(seed, per_template, per_short)
    texts = [t for family, own in TEMPLATES.items() for t in own + short_forms(family)] + _DISTRACT
    names = sorted({f for t in texts for f in features_of(words_of(t))} | set(COMMON_WORDS))
    at = {f: i for i, f in enumerate(names)}
    x = np.zeros((len(rows), len(names)), np.float32)
    for r, (w, _, _) in enumerate(rows):
        x[r, [at[f] for f in features_of(w) if f in at]] = 1
    return names, x, np.eye(len(FAMILIES), dtype=np.float32)[[c for _, c, _ in rows]], np.array([o for *_, o in rows])


def left_out(rounds: int = 150) -> tuple[np.ndarray, np.ndarray]:
    """(logits, classes) of the paragraphs left out, by a model that saw none of their templates."""
    _, x, y, out = prepared()
    w, b = _fit(x[~out], y[~out], rounds)
    return x[out] @ w + b, y[out]


def heat_of(z: np.ndarray, y: np.ndarray) -> float:
    """The temperature of the least log loss."""
    return min((0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0), key=lambda t: -np.log(soft(z / t)[y > 0] + 1e-12).mean())


@functools.cache
def train(rounds: int = 150) -> tuple[dict[str, list[float]], list[float]]:
    """(weights by feature, intercepts), already divided by the calibration temperature."""
    heat = heat_of(*left_out(rounds))
    names, x, y, _ = prepared()
    w, b = _fit(x, y, rounds)
    return {f: (w[i] / heat).round(6).tolist() for i, f in enumerate(names) if np.abs(w[i]).max() > 0}, (b / heat).round(6).tolist()


def _table(spark, rows: list[tuple[str, str]], names: list[str]) -> DataFrame:
    """A small table of strings from a literal."""
    packed = F.lit("\n".join("\t".join(r) for r in rows))
    return spark.range(1).select(F.explode(F.split(packed, "\n")).alias("r")).select(*[F.split("r", "\t")[i].alias(n) for i, n in enumerate(names)])


def _template_rows() -> list[tuple[str, str, str, str]]:
    """(shingle, family, number, shingles of the template) of all templates."""
    rows = []
    for family, texts in TEMPLATES.items():
        for t in dict.fromkeys(texts + short_forms(family)):
            w = words_of(t)
            size = min(3, len(w))
            s = sorted({" ".join(w[i : i + size]) for i in range(len(w) - size + 1)})
            rows += [(x, family, t, str(len(s))) for x in s]
    return rows


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", confident: float = CONFIDENT, confirmed: float = CONFIRMED) -> DataFrame:
    """(id_col, paragraph, family, probability, containment): paragraphs with an anchor word; paragraph counts from 0."""
    spark = docs.sparkSession
    weights, bias = train()
    lines = docs.where(F.col(text_col).rlike(ANCHOR)).select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_t"), F.monotonically_increasing_id().alias("_row")).select("_id", "_row", F.posexplode(F.split("_t", "\n")).alias("paragraph", "_line"))
    plain = F.filter(F.transform(F.regexp_extract_all(ascii_lower(F.col("_line")), F.lit(r"[a-z0-9.+-]+"), 0), lambda w: F.regexp_replace(w, r"^[.+-]+|[.+-]+$", "")), lambda w: w != "")
    lines = lines.where(F.col("_line").rlike(ANCHOR)).select("_id", "_row", "paragraph", plain.alias("_w"))
    lines = materialize(lines, "license-lines")  # row numbers must be those of one scan
    grams = lambda n: f"if(size(_w) >= {n}, transform(sequence(1, size(_w) - {n - 1}), i -> array_join(slice(_w, i, {n}), ' ')), cast(array() as array<string>))"
    score_table = F.broadcast(_table(spark, [(f, ",".join(map(str, w))) for f, w in sorted(weights.items())], ["feature", "_ws"]).select("feature", F.transform(F.split("_ws", ","), lambda v: v.cast("double")).alias("_ws")))
    n = len(FAMILIES)
    templates = F.broadcast(_table(spark, _template_rows(), ["shingle", "_of", "_tn", "_size"]))
    names = F.array(*[F.lit(f) for f in FAMILIES])

    def held(units: DataFrame, key: list[str]) -> DataFrame:
        """(key, _of, containment) of the families that a unit has shingles of."""
        found = units.select(*key, F.explode(F.expr(f"array_distinct(concat(_w, {grams(2)}, {grams(3)}))")).alias("shingle")).join(templates, "shingle")
        each = found.groupBy(*key, "_of", "_tn").agg((F.count("*") / F.first(F.col("_size").cast("int"))).alias("_c"))
        return each.groupBy(*key, "_of").agg(F.max("_c").alias("containment"))

    def judged(units: DataFrame, key: list[str], shared: DataFrame) -> DataFrame:
        """(key, _id, _of, probability, containment, _sure): the classifier's family of each unit."""
        exploded = units.select("_id", *key, F.explode_outer(F.expr(f"array_distinct(concat(_w, {grams(2)}))")).alias("feature")).join(score_table, "feature", "left")
        sums = exploded.groupBy(*key).agg(F.first("_id").alias("_id"), *[F.coalesce(F.sum(F.round(F.col("_ws")[i] * 1_000_000).cast("long")), F.lit(0)).alias(f"_z{i}") for i in range(n)])
        z = F.array(*[F.col(f"_z{i}") / 1_000_000 + float(bias[i]) for i in range(n)])
        probs = sums.select("_id", *key, z.alias("_z")).withColumn("_top", F.array_max("_z"))
        probs = probs.withColumn("probability", F.lit(1.0) / F.aggregate("_z", F.lit(0.0), lambda a, v: a + F.exp(v - F.col("_top"))))
        probs = probs.withColumn("_of", F.element_at(names, F.array_position("_z", F.col("_top")).cast("int"))).drop("_z", "_top")
        out = probs.join(shared, [*key, "_of"], "left").withColumn("containment", F.coalesce("containment", F.lit(0.0)))
        return out.withColumn("_sure", (F.col("_of") != "unknown") & (F.col("probability") >= confident) & (F.col("containment") >= confirmed))

    # runs of each family, named by their first line
    shared = materialize(held(lines, ["_row", "paragraph"]), "license-shingles")
    order = Window.partitionBy("_row", "_of").orderBy("paragraph")
    starts = F.when(F.col("paragraph") - F.lag("paragraph", 1, -REACH - 1).over(order) > REACH, F.col("paragraph"))
    member = shared.select("_row", "paragraph", "_of", F.max(starts).over(order).alias("_run"))
    runs = member.join(lines, ["_row", "paragraph"]).groupBy("_row", F.col("_of").alias("_family"), "_run")
    runs = runs.agg(F.first("_id").alias("_id"), F.array_sort(F.collect_list(F.struct("paragraph", "_w"))).alias("_p")).where(F.size("_p") > 1)
    runs = materialize(runs.select("_id", "_row", "_family", "_run", F.flatten("_p._w").alias("_w")), "license-runs")
    key = ["_row", "_family", "_run"]
    whole = judged(runs, key, held(runs, key)).where(F.col("_sure") & (F.col("_of") == F.col("_family"))).drop("_family", "_id", "_sure")
    best = member.join(whole, ["_row", "_of", "_run"]).groupBy("_row", "paragraph").agg(F.max(F.struct("containment", "probability", "_of")).alias("_best"))
    out = judged(lines, ["_row", "paragraph"], shared).join(best, ["_row", "paragraph"], "left")
    wrapped = ~F.col("_sure") & F.col("_best").isNotNull()
    family = F.when(F.col("_sure"), F.col("_of")).when(wrapped, F.col("_best._of")).otherwise("unknown")
    pick = lambda name: F.when(wrapped, F.col("_best")[name]).otherwise(F.col(name)).alias(name)
    return out.select(F.col("_id").alias(id_col), F.col("paragraph").cast("int").alias("paragraph"), family.alias("family"), pick("probability"), pick("containment"))
