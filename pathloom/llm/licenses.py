"""License scans: MinHash bands over overlapping windows retrieve templates, exact containment verifies them.

Templates and documents are sequences of five-word shingles. Both are cut into windows of the same few
lengths, a template into windows at every place, a document into windows at every few places; a template uses the greatest
length with which any whole copy of it must hold a document window that is one of its own. Each window has one band
per hash function (one row per band, each with hashes of its own seed), so equal windows always collide and windows of
similarity J collide with the chance 1 - (1 - J)^bands: 0.998 at 0.8 with four bands. A bitmap of the templates' keys, a
literal, passes few of a document's windows on; each takes along only the shingles around it, so work grows with a text's
length and no faster. Hits are verified on those shingles. DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathloom.llm.common import texts
from pathloom.llm.private import let

# Public licence notices, as their authors word them.
TEMPLATES = {
    "mit-notice": "Released under the MIT License.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
        to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
        whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission
        notice shall be included in all copies or substantial portions of the Software.""",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
        provided that the above copyright notice and this permission notice appear in all copies.""",
    "bsd-2-clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and
        the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and
        the following disclaimer in the documentation and/or other materials provided with the distribution.""",
    "apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with
        the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law
        or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR
        CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and
        limitations under the License.""",
    "gpl-3.0": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License
        as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This
        program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
        MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
}

WORDS = 5
#: Window length and step, in shingles.
WINDOWS = ((1, 1), (4, 2), (16, 4))
SEEDS = (0x2545F4914F6CDD1D, 0x5851F42D4C957F2D, 0x14057B7EF767814F, 0x369DEA0F31A53F85)
BROADCAST_KEYS = 200_000


def shingles(text: Column) -> Column:
    """Hashes of the five-word shingles in order; words are runs of letters, digits and underscores in lower case."""
    words = F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}_]+"), "")
    return let(words, lambda w: F.when(F.size(w) >= WORDS, F.transform(F.sequence(F.lit(0), F.size(w) - WORDS), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(WORDS))))).otherwise(F.expr("cast(array() AS array<bigint>)")))


def bands(hashes: Column) -> Column:
    """The least hash of each window of a document: for each kind of window, one hash function after the other.

    Windows at the end are shorter. A window of one shingle has one band, its hash; windows of sixteen are put together
    from those of four.
    """

    def least(values: Column, step: int, apart: int) -> Column:
        places = F.when(F.size(values) > 0, F.sequence(F.lit(0), F.size(values) - 1, F.lit(step))).otherwise(F.expr("cast(array() AS array<int>)"))
        return F.transform(places, lambda i: F.least(*(F.get(values, i + k * apart) for k in range(4))))

    fours = F.transform(F.array(*(_permuted(hashes, seed) for seed in SEEDS)), lambda h: least(h, 2, 1))
    return let(fours, lambda w: F.concat(hashes, F.flatten(w), F.flatten(F.transform(w, lambda v: least(v, 2, 2)))))


def _permuted(hashes: Column, seed: int) -> Column:
    return F.transform(hashes, lambda x: F.xxhash64(F.lit(seed), x))


def template_keys(spark: SparkSession, templates: dict[str, str]) -> DataFrame:
    """license, kind (of window), wanted (its distinct shingles), key: one row for each band of each window."""
    known = spark.createDataFrame(sorted(templates.items()), T.StructType([T.StructField("license", T.StringType()), T.StructField("text", T.StringType())]))
    known = known.select("license", shingles(F.col("text")).alias("hashes")).where(F.size("hashes") > 0)
    parts = []
    for kind, (length, step) in enumerate(WINDOWS):
        above = WINDOWS[kind + 1] if kind + 1 < len(WINDOWS) else None
        fits = F.size("hashes") >= length + step - 1
        if above:
            fits &= F.size("hashes") < above[0] + above[1] - 1
        keys = F.col("hashes") if length == 1 else F.concat(*(_template_bands(length, seed) for seed in SEEDS))
        parts.append(known.where(fits).select("license", F.lit(kind).alias("kind"), F.array_distinct("hashes").alias("wanted"), F.explode(keys).alias("key")))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found.distinct()


def _template_bands(length: int, seed: int) -> Column:
    return let(_permuted(F.col("hashes"), seed), lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - length), lambda i: F.array_min(F.slice(h, i + 1, F.lit(length)))))


def scan(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, license, containment: the templates of which a passage of the text holds ``threshold`` or more of the shingles.

    The containment is that of the best passage, which reaches a template's length to either side of a hit.
    Null and empty texts, and those of fewer than five words, hold none. Rows that repeat an id are one document. Templates of
    fewer than five words are never found. An empty table gives no rows.
    """
    keys = template_keys(docs.sparkSession, TEMPLATES if templates is None else templates)
    marked, longest = bitmap([r["key"] for r in keys.select("key").distinct().collect()]), keys.agg(F.max(F.size("wanted"))).first()[0] or 0
    if keys.count() <= BROADCAST_KEYS:
        keys = F.broadcast(keys)
    hashed = texts(docs, id_col, text_col).select("doc_id", shingles(F.col("text")).alias("hashes"))
    hits = hashed.select("doc_id", F.explode(candidates(F.col("hashes"), marked, longest)).alias("at")).select("doc_id", "at.*").join(keys, "key")
    m = F.size("wanted")
    # The window stands at ``before`` in ``near``; the template's length to either side of it counts.
    low = F.greatest(F.col("before") - m, F.lit(0))
    near = F.slice("near", low + 1, F.col("before") - low + m + WINDOWS[-1][0])
    held = hits.select("doc_id", "license", (F.size(F.array_intersect("wanted", near)) / m).alias("containment"))
    return held.where(F.col("containment") >= threshold).groupBy("doc_id", "license").agg(F.max("containment").alias("containment"))


def bitmap(keys: list[int], spread: int = 256) -> tuple[Column, int]:
    """Bits of the keys (those of the templates, which came from the driver), ``spread`` or more for each, in words of 64; and how many words."""
    words = 1
    while 64 * words < spread * len(keys):
        words *= 2
    bits = [0] * words
    for key in keys:
        bits[(key >> 6) & (words - 1)] |= 1 << (key & 63)
    signed = ",".join(str(b - (1 << 64) if b >> 63 else b) for b in bits)
    return F.split(F.lit(signed), ",").cast("array<bigint>"), words


def candidates(hashes: Column, marked: tuple[Column, int], longest: int) -> Column:
    """key, near (the shingles around) and before (how many of them stand before the window) of the windows whose key has its bit set.

    A key may be looked up at a kind of window that it does not belong to: a chance match, which is verified like any other.
    """
    bits, words = marked

    def isset(key: Column) -> Column:
        word = F.get(bits, F.shiftright(key, 6).bitwiseAND(words - 1).cast("int"))
        return F.call_function("shiftright", word, key.bitwiseAND(63).cast("int")).bitwiseAND(1) == 1

    def start(place: Column, n: Column) -> Column:
        found, before = F.lit(0), F.lit(0)
        for length, step in WINDOWS:
            count = F.ceil(n / step).cast("int")
            found = F.when(place >= before, (place - before) % count * step).otherwise(found)
            before = before + count * (1 if length == 1 else len(SEEDS))
        return found

    def around(h: Column) -> Column:
        passed = F.filter(F.transform(bands(h), lambda key, place: F.when(isset(key), F.struct(key.alias("key"), place.alias("place")))), lambda x: x.isNotNull())
        return F.transform(passed, lambda x: let(start(x["place"], F.size(h)), lambda at: let(F.greatest(at - longest, F.lit(0)), lambda low: F.struct(
            x["key"].alias("key"), F.slice(h, low + 1, at - low + longest + WINDOWS[-1][0]).alias("near"), (at - low).alias("before")))))

    return let(hashes, around)


def oracle() -> str:
    """The same by brute force over whole documents."""
    rows = ", ".join("('{}', '{}')".format(name, text.replace("'", "''")) for name, text in sorted(TEMPLATES.items()))
    words = r"list_filter(regexp_split_to_array(lower({}), '[^\p{{L}}\p{{N}}_]+'), lambda x: x <> '')"
    return f"""
    WITH t AS (SELECT name, {words.format('body')} AS w FROM (VALUES {rows}) v(name, body)),
    ts AS (SELECT DISTINCT name, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT name, w, unnest(range(1, len(w) - 3)) AS i FROM t)),
    d AS (SELECT doc_id, {words.format("coalesce(text, '')")} AS w FROM documents),
    ds AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
    n AS (SELECT name, count(*) AS m FROM ts GROUP BY name)
    SELECT doc_id, name AS license, CAST(count(*) AS DOUBLE) / m AS containment
    FROM ds JOIN ts USING (s) JOIN n USING (name) GROUP BY doc_id, name, m HAVING CAST(count(*) AS DOUBLE) / m >= 0.8
    """
