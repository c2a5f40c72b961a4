"""License scans by diagonal voting.

Every rolling k-gram of words of every document is hashed and joined with
the positions of the same k-gram in the license templates.  A match at word
``i`` of a document and word ``j`` of a template is a vote for the diagonal
``i - j``.  Votes are summed by diagonal, and neighbouring diagonals of one
template (words inserted or left out) are merged.  A merged span is verified in
words, not hashes: its score is the template's words that stand in it, in runs
of k or more, as a share of the template's words and the span's other words,
so what is inserted or replaced counts against it; words on which the license
depends must all be there.  Where spans overlap, that with the best score
stays (then the one with more words): a sharealike notice is not a notice of
the license without it.  Base phrases always stay.

The template side is a constant of this module (``TEMPLATES``, some hundred
rows, whatever the corpus), so it is broadcast and the documents are read in
one pass without moving their texts: what is shuffled is one row for each
document and one for each diagonal with a vote.  Groups are single documents,
so no license, source or line that is frequent in the corpus makes a hot key.

Defined results: a null or empty text has no words, no spans and score 0;
null identifiers are a group like any other; rows are told apart by (id,
text), and rows equal in both give equal result rows, one each; templates that
tie in score and words go by place, then label; extra columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import ascii_lower, pick, read

K = 3
#: Java character class of what is no word character (words are runs of the rest).
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    #: Least score of a verified span; short notices must stand word for word.
    share: float | None = None
    #: A base phrase: it must stand whole, on one diagonal.
    phrase: bool = False
    #: Words of the template that must all stand in the span, wherever it has them.
    required: str = ""

    @property
    def least(self) -> float:
        return self.share if self.share is not None else 0.95 if len(template_words(self.text)) < 20 else 0.7


# The base phrases, and the wording of public licenses and notices.
TEMPLATES = (
    Template("mit", "under the mit license", 1.0, True),
    Template("apache-2", "apache license version 2", 1.0, True),
    Template("cc-by-nc", "cc by nc", 1.0, True),
    Template("gpl", "licensed under the gnu general public license"),
    Template("lgpl", "licensed under the gnu lesser general public license"),
    Template("agpl", "licensed under the gnu affero general public license"),
    Template("bsd", "licensed under the bsd license"),
    Template("mpl-2", "subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at", required="v 2 0"),
    Template("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    Template("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license"),
    Template("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license"),
    Template("cc-by-nd", "licensed under a creative commons attribution noderivatives 4 0 international license"),
    Template("cc-by-nc-sa", "licensed under a creative commons attribution noncommercial sharealike 4 0 international license"),
    Template("cc-by-nc-nd", "licensed under a creative commons attribution noncommercial noderivatives 4 0 international license"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    Template("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", required="2 0"),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", required="general public"),
    Template("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", required="lesser"),
    Template("agpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation", required="affero"),
    Template("unlicense", "this is free and unencumbered software released into the public domain"),
)


def template_words(text: str) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())


def template_positions(spark: SparkSession, templates: tuple[Template, ...] = TEMPLATES, k: int = K) -> DataFrame:
    """One row for each k-gram position of each template: a table of constants."""
    rows = []
    for t, x in enumerate(templates):
        w = template_words(x.text)
        if len(w) < k:
            raise ValueError(f"template {x.text!r} has fewer than {k} words")
        needed = [j for j, word in enumerate(w) if word in x.required.split()]
        rows += [(t, j, w[j : j + k], len(w), x.label, x.least, x.phrase, needed) for j in range(len(w) - k + 1)]
    df = spark.createDataFrame(rows, "t int, j int, gram array<string>, size int, label string, share double, phrase boolean, needed array<int>")
    return df.withColumn("g", F.xxhash64(*[F.col("gram")[i] for i in range(k)]))


def _best(spans: Column) -> Column:
    """Of spans that overlap the best, taken in order of score, words, place and label; phrases all stay."""
    order = lambda x, y: F.when(x < y, -1).when(y < x, 1).otherwise(0)
    rank = lambda x: F.struct(-x["score"], -x["found"], x["first"], x["label"])
    others = F.array_sort(F.filter(spans, lambda x: ~x["phrase"]), lambda x, y: order(rank(x), rank(y)))
    none = F.filter(spans, lambda x: F.lit(False))
    free = lambda kept, x: ~F.exists(kept, lambda y: (x["first"] <= y["last"]) & (y["first"] <= x["last"]))
    kept = F.aggregate(others, none, lambda kept, x: F.when(free(kept, x), F.concat(kept, F.array(x))).otherwise(kept))
    return F.concat(F.filter(spans, lambda x: x["phrase"]), kept)


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, k: int = K, reach: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Verified spans of every document, in one array.

    Returns one row per row of ``docs``: the id, ``n_words`` and ``spans``,
    an array of (label, first, last, score, found, phrase), where first and
    last are the first and last words (from 0) that match the template, and
    found is how many of the template's words do.  ``reach`` is how far apart
    neighbouring diagonals of one span may be; a phrase's diagonals are never
    merged.
    """
    raw = F.coalesce(F.col("text").cast("string"), F.lit(""))
    d = pick(docs, id=doc_id, text=text).select("id", F.xxhash64(raw).alias("th"), F.array_remove(F.split(ascii_lower(raw), GAP), "").alias("w"))
    # position -1 stands for the document itself, so that none is lost
    grams = d.select("id", "th", "w", F.posexplode_outer(F.concat(F.array(F.lit("")), "w")).alias("p", "w0"))
    grams = grams.select("id", "th", F.size("w").alias("n_words"), (F.col("p") - 1).alias("i"), "w0", *[F.get("w", F.col("p") + (x - 1)).alias(f"w{x}") for x in range(1, k)])
    whole = (F.col("i") >= 0) & (F.col("i") + (k - 1) < F.col("n_words"))
    grams = grams.withColumn("g", F.when(whole, F.xxhash64(*[f"w{x}" for x in range(k)])))
    pos = template_positions(docs.sparkSession, templates, k)
    same = [grams["g"] == pos["g"], *[grams[f"w{x}"] == pos["gram"][x] for x in range(k)]]
    hits = grams.join(F.broadcast(pos), same, "left").where(F.col("t").isNotNull() | (F.col("i") == -1))
    about = ["t", "label", "share", "phrase", "size", "needed"]
    # everything below is by document: one exchange serves it all
    by = ["id", "th", "n_words"]
    hits = hits.select(*by, "i", "j", *about)
    votes = hits.repartition("id", "th").groupBy(*by, *about, (F.col("i") - F.col("j")).alias("diagonal")).agg(F.count(F.lit(1)).alias("n"), F.collect_set("j").alias("js"))
    order = Window.partitionBy(*by, *about).orderBy("diagonal")
    apart = F.col("phrase") | (F.col("diagonal") - F.lag("diagonal").over(order) > reach)
    votes = votes.withColumn("apart", F.coalesce(apart, F.lit(True)).cast("int")).withColumn("span", F.sum("apart").over(order))
    spans = votes.groupBy(*by, *about, "span").agg(F.sum("n").alias("n"), F.collect_list(F.struct("diagonal", "js")).alias("runs"))
    # the words that the span's k-grams cover, by their places in the template and in the text
    covered = lambda shift: F.array_distinct(F.flatten(F.flatten(F.transform("runs", lambda r: F.transform(r["js"], lambda j: F.sequence(j + shift(r), j + shift(r) + (k - 1)))))))
    spans = spans.withColumn("here", covered(lambda r: F.lit(0))).withColumn("there", covered(lambda r: r["diagonal"]))
    first, last = F.array_min("there"), F.array_max("there")
    others = last - first + 1 - F.size("there")
    score = F.size("here") / (F.col("size") + others)
    verified = (score >= F.col("share")) & (F.size(F.array_except("needed", "here")) == 0)
    kept = F.when(verified, F.struct("label", first.alias("first"), last.alias("last"), score.alias("score"), F.size("here").alias("found"), "phrase"))
    out = spans.groupBy(*by).agg(F.max(F.when(F.col("t").isNull(), F.col("n"))).alias("copies"), F.sort_array(F.collect_list(kept)).alias("spans"))
    one_each = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))
    return out.select(F.col("id").alias(doc_id), F.col("n_words").cast("long").alias("n_words"), _best(F.col("spans")).alias("spans"), one_each.alias("copy")).drop("copy")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base phrases and licenses of every row of ``documents``."""
    df = scan(read(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda x: x["phrase"])
    starts = F.transform(base, lambda x: x["first"])
    names = lambda a: F.array_join(F.array_sort(F.array_distinct(F.transform(a, lambda x: x["label"]))), ",")
    return df.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        names(base).alias("base_labels"),
        names(F.col("spans")).alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda x: x["score"])), F.lit(0.0)).alias("score"),
    )
