"""License texts by exact set-similarity join, and license phrases by their words.

Blocks are short lines of a text and, across its line breaks, windows of its paragraphs; templates are short license
notices; both are sets of words. Windows have up to twice as many words as a template and overlap by half, so that no notice
is cut and no words are gathered from afar. A block holds a template if it has at least the given share of the template's
words, whichever they are. With words in the order of their document frequency, a block that does must share one of the
template's rarest words (prefix), have enough words (length) and have enough of them after the first shared one
(position); what passes is counted in full. Whether a block also has all words that tell variants apart, and none that
tells of another variant, is said of each match but decides none. DataFrame functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgrain.llm.common import written

SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases and their labels.
PHRASES = {("cc", "by"): "cc-by", ("general", "public", "license"): "gpl", ("all", "rights", "reserved"): "reserved"}
#: Notices by which licenses are known.
TEMPLATES = {
    "apache-2.0": ("licensed under the apache license version 2 0",),
    "bsd": ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",),
    "cc-by-nc-4.0": ("licensed under cc by nc 4 0", "licensed under a creative commons attribution noncommercial 4 0 international license"),
    "cc-by-4.0": ("licensed under a creative commons attribution 4 0 international license",),
    "cc0": ("to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",),
    "gpl-3.0": ("this work is licensed under the gnu general public license version 3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    "mit": ("released under the mit license", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    "mpl-2.0": ("this source code form is subject to the terms of the mozilla public license v 2 0",),
}
#: Words that tell a template from others, and words that, next to one of a template's, tell of another.
TELLING = {"2", "3", "4", "apache", "attribution", "cc", "gnu", "mit", "mozilla", "nc", "noncommercial"}
OTHERS = {"gnu": {"affero", "lesser"}, "cc": {"nc", "nd", "sa"}, "attribution": {"nc", "nd", "noderivatives", "noderivs", "noncommercial", "sa", "sharealike"}}
#: Windows are made for templates of up to so many words, and of up to multiples of it.
STEP = 12


def lowered(text: Column) -> Column:
    """Text with A-Z in lower case. (The two other letters that lower case turns into ASCII are left to translate.)"""
    az = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.rlike(text, F.lit("[İK]")), F.translate(text, az, az.lower())).otherwise(F.lower(text))


def split_tokens(low: Column) -> Column:
    """Runs of letters, digits and characters beyond ASCII, in order."""
    parts = F.split(low, SEPARATOR)  # may start and end with an empty string
    lead = F.when(F.get(parts, 0) == "", 1).otherwise(0)
    trail = F.when(F.element_at(parts, -1) == "", 1).otherwise(0)
    return F.when(F.size(parts) <= lead + trail, F.array().cast("array<string>")).otherwise(F.slice(parts, 1 + lead, F.size(parts) - lead - trail))


def phrase_starts(words: str, phrase: tuple[str, ...]) -> Column:
    """Places (from 0) where the words of a phrase stand one after another."""
    w = F.col(words)

    def here(x: Column, i: Column) -> Column:
        is_it = x == phrase[0]
        for k, p in enumerate(phrase[1:], 1):
            is_it = is_it & F.coalesce(F.get(w, i + k) == p, F.lit(False))
        return F.when(is_it, i).otherwise(F.lit(-1))

    return F.filter(F.transform(w, here), lambda i: i >= 0)


def template_sets(templates: dict[str, tuple[str, ...]] | None = None) -> list[tuple[str, list[str]]]:
    return [(label, sorted(set(text.split()))) for label, texts in sorted((templates or TEMPLATES).items()) for text in texts]


def window_step(template: str) -> int:
    return -(-len(template.split()) // STEP) * STEP


def blocks_of(low: Column, rare: Column, vocabulary: Column, steps: list[int]) -> Column:
    """array<struct<line int, step int, words>>: the blocks with a rare word; line is where a block starts, from 0."""
    apart = F.split(low, r"\n(?=[\x00-\x09\x0B-\x20]*\n)")  # one line break goes with each cut
    first = lambda j: F.when(j == 0, 0).otherwise(F.size(F.split(F.array_join(F.slice(apart, 1, j), "\n"), "\n")))
    pieces = F.filter(F.transform(apart, lambda x, j: F.struct(x.alias("text"), j.alias("j"))), lambda p: F.arrays_overlap(split_tokens(p["text"]), rare))

    def block(line: Column, step: Column, words: Column) -> Column:
        return F.struct(line.cast("int").alias("line"), step.cast("int").alias("step"), F.array_intersect(vocabulary, words).alias("words"))

    def of_piece(p: Column) -> Column:
        """p: line int, lines array<array<string>>, words array<struct<i, w>>."""
        return F.concat(*[x for step in steps for x in (short_lines(p, step), windows(p, step))])

    def short_lines(p: Column, step: int) -> Column:
        lines = F.transform(p["lines"], lambda x, i: F.struct(i.alias("i"), x.alias("x")))
        short = F.filter(lines, lambda x: (F.size(x["x"]) <= 2 * step) & F.arrays_overlap(x["x"], rare))
        return F.transform(short, lambda x: block(p["line"] + x["i"], F.lit(step), x["x"]))

    def windows(p: Column, step: int) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((F.size(p["words"]) - 2 * step) / step).cast("int")))
        cut = F.filter(F.transform(starts, lambda k: F.slice(p["words"], k * step + 1, 2 * step)), lambda x: F.arrays_overlap(x["w"], rare))
        return F.transform(cut, lambda x: block(p["line"] + F.get(x["i"], F.lit(0)), F.lit(step), x["w"]))

    split = F.transform(pieces, lambda p: F.struct(first(p["j"]).alias("line"), F.transform(F.split(p["text"], "\n"), split_tokens).alias("lines")))
    tagged = F.transform(split, lambda p: F.struct(p["line"].alias("line"), p["lines"].alias("lines"), F.flatten(F.transform(p["lines"], lambda x, i: F.transform(x, lambda w: F.struct(i.alias("i"), w.alias("w"))))).alias("words")))
    return F.array_distinct(F.flatten(F.transform(tagged, of_piece)))


def scan(docs: DataFrame, threshold: float = 0.8, templates: dict[str, tuple[str, ...]] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of docs with its phrases and the templates that one of its blocks holds.

    Columns: id; n_words long; n_base long (places of phrases), first_word and last_word long (their smallest and largest
    start, else null); base_labels and labels string (distinct, sorted, comma-joined, empty if none); score double (the
    largest share of a template's words in a block that holds it, 1 where a phrase stands, else 0); matches
    array<struct<line int, template string, score double, told boolean>>, told where the block has all words that tell the
    template's variant and none of another's.

    Null texts count as empty. Null ids stay null; repeated rows give a row each and equal results; other columns are
    ignored; an empty table gives an empty table. Document frequencies are those of all documents and of the templates'
    words only, so what reaches the driver is bounded by the templates. Only blocks with a rare enough word leave their row.
    """
    sets = template_sets(templates)
    steps = [window_step(text) for _, texts in sorted((templates or TEMPLATES).items()) for text in texts]
    vocabulary = sorted({w for _, words in sets for w in words})
    d = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    low = d.withColumn("__low", lowered(F.col("__text")))
    words_array = lambda ws: F.array(*[F.lit(w) for w in ws]) if ws else F.array().cast("array<string>")

    seen = low.select(F.explode(F.array_intersect(words_array(vocabulary), split_tokens(F.col("__low")))).alias("word"))
    frequency = {r["word"]: r["n"] for r in seen.groupBy("word").agg(F.count("*").alias("n")).collect()}  # templates' words only
    ordered = sorted(vocabulary, key=lambda w: (frequency.get(w, 0), w))
    rank = {w: i for i, w in enumerate(ordered)}
    rows, prefix_words = [], set()
    for number, ((label, words), step) in enumerate(zip(sets, steps, strict=True)):
        must = sorted(TELLING & set(words))
        never = sorted({x for w in words for x in OTHERS.get(w, ())} - set(words))
        need = math.ceil(threshold * len(words) - 1e-9)
        words = sorted(words, key=rank.__getitem__)
        for place, w in enumerate(words[: len(words) - need + 1]):
            rows.append((number, label, words, need, place, w, step, must, never))
            prefix_words.add(w)
    prefixes = docs.sparkSession.createDataFrame(rows, "template int, label string, words array<string>, need int, place int, word string, step int, must array<string>, never array<string>")
    rare = words_array(sorted(prefix_words))

    w = low.withColumn("__words", split_tokens(F.col("__low")))
    maybe = F.contains("__low", F.lit("reserved")) | F.contains("__low", F.lit("license")) | F.rlike("__low", F.lit(rf"cc{SEPARATOR}by"))
    none = F.array().cast("array<int>")
    for i, phrase in enumerate(PHRASES):
        w = w.withColumn(f"__at{i}", F.when(maybe, phrase_starts("__words", phrase)).otherwise(none))
    starts = F.concat(*[F.col(f"__at{i}") for i in range(len(PHRASES))])
    others = sorted({x for xs in OTHERS.values() for x in xs} - set(vocabulary))
    cut = blocks_of(F.col("__low"), rare, words_array([*ordered, *others]), sorted(set(steps)))
    no_blocks = F.array().cast("array<struct<line:int,step:int,words:array<string>>>")
    w = w.select(
        F.col("__id"),
        F.xxhash64("__id", "__text").alias("__key"),
        F.size("__words").cast("long").alias("n_words"),
        starts.alias("__starts"),
        F.array_compact(F.array(*[F.when(F.size(f"__at{i}") > 0, F.lit(label)) for i, label in enumerate(PHRASES.values())])).alias("__base"),
        F.when(F.arrays_overlap("__words", rare), cut).otherwise(no_blocks).alias("__blocks"),
    )
    per_doc = written(w, "license-rows")

    blocks = per_doc.select("__key", F.explode("__blocks").alias("b")).select("__key", "b.line", F.col("b.step").alias("size"), F.col("b.words").alias("block")).distinct()
    tokens = blocks.select("__key", "line", "size", "block", F.posexplode("block").alias("at", "token"))
    candidate = (
        tokens.join(F.broadcast(prefixes), F.col("token") == F.col("word"))  # bounded by the templates
        .filter((F.col("size") == F.col("step")) & (F.size("block") >= F.col("need")))
        .filter(1 + F.least(F.size("block") - F.col("at") - 1, F.size("words") - F.col("place") - 1) >= F.col("need"))
        .withColumn("told", (F.size(F.array_except("must", "block")) == 0) & ~F.arrays_overlap("never", "block"))
        .select("__key", "line", "template", "label", "need", "words", "block", "told")
        .distinct()
    )
    shared = candidate.withColumn("n", F.size(F.array_intersect("words", "block"))).filter("n >= need")
    found = shared.groupBy(F.col("__key").alias("__k")).agg(
        F.sort_array(F.collect_set(F.struct("line", F.col("label").alias("template"), (F.col("n") / F.size("words")).alias("score"), "told"))).alias("matches")
    )
    joined = per_doc.join(found, F.col("__key") == F.col("__k"), "left")
    no_match = F.array().cast("array<struct<line:int,template:string,score:double,told:boolean>>")
    joined = joined.withColumn("matches", F.coalesce("matches", no_match))
    labels = F.array_distinct(F.concat("__base", F.transform("matches", lambda m: m["template"])))
    return joined.select(
        F.col("__id").alias(id_col),
        "n_words",
        F.size("__starts").cast("long").alias("n_base"),
        F.array_min("__starts").cast("long").alias("first_word"),
        F.array_max("__starts").cast("long").alias("last_word"),
        F.array_join(F.sort_array("__base"), ",").alias("base_labels"),
        F.array_join(F.sort_array(labels), ",").alias("labels"),
        F.when(F.size("__starts") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.transform("matches", lambda m: m["score"])), F.lit(0.0))).alias("score"),
        "matches",
    )
