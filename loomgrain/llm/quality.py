"""Line-first cleaning: rules remove lines, then documents that lost too much text go.

DataFrame functions only; every column of a document comes from its own row, so there is no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = " \t\n\x0b\f\r"
SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
#: Phrases of page furniture (lower case), in English, German, French and Spanish.
BOILERPLATE = (
    "accept cookies",
    "aceptar cookies",
    "accepter les cookies",
    "alle cookies akzeptieren",
    "click here",
    "cliquez ici",
    "conditions d'utilisation",
    "condiciones de uso",
    "cookie policy",
    "datenschutzerklärung",
    "enable javascript",
    "haga clic aquí",
    "hier klicken",
    "iniciar sesión",
    "log in to",
    "mentions légales",
    "newsletter abonnieren",
    "nutzungsbedingungen",
    "política de privacidad",
    "politique de confidentialité",
    "privacy policy",
    "s'abonner à la newsletter",
    "se connecter",
    "share this",
    "sign up for",
    "skip to content",
    "subscribe to our",
    "suscríbete a",
    "terms of service",
    "terms of use",
    "zum inhalt springen",
)
#: How lines of prose end, before white space.
LINE_END = r"[.!?…:;\"'»”’)\]][\x20\x09-\x0D]*$"
#: Phrases of page furniture count on lines of up to so many words; longer ones are prose.
FURNITURE_WORDS = 20


def split_words(text: Column) -> Column:
    """Words between ASCII white space; no words for null or blank text."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(F.length(bare) == 0, F.array().cast("array<string>")).otherwise(F.split(bare, SPACES))


def line_rules(line: Column) -> dict[str, Column]:
    """What a line fails, by name; lines are judged alone.

    punctuation: a tenth or more of its characters are symbols, or there are at least as many doubled exclamation or
    question marks as half its words; fragment: fewer than five words without a mark that ends prose; navigation: three or
    more separators (|, », ·) that stand between words, one for every four words at least; links: web addresses make up half
    its words; boilerplate: it is short and holds a phrase of page furniture; braces: it holds a curly brace.
    """
    low = F.lower(line)
    words = F.size(split_words(line))
    separators = F.regexp_count(line, F.lit(r"[|»·]"))
    marks = F.regexp_count(line, F.lit(r"[!?]{2,}"))
    links = F.regexp_count(low, F.lit(r"https?://|www\."))
    return {
        "punctuation": (F.regexp_count(line, F.lit(SYMBOLS)) * 10 >= F.length(line)) | (marks * 2 >= words),
        "fragment": (words < 5) & ~F.rlike(line, F.lit(LINE_END)),
        "navigation": (separators >= 3) & (separators * 4 >= words),
        "links": links * 2 >= words,
        "boilerplate": (words <= FURNITURE_WORDS) & F.rlike(low, F.lit("|".join(BOILERPLATE))),
        "braces": F.contains(line, F.lit("{")) | F.contains(line, F.lit("}")),
    }


def repeat_words(words: str) -> list[tuple[str, Column]]:
    """Steps (column, expression) from a words column to __covered: words inside a 3-word window that occurs twice.

    Windows are sorted as hash and place in one long; neighbours of equal hash are then compared word by word, and with all
    others of that hash only where they differ.
    """
    w, h = F.col(words), F.col("__hash")
    bits = F.ceil(F.log2(F.size(w) + F.lit(2))).cast("int")
    keys = F.transform(h, lambda x, i: F.call_function("shiftleft", F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2)), F.col("__bits")) + i)
    s = F.col("__sorted")

    def place(v: Column) -> Column:
        return v.bitwiseAND(F.col("__mask"))

    def meets(v: Column, u: Column) -> Column:
        return F.coalesce(F.call_function("shiftright", v, F.col("__bits")) == F.call_function("shiftright", u, F.col("__bits")), F.lit(False))

    def same(v: Column, u: Column) -> Column:
        alike = F.lit(True)
        for k in range(3):
            alike = alike & (F.get(w, (place(v) + k).cast("int")) == F.get(w, (place(u) + k).cast("int")))
        return F.coalesce(alike, F.lit(False))

    def repeats(v: Column, i: Column) -> Column:
        before, after = F.get(s, i - 1), F.get(s, i + 1)
        beside = (meets(v, before) & same(v, before)) | (meets(v, after) & same(v, after))
        return F.when(~meets(v, before) & ~meets(v, after), F.lit(False)).when(beside, F.lit(True)).otherwise(F.exists(s, lambda u: (u != v) & meets(v, u) & same(v, u)))

    p = F.col("__places")
    return [
        ("__bits", bits),
        ("__mask", (F.call_function("shiftleft", F.lit(1).cast("long"), F.col("__bits")) - 1).cast("long")),
        ("__hash", F.transform(w, lambda x: F.xxhash64(x))),
        ("__sorted", F.when(F.size(w) > 3, F.sort_array(F.slice(keys, 1, F.greatest(F.size(w) - 2, F.lit(0))))).otherwise(F.array().cast("array<long>"))),
        ("__places", F.sort_array(F.transform(F.filter(s, repeats), place))),
        ("__covered", F.aggregate(F.transform(p, lambda v, i: F.least(F.lit(3).cast("long"), F.coalesce(F.get(p, i + 1) - v, F.lit(3).cast("long")))), F.lit(0).cast("long"), lambda a, v: a + v)),
    ]


def clean_lines(docs: DataFrame, most_lost: float = 0.5, least_words: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Judge every row of docs by its whole text.

    Columns: id; n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long); base_failed boolean (n_words <
    least_words, or more than half of the words repeat); n_lines, n_lines_removed (long, of lines with a word),
    lost double (share of the words' characters on removed lines), kept boolean (not base_failed, and lost is at most
    most_lost), clean_text string (the lines that stay).

    Null and blank texts have no words: counts 0, base_failed, lost 0, clean_text empty. Null ids stay null, repeated rows
    give a row each, other columns are ignored whatever their names, an empty table gives an empty table.
    """
    d = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    d = d.withColumn("__words", split_words(F.col("__text")))
    has_word = lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]"))
    d = d.withColumn("__lines", F.filter(F.split("__text", "\n"), has_word))

    def fails(x: Column) -> Column:
        out = F.lit(False)
        for rule in line_rules(x).values():
            out = out | rule
        return out

    d = d.withColumn("__good", F.filter("__lines", lambda x: ~fails(x)))
    for name, step in repeat_words("__words"):
        d = d.withColumn(name, step)
    chars = lambda lines: F.length(F.translate(F.array_join(lines, ""), SPACE, ""))
    d = d.select(
        F.col("__id").alias(id_col),
        F.size("__words").cast("long").alias("n_words"),
        F.length(F.array_join("__words", "")).cast("long").alias("word_chars"),
        F.regexp_count("__text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.col("__covered").alias("n_repeat_words"),
        F.size("__lines").cast("long").alias("n_lines"),
        (F.size("__lines") - F.size("__good")).cast("long").alias("n_lines_removed"),
        F.when(F.size("__good") == F.size("__lines"), F.length(F.array_join("__words", ""))).otherwise(chars(F.col("__good"))).cast("long").alias("__stays"),
        F.array_join("__good", "\n").alias("clean_text"),
    )
    d = d.withColumn("base_failed", (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    d = d.withColumn("lost", F.when(F.col("word_chars") > 0, 1 - F.col("__stays") / F.col("word_chars")).otherwise(F.lit(0.0)))
    d = d.withColumn("kept", ~F.col("base_failed") & (F.col("lost") <= most_lost))
    return d.select(id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_lines", "n_lines_removed", "lost", "kept", "clean_text")
