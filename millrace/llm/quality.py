"""Quality rules, lines first, in DataFrame functions only.

Each line is judged by rules of punctuation, of navigation and of boilerplate; lines that fail are taken out, and a
document that loses too much of its text by that is rejected. Base rules on the whole text come before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import doc_columns

WHITE = r"[\x20\x09-\x0D]"
#: A document may lose this share of its word characters to failing lines.
MOST_LOST = 40
#: Marks and separators that a line of running text has few of: at most this share of its characters.
MOST_MARKS = 10
#: Words of a repeated window, and the share of words in such windows that a document may have.
WINDOW, MOST_REPEATED, LEAST_WORDS = 5, 20, 10
#: Letters, marks and digits of any script are what words are made of; the same in Java's regular expressions and in RE2.
W, NOT_W = r"[\p{L}\p{M}\p{N}_]", r"[^\p{L}\p{M}\p{N}_]"
#: Scripts that write no spaces between words (Thai, kana, Han): how many such characters a line of navigation or boilerplate has at most.
SOLID, MOST_SOLID = r"[\x{0E00}-\x{0E7F}\x{3040}-\x{30FF}\x{3400}-\x{9FFF}\x{20000}-\x{3FFFF}]", 12
#: Characters of a line of navigation or boilerplate at most.
SHORT = 300
#: Phrases of navigation, where they begin a line of six words at most (fixed values).
NAVIGATION = rf"^{NOT_W}*(?:home|menu|log ?in|sign in|sign up|next|previous|back to top|skip to content|read more|share this|search|site ?map|startseite|zurück|weiterlesen|accueil|suivant|inicio|siguiente|leer más)(?:{NOT_W}+{W}+){{0,4}}{NOT_W}*$"
#: Phrases of boilerplate (fixed values), where they are a line but for a few words: prose that mentions one stays.
PHRASES = (
    "all rights reserved|privacy policy|terms of (?:use|service)|lorem ipsum|click here|subscribe to|powered by|copyright(?: ©| \\(c\\))? \\d{4}"
    "|(?:uses?|using|accept|enable|allow|disable|manage|our) (?:all )?cookies?|cookies? (?:policy|settings|notice|consent|preferences)"
    "|(?:enable|requires?|without|disabled?) javascript|javascript (?:is |must be )?(?:required|disabled|enabled)"
    "|alle rechte vorbehalten|datenschutzerklärung|tous droits réservés|politique de confidentialité|todos los derechos reservados|política de privacidad"
)
#: Words that may stand before, and behind, such a phrase.
AROUND = 6
BOILERPLATE = rf"^{NOT_W}*(?:{W}+{NOT_W}+){{0,{AROUND}}}(?:{PHRASES})(?:{NOT_W}+{W}+){{0,{AROUND}}}{NOT_W}*$"


def words(text: Column) -> Column:
    return F.filter(F.split(text, WHITE + "+"), lambda w: w != "")


def squeezed(text: Column) -> Column:
    """Characters other than white space, how many."""
    return F.length(F.regexp_replace(text, WHITE + "+", ""))


def fails(line: Column) -> Column:
    """Whether a line with a word is to be taken out."""
    chars = squeezed(line)
    marks = chars - squeezed(F.regexp_replace(line, r"[!?#*$%&|<>~^_=+{}\[\]\\]", ""))
    bars = F.length(line) - F.length(F.replace(line, F.lit(" | "), F.lit("  ")))
    low = F.lower(line)
    punctuation = (chars == 0) | (100 * marks > MOST_MARKS * chars)
    short = (F.length(line) <= SHORT) & (F.length(line) - F.length(F.regexp_replace(line, SOLID, "")) <= MOST_SOLID)
    return punctuation | (bars >= 3) | short & (low.rlike(NAVIGATION) | low.rlike(BOILERPLATE))


def cleaned_lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda line: ~fails(line))


def repeated_words(keys: Column) -> Column:
    """Words that lie in windows which stand twice or more; keys: a hash of each window, in order."""
    ranked = lambda k: F.array_sort(F.transform(k, lambda x, i: F.struct(x.alias("k"), i.alias("i"))))
    again = lambda s: F.filter(F.transform(s, lambda x, j: F.when((F.get(s, j + 1)["k"] == x["k"]) | (F.get(s, F.greatest(j - 1, F.lit(0)))["k"] == x["k"]) & (j > 0), x["i"])), lambda i: i.isNotNull())
    covered = lambda p: F.aggregate(F.transform(p, lambda a, j: F.least(F.lit(WINDOW), F.coalesce(F.get(p, j + 1) - a, F.lit(WINDOW)))), F.lit(0).cast("long"), lambda x, y: x + y)
    bound = lambda value, use: F.element_at(F.transform(F.array(value), use), 1)  # noqa: E731  evaluates value once
    return bound(ranked(keys), lambda s: bound(F.array_sort(again(s)), covered))


def rules(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept of every row.

    Windows of words are told apart by 64-bit hashes. Null texts have no words and so fail. Repeated rows are judged
    each, null ids stay. Other columns are not looked at. An empty table gives an empty result.
    """
    rows = doc_columns(docs, "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    split = rows.select("doc_id", "text", words(F.col("text")).alias("w"))
    lines = F.filter(F.split("text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    listed = split.select("doc_id", "text", F.size("w").alias("n"), F.length(F.array_join("w", "")).alias("word_chars"), F.transform("w", lambda w: F.xxhash64(w)).alias("h"), lines.alias("lines"))
    window = lambda i: F.xxhash64(*[F.get("h", i + k) for k in range(WINDOW)])
    keyed = listed.select("*", F.when(F.col("n") >= WINDOW, F.transform(F.sequence(F.lit(0), F.greatest(F.col("n") - WINDOW, F.lit(0))), window)).otherwise(F.array().cast("array<bigint>")).alias("keys"))
    lost = F.aggregate(F.filter("lines", fails), F.lit(0).cast("long"), lambda total, line: total + squeezed(line))
    counted = keyed.select(
        "doc_id",
        F.col("n").cast("long").alias("n_words"),
        F.col("word_chars").cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.regexp_replace("text", r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct("keys")) < F.size("keys"), repeated_words(F.col("keys"))).otherwise(F.lit(0)).cast("long").alias("n_repeat_words"),
        lost.alias("lost"),
    )
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    judged = counted.withColumn("base_failed", failed)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (100 * F.col("lost") <= MOST_LOST * F.col("word_chars"))).alias("kept"))


def clean(docs: DataFrame) -> DataFrame:
    """doc_id and text of every row, its failing lines taken out; a null text stays null."""
    return doc_columns(docs, "doc_id", "text").select("doc_id", F.array_join(cleaned_lines(F.col("text")), "\n").alias("text"))
