"""Text analysis as column expressions: all of it stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarn.functions.stemming import as_stemmer, light_stem

#: The default stop words.
STOPWORDS = (
    "a about after all also an and are as at be been but by can could did do does for from had has have he her his "
    "if in into is it its more no not of on only or other our out over she so some than that the their them then "
    "there they this to up was we were what when which who will with would you"
).split()


def cleaned(text: Column) -> Column:
    """The text in lower case with a space for all that is no letter, digit or space."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{Nd} ]+", " ")


def words(text: Column) -> Column:
    """All words in order, stop words and numbers included; null has none."""
    return F.filter(F.split(cleaned(text), r"\s+"), lambda w: w != "")


def is_index_word(word: Column, stopwords=STOPWORDS) -> Column:
    return ~word.rlike("^[0-9]+$") & ~word.isin(list(stopwords))


def html_escape(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(plain), F.lit(entity))
    return out


def pmcid_of(path: Column) -> Column:
    """The file name without .nxml."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/\\]+)$", 1), r"\.nxml$", "")


def type_of(path: Column) -> Column:
    """diagnosis, test or treatment, from a segment of the path, else empty."""
    return F.lower(F.regexp_extract(path, r"(?i)[/\\](diagnosis|test|treatment)[/\\]", 1))


def clean_word(word: Column) -> Column:
    """A word of running text as snippets see it: punctuation inside is deleted, not split at."""
    return F.regexp_replace(F.lower(word), r"[^\p{L}\p{Nd}]", "")


def snippet_parts(text: Column, stems: Column, stem=light_stem) -> tuple[Column, Column, Column]:
    """Words of the text, a flag for each that its stem is asked for, and the place of the first (0 if none)."""
    running = F.split(F.coalesce(text, F.lit("")), r"\s+")
    flags = _asked(running, stems, stem)
    return running, flags, F.array_position(flags, True)


def _asked(running: Column, stems: Column, stem) -> Column:
    """For each word of an array whether its stem is among the given ones."""
    clean = F.transform(running, clean_word)
    return F.zip_with(clean, as_stemmer(stem).each(clean), lambda w, s: (w != "") & F.array_contains(stems, s))


def _window(running: Column, first: Column) -> tuple[Column, Column]:
    start = F.greatest(first - 8, F.lit(1))
    return start, F.least(F.size(running), first + 11) - start + 1


def snippet(fields: list[Column], stems: Column, stem=light_stem) -> Column:
    """20 words around the first hit in the first field that has one."""
    out = []
    for text in fields:
        running, _, first = snippet_parts(text, stems, stem)
        start, length = _window(running, first)
        body = F.concat(F.when(start > 1, "...").otherwise(""), F.array_join(F.slice(running, start.cast("int"), length.cast("int")), " "), F.lit(" "), F.when(start + length - 1 < F.size(running), "...").otherwise(""))
        out.append(F.when(first > 0, F.trim(body)))
    return F.coalesce(*out, F.lit("(no snippet)"))


def highlighted_snippet(fields: list[Column], stems: Column, stem=light_stem) -> Column:
    """The same words, escaped for HTML, with every hit marked."""
    out = []
    for text in fields:
        running, flags, first = snippet_parts(text, stems, stem)
        start, length = _window(running, first)
        marked = F.transform(
            F.arrays_zip(running.alias("w"), flags.alias("f")),
            lambda x: F.when(x["f"], F.concat(F.lit("<mark>"), html_escape(x["w"]), F.lit("</mark>"))).otherwise(html_escape(x["w"])),
        )
        body = F.concat(F.when(start > 1, "... ").otherwise(""), F.array_join(F.slice(marked, start.cast("int"), length.cast("int")), " "), F.when(start + length - 1 < F.size(running), " ...").otherwise(""))
        out.append(F.when(first > 0, body))
    return F.coalesce(*out, F.lit("(no snippet)"))


def highlight(text: Column, stems: Column, stem=light_stem) -> Column:
    """The whole text, escaped, with every hit marked and white space kept."""
    pieces = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(\s+|\S+)"), F.lit(1))
    marked = F.zip_with(pieces, _asked(pieces, stems, stem), lambda w, f: F.when(f, F.concat(F.lit("<mark>"), html_escape(w), F.lit("</mark>"))).otherwise(html_escape(w)))
    return F.array_join(marked, "")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))
