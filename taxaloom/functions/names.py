"""Scientific names: cleaning, parts and structure as column expressions.

All of it is regular expressions and array functions, so a checklist of any size is standardized inside
the JVM; ``name_parts`` works on distinct names and joins them back.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Written forms of ranks, hybrid signs and qualifiers, and their standard forms.
DESIGNATIONS = {
    "subspecies": "subsp.", "ssp.": "subsp.", "subsp": "subsp.", "variety": "var.", "var": "var.", "forma": "f.", "fo.": "f.", "form": "f.",
    "cultivar": "cv.", "section": "sect.", "series": "ser.", "subvariety": "subvar.", "subform": "subf.",
}
INFRA = ("subsp.", "var.", "f.", "subvar.", "subf.", "cv.", "sect.", "ser.")
HYBRID = "×"
SYMBOLS = {"x": HYBRID, "X": HYBRID, "Ã—": HYBRID}
QUALIFIERS = ("aff.", "agg.", "s. lat.", "coll.", "sp.", "cf.")


def any_of(words: Sequence[str]) -> str:
    """A pattern that matches any of the words, each once and escaped."""
    return "|".join(re.escape(w) for w in dict.fromkeys(words))


def reversed_map(mapping: Mapping[str, str]) -> dict[str, str]:
    return {v: k for k, v in mapping.items()}


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def clean_text(c: Column) -> Column:
    """En dashes as hyphens, plain spaces, a period for the comma after a capital, no straight quotes, single periods, and no
    lower-case x alone before a word of two or more characters and a period."""
    c = F.regexp_replace(F.translate(c, "\u2013\u00a0\"", "- "), r"([A-Z]),", r"$1.")
    c = F.regexp_replace(c, r"\.\.", ".")
    return squeeze(F.regexp_replace(c, r"\s+x\s+(?=\S{2,}\.)\s*", " "))


def clean_symbols(c: Column, symbols: Mapping[str, str] = SYMBOLS) -> Column:
    """Stand-alone letters and broken encodings to the hybrid sign, set apart by spaces."""
    for written, sign in symbols.items():
        pattern = rf"(?<=^|\s){re.escape(written)}(?=\s|$)" if written.isalpha() and written.isascii() else re.escape(written)
        c = F.regexp_replace(c, pattern, sign)
    return squeeze(F.regexp_replace(c, rf"\s*{HYBRID}\s*", f" {HYBRID} "))


def clean_designations(c: Column, designations: Mapping[str, str] = DESIGNATIONS) -> Column:
    for written, standard in designations.items():
        c = F.regexp_replace(c, rf"(?i)(?<=\s){re.escape(written)}(?=\s)", standard)
    return c


def without_qualifiers(c: Column, qualifiers: Sequence[str] = QUALIFIERS) -> Column:
    return squeeze(F.regexp_replace(c, rf"(?<=\s)(?:{any_of(qualifiers)})(?=\s|$)", ""))


def without_infraspecific(c: Column, marks: Sequence[str] = INFRA) -> Column:
    return squeeze(F.regexp_replace(c, rf"\s(?:{any_of(marks)})\s.*$", ""))


def infraspecific(c: Column, marks: Sequence[str] = INFRA) -> Column:
    """The first rank mark with the word after it, or null."""
    return F.coalesce(*[F.nullif(F.regexp_extract(c, rf"(?<=\s)({re.escape(m)}\s+\S+)", 1), F.lit("")) for m in marks])


def file_name(c: Column) -> Column:
    return F.regexp_replace(F.trim(c), r"\s+", "_")


def species_of_file(c: Column) -> Column:
    """The species of a path like ``.../Genus_epithet.csv``."""
    return F.regexp_replace(F.regexp_replace(F.substring_index(c, "/", -1), r"\.[^.]*$", ""), "_", " ")


def word_count(c: Column) -> Column:
    return F.when(F.trim(c) == "", 0).otherwise(F.size(F.split(F.trim(c), r"\s+")))


def sentence_case(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 1 << 30)))


def wrapped(c: Column, width: int) -> Column:
    """Lines of at most ``width`` characters, cut at spaces."""
    return F.regexp_replace(F.regexp_replace(c, rf"(.{{1,{width}}})(\s+|$)", "$1\n"), r"\n$", "")


def coordinate_text(c: Column) -> Column:
    """Five decimals without trailing zeros."""
    text = F.format_string("%.5f", c)
    return F.regexp_replace(F.regexp_replace(text, r"0+$", ""), r"\.$", "")


def scientific(c: Column, digits: int = 3) -> Column:
    return F.format_string(f"%.{digits}e", c)


def logit(p: Column, guard: float = 1e-6) -> Column:
    p = F.greatest(F.lit(guard), F.least(F.lit(1 - guard), p))
    return F.log(p / (1 - p))


def inverse_logit(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def clamp(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def is_mark(x: Column) -> Column:
    return x.isin(*INFRA)


# Structure classes of a name.
STRUCTURES = (
    "species", "cultivar", "hybridCultivar", "infraspecificTaxon", "MultiInfraspecificTaxon", "interGenericHybrid", "intraGenericHybrid", "interSpecificHybrid",
    "MultiIntraSpecificHybrid", "unknownHybrid", "interGenericHybridTaxon", "interSpecificHybridTaxon", "unknownInfraHybrid", "empty",
)


def structure(df: DataFrame, name: str) -> DataFrame:
    """Adds tokens, positions (from 1) of rank marks and hybrid signs, and the structure class.

    A token is a word or what parentheses hold. A mark counts if a word follows that is no mark; ``f.`` after an
    abbreviation is an author's. A sign beside a mark isn't a token of its own.
    """
    text = F.regexp_replace(F.regexp_replace(F.coalesce(F.col(name), F.lit("")), r"\(\s", "("), r"\s\)", ")")
    out = df.withColumn("_all", F.regexp_extract_all(text, F.lit(r"(\([^()]*\)|\S+)"), F.lit(1)))
    every = F.col("_all")
    no = F.lit(False)
    filius = lambda t, x, i: (x == "f.") & F.coalesce(F.get(t, i - 1).rlike(r"\.$|Baker"), no)
    counts = lambda t, x, i: F.coalesce(is_mark(x) & (i > 0) & ~is_mark(F.get(t, i + 1)) & ~filius(t, x, i), no)
    beside = lambda i: counts(every, F.get(every, i - 1), i - 1) | counts(every, F.get(every, i + 1), i + 1)
    out = out.withColumn("tokens", F.filter(every, lambda x, i: ~((x == HYBRID) & beside(i))))
    t = F.col("tokens")
    at = lambda test: F.filter(F.transform(t, lambda x, i: F.when(test(x, i), i + 1)), lambda p: p.isNotNull())
    out = out.withColumns({
        "mark_at": at(lambda x, i: counts(t, x, i)),
        "hybrid_at": at(lambda x, i: x == HYBRID),
        "quote_at": at(lambda x, i: x.rlike(r"^'[A-Z][^']*")),
    })
    n, marks, signs, h = F.size("tokens"), F.size("mark_at"), F.size("hybrid_at"), F.get("hybrid_at", F.lit(0))
    first, after = F.get(t, F.lit(0)), F.get(t, h)
    short = after.rlike(r"^[A-Z]\.$")
    genera = (h == 1) | ((h < n) & first.rlike(r"^\p{Lu}") & after.rlike(r"^\p{Lu}") & ~short & (first != after))
    kind = (
        F.when(n == 0, "empty")
        .when((F.size("quote_at") > 0) & (marks == 0), F.when(signs > 0, "hybridCultivar").otherwise("cultivar"))
        .when((marks > 0) & (signs > 0), F.when(h == 1, "interGenericHybridTaxon").when(h <= 3, "interSpecificHybridTaxon").otherwise("unknownInfraHybrid"))
        .when(marks > 0, F.when(marks > 1, "MultiInfraspecificTaxon").otherwise("infraspecificTaxon"))
        .when(signs == 0, "species")
        .when(F.coalesce(genera, F.lit(False)), "interGenericHybrid")
        .when(h == 2, "intraGenericHybrid")
        .when((n >= 4) & (signs == 1) & F.coalesce((after == first) | short | after.rlike(r"^\P{Lu}"), F.lit(False)), "interSpecificHybrid")
        .when((n >= 4) & (signs > 1), "MultiIntraSpecificHybrid")
        .otherwise("unknownHybrid")
    )
    return out.withColumn("structure", kind).drop("_all")


def name_parts(df: DataFrame, name: str) -> DataFrame:
    """Genus, epithet, rank, infraspecific epithet, hybrid sign, clean name, what follows it (other), the parts from a second
    rank on (extra), and the full name of each distinct cleaned name, joined to all rows. A null or blank name has none."""
    cleaned = clean_designations(clean_symbols(clean_text(F.col(name))))
    parts = structure(df.select(name).distinct().withColumn("_text", cleaned), "_text")
    t, kind, n = F.col("tokens"), F.col("structure"), F.size("tokens")
    mark, h, quote = F.get("mark_at", F.lit(0)), F.get("hybrid_at", F.lit(0)), F.get("quote_at", F.lit(0))
    one = lambda i: F.get(t, i - 1)
    join = lambda *xs: F.concat_ws(" ", *xs)
    w = lambda i: one(F.lit(i))
    is_ = lambda *names_: kind.isin(*names_)
    after = one(h + 1)
    # Of "A b x A c" and "A b x A. c" the second genus goes.
    again = (after == w(1)) | (after.rlike(r"^[A-Z]\.$") & (F.substring(after, 1, 1) == F.substring(w(1), 1, 1)))
    other_parent = F.when(F.coalesce(again, F.lit(False)), h + 2).otherwise(h + 1)
    abbreviated = F.coalesce(w(2).rlike(r"\.$"), F.lit(False)) & is_("species")
    second = F.when(abbreviated, w(3)).otherwise(w(2))
    formula = is_("interGenericHybrid") & (h > 1)
    genus = F.when(is_("empty"), None).when(is_("interGenericHybrid", "interGenericHybridTaxon") & (h == 1), join(w(1), w(2))).otherwise(w(1))
    epithet = (
        F.when(is_("empty"), None)
        .when(formula, join(w(2), F.lit(HYBRID), after, one(h + 2)))
        .when(is_("interGenericHybrid", "interGenericHybridTaxon", "hybridCultivar"), w(3))
        .when(is_("intraGenericHybrid") | (is_("interSpecificHybridTaxon") & (h == 2)), join(F.lit(HYBRID), w(3)))
        .when(is_("interSpecificHybrid"), join(w(2), F.lit(HYBRID), one(other_parent)))
        .when(is_("interSpecificHybridTaxon"), join(w(2), w(3), w(4)))
        .when(is_("MultiIntraSpecificHybrid"), F.array_join(F.slice(t, 2, 5), " "))
        .when(is_("cultivar"), F.when(quote == 2, w(2)).otherwise(join(w(2), one(quote))))
        .when(is_("species"), second)
        .otherwise(w(2))
    )
    ranked = is_("infraspecificTaxon", "MultiInfraspecificTaxon", "interGenericHybridTaxon", "interSpecificHybridTaxon")
    # A single letter with a period after the mark is an author's.
    initial = is_("infraspecificTaxon") & F.coalesce(one(mark + 1).rlike(r"^[A-Za-z]\.$"), F.lit(False)) & (n > mark + 1)
    infra_at = F.when(initial, mark + 2).otherwise(mark + 1)
    rank, infra = F.when(ranked, one(mark)), F.when(ranked, one(infra_at)).when(is_("unknownInfraHybrid"), w(4))
    parts = parts.withColumns({"genus": genus, "specific_epithet": epithet, "rank": rank, "infra_epithet": infra, "hybrid": F.when(F.size("hybrid_at") > 0, F.lit(HYBRID))})
    middle = F.when(is_("hybridCultivar"), w(2))
    clean = F.when(is_("unknownHybrid", "unknownInfraHybrid"), F.array_join(F.slice(t, 1, 4), " ")).otherwise(F.concat_ws(" ", "genus", middle, "specific_epithet", "rank", F.when(ranked, F.col("infra_epithet"))))
    upto = (
        F.when(ranked, infra_at)
        .when(is_("interSpecificHybrid"), other_parent)
        .when(formula, h + 2)
        .when(is_("MultiIntraSpecificHybrid"), F.lit(6))
        .when(is_("cultivar"), quote)
        .when(is_("species"), F.when(abbreviated, F.lit(3)).otherwise(F.lit(2)))
        .when(is_("unknownHybrid", "unknownInfraHybrid"), F.lit(4))
        .otherwise(F.lit(3))
    )
    last = F.when(is_("MultiInfraspecificTaxon"), F.get("mark_at", F.lit(1)) - 1).otherwise(n)
    rest = F.filter(t, lambda x, i: ((i >= upto) & (i < last)) | (abbreviated & (i == 1)))
    other = F.regexp_replace(F.array_join(rest, " "), r"\s*\([^()]*=.*?\)|\s*hybrid complex", "")
    parts = parts.withColumn("clean_name", F.nullif(clean, F.lit(""))).withColumn("other", F.nullif(F.trim(other), F.lit("")))
    extra = F.concat_ws(" ", w(1), w(2), F.array_join(F.filter(t, lambda x, i: i >= F.get("mark_at", F.lit(1)) - 1), " "))
    parts = parts.withColumn("extra", F.when(is_("MultiInfraspecificTaxon"), extra)).withColumn("full_name", F.nullif(F.concat_ws(" ", "clean_name", "other"), F.lit("")))
    keep = ["full_name", "structure", "genus", "specific_epithet", "rank", "infra_epithet", "hybrid", "clean_name", "other", "extra"]
    small = parts.select(F.col(name).alias("_name"), *keep)
    return df.join(small, df[name].eqNullSafe(small["_name"]), "left").drop("_name")
