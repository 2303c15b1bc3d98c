"""Column functions: the reference's number, date and text rules."""

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def filled(c) -> Column:
    """Null for blank."""
    return F.when(F.trim(c) != "", F.trim(c))


def parse_amount(c) -> Column:
    """'17 100,00' -> 17100.0; anything with letters or two points is null."""
    plain = F.regexp_replace(F.trim(c), "[\\s  ]", "")
    plain = F.replace(plain, F.lit(","), F.lit("."))
    return F.when(plain.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)$"), plain.try_cast("double"))


def plain_number(c) -> Column:
    """A number in the shortest digits that read back as it, with a point and without exponent; whole ones end in '.0'."""
    wide = F.regexp_replace(F.regexp_replace(c.cast("decimal(38,6)").cast("string"), "0+$", ""), r"\.$", ".0")
    return F.when(c.isNull(), F.lit(None).cast("string")).when((F.abs(c) < 1e7) & ((F.abs(c) >= 1e-3) | (c == 0)), c.cast("string")).otherwise(wide)


def parse_int_amount(c) -> Column:
    return F.bround(parse_amount(c), 0).cast("int")


def amount_eu(c) -> Column:
    """Digits and points only."""
    return F.regexp_replace(F.replace(c, F.lit(","), F.lit(".")), "[^0-9.]", "").try_cast("double")


def clean_amount(c) -> Column:
    """Keeps the sign; drops a thousands point."""
    kept = F.replace(F.regexp_replace(c, "[^0-9,.\\-]", ""), F.lit(","), F.lit("."))
    return F.regexp_replace(kept, r"\.(?=[0-9]{3}\.)", "")


def normalize_date(c) -> Column:
    """dd-MM-yyyy of a valid date, else null."""
    plain = F.regexp_replace(F.regexp_replace(c, "[/.]", "-"), "[^0-9-]", "")
    good = plain.rlike("^[0-9]{2}-[0-9]{2}-[0-9]{4}$") & F.try_to_timestamp(plain, F.lit("dd-MM-yyyy")).isNotNull()
    return F.when(good, plain)


def fix_year_typo(c) -> Column:
    """Dates dd-MM-yyyy, also with slashes or points, get dashes; a year 3000 to 3099 loses a thousand if that makes a date."""
    plain = F.regexp_replace(F.trim(c), "[/.]", "-")
    right = F.regexp_replace(plain, "-30([0-9]{2})$", "-20$1")
    typo = plain.rlike("-30[0-9]{2}$") & F.try_to_timestamp(right, F.lit("dd-MM-yyyy")).isNotNull()
    return F.when(~plain.rlike("^[0-9]{2}-[0-9]{2}-[0-9]{4}$"), c).when(typo, right).otherwise(plain)


def _folded() -> tuple[str, str, dict[str, str]]:
    """Letters beyond ASCII whose decomposition is one letter and marks, and that letter; and such with several letters."""
    ones: dict[str, str] = {}
    several: dict[str, str] = {}
    for code in [*range(0xA0, 0x530), *range(0x1E00, 0x2000), *range(0x2100, 0x2150), *range(0xFB00, 0xFB07), *range(0xFF01, 0xFF5F)]:
        plain = "".join(x for x in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(x)).upper()
        if plain != chr(code).upper() or chr(code).upper() != chr(code):
            (ones if len(plain) == 1 else several)[chr(code)] = plain
    return "".join(ones), "".join(ones.values()), several


LETTERS, PLAIN, SEVERAL = _folded()


#: Characters that the table may tell, and the places where runs of them begin.
TOLD = "[\u00a0-\u052f\u1e00-\u1fff\u2100-\u214f\ufb00-\ufb06\uff01-\uff5e]"
RUNS, MARKS = f"(?={TOLD})(?<!{TOLD})", "".join(map(chr, range(0x300, 0x370)))


def fold_text(c) -> Column:
    """Upper case without accents: compatible forms are taken apart, marks go. The table covers Latin, Greek and Cyrillic letters,
    letter-like signs and full-width forms; loose marks (U+0300 to U+036F) go too; other scripts stay."""
    letters = F.str_to_map(F.lit("\n".join(f"{k}\t{v}" for k, v in SEVERAL.items())), F.lit("\n"), F.lit("\t"))
    apart = lambda r: F.array_join(F.transform(F.split(r, ""), lambda x: F.coalesce(F.try_element_at(letters, x), x)), "")
    # Letters with several are few, and a translation tells them faster than a pattern would.
    run = lambda r: F.translate(F.when(F.translate(r, "".join(SEVERAL), "") != r, apart(r)).otherwise(r), LETTERS + MARKS, PLAIN)
    # A translation looks at each character, so only the runs of characters that the table may tell are translated.
    piece = lambda p: F.when(F.octet_length(p) == F.length(p), p).otherwise(F.get(F.transform(F.array(F.regexp_extract(p, f"^{TOLD}+", 0)), lambda r: F.concat(run(r), F.substr(p, F.length(r) + 1))), F.lit(0)))
    plain = F.replace(F.replace(c, F.lit("â€™"), F.lit("'")), F.lit("™"), F.lit("T"))
    return F.upper(F.when(F.octet_length(c) == F.length(c), c).otherwise(F.array_join(F.transform(F.split(plain, RUNS), piece), "")))


#: Texts of these characters only fold by the table.
TABLED = "^[\x00-\u052f\u1e00-\u214f\u3000-\u3003\ufb00-\ufb06\uff01-\uff5e]*$"


@F.pandas_udf(StringType())
def _folded_whole(texts: pd.Series) -> pd.Series:
    return pd.Series(["".join(x for x in unicodedata.normalize("NFKD", t.replace("â€™", "'").replace("™", "T")) if not unicodedata.combining(x)).upper() if t is not None else None for t in texts], dtype="object")


def with_folded(df: DataFrame, text: str, name: str = "folded") -> DataFrame:
    """df with the folded text for all of Unicode: texts of characters that the table covers are folded by it, in the JVM; only rows
    with others (half-width and Arabic forms, Hangul, units, marks of other scripts) go through Python, in batches."""
    plain = F.coalesce(F.col(text).rlike(TABLED), F.lit(True))
    return df.where(plain).withColumn(name, fold_text(F.col(text))).unionByName(df.where(~plain).withColumn(name, _folded_whole(text)))


def name_similarity(a, b) -> Column:
    """Shared tokens of 4 letters and more, over the larger set."""
    tokens = lambda c: F.array_distinct(F.filter(F.split(F.regexp_replace(fold_text(c), "[^A-Z0-9]+", " "), " "), lambda t: F.length(t) >= 4))
    x, y = tokens(a), tokens(b)
    most = F.greatest(F.size(x), F.size(y))
    return F.when(most > 0, F.size(F.array_intersect(x, y)) / most).otherwise(F.lit(0.0))


def path_segment(c, fallback: str) -> Column:
    """Letters, digits, point, line and dash; edges without . _ -"""
    plain = F.regexp_replace(F.regexp_replace(c, "[^A-Za-z0-9._-]+", "_"), "^[._-]+|[._-]+$", "")
    return F.coalesce(F.when(plain != "", plain), F.lit(fallback))


def dum_validated(c) -> Column:
    return F.lower(F.trim(c)).isin("validated", "valide")


def invoice_validated(c) -> Column:
    return F.lower(F.trim(c)).isin("valide", "controle_croise", "controle_ok", "controle_warning", "controle_ecart")


def safe_float(c) -> Column:
    """Digits and points; the sign goes, two points are null."""
    return F.regexp_replace(F.replace(c, F.lit(","), F.lit(".")), "[^0-9.]", "").try_cast("double")


def coherence_number(c) -> Column:
    """As safe_float, with the sign."""
    return F.regexp_replace(F.replace(c, F.lit(","), F.lit(".")), "[^0-9.-]", "").try_cast("double")


def lenient_float(c) -> Column:
    """As coherence_number, of several points the first counts."""
    plain = F.regexp_replace(F.replace(c, F.lit(","), F.lit(".")), "[^0-9.-]", "")
    return F.concat(F.regexp_extract(plain, r"^([^.]*\.?)", 1), F.replace(F.regexp_extract(plain, r"^[^.]*\.?(.*)$", 1), F.lit("."), F.lit(""))).try_cast("double")


# Misread words of the forms and what they stand for, in the order in which they are put right.
MISREAD = [
    (r"\bCUSTPMS\b", "CUSTOMS"), (r"\bDECTARATION\b", "DECLARATION"), (r"\bDECLARATON\b", "DECLARATION"), (r"\bIMPORTATEAR\b", "IMPORTATEUR"), (r"\bIMPRIM[ÉE]\b", "IMPRIME"), (r"\bMAYEN\b", "MOYEN"), (r"\bPATER\b", "PAYS"),
    (r"\bPAYS\s+DE\s+PREMIGRE\b", "PAYS DE PREMIERE"), (r"\bU5D\b", "USD"), (r"\bUSO\b", "USD"), (r"\bUSP\b", "USD"), (r"\bPTEN\b", "PTFN"), (r"\bOCB\b", "QCS"), (r"\bACS\b", "QCS"), (r"\bPOIDA\b", "POIDS"), (r"\bPAIDA\b", "POIDS"),
    (r"\bDOUANE\s+COEF\.?\s+D['’]AJUSTE\w*\b", "DOUANE COEF. D'AJUSTEMENT"), (r"\bSAT\b", "USA"), (r"\bU5A\b", "USA"),
]

# Each begins a word: where none can begin the search goes on, without a look at each of them.
ANY_MISREAD = rf"(?iU)(?=[{''.join(sorted({p[2] for p, _ in MISREAD}))}])\b(?:{'|'.join(p.removeprefix(chr(92) + 'b') for p, _ in MISREAD)})"


def normalize_noise(c) -> Column:
    """Curved quotes and backticks made straight, misread words put right, blanks and empty lines closed up."""
    c = plain = F.replace(F.replace(c, F.lit("’"), F.lit("'")), F.lit("`"), F.lit("'"))
    for pattern, word in MISREAD:
        c = F.regexp_replace(c, "(?iU)" + pattern, word)
    # Texts that no rule fits, which are most, are searched once.
    c = F.when(plain.rlike(ANY_MISREAD), c).otherwise(plain)
    return F.trim(F.regexp_replace(F.regexp_replace(c, "[ \t]{2,}", " "), "\n{3,}", "\n\n"))


def importer_code(c) -> Column:
    """'cl 101' -> CL101, else three to five digits, else the text without blanks. A longer number isn't cut to another client's."""
    plain = F.upper(F.regexp_replace(c, r"\s+", ""))
    client, digits = F.regexp_extract(plain, r"CL([0-9]{1,4})(?![0-9])", 1), F.regexp_extract(plain, r"\b([0-9]{3,5})\b", 1)
    return F.when(client != "", F.concat(F.lit("CL"), client)).when(digits != "", digits).otherwise(F.nullif(plain, F.lit("")))


def field_text(key, c) -> Column:
    """A field's value by its name: dates with dashes, digits of numbers, names in upper case."""
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", ""), r"\s+", " "), r"^[ \-|:;,.]+|[ \-|:;,.]+$", "")
    plain = F.regexp_replace(F.regexp_replace(F.replace(plain, F.lit("™"), F.lit("T")), r"U S A|U\.S\.A", "USA"), r"\b(1N|TM)\b", "TN")
    day = F.nullif(F.regexp_replace(F.regexp_extract(plain, r"\b([0-9]{2}[/.-][0-9]{2}[/.-][0-9]{4})\b", 1), "[/.]", "-"), F.lit(""))
    digits = F.nullif(F.regexp_replace(F.regexp_replace(plain, "[^0-9,.-]", ""), r"\.{2,}", "."), F.lit(""))
    numeric, name = key.rlike("code|numero|num_|colis|poids|montant|qcs|delai|regime"), key.rlike("importateur|exportateur|declarant|bureau|itineraire|mode_transport|designation")
    return F.when(key.contains("date") & day.isNotNull(), day).when(numeric, F.coalesce(digits, plain)).when(name, F.upper(plain)).otherwise(plain)


# The shape of each kind of field.
SHAPES = {
    "declaration_id": r"^[0-9]{6}$", "date_tn": r"\b[0-9]{2}[-/.][0-9]{2}[-/.][0-9]{4}\b", "type_declaration": r"(?i)^ *(EA|SE|EE|DUM|IM *[0-9]*|EX *[0-9]*|T1)$", "small_int": r"^[0-9]{1,5}$", "colis": r"^(?!0+$)[0-9]{1,3}$",
    "repertoire": r"^[0-9]{4,6}$", "declarant_code": r"^(?!0+[0-9]?$)[0-9]{2,5}$", "regime_delai": r"^[0-9]{1,2}$", "weight": r"^[0-9]+([.,][0-9]+)?$", "amount": r"^[0-9]+([.,][0-9]+)?$", "alnum_code": r"[A-Za-z0-9][^A-Za-z0-9]*[A-Za-z0-9]", "block_text": r"(?s)^.{10}",
}


def valid_field(kind, c) -> Column:
    """Whether a value has the shape of its kind; blank never has, a kind without a shape takes anything else."""
    text = F.trim(F.coalesce(c, F.lit("")))
    test = F.lit(True)
    for name, shape in SHAPES.items():
        test = F.when(kind == name, text.rlike(shape)).otherwise(test)
    return (text != "") & test
