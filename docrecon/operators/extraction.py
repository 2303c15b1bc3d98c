"""Fields of declarations and invoices found in their text, as column expressions: one pass over the text, no shuffle.

The parts of a declaration read folded text (upper case, no accents), which `fields` and the functions over tables fold once, into
a column that all patterns read.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docrecon.functions.scalars import amount_eu, clean_amount, fold_text, normalize_date, parse_amount

# Forms and words of the declaration's print. Patterns read folded text (upper case, no accents).
DAY = r"\d{2}[/.-]\d{2}[/.-]\d{4}"
KIND = r"EA|SE|EE|DUM|IM\s*\d{0,3}|EX\s*\d{0,3}|T1"
BARE_KIND = r"EA|SE|DUM|IM\s*\d{0,3}|EX\s*\d{0,3}|T1"
SHIP = "NAVIRE|BATEAU|VESSEL"
TERMS = "EXW|CFR|DAP|FOB|CIF|CIP|CPT|DDP|FCA|FAS|DAT"
MONEY3 = r"\d{1,12}[,.]\d{3}"
NUMBER_AND_DAY = rf"\b(\d{{6}})\s+({DAY})\b"
COUNTS = rf"\b(?:{KIND})\b[^\d]{{0,18}}(\d{{1,2}})[^\d]{{1,18}}(\d{{1,4}})\b"
SHORT_TERMS = rf"\b({TERMS})\b[^\n\d]{{0,12}}(\d{{1,2}})(?![/.-])(?:[^\n\d]{{1,12}}(\d{{1,2}})(?![/.-]))?"
LONG_TERMS = rf"\b({TERMS})\b[\s\S]{{0,120}}?PAIEMENT[^\d]{{0,40}}([1-9])\b[\s\S]{{0,120}}?(?:REL(?:ATION)?|ACH\.?\s*/?\s*VEND)[^\d]{{0,40}}([1-9])\b"
OFFICE = r"\b(\d{1,3})\s+BR\s*-\s*(ARIANA|TUNIS|SFAX|BIZERTE)\b"
MOVEMENT = r"\b(\d{1,3})\s+(\d{1,4})\s+(EXPORT|IMPORT|TRANSIT)\s+\d{1,2}[,.]\d{6,8}"
KEY = r"\b(D\d{2,6}[A-Z]{2,4}\d[A-Z])\b\s*[,/|]?\s*(\d{6,12})?"
# An approval apart from its directory goes before a glued one, which may be the front of another number.
APPROVAL = [r"\b(935)(?:\s*[|:/-]\s*|\s+)(\d{3,5})\b", r"\b(935)(\d{3,5})\b"]
DUTY_TOTAL = [rf"GDT[\s\S]{{0,120}}?\b(602)\s+({MONEY3})", rf"\b(602)\s+({MONEY3})\b"]
FOB_AND_CUSTOMS = rf"\bFOB\b[^\d]{{0,40}}({MONEY3})\b[\s\S]{{0,120}}?\bDOUANE\b[^\d]{{0,40}}({MONEY3})\b"
REGIME = [r"\bREGIME\b(?!\s+DOUAN)(?!\s*S\b)[^\d]{0,18}(\d{2})\b", r"\bREGIME\s+\d+\b[^\d]{0,12}(\d{2})\b", r"(?:CODE\s+)?QCI\b[\s\S]{0,100}?\bREGIME\b[^\d]{0,18}(\d{2})\b"]
NOT_REGIMES = ["36", "53", "62", "32", "21", "11"]
WEIGHTS_TO_FOB = r"POIDS\s+NET[\s\S]{0,280}?\bFOB\b"
COUNTRIES = {"TN": "TUNISIE", "DE": "ALLEMAGNE", "FR": "FRANCE", "IT": "ITALIE", "ES": "ESPAGNE", "BE": "BELGIQUE", "US": "USA", "CN": "CHINE", "TR": "TURQUIE", "NL": "PAYS BAS", "GB": "ROYAUME UNI"}
COUNTRY = r"\b(TN|1N|TM|DE|FR|US|IT|ES|BE|CN|TR|NL|GB)\s+(?:TUNISIE|FRANCE|ALLEMAGNE|U\.?\s*S\.?\s*A\.?|USA|ITALIE|ESPAGNE|BELGIQUE|CHINE|TURQUIE|PAYS\s+BAS|ROYAUME\s+UNI)(?![A-Z])"
COUNTRY_LABELS = {"origin": r"PAYS\s+(?:DE\s+)?PROVENANCE", "purchase": r"PAYS\s+D[' ]?ACHAT", "first_destination": r"PREMIERE\s+DESTINATION", "final_destination": r"DESTINATION\s+DEFINITIVE"}
TITLE = r"T(?:I|[1L!|])TRE\s+CE"
LABELLED_TITLE = r"CODE\s+TITRE\s+CE[^\d]{0,55}(\d{1,3})\b[\s\S]{0,300}?NUMERO\s+TITRE\s+CE[^\d]{0,55}(\d{5,12})\b"
# The patterns of a title, each behind the words without which it can't match; it begins with the first.
TITLES = [
    (["CODE", "TRE"], rf"CODE\s+{TITLE}[^\d]{{0,55}}(\d{{1,3}})\b[\s\S]{{0,300}}?(?:N\s*[°O0]?\s*|NUM\s*E?RO\s*){TITLE}[^\d]{{0,55}}(\d{{5,12}})\b"), (["CODE", "TITRE"], LABELLED_TITLE),
    (["43", "44"], r"\b43\b[^\d]{0,45}(\d{1,3})\b[\s\S]{0,120}?\b44\b[^\d]{0,45}(\d{5,12})\b"),
    (["532", "21", "11"], r"\b532\b\D{0,650}?(\d{1,3})\D{0,55}(\d{6,8})\b[\s\S]{0,220}?\b21\b\D{0,40}\b11\b"), (["362", "532", "21", "11"], r"\b362\b[\s\S]{0,180}?\b532\b[\s\S]{0,650}?(\d{1,3})\D{0,55}(\d{6,8})\b[\s\S]{0,220}?\b21\b\D{0,40}\b11\b"),
]
ROW = r"\b([1-9]\d?)\s+((?:\d\s*){8,12})\s+([A-Z]{1,3})\s+(\d{3,12}[,.]\d{3})"
LINE_AND_CODE = r"(?m)^\s*([1-9]\d?)\s+(\d{4}\s?\d{2}\s?\d{2}(?:\s?\d{2,3})?)\b"
PRICED = r"^\s*([1-9]\d?)\s+(\d{8,11})\s+(.{2,120}?)\s+(\d+(?:[.,]\d+)?)\s+(KG|U|PCE|PCS|M|L|T)\s+(\d+(?:[.,]\d+)?)\s*$"
# Rows of duties, amounts with their currency, conversion rates.
DUTY = r"\b(\d{3})\s+(\d{1,10}[,.]\d{3})\s+(\d{1,6}[,.]\d{6})\s+(\d{1,10}[,.]\d{3})"
MONEY = r"\b(USD|EUR|GBP|TND|CHF|JPY|CAD)\s+(\d{3,12}[,.]\d{3})\b"
CONVERSION = r"(?:CONVERSION|FACTURATION|EXPORT)[\s\S]{0,220}?(\d{1,2}[,.]\d{6,8})\s+(\d{4,12}\s*[,.]\s*\d{3})"
RATE_ONLY = r"\b(?:TAUX|CONVERSION)\b[^\d]{0,40}(\d{1,2}[,.]\d{6,8})\b"
# Details of an article: the words that a pattern begins with, the pattern, and the fields of its groups.
QCS = r"(?:CODE\s+Q(?:CS|C5)|QCS|QC5|ACS)[\s\S]{0,140}?\b(0?\d{1,2})\s+(\d{1,4})\s+(\d{3,12}[,.]\d{3})"
REGIMES = r"(?:REGIMES?|DOUANIERS?)[\s\S]{0,180}?\b(\d{3})\s+(\d{3})\b"
WEIGHTS = r"P(?:OI|O|OTA|OR)DS\s*BRUT[^\d]{0,70}(\d{1,5})[\s\S]{0,120}?P(?:OI|O|OTA|OR)DS\s*NET[^\d]{0,70}(\d{1,5})(?:[\s\S]{0,100}?(?:QUALITE|FISCALE)[^\d]{0,60}(\d{1,2}))?"
FINANCE = [r"(?:CREG|C\.REG|REGLEMENT|REGIEMENT|FINANCIER)[^\d]{0,80}(\d{2})[\s\S]{0,100}?DELAI[^\d]{0,80}(\d{1,2})\b", r"(?:REGLEMENT|REGIEMENT|FINANCIER|CREG|C\.REG)[\s\S]{0,160}?\b(\d{2})\s+(\d{1,2})\b"]
OCI = r"(?:CODE\s+[QO]CI|\b[QO]CI\b)[^\d]{0,40}(\d{1,3})\b"
REGULATION = ["CREG", "C.REG", "REGLEMENT", "REGIEMENT", "FINANCIER"]
ARTICLE_DETAILS = [(["CODE", "QCS", "QC5", "ACS"], QCS, ["code_qcs", "qcs", "pfn"]), (["REGIME", "DOUANIER"], REGIMES, ["regime", "previous_regime"]), (["POIDS", "PODS", "POTADS", "PORDS"], WEIGHTS, ["gross", "net", "fiscal_quality"]), (["CODE", "QCI", "OCI"], OCI, ["oci"])]
NOT_OCI = ["21", "11", "56"]
TITLE_22 = r"\b(22)\s+[|<]?\s*(\d{6,8})\b"
MARK = "\x01\x02"
#: Characters of an article's window, of the shortest row, and what an array may have of rows.
WINDOW, SHORTEST_ROW, MOST_ROWS = 1300, 19, 2**30


def groups(text: Column, pattern: str, n: int) -> Column:
    """The n groups of the first match: an array, '' for a group that took no part; null without a match. The pattern is searched once;
    its groups come from a second run over the match alone, which ends where the first one did."""
    # An array of one string is filtered, so that the search is bound, however often its result is read.
    match = F.filter(F.array(F.regexp_extract(text, pattern, 0)), lambda w: w != "")
    return F.get(F.transform(match, lambda w: F.split(F.regexp_replace(w, f"^(?:{pattern})$", MARK.join(f"${i}" for i in range(1, n + 1))), MARK)), F.lit(0))


def near(text: Column, *words: str) -> Column:
    """The text from the first of the words that patterns over it begin with (and one character before it); null without any. Finding
    a word costs next to nothing beside running a pattern over the text before it; that it isn't there is told faster than where it is."""
    places = [F.when(text.contains(w), F.instr(text, w)) for w in words]
    return F.substr(text, (places[0] if len(places) == 1 else F.least(*places)) - 1)


class Matches:
    """A text and the groups of patterns in it, each pattern run once: `of` is a column for each, made in one projection."""

    def __init__(self, text: Column):
        self.text, self.columns, self.known = text, {}, {}

    def of(self, pattern: str, n: int, text: Column | None = None) -> Callable[[int], Column]:
        """The groups of a pattern by number, null where empty or without a match."""
        text = self.text if text is None else text
        # Parts may ask for the same pattern over the same text.
        name = self.known.setdefault((pattern, n, str(text)), f"_m{len(self.columns)}")
        if name not in self.columns:
            self.columns[name] = groups(text, pattern, n)
        return lambda i: F.nullif(F.get(F.col(name), F.lit(i - 1)), F.lit(""))

    def once(self, value: Column) -> Column:
        """A value that is read several times."""
        name = f"_m{len(self.columns)}"
        self.columns[name] = value
        return F.col(name)


def found(text: Column, pattern: str, group: int = 1) -> Column:
    """The first match's group, null where there is none."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def any_of(text: Column, patterns: list[str], group: int = 1) -> Column:
    return F.coalesce(*[found(text, p, group) for p in patterns])


def printed_box(c: Column) -> Column:
    """Whether a number is one of those printed on the form's boxes (5 to 24, 30 to 67), not a value."""
    n = c.cast("int")
    return ~c.startswith("0") & (n.between(5, 24) | n.between(30, 67))


def bounded(c: Column, low: int, high: int) -> Column:
    return F.when(c.cast("int").between(low, high) & ~printed_box(c), c.cast("int"))


def first_day(text: Column, pattern: str, group: int = 1) -> Column:
    """The first match whose date exists."""
    days = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), normalize_date)
    return F.get(F.filter(days, lambda x: x.isNotNull()), F.lit(0))


def folded(docs: DataFrame, name: str = "_t", of: str = "text") -> DataFrame:
    """docs (text) with the folded text. It isn't inlined into the patterns: they are many, and folding isn't cheap."""
    return docs.withColumn(name, fold_text(F.col(of)))


def fields(docs: DataFrame, part: Callable) -> DataFrame:
    """docs (.., text) with the columns of a part of the declaration, e.g. fields(docs, header_fields)."""
    m = Matches(F.col("_t"))
    wanted = part(m)
    return folded(docs).withColumns(m.columns).select(*docs.columns, *[c.alias(k) for k, c in wanted.items()])


def header_fields(m: Matches) -> dict[str, Column]:
    """Number, date, type, counts of articles and packages, exporter's code; but for packages from the first 3,000 characters."""
    whole, head = m.text, F.substring(m.text, 1, 3000)
    both = F.transform(F.regexp_extract_all(head, F.lit(NUMBER_AND_DAY), F.lit(0)), lambda x: F.struct(F.substring(x, 1, 6).alias("n"), normalize_date(F.substring(x, -10, 10)).alias("d")))
    pair = m.once(F.get(F.filter(both, lambda x: x["d"].isNotNull()), F.lit(0)))
    kind = F.coalesce(found(near(head, "TYPE"), rf"TYPE\s+(?:DECLARATION|ESCIATATION)[\s\S]{{0,160}}?\b({KIND})\b"), found(head, rf"\b({BARE_KIND})\b\s+\d{{1,3}}\s+\d{{1,4}}\b"))
    counts = m.of(COUNTS, 2, head)
    return {
        "number": F.coalesce(pair["n"], found(head, r"(?:DECLARATION|NUMERO|N[°O]?)\D{0,90}\b(\d{6})\b")),
        "date": F.coalesce(pair["d"], normalize_date(found(near(head, "DATE", "DECLARATION"), rf"(?:DATE|DECLARATION)\D{{0,120}}\b({DAY})\b"))),
        "type": F.regexp_replace(kind, r"\s+", ""),
        "articles": bounded(counts(1), 1, 99),
        "packages": F.coalesce(bounded(counts(2), 1, 999), F.coalesce(found(near(whole, "99999"), r"\b99999\s+(\d{1,4})\b"), found(near(whole, "NBRE", "NOMBRE", "BRE"), r"\b(?:NBRE|NOMBRE|BRE)\s*COLIS[^\d]{0,40}(\d{1,4})\b")).cast("int")),
        "exporter_code": found(head, r"\b(\d{6,8}[A-Z])\b"),
    }


def transport_fields(m: Matches) -> dict[str, Column]:
    """Vehicle, modes, arrival and terms. A flight outweighs a ship, a ship named with its mode outweighs both."""
    t = m.text
    vessels = SHIP.split("|")
    ship, flight = m.once(found(near(t, *vessels), rf"\b({SHIP})\b")), m.once(F.coalesce(near(t, "VOL").rlike(r"\bVOL\s+DU\b"), F.lit(False)))
    terms = near(t, *TERMS.split("|"))
    long, short = m.of(LONG_TERMS, 3, F.when(t.contains("PAIEMENT"), terms)), m.of(SHORT_TERMS, 3, terms)
    small = lambda g: F.when(short(g).cast("int").between(1, 9), short(g))
    named = long(1).isNotNull()
    return {
        "vehicle": F.when(flight, "VOL DU").when(ship == "BATEAU", "BATEAU").when(ship.isNotNull(), "NAVIRE"),
        "mode": F.when(ship.isNotNull() & t.rlike(rf"\bT?N\s+7\s+(?:{SHIP})\b"), "7 - MARITIME").when(flight, "2 - AERIEN").when(ship.isNotNull(), "7 - MARITIME"),
        "national_mode": F.when(t.contains("CAMION") & t.rlike(r"\bT?N\s+4\s+CAMION\b"), "4 - ROUTIER"),
        "arrival": first_day(near(t, *vessels, "VOL"), rf"\b(?:{SHIP}|VOL\s+DU)\b[\s\S]{{0,260}}?({DAY})"),
        "terms": F.coalesce(long(1), short(1)),
        "payment": F.when(named, long(2)).otherwise(small(2)), "relation": F.when(named, long(3)).otherwise(small(3)),
    }


def route(text: Column) -> Column:
    """The first A-B that names one of the known places and isn't a label."""
    pairs = F.transform(F.regexp_extract_all(text, F.lit(r"\b([A-Z]{2,12}\s*-\s*[A-Z]{2,12})\b"), F.lit(1)), lambda x: F.regexp_replace(F.regexp_replace(x, r"\s*-\s*", "-"), "^FAX-", "SFAX-"))
    return F.get(F.filter(pairs, lambda x: x.rlike("SFAX|RADES|TUNIS|TC") & ~x.rlike("COLIS|BUREAU|LOCALISATION|FRET|ASSURANCE|BR-")), F.lit(0))


def liquidation_fields(m: Matches) -> dict[str, Column]:
    t = m.text
    first, second = (m.of(p, 2, near(t, word)) for p, word in zip(DUTY_TOTAL, ("GDT", "602")))
    office, movement, key = m.of(OFFICE, 2, F.when(t.contains("BR"), t)), m.of(MOVEMENT, 3, F.when(t.contains("PORT") | t.contains("TRANSIT"), t)), m.of(KEY, 2)
    apart, glued = (m.of(p, 2, near(t, "935")) for p in APPROVAL)
    return {
        "duty_code": F.coalesce(first(1), second(1)), "duty_total": clean_amount(F.coalesce(first(2), second(2))), "office_code": office(1), "office": F.concat(F.lit("BR - "), office(2)),
        "border_office": movement(1), "destination": movement(2), "movement": movement(3), "route": route(t), "approval": F.coalesce(apart(1), glued(1)), "directory": F.coalesce(apart(2), glued(2)), "auth_key": key(1), "qr_code": key(2),
    }


def country_label(code: Column) -> Column:
    plain = F.when(code.isin("1N", "TM", "T"), "TN").otherwise(code)
    names = F.create_map(*[F.lit(x) for pair in COUNTRIES.items() for x in pair])
    return F.concat_ws(" ", plain, names[plain])


def country_fields(m: Matches) -> dict[str, Column]:
    """The country after each label, within 260 characters."""
    codes = {name: m.once(found(near(m.text, label.partition("\\")[0]), rf"{label}[\s\S]{{0,240}}?{COUNTRY}")) for name, label in COUNTRY_LABELS.items()}
    return {name: F.when(code.isNotNull(), country_label(code)) for name, code in codes.items()}


def article_value_fields(m: Matches) -> dict[str, Column]:
    t = m.text
    known = [m.once(found(near(t, *words), p)) for words, p in zip((["REGIME"], ["REGIME"], ["CODE", "QCI"]), REGIME)]
    block, both = m.once(found(near(t, "POIDS"), WEIGHTS_TO_FOB, 0)), m.of(FOB_AND_CUSTOMS, 2, near(t, "FOB"))
    point = lambda c: F.replace(c, F.lit(","), F.lit("."))
    return {
        "fob": clean_amount(F.coalesce(both(1), found(near(t, "FOB", "VALEUR"), rf"\b(?:FOB|VALEUR\s+EN\s+DINARS)\b[^\d]{{0,50}}({MONEY3})\b"))),
        "customs": clean_amount(F.coalesce(both(2), found(near(t, "DOUANE"), rf"\bDOUANE\b[^\d]{{0,50}}({MONEY3})\b"))),
        "regime": F.coalesce(*[F.when(~c.isin(NOT_REGIMES), c) for c in known], found(block, r"\bREGIME\b[^\d]{0,18}(\d{2})\b"), found(block, r"\b([1-5][0-9])\b"), found(near(t, "REGIME"), r"\bREGIME\b(?!\s+DOUAN)[^\d]{0,18}(\d{2})\b")),
        "adjustment": point(found(near(t, "COEF"), r"\bCOEF(?:FICIENT)?\.?\s*(?:D['’]?\s*)?AJUSTEMENT\b[^\d]{0,30}(\d{1,3}(?:[.,]\d{1,6})?)\b")),
    }


def _pair(text: Column, pattern: str) -> Column:
    """struct(code, number) of a pattern's two groups, null without a match."""
    return F.get(F.transform(F.array(groups(text, pattern, 2)), lambda g: F.when(g.isNotNull(), F.struct(g[0].alias("code"), g[1].alias("number")))), F.lit(0))


def labelled_title(t: Column) -> Column:
    """struct(code, number) behind both labels in full, as it is: labels outweigh that a number looks like a tariff heading."""
    labelled = LABELLED_TITLE.replace("{0,55}", "{0,50}").replace("{0,300}", "{0,220}")
    return F.when(t.contains("TITRE"), _pair(near(t, "CODE"), labelled))


def title_pair(t: Column) -> Column:
    """struct(code, number) by the first pattern whose pair is plausible; null if none is."""

    def plausible(x: Column) -> Column:
        # Codes 01 to 21 with two digits, and 56, are other boxes; so are numbers that begin with a tariff heading.
        n = x["code"].cast("int")
        other = n.between(1, 21) & (F.length(x["code"]) == 2) | (x["code"] == "56") | ~n.between(1, 99)
        return ~other & x["number"].cast("long").between(100_000, 99_999_999) & ~x["number"].rlike("^(880|854)")

    good = lambda first, p: F.get(F.filter(F.array(_pair(near(t, first), p)), lambda x: x.isNotNull() & plausible(x)), F.lit(0))
    there = lambda words: reduce(and_, [t.contains(w) for w in words])
    return F.coalesce(*[F.when(there(words), good(words[0], p)) for words, p in TITLES])


def article_rows(docs: DataFrame) -> DataFrame:
    """docs (.., _t) with articles: an array of (line, hs, country, amount, window) of the rows `line HS country value` of the folded
    text, each with 1,300 characters from where it begins; of rows that repeat line, code and value the first."""

    begin, end = MARK
    plain = F.replace(F.replace(F.col("_t"), F.lit(begin), F.lit("\x03")), F.lit(end), F.lit("\x04"))
    # The text is cut before each row, behind the row's groups; a window is its piece and those after it, which are 20 characters at least.
    pieces = F.slice(F.split(F.regexp_replace(plain, ROW, f"{begin}$1{end}$2{end}$3{end}$4{end}$0"), begin), 2, MOST_ROWS)
    docs = docs.withColumn("articles", F.transform(pieces, lambda p: F.split(p, end)))
    docs = docs.withColumn("_texts", F.transform("articles", lambda g: F.substring(g[4], 1, WINDOW)))

    def told(g: Column, i: Column) -> Column:
        window = F.substring(F.array_join(F.slice("_texts", i + 1, WINDOW // SHORTEST_ROW + 1), ""), 1, WINDOW)
        return F.struct(g[0].cast("int").alias("line"), F.regexp_replace(g[1], r"\s+", "").alias("hs"), g[2].alias("country"), clean_amount(g[3]).alias("amount"), window.alias("window"))

    docs = docs.withColumn("articles", F.transform("articles", told)).drop("_texts")
    docs = docs.withColumn("_keys", F.transform("articles", lambda a: F.concat_ws(" ", a["line"], a["hs"], a["amount"])))
    return docs.withColumn("articles", F.filter("articles", lambda a, i: F.array_position("_keys", F.get("_keys", i)) == i + 1)).drop("_keys")


def details(rows: DataFrame) -> DataFrame:
    """rows (.., window) with the details of an article that its window tells."""
    w = F.col("window")
    parts = {f"_d{i}": groups(near(w, *words), p, len(names)) for i, (words, p, names) in enumerate(ARTICLE_DETAILS)}
    finance = [groups(near(w, *REGULATION), p, 2) for p in FINANCE]
    title = F.coalesce(labelled_title(w), _pair(near(w, "22"), TITLE_22), title_pair(w))
    rows = rows.withColumns(parts | {"_finance": F.coalesce(*finance), "title": title})
    at = lambda c, i: F.nullif(F.get(F.col(c), F.lit(i)), F.lit(""))
    told = {name: at(f"_d{k}", i) for k, (_, _, names) in enumerate(ARTICLE_DETAILS) for i, name in enumerate(names)}
    gross, net, quality, oci = (told[k] for k in ("gross", "net", "fiscal_quality", "oci"))
    real = (net.cast("int") > 0) & (gross.cast("int") >= net.cast("int")) & ~printed_box(gross) & ~printed_box(net)
    told |= {"code_qcs": F.lpad(told["code_qcs"], 2, "0"), "pfn": clean_amount(told["pfn"]), "gross": F.when(real, gross), "net": F.when(real, net), "fiscal_quality": F.when(real & ~printed_box(quality), quality), "oci": F.when(~printed_box(oci) & ~oci.isin(NOT_OCI), oci)}
    return rows.withColumns(told | {"financial_regime": at("_finance", 0), "delay": at("_finance", 1)}).drop(*parts, "_finance")


DETAILS = ["line", "hs", "country", "value", *[n for _, _, names in ARTICLE_DETAILS for n in names], "financial_regime", "delay", "title"]


def articles(docs: DataFrame) -> DataFrame:
    """(id, position, line, hs, country, value and details) of all article rows of docs (id, text): no shuffle, repeats are told within
    a text."""
    # An outer generator: for another one Spark would look at its input, patterns and all, once more to see whether it is empty.
    rows = article_rows(folded(docs)).select("id", F.posexplode_outer("articles").alias("position", "r")).where("r is not null").select("id", "position", "r.*")
    return details(rows).withColumn("value", F.col("amount").try_cast("double")).select("id", "position", *DETAILS)


def text_articles(docs: DataFrame) -> DataFrame:
    """(id, position, num_ligne, code_hs): rows of a text that tell a line and an HS code, without the rest; repeats go."""
    rows = F.transform(F.regexp_extract_all("_t", F.lit(LINE_AND_CODE), F.lit(0)), lambda r: F.split(F.trim(r), r"\s+", 2))
    once = F.array_distinct(F.transform(rows, lambda r: F.struct(r[0].cast("int").alias("num_ligne"), F.regexp_replace(r[1], r"\s+", "").alias("code_hs"))))
    return folded(docs).select("id", F.posexplode_outer(once).alias("position", "r")).where("r is not null").select("id", "position", "r.*")


def priced_lines(lines: DataFrame) -> DataFrame:
    """lines (.., line) of the single-line form `line HS designation quantity unit total` with its fields and the unit price, the
    total by the quantity to 6 digits; null where a line isn't of that form."""
    out = lines.withColumn("_t", groups(fold_text(F.col("line")), PRICED, 6))
    part = lambda i: F.get(F.col("_t"), F.lit(i - 1))
    out = out.withColumns({"num_ligne": part(1).cast("int"), "code_hs": part(2), "designation": F.trim(part(3)), "quantite": parse_amount(part(4)), "unite": part(5), "total_ligne": parse_amount(part(6))})
    return out.withColumn("prix_unitaire", F.when(F.col("quantite") > 0, F.round(F.col("total_ligne") / F.col("quantite"), 6))).drop("_t")


def financial_fields(m: Matches) -> dict[str, Column]:
    """Currency and amount; conversion rate and total, or, where no total is told, amount by rate to 3 digits."""
    t = m.text
    words = ["CONVERSION", "FACTURATION", "EXPORT"]
    money, conversion, both = m.of(MONEY, 2, near(t, "USD", "EUR", "GBP", "TND", "CHF", "JPY", "CAD")), m.of(CONVERSION, 2, near(t, *words)), m.of(FOB_AND_CUSTOMS, 2, near(t, "FOB"))
    amount, total = clean_amount(money(2)), clean_amount(F.regexp_replace(conversion(2), r"\s+", ""))
    rate = m.once(F.coalesce(clean_amount(conversion(1)), clean_amount(found(near(t, "TAUX", "CONVERSION"), RATE_ONLY))))
    made = F.format_string("%.3f", amount.try_cast("double") * rate.try_cast("double"))
    told = F.coalesce(total, clean_amount(both(1)))
    computed = amount.try_cast("double") * rate.try_cast("double")
    low = total.isNull() & computed.isNotNull() & (told.isNull() | (told.try_cast("double") < 0.8 * computed))
    return {"currency": money(1), "amount": amount, "rate": rate, "total": F.when(low, made).otherwise(told)}


def tax_rows(t: Column) -> Column:
    """An array of (code, base, rate, amount): the rows of duties."""
    return F.transform(F.regexp_extract_all(t, F.lit(DUTY), F.lit(0)), lambda r: F.struct(*[F.get(F.split(r, r"\s+"), F.lit(i)).alias(c) for i, c in enumerate(["code", "base", "rate", "amount"])]))


# Forms and words of the invoice's print.
INVOICE, RECENT = r"(?i)\b(FA\d{6,10})\b", r"\d{2}/\d{2}/20(?:2[4-9]|3\d)"
TOTALS_ROW = r"(?i)Gross\s+Discount\s+Amount\s+All\s+Taxes\s+Included\s+NET\s+PAY([\s\S]{0,400})"
TOTALS_BLOCK = r"(?i)(Gross[\s\S]{0,900}?)(?=Package\s*Number|PB\s+in\s+Kg|Paiment\s+Term|Virement|Total\s+VAT)"
LARGE = r"(\d{1,2}\s+\d{3}[,.]\d{2}|\d{4,6}[,.]\d{2})"
NET_PAY = [r"(?i)(?<![A-Z])NET\s*PAY\s*[\s:.-]*([0-9][0-9\s ]*[,.]\d{2})", r"(?i)(?<![A-Z])NET\s*PAY[^\n]{0,12}\n\s*([0-9][0-9\s ]*[,.]\d{2})"]


def invoice_fields(text: Column) -> dict[str, Column]:
    """Header fields of an invoice, its total, and confidence: a map of the fields that were found."""
    number = F.upper(found(text, INVOICE))
    # In a row: the invoice's number, then a date; a labelled date; any date that isn't part of a form's reference.
    near, labelled = found(text, rf"(?i)\bFA\d{{6,10}}\b[\s\S]{{0,120}}?({RECENT})"), found(text, rf"(?im)^\s*Date\s*[:\s]*({RECENT})")
    free = F.get(F.regexp_extract_all(text, F.lit(rf"(?i)(?<!FOR-COM.{{0,37}}|/00/20/.{{0,34}})\b({RECENT})\b"), F.lit(1)), F.lit(0))
    date = F.coalesce(near, labelled, free)
    currency = F.when(text.contains("$") | text.rlike(r"(?i)\bUSD\b"), "USD").when(text.contains("€") | text.rlike(r"(?i)\bEUR\b"), "EUR").when(text.rlike(r"(?i)\bTND\b"), "TND").otherwise("EUR")
    large = lambda c: F.array_max(F.filter(F.transform(F.regexp_extract_all(c, F.lit(LARGE), F.lit(1)), amount_eu), lambda x: x >= 1000))
    labels = F.concat(*[F.transform(F.regexp_extract_all(text, F.lit(p), F.lit(1)), amount_eu) for p in NET_PAY])
    total = F.coalesce(large(found(text, TOTALS_ROW)), large(found(text, TOTALS_BLOCK)), F.get(F.filter(labels, lambda x: x >= 1000), F.lit(0)))
    fields = {
        "number": number, "date": date, "currency": currency, "client": F.concat(F.lit("CL"), found(text, r"(?i)\bCL\s*(\d{2,5})\b")),
        "tax_id": F.coalesce(found(text, r"(?i)Matricule\s+Fiscal\s*[:\s]*([A-Z]{2}\d{9,11})"), found(text, r"\b(DE\d{9,11})\b")),
        "incoterm": F.upper(found(text, r"(?i)Incoterm[se]?\s*[:\s*]*([A-Z]{3})")), "payment": F.substring(F.trim(found(text, r"(?i)(Virement\s+[^\n]+|Payment\s+Term\s*[:\s]*[^\n]+)")), 1, 256), "net_pay": total,
    }
    numbered = lambda p: found(text, p)
    note = F.concat_ws(" | ", F.concat(F.lit("Devis "), F.regexp_replace(numbered(r"(?i)quotes\s*N°?\s*[:\s]*([A-Z0-9/\-]+)"), "/+$", "")), F.concat(F.lit("BL"), numbered(r"(?i)(?:Delivery\s*/\s*)?BL\s*(\d{6,10})")), F.trim(numbered(r"(?i)notes\s*N°\s*[:\s]*([^\n]+)")))
    weight = lambda a, b: amount_eu(numbered(rf"(?i)(?:{a}\s+in\s+Kg|{b}\s+Weight)\s*[:\s]*([0-9\s]+[,.]\d{{2}})"))
    party = lambda what: F.trim(F.regexp_replace(numbered(rf"(?is){what}\s+Adress\s*:?\s*(.{{10,200}}?)(?=\n\s*\n|Expedition\s+Adress|Delivery\s+Adress|Belling\s+Adress|$)"), r"\s+", " "))
    fields |= {
        "notes": F.nullif(F.substring(note, 1, 2000), F.lit("")), "transport": F.substring(F.trim(numbered(r"(?i)Incoterme?\s*[:\s*]*[A-Z]{3}\.\s*([A-Za-z]+)")), 1, 128), "packages": numbered(r"(?i)Package\s*Number\s*[:\s]*(\d+)").try_cast("int"), "gross": weight("PB", "Gross"), "net": weight("PN", "Net"),
        "client_name": F.trim(F.regexp_replace(numbered(r"(?i)CL\s*\d{2,5}\s+([A-Z][A-Za-z0-9\s&.,'\-]{2,60}(?:GmbH|KG|SARL|SA|Inc|LLC)\b)"), r"\s+", " ")), "billing_address": party("Belling"), "shipping_address": party("Expedition"), "delivery_address": party("Delivery"),
    }
    day = F.when(near.isNotNull(), 0.92).when(labelled.isNotNull(), 0.88).otherwise(0.72)
    sure = {"number": 0.9, "date": day, "currency": 0.75, "client": 0.8, "tax_id": 0.82, "incoterm": 0.85, "payment": 0.55, "net_pay": 0.8, "notes": 0.7, "packages": 0.75, "gross": 0.75, "net": 0.75, "client_name": 0.72, "billing_address": 0.68, "shipping_address": 0.75, "delivery_address": 0.7}
    pairs = [x for name, c in sure.items() for x in (F.lit(name), F.when(fields[name].isNotNull(), c))]
    return fields | {"confidence": F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull())}


# Labels around parties, with the readings they often get, and what a company's line holds or doesn't.
PARTY_WINDOWS = {
    "exporter": r"\b(?:EXPORTATEUR|EXPORTATEWR|XP0RTATEUR|EXPORTATEU\b)\b([\s\S]{0,280}?)(?=IMPORTATEUR|IMPORTATEWR|IPORTATEUR|LMPORTATEUR|IMMPONATEUR|DECLARANT)",
    "importer": r"\b(?:IMPORTATEUR|IMPORTATEWR|IMPORTAT|IPORTATEUR|LMPORTATEUR|IMMPONATEUR)\b([\s\S]{0,240}?)(?=DECLARANT|ADRESSE|PAYS\s+DE|MOYEN)",
    "declarant": r"\bDECLARANT\b([\s\S]{0,320}?)(?=MOYEN|PAYS|ADRESSE|TRANSPORT|IMPORTATEUR|$)",
}
PARTY_WORDS = {"exporter": ["EXPORTA", "XP0RTA"], "importer": ["IMPORTAT", "IPORTAT", "LMPORTAT", "IMMPONA"], "declarant": ["DECLARANT"]}
COMPANY, CODE_AND_NAME = r"\b(?:GMBH|B\.V|BV|SARL|SA|STE|SYSTEMS|SYSTEME|PRECISION|MACHINING|EQUIPEMENTS)\b", r"\b\d{3,5}\s*[:;]\s*[A-Z]"
PARTY_NOISE = r"\b(?:CERTIFICAT|NUMERO|DECLARATION|BECLARATION|DATE|TYPE\s+DECLARATION|NBRE\s+TOTAL)\b"


def _score(t: Column) -> Column:
    noise, length = F.regexp_count(t, F.lit(PARTY_NOISE)), F.length(t)
    score = F.length(F.regexp_replace(t, "[^A-Z]", "")) + F.when(t.rlike(CODE_AND_NAME), 85).otherwise(0) + F.when(t.rlike(COMPANY), 35).otherwise(0) - 60 * noise - F.when(length > 140, 125).when(length > 100, 45).otherwise(0)
    return F.when(t == "", -999).otherwise(score)


def party_score(line: Column) -> Column:
    """Letters of a line, more for a company's form or a code before the name, less for words of the form and for length."""
    # The folded line is bound once, for the score reads it often.
    return F.get(F.transform(F.array(F.coalesce(fold_text(line), F.lit(""))), _score), F.lit(0))


def best_party_line(window: Column, folded: bool = False) -> Column:
    """The line with at least six letters and the best score, the first of equals."""
    lines = F.transform(F.split(window, "\n"), lambda x: F.trim(F.regexp_replace(x, r"[\s|-]+", " ")))
    named = F.filter(lines, lambda x: (F.length(F.regexp_replace(F.upper(x), "[^A-Z]", "")) >= 6) & ~x.rlike(r"\bIMPORTATEUR\b"))
    scored = F.transform(named, lambda x, i: F.struct((_score if folded else party_score)(x).alias("score"), (-i).alias("place"), x.alias("line")))
    return F.array_max(scored)["line"]


def party_fields(m: Matches) -> dict[str, Column]:
    """Each party's best line between its label and the next, up to 200 characters or a six-digit number beyond the first 40."""
    cut = lambda w: F.substring(F.regexp_replace(w, r"(?s)^(.{40}.*?)(?<!:)\b\d{6}\b.*$", "$1"), 1, 200)
    return {name: best_party_line(cut(found(near(m.text, *PARTY_WORDS[name]), p)), folded=True) for name, p in PARTY_WINDOWS.items()}


# Labels that guide to fields, and words that aren't in a declarant's name.
DIRECTORY, CREDIT = r"\bREPERTOI?RE\b", r"\b(?:N[°O]?\s*C[RE]DIT|NUMERO\s+C[RE]DIT|CREDIT)\b"
SAME_ROW = r"\bBUREAU\s*FRONTI\w*\b[^\d]{0,20}(\d{1,3})[\s\S]{0,60}?\bDESTINATION\b[^\d]{0,20}(\d{1,4})[\s\S]{0,60}?\bLOCALIS\w*\b[^A-Z]{0,20}(EXPORT|IMPORT|TRANSIT)\b"
QUANTITIES = r"\bCODE\s+QCS\b[^\d]{0,20}(\d{1,3})[\s\S]{0,40}?\bQCS\b[^\d]{0,20}(\d{1,5})[\s\S]{0,40}?\bPFN\b[^\d]{0,20}(\d{1,12}(?:[.,]\d{1,3})?)"
DECLARANT_BLOCK = r"\bDECLARANT\b([\s\S]{0,220}?)(?:\bMOYEN\s+DE\s+TRANSPORT\b|$)"
NOT_DECLARANT = r"\b(?:REPERTOI?RE|CREDIT|N[°O]|CODE|TN|US|DE|FR|TYPE|DECLARATION|REGIME|TRANSPORT|RUE|AVENUE|SUITE|SFAX|TUNIS)\b"
GUIDED_COUNTRIES = {"guided_origin": r"PAYS\s+DE\s+PROVENANCE", "guided_purchase": r"PAYS\s+D['’ ]?\s*ACHAT", "guided_first_destination": r"PAYS\s+PREMIERE?\s+DESTINATION", "guided_final_destination": r"PAYS\s+DESTINATION\s+DEFINITIVE"}


def near_anchor(t: Column, anchor: str, low: int = 3, high: int = 10, within: int = 120) -> Column:
    """The first number of low to high digits, whole within so many characters after the anchor."""
    return found(F.substring(F.regexp_extract(t, rf"{anchor}([\s\S]{{0,{within}}})", 1), 1, within), rf"\b(\d{{{low},{high}}})\b")


def guided_fields(m: Matches) -> dict[str, Column]:
    """Fields near their labels. What the strict first pass finds isn't looked for again: the row of border office, destination and
    movement goes before each label on its own, a number in the window of a label before one right after it."""
    t = m.text
    after = lambda label, form, *words: found(near(t, *words) if words else t, rf"{label}{form}")
    same, quantities = m.of(SAME_ROW, 3, F.when(t.contains("LOCALIS"), near(t, "BUREAU"))), m.of(QUANTITIES, 3, F.when(t.contains("PFN"), near(t, "CODE")))
    credit = F.when(t.contains("DIT"), near(t, "N", "CREDIT"))
    one_row = lambda i, other: F.when(same(1).isNotNull(), same(i)).otherwise(other)

    def weight(name: str) -> Column:
        kilos = m.once(after(rf"\bPOIDS\s+{name}(?:\s*\(KG\))?\b", r"[^\d]{0,24}(\d{1,5})\b", "POIDS").cast("int"))
        return F.when(kilos.between(5, 99999), kilos.cast("string"))

    lines = F.transform(F.split(found(near(t, "DECLARANT"), DECLARANT_BLOCK), "\n"), lambda x: F.regexp_replace(F.regexp_replace(x, r"\s+", " "), r"^[ \-|:;,.]+|[ \-|:;,.]+$", ""))
    name = F.get(F.filter(lines, lambda x: F.length(x).between(4, 64) & ~x.rlike(NOT_DECLARANT) & ~x.rlike(r"^\d{3,6}\b") & (F.length(F.regexp_replace(x, "[^A-Z]", "")) >= 5)), F.lit(0))

    def country(label: str) -> Column:
        code = m.once(found(near(t, "PAYS"), rf"{label}[\s\S]{{0,120}}?\b({'|'.join(COUNTRIES)}|1N|TM)\b"))
        return F.when(code.isNotNull(), country_label(code))

    return {
        "directory": F.coalesce(near_anchor(near(t, "REPERT"), DIRECTORY, 3, 6), after(DIRECTORY, r"[^\d]{0,24}(\d{3,6})\b", "REPERT")), "credit": F.coalesce(near_anchor(credit, CREDIT, 4, 10), found(credit, rf"{CREDIT}[^\d]{{0,24}}(\d{{4,10}})\b")), "guided_declarant": name,
        "guided_office": one_row(1, near_anchor(near(t, "BUREAU"), r"\bBUREAU\s*FRONTI\w*\b", 1, 3)), "guided_destination": one_row(2, near_anchor(near(t, "DESTINATION"), r"\bDESTINATION\b", 1, 4)), "guided_movement": one_row(3, after(r"\bLOCALIS\w*\b", r"[\s\S]{0,60}?\b(EXPORT|IMPORT|TRANSIT)\b", "LOCALIS")),
        "code_qcs": quantities(1), "qcs": quantities(2), "pfn": F.replace(quantities(3), F.lit(","), F.lit(".")), "guided_gross": weight("BRUT"), "guided_net": weight("NET"),
        "stopover": after(r"N[°O]?\s*D['’]?\s*ESCALE", r"[^\d]{0,12}(\d{3,6})", "N"), "heading": after(r"\bRUBRIQUE\b", r"[^\d]{0,12}(\d{1,6})", "RUBRIQUE"),
        "financial_regime": after(r"\b(?:REG(?:LEMENT)?\s*FINANCIER|FINANCIER)\b", r"[^\d]{0,16}(\d{1,2})\b", "REG", "FINANCIER"), "delay": after(r"\b(?:CODE\s+)?DELAI\b", r"[^\d]{0,16}(\d{1,2})\b", "CODE", "DELAI"), "oci": after(r"\b(?:CODE\s+)?OCI\b", r"[^\d]{0,16}(\d{1,2})\b", "CODE", "OCI"),
    } | {name: country(label) for name, label in GUIDED_COUNTRIES.items()}
