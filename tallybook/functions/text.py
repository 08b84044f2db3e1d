"""References, names, units and other short texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import plain_dashes

#: Payment codes and their meaning.
PAYMENT_CODES = {
    "IW04": "30 days", "IW07": "60 days", "IW30": "30 days after BL", "IW60": "60 days after BL", "IW90": "90 days", "NT30": "30 days net", "NT60": "60 days net", "NT90": "90 days net",
    "N030": "30 days", "N060": "60 days", "0001": "14 days 2% / 30 days net", "ZB30": "30 days", "ZB60": "60 days",
}
#: Unit spellings and their unit.
UNITS = {
    "PCS": "PCS", "PC": "PCS", "PIECE": "PCS", "PIECES": "PCS", "SZT": "PCS", "SZTUKA": "PCS", "SZTUKI": "PCS", "SZTUK": "PCS", "EA": "PCS", "EACH": "PCS", "EACHES": "PCS", "UNIT": "PCS", "UNITS": "PCS",
    "CTN": "CTN", "CARTON": "CTN", "CARTONS": "CTN", "KARTON": "CTN", "KARTONY": "CTN", "KAR": "CTN", "BOX": "CTN", "BOXES": "CTN",
    "OP": "OP", "OPAKOWANIE": "OP", "OPAKOWANIA": "OP", "PACK": "OP", "PACKS": "OP", "PKG": "OP", "OPZ": "OPZ",
    "PAL": "PAL", "PALLET": "PAL", "PALLETS": "PAL", "PALETA": "PAL", "PALETY": "PAL", "SET": "SET", "SETS": "SET", "KPL": "SET", "ZESTAW": "SET", "ZESTAWY": "SET",
}
#: Legal forms by their spelled form; order matters.
LEGAL_FORMS = (("SP Z O O", "SPZOO"), ("SP ZO O", "SPZOO"), ("S A", "SA"), ("LIMITED", "LTD"), ("CO KG", "COKG"))
#: Characters that scans exchange.
CONFUSABLE = (("I", "1"), ("i", "1"), ("l", "1"), ("O", "0"), ("o", "0"), ("S", "5"), ("s", "5"), ("B", "8"), ("Z", "2"), ("G", "6"))


def _map(pairs: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for p in pairs.items() for x in p))


def loose_ref(s: Column) -> Column:
    """Upper case without white space, dashes, underscores and slashes; zeros and dots stay."""
    return F.regexp_replace(F.upper(plain_dashes(F.coalesce(s, F.lit("")))), r"[\s\-_/]", "")


def strict_ref(s: Column) -> Column:
    """Upper case letters A-Z and digits only."""
    return F.regexp_replace(F.upper(F.coalesce(s, F.lit(""))), "[^A-Z0-9]", "")


def listed_ref(s: Column) -> Column:
    """Without a leading ordinal (12. AB-1), single blanks, upper case; separators stay."""
    return F.upper(F.trim(F.regexp_replace(F.regexp_replace(s, r"^\s*[0-9]{1,3}\.\s+", ""), r"\s+", " ")))


def company_name(s: Column) -> Column:
    """Upper case, no punctuation, single blanks, legal forms in one spelling."""
    out = F.trim(F.regexp_replace(F.regexp_replace(F.upper(s), r"[.,;:\-]", " "), r"\s+", " "))
    for spelled, short in LEGAL_FORMS:
        out = F.replace(out, F.lit(spelled), F.lit(short))
    return out


def payment_terms(s: Column, codes: dict[str, str] | None = None) -> Column:
    """A code's meaning, else "N days" found in the text, else the text; blank if there is none."""
    named = _map(codes or PAYMENT_CODES)
    t = F.trim(F.coalesce(s, F.lit("")))
    days = F.regexp_extract(t, r"(?i)([0-9]+)\s*days?", 1)
    return F.coalesce(F.try_element_at(named, t), F.try_element_at(named, F.upper(t)), F.when(days != "", F.concat(days, F.lit(" days"))), t)


def payment_codes(s: Column, codes: dict[str, str] | None = None) -> Column:
    """Sorted codes of a payment term: those that mean exactly it, else itself if it is a code, else those of its number of days."""
    codes = codes or PAYMENT_CODES
    of = lambda term: F.array_compact(F.array(*(F.when(F.lower(term) == meaning.lower(), F.lit(code)) for code, meaning in sorted(codes.items()))))
    t = F.trim(F.coalesce(s, F.lit("")))
    exact = of(t)
    return F.when(F.size(exact) > 0, exact).when(F.upper(t).isin(*codes), F.array(F.upper(t))).otherwise(of(payment_terms(t, codes)))


def canonical_unit(s: Column) -> Column:
    """A unit's canonical spelling; a plural's last letter may go; unknown units stay as letters."""
    u = F.regexp_replace(F.upper(F.coalesce(s, F.lit(""))), "[^A-Z]", "")
    names = _map(UNITS)
    return F.coalesce(F.try_element_at(names, u), F.when((F.length(u) >= 3) & u.rlike("[SY]$"), F.try_element_at(names, F.regexp_replace(u, "[SY]$", ""))), u)


def bare_text(s: Column) -> Column:
    """Lower case with the usual accents folded and single blanks."""
    return F.trim(F.regexp_replace(F.lower(F.translate(s, "ąćęłńóśźżĄĆĘŁŃÓŚŹŻáàâäãéèêëíìîïòôöõúùûüçñÁÀÂÄÉÈÊËÍÎÏÔÖÚÙÛÜÇÑ", "acelnoszzACELNOSZZaaaaaeeeeiiiioooouuuucnAAAAEEEEIIIOOUUUUCN")), r"\s+", " "))


def product_text(s: Column) -> Column:
    """Lower case, dashes as blanks, numbers glued to their units, no punctuation."""
    t = F.regexp_replace(F.lower(s), "-", " ")
    t = F.regexp_replace(t, r"([0-9])\s+(cm|mm|ml|g|fr|ga)\b", "$1$2")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"[^\p{L}0-9 ]", " "), r"\s+", " "))


def first_match(s: Column, patterns: list[str], group: int = 1) -> Column:
    """The group of the first pattern, in order, that is found; null if none."""
    return F.coalesce(*(F.nullif(F.regexp_extract(s, p, group), F.lit("")) for p in patterns))


def delivery_number(*sources: Column) -> Column:
    """45 and 8 to 18 more digits standing alone, from the first source that has it."""
    return F.coalesce(*(F.nullif(F.regexp_extract(s, r"(?<![0-9])(45[0-9]{8,18})(?![0-9])", 1), F.lit("")) for s in sources), F.lit(""))


def currency(s: Column) -> Column:
    """The ISO code of a currency's spelling; others as their first six characters, upper case."""
    t = F.regexp_replace(F.upper(s), r"[.\s]", "")
    spellings = {"USD": ("USD", "USDOLLAR", "DOLLAR"), "EUR": ("EUR",), "PLN": ("PLN", "ZLOTY", "ZŁOTY"), "CNY": ("CNY", "RENMINBI", "YUAN", "RMB"), "GBP": ("GBP", "POUND"), "CHF": ("CHF",)}
    out = F.when(F.lit(False), "")
    for iso, starts in spellings.items():
        out = out.when(t.rlike("^(" + "|".join(starts) + ")"), iso)
    return out.otherwise(F.substring(F.upper(s), 1, 6))


def day_counts(s: Column) -> Column:
    """All numbers of days in payment terms."""
    return F.transform(F.regexp_extract_all(F.upper(s), F.lit(r"([0-9]+)\s*DAYS?"), F.lit(1)), lambda x: x.cast("int"))


def payment_severity(a: Column, b: Column) -> Column:
    """error if one side pays in advance and the other not, or the days differ by over 30; else warning."""
    advance = lambda s: F.upper(s).rlike("ADV|PREPAY")
    gaps = F.flatten(F.transform(day_counts(a), lambda x: F.transform(day_counts(b), lambda y: F.abs(x - y))))
    return F.when((advance(a) != advance(b)) | (F.coalesce(F.array_max(gaps), F.lit(0)) > 30), "error").otherwise("warning")


def dimensions(s: Column) -> Column:
    """The first W x H x D, in order of the text, whose parts all lie in 5 to 2000 mm; null if none."""
    triples = F.regexp_extract_all(F.translate(F.lower(s), "×,", "x."), F.lit(r"([0-9]+(?:\.[0-9]+)? ?x ?[0-9]+(?:\.[0-9]+)? ?x ?[0-9]+(?:\.[0-9]+)?)"), F.lit(1))
    numbers = F.transform(triples, lambda t: F.transform(F.split(t, " ?x ?"), lambda v: v.cast("decimal(10,2)")))
    return F.get(F.filter(numbers, lambda d: F.forall(d, lambda v: (v >= 5) & (v <= 2000))), F.lit(0))


def keyword_list(s: Column) -> Column:
    """Parts between semicolons or commas, trimmed, blanks dropped."""
    return F.filter(F.transform(F.split(F.coalesce(s, F.lit("")), "[;,]"), lambda x: F.trim(x)), lambda x: x != "")


def container_number(s: Column) -> Column:
    return F.nullif(F.regexp_extract(F.upper(s), r"\b([A-Z]{4}[0-9]{7})\b", 1), F.lit(""))


def role_of_name(name: Column) -> Column:
    """master, supplier or unknown by a word in a file name."""
    n = F.lower(name)
    return F.when(n.rlike("master|wzor"), "master").when(n.rlike("supplier|dostawca|proof"), "supplier").otherwise("unknown")


def without_role(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(name), r"\.[a-z0-9]+$", ""), r"[ _-]*(master|wzor|supplier|dostawca|proof)[ _-]*", "")


def literal_like(s: Column) -> Column:
    """The text with backslash, per cent and underscore escaped for LIKE ... ESCAPE."""
    return F.regexp_replace(s, r"([\\%_])", r"\\$1")


def tokens(s: Column) -> Column:
    """Distinct lower-case words of over two characters."""
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(s, F.lit(""))), r"[^a-z0-9]+"), lambda w: F.length(w) > 2))


def jaccard(a: Column, b: Column) -> Column:
    """Shared of all words; 0 where there are none."""
    return F.coalesce(F.size(F.array_intersect(a, b)) / F.nullif(F.size(F.array_union(a, b)), F.lit(0)), F.lit(0.0))


def shared_of_larger(a: Column, b: Column) -> Column:
    return F.coalesce(F.size(F.array_intersect(a, b)) / F.nullif(F.greatest(F.size(a), F.size(b)), F.lit(0)), F.lit(0.0))


def scan_key(s: Column) -> Column:
    """Upper case with I and 1, and O and 0, as one: equal keys differ by scan errors only."""
    return F.translate(F.upper(s), "IO", "10")


def confused_places(a: Column, b: Column) -> Column:
    """Places (from 1) at which two texts of one length differ by a confusable pair; null unless all differences are such."""
    pairs = F.array(*(F.lit(x + y) for p in CONFUSABLE for x, y in (p, p[::-1])))
    x, y = F.split(a, ""), F.split(b, "")
    each = F.zip_with(x, y, lambda p, q: F.when(p == q, 0).when(F.array_contains(pairs, F.concat(p, q)), 1).otherwise(2))
    places = F.filter(F.transform(each, lambda v, i: F.when(v == 1, i + 1)), lambda v: v.isNotNull())
    fit = (F.length(a) == F.length(b)) & F.length(a).between(4, 30) & a.rlike("[A-Za-z]") & a.rlike("[0-9]") & ~F.array_contains(each, 2)
    return F.when(fit, places)


def long_repeats(s: Column) -> Column:
    """Letters that stand three times or more in a row, each time."""
    return F.regexp_extract_all(s, F.lit(r"((\p{L})\2{2,})"), F.lit(1))


# Strings, braces and what is between them; a string without end goes on to the text's end.
_JSON_PIECES = r'(?s)[^"{}]++|"[^"\\]*+(?:\\.[^"\\]*+)*+(?:"|\\?$)|[{}]'


def first_json_object(s: Column) -> Column:
    """The first balanced object in a text, from its first opening brace on; null if it does not close or is no JSON.

    Braces within strings do not count, nor do quotes behind a backslash. Nothing after a first object that fails is tried.
    """
    begin = F.instr(s, "{")
    pieces = F.regexp_extract_all(F.substr(s, begin, F.length(s)), F.lit(_JSON_PIECES), F.lit(0))
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("read"), F.lit(0).alias("end"))

    def step(at: Column, piece: Column) -> Column:
        depth = at["depth"] + F.when(piece == "{", 1).when(piece == "}", -1).otherwise(0)
        read = at["read"] + 1
        return F.struct(depth.alias("depth"), read.alias("read"), F.when((at["end"] == 0) & (depth == 0) & (piece == "}"), read).otherwise(at["end"]).alias("end"))

    end = F.aggregate(pieces, start, step)["end"]
    found = F.array_join(F.slice(pieces, F.lit(1), end), "")
    return F.when((begin > 0) & (end > 0) & F.json_object_keys(found).isNotNull(), found)
