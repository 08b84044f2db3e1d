"""Roles of a table's columns by their headers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A column's roles, in order of priority, and the words of their headers.
ROLE_WORDS = {
    "ref": ("ref", "code", "item", "article", "sku", "indeks", "kod", "s.no", "sno", "no.", "product code", "catalogue"),
    "qty": ("qty", "quantity", "ilość", "pcs", "szt", "menge", "nos", "nos."),
    "price": ("price", "cena", "unit price", "unit-price", "rate", "preis"),
    "net": ("amount", "net", "value", "total", "wartość", "kwota"),
    "description": ("description", "opis", "nazwa", "goods", "product description", "item description", "opis towarów"),
    "unit": ("unit", "uom", "jm", "order unit"),
    "lot": ("lot", "batch", "seria", "lot no", "batch no"),
    "tariff_code": ("tariff", "kod taryfy", "taryfa", "ncm", "hs code", "hs-code", "commodity code", "kod towaru", "kod cn", "taric", "33"),
    "gross_weight": ("gross", "brutto", "gross weight", "masa brutto", "gross mass", "35"),
    "net_weight": ("net weight", "masa netto", "net mass", "38"),
    "customs_value": ("customs value", "wartość celna", "wartość faktur", "46"),
    "stat_value": ("stat_value", "wartość statystyczna", "statistical value", "99"),
    "customs_duty": ("cło", "customs duty", "duty", "a00"),
    "vat_amount": ("vat", "b00", "podatek vat"),
    "mrn": ("mrn", "mrn zgłoszenia", "movement reference"),
    "procedure": ("procedura", "procedure", "procedura celna", "11 09"),
    "origin": ("origin", "kraj pochodzenia", "country of origin", "kraj wysyłki", "16"),
    "incoterms": ("incoterms", "warunki dostawy", "delivery terms", "14 01", "fob", "cif", "exw"),
    "packages": ("packages", "opakowania", "cartons", "pkgs", "18 06"),
}


def column_roles(headers: Column, words: dict[str, tuple[str, ...]] | None = None) -> Column:
    """The role of each header of an array, in order; skip for those without one, null for a null array.

    The roles choose in order of priority: each takes the first free header that equals one of its words or,
    for words of over three characters, holds one. A role stands at most once. Null headers are skipped.
    """
    table = F.array(*(F.struct(F.lit(r).alias("role"), F.array(*map(F.lit, w)).alias("words")) for r, w in (words or ROLE_WORDS).items()))
    # A value that several places of a lambda need is bound by a transform of one element, so it is worked out once.
    bound = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))
    fits = lambda h, r: F.exists(r["words"], lambda w: (h == w) | ((F.length(w) > 3) & F.contains(h, w)))

    def of(plain: Column) -> Column:
        def choose(roles: Column, r: Column) -> Column:
            place = F.array_position(F.zip_with(roles, plain, lambda given, h: (given == "skip") & fits(h, r)), F.lit(True))
            return bound(place, lambda p: F.transform(roles, lambda given, i: F.when(i + 1 == p, r["role"]).otherwise(given)))

        return F.aggregate(table, F.transform(plain, lambda h: F.lit("skip")), choose)

    return bound(F.transform(headers, lambda h: F.trim(F.lower(F.coalesce(h, F.lit(""))))), of)
