"""Feature extraction and classification as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from regspark.functions import fixed as X
from regspark.functions import text as C
from regspark.functions.text import _col


def concept_flags(text: Column | str) -> dict[str, Column]:
    """six booleans, true when any of the terms occurs."""
    low = F.lower(_col(text))
    return {name: C.contains_any(low, terms) for name, _, terms in X.CONCEPTS}


def land_scope(text: Column | str, chapter: Column | str, compat: bool = False) -> Column:
    """land-scope label. By default accents are ignored on both sides; ``compat`` keeps the asymmetry."""
    t, c = F.lower(_col(text)), F.lower(_col(chapter))
    if not compat:
        t, c = C.fold_accents(t), C.fold_accents(c)
    rural, rustic = ("núcleo rural", "rústico") if compat else ("nucleo rural", "rustico")

    def label(x: Column) -> Column:
        t, c = x["t"], x["c"]
        return (
            F.when(t.contains("urbano consolidado") | c.contains("urbano consolidado"), "urbano_consolidado")
            .when(t.contains("urbano no consolidado"), "urbano_no_consolidado")
            .when(t.contains(rural) | c.contains("nucleo rural"), "nucleo_rural")
            .when(t.contains(rustic) | c.contains("rustico"), "rustico")
            .when(t.contains("suelo urbano") | c.contains("suelo urbano"), "urbano")
            .otherwise("")
        )

    return C.let(F.struct(t.alias("t"), c.alias("c")), label)


def ordinance_code(context_code: Column | str, text: Column | str, compat: bool = False) -> Column:
    """code of the nearest heading, else the first one named in the text, else ''."""
    code = X.ORDINANCE_CODE_COMPAT if compat else X.ORDINANCE_CODE
    found = F.regexp_extract(_col(text), rf"\b[Oo]rdenanza\s+({code})\b", 1)
    return F.coalesce(F.nullif(_col(context_code), F.lit("")), found)


def ordinance_family(code: Column | str) -> Column:
    """part of the code before the dot."""
    return F.split(_col(code), r"\.")[0]


def all_keywords(text: Column | str) -> Column:
    """every keyword of a text, sorted: vocabulary, measures and ordinance codes."""
    return C.let(_col(text), lambda t: C.let(F.lower(t), lambda low: _keyword_array(t, low)))


def _keyword_array(text: Column, low: Column) -> Column:
    words = F.array_compact(F.array(*[F.when(low.contains(w), F.lit(w)) for w in X.VOCABULARY]))
    parts = [words]
    for pattern in X.MEASURES:
        pairs = F.arrays_zip(C.matches(low, pattern, 1).alias("n"), C.matches(low, pattern, 2).alias("u"))
        parts.append(F.transform(pairs, lambda p: F.concat_ws(" ", p["n"], p["u"])))
    parts.append(F.transform(C.matches(F.upper(text), rf"\b({X.ORDINANCE_CODE_COMPAT})\b", 1), F.lower))
    return F.array_sort(F.array_distinct(F.concat(*parts)))


def keywords(text: Column | str, top_n: int = 8) -> Column:
    """the first ``top_n`` keywords in alphabetical order."""
    return F.slice(all_keywords(text), 1, top_n)


def requested_article(question: Column | str) -> Column:
    """article number asked for in a question, NULL when none is."""
    low = F.lower(_col(question))
    return F.coalesce(*[F.nullif(F.regexp_extract(low, p, 1), F.lit("")) for p in X.ARTICLE_REQUESTS])


def source_class(source: Column | str) -> Column:
    """F6."""
    s = _col(source)
    return F.when(s == "pxom", "pxom").when(s == "nhv", "nhv").when(s.startswith("cte"), "cte").otherwise("")


def street_type(address: Column | str) -> Column:
    """type code and upper-case name of a street plus the type codes to try in order."""
    address = _col(address)
    low = F.lower(address)
    none = F.struct(F.lit("RU").alias("type"), F.lit(None).cast("string").alias("name"),
                    F.array(*[F.lit(a) for a in ["RU"] + X.STREET_TYPES[0][3]]).alias("types"))
    out = F.when(F.lit(False), none)
    for code, words, pattern, alternates in X.STREET_TYPES:
        name = F.upper(F.trim(F.regexp_extract(address, "(?iu)" + pattern, 1)))
        out = out.when(C.contains_any(low, words), F.struct(
            F.lit(code).alias("type"), F.nullif(name, F.lit("")).alias("name"),
            F.array(*[F.lit(a) for a in [code] + alternates]).alias("types")))
    return out.otherwise(none)


def address_variants(address: Column | str) -> Column:
    """F8: spellings to try, in order, without case-insensitive repeats."""
    address = _col(address)
    low = F.trim(F.lower(address))
    number = F.regexp_extract(address, r"\s+(\d+)\s*$", 1)
    base = F.when(number != "", F.regexp_replace(address, r"\s+\d+\s*$", "")).otherwise(address)
    prefix = C.prefix_of(low, X.ADDRESS_PREFIXES)
    tail = F.when(number != "", F.concat(F.lit(" "), number)).otherwise(F.lit(""))

    def named(p: Column) -> Column:
        name = F.trim(p["base"].substr(F.length(p["prefix"]) + 1, F.lit(1 << 30)))
        return F.struct(name.alias("name"), p["tail"].alias("tail"), ((p["prefix"] != "") | (name != p["base"])).alias("typed"))

    def options(p: Column) -> Column:
        def spell(kinds: list[str]) -> list[Column]:
            return [F.concat(F.lit(k + " "), p["name"], p["tail"]) for k in kinds]

        return F.when(p["typed"], F.array(address, *spell(X.TYPED_REWRITES), F.concat(p["name"], p["tail"]))) \
            .otherwise(F.array(address, *spell(X.UNTYPED_REWRITES)))

    def distinct(cleaned: Column) -> Column:
        return C.let(F.transform(cleaned, F.lower), lambda lowered: F.filter(cleaned, lambda v, i: F.array_position(lowered, F.lower(v)) == i + 1))

    # each step is computed once: a lambda would compute what it refers to again for each element
    parts = F.struct(base.alias("base"), prefix.alias("prefix"), tail.alias("tail"))
    spelled = C.let(parts, lambda p: C.let(named(p), options))
    return C.let(F.filter(F.transform(spelled, lambda v: F.trim(v)), lambda v: v != ""), distinct)


def house_number(address: Column | str) -> Column:
    """first whole number of an address, '' when absent."""
    return F.regexp_extract(_col(address), r"\b(\d+)\b", 1)


def street_name_only(address: Column | str) -> Column:
    """the name left after number and street type are taken off."""
    bare = F.trim(F.regexp_replace(_col(address), r"\b\d+\b", ""))
    name = F.trim(bare.substr(F.length(C.prefix_of(bare, X.FALLBACK_PREFIXES)) + 1, F.lit(1 << 30)))
    return F.trim(name, F.lit(" ,"))


Dictionary = list[tuple[str, list[str]]]


def expansion_matches(query: Column | str, dictionary: Dictionary, whole_words: bool = False) -> Column:
    """ordered ``array<struct<term, added>>`` of the dictionary terms found in the query.

    The dictionary is one array literal, so the plan does not grow with it.
    """
    entries = F.array(*[F.struct(F.lit(term).alias("term"), F.array(*[F.lit(s) for s in synonyms]).alias("synonyms"))
                        for term, synonyms in dictionary])

    def found(low: Column) -> Column:
        def occurs(e: Column) -> Column:
            if whole_words:
                return F.regexp_like(low, F.concat(F.lit(r"(?U)\b\Q"), e["term"], F.lit(r"\E\b")))
            return low.contains(e["term"])

        hits = F.transform(F.filter(entries, occurs), lambda e: F.struct(
            e["term"].alias("term"), F.filter(e["synonyms"], lambda s: ~low.contains(s)).alias("added")))
        return F.filter(hits, lambda h: F.size(h["added"]) > 0)

    return C.let(F.lower(_col(query)), found)


def expand_query(query: Column | str, dictionary: Dictionary, whole_words: bool = False) -> Column:
    """the query followed by every new synonym once, in dictionary order."""
    query = _col(query)
    found = expansion_matches(query, dictionary, whole_words)
    return F.array_join(F.concat(F.array(query), F.array_distinct(F.flatten(F.transform(found, lambda h: h["added"])))), " ")


def rerank_query(query: Column | str) -> Column:
    """prefix a query that names one of the residential terms."""
    q = _col(query)
    return F.when(C.contains_any(F.lower(q), X.RERANK_TERMS), F.concat(F.lit(X.RERANK_PREFIX), q)).otherwise(q)


def alias_ordinance(code: Column | str) -> Column:
    """codes that are stored under another name."""
    c = _col(code)
    out = reduce(lambda acc, kv: acc.when(c == kv[0], F.lit(kv[1])), X.ORDINANCE_ALIASES.items(), F.when(F.lit(False), c))
    return out.otherwise(c)


def enrich_with_zone(query: Column | str, code: Column | str) -> Column:
    """add the ordinance of the parcel to a question."""
    q, c = _col(query), F.coalesce(_col(code), F.lit(""))
    return F.when(c != "", F.concat(q, F.lit(" ordenanza "), c)).otherwise(q)


def enrich_with_parcel(query: Column, ref: Column, code: Column, area: Column, uses: Column) -> Column:
    """the full active-parcel wording."""
    listed = F.when(F.size(uses) > 0, F.array_join(uses, ", ")).otherwise(F.lit("N/D"))
    return F.concat(F.lit("Parcela RC "), ref, F.lit(", ordenanza "), code, F.lit(", superficie "), area,
                    F.lit(" m², usos actuales: "), listed, F.lit(". "), F.trim(query))


def heading_census(text: Column | str) -> dict[str, Column]:
    """number of title, chapter, section and article headings."""
    t = _col(text)
    patterns = {"titles": X.PLAIN_TITLE, "chapters": X.PLAIN_CHAPTER, "sections": X.PLAIN_SECTION,
                "articles": r"Art\.\s+(\d+[a-z]?)\.\s+([^\n.]+)\."}
    return {k: F.regexp_count(t, F.lit("(?iu)" + p)).cast("long") for k, p in patterns.items()}


def is_key_field(name: Column | str) -> Column:
    """F15."""
    return C.contains_any(F.lower(_col(name)), X.KEY_FIELD_TOKENS)
