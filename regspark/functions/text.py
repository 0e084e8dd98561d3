"""Text normalisation as Column expressions (all JVM-side)."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from regspark.functions import fixed as X

MARK = "\u0001"
WHITE = " \t\n\u000b\f\r"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column) -> Column:
    """Trim every kind of ASCII white space, not only blanks; only the ends are looked at."""
    return F.btrim(c, F.lit(WHITE))


def contains_any(c: Column, terms: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [c.contains(t) for t in terms])


def last_match(c: Column, pattern: str, group: int = 1) -> Column:
    """Last match of a pattern in a text, NULL without one."""
    return F.try_element_at(F.regexp_extract_all(c, F.lit(pattern), F.lit(group)), F.lit(-1))


def iterative(pattern: str) -> str:
    """The same pattern with possessive line repeats: Java then loops over lines instead of recursing into them.

    Valid where nothing after the repeat can match inside the repeated lines.
    """
    return pattern.replace(r"\n)+)", r"\n)++)").replace(r"\n[^.\n]+)*", r"\n[^.\n]+)*+")


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` refers to it."""
    return F.transform(F.array(value), use)[0]


def carried(values: Column, block: int = 256) -> Column:
    """An array in which each element is the last one before it that is not NULL (NULL if there is none).

    Only places are folded, in blocks, so that an array of many elements stays cheap.
    """
    def running(w: Column) -> Column:
        start = F.struct(F.lit(-1).alias("m"), F.array().cast("array<int>").alias("o"))
        return F.aggregate(w, start, lambda a, v: F.struct(F.greatest(a["m"], v).alias("m"), F.concat(a["o"], F.array(a["m"])).alias("o")), lambda a: a["o"])

    def before(v: Column) -> Column:
        places = F.transform(v, lambda x, i: F.when(x.isNotNull(), i).otherwise(-1))
        return let(places, lambda m: let(
            F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.size(m) - 1, F.lit(0)) / block).cast("int")), lambda b: F.slice(m, b * block + 1, block)),
            lambda blocks: F.flatten(F.zip_with(F.transform(blocks, running), running(F.transform(blocks, F.array_max)),
                                                lambda o, top: F.transform(o, lambda j: F.greatest(j, top))))))

    # without any value the array of NULLs is its own answer
    return let(values, lambda v: F.when(F.exists(v, lambda x: x.isNotNull()), F.transform(before(v), lambda j: F.when(j >= 0, F.get(v, j)))).otherwise(v))


def matches(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def split_at(c: Column, pattern: str) -> Column:
    """Cut a text before every match of ``pattern``; piece 0 is the text before the first match."""
    clean = F.replace(c, F.lit(MARK), F.lit(""))
    return F.split(F.regexp_replace(clean, pattern, MARK + "$0"), MARK, -1)


def remove_elements(html: Column | str, tags: list[str] | None = None) -> Column:
    """Drop whole elements and comments from an HTML text."""
    out = _col(html)
    for tag in tags or X.REMOVED_TAGS:
        out = F.regexp_replace(out, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", "")
    return F.regexp_replace(out, r"(?s)<!--.*?-->", "")


def plain_text(html: Column | str) -> Column:
    """Markup to text: tags out, the common entities decoded, ends trimmed."""
    out = F.regexp_replace(_col(html), r"<[^>]*>", "")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return strip(out)


def remove_footers(text: Column | str) -> Column:
    """Page boilerplate. A pattern is tried only where its fixed words occur, which costs much less to find out."""
    def without(pattern: str, words: str):
        return lambda t: F.when(t.contains(words), F.regexp_replace(t, pattern, "")).otherwise(t)

    out = _col(text)
    for (pattern, dotall), words in zip(X.FOOTERS, X.FOOTER_WORDS, strict=True):
        out = let(out, without(("(?s)" if dotall else "") + pattern, words))
    return out


def collapse_blank_lines(text: Column | str) -> Column:
    """Three or more newlines become two."""
    return F.regexp_replace(_col(text), r"\n{3,}", "\n\n")


def single_spaced(text: Column | str) -> Column:
    """Any white space run becomes one blank."""
    return F.trim(F.regexp_replace(_col(text), r"\s+", " "))


def tidy_spaces(text: Column | str) -> Column:
    """C4: double blanks and blanks before a line end."""
    return F.regexp_replace(F.regexp_replace(_col(text), "  +", " "), " \n", "\n")


def split_glued_heading(md: Column | str, compat: bool = False) -> Column:
    """Separate words glued together in a heading.

    The default cuts only between a lower-case and an upper-case letter, so clean headings such as
    ``## ANEXO I`` stay intact; ``compat`` cuts before the last capital of the first word.
    """
    if compat:
        return F.regexp_replace(
            _col(md), r"(#{1,3}\s+)([A-ZÁÉÍÓÚÑ][a-záéíóúñA-ZÁÉÍÓÚÑ]+)([A-ZÁÉÍÓÚÑ])", "$1$2 $3")
    return F.regexp_replace(_col(md), r"(#{1,3}[ \t]+\p{Lu}\p{L}*\p{Ll})(\p{Lu})", "$1 $2")


def number_inline_images(md: Column | str) -> Column:
    """The n-th inline image becomes ``[IMAGEN_n]``."""
    parts = F.split(_col(md), X.INLINE_IMAGE, -1)
    return F.array_join(
        F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(
            F.concat(F.lit("[IMAGEN_"), i.cast("string"), F.lit("]"), p))), "")


def repair_ocr_body(line: Column | str) -> Column:
    """The fixed replacements on one line."""
    out = _col(line)
    for wrong, right in X.OCR_REPAIRS:
        out = F.replace(out, F.lit(wrong), F.lit(right))
    return out


def repair_ocr_heading(line: Column | str) -> Column:
    """Rebuild an article heading damaged by OCR; other lines get the body repairs."""
    line = _col(line)
    pattern = "(?iu)" + X.OCR_HEADING
    raw_no = F.regexp_extract(line, pattern, 2)
    number = F.when(raw_no.rlike(r"^\d+o$"), F.concat(F.regexp_replace(raw_no, "o$", "").cast("int").cast("string"),
                                                     F.lit("0"))).otherwise(raw_no)
    title = repair_ocr_body(F.trim(F.regexp_extract(line, pattern, 3)))
    words = F.filter(F.split(title, r"\s+"), lambda w: w != "")
    cut = F.transform(words, lambda w: F.when(
        F.length(w) > 15, F.regexp_replace(w, "([a-záéíóúñ])([A-ZÁÉÍÓÚÑ])", "$1 $2")).otherwise(w))
    joined = F.array_join(cut, " ")
    capital = F.concat(F.upper(F.substring(joined, 1, 1)), F.substring(joined, 2, 1 << 30))
    clean = F.regexp_replace(capital, "^[°. ]+", "")
    return F.when(line.rlike(pattern), F.concat(F.lit("## Articulo "), number, F.lit(". "), clean, F.lit("."))) \
        .otherwise(repair_ocr_body(line))


def _accent_map() -> tuple[str, str]:
    """Every precomposed Latin letter whose decomposition is one base letter plus accents."""
    src, dst = [], []
    for cp in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base = "".join(c for c in unicodedata.normalize("NFD", chr(cp)) if unicodedata.category(c) != "Mn")
        if len(base) == 1 and base != chr(cp):
            src.append(chr(cp))
            dst.append(base)
    return "".join(src), "".join(dst)


_ACCENTED, _PLAIN = _accent_map()


def fold_accents(text: Column | str) -> Column:
    return F.translate(F.regexp_replace(_col(text), r"\p{Mn}", ""), _ACCENTED, _PLAIN)


def cadastre_upper(text: Column | str) -> Column:
    """Accents off, upper case."""
    return F.upper(fold_accents(text))


def prefix_of(c: Column, prefixes: list[str]) -> Column:
    """The first of the listed prefixes (any case) that a text starts with, as written in the text, '' without one."""
    return F.regexp_extract(c, "(?iu)^(?:" + "|".join(r"\Q" + p + r"\E" for p in prefixes) + ")", 0)


def drop_street_article(name: Column | str, compat: bool = False) -> Column:
    """Drop one leading article; longest article first unless ``compat`` (listed order)."""
    order = X.STREET_ARTICLES if compat else sorted(X.STREET_ARTICLES, key=lambda a: -len(a))
    return let(F.trim(_col(name)), lambda n: n.substr(F.length(prefix_of(n, order)) + 1, F.lit(1 << 30)))


def clean_reference(ref: Column | str) -> Column:
    """C11: blanks out, upper case."""
    return F.upper(F.replace(_col(ref), F.lit(" "), F.lit("")))


def parcel_key(ref: Column | str) -> Column:
    """C11: the parcel part (first 14 characters) of a reference."""
    return F.substring(clean_reference(ref), 1, 14)


def reference_kind(ref: Column | str) -> Column:
    """C12."""
    n = F.length(clean_reference(ref))
    return F.when(n == 14, "parcel").when(n == 20, "unit").otherwise("unknown")


def land_kind(code: Column | str) -> Column:
    """UR is urban, anything else rustic."""
    return F.when(_col(code) == "UR", "Urbano").otherwise("Rústico")


def decimal_comma(value: Column | str) -> Column:
    """Number with a decimal comma; NULL when it is not a number."""
    return F.replace(_col(value).cast("string"), F.lit(","), F.lit(".")).try_cast("double")


def unit_code(value: Column | str) -> Column:
    """C14: trimmed, upper case, whole numbers without leading zeros."""
    v = F.upper(F.trim(F.coalesce(_col(value).cast("string"), F.lit(""))))
    return F.when(v.rlike(r"^[0-9]+$"), F.coalesce(F.nullif(F.ltrim(v, F.lit("0")), F.lit("")), F.lit("0"))).otherwise(v)


def url_file_name(url: Column | str) -> Column:
    """A safe file name from the path of a URL."""
    path = F.translate(F.coalesce(F.parse_url(_col(url), F.lit("PATH")), F.lit("")), "/\\", "__")
    name = F.when(path.isin("", "_"), F.lit("index")).otherwise(path)
    name = F.when(name.endswith(".html"), name).otherwise(F.concat(name, F.lit(".html")))
    return F.ltrim(name, F.lit("_"))


def comparable_address(address: Column | str) -> Column:
    """First four words without unit part, digits and town names."""
    head = F.split(F.split(F.coalesce(_col(address), F.lit("")), "Es:")[0], r"\(")[0]
    out = F.regexp_replace(head, r"\d+", "")
    for town in X.TOWNS:
        out = F.replace(out, F.lit(town), F.lit(""))
    words = F.filter(F.split(out, r"\s+"), lambda w: w != "")
    return F.upper(F.array_join(F.slice(words, 1, 4), " "))


def different_streets(a: Column | str, b: Column | str) -> Column:
    """C17: both addresses present and sharing fewer than two words."""
    ca, cb = comparable_address(a), comparable_address(b)
    common = F.size(F.array_intersect(F.split(ca, " "), F.split(cb, " ")))
    return (ca != "") & (cb != "") & (common < 2)


def card_title(header: Column | str) -> Column:
    """Last part of a ``|`` header."""
    return F.trim(F.element_at(F.split(_col(header), r"\|"), -1))


def card_text(text: Column | str, limit: int = 350) -> Column:
    """First paragraph, cut with dots."""
    return truncate(F.split(_col(text), "\n\n")[0], limit)


def truncate(text: Column | str, limit: int, suffix: str = "...") -> Column:
    """Cut at ``limit`` and mark the cut."""
    text = _col(text)
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit(suffix))).otherwise(text)


def article_slug(number: Column | str) -> Column:
    """C19."""
    return F.concat(F.lit("art-"), F.replace(_col(number), F.lit("."), F.lit("-")))


def wiki_path(source: Column | str, number: Column | str) -> Column:
    """One path rule for writing and looking up pages."""
    folder = F.regexp_replace(_col(source), "^cte-", "cte/")
    return F.concat(F.lit("wiki/"), folder, F.lit("/"), article_slug(number), F.lit(".md"))


def is_partial(text: Column | str, limit: int = X.WIKI_CHARS) -> Column:
    """C20."""
    return F.length(_col(text)) > limit


def model_json_text(raw: Column | str) -> Column:
    """Model output without code fences and reasoning spans."""
    out = strip(_col(raw))
    out = F.regexp_replace(out, r"(?s)<think>.*?</think>", "")
    out = F.regexp_replace(out, r"```\w*\s*", "")
    return strip(out)


def parse_model_json(raw: Column | str, schema: str, fallback: Column) -> Column:
    """Typed record of a model answer; the fallback record when it is not JSON."""
    text = model_json_text(raw)
    ok = F.try_parse_json(text).isNotNull() & text.startswith("{")
    return F.when(ok, F.from_json(text, schema)).otherwise(fallback)


def clean_questions(raw: Column | str) -> Column:
    """At most two questions out of a list-like model answer."""
    lines = F.transform(F.split(_col(raw), "\n"), lambda s: F.regexp_replace(F.trim(s), r"^[\d.\-*]+\s*", ""))
    return F.slice(F.filter(lines, lambda s: (F.length(s) > 10) & s.contains("?")), 1, 2)


def tag_line(tags: Column | str) -> Column:
    """``#tag_name #other``."""
    return F.array_join(F.transform(_col(tags), lambda t: F.concat(F.lit("#"), F.replace(t, F.lit(" "), F.lit("_")))), " ")


def yaml_list(values: Column | str) -> Column:
    """``"a", "b"``."""
    return F.array_join(F.transform(_col(values), lambda t: F.concat(F.lit('"'), t, F.lit('"'))), ", ")
