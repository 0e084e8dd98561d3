"""Cross references, wikilinks and the link graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regspark.functions import fixed as X
from regspark.functions import text as C
from regspark.functions.text import _col
from regspark.operators.ordered import first_by, top_per_key


def number_parts(number: Column | str) -> list[Column]:
    """Sort key (whole part, part after the dot), NULL when not numeric."""
    n = _col(number)
    return [F.regexp_extract(n, r"^(\d+)", 1).try_cast("int"), F.regexp_extract(n, r"\.(\d+)$", 1).try_cast("int")]


def reference_candidates(text: Column | str, compat: bool = False) -> Column:
    """Every match of the prioritised patterns as ``array<struct<priority, pattern, pos, number, source>>``."""
    naming = {
        "own": lambda s: F.lit(X.OWN_SOURCE), "none": lambda s: F.lit(X.NO_SOURCE),
        "law": lambda s: F.concat(F.lit("Ley "), s), "named": lambda s: s, "acronym": F.upper,
    }
    acronym = "([A-Z]{2,10})" if compat else "((?-i:[A-Z]{2,10}))"

    def found(x: Column, index: int, priority: int, kind: str, pattern: str) -> Column:
        regex = "(?iu)" + pattern.replace("{acr}", acronym)
        # one pass over a text with the words of the pattern; the groups are read from the short matches
        some = x["low"].contains("art") & C.contains_any(x["low"], X.REFERENCE_WORDS[index])
        return F.transform(F.when(some, C.matches(x["text"], regex)).otherwise(F.array().cast("array<string>")), lambda m, j: F.struct(
            F.lit(priority).alias("priority"), F.lit(index).alias("pattern"), j.alias("pos"),
            F.regexp_extract(m, regex, 1).alias("number"), naming[kind](F.regexp_extract(m, regex, 2)).alias("source")))

    both = F.struct(_col(text).alias("text"), F.lower(_col(text)).alias("low"))
    return C.let(both, lambda x: F.concat(*[found(x, i, *rule) for i, rule in enumerate(X.REFERENCES)]))


def extract_references(articles: DataFrame, keys: list[str], text: str, compat: bool = False) -> DataFrame:
    """One row per article and cited number, the best pattern deciding the source."""
    found = articles.select(*keys, F.explode(reference_candidates(text, compat)).alias("r")).select(
        *keys, F.col("r.number").alias("ref_number"), F.col("r.source").alias("ref_source"),
        F.col("r.priority").alias("priority"), F.col("r.pattern").alias("pattern"), F.col("r.pos").alias("ref_pos"))
    best = first_by(found, [*keys, "ref_number"], ["priority", "pattern", "ref_pos"])
    fixed_source = F.col("ref_source")
    for number, wrong, right in X.REFERENCE_CORRECTIONS:
        fixed_source = F.when((F.col("ref_number") == number) & (F.col("ref_source") == wrong), right).otherwise(fixed_source)
    return best.select(*keys, "ref_number", fixed_source.alias("ref_source"), "priority")


def reference_list(refs: DataFrame, keys: list[str]) -> DataFrame:
    """References of an article as one array in numeric order (bounded by one article's text)."""
    item = F.struct(*[p.alias(f"o{i}") for i, p in enumerate(number_parts("ref_number"))],
                    F.col("ref_number").alias("number"), F.col("ref_source").alias("source"))
    return refs.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(item)), lambda s: F.struct(
        s["number"].alias("number"), s["source"].alias("source"))).alias("refs"))


def wikilinks(notes: DataFrame, slugs: DataFrame) -> DataFrame:
    """Textual references to ``[[art-n]]`` links; a reference naming an unknown article is dropped.

    ``notes``: source, note_id, ref. ``slugs``: source, slug.
    """
    pattern = "(?iu)" + X.WIKI_ARTICLE
    cited = notes.select("source", "note_id", "ref", F.explode_outer(C.matches(F.col("ref"), pattern, 1)).alias("number")) \
        .withColumn("slug", C.article_slug("number"))
    known = slugs.select("source", "slug").distinct().withColumn("known", F.lit(True))
    checked = cited.join(known, ["source", "slug"], "left")
    whole = checked.groupBy("source", "note_id").agg(
        F.first("ref").alias("ref"), F.bool_or(F.col("slug").isNotNull() & F.col("known").isNull()).alias("broken"))
    text = F.regexp_replace("ref", pattern, "[[art-$1]]")
    # a dot inside a link target becomes a dash
    return whole.filter("not broken").select("source", "note_id", "ref", F.regexp_replace(
        text, r"(\[\[art-\d+)\.(\d+\]\])", "$1-$2").alias("linked"))


# ------------------------------------------------------------------ graph


def degrees(edges: DataFrame) -> DataFrame:
    """Out-degree, in-degree and total per node of distinct (src, dst) edges."""
    both = edges.select(F.explode(F.array(
        F.struct(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")),
        F.struct(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("x")).select("x.*")
    return both.groupBy("node").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"),
                                    F.count("*").alias("total"))


def most_connected(edges: DataFrame, k: int = 15) -> DataFrame:
    """The ``k`` nodes with most links."""
    return degrees(edges).orderBy(F.desc("total"), "node").limit(k)


def bidirectional_pairs(edges: DataFrame) -> DataFrame:
    """Pairs that cite each other, found by grouping on the unordered pair (no self join)."""
    pair = edges.filter("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"),
                                             (F.col("src") < F.col("dst")).alias("forward"))
    return pair.groupBy("a", "b").agg(F.bool_or("forward").alias("f"), F.bool_or(~F.col("forward")).alias("r")) \
        .filter("f and r").select("a", "b")


def neighbourhood(edges: DataFrame, max_incoming: int = 15) -> DataFrame:
    """Outgoing links of every node and its first ``max_incoming`` incoming ones (a report limit)."""
    out = edges.select(F.col("src").alias("node"), F.lit("out").alias("direction"), F.col("dst").alias("other"))
    incoming = top_per_key(edges.select(F.col("dst").alias("node"), F.lit("in").alias("direction"),
                                        F.col("src").alias("other")), ["node"], [F.asc("other")], max_incoming).drop("rank")
    return out.unionByName(incoming)


def subsection(requests: DataFrame, articles: DataFrame) -> DataFrame:
    """``62.6`` -> article 62, item 6. ``articles``: number, item_no, item_text."""
    r = requests.withColumns({"number": F.split("request", r"\.")[0], "item": F.get(F.split("request", r"\."), F.lit(1))})
    joined = r.join(articles, ["number"])
    return joined.filter(F.col("item").isNull() | (F.col("item") == F.col("item_no")))


def related_articles(edges: DataFrame, k: int = 5) -> DataFrame:
    """Suggestions per article: linked articles, mutual links first, then by number of links."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    linked = both.filter("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("links"))
    deg = degrees(edges).select(F.col("node").alias("dst"), "total")
    scored = linked.join(deg, ["dst"])
    return top_per_key(scored, ["src"], [F.desc("links"), F.desc("total"), F.asc("dst")], k)


def reference_statistics(articles: DataFrame, refs: DataFrame) -> DataFrame:
    """Articles, share with references, mean references per article (one row)."""
    per = articles.select("doc", "number").distinct().join(
        refs.groupBy("doc", "number").agg(F.count("*").alias("n")), ["doc", "number"], "left")
    return per.agg(F.count("*").alias("articles"), F.count("n").alias("with_refs"),
                   F.round(F.count("n") * 100.0 / F.count("*"), 1).alias("share"),
                   F.round(F.coalesce(F.sum("n"), F.lit(0)) / F.count("*"), 2).alias("mean_refs"))


def top_counts(df: DataFrame, column: str, k: int = 10) -> DataFrame:
    """The most frequent values of a column."""
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(k)


def contexts(df: DataFrame, text: str, term: str, width: int = 80, k: int = 3) -> DataFrame:
    """Up to ``k`` text windows around a term."""
    pattern = rf"(?is).{{0,{width}}}{term}.{{0,{width}}}"
    if term.isascii() and term.isalnum():
        # only what lies between the first and the last window is read: elsewhere each place would be tried with every width
        def near(p: Column) -> Column:
            start = F.greatest(F.length(p[0]) - width, F.lit(0))
            end = F.length(text) - F.greatest(F.length(F.element_at(p, -1)) - width, F.lit(0))
            return F.when(F.size(p) > 1, C.matches(F.col(text).substr(start + 1, end - start), pattern)).otherwise(F.array().cast("array<string>"))

        found = C.let(F.split(text, f"(?i){term}", -1), near)
    else:
        found = C.matches(F.col(text), pattern)
    return df.withColumn("contexts", F.slice(found, 1, k)).filter(F.size("contexts") > 0)
