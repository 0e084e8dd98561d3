"""Corpus, page, feature and layer readers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from regspark.functions import fixed as X
from regspark.functions import geometry as G
from regspark.functions import text as C
from regspark.operators.ordered import first_by

ARTICLE_SCHEMA = (
    "metadata struct<total_articulos int, fecha_extraccion string, fuente string>, articulos array<struct<numero string, "
    "titulo string, titulo_descriptivo string, contenido string, contenido_estructurado struct<tipo string, total_parrafos int, "
    "texto_completo string, parrafos array<struct<numero string, texto string>>>, referencias array<struct<tipo string, "
    "numero string, fuente string>>, longitud_caracteres int, contexto struct<titulo struct<numero string, nombre string>, "
    "capitulo struct<numero string, nombre string>, seccion struct<numero string, nombre string>>, timestamp string>>"
)
# layer name -> columns kept on load
LAYER_COLUMNS = {
    "parcels": ["refcat", "via", "numero", "area", "fechaalta", "fechabaja", "masa"],
    "buildings": ["refcat", "constru", "area", "fechaalta", "fechabaja", "masa"],
    "blocks": ["refcat", "masa", "area"],
    "subparcels": ["refcat", "area"],
    "axes": ["via", "ttggss"],
    "streets": ["via", "ttggss", "denomina", "fechaalta", "fechabaja"],
}


def markdown_corpus(spark: SparkSession, path: str, registry: DataFrame) -> DataFrame:
    """One row per registered markdown file. ``registry``: source, file_name and any options (a handful of rows)."""
    docs = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_name").alias("file_name"))
    return docs.join(registry, "file_name").withColumnRenamed("value", "md")


def article_json(spark: SparkSession, path: str) -> DataFrame:
    """Article files, one row per article."""
    return spark.read.schema(ARTICLE_SCHEMA).json(path, multiLine=True).selectExpr("inline(articulos)")


def article_rows(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Article documents in a string column, one row per article; the other columns stay."""
    own = [c for c in df.columns if c != raw]
    return df.select(*own, F.from_json(raw, ARTICLE_SCHEMA)["articulos"].alias("_a")).select(*own, F.inline("_a"))


def converted_markdown(raw: Column | str) -> Column:
    """S3: markdown inside a converted document, else the first 2000 characters of the raw JSON."""
    raw = C._col(raw)
    paths = ("$.document.md_content", "$.output.markdown", "$.markdown")
    return F.coalesce(*[F.get_json_object(raw, p) for p in paths], F.substring(raw, 1, 2000))


def image_map(df: DataFrame, raw: str = "raw") -> DataFrame:
    """JSON object of image keys to (source, img_key, url) rows."""
    return df.select("source", F.explode(F.from_json(raw, "map<string,string>")).alias("img_key", "url"))


def pages(spark: SparkSession, path: str) -> DataFrame:
    """Stored pages with their file key."""
    return spark.read.parquet(path).select("page_id", "url", "html", C.url_file_name("url").alias("file_key"))


def absolute_url(base: Column, href: Column) -> Column:
    """Join of a page folder and a link: absolute, host-relative or folder-relative."""
    host = F.regexp_extract(base, r"^([a-zA-Z]+://[^/?#]*)", 1)
    folder = F.regexp_extract(base, r"^([a-zA-Z]+://[^?#]*/)", 1)
    return F.when(href.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), href).when(href.startswith("/"), F.concat(host, href)) \
        .otherwise(F.concat(folder, href))


def links(page: DataFrame, base: Column | None = None, suffixes: tuple[str, str] = (".html", ".pdf")) -> DataFrame:
    """Links of a page in first-occurrence order: page links made absolute, document links as written."""
    href = page.select("page_id", (base if base is not None else F.col("url")).alias("base"),
                       F.posexplode(C.matches(F.col("html"), r"(?is)<a\b[^>]*?\bhref\s*=\s*[\"']([^\"']*)[\"']", 1)).alias("pos", "href"))
    web, doc = F.col("href").endswith(suffixes[0]), F.col("href").endswith(suffixes[1])
    kept = href.filter(web | doc).select(
        "page_id", "pos", F.when(web, "html").otherwise("pdf").alias("kind"),
        F.when(web, absolute_url(F.col("base"), F.col("href"))).otherwise(F.col("href")).alias("link"))
    return kept.groupBy("page_id", "kind", "link").agg(F.min("pos").alias("pos"))


def atom_entries(spark: SparkSession, path: str) -> DataFrame:
    """Entries of Atom files with one row per link."""
    e = spark.read.schema(ENTRY_SCHEMA).format("xml").option("rowTag", "entry").load(path)
    return _entry_links(e)


ENTRY_SCHEMA = "title string, link array<struct<_href string, _rel string, _type string>>"


def _entry_links(e: DataFrame) -> DataFrame:
    own = [c for c in e.columns if c not in ("title", "link")]
    return e.select(*own, "title", F.explode_outer("link").alias("l")).select(*own, "title", F.col("l._href").alias("href"), F.col("l._type").alias("type"))


def entry_rows(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Atom entries in a string column, one row per link; the other columns stay."""
    own = [c for c in df.columns if c != raw]
    return _entry_links(df.select(*own, F.from_xml(raw, ENTRY_SCHEMA).alias("_e")).select(*own, "_e.title", "_e.link"))


FEATURE_SCHEMA = ("features array<struct<attributes struct<ordenanza string, nome string, clase string, clase_desc string, "
                  "cod string>, geometry struct<rings array<array<array<double>>>>>>")


def feature_pages(spark: SparkSession, path: str) -> DataFrame:
    """Features of all page files of a layer; ``page_full`` is false on the last page."""
    return _features(spark.read.schema(FEATURE_SCHEMA).json(path, multiLine=True).withColumn("file", F.col("_metadata.file_name")))


def feature_rows(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Features of pages in a string column (file, raw)."""
    return _features(df.select("file", F.from_json(raw, FEATURE_SCHEMA).alias("_p")).select("file", "_p.features"))


def _features(f: DataFrame) -> DataFrame:
    f = f.select("file", (F.size("features") >= 1000).alias("page_full"), F.posexplode("features").alias("idx", "f"))
    return f.select("file", "page_full", "idx", F.col("f.attributes.ordenanza").alias("ordinance"), F.col("f.attributes.nome").alias("name"),
                    F.col("f.attributes.clase").alias("class"), F.col("f.attributes.clase_desc").alias("class_desc"),
                    F.col("f.attributes.cod").alias("cod"), F.col("f.geometry.rings").alias("rings"))


def layer(df: DataFrame, name: str, x: str | None = None, multi: bool = False) -> DataFrame:
    """The known columns of a cadastral layer, lower-case names, NaN to NULL, rings (Web Mercator) to WGS84; with ``multi`` also the shape as
    ``parts``, where a single polygon is promoted to a shape of one part."""
    low = df.toDF(*[c.lower() for c in df.columns])
    keep = [c for c in LAYER_COLUMNS[name] if c in low.columns]
    doubles = {f.name for f in low.schema if f.dataType.simpleString() in ("double", "float")}
    cols = [F.when(F.isnan(c), None).otherwise(F.col(c)).alias(c) if c in doubles else F.col(c) for c in keep]
    if x and x.lower() in low.columns:
        cols.append(G.rings_to_wgs84(x.lower()).alias("rings"))
    out = low.select(*cols)
    return out.withColumn("parts", G.parts("rings")) if multi and "rings" in out.columns else out


def load_layer(df: DataFrame, name: str, path: str, replace: bool = False, rings: str | None = None) -> None:
    """Write a layer; without ``replace`` an existing target is left alone."""
    layer(df, name, rings).write.mode("overwrite" if replace else "ignore").parquet(path)


def street_names(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """Street-name file in latin-1."""
    df = spark.read.option("header", True).option("sep", sep).option("encoding", "ISO-8859-1").csv(path)
    low = df.toDF(*[c.lower() for c in df.columns])
    return low.select(*LAYER_COLUMNS["streets"])


def street_rows(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Lines of a street-name file as latin-1 bytes; the other columns stay."""
    own = [c for c in df.columns if c != raw]
    names = LAYER_COLUMNS["streets"]
    parsed = F.from_csv(F.decode(raw, "ISO-8859-1"), ", ".join(f"{c} string" for c in names))
    return df.select(*own, parsed.alias("_s")).select(*own, "_s.*")


def front_matter(df: DataFrame, content: str = "content") -> DataFrame:
    """YAML fields and body of wiki pages."""
    parts = F.split(content, "---", 3)
    has = F.col(content).startswith("---") & (F.size(parts) >= 3)
    head = F.when(has, parts[1])
    fields = {k: F.regexp_extract(F.coalesce(head, F.lit("")), rf'(?m)^{k}: "(.*)"$', 1).alias(k)
              for k in ("articulo", "titulo", "tipo_doc", "subtipo", "documento", "ordenanza", "capitulo", "generado")}
    tags = F.regexp_extract_all(F.regexp_extract(F.coalesce(head, F.lit("")), r"(?m)^tags: \[(.*)\]$", 1), F.lit(r'"([^"]*)"'), F.lit(1))
    body = C.strip(F.when(has, parts[2]).otherwise(F.col(content)))
    return df.select(*[c for c in df.columns if c != content], *fields.values(), tags.alias("tags"), body.alias("body"))


def wiki_pages(spark: SparkSession, path: str) -> DataFrame:
    """Wiki page files."""
    return front_matter(spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content")))


def deduplicated_images(docs: DataFrame) -> DataFrame:
    """Every inline image with the name of the first image of equal content in its source.

    ``docs``: source, md. The first image per (source, content) is a partial aggregate, so a picture repeated
    in a third of all pages is one row per task.
    """
    images = docs.select("source", F.posexplode(F.arrays_zip(
        C.matches(F.col("md"), X.INLINE_IMAGE_PARTS, 1).alias("ext"), C.matches(F.col("md"), X.INLINE_IMAGE_PARTS, 2).alias("b64"))).alias("pos", "i"))
    images = images.select("source", (F.col("pos") + 1).cast("long").alias("image_no"), F.col("i.ext").alias("ext"),
                           F.md5(F.unbase64("i.b64")).alias("hash"))
    first = first_by(images, ["source", "hash"], ["image_no"]).select(
        "source", "hash", F.concat("source", F.lit("/imagen_"), "image_no", F.lit("."), "ext").alias("file"))
    return images.join(first, ["source", "hash"]).select(
        "source", "image_no", F.concat(F.lit("IMAGEN_"), "image_no").alias("img_key"), "hash", "file")
