"""Enrichment jobs around a model provider: texts, prompts, answers, error handling and wiki pages."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regspark.functions import features as FE
from regspark.functions import fixed as X
from regspark.functions import text as C
from regspark.operators.state import run_summary, update_where
from regspark.providers import TextProvider, add_completions
from regspark.session import cut_lineage

# --- fixed values: request texts ---
QUESTION_PROMPT = ("Normativa urbanística. Fragmento:\n---\n", "\n---\nOrdenanza: ", "\nConceptos: ",
                   "\n\nEscribe 2 preguntas cortas que haría un arquitecto para encontrar esto.\n"
                   "Una por línea, con signo de interrogación, sin numerar.")
SUMMARY_PROMPT = ("Resume en 1 frase este fragmento de normativa. Incluye valores numéricos si los hay.\n\n",
                  "\n\nResumen (1 frase, sin introducción):")
PARAMETER_SCHEMA = ("{\n  \"edificabilidad\": número m²/m² o null,\n  \"altura_maxima\": número entero (plantas) o null,\n"
                    "  \"ocupacion_maxima\": número porcentaje 0-100 o null,\n  \"retranqueo_frontal\": metros o null,\n"
                    "  \"retranqueo_lateral\": metros o null,\n  \"retranqueo_posterior\": metros o null\n}")
PARAMETER_SYSTEM = ("Eres un extractor de parámetros urbanísticos del PXOM de Vigo. "
                    "Devuelve ÚNICAMENTE un JSON válido, sin markdown, sin explicaciones. "
                    "Si un valor no aparece explícitamente en el texto, usa null.")
PARAMETER_FIELDS = ["edificabilidad", "altura_maxima", "ocupacion_maxima", "retranqueo_frontal", "retranqueo_lateral",
                    "retranqueo_posterior"]
READERS = {
    "PXOM": "normativa urbanística municipal (PXOM). El lector es un arquitecto o técnico municipal que necesita entender qué "
            "regula el artículo, qué usos, alturas, edificabilidades y retranqueos fija, y cómo se relaciona con otras "
            "ordenanzas del PXOM.",
    "NHV": "normativa de habitabilidad de vivienda de Galicia (NHV). El lector es un arquitecto técnico que necesita aplicar "
           "estas condiciones mínimas en proyectos de vivienda: superficies, alturas libres, iluminación, ventilación y "
           "accesibilidad.",
    "CTE": "Código Técnico de la Edificación (CTE). El lector es un arquitecto o ingeniero que necesita aplicar este documento "
           "básico en proyecto: exigencias técnicas, valores límite, métodos de cálculo y relación con otras secciones del CTE.",
}
OTHER_READER = "normativa técnica de edificación."
PARTIAL_NOTICE = ("\nNOTA: El artículo es extenso. Solo se muestra la primera parte. Indica en notas_interpretacion que el "
                  "resumen es parcial y cubre solo la introducción.")
WIKI_ANSWER = """El JSON debe tener EXACTAMENTE estas claves:
{
  "resumen": "2-3 frases claras sobre qué regula, qué exige y por qué importa.",
  "notas_interpretacion": ["nota práctica 1", "nota práctica 2", "caso límite o excepción"],
  "referencias_cruzadas": ["Art. X / Sección Y — motivo de la relación"],
  "tags": ["tag1", "tag2", "tag3"]
}

Criterios:
- resumen: directo, sin jerga innecesaria, orientado a aplicación práctica.
- notas_interpretacion: advertencias reales, excepciones, casos frecuentes en proyecto.
- referencias_cruzadas: SOLO artículos mencionados explícitamente en el texto proporcionado. No inventes referencias ni cites documentos externos que no aparezcan en el texto.
- tags: conceptos técnicos clave (altura, retranqueo, resistencia al fuego, etc.).

Solo JSON."""
WIKI_SCHEMA = "resumen string, notas_interpretacion array<string>, referencias_cruzadas array<string>, tags array<string>"
NO_NOTES, NO_REFS = "_Sin notas._", "_Sin referencias identificadas._"


def embedding_texts() -> dict[str, Column]:
    """The three texts of a chunk that get a vector."""
    none = F.array().cast("array<string>")
    questions, words = F.coalesce("questions", none), F.coalesce("keywords", none)
    summary = F.coalesce("summary", F.lit(""))
    return {
        "view_text": F.col("text_with_header"),
        "view_summary": F.when(summary != "", summary).otherwise(F.substring("text", 1, X.SUMMARY_CHARS)),
        "view_questions": F.when(F.size(questions) > 0, F.array_join(questions, " | "))
        .otherwise(F.concat("header", F.lit(" "), F.array_join(words, " "))),
    }


def question_prompt(text: str, code: str, words: str) -> Column:
    """Request for two questions."""
    a, b, c, d = (F.lit(p) for p in QUESTION_PROMPT)
    listed = F.coalesce(F.nullif(F.array_join(F.slice(words, 1, 5), ", "), F.lit("")), F.lit("N/A"))
    return F.concat(a, F.substring(text, 1, X.PROMPT_CHARS), b, F.coalesce(F.nullif(F.col(code), F.lit("")), F.lit("N/A")), c, listed, d)


def summary_prompt(text: str) -> Column:
    """Request for a one-sentence summary."""
    return F.concat(F.lit(SUMMARY_PROMPT[0]), F.substring(text, 1, X.PROMPT_CHARS), F.lit(SUMMARY_PROMPT[1]))


def enrich_chunks(chunks: DataFrame, provider: TextProvider | None) -> DataFrame:
    """Keywords, two questions and a summary per chunk; ``status`` tells which rows stay pending."""
    c = chunks.withColumn("keywords", FE.keywords("text"))
    if provider is None:
        return c.withColumns({"questions": F.array().cast("array<string>"), "summary": F.lit(""), "status": F.lit("ok")})
    c = c.withColumns({"_qp": question_prompt("text", "ordinance_code", "keywords"), "_sp": summary_prompt("text")})
    done = add_completions(c, {"_qa": "_qp", "_sa": "_sp"}, provider)
    return done.withColumns({"questions": C.clean_questions("_qa"), "summary": F.trim("_sa"),
                             "status": F.coalesce(error_status("error"), F.lit("ok"))}).drop("_qp", "_sp", "_qa", "_sa", "error")


def error_wait(error: Column | str) -> Column:
    """Seconds to wait before the next try, NULL when the error is not a rate limit."""
    e = C._col(error)
    hint = F.regexp_extract(e, r"try again in ([\d.]+)s", 1).try_cast("double")
    return F.when(e.contains("429"), F.coalesce(hint + 0.5, F.lit(5.0)))


def error_status(error: Column | str) -> Column:
    """NULL without error, else quota / retry / empty. ``quota`` and ``retry`` rows stay pending."""
    e, wait = C._col(error), error_wait(error)
    return F.when(e.isNull(), F.lit(None)).when(wait > X.DAILY_LIMIT_SECONDS, "quota").when(wait.isNotNull(), "retry").otherwise("empty")


def parameter_prompt(code: Column, context: Column) -> Column:
    """E5: request for the six parameters of an ordinance."""
    return F.concat(F.lit("Ordenanza: "), code, F.lit("\n\nNormativa:\n"), context, F.lit("\n\nExtrae exactamente este JSON:\n" + PARAMETER_SCHEMA))


def parse_parameters(answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """E5: (parameters per code, error table). ``answers``: code, context, answer, error."""
    schema = ", ".join(f"{f} double" for f in PARAMETER_FIELDS)
    text = C.model_json_text("answer")
    ok = F.try_parse_json(text).isNotNull() & text.startswith("{")
    reason = F.when(F.coalesce("context", F.lit("")) == "", "sin_chunks").when(F.col("error").isNotNull(), F.col("error")) \
        .when(~F.coalesce(ok, F.lit(False)), "json_error")
    a = answers.withColumn("reason", reason)
    values = F.from_json(C.model_json_text("answer"), schema)
    good = a.filter("reason is null").withColumn("p", values).select(
        "code", *[F.col("p")[f].alias(n) for f, n in zip(PARAMETER_FIELDS, X.PARAMETER_COLUMNS)])
    return good, a.filter("reason is not null").select("code", "reason")


def joined_context(picked: DataFrame, chunks: DataFrame) -> DataFrame:
    """E5: texts of the picked chunks (code, rank, chunk_id) in rank order; at most eight per code."""
    j = picked.join(chunks.select("chunk_id", "text_with_header"), ["chunk_id"])
    return j.groupBy("code").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text_with_header"))),
                                                          lambda s: s["text_with_header"]), X.BLOCK_SEPARATOR).alias("context"))


@dataclass
class ParameterRun:
    """``zones``: all zones with the extracted parameters; ``parameters``: one row a code; ``errors``: code, reason; ``summary``: codes by outcome."""

    zones: DataFrame
    parameters: DataFrame
    errors: DataFrame
    summary: DataFrame


def parameter_flow(codes: DataFrame, chunks: DataFrame, zones: DataFrame, provider: TextProvider, search=None) -> ParameterRun:
    """E5 as one flow: context of each ordinance (V9), request with the system text, answer, parameters into the zones (K8), errors.

    ``codes``: code, vector. ``search``: what picks the chunks, ``ordinance_context`` if not given. A code without chunks is not asked. Each code is
    asked once: the answers are written before they are used.
    """
    from regspark.operators.retrieve import ordinance_context

    picked = (search or ordinance_context)(codes, chunks)
    asked = codes.select("code").distinct().join(joined_context(picked, chunks), "code", "left")
    empty = F.coalesce("context", F.lit("")) == ""
    request = F.concat(F.lit(PARAMETER_SYSTEM + "\n\n"), parameter_prompt(F.col("code"), F.col("context")))
    answered = add_completions(asked.filter(~empty).withColumn("_p", request), {"answer": "_p"}, provider).drop("_p")
    none = F.lit(None).cast("string")
    answers = cut_lineage(answered.select("code", "context", "answer", "error").unionByName(asked.filter(empty).select("code", "context", none.alias("answer"), none.alias("error"))))
    good, bad = parse_parameters(answers)
    named = good.withColumnRenamed("code", "ordinance")
    held = zones.select(*zones.columns, *[F.lit(None).cast("double").alias(c) for c in X.PARAMETER_COLUMNS if c not in zones.columns])
    outcome = good.select("code", F.lit(None).cast("string").alias("reason")).unionByName(bad)
    return ParameterRun(update_where(held, named, "ordinance", X.PARAMETER_COLUMNS), good, bad, run_summary(outcome))


def wiki_prompt() -> Column:
    """Metadata request of an article; columns kind, subkind, label, number, title, block, chapter, ordinance_code."""
    reader = F.lit(None).cast("string")
    for kind, text in READERS.items():
        reader = F.when(F.col("kind") == kind, F.lit(text)).otherwise(reader)
    reader = F.coalesce(reader, F.lit(OTHER_READER))

    def line(label: str, col: str) -> Column:
        return F.when(F.coalesce(F.col(col), F.lit("")) != "", F.concat(F.lit(label), F.col(col), F.lit("\n"))).otherwise(F.lit(""))

    return F.concat(
        F.lit("Eres un experto en "), reader,
        F.lit("\n\nAnaliza el siguiente artículo y responde ÚNICAMENTE con un objeto JSON válido.\n"
              "Sin texto adicional, sin bloques markdown, sin ```json.\n\nDocumento: "), "label", F.lit("\n"),
        line("Ordenanza: ", "ordinance_code"), line("Capítulo: ", "chapter"),
        F.when(C.is_partial("block"), F.lit(PARTIAL_NOTICE)).otherwise(F.lit("")),
        F.lit("\nArtículo: "), "subkind", F.lit(" — Art. "), "number", F.lit(". "), "title", F.lit("\nTexto:\n"),
        F.substring("block", 1, X.WIKI_CHARS),
        F.lit("\n\n" + WIKI_ANSWER))


def parse_wiki_answer(raw: Column | str) -> Column:
    """Metadata record; a text that is not JSON becomes the summary."""
    text = C.model_json_text(raw)
    none = F.array().cast("array<string>")
    fallback = F.struct(text.alias("resumen"), none.alias("notas_interpretacion"), none.alias("referencias_cruzadas"), none.alias("tags"))
    return C.parse_model_json(raw, WIKI_SCHEMA, fallback)


def section_prompt(instructions: str, text: Column | str) -> Column:
    """Request to structure one OCR section, cut at 4000 characters."""
    return F.concat(F.lit(instructions), C.truncate(text, X.SECTION_CHARS))


def section_record(code: Column, text: Column) -> Column:
    """Fallback record of a section whose answer is not JSON."""
    return F.struct(code.alias("number"), F.substring(C.strip(F.split(text, "\n")[0]), 1, 100).alias("title"), text.alias("text"),
                    F.filter(F.transform(F.split(text, "\n\n"), C.strip), lambda p: p != "").alias("paragraphs"),
                    F.substring(code, 1, 1).alias("chapter"))


def wiki_page(date: Column, model: str = "offline") -> Column:
    """Page text; columns number, title, block, chapter, ordinance_code, kind, subkind, label, summary, notes, refs,
    tags, image_urls."""
    def bullets(col: str, empty: str) -> Column:
        return F.when(F.size(col) > 0, F.array_join(F.transform(F.col(col), lambda x: F.concat(F.lit("- "), x)), "\n")).otherwise(F.lit(empty))

    chapter, ordinance = F.coalesce("chapter", F.lit("—")), F.coalesce("ordinance_code", F.lit("—"))
    urls = F.filter("image_urls", lambda u: u != "")
    images = F.when(F.size(urls) > 0, F.concat(F.lit("## Imágenes\n\n"), F.array_join(F.transform(urls, lambda u: F.concat(
        F.lit("![]("), u, F.lit(")"))), "\n\n"), F.lit("\n\n"))).otherwise(F.lit(""))
    notice = F.when(C.is_partial("block"), F.concat(
        F.lit("\n> ⚠ **Resumen parcial** — Este artículo es extenso ("), F.format_number(F.length("block"), 0),
        F.lit(" chars). El resumen y las notas cubren solo la primera parte.\n"))).otherwise(F.lit(""))
    front = {"articulo": F.col("number"), "titulo": F.col("title"), "tipo_doc": F.col("kind"), "subtipo": F.col("subkind"),
             "documento": F.col("label"), "ordenanza": ordinance, "capitulo": chapter, "generado": date}
    head = [part for k, v in front.items() for part in (F.lit(f'{k}: "'), v, F.lit('"\n'))]
    return F.concat(
        F.lit("---\n"), *head, F.lit("tags: ["), C.yaml_list("tags"), F.lit("]\n---\n\n# "), "subkind", F.lit(" — Art. "), "number",
        F.lit(". "), "title", F.lit("\n\n> **Tipo:** `"), "kind", F.lit("` | **Documento:** "), "subkind", F.lit(" | **Capítulo:** "),
        chapter, F.lit(" | **Ordenanza:** "), ordinance, F.lit("\n\n## Resumen\n"), notice, F.lit("\n"), "summary",
        F.lit("\n\n---\n\n## Texto Original\n\n"), "block", F.lit("\n\n"), images, F.lit("---\n\n## Notas de Interpretación\n\n"),
        bullets("notes", NO_NOTES), F.lit("\n\n## Referencias Cruzadas\n\n"), bullets("refs", NO_REFS), F.lit("\n\n---\n\n"),
        C.tag_line("tags"), F.lit("\n*Generado el "), date, F.lit(f" con `{model}`*\n"))
