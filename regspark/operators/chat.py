"""Chat histories and answer requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regspark.functions import fixed as X
from regspark.operators.segscan import scan

# --- fixed values: answer request texts ---
LANGUAGE_SUFFIX = {
    "gl": "\n\nResponde SIEMPRE en GALLEGO (galego). Usa terminología técnica galega: edificabilidade, recuamento, "
          "aproveitamento, planta baixa, aliñación, vivenda, solo urbano, Plan Xeral, medianeira, cuberta, voo, "
          "cédula de habitabilidade, etc.",
    "es": "\n\nResponde SIEMPRE en ESPAÑOL.",
}
NO_HITS_REPLY = ("No se encontraron fragmentos relevantes para esta consulta. "
                 "Prueba a reformular la pregunta con términos más específicos.")
QUESTION_HEAD = "Analiza los siguientes fragmentos normativos y responde a la pregunta.\n\nPREGUNTA: "
QUESTION_TAIL = (
    "\n\nINSTRUCCIONES INTERNAS (no las incluyas en la respuesta final):\n"
    "1. Identifica qué artículos son relevantes y por qué.\n2. Si hay tablas, extrae los datos exactos.\n"
    "3. Detecta contradicciones entre fragmentos.\n4. Cita artículos concretos y fuentes.\n\nRESPUESTA:")
PARCEL_TAIL = ("\n\nResponde siguiendo esta estructura:\n1. Datos de la parcela (resume los datos anteriores)\n"
               "2. Normativa aplicable (cita artículos concretos)\n3. Conclusión y limitaciones detectadas")
RULE = "═" * 40


def history(messages: DataFrame, n: int = X.HISTORY_MESSAGES) -> DataFrame:
    """The ``n`` messages before each one, oldest first. ``messages``: conv_id, turn, role, text."""
    return scan(messages, ["conv_id"], "turn", tails={"history": (F.struct("role", "text"), n)})


def sessions(messages: DataFrame) -> DataFrame:
    """Session number per conversation; it goes up when the active parcel ``rc`` changes."""
    return scan(messages, ["conv_id"], "turn", run=("session", F.col("rc")))


def session_history(messages: DataFrame, n: int = X.HISTORY_MESSAGES) -> DataFrame:
    """W1 + W2: history that starts again when the parcel changes, in the same scan as the session numbers."""
    return scan(messages, ["conv_id"], "turn", tails={"history": (F.struct("role", "text"), n)}, run=("session", F.col("rc")))


def system_text(base: Column, language: Column) -> Column:
    """System text with the language suffix."""
    return F.concat(base, F.when(language == "gl", LANGUAGE_SUFFIX["gl"]).otherwise(LANGUAGE_SUFFIX["es"]))


def question_text(question: Column, context: Column) -> Column:
    """User message of an answer request."""
    return F.concat(F.lit(QUESTION_HEAD), question, F.lit("\n\nFRAGMENTOS:\n"), context, F.lit(QUESTION_TAIL))


def parcel_question_text(question: Column, context: Column, parcel: dict[str, Column]) -> Column:
    """User message with the parcel block. ``parcel``: ref, area, street, number, zone, ordinance, land_class."""
    def known(name: str) -> Column:
        return F.coalesce(F.nullif(parcel[name].cast("string"), F.lit("")), F.lit("N/D"))

    def plain(name: str) -> Column:
        return F.coalesce(parcel[name].cast("string"), F.lit(""))

    return F.concat(
        F.lit("DATOS DE LA PARCELA (Catastro + PXOM):\n- Referencia catastral : "), plain("ref"),
        F.lit("\n- Superficie           : "), known("area"), F.lit(" m²\n- Vía / Número         : "), plain("street"), F.lit(" nº "),
        plain("number"), F.lit("\n- Zona PXOM            : "), known("zone"), F.lit(" (ordenanza "), plain("ordinance"),
        F.lit(")\n- Clasificación        : "), known("land_class"), F.lit(f"\n\n{RULE}\nNORMATIVA APLICABLE:\n{RULE}\n"), context,
        F.lit(f"\n\n{RULE}\nPREGUNTA DEL ARQUITECTO:\n"), question, F.lit(PARCEL_TAIL))


def answer_requests(questions: DataFrame, contexts: DataFrame, system: str) -> DataFrame:
    """Request table: system and user message plus history; questions without fragments get the fixed reply.

    ``questions``: query_id, question, language, history. ``contexts``: query_id, context.
    """
    j = questions.join(contexts, "query_id", "left")
    hit = F.col("context").isNotNull()
    return j.select("query_id", "history",
                    F.when(hit, system_text(F.lit(system), F.col("language"))).alias("system"),
                    F.when(hit, question_text(F.col("question"), F.col("context"))).alias("user"),
                    F.when(~hit, F.lit(NO_HITS_REPLY)).alias("fixed_reply"))
