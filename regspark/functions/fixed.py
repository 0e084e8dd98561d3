"""Word lists, patterns and constants that results depend on.

Patterns are written without inline flags and without look-around, so that the same text works in
Java regex (Spark) and in RE2. Callers add the flags.
"""

# --- fixed values: page boilerplate (pattern, dot matches newline) ---
FOOTERS = [
    (r"REVISIÓN DEL.*?ataD", True),
    (r"\d+ de \d+", False),
    (r"OFICINA DE PLANEAMIENTO.*?2025", True),
    (r"S\.E\.P\.I\.A\..*?\n", False),
    (r"onalletsac.*?\n", False),
]
# a text without these words has no match of the pattern in the same place above
FOOTER_WORDS = ["REVISIÓN DEL", " de ", "OFICINA DE PLANEAMIENTO", "S.E.P.I.A.", "onalletsac"]

# --- fixed values: HTML ---
REMOVED_TAGS = ["script", "style", "nav", "header", "footer", "iframe"]
ARTICLE_KEYWORDS = ["artículo", "articulo", "art.", "art ", "capítulo", "capitulo", "sección", "seccion"]

# --- fixed values: article and heading patterns ---
PLAIN_ARTICLE = r"Art\.\s+(\d+[a-z]?)\.\s+((?:[^.\n]+|\n[^.\n]+)(?:\n[^.\n]+)*\n?|\n)\."
PLAIN_TITLE = r"TÍTULO\s+([IVX]+)\.\s+([^\n]+)"
PLAIN_CHAPTER = r"CAPÍTULO\s+([IVX]+)\.\s+([^\n]+)"
PLAIN_SECTION = r"Sección\s+(\d+ª)\.\s+([^\n]+)"
PLAIN_ITEM = r"^(\d+[a-z]?|[a-z])[.)\-]\s+"
MD_ARTICLE = r"^##\s+Art(?:[ií]culo|\.)\s*(\d+(?:\.\d+)?)[.:]?\s*(.+?)\.?\s*$"
MD_ARTICLE_COMPAT = r"^##\s+Art(?:iculo|\.)\s*(\d+(?:\.\d+)?)[.:]?\s*(.+?)\.?\s*$"
MD_ANNEX = r"^##\s+ANEXO\s*(II+|I)\b"
MD_CODED_SECTION = r"^##\s+Secci[oó¾]n\s+([A-Z]{1,3}[\s\-]?\d+(?:\.\d+)?)\s+(.+?)$"
MD_LEVEL1 = r"^##\s+(\d+)\s+([A-ZÁÉÍÓÚÑ][^#\n]{3,80})$"
MD_APPENDIX = r"^##\s+Anejo\s+([A-Z])\s+(.+?)$"
MD_CHAPTER = r"^#{1,2}\s+(?:CAP[ÍI]TULO|T[ÍI]TULO)\s+(.+?)$"
ORDINANCE_CODE = r"[UNR]\d+(?:\.[A-Z0-9]+)?"
ORDINANCE_CODE_COMPAT = r"[UNR]\d+(?:\.\d+)?"
IMAGE_TAG = r"\[IMAGEN_\d+\]"
IMAGE_WORD = "[IMAGEN_"  # stands in every image tag
INLINE_IMAGE = r"!\[Image\]\(data:image[^)]+\)"
INLINE_IMAGE_PARTS = r"!\[Image\]\(data:image/(png|jpeg|jpg);base64,([^)]+)\)"
PIPE_TABLE = r"(\|[^\n]+\|\n(?:\|[-:]+\|[-:\s|]*\n)?(?:\|[^\n]+\|\n)+)"
OCR_SECTIONS = [
    r"\n([A-C](?:\.\d+)+\.\s+[A-ZÁÉÍÓÚÑ][^\n]{3,})",
    r"\n([A-C]\.\s+[A-ZÁÉÍÓÚÑ][^\n]{5,})",
    r"\n([A-C](?:\.\d+)+\.[ \t]+\S[^\n]{3,})",
]

# --- fixed values: concept flags (flag, header label, terms) ---
CONCEPTS = [
    ("defines_height", "altura", ["altura", "plantas", "pisos", "niveles", "rasante", "cota", "coronación"]),
    ("defines_occupation", "ocupación", ["ocupación", "ocupacion", "superficie ocupada"]),
    ("defines_buildability", "edificabilidad", ["edificabilidad", "aprovechamiento", "m²/m²", "m2/m2"]),
    ("defines_setbacks", "retranqueos", ["retranqueo", "separación", "lindero", "medianera", "fachada"]),
    ("defines_min_plot", "parcela mínima",
     ["parcela mínima", "solar mínimo", "superficie mínima", "frente mínimo"]),
    ("defines_uses", "usos", ["uso", "compatible", "permitido", "prohibido", "autorizable"]),
]

# --- fixed values: keyword vocabulary ---
VOCABULARY = [
    "altura", "plantas", "metros", "edificabilidad", "ocupación", "ocupacion", "retranqueo", "retranqueos", "parcela",
    "solar", "fachada", "alineación", "alineacion", "rasante", "cota", "volumen", "uso", "usos", "residencial",
    "comercial", "industrial", "dotacional", "equipamiento", "vivienda", "local", "sótano", "sotano", "bajo",
    "cubierta", "ático", "atico", "vuelo", "voladizo", "medianera", "lindero", "frente", "fondo", "separación",
    "separacion", "mínima", "minima", "máxima", "maxima", "consolidado", "urbanizable", "rústico", "rustico",
    "núcleo", "nucleo", "rural", "urbano",
]
MEASURES = [
    r"(\d+(?:[,.]\d+)?)\s*(m²|m2|metros cuadrados)",
    r"(\d+(?:[,.]\d+)?)\s*(m\.?|metros?)\b",
    r"(\d+(?:[,.]\d+)?)\s*(plantas?|pisos?)",
    r"(\d+(?:[,.]\d+)?)\s*(%|por ciento)",
]

# --- fixed values: cross references (priority, kind, pattern); {acr} is the acronym group ---
ART = r"art(?:ículo|\.)?\s+(\d+(?:\.\d+)?)"
REFERENCES = [
    (1, "own", ART + r"\s+de\s+(?:la\s+presente\s+|esta\s+|estas\s+|las\s+presentes\s+)(Normativa|Normas)"),
    (1, "law", ART + "\\s+de\\s+la\\s+[“”\"]L[eé]i?\\s+(\\d+/\\d+)"),
    (1, "named", ART + r"\s+de\s+la\s+(Constitución)"),
    (2, "named", ART + r"\s+de\s+(?:su|dicho|dicha)\s+(reglamento|Ley)"),
    (2, "acronym", ART + r"\s+(?:de\s+la\s+|del\s+)?{acr}\b"),
    (2, "law", ART + r"\s+de\s+la\s+Ley\s+(\d+/\d+)"),
    (2, "named", ART + r"\s+del?\s+(Real\s+Decreto|Reglamento)"),
    (3, "none", r"(?:conforme|según|establecido|previsto|atender[áa])\s+(?:al|en\s+el|a\s+lo\s+establecido\s+en\s+el)"
                r"\s+" + ART + r"\b()"),
]
# a lower-case text without one of these has no match of the reference pattern in the same place; no letter that other letters
# fold to (i, s, k) is among them
REFERENCE_WORDS = [["norma"], ["“", "”", '"'], ["tuc"], ["reglam", "ley"], ["art"], ["ley"], ["decreto", "reglam"],
                   ["onforme", "gún", "tablec", "prev", "atender"]]
OWN_SOURCE = "esta Normativa"
NO_SOURCE = "no especificada"
REFERENCE_CORRECTIONS = [("18", "DE", "Ley 37/2015"), ("2", "DE", "Ley 37/2015"), ("44.6", "DE", "Ley de Costas")]
WIKI_ARTICLE = r"\bArt(?:ículo|iculo|\.)?\s*\.?\s*(\d+(?:\.\d+)?)\b"

# --- fixed values: article requests in a question, tried in order ---
ARTICLE_REQUESTS = [
    r"(?:art(?:iculo)?\.?\s+|artigo\s+)(\d+)",
    r"(?:ver|muestra|mostrar|dame|consulta|busca)\s+(?:el\s+)?(?:art(?:iculo)?\.?\s+|artigo\s+)?(\d+)",
    r"^(\d+)$",
]

# --- fixed values: retrieval ---
TOP_K_VIEW = 20
TOP_K_FINAL = 5
TOP_K_SERVICE = 12
SCORE_FLOOR = 0.3
SERVICE_FLOOR = 0.05
RRF_K = 60
ORDINANCE_ALIASES = {"U1.1": "U1", "U1.2": "U1"}
CODE_SOURCES = ["cte-si", "cte-sua", "cte-hs", "cte-se", "cte-se-ae", "cte-se-a", "cte-se-c", "cte-se-f",
                "cte-se-m", "cte-hr", "cte-he"]
RERANK_TERMS = ["residencial", "vivienda", "altura", "retranqueo", "edificabilidad", "parcela"]
RERANK_PREFIX = "Normativa urbanística PXOM Vigo uso residencial vivienda: "
BLOCK_SEPARATOR = "\n\n---\n\n"
NO_HITS_CONTEXT = "(Sin fragmentos relevantes)"
PARAMETER_COLUMNS = ["buildability", "max_height", "max_occupation", "front_setback", "side_setback", "rear_setback"]

# --- fixed values: street names ---
STREET_ARTICLES = ["DO ", "DA ", "DOS ", "DAS ", "DE O ", "DE A ", "DEL ", "DE ", "DE LA ", "DE LOS ", "DE LAS ",
                   "D'", "EL ", "LA ", "LOS ", "LAS "]
ADDRESS_PREFIXES = ["calle ", "c/", "c\\", "avenida ", "av.", "av ", "plaza ", "praza ", "pza.", "paseo ", "rua ",
                    "rúa ", "rúa de ", "camiño ", "camino ", "estrada ", "carretera ", "ctra.", "travesía ",
                    "travesia ", "lugar "]
TYPED_REWRITES = ["rúa", "avenida", "camiño", "estrada", "praza", "rúa de"]
UNTYPED_REWRITES = ["rúa", "avenida", "camiño", "estrada", "rúa de", "praza"]
FALLBACK_PREFIXES = ["estrada ", "carretera ", "ctra. ", "camiño ", "camino ", "rúa ", "rua ", "avenida ", "av. ",
                     "plaza ", "praza ", "paseo ", "travesía ", "lugar ", "calle ", "c/ "]
# street type code, words that select it, name pattern, alternate codes to try next
STREET_TYPES = [
    ("RU", ["rúa", "rua"], r"r[uú]a\s+(?:d[oa]s?\s+)?([^,]+)", ["AV", "CL", "CM", "CR", "PZ"]),
    ("AV", ["avenida"], r"avenida\s+(?:de\s+)?([^,]+)", ["RU", "CL", "PS"]),
    ("PZ", ["praza", "plaza"], r"p(?:ra)?za\s+(?:d[oa]s?\s+)?([^,]+)", ["RU"]),
    ("CM", ["camiño", "camino"], r"cami[nñ]o\s+(?:d[oa]s?\s+)?([^,]+)", ["CR", "RU"]),
    ("CR", ["estrada", "carretera"], r"(?:estrada|carretera)\s+(?:d[oa]s?\s+)?([^,]+)", ["CM", "RU"]),
    ("PS", ["paseo"], r"paseo\s+(?:de\s+)?([^,]+)", ["AV", "RU"]),
]
TOWNS = ["VIGO", "PONTEVEDRA"]

# --- fixed values: geography ---
EARTH_RADIUS = 6378137.0
MEAN_EARTH_RADIUS = 6371008.8
# two service boxes: lat min, lat max, lon min, lon max
SERVICE_BOXES = [(42.13, 42.29, -8.82, -8.60), (42.13, 42.30, -8.79, -8.61)]
URBAN_CLASSES = ["UC", "UNC", "SU", "SUC", "SUNC"]
RUSTIC_CLASSES = ["SR", "SNR"]
NEARBY_METRES = 50.0
KEY_FIELD_TOKENS = ["zona", "ordenanza", "codigo", "clas", "edif", "altura"]

# --- fixed values: OCR repairs, applied in order ---
OCR_REPAIRS = [
    ("Articulo1o.", "Articulo 10."),
    ("Articulo1o ", "Articulo 10 "),
    ("Articulo2o.", "Articulo 20."),
    ("Articulo3o.", "Articulo 30."),
    ("Viviendasenedificacionesdenuevaconstruccion", "Viviendas en edificaciones de nueva construccion"),
    ("Verificaciondesucumplimento", "Verificacion de su cumplimento"),
    ("ComiteAsesordeHabitabilidad", "Comite Asesor de Habitabilidad"),
    ("Obrasdeadecuacionestructural", "Obras de adecuacion estructural"),
    ("obrasdeadecuacionfuncionaldeedificios", "Obras de adecuacion funcional de edificios"),
    ("Obrasderemodelaciondeedificios", "Obras de remodelacion de edificios"),
    ("Obrasdeampliaciondeedificiosoviviendas", "Obras de ampliacion de edificios o viviendas"),
    ("Losanexosdehabitabilidad", "Los anexos de habitabilidad"),
    ("deedificiosyviviendas", "de edificios y viviendas"),
    ("deviviendas", "de viviendas"),
    ("enestedecreto", "en este decreto"),
    ("°. ", ""),
    ("°.", ""),
]
OCR_HEADING = r"^(##\s+Articulo)\s*(\d+[a-z]?)\s*[.\s]*(.+?)\.?\s*$"

# --- fixed values: chat and model requests ---
HISTORY_MESSAGES = 6
PROMPT_CHARS = 600
SECTION_CHARS = 4000
WIKI_CHARS = 8000
SUMMARY_CHARS = 500
DAILY_LIMIT_SECONDS = 300.0
