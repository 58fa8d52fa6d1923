"""Names, texts and numbers that results are compared on."""

# --- fixed values -----------------------------------------------------------

# Record fields (JSON name = column name), each a string.
RECORD_FIELDS = (
    "Nombre",
    "Ciudad",
    "País",
    "Fecha de Nacimiento",
    "Carrera",
    "Número de Teléfono",
    "Correo",
    "Entidad Donde Estudió",
    "Resumen del Postulante",
    "RUN del postulante",
)
RECORD_KEY = "RUN del postulante"
FIELD_DEFAULT = "No especificado"

# Name of the column that holds the source file.
SOURCE_NAME = "pdf_name"

# Keys that count as missing once trimmed and lower-cased.
MISSING_KEYS = ("", "no especificado")

# Characters dropped from a key when it names a stored document.
KEY_PUNCTUATION = ".- "

# What Python calls white space.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x20\x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Reply clean-up.
FENCE_CHARACTER = "`"
FENCE_TAG = "json"

# Document link.
LINK_PREFIX = '<a href="data:application/pdf;base64,'
LINK_SUFFIX = '" target="_blank">Ver PDF</a>'
LINK_MISSING = "No disponible"

# Stored document path.
DOCUMENT_FOLDER = "curriculums"
DOCUMENT_SUFFIX = ".pdf"

# Chat request.
SYSTEM_PROMPT = "you are an AI helpful assistant .\n    "
TEMPERATURE = 0.2
TOP_P = 0.9
MAX_TOKENS = 2000

# Prompt placed before the document text.
EXTRACTION_PROMPT = (
    "A continuación verás un currículum vitae. "
    "Extrae los siguientes campos y devuélvelos ÚNICAMENTE en formato JSON válido: "
    '{"Nombre": "...", "Ciudad": "...", "País": "...", "Fecha de Nacimiento": "...", '
    '"Carrera": "...", "Número de Teléfono": "...", "Correo": "...", '
    '"Entidad Donde Estudió": "...", "Resumen del Postulante": "...", "RUN del postulante": ""} '
    "No incluyas texto adicional, ni bloques de código.\nCurrículum:\n"
)

# Search.
HITS_PER_QUESTION = 2
CHUNK_SIZE = 1000
KEYS_LISTED = 5

# ----------------------------------------------------------------------------

# Default prompt around one search hit: before and after the text. Our own
# wording; jobs take another one as ``template``.
SUMMARY_PROMPT = (
    "Fragmento de un documento:\n\n'",
    "'\n\nEscribe en una o dos frases qué dice este fragmento que ayude a responder la consulta.",
)
