"""Fixed values.

Everything in this module is data whose exact spelling is part of the result:
domains, limits, message texts, labels, formats and the two prompt texts.  The
operators import from here and hold no such literals of their own.
"""

# --- fixed values: processing states and stages -----------------------------
PENDING = "PENDING"
PROCESSING = "PROCESSING"
COMPLETED = "COMPLETED"
FAILED = "FAILED"
FIRST_STAGE = "ingestion"
STAGES = ("Ingesta", "Extracción", "Limpieza", "llm_processing")
STAGE_MESSAGE = "Iniciando etapa: "
DEFAULT_MODEL = "gpt-4o-mini"
STORED_STATE = "procesada"

# --- fixed values: domains ---------------------------------------------------
PAYMENT_METHODS = (
    "CONTADO",
    "CREDITO",
    "TARJETA",
    "EFECTIVO",
    "TRANSFERENCIA",
    "YAPE",
    "PLIN",
)
CURRENCIES_STRICT = ("PEN", "USD")
CURRENCIES_FORM = ("PEN", "USD", "EUR", "GBP", "JPY")
DEFAULT_CURRENCY = "PEN"
CLIENT_CODE_PATTERN = r"\A([0-9]{11}|[0-9]{8})\z"

# --- fixed values: extraction strategies, in order of preference -------------
EXTRACTION_METHODS = ("PyMuPDF", "pdfplumber", "PyPDF2")
DEFAULT_METHOD = "PyMuPDF"
NO_METHOD = "none"

# --- fixed values: limits and rates ------------------------------------------
BYTES_PER_MB = 1024 * 1024
MAX_SIZE_MB = 10
MAX_PAGES = 3
MIN_PAGE_CHARS = 20
MIN_ALPHANUMERICS = 10
VAT_RATE = "0.18"
TOLERANCE = "0.01"
USD_PER_1000_TOKENS = 0.00015
REPLY_MAX_TOKENS = 1500
TEMPERATURE = 0.1
TOP_P = 0.9
PROMPT_PREVIEW_CHARS = 500
REPLY_PREVIEW_CHARS = 300
PDF_MAGIC_HEX = "25504446"

# --- fixed values: upload verdicts (code, text) -------------------------------
NO_NAME = (400, "El archivo debe tener un nombre")
NOT_PDF_NAME = (400, "El archivo debe ser un PDF")
NOT_PDF_TYPE = (400, "Solo se permiten archivos PDF")
TOO_LARGE_CODE = 413
TOO_LARGE_TEXT = ("Archivo demasiado grande: ", "MB. Máximo permitido: ", "MB")
NOT_PDF_CONTENT = (400, "El archivo no es un PDF válido")

# --- fixed values: integrity verdicts ----------------------------------------
CORRUPT_FILE = "Archivo PDF corrupto o inválido"
EMPTY_FILE = "Archivo PDF vacío"
PASSWORD_FILE = "PDF protegido con contraseña no soportado"
ZERO_PAGES = "PDF no contiene páginas válidas"
UNREADABLE_PAGE = "PDF corrupto: no se puede acceder a las páginas"
OTHER_OPEN_ERROR = "Error inesperado analizando PDF: "
FILE_MISSING = "Archivo no encontrado: "
OVERSIZE_TEXT = ("Archivo excede tamaño máximo (", "MB > ", "MB)")
VALIDATED_TEXT = ("Documento validado: ", " páginas, ", "MB, método: ")
PASSED = "PASSED"
NATIVE_TEXT = "native_text"
NO_TEXT_FOUND = "PDF no contiene texto extraíble (posiblemente escaneado)"

# --- fixed values: processing messages ---------------------------------------
NO_ASSEMBLED_TEXT = "El documento no contiene texto extraíble"
UNKNOWN_METHOD = "Método de extracción inválido: "
NOTHING_TO_CLEAN = "No hay texto para limpiar"
NO_PROMPT_TEXT = "No hay texto limpio disponible en el estado"
BAD_REPLY = "Respuesta de OpenAI no es un objeto JSON válido"
REPLY_STEP_ERROR = "Error en extracción LLM: "
EXTRACTED_TEXT = ("Texto extraído: ", " caracteres de ", " páginas")
CLEANED_TEXT = ("Texto limpiado: -", " caracteres (", "%)")
EXTRACTED_FIELDS = ("Extracción completada: ", " campos extraídos")
UNKNOWN_ERROR = "Unknown error"
PAGE_HEADER = ("\n--- PÁGINA ", " ---\n", "\n")

# --- fixed values: report labels and formats ---------------------------------
NOT_AVAILABLE = "N/A"
SECTION_DOCUMENT = "FACTURA - DATOS EXTRAÍDOS"
SECTION_CLIENT = "DATOS DEL CLIENTE"
SECTION_ITEMS = "DETALLE DE ITEMS"
SECTION_TOTALS = "TOTALES"
SECTION_DEDUCTION = "DETRACCIÓN"
SECTION_PAYMENT = "INFORMACIÓN ADICIONAL"
LABEL_FILE = "Archivo origen:"
LABEL_GENERATED = "Fecha de generación:"
LABEL_CLIENT_CODE = "Código Cliente:"
LABEL_NAME = "Razón Social:"
LABEL_ADDRESS = "Dirección:"
LABEL_DISTRICT = "Distrito:"
LABEL_DESCRIPTION = "Descripción"
LABEL_QUANTITY = "Cantidad"
LABEL_PRICE = "Precio Unitario"
LABEL_ITEM_SUBTOTAL = "Subtotal"
LABEL_NO_ITEMS = "Sin items registrados"
LABEL_SUBTOTAL = "Subtotal:"
LABEL_VAT = "IGV (18%):"
LABEL_TOTAL = "TOTAL:"
LABEL_PERCENT = "Porcentaje:"
LABEL_DEDUCTION = "Monto Detracción:"
LABEL_PAYMENT = "Forma de Pago:"
LABEL_CURRENCY = "Moneda:"
REPORT_TIME_FORMAT = "dd/MM/yyyy HH:mm:ss"
EXPORT_TIME_FORMAT = "yyyyMMdd_HHmmss"
EXPORT_PREFIX = "factura_"
EXPORT_SUFFIX = ".xlsx"
LOG_TIME_FORMAT = "HH:mm:ss"
ISO_TIME_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
INVOICE_CODE_PREFIX = "FACT-"

# --- fixed values: whitespace ------------------------------------------------
# Every character that counts as white space in Unicode text, plus the four
# information separators and NEL.
WHITESPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
WHITESPACE_RUN = r"[\s\x1c-\x1f\x85\p{Z}]+"

# --- fixed values: prompt texts ----------------------------------------------
SYSTEM_PROMPT = """Eres un experto contador que se especializa en extraer datos de facturas peruanas.
Tu tarea es analizar el texto de facturas y extraer datos específicos en formato JSON válido.
Responde ÚNICAMENTE con JSON, sin markdown, sin explicaciones adicionales."""

PROMPT_PLACEHOLDER = "{cleaned_text}"

USER_PROMPT = """Analiza el siguiente texto de factura peruana y extrae los datos en formato JSON.

REGLAS ESTRICTAS:
1. Extrae SOLO información explícitamente presente en el texto.
2. NO inventes, infieras ni reformatees datos.
3. Si un campo no existe: usa null.
4. Si hay ambigüedad: usa el valor más específico y exacto.
5. Todos los montos deben tener hasta 2 decimales (ej: 1500.00).
6. Todos los strings deben conservar el texto tal cual aparece, excepto donde se indique lo contrario.
7. NO incluyas ningún comentario ni texto adicional: responde ÚNICAMENTE con JSON válido.

ESTRUCTURA DEL JSON A RETORNAR:

- codigo_cliente: RUC (11 dígitos) o DNI (8 dígitos) del CLIENTE. String o null.
- razon_social_cliente: Nombre o razón social EXACTO del cliente, según figura en la factura. String o null.
- direccion_cliente: Dirección completa del cliente (SIN distrito ni departamento). MAYÚSCULAS, sin comas ni paréntesis. String o null.
- distrito: Distrito peruano del cliente en MAYÚSCULAS. String o null.
- items: Array de objetos con cada producto o servicio. Cada objeto debe tener:
  - descripcion: String
  - cantidad: Number
  - precio_unitario: Number
  - subtotal: Number
- forma_pago: Condición de pago (CONTADO/CREDITO/TARJETA/EFECTIVO/TRANSFERENCIA/YAPE/PLIN). String o null.
- moneda: Código ISO (PEN para soles, USD para dólares). String o null.
- subtotal: Subtotal antes de impuestos. Number o null.
- igv: Monto de IGV (18%). Number o null.
- total: Importe total a pagar. Number o null.
- detraccion: Objeto con los campos:
  - porcentaje: Number
  - monto: Number
  Solo si la detracción está explícitamente indicada. En caso contrario: null.

FORMATO DE EJEMPLO:
{
  "codigo_cliente": "20123456789",
  "razon_social_cliente": "EMPRESA COMERCIAL SAC",
  "direccion_cliente": "AV LOS CONQUISTADORES 456",
  "distrito": "SAN ISIDRO",
  "items": [
    {
      "descripcion": "SERVICIO DE CONSULTORIA",
      "cantidad": 1.00,
      "precio_unitario": 1500.00,
      "subtotal": 1500.00
    }
  ],
  "forma_pago": "CREDITO",
  "moneda": "PEN",
  "subtotal": 1500.00,
  "igv": 270.00,
  "total": 1770.00,
  "detraccion": {
    "porcentaje": 12.00,
    "monto": 177.00
  }
}

TEXTO DE LA FACTURA:
---
{cleaned_text}
---

Responde únicamente con el JSON:
"""

# US dollars for 1,000 tokens of input and of output, by model.
MODEL_PRICES = {
    "gpt-4o": (0.0025, 0.01),
    "gpt-4o-mini": (0.00015, 0.0006),
    "gpt-3.5-turbo": (0.001, 0.002),
}

# Part of the contract fields that makes an invoice complete.
COMPLETENESS = 0.8

# Tokens of a chunk, and tokens that a chunk shares with the one before.
CHUNK_TOKENS, CHUNK_OVERLAP = 2500, 250

# Tokens of all pages of a document, and of its zones of high, middle and low priority.
TOTAL_TOKENS = 5000
ZONE_TOKENS = (1500, 2500, 3000)

# Confidence that a field or document must reach.
CONFIDENCE = 0.7
