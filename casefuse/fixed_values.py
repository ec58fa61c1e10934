"""Fixed values. Everything here must equal the published rules for results to be right."""

# --- Form catalogue: (key, label, section, rule family). Keys are exact; double spaces count.
# --- The dates stand outside the sections.
FIELD_CATALOG = [
    ("Nombre  Razón Social", "Razón social", "Empresa / Identificación", "text"),
    ("Nombre Comercial", "Nombre comercial", "Empresa / Identificación", "text"),
    ("NIE", "CIF/NIF/NIE de la empresa", "Empresa / Identificación", "holder_id"),
    ("Nombre representante", "Nombre del representante", "Empresa / Identificación", "person"),
    ("NIF representante", "NIF del representante", "Empresa / Identificación", "rep_id"),
    ("Dirección", "Dirección (fiscal)", "Dirección fiscal", "text"),
    ("CP", "Código postal", "Dirección fiscal", "postcode"),
    ("Población", "Población", "Dirección fiscal", "text"),
    ("Provincia", "Provincia", "Dirección fiscal", "text"),
    ("Dirección_2", "Dirección comercio/PdV", "Dirección comercio / PdV", "text"),
    ("CP_2", "CP comercio", "Dirección comercio / PdV", "postcode"),
    ("Población_2", "Población comercio", "Dirección comercio / PdV", "text"),
    ("Provincia_2", "Provincia comercio", "Dirección comercio / PdV", "text"),
    ("Teléfono", "Teléfono", "Contacto", "phone"),
    ("Email Comercial", "Email comercial", "Contacto", "email"),
    ("Email  Facturación", "Email facturación", "Contacto", "email"),
    ("Datos bancarios del DISTRIBUIDOR", "IBAN", "Datos bancarios", "iban"),
    ("Actividad principal del negocio", "Actividad principal (IAE)", "Empresa / Identificación", "text"),
    ("Fecha", "Fecha · día", None, "day"),
    ("de", "Fecha · mes", None, "text"),
    ("año", "Fecha · año", None, "text"),
]
DATE_FIELDS = ["Fecha", "de", "año"]
ADDRESS_FIELDS = ["Dirección", "CP", "Población", "Provincia"]
SECOND_BLOCK_SUFFIX = "_2"
MONTH_NAMES = [
    "enero", "febrero", "marzo", "abril", "mayo", "junio",
    "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre",
]

# --- Identification check boxes: type -> the form's own box name ------------------------------
CHECKBOXES = {"CIF": "CIF", "NIF": "NIF", "NIE": "undefined"}
CHECKBOX_ON = "/On"
CHECKBOX_OFF = "/Off"

# --- Source engines: (id, display name, runs inside the EU) -----------------------------------
ENGINES = [
    ("claude", "Claude", False),
    ("gemini", "Gemini", False),
    ("groq", "Groq", False),
    ("grok", "Grok", False),
    ("mistral", "Mistral", True),
    ("scaleway", "Scaleway", True),
    ("ovh", "OVHcloud", True),
    ("nebius", "Nebius", True),
    ("eurouter", "EUrouter", True),
]
CALL_PRIORITY = ["groq", "mistral", "claude", "gemini", "scaleway", "eurouter"]
BOX_PRIORITY = ["mistral", "scaleway", "claude", "gemini", "grok"]
SUGGESTION_ONLY_ENGINES = ["groq"]
SINGLE_PAGE_ENGINES = ["groq"]
PERMANENT_FAILURE_CODES = [401, 403, 404]
MAX_PAGES_PER_CALL = 20

# --- Document type rules, first match wins, over folded text ----------------------------------
DEFAULT_DOC_TYPE = "Documento"
DOC_TYPE_RULES = [
    ("Certificado de situación censal",
     r"certificado de situacion censal|situacion en el censo de actividades"),
    ("Modelo 036", r"modelo 036|modelo 037|declaracion censal de alta"),
    ("Tarjeta CIF/NIF", r"tarjeta de identificacion fiscal|comunicacion de tarjeta acreditativa"),
    ("Alta en RETA", r"regimen especial de trabajo autonomo"),
    ("Contrato de alquiler", r"contrato de arrendamiento|arrendamiento para uso distinto"),
    ("Escritura de constitución",
     r"escritura de constitucion|numero de protocolo|otorgo ante mi"),
    ("Certificado bancario",
     r"solicitud de datos codigo cuenta|codigo cuenta \(iban\)|\bes titularidad\b"
     r"|bic ?[/(]? ?(codigo )?swift"),
    ("NIE / Permiso de residencia",
     r"permiso de residencia|titre de sejour|tarjeta de identidad de extranjero"),
    ("DNI", r"documento nacional de identidad"),
    ("Pasaporte", r"\bpasaporte\b|\bpassport\b"),
]
STRONG_IDENTITY_TYPES = [
    "Tarjeta CIF/NIF", "Certificado de situación censal", "Modelo 036", "DNI",
    "NIE / Permiso de residencia", "Pasaporte", "Escritura de constitución",
]

# --- Failure causes, first match wins, over the lower-cased message ----------------------------
DEFAULT_CAUSE = ("OTHER", "error", "Si se repite, prueba a analizar con otro motor.")
FAILURE_RULES = [
    ("QUOTA", "límite o cuota alcanzada",
     "Vuelve a intentarlo en unos minutos o usa otro motor.",
     r"quota|rate.?limit|429|resource has been exhausted|exhausted"),
    ("AUTH", "clave no válida o sin permiso",
     "Revisa la clave de ese motor en la configuración del proxy.",
     r"\b401\b|\b403\b|unauthor|api key|invalid.*key|permission|credential"),
    ("TOO_LARGE", "documento demasiado grande",
     "Ese motor no admite un documento de ese tamaño; los demás sí lo han analizado.",
     r"\b413\b|too large|payload|entity too large"),
    ("NETWORK", "problema de red",
     "Comprueba la conexión. Si estás en WiFi, prueba con datos móviles.",
     r"timeout|timed out|network|unable to resolve|failed to connect|econn|unknownhost"),
    ("PARSE", "respuesta incompleta",
     "El motor cortó la respuesta. Suele arreglarse repitiendo el análisis.",
     r"json|parse|syntax|incompleta|truncat|unexpected end"),
    ("UNAVAILABLE", "servicio no disponible",
     "Es un fallo temporal del proveedor, no de la app.",
     r"\b50[0234]\b|unavailable|overload|internal error"),
]

# --- Field -> document types whose value usually belongs to a third party ----------------------
RISKY_SOURCES = {
    "Datos bancarios del DISTRIBUIDOR": ["Contrato de alquiler", "Factura"],
    "Email Comercial": ["Contrato de alquiler", "Alta en RETA"],
    "Email  Facturación": ["Contrato de alquiler", "Alta en RETA"],
    "Teléfono": ["Contrato de alquiler"],
    "Nombre representante": ["Modelo 036"],
    "NIF representante": ["Modelo 036"],
}
UNKNOWN_DOCUMENT = "documento analizado"
INTRUDER_NOTE = "este documento parece de otro titular (%s)"
NOTE_SEPARATOR = " · "

# --- Identifier checks -------------------------------------------------------------------------
DNI_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"
CIF_CONTROL_LETTERS = "JABCDEFGHI"
CIF_LETTER_TYPES = "NPQRSW"
CIF_DIGIT_TYPES = "ABEH"
DNI_SHAPE = r"^\d{8}[A-Z]$"
NIE_SHAPE = r"^[XYZ]\d{7}[A-Z]$"
CIF_SHAPE = r"^[ABCDEFGHJNPQRSUVW]\d{7}[0-9A-J]$"
IBAN_SHAPE = r"^[A-Z]{2}\d{2}[A-Z0-9]{10,30}$"
PHONE_SHAPE = r"^[6789]\d{8}$"
EMAIL_SHAPE = r"^[^\s@]+@[^\s@]+\.[^\s@]{2,}$"
PROVINCES = {
    "01": "alava araba", "02": "albacete", "03": "alicante alacant", "04": "almeria",
    "05": "avila", "06": "badajoz", "07": "baleares balears illes", "08": "barcelona",
    "09": "burgos", "10": "caceres", "11": "cadiz", "12": "castellon castello",
    "13": "ciudad real", "14": "cordoba", "15": "coruna", "16": "cuenca",
    "17": "girona gerona", "18": "granada", "19": "guadalajara", "20": "gipuzkoa guipuzcoa",
    "21": "huelva", "22": "huesca", "23": "jaen", "24": "leon", "25": "lleida lerida",
    "26": "rioja", "27": "lugo", "28": "madrid", "29": "malaga", "30": "murcia",
    "31": "navarra", "32": "ourense orense", "33": "asturias oviedo", "34": "palencia",
    "35": "palmas", "36": "pontevedra", "37": "salamanca", "38": "tenerife",
    "39": "cantabria santander", "40": "segovia", "41": "sevilla", "42": "soria",
    "43": "tarragona", "44": "teruel", "45": "toledo", "46": "valencia", "47": "valladolid",
    "48": "bizkaia vizcaya", "49": "zamora", "50": "zaragoza", "51": "ceuta", "52": "melilla",
}
MESSAGES = {
    "cif": "CIF no válido (dígito de control)",
    "nif": "NIF/DNI no válido (letra de control)",
    "nie": "NIE no válido (letra de control)",
    "any_id": "Documento no válido (CIF/NIF/NIE)",
    "rep_id": "NIF del representante no válido",
    "iban": "IBAN no válido (mod-97)",
    "phone": "Teléfono: 9 dígitos (6/7/8/9)",
    "email": "Email no válido",
    "day": "Día entre 1 y 31",
    "postcode_shape": "El C.P. debe tener 5 dígitos",
    "postcode_prefix": "Prefijo de C.P. inexistente (%s)",
    "postcode_province": "El C.P. %s es de %s y la provincia es «%s»",
}

# --- Documents ---------------------------------------------------------------------------------
MIME_BY_EXTENSION = {
    "pdf": "application/pdf", "jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png",
    "webp": "image/webp", "gif": "image/gif", "heic": "image/heic", "heif": "image/heic",
    "bmp": "image/bmp", "txt": "text/plain", "html": "text/html", "csv": "text/csv",
}
DEFAULT_MIME = "application/octet-stream"
DEFAULT_NAME = "documento"
BATCH_LABEL = "%s (parte %d/%d)"
NO_DOCUMENTS_ERROR = "No se pudieron leer los documentos."
EMPTY_REPLY = "(vacío)"
UNPARSEABLE_STATUS = 'respuesta no parseable — "%s"'

# --- Layout ------------------------------------------------------------------------------------
ANCHOR_WORD = "DISTRIBUIDOR"
ANCHOR_EXCLUDED = "DISTRIBUIDORES"
FORCED_PAGE = 23
# page -> (x centre, y centre, width, height), relative to the page
CALIBRATED_PLACEMENTS = {
    23: (0.275, 0.463, 0.256, 0.114),
    29: (0.722, 0.261, 0.256, 0.114),
    32: (0.220, 0.940, 0.256, 0.114),
    44: (0.222, 0.853, 0.256, 0.114),
    53: (0.183, 0.886, 0.256, 0.114),
}
DEFAULT_PLACEMENT = {"x": 0.30, "y": 0.82, "below_anchor": 0.06, "lowest": 0.95,
                     "w": 0.28, "h": 0.114}
MOVED_PLACEMENT_SIZE = (0.256, 0.114)

# --- Edit log and sessions ---------------------------------------------------------------------
UNDO_DEPTH = 20
SESSION_SCHEMA_VERSION = 1
STEP_MIGRATION = {0: 0, 1: 1, 2: 2, 3: 2, 4: 3}
