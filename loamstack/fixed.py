"""Names, word lists, patterns and formats that results depend on.

They are the data of the catalogue and web corpus this engine serves, stated as they are; no logic lives here. Patterns are plain
regular expressions that Java's and Python's engines read alike; flags are added where they are used.
"""

from __future__ import annotations

# --- fixed values: URLs -------------------------------------------------------------------------------------------------

PDF_EXTENSION = ".pdf"
NON_HTML_EXTENSIONS = (
    # office files
    ".doc", ".docx", ".xls", ".xlsx", ".xlsm", ".ppt", ".pptx", ".rtf", ".odt", ".csv",
    # archives and binaries
    ".zip", ".rar", ".7z", ".gz", ".tar", ".exe", ".msi", ".apk", ".dmg",
    # pictures, sound, video
    ".jpg", ".jpeg", ".png", ".gif", ".bmp", ".svg", ".webp", ".ico", ".tif", ".tiff",
    ".mp3", ".mp4", ".avi", ".mov", ".wmv", ".mkv", ".webm", ".flv",
    # resources and data
    ".css", ".js", ".json", ".xml", ".txt", ".rss",
)
TRACKING_PARAMS = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid", "msclkid", "mc_cid", "mc_eid", "_ga")
LOGIN_MARKERS = ("/login", "/signin", "/user/login", "/user/password", "iniciar-sesion")

# --- fixed values: pages ------------------------------------------------------------------------------------------------

DROPPED_TAGS = ("script", "style", "noscript", "template", "svg", "form", "input", "select", "textarea", "nav", "header", "footer", "aside")
DROPPED_ROLES = ("navigation", "banner", "contentinfo", "search", "dialog")
#: Classes and ids that are noise as a whole, and parts of them that are noise anywhere.
NOISE_NAMES = ("header", "footer", "search", "tabs", "aside", "menu", "nav")
NOISE_PARTS = (
    "navbar", "navigation", "megamenu", "main-menu", "block-menu", "menu-item", "menu-principal",
    "breadcrumb", "migas", "site-header", "page-header", "region-header", "global-header",
    "site-footer", "page-footer", "region-footer", "global-footer",
    "banner", "carousel", "slider", "modal", "popup", "overlay", "cookie", "consent",
    "social", "compartir", "redes-sociales", "sidebar", "related", "relacionad",
    "popular", "mas-visitado", "mas-populares", "destacado", "toolbar", "pager", "pagination",
    "skip-link", "back-to-top", "volver-arriba", "buscador", "search-form", "searchform",
    "login", "feedback", "encuesta", "calificanos",
)
PROTECTED_TAGS = ("html", "body", "main", "article")
HEADING_TAGS = ("h1", "h2", "h3", "h4", "h5", "h6")
BLOCK_TAGS = ("h1", "h2", "h3", "h4", "h5", "h6", "p", "ul", "ol", "dl", "table", "blockquote", "pre")
MEDIA_TAGS = ("img", "figure", "picture", "video", "audio", "iframe", "canvas", "object", "embed", "map")
QUESTION_TAGS = ("h2", "h3", "h4", "h5", "h6", "summary", "button", "a", "span", "strong")
FOLDING_CLASS = r"accordion|acordeon|collaps|panel|faq|pregunta|toggle"
EMBEDDED_TAGS = ("iframe", "object", "embed", "canvas")
#: Where the main content is looked for, in this order: tag, or attribute and value.
MAIN_PLACES = (
    ("tag", "main"),
    ("role", "main"),
    ("tag", "article"),
    ("id", "content"),
    ("id", "main-content"),
    ("class", "region-content"),
    ("class", "node__content"),
    ("class", "field--name-body"),
    ("id", "block-system-main"),
)
#: Where a page's trail is looked for, in this order, and the signs between its parts.
TRAIL_PLACES = (("class", "breadcrumb"), ("aria-label", "breadcrumb"), ("class", "migas"), ("id", "breadcrumb"))
TRAIL_SEPARATORS = (">", "/", "|", "»")
#: Attributes of the meta elements that tell when a page was changed, in this order.
DATE_SOURCES = (("property", "article:modified_time"), ("name", "last-modified"), ("itemprop", "dateModified"))
CAPTCHA_MARKERS = ("g-recaptcha", "h-captcha", "hcaptcha", "recaptcha", "captcha")
SERVER_ERROR_MARKERS = (
    "internal server error", "error 500", "503 service", "service unavailable",
    "servicio no disponible", "servicio temporalmente no disponible", "error del servidor",
)
PDF_LINK = r"\.pdf($|\?|#)"
PASSWORD_INPUT = r"""type\s*=\s*["']?password"""

# --- fixed values: chunks -----------------------------------------------------------------------------------------------

ATOMIC_PREFIXES = ("Pregunta:", "- ", "1. ")
SENTENCE_END = r"(?<=[.!?:])\s+"
STATEMENT_END = r"(?<=[.;!?])\s+(?=[A-ZÁÉÍÓÚÜÑ0-9])"
TOKEN = r"\w+|[^\w\s]"
#: Headings that carry no text of their own; matched without regard to case.
HEADING_ONLY = (
    r"^\s*REQUISITOS\s+GENERALES\s*:?\s*$",
    r"^\s*REQUISITOS\s+ESPEC[IÍ]FICOS\s*:?\s*$",
    r"^\s*DOCUMENTACI[OÓ]N\s*-\s*REQUISITOS\s+GENERALES\s*:?\s*$",
    r"^\s*DOCUMENTACI[OÓ]N\s*-\s*REQUISITOS\s+ESPEC[IÍ]FICOS\s*:?\s*$",
)

# --- fixed values: the catalogue ----------------------------------------------------------------------------------------

CATALOGUE_COLUMNS = (
    "codigo", "denominacion_y_base_legal", "requisitos", "formularios", "costo",
    "calificacion_automatica", "evaluacion_previa_positiva", "evaluacion_previa_negativa",
    "plazo", "inicio_procedimiento", "autoridad_competente", "reconsideracion", "reclamo", "apelacion",
)
#: Fields of a record, in the order they are shown, with their labels.
FIELD_LABELS = {
    "fundamento_legal": "Fundamento legal",
    "requisitos": "Requisitos",
    "formularios": "Formularios, códigos y ubicaciones",
    "costo": "Derecho de tramitación / costo",
    "calificacion": "Calificación",
    "plazo": "Plazo para resolver",
    "inicio_procedimiento": "Inicio del procedimiento / canal",
    "autoridad_competente": "Autoridad competente",
    "reconsideracion": "Reconsideración",
    "reclamo": "Reclamo",
    "apelacion": "Apelación",
    "denominacion_adicional": "Información adicional de la denominación",
}
MARK_LABELS = {
    "calificacion_automatica": "Automático",
    "evaluacion_previa_positiva": "Evaluación previa con silencio positivo",
    "evaluacion_previa_negativa": "Evaluación previa con silencio negativo",
}
#: Fields that are chunked each on its own, and short ones that share a chunk: type, label, fields.
LONG_FIELDS = ("fundamento_legal", "requisitos", "formularios")
GROUPED_FIELDS = (
    ("resumen_administrativo", "Costo, calificación y plazo", ("costo", "calificacion", "plazo")),
    ("canal_y_autoridad", "Canal de inicio y autoridad competente", ("inicio_procedimiento", "autoridad_competente")),
    ("recursos", "Recursos administrativos", ("reconsideracion", "reclamo", "apelacion")),
    ("informacion_adicional", "Información adicional", ("denominacion_adicional",)),
)
COLUMN_HEADERS = ("NUMERO DE ORDEN", "DENOMINACION DEL PROCEDIMIENTO", "DERECHO DE TRAMITACION", "AUTORIDAD COMPETENTE")
STATUS_NOTES = ("ELIMINADO MEDIANTE", "MODIFICADO MEDIANTE", "MODIFICADO A SERVICIO", "INCORPORADO MEDIANTE")
INLINE_NOTE = r"\s*\((ELIMINADO|MODIFICADO|INCORPORADO)\s+MEDIANTE.+$"
INACTIVE_MARKERS = ("ELIMINADO", "MODIFICADO A SERVICIO PRESTADO EN EXCLUSIVIDAD")
LEGAL_MARKER = r"FUNDAMENTOS?\s+LEGAL(?:ES)?\s*:?"
LAW_LINE = r"^(?:DECRETO|RESOLUCI[ÓO]N|LEY\b|DECISI[ÓO]N|CONVENIO|ACUERDO|REGLAMENTO)"
#: Section headings, as match keys: without accents, signs are single spaces.
KNOWN_HEADINGS = (
    "REQUISITOS GENERALES",
    "REQUISITOS ESPECIFICOS",
    "DOCUMENTACION REQUISITOS GENERALES",
    "DOCUMENTACION REQUISITOS ESPECIFICOS",
    "CONDICIONES PARA PRESENTAR",
    "CONDICIONES PARA OBTENER",
    "CONDICIONES PARA SER HABILITADO",
    "EN FORMA PRESENCIAL",
    "DE MANERA PRESENCIAL",
    "A TRAVES DEL CANAL TELEFONICO",
    "REQUISITOS",
    "NOTA",
    "NOTAS",
)
#: A dotted code, then its title; a plain code with an optional letter; a service.
SUB_LINE = r"^\s*0*(\d+(?:-[A-Z])?(?:\.\d+)+)\s*(?:[.\-–—:]+\s*)?(.*)$"
PLAIN_CODE = r"^0*(\d+)(?:\s*-\s*([A-Z]))?$"
SERVICE_CODE = r"^SERVICIO\s*0*(\d+)$"

# --- fixed values: numbers and privacy ----------------------------------------------------------------------------------

TAX_ID = r"^(?:10|15|16|17|20)\d{9}$"
#: Weights of the modulo-11 check digit, from the left.
TAX_ID_WEIGHTS = (5, 4, 3, 2, 7, 6, 5, 4, 3, 2)
#: Digits and signs that stand for letters.
DISGUISES = ("013457@$", "oieastas")
SOL_KEY = r"clave\s*sol|clavesol"
CREDENTIAL_WORDS = (
    r"clave\s*sol|clavesol|clave\s*de\s*acceso|mi\s*clave|contrasena|contrasenia|"
    r"password|passwd|pass|pin|codigo\s*de\s*verificacion|codigo\s*sms|otp|"
    r"token|usuario\s*y\s*clave|user\s*y\s*pass|credencial(?:es)?|"
    r"clave\s*(?:de\s*)?(?:mi\s*)?(?:cuenta|banco|tarjeta|celular)"
)
CREDENTIAL_TIGHT = r"clavesol|contrasena|contrasenia|password|passwd|codigodeverificacion|claveseacceso"
USER_WITH_VALUE = r"(?:usuario|user|login|nick|cuenta)\s*(?:sol)?\s*(?:es|:|=)\s*[\"'`]?([A-Za-z0-9._\-]{3,})"
SENSITIVE = (
    r"\b(?:mi|mis)\s+(?:diagnostico|enfermedad|historia\s*clinica|vih|sida|"
    r"cancer|discapacidad|religion|orientacion\s*sexual|afiliacion\s*(?:politica|sindical)|"
    r"huella\s*(?:digital|dactilar)|datos\s*biometricos)\b"
)
IDENTITY_NUMBER = r"(?<!\d)\d{8}(?!\d)"
CARD_NUMBER = r"(?<!\d)(?:\d[ \-]?){13,19}(?!\d)"
ACCOUNT_NUMBER = r"(?<!\d)\d{20}(?!\d)"
EMAIL = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"
MOBILE_NUMBER = r"(?<![\d+])(?:\+?51[\s\-]?)?9\d{2}[\s\-]?\d{3}[\s\-]?\d{3}(?!\d)"
