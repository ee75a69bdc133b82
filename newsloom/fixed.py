"""Fixed values.

Everything in this module is a constant that must stay exactly as written for
results to match: topic keywords, stop words, thresholds, portal settings,
messages and prompt texts.  They are defaults only; every operator takes its
own rules, words and thresholds as parameters.
"""

from __future__ import annotations

# --- topic rules: (topic, keywords), tried in this order; first match wins ----
TOPIC_RULES = [
    ("🚧 Bloqueos y rutas", [
        "bloqueo", "bloqueos", "desbloqueo", "ruta", "carretera", "transitabilidad",
        "sindicato", "marcha", "protesta", "corte", "paro", "cierre vía",
    ]),
    ("🏛️ Política", [
        "gobierno", "presidente", "ministro", "diputado", "asamblea", "elecciones",
        "parlamento", "senado", "decreto", "ley", "partido", "candidato", "arce", "morales",
    ]),
    ("💰 Economía", [
        "economía", "dólar", "combustible", "ypfb", "precio", "exportación", "importación",
        "gestora", "banco", "deuda", "inflación", "presupuesto", "empresa", "inversión",
    ]),
    ("⚖️ Seguridad", [
        "policía", "aprehendido", "detenido", "delito", "atraco", "violencia",
        "crimen", "narcotráfico", "droga", "homicidio", "fiscal", "tribunal",
    ]),
    ("🏥 Salud", [
        "salud", "hospital", "paciente", "médico", "enfermedad", "vacuna",
        "epidemia", "dengue", "tratamiento", "sanitario",
    ]),
    ("📚 Educación", [
        "educación", "maestro", "universidad", "colegio", "estudiantes",
        "clases", "bachiller", "magisterio", "huelga docente",
    ]),
    ("⚽ Deportes", [
        "fútbol", "bolívar", "oriente", "blooming", "deporte", "copa",
        "liga", "gol", "torneo", "selección", "atleta",
    ]),
]
TOPIC_DEFAULT = "📰 General"

# --- stop words of the lexical index -----------------------------------------
STOP_WORDS = [
    "de", "la", "el", "en", "y", "a", "los", "del", "se", "las", "un", "por", "con", "una",
    "su", "para", "es", "al", "lo", "como", "más", "pero", "sus", "le", "ya", "o", "fue",
    "este", "ha", "si", "porque", "esta", "son", "entre", "cuando", "muy", "sin", "sobre",
    "también", "me", "hasta", "hay", "donde", "quien", "desde", "todo", "nos", "durante",
    "todos", "uno", "les", "ni", "contra", "otros", "ese", "eso", "ante", "ellos", "e",
    "esto", "antes", "algunos", "qué", "unos", "otro", "otras", "otra", "él", "tanto",
    "esa", "estos", "mucho", "cual", "poco", "ella", "estar", "estas", "algunas", "algo",
    "nosotros", "mi", "mis", "tú", "te", "ti", "tu", "tus", "que", "no", "ser", "hacer",
    "tener", "haber", "poder", "ir", "ver", "han", "sido", "hizo", "era", "eran", "tiene",
    "tienen", "le", "les", "les", "nos", "os", "me", "te", "se", "si", "ya", "aun", "bien",
    "cada", "cual", "cuyo", "desde", "donde", "ello", "entre", "esta", "este", "esos",
    "esas", "aquí", "allí", "allá", "ahora", "luego", "pues", "así", "ante", "bajo",
    "cabe", "con", "contra", "de", "desde", "en", "entre", "hacia", "hasta", "para",
    "por", "según", "sin", "so", "sobre", "tras", "versus", "vía",
]

# --- lexical retrieval ---------------------------------------------------------
MAX_FEATURES = 8000
RELEVANCE_THRESHOLD = 0.08
HIGH_SIMILARITY = 0.25
TITLE_WEIGHT = 2
LEXICAL_TOP_K = 5
MSG_EMPTY_CORPUS = "⚠️ No hay noticias en la base de datos. Ejecuta el scraping primero."
MSG_BLANK_QUERY = "Escribe una pregunta o tema para buscar."
MSG_WEAK = (
    "No encontré coincidencias fuertes con tu consulta, "
    "pero estas son las noticias más cercanas en el corpus."
)
MSG_RELATED = "Encontré noticias relacionadas con tu consulta."
MSG_RELEVANT = "Encontré {n} noticias relevantes."

# --- dense retrieval -------------------------------------------------------------
DENSE_TOP_K = 2
CONTEXT_CHARS = 400
CONTEXT_SEPARATOR = "\n\n---\n\n"
DOC_KEY_PREFIX = "noticia_"
DOC_TITLE_LABEL = "TÍTULO: "
DOC_BODY_LABEL = "\n\nCONTENIDO: "

# --- dashboard ---------------------------------------------------------------------
FEED_LIMIT = 50
RECENT_LIMIT = 50
KEYWORD_LIMIT = 10
DEFAULT_WINDOW_DAYS = 7
NO_DATE = "Sin fecha"
NO_LATEST = "N/D"
ALL_SOURCES = "Todas"
ALL_TOPICS = "Todos"
MISSING_DEFAULTS = {"titulo": "Sin título", "texto": "", "fuente": "Desconocido", "url": "#"}

# --- page gate ---------------------------------------------------------------------
BLOCKED_STATUS = [403, 429]
BLOCKED_PHRASES = ["captcha", "access denied"]
HTML_HEAD_CHARS = 500

# --- portals: source name, front page, origin, host test, link rule, parser ---------
PORTALS = [
    {
        "fuente": "Los Tiempos",
        "portada": "https://www.lostiempos.com/actualidad",
        "dominio": "https://www.lostiempos.com",
        "sitio": "lostiempos.com",
        "min_segments": 3,
        "sections": ["actualidad", "hoy", "cochabamba", "pais"],
        "excluded": ["#", "javascript", "mailto", "/rss", "/servicios"],
        "strip_href": False,
        "parser": "page_header",
    },
    {
        "fuente": "EL DEBER",
        "portada": "https://eldeber.com.bo/",
        "dominio": "https://eldeber.com.bo",
        "sitio": "eldeber.com.bo",
        "min_segments": 2,
        "sections": [],
        "excluded": ["#", "javascript", "mailto"],
        "strip_href": True,
        "parser": "article_tag",
    },
]
MAX_LINKS_PER_PAGE = 40

# --- article parsers -------------------------------------------------------------
HEADER_CLASS = "page-header"
BODY_CLASS = "field-name-body"
TITLE_META = "og:title"
DATE_META = "article:published_time"
MIN_BODY_PAGE_HEADER = 100
MIN_PARAGRAPH_ARTICLE_TAG = 40  # longer than this
MIN_BODY_ARTICLE_TAG = 200

# --- prompt texts; {contexto} and {pregunta} are filled per query ---------------
PROMPT_RUTA = """Eres un asistente experto en transitabilidad y bloqueos de carreteras en Bolivia.
Tu función es responder preguntas sobre el estado de las rutas y bloqueos ÚNICAMENTE basándote
en las noticias proporcionadas como contexto. NO inventes información.

Si las noticias no mencionan la ruta o ciudad consultada, di claramente:
"No encontré información específica sobre esa ruta en las noticias recientes."

CONTEXTO (noticias recientes):
{contexto}

PREGUNTA DEL USUARIO:
{pregunta}

Responde de forma clara y concisa. Menciona las fuentes (nombre del medio) al final.
Si hay bloqueos, especifica dónde y desde cuándo si la información está disponible.
Responde SIEMPRE en español."""
RUTA_NO_CONTEXT = "No hay noticias indexadas. Ejecuta el scraper y luego indexar_noticias()."

PROMPT_FACT_CHECK = """Eres un verificador de hechos (fact-checker) especializado en noticias de Bolivia.
Tu tarea es analizar si el texto proporcionado por el usuario coincide, contradice o no puede
verificarse con las noticias indexadas en nuestra base de datos.

INSTRUCCIONES:
1. Compara el texto del usuario con el contexto de noticias.
2. Emite un veredicto claro: VERIFICADO / CONTRADICE LO REPORTADO / NO VERIFICABLE.
3. Explica brevemente por qué, citando las fuentes disponibles.
4. Si el contexto no es suficiente, dilo explícitamente.
5. NO asumas que algo es falso solo porque no está en las noticias.

CONTEXTO (noticias de Los Tiempos y Red Uno):
{contexto}

TEXTO A VERIFICAR:
"{pregunta}"

Formato de respuesta:
🔍 VEREDICTO: [VERIFICADO / CONTRADICE LO REPORTADO / NO VERIFICABLE]
📋 ANÁLISIS: [Explicación detallada]
📰 FUENTES CONSULTADAS: [Lista de medios/titulares relevantes]

Responde SIEMPRE en español."""
FACT_CHECK_NO_CONTEXT = "No se encontraron noticias relacionadas en la base de datos."

PROMPT_GENERAL = """Eres un asistente informativo sobre Bolivia. Responde la pregunta
del usuario ÚNICAMENTE basándote en las noticias del contexto. Si no tienes información
suficiente, dilo claramente. No inventes datos.

CONTEXTO:
{contexto}

PREGUNTA: {pregunta}

Responde en español de forma clara y cita las fuentes."""
GENERAL_NO_CONTEXT = "Sin noticias relacionadas."
