"""What a document is: its type, its language, its domain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import normalize, slug

#: Words that speak for a type of material, and for a topic; accent-free and in lower case.
TYPES = {
    "CLINICAL": """paciente pacientes diagnostico diagnostica sintomas sintoma tratamiento anamnesis exploracion
        antecedentes alergias medicacion dosis mg posologia receta-medica evolucion pronostico
        consulta ingreso alta clinica historia-clinica tension arterial glucemia analitica
        patient diagnosis symptoms treatment prescription dosage clinical medical chart vitals
        allergies comorbidity follow-up prognosis referral triage admission discharge""",
    "PROCESS": """ingredientes ingrediente receta pasos paso preparacion mezclar cocinar hornear anadir batir
        reposar servir raciones coccion utensilios materiales procedimiento protocolo instrucciones
        ingredients recipe steps step preparation mix cook bake stir whisk simmer serve servings
        procedure protocol instructions checklist runbook requirements assemble install configure""",
    "PERSONAL": """hoy ayer manana diario entrada sesion recordar recuerdo me-siento cansado contento familia
        amigos vacaciones cumpleanos casa mudanza trabajo jefe novia novio quede quedamos
        today yesterday tomorrow diary journal entry felt remember reminder weekend holiday
        birthday family friends moved apartment girlfriend boyfriend chatted call meetup""",
    "NARRATIVE": """capitulo escena personaje protagonista relato novela cuento historia habia-una-vez susurro
        miro dijo penso caminaba noche silencio ciudad puerta ventana lluvia
        chapter scene character protagonist novel tale story whispered glanced murmured dusk
        shadows corridor stranger horizon silence""",
}
TOPICS = {
    "medicine": "paciente diagnostico tratamiento clinica sintomas medico hospital patient diagnosis clinical medication doctor nurse hospital",
    "cooking": "receta ingredientes cocinar horno sarten sabor plato cocina recipe ingredients cook oven pan flavour dish kitchen bake",
    "education": "alumno alumnos leccion tema examen apuntes curso profesor aprendizaje ejercicio student lesson exam notes course teacher learning exercise syllabus",
    "literature": "novela capitulo personaje narrador poema verso prosa relato chapter character narrator poem verse prose fiction",
    "finance": "factura presupuesto ingresos gastos impuestos nomina inversion invoice budget income expenses taxes payroll investment",
    "travel": "viaje vuelo hotel maleta playa vacaciones itinerario trip flight hotel luggage beach holiday itinerary",
    "software": """api endpoint servidor despliegue repositorio funcion clase bug refactor deploy server
        repository function class database git github gitlab commit commits branch rama merge
        release version build compilar compila compile binario binary script tests test ci
        pipeline docker contenedor container mcp python swift java javascript typescript kotlin
        rust xcode macos ios linux terminal cli shell zsh bash npm pip venv sdk framework config
        configuracion json yaml sql postgres postgresql sqlite frontend backend app aplicacion
        codigo code fichero archivo directorio directory instalar install plugin shader appkit
        swiftui cpu gpu localhost puerto port token tokens prompt agente agent pr issue""",
}
#: Signs of source code and their weights; then other signs in a text.
CODE_SIGNS = (
    (r"(?md)^[\s]*(?:public|private|protected)[\s]+.*\{", 3.0),
    (r"(?md)^[\s]*(?:def|class)[\s]+[\p{L}\p{N}_]+.*:", 3.0),
    (r"(?md)^[\s]*(?:import|from|#include|package|using)[\s]+[\p{L}\p{N}_.<\"/]+", 2.0),
    (r"(?md)^[\s]*(?:function|const|let|var)[\s]+[\p{L}\p{N}_]+[\s]*[=(]", 2.0),
    (r"(?md)[;{}][\s]*$", 0.4),
    (r"(?U)\breturn\b|\bif\s*\(|\bfor\s*\(|=>", 0.5),
)
DIALOGUE = r"(?md)^\s*(?:[—–\"“«]|-(?=\S))"
CHAT = r"(?mdU)^\s*(?:\[\d{1,2}:\d{2}\]\s*)?[A-ZÀ-Ü][\wÀ-ÿ ]{1,20}:\s"
DATED = r"(?md)^\s*#{0,4}\s*\[?\d{4}-\d{1,2}-\d{1,2}|^\s*\d{1,2}[/.\-]\d{1,2}[/.\-]\d{2,4}"
STEPS = r"(?md)^\s*(?:\d{1,2}[.)]|[-*•])\s+\S"
TECHNICAL = (
    r"(?U)\b\d+\.\d+(?:\.\d+)*\b|\b[\w-]+\.(?:swift|py|js|ts|tsx|java|kt|go|rs|c|h|cpp|sh|json|ya?ml|toml|plist|md|txt|app|html|css)\b"
    r"|(?:^|\s)(?:~|\.{1,2})?/[\w.-]+/|\b[a-z]+[A-Z][A-Za-z0-9]+\b|\b[A-Z][a-z]+[A-Z][A-Za-z0-9]+\b"
)
WORD = r"[\p{L}\p{N}_'-]+"
#: Languages by file suffix.
LANGUAGES = {
    ".py": "python", ".pyi": "python", ".java": "java", ".kt": "kotlin", ".js": "javascript", ".mjs": "javascript", ".jsx": "javascript", ".ts": "typescript",
    ".tsx": "typescript", ".c": "c", ".h": "c", ".cc": "cpp", ".cpp": "cpp", ".cxx": "cpp", ".hpp": "cpp", ".hh": "cpp", ".cs": "csharp", ".go": "go",
    ".rs": "rust", ".swift": "swift", ".php": "php", ".scala": "scala",
}


def lexicon(spark: SparkSession) -> DataFrame:
    rows = [(kind, name, term) for kind, lists in (("type", TYPES), ("topic", TOPICS)) for name, words in lists.items() for term in sorted(set(words.split()))]
    return spark.createDataFrame(rows, "kind string, name string, term string")


def language(source: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.try_element_at(table, F.lower(F.regexp_extract(source, r"(\.[A-Za-z]+)$", 1)))


def lexicon_hits(documents: DataFrame, sample: int | None = None) -> DataFrame:
    """(doc_id, kind, name, hits, distinct_hits) of a text's words, or its first `sample` characters'; only hits leave their task."""
    text = F.left("text", F.lit(sample)) if sample else F.col("text")
    words = documents.select("doc_id", F.explode(F.regexp_extract_all(normalize(text), F.lit(WORD), F.lit(0))).alias("term"))
    hits = words.join(F.broadcast(lexicon(documents.sparkSession)), "term").groupBy("doc_id", "kind", "name", "term").agg(F.count("*").alias("n"))
    return hits.groupBy("doc_id", "kind", "name").agg(F.sum("n").alias("hits"), F.count("*").alias("distinct_hits"))


def best_topics(documents: DataFrame, least: int = 3) -> DataFrame:
    """(doc_id, topic, n): the topic with the most words in a text, `least` at least; ties by the order of TOPICS."""
    order = F.create_map(*[F.lit(x) for i, t in enumerate(TOPICS) for x in (t, -i)])
    hits = lexicon_hits(documents).where("kind = 'topic'")
    best = hits.groupBy("doc_id").agg(F.max(F.struct("hits", F.element_at(order, F.col("name")).alias("o"), "name")).alias("b"))
    return best.where(F.col("b.hits") >= least).select("doc_id", F.col("b.name").alias("topic"), F.col("b.hits").alias("n"))


def code_score(text: Column) -> Column:
    total = sum((F.regexp_count(text, F.lit(p)) * w for p, w in CODE_SIGNS), F.lit(0.0))
    return total * 100.0 / F.greatest(F.lit(1), F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"), F.lit(""))))


def code_line_share(text: Column) -> Column:
    """The share of lines with content that look like code; weak signs count on short lines only."""
    content = F.filter(F.split(text, r"\r\n|[\n\r\x0b\f\x1c-\x1e\x85  ]"), lambda x: x.rlike(r"(?U)\S"))
    short = lambda x: F.size(F.split(F.trim(F.regexp_replace(x, r"(?U)\s+", " ")), " ")) <= 8
    strong = "|".join(f"(?:{p})" for p, w in CODE_SIGNS if w >= 2)
    weak = "|".join(f"(?:{p})" for p, w in CODE_SIGNS if w < 2)
    looks = F.filter(content, lambda x: x.rlike(strong) | x.rlike(weak) & short(x))
    return F.when(F.size(content) > 0, F.size(looks) / F.size(content)).otherwise(0.0)


def detect(documents: DataFrame) -> DataFrame:
    """(doc_id, data_type, domain, confidence, language, score): the type with the largest score, GENERIC under 2.

    Ties go to the type named first in: CODE, CLINICAL, PROCESS, PERSONAL, NARRATIVE. Null texts read as empty. A
    document id stands for one row: rows that share one are judged by the words of all of them."""
    order = ["CODE", *TYPES]
    whole = F.coalesce("text", F.lit(""))
    docs = documents.where("doc_id is not null").select("doc_id", F.coalesce("source", F.lit("")).alias("source"), whole.alias("s"))
    n = lambda p: F.regexp_count("s", F.lit(p))
    breaks = F.char_length("s") - F.char_length(F.replace("s", F.lit("\n"), F.lit("")))
    base = docs.select(
        "doc_id", "source", language(F.col("source")).alias("language"), code_score(F.col("s")).alias("code"), code_line_share(F.col("s")).alias("share"),
        F.regexp_count(normalize(F.col("s")), F.lit(WORD)).alias("words"),
        (2.0 * n(CHAT) / F.greatest(F.lit(1.0), F.when(breaks == 0, 1.0).otherwise(breaks / 10)) + F.when(n(DATED) >= 2, 3.0).otherwise(0.0)).alias("personal"),
        F.least(F.lit(4.0), n(DIALOGUE) * 0.5).alias("narrative"), F.least(F.lit(5.0), n(STEPS) * 0.6).alias("process"), n(TECHNICAL).alias("marks"),
    )
    hits = lexicon_hits(documents.where("doc_id is not null"))
    wide = hits.groupBy("doc_id").agg(*[F.max(F.when((F.col("kind") == k) & (F.col("name") == m), F.struct("hits", "distinct_hits"))).alias(f"{k}_{m}") for k, lists in (("type", TYPES), ("topic", TOPICS)) for m in lists])
    rows = base.join(wide, "doc_id", "left")
    count = lambda c: F.coalesce(F.col(c)["hits"], F.lit(0))
    density = F.greatest(F.col("words"), F.lit(1)) / 1000.0
    lexical = lambda t: F.when(F.col(f"type_{t}")["distinct_hits"] >= 2, count(f"type_{t}") / density).otherwise(0.0)
    extra = {"CLINICAL": F.lit(0.0), "PROCESS": F.col("process"), "PERSONAL": F.col("personal"), "NARRATIVE": F.col("narrative")}
    score = {t: lexical(t) + extra[t] for t in TYPES}
    score["CODE"] = F.when(F.col("language").isNull() & (F.col("share") < 0.3), 0.0).otherwise(F.col("code")) + F.when(F.col("language").isNotNull(), 6.0).otherwise(0.0)
    ranked = F.reverse(F.array_sort(F.array(*[F.struct(score[t].alias("v"), F.lit(-i).alias("o"), F.lit(t).alias("t")) for i, t in enumerate(order)])))
    rows = rows.withColumn("r", ranked)
    best, second = F.col("r")[0], F.col("r")[1]
    sure = F.when(best["v"] <= 0, 0.0).otherwise(F.bround(F.least(F.lit(1.0), 0.45 * F.least(F.lit(1.0), best["v"] / 12.0) + 0.55 * (best["v"] - second["v"]) / F.nullif(best["v"], F.lit(0.0))), 3))
    first = F.when(best["v"] >= 2.0, best["t"]).otherwise("GENERIC")
    software = count("topic_software") + F.col("marks")
    rival = F.lit(0)
    for t in TYPES:
        rival = F.when(F.col("first") == t, count(f"type_{t}")).otherwise(rival)
    rows = rows.withColumn("first", first)
    technical = F.col("first").isin("PERSONAL", "NARRATIVE", "CLINICAL", "GENERIC") & (software >= 3) & (software >= rival)
    topics = F.reverse(F.array_sort(F.array(*[F.struct(count(f"topic_{t}").alias("n"), F.lit(-i).alias("o"), F.lit(t).alias("t")) for i, t in enumerate(TOPICS)])))[0]
    rows = rows.withColumns({"data_type": F.when(technical, "GENERIC").otherwise(F.col("first")), "topic": topics})
    top, tops = F.col("topic")["t"], F.col("topic")["n"]
    stem = F.regexp_replace(F.element_at(F.split("source", "/"), -1), r"(?<=.)\.[^.]*$", "")
    domain = (
        F.when(F.col("data_type") == "CODE", F.concat_ws(".", F.lit("software"), F.col("language")))
        .when(F.col("data_type") == "CLINICAL", "medicine.clinical")
        .when(F.col("data_type") == "PROCESS", F.when((tops >= 3) & (top != "software"), F.concat(F.lit("process."), top)).otherwise("process"))
        .when(F.col("data_type") == "PERSONAL", F.when(tops >= 12, F.concat(F.lit("personal."), top)).otherwise("personal"))
        .when(F.col("data_type") == "NARRATIVE", "literature.narrative")
        .when((tops >= 3) | (tops >= 2) & (F.col("words") < 60), top)
        .when((F.col("source") != "") & ~F.col("source").contains("://"), slug(stem))
        .otherwise("general")
    )
    return rows.select("doc_id", "data_type", slug(domain).alias("domain"), sure.alias("confidence"), "language", F.round(best["v"], 6).alias("score"))
