"""Ordered rules and keyword features."""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.functions.text import accent_fold

# Outcome classes and the phrases that give them, in the order in which they are tried.
OUTCOMES = {
    "ADMITIDO": ["con lugar", "ha lugar", "ha lugar parcialmente", "otorgado", "otorgado parcialmente", "reforma otorgamiento", "confirmando otorgamiento", "revoca denegatoria", "declara la procedencia", "declara competente", "se declara competente", "admitida a trámite", "auto de admisión", "fundada la queja", "reconocer y darle cumplimiento", "declarar inconstitucional", "inconstitucionalidad", "inconstitucionalidad parcial", "declara la constitucionalidad"],
    "DENEGADO": ["no ha lugar", "sin lugar", "denegado", "no admitida", "no admitido", "auto de inadmisión", "inadmisibilidad", "inadmisión in limine", "no admitida", "declara la no procedencia", "infundada la queja", "improcedente la acción", "no ha lugar la admisión", "rechazada", "desestima", "confirma inadmisibilidad", "recurso no admitido", "confirmando denegatoria", "reforma denegatoria"],
    "SOBRESEIMIENTO": ["sobreseimiento", "confirmando sobreseimiento", "sobreseer", "reformando sobreseimiento", "revoca sobreseimiento"],
    "NULIDAD": ["nulidad absoluta", "nulidad de oficio", "nulidad subsidiaria", "nulidad de autos"],
    "CASACION": ["casa totalmente", "casa parcialmente", "revoca fallo", "reforma fallo", "revoca otorgamiento", "confirma fallo", "confirma parcialmente", "confirma inadmisibilidad"],
    "OTRO": ["desistimiento", "reserva de actuaciones", "reservado", "suspensión de la ciudadanía", "amonestación", "precluído", "desierto", "abstenerse", "devolver antecedentes", "retirada", "libramiento de comunicación", "declara de oficio", "verificar"],
}

# Keyword groups counted as features.
KEYWORDS = {
    "kw_no_ha_lugar": [r"\bno ha lugar\b", r"\bsin lugar\b", r"\bdeclara(?:r)? sin lugar\b"],
    "kw_ha_lugar": [r"(?<!no )\bha lugar\b", r"\bcon lugar\b", r"\bdeclara(?:r)? con lugar\b"],
    "kw_casacion": [r"\bcasaci[oó]n\b", r"\bcasa(?:r|do|da)?\b"],
    "kw_revoca": [r"\brevoca(?:r|do|da)?\b"],
    "kw_confirma": [r"\bconfirma(?:r|do|da)?\b"],
    "kw_sobreseimiento": [r"\bsobreseim", r"\bsobresee\b", r"\bsobreseer\b"],
    "kw_nulidad": [r"\bnulidad\b", r"\bnulo\b", r"\bnula\b"],
    "kw_inadmisibilidad": [r"\binadmis", r"\bno admit", r"\bin limine\b"],
    "kw_otorga": [r"\botorga(?:miento)?\b", r"\botorgado\b"],
    "kw_deniega": [r"\bdeniega\b", r"\bdenegado\b", r"\bimprocedente\b"],
    "kw_competencia": [r"\bcompetente\b", r"\bincompetente\b"],
    "kw_constitucionalidad": [r"\binconstitucional", r"\bconstitucionalidad\b"],
    "regla_admitido": [r"\bha lugar\b", r"\bcon lugar\b", r"\botorgado\b", r"\bprocedente\b"],
    "regla_denegado": [r"\bno ha lugar\b", r"\bsin lugar\b", r"\bdenegado\b", r"\bimprocedente\b"],
    "regla_sobreseimiento": [r"\bsobreseim", r"\bsobresee\b", r"\bsobreseer\b"],
    "regla_nulidad": [r"\bnulidad\b", r"\bnulo\b", r"\bnula\b"],
    "regla_casacion": [r"\bcasaci[oó]n\b", r"\bcasa(?:r|do|da)?\b", r"\brevoca\b", r"\breforma fallo\b"],
    "regla_otro": [r"\bdesistimiento\b", r"\breserva\b", r"\babstenerse\b"],
}

# Hints of a query's intent by facet.
INTENT = {
    "fallo_macro": {"CASACION": ["casacion", "recurso de casacion"], "NULIDAD": ["nulidad", "nulo", "nula"], "SOBRESEIMIENTO": ["sobreseimiento", "sobreseer", "sobresee"], "ADMITIDO": ["ha lugar", "con lugar", "otorgar", "otorgamiento", "procedente"], "DENEGADO": ["no ha lugar", "sin lugar", "inadmis", "improcedente", "rechazo"]},
    "tipo_proceso": {"Amparo": ["amparo"], "Casacion": ["casacion"], "Habeas Corpus": ["habeas corpus", "exhibicion personal"], "Inconstitucionalidad": ["inconstitucionalidad", "inconstitucional"], "Revision": ["revision"], "Recurso": ["recurso"]},
    "materia": {
        "Derecho Laboral": ["laboral", "trabajador", "despido", "indemnizacion", "salario"],
        "Derecho Penal": ["penal", "delito", "pena", "estafa", "fraude", "acusado"],
        "Derecho Civil": ["civil", "contrato", "obligacion", "responsabilidad", "daños"],
        "Contencioso Administrativo": ["administrativo", "licitacion", "acto administrativo", "contencioso"],
        "Derecho Constitucional": ["constitucional", "constitucion", "garantias", "amparo"],
        "Derechos Humanos": ["derechos humanos", "niñez", "mujer", "discapacidad", "vulnerable"],
    },
}


def first_rule(c: Column, rules: dict[str, list[str]] = OUTCOMES, empty: str | None = "DESCONOCIDO", other: str | None = "OTRO", longest_match: bool = False) -> Column:
    """The first class with a phrase in the text. longest_match: the class of the longest phrase found instead, so a negation beats what it contains."""
    low = F.lower(F.trim(c))
    pairs = [(phrase, name) for name, phrases in rules.items() for phrase in phrases]
    if longest_match:
        pairs.sort(key=lambda p: -len(p[0]))
    out = F.when(F.coalesce(c, F.lit("")) == "", F.lit(empty))
    for phrase, name in pairs:
        out = out.when(F.contains(low, F.lit(phrase)), F.lit(name))
    return out.otherwise(F.lit(other))


def keyword_counts(folded: Column, groups: dict[str, list[str]] = KEYWORDS) -> dict[str, Column]:
    """Matches of each group's patterns in folded, lower-case text."""
    return {k: reduce(Column.__add__, [F.regexp_count(folded, F.lit("(?i)" + p)) for p in ps]) for k, ps in groups.items()}


def keyword_vector(main: Column, other: Column | None = None) -> dict[str, Column]:
    """For each group a flag and a count, then length, line breaks and share of capitals of main, or of other where main is blank."""
    text = F.trim(F.coalesce(main, F.lit("")))
    if other is not None:
        text = F.when(text == "", F.trim(F.coalesce(other, F.lit("")))).otherwise(text)
    counts = keyword_counts(F.lower(accent_fold(text)))
    out = {f"{k}_{kind}": c for k, n in counts.items() for kind, c in (("flag", (n > 0).cast("int")), ("count", n))}
    return out | {"texto_char_len": F.char_length(text), "texto_linebreaks": F.regexp_count(text, F.lit("\n")), "texto_upper_ratio": upper_ratio(text)}


def upper_ratio(c: Column) -> Column:
    letters = F.regexp_count(c, F.lit(r"\p{L}"))
    return F.when(letters == 0, 0.0).otherwise(F.regexp_count(c, F.lit(r"\p{Lu}")) / letters)


def intent(query: Column) -> dict[str, Column]:
    """The first hit of each facet in a folded, lower-case query; null if none."""
    return {facet: first_rule(query, hints, None, None) for facet, hints in INTENT.items()}
