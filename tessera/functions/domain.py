"""Closed domains, schemas and fixed values that results depend on."""

from __future__ import annotations

from pyspark.sql import types as T

# Names of decisions, severities, issues, sources, states.
DECISIONS = ("APPROVE", "REVIEW", "REJECT")
SEVERITIES = ("INFO", "WARNING", "BLOCKING")
ISSUES = (
    "MISSING_CRITICAL_FIELD", "MISSING_TECHNICAL_ATTRIBUTE", "INVALID_UNIT", "INVALID_STATUS", "SUSPICIOUS_UNIT", "POSSIBLE_DUPLICATE",
    "AMBIGUOUS_DESCRIPTION", "CLASSIFICATION_CONFLICT",
)
SOURCES = ("RULE", "VALIDATION", "DUPLICATE", "LLM")
HUMAN_DECISIONS = ("APPROVE", "REJECT", "REQUEST_CORRECTION")
PENDING, REVIEWED = "PENDING_HUMAN_REVIEW", "REVIEWED"
AUDIT_EVENT, CONCLUDED_EVENT = "HUMAN_REVIEW_RECORDED", "WORKFLOW_CONCLUDED"

# The material record.
FIELDS = ("material_id", "description_short", "long_description", "unit", "manufacturer", "manufacturer_part_number", "material_group", "status")
REQUIRED = ("material_id", "description_short", "unit", "status")
LABEL = "expected_issue"

# Words of the normalisation.
ABBREVIATIONS = {
    "AC": "ACO", "ESF": "ESFERA", "PARAF": "PARAFUSO", "POL": "POLEGADA", "ROLAM": "ROLAMENTO", "SCH": "SCHEDULE", "SEXT": "SEXTAVADO", "VALV": "VALVULA",
}
STOP_WORDS = ("A", "DE", "DO", "DA", "EM", "PARA", "COM", "SEM", "ROSCA", "METRICA", "COMPRIMENTO", "DIAMETRO", "CLASSE", "CABECA")

# Words of the rules.
UNITS, PIECES = ("PC", "UN", "M", "KG", "L"), ("PC", "UN")
STATUSES = ("ACTIVE", "INACTIVE", "UNDER_REVIEW")
LIQUIDS = ("OLEO", "LUBRIFICANTE", "FLUIDO")
GENERIC = ("DIVERSO", "GERAL", "INDUSTRIAL", "OUTROS")
VOLTAGE, FREQUENCY = r"\b\d+\s*(?:V|KV)\b", r"\b(?:50|60)\s*HZ\b"
FILTER_WORDS, GAUGE_WORDS = ("MICRA", "MICRON", "ELEMENTO"), ("CONEXAO", "ROSCA")

# Messages.
MESSAGES = {
    "required": "Campo obrigatório ausente: ",
    "unit": "Unidade não reconhecida: ",
    "liquid": "Material líquido cadastrado em unidade de peça",
    "status": "Status não reconhecido: ",
    "generic": "Descrição usa termo genérico sem especificação adicional",
    "technical": "Atributo técnico ausente: ",
    "duplicate": "Material semelhante a registro existente",
}
MISSING = {
    "CABO": "tensão nominal",
    "MOTOR": "tensão e frequência",
    "FILTRO": "elemento, micragem ou código do fabricante",
    "MANOMETRO": "conexão ao processo",
}
PROMPT = (
    "Analise o cadastro de material abaixo sob a perspectiva de governança PDM/BOM.",
    "A resposta deve obedecer estritamente ao JSON Schema fornecido pelo sistema.",
    "Não invente dados ausentes.",
    "A saída é uma recomendação auditável e deve permanecer sujeita à revisão humana.",
    "",
    "Material:",
)
RATIONALE = {
    "REJECT": "Recomendação REJECT: %d evidência(s) impeditiva(s) e %d evidência(s) revisável(is).",
    "REVIEW": "Recomendação REVIEW: %d evidência(s) requer(em) análise humana.",
    "APPROVE": "Recomendação APPROVE: nenhuma evidência impeditiva ou revisável.",
}
EMPTY_ID = "material_id não pode ser vazio"

# Words of the report.
REPORT_HEAD, REPORT_RULE = "material_id | decisão | completude | confiança | alertas", "-" * 78
REPORT_TITLE, REPORT_ERRORS, REPORT_DECISIONS = "Métricas do baseline", "- Erros:", "- Decisões: %s"
REPORT_MEASURES = (
    ("- Registros: %d", "total"), ("- Acertos: %d", "correct"), ("- Correspondência exata: %.1f%%", "exact_match_accuracy"), ("- Cobertura do rótulo esperado: %.1f%%", "label_hit_rate"),
    ("- Precisão de duplicidade: %.1f%%", "duplicate_precision"), ("- Recall de duplicidade: %.1f%%", "duplicate_recall"),
)

# Weights of the evaluation and confidences of the decision.
COST_MISSED_DUPLICATE, COST_NEEDLESS_REVIEW = 5, 1
SURE_APPROVE, SURE_REJECT, REVIEW_FROM, REVIEW_STEP, REVIEW_LEAST = 0.95, 0.98, 0.85, 0.08, 0.55

ISSUE = T.StructType([T.StructField(n, T.StringType()) for n in ("issue_type", "field_name", "message", "severity")])
MATERIAL = T.StructType([T.StructField("ord", T.LongType(), False), *[T.StructField(n, T.StringType(), False) for n in FIELDS]])
