"""Query enhancement: intent, entities and hypothetical documents as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keywords of each intent, first match wins (fixed values).
INTENT_KEYWORDS = (
    ("api_lookup", ("router", "路由", "跳转", "页面")),
    ("error_fix", ("error", "错误", "修复", "失败")),
    ("migration", ("kmp", "android", "ios", "迁移")),
    ("adaptive", ("一多", "断点", "adaptive")),
    ("new_component", ("组件", "component", "列表", "刷新")),
)

#: Own wording; {} is the query.
TEMPLATES = {
    "api_lookup": "// {}\n// Reference entry: import the module, call it with its options, handle the result.\nimport api from 'module';\napi.call({{ option: value }});",
    "error_fix": "// {}\n// Symptom, cause and remedy of the failure.\ntry {{\n  run();\n}} catch (e) {{\n  recover(e);\n}}",
    "migration": "// {}\n// The construct on the source platform and its counterpart on the target.\nconst before = source();\nconst after = target(before);",
    "adaptive": "// {}\n// Layout that follows the width of the window.\nif (width < breakpoint) {{\n  column();\n}} else {{\n  row();\n}}",
    "new_component": "// {}\n// A component with state and a build function.\n@Component\nstruct View {{\n  @State value: number = 0;\n  build() {{}}\n}}",
    "generic": "// {}\n// A short explanation with an example.\nexample();",
}


def classify_intent(raw: Column) -> Column:
    """Keywords match anywhere in the lower-cased text, also inside words."""
    low = F.lower(raw)
    out = F.lit("generic")
    for intent, keywords in reversed(INTENT_KEYWORDS):
        hit = F.lit(False)
        for k in keywords:
            hit = hit | F.coalesce(F.contains(low, F.lit(k)), F.lit(False))
        out = F.when(hit, intent).otherwise(out)
    return out


def dedup_adjacent(items: Column) -> Column:
    """items without elements equal to the one before."""
    return F.element_at(F.transform(F.array(items), lambda v: F.filter(v, lambda x, i: (i == 0) | ~x.eqNullSafe(F.get(v, i - 1)))), 1)


def extract_entities(raw: Column) -> Column:
    """Pieces of letters, digits, underscores and dots, of at least two bytes, with an upper-case letter, a dot or an ASCII digit."""
    return dedup_adjacent(F.filter(F.split(raw, r"[^\p{L}\p{N}_.]+"), lambda x: (F.octet_length(x) >= 2) & x.rlike(r"[\p{Lu}.0-9]")))


def hyde_document(raw: Column, intent: Column) -> Column:
    def filled(template: str) -> Column:
        head, tail = template.replace("{{", "\0").replace("}}", "\1").split("{}")
        back = lambda s: F.lit(s.replace("\0", "{").replace("\1", "}"))
        return F.concat(back(head), raw, back(tail))

    out = filled(TEMPLATES["generic"])
    for name, template in TEMPLATES.items():
        if name != "generic":
            out = F.when(intent == name, filled(template)).otherwise(out)
    return out


def rule_enhance(queries: DataFrame) -> DataFrame:
    """query_id, raw, rewritten, hyde_doc, entities and intent."""
    q = queries.select("query_id", F.col("query").alias("raw"), F.col("query").alias("rewritten"))
    q = q.withColumn("intent", classify_intent(F.col("raw"))).withColumn("entities", extract_entities(F.col("raw")))
    return q.withColumn("hyde_doc", hyde_document(F.col("raw"), F.col("intent")))
