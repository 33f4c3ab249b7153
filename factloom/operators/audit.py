"""Prompts and recorded model executions, table in and table out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import exprs as E

from . import contracts

PROMPT_FIELDS = ["input_schema_key", "input_schema_version", "output_schema_key", "output_schema_version", "prompt_key", "system_template", "user_template", "version"]

_PARTS = r"\{\{|\}\}|\{[^{}]*\}|[^{}]+|[{}]"


def prompt_checksums(prompts: DataFrame) -> DataFrame:
    """SHA-256 of the canonical JSON (keys in order) of each prompt's fields, and whether its key and version stand once."""
    summed = prompts.withColumn("checksum", F.sha2(F.to_json(F.struct(*PROMPT_FIELDS), {"ignoreNullFields": "false"}), 256))
    counts = prompts.groupBy("prompt_key", "version").agg(F.count("*").alias("n"))
    return summed.join(counts, ["prompt_key", "version"]).select("prompt_id", "prompt_key", "version", "checksum", (F.col("n") == 1).alias("unique_version"))


def rendered(template: Column, values: Column) -> tuple[Column, Column]:
    """(text, error) of a template with {name} placeholders and a map of values. Values are never expanded again; {{ and }} are braces."""
    parts = F.regexp_extract_all(template, F.lit(_PARTS), F.lit(0))
    holes = F.filter(parts, lambda p: p.rlike(r"^\{[^{}]*\}$"))
    names = F.transform(holes, lambda p: F.substring(p, 2, F.length(p) - 2))
    broken = F.exists(parts, lambda p: p.isin("{", "}")) | F.exists(names, lambda n: (n == "") | n.rlike(r"[.\[\]!:]"))
    missing = F.size(F.array_except(names, F.map_keys(values))) > 0
    fill = lambda p: F.when(p == "{{", "{").when(p == "}}", "}").when(p.rlike(r"^\{[^{}]*\}$"), F.try_element_at(values, F.substring(p, 2, F.length(p) - 2))).otherwise(p)
    error = F.when(broken, "UNSUPPORTED_PLACEHOLDER").when(missing, "MISSING_PLACEHOLDER")
    return F.when(error.isNull(), F.array_join(F.transform(parts, fill), "")), error


def render_prompts(prompts: DataFrame, inputs: DataFrame) -> DataFrame:
    """inputs: execution_id, prompt_id, values (map). Hashes of rendered system and user prompts, or an error. Prompts are few and joined by id."""
    both = inputs.join(prompts.select("prompt_id", "system_template", "user_template"), "prompt_id")
    system, system_error = rendered(F.col("system_template"), F.col("values"))
    user, user_error = rendered(F.col("user_template"), F.col("values"))
    out = both.select("execution_id", "prompt_id", system.alias("system"), user.alias("user"), F.coalesce(system_error, user_error).alias("error"))
    return out.withColumns({"system_sha256": F.sha2("system", 256), "user_sha256": F.sha2("user", 256)})


def execution_audit(executions: DataFrame, *, valid: Callable[[Column], Column] = contracts.claims_output_valid) -> DataFrame:
    """execution_id, status, error_code and, of those that succeeded, output (JSON with keys in order) and its hash; codes in fixed order.

    valid: the contract that an output, as text, must keep; by default that of grounded claims.
    """
    parsed = executions.withColumn("json", F.expr("try_parse_json(output_text)"))
    cost_given = F.col("provider_cost").isNotNull()
    bad_response = (
        F.col("output_text").isNull()
        | (E.strip(F.col("output_text")) == "")
        | ~E.token_usage_valid(F.col("input_tokens"), F.col("output_tokens"), F.col("total_tokens"))
        | (F.col("cost_currency").isNotNull() & ~F.col("cost_currency").rlike("^[A-Z]{3}$"))
        | (cost_given != F.col("cost_currency").isNotNull())
        | (cost_given & E.cost(F.col("provider_cost")).isNull())
    )
    code = (
        F.when(F.col("provider_error").isNotNull(), F.when(F.col("provider_error").isin(E.PROVIDER_CODES), F.col("provider_error")).otherwise("AI_PROVIDER_ERROR"))
        .when(bad_response, "AI_PROVIDER_INVALID_RESPONSE")
        .when(F.col("json").isNull(), "AI_OUTPUT_INVALID_JSON")
        .when(~valid(F.col("output_text")), "AI_OUTPUT_SCHEMA_INVALID")
    )
    coded = parsed.withColumn("error_code", code)
    output = F.when(F.col("error_code").isNull(), F.to_json("json"))
    return coded.select("execution_id", F.when(F.col("error_code").isNull(), "SUCCEEDED").otherwise("FAILED").alias("status"), "error_code", output.alias("output_json"), F.sha2(output, 256).alias("output_sha256"))


def provider_status_code(code: Column, status: Column) -> Column:
    """Stable error code of an HTTP code, or without one of a status name."""
    by_name = (
        F.when(status.isin("UNAUTHENTICATED", "PERMISSION_DENIED"), "AI_PROVIDER_AUTHENTICATION")
        .when(status == "RESOURCE_EXHAUSTED", "AI_PROVIDER_RATE_LIMITED")
        .when(status == "DEADLINE_EXCEEDED", "AI_PROVIDER_TIMEOUT")
        .when(status == "UNAVAILABLE", "AI_PROVIDER_UNAVAILABLE")
        .otherwise("AI_PROVIDER_TRANSPORT")
    )
    by_code = (
        F.when(code.isin(401, 403), "AI_PROVIDER_AUTHENTICATION").when(code == 429, "AI_PROVIDER_RATE_LIMITED").when(code.isin(408, 504), "AI_PROVIDER_TIMEOUT").when(code.between(500, 599), "AI_PROVIDER_UNAVAILABLE").otherwise("AI_PROVIDER_TRANSPORT")
    )
    return F.when(code.isNotNull(), by_code).otherwise(by_name)


def model_allowlist(executions: DataFrame, models: list[str]) -> DataFrame:
    """Executions whose model is blank or not listed."""
    refused = F.coalesce(~F.col("model_id").isin(models) | (E.strip(F.col("model_id")) == ""), F.lit(True))
    return executions.where(refused).select("execution_id", "model_id", F.lit("AI_MODEL_NOT_ALLOWED").alias("error_code"))
