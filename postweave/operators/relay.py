"""Requests to and replies from model providers as table columns.

Credentials never enter a table: only booleans say whether they are there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postweave.functions.text import or_else

# Provider, request family, default base, path, default model, credential message.
PROVIDERS = [
    ("groq", "chat", "https://api.groq.com/openai/v1", "/chat/completions",
     "llama-3.1-8b-instant", "Missing GROQ_API_KEY environment variable"),
    ("cohere", "message", "https://api.cohere.com/v1/chat", None,
     "command-r", "Missing COHERE_API_KEY environment variable"),
    ("cerebras", "chat", "https://api.cerebras.ai/v1", "/chat/completions",
     "llama3.1-8b", "Missing CEREBRAS_API_KEY environment variable"),
    ("databricks", "chat", "https://{host}/api/2.0/ai", "/chat/completions",
     "meta-llama/Meta-Llama-3.1-8B-Instruct",
     "Missing DATABRICKS_HOST or DATABRICKS_TOKEN environment variables"),
    ("vapi", "input", "https://api.vapi.ai/v1", "/messages",
     "default", "Missing VAPI_API_KEY environment variable"),
]
DEFAULT_TEMPERATURE = 0.2
DEFAULT_TIMEOUT = 60.0
NEEDS_HOST = "databricks"


def by_provider(provider: Column, values: dict[str, str | None]) -> Column:
    """The value of a provider as an expression, null for unknown ones: no join is needed."""
    picked = F.lit(None).cast("string")
    for name, value in values.items():
        picked = F.when(provider == name, F.lit(value)).otherwise(picked)
    return picked


def provider_field(provider: Column, position: int) -> Column:
    return by_provider(provider, {p[0]: p[position] for p in PROVIDERS})


def family(provider: Column) -> Column:
    return provider_field(provider, 1)


# ---- requests ------------------------------------------------------------------------------


def resolve_model(provider: Column, model: Column, overrides: dict[str, str] | None = None) -> Column:
    """The given model unless null or empty, else the override, else the provider's default."""
    return or_else(model, F.coalesce(by_provider(provider, overrides or {}), provider_field(provider, 4)))


def credential_error(provider: Column, has_key: Column, has_host: Column) -> Column:
    """Message when a credential is missing; one provider needs a host as well."""
    present = F.coalesce(has_key, F.lit(False)) & (F.coalesce(has_host, F.lit(False)) | (provider != NEEDS_HOST))
    return F.when(provider_field(provider, 5).isNotNull() & ~present, provider_field(provider, 5))


def chat_messages(system: Column, prompt: Column) -> Column:
    message = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    user = message("user", prompt)
    return F.when(system != "", F.array(message("system", system), user)).otherwise(F.array(user))


def prefix_system(system: Column, prompt: Column) -> Column:
    return F.when(system != "", F.concat(F.lit("[system]: "), system, F.lit("\n\n"), prompt)).otherwise(prompt)


def request_payload(
    provider: Column, model: Column, system: Column, prompt: Column, temperature: Column
) -> Column:
    """Request body as JSON by provider family, null for unknown providers."""
    options = {"ignoreNullFields": "false"}
    chat = F.struct(
        model.alias("model"),
        chat_messages(system, prompt).alias("messages"),
        temperature.alias("temperature"),
        F.lit(False).alias("stream"),
    )
    single = prefix_system(system, prompt)
    message = F.struct(model.alias("model"), single.alias("message"), temperature.alias("temperature"))
    plain = F.struct(single.alias("input"), model.alias("model"), temperature.alias("temperature"))
    kind = family(provider)
    return (
        F.when(kind == "chat", F.to_json(chat, options))
        .when(kind == "message", F.to_json(message, options))
        .when(kind == "input", F.to_json(plain, options))
    )


def request_url(provider: Column, host: Column, base: Column | None = None) -> Column:
    """Endpoint: a given base, else the default (one is derived from ``host``), plus the path."""
    default = F.replace(provider_field(provider, 2), F.lit("{host}"), F.coalesce(host, F.lit("")))
    root = default if base is None else F.coalesce(base, default)
    path = provider_field(provider, 3)
    return F.when(path.isNull(), root).otherwise(F.concat(F.rtrim(root, F.lit("/")), path))


def build_requests(
    rows: DataFrame, host: str | None = None, overrides: dict[str, str] | None = None, base: Column | None = None
) -> DataFrame:
    """Resolve ``model`` and add ``url``, ``payload`` and ``error`` to request rows.

    ``base`` replaces the provider's address where it is not null.

    Reads ``provider, prompt, system, model, temperature, has_key, has_host``. A row with an error
    or an unknown provider has no payload.
    """
    provider, system, prompt = F.col("provider"), F.col("system"), F.col("prompt")
    resolved = rows.withColumn("model", resolve_model(provider, F.col("model"), overrides)).withColumn(
        "error", credential_error(provider, F.col("has_key"), F.col("has_host"))
    )
    payload = request_payload(provider, F.col("model"), system, prompt, F.col("temperature"))
    return resolved.withColumns(
        {
            "url": F.when(F.col("error").isNull(), request_url(provider, F.lit(host), base)),
            "payload": F.when(F.col("error").isNull(), payload),
        }
    )


# ---- replies -------------------------------------------------------------------------------


_EMPTY = ["null", "false", "0", "0.0", "-0", "-0.0", "[]", "{}", '""']  # as JSON


def reply_chat(raw: Column) -> Column:
    return F.get_json_object(raw, "$.choices[0].message.content")


def _filled(raw: Column, field: str) -> Column:
    """Text of a field; null when it is absent, empty, false, zero, or an empty list or object."""
    value = F.to_json(F.try_variant_get(F.try_parse_json(raw), f"$.{field}", "variant"))
    empty = F.coalesce(value, F.lit("null")).isin(_EMPTY)
    return F.when(~empty, F.get_json_object(raw, f"$.{field}"))


def reply_text_chain(raw: Column) -> Column:
    """``text``, else ``output_text`` even when empty, else the text of the first generation."""
    return F.coalesce(
        _filled(raw, "text"), F.get_json_object(raw, "$.output_text"), F.get_json_object(raw, "$.generations[0].text")
    )


def reply_output_chain(raw: Column) -> Column:
    """``text``, else ``output``, else ``message``, which may be an object."""
    return F.coalesce(_filled(raw, "text"), _filled(raw, "output"), F.get_json_object(raw, "$.message"))


def route_replies(rows: DataFrame, provider: str = "provider", raw: str = "raw", error: str = "error") -> DataFrame:
    """Add ``output_text`` by provider family and the exit ``code``: 2 unknown, 1 failed, 0 fine."""
    kind, body = family(F.col(provider)), F.col(raw)
    text = (
        F.when(kind == "chat", reply_chat(body))
        .when(kind == "message", reply_text_chain(body))
        .when(kind == "input", reply_output_chain(body))
    )
    code = F.when(kind.isNull(), 2).when(F.col(error).isNotNull(), 1).otherwise(0)
    return rows.withColumns({"code": code.cast("bigint"), "output_text": F.when(code == 0, text)})


def result_json(provider: Column, model: Column, text: Column, raw: Column) -> Column:
    """The whole result as JSON, the provider's reply nested as it came."""
    head = F.to_json(
        F.struct(provider.alias("provider"), model.alias("model"), text.alias("output_text")),
        {"ignoreNullFields": "false"},
    )
    return F.concat(F.regexp_replace(head, r"\}$", ""), F.lit(',"raw":'), raw, F.lit("}"))


def select_output(raw_flag: Column, whole: Column, text: Column) -> Column:
    return F.when(raw_flag, whole).otherwise(F.coalesce(text, F.lit("")))


def failure_message(code: Column, url: Column, body: Column, reason: Column) -> Column:
    """Message of a failed call, null when it went well."""
    http = F.concat(F.lit("HTTP "), code.cast("string"), F.lit(" calling "), url, F.lit(": "), body)
    network = F.concat(F.lit("Network error calling "), url, F.lit(": "), reason)
    return F.when(reason.isNotNull(), network).when(code >= 400, http)
