"""Models that a transformation may call, their prices, and prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..errors import ValidationError
from ..functions.text import LANGUAGE_NAMES

# Id, protocol, label, US dollars per million tokens (input, output, cached input), context window, most output tokens.
MODELS = (
    ("gpt-6-luna", "openai", "GPT 6 Luna", 0.1, 0.5, 0.01, 272000, 16384),
    ("deepseek-v4-flash", "openai-compatible", "DeepSeek V4 Flash", 0.14, 0.28, 0.028, 128000, 16384),
    ("glm-5.3-flash", "openai-compatible", "GLM 5.3 Flash", 0.15, 0.5, 0.03, 128000, 16384),
    ("gpt-5.6-luna", "openai", "GPT 5.6 Luna", 0.2, 1.2, 0.02, 272000, 16384),
    ("deepseek-v4.1-flash", "openai-compatible", "DeepSeek V4.1 Flash", 0.3, 1.2, 0.006, 128000, 16384),
    ("minimax-m3", "openai-compatible", "MiniMax M3", 0.3, 1.2, 0.06, 128000, 16384),
    ("gemini-3.5-flash-lite", "google", "Gemini 3.5 Flash Lite", 0.3, 2.5, 0.03, 1000000, 16384),
    ("gemini-3-flash", "google", "Gemini 3 Flash", 0.5, 3.0, 0.05, 1000000, 16384),
    ("glm-5.3", "openai-compatible", "GLM 5.3", 1.4, 4.4, 0.26, 128000, 16384),
)
# Options that some models need, the default model, the prompt's version.
PROVIDER_OPTIONS = {"glm-5.3-flash": {"reasoningEffort": "low"}, "deepseek-v4.1-flash": {"thinking": {"type": "disabled"}}, "glm-5.3": {"reasoningEffort": "low"}}
DEFAULT_MODEL = "gpt-6-luna"
PROMPT_VERSION = "t0002-v1"
PROTOCOLS = ("openai-compatible", "openai", "google")
# Rules of the system prompt.
PROMPT_RULES = (
    "1. Translate all human-readable prose, headings, list items, table cells, captions, and image alternative text.",
    "2. Keep the Markdown structure identical: the same block types in the same order, the same heading levels, the same list markers and item counts, the same table shape, the same block quotes, and the same horizontal rules.",
    "3. Keep code blocks and inline code unchanged.",
    "4. Keep every link target and every image source exactly as written. Translate only the visible link text and the alternative text.",
    "5. Keep internal links such as /read/unit-002 unchanged, and only use internal links that already appear in the source.",
    "6. Do not add, remove, merge, or split any block.",
    "7. Do not add commentary, notes, or explanations.",
    "8. Output the translated Markdown only. Do not wrap the result in a code fence.",
)
SCHEMA = "model string, protocol string, label string, price_in double, price_out double, price_cached double, context_window long, max_output_tokens long, model_order int"


def table(spark: SparkSession) -> DataFrame:
    """The nine models, in rising input price."""
    return spark.createDataFrame([(*m, i) for i, m in enumerate(MODELS)], SCHEMA)


def find(model: str) -> dict:
    names = SCHEMA.split(", ")
    for i, m in enumerate(MODELS):
        if m[0] == model:
            return dict(zip([n.split()[0] for n in names], (*m, i))) | {"provider_options": PROVIDER_OPTIONS.get(model)}
    raise ValidationError(f"Unknown model id: {model}. Known model ids: {', '.join(m[0] for m in MODELS)}")


def options_key(protocol: str, gateway: str = "gateway") -> str:
    """The name under which a provider reads its options."""
    return gateway if protocol == "openai-compatible" else protocol


def language_name(tag: str) -> str:
    return LANGUAGE_NAMES.get(tag.lower().split("-")[0], tag)


def system_prompt(to: str, source: str) -> str:
    head = f"You are a professional literary translator. Translate {language_name(source)} text into {language_name(to)}."
    return "\n".join([head, "", "Rules:", *PROMPT_RULES])


def user_prompt(title: str, markdown: str, to: str, source: str) -> str:
    head = f"Translate the following Markdown unit into {language_name(to)}."
    return "\n".join([head, "", f"Source language: {language_name(source)}", f"Unit title: {title}", "", markdown])
