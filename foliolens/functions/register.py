"""The scalar functions for SQL text, as SQL functions (no Python per row)."""

from __future__ import annotations

from pyspark.sql import SparkSession

from foliolens import fixed_values as V
from foliolens.functions.text import WS

_UNSAFE = r'[<>:"/\\|?*]'
_COLLAPSED = f"trim(regexp_replace(coalesce(t, ''), r'{WS}+', ' '))"
_SENTENCES = (
    r"filter(regexp_extract_all(coalesce(t, ''), r'[^.!?]++(?:[.!?]++|\z)', 0), "
    "s -> substring(s, -1, 1) IN ('.', '!', '?'))"
)


def _trimmed(value: str) -> str:
    return rf"regexp_replace({value}, r'\A{WS}+|{WS}+\z', '')"


def _escaped() -> str:
    value = "coalesce(t, '')"
    for char, reference in V.HTML_ESCAPES:
        value = f'replace({value}, r"{char}", "{reference}")' if char != '"' else f"replace({value}, '\"', '{reference}')"
    return value


def _marked(mark: str) -> str:
    return f"transform(regexp_extract_all(coalesce(t, ''), r'{mark}[0-9A-Za-z_]+', 0), x -> lower(x))"


def _definitions() -> dict[str, tuple[str, str, str]]:
    """Parameters, result type and body by function name."""
    words = f"octet_length({_COLLAPSED}) - octet_length(replace({_COLLAPSED}, ' ', '')) + int({_COLLAPSED} != '')"
    safe = f"regexp_replace(regexp_replace(regexp_replace(t, r'{_UNSAFE}', ''), r'{WS}+', '_'), r'^[.]+|[.]+$', '')"
    whole = _trimmed("coalesce(t, '')")
    first = _trimmed(f"array_join(slice({_SENTENCES}, 1, n), ' ')")
    return {
        "fl_clean_text": ("t STRING", "STRING", f"trim(regexp_replace({_COLLAPSED}, r'{V.ZERO_WIDTH}', ''))"),
        "fl_word_count": ("t STRING", "BIGINT", words),
        "fl_estimate_minutes": ("t STRING, wpm INT", "BIGINT", "ceil(fl_word_count(t) / wpm)"),
        "fl_file_slug": (
            "t STRING", "STRING",
            f"CASE WHEN coalesce(t, '') = '' THEN 'untitled' ELSE lower(substring({safe}, 1, {V.MAX_SLUG_LENGTH})) END",
        ),
        "fl_truncate": (
            "t STRING, n INT, suffix STRING", "STRING",
            "CASE WHEN length(coalesce(t, '')) <= n THEN coalesce(t, '') "
            "ELSE concat(substring(t, 1, greatest(n - length(suffix), 0)), suffix) END",
        ),
        "fl_hashtags": ("t STRING", "ARRAY<STRING>", _marked("#")),
        "fl_mentions": ("t STRING", "ARRAY<STRING>", _marked("@")),
        "fl_domain": (
            "t STRING", "STRING",
            r"coalesce(regexp_replace(lower(try_parse_url(t, 'HOST')), r'^(.*?)www\.', '$1'), '')",
        ),
        "fl_is_valid_url": ("t STRING", "BOOLEAN", "try_parse_url(t, 'PROTOCOL') IS NOT NULL"),
        "fl_summary": (
            "t STRING, n INT", "STRING",
            f"CASE WHEN size({_SENTENCES}) <= n THEN {whole} ELSE {first} END",
        ),
        "fl_digits_count": (
            "t STRING", "BIGINT", "if(coalesce(t, '') RLIKE '[0-9]', try_cast(regexp_replace(t, '[^0-9]', '') AS BIGINT), 0L)",
        ),
        "fl_contains_ci_either": (
            "a STRING, b STRING", "BOOLEAN", "contains(lower(a), lower(b)) OR contains(lower(b), lower(a))",
        ),
        "fl_html_escape": ("t STRING", "STRING", _escaped()),
        "fl_csv_escape": ("t STRING", "STRING", "replace(coalesce(t, ''), '\"', '\"\"')"),
        "fl_engagement": (
            "claps BIGINT, responses BIGINT", "BIGINT", "coalesce(claps, 0) + coalesce(responses, 0)",
        ),
    }


def register_functions(spark: SparkSession) -> list[str]:
    """Create the ``fl_*`` SQL functions in the session and return their names."""
    definitions = _definitions()
    for name, (parameters, result, body) in definitions.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
    return list(definitions)
