"""Per-request projections (P-5, P-10, P-12, P-16, P-17, P-19..P-21, P-28, P-29)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gatemeter import fixed
from gatemeter.functions.models import ModelPolicy, is_claude_model
from gatemeter.functions.text import blank_to_null, pystrip


def _null_str() -> Column:
    return F.lit(None).cast("string")


def parse_user_id(user_id: Column) -> Column:
    """P-10: ``struct(session_id, account_id)`` from ``metadata.user_id``.

    A JSON-object string gives ``session_id`` and ``account_uuid`` (else
    ``device_id``); anything else, including JSON that does not parse, is
    matched against the legacy underscore form.  Empty values are missing.
    """
    return parse_user_id_stripped(pystrip(user_id))


def user_id_object(s: Column) -> Column:
    """The JSON form of a stripped user id as a map; null unless it looks like
    an object (only JSON-looking values reach the parser)."""
    return F.from_json(F.when(s.startswith("{"), s), "map<string,string>")


def parse_user_id_stripped(s: Column, obj: Column | None = None) -> Column:
    """P-10 over an already whitespace-stripped value.  When the result feeds
    several columns, compute the strip and :func:`user_id_object` in an
    earlier projection and pass both."""
    looks_json = s.startswith("{")
    obj = user_id_object(s) if obj is None else obj
    json_ok = looks_json & obj.isNotNull()
    sess_json = blank_to_null(F.element_at(obj, F.lit("session_id")))
    acct_json = F.coalesce(blank_to_null(F.element_at(obj, F.lit("account_uuid"))),
                           blank_to_null(F.element_at(obj, F.lit("device_id"))))
    # group 2 is ``.+``: a match always yields a non-empty session, so an empty
    # extract means no match (and the account is then missing as well)
    has_marker = s.contains("_session_")
    sess_rx = F.when(has_marker, blank_to_null(F.regexp_extract(s, fixed.USER_ID_PATTERN, 2)))
    acct_rx = F.when(sess_rx.isNotNull(), blank_to_null(F.regexp_extract(s, fixed.USER_ID_PATTERN, 1)))
    return F.struct(
        F.when(json_ok, sess_json).otherwise(sess_rx).alias("session_id"),
        F.when(json_ok, acct_json).otherwise(acct_rx).alias("account_id"),
    )


def _starts_with_any(x: Column, prefixes) -> Column:
    cond = F.lit(False)
    for p in prefixes:
        cond = cond | x.startswith(p)
    return cond


def beta_parts(raw_beta: Column) -> Column:
    """Comma-split, whitespace-stripped beta flags."""
    return F.transform(F.split(raw_beta, ","), lambda b: pystrip(b))


def beta_stripped(raw_beta: Column, prefixes=fixed.STRIP_BETA_PREFIXES) -> Column:
    """P-16: flags removed before forwarding, joined with ``", "``; null if none."""
    dropped = F.filter(beta_parts(raw_beta), lambda b: _starts_with_any(b, prefixes))
    return F.when((raw_beta != "") & (F.size(dropped) > 0), F.array_join(dropped, ", "))


def beta_forwarded(raw_beta: Column, prefixes=fixed.STRIP_BETA_PREFIXES) -> Column:
    """P-16: flags kept, joined with ``", "``; null if none."""
    kept = F.filter(beta_parts(raw_beta), lambda b: ~_starts_with_any(b, prefixes))
    return F.when((raw_beta != "") & (F.size(kept) > 0), F.array_join(kept, ", "))


def http_error_type(status: Column) -> Column:
    """P-19: ``http_<status>`` for any non-200 status."""
    return F.when(status != 200, F.concat(F.lit("http_"), status.cast("string")))


def error_type(route: Column, status: Column, has_auth: Column | None = None) -> Column:
    """P-19: a search call fails as an empty query (400) or at the provider; a
    translated call without credentials as such (503); any other call as
    ``http_<status>``."""
    no_auth = F.lit(False) if has_auth is None else ~F.coalesce(has_auth, F.lit(True))
    return (F.when(status == 200, F.lit(None).cast("string"))
            .when((route == "openai") & (status == 503) & no_auth, F.lit(fixed.ERROR_NO_AUTH))
            .when((route == "tavily") & (status == 400), F.lit(fixed.ERROR_EMPTY_SEARCH_QUERY))
            .when((route == "tavily") & status.isNotNull(), F.lit(fixed.ERROR_SEARCH_FAILED))
            .otherwise(http_error_type(status)))


def error_message(text: Column) -> Column:
    """P-19: the message kept of an error (its first ``ERROR_MESSAGE_MAX_CHARS`` characters)."""
    return F.substring(text, 1, fixed.ERROR_MESSAGE_MAX_CHARS)


def _lookup(mapping: dict, key: Column, default: str) -> Column:
    items = []
    for k, v in mapping.items():
        items += [F.lit(k), F.lit(v)]
    return F.coalesce(F.element_at(F.create_map(*items), F.coalesce(key, F.lit(""))),
                      F.lit(default))


def chat_stop_reason(finish_reason: Column) -> Column:
    """P-17: chat ``finish_reason`` -> message ``stop_reason`` (non-stream map)."""
    return _lookup(fixed.CHAT_STOP_MAP, finish_reason, fixed.CHAT_STOP_DEFAULT)


def chat_stream_stop_reason(finish_reason: Column) -> Column:
    """P-17: the streaming converter's map (no content_filter entry)."""
    return _lookup(fixed.CHAT_STREAM_STOP_MAP, finish_reason, fixed.CHAT_STOP_DEFAULT)


def responses_incomplete_finish(reason: Column) -> Column:
    """P-17: Responses ``incomplete_details.reason`` -> chat ``finish_reason``."""
    return _lookup(fixed.RESPONSES_INCOMPLETE_MAP, reason, fixed.RESPONSES_INCOMPLETE_DEFAULT)


def search_only(tool_types: Column) -> Column:
    """P-20: tools non-empty and every type is a web_search_/web_fetch_ server tool."""
    ok = F.forall(tool_types, lambda t: F.coalesce(
        t.startswith("web_search_") | t.startswith("web_fetch_"), F.lit(False)))
    return F.coalesce((F.size(tool_types) > 0) & ok, F.lit(False))


def derive_route(policy: ModelPolicy, search_key_set: bool, is_search_only: Column) -> Column:
    """P-29: ``tavily`` / ``openai`` / ``native`` from the policy and the body."""
    use_openai = bool(policy.upstream_base_url) or (
        policy.upstream_model is not None and not policy.upstream_model.startswith("claude-"))
    base = F.lit("openai" if use_openai else "native")
    if search_key_set:
        return F.when(is_search_only, F.lit("tavily")).otherwise(base)
    return base


def is_responses_body(n_messages: Column, has_input: Column) -> Column:
    """P-28: a Responses-API body has no message but an ``input``."""
    return (F.coalesce(n_messages, F.lit(0)) <= 0) & F.coalesce(has_input, F.lit(False))


def unknown_fields(keys: Column, allowed=fixed.ALLOWED_BODY_FIELDS) -> Column:
    """P-5: top-level keys outside the allowlist, in body order."""
    allow = F.array(*[F.lit(a) for a in allowed])
    return F.filter(keys, lambda k: ~F.array_contains(allow, k))


__all__ = [
    "parse_user_id", "beta_stripped", "beta_forwarded", "http_error_type", "error_type",
    "error_message", "chat_stop_reason", "chat_stream_stop_reason",
    "responses_incomplete_finish", "search_only",
    "derive_route", "is_responses_body", "unknown_fields",
]
