"""The telemetry fact table: one row per gateway call (SRC-2, A-20).

Input is a *call record* DataFrame (what the gateway knows when a call ends):

  request_id, ts, user_id_raw, requested_model, route, beta_requested,
  input_tokens, output_tokens, cache_read_input_tokens,
  cache_creation_input_tokens, [cache_creation_5m, cache_creation_1h,
  web_search_requests], stream, status, elapsed_ms, ttft_ms,
  [stop_reason, completed, response_message_id, response_tool_names,
   resp_bytes, req_bytes, error_message, search_depth, retry_count,
   has_auth (false: no credentials for the translated route),
   upstream_model (when known, else mapped from requested_model)]

Optional request-body features (see :mod:`gatemeter.operators.bodies`) are
joined on ``request_id``.  The output has the gateway's 49 columns in order,
plus ``est_cost_micro_usd``, the exact integer twin of the cost column.

Plan shape: one narrow projection over the call records; the price list is a
map literal, so a report that reads no cost prunes the lookup away.  No shuffle
unless body features are joined, which is a single equi-join on the key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gatemeter import fixed
from gatemeter.functions import usage as U
from gatemeter.functions.models import (ModelPolicy, downgrade_to, downgraded,
                                       map_model_from_parts, with_model_parts)
from gatemeter.functions.requests import (beta_stripped, error_message, error_type,
                                         parse_user_id_stripped, user_id_object)
from gatemeter.functions.text import pystrip
from gatemeter.sources.prices import price_map

TELEMETRY_COLUMNS: tuple[str, ...] = tuple(f.name for f in fixed.TELEMETRY_SCHEMA.fields)
EXTRA_COLUMNS: tuple[str, ...] = ("est_cost_micro_usd",)

# Request-body feature columns (filled by a join when bodies are available).
BODY_FEATURES: tuple[str, ...] = (
    "n_messages", "system_bytes", "tool_count", "tool_names", "max_tokens", "temperature",
    "top_p", "top_k", "thinking_enabled", "thinking_budget",
)


def _opt(df: DataFrame, name: str, default: Column) -> Column:
    return F.col(name) if name in df.columns else default


def _map_lit(d: dict) -> Column:
    items = []
    for k, v in d.items():
        items += [F.lit(k), F.lit(v)]
    return F.create_map(*items)


def _typed_null(t: T.DataType) -> Column:
    return F.lit(None).cast(t)


def build_telemetry(calls: DataFrame, policy: ModelPolicy | None = None,
                    prices: dict | None = None, body_features: DataFrame | None = None,
                    search_depth: str = fixed.SEARCH_DEPTH_DEFAULT) -> DataFrame:
    """Derive the fact table from call records (see module doc)."""
    policy = policy or ModelPolicy()

    # Stage the per-row string work once: model-name parts and the stripped
    # user id are separate projections, so no regex runs once per CASE branch.
    calls = with_model_parts(calls, "requested_model").withColumn(
        "_uid", pystrip(F.col("user_id_raw")))
    calls = calls.withColumn("_uobj", user_id_object(F.col("_uid")))
    route = F.col("route")
    req_model = F.col("requested_model")
    # search calls keep the client's model name (T9); others are canonicalised
    upstream = F.coalesce(_opt(calls, "upstream_model", _typed_null(T.StringType())),
                          F.when(route == "tavily", req_model).otherwise(
        F.lit(policy.upstream_model) if policy.upstream_model
        else map_model_from_parts(req_model, F.col("_m_bare"), F.col("_m_stripped"), policy)))
    host = (F.when(route == "tavily", F.lit(fixed.SEARCH_UPSTREAM_HOST))
            .when((route == "openai") & F.lit(bool(policy.upstream_base_url)), F.lit(policy.upstream_base_url))
            .otherwise(F.lit(fixed.NATIVE_UPSTREAM_HOST)))
    ids = parse_user_id_stripped(F.col("_uid"), F.col("_uobj"))

    inp = U.nz(F.col("input_tokens"))
    out = U.nz(F.col("output_tokens"))
    cr = U.nz(F.col("cache_read_input_tokens"))
    cw = U.nz(F.col("cache_creation_input_tokens"))
    native_stream = (route == "native") & F.coalesce(F.col("stream"), F.lit(False))
    ttft = F.when(native_stream, F.col("ttft_ms"))
    status = F.col("status")

    staged = calls.select(
        F.col("request_id"), F.col("ts").cast("timestamp_ntz").alias("ts"),
        ids["session_id"].alias("session_id"),
        ids["account_id"].alias("account_id"),
        req_model.alias("requested_model"),
        upstream.alias("upstream_model"),
        route.alias("route"),
        host.alias("upstream_host"),
        _opt(calls, "retry_count", F.lit(0)).cast("int").alias("retry_count"),
        F.col("beta_requested"),
        F.when(route == "native", beta_stripped(F.col("beta_requested"))).alias("beta_stripped"),
        F.coalesce(F.col("stream"), F.lit(False)).alias("stream"),
        _opt(calls, "req_bytes", _typed_null(T.IntegerType())).cast("int").alias("req_bytes"),
        inp.alias("_in"), out.alias("_out"), cr.alias("_cr"), cw.alias("_cw"),
        U.nz(_opt(calls, "cache_creation_5m", F.lit(0))).alias("_cw5"),
        U.nz(_opt(calls, "cache_creation_1h", F.lit(0))).alias("_cw1"),
        U.nz(_opt(calls, "web_search_requests", F.lit(0))).alias("_ws"),
        status.cast("int").alias("status"),
        _opt(calls, "stop_reason", _typed_null(T.StringType())).alias("stop_reason"),
        _opt(calls, "completed", status == 200).alias("completed"),
        F.col("elapsed_ms").cast("int").alias("elapsed_ms"),
        ttft.cast("int").alias("ttft_ms"),
        F.when(native_stream, U.tokens_per_sec(out, F.col("elapsed_ms"), ttft))
        .alias("output_tokens_per_sec"),
        _opt(calls, "resp_bytes", _typed_null(T.IntegerType())).cast("int").alias("resp_bytes"),
        _opt(calls, "response_message_id", _typed_null(T.StringType())).alias("response_message_id"),
        _opt(calls, "response_tool_names", F.array().cast("array<string>")).alias("response_tool_names"),
        error_type(route, status, _opt(calls, "has_auth", F.lit(True))).alias("error_type"),
        error_message(_opt(calls, "error_message", _typed_null(T.StringType()))).alias("error_message"),
        _opt(calls, "search_depth", F.lit(search_depth)).alias("_depth"),
        # request shape, when the call record already carries it (log rebuild)
        _opt(calls, "n_messages", _typed_null(T.IntegerType())).cast("int").alias("n_messages"),
        _opt(calls, "max_tokens", _typed_null(T.IntegerType())).cast("int").alias("max_tokens"),
        F.coalesce(_opt(calls, "tool_names", _typed_null(T.ArrayType(T.StringType()))),
                   F.array().cast("array<string>")).alias("tool_names"),
    )

    # J-1 and J-5: the price list and the per-depth search price are map literals
    priced = staged.withColumn("_price", F.element_at(price_map(prices), F.col("upstream_model")))
    price = F.col("_price")
    depth_price = F.element_at(_map_lit(fixed.SEARCH_PRICES), F.col("_depth"))

    micro = F.when(price.isNotNull(), U.micro_usd(U.cost_e8(
        F.col("_in"), F.col("_out"), F.col("_cr"), F.col("_cw"),
        price["in_c"], price["out_c"], price["cache_read_c"], price["cache_write_c"],
    ))).otherwise(F.lit(0).cast("long"))
    search_cost = F.when((F.col("route") == "tavily") & (F.col("status") == 200),
                         F.coalesce(depth_price, F.lit(fixed.SEARCH_PRICE_DEFAULT))
                         ).otherwise(F.lit(0.0))

    fact = priced.select(
        "request_id", "ts", "session_id",
        _typed_null(T.StringType()).alias("session_name"),
        "account_id", "response_message_id", "requested_model", "upstream_model",
        downgraded(F.col("requested_model"), policy).alias("downgraded"),
        downgrade_to(F.col("requested_model"), policy).alias("downgrade_to"),
        "route", "upstream_host", "retry_count", "beta_requested", "beta_stripped",
        "n_messages",
        F.lit(0).alias("system_bytes"),
        F.size("tool_names").alias("tool_count"),
        "tool_names",
        "max_tokens",
        _typed_null(T.DoubleType()).alias("temperature"),
        _typed_null(T.DoubleType()).alias("top_p"),
        _typed_null(T.IntegerType()).alias("top_k"),
        F.lit(False).alias("thinking_enabled"),
        _typed_null(T.IntegerType()).alias("thinking_budget"),
        "stream", "req_bytes",
        F.col("_in").cast("int").alias("input_tokens"),
        F.col("_out").cast("int").alias("output_tokens"),
        F.col("_cr").cast("int").alias("cache_read_tokens"),
        F.col("_cw").cast("int").alias("cache_creation_tokens"),
        F.col("_cw5").cast("int").alias("cache_creation_5m"),
        F.col("_cw1").cast("int").alias("cache_creation_1h"),
        (F.col("_in") + F.col("_out") + F.col("_cr") + F.col("_cw")).cast("int").alias("total_tokens"),
        U.cache_hit_ratio(F.col("_in"), F.col("_cr")).alias("cache_hit_ratio"),
        F.col("_ws").cast("int").alias("web_search_requests"),
        "status", "stop_reason", "completed", "elapsed_ms", "ttft_ms", "output_tokens_per_sec",
        "resp_bytes", "response_tool_names", "error_type", "error_message",
        U.usd_from_micro(micro).alias("est_anthropic_cost_usd"),
        F.coalesce(price["premium"], F.lit(0.0)).alias("copilot_premium_multiplier"),
        search_cost.alias("tavily_cost_usd"),
        micro.alias("est_cost_micro_usd"),
    )

    if body_features is not None:
        fact = attach_body_features(fact, body_features)
    return fact


def misfit(calls: DataFrame) -> Column:
    """Why :func:`build_telemetry` could not store a call: the first number that the table's type does not hold; else null.

    The counts and columns are those that the projection above casts to ``int``.
    """
    counts = ("input_tokens", "output_tokens", "cache_read_input_tokens", "cache_creation_input_tokens",
              "cache_creation_5m", "cache_creation_1h", "web_search_requests", "status", "elapsed_ms", "retry_count",
              "req_bytes", "resp_bytes", "n_messages", "max_tokens")
    values = {c: F.col(c) for c in counts if c in calls.columns}
    native_stream = (F.col("route") == "native") & F.coalesce(F.col("stream"), F.lit(False))
    values["ttft_ms"] = F.when(native_stream, F.col("ttft_ms"))
    total = F.lit(0).cast("decimal(21,0)")
    for c in counts[:4]:
        total = total + F.coalesce(F.col(c).try_cast("decimal(20,0)"), F.lit(0))
    values["total_tokens"] = total
    return F.coalesce(*[F.when(v.isNotNull() & v.try_cast("int").isNull(),
                               F.concat(F.lit(f"bad_value: {c} = "), v.cast("string"), F.lit(" is no INT")))
                        for c, v in values.items()])


def attach_body_features(fact: DataFrame, features: DataFrame) -> DataFrame:
    """Fill the request-shape columns from parsed bodies (left join on request_id).

    Both sides are keyed on ``request_id``; at scale land both tables bucketed
    by it so this join needs no exchange.  Both grow with the calls: the merge
    join keeps the planner from broadcasting one whose size it guesses too small.
    """
    feats = features.select("request_id", *[F.col(c).alias(f"_b_{c}") for c in BODY_FEATURES
                                            if c in features.columns],
                            *([F.col("req_bytes").alias("_b_req_bytes")]
                              if "req_bytes" in features.columns else []))
    joined = fact.join(feats.hint("merge"), "request_id", "left")
    cols = []
    for name in TELEMETRY_COLUMNS + EXTRA_COLUMNS:
        b = f"_b_{name}"
        if b in feats.columns:
            cols.append(F.coalesce(F.col(b), F.col(name)).alias(name))
        else:
            cols.append(F.col(name))
    return joined.select(*cols)


def telemetry_from_events(events: DataFrame, policy: ModelPolicy | None = None) -> DataFrame:
    """The fact table built from the landed ``events`` table via bridge B1."""
    from gatemeter.sources.bridges import calls_from_usage_raw, usage_raw

    return build_telemetry(calls_from_usage_raw(usage_raw(events)), policy)
