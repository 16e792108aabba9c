"""Model-name canonicalisation and model-id parsing as Column expressions.

All of it is built-in expressions (regexp, CASE, map lookups), so it stays
inside whole-stage codegen; no Python runs per row.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from gatemeter import fixed


@dataclass(frozen=True)
class ModelPolicy:
    """Which model every Opus request resolves to, and the family aliases.

    ``family_map`` maps bare / major-only names (``claude-sonnet``,
    ``claude-sonnet-4``) to a concrete model; build it from a catalog with
    :func:`gatemeter.operators.catalog.policy_from_catalog`.
    """

    opus_model: str = fixed.OPUS_MODEL_DEFAULT
    no_opus: bool = False
    no_opus_target: str = fixed.NO_OPUS_TARGET_DEFAULT
    family_map: dict = field(default_factory=lambda: dict(fixed.MODEL_FAMILY_MAP_DEFAULT))
    static_map: dict = field(default_factory=lambda: dict(fixed.MODEL_STATIC_MAP))
    upstream_base_url: str | None = None  # set => every call takes the translated route
    upstream_model: str | None = None  # set => the model of every call but searches

    def resolved_opus(self) -> str:
        return self.no_opus_target if self.no_opus else self.opus_model


def _map_literal(d: dict) -> Column:
    if not d:
        return F.create_map().cast("map<string,string>")
    items = []
    for k, v in d.items():
        items += [F.lit(k), F.lit(v)]
    return F.create_map(*items)


def strip_bracket_suffix(model: Column) -> Column:
    """``claude-opus-4-6[1m]`` -> ``claude-opus-4-6`` (regex only when it ends in ``]``)."""
    return F.when(model.endswith("]"), F.regexp_replace(model, fixed.BRACKET_SUFFIX, "")).otherwise(model)


def strip_date_suffix(model: Column) -> Column:
    """``claude-opus-4-6-20260312`` -> ``claude-opus-4-6`` (regex only when a
    ``-`` sits nine characters from the end)."""
    return F.when(F.substring(model, -9, 1) == "-",
                  F.regexp_replace(model, fixed.DATE_SUFFIX, "")).otherwise(model)


def is_opus_name(stripped: Column) -> Column:
    return (stripped == F.lit("claude-opus")) | stripped.startswith("claude-opus-")


def resolve_opus(policy: ModelPolicy) -> Column:
    """P-2: the downgrade target when the policy forbids Opus, else the pin."""
    return F.lit(policy.resolved_opus())


def map_model_name(model: Column, policy: ModelPolicy | None = None) -> Column:
    """P-1: client model name -> upstream model name.

    Order: strip ``[...]``, strip ``-YYYYMMDD``; any Opus -> policy; static
    map; ``claude-<tier>-<maj>-<min>`` -> ``<maj>.<min>``; family alias;
    otherwise the bracket-stripped (date kept) input.
    """
    bare = strip_bracket_suffix(model)
    return map_model_from_parts(model, bare, strip_date_suffix(bare), policy)


def map_model_from_parts(model: Column, bare: Column, stripped: Column,
                         policy: ModelPolicy | None = None) -> Column:
    """P-1 over precomputed ``bare`` (brackets stripped) and ``stripped`` (date
    stripped too).  Pass columns computed in an earlier ``select`` so the
    regexes run once per row instead of once per CASE branch."""
    policy = policy or ModelPolicy()
    static = F.element_at(_map_literal(policy.static_map), stripped)
    family = F.element_at(_map_literal(policy.family_map), stripped)
    dotted = F.regexp_replace(stripped, fixed.TIER_MAJOR_MINOR, "$1.$2")
    return (
        F.when(model.isNull(), F.lit(None).cast("string"))
        .when(is_opus_name(stripped), resolve_opus(policy))
        .when(static.isNotNull(), static)
        .when(stripped.rlike(fixed.TIER_MAJOR_MINOR), dotted)
        .when(family.isNotNull(), family)
        .otherwise(bare)
    )


def with_model_parts(df, model_col: str, prefix: str = "_m"):
    """Add ``<prefix>_bare`` and ``<prefix>_stripped`` columns (two projections,
    so each regex is evaluated once per row)."""
    df = df.withColumn(f"{prefix}_bare", strip_bracket_suffix(F.col(model_col)))
    return df.withColumn(f"{prefix}_stripped", strip_date_suffix(F.col(f"{prefix}_bare")))


def is_claude_model(model: Column) -> Column:
    """P-3."""
    return model.startswith("claude-")


def downgraded(requested_model: Column, policy: ModelPolicy | None = None) -> Column:
    """P-13: only the ``claude-opus-`` prefix counts (bare ``claude-opus`` does not)."""
    policy = policy or ModelPolicy()
    return F.coalesce(F.lit(policy.no_opus) & requested_model.startswith("claude-opus-"),
                      F.lit(False))


def downgrade_to(requested_model: Column, policy: ModelPolicy | None = None) -> Column:
    policy = policy or ModelPolicy()
    return F.when(downgraded(requested_model, policy), F.lit(policy.no_opus_target))


def parse_model_id(model_id: Column) -> Column:
    """P-4: struct(tier, major, minor, suffix, sort_key) or null when not a tiered id.

    ``sort_key`` orders newer first when compared descending:
    (major, minor or 0, 1 if no suffix else 0).
    """
    ok = model_id.rlike(fixed.MODEL_ID_PATTERN)
    tier = F.regexp_extract(model_id, fixed.MODEL_ID_PATTERN, 1)
    major = F.regexp_extract(model_id, fixed.MODEL_ID_PATTERN, 2).cast("int")
    minor_s = F.regexp_extract(model_id, fixed.MODEL_ID_PATTERN, 3)
    suffix_s = F.regexp_extract(model_id, fixed.MODEL_ID_PATTERN, 4)
    # regexp_extract returns '' for an absent group (T14)
    minor = F.when(minor_s == "", F.lit(None).cast("int")).otherwise(minor_s.cast("int"))
    suffix = F.when(suffix_s == "", F.lit(None).cast("string")).otherwise(suffix_s)
    sort_key = F.struct(
        major.alias("major"),
        F.coalesce(minor, F.lit(0)).alias("minor"),
        F.when(suffix_s == "", F.lit(1)).otherwise(F.lit(0)).alias("bare"),
    )
    return F.when(ok, F.struct(
        tier.alias("tier"), major.alias("major"), minor.alias("minor"),
        suffix.alias("suffix"), sort_key.alias("sort_key")))
