"""Model catalog: newest model per tier and per (tier, major) (SRC-6, A-9, A-10, J-3)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatemeter.functions.models import ModelPolicy, parse_model_id


def catalog_from_json(raw: DataFrame, col: str = "value") -> DataFrame:
    """SRC-6: ``(pos, id)`` from a landed catalog payload in any of its shapes:
    ``{"data":[{"id":..}]}``, a bare list of objects, or a list of strings.
    Entries without an id are dropped."""
    v = F.try_parse_json(F.col(col))
    items = F.coalesce(F.try_variant_get(v, "$.data", "array<variant>"),
                       F.try_variant_get(v, "$", "array<variant>"))
    exploded = raw.select(F.posexplode(items).alias("pos", "item"))
    ident = F.coalesce(F.try_variant_get(F.col("item"), "$.id", "string"),
                       F.try_variant_get(F.col("item"), "$", "string"))
    # an object without id casts to its JSON text; keep only true strings / ids
    is_obj = F.schema_of_variant(F.col("item")).startswith("OBJECT")
    ident = F.when(is_obj, F.try_variant_get(F.col("item"), "$.id", "string")).otherwise(ident)
    return exploded.select("pos", ident.alias("id")).where(F.col("id").isNotNull() & (F.col("id") != ""))


def _ranked(catalog: DataFrame, id_col: str, pos_col: str | None) -> DataFrame:
    p = parse_model_id(F.col(id_col))
    pos = F.col(pos_col) if pos_col else F.lit(0)
    parsed = F.struct(F.col(id_col).alias("id"), pos.alias("_pos"), p.alias("_p"))
    # behind a generator the parse is not copied into every use of its parts
    return (catalog.select(F.inline(F.array(parsed)))
            .where(F.col("_p").isNotNull())
            .select("id", F.col("_p.tier").alias("tier"), F.col("_p.major").alias("major"),
                    # newest first; among equal versions the earliest catalog entry wins
                    F.struct(F.col("_p.sort_key.major"), F.col("_p.sort_key.minor"),
                             F.col("_p.sort_key.bare"), (-F.col("_pos")).alias("first"))
                    .alias("_key")))


def latest_per_tier(catalog: DataFrame, id_col: str = "id", pos_col: str | None = "pos") -> DataFrame:
    """A-9: ``(tier, model_id)``: the arg-max of (major, minor, bare) per tier."""
    return (_ranked(catalog, id_col, pos_col).groupBy("tier")
            .agg(F.max_by("id", "_key").alias("model_id")))


def family_map(catalog: DataFrame, id_col: str = "id", pos_col: str | None = "pos") -> DataFrame:
    """A-10: ``(alias, model_id)``: ``claude-<tier>-<major>`` -> newest of that
    major for sonnet/haiku, plus bare ``claude-<tier>`` -> newest of the tier."""
    r = _ranked(catalog, id_col, pos_col).where(F.col("tier") != "opus")
    # one pass: every model counts for its major and for its whole tier
    scopes = F.array(F.concat(F.lit("claude-"), F.col("tier"), F.lit("-"), F.col("major").cast("string")),
                     F.concat(F.lit("claude-"), F.col("tier")))
    return (r.select("id", "_key", F.explode(scopes).alias("alias"))
            .groupBy("alias").agg(F.max_by("id", "_key").alias("model_id")))


def policy_from_catalog(catalog: DataFrame, base: ModelPolicy | None = None,
                        update_opus: bool = True, update_no_opus_target: bool = True,
                        id_col: str = "id", pos_col: str | None = "pos") -> ModelPolicy:
    """Apply discovery to a policy (the gateway's startup step).

    The collected result has at most one row per tier plus one per
    (tier, major): a handful of rows whatever the catalog size.
    """
    base = base or ModelPolicy()
    latest = {r["tier"]: r["model_id"] for r in latest_per_tier(catalog, id_col, pos_col).collect()}
    fam = {r["alias"]: r["model_id"] for r in family_map(catalog, id_col, pos_col).collect()}
    family = fam if fam else dict(base.family_map)
    return ModelPolicy(
        opus_model=latest.get("opus", base.opus_model) if update_opus else base.opus_model,
        no_opus=base.no_opus,
        no_opus_target=(latest.get("sonnet", base.no_opus_target)
                        if update_no_opus_target else base.no_opus_target),
        family_map=family,
        static_map=dict(base.static_map),
        upstream_base_url=base.upstream_base_url,
    )


def observed_catalog(requests: DataFrame) -> DataFrame:
    """Catalog of the upstream models seen in the fact table; ``pos`` is the
    time of first use (microseconds), so earlier models count as listed first."""
    return (requests.where(F.col("upstream_model").isNotNull())
            .groupBy(F.col("upstream_model").alias("id"))
            .agg(F.min("ts").alias("_first"))
            .select("id", F.unix_micros(F.col("_first").cast("timestamp")).alias("pos")))
