"""Confidence rules: which channel a rule reads for an item, and the score it makes of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.columns import count_if, defined

# Level codes 1..28, canonical order and transitional levels.
LEVEL_OF_CODE = {
    **{i: f"C{i}" for i in range(1, 8)},
    **{i: f"T{i - 7}" for i in range(8, 20)},
    **{i: f"L{i - 19}" for i in range(20, 26)},
    26: "SACRUM",
    27: "COCCYX",
    28: "T13",
}
CANONICAL = [LEVEL_OF_CODE[i] for i in range(1, 25)] + ["SACRUM"]
UNKNOWN_ORDINAL = 999
# Channels for odd levels, even levels, sacrum, canal.
ODD, EVEN, SACRAL, CANAL = 6, 7, 8, 9

# Names of the rules.
RULES = [
    "region_retired",
    "parity_name",
    "parity_region_deployed",
    "parity_sequence",
    "parity_sequence_inverted",
    "parity_sequence_phased",
    "mapping_free_top1",
    "mapping_free_margin",
    "argmax_mean",
]


def literal_map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def level_name(code: Column) -> Column:
    return F.try_element_at(literal_map(LEVEL_OF_CODE), code.cast("int"))


def region_of_code(code: Column) -> Column:
    return (
        F.when(code.between(1, 7), "C")
        .when(code.between(8, 19) | (code == 28), "T")
        .when(code.between(20, 25), "L")
        .otherwise("S")
    )


def normalise_category(name: Column) -> Column:
    bare = F.upper(F.regexp_replace(F.trim(name), r"(?i)^vertebrae[_-]?", ""))
    return F.when(bare.rlike(r"^S") & ~bare.rlike(r"^S\d"), "SACRUM").otherwise(bare)


def ordinal(name: Column, order: list[str], strict: bool = False) -> Column:
    """0-based place in a fixed order; unknown names sort last, or fail when strict."""
    found = F.try_element_at(literal_map({n: i for i, n in enumerate(order)}), name)
    if strict:
        return F.coalesce(found, F.raise_error(F.concat(F.lit("no ordinal for "), name)).cast("int"))
    return F.coalesce(found, F.lit(UNKNOWN_ORDINAL))


def channel_by_region(name: Column) -> Column:
    lead = F.substring(name, 1, 1)
    return F.when(lead == "C", ODD).when(lead == "T", EVEN).when(lead == "L", SACRAL).otherwise(CANAL)


def channel_by_parity(name: Column, place: Column) -> Column:
    """Channel from the parity of a place; an unknown place leaves the rule undefined."""
    side = F.when(F.pmod(place, F.lit(2)) == 0, ODD).when(place.isNotNull(), EVEN)
    return F.when(name == "SACRUM", SACRAL).otherwise(side)


def channel_by_name(name: Column) -> Column:
    place = ordinal(name, CANONICAL)
    return channel_by_parity(name, F.when(place != UNKNOWN_ORDINAL, place))


def channel_by_number(name: Column) -> Column:
    number = F.try_to_number(F.regexp_extract(name, r"^[A-Z](\d+)$", 1), F.lit("9999999999"))
    side = F.when(F.pmod(number, F.lit(2)) == 1, ODD).when(number.isNotNull(), EVEN)
    return F.when(F.substring(name, 1, 1) == "S", SACRAL).otherwise(side)


def confidence(mean: Column, p95: Column, n_high: Column, n_cells: Column) -> Column:
    share = F.least(F.lit(1.0), F.coalesce(n_high, F.lit(0)) / F.greatest(F.lit(1), n_cells))
    return (
        F.lit(0.20) * F.coalesce(mean, F.lit(0.0))
        + F.lit(0.50) * F.coalesce(p95, F.lit(0.0))
        + F.lit(0.30) * share
    )


def pack_channels(channels: DataFrame, keys: list[str]) -> DataFrame:
    """One row per item with its channels as an array ordered by channel (a dozen entries)."""
    entry = F.struct("channel", "mean", "p95", "n_gt")
    return channels.groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias("channels"))


def channel_mean(channel: Column) -> Column:
    """Mean of one channel of the packed array, 0 where that channel is absent."""
    hit = F.get(F.filter("channels", lambda c: c["channel"] == channel), F.lit(0))
    return F.when(channel.isNotNull(), F.coalesce(hit["mean"], F.lit(0.0)))


def ranked_channels() -> Column:
    """Channels by falling mean, an undefined mean counting as 0; equal means keep the lower channel first."""
    flipped = F.transform(
        "channels", lambda c: F.struct((-F.coalesce(c["mean"], F.lit(0.0))).alias("down"), c["channel"].alias("channel"))
    )
    return F.array_sort(flipped)


def rule_columns(seq: str = "seq", phase: str = "phase") -> dict[str, tuple[str, Column]]:
    """The registry: a rule either names the channel it reads or gives its score outright."""
    name, place = F.col("category"), F.col(seq)
    order = ranked_channels()
    first, second = F.get(order, F.lit(0)), F.get(order, F.lit(1))
    return {
        "region_retired": ("channel", channel_by_region(name)),
        "parity_name": ("channel", channel_by_name(name)),
        "parity_region_deployed": ("channel", channel_by_number(name)),
        "parity_sequence": ("channel", channel_by_parity(name, place)),
        "parity_sequence_inverted": ("channel", channel_by_parity(name, place + 1)),
        "parity_sequence_phased": ("channel", channel_by_parity(name, place + F.col(phase))),
        "mapping_free_top1": ("score", -first["down"]),
        "mapping_free_margin": ("score", -first["down"] + F.coalesce(second["down"], F.lit(0.0))),
        "argmax_mean": ("channel", first["channel"]),
    }


def score_rules(items: DataFrame, rules: dict[str, tuple[str, Column]] | None = None, n_cells: str = "n_cells") -> DataFrame:
    """Long form: every item once per rule, score NULL where the rule is undefined.

    Rows are multiplied first, so the chosen channel is looked up once per item and rule.
    """
    rules = rules or rule_columns()
    none = {"channel": F.lit(None).cast("int"), "score": F.lit(None).cast("double")}

    def entry(name: str, kind: str, col: Column) -> Column:
        given = none | {kind: col.cast("int") if kind == "channel" else defined(col)}
        return F.struct(F.lit(name).alias("rule"), *[c.alias(f"__{k}") for k, c in given.items()])

    rest = [c for c in items.columns if c != "channels"]
    rows = items.withColumn("__r", F.explode(F.array(*[entry(n, k, c) for n, (k, c) in rules.items()])))
    rows = rows.select(*items.columns, "__r.*")
    rows = rows.withColumn("__hit", F.get(F.filter("channels", lambda c: c["channel"] == F.col("__channel")), F.lit(0)))
    hit = F.col("__hit")
    made = confidence(hit["mean"], hit["p95"], hit["n_gt"], F.greatest(F.lit(1), F.col(n_cells)))
    score = F.when(F.col("__channel").isNotNull(), defined(made)).otherwise(F.col("__score"))
    return rows.select(*rest, "rule", score.alias("score"))


def undefined_counts(scored: DataFrame, keys: list[str]) -> DataFrame:
    return scored.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), count_if(F.col("score").isNull()).alias("n_undefined")
    )


def phase_estimate(items: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """Offset 0 or 1 that puts more mean on the selected channels; a tie keeps 0; no labels used."""
    name, place = F.col("category"), F.col(seq)
    even = F.sum(channel_mean(channel_by_parity(name, place)))
    odd = F.sum(channel_mean(channel_by_parity(name, place + 1)))
    totals = items.groupBy(*keys).agg(even.alias("total_0"), odd.alias("total_1"))
    return totals.withColumn("phase", F.when(F.col("total_1") > F.col("total_0"), 1).otherwise(0))
