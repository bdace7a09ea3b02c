"""Names, seeds, fingerprints and rules: the bookkeeping of experiments as Column expressions and rule tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The largest seed plus one, and the texts before the seeds that derivations hash; other texts make other series.
SEEDS = 2147483647
PAIR_TEXT, BACKGROUND_TEXT = "seeds-v1:", "background-seed-v1:"


def slug(name: Column, longest: int = 48) -> Column:
    """Lower case, runs of other than letters and digits become one dash, none at the ends; empty for nothing."""
    dashed = F.regexp_replace(F.lower(F.trim(name)), "[^a-z0-9]+", "-")
    return F.rtrim(F.substring(F.btrim(dashed, F.lit("-")), 1, longest), F.lit("-"))


def run_label(name: Column, longest: int = 24) -> Column:
    """Words of letters and digits joined by dashes; "experiment" when there are none."""
    words = F.array_remove(F.split(F.lower(F.regexp_replace(name, r"[^\p{L}\p{N}]", " ")), " +"), "")
    joined = F.array_join(words, "-")
    return F.rtrim(F.substring(F.when(joined == "", F.lit("experiment")).otherwise(joined), 1, longest), F.lit("-"))


def digest_number(text: Column, start: int = 1) -> Column:
    """Sixteen hex digits of the text's SHA-256, from ``start``, as a number modulo SEEDS."""
    number = F.conv(F.substring(F.sha2(text.cast("binary"), 256), start, 16), 16, 10).cast("decimal(20,0)")
    return (number % F.lit(SEEDS).cast("decimal(20,0)")).cast("long")


def next_seeds(static: Column, dynamics: Column, text: str = PAIR_TEXT) -> tuple[Column, Column]:
    """The next pair of seeds, never equal."""
    payload = F.concat(F.lit(text), static.cast("string"), F.lit(":"), dynamics.cast("string"))
    first, second = digest_number(payload), digest_number(payload, 17)
    return first, F.when(first == second, (second + 1) % SEEDS).otherwise(second)


def next_background_seed(seed: Column, text: str = BACKGROUND_TEXT) -> Column:
    made = digest_number(F.concat(F.lit(text), seed.cast("string")))
    return F.when(made == seed, (made + 1) % SEEDS).otherwise(made)


def fingerprint(*columns: Column) -> Column:
    """Upper-case SHA-256 of the columns' texts joined by "|"; null counts as "null"."""
    return F.upper(F.sha2(F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("null")) for c in columns]).cast("binary"), 256))


def canonical_json(df: DataFrame, columns: list[str] | None = None) -> Column:
    """The columns as JSON with sorted keys."""
    return F.to_json(F.struct(*sorted(columns or df.columns)))


def array_digest(values: Column, kind: str, shape: str) -> Column:
    """Digest of a kind, a shape and bytes, so arrays of equal bytes but other shapes differ."""
    return F.upper(F.sha2(F.concat(F.lit(kind).cast("binary"), F.lit(shape).cast("binary"), values), 256))


def violations(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(key, rule) for every rule that does not hold, unknown counting as broken."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()]))
    return df.select(key, F.explode(broken).alias("rule"))


def key_differences(present: Column, required: list[str]) -> tuple[Column, Column]:
    """Missing and unknown names of an array of names, sorted."""
    wanted = F.array(*[F.lit(r) for r in required])
    return F.array_sort(F.array_except(wanted, present)), F.array_sort(F.array_except(present, wanted))


def histogram(df: DataFrame, by: list[str], value: str, low: float, high: float, bins: int) -> DataFrame:
    """Counts by bin of equal width; the last bin holds its upper edge."""
    at = F.least(F.floor((F.col(value) - low) / ((high - low) / bins)), F.lit(bins - 1)).cast("long")
    return df.filter(F.col(value).between(low, high)).groupBy(*by, at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def latest(df: DataFrame, by: list[str], at: str) -> DataFrame:
    """The last version of each row: the upsert of a log."""
    return df.groupBy(*by).agg(F.max_by(F.struct(*[c for c in df.columns if c not in by]), F.col(at)).alias("r")).select(*by, "r.*")


def finite(value: Column, name: str) -> Column:
    """``value`` as a double; a row where it is null or not finite fails the query, by ``name``."""
    c = value.cast("double")
    good = c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return F.when(good, c).otherwise(F.raise_error(F.lit(f"{name} must be finite")).cast("double"))
