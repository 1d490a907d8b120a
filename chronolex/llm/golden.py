"""One record per cluster of client records: candidates by source, freshness, trust ladder.

A single conditional aggregation pivots a cluster by the trust of its sources
and keeps, for every field and level, the latest candidate that has a value. A
level's latest candidate is fresh if any of the level is, so testing that one
against the cluster's latest time decides for all; the fields are then read
down the ladder, fresh levels before stale ones.

Rows are combined by (cluster, segment) before they are combined by cluster,
both times in the tasks that read them first, so a cluster of any size sends a
row per task and segment. Stale records are counted per (cluster, time), and
those counts meet the cluster's latest time dealt to SALTS parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LADDER = ("store", "crm", "partner", "web")
"""Sources by falling trust. Every other source, null too, stands below the last of them."""

FRESH_DAYS = 10
SALTS = 64
BLANK = r"^[\x20\x09-\x0D]*$"


def _filled(column: str) -> Column:
    """A string, or null where it is empty or blank."""
    return F.when(~F.col(column).rlike(BLANK), F.col(column))


def records(clients: DataFrame) -> DataFrame:
    """Client rows as they compete: cluster, trust (higher is better), blank strings and balances that are no number as null."""
    trust = F.lit(0)
    for k, source in enumerate(LADDER):
        trust = F.when(F.col("source") == source, len(LADDER) - k).otherwise(trust)
    balance = F.col("balance").cast("double")
    return clients.select(
        F.coalesce("master_id", "client_id").alias("cluster_id"), "client_id", trust.alias("trust"), "updated_at", "nation_id",
        *[_filled(c).alias(c) for c in ("name", "email", "segment", "city")],
        F.when(~F.isnan(balance) & (F.abs(balance) < float("inf")), balance).alias("balance"),
    )


def _candidates() -> dict[str, Column]:
    """For each field the struct whose greatest value is its best candidate of one level: what counts first, then the latest, the smallest id, the greatest value."""
    recent = [F.col("updated_at"), F.col("trust"), F.bitwise_not("client_id").alias("earliest")]
    filled = F.col("city").isNotNull().cast("int") + F.col("nation_id").isNotNull().cast("int")
    plain = lambda c: F.when(F.col(c).isNotNull(), F.struct(*recent, F.col(c).alias("value"), "client_id"))
    return {
        "name": F.when(F.col("name").isNotNull(), F.struct(F.char_length("name").alias("size"), *recent, F.col("name").alias("value"), "client_id")),
        "email": plain("email"),
        "segment": plain("segment"),
        "balance": plain("balance"),
        "address": F.struct(filled.alias("filled"), *recent, "city", "nation_id", "client_id"),
    }


LEVELS = range(len(LADDER), -1, -1)


def _column(field: str, level: int) -> str:
    return f"{field}_{level}"


def _too_old(at: Column, latest: Column) -> Column:
    return latest - at > F.make_dt_interval(F.lit(FRESH_DAYS))


def stale_counts(rows: DataFrame) -> DataFrame:
    """(cluster_id, n_stale) by salt: dated records that are too old beside their cluster's latest. A cluster may have several rows, or none."""
    times = rows.filter(F.col("updated_at").isNotNull()).groupBy("cluster_id", "updated_at").agg(F.count("*").alias("n")).withColumn("salt", F.pmod(F.xxhash64("updated_at"), F.lit(SALTS)).cast("int"))
    parts = times.groupBy("cluster_id", "salt").agg(F.max("updated_at").alias("latest"))
    # a cluster has as many copies of its latest time as parts with records
    latest = parts.groupBy("cluster_id").agg(F.max("latest").alias("latest"), F.collect_set("salt").alias("salts")).select(F.col("cluster_id").alias("_cluster"), "latest", F.explode("salts").alias("_salt"))
    met = times.join(latest, F.col("cluster_id").eqNullSafe(F.col("_cluster")) & (F.col("salt") == F.col("_salt")))
    return met.filter(_too_old(F.col("updated_at"), F.col("latest"))).groupBy("cluster_id", "salt").agg(F.sum("n").alias("n_stale")).drop("salt")


def pivot(rows: DataFrame) -> DataFrame:
    """(cluster_id, latest, n_records, n_stale, <field>_<level>..., chosen): the best candidates of each trust level.

    ``chosen`` is the latest segment together with the latest balance among the
    records that have this very segment. The counts of stale records join the
    candidates by the sum that combines a cluster's segments.
    """
    best = {_column(f, k): F.max(F.when(F.col("trust") == k, c)) for f, c in _candidates().items() for k in LEVELS}
    by_segment = rows.groupBy("cluster_id", "segment").agg(F.max("updated_at").alias("latest"), F.count("*").alias("n_records"), F.count_if(F.col("updated_at").isNull()).alias("n_stale"), *[c.alias(n) for n, c in best.items()])
    of_field = lambda f: F.greatest(*[F.col(_column(f, k)) for k in LEVELS])
    with_own = by_segment.withColumn("chosen", F.when(F.col("segment").isNotNull(), F.struct(of_field("segment").alias("latest"), of_field("balance").alias("own"))))
    both = with_own.drop("segment").unionByName(stale_counts(rows), allowMissingColumns=True)
    return both.groupBy("cluster_id").agg(F.max("latest").alias("latest"), F.sum("n_records").alias("n_records"), F.sum("n_stale").alias("n_stale"), *[F.max(n).alias(n) for n in best], F.max("chosen").alias("chosen"))


def _down_the_ladder(field: str) -> Column:
    """The candidate of the most trusted fresh level, else of the most trusted stale one."""
    each = [F.col(_column(field, k)) for k in LEVELS]
    fresh = [F.when(c["updated_at"].isNotNull() & ~_too_old(c["updated_at"], F.col("latest")), c) for c in each]
    return F.coalesce(*fresh, *each)


def _longest_name() -> Column:
    """Down the ladder of those levels whose best name is as long as the cluster's longest."""
    each = [F.col(_column("name", k)) for k in LEVELS]
    most = F.greatest(*[c["size"] for c in each])
    long = [F.when(c["size"] == most, c) for c in each]
    fresh = [F.when(c["updated_at"].isNotNull() & ~_too_old(c["updated_at"], F.col("latest")), c) for c in long]
    return F.coalesce(*fresh, *long)


def golden(clients: DataFrame) -> DataFrame:
    """(cluster_id, n_records, n_stale, name, email, segment, city, nation_id, balance_cents, <field>_from).

    * Nulls: rows with neither master_id nor client_id form the cluster null; a null source is the least trusted; a null time
      is stale and the last of all times. Balances that are NaN or infinite count as null, as they have no cents.
    * Ties: records that agree on all that the order names (a client_id that repeats) give the greatest value.
    * Repeated rows count as often as they occur; empty strings count as null, very long ones are values like others;
      an empty table gives no rows; further columns are not read.
    """
    one = pivot(records(clients))
    of_all = lambda f: F.greatest(*[F.col(_column(f, k)) for k in LEVELS])
    picked = one.select(
        "cluster_id", "n_records", "n_stale", _longest_name().alias("name"), _down_the_ladder("email").alias("email"), of_all("segment").alias("segment"),
        F.coalesce(F.col("chosen")["own"], of_all("balance")).alias("balance"), of_all("address").alias("address"),
    )
    return picked.select(
        "cluster_id", "n_records", "n_stale", F.col("name.value").alias("name"), F.col("email.value").alias("email"), F.col("segment.value").alias("segment"), "address.city", "address.nation_id",
        F.floor(100 * F.col("balance.value") + 0.5).alias("balance_cents"),
        *[F.col(f"{c}.client_id").alias(f"{c}_from") for c in ("name", "email", "segment", "balance")],
        F.when(F.col("address.filled") > 0, F.col("address.client_id")).alias("address_from"),
    )
