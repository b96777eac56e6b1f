"""Users: normal form, audits, and the locations each of them sees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.functions.values import authorized_of, role_of, stripped, username_key


#: Copies of the locations that master accounts are joined with, so that they don't meet in one task.
MASTER_PARTS = 64


def normalized(users: DataFrame) -> DataFrame:
    """username, role and authorized_locations in their normal form; nobody without a name."""
    out = users.select(stripped(F.col("username")).alias("username"), role_of(F.col("role")).alias("role"), "authorized_locations").filter(F.col("username") != "")
    return out.withColumn("authorized_locations", authorized_of(F.col("role"), F.col("authorized_locations")))


def duplicate_usernames(users: DataFrame) -> DataFrame:
    """Names that stand for more than one record, and how many."""
    return users.groupBy(username_key(F.col("username")).alias("username_key")).agg(F.count(F.lit(1)).alias("records")).filter(F.col("records") > 1)


def audit(users: DataFrame) -> DataFrame:
    """username, passed, reason, account_type; the first rule that a record breaks is the reason."""
    role, ids = F.col("role"), F.col("authorized_locations")
    # fixed values: the rules' texts
    rules = [
        (stripped(F.coalesce("username", F.lit(""))) == "", "Username is empty."),
        (~F.coalesce(role.isin("master", "staff"), F.lit(False)), "Role must be master or staff."),
        (ids.isNull(), "authorized_locations must be a list."),
        ((role == "master") & (ids != F.array(F.lit("*"))), "Master accounts must use authorized_locations ['*']."),
        ((role == "staff") & (F.size(ids) == 0), "Staff account has no authorized locations."),
        ((role == "staff") & F.array_contains(ids, "*"), "Wildcard '*' is only valid for master accounts."),
        (F.exists(ids, lambda x: x.isNull() | (stripped(x) == "")), "authorized_locations contains an invalid location id."),
        (~F.col("has_hash"), "Missing password_hash."),
        (~F.col("has_salt"), "Missing salt."),
        (~F.col("has_iterations"), "Missing iterations."),
    ]
    reason = F.lit("User record is valid.")
    for broken, text in reversed(rules):
        reason = F.when(broken, text).otherwise(reason)
    hashed = F.col("has_hash") & F.col("has_salt") & F.col("has_iterations")
    out = users.select("username", reason.alias("reason"), F.when(hashed, "hashed").otherwise("plaintext").alias("account_type"))
    return out.withColumn("passed", F.col("reason") == "User record is valid.")


#: Fixed value: the reason for a name that no record has.
NO_SUCH_NAME = "Username does not exist."


def audit_names(names: DataFrame, users: DataFrame) -> DataFrame:
    """username, passed, reason, account_type for each asked-for name (``username``): the audit of the first record (by ``seq``) of that name.

    A blank name fails as such; a name without a record has no account type. Asked-for names stay as they are, one row each.
    """
    asked = names.select(F.col("username").alias("__asked"), username_key(F.coalesce("username", F.lit(""))).alias("__key"))
    known = audit(first_of_name(users)).withColumn("__key", username_key(F.col("username"))).drop("username")
    blank = F.col("__key") == ""
    reason = F.when(blank, F.lit("Username is empty.")).when(F.col("reason").isNull(), NO_SUCH_NAME).otherwise(F.col("reason"))
    found = asked.join(known, "__key", "left").withColumn("reason", reason)
    return found.select(F.col("__asked").alias("username"), "reason", F.when(~blank, F.col("account_type")).alias("account_type"), (F.col("reason") == "User record is valid.").alias("passed"))


def visible_locations(users: DataFrame, locations: DataFrame) -> DataFrame:
    """username, location_id for every location a (normalised) user sees; unknown ids drop out.

    Masters see all: they are dealt out over ``MASTER_PARTS`` copies of the locations, the others are joined on the ids they list.
    """
    places = locations.select(F.col("id").alias("location_id"))
    listed = users.filter(F.col("role") != "master").select("username", F.explode(F.array_distinct("authorized_locations")).alias("location_id"))
    masters = users.filter(F.col("role") == "master").select("username", F.pmod(F.xxhash64("username"), F.lit(MASTER_PARTS)).alias("part"))
    everywhere = places.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(MASTER_PARTS - 1).cast("long"))))
    return listed.join(places, "location_id", "left_semi").select("username", "location_id").unionByName(masters.join(everywhere, "part").select("username", "location_id"))


def location_labels(users: DataFrame, locations: DataFrame) -> DataFrame:
    """username and the names of its locations, in the order they are listed."""
    names = locations.select(F.col("id").alias("location_id"), "name")
    listed = users.select("username", "role", F.posexplode_outer("authorized_locations").alias("pos", "location_id")).join(names, "location_id", "left")
    label = F.coalesce("name", F.concat(F.lit("Unknown location ("), "location_id", F.lit(")")))
    joined = listed.groupBy("username", "role").agg(F.array_sort(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", label.alias("label"))))).alias("own"))
    text = F.when(F.col("role") == "master", "All Locations").when(F.size("own") == 0, "None").otherwise(F.array_join("own.label", ", "))
    return joined.select("username", text.alias("label"))


def account_counts(users: DataFrame, locations: DataFrame) -> DataFrame:
    """Users, masters, staff and locations in one row."""
    counts = users.agg(F.count(F.lit(1)).alias("users"), F.count_if(F.col("role") == "master").alias("masters"), F.count_if(F.col("role") == "staff").alias("staff"))
    return counts.join(locations.agg(F.count(F.lit(1)).alias("locations")), F.lit(True))  # one row each


def first_of_name(users: DataFrame) -> DataFrame:
    """One record for each name, the first by ``seq``: the one that a look-up finds. Names combine before the shuffle."""
    first = users.groupBy(username_key(F.col("username")).alias("__key")).agg(F.min_by(F.struct(*users.columns), "seq").alias("__first"))
    return first.select("__first.*")
