"""Dictionary encoding: values to numbers, profiles to types, types to catalogues.

Input is a long table (entity, locus, value). A missing value has no row, or a
null or empty value; it never becomes a value of its own, and an entity without
some locus has no type. Numbers are exact distributed ranks, of one locus as of all profiles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from typeweave.operators.names import unused
from typeweave.operators.offsets import placed


def present(long: DataFrame) -> DataFrame:
    return long.where("entity IS NOT NULL AND locus IS NOT NULL AND value IS NOT NULL AND cast(value AS string) <> ''")


def numbered(df: DataFrame, key: str, out: str) -> DataFrame:
    """Numbers rows from 1 by a key of any ordered type that is unique; null keys have no place and are left out."""
    return placed(df.where(F.col(key).isNotNull()), [], [key], "_place").withColumn(out, F.col("_place") + 1).drop("_place")


def frequency_dictionary(long: DataFrame, first: str) -> DataFrame:
    """(locus, value, n, code): codes from 1 by falling frequency, ties by first appearance, then value."""
    counts = present(long).groupBy("locus", "value").agg(F.count(F.lit(1)).alias("n"), F.min(first).alias("first"))
    ranks = placed(counts, ["locus"], [F.desc("n"), F.col("first"), F.col("value")], "place")
    return ranks.select("locus", "value", "n", (F.col("place") + 1).cast("int").alias("code"))


def first_seen_dictionary(long: DataFrame, first: str) -> DataFrame:
    """(locus, value, code): codes from 1 by first appearance, then value."""
    seen = present(long).groupBy("locus", "value").agg(F.min(first).alias("first"))
    ranks = placed(seen, ["locus"], [F.col("first"), F.col("value")], "place")
    return ranks.select("locus", "value", (F.col("place") + 1).cast("int").alias("code"))


def profiles(long: DataFrame, loci: list[str], coded: str = "value") -> DataFrame:
    """(entity, profile): the values in the order of the loci, of entities that have them all."""
    rows = present(long).where(F.col("locus").isin(loci))
    cells = [F.max(F.when(F.col("locus") == l, F.col(coded))) for l in loci]
    return rows.groupBy("entity").agg(F.array(*cells).alias("profile")).where(F.forall("profile", lambda x: x.isNotNull()))


def complete_dictionary(long: DataFrame, loci: list[str]) -> DataFrame:
    """(locus, value, code): the first-seen dictionary over the entities that have all loci; what others alone have is no value."""
    whole = profiles(long, loci).select("entity")
    return first_seen_dictionary(long.where(F.col("locus").isin(loci)).join(whole, "entity", "left_semi"), "entity")


def missing_loci(entities: DataFrame, long: DataFrame, loci: list[str]) -> DataFrame:
    """(entity, missing): the loci that an entity has no value for, in the order in which they are given; entities that lack none have no row."""
    have = present(long).where(F.col("locus").isin(loci)).groupBy("entity").agg(F.collect_set("locus").alias("have"))  # at most all loci
    known = entities.select("entity").distinct().join(have, "entity", "left")
    every = F.array(*map(F.lit, loci)).cast("array<string>")
    lacking = F.filter(every, lambda l: F.col("have").isNull() | ~F.array_contains("have", l))
    return known.select("entity", lacking.alias("missing")).where(F.size("missing") > 0)


def sequence_types(entities: DataFrame, long: DataFrame, loci: list[str]) -> DataFrame:
    """(entity, st, is_novel, has_missing_data, missing_loci) of every entity; ids are of any ordered type.

    Types are numbered from 1 by the first entity, in order, that has the
    profile. A type is novel where one entity alone has it. Entities without
    some locus have null types and the names of those loci in the scheme's order;
    entities without any locus stay too.
    """
    of = profiles(long, loci)
    types = of.groupBy("profile").agg(F.min("entity").alias("first"), F.count(F.lit(1)).alias("members"))
    types = numbered(types, "first", "st").select("profile", F.col("st").cast("bigint").alias("st"), "members")
    return (
        entities.select("entity").distinct()
        .join(of.join(types, "profile").select("entity", "st", "members"), "entity", "left")
        .join(missing_loci(entities, long, loci), "entity", "left")
        .select(
            "entity", "st", F.when(F.col("st").isNotNull(), F.col("members") == 1).alias("is_novel"),
            F.col("missing").isNotNull().alias("has_missing_data"), F.coalesce(F.array_join("missing", ";"), F.lit("")).alias("missing_loci"),
        )
    )


def catalogue(members: DataFrame, top: int = 5) -> DataFrame:
    """Ordered catalogue of profiles: pst, profile, sizes, majority cluster, lineage, representatives.

    ``members`` has entity, profile, cluster (null outside the overlap), in_a,
    in_l (flags, null counts as no). Profiles are ordered by members in A, then in L,
    then size, all falling, then first entity. The cluster is the commonest, the
    least of those that tie.
    """
    flag = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    sizes = members.groupBy("profile").agg(
        F.count(F.lit(1)).alias("n_total"), F.count("cluster").alias("n_overlap"), flag(F.col("in_a")).alias("n_a"), flag(F.col("in_l")).alias("n_l"),
        F.min("entity").alias("first"),
    )
    votes = members.where("cluster IS NOT NULL").groupBy("profile", "cluster").agg(F.count(F.lit(1)).alias("k"))
    majority = votes.groupBy("profile").agg(F.min_by("cluster", F.struct(-F.col("k"), F.col("cluster"))).alias("cluster"))
    listed = smallest(members, "profile", "entity", top).withColumnRenamed("least", "reps")
    order = [F.desc("n_a"), F.desc("n_l"), F.desc("n_total"), F.col("first")]
    lineage = F.when((F.col("n_overlap") > 0) & (F.col("n_a") == F.col("n_overlap")), "A").when(F.col("n_l") > 0, "L").otherwise("")
    return (
        placed(sizes, [], order, "place").join(majority, "profile", "left").join(listed, "profile")
        .select((F.col("place") + 1).cast("int").alias("pst"), "profile", "n_total", "n_overlap", "cluster", lineage.alias("lineage"), "reps")
    )


def smallest(df: DataFrame, key: str, value: str, top: int) -> DataFrame:
    """(key, least): the ``top`` least values of each key, sorted; tasks cut their own part first, so no group is collected whole."""
    rank = lambda by: F.row_number().over(Window.partitionBy(*by).orderBy(value))
    salted = df.select(key, value).withColumn("_salt", F.pmod(F.xxhash64(value), F.lit(16)))
    few = salted.withColumn("_r", rank([key, "_salt"])).where(F.col("_r") <= top).drop("_r", "_salt")
    return few.withColumn("_r", rank([key])).where(F.col("_r") <= top).groupBy(key).agg(F.sort_array(F.collect_list(value)).alias("least"))


def prefixed(prefix: str, number: str) -> Column:
    """A label such as ``ST7`` from a number; null stays null."""
    return F.concat(F.lit(prefix), F.col(number).cast("string"))


def relabelled(rows: DataFrame, mapping: DataFrame, column: str) -> DataFrame:
    """``rows`` with the column's values replaced by those of ``mapping`` (local_label, label); what it lacks becomes null."""
    old, new = unused(rows.columns, "local_label", "label")
    found = rows.join(mapping.select(F.col("local_label").alias(old), F.col("label").alias(new)), F.col(column) == F.col(old), "left")
    return found.select(*(F.col(new).alias(c) if c == column else F.col(c) for c in rows.columns))


def remapped(local: DataFrame, catalogue_rows: DataFrame, checked: bool = True, separator: str = ";") -> DataFrame:
    """(local_label, label, conflict): local labels by the catalogue's through shared representatives.

    ``local`` is (entity, local_label), ``catalogue_rows`` (label, order_no, reps):
    reps is a list joined by the separator, in which empty entries and ``nan`` of any case count for nothing. A catalogue row whose representatives have
    exactly one local label maps it; with none it is skipped; with more it is a
    conflict, which raises an error if ``checked``. Later rows win over earlier.
    """
    names = F.filter(F.transform(F.split("reps", separator), lambda r: F.trim(r)), lambda r: (r != "") & (F.lower(r) != "nan"))
    found = (
        catalogue_rows.select("label", "order_no", F.explode(names).alias("entity"))
        .join(local.select(F.col("entity").cast("string").alias("entity"), "local_label"), "entity")
        .groupBy("label", "order_no").agg(F.count_distinct("local_label").alias("labels"), F.min("local_label").alias("local_label"))
    )
    conflict = F.col("labels") > 1
    if checked:
        conflict = F.when(conflict, F.raise_error(F.concat(F.lit("representatives of one type have several local labels: "), F.col("label").cast("string")))).otherwise(F.lit(False))
    return found.withColumn("conflict", conflict.cast("boolean")).groupBy("local_label").agg(F.max_by("label", "order_no").alias("label"), F.bool_or("conflict").alias("conflict"))
