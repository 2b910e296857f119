"""Problem 5: the best representative of each group of duplicate records.

Method: skyline selection. Records are compared by trust (origin, then confidence), agreement, completeness and age in
days. Records equal in all four are first merged into cells by a partial aggregate, so a group with any share of all rows
shrinks to its distinct combinations before it is put together: agreement counts of one group add up to at most its rows,
so it has at most about sqrt(2 rows) of them per trust tier, completeness and day. Over the sorted cells of a group, each
cell's dominance layer is one more than the deepest layer that dominates it; equal records are in one layer. The
lexicographic policy picks within layer one, and empty fields are filled from the first later layer that has them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Order of preference of origins and confidences.
ORIGINS = ["user", "publisher", "paper", "openalex", "library_metadata", "citing_bibliography"]
CONFIDENCES = ["explicit", "heuristic", "model"]
FILLED = ["source_record_id", "entry_id", "locator"]
#: The day of claims without a time: after all others.
LAST_DAY = 2**31 - 1


def rank_of(name: str, order: list[str]) -> Column:
    """Place of a value in the order, from 0; unknown and null values come last."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col(name))
    return F.when(place > 0, place - 1).otherwise(F.lit(len(order))).cast("int")


def readable(field: Column, kind: Column, value: Column) -> Column:
    """Whether a claim's JSON value has the type its field needs; kind is schema_of_variant of the parsed value."""
    names = F.from_json(value, "array<string>")
    text = F.trim(F.regexp_replace(F.from_json(F.concat(F.lit("["), value, F.lit("]")), "array<string>")[0], r"[\s ]+", " "))
    return F.coalesce(
        F.when(field.isin("title", "venue"), (kind == "STRING") & (text != ""))
        .when(field == "year", (kind == "BIGINT") | kind.rlike(r"^DECIMAL\(\d+,0\)$") & ~value.rlike(r"[.eE]"))
        .when(field == "author", (kind == "ARRAY<STRING>") & (F.size(names) > 0) & ~F.exists(names, lambda x: x.isNull()))
        .otherwise(F.lit(False)),
        F.lit(False),
    )


def eligible(claims: DataFrame) -> DataFrame:
    """Claims that may survive, with trust, agreement key and completeness.

    Not eligible: rejected, retracted, null or unreadable values, null work_id or field. A null origin or confidence ranks last;
    a null review_state isn't a rejection.
    """
    kept = claims.where("work_id is not null and field is not null and id is not null and retracted_at is null and coalesce(review_state, '') <> 'rejected' and value is not null")
    kept = kept.withColumn("_kind", F.expr("schema_of_variant(try_parse_json(value))"))
    kept = kept.where(readable(F.col("field"), F.col("_kind"), F.col("value")))
    names = F.from_json("value", "array<string>")
    plain = lambda x: F.regexp_replace(F.lower(x), r"[^\p{L}\p{N}]", "")
    cut_list = F.lower(F.trim(F.element_at(names, -1))).isin("et al", "et al.")
    one = F.from_json(F.concat(F.lit("["), F.col("value"), F.lit("]")), "array<string>")[0]
    return kept.select(
        "work_id", "field", "id", "created_at", *FILLED, "value",
        (rank_of("origin", ORIGINS) * (len(CONFIDENCES) + 1) + rank_of("confidence", CONFIDENCES)).alias("tier"),
        F.when(F.col("field") == "author", F.array_join(F.transform(names, plain), "\u0001")).when(F.col("field") == "year", F.trim("value")).otherwise(plain(one)).alias("agree"),
        F.when(F.col("field") == "author", F.when(cut_list, F.lit(-1)).otherwise(F.size(names))).otherwise(F.lit(0)).alias("complete"),
    )


def cells(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row per group, tier, agreement count, completeness and day, with its oldest claim and its oldest filled values."""
    rows = rows.withColumn("day", F.coalesce(F.unix_date(F.to_date("created_at")), F.lit(LAST_DAY)))
    best = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct(F.col("created_at"), F.col("id"), F.col(c).alias("v")))).alias(f"_{c}")
    merged = rows.groupBy(*keys, "tier", "agree", "complete", "day").agg(F.count("*").alias("n"), F.min(F.struct(F.col("created_at").isNull().alias("undated"), "created_at", "id", "value")).alias("first"), *map(best, FILLED))
    count = merged.groupBy(*keys, "tier", "agree").agg(F.sum("n").alias("support"))
    merged = merged.join(count, [*keys, "tier", "agree"])
    return merged.groupBy(*keys, "tier", "support", "complete", "day").agg(F.min("first").alias("first"), *(F.min(f"_{c}").alias(f"_{c}") for c in FILLED))


def layered(cell: DataFrame, keys: list[str]) -> DataFrame:
    """One row per group with its cells in policy order, each with its dominance layer (1: nothing dominates it)."""
    facts = F.struct(
        F.col("tier"), (-F.col("support")).alias("s"), (-F.col("complete")).alias("c"), F.col("day").alias("t"), F.col("first.created_at").alias("at"), F.col("first.id").alias("id"),
        F.col("first.value").alias("value"), *(F.col(f"_{c}.v").alias(c) for c in FILLED),
    )
    rows = cell.groupBy(*keys).agg(F.array_sort(F.collect_list(facts)).alias("cell"))

    def step(done: Column, x: Column) -> Column:
        above = F.filter(done, lambda d: (d["x"]["tier"] <= x["tier"]) & (d["x"]["s"] <= x["s"]) & (d["x"]["c"] <= x["c"]) & (d["x"]["t"] <= x["t"]))
        layer = F.coalesce(F.array_max(F.transform(above, lambda d: d["layer"])), F.lit(0)) + 1
        return F.concat(done, F.array(F.struct(layer.alias("layer"), x.alias("x"))))

    kind = rows.schema["cell"].dataType.elementType.simpleString()
    empty = F.expr(f"cast(array() as array<struct<layer:int,x:{kind}>>)")
    return rows.withColumn("cell", F.when(F.size("cell") == 1, F.transform("cell", lambda x: F.struct(F.lit(1).alias("layer"), x.alias("x")))).otherwise(F.aggregate("cell", empty, step)))


def survivors(claims: DataFrame) -> DataFrame:
    """claims(field_claim) -> (work_id, field, claim_id, value, filled columns, layers), one row per group with an eligible claim.

    The surviving claim is the first of layer one in policy order; a null among source_record_id, entry_id and locator is
    filled from the lowest layer whose claims have it, in policy order within the layer. A null created_at is the latest.
    """
    keys = ["work_id", "field"]
    rows = layered(cells(eligible(claims), keys), keys)
    top = F.element_at(F.filter("cell", lambda c: c["layer"] == 1), 1)["x"]

    def fill(c: str) -> Column:
        having = F.filter("cell", lambda d: d["x"][c].isNotNull())
        low = F.array_min(F.transform(having, lambda d: d["layer"]))
        later = F.get(F.filter(having, lambda d: d["layer"] == low), F.lit(0))["x"][c]
        return F.coalesce(top[c], later).alias(c)

    return rows.select(*keys, top["id"].alias("claim_id"), top["value"].alias("value"), *map(fill, FILLED), F.array_max(F.transform("cell", lambda d: d["layer"])).alias("layers"))
