"""Which claim of a work's field is shown, and how the other claims of the field relate to it.

Agreement isn't an equivalence: a cut author list agrees with every list it is the start of. Support is counted over keys
and the prefixes of author lists, so no claim of a group meets all others.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bibliography import author_list_key
from ..functions.titlekey import key_of

# Order of preference.
ORIGINS = ["user", "publisher", "paper", "openalex", "library_metadata", "citing_bibliography"]
CONFIDENCES = ["explicit", "heuristic", "model"]
KEYS = ["work_id", "field"]


def place(name: str, order: list[str]) -> Column:
    """Place in the order from 0; unknown and null values come last."""
    at = F.array_position(F.array(*map(F.lit, order)), F.col(name))
    return F.when(at > 0, at - 1).otherwise(F.lit(len(order))).cast("int")


def _readable(kind: Column) -> Column:
    value, field = F.col("value"), F.col("field")
    names = F.from_json(value, "array<string>")
    text = F.from_json(F.concat(F.lit("["), value, F.lit("]")), "array<string>")[0]
    ok = F.when(field.isin("title", "venue"), (kind == "STRING") & (F.trim(text) != "")).when(field == "year", kind == "BIGINT").when(field == "author", (kind == "ARRAY<STRING>") & (F.size(names) > 0) & ~F.exists(names, lambda x: x.isNull()))
    return F.coalesce(ok, F.lit(False))


def judged(claims: DataFrame) -> DataFrame:
    """Claims with reason (why one can't be selected, the first of rejected, retracted, unreadable; else null), tier, key array, cut and complete.

    key is the families of an author list in order, else the one key of the value; an empty key agrees with nothing. Null
    origins and confidences rank last; claims without work, field or id are left out.
    """
    rows = claims.where("work_id is not null and field is not null and id is not null")
    rows = rows.withColumn("_kind", F.expr("schema_of_variant(try_parse_json(value))"))
    readable = _readable(F.col("_kind"))
    rows = rows.withColumn("reason", F.when(F.col("review_state") == "rejected", "rejected").when(F.col("retracted_at").isNotNull(), "retracted").when(~readable, "unreadable")).drop("_kind")
    rows = rows.withColumn("tier", place("origin", ORIGINS) * (len(CONFIDENCES) + 1) + place("confidence", CONFIDENCES))
    text = F.from_json(F.concat(F.lit("["), "value", F.lit("]")), "array<string>")[0]
    lists = F.when((F.col("field") == "author") & F.col("reason").isNull(), F.from_json("value", "array<string>"))

    @F.pandas_udf("families array<string>, cut boolean")
    def families(names: pd.Series) -> pd.DataFrame:
        found = [([], False) if n is None else author_list_key(n) for n in names]
        return pd.DataFrame({"families": [k for k, _ in found], "cut": [c for _, c in found]})

    rows = rows.withColumn("_a", families(lists))
    one = F.when(F.col("field") == "year", F.trim("value")).otherwise(key_of(text))
    key = F.when(F.col("reason").isNotNull(), F.expr("cast(array() as array<string>)")).when(F.col("field") == "author", F.col("_a.families")).otherwise(F.filter(F.array(one), lambda x: x != ""))
    complete = F.when(F.col("field") != "author", 0).when(F.col("_a.cut"), -1).otherwise(F.size("_a.families"))
    return rows.withColumns({"key": key, "cut": F.col("_a.cut"), "complete": complete}).drop("_a")


def agree(a: str, b: str, field: Column) -> Column:
    """Whether two judged claims say the same: columns a.key, a.cut, b.key, b.cut."""
    x, y = F.col(f"{a}key"), F.col(f"{b}key")
    starts = lambda p, q: F.slice(q, F.lit(1), F.greatest(F.size(p), F.lit(1))) == p
    cut = (field == "author") & ((F.col(f"{a}cut") & starts(x, y)) | (F.col(f"{b}cut") & starts(y, x)))
    return F.coalesce((F.size(x) > 0) & (F.size(y) > 0) & ((x == y) | cut), F.lit(False))


def supported(rows: DataFrame) -> DataFrame:
    """Distinct values of the best tier of each field with support, the number of claims that agree, and size, the number of claims of the tier."""
    top = rows.groupBy(*KEYS).agg(F.min("tier").alias("tier"))
    value = rows.groupBy(*KEYS, "tier", "key", "cut").agg(F.count("*").alias("n")).join(top, [*KEYS, "tier"]).drop("tier")
    size = value.groupBy(*KEYS).agg(F.sum("n").alias("size"))
    same = value.groupBy(*KEYS, "key").agg(F.sum("n").alias("same"), F.sum(F.when(F.col("cut"), F.col("n")).otherwise(0)).alias("cuts"))
    prefix = value.where("field = 'author' and size(key) > 1").select(*KEYS, "key", "cut", "n", F.explode(F.transform(F.sequence(F.lit(1), F.size("key") - 1), lambda k: F.slice("key", 1, k))).alias("head"))
    longer = prefix.groupBy(*KEYS, F.col("head").alias("key")).agg(F.sum("n").alias("longer"))
    shorter = prefix.select(*KEYS, F.col("key").alias("full"), F.col("head").alias("key")).distinct().join(same.where("cuts > 0"), [*KEYS, "key"]).groupBy(*KEYS, F.col("full").alias("key")).agg(F.sum("cuts").alias("shorter"))
    out = value.join(same, [*KEYS, "key"]).join(longer, [*KEYS, "key"], "left").join(shorter, [*KEYS, "key"], "left").join(size, KEYS)
    support = F.when(F.size("key") == 0, 1).otherwise(F.col("same") + F.coalesce("shorter", F.lit(0)) + F.when(F.col("cut"), F.coalesce("longer", F.lit(0))).otherwise(0))
    return out.select(*KEYS, "key", "cut", support.alias("support"), "size")


def selected(claims: DataFrame) -> DataFrame:
    """claims(id, work_id, field, value, origin, confidence, review_state, retracted_at, created_at) -> one row per work and field with a claim.

    (work_id, field, claim_id, value, state, support): state is unknown without an eligible claim, conflicting if two
    claims of the best tier disagree, else known. Ties go to support, completeness, the oldest, the smallest id.
    """
    rows = judged(claims)
    fit = rows.where("reason is null")
    value = supported(fit)
    best = fit.join(value, [*KEYS, "key", "cut"])
    top = fit.groupBy(*KEYS).agg(F.min("tier").alias("tier"))
    best = best.join(top, [*KEYS, "tier"])
    order = F.struct((-F.col("support")).alias("s"), (-F.col("complete")).alias("c"), F.col("created_at").isNull().alias("u"), "created_at", "id")
    won = best.groupBy(*KEYS).agg(F.min_by(F.struct("id", "value", "support", "key", "cut"), order).alias("w"), F.max(F.col("support") < F.col("size")).alias("conflict"))
    every = rows.select(*KEYS).distinct().join(won, KEYS, "left")
    state = F.when(F.col("w").isNull(), "unknown").when(F.col("conflict"), "conflicting").otherwise("known")
    return every.select(*KEYS, F.col("w.id").alias("claim_id"), F.col("w.value").alias("value"), state.alias("state"), F.col("w.support").alias("support"), F.col("w.key").alias("won_key"), F.col("w.cut").alias("won_cut"))


def provenance(claims: DataFrame) -> DataFrame:
    """(work_id, field, id, relation): each claim is selected, agrees, disagrees, or excluded with its reason."""
    rows = judged(claims)
    both = rows.join(selected(claims), KEYS)
    relation = F.when(F.col("reason").isNotNull(), F.concat(F.lit("excluded:"), "reason")).when(F.col("id") == F.col("claim_id"), "selected").when(agree("won_", "", F.col("field")), "agrees").otherwise("disagrees")
    return both.select(*KEYS, "id", relation.alias("relation"))


def reselect(works: DataFrame, claims: DataFrame) -> DataFrame:
    """works(id, display_title, display_year, display_authors) -> (id, the three fields as selected, changed array of field names).

    A field without claims stays; one whose claims are all excluded becomes null.
    """
    won = selected(claims).where("field in ('title', 'year', 'author')").groupBy("work_id").agg(F.map_from_entries(F.collect_list(F.struct("field", F.struct("value", "state")))).alias("m"))
    rows = works.select("id", "display_title", "display_year", "display_authors").join(won, F.col("id") == F.col("work_id"), "left")
    got = lambda f: F.col("m")[f]["value"]
    has = lambda f: F.coalesce(F.map_contains_key("m", F.lit(f)), F.lit(False))
    text = F.from_json(F.concat(F.lit("["), got("title"), F.lit("]")), "array<string>")[0]
    new = {
        "display_title": F.when(has("title"), text).otherwise(F.col("display_title")), "display_year": F.when(has("year"), got("year").try_cast("int")).otherwise(F.col("display_year")),
        "display_authors": F.when(has("author"), F.from_json(got("author"), "array<string>")).otherwise(F.col("display_authors")),
    }
    changed = F.filter(F.array(*(F.when(~v.eqNullSafe(F.col(k)), F.lit(k)) for k, v in new.items())), lambda x: x.isNotNull())
    return rows.select("id", *(v.alias(k) for k, v in new.items()), changed.alias("changed"))


