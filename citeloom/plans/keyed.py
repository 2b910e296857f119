"""Lookups of rows by keys that come as a table: one semi join each, however many keys are asked for.

Each query is stated once, as the table it reads, the key, what is asked for and an order; the DataFrame and its SQL are
made from that statement.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.topk import ranked
from ..session import table
from .catalog import QUERIES, SQL


class Lookup(NamedTuple):
    name: str
    says: str
    source: str
    columns: list[str]
    key: str
    asked: str
    where: str = "true"
    order: list[str] = []  # noqa: RUF012  never changed


# asked is SQL over the tables that gives the wanted keys as k; it runs in Spark and in the oracle alike.
LOOKUPS = [
    Lookup("look_p07_version_identifiers", "Entries of asked versions, in printed order.", "bibliography_entry", ["id", "citing_version_id", "entry_key"], "citing_version_id", "select document_version_id as k from citation_mention where page > 3", "entry_key is not null", ["citing_version_id", "ordinal", "entry_key", "id"]),
    Lookup("look_p12_get", "Claims by id.", "field_claim", ["id", "work_id", "field", "value"], "id", "select min(id) as k from field_claim group by work_id"),
    Lookup("look_p15_entry", "Entries by id.", "bibliography_entry", ["id", "entry_key", "ordinal"], "id", "select entry_id as k from citation_mention where style = 'superscript'"),
    Lookup("look_p16_entries_for_record", "Entries of asked documents by ordinal and key.", "bibliography_entry", ["id", "citing_version_id", "ordinal"], "citing_version_id", "select max(citing_version_id) as k from bibliography_entry group by ordinal", "true", ["citing_version_id", "ordinal", "entry_key", "id"]),
    Lookup("look_p18_accepted_resolution", "Accepted claims of asked entries.", "field_claim", ["id", "entry_id", "work_id"], "entry_id", "select id as k from bibliography_entry where page % 2 = 0", "review_state = 'accepted' and retracted_at is null"),
    Lookup("look_p21_states_of_works", "Identifiers of asked works with their state.", "work_identifier", ["id", "work_id", "scheme", "status"], "work_id", "select id as k from graph_work where display_year < 1990"),
    Lookup("look_p24_rows_for", "Ledger rows of asked customers.", "orders", ["o_orderkey", "o_custkey", "o_orderstatus"], "o_custkey", "select c_custkey as k from customer where c_acctbal < 0"),
    Lookup("look_p27_payload", "Payloads by key, none for an unknown one.", "documents", ["doc_id", "source", "n_chars"], "doc_id", "select doc_id * 3 as k from documents", "text is not null"),
    Lookup("look_p31_version_for_sha", "Mentions of asked passages, by the passage itself.", "citation_mention", ["id", "document_version_id", "page"], "passage", "select passage as k from citation_mention group by passage having count(*) > 1"),
    Lookup("look_p33_local_documents_for_works", "Present documents of asked works.", "orders", ["o_orderkey", "o_orderdate"], "o_orderkey", "select p_partkey as k from part where p_size < 20", "o_orderstatus = 'F'"),
    Lookup("look_p36_get_tag", "Parts of asked brands.", "part", ["p_partkey", "p_brand"], "p_brand", "select max(p_brand) as k from part group by p_size"),
    Lookup("look_p37_marks_for_works", "Marks of a list of works.", "field_claim", ["id", "work_id", "review_state"], "work_id", "select work_id as k from work_identifier where scheme = 'doi'", "review_state is not null"),
    Lookup("look_p40_items", "Items of asked lists by position.", "lineitem", ["l_orderkey", "l_linenumber", "l_partkey"], "l_orderkey", "select o_orderkey as k from orders where o_totalprice > 200000", "true", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]),
    Lookup("look_p41_item", "Single items by list and number.", "lineitem", ["l_orderkey", "l_partkey", "l_quantity"], "l_orderkey", "select max(o_orderkey) as k from orders group by o_custkey", "l_linenumber = 1"),
    Lookup("look_p49_held_papers", "Works that a provider's record holds under the same title, with their titles.", "graph_work", ["id", "display_title"], "display_title", "select title as k from openalex_work where title is not null"),
]


def _register(q: Lookup) -> None:
    shown = [*q.columns, *([f"row_number() over (order by {', '.join(q.order)}) as place"] if q.order else [])]
    SQL[q.name] = f"select {', '.join(shown)} from {q.source} where {q.key} in (select k from ({q.asked}) where k is not null) and ({q.where})"

    def run(spark: SparkSession, d: str) -> DataFrame:
        keys = _asked(spark, d, q.asked).where("k is not null").withColumnRenamed("k", q.key)
        rows = table(spark, d, q.source).where(q.where).join(keys, q.key, "left_semi")
        if q.order:
            return ranked(rows.select(*dict.fromkeys([*q.columns, *q.order])), [], q.order, "place").select(*q.columns, "place")
        return rows.select(*q.columns)

    run.__name__, run.__doc__ = q.name, q.says
    QUERIES[q.name] = run


def _asked(spark: SparkSession, d: str, sql: str) -> DataFrame:
    """The keys asked for; the one table that the statement reads is given by name."""
    import re

    name = re.search(r"from (\w+)", sql)[1]
    return spark.sql(sql.replace(f"from {name}", "from {source}"), source=table(spark, d, name)).select(F.col("k"))


for _q in LOOKUPS:
    _register(_q)
