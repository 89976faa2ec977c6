"""Document sources, tables, maps and the streams that keep them."""

from __future__ import annotations

import json

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..checkpoints import fresh_path
from ..operators import lookup
from ..plans import Pipeline
from ..sources import tables
from ..sources.documents import read_documents, read_records, with_ids
from ..streaming import incremental
from . import query
from .common import PLAIN, ctes, table


@query("src_documents", "select doc_id, text, lang, source, n_chars from documents")
def src_documents(spark, sf):
    d, path = table(spark, sf, "documents"), fresh_path(spark, "source")
    d.write.json(path)
    return read_documents(spark, path, "json", extensions=[".json"], schema=d._jdf.schema().toDDL())


@query("src_walk", "select doc_id, text, source, n_chars from documents")
def src_walk(spark, sf):
    d, path = table(spark, sf, "documents"), fresh_path(spark, "source")
    d.write.partitionBy("lang").json(path)
    return read_documents(spark, path, "json", extensions=[".json"], recursive=True, schema="doc_id long, text string, source string, n_chars long")


@query("src_records", "select conv_id, turn, role, text from conversations")
def src_records(spark, sf):
    path = fresh_path(spark, "source")
    table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").write.json(path)
    return read_records(spark, path, lambda raw: (json.loads(line) for line in raw.splitlines()), "conv_id long, turn long, role string, text string", extensions=[".json"])


@query("src_with_ids", "select row_number() over (order by url) - 1 as id, page_id from pages")
def src_with_ids(spark, sf):
    return with_ids(table(spark, sf, "pages").select("page_id", "url"), "id", "url").select("id", "page_id")


_SPEC = {"schema": [["c_custkey", "INTEGER"], ["c_name", "TEXT"], ["c_acctbal", "REAL"], ["rating", "REAL"], ["note", "TEXT"]], "keys": ["c_custkey"]}


@query("table_evolved", "select c_custkey, c_name, c_acctbal, cast(null as double) as rating, cast(null as varchar) as note from customer")
def table_evolved(spark, sf):
    return tables.evolve(table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal"), tables.TableSpec.read("customer", _SPEC))


@query("table_created", "select c_custkey, c_name, c_acctbal, cast(null as double) as rating, cast(null as varchar) as note from customer")
def table_created(spark, sf):
    """Created from its specification, without two fields, which come when the specification has them."""
    name = "made_" + fresh_path(spark, "t").rsplit("-", 1)[1]
    first = tables.TableSpec.read(name, {**_SPEC, "schema": _SPEC["schema"][:3]})
    where = fresh_path(spark, "table")
    tables.create_all(spark, [first], path=where)
    table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal").write.insertInto(name)
    tables.create_table(spark, tables.TableSpec.read(name, _SPEC))
    return spark.table(name)


@query("map_substitute_keys", "select n_name as key, n_regionkey as value from nation")
def map_substitute_keys(spark, sf):
    n = table(spark, sf, "nation")
    return lookup.substitute_keys(n.select(F.col("n_nationkey").alias("key"), F.col("n_regionkey").alias("value")), n.select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("value")), check=True)


@query("map_compose", "select n_nationkey as key, r_name as value from nation join region on n_regionkey = r_regionkey")
def map_compose(spark, sf):
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    return lookup.compose_maps(n.select(F.col("n_nationkey").alias("key"), F.col("n_regionkey").alias("value")), r.select(F.col("r_regionkey").alias("key"), F.col("r_name").alias("value")))


@query("binary_search", """with l as (select c_nationkey as nation, c_acctbal as v, row_number() over (partition by c_nationkey order by c_acctbal, c_custkey) - 1 as place from customer)
select s_nationkey as nation, s_acctbal as x, (select min(place) from l where l.nation = s.s_nationkey and l.v >= s.s_acctbal) as place from supplier s""")
def binary_search(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("v"), "c_custkey")
    lists = c.withColumn("place", F.row_number().over(Window.partitionBy("nation").orderBy("v", "c_custkey")).cast("long") - 1)
    asked = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("x"))
    return lookup.first_reaching(lists, asked, "v", ["nation"], "place")


@query("stream_vocabulary", ctes() + "select cast(row_number() over (order by first) - 1 as bigint) as term_id, token from (select token, min(doc_id * 1000000 + pos) as first from t group by token)")
def stream_vocabulary(spark, sf):
    """Two runs of the stream, the second with the later half of the documents."""
    docs, root = table(spark, sf, "documents"), fresh_path(spark, "stream")
    middle = docs.agg(F.avg("doc_id")).first()[0]
    for half in ("doc_id <= {}", "doc_id > {}"):
        docs.where(half.format(middle or 0)).write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema(docs.schema).parquet(f"{root}/in")
        incremental.maintain_vocabulary(stream, Pipeline(PLAIN), f"{root}/state", f"{root}/checkpoint")
    return incremental.Versions(spark, f"{root}/state").latest().select("term_id", "token")


@query("stream_upsert", "select c_custkey, c_name, coalesce(m, c_acctbal) as c_acctbal from customer left join (select o_custkey, max(o_totalprice) as m from orders group by o_custkey) on o_custkey = c_custkey")
def stream_upsert(spark, sf):
    first, root = table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal"), fresh_path(spark, "stream")
    new = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("c_acctbal"))
    new.write.parquet(f"{root}/in")
    stream = spark.readStream.schema(new.schema).option("maxFilesPerTrigger", 2).parquet(f"{root}/in")
    incremental.maintain_table(stream, f"{root}/state", f"{root}/checkpoint", ["c_custkey"], first=first)
    return incremental.Versions(spark, f"{root}/state").latest()
