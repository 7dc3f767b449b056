"""Queries of sources, sinks and small operators over the given tables, each with its SQL."""

from __future__ import annotations

import datetime
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import vectors as V
from ..operators import decisions, encoders, integrity, lookups, metrics, retrieval
from ..sources import datasets, schemas, snapshots
from ..sources.shared import shared_folder
from ..sources.versions import VersionStore
from . import tables as T
from .queries import BOUNDS, SPLIT, M, _split, joined, micro
from .tables import with_tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _place(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


@query(
    with_tables("prepared", "customers", "catalog")
    + """ select 'purchases' as name, count(*) as n, count(distinct customer_id) as ids from prepared
union all select 'customers', count(*), count(distinct customer_id) from customers union all select 'models', count(*), count(distinct model) from catalog"""
)
def snapshot_tables(spark: SparkSession, d: str) -> DataFrame:
    """Two snapshots, of which the later one lacks purchases; the latest whole one is found, read and checked."""
    root, day = _place(spark), lambda n: datetime.datetime(2026, 1, n, tzinfo=datetime.timezone.utc)
    whole = {"purchases": T.prepared(spark, d), "customers": T.customers(spark, d), "models": T.catalog(spark, d)}
    snapshots.write_snapshot(whole, root, day(2), "star")
    snapshots.write_snapshot({"customers": whole["customers"]}, root, day(3), "star")
    ids = {"purchases": "customer_id", "customers": "customer_id", "models": "model"}
    got = snapshots.read_snapshot(spark, snapshots.latest_snapshot(spark, root), {n: [c] for n, c in ids.items()})
    parts = [schemas.require_columns(got[n], [c]).agg(F.lit(n).alias("name"), F.count(F.lit(1)).alias("n"), F.count_distinct(c).alias("ids")) for n, c in ids.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(with_tables("examples") + f", {BOUNDS} select {SPLIT} as split, customer_id, place, model from examples, bounds where reason = 'ok'")
def dataset_splits(spark: SparkSession, d: str) -> DataFrame:
    """The examples, written by split and read again."""
    root = _place(spark)
    made = _split(spark, d).filter("reason = 'ok'").select("customer_id", F.col("place").cast("long").alias("place"), "model", "split")
    datasets.write_dataset(made, root, {"source": "star"})
    parts = [datasets.load_split(spark, root, split).withColumn("split", F.lit(split)) for split in datasets.SPLITS]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("select label::varchar as model, case vec_id % 3 when 0 then 'main' when 1 then 'pers' else 'side' end as image_type, count(*) as n, 'http://images/' || label || case vec_id % 3 when 0 then '' when 1 then '_pers' else '_side' end || '.jpg' as source_url from embeddings where vec_id % 17 <> 0 and vec_id % 19 <> 0 group by 1, 2, 4")
def cached_images(spark: SparkSession, d: str) -> DataFrame:
    """Catalog records with blanks, unknown views and bad vectors among them, cleaned and read from the cache."""
    at = F.col("position")
    raw = T.images(spark, d).select(
        F.when(at % 17 == 0, " ").otherwise(F.concat(F.lit(" "), "model")).alias("model"), F.upper("image_type").alias("image_type"),
        F.when(at % 19 == 0, F.slice("embedding", 1, 0)).otherwise(F.col("embedding")).alias("embedding"), F.lit(None).cast("int").alias("embedding_dimension"), F.lit("").alias("source_url"),
    )
    path, build = _place(spark), lambda: retrieval.clean_images(raw, "http://images", T.DIMENSION)
    datasets.cached_catalog(spark, path, "star", T.VECTOR_MODEL, build)
    again = datasets.cached_catalog(spark, path, "star", T.VECTOR_MODEL, build)
    return again.groupBy("model", "image_type", "source_url").agg(F.count(F.lit(1)).alias("n"))


PAYLOADS = """with b as (select page_id as i, page_id % 6 as kind, url from pages),
e as (
  select i, unnest(case kind when 0 then ['main', 'side'] when 1 then ['main', 'side'] else [null] end) as image_type, kind, url from b where kind <> 5)"""


def _payloads(spark: SparkSession, d: str) -> DataFrame:
    """Payloads of pages: whole ones, with a blank address, with a bad entry, of another form, no JSON, without models."""
    i, url = F.col("page_id"), F.col("url")
    images = F.to_json(F.struct(url.alias("main"), F.when(i % 6 == 1, " ").otherwise(url).alias("side"), url.alias("back")))
    model = F.concat(F.lit('{"model_id": '), i.cast("string"), F.lit(', "model": "m'), i.cast("string"), F.lit('", "images": '), images, F.lit("}"))
    body = (
        F.when(i % 6 <= 1, F.concat(F.lit('{"models": ['), model, F.lit("]}")))
        .when(i % 6 == 2, F.concat(F.lit('{"models": ['), i.cast("string"), F.lit("]}")))
        .when(i % 6 == 3, F.concat(F.lit("["), model, F.lit("]")))
        .when(i % 6 == 4, F.concat(F.lit("{"), i.cast("string")))
        .otherwise(F.lit('{"models": []}'))
    )
    return T.read(spark, d, "pages").select(body.alias("payload"))


@query(PAYLOADS + " select i::varchar as model_id, 'm' || i as model, image_type, url from e where kind <= 1 and not (kind = 1 and image_type = 'side')")
def payload_addresses(spark: SparkSession, d: str) -> DataFrame:
    return snapshots.payload_jobs(_payloads(spark, d))[0].select("model_id", "model", "image_type", "url")


@query(PAYLOADS + " select case kind when 1 then 'INVALID_URL' when 2 then 'INVALID_MODEL_ENTRY' when 3 then 'UNSUPPORTED_PAYLOAD' else 'MALFORMED_JSON' end as error, count(*) as n from e where kind in (2, 3, 4) or (kind = 1 and image_type = 'side') group by 1")
def payload_errors(spark: SparkSession, d: str) -> DataFrame:
    return snapshots.payload_jobs(_payloads(spark, d))[1].groupBy("error").agg(F.count(F.lit(1)).alias("n"))


@query("select p_partkey as a, p_brand as b from part where p_partkey % 5 <> 4")
def unwrapped_answers(spark: SparkSession, d: str) -> DataFrame:
    """Rows from answers of a remote view in its forms, and from one that isn't any."""
    i = F.col("p_partkey")
    row = F.to_json(F.struct(i.alias("a"), F.col("p_brand").alias("b")))
    listed = F.concat(F.lit("["), row, F.lit("]"))
    table = F.to_json(F.struct(F.array(F.lit("b"), F.lit("a")).alias("fields"), F.array(F.array(F.col("p_brand"), i.cast("string"))).alias("values")))
    body = F.when(i % 5 == 0, listed).when(i % 5 == 1, F.concat(F.lit('{"data":'), listed, F.lit("}"))).when(i % 5 == 2, F.concat(F.lit('{"records":'), listed, F.lit("}"))).when(i % 5 == 3, table).otherwise(row)
    return snapshots.unwrap_payload(T.read(spark, d, "part").select(body.alias("body")), "struct<a:bigint,b:string>")


FORMS = "with f as (select vec_id as i, vec_id % 7 as form, label::varchar as m from embeddings)"


@query(FORMS + " select i as vec_id, case when form <> 5 then m end as model, case when form <> 5 then 'same' end as verdict from f where form <> 6")
def verdict_forms(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts from answers in all forms: plain, fenced, in prose, as an object's text, in pieces of a list, failed, none."""
    i = F.col("vec_id")
    rows = F.concat(F.lit('{"candidates": [{"model": "'), F.col("label").cast("string"), F.lit('", "verdict": "Same"}]}'))
    quoted = lambda c: F.to_json(F.array(c)).substr(F.lit(2), F.length(F.to_json(F.array(c))) - 2)
    pieces = F.concat(F.lit('[{"content": [{"text": '), quoted(F.substring(rows, 1, 20)), F.lit('}, {"other": 1}]}, {"text": '), quoted(rows.substr(F.lit(21), F.length(rows))), F.lit("}]"))
    answer = (
        F.when(i % 7 == 0, rows).when(i % 7 == 1, F.concat(F.lit("```json\n"), rows, F.lit("\n```"))).when(i % 7 == 2, F.concat(F.lit("I think "), rows, F.lit(".")))
        .when(i % 7 == 3, F.concat(F.lit('{"output_text": '), quoted(rows), F.lit("}"))).when(i % 7 == 4, pieces).when(i % 7 == 5, F.concat(F.lit('{"result": "failed", '), rows.substr(F.lit(2), F.length(rows))))
        .otherwise(F.lit(None))
    )
    found = T.read(spark, d, "embeddings").select(i, decisions.parse_output(answer).alias("c")).filter(i % 7 != 6)
    one = decisions.normalize_verdict(F.get("c", 0))
    return found.select("vec_id", F.when(F.col("c").isNotNull(), one["model"]).alias("model"), F.when(F.col("c").isNotNull(), one["verdict"]).alias("verdict"))


@query("select page_id, sha256(coalesce(html, '')) as image_hash, strlen(html) as n from pages where strlen(html) > 0")
def image_bytes_hashed(spark: SparkSession, d: str) -> DataFrame:
    """Images as base64 text, with or without a data URL's prefix, decoded and hashed."""
    text = F.base64(F.col("html").cast("binary"))
    sent = T.read(spark, d, "pages").select("page_id", F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("data:image/png;base64,"), text)).otherwise(text).alias("body"))
    decoded = sent.select("page_id", S.image_bytes(F.col("body")).alias("b")).filter("b is not null")
    return decoded.select("page_id", F.sha2("b", 256).alias("image_hash"), F.octet_length("b").cast("long").alias("n"))


@query("select user_id, count(*) as n, count(json_extract_string(props, '$.k')) as known, sum(json_extract_string(props, '$.k')::bigint)::bigint as total from events group by 1")
def event_properties(spark: SparkSession, d: str) -> DataFrame:
    """Maps from JSON texts, and their lists of values without blanks."""
    read = T.read(spark, d, "events").select("user_id", S.json_map(F.col("props")).alias("m"))
    k = F.col("m")["k"]
    return read.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size(S.positive_list(F.array(k)))).alias("known"), F.sum(k.cast("long")).alias("total"))


@query("select count(*) as images, count(distinct case when label <> 3 then label end) as models from embeddings")
def catalog_sizes(spark: SparkSession, d: str) -> DataFrame:
    return integrity.catalog_counts(T.images(spark, d).withColumn("model", F.when(F.col("model") == "3", " ").otherwise(F.col("model"))))


@query(
    """with s as (select vec_id as i, vec_id % 2 = 0 as ok, embedding[1]::double as e, case when vec_id % 11 <> 0 then embedding[2]::double end as c, vec_id % 10 as x, vec_id % 4 as y, vec_id % 3 as p from embeddings)
select i as vec_id, case when not ok then 'B' when e > coalesce(c, '-infinity'::double) and p = y then 'A' when p = x then 'ok' else 'C' end as class from s"""
)
def failure_classes(spark: SparkSession, d: str) -> DataFrame:
    i, e = F.col("vec_id"), F.col("embedding")
    kind = retrieval.failure_class(i % 2 == 0, e[0].cast("double"), F.when(i % 11 != 0, e[1].cast("double")), i % 10, i % 4, i % 3)
    return T.read(spark, d, "embeddings").select("vec_id", kind.alias("class"))


@query("select toxic::varchar as expected, count(*) filter (quality = 0) as \"0\", count(*) filter (quality = 1) as \"1\" from labels group by 1")
def label_confusion(spark: SparkSession, d: str) -> DataFrame:
    rows = T.read(spark, d, "labels").select(F.col("toxic").cast("string").alias("expected"), F.col("quality").cast("string").alias("predicted"))
    return metrics.confusion(rows, ("0", "1"))


@query("with r as (select p_size as dimension, count(*) / (select count(*) from part) as recall from part group by 1) select min(dimension) as dimension from r where recall >= (select max(recall) from r) - 0.01")
def smallest_dimension(spark: SparkSession, d: str) -> DataFrame:
    parts = T.read(spark, d, "part")
    n = parts.count()
    return metrics.smallest_good(parts.groupBy(F.col("p_size").alias("dimension")).agg((F.count(F.lit(1)) / F.lit(n)).alias("recall_10")))


@query(
    """with asked as (select vec_id, label, case when vec_id % 40 = 0 then list_reverse(embedding) else embedding end::double[] as q from embeddings where vec_id % 20 = 0),
s as (select a.vec_id, e.vec_id = a.vec_id as own, list_dot_product(q, e.embedding::double[]) as s from asked a, embeddings e)
select vec_id::varchar as position from s group by 1 having max(s) filter (not own) > max(s) filter (own)"""
)
def self_test_failures(spark: SparkSession, d: str) -> DataFrame:
    """Images that don't find themselves: half of those asked are stored as other vectors."""
    images = T.images(spark, d).withColumn("image_type", F.col("position").cast("string"))
    asked = images.filter("position % 20 = 0").select(F.concat_ws("|", "model", "image_type").alias("query_id"), F.when(F.col("position") % 40 == 0, F.reverse("embedding")).otherwise(F.col("embedding")).alias("vector"))
    hits = retrieval.rank_images(asked, images, 2)
    scores = hits.select(F.substring_index("query_id", "|", 1).alias("query_model"), F.substring_index("query_id", "|", -1).alias("query_type"), "model", "image_type", "similarity")
    return integrity.self_retrieval(scores).select(F.col("query_type").alias("position"))


@query("select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') as ts, case when event_id % 5 <> 0 and event_id % 7 <> 0 then value end as value from events")
def json_safe_events(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    odd = F.when(i % 5 == 0, float("nan")).when(i % 7 == 0, float("inf")).otherwise(F.col("value"))
    return lookups.json_safe(T.read(spark, d, "events").select(i, F.col("ts").cast("timestamp").alias("ts"), odd.alias("value")))


@query(with_tables("faulty_images") + f" select position, position % 50 in (2, 3, 4) as zeros, {M.format('case when position % 50 in (2, 3, 4) then 0.0 else list_sum(embedding::double[]) end')} as sum_micro from faulty_images")
def visual_slots(spark: SparkSession, d: str) -> DataFrame:
    """Vectors as the towers take them: zeros for those that are bad."""
    v = V.fits(F.col("embedding"), T.DIMENSION)
    return T.faulty_images(spark, d).select("position", F.forall(v, lambda x: x == 0).alias("zeros"), micro(F.aggregate(v.cast("array<double>"), F.lit(0.0), lambda a, x: a + x)).alias("sum_micro"))


@query("select field, n, least(16, greatest(4, (n + 1) // 2))::int as width from (select 'brand' as field, count(distinct p_brand) as n from part union all select 'type', count(distinct p_type) from part)")
def embedding_widths(spark: SparkSession, d: str) -> DataFrame:
    parts = T.read(spark, d, "part")
    counts = [(f, parts.select(c).distinct().count()) for f, c in (("brand", "p_brand"), ("type", "p_type"))]
    return spark.createDataFrame([(f, n, encoders.embedding_width(n)) for f, n in counts], "field string, n long, width int")


@query(with_tables("catalog") + " select distinct main_category as model from catalog where main_category <> '' and position(',' in main_category) = 0")
def csv_codes(spark: SparkSession, d: str) -> DataFrame:
    """Codes written to a CSV file with a header, twice each, and read again."""
    path, rows = _place(spark), T.catalog(spark, d).select(F.col("main_category").alias("model")).distinct()
    snapshots.write_csv(rows.unionByName(rows), path, ["model"])
    return snapshots.read_codes(spark, path).select("model")


@query(
    """select unnest(['failed', 'ready', 'failed', 'ready']) as status, unnest([0, 1, 1, 2])::int as version, unnest([false, false, true, false]) as kept_previous,
unnest([0, (select count(*) from embeddings), (select count(*) from embeddings), (select count(*) from embeddings where vec_id % 2 = 0)]) as images"""
)
def refresh_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Refreshes of a catalog: an empty one before any version, a whole one, an empty one, a smaller one."""
    images, store = T.images(spark, d), VersionStore(spark, _place(spark))
    counted = lambda df: {"images": df.count()}
    made = [store.refresh(lambda rows=rows: rows, lambda df: not df.isEmpty(), counted) for rows in (images.limit(0), images, images.limit(0), images.filter("position % 2 = 0"))]
    return spark.createDataFrame([(o.status, o.version, o.kept_previous, o.counts.get("images", 0)) for o in made], "status string, version int, kept_previous boolean, images long")


@query("select doc_id, 'MODEL_' || (doc_id % 3) || '/' || ['main', 'pers', 'side'][doc_id % 3 + 1] as spec, joined from (select doc_id, lang || ',' || source as joined from documents where lang is not null and source is not null)")
def self_test_specs_read(spark: SparkSession, d: str) -> DataFrame:
    """MODEL/TYPE specifications, with blanks and case, read and put together again."""
    i = F.col("doc_id")
    kind = F.get(F.array(F.lit("MAIN"), F.lit(" Pers"), F.lit("side ")), (i % 3).cast("int"))
    spec = lookups.self_test(F.concat(F.lit(" MODEL_"), (i % 3).cast("string"), F.lit("/"), kind))
    rows = T.read(spark, d, "documents").filter("lang is not null and source is not null")
    return rows.select("doc_id", F.concat_ws("/", spec["model"], spec["image_type"]).alias("spec"), joined(F.array("lang", "source")).alias("joined"))


DIAGNOSED = """with asked as (select vec_id, vec_id::varchar as query_id, embedding::double[] as q, label as expected, (label + 1) % 10 as compare from embeddings where vec_id % 20 = 0),
scored as (select query_id, e.vec_id as position, e.label, expected, compare, list_dot_product(q, embedding::double[]) as s, sqrt(list_dot_product(embedding::double[], embedding::double[])) as norm from asked, embeddings e),
ranked as (select *, row_number() over (partition by query_id order by s desc, position) as rank from scored)"""


def _targets(spark: SparkSession, d: str) -> DataFrame:
    """Each asked image's own model, and the next one to compare with."""
    e = T.read(spark, d, "embeddings").filter("vec_id % 20 = 0")
    both = F.explode(F.array(F.col("label"), (F.col("label") + 1) % 10).cast("array<string>"))
    return e.select(F.col("vec_id").cast("string").alias("query_id"), both.alias("model"))


def _asked(spark: SparkSession, d: str) -> DataFrame:
    return T.read(spark, d, "embeddings").filter("vec_id % 20 = 0").select(F.col("vec_id").cast("string").alias("query_id"), F.col("embedding").alias("vector"))


@query(DIAGNOSED + f" select query_id, label::varchar as model, position, rank, {M.format('s')} as similarity_micro, {M.format('norm')} as norm_micro from ranked where label in (expected, compare)")
def match_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    """How near the images of the expected model and of another one are to each query, among all images."""
    out = retrieval.view_ranks(_asked(spark, d), _targets(spark, d), T.images(spark, d))
    return out.select("query_id", "model", "position", "rank", micro(F.col("similarity")).alias("similarity_micro"), micro(F.col("norm")).alias("norm_micro"))


@query("select event_id, epoch_us(ts + case event_id % 4 when 2 then interval (-2) hour when 3 then interval 5 hour else interval 0 hour end) // 1000000 as seconds from events")
def utc_moments(spark: SparkSession, d: str) -> DataFrame:
    """Moments from texts without a zone, and with zones, in whole seconds."""
    i, text = F.col("event_id"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    told = F.when(i % 4 == 0, text).when(i % 4 == 1, F.concat(F.replace(text, F.lit(" "), F.lit("T")), F.lit("Z"))).when(i % 4 == 2, F.concat(text, F.lit("+02:00"))).otherwise(F.concat(text, F.lit("-05:00")))
    return T.read(spark, d, "events").select("event_id", F.unix_seconds(S.as_utc(told)).alias("seconds"))
