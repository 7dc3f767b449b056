"""The engine's tables, derived from the star schema, and the same derivations in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.purchases import prepare_purchases

OBSERVED_FROM, AS_OF = "1997-01-01", "2001-09-01"
#: What tells purchases of one customer and moment apart in these tables.
TIES = ("purchase_id", "invoice_number", "sku", "price", "quantity")
DIMENSION, VECTOR_MODEL = 64, "synthetic-64"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def purchases(spark: SparkSession, d: str) -> DataFrame:
    line, orders, customer = (read(spark, d, t) for t in ("lineitem", "orders", "customer"))
    # orders meet their customers first: they are fewer than their lines
    named = orders.join(customer.select("c_custkey", "c_name"), F.col("o_custkey") == F.col("c_custkey"))
    bought = line.join(named, F.col("l_orderkey") == F.col("o_orderkey"))
    month = F.month("o_orderdate")
    return bought.select(
        F.col("l_orderkey").alias("purchase_id"),
        F.col("l_linenumber").cast("string").alias("invoice_number"),
        F.col("o_orderdate").cast("timestamp").alias("purchase_date"),
        F.col("o_custkey").cast("string").alias("customer_id"),
        F.col("l_partkey").cast("string").alias("model"),
        F.concat_ws("-", F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")).alias("sku"),
        (F.col("l_linenumber") + 35).cast("string").alias("size"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_discount").alias("discount"),
        F.concat(F.when(month.between(4, 9), "S").otherwise("W"), F.date_format("o_orderdate", "yy")).alias("season"),
        F.col("c_name").alias("last_name"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("paid_amount"),
        F.col("l_extendedprice").alias("price"),
    )


def prepared(spark: SparkSession, d: str) -> DataFrame:
    return prepare_purchases(purchases(spark, d), OBSERVED_FROM)


def customers(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "customer")
    return c.select(F.col("c_custkey").cast("string").alias("customer_id"), F.col("c_mktsegment").alias("age_group"), F.concat(F.lit("3"), (F.col("c_nationkey") % 10).cast("string")).alias("preferred_size"), F.col("c_acctbal").alias("history_confidence"))


def catalog(spark: SparkSession, d: str) -> DataFrame:
    """One row a model; models without a vector have a null visual."""
    vectors = read(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("visual"))
    part = read(spark, d, "part").join(vectors, F.col("p_partkey") == F.col("vec_id"), "left")
    return part.select(F.col("p_partkey").cast("string").alias("model"), F.col("p_partkey").alias("model_id"), F.col("p_name").alias("model_name"), F.col("p_type").alias("main_category"), F.col("p_brand").alias("color"), F.col("p_size").cast("string").alias("theme"), "visual")


def views(spark: SparkSession, d: str) -> DataFrame:
    """model, model_id, main, pers, side: three vectors a model, some without the second."""
    e = read(spark, d, "embeddings").select("vec_id", "embedding")
    n = e.count()
    other = lambda name, step: e.select(((F.col("vec_id") - step + n) % n).alias("vec_id"), F.col("embedding").alias(name))
    joined = e.withColumnRenamed("embedding", "main").join(other("pers", 1), "vec_id").join(other("side", 7), "vec_id")
    return joined.select(F.col("vec_id").cast("string").alias("model"), F.col("vec_id").alias("model_id"), "main", F.when(F.col("vec_id") % 3 != 0, F.col("pers")).alias("pers"), "side")


def images(spark: SparkSession, d: str) -> DataFrame:
    """model, image_type, embedding, position, embedding_model: a row an image, ten models."""
    kind = F.when(F.col("vec_id") % 3 == 0, "main").when(F.col("vec_id") % 3 == 1, "pers").otherwise("side")
    return read(spark, d, "embeddings").select(F.col("label").cast("string").alias("model"), kind.alias("image_type"), "embedding", F.col("vec_id").alias("position"), F.lit(VECTOR_MODEL).alias("embedding_model"))


def cases(spark: SparkSession, d: str) -> DataFrame:
    docs, labels, vectors = (read(spark, d, t) for t in ("documents", "labels", "embeddings"))
    joined = docs.join(labels, "doc_id").join(vectors.select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id")
    status = F.when(F.col("toxic") == 1, "unreviewed").when(F.col("quality") == 1, "approved").otherwise("draft")
    return joined.select(
        F.col("doc_id").cast("string").alias("case_key"), F.col("source").alias("wa_id"), F.when(F.col("lang") == "en", "customer_success").otherwise("sales").alias("role_id"), status.alias("review_status"),
        F.col("text").alias("recognition_text"), F.col("text").alias("case_text"), F.lit("").alias("case_summary"), F.col("embedding").alias("recognition_vector"), F.col("embedding").alias("case_vector"),
    )


def notices(spark: SparkSession, d: str) -> DataFrame:
    """notice_id, text: wordings of orders and deliveries, of six kinds."""
    key = F.col("o_orderkey")
    number = F.lpad((key + 10000).cast("string"), 5, "0")
    app = F.concat(F.lit("CS"), F.lpad(key.cast("string"), 9, "2"))
    model = F.concat((F.lit(50000) + key % 9000).cast("string"), F.lit("_"), F.lpad((key % 1000).cast("string"), 3, "0"))
    size = F.concat((F.lit(35) + key % 8).cast("string"), F.when(key % 2 == 0, ",5").otherwise(""))
    text = (
        F.when(key % 6 == 0, F.concat(F.lit("Thank you for your order #"), number, F.lit(" "), model, F.lit(" - "), size))
        .when(key % 6 == 1, F.concat(F.lit("Your Order Number: "), number, F.lit("\nsize "), size))
        .when(key % 6 == 2, F.concat(F.lit("order "), app, F.lit(" model "), model))
        .when(key % 6 == 3, F.concat(F.lit("On The Way! parcel "), F.lpad(key.cast("string"), 10, "7")))
        .when(key % 6 == 4, F.concat(F.lit("Tracking number: "), F.lpad(key.cast("string"), 8, "3"), F.lit(" packed")))
        .otherwise(F.concat(F.lit("hello "), key.cast("string")))
    )
    return read(spark, d, "orders").select(key.alias("notice_id"), text.alias("text"))


def scans(spark: SparkSession, d: str) -> DataFrame:
    """notice_id, text: wordings in Hebrew, misread prefixes, several numbers in a text, of twelve kinds."""
    key = F.col("o_orderkey")
    nine, short = F.lpad(key.cast("string"), 9, "2"), F.lpad((key + 10000).cast("string"), 5, "0")
    texts = [
        F.concat(F.lit("אישור הזמנה: "), short), F.concat(F.lit("order C5"), nine), F.concat(F.lit("8S"), nine, F.lit(" thanks")),
        F.concat(F.lit("BS"), nine, F.lit(" or cs"), nine, F.lit("77")), F.concat(F.lit("BS"), nine, F.lit(" or CS"), nine),
        F.concat(F.lit("הזמנתך התקבלה #"), short), F.concat(F.lit("מספר משלוח: "), nine), F.concat(F.lit("בדרך אליך "), nine),
        F.concat(F.lit("מידה 41.5 - "), short), F.concat(F.lit("new order b5"), nine), F.concat(F.lit("hello "), key.cast("string")), F.lit("מעקב משלוח"),
    ]
    return read(spark, d, "orders").select(key.alias("notice_id"), F.get(F.array(*texts), (key % 12).cast("int")).alias("text"))


def faulty_images(spark: SparkSession, d: str) -> DataFrame:
    """images with faults in some: another encoder, a number too few, none, a NaN, twice the length, one vector for all."""
    at, v = F.col("position") % 50, F.col("embedding")
    one = F.transform(F.sequence(F.lit(1), F.lit(DIMENSION)), lambda i: (i == 1).cast("float"))
    made = (
        F.when(at == 2, F.slice(v, 1, DIMENSION - 1))
        .when(at == 3, F.slice(v, 1, 0))
        .when(at == 4, F.transform(v, lambda x, i: F.when(i == 5, float("nan")).otherwise(x).cast("float")))
        .when(at == 5, F.transform(v, lambda x: (x * 2).cast("float")))
        .when(at == 6, one)
        .otherwise(v)
    )
    return images(spark, d).withColumns({"embedding": made, "embedding_model": F.when(at == 1, "another").when(at != 7, F.col("embedding_model"))})


#: The same as common table expressions.
SQL = {
    "purchases": """purchases as (
  select l_orderkey as purchase_id, l_linenumber::varchar as invoice_number, o_orderdate as purchase_date, o_custkey::varchar as customer_id,
         l_partkey::varchar as model, l_partkey || '-' || l_suppkey as sku, (l_linenumber + 35)::varchar as size, l_quantity as quantity,
         l_discount as discount, (case when month(o_orderdate) between 4 and 9 then 'S' else 'W' end) || strftime(o_orderdate, '%y') as season,
         c_name as last_name, l_extendedprice * (1 - l_discount) as paid_amount, l_extendedprice as price
  from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey)""",
    "prepared": """prepared as (
  select * from purchases where purchase_date >= timestamp '1997-01-01' and customer_id <> '99999999' and quantity > 0 and paid_amount > 0)""",
    "customers": """customers as (
  select c_custkey::varchar as customer_id, c_mktsegment as age_group, '3' || (c_nationkey % 10) as preferred_size from customer)""",
    "catalog": """catalog as (
  select p_partkey::varchar as model, p_partkey as model_id, p_name as model_name, p_type as main_category, p_brand as color, p_size::varchar as theme,
         embedding as visual
  from part left join embeddings on p_partkey = vec_id)""",
    "sequences": """sequences as (
  select *, row_number() over o as place, count(*) over b as purchases_before,
         coalesce(sum(case when discount > 0 then 1 else 0 end) over b, 0)::bigint as discounts_before,
         coalesce(sum(discount::decimal(12, 2)) over b, 0)::double as discount_sum_before,
         lag(purchase_date) over o as last_date, first(purchase_date) over b as first_date,
         list(model) over b as history, list(season) over b as seasons_before
  from prepared
  window o as (partition by customer_id order by purchase_date, purchase_id, invoice_number, sku, price, quantity),
         b as (partition by customer_id order by purchase_date, purchase_id, invoice_number, sku, price, quantity rows between unbounded preceding and 1 preceding)
  qualify place > 1)""",
    "examples": """examples as (
  select s.*, case when c.model is null then 'missing_model' when c.visual is null then 'missing_visual' else 'ok' end as reason
  from sequences s left join catalog c on s.model = c.model)""",
    "histories": """histories as (
  select p.customer_id, list(p.model order by purchase_date, purchase_id, invoice_number, sku, price, quantity) as catalog_history
  from prepared p join catalog c on p.model = c.model and c.visual is not null group by 1)""",
    "pooled": """recent as (
  select customer_id, unnest(catalog_history[-20:]) as model from histories),
pooled as (
  select customer_id, list(m order by i) as mean from (
    select customer_id, i, avg(visual[i]::double) as m
    from recent r join catalog c on r.model = c.model, range(1, 65) as t(i) group by customer_id, i) group by customer_id),
vectors as (
  select customer_id, list_transform(mean, lambda x: x / sqrt(list_dot_product(mean, mean))) as vector from pooled)""",
    "views": """views as (
  select a.vec_id::varchar as model, a.vec_id as model_id, a.embedding as main, case when a.vec_id % 3 <> 0 then b.embedding end as pers, c.embedding as side
  from embeddings a
  join embeddings b on b.vec_id = (a.vec_id + 1) % (select count(*) from embeddings)
  join embeddings c on c.vec_id = (a.vec_id + 7) % (select count(*) from embeddings))""",
    "images": """images as (
  select label::varchar as model, case vec_id % 3 when 0 then 'main' when 1 then 'pers' else 'side' end as image_type, embedding, vec_id as position from embeddings)""",
    "faulty_images": """faulty_images as (
  select model, image_type, position, case position % 50 when 1 then 'another' when 7 then null else 'synthetic-64' end as embedding_model,
         case position % 50 when 2 then embedding[:63] when 3 then embedding[:0] when 4 then list_concat(embedding[:5], ['nan'::float], embedding[7:])
           when 5 then list_transform(embedding, lambda x: (x * 2)::float) when 6 then list_transform(range(1, 65), lambda i: (i = 1)::int::float) else embedding end as embedding
  from images)""",
    "scans": """scans as (
  select k as notice_id, [
    'אישור הזמנה: ' || short, 'order C5' || nine, '8S' || nine || ' thanks', 'BS' || nine || ' or cs' || nine || '77', 'BS' || nine || ' or CS' || nine, 'הזמנתך התקבלה #' || short,
    'מספר משלוח: ' || nine, 'בדרך אליך ' || nine, 'מידה 41.5 - ' || short, 'new order b5' || nine, 'hello ' || k, 'מעקב משלוח'][k % 12 + 1] as text
  from (select o_orderkey as k, lpad(o_orderkey::varchar, 9, '2') as nine, lpad((o_orderkey + 10000)::varchar, 5, '0') as short from orders))""",
    "cases": """cases as (
  select d.doc_id::varchar as case_key, source as wa_id, case when lang = 'en' then 'customer_success' else 'sales' end as role_id,
         case when toxic = 1 then 'unreviewed' when quality = 1 then 'approved' else 'draft' end as review_status, text, embedding
  from documents d join labels l on d.doc_id = l.doc_id join embeddings e on d.doc_id = e.vec_id)""",
    "notices": """notices as (
  select k as notice_id, case k % 6
    when 0 then 'Thank you for your order #' || lpad((k + 10000)::varchar, 5, '0') || ' ' || m || ' - ' || s
    when 1 then 'Your Order Number: ' || lpad((k + 10000)::varchar, 5, '0') || chr(10) || 'size ' || s
    when 2 then 'order CS' || lpad(k::varchar, 9, '2') || ' model ' || m
    when 3 then 'On The Way! parcel ' || lpad(k::varchar, 10, '7')
    when 4 then 'Tracking number: ' || lpad(k::varchar, 8, '3') || ' packed'
    else 'hello ' || k end as text
  from (select o_orderkey as k, (50000 + o_orderkey % 9000) || '_' || lpad((o_orderkey % 1000)::varchar, 3, '0') as m,
               (35 + o_orderkey % 8) || case when o_orderkey % 2 = 0 then ',5' else '' end as s from orders))""",
}


def with_tables(*names: str) -> str:
    """A WITH clause of the tables and what they need."""
    needs = {"prepared": ("purchases",), "sequences": ("prepared",), "examples": ("sequences", "catalog"), "histories": ("prepared", "catalog"), "pooled": ("histories",), "faulty_images": ("images",)}
    done: list[str] = []

    def add(name: str) -> None:
        for n in needs.get(name, ()):
            add(n)
        if name not in done:
            done.append(name)

    for name in names:
        add(name)
    return "with " + ",\n".join(SQL[n] for n in done)
