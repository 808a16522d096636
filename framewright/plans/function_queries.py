"""Column function queries (U)."""

from __future__ import annotations

from pyspark.sql import functions as F

from framewright.functions import binary as B
from framewright.functions import columns as C
from framewright.plans.adapters import r, rnd, table, weigh
from framewright.plans.registry import query


@query("u01_pcm_conversion", f"""WITH v AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (l_quantity - 25.5::DOUBLE) / 20.0::DOUBLE AS x, (l_partkey * 37 + l_suppkey) % 65536 - 32768 AS p FROM lineitem),
c AS (SELECT *, least(greatest(x, -1), 1) AS y FROM v)
SELECT l_orderkey, {r('sum(p / 32768.0::DOUBLE)', 9)} AS f8, {r('sum(p / 32767.0::DOUBLE)', 9)} AS f7, sum(trunc(CASE WHEN y < 0 THEN y * 32768 ELSE y * 32767 END))::BIGINT AS pcm FROM c GROUP BY 1""")
def u01(spark, sf):
    p = (F.col("l_partkey") * 37 + F.col("l_suppkey")) % 65536 - 32768
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        rnd(F.sum(C.pcm16_to_float(p)), 9).alias("f8"), rnd(F.sum(C.pcm16_to_float(p, 32767.0)), 9).alias("f7"),
        F.sum(C.float_to_pcm16((F.col("l_quantity") - 25.5) / 20.0)).alias("pcm"))


@query("u02_clamp", f"""SELECT l_orderkey, {r('sum(least(greatest(l_extendedprice / 100.0::DOUBLE - 300, 0), 255))')} AS v,
  count(*) FILTER (l_linenumber = 1) * 255 AS inf FROM lineitem GROUP BY 1""")
def u02(spark, sf):
    inf = F.when(F.col("l_linenumber") == 1, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        rnd(F.sum(C.clamp(F.col("l_extendedprice") / 100.0 - 300, 0.0, 255.0))).alias("v"),
        F.sum(C.clamp(inf, 0.0, 255.0)).cast("long").alias("inf"))


@query("u03_image_scaling", f"""WITH b AS (SELECT l_orderkey, l_partkey % 256 AS v FROM lineitem) SELECT l_orderkey, {r('sum((v / 255.0::DOUBLE - 0.5::DOUBLE) * 2)', 9)} AS scaled,
  sum(trunc((((v / 255.0::DOUBLE - 0.5::DOUBLE) * 2.0::DOUBLE) / 2.0::DOUBLE + 0.5::DOUBLE) * 255.0::DOUBLE))::BIGINT AS back FROM b GROUP BY 1""")
def u03(spark, sf):
    v = C.scale_image(F.col("l_partkey") % 256)
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        rnd(F.sum(v), 9).alias("scaled"), F.sum(C.unscale_image(v)).alias("back"))


@query("u04_clock_conversion", """SELECT o_orderkey, o_orderkey * 40 AS ms, o_orderkey * 640 AS sample, o_orderkey * 80 // 25 AS step, o_orderkey // 200 AS sample_step, o_orderkey * 25 // 1000 AS frame FROM orders""")
def u04(spark, sf):
    o = F.col("o_orderkey")
    return table(spark, sf, "orders").select(
        "o_orderkey", C.frame_to_ms(o).alias("ms"), C.frame_to_sample(o).alias("sample"), C.frame_to_step(o).alias("step"),
        C.sample_to_step(o).alias("sample_step"), C.ms_to_frame(o).alias("frame"))


@query("u05_frame_names", """SELECT o_orderkey, 'frame_' || CASE WHEN length(o_orderkey::VARCHAR) < 4 THEN lpad(o_orderkey::VARCHAR, 4, '0') ELSE o_orderkey::VARCHAR END || '.png' AS name, o_orderkey AS id FROM orders""")
def u05(spark, sf):
    o = F.col("o_orderkey")
    return table(spark, sf, "orders").select(
        "o_orderkey", C.frame_name(o).alias("name"), C.frame_id_from_path(F.concat(F.lit("/a/b.c/"), o.cast("string"), F.lit(".lms"))).alias("id"))


@query("u06_float_bytes", f"""SELECT vec_id, (len(embedding) * 4)::BIGINT AS bytes, {r('list_sum(list_transform(embedding, lambda v, i: v::DOUBLE * i))')} AS chk FROM embeddings""")
def u06(spark, sf):
    raw = table(spark, sf, "embeddings").select("vec_id", B.floats_to_bytes("embedding").alias("raw"))
    return raw.select("vec_id", F.octet_length("raw").cast("long").alias("bytes"), rnd(weigh(B.bytes_to_floats("raw"))).alias("chk"))


@query("u07_base64_md5", """SELECT doc_id, md5(text) AS md5, length(base64(encode(text)))::BIGINT AS b64, strlen(text)::BIGINT AS bytes FROM documents""")
def u07(spark, sf):
    raw = F.encode("text", "utf-8")
    b64 = F.regexp_replace(F.base64(raw), r"\s", "")
    return table(spark, sf, "documents").select(
        "doc_id", F.md5(raw).alias("md5"), F.length(b64).cast("long").alias("b64"), F.octet_length(F.unbase64(b64)).cast("long").alias("bytes"))
