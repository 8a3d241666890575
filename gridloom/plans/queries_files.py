"""Queries that write given tables as files and read them back, that call user functions, and that factor matrices, each with its SQL."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import dtypes
from ..functions import tapers
from ..operators import arrange, factor, order, random, udf
from ..sources import masked as masked_files
from ..sources import npy, npy_source, text
from .catalog import query
from .queries import _CELLS, _matrix, r, table


def scratch(spark: SparkSession) -> str:
    """A new folder for files: where ``spark.checkpoint.dir`` says, on one machine a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="gridloom-")
    path = f"{named.rstrip('/')}/gridloom-files/{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def _npy_again(df: DataFrame, rows: int) -> DataFrame:
    spark, path = df.sparkSession, scratch(df.sparkSession)
    npy_source.register(spark)
    df.write.format("npy").mode("append").save(path)
    return spark.read.format("npy").option("path", path).option("rows", str(rows)).load()


@query("npy_column", "SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_extendedprice) - 1 AS i0, l_extendedprice AS v FROM lineitem")
def npy_column(spark, sf):
    """A whole column as array files and back, a task for each range of rows."""
    ordered = table(spark, sf, "lineitem").orderBy("l_orderkey", "l_linenumber", "l_extendedprice").select(F.col("l_extendedprice").alias("v"))
    return _npy_again(ordered, 4000)


@query("npy_matrix", "SELECT row_number() OVER (ORDER BY vec_id) - 1 AS i0, vec_id, embedding[1]::DOUBLE AS first, embedding[64]::DOUBLE AS last FROM embeddings")
def npy_matrix(spark, sf):
    """A matrix of 65 columns, an id and a vector each row, as array files and back."""
    ordered = table(spark, sf, "embeddings").orderBy("vec_id").select(F.concat(F.array(F.col("vec_id").cast("float")), "embedding").alias("v"))
    got = _npy_again(ordered, 100)
    return got.select("i0", F.col("v")[0].cast("long").alias("vec_id"), F.col("v")[1].cast("double").alias("first"), F.col("v")[64].cast("double").alias("last"))


@query("npy_lanes", "SELECT c_nationkey AS n, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS pos, c_custkey AS v FROM customer")
def npy_lanes(spark, sf):
    """An array file for each group, whole numbers kept."""
    path = scratch(spark)
    npy.save_arrays(table(spark, sf, "customer").select("c_nationkey", "c_custkey", F.col("c_custkey").alias("at")), ["c_nationkey"], "at", "c_custkey", path).count()
    got = npy.read_arrays(spark, path)
    return got.select(F.regexp_extract("file", r"([0-9]+)\.npy$", 1).cast("int").alias("n"), "pos", F.col("v").cast("long").alias("v"))


@query("text_table", "SELECT o_orderkey::DOUBLE AS k, o_totalprice AS v FROM orders")
def text_table(spark, sf):
    """Numbers as delimited text with a header comment, compressed by Spark's codec, and back."""
    path = scratch(spark)
    text.save(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), path, ["o_orderkey", "o_totalprice"], fmt=["%d", "%.18e"], order=["o_orderkey"], header="orders\nkey, price")
    return text.load(spark, path, 2, names=["k", "v"])


@query("text_matches", "SELECT o_orderkey::VARCHAR AS c0, floor(o_totalprice)::BIGINT::VARCHAR AS c1 FROM orders WHERE o_totalprice >= 1")
def text_matches(spark, sf):
    """Fields found in lines by a pattern."""
    path = scratch(spark)
    table(spark, sf, "orders").where("o_totalprice >= 1").select(F.format_string("<%d|%d>", "o_orderkey", F.floor("o_totalprice")).alias("value")).write.text(path)
    return text.from_regex(spark, path, r"<(\d+)\|(\d+)>", 2)


@query("masked_table", "SELECT event_id, CASE WHEN value <= 40 THEN value END AS value, value AS lifted FROM events")
def masked_table(spark, sf):
    """Masked values through files: gone under a hard mask, there when it is lifted."""
    path = scratch(spark)
    masked_files.save(table(spark, sf, "events").select("event_id", "value"), path, "value", F.col("value") > 40)
    lifted = masked_files.unmasked(masked_files.load(spark, path, hard=False), "value").select("event_id", F.col("value").alias("lifted"))
    return masked_files.load(spark, path).join(lifted, "event_id")


@query("exchanged", "SELECT c_nationkey::BIGINT AS i0, count(*)::DOUBLE AS v FROM customer GROUP BY 1 UNION ALL SELECT i, 0.0 FROM range(25) t(i) WHERE i NOT IN (SELECT c_nationkey FROM customer)")
def exchanged(spark, sf):
    """A bounded array to NumPy and back."""
    counts = table(spark, sf, "customer").groupBy(F.col("c_nationkey").cast("long").alias("i0")).agg(F.count(F.lit(1)).alias("v"))
    return npy.from_array(spark, np.nan_to_num(npy.to_array(counts, (25,))))


@query(
    "selections",
    _CELLS + """SELECT 'extract' AS how, i AS i0, j AS i1, round(v, 6) AS v FROM c WHERE v > 0.1 UNION ALL SELECT 'compress', i, j // 2, round(v, 6) FROM c WHERE j % 2 = 0
              UNION ALL SELECT 'where', i, j, round(v, 6) FROM c WHERE j < 3 AND v <> 0""",
)
def selections(spark, sf):
    """Cells by a condition, slices by a mask, places that aren't 0."""
    m = _matrix(spark, sf)
    some = arrange.extract(m.map(lambda v: (v > 0.1).cast("double")), m)
    slices = arrange.compress(m, [k % 2 == 0 for k in range(64)], 1).cells
    places = arrange.argwhere(m).where("i1 < 3").join(m.cells, ["i0", "i1"])
    return some.select(F.lit("extract").alias("how"), "i0", "i1", r("v").alias("v")).unionByName(slices.select(F.lit("compress").alias("how"), "i0", "i1", r("v").alias("v"))).unionByName(places.select(F.lit("where").alias("how"), "i0", "i1", r("v").alias("v")))


@query(
    "user_functions",
    "SELECT o_orderkey, round(sqrt(o_totalprice) + ln(o_custkey + 1), 8) AS batch, (o_orderkey // 7)::BIGINT AS q, (o_orderkey % 7)::BIGINT AS m FROM orders",
)
def user_functions(spark, sf):
    """A function of arrays, called by batches, and one of single values with two results."""
    mix = udf.vectorize(lambda a, b: np.sqrt(a) + np.log1p(b))
    parts = udf.frompyfunc(divmod, 2, 2, "long")
    got = parts(F.col("o_orderkey"), F.lit(7))
    return table(spark, sf, "orders").select("o_orderkey", r(mix("o_totalprice", "o_custkey"), 8).alias("batch"), got.alias("g")).select("o_orderkey", "batch", F.col("g")[0].alias("q"), F.col("g")[1].alias("m"))


@query(
    "user_folds",
    """SELECT l_returnflag, max(abs(l_extendedprice - 3000)) AS far, round(sum(ln(1 + l_quantity)), 5) AS logs, min(l_orderkey * 8 + l_linenumber) // 8 AS first, max(l_orderkey * 8 + l_linenumber) // 8 AS last
       FROM lineitem GROUP BY 1""",
)
def user_folds(spark, sf):
    """Associative functions of one's own: the larger magnitude, a product as a sum of logarithms, and (not commutative) the ends of
    a group in an order."""
    rows = table(spark, sf, "lineitem").select("l_returnflag", (F.col("l_extendedprice") - 3000).alias("d"), F.log1p("l_quantity").alias("w"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("at"))
    by = ["l_returnflag"]
    far = udf.reduce_with(rows, by, "d", lambda a, b: np.where(np.abs(a) >= np.abs(b), a, b), as_col="far").select(*by, F.abs("far").alias("far"))
    logs = udf.reduce_with(rows, by, "w", np.add, as_col="logs").select(*by, r("logs", 5).alias("logs"))
    first = udf.reduce_with(rows, by, "at", lambda a, b: a, "at", "long", "first").select(*by, F.expr("first div 8").alias("first"))
    last = udf.reduce_with(rows, by, "at", lambda a, b: b, "at", "long", "last").select(*by, F.expr("last div 8").alias("last"))
    return far.join(logs, by).join(first, by).join(last, by)


@query(
    "promotions",
    """WITH k AS (SELECT o_orderkey, o_custkey % 4 AS a, o_orderkey % 4 AS b FROM orders), t AS (SELECT * FROM (VALUES (0, 'i', 8), (1, 'i', 32), (2, 'f', 32), (3, 'f', 64)) v(n, kind, bits))
       SELECT CASE WHEN x.kind = y.kind THEN CASE x.kind WHEN 'i' THEN 'int' ELSE 'float' END || greatest(x.bits, y.bits)
                   ELSE 'float' || greatest(CASE WHEN x.kind = 'f' THEN x.bits ELSE y.bits END, CASE WHEN CASE WHEN x.kind = 'i' THEN x.bits ELSE y.bits END = 8 THEN 16 ELSE 64 END) END AS kind, count(*) AS n
       FROM k JOIN t x ON x.n = a JOIN t y ON y.n = b GROUP BY 1""",
)
def promotions(spark, sf):
    """The common type of every pair of types that rows name."""
    names = ["int8", "int32", "float32", "float64"]
    both = F.array(*[F.array(*[F.lit(dtypes.result_type(a, b)) for b in names]) for a in names])
    at = F.get(F.get(both, F.col("o_custkey").cast("int") % 4), F.col("o_orderkey").cast("int") % 4)
    return table(spark, sf, "orders").groupBy(at.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "tapered_lanes",
    """WITH l AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events)
       SELECT user_id, round(sum(value * CASE WHEN n = 1 THEN 1 ELSE 0.5 - 0.5 * cos(2 * pi() * i / (n - 1)) END), 5) AS hann,
              round(sum(value * CASE WHEN n = 1 THEN 1 ELSE 0.54 - 0.46 * cos(2 * pi() * i / (n - 1)) END), 5) AS hamming, round(sum(value * CASE WHEN n = 1 THEN 1 ELSE 1 - abs(2 * i / (n - 1) - 1) END), 5) AS bartlett
       FROM l GROUP BY user_id""",
)
def tapered_lanes(spark, sf):
    """Each user's values under windows of the lane's own length."""
    rows = table(spark, sf, "events").select("user_id", "event_id", "value")
    placed = order.ranked(rows, ["event_id"], "i", ["user_id"])
    sizes = rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    both = placed.join(sizes, "user_id")
    named = {w: F.col("value") * tapers.taper_of(w, F.col("i"), F.col("n")) for w in ("hann", "hamming", "bartlett")}
    return both.groupBy("user_id").agg(*[r(F.sum(v), 5).alias(w) for w, v in named.items()])


def _philox_sql(index: str, key: int) -> str:
    """Nested queries, one for each round, over a table ``t`` with the index."""
    mask, (m0, m1) = 0xFFFFFFFF, random.PHILOX_MULTIPLIERS
    inner = f"SELECT *, ({index}) & {mask} AS a, (({index}) >> 32) & {mask} AS b, 0::BIGINT AS c, 0::BIGINT AS d FROM t"
    for k in range(random.PHILOX_ROUNDS):
        k0, k1 = (((key >> 32 * j) + k * w) & mask for j, w in enumerate(random.PHILOX_WEYL))
        p, q = f"(a::HUGEINT * {m0})", f"(c::HUGEINT * {m1})"
        inner = f"SELECT * REPLACE (xor(xor(({q} // 4294967296)::BIGINT, b), {k0}) AS a, ({q} % 4294967296)::BIGINT AS b, xor(xor(({p} // 4294967296)::BIGINT, d), {k1}) AS c, ({p} % 4294967296)::BIGINT AS d) FROM ({inner})"
    return f"SELECT *, ((a >> 5) * 67108864 + (b >> 6))::DOUBLE / 9007199254740992 AS u FROM ({inner})"


@query("philox_draws", f"WITH t AS (SELECT o_orderkey FROM orders) SELECT o_orderkey, a, b, c, d, u, round(-ln(1 - u), 9) AS exponential, ceil(u * 6)::BIGINT AS die FROM ({_philox_sql('o_orderkey', 20240607)})")
def philox_draws(spark, sf):
    """Words and draws of a published generator for every order, bit for bit."""
    k, key = F.col("o_orderkey"), 20240607
    words = table(spark, sf, "orders").select(k, random.philox_words(k, key).alias("w"), random.philox_uniform(k, key).alias("u"))
    return words.select("o_orderkey", *[F.col("w")[j].alias(c) for j, c in enumerate("abcd")], "u", r(-F.log1p(-F.col("u")), 9).alias("exponential"), F.ceil(F.col("u") * 6).alias("die"))


@query("weighted_rows", f"WITH t AS (SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 0) SELECT o_orderkey, o_totalprice FROM ({_philox_sql('o_orderkey', 7)}) ORDER BY -ln(1 - u) / o_totalprice, o_orderkey LIMIT 100")
def weighted_rows(spark, sf):
    """A hundred orders without replacement, in proportion to their price: the limit is the feature."""
    return random.weighted_sample(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", "o_totalprice", 100, 7)


@query("lu_solution", "SELECT j AS k, round(avg(v), 6) AS b FROM (SELECT unnest(range(64)) AS j, unnest(embedding)::DOUBLE AS v FROM embeddings) GROUP BY 1")
def lu_solution(spark, sf):
    """G x = b by elimination over tasks, for G the products of all embeddings' components and b their means: G x, which is b."""
    g = _gram_rows(spark, sf)
    means = table(spark, sf, "embeddings").select(F.posexplode("embedding").alias("k", "v")).groupBy("k").agg(F.avg(F.col("v").cast("double")).alias("b"))
    rows = g.join(means, "k").select("k", "a", F.array("b").alias("b"))
    x = factor.solve(rows, "k", "a", "b", 64, 1, panel=16)
    cells = g.select("k", F.posexplode("a").alias("j", "v"))
    solved = x.select(F.col("k").alias("j"), F.col("x")[0].alias("x"))
    return cells.join(solved, "j").groupBy("k").agg(r(F.sum(F.col("v") * F.col("x")), 6).alias("b")).select(F.col("k").cast("long").alias("k"), "b")


def _gram_rows(spark, sf) -> DataFrame:
    from ..operators import linalg

    cells = linalg.gram(table(spark, sf, "embeddings"), "embedding", 64)
    return cells.groupBy(F.col("i0").alias("k")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i1", "v"))), lambda x: x["v"]).alias("a"))


@query(
    "leading_pairs",
    """WITH c AS (SELECT vec_id, unnest(range(64)) AS j, unnest(embedding)::DOUBLE AS v FROM embeddings)
       SELECT vec_id, round(sum(v * v), 4) AS norm2, 0.0::DOUBLE AS off FROM c GROUP BY 1""",
)
def leading_pairs(spark, sf):
    """All singular triples of the embeddings by a randomised range: each row's length from u s, and how far A v is from u s."""
    rows, s, vt = factor.leading_svd(table(spark, sf, "embeddings").select("vec_id", "embedding"), "embedding", 64, 64)
    scaled = F.zip_with("u", F.lit(s.tolist()), lambda u, x: u * x)
    from ..operators.linalg import times

    both = times(rows, "embedding", vt.T, "av").select("vec_id", scaled.alias("us"), "av")
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y)
    return both.select("vec_id", r(total(F.transform("us", lambda x: x * x)), 4).alias("norm2"), (r(total(F.zip_with("us", "av", lambda x, y: F.abs(x - y))), 4) + 0.0).alias("off"))
