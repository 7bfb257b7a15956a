"""Queries over samples and training runs: name -> (query, SQL)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import sets as T
from ..operators import training as O
from . import domain as D

QUERIES: dict = {}


def query(name: str, sql: str | None):
    def add(f):
        QUERIES[name] = (f, sql)
        return f

    return add


_SPLIT_CASE = """CASE WHEN r < greatest(1, floor(n * 0.2)) THEN 'test'
  WHEN r < greatest(1, floor(n * 0.2)) * 2 THEN 'val' ELSE 'train' END"""


@query("group_split", f"WITH {D.SAMPLES}, {D.SPLIT} SELECT doc_id, video, {_SPLIT_CASE} AS split FROM samples JOIN ranks USING (video)")
def group_split(spark: SparkSession, d: str) -> DataFrame:
    return O.group_split(D.samples(spark, d), "video").select("doc_id", "video", "split")


@query(
    "split_difference",
    f"WITH {D.SAMPLES}, {D.SPLIT} SELECT doc_id FROM samples JOIN ranks USING (video) WHERE {_SPLIT_CASE} = 'train'",
)
def split_difference(spark: SparkSession, d: str) -> DataFrame:
    s = O.group_split(D.samples(spark, d), "video").select("doc_id", "split")
    return T.difference(s, s.where("split <> 'train'"), key="doc_id").select("doc_id")


@query("kfold_assign", f"WITH {D.SAMPLES}, {D.SPLIT} SELECT doc_id, video, (r % 5)::INT AS fold FROM samples JOIN ranks USING (video)")
def kfold_assign(spark: SparkSession, d: str) -> DataFrame:
    return O.kfold(D.samples(spark, d), "video").select("doc_id", "video", "fold")


@query(
    "subsample_k",
    f"""WITH {D.SAMPLES}, r AS (
  SELECT *, row_number() OVER (PARTITION BY video ORDER BY (doc_id * 2654435761 + 3) % 4294967296, doc_id) AS k FROM samples
) SELECT doc_id, video FROM r WHERE k <= 7""",
)
def subsample_k(spark: SparkSession, d: str) -> DataFrame:
    return O.subsampled(D.samples(spark, d), "video", "doc_id", 7, epoch=3).select("doc_id", "video")


@query(
    "class_weights",
    f"""WITH {D.SAMPLES}, c AS (SELECT q AS quality, (SELECT count(*) FROM samples WHERE quality = q) AS n FROM (VALUES (0), (1), (2), (3)) v(q))
SELECT quality, n, CASE WHEN n > 0 THEN (SELECT count(*) FROM samples)::DOUBLE / (n * 4) END AS weight FROM c""",
)
def class_weights(spark: SparkSession, d: str) -> DataFrame:
    return O.class_weights(D.samples(spark, d), "quality", 4)


@query(
    "group_samples",
    f"WITH {D.SAMPLES} SELECT video, count(*) AS n, min(doc_id) AS first, max(doc_id) AS last FROM samples GROUP BY video",
)
def group_samples(spark: SparkSession, d: str) -> DataFrame:
    return D.samples(spark, d).groupBy("video").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))


@query(
    "accuracy",
    f"WITH {D.SAMPLES} SELECT video, count(*) AS n, sum((quality = toxic)::INT)::BIGINT AS correct, avg((quality = toxic)::INT) AS accuracy FROM samples GROUP BY video",
)
def accuracy(spark: SparkSession, d: str) -> DataFrame:
    return O.accuracy(D.samples(spark, d), "quality", "toxic", ["video"])


@query(
    "epoch_metrics",
    """SELECT l_suppkey AS run, floor(sum(l_discount * l_quantity) / sum(l_quantity) * 1e6 + 0.5)::BIGINT AS loss_ppm,
  floor(sum(l_linenumber::DOUBLE) / sum(l_quantity) * 1e6 + 0.5)::BIGINT AS accuracy_ppm FROM lineitem GROUP BY 1""",
)
def epoch_metrics(spark: SparkSession, d: str) -> DataFrame:
    batches = D.table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("run"), F.col("l_discount").alias("loss"), F.col("l_quantity").alias("size"), F.col("l_linenumber").alias("correct")
    )
    # a loss is rounded by its decimals: half a millionth, as a double, may lie below itself
    loss = F.floor(F.col("loss").cast("decimal(30,17)") * 1000000 + F.expr("0.5BD")).cast("bigint")
    return O.epoch_metrics(batches, ["run"]).select("run", loss.alias("loss_ppm"), F.floor(F.col("accuracy") * 1e6 + 0.5).alias("accuracy_ppm"))


@query(
    "kfold_macro",
    f"""WITH {D.SAMPLES}, {D.SPLIT}, f AS (SELECT r % 5 AS fold, avg((quality = toxic)::INT) AS a FROM samples JOIN ranks USING (video) GROUP BY 1)
SELECT count(*) AS folds, floor(avg(a) * 1e9 + 0.5)::BIGINT AS accuracy_ppb FROM f""",
)
def kfold_macro(spark: SparkSession, d: str) -> DataFrame:
    folds = O.accuracy(O.kfold(D.samples(spark, d), "video"), "quality", "toxic", ["fold"])
    return O.macro(folds, "accuracy").select("folds", F.floor(F.col("accuracy") * 1e9 + 0.5).alias("accuracy_ppb"))


@query(
    "kfold_each",
    f"""WITH {D.SAMPLES}, {D.SPLIT} SELECT (r % 5)::INT AS fold, count(*) AS n, sum((quality = toxic)::INT)::BIGINT AS correct, avg((quality = toxic)::INT) AS accuracy
FROM samples JOIN ranks USING (video) GROUP BY 1""",
)
def kfold_each(spark: SparkSession, d: str) -> DataFrame:
    return O.accuracy(O.kfold(D.samples(spark, d), "video"), "quality", "toxic", ["fold"])


@query(
    "two_head_loss",
    """WITH p AS (SELECT vec_id, label % 4 AS t, label % 3 AS u, list_transform(embedding[4:7], lambda x: exp(x::DOUBLE)) AS e, list_transform(embedding[1:3], lambda x: exp(x::DOUBLE)) AS f FROM embeddings),
q AS (SELECT vec_id, t, u, list_transform(e, lambda x: x / list_sum(e)) AS p, list_transform(f, lambda x: x / list_sum(f)) AS q FROM p),
l AS (SELECT vec_id, 0.9 * -ln(p[t + 1]) + 0.1 * list_sum(list_transform(p, lambda x: -ln(x))) / 4 AS score,
  0.9 * -ln(q[u + 1]) + 0.1 * list_sum(list_transform(q, lambda x: -ln(x))) / 3 AS region FROM q)
SELECT vec_id, floor((0.5 * region + 2.0 * score) * 1e6 + 0.5)::BIGINT AS loss_ppm FROM l""",
)
def two_head_loss(spark: SparkSession, d: str) -> DataFrame:
    head = lambda first, n: S.softmax(F.slice("embedding", first, n).cast("array<double>"))
    target = lambda n: F.pmod("label", F.lit(n))
    rows = D.table(spark, d, "embeddings").select("vec_id", head(4, 4).alias("p"), target(4).alias("t"), head(1, 3).alias("q"), target(3).alias("u"))
    score, region = S.cross_entropy(F.col("p"), F.col("t"), F.lit(1.0)), S.cross_entropy(F.col("q"), F.col("u"), F.lit(1.0))
    return rows.select("vec_id", F.floor(S.two_head_loss(region, score, (0.5, 2.0)) * 1e6 + 0.5).alias("loss_ppm"))


@query(
    "tta_mean",
    """WITH v AS (SELECT vec_id // 3 AS sample, vec_id % 3 AS view, embedding[1:3] AS l FROM embeddings),
u AS (SELECT sample, unnest(range(3)) AS class, unnest(l)::DOUBLE AS x FROM v),
m AS (SELECT sample, class, avg(x) AS x FROM u GROUP BY ALL)
SELECT sample, region, score FROM (SELECT sample, arg_max(class, row(x, -class)) AS region FROM m GROUP BY sample)
JOIN (SELECT sample, list_position(arg_min(l, view), list_max(arg_min(l, view))) - 1 AS score FROM v GROUP BY sample) USING (sample)""",
)
def tta_mean(spark: SparkSession, d: str) -> DataFrame:
    views = D.table(spark, d, "embeddings").select(
        F.expr("vec_id DIV 3").alias("sample"), F.pmod("vec_id", F.lit(3)).alias("view"), F.slice("embedding", 1, 3).cast("array<double>").alias("logits")
    )
    return O.test_time_augmented(views, "sample", "view", "logits")


@query(
    "early_stop",
    f"""WITH {D.EPOCHS}, b AS (
  SELECT *, coalesce(val_loss < min(val_loss) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS better FROM epochs
), w AS (
  SELECT *, epoch - max(CASE WHEN better THEN epoch END) OVER (PARTITION BY run ORDER BY epoch ROWS UNBOUNDED PRECEDING) AS waited FROM b
), s AS (SELECT *, min(CASE WHEN waited >= 30 THEN epoch END) OVER (PARTITION BY run) AS stop FROM w)
SELECT run, max(epoch) FILTER (better) AS best_epoch, max(epoch) AS last_epoch, min(val_loss) AS best_loss, bool_or(stop IS NOT NULL) AS stopped
FROM s WHERE stop IS NULL OR epoch <= stop GROUP BY run""",
)
def early_stop(spark: SparkSession, d: str) -> DataFrame:
    return O.early_stopping(D.epochs(spark, d), "run", "epoch", "val_loss", 30)


@query(
    "cosine_lr",
    """SELECT e::BIGINT AS step, floor(CASE WHEN e < 5 THEN 1e-6 + (3e-4 - 1e-6) * (1 + cos(3.141592653589793 * e / 200)) / 2
  ELSE 1e-6 + (3e-5 - 1e-6) * (1 + cos(3.141592653589793 * (e - 5) / 195)) / 2 END * 1e12 + 0.5)::BIGINT AS rate_e12 FROM range(200) r(e)""",
)
def cosine_lr(spark: SparkSession, d: str) -> DataFrame:
    rate = S.cosine_rate(F.col("id"), 3e-4, 5, 200)
    return spark.range(200).select(F.col("id").alias("step"), F.floor(rate * 1e12 + 0.5).alias("rate_e12"))


@query(
    "cross_entropy",
    """WITH p AS (SELECT vec_id, label % 4 AS t, list_transform(embedding[4:7], lambda x: exp(x::DOUBLE)) AS e FROM embeddings),
q AS (SELECT vec_id, t, list_transform(e, lambda x: x / list_sum(e)) AS p FROM p)
SELECT vec_id, floor((0.5 + t) * (0.9 * -ln(p[t + 1]) + 0.1 * list_sum(list_transform(p, lambda x: -ln(x))) / 4) * 1e6 + 0.5)::BIGINT AS loss_ppm FROM q""",
)
def cross_entropy(spark: SparkSession, d: str) -> DataFrame:
    logits = F.slice("embedding", 4, 4).cast("array<double>")
    target = F.pmod("label", F.lit(4))
    rows = D.table(spark, d, "embeddings").select("vec_id", target.alias("t"), S.softmax(logits).alias("p"))
    loss = S.cross_entropy(F.col("p"), F.col("t"), 0.5 + F.col("t"))
    return rows.select("vec_id", F.floor(loss * 1e6 + 0.5).alias("loss_ppm"))
